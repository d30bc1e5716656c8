import random

import pytest

import corpus_pipeline
from gleaner.llm import near_copies


def plain_sets(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_heads(rows):
    """The least doc_ids of groups, by comparing all pairs."""
    sets = [plain_sets(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted(least.values())


@pytest.fixture(scope="module")
def rows():
    """Texts and copies of them with some words changed, added or cut, on both sides of the threshold."""
    rng = random.Random(3)
    line = "this line of the licence stands in many of the texts as it is"
    base = [" ".join(rng.choice("abcdefghij") + str(rng.randrange(40)) for _ in range(rng.randrange(20, 300))) for _ in range(12)]
    base = [t + " " + line if i % 2 else t for i, t in enumerate(base)]
    out = list(base)
    for _ in range(110):
        words = rng.choice(base).split()
        for _ in range(rng.randrange(1, 2 + len(words) // 30)):
            words[rng.randrange(len(words))] = "x" + str(rng.randrange(99))
        out.append("  ".join(words[rng.randrange(4) :]).upper())
    out += ["", None, " \n", "one", "ONE", "one two three four", "one two three four five", line]
    return list(enumerate(out))


def test_stage_finds_all_similar_pairs(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r.doc_id for r in corpus_pipeline.stage_near_duplicates(spark, docs, "").collect())
    assert got == plain_heads(rows) and 12 < len(got) < len(rows) - 40


def test_steps_and_sample_don_t_change_groups(spark, rows, monkeypatch):
    for name, small in (("NODE_ROWS", 3), ("BATCH_ROWS", 2), ("SAMPLE_ROWS", 20), ("HOT_SHINGLES", 7), ("CHECKED", 600)):
        monkeypatch.setattr(near_copies, name, small)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(r.doc_id for r in near_copies.representatives(docs).collect()) == plain_heads(rows)


def test_no_rows(spark):
    assert near_copies.representatives(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_null_and_repeated_ids(spark):
    rng = random.Random(8)
    a, b, c, d = (" ".join("w" + str(rng.randrange(999)) for _ in range(60)) for _ in range(4))
    rows = [(1, a), (None, a), (None, a.replace("w", "W") + " more"), (1, b), (2, b), (None, c), (None, c), (None, c + " more"), (5, d), (5, d)]
    got = [tuple(r) for r in near_copies.representatives(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    assert len(got) == 4 and {(1, a), (1, b), (5, d)} < set(got) and {(i, t[: len(c)]) for i, t in got if i is None} == {(None, c)}
