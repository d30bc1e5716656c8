import random

import numpy as np
import pytest
import xxhash

from gleaner.llm import simhash


def plain_print(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or "")).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\v", " ").replace("\f", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(rows):
    """(doc_id, text) -> {(doc_id, print, least doc_id)} by comparing all pairs."""
    prints = [plain_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return sorted((str(d), f"{p:016x}", str(least.get(find(i)))) for i, ((d, _), p) in enumerate(zip(rows, prints, strict=True)))


def near(rng, n, clusters, spread):
    centres = [rng.getrandbits(64) for _ in range(clusters)]
    out = set()
    while len(out) < n:
        x = rng.choice(centres)
        for _ in range(rng.randrange(spread)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return sorted(out)


def plain_labels(fps):
    root = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = i, j
                while root[a] != a:
                    a = root[a]
                while root[b] != b:
                    b = root[b]
                root[max(a, b)] = min(a, b)
    return root


def test_gray_neighbours_differ_by_one_bit():
    x = np.arange(1 << 12, dtype=np.uint64)
    code = x ^ (x >> np.uint64(1))
    assert (simhash.gray_rank(code) == x).all()


@pytest.mark.parametrize("n,clusters,spread", [(1, 1, 1), (9, 2, 4), (300, 3, 8), (400, 60, 6), (500, 1, 5)])
def test_search_finds_every_link(n, clusters, spread, monkeypatch):
    monkeypatch.setattr(simhash, "STEP_PAIRS", 512)
    fps = near(random.Random(n), n, clusters, spread)
    fps = np.array(fps, dtype=np.uint64)
    fps = fps[np.argsort(simhash.gray_rank(fps))]
    label = simhash.search(np.zeros(n, np.int64), fps)
    want = plain_labels([int(x) for x in fps])

    def top(i):
        while want[i] != i:
            i = want[i]
        return i

    assert [int(x) for x in label] == [top(i) for i in range(n)]


@pytest.mark.parametrize("node_rows", [20_000, 8])
def test_links_and_components_over_all_pairs(spark, monkeypatch, node_rows):
    monkeypatch.setattr(simhash, "NODE_ROWS", node_rows)
    rng = random.Random(7)
    fps = near(rng, 400, 25, 9)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    got = {r.a: r.b for r in simhash.components(edges).collect()}
    root = plain_labels(fps)

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    groups = {}
    for i in range(len(fps)):
        groups.setdefault(top(i), []).append(signed[i])
    want = {x: min(g) for g in groups.values() for x in g if x != min(g)}
    assert got == want


def test_groups_against_brute_force(spark):
    rng = random.Random(1)
    base = [" ".join(rng.choice("abcdefghij") + str(rng.randrange(30)) for _ in range(200)) for _ in range(6)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(40):
        words = rng.choice(base).split()
        words[rng.randrange(len(words))] = "x"
        rows.append((100 + i, " ".join(words)))
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, "One"), (204, "one"), (205, "a\xa0b É"), (None, base[0]), (0, base[0])]
    rows += [(206, "lang " * 30_000), (207, "É é Ab"), (208, "É é aB")]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, fp int")
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.report(df).collect())
    assert got == plain_groups(rows)


def test_empty_table(spark):
    assert simhash.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0
