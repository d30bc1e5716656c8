import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from gleaner.llm import pieces, quality, simhash, toxicity
from tests.llm.test_decontaminate import by_force
from tests.llm.test_simhash import plain_groups


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(6)
    common = "the of and to a in is on for with river bridge town hill cart road".split()
    passage = " ".join(rng.choice(common) + str(rng.randrange(99)) for _ in range(25))
    docs, labels = [], []
    for i in range(500):
        words = [rng.choice(common) + rng.choice(["", "s", "er"]) for _ in range(rng.randrange(30, 80))]
        toxic, bad = i % 5 == 0, i % 7 == 0
        if toxic:
            words[3:3] = ["grobnik", "vloop"]
        if i % 11 == 0:
            words += passage.split()
        text = " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words)
        docs.append((i, text))
        if i % 2:
            labels.append((i, int(not bad), int(toxic)))
    docs += [(1000 + i, docs[i][1]) for i in range(0, 60, 3)]
    docs += [(2000 + i, docs[i][1].replace(" ", "  ", 1)) for i in range(1, 60, 3)]
    docs += [(None, "no id of the town"), (None, "no id of the town"), (3000, ""), (3001, None), (1, docs[1][1])]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, passage), (1, "an item that no document holds at all in these rows")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages_against_plain_versions(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    by_name = dict(corpus_pipeline.STAGES)
    assert [*by_name] == ["toxicity", "quality", "near_duplicates", "decontaminate", "pieces"]
    rows = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, after = rows(docs), rows(kept := stage(spark, docs, folder))
        assert kept.columns == docs.columns
        if name in ("toxicity", "quality"):
            ids = sorted({d for d, _ in before if d in labels})
            text = dict(before)
            module, column = (toxicity, "toxic") if name == "toxicity" else (quality, "quality")
            features = toxicity.Terms() if name == "toxicity" else quality.Grams()
            model = module.fit([features(pa.array([text[d]]))[1] for d in ids], np.array([labels[d][column] for d in ids]))
            scores = model.scores(pa.array([t or "" for _, t in before]))
            assert after == [r for r, s in zip(before, scores, strict=True) if (s >= 0.3) == (name == "quality")]
            assert 0 < len(before) - len(after) < len(before) / 3
        elif name == "near_duplicates":
            heads = {least for d, _, least in plain_groups([r for r in before if r[0] is not None])}
            assert sorted(str(d) for d, _ in after if d is not None) == sorted(heads) and len(after) == len(heads) + 1
        else:
            hit = {(d, t): by_force([(d, t)], items)[0][-1] for d, t in before}
            assert after == [r for r in before if not hit[r]] and len(after) < len(before)
        docs = kept
    last = by_name["pieces"](spark, docs, folder).collect()
    assert all(r.decodes for r in last) and len(last) == docs.count()
    whole = corpus_pipeline.run(spark, folder).collect()
    assert sorted(map(str, whole)) == sorted(map(str, last))
    codec = pieces.codec(pieces.model_path())
    text = dict(rows(docs))
    assert all(len(codec.encode(text[r.doc_id])) == 4 * r.n_pieces for r in whole)


def test_clean_documents_stay(spark, folder):
    out = {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()}
    clean = {i for i in range(500) if i % 5 and i % 7 and i % 11}
    assert len(clean - out) <= 2 and not {i for i in out if i is not None and i < 500 and (i % 5 == 0 or i % 7 == 0)}
    assert simhash.RADIUS == 3
