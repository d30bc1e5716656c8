import numpy as np
import pytest

from gleaner.llm import near_vectors as nv

SCHEMA = "vec_id long, embedding array<float>, label int, d string, uid long, n long"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, y, "extra", 1, 2) for i, v, y in rows], SCHEMA)


def plain(rows, cosine=nv.COSINE):
    """(vec_id, n_links, component_id) by comparing all pairs."""

    def unit(v):
        if v is None or not v or any(c is None or not np.isfinite(c) for c in v) or not any(v):
            return None
        x = np.array(v, np.float32).astype(np.float64)
        return x / np.sqrt((x * x).sum())

    units = [unit(v) if y is not None else None for _, v, y in rows]
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(units):
        for j in range(i):
            b = units[j]
            if a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b) and float(a @ b) >= cosine:
                n[i], n[j] = n[i] + 1, n[j] + 1
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted((str(r[0]), n[i], str(least.get(find(i)))) for i, r in enumerate(rows))


def got(df):
    return sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in df.collect())


def clustered(rng, clusters, each, d, spread):
    out = []
    for _ in range(clusters):
        c = rng.normal(size=d)
        c /= np.linalg.norm(c)
        for _ in range(each):
            v = c + rng.normal(size=d) * spread * rng.random() / np.sqrt(d)
            out.append((v * rng.uniform(0.1, 10)).tolist())
    return out


@pytest.mark.parametrize("d,spread", [(64, 0.5), (3, 0.8), (1, 1.0), (100, 0.45)])
def test_all_pairs_of_a_label(spark, d, spread):
    rng = np.random.default_rng(d)
    rows = [(i, v, i % 2) for i, v in enumerate(clustered(rng, 12, 14, d, spread))]
    assert got(nv.groups(frame(spark, rows))) == plain(rows)


def test_blocks_and_further_rotations(spark, monkeypatch):
    monkeypatch.setattr(nv, "LEFT", 7)
    monkeypatch.setattr(nv, "RIGHT", 11)
    monkeypatch.setattr(nv, "SMALL", 0)
    monkeypatch.setattr(nv, "STEP", 4)
    monkeypatch.setattr(nv, "DEALT", 9)
    monkeypatch.setattr(nv, "PAIRS", 13)
    rng = np.random.default_rng(5)
    rows = [(i, v, 0) for i, v in enumerate([*clustered(rng, 2, 60, 64, 0.45), *clustered(rng, 30, 2, 64, 0.2)])]
    assert got(nv.groups(frame(spark, rows))) == plain(rows)
    monkeypatch.setattr(nv, "NODE", 0.01)  # two rotations
    found, want = got(nv.groups(frame(spark, rows))), plain(rows)
    assert all(f[0] == w[0] and f[1] <= w[1] for f, w in zip(found, want, strict=True))
    assert sum(f[1] for f in found) >= 0.995 * sum(w[1] for w in want)


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(1)
    x = nv.directions(rng.normal(size=(4000, 64)))
    z = nv.directions(rng.normal(size=(4000, 64)))
    z = nv.directions(z - (x * z).sum(axis=1, keepdims=True) * x)
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * z
    code, factor = nv.codes(nv.turned(x))
    estimate = (nv.turned(y) * nv.signs(code)).sum(axis=1) / factor
    assert abs(estimate.mean() - 0.93) < 4 * estimate.std() / np.sqrt(4000)
    assert all(nv.kept(nv.turned(y[i : i + 1]), code[i : i + 1], factor[i : i + 1], 0.9299999)[0, 0] for i in range(4000))
    far = nv.directions(rng.normal(size=(300, 64)))
    assert nv.kept(nv.turned(far), code, factor).mean() < 1e-4


@pytest.mark.parametrize("levels,least", [(1, 0.999), (2, 0.997)])
def test_pairs_at_the_threshold_meet(levels, least):
    rng = np.random.default_rng(2)
    x = nv.directions(rng.normal(size=(3000, 64)))
    z = nv.directions(rng.normal(size=(3000, 64)))
    z = nv.directions(z - (x * z).sum(axis=1, keepdims=True) * x)
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * z
    a, b = nv.cells(x, levels, nv.turned(x)), nv.cells(y, levels, nv.turned(y))
    met = (a[:, :1] == b).any(axis=1) | (b[:, :1] == a).any(axis=1)
    assert met.mean() >= least


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    v = [1.0, 2.0, 3.0]
    rows = [
        (1, v, 0), (2, v, 0), (2, v, 0), (3, v, 1), (4, v, None), (None, v, 0), (5, None, 0), (6, [], 0), (7, [0.0] * 3, 0), (8, [nan, 1.0, 1.0], 0),
        (9, [None, 1.0, 1.0], 0), (10, [inf, 1.0, 1.0], 0), (11, [2.0, 4.0, 6.0], 0), (12, [1.0, 2.0, 3.0, 0.0], 0), (None, [5.0, -1.0, 0.0], 0), (13, [1e-30, 2e-30, 3e-30], 0), (14, [1e30, 2e30, 3e30], 0),
    ]
    df = frame(spark, rows)
    assert got(nv.groups(df)) == plain(rows)
    out = {(r.vec_id, r.n_links): r.kept for r in nv.report(df).collect()}
    assert out[1, 6] and not out[2, 6] and out[4, 0] and out[None, 0] and out[7, 0]
    assert nv.report(df.limit(0)).count() == 0
    assert got(nv.groups(df.filter("vec_id = 5"))) == [("5", 0, "5")]


def test_a_large_group_gives_a_row_a_vector(spark):
    """Linear rows from a group whose pairs are many."""
    rng = np.random.default_rng(8)
    rows = [(i, v, 0) for i, v in enumerate(clustered(rng, 1, 700, 64, 0.2))]
    out = nv.groups(frame(spark, rows)).collect()
    assert {r.n_links for r in out} == {699} and {r.component_id for r in out} == {0}
