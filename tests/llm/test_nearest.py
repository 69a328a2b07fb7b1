import numpy as np
import pytest

from narrata.llm import nearest as N


def brute(rows, k, least):
    out = set()
    for g in {r[1] for r in rows}:
        own = sorted((r[0], np.array(r[2])) for r in rows if r[1] == g)
        ids, v = [i for i, _ in own], np.array([v for _, v in own])
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        s = np.round(v @ v.T, 6)
        np.fill_diagonal(s, -9)
        # The ids are sorted, so a stable sort settles ties by id.
        for i, near in enumerate(np.argsort(-s, axis=1, kind="stable")[:, :k].tolist()):
            out |= {(ids[i], ids[j]) for j in near if s[i, j] >= least}
    return out


def vectors(n, d, seed, copies=0):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, d))
    v[n // 2 :: 2] = v[: len(v[n // 2 :: 2])] + rng.normal(size=v[n // 2 :: 2].shape) * 0.05
    rows = [(f"v{i:04d}", f"m{i % 2}", x.round(3).tolist()) for i, x in enumerate(v)]
    return rows + [(f"w{i:04d}", rows[0][1], rows[0][2]) for i in range(copies)]


@pytest.mark.parametrize("least", [None, 0.96])
def test_equals_brute_force(spark, least):
    rows = vectors(3000, 16, 3, copies=40)
    df = spark.createDataFrame(rows, "id string, m string, v array<double>").repartition(3)
    got = N.nearest(df, id_col="id", vector_col="v", group_col="m", k=4, min_similarity=least, cell_rows=64, chunk_rows=256).collect()
    assert {(r.id, r.neighbour_id) for r in got} == brute(rows, 4, -2 if least is None else least)
    assert all(r["rank"] <= 4 and r.group in ("m0", "m1") for r in got)


def test_bounds_hold():
    rng = np.random.default_rng(1)
    u = rng.normal(size=(300, 24)).astype(np.float32)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    code, scale, err = N.quantised(u)
    low, err2 = N.refined(u, code, scale)
    for raw, worst in ((N.packed(code, None, scale, err), 0.02), (N.packed(code, low, scale, err2), 0.0002)):
        v, e = N.unpacked(raw, 24)
        bound = e[:, None] + e[None] + e[:, None] * e[None]
        assert (np.abs(v @ v.T - u @ u.T) <= bound + 1e-5).all() and bound.max() < worst


def test_dense_group(spark):
    """A third of all rows in one near-equal group: as brute force, and without all its pairs."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(3000, 32))
    v[:1000] = v[0] + rng.normal(size=(1000, 32)) * 0.1
    rows = [(f"v{i:04d}", "m", x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "id string, m string, v array<double>")
    got = N.nearest(df, id_col="id", vector_col="v", group_col="m", k=5, min_similarity=0.96, cell_rows=64, chunk_rows=400, fine_rows=256).select("id", "neighbour_id").collect()
    want = brute(rows, 5, 0.96)
    assert len(want) >= 5000 and len(want & {tuple(r) for r in got}) >= 0.999 * len(want)
    u = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)[:1000]
    code, scale, _ = N.quantised(u)
    low, err = N.refined(u, code, scale)
    i, _ = N.tile(*N.unpacked(N.packed(code, low, scale, err), 32), *N.unpacked(N.packed(code, low, scale, err), 32), 5, 0.96, True)
    assert len(i) < 20 * len(u)


@pytest.mark.parametrize("d", [32, 768])
def test_recall_of_lists(spark, d):
    """Probing a measured number of cells finds at least the recall asked for, and blocks and salts lose nothing."""
    rows = vectors(4000, d, 7)
    rng = np.random.default_rng(8)
    # Real vectors lie in groups: 200 directions with noise.
    c = rng.normal(size=(200, d))
    rows = [(i, "m", (c[n % 200] + 1.2 * rng.normal(size=d)).round(4).tolist()) for n, (i, _, _) in enumerate(rows)]
    df = spark.createDataFrame(rows, "id string, m string, v array<double>").repartition(3)
    got = N.nearest(df, id_col="id", vector_col="v", group_col="m", k=5, cell_rows=32, block_rows=300, min_probes=4).select("id", "neighbour_id").collect()
    want = brute(rows, 5, -2)
    assert len(got) == 5 * len(rows) and len(want & {tuple(r) for r in got}) >= 0.9 * len(want)


def test_near_equal_group_looks_no_further(spark):
    """A third of all rows within rounding of each other: every list is full and as similar as brute force."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(2400, 16))
    v[:800] = v[0] + rng.normal(size=(800, 16)) * 1e-9
    df = spark.createDataFrame([(f"v{i:04d}", "m", x.tolist()) for i, x in enumerate(v)], "id string, m string, v array<double>")
    got = N.nearest(df, id_col="id", vector_col="v", group_col="m", k=3, cell_rows=32, block_rows=100, min_probes=8).collect()
    assert len(got) == 3 * 2400 and all(r.similarity > 1 - 1e-6 for r in got if r.id < "v0800")


def test_defined_results_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", "m", [1.0, 0.0]), ("a", "m", [1.0, 0.0]), ("b", "m", [2.0, 0.0]), ("c", "m", None), ("d", "m", []), ("e", "m", [0.0, 0.0]), ("f", "m", [nan, 1.0]), ("g", "m", [1.0]), ("h", None, [1.0, 0.0]), (None, "m", [1.0, 0.0]), ("i", "m", [inf, 1.0]), ("j", "n", [1.0, 0.0]), ("k", "m", [None, 1.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id string, m string, v array<double>, similarity int")
    got = N.nearest(df, id_col="id", vector_col="v", group_col="m", k=2, dim=2, min_similarity=0.9).collect()
    assert sorted((r.id, r.neighbour_id, round(r.similarity, 6)) for r in got) == [("a", "b", 1.0), ("b", "a", 1.0)]
    assert N.nearest(df.where("false"), id_col="id", vector_col="v", group_col="m").count() == 0
