"""Operators on embeddings against plain versions, and on odd tables."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pseudoveil.llm import bitplanes, whitening
from pseudoveil.llm.vectors import fixed_point, vector_rows

SCHEMA = "vec_id long, embedding array<float>"
CLASHING = SCHEMA + ", id long, vector string, planes string, x long, cluster long, norm string"


def usable(rows, dim=64):
    return [(i, [float(np.float32(c)) for c in v]) for i, v in rows
            if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]


def plain_clusters(rows, k=16, rounds=3):
    """Lloyd rounds with Python integers: {row number: (id, cluster, distance)}, centroids."""
    kept = [(i, [math.floor(64 * c) for c in v]) for i, v in usable(rows)]
    start = sorted(kept, key=lambda r: hashlib.sha256(f"1:{r[0]}".encode()).hexdigest())[:k]
    centroids = [v for _, v in start]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(col) // len(groups[j]) for col in zip(*groups[j])] if j in groups else c for j, c in enumerate(centroids)]
    return [(i, *nearest(v)[::-1]) for i, v in kept], centroids


def random_rows(n, seed=3, dim=64, scale=1.0):
    r = np.random.default_rng(seed)
    return [(i, [float(c) for c in np.float32(r.standard_normal(dim) * scale)]) for i in range(n)]


ODD = [(1000, None), (1001, []), (1002, [1.0] * 63), (1003, [1.0] * 63 + [None]), (1004, [float("nan")] + [0.0] * 63),
       (1005, [float("inf")] + [0.0] * 63), (1006, [0.0] * 64), (1006, [0.0] * 64), (1007, [-0.0] * 64), (1008, [3e5] * 64)]


def test_planes_are_the_components():
    r = np.random.default_rng(1)
    for top in (1, 2, 63, 64, 1 << 20):
        x = r.integers(-top, top + 1, (50, 64))
        bits = bitplanes.bits_needed(x)
        p = bitplanes.planes(x, bits)
        assert [bitplanes.components_of(row) for row in p.view(np.int64).tolist()] == x.tolist()
        c = r.integers(-3 * top, 3 * top + 1, (5, 64))
        assert (bitplanes.distances(p, (x * x).sum(axis=1), c) == ((x[:, None] - c[None]) ** 2).sum(axis=2)).all()
        assert (bitplanes.plane_sums(p, np.arange(50) % 3, 3) == [x[np.arange(50) % 3 == j].sum(axis=0) for j in range(3)]).all()


def test_clusters_match_plain_version(spark):
    rows = random_rows(300) + ODD + random_rows(40, seed=4, scale=40)
    unique = [r for n, r in enumerate(rows) if r[0] not in {x[0] for x in rows[:n]}]
    got, centroids = bitplanes.cluster(spark.createDataFrame(unique, SCHEMA).repartition(5))
    want, want_centroids = plain_clusters(unique)
    assert centroids.tolist() == want_centroids
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_clusters_of_odd_tables(spark):
    none, centroids = bitplanes.cluster(spark.createDataFrame([], SCHEMA))
    assert none.collect() == [] and centroids.shape == (0, 64)
    few, centroids = bitplanes.cluster(spark.createDataFrame([(None, [1.0] * 64), (3, [2.0] * 64), (3, [2.0] * 64)], SCHEMA))
    assert len(centroids) == 3 and sorted(map(tuple, few.collect()), key=str) == [(3, 0, 0), (3, 0, 0), (None, 2, 0)]
    rows = [(*r, 1, "v", "p", 2, 3, "n") for r in random_rows(30)]
    clash, _ = bitplanes.cluster(spark.createDataFrame(rows, CLASHING))
    assert clash.columns == ["id", "cluster", "distance"] and clash.count() == 30
    with pytest.raises(Exception, match="beyond|too large"):
        bitplanes.cluster(spark.createDataFrame([(1, [1e30] * 64)], SCHEMA))


def test_clusters_do_not_depend_on_partitions_or_batches(spark):
    rows = random_rows(200) + [(500 + i, [0.5] * 64) for i in range(300)]
    a, ca = bitplanes.cluster(spark.createDataFrame(rows, SCHEMA).coalesce(1))
    b, cb = bitplanes.cluster(spark.createDataFrame(rows, SCHEMA).repartition(9))
    assert ca.tolist() == cb.tolist() and sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


# --------------------------------------------------------------------------
# whitening
# --------------------------------------------------------------------------

def test_counts_match_eigenvalues():
    r = np.random.default_rng(2)
    for d in (1, 2, 5, 20):
        a = r.standard_normal((d, d))
        a = a + a.T
        e = np.linalg.eigvalsh(a)
        for s in np.r_[e - 1e-6, e + 1e-6, 0.0]:
            assert whitening.count_above(a, float(s)) == (e > s).sum()
    assert whitening.count_above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1      # no diagonal pivot


@pytest.mark.parametrize("kind", ["random", "rank", "equal", "close", "diagonal", "large"])
def test_eigenpairs(kind):
    r = np.random.default_rng(5)
    d = 24
    q, _ = np.linalg.qr(r.standard_normal((d, d)))
    e = {"random": np.abs(r.standard_normal(d)), "rank": np.r_[np.arange(1.0, 6), np.zeros(d - 5)], "equal": np.full(d, 2.0),
         "close": 1 + 1e-13 * np.arange(d), "diagonal": np.arange(1.0, d + 1), "large": 10.0 ** np.arange(d)[::-1]}[kind]
    v = np.diag(e) if kind == "diagonal" else (q * e) @ q.T
    v = (v + v.T) / 2
    values, vectors = whitening.leading_eigenpairs(v, 16)
    top = np.sort(np.linalg.eigvalsh(v))[::-1]
    assert len(values) == {"rank": 5, "large": 16}.get(kind, 16) or kind == "large"
    assert np.allclose(values, top[:len(values)], rtol=0, atol=1e-13 * top[0])
    assert np.abs(vectors @ v - values[:, None] * vectors).max() < 1e-13 * top[0]
    assert np.abs(vectors @ vectors.T - np.eye(len(values))).max() < 1e-13


def plain_whitening(rows, dim, k):
    kept = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in usable(rows, dim)]
    fit = sorted({tuple(x) for _, x in kept})
    n, total = len(fit), [sum(col) for col in zip(*fit)]
    f = np.array(fit, float) - np.array(total) / n
    e, u = np.linalg.eigh(f.T @ f / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    out = {}
    for i, x in kept:
        out[i] = (sum((n * a - s) ** 2 for a, s in zip(x, total)), (np.array(x) - np.array(total) / n) @ u / np.sqrt(e))
    return n, e, np.trace(f.T @ f / n), out


def test_whitening_matches_plain_version(spark):
    rows = random_rows(400) + [(2000 + i, [0.25] * 64) for i in range(200)] + [r for r in ODD if r[0] not in (1006, 1007, 1008)]
    w = whitening.fit_whitening(vector_rows(spark.createDataFrame(rows, SCHEMA).repartition(4), "vec_id", "embedding"))
    n, e, trace, want = plain_whitening(rows, 64, 16)
    assert w.n == n == 401 and np.allclose(w.values, e, rtol=1e-10) and math.isclose(w.trace, trace, rel_tol=1e-10) and w.identity_error < 1e-9
    got = whitening.whiten(vector_rows(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding"), w).collect()
    assert sorted(r["id"] for r in got) == sorted(want)
    sign = np.sign(np.array(got[0]["whitened"]) * want[got[0]["id"]][1])
    for r in got:
        deviation, z = want[r["id"]]
        assert int(r["deviation"]) == deviation and np.allclose(r["whitened"], z * sign, atol=1e-8)


def test_whitening_of_odd_tables(spark):
    def fit(rows, schema=SCHEMA):
        v = vector_rows(spark.createDataFrame(rows, schema), "vec_id", "embedding")
        w = whitening.fit_whitening(v)
        return w, whitening.whiten(v, w).collect()
    assert fit([])[1] == [] and fit([(1, None), (2, [])])[1] == []
    w, got = fit([(1, [1.0, 2.0]), (1, [1.0, 2.0])])
    assert w.n == 1 and got == []                                         # no direction with variance
    w, got = fit([(1, [0.0, 1.0]), (None, [1.0, 1.0]), (3, [1.0, 1.0]), (4, [1.0]), (5, [float("nan"), 0.0])])
    assert w.n == 2 and len(w.values) == 1 and sorted((r["id"], abs(round(r["whitened"][0], 9))) for r in got if r["id"]) == [(1, 1.0), (3, 1.0)]
    assert len(got) == 3
    rows = [(*r, 1, "v", "p", 2, 3, "n") for r in random_rows(40)]
    assert len(fit(rows, CLASHING)[1]) == 40
    w, got = fit([(1, [1e12, 0.0]), (2, [-1e12, 0.0]), (3, [1e12, 0.5])])                 # exact beyond 64-bit products
    total = sum(int(r["deviation"]) for r in got)
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in ([1e12, 0.0], [-1e12, 0.0], [1e12, 0.5])]
    s = [sum(c) for c in zip(*x)]
    assert total == sum((3 * a - b) ** 2 for v in x for a, b in zip(v, s))


def test_fixed_point():
    assert fixed_point(np.array([[-0.001, 0.999, 1.0]]), 64).tolist() == [[-1, 63, 64]]
    with pytest.raises(ValueError):
        fixed_point(np.array([[1e300]]), 64)


def test_queries_on_a_small_table(spark):
    from pseudoveil.llm import catalog
    rows = catalog.QUERIES["op12_whitening"](spark, "/root/testdata/sf0.001")
    facts = rows.agg(F.count("*").alias("n"), F.max("identity_error").alias("e"), F.countDistinct("explained").alias("k")).first()
    assert facts["n"] == 500 * 16 and facts["e"] < 1e-4 and facts["k"] == 16
