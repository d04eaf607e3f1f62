import numpy as np
import pytest

from snapweave.llm import vectors as X

NAMES = "vec_id long, embedding array<float>, label int"


def brute(rows, least=0.93):
    ok = [(i, np.array(v, np.float64), lab) for i, v, lab in rows if i is not None and v is not None and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: 0 for i, _, _ in ok}
    up = {i: i for i, _, _ in ok}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(ok)):
        for b in range(a):
            (i, x, p), (j, y, q) = ok[a], ok[b]
            if p == q and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= least:
                links[i] += 1
                links[j] += 1
                lo, hi = sorted((root(i), root(j)))
                up[hi] = lo
    return {i: (links.get(i, 0), root(i) if i in up else i) for i, _, _ in rows}


def clusters(seed, n=40, size=12, spread=0.25, d=64):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(n):
        centre = rng.normal(size=d)
        centre /= np.linalg.norm(centre)
        for _ in range(int(rng.integers(1, size))):
            v = centre + spread * rng.normal(size=d) / d**0.5 * rng.random()
            rows.append((len(rows), [float(x) for x in v.astype(np.float32)], c % 3))
    return rows


def check(spark, rows, exact=True, **options):
    got = {r["vec_id"]: r for r in X.near_vectors(spark.createDataFrame(rows, NAMES), **options).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())
    if exact:
        assert {i: (r["n_links"], r["component_id"]) for i, r in got.items()} == want
    else:
        found, all_ = sum(r["n_links"] for r in got.values()), sum(n for n, _ in want.values())
        assert all(got[i]["n_links"] <= want[i][0] for i in want) and found >= 0.9 * all_
    return want


@pytest.mark.parametrize("block", [5, 1024])
def test_links_and_components_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(X, "BLOCK", block)
    want = check(spark, clusters(1))
    assert sum(n for n, _ in want.values()) > 100


def test_vectors_of_several_lengths(spark):
    rows = clusters(2, n=12) + clusters(3, n=3, d=3) + clusters(4, n=12, d=200) + [(0, [1.0, 0.001], 0), (0, [1.0, 0.0], 0), (0, [1.0], 0), (0, [2.0], 0), (0, [-2.0], 0)]
    rows = [(k, v, lab) for k, (_, v, lab) in enumerate(rows)]
    want = check(spark, rows)
    assert [want[len(rows) - k][0] for k in range(5, 0, -1)] == [1, 1, 1, 1, 0]


def test_one_large_cluster_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(X, "BLOCK", 100)
    rng = np.random.default_rng(6)
    centre = rng.normal(size=64)
    rows = [(k, (centre + 0.26 * rng.normal(size=64)).tolist() if k % 2 else rng.normal(size=64).tolist(), 0) for k in range(600)]
    rows += [(600 + k, centre.tolist(), 0) for k in range(90)]
    got = {r["vec_id"]: r for r in X.near_vectors(spark.createDataFrame(rows, NAMES)).collect()}
    want = brute(rows)
    found, all_ = sum(r["n_links"] for r in got.values()), sum(n for n, _ in want.values())
    assert all(got[i]["n_links"] <= want[i][0] for i in want) and 0.9995 * all_ <= found <= all_ and all_ > 100_000
    assert {i: r["component_id"] for i, r in got.items()} == {i: c for i, (_, c) in want.items()}


def test_repeated_ids_and_columns_of_clashing_names(spark):
    x, y = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, x, 0), (1, y, 0), (2, y, 0), (3, x, 0), (3, x, 0), (4, x, 1)]
    df = spark.createDataFrame(rows, NAMES).selectExpr("*", "1 as id", "2 as n", "'q' as vector", "3 as p", "4 as key", "5 as d")
    got = sorted(tuple(r) for r in X.near_vectors(df).collect())
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 2, 1, False), (3, 2, 1, False), (4, 0, 4, True)])


def test_signs_tell_near_from_far():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    r = rng.normal(size=a.shape)
    r -= (r * a).sum(1, keepdims=True) * a
    b = 0.93 * a + (1 - 0.93**2) ** 0.5 * r / np.linalg.norm(r, axis=1, keepdims=True)
    apart = lambda p, q: np.bitwise_count((p ^ q).view(np.uint64)).sum(1)
    s, t = X.bucket_codes(a)[1], X.bucket_codes(b)[1]
    assert apart(s, t).max() < X.most_apart(0.93) < 45 and (apart(s, np.roll(t, 1, 0)) > X.most_apart(0.93)).mean() > 0.99


def test_recall_at_the_threshold(spark):
    rng, rows = np.random.default_rng(4), []
    for k in range(300):
        a = rng.normal(size=64)
        a /= np.linalg.norm(a)
        r = rng.normal(size=64)
        r -= (r @ a) * a
        r /= np.linalg.norm(r)
        rows += [(2 * k, a.tolist(), 0), (2 * k + 1, (0.9302 * a + (1 - 0.9302**2) ** 0.5 * r).tolist(), 0)]
    check(spark, rows, exact=False)


def test_odd_vectors_link_with_nothing(spark):
    x, y = [1.0] + [0.0] * 63, [0.0, 1.0] + [0.0] * 62
    rows = [(1, x, 0), (2, x, 0), (3, x, 1), (4, x, None), (5, None, 0), (6, [0.0] * 64, 0), (7, [float("nan"), *x[1:]], 0), (8, [float("inf"), *x[1:]], 0), (9, [None, *x[1:]], 0), (10, y, 0), (11, [], 0), (12, [2.0 * v for v in x], 0), (13, [-v for v in x], 0)]
    want = check(spark, rows)
    assert want[1] == (2, 1) and want[12] == (2, 1) and want[3] == (0, 3)


def test_copies_and_empty_tables(spark):
    check(spark, [(k, [1.0, 2.0, 3.0] if k % 2 else [3.0, 1.0, 0.5], 0) for k in range(50)])
    assert X.near_vectors(spark.createDataFrame([], NAMES)).count() == 0
    assert X.near_vectors(spark.createDataFrame([(1, None, 0)], NAMES)).first()["kept"]


def test_rotation_keeps_lengths_and_angles():
    x = np.random.default_rng(0).normal(size=(5, 64))
    y = X.hadamard(x)
    assert np.allclose(x @ x.T, y @ y.T) and np.allclose(X.hadamard(y), x)
