import numpy as np
from quillstream.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int"


def exact(ids, x, every=20, k=20):
    x, out = x.astype(np.float64), {}
    for q in np.flatnonzero(ids % every == 0):
        s = x @ x[q]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[j]), s[j]) for j in order]
    return out


def read(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for rows in out.values():
        assert [r for r, _, _ in rows] == list(range(1, len(rows) + 1))
        assert all(a[2] > b[2] or (a[2] == b[2] and a[1] < b[1]) for a, b in zip(rows, rows[1:]))
    return out


def recall(got, want):
    hits = sum(len({v for _, v, _ in got.get(q, [])} & {v for v, _ in w}) for q, w in want.items())
    return hits / sum(map(len, want.values()))


def test_query_recall(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, x = np.asarray([r.vec_id for r in rows]), np.asarray([r.embedding for r in rows], np.float32)
    got = read(neighbours.op4_nearest(spark, sf))
    want = exact(ids, x)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert recall(got, want) >= 0.9
    by = dict(zip(ids.tolist(), x.astype(np.float64)))
    assert all(abs(s - by[q] @ by[v]) < 1e-12 for q, hits in got.items() for _, v, s in hits)


def test_full_search_is_exact_with_ties_and_repeats(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(-2, 3, (700, 6)).astype(np.float32)
    x[:240] = x[0]
    x[(x == 0).all(1)] = 1
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    got = read(neighbours.search(spark.createDataFrame(rows + rows[:50], SCHEMA), share=1.0, block=64, sample=500))
    want = exact(np.arange(700), x)
    assert {q: [(v, s) for _, v, s in h] for q, h in got.items()} == want


def test_defined_cases(spark):
    bad = [(0, None, 1), (20, [0.0, 0.0], 1), (40, [1.0, None], 1), (60, [float("nan"), 1.0], 1), (80, [float("inf"), 1.0], 1), (None, [1.0, 2.0], 1), (100, [1.0], 1)]
    good = [(120, [1.0, 2.0], 1), (121, [0.5, 0.5], 1), (122, [0.5, 0.5], 1)]
    got = read(neighbours.search(spark.createDataFrame(bad + good, SCHEMA)))
    assert got == {120: [(1, 121, 1.5), (2, 122, 1.5)]}
    assert neighbours.search(spark.createDataFrame(bad, SCHEMA)).count() == 0
    assert neighbours.search(spark.createDataFrame([], SCHEMA)).count() == 0


def test_columns_of_any_name_and_a_given_share(spark):
    rows = [(i, [float(i % 7) - 3, 1.0 + i], "x", "y") for i in range(60)]
    got = read(neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>, c string, q string"), share=1.0))
    assert got.keys() == {0, 20, 40} and all(len(v) == 20 for v in got.values())


def test_recall_and_share_on_ten_thousand_vectors(spark):
    rng = np.random.default_rng(2)
    for clusters, most in ((0, 0.6), (50, 0.25)):
        x = rng.normal(size=(10_000, 64))
        if clusters:
            x = 0.35 * x + rng.normal(size=(clusters, 64))[rng.integers(clusters, size=10_000)]
        x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
        index = neighbours.Index(neighbours.kmeans(x[:, :32].astype(float), 64), neighbours.kmeans(x[:, 32:].astype(float), 64, seed=5))
        assert index.share(x.astype(float), 20, 0.95) <= most
        d = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA).where("vec_id % 20 <> 0 or vec_id % 100 = 0")
        ids = np.asarray([i for i in range(10_000) if i % 20 or i % 100 == 0])
        assert recall(read(neighbours.search(d)), exact(ids, x[ids])) >= 0.9


def test_buckets_hold_about_a_block():
    count = np.asarray([[3, 4], [10, 15], [1, 1], [0, 0], [2, 2]])
    assert neighbours.buckets(count, 10) == ([0, 1, 4, 4, 4], [1, 3, 1, 1, 1])
