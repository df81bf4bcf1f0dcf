
import numpy as np

from ocellus.llm.neighbours import Side, join_sides, products, similar_pairs, similar_papers

SCHEMA = "paper_id bigint, provider string, model string, dimensions int, text_hash string, embedding_blob binary, updated_at timestamp_ntz, similarity string"


def frame(spark, vectors, ids=None, d=None):
    rows = [(i, "api", "m", d or len(v), "", None if v is None else np.asarray(v, "<f4").tobytes(), None, "") for i, v in zip(ids or range(len(vectors)), vectors)]
    return spark.createDataFrame(rows, SCHEMA)


def brute(vectors, k, least, ids):
    v = np.asarray(vectors, np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    c = v @ v.T
    out = {}
    for a in range(len(v)):
        order = sorted((j for j in range(len(v)) if j != a and c[a, j] >= least - 1e-12), key=lambda j: (-round(c[a, j], 10), ids[j]))
        out[ids[a]] = [ids[j] for j in order[:k]]
    return out


def clustered(n, d, seed=0):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(max(n // 6, 1), d))
    return (centres[r.integers(0, len(centres), n)] + 0.2 * r.normal(size=(n, d))).astype("<f4")


def lists(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.paper_id, r["rank"])):
        out.setdefault(r.paper_id, []).append(r.neighbour_id)
    return out


def test_all_neighbours_are_exact(spark):
    v, ids = clustered(400, 16), list(range(1000, 1400))
    for group in (64, 5000):
        got = lists(similar_papers(frame(spark, v, ids), model="m", k=5, group=group))
        assert got == brute(v, 5, -1, ids)


def test_threshold(spark):
    v, ids = clustered(300, 32, 3), list(range(300))
    want = {(min(a, b), max(a, b)) for a, bs in brute(v, 10, 0.9, ids).items() for b in bs}
    got = {(r.paper_id_a, r.paper_id_b) for r in similar_pairs(frame(spark, v, ids), 0.9, model="m").collect()}
    assert got == want and want


def test_dense_clouds_keep_the_best():
    r = np.random.default_rng(4)
    v = (1 + 0.01 * r.normal(size=(700, 24))).astype("<f4")
    ids = np.arange(700)
    side = Side(ids, v, 0.5)
    (a, b, _), *_ = join_sides(side, side, 3, True)
    got = {}
    for x, y in zip(a, b):
        got.setdefault(x, set()).add(y)
    want = brute(v, 3, 0.5, ids.tolist())
    recall = np.mean([len(got[i] & set(want[i])) / 3 for i in want])
    assert recall > 0.999


def test_copies_share_their_neighbours(spark):
    base = clustered(20, 8, 5)
    v, ids = [*base, *[base[0]] * 40], list(range(60))
    got = lists(similar_papers(frame(spark, v, ids), model="m", k=4))
    assert got[0] == [20, 21, 22, 23] and got[20] == [0, 21, 22, 23] and got[59] == [0, 20, 21, 22]
    assert got == brute(v, 4, -1, ids)


def test_unusable_vectors(spark):
    good = [[1.0, 0.0], [1.0, 0.1], [1e-30, 1e-31], [3e38, 3e37]]
    bad = [None, [], [1.0], [1.0, 2.0, 3.0], [0.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0]]
    df = frame(spark, good, [1, 2, 3, 4], 2).unionByName(frame(spark, bad, list(range(10, 17)), 2))
    got = lists(similar_papers(df, model="m", k=10))
    assert set(got) == {1, 2, 3, 4} and all(len(x) == 3 for x in got.values())


def test_last_update_counts_and_empty(spark):
    a, b = np.array([1, 0], "<f4").tobytes(), np.array([0, 1], "<f4").tobytes()
    from datetime import datetime

    rows = [(1, "api", "m", 2, "", a, None, ""), (1, "api", "m", 2, "", b, datetime(2024, 1, 1), ""), (2, "api", "m", 2, "", b, None, ""), (3, "local", "m", 2, "", b, None, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [(r.paper_id_a, r.paper_id_b) for r in similar_pairs(df, 0.9, model="m").collect()] == [(1, 2)]
    assert similar_papers(df.limit(0), model="m").collect() == []


def test_products_of_codes_are_exact_integers():
    r = np.random.default_rng(1)
    for d in (1, 128, 1024, 1025, 5000):
        a, b = (r.integers(-127, 128, (9, d)).astype(np.int8) for _ in range(2))
        a[0], b[0] = 127, 127
        assert (products(a, b) == a.astype(np.int64) @ b.astype(np.int64).T).all()


def test_long_vectors_lose_nothing(spark):
    v, ids = clustered(120, 2500, 8), list(range(120))
    assert lists(similar_papers(frame(spark, v, ids), model="m", k=4, group=50)) == brute(v, 4, -1, ids)
