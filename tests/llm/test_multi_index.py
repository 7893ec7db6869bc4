import math

import numpy as np
from conftest import SMALL

from docquarry.llm import multi_index as m

SCHEMA = "vec_id long, embedding array<float>, score double, code long, part int"


def rows(spark, pairs):
    return spark.createDataFrame([(i, v, 0.0, 0, 0) for i, v in pairs], SCHEMA)


def brute(pairs, query, k):
    known = {i: np.array(v, float) for i, v in pairs}
    far = sorted((float(np.sqrt(((v - known[query]) ** 2).sum())), i) for i, v in known.items() if i != query)
    return [(n + 1, i, d) for n, (d, i) in enumerate(far[:k])]


def test_recall(spark):
    df = spark.read.parquet(f"{SMALL.replace('0.001', '0.1')}/embeddings.parquet")
    pairs = [(r.vec_id, r.embedding) for r in df.collect()]
    got = {}
    for r in m.nearest(df, df.filter("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, []).append(r)
    assert set(got) == {i for i, _ in pairs if i % 20 == 0}
    hits = [len({r.vec_id for r in got[q]} & {i for _, i, _ in brute(pairs, q, 10)}) for q in got]
    assert np.mean(hits) >= 9


def test_ties_copies_and_unfit_vectors(spark):
    pick = np.random.default_rng(3)
    pairs = [(i, [float(x) for x in np.float32(pick.normal(size=16))]) for i in range(60)]
    pairs += [(100 + i, pairs[0][1]) for i in range(30)]
    unfit = [(200, None), (201, [0.0] * 16), (202, [math.nan] + [1.0] * 15), (203, [math.inf] + [1.0] * 15), (204, [None] + [1.0] * 15), (205, [1.0]), (None, [1.0] * 16)]
    df = rows(spark, pairs + unfit + [pairs[5]])
    got = [(r["rank"], r.vec_id, r.score) for r in m.nearest(df, df.filter("vec_id = 0")).orderBy("rank").collect()]
    assert got == brute(pairs, 0, 10)
    assert {r.query_id for r in m.nearest(df, df.filter("vec_id >= 200 or vec_id is null")).collect()} == set()


def test_outliers_among_dense_clusters_get_k_rows(spark):
    pick = np.random.default_rng(5)
    centres = pick.normal(size=(20, 64))
    pairs = [(i, [float(x) for x in np.float32(centres[i % 20] + pick.normal(size=64) * 1e-3)]) for i in range(600)]
    pairs += [(1000 + i, [float(x) for x in np.float32(pick.normal(size=64) * 5)]) for i in range(12)]
    df = rows(spark, pairs)
    got = {}
    for r in m.nearest(df, df.filter("vec_id % 50 = 0 or vec_id >= 1000")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    asked = [i for i, _ in pairs if i % 50 == 0 or i >= 1000]
    assert {q: len(got.get(q, ())) for q in asked} == dict.fromkeys(asked, 10)
    exact = [q for q in asked if [g[1] for g in sorted(got[q])] == [b[1] for b in brute(pairs, q, 10)]]
    assert set(range(1000, 1012)) <= set(exact)


def test_few_or_no_rows(spark):
    pairs = [(i, [float(i + 1)] * 8) for i in range(4)]
    df = rows(spark, pairs)
    got = [(r["rank"], r.vec_id, r.score) for r in m.nearest(df, df.filter("vec_id = 1")).orderBy("rank").collect()]
    assert [g[:2] for g in got] == [b[:2] for b in brute(pairs, 1, 10)]
    none = df.limit(0)
    assert m.nearest(none, none).count() == 0
    assert m.nearest(df, none).count() == 0
