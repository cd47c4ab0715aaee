"""Learned partitions: recall and scores against brute force, and the cases with few or odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import neighbours as N

SCHEMA = "vec_id long, embedding array<float>, part string, score int"


def frame(spark, ids, vectors):
    return spark.createDataFrame([(int(i) if i is not None else None, v if v is None else [None if x is None else float(x) for x in v], "p", 0) for i, v in zip(ids, vectors)], SCHEMA)


def brute(ids, v, q, k=10):
    d = np.sqrt(((v - v[q]) ** 2).sum(1))
    out = [x for x in np.lexsort((ids, d)) if ids[x] != ids[q]][:k]
    return [(int(ids[x]), float(d[x])) for x in out]


def test_recall_and_scores(spark, sf_dir):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((40, 16)) * 3
    v = (centres[rng.integers(0, 40, 6000)] + rng.standard_normal((6000, 16))).astype(np.float32)
    v[1500:3500] = v[1500]  # a third of all rows are one vector
    ids = np.arange(6000)
    got = N.search(frame(spark, ids, v), F.col("vec_id") % 100 == 0).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(by) == list(range(0, 6000, 100))
    x, hit = v.astype(float), 0
    for q, rows in by.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 11)) and rows == sorted(rows, key=lambda r: (r[2], r[1]))
        assert all(s == pytest.approx(np.sqrt(((x[i] - x[q]) ** 2).sum()), abs=1e-12) for _, i, s in rows)
        hit += len({i for i, _ in brute(ids, x, q)} & {r[1] for r in rows})
    assert hit >= 0.9 * 10 * len(by)
    assert [r[1] for r in sorted(by[1600])] == [*range(1500, 1510)]


def test_recall_on_given_vectors(spark, sf_dir):
    table = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.1") + "/embeddings.parquet")
    rows = table.orderBy("vec_id").toPandas()
    v, ids = np.array(rows.embedding.tolist(), float), rows.vec_id.to_numpy()
    got = N.search(table, F.col("vec_id") % 100 == 0).toPandas()
    want = {int(q): {i for i, _ in brute(ids, v, q)} for q in np.flatnonzero(ids % 100 == 0)}
    assert np.mean([len(want[q] & set(got.vec_id[got.query_id == q])) for q in want]) >= 9


def test_fewer_probes_on_clusters():
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.standard_normal((200, 8)) + 30 * rng.standard_normal(8) for _ in range(16)])
    edges = np.array([(i, j) for i, at, _ in N.nearest(v, v, 10, own=np.arange(len(v))) for j in at])
    index = N.Index(v, edges[:, 0], edges[:, 1])
    assert index.parts >= 16 and index.probes <= 4 and index.recall >= N.TARGET


def test_parts_are_balanced():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 1000, 5000), rng.integers(0, 1000, 5000)
    sizes = np.bincount(N.balanced_parts(a, b, 1000, 7), minlength=7)
    assert sizes.sum() == 1000 and sizes.max() - sizes.min() <= 3


def test_odd_vectors(spark):
    vectors = [[1, 0], [0, 0], None, [], [float("nan"), 1], [float("inf"), 1], [None, 1], [1, 2, 3], [1, 1], [1, 1], [3, 4], [2, 2]]
    ids = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, None, 8]
    got = N.search(frame(spark, ids, vectors), F.lit(True)).collect()
    by = {q: [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in {r.query_id for r in got}}
    assert by == {0: [(8, 1.0), (9, 1.0), (8, pytest.approx(5**0.5))], 8: [(9, 0.0), (0, 1.0)], 9: [(8, 0.0), (0, 1.0), (8, pytest.approx(2**0.5))]}


def test_empty_table_and_lone_vector(spark):
    empty = N.search(frame(spark, [], []), F.col("vec_id") % 100 == 0)
    assert empty.collect() == [] and empty.columns == ["query_id", "rank", "vec_id", "score"]
    assert N.search(frame(spark, [0], [[1, 2]]), F.lit(True)).collect() == []
