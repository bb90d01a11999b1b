"""Distributed exact vector search against one matrix product, and what it holds in memory."""

import tracemalloc

import numpy as np
import pytest

from tesserae.operators import dense

SCHEMA = "id long, v array<float>"


def frame(spark, m, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in row]) for i, row in enumerate(m)], SCHEMA)


def brute(q, v, k):
    s = np.round(q.astype(np.float64) @ v.astype(np.float64).T, 9)
    out = set()
    for i, row in enumerate(s):
        out |= {(i, int(j), r + 1) for r, j in enumerate(np.lexsort((np.arange(len(row)), -row))[:k])}
    return out


def clusters(seed, n, centres=12, dim=8):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dim)) * 6
    return (middle[rng.integers(centres, size=n)] + rng.normal(size=(n, dim))).astype(np.float32)


@pytest.mark.parametrize(("tile", "asked"), [(1 << 14, 1 << 12), (100, 16), (30, 7)])
def test_equal_to_one_product(spark, tile, asked):
    v, q = clusters(1, 900), clusters(2, 60)
    v[300:600] = v[0]  # a third of all vectors is one
    got = dense.dense(frame(spark, q), frame(spark, v), 10, "id", "id", "v", tile, asked).collect()
    assert {(r.query_id, r.doc, r["rank"]) for r in got} == brute(q, v, 10)


def test_tiles_out_of_reach_are_left_out(spark):
    v, q = clusters(3, 1200), clusters(3, 1200)[:40]
    axes = dense._axes(frame(spark, v).withColumnRenamed("id", "doc"), 5)
    held = dense._tiled(frame(spark, v).withColumnRenamed("id", "doc"), "doc", axes, len(v), 60, "vt").cache()
    asked = dense._tiled(frame(spark, q).withColumnRenamed("id", "query_id"), "query_id", axes, len(q), 4, "qt").cache()
    tiles = held.select("vt").distinct().count() * asked.select("qt").distinct().count()
    assert dense.promising(asked, held, 5).count() < 0.6 * tiles
    assert max(r["count"] for r in held.groupBy("vt").count().collect()) < 3 * 60


def test_no_rows_on_either_side(spark):
    v, none = frame(spark, clusters(4, 20)), spark.createDataFrame([], SCHEMA)
    for q, r in ((none, v), (v, none), (none, none), (v, spark.createDataFrame([(1, None)], SCHEMA))):
        assert dense.dense(q, r, 3, "id", "id", "v").count() == 0
    assert dense.dense(v, frame(spark, clusters(5, 2)), 3, "id", "id", "v").count() == 40


def test_memory_of_a_pair_of_tiles_is_bounded():
    """5,000 queries on 16,384 vectors: all scores would take 655 MB."""
    rng = np.random.default_rng(6)
    q, v = rng.normal(size=(5000, 64)), rng.normal(size=(1 << 14, 64))
    tracemalloc.start()
    of, _, _ = dense.best_of_tiles(q, v, 30)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(of) == 5000 * 30 and peak < 150e6


def test_ties_go_by_row():
    q, v = np.ones((3, 2)), np.array([[1.0, 1], [0, 0], [1, 1], [1, 1], [2, 2]])
    of, at, _ = dense.best_of_tiles(q, v, 3, cells=5)
    assert sorted(zip(of.tolist(), at.tolist(), strict=True)) == [(i, j) for i in range(3) for j in (0, 2, 4)]


def test_nothing_of_the_tables_comes_to_the_driver():
    import inspect

    source = inspect.getsource(dense.dense) + inspect.getsource(dense._scored) + inspect.getsource(dense.promising)
    assert not any(x in source for x in ("collect()", "toLocalIterator", "toPandas", "broadcast"))
