"""Exact search by inner product with queries and vectors both distributed.

Both sides go in tiles of bounded size: by the side of the mean in the coordinates of greatest variance, so that a tile's
vectors lie together, and tiles that are too large by hash of the key, so that no number of equal vectors fills one. A pair
of tiles is a matrix product of bounded size in one task. What a tile can reach at most follows from its centre and radius:
``q.v <= cq.c + |cq| r + rq |c| + rq r``. Queries are compared with the most promising tile first; pairs of tiles that
cannot reach any query's k-th score are left out. No vector comes to the driver.

Null vectors are left out, as query and as row. Ties in score (to nine digits) go by document.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tesserae.sources.scratch import written

#: Vectors and queries of a tile, about: the hash that deals them out is not exact.
TILE, ASKED = 1 << 14, 1 << 12
#: Results for each query.
CANDIDATES = 30
#: Scores that a task holds at once.
CELLS = 1 << 21
#: Tiles of vectors up to which bounds aren't worth their cost.
FEW = 4
#: Scores that differ by less are equal; bounds are given so much room.
DIGITS, ROOM = 9, 1e-6


def _axes(vectors: DataFrame, n: int) -> list[tuple[int, float]]:
    """The ``n`` coordinates of greatest variance and their means: as many rows as coordinates come to the driver."""
    if not n:
        return []
    told = vectors.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.var_pop("x").alias("s"), F.avg("x").alias("m"))
    return [(r["i"], r["m"]) for r in told.orderBy(F.desc("s"), "i").limit(n).collect()]


def _tiled(rows: DataFrame, key: str, axes: list[tuple[int, float]], n: int, size: int, tile: str) -> DataFrame:
    """``rows`` (with ``v``) and ``tile``. ``n``: how many rows there are."""
    bits = min(len(axes), max(0, math.ceil(math.log2(max(1, n) / size))))
    side = sum((F.when(F.get("v", F.lit(i)) > m, 1 << j).otherwise(0) for j, (i, m) in enumerate(axes[:bits])), F.lit(0))
    placed = rows.withColumn("_side", side)
    parts = placed.groupBy("_side").agg(F.ceil(F.count(F.lit(1)) / size).alias("_n"))
    return placed.join(parts, "_side").withColumn(tile, F.struct("_side", F.pmod(F.xxhash64(key), F.col("_n")).alias("part"))).drop("_side", "_n")


def _norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _balls(rows: DataFrame, tile: str, suffix: str) -> DataFrame:
    """``tile`` with its centre ``c``, radius ``r`` and number of rows ``n``."""
    means = rows.select(tile, F.posexplode("v").alias("i", "x")).groupBy(tile, "i").agg(F.avg("x").alias("m"))
    centres = means.groupBy(tile).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("c"))
    away = F.zip_with("v", "c", lambda x, y: x - y)
    around = rows.join(centres, tile).groupBy(tile).agg(F.max(_norm(away)).alias(f"r{suffix}"), F.count(F.lit(1)).alias(f"n{suffix}"))
    return centres.join(around, tile).withColumnRenamed("c", f"c{suffix}")


def best_of_rows(exact: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the best ``k`` scores in each row; of equal scores the first columns. Partial selection."""
    n = min(k, exact.shape[1])
    s = np.round(exact, DIGITS)
    least = np.partition(s, s.shape[1] - n, axis=1)[:, s.shape[1] - n : s.shape[1] - n + 1]
    above, at = s > least, s == least
    at &= np.cumsum(at, axis=1, dtype=np.int32) <= n - above.sum(axis=1, keepdims=True)
    return np.nonzero(above | at)


def best_of_tiles(q: np.ndarray, v: np.ndarray, k: int, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``q``, rows of ``v`` and scores of the best ``k`` for each query; of equal scores the first rows of ``v``.
    As many queries at once as ``cells`` allows."""
    found = []
    each = max(1, cells // max(1, len(v)))
    for a in range(0, len(q), each):
        exact = q[a : a + each] @ v.T
        of, row = best_of_rows(exact, k)
        found.append((of + a, row, exact[of, row]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _scorer(k: int, names: pa.DataType, docs: pa.DataType) -> Callable[[pa.Table], pa.Table]:
    def matrix(part: pa.Table) -> np.ndarray:
        flat = part.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        return flat.reshape(part.num_rows, -1)

    def score(part: pa.Table) -> pa.Table:
        asks = part.filter(part.column("asks"))
        rows = part.filter(pc.invert(part.column("asks")))
        rows = rows.take(pc.sort_indices(rows.column("doc")))
        of, at, s = best_of_tiles(matrix(asks), matrix(rows), k) if asks.num_rows and rows.num_rows else ([], [], [])
        return pa.table({"query_id": asks.column("query_id").take(pa.array(of, pa.int64())).cast(names), "doc": rows.column("doc").take(pa.array(at, pa.int64())).cast(docs), "score": pa.array(s, pa.float64())})

    return score


def _scored(asked: DataFrame, held: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """``query_id``, ``doc``, ``score`` of the best ``k`` of each query in each of its pairs of tiles."""
    id_type, doc_type = asked.schema["query_id"].dataType, held.schema["doc"].dataType
    left = asked.join(pairs, "qt").select("qt", "vt", F.lit(True).alias("asks"), "query_id", F.lit(None).cast(doc_type).alias("doc"), "v")
    right = held.join(pairs, "vt").select("qt", "vt", F.lit(False).alias("asks"), F.lit(None).cast(id_type).alias("query_id"), "doc", "v")
    kinds = f"query_id {id_type.simpleString()}, doc {doc_type.simpleString()}, score double"
    return left.unionByName(right).groupBy("qt", "vt").applyInArrow(_scorer(k, to_arrow_type(id_type), to_arrow_type(doc_type)), kinds)


def promising(asked: DataFrame, held: DataFrame, k: int) -> DataFrame:
    """The pairs of tiles (``qt``, ``vt``) that may hold one of a query's best ``k``."""
    balls_q, balls_v = _balls(asked, "qt", "q"), _balls(held, "vt", "v")
    # tiles are thousands of rows each; their pairs are the query set against all rows, in blocks
    grid = balls_q.join(balls_v, F.lit(True)).withColumn("near", _dot(F.col("cq"), F.col("cv")))
    reach = F.col("near") + _norm(F.col("cq")) * F.col("rv") + F.col("rq") * _norm(F.col("cv")) + F.col("rq") * F.col("rv")
    grid = written(grid.select("qt", "vt", "near", reach.alias("reach"), "nv"))
    first = grid.where(F.col("nv") >= k).groupBy("qt").agg(F.max_by("vt", "near").alias("vt"))
    sure = _scored(asked, held, first, k).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
    least = asked.select("qt", "query_id").join(sure, "query_id", "left").groupBy("qt").agg(F.min(F.coalesce("least", F.lit(float("-inf")))).alias("least"))
    return grid.join(least, "qt").where(F.col("reach") >= F.col("least") - ROOM * (1 + F.abs("least"))).select("qt", "vt")


def dense(queries: DataFrame, vectors: DataFrame, k: int = CANDIDATES, key: str = "vec_id", query_key: str = "query_id", vector: str = "embedding", tile: int = TILE, asked_tile: int = ASKED) -> DataFrame:
    """``query_id``, ``doc``, ``score``, ``rank``: the best ``k`` by exact inner product in double precision.
    Identifiers are unique on either side."""
    one = lambda df, name, out: df.where(F.col(vector).isNotNull()).select(F.col(name).alias(out), F.col(vector).alias("v"))
    asked, held = one(queries, query_key, "query_id"), one(vectors, key, "doc")
    n_asked, n_held = asked.count(), held.count()
    axes = _axes(held, max(0, math.ceil(math.log2(max(1, n_held, n_asked) / min(tile, asked_tile)))))
    asked, held = _tiled(asked, "query_id", axes, n_asked, asked_tile, "qt"), _tiled(held, "doc", axes, n_held, tile, "vt")
    if n_held <= FEW * tile:
        pairs = asked.select("qt").distinct().join(held.select("vt").distinct(), F.lit(True))
    else:
        pairs = written(promising(asked, held, k))
    best = Window.partitionBy("query_id").orderBy(F.round("score", DIGITS).desc(), "doc")
    return _scored(asked, held, pairs, k).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
