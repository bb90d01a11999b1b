"""Helpers that several operators of this subpackage use: tables, shared folders, vectorised words, components."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step holds at most (a single longer text is a step of its own).
STEP_BYTES = 8 << 20
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches by bytes too, unless the session says otherwise: rows of long texts would fill memory by number."""
    if spark.conf.get(ARROW_BYTES, None) is None:
        spark.conf.set(ARROW_BYTES, str(2 * STEP_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; Spark alone touches the path, so any store that Spark can read will do."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- shared folders


def shared_dir(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see, under ``spark.checkpoint.dir``.

    Where the setting is absent (tests) and the master is local, a temporary folder serves; on a cluster its absence is
    an error, since executors could not see each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tesserae-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tesserae-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Writes ``df`` as Parquet to a shared folder and reads it back: the lineage ends there, and losing an executor
    later costs no recomputation. ``discard`` removes it once nothing reads it any more."""
    spark = df.sparkSession
    bound_batches(spark)
    path = shared_dir(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tesserae_path = path
    return out


def discard(*frames: DataFrame | None) -> None:
    """Deletes what ``materialise`` wrote for these frames."""
    for df in frames:
        path = getattr(df, "_tesserae_path", None)
        if path:
            jvm = df.sparkSession._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def release(df: DataFrame) -> None:
    """Lets executors delete the shuffle files of jobs that nothing refers to any more; else they lie there until the
    driver's JVM happens to collect its garbage."""
    gc.collect()
    df.sparkSession._jvm.System.gc()


def tidy(batches: Iterator[pa.RecordBatch], *leave: Callable[[], None]) -> Iterator[pa.RecordBatch]:
    """Passes batches on; after the last one it calls ``leave`` and gives freed memory back to the system. Python workers
    live on between tasks, and what one of them keeps is missing to the next query."""
    yield from batches
    for done in leave:
        done()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


# ---------------------------------------------------------------- names and sparse joins


def free_name(taken: Iterable[str], stem: str) -> str:
    """A column name that none of ``taken`` equals (case aside)."""
    held = {x.lower() for x in taken}
    while stem.lower() in held:
        stem = f"_{stem}"
    return stem


#: Bits of the table that ``marked`` broadcasts: 262,144 rows of two longs at most, whatever the input.
SIEVE = 1 << 24


def marked(rows: DataFrame, key: Column, keys: DataFrame, column: str, name: str) -> DataFrame:
    """``rows`` with the boolean ``name``: whether ``key`` may be among ``keys[column]``; false is certain.

    Keys set bits of a table of fixed size by their hash. With many more keys than bits nearly all rows are marked. Null
    keys are not among any.
    """
    word, mask, own = (free_name((*rows.columns, name), x) for x in ("_word", "_mask", "slot"))
    slot = F.pmod(F.xxhash64(F.col(column)), F.lit(SIEVE)).alias("slot")
    bit = "shiftleft(1L, cast(slot % 64 as int))"
    table_ = keys.where(F.col(column).isNotNull()).select(slot).select(F.shiftright("slot", 6).alias(word), F.expr(bit).alias("bit")).groupBy(word).agg(F.bit_or("bit").alias(mask))
    placed = rows.withColumn(own, F.pmod(F.xxhash64(key), F.lit(SIEVE))).withColumn(word, F.shiftright(own, 6)).withColumn(name, key.isNotNull())
    maybe = F.coalesce(F.col(mask).bitwiseAND(F.expr(bit.replace("slot", f"`{own}`"))) != 0, F.lit(False)) & F.col(name)
    return placed.join(F.broadcast(table_), word, "left").select(*(F.col(f"`{c}`") for c in rows.columns), maybe.alias(name))


def sieved(rows: DataFrame, key: Column, keys: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` in two parts: those whose ``key`` may be among ``keys[column]``, and those whose ``key`` surely isn't.

    A join of large rows with few keys need only move the first part. With many more keys than bits it nears all rows, which
    then move as without the sieve. Null keys are in the second part.
    """
    name = free_name(rows.columns, "_maybe")
    met = marked(rows, key, keys, column, name)
    return met.where(F.col(name)).drop(name), met.where(~F.col(name)).drop(name)


# ---------------------------------------------------------------- Arrow batches


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that each holds at most ``limit`` bytes of ``column`` (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = (np.cumsum(sizes, dtype=np.int64) - 1) // limit
        starts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:], strict=False):
            yield batch.slice(a, b - a)


def word_arrays(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text (null: none), A-Z lower-cased if asked.

    Returns ``codes`` (int32 index of every word into ``vocabulary``, all texts one after another), ``vocabulary`` (an
    Arrow string array of the distinct words) and ``ends`` (int64, where each text's words end in ``codes``).
    """
    texts = texts.take(pa.array(np.arange(len(texts))))  # the kernels below misread arrays that are slices of others
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat, parents = split.flatten(), pc.list_parent_indices(split)
    keep = pc.greater(pc.binary_length(flat), 0)
    coded = flat.filter(keep).dictionary_encode()
    parents = parents.filter(keep).to_numpy(zero_copy_only=False)
    ends = np.cumsum(np.bincount(parents, minlength=len(texts)), dtype=np.int64) if len(texts) else np.zeros(0, np.int64)
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary, ends


def hash_strings(values: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each string's UTF-8 bytes."""
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(x, seed) for x in values.cast(pa.large_binary()).to_pylist()), np.uint64, len(values))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit over the whole word."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def odd_multipliers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Words(NamedTuple):
    """The words ``[^\\x20\\x09-\\x0D]+`` of some texts, one text after another."""

    data: np.ndarray  # UTF-8 of all texts, with a line end after each
    bounds: np.ndarray  # where each text begins in it; text i is data[bounds[i] : bounds[i + 1] - 1]
    starts: np.ndarray  # of each word in the data
    ends: np.ndarray
    hashes: np.ndarray  # of each word, A-Z lower-cased: 64 bits
    text_ends: np.ndarray  # where each text's words end


BASE = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
#: Bytes whose words are hashed at once.
_BLOCK = 1 << 17


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of ``BASE`` and of its inverse."""
    return tuple(np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(max(n - 1, 0), x, np.uint64)))) for x in (BASE, BACK))


_POWERS = powers(_BLOCK)
_BYTE = np.random.default_rng(17).integers(0, 2**64, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]


def _hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomials over the bytes of each word, by running sums: no word is looked at by itself."""
    out, a = np.empty(len(starts), np.uint64), 0
    while a < len(starts):
        lo = int(starts[a])
        b = max(a + 1, int(np.searchsorted(ends, lo + _BLOCK, "right")))
        size = int(ends[b - 1]) - lo
        up, down = _POWERS if size <= _BLOCK else powers(size)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(_BYTE[data[lo : lo + size]] * up[:size], out=sums[1:])
        out[a:b] = (sums[ends[a:b] - lo] - sums[starts[a:b] - lo]) * down[starts[a:b] - lo]
        a = b
    return mix64(out + (ends - starts).astype(np.uint64) * BASE)


def split_words(texts: pa.Array) -> Words:
    """Nulls are empty texts."""
    kind = pa.large_string()
    whole = pc.binary_join_element_wise(pc.fill_null(texts.cast(kind), ""), pa.scalar("", kind), pa.scalar("\n", kind))
    n = len(whole)
    if not n:
        return Words(np.zeros(0, np.uint8), np.zeros(1, np.int64), *(np.zeros(0, np.int64) for _ in range(2)), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    bounds = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + n + 1]
    data = np.frombuffer(whole.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    inside = np.zeros(len(data) + 1, bool)
    inside[1:] = (data != 32) & ((data < 9) | (data > 13))
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = turns[::2], turns[1::2]
    return Words(data, bounds, starts, ends, _hash_words(data, starts, ends), np.searchsorted(starts, bounds[1:]))


def spans_of(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of spans that follow each other."""
    starts = np.concatenate((np.zeros(1, np.int64), ends[:-1])) if len(ends) else np.zeros(0, np.int64)
    return starts, ends - starts


def shingle_sets(words: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ``size``-word shingles of each text as 64-bit hashes, one text after another, and their ends.

    ``words`` are 64-bit word hashes. A text of fewer words has one shingle, its whole sequence; one without words has
    none. Two different shingles share a hash with probability about 2**-64.
    """
    starts, counts = spans_of(ends)
    multipliers, n = odd_multipliers(size, 11), len(words)
    acc = np.zeros(max(n, 1), np.uint64)
    for k in range(size):
        if n - k > 0:
            acc[: n - k] += words[k:] * multipliers[k]
    total = np.where(counts >= size, counts - size + 1, counts > 0)
    owner = np.repeat(np.arange(len(ends)), total)
    last = np.cumsum(total)
    within = np.arange(len(owner), dtype=np.int64) - np.repeat(last - total, total)
    hashes = mix64(acc[np.repeat(starts, total) + within])
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        whole = counts[short].astype(np.uint64) * BASE
        for k in range(size - 1):
            there = k < counts[short]
            whole[there] += words[starts[short][there] + k] * multipliers[k]
        hashes[last[short] - 1] = mix64(whole)
    # a shingle that its text has twice: one sort over all texts
    key = mix64(hashes + owner.astype(np.uint64) * BASE)
    order = np.argsort(key)
    key = key[order]
    keep = np.ones(len(hashes), bool)
    keep[order[1:][key[1:] == key[:-1]]] = False
    return hashes[keep], np.cumsum(np.bincount(owner[keep], minlength=len(ends)), dtype=np.int64)


class Lookup:
    """Places in a sorted array of distinct 64-bit hashes: their first bits lead to the few that share them."""

    def __init__(self, keys: np.ndarray):
        self.keys, bits = keys, len(keys).bit_length() + 1
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(keys, np.arange(2**bits, dtype=np.uint64) << self.shift).astype(np.int32)
        self.deepest = int(np.diff(np.append(self.first, len(keys))).max()) if len(keys) else 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """-1 for what isn't there."""
        out = np.full(len(hashes), -1, np.int64)
        first = self.first[hashes >> self.shift]
        for step in range(self.deepest):
            at = np.minimum(first + step, len(self.keys) - 1)
            hit = self.keys[at] == hashes
            out[hit] = at[hit]
        return out


# ---------------------------------------------------------------- connected components


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node``, ``component`` (the smallest node id reachable) for every node of an undirected edge table of longs.

    Each round points every node at its smallest neighbour, follows the pointers once more, and contracts the edges to
    what still differs, so long chains shrink geometrically. Neighbours are reduced by map-side ``min`` and looked up by
    joins, which adaptive execution can split; nothing is collected, and what a round leaves is written to the shared
    folder. The rounds' pointers are followed one after the other at the end. ``edges`` is read twice.
    """
    left = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null")
    live = materialise(left.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    jumps = []
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        point = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("p"))
        up = point.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        jump = materialise(point.join(up, "p", "left").select("u", F.coalesce("pp", "p").alias("root")))
        root_u = jump.select("u", F.col("root").alias("ru"))
        root_v = jump.select(F.col("u").alias("v"), F.col("root").alias("rv"))
        rest = live.join(root_u, "u").join(root_v, "v").where("ru <> rv").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct()
        old, live = live, materialise(rest)
        discard(old)
        jumps.append(jump)
    nodes = left.select(F.col("u").alias("node")).union(left.select("v")).distinct().withColumn("component", F.col("node"))
    for jump in jumps:
        nodes = nodes.join(jump, nodes["component"] == jump["u"], "left").select("node", F.coalesce("root", "component").alias("component"))
    out = materialise(nodes)
    discard(live, *jumps)
    return out
