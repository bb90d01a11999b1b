"""Near-duplicate documents by circulant MinHash.

Two permutations make the whole signature: the first (sigma) scatters the shingles over the 32-bit integers, the second
(pi) is applied to sigma shifted circularly by k to give coordinate k. Bands of coordinates put documents into buckets;
candidates are confirmed on their full shingle sets.

Documents with equal sets are one class from the start. Inside a bucket no pairs are listed. In rounds, a few members
are hubs; every other member that may still be linked to a hub, and isn't yet in its component, is compared with it, and
the hubs leave the bucket, settled against all. A bucket ends when its members are in one component. Exact bounds
spare comparisons: two sets have no more in common than the shingles of either that occur elsewhere at all (counted for
large buckets; it also covers unequal sizes), nor more than what falls into cells of a table that both fill, and two whose known distances to the bucket's first hub differ too much
can't reach the threshold (Jaccard distance is a metric). So no link between members of a bucket is lost, and
a bucket of n copies costs about n comparisons.

Two documents at 85 % share no band with probability 4e-7 (25 bands of 5), at 80 % 5e-5.

Defined results. Null or empty text, or no words: no shingles, linked with nothing, its own component. Fewer than five
words: the whole sequence is the one shingle. Repeated rows: each its result (an identifier is one document: its links
are those of all its texts). Null identifiers: link nothing, are kept; the component is that of an equal text that has
an identifier, if any. Extra columns are ignored. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import BASE, STEP_BYTES, Lookup, components, discard, materialise, mix64, odd_multipliers, shingle_sets, sieved, slices, spans_of, split_words, table, tidy

SHINGLE = 5
BANDS, ROWS = 25, 5
PERCENT = 85
#: Buckets of more members are searched for shingles that only one of them has.
LARGE = 32
#: 64-bit words of a set's bitmap.
CELLS = 16
_BLOCK = 1 << 15


def sets_of(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, one after another, and where each text's end."""
    words = split_words(texts)
    return shingle_sets(words.hashes, words.text_ends, size)


def _sigma(shingles: np.ndarray) -> np.ndarray:
    return (mix64(shingles ^ np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def _pi(x: np.ndarray) -> np.ndarray:
    """A bijection of the 32-bit integers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def signatures(shingles: np.ndarray, ends: np.ndarray, n: int = BANDS * ROWS) -> np.ndarray:
    """Coordinate k of a set is the least ``pi(sigma(x) + k)`` over its shingles x; all ones for an empty set."""
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
    out = np.full((len(ends), n), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(ends > starts)
    scattered = _sigma(shingles)
    # blocks of whole sets that fit the cache; a larger set is a block of its own
    a = 0
    while a < len(full):
        b = max(a + 1, int(np.searchsorted(ends[full], starts[full[a]] + _BLOCK, side="right")))
        rows = full[a:b]
        block = scattered[starts[rows[0]] : ends[rows[-1]]]
        cuts = starts[rows] - starts[rows[0]]
        for k in range(n):
            out[rows, k] = np.minimum.reduceat(_pi(block + np.uint32(k)), cuts)
        a = b
    return out


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    parts = signature.reshape(len(signature), bands, rows).astype(np.uint64)
    key = np.tile(mix64(np.arange(1, bands + 1, dtype=np.uint64)), (len(signature), 1))
    for k, m in enumerate(odd_multipliers(rows, 5)):
        key = mix64(key + parts[:, :, k] * m)
    return key.view(np.int64)


def digests(shingles: np.ndarray, ends: np.ndarray) -> list[bytes | None]:
    """128 bits of each set, whatever the order of its members (sums of two hashes of each); None for an empty one."""
    starts, n = spans_of(ends)
    full = np.flatnonzero(n)
    raw = np.zeros((len(ends), 2), np.uint64)
    for k, seed in enumerate((np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB))):
        if len(full):
            raw[full, k] = np.add.reduceat(mix64(shingles ^ seed), starts[full])
    held = raw.tobytes()
    return [held[16 * i : 16 * i + 16] if size else None for i, size in enumerate(n.tolist())]


def listed(keys: np.ndarray, has: np.ndarray) -> pa.ListArray:
    """Rows of ``keys`` as lists, for the rows that ``has`` tells; the others are empty."""
    ends = np.concatenate((np.zeros(1, np.int32), np.cumsum(has, dtype=np.int32))) * np.int32(keys.shape[1])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(keys.ravel()))


def sketch(docs: DataFrame, key: str, bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE) -> DataFrame:
    """``id``, ``n_shingles``, ``digest`` (128 bits of the set; null for none) and ``bands``: of equal sets in a slice of
    texts only the first has them, so a large group of copies is thinned out before it is shuffled."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", STEP_BYTES // 2):
            shingles, ends = sets_of(part.column("text"), size)
            n = spans_of(ends)[1]
            digest = digests(shingles, ends)
            fresh, seen = np.zeros(len(n), bool), {None}
            for i, x in enumerate(digest):
                if x not in seen:
                    seen.add(x)
                    fresh[i] = True
            keys = band_keys(signatures(shingles[np.repeat(fresh, n)], np.cumsum(n[fresh]), bands * rows), bands, rows)
            yield pa.RecordBatch.from_arrays([part.column("id").cast(pa.int64()), pa.array(n), pa.array(digest, pa.binary()), listed(keys, fresh)], ["id", "n_shingles", "digest", "bands"])

    return docs.select(F.col(key).cast("long").alias("id"), "text").mapInArrow(lambda batches: tidy(run(batches)), "id bigint, n_shingles bigint, digest binary, bands array<bigint>")


def compare(pairs: DataFrame, texts: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``a``, ``b``, ``common`` and ``total`` (sizes of the sets' intersection and union) of each pair of identifiers."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text_b", STEP_BYTES // 2):
            left = part.column("text_a").dictionary_encode()  # a hub's text stands in many rows
            hubs, hub_ends = sets_of(left.dictionary, size)
            which = left.indices.to_numpy(zero_copy_only=False)
            others, ends = sets_of(part.column("text_b"), size)
            hub_n, n = spans_of(hub_ends)[1], spans_of(ends)[1]
            # shingles told apart by their hub: all pairs in one look-up
            of_hub = lambda shingles, hub: mix64(shingles + hub.astype(np.uint64) * BASE)
            held = Lookup(np.sort(of_hub(hubs, np.repeat(np.arange(len(hub_n)), hub_n))))
            met = held.find(of_hub(others, np.repeat(which, n))) >= 0
            common = np.bincount(np.repeat(np.arange(len(n)), n)[met], minlength=len(n))
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(common), pa.array(hub_n[which] + n - common)], ["a", "b", "common", "total"])

    with_b = pairs.select("a", "b").hint("merge").join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.hint("merge").join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(lambda batches: tidy(run(batches)), "a bigint, b bigint, common bigint, total bigint")


def own_shingles(texts: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``id`` and ``alone``: how many of its shingles no other of these texts has. Each task adds up what it reads."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", STEP_BYTES // 2):
            shingles, ends = sets_of(part.column("text"), size)
            owner = np.repeat(part.column("id").to_numpy(), spans_of(ends)[1])
            unique, first, times = np.unique(shingles, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(unique.view(np.int64)), pa.array(times), pa.array(owner[first])], ["shingle", "c", "id"])

    rows = texts.select("id", "text").mapInArrow(lambda batches: tidy(run(batches)), "shingle bigint, c bigint, id bigint")
    once = rows.groupBy("shingle").agg(F.sum("c").alias("c"), F.min("id").alias("id")).where("c = 1")
    return once.groupBy("id").agg(F.count(F.lit(1)).alias("alone"))


def bitmaps(texts: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``id`` and ``bits``: the cells of a table of ``64 * CELLS`` that the text's shingles fall into."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", STEP_BYTES // 2):
            shingles, ends = sets_of(part.column("text"), size)
            owner = np.repeat(np.arange(len(ends)), spans_of(ends)[1])
            cell = (mix64(shingles ^ np.uint64(0xD6E8FEB86659FD93)) % np.uint64(64 * CELLS)).astype(np.int64)
            marks = np.zeros((len(ends), 64 * CELLS), np.uint8)
            marks[owner, cell] = 1
            bits = np.packbits(marks, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(pa.array(np.arange(len(ends) + 1, dtype=np.int32) * CELLS), pa.array(bits.ravel()))], ["id", "bits"])

    return texts.select("id", "text").mapInArrow(lambda batches: tidy(run(batches)), "id bigint, bits array<bigint>")


def most_in_common(n: Column, bits: Column, other_n: Column, other_bits: Column) -> Column:
    """An upper bound on two sets' intersection: shingles in cells that the other set leaves empty are not in it. Null
    without bitmaps."""
    outside = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y)))), F.lit(0), lambda s, x: s + x)
    return F.least(n - outside(bits, other_bits), other_n - outside(other_bits, bits))


def described(texts: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``id``, ``bits`` and ``alone`` of texts."""
    return bitmaps(texts, size).join(own_shingles(texts, size), "id", "left")


def shared_sizes(members: DataFrame, texts: DataFrame, size: int = SHINGLE, describe: Callable[[DataFrame, int], DataFrame] = described) -> DataFrame:
    """``members`` with ``m``: in buckets of more than ``LARGE`` members, how many of a set's shingles occur in another
    set of such buckets; else the set's size. No two sets have more than the smaller ``m`` in common. ``bits`` (large
    buckets only) bound what two sets share."""
    large = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > LARGE).select("bucket", F.lit(True).alias("large"))
    marked = materialise(members.select("bucket", "rep", "n").join(large, "bucket", "left"))
    of_large = marked.where("large").select(F.col("rep").alias("id")).distinct()
    held = materialise(texts.hint("merge").join(of_large, "id", "left_semi"))
    told = describe(held, size).withColumnRenamed("id", "rep")
    m = F.when(F.col("large"), F.col("n") - F.coalesce("alone", F.lit(0))).otherwise(F.col("n"))
    out = materialise(marked.join(told, "rep", "left").select("bucket", "rep", "n", m.alias("m"), F.when(F.col("large"), F.col("bits")).alias("bits")))
    discard(marked, held)
    return out


def settle(
    members: DataFrame, texts: DataFrame, links: DataFrame, percent: int = PERCENT, size: int = SHINGLE,
    describe: Callable[[DataFrame, int], DataFrame] = described, measure: Callable[[DataFrame, DataFrame, int], DataFrame] = compare,
) -> DataFrame:
    """``node``, ``component`` of all nodes that have a link: those of ``links`` (``a``, ``b``) and of the members
    (``bucket``, ``rep``, ``n``: set size) whose ``texts`` (``id``, ``text``) share ``percent`` of their shingles. Sets of
    another kind come with their own ``describe`` and ``measure``."""
    held = [shared_sizes(members, texts, size, describe)]
    members = held[0].withColumn("d", F.lit(None).cast("double"))
    parts, tested, turn, hubs_each = None, [], 0, 1
    while True:
        previous, parts = parts, components(links)
        discard(previous)
        placed = members.join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        # who shares too little with all, given the smallest set of the bucket, is alone there
        least = placed.groupBy("bucket").agg(F.min("n").alias("least"))
        placed = materialise(placed.join(least, "bucket").where(100 * F.col("m") >= percent * (F.col("n") + F.greatest("least", "m") - F.col("m"))).drop("least"))
        discard(*held)
        sizes = placed.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("c"))
        live = sizes.groupBy("bucket").agg(F.count(F.lit(1)).alias("k"), F.max_by("component", F.struct("c", "component")).alias("most")).where("k > 1").select("bucket", "most")
        # two sets that meet in several buckets are settled in the first of them
        now = placed.join(live, "bucket")
        everywhere = now.groupBy("rep").agg(F.collect_set("bucket").alias("_all"))  # as many as there are bands at most
        now = materialise(now.join(everywhere, "rep").withColumn("earlier", F.filter("_all", lambda x: x < F.col("bucket"))).drop("_all"))
        discard(placed)
        if now.isEmpty():
            discard(now, *tested)
            return parts
        # first the set that shares most; then smaller components first: a hub of theirs is compared with the rest, one of
        # the largest is nearly settled
        order = [F.col("component") == F.col("most"), F.xxhash64("rep", F.lit(turn)), "rep"] if turn else [F.desc("m"), "rep"]
        ranked = now.withColumn("at", F.row_number().over(Window.partitionBy("bucket").orderBy(*order))).where(F.col("at") <= hubs_each)
        hubs = materialise(ranked.select("bucket", F.col("rep").alias("hub"), F.col("n").alias("hub_n"), F.col("m").alias("hub_m"), F.col("d").alias("hub_d"), F.col("component").alias("hub_component"), F.col("earlier").alias("hub_earlier"), F.col("bits").alias("hub_bits")))
        gap, most = 1 - percent / 100 + 1e-9, F.least("m", "hub_m")
        able = (100 * most >= percent * (F.col("n") + F.col("hub_n") - most)) & F.coalesce(F.abs(F.col("d") - F.col("hub_d")) <= gap, F.lit(True))
        shared = most_in_common(F.col("n"), F.col("bits"), F.col("hub_n"), F.col("hub_bits"))
        likely = F.coalesce(100 * shared >= percent * (F.col("n") + F.col("hub_n") - shared), F.lit(True))
        # the dear bound last
        met = now.join(hubs, "bucket").where((F.col("component") != F.col("hub_component")) & (F.col("rep") != F.col("hub")) & able & ~F.arrays_overlap("earlier", "hub_earlier") & likely)
        pairs = met.select(F.col("hub").alias("a"), F.col("rep").alias("b")) if turn == 0 else met.select(F.least("hub", "rep").alias("a"), F.greatest("hub", "rep").alias("b"))
        pairs = pairs.distinct()
        for known in tested:
            pairs = pairs.join(known.select("a", "b"), ["a", "b"], "left_anti")
        found = materialise(measure(pairs, texts, size))
        tested.append(found)
        links = links.unionByName(found.where(100 * F.col("common") >= percent * F.col("total")).select("a", "b"))
        rest = now.select("bucket", "rep", "n", "m", "bits", "d")
        if turn == 0:  # distances to the first hub
            d = found.select(F.col("a").alias("hub"), F.col("b").alias("rep"), (1 - F.col("common") / F.col("total")).alias("d"))
            first = hubs.select("bucket", "hub")
            rest = rest.drop("d").join(first, "bucket").join(d, ["hub", "rep"], "left").select("bucket", "rep", "n", "m", "bits", "d")
        members, held = rest.join(hubs.select("bucket", F.col("hub").alias("rep")), ["bucket", "rep"], "left_anti"), [now, hubs]
        turn, hubs_each = turn + 1, hubs_each * 32


def in_shared_buckets(banded: DataFrame) -> DataFrame:
    """``bucket``, ``rep``, ``n`` of the buckets that several of ``banded`` (``rep``, ``n``, array ``bands``; a ``rep`` may
    come more than once) fall into."""
    rows = banded.select("rep", "n", F.explode("bands").alias("bucket"))
    several = rows.groupBy("bucket").agg(F.min("rep").alias("_lo"), F.max("rep").alias("_hi")).where("_lo <> _hi").select("bucket")
    return materialise(rows.join(several, "bucket", "left_semi").select("bucket", "rep", "n").distinct())


def texts_of(docs: DataFrame, ids: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """``id``, ``text`` of the documents ``ids``: one row for each text of an identifier. Only identifiers that ``known``
    has more than once with one set are looked at for repeats, so texts move once."""
    rows = docs.select(F.col(key).cast("long").alias("id"), "text")
    # merge joins wherever texts move: small and large inputs then move the same share of them
    texts = materialise(sieved(rows, F.col("id"), ids, "id")[0].hint("merge").join(ids, "id", "left_semi"))
    again = materialise(known.groupBy("id", "digest").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("id").distinct())
    if again.isEmpty():
        discard(again)
        return texts
    once = texts.join(again, "id", "left_anti").unionByName(texts.join(again, "id", "left_semi").distinct())
    out = materialise(once)
    discard(texts, again)
    return out


def near_duplicates(docs: DataFrame, key: str = "doc_id", percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE) -> DataFrame:
    """``key``, ``n_shingles``, ``component_id`` and ``kept`` for each row of ``docs``."""
    known = materialise(sketch(docs, key, bands, rows, size))
    full = known.where("digest is not null and id is not null")
    classes = materialise(full.groupBy("digest").agg(F.min("id").alias("rep")))
    # any row of a set has its bands; in the slice of texts the first row with the set, which may lack an identifier
    banded = known.where(F.size("bands") > 0).join(classes, "digest").select("rep", F.col("n_shingles").alias("n"), "bands")
    members = in_shared_buckets(banded)
    ids = materialise(members.select(F.col("rep").alias("id")).distinct())
    texts = texts_of(docs, ids, full, key)
    # an identifier with several texts joins their classes
    same = full.join(classes, "digest").groupBy("id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo <> hi").select(F.col("lo").alias("a"), F.col("hi").alias("b"))
    same = materialise(same)
    parts = settle(members, texts, same, percent, size)
    discard(members, texts, ids, same)
    final = classes.join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    out = known.join(final, "digest", "left").select(F.col("id").alias(key), "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op3_near_dedup": op3_near_dedup}
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: All pairs of documents that share a shingle: for small tables.
ORACLES: dict[str, str] = {
    "op3_near_dedup": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {SHINGLE} THEN list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY ALL
), c AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL
), e AS (
  SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= {PERCENT} * (a.n + b.n - c)
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.y FROM r JOIN e ON e.x = r.b
)
SELECT d.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id, d.doc_id = min(r.b) AS kept
FROM documents d JOIN r ON r.a = d.doc_id LEFT JOIN n USING (doc_id) GROUP BY d.doc_id
"""
}
