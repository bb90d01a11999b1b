"""Substring dedup by paragraph MinHash banding.

Paragraphs are the lines of a text. The bands of a MinHash signature, tuned for high recall at the threshold, bring near
paragraphs together; exact Jaccard verifies them, and components of the confirmed links are the clusters (equal
paragraphs are one class from the start).

Passages that don't keep to lines are found by anchors: runs of ``ANCHOR`` words, chosen by their hash so that one begins
among any ``SPREAD`` words in a row that begin one. So whatever ``ANCHOR + SPREAD - 1`` = 50 words several documents
share, one of their anchors is in it. Anchors at the ends of a run are compared with the keeper's text beyond them and
grow by all words that are the same (as far as ``REACH`` code points).

Of each cluster the document with the smallest identifier keeps its paragraphs; in other documents they are repeats.
Repeats that follow each other make a run; a run of at least ``MIN_WORDS`` words is removed. So a common short line in
otherwise unlike documents stays where it is. Shared passages inside a line of less than 50 words may stay too.

Defined results. Null or empty text: nothing to remove. Repeats within one document stay. Rows of one identifier
count as one document: what they share stays, and each loses what its own text repeats of others. Null identifiers: never removed, never kept for others. Extra columns stay, whatever
their names; one named ``removed`` gives way. Empty table: no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .near_dedup import SHINGLE, band_keys, in_shared_buckets, listed, settle, signatures
from .shared import STEP_BYTES, discard, free_name, materialise, mix64, powers, release, shingle_sets, sieved, slices, spans_of, split_words, table, tidy

PERCENT = 80
RECALL = 0.995
ROWS = 2
#: Words of a run of repeats from which it is removed.
MIN_WORDS = 25
#: Words of an anchor, and of the places among which one is chosen.
ANCHOR, SPREAD = 25, 26
#: Code points beyond an anchor in which it grows; the words that count there are fewer than ``SPREAD``.
REACH = 400
#: Code points (of empty lines) that may lie between the repeats of a run.
GAP = 4
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tune(percent: int = PERCENT, rows: int = ROWS, recall: float = RECALL) -> int:
    """The fewest bands of so many rows that let a pair at the threshold meet with the probability ``recall``."""
    bands = 1
    while 1 - (1 - (percent / 100) ** rows) ** bands < recall:
        bands += 1
    return bands


def _identity(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit identity of each sequence of words, and its length."""
    n = spans_of(ends)[1]
    within = np.arange(len(words)) - np.repeat(ends - n, n)
    up = powers(int(n.max()) if len(n) else 0)[0]
    terms = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(words) * up[within], dtype=np.uint64))) if len(words) else np.zeros(1, np.uint64)
    return mix64(terms[ends] - terms[ends - n] + n.astype(np.uint64)).view(np.int64), n


def _sliding(values: np.ndarray, width: int, fold: Callable) -> np.ndarray:
    """``fold`` (minimum or maximum) of each ``width`` values that follow each other."""
    span = 1
    while 2 * span <= width:
        values, span = fold(values[:-span], values[span:]), 2 * span
    return fold(values[: span - width], values[width - span :]) if width > span else values


def anchors(words: np.ndarray, ends: np.ndarray, size: int = ANCHOR, spread: int = SPREAD) -> tuple[np.ndarray, np.ndarray]:
    """First words (positions in ``words``) of the anchors of all texts, and their identities. Of any ``spread`` runs of
    ``size`` words that follow each other in a text, the one with the least hash is an anchor."""
    n = len(words)
    if n < size + spread - 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    up, down = powers(n)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(words) * up, dtype=np.uint64)))
    grams = mix64((sums[size:] - sums[:-size]) * down[: n - size + 1] + np.uint64(size))
    least = _sliding(grams, spread, np.minimum)
    # windows of runs that end in the text in which they begin
    last = np.repeat(ends, spans_of(ends)[1])
    least[np.arange(len(least)) + size + spread - 1 > last[: len(least)]] = 0
    edge = np.zeros(spread - 1, np.uint64)
    at = np.flatnonzero((_sliding(np.concatenate((edge, least, edge)), spread, np.maximum) == grams) & (grams > 0))
    return at, grams[at].view(np.int64)


def _text_of(doc: Column) -> Column:
    """What places belong to: an identifier and its text. Rows of one identifier may hold unlike texts; the order is that of
    identifiers."""
    return F.struct(doc.cast("long").alias("doc"), F.xxhash64("text").alias("body"))


def _kind(rows: DataFrame) -> str:
    return rows.schema["doc"].dataType.simpleString()


def units(docs: DataFrame, bands: int, rows: int = ROWS, size: int = SHINGLE) -> DataFrame:
    """A row per line with words and per anchor: ``doc``, ``line`` (or an anchor), ``start``, ``length``, ``at`` (its first
    word's number in the text), ``words``, ``unit`` (identity), ``n`` (shingles of a line, else 0) and ``bands`` (of lines;
    of equal ones in a slice of texts only the first has them)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a step holds many numbers a word
        for part in slices(batches, "text", STEP_BYTES // 8):
            w = split_words(part.column("text"))
            # code points before each byte
            points = np.zeros(len(w.data) + 1, np.int64)
            np.cumsum((w.data & 0xC0) != 0x80, out=points[1:])
            begins, breaks = w.bounds[:-1], np.flatnonzero(w.data == 10)
            ends = np.searchsorted(w.starts, breaks)
            identity, n = _identity(w.hashes, ends)
            of = np.searchsorted(w.bounds[1:], breaks, "right")
            first = np.concatenate((np.zeros(1, np.int64), breaks[:-1] + 1))
            whole = np.flatnonzero(n)
            fresh = np.zeros(len(n), bool)
            fresh[whole[np.unique(identity[whole], return_index=True)[1]]] = True
            sets, set_ends = shingle_sets(w.hashes, ends, size)
            sizes = spans_of(set_ends)[1]
            keys = band_keys(signatures(sets[np.repeat(fresh, sizes)], np.cumsum(sizes[fresh]), bands * rows), bands, rows)
            at, anchor = anchors(w.hashes, w.text_ends)
            anchor_of = np.searchsorted(w.text_ends, at, "right")
            # a line's end mark belongs to it; that after the text isn't the text's
            stop = np.concatenate((np.where(breaks + 1 == w.bounds[of + 1], breaks, breaks + 1)[whole], w.ends[at + ANCHOR - 1]))
            start, owner = np.concatenate((first[whole], w.starts[at])), np.concatenate((of[whole], anchor_of))
            place = np.concatenate(((ends - n)[whole], at)) - spans_of(w.text_ends)[0][owner]
            extra = np.zeros(len(at), np.int64)
            numbers = (points[start] - points[begins[owner]], points[stop] - points[start], place, np.concatenate((n[whole], extra + ANCHOR)))
            cols = [
                part.column("doc").take(pa.array(owner)), pa.array(np.arange(len(owner)) < len(whole)), *(pa.array(x.astype(np.int32)) for x in numbers),
                pa.array(np.concatenate((identity[whole], anchor))), pa.array(np.concatenate((sizes[whole], extra))), listed(keys, np.concatenate((fresh[whole], extra > 0))),
            ]
            yield pa.RecordBatch.from_arrays(cols, names)

    names = ["doc", "line", "start", "length", "at", "words", "unit", "n", "bands"]
    kinds = "line boolean, start int, length int, at int, words int, unit bigint, n bigint, bands array<bigint>"
    return docs.mapInArrow(lambda batches: tidy(run(batches)), f"doc {_kind(docs)}, {kinds}")


def _repeated(placed: DataFrame, cluster: str) -> DataFrame:
    """The places in clusters that several documents hold, with ``keeper``, the smallest of these. Written, so that the
    join ends there and adaptive execution can split the rows of a large cluster."""
    several = placed.groupBy(cluster).agg(F.min("doc").alias("keeper"), F.max("doc").alias("_most")).where("keeper.doc <> _most.doc").select(cluster, "keeper")
    return materialise(placed.join(several, cluster))


def same_words(own: str, kept: str, ahead: bool) -> tuple[int, int]:
    """The words that two texts have in common from their beginning (``ahead``) or up to their end, and the code points of
    ``own`` that they take."""
    a, b = (x.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass") for x in (own, kept))
    if not ahead:
        a, b = a[::-1], b[::-1]
    n = taken = 0
    for x, y in zip(_WORD.finditer(a), _WORD.finditer(b), strict=False):
        # a word at the edge of what was read may go on
        cut = (len(a) >= REACH and x.end() == len(a)) or (len(b) >= REACH and y.end() == len(b))
        if n == SPREAD - 1 or cut or x.group() != y.group():
            break
        n, taken = n + 1, x.end()
    return n, taken


def grown(edges: DataFrame, around: DataFrame) -> DataFrame:
    """Places of ``edges`` (anchors) with the words beyond them that their keepers share; ``around``: ``doc``, ``start``,
    ``before`` and ``after`` of all places concerned."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [b.column(c).to_pylist() for c in ("before", "kept_before", "after", "kept_after")]
            left = np.array([same_words(x, y, False) for x, y in zip(*texts[:2], strict=True)], np.int32).reshape(-1, 2)
            right = np.array([same_words(x, y, True) for x, y in zip(*texts[2:], strict=True)], np.int32).reshape(-1, 2)
            start, length, at, words = (b.column(c).to_numpy() for c in ("start", "length", "at", "words"))
            made = (start - left[:, 1], length + left[:, 1] + right[:, 1], at - left[:, 0], words + left[:, 0] + right[:, 0])
            yield pa.RecordBatch.from_arrays([b.column("doc"), *map(pa.array, made), b.column("keeper")], ["doc", "start", "length", "at", "words", "keeper"])

    kept = around.select(F.col("doc").alias("keeper"), F.col("start").alias("from"), F.col("before").alias("kept_before"), F.col("after").alias("kept_after"))
    both = edges.join(around, ["doc", "start"]).join(kept, ["keeper", "from"])
    return both.mapInArrow(lambda batches: tidy(run(batches)), f"doc {_kind(edges)}, start int, length int, at int, words int, keeper {_kind(edges)}")


def repeats(docs: DataFrame, key: str = "doc_id", percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """The runs to remove: ``doc`` (identifier and text), ``start``, ``length``, ``words``, ``keepers`` (identifiers of the
    documents that keep such passages)."""
    rows = docs.where(F.col(key).isNotNull()).select(_text_of(F.col(key)).alias("doc"), "text")
    found = materialise(units(rows, tune(percent)))
    lines = found.where("line")
    # equal lines and anchors
    same = _repeated(found.drop("n", "bands"), "unit")
    others = same.where("doc.doc <> keeper.doc")
    # anchors that no other overlaps before or after them; repeated rows hold the same places
    by_place = Window.partitionBy("doc").orderBy("start")
    ends = others.where("not line").dropDuplicates(["doc", "start"]).withColumn("_end", F.col("start") + F.col("length"))
    alone = lambda x: F.coalesce(x, F.lit(True))
    ends = ends.withColumn("_open", alone(F.lag("_end").over(by_place) < F.col("start")) | alone(F.lead("start").over(by_place) > F.col("_end")))
    first = same.where("not line and doc = keeper").groupBy("unit").agg(F.min("start").alias("from"))
    edges = materialise(ends.where("_open").join(first, "unit").select("doc", "start", "length", "at", "words", "keeper", "from"))
    # near lines: the text of each of them from one place where it stands
    members = in_shared_buckets(lines.select(F.col("unit").alias("rep"), "n", "bands"))
    at = lines.select("unit", "doc", "start", "length").join(members.select(F.col("rep").alias("unit")).distinct(), "unit", "left_semi")
    at = at.groupBy(F.col("unit").alias("id")).agg(F.min(F.struct("doc", "start", "length")).alias("at")).select("id", "at.*")
    # and what is around the edges and their keepers' places
    asked = edges.select("doc", "start", "length").unionByName(edges.select(F.col("keeper").alias("doc"), F.col("from").alias("start"), "length")).distinct()
    spots = materialise(at.unionByName(asked.withColumn("id", F.lit(None).cast("long"))))
    held = sieved(rows, F.col("doc"), spots, "doc")[0].hint("merge").join(spots, "doc")
    before = F.greatest(F.col("start") - REACH, F.lit(0))
    line = F.col("id").isNotNull()
    every = materialise(
        held.select(
            "id", "doc", "start", F.when(line, F.substring("text", F.col("start") + 1, F.col("length"))).alias("text"),
            F.when(~line, F.substring("text", before + 1, F.col("start") - before)).alias("before"), F.when(~line, F.substring("text", F.col("start") + F.col("length") + 1, F.lit(REACH))).alias("after"),
        )
    )
    texts = materialise(every.where("id is not null").select("id", "text").dropDuplicates(["id"]))
    wider = materialise(grown(edges, every.where("id is null").select("doc", "start", "before", "after").dropDuplicates(["doc", "start"])))
    discard(every, edges, spots)
    release(docs)
    empty = docs.sparkSession.createDataFrame([], "a bigint, b bigint")
    parts = settle(members, texts, empty, percent)
    discard(members, texts)
    near = _repeated(lines.drop("n", "bands").join(parts.select(F.col("node").alias("unit"), "component"), "unit"), "component")
    discard(found)
    release(docs)
    columns = ("doc", "start", "length", "at", "words", "keeper")
    placed = near.where("doc.doc <> keeper.doc").select(*columns).unionByName(others.select(*columns)).unionByName(wider)
    # repeated rows hold the same places
    again = placed.groupBy("doc", "start", "length").agg(F.max("at").alias("at"), F.max("words").alias("words"), F.min("keeper").alias("keeper")).withColumn("_end", F.col("start") + F.col("length"))
    above = Window.partitionBy("doc").orderBy("start", "_end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("doc").orderBy("start", "_end").rowsBetween(Window.unboundedPreceding, 0)
    # a run goes on while a place begins where the run ends; empty lines may lie between
    runs = again.withColumn("_new", F.when(F.col("start") <= F.max("_end").over(above) + GAP, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(upto))
    # places overlap: a run's words are those from its first to its last
    words = (F.max(F.col("at") + F.col("words")) - F.min("at")).cast("long").alias("words")
    spans = runs.groupBy("doc", "_run").agg(F.min("start").alias("start"), F.max("_end").alias("_end"), words, F.array_sort(F.collect_set("keeper.doc")).alias("keepers"))
    out = materialise(spans.where(F.col("words") >= min_words).select("doc", "start", (F.col("_end") - F.col("start")).alias("length"), "words", "keepers"))
    discard(same, near, wider)
    return out


def substring_dedup(docs: DataFrame, key: str = "doc_id", percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with ``removed`` (the runs, ordered) and ``text`` without them."""
    spans = repeats(docs, key, percent, min_words)
    own = docs.drop("removed")
    doc = free_name(own.columns, "_doc")
    listed_ = spans.groupBy(F.col("doc").alias(doc)).agg(F.array_sort(F.collect_list(F.struct("start", "length", "words", "keepers"))).alias("removed"))
    # only documents that may have runs move
    mine = _text_of(F.col(key))
    cut, whole = sieved(own, mine, spans, "doc")
    cut = cut.hint("merge").join(listed_, mine == F.col(doc), "left").drop(doc)
    # the text between the runs: from each run's end to the next one's start
    begins = F.concat(F.array(F.lit(0)), F.transform("removed", lambda r: r["start"] + r["length"]))
    ends = F.concat(F.transform("removed", lambda r: r["start"]), F.array(F.length("text")))
    rest = F.array_join(F.transform(F.arrays_zip(begins.alias("a"), ends.alias("b")), lambda x: F.substring(F.col("text"), x["a"] + 1, x["b"] - x["a"])), "")
    cut = cut.withColumn("text", F.when(F.col("removed").isNull(), F.col("text")).otherwise(rest))
    return cut.unionByName(whole.withColumn("removed", F.lit(None).cast(cut.schema["removed"].dataType)))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.length("text").cast("long").alias("n_chars"))
    out = substring_dedup(docs)
    words = F.coalesce(F.aggregate("removed", F.lit(0).cast("long"), lambda s, r: s + r["words"]), F.lit(0).cast("long"))
    return out.select(
        "doc_id", F.coalesce("n_chars", F.lit(0).cast("long")).alias("n_chars"), F.coalesce(F.size("removed"), F.lit(0)).alias("n_removed"), words.alias("removed_words"),
        F.coalesce(F.array_distinct(F.flatten(F.transform("removed", lambda r: r["keepers"]))), F.array().cast("array<bigint>")).alias("keepers"),
        F.coalesce(F.transform("removed", lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"))), F.array().cast("array<struct<start:int,length:int>>")).alias("spans"),
        "text",
    )


QUERIES = {"op2_substring_dedup": op2_substring_dedup}
ORACLES: dict[str, str] = {}
