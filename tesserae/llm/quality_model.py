"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics of a text (shares of byte classes, word and line figures) are computed for a slice of texts at once. The
trees are grown on the driver from a bounded sample of labelled documents (``SAMPLE`` rows, those with the smallest
hash of their identifier), level by level on histograms of binned statistics, and kept as complete binary trees in flat
arrays, through which all rows of a batch go together.

Defined results. Null or empty text: the statistics of an empty text. Without labels of both kinds: every score is the
share of label 1 (0.5 without any). Repeated rows: each its result; a repeated label counts by its largest value. Null
identifiers never serve for learning. Extra columns are ignored. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import STEP_BYTES, slices, table, tidy, word_arrays

#: Labelled rows that a model learns from at most.
SAMPLE = 20_000
THRESHOLD = 0.3
#: Frequent words of the corpus languages.
COMMON = frozenset(
    "the of and to in is that it for was on are as with be by this from at or an a "
    "der die das und ist in den von zu mit sich auf für im dem nicht ein eine als auch "
    "le la les de des et est en un une du que dans pour qui sur par au avec ne "
    "el los las y del se por con para una su al lo como más o pero sus".split()
)
_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "symbol": b"#*$%&|<>@^~=+\\_{}[]`/", "stop": b".?", "shout": b"!", "comma": b",;:", "line": b"\n", "space": b" \t\r\x0b\x0c"}
FEATURES = (
    *(f"share_{c}" for c in _CLASSES), "share_high", "share_control", "log_bytes", "log_words", "word_bytes",
    "distinct_words", "same_as_before", "common_words", "longest_word", "words_a_line", "most_frequent",
)


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of ``FEATURES`` for each text (null: as empty)."""
    texts = texts.take(pa.array(np.arange(len(texts)))).fill_null("").cast(pa.large_string())
    rows = len(texts)
    if not rows:
        return np.zeros((0, len(FEATURES)), np.float32)
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + rows + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    data, bounds = data[bounds[0] : bounds[-1]], bounds - bounds[0]
    size = np.diff(bounds)

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return total[bounds[1:]] - total[bounds[:-1]]

    some = np.maximum(size, 1)
    out, counts = [], {}
    for name, members in _CLASSES.items():
        belongs = np.zeros(256, np.uint8)
        belongs[np.frombuffer(members, np.uint8)] = 1
        counts[name] = count(belongs[data])
        out.append(counts[name] / some)
    out += [count(data >= 128) / some, count(data < 9) / some]
    codes, vocabulary, ends = word_arrays(texts)
    n = np.diff(np.concatenate(([0], ends)))
    words = np.maximum(n, 1)
    owner = np.repeat(np.arange(rows), n)
    lengths = np.fromiter((len(x) for x in vocabulary.cast(pa.large_binary()).to_pylist()), np.int64, len(vocabulary))
    common = np.fromiter((x in COMMON for x in vocabulary.to_pylist()), np.int64, len(vocabulary))
    key, times = np.unique(owner * np.int64(max(len(vocabulary), 1)) + codes, return_counts=True)
    pair_owner = key // max(len(vocabulary), 1)
    most, longest = np.zeros(rows), np.zeros(rows)
    np.maximum.at(most, pair_owner, times)
    if len(codes):
        np.maximum.at(longest, pair_owner, lengths[key % len(vocabulary)])
    same = (codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])
    by = lambda weights, at=owner: np.bincount(at, weights, minlength=rows)
    out += [
        np.log1p(size), np.log1p(n), by(lengths[codes] if len(codes) else None) / words, np.bincount(pair_owner, minlength=rows) / words,
        by(same, owner[1:]) / words, by(common[codes] if len(codes) else None) / words, np.log1p(longest), np.log1p(n / (counts["line"] + 1)), most / words,
    ]
    return np.stack(out, 1).astype(np.float32)


@dataclass(frozen=True)
class Forest:
    """Complete binary trees in flat arrays: node i has children 2i+1 and 2i+2; the last level holds the leaf values."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray  # to the right above this value; +inf where a node doesn't split
    leaf: np.ndarray  # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows, inner = np.full(len(x), self.base), np.arange(len(x)), self.feature.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            while len(x) and at[0] < inner:  # all rows are on one level
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            total += leaf[at - inner]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: float = 3.0) -> Forest:
    """Boosting on log loss. Statistics are binned at their quantiles once; each level's histograms of gradients are made
    with one ``bincount``, and a split needs ``least`` of second derivative on each side."""
    inner, share = 2**depth - 1, float(np.mean(y)) if len(y) else 0.5
    base = float(np.log(np.clip(share, 1e-6, 1 - 1e-6) / np.clip(1 - share, 1e-6, 1)))
    if not len(y) or share in (0.0, 1.0):
        return Forest(base, np.zeros((0, inner), np.int64), np.zeros((0, inner), np.float32), np.zeros((0, inner + 1)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1]).astype(np.float32)) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(cuts, x.T, strict=True)], 1)
    width, n_features = bins + 1, x.shape[1]
    offsets = np.arange(n_features) * width
    total, found = np.full(len(y), base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        at, feature, cut, leaf = np.zeros(len(y), np.int64), np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32), np.zeros(inner + 1)
        for level in range(depth):
            first, n = 2**level - 1, 2**level
            slot = ((at - first)[:, None] * (n_features * width) + offsets + binned).ravel()
            hist = lambda w: np.bincount(slot, np.repeat(w, n_features), minlength=n * n_features * width).reshape(n, n_features, width)  # noqa: B023, E731
            gl, hl = np.cumsum(hist(g), 2), np.cumsum(hist(h), 2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(hl < least) | (ht - hl < least)] = 0
            best = gain.reshape(n, -1).argmax(1)
            split_bin = np.full(n, width)
            for i in np.flatnonzero(gain.reshape(n, -1).max(1) > 1e-6).tolist():
                f, b = divmod(int(best[i]), width)
                if b < len(cuts[f]):
                    feature[first + i], cut[first + i], split_bin[i] = f, cuts[f][b], b
            node = at - first
            at = 2 * at + 1 + (binned[np.arange(len(y)), feature[at]] > split_bin[node])
        leaf = rate * np.bincount(at - inner, g, minlength=inner + 1) / (np.bincount(at - inner, h, minlength=inner + 1) + ridge)
        total += leaf[at - inner]
        found.append((feature, cut, leaf))
    return Forest(base, *(np.stack(c) for c in zip(*found, strict=True)))


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", sample: int = SAMPLE) -> Forest:
    """Learns ``quality`` from labelled documents outside the held-out fold, ``sample`` of them at most. The sample is
    drawn from the labels alone, so only its documents' statistics come to the driver."""
    chosen = labels.where(~held_out(F.col("doc_id")) & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = docs.select(F.col(key).alias("doc_id"), "text")
    chosen = chosen.join(known.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", STEP_BYTES // 2):
            x = statistics(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), pa.array(list(x), pa.list_(pa.float32()))], ["doc_id", "quality", "x"])

    kind = docs.schema[key].dataType.simpleString()
    rows = known.join(F.broadcast(chosen), "doc_id").select("doc_id", F.col("quality").cast("double").alias("quality"), "text").mapInArrow(lambda batches: tidy(run(batches)), f"doc_id {kind}, quality double, x array<float>").toArrow().to_pandas()
    rows = rows.sort_values("doc_id").drop_duplicates("doc_id")  # the same model whatever the order of the rows
    x = np.stack(rows["x"].to_list()).astype(np.float32) if len(rows) else np.zeros((0, len(FEATURES)), np.float32)
    return grow(x, (rows["quality"].to_numpy() > 0).astype(np.float64))


def quality_scores(docs: DataFrame, forest: Forest, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``score`` of every whole text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", STEP_BYTES // 2):
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(forest.score(statistics(part.column("text"))))], [*keep, "score"])

    columns = list(dict.fromkeys((*keep, "text")))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*columns).mapInArrow(lambda batches: tidy(run(batches)), f"{schema}, score double")


def op10_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scores = quality_scores(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op10_quality_model": op10_quality_model}
ORACLES: dict[str, str] = {}
