"""Lexical and vector retrieval over whole batches of queries.

Everything is keyed by (query, document). Tokens are counted where their text lies; what moves are document frequencies,
scores and the per-query top-k, which Spark limits before it shuffles. An index is written once and asked many times. Query
sets may be of any size; Spark broadcasts them where their size allows. Vector search is in ``dense``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType

from tesserae.functions.text import tokens
from tesserae.operators.dense import CANDIDATES, best_of_rows, dense
from tesserae.sources.scratch import written

K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_K = 60
RERANKED = 20


def ranked(rows: DataFrame, by: list[Column], within: str = "query_id", name: str = "rank") -> DataFrame:
    """``rank`` from 1 in each query."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(within).orderBy(*by)))


#: Characters whose tokens are counted at once, about.
COUNTED = 1 << 22
#: Whether a byte of UTF-8 belongs to a token; texts are in lower case by then.
_TOKEN = np.isin(np.arange(256), np.frombuffer(b"0123456789abcdefghijklmnopqrstuvwxyz", np.uint8))


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts, and where each begins (and the last ends)."""
    texts = texts.cast(pa.large_utf8())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return data, ends - ends[0]


def _runs(inside: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of ``inside`` begin and end; none goes on in the next text."""
    edges = np.zeros(len(inside) + 1, np.bool_)
    edges[:-1] = inside
    edges[1:] ^= inside
    cuts = ends[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(inside))]
    cuts = np.unique(cuts[inside[cuts] & inside[cuts - 1]])  # an end and a beginning in one place
    at = np.flatnonzero(edges)
    if len(cuts):
        at = np.sort(np.concatenate([at, cuts, cuts]))
    return at[::2], at[1::2]


def _tokens_of(data: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The tokens of lower-case texts, as ``tokens`` has them, and where each begins."""
    inside = _TOKEN[data]
    at, to = _runs(inside, ends)
    offsets = np.zeros(len(at) + 1, np.int64)
    np.cumsum(to - at, out=offsets[1:])
    return pa.Array.from_buffers(pa.large_utf8(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]), at


def _texts_of(at: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The text that each place (in order) is in."""
    return np.repeat(np.arange(len(ends) - 1), np.diff(np.searchsorted(at, ends)))


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        size = np.cumsum(pc.binary_length(whole.column("text")).to_numpy(zero_copy_only=False))
        cuts = np.flatnonzero(np.diff(size // COUNTED, prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], whole.num_rows], strict=True):
            part = whole.slice(a, b - a)
            data, ends = _bytes_of(part.column("text"))
            found, at = _tokens_of(data, ends)
            of = _texts_of(at, ends)
            held = found.dictionary_encode()
            code = np.sort(of * max(1, len(held.dictionary)) + held.indices.to_numpy())
            first = np.flatnonzero(np.diff(code, prepend=-1))
            doc, term = np.divmod(code[first], max(1, len(held.dictionary)))
            tf, dl = np.diff(np.append(first, len(code))), np.bincount(of, minlength=len(part))[doc]
            yield pa.RecordBatch.from_arrays([part.column("doc").take(pa.array(doc)), held.dictionary.take(pa.array(term)).cast(pa.utf8()), pa.array(tf, pa.int64()), pa.array(dl, pa.int64())], ["doc", "term", "tf", "dl"])


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc``, ``term``, ``tf``, ``dl`` (tokens of the document). Counted where the text lies, so no row moves; a row is a
    document."""
    rows = docs.select(F.col(key).alias("doc"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    return rows.mapInArrow(_counted, f"doc {rows.schema['doc'].dataType.simpleString()}, term string, tf long, dl long")


def term_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc``, ``term``, ``tf``."""
    return postings(docs, key, text).select("doc", "term", "tf")


def doc_lengths(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc``, ``dl``: tokens of each text, without exploding them."""
    return docs.select(F.col(key).alias("doc"), F.coalesce(F.size(tokens(F.col(text))), F.lit(0)).cast("long").alias("dl"))


def idf(held: DataFrame, n_docs: int) -> DataFrame:
    """``term``, ``df``, ``idf`` of postings. A negative idf is replaced by ``EPSILON`` times the mean idf of the
    vocabulary, which includes the negative ones."""
    return _weighed(held.groupBy("term").agg(F.count(F.lit(1)).alias("df")), n_docs)


def _weighed(df: DataFrame, n_docs: int) -> DataFrame:
    raw = df.withColumn("raw", F.log(n_docs - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))  # one row
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


@dataclass(frozen=True)
class Index:
    """What BM25 knows of a corpus: postings, the terms' weights, two totals, and the postings in blocks or packed (see
    ``packed``), if they were written so."""

    postings: DataFrame
    terms: DataFrame
    n_docs: int
    mean_length: float
    blocks: DataFrame | None = None
    packed: DataFrame | None = None


def index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
    held = postings(docs, key, text)
    return _index(held, docs.count(), held)


def _index(counted: DataFrame, n_docs: int, held: DataFrame) -> Index:
    total = counted.agg(F.sum("tf")).head()[0] or 0
    return Index(held, idf(held, n_docs), n_docs, total / n_docs if n_docs else 0.0)


#: Characters (about) and documents (at most) of a row of packed postings, and such rows of a file: readers take all rows of
#: a file at once.
PACKED, DOCS, ROWS = 1 << 23, 1 << 13, 4
#: How ``at`` and ``tf`` are written: as bytes, since there is one of each for every posting.
_INT = np.dtype("<i4")
#: Whether a byte of UTF-8 parts words, as in ``words``.
_SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\x0b\f\r", np.uint8))


def _windows_of(word: np.ndarray, doc: np.ndarray, n_words: np.ndarray, window: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows as ``chunking.windows`` has them, over tokens that are the ``word``-th of ``doc``: places of tokens and the
    window that each is in (a token comes once for each), and each window's document and number there."""
    last = np.maximum(0, -((window - n_words) // step))
    n = np.where(n_words > 0, last + 1, 0)
    first = np.cumsum(n) - n
    places, texts = [], []
    for back in range(-(-window // step)):
        k = word // step - back
        here = np.flatnonzero((k >= 0) & (k <= last[doc]) & (word < k * step + window))
        places.append(here)
        texts.append(first[doc[here]] + k[here])
    of = np.repeat(np.arange(len(n)), n)
    return np.concatenate(places), np.concatenate(texts), of, np.arange(len(of)) - first[of]


def _packer(window: int, step: int, schema: pa.Schema) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def whole(x: pa.Array | np.ndarray, kind: pa.DataType) -> pa.Array:
        if pa.types.is_binary(kind):
            return pa.array([x.astype(_INT).tobytes()], kind)
        return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind.value_type) if isinstance(x, np.ndarray) else x.cast(kind.value_type))

    def pack(part: pa.RecordBatch) -> pa.RecordBatch:
        part = part.take(pa.array(np.argsort(_places(part.column("doc"))[0], kind="stable")))  # of equal scores the first documents count
        data, ends = _bytes_of(part.column("text"))
        found, at = _tokens_of(data, ends)
        text = _texts_of(at, ends)
        of, number = np.arange(len(part)), np.full(len(part), -1)
        held = found.dictionary_encode()
        term = held.indices.to_numpy()
        if window:
            starts, _ = _runs(~_SPACE[data], ends)
            before = np.searchsorted(starts, ends)
            word = np.searchsorted(starts, at, side="right") - 1 - before[text]
            place, text, of, number = _windows_of(word, text, np.diff(before), window, step)
            term = term[place]
        code = np.sort(term.astype(np.int64) * max(1, len(of)) + text)
        first = np.flatnonzero(np.diff(code, prepend=-1))
        term, at = np.divmod(code[first], max(1, len(of)))
        df = np.bincount(term, minlength=len(held.dictionary))
        tf, lengths = np.diff(np.append(first, len(code))), np.bincount(text, minlength=len(of))
        values = [part.column("doc"), of, number, lengths, held.dictionary.take(pa.array(np.flatnonzero(df))), df[df > 0], at, tf]
        return pa.RecordBatch.from_arrays([whole(x, f.type) for x, f in zip(values, schema, strict=True)], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.cumsum(pc.binary_length(b.column("text")).to_numpy(zero_copy_only=False))
            cuts = np.flatnonzero(np.diff(size // PACKED, prepend=-1))
            cuts = np.union1d(cuts, np.arange(0, b.num_rows, DOCS))
            for a, z in zip(cuts, [*cuts[1:], b.num_rows], strict=True):
                yield pack(b.slice(a, z - a))

    return run


def packed(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 0, step: int = 0) -> DataFrame:
    """Postings of some thousand documents a row, counted where the texts lie: ``docs``; for each of their texts its document
    ``of`` (a place in ``docs``), its ``number`` there and ``lengths``; distinct ``terms`` with their ``df``, and for all
    postings in the terms' order the text ``at`` and ``tf`` (bytes of ``_INT``). Identifiers are unique. A text is a document (its number is -1)
    or one of its windows of ``window`` words, ``step`` apart (see ``chunking.windows``)."""
    rows = docs.select(F.col(key).alias("doc"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    kind = rows.schema["doc"].dataType
    lists = {"docs": to_arrow_type(kind), "of": pa.int32(), "number": pa.int32(), "lengths": pa.int32(), "terms": pa.utf8(), "df": pa.int32()}
    schema = pa.schema([*((c, pa.list_(t)) for c, t in lists.items()), ("at", pa.binary()), ("tf", pa.binary())])
    made = f"docs array<{kind.simpleString()}>, of array<int>, number array<int>, lengths array<int>, terms array<string>, df array<int>, at binary, tf binary"
    return rows.mapInArrow(_packer(window, step, schema), made)


def _values(b: pa.RecordBatch, i: int, name: str) -> pa.Array:
    return b.column(name)[i].values


def _ints(b: pa.RecordBatch, i: int, name: str) -> np.ndarray:
    x = b.column(name)[i]
    return np.frombuffer(x.as_buffer(), _INT) if pa.types.is_binary(x.type) else x.values.to_numpy()


def _unpacked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            docs, (of, number, lengths, df, at, tf) = _values(b, i, "docs"), (_ints(b, i, c) for c in ("of", "number", "lengths", "df", "at", "tf"))
            if not len(at):
                continue
            named = docs.take(pa.array(of))
            part = pc.binary_join_element_wise(named.cast(pa.utf8()), pa.array(number).cast(pa.utf8()), "::fixed::chunk")
            part = pc.if_else(pa.array(number < 0), "", part)
            keys = pa.StructArray.from_arrays([named, part], ["doc_id", "part"])
            terms = _values(b, i, "terms").take(pa.array(np.repeat(np.arange(len(df)), df)))
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(at)), terms, pa.array(tf, pa.int64()), pa.array(lengths[at], pa.int64())], ["doc", "term", "tf", "dl"])


def unpacked(rows: DataFrame) -> DataFrame:
    """``postings`` of packed ones; ``doc`` is (``doc_id``, ``part``), ``part`` a chunk's identifier or empty."""
    return rows.mapInArrow(_unpacked, f"doc struct<doc_id:{rows.schema['docs'].dataType.elementType.simpleString()},part:string>, term string, tf long, dl long")


#: Documents of a block, about: the hash that deals them out is not exact.
BLOCK = 1024
#: Blocks of documents that are scored first for each query, to know what its results reach at least.
FIRST = 4
#: Room that is given to bounds, against rounding.
ROOM = 1e-6


def _contribution(held: Index) -> Column:
    """What a posting (``tf``, ``dl``, ``idf``) adds to a score for each time that a query has its term."""
    return F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(held.mean_length or 1.0)))


def blocks_of(held: Index, size: int | None = None) -> DataFrame:
    """``term``, ``bucket``, ``top`` (the greatest contribution, 0 at least), ``docs`` (of ``doc`` and contribution ``w``).

    A document is in one bucket of about ``size`` documents of its own length (to a fifth): contributions fall with length,
    so the blocks of short documents stand out. A frequent term has a block in each bucket, none is longer than a bucket."""
    length = F.floor(F.log2(F.col("dl") + 1) * 4).cast("long")
    docs = held.postings.select("doc", length.alias("length")).distinct()
    parts = docs.groupBy("length").agg(F.ceil(F.count(F.lit(1)) / (size or BLOCK)).alias("parts"))
    weighed = held.postings.withColumn("length", length).join(parts, "length").join(held.terms.select("term", "idf"), "term")
    bucket = F.shiftleft("length", 40) + F.pmod(F.xxhash64("doc"), F.col("parts"))
    rows = weighed.select("term", bucket.alias("bucket"), "doc", _contribution(held).alias("w"))
    made = rows.groupBy("term", "bucket").agg(F.greatest(F.max("w"), F.lit(0.0)).alias("top"), F.collect_list(F.struct("doc", "w")).alias("docs"))
    return made.repartitionByRange("term", "bucket").sortWithinPartitions("term", "bucket")


def write_index(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", blocks: bool = True, windows: tuple[int, int] | None = None) -> Index:
    """The index, written to ``path`` (texts are made, counted and tokenised in one pass) and read back; blocks lie in the
    order of terms. ``blocks`` are for few questions of rare words: questions with a word of most documents have to read most
    of them, several times. ``windows`` (words and step; 0: whole documents) has postings ``packed``, without blocks, for
    ``best_documents`` and ``holders``; then identifiers are unique."""
    if windows is not None:
        return _write_packed(docs, path, key, text, windows)
    spark = docs.sparkSession
    seen = Observation()
    postings(docs.observe(seen, F.count(F.lit(1)).alias("n")), key, text).write.mode("overwrite").parquet(f"{path}/postings")
    held = spark.read.parquet(f"{path}/postings")
    made = _index(held, seen.get.get("n", 0), held)
    made.terms.write.mode("overwrite").parquet(f"{path}/terms")
    _write_totals(spark, path, made.n_docs, made.mean_length)
    if blocks:
        weighed = Index(held, spark.read.parquet(f"{path}/terms"), made.n_docs, made.mean_length)
        blocks_of(weighed).write.mode("overwrite").parquet(f"{path}/blocks")
    return read_index(spark, path, blocks)


def _write_packed(docs: DataFrame, path: str, key: str, text: str, windows: tuple[int, int]) -> Index:
    spark = docs.sparkSession
    packed(docs, key, text, *windows).write.mode("overwrite").options(**{"maxRecordsPerFile": ROWS, "parquet.enable.dictionary": "false"}).parquet(f"{path}/postings")
    held = spark.read.parquet(f"{path}/postings")
    n_docs, total = held.agg(F.coalesce(F.sum(F.size("lengths")), F.lit(0)), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x))).head()
    df = held.select(F.inline(F.arrays_zip("terms", "df"))).groupBy(F.col("terms").alias("term")).agg(F.sum("df").alias("df"))
    _weighed(df, n_docs).write.mode("overwrite").parquet(f"{path}/terms")
    _write_totals(spark, path, n_docs, total / n_docs if n_docs else 0.0)
    return read_index(spark, path, blocks=False)


def _write_totals(spark: SparkSession, path: str, n_docs: int, mean_length: float) -> None:
    spark.range(1).select(F.lit(n_docs).cast("long").alias("n_docs"), F.lit(mean_length).cast("double").alias("mean_length")).write.mode("overwrite").parquet(f"{path}/totals")


def read_index(spark: SparkSession, path: str, blocks: bool = True) -> Index:
    totals = spark.read.parquet(f"{path}/totals").head()
    held = spark.read.parquet(f"{path}/postings")
    if "docs" in held.columns:
        return Index(unpacked(held), spark.read.parquet(f"{path}/terms"), totals["n_docs"], totals["mean_length"], packed=held)
    return Index(*(spark.read.parquet(f"{path}/{x}") for x in ("postings", "terms")), totals["n_docs"], totals["mean_length"], spark.read.parquet(f"{path}/blocks") if blocks else None)


def _asked(queries: DataFrame, query_key: str) -> DataFrame:
    """``query_id``, ``term``, ``qtf``: a term that a query repeats counts as often."""
    return queries.select(F.col(query_key).alias("query_id"), F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def _permitted(found: DataFrame, allowed: DataFrame | None) -> DataFrame:
    return found if allowed is None else found.join(allowed, [c for c in ("query_id", "doc") if c in allowed.columns], "left_semi")


#: Documents that a task scores, about: the hash that deals them out is not exact.
SCORED = 1 << 11


def bm25_scores(queries: DataFrame, held: Index, query_key: str = "query_id", allowed: DataFrame | None = None, group: Column | None = None) -> DataFrame:
    """``query_id``, ``doc``, ``score`` of all documents with a positive score. ``allowed`` (``doc``, or ``query_id`` and
    ``doc``) restricts the results, not the statistics.

    Postings of terms that are asked for are dealt out by document, before queries meet them: what moves grows with the
    documents, not with their pairs with queries, and a document's scores are complete where they are made. ``group``: a
    function of ``doc`` whose equal values lie together, as a column ``group``; then a task has about ``SCORED`` documents
    if groups are small."""
    asked = written(_asked(queries, query_key).join(held.terms.select("term", "idf"), "term"))  # small, of known size
    found = held.postings.join(asked.select("term").distinct(), "term", "left_semi")
    if allowed is not None and "query_id" not in allowed.columns:
        found = found.join(allowed, "doc", "left_semi")
    keys = ["doc"] if group is None else ["group", "doc"]
    found = (found if group is None else found.withColumn("group", group)).repartition(max(1, -(-held.n_docs // SCORED)), keys[0])
    if allowed is not None and "query_id" in allowed.columns:
        found = found.join(allowed.groupBy("doc").agg(F.collect_set("query_id").alias("_for")), "doc")
    met = found.join(asked, "term")
    if "_for" in met.columns:
        met = met.where(F.array_contains("_for", F.col("query_id")))
    return met.groupBy("query_id", *keys).agg(F.sum(F.col("qtf") * _contribution(held)).alias("score")).where("score > 0")


#: Queries and terms that a task takes at once, about.
ASKING, TERMS = 1 << 10, 1 << 10


def _places(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each value its place among the distinct values in order (nulls first), and a row for each of these."""
    if pa.types.is_struct(values.type):
        code = np.zeros(len(values), np.int64)
        for part in values.flatten():
            place, first = _places(part)
            code = code * len(first) + place
    else:
        found = values.dictionary_encode(null_encoding="encode")
        order = pc.sort_indices(found.dictionary, null_placement="at_start").to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        code = place[found.indices.to_numpy()]
    _, first, code = np.unique(code, return_index=True, return_inverse=True)
    return code, first


def _products(doc: np.ndarray, n_docs: int, term: np.ndarray, w: np.ndarray, asks: np.ndarray, terms: int = TERMS) -> np.ndarray:
    """Scores of queries (rows) and documents: contributions by document and term times ``asks`` (terms by queries), a range
    of terms at a time. Contributions of one document to one term add up."""
    out = np.zeros((asks.shape[1], n_docs))
    for a in range(0, len(asks), terms):
        part, here = asks[a : a + terms], (term >= a) & (term < a + terms)
        held = np.bincount((term[here] - a) * n_docs + doc[here], w[here], len(part) * n_docs).reshape(len(part), n_docs)
        out += part.T @ held
    return out


def _lexical_scorer(k: int, grouped: bool, schema: pa.Schema) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def score(held: pa.Table, asked: pa.Table) -> pa.Table:
        if not held.num_rows or not asked.num_rows:
            return schema.empty_table()
        column = lambda t, c: t.column(c).combine_chunks()
        words, names = column(asked, "term").unique(), column(asked, "query_id")
        query, of_query = _places(names)
        asks = np.zeros((len(words), len(of_query)))
        asks[pc.index_in(column(asked, "term"), words).to_numpy(), query] = column(asked, "qtf").to_numpy()
        held = held.append_column("_t", pc.index_in(column(held, "term"), words)).filter(pc.is_valid(pc.field("_t")))
        if not held.num_rows:
            return schema.empty_table()
        keys = column(held, "doc")
        doc, of_doc = _places(keys)
        scores = _products(doc, len(of_doc), column(held, "_t").to_numpy(), column(held, "w").to_numpy(), asks)
        if grouped:
            keys = column(held, "group")
            group, of_group = _places(keys)
            group_of = np.empty(len(of_doc), np.int64)
            group_of[doc] = group
            order = np.argsort(group_of, kind="stable")
            scores = np.maximum.reduceat(scores[:, order], np.searchsorted(group_of[order], np.arange(len(of_group))), axis=1)
            of_doc = of_group
        at, row = best_of_rows(scores, k)
        good = scores[at, row] > 0
        at, row = at[good], row[good]
        return pa.Table.from_arrays([names.take(pa.array(of_query[at])), keys.take(pa.array(of_doc[row])), pa.array(scores[at, row])], schema=schema)

    return score


def bm25_best(queries: DataFrame, held: Index, k: int, query_key: str = "query_id", allowed: DataFrame | None = None, group: Column | None = None) -> DataFrame:
    """``query_id``, ``doc``, ``score``: of each part of the documents a query's best ``k`` with a positive score; its best
    ``k`` of all are among them. ``allowed``: ``doc``. ``group``: a function of ``doc``; then ``doc`` is its value, with the
    best score of the documents that have it.

    Postings of terms that are asked for are dealt out by document, and each part meets the queries in blocks of about
    ``ASKING``: a matrix product of bounded size in one task. No row is made for a pair of posting and query."""
    asked = written(_asked(queries, query_key).join(held.terms.select("term", "idf"), "term"))  # small, of known size
    found = held.postings.join(asked.select("term", "idf").distinct(), "term")
    if allowed is not None:
        found = found.join(allowed, "doc", "left_semi")
    n_parts = max(1, -(-held.n_docs // SCORED))
    n_blocks = max(1, -(-asked.select("query_id").distinct().count() // ASKING))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))) if n > 1 else F.lit(0)
    dealt = lambda by, n: F.pmod(F.xxhash64(by), F.lit(n)).cast("int")
    by = F.col("doc") if group is None else group
    rows = found.select(dealt(by, n_parts).alias("part"), every(n_blocks).alias("block"), "doc", *([] if group is None else [group.alias("group")]), "term", _contribution(held).alias("w"))
    asks = asked.select(every(n_parts).alias("part"), dealt("query_id", n_blocks).alias("block"), "query_id", "term", "qtf")
    kinds = {"query_id": asks.schema["query_id"].dataType, "doc": rows.schema["doc" if group is None else "group"].dataType, "score": DoubleType()}
    score = _lexical_scorer(k, group is not None, pa.schema([(c, to_arrow_type(t)) for c, t in kinds.items()]))
    return rows.groupBy("part", "block").cogroup(asks.groupBy("part", "block")).applyInArrow(score, ", ".join(f"{c} {t.simpleString()}" for c, t in kinds.items()))


#: Scores that a task holds at once, and pairs of posting and query.
CELLS, PAIRS = 1 << 21, 1 << 22
#: Share of the pairs of text and query from which a term's are added as a matrix product.
DENSE = 1 / 32


def _in_blocks(asked: DataFrame, n_blocks: int) -> DataFrame:
    """``asks``: queries and their terms, a row for each block of queries."""
    return asked.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks))).agg(F.collect_list(F.struct(*asked.columns)).alias("asks")).select("asks")


def _n_blocks(asked: DataFrame) -> int:
    return max(1, -(-asked.select("query_id").distinct().count() // ASKING))


def _sums(n_terms: int, n_texts: int, n_queries: int, term: np.ndarray, text: np.ndarray, w: np.ndarray, asks: np.ndarray) -> np.ndarray:
    """Scores of queries (rows) and texts: ``w`` times ``asks`` (terms by queries) for each posting and query that meet. Terms
    of many such pairs go through matrix products, the pairs of all others are added up one by one."""
    each, df = np.count_nonzero(asks, axis=1), np.bincount(term, minlength=n_terms)
    dense = df * each > DENSE * n_texts * n_queries
    held = dense[term]
    out = _products(text[held], n_texts, (np.cumsum(dense) - 1)[term[held]], w[held], asks[dense])
    term, text, w = term[~held], text[~held], w[~held]
    of_term, query = np.nonzero(asks)
    first = np.searchsorted(of_term, np.arange(n_terms))
    pairs = np.cumsum(each[term])
    cuts = np.searchsorted(pairs, np.arange(PAIRS, pairs[-1], PAIRS)) if len(pairs) else []
    for a, z in zip([0, *cuts], [*cuts, len(term)], strict=True):
        t, n = term[a:z], each[term[a:z]]
        asked = np.repeat(first[t] - np.cumsum(n) + n, n) + np.arange(n.sum())
        posting = np.repeat(np.arange(a, z), n)
        at = query[asked] * n_texts + text[posting]
        out += np.bincount(at, w[posting] * asks[term[posting], query[asked]], n_queries * n_texts).reshape(n_queries, n_texts)
    return out


def _found_of(b: pa.RecordBatch, i: int, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the postings of each of ``words`` begin in a row, how many they are (0: not there), and where each posting is."""
    df = _ints(b, i, "df")
    place = pc.index_in(words, _values(b, i, "terms")).fill_null(-1).to_numpy()
    n = np.where(place >= 0, np.append(df, 0)[place], 0)
    first = (np.cumsum(np.append(df, 0)) - np.append(df, 0))[place]
    return first, n, np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())


def _packed_scorer(k: int, mean_length: float, schema: pa.Schema) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def score(b: pa.RecordBatch, i: int) -> Iterator[pa.RecordBatch]:
        asked = _values(b, i, "asks")
        names = asked.field("query_id")
        words = asked.field("term").unique()
        of_word = pc.index_in(asked.field("term"), words).to_numpy()
        query, of_query = _places(names)
        asks = np.zeros((len(words), len(of_query)))
        asks[of_word, query] = asked.field("qtf").to_numpy() * asked.field("idf").to_numpy()
        _, n, posting = _found_of(b, i, words)
        term, text, tf = np.repeat(np.arange(len(words)), n), _ints(b, i, "at")[posting], _ints(b, i, "tf")[posting]
        docs, of, lengths = _values(b, i, "docs"), _ints(b, i, "of"), _ints(b, i, "lengths")
        w = tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[text] / mean_length))
        each = max(1, CELLS // len(of_query))
        for a in range(0, len(of), each):
            here = slice(None) if each >= len(of) else (text >= a) & (text < a + each)
            part = of[a : a + each]
            scores = _sums(len(words), len(part), len(of_query), term[here], text[here] - a, w[here], asks)
            firsts = np.flatnonzero(np.diff(part, prepend=-1))
            if len(firsts) < len(part):
                scores = np.maximum.reduceat(scores, firsts, axis=1)
            at, row = best_of_rows(scores, k)
            good = scores[at, row] > 0
            at, row = at[good], row[good]
            yield pa.RecordBatch.from_arrays([names.take(pa.array(of_query[at])), docs.take(pa.array(part[firsts[row]])), pa.array(scores[at, row])], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                yield from score(b, i)

    return run


def best_documents(queries: DataFrame, held: Index, k: int, query_key: str = "query_id") -> DataFrame:
    """``query_id``, ``doc``, ``score`` (of the document's best text): a query's best ``k`` documents with a positive score are
    among them. Each row of packed postings meets the queries in blocks of about ``ASKING`` where it lies: no posting moves."""
    asked = written(_asked(queries, query_key).join(held.terms.select("term", "idf"), "term").select("query_id", "term", "qtf", "idf"))  # small, of known size
    met = held.packed.select("docs", "of", "lengths", "terms", "df", "at", "tf").crossJoin(_in_blocks(asked, _n_blocks(asked)))
    kinds = {"query_id": asked.schema["query_id"].dataType, "doc": held.packed.schema["docs"].dataType.elementType, "score": DoubleType()}
    score = _packed_scorer(k, held.mean_length or 1.0, pa.schema([(c, to_arrow_type(t)) for c, t in kinds.items()]))
    found = met.mapInArrow(score, ", ".join(f"{c} {t.simpleString()}" for c, t in kinds.items()))
    return found.groupBy("query_id", "doc").agg(F.max("score").alias("score"))


def _of_buckets(asked: DataFrame, held: Index, wanted: DataFrame, allowed: DataFrame | None) -> DataFrame:
    """The scores of all documents in the ``wanted`` buckets (``query_id``, ``bucket``)."""
    read = asked.join(wanted, "query_id").join(held.blocks.select("term", "bucket", "docs"), ["term", "bucket"])
    found = read.select("query_id", "qtf", F.explode("docs").alias("d")).select("query_id", "qtf", "d.doc", "d.w")
    return _permitted(found, allowed).groupBy("query_id", "doc").agg(F.sum(F.col("qtf") * F.col("w")).alias("score")).where("score > 0")


def reached_buckets(queries: DataFrame, held: Index, k: int, query_key: str = "query_id", allowed: DataFrame | None = None) -> DataFrame:
    """``query_id``, ``bucket``, ``reach`` (what no document there exceeds), ``needed``: whether it may hold one of the best
    ``k``. The buckets of greatest reach are scored; the ``k``-th score among them is what others must reach."""
    asked = _asked(queries, query_key)
    reach = asked.join(held.blocks.select("term", "bucket", "top"), "term").groupBy("query_id", "bucket").agg(F.sum(F.col("qtf") * F.col("top")).alias("reach"))
    reach = written(reach)
    first = ranked(reach, [F.desc("reach"), F.col("bucket")]).where(F.col("rank") <= FIRST).select("query_id", "bucket")
    known = ranked(_of_buckets(asked, held, first, allowed), [F.desc("score")]).where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    return reach.join(known, "query_id", "left").select("query_id", "bucket", "reach", (F.col("reach") >= F.coalesce(F.col("least") - ROOM, F.lit(0.0))).alias("needed"))


def bm25(queries: DataFrame, docs: DataFrame | Index, k: int = CANDIDATES, key: str = "doc_id", query_key: str = "query_id", text: str = "text", allowed: DataFrame | None = None) -> DataFrame:
    """``query_id``, ``doc``, ``score``, ``rank``: the best ``k`` with a positive score, ties by document. ``docs``: a
    corpus, or its index; one that was written is read in blocks, and blocks that can't reach a query's ``k``-th score are
    left out. The results are the same."""
    held = docs if isinstance(docs, Index) else index(docs, key, text)
    if held.blocks is None and (allowed is None or "query_id" not in allowed.columns):
        scores = bm25_best(queries, held, k, query_key, allowed)
    elif held.blocks is None:
        scores = bm25_scores(queries, held, query_key, allowed)
    else:
        wanted = reached_buckets(queries, held, k, query_key, allowed).where("needed").select("query_id", "bucket")
        scores = _of_buckets(_asked(queries, query_key), held, wanted, allowed)
    return ranked(scores, [F.round("score", 9).desc(), F.col("doc")]).where(F.col("rank") <= k)


def block_report(queries: DataFrame, held: Index, k: int = CANDIDATES, query_key: str = "query_id") -> DataFrame:
    """``query_id``, ``n_blocks`` that its terms have, ``n_read`` of them for its best ``k``."""
    needed = reached_buckets(queries, held, k, query_key).select("query_id", "bucket", "needed")
    rows = _asked(queries, query_key).join(held.blocks.select("term", "bucket"), "term").join(needed, ["query_id", "bucket"])
    return rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_blocks"), F.count(F.when(F.col("needed"), 1)).alias("n_read"))


def _holds_all(schema: pa.Schema) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def find(b: pa.RecordBatch, i: int) -> pa.RecordBatch:
        asked = _values(b, i, "asks")
        names = asked.field("query_id")
        words = asked.field("term").unique()
        first, n, _ = _found_of(b, i, words)
        docs, of, at = _values(b, i, "docs"), _ints(b, i, "of"), _ints(b, i, "at")
        query, of_query = _places(names)
        word = pc.index_in(asked.field("term"), words).to_numpy()
        order = np.lexsort((n[word], query))  # of each query, rare words first
        word, starts = word[order], np.searchsorted(query[order], np.arange(len(of_query) + 1))
        found = []
        for q in np.flatnonzero(n[word[starts[:-1]]]):  # the rarest is there
            texts = None
            for w in word[starts[q] : starts[q + 1]]:
                here = at[first[w] : first[w] + n[w]]
                texts = here if texts is None else texts[np.append(here, -1)[np.searchsorted(here, texts)] == texts]
                if not len(texts):
                    break
            found.append((np.full(len(texts), of_query[q]), of[texts]))
        at, row = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int))
        return pa.RecordBatch.from_arrays([names.take(pa.array(at)), docs.take(pa.array(row))], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                yield find(b, i)

    return run


def _with_all(passages: DataFrame, held: Index, query_key: str) -> DataFrame:
    """``query_id``, ``doc`` of documents with all tokens of a passage, by packed postings of whole documents."""
    asked = written(_asked(passages, query_key).select("query_id", "term"))
    met = held.packed.select("docs", "of", "terms", "df", "at").crossJoin(_in_blocks(asked, _n_blocks(asked)))
    kinds = {"query_id": asked.schema["query_id"].dataType, "doc": held.packed.schema["docs"].dataType.elementType}
    found = met.mapInArrow(_holds_all(pa.schema([(c, to_arrow_type(t)) for c, t in kinds.items()])), ", ".join(f"{c} {t.simpleString()}" for c, t in kinds.items()))
    return written(found)  # few, of known size


def holders(passages: DataFrame, docs: DataFrame, held: Index, key: str = "doc_id", query_key: str = "query_id") -> DataFrame:
    """``query_id``, ``doc`` of all documents that hold a passage's tokens in a row. Only documents with the passage's
    rarest token are looked at (all its tokens where postings are packed, of whole documents then); a passage without tokens
    is nowhere."""
    pairs = _with_all(passages, held, query_key) if held.packed is not None else _with_rarest(passages, held, query_key)
    norm = lambda c: F.concat(F.lit(" "), F.array_join(tokens(c), " "), F.lit(" "))
    # never null: else whether it is null is asked of all documents, before the others are left out
    text = F.coalesce(norm(F.col("text")), F.lit(""))
    texts = docs.select(F.col(key).alias("doc"), "text").join(pairs.select("doc").distinct(), "doc", "left_semi").select("doc", text.alias("_t"))
    both = pairs.join(texts, "doc").join(passages.select(F.col(query_key).alias("query_id"), norm(F.col("text")).alias("_p")), "query_id")
    return both.where(F.contains("_t", "_p")).select("query_id", "doc").distinct()


def _with_rarest(passages: DataFrame, held: Index, query_key: str) -> DataFrame:
    """``query_id``, ``doc`` of documents with a passage's rarest token."""
    asked = passages.select(F.col(query_key).alias("query_id"), F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).join(held.terms.select("term", "df"), "term", "left")
    rare = asked.groupBy("query_id").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), F.col("term").alias("term"))).alias("r")).select("query_id", "r.term")
    rare = written(rare)  # of known size, so that postings needn't move to it
    return held.postings.select("doc", "term").join(rare, "term").select("query_id", "doc")


def tag_filter(results: DataFrame, tags: DataFrame, wanted: dict[str, str], ids: DataFrame | None = None, doc: str = "doc") -> DataFrame:
    """Keeps results by an allow-list (``ids``, one column; an empty one keeps nothing) and by array tags. A document
    without tags passes only if an allow-list is given; without either filter all pass. ``tags``: ``doc`` and arrays."""
    wanted = {c: v for c, v in wanted.items() if v}
    if ids is not None:
        results = results.join(ids.select(F.col(ids.columns[0]).alias(doc)).distinct(), doc, "left_semi")
    if not wanted:
        return results
    last = tags.withColumn("_known", F.lit(True))
    joined = results.join(last, doc, "left")
    fits = F.lit(True)
    for column, value in wanted.items():
        fits = fits & F.coalesce(F.array_contains(column, value), F.lit(False))
    return joined.where(F.when(F.col("_known").isNull(), F.lit(ids is not None)).otherwise(fits)).select(*results.columns)


def fuse(*lists: DataFrame, k: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of ``query_id``, ``doc``, ``rank``: ties by the first list that holds a document, then by
    its rank there."""
    rows = None
    for i, part in enumerate(lists):
        one = part.select("query_id", "doc", (1.0 / (RRF_K + F.col("rank"))).alias("s"), F.struct(F.lit(i).alias("list"), F.col("rank").alias("rank")).alias("seen"))
        rows = one if rows is None else rows.unionByName(one)
    scores = rows.groupBy("query_id", "doc").agg(F.sum("s").alias("score"), F.min("seen").alias("seen"))
    out = ranked(scores, [F.round("score", 12).desc(), F.col("seen")]).drop("seen")
    return out.where(F.col("rank") <= k) if k else out


def rerank_standin(queries: DataFrame, results: DataFrame, docs: DataFrame, k: int, key: str = "doc_id", query_key: str = "query_id") -> DataFrame:
    """A lexical stand-in for a cross-encoder: the share of a query's distinct tokens that a text holds. Not comparable
    with any model's scores; its place in the plan (above the candidate limit) is what it is for."""
    results = written(results.select("query_id", "doc", "rank"))  # ranked once; of known size, so that other texts needn't move to it
    asked = queries.select(F.col(query_key).alias("query_id"), F.array_distinct(tokens(F.col("text"))).alias("_q"))
    held = docs.select(F.col(key).alias("doc"), "text").join(results.select("doc").distinct(), "doc", "left_semi")
    pairs = results.select("query_id", "doc", F.col("rank").alias("_before")).join(asked, "query_id").join(held, "doc")
    scored = pairs.withColumn("score", F.size(F.array_intersect("_q", tokens(F.col("text")))) / F.greatest(F.size("_q"), F.lit(1)))
    return ranked(scored, [F.col("score").desc(), F.col("_before")]).where(F.col("rank") <= k).select("query_id", "doc", "score", "rank")


RERANK_BATCH = 32


def rerank(queries: DataFrame, results: DataFrame, docs: DataFrame, make_model: Callable[[], Callable[[list[tuple[str, str]]], Iterable[float]]], k: int, key: str = "doc_id", query_key: str = "query_id", batch: int = RERANK_BATCH) -> DataFrame:
    """The best ``k`` of ``results`` by a model of pairs (a cross-encoder): ``query_id``, ``doc``, ``score``, ``rank``. The
    model is made once for each task, where it runs, and sees ``batch`` pairs of texts (null: empty) at a time; scores that
    are equal or no numbers leave the order as it was, the latter at the end."""
    results = written(results.select("query_id", "doc", "rank"))  # ranked once; of known size, so that other texts needn't move to it
    asked = queries.select(F.col(query_key).alias("query_id"), F.col("text").alias("_q"))
    held = docs.select(F.col(key).alias("doc"), F.col("text").alias("_d")).join(results.select("doc").distinct(), "doc", "left_semi")
    pairs = results.select("query_id", "doc", F.col("rank").alias("_before")).join(asked, "query_id").join(held, "doc").select("query_id", "doc", "_before", "_q", "_d")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for b in batches:
            for a in range(0, b.num_rows, batch):
                part = b.slice(a, batch)
                model = model or make_model()
                texts = [(x or "", y or "") for x, y in zip(part.column("_q").to_pylist(), part.column("_d").to_pylist(), strict=True)]
                scores = np.asarray(list(model(texts)), np.float64)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("query_id", "doc", "_before")), pa.array(np.where(np.isnan(scores), -np.inf, scores))], ["query_id", "doc", "_before", "score"])

    kinds = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in ("query_id", "doc", "_before"))
    scored = pairs.mapInArrow(run, f"{kinds}, score double")
    return ranked(scored, [F.col("score").desc(), F.col("_before")]).where(F.col("rank") <= k).select("query_id", "doc", "score", "rank")


def search(
    queries: DataFrame,
    docs: DataFrame,
    vectors: DataFrame | None = None,
    k: int = 5,
    tags: DataFrame | None = None,
    wanted: dict[str, str] | None = None,
    ids: DataFrame | None = None,
    rerank: bool = False,
    lexical: bool = True,
    filter_mode: str = "pre",
    held: Index | None = None,
    model: Callable[[], Callable[[list[tuple[str, str]]], Iterable[float]]] | None = None,
) -> DataFrame:
    """Hybrid search: 30 candidates of each kind, fused, optionally reranked (20), cut to ``k``. ``queries``:
    ``query_id``, ``text`` and, for vectors, ``embedding``; ``docs``: ``doc_id``, ``text``; ``vectors``: ``doc_id``,
    ``embedding``. ``filter_mode='post'`` filters the candidates, ``'pre'`` the documents before they are ranked (term statistics stay those of all documents).
    ``held``: the documents' index, if there is one; ``model``: what ``rerank`` takes, else the stand-in ranks."""
    if filter_mode not in ("pre", "post"):
        raise ValueError("filter_mode is 'pre' or 'post'")
    wanted = wanted or {}
    keep = (lambda rows: tag_filter(rows, tags, wanted, ids)) if wanted or ids is not None else (lambda rows: rows)
    if filter_mode == "pre" and (wanted or ids is not None):
        allowed = keep(docs.select(F.col("doc_id").alias("doc"))).distinct()
        only = lambda rows: rows.join(allowed.withColumnRenamed("doc", "doc_id"), "doc_id", "left_semi")
        post = lambda rows: rows
    else:
        allowed, only, post = None, (lambda rows: rows), keep

    def again(rows: DataFrame) -> DataFrame:  # ranks count after the filter
        return ranked(post(rows).drop("rank"), [F.round("score", 9).desc(), F.col("doc")])

    lists = []
    if vectors is not None:
        lists.append(again(dense(queries, only(vectors), CANDIDATES, "doc_id")))
    if lexical:
        lists.append(again(bm25(queries, held or docs, CANDIDATES, allowed=allowed)))
    fused = fuse(*lists) if len(lists) > 1 else lists[0]
    if rerank:
        best = fused.where(F.col("rank") <= RERANKED)
        return rerank(queries, best, docs, model, k) if model else rerank_standin(queries, best, docs, k)
    return fused.where(F.col("rank") <= k).select("query_id", "doc", "score", "rank")


def embed_standin(docs: DataFrame, dim: int = 64, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A hashed bag of words, normalised: a deterministic stand-in for an embedding model, not comparable with one."""
    counted = term_counts(docs, key, text).select("doc", F.pmod(F.xxhash64("term"), F.lit(dim)).cast("int").alias("at"), (F.col("tf") * F.when(F.pmod(F.xxhash64("term", F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0)).alias("v"))
    cells = counted.groupBy("doc", "at").agg(F.sum("v").alias("v"))
    packed = cells.groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("at", "v"))).alias("m"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    vector = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / F.when(F.col("norm") > 0, F.col("norm")).otherwise(1.0)).cast("float"))
    empty = docs.select(F.col(key).alias("doc")).join(packed.select("doc", vector.alias("embedding")), "doc", "left")
    return empty.select("doc", F.coalesce("embedding", F.array_repeat(F.lit(0.0).cast("float"), dim)).alias("embedding"))


#: What models expect before a query and before a passage.
PREFIXES = {
    "bge-large": {"query": "Represent this sentence for searching relevant passages: ", "passage": ""},
    "e5-large": {"query": "query: ", "passage": "passage: "},
}
EMBED_BATCH = 32


def embed(rows: DataFrame, make_model: Callable[[], Callable[[list[str]], np.ndarray]], key: str = "doc_id", text: str = "text", prefix: str = "", batch: int = EMBED_BATCH) -> DataFrame:
    """``doc``, ``embedding``: texts (null: empty) with ``prefix`` through a model, ``batch`` at a time, normalised. The
    model is made once for each task, where it runs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for b in batches:
            for a in range(0, b.num_rows, batch):
                part = b.slice(a, batch)
                model = model or make_model()
                v = np.asarray(model([prefix + (x or "") for x in part.column("text").to_pylist()]), np.float32)
                v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), np.float32(1e-12))
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(list(v), pa.list_(pa.float32()))], ["doc", "embedding"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key).alias("doc"), F.col(text).alias("text")).mapInArrow(run, f"doc {kind}, embedding array<float>")
