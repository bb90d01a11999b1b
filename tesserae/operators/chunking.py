"""Chunks of documents: greedy packs of sentences with overlap, table parts, fixed windows of tokens.

The unit of length is a pluggable ``count`` (a Column function; default: words). Packing is a fold whose resets depend on
what it carries, so it runs per document in Python over arrays of lengths; all else stays in the JVM.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.text import EXCLUDED_SECTIONS, count_words, hard_split, let, normalize_title, row_to_line, split_sentences, strip, table_to_text, words

MOST, OVERLAP, LEAST, TABLE_MOST = 800, 90, 10, 4000
WINDOW, STEP = 650, 560
#: Rows whose sizes and ranges Python holds at once.
AT_ONCE = 256
Count = Callable[[Column], Column]


# ---------------------------------------------------------------- packing


def pack(sizes: list[int], most: int = MOST, overlap: int = OVERLAP, mode: str = "strict") -> list[tuple[int, int]]:
    """Chunks as ranges of units. A chunk is closed before a unit that would exceed ``most``, and once it reaches it; the
    next one starts with the last units that together reach ``overlap``.

    ``compat`` keeps that to the letter: a seed is a whole number of units whatever their size, so a chunk may exceed
    ``most``, and a seed that the next unit doesn't fit is a chunk again. ``strict`` shortens the seed until the next unit
    fits: every chunk brings a new unit and exceeds ``most`` only if it is a lone unit."""
    if mode not in ("strict", "compat"):
        raise ValueError("mode is 'strict' or 'compat'")
    ends = [0, *accumulate(sizes)]
    out: list[tuple[int, int]] = []
    start, fresh = 0, False

    def seed(i: int) -> int:
        """Where the shortest suffix of units before ``i`` begins that reaches the overlap (at ``start`` at the least)."""
        at = bisect_right(ends, ends[i] - overlap, 0, i + 1) - 1
        return max(start, at, 0) if ends[i] - ends[start] > 0 else i

    for i, n in enumerate(sizes):
        if ends[i] > ends[start] and ends[i] - ends[start] + n > most:
            if fresh or mode == "compat":
                out.append((start, i))
                start = seed(i)
            while mode == "strict" and start < i and ends[i] - ends[start] + n > most:
                start += 1
        fresh = True
        if ends[i + 1] - ends[start] >= most:
            out.append((start, i + 1))
            start, fresh = seed(i + 1), False
            if mode == "strict" and start == out[-1][0]:
                start += 1
    if fresh and start < len(sizes):
        out.append((start, len(sizes)))
    return out


def pack_rows(sizes: list[int], budget: int) -> list[tuple[int, int]]:
    """Greedy batches without overlap; one row above the budget is a batch of its own."""
    out, start, total = [], 0, 0
    for i, n in enumerate(sizes):
        if total + n > budget and i > start:
            out.append((start, i))
            start, total = i, 0
        total += n
    return [*out, (start, len(sizes))] if start < len(sizes) else out


def _ranges(rows: DataFrame, sizes: str, fn: Callable[[list[int], dict], list[tuple[int, int]]], *needed: str) -> DataFrame:
    """Adds ``ranges``: what ``fn`` makes of each row's array of sizes, of ``AT_ONCE`` rows at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, AT_ONCE):
                b = whole.slice(at, AT_ONCE)
                others = [b.column(c).to_pylist() for c in needed]
                made = [[{"a": x, "b": y} for x, y in fn(s or [], *values)] for s, *values in zip(b.column(sizes).to_pylist(), *others, strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, kind)], [*b.schema.names, "ranges"])

    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{schema}, ranges array<struct<a:int,b:int>>")


def units_of(text: Column, most: int = MOST) -> Column:
    """Sentences; those of more than ``most`` words are cut into blocks of as many."""
    cut = lambda s: F.when(count_words(s) <= most, F.array(s)).otherwise(F.transform(hard_split(words(s), most), lambda p: F.array_join(p, " ")))
    return F.flatten(F.transform(split_sentences(text), cut))


def pack_texts(rows: DataFrame, text: str = "text", most: int = MOST, overlap: int = OVERLAP, mode: str = "strict", count: Count = count_words) -> DataFrame:
    """A row per chunk: the columns of ``rows`` without the text, ``pos``, ``token_count``, ``text``."""
    keep = [c for c in rows.columns if c != text]
    units = rows.select(*keep, units_of(F.col(text), most).alias("_units")).withColumn("_sizes", F.transform("_units", count))
    packed = _ranges(units, "_sizes", lambda sizes: pack(sizes, most, overlap, mode))
    chunks = packed.select(*keep, "_units", F.posexplode("ranges").alias("pos", "_r"))
    chunks = chunks.withColumn("text", F.array_join(F.slice("_units", F.col("_r.a") + 1, F.col("_r.b") - F.col("_r.a")), " "))
    return chunks.select(*keep, "pos", count(F.col("text")).alias("token_count"), "text")


# ---------------------------------------------------------------- parsed papers


def sections(papers: DataFrame) -> DataFrame:
    """Sections that count: with text, not references or thanks; ``sec_idx`` is their place in the paper."""
    rows = papers.select("paper_id", "title", F.posexplode("sections").alias("sec_idx", "s"))
    rows = rows.select("paper_id", "title", "sec_idx", F.col("s.title").alias("section_title"), normalize_title(F.col("s.title")).alias("_norm"), "s.page_start", "s.page_end", strip(F.coalesce("s.text", F.lit(""))).alias("text"))
    kept = rows.where(~F.col("_norm").isin(list(EXCLUDED_SECTIONS)) & (F.col("text") != ""))
    return kept.withColumn("chunk_type", F.when(F.col("_norm") == "abstract", "abstract").otherwise("text")).drop("_norm")


def _first_by_page(sections: Column) -> Column:
    """Where the first section in order changes, as structs of ``at`` (page) and ``title`` (null: none). A sweep over the
    pages where sections begin and end, with the set of those that are open."""
    spans = F.transform(sections, lambda x, i: F.struct(x["page_start"].alias("a"), x["page_end"].alias("b"), i.alias("i")))
    spans = F.filter(spans, lambda x: x["a"] <= x["b"])
    event = lambda at, opens, i: F.struct(at.cast("int").alias("at"), F.lit(opens).alias("opens"), i.alias("i"))
    events = F.array_sort(F.concat(F.transform(spans, lambda x: event(x["a"], 1, x["i"])), F.transform(spans, lambda x: event(x["b"] + 1, 0, x["i"]))))

    def step(s: Column, e: Column) -> Column:
        held = F.when(e["opens"] == 1, F.array_append(s["open"], e["i"])).otherwise(F.array_remove(s["open"], e["i"]))
        return let(held, lambda h: F.struct(h.alias("open"), F.array_append(s["cuts"], F.struct(e["at"].alias("at"), F.array_min(h).alias("i"))).alias("cuts")))

    start = F.struct(F.array().cast("array<int>").alias("open"), F.array().cast("array<struct<at:int,i:int>>").alias("cuts"))
    cuts = F.aggregate(events, start, step, lambda s: s["cuts"])
    return F.transform(cuts, lambda c: F.struct(c["at"].alias("at"), F.get(sections, c["i"])["title"].alias("title")))


def enclosing_section(pages: DataFrame, papers: DataFrame) -> DataFrame:
    """``pages`` (``paper_id``, ``page``, more) with ``section_title``: the first section in order that holds the page,
    else ``Unknown``. Papers come once each. Pages and the places where the section changes go through one sort a paper."""
    row = F.struct(*(F.col(f"`{c}`") for c in pages.columns))
    asks = pages.select("paper_id", F.col("page").cast("int").alias("_at"), row.alias("_row"), F.lit(None).cast("struct<title:string>").alias("_cut"), F.lit(None).cast("int").alias("_k"))
    cuts = papers.where("paper_id is not null").select("paper_id", F.posexplode(_first_by_page(F.col("sections"))).alias("_k", "c"))
    none = F.lit(None).cast(pages.select(row.alias("r")).schema["r"].dataType)
    cuts = cuts.select("paper_id", F.col("c.at").alias("_at"), none.alias("_row"), F.struct(F.col("c.title").alias("title")).alias("_cut"), "_k")
    # on one page, changes stand before what asks, and the last of them counts
    upto = Window.partitionBy("paper_id").orderBy("_at", F.col("_row").isNotNull(), "_k").rowsBetween(Window.unboundedPreceding, 0)
    met = asks.unionByName(cuts).withColumn("_cut", F.last("_cut", ignorenulls=True).over(upto)).where("_row is not null")
    return met.select("_row.*", F.coalesce("_cut.title", F.lit("Unknown")).alias("section_title"))


def tables(papers: DataFrame, most: int = TABLE_MOST, count: Count = count_words) -> DataFrame:
    """Tables as texts, in batches of rows under ``most`` with the caption on each."""
    rows = papers.select("paper_id", "title", F.posexplode("tables").alias("_i", "t")).select("paper_id", "title", "_i", "t.table_id", "t.page", strip(F.coalesce("t.caption", F.lit(""))).alias("caption"), F.col("t.rows").alias("rows"))
    rows = rows.withColumn("_full", table_to_text(F.col("caption"), F.col("rows"))).withColumn("_lines", F.filter(F.transform("rows", row_to_line), lambda x: x != ""))
    rows = rows.withColumn("_sizes", F.transform("_lines", count)).withColumn("_budget", F.when(count(F.col("_full")) <= most, F.lit(2**31 - 1)).otherwise(F.lit(most) - count(F.col("caption")))).drop("rows")
    packed = _ranges(rows, "_sizes", lambda sizes, budget: pack_rows(sizes, budget) if sizes else [], "_budget")
    whole = F.col("_budget") == 2**31 - 1
    ranges = F.when(whole, F.when(F.col("_full") == "", F.array().cast("array<struct<a:int,b:int>>")).otherwise(F.array(F.struct(F.lit(0).cast("int").alias("a"), F.size("_lines").alias("b"))))).otherwise(F.col("ranges"))
    parts = packed.withColumn("ranges", ranges).withColumn("_n", F.size("ranges")).select("*", F.posexplode("ranges").alias("part", "_r"))
    body = F.array_join(F.slice("_lines", F.col("_r.a") + 1, F.col("_r.b") - F.col("_r.a")), "\n")
    text = F.when(whole, F.col("_full")).otherwise(strip(F.concat("caption", F.lit("\n\n"), body)))
    chunk = F.concat("paper_id", F.lit("::table::"), F.translate("table_id", "/", "_"), F.when(F.col("_n") > 1, F.concat(F.lit("::part"), F.col("part").cast("string"))).otherwise(""))
    return parts.select(chunk.alias("chunk_id"), "paper_id", "title", "page", text.alias("text"))


def chunk_papers(papers: DataFrame, mode: str = "strict", least: int = LEAST, count: Count = count_words) -> DataFrame:
    """Section and table chunks of parsed papers (schema ``CHUNKS``). Text chunks under ``least`` are dropped and don't
    count in the numbering; table chunks are kept."""
    packed = pack_texts(sections(papers), mode=mode, count=count).where(F.col("token_count") >= least)
    dense = F.row_number().over(Window.partitionBy("paper_id", "sec_idx").orderBy("pos")) - 1
    text = packed.withColumn("_k", dense).select(
        F.format_string("%s::sec%d::chunk%d", "paper_id", "sec_idx", "_k").alias("chunk_id"), "paper_id", "title", "section_title", "chunk_type", "page_start", "page_end", F.col("token_count").cast("int").alias("token_count"), "text"
    )
    found = enclosing_section(tables(papers, count=count), papers)
    table = found.select("chunk_id", "paper_id", "title", "section_title", F.lit("table").alias("chunk_type"), F.col("page").alias("page_start"), F.col("page").alias("page_end"), count(F.col("text")).cast("int").alias("token_count"), "text")
    return text.unionByName(table)


# ---------------------------------------------------------------- fixed windows


def windows(n: Column, window: int = WINDOW, step: int = STEP) -> Column:
    """Starts of sliding windows over ``n`` tokens: none for no tokens, the last is the first that reaches the end."""
    last = F.greatest(F.lit(0), F.ceil((n - window) / step).cast("int")) * step
    return F.when(n > 0, F.sequence(F.lit(0), last, F.lit(step))).otherwise(F.array().cast("array<int>"))


def paged_tokens(papers: DataFrame, tokens: Callable[[Column], Column] = words) -> DataFrame:
    """``tokens``: all tokens of a paper's pages in order, as structs of token and page."""
    tagged = F.flatten(F.transform("pages", lambda p: F.transform(tokens(F.coalesce(p["text"], F.lit(""))), lambda t: F.struct(t.alias("t"), p["page_number"].alias("page")))))
    return papers.select("paper_id", "title", tagged.alias("tokens"))


def fixed_chunks(papers: DataFrame, window: int = WINDOW, step: int = STEP, tokens: Callable[[Column], Column] = words) -> DataFrame:
    """Chunks of ``window`` tokens, ``step`` apart (schema ``CHUNKS``)."""
    pages = F.transform("pages", lambda p: F.struct(tokens(F.coalesce(p["text"], F.lit(""))).alias("t"), p["page_number"].alias("page")))
    flat = papers.select("paper_id", "title", pages.alias("_p"))
    # tokens and their pages lie side by side; nothing is computed for single tokens
    flat = flat.select("paper_id", "title", F.flatten("_p.t").alias("_t"), F.flatten(F.transform("_p", lambda p: F.array_repeat(p["page"], F.size(p["t"])))).alias("_g"))
    part = lambda c, i: F.slice(c, i + 1, F.lit(window))
    made = lambda i: F.struct(F.array_min(part("_g", i)).alias("a"), F.array_max(part("_g", i)).alias("b"), F.size(part("_t", i)).alias("n"), F.array_join(part("_t", i), " ").alias("text"))
    parts = flat.select("paper_id", "title", F.posexplode(F.transform(windows(F.size("_t"), window, step), made)).alias("k", "w"))
    out = parts.select(F.format_string("%s::fixed::chunk%d", "paper_id", "k").alias("chunk_id"), "paper_id", "title", F.lit("N/A (fixed-size chunk)").alias("section_title"), F.lit("text").alias("chunk_type"), F.col("w.a").alias("page_start"), F.col("w.b").alias("page_end"), F.col("w.n").alias("token_count"), "w.text")
    return out


def paper_text(papers: DataFrame, most: int = 250_000) -> DataFrame:
    """``paper_id``, ``source``: title, sections and tables as one text, cut after ``most`` words."""
    keep = F.filter("sections", lambda s: ~normalize_title(s["title"]).isin(list(EXCLUDED_SECTIONS)) & (strip(F.coalesce(s["text"], F.lit(""))) != ""))
    body = F.transform(keep, lambda s: F.concat(F.lit("## "), s["title"], F.lit("\n"), strip(s["text"])))
    shown = F.transform("tables", lambda t: F.struct(strip(table_to_text(t["caption"], t["rows"])).alias("x"), F.concat(F.lit("## Table "), F.coalesce(t["table_id"], F.lit("")), F.lit(" (page "), F.coalesce(t["page"].cast("string"), F.lit("?")), F.lit(")\n")).alias("h")))
    listed = F.transform(F.filter(shown, lambda t: t["x"] != ""), lambda t: F.concat(t["h"], t["x"]))
    empty = F.array().cast("array<string>")
    full = F.array_join(F.concat(F.array(F.concat(F.lit("Title: "), F.coalesce("title", F.lit("")))), F.coalesce(body, empty), F.coalesce(listed, empty)), "\n\n")
    return papers.select("paper_id", let(full, lambda x: F.when(count_words(x) <= most, x).otherwise(F.array_join(F.slice(words(x), 1, most), " "))).alias("source"))


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """Number and lengths of chunks by type, and of all (type null); zeros where there are none."""
    figures = [F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("token_count"), F.lit(0.0)).alias("mean"), F.coalesce(F.min("token_count"), F.lit(0)).alias("least"), F.coalesce(F.max("token_count"), F.lit(0)).alias("most")]
    return chunks.groupBy("chunk_type").agg(*figures).unionByName(chunks.agg(*figures).select(F.lit(None).cast("string").alias("chunk_type"), "n", "mean", "least", "most"))
