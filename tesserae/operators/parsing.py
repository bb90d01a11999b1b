"""From lines and HTML blocks to sections, tables and diagnostics.

``lines``: ``paper_id, page, pos, text, size, bold, bbox``. Order is data: everything is ordered by page and position.
Merges that consume lines are folds over a page's lines; headings, sections and captions are windows and joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from tesserae.functions import text as T
from tesserae.sources.scratch import written

BOLD_FLAG = 16
CAPTION_WINDOW = 120.0
DENSE_HEADINGS = 3.5
CONTENT_BLOCKS = ("Text", "ListGroup", "Footnote", "Equation", "Caption")


def lines_from_spans(spans: DataFrame) -> DataFrame:
    """Spans (``paper_id, page, line, pos, text, size, flags, bbox``) to lines: texts joined and stripped, the largest
    size, bold if any span is. Empty lines and repository stamps go."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "")
    rows = spans.groupBy("paper_id", "page", "line").agg(T.strip(joined).alias("text"), F.max("size").alias("size"), F.max(F.col("flags").bitwiseAND(BOLD_FLAG) != 0).alias("bold"), F.min_by("bbox", "pos").alias("bbox"))
    return rows.where((F.col("text") != "") & ~F.col("text").rlike(T.STAMP)).select("paper_id", "page", F.col("line").alias("pos"), "text", "size", "bold", "bbox")


# ---------------------------------------------------------------- merges within a page


def _fold(rows: Column, step: Callable[[Column, Column], Column], **state: Column) -> Column:
    """``out`` of a fold over the ordered lines of a page: ``step`` gets what was kept so far (``out``, and ``state``) and a
    line with the next one (``x``, ``y``)."""
    pairs = F.transform(rows, lambda x, i: F.struct(x.alias("x"), F.get(rows, i + 1).alias("y")))
    start = F.struct(F.slice(rows, 1, 0).alias("out"), *(v.alias(k) for k, v in state.items()))
    return F.aggregate(pairs, start, step, lambda s: s["out"])


def _line(pos: Column, text: Column, size: Column, bold: Column, bbox: Column) -> Column:
    return F.struct(pos.alias("pos"), text.alias("text"), size.alias("size"), bold.alias("bold"), bbox.alias("bbox"))


def join_numbers(rows: Column) -> Column:
    """A bare section number (bold, or larger than what follows) takes the next line, if that has at most ten words."""

    def step(s: Column, p: Column) -> Column:
        x, y = p["x"], p["y"]
        takes = F.coalesce(y.isNotNull() & x["text"].rlike(T.BARE_NUMBER) & (x["bold"] | (x["size"] > y["size"])) & (T.count_words(y["text"]) <= 10), F.lit(False))
        joined = _line(x["pos"], F.concat_ws(" ", x["text"], y["text"]), F.greatest(x["size"], y["size"]), x["bold"] | y["bold"], y["bbox"])
        kept = lambda out, skip: F.struct(out.alias("out"), F.lit(skip).alias("skip"))
        return F.when(s["skip"], kept(s["out"], False)).when(takes, kept(F.array_append(s["out"], joined), True)).otherwise(kept(F.array_append(s["out"], x), False))

    return _fold(rows, step, skip=F.lit(False))


def join_captions(rows: Column) -> Column:
    """A caption takes the lines that go on in its type (bold, size within 0.5), up to a numbered heading or a line of
    more than thirty words. Captions of figures go."""

    def step(s: Column, p: Column) -> Column:
        x, head = p["x"], s["head"]
        alike = x["bold"].eqNullSafe(head["bold"]) & (F.abs(x["size"] - head["size"]) < 0.5)
        goes_on = F.coalesce(head.isNotNull() & alike & ~x["text"].rlike(T.NUMBERED) & (T.count_words(x["text"]) <= 30), F.lit(False))
        longer = _line(head["pos"], F.concat_ws(" ", head["text"], x["text"]), head["size"], head["bold"], head["bbox"])
        kept = lambda out, top, shown: F.struct(out.alias("out"), top.alias("head"), F.lit(shown).alias("shown"))
        replaced = F.array_append(F.slice(s["out"], 1, F.size(s["out"]) - 1), longer)
        return (
            F.when(goes_on & s["shown"], kept(replaced, longer, True))
            .when(goes_on, kept(s["out"], longer, False))
            .when(x["text"].rlike(T.FIGURE_CAPTION), kept(s["out"], x, False))
            .when(x["text"].rlike(T.TABLE_CAPTION), kept(F.array_append(s["out"], x), x, True))
            .otherwise(kept(F.array_append(s["out"], x), F.get(F.slice(rows, 1, 0), F.lit(0)), False))
        )

    return _fold(rows, step, head=F.get(F.slice(rows, 1, 0), F.lit(0)), shown=F.lit(False))


def merge_lines(lines: DataFrame, *steps: Callable[[Column], Column]) -> DataFrame:
    """The steps (default: numbers, then captions) on the lines of each page, which are one row's array."""
    held = F.array_sort(F.collect_list(_line(*(F.col(c) for c in ("pos", "text", "size", "bold", "bbox")))))
    pages = lines.groupBy("paper_id", "page").agg(held.alias("_l"))
    for step in steps or (join_numbers, join_captions):
        pages = pages.withColumn("_l", step(F.col("_l")))
    return pages.select("paper_id", "page", F.explode("_l").alias("_x")).select("paper_id", "page", "_x.*")


# ---------------------------------------------------------------- headings and sections


def body_size(lines: DataFrame, key: str = "paper_id") -> DataFrame:
    """``key`` and ``body``: the half-point size (half to even) that most characters have; the first seen of equals."""
    weight = lines.withColumn("_s", F.bround(F.col("size") * 2) / 2).groupBy(key, "_s").agg(F.sum(F.length("text")).alias("w"), F.min(F.struct("page", "pos")).alias("first"))
    best = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("w"), "first"))
    return weight.withColumn("_r", best).where("_r = 1").select(key, F.col("_s").alias("body"))


def headings(lines: DataFrame) -> DataFrame:
    """``lines`` with ``level`` (null: no heading)."""
    rows = lines.join(body_size(lines), "paper_id", "left").withColumn("body", F.coalesce("body", F.lit(10.0)))
    return rows.withColumn("level", T.heading_level(F.col("text"), F.col("size"), F.col("bold"), F.col("body"))).drop("body")


def sectionize(rows: DataFrame) -> DataFrame:
    """Sections of ordered rows (``paper_id, page, pos, text, level``): a row with a level opens one; rows before the
    first belong to ``Front Matter``. A section ends on the page of its last text row; without text it is kept empty."""
    ordered = Window.partitionBy("paper_id").orderBy("page", "pos")
    seg = rows.withColumn("_seg", F.sum(F.when(F.col("level").isNotNull(), 1).otherwise(0)).over(ordered))
    head, body = F.col("level").isNotNull(), F.col("level").isNull()
    text = T.strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(body, F.struct("page", "pos", "text")))), lambda x: x["text"]), " "))
    out = seg.groupBy("paper_id", "_seg").agg(F.max(F.when(head, F.col("text"))).alias("title"), F.max("level").alias("level"), F.min("page").alias("page_start"), F.coalesce(F.max(F.when(body, F.col("page"))), F.min("page")).alias("page_end"), text.alias("text"))
    idx = F.row_number().over(Window.partitionBy("paper_id").orderBy("_seg")) - 1
    return out.select("paper_id", idx.alias("sec_idx"), F.coalesce("title", F.lit("Front Matter")).alias("title"), F.coalesce("level", F.lit(0)).alias("level"), "page_start", "page_end", "text")


# ---------------------------------------------------------------- tables


def nearest(left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str], right_span: tuple[str, str], window: float = CAPTION_WINDOW, order: str = "pos") -> DataFrame:
    """For each left row (``row_id``) the right row of the same keys with the smallest gap between their spans, less than
    ``window``; overlapping ones don't count; the first in ``order`` of equals: ``row_id``, ``near``, ``gap``.

    An as-of join: the nearest before a span is the last that ends at its start or before, the nearest after it the first
    that starts at its end or later. Both sides go through one sort for each direction; no pairs are formed."""
    held = F.struct(*(F.col(c).alias(c) for c in right.columns))
    none = F.lit(None).cast(right.select(held.alias("r")).schema["r"].dataType)

    def side(before: bool) -> DataFrame:
        mine, other = (left_span[0], right_span[1]) if before else (left_span[1], right_span[0])
        asks = left.select(*keys, "row_id", F.col(mine).cast("double").alias("_at"), none.alias("_r"), F.lit(None).cast("double").alias("_o"))
        gives = right.select(*keys, F.lit(None).cast(left.schema["row_id"].dataType).alias("row_id"), F.col(other).cast("double").alias("_at"), held.alias("_r"), F.col(order).cast("double").alias("_o"))
        # at one place what is given stands before what asks, and of equals the first in order stands nearest
        way = F.col("_at").asc() if before else F.col("_at").desc()
        w = Window.partitionBy(*keys).orderBy(way, F.col("row_id").isNotNull(), F.col("_o").desc()).rowsBetween(Window.unboundedPreceding, 0)
        both = asks.unionByName(gives.where(F.col("_at").isNotNull()))
        met = both.withColumn("_near", F.last(F.when(F.col("row_id").isNull(), F.struct("_at", "_r")), ignorenulls=True).over(w))
        return met.where("row_id is not null and _near is not null").select("row_id", F.col("_near._r").alias("near"), F.abs(F.col("_at") - F.col("_near._at")).alias("gap"))

    met = side(True).unionByName(side(False)).where(F.col("gap") < window)
    return met.groupBy("row_id").agg(F.min_by("near", F.struct("gap", F.col(f"near.{order}"))).alias("near"), F.min("gap").alias("gap"))


def split_tables(candidates: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates (``paper_id, page, idx, bbox, rows``) whose nearest caption is a table's, and the rejected ones with a
    reason."""
    tables = candidates.withColumn("row_id", F.concat_ws("/", "paper_id", "page", "idx")).withColumn("_y0", F.get("bbox", F.lit(1))).withColumn("_y1", F.get("bbox", F.lit(3)))
    captions = lines.withColumn("kind", T.caption_kind(F.col("text"))).where("kind is not null").select("paper_id", "page", "pos", "text", "kind", F.get("bbox", F.lit(1)).alias("y0"), F.get("bbox", F.lit(3)).alias("y1"))
    near = nearest(tables, captions, ["paper_id", "page"], ("_y0", "_y1"), ("y0", "y1"))
    rows = tables.join(near, "row_id", "left").drop("_y0", "_y1", "row_id")
    kept = rows.where("near.kind = 'table'").select("paper_id", "page", F.format_string("p%d_t%d", "page", F.col("idx") + 1).alias("table_id"), F.col("near.text").alias("caption"), "bbox", "rows")
    why = F.when(F.col("near.kind") == "figure", F.concat(F.lit("beside a figure: "), F.col("near.text"))).otherwise("no caption within reach")
    rejected = rows.where("near is null or near.kind = 'figure'").select("paper_id", "page", "bbox", why.alias("reason"))
    return kept, rejected


def diagnostics(pages: DataFrame, sections: DataFrame, tables: DataFrame) -> DataFrame:
    """Per paper: headings a page, table numbers mentioned and captured, and whether another parser should try."""
    per = pages.groupBy("paper_id").agg(F.count(F.lit(1)).alias("num_pages"), F.array_distinct(F.flatten(F.collect_list(T.table_mentions(F.col("text"))))).alias("_m"))
    heads = sections.where("level > 0").groupBy("paper_id").agg(F.count(F.lit(1)).alias("num_headings_detected"))
    got = tables.groupBy("paper_id").agg(F.count(F.lit(1)).alias("captured_table_count"), F.array_remove(F.collect_set(F.regexp_extract("caption", T.TABLE_CAPTION, 2)), "").alias("_c"))
    rows = per.join(heads, "paper_id", "left").join(got, "paper_id", "left").na.fill(0, ["num_headings_detected", "captured_table_count"])
    density = F.col("num_headings_detected") / F.col("num_pages")
    garbled = F.size("_m") > F.size(F.coalesce("_c", F.array().cast("array<string>")))
    return rows.select("paper_id", "num_pages", "num_headings_detected", F.round(density, 2).alias("heading_density_per_page"), F.size("_m").alias("mentioned_table_count"), "captured_table_count", garbled.alias("tables_garbled"), (density > DENSE_HEADINGS).alias("headings_garbled"), (garbled | (density > DENSE_HEADINGS)).alias("needs_fallback_parser"))


# ---------------------------------------------------------------- HTML blocks


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts, self.rows, self.cells, self.hidden = [], [], [], 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th") and self.rows:
            self.cells.append([])
            self.rows[-1].append(self.cells[-1])

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag in ("td", "th") and self.cells:
            self.cells.pop()

    def handle_data(self, data):
        if data.strip() and not self.hidden:
            self.parts.append(data.strip())
            for cell in self.cells:
                cell.append(data.strip())


def _parsed(html: str | None) -> _Text:
    parser = _Text()
    parser.feed(html or "")
    parser.close()
    return parser


def plain_text(html: str | None) -> str:
    """Text nodes, stripped, with a space between; scripts and styles are left out."""
    return " ".join(_parsed(html).parts)


def table_rows(html: str | None) -> list[list[str]]:
    """The cells of each row."""
    return [["".join(c) for c in row] for row in _parsed(html).rows]


@F.pandas_udf(StringType())
def html_text(html: pd.Series) -> pd.Series:
    return html.map(plain_text)


@F.pandas_udf(ArrayType(ArrayType(StringType())))
def html_rows(html: pd.Series) -> pd.Series:
    return html.map(table_rows)


def walk(node: dict) -> list[dict]:
    """A block tree in pre-order: ``ord``, ``parent`` (its ord), ``idx`` (place among siblings), type, id, html."""
    out, stack = [], [(node, -1, 0)]
    while stack:
        block, parent, idx = stack.pop()
        me = len(out)
        out.append({"ord": me, "parent": parent, "idx": idx, "block_type": block.get("block_type"), "id": block.get("id"), "html": block.get("html") or ""})
        stack.extend((child, me, i) for i, child in reversed(list(enumerate(block.get("children") or []))))
    return out


BLOCKS = ArrayType(StructType([StructField(c, IntegerType()) for c in ("ord", "parent", "idx")] + [StructField(c, StringType()) for c in ("block_type", "id", "html")]))


@F.pandas_udf(BLOCKS)
def blocks_of(tree: pd.Series) -> pd.Series:
    """JSON trees to flat blocks."""
    import json

    return tree.map(lambda x: walk(json.loads(x)) if x else [])


#: Rounds of ``preorder``: each doubles the depth that is resolved.
ROUNDS = 24


def preorder(edges: DataFrame) -> DataFrame:
    """Trees kept as edges (``tree``, ``node``, ``parent``, ``idx`` among its siblings) in pre-order: ``tree``, ``node``,
    ``ord`` from 0, ``depth`` from 0. A node without parent, or whose parent isn't there, is a root.

    Each round a node takes over what is known of the way to its nearest unresolved ancestor, so a tree of any depth takes as
    many joins as its depth has binary digits; ways compare as arrays, parents before children. A circle is an error."""
    rows = edges.select("tree", "node", F.col("parent").alias("up"), F.array(F.coalesce("idx", F.lit(0))).alias("way"))
    for _ in range(ROUNDS):
        above = rows.select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("way").alias("way2"))
        rows = written(rows.join(above, ["tree", "up"], "left").select("tree", "node", F.col("up2").alias("up"), F.coalesce(F.concat("way2", "way"), F.col("way")).alias("way")))
        if rows.where("up is not null").isEmpty():
            break
    else:
        raise ValueError("a circle in the edges")
    order = Window.partitionBy("tree").orderBy("way", "node")
    return rows.select("tree", "node", (F.row_number().over(order) - 1).alias("ord"), (F.size("way") - 1).alias("depth"))


#: Tags that hold blocks and are always closed.
BLOCK_TAGS = ("html", "head", "body", "nav", "ul", "li", "a", "article", "div")


def tag_edges(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """The tree of ``BLOCK_TAGS`` of each page as edges: ``tree``, ``node`` (place among the tags), ``parent``, ``idx``,
    ``tag``. Depths are running sums of opening and closing tags; a tag's parent is the last one before it that opened a level
    above."""
    found = F.regexp_extract_all(F.lower(html), F.lit(rf"</?(?:{'|'.join(BLOCK_TAGS)})\b"), F.lit(0))
    tags = pages.select(F.col(key).alias("tree"), F.posexplode(found).alias("node", "t"))
    opens = ~F.startswith("t", F.lit("</"))
    depth = F.sum(F.when(opens, 1).otherwise(-1)).over(Window.partitionBy("tree").orderBy("node"))
    nodes = tags.withColumn("depth", depth).where(opens).select("tree", "node", "depth", F.substring("t", 2, 99).alias("tag"))
    # an opening tag asks for a parent on the level above and is one for the level below
    roles = nodes.withColumn("asks", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("level", F.col("depth") - F.col("asks").cast("int"))
    before = Window.partitionBy("tree", "level").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    asked = roles.withColumn("parent", F.last(F.when(~F.col("asks"), F.col("node")), ignorenulls=True).over(before)).where("asks")
    idx = F.row_number().over(Window.partitionBy("tree", "parent").orderBy("node")) - 1
    return asked.select("tree", "node", "parent", idx.alias("idx"), "tag")


def block_tables(blocks: DataFrame) -> DataFrame:
    """Tables of flat blocks (``paper_id, ord, parent, idx, block_type, id, html``) with the caption that stands before
    them, else the one after."""
    siblings = Window.partitionBy("paper_id", "parent").orderBy("idx")
    caption = lambda f: F.when(f("block_type").over(siblings) == "Caption", f("html").over(siblings))
    rows = blocks.withColumn("_c", F.coalesce(caption(F.lag), caption(F.lead))).where("block_type = 'Table'")
    return rows.select("paper_id", "ord", F.col("id").alias("table_id"), T.block_page(F.col("id")).alias("page"), html_text(F.coalesce("_c", F.lit(""))).alias("caption"), "html", html_rows("html").alias("rows"))


def block_sections(blocks: DataFrame) -> DataFrame:
    """Sections of flat blocks. Section headers open them; content blocks give text; others, and empty ones, nothing.
    Blocks inside a table group are visited like all others."""
    page = F.last(F.when(F.col("block_type") == "Page", T.block_page(F.col("id"))), ignorenulls=True).over(Window.partitionBy("paper_id").orderBy("ord"))
    rows = blocks.withColumn("page", page).where(F.col("page").isNotNull() & F.col("block_type").isin("SectionHeader", *CONTENT_BLOCKS)).withColumn("text", html_text("html")).where("text <> ''")
    return sectionize(rows.select("paper_id", "page", F.col("ord").alias("pos"), "text", F.when(F.col("block_type") == "SectionHeader", T.html_level(F.col("html"))).alias("level")))


def parse_files(files: DataFrame, parser: Callable[[bytes], dict], schema: str) -> DataFrame:
    """``files`` (``path``, ``content``) through a pluggable parser, made once per task; a failure is a row with ``error``
    and does not stop the run."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows.append((path, parser(content), None))
                except Exception as e:  # noqa: BLE001 - one bad file is a row, not the end
                    rows.append((path, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "parsed", "error"])

    return files.select("path", "content").mapInPandas(run, f"path string, parsed struct<{schema}>, error string")


