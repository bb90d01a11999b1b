"""Text functions as Column expressions: nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns and words that decide what is a heading, a caption or a table number.
NUMBERED = r"^(\d+(?:\.\d+)*)\.?\s+(\S.*)$"
BARE_NUMBER = r"^\d+(?:\.\d+)*\.?$"
LEADING_NUMBER = r"^\d+(\.\d+)*\.?\s+"
STAMP = r"^arXiv:\d{4}\.\d+"
TABLE_CAPTION = r"^\s*(TABLE|Table)\s+([IVXLCDM]+|\d+)\b"
FIGURE_CAPTION = r"^\s*(FIGURE|Figure|Fig\.?)\s+([IVXLCDM]+|\d+)\b"
TABLE_MENTION = r"\bTable\s+([IVXLCDM]+|\d+)\b"
SENTENCE_GAP = r"(?<=[.!?])\s+(?=[A-Z0-9])"
TOKEN_LETTERS = "a-z0-9"
SECTION_WORDS = (
    "abstract", "introduction", "related work", "literature review", "background",
    "data", "data description", "methodology", "method", "methods", "model",
    "empirical results", "results", "discussion", "conclusion", "conclusions",
    "references", "appendix", "acknowledgements", "acknowledgments",
    "robustness checks", "robustness", "limitations", "summary",
)
EXCLUDED_SECTIONS = ("references", "bibliography", "acknowledgements", "acknowledgments")


def let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once: inside a lambda a plain expression is computed for each element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space (of all Unicode) at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def tokens(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9; other letters part words. To split at what lies between costs a fifth of what it costs
    to extract matches; only a gap at either end leaves an empty string."""
    return F.array_remove(F.split(F.lower(text), f"[^{TOKEN_LETTERS}]+"), "")


def words(text: Column) -> Column:
    """Runs without white space: the default unit of length."""
    return F.array_remove(F.split(text, r"\s+"), "")


def count_words(text: Column) -> Column:
    return F.coalesce(F.size(words(text)), F.lit(0))


def normalize_title(title: Column) -> Column:
    """Without a leading section number, lower case, without colons at the end."""
    return F.regexp_replace(F.lower(strip(F.regexp_replace(title, LEADING_NUMBER, ""))), ":+$", "")


def split_sentences(text: Column) -> Column:
    """Cut at white space after ``.!?`` and before a capital or digit (ASCII)."""
    return F.filter(F.transform(F.split(strip(text), SENTENCE_GAP), strip), lambda s: s != "")


def hard_split(pieces: Column, size: int) -> Column:
    """An array cut into blocks of ``size`` elements."""
    return let(pieces, lambda p: F.when(F.size(p) > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.size(p) - 1, F.lit(0)), F.lit(size)), lambda i: F.slice(p, i + 1, size))).otherwise(F.array()))


def looks_like_prose(text: Column) -> Column:
    """No control characters and at most 15 % non-ASCII; an empty text passes."""
    odd = F.length(F.regexp_replace(text, r"[\x00-\x7f]", ""))
    return ~text.rlike(r"[\x00-\x1f]") & ((text == "") | (odd / F.greatest(F.length(text), F.lit(1)) <= 0.15))


def is_table_caption(text: Column) -> Column:
    return text.rlike(TABLE_CAPTION)


def is_figure_caption(text: Column) -> Column:
    return text.rlike(FIGURE_CAPTION)


def caption_kind(text: Column) -> Column:
    """``table``, ``figure`` or null."""
    return F.when(is_table_caption(text), "table").when(is_figure_caption(text), "figure")


def heading_level(text: Column, size: Column, bold: Column, body: Column) -> Column:
    """The level (1 to 3) of a line that is a heading, else null. The first rule that holds decides."""
    n, ratio = F.size(F.split(strip(text), r"(?U)\s+")), F.when(body != 0, size / body).otherwise(1.0)
    able = (strip(text) != "") & (n <= 15) & (F.length(text) <= 140) & looks_like_prose(text) & caption_kind(text).isNull()
    numbered = text.rlike(NUMBERED) & F.regexp_extract(text, NUMBERED, 2).rlike("[A-Za-z]{2,}") & (bold | (ratio >= 1.1))
    dots = F.length(F.regexp_replace(F.regexp_extract(text, NUMBERED, 1), r"[^.]", ""))
    keyword = normalize_title(text).isin(list(SECTION_WORDS)) & (bold | (ratio >= 1.05))
    return F.when(~able, None).when(numbered, F.least(dots + 1, F.lit(3))).when(keyword, 1).when(ratio >= 1.3, 1).when(bold & (ratio >= 0.95) & (ratio < 1.3), 2)


def table_mentions(text: Column) -> Column:
    """Distinct table numbers that a text mentions."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(TABLE_MENTION), F.lit(1)))


def row_to_line(row: Column) -> Column:
    """Cells with content, stripped, between bars."""
    return F.array_join(F.filter(F.transform(row, lambda c: strip(F.coalesce(c, F.lit("")))), lambda c: c != ""), " | ")


def table_to_text(caption: Column, rows: Column) -> Column:
    """Caption, an empty line, the rows that have content."""
    body = F.array_join(F.filter(F.transform(rows, row_to_line), lambda x: x != ""), "\n")
    head = strip(F.coalesce(caption, F.lit("")))
    return F.when(head == "", body).otherwise(strip(F.concat(head, F.lit("\n\n"), body)))


def short_id(url: Column) -> Column:
    """What follows the first ``/abs/``; the whole where there is none."""
    return F.when(F.instr(url, "/abs/") > 0, F.regexp_extract(url, r"(?s)^.*?/abs/(.*)$", 1)).otherwise(url)


def file_key(paper_id: Column) -> Column:
    """An identifier as a file name: without the ``arxiv:`` prefix, slashes as underscores."""
    return F.translate(F.regexp_replace(paper_id, "^arxiv:", ""), "/", "_")


def block_page(block_id: Column) -> Column:
    """The page (from 1) in a block's path such as ``/page/6/Table/4``."""
    return F.get(F.split(F.regexp_replace(block_id, "^/+|/+$", ""), "/"), F.lit(1)).try_cast("int") + 1


def html_level(html: Column) -> Column:
    """The level of the heading tag that a piece of HTML starts with, else 1."""
    found = F.regexp_extract(strip(F.coalesce(html, F.lit(""))), "^<h([1-6])", 1)
    return F.when(found == "", 1).otherwise(found.try_cast("int"))


def page_label(start: Column, end: Column) -> Column:
    return F.when(start == end, F.format_string("p%d", start)).otherwise(F.format_string("pp%d-%d", start, end))


def snippet(text: Column, size: int = 280) -> Column:
    return F.translate(F.substring(text, 1, size), "\n", " ")


def category_query(categories: Column, terms: Column) -> Column:
    """``cat:a OR cat:b``, with ``terms`` (if any) in a conjunction."""
    any_of = F.array_join(F.transform(categories, lambda c: F.concat(F.lit("cat:"), c)), " OR ")
    return F.when(F.coalesce(terms, F.lit("")) == "", any_of).otherwise(F.concat(F.lit("("), any_of, F.lit(") AND ("), terms, F.lit(")")))


def embed_text(title: Column, section: Column, text: Column) -> Column:
    none = F.lit("")
    return F.concat(F.coalesce(title, none), F.lit("\n"), F.coalesce(section, none), F.lit("\n\n"), F.coalesce(text, none))
