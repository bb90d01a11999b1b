"""Parsing, chunking, source and incremental queries. Lines of a document are its pages, turns of a conversation its
lines, and a user's turn opens a section."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import text as T
from tesserae.operators import answer, chunking, incremental, parsing
from tesserae.plans.tables import table
from tesserae.sources import files


def _papers(spark: SparkSession, d: str) -> DataFrame:
    """Documents as parsed papers: a page per line, a section per two lines, and all lines as the rows of a table."""
    docs = table(spark, d, "documents")
    lines = F.split("text", "\n", -1)
    pages = F.transform(lines, lambda x, i: F.struct((i + 1).alias("page_number"), x.alias("text")))
    title = lambda i: F.when(i == 0, "Abstract").when(i == 6, "7. References").otherwise(F.concat(F.lit("1.2 Part "), i.cast("string")))
    pairs = F.transform(lines, lambda x, i: F.struct(i.alias("i"), F.concat_ws(" ", x, F.get(lines, i + 1)).alias("x")))
    parts = F.transform(F.filter(pairs, lambda r: r["i"] % 2 == 0), lambda r: F.struct(title(r["i"]).alias("title"), F.lit(1).alias("level"), (r["i"] + 1).alias("page_start"), (r["i"] + 2).alias("page_end"), r["x"].alias("text")))
    rows = F.transform(lines, lambda x: F.transform(F.split(x, " "), lambda c: F.nullif(c, F.lit("the"))))
    tables = F.array(F.struct(F.lit("p2/t1").alias("table_id"), F.lit(2).alias("page"), F.concat(F.lit(" Table 1 of "), F.col("source")).alias("caption"), F.lit(None).cast("array<double>").alias("bbox"), F.lit(None).cast("string").alias("html"), rows.alias("rows")))
    return docs.select(F.col("doc_id"), F.concat(F.lit("arxiv:"), F.col("doc_id").cast("string")).alias("paper_id"), F.col("lang").alias("title"), pages.alias("pages"), parts.alias("sections"), tables.alias("tables"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Turns as lines with a type derived from their text."""
    c = table(spark, d, "conversations")
    n = F.length("text")
    y = F.col("turn") * 40.0
    text = F.when(F.col("role") == "system", F.concat(F.lit("Table "), F.col("turn").cast("string"), F.lit(" x"))).when(n % 5 == 0, F.concat((n % 4 + 1).cast("string"), F.lit(".2 Methods"))).when(n % 5 == 1, F.lit("Results:")).otherwise(F.translate("text", "\n", " "))
    return c.select(F.col("conv_id").cast("string").alias("paper_id"), (F.col("turn") / 4).cast("int").alias("page"), F.col("turn").cast("int").alias("pos"), text.alias("text"), ((n % 9) / 4 + 9).alias("size"), (n % 3 == 0).alias("bold"), F.array(F.lit(0.0), y, F.lit(10.0), y + 10).alias("bbox"))


LINES = """
ln AS (SELECT conv_id::VARCHAR AS paper_id, (turn // 4)::INT AS page, turn::INT AS pos, CASE WHEN role = 'system' THEN 'Table ' || turn || ' x'
    WHEN length(text) % 5 = 0 THEN (length(text) % 4 + 1) || '.2 Methods' WHEN length(text) % 5 = 1 THEN 'Results:' ELSE replace(text, chr(10), ' ') END AS text,
  (length(text) % 9) / 4.0::DOUBLE + 9 AS size, length(text) % 3 = 0 AS bold FROM conversations),
w AS (SELECT paper_id, round_even(size * 2, 0) / 2 AS s, sum(length(text)) AS w, min(pos) AS first FROM ln GROUP BY ALL),
body AS (SELECT paper_id, s AS body FROM w QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY w DESC, first) = 1),
hd AS (SELECT ln.*, CASE WHEN trim(text) = '' OR len(regexp_split_to_array(trim(text), '\\s+')) > 15 OR length(text) > 140 OR regexp_matches(text, '^\\s*(TABLE|Table)\\s+([IVXLCDM]+|\\d+)\\b')
      OR length(regexp_replace(text, '[\\x00-\\x7f]', '', 'g')) / greatest(length(text), 1) > 0.15 THEN NULL
    WHEN regexp_matches(text, '^(\\d+(?:\\.\\d+)*)\\.?\\s+(\\S.*)$') AND regexp_matches(text, '[A-Za-z]{2,}') AND (bold OR size / body >= 1.1)
      THEN least(3, length(regexp_replace(regexp_extract(text, '^(\\d+(?:\\.\\d+)*)', 1), '[^.]', '', 'g')) + 1)
    WHEN lower(regexp_replace(regexp_replace(text, '^\\d+(\\.\\d+)*\\.?\\s+', ''), ':+$', '')) IN ('methods', 'results') AND (bold OR size / body >= 1.05) THEN 1
    WHEN size / body >= 1.3 THEN 1 WHEN bold AND size / body >= 0.95 AND size / body < 1.3 THEN 2 END::INT AS level FROM ln JOIN body USING (paper_id))"""


def c1_word_count(spark, d):
    return table(spark, d, "documents").select("doc_id", T.count_words(F.col("text")).cast("long").alias("n_words"))


def c2_title_norm(spark, d):
    title = F.concat((F.col("p_size") % 7).cast("string"), F.when(F.col("p_size") % 2 == 0, ".3. ").otherwise(" "), F.upper("p_name"), F.when(F.col("p_size") % 3 == 0, "::").otherwise(""))
    return table(spark, d, "part").select("p_partkey", T.normalize_title(title).alias("title"))


def c3_sentences(spark, d):
    s = T.split_sentences(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(s).cast("long").alias("n"), F.md5(F.array_join(s, "|")).alias("md5"))


def c4_hard_split(spark, d):
    blocks = T.hard_split(T.words(F.col("text")), 100)
    return table(spark, d, "documents").select("doc_id", F.size(blocks).cast("long").alias("n"), F.md5(F.array_join(F.transform(blocks, lambda b: F.array_join(b, " ")), "|")).alias("md5"))


def c5_pack(spark, d):
    return chunking.pack_texts(table(spark, d, "documents").select("doc_id", "text"))


def c6_rows_to_text(spark, d):
    t = F.get("tables", F.lit(0))
    return _papers(spark, d).select("doc_id", F.md5(T.table_to_text(t["caption"], t["rows"])).alias("md5"))


def c7_table_batches(spark, d):
    return chunking.tables(_papers(spark, d), most=200)


def _sectioned(spark, d):
    """Sections of a conversation: each user turn covers itself and the next two."""
    c = table(spark, d, "conversations").where("role = 'user'")
    return c.groupBy(F.col("conv_id").alias("paper_id")).agg(F.array_sort(F.collect_list(F.col("turn").cast("int"))).alias("t")).select("paper_id", F.transform("t", lambda t: F.struct(F.concat(F.lit("s"), t.cast("string")).alias("title"), F.lit(1).alias("level"), t.alias("page_start"), (t + 2).alias("page_end"), F.lit("x").alias("text"))).alias("sections"))


def c8_interval_join(spark, d):
    pages = table(spark, d, "conversations").select(F.col("conv_id").alias("paper_id"), F.col("turn").cast("int").alias("page"))
    return chunking.enclosing_section(pages, _sectioned(spark, d)).select("paper_id", "page", "section_title")


def c9_chunk_papers(spark, d):
    return chunking.chunk_papers(_papers(spark, d))


def c10_token_pages(spark, d):
    t = chunking.paged_tokens(_papers(spark, d)).select("paper_id", F.posexplode("tokens").alias("pos", "t"))
    return t.groupBy("paper_id").agg(F.count(F.lit(1)).alias("n"), F.max("t.page").cast("long").alias("last_page"), F.sum((F.col("pos") % 7) * F.col("t.page")).cast("long").alias("mix"))


def c11_fixed_windows(spark, d):
    return chunking.fixed_chunks(_papers(spark, d)).select("chunk_id", "page_start", "page_end", "token_count", F.md5("text").alias("md5"))


def c12_doc_text(spark, d):
    return chunking.paper_text(_papers(spark, d)).select("paper_id", F.md5("source").alias("md5"))


def s9_chunk_stats(spark, d):
    docs = table(spark, d, "documents").select(F.col("lang").alias("chunk_type"), F.col("n_chars").alias("token_count"))
    return chunking.chunk_stats(docs).select("chunk_type", "n", F.round("mean", 4).alias("mean"), "least", "most")


def p2_p3_merges(spark, d):
    return parsing.merge_lines(_lines(spark, d)).select("paper_id", "page", "pos", "text")


def p4_weighted_mode(spark, d):
    return parsing.body_size(_lines(spark, d))


def p5_prose(spark, d):
    """Lines of each text, and how many of them look like prose."""
    lines = F.split("text", "\n", -1)
    return table(spark, d, "documents").select("doc_id", F.size(lines).cast("long").alias("n"), F.size(F.filter(lines, T.looks_like_prose)).cast("long").alias("n_prose"))


def p6_heading_rules(spark, d):
    return parsing.headings(_lines(spark, d)).select("paper_id", "pos", "level")


def p7_sessionize(spark, d):
    rows = parsing.sectionize(parsing.headings(_lines(spark, d)))
    return rows.select("paper_id", F.col("sec_idx").cast("long").alias("sec_idx"), "title", "level", "page_start", "page_end", F.md5("text").alias("md5"))


def p8_nearest(spark, d):
    e = table(spark, d, "events")
    side = lambda kind: e.where(F.col("event_type") == kind).select("user_id", F.col("event_id").alias("row_id"), F.col("event_id").alias("pos"), F.col("value").alias("lo"), (F.col("value") + 1).alias("hi"))
    near = parsing.nearest(side("error"), side("purchase").drop("row_id"), ["user_id"], ("lo", "hi"), ("lo", "hi"), 5.0)
    return near.select("row_id", F.col("near.pos").alias("near"), F.round("gap", 6).alias("gap"))


def p9_tables(spark, d):
    lines = _lines(spark, d)
    spots = lines.where("pos % 3 = 1").select("paper_id", "page", F.col("pos").alias("idx"), F.transform("bbox", lambda x: x + 3).alias("bbox"), F.array(F.array("text")).alias("rows"))
    kept, rejected = parsing.split_tables(spots, lines)
    return kept.select("paper_id", "page", F.lit("kept").alias("kind"), "caption").unionByName(rejected.select("paper_id", "page", F.lit("rejected").alias("kind"), F.col("reason").alias("caption")))


def p10_mentions(spark, d):
    text = F.concat("text", F.lit(" Table 1 and Table "), (F.col("doc_id") % 3).cast("string"), F.when(F.col("doc_id") % 2 == 0, "; TABLE 9, Table IV.").otherwise(""))
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(T.table_mentions(text)), ",").alias("mentioned"))


def p10_diagnostics(spark, d):
    lines = _lines(spark, d)
    pages = lines.groupBy("paper_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n").alias("text"))
    caught = lines.where(T.is_table_caption(F.col("text")) & (F.col("pos") % 2 == 0)).select("paper_id", F.col("text").alias("caption"))
    return parsing.diagnostics(pages, parsing.sectionize(parsing.headings(lines)), caught).select("paper_id", "num_pages", "num_headings_detected", F.col("mentioned_table_count").cast("long").alias("mentioned_table_count"), "captured_table_count", "tables_garbled", "headings_garbled", "needs_fallback_parser")


def p11_html_text(spark, d):
    return table(spark, d, "pages").select("page_id", parsing.html_text("html").alias("text"))


def p12_html_table(spark, d):
    html = F.concat(F.lit("<table><tr><th>a</th><td> "), F.col("page_id").cast("string"), F.lit("</td></tr><tr><td>b &amp; c</td></tr></table>"))
    return table(spark, d, "pages").select("page_id", F.array_join(F.transform(parsing.html_rows(html), lambda r: F.array_join(r, ",")), ";").alias("rows"))


def p13_block_page(spark, d):
    return table(spark, d, "pages").select("page_id", T.block_page(F.concat(F.lit("/page/"), F.col("page_id").cast("string"), F.lit("/Table/4"))).alias("page"))


def p14_heading_level(spark, d):
    """Of each piece of a page's html that begins with a heading."""
    pieces = F.split("html", r"(?=<h[0-9])")
    return table(spark, d, "pages").select("page_id", F.posexplode(pieces).alias("pos", "x")).select("page_id", "pos", T.html_level(F.col("x")).alias("level"))


def _blocks(spark, d):
    """Turns as blocks of a page tree: a root, a page, and the turns below it."""
    kind = F.when(F.col("role") == "user", "Caption").when(F.col("role") == "system", "SectionHeader").when(F.col("turn") % 3 == 1, "Table").otherwise("Text")
    turns = table(spark, d, "conversations").select("conv_id", (F.col("turn") + 1).cast("int").alias("ord"), F.lit(0).alias("parent"), F.col("turn").cast("int").alias("idx"), kind.alias("block_type"), F.format_string("/page/%d/x/%d", F.col("turn") % 3, "turn").alias("id"), F.format_string("<h3>t%d &lt;</h3>", "turn").alias("html"))
    page = table(spark, d, "conversations").select("conv_id").distinct().select("conv_id", F.lit(0).alias("ord"), F.lit(-1).alias("parent"), F.lit(0).alias("idx"), F.lit("Page").alias("block_type"), F.lit("/page/4/Page/0").alias("id"), F.lit("").alias("html"))
    return page.unionByName(turns).withColumnRenamed("conv_id", "paper_id")


def p15_walk(spark, d):
    """The trees of block tags in the html of pages, in pre-order."""
    edges = parsing.tag_edges(table(spark, d, "pages"))
    walked = parsing.preorder(edges)
    above = walked.select("tree", F.col("node").alias("parent"), F.col("ord").alias("_up"))
    rows = edges.join(walked, ["tree", "node"]).join(above, ["tree", "parent"], "left")
    return rows.select(F.col("tree").alias("page_id"), "ord", F.coalesce("_up", F.lit(-1)).alias("parent"), "idx", "depth", F.col("tag").alias("block_type"))


def p16_sibling_caption(spark, d):
    return parsing.block_tables(_blocks(spark, d)).select("paper_id", "table_id", "page", "caption")


def p17_block_sections(spark, d):
    return parsing.block_sections(_blocks(spark, d)).select("paper_id", F.col("sec_idx").cast("long").alias("sec_idx"), "title", "level", "page_start", "page_end", "text")


def p18_parser(spark, d):
    """Pages through a pluggable parser; a page without a title fails and stays a row."""
    source = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("path"), F.encode(F.when(F.col("page_id") % 10 == 3, "").otherwise(F.col("html")), "UTF-8").alias("content"))

    def parser(content: bytes) -> dict:
        if not content:
            raise ValueError("empty")
        return {"text": parsing.plain_text(content.decode("utf-8"))}

    return parsing.parse_files(source, parser, "text:string").select("path", "parsed.text", "error")


def p19_upsert(spark, d):
    base = table(spark, d, "supplier").select("s_suppkey", "s_name")
    changes = table(spark, d, "supplier").where("s_suppkey % 4 = 0").select("s_suppkey", F.lower("s_name").alias("s_name"))
    return incremental.upsert(base, changes, "s_suppkey")


def i1_anti_ingest(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("key")).unionByName(table(spark, d, "orders").select(F.col("o_custkey").alias("key")))
    return incremental.new_rows(rows, table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("key")), "key")


def i2_resume(spark, d):
    todo, done = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id")
    return incremental.pending(todo, done, "doc_id")


def i4_select(spark, d):
    return incremental.select_run(table(spark, d, "customer").select("c_name", "c_custkey").where("c_acctbal > 0"), "c_name", limit=20)


def r11_last_wins(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", "event_type")
    return incremental.last_by_key(rows, "user_id", "event_id")


def s4_query(spark, d):
    return table(spark, d, "nation").select("n_nationkey", T.category_query(F.array("n_name", F.lit("b")), F.when(F.col("n_nationkey") % 2 == 0, F.lit("x y"))).alias("query"))


def s5_ids(spark, d):
    return table(spark, d, "pages").select("page_id", T.short_id(F.concat(F.lit("http://a/abs/"), F.col("url"), F.lit("/abs/2"))).alias("id"), T.short_id(F.col("url")).alias("whole"), T.file_key(F.concat(F.lit("arxiv:arxiv:a/"), F.col("page_id").cast("string"))).alias("file"))


def s7_listing(spark, d):
    entries = table(spark, d, "orders").select(
        F.concat(F.lit("http://x/abs/"), F.col("o_orderkey").cast("string")).alias("entry_id"), F.concat(F.lit(" "), F.col("o_orderpriority")).alias("title"), F.array(F.lit("a")).alias("authors"), F.col("o_orderdate").cast("timestamp").alias("published"),
        F.col("o_orderdate").cast("timestamp").alias("updated"), F.array("o_orderstatus").alias("categories"), F.col("o_orderstatus").alias("primary_category"), F.lit("u").alias("pdf_url"), F.lit(" abs ").alias("abstract"))
    return files.listing(entries).select("paper_id", "title", F.substring("published", 1, 19).alias("published"), "primary_category", "url", "abstract", "pdf_path")


def s12_eval_format(spark, d):
    return table(spark, d, "documents").select("doc_id", F.format_string("%.4f", F.col("n_chars") / 7.0).alias("shown"))


def s14_page_label(spark, d):
    rows = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 5).cast("int").alias("a"), (F.col("doc_id") % 5 + F.col("doc_id") % 2).cast("int").alias("b"), "text")
    return rows.select("doc_id", T.page_label(F.col("a"), F.col("b")).alias("pages"), T.snippet(F.col("text")).alias("snippet"))


def a5_cited(spark, d):
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: F.concat(x["role"], x["turn"].cast("string"))).alias("s"))
    return rows.select("conv_id", F.array_join(answer.cited(F.col("s"), F.array(F.lit(2), F.lit(0), F.lit(1), F.lit(9), F.lit(-1))), ",").alias("cited"))


def a6_backoff(spark, d):
    """Pauses for each turn of a conversation as one more attempt."""
    rows = table(spark, d, "conversations").select("conv_id", (F.col("turn") + 1).alias("attempt"))
    return rows.withColumn("b", answer.backoff_bounds(F.col("attempt"))).select("conv_id", "attempt", "b.*")


#: Recursive SQL of the merges: which numbers take the next line, then which lines captions take.
MERGES = """
o AS (SELECT *, row_number() OVER w AS rn, lead(text) OVER w AS nt, lead(size) OVER w AS ns, lead(bold) OVER w AS nb FROM ln WINDOW w AS (PARTITION BY paper_id, page ORDER BY pos)),
e AS (SELECT *, coalesce(nt IS NOT NULL AND regexp_matches(text, '^\\d+(?:\\.\\d+)*\\.?$') AND (bold OR size > ns) AND len(regexp_extract_all(nt, '\\S+')) <= 10, false) AS can FROM o),
nm AS (SELECT paper_id, page, rn, can AS takes FROM e WHERE rn = 1
  UNION ALL SELECT e.paper_id, e.page, e.rn, e.can AND NOT nm.takes FROM nm JOIN e ON e.paper_id = nm.paper_id AND e.page = nm.page AND e.rn = nm.rn + 1),
tk AS (SELECT e.*, takes, coalesce(lag(takes) OVER (PARTITION BY paper_id, page ORDER BY rn), false) AS taken FROM e JOIN nm USING (paper_id, page, rn)),
m AS (SELECT paper_id, page, pos, CASE WHEN takes THEN text || ' ' || nt ELSE text END AS text, CASE WHEN takes THEN greatest(size, ns) ELSE size END AS size, CASE WHEN takes THEN bold OR nb ELSE bold END AS bold,
  row_number() OVER (PARTITION BY paper_id, page ORDER BY rn) AS rn FROM tk WHERE NOT taken),
k AS (SELECT *, regexp_matches(text, '^\\s*(FIGURE|Figure|Fig\\.?)\\s+([IVXLCDM]+|\\d+)\\b') AS fig, regexp_matches(text, '^\\s*(TABLE|Table)\\s+([IVXLCDM]+|\\d+)\\b') AS tab,
  regexp_matches(text, '^(\\d+(?:\\.\\d+)*)\\.?\\s+(\\S.*)$') OR len(regexp_extract_all(text, '\\S+')) > 30 AS stops FROM m),
cp AS (SELECT paper_id, page, rn, rn AS seg, CASE WHEN fig OR tab THEN bold END AS hb, CASE WHEN fig OR tab THEN size END AS hs, fig AS hf FROM k WHERE rn = 1
  UNION ALL SELECT paper_id, page, rn, CASE WHEN go THEN seg ELSE rn END, CASE WHEN go THEN hb WHEN fig OR tab THEN bold END, CASE WHEN go THEN hs WHEN fig OR tab THEN size END, CASE WHEN go THEN hf ELSE fig END
  FROM (SELECT k.paper_id, k.page, k.rn, cp.seg, hb, hs, hf, fig, tab, k.bold, k.size, coalesce(NOT stops AND k.bold = hb AND abs(k.size - hs) < 0.5, false) AS go
    FROM cp JOIN k ON k.paper_id = cp.paper_id AND k.page = cp.page AND k.rn = cp.rn + 1))"""
TABLE_BODY = "array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: array_to_string(list_filter(list_transform(string_split(x, ' '), lambda c: regexp_replace(regexp_replace(CASE WHEN c = 'the' THEN '' ELSE c END, '^\\s+', ''), '\\s+$', '')), lambda c: c <> ''), ' | ')), lambda x: x <> ''), chr(10))"
TABLE_TEXT = f"CASE WHEN {TABLE_BODY} = '' THEN 'Table 1 of ' || source ELSE 'Table 1 of ' || source || chr(10) || chr(10) || {TABLE_BODY} END"
SENTENCES = "list_filter(string_split(regexp_replace(regexp_replace(trim(text, ' ' || chr(10) || chr(9) || chr(13)), '([.!?])\\s+([A-Z0-9])', '\\1' || chr(30) || '\\2', 'g'), '([.!?])\\s+([A-Z0-9])', '\\1' || chr(30) || '\\2', 'g'), chr(30)), lambda x: x <> '')"
WORDS = "regexp_extract_all(text, '\\S+')"
PAGED = "pg AS (SELECT doc_id, i AS page, unnest(regexp_extract_all(line, '\\S+')) AS t, generate_subscripts(regexp_extract_all(line, '\\S+'), 1) AS k FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)), tk AS (SELECT doc_id, page, t, row_number() OVER (PARTITION BY doc_id ORDER BY page, k) - 1 AS pos FROM pg)"



def _packed(name: str, units: str, key: str = "id") -> str:
    """Recursive SQL of the packing, unit by unit: tables ``<name>_...`` and ``<name>`` (``id``, ``pos``, ``text``). ``units``
    gives ``id`` and the list ``u``. ``e[i + 1]`` are the words before unit ``i``."""
    most, overlap = chunking.MOST, chunking.OVERLAP
    before = lambda x: f"len(list_filter(e, lambda y: y {x}))"
    seed = lambda i, start: f"CASE WHEN e[{i} + 1] > e[{start} + 1] THEN greatest({start}, {before(f'<= e[{i} + 1] - {overlap}')} - 1, 0) ELSE {i} END"
    return f"""
{name}_u AS (SELECT id, u, n, list_concat([0], [list_sum(n[1:i]) FOR i IN range(1, len(n) + 1)]) AS e FROM (SELECT id, u, [len(regexp_extract_all(x, '\\S+')) FOR x IN u] AS n FROM ({units})) WHERE len(u) > 0),
{name}_r AS (SELECT id, 0::BIGINT AS i, 0::BIGINT AS start, false AS fresh, NULL::BIGINT AS a1, NULL::BIGINT AS b1, NULL::BIGINT AS a2, NULL::BIGINT AS b2 FROM {name}_u
  UNION ALL SELECT id, i + 1, CASE WHEN NOT shut THEN s2 WHEN s3 = s2 THEN s2 + 1 ELSE s3 END, NOT shut, CASE WHEN cut THEN start END, CASE WHEN cut THEN i END, CASE WHEN shut THEN s2 END, CASE WHEN shut THEN i + 1 END
  FROM (SELECT *, {seed('(i + 1)', 's2')} AS s3 FROM (SELECT *, e[i + 2] - e[s2 + 1] >= {most} AS shut FROM (SELECT *, CASE WHEN full_ THEN greatest(s1, least(i, {before(f'< e[i + 2] - {most}')})) ELSE s1 END AS s2
    FROM (SELECT *, full_ AND fresh AS cut, CASE WHEN full_ AND fresh THEN {seed('i', 'start')} ELSE start END AS s1
      FROM (SELECT r.*, e, e[i + 1] > e[start + 1] AND e[i + 2] - e[start + 1] > {most} AS full_ FROM {name}_r r JOIN {name}_u USING (id) WHERE i < len(n))))))),
{name}_c AS (SELECT id, i, 1 AS w, a1 AS a, b1 AS b FROM {name}_r WHERE a1 IS NOT NULL UNION ALL SELECT id, i, 2, a2, b2 FROM {name}_r WHERE a2 IS NOT NULL
  UNION ALL SELECT id, i, 3, start, len(n) FROM {name}_r JOIN {name}_u USING (id) WHERE i = len(n) AND fresh AND start < len(n)),
{name} AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY i, w) - 1 AS pos, array_to_string(u[a + 1:b], ' ') AS text FROM {name}_c JOIN {name}_u USING (id))"""


UNITS = f"flatten(list_transform({SENTENCES}, lambda s: CASE WHEN len(regexp_extract_all(s, '\\S+')) <= {chunking.MOST} THEN [s] ELSE [array_to_string(regexp_extract_all(s, '\\S+')[k + 1:k + {chunking.MOST}], ' ') FOR k IN range(0, len(regexp_extract_all(s, '\\S+')), {chunking.MOST})] END))"
#: Lines of a table with their words, and greedy batches of them under a budget.
ROWS = "list_filter(list_transform(string_split(text, chr(10)), lambda x: array_to_string(list_filter(list_transform(string_split(x, ' '), lambda c: regexp_replace(regexp_replace(CASE WHEN c = 'the' THEN '' ELSE c END, '^\\s+', ''), '\\s+$', '')), lambda c: c <> ''), ' | ')), lambda x: x <> '')"


def _batches(most: int) -> str:
    """Tables of ``documents`` as chunks: ``doc_id``, ``source``, ``part`` (null: the whole), ``text``."""
    words = lambda x: f"len(regexp_extract_all({x}, '\\S+'))"
    return f"""
tl AS (SELECT doc_id, 'Table 1 of ' || source AS caption, {TABLE_TEXT} AS whole, {ROWS} AS ls FROM documents),
tb AS (SELECT *, {most} - {words('caption')} AS budget, [{words('x')} FOR x IN ls] AS n FROM tl WHERE {words('whole')} > {most}),
tr AS (SELECT doc_id, 0::BIGINT AS i, 0::BIGINT AS total, 0::BIGINT AS part FROM tb
  UNION ALL SELECT doc_id, i + 1, CASE WHEN i > 0 AND total + n[i + 1] > budget AND total > 0 THEN n[i + 1] ELSE total + n[i + 1] END, CASE WHEN i > 0 AND total + n[i + 1] > budget AND total > 0 THEN part + 1 ELSE part END
  FROM tr JOIN tb USING (doc_id) WHERE i < len(n)),
tp AS (SELECT doc_id, part, string_agg(ls[i], chr(10) ORDER BY i) AS body FROM tr JOIN tb USING (doc_id) WHERE i > 0 GROUP BY ALL),
tc AS (SELECT doc_id, NULL::BIGINT AS part, whole AS text FROM tl WHERE {words('whole')} <= {most}
  UNION ALL SELECT doc_id, CASE WHEN max(part) OVER (PARTITION BY doc_id) > 0 THEN part END, caption || chr(10) || chr(10) || body FROM tp JOIN tb USING (doc_id))"""


TABLE_ID = "'arxiv:' || doc_id || '::table::p2_t1' || CASE WHEN part IS NULL THEN '' ELSE '::part' || part END"

QUERIES = {
    f.__name__: f
    for f in (c1_word_count, c2_title_norm, c3_sentences, c4_hard_split, c5_pack, c6_rows_to_text, c7_table_batches, c8_interval_join, c9_chunk_papers, c10_token_pages, c11_fixed_windows, c12_doc_text, s9_chunk_stats, p2_p3_merges, p4_weighted_mode, p5_prose, p6_heading_rules, p7_sessionize, p8_nearest, p9_tables, p10_mentions, p10_diagnostics, p11_html_text, p12_html_table, p13_block_page, p14_heading_level, p15_walk, p16_sibling_caption, p17_block_sections, p18_parser, p19_upsert, i1_anti_ingest, i2_resume, i4_select, r11_last_wins, s4_query, s5_ids, s7_listing, s12_eval_format, s14_page_label, a5_cited, a6_backoff)
}
ORACLES = {
    "c1_word_count": f"SELECT doc_id, len({WORDS}) AS n_words FROM documents",
    "c2_title_norm": "SELECT p_partkey, regexp_replace(lower(regexp_replace((p_size % 7) || CASE WHEN p_size % 2 = 0 THEN '.3. ' ELSE ' ' END || upper(p_name), '^\\d+(\\.\\d+)*\\.?\\s+', '')), ':+$', '') AS title FROM part",
    "c3_sentences": f"SELECT doc_id, len({SENTENCES}) AS n, md5(array_to_string({SENTENCES}, '|')) AS md5 FROM documents",
    "c4_hard_split": f"SELECT doc_id, ceil(len({WORDS}) / 100.0)::BIGINT AS n, md5(array_to_string([array_to_string(({WORDS})[i + 1:i + 100], ' ') FOR i IN range(0, len({WORDS}), 100)], '|')) AS md5 FROM documents",
    "c5_pack": f"WITH RECURSIVE {_packed('pk', f'SELECT doc_id AS id, {UNITS} AS u FROM documents')} SELECT id AS doc_id, pos::INT AS pos, len(regexp_extract_all(text, '\\S+'))::INT AS token_count, text FROM pk",
    "c7_table_batches": f"WITH RECURSIVE {_batches(200)} SELECT {TABLE_ID} AS chunk_id, 'arxiv:' || doc_id AS paper_id, lang AS title, 2 AS page, tc.text FROM tc JOIN documents USING (doc_id)",
    "c9_chunk_papers": f"""WITH RECURSIVE ln AS (SELECT doc_id, i - 1 AS i, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
sx AS (SELECT doc_id, i // 2 * 2 AS i, regexp_replace(regexp_replace(string_agg(line, ' ' ORDER BY ln.i), '^\\s+', ''), '\\s+$', '') AS text FROM ln GROUP BY doc_id, ln.i // 2),
{_packed('pk', f"SELECT {{'d': doc_id, 'i': i}} AS id, {UNITS} AS u FROM sx WHERE text <> '' AND i <> 6")}, {_batches(chunking.TABLE_MOST)},
tx AS (SELECT id.d AS doc_id, id.i AS i, text, len(regexp_extract_all(text, '\\S+'))::INT AS n, pos FROM pk WHERE len(regexp_extract_all(text, '\\S+')) >= {chunking.LEAST})
SELECT 'arxiv:' || doc_id || '::sec' || i // 2 || '::chunk' || (row_number() OVER (PARTITION BY doc_id, i ORDER BY pos) - 1) AS chunk_id, 'arxiv:' || doc_id AS paper_id, lang AS title, CASE WHEN i = 0 THEN 'Abstract' ELSE '1.2 Part ' || i END AS section_title,
  CASE WHEN i = 0 THEN 'abstract' ELSE 'text' END AS chunk_type, (i + 1)::INT AS page_start, (i + 2)::INT AS page_end, n AS token_count, tx.text FROM tx JOIN documents USING (doc_id)
UNION ALL SELECT {TABLE_ID}, 'arxiv:' || doc_id, lang, 'Abstract', 'table', 2, 2, len(regexp_extract_all(tc.text, '\\S+'))::INT, tc.text FROM tc JOIN documents USING (doc_id)""",
    "c6_rows_to_text": f"SELECT doc_id, md5({TABLE_TEXT}) AS md5 FROM documents",
    "c8_interval_join": "SELECT c.conv_id AS paper_id, c.turn::INT AS page, coalesce('s' || min(u.turn), 'Unknown') AS section_title FROM conversations c LEFT JOIN conversations u ON u.conv_id = c.conv_id AND u.role = 'user' AND c.turn BETWEEN u.turn AND u.turn + 2 GROUP BY ALL",
    "c10_token_pages": f"WITH {PAGED} SELECT 'arxiv:' || doc_id AS paper_id, count(*) AS n, max(page) AS last_page, sum((pos % 7) * page)::BIGINT AS mix FROM tk GROUP BY doc_id",
    "c11_fixed_windows": f"WITH {PAGED}, n AS (SELECT doc_id, count(*) AS n FROM tk GROUP BY 1), st AS (SELECT doc_id, unnest(range(0, (greatest(0, ceil((n - 650) / 560.0)) + 1)::BIGINT)) AS k FROM n) SELECT 'arxiv:' || doc_id || '::fixed::chunk' || k AS chunk_id, min(page)::INT AS page_start, max(page)::INT AS page_end, count(*)::INT AS token_count, md5(string_agg(t, ' ' ORDER BY pos)) AS md5 FROM st JOIN tk USING (doc_id) WHERE pos >= k * 560 AND pos < k * 560 + 650 GROUP BY doc_id, k",
    "c12_doc_text": f"""WITH ln AS (SELECT doc_id, i - 1 AS i, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
s AS (SELECT doc_id, i // 2 * 2 AS i, regexp_replace(regexp_replace(string_agg(line, ' ' ORDER BY ln.i), '^\\s+', ''), '\\s+$', '') AS line FROM ln GROUP BY doc_id, ln.i // 2),
b AS (SELECT doc_id, string_agg('## ' || CASE i WHEN 0 THEN 'Abstract' ELSE '1.2 Part ' || i END || chr(10) || line, chr(10) || chr(10) ORDER BY i) AS body FROM s WHERE i <> 6 AND line <> '' GROUP BY 1)
SELECT 'arxiv:' || doc_id AS paper_id, md5('Title: ' || lang || coalesce(chr(10) || chr(10) || body, '') || chr(10) || chr(10) || '## Table p2/t1 (page 2)' || chr(10) || {TABLE_TEXT}) AS md5 FROM documents LEFT JOIN b USING (doc_id)""",
    "s9_chunk_stats": "SELECT lang AS chunk_type, count(*) AS n, round(avg(n_chars), 4) AS mean, min(n_chars) AS least, max(n_chars) AS most FROM documents GROUP BY lang UNION ALL SELECT NULL, count(*), round(avg(n_chars), 4), min(n_chars), max(n_chars) FROM documents",
    "p2_p3_merges": f"WITH RECURSIVE {LINES}, {MERGES} SELECT paper_id, page, min(pos) AS pos, string_agg(text, ' ' ORDER BY rn) AS text FROM cp JOIN k USING (paper_id, page, rn) WHERE NOT hf GROUP BY paper_id, page, seg",
    "p4_weighted_mode": f"WITH {LINES} SELECT * FROM body",
    "p5_prose": "SELECT doc_id, len(string_split(text, chr(10))) AS n, len(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '[\\x00-\\x1f]') AND (x = '' OR length(regexp_replace(x, '[\\x00-\\x7f]', '', 'g')) / greatest(length(x), 1) <= 0.15))) AS n_prose FROM documents",
    "p6_heading_rules": f"WITH {LINES} SELECT paper_id, pos, level FROM hd",
    "p7_sessionize": f"WITH {LINES}, sg AS (SELECT *, count(level) OVER (PARTITION BY paper_id ORDER BY pos) AS seg FROM hd) SELECT paper_id, row_number() OVER (PARTITION BY paper_id ORDER BY seg) - 1 AS sec_idx, coalesce(max(text) FILTER (level IS NOT NULL), 'Front Matter') AS title, coalesce(max(level), 0)::INT AS level, min(page) AS page_start, coalesce(max(page) FILTER (level IS NULL), min(page)) AS page_end, md5(trim(coalesce(string_agg(text, ' ' ORDER BY pos) FILTER (level IS NULL), ''))) AS md5 FROM sg GROUP BY paper_id, seg",
    "p8_nearest": "WITH j AS (SELECT a.event_id AS row_id, b.event_id AS near, CASE WHEN b.value + 1 <= a.value THEN a.value - (b.value + 1) WHEN b.value >= a.value + 1 THEN b.value - (a.value + 1) END AS gap FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'error' AND b.event_type = 'purchase') SELECT row_id, near, round(gap, 6) AS gap FROM j WHERE gap < 5 QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY gap, near) = 1",
    "p9_tables": f"WITH {LINES}, cap AS (SELECT paper_id, page, pos, text, pos * 40.0::DOUBLE AS y0, pos * 40.0::DOUBLE + 10 AS y1 FROM ln WHERE regexp_matches(text, '^\\s*(TABLE|Table)\\s+([IVXLCDM]+|\\d+)\\b')), tb AS (SELECT paper_id, page, pos, pos * 40.0::DOUBLE + 3 AS y0, pos * 40.0::DOUBLE + 13 AS y1 FROM ln WHERE pos % 3 = 1), nr AS (SELECT tb.paper_id, tb.page, tb.pos, cap.text, CASE WHEN cap.y1 <= tb.y0 THEN tb.y0 - cap.y1 WHEN cap.y0 >= tb.y1 THEN cap.y0 - tb.y1 END AS gap, cap.pos AS cpos FROM tb JOIN cap ON tb.paper_id = cap.paper_id AND tb.page = cap.page WHERE gap < 120 QUALIFY row_number() OVER (PARTITION BY tb.paper_id, tb.pos ORDER BY gap, cpos) = 1) SELECT tb.paper_id, tb.page, CASE WHEN text IS NULL THEN 'rejected' ELSE 'kept' END AS kind, coalesce(text, 'no caption within reach') AS caption FROM tb LEFT JOIN nr USING (paper_id, pos)",
    "p10_mentions": "SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text || ' Table 1 and Table ' || (doc_id % 3) || CASE WHEN doc_id % 2 = 0 THEN '; TABLE 9, Table IV.' ELSE '' END, '\\bTable\\s+([IVXLCDM]+|\\d+)\\b', 1))), ',') AS mentioned FROM documents",
    "p10_diagnostics": f"WITH {LINES}, pp AS (SELECT paper_id, count(DISTINCT page) AS num_pages, len(list_distinct(flatten(list(regexp_extract_all(text, '\\bTable\\s+([IVXLCDM]+|\\d+)\\b', 1))))) AS m, count(level) AS h FROM hd GROUP BY 1), cc AS (SELECT paper_id, count(*) AS n, count(DISTINCT regexp_extract(text, '\\d+')) AS c FROM ln WHERE regexp_matches(text, '^\\s*(TABLE|Table)\\s+([IVXLCDM]+|\\d+)\\b') AND pos % 2 = 0 GROUP BY 1) SELECT paper_id, num_pages, h AS num_headings_detected, m AS mentioned_table_count, coalesce(n, 0) AS captured_table_count, m > coalesce(c, 0) AS tables_garbled, h / num_pages > 3.5 AS headings_garbled, m > coalesce(c, 0) OR h / num_pages > 3.5 AS needs_fallback_parser FROM pp LEFT JOIN cc USING (paper_id)",
    "p12_html_table": "SELECT page_id, 'a,' || page_id || ';b & c' AS rows FROM pages",
    "p13_block_page": "SELECT page_id, (page_id + 1)::INT AS page FROM pages",
    "p14_heading_level": "SELECT page_id, i::INT AS pos, CASE WHEN regexp_matches(x, '^[1-6]') AND i > 0 THEN x[1]::INT ELSE 1 END AS level FROM (SELECT page_id, unnest(string_split(regexp_replace(html, '<h([0-9])', chr(1) || '\\1', 'g'), chr(1))) AS x, generate_subscripts(string_split(regexp_replace(html, '<h([0-9])', chr(1) || '\\1', 'g'), chr(1)), 1) - 1 AS i FROM pages)",
    "p15_walk": """WITH t AS (SELECT page_id, i, x FROM (SELECT page_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT page_id, regexp_extract_all(lower(html), '</?(?:html|head|body|nav|ul|li|a|article|div)\\b') AS l FROM pages))),
d AS (SELECT *, sum(CASE WHEN starts_with(x, '</') THEN -1 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY i) AS depth FROM t),
o AS (SELECT page_id, substr(x, 2) AS tag, depth, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS ord FROM d WHERE NOT starts_with(x, '</')),
p AS (SELECT c.page_id, c.ord, c.tag, c.depth, coalesce(max(a.ord), -1) AS parent FROM o c LEFT JOIN o a ON a.page_id = c.page_id AND a.depth = c.depth - 1 AND a.ord < c.ord GROUP BY ALL),
e AS (SELECT *, row_number() OVER (PARTITION BY page_id, parent ORDER BY ord) - 1 AS idx FROM p)
SELECT page_id, ord::INT AS ord, parent::INT AS parent, idx::INT AS idx, (depth - min(depth) OVER (PARTITION BY page_id))::INT AS depth, tag AS block_type FROM e""",
    "p16_sibling_caption": "WITH b AS (SELECT *, CASE WHEN role = 'user' THEN 'Caption' WHEN role = 'system' THEN 'SectionHeader' WHEN turn % 3 = 1 THEN 'Table' ELSE 'Text' END AS bt FROM conversations), s AS (SELECT *, lag(bt) OVER w AS pb, lag(turn) OVER w AS pt, lead(bt) OVER w AS nb, lead(turn) OVER w AS nt FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id AS paper_id, '/page/' || (turn % 3) || '/x/' || turn AS table_id, (turn % 3 + 1)::INT AS page, CASE WHEN pb = 'Caption' THEN 't' || pt || ' <' WHEN nb = 'Caption' THEN 't' || nt || ' <' ELSE '' END AS caption FROM s WHERE bt = 'Table'",
    "p17_block_sections": "WITH b AS (SELECT *, CASE WHEN role = 'user' THEN 'Caption' WHEN role = 'system' THEN 'SectionHeader' WHEN turn % 3 = 1 THEN 'Table' ELSE 'Text' END AS bt FROM conversations), s AS (SELECT *, count(*) FILTER (bt = 'SectionHeader') OVER (PARTITION BY conv_id ORDER BY turn) AS seg FROM b WHERE bt <> 'Table') SELECT conv_id AS paper_id, row_number() OVER (PARTITION BY conv_id ORDER BY seg) - 1 AS sec_idx, coalesce('t' || max(turn) FILTER (bt = 'SectionHeader') || ' <', 'Front Matter') AS title, CASE WHEN max(bt = 'SectionHeader') THEN 3 ELSE 0 END AS level, 5 AS page_start, 5 AS page_end, coalesce(string_agg('t' || turn || ' <', ' ' ORDER BY turn) FILTER (bt <> 'SectionHeader'), '') AS text FROM s GROUP BY conv_id, seg",
    "p19_upsert": "SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN lower(s_name) ELSE s_name END AS s_name FROM supplier",
    "i1_anti_ingest": "SELECT DISTINCT o_custkey AS key FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)",
    "i2_resume": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "i4_select": "SELECT c_name, c_custkey FROM customer WHERE c_acctbal > 0 ORDER BY c_name LIMIT 20",
    "r11_last_wins": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id",
    "s4_query": "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN '(cat:' || n_name || ' OR cat:b) AND (x y)' ELSE 'cat:' || n_name || ' OR cat:b' END AS query FROM nation",
    "s5_ids": "SELECT page_id, url || '/abs/2' AS id, CASE WHEN contains(url, '/abs/') THEN regexp_extract(url, '^.*?/abs/(.*)$', 1) ELSE url END AS whole, 'arxiv:a_' || page_id AS file FROM pages",
    "s7_listing": "SELECT 'arxiv:' || o_orderkey AS paper_id, o_orderpriority AS title, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS published, o_orderstatus AS primary_category, 'http://x/abs/' || o_orderkey AS url, 'abs' AS abstract, o_orderkey || '.pdf' AS pdf_path FROM orders",
    "s12_eval_format": "SELECT doc_id, printf('%.4f', n_chars / 7.0::DOUBLE) AS shown FROM documents",
    "s14_page_label": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'p' || (doc_id % 5) ELSE 'pp' || (doc_id % 5) || '-' || (doc_id % 5 + 1) END AS pages, replace(substr(text, 1, 280), chr(10), ' ') AS snippet FROM documents",
    "a5_cited": "WITH s AS (SELECT conv_id, list(role || turn ORDER BY turn) AS s FROM conversations GROUP BY 1) SELECT conv_id, array_to_string(list_filter([s[i] FOR i IN [2, 1, 9]], lambda x: x IS NOT NULL), ',') AS cited FROM s",
    "a6_backoff": "SELECT conv_id, turn + 1 AS attempt, least(20.0 * pow(2, turn), 180)::DOUBLE AS least, (least(20.0 * pow(2, turn), 180) * 1.25)::DOUBLE AS most, (least(20.0 * pow(2, turn), 180) / 2)::DOUBLE AS least_other, (least(20.0 * pow(2, turn), 180) / 2)::DOUBLE AS most_other FROM conversations",
}
