"""Edge cases of the library's own operators, written by hand."""

import json

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesserae import schemas
from tesserae.functions import text as T
from tesserae.operators import answer, chunking, dense, evaluate, facts, incremental, parsing, retrieval, validate
from tesserae.sources import files
from tesserae.streaming import ingest


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).head().x


# ---------------------------------------------------------------- text


@pytest.mark.parametrize("title,want", [("1.2. Results:", "results"), ("  Data ", "data"), ("3 Method", "method"), ("2020", "2020"), ("A::", "a")])
def test_normalize_title(spark, title, want):
    assert one(spark, T.normalize_title(F.lit(title))) == want


@pytest.mark.parametrize("text,want", [("A b. C d! 3 e? f", ["A b.", "C d!", "3 e? f"]), ("", []), (" \n ", []), ("x. y. Z", ["x. y.", "Z"])])
def test_split_sentences(spark, text, want):
    assert one(spark, T.split_sentences(F.lit(text))) == want


@pytest.mark.parametrize(
    "text,size,bold,want",
    [
        ("1.2.3.4 Deep title", 10.0, True, 3), ("1 Intro", 11.0, False, 1), ("1 Intro", 10.9, False, None), ("Results:", 10.5, False, 1), ("Results:", 10.4, False, None), ("Big words", 13.0, False, 1), ("Bold words", 12.9, True, 2),
        ("Bold words", 9.5, True, 2), ("Bold words", 9.4, True, None), ("Table 1 x", 20.0, True, None), ("Fig. 2", 20.0, True, None), ("", 20.0, True, None), (" ".join("w" * 16), 20.0, True, None), ("x" * 141, 20.0, True, None), ("𝑎𝑏𝑐𝑑", 20.0, True, None), ("a\x01b", 20.0, True, None), ("3.1 5", 10.0, True, 2),
    ],
)
def test_heading_level(spark, text, size, bold, want):
    assert one(spark, T.heading_level(F.lit(text), F.lit(size), F.lit(bold), F.lit(10.0))) == want


def test_small_text_functions(spark):
    assert one(spark, T.short_id(F.lit("http://x/abs/math/0703743v1"))) == "math/0703743v1"
    assert one(spark, T.short_id(F.lit("no such part"))) == "no such part"
    assert one(spark, T.file_key(F.lit("arxiv:math/07v1"))) == "math_07v1"
    assert one(spark, T.block_page(F.lit("/page/6/Table/4"))) == 7
    assert one(spark, T.block_page(F.lit("odd"))) is None
    assert one(spark, T.html_level(F.lit(" <h3 class=x>y</h3>"))) == 3 and one(spark, T.html_level(F.lit(None).cast("string"))) == 1
    assert one(spark, T.looks_like_prose(F.lit(""))) is True
    assert one(spark, T.table_to_text(F.lit(" T "), F.array(F.array(F.lit(" a "), F.lit(None).cast("string"), F.lit("b")), F.array(F.lit(" "))))) == "T\n\na | b"
    assert one(spark, T.hard_split(F.array(*map(F.lit, "abcde")), 2)) == [["a", "b"], ["c", "d"], ["e"]]
    assert one(spark, T.category_query(F.array(F.lit("a"), F.lit("b")), F.lit(""))) == "cat:a OR cat:b"


# ---------------------------------------------------------------- chunking


def ranges(sizes, **kw):
    return [list(range(a, b)) for a, b in chunking.pack(sizes, **kw)]


def test_compatible_packs():
    assert ranges([800, 800, 400], mode="compat") == [[0], [0], [0, 1], [1], [1, 2]]
    assert ranges([700, 50, 100], mode="compat") == [[0, 1], [0, 1, 2]]
    assert ranges([], mode="compat") == [] and ranges([5], mode="compat") == [[0]]
    assert ranges([300] * 5, mode="compat") == [[0, 1], [1, 2], [2, 3], [3, 4]]


@given(st.lists(st.integers(1, 900), max_size=40))
def test_strict_packs_are_sound(sizes):
    out = chunking.pack(sizes)
    assert len(set(out)) == len(out)
    reached = 0
    for a, b in out:
        assert a <= reached < b and (sum(sizes[a:b]) <= chunking.MOST or b - a == 1)
        reached = b
    assert reached == len(sizes)


@given(st.lists(st.integers(1, 60), max_size=30))
def test_row_batches_cover_all(sizes):
    out = chunking.pack_rows(sizes, 50)
    assert [i for a, b in out for i in range(a, b)] == list(range(len(sizes)))
    assert all(sum(sizes[a:b]) <= 50 or b - a == 1 for a, b in out)


@pytest.mark.parametrize("n,want", [(0, []), (1, [0]), (560, [0]), (650, [0]), (651, [0, 560]), (1210, [0, 560]), (1211, [0, 560, 1120])])
def test_windows(spark, n, want):
    assert one(spark, chunking.windows(F.lit(n))) == want


def paper(**kw):
    base = {"paper_id": "arxiv:1", "title": "T", "pages": [{"page_number": 1, "text": "a b"}], "sections": [], "tables": []}
    return json.dumps(base | kw)


def papers(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "j string").select(F.from_json("j", schemas.PARSED).alias("p")).select("p.*")


def test_chunk_papers(spark):
    long = " ".join(f"Sentence number {i} has just a few words." for i in range(300))
    sections = [
        {"title": "Abstract:", "level": 1, "page_start": 1, "page_end": 1, "text": "One two three four five six seven eight nine ten."}, {"title": "7. References", "level": 1, "page_start": 1, "page_end": 9, "text": long}, {"title": "2 Data", "level": 1, "page_start": 2, "page_end": 3, "text": long},
        {"title": "Tiny", "level": 1, "page_start": 3, "page_end": 4, "text": "Too short."}, {"title": "Empty", "level": 1, "page_start": 3, "page_end": 4, "text": "  "},
    ]
    tables = [{"table_id": "p3/t1", "page": 3, "caption": " Cap ", "rows": [["a", None, " b "], [" "]]}, {"table_id": "x", "page": 99, "caption": "", "rows": [["r w " * 3000], ["s"], ["t " * 3999]]}, {"table_id": "none", "page": 1, "caption": "", "rows": []}]
    rows = {r.chunk_id: r for r in chunking.chunk_papers(papers(spark, paper(sections=sections, tables=tables))).collect()}
    data = sorted(k for k in rows if "::sec2::" in k)
    assert rows["arxiv:1::sec0::chunk0"].chunk_type == "abstract" and len(data) > 2 and data[0] == "arxiv:1::sec2::chunk0"
    assert not [k for k in rows if "::sec1::" in k or "::sec3::" in k or "::sec4::" in k]
    assert all(rows[k].token_count <= 800 for k in data)
    assert rows["arxiv:1::table::p3_t1"].text == "Cap\n\na | b" and rows["arxiv:1::table::p3_t1"].section_title == "7. References"
    assert [rows[f"arxiv:1::table::x::part{i}"].section_title for i in range(2)] == ["Unknown"] * 2 and "arxiv:1::table::none" not in rows


def test_fixed_chunks_and_paper_text(spark):
    pages = [{"page_number": i + 1, "text": " ".join(f"w{i}_{k}" for k in range(500))} for i in range(3)]
    got = sorted((r.chunk_id, r.page_start, r.page_end, r.token_count) for r in chunking.fixed_chunks(papers(spark, paper(pages=pages), paper(paper_id="e", pages=[]))).collect())
    assert got == [("arxiv:1::fixed::chunk0", 1, 2, 650), ("arxiv:1::fixed::chunk1", 2, 3, 650), ("arxiv:1::fixed::chunk2", 3, 3, 380)]
    text = chunking.paper_text(papers(spark, paper(sections=[{"title": "S", "text": " x "}, {"title": "References", "text": "y"}])), most=3).head().source
    assert text == "Title: T ##"


# ---------------------------------------------------------------- retrieval


def test_bm25_edges(spark):
    docs = spark.createDataFrame([(1, "a a b"), (2, "a c"), (3, "a d"), (4, ""), (5, None)], "doc_id long, text string")
    q = spark.createDataFrame([(1, "b b"), (2, "zzz"), (3, "b"), (4, "a")], "query_id long, text string")
    got = {(r.query_id, r.doc): r.score for r in retrieval.bm25(q, docs).collect()}
    assert got[1, 1] == pytest.approx(2 * got[3, 1]) and not [k for k in got if k[0] == 2]
    assert {k for k in got if k[0] == 4} == {(4, 1), (4, 2), (4, 3)}  # more than half hold it: its idf is replaced, and stays positive


def test_dense_is_exact_with_ties(spark):
    v = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(20)], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, embedding array<float>")
    rows = retrieval.dense(q, v, 9).orderBy("rank").collect()
    assert [r.doc for r in rows] == [2, 5, 8, 11, 14, 17, 1, 4, 7]
    assert retrieval.dense(q.limit(0), v).count() == 0


def test_dense_in_blocks(spark):
    rng = np.random.default_rng(3)
    v = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(30)], "vec_id long, embedding array<double>")
    q = v.select(F.col("vec_id").alias("query_id"), "embedding")
    whole = sorted(retrieval.dense(q, v, 5).collect())
    assert sorted(dense.dense(q, v, 5, tile=64, asked_tile=7).collect()) == whole and len(whole) == 150


def test_tag_filter(spark):
    found = spark.createDataFrame([(1, i, 1.0, i) for i in (1, 2, 3)], "query_id long, doc long, score double, rank int")
    tags = spark.createDataFrame([(1, ["x"]), (2, [])], "doc long, signal_type array<string>")
    keep = lambda wanted, ids=None: sorted(r.doc for r in retrieval.tag_filter(found, tags, wanted, ids).collect())
    ids = spark.createDataFrame([(2,), (3,)], "doc long")
    assert keep({}) == [1, 2, 3] and keep({}, ids) == [2, 3] and keep({}, ids.limit(0)) == []
    assert keep({"signal_type": "x"}) == [1] and keep({"signal_type": "x"}, ids) == [3]


def test_fusion(spark):
    a = spark.createDataFrame([(1, "p", 1), (1, "q", 2)], "query_id long, doc string, rank int")
    b = spark.createDataFrame([(1, "r", 1), (1, "q", 2)], "query_id long, doc string, rank int")
    assert [r.doc for r in retrieval.fuse(a, b).orderBy("rank").collect()] == ["q", "p", "r"]
    assert {(r.doc, round(r.score, 12)) for r in retrieval.fuse(a, b).collect()} == {(r.doc, round(r.score, 12)) for r in retrieval.fuse(b, a).collect()}


def test_filters_before_and_after_the_candidates_differ(spark):
    docs = spark.createDataFrame([(i, f"word {'extra ' * (i % 7)}") for i in range(200)], "doc_id long, text string").unionByName(spark.createDataFrame([(i, "other") for i in range(200, 700)], "doc_id long, text string"))
    tags = docs.select(F.col("doc_id").alias("doc"), F.array(F.when(F.col("doc_id") % 50 == 6, "rare").otherwise("many")).alias("signal_type"))
    q = spark.createDataFrame([(1, "word")], "query_id long, text string")
    n = {m: retrieval.search(q, docs, k=30, tags=tags, wanted={"signal_type": "rare"}, filter_mode=m).count() for m in ("pre", "post")}
    assert n["pre"] == 4 > n["post"]
    with pytest.raises(ValueError):
        retrieval.search(q, docs, filter_mode="both")


def test_metrics(spark):
    q = spark.createDataFrame([(i,) for i in range(4)], "query_id long")
    found = spark.createDataFrame([(0, "a", 1), (1, "b", 6), (1, "c", 7), (2, "x", 1)], "query_id long, doc string, rank int")
    gold = spark.createDataFrame([(0, "a"), (1, "b"), (1, "c"), (2, "y")], "query_id long, doc string")
    r = evaluate.summary(evaluate.by_query(q, found, gold)).head()
    assert (r.hit_at_5, r.hit_at_10, r.mrr_at_10, r.recall_at_10, r.n_queries, r.n_with_gold) == (0.25, 0.5, round((1 + 1 / 6) / 4, 6), 0.5, 4, 3)


# ---------------------------------------------------------------- facts and validation


def record(spark, metrics, signal=("momentum",), asset=("fx",), key="p"):
    m = [dict(metric_name=n, value=v, unit=u, context="", evidence_quote=q, source_location="") for n, v, u, q in metrics]
    return {"paper_id": key, "title": "t", "extraction": {"signal_type": list(signal), "asset_class": list(asset), "methodology_summary": "m", "data_period": "", "universe": "", "performance_metrics": m, "key_findings": [], "limitations": [], "extraction_confidence": "high", "extraction_notes": ""}, "extraction_meta": {"validation_flags": []}}


def frame(spark, *rows):
    return spark.createDataFrame([(json.dumps(r), r["paper_id"]) for r in rows], "j string, file_name string").select(F.from_json("j", schemas.RECORDS).alias("r"), "file_name").select("r.*", "file_name")


def test_best_metric_and_order(spark):
    ms = [("Sharpe ratio", 1.0, "ratio", "x"), ("Net sharpe", 3.0, "ratio", "y"), ("sharpe", 3.0, "percent", "z"), ("alpha", 9.0, "percent", "")]
    rows = frame(spark, record(spark, ms, key="b"), record(spark, ms[:1], key="a"), record(spark, [], key="c"))
    ask = lambda **kw: [(r.paper_id, r.matching_metric.metric_name if r.matching_metric else None) for r in facts.structured_query(rows, facts.Params(**kw)).collect()]
    assert ask(keyword="SHARPE", operator=">", threshold=0.5) == [("b", "Net sharpe"), ("a", "Sharpe ratio")]
    assert ask(keyword="sharpe", operator="<=", threshold=3.0) == [("a", "Sharpe ratio"), ("b", "Sharpe ratio")]
    assert ask(keyword="sharpe") == [("a", "Sharpe ratio"), ("b", "Sharpe ratio")]
    assert ask(keyword="sharpe", operator=">", threshold=0.5, unit="percent") == [("b", "sharpe")]
    assert ask(operator=">", threshold=99.0) == [("a", None), ("b", None), ("c", None)]
    assert ask(signal_type=("carry",)) == []
    with pytest.raises(ValueError):
        facts.Params(operator="=")


def test_total_is_counted_before_the_limit(spark):
    rows = frame(spark, *(record(spark, [("m", float(i), "ratio", "")], key=f"{i:03d}") for i in range(30)))
    top = facts.structured_query(rows, facts.Params(keyword="m"), with_total=True).collect()
    assert len(top) == 25 and {r.total_matches for r in top} == {30} and not top[0].mixed_units
    assert facts.summary(rows, facts.Params(keyword="m", operator=">", threshold=2)).head().summary == "27 fit: m > 2.0"


@pytest.mark.parametrize("name,value,unit,want", [("x", 20.0, "ratio", False), ("x", -15.0, "ratio", False), ("x", 20.1, "ratio", True), ("t-stat of x", 900.0, "ratio", False), ("Chi square", 1000.1, "ratio", True), ("x", float("nan"), "ratio", True), ("x", -0.1, "stddev", True), ("x", 5e11, "unknown", False), ("x", 2e12, "unknown", True)])
def test_ranges(spark, name, value, unit, want):
    assert one(spark, validate.out_of_range(F.lit(name), F.lit(value), F.lit(unit))) is want


@pytest.mark.parametrize("quote,source,want", [("", "", True), ("an is of", "", True), ("alpha beta gamma delta eps1 eps2 eps3 zeta1 zeta2 zeta3", "alpha beta gamma delta eps1 eps2 eps3", True), ("alpha beta gamma", "alpha beta", False), ("Alpha ALPHA beta", "alpha", False)])
def test_grounding(spark, quote, source, want):
    assert one(spark, validate.is_grounded(F.lit(quote), F.lit(source))) is want


@pytest.mark.parametrize("got,curated,want", [(["a"], [], False), (["a"], ["a", "b"], False), (["a"], ["b"], True), (["other"], ["b"], False), (["a"], ["other"], False), (["a"], ["other", "x"], True)])
def test_tag_mismatch(spark, got, curated, want):
    arr = lambda x: F.array(*map(F.lit, x)).cast("array<string>")
    assert one(spark, validate.tag_mismatch(arr(got), arr(curated))) is want


def test_flags(spark):
    rows = frame(spark, record(spark, [("Sharpe", 2.82, "ratio", "LSTM | -4.15% | 2.82% | -1.50"), ("big", 50.0, "ratio", "nowhere at all")], key="p"), record(spark, [], key="q"), record(spark, [], key="r"))
    sources = spark.createDataFrame([("p", "lstm 4 15 2 82 1 50"), ("q", "x")], "paper_id string, source string")
    tags = spark.createDataFrame([("p", ["carry"], ["fx"])], "paper_id string, signal_type array<string>, asset_class array<string>")
    flags = lambda ext: {r.paper_id: r.new_flags for r in validate.validate(rows, sources, tags, ext).collect()}
    assert flags(False)["p"] == ["unverified_quote:'big'", "metric_out_of_range:'big'=50.0ratio", "signal_type_disagrees_with_curation"]
    assert "value_percent_but_ratio:'Sharpe'" in flags(True)["p"]
    assert flags(False)["q"] == ["no_performance_metrics_found", "no_curation_tags_to_cross_check"] and flags(False)["r"] is None
    again = {r.paper_id: r.changed for r in validate.revalidate(rows, sources, tags).collect()}
    assert again == {"p": True, "q": True, "r": False}
    good, bad = validate.split_valid(frame(spark, record(spark, []), record(spark, [("x", 1.0, "furlong", "")], signal=(), key="z")))
    assert [r.paper_id for r in good.collect()] == ["p"] and bad.head().errors == ["signal_type: empty", "unit: value"]


# ---------------------------------------------------------------- parsing


def line(pos, text, size=10.0, bold=False, page=1):
    return ("p", page, pos, text, size, bold, [0.0, pos * 20.0, 9.0, pos * 20.0 + 10])


def test_merges(spark):
    rows = [line(0, "1", bold=True), line(1, "Introduction"), line(2, "2", size=9.0), line(3, "Not merged"), line(4, "Figure 1 x", bold=True), line(5, "more of it", bold=True), line(6, "Table 2: y"), line(7, "goes on"), line(8, "3. Heading"), line(9, "text")]
    got = [r.text for r in parsing.merge_lines(spark.createDataFrame(rows, schemas.LINES)).orderBy("pos").collect()]
    assert got == ["1 Introduction", "2", "Not merged", "Table 2: y goes on", "3. Heading", "text"]


def test_merges_at_the_edges(spark):
    """Two numbers in a row, a number at the end, a caption's lines to the end of the page, unknown weights, pages apart."""
    rows = [line(0, "1", bold=True), line(1, "2", bold=True), line(2, "x " * 11), line(3, "Table 1"), line(4, "a"), line(5, "b " * 31), line(6, "3", bold=True)]
    rows += [line(0, "Table 2", bold=None, page=2), line(1, "c", bold=None, page=2), line(2, "Figure 3", page=2), line(3, "d", page=2), line(0, "e", page=3)]
    got = [(r.page, r.text.strip()) for r in parsing.merge_lines(spark.createDataFrame(rows, schemas.LINES)).orderBy("page", "pos").collect()]
    assert got == [(1, "1 2"), (1, ("x " * 11).strip()), (1, "Table 1 a"), (1, ("b " * 31).strip()), (1, "3"), (2, "Table 2 c"), (3, "e")]
    assert "Python" not in parsing.merge_lines(spark.createDataFrame(rows, schemas.LINES))._jdf.queryExecution().toString()


def test_first_section_of_a_page(spark):
    spans = {"p": [("a", 2, 9), ("b", 1, 3), ("c", 3, 3), ("d", 8, 12), (None, 14, 14), ("x", 7, 5)], "q": [], "r": None}
    papers = spark.createDataFrame([(k, None if v is None else [(t, 1, a, b, "") for t, a, b in v]) for k, v in spans.items()], "paper_id string, sections array<struct<title:string,level:int,page_start:int,page_end:int,text:string>>")
    asked = [(p, n, f"{p}{n}") for p in ("p", "q", "r", "s", None) for n in (0, 1, 2, 3, 9, 10, 12, 13, 14, None)] + [("p", 3, "again")]
    got = chunking.enclosing_section(spark.createDataFrame(asked, "paper_id string, page int, more string"), papers)
    first = lambda p, n: next((t or "Unknown" for t, a, b in spans.get(p) or [] if n is not None and a <= n <= b), "Unknown")
    assert got.columns == ["paper_id", "page", "more", "section_title"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr((p, n, m, first(p, n))) for p, n, m in asked)


def test_body_size_rounds_half_to_even(spark):
    rows = [line(0, "aa", 10.25), line(1, "bbb", 10.75), line(2, "c" * 4, 10.0), line(3, "d", 11.0)]
    assert parsing.body_size(spark.createDataFrame(rows, schemas.LINES)).head().body == 10.0
    assert parsing.body_size(spark.createDataFrame(rows[:2], schemas.LINES)).head().body == 11.0


def test_sections(spark):
    rows = [line(0, "front"), line(1, "1 Intro", bold=True), line(2, "x"), line(3, "y", page=2), line(4, "2 Empty", bold=True, page=2), line(5, "3 Last", bold=True, page=3), line(6, "z", page=3)]
    got = [(r.title, r.level, r.page_start, r.page_end, r.text) for r in parsing.sectionize(parsing.headings(spark.createDataFrame(rows, schemas.LINES))).orderBy("sec_idx").collect()]
    assert got == [("Front Matter", 0, 1, 1, "front"), ("1 Intro", 1, 1, 2, "x y"), ("2 Empty", 1, 2, 2, ""), ("3 Last", 1, 3, 3, "z")]


def test_nearest_captions(spark):
    lines = spark.createDataFrame([("p", 1, 0, "Table 1 far", 9.0, False, [0.0, 0.0, 1.0, 10.0]), ("p", 1, 1, "Table 2 tie", 9.0, False, [0.0, 390.0, 1.0, 400.0]), ("p", 1, 2, "Figure 3 tie", 9.0, False, [0.0, 470.0, 1.0, 480.0]), ("p", 1, 3, "Table 4 inside", 9.0, False, [0.0, 430.0, 1.0, 440.0])], schemas.LINES)
    spots = spark.createDataFrame([("p", 1, 0, [0.0, 420.0, 1.0, 450.0], [["a"]]), ("p", 1, 1, [0.0, 130.0, 1.0, 140.0], [["b"]]), ("p", 1, 2, [0.0, 129.9, 1.0, 140.0], [["c"]]), ("p", 1, 3, [0.0, 490.0, 1.0, 500.0], [["d"]])], "paper_id string, page int, idx int, bbox array<double>, rows array<array<string>>")
    kept, rejected = parsing.split_tables(spots, lines)
    assert sorted((r.table_id, r.caption) for r in kept.collect()) == [("p1_t1", "Table 2 tie"), ("p1_t3", "Table 1 far")]
    assert sorted(r.reason[:22] for r in rejected.collect()) == ["beside a figure: Figur", "no caption within reac"]


def test_html_and_trees(spark):
    assert parsing.plain_text("<p>a <b> b</b>&amp;<script>x</script></p>\n<p>c</p>") == "a b & c" and parsing.plain_text(None) == ""
    assert parsing.table_rows("<table><tr><th>h</th><td> 1 <i>x</i></td></tr><tr></tr></table>") == [["h", "1x"], []]
    tree = {"block_type": "Document", "children": [{"block_type": "Page", "id": "/page/0/Page/1", "children": [{"block_type": "TableGroup", "id": "g", "children": [{"block_type": "Caption", "html": "cap"}, {"block_type": "Table", "id": "/page/0/Table/2", "html": "<tr><td>1</td></tr>"}]}, {"block_type": "SectionHeader", "html": "<h2>S</h2>"}, {"block_type": "SectionHeader", "html": ""}, {"block_type": "Text", "html": "t"}, {"block_type": "Picture", "html": "no"}]}]}
    blocks = spark.createDataFrame([("p", json.dumps(tree)), ("q", None)], "paper_id string, j string").select("paper_id", F.explode(parsing.blocks_of("j")).alias("b")).select("paper_id", "b.*")
    t = parsing.block_tables(blocks).head()
    assert (t.table_id, t.page, t.caption, t.rows) == ("/page/0/Table/2", 1, "cap", [["1"]])
    got = [(r.title, r.level, r.text) for r in parsing.block_sections(blocks).orderBy("sec_idx").collect()]
    assert got == [("Front Matter", 0, "cap"), ("S", 2, "t")]


def test_spans(spark):
    spans = spark.createDataFrame([("p", 1, 0, 1, "b ", 9.0, 0, [0.0]), ("p", 1, 0, 0, " a", 11.0, 16, [1.0]), ("p", 1, 1, 0, "arXiv:2401.01 stamp", 9.0, 0, [0.0]), ("p", 1, 2, 0, "  ", 9.0, 0, [0.0])], "paper_id string, page int, line int, pos int, text string, size double, flags int, bbox array<double>")
    assert [(r.text, r.size, r.bold, r.bbox) for r in parsing.lines_from_spans(spans).collect()] == [("ab", 11.0, True, [1.0])]


# ---------------------------------------------------------------- answers, runs, files, streams


def test_answers(spark):
    chunks = spark.createDataFrame([(f"c{i}", "p" if i < 6 else "q", "t", "s", "text", 1, 2, 3, f"momentum works {'very ' * i}well") for i in range(8)] + [(f"o{i}", "z", "t", "s", "text", 1, 1, 3, "nothing here") for i in range(12)], schemas.CHUNKS)
    tags = spark.createDataFrame([("p", ["momentum"], ["fx"]), ("q", ["carry"], ["fx"])], "paper_id string, signal_type array<string>, asset_class array<string>")
    rows = frame(spark, record(spark, [("Sharpe", 2.5, "ratio", "")], key="p"), record(spark, [("Sharpe", 1.0, "ratio", "")], key="q"))
    asked = []

    def model(question, sources):
        asked.append(sources)
        return {"answer": "yes", "used_source_indices": [1, 0, 99, 2], "confidence": "high", "caveat": None}

    engine = answer.Engine(spark, rows, chunks, tags, model)
    got = engine.ask("Which papers have Sharpe > 2?")
    assert got["mode"] == "structured" and got["total_matches"] == 1 and got["matches"][0]["paper_id"] == "p" and not asked
    got = engine.ask("Does momentum in fx do well?")
    assert got["mode"] == "retrieval" and len(got["sources"]) == 2 and got["caveat"] is None and {s["paper_id"] for s in got["sources"]} == {"p"}
    got = engine.retrieved("works well", facts.Params(signal_type=("carry",)))
    assert got["caveat"] == answer.WIDENED
    got = engine.hybrid("works", facts.Params(keyword="sharpe", operator=">", threshold=0.5))
    assert got["answer"] == "yes" and asked[-1].startswith("Source 1 | ")
    assert engine.hybrid("works", facts.Params(keyword="none such"))["answer"] is None
    assert engine.retrieved("zzz", facts.Params())["caveat"] == answer.NOTHING["caveat"]


def test_retries():
    slept, calls = [], []

    def fails():
        calls.append(1)
        raise OSError("x")

    with pytest.raises(RuntimeError):
        answer.with_retries(fails, sleep=slept.append)
    assert slept == [10.0, 20.0, 40.0, 80.0, 90.0] and len(calls) == 5
    with pytest.raises(answer.Fatal):
        answer.with_retries(lambda: (_ for _ in ()).throw(answer.Fatal("no")), sleep=slept.append)
    assert answer.backoff(2) == (40.0, 50.0)


def test_incremental(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k long, v string")
    assert sorted(r.k for r in incremental.new_rows(rows, rows.where("k = 2"), "k").collect()) == [1]
    assert incremental.pending(rows, rows, "k").count() == 0 and incremental.pending(rows, rows, "k", force=True).count() == 3
    with pytest.raises(ValueError):
        incremental.select_run(rows, "k", limit=0)
    assert incremental.select_run(rows, "v", only=["b"]).count() == 1
    many = spark.range(100).withColumnRenamed("id", "k")
    done = incremental.in_batches(many, "k", lambda df: df.count(), 20)
    assert sum(done) == 100 and len(done) == 5
    assert len(incremental.in_batches(many, "k", lambda df: df.count(), 20, stop=lambda r: True)) == 1


def test_files(spark, tmp_path):
    folder = tmp_path / "x"
    folder.mkdir()
    for name, rec in (("b.json", record(spark, [("Sharpe", 1.5, "ratio", "q")], key="b")), ("a.json", record(spark, [], key="a")), ("_s.json", record(spark, [], key="no"))):
        (folder / name).write_text(json.dumps(rec, indent=1))
    rows = files.records(spark, str(folder))
    assert [r.paper_id for r in rows.orderBy("file_name").collect()] == ["a", "b"]
    assert [r.sample_metric for r in files.summary_lines(rows).collect()] == ["", "Sharpe=1.5ratio"]
    files.write_summary(rows, f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == 2
    (tmp_path / "l.jsonl").write_text('{"query_id": "q", "query": "x", "relevant_paper_ids": ["p"]}\n\n')
    assert files.jsonl(spark, f"{tmp_path}/l.jsonl", schemas.EVAL_QUERIES).count() == 1
    assert files.jsonl(spark, f"{tmp_path}/missing.jsonl", schemas.EVAL_QUERIES, optional=True).count() == 0
    with pytest.raises(Exception):
        files.jsonl(spark, f"{tmp_path}/missing.jsonl", schemas.EVAL_QUERIES).count()
    vectors = spark.createDataFrame([("c", [0.5])], schemas.VECTORS)
    files.write_index(vectors, f"{tmp_path}/index", "m", 1)
    back, info = files.read_index(spark, f"{tmp_path}/index")
    assert back.count() == 1 and info.head().num_vectors == 1
    files.write_eval(spark.createDataFrame([("c", 0.25)], "config string, hit double"), f"{tmp_path}/eval")
    assert [r.value for r in spark.read.text(f"{tmp_path}/eval/md").collect()][-1] == "| c | 0.2500 |"
    (tmp_path / "f.pdf").write_bytes(b"bad")

    def parser(content):
        raise ValueError("no")

    good, dead = files.split_failures(parsing.parse_files(files.fetched_files(spark, str(tmp_path)), parser, "a string"))
    assert good.count() == 0 and dead.head().error == "ValueError: no" and dead.head().failed_at


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    run = lambda: ingest.run_available(ingest.new_papers(spark, f"{tmp_path}/in", "paper_id string"), f"{tmp_path}/check", ingest.to_folders(f"{tmp_path}/out")).awaitTermination()
    (tmp_path / "in/1.json").write_text('{"paper_id": "a"}\n{"paper_id": "a"}\n')
    run()
    (tmp_path / "in/2.json").write_text('{"paper_id": "a"}\n{"paper_id": "b"}\n')
    run()
    assert sorted(r.paper_id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a", "b"]


# ---------------------------------------------------------------- plans


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_plans_push_filters_and_limit_early(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in plan(retrieval.doc_lengths(docs.where("lang = 'en'")))
    assert "ReadSchema: struct<doc_id:bigint,text:string" in plan(retrieval.doc_lengths(docs))
    found = retrieval.bm25(spark.createDataFrame([(1, "a")], "query_id long, text string"), docs)
    assert "WindowGroupLimit" in plan(found) and "EvalPython" not in plan(found) and "MapInArrow" not in plan(found)
    rows = frame(spark, record(spark, [("m", 1.0, "ratio", "")]))
    assert "TakeOrderedAndProject" in plan(facts.structured_query(rows, facts.Params(keyword="m")))


def test_entry(spark, small):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


# ---------------------------------------------------------------- extraction, batches, pages, indexes


def papers_of(spark, texts):
    rows = [(i, f"T {i}", [("Results", 1, 1, 1, t)], []) for i, t in texts.items()]
    return spark.createDataFrame(rows, "paper_id string, title string, sections array<struct<title:string,level:int,page_start:int,page_end:int,text:string>>, tables array<struct<table_id:string,page:int,caption:string,bbox:array<double>,html:string,rows:array<array<string>>>>")


def quota(code, quota_id):
    from tesserae.operators import answer

    return answer.ServiceError(code, {"error": {"details": [{"@type": "x.QuotaFailure", "violations": [{"quotaId": quota_id}]}]}})


def test_extraction_keeps_failures_apart_and_stops(spark, tmp_path):
    from tesserae.operators import extract

    tags = spark.createDataFrame([("a", ["momentum"], ["fx"])], "paper_id string, signal_type array<string>, asset_class array<string>")
    papers = papers_of(spark, {"a": "reported gain of 250% here", "b": "reported x of 1.5", "bad": "broken"})

    def extractor(text):
        if "broken" in text:
            raise ValueError("no model can read this")
        return extraction.extract_standin(text)

    rows = {r.paper_id: r for r in extract.process_papers(papers, extractor, tags, "m", "now", sleep=lambda s: None).collect()}
    assert rows["a"].extraction.performance_metrics[0].value == 250 and rows["a"].extraction_meta.validation_flags == [] and rows["a"].extraction_meta.curation_signal_type == ["momentum"]
    assert rows["b"].extraction_meta.validation_flags == ["no_curation_tags_to_cross_check"] and rows["b"].extraction_meta.input_tokens == 9 and rows["b"].extraction_meta.model == "m"
    assert rows["bad"].extraction is None and rows["bad"].extraction_meta is None and rows["bad"].error == "RuntimeError: no model can read this"

    def spent(text):
        from tesserae.operators import answer

        raise answer.ServiceError(429, {"error": {"details": [{"@type": "x.QuotaFailure", "violations": [{"quotaId": "GenerateRequestsPerDay"}]}]}})

    none = spark.createDataFrame([], "paper_id string")
    many = papers_of(spark, {str(i): "x" for i in range(40)})
    told = extract.run_extraction(many, none, f"{tmp_path}/spent", spent, tags, "m", size=10, sleep=lambda s: None)
    assert len(told) == 1 and told[0]["stop"] and told[0]["ok"] == 0
    told = extract.run_extraction(papers, none, f"{tmp_path}/run", extractor, tags, "m", size=2, sleep=lambda s: None)
    assert sum(x["ok"] for x in told) == 2 and sum(x["failed"] for x in told) == 1
    assert {r.paper_id for r in spark.read.json(f"{tmp_path}/run/records").collect()} == {"a", "b"} and spark.read.json(f"{tmp_path}/run/failed").head().paper_id == "bad"


def test_which_errors_are_fatal():
    from tesserae.operators import answer

    tried = []

    def failing(error):
        def call():
            tried.append(1)
            raise error

        return call

    for error, kind, n in ((quota(429, "RequestsPerDay"), answer.DayQuota, 1), (answer.ServiceError(404), answer.Fatal, 1), (quota(429, "PerMinute"), RuntimeError, 3), (answer.ServiceError(429, {"error": None}), RuntimeError, 3)):
        tried.clear()
        with pytest.raises(kind):
            answer.with_retries(failing(error), 3, sleep=lambda s: None)
        assert len(tried) == n


def test_paged_listing(spark, tmp_path):
    from tesserae.sources import paged

    spark.dataSource.register(paged.PagedListing)
    read = lambda **options: spark.read.format("paged_listing").options(**options).load().collect()
    for i in (0, 2, 6):
        (tmp_path / f"page-{i}.json").write_text(json.dumps([{"entry_id": f"e{i}", "title": "t"}, {"entry_id": f"e{i + 1}", "authors": ["a", "b"]}]))
    rows = read(fetch="tesserae.sources.paged:replay", query=f"file://{tmp_path}", max=7, page_size=2)
    assert sorted(r.entry_id for r in rows) == ["e0", "e1", "e2", "e3", "e6"] and [r.pos for r in rows if r.entry_id == "e3"] == [3]
    (tmp_path / "page-4.json").write_text("no json")
    rows = read(fetch="tesserae.sources.paged:replay", query=f"file://{tmp_path}", max=7, page_size=2, retries=2)
    assert len(rows) == 6 and [r.page for r in rows if r.error] == [2]


def test_index_is_written_once_and_again_for_another_state(spark, tmp_path):
    from tesserae.sources import catalog

    path, put = f"{tmp_path}/t.parquet", lambda rows: spark.createDataFrame(rows, "doc_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/t.parquet")
    put([(1, "a b a"), (2, None), (3, "b c")])
    held = catalog.index_of(spark, path)
    assert sorted(tuple(r) for r in held.postings.collect()) == [(1, "a", 2, 3), (1, "b", 1, 3), (3, "b", 1, 2), (3, "c", 1, 2)]
    assert held.n_docs == 3 and held.mean_length == pytest.approx(5 / 3)
    assert catalog.index_of(spark, path).postings.inputFiles() == held.postings.inputFiles()
    put([(1, "z")])
    assert catalog.index_of(spark, path).n_docs == 1
    q = spark.createDataFrame([(1, "b a"), (2, "a b"), (3, "...")], "query_id long, text string")
    docs = spark.createDataFrame([(1, "x, B a! c"), (2, "a. b"), (3, "ba a")], "doc_id long, text string")
    assert sorted(tuple(r) for r in retrieval.holders(q, docs, retrieval.index(docs)).collect()) == [(1, 1), (2, 2)]


def test_embed_by_a_model_in_batches(spark):
    def make():
        import numpy

        return lambda texts: numpy.array([[len(x), len(texts)] for x in texts], float)

    df = spark.createDataFrame([(i, "x" * i if i else None) for i in range(70)], "doc_id long, text string").coalesce(1)
    got = {r.doc: r.embedding for r in retrieval.embed(df, make, prefix="pp").collect()}
    assert len(got) == 70 and got[0] == pytest.approx([2 / np.hypot(2, 32), 32 / np.hypot(2, 32)], rel=1e-6) and got[69] == pytest.approx([71 / np.hypot(71, 6), 6 / np.hypot(71, 6)], rel=1e-6)


def test_nearest_by_brute_force(spark):
    import random

    rng = random.Random(1)
    spans = lambda n: [(rng.randrange(2), i, float(a := rng.randrange(30)), float(a + rng.randrange(4))) for i in range(n)]
    left, right = spans(60), spans(25)
    got = {r.row_id: (r.near.pos, r.gap) for r in parsing.nearest(spark.createDataFrame(left, "k int, row_id long, lo double, hi double"), spark.createDataFrame(right, "k int, pos long, lo double, hi double"), ["k"], ("lo", "hi"), ("lo", "hi"), 6.0).collect()}
    want = {}
    for k, i, a0, a1 in left:
        gaps = [(a0 - b1 if b1 <= a0 else b0 - a1, p) for q, p, b0, b1 in right if q == k and (b1 <= a0 or b0 >= a1)]
        if gaps and min(gaps)[0] < 6:
            want[i] = (min(gaps)[1], min(gaps)[0])
    assert got == want and len(want) > 20


def test_blocks_give_what_all_postings_give(spark, tmp_path, monkeypatch):
    """Frequent words are in every document, rare ones in few; documents of many lengths, ties, repeated query words."""
    rng = np.random.default_rng(8)
    common, rare = ["the", "of", "and", "to"], [f"w{i}" for i in range(400)]
    text = lambda n: " ".join([*rng.choice(common, n), *rng.choice(rare, max(1, n // 4))])
    rows = [(i, text(int(n))) for i, n in enumerate(rng.integers(1, 120, 1500))] + [(5000 + i, "the w1 w2") for i in range(20)] + [(6000, ""), (6001, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    q = spark.createDataFrame([(0, "the of w1 w2"), (1, "w3 w3 the"), (2, "the"), (3, "nowhere"), (4, ""), (5, None), (6, " ".join(rare[:40]))], "query_id long, text string")
    monkeypatch.setattr(retrieval, "BLOCK", 16)
    held = retrieval.write_index(docs, str(tmp_path / "index"))
    assert held.blocks.agg(F.max(F.size("docs"))).head()[0] < 64
    plain = retrieval.Index(held.postings, held.terms, held.n_docs, held.mean_length)
    shown = lambda rows: sorted((r.query_id, r["rank"], r.doc, round(r.score, 9)) for r in rows.collect())
    some = docs.where("doc_id % 3 = 0").select(F.col("doc_id").alias("doc"))
    for k, allowed in ((5, None), (30, None), (30, some), (5000, None)):
        assert shown(retrieval.bm25(q, held, k, allowed=allowed)) == shown(retrieval.bm25(q, plain, k, allowed=allowed))
    told = {r.query_id: (r.n_read, r.n_blocks) for r in retrieval.block_report(q, held, 5).collect()}
    # what holds frequent words alone is left out
    assert told[0][0] < told[0][1] / 2 and told[1][0] < told[1][1] / 2 and told.keys() == {0, 1, 2, 6}


def test_scores_move_by_document(spark, tmp_path):
    """Postings are dealt out by document before queries meet them; pairs of both are never shuffled, with or without a restriction."""
    docs = spark.createDataFrame([(i, f"the w{i % 7} of w{i % 5}") for i in range(300)], "doc_id long, text string")
    q = spark.createDataFrame([(i, f"the w{i} of w{i + 1}") for i in range(6)], "query_id long, text string")
    held = retrieval.write_index(docs, str(tmp_path / "index"), blocks=False)
    assert held.blocks is None and not (tmp_path / "index/blocks").exists()
    pairs = q.select("query_id").crossJoin(docs.select(F.col("doc_id").alias("doc"))).where("doc % 5 = query_id % 5")
    shown = lambda rows: sorted((r.query_id, r["rank"], r.doc, round(r.score, 9)) for r in rows.collect())
    for allowed in (None, pairs, pairs.select("doc").distinct()):
        found = retrieval.bm25(q, held, 5, allowed=allowed)
        moved = [x for x in plan(found).split("== Initial")[0].splitlines() if "Arguments: hashpartitioning(query_id" in x]
        assert len(moved) <= 1  # the best of each task only
        scores = retrieval.bm25_scores(q, held)
        kept = scores if allowed is None else scores.join(allowed, [c for c in ("query_id", "doc") if c in allowed.columns], "left_semi")
        assert shown(found) == shown(retrieval.ranked(kept, [F.round("score", 9).desc(), F.col("doc")]).where("rank <= 5"))


def test_best_of_parts_are_the_best_of_all(spark, monkeypatch):
    """Ties, names as identifiers, none at all, repeated identifiers, more queries than a block; groups count by their best."""
    monkeypatch.setattr(retrieval, "SCORED", 16)
    monkeypatch.setattr(retrieval, "ASKING", 3)
    rows = [(f"d{i % 90}" if i else None, f"the w{i % 7} of w{i % 5} " + "x " * (i % 3)) for i in range(100)] + [("e", None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    q = spark.createDataFrame([(i, f"the w{i} w{i} of w{i + 1}") for i in range(8)] + [(8, ""), (9, "nowhere")], "query_id long, text string")
    held = retrieval.index(docs)
    shown = lambda rows: sorted(((r.query_id, r["rank"], r.doc, round(r.score, 9)) for r in rows.collect()), key=repr)
    top = lambda scores, k: retrieval.ranked(scores, [F.round("score", 9).desc(), F.col("doc")]).where(F.col("rank") <= k)
    for k in (1, 7, 500):
        found = retrieval.bm25(q, held, k)
        assert shown(found) == shown(top(retrieval.bm25_scores(q, held), k))
    assert "FlatMapCoGroupsInArrow" in plan(found)  # no row for a pair of posting and query
    group = F.substring("doc", 1, 2)
    best = retrieval.bm25_scores(q, held, group=group).groupBy("query_id", F.col("group").alias("doc")).agg(F.max("score").alias("score"))
    assert shown(top(retrieval.bm25_best(q, held, 4, group=group), 4)) == shown(top(best, 4))


def _counting(spark, rows, kind):
    """``rows``, and how many of them were made so far."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    return spark.createDataFrame(rows, kind).mapInArrow(count, kind), made


def test_an_index_is_made_in_one_pass(spark, tmp_path):
    docs, made = _counting(spark, [(1, "a b a"), (2, None), (3, ""), (4, "c")], "doc_id long, text string")
    held = retrieval.write_index(docs, str(tmp_path / "index"), blocks=False)
    assert (made.value, held.n_docs, held.mean_length) == (4, 4, 1.0)
    none = retrieval.write_index(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "none"), blocks=False)
    assert (none.n_docs, none.mean_length, none.postings.count()) == (0, 0.0, 0)


def test_counted_tokens_are_the_tokens(spark):
    """Texts that end and begin inside a token, letters that only become ASCII in lower case."""
    texts = ["ab", "cd", "\u0130x \u212a2 Ab-ab ab", None, "", " ", "\u65e5\u672c \u00e9 e 1", "tail", "-head-"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    brute = docs.select("doc_id", F.posexplode(T.tokens(F.col("text"))).alias("i", "term")).groupBy("doc_id", "term").agg(F.count("i").alias("tf")).join(docs.select("doc_id", F.size(T.tokens(F.col("text"))).alias("dl")), "doc_id")
    assert sorted(tuple(r) for r in retrieval.postings(docs).collect()) == sorted((r.doc_id, r.term, r.tf, r.dl) for r in brute.collect())
    parts = list(retrieval._counted([pa.record_batch({"doc": list(range(5)), "text": ["ab ab", "", "a" * retrieval.COUNTED, "b", "a b"]})]))
    assert len(parts) == 2 and [(r["doc"], len(r["term"]), r["tf"], r["dl"]) for p in parts for r in p.to_pylist()] == [(0, 2, 2, 2), (2, retrieval.COUNTED, 1, 1), (3, 1, 1, 1), (4, 1, 1, 2), (4, 1, 1, 2)]


def test_packed_postings_are_the_postings(spark, tmp_path, monkeypatch):
    """Whole documents and windows against chunks made by Spark; white space of all kinds, words without tokens or of several."""
    from jobs import ingest

    monkeypatch.setattr(retrieval, "PACKED", 40)
    monkeypatch.setattr(retrieval, "DOCS", 3)
    texts = ["a b c d e f g h", "  a,b c\t\nd-d \x0b e\x0cf\r\n g ", None, "", " \n ", "... --- a ...", "\u0130x \u212a2 Ab\u00a0c \u65e5 d e f g", "a " * 30, "b"]
    docs = spark.createDataFrame([(9 - i, x, "en") for i, x in enumerate(texts)], "doc_id long, text string, lang string").coalesce(1)
    for window, step in ((0, 0), (4, 3), (3, 1), (2, 5)):
        held = retrieval.write_index(docs, str(tmp_path / f"{window}"), blocks=False, windows=(window, step))
        cut = ingest.chunks_of(docs, ingest.Settings(window, step)).selectExpr("struct(doc_id, chunk_id AS part) AS key", "text") if window else docs.selectExpr("struct(doc_id, '' AS part) AS key", "text")
        plain = retrieval.index(cut, "key")
        rows = lambda t: sorted(map(repr, t.collect()))
        assert rows(held.postings) == rows(plain.postings) and held.n_docs == plain.n_docs and held.mean_length == pytest.approx(plain.mean_length)
        assert {r.term: (r.df, round(r.idf, 9)) for r in held.terms.collect()} == {r.term: (r.df, round(r.idf, 9)) for r in plain.terms.collect()}
        assert held.packed.count() > 2
    none = retrieval.write_index(docs.limit(0), str(tmp_path / "none"), blocks=False, windows=(4, 3))
    assert (none.n_docs, none.mean_length, none.postings.count(), none.terms.count()) == (0, 0.0, 0, 0)


def test_packed_postings_rank_as_all_do(spark, tmp_path, monkeypatch):
    """Ties, repeated query words, more queries than a block, rows in several parts; terms as products and one by one."""
    monkeypatch.setattr(retrieval, "ASKING", 3)
    monkeypatch.setattr(retrieval, "PACKED", 400)
    rows = [(i, f"the w{i % 7} of w{i % 5} " + "x y " * (i % 9)) for i in range(100)] + [(200, None), (201, "the w1 of w2 w1 of w2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    q = spark.createDataFrame([(i, f"the w{i} w{i} of w{i + 1}") for i in range(8)] + [(8, ""), (9, "nowhere"), (10, "w1 of w2"), (11, None), (12, "w1 nowhere")], "query_id long, text string")
    shown = lambda rows: sorted((r.query_id, r["rank"], r.doc, round(r.score, 9)) for r in rows.collect())
    top = lambda scores, k: retrieval.ranked(scores, [F.round("score", 9).desc(), F.col("doc")]).where(F.col("rank") <= k)
    for window, step in ((0, 0), (4, 3)):
        held = retrieval.write_index(docs, str(tmp_path / f"{window}"), blocks=False, windows=(window, step))
        group = F.col("doc.doc_id")
        best = retrieval.bm25_scores(q, held, group=group).groupBy("query_id", F.col("group").alias("doc")).agg(F.max("score").alias("score"))
        for k, dense, cells, pairs in ((1, 0, 1 << 21, 1 << 22), (7, 1 / 4, 1 << 5, 4), (500, 2, 1 << 21, 4)):
            for name, value in (("DENSE", dense), ("CELLS", cells), ("PAIRS", pairs)):
                monkeypatch.setattr(retrieval, name, value)
            found = retrieval.best_documents(q, held, k)
            assert shown(top(found, k)) == shown(top(best, k))
        # postings stay where they lie; best scores move
        moved = [x for x in plan(found).split("== Initial")[0].splitlines() if "Arguments: hashpartitioning(" in x]
        assert not any(f"hashpartitioning({c}" in x for x in moved for c in ("part", "term", "doc")) and "FlatMapCoGroupsInArrow" not in plan(found)


def test_holders_by_packed_postings(spark, tmp_path):
    """The same as by all postings; texts are only made ready for a search where a document has all words."""
    docs = spark.createDataFrame([(1, "x, B a! c"), (2, "a. b b a"), (3, "ba a"), (4, None), (5, "b"), (6, "a c b"), (7, "B... A")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "b a"), (2, "a b"), (3, "..."), (4, None), (5, "a nowhere"), (6, "b"), (7, "a a")], "query_id long, text string")
    held = retrieval.write_index(docs, str(tmp_path / "index"), blocks=False, windows=(0, 0))
    found = retrieval.holders(q, docs, held)
    want = sorted(tuple(r) for r in retrieval.holders(q, docs, retrieval.index(docs)).collect())
    assert sorted(tuple(r) for r in found.collect()) == want and (1, 2) in want and (1, 7) in want
    assert plan(retrieval.holders(q, docs, held)).lower().count("isnotnull(concat(") == 1  # of the passages alone


def test_reranked_results_are_made_once(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "b c"), (3, "d")], "doc_id long, text string")
    q = spark.createDataFrame([(0, "b c")], "query_id long, text string")
    for run in (lambda found: retrieval.rerank_standin(q, found, docs, 2), lambda found: retrieval.rerank(q, found, docs, lambda: lambda pairs: [len(set(a.split()) & set(b.split())) for a, b in pairs], 2)):
        found, made = _counting(spark, [(0, 1, 1.0, 1), (0, 2, 0.5, 2)], "query_id long, doc long, score double, rank int")
        assert [(r.doc, r["rank"]) for r in run(found).orderBy("rank").collect()] == [(2, 1), (1, 2)]
        assert made.value == 2


def test_fixed_chunks_of_odd_pages(spark):
    """Pages out of order, without number or text; against loops."""
    pages = [(3, "a b c"), (1, "d"), (None, "e f"), (2, None), (7, "g h i j")]
    papers = spark.createDataFrame([("p", "t", pages), ("q", "t", []), ("r", "t", None)], "paper_id string, title string, pages array<struct<page_number:int,text:string>>")
    flat = [(w, n) for n, text in pages for w in (text or "").split()]
    expected = []
    for k, at in enumerate(range(0, 10, 3)):
        part = flat[at : at + 4]
        numbers = [n for _, n in part if n is not None]
        expected.append((f"p::fixed::chunk{k}", min(numbers), max(numbers), len(part), " ".join(w for w, _ in part)))
        if at + 4 >= len(flat):
            break
    found = chunking.fixed_chunks(papers, 4, 3)
    assert sorted(tuple(r) for r in found.select("chunk_id", "page_start", "page_end", "token_count", "text").collect()) == expected
    assert "named_struct(t" not in plan(found)  # nothing is made for single tokens


def test_negative_weights_stay_exact(spark, tmp_path):
    """Most words are in most documents, so the mean weight, which replaces negative ones, is negative."""
    docs = spark.createDataFrame([(i, "a b c" if i else "a b c d") for i in range(9)], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a d"), (2, "a"), (3, "d d")], "query_id long, text string")
    held = retrieval.write_index(docs, str(tmp_path / "index"))
    plain = retrieval.Index(held.postings, held.terms, held.n_docs, held.mean_length)
    assert sorted(retrieval.bm25(q, held, 3).collect()) == sorted(retrieval.bm25(q, plain, 3).collect())


def test_questions_as_rows_equal_one_by_one(spark):
    """Random questions over random records: each question of the table against ``structured_query``."""
    rng = np.random.default_rng(12)
    names, tags, assets = ["Sharpe ratio", "SHARPE", "alpha", "beta", "drawdown"], ["carry", "value", "size"], ["fx", "equities"]
    some = lambda values: [x for x in values if rng.random() < 0.5]
    metric = lambda: (str(rng.choice(names)), float(rng.choice([-1, 0, 0.5, 2, 2, float("nan")])), str(rng.choice(["ratio", "percent"])), "", "", "")
    rows = [(f"f{i:02}", f"p{i}", "t", (some(tags), some(assets), "m", [metric() for _ in range(rng.integers(0, 5))])) for i in range(40)]
    kind = f"file_name string, paper_id string, title string, extraction struct<signal_type:array<string>,asset_class:array<string>,methodology_summary:string,performance_metrics:array<{schemas.METRIC}>>"
    held = spark.createDataFrame(rows, kind).cache()
    pick = lambda *v: v[rng.integers(len(v))]
    asked = {i: facts.Params(tuple(some(tags)), tuple(some(assets)), pick("", "sharpe", "A", "RATIO", "none"), pick("none", ">", ">=", "<", "<="), float(pick(-1, 0, 0.5, 2)), pick(None, None, "ratio")) for i in range(24)}
    got = answer.structured_questions(held, answer.question_table(spark, asked), limit=5).collect()
    found = {(r.query_id, r.place): (r.paper_id, repr(r.matching_metric), r.total_matches) for r in got}
    expected = {}
    for i, p in asked.items():
        rows = facts.structured_query(held, p, limit=5, with_total=True).collect()
        expected |= {(i, n + 1): (r.paper_id, repr(r.matching_metric), r.total_matches) for n, r in enumerate(rows)}
    assert found == expected


def test_ten_thousand_questions_are_one_plan(spark):
    held = spark.createDataFrame([("f", "p", "t", (["carry"], ["fx"], "m", [("Sharpe", 1.5, "ratio", "", "", "")]))], f"file_name string, paper_id string, title string, extraction struct<signal_type:array<string>,asset_class:array<string>,methodology_summary:string,performance_metrics:array<{schemas.METRIC}>>")
    many = lambda n: spark.range(n).selectExpr("id as query_id", "array('carry') as signal_type", "cast(array() as array<string>) as asset_class", "'sharpe' as keyword", "'>' as operator", "id / 5000.0D as threshold", "cast(null as string) as unit")
    found = answer.structured_questions(held, many(10_000))
    assert found.count() == 7500  # thresholds below 1.5
    size = lambda n: len(answer.structured_questions(held, many(n))._jdf.queryExecution().optimizedPlan().toString())
    assert abs(size(10) - size(10_000)) < 100


def test_questions_of_a_class_meet_records_once(spark):
    """Thresholds of all sorts over values with zeros of both signs, infinities, no numbers and nulls; questions that differ
    in the threshold alone never meet the records one by one."""
    rng = np.random.default_rng(5)
    values = [-1.0, -0.0, 0.0, 0.5, 2.0, float("nan"), float("inf"), float("-inf"), None]
    metric = lambda: ("Sharpe", values[rng.integers(len(values))], "ratio", "", "", "")
    kind = f"file_name string, paper_id string, title string, extraction struct<signal_type:array<string>,asset_class:array<string>,methodology_summary:string,performance_metrics:array<{schemas.METRIC}>>"
    held = spark.createDataFrame([(f"f{i:03}", f"p{i}", "t", (["carry"], ["fx"], "m", [metric() for _ in range(rng.integers(0, 4))])) for i in range(120)], kind)
    cuts = [-1.0, -0.0, 0.0, 0.25, 0.5, 2.0, float("inf"), float("-inf")]
    asked = {i: facts.Params(keyword="sharpe", operator=op, threshold=t) for i, (op, t) in enumerate((op, t) for op in (">", ">=", "<", "<=") for t in cuts)}
    rows = answer.structured_questions(held, answer.question_table(spark, asked), limit=7)
    text = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "performance_metrics" not in text  # what is left to do per question reads the classes' results
    found, expected = {}, {}
    for r in rows.collect():
        found.setdefault(r.query_id, []).append((r.place, r.paper_id, repr(r.matching_metric.value), r.total_matches))
    for i, p in asked.items():
        best = facts.structured_query(held, p, limit=7, with_total=True).collect()
        if best:
            expected[i] = [(n + 1, r.paper_id, repr(r.matching_metric.value), r.total_matches) for n, r in enumerate(best)]
    assert {i: sorted(x) for i, x in found.items()} == expected
    odd = spark.createDataFrame([(1, [], [], "sharpe", ">", float("nan"), None), (2, [], [], "sharpe", "<=", float("nan"), None), (3, [], [], "sharpe", "<", None, None)], answer.QUESTIONS)
    n = sum(1 for r in held.collect() if any(m.value is not None for m in r.extraction.performance_metrics))
    assert {(r.query_id, r.total_matches) for r in answer.structured_questions(held, odd, limit=1).collect()} == {(2, n)}


def test_results_of_extraction_leave_a_task_in_parts(spark):
    """However many papers a batch has, few results are held at once, and a spent day holds for the rest of the task."""
    from tesserae.operators import answer
    from tesserae.operators import extract as extraction

    asked = spark.sparkContext.accumulator(0)

    def model(text):
        asked.add(1)
        if text == "last":
            raise answer.DayQuota("spent")
        return extraction.extract_standin(text)

    rows = spark.range(0, 300, 1, 1).selectExpr("cast(id as string) as paper_id", "if(id = 200, 'last', 'reported click of 1.5%') as source")
    got = {int(r.paper_id): (r.error is None, r.stop) for r in extraction.extracted(rows, model, 1).collect()}
    assert asked.value == 201 and got == {i: (i < 200, i >= 200) for i in range(300)}
    sent = []
    import pandas as pd

    def frames():
        yield pd.DataFrame({"paper_id": [str(i) for i in range(300)], "source": ["x"] * 300})

    class Rows:  # what Spark does with the function, in this process
        def select(self, *columns):
            return self

        def mapInPandas(self, run, schema):  # noqa: N802
            sent.extend(len(x) for x in run(frames()))

    extraction.extracted(Rows(), extraction.extract_standin)
    assert sum(sent) == 300 and max(sent) <= extraction.AT_ONCE


def test_rerank_by_a_model(spark):
    docs = spark.createDataFrame([(i, "x" * i) for i in range(40)] + [(99, None)], "doc_id long, text string")
    q = spark.createDataFrame([(1, "up"), (2, "down"), (3, None), (4, "odd")], "query_id long, text string")
    found = spark.createDataFrame([(i, d, 1.0, r + 1) for i in (1, 2, 3, 4) for r, d in enumerate((5, 99, 30, 7))], "query_id long, doc long, score double, rank int")

    def make():
        return lambda pairs: [{"up": len(d), "down": -len(d), "": 0, "odd": float("nan") if len(d) == 30 else 1}[a] for a, d in pairs]

    got = {i: [r.doc for r in retrieval.rerank(q, found, docs, make, 3, batch=2).where(F.col("query_id") == i).orderBy("rank").collect()] for i in (1, 2, 3, 4)}
    assert got == {1: [30, 7, 5], 2: [99, 5, 7], 3: [5, 99, 30], 4: [5, 99, 7]}


def test_upsert_leaves_other_files(spark, tmp_path):
    import os

    path = str(tmp_path / "table")
    incremental.write_bucketed(spark.range(200).select("id", F.lit("old").alias("v")), path, "id", 16)
    state = lambda: {f"{d}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}
    before = state()
    changes = spark.createDataFrame([(3, "new"), (500, "added")], "id long, v string")
    n = incremental.upsert_into(path, changes, "id", 16)
    after = state()
    assert n in (1, 2) and len(before.items() - after.items()) == n
    rows = {r.id: r.v for r in spark.read.parquet(path).collect()}
    assert rows == {i: "old" for i in range(200)} | {3: "new", 500: "added"}
    assert incremental.upsert_into(path, changes.limit(0), "id", 16) == 0 and state() == after
    # again: the same table
    incremental.upsert_into(path, changes, "id", 16)
    assert {r.id: r.v for r in spark.read.parquet(path).collect()} == rows


def test_backoff_as_columns(spark):
    rows = spark.range(1, 9).select("id", answer.backoff_bounds(F.col("id")).alias("b")).select("id", "b.*").collect()
    assert [tuple(r)[1:] for r in rows] == [(*answer.backoff(i), *answer.backoff(i, service=False)) for i in range(1, 9)]


def test_preorder_of_deep_and_bushy_trees(spark):
    rng = np.random.default_rng(4)
    edges, expected = [(1, i, i - 1 if i else None, 0) for i in range(200)], {(1, i): (i, i) for i in range(200)}
    above, below = {0: None}, {}
    for node in range(1, 120):
        above[node] = int(rng.integers(0, node))
        below.setdefault(above[node], []).append(node)
    for siblings in below.values():
        rng.shuffle(siblings)
    stack, n = [(0, 0)], 0
    while stack:
        node, depth = stack.pop()
        expected[2, 1000 - node], n = (n, depth), n + 1
        stack += [(c, depth + 1) for c in reversed(below.get(node, []))]
    place = {c: i for siblings in below.values() for i, c in enumerate(siblings)}
    edges += [(2, 1000 - node, None if p is None else 1000 - p, place.get(node, 0)) for node, p in above.items()]
    got = parsing.preorder(spark.createDataFrame(edges, "tree long, node long, parent long, idx int")).collect()
    assert {(r.tree, r.node): (r.ord, r.depth) for r in got} == expected
    assert parsing.preorder(spark.createDataFrame([], "tree long, node long, parent long, idx int")).count() == 0


def test_tags_as_edges(spark):
    deep = "<div>" * 60 + "</div>" * 60
    pages = spark.createDataFrame([(1, "<html><body><ul><li><a href=x>t</a></li><li></ul></li><DIV>x</DIV>"), (2, deep), (3, None), (4, "<p>no blocks<abbr>")], "page_id long, html string")
    got = sorted(tuple(r) for r in parsing.tag_edges(pages).where("tree = 1").select("node", "parent", "tag").collect())
    assert got == [(0, None, "html"), (1, 0, "body"), (2, 1, "ul"), (3, 2, "li"), (4, 3, "a"), (7, 2, "li"), (10, 1, "div")]
    assert parsing.preorder(parsing.tag_edges(pages).where("tree = 2")).agg(F.max("depth")).head()[0] == 59
