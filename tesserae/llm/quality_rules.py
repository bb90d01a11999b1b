"""Quality rules from cross-document line frequency, in DataFrame functions only.

Lines are normalised (lower case, no white space at either end) and hashed; for every host the distinct
documents that hold a line are counted. A line above the limits is boilerplate of its host; a document that loses more
than a stated share of its characters with such lines is rejected as depleted; from all others they are removed.

Copies of one document are not boilerplate. Equal documents count as one, and a line must also have documents that are
unlike: they have lines of their own, and these differ. A document's own lines are those that neither are frequent (on
``min_documents`` documents of the host) nor a changed copy of a frequent line: one that begins or ends with the same three
words, and of whose three-word windows (every third of a long line's) more than half are in frequent lines. So near copies
(a few words changed here and there) have no lines of their own, and pages of a template have, however short these are. ``kind`` tells them apart: of less
than ``OWN_CHARS`` code points of own lines the line with the smallest hash, digits aside (a copy may carry a date or a number);
of more the smallest hash among the first, middle and last words of the own lines, which copies of an article share though
each of their long lines was changed. Beginnings and ends of frequent lines don't count there. Documents without own lines
are of one kind. A line is over the limits with ``min_documents`` distinct documents of which ``min_unlike`` (a share) differ
in kind.

Defined results. Null or empty text: no words, all counts 0, ``base_failed``. Null host: a host of its own. Repeated
rows: each row gets its result; they count as one document. Extra columns stay, whatever their names, but for those named
as results, which give way. Empty table: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import discard, free_name, marked, materialise, release, sieved, table

#: A line is boilerplate of its host from so many distinct documents on ...
MIN_DOCUMENTS = 20
#: ... if at least this share of them are unlike each other.
MIN_UNLIKE = 0.5
#: A document that loses more than this share of its characters is depleted.
MAX_LOST = 0.5
#: Words at either end of a line by which a changed copy of it is known.
END_WORDS = 3
#: A line that begins or ends as a frequent one is a changed copy if more than this share of its windows are frequent lines'.
CHANGED = 0.5
#: Words of a line up to which all its windows are looked up; of longer ones every third.
SHORT_WORDS = 12
#: Code points of own lines below which whole lines tell documents apart.
OWN_CHARS = 200

#: Columns that ``base_counts`` adds; columns of these names in the input give way.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")

WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SPACE = r"[\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"


def let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once: inside a lambda a plain expression is computed for each element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _repeated(grams: Column) -> Column:
    """Words that lie in a window found at least twice: ``grams`` is an array of window hashes by position."""
    return let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(_covered(g)))


def _covered(grams: Column) -> Column:
    placed = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

    def positions(rows: Column) -> Column:
        # neighbours in this order that are equal are repeats; get() past either end is null
        same = lambda x, j: F.coalesce(x["g"] == F.get(rows, j)["g"], F.lit(False))
        marked = F.transform(rows, lambda x, j: F.when(same(x, j - 1) | same(x, j + 1), x["i"]))
        return F.array_sort(F.array_compact(marked))

    return F.aggregate(
        let(placed, positions),
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(3), i - s["last"])).alias("n")),
        lambda s: s["n"],
    )


def base_counts(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed to ``docs`` (column ``text``)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.trim(x, F.lit(SPACES)) != "")

    def of_words(words: Column) -> Column:
        last = F.size(words) - 3
        windows = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
        grams = F.transform(windows, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
        return F.struct(F.size(words).cast("long").alias("n_words"), _repeated(grams).cast("long").alias("n_repeat_words"))

    w = free_name(docs.columns, "_w")
    out = docs.withColumn(w, let(F.array_remove(F.split(text, f"{SPACE}+"), ""), of_words))
    out = out.select(
        *(c for c in docs.columns if c not in COUNTS),
        F.col(f"{w}.n_words").alias("n_words"),
        (F.length(text) - F.regexp_count(text, F.lit(SPACE))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.col(f"{w}.n_repeat_words").alias("n_repeat_words"),
    )
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _number(text: Column) -> Column:
    """60 bits of a text's MD5: the order of these decides which line stands for a document."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def document_lines(docs: DataFrame, key: str = "doc_id", host: str = "source", with_text: bool = False) -> DataFrame:
    """One row for each line with words of each document: ``doc``, ``body`` (hash of host and whole text), ``host``, ``pos``
    (of the line in the text), ``chars`` (code points of the normalised line), a hash of the ``line`` (with the host), numbers
    of its first (``head``), middle (``mid``) and last words (``tail``), ``mark`` (that of the line, digits aside), and ``x``,
    the normalised line, if asked."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.transform(F.split(F.lower(text), "\n", -1), lambda x: F.trim(x, F.lit(SPACES)))
    named = F.transform(lines, lambda x, i: F.struct(i.alias("pos"), F.length(x).alias("c"), x.alias("x")))
    own = F.xxhash64(F.coalesce(F.col(host), F.lit("\x00")))
    flat = docs.select(_identity(key, host).alias("doc"), F.xxhash64(own, text).alias("body"), own.alias("host"), F.explode(F.filter(named, lambda x: x["c"] > 0)).alias("_l"))
    x = F.col("_l.x")
    ends = [_number(F.substring_index(x, " ", n)).alias(name) for name, n in (("head", END_WORDS), ("tail", -END_WORDS))]
    columns = ["doc", "body", "host", F.col("_l.pos").alias("pos"), F.col("_l.c").alias("chars"), F.xxhash64("host", x).alias("line"), *ends]
    if with_text:
        return flat.select(*columns, x.alias("x"))
    mid = let(F.split(x, " "), lambda w: F.array_join(F.slice(w, F.greatest(F.lit(1), F.floor(F.size(w) / 2).cast("int")), END_WORDS), " "))
    return flat.select(*columns, _number(mid).alias("mid"), _number(F.regexp_replace(x, "[0-9]+", "0")).alias("mark"))


def _windows(x: Column, every: int = 1) -> Column:
    """The distinct windows of three words; a shorter line is one. ``every``: of lines of more than ``SHORT_WORDS`` words only
    those from so many words to so many, and the last."""

    def of_words(w: Column) -> Column:
        last = F.size(w) - 3
        starts = F.sequence(F.lit(0), last)
        if every > 1:
            starts = F.filter(starts, lambda i: (F.size(w) <= SHORT_WORDS) | (i % every == 0) | (i == last))
        grams = F.transform(starts, lambda i: F.array_join(F.slice(w, i + 1, 3), " "))
        return F.when(F.size(w) < 3, F.array(F.array_join(w, " "))).otherwise(F.array_distinct(grams))

    return let(F.split(x, " "), of_words)


def changed_copies(docs: DataFrame, often: DataFrame, key: str = "doc_id", host: str = "source") -> DataFrame:
    """``line`` of the lines that are changed copies of frequent ones (``often``: ``line``, ``host``, ``head``, ``tail``).
    Only lines that may begin or end as a frequent one move, each distinct one once."""
    rows = document_lines(docs, key, host, with_text=True).select("host", "line", "head", "tail", "x")
    ends = often.select(F.xxhash64("host", "head").alias("_head"), F.xxhash64("host", "tail").alias("_tail"))
    rows = marked(marked(rows, F.xxhash64("host", "head"), ends, "_head", "_h"), F.xxhash64("host", "tail"), ends, "_tail", "_t").where("_h or _t")
    near = materialise(rows.groupBy("host", "line", "head", "tail").agg(F.min("x").alias("x")))
    held = near.join(often.select("line"), "line", "left_semi").select("host", F.explode(_windows(F.col("x"))).alias("w")).distinct()
    rest = near.join(often.select("line"), "line", "left_anti")
    alike = lambda end: rest.join(often.select("host", end).distinct(), ["host", end], "left_semi").select("host", "line", "x")
    met = alike("head").unionByName(alike("tail")).distinct()
    asked = met.select("host", "line", _windows(F.col("x"), 3).alias("ws")).select("host", "line", F.size("ws").alias("n"), F.explode("ws").alias("w"))
    parts = asked.join(held, ["host", "w"], "left_semi")
    out = materialise(parts.groupBy("line", "n").agg(F.count(F.lit(1)).alias("n_in")).where(F.col("n_in") > CHANGED * F.col("n")).select("line"))
    discard(near)
    return out


def _kinds(lines: DataFrame, often: DataFrame, changed: DataFrame) -> DataFrame:
    """``body`` and ``kind`` of the documents with own lines."""
    own = lines.join(often.select("line").unionByName(changed), "line", "left_anti").select("host", "body", "pos", "chars", "head", "mid", "tail", "mark").distinct()  # repeated rows say the same
    for end in ("head", "tail"):
        own = own.join(often.select("host", end).distinct().withColumn(f"_{end}", F.lit(True)), ["host", end], "left")
    some = F.least(F.when(F.col("_head").isNull(), F.col("head")), F.when(F.col("_tail").isNull(), F.col("tail")), "mid")
    by_body = own.groupBy("body").agg(F.sum("chars").alias("own"), F.min("mark").alias("mark"), F.min(some).alias("some"))
    return by_body.select("body", F.when(F.col("own") < OWN_CHARS, F.col("mark")).otherwise(F.col("some")).alias("kind"))


def frequent_lines(lines: DataFrame, docs: DataFrame, min_documents: int = MIN_DOCUMENTS, min_unlike: float = MIN_UNLIKE, key: str = "doc_id", host: str = "source") -> DataFrame:
    """Lines above the limits: ``line``, ``n_documents``, ``n_kinds``. ``lines`` are those of ``docs``. Nested groupings, each
    combined before it is shuffled, so a line that every document has costs a row a task."""
    once = lines.groupBy("line", "host", "head", "tail", "body").agg(F.lit(1).alias("one"))
    often = materialise(once.groupBy("line", "host", "head", "tail").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_documents).select("line", "host", "head", "tail"))
    holders = materialise(lines.select("line", "body").join(often.select("line"), "line", "left_semi").distinct())
    # only documents that hold a frequent line need a kind
    concerned = sieved(lines, F.col("body"), holders, "body")[0]
    kinds = _kinds(concerned, often, changed_copies(docs, often, key, host))
    placed = holders.join(kinds, "body", "left").select("line", F.coalesce("kind", F.lit(-1).cast("long")).alias("kind"))
    by_kind = placed.groupBy("line", "kind").agg(F.count(F.lit(1)).alias("n"))
    return by_kind.groupBy("line").agg(F.sum("n").alias("n_documents"), F.count(F.lit(1)).alias("n_kinds")).where(F.col("n_kinds") >= min_unlike * F.col("n_documents"))


def _identity(key: str, host: str) -> Column:
    return F.xxhash64(F.col(key), F.col(host), F.coalesce(F.col("text"), F.lit("")))


def boilerplate(docs: DataFrame, key: str = "doc_id", host: str = "source", min_documents: int = MIN_DOCUMENTS, min_unlike: float = MIN_UNLIKE) -> DataFrame:
    """``doc`` (identity of a row), ``lost`` (characters) and ``gone`` (positions of the lines above the limits) of the
    documents that hold such lines. Written, so that what it took is gone before texts move."""
    lines = materialise(document_lines(docs, key, host))
    bad = frequent_lines(lines, docs, min_documents, min_unlike, key, host).select("line")
    # a line of very many documents is one row on the right; adaptive execution splits its rows on the left
    held = lines.select("doc", "line", "pos", "chars").join(bad, "line", "left_semi")
    # repeated rows share an identity and have the same lines
    lost = held.groupBy("doc").agg(F.collect_set(F.struct("pos", "chars")).alias("l"))
    chars = F.aggregate("l", F.lit(0).cast("long"), lambda s, x: s + x["chars"])
    out = materialise(lost.select("doc", chars.alias("lost"), F.transform("l", lambda x: x["pos"]).alias("gone")))
    discard(lines)
    release(docs)
    return out


def without_lines(text: str, gone: str) -> Column:
    """The text without the lines at the positions ``gone`` (null: as it is)."""
    rest = F.filter(F.split(F.col(text), "\n", -1), lambda x, i: ~F.array_contains(F.col(gone), i))
    return F.when(F.col(gone).isNull(), F.col(text)).otherwise(F.array_join(rest, "\n"))


def _looked_up(docs: DataFrame, lost: DataFrame, key: str, host: str) -> tuple[DataFrame, DataFrame, DataFrame, tuple[str, str, str]]:
    """Documents that may hold boilerplate and those that don't; ``lost`` with names that ``docs`` doesn't use, and these
    names. So the texts of the second part needn't move."""
    doc, chars, gone = (free_name(docs.columns, x) for x in ("_doc", "_lost", "_gone"))
    maybe, clean = sieved(docs.withColumn(doc, _identity(key, host)), F.col(doc), lost, "doc")
    return maybe, clean.drop(doc), lost.toDF(doc, chars, gone), (doc, chars, gone)


def quality_rules(docs: DataFrame, key: str = "doc_id", host: str = "source", min_documents: int = MIN_DOCUMENTS, min_unlike: float = MIN_UNLIKE, max_lost: float = MAX_LOST) -> DataFrame:
    """``docs`` with the base counts (of the text as it came), ``n_boilerplate_chars``, ``depleted`` and ``kept``, and
    ``text`` without the lines above the limits. Only columns that are selected from the result move."""
    own = docs.drop("n_boilerplate_chars", "depleted", "kept")
    maybe, clean, lost, (doc, chars, gone) = _looked_up(own, boilerplate(docs, key, host, min_documents, min_unlike), key, host)
    met = base_counts(maybe).hint("merge").join(lost, doc, "left")
    columns = [c for c in met.columns if c not in (doc, chars, gone, "text")]
    n = F.coalesce(chars, F.lit(0).cast("long"))
    met = met.select(*(F.col(f"`{c}`") for c in columns), without_lines("text", gone).alias("text"), n.alias("n_boilerplate_chars"), (n > max_lost * F.coalesce(F.length("text"), F.lit(0))).alias("depleted"))
    clean = base_counts(clean).withColumns({"n_boilerplate_chars": F.lit(0).cast("long"), "depleted": F.lit(False)})
    return clean.unionByName(met).withColumn("kept", ~(F.col("base_failed") | F.col("depleted")))


def accepted(docs: DataFrame, key: str = "doc_id", host: str = "source", min_documents: int = MIN_DOCUMENTS, min_unlike: float = MIN_UNLIKE, max_lost: float = MAX_LOST) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, without the lines above the limits; ``n_chars``, where there is
    one, is that of the text that is left."""
    maybe, clean, lost, (doc, chars, gone) = _looked_up(docs, boilerplate(docs, key, host, min_documents, min_unlike), key, host)

    def sound(rows: DataFrame) -> DataFrame:
        plain = rows.withColumn("_row", F.struct(*(F.col(f"`{c}`") for c in rows.columns))).select("_row", "text")
        return base_counts(plain).where(~F.col("base_failed")).select("_row.*")

    met = sound(maybe).hint("merge").join(lost, doc, "left").where(F.col(gone).isNull() | (F.col(chars) <= max_lost * F.length("text")))
    left = without_lines("text", gone)
    of = {"text": left}
    if "n_chars" in docs.columns:
        of["n_chars"] = F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.length(left)).cast(docs.schema["n_chars"].dataType)
    return sound(clean).unionByName(met.select(*(of[c].alias(c) if c in of else F.col(f"`{c}`") for c in docs.columns)))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_boilerplate_chars", "depleted", "text")


QUERIES = {"op4_quality_rules": op4_quality_rules}
_LINES = "string_split(lower(coalesce(text, '')), chr(10))"
_NUMBER = "('0x' || substr(md5({0}), 1, 15))::BIGINT"
_WINDOWS = "list_distinct(CASE WHEN len(string_split(x, ' ')) < 3 THEN [x] ELSE [array_to_string(string_split(x, ' ')[i:i + 2], ' ') FOR i IN range(1, len(string_split(x, ' ')) - 1)] END)"
_SOME = _WINDOWS.replace("- 1)]", f"- 1) IF len(string_split(x, ' ')) <= {SHORT_WORDS} OR (i - 1) % 3 = 0 OR i = len(string_split(x, ' ')) - 2]")
ORACLES: dict[str, str] = {
    "op4_quality_rules": f"""
WITH l AS (
  SELECT doc_id, host, body, i - 1 AS pos, x, length(x) AS c, string_split(x, ' ')[:{END_WORDS}] AS head, string_split(x, ' ')[-{END_WORDS}:] AS tail, regexp_replace(x, '[0-9]+', '0', 'g') AS plain
  FROM (SELECT doc_id, coalesce(source, chr(1)) AS host, coalesce(text, '') AS body, generate_subscripts({_LINES}, 1) AS i,
    unnest(list_transform({_LINES}, lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)))) AS x FROM documents)
  WHERE x <> ''
), often AS (
  SELECT host, x, head, tail FROM (SELECT DISTINCT host, x, head, tail, body FROM l) GROUP BY ALL HAVING count(*) >= {MIN_DOCUMENTS}
), suspect AS (
  SELECT DISTINCT host, x FROM l WHERE (host, x) NOT IN (SELECT (host, x) FROM often) AND ((host, head) IN (SELECT (host, head) FROM often) OR (host, tail) IN (SELECT (host, tail) FROM often))
), held AS (
  SELECT DISTINCT host, unnest({_WINDOWS}) AS w FROM often
), changed AS (
  SELECT host, x FROM (SELECT host, x, unnest({_SOME}) AS w FROM suspect) LEFT JOIN (SELECT *, 1 AS met FROM held) USING (host, w) GROUP BY ALL HAVING count(met) > {CHANGED} * count(*)
), own AS (
  SELECT DISTINCT host, body, pos, c, plain, head, tail, string_split(x, ' ')[greatest(1, len(string_split(x, ' ')) // 2):][:{END_WORDS}] AS mid FROM l
  WHERE (host, x) NOT IN (SELECT (host, x) FROM often) AND (host, x) NOT IN (SELECT (host, x) FROM changed)
), kinds AS (
  SELECT host, body, CASE WHEN sum(c) < {OWN_CHARS} THEN min({_NUMBER.format('plain')}) ELSE min(least(
    CASE WHEN (host, head) NOT IN (SELECT (host, head) FROM often) THEN {_NUMBER.format("array_to_string(head, ' ')")} END,
    CASE WHEN (host, tail) NOT IN (SELECT (host, tail) FROM often) THEN {_NUMBER.format("array_to_string(tail, ' ')")} END, {_NUMBER.format("array_to_string(mid, ' ')")})) END AS kind FROM own GROUP BY ALL
), holders AS (
  SELECT DISTINCT host, x, body FROM l WHERE (host, x) IN (SELECT (host, x) FROM often)
), bad AS (
  SELECT host, x FROM holders LEFT JOIN kinds USING (host, body) GROUP BY ALL HAVING count(DISTINCT coalesce(kind, -1)) >= {MIN_UNLIKE} * count(*)
), lost AS (
  SELECT doc_id, sum(c) AS n, list(pos) AS gone FROM l WHERE (host, x) IN (SELECT (host, x) FROM bad) GROUP BY ALL
), w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)
), r AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT * FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1)) GROUP BY ALL
), b AS (
  SELECT doc_id, text, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
    coalesce(lost.n, 0)::BIGINT AS n_boilerplate_chars, gone FROM documents JOIN w USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN lost USING (doc_id)
), v AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_boilerplate_chars > {MAX_LOST} * length(coalesce(text, '')) AS depleted FROM b
)
SELECT doc_id, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR depleted) AS kept,
  n_boilerplate_chars, depleted, CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(gone, i - 1)), chr(10)) END AS text
FROM v
"""
}
