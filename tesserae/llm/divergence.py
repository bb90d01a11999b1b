"""Source divergence audit: how far the word use of each source of a language is from every other source, and which terms
set it apart, in exact integers.

A term's counts in the sources of its language are its sparse vector. Terms of one vector behave alike in every pair of
sources, so each distinct vector is evaluated once for every pair of sources that it holds, and the result is multiplied by
the number of its terms. Where a vector holds only one source of a pair, or none, the other shares are those of a count of 0,
the same for all terms: such parts come from a source's histogram of counts, without any pair of entries. Terms are ranked as
themselves.

A vector has one entry a source of its language; the result has one row a pair of sources, so a vector is never longer than
the square root of the result. What is shuffled are counts of (language, source, term), summed up before they move.

Defined results. Null text, lang or source: ''. A text without terms: its group is there all the same, with all counts 0.
Repeated rows: each is a document. Extra columns are not read. A language without kept terms: pairs of value 0, no terms. A
language of one source: no pairs. Empty table: no rows. Exact while a language has less than 9e15 words and 2e9 kept terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .quality_rules import let
from .shared import discard, materialise, table

#: A term is kept if so many documents of its language have it.
MIN_DOCUMENTS = 3
#: Terms that are listed for each source.
TOP = 200
#: Shares are counted in parts of a thousand to this power.
STEPS = 3
#: Groups that a source's terms, or a language's pairs, are dealt into before they meet.
SALTS = 32

#: What parts terms.
GAP = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share(count: Column, size: Column) -> Column:
    """1 + floor(10^9 * (count + 1) / size), by long division in steps of a thousand: no product leaves 64 bits."""
    out, rest = F.lit(0).cast("long"), count + F.lit(1).cast("long")
    for _ in range(STEPS):
        up = rest * 1000
        out, rest = out * 1000 + _div(up, size), up % size
    return out + 1


def gain(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), q)


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``term``, ``n`` occurrences, ``df`` documents; a row without a term for every group that has
    a text without terms."""
    text, lang, source = (F.coalesce(F.col(c), F.lit("")) for c in ("text", "lang", "source"))
    # to split costs a fifth of what it costs to extract matches; a gap at either end leaves an empty string
    words = F.sort_array(F.array_remove(F.split(F.translate(text, UPPER, LOWER), GAP), ""))
    # in order, a term's first place in the document is where it differs from its left neighbour
    marked = let(words, lambda ws: F.transform(ws, lambda w, i: F.struct(w.alias("term"), (~F.coalesce(w == F.get(ws, i - 1), F.lit(False))).alias("new"))))
    rows = docs.select(lang.alias("lang"), source.alias("source"), F.explode_outer(marked).alias("_t"))
    return rows.groupBy("lang", "source", F.col("_t.term").alias("term")).agg(F.count("_t.term").alias("n"), F.sum(F.col("_t.new").cast("long")).alias("df"))


def kept_terms(counts: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``lang``, ``term``, ``total`` occurrences and the vector ``vec`` of (source, n), by source."""
    by_term = counts.where("term is not null").groupBy("lang", "term")
    found = by_term.agg(F.sum("df").alias("df"), F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("vec"))
    return found.where(F.col("df") >= min_documents).drop("df")


def group_sizes(counts: DataFrame, terms: DataFrame) -> DataFrame:
    """For every (lang, source): ``v`` kept terms of the language, ``size`` and ``lang_size`` (occurrences of kept terms,
    and ``v``; null where ``v`` is 0), ``zero`` (the share of a term that the source lacks)."""
    own = terms.select("lang", F.explode("vec").alias("e")).groupBy("lang", F.col("e.source").alias("source")).agg(F.sum("e.n").alias("own"))
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("all"))
    every = counts.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    v = F.coalesce("v", F.lit(0).cast("long"))
    size = F.nullif(F.coalesce("own", F.lit(0).cast("long")) + v, F.lit(0).cast("long"))
    sized = every.select("lang", "source", v.alias("v"), size.alias("size"), (F.col("all") + v).alias("lang_size"))
    return sized.withColumn("zero", share(F.lit(0).cast("long"), F.col("size")))


def vectors(terms: DataFrame, sizes: DataFrame) -> DataFrame:
    """Each distinct vector once: ``lang``, ``m`` (its terms), ``vec`` of (source, share, share of a count of 0)."""
    once = terms.groupBy("lang", "vec").agg(F.count(F.lit(1)).alias("m"), F.min("term").alias("first"))
    entries = once.select("lang", "first", "m", F.explode("vec").alias("e")).select("lang", "first", "m", F.col("e.source").alias("source"), F.col("e.n").alias("n"))
    entries = entries.join(sizes.select("lang", "source", "size", "zero"), ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("size")))
    return entries.groupBy("lang", "first").agg(F.first("m").alias("m"), F.sort_array(F.collect_list(F.struct("source", "p", F.col("zero").alias("z")))).alias("vec")).drop("first")


def shared_part(vecs: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``other``, ``both``: what terms that both sources have add to the sum, over what they would add
    as terms of each alone."""
    left = vecs.select("lang", "m", "vec", F.posexplode("vec").alias("i", "x"))
    pairs = left.select("lang", "m", "x", F.explode(F.slice("vec", F.col("i") + 2, F.size("vec"))).alias("y"))

    def added(a: str, b: str) -> Column:
        p, q, z, y = F.col(f"{a}.p"), F.col(f"{b}.p"), F.col(f"{a}.z"), F.col(f"{b}.z")
        return F.sum(F.col("m") * (gain(p, q) - gain(p, y) - gain(z, q) + gain(z, y)))

    summed = pairs.groupBy("lang", F.col("x.source").alias("a"), F.col("y.source").alias("b")).agg(added("x", "y").alias("ab"), added("y", "x").alias("ba"))
    row = lambda *names: F.struct(*(F.col(c).alias(x) for c, x in zip(names, ("source", "other", "both"), strict=True)))
    both_ways = F.explode(F.array(row("a", "b", "ab"), row("b", "a", "ba"))).alias("r")
    return summed.select("lang", both_ways).select("lang", "r.*")


def pair_values(terms: DataFrame, sizes: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``item`` (each other source of the language), ``value``."""
    vecs = materialise(vectors(terms, sizes))
    counted = vecs.select("lang", "m", F.explode("vec").alias("e")).groupBy("lang", F.col("e.source").alias("source"), F.col("e.p").alias("p")).agg(F.sum("m").alias("k"))
    histogram = counted.groupBy("lang", "source").agg(F.collect_list(F.struct("p", "k")).alias("h"))
    side = sizes.select("lang", "source", "v", "zero").join(histogram, ["lang", "source"], "left")
    a = side.withColumn("salt", F.pmod(F.xxhash64("source"), F.lit(SALTS)).cast("int"))
    b = side.select("lang", F.col("source").alias("item"), F.col("zero").alias("other_zero"), F.col("h").alias("other_h"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    grid = a.join(b, ["lang", "salt"]).where(F.col("source") != F.col("item"))
    z, y, none = F.col("zero"), F.col("other_zero"), F.lit(0).cast("long")
    alone = F.aggregate("h", none, lambda s, x: s + x["k"] * (gain(x["p"], y) - gain(z, y)))
    lacked = F.aggregate("other_h", none, lambda s, x: s + x["k"] * (gain(z, x["p"]) - gain(z, y)))
    parts = [F.when(F.col("v") > 0, F.col("v") * gain(z, y)), alone, lacked, F.col("both")]
    shared = shared_part(vecs).withColumnRenamed("other", "item")
    return grid.join(shared, ["lang", "source", "item"], "left").select("lang", "source", "item", sum((F.coalesce(x, none) for x in parts), none).alias("value"))


def term_values(terms: DataFrame, sizes: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``item`` (each kept term that the source has with more than the language's share), ``value``."""
    flat = terms.select("lang", "term", "total", F.explode("vec").alias("e")).select("lang", F.col("e.source").alias("source"), "term", "total", F.col("e.n").alias("n"))
    met = flat.join(sizes, ["lang", "source"]).select("lang", "source", "term", share(F.col("n"), F.col("size")).alias("p"), share(F.col("total"), F.col("lang_size")).alias("q"))
    return met.where("p > q").select("lang", "source", F.col("term").alias("item"), gain(F.col("p"), F.col("q")).alias("value"))


def _ranked(rows: DataFrame, *by: str) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("value"), "item")))


def source_divergence(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, top: int = TOP) -> DataFrame:
    """``lang``, ``source``, ``part`` ('pair' or 'term'), ``item``, ``value``, ``rank``: all other sources of the language,
    and the ``top`` terms, by falling value."""
    counts = materialise(term_counts(docs))
    terms = materialise(kept_terms(counts, min_documents))
    sizes = materialise(group_sizes(counts, terms))
    discard(counts)
    pairs = _ranked(pair_values(terms, sizes), "lang", "source").withColumn("part", F.lit("pair"))
    # a hot source's terms are ranked in salted groups first, each of which leaves ``top`` rows
    few = _ranked(term_values(terms, sizes).withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(SALTS))), "lang", "source", "salt").where(F.col("rank") <= top)
    best = _ranked(few.drop("rank", "salt"), "lang", "source").where(F.col("rank") <= top).withColumn("part", F.lit("term"))
    names = ("lang", "source", "part", "item", "value", "rank")
    return pairs.select(*names).unionByName(best.select(*names))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents").select("text", "lang", "source"))


QUERIES = {"op11_source_divergence": op11_source_divergence}
ORACLES: dict[str, str] = {
    "op11_source_divergence": f"""
WITH docs AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ws FROM documents
), occ AS (
  SELECT id, lang, source, unnest(ws) AS term FROM docs
), kept AS (
  SELECT lang, term FROM occ GROUP BY ALL HAVING count(DISTINCT id) >= {MIN_DOCUMENTS}
), grp AS (
  SELECT DISTINCT lang, source FROM docs
), cell AS (
  SELECT lang, source, term, count(*) AS c FROM occ SEMI JOIN kept USING (lang, term) GROUP BY ALL
), dense AS (
  SELECT lang, source, term, coalesce(c, 0)::HUGEINT AS c FROM grp JOIN kept USING (lang) LEFT JOIN cell USING (lang, source, term)
), p AS (
  SELECT lang, source, term, c, 1 + (1000000000 * (c + 1)) // (sum(c) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source)) AS p FROM dense
), whole AS (
  SELECT lang, term, 1 + (1000000000 * (c + 1)) // (sum(c) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang)) AS q
  FROM (SELECT lang, term, sum(c) AS c FROM cell GROUP BY ALL)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pairs.value, 0)::BIGINT AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM p JOIN whole USING (lang, term) WHERE c > 0 AND p > q
)
SELECT lang, source, part, item, value, rank::INT AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item COLLATE "binary") AS rank FROM every)
WHERE part = 'pair' OR rank <= {TOP}
"""
}
