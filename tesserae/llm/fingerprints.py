"""Document fingerprints by SpotSigs, in DataFrame functions only.

A spot is an anchor (a very common word); its signature is the chain of the next two content words, stop words and other
anchors skipped (of one, where the text ends). The set of a text's signatures is its fingerprint. Sets are compared by
Jaccard, pruned by their sizes: they can't be more alike than the smaller size over the larger.

``similar`` finds near documents of the whole table. Lengths of sets are partitioned so that alike sets stand in one
partition or in neighbouring ones; a set also enters the partition below its own. Within a partition sets meet by their
rarest signatures, as many as two alike sets can't both lack. Equal sets are one; who meets is compared exactly, a few
hubs of a bucket at a time, with the members that sizes, shared signatures and distances don't exclude.

``edited`` and ``next`` texts need each document's successor by descending identifier. Rows are dealt into at most
``BUCKETS`` ranges of identifiers (more with more rows) (boundaries by approximate percentiles, each range cut evenly), each range also gets
the first document of the following one as a guest, and a window finds the successor inside. One shuffle of the texts.

Defined results. Null or empty text: no signatures, fingerprint ``''``; two such are alike (1.0), one such and another
text not at all (0.0). A text with words but no spot: the hash of its word sequence is its one signature. Null
identifiers come last. Repeated identifiers: in the order of their texts' hashes; each row's successor is the following
row. A single document is its own successor. Extra columns are ignored. Empty table: no rows. Documents without
signatures are near to none, a null identifier has no component; an identifier with several texts has the
smallest of their components. Equal texts are near to each other.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .near_dedup import CELLS, in_shared_buckets, settle
from .quality_rules import let
from .shared import discard, materialise, release, sieved, table

#: Anchors of four languages.
ANCHORS = "the and is a der die und ist le la et est el y es".split()
#: Words that chains skip.
STOPS = sorted(
    {*ANCHORS}
    | set(
        "of to in that it for was on are as with be by this from at or an "
        "das den von zu mit sich auf für im dem nicht ein eine als auch "
        "les de des en un une du que dans pour qui sur par au avec ne "
        "los las del se por con para una su al lo como o pero sus".split()
    )
)
CHAIN = 2
BUCKETS = 1 << 17
_RANGES = 64
#: Near documents share at least this percentage of their signatures.
PERCENT = 80
#: A signature with more than one of so many occurrences is common; there are fewer common ones than this.
COMMON = 10_000
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPOT = "\x01"


def _digest(text: Column) -> Column:
    """16 hexadecimal digits."""
    return F.substring(F.md5(text), 1, 16)


def signatures(text: Column) -> Column:
    """The sorted distinct signatures of a text, 16 hexadecimal digits each."""

    def of_words(words: Column) -> Column:
        content = F.filter(words, lambda w: ~w.isin([w for w in STOPS if w not in ANCHORS]))
        marked = F.array_join(F.transform(content, lambda w: F.when(w.isin(ANCHORS), F.lit(_SPOT)).otherwise(w)), " ")
        # anchors become a mark on the content word that follows them
        chains = let(F.split(F.regexp_replace(marked, f"({_SPOT} )+", _SPOT), " ", -1), of_content)
        whole = F.when(F.size(words) > 0, F.array(_digest(F.array_join(words, " ")))).otherwise(F.array().cast("array<string>"))
        return let(chains, lambda c: F.when(F.size(c) > 0, c).otherwise(whole))

    def of_content(content: Column) -> Column:
        plain = lambda w: F.translate(F.coalesce(w, F.lit("")), _SPOT, "")
        chain = lambda w, i: F.rtrim(F.concat_ws(" ", plain(w), *(plain(F.get(content, i + k)) for k in range(1, CHAIN))))
        spots = F.transform(content, lambda w, i: F.when(F.startswith(w, F.lit(_SPOT)) & (plain(w) != ""), _digest(chain(w, i))))
        return F.array_sort(F.array_distinct(F.array_compact(spots)))

    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _BREAK, -1), lambda w: w != "")
    return let(words, of_words)


def fingerprint(signature: Column) -> Column:
    """Signatures as one text."""
    return F.array_join(signature, "")


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard of two signature sets; 0 where their sizes alone keep it under ``least``."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    exact = let(F.size(F.array_intersect(a, b)), lambda c: c / (small + large - c))
    return F.when(large == 0, F.lit(1.0)).when((small == 0) | (small < least * large), F.lit(0.0)).otherwise(exact)


def _range_of(key: Column, bounds: list[int], first: int = 0) -> Column:
    """Number of bounds that are at most ``key``, by a tree of comparisons."""
    if not bounds:
        return F.lit(first)
    mid = len(bounds) // 2
    return F.when(key < bounds[mid], _range_of(key, bounds[:mid], first)).otherwise(_range_of(key, bounds[mid + 1 :], first + mid + 1))


def with_next(docs: DataFrame, key: str = "doc_id", rows_each: int = 512, carry: tuple[str, ...] = ()) -> DataFrame:
    """``key``, ``text`` (never null), the columns ``carry`` and ``next_text``: the text of the next document by descending
    identifier."""
    lowest = -(2**63)
    rows = docs.select(F.col(key), *carry, F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col(key).cast("long"), F.lit(lowest)).alias("_id"))
    known = rows.where(F.col("_id") > lowest).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("_id", [i / _RANGES for i in range(_RANGES + 1)], 10_000).alias("q"), F.min("_id").alias("lo"), F.max("_id").alias("hi")).head()
    if known["n"]:
        bounds = sorted({*known["q"][1:-1]} - {known["lo"]})
        edges = [known["lo"], *bounds, known["hi"] + 1]
        parts = max(1, min(BUCKETS // _RANGES, math.ceil(known["n"] / rows_each / (len(edges) - 1))))
        at = _range_of(F.col("_id"), bounds)
        low, high = (F.get(F.array(*(F.lit(x).cast("long") for x in e)), at) for e in (edges[:-1], edges[1:]))
        inside = F.floor((F.col("_id") - low).cast("double") / (high - low).cast("double") * parts)
        bucket = F.when(F.col("_id") == lowest, F.lit(-1).cast("long")).otherwise((at * parts + F.least(F.greatest(inside, F.lit(0)), F.lit(parts - 1))).cast("long"))
    else:
        bucket = F.lit(-1).cast("long")
    rows = rows.withColumn("_bucket", bucket)
    # the largest identifier of each bucket is the guest of the bucket above; that of the topmost is the lowest's
    tops = rows.groupBy("_bucket").agg(F.max("_id").alias("_id"))
    order = Window.partitionBy(F.lit(0)).orderBy("_bucket")  # BUCKETS + 1 rows at most, whatever the input
    lowest_bucket = F.min("_bucket").over(Window.partitionBy(F.lit(0)))
    guests = tops.select("_id", F.coalesce(F.lead("_bucket").over(order), lowest_bucket).alias("_bucket"))
    own = rows.select(key, *carry, "text", "_id", "_bucket", F.lit(0).alias("_guest"))
    visiting = rows.drop("_bucket").join(F.broadcast(guests), "_id").select(key, *carry, "text", "_id", "_bucket", F.lit(1).alias("_guest"))
    # a guest's rows stand below the bucket's own
    within = Window.partitionBy("_bucket").orderBy("_guest", F.desc("_id"), F.xxhash64("text"))
    both = own.unionByName(visiting).withColumn("next_text", F.lead("text").over(within))
    return both.where("_guest = 0").select(key, *carry, "text", "next_text")


def fingerprints(docs: DataFrame, key: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """``key``, the columns ``carry`` and the signature sets of each text, of its edited text (last half replaced by the next document's start)
    and of the next text."""
    rows = with_next(docs, key, carry=carry)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.select(key, *carry, "text", "next_text", n.cast("long").alias("n_chars"), F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)).alias("edited"))
    return rows.select(key, *carry, "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), signatures(F.col("text")).alias("own"), signatures(F.col("edited")).alias("changed"), signatures(F.col("next_text")).alias("following"))


# ---------------------------------------------------------------- near documents of the whole table


def length_partitions(n: Column, percent: int = PERCENT) -> Column:
    """The partition of sets of ``n`` signatures and the one below. Two sets have one in common if the smaller has at least
    ``percent`` of the larger's size."""
    at = F.floor(F.log(n) / (math.log(100 / percent) * (1 + 1e-9))).cast("long")
    return F.when(at > 0, F.array(at - 1, at)).otherwise(F.array(at))


def rarest(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``id``, ``n`` (size) and ``prefix`` of each set (``id``, ``s``): so many of its rarest signatures that two sets with
    ``percent`` in common share one of them. Those that no other set has are left out.

    Fewer than ``COMMON`` signatures are common, whatever the input: their counts go to every task and their occurrences
    stay where they are, so no key of the other join is hot."""
    each = sets.select("id", F.size("s").alias("n"), F.explode("s").alias("sig"))
    counts = materialise(each.groupBy("sig").agg(F.count(F.lit(1)).alias("c")))
    total = counts.agg(F.sum("c").alias("total"))
    common = counts.join(F.broadcast(total), F.col("c") * COMMON > F.col("total")).select("sig", F.col("c").alias("common"))
    told = each.join(F.broadcast(common), "sig", "left")
    cold = told.where("common is null").drop("common").join(counts, "sig")
    ranked = cold.unionByName(told.where("common is not null").withColumnRenamed("common", "c"))
    kept = F.col("n") - F.ceil(F.col("n") * percent / 100).cast("int") + 1
    lists = ranked.groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("c", "sig"))).alias("by"))
    return lists.select("id", "n", F.transform(F.filter(F.slice("by", F.lit(1), kept), lambda x: x["c"] > 1), lambda x: x["sig"]).alias("prefix"))


def _described(sets: DataFrame, size: int = 0) -> DataFrame:
    """``id``, ``bits`` (the cells of a table of ``64 * CELLS`` that its signatures fall into) and ``alone`` (how many of
    them no other of these sets has)."""
    each = sets.select("id", F.explode("s").alias("sig"))
    once = each.groupBy("sig").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("id")).where("c = 1")
    alone = once.groupBy("id").agg(F.count(F.lit(1)).alias("alone"))
    cell = F.pmod("sig", F.lit(64 * CELLS))
    words = each.select("id", F.floor(cell / 64).cast("int").alias("at"), (cell % 64).cast("int").alias("bit")).groupBy("id", "at").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("word"))
    maps = words.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("at", "word"))).alias("m"))  # CELLS entries at most
    bits = F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0).cast("long")))
    return maps.select("id", bits.alias("bits")).join(alone, "id", "left")


def compare(pairs: DataFrame, sets: DataFrame, size: int = 0) -> DataFrame:
    """``a``, ``b``, ``common`` and ``total`` (sizes of the sets' intersection and union) of each pair of ``id``."""
    with_b = pairs.select("a", "b").hint("merge").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    both = with_b.hint("merge").join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
    met = both.select("a", "b", F.size(F.array_intersect("sa", "sb")).cast("long").alias("common"), (F.size("sa") + F.size("sb")).alias("sizes"))
    return met.select("a", "b", "common", (F.col("sizes") - F.col("common")).alias("total"))


def similar(docs: DataFrame, key: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """``id`` and ``near_id``, the smallest identifier reachable over near documents, of those documents for which the two
    differ. Near documents have ``percent`` of the union of their signature sets in common."""
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), signatures(F.col("text")).alias("s"))
    # numbers of 64 bits as the signatures themselves; the digest of a set has 128
    told = materialise(rows.select("id", F.unhex(F.md5(F.array_join("s", ""))).alias("digest"), F.transform("s", lambda x: F.xxhash64(x)).alias("s")))
    known = told.where(F.size("s") > 0)  # not before the table is written: the sets would be made twice
    classes = materialise(known.groupBy("digest").agg(F.min("id").alias("least"), F.first("s").alias("s")).withColumn("node", F.monotonically_increasing_id()))
    sets = classes.select(F.col("node").alias("id"), "s")
    lists = rarest(sets, percent)
    bands = F.flatten(F.transform(length_partitions(F.col("n"), percent), lambda k: F.transform("prefix", lambda x: F.xxhash64(x, k))))
    members = in_shared_buckets(lists.select(F.col("id").alias("rep"), "n", bands.alias("bands")))
    release(members)
    met = materialise(sets.join(members.select(F.col("rep").alias("id")).distinct(), "id", "left_semi"))
    none = classes.where("false").select(F.col("node").alias("a"), F.col("node").alias("b"))
    parts = settle(members, met, none, percent, describe=_described, measure=compare)
    placed = classes.join(parts, "node", "left").select("digest", "least", F.coalesce("component", "node").alias("component"))
    names = placed.groupBy("component").agg(F.min("least").alias("near_id"))
    named = placed.join(names, "component").select("digest", "near_id")
    out = materialise(known.select("id", "digest").join(named, "digest").where("id <> near_id").groupBy("id").agg(F.min("near_id").alias("near_id")))
    discard(told, classes, members, met, parts)
    release(out)
    return out


def with_near(docs: DataFrame, key: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """``key``, ``text`` and ``near_id`` (``similar``; its own identifier where nothing is near). Only documents that may
    have another one's move."""
    near = similar(docs, key, percent)
    rows = docs.select(key, "text")
    maybe, rest = sieved(rows, F.col(key).cast("long"), near, "id")
    own = F.col(key).cast("long")
    met = maybe.join(near, own == F.col("id"), "left").select(key, "text", F.coalesce("near_id", own).alias("near_id"))
    return rest.select(key, "text", own.alias("near_id")).unionByName(met)


def op1_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints(with_near(table(spark, sf_dir, "documents")), carry=("near_id",))
    return found.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next"), "near_id",
    )


QUERIES = {"op1_spotsigs": op1_spotsigs}
_QUOTED = {k: ", ".join(f"'{w}'" for w in v) for k, v in (("anchors", ANCHORS), ("stops", [w for w in STOPS if w not in ANCHORS]))}
ORACLES: dict[str, str] = {
    "op1_spotsigs": f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(lead(coalesce(text, '')) OVER w, first_value(coalesce(text, '')) OVER w) AS nt, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id
  FROM documents WINDOW w AS (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
), e AS (
  SELECT *, substr(t, 1, length(t) - length(t) // 2) || substr(nt, 1, length(t) // 2) AS edited FROM d
), x AS (
  SELECT doc_id, 0 AS kind, t FROM e UNION ALL SELECT doc_id, 1, edited FROM e
), w AS (
  SELECT doc_id, kind, regexp_extract_all(lower(t), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM x
), c AS (
  SELECT *, string_split(regexp_replace(array_to_string(list_transform(list_filter(w, lambda y: y NOT IN ({_QUOTED["stops"]})),
    lambda y: CASE WHEN y IN ({_QUOTED["anchors"]}) THEN chr(1) ELSE y END), ' '), '(' || chr(1) || ' )+', chr(1), 'g'), ' ') AS c FROM w
), s AS (
  SELECT doc_id, kind, w, list_sort(list_distinct(list_filter(list_transform(c, lambda y, i: CASE WHEN starts_with(y, chr(1)) AND replace(y, chr(1), '') <> ''
    THEN substr(md5(rtrim(replace(y, chr(1), '') || ' ' || replace(coalesce(c[i + 1], ''), chr(1), ''))), 1, 16) END), lambda y: y IS NOT NULL))) AS s FROM c
), f AS (
  SELECT doc_id, kind, CASE WHEN len(s) > 0 THEN s WHEN len(w) > 0 THEN [substr(md5(array_to_string(w, ' ')), 1, 16)] ELSE [] END AS s FROM s
), p AS (
  SELECT e.doc_id, length(t) AS n_chars, sha256(edited) AS edited_sha256, a.s AS own, b.s AS changed, n.s AS following
  FROM e JOIN f a ON a.doc_id = e.doc_id AND a.kind = 0 JOIN f b ON b.doc_id = e.doc_id AND b.kind = 1 JOIN f n ON n.doc_id = e.next_id AND n.kind = 0
), u AS (
  SELECT doc_id, unnest(own) AS g FROM p
), o AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM u a JOIN u b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT x, y FROM o JOIN p a ON a.doc_id = x JOIN p b ON b.doc_id = y WHERE 100 * c >= {PERCENT} * (len(a.own) + len(b.own) - c)
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM p UNION SELECT r.a, l.y FROM r JOIN l ON l.x = r.b
), near AS (
  SELECT a AS doc_id, min(b) AS near_id FROM r GROUP BY a
)
SELECT doc_id, n_chars, edited_sha256, array_to_string(own, '') AS fingerprint, array_to_string(changed, '') AS edited_fingerprint,
  CASE WHEN len(own) + len(changed) = 0 THEN 1 WHEN len(own) = 0 OR len(changed) = 0 THEN 0 ELSE len(list_intersect(own, changed)) / (len(own) + len(changed) - len(list_intersect(own, changed)))::DOUBLE END::DOUBLE AS near_edited,
  CASE WHEN len(own) + len(following) = 0 THEN 1 WHEN len(own) = 0 OR len(following) = 0 THEN 0 ELSE len(list_intersect(own, following)) / (len(own) + len(following) - len(list_intersect(own, following)))::DOUBLE END::DOUBLE AS near_next, near_id
FROM p JOIN near USING (doc_id)
"""
}
