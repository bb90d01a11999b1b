"""URL filters: allow and block rules by host and path, and for all other pages trust and distrust that spread over links
between hosts. DataFrame functions only.

A rule fits its host and all subdomains if the path starts as the rule's; the longest rule (host and path together) decides,
of equal ones the blocking one. Pages that a rule judges are seeds: a host has trust by the share of its pages that rules
allow and distrust by the share that they block. Personalised PageRank carries trust along links, and distrust against them
(who links to blocked hosts is suspect). A host whose distrust is above its trust, and at least half of what a wholly
blocked host without any link has, is blocked; only pages without a rule follow it.

Scores are integers in parts of ``UNIT``, not normalised by the number of seeds: a host's verdict is the same in a small and a
large graph around it, whatever the order of rows. Links are the distinct pairs of hosts in ``href`` and ``src`` attributes
that name a host; those within a host count for nothing. A host that everyone links to is one row of the sums, combined
before they are shuffled; one that links to everyone has rows that adaptive execution may split. Each round's scores are
written to the shared folder.

Defined results. Null url, or one without ``://``: host and path empty, no rule, allowed. Null or empty html: no links. Null
page_id and repeated rows: each row gets its result. Extra columns are not read. Empty table: no rows. No rules: all allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .divergence import LOWER, UPPER
from .shared import discard, materialise, table

#: (verdict, host, path); fixed values.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: A whole seed. Sums stay in 64 bits while fewer than 9e9 hosts link to one.
UNIT = 10**9
#: Percentage of a score that links carry on.
DAMPING = 85
#: Rounds at most; they end before where nothing changes any more. 0.85 ** 30 < 0.01 of a score is then under way.
ROUNDS = 30
#: Distrust from which a host may be blocked: half of what a wholly blocked one has of itself.
LEAST = UNIT * (100 - DAMPING) // 200

LINK = r"(?i)\b(?:href|src)[\x20\x09-\x0D]*+=[\x20\x09-\x0D]*+[\"']?+[\x20\x09-\x0D]*+(?:[a-z][a-z0-9+.-]*+:)?+//([^/?#\"'<>\x20\x09-\x0D]++)"


def _div(a: Column, b: Column | int) -> Column:
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b).cast("long"))


def host_and_path(url: str) -> tuple[Column, Column]:
    """Empty for null and for what has no ``://``."""
    at = F.locate("://", F.coalesce(F.col(url), F.lit("")))
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rules_of_hosts(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """``host`` and ``rules``, those of the host and of what it is a subdomain of, the first to decide at the front. Hosts
    meet rules by their suffixes, so a long list costs a join and no scan of the list for each host."""
    labels = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    given = rules.select(F.col("host").alias("suffix"), F.struct((-F.length(F.concat("host", "path"))).alias("order"), F.when(F.col("verdict") == "block", 0).otherwise(1).alias("mild"), F.concat("host", "path").alias("rule"), "path", "verdict").alias("r"))
    return hosts.select("host", F.explode(suffix).alias("suffix")).join(given, "suffix").groupBy("host").agg(F.sort_array(F.collect_set("r")).alias("rules"))


def ruled(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``pages`` (with ``host`` and ``path``) and ``r``, the struct of the rule that decides (null: none)."""
    found = rules_of_hosts(pages.select("host").where("host <> ''").distinct(), rules)
    met = pages.join(found, "host", "left")
    return met.withColumn("r", F.get(F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"])), F.lit(0))).drop("rules")


def host_links(pages: DataFrame) -> DataFrame:
    """Distinct links between different hosts: ``u`` (has the link) and ``v``. Reads ``url`` and ``html``."""
    named = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1))
    targets = F.array_distinct(F.transform(named, lambda x: F.translate(x, UPPER, LOWER)))
    flat = pages.select(host_and_path("url")[0].alias("u"), F.explode(targets).alias("v"))
    return flat.where("u <> '' and u <> v").distinct()


def spread(seeds: DataFrame, links: DataFrame, rounds: int = ROUNDS, damping: int = DAMPING) -> DataFrame:
    """``host``, ``trust``, ``distrust`` of all hosts that links or seeds reach. ``seeds``: ``host``, ``trust``,
    ``distrust``, in parts of ``UNIT``.

    Both kinds go in one table, ``k`` 0 along links and 1 against them, so a round is one join and one sum.
    """
    both = F.explode(F.array(F.struct(F.lit(0).alias("k"), "u", "v"), F.struct(F.lit(1).alias("k"), F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")
    edges = materialise(links.select(both).select("e.k", "e.u", "e.v"))
    degrees = materialise(edges.groupBy("k", "u").agg(F.count(F.lit(1)).alias("degree")))
    kinds = F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("trust").alias("seed")), F.struct(F.lit(1).alias("k"), F.col("distrust").alias("seed")))).alias("s")
    start = seeds.select(F.col("host").alias("u"), kinds).select("s.k", "u", _div(F.col("s.seed") * (100 - damping), 100).alias("score")).where("score > 0")
    start = materialise(start)
    scores, idle = start, edges.isEmpty()
    for _ in range(0 if idle else rounds):
        out = scores.join(degrees, ["k", "u"]).select("k", "u", _div(F.col("score"), F.col("degree")).alias("part")).where("part > 0")
        came = edges.join(out, ["k", "u"]).groupBy("k", F.col("v").alias("u")).agg(F.sum("part").alias("came"))
        # damping of a sum that may be near 2^63: whole hundreds and the rest apart
        share = _div(F.col("came"), 100) * damping + _div((F.col("came") % 100) * damping, 100)
        new = materialise(start.unionByName(came.select("k", "u", share.alias("score"))).groupBy("k", "u").agg(F.sum("score").alias("score")).where("score > 0"))
        settled = new.exceptAll(scores).isEmpty()
        if scores is not start:
            discard(scores)
        scores = new
        if settled:
            break
    total = lambda k: F.sum(F.when(F.col("k") == k, F.col("score")).otherwise(0))
    return scores.groupBy(F.col("u").alias("host")).agg(total(0).alias("trust"), total(1).alias("distrust"))


def judged(pages: DataFrame, rules: DataFrame, rounds: int = ROUNDS, damping: int = DAMPING, least: int = LEAST) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``trust`` and ``distrust`` of the host. ``pages`` is read
    twice, the html once and by itself."""
    host, path = host_and_path("url")
    met = materialise(ruled(pages.select("page_id", host.alias("host"), path.alias("path")), rules))
    rated = lambda verdict: _div(F.lit(UNIT).cast("long") * F.count(F.when(F.col("r.verdict") == verdict, 1)), F.count(F.lit(1)))
    seeds = met.where("host <> ''").groupBy("host").agg(rated("allow").alias("trust"), rated("block").alias("distrust")).where("trust > 0 or distrust > 0")
    scores = spread(seeds, host_links(pages.select("url", "html")), rounds, damping)
    none = F.lit(0).cast("long")
    out = met.join(scores, "host", "left").withColumns({"trust": F.coalesce("trust", none), "distrust": F.coalesce("distrust", none)})
    by_host = F.when((F.col("distrust") > F.col("trust")) & (F.col("distrust") >= least), "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", by_host).alias("verdict"), "trust", "distrust")


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(RULES), "verdict string, host string, path string")
    return judged(table(spark, sf_dir, "pages").select("page_id", "url", "html"), rules)


QUERIES = {"op12_url_filter": op12_url_filter}


def _oracle() -> str:
    """The same rules as SQL, every round a table of its own."""
    values = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    rounds = "".join(
        f""", s{i + 1} AS MATERIALIZED (
  SELECT k, u, sum(x) AS x FROM (SELECT * FROM s0 UNION ALL (
    SELECT k, v, (sum(x // degree) * {DAMPING}) // 100 FROM s{i} JOIN edge USING (k, u) JOIN degree USING (k, u) GROUP BY ALL)) GROUP BY ALL
)"""
        for i in range(ROUNDS)
    )
    link = """(?i)\\b(?:href|src)[\\x20\\x09-\\x0D]*=[\\x20\\x09-\\x0D]*["'']?[\\x20\\x09-\\x0D]*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''<>\\x20\\x09-\\x0D]+)"""
    lower = lambda x: f"translate({x}, '{UPPER}', '{LOWER}')"
    return f"""
WITH rule AS (
  SELECT * FROM (VALUES {values}) r(verdict, rhost, rpath)
), page AS (
  SELECT page_id, html, row_number() OVER () AS id, {lower("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT *, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)
), best AS (
  SELECT id, rhost || rpath AS rule, verdict FROM page JOIN rule ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY length(rhost || rpath) DESC, verdict DESC) = 1
), met AS (
  SELECT page.*, rule, verdict FROM page LEFT JOIN best USING (id)
), link AS (
  SELECT DISTINCT host AS a, {lower("unnest(regexp_extract_all(html, '" + link + "', 1))")} AS b FROM page WHERE host <> ''
), edge AS (
  SELECT 0 AS k, a AS u, b AS v FROM link WHERE a <> b UNION ALL SELECT 1, b, a FROM link WHERE a <> b
), degree AS (
  SELECT k, u, count(*) AS degree FROM edge GROUP BY ALL
), seed AS (
  SELECT host, {UNIT} * count(*) FILTER (verdict = 'allow') // count(*) AS t, {UNIT} * count(*) FILTER (verdict = 'block') // count(*) AS d FROM met WHERE host <> '' GROUP BY ALL
), s0 AS (
  SELECT 0 AS k, host AS u, t * {100 - DAMPING} // 100 AS x FROM seed WHERE t > 0 UNION ALL SELECT 1, host, d * {100 - DAMPING} // 100 FROM seed WHERE d > 0
){rounds}, score AS (
  SELECT u AS host, sum(CASE WHEN k = 0 THEN x ELSE 0 END) AS t, sum(CASE WHEN k = 1 THEN x ELSE 0 END) AS d FROM s{ROUNDS} GROUP BY ALL
)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN coalesce(d, 0) > coalesce(t, 0) AND d >= {LEAST} THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(t, 0)::BIGINT AS trust, coalesce(d, 0)::BIGINT AS distrust
FROM met LEFT JOIN score USING (host)
"""


ORACLES: dict[str, str] = {"op12_url_filter": _oracle()}
