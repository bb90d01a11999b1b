"""Checks of extracted facts against their sources, ranges and curated tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.text import let, tokens
from tesserae.schemas import ASSET_CLASSES, CONFIDENCES, SIGNAL_TYPES, UNITS

GROUNDED = 0.7
#: Inclusive ranges by unit, the wide one for test statistics reported as ratios, and the default.
RANGES = {
    "ratio": (-15.0, 20.0),
    "percent": (-500.0, 5000.0),
    "bps": (-50000.0, 500000.0),
    "stddev": (0.0, 500.0),
    "count": (0.0, 1e12),
    "currency": (-1e15, 1e15),
    "other": (-1e12, 1e12),
}
WIDE_NAME = r"(?i)t[\s-]?stat|z[\s-]?stat|f[\s-]?stat|chi[\s-]?square"
WIDE = (-1000.0, 1000.0)
DEFAULT = (-1e12, 1e12)


def grounded_share(quote: Column, source_tokens: Column) -> Column:
    """Share of the quote's words of three letters or more that the source holds; 1 for a quote without any."""
    long = F.filter(tokens(quote), lambda w: F.length(w) >= 3)
    return let(long, lambda q: F.when(F.size(q) == 0, F.lit(1.0)).otherwise(F.size(F.filter(q, lambda w: F.array_contains(source_tokens, w))) / F.size(q)))


def is_grounded(quote: Column, source: Column, threshold: float = GROUNDED) -> Column:
    return let(F.array_distinct(tokens(source)), lambda s: grounded_share(quote, s) >= threshold)


def grounded(quotes: DataFrame, sources: DataFrame, threshold: float = GROUNDED) -> DataFrame:
    """The same for long sources, as a join: ``quotes`` (``quote_id``, ``source_id``, ``quote``) against ``sources``
    (``source_id``, ``text``); returns ``quote_id``, ``share``, ``grounded``."""
    asked = quotes.select("quote_id", "source_id", F.explode(F.filter(tokens(F.col("quote")), lambda w: F.length(w) >= 3)).alias("w"))
    held = sources.select("source_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("w")).withColumn("_in", F.lit(1))
    share = asked.join(held, ["source_id", "w"], "left").groupBy("quote_id").agg((F.sum(F.coalesce("_in", F.lit(0))) / F.count(F.lit(1))).alias("share"))
    out = quotes.select("quote_id").join(share, "quote_id", "left").withColumn("share", F.coalesce("share", F.lit(1.0)))
    return out.withColumn("grounded", F.col("share") >= threshold)


def out_of_range(name: Column, value: Column, unit: Column) -> Column:
    """Outside the unit's range, or not a number."""
    inside = F.lit(None)
    for u, (lo, hi) in RANGES.items():
        inside = F.when(unit == u, value.between(lo, hi)).otherwise(inside) if u != "ratio" else F.when((unit == u) & name.rlike(WIDE_NAME), value.between(*WIDE)).when(unit == u, value.between(lo, hi)).otherwise(inside)
    return ~F.coalesce(inside, value.between(*DEFAULT), F.lit(False)) | F.isnan(value)


def tag_mismatch(extracted: Column, curated: Column) -> Column:
    """Nothing in common, though curated tags exist and neither side is just ``other``."""
    other = F.array(F.lit("other"))
    return (F.size(F.coalesce(curated, F.array().cast("array<string>"))) > 0) & ~F.coalesce(F.arrays_overlap(extracted, curated), F.lit(False)) & (extracted != other) & (curated != other)


def percent_as_ratio(metric: Column) -> Column:
    """The value stands before a per cent sign in its own quote, though its unit is ``ratio``."""
    number = F.regexp_replace(F.regexp_replace(F.abs(metric["value"]).cast("string"), r"\.0$", ""), r"\.", "\\\\.")
    return (metric["unit"] == "ratio") & F.regexp_like(F.coalesce(metric["evidence_quote"], F.lit("")), F.concat(F.lit(r"(?<![\d.])"), number, F.lit(r"0*\s?%")))


def flags(extraction: Column, source: Column, curated_signal: Column, curated_asset: Column, curated: Column, extended: bool = False) -> Column:
    """The ordered list of flags. ``curated`` tells whether there is a curated record. ``extended`` adds a check that the
    ranges can't make: a percentage labelled as a ratio. The names of flags are fixed values: stored records hold them."""
    metrics = extraction["performance_metrics"]
    quoted = lambda m: F.concat(F.lit("'"), m["metric_name"], F.lit("'"))

    def of_metric(m: Column, held: Column) -> Column:
        told = [
            F.when(grounded_share(m["evidence_quote"], held) < GROUNDED, F.concat(F.lit("unverified_quote:"), quoted(m))),
            F.when(out_of_range(m["metric_name"], m["value"], m["unit"]), F.concat(F.lit("metric_out_of_range:"), quoted(m), F.lit("="), m["value"].cast("string"), m["unit"])),
        ]
        if extended:
            told.append(F.when(percent_as_ratio(m), F.concat(F.lit("value_percent_but_ratio:"), quoted(m))))
        return F.array(*told)

    none = F.array(F.when(F.size(metrics) == 0, F.lit("no_performance_metrics_found")))
    by_metric = let(F.array_distinct(tokens(F.coalesce(source, F.lit("")))), lambda held: F.flatten(F.transform(metrics, lambda m: of_metric(m, held))))
    tags = F.when(curated, F.array(F.when(tag_mismatch(extraction["signal_type"], curated_signal), F.lit("signal_type_disagrees_with_curation")), F.when(tag_mismatch(extraction["asset_class"], curated_asset), F.lit("asset_class_disagrees_with_curation")))).otherwise(F.array(F.lit("no_curation_tags_to_cross_check"), F.lit(None)))
    return F.array_compact(F.concat(none, by_metric, tags))


def validate(records: DataFrame, sources: DataFrame, tags: DataFrame, extended: bool = False) -> DataFrame:
    """``records`` with ``new_flags`` (null where there is no source text). ``sources``: ``paper_id``, ``source``;
    ``tags``: ``paper_id`` and two arrays, the last row of a paper counts (``pos`` if present)."""
    known = tags.select("paper_id", F.col("signal_type").alias("_signal"), F.col("asset_class").alias("_asset"))
    rows = records.join(sources.select("paper_id", "source"), "paper_id", "left").join(known, "paper_id", "left")
    curated = F.col("_signal").isNotNull() | F.col("_asset").isNotNull()
    new = F.when(F.col("source").isNotNull(), flags(F.col("extraction"), F.col("source"), F.col("_signal"), F.col("_asset"), curated, extended))
    return rows.withColumn("new_flags", new).drop("_signal", "_asset", "source")


def revalidate(records: DataFrame, sources: DataFrame, tags: DataFrame, extended: bool = False) -> DataFrame:
    """``paper_id``, ``flags`` (old ones where the source is missing) and ``changed``."""
    old = F.coalesce(F.col("extraction_meta.validation_flags"), F.array().cast("array<string>"))
    return validate(records, sources, tags, extended).select("paper_id", F.coalesce("new_flags", old).alias("flags"), (F.col("new_flags").isNotNull() & ~F.col("new_flags").eqNullSafe(old)).alias("changed"))


def flag_counts(flagged: DataFrame) -> DataFrame:
    """How often each kind of flag occurs; ``flagged``: ``flags``."""
    return flagged.select(F.explode("flags").alias("f")).groupBy(F.get(F.split("f", ":"), F.lit(0)).alias("flag")).agg(F.count(F.lit(1)).alias("n"))


def schema_errors(extraction: Column) -> Column:
    """Violations of required fields, enumerations and minimum lengths, as texts."""
    outside = lambda values, allowed: F.size(F.filter(values, lambda x: ~x.isin(list(allowed)))) > 0
    e, text = extraction, ("methodology_summary", "data_period", "universe")
    return F.array_compact(
        F.array(
            F.when(F.coalesce(F.size(e["signal_type"]), F.lit(0)) < 1, "signal_type: empty"),
            F.when(F.coalesce(outside(e["signal_type"], SIGNAL_TYPES), F.lit(False)), "signal_type: value"),
            F.when(F.coalesce(F.size(e["asset_class"]), F.lit(0)) < 1, "asset_class: empty"),
            F.when(F.coalesce(outside(e["asset_class"], ASSET_CLASSES), F.lit(False)), "asset_class: value"),
            *(F.when(e[c].isNull(), f"{c}: missing") for c in text),
            F.when(e["performance_metrics"].isNull(), "performance_metrics: missing"),
            F.when(F.coalesce(outside(F.transform(e["performance_metrics"], lambda m: F.coalesce(m["unit"], F.lit(""))), UNITS), F.lit(False)), "unit: value"),
            F.when(~F.coalesce(e["extraction_confidence"].isin(list(CONFIDENCES)), F.lit(False)), "extraction_confidence: value"),
        )
    )


def split_valid(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records that fit the schema, and the others with their ``errors``."""
    checked = records.withColumn("errors", schema_errors(F.col("extraction")))
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0)
