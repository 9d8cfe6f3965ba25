"""Linking units of competency to occupations: candidates with a confidence, the best per pair, one primary per unit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skillweave.functions import codes
from skillweave.operators.upsert import first_by

# Confidence of each way in which a unit meets an occupation.
CONFIDENCE = {"direct": 1.00, "core_native": 0.85, "core_imported": 0.70, "elective_native": 0.50, "elective_imported": 0.40, "task": 0.30}
STRONG = 0.70
SHORTEST_CODE = 4

_LINK = ["uoc_code", "anzsco_code", "anzsco_title", "industry_sector", "confidence", "mapping_source", "source_qual_code", "step"]


def _decimal(value: float):
    return F.lit(f"{value:.3f}").cast("decimal(5,3)")


def current_qualifications(quals: DataFrame) -> DataFrame:
    """Codes of the qualifications whose last snapshot says Current."""
    last = first_by(quals, ["qual_code"], [F.col("snapshot_date").desc_nulls_last(), F.col("ingested_at").desc_nulls_last(), F.col("id").desc()])
    return last.where(F.lower(F.trim("status")) == "current").select("qual_code", "qual_title", "aqf_level")


def direct_candidates(classifications: DataFrame) -> DataFrame:
    """Links that a unit's own classification states: (uoc_code, code, value)."""
    code = codes.effective_code(F.col("code"), F.col("value"))
    return classifications.select(
        "uoc_code", code.alias("anzsco_code"), F.lit("").alias("anzsco_title"), F.lit(None).cast("string").alias("industry_sector"),
        _decimal(CONFIDENCE["direct"]).alias("confidence"), F.lit("direct").alias("mapping_source"), F.lit(None).cast("string").alias("source_qual_code"), F.lit(1).alias("step"),
    ).where(F.length("anzsco_code") >= SHORTEST_CODE)


def qualification_candidates(memberships: DataFrame, quals: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Links over current qualifications: a member unit meets the occupations that its qualification is for."""
    key = lambda c: F.upper(F.trim(F.col(c)))
    core, foreign = F.lower(F.trim("membership_type")) == "core", F.coalesce("is_imported", F.lit(False))
    source = F.concat(F.when(core, "core").otherwise("elective"), F.when(foreign, "_imported").otherwise("_native"))
    table = F.create_map(*[x for k, v in CONFIDENCE.items() for x in (F.lit(k), _decimal(v))])
    members = memberships.select(key("uoc_code").alias("uoc_code"), key("qual_code").alias("qual_code"), source.alias("mapping_source"))
    # A unit may be listed several times in the same way; pre-aggregation keeps the fan-out to what differs.
    members = members.where("uoc_code <> '' and qual_code <> ''").distinct()
    aims = taxonomy.select(
        key("qual_code").alias("qual_code"), codes.effective_code(F.col("anzsco_identifier"), F.lit("")).alias("anzsco_code"),
        F.coalesce("occupation_titles", F.lit("")).alias("anzsco_title"), "industry_sector",
    ).where(F.length("anzsco_code") >= SHORTEST_CODE).distinct()
    return (
        members.join(quals.select("qual_code"), "qual_code").join(aims, "qual_code")
        .select("uoc_code", "anzsco_code", "anzsco_title", "industry_sector", F.element_at(table, F.col("mapping_source")).alias("confidence"), "mapping_source", F.col("qual_code").alias("source_qual_code"), F.lit(2).alias("step"))
    )


def task_candidates(matches: DataFrame, strong: DataFrame) -> DataFrame:
    """Weak links by text, only for units without a strong link; matches: (uoc_code, anzsco_code, anzsco_title)."""
    rest = matches.join(strong.select("uoc_code").distinct(), "uoc_code", "left_anti")
    return rest.select(
        "uoc_code", "anzsco_code", "anzsco_title", F.lit(None).cast("string").alias("industry_sector"), _decimal(CONFIDENCE["task"]).alias("confidence"),
        F.lit("asc_specialist_task").alias("mapping_source"), F.lit(None).cast("string").alias("source_qual_code"), F.lit(3).alias("step"),
    ).where(F.length("anzsco_code") > 0)


def best_links(candidates: DataFrame) -> DataFrame:
    """Of each (unit, occupation) the link of highest confidence; earlier steps, then the smaller codes win ties."""
    order = [F.col("confidence").desc(), F.col("step"), F.col("source_qual_code").asc_nulls_first(), F.col("anzsco_title"), F.col("industry_sector").asc_nulls_first()]
    best = first_by(candidates.where(F.col("anzsco_code") != "").select(*_LINK), ["uoc_code", "anzsco_code"], order)
    return best.withColumn("anzsco_major_group", codes.major_group(F.col("anzsco_code")))


def with_primary(links: DataFrame) -> DataFrame:
    """is_primary marks one link per unit; `ties` counts the links that share the highest confidence."""
    unit = Window.partitionBy("uoc_code")
    rank = F.row_number().over(unit.orderBy(F.col("confidence").desc_nulls_last(), F.col("anzsco_code"), F.col("source_qual_code").asc_nulls_first()))
    top = F.max("confidence").over(unit)
    marked = links.withColumn("is_primary", rank == 1).withColumn("is_top", F.col("confidence") == top)
    return marked.withColumn("ties", F.sum(F.col("is_top").cast("bigint")).over(unit))


def current_primary(links: DataFrame) -> DataFrame:
    """One open primary link per unit of a link table."""
    held = links.where(F.col("is_primary") & F.col("valid_to").isNull())
    return first_by(held, ["uoc_code"], [F.col("confidence").desc_nulls_last(), F.col("anzsco_code"), F.col("id")])


def coverage(units: DataFrame, links: DataFrame) -> DataFrame:
    """One row on how far the links reach; the mean is summed in thousandths, so its rounding doesn't depend on the order."""
    joined = units.select("uoc_code").join(links.select("uoc_code", "anzsco_code", "confidence"), "uoc_code", "left")
    linked = F.col("anzsco_code").isNotNull()
    summed = joined.agg(
        F.count_distinct("uoc_code").alias("n_units"), F.count_distinct(F.when(linked, F.col("uoc_code"))).alias("n_linked"),
        F.count_distinct(F.when(F.col("confidence") >= STRONG, F.col("uoc_code"))).alias("n_strong"),
        F.count_distinct("anzsco_code").alias("n_occupations"), F.sum((F.col("confidence") * 1000).cast("bigint")).alias("_s"), F.count("confidence").alias("_n"),
    )
    mean = F.when(F.col("_n") > 0, F.expr("(2 * _s + _n) div (2 * _n)").cast("double") / 1000)  # half up
    return summed.withColumn("mean_confidence", mean).drop("_s", "_n")
