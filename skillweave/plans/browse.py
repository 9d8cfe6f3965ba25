"""Queries behind selection lists, slices, samples and displayed columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skillweave.functions import codes
from skillweave.functions import text as tx
from skillweave.operators import linkage
from skillweave.plans import skills as sk
from skillweave.plans.analytics import _classes
from skillweave.plans.links import PRIMARY_SQL
from skillweave.plans.tables import table

#: Rows of a sample and of a slice (the features themselves).
SAMPLE, SLICE = 500, (100, 199)


def option_lists(spark: SparkSession, d: str) -> DataFrame:
    """Distinct values of the fields that can be selected by, in order."""
    rows = table(spark, d, "rsd_skill_records")
    every = [rows.where(F.col(c).isNotNull()).select(F.lit(c).alias("field"), F.col(c).alias("value")).distinct() for c in ("tp_code", "bart_model", "run_id")]
    listed = reduce(DataFrame.unionByName, every)
    return listed.withColumn("place", F.row_number().over(Window.partitionBy("field").orderBy("value")))


def group_sizes(spark, d):
    """Groups for a selection list: training packages and domains by number of statements, then by name."""
    rows = _classes(spark, d)
    sizes = [rows.where(F.col(c).isNotNull()).groupBy(F.lit(c).alias("kind"), F.col(c).alias("name")).agg(F.count("*").alias("n")) for c in ("tp_code", "domain")]
    listed = sizes[0].unionByName(sizes[1])
    label = F.format_string("%s (%d)", "name", "n")
    return listed.select("kind", "name", "n", label.alias("label"), F.row_number().over(Window.partitionBy("kind").orderBy(F.col("n").desc(), "name")).alias("place"))


def sampled_records(spark, d):
    """A sample that is always the same: the records with the smallest digests, then those of one package."""
    rows = table(spark, d, "rsd_skill_records").where(tx.has_text(F.col("skill_statement"))).select("id", "tp_code", F.md5(F.concat(F.col("id").cast("string"), F.lit("|42"))).alias("draw"))
    first = rows.agg(F.min("tp_code").alias("chosen"))
    return rows.orderBy("draw").limit(SAMPLE).crossJoin(F.broadcast(first)).where("tp_code = chosen").select("id", "tp_code")  # one row


def batch_slice(spark, d):
    """Rows of every run from one place to another, in input order."""
    return table(spark, d, "rsd_skill_records").where(F.col("row_index").between(*SLICE)).select("run_id", "row_index", "id", "element_title").orderBy("run_id", "row_index", "id")


def filtered_records(spark, d):
    """Statements of some domains and verb groups within a range of complexity; a filter without values lets all through."""
    chosen: dict[str, tuple[str, ...]] = {"domain": ("Lab/Science", "Business", "Construction"), "verb_group": ("Analyse", "Apply", "Other"), "tp_code": ()}
    rows = _classes(spark, d)
    for c, values in chosen.items():
        rows = rows.where(F.col(c).isin(*values)) if values else rows
    return rows.where(F.col("complexity").between(3.0, 9.0)).select("id", "domain", "verb_group", "complexity")


def display_columns(spark, d):
    """Shortened labels, ordinals, marker sizes, rounded scores, search addresses and times as they are displayed."""
    rows = table(spark, d, "rsd_skill_records").where(tx.has_text(F.col("skill_statement"))).select("id", "unit_code", "element_title", "skill_statement", "created_at", "bart_temperature", tx.domain(F.col("skill_statement")).alias("domain"), tx.complexity(F.col("skill_statement")).alias("c"))
    ordinal = F.array_position(F.array(*[F.lit(x) for x in [*tx.DOMAINS, "General"]]), F.col("domain")) - 1
    return rows.select(
        "id", F.substring("element_title", 1, 20).alias("label"), ordinal.cast("int").alias("ordinal"), F.greatest(F.least(F.col("c") * 2, F.lit(18.0)), F.lit(3.0)).alias("marker"),
        F.coalesce(F.col("domain") == "Business", F.lit(False)).alias("highlighted"), F.bround(F.col("c") * 0.25, 1).alias("half_even"), F.round(F.col("c") * 0.25, 1).alias("half_up"),
        F.concat(F.lit("https://example.org/search?text="), F.replace(F.url_encode(F.substring("element_title", 1, 500)), F.lit("+"), F.lit("%20")), F.lit("&limit=3")).alias("address"),
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("stamp"),
    )


def statement_record(spark, d):
    """Alignment of every linked record's unit to its occupation, with the sector only where there is one."""
    primary = linkage.current_primary(table(spark, d, "uoc_occupation_links")).select("uoc_code", "anzsco_code", "anzsco_title", "confidence", "asced_code")
    rows = table(spark, d, "rsd_skill_records").select("id", "unit_code")
    joined = rows.join(primary, rows.unit_code == primary.uoc_code)
    aligned = F.struct("anzsco_code", "anzsco_title", codes.occupation_uri(F.col("anzsco_code")).alias("uri"), F.round("confidence", 3).cast("string").alias("confidence"), "asced_code")
    return joined.select("id", F.to_json(aligned).alias("alignment"))


def requested_units(spark, d):
    """Asked for units with what is known of them; an unknown unit gives an error instead."""
    asked = table(spark, d, "uoc_qual_memberships").where("trim(uoc_code) <> ''").select(F.upper(F.trim("uoc_code")).alias("uoc_code")).distinct()
    known = table(spark, d, "uoc_registry").select(F.upper(F.trim("uoc_code")).alias("k"), "uoc_title")
    found = asked.join(known, F.col("uoc_code") == F.col("k"), "left")
    unknown = F.to_json(F.struct(F.concat(F.lit("no unit "), "uoc_code").alias("error")))
    return found.select("uoc_code", F.when(F.col("k").isNull(), unknown).otherwise(F.to_json(F.struct("uoc_code", "uoc_title"), {"ignoreNullFields": "false"})).alias("record"))


def present_tables(spark, d):
    """Which of the tables that an analysis needs are in the folder, and whether they hold rows."""
    jvm = spark.sparkContext._jvm

    def state(name: str) -> tuple[str, bool, bool]:
        path = jvm.org.apache.hadoop.fs.Path(f"{d}/{name}.parquet")
        there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        return name, there, there and not table(spark, d, name).limit(1).isEmpty()

    needed = ("uoc_registry", "qual_registry", "uoc_qual_memberships", "qual_taxonomy_links", "uoc_occupation_links", "asc_specialist_tasks")
    return spark.createDataFrame([state(n) for n in needed], "name string, present boolean, filled boolean")


QUERIES = {f.__name__: f for f in (option_lists, group_sizes, sampled_records, batch_slice, filtered_records, display_columns, statement_record, requested_units, present_tables)}

_C = sk.CLASSES_SQL
_ORDINAL = " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate([*tx.DOMAINS, "General"]))

ORACLE = {
    "option_lists": """WITH o AS (SELECT DISTINCT 'tp_code' field, tp_code "value" FROM rsd_skill_records WHERE tp_code IS NOT NULL UNION SELECT DISTINCT 'bart_model', bart_model FROM rsd_skill_records WHERE bart_model IS NOT NULL
  UNION SELECT DISTINCT 'run_id', run_id FROM rsd_skill_records WHERE run_id IS NOT NULL) SELECT field, "value", row_number() OVER (PARTITION BY field ORDER BY "value") place FROM o""",
    "group_sizes": _C + """, g AS (SELECT 'tp_code' kind, tp_code name, count(*) n FROM c WHERE tp_code IS NOT NULL GROUP BY 2 UNION ALL SELECT 'domain', "domain", count(*) FROM c GROUP BY 2)
  SELECT kind, name, n, name || ' (' || n || ')' AS label, row_number() OVER (PARTITION BY kind ORDER BY n DESC, name) place FROM g""",
    "sampled_records": f"""WITH s AS (SELECT id, tp_code FROM rsd_skill_records WHERE skill_statement <> '' ORDER BY md5(id::VARCHAR || '|42') LIMIT {SAMPLE})
  SELECT id, tp_code FROM s WHERE tp_code = (SELECT min(tp_code) FROM rsd_skill_records WHERE skill_statement <> '')""",
    "batch_slice": f"SELECT run_id, row_index, id, element_title FROM rsd_skill_records WHERE row_index BETWEEN {SLICE[0]} AND {SLICE[1]}",
    "filtered_records": _C + """SELECT id, "domain", verb_group, complexity FROM c WHERE "domain" IN ('Lab/Science', 'Business', 'Construction') AND verb_group IN ('Analyse', 'Apply', 'Other') AND complexity BETWEEN 3 AND 9""",
    "display_columns": _C + f"""SELECT c.id, substr(c.element_title, 1, 20) AS label, CASE "domain" {_ORDINAL} END ordinal, greatest(least(complexity * 2, 18.0), 3.0) marker, "domain" = 'Business' highlighted, round_even(complexity * 0.25, 1) half_even, round(complexity * 0.25, 1) half_up,
  'https://example.org/search?text=' || url_encode(substr(c.element_title, 1, 500)) || '&limit=3' address, strftime(r.created_at, '%Y-%m-%dT%H:%M:%SZ') stamp FROM c JOIN rsd_skill_records r USING (id)""",
    "statement_record": f"""WITH {PRIMARY_SQL} SELECT s.id, '{{' || concat_ws(',', '"anzsco_code":"' || anzsco_code || '"', '"anzsco_title":"' || anzsco_title || '"', '"uri":"' || CASE WHEN coalesce(anzsco_code, '') = '' THEN '' ELSE '{codes.OCCUPATION_URI}' || replace(replace(anzsco_code, ' ', ''), '-', '') END || '"',
  '"confidence":"' || confidence || '"', '"asced_code":"' || asced_code || '"') || '}}' alignment FROM rsd_skill_records s JOIN pl ON pl.uoc_code = s.unit_code""",
    "requested_units": """WITH a AS (SELECT DISTINCT upper(trim(uoc_code)) uoc_code FROM uoc_qual_memberships WHERE trim(uoc_code) <> '')
  SELECT a.uoc_code, CASE WHEN u.uoc_code IS NULL THEN '{"error":"no unit ' || a.uoc_code || '"}' ELSE '{"uoc_code":"' || a.uoc_code || '","uoc_title":' || coalesce('"' || uoc_title || '"', 'null') || '}' END record FROM a LEFT JOIN uoc_registry u ON upper(trim(u.uoc_code)) = a.uoc_code""",
    "present_tables": "SELECT unnest(['uoc_registry', 'qual_registry', 'uoc_qual_memberships', 'qual_taxonomy_links', 'uoc_occupation_links', 'asc_specialist_tasks']) name, unnest([true, true, true, true, true, false]) present, unnest([true, true, true, true, true, false]) filled",
}
