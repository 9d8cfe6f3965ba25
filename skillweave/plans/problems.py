"""Queries of the general data problems (history, packed fields, references)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillweave.operators import history, packed, references
from skillweave.plans.tables import table

_REF_FIELDS = (
    ("uoc_qual_memberships", "uoc_code", "uoc"),
    ("uoc_qual_memberships", "qual_code", "qual"),
    ("rsd_skill_records", "unit_code", "uoc"),
    ("qual_taxonomy_links", "qual_code", "qual"),
)
_PACKED = (
    ("tga_qualifications_updated", "row_id", ("core_unit_codes", "elective_unit_codes", "taxonomy_occupation")),
    ("rsd_skill_records", "id", ("keywords",)),
)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Versions of qualifications and of occupation links."""
    tidy = lambda c: F.coalesce(F.lower(F.trim(F.col(c))), F.lit(""))
    quals = history.version_history(
        table(spark, d, "qual_registry"),
        entity=F.col("qual_code"),
        at=F.col("snapshot_date"),
        state=[tidy("status"), tidy("superseded_by")],
        latest_by=[F.col("ingested_at"), F.col("id")],
    )
    links = history.version_history(
        table(spark, d, "uoc_occupation_links").where(F.col("source_qual_code").isNotNull()),
        entity=F.concat_ws("|", F.coalesce("uoc_code", F.lit("")), F.coalesce("anzsco_code", F.lit("")), "source_qual_code"),
        at=F.col("valid_from"),
        state=[F.col("confidence"), F.col("mapping_source")],
        latest_by=[F.col("created_at"), F.col("id")],
        until=F.col("valid_to"),
        period=F.date_format("valid_from", "yyyy-MM"),
        only_changed=True,
    )
    moment = lambda c, form: F.coalesce(F.date_format(F.timestamp_micros(c), form), F.lit(""))
    shaped = lambda v, name, form: v.select(F.lit(name).alias("src_table"), F.col("entity").alias("entity_key"), moment("valid_from", form).alias("valid_from"), moment("valid_to", form).alias("valid_to"))
    return shaped(quals, "qual_registry", "yyyy-MM-dd").unionByName(shaped(links, "uoc_occupation_links", "yyyy-MM-dd HH:mm:ss"))


def p2_appended(spark: SparkSession, d: str) -> DataFrame:
    """The history of the qualifications up to the last snapshot but one, with the last snapshot appended to it."""
    tidy = lambda c: F.coalesce(F.lower(F.trim(F.col(c))), F.lit(""))
    rows = table(spark, d, "qual_registry").where(F.col("qual_code").isNotNull() & F.col("snapshot_date").isNotNull())
    rows = rows.select("qual_code", "snapshot_date", "ingested_at", "id", tidy("status").alias("status"), tidy("superseded_by").alias("superseded_by"))
    last = rows.agg(F.max("snapshot_date").alias("at"))  # one row
    told = rows.crossJoin(F.broadcast(last)).withColumn("is_last", F.col("snapshot_date") == F.col("at"))
    order = [F.col("ingested_at"), F.col("id")]
    held = history.version_history(told.where("not is_last"), entity=F.col("qual_code"), at=F.col("snapshot_date"), state=[F.col("status"), F.col("superseded_by")], latest_by=order)
    of = lambda n: F.split("state", "\x1f")[n]
    day = lambda c: F.timestamp_micros(c).cast("date")
    before = held.select(F.col("entity").alias("qual_code"), of(0).alias("status"), of(1).alias("superseded_by"), day("valid_from").alias("valid_from"), day("valid_to").alias("valid_to"))
    final = told.where("is_last").groupBy("qual_code").agg(F.max_by(F.struct("status", "superseded_by"), F.struct(*order)).alias("x")).select("qual_code", "x.*")
    at = last.first()["at"]
    found = history.append_snapshot(before, final, "qual_code", ["status", "superseded_by"], F.lit(at).cast("date"))
    return found.select("qual_code", "status", "superseded_by", *[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("valid_from", "valid_to")])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Items of the packed fields, one per row."""
    return packed.unpack([packed.cells(table(spark, d, t), t, row_id, f) for t, row_id, fields in _PACKED for f in fields])


def _dangling(spark: SparkSession, d: str) -> DataFrame:
    said_deleted = lambda c: F.lower(F.trim(F.col(c))) == "deleted"
    units = references.parent_intervals(
        table(spark, d, "uoc_registry"), key=F.col("uoc_code"), received=F.col("ingested_at"),
        deleted=said_deleted("usage_recommendation"), latest_by=[F.col("ingested_at"), F.col("release_number")],
    )
    quals = references.parent_intervals(
        table(spark, d, "qual_registry"), key=F.col("qual_code"), received=F.col("ingested_at"),
        deleted=said_deleted("status"), latest_by=[F.col("snapshot_date"), F.col("ingested_at"), F.col("id")],
    )
    refs = [references.references(table(spark, d, t), name=t, field=f, registry=r) for t, f, r in _REF_FIELDS]
    return references.dangling(refs, {"uoc": units, "qual": quals})


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Dangling references of the four reference fields."""
    return _dangling(spark, d).select("src_table", "ref_field", "row_id", "reason")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Dangling references per table, field, month and reason."""
    return references.dangling_report(_dangling(spark, d))


QUERIES = {"p2_found": p2_found, "p2_appended": p2_appended, "p4_found": p4_found, "p6_found": p6_found, "p6_report": p6_report}

_REGISTRY_SQL = """
WITH u AS (SELECT upper(trim(uoc_code)) code, min(ingested_at) since, bool_or(lower(trim(usage_recommendation)) = 'deleted') deleted
           FROM uoc_registry GROUP BY 1),
q0 AS (SELECT upper(trim(qual_code)) code, ingested_at, status,
              row_number() OVER (PARTITION BY upper(trim(qual_code)) ORDER BY snapshot_date DESC, ingested_at DESC, id DESC) rn FROM qual_registry),
q AS (SELECT code, min(ingested_at) since, bool_or(rn = 1 AND lower(trim(status)) = 'deleted') deleted FROM q0 GROUP BY 1),
p AS (SELECT 'uoc' registry, * FROM u UNION ALL SELECT 'qual', * FROM q),
r AS (
  SELECT 'uoc_qual_memberships' src_table, 'uoc_code' ref_field, id row_id, upper(trim(uoc_code)) code, created_at, 'uoc' registry FROM uoc_qual_memberships
  UNION ALL SELECT 'uoc_qual_memberships', 'qual_code', id, upper(trim(qual_code)), created_at, 'qual' FROM uoc_qual_memberships
  UNION ALL SELECT 'rsd_skill_records', 'unit_code', id, upper(trim(unit_code)), created_at, 'uoc' FROM rsd_skill_records
  UNION ALL SELECT 'qual_taxonomy_links', 'qual_code', id, upper(trim(qual_code)), created_at, 'qual' FROM qual_taxonomy_links),
f AS (
  SELECT r.*, CASE WHEN p.code IS NULL THEN 'missing' WHEN p.deleted THEN 'deleted' WHEN p.since > r.created_at THEN 'late' END reason
  FROM r LEFT JOIN p ON p.registry = r.registry AND p.code = r.code WHERE r.code <> '')
"""

ORACLE = {
    "p2_found": """
WITH q1 AS (SELECT qual_code k, snapshot_date a, coalesce(lower(trim(status)), '') || chr(31) || coalesce(lower(trim(superseded_by)), '') s,
                   row_number() OVER (PARTITION BY qual_code, snapshot_date ORDER BY ingested_at DESC, id DESC) rn
            FROM qual_registry WHERE qual_code IS NOT NULL AND snapshot_date IS NOT NULL),
q2 AS (SELECT k, a, s, lag(s) OVER (PARTITION BY k ORDER BY a) p FROM q1 WHERE rn = 1),
q3 AS (SELECT k, a, lead(a) OVER (PARTITION BY k ORDER BY a) n FROM q2 WHERE p IS NULL OR p <> s),
l1 AS (SELECT uoc_code || '|' || anzsco_code || '|' || source_qual_code k, valid_from a,
              coalesce(CAST(confidence AS VARCHAR), '~') || chr(31) || coalesce(mapping_source, '~') s, valid_to v,
              row_number() OVER (PARTITION BY uoc_code, anzsco_code, source_qual_code, valid_from ORDER BY created_at DESC, id DESC) rn
       FROM uoc_occupation_links WHERE source_qual_code IS NOT NULL AND valid_from IS NOT NULL),
l2 AS (SELECT k, a, s, lag(s) OVER w p, last_value(CASE WHEN v > a THEN v END) OVER (PARTITION BY k ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) u
       FROM l1 WHERE rn = 1 WINDOW w AS (PARTITION BY k ORDER BY a)),
l3 AS (SELECT k, a, coalesce(lead(a) OVER (PARTITION BY k ORDER BY a), u) n, count(*) OVER (PARTITION BY k) c FROM l2 WHERE p IS NULL OR p <> s)
SELECT 'qual_registry' src_table, k entity_key, strftime(a, '%Y-%m-%d') valid_from, coalesce(strftime(n, '%Y-%m-%d'), '') valid_to FROM q3
UNION ALL
SELECT 'uoc_occupation_links', k, strftime(a, '%Y-%m-%d %H:%M:%S'), coalesce(strftime(n, '%Y-%m-%d %H:%M:%S'), '') FROM l3 WHERE c > 1
""",
    "p2_appended": """
WITH q1 AS (SELECT qual_code, snapshot_date a, coalesce(lower(trim(status)), '') status, coalesce(lower(trim(superseded_by)), '') superseded_by FROM qual_registry WHERE qual_code IS NOT NULL AND snapshot_date IS NOT NULL
            QUALIFY row_number() OVER (PARTITION BY qual_code, snapshot_date ORDER BY ingested_at DESC, id DESC) = 1),
q2 AS (SELECT *, lag(status || chr(31) || superseded_by) OVER (PARTITION BY qual_code ORDER BY a) p FROM q1)
SELECT qual_code, status, superseded_by, strftime(a, '%Y-%m-%d') valid_from, strftime(lead(a) OVER (PARTITION BY qual_code ORDER BY a), '%Y-%m-%d') valid_to FROM q2 WHERE p IS NULL OR p <> status || chr(31) || superseded_by
""",
    "p4_found": """
WITH c AS (SELECT 'tga_qualifications_updated' src_table, row_id, unnest(['core_unit_codes', 'elective_unit_codes', 'taxonomy_occupation']) field, unnest([core_unit_codes, elective_unit_codes, taxonomy_occupation]) t FROM tga_qualifications_updated
  UNION ALL SELECT 'rsd_skill_records', id, 'keywords', keywords FROM rsd_skill_records),
l AS (SELECT src_table, row_id, field, list_filter(list_transform(regexp_extract_all(t, '(?:"(?:[^"]|"")*"|“[^”]*”|[^,;|•\t\r\n"“])+'), lambda x: trim(x, ' ' || chr(160) || chr(8203))), lambda x: x <> '') l
  FROM c WHERE t IS NOT NULL AND upper(trim(t)) NOT IN ('', 'N/A')),
i AS (SELECT src_table, row_id, field, list_filter(list_transform(l, lambda x: CASE WHEN length(x) > 1 AND x[1] IN ('"', '“') AND x[-1] IN ('"', '”') THEN trim(replace(x[2:-2], '""', '"')) ELSE x END), lambda x: x <> '') l FROM l)
SELECT src_table, row_id, field, generate_subscripts(l, 1)::BIGINT pos, unnest(l) item FROM i
""",
    "p6_found": _REGISTRY_SQL + "SELECT src_table, ref_field, row_id, reason FROM f WHERE reason IS NOT NULL",
    "p6_report": _REGISTRY_SQL + """SELECT src_table, ref_field, strftime(created_at, '%Y-%m') "month", reason, count(*) n_refs, count(DISTINCT code) n_codes
FROM f WHERE reason IS NOT NULL GROUP BY ALL""",
}
