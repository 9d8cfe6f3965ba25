"""Queries on units, qualifications and occupation links: joins, linkage, merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skillweave.functions import codes
from skillweave.functions import text as tx
from skillweave.operators import ingest, linkage, upsert
from skillweave.operators.upsert import first_by
from skillweave.plans.tables import table


def _now():
    return F.to_timestamp(F.lit("2025-01-01 00:00:00")).cast("timestamp_ntz")


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    quals = linkage.current_qualifications(table(spark, d, "qual_registry"))
    return linkage.qualification_candidates(table(spark, d, "uoc_qual_memberships"), quals, table(spark, d, "qual_taxonomy_links"))


def linkage_candidates(spark, d):
    """How candidates spread over their sources."""
    return _candidates(spark, d).groupBy("mapping_source", "confidence").agg(F.count("*").alias("n"), F.count_distinct("uoc_code").alias("n_units"), F.count_distinct("anzsco_code").alias("n_occupations"))


def linkage_best(spark, d):
    """Best link of every unit and occupation."""
    return linkage.best_links(_candidates(spark, d)).select("uoc_code", "anzsco_code", "confidence", "mapping_source", "source_qual_code", "anzsco_major_group")


def linkage_primary(spark, d):
    """Primary link of every unit and how many share its confidence."""
    return linkage.with_primary(linkage.best_links(_candidates(spark, d))).where("is_primary").select("uoc_code", "anzsco_code", "confidence", "ties")


def linkage_coverage(spark, d):
    return linkage.coverage(table(spark, d, "uoc_registry"), linkage.best_links(_candidates(spark, d)))


def load_skills(spark, d):
    """Skill records with the current primary occupation of their unit."""
    primary = linkage.current_primary(table(spark, d, "uoc_occupation_links")).select("uoc_code", "anzsco_code", "anzsco_title", "confidence")
    skills = table(spark, d, "rsd_skill_records").where(tx.has_text(F.col("skill_statement"))).select("id", "unit_code", "tp_code")
    return skills.join(primary, skills.unit_code == primary.uoc_code, "left").select("id", "unit_code", "tp_code", "anzsco_code", "anzsco_title", "confidence")


def occupation_skills(spark, d):
    """Statements of each occupation over primary links, counted."""
    primary = linkage.current_primary(table(spark, d, "uoc_occupation_links")).select("uoc_code", "anzsco_code", "anzsco_title", "anzsco_major_group")
    skills = table(spark, d, "rsd_skill_records").where(tx.has_text(F.col("skill_statement"))).select("id", "unit_code", "tp_code")
    joined = primary.join(skills, skills.unit_code == primary.uoc_code)
    return joined.groupBy("anzsco_code").agg(
        F.min("anzsco_title").alias("anzsco_title"), F.min("anzsco_major_group").alias("major_group"), F.count_distinct("uoc_code").alias("n_units"), F.count("*").alias("n_skills"), F.count_distinct("tp_code").alias("n_packages")
    )


def linked_records_top(spark, d):
    """The 500 records of highest confidence, links below 0.5 not counted (a top-k report)."""
    primary = linkage.current_primary(table(spark, d, "uoc_occupation_links")).where("confidence >= 0.5").select("uoc_code", "anzsco_code", "confidence")
    skills = table(spark, d, "rsd_skill_records").select("id", "unit_code")
    return skills.join(primary, skills.unit_code == primary.uoc_code, "left").select("id", "unit_code", "anzsco_code", "confidence").orderBy(F.col("confidence").desc_nulls_last(), "id").limit(500)


def unit_qualifications(spark, d):
    """Current qualifications of every unit, with the highest level."""
    quals = linkage.current_qualifications(table(spark, d, "qual_registry"))
    members = table(spark, d, "uoc_qual_memberships").select(F.upper(F.trim("uoc_code")).alias("uoc_code"), F.upper(F.trim("qual_code")).alias("qual_code"), "is_imported").where("uoc_code <> ''")
    joined = members.join(quals, "qual_code")
    return joined.groupBy("uoc_code").agg(
        F.count_distinct("qual_code").alias("n_quals"), F.bool_or(F.coalesce("is_imported", F.lit(False))).alias("any_imported"), F.bool_and(F.coalesce("is_imported", F.lit(False))).alias("all_imported"),
        F.max(codes.level_rank(F.col("aqf_level"))).alias("best_level"),
    )


def _schemes(spark: SparkSession, d: str) -> DataFrame:
    """Wide taxonomy rows as (qual_code, scheme, value), blanks left out."""
    wide = table(spark, d, "qual_taxonomy_links")
    pairs = (("ANZSCO Identifier", "anzsco_identifier"), ("Industry Sector", "industry_sector"), ("Taxonomy-Occupation", "occupation_titles"))
    long = wide.select("id", F.upper(F.trim("qual_code")).alias("qual_code"), "created_at", F.explode(F.array(*[F.struct(F.lit(s).alias("scheme"), F.trim(c).alias("value")) for s, c in pairs])).alias("x"))
    return long.select("id", "qual_code", "created_at", "x.scheme", "x.value").where("value <> '' and qual_code <> ''")


def taxonomy_long(spark, d):
    return _schemes(spark, d).select("id", "qual_code", "scheme", "value")


def taxonomy_last(spark, d):
    """Of each qualification and scheme the value that arrived last."""
    return _schemes(spark, d).groupBy("qual_code", "scheme").agg(F.max_by("value", F.struct("created_at", "id")).alias("value"))


def taxonomy_routed(spark, d):
    """Values collected into the field that their scheme feeds, distinct and in order."""
    routed = _schemes(spark, d).select("qual_code", tx.routed(F.col("scheme")).alias("field"), "value").distinct()
    return routed.groupBy("qual_code", "field").agg(F.array_join(F.array_sort(F.collect_list("value")), ", ").alias("vals"))


def tidy_taxonomy(spark, d):
    return table(spark, d, "tga_qualifications_updated").select("row_id", tx.tidy_taxonomy(F.col("taxonomy_occupation")).alias("occupations"), F.coalesce(F.size(tx.listed(F.col("taxonomy_occupation"), r"[\n\r;|•]+")), F.lit(0)).alias("n"))


def _derived(spark: SparkSession, d: str) -> DataFrame:
    return ingest.sheet_units(table(spark, d, "tga_qualifications_updated"))


def derived_links(spark, d):
    """Links derived from the packed lists; all of a unit's highest confidence are primary."""
    return ingest.sheet_links(table(spark, d, "tga_qualifications_updated")).select("uoc_code", "source_qual_code", "mapping_source", "confidence", "is_primary", "industry_sector")


def seeded_units(spark, d):
    """Units that the skill records name."""
    return ingest.seed_units(table(spark, d, "rsd_skill_records"))


def derived_memberships(spark, d):
    """Derived memberships that the membership table lacks."""
    known = table(spark, d, "uoc_qual_memberships").select(F.upper(F.trim("uoc_code")).alias("uoc_code"), F.upper(F.trim("qual_code")).alias("qual_code"), F.lower(F.trim("membership_type")).alias("kind"))
    return _derived(spark, d).select("uoc_code", "qual_code", "kind").distinct().join(known.where("uoc_code is not null and qual_code is not null and kind is not null"), ["uoc_code", "qual_code", "kind"], "left_anti")


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "qual_registry")
    split = F.to_date(F.lit("2023-01-01"))
    shape = lambda r: first_by(r, ["qual_code"], [F.col("snapshot_date").desc(), F.col("ingested_at").desc(), F.col("id").desc()]).select("qual_code", "qual_title", "tp_code", "aqf_level", "status")
    return shape(rows.where(F.col("snapshot_date") < split)), shape(rows.where(F.col("snapshot_date") >= split))


def upsert_qualifications(spark, d):
    """Registry of 2022 after the later snapshots: title and status overwritten, level kept where the new one is null."""
    old, new = _snapshots(spark, d)
    return upsert.upsert(old, new, ["qual_code"], {"qual_title": "overwrite", "status": "overwrite", "aqf_level": "coalesce_new_old"})


def upsert_records(spark, d):
    """Skill records with each (run, row) delivered once: the later delivery changes the statement, not the identity."""
    rows = table(spark, d, "rsd_skill_records").select("run_id", "row_index", "unit_code", F.coalesce("skill_statement", F.lit("")).alias("skill_statement"), "rewrite_count", "id")
    w = Window.partitionBy("run_id", "row_index").orderBy("id")
    numbered = rows.withColumn("n", F.row_number().over(w))
    base, delta = numbered.where("n = 1").drop("n"), numbered.where("n > 1").drop("n")
    merged = upsert.upsert(base, delta, ["run_id", "row_index"], {"skill_statement": "overwrite", "rewrite_count": "greatest"}, [F.col("id")])
    return merged.select("run_id", "row_index", "id", "unit_code", F.md5("skill_statement").alias("digest"), "rewrite_count")


def upsert_links(spark, d):
    """Best confidence of each unit and occupation over the runs, with the last source."""
    rows = table(spark, d, "uoc_occupation_links").where("confidence is not null")
    shape = lambda r: first_by(r, ["uoc_code", "anzsco_code"], [F.col("created_at").desc(), F.col("id").desc()]).select("uoc_code", "anzsco_code", "confidence", "mapping_source", "industry_sector")
    half = F.lit("2023-06-01").cast("timestamp_ntz")
    return upsert.upsert(shape(rows.where(F.col("created_at") < half)), shape(rows.where(F.col("created_at") >= half)), ["uoc_code", "anzsco_code"], {"confidence": "greatest", "mapping_source": "overwrite", "industry_sector": "fill_blank"})


def insert_absent(spark, d):
    """Memberships of each unit, qualification and type by the first row that names them."""
    rows = table(spark, d, "uoc_qual_memberships").where("uoc_code is not null and qual_code is not null and membership_type is not null").select("uoc_code", "qual_code", "membership_type", "id")
    half = F.col("id") % 2 == 0
    return upsert.insert_absent(first_by(rows.where(half), ["uoc_code", "qual_code", "membership_type"], [F.col("id")]), rows.where(~half), ["uoc_code", "qual_code", "membership_type"], [F.col("id")])


def expire_links(spark, d):
    """Open and closed links per run after the units of the last run are expired."""
    links = table(spark, d, "uoc_occupation_links").select("uoc_code", "pipeline_run_id", "valid_to")
    last = links.agg(F.max("pipeline_run_id").alias("run"))
    touched = links.join(F.broadcast(last), F.col("pipeline_run_id") == F.col("run"), "left_semi")  # one row
    return upsert.expire(links, touched, "uoc_code", _now()).groupBy("pipeline_run_id").agg(F.count_if(F.col("valid_to").isNull()).alias("n_open"), F.count_if(F.col("valid_to") == _now()).alias("n_expired"), F.count("*").alias("n_rows"))


def backfill_titles(spark, d):
    """Blank unit titles of skill records filled from the registry."""
    rows = table(spark, d, "rsd_skill_records").select("id", "unit_code", "unit_title")
    units = first_by(table(spark, d, "uoc_registry").where("uoc_title is not null"), ["uoc_code"], [F.col("ingested_at"), F.col("uoc_title")])
    return upsert.backfill(rows, units, ("unit_code", "uoc_code"), {"unit_title": "uoc_title"})


def unreferenced_units(spark, d):
    """Registered units that no qualification lists (set difference)."""
    return table(spark, d, "uoc_registry").select("uoc_code").subtract(table(spark, d, "uoc_qual_memberships").select(F.upper(F.trim("uoc_code")).alias("uoc_code")))


def latest_events(spark, d):
    """The last event of every user."""
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("x"), F.count("*").alias("n")).select("user_id", "x.event_id", "x.event_type", "n")


QUERIES = {
    f.__name__: f
    for f in (
        linkage_candidates, linkage_best, linkage_primary, linkage_coverage, load_skills, occupation_skills, linked_records_top, unit_qualifications, taxonomy_long, taxonomy_last,
        taxonomy_routed, tidy_taxonomy, derived_links, seeded_units, derived_memberships, upsert_qualifications, upsert_records, upsert_links, insert_absent, expire_links, backfill_titles,
        unreferenced_units, latest_events,
    )
}

_CANDIDATES = """
WITH lastq AS (SELECT qual_code, aqf_level, status FROM qual_registry QUALIFY row_number() OVER (PARTITION BY qual_code ORDER BY snapshot_date DESC, ingested_at DESC, id DESC) = 1),
cur AS (SELECT qual_code, aqf_level FROM lastq WHERE lower(trim(status)) = 'current'),
m AS (SELECT DISTINCT upper(trim(uoc_code)) uoc_code, upper(trim(qual_code)) qual_code,
  (CASE WHEN lower(trim(membership_type)) = 'core' THEN 'core' ELSE 'elective' END) || (CASE WHEN coalesce(is_imported, false) THEN '_imported' ELSE '_native' END) mapping_source
  FROM uoc_qual_memberships WHERE trim(uoc_code) <> '' AND trim(qual_code) <> ''),
a AS (SELECT DISTINCT upper(trim(qual_code)) qual_code, trim(anzsco_identifier) anzsco_code, coalesce(occupation_titles, '') anzsco_title, industry_sector FROM qual_taxonomy_links WHERE length(trim(anzsco_identifier)) >= 4),
c AS (SELECT m.uoc_code, a.anzsco_code, a.anzsco_title, a.industry_sector, m.mapping_source, m.qual_code source_qual_code,
  CAST(CASE m.mapping_source WHEN 'core_native' THEN 0.85 WHEN 'core_imported' THEN 0.70 WHEN 'elective_native' THEN 0.50 ELSE 0.40 END AS DECIMAL(5,3)) confidence
  FROM m JOIN cur USING (qual_code) JOIN a USING (qual_code)),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY uoc_code, anzsco_code ORDER BY confidence DESC, source_qual_code, anzsco_title, industry_sector NULLS FIRST) = 1)
"""
_MAJOR = f"""CASE substr(anzsco_code, 1, 1) {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in codes.MAJOR_GROUPS.items())} ELSE '' END"""
PRIMARY_SQL = "pl AS (SELECT * FROM uoc_occupation_links WHERE is_primary AND valid_to IS NULL QUALIFY row_number() OVER (PARTITION BY uoc_code ORDER BY confidence DESC NULLS LAST, anzsco_code, id) = 1)"
_SCHEMES = """
WITH s AS (SELECT id, upper(trim(qual_code)) qual_code, created_at, unnest(['ANZSCO Identifier', 'Industry Sector', 'Taxonomy-Occupation']) scheme, unnest([trim(anzsco_identifier), trim(industry_sector), trim(occupation_titles)]) "value"
  FROM qual_taxonomy_links), t AS (SELECT * FROM s WHERE "value" <> '' AND qual_code <> '')
"""
_DERIVED = f"""
WITH x AS (SELECT qualification_code qual_code, 'core' kind, unnest(string_split_regex(core_unit_codes, '[\\n\\r\\t;|•,]+')) r FROM tga_qualifications_updated
  UNION ALL SELECT qualification_code, 'elective', unnest(string_split_regex(elective_unit_codes, '[\\n\\r\\t;|•,]+')) FROM tga_qualifications_updated),
u AS (SELECT DISTINCT trim(translate(r, '"“”', '')) uoc_code, qual_code, kind FROM x WHERE regexp_matches(trim(translate(r, '"“”', '')), '{tx.UNIT_CODE}'))
"""

ORACLE = {
    "linkage_candidates": _CANDIDATES + "SELECT mapping_source, confidence, count(*) n, count(DISTINCT uoc_code) n_units, count(DISTINCT anzsco_code) n_occupations FROM c GROUP BY ALL",
    "linkage_best": _CANDIDATES + f"SELECT uoc_code, anzsco_code, confidence, mapping_source, source_qual_code, {_MAJOR} anzsco_major_group FROM b",
    "linkage_primary": _CANDIDATES + """, r AS (SELECT *, row_number() OVER (PARTITION BY uoc_code ORDER BY confidence DESC, anzsco_code, source_qual_code) rn, max(confidence) OVER (PARTITION BY uoc_code) mx FROM b),
  t AS (SELECT *, sum((confidence = mx)::INT) OVER (PARTITION BY uoc_code) ties FROM r) SELECT uoc_code, anzsco_code, confidence, ties::BIGINT ties FROM t WHERE rn = 1""",
    "linkage_coverage": _CANDIDATES + """SELECT count(DISTINCT u.uoc_code) n_units, count(DISTINCT CASE WHEN b.anzsco_code IS NOT NULL THEN u.uoc_code END) n_linked, count(DISTINCT CASE WHEN confidence >= 0.7 THEN u.uoc_code END) n_strong,
  count(DISTINCT b.anzsco_code) n_occupations, ((2 * sum((confidence * 1000)::BIGINT) + count(confidence)) // (2 * count(confidence)))::DOUBLE / 1000 mean_confidence FROM uoc_registry u LEFT JOIN b ON b.uoc_code = u.uoc_code""",
    "load_skills": f"WITH {PRIMARY_SQL} SELECT s.id, unit_code, tp_code, anzsco_code, anzsco_title, confidence FROM rsd_skill_records s LEFT JOIN pl ON pl.uoc_code = s.unit_code WHERE skill_statement <> ''",
    "occupation_skills": f"""WITH {PRIMARY_SQL} SELECT anzsco_code, min(anzsco_title) anzsco_title, min(anzsco_major_group) major_group, count(DISTINCT uoc_code) n_units, count(*) n_skills, count(DISTINCT tp_code) n_packages
  FROM pl JOIN rsd_skill_records s ON pl.uoc_code = s.unit_code WHERE skill_statement <> '' GROUP BY 1""",
    "linked_records_top": f"WITH {PRIMARY_SQL} SELECT s.id, unit_code, anzsco_code, confidence FROM rsd_skill_records s LEFT JOIN pl ON pl.uoc_code = s.unit_code AND confidence >= 0.5 ORDER BY confidence DESC NULLS LAST, s.id LIMIT 500",
    "unit_qualifications": _CANDIDATES + f"""SELECT upper(trim(uoc_code)) uoc_code, count(DISTINCT cur.qual_code) n_quals, bool_or(coalesce(is_imported, false)) any_imported, bool_and(coalesce(is_imported, false)) all_imported,
  max(CASE aqf_level {" ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(codes.LEVEL_LABELS, 1))} END) best_level FROM uoc_qual_memberships x JOIN cur ON cur.qual_code = upper(trim(x.qual_code)) WHERE trim(uoc_code) <> '' GROUP BY 1""",
    "taxonomy_long": _SCHEMES + 'SELECT id, qual_code, scheme, "value" FROM t',
    "taxonomy_last": _SCHEMES + 'SELECT qual_code, scheme, "value" FROM t QUALIFY row_number() OVER (PARTITION BY qual_code, scheme ORDER BY created_at DESC, id DESC) = 1',
    "taxonomy_routed": _SCHEMES + """, r AS (SELECT DISTINCT qual_code, CASE scheme WHEN 'ANZSCO Identifier' THEN 'anzsco' WHEN 'Industry Sector' THEN 'industry' ELSE 'occupation' END field, "value" v FROM t)
  SELECT qual_code, field, string_agg(v, ', ' ORDER BY v) vals FROM r GROUP BY ALL""",
    "tidy_taxonomy": """WITH l AS (SELECT row_id, taxonomy_occupation t, list_filter(list_transform(string_split_regex(taxonomy_occupation, '[\\n\\r;|•]+'), lambda x: trim(x)), lambda x: x <> '') l FROM tga_qualifications_updated)
  SELECT row_id, CASE WHEN t IN ('', 'N/A') THEN t ELSE array_to_string(l, ', ') END occupations, coalesce(len(l), 0)::INT n FROM l""",
    "derived_links": _DERIVED.replace("SELECT qualification_code qual_code", "SELECT row_id, taxonomy_industry_sector sec, qualification_code qual_code").replace("SELECT qualification_code,", "SELECT row_id, taxonomy_industry_sector, qualification_code,").replace("qual_code, kind FROM x WHERE", "qual_code, kind, row_id, sec FROM x WHERE") + """,
  o AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY uoc_code, qual_code, kind ORDER BY row_id DESC) = 1)
  SELECT uoc_code, qual_code source_qual_code, kind || '_native' mapping_source, CAST(CASE kind WHEN 'core' THEN 0.5 ELSE 0.4 END AS DECIMAL(5,3)) confidence, (kind = 'core') = bool_or(kind = 'core') OVER (PARTITION BY uoc_code) is_primary,
    CASE WHEN coalesce(trim(sec), '') IN ('', 'N/A', 'nan') THEN '' ELSE trim(sec) END industry_sector FROM o""",
    "seeded_units": """SELECT trim(unit_code) uoc_code, coalesce(nullif(trim(unit_title), ''), '') uoc_title, coalesce(nullif(trim(tp_code), ''), substr(trim(unit_code), 1, 3)) tp_code FROM rsd_skill_records WHERE trim(unit_code) <> ''
  QUALIFY row_number() OVER (PARTITION BY trim(unit_code) ORDER BY coalesce(trim(unit_title), '') = '', id) = 1""",
    "derived_memberships": _DERIVED + "SELECT * FROM u WHERE NOT EXISTS (SELECT 1 FROM uoc_qual_memberships k WHERE upper(trim(k.uoc_code)) = u.uoc_code AND upper(trim(k.qual_code)) = u.qual_code AND lower(trim(k.membership_type)) = u.kind)",
    "upsert_qualifications": """WITH o AS (SELECT * FROM qual_registry WHERE snapshot_date < DATE '2023-01-01' QUALIFY row_number() OVER (PARTITION BY qual_code ORDER BY snapshot_date DESC, ingested_at DESC, id DESC) = 1),
  n AS (SELECT * FROM qual_registry WHERE snapshot_date >= DATE '2023-01-01' QUALIFY row_number() OVER (PARTITION BY qual_code ORDER BY snapshot_date DESC, ingested_at DESC, id DESC) = 1)
  SELECT coalesce(o.qual_code, n.qual_code) qual_code, CASE WHEN n.id IS NULL THEN o.qual_title ELSE n.qual_title END qual_title, CASE WHEN o.id IS NULL THEN n.tp_code ELSE o.tp_code END tp_code,
    coalesce(n.aqf_level, o.aqf_level) aqf_level, CASE WHEN n.id IS NULL THEN o.status ELSE n.status END status FROM o FULL JOIN n ON o.qual_code = n.qual_code""",
    "upsert_records": """WITH r AS (SELECT run_id, row_index, id, unit_code, coalesce(skill_statement, '') s, rewrite_count c, row_number() OVER (PARTITION BY run_id, row_index ORDER BY id) n, row_number() OVER (PARTITION BY run_id, row_index ORDER BY id DESC) m FROM rsd_skill_records)
  SELECT f.run_id, f.row_index, f.id, f.unit_code, md5(l.s) digest, greatest(f.c, l.c) rewrite_count FROM r f JOIN r l ON f.run_id IS NOT DISTINCT FROM l.run_id AND f.row_index IS NOT DISTINCT FROM l.row_index AND l.m = 1 WHERE f.n = 1""",
    "upsert_links": """WITH r AS (SELECT *, created_at >= TIMESTAMP '2023-06-01' late FROM uoc_occupation_links WHERE confidence IS NOT NULL),
  f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY uoc_code, anzsco_code, late ORDER BY created_at DESC, id DESC) = 1), o AS (SELECT * FROM f WHERE NOT late), n AS (SELECT * FROM f WHERE late)
  SELECT coalesce(o.uoc_code, n.uoc_code) uoc_code, coalesce(o.anzsco_code, n.anzsco_code) anzsco_code, greatest(o.confidence, n.confidence) confidence, CASE WHEN n.id IS NULL THEN o.mapping_source ELSE n.mapping_source END mapping_source,
    CASE WHEN n.id IS NULL THEN o.industry_sector WHEN o.id IS NULL OR coalesce(o.industry_sector, '') = '' THEN n.industry_sector ELSE o.industry_sector END industry_sector FROM o FULL JOIN n ON o.uoc_code = n.uoc_code AND o.anzsco_code = n.anzsco_code""",
    "insert_absent": """SELECT uoc_code, qual_code, membership_type, id FROM uoc_qual_memberships WHERE uoc_code IS NOT NULL AND qual_code IS NOT NULL AND membership_type IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY uoc_code, qual_code, membership_type ORDER BY id % 2, id) = 1""",
    "expire_links": """WITH t AS (SELECT DISTINCT uoc_code FROM uoc_occupation_links WHERE pipeline_run_id = (SELECT max(pipeline_run_id) FROM uoc_occupation_links)),
  e AS (SELECT pipeline_run_id, CASE WHEN valid_to IS NULL AND uoc_code IN (SELECT uoc_code FROM t) THEN TIMESTAMP '2025-01-01' ELSE valid_to END v FROM uoc_occupation_links)
  SELECT pipeline_run_id, count(*) FILTER (v IS NULL) n_open, count(*) FILTER (v = TIMESTAMP '2025-01-01') n_expired, count(*) n_rows FROM e GROUP BY 1""",
    "backfill_titles": """WITH u AS (SELECT * FROM uoc_registry WHERE uoc_title IS NOT NULL QUALIFY row_number() OVER (PARTITION BY uoc_code ORDER BY ingested_at, uoc_title) = 1)
  SELECT s.id, s.unit_code, CASE WHEN coalesce(s.unit_title, '') = '' THEN u.uoc_title ELSE s.unit_title END unit_title FROM rsd_skill_records s LEFT JOIN u ON u.uoc_code = s.unit_code""",
    "unreferenced_units": "SELECT uoc_code FROM uoc_registry EXCEPT SELECT upper(trim(uoc_code)) FROM uoc_qual_memberships",
    "latest_events": "SELECT user_id, event_id, event_type, n FROM (SELECT *, count(*) OVER (PARTITION BY user_id) n FROM events) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
}
