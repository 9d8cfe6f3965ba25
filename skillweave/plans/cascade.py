"""The whole linkage cascade, and the merges of its results with their policies per column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skillweave.functions import text as tx
from skillweave.operators import linkage, similarity, upsert
from skillweave.operators.upsert import first_by
from skillweave.plans import links
from skillweave.plans.analytics import _TERMS, _weights
from skillweave.plans.tables import table
from skillweave.session import materialise

#: Different statements of a unit that are matched, occupations taken for each, and least cosine.
STATEMENTS, TASKS, LEAST = 20, 3, 0.25


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of the three steps for current units. Links marked direct stand in for a unit's own classifications."""
    units = table(spark, d, "uoc_registry").where(F.lower(F.trim("usage_recommendation")) == "current").select(F.upper(F.trim("uoc_code")).alias("uoc_code"))
    stated = table(spark, d, "uoc_occupation_links").where("mapping_source = 'direct_uoc_classification'")
    direct = linkage.direct_candidates(stated.select(F.upper(F.trim("uoc_code")).alias("uoc_code"), F.col("anzsco_code").alias("code"), F.col("anzsco_title").alias("value")).distinct())
    quals = linkage.current_qualifications(table(spark, d, "qual_registry"))
    found = direct.unionByName(linkage.qualification_candidates(table(spark, d, "uoc_qual_memberships"), quals, table(spark, d, "qual_taxonomy_links")))
    found = materialise(found.join(units, "uoc_code", "left_semi"), "linked")
    # Step 3 is for units without a strong link: their statements against the titles of the occupations.
    weak = units.join(found.where(F.col("confidence") >= linkage.STRONG).select("uoc_code").distinct(), "uoc_code", "left_anti")
    rows = table(spark, d, "rsd_skill_records").where(tx.has_text(F.col("skill_statement"))).select(F.upper(F.trim("unit_code")).alias("uoc_code"), "skill_statement")
    few = first_by(rows.join(weak, "uoc_code", "left_semi").distinct(), ["uoc_code"], [F.col("skill_statement")], STATEMENTS)
    titles = table(spark, d, "anzsco_codes").where(tx.has_text(F.col("anzsco_title"))).select("anzsco_code", "anzsco_title")
    fitted = similarity.term_weights(titles, "anzsco_code", F.col("anzsco_title"))
    df = titles.select("anzsco_code", F.explode(F.array_distinct(tx.content_terms(F.col("anzsco_title")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    n = titles.agg(F.count("*").alias("n"))
    idf = df.crossJoin(F.broadcast(n)).select("term", (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))  # one row
    tf = few.select(F.struct("uoc_code", "skill_statement").alias("q"), F.explode(tx.content_terms(F.col("skill_statement"))).alias("term")).groupBy("q", "term").agg(F.count("*").alias("tf"))
    raw = tf.join(idf, "term").withColumn("raw", F.col("tf") * F.col("idf"))
    asked = raw.select("q", "term", (F.col("raw") / F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("q")))).alias("weight"))
    matches = similarity.best_matches(asked, "q", fitted, "anzsco_code", LEAST, TASKS)
    tasks = linkage.task_candidates(matches.join(titles, "anzsco_code").select("q.uoc_code", "anzsco_code", "anzsco_title").distinct(), found.where(F.col("confidence") >= linkage.STRONG))
    return found.unionByName(tasks)


def linkage_full(spark, d):
    """The best link of every current unit and occupation over all steps, with the primary one of each unit."""
    found = linkage.with_primary(linkage.best_links(_candidates(spark, d)))
    return found.select("uoc_code", "anzsco_code", "confidence", "mapping_source", "source_qual_code", "is_primary", "ties")


def linkage_steps(spark, d):
    """How many links each step of the cascade gives in the end."""
    best = linkage.best_links(_candidates(spark, d))
    return best.groupBy("step", "mapping_source").agg(F.count("*").alias("n"), F.count_distinct("uoc_code").alias("n_units"))


def linkage_merged(spark, d):
    """The link table after the cascade: open links of linked units end, new ones enter as open."""
    new = linkage.with_primary(linkage.best_links(_candidates(spark, d))).select("uoc_code", "anzsco_code", "confidence", "mapping_source", "is_primary")
    held = table(spark, d, "uoc_occupation_links").select("uoc_code", "anzsco_code", "confidence", "mapping_source", "is_primary", "valid_to")
    kept = upsert.expire(held, new, "uoc_code", links._now())
    opened = new.withColumn("valid_to", F.lit(None).cast("timestamp_ntz"))
    both = kept.withColumn("fresh", F.lit(False)).unionByName(opened.withColumn("fresh", F.lit(True)))
    return both.groupBy("uoc_code").agg(F.count_if("fresh").alias("n_new"), F.count_if(F.col("valid_to").isNull()).alias("n_open"), F.count_if(F.col("valid_to") == links._now()).alias("n_ended"), F.count("*").alias("n"))


#: Columns that a record delivered again overwrites; what identifies it stays.
REWORKED = ("skill_statement", "bart_prompt", "qa_one_sentence", "qa_word_count", "qa_has_method", "qa_has_outcome", "qa_passes", "rewrite_count", "bart_model", "bart_temperature", "keywords", "error_message")


def upsert_reworked(spark, d):
    """Skill records by run and row: a later delivery overwrites the twelve worked columns, null as '' in texts."""
    rows = table(spark, d, "rsd_skill_records").withColumns({c: F.coalesce(c, F.lit("")) for c in ("skill_statement", "bart_prompt", "bart_model", "keywords", "error_message")})
    keys = ["run_id", "row_index"]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("id"))
    numbered = rows.withColumn("_n", place)
    merged = upsert.upsert(numbered.where("_n = 1").drop("_n"), numbered.where("_n > 1").drop("_n"), keys, dict.fromkeys(REWORKED, "overwrite"), [F.col("id")])
    return merged.select("run_id", "row_index", "id", "unit_code", "tp_code", "qa_passes", "qa_word_count", "rewrite_count", F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("skill_statement", "bart_prompt", "bart_model", "keywords", "error_message")])).alias("digest"))


def _link_versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "uoc_occupation_links").where("uoc_code is not null and anzsco_code is not null and source_qual_code is not null")
    keys = ["uoc_code", "anzsco_code", "source_qual_code"]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("created_at", "id"))
    columns = [*keys, "anzsco_title", "industry_sector", "is_primary", "confidence", "anzsco_major_group", "created_at", "id"]
    numbered = rows.withColumn("_n", place)
    return numbered.where("_n = 1").select(columns), numbered.where("_n > 1").select(columns)


def _overwritten(spark: SparkSession, d: str, columns: tuple[str, ...]) -> DataFrame:
    base, delta = _link_versions(spark, d)
    merged = upsert.upsert(base, delta, ["uoc_code", "anzsco_code", "source_qual_code"], dict.fromkeys(columns, "overwrite"), [F.col("created_at"), F.col("id")])
    return merged.select("uoc_code", "anzsco_code", "source_qual_code", "anzsco_title", "industry_sector", "is_primary", "confidence", "anzsco_major_group", "id")


def upsert_links_enriched(spark, d):
    """Links by unit, occupation and qualification: titles, sector and primary mark overwritten, confidence kept."""
    return _overwritten(spark, d, ("anzsco_title", "industry_sector", "is_primary"))


def upsert_links_scraped(spark, d):
    """The same with five columns overwritten."""
    return _overwritten(spark, d, ("anzsco_title", "industry_sector", "is_primary", "confidence", "anzsco_major_group"))


def upsert_sheet(spark, d):
    """One row per qualification of the sheet: a later row overwrites all four attributes; blank codes are skipped."""
    rows = table(spark, d, "tga_qualifications_updated").where("trim(qualification_code) <> ''").select(F.trim("qualification_code").alias("qual_code"), "qualification_title", "taxonomy_occupation", "taxonomy_industry_sector", "anzsco_identifier", "row_id")
    place = F.row_number().over(Window.partitionBy("qual_code").orderBy("row_id"))
    numbered = rows.withColumn("_n", place)
    policy = dict.fromkeys(("qualification_title", "taxonomy_occupation", "taxonomy_industry_sector", "anzsco_identifier"), "overwrite")
    return upsert.upsert(numbered.where("_n = 1").drop("_n"), numbered.where("_n > 1").drop("_n"), ["qual_code"], policy, [F.col("row_id")])


def run_log(spark, d):
    """Runs with their settings as JSON, rows, and first and last time."""
    rows = table(spark, d, "rsd_skill_records").where("run_id is not null").groupBy("run_id").agg(F.min_by("bart_model", F.struct("created_at", "id")).alias("model"), F.count("*").alias("n_rows"), F.min("created_at").alias("started_at"), F.max("created_at").alias("finished_at"))
    settings = F.to_json(F.struct("model", F.lit(60).alias("most_words")))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(c)
    return rows.select("run_id", settings.alias("settings"), "n_rows", stamp("started_at"), stamp("finished_at"))


QUERIES = {f.__name__: f for f in (linkage_full, linkage_steps, linkage_merged, upsert_reworked, upsert_links_enriched, upsert_links_scraped, upsert_sheet, run_log)}

_FULL = (
    links._CANDIDATES.rstrip()
    + """,
cu AS (SELECT upper(trim(uoc_code)) uoc_code FROM uoc_registry WHERE lower(trim(usage_recommendation)) = 'current'),
p1 AS (SELECT DISTINCT upper(trim(uoc_code)) uoc_code, trim(coalesce(nullif(trim(anzsco_code), ''), nullif(trim(anzsco_title), ''), '')) anzsco_code FROM uoc_occupation_links WHERE mapping_source = 'direct_uoc_classification'),
q12 AS (SELECT uoc_code, anzsco_code, '' anzsco_title, NULL industry_sector, 'direct' mapping_source, NULL source_qual_code, CAST(1 AS DECIMAL(5,3)) confidence, 1 step FROM p1 WHERE length(anzsco_code) >= 4
  UNION ALL SELECT uoc_code, anzsco_code, anzsco_title, industry_sector, mapping_source, source_qual_code, confidence, 2 FROM c),
l12 AS (SELECT * FROM q12 WHERE uoc_code IN (SELECT uoc_code FROM cu)),
st AS (SELECT DISTINCT upper(trim(unit_code)) uoc_code, skill_statement FROM rsd_skill_records WHERE skill_statement <> ''),
s20 AS (SELECT * FROM st WHERE uoc_code IN (SELECT uoc_code FROM cu) AND uoc_code NOT IN (SELECT uoc_code FROM l12 WHERE confidence >= 0.7) QUALIFY row_number() OVER (PARTITION BY uoc_code ORDER BY skill_statement) <= 20),
"""
    + _weights("SELECT anzsco_code, anzsco_title FROM anzsco_codes WHERE anzsco_title <> ''", "anzsco_code", "anzsco_title")
    + f""",
z1 AS (SELECT uoc_code, skill_statement, unnest({_TERMS("skill_statement")}) term FROM s20), z2 AS (SELECT uoc_code, skill_statement, term, count(*) tf FROM z1 GROUP BY ALL),
z3 AS (SELECT uoc_code, skill_statement, term, tf * (ln((1 + (SELECT count(*) FROM d)) / (1 + df)) + 1) r FROM z2 JOIN dfs USING (term)),
z4 AS (SELECT uoc_code, skill_statement, term, r / sqrt(sum(r * r) OVER (PARTITION BY uoc_code, skill_statement)) wq FROM z3),
z5 AS (SELECT uoc_code, skill_statement, anzsco_code, sum(wq * weight) sim FROM z4 JOIN w USING (term) GROUP BY 1, 2, 3 HAVING sum(wq * weight) >= 0.25),
z6 AS (SELECT * FROM z5 QUALIFY row_number() OVER (PARTITION BY uoc_code, skill_statement ORDER BY round(sim, 9) DESC, anzsco_code) <= 3),
l3 AS (SELECT DISTINCT uoc_code, anzsco_code, anzsco_title, NULL industry_sector, 'asc_specialist_task' mapping_source, NULL source_qual_code, CAST(0.3 AS DECIMAL(5,3)) confidence, 3 step FROM z6 JOIN anzsco_codes USING (anzsco_code)),
every AS (SELECT * FROM l12 UNION ALL SELECT * FROM l3),
best AS (SELECT * FROM every WHERE anzsco_code <> '' QUALIFY row_number() OVER (PARTITION BY uoc_code, anzsco_code ORDER BY confidence DESC, step, source_qual_code NULLS FIRST, anzsco_title, industry_sector NULLS FIRST) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY uoc_code ORDER BY confidence DESC, anzsco_code, source_qual_code NULLS FIRST) = 1 is_primary, max(confidence) OVER (PARTITION BY uoc_code) mx FROM best)
"""
)
_SAME = "uoc_code IS NOT NULL AND anzsco_code IS NOT NULL AND source_qual_code IS NOT NULL"
_VERSIONS = f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY uoc_code, anzsco_code, source_qual_code ORDER BY created_at, id) n, row_number() OVER (PARTITION BY uoc_code, anzsco_code, source_qual_code ORDER BY created_at DESC, id DESC) m FROM uoc_occupation_links WHERE {_SAME})
SELECT f.uoc_code, f.anzsco_code, f.source_qual_code, l.anzsco_title, l.industry_sector, l.is_primary, {{c}}.confidence, {{c}}.anzsco_major_group, f.id FROM r f JOIN r l USING (uoc_code, anzsco_code, source_qual_code) WHERE f.n = 1 AND l.m = 1"""

ORACLE = {
    "linkage_full": _FULL + "SELECT uoc_code, anzsco_code, confidence, mapping_source, source_qual_code, is_primary, (sum((confidence = mx)::INT) OVER (PARTITION BY uoc_code))::BIGINT ties FROM ranked",
    "linkage_steps": _FULL + "SELECT step, mapping_source, count(*) n, count(DISTINCT uoc_code) n_units FROM best GROUP BY ALL",
    "linkage_merged": _FULL + """, k AS (SELECT uoc_code, CASE WHEN valid_to IS NULL AND uoc_code IN (SELECT uoc_code FROM ranked) THEN TIMESTAMP '2025-01-01' ELSE valid_to END v, false fresh FROM uoc_occupation_links UNION ALL SELECT uoc_code, NULL, true FROM ranked)
  SELECT uoc_code, count(*) FILTER (fresh) n_new, count(*) FILTER (v IS NULL) n_open, count(*) FILTER (v = TIMESTAMP '2025-01-01') n_ended, count(*) n FROM k GROUP BY 1""",
    "upsert_reworked": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY run_id, row_index ORDER BY id) n, row_number() OVER (PARTITION BY run_id, row_index ORDER BY id DESC) m FROM rsd_skill_records)
  SELECT f.run_id, f.row_index, f.id, f.unit_code, f.tp_code, l.qa_passes, l.qa_word_count, l.rewrite_count, md5(coalesce(l.skill_statement, '') || '|' || coalesce(l.bart_prompt, '') || '|' || coalesce(l.bart_model, '') || '|' || coalesce(l.keywords, '') || '|' || coalesce(l.error_message, '')) digest
  FROM r f JOIN r l ON f.run_id IS NOT DISTINCT FROM l.run_id AND f.row_index IS NOT DISTINCT FROM l.row_index WHERE f.n = 1 AND l.m = 1""",
    "upsert_links_enriched": _VERSIONS.format(c="f"),
    "upsert_links_scraped": _VERSIONS.format(c="l"),
    "upsert_sheet": """WITH r AS (SELECT trim(qualification_code) qual_code, * EXCLUDE (qualification_code), row_number() OVER (PARTITION BY trim(qualification_code) ORDER BY row_id) n, row_number() OVER (PARTITION BY trim(qualification_code) ORDER BY row_id DESC) m FROM tga_qualifications_updated WHERE trim(qualification_code) <> '')
  SELECT f.qual_code, l.qualification_title, l.taxonomy_occupation, l.taxonomy_industry_sector, l.anzsco_identifier, f.row_id FROM r f JOIN r l USING (qual_code) WHERE f.n = 1 AND l.m = 1""",
    "run_log": """SELECT run_id, CASE WHEN arg_min(bart_model, (created_at, id)) IS NULL THEN '{"most_words":60}' ELSE '{"model":"' || arg_min(bart_model, (created_at, id)) || '","most_words":60}' END settings, count(*) n_rows,
  strftime(min(created_at), '%Y-%m-%dT%H:%M:%SZ') started_at, strftime(max(created_at), '%Y-%m-%dT%H:%M:%SZ') finished_at FROM rsd_skill_records WHERE run_id IS NOT NULL GROUP BY 1""",
}
