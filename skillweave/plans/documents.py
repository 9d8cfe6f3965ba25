"""Queries that write pages, responses and files from the tables, read them back with the sources, and call services."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skillweave.functions import text as tx
from skillweave.operators import export, ingest, upsert
from skillweave.operators.upsert import first_by
from skillweave.plans.links import _DERIVED
from skillweave.plans.tables import table
from skillweave.session import shared_folder
from skillweave.sources import files, pages, registry, services


def _escaped(value: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        value = F.replace(value, F.lit(plain), F.lit(entity))
    return value


def _held(name: str) -> Column:
    return _escaped(tx.stripped(F.coalesce(F.col(name), F.lit(""))))


def page_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    """Classifications of pages with a table, one page per taxonomy link."""
    row = lambda label, c: F.concat(F.lit(f"<tr><td>{label}</td><td>"), _held(c), F.lit("</td></tr>"))
    html = F.concat(F.lit("<h2>Classifications</h2><table>"), row("ANZSCO Identifier", "anzsco_identifier"), row("Industry Sector", "industry_sector"), row("Taxonomy - Occupation", "occupation_titles"), F.lit("</table>"))
    rows = table(spark, d, "qual_taxonomy_links").select("id", html.alias("html"))
    return rows.withColumn("t", pages.taxonomy(F.col("html"))).select("id", "t.anzsco", "t.industry", "t.occupation")


def page_units(spark: SparkSession, d: str) -> DataFrame:
    """Units of pages with a list per section, one page per row of the sheet, counted."""
    items = lambda c: F.concat_ws("", F.transform(F.split(F.coalesce(F.col(c), F.lit("")), r"[\n\r\t;|•,]+"), lambda x: F.concat(F.lit("<li>"), _escaped(F.trim(F.translate(x, '"“”', ""))), F.lit(" Title</li>"))))
    html = F.concat(F.lit("<h3>Core units</h3><ul>"), items("core_unit_codes"), F.lit("</ul><h3>Elective units</h3><ul>"), items("elective_unit_codes"), F.lit("</ul>"))
    found = table(spark, d, "tga_qualifications_updated").select("row_id", F.explode(pages.units(html)).alias("u"))
    return found.groupBy("row_id", "u.section").agg(F.count("*").alias("n_units"), F.min("u.unit_code").alias("first_code"), F.max("u.unit_code").alias("last_code"))


def response_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    """Classifications of XML responses, one per taxonomy link; a description counts before a value."""
    scheme = lambda name, c: F.concat(F.lit(f"<ns:ClassificationScheme><ns:Scheme>{name}</ns:Scheme>"), c, F.lit("</ns:ClassificationScheme>"))
    value = lambda c: F.concat(F.lit("<ns:Value>"), _held(c), F.lit("</ns:Value>"))
    both = F.concat(F.lit("<ns:Value>none</ns:Value><ns:Description>"), _held("industry_sector"), F.lit("</ns:Description>"))
    xml = F.concat(F.lit('<r xmlns:ns="urn:x">'), scheme("ANZSCO Identifier", value("anzsco_identifier")), scheme("Industry Sector", F.when(_held("industry_sector") == "", value("industry_sector")).otherwise(both)), scheme("Taxonomy-Occupation", value("occupation_titles")), F.lit("</r>"))
    rows = table(spark, d, "qual_taxonomy_links").select("id", xml.alias("xml"))
    return rows.withColumn("t", pages.soap_taxonomy(F.col("xml"))).select("id", "t.anzsco", "t.industry", "t.occupation")


def unit_detail_rows(spark: SparkSession, d: str) -> DataFrame:
    """Criteria of JSON details, one per skill record, counted; a single criterion comes as the object itself."""
    line = F.filter(F.split(F.coalesce("pcs_text", F.lit("")), "\n"), lambda x: x.rlike(r"^\d+\.\d+ "))
    pc = F.transform(line, lambda x: F.struct(F.regexp_extract(x, r"^(\d+\.\d+) ", 1).alias("Num"), F.regexp_extract(x, r"(?s)^\d+\.\d+ (.*)$", 1).alias("Description")))
    shaped = lambda inner: F.to_json(F.struct(F.col("id").cast("string").alias("Code"), F.col("unit_title").alias("Title"), F.struct(F.array(F.struct(F.lit("1").alias("Num"), F.col("element_title").alias("Title"), F.struct(inner.alias("PerformanceCriterion")).alias("PerformanceCriteria"))).alias("Element")).alias("Elements")))
    rows = table(spark, d, "rsd_skill_records").withColumn("pc", pc)
    payload = rows.select(F.when(F.size("pc") == 1, shaped(F.col("pc")[0])).otherwise(shaped(F.col("pc"))).alias("payload"))
    found = pages.unit_rows(payload, "payload")
    return found.groupBy("unit_code", "unit_title", "element_title").agg(F.count("*").alias("n_criteria"), F.sum(F.length("pc_text")).alias("n_chars"), F.min("pc_num").alias("first"), F.max("pc_num").alias("last"))


def organisation_rows(spark: SparkSession, d: str) -> DataFrame:
    """Organisations of JSON responses; what a response lacks is ''."""
    payload = F.to_json(F.struct(F.col("s_suppkey").cast("string").alias("Code"), F.col("s_name").alias("LegalName"), F.col("s_nationkey").cast("string").alias("AddressState")))
    return table(spark, d, "supplier").select(pages.organisation(payload).alias("o")).select("o.*")


def search_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Items of JSON:API search responses, one response per occupation with a repeated item."""
    item = lambda title: F.struct(F.col("anzsco_code").alias("id"), F.lit("occupation").alias("type"), F.struct(F.col("anzsco_code").alias("code"), title.alias("title")).alias("attributes"))
    payload = F.to_json(F.struct(F.array(item(F.col("anzsco_title")), item(F.lit("repeated"))).alias("data")))
    return pages.qualification_summaries(table(spark, d, "anzsco_codes").select(payload.alias("payload")), "payload")


def _details(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    last = first_by(table(spark, d, "qual_registry"), ["qual_code"], [F.col("snapshot_date").desc_nulls_last(), F.col("ingested_at").desc_nulls_last(), F.col("id").desc()])
    units = table(spark, d, "uoc_qual_memberships").where("trim(uoc_code) <> ''").groupBy(F.upper(F.trim("qual_code")).alias("q"))
    # As many as a qualification has units.
    units = units.agg(F.array_sort(F.collect_set(F.struct(F.upper(F.trim("uoc_code")).alias("Code"), F.lit("").alias("Title"), (F.lower(F.trim("membership_type")) == "core").alias("IsEssential")))).alias("Units"))
    joined = last.join(units, F.col("qual_code") == F.col("q"), "left")
    payload = F.to_json(F.struct(F.col("qual_code").alias("Code"), F.col("qual_title").alias("Title"), F.col("status").alias("Status"), F.col("tp_code").alias("TrainingPackageCode"), F.col("aqf_level").alias("AqfLevel"), "Units"))
    return ingest.from_details(joined.select(payload.alias("payload")), "payload")


def detail_qualifications(spark, d):
    """Qualifications of JSON details, one per code of the registry."""
    return _details(spark, d)["qualifications"]


def detail_memberships(spark, d):
    """Memberships of JSON details."""
    return _details(spark, d)["memberships"]


def code_page(number: int) -> list[dict]:
    """A client for the paged registry: 40 made-up codes a page."""
    return [{"code": f"{'AQ' if k % 3 else 'BR'}{number:03d}{k:02d}", "title": f"Item {k}", "type": "unit"} for k in range(40)] + [{"title": "without code"}]


def registry_pages(spark, d):
    """Codes of a paged registry that begin with AQ, a partition per page."""
    registry.register(spark)
    found = spark.read.format("registry_search").option("client", "skillweave.plans.documents:code_page").option("pages", 12).option("prefixes", "AQ").load()
    return found.select("page", "code", "title", "kind")


def csv_round_trip(spark, d):
    """Occupations written as CSV and read again by extension."""
    path = f"{shared_folder(spark)}/export-{uuid.uuid4().hex[:8]}.csv"
    export.write_csv(table(spark, d, "anzsco_codes").drop("created_at"), path)
    return files.read(spark, path).select(*[F.col(c).cast("string").alias(c) for c in ("anzsco_code", "anzsco_title", "anzsco_level", "major_group_code", "major_group_title")])


def jsonl_round_trip(spark, d):
    """Criteria written as one JSON document per line and read again by extension."""
    path = f"{shared_folder(spark)}/export-{uuid.uuid4().hex[:8]}.jsonl"
    record = F.to_json(F.struct("id", "unit_code", "pcs_text", "keywords"), {"ignoreNullFields": "false"})
    export.write_jsonl(table(spark, d, "rsd_skill_records").select(record.alias("record")), path)
    return files.read(spark, path, "id bigint, unit_code string, pcs_text string, keywords string").select("id", "unit_code", F.md5(F.concat_ws("|", "pcs_text", "keywords")).alias("digest"))


def workbook_rows(spark, d):
    """Rows of the sheet written as workbooks, one per batch, and parsed again."""
    names = ["row_id", "qualification_code", "qualification_title", "anzsco_identifier"]

    def through(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            book = files.workbook(names, pdf[names].astype(object).where(pdf[names].notna(), None).values.tolist())
            rows = files.parse_xlsx(book)[1:]
            yield pd.DataFrame([[r.get(i) for i in range(len(names))] for r in rows], columns=names, dtype=object)

    rows = table(spark, d, "tga_qualifications_updated").select(F.col("row_id").cast("string").alias("row_id"), *[F.nullif(F.col(c), F.lit("")).alias(c) for c in names[1:]])
    return rows.mapInPandas(through, ", ".join(f"{n} string" for n in names)).withColumn("row_id", F.col("row_id").cast("bigint"))


def sheet_loaded(spark, d):
    """The load of the sheet in one chain: columns checked, deliveries put together, links derived and titles filled in."""
    wide = table(spark, d, "tga_qualifications_updated")
    files.require(wide, "qualification_code", "taxonomy_occupation")
    early, late = wide.where("coalesce(anzsco_identifier, '') = ''").drop("anzsco_identifier"), wide.where("coalesce(anzsco_identifier, '') <> ''")
    links = ingest.sheet_links(files.combined(early, late))
    titles = table(spark, d, "uoc_registry").groupBy("uoc_code").agg(F.max("uoc_title").alias("uoc_title"))
    filled = upsert.backfill(links.select("uoc_code", "source_qual_code", "anzsco_code", "confidence", "is_primary").withColumn("title", F.lit("")), titles, ("uoc_code", "uoc_code"), {"title": "uoc_title"})
    return filled.groupBy("source_qual_code").agg(F.count("*").alias("n_links"), F.count_if(F.coalesce("title", F.lit("")) != "").alias("n_titled"), F.count_if("is_primary").alias("n_primary"), F.max("anzsco_code").alias("anzsco_code"))


class Repeater:
    """A service without a network: it gives the first line of what it is asked about, in capitals, or fails on request."""

    name = "repeater"

    def chat_completion(self, messages: list[dict], model: str, temperature: float, max_tokens: int = 1500) -> str:
        text = messages[0]["content"].removeprefix("Skill statement:\n").split("\n")[0]
        if text.startswith("Clean"):
            raise ValueError("not today")
        return text.upper()


def generated_statements(spark, d):
    """Statements that a service gives for element titles; a failure becomes the row's error."""
    rows = table(spark, d, "rsd_skill_records").where(tx.has_text(F.col("element_title"))).select("id", "element_title")
    return services.generate(rows, "id", "element_title", Repeater, max_fixes=0)


def generated_keywords(spark, d):
    """Keywords that a service gives for statements."""
    rows = table(spark, d, "rsd_skill_records").where(tx.has_text(F.col("element_title"))).select("id", "element_title", F.coalesce("pcs_text", F.lit("")).alias("pcs_text"))
    return services.keywords(rows, "id", "element_title", "pcs_text", Repeater)


def _fetching():
    return lambda code: f"<code>{code}</code>" if code[-1:] != "9" else None


def fetched_codes(spark, d):
    """Payloads of the registry's units that no skill record is for yet; a service that has nothing leaves null."""
    done = table(spark, d, "rsd_skill_records").select(F.trim("unit_code").alias("uoc_code"))
    found = services.fetch(files.remaining(table(spark, d, "uoc_registry").select("uoc_code"), done, "uoc_code"), "uoc_code", _fetching)
    return found.select("uoc_code", "payload")


QUERIES = {
    f.__name__: f
    for f in (
        page_taxonomy, page_units, response_taxonomy, unit_detail_rows, organisation_rows, search_summaries, detail_qualifications, detail_memberships, registry_pages,
        csv_round_trip, jsonl_round_trip, workbook_rows, generated_statements, generated_keywords, fetched_codes, sheet_loaded,
    )
}

_TRIM = lambda c: f"regexp_replace(coalesce({c}, ''), '^\\s+|\\s+$', '', 'g')"
_TIDY = lambda c: f"array_to_string(list_filter(list_transform(string_split_regex({_TRIM(c)}, '[\\n\\r;|•]+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), ', ')"
_LAST = "l AS (SELECT * FROM qual_registry QUALIFY row_number() OVER (PARTITION BY qual_code ORDER BY snapshot_date DESC, ingested_at DESC, id DESC) = 1)"

ORACLE = {
    "page_taxonomy": f"""WITH x AS (SELECT id, {_TRIM("anzsco_identifier")} a, {_TRIM("industry_sector")} i, {_TRIM("occupation_titles")} o, {_TIDY("anzsco_identifier")} ta, {_TIDY("industry_sector")} ti, {_TIDY("occupation_titles")} tt FROM qual_taxonomy_links)
  SELECT id, CASE WHEN a IN ('', 'N/A') THEN a ELSE ta END anzsco, CASE WHEN i IN ('', 'N/A') THEN i ELSE ti END industry, CASE WHEN o IN ('', 'N/A') THEN o ELSE tt END occupation FROM x""",
    "page_units": """WITH x AS (SELECT row_id, 'core' section, unnest(string_split_regex(coalesce(core_unit_codes, ''), '[\\n\\r\\t;|•,]+')) c FROM tga_qualifications_updated
  UNION ALL SELECT row_id, 'elective', unnest(string_split_regex(coalesce(elective_unit_codes, ''), '[\\n\\r\\t;|•,]+')) FROM tga_qualifications_updated), y AS (SELECT row_id, section, trim(translate(c, '"“”', '')) c FROM x)
  SELECT row_id, section, count(*) n_units, min(c) first_code, max(c) last_code FROM y WHERE regexp_full_match(c, '[A-Z]{2,8}\\d{3,6}[A-Z]?') GROUP BY ALL""",
    "response_taxonomy": f"SELECT id, {_TRIM('anzsco_identifier')} anzsco, {_TRIM('industry_sector')} industry, {_TRIM('occupation_titles')} occupation FROM qual_taxonomy_links",
    "unit_detail_rows": """WITH x AS (SELECT id::VARCHAR unit_code, coalesce(unit_title, '') unit_title, coalesce(element_title, '') element_title, unnest(string_split(coalesce(pcs_text, ''), chr(10))) l FROM rsd_skill_records)
  SELECT unit_code, unit_title, element_title, count(*) n_criteria, sum(length(regexp_extract(l, '^\\d+\\.\\d+ (.*)$', 1, 's')))::BIGINT n_chars, min(regexp_extract(l, '^(\\d+\\.\\d+) ', 1)) "first", max(regexp_extract(l, '^(\\d+\\.\\d+) ', 1)) "last"
  FROM x WHERE regexp_matches(l, '^\\d+\\.\\d+ ') GROUP BY 1, 2, 3""",
    "organisation_rows": "SELECT s_suppkey::VARCHAR code, s_name legal_name, '' trading_name, '' status, s_nationkey::VARCHAR state, '' postcode FROM supplier",
    "search_summaries": "SELECT anzsco_code code, anzsco_title title, 'occupation' type FROM anzsco_codes",
    "detail_qualifications": f"""WITH {_LAST} SELECT qual_code, coalesce(trim(qual_title), '') qual_title, coalesce(nullif(trim(tp_code), ''), substr(qual_code, 1, 3)) tp_code, nullif(trim(aqf_level), '') aqf_level, coalesce(status, 'Current') status FROM l WHERE trim(qual_code) <> ''""",
    "detail_memberships": f"""WITH {_LAST}, m AS (SELECT DISTINCT upper(trim(qual_code)) q, upper(trim(uoc_code)) uoc_code, coalesce(lower(trim(membership_type)) = 'core', false) core FROM uoc_qual_memberships WHERE trim(uoc_code) <> '')
  SELECT uoc_code, qual_code, CASE WHEN core THEN 'core' ELSE 'elective' END membership_type, NOT starts_with(uoc_code, substr(coalesce(nullif(trim(tp_code), ''), substr(qual_code, 1, 3)), 1, 3)) is_imported, substr(uoc_code, 1, 3) owner_tp_code FROM l JOIN m ON q = qual_code""",
    "registry_pages": """SELECT p::INT page, 'AQ' || lpad(p::VARCHAR, 3, '0') || lpad(k::VARCHAR, 2, '0') code, 'Item ' || k title, 'unit' kind FROM range(1, 13) a(p), range(0, 40) b(k) WHERE k % 3 <> 0""",
    "csv_round_trip": "SELECT anzsco_code, anzsco_title, anzsco_level, major_group_code, major_group_title FROM anzsco_codes",
    "jsonl_round_trip": "SELECT id, unit_code, md5(concat_ws('|', pcs_text, keywords)) digest FROM rsd_skill_records",
    "workbook_rows": "SELECT row_id, nullif(qualification_code, '') qualification_code, nullif(qualification_title, '') qualification_title, nullif(anzsco_identifier, '') anzsco_identifier FROM tga_qualifications_updated",
    "generated_statements": "SELECT id, CASE WHEN starts_with(element_title, 'Clean') THEN 'ERROR: not today' ELSE trim(upper(element_title)) END statement, 0 rewrites, CASE WHEN starts_with(element_title, 'Clean') THEN 'not today' END error FROM rsd_skill_records WHERE element_title <> ''",
    "generated_keywords": "SELECT id, CASE WHEN NOT starts_with(element_title, 'Clean') THEN trim(upper(element_title)) END keywords, CASE WHEN starts_with(element_title, 'Clean') THEN 'not today' END error FROM rsd_skill_records WHERE element_title <> ''",
    "sheet_loaded": _DERIVED.replace("SELECT qualification_code qual_code", "SELECT row_id, anzsco_identifier a, qualification_code qual_code").replace("SELECT qualification_code,", "SELECT row_id, anzsco_identifier, qualification_code,").replace("qual_code, kind FROM x WHERE", "qual_code, kind, row_id, a FROM x WHERE") + """,
  o AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY uoc_code, qual_code, kind ORDER BY row_id DESC) = 1), q AS (SELECT *, (kind = 'core') = bool_or(kind = 'core') OVER (PARTITION BY uoc_code) is_primary FROM o),
  t AS (SELECT uoc_code, max(uoc_title) title FROM uoc_registry GROUP BY 1)
  SELECT qual_code source_qual_code, count(*) n_links, count(*) FILTER (coalesce(title, '') <> '') n_titled, count(*) FILTER (is_primary) n_primary, max(CASE WHEN coalesce(trim(a), '') IN ('', 'N/A', 'nan') THEN '' ELSE trim(a) END) anzsco_code FROM q LEFT JOIN t USING (uoc_code) GROUP BY 1""",
    "fetched_codes": "SELECT DISTINCT uoc_code, CASE WHEN NOT ends_with(uoc_code, '9') THEN '<code>' || uoc_code || '</code>' END payload FROM uoc_registry WHERE uoc_code NOT IN (SELECT trim(unit_code) FROM rsd_skill_records WHERE unit_code IS NOT NULL)",
}
