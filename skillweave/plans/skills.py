"""Queries on skill records: checks, classes, normalisation and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillweave.functions import codes
from skillweave.functions import text as tx
from skillweave.operators import export, normalise, upsert
from skillweave.plans.tables import table

def _s():
    return F.col("skill_statement")


def _order():
    return [F.col("row_index").asc_nulls_last(), F.col("id")]


def _skills(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "rsd_skill_records").where(tx.has_text(_s()))


def qa_check(spark, d):
    """Rule check of every statement."""
    return _skills(spark, d).select("id", *[c.alias(n) for n, c in tx.qa(_s()).items()])


def qa_issues(spark, d):
    """Issues of the statements that fail."""
    return _skills(spark, d).select("id", tx.qa_issues(_s()).alias("issues")).where("issues <> ''")


def qa_agreement(spark, d):
    """How often the stored flag agrees with the rules."""
    flags = _skills(spark, d).select(F.coalesce("qa_passes", F.lit(False)).alias("qa_passes"), tx.qa(_s())["passes"].alias("rule"))
    return flags.groupBy("qa_passes", "rule").agg(F.count("*").alias("n"))


def skill_classes(spark, d):
    """Verb, domain, verb group and complexity of every statement."""
    return _skills(spark, d).select("id", tx.primary_verb(_s()).alias("verb"), tx.domain(_s()).alias("domain"), tx.verb_group(_s()).alias("verb_group"), tx.complexity(_s()).alias("complexity"))


def blob_parse(spark, d):
    """Elements and criteria parsed out of blobs (each record's element and criteria put together as one text)."""
    rows = table(spark, d, "rsd_skill_records")
    blob = F.concat(F.lit("1 "), F.coalesce("element_title", F.lit("")), F.lit("\nPerformance criteria\n"), F.coalesce("pcs_text", F.lit("")))
    parsed = normalise.parse_blobs(rows.select("id", blob.alias("blob")), ["id"], "blob")
    return parsed.where("element_title <> '' and size(criteria) > 0").select("id", "element_title", F.array_join("criteria", "\n").alias("criteria"), F.size("criteria").alias("n_criteria"))


def row_per_criterion(spark, d):
    """Criteria split to one row each, then grouped to elements again."""
    rows = table(spark, d, "rsd_skill_records").where("element_title is not null and pcs_text is not null")
    lines = rows.select("id", "unit_title", F.posexplode(F.split("pcs_text", "\n")).alias("line_no", "pc"))
    grouped = normalise.group_criteria(lines, ["id"], "unit_title", "pc", F.col("line_no"))
    return grouped.select("id", "unit_title", F.length("pcs_text").alias("n_chars"), F.md5("pcs_text").alias("digest"))


def section_carry(spark, d):
    """Unit codes of a contents text with the section that they stand under."""
    rows = table(spark, d, "tga_qualifications_updated")
    side = lambda c: F.array_join(tx.listed(F.coalesce(c, F.lit("")), r"[\n\r;|•,\t]+"), "\n")
    contents = F.concat(F.lit("Contents\nCore units\n"), side("core_unit_codes"), F.lit("\n\nGroup A electives\n"), side("elective_unit_codes"))
    carried = normalise.carry_sections(rows.select("row_id", contents.alias("contents")), ["row_id"], "contents")
    return carried.groupBy("row_id", "section").agg(F.count("*").alias("n_units"), F.min("unit_code").alias("first_code"), F.max("unit_code").alias("last_code"))


def unit_numbering(spark, d):
    return export.numbered_unit(table(spark, d, "rsd_skill_records").select("id", "unit_code", "row_index"), _order()).select("id", "unit_number")


def rsd_rows(spark, d):
    return export.rsd_rows(table(spark, d, "rsd_skill_records"), _order())


def osmt_rows(spark, d):
    return export.osmt_rows(table(spark, d, "rsd_skill_records"), _order(), "curriculum team")


def traceability(spark, d):
    return export.traceability(table(spark, d, "rsd_skill_records"), _order())


def prompts(spark, d):
    """Digest of the request for every element."""
    text = tx.prompt(F.col("unit_code"), F.col("unit_title"), F.col("element_title"), F.col("pcs_text"))
    return table(spark, d, "rsd_skill_records").select("id", F.md5(text).alias("digest"), F.length(text).alias("n_chars"))


def code_functions(spark, d):
    """Expressions on codes over the occupation list."""
    c = F.col("anzsco_code")
    return table(spark, d, "anzsco_codes").select("anzsco_code", codes.major_group(c).alias("major_group"), codes.occupation_uri(c).alias("uri"), F.sha2(c, 256).alias("digest"))


def level_labels(spark, d):
    """Labels of the qualification levels, in table order and by longest name."""
    levels = table(spark, d, "qual_registry").select(F.col("aqf_level").alias("level")).distinct()
    return levels.select("level", codes.level_label(F.col("level")).alias("label"), codes.level_label(F.col("level"), longest=True).alias("longest_label"))


def criterion_in_title(spark, d):
    """Records of which a title, or a line of the criteria, holds a criterion number, with the lines that do."""
    number = r"\b\d+\.\d+\b"
    lines = F.size(F.filter(F.split(F.coalesce("pcs_text", F.lit("")), "\n"), lambda x: x.rlike(number)))
    rows = table(spark, d, "rsd_skill_records").select("id", F.coalesce(F.col("element_title").rlike(number), F.lit(False)).alias("in_title"), lines.alias("n_lines"))
    return rows.where("in_title or n_lines > 0")


def run_records(spark, d):
    """Records of the run with the most rows, in order (smaller run id on ties)."""
    rows = table(spark, d, "rsd_skill_records")
    run = rows.groupBy("run_id").count().orderBy(F.col("count").desc(), "run_id").limit(1).select("run_id")
    return rows.join(F.broadcast(run), "run_id", "left_semi").select("run_id", "row_index", "id", "unit_code")  # one row


def next_index(spark, d):
    """Where each run goes on."""
    return table(spark, d, "rsd_skill_records").groupBy("run_id").agg((F.coalesce(F.max("row_index"), F.lit(-1)) + 1).alias("next_index"))


def content_fingerprint(spark, d):
    return upsert.fingerprint(table(spark, d, "uoc_registry").select("uoc_code", "uoc_title", "tp_code"))


def _records(spark, d, all_links):
    found = export.unit_records(table(spark, d, "uoc_registry"), table(spark, d, "rsd_skill_records"), table(spark, d, "uoc_qual_memberships"), table(spark, d, "uoc_occupation_links"), all_links)
    at = lambda path: F.get_json_object("record", path)
    size = lambda path: F.coalesce(F.json_array_length(at(path)), F.lit(0))
    return found.select(
        "uoc_code", "part", at("$.uoc_title").alias("uoc_title"), size("$.skill_statements").alias("n_statements"), size("$.qualification_memberships").alias("n_memberships"), size("$.occupation_links").alias("n_links"),
        at("$.primary_occupation.anzsco_code").alias("anzsco_code"), at("$.primary_occupation.uri").alias("uri"), at("$.skill_statements[0].element_id").alias("first_element"),
        at("$.import_status.owner_tp_code").alias("owner"), at("$.import_status.imported_only").alias("imported_only"), at("$.skill_statements[0].evidence.hash").alias("first_hash"),
    )


def unit_records(spark, d):
    """Nested record of every unit: what it holds, by part."""
    return _records(spark, d, False)


def unit_records_all_links(spark, d):
    """The same with every open link instead of the primary ones."""
    return _records(spark, d, True)


QUERIES = {
    f.__name__: f
    for f in (
        qa_check, qa_issues, qa_agreement, skill_classes, blob_parse, row_per_criterion, section_carry, unit_numbering, rsd_rows, osmt_rows, traceability, prompts,
        code_functions, level_labels, criterion_in_title, run_records, next_index, content_fingerprint, unit_records, unit_records_all_links,
    )
}

_T = "regexp_replace(skill_statement, '^\\s+|\\s+$', '', 'g')"
_QA = f"""
WITH q AS (SELECT id, qa_passes, len(regexp_extract_all({_T}, '[.!?]\\s+')) = 0 one_sentence, len(regexp_extract_all(skill_statement, '\\S+'))::INT word_count,
  regexp_matches(skill_statement, '{tx.METHOD_HINTS}') has_method, regexp_matches(skill_statement, '{tx.OUTCOME_HINTS}') has_outcome
  FROM rsd_skill_records WHERE skill_statement <> ''),
p AS (SELECT *, one_sentence AND word_count BETWEEN 30 AND 60 AND has_method AND has_outcome passes FROM q)
"""
_UNIT = "CASE WHEN unit_code IS NULL OR trim(unit_code) IN ('', 'nan', 'None') THEN 'UNIT' ELSE trim(unit_code) END"
_NUM = f"{_UNIT} || '.' || row_number() OVER (PARTITION BY {_UNIT} ORDER BY row_index ASC NULLS LAST, id)"
_W = "regexp_extract_all(lower(skill_statement), '[\\p{L}\\p{N}_]+')"
_lit = lambda ws: "[" + ",".join(f"'{w}'" for w in ws) + "]"
_DOMAIN = "CASE greatest({all}) WHEN 0 THEN 'General' {whens} END".format(
    all=", ".join("d%d" % i for i in range(len(tx.DOMAINS))), whens=" ".join(f"WHEN d{i} THEN '{d}'" for i, d in enumerate(tx.DOMAINS))
)
_COUNTS = ", ".join("(" + " + ".join(f"contains(lower(skill_statement), '{k}')::INT" for k in ks.split()) + f") d{i}" for i, ks in enumerate(tx.DOMAINS.values()))
_SIGNALS = ", ".join(f"len(list_filter(w, lambda x: list_contains({_lit(ws.split())}, x))) s{n}" for n, ws in tx.COMPLEXITY.items())
CLASSES_SQL = f"""
WITH w AS (SELECT id, unit_code, tp_code, element_title, skill_statement, {_W} w, {_COUNTS} FROM rsd_skill_records WHERE skill_statement <> ''),
s AS (SELECT *, {_SIGNALS} FROM w),
c AS (SELECT id, unit_code, tp_code, element_title, skill_statement, coalesce(list_filter(w, lambda x: list_contains({_lit(tx.ACTION_VERBS)}, x))[1], 'other') verb, {_DOMAIN} "domain",
  CASE {" ".join(f"WHEN list_has_any(w, {_lit(v.split())}) THEN '{g}'" for g, v in tx.VERB_GROUPS.items())} ELSE 'Other' END verb_group,
  CASE WHEN s9 + s5 + s2 = 0 THEN 5.0 ELSE round(least(greatest((s9 * 9 + s5 * 5 + s2 * 2)::DOUBLE / (s9 + s5 + s2) + least(len(w) / 20.0, 1.5), 1.0), 10.0), 1) END complexity FROM s)
"""
_LEVEL = lambda names: "CASE WHEN coalesce(aqf_level, '') = '' THEN 'Unspecified' " + " ".join(f"WHEN contains(lower(aqf_level), '{n.lower()}') THEN '{codes.LEVEL_LABELS[n]}'" for n in names) + " ELSE aqf_level END"
_FP = "concat_ws(chr(31), coalesce(uoc_code, chr(0)), coalesce(uoc_title, chr(0)), coalesce(tp_code, chr(0)))"

_RECORDS = """
WITH s AS (SELECT unit_code uoc_code, skill_statement, row_number() OVER (PARTITION BY unit_code ORDER BY row_index NULLS LAST, id) n FROM rsd_skill_records WHERE skill_statement IS NOT NULL),
p AS (SELECT uoc_code, ((n - 1) // 5000 + 1)::INT part, count(*)::INT n_statements, min(n) n1, arg_min(skill_statement, n) first FROM s GROUP BY 1, 2),
m0 AS (SELECT DISTINCT uoc_code, qual_code, membership_type, elective_group, is_imported, owner_tp_code FROM uoc_qual_memberships WHERE uoc_code IS NOT NULL),
m AS (SELECT uoc_code, count(*)::INT n_memberships, bool_and(coalesce(is_imported, false)) only_imported FROM m0 GROUP BY 1),
l0 AS (SELECT DISTINCT uoc_code, coalesce(is_primary, false) is_primary, confidence, anzsco_code, anzsco_title, mapping_source, source_qual_code, industry_sector FROM uoc_occupation_links WHERE valid_to IS NULL),
l AS (SELECT uoc_code, count(*) FILTER ({links})::INT n_links FROM l0 GROUP BY 1),
b AS (SELECT uoc_code, anzsco_code FROM l0 QUALIFY row_number() OVER (PARTITION BY uoc_code ORDER BY is_primary DESC, confidence DESC NULLS LAST, anzsco_code DESC NULLS LAST) = 1)
SELECT u.uoc_code, coalesce(part, 1) part, uoc_title, coalesce(n_statements, 0) n_statements, coalesce(n_memberships, 0) n_memberships, coalesce(n_links, 0) n_links, b.anzsco_code,
  CASE WHEN b.uoc_code IS NULL THEN NULL WHEN coalesce(b.anzsco_code, '') = '' THEN '' ELSE '{uri}' || regexp_replace(b.anzsco_code, '[ -]', '', 'g') END uri, CASE WHEN n1 IS NOT NULL THEN u.uoc_code || '-E' || CASE WHEN n1 < 10 THEN '0' ELSE '' END || n1 END first_element,
  coalesce(nullif(trim(tp_code), ''), substr(u.uoc_code, 1, 3)) "owner", coalesce(only_imported, false)::VARCHAR imported_only, CASE WHEN n1 IS NOT NULL THEN 'sha256:' || sha256(first) END first_hash
FROM uoc_registry u LEFT JOIN p USING (uoc_code) LEFT JOIN m USING (uoc_code) LEFT JOIN l USING (uoc_code) LEFT JOIN b USING (uoc_code)
"""

ORACLE = {
    "unit_records": _RECORDS.format(links="is_primary", uri=codes.OCCUPATION_URI),
    "unit_records_all_links": _RECORDS.format(links="true", uri=codes.OCCUPATION_URI),
    "qa_check": _QA + "SELECT id, one_sentence, word_count, has_method, has_outcome, passes FROM p",
    "qa_issues": _QA + """SELECT id, issues FROM (SELECT id, concat_ws(' ', CASE WHEN NOT one_sentence THEN 'The statement must be exactly one sentence.' END,
      CASE WHEN word_count < 30 THEN 'Too short (' || word_count || ' words). Aim for 30–60 words.' END, CASE WHEN word_count > 60 THEN 'Too long (' || word_count || ' words). Shorten to 30–60 words.' END,
      CASE WHEN NOT has_method THEN 'Add a method phrase (e.g. ''using …'', ''by applying …'', ''through …'').' END,
      CASE WHEN NOT has_outcome THEN 'Add an outcome phrase (e.g. ''to ensure …'', ''enabling …'', ''resulting in …'').' END) issues FROM p) WHERE issues <> ''""",
    "qa_agreement": _QA + "SELECT coalesce(qa_passes, false) qa_passes, passes rule, count(*) n FROM p GROUP BY ALL",
    "skill_classes": CLASSES_SQL + 'SELECT id, verb, "domain", verb_group, complexity FROM c',
    "blob_parse": """
WITH l AS (SELECT id, trim(element_title) t, unnest(string_split_regex(coalesce(pcs_text, ''), '\\r\\n|\\n|\\r')) x, generate_subscripts(string_split_regex(coalesce(pcs_text, ''), '\\r\\n|\\n|\\r'), 1) i
  FROM rsd_skill_records WHERE regexp_matches('1 ' || coalesce(element_title, ''), '^(\\d+)\\.?\\s+[^\\d.]')),
m AS (SELECT id, t, i, regexp_replace(x, '^\\s+|\\s+$', '', 'g') x FROM l),
g AS (SELECT id, t, i, regexp_extract(x, '^(\\d+\\.\\d+)\\.?\\s+(.*)', 1) || ' ' || trim(regexp_extract(x, '^(\\d+\\.\\d+)\\.?\\s+(.*)', 2)) p FROM m WHERE regexp_matches(x, '^(\\d+\\.\\d+)\\.?\\s+(.*)'))
SELECT id, t element_title, string_agg(p, chr(10) ORDER BY i) criteria, count(*)::INT n_criteria FROM g WHERE t <> '' GROUP BY id, t""",
    "row_per_criterion": "SELECT id, unit_title, length(pcs_text)::INT n_chars, md5(pcs_text) digest FROM rsd_skill_records WHERE element_title IS NOT NULL AND pcs_text IS NOT NULL",
    "section_carry": f"""
WITH x AS (SELECT row_id, 'core' section, unnest(string_split_regex(coalesce(core_unit_codes, ''), '[\\n\\r;|•,\\t]+')) c FROM tga_qualifications_updated
  UNION ALL SELECT row_id, 'elective', unnest(string_split_regex(coalesce(elective_unit_codes, ''), '[\\n\\r;|•,\\t]+')) FROM tga_qualifications_updated)
SELECT row_id, section, count(*) n_units, min(trim(c)) first_code, max(trim(c)) last_code FROM x WHERE regexp_matches(trim(c), '{tx.UNIT_CODE}') GROUP BY ALL""",
    "unit_numbering": f"SELECT id, {_NUM} unit_number FROM rsd_skill_records",
    "rsd_rows": f"""SELECT element_title "RSD Name", {_NUM} "Unit Code", unit_title "Unit Title", element_title "Element Title", skill_statement "Skill Statement", keywords "Keywords", tp_code "TP Code ", tp_title "TP Title ", coalesce(qa_passes, false) "QA Pass" FROM rsd_skill_records""",
    "osmt_rows": f"""SELECT element_title "RSD Name", 'curriculum team' "Authors", skill_statement "Skill Statement", unit_title "Categories", keywords "Keywords", {_NUM} "Standards", {", ".join(f"'' " + chr(34) + c + chr(34) for c in export.OSMT_BLANK)} FROM rsd_skill_records""",
    "traceability": f"""SELECT element_title "RSD Name", {_NUM} "Unit Code", unit_title "Unit Title", element_title "Element", pcs_text "Performance Criteria", skill_statement "Skill Statement", keywords "Keywords", tp_code "TP Code", tp_title "TP Title",
  bart_prompt "Prompt", bart_model "Model", bart_temperature "Temperature", coalesce(qa_one_sentence, false) "QA: One Sentence", qa_word_count "QA: Word Count", coalesce(qa_has_method, false) "QA: Has Method", coalesce(qa_has_outcome, false) "QA: Has Outcome", coalesce(qa_passes, false) "QA: Passes", rewrite_count "Rewrites", error_message "Error" FROM rsd_skill_records""",
    "prompts": """WITH p AS (SELECT id, 'Unit code: ' || coalesce(unit_code, '') || chr(10) || 'Unit title: ' || coalesce(unit_title, '') || chr(10) || 'Element title: ' || coalesce(element_title, '') || chr(10) || 'Performance criteria:' || chr(10) || coalesce(pcs_text, '')
  || chr(10) || chr(10) || 'Write one skill statement for this element.' t FROM rsd_skill_records) SELECT id, md5(t) digest, length(t)::INT n_chars FROM p""",
    "code_functions": f"""SELECT anzsco_code, CASE substr(anzsco_code, 1, 1) {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in codes.MAJOR_GROUPS.items())} ELSE '' END major_group, '{codes.OCCUPATION_URI}' || replace(replace(anzsco_code, ' ', ''), '-', '') uri, sha256(anzsco_code) digest FROM anzsco_codes""",
    "level_labels": f"SELECT DISTINCT aqf_level AS level, {_LEVEL(list(codes.LEVEL_LABELS))} AS label, {_LEVEL(sorted(codes.LEVEL_LABELS, key=lambda n: -len(n)))} longest_label FROM qual_registry",
    "criterion_in_title": """WITH x AS (SELECT id, coalesce(regexp_matches(element_title, '\\b\\d+\\.\\d+\\b'), false) in_title,
  len(list_filter(string_split(coalesce(pcs_text, ''), chr(10)), lambda l: regexp_matches(l, '\\b\\d+\\.\\d+\\b')))::INT n_lines FROM rsd_skill_records) SELECT * FROM x WHERE in_title OR n_lines > 0""",
    "run_records": "SELECT run_id, row_index, id, unit_code FROM rsd_skill_records WHERE run_id = (SELECT run_id FROM rsd_skill_records GROUP BY 1 ORDER BY count(*) DESC, run_id LIMIT 1)",
    "next_index": "SELECT run_id, coalesce(max(row_index), -1) + 1 next_index FROM rsd_skill_records GROUP BY 1",
    "content_fingerprint": f"""WITH m AS (SELECT md5({_FP}) h FROM uoc_registry)
SELECT md5(concat_ws(',', {", ".join(f"coalesce(sum(('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT), 0)::VARCHAR" for i in range(4))}, count(*)::VARCHAR)) fingerprint, count(*) n_rows FROM m""",
}
