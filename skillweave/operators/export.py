"""Flat exports and nested records of skill statements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillweave.functions import codes
from skillweave.operators.numbering import numbered

# Column names of the export formats (the trailing spaces belong to them).
RSD_COLUMNS = ("RSD Name", "Unit Code", "Unit Title", "Element Title", "Skill Statement", "Keywords", "TP Code ", "TP Title ", "QA Pass")
OSMT_BLANK = (
    "Certifications", "Occupation Major Groups", "Occupation Minor Groups", "Broad Occupations", "Detailed Occupations", "O*NET Job Codes", "Employers",
    "Alignment Name", "Alignment URL", "Alignment Framework", "Alignment 2 Name", "Alignment 2 URL", "Alignment 2 Framework",
)


def first_column(rows: DataFrame, *names: str) -> Column:
    """The first of the named columns that the table has, else ''."""
    return next((F.col(n) for n in names if n in rows.columns), F.lit(""))


def _flag(rows: DataFrame, name: str) -> Column:
    """A flag as true or false: null is false."""
    return F.coalesce(F.col(name), F.lit(False)) if name in rows.columns else F.lit("")


def numbered_unit(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """`rows` with unit_number: CODE.n by `order` within the unit; blank codes count as UNIT."""
    code = F.trim(first_column(rows, "unit_code").cast("string"))
    plain = F.when(code.isNull() | code.isin("", "nan", "None"), "UNIT").otherwise(code)
    found = numbered(rows.withColumn("_unit", plain), F.col("_unit"), order, "_number")
    return found.withColumn("unit_number", F.concat_ws(".", "_unit", F.col("_number").cast("string"))).drop("_unit", "_number")


def rsd_rows(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Review format, 9 columns; columns that the input lacks come out as ''."""
    n = numbered_unit(rows, order)
    get = lambda *c: first_column(n, *c)
    values = (get("element_title"), F.col("unit_number"), get("unit_title"), get("element_title"), get("skill_statement"), get("keywords_semicolon", "keywords"), get("tp_code"), get("tp_title"), _flag(n, "qa_passes"))
    return n.select(*[v.alias(c) for v, c in zip(values, RSD_COLUMNS, strict=True)])


def osmt_rows(rows: DataFrame, order: Sequence[Column], author: str = "") -> DataFrame:
    """Batch-import format, 19 columns."""
    n = numbered_unit(rows, order)
    get = lambda *c: first_column(n, *c)
    return n.select(
        get("element_title").alias("RSD Name"), F.lit(author).alias("Authors"), get("skill_statement").alias("Skill Statement"), get("unit_title").alias("Categories"),
        get("keywords_semicolon", "keywords").alias("Keywords"), F.col("unit_number").alias("Standards"), *[F.lit("").alias(c) for c in OSMT_BLANK],
    )


def traceability(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Audit trail, 19 columns."""
    n = numbered_unit(rows, order)
    source = {
        "RSD Name": ("element_title",), "Unit Code": ("unit_number",), "Unit Title": ("unit_title",), "Element": ("element_title",), "Performance Criteria": ("pcs_text",),
        "Skill Statement": ("skill_statement",), "Keywords": ("keywords_semicolon", "keywords"), "TP Code": ("tp_code",), "TP Title": ("tp_title",), "Prompt": ("bart_prompt",),
        "Model": ("bart_model",), "Temperature": ("bart_temperature",), "QA: One Sentence": ("qa_one_sentence",), "QA: Word Count": ("qa_word_count",), "QA: Has Method": ("qa_has_method",),
        "QA: Has Outcome": ("qa_has_outcome",), "QA: Passes": ("qa_passes",), "Rewrites": ("rewrite_count",), "Error": ("error_message",),
    }
    flags = ("qa_one_sentence", "qa_has_method", "qa_has_outcome", "qa_passes")
    return n.select(*[(_flag(n, names[0]) if names[0] in flags else first_column(n, *names)).alias(c) for c, names in source.items()])


#: Children of one unit in a nested record; a unit with more is written in several records of `part` 1, 2, ...
PART_ROWS = 5_000


def unit_records(units: DataFrame, statements: DataFrame, memberships: DataFrame, links: DataFrame, all_links: bool = False) -> DataFrame:
    """(uoc_code, part, record): nested records as JSON, null fields kept.

    A record has the unit's header, its primary occupation, statements in row order with element ids, memberships and
    occupation links. Units without children have empty lists. Statements of a very large unit are spread over parts, so
    that no task holds an unbounded unit.
    """
    st = statements.where(F.col("skill_statement").isNotNull()).select(F.col("unit_code").alias("uoc_code"), "row_index", "id", "element_title", "skill_statement", "keywords", "qa_passes")
    st = numbered(st, F.col("uoc_code"), [F.col("row_index").asc_nulls_last(), F.col("id")], "n").withColumn("part", F.floor((F.col("n") - 1) / PART_ROWS).cast("int") + 1)
    entry = F.struct(
        "n", codes.element_id(F.col("uoc_code"), F.col("n")).alias("element_id"), "element_title", F.col("skill_statement").alias("statement"),
        F.filter(F.transform(F.split("keywords", ";"), lambda k: F.trim(k)), lambda k: k != "").alias("keywords"),
        F.when(F.col("qa_passes"), "Verified").otherwise("Pending Review").alias("status"), codes.evidence(F.col("skill_statement"), F.lit(None).cast("string")).alias("evidence"),
    )
    listed = st.groupBy("uoc_code", "part").agg(F.array_sort(F.collect_list(entry)).alias("statements"))
    members = memberships.select("uoc_code", F.struct("qual_code", "membership_type", "elective_group", "is_imported", "owner_tp_code").alias("m")).where("uoc_code is not null").distinct()
    members = members.groupBy("uoc_code").agg(F.array_sort(F.collect_list("m")).alias("memberships"), F.bool_or("m.is_imported").alias("is_imported"), F.bool_and(F.coalesce("m.is_imported", F.lit(False))).alias("imported_only"))
    link = F.struct(F.coalesce("is_primary", F.lit(False)).alias("is_primary"), "confidence", "anzsco_code", "anzsco_title", codes.occupation_uri(F.col("anzsco_code")).alias("uri"), "mapping_source", "source_qual_code", "industry_sector")
    linked = links.where(F.col("valid_to").isNull()).select("uoc_code", link.alias("l")).distinct()
    linked = linked.groupBy("uoc_code").agg(F.max("l").alias("best"), F.sort_array(F.collect_list("l"), False).alias("links"))
    if not all_links:
        linked = linked.withColumn("links", F.filter("links", lambda x: x.is_primary))
    joined = units.join(listed, "uoc_code", "left").join(members, "uoc_code", "left").join(linked, "uoc_code", "left")
    record = F.struct(
        "uoc_code", "uoc_title", "tp_code", F.coalesce("tp_title", F.lit("")).alias("tp_title"), F.coalesce("usage_recommendation", F.lit("Current")).alias("usage_recommendation"),
        F.struct(F.coalesce("is_imported", F.lit(False)).alias("is_imported"), F.coalesce("imported_only", F.lit(False)).alias("imported_only"), codes.owner(F.col("uoc_code"), F.col("tp_code")).alias("owner_tp_code")).alias("import_status"),
        F.col("best").alias("primary_occupation"), F.coalesce("statements", F.array()).alias("skill_statements"), F.coalesce("memberships", F.array()).alias("qualification_memberships"), F.coalesce("links", F.array()).alias("occupation_links"),
    )
    return joined.select("uoc_code", F.coalesce("part", F.lit(1)).alias("part"), F.to_json(record, {"ignoreNullFields": "false"}).alias("record"))


def write_csv(rows: DataFrame, path: str, single: bool = False) -> None:
    """CSV with a header and quoted line breaks; `single` writes one file and is meant for small results."""
    (rows.coalesce(1) if single else rows).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_jsonl(records: DataFrame, path: str) -> None:
    """One JSON document per line."""
    records.select("record").write.mode("overwrite").text(path)
