"""Registered queries of the training-data operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillweave.llm import chunking, leakage, mapping, mixing, neardup, pairs, topn
from skillweave.plans.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The three best links of every unit."""
    links = table(spark, d, "uoc_occupation_links").where(F.col("confidence").isNotNull() & F.col("uoc_code").isNotNull())
    primary = F.coalesce("is_primary", F.lit(False))
    keep = ["uoc_code", "confidence", "_primary", "anzsco_code"]
    distinct = topn.distinct_rows(links.withColumn("_primary", primary), "id", keep)
    order = [topn.Key(F.col("confidence"), ascending=False), topn.Key(F.col("_primary"), ascending=False), topn.Key(F.col("anzsco_code"), nulls_first=False)]
    return topn.top_n(distinct, group="uoc_code", order=order, n=3, id_col="id").select("uoc_code", F.col("id").alias("link_id"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The occupation that each typed title means, '' where the list holds none."""
    typed, codes = table(spark, d, "qual_taxonomy_links"), table(spark, d, "anzsco_codes")
    found = mapping.map_values(typed, codes, row_id="id", value="occupation_titles", code="anzsco_code", title="anzsco_title")
    return found.select(F.col("row_id").alias("link_id"), F.col("code").alias("anzsco_code"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Skill records whose statement is no proper answer to its prompt."""
    return pairs.broken_pairs(table(spark, d, "rsd_skill_records"), record_id="id", prompt="bart_prompt", response="skill_statement")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of skill records with at least 80 % of their words in common."""
    records = table(spark, d, "rsd_skill_records")
    return neardup.pairs_of_records(*neardup.near_duplicates(records, "id", "element_title", "pcs_text", "skill_statement"))


def p7_groups(spark: SparkSession, d: str) -> DataFrame:
    """The group of every skill record that has words, with its copies and links."""
    records = table(spark, d, "rsd_skill_records")
    return neardup.groups_of_records(*neardup.near_duplicates(records, "id", "element_title", "pcs_text", "skill_statement"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold at least half of an evaluation item."""
    return leakage.leaked(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p9_mixed(spark: SparkSession, d: str) -> DataFrame:
    """The mix to the plan's shares, one row per use of a document."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "source_plan"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares reached, by source."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "source_plan"))[1]


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of the documents that exceed their source's limit."""
    return chunking.pieces(table(spark, d, "documents"), table(spark, d, "source_plan"))


QUERIES = {"p1_found": p1_found, "p3_found": p3_found, "p5_found": p5_found, "p7_found": p7_found, "p7_groups": p7_groups, "p8_found": p8_found, "p9_mixed": p9_mixed, "p9_shares": p9_shares, "p10_pieces": p10_pieces}

_SIMILAR = """
w AS (SELECT id, list_sort(list_distinct(regexp_extract_all(lower(concat_ws(' ', element_title, pcs_text, skill_statement)), '\\p{L}+'))) w FROM rsd_skill_records),
k AS (SELECT w, min(id) class_id, count(*) n_copies FROM w WHERE len(w) > 0 GROUP BY w),
u AS (SELECT class_id id, len(w) n, unnest(w) x FROM k),
p AS (SELECT a.id a, b.id b, any_value(a.n) + any_value(b.n) n, count(*) c FROM u a JOIN u b ON a.x = b.x AND a.id < b.id GROUP BY 1, 2),
e AS (SELECT a, b FROM p WHERE c * 5 >= (n - c) * 4 UNION ALL SELECT b, a FROM p WHERE c * 5 >= (n - c) * 4),
"""

ORACLE = {
    "p1_found": """
WITH u AS (SELECT * EXCLUDE (id), min(id) id FROM uoc_occupation_links WHERE confidence IS NOT NULL AND uoc_code IS NOT NULL GROUP BY ALL)
SELECT uoc_code, id link_id FROM u
QUALIFY row_number() OVER (PARTITION BY uoc_code ORDER BY confidence DESC, coalesce(is_primary, false) DESC, anzsco_code ASC NULLS LAST, id) <= 3
""",
    "p7_found": """
WITH w AS (SELECT id, list_distinct(regexp_extract_all(lower(concat_ws(' ', element_title, pcs_text, skill_statement)), '\\p{L}+')) w FROM rsd_skill_records),
u AS (SELECT id, len(w) n, unnest(w) x FROM w),
p AS (SELECT a.id id_a, b.id id_b, any_value(a.n) + any_value(b.n) n, count(*) c FROM u a JOIN u b ON a.x = b.x AND a.id < b.id GROUP BY 1, 2)
SELECT id_a, id_b FROM p WHERE c * 5 >= (n - c) * 4
""",
    "p7_groups": "WITH RECURSIVE" + _SIMILAR + """
r AS (SELECT class_id n, class_id g FROM k UNION SELECT e.b, r.g FROM r JOIN e ON e.a = r.n),
g AS (SELECT n, min(g) group_id FROM r GROUP BY 1), d AS (SELECT a, count(*) n_links FROM e GROUP BY 1)
SELECT w.id, class_id, n_copies, coalesce(n_links, 0) n_links, group_id FROM w JOIN k USING (w) JOIN g ON g.n = class_id LEFT JOIN d ON d.a = class_id
""",
    "p8_found": """
WITH i0 AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') w FROM eval_items),
i AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2])) r FROM i0),
d0 AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') w FROM documents WHERE text IS NOT NULL),
d AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2])) r FROM d0),
n AS (SELECT item_id, count(*) n FROM i GROUP BY 1)
SELECT doc_id, item_id FROM d JOIN i USING (r) JOIN n USING (item_id) GROUP BY doc_id, item_id, n HAVING count(*) * 2 >= n
""",
}
