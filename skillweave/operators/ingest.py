"""Ingestion of qualification details and of the wide sheet, as pure functions from tables to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skillweave.functions import codes
from skillweave.functions import text as tx
from skillweave.operators.upsert import first_by, insert_absent, upsert

DETAIL = (
    "struct<Code:string,Title:string,Status:string,TrainingPackageCode:string,AqfLevel:string,"
    "Classifications:array<struct<Scheme:string,Value:string,Description:string>>,Units:array<struct<Code:string,Title:string,IsEssential:boolean>>>"
)
# Confidence of links derived from the sheet.
SHEET_CONFIDENCE = {"core": "0.50", "elective": "0.40"}
#: Values of the sheet that stand for nothing (fixed values).
SENTINELS = ("", "N/A", "nan")


def _held(value: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(value), F.lit("")), F.lit(""))


def from_details(rows: DataFrame, payload: str) -> dict[str, DataFrame]:
    """qualifications, taxonomy, units and memberships of the JSON details in `payload`; payloads without a code give nothing."""
    parsed = rows.select(F.from_json(payload, DETAIL).alias("q")).where(_held(F.col("q.Code")) != "").select("q.*")
    package = codes.owner(F.col("Code"), F.col("TrainingPackageCode"))
    quals = parsed.select(F.col("Code").alias("qual_code"), _held(F.col("Title")).alias("qual_title"), package.alias("tp_code"), F.nullif(F.trim("AqfLevel"), F.lit("")).alias("aqf_level"), F.coalesce("Status", F.lit("Current")).alias("status"))
    schemes = parsed.select(F.col("Code").alias("qual_code"), F.posexplode("Classifications").alias("n", "c"))
    taxonomy = schemes.select("qual_code", "n", _held(F.col("c.Scheme")).alias("scheme"), F.coalesce(F.nullif(F.trim("c.Description"), F.lit("")), F.trim("c.Value"), F.lit("")).alias("value"))
    members = parsed.select(F.col("Code").alias("qual_code"), package.alias("tp"), F.explode("Units").alias("u")).where(_held(F.col("u.Code")) != "")
    return {
        "qualifications": quals,
        # Of several values for a scheme the last in the delivery counts.
        "taxonomy": taxonomy.where("scheme <> '' and value <> ''").groupBy("qual_code", "scheme").agg(F.max_by("value", "n").alias("value")),
        "units": members.groupBy(F.trim("u.Code").alias("uoc_code")).agg(F.max(_held(F.col("u.Title"))).alias("uoc_title")).withColumn("tp_code", codes.owner(F.col("uoc_code"))),
        "memberships": members.select(
            F.trim("u.Code").alias("uoc_code"), "qual_code", F.when(F.coalesce("u.IsEssential", F.lit(False)), "core").otherwise("elective").alias("membership_type"),
            codes.imported(F.trim("u.Code"), F.col("tp")).alias("is_imported"), codes.owner(F.trim("u.Code")).alias("owner_tp_code"),
        ).distinct(),
    }


def merge(tables: dict[str, DataFrame], new: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The four tables after a delivery: titles and status overwritten, a level kept where the new one is null, memberships only added."""
    return {
        "qualifications": upsert(tables["qualifications"], new["qualifications"], ["qual_code"], {"qual_title": "overwrite", "status": "overwrite", "aqf_level": "coalesce_new_old"}),
        "taxonomy": upsert(tables["taxonomy"], new["taxonomy"], ["qual_code", "scheme"], {"value": "overwrite"}),
        "units": upsert(tables["units"], new["units"], ["uoc_code"], {"uoc_title": "overwrite"}),
        "memberships": insert_absent(tables["memberships"], new["memberships"], ["uoc_code", "qual_code", "membership_type"], [F.col("is_imported"), F.col("owner_tp_code")]),
    }


def seed_units(skills: DataFrame) -> DataFrame:
    """(uoc_code, uoc_title, tp_code) of the units that skill records name; the first title by id."""
    named = skills.where(_held(F.col("unit_code")) != "").select(F.trim("unit_code").alias("uoc_code"), _held(F.col("unit_title")).alias("uoc_title"), codes.owner(F.trim("unit_code"), F.col("tp_code")).alias("tp_code"), "id")
    return first_by(named, ["uoc_code"], [(F.col("uoc_title") == ""), F.col("id")]).drop("id")


def sheet_units(wide: DataFrame) -> DataFrame:
    """(row_id, qual_code, kind, uoc_code) of the unit lists of the wide sheet; entries that aren't unit codes are left out."""
    sides = [wide.select("row_id", F.trim("qualification_code").alias("qual_code"), F.lit(k).alias("kind"), F.explode(tx.listed(F.col(c), r"[\n\r\t;|•,]+")).alias("raw")) for k, c in (("core", "core_unit_codes"), ("elective", "elective_unit_codes"))]
    plain = F.trim(F.translate("raw", '"“”', ""))
    return sides[0].unionByName(sides[1]).select("row_id", "qual_code", "kind", plain.alias("uoc_code")).where(F.col("uoc_code").rlike(tx.UNIT_CODE))


def sheet_links(wide: DataFrame) -> DataFrame:
    """Occupation links derived from the sheet: one per unit, qualification and list; all of a unit's best are primary.

    Sentinel values of the sheet count as nothing: a link keeps '' for what it doesn't know.
    """
    value = lambda c: F.when(F.coalesce(F.trim(c), F.lit("")).isin(*SENTINELS), "").otherwise(F.trim(c))
    facts = wide.select("row_id", value("anzsco_identifier").alias("anzsco_code"), value("taxonomy_industry_sector").alias("industry_sector"), value("taxonomy_occupation").alias("occupation_titles"))
    confidence = F.when(F.col("kind") == "core", F.lit(SHEET_CONFIDENCE["core"])).otherwise(F.lit(SHEET_CONFIDENCE["elective"])).cast("decimal(5,3)")
    joined = sheet_units(wide).join(facts, "row_id").withColumn("confidence", confidence).withColumn("mapping_source", F.concat("kind", F.lit("_native")))
    one = first_by(joined, ["uoc_code", "qual_code", "kind"], [F.col("row_id").desc()])
    best = F.max("confidence").over(Window.partitionBy("uoc_code"))
    return one.select("uoc_code", F.col("qual_code").alias("source_qual_code"), "anzsco_code", tx.tidy_taxonomy(F.col("occupation_titles")).alias("occupation_titles"), "industry_sector", "confidence", "mapping_source", (F.col("confidence") == best).alias("is_primary"))
