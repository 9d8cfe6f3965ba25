import json

from skillweave.operators import ingest

DETAIL = {
    "Code": "ACM30121", "Title": "Certificate III", "Status": "Current", "AqfLevel": "Certificate III",
    "Classifications": [{"Scheme": "ANZSCO Identifier", "Value": "3613"}, {"Scheme": "ANZSCO Identifier", "Value": "x", "Description": "3614"}, {"Scheme": "", "Value": "y"}],
    "Units": [{"Code": "ACMGEN101", "Title": "Explore", "IsEssential": True}, {"Code": "BSBWHS201", "IsEssential": False}, {"Code": "BSBWHS201", "IsEssential": False}, {"Code": " "}],
}


def test_details_and_merge(spark, rows):
    raw = spark.createDataFrame([(json.dumps(DETAIL),), ("{}",), (None,), ("broken",)], "p string")
    new = ingest.from_details(raw, "p")
    assert rows(new["taxonomy"]) == [("ACM30121", "ANZSCO Identifier", "3614")]
    assert rows(new["memberships"]) == [("ACMGEN101", "ACM30121", "core", False, "ACM"), ("BSBWHS201", "ACM30121", "elective", True, "BSB")]
    later = ingest.from_details(spark.createDataFrame([(json.dumps(DETAIL | {"Title": "New", "AqfLevel": None, "Units": [{"Code": "ACMGEN101", "Title": ""}]}),)], "p string"), "p")
    merged = ingest.merge(new, later)
    assert rows(merged["qualifications"]) == [("ACM30121", "New", "ACM", "Certificate III", "Current")]
    assert {(r.uoc_code, r.uoc_title) for r in merged["units"].collect()} == {("ACMGEN101", ""), ("BSBWHS201", "")}
    assert merged["memberships"].count() == 3


def test_sheet(spark, rows):
    wide = spark.createDataFrame([(1, "Q1", "ABC101|ABC102", "ABC102; zz", "Vet | Nurse", "N/A", "3613"), (2, "Q1", "ABC101", None, None, None, None), (3, "Q2", "", "ABC101", "", "Care", "N/A")],
        "row_id long, qualification_code string, core_unit_codes string, elective_unit_codes string, taxonomy_occupation string, taxonomy_industry_sector string, anzsco_identifier string")
    found = {(r.uoc_code, r.source_qual_code, r.mapping_source): (r.anzsco_code, r.occupation_titles, r.industry_sector, r.is_primary) for r in ingest.sheet_links(wide).collect()}
    assert found == {
        ("ABC101", "Q1", "core_native"): ("", "", "", True), ("ABC101", "Q2", "elective_native"): ("", "", "Care", False),
        ("ABC102", "Q1", "core_native"): ("3613", "Vet, Nurse", "", True), ("ABC102", "Q1", "elective_native"): ("3613", "Vet, Nurse", "", False),
    }


def test_seed_units(spark, rows):
    skills = spark.createDataFrame([(2, "ABC101", "Late", None), (1, " ABC101 ", "", "ABC"), (3, None, "x", None), (4, "", "x", None)], "id int, unit_code string, unit_title string, tp_code string")
    assert rows(ingest.seed_units(skills)) == [("ABC101", "Late", "ABC")]
