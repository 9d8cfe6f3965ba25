import pytest
from pyspark.sql import functions as F

from skillweave.functions import codes
from skillweave.functions import text as tx
from skillweave.operators import export, linkage, upsert

SCHEMA = "k int, a string, b int, c string"


def test_policies(spark, rows):
    base = spark.createDataFrame([(1, "a", 5, ""), (2, "b", 1, "old"), (None, "n", 1, None)], SCHEMA)
    delta = spark.createDataFrame([(1, None, 3, "new"), (2, "z", 9, "new"), (3, "c", 1, "x"), (2, "y", 9, "new"), (None, "m", 0, "f")], SCHEMA)
    out = upsert.upsert(base, delta, ["k"], {"a": "coalesce_new_old", "b": "greatest", "c": "fill_blank"}, [F.col("a")])
    assert rows(out) == sorted([(1, "a", 5, "new"), (2, "z", 9, "old"), (3, "c", 1, "x"), (None, "m", 1, "f")], key=lambda t: tuple((x is None, str(x)) for x in t))
    assert rows(upsert.upsert(base, delta.limit(0), ["k"], {})) == rows(base)
    with pytest.raises(ValueError):
        upsert.upsert(base, delta, ["k"], {"a": "other"})


def test_insert_absent(spark, rows):
    base = spark.createDataFrame([(1, "a", 5, "")], SCHEMA)
    delta = spark.createDataFrame([(1, "z", 1, ""), (2, "q", 2, ""), (2, "p", 1, "")], SCHEMA)
    assert rows(upsert.insert_absent(base, delta, ["k"], [F.col("b")])) == [(1, "a", 5, ""), (2, "p", 1, "")]


def test_expire_leaves_untouched_open(spark):
    links = spark.sql("select * from values ('u', timestamp_ntz'2024-01-01', cast(null as timestamp_ntz)), ('v', timestamp_ntz'2024-01-01', null) t(uoc_code, valid_from, valid_to)")
    out = upsert.expire(links, spark.createDataFrame([("u",), ("u",)], "uoc_code string"), "uoc_code", F.lit("2025-01-01").cast("timestamp_ntz"))
    assert {(r.uoc_code, r.valid_to is None) for r in out.collect()} == {("u", False), ("v", True)} and out.count() == 2


def test_backfill(spark, rows):
    held = spark.createDataFrame([(1, ""), (2, "x"), (3, None), (4, None)], "k int, t string")
    source = spark.createDataFrame([(1, "one"), (2, "two"), (3, "three")], "key int, title string")
    assert rows(upsert.backfill(held, source, ("k", "key"), {"t": "title"})) == [(1, "one"), (2, "x"), (3, "three"), (4, None)]


def test_qa(spark):
    def text(n):
        return "Use tools " + "x " * (n - 6) + "by hand to work."

    rows = spark.createDataFrame([(n, text(n)) for n in (29, 30, 60, 61)] + [(1, "One. Two."), (2, "nothing here")], "n int, t string")
    found = {r.n: r for r in rows.select("n", *[c.alias(k) for k, c in tx.qa(F.col("t")).items()], tx.qa_issues(F.col("t")).alias("issues")).collect()}
    assert [(found[n].word_count, found[n].passes) for n in (29, 30, 60, 61)] == [(29, False), (30, True), (60, True), (61, False)]
    assert not found[1].one_sentence and not found[2].has_method and "Too short (2 words)" in found[2].issues


def test_classifiers(spark):
    rows = spark.createDataFrame([(1, "Review the budget report"), (2, ""), (3, None), (4, "Zzz"), (5, "evaluate design develop " * 40)], "i int, t string")
    c = F.col("t")
    found = {r.i: r for r in rows.select("i", tx.primary_verb(c).alias("v"), tx.domain(c).alias("d"), tx.verb_group(c).alias("g"), tx.complexity(c).alias("x")).collect()}
    assert (found[1].v, found[1].d, found[1].g) == ("review", "Business", "Analyse")
    assert found[2].x == found[3].x == found[4].x == 5.0 and found[4].v == "other" and found[4].g == "Other" and found[5].x == 10.0


def test_codes(spark):
    row = spark.sql("select '2347-11' c, 'Certificate III in X' l, 'BSBWHS201' u, '' b").select(
        codes.major_group(F.col("c")), codes.occupation_uri(F.col("c")), codes.level_label(F.col("l")), codes.level_label(F.col("l"), True), codes.imported(F.col("u"), F.lit("TLI")), codes.element_id(F.col("u"), F.lit(2)),
        codes.owner(F.col("u"), F.col("b")), codes.occupation_uri(F.col("b")), codes.level_label(F.col("b")), codes.effective_code(F.col("b"), F.lit(" 22 ")),
    ).head()
    assert tuple(row) == ("Professionals", codes.OCCUPATION_URI + "234711", "Foundation", "Trades / Operational", True, "BSBWHS201-E02", "BSB", "", "Unspecified", "22")


def test_linkage(spark):
    members = spark.createDataFrame([("U1", "Q1", "core", False), (" u1", "q1 ", "Elective", True), ("U2", "Q1", "elective", None), ("U3", "OLD", "core", False), ("U1", "Q1", "core", False)], "uoc_code string, qual_code string, membership_type string, is_imported boolean")
    quals = spark.createDataFrame([("Q1",)], "qual_code string")
    aims = spark.createDataFrame([("Q1", "2347", "Vet", None), ("Q1", "12", "short", None), ("Q1", "2347", "Vet", None)], "qual_code string, anzsco_identifier string, occupation_titles string, industry_sector string")
    best = linkage.best_links(linkage.qualification_candidates(members, quals, aims))
    assert {(r.uoc_code, r.anzsco_code, float(r.confidence), r.mapping_source) for r in best.collect()} == {("U1", "2347", 0.85, "core_native"), ("U2", "2347", 0.5, "elective_native")}
    direct = linkage.direct_candidates(spark.createDataFrame([("U2", "", "9999"), ("U2", "1", "")], "uoc_code string, code string, value string"))
    every = linkage.best_links(linkage.qualification_candidates(members, quals, aims).unionByName(direct))
    marked = {(r.uoc_code, r.anzsco_code): r.is_primary for r in linkage.with_primary(every).collect()}
    assert marked == {("U1", "2347"): True, ("U2", "9999"): True, ("U2", "2347"): False}
    strong = every.where(F.col("confidence") >= linkage.STRONG)
    weak = linkage.task_candidates(spark.createDataFrame([("U1", "1111", "t"), ("U9", "1111", "t")], "uoc_code string, anzsco_code string, anzsco_title string"), strong)
    assert [r.uoc_code for r in weak.collect()] == ["U9"]


def test_exports(spark):
    full = spark.createDataFrame([("BSBWHS201", "Contribute", "Prepare", "1.1 x", "Apply procedures.", True, "whs; ppe", 1)], "unit_code string, unit_title string, element_title string, pcs_text string, skill_statement string, qa_passes boolean, keywords string, id int")
    out = export.rsd_rows(full, [F.col("id")])
    assert tuple(out.columns) == export.RSD_COLUMNS and out.head()["Unit Code"] == "BSBWHS201.1" and out.head()["RSD Name"] == "Prepare"
    trace = export.traceability(full, [F.col("id")])
    assert len(trace.columns) == 19 and {"Prompt", "QA: Passes", "Rewrites"} <= set(trace.columns)
    sparse = spark.createDataFrame([("X", "s"), (None, "t")], "unit_code string, skill_statement string")
    assert export.rsd_rows(sparse, [F.col("skill_statement")]).count() == 2 and len(export.osmt_rows(sparse, [F.col("skill_statement")]).columns) == 19
    assert {r["Unit Code"] for r in export.rsd_rows(sparse, [F.col("skill_statement")]).collect()} == {"X.1", "UNIT.1"}


def test_csv_round_trip(spark, tmp_path):
    from skillweave.sources import files

    rows = spark.createDataFrame([("a\nb", 'q"x'), ("ü,", None)], "x string, y string")
    export.write_csv(rows, str(tmp_path / "out.csv"), single=True)
    assert sorted(tuple(r) for r in files.read(spark, str(tmp_path / "out.csv")).collect()) == sorted([("a\nb", 'q"x'), ("ü,", None)])
