import json
import sys
import zipfile

from pyspark import cloudpickle
from pyspark.sql import functions as F

from skillweave.sources import files, pages, registry, services

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the workers can't import this file

HTML = """<html><h2>Classifications</h2><p>x</p><table><tr><th>Scheme</th><th>V</th></tr><tr><td>ANZSCO Identifier</td><td>361311; 361312</td></tr><tr><td>Taxonomy - Industry Sector</td><td>a</td><td>Animal Care</td></tr></table>
<h3>Core units</h3><table><tr><td colspan=2>Group A &ndash; Care</td></tr><tr><td>ACMGEN101</td><td>Explore jobs</td></tr><tr><td>ACMGEN102 Handle animals</td></tr></table>
<h3>Elective units Group B</h3><div><ul><li>BSBCMM411 Make <b>presentations</b></li><li>other</li></ul></div><h2>End</h2><ul><li>XYZ123 No</li></ul></html>"""
DETAIL = {
    "Code": "BSBCMM411", "Title": "Make presentations", "Status": "Current",
    "Elements": {"Element": [{"Num": "1", "Title": "Plan communication", "PerformanceCriteria": {"PerformanceCriterion": [{"Num": "1.1", "Description": "Identify"}, {"Num": "1.2", "Description": "Select"}]}},
                             {"Num": "2", "Title": "Deliver", "PerformanceCriteria": {"PerformanceCriterion": {"Num": "2.1", "Description": "Draft"}}}]},
}


def test_html(spark):
    assert pages.taxonomy_of(HTML) == {"anzsco": "361311, 361312", "industry": "Animal Care", "occupation": "N/A"}
    assert pages.taxonomy_of("<dl><dt>Taxonomy - Occupation</dt><dd>Vet nurse</dd></dl>")["occupation"] == "Vet nurse"
    assert [(u["section"], u["unit_code"], u["grp"]) for u in pages.units_of(HTML)] == [("core", "ACMGEN101", "Group A – Care"), ("core", "ACMGEN102", "Group A – Care"), ("elective", "BSBCMM411", "Elective units Group B")]
    rows = spark.createDataFrame([(1, HTML), (2, None), (3, "<p>unclosed <b>x")], "id int, html string")
    found = {r.id: r for r in rows.select("id", pages.taxonomy(F.col("html")).alias("t"), F.size(pages.units(F.col("html"))).alias("n")).collect()}
    assert found[1].t.anzsco == "361311, 361312" and [found[i].n for i in (1, 2, 3)] == [3, 0, 0]


def test_soap(spark):
    one = "<ClassificationScheme><Scheme>{}</Scheme><Value>{}</Value></ClassificationScheme>"
    xml = '<s:Body xmlns:s="urn:x">' + one.format("ANZSCO Identifier", "3613") + one.format("Industry Sector", "Animals") + one.format("ANZSCO Identifier", "3614") + "</s:Body>"
    described = xml.replace("<Value>Animals</Value>", "<Value>A</Value><Description>Animals</Description>")
    rows = spark.createDataFrame([(1, xml), (2, described), (3, "<broken"), (4, None)], "i int, x string").select("i", pages.soap_taxonomy(F.col("x")).alias("t")).orderBy("i").collect()
    assert [tuple(r.t) for r in rows] == [("3613, 3614", "Animals", "")] * 2 + [("", "", "")] * 2


def test_unit_detail(spark):
    rows = spark.createDataFrame([(json.dumps(DETAIL),), (None,), ("not json",), (json.dumps({"Code": "X1"}),)], "p string")
    found = pages.unit_rows(rows, "p").collect()
    assert [(r.unit_code, r.element_num, r.pc_num, r.pc_text) for r in found] == [("BSBCMM411", "1", "1.1", "Identify"), ("BSBCMM411", "1", "1.2", "Select"), ("BSBCMM411", "2", "2.1", "Draft")]


def test_organisation_and_search(spark):
    org = spark.createDataFrame([('{"Code":"1234","LegalName":"T","AddressState":"NSW"}',)], "p string").select(pages.organisation(F.col("p")).alias("o")).head().o
    assert tuple(org) == ("1234", "T", "", "", "NSW", "")
    search = {"data": [{"id": "Q1", "attributes": {"title": "One"}}, {"id": "Q2", "attributes": {"code": "Q1", "title": "Again"}}, {"id": ""}]}
    assert [tuple(r)[:2] for r in pages.qualification_summaries(spark.createDataFrame([(json.dumps(search),)], "p string"), "p").collect()] == [("Q1", "One")]


def test_xlsx(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>Third</t></is></c></row><row><c r="A2"><v>5</v></c><c r="C2" t="s"><v>1</v></c></row></sheetData></worksheet>'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Code</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    found = files.read(spark, str(tmp_path / "b.xlsx"))
    assert found.columns == ["Code", "column_2", "Third"] and [tuple(r) for r in found.collect()] == [("5", None, "ab")]


def test_files_and_columns(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a")], "k int, v string")
    for kind in ("parquet", "orc", "json"):
        rows.write.format(kind).save(str(tmp_path / f"t.{kind}"))
        assert files.read(spark, str(tmp_path / f"t.{kind}")).count() == 1
    more = files.ensure_columns(rows, {"v": ("string", "x"), "w": ("double", 1.5)})
    assert [tuple(r) for r in more.collect()] == [(1, "a", 1.5)]
    assert files.remaining(rows, rows, "k").count() == 0


def test_registry_source(spark, tmp_path):
    registry.register(spark)
    (tmp_path / "r.json").write_text(json.dumps([{"code": f"{'BSB' if i % 2 else 'TLI'}{i}", "title": f"t{i}"} for i in range(25)]))
    found = spark.read.format("registry_search").option("path", str(tmp_path / "r.json")).option("page_size", 10).option("pages", 3).option("prefixes", "BSB").load()
    assert found.count() == 12 and {r.page for r in found.collect()} == {1, 2, 3}


class Echo:
    name = "echo"

    def chat_completion(self, messages, model, temperature, max_tokens=1500):
        if "fail" in messages[0]["content"]:
            raise services.Retryable("busy")
        return "Fixed by using words to pass " + "x " * 30 if len(messages) > 1 else "short"


def test_generation(spark):
    rows = spark.createDataFrame([(1, "go"), (2, "fail")], "id int, p string")
    found = {r.id: r for r in services.generate(rows, "id", "p", Echo).collect()}
    assert found[1].rewrites == 1 and found[1].error is None and found[2].error == "busy" and found[2].statement.startswith("ERROR")
    assert services.keywords(rows.where("id = 1"), "id", "p", "p", Echo).head().keywords == "short"


def test_retry_and_fallback():
    calls, waits = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise services.Retryable
        return "ok"

    assert services.retried(flaky, sleep=waits.append) == "ok" and waits == [10.0, 20.0]

    class Down(Echo):
        def chat_completion(self, *a, **k):
            raise services.Retryable

    assert services.Fallback(Down(), Echo()).chat_completion([{"content": "x"}], "", 0) == "short"


class Catalogue:
    def skills(self, text, limit):
        return [{"uri": "s1", "title": text[:3], "score": 0.9}, {"uri": "s2", "title": "low", "score": 0.1}][:limit]

    def occupations(self, uri, relation, limit):
        return [{"uri": "o1", "title": relation}, {"uri": relation, "title": "x"}]


def test_skill_matching_and_embedding(spark):
    rows = spark.createDataFrame([(1, "weld steel"), (2, None), (3, " ")], "id int, t string")
    found = {r.id: r for r in services.match_skills(rows, "id", "t", Catalogue, min_score=0.5).collect()}
    assert found[1].skill_uris == ["s1"] and found[1].occupation_titles[0] == "isEssentialForOccupation" and len(found[1].occupation_uris) == 3 and found[2].skill_uris == []
    vectors = {r.id: r.embedding for r in services.embed(rows, "id", "t", lambda: services.hashing_embedder(8), 2).collect()}
    assert len(vectors[1]) == 8 and vectors[2] == vectors[3]


def test_fetch(spark):
    def factory():
        def call(code):
            if code == "B":
                raise OSError("no")
            return code.lower()

        return call

    codes = spark.createDataFrame([("A",), ("A",), ("B",), (None,)], "code string")
    assert {(r.code, r.payload, r.error) for r in services.fetch(codes, "code", factory).collect()} == {("A", "a", None), ("B", None, "no")}
