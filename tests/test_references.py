from datetime import datetime

from pyspark.sql import functions as F

from skillweave.operators import references

OLD, NEW = datetime(2024, 1, 1), datetime(2024, 6, 1)


def find(spark, refs, parents, hot_rows=references.HOT_ROWS):
    r = spark.createDataFrame(refs, "id long, code string, created_at timestamp_ntz, reason string, salt int, registry int")
    p = spark.createDataFrame(parents, "code string, got timestamp_ntz, status string, id long")
    held = references.parent_intervals(p, key=F.col("code"), received=F.col("got"), deleted=F.lower(F.trim("status")) == "deleted", latest_by=[F.col("id")])
    found = references.dangling([references.references(r, name="t", field="code", registry="x")], {"x": held}, hot_rows)
    return sorted((x.row_id, x.reason) for x in found.collect())


PARENTS = [("A1", OLD, "Current", 1), ("B2", NEW, "Current", 1), ("C3", OLD, "Current", 1), (" c3 ", NEW, " DELETED", 2), ("D4", OLD, "Deleted", 1), ("d4", NEW, "Current", 2), (None, OLD, "Deleted", 1), ("E5", NEW, "deleted", 1)]
REFS = [
    (1, "a1", OLD), (2, " A1 ", NEW), (3, "B2", OLD), (4, "B2", NEW), (5, "C3", NEW), (6, "D4", NEW), (7, "ZZ", OLD), (8, "", OLD), (9, "  ", OLD), (10, None, OLD), (11, "B2", None), (12, "E5", OLD), (7, "ZZ", OLD),
]
EXPECTED = [(3, "late"), (5, "deleted"), (7, "missing"), (7, "missing"), (12, "deleted")]


def full(rows):
    return [(i, c, t, "no", 0, 0) for i, c, t in rows]


def test_reasons(spark):
    assert find(spark, full(REFS), PARENTS) == EXPECTED


def test_hot_codes_are_salted_without_change(spark):
    many = full(REFS + [(100 + i, "B2", OLD) for i in range(300)] + [(1000 + i, "QQ", OLD) for i in range(300)])
    plain = find(spark, many, PARENTS)
    assert plain == find(spark, many, PARENTS, hot_rows=50) and len(plain) == len(EXPECTED) + 600


def test_empty_tables(spark):
    assert find(spark, [], PARENTS) == []
    assert find(spark, full([(1, "a", OLD)]), []) == [(1, "missing")]


def test_report(spark):
    r = spark.createDataFrame([("t", "f", i, OLD, "A", "missing") for i in range(3)], "src_table string, ref_field string, row_id long, at timestamp_ntz, code string, reason string")
    assert [tuple(x) for x in references.dangling_report(r).collect()] == [("t", "f", "2024-01", "missing", 3, 1)]


def test_long_codes(spark):
    assert find(spark, full([(1, "x" * 100_000, OLD)]), PARENTS) == [(1, "missing")]


def test_intervals(spark):
    p = spark.createDataFrame(PARENTS, "code string, got timestamp_ntz, status string, id long")
    held = references.parent_intervals(p, key=F.col("code"), received=F.col("got"), deleted=F.lower(F.trim("status")) == "deleted", latest_by=[F.col("id")])
    assert {tuple(r) for r in held.collect()} == {("A1", OLD, None, False), ("B2", NEW, None, False), ("C3", OLD, NEW, True), ("D4", OLD, None, False), ("E5", NEW, NEW, True)}
