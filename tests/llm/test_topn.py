import random
from decimal import Decimal

from pyspark.sql import functions as F

from skillweave.llm import topn

SCHEMA = "g string, score decimal(4,3), flag boolean, code string, id long, rank int, count int, pid int"


def brute(rows, n):
    out = {}
    for r in sorted({tuple(x) for x in rows}, key=lambda r: (r[0] or "", r[1] is None, -(r[1] or 0), not r[2], r[3] is None, r[3] or "", r[4])):
        out.setdefault(r[0], []).append(r[4])
    return sorted(((g, i, p) for g, ids in out.items() for p, i in enumerate(ids[:n], 1)), key=str)


def run(spark, rows, n=3):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("_f", F.coalesce("flag", F.lit(False)))
    order = [topn.Key(F.col("score"), ascending=False), topn.Key(F.col("_f"), ascending=False), topn.Key(F.col("code"), nulls_first=False)]
    return sorted((tuple(r) for r in topn.top_n(df, group="g", order=order, n=n, id_col="id").collect()), key=str)


def make(n, seed=1):
    rng = random.Random(seed)
    return [
        (rng.choice(["hot", "hot", "a", "b", None, f"g{rng.randrange(50)}"]), rng.choice([None, Decimal("0.5"), Decimal("0.25"), Decimal("0.125")]), rng.choice([True, False, None]), rng.choice(["x", "y", None]), i, 1, 2, 3)
        for i in range(n)
    ]


def test_against_sort(spark):
    rows = make(2000)
    for n in (1, 3, 40):
        assert run(spark, rows, n) == brute(rows, n)


def test_group_larger_than_a_partition(spark):
    rows = [("hot", Decimal("0.5"), None, None, i, 0, 0, 0) for i in range(3000)]
    assert run(spark, rows, 2000) == brute(rows, 2000)


def test_empty_and_none_asked(spark):
    assert run(spark, []) == [] and run(spark, make(20), 0) == []


def test_distinct_rows(spark):
    rows = [("a", 1, 5), ("a", 1, 3), (None, 1, 2), ("a", None, 1), (None, None, 4), ("a", 1, 9)]
    df = spark.createDataFrame(rows, "a string, b int, id long")
    assert sorted(r.id for r in topn.distinct_rows(df, "id", ["a"]).collect()) == [1, 2, 3, 4]


def test_nulls_in_other_places_differ(spark):
    df = spark.createDataFrame([("v", None, 1), (None, "v", 2)], "a string, b string, id long")
    assert topn.distinct_rows(df, "id", []).count() == 2


def test_long_values(spark):
    assert run(spark, [("g" * 100_000, Decimal("0.5"), True, "c" * 100_000, 1, 0, 0, 0)]) == [("g" * 100_000, 1, 1)]


def test_rows_with_nested_columns(spark):
    df = spark.sql("select * from values (1, map('a', 1), array('x')), (2, map('a', 1), array('x')), (3, map('a', 2), array('x')), (4, null, null) t(id, m, l)")
    assert sorted(r.id for r in topn.distinct_rows(df, "id", []).collect()) == [1, 3, 4]


def test_batches_of_any_size(spark):
    rows = make(300, 4)
    for size in ("1", "7"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            assert run(spark, rows, 5) == brute(rows, 5)
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
