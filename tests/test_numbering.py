import random

import pytest
from pyspark.sql import functions as F

from skillweave.operators.numbering import numbered


@pytest.mark.parametrize("hot_rows", [10_000, 50, 1])
def test_numbers_of_groups_of_any_size(spark, hot_rows):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", None, "a", "b"]), rng.choice([None, 1, 2, 3]), i, "x") for i in range(400)]
    df = spark.createDataFrame(rows, "g string, o int, id int, n string").repartition(5)
    found = {r.id: r.place for r in numbered(df, F.col("g"), [F.col("o").asc_nulls_last(), F.col("id")], "place", hot_rows).collect()}
    expected = {}
    for g in {r[0] for r in rows}:
        expected |= {r[2]: k for k, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, r[1] or 0, r[2])), 1)}
    assert found == expected


def test_empty(spark):
    df = spark.createDataFrame([], "g string, id int")
    assert numbered(df, F.col("g"), [F.col("id")], "n").collect() == []
