"""Version histories against a plain loop."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skillweave.operators import history

SCHEMA = "k string, at timestamp_ntz, a string, b string, made int, id long, until timestamp_ntz, entity string, state string, period int"
DAY = datetime(2024, 1, 1)


def brute(rows, use_until):
    out = []
    for k in sorted({r[0] for r in rows if r[0] is not None}):
        last = {}
        for r in rows:
            if r[0] == k and r[1] is not None:
                order = (r[4] is not None, r[4] or 0, r[5])
                if r[1] not in last or order >= last[r[1]][0]:
                    last[r[1]] = (order, r)
        seq = [last[t][1] for t in sorted(last)]
        versions = []
        for r in seq:
            if not versions or versions[-1][1] != r[2:4]:
                versions.append([r[1], r[2:4]])
        end = seq[-1][6] if seq and use_until and seq[-1][6] is not None and seq[-1][6] > seq[-1][1] else None
        for i, (start, _) in enumerate(versions):
            out.append((k, start, versions[i + 1][0] if i + 1 < len(versions) else end, len(versions) > 1))
    return sorted(out, key=str)


def run(spark, rows, use_until=True, **more):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = history.version_history(
        df, entity=F.col("k"), at=F.col("at"), state=[F.col("a"), F.col("b")], latest_by=[F.col("made"), F.col("id")], until=F.col("until") if use_until else None, **more
    )
    shaped = found.select("entity", F.timestamp_micros("valid_from").cast("timestamp_ntz"), F.timestamp_micros("valid_to").cast("timestamp_ntz"), "changed")
    return sorted((tuple(r) for r in shaped.collect()), key=str)


def make(seed, n, keys, days):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        at = DAY + timedelta(days=rng.randrange(days))
        until = rng.choice([None, at + timedelta(days=rng.randrange(-3, 5))])
        key = "hot" if rng.random() < 0.4 else f"k{rng.randrange(keys)}"
        rows.append((key, at, rng.choice(["x", "y", None, ""]), rng.choice(["p", "p", "q"]), rng.choice([None, 1, 2]), i, until, "no", "no", 1))
    return rows + rows[: n // 10]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_loop(spark, seed):
    rows = make(seed, 300, 12, 25)
    assert run(spark, rows) == brute(rows, True)


def test_snapshots_with_period(spark):
    rows = make(7, 250, 30, 6)
    assert run(spark, rows, False, period=F.date_format("at", "yyyy-MM")) == brute(rows, False)


def test_only_changed(spark):
    rows = make(9, 200, 40, 4)
    assert run(spark, rows, only_changed=True) == [r for r in brute(rows, True) if r[3]]


def test_nulls_empty_and_repeats(spark):
    assert run(spark, []) == []
    rows = [(None, DAY, "x", "p", 1, 1, None, "", "", 1), ("k", None, "x", "p", 1, 2, None, "", "", 1), ("k", DAY, None, None, None, 3, DAY, "", "", 1), ("k", DAY, None, None, None, 3, DAY, "", "", 1)]
    assert run(spark, rows) == [("k", DAY, None, False)]


def test_long_values(spark):
    rows = [("k", DAY + timedelta(days=i), "v" * 100_000 + str(i // 2), "p", 1, i, None, "", "", 1) for i in range(4)]
    assert len(run(spark, rows)) == 2


def test_unchanged_buckets_are_left_out(spark):
    base = spark.range(200).select(F.concat(F.lit("k"), "id").alias("entity"), F.explode(F.array(F.lit("1"), F.lit("2"), F.lit("3"))).alias("period"))
    content = F.when((F.col("entity") == "k7") & (F.col("period") == "3"), "new").otherwise("old")
    found = {tuple(r) for r in history.changed_buckets(base.withColumn("content", content))[0].collect()}
    first = {r for r in found if r[0] == "1"}
    assert len(found - first) == 1 and not {r for r in found if r[0] == "2"}


def test_joining_edges_across_partitions(spark):
    """One entity in as many partitions as possible gives the same versions."""
    rows = [("hot", DAY + timedelta(hours=i), "x" if (i // 5) % 2 else "y", "p", 1, i, None, "", "", 1) for i in range(400)]
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert run(spark, rows) == brute(rows, True)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_append_snapshot(spark):
    held = spark.createDataFrame([("a", "1", DAY, None), ("b", "1", DAY, None), ("c", "1", DAY, DAY + timedelta(days=1))], "k string, v string, valid_from timestamp_ntz, valid_to timestamp_ntz")
    snap = spark.createDataFrame([("a", "2"), ("b", "1"), ("c", "1"), ("d", None), (None, "9"), ("a", "2")], "k string, v string")
    at = F.lit("2024-03-01").cast("timestamp_ntz")
    found = {(r.k, r.v, r.valid_to is None) for r in history.append_snapshot(held, snap, "k", ["v"], at).collect()}
    assert found == {("a", "1", False), ("a", "2", True), ("b", "1", True), ("c", "1", False), ("c", "1", True), ("d", None, True)}


@pytest.mark.parametrize("times", [1, 8, 64])
def test_share_of_changed_buckets_does_not_grow_with_the_keys(spark, times):
    """A fifth of the keys changes in each delivery; leaves grow in number with the keys, so as few rows are left to diff."""
    base = spark.range(100 * times).select(F.concat(F.lit("k"), "id").alias("entity"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("p"))
    rows = base.select("entity", F.col("p").cast("string").alias("period"), F.when(F.pmod(F.xxhash64("entity"), F.lit(10)) == F.col("p"), F.col("p")).otherwise(0).alias("content"))
    changed, every, bits = history.changed_buckets(rows)
    kept = history.in_changed_buckets(rows.withColumn("leaf", history.leaf_of(F.col("entity"), bits)), changed, every)
    assert 0.15 < kept.where("period <> '1'").count() / (400 * times) < 0.32 and kept.where("period = '1'").count() == 100 * times


def test_updates_that_repeat_what_is_known_are_left_out(spark):
    """A key that a delivery lacks is compared with the last one that had it."""
    rows = [(f"k{i}", str(p), "x") for i in range(50) for p in range(6) if p == 0 or (i + p) % 3 == 0]
    df = spark.createDataFrame(rows, "entity string, period string, content string")
    changed, every, _ = history.changed_buckets(df)
    later = "period <> '0'"
    assert changed.where("period = '0'").count() == every.where("period = '0'").count()
    assert 2 * changed.where(later).count() < every.where(later).count()  # leaves of several keys of which one comes


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_batches_of_any_size(spark, size):
    rows = make(21, 300, 12, 25)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))
    try:
        assert run(spark, rows) == brute(rows, True)
        assert run(spark, rows, only_changed=True) == [r for r in brute(rows, True) if r[3]]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
