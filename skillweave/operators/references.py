"""References to keys that a registry lacks, holds as deleted or received only later."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillweave.session import materialise

#: References to one key from which its rows are spread over SALTS buckets.
HOT_ROWS = 100_000
SALTS = 32
#: Most hot codes that are broadcast.
BROADCAST_CODES = 1_000_000


def code_key(code: Column) -> Column:
    """Codes compare without outer spaces and case; a blank code is none."""
    return F.nullif(F.upper(F.regexp_replace(code, r"^[\s ]+|[\s ]+$", "")), F.lit(""))


def parent_intervals(parents: DataFrame, *, key: Column, received: Column, deleted: Column, latest_by: list[Column]) -> DataFrame:
    """(code, since, until, deleted): when a key was first received, and when the row came that says it is deleted.

    The last row in the order of `latest_by` decides; until is null for a key that it holds.
    """
    rows = parents.select(code_key(key).alias("code"), received.alias("since"), F.coalesce(deleted, F.lit(False)).alias("gone"), F.struct(*latest_by).alias("by"))
    return rows.where(F.col("code").isNotNull()).groupBy("code").agg(F.min("since").alias("since"), F.max_by(F.struct("gone", "since"), "by").alias("last")).select("code", "since", F.when(F.col("last.gone"), F.coalesce("last.since", "since")).alias("until"), F.col("last.gone").alias("deleted"))


def references(table: DataFrame, *, name: str, field: str, registry: str, row_id: str = "id", at: str = "created_at") -> DataFrame:
    """The references that one column makes, in the shape that `dangling` takes."""
    return table.select(
        F.lit(name).alias("src_table"), F.lit(field).alias("ref_field"), F.col(row_id).cast("bigint").alias("row_id"),
        code_key(F.col(field)).alias("code"), F.col(at).alias("at"), F.lit(registry).alias("registry"),
    )


def dangling(refs: list[DataFrame], registries: dict[str, DataFrame], hot_rows: int = HOT_ROWS) -> DataFrame:
    """(src_table, ref_field, row_id, at, code, reason, since, until) of each reference that its registry doesn't bear out.

    reason is the first that holds of missing, deleted and late. References and parents are hashed and sorted by
    (registry, code, salt) alike and merged in one pass (a sort-merge join). Codes with over `hot_rows` references are
    spread over SALTS buckets, each with a copy of the one parent row, before the references are shuffled: such codes
    are few (total / hot_rows at most), so they are counted first (one pass that sums before it shuffles) and broadcast,
    or joined where they are over BROADCAST_CODES.

    A null or blank code is no reference; a reference without `at` can't be late; repeated rows each count; empty
    tables give no rows (without parents every reference is missing); columns not named are not looked at.
    """
    child = reduce(DataFrame.unionByName, refs).where(F.col("code").isNotNull())
    parent = reduce(DataFrame.unionByName, [p.select(F.lit(n).alias("registry"), "code", "since", "until", "deleted") for n, p in registries.items()])
    hot = materialise(child.groupBy("registry", "code").count().where(F.col("count") > hot_rows).select("registry", "code", F.lit(True).alias("hot")), "hot")
    hot = F.broadcast(hot) if hot.count() <= BROADCAST_CODES else hot
    salted = child.join(hot, ["registry", "code"], "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("row_id"), F.lit(SALTS)).cast("int")).otherwise(0))
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    spread = parent.join(hot, ["registry", "code"], "left").withColumn("salt", F.explode(salts)).drop("hot").withColumn("known", F.lit(True))
    merged = salted.drop("hot").join(spread.hint("merge"), ["registry", "code", "salt"], "left")
    reason = (
        F.when(F.col("known").isNull(), "missing").when(F.col("deleted"), "deleted").when(F.col("since") > F.col("at"), "late")
    )
    return merged.withColumn("reason", reason).where(F.col("reason").isNotNull()).select("src_table", "ref_field", "row_id", "at", "code", "reason", "since", "until")


def dangling_report(found: DataFrame) -> DataFrame:
    """Counts of dangling references per table, field, month and reason."""
    month = F.date_format(F.date_trunc("month", F.col("at").cast("timestamp")), "yyyy-MM")
    return found.groupBy("src_table", "ref_field", month.alias("month"), "reason").agg(F.count("*").alias("n_refs"), F.count_distinct("code").alias("n_codes"))
