"""Merging changes into tables: upserts with a policy per column, inserts of what is absent, expiry and back-fill.

Parquet tables have no MERGE; each operation is a function of the old and the new rows, to be written to a new version.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How a column's new value meets its old one.
POLICIES = ("overwrite", "coalesce_new_old", "keep_old", "greatest", "fill_blank")


def first_by(rows: DataFrame, keys: Sequence[str | Column], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first `n` rows of every key by `order` (which should end in a unique column)."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def upsert(base: DataFrame, delta: DataFrame, keys: Sequence[str], policy: Mapping[str, str], arrival: Sequence[Column] | None = None, newer: Sequence[str] | None = None) -> DataFrame:
    """`base` after the rows of `delta`, matched on `keys` (null matches null).

    policy names how each column of an existing row changes; columns without policy keep their old value. Of several
    delta rows for one key the last by `arrival` (all columns, if not given) counts. New rows enter whole. With `newer`
    (columns of both) an existing row only changes if the delta row comes later by them; null is earliest.
    """
    bad = set(policy.values()) - set(POLICIES)
    if bad:
        raise ValueError(f"unknown policy {sorted(bad)}")
    columns = base.columns
    values = [c for c in columns if c not in keys]
    order = [c.desc_nulls_last() for c in (arrival if arrival is not None else [F.col(c) for c in delta.columns])]
    new = first_by(delta, list(keys), order)
    old = base.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.struct(*[F.col(c) for c in columns]).alias("_old"))
    incoming = new.select(*[F.col(k).alias(f"_n{i}") for i, k in enumerate(keys)], F.struct(*[F.col(c) for c in columns if c in new.columns]).alias("_new"))
    match = None
    for i in range(len(keys)):
        same = F.col(f"_k{i}").eqNullSafe(F.col(f"_n{i}"))
        match = same if match is None else match & same
    both = old.join(incoming, match, "full_outer")
    kept = F.col("_new").isNull()
    if newer:
        at = lambda side: F.struct(*[F.col(side)[c].alias(c) for c in newer])
        kept = kept | (at("_new") <= at("_old"))
    out = []
    for c in columns:
        o = F.col("_old")[c]
        if c not in new.columns:
            out.append(o.alias(c))
            continue
        n = F.col("_new")[c]
        kind = policy.get(c, "keep_old") if c in values else "keep_old"
        changed = {
            "overwrite": n,
            "coalesce_new_old": F.coalesce(n, o),
            "keep_old": o,
            "greatest": F.greatest(n, o),
            "fill_blank": F.when(F.coalesce(o.cast("string"), F.lit("")) == "", n).otherwise(o),
        }[kind]
        out.append(F.when(F.col("_old").isNull(), n).when(kept, o).otherwise(changed).alias(c))
    return both.select(*out)


def insert_absent(base: DataFrame, delta: DataFrame, keys: Sequence[str], arrival: Sequence[Column]) -> DataFrame:
    """`base` and the delta rows whose key it lacks; the first to arrive of several."""
    fresh = first_by(delta, list(keys), arrival).join(base.select(*keys).distinct(), list(keys), "left_anti")
    return base.unionByName(fresh.select(*base.columns))


def expire(links: DataFrame, touched: DataFrame, key: str, now: Column) -> DataFrame:
    """Open rows of touched keys end at `now`; keys that aren't touched stay open."""
    marked = links.join(touched.select(key).distinct().withColumn("_touched", F.lit(True)), key, "left")
    return marked.withColumn("valid_to", F.when(F.col("valid_to").isNull() & F.col("_touched"), now).otherwise(F.col("valid_to"))).drop("_touched").select(*links.columns)


def backfill(rows: DataFrame, source: DataFrame, key: tuple[str, str], columns: Mapping[str, str]) -> DataFrame:
    """Blank columns of `rows` filled from the one source row of their key (`source` must be unique by it)."""
    picked = source.select(F.col(key[1]).alias("_key"), *[F.col(s).alias(f"_{t}") for t, s in columns.items()])
    joined = rows.join(picked, F.col(key[0]) == F.col("_key"), "left")
    for t in columns:
        joined = joined.withColumn(t, F.when(F.coalesce(F.col(t).cast("string"), F.lit("")) == "", F.col(f"_{t}")).otherwise(F.col(t)))
    return joined.select(*rows.columns)


def fingerprint(rows: DataFrame) -> DataFrame:
    """(fingerprint, n_rows): 32 hex digits that change with any value or repetition, not with the order of rows."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in rows.columns])
    parts = [F.sum(F.conv(F.substring(F.md5(text), 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")) for i in range(4)]
    return rows.agg(F.md5(F.concat_ws(",", *[F.coalesce(p, F.lit(0)).cast("string") for p in parts], F.count("*").cast("string"))).alias("fingerprint"), F.count("*").alias("n_rows"))
