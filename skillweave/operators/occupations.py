"""Occupations compared by the statements of their units: documents, pathways, gaps and bridges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skillweave.functions import text as tx
from skillweave.operators import similarity


def occupation_terms(skills: DataFrame, group: str, text: Column) -> DataFrame:
    """(group, term, weight): sublinear tf-idf over all statements of a group taken as one document.

    Terms are counted per group straight from the statements; no group's text is ever put together in one row.
    """
    terms = skills.select(F.col(group), F.explode(tx.content_terms(text)).alias("term"))
    tf = terms.groupBy(group, "term").agg(F.count("*").alias("tf"))
    return similarity.weigh(skills.select(group).distinct(), tf, group, sublinear=True)


def pathways(pairs: DataFrame, units: DataFrame, group: str, unit: str, n: int) -> DataFrame:
    """(source, target, sim, rank, n_shared, n_missing): the n most similar groups of each group with their unit overlap.

    pairs: (a, b, sim) with a < b; units: distinct (group, unit).
    """
    both = pairs.select(F.col("a").alias("source"), F.col("b").alias("target"), "sim").union(pairs.select("b", "a", "sim"))
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.round("sim", 9).desc(), "target"))
    top = both.withColumn("rank", rank).where(F.col("rank") <= n)
    has = units.select(F.col(group).alias("source"), F.col(unit).alias("_u"))
    needs = units.select(F.col(group).alias("target"), F.col(unit).alias("_u"))
    shared = top.join(needs, "target").join(has, ["source", "_u"], "left_semi").groupBy("source", "target").agg(F.count("*").alias("n_shared"))
    size = needs.groupBy("target").agg(F.count("*").alias("n_units"))
    joined = top.join(shared, ["source", "target"], "left").join(size, "target", "left")
    n_shared = F.coalesce("n_shared", F.lit(0))
    return joined.select("source", "target", "sim", "rank", n_shared.alias("n_shared"), (F.coalesce("n_units", F.lit(0)) - n_shared).alias("n_missing"))


def bridges(pairs: DataFrame, package: DataFrame, group: str, value: str) -> DataFrame:
    """(a, b, sim, package_a, package_b) of the pairs whose groups belong to different packages."""
    side = lambda c: package.select(F.col(group).alias(c), F.col(value).alias(f"package_{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where("package_a <> package_b").select("a", "b", "sim", "package_a", "package_b")
