"""Density clusters as connected components, canonical members, and pipelines of pyspark.ml for k-means, SVD and PCA."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skillweave.session import discard, materialise

MOST_ROUNDS = 60


def _digest(edges: DataFrame) -> tuple:
    """A number of the set of edges, to tell whether a round changed it."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", F.lit(5), "a"))).head())


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node of the connected component of every node that `edges` (a, b) name.

    Large-star and small-star rounds halve the distance to the smallest node, so the rounds grow with the logarithm of a
    component's size. Every round is written out, which cuts the lineage; nothing is gathered on the driver.
    """
    links = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    now = _digest(links)
    for _ in range(MOST_ROUNDS):
        # Large star: every larger neighbour of a node is linked to the node's smallest neighbour (or itself).
        both = links.union(links.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        # Small star: every smaller neighbour of a node is linked to its smallest one.
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a < b").distinct()
        new = materialise(small, "edges")
        discard(links)
        links, before, now = new, now, _digest(new)
        if now == before:
            break
    else:
        raise RuntimeError(f"components didn't settle in {MOST_ROUNDS} rounds")
    return links.select(F.col("b").alias("node"), F.col("a").alias("component")).union(links.select("a", "a")).distinct()


def density_clusters(nodes: DataFrame, key: str, edges: DataFrame, min_samples: int = 2) -> DataFrame:
    """(key, cluster): DBSCAN over the pairs that are near enough; cluster is the smallest core member, -1 for noise.

    A node with min_samples - 1 neighbours is core; cores that are near each other share a cluster; a border node joins
    the smallest cluster among its core neighbours.
    """
    edges = materialise(edges.select("a", "b"), "near")  # read several times below
    both = edges.union(edges.select("b", "a")).distinct()
    core = both.groupBy("a").count().where(F.col("count") + 1 >= min_samples).select("a")
    dense = both.join(core, "a").join(core.select(F.col("a").alias("b")), "b").select("a", "b")
    label = components(dense).select(F.col("node").alias("a"), F.col("component").alias("cluster"))
    label = core.join(label, "a", "left").select("a", F.coalesce("cluster", "a").alias("cluster"))
    border = both.join(core, "a", "left_anti").join(label.select(F.col("a").alias("b"), "cluster"), "b").groupBy("a").agg(F.min("cluster").alias("cluster"))
    found = label.union(border)
    return nodes.select(key).join(found, nodes[key] == found.a, "left").select(key, F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def canonical(vectors: DataFrame, key: str, vector: str, group: str) -> DataFrame:
    """(group, key): the member nearest to the mean vector of each group; the smaller key wins ties."""
    parts = vectors.where(F.col(vector).isNotNull()).select(key, group, F.posexplode(vector).alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    mean = parts.groupBy(group, "i").agg(F.avg("x").alias("m"))
    dots = parts.join(mean, [group, "i"]).groupBy(group, key).agg(F.sum(F.col("x") * F.col("m")).alias("dot"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("len"))
    score = F.round(F.when(F.col("len") == 0, 0.0).otherwise(F.col("dot") / F.col("len")), 9)
    return dots.groupBy(group).agg(F.min_by(key, F.struct((-score).alias("s"), F.col(key))).alias(key))


def annotate(nodes: DataFrame, key: str, clusters: DataFrame, chosen: DataFrame) -> DataFrame:
    """nodes with cluster, is_canonical and is_singleton."""
    marked = chosen.select(F.col(key), F.lit(True).alias("_c"))
    joined = nodes.join(clusters, key, "left").join(marked, key, "left")
    return joined.withColumn("is_canonical", F.coalesce("_c", F.lit(False)) & (F.col("cluster") != -1)).withColumn("is_singleton", F.col("cluster") == -1).drop("_c")


def degrees(nodes: DataFrame, key: str, edges: DataFrame) -> DataFrame:
    """(key, degree, centrality) of every node; centrality is the share of the other nodes that it meets."""
    ends = edges.select(F.col("a").alias(key)).union(edges.select("b")).groupBy(key).agg(F.count("*").alias("degree"))
    n = nodes.agg(F.count("*").alias("n"))
    return (
        nodes.select(key).join(ends, key, "left").crossJoin(F.broadcast(n))  # one row
        .select(key, F.coalesce("degree", F.lit(0)).alias("degree"), (F.coalesce("degree", F.lit(0)) / F.greatest(F.col("n") - 1, F.lit(1))).alias("centrality"))
    )


def kmeans(vectors: DataFrame, key: str, vector: str, k: int, starts: int = 10, seed: int = 42) -> DataFrame:
    """(key, cluster): k-means with several starts, the cheapest kept; k is bounded by the number of rows."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = materialise(vectors.where(F.col(vector).isNotNull()).select(key, F.transform(vector, lambda v: v.cast("double")).alias("_v")), "kmeans")
    n = rows.count()
    if not n:
        return rows.select(key, F.lit(0).alias("cluster"))
    data = rows.select(key, array_to_vector("_v").alias("features"))
    models = [KMeans(k=max(2, min(k, n)), seed=seed + s).fit(data) for s in range(starts)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    return best.transform(data).select(key, F.col("prediction").alias("cluster"))


def project(vectors: DataFrame, key: str, vector: str, dims: int) -> DataFrame:
    """(key, dim, x): coordinates on the first principal components."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = vectors.where(F.col(vector).isNotNull()).select(key, array_to_vector(F.transform(vector, lambda v: v.cast("double"))).alias("f"))
    model = PCA(k=dims, inputCol="f", outputCol="p").fit(data)
    return model.transform(data).select(key, F.posexplode(vector_to_array("p")).alias("dim", "x"))


def _spectrum(vectors: DataFrame, vector: str) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and -vectors, largest first, of the Gram matrix of the unit vectors.

    It has a row per dimension of the vectors, however many vectors there are.
    """
    parts = vectors.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"))
    size = parts.select(F.max(F.size("v"))).head()[0] or 0

    def gram(batches):
        total = np.zeros((size, size))
        for pdf in batches:
            if len(pdf):
                m = _unit(pdf["v"])
                total += m.T @ m
        i, j = np.nonzero(total)
        yield pd.DataFrame({"i": i, "j": j, "x": total[i, j]})

    summed = parts.mapInPandas(gram, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect()  # size squared
    g = np.zeros((size, size))
    for r in summed:
        g[r.i, r.j] = r.x
    values, directions = np.linalg.eigh(g)
    return values[::-1], directions[:, ::-1]


def _unit(column: pd.Series) -> np.ndarray:
    m = np.stack(column.to_numpy()).astype(np.float64)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1, norm)


def singular_values(vectors: DataFrame, key: str, vector: str, dims: int) -> DataFrame:
    """(dim, value): the largest singular values of the matrix of unit vectors, from its Gram matrix."""
    values = np.sqrt(np.maximum(_spectrum(vectors, vector)[0][:dims], 0))
    return vectors.sparkSession.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "dim int, value double")


def reduced(vectors: DataFrame, key: str, vector: str, dims: int) -> DataFrame:
    """(key, reduced): unit vectors on their first `dims` singular directions, brought to unit length again.

    Directions have no sign of their own; each is turned so that its largest component is positive. Null vectors are left out.
    """
    directions = _spectrum(vectors, vector)[1][:, :dims]
    if directions.size:
        directions = directions * np.sign(directions[np.abs(directions).argmax(axis=0), np.arange(directions.shape[1])])
    shared = vectors.sparkSession.sparkContext.broadcast(directions)
    kind = dict(vectors.dtypes)[key]

    def turn(batches):
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"k": pdf["k"], "reduced": list(_unit(pd.Series(list(_unit(pdf["v"]) @ shared.value))))})

    held = vectors.where(F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"))
    return held.mapInPandas(turn, f"k {kind}, reduced array<double>").withColumnRenamed("k", key)


def cluster_names(weights: DataFrame, key: str, labels: DataFrame, cluster: str, top: int = 3) -> DataFrame:
    """(cluster, name): the terms of highest mean weight of each cluster."""
    held = weights.join(labels, key)
    size = labels.groupBy(cluster).agg(F.count("*").alias("n"))
    mean = held.groupBy(cluster, "term").agg(F.sum("weight").alias("w")).join(size, cluster).withColumn("w", F.round(F.col("w") / F.col("n"), 9))
    rank = F.row_number().over(Window.partitionBy(cluster).orderBy(F.col("w").desc(), "term"))
    named = mean.withColumn("r", rank).where(F.col("r") <= top).groupBy(cluster).agg(F.array_sort(F.collect_list(F.struct("r", "term"))).alias("t"))
    return named.select(cluster, F.array_join(F.transform("t", lambda x: x.term), " · ").alias("name"))


def scaled(rows: DataFrame, value: str, name: str, low: float = 1.0, high: float = 10.0) -> DataFrame:
    """`rows` with `value` scaled to low..high over all rows."""
    ends = rows.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    share = (F.col(value) - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1))
    return rows.crossJoin(F.broadcast(ends)).withColumn(name, share * (high - low) + low).drop("_lo", "_hi")  # one row
