"""Queries that compare occupations, units and vectors with each other: gaps, redundancy, clusters, neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skillweave.functions import text as tx
from skillweave.operators import clusters, occupations, similarity
from skillweave.operators.upsert import first_by
from skillweave.plans.analytics import _C, _OCC, _V, VECTORS, _classes, _occupation_base, _occupation_pairs, _s, _TERMS, _weights
from skillweave.plans.links import PRIMARY_SQL
from skillweave.plans.tables import table
from skillweave.session import materialise


def _chosen(spark: SparkSession, d: str) -> DataFrame:
    """Statements of the two occupations with most statements, `side` 1 and 2."""
    base = materialise(_occupation_base(spark, d).select("anzsco_code", "unit_code", "id", "skill_statement"), "base")
    top = base.groupBy("anzsco_code").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "anzsco_code").limit(2)
    sides = top.withColumn("side", F.row_number().over(Window.orderBy(F.col("n").desc(), "anzsco_code"))).select("anzsco_code", "side")  # two rows
    return base.join(F.broadcast(sides), "anzsco_code")


def gap_matches(spark, d):
    """For the first 50 statements of an occupation the nearest of the one most like it, at cosine 0.3 or more: the 15 best."""
    pair = _occupation_pairs(spark, d).orderBy(F.round("sim", 9).desc(), "a", "b").limit(1)
    sides = pair.select(F.explode(F.array(F.struct(F.col("a").alias("anzsco_code"), F.lit(1).alias("side")), F.struct(F.col("b").alias("anzsco_code"), F.lit(2).alias("side")))).alias("x")).select("x.*")  # two rows
    rows = materialise(_occupation_base(spark, d).select("anzsco_code", "id", "skill_statement").join(F.broadcast(sides), "anzsco_code"), "chosen")
    asked = rows.where("side = 1").groupBy("skill_statement").agg(F.min("id").alias("id")).orderBy("id").limit(50)
    targets = rows.where("side = 2").groupBy("skill_statement").agg(F.min("id").alias("id"))
    weights = similarity.term_weights(asked.select("id", "skill_statement").unionByName(targets.select((-F.col("id") - 1).alias("id"), "skill_statement")), "id", _s())
    weights = materialise(weights, "weights")
    found = similarity.best_matches(weights.where("id >= 0"), "id", weights.where("id < 0").select((-F.col("id") - 1).alias("target"), "term", "weight"), "target", 0.3, 1)
    return found.select("id", "target", F.round("sim", 6).alias("sim")).orderBy(F.col("sim").desc(), "id").limit(15)


def gap_export(spark, d):
    """Up to three statements of every unit that one occupation has and another lacks."""
    rows = materialise(_chosen(spark, d), "chosen")
    missing = rows.where("side = 2").join(rows.where("side = 1").select("unit_code").distinct(), "unit_code", "left_anti")
    return first_by(missing, ["unit_code"], [F.col("id")], 3).select("unit_code", "id", F.substring("skill_statement", 1, 120).alias("shown"))


def occupation_clusters(spark, d):
    """Clusters of occupations linked at cosine 0.3 or more: members, units and major groups."""
    pairs = _occupation_pairs(spark, d)
    base = _occupation_base(spark, d).select("anzsco_code", "anzsco_major_group", "unit_code").distinct()
    found = clusters.density_clusters(base.select("anzsco_code").distinct(), "anzsco_code", pairs.select("a", "b")).where("cluster <> '-1'")
    return base.join(found, "anzsco_code").groupBy("cluster").agg(F.count_distinct("anzsco_code").alias("n_occupations"), F.count_distinct("unit_code").alias("n_units"), F.array_join(F.array_sort(F.collect_set("anzsco_major_group")), ", ").alias("major_groups"))


def package_bridges(spark, d):
    """Similar occupations whose units mostly belong to different training packages."""
    n = _occupation_base(spark, d).where("tp_code is not null").groupBy("anzsco_code", "tp_code").agg(F.count("*").alias("n"))
    package = n.groupBy("anzsco_code").agg(F.min_by("tp_code", F.struct((-F.col("n")).alias("n"), "tp_code")).alias("tp"))
    return occupations.bridges(_occupation_pairs(spark, d), package, "anzsco_code", "tp").withColumn("sim", F.round("sim", 5))


def statement_neighbours(spark, d):
    """The eight statements nearest to the first one of the unit with the most statements, of which up to four of other units."""
    rows = table(spark, d, "rsd_skill_records").where(tx.has_text(_s()) & F.col("unit_code").isNotNull())
    texts = materialise(rows.groupBy("skill_statement").agg(F.min_by(F.struct("id", "unit_code"), "id").alias("r")).select("r.*", "skill_statement"), "texts")
    unit = rows.groupBy("unit_code").agg(F.count("*").alias("n"), F.min(F.struct(F.coalesce("row_index", F.lit(2**31 - 1)).alias("o"), "id", "skill_statement")).alias("f")).orderBy(F.col("n").desc(), "unit_code").limit(1)
    first = materialise(unit.select("f.skill_statement").join(texts, "skill_statement").select("id", F.col("unit_code").alias("own")), "first")
    weights = materialise(similarity.term_weights(texts, "id", _s()), "weights")
    asked = weights.join(F.broadcast(first.select("id")), "id", "left_semi")  # one statement
    found = similarity.best_matches(asked, "id", weights.withColumnRenamed("id", "target"), "target", 0.05, 9).where("id <> target")
    eight = found.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("rank"))).where("place <= 8")
    named = eight.join(texts.select(F.col("id").alias("target"), "unit_code"), "target").join(F.broadcast(first), "id")
    left = named.where("unit_code <> own").withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("place"))).where("n <= 4")
    return left.select("id", "target", F.round("sim", 6).alias("sim"))


def redundancy_surface(spark, d):
    """Per vector: its highest cosine to another from 0.35 on, its label's share of the largest label, and the label's density."""
    rows = table(spark, d, "embeddings").where("label is not null")
    pairs = similarity.vector_pairs(rows, "vec_id", "embedding", VECTORS)
    top = pairs.select("a", "sim").unionByName(pairs.select(F.col("b").alias("a"), "sim")).groupBy("a").agg(F.max("sim").alias("top"))
    return rows.select("vec_id", "label").join(top, F.col("vec_id") == F.col("a"), "left").join(F.broadcast(_density(spark, d)), "label").select("vec_id", F.round(F.coalesce("top", F.lit(0.0)), 5).alias("top"), F.round("frequency", 6).alias("frequency"), F.round("density", 6).alias("density"))


def _density(spark: SparkSession, d: str) -> DataFrame:
    """Per label (a bounded number of classes): size relative to the largest, and mean cosine over all n x n places with an empty diagonal."""
    sizes = similarity.group_similarity(table(spark, d, "embeddings").where("label is not null"), "vec_id", "embedding", "label")
    most = sizes.agg(F.max("n").alias("most"))
    density = F.when(F.col("n") < 2, 0.0).otherwise(F.col("mean_sim") * (F.col("n") - 1) / F.col("n"))
    return sizes.crossJoin(F.broadcast(most)).select("label", "n", (F.col("n") / F.col("most")).alias("frequency"), density.alias("density"))  # one row


def redundancy_hotspots(spark, d):
    """The ten labels of highest density."""
    found = _density(spark, d).select("label", "n", F.round("density", 6).alias("density"))
    return found.orderBy(F.col("density").desc(), "label").limit(10)


def uniqueness_histogram(spark, d):
    """Thirty equal bins of the vectors' uniqueness, by label."""
    rows = table(spark, d, "embeddings")
    found = similarity.uniqueness(rows, "vec_id", "embedding").select("vec_id", F.round("uniqueness", 6).alias("u")).join(rows.select("vec_id", "label"), "vec_id")
    ends = found.agg(F.min("u").alias("lo"), F.max("u").alias("hi"))
    bin_ = F.least(F.floor((F.col("u") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-6)) * 30 + 1e-6), F.lit(29)).cast("int")
    return found.crossJoin(F.broadcast(ends)).groupBy("label", bin_.alias("bin")).agg(F.count("*").alias("n"))  # one row


def package_depth(spark, d):
    """Per training package: units, statements, mean complexity, and the share of statements that repeat another."""
    rows = _classes(spark, d).join(table(spark, d, "rsd_skill_records").select("id", "skill_statement"), "id").where("tp_code is not null")
    agg = rows.groupBy("tp_code").agg(F.count("*").alias("n"), F.count_distinct("unit_code").alias("n_units"), F.round(F.avg("complexity"), 3).alias("mean_complexity"), F.count_distinct("skill_statement").alias("n_texts"))
    return agg.withColumn("redundancy", F.round(1 - F.col("n_texts") / F.greatest("n", F.lit(1)), 6))


def limited_terms(spark, d):
    """Tf-idf of statements over the 500 terms that occur most often, folded to one row a statement."""
    rows = table(spark, d, "rsd_skill_records").where(tx.has_text(_s())).select("id", "skill_statement")
    w = similarity.term_weights(rows, "id", _s(), ngrams=2, max_features=500)
    return w.groupBy("id").agg(F.count("*").alias("n_terms"), F.round(F.sum("weight"), 6).alias("sum_weight"))


def reduced_vectors(spark, d):
    """Vectors on their first eight singular directions, with unit length."""
    return clusters.reduced(table(spark, d, "embeddings"), "vec_id", "embedding", 8)


QUERIES = {
    f.__name__: f
    for f in (
        gap_matches, gap_export, occupation_clusters, package_bridges, statement_neighbours, redundancy_surface, redundancy_hotspots, uniqueness_histogram, package_depth, limited_terms,
        reduced_vectors,
    )
}

_CHOSEN = f"""WITH {PRIMARY_SQL}, base AS (SELECT anzsco_code, s.unit_code, s.id, s.skill_statement FROM pl JOIN rsd_skill_records s ON s.unit_code = pl.uoc_code WHERE skill_statement <> ''),
top AS (SELECT anzsco_code, row_number() OVER (ORDER BY count(*) DESC, anzsco_code) side FROM base GROUP BY 1), ch AS (SELECT * FROM base JOIN top USING (anzsco_code) WHERE side <= 2)"""
_TEXTS = "SELECT id, unit_code, skill_statement FROM rsd_skill_records WHERE skill_statement <> '' AND unit_code IS NOT NULL QUALIFY row_number() OVER (PARTITION BY skill_statement ORDER BY id) = 1"
_DENSE = """, g AS (SELECT label, count(*) n FROM v WHERE label IS NOT NULL GROUP BY 1),
m AS (SELECT x.label, sum(list_cosine_similarity(x.e, y.e)) s FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id GROUP BY 1),
dn AS (SELECT label, n, n / (SELECT max(n) FROM g) frequency, CASE WHEN n < 2 THEN 0.0 ELSE s / (n * n) END density FROM g LEFT JOIN m USING (label))"""

ORACLE = {
    "gap_matches": "WITH pr AS (" + _OCC + f""" SELECT a, b FROM p ORDER BY round(sim, 9) DESC, a, b LIMIT 1), {PRIMARY_SQL},
  ch AS (SELECT s.id, s.skill_statement, CASE WHEN anzsco_code = pr.a THEN 1 ELSE 2 END side FROM pr JOIN pl ON anzsco_code IN (pr.a, pr.b) JOIN rsd_skill_records s ON s.unit_code = pl.uoc_code WHERE skill_statement <> ''), a AS (SELECT min(id) id, skill_statement FROM ch WHERE side = 1 GROUP BY 2 ORDER BY 1 LIMIT 50), b AS (SELECT min(id) id, skill_statement FROM ch WHERE side = 2 GROUP BY 2),
  """ + _weights("SELECT id, skill_statement FROM a UNION ALL SELECT -id - 1, skill_statement FROM b", "id", "skill_statement") + """,
  s AS (SELECT x.id, -y.id - 1 target, sum(x.weight * y.weight) sim FROM w x JOIN w y ON x.term = y.term AND x.id >= 0 AND y.id < 0 GROUP BY 1, 2 HAVING sum(x.weight * y.weight) >= 0.3),
  k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(sim, 9) DESC, target) = 1) SELECT id, target, round(sim, 6) sim FROM k ORDER BY 3 DESC, 1 LIMIT 15""",
    "gap_export": _CHOSEN + " SELECT unit_code, id, substr(skill_statement, 1, 120) shown FROM ch WHERE side = 2 AND unit_code NOT IN (SELECT unit_code FROM ch WHERE side = 1) QUALIFY row_number() OVER (PARTITION BY unit_code ORDER BY id) <= 3",
    "occupation_clusters": _OCC.replace("WITH ", "WITH RECURSIVE ", 1) + """, e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r(n, m) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.n), c AS (SELECT n, min(m) cluster FROM r GROUP BY n)
  SELECT cluster, count(DISTINCT anzsco_code) n_occupations, count(DISTINCT unit_code) n_units, coalesce(string_agg(DISTINCT anzsco_major_group, ', ' ORDER BY anzsco_major_group), '') major_groups FROM base JOIN c ON c.n = anzsco_code GROUP BY 1""",
    "package_bridges": _OCC + f""", b2 AS (SELECT anzsco_code, tp_code, count(*) n FROM (SELECT anzsco_code, s.tp_code FROM pl JOIN rsd_skill_records s ON s.unit_code = pl.uoc_code WHERE skill_statement <> '' AND tp_code IS NOT NULL) GROUP BY 1, 2),
  t AS (SELECT anzsco_code, tp_code tp FROM b2 QUALIFY row_number() OVER (PARTITION BY anzsco_code ORDER BY n DESC, tp_code) = 1)
  SELECT a, b, round(sim, 5) sim, x.tp package_a, y.tp package_b FROM p JOIN t x ON x.anzsco_code = a JOIN t y ON y.anzsco_code = b WHERE x.tp <> y.tp""",
    "statement_neighbours": "WITH " + _weights(_TEXTS, "id", "skill_statement") + """, u AS (SELECT unit_code, count(*) n FROM rsd_skill_records WHERE skill_statement <> '' AND unit_code IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1),
  f AS (SELECT skill_statement FROM rsd_skill_records JOIN u USING (unit_code) WHERE skill_statement <> '' ORDER BY row_index NULLS LAST, id LIMIT 1), q AS (SELECT d.id, d.unit_code own FROM d JOIN f USING (skill_statement)),
  s AS (SELECT x.id, y.id target, sum(x.weight * y.weight) sim FROM w x JOIN q ON q.id = x.id JOIN w y ON x.term = y.term GROUP BY 1, 2 HAVING sum(x.weight * y.weight) >= 0.05),
  k AS (SELECT * FROM s WHERE id <> target QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(sim, 9) DESC, target) <= 8),
  o AS (SELECT k.id, target, sim FROM k JOIN d ON d.id = target JOIN q ON q.id = k.id WHERE d.unit_code <> own QUALIFY row_number() OVER (ORDER BY round(sim, 9) DESC, target) <= 4) SELECT id, target, round(sim, 6) sim FROM o""",
    "redundancy_surface": _V + _DENSE + """, t AS (SELECT vec, max(sim) top FROM (SELECT a vec, sim FROM p UNION ALL SELECT b, sim FROM p) GROUP BY 1)
  SELECT vec_id, round(coalesce(top, 0), 5) top, round(frequency, 6) frequency, round(density, 6) density FROM v JOIN dn USING (label) LEFT JOIN t ON vec = vec_id""",
    "redundancy_hotspots": _V + _DENSE + " SELECT label, n, round(density, 6) density FROM dn ORDER BY 3 DESC, 1 LIMIT 10",
    "package_depth": _C + "SELECT tp_code, count(*) n, count(DISTINCT unit_code) n_units, round(avg(complexity), 3) mean_complexity, count(DISTINCT skill_statement) n_texts, round(1 - count(DISTINCT skill_statement) / count(*), 6) redundancy FROM c WHERE tp_code IS NOT NULL GROUP BY 1",
    "limited_terms": f"""WITH d AS (SELECT id, skill_statement FROM rsd_skill_records WHERE skill_statement <> ''), t0 AS (SELECT id, {_TERMS("skill_statement")} t FROM d),
  t1 AS (SELECT id, unnest(t || list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) term FROM t0), k AS (SELECT term FROM t1 GROUP BY 1 ORDER BY count(*) DESC, term LIMIT 500),
  tf AS (SELECT id, term, count(*) tf FROM t1 JOIN k USING (term) GROUP BY ALL), dfs AS (SELECT term, count(*) df FROM tf GROUP BY 1), raw AS (SELECT id, tf * (ln((1 + (SELECT count(*) FROM d)) / (1 + df)) + 1) r FROM tf JOIN dfs USING (term)),
  w AS (SELECT id, r / sqrt(sum(r * r) OVER (PARTITION BY id)) weight FROM raw) SELECT id, count(*) n_terms, round(sum(weight), 6) sum_weight FROM w GROUP BY 1""",
    "uniqueness_histogram": """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) e FROM embeddings WHERE embedding IS NOT NULL),
  u AS (SELECT x.vec_id, any_value(x.label) label, round(1 - avg(list_cosine_similarity(x.e, y.e)), 6) u FROM v x, v y GROUP BY 1), m AS (SELECT min(u) lo, max(u) hi FROM u)
  SELECT label, least(floor((u - lo) / greatest(hi - lo, 1e-6) * 30 + 1e-6), 29)::INT bin, count(*) n FROM u, m GROUP BY 1, 2""",
}
