"""Queries that aggregate, compare and cluster skill statements, occupations and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skillweave.functions import text as tx
from skillweave.operators import clusters, linkage, occupations, similarity
from skillweave.operators.upsert import first_by
from skillweave.plans import skills as sk
from skillweave.plans.links import PRIMARY_SQL
from skillweave.plans.tables import table
from skillweave.session import materialise

def _s():
    return F.col("skill_statement")

#: Similarities at which the queries link statements and vectors.
LINKED, NEAR, VECTORS = 0.85, 0.92, 0.35


def _classes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "rsd_skill_records").where(tx.has_text(_s()))
    return rows.select("id", "unit_code", "tp_code", "element_title", tx.primary_verb(_s()).alias("verb"), tx.domain(_s()).alias("domain"), tx.verb_group(_s()).alias("verb_group"), tx.complexity(_s()).alias("complexity"))


def _counts(rows: DataFrame, keys: list[str], item: str) -> DataFrame:
    """The commonest item of each key, smaller item on ties."""
    n = rows.where(F.col(item).isNotNull()).groupBy(*keys, item).agg(F.count("*").alias("n"))
    return n.groupBy(*keys).agg(F.min_by(item, F.struct((-F.col("n")).alias("n"), F.col(item).alias("i"))).alias(item))


def domain_summary(spark, d):
    """Per domain: statements, units, commonest verb, mean complexity, band."""
    rows = _classes(spark, d)
    agg = rows.groupBy("domain").agg(F.count("*").alias("n"), F.count_distinct("unit_code").alias("n_units"), F.count_distinct("tp_code").alias("n_packages"), F.round(F.avg("complexity"), 3).alias("mean_complexity"))
    return agg.join(_counts(rows, ["domain"], "verb"), "domain").withColumn("band", tx.band(F.col("mean_complexity"), 7, 4))


def element_summary(spark, d):
    """Per unit and element: statements, mean complexity, verbs."""
    rows = _classes(spark, d).where("unit_code is not null and element_title is not null")
    return rows.groupBy("unit_code", "element_title").agg(F.count("*").alias("n"), F.round(F.avg("complexity"), 3).alias("mean_complexity"), F.array_join(F.array_sort(F.collect_set("verb")), ", ").alias("verbs"))


def verb_counts(spark, d):
    """The eight commonest verbs."""
    return _classes(spark, d).groupBy("verb").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "verb").limit(8)


def domain_distribution(spark, d):
    """Percentage of each domain."""
    n = _classes(spark, d).groupBy("domain").agg(F.count("*").alias("n"))
    return n.withColumn("percent", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 4))  # a row per domain


def package_redundancy(spark, d):
    """Per training package: statements, different ones, redundancy."""
    rows = table(spark, d, "rsd_skill_records").where(tx.has_text(_s())).select("tp_code", _s().alias("s"))
    return rows.groupBy("tp_code").agg(F.count("*").alias("total"), F.count_distinct("s").alias("distinct_statements")).withColumn("redundancy", F.round(1 - F.col("distinct_statements") / F.greatest(F.col("total"), F.lit(1)), 6))


def transferability(spark, d):
    """How many units reach over three domains or more."""
    n = _classes(spark, d).where("unit_code is not null").groupBy("unit_code").agg(F.count_distinct("domain").alias("k"))
    return n.agg(F.count("*").alias("n_units"), F.count_if(F.col("k") >= 3).alias("n_wide"), F.round(F.count_if(F.col("k") >= 3) * 100.0 / F.greatest(F.count("*"), F.lit(1)), 4).alias("percent"))


def complexity_histogram(spark, d):
    """Ten equal bins of complexity from 1 to 10, by domain."""
    b = F.least(F.floor((F.col("complexity") - 1) / 0.9 + 1e-9), F.lit(9)).cast("int")
    return _classes(spark, d).select("domain", b.alias("bin")).groupBy("domain", "bin").agg(F.count("*").alias("n"))


def unit_profiles(spark, d):
    """Share of each domain in every unit."""
    n = _classes(spark, d).where("unit_code is not null").groupBy("unit_code", "domain").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("unit_code")), 6))


def similar_units(spark, d):
    """The ten units whose domain profile is nearest to that of the unit with the most statements."""
    n = _classes(spark, d).where("unit_code is not null").groupBy("unit_code", "domain").agg(F.count("*").cast("double").alias("n"))
    unit = n.groupBy("unit_code").agg(F.sum("n").alias("t"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("len"))
    chosen = unit.orderBy(F.col("t").desc(), "unit_code").limit(1).select(F.col("unit_code").alias("c"), F.col("len").alias("clen"))
    mine = n.join(F.broadcast(chosen), F.col("unit_code") == F.col("c")).select("domain", F.col("n").alias("cn"), "c", "clen")  # a row per domain
    dots = n.join(F.broadcast(mine), "domain").where("unit_code <> c").groupBy("unit_code", "clen").agg(F.sum(F.col("n") * F.col("cn")).alias("dot"))
    sim = F.round(F.col("dot") / (F.col("len") * F.col("clen")), 6)
    return dots.join(unit, "unit_code").select("unit_code", sim.alias("sim")).orderBy(F.col("sim").desc(), "unit_code").limit(10)


def unit_reach(spark, d):
    """Number of units with each domain, scaled to 1..10."""
    n = _classes(spark, d).groupBy("domain").agg(F.count_distinct("unit_code").alias("n_units"))
    scaled = clusters.scaled(n, "n_units", "reach")
    return scaled.select("domain", "n_units", F.round("reach", 6).alias("reach"))


def header_metrics(spark, d):
    """Totals of the skill records."""
    rows = table(spark, d, "rsd_skill_records")
    return rows.agg(F.count("*").alias("n"), F.count_distinct("unit_code").alias("n_units"), F.count_distinct("tp_code").alias("n_packages"), F.count_distinct("run_id").alias("n_runs"), F.count_if(tx.has_text(_s())).alias("n_statements"))


def first_statements(spark, d):
    """The first three statements of every unit by row."""
    rows = table(spark, d, "rsd_skill_records").where(tx.has_text(_s()) & F.col("unit_code").isNotNull())
    return first_by(rows, ["unit_code"], [F.col("row_index").asc_nulls_last(), F.col("id")], 3).select("unit_code", "id")


def package_labels(spark, d):
    """Dense numbers of the training packages in order of first appearance."""
    first = table(spark, d, "rsd_skill_records").where("tp_code is not null").groupBy("tp_code").agg(F.min("id").alias("first_id"))
    return first.withColumn("label", F.row_number().over(Window.orderBy("first_id")) - 1).select("tp_code", "label")  # a row per package


def _statement_terms(spark: SparkSession, d: str, ngrams: int = 1) -> DataFrame:
    return similarity.term_weights(table(spark, d, "rsd_skill_records").where(tx.has_text(_s())).select("id", "skill_statement"), "id", _s(), ngrams=ngrams)


def term_weights(spark, d):
    """Tf-idf of words and word pairs, folded to one row a statement."""
    w = _statement_terms(spark, d, 2)
    return w.groupBy("id").agg(F.count("*").alias("n_terms"), F.round(F.max("weight"), 6).alias("top_weight"), F.round(F.sum("weight"), 6).alias("sum_weight"))


def similar_statements(spark, d):
    """Pairs of different statements of cosine 0.85 or more, over distinct texts."""
    rows = table(spark, d, "rsd_skill_records").where(tx.has_text(_s())).groupBy("skill_statement").agg(F.min("id").alias("id"))
    pairs = similarity.cosine_pairs(similarity.term_weights(rows, "id", _s()), "id", LINKED)
    return pairs.select("a", "b", F.round("sim", 6).alias("sim"))


def statement_duplicates(spark, d):
    """Pairs of distinct texts of cosine 0.92 or more with a count per statement."""
    pairs = similar_statements(spark, d).where(F.col("sim") >= NEAR)
    ends = pairs.select(F.col("a").alias("id")).union(pairs.select("b"))
    return ends.groupBy("id").agg(F.count("*").alias("n_near"))


def statement_clusters(spark, d):
    """Density clusters of distinct statements over the pairs of cosine 0.85 or more."""
    pairs = similar_statements(spark, d)
    rows = table(spark, d, "rsd_skill_records").where(tx.has_text(_s())).groupBy("skill_statement").agg(F.min("id").alias("id")).select("id")
    found = clusters.density_clusters(rows, "id", pairs.select("a", "b"))
    return found.where("cluster >= 0")


def statement_members(spark, d):
    """Every record with a statement: the id that stands for its text in the pairs, the records of that text, near texts, class.

    The other statement queries name texts by their smallest id; this is their membership. The class is the density
    cluster of the text, else that id if several records hold the text, else -1.
    """
    rows = table(spark, d, "rsd_skill_records").where(tx.has_text(_s())).select("id", "skill_statement")
    texts = rows.groupBy("skill_statement").agg(F.min("id").alias("representative"), F.count("*").alias("n_copies"))
    pairs = similar_statements(spark, d)
    near = pairs.where(F.col("sim") >= NEAR)
    near = near.select("a").union(near.select("b")).groupBy("a").agg(F.count("*").alias("n_near"))
    found = clusters.density_clusters(texts.select(F.col("representative").alias("id")), "id", pairs).where("cluster >= 0")
    known = texts.join(near, F.col("representative") == near.a, "left").join(found.withColumnRenamed("id", "k"), F.col("representative") == F.col("k"), "left")
    of_text = F.coalesce("cluster", F.when(F.col("n_copies") > 1, F.col("representative")), F.lit(-1)).alias("cluster")
    return rows.join(known.select("skill_statement", "representative", "n_copies", F.coalesce("n_near", F.lit(0)).alias("n_near"), of_text), "skill_statement").drop("skill_statement")


def task_matches(spark, d):
    """For every statement the up to three unit titles of cosine 0.25 or more."""
    titles = table(spark, d, "uoc_registry").where(tx.has_text(F.col("uoc_title"))).select("uoc_code", "uoc_title")
    rows = table(spark, d, "rsd_skill_records").where(tx.has_text(_s())).select("id", "skill_statement")
    found = similarity.best_texts(rows, "id", _s(), titles, "uoc_code", F.col("uoc_title"), 0.25, 3)
    return found.select("id", "uoc_code", F.round("sim", 5).alias("sim"), "rank")


def _occupation_base(spark: SparkSession, d: str) -> DataFrame:
    primary = linkage.current_primary(table(spark, d, "uoc_occupation_links")).select("uoc_code", "anzsco_code", "anzsco_major_group")
    rows = table(spark, d, "rsd_skill_records").where(tx.has_text(_s())).select("id", "unit_code", "tp_code", "skill_statement")
    return primary.join(rows, rows.unit_code == primary.uoc_code)


def _occupation_pairs(spark: SparkSession, d: str) -> DataFrame:
    weights = occupations.occupation_terms(_occupation_base(spark, d), "anzsco_code", _s())
    return materialise(similarity.cosine_pairs(weights, "anzsco_code", 0.3, few=True), "pairs")  # as the classification has entries


def occupation_pairs(spark, d):
    """Pairs of occupations of cosine 0.3 or more over their statements."""
    return _occupation_pairs(spark, d).select("a", "b", F.round("sim", 5).alias("sim"))


def career_pathways(spark, d):
    """The five nearest occupations of each, with shared and missing units."""
    base = _occupation_base(spark, d)
    found = occupations.pathways(_occupation_pairs(spark, d), base.select("anzsco_code", "unit_code").distinct(), "anzsco_code", "unit_code", 5)
    return found.withColumn("sim", F.round("sim", 5)).withColumn("band", tx.band(F.col("sim"), 0.6, 0.35, ("strong", "moderate", "stretch")))


def group_bridges(spark, d):
    """Similar occupations of different major groups."""
    major = _occupation_base(spark, d).where("anzsco_major_group is not null").groupBy("anzsco_code").agg(F.min("anzsco_major_group").alias("m"))
    return occupations.bridges(_occupation_pairs(spark, d), major, "anzsco_code", "m").withColumn("weight", F.floor(F.col("sim") * 100).cast("int")).withColumn("sim", F.round("sim", 5))


def skill_gap(spark, d):
    """Units of the two occupations with the most links: shared, or of one only."""
    links = table(spark, d, "uoc_occupation_links").where("uoc_code is not null and anzsco_code is not null").select("anzsco_code", "uoc_code")
    top = [r.anzsco_code for r in links.groupBy("anzsco_code").count().orderBy(F.col("count").desc(), "anzsco_code").limit(2).collect()] + [""] * 2
    return similarity.shared_sets(links, "anzsco_code", "uoc_code", top[:1], top[1:2])


def vector_pairs(spark, d):
    """Pairs of vectors of cosine 0.35 or more."""
    return similarity.vector_pairs(table(spark, d, "embeddings"), "vec_id", "embedding", VECTORS).select("a", "b", F.round("sim", 5).alias("sim"))


def vector_uniqueness(spark, d):
    return similarity.uniqueness(table(spark, d, "embeddings"), "vec_id", "embedding").select("vec_id", F.round("uniqueness", 6).alias("uniqueness"))


def label_similarity(spark, d):
    """Mean cosine within each label."""
    return similarity.group_similarity(table(spark, d, "embeddings"), "vec_id", "embedding", "label").select("label", "n", F.round("mean_sim", 6).alias("mean_sim"))


def nearest_vectors(spark, d):
    """The three nearest of every vector whose id is divisible by 100, among all."""
    rows = table(spark, d, "embeddings")
    found = similarity.nearest(rows, "vec_id", "embedding", rows.where(F.col("vec_id") % 100 == 0), 3)
    return found.select("vec_id", "neighbour", F.round("sim", 5).alias("sim"), "rank")


def vector_redundancy(spark, d):
    """Percentage of vector pairs above 0.35."""
    rows = table(spark, d, "embeddings")
    n = rows.count()
    pairs = similarity.vector_pairs(rows, "vec_id", "embedding", VECTORS, strict=True)
    return pairs.agg(F.count("*").alias("n_pairs"), F.round(similarity.share_of_pairs(pairs, n), 6).alias("percent"))


def vector_clusters(spark, d):
    """Density clusters of the vectors at cosine 0.35 with canonical members."""
    rows = table(spark, d, "embeddings")
    pairs = similarity.vector_pairs(rows, "vec_id", "embedding", VECTORS)
    found = clusters.density_clusters(rows, "vec_id", pairs)
    chosen = clusters.canonical(rows.join(found.where("cluster >= 0"), "vec_id"), "vec_id", "embedding", "cluster").select("vec_id")
    return clusters.annotate(rows.select("vec_id"), "vec_id", found, chosen)


def vector_degrees(spark, d):
    """Neighbours of every vector at cosine 0.35."""
    rows = table(spark, d, "embeddings")
    found = clusters.degrees(rows, "vec_id", similarity.vector_pairs(rows, "vec_id", "embedding", VECTORS, strict=True))
    return found.select("vec_id", "degree", F.round("centrality", 6).alias("centrality"))


def edge_list(spark, d):
    """The first 5001 edges by their ends (a report of limited size)."""
    return vector_pairs(spark, d).orderBy("a", "b").limit(5001)


def canonical_vectors(spark, d):
    """The member nearest to the mean of each label."""
    return clusters.canonical(table(spark, d, "embeddings"), "vec_id", "embedding", "label")


def vector_kmeans(spark, d):
    return clusters.kmeans(table(spark, d, "embeddings"), "vec_id", "embedding", 8)


def vector_projection(spark, d):
    return clusters.project(table(spark, d, "embeddings"), "vec_id", "embedding", 3)


def vector_spectrum(spark, d):
    return clusters.singular_values(table(spark, d, "embeddings"), "vec_id", "embedding", 3)


def domain_names(spark, d):
    """Names of the domains by their three strongest terms."""
    labels = _classes(spark, d).select("id", "domain")
    return clusters.cluster_names(_statement_terms(spark, d), "id", labels, "domain")


def order_revenue(spark, d):
    """Revenue by nation and year: the star-schema join that exercises scans, joins and aggregation together."""
    line = table(spark, d, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"))
    customer = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, d, "nation").select("n_nationkey", "n_name")
    joined = line.join(orders, line.l_orderkey == orders.o_orderkey).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name", "year").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        domain_summary, element_summary, verb_counts, domain_distribution, package_redundancy, transferability, complexity_histogram, unit_profiles, similar_units, unit_reach, header_metrics,
        first_statements, package_labels, term_weights, similar_statements, statement_duplicates, statement_clusters, statement_members, task_matches, occupation_pairs, career_pathways, group_bridges, skill_gap,
        vector_pairs, vector_uniqueness, label_similarity, nearest_vectors, vector_redundancy, vector_clusters, vector_degrees, edge_list, canonical_vectors, vector_kmeans, vector_projection,
        vector_spectrum, domain_names, order_revenue,
    )
}

_C = sk.CLASSES_SQL
_STOP = "[" + ",".join(f"'{w}'" for w in tx.STOP_WORDS) + "]"
_TERMS = lambda col: f"list_filter(regexp_extract_all(lower({col}), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: NOT list_contains({_STOP}, w))"


def _weights(docs: str, key: str, col: str, ngrams: int = 1) -> str:
    """CTEs that end in w(key, term, weight) over docs."""
    terms = "t" if ngrams == 1 else "t || list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])"
    return f"""d AS ({docs}), t0 AS (SELECT {key}, {_TERMS(col)} t FROM d), t1 AS (SELECT {key}, unnest({terms}) term FROM t0),
tf AS (SELECT {key}, term, count(*) tf FROM t1 GROUP BY ALL), dfs AS (SELECT term, count(*) df FROM tf GROUP BY 1),
raw AS (SELECT {key}, term, tf * (ln((1 + (SELECT count(*) FROM d)) / (1 + df)) + 1) r FROM tf JOIN dfs USING (term)),
w AS (SELECT {key}, term, r / sqrt(sum(r * r) OVER (PARTITION BY {key})) weight FROM raw)"""


_DISTINCT = "SELECT min(id) id, skill_statement FROM rsd_skill_records WHERE skill_statement <> '' GROUP BY skill_statement"
_PAIRS = "WITH " + _weights(_DISTINCT, "id", "skill_statement") + ", p AS (SELECT x.id a, y.id b, sum(x.weight * y.weight) sim FROM w x JOIN w y ON x.term = y.term AND x.id < y.id GROUP BY 1, 2 HAVING sum(x.weight * y.weight) >= 0.85)"
_OCC = f"""WITH {PRIMARY_SQL}, base AS (SELECT anzsco_code, anzsco_major_group, s.unit_code, s.skill_statement FROM pl JOIN rsd_skill_records s ON s.unit_code = pl.uoc_code WHERE skill_statement <> ''),
t1 AS (SELECT anzsco_code, unnest({_TERMS("skill_statement")}) term FROM base), tf AS (SELECT anzsco_code, term, count(*) tf FROM t1 GROUP BY ALL), dfs AS (SELECT term, count(*) df FROM tf GROUP BY 1),
raw AS (SELECT anzsco_code, term, (1 + ln(tf)) * (ln((1 + (SELECT count(DISTINCT anzsco_code) FROM base)) / (1 + df)) + 1) r FROM tf JOIN dfs USING (term)),
w AS (SELECT anzsco_code, term, r / sqrt(sum(r * r) OVER (PARTITION BY anzsco_code)) weight FROM raw),
p AS (SELECT x.anzsco_code a, y.anzsco_code b, sum(x.weight * y.weight) sim FROM w x JOIN w y ON x.term = y.term AND x.anzsco_code < y.anzsco_code GROUP BY 1, 2 HAVING sum(x.weight * y.weight) >= 0.3)"""
_V = "WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) e FROM embeddings WHERE embedding IS NOT NULL), p AS (SELECT x.vec_id a, y.vec_id b, list_cosine_similarity(x.e, y.e) sim FROM v x JOIN v y ON x.vec_id < y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.35)"
_COMPONENT = """, e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r(n, m) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.n), c AS (SELECT n, min(m) cluster FROM r GROUP BY n)"""

ORACLE = {
    "domain_summary": _C + """, v0 AS (SELECT "domain", verb, count(*) n FROM c GROUP BY 1, 2), v AS (SELECT "domain", verb FROM v0 QUALIFY row_number() OVER (PARTITION BY "domain" ORDER BY n DESC, verb) = 1),
  a AS (SELECT "domain", count(*) n, count(DISTINCT unit_code) n_units, count(DISTINCT tp_code) n_packages, round(avg(complexity), 3) mean_complexity FROM c GROUP BY 1)
  SELECT a.*, v.verb, CASE WHEN mean_complexity >= 7 THEN 'High' WHEN mean_complexity >= 4 THEN 'Medium' ELSE 'Low' END band FROM a JOIN v USING ("domain")""",
    "element_summary": _C + "SELECT unit_code, element_title, count(*) n, round(avg(complexity), 3) mean_complexity, string_agg(DISTINCT verb, ', ' ORDER BY verb) verbs FROM c WHERE unit_code IS NOT NULL AND element_title IS NOT NULL GROUP BY 1, 2",
    "verb_counts": _C + "SELECT verb, count(*) n FROM c GROUP BY 1 ORDER BY n DESC, verb LIMIT 8",
    "domain_distribution": _C + 'SELECT "domain", count(*) n, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) percent FROM c GROUP BY 1',
    "package_redundancy": "SELECT tp_code, count(*) total, count(DISTINCT skill_statement) distinct_statements, round(1 - count(DISTINCT skill_statement) / count(*), 6) redundancy FROM rsd_skill_records WHERE skill_statement <> '' GROUP BY 1",
    "transferability": _C + ', k AS (SELECT unit_code, count(DISTINCT "domain") k FROM c WHERE unit_code IS NOT NULL GROUP BY 1) SELECT count(*) n_units, count(*) FILTER (k >= 3) n_wide, round(count(*) FILTER (k >= 3) * 100.0 / count(*), 4) percent FROM k',
    "complexity_histogram": _C + 'SELECT "domain", least(floor((complexity - 1) / 0.9 + 1e-9), 9)::INT bin, count(*) n FROM c GROUP BY 1, 2',
    "unit_profiles": _C + 'SELECT unit_code, "domain", count(*) n, round(count(*) / sum(count(*)) OVER (PARTITION BY unit_code), 6) share FROM c WHERE unit_code IS NOT NULL GROUP BY 1, 2',
    "similar_units": _C + """, n AS (SELECT unit_code, "domain", count(*)::DOUBLE n FROM c WHERE unit_code IS NOT NULL GROUP BY 1, 2), u AS (SELECT unit_code, sum(n) t, sqrt(sum(n * n)) len FROM n GROUP BY 1),
  k AS (SELECT unit_code c, len clen FROM u ORDER BY t DESC, unit_code LIMIT 1), x AS (SELECT n.unit_code, sum(n.n * m.n) dot FROM n JOIN n m USING ("domain") JOIN k ON m.unit_code = k.c WHERE n.unit_code <> k.c GROUP BY 1)
  SELECT x.unit_code, round(dot / (len * clen), 6) sim FROM x JOIN u USING (unit_code), k ORDER BY sim DESC, 1 LIMIT 10""",
    "unit_reach": _C + ', n AS (SELECT "domain", count(DISTINCT unit_code) n_units FROM c GROUP BY 1) SELECT "domain", n_units, round((n_units - min(n_units) OVER ()) / greatest(max(n_units) OVER () - min(n_units) OVER (), 1) * 9 + 1, 6) reach FROM n',
    "header_metrics": "SELECT count(*) n, count(DISTINCT unit_code) n_units, count(DISTINCT tp_code) n_packages, count(DISTINCT run_id) n_runs, count(*) FILTER (skill_statement <> '') n_statements FROM rsd_skill_records",
    "first_statements": "SELECT unit_code, id FROM rsd_skill_records WHERE skill_statement <> '' AND unit_code IS NOT NULL QUALIFY row_number() OVER (PARTITION BY unit_code ORDER BY row_index ASC NULLS LAST, id) <= 3",
    "package_labels": "SELECT tp_code, (row_number() OVER (ORDER BY min(id)) - 1)::INT AS label FROM rsd_skill_records WHERE tp_code IS NOT NULL GROUP BY 1",
    "term_weights": "WITH " + _weights("SELECT id, skill_statement FROM rsd_skill_records WHERE skill_statement <> ''", "id", "skill_statement", 2) + " SELECT id, count(*) n_terms, round(max(weight), 6) top_weight, round(sum(weight), 6) sum_weight FROM w GROUP BY 1",
    "similar_statements": _PAIRS + " SELECT a, b, round(sim, 6) sim FROM p",
    "statement_duplicates": _PAIRS + ", n AS (SELECT a, b FROM p WHERE round(sim, 6) >= 0.92) SELECT id, count(*) n_near FROM (SELECT a id FROM n UNION ALL SELECT b FROM n) GROUP BY 1",
    "statement_clusters": _PAIRS.replace("WITH ", "WITH RECURSIVE ", 1) + _COMPONENT + " SELECT n id, cluster FROM c",
    "statement_members": _PAIRS.replace("WITH ", "WITH RECURSIVE ", 1) + _COMPONENT + """, m AS (SELECT a, b FROM p WHERE round(sim, 6) >= 0.92), k AS (SELECT id, count(*) n_near FROM (SELECT a id FROM m UNION ALL SELECT b FROM m) GROUP BY 1),
  g AS (SELECT skill_statement, min(id) representative, count(*) n_copies FROM rsd_skill_records WHERE skill_statement <> '' GROUP BY 1)
  SELECT s.id, g.representative, g.n_copies, coalesce(k.n_near, 0) n_near, coalesce(c.cluster, CASE WHEN g.n_copies > 1 THEN g.representative ELSE -1 END) cluster
  FROM rsd_skill_records s JOIN g USING (skill_statement) LEFT JOIN k ON k.id = g.representative LEFT JOIN c ON c.n = g.representative""",
    "task_matches": "WITH " + _weights("SELECT uoc_code, uoc_title FROM uoc_registry WHERE uoc_title <> ''", "uoc_code", "uoc_title") + f""", q1 AS (SELECT id, unnest({_TERMS("skill_statement")}) term FROM rsd_skill_records WHERE skill_statement <> ''),
  q2 AS (SELECT id, term, count(*) tf FROM q1 GROUP BY ALL), q3 AS (SELECT id, term, tf * (ln((1 + (SELECT count(*) FROM d)) / (1 + df)) + 1) r FROM q2 JOIN dfs USING (term)), q4 AS (SELECT id, term, r / sqrt(sum(r * r) OVER (PARTITION BY id)) wq FROM q3),
  s AS (SELECT id, uoc_code, sum(wq * weight) sim FROM q4 JOIN w USING (term) GROUP BY 1, 2 HAVING sum(wq * weight) >= 0.25), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(sim, 9) DESC, uoc_code) "rank" FROM s)
  SELECT id, uoc_code, round(sim, 5) sim, "rank" FROM k WHERE "rank" <= 3""",
    "occupation_pairs": _OCC + " SELECT a, b, round(sim, 5) sim FROM p",
    "career_pathways": _OCC + """, u AS (SELECT DISTINCT anzsco_code, unit_code FROM base), b2 AS (SELECT a source, b target, sim FROM p UNION ALL SELECT b, a, sim FROM p),
  k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(sim, 9) DESC, target) "rank" FROM b2 QUALIFY "rank" <= 5)
  SELECT source, target, round(sim, 5) sim, "rank", (SELECT count(*) FROM u x JOIN u y USING (unit_code) WHERE x.anzsco_code = source AND y.anzsco_code = target) n_shared,
    (SELECT count(*) FROM u y WHERE y.anzsco_code = target AND NOT EXISTS (SELECT 1 FROM u x WHERE x.anzsco_code = source AND x.unit_code = y.unit_code)) n_missing,
    CASE WHEN round(sim, 5) >= 0.6 THEN 'strong' WHEN round(sim, 5) >= 0.35 THEN 'moderate' ELSE 'stretch' END band FROM k""",
    "group_bridges": _OCC + """, m AS (SELECT anzsco_code, min(anzsco_major_group) m FROM base WHERE anzsco_major_group IS NOT NULL GROUP BY 1)
  SELECT a, b, round(sim, 5) sim, x.m package_a, y.m package_b, floor(sim * 100)::INT weight FROM p JOIN m x ON x.anzsco_code = a JOIN m y ON y.anzsco_code = b WHERE x.m <> y.m""",
    "skill_gap": """WITH l AS (SELECT anzsco_code, uoc_code FROM uoc_occupation_links WHERE anzsco_code IS NOT NULL AND uoc_code IS NOT NULL), t AS (SELECT anzsco_code, row_number() OVER (ORDER BY count(*) DESC, anzsco_code) r FROM l GROUP BY 1 QUALIFY r <= 2)
  SELECT uoc_code, CASE WHEN bool_or(r = 1) AND bool_or(r = 2) THEN 'both' WHEN bool_or(r = 1) THEN 'only_a' ELSE 'only_b' END held_by FROM l JOIN t USING (anzsco_code) GROUP BY 1""",
    "vector_pairs": _V + " SELECT a, b, round(sim, 5) sim FROM p",
    "vector_uniqueness": _V + ", m AS (SELECT x.vec_id, avg(list_cosine_similarity(x.e, y.e)) s FROM v x CROSS JOIN v y GROUP BY 1) SELECT vec_id, round(1 - s, 6) uniqueness FROM m",
    "label_similarity": _V + ", m AS (SELECT x.label, avg(list_cosine_similarity(x.e, y.e)) s FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id GROUP BY 1) SELECT v.label, count(*) n, round(coalesce(any_value(s), 0), 6) mean_sim FROM v LEFT JOIN m ON m.label = v.label GROUP BY 1",
    "nearest_vectors": _V + ', n AS (SELECT x.vec_id, y.vec_id neighbour, list_cosine_similarity(x.e, y.e) sim FROM v x JOIN v y ON x.vec_id <> y.vec_id WHERE x.vec_id % 100 = 0) SELECT vec_id, neighbour, round(sim, 5) sim, row_number() OVER (PARTITION BY vec_id ORDER BY round(sim, 9) DESC, neighbour)::INT "rank" FROM n QUALIFY "rank" <= 3',
    "vector_redundancy": _V + " SELECT count(*) n_pairs, round(count(*) * 200.0 / ((SELECT count(*) FROM v) * ((SELECT count(*) FROM v) - 1)), 6) percent FROM p WHERE sim > 0.35",
    "vector_clusters": _V.replace("WITH ", "WITH RECURSIVE ", 1) + _COMPONENT + """, g AS (SELECT v.vec_id, coalesce(c.cluster, -1) cluster, v.e FROM v LEFT JOIN c ON c.n = v.vec_id),
  x AS (SELECT vec_id, cluster, unnest(e) x, generate_subscripts(e, 1) i FROM g WHERE cluster >= 0), m AS (SELECT cluster, i, avg(x) m FROM x GROUP BY ALL),
  s AS (SELECT vec_id, cluster, sum(x * m) / sqrt(sum(x * x)) s FROM x JOIN m USING (cluster, i) GROUP BY 1, 2), k AS (SELECT vec_id FROM s QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY round(s, 9) DESC, vec_id) = 1)
  SELECT vec_id, cluster, vec_id IN (SELECT vec_id FROM k) is_canonical, cluster = -1 is_singleton FROM g""",
    "vector_degrees": _V + ", e AS (SELECT a n FROM p WHERE sim > 0.35 UNION ALL SELECT b FROM p WHERE sim > 0.35), g AS (SELECT n, count(*) k FROM e GROUP BY 1) SELECT vec_id, coalesce(k, 0) AS degree, round(coalesce(k, 0) / ((SELECT count(*) FROM v) - 1), 6) centrality FROM v LEFT JOIN g ON g.n = v.vec_id",
    "edge_list": _V + " SELECT a, b, round(sim, 5) sim FROM p ORDER BY a, b LIMIT 5001",
    "canonical_vectors": _V + """, x AS (SELECT vec_id, label, unnest(e) x, generate_subscripts(e, 1) i FROM v), m AS (SELECT label, i, avg(x) m FROM x GROUP BY ALL), s AS (SELECT vec_id, label, sum(x * m) / sqrt(sum(x * x)) s FROM x JOIN m USING (label, i) GROUP BY 1, 2)
  SELECT label, vec_id FROM s QUALIFY row_number() OVER (PARTITION BY label ORDER BY round(s, 9) DESC, vec_id) = 1""",
    "domain_names": _C + ", " + _weights("SELECT id, skill_statement FROM rsd_skill_records WHERE skill_statement <> ''", "id", "skill_statement").replace("\nw AS", "\nww AS") + """, z AS (SELECT "domain", count(*) n FROM c GROUP BY 1),
  g AS (SELECT c."domain", term, round(sum(weight) / any_value(z.n), 9) m FROM ww JOIN c USING (id) JOIN z ON z."domain" = c."domain" GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY "domain" ORDER BY m DESC, term) r FROM g)
  SELECT "domain", string_agg(term, ' · ' ORDER BY r) "name" FROM k WHERE r <= 3 GROUP BY 1""",
    "order_revenue": "SELECT n_name, year(o_orderdate) AS year, round(sum(l_extendedprice * (1 - l_discount)), 2) revenue, count(*) n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2",
}
