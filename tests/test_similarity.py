import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skillweave.operators import clusters, similarity
from skillweave.plans import analytics


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 6))
    m = np.concatenate([base[i % 12] + 0.25 * rng.normal(size=6) for i in range(90)]).reshape(90, 6)
    m[7] = 0
    rows = [(i, [float(x) for x in m[i]], i % 4) for i in range(90)] + [(90, None, 1)]
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return spark.createDataFrame(rows, "id long, v array<double>, label int"), m / np.where(n == 0, 1, n)


@pytest.mark.parametrize("t", [0.1, 0.6, 0.95])
def test_vector_pairs(vectors, monkeypatch, t):
    df, m = vectors
    monkeypatch.setattr(similarity, "CELLS_PER_MILLION", 80_000)
    sim = m @ m.T
    want = {(i, j) for i in range(90) for j in range(i + 1, 90) if sim[i, j] >= t}
    found = [(r.a, r.b) for r in similarity.vector_pairs(df, "id", "v", t).collect()]
    assert len(found) == len(set(found)) and set(found) == want


def test_linear_shortcuts(vectors):
    df, m = vectors
    sim = m @ m.T
    found = {r.id: r.uniqueness for r in similarity.uniqueness(df, "id", "v").collect()}
    assert all(found[i] == pytest.approx(1 - sim[i].mean(), abs=1e-9) for i in range(90))
    inside = {r.label: (r.n, r.mean_sim) for r in similarity.group_similarity(df, "id", "v", "label").collect()}
    for g in range(4):
        rows = [i for i in range(90) if i % 4 == g and i != 7] + ([7] if g == 3 else [])
        block = sim[np.ix_(rows, rows)]
        assert inside[g][1] == pytest.approx((block.sum() - np.trace(block)) / (len(rows) * (len(rows) - 1)), abs=1e-9)


def test_nearest(vectors):
    df, m = vectors
    sim = m @ m.T
    found = {(r.id, r["rank"]): r.neighbour for r in similarity.nearest(df, "id", "v", df.where("id % 10 = 0"), 2).collect()}
    for i in range(0, 90, 10):
        order = sorted((j for j in range(90) if j != i), key=lambda j: (-round(sim[i, j], 9), j))
        assert [found[i, 1], found[i, 2]] == order[:2]


def test_cosine_pairs_of_terms(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choices([f"word{k}" for k in range(25)], k=rng.randrange(1, 12)))) for i in range(80)]
    df = spark.createDataFrame(docs, "id int, t string")
    w = similarity.term_weights(df, "id", F.col("t"), ngrams=2).cache()
    rows = {}
    for r in w.collect():
        rows.setdefault(r.id, {})[r.term] = r.weight
    for t in (0.2, 0.6, 0.9):
        want = {(a, b) for a in rows for b in rows if a < b and sum(x * rows[b].get(k, 0) for k, x in rows[a].items()) >= t}
        assert {(r.a, r.b) for r in similarity.cosine_pairs(w, "id", t).collect()} == want
    best = {(r.id, r["rank"]): r.other for r in similarity.best_matches(w, "id", w.withColumnRenamed("id", "other"), "other", 0.3, 1).collect()}
    assert len(best) == len(rows)


def _best(texts, targets, t, n):
    """Brute force: (key, target, rank) by word lists."""
    df = Counter(w for ws in targets.values() for w in set(ws))
    idf = {w: math.log((1 + len(targets)) / (1 + k)) + 1 for w, k in df.items()}

    def unit(ws):
        raw = {w: k * idf[w] for w, k in Counter(ws).items() if w in idf}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        return {w: x / norm for w, x in raw.items()}

    held, found = {k: unit(ws) for k, ws in targets.items()}, set()
    for key, ws in texts.items():
        mine = unit(ws)
        sims = sorted((-round(s, 9), k) for k, v in held.items() if (s := sum(x * v.get(w, 0) for w, x in mine.items())) >= t)
        found |= {(key, k, i + 1) for i, (_, k) in enumerate(sims[:n])}
    return found


def _texts(seed):
    """Short, long, repeated, empty and unknown texts over few words of unequal frequency."""
    r = random.Random(seed)
    words = [f"word{k}" for k in range(40)]
    some = lambda lo, hi, own=(): r.choices([*words, *own], weights=[1 / (i + 2) for i in range(40)] + [0.05] * len(own), k=r.randrange(lo, hi))
    targets = {f"T{i:03}": some(1, 7) for i in range(150)} | {f"U{i}": some(18, 60) for i in range(6)} | {f"A{i}": ["word3", "word9", "word4"] for i in range(9)}
    texts = {i: some(1, 14, ["unknown"]) for i in range(120)} | {200 + i: some(60, 90) for i in range(5)} | {300: ["unknown"], 301: [], 302: ["word4", "word3", "word9"], 303: ["word9", "word4", "word3"]}
    return texts, targets


@pytest.mark.parametrize("short, long, pairs", [(16, 32, 500_000), (4, 6, 7), (0, 0, 40)])
def test_targets_by_shared_words(monkeypatch, short, long, pairs):
    """Lists by one, two and three words, cut where nothing better can follow, find what brute force finds."""
    monkeypatch.setattr(similarity, "SHORT", short)
    monkeypatch.setattr(similarity, "LONG", long)
    monkeypatch.setattr(similarity, "PAIRS_AT_ONCE", pairs)
    for seed in range(3):
        texts, targets = _texts(seed)
        known = sorted({w for ws in targets.values() for w in ws})
        number = {w: i for i, w in enumerate(known)}
        df = Counter(w for ws in targets.values() for w in set(ws))
        idf = np.array([math.log((1 + len(targets)) / (1 + df[w])) + 1 for w in known])
        table = pa.table({"bag": pa.array([[number[w] for w in ws] for ws in targets.values()], pa.list_(pa.int64())), "k": [[k] for k in targets]})
        held = similarity._targets(table, np.arange(len(known)), idf)
        bags = {k: sorted(number[w] for w in ws if w in number) for k, ws in texts.items()}
        for t, n in ((0.25, 3), (0.6, 1), (0.05, 200)):
            found = set()
            for key, bag in bags.items():
                if bag:
                    _, word, weight = similarity._unit_vectors(np.array(bag), np.zeros(len(bag), int), 1, idf)
                    _, target, _ = held.best(word[None], weight[None], t, n)
                    found |= {(key, held.names[int(held.ranks[held.of[j]])].as_py(), i + 1) for i, j in enumerate(target)}
            assert found == _best(texts, targets, t, n)


@pytest.mark.parametrize("terms, combinations", [(500_000, 4_000_000), (500_000, 500), (0, 1)])
def test_best_texts(spark, monkeypatch, terms, combinations):
    """One block, several blocks and the join on the terms; keys whose words stand in several rows; more equal targets than asked for."""
    monkeypatch.setattr(similarity, "BROADCAST_TERMS", terms)
    monkeypatch.setattr(similarity, "COMBINATIONS_AT_ONCE", combinations)
    texts, targets = _texts(7)
    rows = spark.createDataFrame([(k, " ".join(ws)) for k, ws in texts.items()] + [(5, "word1 word2"), (400, None)], "id long, s string")
    texts[5] = [*texts[5], "word1", "word2"]
    named = spark.createDataFrame([(k, " ".join(ws)) for k, ws in targets.items()], "code string, name string")
    found = similarity.best_texts(rows, "id", F.col("s"), named, "code", F.col("name"), 0.25, 3)
    assert found.columns == ["id", "code", "sim", "rank"] and dict(found.dtypes)["rank"] == "int"
    held = [(r.id, r.code, r["rank"]) for r in found.collect()]
    assert len(held) == len(set(held)) and set(held) == _best(texts, targets, 0.25, 3)
    assert {k for i, k, _ in held if i == 302} == {"A0", "A1", "A2"}
    assert similarity.best_texts(rows, "id", F.col("s"), named.limit(0), "code", F.col("name"), 0.25, 3).count() == 0


def test_task_matches_shuffles_no_pairs(spark, tmp_path, request):
    """Statements and titles that all share words meet in a million pairs, which are compared where they meet."""
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    request.addfinalizer(lambda: spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # tables are too large to send in practice
    titles = [(f"U{i:04}", f"operate machine part{i % 100} tool{i // 100}") for i in range(500)]
    rows = [(i, f"operate machine part{i % 100} with site{i} tool{i % 5}") for i in range(2000)]
    spark.createDataFrame(titles, "uoc_code string, uoc_title string").write.parquet(str(tmp_path / "uoc_registry.parquet"))
    spark.createDataFrame(rows, "id bigint, skill_statement string").write.parquet(str(tmp_path / "rsd_skill_records.parquet"))

    def shuffled():
        context = spark.sparkContext._jsc.sc()
        context.listenerBus().waitUntilEmpty(30_000)
        held = context.statusStore().executorList(True)
        return sum(held.apply(i).totalShuffleWrite() for i in range(held.size()))

    before = shuffled()
    found = {(r.id, r["rank"]): r.uoc_code for r in analytics.task_matches(spark, str(tmp_path)).collect()}
    assert len(found) == 6000 and all(found[i, 1] == f"U{i % 100 + i % 5 * 100:04}" for i in range(2000))
    assert shuffled() - before < 1_000_000


def test_every_record_is_a_member(spark, tmp_path):
    """Copies of a text share its class and count; copies without a near text are a class of their own."""
    near = "grind polish repair inspect measure mount align balance lubricate wheel"
    texts = [near, "sew canvas sails", near + " wheel", "sew canvas sails", near, "bake bread", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "id bigint, skill_statement string").coalesce(1).write.parquet(str(tmp_path / "rsd_skill_records.parquet"))
    found = {r.id: (r.representative, r.n_copies, r.n_near, r.cluster) for r in analytics.statement_members(spark, str(tmp_path)).collect()}
    assert found == {0: (0, 2, 1, 0), 1: (1, 2, 0, 1), 2: (2, 1, 1, 0), 3: (1, 2, 0, 1), 4: (0, 2, 1, 0), 5: (5, 1, 0, -1)}


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(200 + i, 201 + i) for i in range(40)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    want = {(x, root(x)) for e in edges if e[0] != e[1] for x in e}
    found = {(r.node, r.component) for r in clusters.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == want
    assert clusters.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_density_clusters(spark):
    nodes = spark.range(8)
    edges = spark.createDataFrame([(0, 1), (1, 2), (3, 4)], "a long, b long")
    found = {r.id: r.cluster for r in clusters.density_clusters(nodes, "id", edges).collect()}
    assert found == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: -1, 6: -1, 7: -1}
    three = {r.id: r.cluster for r in clusters.density_clusters(nodes, "id", edges, 3).collect()}
    assert three == {0: 1, 1: 1, 2: 1, 3: -1, 4: -1, 5: -1, 6: -1, 7: -1}


def test_canonical_and_degrees(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.9, 0.1], 0), (3, [0.5, 0.5], 0), (4, [0.0, 1.0], 1)], "id long, v array<double>, g int")
    assert {(r.g, r.id) for r in clusters.canonical(df, "id", "v", "g").collect()} == {(0, 2), (1, 4)}
    found = {r.id: (r.degree, round(r.centrality, 4)) for r in clusters.degrees(df, "id", spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")).collect()}
    assert found == {1: (2, 0.6667), 2: (1, 0.3333), 3: (1, 0.3333), 4: (0, 0.0)}


def test_spectrum_and_kmeans(vectors):
    df, m = vectors
    values = [r.value for r in clusters.singular_values(df, "id", "v", 3).orderBy("dim").collect()]
    assert values == pytest.approx(np.linalg.svd(m, compute_uv=False)[:3], rel=1e-6)
    assert clusters.kmeans(df, "id", "v", 5, starts=1).select("cluster").distinct().count() == 5


def test_shared_sets(spark):
    rows = spark.createDataFrame([("x", 1), ("x", 2), ("y", 2), ("y", 3), ("z", 9)], "g string, i int")
    assert {tuple(r) for r in similarity.shared_sets(rows, "g", "i", ["x"], ["y"]).collect()} == {(1, "only_a"), (2, "both"), (3, "only_b")}


def test_kmeans_keeps_the_best_of_ten_starts(vectors, monkeypatch):
    from pyspark.ml.clustering import KMeans

    fit, costs = KMeans.fit, []
    monkeypatch.setattr(KMeans, "fit", lambda self, data: costs.append(fit(self, data)) or costs[-1])
    clusters.kmeans(vectors[0], "id", "v", 3)
    assert len({m.getSeed() for m in costs}) == 10


def test_reduced_vectors(spark):
    """Cosines of reduced vectors are those of numpy's truncated decomposition."""
    rng = np.random.default_rng(4)
    m = rng.normal(size=(60, 12)) @ np.diag(np.linspace(3, 0.1, 12))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(99, None)], "k int, v array<double>").repartition(3)
    found = {r.k: np.array(r.reduced) for r in clusters.reduced(df, "k", "v", 3).collect()}
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    u, s, _ = np.linalg.svd(unit, full_matrices=False)
    low = u[:, :3] * s[:3]
    low /= np.linalg.norm(low, axis=1, keepdims=True)
    assert sorted(found) == list(range(60)) and np.allclose(np.stack([found[i] for i in range(60)]) @ found[7], low @ low[7])


def test_crowded_cells_and_ties(spark, monkeypatch):
    rng = np.random.default_rng(5)
    m = np.repeat(rng.normal(size=(30, 6)), 3, axis=0)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "k int, v array<double>").repartition(4)
    whole = sorted((r.a, r.b, round(r.sim, 9)) for r in similarity.vector_pairs(df, "k", "v", 0.5).collect())
    monkeypatch.setattr(similarity, "ROWS_A_TASK", 7)
    monkeypatch.setattr(similarity, "QUERIES_AT_ONCE", 4)
    assert whole == sorted((r.a, r.b, round(r.sim, 9)) for r in similarity.vector_pairs(df, "k", "v", 0.5).collect())
    found = {(r.k, r.rank): r.neighbour for r in similarity.nearest(df, "k", "v", df, 2).collect()}
    assert all({found[3 * g + j, 1], found[3 * g + j, 2]} == {3 * g, 3 * g + 1, 3 * g + 2} - {3 * g + j} for g in range(30) for j in range(3))
    assert all(found[3 * g + 2, 1] == 3 * g for g in range(30))


def test_pairs_in_tiles(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, w, 1.0) for i in range(120) for w in rng.sample("abcdefghij", 5)]
    raw = spark.createDataFrame(rows, "id long, term string, weight double").withColumn("weight", F.lit(1 / 5**0.5))
    vectors = {}
    for i, w, _ in rows:
        vectors.setdefault(i, set()).add(w)
    expected = sorted((i, j) for i in vectors for j in vectors if i < j and len(vectors[i] & vectors[j]) >= 4)
    for size, terms in ((1_500, 2_000), (10, 3)):
        monkeypatch.setattr(similarity, "TEXTS_A_TASK", size)
        monkeypatch.setattr(similarity, "TERMS_AT_ONCE", terms)
        assert sorted((r.a, r.b) for r in similarity.cosine_pairs(raw, "id", 0.79).collect()) == expected
    assert similarity.cosine_pairs(raw.limit(0), "id", 0.79).collect() == []
