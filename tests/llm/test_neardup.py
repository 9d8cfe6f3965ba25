import random
import re

import numpy as np
import pytest

from skillweave.llm import neardup

SCHEMA = "id long, one string, two string, key string, words string, rep int"
VOCABULARY = [f"{a}{b}{c}" for a in "bcdfgh" for b in "aeiou" for c in "klmnp"]


def make(n, seed, low=1, high=60):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.5:
            words = rows[rng.randrange(len(rows))][1].split()
            for _ in range(rng.randrange(0, 6)):
                if rng.random() < 0.5 and len(words) > 1:
                    words.pop(rng.randrange(len(words)))
                else:
                    words.insert(rng.randrange(len(words) + 1), rng.choice(VOCABULARY))
            rng.shuffle(words)
        else:
            words = rng.sample(VOCABULARY, min(len(VOCABULARY), rng.randrange(low, high)))
        rows.append((i, " ".join(words)))
    return rows


def brute(rows, t=(4, 5)):
    sets = [(i, frozenset(re.findall(r"[^\W\d_]+", " ".join(x or "" for x in texts).lower()))) for i, *texts in rows]
    out = set()
    for x in range(len(sets)):
        for y in range(x):
            (i, a), (j, b) = sets[x], sets[y]
            if i != j and a and b and len(a & b) * t[1] >= len(a | b) * t[0]:
                out.add((min(i, j), max(i, j)))
    return out


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, a, b, "no", "no", 0) for i, a, b in rows], SCHEMA).repartition(3)
    member, links = neardup.near_duplicates(df, "id", "one", "two", **more)
    return {tuple(r) for r in neardup.pairs_of_records(member, links).collect()}


def test_against_all_pairs(spark):
    rows = [(i, t, None if i % 3 else "5 Extra9words, EXTRA") for i, t in make(400, 1)]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("t", [(1, 2), (9, 10)])
def test_other_thresholds(spark, t):
    rows = [(i, x, "") for i, x in make(200, 2)]
    assert run(spark, rows, t=t) == brute(rows, t)


def test_oversized_blocks_are_divided(spark):
    """Boilerplate that all share makes one large block; dividing it loses no pair."""
    base = " ".join(VOCABULARY[:60])
    rows = [(i, base + " " + x, "") for i, x in make(150, 3, 1, 25)]
    df = spark.createDataFrame([(i, a, b, "", "", 0) for i, a, b in rows], SCHEMA)
    sets = neardup.word_sets(df, "id", "one", "two").select("key", "words")
    whole = {(r.a, r.b) for r in neardup.similar_sets(sets).collect()}
    for slack in (0, 1):
        assert whole == {(r.a, r.b) for r in neardup.similar_sets(sets, hot=4, slack=slack).collect()} and whole


def test_slack_loses_nothing(spark):
    rows = [(i, x, "") for i, x in make(500, 4)]
    df = spark.createDataFrame([(i, a, b, "", "", 0) for i, a, b in rows], SCHEMA)
    sets = neardup.word_sets(df, "id", "one", "two").select("key", "words")
    plain = [(r.a, r.b) for r in neardup.similar_sets(sets, slack=0).collect()]
    wide = [(r.a, r.b) for r in neardup.similar_sets(sets, slack=1).collect()]
    assert sorted(plain) == sorted(wide) and len(set(wide)) == len(wide) > 50


def test_copies_nulls_and_blanks(spark):
    rows = [(1, "a b c", None), (2, None, "C, b; A"), (3, None, None), (4, "", ""), (5, "12 34", ""), (1, "a b c", None), (6, "a b c d e f", "g")]
    assert run(spark, rows) == {(1, 2)}


def test_empty_table(spark):
    assert run(spark, []) == set()


def test_long_texts(spark):
    def word(i):
        return "".join(chr(97 + int(c)) for c in str(i))

    long = " ".join(word(i) for i in range(70_000))
    rows = [(1, long, ""), (2, long + " extra", ""), (3, "short", "")]
    assert run(spark, rows) == {(1, 2)}


def test_bounds_hold():
    """No filter discards a pair within the distance: differences of coordinates never exceed it."""
    rng = np.random.default_rng(1)
    scheme = neardup.Scheme([], [rng.integers(0, 10**9, 30).tolist() for _ in range(neardup.PIVOTS)], (4, 5))
    for _ in range(50):
        a = np.unique(rng.integers(0, 10**9, 60))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.95], rng.integers(0, 10**9, 4)]))
        words, record = np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)])
        sizes = np.array([len(a), len(b)])
        differ = len(np.setxor1d(a, b))
        columns = scheme.distances(scheme.coordinates(words, record, sizes))
        assert len(columns) == neardup.PIVOTS + 1 and max(abs(int(c[0]) - int(c[1])) for c in columns) <= differ
        if differ <= scheme.distance(len(a) + len(b)):
            for scheme.slack in (0, 1):
                scheme.hot = np.zeros(0, np.uint64)
                row, sig, _ = scheme.signatures(words, record, sizes)
                assert set(sig[row == 0].tolist()) & set(sig[row == 1].tolist())
                scheme.hot = np.unique(sig)  # all divided
                row, more, _ = scheme.signatures(words, record, sizes)
                assert set(more[row == 0].tolist()) & set(more[row == 1].tolist()) and not np.isin(more, sig).any()


def test_coordinates_are_distances():
    """The pivot table holds the Hamming distances to the reference fingerprints, but for the pivots' sizes."""
    rng = np.random.default_rng(2)
    pivots = [np.unique(rng.integers(0, 200, 60)).tolist() for _ in range(neardup.PIVOTS)]
    scheme = neardup.Scheme([], pivots, (4, 5))
    sets = [np.unique(rng.integers(0, 200, k)) for k in (5, 60, 90)]
    sizes = np.array([len(x) for x in sets])
    columns = scheme.distances(scheme.coordinates(np.concatenate(sets), np.repeat(np.arange(3), sizes), sizes))
    for k, p in enumerate(pivots):
        assert [int(d) + len(p) for d in columns[k + 1]] == [len(set(x.tolist()) ^ set(p)) for x in sets]


def test_hot_blocks_are_tiled(spark, monkeypatch):
    """Blocks that no division makes small are compared in tiles; the sample may miss them."""
    base = " ".join(VOCABULARY[:80])
    rows = [(i, base + " " + x, "") for i, x in make(60, 5, 1, 12)]
    monkeypatch.setattr(neardup, "SAMPLE", 10)
    df = spark.createDataFrame([(i, a, b, "", "", 0) for i, a, b in rows], SCHEMA)
    sets = neardup.word_sets(df, "id", "one", "two").select("key", "words")
    found = [(r.a, r.b) for r in neardup.similar_sets(sets, hot=20).collect()]
    assert sorted(found) == sorted((r.a, r.b) for r in neardup.similar_sets(sets).collect()) and len(found) > 500


def test_groups(spark):
    rows = [(i, x, "") for i, x in make(200, 9)] + [(900, "a b c", ""), (901, "c B a", ""), (902, "", None)]
    df = spark.createDataFrame([(i, a, b, "", "", 0) for i, a, b in rows], SCHEMA)
    found = {r.id: r for r in neardup.groups_of_records(*neardup.near_duplicates(df, "id", "one", "two")).collect()}
    group = {i: i for i, a, _ in rows if a}
    links = {i: set() for i in group}
    sets = {i: frozenset(re.findall(r"[^\W\d_]+", a.lower())) for i, a, _ in rows}
    for i, j in sorted(brute(rows)):
        if sets[i] != sets[j]:
            links[i].add(sets[j])
            links[j].add(sets[i])
    changed = True
    while changed:
        changed = False
        for i, j in brute(rows):
            low = min(group[i], group[j])
            changed |= group[i] != low or group[j] != low
            group[i] = group[j] = low
    assert found.keys() == group.keys() and {i: r.group_id for i, r in found.items()} == group
    assert all(r.n_links == len(links[i]) for i, r in found.items()) and (found[901].class_id, found[901].n_copies) == (900, 2)
