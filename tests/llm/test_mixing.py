from pathlib import Path

import pytest

from skillweave.llm import mixing, tokens

pytestmark = pytest.mark.skipif(not Path(tokens.VOCABULARY).exists(), reason="no vocabulary file")
DOCS = "doc_id long, text string, source string, n_tokens long, copy int"
PLAN = "source string, target_share double, max_repeats int, max_tokens int, overlap_tokens int"


def run(spark, docs, plan, **more):
    d = spark.createDataFrame([(i, t, s, 0, 0) for i, t, s in docs], DOCS).repartition(3)
    mix, report = mixing.mix(d, spark.createDataFrame([(*p, 0, 0) for p in plan], PLAN), **more)
    return [tuple(r) for r in mix.collect()], {r.source: r for r in report.collect()}


BIG = [(i, "one two three four", "big") for i in range(1000)]
SMALL = [(5000 + i, "one two three four", " Small ") for i in range(100)]


def test_shares_and_caps(spark):
    mix, report = run(spark, BIG + SMALL, [("big", 0.7, 1), ("small", 0.3, 3)])
    assert report["small"].rate == pytest.approx(3) and report["small"].most_copies == 3
    assert report["big"].share == pytest.approx(0.7, abs=0.02) and report["small"].share == pytest.approx(0.3, abs=0.02)
    assert sum(r.mixed_tokens for r in report.values()) == sum(m[3] for m in mix) == 4 * len(mix)
    assert len({(m[0], m[2]) for m in mix}) == len(mix) and all(m[2] == 1 for m in mix if m[1] == "big")


def test_fraction_is_drawn_by_hash(spark):
    plan = [("big", 0.5, 2), ("small", 0.5, 4)]
    one, report = run(spark, BIG + SMALL, plan)
    assert report["big"].rate == pytest.approx(0.4) and 340 < report["big"].n_copies < 460
    again, _ = run(spark, SMALL + BIG[::-1], plan)
    assert sorted(one) == sorted(again)
    assert sorted(run(spark, BIG + SMALL, plan, seed=7)[0]) != sorted(one)


def test_stated_total_and_shortage(spark):
    _, report = run(spark, BIG + SMALL, [("big", 0.5, 1), ("small", 0.5, 2)], total_tokens=4000)
    assert report["small"].rate == 2 and report["small"].share < 0.5


def test_nulls_blanks_and_unknown_sources(spark):
    docs = [(1, None, "a"), (2, "", "a"), (3, "word", "a"), (4, "word", None), (5, "word", "zz"), (3, "word", "a")]
    mix, report = run(spark, docs, [("A", 1.0, 1), ("b", 0.0, 1), (None, 0.5, 1)])
    assert sorted(m[0] for m in mix) == [3, 3] and report["b"].n_copies == 0 and set(report) == {"a", "b"}


def test_empty_tables(spark):
    assert run(spark, [], [("a", 1.0, 1)])[0] == [] and run(spark, BIG[:3], []) == ([], {})


def test_long_text(spark):
    mix, _ = run(spark, [(1, "word " * 200_000, "a")], [("a", 1.0, 1)])
    assert mix[0][3] >= 200_000
