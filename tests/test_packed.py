import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skillweave.operators import packed

SCHEMA = "id long, text string, pos int, item string, field string"


def unpack(spark, texts):
    df = spark.createDataFrame([(i, t, 9, "x", "y") for i, t in enumerate(texts)], SCHEMA)
    out = {}
    for r in packed.unpack([packed.cells(df, "t", "id", "text")]).orderBy("row_id", "pos").collect():
        assert (r.src_table, r.field) == ("t", "text")
        out.setdefault(r.row_id, []).append((r.pos, r.item))
    return [[x for _, x in out.get(i, [])] for i in range(len(texts))] if all([p for p, _ in v] == list(range(1, len(v) + 1)) for v in out.values()) else None


CASES = [
    ("a; b ;;c", ["a", "b", "c"]),
    ('"a, b"; c', ["a, b", "c"]),
    ('“a; ""b” • "c ""d"" e"', ['a; ""b', 'c "d" e']),
    ("x/y - z & w\tq\r\nr", ["x/y - z & w", "q", "r"]),
    ("N/A", []),
    (" n/a ", []),
    ("", []),
    ("  ", []),
    (None, []),
    (";;|", []),
    ("a|a|a", ["a", "a", "a"]),
    ('"open, b; c', ['"open', "b", "c"]),
    ('5" pipe, 6" pipe', ['5" pipe', '6" pipe']),
    ('""', []),
    ('Clerk ("Linen, wool" stream); x', ['Clerk ("Linen, wool" stream)', "x"]),
]


def test_cases(spark):
    assert unpack(spark, [t for t, _ in CASES]) == [e for _, e in CASES]


def test_learns_values_with_delimiters(spark):
    """A value that is quoted often is kept whole where it stands unquoted; others are cut."""
    texts = ['"sail loft, aft"|rope'] * 30 + ["rope|sail loft, aft|winch"] + ["rope, winch"] * 5
    found = unpack(spark, texts)
    assert found[30] == ["rope", "sail loft, aft", "winch"]
    assert found[0] == ["sail loft, aft", "rope"] and found[31] == ["rope", "winch"]


def test_parts_that_are_values_of_their_own_stay_apart(spark):
    texts = ['"rope, winch"'] + ["rope, winch", "rope; cleat", "winch; cleat", "rope|winch"] * 40
    found = unpack(spark, texts)
    assert found[0] == ["rope, winch"] and found[1] == ["rope", "winch"]


def test_several_quoted_values(spark):
    texts = ['"sail loft, aft"|rope', '"cold room, east"|rope'] * 20 + ["rope|sail loft, aft|cold room, east"]
    assert unpack(spark, texts)[-1] == ["rope", "sail loft, aft", "cold room, east"]


def planted(size, n=400):
    """Lists of words in any order, a twentieth of them with a value of `size` parts that is never quoted."""
    rng = random.Random(5)
    words, value = [f"word{i}" for i in range(60)], ", ".join(f"part {i}" for i in range(size))
    texts, expected = [], []
    for k in range(n):
        items = [rng.choice(words) for _ in range(rng.randrange(3, 9))]
        if k % 20 == 0:
            items[rng.randrange(len(items))] = value
        texts.append((", " if k % 3 else "; ").join(items))
        expected.append(items)
    return texts, expected


@pytest.mark.parametrize("size", [2, 3, 5, 6])
def test_values_that_are_never_quoted(spark, size):
    """Parts that only stand together are one value, however many they are; words that merely meet often stay apart."""
    texts, expected = planted(size)
    assert unpack(spark, texts) == expected
    df = spark.createDataFrame([(i, t, 9, "x", "y") for i, t in enumerate(texts)], SCHEMA)
    row = packed.choices([packed.cells(df, "t", "id", "text")]).first()
    assert (row.n_fields, row.n_joined) == (400, 20) and row.n_open >= row.n_joined


def test_lists_that_come_again_show_nothing_new(spark):
    """The same pair in repeated rows is no value: it always has the same surroundings."""
    assert unpack(spark, ["rope, winch; cleat"] * 50)[0] == ["rope", "winch", "cleat"]


def test_most_pairs_that_may_be_values_are_cut(spark):
    """Frequent words meet often enough to open second paths, which Viterbi doesn't take."""
    rng = random.Random(3)
    texts = [", ".join(rng.choice("abcdef") for _ in range(6)) for _ in range(300)]
    df = spark.createDataFrame([(i, t, 9, "x", "y") for i, t in enumerate(texts)], SCHEMA)
    row = packed.choices([packed.cells(df, "t", "id", "text")]).first()
    assert row.n_open > 250 and row.n_joined == 0


def test_long_and_empty(spark):
    assert unpack(spark, []) == []
    assert unpack(spark, ["|".join(f"v{i}" for i in range(50_000))])[0][-1] == "v49999"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet='ab ,;|•"“”\t\n', max_size=12), max_size=6))
def test_quoted_values_come_back(values):
    values = [v.strip(packed._TRIM) for v in values]
    values = [v for v in values if v]
    text = "; ".join('"' + v.replace('"', '""') + '"' for v in values)
    assert [q for _, _, q in packed.lex(text)] == values


def test_posteriors_sum_to_one():
    key = lambda v: packed._key(0, v)
    lexicon = packed.Lexicon({key("a,b"): (key("a"), 2), key("b,c"): (key("b"), 2)})
    model = packed.Model({key("a"): 3.0, key("a,b"): 2.0, key("b,c"): 1.0}, {0: 50}, {})
    edges = lexicon.edges(0, ["a", "b", "c"], [",", ","])
    assert [e[:2] for e in edges] == [(0, 2), (1, 3)]
    total = [0.0] * 3
    for i, j, _, p in model.expected(0, ["a", "b", "c"], [",", ","], edges)[1]:
        for k in range(i, j):
            total[k] += p
    assert total == pytest.approx([1, 1, 1])


def test_same_text_in_other_partitions(spark, rows):
    df = spark.createDataFrame([(i, f'"a, {i % 5}"; b', 1, "", "") for i in range(60)], SCHEMA)
    one = rows(packed.unpack([packed.cells(df.coalesce(1), "t", "id", "text")]))
    assert one == rows(packed.unpack([packed.cells(df.repartition(7), "t", "id", "text")]))


@pytest.mark.parametrize("size", [5, 40, 400])
def test_values_of_many_parts(spark, size):
    long = ", ".join(f"part {i}" for i in range(size))
    texts = [f'"{long}"|rope'] * 30 + [f"rope|{long}|winch"] + ["rope, winch"] * 5
    assert unpack(spark, texts)[30] == ["rope", long, "winch"]
