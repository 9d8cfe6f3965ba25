import random
import re

import numpy as np

from skillweave.llm import leakage

DOCS = "doc_id long, text string, item_id long, share double"
ITEMS = "item_id long, text string, doc_id long"


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def runs(t):
    w = words(t)
    return set(zip(w, w[1:], w[2:], strict=False))


def brute(docs, items, share):
    out = []
    for d, text in docs:
        held = runs(text)
        for i, q in items:
            want = runs(q)
            if want and len(want & held) >= share * len(want) - 1e-9:
                out.append((d, i))
    return sorted(out)


def run(spark, docs, items, share=0.5):
    d = spark.createDataFrame([(i, t, 0, 0.0) for i, t in docs], DOCS)
    q = spark.createDataFrame([(i, t, 0) for i, t in items], ITEMS)
    return sorted((r.doc_id, r.item_id) for r in leakage.leaked(d, q, share=share).collect())


def make(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 25)))) for i in range(40)]
    docs = []
    for d in range(120):
        text = rng.choices(vocabulary + ["Other", "WORDS"], k=rng.randrange(0, 60))
        if rng.random() < 0.6:
            q = rng.choice(items)[1].split()
            cut = q[: rng.randrange(len(q) + 1)]
            text[5:5] = cut
        docs.append((d, " , ".join(text) if d % 2 else "\n".join(text).upper()))
    return docs, items


def test_against_sets(spark):
    for seed, share in ((1, 0.5), (2, 0.5), (3, 0.8), (4, 1.0), (5, 0.2)):
        docs, items = make(seed)
        assert run(spark, docs, items, share) == brute(docs, items, share)


def test_blocks_of_items(spark, monkeypatch):
    docs, items = make(6)
    monkeypatch.setattr(leakage, "ITEM_BLOCK", 7)
    assert run(spark, docs, items) == brute(docs, items, 0.5)


def test_nulls_repeats_and_short(spark):
    docs = [(1, "a b c d"), (1, "a b c d"), (2, None), (3, ""), (4, "A-b_c!d"), (5, "a b")]
    items = [(1, "a b c"), (2, "a b c"), (3, "a b"), (4, None), (5, "")]
    assert run(spark, docs, items) == brute(docs, items, 0.5) == [(1, 1), (1, 1), (1, 2), (1, 2), (4, 1), (4, 2)]


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b c")]) == [] and run(spark, [(1, "a b c")], []) == []


def test_long_text(spark):
    assert run(spark, [(1, "x y " * 600_000 + "alpha beta gamma delta")], [(9, "alpha beta gamma delta")]) == [(1, 9)]


def test_windows_are_skipped():
    """Only windows with a listed block at an even place are read; the others can't be patterns."""
    patterns = leakage.Patterns([(1, "a b c"), (2, "b c d e")], 0.5)
    number = patterns.vocabulary
    flat = np.array([number.get(w, patterns.size - 1) for w in "x a b c y b z c d e a b".split()])
    assert sorted(patterns.windows(flat).tolist()) == [1, 7]
    assert patterns.windows(np.full(10_000, patterns.size - 1)).size == 0


def test_large_vocabularies_do_not_overflow():
    """Codes of patterns stay below patterns * words, whose cube would not fit 64 bits."""
    items = [(k, " ".join(f"u{k}x{i}" for i in range(300))) for k in range(8_000)]
    patterns = leakage.Patterns(items, 0.5)
    assert patterns.size > 2_097_152
    text, item, held = patterns.search(["noise " + items[7_999][1], items[0][1][:900], "u1x0 u2x1 u3x2"])
    assert text.tolist() == [0] and item.tolist() == [7_999] and held.tolist() == [298]
