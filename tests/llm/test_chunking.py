import random
from pathlib import Path

import pytest

from skillweave.llm import chunking, tokens

pytestmark = pytest.mark.skipif(not Path(tokens.VOCABULARY).exists(), reason="no vocabulary file")
DOCS = "doc_id long, text string, source string, piece int, n_tokens int"


def run(spark, docs, plan=((" A ", 40, 6),)):
    d = spark.createDataFrame([(i, t, s, 0, 0) for i, t, s in docs], DOCS)
    p = spark.createDataFrame(list(plan), "source string, max_tokens int, overlap_tokens int")
    out = {}
    for r in sorted(chunking.pieces(d, p).collect(), key=lambda r: (r.doc_id, r.piece)):
        out.setdefault(r.doc_id, []).append(r)
    return out


def whole(pieces):
    text = ""
    for p in pieces:
        assert p.start_char <= len(text) and p.end_char - p.start_char == len(p.text)
        text = text[: p.start_char] + p.text
    return text


def prose(seed, n=60):
    rng = random.Random(seed)
    return "".join(" ".join(rng.choices(["rope", "winch", "cleat", "the", "of", "harbour", "keel"], k=rng.randrange(4, 14))).capitalize() + rng.choice([". ", ".\n", "? ", ".\n\n"]) for _ in range(n))


def test_round_trip_limit_overlap_boundaries(spark):
    docs = [(i, prose(i), "a") for i in range(20)]
    encode = tokens.encoding(Path(tokens.VOCABULARY).read_bytes())[0].encode_ordinary
    found = run(spark, docs)
    for i, text, _ in docs:
        pieces = found[i]
        assert whole(pieces) == text and [p.piece for p in pieces] == list(range(1, len(pieces) + 1))
        assert all(p.n_tokens == len(encode(p.text)) <= 40 for p in pieces)
        assert all(p.text.rstrip()[-1] in ".?" for p in pieces)
        for p, q in zip(pieces, pieces[1:], strict=False):
            assert len(encode(text[q.start_char : p.end_char])) == pytest.approx(6, abs=2)


def test_edit_alters_neighbours_only(spark):
    text = prose(99, 300)
    at = text.index(". ", len(text) // 3) + 2
    found = run(spark, [(1, text, "a"), (2, text[:at] + "An inserted sentence here. " + text[at:], "a")])
    before, after = ({p.text for p in found[i]} for i in (1, 2))
    assert len(after - before) <= 4 < len(before) // 4


def test_texts_without_boundaries(spark):
    docs = [(1, "x" * 3000, "a"), (2, "清洗过滤器和水箱" * 200, "a"), (3, "🙂" * 300, "a"), (4, "\n" * 900, "a"), (5, "á" * 500, "a"), (6, "%$#@!^&*()" * 100, "a")]
    found = run(spark, docs)
    for i, text, _ in docs:
        if i in found:
            assert whole(found[i]) == text and all(p.n_tokens <= 40 for p in found[i])
    assert {1, 2, 3, 6} <= set(found)


def test_small_null_and_unknown(spark):
    assert run(spark, [(1, None, "a"), (2, "", "a"), (3, "short", "a"), (4, prose(1), None), (5, prose(1), "zz")]) == {}
    assert run(spark, []) == {} and run(spark, [(1, prose(1), "a")], []) == {}


def test_repeated_documents_and_plan_rows(spark):
    found = run(spark, [(1, prose(1), "a"), (1, prose(1), "a")], [("a", 40, 6), ("A", 90, 6), ("a", None, None), (None, 5, 1)])
    assert len(found[1]) % 2 == 0 and max(p.n_tokens for p in found[1]) <= 40


def test_overlap_of_nothing_and_too_large(spark):
    assert whole(run(spark, [(1, prose(3), "a")], [("a", 30, 0)])[1]) == prose(3)
    assert whole(run(spark, [(1, prose(3), "a")], [("a", 30, 500)])[1]) == prose(3)
    assert whole(run(spark, [(1, "one two three", "a")], [("a", 1, 1)])[1]) == "one two three"


def test_long_text(spark):
    text = prose(5, 20_000)
    assert whole(run(spark, [(1, text, "a")], [("a", 512, 48)])[1]) == text
