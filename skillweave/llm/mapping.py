"""Free-entered values mapped to the entries of a reference list.

Distinct values are normalised and looked up in an inverted index of character n-grams; the entries that share n-grams
come with their weighted cosine, and those near the best one are candidates. Words that stand for a word of the list
(spelling slips, plurals, abbreviations) are then taken for it, and words beside the title are left out: the weighted
cosine of that reading decides. The best candidate is accepted if it reaches a threshold and leads the next by a margin;
an exact check of the words follows (nothing of the title may be missing but one word, and then only one entry may fit).
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillweave.session import materialise

N = 3
#: Least cosine of a candidate, and how far below the best one may lie.
THRESHOLD, WINDOW = 0.35, 0.45
#: Least cosine of an accepted candidate's reading, and its least lead over the next.
ACCEPT, MARGIN = 0.6, 0.005
#: Lead in the quality of the words over another entry of which as many words are missing.
QUALITY = 0.05
#: Typed words whose likenesses are remembered by a worker at once.
REMEMBERED = 200_000
#: Rows above which a value's decision is broadcast; there are at most (rows / HOT_ROWS) such values.
HOT_ROWS = 100_000
#: Entries of the list that one pass carries; longer lists are taken in blocks.
LIST_BLOCK = 20_000

#: Words beside a title that don't change which title is meant (fixed values: grades, shifts, forms of employment).
QUALIFIERS = frozenset(
    "a an and apprentice as assistant at by casual contract day deputy evening experienced first fixed for full grade head in junior jnr "
    "lead level morning new night occupation of on or part permanent principal qualified relief role roster rotating senior shift site snr "
    "sr jr temporary term the time title to trainee weekend with job position i ii iii iv v 1 2 3 4 5".split()
)
#: Marks for "no value" (fixed values).
NO_VALUE = frozenset(["", "n a", "na", "none", "nil", "null", "tba", "tbd", "tbc", "unknown", "not applicable", "not available", "no value", "blank", "nan"])

_WORDS = re.compile(r"[a-z0-9]+")
_HEAD = re.compile(r"\s*[,(;:]|\s[-–—]\s")


def normal(text: str) -> list[str]:
    """Words without case, accents and punctuation; a hyphenated 'co-' is rejoined."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))
    words, out = _WORDS.findall(plain), []
    for w in words:
        if out and out[-1] == "co" and w.startswith("or"):
            out[-1] += w
        else:
            out.append(w)
    return out


def grams(word: str) -> list[str]:
    padded = f"#{word}#"
    return [padded[i : i + N] for i in range(max(1, len(padded) - N + 1))]


def distance(a: str, b: str, most: int) -> int:
    """Edits (with swaps of neighbours) from a to b, or most + 1; only cells within `most` of the diagonal are filled."""
    n, far = len(b), most + 1
    if abs(len(a) - n) > most:
        return far
    before, row = [far] * (n + 1), [j if j <= most else far for j in range(n + 1)]
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [far] * (n + 1)
        if i <= most:
            row[0] = i
        least = row[0]
        for j in range(max(1, i - most), min(n, i + most) + 1):
            y = b[j - 1]
            d = before[j - 1] + (x != y)
            if before[j] < d:
                d = before[j] + 1
            if row[j - 1] < d:
                d = row[j - 1] + 1
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and older[j - 2] + 1 < d:
                d = older[j - 2] + 1
            row[j] = d
            if d < least:
                least = d
        if least > most:
            return far
    return min(row[n], far)


def shortened(short: str, word: str) -> bool:
    """Whether `short` abbreviates `word`: same first letter, its letters in order, clearly shorter."""
    if len(short) < 2 or len(short) >= len(word) or short[0] != word[0]:
        return False
    letters = iter(word)
    return all(c in letters for c in short)


class Lexicon:
    """Words and n-gram counts of a whole reference list, added block by block."""

    def __init__(self):
        self.entries, self.df, self.vocabulary = 0, Counter(), set()

    def add(self, titles: list[str]) -> Lexicon:
        for words in map(normal, titles):
            self.entries += 1
            self.df.update({g for w in words for g in grams(w)})
            self.vocabulary.update(words)
        return self


class Reference:
    """Inverted n-gram index of a reference list, or of a block of it with the lexicon of the whole list."""

    def __init__(self, entries: list[tuple[str, str]], lexicon: Lexicon | None = None):
        lexicon = lexicon or Lexicon().add([t for _, t in entries])
        self.codes = [c for c, _ in entries]
        self.words = [tuple(normal(t)) for _, t in entries]
        self.vocabulary = lexicon.vocabulary
        counts = [Counter(g for w in ws for g in grams(w)) for ws in self.words]
        self.idf = {g: math.log(1 + lexicon.entries / n) for g, n in lexicon.df.items()}
        self.rarest = math.log(1 + lexicon.entries)
        posting: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for i, c in enumerate(counts):
            norm = math.sqrt(sum((n * self.idf[g]) ** 2 for g, n in c.items())) or 1.0
            for g, n in c.items():
                posting[g].append((i, n * self.idf[g] / norm))
        self.weight = {w: math.sqrt(sum((n * self.idf[g]) ** 2 for g, n in Counter(grams(w)).items())) for w in {w for ws in self.words for w in ws}}
        self.sets = [frozenset(ws) for ws in self.words]
        self.norms = [math.sqrt(sum(self.weight[w] ** 2 for w in ws)) or 1.0 for ws in self.words]
        self.posting = {g: (np.array([i for i, _ in p]), np.array([w for _, w in p])) for g, p in posting.items()}
        self.alike: dict[str, dict[str, float]] = {}
        self.near: dict[str, set[str]] = defaultdict(set)
        for w in self.vocabulary:
            for pair in self.pairs(w):
                self.near[pair].add(w)

    @staticmethod
    def pairs(word: str) -> set[str]:
        """Pairs of neighbouring letters, and the first letter; words that resemble each other share one."""
        return {word[:1], *(word[i : i + 2] for i in range(len(word) - 1)), word[-1:] + "#"}

    def cosines(self, words: list[str]) -> np.ndarray:
        counts = Counter(g for w in words for g in grams(w))
        score, norm = np.zeros(len(self.codes)), 0.0
        for g, n in counts.items():
            w = n * self.idf.get(g, self.rarest)
            norm += w * w
            if g in self.posting:
                at, weight = self.posting[g]
                score[at] += w * weight
        return score / math.sqrt(norm or 1.0)

    def resembles(self, word: str) -> dict[str, float]:
        """Words of the list that `word` may stand for, with a quality."""
        found = self.alike.get(word)
        if found is None:
            found = {}
            if word in self.vocabulary:
                found[word] = 1.0
            elif word.endswith("s") and word[:-1] in self.vocabulary:
                found[word[:-1]] = 1.0
            elif not word.isdigit():
                own = self.pairs(word)
                shared = Counter(w for p in own for w in self.near.get(p, ()))
                for w, n in sorted(shared.items()):
                    most = 2 if len(w) >= 5 else 1 if len(w) >= 4 else 0
                    # An edit touches three of the pairs at most, a plural two.
                    close = most and n >= len(own) - 3 * most - 2 and -most <= len(word) - len(w) <= most + 1
                    d = min(distance(word, w, most), distance(word, w + "s", most)) if close else 9
                    if d <= most:
                        found[w] = 1 - 0.1 * d
                    elif shortened(word, w):
                        found[w] = 0.75 if w.startswith(word) else 0.65
            if len(self.alike) >= REMEMBERED:
                self.alike.clear()
            self.alike[word] = found
        return found

    def apart(self, words: list[str]) -> list[str]:
        """Words with run-together ones (a space lost or mistyped) taken apart where both halves are in the list."""
        out = []
        for w in words:
            if len(w) >= 8 and not self.resembles(w):
                cuts = [(i, j) for i in range(3, len(w) - 2) for j in (i, i + 1) if len(w) - j >= 3]
                fits = lambda x: max(self.resembles(x).values(), default=0.0) if len(x) >= 4 else 0.0
                score, i, j = max(((fits(w[:i]) + fits(w[j:]) - 0.01 * (j - i), i, j) if fits(w[:i]) >= 0.8 and fits(w[j:]) >= 0.8 else (0.0, 0, 0)) for i, j in cuts)
                if score:
                    out += [w[:i], w[j:]]
                    continue
            out.append(w)
        return out

    def check(self, words: list[str], entry: int) -> tuple[int, float, int, float]:
        """(entry words found, their quality, words that neither stand in the entry nor qualify it, cosine of the reading).

        In the reading a word that stands for one of the entry's counts as that, by its quality; one that stands for
        another word of the list counts against it; words that stand for none are beside the title.
        """
        left, found, quality = list(self.words[entry]), 0, 0.0
        extra, dot, norm = 0, 0.0, 0.0
        for w in words:
            alike = self.resembles(w)
            best = max((e for e in left if e in alike), key=lambda e: alike[e], default=None)
            if best is not None:
                left.remove(best)
                found += 1
                quality += alike[best]
                dot += alike[best] * self.weight[best] ** 2
                norm += self.weight[best] ** 2
            elif w not in QUALIFIERS:
                extra += 1
        return found, quality, extra, dot / (math.sqrt(norm or 1.0) * self.norms[entry])

    def scores(self, text: str) -> list[tuple[list[str], np.ndarray]]:
        """(words, cosines) of the whole text and of what stands before its first break."""
        words = self.apart(normal(text))
        head = self.apart(normal(_HEAD.split(text.strip(), maxsplit=1)[0]))
        out = []
        for tried in (words, [] if head == words else head):
            out.append((tried, self.cosines([w for w in tried if w not in QUALIFIERS or w in self.vocabulary]) if tried else np.zeros(0)))
        return out

    def tops(self, text: str) -> tuple[float, float]:
        """The highest cosine of the whole text and of its head."""
        whole, head = (float(score.max()) if len(score) else 0.0 for _, score in self.scores(text))
        return whole, head

    def best(self, text: str, tops: tuple[float, float] | None = None) -> list[tuple[int, float, float, str]]:
        """Up to two (entry words missing, quality, cosine, code), of highest cosine first; `tops` are those of the whole list, if this is a block."""
        ranked: dict[str, tuple[float, int, float]] = {}
        for n, (tried, score) in enumerate(self.scores(text)):
            if not len(score) or score.max() < THRESHOLD:
                continue
            top = tops[n] if tops else score.max()
            stands_for = set().union(*map(self.resembles, tried))
            for i in np.flatnonzero(score >= max(THRESHOLD, top - WINDOW)).tolist():
                size = len(self.words[i])
                if len(self.sets[i] & stands_for) < min(len(self.sets[i]), max(2, size) - 1):
                    continue  # too many words missing for the check
                found, quality, extra, cosine = self.check(tried, i)
                if cosine >= ACCEPT and (found == size or (found >= 2 and found == size - 1 and not extra)):
                    rank = (-cosine, size - found, -quality)
                    if rank < ranked.get(self.codes[i], (9.0, 0, 0.0)):
                        ranked[self.codes[i]] = rank
        return [(m, -q, -x, c) for c, (x, m, q) in sorted(ranked.items(), key=lambda x: (x[1], x[0]))[:2]]


def _mapping(shared):
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reference: Reference = shared.value
        for batch in batches:
            given = batch.column("tops").to_pylist() if "tops" in batch.schema.names else [None] * batch.num_rows
            found = [(v, *hit) for v, tops in zip(batch.column("value").to_pylist(), given, strict=True) for hit in reference.best(v, tops)]
            columns = list(zip(*found, strict=True)) or [()] * 5
            kinds = (pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["value", "missing", "quality", "cosine", "code"])

    return look


def _topping(shared):
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reference: Reference = shared.value
        for batch in batches:
            found = [reference.tops(v) for v in batch.column("value").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("value"), *(pa.array([t[n] for t in found], pa.float64()) for n in (0, 1))], names=["value", "whole", "head"])

    return look


def is_entry(value) -> F.Column:
    """Whether a text holds an entry: not null, blank or a mark for no value."""
    plain = F.trim(F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}]+", " "))
    return value.isNotNull() & ~plain.isin(*NO_VALUE)


def map_values(rows: DataFrame, reference: DataFrame, *, row_id: str, value: str, code: str, title: str) -> DataFrame:
    """(row_id, value, code) of every row that holds an entry; code is '' where the list holds nothing like it.

    Rows are joined to the decisions on their distinct values, so a value that a third of the rows share is matched once.
    The reference list is sent to the executors in blocks of LIST_BLOCK entries. Weights, vocabulary and the highest
    cosine of a value are those of the whole list, so the blocks don't change what is found; the best of all counts.
    Null, blank and no-value rows give no row; entries without title are ignored; two entries of equal fit are a tie,
    which is no match; repeated rows each give one; texts of any length are used whole; an empty list matches nothing.
    """
    spark = rows.sparkSession
    held = rows.select(F.col(row_id).alias("row_id"), F.col(value).alias("value")).where(is_entry(F.col("value")))
    # Matching is the costly part, so the distinct values are dealt out evenly again.
    values = held.select("value").distinct().repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    entries = reference.where(F.col(title).isNotNull() & F.col(code).isNotNull()).select(F.col(code).cast("string").alias("c"), F.col(title).alias("t"))
    blocks = max(1, -(-entries.count() // LIST_BLOCK))
    lexicon, held_blocks = Lexicon(), []
    block_of = lambda b: [(r.c, r.t) for r in entries.where(F.pmod(F.xxhash64("c", "t"), F.lit(blocks)) == b).orderBy("c", "t").collect()]
    if blocks > 1:
        for b in range(blocks):
            lexicon.add([t for _, t in block_of(b)])
    for b in range(blocks):
        held_blocks.append(spark.sparkContext.broadcast(Reference(block_of(b), lexicon if blocks > 1 else None)))
    if blocks > 1:  # which candidates lie near enough to the best one depends on all blocks
        tops = reduce(DataFrame.unionByName, [values.mapInArrow(_topping(shared), "value string, whole double, head double") for shared in held_blocks])
        values = materialise(tops.groupBy("value").agg(F.array(F.max("whole"), F.max("head")).alias("tops")), "tops")
    hits = reduce(DataFrame.unionByName, [values.mapInArrow(_mapping(shared), "value string, missing bigint, quality double, cosine double, code string") for shared in held_blocks])
    # At most two rows a value and block meet here.
    ranked = hits.groupBy("value").agg(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("far"), "missing", "quality", "code"))).alias("hits"))
    one = F.element_at("hits", 1)
    two = F.try_element_at(F.filter("hits", lambda h: h["code"] != one["code"]), F.lit(1))  # titles of one code may lie in several blocks
    leads = two["far"] - one["far"] >= MARGIN
    checked = (two["missing"] > one["missing"]) | ((two["missing"] == one["missing"]) & (one["quality"] - two["quality"] >= QUALITY))
    clear = two.isNull() | (leads & checked)
    decided = materialise(ranked.select("value", F.when(clear, one["code"]).otherwise("").alias("code")), "decided")
    # A value that very many rows share would meet its decision in one task; the few such decisions are broadcast.
    hot = materialise(held.groupBy("value").count().where(F.col("count") > HOT_ROWS).select("value"), "hot")
    few = F.broadcast(hot.join(decided, "value", "left"))
    rest = held.join(F.broadcast(hot), "value", "left_anti").join(decided, "value", "left")
    return held.join(few, "value").unionByName(rest).select("row_id", "value", F.coalesce("code", F.lit("")).alias("code"))
