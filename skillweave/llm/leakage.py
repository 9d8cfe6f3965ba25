"""Test items that stand, whole or in good part, in corpus documents.

Wu-Manber multi-pattern search over words: the patterns are the items' runs of RUN = 3 consecutive words, a block is two
neighbouring words, so a window moves by two words at most. The shift table has 0 for blocks that end a pattern, 1 for
those that begin one and 2 for all others. A batch of documents is searched at once (numpy): every second block is looked
up. With shift 2 neither window over it can be a pattern, so both are skipped unread, with the block between it and the
next; with 0 or 1 the window that ends or begins there falls into a bucket by its block, and the bucket's patterns are
compared word by word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN = 3
#: Items, and their characters, carried by one pass over the corpus; more items take more passes.
ITEM_BLOCK, ITEM_CHARS = 20_000, 50_000_000
#: Characters that are searched at once; bounds memory, not texts.
_CHARS = 4_000_000

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters and digits."""
    return _WORD.findall(text.lower())


class Patterns:
    """Search tables for a block of items."""

    def __init__(self, items: list[tuple[int, str]], share: float):
        self.share = share
        self.vocabulary: dict[str, int] = {}
        number = self.vocabulary.setdefault
        runs: dict[tuple[int, ...], int] = {}
        pairs: list[tuple[int, int]] = []
        for k, (_, text) in enumerate(items):
            ids = [number(w, len(self.vocabulary)) for w in words_of(text)]
            for t in set(zip(*(ids[i:] for i in range(RUN)), strict=False)):
                pairs.append((runs.setdefault(t, len(runs)), k))
        self.items = np.array([i for i, _ in items], dtype=np.int64)
        self.runs = np.array(list(runs), dtype=np.int64).reshape(-1, RUN)
        size = len(self.vocabulary) + 1  # the last number is that of all other words
        # The shift table; blocks in neither place have the most, RUN - 1. A block may both end and begin patterns.
        code = lambda a, b: a * size + b
        self.size, tail, head = size, code(self.runs[:, 1], self.runs[:, 2]), code(self.runs[:, 0], self.runs[:, 1])
        self.blocks = np.unique(np.concatenate([tail, head]))
        self.ends, self.begins = np.isin(self.blocks, tail), np.isin(self.blocks, head)
        # Suffix buckets: patterns ordered by block, then by first word; the full code (at most patterns * words) confirms.
        full = np.searchsorted(self.blocks, tail) * size + self.runs[:, 0]
        order = np.argsort(full)
        self.full, self.run_of = full[order], order
        run, item = (np.array(x, dtype=np.int64) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 2
        by_run = np.argsort(run, kind="stable")
        self.item_of, counts = item[by_run], np.bincount(run, minlength=len(self.runs))
        self.item_at = np.concatenate([[0], np.cumsum(counts)])
        self.need = np.bincount(item, minlength=len(items))
        # A document that holds its share of an item holds one of these rarest runs: others don't start a candidate.
        self.starts = np.zeros(len(item), dtype=bool)
        rarity = np.lexsort((counts[run], item))
        place = np.arange(len(item)) - np.concatenate([[0], np.cumsum(self.need)])[item[rarity]]
        chosen = rarity[place <= (self.need - np.ceil(share * self.need - 1e-9).astype(np.int64))[item[rarity]]]
        flag = np.zeros(len(item), dtype=bool)
        flag[chosen] = True
        self.starts = flag[by_run]

    def windows(self, flat: np.ndarray) -> np.ndarray:
        """Starts of the windows that the shift table doesn't skip and whose last two words end a pattern."""
        looked = np.arange(0, len(flat) - 1, RUN - 1)
        known = (flat[looked] != self.size - 1) & (flat[looked + 1] != self.size - 1)
        looked, block = looked[known], (flat[looked] * self.size + flat[looked + 1])[known]
        at = np.searchsorted(self.blocks, block)
        at[at == len(self.blocks)] = 0
        listed = self.blocks[at] == block
        ending, beginning = looked[listed & self.ends[at]] - 1, looked[listed & self.begins[at]]
        beginning = beginning[beginning + RUN <= len(flat)]
        # A window that begins with a listed block must still end with one.
        block = flat[beginning + 1] * self.size + flat[beginning + 2]
        at = np.searchsorted(self.blocks, block)
        at[at == len(self.blocks)] = 0
        beginning = beginning[(self.blocks[at] == block) & self.ends[at] & (flat[beginning + 2] != self.size - 1)]
        return np.concatenate([ending[ending >= 0], beginning])

    def search(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text number, item number, runs held) of items held to their share at least."""
        get, other = self.vocabulary.get, self.size - 1
        ids = [np.fromiter((get(w, other) for w in words_of(t)), dtype=np.int64) for t in texts]
        lengths = np.array([len(x) for x in ids])
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        none = (np.zeros(0, np.int64),) * 3
        if len(flat) < RUN or not len(self.full):
            return none
        doc = np.repeat(np.arange(len(texts)), lengths)
        windows = self.windows(flat)
        windows = windows[doc[windows] == doc[windows + RUN - 1]]
        full = np.searchsorted(self.blocks, flat[windows + 1] * self.size + flat[windows + 2]) * self.size + flat[windows]
        at = np.searchsorted(self.full, full)
        at[at == len(self.full)] = 0
        hit = self.full[at] == full
        run, where = self.run_of[at[hit]], doc[windows[hit]]
        seen = np.unique(where * len(self.runs) + run)
        where, run = np.divmod(seen, len(self.runs))
        begin, width = self.item_at[run], np.diff(self.item_at)[run]
        entry = np.repeat(begin - np.concatenate([[0], np.cumsum(width)[:-1]]), width) + np.arange(width.sum())
        key = np.repeat(where, width) * len(self.items) + self.item_of[entry]
        keys, held = np.unique(key[np.isin(key, np.unique(key[self.starts[entry]]))], return_counts=True)
        text, item = np.divmod(keys, len(self.items))
        ok = held >= self.share * self.need[item] - 1e-9
        return text[ok], item[ok], held[ok]


def _searching(shared):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns: Patterns = shared.value
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            lo = 0
            while lo < len(texts):
                hi, chars = lo, 0
                while hi < len(texts) and (hi == lo or chars + len(texts[hi]) <= _CHARS):
                    chars += len(texts[hi])
                    hi += 1
                text, item, held = patterns.search(texts[lo:hi])
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(text + lo)), pa.array(patterns.items[item]), pa.array(held / patterns.need[item])], names=["doc_id", "item_id", "share"]
                )
                lo = hi

    return search


def leaked(documents: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", share: float = 0.5) -> DataFrame:
    """(doc_id, item_id, share) of the documents that hold at least `share` of an item's distinct word runs.

    Items are sent to the executors in blocks of ITEM_BLOCK or ITEM_CHARS characters; each block is one pass over the
    documents. Null and empty texts hold nothing; items of fewer than RUN words have no run and leak
    nowhere; repeated documents each report their items, equal items under other ids each count; texts of any length
    are searched whole; empty tables give no rows; other columns are not looked at.
    """
    spark = documents.sparkSession
    wanted = items.select(F.col(item_id).cast("bigint").alias("i"), F.col(item_text).alias("t")).where(F.col("t").isNotNull())
    corpus = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where(F.length("text") > 0)
    size = wanted.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("chars")).first()
    blocks = max(1, -(-size["n"] // ITEM_BLOCK), -(-size["chars"] // ITEM_CHARS))
    parts = []
    for b in range(blocks):
        rows = wanted.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).collect()
        shared = spark.sparkContext.broadcast(Patterns([(r.i, r.t) for r in rows], share))
        parts.append(corpus.mapInArrow(_searching(shared), "doc_id bigint, item_id bigint, share double"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found
