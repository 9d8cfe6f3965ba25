"""Oversized documents cut into pieces at natural boundaries.

Content-defined chunking: a rolling hash over the last WINDOW tokens marks landmarks. From the start of a piece the
first landmark between the least and the greatest size is taken and snapped to the nearest natural boundary there
(paragraph, line or sentence end; if there is none, the last one before; else a clause, a word or a character). Where a piece ends thus depends on
nearby text only, so an edit alters the pieces around it and later pieces fall into step again. The next piece starts
`overlap` tokens before the end of the last.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillweave.llm import tokens

WINDOW = 8
#: Landmarks expected between the least and the greatest size of a piece.
LANDMARKS = 4
#: Most rows of a plan, which is broadcast.
MOST_SOURCES = 100_000

# Natural boundaries in bytes: after a line break; after a sentence's final mark; after a clause; after a word.
_NATURAL = (
    re.compile(rb"\n+|(?:[.!?][\"')\]]*|\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f|\xe2\x80\xa6)(?=\s|$|[\xe3-\xe9])"),
    re.compile(rb"[,;:](?=\s)|\xef\xbc\x8c|\xe3\x80\x81|\xef\xbc\x9b|\xe2\x80\x94"),
    re.compile(rb"\S(?=\s)"),
)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def landmarks(ids: np.ndarray, divisor: int) -> np.ndarray:
    """Token numbers after which the hash of the last WINDOW tokens is 0 modulo `divisor`."""
    with np.errstate(over="ignore"):
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * _ODD
        mixed ^= mixed >> np.uint64(29)
        rolling = np.zeros(len(ids), dtype=np.uint64)
        factor = np.uint64(1)
        for back in range(min(WINDOW, len(ids))):
            rolling[back:] += mixed[: len(ids) - back] * factor
            factor *= np.uint64(0x100000001B3)
        rolling *= _ODD
    hit = (rolling >> np.uint64(20)) % np.uint64(divisor) == 0
    hit[: WINDOW - 1] = False
    return np.flatnonzero(hit) + 1


class Document:
    """Tokens, their byte offsets and the token numbers at which a text may be cut."""

    def __init__(self, text: str, coding):
        encoder, sizes = coding
        self.encode = encoder.encode_ordinary
        self.data = text.encode()
        self.ids = np.array(self.encode(text), dtype=np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(sizes[self.ids])])
        raw = np.frombuffer(self.data + b"\x20", dtype=np.uint8)
        self.whole = np.flatnonzero((raw[self.offsets] & 0xC0) != 0x80)  # cuts between characters
        self._levels: list[np.ndarray | None] = [None] * len(_NATURAL)

    def level(self, k: int) -> np.ndarray:
        """Token numbers at natural boundaries of one level."""
        if self._levels[k] is None:
            ends = np.array([m.end() for m in _NATURAL[k].finditer(self.data)], dtype=np.int64)
            at = np.searchsorted(self.offsets, ends)
            self._levels[k] = np.intersect1d(at[self.offsets[np.minimum(at, len(self.ids))] == ends], self.whole)
        return self._levels[k]

    def text(self, lo: int, hi: int) -> str:
        return self.data[self.offsets[lo] : self.offsets[hi]].decode()

    def cut(self, start: int, least: int, most: int, overlap: int, marks: np.ndarray) -> int:
        """End of the piece that begins at token `start`.

        A better boundary before the least size is taken over a worse one after it, as long as the piece is longer than
        its overlap with the next.
        """
        lo, hi = start + least, start + most
        i = np.searchsorted(marks, lo)
        mark = int(marks[i]) if i < len(marks) and marks[i] <= hi else hi
        for k in range(len(_NATURAL)):
            ends = self.level(k)
            a, b = np.searchsorted(ends, lo), np.searchsorted(ends, hi, side="right")
            if a < b:
                near = ends[a:b]
                return int(near[np.abs(near - mark).argmin()])
            if a and ends[a - 1] > start + overlap:
                return int(ends[a - 1])
        a, b = np.searchsorted(self.whole, start, side="right"), np.searchsorted(self.whole, hi, side="right")
        return int(self.whole[b - 1]) if a < b else int(self.whole[min(a, len(self.whole) - 1)])

    def pieces(self, most: int, overlap: int) -> Iterator[tuple[int, int, int]]:
        """(first token, last token + 1, size of the piece's text in tokens)."""
        n = len(self.ids)
        least = max(overlap + 1, most // 2)
        marks = landmarks(self.ids, max(1, (most - least) // LANDMARKS))
        start = 0
        while True:
            room = most
            while True:
                end = n if n - start <= room else self.cut(start, min(least, room), room, overlap, marks)
                size = len(self.encode(self.text(start, end)))
                # Cut off from its context a text may take other tokens; a piece that grows past the limit is shortened.
                if size <= most or room <= 1:
                    break
                room = max(1, min(room, end - start) - (size - most))
            yield start, end, size
            if end >= n:
                return
            back = int(self.whole[np.searchsorted(self.whole, end - overlap, side="right") - 1])
            start = back if back > start else end


def _cutting(shared):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coding = tokens.encoding(shared.value)
        for batch in batches:
            of, number, sizes, firsts, lasts, texts = [], [], [], [], [], []
            for row, (text, most, overlap) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("text", "most", "overlap")), strict=True)):
                document = Document(text, coding)
                if len(document.ids) <= most:
                    continue
                at = byte = 0
                for k, (lo, hi, size) in enumerate(document.pieces(most, overlap), 1):
                    piece, start = document.text(lo, hi), int(document.offsets[lo])
                    at += len(document.data[byte:start].decode())  # characters before the piece
                    byte = start
                    of.append(row)
                    number.append(k)
                    sizes.append(size)
                    firsts.append(at)
                    lasts.append(at + len(piece))
                    texts.append(piece)
            take = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(take), batch.column("source").take(take), *(pa.array(x, pa.int64()) for x in (number, sizes, firsts, lasts)), pa.array(texts, pa.string())],
                names=["doc_id", "source", "piece", "n_tokens", "start_char", "end_char", "text"],
            )

    return cut


def pieces(documents: DataFrame, plan: DataFrame, *, path: str = tokens.VOCABULARY, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, piece, n_tokens, start_char, end_char, text) of each document of more tokens than its source allows.

    Pieces are exact slices of the text, from its first to its last character; each is the previous one's end less the
    overlap (counted in the document's tokens; up to three more where a token ends inside a character). No piece exceeds
    the limit, but for a single character of more tokens than that. Null, empty and small enough texts give no rows, nor
    do documents whose source the plan lacks; overlaps are kept below half the limit; repeated documents each give their
    pieces; of repeated plan rows the smallest limit holds; empty tables give no rows; texts of any length are cut whole.
    """
    spark = documents.sparkSession
    limits = plan.select(tokens.source_key(F.col("source")).alias("source"), F.greatest(F.col("max_tokens").cast("bigint"), F.lit(1)).alias("most"), F.coalesce(F.col("overlap_tokens").cast("bigint"), F.lit(0)).alias("overlap"))
    limits = limits.where(F.col("source").isNotNull() & F.col("most").isNotNull()).groupBy("source").agg(F.min("most").alias("most"), F.min("overlap").alias("overlap"))
    limits = limits.withColumn("overlap", F.greatest(F.lit(0), F.least("overlap", F.floor((F.col("most") - 1) / 2))).cast("bigint"))
    held = limits.limit(MOST_SOURCES + 1).collect()
    if len(held) > MOST_SOURCES:
        raise ValueError(f"a plan has {MOST_SOURCES} sources at most")
    known = spark.createDataFrame(held, limits.schema)
    rows = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), tokens.source_key(F.col(source)).alias("source"), F.col(text).alias("text"))
    # A token has a byte at least, so shorter texts fit.
    large = rows.join(F.broadcast(known), "source").where(F.octet_length("text") > F.col("most"))
    schema = "doc_id bigint, source string, piece bigint, n_tokens bigint, start_char bigint, end_char bigint, text string"
    return large.select("doc_id", "source", "text", "most", "overlap").mapInArrow(_cutting(tokens.vocabulary(spark, path)), schema)
