"""Groups of records that share most of their words.

A record's fingerprint is the set of its distinct words, each hashed to 64 bits. Two fingerprints of sizes a and b with
a Jaccard similarity of at least t differ in at most D = (1-t)/(1+t) * (a+b) words (their Hamming distance).

1. Blocks. Words are dealt to D+1 segments; two records within D must agree in one segment entirely, so records that
   agree in a segment are the only pairs to look at. Segments are balanced by how much the words tell apart, and made
   per size class, as D depends on the sizes. No pair is lost.
2. Pivot distance table. The Hamming distances of every record to PIVOTS reference fingerprints are computed once; they
   go with the record into its blocks. By the triangle inequality |d(x,p) - d(y,p)| <= d(x,y), so a pair whose
   coordinates differ by more than its D anywhere is discarded. No pair is lost. A reference fingerprint joins the words
   of several records, as distances to larger sets spread more than those to single records.
3. Survivors are verified on their words.

Many records (over WIDE) make such blocks large. Then half as many segments are dealt and one of them is allowed a single
difference: a record also enters the blocks of its segments with one word left out, and is compared there with the
records that have the segment as it is. That takes some 150 block rows a record instead of 33, but blocks shrink with the
square of their former share, and again no pair is lost.

A block that a sample shows to have over `hot` records (many records lack the words of a segment, or share boilerplate)
is divided before the shuffle, if the sample shows that this leaves fewer pairs: its records are dealt to segments of
another deal of the words, as a pair within D must agree in one of those too. Which blocks the sample finds changes the
load, not the pairs. Any block that is over `hot` where it meets is compared in tiles of some `hot` by `hot` records.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillweave.operators.clusters import components
from skillweave.session import materialise

#: Reference fingerprints besides the empty set, each of MERGED records; chosen from CANDIDATES so that the distances of
#: DRAWN records (those with the smallest hashes, a bounded sample) spread most.
PIVOTS, MERGED, CANDIDATES, DRAWN = 24, 6, 128, 2_000
THRESHOLD = (4, 5)
#: Words in at least this share of the records are weighed; there are at most (mean words a record) / share of them.
FREQUENT = 0.001
HOT = 3_000
#: Records in the sample that finds hot blocks before the shuffle, and how often a block must show up there.
SAMPLE, SEEN = 50_000, 20
#: Keys that are broadcast to pick the words of the survivors; beyond it the join shuffles.
BROADCAST_KEYS = 2_000_000
#: Records above which segments may differ in one word.
WIDE = 3_000_000
#: Records a part of the block shuffle.
PART_RECORDS = 10_000
#: Pairs compared at once.
_CHUNK = 1_000_000


def word_set(*columns: Column) -> Column:
    """Sorted distinct word hashes of several text fields; null is empty. Words are lower-cased runs of letters."""
    text = F.lower(F.concat_ws(" ", *columns))
    words = F.array_remove(F.split(F.regexp_replace(text, r"[^\p{L}]+", " "), " "), "")
    return F.sort_array(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))))


LOWER, LESS = 1, 2


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit mixing function (splitmix64), so that deals with different salts are independent."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15) % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


class Scheme:
    """Deals of the words to segments for every size class, and the pivots."""

    def __init__(self, frequent: list[tuple[int, float]], pivots: list[list[int]], t: tuple[int, int], slack: int = 0):
        self.t, self.slack = t, slack
        self.words = np.array(sorted(w for w, _ in frequent), dtype=np.int64)
        share = dict(frequent)
        p = np.array([share[w] for w in self.words.tolist()])
        self.weight = -np.log2(np.maximum(p**2 + (1 - p) ** 2, 1e-12)) if len(p) else np.zeros(0)
        self.pivots = np.unique(np.concatenate([np.array(x, dtype=np.int64) for x in pivots])) if pivots else np.zeros(0, np.int64)
        self.in_pivot = np.array([np.isin(self.pivots, x) for x in pivots], dtype=np.int8).T.reshape(len(self.pivots), len(pivots))
        self.deals: dict[tuple[int, int], np.ndarray] = {}
        self.hot = np.zeros(0, dtype=np.uint64)  # signatures of blocks that are divided before the shuffle, sorted

    def distance(self, size):
        """Most words in which two records of summed size `size` may differ."""
        up, down = self.t
        return (down - up) * size // (down + up)

    def edges(self) -> np.ndarray:
        """Lower bounds of the size classes: each 1/t times the one before, so partners are in the same or the next."""
        up, down = self.t
        out = [1]
        while out[-1] < 2**31:
            out.append(max(out[-1] + 1, out[-1] * down // up))
        return np.array(out)

    def segment(self, words: np.ndarray, n: int, salt: int) -> np.ndarray:
        """The segment (of n) of each word: frequent words by a balanced deal, others by hash."""
        by_hash = (_mix(words, 2 * salt + 1) % np.uint64(n)).astype(np.int64)
        if not len(self.words):
            return by_hash
        if (n, salt) not in self.deals:
            deal, load = np.zeros(len(self.words), dtype=np.int64), np.zeros(n)
            turn = np.argsort(-self.weight * (1 + 0.05 * (_mix(self.words, 50 + salt) % np.uint64(64)).astype(float) / 64), kind="stable")
            for w in turn.tolist():
                j = int(load.argmin())
                deal[w] = j
                load[j] += self.weight[w]
            self.deals[n, salt] = deal
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, self.deals[n, salt][at], by_hash)

    def coordinates(self, words: np.ndarray, record: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The pivot table, one row a record: its size, and the words it shares with each pivot.

        The distance to a pivot p is size + |p| - 2 * shared, so `distances` of two records differ as the distances do.
        """
        out = np.zeros((len(sizes), 1 + self.in_pivot.shape[1]), dtype=np.int32)
        out[:, 0] = sizes
        if len(self.pivots):
            at = np.minimum(np.searchsorted(self.pivots, words), len(self.pivots) - 1)
            member = np.flatnonzero(self.pivots[at] == words)
            row = record[member]
            starts = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
            for lo in range(0, len(starts), 5_000):  # bounds the table of words by pivots
                some = starts[lo : lo + 5_000]
                end = starts[lo + 5_000] if lo + 5_000 < len(starts) else len(row)
                out[row[some], 1:] = np.add.reduceat(self.in_pivot[at[member[some[0] : end]]], some - some[0], axis=0, dtype=np.int32)
        return out

    @staticmethod
    def distances(at: np.ndarray) -> list[np.ndarray]:
        """Columns of a pivot table: the distance to the empty set, and those to each pivot less the pivot's size."""
        size = np.ascontiguousarray(at[:, 0], dtype=np.int32)
        return [size, *(size - 2 * at[:, k].astype(np.int32) for k in range(1, at.shape[1]))]

    def signatures(self, words: np.ndarray, record: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(record, signature, mark): the segments in which a partner may agree, for a record's class and the next.

        Marks add LOWER for a record below the class (two such records meet in their own class, so not here) and LESS for
        a segment with a word left out (two such rows differ by two words, so they needn't meet). Rows of `hot`
        signatures come divided: one for each segment of the next deal instead.
        """
        rows, sigs, marks = [], [], []
        for mine, lower, given in self._classes(words, record, sizes):
            row, sig, less = self._segments(*given, salt=0, slack=self.slack)
            hot = self._among(self.hot, sig)
            if hot.any():
                at, second, joined = self._divided(row[hot], sig[hot], self._segments(*given, salt=1, slack=0))
                row, sig, less = np.append(row[~hot], row[hot][at]), np.append(sig[~hot], joined), np.append(less[~hot], np.zeros(len(at), dtype=bool))
            rows.append(mine[row])
            sigs.append(sig)
            marks.append(np.where(lower[row], LOWER, 0) + np.where(less, LESS, 0))
        return np.concatenate(rows), np.concatenate(sigs), np.concatenate(marks).astype(np.uint8)

    def divisions(self, words: np.ndarray, record: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hot signature, signature after its division) of the rows of hot blocks."""
        whole, parts = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for _, _, given in self._classes(words, record, sizes):
            row, sig, _ = self._segments(*given, salt=0, slack=self.slack)
            hot = self._among(self.hot, sig)
            if hot.any():
                at, _, joined = self._divided(row[hot], sig[hot], self._segments(*given, salt=1, slack=0))
                whole.append(sig[hot][at])
                parts.append(joined)
        return np.concatenate(whole), np.concatenate(parts)

    def _classes(self, words: np.ndarray, record: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, tuple]]:
        """(records, whether they are below the class, what `_segments` takes) of each size class in which records meet."""
        edges = self.edges()
        own = np.searchsorted(edges, sizes, side="right") - 1
        for c in np.unique(np.concatenate([own, own + 1])).tolist():
            mine = np.flatnonzero((own == c) | (own == c - 1))
            here = np.full(len(sizes), -1, dtype=np.int64)
            here[mine] = np.arange(len(mine))
            take = here[record] >= 0
            yield mine, own[mine] < c, (words[take], here[record[take]], sizes[mine], int(edges[c + 1]) - 1, c)

    @staticmethod
    def _among(few: np.ndarray, sig: np.ndarray) -> np.ndarray:
        """Which signatures are among a few sorted ones."""
        return few[np.minimum(np.searchsorted(few, sig), len(few) - 1)] == sig if len(few) else np.zeros(len(sig), dtype=bool)

    @staticmethod
    def _divided(row: np.ndarray, sig: np.ndarray, again: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the row, number of the second row, joint signature): each row with every segment of another deal."""
        order = np.argsort(again[0], kind="stable")
        begin = np.searchsorted(again[0][order], row)
        width = np.searchsorted(again[0][order], row, side="right") - begin
        at = np.repeat(np.arange(len(row)), width)
        second = order[np.repeat(begin - np.cumsum(width) + width, width) + np.arange(width.sum())]
        return at, second, _mix(sig[at] ^ _mix(again[1][second], 41), 43)

    def _segments(self, w: np.ndarray, r: np.ndarray, sizes: np.ndarray, top: int, c: int, *, salt: int, slack: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, signature, whether a word is left out) of the records that meet in class c, whose largest size is `top`."""
        share = 1 + slack  # differences that uses up a segment
        n = -(-(int(self.distance(2 * top)) + 1) // share)
        # A record needs no more segments than its own farthest partner asks for.
        partner = np.minimum(sizes * self.t[1] // self.t[0], top)
        emit = np.minimum(-(-(self.distance(sizes + partner) + 1) // share), n)
        seg = self.segment(w, n, salt)
        key = r * n + seg
        order = np.argsort(key, kind="stable")
        total = np.zeros(len(sizes) * n, dtype=np.uint64)
        uniq, first = np.unique(key[order], return_index=True)
        code = _mix(w, 99)
        if len(uniq):
            total[uniq] = np.add.reduceat(code[order], first)
        place = _mix(np.arange(n) + 1000 * c + 10_000_000 * salt, 5)
        wanted = np.tile(np.arange(n), len(sizes)) < np.repeat(emit, n)
        rows, sigs = np.repeat(np.arange(len(sizes)), n)[wanted], _mix(total + np.tile(place, len(sizes)), 7)[wanted]
        less = np.zeros(len(rows), dtype=bool)
        if slack:
            used = seg < emit[r]
            rows = np.concatenate([rows, r[used]])
            sigs = np.concatenate([sigs, _mix(total[key[used]] - code[used] + place[seg[used]], 7)])
            less = np.append(less, np.ones(int(used.sum()), dtype=bool))
        return rows, sigs, less


def _flat(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(lists.offsets.to_numpy())
    return lists.flatten().to_numpy(), np.repeat(np.arange(len(sizes)), sizes), sizes.astype(np.int64)


class Block:
    """Rows of blocks: signatures, record keys, marks and distances to the pivots (the first is the size)."""

    def __init__(self, sig: np.ndarray, key: np.ndarray, mark: np.ndarray, at: np.ndarray):
        self.sig, self.key, self.mark, self.at = sig, key, mark, at

    def take(self, rows: np.ndarray) -> Block:
        return Block(self.sig[rows], self.key[rows], self.mark[rows], self.at[rows])

    def packed(self) -> list[bytes]:
        """Signatures (their upper half: in a part, rows that share it by chance are compared for nothing), keys, and the rest."""
        most = self.at.max(initial=0)
        kind = np.uint8 if most < 2**8 else np.uint16 if most < 2**16 else np.int32
        table = np.concatenate([self.mark[None].astype(kind), self.at.T.astype(kind)])
        return [(self.sig >> np.uint64(32)).astype(np.uint32).tobytes(), self.key.tobytes(), _PACK.compress(table.tobytes())]

    @staticmethod
    def unpacked(rows: pd.DataFrame) -> Block:
        join = lambda c, kind: np.concatenate([np.frombuffer(x, kind) for x in rows[c]])
        kinds, width, tables = {1: np.uint8, 2: np.uint16, 4: np.int32}, PIVOTS + 2, []
        unpack = zstandard.ZstdDecompressor()
        for blob, key in zip(rows["at"], rows["key"], strict=True):
            raw = unpack.decompress(blob)
            tables.append(np.frombuffer(raw, kinds[len(raw) // (len(key) // 8 * width)]).reshape(width, -1).T.astype(np.int32))
        table = np.concatenate(tables)
        sig = (np.uint64(rows["part"].iloc[0]) << np.uint64(32)) + join("sig", np.uint32).astype(np.uint64)
        return Block(sig, join("key", np.int64), table[:, 0].astype(np.uint8), table[:, 1:])


_PACK = zstandard.ZstdCompressor(level=1)
_PACKED = "part int, sig binary, key binary, at binary"


def _rows_of(scheme: Scheme, keys: np.ndarray, lists: pa.Array) -> Block:
    """Block rows of a batch of records."""
    words, record, sizes = _flat(lists)
    row, sig, mark = scheme.signatures(words, record, sizes)
    return Block(sig, keys[row], mark, scheme.coordinates(words, record, sizes)[row])


def _emit(block: Block, parts: int) -> pa.RecordBatch:
    """One row per target part, with all its block rows packed (a compact shuffle)."""
    part = (block.sig % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((block.sig, part))
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    groups = np.split(order, cuts)
    blobs = [block.take(g).packed() for g in groups]
    return pa.RecordBatch.from_arrays([pa.array(part[[g[0] for g in groups]].astype(np.int32)), *[pa.array([x[i] for x in blobs], pa.binary()) for i in range(3)]], names=["part", "sig", "key", "at"])


def _packing(shared, parts: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, first = np.unique(batch.column("key").to_numpy(), return_index=True)  # copies in a batch count once
            if len(keys):
                yield _emit(_rows_of(shared.value, keys, batch.column("words").take(pa.array(first))), parts)

    return pack


def _counting(shared):
    """How many records of the sample share each signature (whole 0), and each one made by division of a hot one (whole)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scheme: Scheme = shared.value
        for batch in batches:
            if batch.num_rows:
                given = _flat(batch.column("words"))
                whole, sig = scheme.divisions(*given) if len(scheme.hot) else (np.zeros(0, np.uint64), scheme.signatures(*given)[1])
                seen = pd.DataFrame({"whole": whole.view(np.int64) if len(scheme.hot) else np.int64(0), "sig": sig.view(np.int64)}).value_counts().reset_index(name="n")
                yield pa.RecordBatch.from_pandas(seen, preserve_index=False)

    return count


def _survivors(block: Block, starts: np.ndarray, sizes: np.ndarray, scheme: Scheme) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs within blocks (rows starts..starts+sizes, by mark) that the pivots don't discard."""
    # A row is paired with all later rows of its block, unless its mark forbids it; rows are taken in chunks of _CHUNK pairs.
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    row = np.repeat(starts, sizes) + place
    # Without slack the lower rows are the last, and only meet each other; with it they meet rows that lack a word.
    idle = (block.mark[row] & LESS > 0) if scheme.slack else block.mark[row] > 0
    later = np.where(idle, 0, np.repeat(sizes, sizes) - place - 1)
    row, later = row[later > 0], later[later > 0]
    bounds = np.concatenate([[0], np.cumsum(later)])
    columns = scheme.distances(block.at)
    lo = 0
    while lo < len(row):
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + _CHUNK, side="right")) - 1)
        n = later[lo:hi]
        a = np.repeat(row[lo:hi].astype(np.int32), n)
        b = np.arange(n.sum(), dtype=np.int32) - np.repeat((np.cumsum(n) - n).astype(np.int32), n) + a + 1
        most = scheme.distance(columns[0][a] + columns[0][b])
        for column in columns:
            ok = np.abs(column[a] - column[b]) <= most
            a, b, most = a[ok], b[ok], most[ok]
        ok = (block.key[a] != block.key[b]) & (block.mark[a] & block.mark[b] & LOWER == 0)
        x, y = block.key[a[ok]], block.key[b[ok]]
        yield np.minimum(x, y), np.maximum(x, y)
        lo = hi


def _comparing(shared, hot: int):
    """Blocks of a part -> pairs; members of oversized blocks leave as (record, block), to be compared in tiles."""

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        block = Block.unpacked(pdf)
        block = block.take(np.lexsort((block.key, block.mark, block.sig)))
        fresh = np.append(True, (block.sig[1:] != block.sig[:-1]) | (block.key[1:] != block.key[:-1]) | (block.mark[1:] != block.mark[:-1]))
        block = block.take(np.flatnonzero(fresh))
        starts = np.flatnonzero(np.append(True, block.sig[1:] != block.sig[:-1]))
        sizes = np.diff(np.append(starts, len(block.sig)))
        fits = (sizes > 1) & ((sizes <= hot) | (hot < 0))
        found = list(_survivors(block, starts[fits], sizes[fits], shared.value)) if fits.any() else []
        a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
        pairs = np.unique(np.stack([a, b], axis=1), axis=0)
        over = (sizes > hot) & (hot >= 0)
        rows = np.repeat(starts[over] - np.cumsum(sizes[over]) + sizes[over], sizes[over]) + np.arange(sizes[over].sum())
        return pd.DataFrame({"a": np.concatenate([pairs[:, 0], block.key[rows]]), "b": np.concatenate([pairs[:, 1], block.sig[rows].view(np.int64)]), "hot": np.repeat([False, True], [len(pairs), len(rows)])})

    return compare


def _tiling(shared, parts: int):
    """Members of oversized blocks, once for each tile of `width` by `width` groups of them in which they are compared."""

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scheme: Scheme = shared.value
        for batch in batches:
            if batch.num_rows:
                words, record, sizes = _flat(batch.column("words"))
                keys, width = batch.column("key").to_numpy(), batch.column("width").to_numpy()
                group = (_mix(keys, 61) % width.astype(np.uint64)).astype(np.int64)
                row = np.repeat(np.arange(len(keys)), width)
                other = np.arange(len(row)) - np.repeat(np.cumsum(width) - width, width)
                at = np.minimum(group[row], other) * width[row] + np.maximum(group[row], other)
                sig = _mix(batch.column("block").to_numpy().view(np.uint64)[row] ^ _mix(at, 67), 71)
                yield _emit(Block(sig, keys[row], np.zeros(len(row), np.uint8), scheme.coordinates(words, record, sizes)[row]), parts)

    return tile


def choose_pivots(drawn: list[list[int]]) -> list[list[int]]:
    """PIVOTS reference fingerprints: each has the largest spread of distances that the ones before don't explain."""
    merged = [sorted(set().union(*drawn[k : k + MERGED])) for k in range(0, min(len(drawn), CANDIDATES * MERGED), MERGED)]
    merged += [[] for _ in range(PIVOTS - len(merged))]
    sizes = np.array([len(x) for x in drawn], dtype=np.int64)
    words, record = np.array([w for x in drawn for w in x], dtype=np.int64), np.repeat(np.arange(len(drawn)), sizes)
    wide = Scheme([], merged, THRESHOLD)
    rest = np.stack(wide.distances(wide.coordinates(words, record, sizes))[1:], axis=1).astype(float)
    rest -= rest.mean(axis=0) if len(rest) else 0.0
    chosen: list[int] = []
    for _ in range(PIVOTS):
        spread = np.sum(rest * rest, axis=0)
        spread[chosen] = -1.0
        chosen.append(int(spread.argmax()))
        if spread[chosen[-1]] > 1e-6:
            unit = rest[:, chosen[-1]] / np.sqrt(spread[chosen[-1]])
            rest -= np.outer(unit, unit @ rest)
    return [merged[k] for k in chosen]


def learn_scheme(sets: DataFrame, t: tuple[int, int], n: int, slack: int = 0, hot: int = HOT) -> Scheme:
    """Word shares over all `n` records; pivots, and hot signatures, from bounded samples."""
    counts = sets.select(F.explode("words").alias("w")).groupBy("w").count().where(F.col("count") >= FREQUENT * n)
    frequent = [(r.w, r["count"] / n) for r in counts.collect()] if n else []
    drawn = [list(r.words) for r in sets.orderBy(F.xxhash64("key"), "key").select("words").limit(DRAWN).collect()]
    scheme = Scheme(frequent, choose_pivots(drawn), t, slack)
    every = max(1, n // SAMPLE)
    sample = sets.where(F.pmod(F.xxhash64(F.lit(9), "key"), F.lit(every)) == 0).select("key", "words")

    def seen() -> DataFrame:
        shared = sets.sparkSession.sparkContext.broadcast(scheme)
        return sample.mapInArrow(_counting(shared), "whole bigint, sig bigint, n bigint").groupBy("whole", "sig").agg(F.sum("n").alias("n"))

    as_hot = lambda sigs: np.sort(np.array(sigs, dtype=np.int64).view(np.uint64))
    # Each has SEEN records of the sample at least, so there are few (rows a record * SAMPLE / SEEN).
    large = seen().where((F.col("n") * every > hot) & (F.col("n") >= (SEEN if every > 1 else 1))).select("sig", "n").collect()
    if large:
        size = {r.sig: r.n for r in large}
        scheme.hot = as_hot(list(size))
        left = seen().groupBy("whole").agg(F.sum(F.col("n") * F.col("n")).alias("pairs")).collect()
        scheme.hot = as_hot([r.whole for r in left if 4 * r.pairs <= size[r.whole] ** 2])
    return scheme


def similar_sets(sets: DataFrame, t: tuple[int, int] = THRESHOLD, hot: int = HOT, parts: int | None = None, slack: int | None = None) -> DataFrame:
    """(a, b, common, either) of all pairs of different word sets with common / either >= t; a < b are keys.

    `sets` has key BIGINT (equal for equal sets) and words, the sorted distinct word hashes; rows with equal keys are
    copies. It is read several times, so it should be a table. Sets without words have no partners. slack: differences
    allowed in a segment (0 or 1; by the number of records, if not given); the pairs are the same.
    """
    spark = sets.sparkSession
    sets = sets.where(F.size("words") > 0)
    n = sets.count()
    slack = int(n > WIDE) if slack is None else slack
    shared = spark.sparkContext.broadcast(learn_scheme(sets, t, n, slack, hot))
    # A record takes some 1 kB of block rows (5 with slack), so a part stays near 10 MB however many records there are.
    # Each part is a task of its own: parts are of even size, and number the shuffle's partitions directly.
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")) * 4, n * (1 + 4 * slack) // PART_RECORDS)
    found = "a bigint, b bigint, hot boolean"
    compared = lambda packed, hot, name: materialise(packed.repartitionById(parts, F.col("part")).groupBy("part").applyInPandas(_comparing(shared, hot), found), name)
    first = compared(sets.select("key", "words").mapInArrow(_packing(shared, parts), _PACKED), hot, "candidates")
    pairs = first.where("not hot").select("a", "b")
    crowded = first.where("hot").select(F.col("a").alias("key"), F.col("b").alias("block")).distinct()
    if crowded.limit(1).count():
        width = crowded.groupBy("block").agg(F.ceil(F.count("*") / F.lit(hot)).alias("width"))
        members = crowded.join(width, "block").join(_words_of(sets, crowded.select("key").distinct()), "key")
        tiles = members.select("key", "block", "width", "words").mapInArrow(_tiling(shared, parts), _PACKED)
        pairs = pairs.unionByName(compared(tiles, -1, "tiles").select("a", "b"))
    pairs = materialise(pairs.distinct(), "survivors")
    words = materialise(_words_of(sets, pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()), "words")
    side = lambda c: words.select(F.col("key").alias(c), F.col("words").alias(f"w{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("common", F.size(F.array_intersect("wa", "wb")))
    either = F.size("wa") + F.size("wb") - F.col("common")
    return both.withColumn("either", either).where(F.col("common") * t[1] >= F.col("either") * t[0]).select("a", "b", "common", "either")


def _words_of(sets: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, words) of some keys, once each."""
    keys = materialise(keys, "needed")
    few = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
    return sets.join(few, "key", "left_semi").groupBy("key").agg(F.first("words").alias("words"))


def word_sets(rows: DataFrame, id_col: str, *texts: str) -> DataFrame:
    """Table (id, key, words) of the records' word sets; written once, as it is read several times.

    Keys are 64 bits that are checked against another hash: were two different sets to share one, all are drawn anew.
    """
    words = rows.select(F.col(id_col).cast("bigint").alias("id"), word_set(*[F.col(c) for c in texts]).alias("words"))
    for seed in range(16):
        sets = materialise(words.select("id", F.xxhash64(F.lit(seed), "words").alias("key"), "words", F.xxhash64("words", F.lit(-1 - seed)).alias("check")), "sets")
        if not sets.groupBy("key").agg(F.min("check").alias("lo"), F.max("check").alias("hi")).where("lo <> hi").limit(1).count():
            return sets.select("id", "key", "words")
    raise RuntimeError("word sets can't be told apart by 64 bits")


def near_duplicates(rows: DataFrame, id_col: str, *texts: str, t: tuple[int, int] = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(membership, links): membership (id, rep) with one row per record that has words, links (a, b, common, either).

    `rep` stands for all records with exactly the same words (exact copies); links join the reps of different word sets
    whose similarity reaches t. Null texts are empty; records without words belong to no class; repeated rows are copies
    of each other; texts of any length are used whole; an empty table gives empty results; other columns aren't read.
    """
    sets = word_sets(rows, id_col, *texts)
    return sets.where(F.size("words") > 0).select("id", F.col("key").alias("rep")), similar_sets(sets.select("key", "words"), t)


def pairs_of_records(membership: DataFrame, links: DataFrame) -> DataFrame:
    """(id_a, id_b) of all linked records: copies expanded, smaller id first."""
    one = membership.select(F.col("id").alias("x"), F.col("rep").alias("a"))
    two = membership.select(F.col("id").alias("y"), F.col("rep").alias("b"))
    across = links.select("a", "b").join(one, "a").join(two, "b").select("x", "y")
    shared = membership.groupBy("rep").count().where("count > 1").select("rep")
    doubled = membership.join(shared, "rep", "left_semi")
    within = doubled.select("rep", F.col("id").alias("x")).join(doubled.select("rep", F.col("id").alias("y")), "rep").where("x < y").select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def groups_of_records(membership: DataFrame, links: DataFrame) -> DataFrame:
    """(id, class_id, n_copies, n_links, group_id): one row per record of `membership`.

    class_id is the smallest id of the records with the same words and n_copies their number; n_links counts the other
    word sets that are similar; group_id is the smallest id of all records that links join, directly or through others.
    """
    classes = membership.groupBy("rep").agg(F.min("id").alias("class_id"), F.count_distinct("id").alias("n_copies"))
    named = lambda c: classes.select(F.col("rep").alias(c), F.col("class_id").alias(f"_{c}"))
    edges = materialise(links.join(named("a"), "a").join(named("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")), "links")
    counts = edges.select(F.col("a").alias("class_id")).union(edges.select("b")).groupBy("class_id").agg(F.count("*").alias("n_links"))
    grouped = components(edges).select(F.col("node").alias("class_id"), F.col("component").alias("group_id"))
    about = classes.join(counts, "class_id", "left").join(grouped, "class_id", "left")
    found = membership.distinct().join(about, "rep")
    return found.select("id", "class_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("group_id", "class_id").alias("group_id"))
