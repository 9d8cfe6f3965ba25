"""Several values packed in one field: one row per value, with its position.

Quoted spans are atomic. Between them every delimiter is a possible cut, and a field is a lattice: its nodes are the
places between parts, its edges the values that may stand there. Edges of several parts ("loft, aft") come from the
whole column: every run of neighbouring parts that is frequent enough (see `FLOOR` and `SHARE`), quoted or not.
Expectation-maximisation estimates from all fields how often each value occurs and how often each delimiter separates,
until the likelihood settles; Viterbi then picks every field's likeliest path. Values found in one round are units of
the next, in which longer ones can form, until a round finds none.

Only stretches of a field that such an edge covers have a second path. They are brought together with their counts
(`_regions`), so that an iteration reads those instead of the column; the other parts are counted once.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillweave.session import materialise

#: Characters that may separate values. Fixed values.
DELIMITERS = ",;|•\t\r\n"
#: Different surroundings (parts before and after) in which a run of parts must stand to be taken for a possible value;
#: lists that are delivered again show no new surroundings. A quoted value needs none.
FLOOR = 8
#: Least share of a column's parts that the occurrences of a possible value make up, so that there are at most
#: 1 / SHARE of them, with as many parts together, at every size of the column.
SHARE = 5e-6
#: A change of the log-likelihood (as a share of it) below which EM has settled, and most iterations until then.
SETTLED, ITERATIONS = 1e-5, 25
#: Share of delimiters that separate, before anything is known.
RHO = 0.9

_CUT = re.compile(f"[{DELIMITERS}]")
_QUOTE = re.compile('["“]')
_PART = re.compile(f'(?:(?<![^\\s(,;|•])"(?:[^"]|"")*"|(?<![^\\s(,;|•])“[^”]*”|[^{DELIMITERS}])*')
_SPACED = re.compile(f"[ \\t]*([{DELIMITERS}])[ \\t]*")
_WHOLE = re.compile(r'"((?:[^"]|"")*)"|“((?:[^”]|””)*)”', re.S)
_NONE = re.compile(r"\s*(?:n\s*/?\s*a)?\s*", re.I)
_TRIM = " \t\r\n\f\v ​"


def cells(rows: DataFrame, name: str, row_id: str, field: str) -> DataFrame:
    """One field of a table in the shape that `unpack` takes."""
    return rows.select(F.lit(name).alias("src_table"), F.col(row_id).cast("bigint").alias("row_id"), F.lit(field).alias("field"), F.col(field).alias("text"))


def lex(text: str) -> list[tuple[int, int, str | None]]:
    """(start, end, value of a wholly quoted part or None) of the non-empty parts between possible cuts."""
    if _NONE.fullmatch(text):
        return []
    out = []
    if not _QUOTE.search(text):
        at = 0
        for part in _CUT.split(text):
            if part.strip(_TRIM):
                out.append((at, at + len(part), None))
            at += len(part) + 1
        return out
    at, size = 0, len(text)
    while at <= size:
        end = _PART.match(text, at).end()
        bare = text[at:end].strip(_TRIM)
        if bare:
            whole = _WHOLE.fullmatch(bare)
            if whole:
                value = (whole[1].replace('""', '"') if whole[1] is not None else whole[2].replace("””", "”")).strip(_TRIM)
                if value:
                    out.append((at, end, value))
            else:
                out.append((at, end, None))
        at = end + 1
    return out


def parts_of(value: str) -> tuple[str, ...]:
    """The parts into which a value falls when cut at every delimiter."""
    return tuple(p for p in (x.strip(_TRIM) for x in _CUT.split(value)) if p)


def plain(value: str) -> str:
    """A value with even spacing around its delimiters, so that spellings compare."""
    return _SPACED.sub(r"\1", value.strip(_TRIM))


def _key(column: int, value: str) -> int:
    """64 bits that stand for a value of a column."""
    return xxhash.xxh64_intdigest(value, column) - 2**63


class Run(NamedTuple):
    """Unquoted neighbouring parts of a field with one delimiter between each two; `first` is the number of the first."""

    first: int
    words: list[str]
    cuts: list[str]


def runs_of(text: str, parts: list[tuple[int, int, str | None]]) -> list[Run]:
    """The runs of a field. Quoted parts, and delimiters with nothing between them, always separate."""
    out: list[Run] = []
    for k, (start, end, quoted) in enumerate(parts):
        if quoted is not None:
            continue
        word = text[start:end].strip(_TRIM)
        if out and out[-1].first + len(out[-1].words) == k and parts[k - 1][1] + 1 == start:
            out[-1].words.append(word)
            out[-1].cuts.append(text[start - 1])
        else:
            out.append(Run(k, [word], []))
    return out


class Lexicon:
    """Keys of possible values of several parts, by the key of their first part and their number of parts."""

    def __init__(self, known: dict[int, tuple[int, int]]):
        self.by_first: dict[int, dict[int, set[int]]] = {}
        for key, (first, size) in known.items():
            self.by_first.setdefault(first, {}).setdefault(size, set()).add(key)

    def edges(self, column: int, words: list[str], cuts: list[str]) -> list[tuple[int, int, int]]:
        """(first, last + 1, key) of the values that may span several words of a run."""
        found = []
        for i in range(len(cuts) if self.by_first else 0):
            for size, keys in self.by_first.get(_key(column, words[i]), {}).items():
                if i + size <= len(words):
                    key = _key(column, spelt(words, cuts, i, i + size))
                    if key in keys:
                        found.append((i, i + size, key))
        return found


def spelt(words: list[str], cuts: list[str], i: int, j: int) -> str:
    """The plain form of words i..j of a run."""
    return words[i] + "".join(cuts[k] + words[k + 1] for k in range(i, j - 1))


def stretches(edges: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(first, last + 1) of the stretches that overlapping edges cover together."""
    out: list[tuple[int, int]] = []
    for i, j in sorted((i, j) for i, j, _ in edges):
        if out and i < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], j))
        else:
            out.append((i, j))
    return out


class Model:
    """Frequencies of values by key, of all values by column, and the share of each delimiter that separates."""

    def __init__(self, weight: dict[int, float], total: dict[int, float], rho: dict[tuple[int, str], float]):
        self.weight, self.total, self.rho = weight, total, rho

    def steps(self, column: int, words: list[str], cuts: list[str], edges: list[tuple[int, int, int]]) -> list[list[tuple[int, float, int]]]:
        """For each place between words the edges that end there, as (place of their begin, log probability, key)."""
        scale = math.log(max(self.total.get(column, 1.0), 1.0))
        into: list[list[tuple[int, float, int]]] = [[] for _ in range(len(words) + 1)]
        singles = [(k, k + 1, _key(column, w)) for k, w in enumerate(words)]
        for i, j, key in [*singles, *edges]:
            n = self.weight.get(key, 0.0)
            if n <= 0 and j > i + 1:
                continue
            p = math.log(max(n, 1e-3)) - scale
            for k in range(i, j - 1):
                p += math.log(1 - self.rho.get((column, cuts[k]), RHO))
            if j < len(words):
                p += math.log(self.rho.get((column, cuts[j - 1]), RHO))
            into[j].append((i, p, key))
        return into

    def best(self, column: int, words: list[str], cuts: list[str], edges: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
        """Viterbi path; of equal paths the one of more values."""
        score = [(0.0, 0, 0)]
        for ending in self.steps(column, words, cuts, edges)[1:]:
            score.append(max((score[i][0] + p, score[i][1] + 1, i) for i, p, _ in ending))
        path, j = [], len(words)
        while j:
            path.append((score[j][2], j))
            j = score[j][2]
        return path[::-1]

    def expected(self, column: int, words: list[str], cuts: list[str], edges: list[tuple[int, int, int]]) -> tuple[float, list[tuple[int, int, int, float]]]:
        """(log-likelihood, [(first, last + 1, key, posterior)]) by forward-backward."""
        into = self.steps(column, words, cuts, edges)
        ahead, back = [0.0], [-math.inf] * len(words) + [0.0]
        for ending in into[1:]:
            ahead.append(_log_sum([ahead[i] + p for i, p, _ in ending]))
        for j in range(len(words), 0, -1):
            for i, p, _ in into[j]:
                back[i] = _log_sum([back[i], p + back[j]])
        whole = ahead[-1]
        return whole, [(i, j, key, math.exp(min(0.0, ahead[i] + p + back[j] - whole))) for j, ending in enumerate(into) for i, p, key in ending]


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top if top == -math.inf or len(values) == 1 else top + math.log(sum(math.exp(v - top) for v in values))


def segment(lexicon: Lexicon, model: Model, column: int, run: Run) -> list[tuple[int, int]]:
    """The likeliest path through a run."""
    edges = lexicon.edges(column, run.words, run.cuts)
    path, at = [], 0
    for i, j in stretches(edges):
        path += [(k, k + 1) for k in range(at, i)]
        inside = [(x - i, y - i, key) for x, y, key in edges if i <= x < j]
        path += [(x + i, y + i) for x, y in model.best(column, run.words[i:j], run.cuts[i : j - 1], inside)]
        at = j
    return path + [(k, k + 1) for k in range(at, len(run.words))]


def _columns(batch: pa.RecordBatch) -> Iterator[tuple[int, str]]:
    return zip(batch.column("column").to_pylist(), batch.column("text").to_pylist(), strict=True)


def _summed(seen: dict, fields: list[tuple[str, pa.DataType]], kind: pa.DataType) -> pa.RecordBatch:
    """The counts of a Counter by tuples, as a batch with a last column n."""
    columns = list(zip(*seen, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)), pa.array(list(seen.values()), kind)], names=[*(f for f, _ in fields), "n"])


_INT, _LONG, _TEXT, _REAL = pa.int32(), pa.int64(), pa.string(), pa.float64()
_STATS = [("column", _INT), ("kind", _TEXT), ("key", _LONG), ("around", _LONG), ("first", _LONG), ("size", _INT)]
_STATS_DDL = "column int, kind string, key bigint, around bigint, first bigint, size int, n bigint"


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of every batch: values if all delimiters cut, neighbouring pairs with what stands around, quoted values, parts."""
    for batch in batches:
        seen: Counter = Counter()
        for column, text in _columns(batch):
            parts = lex(text)
            size = len(parts)
            for _, _, value in parts:
                if value is not None:
                    seen[column, "unit", _key(column, plain(value)), 0, 0, 0] += 1
                    inner = parts_of(value) if _CUT.search(value) else ()
                    if len(inner) > 1:
                        size += len(inner) - 1
                        seen[column, "quoted", _key(column, plain(value)), 0, _key(column, inner[0]), len(inner)] += 1
            seen[column, "parts", 0, 0, 0, 0] += size
            for _, words, cuts in runs_of(text, parts):
                keys = [_key(column, w) for w in words]
                for key in keys:
                    seen[column, "unit", key, 0, 0, 0] += 1
                for i, cut in enumerate(cuts):
                    around = _key(column, (words[i - 1] if i else "") + "\x1f" + (words[i + 2] if i + 2 < len(words) else ""))
                    seen[column, "pair", _key(column, words[i] + cut + words[i + 1]), around, keys[i], 2] += 1
        yield _summed(seen, _STATS, _LONG)


def _counting_longer(shared):
    """Counts of pairs of which one is a value found before, with what stands around."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, model = shared.value
        for batch in batches:
            seen: Counter = Counter()
            for column, text in _columns(batch):
                for run in runs_of(text, lex(text)):
                    path = segment(lexicon, model, column, run) if run.cuts else []
                    for (i, m), (n, j) in zip(path, path[1:], strict=False):
                        if j - i > 2:
                            around = _key(column, (run.words[i - 1] if i else "") + "\x1f" + (run.words[j] if j < len(run.words) else ""))
                            seen[column, "pair", _key(column, spelt(run.words, run.cuts, i, j)), around, _key(column, run.words[i]), j - i] += 1
            yield _summed(seen, _STATS, _LONG)

    return count


_REGION = [("column", _INT), ("region", _TEXT), ("cut", _TEXT)]


def _regions(shared):
    """Stretches with a second path (words and cuts in one text), and the delimiters outside them."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon: Lexicon = shared.value
        for batch in batches:
            seen: Counter = Counter()
            for column, text in _columns(batch):
                parts = lex(text)
                for _, end, _ in parts[:-1]:
                    seen[column, "", text[end : end + 1]] += 1
                for _, words, cuts in runs_of(text, parts):
                    for i, j in stretches(lexicon.edges(column, words, cuts)):
                        seen[column, words[i] + "".join("\x1f" + cuts[k] + words[k + 1] for k in range(i, j - 1)), ""] += 1
                        for k in range(i, j - 1):
                            seen[column, "", cuts[k]] -= 1
            yield _summed(seen, _REGION, _LONG)

    return find


def _opened(region: str) -> tuple[list[str], list[str]]:
    first, *rest = region.split("\x1f")
    return [first, *(r[1:] for r in rest)], [r[0] for r in rest]


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str], list[str], int]]:
    for column, region, n in zip(*(batch.column(c).to_pylist() for c in ("column", "region", "n")), strict=True):
        yield column, *_opened(region), n


def _standing(shared):
    """How often the words and possible values of the regions stand there, by key."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for column, words, cuts, n in _rows(batch):
                for key in [*(_key(column, w) for w in words), *(k for _, _, k in shared.value.edges(column, words, cuts))]:
                    seen[(key,)] += n
        yield _summed(seen, [("key", _LONG)], _LONG)

    return find


def _expecting(shared):
    """E-step over the regions: expected counts of values by key and of cuts by delimiter, and the log-likelihood."""

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, model = shared.value
        sums: dict = defaultdict(float)
        for batch in batches:
            for column, words, cuts, n in _rows(batch):
                likely, found = model.expected(column, words, cuts, lexicon.edges(column, words, cuts))
                sums[column, "likely", 0] += n * likely
                for i, j, key, p in found:
                    sums[column, "value", key] += n * p
                    for k in range(i, j - 1):
                        sums[column, "0" + cuts[k], 0] += n * p
                    if j < len(words):
                        sums[column, "1" + cuts[j - 1], 0] += n * p
        yield _summed(sums, [("column", _INT), ("kind", _TEXT), ("key", _LONG)], _REAL)

    return expect


def _fit(text: DataFrame, units: DataFrame, total: dict[int, int], known: dict[int, tuple[int, int]], quoted: set[int]) -> Model:
    """EM from the counted frequencies until the likelihood settles."""
    context, lexicon = text.sparkSession.sparkContext, Lexicon(known)
    shared = context.broadcast(lexicon)
    found = materialise(text.mapInArrow(_regions(shared), "column int, region string, cut string, n bigint").groupBy("column", "region", "cut").agg(F.sum("n").alias("n")), "regions")
    beside = {(r.column, r.cut): r.n for r in found.where("region = ''").collect()}  # a few delimiters a column
    regions = found.where("region <> ''").select("column", "region", "n")
    standing = regions.mapInArrow(_standing(shared), "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("inside"))
    counts = standing.join(units.select("key", "n"), "key", "left").select("key", "inside", F.coalesce("n", F.lit(0)).alias("n")).collect()
    # What stands outside the regions is the same in every iteration.
    fixed = {r.key: float(r.n if r.key in known else r.n - r.inside) for r in counts}
    weight = {r.key: fixed[r.key] + r.inside for r in counts}
    rho: dict[tuple[int, str], float] = {}
    before = None
    for _ in range(ITERATIONS):
        step = context.broadcast((lexicon, Model(weight, total, rho)))
        rows = regions.mapInArrow(_expecting(step), "column int, kind string, key bigint, n double").groupBy("column", "kind", "key").agg(F.sum("n").alias("n")).collect()
        weight, split, likely = dict(fixed), defaultdict(float), 0.0
        for r in rows:  # as many as possible values and their parts (see SHARE), and a few delimiters
            if r.kind == "value":
                weight[r.key] += r.n
            elif r.kind == "likely":
                likely += r.n
            else:
                split[r.column, r.kind[1:], r.kind[0]] += r.n
        for key in known.keys() - quoted:  # a value that is never quoted must be expected FLOOR times
            if weight.get(key, 0.0) < FLOOR:
                weight.pop(key, None)
        rho = {}
        for column, cut in {*beside, *((c, k) for c, k, _ in split)}:
            yes, no = beside.get((column, cut), 0) + split[column, cut, "1"], split[column, cut, "0"]
            rho[column, cut] = (yes + 1) / (yes + no + 2)
            likely += beside.get((column, cut), 0) * math.log(rho[column, cut])
        if before is not None and abs(likely - before) <= SETTLED * abs(before):
            break
        before = likely
    return Model(weight, total, rho)


class Learned(NamedTuple):
    """The values of several parts that the model keeps, the model, and all that were possible."""

    lexicon: Lexicon
    model: Model
    possible: Lexicon


def learn(text: DataFrame) -> Learned:
    """Values of several parts and the model that weighs them, from all fields in `text` (column, text)."""
    context = text.sparkSession.sparkContext
    stats = materialise(text.mapInArrow(_counting, _STATS_DDL).groupBy("column", "kind", "key", "around", "first", "size").agg(F.sum("n").alias("n")), "units")
    total = {r.column: r.n for r in stats.where("kind = 'parts'").collect()}  # a row a column
    least = reduce(lambda e, c: e.when(F.col("column") == c, SHARE * total[c]), total, F.when(F.lit(False), 0.0)).otherwise(0.0)
    quoted = {r.key: (r.first, r.size) for r in stats.where("kind = 'quoted'").where(F.col("n") >= least).collect()}
    units = stats.where("kind = 'unit'")

    def pairs(counted: DataFrame) -> dict[int, tuple[int, int]]:
        held = counted.where("kind = 'pair'").groupBy("column", "key", "first", "size").agg(F.count("*").alias("surroundings"), F.sum("n").alias("n"))
        return {r.key: (r.first, r.size) for r in held.where((F.col("surroundings") >= FLOOR) & (F.col("n") >= least)).collect()}

    known, found = pairs(stats) | quoted, set()
    model, possible = Model({}, total, {}), dict(known)
    while known:
        model = _fit(text, units, total, known, set(quoted))
        known = {key: at for key, at in known.items() if model.weight.get(key, 0.0) > 0}
        fresh = known.keys() - quoted.keys() - found
        found |= fresh
        if not fresh:
            break
        shared = context.broadcast((Lexicon(known), model))
        longer = text.mapInArrow(_counting_longer(shared), _STATS_DDL).groupBy("column", "kind", "key", "around", "first", "size").agg(F.sum("n").alias("n"))
        news = {key: at for key, at in pairs(longer).items() if key not in known}
        if not news:
            break
        known |= news
        possible |= news
    return Learned(Lexicon(known), model, Lexicon(possible))


def _cutting(shared):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, model, _ = shared.value
        for batch in batches:
            of, pos, items = [], [], []
            for row, (column, text) in enumerate(_columns(batch)):
                parts = lex(text)
                ends = list(range(1, len(parts) + 1))  # end of the value that begins with a part; None inside a value
                if lexicon.by_first:
                    for run in runs_of(text, parts):
                        for i, j in segment(lexicon, model, column, run) if run.cuts else ():
                            if j > i + 1:
                                ends[run.first + i] = run.first + j
                                ends[run.first + i + 1 : run.first + j] = [None] * (j - i - 1)
                n = 0
                for i, j in enumerate(ends):
                    if j is not None:
                        n += 1
                        quoted = parts[i][2]
                        of.append(row)
                        pos.append(n)
                        items.append(quoted if quoted is not None else text[parts[i][0] : parts[j - 1][1]].strip(_TRIM))
            take = pa.array(of, pa.int64())
            kept = [batch.column(c).take(take) for c in ("src_table", "row_id", "field")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(pos, pa.int64()), pa.array(items, pa.string())], names=["src_table", "row_id", "field", "pos", "item"])

    return cut


def _numbered(fields: list[DataFrame]) -> DataFrame:
    """All fields in one table, with a number for each column they come from."""
    return reduce(DataFrame.unionByName, [f.withColumn("column", F.lit(n)) for n, f in enumerate(fields)]).where(F.col("text").isNotNull())


def unpack(fields: list[DataFrame]) -> DataFrame:
    """(src_table, row_id, field, pos, item) of every value in `fields` (made by `cells`, one per column).

    Null, blank and N/A fields have no items; empty items take no position; repeats stay; a quotation mark that isn't
    closed, or doesn't begin a value, is an ordinary character; repeated rows each give their items (and weigh in the
    model); empty tables give none; texts of any length are cut whole. Of equally likely ways the one of more values
    is taken.
    """
    text = _numbered(fields)
    shared = text.sparkSession.sparkContext.broadcast(learn(text.select("column", "text")))
    return text.mapInArrow(_cutting(shared), "src_table string, row_id bigint, field string, pos bigint, item string")


def _choosing(shared):
    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, model, possible = shared.value
        seen: Counter = Counter()
        for batch in batches:
            for column, text in _columns(batch):
                runs = [r for r in runs_of(text, lex(text)) if r.cuts]
                seen[column, "fields"] += 1
                seen[column, "open"] += any(possible.edges(column, r.words, r.cuts) for r in runs)
                seen[column, "joined"] += any(j > i + 1 for r in runs for i, j in segment(lexicon, model, column, r))
        yield _summed(seen, [("column", _INT), ("kind", _TEXT)], _LONG)

    return choose


def choices(fields: list[DataFrame]) -> DataFrame:
    """(src_table, field, n_fields, n_open, n_joined): how many fields have a second path, and in how many it is taken."""
    text, names = _numbered(fields), [f.select("src_table", "field").limit(1).withColumn("column", F.lit(n)) for n, f in enumerate(fields)]
    shared = text.sparkSession.sparkContext.broadcast(learn(text.select("column", "text")))
    counted = text.select("column", "text").mapInArrow(_choosing(shared), "column int, kind string, n bigint").groupBy("column").pivot("kind", ["fields", "open", "joined"]).agg(F.sum("n"))
    return reduce(DataFrame.unionByName, names).join(counted, "column").select("src_table", "field", *[F.col(c).alias(f"n_{c}") for c in ("fields", "open", "joined")])
