"""Version history of entity attributes from snapshots or updates.

1. Merkle comparison. The keys of a delivery (snapshot or run) fall into leaf buckets by their hash, as many as keep the
   number of keys a leaf the same however many keys there are; a node's digest is the XOR of its children's. Each node is
   compared with itself in the last delivery that has it, from the root down, and only differing branches are descended.
   Equal digests mean the same keys with the same content as when those keys were last delivered, so nothing of that
   branch begins a version and its rows are left out. An update that repeats what is known is left out as well.
2. Diff. The rows of changed leaves are sorted by entity and time and read once in order: a row is compared with the
   version open before it and appends a version if it differs. No entity is gathered in one task: the range sort cuts a
   large entity anywhere, and the runs at the cuts (three a partition at most) are joined afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skillweave.session import materialise

#: Bits of the tree from one level to the next, and bits by which the leaves outnumber the keys (so that most leaves hold
#: one key, and a changed key takes few others with it).
STEP, SPARE = 8, 1
_NULL = "\x00"
#: Most (period, leaf) rows that are broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000


def state_text(*columns: Column) -> Column:
    """One comparable text of several attributes; null differs from every value."""
    return F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit(_NULL)) for c in columns])


def small(table: DataFrame, size: int) -> DataFrame:
    """The table, to be broadcast if it has few enough rows."""
    return F.broadcast(table) if size <= BROADCAST_ROWS else table


def leaf_bits(n_keys: int) -> int:
    """Bits that number the leaves for so many keys."""
    return min(48, max(1, int(n_keys).bit_length()) + SPARE)


def leaf_of(entity: Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(entity), 64 - bits)


def _digests(rows: DataFrame, *keys: str) -> DataFrame:
    """128-bit digests of nodes from those of their children."""
    return rows.groupBy(*keys).agg(F.bit_xor("d").alias("d"), F.bit_xor("e").alias("e"))


def changed_buckets(rows: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """((period, leaf) of the buckets to diff, those of all buckets, bits of a leaf). `rows` has entity, period, content.

    An entity with two contents in a period gets a digest of its own there, which equals that of no other period.
    """
    bits = leaf_bits(rows.agg(F.approx_count_distinct("entity")).first()[0] or 0)
    contents = (
        rows.select(F.xxhash64("entity").alias("h1"), F.xxhash64(F.lit(7), "entity").alias("h2"), "period", F.xxhash64("content").alias("c"))
        .groupBy("h1", "h2", "period").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    )
    sole = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.xxhash64("lo", "hi", "period"))
    keys = contents.select("period", F.shiftrightunsigned("h1", 64 - bits).alias("node"), F.xxhash64("h1", "h2", sole).alias("d"), F.xxhash64(F.lit(3), "h2", "h1", sole).alias("e"))
    leaves = materialise(_digests(keys, "period", "node"), "merkle")
    depths = [0, *range(bits % STEP or STEP, bits + 1, STEP)]
    alive: DataFrame | None = None
    for above, depth in zip([0, *depths], depths, strict=False):
        level = leaves
        if alive is not None:  # only what lies below a differing node
            parents = alive.select("period", F.col("node").alias("parent"))
            level = level.withColumn("parent", F.shiftright("node", bits - above)).join(small(parents, parents.count()), ["period", "parent"], "left_semi")
        if depth < bits:
            level = _digests(level.withColumn("node", F.shiftright("node", bits - depth)), "period", "node")
        # A node has at most a row for each delivery. Where its parent is left out the node is that of the delivery before.
        before = Window.partitionBy("node").orderBy("period")
        same = F.col("d").eqNullSafe(F.lag("d").over(before)) & F.col("e").eqNullSafe(F.lag("e").over(before))
        compared = materialise(level.select("period", "node", same.alias("same")), "branches")
        alive = compared.where("not same")
        if depth < bits and 2 * alive.count() > compared.count():
            alive = None  # most branches differ: all are descended, which finds the same leaves
    alive = alive.select("period", "node")
    named = lambda x: x.select("period", F.col("node").alias("leaf"))
    return named(alive), named(leaves), bits


def in_changed_buckets(rows: DataFrame, changed: DataFrame, every: DataFrame) -> DataFrame:
    """The rows (with period and leaf) of changed buckets, told by the shorter of the lists of changed and unchanged ones."""
    n_changed, n = changed.count(), every.count()
    few, how, size = (changed, "left_semi", n_changed) if 2 * n_changed <= n else (every.join(changed, ["period", "leaf"], "left_anti"), "left_anti", n - n_changed)
    return rows.join(small(few, size), ["period", "leaf"], how)


_RUNS = T.StructType(
    [
        T.StructField("entity", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("state", T.StringType()),
        T.StructField("last", T.LongType()),
        T.StructField("until", T.LongType()),
        T.StructField("next", T.LongType()),
        T.StructField("follows", T.BooleanType()),
        T.StructField("pid", T.IntegerType()),
        T.StructField("seq", T.LongType()),
        T.StructField("edge", T.BooleanType()),
    ]
)


_ARROW = pa.schema(
    [(f.name, {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_(), "int": pa.int32()}[f.dataType.simpleString()]) for f in _RUNS.fields]
)


def _shifted(values: np.ndarray) -> np.ndarray:
    """True where a value differs from the one before it."""
    out = np.ones(len(values), dtype=bool)
    out[1:] = values[1:] != values[:-1]
    return out


def _starts(*values: np.ndarray) -> np.ndarray:
    """Where any of the values differs from the one before."""
    out = np.zeros(len(values[0]), dtype=bool)
    for v in values:
        out |= _shifted(v)
    return np.flatnonzero(out)


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """Numbers that are equal where the values are; of one batch and a row, so of a bounded size."""
    return column.combine_chunks().dictionary_encode().indices.to_numpy()


class _Scan:
    """Runs of equal state in rows that come sorted by entity and time, batch by batch; holds one row and two runs."""

    def __init__(self, only_changed: bool):
        self.only_changed, self.pid, self.seq = only_changed, TaskContext.get().partitionId(), 0
        self.row: pa.Table | None = None  # of the last entity and time, which the next batch may still replace
        self.runs: list[dict] = []  # the open run and the one before it

    def feed(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches([batch])
        if self.row is not None:
            table = pa.concat_tables([self.row, table])
        # Of rows for one entity and time the last in order holds.
        keep = np.append(_starts(_codes(table["entity"]), table["at"].to_numpy())[1:], len(table)) - 1
        self.row = table.slice(int(keep[-1]), 1)
        if len(keep) > 1:
            yield from self._add(table.take(pa.array(keep[:-1])))

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.row is not None:
            yield from self._add(self.row)
            yield pa.RecordBatch.from_pylist([run | {"pid": self.pid, "seq": self.seq + k, "edge": True} for k, run in enumerate(self.runs)], _ARROW)

    def _add(self, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """Append the rows to the open version or, where they differ from it, as new versions; yields those that are done."""
        entity = _codes(rows["entity"])
        starts = _starts(entity, _codes(rows["state"]))
        ends = np.append(starts[1:], len(rows)) - 1
        follows = np.append(False, entity[starts[1:]] == entity[starts[1:] - 1])
        firsts, lasts = rows.take(pa.array(starts)), rows.take(pa.array(ends))
        begin = firsts["at"].to_numpy()
        skip = 0
        if self.runs and self.runs[-1]["entity"] == firsts["entity"][0].as_py():
            if self.runs[-1]["state"] == firsts["state"][0].as_py():
                skip = 1
                self.runs[-1] |= {"last": lasts["at"][0].as_py(), "until": lasts["until"][0].as_py()}
            else:
                follows[0] = True
        if self.runs and len(starts) > skip and follows[skip]:
            self.runs[-1]["next"] = int(begin[skip])
        following = np.append(follows[1:], False)
        found = pa.Table.from_arrays(
            [firsts["entity"], pa.array(begin), firsts["state"], lasts["at"], lasts["until"], pa.array(np.append(begin[1:], 0), pa.int64(), mask=~following), pa.array(follows)], names=_ARROW.names[:7]
        ).slice(skip)
        done = max(0, len(found) - 2)
        earlier, self.runs = self.runs[: max(0, len(self.runs) + len(found) - 2)], (self.runs + found.slice(done).to_pylist())[-2:]
        for some in (pa.Table.from_pylist(earlier, pa.schema(list(_ARROW)[:7])), found.slice(0, done)):
            if len(some):
                seq = np.arange(self.seq, self.seq + len(some))
                self.seq += len(some)
                more = [pa.array(np.full(len(some), self.pid), pa.int32()), pa.array(seq), pa.array(seq == 0)]
                whole = pa.Table.from_arrays([*some.columns, *more], names=_ARROW.names)
                if self.only_changed:
                    whole = whole.filter((seq == 0) | some["follows"].to_numpy() | ~np.asarray(some["next"].is_null()))
                yield from whole.cast(_ARROW).combine_chunks().to_batches()


def _runs(only_changed: bool):
    """Linear pass over a sorted partition: rows -> runs of equal state."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _Scan(only_changed)
        for batch in batches:
            if batch.num_rows:
                yield from state.feed(batch)
        yield from state.close()

    return scan


def _join_edges(edges: list) -> list[tuple]:
    """Join the runs at partition cuts; `edges` come in global order, at most three a partition."""
    stack: list[dict] = []
    pid = None
    for row in edges:
        run = row.asDict()
        if row.pid != pid:  # a cut between partitions
            pid = row.pid
            if stack and stack[-1]["entity"] == run["entity"] and stack[-1]["last"] == run["start"] and stack[-1]["start"] == stack[-1]["last"]:
                void = stack.pop()  # its only row is replaced by a later one for the same time
                run["follows"] = void["follows"]
            if stack and stack[-1]["entity"] == run["entity"]:
                top = stack[-1]
                if top["state"] == run["state"]:
                    top |= {"last": run["last"], "until": run["until"], "next": run["next"]}
                    continue
                top["next"], run["follows"] = run["start"], True
        stack.append(run)
    return [(r["entity"], r["start"], r["state"], r["until"], r["next"], r["follows"]) for r in stack]


def version_history(
    rows: DataFrame,
    *,
    entity: Column,
    at: Column,
    state: Sequence[Column],
    latest_by: Sequence[Column],
    until: Column | None = None,
    period: Column | None = None,
    only_changed: bool = False,
) -> DataFrame:
    """Versions (entity, valid_from, valid_to, state, changed) of each entity's attributes.

    entity: text key; at: time from which a row holds; state: attributes to follow; latest_by: of several rows for one
    entity and time the one largest in these holds (nulls lowest); until: end stated by a row, used for the last version
    if it lies after the row's `at`; period: the delivery a row belongs to (default: `at`); only_changed: leave out
    entities with a single version. `changed` tells whether the entity has other versions.

    Times are microseconds as BIGINT; valid_to is null while open. Rows without entity or `at` have no place in a
    history and are left out; a null attribute is a value of its own; exact repeats change nothing; an empty table
    gives an empty history; other columns of `rows`, whatever their names, are not looked at.
    """
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    base = rows.select(
        entity.alias("entity"),
        micros(at).alias("at"),
        state_text(*state).alias("state"),
        (micros(until) if until is not None else F.lit(None).cast("bigint")).alias("stated"),
        *[c.alias(f"by{i}") for i, c in enumerate(latest_by)],
        F.coalesce((period if period is not None else at).cast("string"), F.lit("")).alias("period"),
    ).where(F.col("entity").isNotNull() & F.col("at").isNotNull())
    base = base.withColumn("until", F.when(F.col("stated") > F.col("at"), F.col("stated"))).drop("stated")
    changed, every, bits = changed_buckets(base.select("entity", "period", state_text(F.col("state"), F.col("until")).alias("content")))
    order = ["entity", "at", *[F.col(f"by{i}").asc_nulls_first() for i in range(len(latest_by))]]
    alive = in_changed_buckets(base.withColumn("leaf", leaf_of(F.col("entity"), bits)), changed, every)
    ordered = alive.select("entity", "at", "state", "until", *[f"by{i}" for i in range(len(latest_by))]).repartitionByRange(*order).sortWithinPartitions(*order)
    runs = materialise(ordered.select("entity", "at", "state", "until").mapInArrow(_runs(only_changed), _RUNS), "runs")
    edges = runs.where("edge").orderBy("pid", "seq").collect()  # three rows a partition at most
    joined = runs.sparkSession.createDataFrame(_join_edges(edges), "entity string, start bigint, state string, until bigint, next bigint, follows boolean")
    inner = runs.where("not edge").select("entity", "start", "state", "until", "next", "follows")
    found = inner.unionByName(joined).select(
        "entity",
        F.col("start").alias("valid_from"),
        F.coalesce("next", "until").alias("valid_to"),
        "state",
        (F.col("follows") | F.col("next").isNotNull()).alias("changed"),
    )
    return found.where("changed") if only_changed else found


def append_snapshot(history: DataFrame, snapshot: DataFrame, key: str, attributes: Sequence[str], at: Column) -> DataFrame:
    """History (key, attributes, valid_from, valid_to) after one more full or partial snapshot.

    Open versions whose attributes the snapshot changes are closed at `at`, new ones are opened; keys that the snapshot
    lacks stay open. Keys with null or repeated rows in the snapshot: null keys are ignored, of repeats the largest
    attributes hold. Only leaves that differ between the snapshot and the open versions of its leaves are diffed; closed
    versions are passed through unread.
    """
    one = snapshot.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*attributes)).alias("_n"))
    bits = leaf_bits(snapshot.agg(F.approx_count_distinct(key)).first()[0])
    given = lambda side: state_text(*[F.col(f"{side}.{a}") for a in attributes])
    news = one.select(F.col(key).alias("_k"), "_n", leaf_of(F.col(key), bits).alias("_leaf"))
    open_now = history.where(F.col("valid_to").isNull()).withColumn("_leaf", leaf_of(F.col(key), bits))
    held = open_now.select(F.col(key).alias("_k"), F.struct(*attributes).alias("_o"), "_leaf")
    digest = lambda d, side: d.groupBy("_leaf").agg(F.bit_xor(F.xxhash64("_k", given(side))).alias("d"), F.bit_xor(F.xxhash64(F.lit(3), "_k", given(side))).alias("e"))
    # Leaves that the snapshot lacks have nothing to say.
    both = digest(news, "_n").join(digest(held, "_o").select("_leaf", F.col("d").alias("od"), F.col("e").alias("oe")), "_leaf", "left")
    differing = both.where(~(F.col("d").eqNullSafe(F.col("od")) & F.col("e").eqNullSafe(F.col("oe")))).select("_leaf")
    changes = news.join(differing, "_leaf", "left_semi").join(held.drop("_leaf"), "_k", "left").where(F.col("_o").isNull() | (given("_o") != given("_n")))
    changes = materialise(changes.select("_k", "_n", F.col("_o").isNotNull().alias("_closes")), "appended")
    closing = changes.where("_closes").select(F.col("_k").alias(key), F.lit(True).alias("_closed"))
    kept = open_now.drop("_leaf").join(closing, key, "left").withColumn("valid_to", F.when(F.col("_closed"), at).otherwise(F.col("valid_to"))).select(*history.columns)
    opened = changes.select(F.col("_k").alias(key), *[F.col("_n")[a].alias(a) for a in attributes], at.alias("valid_from"), F.lit(None).cast(history.schema["valid_to"].dataType).alias("valid_to"))
    return history.where(F.col("valid_to").isNotNull()).unionByName(kept).unionByName(opened.select(*history.columns))
