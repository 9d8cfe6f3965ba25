"""The best N rows of every group by a global sort.

The rows are range-partitioned and sorted by (group, order keys, identifier), so that a group of any size is spread
over as many partitions as it fills. Each partition numbers its own rows of a group batch by batch and keeps the first N;
the number of rows of its last group, which may go on in the next partition, is prefix-summed into exact positions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_digest(columns: Sequence[str]) -> list[Column]:
    """128 bits that stand for the content of a row; nulls count by place."""
    nulls = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in columns])
    return [F.xxhash64(nulls, *columns).alias("_d1"), F.xxhash64(F.lit(11), *reversed(columns), nulls).alias("_d2")]


def distinct_rows(rows: DataFrame, id_col: str, keep: Sequence[str]) -> DataFrame:
    """Rows equal in everything but `id_col` as one, with the smallest id and the columns `keep`.

    Null equals null; maps, which can't be hashed, compare by their JSON.
    """
    maps = [c for c, kind in rows.dtypes if "map<" in kind and c not in keep]
    rows = rows.withColumns({c: F.to_json(F.struct(c)) for c in maps}) if maps else rows
    others = [c for c in rows.columns if c != id_col]
    return rows.select(*keep, id_col, *row_digest(others)).groupBy(*keep, "_d1", "_d2").agg(F.min(id_col).alias(id_col)).drop("_d1", "_d2")


def _local_ranks(n: int):
    """First n rows of each group in a sorted partition, numbered, and the size of its last group, which may go on in the next."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, last, size = TaskContext.get().partitionId(), None, 0  # the group at the end of the batch before, and its rows so far
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column("g")
            group = values.dictionary_encode(null_encoding="encode").indices.to_numpy()
            starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            sizes = np.diff(np.append(starts, len(group)))
            before = np.zeros(len(starts), dtype=np.int64)
            if last is not None and last[0].as_py() == values[0].as_py():
                before[0] = size
            rank = np.arange(len(group)) - np.repeat(starts - before, sizes) + 1
            keep = np.flatnonzero(rank <= n)
            last, size = values.slice(len(group) - 1, 1), int(before[-1] + sizes[-1])
            yield _ranked(values.take(pa.array(keep)), batch.column("id").take(pa.array(keep)), pa.array(rank[keep], pa.int64()), 0, pid)
        if last is not None:
            yield _ranked(last, pa.nulls(1, batch.column("id").type), pa.nulls(1, pa.int64()), size, pid)

    return scan


def _ranked(g: pa.Array, ids: pa.Array, rank: pa.Array, count: int, pid: int) -> pa.RecordBatch:
    more = [pa.array(np.full(len(g), count), pa.int64()), pa.array(np.full(len(g), pid), pa.int32())]
    return pa.RecordBatch.from_arrays([g, ids, rank, *more], names=["g", "id", "rank", "count", "pid"])


def top_n(rows: DataFrame, *, group: str, order: Sequence[Column], n: int, id_col: str) -> DataFrame:
    """(group, id, position) of the first `n` rows of each group by `order`, then by `id_col` ascending.

    order: sort columns with their direction and null placing (Spark's default puts nulls first when ascending).
    Ties end with the identifier, so the result is the same however the rows lie; repeated identifiers are rows of
    their own. A null group is a group. Fewer than `n` rows give what there is; an empty table or n < 1 gives none.
    Other columns, also ones named like the result's, are not looked at.
    """
    kind, id_kind = rows.schema[group].dataType, rows.schema[id_col].dataType
    keyed = rows.select(F.col(group).alias("g"), F.col(id_col).alias("id"), *[F.struct(_bare(c).alias("v")).alias(f"k{i}") for i, c in enumerate(order)])
    by = ["g", *[_directed(c, F.col(f"k{i}.v")) for i, c in enumerate(order)], "id"]
    ordered = keyed.repartitionByRange(*by).sortWithinPartitions(*by).select("g", "id")
    schema = f"g {kind.simpleString()}, id {id_kind.simpleString()}, rank bigint, count bigint, pid int"
    local = ordered.mapInArrow(_local_ranks(n), schema)
    # At most n rows a group and partition meet here, however large the group is, and a count a partition.
    earlier = Window.partitionBy("g").orderBy("pid").rangeBetween(Window.unboundedPreceding, -1)
    placed = local.withColumn("position", F.col("rank") + F.coalesce(F.sum("count").over(earlier), F.lit(0)))
    return placed.where(F.col("position") <= n).select(F.col("g").alias(group), F.col("id").alias(id_col), "position")


class Key:
    """A sort column with its direction."""

    def __init__(self, column: Column, ascending: bool = True, nulls_first: bool | None = None):
        self.column, self.ascending = column, ascending
        self.nulls_first = ascending if nulls_first is None else nulls_first


def _bare(key: Key | Column) -> Column:
    return key.column if isinstance(key, Key) else key


def _directed(key: Key | Column, column: Column) -> Column:
    if not isinstance(key, Key):
        return column.asc_nulls_first()
    if key.ascending:
        return column.asc_nulls_first() if key.nulls_first else column.asc_nulls_last()
    return column.desc_nulls_first() if key.nulls_first else column.desc_nulls_last()
