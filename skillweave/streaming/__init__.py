"""Streaming forms of the incremental operations: resumable intake, idempotent merges, change detection, histories."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from skillweave.operators.upsert import upsert


def read_new_files(spark: SparkSession, folder: str, schema: str | StructType, kind: str = "parquet", files_per_batch: int = 100) -> DataFrame:
    """Files that arrive in a folder; what earlier runs took is known from the checkpoint."""
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(folder)


class VersionedTable:
    """A Parquet table of immutable files; a numbered pointer names those of each version, and the highest one is current.

    A version exists once its pointer has been renamed into place, which is one step: a failure before leaves the version
    before current, and readers never see half a merge. Rows lie in `buckets` by the hash of `keys`; a merge rewrites the
    buckets that its rows fall into, the others go on as they are. Files that neither the current version nor the one
    before names are deleted, so a reader has one more batch's time.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, keys: Sequence[str] = (), buckets: int = 16):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, list(keys), buckets if keys else 1

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, prefix: str) -> list[str]:
        _, at, fs = self._fs()
        return sorted(x.getPath().getName() for x in fs.listStatus(at) if x.getPath().getName().startswith(prefix)) if fs.exists(at) else []

    def _manifest(self, pointer: str) -> dict[str, str]:
        """Folder of each bucket in a version; '' stands for a table that isn't in buckets."""
        lines = [r[0] for r in self.spark.read.text(f"{self.path}/{pointer}").collect()]
        return dict(reversed(line.split("\t")) for line in lines if line)

    def current(self) -> tuple[dict[str, str], int]:
        """(folders by bucket, last batch) of the current version."""
        pointers = self._names("pointer-")
        return (self._manifest(pointers[-1]), int(pointers[-1].split("-")[1])) if pointers else ({}, -1)

    def _rows(self, folders: Sequence[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._rows(sorted(self.current()[0].values()))

    def _commit(self, manifest: Mapping[str, str], batch: int) -> None:
        jvm, _, fs = self._fs()
        staged = jvm.org.apache.hadoop.fs.Path(f"{self.path}/next-{uuid.uuid4().hex[:8]}")
        out = fs.create(staged, True)
        out.write(bytearray("\n".join(f"{folder}\t{bucket}" for bucket, folder in sorted(manifest.items())).encode()))
        out.close()
        if not fs.rename(staged, jvm.org.apache.hadoop.fs.Path(f"{self.path}/pointer-{batch:020d}")):
            raise OSError(f"batch {batch} of {self.path} was committed already")
        self._tidy()

    def _tidy(self) -> None:
        jvm, _, fs = self._fs()
        pointers = self._names("pointer-")
        used = {folder.removeprefix(f"{self.path}/").split("/")[0] for p in pointers[-2:] for folder in self._manifest(p).values()}
        for name in [*pointers[:-2], *(v for v in self._names("v-") if v not in used)]:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"), True)

    def replace(self, rows: DataFrame, batch: int) -> None:
        """The whole table anew."""
        folder = f"{self.path}/v-{batch}-{uuid.uuid4().hex[:8]}"
        rows.write.parquet(folder)
        self._commit({"": folder}, batch)

    def merge(self, rows: DataFrame, batch: int, policy: Mapping[str, str], arrival: Sequence[Column] | None = None, newer: Sequence[str] | None = None) -> None:
        """`rows` upserted by the table's keys; null matches null."""
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        folders = self.current()[0]
        touched = sorted(str(r.b) for r in rows.select(bucket.alias("b")).distinct().collect())  # as many as there are buckets
        if not touched:
            self._commit(folders, batch)
            return
        merged = upsert(self._rows([folders[b] for b in touched if b in folders]), rows, self.keys, policy, arrival, newer)
        folder = f"{self.path}/v-{batch}-{uuid.uuid4().hex[:8]}"
        merged.withColumn("bucket", bucket).write.partitionBy("bucket").parquet(folder)
        self._commit(folders | {b: f"{folder}/bucket={b}" for b in touched}, batch)


def merge_stream(stream: DataFrame, table: VersionedTable, policy: Mapping[str, str], checkpoint: str, arrival: Callable[[], Sequence[Column]] | None = None, newer: Sequence[str] | None = None) -> StreamingQuery:
    """Every batch is upserted once: a batch that is delivered again after a failure is recognised by its number.

    `arrival` orders the rows of one batch; with `newer` a row of a later batch only counts if it comes later by these columns too.
    """

    def apply(batch: DataFrame, number: int) -> None:
        if number > table.current()[1]:
            table.merge(batch, number, policy, arrival() if arrival else None, newer)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replace_stream(counted: DataFrame, table: VersionedTable, checkpoint: str) -> StreamingQuery:
    """The whole result of a streaming aggregation replaces the table after every batch; batches delivered again are skipped."""

    def apply(result: DataFrame, number: int) -> None:
        if number > table.current()[1]:
            table.replace(result, number)

    return counted.writeStream.foreachBatch(apply).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def changed_content(stream: DataFrame, key: str, content: str) -> DataFrame:
    """(key, digest, deliveries) of each delivery whose content differs from the key's last one."""

    def detect(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, n = state.get if state.exists else (None, 0)
        out = []
        for pdf in batches:
            for d in pdf["digest"]:
                n += 1
                if d != last:
                    out.append((k[0], d, n))
                    last = d
        state.update((last, n))
        yield pd.DataFrame(out, columns=["key", "digest", "deliveries"])

    digested = stream.select(F.col(key).cast("string").alias("key"), F.md5(F.coalesce(F.col(content).cast("string"), F.lit("\x00"))).alias("digest"))
    return digested.groupBy("key").applyInPandasWithState(detect, "key string, digest string, deliveries int", "last string, n int", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(stream: DataFrame, at: str, group: str, value: str, length: str = "1 hour", slide: str | None = None, late: str | None = "10 minutes") -> DataFrame:
    """(window_start, group, n, total) by event time; rows later than `late` are dropped by the watermark.

    Without `late` no row is dropped however late it comes, every window stays in the state, and a column `last` has the
    time of the window's last row; meant for output modes update and complete.
    """
    window = F.window(at, length, slide) if slide else F.window(at, length)
    held, last = (stream.withWatermark(at, late), []) if late else (stream, [F.max(at).alias("last")])
    counted = held.groupBy(window.alias("w"), group).agg(F.count("*").alias("n"), F.sum(value).alias("total"), *last)
    return counted.select(F.col("w.start").alias("window_start"), *[c for c in counted.columns if c != "w"])


def first_deliveries(stream: DataFrame, keys: Sequence[str], at: str, late: str = "1 day") -> DataFrame:
    """Each key once within the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(list(keys))
