from datetime import datetime, timedelta

import pytest

from skillweave import streaming
from skillweave.plans import streams

SCHEMA = "k string, v string, n int, at timestamp"
T0 = datetime(2024, 1, 1)


def write(spark, folder, rows, name):
    spark.createDataFrame([(k, v, n, T0 + timedelta(minutes=m)) for k, v, n, m in rows], SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def run(stream, name, checkpoint):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(checkpoint)).start()
    q.processAllAvailable()
    q.stop()


def test_merge_stream_resumes(spark, tmp_path):
    folder = tmp_path / "in"
    table = streaming.VersionedTable(spark, str(tmp_path / "table"), SCHEMA, ["k"])
    write(spark, folder, [("a", "1", 1, 0), ("b", "1", 5, 0)], "one")
    go = lambda: streaming.merge_stream(streaming.read_new_files(spark, str(folder), SCHEMA), table, {"v": "overwrite", "n": "greatest"}, str(tmp_path / "cp")).awaitTermination()
    go()
    write(spark, folder, [("b", "2", 3, 1), ("c", "1", 1, 1)], "two")
    go()
    go()
    assert {(r.k, r.v, r.n) for r in table.read().collect()} == {("a", "1", 1), ("b", "2", 5), ("c", "1", 1)}
    assert table.current()[1] == 1


def test_failure_between_write_and_pointer_loses_nothing(spark, tmp_path, monkeypatch):
    table = streaming.VersionedTable(spark, str(tmp_path / "table"), SCHEMA, ["k"], buckets=4)
    rows = lambda *r: spark.createDataFrame([(k, v, n, T0) for k, v, n in r], SCHEMA)
    held = lambda: {(r.k, r.v) for r in table.read().collect()}
    table.merge(rows(*((f"k{i}", "1", 1) for i in range(20))), 0, {"v": "overwrite"})
    before = held()
    commit = streaming.VersionedTable._commit

    def fails(*_):
        raise OSError("lost")

    monkeypatch.setattr(streaming.VersionedTable, "_commit", fails)
    with pytest.raises(OSError, match="lost"):
        table.merge(rows(("k1", "2", 1)), 1, {"v": "overwrite"})
    assert held() == before and table.current()[1] == 0
    monkeypatch.setattr(streaming.VersionedTable, "_commit", commit)
    table.merge(rows(("k1", "2", 1)), 1, {"v": "overwrite"})
    assert held() == before - {("k1", "1")} | {("k1", "2")}
    with pytest.raises(OSError, match="already"):
        table._commit(table.current()[0], 1)


def test_merges_rewrite_the_buckets_they_touch(spark, tmp_path):
    table = streaming.VersionedTable(spark, str(tmp_path / "table"), SCHEMA, ["k"], buckets=4)
    rows = lambda *r: spark.createDataFrame([(k, v, n, T0) for k, v, n in r], SCHEMA)
    table.merge(rows(*((f"k{i}", "1", 1) for i in range(20))), 0, {"v": "overwrite"})
    first = table.current()[0]
    for batch in (1, 2, 3):
        table.merge(rows(("k1", str(batch), 1)), batch, {"v": "overwrite"})
    assert sum(first[b] != f for b, f in table.current()[0].items()) == 1
    assert table.read().count() == 20 and len(table._names("pointer-")) == 2 and len(table._names("v-")) == 3
    table.merge(rows(), 4, {"v": "overwrite"})
    assert table.read().count() == 20 and table.current()[1] == 4


def test_changed_content(spark, tmp_path):
    folder = tmp_path / "in"
    for i, v in enumerate(["x", "x", "y", "x"]):
        write(spark, folder, [("a", v, i, i)], str(i))
    stream = streaming.changed_content(streaming.read_new_files(spark, str(folder), SCHEMA, files_per_batch=1), "k", "v")
    run(stream, "changes", tmp_path / "cp")
    assert sorted(r.deliveries for r in spark.table("changes").collect()) == [1, 3, 4]


def test_windows_and_late_rows(spark, tmp_path):
    folder = tmp_path / "in"
    write(spark, folder, [("a", "x", 1, 5), ("a", "x", 2, 20)], "1")
    write(spark, folder, [("a", "x", 4, 200)], "2")
    write(spark, folder, [("a", "x", 5, 201)], "3")
    write(spark, folder, [("a", "x", 8, 6), ("a", "x", 0, 400)], "4")  # the first is too late
    stream = streaming.windowed_counts(streaming.read_new_files(spark, str(folder), SCHEMA, files_per_batch=1), "at", "k", "n")
    run(stream, "windows", tmp_path / "cp")
    found = {(r.window_start.hour, r.n, r.total) for r in spark.table("windows").collect()}
    assert (0, 2, 3) in found and (3, 2, 9) in found


def test_first_deliveries(spark, tmp_path):
    folder = tmp_path / "in"
    write(spark, folder, [("a", "x", 1, 0)], "1")
    write(spark, folder, [("a", "x", 1, 1), ("b", "x", 1, 1)], "2")
    run(streaming.first_deliveries(streaming.read_new_files(spark, str(folder), SCHEMA, files_per_batch=1), ["k", "v"], "at"), "firsts", tmp_path / "cp")
    assert sorted(r.k for r in spark.table("firsts").collect()) == ["a", "b"]


def test_queries_over_files_out_of_time_order(spark, tmp_path):
    """Newest file first, each file over all hours, a file a batch: the same as over the whole table."""
    events = [(i, i % 3, T0 + timedelta(minutes=i), "ab"[i % 2], float(i)) for i in range(240)]
    schema = "event_id bigint, user_id bigint, ts timestamp_ntz, event_type string, value double"
    for n in (4, 3, 2, 1, 0):
        spark.createDataFrame([e for e in events if e[0] % 5 == n], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    found = streams.streamed_latest(spark, str(tmp_path), files=1)
    assert sorted((r.user_id, r.event_id) for r in found.collect()) == [(0, 237), (1, 238), (2, 239)]
    found = streams.streamed_windows(spark, str(tmp_path), files=1)
    assert sorted((r.window_start.hour, r.event_type, r.n) for r in found.collect()) == [(h, t, 30) for h in range(3) for t in "ab"]
    total = {(r.window_start.hour, r.event_type): r.total for r in found.collect()}
    assert total[0, "a"] == sum(range(0, 60, 2))
