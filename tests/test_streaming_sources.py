import json
import os
from pathlib import Path

from pyspark.sql import functions as F

from docloom.plans import catalog
from docloom.session import table
from docloom.sources import records
from docloom.streaming import jobs


def feed(spark, small, tmp_path, parts=5):
    """Events in parts that arrive in the order of their time, one file a trigger."""
    events = table(spark, small, "events").repartitionByRange(parts, "ts").sortWithinPartitions("ts")
    events.write.parquet(f"{tmp_path}/in")
    for age, part in enumerate(sorted(Path(f"{tmp_path}/in").glob("part-*"))):  # a file source reads the oldest file first
        os.utime(part, (1_600_000_000 + 100 * age,) * 2)
    return events, jobs.read_events(spark, f"{tmp_path}/in", events.schema.simpleString()[7:-1].replace(":", " "), 1)


def test_latest_state_of_stream_equals_batch(spark, small, tmp_path):
    _, stream = feed(spark, small, tmp_path)
    last = jobs.run_available(stream, f"{tmp_path}/check", jobs.merge_latest(spark, f"{tmp_path}/state", "user_id", "ts", "event_id"))
    got = spark.read.parquet(f"{tmp_path}/state/v{last}").select("user_id", F.col("event_type").alias("state"), "event_id").collect()
    want = catalog.queries()["latest_job_state"](spark, small).collect()
    assert last >= 3 and sorted(got) == sorted(want)


def collect_stream(spark, df, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/c-{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_tumbling_windows_equal_batch_up_to_the_watermark(spark, small, tmp_path):
    _, stream = feed(spark, small, tmp_path)
    got = {tuple(r) for r in collect_stream(spark, jobs.tumbling(stream, ["event_type"]), tmp_path, "tumbled").collect()}
    want = {(r.window_start, r.event_type, r.n) for r in catalog.queries()["event_tumbling"](spark, small).collect()}
    assert got and len(want - got) < len(want) / 2
    newest = max(w for w, *_ in want)
    assert got <= want or all(w >= newest or (w, t, n) in want for w, t, n in got)


def test_late_events_are_dropped(spark, tmp_path):
    """An event older than the watermark of what came before changes no window."""
    rows = [[(1, "2024-01-01 00:05:00", "a")], [(2, "2024-01-01 03:00:00", "a")], [(4, "2024-01-01 03:10:00", "a")], [(3, "2024-01-01 00:06:00", "a")], [(5, "2024-01-01 09:00:00", "a")]]
    for age, part in enumerate(rows):
        spark.createDataFrame(part, "event_id long, ts string, event_type string").selectExpr("event_id", "cast(ts as timestamp) ts", "event_type").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        for f in Path(f"{tmp_path}/in").glob("part-*"):
            if f.stat().st_mtime > 1_700_000_000:
                os.utime(f, (1_600_000_000 + 100 * age,) * 2)
    stream = jobs.read_events(spark, f"{tmp_path}/in", "event_id long, ts timestamp, event_type string", 1)
    got = {(r.window_start.hour, r.n) for r in collect_stream(spark, jobs.tumbling(stream, ["event_type"]), tmp_path, "late").collect()}
    assert got == {(0, 1), (3, 2)}


def test_stream_deduplicates(spark, small, tmp_path):
    events, _ = feed(spark, small, tmp_path)
    twice = events.union(events)
    twice.coalesce(1).write.parquet(f"{tmp_path}/twice")
    stream = jobs.read_events(spark, f"{tmp_path}/twice", "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    assert collect_stream(spark, jobs.deduplicate(stream, ["event_id"]), tmp_path, "once").count() == events.count()


def test_records_are_unwrapped(spark, tmp_path):
    rows = [{"id": 1, "name": "a"}, {"id": 2, "name": None}]
    for k, text in enumerate([json.dumps(rows), json.dumps({"data": rows}), "\n".join(map(json.dumps, rows)) + "\n"]):
        (tmp_path / f"{k}.json").write_text(text)
        got = records.read_records(spark, str(tmp_path / f"{k}.json"), "id long, name string").collect()
        assert [tuple(r) for r in got] == [(1, "a"), (2, None)], k


def test_texts_keep_bad_bytes_out(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("gut größe ".encode() + b"\xff!")
    assert records.read_texts(spark, str(tmp_path)).first().text == "gut größe �!"


def test_partitions_are_replaced(spark, tmp_path):
    path = f"{tmp_path}/p"
    records.write_partitioned(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), path, ["k"])
    records.write_partitioned(spark.createDataFrame([("b", 3)], "k string, v int"), path, ["k"])
    assert {(r.k, r.v) for r in spark.read.parquet(path).collect()} == {("a", 1), ("b", 3)}
