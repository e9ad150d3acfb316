"""The job state machine: rules one by one, and the stream against a plain fold over all events, however they are cut into batches."""

import os
import random
from pathlib import Path

import pytest

from docloom.streaming import lifecycle as L

HOUR = 3_600_000
SCHEMA = "entity string, ts timestamp, event_id long, kind string, version string, fingerprint string, stage string"


def play(*events):
    job, out = L.Job(), []
    for n, (at, kind, *rest) in enumerate(events):
        version, fingerprint, stage = (*rest, None, None, None)[:3]
        out += list(L.apply(job, "e", {"event_id": n, "at": at * HOUR, "kind": kind, "version": version, "fingerprint": fingerprint, "stage": stage}))
    return job, [(r["seq"], r["status"], r["stage"], r["reason"]) for r in out]


def test_rules():
    job, out = play((0, "enqueue", "v1", "f"), (1, "enqueue", "v1", "f"), (1, "enqueue", "v1", None), (2, "claim"), (3, "claim"), (3, "done", "v0"), (3, "done", "v1", None, "embedding"), (3, "done", "v1", None, "chunking"), (4, "done"), (4, "failed", "v1"), (5, "done", "v1"))
    assert out == [
        (1, "pending", None, "enqueued"), (1, "pending", None, "reused"), (1, "cancelled", None, "superseded by a new job"), (2, "pending", None, "enqueued"), (2, "processing", None, "claimed"),
        (2, "processing", None, "superseded event"), (2, "processing", "chunking", "stage done"), (2, "processing", "embedding", "stage done"), (2, "failed", "indexing", "stage failed"), (2, "skipped", "analysis", "after a failure"), (2, "skipped", "linking", "after a failure"),
    ]
    job, out = play((0, "enqueue", "a"), (0, "claim"), *[(1, "done") for _ in range(6)])
    assert job.status == "completed" and [o[2] for o in out][2:] == list(L.STAGES)
    job, out = play((0, "enqueue", "a"), (0, "claim"), (7, "claim"), (14, "claim"), (21, "claim"))
    assert [o[1] for o in out] == ["pending", "processing", "pending", "processing", "pending", "processing", "failed"] and job.status == "failed"
    job, out = play((0, "follow", "a"), (1, "follow", "a"), (2, "followed", "a"), (2, "followed", "a"), (3, "follow", "a"), (4, "follow", None))
    assert [o[3] for o in out] == ["follow-up of a started", "follow-up of a ended", "follow-up of a started"]


def test_replays_and_late_events_change_nothing():
    job, e = L.Job(), {"event_id": 5, "at": 10, "kind": "enqueue", "version": "v", "fingerprint": None, "stage": None}
    assert len(list(L.apply(job, "e", e))) == 1
    before = str(job)
    assert list(L.apply(job, "e", e)) == [] and list(L.apply(job, "e", e | {"at": 9, "event_id": 9})) == [] and str(job) == before


def events(n=1500):
    r = random.Random(7)
    rows, at = [], 0
    for i in range(n):
        at += r.randrange(0, 8 * 60_000)
        rows.append((f"e{r.randrange(25)}", at, i, r.choice(["enqueue", "claim", "claim", "done", "done", "done", "failed", "follow", "followed"]), r.choice(["v1", "v1", "v2", None]), r.choice(["f", "g", None]), None))
    return [*rows, ("last", at + 100 * HOUR, n, "enqueue", "v", None, None), ("last", at + 101 * HOUR, n + 1, "claim", None, None, None)]


@pytest.mark.parametrize("parts", [1, 6])
def test_stream_equals_a_fold_over_all_events(spark, tmp_path, parts):
    rows = events()
    state, want = {}, []
    for e, at, i, kind, version, fingerprint, stage in rows:
        want += list(L.apply(state.setdefault(e, L.Job()), e, {"event_id": i, "at": at, "kind": kind, "version": version, "fingerprint": fingerprint, "stage": stage}))
    for e, job in state.items():  # by the watermark after the last event all other leases have run out
        want += list(L.expire(job, e, rows[-1][1] - 600_000))
    size = -(-len(rows) // parts)
    for p in range(parts):
        part = [(e, *x) for e, *x in rows[p * size : (p + 1) * size]]
        part += part[:3] + rows[max(0, p * size - 5) : p * size]  # replays within the batch, and of the batch before
        df = spark.createDataFrame(part, "entity string, at long, event_id long, kind string, version string, fingerprint string, stage string")
        df.selectExpr("entity", "timestamp_millis(at) as ts", "event_id", "kind", "version", "fingerprint", "stage").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        for f in Path(f"{tmp_path}/in").glob("part-*"):
            if f.stat().st_mtime > 1_700_000_000:
                os.utime(f, (1_600_000_000 + 100 * p,) * 2)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    L.run(spark, stream, f"{tmp_path}/out", f"{tmp_path}/check")
    out = spark.read.schema(L.OUTPUT).parquet(f"{tmp_path}/out")
    got = sorted(repr(tuple(r)) for r in out.collect())
    assert got == sorted(repr(tuple(w[k] for k in ("entity", "seq", "version", "status", "stage", "reason", "at", "event_id"))) for w in want)
    status = {r.entity: (r.seq, r.status) for r in L.current(out).collect()}
    assert status == {e: (j.seq, j.status) for e, j in state.items() if j.seq}
    L.run(spark, stream, f"{tmp_path}/out", f"{tmp_path}/check")  # nothing new has arrived
    assert spark.read.schema(L.OUTPUT).parquet(f"{tmp_path}/out").count() == len(got)
