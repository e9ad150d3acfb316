"""Jobs of entities as a keyed state machine on a stream of events.

Each entity has one current job: pending, processing, then completed, failed or cancelled, and while it is processed a number of stages. The state store keeps that
one job and the place of the last event applied, so state grows with entities and not with events. Rules:

- enqueue: an open job of the same version and the same fingerprint (not null) is reused; else an open one is cancelled and a new one is pending.
- claim: a pending job is processing; one that is processing already is not claimed again. It has LEASE to get on.
- done: the job's next stage is completed if the event names it and the job's version; after the last one the job is completed.
  An event of another version is superseded and changes nothing.
- failed: the job has failed, and the stages after are skipped.
- A lease that runs out puts the job back to pending, ATTEMPTS times; then it has failed. Each stage done renews it.
- follow: a follow-up of a version is started unless one is on its way; followed ends it.

Leases run on event time: an event later than a deadline first lets the lease run out, and a timer does so for entities of which nothing more arrives. So what comes out
doesn't depend on how events are cut into batches. Events not later than the last one applied (by time, then id) are replays or late and are ignored.
Every transition is a row; rerun from its checkpoint, a batch gives the same rows once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STAGES = ("chunking", "embedding", "indexing", "analysis", "linking")
LEASE_MS, ATTEMPTS = 6 * 3_600_000, 2
OUTPUT = "entity string, seq long, version string, status string, stage string, reason string, at long, event_id long"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass
class Job:
    """An entity's state."""

    seq: int = 0
    version: str | None = None
    fingerprint: str | None = None
    status: str = "none"
    stage: int = 0
    attempts: int = 0
    deadline: int | None = None
    last: list[int] = field(default_factory=lambda: [-(2**62), 0])
    following: list[str] = field(default_factory=list)


def _row(job: Job, entity: str, reason: str, at: int, event_id: int | None, status: str | None = None, stage: str | None = None) -> dict:
    return {"entity": entity, "seq": job.seq, "version": job.version, "status": status or job.status, "stage": stage, "reason": reason, "at": at, "event_id": event_id}


def expire(job: Job, entity: str, now: int) -> Iterator[dict]:
    """A lease that has run out by now."""
    if job.status == "processing" and job.deadline is not None and job.deadline < now:
        at, job.deadline = job.deadline, None
        job.attempts += 1
        job.status = "failed" if job.attempts > ATTEMPTS else "pending"
        yield _row(job, entity, "lease ran out", at, None)


def apply(job: Job, entity: str, e: dict) -> Iterator[dict]:
    """One event: changes the job and gives the transitions. e: event_id, at (milliseconds), kind, version, fingerprint, stage."""
    place = [e["at"], e["event_id"]]
    if place <= job.last:
        return
    yield from expire(job, entity, e["at"])
    job.last = place
    kind, version, at, number = e["kind"], e["version"], e["at"], e["event_id"]
    if kind == "enqueue":
        is_open = job.status in ("pending", "processing")
        if is_open and job.version == version and job.fingerprint is not None and job.fingerprint == e["fingerprint"]:
            yield _row(job, entity, "reused", at, number)
            return
        if is_open:
            yield _row(job, entity, "superseded by a new job", at, number, "cancelled")
        job.seq, job.version, job.fingerprint, job.status, job.stage, job.attempts, job.deadline = job.seq + 1, version, e["fingerprint"], "pending", 0, 0, None
        yield _row(job, entity, "enqueued", at, number)
    elif kind == "claim" and job.status == "pending":
        job.status, job.deadline = "processing", at + LEASE_MS
        yield _row(job, entity, "claimed", at, number)
    elif kind in ("done", "failed") and job.status == "processing":
        if version is not None and version != job.version:
            yield _row(job, entity, "superseded event", at, number)
        elif kind == "failed":
            job.status, job.deadline = "failed", None
            yield _row(job, entity, "stage failed", at, number, stage=STAGES[job.stage])
            for s in STAGES[job.stage + 1 :]:
                yield _row(job, entity, "after a failure", at, number, "skipped", s)
        elif e["stage"] in (None, STAGES[job.stage]):
            done = STAGES[job.stage]
            job.stage, job.deadline = job.stage + 1, at + LEASE_MS
            if job.stage == len(STAGES):
                job.status, job.deadline = "completed", None
            yield _row(job, entity, "stage done", at, number, stage=done)
    elif kind == "follow" and version is not None and version not in job.following:
        job.following.append(version)
        yield _row(job, entity, f"follow-up of {version} started", at, number)
    elif kind == "followed" and version in job.following:
        job.following.remove(version)
        yield _row(job, entity, f"follow-up of {version} ended", at, number)


class Lifecycle(StatefulProcessor):
    """The state machine of one entity; its state is one JSON value."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "job string")

    def _load(self) -> Job:
        return Job(**json.loads(self.state.get()[0])) if self.state.exists() else Job()

    def _save(self, job: Job, before: int | None) -> None:
        self.state.update((json.dumps(asdict(job)),))
        if before is not None and before != job.deadline:
            self.handle.deleteTimer(before + 1)
        if job.deadline is not None and before != job.deadline:
            self.handle.registerTimer(job.deadline + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        job, entity = self._load(), key[0]
        before = job.deadline
        events = sorted((r.asDict() for r in rows), key=lambda e: (e["at"], e["event_id"]))  # one entity's events of one batch
        out = [x for e in events for x in apply(job, entity, e)]
        self._save(job, before)
        yield from (Row(**x) for x in out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        job, entity = self._load(), key[0]
        out = list(expire(job, entity, expiredTimerInfo.getExpiryTimeInMs()))
        if out:
            self.state.update((json.dumps(asdict(job)),))
        yield from (Row(**x) for x in out)

    def close(self) -> None:
        pass


def lifecycle(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The transitions of a stream of (entity, ts, event_id, kind, version, fingerprint, stage)."""
    rows = events.select(F.col("entity").cast("string"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "kind", "version", "fingerprint", "stage").filter("entity is not null and ts is not null and event_id is not null")
    rows = rows.withWatermark("ts", late).withColumn("at", F.unix_millis("ts"))
    return rows.groupBy("entity").transformWithState(Lifecycle(), OUTPUT, "Append", "EventTime")


@contextmanager
def state_store(spark: SparkSession):
    """The state store that keyed state needs, for the queries that start within."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def run(spark: SparkSession, events: DataFrame, out: str, checkpoint: str) -> None:
    """Work off all that has arrived: transitions are appended to a Parquet folder."""
    with state_store(spark):
        q = lifecycle(events).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()


def current(transitions: DataFrame) -> DataFrame:
    """(entity, seq, version, status, at): the newest status of each entity's newest job, stages and cancelled jobs aside."""
    rows = transitions.filter("stage is null or status in ('completed', 'failed')").filter("status <> 'skipped'")
    best = F.max(F.struct("seq", F.when(F.col("status") == "cancelled", 0).otherwise(1).alias("live"), "at", F.coalesce("event_id", F.lit(-1)).alias("event_id"), "version", "status")).alias("m")
    return rows.groupBy("entity").agg(best).select("entity", "m.seq", "m.version", "m.status", "m.at")

