"""Queries that run a stream over a table until all of it is worked off."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.plans.registry import query
from docloom.session import scratch, table
from docloom.streaming import lifecycle as L

#: What the events of the table stand for.
KINDS = {"signup": "enqueue", "click": "claim", "purchase": "done", "error": "failed", "view": "follow"}


def _transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "arrivals")  # a stream reads a folder
    arrived = table(spark, sf_dir, "events")
    arrived.write.parquet(path)
    events = spark.readStream.schema(arrived.schema).parquet(path)
    kind = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[F.col("event_type")]
    version = F.when(kind.isin("enqueue", "follow"), F.concat(F.lit("v"), F.col("event_id") % 3))
    rows = events.select(F.col("user_id").cast("string").alias("entity"), "ts", "event_id", kind.alias("kind"), version.alias("version"), F.when(F.col("event_id") % 2 == 0, "f").alias("fingerprint"), F.lit(None).cast("string").alias("stage"))
    out = scratch(spark, "transitions")
    L.run(spark, rows, out, scratch(spark, "lifecycle"))
    return spark.read.schema(L.OUTPUT).parquet(out)


@query()
def job_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every transition of every entity's jobs, with leases, stages and follow-ups."""
    return _transitions(spark, sf_dir)


@query()
def job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest job of each entity and its status."""
    return L.current(_transitions(spark, sf_dir))


@query(
    """WITH e AS (SELECT user_id, event_type, CASE WHEN event_type = 'signup' THEN 'v' || (event_id % 3) END AS version FROM events)
    SELECT CAST(user_id AS VARCHAR) AS entity, count(*) AS n_enqueued, count(DISTINCT version) AS n_versions FROM e WHERE event_type = 'signup' GROUP BY user_id"""
)
def job_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enqueue requests of each entity as its transitions show them: new and reused ones (O3)."""
    asked = _transitions(spark, sf_dir).filter("reason in ('enqueued', 'reused')")
    return asked.groupBy("entity").agg(F.count(F.lit(1)).alias("n_enqueued"), F.count_distinct("version").alias("n_versions"))
