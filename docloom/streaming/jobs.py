"""Entity events as a stream: deduplicated jobs, latest state per key, windows with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.session import remove_path

REINDEX = ("created", "updated", "linked", "imported")


def read_events(spark: SparkSession, path: str, schema: str, files_per_batch: int = 16) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def actions(events: DataFrame, event: str = "event_type") -> DataFrame:
    """Each event's action: reindex, purge or error."""
    return events.withColumn("action", F.when(F.col(event).isin(*REINDEX), "reindex").when(F.col(event) == "deleted", "purge").otherwise("error"))


def deduplicate(events: DataFrame, keys: list[str], at: str = "ts", late: str = "10 minutes") -> DataFrame:
    """One event of equal keys within the watermark; state of older keys is dropped."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def tumbling(events: DataFrame, by: list[str], at: str = "ts", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    rows = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return rows.groupBy(F.window(at, width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), *by, "n")


def sessions(events: DataFrame, by: list[str], at: str = "ts", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    rows = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return rows.groupBy(*by, F.session_window(at, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(*by, F.col("w.start").alias("session_start"), "n")


def newest(rows: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The newest row of each key, by a struct maximum: partial results before the shuffle."""
    names = rows.columns
    best = F.max(F.struct(at, tie, *[c for c in names if c not in (at, tie, key)])).alias("m")
    return rows.groupBy(key).agg(best).select(*[F.col(key) if c == key else F.col(f"m.{c}").alias(c) for c in names])


def merge_latest(spark: SparkSession, root: str, key: str, at: str, tie: str):
    """A foreachBatch function that keeps the newest event per key in versions of a Parquet table.

    Version N + 1 is the newest of version N and the batch, written under the batch's id, so a
    replayed batch writes the same version again; events older than what is applied change nothing. Only the
    last two versions are kept, as a replay reads the one before. Each batch rewrites the table: for many keys use ``lifecycle``, whose state is keyed.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        before = None
        if batch_id:
            before = spark.read.schema(batch.schema).parquet(f"{root}/v{batch_id - 1}")
        rows = batch if before is None else before.unionByName(batch)
        newest(rows, key, at, tie).write.mode("overwrite").parquet(f"{root}/v{batch_id}")
        if batch_id > 1:
            remove_path(spark, f"{root}/v{batch_id - 2}")

    return apply


def run_available(stream: DataFrame, checkpoint: str, apply) -> int:
    """Work off all that has arrived; the last batch's id, -1 if there was none."""
    q = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q.lastProgress["batchId"] if q.lastProgress else -1
