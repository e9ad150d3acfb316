"""Keeping derived tables up to date: fingerprints, latest state, SCD-2 and job queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The newest row of each key."""
    return rows.withColumn("__rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("__rank = 1").drop("__rank")


def first_seen(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return latest(rows, by, order)


def changed(current: DataFrame, indexed: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """Rows that are new or whose digest differs from the indexed one."""
    return current.join(indexed.select(*keys, digest).distinct(), [*keys, digest], "left_anti")


def stale(indexed: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Indexed rows whose key (nulls equal) is not current any more."""
    cond = None
    for k in keys:
        c = indexed[k].eqNullSafe(current[k])
        cond = c if cond is None else cond & c
    return indexed.join(current, cond, "left_anti")


def enqueue(requests: DataFrame, by: str, digest: str, order: list[Column]) -> DataFrame:
    """Requests in order -> with action: a request equal to its predecessor of the key is
    deduplicated, others are queued and all but the last of these are superseded."""
    w = Window.partitionBy(by).orderBy(*order)
    same = F.coalesce(F.lag(digest).over(w) == F.col(digest), F.lit(False))
    rows = requests.withColumn("__dup", same)
    queued = F.when(~F.col("__dup"), 1)
    # those after a row: the key's total less a running count, in one pass
    later = F.count(queued).over(Window.partitionBy(by)) - F.count(queued).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("action", F.when(F.col("__dup"), "deduplicated").when(later > 0, "cancelled").otherwise("pending")).drop("__dup")


def scd2(history: DataFrame, key: str, digest: str, at: str, tie: str) -> DataFrame:
    """Snapshots -> one row per change: valid_from, valid_to, is_active."""
    w = Window.partitionBy(key).orderBy(at, tie)
    change = history.withColumn("__before", F.lag(digest).over(w)).filter(~F.col(digest).eqNullSafe(F.col("__before")) | F.col("__before").isNull())
    end = F.lead(at).over(w)
    return change.withColumn("valid_from", F.col(at)).withColumn("valid_to", end).withColumn("is_active", end.isNull()).drop("__before")


def runs(rows: DataFrame, by: list[str], order: list[Column], value: str) -> DataFrame:
    """Consecutive equal values get one run number."""
    w = Window.partitionBy(*by).orderBy(*order)
    step = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return rows.withColumn("__step", step).withColumn("run", F.sum("__step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__step")
