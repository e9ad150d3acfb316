"""Session defaults and table loading shared by queries, tests and the bench."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "docloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library is tested under; callers' own conf wins."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table; Spark's reader takes any file system the session knows."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset a local master (tests) gets a new folder in /tmp; on a cluster it is an error,
    as executors would write where the driver can't read.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.conf.get("spark.docloom.local.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-docloom-", dir="/tmp")
        spark.conf.set("spark.docloom.local.dir", found)
    return found.rstrip("/")


_SCRATCH: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; clear_scratch() deletes it."""
    path = f"{shared_dir(spark)}/docloom-{name}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back; options are the writer's.

    A lost executor then costs no recomputation, and the files' size lets Spark
    decide by itself, under autoBroadcastJoinThreshold, whether to broadcast.
    """
    path = scratch(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._docloom_path = path
    return out


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder that nothing will read again."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    if path in _SCRATCH:
        _SCRATCH.remove(path)


def forget(df: DataFrame) -> None:
    """Delete what written() has written for df, once a later table has taken its place."""
    path = getattr(df, "_docloom_path", None)
    if path:
        remove_path(df.sparkSession, path)


def clear_scratch(spark: SparkSession) -> int:
    """Delete all scratch tables of this process, after their results are stored; their number."""
    gone = list(_SCRATCH)
    for path in gone:
        remove_path(spark, path)
    return len(gone)
