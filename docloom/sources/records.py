"""Sources and sinks of records and texts, through Spark's readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): whole text files, undecodable bytes replaced."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def read_records(spark: SparkSession, path: str, schema: str, wrappers: tuple[str, ...] = ("results", "data", "items", "sops")) -> DataFrame:
    """JSON records: a bare list or lines, or the first list under one of the wrapper names.

    The schema is given, never inferred; what does not fit it is null. Each file is read whole, as a
    response of a service is: files of lines that grow are read_json_lines' to read.
    """
    wrapped = ", ".join(f"{w} array<struct<{schema}>>" for w in wrappers)
    rows = spark.read.text(path, wholetext=True).select(F.col("value").alias("raw"))
    bare = F.from_json("raw", f"array<struct<{schema}>>")
    inside = F.from_json("raw", wrapped)
    lines = F.transform(F.filter(F.split("raw", "\n"), lambda x: F.trim(x) != ""), lambda x: F.from_json(x, schema))
    listed = F.coalesce(*[inside[w] for w in wrappers])
    found = F.when(F.ltrim("raw").startswith("["), bare).when(listed.isNotNull(), listed).otherwise(lines)
    return rows.select(F.explode(found).alias("r")).select("r.*")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of any size, read in splits; the schema is given, what does not fit it is null."""
    return spark.read.schema(schema).json(path)


def write_partitioned(df: DataFrame, path: str, by: list[str]) -> None:
    """Replace the partitions that df has; the others stay. Rows of a partition are gathered first."""
    df.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
