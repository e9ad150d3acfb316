"""Queries of splitters and of parts of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import answers as A
from docloom.functions import splitters as S
from docloom.plans.registry import query
from docloom.session import table


@query()
def recursive_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 500 characters by a ladder of separators, with an overlap of 50."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(S.recursive_chunks(F.col("text"))).alias("chunk", "text"))
    return rows.select("doc_id", "chunk", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


@query()
def text_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of 1400 characters at most with what joins them."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(S.text_segments(F.col("text"))).alias("segment", "s"))
    return rows.select("doc_id", "segment", F.length("s.text").alias("n_chars"), F.md5("s.text").alias("text_md5"), "s.joiner")


def _answer(text: Column) -> Column:
    """A model's answer made of a turn."""
    return F.concat(
        F.lit("[REASONING] as of turn "), F.col("turn"), F.lit("\n[ANSWER]\n"), text, F.lit("\n[CONFIDENCE] high\n---CITATIONS---\n[[C-"), F.col("conv_id"), F.lit("|turn "), F.col("turn"), F.lit(" |sop| by "), F.col("role"),
        F.lit("]] [[broken|two]]\n---SUGGESTIONS---\n[\"ask "), F.col("turn"), F.lit('", 5, "b", "c", null, "d", "e"] and so on'),
    )


@query(
    """SELECT conv_id, turn, md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS answer_md5, 'C-' || conv_id AS ref, 'turn ' || turn AS title, 'by ' || role AS excerpt, 'ask ' || turn || ',b,c,d' AS suggestions, 'as of turn ' || turn AS reasoning, 'high' AS confidence FROM conversations"""
)
def parsed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks, citations and suggestions of answers."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", A.answer_parts(_answer(F.col("text"))).alias("a"))
    one = F.col("a.citations")[0]
    return rows.select("conv_id", "turn", F.md5("a.answer").alias("answer_md5"), one["ref"].alias("ref"), one["title"].alias("title"), one["excerpt"].alias("excerpt"), F.array_join("a.suggestions", ",").alias("suggestions"), "a.reasoning", "a.confidence")


@query("SELECT conv_id, turn, role AS who, CAST(turn AS BIGINT) AS n, md5(text) AS text_md5 FROM conversations")
def first_json_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first JSON object in text around it."""
    packed = F.to_json(F.struct(F.struct(F.col("role").alias("who")).alias("by"), F.col("turn").alias("n"), F.col("text").alias("t")))
    raw = F.concat(F.lit("Here is {it}: ```json\n"), packed, F.lit("\n``` and {\"n\": 0}\nSources: none"))
    found = A.first_object(A.bare_json(raw))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.from_json(found, "by struct<who:string>, n long, t string").alias("j"))
    return rows.select("conv_id", "turn", F.col("j.by.who").alias("who"), "j.n", F.md5("j.t").alias("text_md5"))


@query(
    """SELECT conv_id, turn, CAST(greatest(1, least(120, turn * 13)) AS INTEGER) AS lines, CAST(greatest(10, least(10000, 10 + conv_id)) AS INTEGER) AS words, CASE WHEN turn < 77 THEN 'plain_lines' ELSE 'bullets' END AS format
    FROM conversations WHERE role = 'user' AND conv_id < 99990"""
)
def asked_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines and words that a message asks for."""
    asked = table(spark, sf_dir, "conversations").filter("role = 'user' and conv_id < 99990")
    message = F.concat(F.lit("Rewrite it as bullets in "), F.col("turn") * 13, F.lit(" lines of "), F.col("conv_id") + 10, F.lit(" words"))
    return asked.select("conv_id", "turn", A.limits_asked(message).alias("l")).select("conv_id", "turn", "l.*")


@query(
    """SELECT o_orderkey, CAST(n AS INTEGER) AS n_sections, CASE WHEN n = 2 THEN md5(rtrim(repeat('the valve of order ' || o_orderkey || ' was open. ', 4))) END AS first_md5
    FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 2 END AS n FROM orders)"""
)
def embedded_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies under heads of records within a text."""
    body = F.repeat(F.concat(F.lit("the valve of order "), "o_orderkey", F.lit(" was open. ")), 4)
    first = F.when(F.col("o_orderkey") % 3 == 0, "too short").otherwise(body)
    text = F.concat(F.lit("Intro\n1. Deviation: "), first, F.lit("\nCAPA - "), body, F.lit("\n  deviation:\n"), body)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", A.embedded_sections(text, "deviation").alias("s"))
    return rows.select("o_orderkey", F.size("s").alias("n_sections"), F.when(F.size("s") == 2, F.md5(F.get("s", F.lit(0)))).alias("first_md5"))
