"""Cases that lost data or ended the job."""

import json
import time

from pyspark.sql import functions as F

from docloom.functions import structure, text, tree
from docloom.operators import tables


def test_trees_that_cannot_be_read_come_back_as_they_are(spark):
    deep = '{"type":"doc","content":[' * 20_000 + "]}" * 20_000
    rows = [(0, '{"type":"doc","content":['), (1, deep), (2, None), (3, "[1]"), (4, '{"type":"doc","content":[{"type":"paragraph","content":[{"type":"text","text":"a"}]}]}')]
    df = spark.createDataFrame(rows, "i int, t string").withColumn("p", F.array(F.struct(F.lit("0.0").alias("path"), F.lit("b").alias("text"))))
    got = {r.i: r.o for r in df.select("i", tree.apply_patches("t", "p").alias("o")).collect()}
    assert [got[i] for i in range(4)] == [rows[i][1] for i in range(4)]
    assert json.loads(got[4])["content"][0]["content"][0]["text"] == "b"


def test_long_version_numbers_sort(spark):
    labels = ["V99999999999", "V100000000000", "V007", "V7.1", "Rev. 12345678901234567890", "3", ""]
    df = spark.createDataFrame([(x,) for x in labels], "v string")
    assert [r.v for r in df.orderBy(tables.version_key(F.col("v")).desc()).collect()] == ["V100000000000", "V99999999999", "V7.1", "V007", "Rev. 12345678901234567890", "3", ""]
    forms = [r[0] for r in df.select(tables.canonical_version(F.concat(F.lit("rev "), F.regexp_extract("v", r"(\d+)$", 1)))).collect()]
    assert forms == ["Rev. 99999999999", "Rev. 100000000000", "Rev. 07", "Rev. 01", "Rev. 12345678901234567890", "Rev. 03", "rev"]


def test_headings_with_carriage_returns_and_tabs(spark):
    df = spark.createDataFrame([(1, "PURPOSE\r\nwhy\r\n\t2. Scope\t\r\nall\rRECORDS\r\nRECORDS\r\nRECORDS\r\nx")], "doc_id int, text string")
    got = structure.sections(df).orderBy("start_line").collect()
    assert [(r.title, r.start_line, r.content) for r in got] == [("PURPOSE", 0, "PURPOSE\nwhy"), ("Scope", 2, "2. Scope\t\nall"), ("RECORDS", 4, "RECORDS\nRECORDS"), ("RECORDS", 6, "RECORDS\nx")]


def test_many_headings_and_long_texts_take_time_in_proportion(spark):
    heads = "".join(f"{i}. Scope {i}\n\n" for i in range(20_000))
    long = "abcdefg hi" * 400_000
    df = spark.createDataFrame([(1, heads)], "doc_id int, text string")
    began = time.time()
    assert structure.sections(df).count() == 20_000
    chunks = spark.createDataFrame([(1, long)], "doc_id int, text string").select(F.explode(text.window_chunks(F.col("text"))).alias("c")).agg(F.count("*"), F.sum(F.length("c"))).first()
    assert chunks[0] == 4000 and time.time() - began < 40


def test_windows_equal_a_plain_version(spark):
    def plain(t, size, overlap):
        if len(t) <= size:
            return [t]
        out, i = [], 0
        while True:
            out.append(t[i : i + size].strip())
            if i + size >= len(t):
                return [x for x in out if x]
            i += size - overlap

    texts = ["", "a" * 1200, "a" * 1201, "ä😀 " * 900, " " * 3000 + "x", "\n".join("word" * 30 for _ in range(60)), "b" * 3200]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for size, overlap in ((1200, 200), (100, 70), (50, 0)):
        got = {r.i: r.w for r in df.select("i", text.window_chunks(F.col("t"), size, overlap).alias("w")).collect()}
        assert [got[i] for i in range(len(texts))] == [plain(t, size, overlap) for t in texts], size
