"""Blocks, sections and tables against a plain reading of the lines."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from docloom.functions import lines as L
from docloom.operators import blocks as B

PIECES = ["", "", "word and word", "- one", "*  two", "+ three", "1. step", "2. Scope", "3) go on", "---", "***", "___", "-" * 25, "17", "# Top | a | b", "### deep `x`", "| a | **b** |", "|---|---|", "a | b | c", "![pic *x*](u.png)", "![](u)", "Owner: Ana", "**bold** text", "  - inner", "=== no ===", "| |  |", "ALL CAPS", "1.1 Sub"]


def plain_markdown(text):
    """(type, level, text) by one reading of the lines from the first to the last."""
    def strip_marks(s):
        for p in (r"\*\*([^*]+)\*\*", r"\*([^*]+)\*", r"`([^`]+)`"):
            s = re.sub(p, r"\1", s.strip())
        return s.strip()

    rows = text.split("\n")
    bars = [r.count("|") >= 2 for r in rows]
    out, run, kind, i = [], [], None, 0

    def close():
        nonlocal run, kind
        if kind == "paragraph" and "\n".join(run).strip():
            out.append(("paragraph", None, "\n".join(run).strip()))
        elif kind in ("bullet_list", "numbered_list") and any(run):
            out.append((kind, None, "\n\n".join(x for x in run if x)))
        run, kind = [], None

    def put(now, value):
        nonlocal kind
        if kind != now:
            close()
        kind = now
        run.append(value)

    while i < len(rows):
        row, s = rows[i], rows[i].strip()
        i += 1
        if not s:
            close()
        elif re.match(r"^(-{20,}|\d{1,4})$", s):
            pass
        elif m := re.match(r"^!\[([^\]]*)\]\(([^)]+)\)\s*$", s):
            close()
            out.append(("paragraph", None, f"[{strip_marks(m[1]) or 'Image'}]"))
        elif m := re.match(r"^(#{1,6})\s+(.+)$", s):
            close()
            level = min(3, len(m[1]))
            out.append(("section_heading" if level < 3 else "heading", level, strip_marks(m[2])))
        elif i < len(rows) and re.match(r"^(-{3,}|\*{3,}|_{3,})$", rows[i].strip()):
            close()
            out.append(("section_heading", 1, strip_marks(s)))
            i += 1
        elif bars[i - 1]:
            close()
            got = [s]
            while i < len(rows) and (bars[i] or not rows[i].strip()):
                got.append(rows[i].strip())
                i += 1
            cells = [[strip_marks(c) for c in r.strip("|").split("|")] for r in got if r.strip("|") and not re.match(r"^\|?[\s:|-]+\|?$", r)]
            cells = [c for c in cells if any(c)]
            if cells:
                out.append(("table", None, "\n\n".join(" | ".join(x for x in c if x) for c in cells)))
        elif m := re.match(r"^\s*[-*+]\s+(.+)$", row):
            put("bullet_list", strip_marks(m[1]))
        elif m := re.match(r"^\s*\d+\.\s+(.+)$", row):
            put("numbered_list", strip_marks(m[1]))
        else:
            put("paragraph", strip_marks(s))
    close()
    return out


def found(rows):
    got = {}
    for r in rows.select("row", "id", "block", "type", "level", B.block_text().alias("t")).collect():
        got.setdefault((r.row, r.id), []).append((r.block, r.type, r.level, r.t))
    return {k: [x[1:] for x in sorted(v)] for k, v in got.items()}


def test_markdown_equals_a_plain_reading(spark):
    r = random.Random(11)
    texts = ["\n".join(r.choice(PIECES) for _ in range(r.randrange(1, 25))) for _ in range(600)]
    texts += ["Title\n---\n---\n---\nx", "a | b | c\n---\nd | e | f\n\n# g | h | i\n12\nj | k | l", "\n".join(["p", "-" * 25, "-" * 25, "---", "q", "***"]), "", " \n "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "doc_id int, text string").repartition(3)
    got = {k[1]: v for k, v in found(B.blocks_of_markdown(df)).items()}
    for i, t in enumerate(texts):
        assert got.get(i, []) == plain_markdown(t), repr(t)
    assert len(texts) not in got


def test_whole_documents_as_markdown(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = {k[1]: v for k, v in found(B.blocks_of_markdown(docs)).items()}
    for r in docs.collect():
        assert got.get(r.doc_id, []) == plain_markdown(r.text), r.doc_id


@pytest.mark.parametrize(
    ("line", "kind", "level"),
    [
        ("Owner: Ana", "pair", 2), ("sop id: X-1", "pair", 2), ("Owner:", "paragraph", 2), ("1. Purpose", "heading", 2), ("2. Open the valve and wait", "number", 2), ("3) go", "number", 2),
        ("1.2 Scope of it", "heading", 3), ("1.2.3.4 deep", "heading", 3), ("ALL IN CAPITALS", "heading", 2), ("ONE TWO THREE FOUR FIVE SIX", "paragraph", 2), ("the scope here", "heading", 2),
        ("the scope here is long", "paragraph", 2), ("- item", "bullet", 2), ("• item", "bullet", 2), ("-item", "paragraph", 2), ("1. " + "GO " * 4 + "ON", "heading", 2), ("plain", "paragraph", 2),
    ],
)
def test_kinds_of_lines(spark, line, kind, level):
    r = spark.createDataFrame([(line,)], "l string").select(L.kind_of(F.col("l")), L.level_of(F.col("l"))).first()
    assert tuple(r) == (kind, level)


def test_lines_to_blocks_sections_and_json(spark):
    text = "before\nSOP\n\nID: X-1\n1. Purpose\nwhy\r\nand\thow\n- a\n• b\n1) c\n1.1 Details\nOwner:  Ana B \nSOP\nend\n2. Scope"
    df = spark.createDataFrame([(7, text, "x"), (7, "SOP", "x"), (None, "1.1 alone", "x"), (8, None, "x"), (9, "\x00 \t", "x")], "doc_id int, text string, block string")
    blocks = B.blocks_of_lines(df)
    got = found(blocks)
    one = [v for k, v in got.items() if k[1] == 7 and len(v) > 1][0]
    assert one == [
        ("paragraph", None, "before"), ("two_column_row", None, "SOP ID: X-1"), ("section_heading", 2, "1. Purpose"), ("paragraph", None, "why\nand how"), ("bullet_list", None, "a\n\nb"), ("numbered_list", None, "c"),
        ("heading", 3, "1.1 Details"), ("two_column_row", None, "Owner: Ana B"), ("section_heading", 2, "SOP"), ("paragraph", None, "end"), ("section_heading", 2, "2. Scope"),
    ]
    assert len(got) == 3
    placed = B.hierarchy(blocks)
    where = sorted((r.section, r.subsection, r.block, r.section_title, r.section_level, r.subsection_title) for r in placed.filter("id = 7 and block > 0").collect() if r.section_title != "SOP" or r.section > 1)
    assert where[0] == (1, 0, 1, "Document Body", 1, None) and (2, 1, 8, "1. Purpose", 2, "1.1 Details") in where and where[-1][:4] == (4, 0, 11, "2. Scope")
    alone = placed.filter("id is null").first()
    assert (alone.section, alone.section_title, alone.subsection, alone.subsection_title) == (1, "Document Body", 1, "1.1 alone")
    trees = {r.id: json.loads(r.j) for r in B.nested(placed).select("id", F.to_json("sections").alias("j")).collect() if r.id != 7 or "Purpose" in r.j}
    body, purpose, sop, scope = trees[7]
    assert [x["type"] for x in body["content"]] == ["paragraph", "two_column_row"] and body["content"][1]["label"] == "SOP ID" and body["subsections"] == []
    assert [x["type"] for x in purpose["content"]] == ["paragraph", "bullet_list", "numbered_list"] and purpose["content"][1]["items"] == ["a", "b"]
    assert purpose["subsections"][0]["title"] == "1.1 Details" and purpose["subsections"][0]["content"][0]["value"] == "Ana B"
    assert sop["content"][0]["text"] == "end" and scope["content"] == [] and trees[None][0]["subsections"][0]["content"] == []
    flat = {r.text for r in B.flat_text(blocks).collect()}
    assert "before\n\n1. Purpose\n\nwhy\nand how\n\na\n\nb\n\nc\n\n1.1 Details\n\nSOP\n\nend\n\n2. Scope" in flat


def test_header_chunks(spark):
    text = "lead in\n## Purpose of it\nbody\n  3. Records kept\n\n\nVerantwortung hier\nx"
    rows = B.header_chunks(spark.createDataFrame([(1, text), (2, " \n"), (3, None), (4, "Scopes are no header")], "doc_id int, text string")).collect()
    got = sorted((r.id, r.chunk, r.title, r.section_type, r.chunk_type, r.start_line, r.end_line, r.content) for r in rows)
    assert got == [
        (1, 1, "Intro", "general", "intro", 0, 0, "lead in"),
        (1, 2, "## Purpose of it", "purpose", "header", 1, 2, "## Purpose of it\nbody"),
        (1, 3, "3. Records kept", "records", "header", 3, 5, "3. Records kept"),
        (1, 4, "Verantwortung hier", "responsibilities", "header", 6, 7, "Verantwortung hier\nx"),
        (4, 1, "Intro", "general", "intro", 0, 0, "Scopes are no header"),
    ]


def test_tables_are_padded_and_their_headers_found(spark):
    cases = [
        ([["No.", " Name "], ["1", None, "x\ty"], ["", " "], []], [["No.", "Name", ""], ["1", "", "x y"]], 1),
        ([["a"]], [["a"]], 0),
        ([["Date", "Version"], ["No.", "Status"], ["a rather long cell of text", "and another one that is long"]], [["Date", "Version"], ["No.", "Status"], ["a rather long cell of text", "and another one that is long"]], 2),
        ([["x", "y"], ["No.", "z"], ["a rather long cell of text", "and another one that is long"]], [["x", "y"], ["No.", "z"], ["a rather long cell of text", "and another one that is long"]], 1),
        ([["x" * 90], ["y" * 90]], [["x" * 90], ["y" * 90]], 0),
        ([], [], 0),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, r array<array<string>>")
    got = df.select("i", L.normal_rows(F.col("r")).alias("n")).select("n", L.header_rows(F.col("n")).alias("h")).collect()
    assert [(r.n, r.h) for r in got] == [(c[1], c[2]) for c in cases]
    texts = [["a  b", "c\td", "x"], ["a b", "c d"], ["a  b", "c  d  e", "f  g  h  i", "j  k  l  m  n"], ["one  two"], []]
    df = spark.createDataFrame([(t,) for t in texts], "l array<string>")
    assert [r[0] for r in df.select(L.looks_like_table(F.col("l"))).collect()] == [True, False, False, False, False]
    assert df.select(L.table_of(F.col("l"))).first()[0] == [["a", "b"], ["c", "d"]]


def test_a_long_table_is_padded_in_linear_time(spark):
    import time

    lines = lambda n: spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(i.cast("string"), F.lit("\tb"), F.when(i % 2 == 0, "\tc").otherwise(""))).alias("l"))
    r = lines(5).select(L.table_of(F.col("l"))).first()[0]
    assert r == [["1", "b", ""], ["2", "b", "c"], ["3", "b", ""], ["4", "b", "c"], ["5", "b", ""]]
    start = time.time()
    got = lines(60_000).select(L.table_of(F.col("l")).alias("t")).select(F.size("t"), F.size(F.filter("t", lambda r: F.size(r) == 3))).first()
    assert got[:] == (60_000, 60_000) and time.time() - start < 30


def test_markdown_stays_in_its_row(spark):
    draw = random.Random(5)
    texts = [None, "", "\n", "---", *["\n".join(draw.choice(PIECES) for _ in range(draw.randint(1, 16))) for _ in range(300)]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").coalesce(2)
    blocks = B.blocks_of_markdown(df)
    got = {k[1]: v for k, v in found(blocks).items()}
    for i, t in enumerate(texts):
        assert got.get(i, []) == plain_markdown(t or ""), repr(t)
    assert B.blocks_of_markdown(df.filter("doc_id < 0")).collect() == []
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "Sort" not in plan
