"""Metadata ladders, rung by rung, and trees made of blocks."""

import json

from pyspark.sql import functions as F

from docloom.functions import tree as J
from docloom.operators import blocks as B
from docloom.operators import metadata as M


def test_best_ids(spark):
    cases = {"see DOC-1 and sop-qa-001": "SOP-QA-001", "WI-A then WI-7": "WI-7", "SOP-QA-002, SOP-QA-001": "SOP-QA-002", "QM/1/2 or QM/1": "QM/1/2", "none": None, None: None}
    df = spark.createDataFrame([(c,) for c in cases], "t string").coalesce(1)
    assert [r[0] for r in df.select(M.best_id(F.col("t"))).collect()] == list(cases.values())


def test_versions_from_tables(spark):
    table = lambda *rows: "\n".join("| " + " | ".join(r) + " |" for r in rows)
    cases = [
        (table(("Change", "Version", "Date"), ("a", "2.0", "01.02.2020"), ("b", "1.5", "03.04.2021"), ("c", "9", "")), "1.5"),
        (table(("History", "Rev."), ("a", "Rev 2"), ("b", "Rev 11"), ("c", "x")), "Rev. 11"),
        (table(("Part", "Version"), ("a", "V1.9"), ("b", "V1.10")), "V1.10"),
        (table(("Änderung", "Was"), ("v3", "x"), ("y", "V2")), "V3"),
        (table(("Part", "Version"), ("a", "V9")) + "\n\ntext\n\n" + table(("Change", "Version"), ("a", "V2")), "V2"),
        (table(("Part", "Size"), ("a", "9")), None),
        (table(("Change", "Version", "Date"), ("a", "7", "2020-01-01"), ("b", "8", "2020-01-01")), "7"),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "doc_id int, text string")
    blocks = B.blocks_of_markdown(df).drop("row").withColumnRenamed("id", "row")
    got = {r.row: r.version for r in M.version_from_tables(blocks).collect()}
    assert [got.get(i) for i in range(len(cases))] == [c[1] for c in cases]


def test_lines_around_an_id(spark):
    far = "\n".join(["SOP-1"] + ["x"] * 5 + ["Version 2"])
    near = "\n".join(["Revision: 4"] + ["x"] * 4 + ["the SOP-1"] + ["x"] * 4 + ["Version 3"])
    df = spark.createDataFrame([(1, far, "SOP-1"), (2, near, "SOP-1"), (3, far + "\nSOP-1", "SOP-1"), (4, "SOP-1 Version 5", ""), (5, None, "SOP-1")], "doc_id int, text string, n string")
    assert {r.id: r.found for r in M.around(df, "n", M.NEAR).collect()} == {2: "3", 3: "2"}
    assert {r.id: r.found for r in M.around(df, "n", M.NEAR, after=6).collect()} == {1: "2", 2: "3", 3: "2"}


def test_every_rung_of_the_ladder(spark):
    table = "| Change | Version |\n|---|---|\n| a | V3 |\n"
    texts = [
        "SOP-QA-001 Cleaning\nTitle: SOP-QA-001 - Cleaning of tanks\nVersion: 2.1\nEffective date: 5. März 2024\nStatus: Released\nAbteilung: Quality\nOwner: Ana B\n\n" + table,
        "1. PURPOSE\nof SOP-QA-002\n\n" + table,
        "x\nSOP-QA-003\nRevision: 7 of it",
        "Rev: 4\nVersion: none\nDatum: 2020-01-02",
        None,
        "",
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, "nothing", "x")], "doc_id int, text string, row string")
    got = [tuple(r)[1:] for r in M.metadata(df).orderBy("row").collect()]
    none = (None,) * 8
    assert got == [
        (0, "SOP-QA-001", "Cleaning of tanks", "2.1", "label", "2024-03-05", "released", "Quality", "Ana B"),
        (1, "SOP-QA-002", "PURPOSE", "V3", "table", None, None, None, None),
        (2, "SOP-QA-003", None, "7", "near number", None, None, None, None),
        (3, None, None, None, None, "2020-01-02", None, None, None),
        (4, *none), (5, *none), (0, *none),
    ]


def test_blocks_become_trees_and_come_back(spark):
    text = "# A \"head\"\n\nfirst\nsecond\\line\n\n- one\n- two\n\n1. three\n\n| No. | Name |\n|---|---|\n| 1 | ü |\n| 2 | |\n\n### Deep"
    df = spark.createDataFrame([(1, text), (2, "Owner: Ana"), (3, None)], "doc_id int, text string")
    rows = {r.id: r for r in B.trees(B.blocks_of_markdown(df)).collect()}
    tree = json.loads(rows[1].tree)
    assert [n["type"] for n in tree["content"]] == ["heading", "paragraph", "bulletList", "orderedList", "table", "heading"] and 3 not in rows
    assert tree["content"][0]["attrs"]["level"] == 1 and tree["content"][1]["content"][1] == {"type": "hardBreak"}
    table = tree["content"][4]["content"]
    assert [c["type"] for r in table for c in r["content"]] == ["tableHeader"] * 2 + ["tableCell"] * 4 and table[2]["content"][1]["content"] == [{"type": "paragraph", "content": []}]
    back = spark.createDataFrame([(rows[1].tree,)], "t string").select(J.tree_text("t"), J.table_fingerprints("t"), J.text_node_count("t")).first()
    assert back[0].split("\n") == ['A "head"', "firstsecond\\line", "one", "two", "three", "No.", "Name", "1", "ü", "2", "Deep"] and back[1] == [[2, 2, 2]] and back[2] == 12
    pair = json.loads(spark.createDataFrame([("Owner: Ana",)], "text string").withColumn("doc_id", F.lit(1)).transform(lambda d: B.trees(B.blocks_of_lines(d))).first().tree)
    assert pair["content"][0]["content"] == [{"type": "text", "text": "Owner: ", "marks": [{"type": "bold"}]}, {"type": "text", "text": "Ana"}]


def test_texts_are_merged_and_tables_stay(spark):
    leaf = lambda t: {"type": "paragraph", "content": [{"type": "text", "text": t}]}
    table = {"type": "table", "content": [{"type": "tableRow", "content": [{"type": "tableCell", "content": [leaf("c")]}]}]}
    doc = json.dumps({"type": "doc", "content": [leaf("old"), table, {"type": "heading", "content": [{"type": "text", "text": "h"}]}]})
    rows = [(doc, "new\r\n\n line two ", False), (doc, "new", True), (json.dumps({"type": "doc", "content": [leaf("old")]}), "new", False), ("{broken", "new", False), (None, "new", False), (doc, None, False), ('{"type":"doc"}', "", False)]
    got = [r[0] for r in spark.createDataFrame(rows, "d string, t string, a boolean").coalesce(1).select(J.merge_text("d", "t", "a")).collect()]
    kinds = [[n["type"] for n in json.loads(g)["content"]] if g and g[1] == '"' else g for g in got]
    assert kinds == [["table", "heading", "paragraph", "paragraph"], ["paragraph", "table", "heading", "paragraph"], ["paragraph"], "{broken", None, ["table", "heading"], ["paragraph"]]
    pairs = [(doc, doc), (doc, json.dumps({"type": "doc", "content": [leaf("x")]})), (json.dumps({"content": [leaf("a")] * 6}), json.dumps({"content": [leaf("a")] * 2})), (json.dumps({"content": [{"content": [leaf("a")] * 10}]}), json.dumps({"content": [{"content": [leaf("a")] * 3}]}))]
    assert [r[0] for r in spark.createDataFrame(pairs, "a string, b string").coalesce(1).select(J.structure_faults("a", "b")).collect()] == [None, "tables", "blocks", "texts"]


def test_lines_around_an_id_are_read_in_the_row(spark):
    import random
    import re

    draw = random.Random(3)
    texts = ["\n".join(draw.choice(["x", "", "see N1", "Version: 2", "Rev 3.1", "N1 Stand 7", "other"]) for _ in range(draw.randint(0, 14))) for _ in range(120)]

    def plain(text):
        lines = text.split("\n")
        for i, line in enumerate(lines):
            found = re.search(M.NEAR, "\n".join(lines[max(0, i - 4) : i + 6])) if "N1" in line else None
            if found:
                return found.group(1)

    df = spark.createDataFrame([(i, "N1", t) for i, t in enumerate(texts)] + [(500, "", "a\nVersion: 2"), (501, None, "Version: 2"), (502, "N1", None)], "doc_id int, n string, text string")
    found = M.around(df, "n", M.NEAR)
    assert {r.id: r.found for r in found.collect()} == {i: plain(t) for i, t in enumerate(texts) if plain(t)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "Generate" not in plan


def test_only_texts_with_two_bars_in_a_line_are_read_for_tables(spark):
    head = "SOP-QA-001\n|Change|Version|\n|---|---|\n"
    rows = [(1, head + "|a|V3|"), (2, "SOP-QA-002\na | b\nc | V4"), (3, "SOP-QA-003\rChange\x0b|Change|Version|\x0b|a|V5|"), (4, None), (5, "Version: 2\nversion: 3\nRev: 9\nTitle: a | b | c")]
    got = M.metadata(spark.createDataFrame(rows, "doc_id int, text string"))
    assert {r.id: (r.version, r.version_from) for r in got.collect()} == {1: ("V3", "table"), 2: (None, None), 3: ("V5", "table"), 4: (None, None), 5: ("2", "label")}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
