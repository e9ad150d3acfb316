import json

from pyspark.sql import functions as F

from docloom.functions import tree as T
from docloom.operators import graph, tables

TEXT = lambda s: {"type": "text", "text": s}
DOC = {
    "type": "doc",
    "content": [
        {"type": "paragraph", "content": [TEXT("Before any "), TEXT("heading")]},
        {"type": "heading", "attrs": {"level": 1, "block-id": "b1"}, "content": [TEXT("Scope")]},
        {"type": "bulletList", "content": [{"type": "listItem", "content": [{"type": "paragraph", "content": [TEXT("one")]}]}]},
        {"type": "heading", "attrs": {"level": 2}, "content": [TEXT("Roles")]},
        {"type": "paragraph", "content": [TEXT("two"), TEXT("")]},
        {"type": "heading", "attrs": {"level": 1}, "content": [TEXT("Scope")]},
        {"type": "paragraph", "content": [TEXT("three")]},
        {"type": "paragraph"},
    ],
}


def test_trees(spark):
    df = spark.createDataFrame([(json.dumps(DOC),), (None,), ("no json",), ("[1]",)], "t string")
    rows = df.select(T.tree_text("t").alias("text"), T.tree_sections("t").alias("apart"), T.tree_sections_merged("t").alias("merged"), T.text_nodes("t").alias("nodes")).collect()
    assert rows[0].text.split("\n") == ["Before any heading", "Scope", "one", "Roles", "two", "Scope", "three"]
    assert [(s.name, s.text) for s in rows[0].apart] == [("General", "Before any heading"), ("Scope", "one"), ("Roles", "two"), ("Scope", "three")]
    assert [(s.name, s.text) for s in rows[0].merged] == [("General", "Before any heading"), ("Scope", "one\nthree"), ("Roles", "two")]
    assert all(r.text == "" and r.apart == [] for r in rows[1:]) and rows[0].nodes[0].path == "0.0"
    patch = F.array(F.struct(F.lit("0.0").alias("path"), F.lit("After ").alias("text")), F.struct(F.lit("4.0").alias("path"), F.lit(" ").alias("text")))
    out = json.loads(df.select(T.apply_patches("t", patch)).first()[0])
    assert T.inner_text(out["content"][0]) == "After heading" and T.inner_text(out["content"][4]) == "two" and len(out["content"]) == 7


def test_upserts_resolve_by_a_ladder_of_keys(spark):
    stored = spark.createDataFrame([(1, "x1", "A"), (2, None, "B"), (3, "x3", "B")], "id long, external string, name string")
    new = spark.createDataFrame([(1, None, "Z"), (None, "x3", "A"), (None, None, "B"), (None, "q", "Q")], "id long, external string, name string")
    got = tables.resolve(new, stored, "id", ["external", "name"]).collect()
    assert sorted((r.name, r.matched or 0) for r in got) == [("A", 3), ("B", 2), ("Q", 0), ("Z", 1)]
    done = tables.upsert(stored, spark.createDataFrame([(2, "n", "N"), (9, "o", "O")], stored.schema), "id")
    assert sorted((r.id, r.name) for r in done.collect()) == [(1, "A"), (2, "N"), (3, "B"), (9, "O")]
    scope = tables.replace_scope(stored, spark.createDataFrame([(7, None, "B")], stored.schema), ["external", "name"])
    assert sorted(r.id for r in scope.collect()) == [1, 3, 7]


def test_transitions(spark):
    rules = spark.createDataFrame([("submit", ["draft"], "review", False), ("reject", ["review"], "draft", True)], "action string, from_status array<string>, to_status string, needs_note boolean")
    asked = spark.createDataFrame([(1, "submit", "draft", None), (2, "reject", "review", " "), (3, "reject", "draft", "n"), (4, "x", "draft", "n"), (5, "reject", "review", "n")], "id int, action string, status string, note string")
    got = {r.id: (r.verdict, r.new_status) for r in tables.guard_transition(asked, rules).collect()}
    assert got == {1: ("ok", "review"), 2: ("missing note", "review"), 3: ("wrong status", "draft"), 4: ("unknown action", "draft"), 5: ("ok", "draft")}


def test_versions_and_lists(spark):
    df = spark.createDataFrame([(v,) for v in ["2", "Rev. 3", "v1.10", "V1.9", "draft", "10", "revision 12"]], "v string")
    assert [r.v for r in df.orderBy(tables.version_key(F.col("v")).desc()).collect()] == ["v1.10", "V1.9", "revision 12", "Rev. 3", "10", "2", "draft"]
    assert df.select(tables.canonical_version(F.col("v"))).collect()[1][0] == "Rev. 03"
    rows = spark.createDataFrame([("k", 2, ["b", "c"]), ("k", 1, ["a", "b"])], "k string, at int, l array<string>")
    assert tables.merge_lists(rows, "k", ["l"], "at").first().l == ["a", "b", "c"]


def test_orphans(spark):
    edges = spark.createDataFrame([(1, 10), (2, 10), (1, 11), (3, 12)], "src long, dst long")
    kids = spark.createDataFrame([(10,), (11,), (12,)], "id long")
    gone = spark.createDataFrame([(1,)], "id long")
    assert [r.id for r in graph.delete_orphans(kids, edges, gone).collect()] == [11]


def test_deep_trees_end_no_task(spark):
    """3,000 levels: read without recursion, or an empty tree where the JSON reader itself gives up."""
    node = {"type": "paragraph", "content": [{"type": "text", "text": "x"}]}
    for _ in range(300):
        node = {"type": "list", "content": [node]}
    deep = '{"type":"list","content":[' * 200_000 + "{}" + "]}" * 200_000
    rows = spark.createDataFrame([(json.dumps({"type": "doc", "content": [node]}),), (deep,)], "raw string")
    assert [r.t for r in rows.select(T.tree_text("raw").alias("t")).collect()] == ["x", ""]
    nested = {"type": "text", "text": "y"}
    for _ in range(5000):
        nested = {"type": "list", "content": [nested]}
    assert sum(1 for _ in T.walk(nested)) == 5001 and T.pruned(nested) is nested


def test_context_carries_roots_as_bits(spark):
    import random

    from pyspark.sql import functions as F

    from docloom.operators import graph as G

    r = random.Random(8)
    pairs = lambda n: [(r.randrange(0, 90), r.randrange(0, 90)) for _ in range(n)]
    names = ["sop_dev", "dev_capa", "capa_audit", "audit_dec", "dec_sop"]
    edges = {n: pairs(120) + [(1, 1), (1, 1), (None, 4), (4, None)] for n in names}
    roots = [(n, n) for n in range(-1, 80)] + [(None, 3)]
    step = lambda ids, n, back=False: {(d, s)[back] for s, d in edges[n] for i in ids if i is not None and i == (s, d)[back]}
    want = set()
    for root, i in roots:
        dev0, dec0 = step({i}, "sop_dev"), step({i}, "dec_sop", True)
        capa0 = step(dev0, "dev_capa")
        aud = step(dec0, "audit_dec", True) | step(capa0, "capa_audit")
        capa = capa0 | step(aud, "capa_audit", True)
        dev, dec = dev0 | step(capa, "dev_capa", True), dec0 | step(aud, "audit_dec")
        sops = step(dec, "dec_sop") - {i}
        want |= {(root, t, x) for t, xs in (("deviation", dev), ("capa", capa), ("audit", aud), ("decision", dec), ("sop", sops)) for x in xs}
    tables = {n: spark.createDataFrame(e, "src long, dst long") for n, e in edges.items()}
    got = [tuple(x) for x in G.quality_context(spark.createDataFrame(roots, "root long, id long"), *[tables[n] for n in names]).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    merged = G._merged(spark.createDataFrame([(i % 7, 0, 1 << (i % 9)) for i in range(126)], "id long, word long, bits long"))
    assert merged.count() == 7 and merged.agg(F.min("bits")).first()[0] == 511
