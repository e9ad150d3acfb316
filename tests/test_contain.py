"""Substring joins against a nested loop."""

import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import contain as C


def plain(snippets, texts):
    squeeze = lambda t: " ".join((t or "").lower().split())
    out = []
    for s, raw in snippets:
        a = squeeze(raw)
        if not a:
            continue
        found = [(s, i, "in text" if a in squeeze(t) else "holds text") for i, t in texts if a in squeeze(t) or (squeeze(t) and squeeze(t) in a)]
        if not found and len(a.split()) > 5:
            found = [(s, i, "probe") for i, t in texts if " ".join(a.split()[:5]) in (t or "").lower()]
        out += found
    return sorted(map(repr, out))


@pytest.mark.parametrize("block", [2_000_000, 60])
def test_pairs_equal_a_nested_loop(spark, block):
    r = random.Random(6)
    words = ["ab", "abc", "b", "cab", "größe", "Ab\n c", "x", "yz yz", "дом"]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    texts = [(i, say(r.randrange(0, 60))) for i in range(120)] + [(200, None), (201, " "), (202, "a"), (203, "B"), (None, "cab  X"), (5, "abc"), (204, "z"), (205, "ab abc b cab x one more")]
    snippets = [(i, say(r.randrange(1, 12))) for i in range(40)] + [(90, None), (91, " \n"), (92, "b"), (93, "AB  C"), (92, "b"), (None, "cab x"), (94, "q" * 9), (95, "ab abc b cab x and nothing else"), (96, "zz z"), (97, "дом")]
    s, t = spark.createDataFrame(snippets, "item long, text string"), spark.createDataFrame(texts, "doc long, text string").repartition(3)
    got = C.containment(s, t, "item", "doc", block_bytes=block)
    assert sorted(repr(tuple(x)) for x in got.collect()) == plain(snippets, texts)


def test_first_match_and_empty_tables(spark):
    s = spark.createDataFrame([(1, "b c")], "item long, text string")
    t = spark.createDataFrame([(3, "a b c"), (2, "b c d")], "doc long, text string")
    assert [tuple(r) for r in C.first_match(C.containment(s, t, "item", "doc")).collect()] == [(1, 2, "in text")]
    for x, y in ((s.limit(0), t), (s, t.limit(0))):
        assert C.containment(x, y, "item", "doc").collect() == []


def test_citations_are_enriched_by_the_first_that_fits(spark):
    schema = "c array<struct<ref:string,title:string>>, r array<struct<ref:string,title:string,status:string,score:double>>"
    raw = [("X-1", "Old plan", "open", 0.5), ("X-12", "", "shut", 0.25)]
    rows = [([("X-12", "a"), ("1", "b"), ("Q", "the Old plan of"), ("Q", "again"), ("Z", "none"), ("", None)], raw), ([("a", "b")], []), ([], raw)]
    got = spark.createDataFrame(rows, schema).select(C.enriched(F.col("c"), F.col("r")).alias("e")).collect()
    assert [tuple(x) for x in got[0].e] == [("X-12", "a", "shut", 0.25), ("1", "b", "open", 0.5), ("Q", "the Old plan of", "open", 0.5), ("Z", "none", "", 0.0), ("", "", "open", 0.5)]
    assert [tuple(x) for x in got[1].e] == [("a", "b", "", 0.0)] and got[2].e == []


def test_sections_that_messages_speak_of(spark):
    labels = ["Scope", "Purpose of it", "Records", "Roles & Duties", ""]
    says = {"What is in the scope?": "Scope", "the purpose of it all, in scope": "Purpose of it", "recods please": "Records", "the duties section": "Roles & Duties", "hello": None, "": None, None: None, "in purpose": "Purpose of it"}
    df = spark.createDataFrame([(m, labels) for m in says], "m string, l array<string>")
    assert [r[0] for r in df.select(C.mentioned_section(F.col("m"), F.col("l"))).collect()] == list(says.values())
