"""Splitters against plain recursive versions; parts of answers."""

import json
import random
import re

from pyspark.sql import functions as F

from docloom.functions import answers as A
from docloom.functions import splitters as S


def plain_merge(pieces, size, overlap):
    """Windows over the pieces: each as long as fits, the next from the first place with at most overlap characters before it ends."""
    out, begin, end = [], 0, 0
    n = lambda a, b: sum(map(len, pieces[a:b]))
    while end < len(pieces):
        while end < len(pieces) and (end == begin or n(begin, end) + len(pieces[end]) <= size):
            end += 1
        out.append("".join(pieces[begin:end]).strip())
        if end < len(pieces):
            while begin < end and (n(begin, end) > overlap or n(begin, end) + len(pieces[end]) > size):
                begin += 1
    return [c for c in out if c]


def plain_chunks(text, size, overlap, separators):
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    sep, rest = separators[at], separators[at + 1 :]
    pieces = list(text) if sep == "" else [p for p in re.split(f"(?={re.escape(sep)})", text) if p] if sep != "\n\n" else [p for p in [text.split(sep)[0], *[sep + x for x in text.split(sep)[1:]]] if p]
    out, short = [], []
    for p in pieces:
        if len(p) < size:
            short.append(p)
            continue
        out += plain_merge(short, size, overlap)
        short = []
        out += plain_chunks(p, size, overlap, rest) if rest and sep in text else [p]
    return out + plain_merge(short, size, overlap)


def texts(n=200):
    r = random.Random(12)
    word = lambda: "x" * r.choice([1, 3, 8, 8, 30, 90])
    return ["".join(word() + r.choice([" ", " ", " ", ". ", "\n", "\n\n", ""]) for _ in range(r.randrange(0, 60))) for _ in range(n)]


def test_chunks_equal_a_recursive_version(spark, small):
    for t in texts():
        for size, overlap in ((50, 10), (20, 0), (40, 30)):
            assert S.chunks(t, size, overlap) == plain_chunks(t, size, overlap, S.SEPARATORS), repr(t)
    docs = spark.read.parquet(f"{small}/documents.parquet").select("text", S.recursive_chunks(F.col("text")).alias("c")).collect()
    for r in docs:
        assert r.c == plain_chunks(r.text, 500, 50, S.SEPARATORS)
    assert S.chunks(None) == [] and S.chunks("a" * 1200, 500, 50) == ["a" * 500, "a" * 500, "a" * 300] and S.chunks("abc def", 3, 0, (" ",)) == ["abc", " def"]


def test_segments_fit_and_lose_no_word(spark, small):
    for t in texts():
        for size in (30, 100):
            got = S.segments(t, size)
            assert "".join(a + b for a, b in got).replace(" ", "").replace("\n", "") == t.replace(" ", "").replace("\n", "")
            assert all(len(a) <= size for a, _ in got)
    for r in spark.read.parquet(f"{small}/documents.parquet").select("text", S.text_segments(F.col("text")).alias("s")).collect():
        assert "".join("".join(x.text + x.joiner for x in r.s).split()) == "".join(r.text.split()) and (len(r.text) <= 1400) == (len(r.s) == 1 and r.s[0].text == r.text)
    assert S.segments("aa bb cc dd", 6) == [("aa bb", " "), ("cc dd", "")]
    assert S.segments("One. Two.\n\nThree is long enough.", 14) == [("One. Two.", "\n\n"), ("Three is long", " "), ("enough.", "")]
    assert S.segments("a\n\nb\n \nc\n\nlonger", 7) == [("a\n\nb", "\n \n"), ("c", "\n\n"), ("longer", "")]
    assert S.segments(None) == [("", "")] and S.segments("word " * 4, 9)[0] == ("word", " ")


def test_answers(spark):
    cases = [
        ("plain text", ("plain text", [], [], "", "")),
        (None, ("", [], [], "", "")),
        ("[answer] a\nb [CONFIDENCE] low", ("a\nb", [], [], "", "low")),
        ("[REASONING] why [ANSWER]  [CONFIDENCE] x", ("", [], [], "why", "x")),
        ("before [REASONING] why", ("before [REASONING] why", [], [], "why", "")),
        ("lead [ANSWER]", ("lead", [], [], "", "")),
        ('x ---CITATIONS--- [[a|b|c|d]][[e | f |g| h ]] [[no]]\n[[i|j|k|l|m]] ---CITATIONS--- [[z|z|z|z]]', ("x", [("a", "b", "c", "d"), ("e", "f", "g", "h"), ("i", "j", "k", "l|m")], [], "", "")),
        ('x ---suggestions--- ["q", 1, "r"] tail', ("x", [], ["q", "r"], "", "")),
        ("x ---SUGGESTIONS--- [broken]", ("x", [], [], "", "")),
        ("x ---SUGGESTIONS--- none", ("x ---SUGGESTIONS--- none", [], [], "", "")),
    ]
    rows = spark.createDataFrame([(c,) for c, _ in cases], "r string").coalesce(1).select(A.answer_parts(F.col("r")).alias("a")).collect()
    for (raw, want), r in zip(cases, rows, strict=True):
        assert (r.a.answer, [tuple(c) for c in r.a.citations], list(r.a.suggestions), r.a.reasoning, r.a.confidence) == want, raw


def test_first_objects(spark):
    cases = [('{"a": 1}', {"a": 1}), ('Here is it: {"a": "}"} {"b": 2}', {"a": "}"}), ("{x} {y} {\"c\": [1, {\"d\": null}]} z", {"c": [1, {"d": None}]}), ("none", None), (None, None), ('{"a": ', None), ('```json\n{"a": 1}\n```', {"a": 1}), ("[1]", None), ("{" * 100 + '"a": 1}', None), ('{"a":' * 50_000, None)]
    rows = spark.createDataFrame([(c,) for c, _ in cases], "r string").coalesce(1).select(A.first_object(A.bare_json(F.col("r"))).alias("o")).collect()
    assert [json.loads(r.o) if r.o else None for r in rows] == [w for _, w in cases]
    bare = {"Sure!\n{\"a\": 1}\nSources: x": '{"a": 1}', "prose {1}": "prose {1}", "a\n--- CITATIONS ---\nb": "a"}
    assert [r[0] for r in spark.createDataFrame([(b,) for b in bare], "r string").coalesce(1).select(A.bare_json(F.col("r"))).collect()] == list(bare.values())


def test_sections_heads_limits_and_changes(spark):
    long = "a body that is long enough to be kept as one, with words and more words in it, really"
    text = f"1) Deviation: {long}\nCAPA: {long} second\nDeviation - short\naudit finding: {long}\nDEVIATION: {'x' * 4000}"
    one = spark.createDataFrame([(text,)], "t string")
    got = one.select(A.embedded_sections(F.col("t"), "deviation"), A.embedded_sections(F.col("t"), "capa"), A.embedded_sections(F.lit(None).cast("string"), "capa")).first()
    assert got[0] == [long, "x" * 3000] and got[1] == [f"{long} second"] and got[2] == []
    assert one.select(A.heads_on_lines(F.lit("a CAPA-QA-01 - b  dev-AB-12–c\n\n\n\nd"))).first()[0] == "a\n\nCAPA-QA-01 - b\n\ndev-AB-12–c\n\nd"
    says = {"in 5 lines": (5, None, "plain_lines"), "a 300-line limit, 5 words": (120, None, "plain_lines"), "explain it to me please using some 40 zeilen": (40, None, "plain_lines"), "200 words as bullets": (None, 200, "bullets"), "hello": (None, None, None), "99999 wörter": (None, 10_000, None)}
    assert [tuple(r[0]) for r in spark.createDataFrame([(s,) for s in says], "m string").coalesce(1).select(A.limits_asked(F.col("m"))).collect()] == list(says.values())
    pairs = spark.createDataFrame([("The valve was open", "That VALVE was Shut, shut tight and tight forever today"), ("a\nb", "a"), ("", "x"), (None, None)], "a string, b string").coalesce(1)
    got = pairs.select(A.new_terms(F.col("a"), F.col("b"), ["that"]), A.changes(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(["Shut", "shut", "tight", "forever"], ["longer"]), ([], ["fewer_lines", "shorter"]), ([], ["more_lines", "longer"]), ([], [])]
