"""Writing style, terminology and gaps against plain readings."""

import re
import statistics
from collections import Counter

from pyspark.sql import functions as F

from docloom.functions import style as S
from docloom.operators import evidence as E

TEXT = """1. Purpose
Owner: Ana B
The valve shall be closed and must not be opened. Operators should check it's state daily.
- Verify the documentation of the ABC/DE system within 24 hours.
Verify that it is written down by QMS-AB12. Verify all.
a | b | c
The review may be prohibited; a review may follow prior to its implementation, no later than the end of May.
CAPA means a corrective and preventive action. ABC - the automated batch control unit
"""


def plain_style(text, n_sections):
    lines = [x.rstrip() for x in text.split("\n")]
    parts = re.split(r"(?<=[.!?])\s+|\n(?=\s*(?:[-*•]|\d+[.)]|[A-Z][A-Za-z ]{2,}:))|\n{2,}", text)
    sents = [" ".join(p.split()) for p in parts if len(p.split()) >= 3]
    n = lambda p, f=0: len(re.findall(p, text, f))
    modal = {g: sum(n(rf"\b{re.escape(t)}\b", re.I) for t in terms) for g, terms in S.MODALS.items()}
    sizes = [len(s.split()) for s in sents] or [0]
    tokens, total = max(1, n(r"[A-Za-z][A-Za-z0-9_/-]*")), max(1, len(sents))
    out = {
        "lines": len(lines), "bullets": sum(bool(re.match(S.BULLET_LINE, x)) for x in lines), "numbered": sum(bool(re.match(S.NUMBERED_LINE, x)) for x in lines), "tables": sum(x.count("|") >= 2 or "\t" in x for x in lines),
        "forms": sum(bool(re.match(S.FORM_LINE, x)) for x in lines), "sentences": len(sents), "mean_sentence": sum(sizes) / len(sizes), "median_sentence": float(statistics.median(sizes)),
        "passive": n(S.PASSIVE[5:], re.I), "imperative": sum(bool(re.match(rf"(?:{'|'.join(S.ACTIONS)})\b", s, re.I)) for s in sents), "acronyms": n(S.ACRONYM[4:]), "nominal": n(S.NOMINAL[5:], re.I), "contractions": n(S.CONTRACTION[5:], re.I), **modal,
    }
    score = min(modal["mandatory"] / total, 1) * 0.3 + min(out["passive"] / total, 1) * 0.18 + min(out["nominal"] / max(tokens / 100, 1), 1) * 0.2
    score += 0.12 * (out["contractions"] == 0) + 0.12 * (n_sections >= 4) + 0.08 * (out["tables"] > 0 or out["forms"] > 0)
    return out, round(score, 3)


def test_style_equals_a_plain_reading(spark, small):
    docs = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    cases = [TEXT, "", "One two three four. " * 3, "Check the lab now. Review all of it. Report to me soon.", *docs]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string")
    for r in df.select("i", "t", S.style(F.col("t"), F.lit(4)).alias("s")).collect():
        want, score = plain_style(r.t, 4)
        got = r.s.signals.asDict()
        assert {k: round(got[k], 9) for k in want} == {k: round(v, 9) for k, v in want.items()}, r.i
        assert abs(r.s.formality_score - score) < 1e-9
    labels = {r.i: (r.s.directive, r.s.complexity, r.s.formality, r.s.tone, r.s.primary_format) for r in df.filter("i < 4").select("i", S.style(F.col("t"), F.lit(1)).alias("s")).collect()}
    assert labels[0][0] == "descriptive/mixed" and labels[1] == ("descriptive/mixed", "low_to_medium", "standard", "mixed_descriptive", "free_prose_or_short_instruction")
    assert labels[3][:2] == ("imperative/action-led", "low_to_medium") and labels[3][3] == "instructional_procedural"
    one = spark.range(1)
    assert one.select(S.median(F.array(F.lit(3), F.lit(1), F.lit(2))), S.median(F.array(F.lit(4), F.lit(1))), S.median(F.array().cast("array<int>"))).first()[:] == (2.0, 2.5, 0.0)


def test_terminology(spark):
    r = spark.createDataFrame([(TEXT,), (None,)], "t string").coalesce(1).select(S.acronyms(F.col("t")), S.trace_ids(F.col("t")), S.timing_mentions(F.col("t")), S.definitions(F.col("t"))).collect()
    assert r[0][0] == sorted(set(re.findall(r"\b[A-Z]{2,}(?:/[A-Z]{2,})?\b", TEXT))) and r[0][1] == ["QMS-AB12"]
    assert r[0][2] == ["daily", "no later than the end of May", "prior to", "within 24 hour"]
    terms = {x.term: x.definition for x in r[0][3]}
    assert terms["CAPA"] == "a corrective and preventive action" and terms["ABC"] == "the automated batch control unit" and [list(x) for x in r[1]] == [[], [], [], []]


def test_key_phrases(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(40)
    got = {}
    for r in E.key_phrases(docs, most=10).collect():
        got.setdefault(r.id, []).append((r["rank"], r.phrase, r["count"]))
    for d in docs.collect():
        words = [w for w in (x.lower() for x in re.findall(r"[A-Za-z][A-Za-z0-9_/-]*", d.text)) if len(w) >= 3 and w not in S.STOP]
        counts = Counter(" ".join(words[i : i + n]) for n in (2, 3) for i in range(len(words) - n + 1))
        want = [(n, p, c) for n, (p, c) in enumerate([x for x in counts.most_common() if x[1] > 1][:10], 1)]
        assert sorted(got.get(d.doc_id, [])) == want, d.doc_id


def test_gaps_rule_by_rule(spark):
    flow = "array<struct<flow:string,status:string,missing_core:array<string>,required:boolean,has_timing:boolean>>"
    schema = f"text string, labels array<string>, title string, version string, flows {flow}, roles array<string>, approver boolean, n int"
    full = ["purpose", "scope", "responsibilities", "procedure", "records", "approval", "revision_history"]
    rows = [
        ("all checked and verified", full, "T", "1", [], [], True, 7),
        ("verify and check it", ["purpose"], " ", None, [], ["Owner", "Auditor"], False, 1),
        ("a CAPA and a backup by the user, approve it, checked", full, "T", "1", [], [], True, 7),
        ("a capa with an effectiveness check within 2 days and a critical verify check escalate now", full, "T", "1", [], [], True, 7),
        ("verify check", full, "T", "1", [("approval_flow", "detected", ["submit"], True, False), ("capa_flow", "needs_review", ["close"], True, True), ("review_flow", "not_detected", ["x"], True, False), ("audit_flow", "not_detected", ["x"], False, False)], [], True, 7),
        (None, [], None, None, [], [], False, 0),
    ]
    words = {"approval": ["approval"], "escalation": ["escalate"], "controls": ["verify", "check", "checked", "verified"]}
    gaps = E.gap_list(F.col("text"), F.col("labels"), F.col("title"), F.col("version"), F.col("flows"), F.col("roles"), F.col("approver"), F.col("n"), **words)
    got = spark.createDataFrame(rows, schema).coalesce(1).select(gaps.alias("g")).select("g", E.gap_summary(F.col("g")).alias("s")).collect()
    codes = [[g.code for g in r.g] for r in got]
    assert codes[0] == [] and got[0].s[:3] == (0, "controlled", 0)
    assert codes[1] == ["scope", "responsibilities", "procedure", "records", "approval", "revision_history", "title", "version_or_revision", "approval_authority", "sectioning", "Owner", "Auditor"]
    assert codes[2] == ["timing", "escalation", "controls", "capa_effectiveness", "access_control", "backup_restore_testing"]
    assert codes[3] == [] and codes[4] == ["approval_flow:submit", "approval_flow", "approval_flow:submit", "capa_flow:close", "review_flow"]
    assert [g.group for g in got[4].g] == ["missing_approvals", "missing_timing", "workflow_gaps", "workflow_gaps", "workflow_gaps"] and len(codes[5]) == 12
    assert got[1].s.score == round(9 * (0.8 * 3 + 0.82 + 0.7) + 5 * (0.68 * 3 + 0.65 + 0.7 + 0.7 + 0.7)) and got[1].s.level == "medium" and got[1].s.focus[0] == "approval_authority"


def test_key_phrases_are_ranked_without_a_shuffle(spark):
    docs = spark.createDataFrame([(1, "ab1 cd1 ef1 ab1 cd1 ef1 zz9"), (1, "gh1 ij1 gh1 ij1"), (2, None), (3, "only once here")], "doc_id long, text string")
    found = E.key_phrases(docs)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.id, r["rank"], r.phrase, r["count"]) for r in found.collect())
    assert got == [(1, 1, "ab1 cd1", 2), (1, 1, "gh1 ij1", 2), (1, 2, "cd1 ef1", 2), (1, 3, "ab1 cd1 ef1", 2)]


def test_a_heading_reads_its_line_once(spark):
    """Before, the line was stripped some twenty times."""
    from docloom.functions import structure as T

    lines = ["1.2 Scope of work", "# the aim", "PURPOSE", "Records:", " \x85 2. Procedure 　", "All of it is in this long sentence here.", "PURPOSE " * 30, "", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string").coalesce(1).select("i", T.heading_of(F.col("line"), F.col("i")).alias("h"))
    assert df._jdf.queryExecution().optimizedPlan().expressions().mkString().count("line#") == 1
    got = [(r.h.title, r.h.level, r.h.label, r.h.confidence) if r.h else None for r in df.orderBy("i").collect()]
    assert got == [("Scope of work", 2, "scope", 0.88), ("the aim", 1, "purpose", 0.86), ("PURPOSE", 1, "purpose", 0.98), ("Records", 1, "records", 0.98), ("Procedure", 1, "procedure", 0.98), None, None, None, None]


def test_roles_find_their_terms_once(spark):
    """F8: a filter on the terms was pushed below them, so that each text was searched twice."""
    docs = spark.createDataFrame([(1, "The chief editor shall review it. Then the editor reviewed more.", "x"), (2, "no one here", "x"), (3, None, "x")], "doc_id long, text string, d string").coalesce(1)
    found = E.roles(docs, {"Approver": E.Role(["editor", "chief"], ["*"])}, ["review"], domain_col="d")
    assert "Filter (size(" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.id, r.role, r.matched_terms, r.actions, len(r.evidence)) for r in found.collect()] == [(1, "Approver", ["chief", "editor"], ["review"], 2)]


def test_words_of_obligation_are_found_in_one_search(spark):
    """before, each kind of words was a search of its own."""
    df = spark.createDataFrame([("It shall not be done. One must, and may not; it is not permitted. Er darf nicht. They should.",)], "t string").coalesce(1).select(S.signals(F.col("t")).alias("s"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(lower(") <= 2
    assert df.select("s.mandatory", "s.recommended", "s.permissive", "s.prohibited").first()[:] == (2, 1, 2, 4)


def test_definitions_are_searched_once_a_pattern(spark):
    """before, each pattern ran over the text once for each of its groups."""
    text = "  Rule A - b: one two three \r\nX: a: b c d\nit MEANS well; Backup set means a copy of\nABC/DE - is a b c\u2028LOG: d e f\n\n  K means it is so. x"
    df = spark.createDataFrame([(text,)], "t string").coalesce(1)
    found = df.select(S.definitions(F.col("t")).alias("d"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 3
    want = []
    for pattern in S.DEFINITIONS:
        both = df.select(*[F.regexp_extract_all("t", F.lit(pattern), F.lit(g)) for g in (1, 2)]).first()
        want += [(" ".join(t.split()), " ".join(d.split())) for t, d in zip(*both, strict=True)]
    keys = [t.lower() for t, _ in want]
    want = [x for i, x in enumerate(want) if len(x[0].split()) <= 7 and len(x[1].split()) >= 3 and x[0].lower() not in S.NO_TERMS]
    want = [x for i, x in enumerate(want) if x[0].lower() not in [y[0].lower() for y in want[:i]]]
    assert keys and want and [tuple(x) for x in found.first().d] == want


def test_sets_of_other_sizes_do_not_become_rows(spark, monkeypatch):
    """before, every word of every set was counted, sorted and shuffled."""
    from docloom.operators import search

    kept = {}

    def noted(df, name):
        kept[name] = df.cache()
        return kept[name]

    monkeypatch.setattr(search, "written", noted)
    sets = {n: [f"w{i}" for i in range(n)] for n in (0, 1, 4, 5, 10, 25, 26, 400)}
    left = spark.createDataFrame([(1, sets[10]), (2, []), (3, None)], "a int, w array<string>")
    right = spark.createDataFrame([*sets.items(), (7, None)], "b int, w array<string>")
    got = sorted((r.a, r.b, r.jaccard) for r in search.similar_sets(left, right, 40).collect())
    assert got == [(1, 4, 0.4), (1, 5, 0.5), (1, 10, 1.0), (1, 25, 0.4)]
    assert sorted(r.b for r in kept["near-sets"].collect()) == [4, 5, 10, 25]
    assert search.similar_sets(left.filter("a > 1"), right, 40).count() == 0
