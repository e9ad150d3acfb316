"""Phrases, roles, flows and standards against plain readings and goldens."""

import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from docloom.functions import nlp as N
from docloom.functions import phrases as P
from docloom.operators import evidence as E

WORDS = ["audit", "trail", "audits", "plan", "a", "it", "lab", "für", "x1", "sign", "design", "owner"]
BANK = ["audit", "audit trail", "audit trail plan", "it", "plan a", "trail", "a", "für it", "sign", "design owner", "x1 x1"]


def plain_found(text, phrases, whole):
    edge = r"(?<![^\W])", r"(?![^\W])"
    out = []
    for p in phrases:
        rule = f"{edge[0]}(?={re.escape(p)}{edge[1]})" if whole else f"(?={re.escape(p)})"
        out += [p] * len(re.findall(rule, text))
    return sorted(out)


@pytest.mark.parametrize("whole", [True, False])
def test_all_phrases_are_found_at_all_places(spark, whole):
    r = random.Random(2)
    texts = [" ".join(r.choice(WORDS) for _ in range(r.randrange(1, 30))) + r.choice([".", "", "_"]) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [sorted(x[0]) for x in df.select(P.found(F.col("t"), BANK, whole)).collect()]
    assert got == [plain_found(t, BANK, whole) for t in texts]
    assert [x[0] for x in df.select(P.any_of(F.col("t"), ["esi", "it a", "it"])).collect()] == ["esi" in t or "it" in t for t in texts]


def test_five_hundred_phrases_cost_about_as_much_as_fifty(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(4, 9)))
    bank = [f"{word()} {word()}" for _ in range(500)]
    texts = [(" ".join(word() for _ in range(2000)) + " " + bank[i],) for i in range(200)]
    df = spark.createDataFrame(texts, "t string").repartition(4).cache()
    df.count()

    def took(n):
        best = 9e9
        for _ in range(3):
            began = time.time()
            rows = df.select(F.size(P.found(F.col("t"), bank[:n])).alias("n")).agg(F.sum("n")).first()[0]
            best = min(best, time.time() - began)
        return best, rows

    few, many = took(50), took(500)
    assert (few[1], many[1]) == (50, 200) and many[0] < 4 * few[0] + 0.5


def test_sentences(spark):
    text = "One two three. Four five six!  Seven eight\nnine ten\n- an item here\n2) go on there\nOwner of it: some one\n\nlast of all"
    got = spark.createDataFrame([(text,)], "t string").select(P.sentence_list(F.col("t"))).first()[0]
    assert got == ["One two three.", "Four five six!", "Seven eight nine ten", "- an item here", "2) go on there", "Owner of it: some one", "last of all"]


ROLES = {"QA": E.Role(["qa", "quality lead"], ["pharma"]), "Owner": E.Role(["owner"], ["*"], ambiguous=True), "Lab": E.Role(["lab", "lab analyst"])}
VERBS = ["review", "sign", "file"]


def plain_roles(text, domain):
    low = text.lower()
    parts = re.split(r"(?<=[.!?])\s+|\n(?=\s*(?:[-*•]|\d+[.)]|[A-Z][A-Za-z ]{2,}:))|\n{2,}", text)
    sents = [s for s in (" ".join(p.split()) for p in parts) if len(s.split()) >= 3]
    has = lambda s, t: re.search(rf"(?<!\w){re.escape(t)}(?!\w)", s.lower())
    out = {}
    for name, role in ROLES.items():
        hits = [t for t in role.terms if has(low, t)]
        if not hits:
            continue
        evidence = [s for s in sents if any(k in s.lower() for k in hits + VERBS)][:5]
        actions = sorted({v for s in sents if any(has(s, t) for t in hits) for v in VERBS if re.search(rf"\b{v}(?:s|ed|ing)?\b", s.lower())})
        score = 0.55 * len(hits) + 0.2 * len(actions) + 0.28 * len(evidence)
        score += 0.55 if domain and ("*" in role.domains or domain in role.domains) else 0
        if role.ambiguous and len(hits) == 1 and not actions:
            score *= 0.55
        confidence = round(min(0.96, 1 - math.exp(-score / 3.2)), 3)
        if confidence >= 0.52:
            out[name] = (sorted(hits), actions, evidence, confidence)
    return out


def test_roles_equal_a_plain_reading(spark):
    r = random.Random(9)
    words = ["qa", "owner", "lab", "analyst", "quality", "lead", "review", "reviews", "signed", "designs", "file", "the", "by", "of"]
    texts = [" ".join(r.choice(words) + r.choice(["", "", "", ".", "\n", "\n\n"]) for _ in range(r.randrange(3, 60))) for _ in range(150)]
    rows = [(i, t, r.choice(["pharma", "other", None])) for i, t in enumerate(texts)] + [(None, None, None), (900, "", "pharma")]
    got = {}
    for x in E.roles(spark.createDataFrame(rows, "doc_id int, text string, domain string"), ROLES, VERBS, domain_col="domain").collect():
        got.setdefault(x.id, {})[x.role] = (x.matched_terms, x.actions, x.evidence, x.confidence)
    assert got == {i: want for i, t, d in rows if (want := plain_roles(t or "", d))}


def test_role_goldens_and_categories(spark):
    one = spark.range(1)
    assert one.select(E.role_score(F.lit(2), F.lit(3), F.lit(2), F.lit(True), F.lit(False))).first()[0] == 0.584
    assert one.select(E.status_of(F.lit(0.584), E.ROLE_DETECTED)).first()[0] == "needs_review"
    cases = [("Approver", [], [], "Accountable/Approver"), ("X", ["release"], [], "Accountable/Approver"), ("QA", [], [], "Reviewer/Verifier"), ("X", [], ["They assess it"], "Reviewer/Verifier"),
             ("IT", [], [], "Responsible/Executor"), ("X", ["notify"], [], "Consulted/Informed"), ("Owner", [], ["designs"], "Accountable/Owner"), ("X", [], [], "Mentioned/Unclear")]
    df = spark.createDataFrame([c[:3] for c in cases], "r string, a array<string>, e array<string>")
    assert [x[0] for x in df.select(E.raci_category(F.col("r"), F.col("a"), F.col("e"))).collect()] == [c[3] for c in cases]
    rules = [("kind", ["Audit"], ["Auditor", "QA"]), ("domain", ["pharma"], ["QA"])]
    assert one.select(E.expected_roles(F.lit("pharma"), F.lit("Audit"), rules)).first()[0] == ["Auditor", "QA"]


def test_sections_narrow_the_evidence(spark):
    long = "The lab analyst files what the lab has seen on that day and the lab signs it. " * 5
    text = f"Scope:\nthe owner reviews it all\nProcedure:\n{long}"
    got = {r.role: r for r in E.roles(spark.createDataFrame([(1, text)], "doc_id int, text string"), ROLES, VERBS).collect()}
    assert list(got) == ["Lab"] and all("owner" not in s for s in got["Lab"].evidence) and got["Lab"].actions == ["file", "sign"]


FLOW = {"f": E.Flow({s: [s] for s in "draft prepare submit review approve authorize release effective archive".split()}, ["submit", "review", "approve", "release"], ["procedure"], ["Policy"])}


@pytest.mark.parametrize(("text", "kind", "want"), [
    ("They submit and review it. Then approve it now. Do archive all.", None, (0.695, "detected", 4, ["release"])),
    ("nothing of the kind", None, (0.18, "not_detected", 0, ["submit", "review", "approve", "release"])),
    ("", None, (0.18, "not_detected", 0, ["submit", "review", "approve", "release"])),
    ("draft prepare submit review approve authorize release effective archive", "Policy", (1.0, "detected", 9, [])),
])
def test_flow_goldens(spark, text, kind, want):
    r = E.flows(spark.createDataFrame([(1, text, kind)], "doc_id int, text string, kind string"), FLOW, kind_col="kind").first()
    assert (r.confidence, r.status, len(r.stages), r.missing_core) == want


def test_one_of_eight_stages_of_a_required_flow(spark):
    flow = {"g": E.Flow({f"s{i}": [f"stage {i}"] for i in range(8)}, [f"s{i}" for i in range(5)], required_for=["K"])}
    r = E.flows(spark.createDataFrame([(1, "we are at stage 0 now", "K")], "doc_id int, text string, kind string"), flow, kind_col="kind").first()
    assert r.confidence == 0.413 and r.stages[0].evidence == ["we are at stage 0 now"] and r.order_quality == 0.0


def test_flow_scopes_and_evidence(spark):
    body = " ".join(f"They submit form {i} and wait." for i in range(6))
    df = spark.createDataFrame([(1, f"1. Procedure\n{body}\n2. Scope\nwe approve all of it"), (2, "1. Procedure\nthey submit it\n2. Scope\nwe approve all of it")], "doc_id int, text string")
    got = {r.id: [(s.stage, len(s.evidence), s.confidence) for s in r.stages] for r in E.flows(df, FLOW).collect()}
    assert got == {1: [("submit", 3, 0.401)], 2: [("submit", 1, 0.33), ("approve", 1, 0.33)]}


def test_standards_and_domains(spark):
    banks = {"ISO 1": E.Standard([r"\biso\s*1\b", "first norm"], "quality"), "Act 9": E.Standard(["act nine"], "law"), "None": E.Standard(["zzz"])}
    docs = spark.createDataFrame([(1, "By ISO 1, the first norm. It says act nine here."), (2, None), (3, "act nine")], "doc_id int, text string")
    found = E.standards(docs, banks)
    got = {(r.id, r.standard): (r.n_patterns, r.confidence, len(r.evidence)) for r in found.collect()}
    assert got == {(1, "ISO 1"): (2, 0.94, 1), (1, "Act 9"): (1, 0.92, 1), (3, "Act 9"): (1, 0.92, 0)}
    best = E.domains_with_standards(spark.createDataFrame([(1, "quality", 0.7), (1, "other", 0.8), (4, "x", 0.97)], "id int, domain string, confidence double"), found)
    assert sorted((r.id, r["rank"], r.domain, r.confidence, r.source) for r in best.collect()) == [
        (1, 1, "law", 0.9, "standard"), (1, 2, "other", 0.8, "candidate"), (1, 3, "quality", 0.78, "candidate+standard"), (3, 1, "law", 0.9, "standard"), (4, 1, "x", 0.97, "candidate"),
    ]


def test_risk_golden_level_and_focus(spark):
    gaps = F.array(N.gap(F.lit(True), "a", "high", 0.80), N.gap(F.lit(True), "b", "medium", 0.68), N.gap(F.lit(True), "c", "high", 0.82))
    score = N.risk_score(gaps)
    assert tuple(spark.range(1).select(score, E.risk_level(score), E.risk_level(F.lit(0)), E.risk_level(F.lit(35)), E.risk_level(F.lit(70))).first()) == (18, "low", "controlled", "medium", "high")
    g = lambda m, s, c: F.struct(F.lit(m).alias("message"), F.lit(s).alias("severity"), F.lit(c).alias("confidence"))
    listed = F.array(g("a", "low", 0.9), g("b", "critical", 0.1), g("c", "high", 0.5), g("d", "high", 0.7), g("e", "odd", 0.2), g("f", "high", 0.7))
    assert spark.range(1).select(E.focus_areas(listed)).first()[0] == ["b", "d", "f", "c", "e"]
