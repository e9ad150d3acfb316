"""Roles, flows and named standards in documents, with the sentences that show them.

All work on a document is done in its own row: its sentences are matched once against the phrases of all banks
(functions.phrases), and each bank's hits, actions and evidence are picked from that. Only documents
with a hit are split into sentences at all. Banks are parameters.

Defined cases: null and empty texts have no roles, standards and stages (a flow without stages scores .18). Ids may be null or
repeat. Extra columns aren't read; a very long text is one row's work.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import phrases as P
from docloom.functions.nlp import risk_score
from docloom.functions.structure import headings
from docloom.functions.style import filtered_words, timing_mentions
from docloom.functions.text import confidence_from_score

# Weights and thresholds of the scores, and the ladder of responsibility categories.
WEAK, ROLE_DETECTED, FLOW_DETECTED = 0.52, 0.62, 0.55
ROLE_WEIGHTS = {"hits": 0.55, "actions": 0.20, "evidence": 0.28, "domain": 0.55}
AMBIGUOUS, ROLE_CAP, MAX_ACTIONS, MAX_EVIDENCE = 0.55, 0.96, 16, 5
FLOW_WEIGHTS = {"base": 0.18, "stages": 0.36, "core": 0.34, "order": 0.10, "required": 0.12}
RESPONSIBILITY_LABELS, RESPONSIBILITY_WORDS, FLOW_WORDS = ["responsibilities", "procedure", "approval", "review", "records"], 20, 25
VERB_ENDINGS = "(?:s|ed|ing)?"
CATEGORIES = [
    ("Accountable/Approver", ["Approver"], "approve|authorize|sign|release"),
    ("Reviewer/Verifier", ["Reviewer", "QA", "QC", "Auditor"], "review|verify|audit|assess|check"),
    ("Responsible/Executor", ["Technician", "Production", "IT", "OT", "EHS"], "perform|execute|implement|record|submit|grant|revoke|disable|enable"),
    ("Consulted/Informed", [], "notify|inform|consult|report"),
    ("Accountable/Owner", ["Owner"], ""),
]
UNCLEAR = "Mentioned/Unclear"


@dataclass(frozen=True)
class Role:
    """Terms that name it; domains in which it is expected, "*" for all; ambiguous ones count less when one term stands alone."""

    terms: list[str]
    domains: list[str] = field(default_factory=list)
    ambiguous: bool = False


@dataclass(frozen=True)
class Flow:
    """Stages in order, each with the phrases that show it; the core ones; labels of the sections to look in; types of documents that need it."""

    stages: dict[str, list[str]]
    core: list[str]
    labels: list[str] = field(default_factory=lambda: ["procedure"])
    required_for: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Standard:
    patterns: list[str]
    domain: str | None = None


def status_of(confidence: Column, threshold: float) -> Column:
    return F.when(confidence >= threshold, "detected").when(confidence >= WEAK, "needs_review").otherwise("not_detected")


def _strings(values: Iterable[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def _cut(sentences: Column, most: int) -> Column:
    return F.transform(F.slice(sentences, 1, most), lambda s: F.substring(s["s"], 1, P.EVIDENCE_CUT))


def role_score(hits: Column, actions: Column, evidence: Column, in_domain: Column, ambiguous: Column) -> Column:
    """Confidence from numbers of terms, actions and sentences."""
    w = ROLE_WEIGHTS
    base = hits * w["hits"] + actions * w["actions"] + evidence * w["evidence"] + F.when(in_domain, w["domain"]).otherwise(0.0)
    return confidence_from_score(F.when(ambiguous & (hits == 1) & (actions == 0), base * AMBIGUOUS).otherwise(base), ROLE_CAP)


def raci_category(role: Column, actions: Column, evidence: Column) -> Column:
    """The first rung whose roles or words fit."""
    joined = F.lower(F.concat(F.array_join(actions, " "), F.lit(" "), F.array_join(evidence, " ")))
    out = F.lit(UNCLEAR)
    for name, roles, words in reversed(CATEGORIES):
        fits = role.isin(roles) if roles else F.lit(False)
        out = F.when(fits | joined.rlike(rf"\b({words})\b") if words else fits, name).otherwise(out)
    return out


def roles(docs: DataFrame, banks: dict[str, Role], verbs: list[str], id_col: str = "doc_id", text_col: str = "text", domain_col: str | None = None) -> DataFrame:
    """(id, role, matched_terms, actions, evidence, confidence, status, raci_category) of the roles with a confidence of WEAK or more."""
    terms = [t.lower() for r in banks.values() for t in r.terms]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), (F.col(domain_col) if domain_col else F.lit(None).cast("string")).alias("domain"))
    rows = rows.withColumn("hits", F.array_distinct(P.found(F.lower("text"), terms)))

    def marked(c: Column) -> Column:
        made = lambda s, low: F.struct(s.alias("s"), low.alias("low"), P.found(low, terms).alias("terms"), P.found(low, verbs, endings=VERB_ENDINGS).alias("verbs"), P.any_of(low, verbs).alias("acts"))
        return F.transform(P.sentence_list(c), lambda s: P.let(F.lower(s), lambda low: made(s, low)))

    scope = P.scoped_text(F.col("text"), headings(F.col("text")), RESPONSIBILITY_LABELS, RESPONSIBILITY_WORDS)
    # a filter on hits would be pushed below them and find them twice
    rows = rows.withColumn("z", F.when(F.size("hits") > 0, P.let(marked(F.col("text")), lambda s: F.struct(s.alias("all"), P.let(scope, lambda t: F.when(t.isNull(), s).otherwise(marked(t))).alias("scoped")))))
    bank = F.array(*[F.struct(F.lit(n).alias("role"), _strings(t.lower() for t in r.terms).alias("terms"), _strings(r.domains).alias("domains"), F.lit(r.ambiguous).alias("ambiguous")) for n, r in banks.items()])

    def one(r: Column, z: Column) -> Column:
        def filled(mine: Column) -> Column:
            holds = lambda s: F.exists(mine, lambda t: s["low"].contains(t))
            actions = F.slice(F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter(z["all"], lambda s: F.arrays_overlap(s["terms"], mine)), lambda s: s["verbs"])))), 1, MAX_ACTIONS)
            evidence = P.let(_cut(F.filter(z["scoped"], lambda s: s["acts"] | holds(s)), MAX_EVIDENCE), lambda e: F.when(F.size(e) > 0, e).otherwise(_cut(F.filter(z["all"], holds), 3)))
            in_domain = F.coalesce(F.array_contains(r["domains"], "*") & F.col("domain").isNotNull() | F.array_contains(r["domains"], F.col("domain")), F.lit(False))
            return F.struct(r["role"].alias("role"), F.array_sort(mine).alias("matched_terms"), actions.alias("actions"), evidence.alias("evidence"), in_domain.alias("in_domain"), r["ambiguous"].alias("ambiguous"))

        return P.let(F.array_intersect(r["terms"], F.col("hits")), filled)

    held = P.let(F.col("z"), lambda z: F.transform(F.filter(bank, lambda r: F.arrays_overlap(r["terms"], F.col("hits"))), lambda r: one(r, z)))
    out = rows.select("id", F.explode(held).alias("r")).select("id", "r.*")
    confidence = role_score(F.size("matched_terms"), F.size("actions"), F.size("evidence"), F.col("in_domain"), F.col("ambiguous"))
    out = out.withColumn("confidence", confidence).filter(F.col("confidence") >= WEAK)
    return out.select("id", "role", "matched_terms", "actions", "evidence", "confidence", status_of(F.col("confidence"), ROLE_DETECTED).alias("status"), raci_category(F.col("role"), F.col("actions"), F.col("evidence")).alias("raci_category"))


def raci_summary(found: DataFrame) -> DataFrame:
    """(id, raci_category, roles): the roles of each category in a document."""
    return found.groupBy("id", "raci_category").agg(F.array_sort(F.collect_set("role")).alias("roles"))


def expected_roles(domain: Column, kind: Column, rules: list[tuple[str, list[str], list[str]]]) -> Column:
    """Roles that a document should name: rules (domain or kind, its values, roles), all that fit."""
    of = {"domain": domain, "kind": kind}
    got = F.flatten(F.array(*[F.when(of[c].isin(values), _strings(names)).otherwise(_strings([])) for c, values, names in rules]))
    return F.array_sort(F.array_distinct(got))


def flow_score(stage_ratio: Column, core_ratio: Column, order: Column, required: Column) -> Column:
    w = FLOW_WEIGHTS
    raw = w["base"] + stage_ratio * w["stages"] + core_ratio * w["core"] + order * w["order"] + F.when(required, w["required"]).otherwise(0.0)
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), 3)


def flows(docs: DataFrame, banks: dict[str, Flow], id_col: str = "doc_id", text_col: str = "text", kind_col: str | None = None) -> DataFrame:
    """(id, flow, confidence, status, stage_ratio, core_ratio, order_quality, stages, missing_core, required) for each document and flow.

    stages is an array of (stage, order_index, confidence, evidence). A stage is shown by sentences of the flow's
    own sections that hold one of its phrases, and of the whole text where those have under FLOW_WORDS words.
    """
    variants = [v for f in banks.values() for vs in f.stages.values() for v in vs]
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), (F.col(kind_col) if kind_col else F.lit(None).cast("string")).alias("kind"))

    def marked(c: Column) -> Column:
        held = F.transform(P.sentence_list(c), lambda s: F.struct(s.alias("s"), F.array_distinct(P.found(F.lower(s), variants, whole=False)).alias("held")))
        return F.filter(held, lambda x: F.size(x["held"]) > 0)

    scopes = {labels: f"scope{i}" for i, labels in enumerate(dict.fromkeys(tuple(f.labels) for f in banks.values()))}

    def scoped(every: Column, heads: Column) -> Column:
        """The sentences of each set of labels: its sections', or all."""
        own = lambda labels: P.let(P.scoped_text(F.col("text"), heads, labels, FLOW_WORDS), lambda t: F.when(t.isNull(), every).otherwise(marked(t)))
        return F.struct(*[own(labels).alias(name) for labels, name in scopes.items()])

    rows = rows.withColumn("z", P.let(marked(F.col("text")), lambda every: P.let(headings(F.col("text")), lambda heads: scoped(every, heads))))

    def one(name: str, flow: Flow, z: Column) -> Column:
        stages = F.array(*[F.struct(F.lit(s).alias("stage"), F.lit(i).alias("order_index"), _strings(v.lower() for v in vs).alias("variants")) for i, (s, vs) in enumerate(flow.stages.items())])
        shown = F.transform(stages, lambda s: F.struct(s["stage"].alias("stage"), s["order_index"].alias("order_index"), _cut(F.filter(z[scopes[tuple(flow.labels)]], lambda x: F.arrays_overlap(x["held"], s["variants"])), 3).alias("evidence")))
        found = F.transform(
            F.filter(shown, lambda s: F.size(s["evidence"]) > 0),
            lambda s: F.struct(s["stage"].alias("stage"), s["order_index"].alias("order_index"), confidence_from_score(1.1 + 0.18 * F.size(s["evidence"]), 0.90).alias("confidence"), s["evidence"].alias("evidence")),
        )
        return F.struct(F.lit(name).alias("flow"), found.alias("stages"), F.lit(len(flow.stages)).alias("n"), _strings(flow.core).alias("core"), F.coalesce(F.col("kind").isin(flow.required_for), F.lit(False)).alias("required"))

    out = rows.select("id", F.explode(P.let(F.col("z"), lambda z: F.array(*[one(n, f, z) for n, f in banks.items()]))).alias("f")).select("id", "f.*")
    names = F.transform("stages", lambda s: s["stage"])
    out = out.withColumn("missing_core", F.array_except("core", names)).withColumn("stage_ratio", F.size("stages") / F.greatest(F.col("n"), F.lit(1)))
    out = out.withColumn("core_ratio", (F.size("core") - F.size("missing_core")) / F.greatest(F.size("core"), F.lit(1)))
    # stages come in the flow's order, so two or more of them are always in order
    out = out.withColumn("order_quality", F.when(F.size("stages") > 1, 1.0).otherwise(0.0))
    out = out.withColumn("confidence", flow_score(F.col("stage_ratio"), F.col("core_ratio"), F.col("order_quality"), F.col("required")))
    return out.select(
        "id", "flow", "confidence", status_of(F.col("confidence"), FLOW_DETECTED).alias("status"), F.bround("stage_ratio", 3).alias("stage_ratio"), F.bround("core_ratio", 3).alias("core_ratio"), "order_quality", "stages", "missing_core", "required"
    )


def standards(docs: DataFrame, banks: dict[str, Standard], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, standard, domain, n_patterns, confidence, evidence) of the standards of which a text holds a pattern, in any case."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    counts = [F.struct(F.lit(n).alias("standard"), F.lit(s.domain).cast("string").alias("domain"), sum((text.rlike(f"(?i){p}").cast("int") for p in s.patterns), F.lit(0)).alias("n_patterns")) for n, s in banks.items()]
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.filter(F.array(*counts), lambda s: s["n_patterns"] > 0).alias("found")).filter(F.size("found") > 0)
    rows = rows.select("id", "found", P.sentence_list(F.col("text")).alias("ss"))
    names = F.concat(F.array(F.lower("f.standard")), F.split(F.lower("f.standard"), r"\s+"))
    out = rows.select("id", F.explode("found").alias("f"), "ss")
    evidence = F.slice(F.filter("ss", lambda s: F.exists(names, lambda t: F.lower(s).contains(t))), 1, 3)
    confidence = F.bround(0.90 + F.least(F.lit(0.07), 0.02 * F.col("f.n_patterns")), 3)
    return out.select("id", "f.standard", "f.domain", "f.n_patterns", confidence.alias("confidence"), F.transform(evidence, lambda s: F.substring(s, 1, P.EVIDENCE_CUT)).alias("evidence"))


def domains_with_standards(candidates: DataFrame, found: DataFrame, most: int = 6) -> DataFrame:
    """(id, domain, confidence, source): candidate domains (id, domain, confidence), raised by .08 up to .96 for each standard that stands for them; domains only standards name come in at .90. The best of each document."""
    named = found.filter(F.col("domain").isNotNull()).groupBy("id", "domain").agg(F.count(F.lit(1)).alias("n"))
    both = candidates.select("id", "domain", "confidence").join(named, ["id", "domain"], "full")
    # raised once for each standard, and never lowered; a domain that the first standard brings in is raised by the others
    begin, times = F.coalesce("confidence", F.lit(0.90)), F.coalesce("n", F.lit(0)) - F.col("confidence").isNull().cast("int")
    raised = F.when(times > 0, F.greatest(begin, F.least(F.lit(0.96), begin + 0.08 * times))).otherwise(begin)
    source = F.when(F.col("confidence").isNull(), "standard").when(F.col("n") > 0, "candidate+standard").otherwise("candidate")
    rows = both.select("id", F.struct((-F.round(raised, 3)).alias("c"), "domain", source.alias("source")).alias("x"))
    best = rows.groupBy("id").agg(F.slice(F.array_sort(F.collect_list("x")), 1, most).alias("xs"))  # a document's own domains
    return best.select("id", F.posexplode("xs").alias("at", "x")).select("id", "x.domain", (-F.col("x.c")).alias("confidence"), "x.source", (F.col("at") + 1).alias("rank"))


def risk_level(score: Column) -> Column:
    return F.when(score >= 70, "high").when(score >= 35, "medium").when(score > 0, "low").otherwise("controlled")


def focus_areas(gaps: Column, most: int = 5) -> Column:
    """Messages of the gravest gaps: by severity, then confidence; equal ones as they come. gaps: an array of (message, severity, confidence)."""
    rank = lambda g: F.when(g["severity"] == "critical", 4).when(g["severity"] == "high", 3).when(g["severity"] == "low", 1).otherwise(2)
    keyed = F.transform(gaps, lambda g, i: F.struct((-rank(g)).alias("r"), (-F.round(g["confidence"], 3)).alias("c"), i.alias("i"), g["message"].alias("m")))
    return F.transform(F.slice(F.array_sort(keyed), 1, most), lambda x: x["m"])


#: Documents whose phrases a task holds at once.
PHRASE_ROWS = 64


def key_phrases(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 60) -> DataFrame:
    """(row, id, phrase, n, rank): each document's phrases of two and three words that it holds twice or more, the most frequent first, of equals the one that stands first, pairs before triples.

    A document's phrases are counted in its own row, so what leaves a task is at most most rows a document; nothing is shuffled.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), filtered_words(F.col(text_col)).alias("w"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, PHRASE_ROWS):
                part = batch.slice(first, PHRASE_ROWS)
                at, phrases, counts, ranks = [], [], [], []
                for i, w in enumerate(part.column("w")):
                    words = w.as_py()
                    counted = Counter(map(" ".join, zip(words, words[1:], strict=False)))  # pairs, then triples, each where it first stands
                    counted.update(map(" ".join, zip(words, words[1:], words[2:], strict=False)))
                    best = sorted(((p, n) for p, n in counted.items() if n > 1), key=lambda x: -x[1])[:most]
                    at += [i] * len(best)
                    phrases += [p for p, _ in best]
                    counts += [n for _, n in best]
                    ranks += range(1, len(best) + 1)
                at = pa.array(at, pa.int64())
                columns = [part.column("row").take(at), part.column("id").take(at), pa.array(phrases, pa.string()), pa.array(counts, pa.int64()), pa.array(ranks, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["row", "id", "phrase", "count", "rank"])

    return rows.mapInArrow(run, f"row long, id {kind}, phrase string, count long, rank int")


# What a document of a kind must hold, what in a text calls for what else, and how grave each gap is.
REQUIRED = ["purpose", "scope", "responsibilities", "procedure", "records", "approval", "revision_history"]
GRAVE_SECTIONS = ["purpose", "scope", "procedure", "responsibilities"]
GRAVE_ROLES = ["Approver", "Owner", "QA", "IT"]
GRAVE_FLOWS = ["incident_flow", "capa_flow", "access_control_flow"]
TIMED_FLOWS = ["incident_flow", "capa_flow", "approval_flow", "review_flow", "backup_restore_flow"]
#: group, code, severity, confidence, words of which one must be there, words of which none may be
CALLS = [
    ("missing_controls", "capa_effectiveness", "high", 0.84, ["capa", "corrective action", "preventive action"], ["effectiveness", "verify effectiveness", "effectiveness check"]),
    ("missing_controls", "access_control", "high", 0.82, ["access", "user", "privilege", "password"], ["periodic review", "access review", "mfa", "least privilege", "rbac"]),
    ("missing_controls", "backup_restore_testing", "high", 0.80, ["backup", "restore", "recovery"], ["restore test", "test restore", "backup verification", "verify backup"]),
]
TIMED_WORDS = ["approve", "review", "incident", "deviation", "capa", "escalate", "audit", "periodic", "backup", "restore"]
RISK_WORDS = ["incident", "deviation", "critical", "overdue", "failure", "nonconformance", "security event", "capa", "restore failure"]
GAP = "array<struct<group:string,code:string,severity:string,confidence:double>>"


def _gap(condition: Column, group: str, code: Column | str, severity: Column | str, confidence: Column | float) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.when(condition, F.struct(F.lit(group).alias("group"), lit(code).alias("code"), lit(severity).alias("severity"), lit(confidence).cast("double").alias("confidence")))


def gap_list(text: Column, labels: Column, title: Column, version: Column, flows: Column, missing_roles: Column, has_approver: Column, n_sections: Column, required: list[str] = REQUIRED, approval: list[str] = (), escalation: list[str] = (), controls: list[str] = ()) -> Column:
    """The gaps of a document, group by group: what it must have and lacks.

    labels: its sections' labels; flows: array of (flow, status, missing_core, required, has_timing); approval, escalation, controls: words that show these.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    named = [*TIMED_WORDS, *RISK_WORDS, *approval, *escalation, *controls, "policy", "policy statement", *[w for c in CALLS for w in [*c[4], *c[5]]]]

    def listed(held: Column) -> Column:
        any_of = lambda words: F.arrays_overlap(held, F.array(*map(F.lit, words)).cast("array<string>")) if words else F.lit(False)
        has = lambda label: F.array_contains(labels, label)
        sections = [_gap(~has(r) & ~(any_of(["policy", "policy statement"]) if r == "policy" else F.lit(False)), "missing_information", r, "high" if r in GRAVE_SECTIONS else "medium", 0.80 if r in GRAVE_SECTIONS else 0.68) for r in required]
        blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
        timing = F.size(timing_mentions(text)) > 0
        few = F.size(F.array_intersect(held, F.array(*map(F.lit, controls)).cast("array<string>"))) < 2 if controls else F.lit(True)
        single = [
            *sections,
            _gap(blank(title), "missing_information", "title", "medium", 0.65),
            _gap(blank(version), "missing_information", "version_or_revision", "medium", 0.70),
            _gap(~has("approval") & ~any_of(approval) & ~has_approver, "missing_approvals", "approval_authority", "high", 0.82),
            _gap(any_of(TIMED_WORDS) & ~timing, "missing_timing", "timing", "high", 0.82),
            _gap(any_of(RISK_WORDS) & ~any_of(escalation), "missing_escalation_logic", "escalation", "high", 0.78),
            _gap(few, "missing_controls", "controls", "medium", 0.62),
            *[_gap(any_of(call) & ~any_of(relief), group, code, severity, sure) for group, code, severity, sure, call, relief in CALLS],
            _gap(n_sections < 3, "structure_gaps", "sectioning", "medium", 0.70),
        ]
        detected = lambda f: f["status"] == "detected"
        stage = lambda group, f, s, severity, sure: F.struct(F.lit(group).alias("group"), F.concat(f["flow"], F.lit(":"), s).alias("code"), severity.alias("severity"), sure.cast("double").alias("confidence"))
        none = F.array().cast(GAP)
        approvals = F.flatten(F.transform(F.filter(flows, lambda f: detected(f) & (f["flow"] == "approval_flow")), lambda f: F.transform(f["missing_core"], lambda s: stage("missing_approvals", f, s, F.lit("medium"), F.lit(0.66)))))
        untimed = F.transform(F.filter(flows, lambda f: detected(f) & ~f["has_timing"] & f["flow"].isin(TIMED_FLOWS)), lambda f: _gap(F.lit(True), "missing_timing", f["flow"], "medium", 0.64))
        roles = F.transform(missing_roles, lambda r: _gap(F.lit(True), "role_gaps", r, F.when(r.isin(GRAVE_ROLES), "high").otherwise("medium"), 0.70))

        def flow_gaps(f: Column) -> Column:
            grave = f["flow"].isin(GRAVE_FLOWS)
            whole = F.array(_gap(F.lit(True), "workflow_gaps", f["flow"], "high", 0.76))
            stages = F.transform(F.slice(f["missing_core"], 1, 6), lambda s: stage("workflow_gaps", f, s, F.when(grave, "high").otherwise("medium"), F.when(grave, 0.76).otherwise(0.68)))
            return F.when(f["status"] == "not_detected", whole).otherwise(stages)

        needed = F.flatten(F.transform(F.filter(flows, lambda f: f["required"]), flow_gaps))
        return F.concat(*[F.coalesce(x.cast(GAP), none) for x in (F.array_compact(F.array(*single)), approvals, untimed, roles, needed)])

    return P.let(F.array_distinct(P.found(low, named)), listed)


def gap_summary(gaps: Column) -> Column:
    """(score, level, n, focus): severity weights times confidence, at most 100, its level, the number of gaps, and the codes of the five gravest."""
    weighted = F.transform(gaps, lambda g: F.struct((F.when(g["severity"] == "low", 2).when(g["severity"] == "high", 9).when(g["severity"] == "critical", 12).otherwise(5) * F.round(g["confidence"], 3)).alias("weight")))
    score = risk_score(weighted)
    focus = focus_areas(F.transform(gaps, lambda g: F.struct(g["code"].alias("message"), g["severity"].alias("severity"), g["confidence"].alias("confidence"))))
    return P.let(score, lambda s: F.struct(s.alias("score"), risk_level(s).alias("level"), F.size(gaps).alias("n"), focus.alias("focus")))
