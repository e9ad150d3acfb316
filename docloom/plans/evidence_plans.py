"""Queries of phrase banks: sentences as evidence, roles, flows, named standards and the domains they stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import phrases as P
from docloom.functions import style as S
from docloom.functions import structure as T
from docloom.operators import evidence as E
from docloom.plans.registry import query
from docloom.session import table

VERBS = ["review", "approve", "check", "file", "sign", "publish", "archive", "enforce", "provide"]
ROLES = {
    "Approver": E.Role(["chief editor", "editor"], ["en", "de"]),
    "Translator": E.Role(["translator", "interpreter"], ["*"]),
    "Owner": E.Role(["copyright holder", "licensor", "author"], [], ambiguous=True),
}
FLOWS = {
    "publishing": E.Flow({"write": ["shall review text"], "approve": ["and approve it", "approve the text"], "check": ["checks the"], "publish": ["publish and archive"], "license": ["without warranties or", "licensed under the"]}, ["approve", "publish"], ["approval"], ["src0"]),
    "licensing": E.Flow({"grant": ["permission is hereby", "you may obtain"], "limit": ["subject to the", "without restriction"], "warranty": ["without warranty of", "without warranties or"]}, ["grant", "warranty"], ["records"], ["src1"]),
}
STANDARDS = {
    "Apache License": E.Standard(["apache license", r"version 2\.0"], "software"),
    "GNU GPL": E.Standard(["general public license", r"\bgpl\b"], "software"),
    "Creative Commons": E.Standard(["creative commons", r"\bcc by\b"], "text"),
    "MIT License": E.Standard(["mit license", "permission is hereby granted"], "software"),
}


def _planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, each with sentences made of its columns at its end, so that roles and stages occur in all."""
    docs = table(spark, sf_dir, "documents")
    more = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("A translator checks the "), "lang", F.lit(" text. The translator files it. Then they publish and archive it.\n"))).otherwise("")
    end = F.concat(F.lit("\nThe chief editor of "), "source", F.lit(" shall review text "), "doc_id", F.lit(" and approve it.\n"), more)
    return docs.select("doc_id", "lang", "source", F.concat(F.coalesce("text", F.lit("")), end).alias("text"))


_TEXT = """src AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') || chr(10) || 'The chief editor of ' || source || ' shall review text ' || doc_id || ' and approve it.' || chr(10)
    || CASE WHEN doc_id % 3 = 0 THEN 'A translator checks the ' || lang || ' text. The translator files it. Then they publish and archive it.' || chr(10) ELSE '' END AS text FROM documents)"""
#: The same cuts as sentence_list(), one after another, with a control character at each.
_CUTS = "regexp_replace(regexp_replace(regexp_replace({c}, '([.!?])\\s+', '\\1' || chr(1), 'g'), '\\n{{2,}}', chr(1), 'g'), '\\n(\\s*(?:[-*•]|\\d+[.)]|[A-Z][A-Za-z ]{{2,}}:))', chr(1) || '\\1', 'g')"
_SENTENCES = f"list_filter(list_transform(string_split({_CUTS.format(c='text')}, chr(1)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: len(string_split(x, ' ')) >= 3)"
_QUOTED = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_HOLDS = "list_bool_or(list_transform({words}, lambda t: contains(lower({s}), t)))"
_WHOLE = "regexp_matches(lower({s}), '(^|[^\\p{{L}}\\p{{N}}_])(' || {t} || '){end}($|[^\\p{{L}}\\p{{N}}_])')"


@query(f"SELECT doc_id, CAST(len(ss) AS BIGINT) AS n_sentences, md5(array_to_string(list_transform(list_filter(ss, lambda s: contains(lower(s), 'license') OR contains(lower(s), 'the ')), lambda s: substr(s, 1, 450))[1:3], chr(10))) AS evidence_md5 FROM (SELECT doc_id, {_SENTENCES} AS ss FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))")
def sentence_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences (J4), and the first three that hold a word."""
    rows = table(spark, sf_dir, "documents").select("doc_id", P.sentence_list(F.coalesce("text", F.lit(""))).alias("ss"))
    held = F.slice(F.filter("ss", lambda s: P.any_of(F.lower(s), ["license", "the "])), 1, 3)
    return rows.select("doc_id", F.size("ss").cast("long").alias("n_sentences"), F.md5(F.array_join(F.transform(held, lambda s: F.substring(s, 1, P.EVIDENCE_CUT)), "\n")).alias("evidence_md5"))


def _role_sql(name: str, role: E.Role) -> str:
    """Patterns are constants: DuckDB then reads each once."""
    whole = lambda t, s, end="": _WHOLE.format(s=s, t=f"'{t}'", end=end).replace("' || '", "")
    hits = "list_filter([" + ", ".join(f"CASE WHEN {whole(t, 'text')} THEN '{t}' END" for t in role.terms) + "], lambda x: x IS NOT NULL)"
    named = " OR ".join(f"(list_contains(hits, '{t}') AND {whole(t, 's')})" for t in role.terms)
    actions = ", ".join(f"CASE WHEN list_bool_or(list_transform(mine, lambda s: {whole(v, 's', '(s|ed|ing)?')})) THEN '{v}' END" for v in VERBS)
    domain = "TRUE" if "*" in role.domains else f"lang IN ({', '.join(map(repr, role.domains))})" if role.domains else "FALSE"
    shows = " OR ".join([f"contains(lower(s), '{v}')" for v in VERBS] + [f"(list_contains(hits, '{t}') AND contains(lower(s), '{t}'))" for t in role.terms])
    return f"""SELECT rid, doc_id, '{name}' AS role, {domain} AS in_domain, {str(role.ambiguous).upper()} AS ambiguous, hits,
      list_filter([{actions}], lambda x: x IS NOT NULL) AS actions, list_filter(ss, lambda s: {shows})[1:5] AS evidence
      FROM (SELECT *, list_filter(ss, lambda s: {named}) AS mine FROM (SELECT *, {hits} AS hits FROM t) WHERE len(hits) > 0)"""


@query(
    f"""WITH {_TEXT}, t AS (SELECT *, {_SENTENCES} AS ss FROM src),
    r AS ({' UNION ALL '.join(_role_sql(n, r) for n, r in ROLES.items())}),
    p AS (SELECT *, (0.55::DOUBLE * len(hits) + 0.2::DOUBLE * len(actions) + 0.28::DOUBLE * len(evidence) + CASE WHEN in_domain THEN 0.55::DOUBLE ELSE 0 END) * CASE WHEN ambiguous AND len(hits) = 1 AND len(actions) = 0 THEN 0.55::DOUBLE ELSE 1 END AS points FROM r),
    c AS (SELECT *, round(least(0.96, 1 - exp(-points / 3.2)), 3) AS confidence FROM p)
    SELECT doc_id, role, array_to_string(list_sort(hits), ',') AS terms, array_to_string(list_sort(actions), ',') AS actions, CAST(len(evidence) AS INTEGER) AS n_evidence, md5(array_to_string(list_transform(evidence, lambda s: substr(s, 1, 450)), chr(10))) AS evidence_md5, confidence,
      CASE WHEN confidence >= 0.62 THEN 'detected' ELSE 'needs_review' END AS status FROM c WHERE confidence >= 0.52"""
)
def role_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles with their terms, actions and sentences."""
    found = E.roles(_planted(spark, sf_dir), ROLES, VERBS, domain_col="lang")
    joined = lambda c: F.array_join(c, ",").alias(c if c == "actions" else "terms")
    return found.select(F.col("id").alias("doc_id"), "role", joined("matched_terms"), joined("actions"), F.size("evidence").alias("n_evidence"), F.md5(F.array_join("evidence", "\n")).alias("evidence_md5"), "confidence", "status")


@query()
def raci_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The roles of each responsibility category in a document."""
    found = E.raci_summary(E.roles(_planted(spark, sf_dir), ROLES, VERBS, domain_col="lang"))
    return found.select(F.col("id").alias("doc_id"), "raci_category", F.array_join("roles", ",").alias("roles"))


def _flow_sql(name: str, flow: E.Flow) -> str:
    shown = "[" + ", ".join(f"CAST(len(list_filter(ss, lambda s: {_HOLDS.format(words=_QUOTED(v), s='s')})[1:3]) AS INTEGER)" for v in flow.stages.values()) + "]"
    core = ", ".join(str(list(flow.stages).index(c) + 1) for c in flow.core)
    return f"SELECT doc_id, '{name}' AS flow, {shown} AS shown, len(list_filter([{core}], lambda i: ({shown})[i] > 0)) AS n_core, {len(flow.core)} AS core, source IN ({', '.join(map(repr, flow.required_for))}) AS required FROM t"


@query(
    f"""WITH {_TEXT}, t AS (SELECT *, {_SENTENCES} AS ss FROM src), f AS ({' UNION ALL '.join(_flow_sql(n, f) for n, f in FLOWS.items())}),
    c AS (SELECT *, len(list_filter(shown, lambda x: x > 0)) AS n FROM f),
    s AS (SELECT *, round(least(1, 0.18::DOUBLE + n / len(shown) * 0.36::DOUBLE + n_core / core * 0.34::DOUBLE + CASE WHEN n > 1 THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN required THEN 0.12::DOUBLE ELSE 0 END), 3) AS confidence FROM c)
    SELECT doc_id, flow, confidence, CASE WHEN confidence >= 0.55 THEN 'detected' WHEN confidence >= 0.52 THEN 'needs_review' ELSE 'not_detected' END AS status, CAST(n AS INTEGER) AS n_stages, CAST(list_sum(shown) AS BIGINT) AS n_evidence, CAST(core - n_core AS INTEGER) AS n_missing, required FROM s"""
)
def flow_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows with the stages that sentences show, for each document."""
    found = E.flows(_planted(spark, sf_dir), FLOWS, kind_col="source")
    total = F.aggregate("stages", F.lit(0), lambda a, s: a + F.size(s["evidence"])).cast("long")
    return found.select(F.col("id").alias("doc_id"), "flow", "confidence", "status", F.size("stages").alias("n_stages"), total.alias("n_evidence"), F.size("missing_core").alias("n_missing"), "required")


_HELD = " UNION ALL ".join(f"SELECT rid, doc_id, '{n}' AS standard, '{s.domain}' AS domain, {' + '.join(f"regexp_matches(lower(text), '{p}')::INT" for p in s.patterns)} AS n FROM src" for n, s in STANDARDS.items())


@query(f"WITH {_TEXT} SELECT doc_id, standard, domain, n AS n_patterns, round(0.9::DOUBLE + least(0.07::DOUBLE, 0.02::DOUBLE * n), 3) AS confidence FROM ({_HELD}) WHERE n > 0")
def standards_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named standards by several patterns each (N2); licences are those that the texts name."""
    return E.standards(_planted(spark, sf_dir), STANDARDS).select(F.col("id").alias("doc_id"), "standard", "domain", "n_patterns", "confidence")


@query(
    f"""WITH {_TEXT}, h AS (SELECT doc_id, domain, count(*) AS n FROM ({_HELD}) WHERE n > 0 GROUP BY doc_id, domain),
    c AS (SELECT doc_id, 'text' AS domain, 0.6::DOUBLE AS confidence FROM documents WHERE lang = 'en'),
    b AS (SELECT doc_id, domain, c.confidence, CASE WHEN c.confidence IS NULL THEN 0.9::DOUBLE ELSE c.confidence END AS base, coalesce(n, 0) - (c.confidence IS NULL)::INT AS times, n FROM c FULL JOIN h USING (doc_id, domain))
    SELECT doc_id, domain, round(CASE WHEN times > 0 THEN greatest(base, least(0.96, base + 0.08::DOUBLE * times)) ELSE base END, 3) AS confidence,
      CASE WHEN confidence IS NULL THEN 'standard' WHEN n > 0 THEN 'candidate+standard' ELSE 'candidate' END AS source FROM b"""
)
def domain_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains of documents, raised by the standards that they name."""
    docs = _planted(spark, sf_dir)
    candidates = docs.filter("lang = 'en'").select(F.col("doc_id").alias("id"), F.lit("text").alias("domain"), F.lit(0.6).alias("confidence"))
    return E.domains_with_standards(candidates, E.standards(docs, STANDARDS)).select(F.col("id").alias("doc_id"), "domain", "confidence", "source")


@query()
def writing_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of lines, sentences and words, and what they say of a text's style."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("n", F.greatest(F.size(T.headings(F.col("text"))), F.lit(1)))
    found = rows.select("doc_id", S.style(F.col("text"), F.col("n")).alias("s"))
    return found.select("doc_id", "s.signals.*", "s.directive", "s.complexity", "s.formality", "s.formality_score", "s.tone", "s.primary_format")


@query(
    """WITH d AS (SELECT doc_id, coalesce(text, '') || chr(10) || 'Rule ' || source || ': the rule of ' || lang || ' texts' || chr(10) || 'Done within ' || (1 + doc_id % 40) || ' weeks by SOP-QA-' || lpad(CAST(doc_id % 900 AS VARCHAR), 3, '0') AS text, 'the rule of ' || lang || ' texts' AS definition FROM documents)
    SELECT doc_id, least(100, len(list_distinct(regexp_extract_all(regexp_replace(text, '[À-ÖØ-öø-ſ]', 'x', 'g'), '\\b[A-Z]{2,}(?:/[A-Z]{2,})?\\b')))) AS n_acronyms,
      list_contains(regexp_extract_all(text, 'within \\d+ week'), 'within ' || (1 + doc_id % 40) || ' week') AS timed, list_contains(regexp_extract_all(text, 'SOP-QA-\\d+'), 'SOP-QA-' || lpad(CAST(doc_id % 900 AS VARCHAR), 3, '0')) AS traced, definition FROM d"""
)
def terminology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acronyms, record ids, times and definitions of whole texts with a rule at their end."""
    n = F.col("doc_id")
    number = F.concat(F.lit("SOP-QA-"), F.lpad((n % 900).cast("string"), 3, "0"))
    time = F.concat(F.lit("within "), 1 + n % 40, F.lit(" week"))
    text = F.concat(F.coalesce("text", F.lit("")), F.lit("\nRule "), "source", F.lit(": the rule of "), "lang", F.lit(" texts\nDone "), time, F.lit("s by "), number)
    docs = table(spark, sf_dir, "documents").select("doc_id", text.alias("text"), F.concat(F.lit("Rule "), "source").alias("term"))
    t = F.col("text")
    return docs.select("doc_id", F.size(S.acronyms(t)).cast("long").alias("n_acronyms"), F.array_contains(S.timing_mentions(t), time).alias("timed"), F.array_contains(S.trace_ids(t), number).alias("traced"), F.get(F.filter(S.definitions(t), lambda d: d["term"] == F.col("term")), F.lit(0))["definition"].alias("definition"))


_PHRASE_WORDS = f"list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z][A-Za-z0-9_/-]*'), lambda x: lower(x)), lambda x: length(x) >= 3 AND NOT list_contains({_QUOTED(S.STOP)}, x))"


@query(
    f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_PHRASE_WORDS} AS w FROM documents),
    p AS (SELECT rid, doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT rid, doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (VALUES (2), (3)) v(k))),
    c AS (SELECT rid, doc_id, k, phrase, count(*) AS n, min(i) AS first FROM p GROUP BY ALL HAVING count(*) > 1)
    SELECT doc_id, phrase, n AS count, CAST(row_number() OVER (PARTITION BY rid ORDER BY n DESC, k, first) AS INTEGER) AS rank FROM c QUALIFY row_number() OVER (PARTITION BY rid ORDER BY n DESC, k, first) <= 60"""
)
def key_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent phrases of each text."""
    return E.key_phrases(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "phrase", "count", "rank")


@query()
def document_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document lacks, with risk score, level and focus, from its sections, flows and roles."""
    docs = _planted(spark, sf_dir)
    flows = E.flows(docs, FLOWS, kind_col="source").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("flow", "status", "missing_core", "required", F.lit(False).alias("has_timing")))).alias("flows"))
    named = E.roles(docs, ROLES, VERBS, domain_col="lang").filter("status = 'detected'").groupBy("id").agg(F.collect_set("role").alias("named"))
    rows = docs.withColumn("heads", T.headings(F.col("text"))).join(flows, docs["doc_id"] == flows["id"], "left").drop("id")
    rows = rows.join(named, rows["doc_id"] == named["id"], "left").drop("id").withColumn("named", F.coalesce("named", F.array().cast("array<string>")))
    labels = F.transform("heads", lambda h: h["label"])
    missing = F.array_except(F.array(*map(F.lit, ROLES)), "named")
    title = F.get(F.transform("heads", lambda h: h["title"]), F.lit(0))

    version = F.nullif(F.regexp_extract("text", r"(?i)\bversion\s+(\d+)", 1), F.lit(""))
    gaps = E.gap_list(F.col("text"), labels, title, version, F.col("flows"), missing, F.array_contains("named", "Approver"), F.size("heads"), approval=["approve"], escalation=["escalate"], controls=["review", "checks", "files", "provide"])
    found = rows.select("doc_id", gaps.alias("gaps")).select("doc_id", "gaps", E.gap_summary(F.col("gaps")).alias("s"))
    groups = F.array_join(F.array_sort(F.array_distinct(F.transform("gaps", lambda g: g["group"]))), ",")
    return found.select("doc_id", "s.score", "s.level", "s.n", F.array_join("s.focus", ",").alias("focus"), groups.alias("groups"))
