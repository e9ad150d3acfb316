"""Deterministic language, style, keyword-bank and risk features as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Marker words of the light language test.
GERMAN = ["der", "die", "das", "und", "ist", "nicht", "mit", "für"]
ENGLISH = ["the", "and", "is", "not", "with", "for", "of", "to"]
SEVERITY = {"low": 2, "medium": 5, "high": 9, "critical": 12}
#: Weights of keyword-bank scores: where a term stands, and how telling it is.
ZONES = {"title": 3.2, "headings": 2.4, "procedure": 1.7, "sectioned": 1.2, "body": 0.7}
CLASSES = {"title": 1.55, "high": 1.20, "medium": 0.72, "low": 0.38}
NEGATIVE = -1.4
WEAK_HIT = 0.45
TITLE_LINES = 15
SPECIFICITY = 50
LETTERS = "a-z0-9äöüßéèêçñáíóú"
#: Banks of the test tables' languages: label -> class -> terms.
BANKS = {
    "english": {"high": ["the", "that"], "medium": ["with", "from"], "low": ["to", "in"], "negative": ["der", "les"]},
    "german": {"high": ["der", "und"], "medium": ["nicht", "für"], "low": ["in", "das"], "negative": ["the", "los"]},
    "french": {"high": ["les", "des"], "medium": ["pour", "avec"], "low": ["en", "et"], "negative": ["the", "und"]},
    "spanish": {"high": ["los", "que"], "medium": ["para", "con"], "low": ["en", "de"], "negative": ["the", "der"]},
}


def _spaced(c: Column, letters: str) -> Column:
    """Lower-cased words with two blanks between them, so that matches of neighbours don't overlap."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(c), f"[^{letters}]+", "  "), F.lit(" "))


def marker_hits(c: Column, words: list[str]) -> Column:
    spaced = _spaced(c, "a-zäöüß")
    return sum((F.regexp_count(spaced, F.lit(f" {w} ")) for w in words), F.lit(0)).cast("long")


def language_light(c: Column) -> list[Column]:
    de, en = marker_hits(c, GERMAN), marker_hits(c, ENGLISH)
    language = F.when((de >= 3) & (en >= 3), "bilingual").when(de > en, "de").otherwise("en")
    return [de.alias("de_hits"), en.alias("en_hits"), language.alias("language")]


def script_ratios(c: Column) -> list[Column]:
    size = F.greatest(F.length(c), F.lit(1))
    ratio = lambda p: F.round(F.regexp_count(c, F.lit(p)) / size, 6)
    return [ratio("[A-Za-z]").alias("latin_ratio"), ratio("[äöüßÄÖÜ]").alias("german_ratio"), ratio("[0-9]").alias("digit_ratio")]


def gap(condition: Column, code: str, severity: str, confidence: float) -> Column:
    return F.when(condition, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(SEVERITY[severity] * confidence).alias("weight")))


def risk_score(gaps: Column) -> Column:
    """Severity weights times confidence, rounded and capped at 100."""
    total = F.aggregate(gaps, F.lit(0.0), lambda acc, g: acc + g["weight"])
    return F.least(F.lit(100), F.round(total)).cast("long")


def _held_terms(c: Column, terms: list[str]) -> Column:
    """The terms that a text holds, words for words in lower case; one pass over its words for all terms of one word."""
    plain = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), f"[^{LETTERS}]+", " ")
    single, phrases = [t for t in terms if " " not in t], [t for t in terms if " " in t]
    held = F.array_intersect(F.array(*map(F.lit, single)) if single else F.array().cast("array<string>"), F.split(plain, " "))
    if not phrases:
        return held
    return F.concat(held, F.filter(F.array(*map(F.lit, phrases)), lambda t: F.concat(F.lit(" "), plain, F.lit(" ")).contains(F.concat(F.lit(" "), t, F.lit(" ")))))


def title_zone(c: Column) -> Column:
    lines = F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_join(F.slice(lines, 1, TITLE_LINES), "\n")


def bank_score(zones: Column, bank: dict[str, list[str]]) -> Column:
    """Zone weight times class weight of each term a zone holds, less 1.4 for each negative term of the body;
    a single hit of a medium or low term counts WEAK_HIT of that. zones: a struct of held terms by zone."""
    score, anywhere, strong = F.lit(0.0), [], F.lit(False)
    for kind, weight in CLASSES.items():
        for term in bank.get(kind, []):
            held = {z: F.array_contains(zones[z], term) for z in ZONES}
            for z, zone_weight in ZONES.items():
                score = score + F.when(held[z], zone_weight * weight).otherwise(0.0)
            seen = held["title"] | held["headings"] | held["procedure"] | held["sectioned"] | held["body"]
            anywhere.append(F.when(seen, F.lit(term)))
            strong = strong | (seen if kind in ("title", "high") else F.lit(False))
    for term in bank.get("negative", []):
        score = score + F.when(F.array_contains(zones["body"], term), NEGATIVE).otherwise(0.0)
    hits = F.size(F.array_distinct(F.array_compact(F.array(*anywhere)))) if anywhere else F.lit(0)
    return F.when((hits == 1) & ~strong, score * WEAK_HIT).otherwise(score)


def bank_confidence(score: Column) -> Column:
    return F.round(F.least(F.lit(0.97), 1 - F.exp(-F.greatest(score, F.lit(0.0)) / 3.2)), 3)


def bank_zones(text: Column, terms: list[str], sections: dict[str, Column] | None = None) -> Column:
    """The struct of terms held by zone: title lines and body, and those of detected sections where they are given."""
    raw = {"title": title_zone(text), "headings": F.lit(""), "procedure": F.lit(""), "sectioned": F.lit("")} | (sections or {}) | {"body": text}
    return F.struct(*[(_held_terms(raw[z], terms) if z in ("title", "body", *(sections or {})) else F.array().cast("array<string>")).alias(z) for z in ZONES])


def classify_banks(docs: DataFrame, banks: dict, threshold: float = 0.46, top: int = 6, specificity: dict[str, int] | None = None, sections: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, label, confidence, rank): banks that reach the threshold, best first; ties by specificity, then by score.

    The labels of one document are scored and sorted in its own row, so nothing is shuffled; its zones
    are split into words once for all terms.
    """
    terms = sorted({t for bank in banks.values() for kind in bank.values() for t in kind})

    def all_labels(zones: Column) -> Column:
        return F.array(
            *[
                F.struct(bank_score(zones, bank).alias("score"), F.lit((specificity or {}).get(label, SPECIFICITY)).alias("priority"), F.lit(-i).alias("ord"), F.lit(label).alias("label"))
                for i, (label, bank) in enumerate(banks.items())
            ]
        )

    scored = F.transform(F.array(bank_zones(F.col("text"), terms, sections)), all_labels)[0]
    ranked = F.transform("scored", lambda x: F.struct(bank_confidence(x["score"]).alias("confidence"), x["priority"].alias("priority"), x["score"].alias("score"), x["ord"].alias("ord"), x["label"].alias("label")))
    kept = F.slice(F.sort_array(F.filter(ranked, lambda x: x["confidence"] >= threshold), asc=False), 1, top)
    # posexplode_outer: for posexplode Spark would add a filter that scores each text once more
    rows = docs.select("doc_id", scored.alias("scored")).select("doc_id", F.posexplode_outer(kept).alias("at", "s")).filter("s is not null")
    return rows.select("doc_id", "s.label", "s.confidence", (F.col("at") + 1).alias("rank"))


def bank_sql() -> str:
    """The same classification as DuckDB SQL, without sections."""
    spaced = f"' ' || regexp_replace(lower({{c}}), '[^{LETTERS}]+', ' ', 'g') || ' '"
    labels = []
    for i, (label, bank) in enumerate(BANKS.items()):
        terms = [f"CASE WHEN contains({z}, ' {t} ') THEN {ZONES[z]}::DOUBLE * {w}::DOUBLE ELSE 0 END" for k, w in CLASSES.items() for t in bank.get(k, []) for z in ("title", "body")]
        terms += [f"CASE WHEN contains(body, ' {t} ') THEN {NEGATIVE}::DOUBLE ELSE 0 END" for t in bank["negative"]]
        weak = " + ".join(f"contains(body, ' {t} ')::INT" for k in ("medium", "low") for t in bank.get(k, []))
        strong = " + ".join(f"contains(body, ' {t} ')::INT" for k in ("title", "high") for t in bank.get(k, []))
        labels.append(f"SELECT doc_id, '{label}' AS label, {i} AS ord, ({' + '.join(terms)}) * CASE WHEN {weak} = 1 AND {strong} = 0 THEN {WEAK_HIT}::DOUBLE ELSE 1 END AS score FROM z")
    return f"""
    WITH l AS (SELECT doc_id, text, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1:{TITLE_LINES}], chr(10)) AS head FROM documents),
    z AS (SELECT doc_id, {spaced.format(c="head")} AS title, {spaced.format(c='text')} AS body FROM l),
    s AS ({' UNION ALL '.join(labels)}),
    c AS (SELECT doc_id, label, ord, score, round(least(0.97, 1 - exp(-greatest(score, 0) / 3.2)), 3) AS confidence FROM s)
    SELECT doc_id, label, confidence, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, score DESC, ord) AS rank FROM c WHERE confidence >= 0.46
    """


def patterns_held(docs: DataFrame, patterns: dict[str, str], base: float = 0.90, step: float = 0.02, most: float = 0.07) -> DataFrame:
    """(doc_id, standard, hits, confidence) of standards whose pattern a text holds: base + min(most, step * hits)."""
    found = F.array(*[F.struct(F.lit(k).alias("standard"), F.regexp_count("text", F.lit(p)).alias("hits")) for k, p in patterns.items()])
    rows = docs.select("doc_id", F.explode(F.filter(found, lambda x: x["hits"] > 0)).alias("f"))
    return rows.select("doc_id", "f.standard", "f.hits", F.bround(base + F.least(F.lit(most), step * F.col("f.hits")), 3).alias("confidence"))


def capped_score(counts: dict[str, Column], rules: dict[str, tuple[int, int]], cap: int = 100) -> Column:
    """Sum of weight * min(count, limit), at most cap; rules: name -> (weight, limit)."""
    parts = [F.least(counts[k], F.lit(limit)) * weight for k, (weight, limit) in rules.items()]
    return F.least(sum(parts, F.lit(0)), F.lit(cap)).cast("long")


def grade(score: Column) -> Column:
    return F.when(score >= 80, "A").when(score >= 65, "B").when(score >= 50, "C").otherwise("D")


def workflow(c: Column, stages: list[str], core: list[str], required: list[str]) -> Column:
    """.18 + .36 stages + .34 core + .10 order (two stages or more) + .12 required, clamped to 0 to 1."""
    held = {s: c.contains(s).cast("int") for s in {*stages, *core, *required}}
    n = sum((held[s] for s in stages), F.lit(0))
    share = lambda names: sum((held[s] for s in names), F.lit(0)) / len(names)
    order = (n >= 2).cast("int")
    raw = 0.18 + 0.36 * (n / len(stages)) + 0.34 * share(core) + 0.10 * order + 0.12 * (share(required) == 1).cast("int")
    return F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))).otherwise(F.lit(0.0))


def labelled_value(c: Column, label: str, stops: list[str]) -> Column:
    """What follows a label up to the next known label or the line's end; null if there is none."""
    until = "|".join(f"{s}\\s*:" for s in stops)
    return F.nullif(F.trim(F.regexp_extract(c, rf"(?i)\b{label}\s*:\s*(.*?)(?=\s*(?:{until})|\n|$)", 1)), F.lit(""))


def is_heading(line: Column) -> Column:
    """Up to 100 characters: numbered words, or upper case of fewer than six words."""
    numbered = line.rlike(r"^\d+(?:\.\d+)*[.)]?\s+\p{Lu}")
    upper = (F.upper(line) == line) & (F.lower(line) != line) & (F.size(F.split(line, r"\s+")) < 6)
    return (F.length(line) <= 100) & (numbered | upper)


def fill_placeholders(c: Column, values: Column) -> Column:
    """{{ name }} replaced from a map, by exact name, then in any case; unknown ones stay."""
    names = F.array_distinct(F.regexp_extract_all(c, F.lit(r"\{\{\s*([\w.-]+)\s*\}\}"), F.lit(1)))
    folded = F.transform_keys(values, lambda k, v: F.lower(k))

    def put(text: Column, name: Column) -> Column:
        value = F.coalesce(values[name], folded[F.lower(name)])
        pattern = F.concat(F.lit(r"\{\{\s*\Q"), name, F.lit(r"\E\s*\}\}"))
        safe = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
        return F.when(value.isNull(), text).otherwise(F.regexp_replace(text, pattern, safe))

    return F.aggregate(names, c, put)
