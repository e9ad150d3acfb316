"""Writing style, terminology and definitions of a text, in its own row."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions import phrases as P
from docloom.functions.text import TOKEN, normalize_space

# Words of obligation and action, forms of lines, names and times, and the thresholds of the labels.
MODALS = {
    "mandatory": ["shall", "must", "is required to", "are required to", "mandatory", "muss", "müssen", "hat zu", "ist verpflichtet"],
    "recommended": ["should", "recommended", "sollte", "sollen", "empfohlen"],
    "permissive": ["may", "can", "permitted", "allowed", "kann", "dürfen", "erlaubt"],
    "prohibited": ["shall not", "must not", "may not", "prohibited", "not permitted", "darf nicht", "nicht autorisiert", "nicht erlaubt", "verbot"],
}
ACTIONS = [
    "verify", "ensure", "perform", "execute", "document", "record", "review", "approve", "submit", "notify", "escalate", "investigate", "assess", "classify", "close", "release", "archive",
    "train", "retain", "monitor", "control", "validate", "authorize", "implement", "check", "create", "update", "delete", "grant", "revoke", "disable", "enable", "report", "maintain",
]
BULLET_LINE = r"^\s*(?:[-*•]|[a-zA-Z]\)|\d+[.)])\s+"
NUMBERED_LINE = r"^\s*\d+(?:\.\d+)*[.)]?\s+"
FORM_LINE = r"^\s*[A-Za-z][A-Za-z ]{2,45}:\s*.+"
PASSIVE = r"(?iU)\b(?:is|are|was|were|be|been|being)\s+\w+(?:ed|en)\b"
#: A word's end is looked at once, from behind, instead of after each of its letters.
NOMINAL = r"(?iU)\b\w++(?:(?<=\wtion)|(?<=\wment)|(?<=\wance)|(?<=\wence)|(?<=\wity)|(?<=\wness))"
CONTRACTION = r"(?iU)\b\w+'(?:t|re|ve|ll|d|m)\b"
ACRONYM = r"(?U)\b[A-Z]{2,}(?:/[A-Z]{2,})?\b"
TRACE_ID = r"(?i)\b(?:SOP|WI|POL|FORM|FRM|DEV|CAPA|AUD|NCR|CC|CR|DEC|TRN|VAL|QMS|IT|SEC)-?[A-Z0-9]{2,}[-/]?\d{2,6}\b"
TIMING = (
    r"(?i)\b(within\s+\d+\s+(?:minute|minutes|hour|hours|day|days|working day|working days|business day|business days|week|weeks|month|months)|no later than\s+[^.;\n]+|not later than\s+[^.;\n]+|"
    r"every\s+\d+\s+(?:month|months|year|years|day|days|week|weeks)|(?:daily|weekly|monthly|quarterly|annually|yearly|immediately|before|after|prior to)\b)"
)
DEFINITIONS = [
    r"(?im)^\s*([A-Z][A-Za-z0-9 /()_-]{1,45})\s*[:=-]\s*(.{5,240})$",
    r"(?i)\b([A-Z][A-Za-z0-9 /()_-]{1,45})\s+means\s+(.{5,240}?)(?:\.|;|\n)",
    r"(?im)\b([A-Z]{2,}(?:/[A-Z]{2,})?)\s*[:=-]\s*(.{5,220})$",
]
NO_TERMS = ["procedure", "purpose", "scope", "records", "document", "revision", "table", "figure", "form", "appendix", "section", "responsibilities", "the", "this", "when", "where", "if", "shall", "must", "may", "should", "critical", "normal"]
STOP = ["the", "and", "for", "with", "shall", "must", "should", "may", "can", "this", "that", "from", "will", "are", "is", "be", "by", "to", "of", "in", "on", "or", "as", "an", "a", "any"]
MOST = {"timing": 40, "acronyms": 100, "trace_ids": 150, "definitions": 50, "phrases": 60}


def _words(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != ""))


def median(values: Column) -> Column:
    """The middle of an array of numbers, the mean of the two middle ones of an even number; 0 for none."""
    mid = lambda s: (F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")) + F.get(s, F.floor(F.size(s) / 2).cast("int"))) / 2
    return F.coalesce(P.let(F.array_sort(values), mid), F.lit(0.0)).cast("double")


def signals(text: Column) -> Column:
    """Counts of lines, sentences and words of each kind."""
    lines = F.transform(F.split(text, r"\r\n|[\n\r]"), lambda x: F.regexp_replace(x, r"\s+$", ""))
    count = lambda p: F.regexp_count(text, F.lit(p))
    starts = "(?iU)^(?:" + "|".join(ACTIONS) + r")\b"

    def counted(ls: Column, ss: Column, modals: Column) -> Column:
        like = lambda p: F.size(F.filter(ls, lambda x: x.rlike(p)))
        full = F.filter(ls, lambda x: F.trim(x) != "")
        sizes = F.transform(ss, lambda s: F.size(F.split(s, " ")))  # sentences have single blanks
        modal = lambda terms: F.size(F.filter(modals, lambda m: m.isin(terms)))
        total = lambda v: F.aggregate(v, F.lit(0), lambda a, x: a + x)
        return F.struct(
            F.size(ls).alias("lines"), like(BULLET_LINE).alias("bullets"), like(NUMBERED_LINE).alias("numbered"),
            F.size(F.filter(ls, lambda x: (F.regexp_count(x, F.lit(r"\|")) >= 2) | x.contains("\t"))).alias("tables"), like(FORM_LINE).alias("forms"),
            F.size(ss).alias("sentences"), count(TOKEN).alias("tokens"),
            (total(sizes) / F.greatest(F.size(ss), F.lit(1))).alias("mean_sentence"), median(sizes).alias("median_sentence"),
            (total(F.transform(full, lambda x: _words(x))) / F.greatest(F.size(full), F.lit(1))).alias("mean_line"),
            count(PASSIVE).alias("passive"), F.size(F.filter(ss, lambda s: s.rlike(starts))).alias("imperative"), count(ACRONYM).alias("acronyms"), count(NOMINAL).alias("nominal"), count(CONTRACTION).alias("contractions"),
            *[modal(terms).alias(name) for name, terms in MODALS.items()],
        )

    # the words of all kinds in one search
    modals = P.found(F.lower(text), [t for terms in MODALS.values() for t in terms])
    return P.let(lines, lambda ls: P.let(P.sentence_list(text), lambda ss: P.let(modals, lambda ms: counted(ls, ss, ms))))


def style(text: Column, n_sections: Column) -> Column:
    """The signals with directive, complexity, formality (and its score), tone and primary_format; n_sections: a text without headings is one section."""

    def judged(s: Column) -> Column:
        sentences, tokens = F.greatest(s["sentences"], F.lit(1)), F.greatest(s["tokens"], F.lit(1))
        directive = (
            F.when((s["mandatory"] >= F.greatest(s["recommended"], s["permissive"])) & (s["mandatory"] > 0), "mandatory/controlled")
            .when(s["imperative"] / sentences > 0.22, "imperative/action-led")
            .when(s["recommended"] > s["mandatory"], "guidance/recommendation-led")
            .otherwise("descriptive/mixed")
        )
        complexity = F.when((s["mean_sentence"] >= 26) | (s["nominal"] / tokens > 0.065), "high").when(s["mean_sentence"] >= 16, "medium").otherwise("low_to_medium")
        most = lambda x: F.least(x, F.lit(1.0))
        score = (
            most(s["mandatory"] / sentences) * 0.30
            + most(s["passive"] / sentences) * 0.18
            + most(s["nominal"] / F.greatest(tokens / 100, F.lit(1.0))) * 0.20
            + F.when(s["contractions"] == 0, 0.12).otherwise(0.0)
            + F.when(n_sections >= 4, 0.12).otherwise(0.0)
            + F.when((s["tables"] > 0) | (s["forms"] > 0), 0.08).otherwise(0.0)
        )
        shape = (
            F.when(s["tables"] >= F.greatest(F.lit(5), s["numbered"], s["bullets"]), "table_dominant")
            .when((s["numbered"] >= 3) & (n_sections >= 3), "controlled_numbered_sop")
            .when((s["bullets"] >= 5) & (n_sections >= 2), "checklist_or_bullet_sop")
            .when(s["forms"] >= 5, "form_based_sop")
            .when(n_sections >= 3, "sectioned_sop")
            .otherwise("free_prose_or_short_instruction")
        )
        names = lambda x: x["formality_score"]
        first = F.struct(s.alias("signals"), directive.alias("directive"), complexity.alias("complexity"), score.alias("formality_score"), shape.alias("primary_format"))

        def toned(x: Column) -> Column:
            formality = F.when(names(x) >= 0.70, "highly_formal").when(names(x) >= 0.45, "formal").otherwise("standard")
            tone = (
                F.when((x["directive"] == "mandatory/controlled") & (names(x) >= 0.45), "formal_regulatory")
                .when(x["directive"] == "imperative/action-led", "instructional_procedural")
                .when(s["acronyms"] / tokens > 0.06, "technical_operational")
                .when(s["recommended"] > s["mandatory"], "guidance_advisory")
                .otherwise("mixed_descriptive")
            )
            return F.struct(x["signals"].alias("signals"), x["directive"].alias("directive"), x["complexity"].alias("complexity"), formality.alias("formality"), F.round(names(x), 3).alias("formality_score"), tone.alias("tone"), x["primary_format"].alias("primary_format"))

        return P.let(first, toned)

    return P.let(signals(F.coalesce(text, F.lit(""))), judged)


def _distinct(c: Column, pattern: str, most: int, group: int = 0) -> Column:
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(group))
    return F.slice(F.array_sort(F.array_distinct(F.transform(found, lambda x: normalize_space(x)))), 1, most)


def timing_mentions(c: Column) -> Column:
    """Sorted mentions of terms and frequencies."""
    return _distinct(c, TIMING, MOST["timing"], 1)


def acronyms(c: Column) -> Column:
    return _distinct(c, ACRONYM, MOST["acronyms"])


def trace_ids(c: Column) -> Column:
    return _distinct(c, TRACE_ID, MOST["trace_ids"])


def definitions(c: Column) -> Column:
    """(term, definition): "term: text", "term means text", "ABC - text"; each term where it first stands, of seven words at most, with three words or more."""
    text = F.coalesce(c, F.lit(""))

    def of(pattern: str) -> Column:
        # the text is searched once; the parts are then read from what was found, whose end is the end of the match
        whole = re.sub(r"\(\?i(m?)\)", "(?i)", pattern, count=1).removesuffix("$") + r"\z"
        part = lambda m, g: normalize_space(F.regexp_extract(m, whole, g))
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.struct(part(m, 1).alias("term"), part(m, 2).alias("definition")))

    good = lambda x: (_words(x["term"]) <= 7) & (_words(x["definition"]) >= 3) & ~F.lower(x["term"]).isin(NO_TERMS)
    found = F.filter(F.flatten(F.array(*map(of, DEFINITIONS))), good)

    def once(rows: Column) -> Column:
        keys = F.transform(rows, lambda x: F.lower(x["term"]))
        firsts = lambda ks: F.filter(rows, lambda x, i: F.array_position(ks, F.lower(x["term"])) == i + 1)
        return P.let(keys, firsts)

    return F.slice(P.let(found, once), 1, MOST["definitions"])


def filtered_words(c: Column) -> Column:
    """Lower-case words of three letters or more that aren't stop words; phrases are runs of these."""
    words = F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(TOKEN), F.lit(0)), lambda w: F.lower(w))
    return F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(STOP))

