"""Parts of model answers and requests: blocks, citations, suggestions, JSON, limits asked for, what a rewrite changed."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from docloom.functions.structure import strip

# Marks of an answer's parts, and limits.
SUGGESTIONS, CITATIONS = "---SUGGESTIONS---", "---CITATIONS---"
MAX_SUGGESTIONS, FALLBACK_CHARS, MAX_STARTS = 4, 8000, 40
EMBEDDED_HEADS = r"deviation|capa|audit(?:\s+finding)?|decision|sop"
EMBEDDED_LEAST, EMBEDDED_MOST = 80, 3000
PROLOGUE = r"(?is)^(?:here(?:is|’s|s)?\b|below\b|sure[,!]?\s*$|ok(?:ay)?[,!]?\s*$|this is|output\s*:|result\s*:|the json is|assistant\s*:|response\s*:)"
RECORD_HEAD = r"(?i)\s*((?:DEV|CAPA|AUD|DEC)-[A-Z]{2,}-\d{2,}\s*[–-])"
LINE_LIMITS = [
    r"(?i)\b(?:in|into|within|auf|using|with|as|to)\s+(\d{1,3})\s*(?:lines?|zeilen?|line\s+limit)\b",
    r"(?i)\b(\d{1,3})\s*[-\s]*(?:line|zeilen)(?:\s+limit)?\b",
    r"(?i)\b(?:rewrite|improve|explain|describe|fasse|zusammenfass)\w*[^.?\n]{0,100}?\b(\d{1,3})\s*(?:lines?|zeilen?)\b",
]
WORD_LIMIT = r"(?i)\b(\d{2,5})\s*(?:words?|wörter|woerter)\b"
BULLETS = r"(?i)\b(?:bullet|bullets|numbered\s+list|aufzählung)\b"


def _block(text: Column, head: str, ends: str) -> Column:
    """What follows a head in brackets, up to the next one of ends or the text's end; null without the head."""
    pattern = rf"(?is)\[{head}\](.*?)(?={ends}\z)"
    return F.when(text.rlike(rf"(?i)\[{head}\]"), strip(F.regexp_extract(text, pattern, 1)))


def _texts(raw: Column) -> Column:
    """The strings of a JSON array, other values left out; none if it can't be read."""
    values = F.try_variant_get(F.try_parse_json(raw), "$", "array<variant>")
    return F.coalesce(F.transform(F.filter(values, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: v.cast("string")), F.array().cast("array<string>"))


def answer_parts(raw: Column) -> Column:
    """(answer, citations, suggestions, reasoning, confidence) of a model's answer; parts that aren't there are empty.

    Without an [ANSWER] block the answer is all that stands before the citations; where that block is blank, the rest without the other blocks.
    Citations are [[ref|title|type|excerpt]]; others are left out. At most four suggestions, strings only.
    """
    whole = F.coalesce(raw, F.lit(""))
    listed = rf"(?is){SUGGESTIONS}\s*(\[.*?\])"
    suggestions = F.slice(_texts(F.regexp_extract(whole, listed, 1)), 1, MAX_SUGGESTIONS)
    before = F.when(whole.rlike(listed), strip(F.regexp_replace(whole, rf"{listed}.*\z", ""))).otherwise(whole)

    def parts(text: Column) -> Column:
        pieces = F.split(text, CITATIONS)
        content, cited = strip(pieces[0]), F.coalesce(F.get(pieces, F.lit(1)), F.lit(""))
        form = r"(?d)\[\[(.*?)\|(.*?)\|(.*?)\|(.*?)\]\]"
        field = lambda m, i: strip(F.regexp_extract(m, form, i))
        citations = F.transform(F.regexp_extract_all(cited, F.lit(form), F.lit(0)), lambda m: F.struct(*[field(m, i + 1).alias(n) for i, n in enumerate(("ref", "title", "type", "excerpt"))]))
        return F.struct(content.alias("content"), citations.alias("citations"))

    def made(p: Column) -> Column:
        c = p["content"]
        reasoning = _block(c, "REASONING", r"\[ANSWER\]|\[CONFIDENCE\]|")
        answer = F.coalesce(_block(c, "ANSWER", r"\[CONFIDENCE\]|\[REASONING\]|"), c)
        bare = strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"(?is)\[REASONING\].*?(?=\[ANSWER\]|\[CONFIDENCE\]|\z)", ""), r"(?i)\[ANSWER\]\s*", ""), r"(?is)\[CONFIDENCE\].*\z", ""))
        answer = F.when(answer == "", F.substring(bare, 1, FALLBACK_CHARS)).otherwise(answer)
        empty = F.lit("")
        return F.struct(answer.alias("answer"), p["citations"].alias("citations"), suggestions.alias("suggestions"), F.coalesce(reasoning, empty).alias("reasoning"), F.coalesce(_block(c, "CONFIDENCE", ""), empty).alias("confidence"))

    return F.transform(F.transform(F.array(before), parts), made)[0]


def without_sources(c: Column) -> Column:
    """Without what follows a line of sources, citations or suggestions."""
    out = strip(c)
    for mark in (r"\n?\s*(?:📎\s*)?sources?\s*:.*\z", r"\n?\s*---\s*CITATIONS?\s*---.*\z", r"\n?\s*---\s*SUGGESTIONS?\s*---.*\z"):
        out = F.regexp_replace(out, rf"(?is){mark}", "")
    return F.regexp_replace(out, r"\s+\z", "")


def bare_json(c: Column) -> Column:
    """Without code fences, sources and a short preface such as "Here is"."""
    text = F.regexp_replace(strip(F.coalesce(c, F.lit(""))), "^﻿", "")
    text = strip(F.regexp_replace(F.regexp_replace(text, r"(?im)^\s*```(?:json)?\s*", ""), r"(?m)\s*```\s*$", ""))
    text = without_sources(text)
    preface = F.trim(F.substring_index(text, "{", 1))
    from_brace = F.regexp_extract(text, r"(?s)\{.*\z", 0)
    return F.when((from_brace != "") & F.length(preface).between(2, 400) & preface.rlike(PROLOGUE), from_brace).otherwise(text)


def _first_object(text: str | None) -> str | None:
    """The first brace from which a whole object can be read; null after MAX_STARTS others."""
    at, read = -1, json.JSONDecoder()
    for _ in range(MAX_STARTS):
        at = (text or "").find("{", at + 1)
        if at < 0:
            return None
        try:
            found, _ = read.raw_decode(text, at)
        except (ValueError, RecursionError):
            continue
        return json.dumps(found, ensure_ascii=False)
    return None


@F.pandas_udf(StringType())
def first_object(texts: pd.Series) -> pd.Series:
    """The first JSON object within a text, whatever stands around it."""
    return texts.map(_first_object)


def embedded_sections(text: Column, heading: str) -> Column:
    """Bodies of 80 characters or more under a head such as "Deviation:", up to the next head; at most 3000 characters of each."""
    pattern = rf"(?ims)^\s*(?:\d+[.)]\s*)?(?:{heading})\s*[:\-]\s*(.+?)(?=^\s*(?:\d+[.)]\s*)?(?:{EMBEDDED_HEADS})\s*[:\-]|\z)"
    bodies = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(1)), lambda b: strip(b))
    return F.transform(F.filter(bodies, lambda b: F.length(b) >= EMBEDDED_LEAST), lambda b: F.substring(b, 1, EMBEDDED_MOST))


def heads_on_lines(text: Column, heads: str = RECORD_HEAD) -> Column:
    """Heads of records within a line put on lines of their own, no more than one blank line in a row."""
    return strip(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), heads, "\n\n$1"), r"\n{3,}", "\n\n"))


def limits_asked(message: Column) -> Column:
    """(lines, words, format) that a message asks for: 1 to 120 lines, 10 to 10000 words, plain_lines or bullets; null where it doesn't."""
    first = lambda p: F.nullif(F.regexp_extract(message, p, 1), F.lit("")).cast("int")
    lines, words = F.coalesce(*[first(p) for p in LINE_LIMITS]), first(WORD_LIMIT)
    within = lambda n, a, b: F.when(n.isNotNull(), F.greatest(F.lit(a), F.least(F.lit(b), n)))
    shape = F.when(lines.isNotNull(), "plain_lines").when(message.rlike(BULLETS), "bullets")
    return F.struct(within(lines, 1, 120).alias("lines"), within(words, 10, 10_000).alias("words"), shape.alias("format"))


def new_terms(old: Column, new: Column, stop: list[str], limit: int = 4) -> Column:
    """The first words of four letters or more that the old text lacks, whatever their case."""
    words = lambda c: F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?U)\b\w{4,}\b"), F.lit(0))
    known = F.transform(words(old), lambda w: F.lower(w))
    fresh = lambda k: F.filter(words(new), lambda w: ~F.array_contains(k, F.lower(w)))
    return F.slice(F.array_distinct(F.transform(F.array(F.array_union(F.array_distinct(known), F.array(*map(F.lit, stop)).cast("array<string>"))), fresh)[0]), 1, limit)


def changes(old: Column, new: Column) -> Column:
    """What a rewrite did: fewer_lines or more_lines, longer (by over 8 %) or shorter (by over 8 %)."""
    count = lambda c: F.size(F.filter(F.split(c, r"\r\n|[\n\r]"), lambda x: F.trim(x) != ""))
    a, b = F.coalesce(old, F.lit("")), F.coalesce(new, F.lit(""))
    lines = F.when(count(b) < count(a), "fewer_lines").when(count(b) > count(a), "more_lines")
    size = F.when(F.length(b) > F.floor(F.length(a) * F.lit(1.08)), "longer").when((F.length(b) < F.floor(F.length(a) * F.lit(0.92))) & (a != ""), "shorter")
    return F.array_compact(F.array(lines, size))
