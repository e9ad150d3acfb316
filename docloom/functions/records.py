"""Record texts, canonical forms and filters of controlled-document records, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"


def labelled_text(fields: dict[str, Column], drop_blank: bool = False) -> Column:
    """``label: value`` lines; null values are empty. drop_blank leaves out lines without a value, else labels stay."""
    value = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    lines = [F.struct(value(c).alias("v"), F.concat(F.lit(f"{k}: "), value(c)).alias("line")) for k, c in fields.items()]
    kept = F.filter(F.array(*lines), lambda x: (F.trim(x["v"]) != "") | F.lit(not drop_blank))
    return F.trim(F.array_join(F.transform(kept, lambda x: x["line"]), "\n"))


def first_of(*columns: Column) -> Column:
    """The first value that is neither null nor blank."""
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in columns])


def canonical(c: Column, rules: list[tuple[str, str]], default: str = "") -> Column:
    """The name of the first pattern found, in any case; rules in order."""
    out = F.lit(default)
    for pattern, name in reversed(rules):
        out = F.when(F.lower(F.trim(c)).rlike(pattern), F.lit(name)).otherwise(out)
    return out


def strip_controls(c: Column) -> Column:
    return F.regexp_replace(c, CONTROL, "")


def strip_markdown(c: Column) -> Column:
    """Heading marks, emphasis and byte order marks off; runs of blanks to one."""
    out = F.regexp_replace(F.replace(c, F.lit("﻿"), F.lit("")), r"(?m)^[ \t]*#{1,6}[ \t]+", "")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[*_`]{1,3}", ""), r"[ \t]+", " "))


def split_lines(c: Column) -> Column:
    """Lines without blanks at their ends; a last line break makes no line."""
    return F.transform(F.split(F.regexp_replace(c, r"\r\n?", "\n").try_cast("string"), "\n"), lambda x: F.rtrim(x))


def first_match(c: Column, patterns: list[str], cut: int = 200) -> Column:
    """Group 1 of the first pattern that matches, blanks normalised, cut; null without one."""
    found = [F.nullif(F.trim(F.regexp_replace(F.regexp_extract(c, p, 1), r"\s+", " ")), F.lit("")) for p in patterns]
    return F.substring(F.coalesce(*found), 1, cut)


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def safe_round(c: Column, digits: int = 3) -> Column:
    """Rounded; null, NaN and infinite values are 0."""
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return F.when(bad, 0.0).otherwise(F.round(c, digits))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def uuid_or_null(c: Column) -> Column:
    """Lower case with dashes; braces, prefixes and missing dashes are accepted, other strings give null."""
    digits = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"^urn:uuid:|[{}]", ""), "-", "")
    dashed = F.concat_ws("-", *[F.substring(digits, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return F.when(digits.rlike("^[0-9a-f]{32}$"), dashed)


def any_contains(term: str, *columns: Column) -> Column:
    """A blank term is in everything."""
    if not term.strip():
        return F.lit(True)
    return reduce(lambda a, b: a | b, [F.coalesce(F.lower(c).contains(term.lower()), F.lit(False)) for c in columns])


def payload_filter(exact: dict[str, tuple[Column, object]], ids: tuple[Column, list | None] | None = None) -> Column:
    """AND of equalities whose value is given, and an allow-list: none is no restriction, an empty one matches nothing."""
    out = F.lit(True)
    for c, value in exact.values():
        if value is not None:
            out = out & (c == F.lit(value))
    if ids and ids[1] is not None:
        out = out & (ids[0].isin(ids[1]) if ids[1] else F.lit(False))
    return out


def id_rank(token: Column, position: Column) -> Column:
    """Sort key of id candidates: strict form, holds a digit, more separators, earlier, longer."""
    strict = token.rlike(r"^[A-Z]{2,5}-[A-Z]{2,6}-\d{2,5}$").cast("int")
    return F.struct(strict.alias("strict"), token.rlike(r"\d").cast("int").alias("digit"), F.regexp_count(token, F.lit("[-_/]")).alias("parts"), (-position).alias("early"), F.length(token).alias("size"))
