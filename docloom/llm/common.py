"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.session import forget, scratch, shared_dir, written  # noqa: F401  the operators take them from here

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A word of the quality, mixing and similarity operators: what stands between ASCII white space.
BLANK_WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; other scripts stay as they are."""
    return F.translate(text, UPPER, UPPER.lower())


def blank_words(text: Column) -> Column:
    """Words between ASCII white space; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def count_blank_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(BLANK_WORD)), F.lit(0)).cast("long")


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns whose names an operator is about to add, whatever their case."""
    taken = {n.lower() for n in names}
    return df.select(*[c for c in quoted(df) if c[1:-1].replace("``", "`").lower() not in taken])


def quoted(df: DataFrame) -> list[str]:
    return ["`" + c.replace("`", "``") + "`" for c in df.columns]
