"""What a line of a document is: label and value, heading, bullet, numbered item; cells of a table row."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# The forms of lines, and the words that make a short line or a numbered one a heading.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
CONTROLS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
ID_LINE = r"(?i)^(?:SOP\s*ID|Document\s*ID|Dokumenten?\s*ID)\s*:\s*\S+"
PAIR = r"^[A-ZÄÖÜ][A-Za-zÄÖÜäöüß\s/&()\-]{1,40}:\s+\S+"
NUMBERED_TITLE = r"^\d+(?:\.\d+)*\.\s+(.+)$"
SECTION_WORDS = ["PURPOSE", "SCOPE", "RESPONSIBILITIES", "PROCEDURE", "REFERENCES", "DEFINITIONS", "APPROVAL", "HISTORY", "ZWECK", "GELTUNG", "VERFAHREN", "DOKUMENTATION", "ANHANG"]
SHORT_WORDS = ["PURPOSE", "SCOPE", "RESPONSIBILITIES", "PROCEDURE", "REFERENCES", "HISTORY", "APPROVAL"]
BULLET = r"^[-*•]\s+(?=.)"
NUMBER = r"^\d+[).]\s+(?=.)"
CELL_BREAK = r"\s{2,}|\t"
HEADER_LABEL = r"(?i)^(?:no\.?|#|item|step|phase|date|version|revision|status|title|name|role|description|requirement|reference|id|sop|action|owner|department|remarks?|comments?)\b"


def squeezed(c: Column) -> Column:
    """Runs of white space to one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def split_text(c: Column) -> Column:
    """The lines of a text; null has one empty line. Control characters are gone after the split."""
    return F.transform(F.split(F.coalesce(c, F.lit("")), LINE_BREAK), lambda x: F.regexp_replace(x, CONTROLS, ""))


def words_in(c: Column) -> Column:
    return F.when(F.trim(c) == "", 0).otherwise(F.size(F.split(F.trim(c), r"(?U)\s+")))


def upper_case(c: Column) -> Column:
    return (F.upper(c) == c) & (F.lower(c) != c)


def _holds(c: Column, words: list[str]) -> Column:
    return reduce(or_, [F.upper(c).contains(w) for w in words])


def is_pair(line: Column) -> Column:
    """A label of 2 to 41 characters, a colon, and a value; or an id line."""
    return line.rlike(ID_LINE) | line.rlike(PAIR)


def is_section_number(line: Column) -> Column:
    """Like "1. Purpose": up to 72 characters and 7 words of which one names a section, or up to 5 in upper case."""
    title = F.trim(F.regexp_extract(line, NUMBERED_TITLE, 1))
    return (title != "") & (F.length(title) <= 72) & (words_in(title) <= 7) & (_holds(title, SECTION_WORDS) | (upper_case(title) & (words_in(title) <= 5)))


def is_heading(line: Column) -> Column:
    """A numbered heading, or a line of up to 100 characters that is numbered and capitalised, of fewer than 6 words in upper case, or of fewer than 4 with a section's name."""
    several = line.rlike(r"^\d+\.\d+") & line.rlike(r"^\d+(?:\.\d+)+[).]?\s+\S+")
    loose = line.rlike(r"^(\d+\.)+\s+[A-ZÄÖÜ]") | (upper_case(line) & (words_in(line) < 6)) | (_holds(line, SHORT_WORDS) & (words_in(line) < 4))
    likely = (F.length(line) <= 100) & F.when(line.rlike(r"^\d+[).]\s+"), is_section_number(line)).otherwise(loose)
    return several | (~line.rlike(r"^\d+\.\d+") & is_section_number(line)) | likely


def is_bullet(line: Column) -> Column:
    return line.rlike(BULLET)


def is_item(line: Column) -> Column:
    return line.rlike(NUMBER) & ~is_section_number(line)


def level_of(line: Column) -> Column:
    """Depth of the number and one, 1 to 3; without a number 2."""
    number = F.regexp_extract(line, r"^(\d+(?:\.\d+)*)", 1)
    return F.when(number == "", 2).otherwise(F.least(F.lit(3), F.size(F.split(number, r"\.")) + 1)).cast("int")


def kind_of(line: Column) -> Column:
    """pair, heading, bullet, number or paragraph: the first that fits."""
    return F.when(is_pair(line), "pair").when(is_heading(line), "heading").when(is_bullet(line), "bullet").when(is_item(line), "number").otherwise("paragraph")


def normal_rows(rows: Column) -> Column:
    """Cells squeezed, rows of blank cells gone, the others padded to the greatest number of cells; a null cell is a blank one."""
    clean = F.filter(F.transform(rows, lambda r: F.transform(r, lambda c: squeezed(F.coalesce(c, F.lit(""))))), lambda r: F.exists(r, lambda c: c != ""))
    # the greatest number of cells is worked out once, not for each row
    pad = lambda t, most: F.transform(t, lambda r: F.concat(r, F.array_repeat(F.lit(""), most - F.size(r))))
    return F.transform(F.array(clean), lambda t: F.transform(F.array(F.coalesce(F.array_max(F.transform(t, F.size)), F.lit(0))), lambda most: pad(t, most))[0])[0]


def header_rows(rows: Column) -> Column:
    """How many of a table's first rows, at most 2, are its header: short labels above longer rows."""

    def stats(row: Column) -> Column:
        full = F.filter(row, lambda c: c != "")
        total = F.aggregate(full, F.lit(0), lambda a, c: a + F.length(c))
        labels = F.size(F.filter(full, lambda c: c.rlike(HEADER_LABEL)))
        return F.struct(F.when(F.size(full) > 0, total / F.size(full)).otherwise(F.lit(0.0)).alias("mean"), labels.alias("labels"), F.size(row).alias("n"))

    def decide(s: Column) -> Column:
        a, b, c = (F.get(s, F.lit(i)) for i in range(3))
        third = lambda x: x["labels"] >= F.greatest(F.lit(1), F.floor(x["n"] / 3))
        two = (F.size(s) >= 3) & (a["mean"] < 42) & (b["mean"] < 42) & (c["mean"] > F.greatest(a["mean"], b["mean"]) * 1.2)
        one = (a["labels"] >= F.greatest(F.lit(2), F.floor(a["n"] / 2))) | ((a["mean"] < 40) & (b["mean"] > a["mean"] * 1.3))
        return F.when(F.size(s) < 2, 0).when(two & third(a) & third(b), 2).when(two, 1).when(one, 1).otherwise(0).cast("int")

    return F.transform(F.array(F.transform(F.slice(rows, 1, 3), stats)), decide)[0]


def _cells(line: Column) -> Column:
    return F.filter(F.transform(F.split(F.trim(line), CELL_BREAK), lambda x: F.trim(x)), lambda x: x != "")


def looks_like_table(lines: Column) -> Column:
    """Whether of the first 40 lines with text two or more have columns, and 60 % of those the same number of them."""
    full = F.filter(lines, lambda x: F.trim(x) != "")
    sizes = F.filter(F.transform(F.slice(full, 1, 40), lambda x: F.size(_cells(x))), lambda n: n >= 2)
    most = lambda v: F.array_max(F.transform(v, lambda n: F.size(F.filter(v, lambda m: m == n))))
    return F.transform(F.array(sizes), lambda v: (F.size(v) >= 2) & (F.coalesce(most(v), F.lit(0)) >= F.greatest(F.lit(2.0), F.size(v) * 0.6)))[0]


def table_of(lines: Column) -> Column:
    """The rows of a plain-text table: lines of two or more columns, padded."""
    return normal_rows(F.filter(F.transform(lines, _cells), lambda r: F.size(r) >= 2))
