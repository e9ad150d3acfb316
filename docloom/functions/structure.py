"""Sections of plain text: headings by pattern, title labels, ends, duplicates; all in the document's own row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import normalize_key, normalize_space

#: Labels of section titles by words that name them.
TITLES = {
    "purpose": ["purpose", "objective", "aim"],
    "scope": ["scope", "applicability"],
    "responsibilities": ["responsibilities", "roles and responsibilities"],
    "procedure": ["procedure", "process", "workflow"],
    "records": ["records", "documentation"],
    "review": ["review", "periodic review"],
    "approval": ["approval", "signatures"],
}
# Forms of a heading line, with the confidence of each.
NUMBERED = r"^(\d+(?:\.\d+)*)[.)]?\s+([A-Z][A-Za-z0-9 /&()_\-,]{2,130})$"
HASHED = r"^#{1,6}\s+(.{2,130})$"
CAPITALS = r"^([A-Z][A-Z0-9 /&()_\-]{3,130})$"
COLON = r"^([A-Z][A-Za-z0-9 /&()_\-]{2,90}):$"
LINE_BREAK = r"\r\n|\n|\r"
HEADING_LENGTH = 160
#: White space of any kind, as (?U)\s has it.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
HEADING = "struct<line:int,title:string,level:int,label:string,confidence:double>"


def strip(c: Column) -> Column:
    """Without white space of any kind at its ends."""
    return F.btrim(c, F.lit(SPACES))


def _best(title: Column, labels: dict[str, list[str]]) -> Column:
    """The best (score, -order, label) of a cleaned title."""

    def score(words: Column, alias: str) -> Column:
        mine = F.array(*[F.lit(w) for w in dict.fromkeys(alias.split())])
        overlap = F.size(F.array_intersect(words, mine)) / F.size(F.array_union(words, mine))
        return F.when(title == alias, 0.98).when(title.contains(alias), 0.86).otherwise(overlap)

    def best(words: Column) -> Column:
        rows = [F.struct(F.greatest(*[score(words, a) for a in aliases], F.lit(0.0)).alias("score"), F.lit(-i).alias("ord"), F.lit(label).alias("label")) for i, (label, aliases) in enumerate(labels.items())]
        return F.array_max(F.array(*rows))

    return F.transform(F.array(F.array_distinct(F.regexp_extract_all(title, F.lit("[a-z0-9]+"), F.lit(0)))), best)[0]


def classify_title(title: Column, labels: dict[str, list[str]] = TITLES) -> Column:
    """(label, confidence): an alias itself .98, within the title .86, else shared words; under .25 general at .35."""
    cleaned = F.regexp_replace(F.regexp_replace(F.lower(normalize_space(title)), r"^\d+(?:\.\d+)*[.)]?\s*", ""), r"^[ :\-]+|[ :\-]+$", "")
    pick = lambda b: F.when(b["score"] < 0.25, F.struct(F.lit("general").alias("label"), F.lit(0.35).alias("confidence"))).otherwise(
        F.struct(b["label"].alias("label"), F.round(b["score"], 3).alias("confidence"))
    )
    return F.transform(F.transform(F.array(cleaned), lambda t: _best(t, labels)), pick)[0]


def heading_of(line: Column, at: Column, labels: dict[str, list[str]] = TITLES) -> Column:
    """The heading that a line is, or null: up to 160 characters, no sentence of over six words, and numbered, upper case or of a known label.

    The stripped line, its form and its title are worked out once each, the cheapest test first: a line of prose ends at its length or its first letters.
    """
    let = lambda value, body: F.transform(F.array(value), body)[0]

    def formed(s: Column) -> Column:
        form = F.when(s.rlike(NUMBERED), 1).when(s.rlike(HASHED), 2).when(s.rlike(CAPITALS), 3).when(s.rlike(COLON), 4)
        return F.when(F.length(s) <= HEADING_LENGTH, let(form, lambda f: F.when(f.isNotNull() & ~(s.endswith(".") & (F.size(F.split(s, r"\s+")) > 6)), titled(s, f))))

    def titled(s: Column, form: Column) -> Column:
        raw = F.when(form == 1, F.regexp_extract(s, NUMBERED, 2)).when(form == 2, F.regexp_extract(s, HASHED, 1)).when(form == 3, s).otherwise(F.regexp_extract(s, COLON, 1))
        return let(F.regexp_replace(raw, r"^[ :.\-]+|[ :.\-]+$", ""), lambda title: F.when(title != "", let(classify_title(title, labels), lambda c: made(s, form, title, c))))

    def made(s: Column, form: Column, title: Column, c: Column) -> Column:
        numbered = form == 1
        depth = F.when(numbered, F.size(F.split(F.regexp_extract(s, NUMBERED, 1), r"\."))).otherwise(1)
        formal = s.rlike(r"^\d") | ((F.upper(s) == s) & (F.lower(s) != s))
        sure = F.greatest(F.when(numbered, 0.88).otherwise(0.74), c["confidence"])
        return F.when((c["label"] != "general") | formal, F.struct(at.cast("int").alias("line"), title.alias("title"), depth.cast("int").alias("level"), c["label"].alias("label"), sure.alias("confidence")))

    return let(strip(line), formed)


def headings(text: Column, labels: dict[str, list[str]] = TITLES) -> Column:
    """A text's headings in order, less those on the line after a kept equal one.

    Equal headings on neighbouring lines are a run, of which every other one is kept: runs begin where a heading isn't equal to that on
    the line before, so one pass finds them and none copies the list for each heading.
    """
    found = F.array_compact(F.transform(F.split(text, LINE_BREAK), lambda line, i: heading_of(line, i, labels)))

    def runs(rows: Column) -> Column:
        # (heading, key, line before, key before), the last two null for the first
        keyed = F.transform(rows, lambda x: F.struct(x.alias("h"), normalize_key(x["title"]).alias("key")))
        before = F.concat(F.array(F.lit(None).cast(f"struct<h:{HEADING},key:string>")), F.slice(keyed, 1, F.greatest(F.size(keyed) - 1, F.lit(0))))
        begins = F.filter(
            F.transform(F.arrays_zip(keyed.alias("now"), before.alias("last")), lambda z, i: F.when((z["now"]["key"] == z["last"]["key"]) & (z["now"]["h"]["line"] - z["last"]["h"]["line"] <= 1), None).otherwise(i)), lambda i: i.isNotNull()
        )
        ends = F.concat(F.slice(begins, 2, F.size(begins)), F.array(F.size(rows)))
        return F.flatten(F.zip_with(begins, ends, lambda a, e: F.filter(F.slice(rows, a + 1, e - a), lambda x, k: k % 2 == 0)))

    return F.transform(F.array(found), lambda rows: F.when(F.size(rows) > 1, runs(rows)).otherwise(rows))[0]


def sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", labels: dict[str, list[str]] = TITLES) -> DataFrame:
    """(id, title, label, level, start_line, end_line, confidence, content), one row a section; a section ends before the next heading.

    A text without headings is one section named Document, general, at .40.
    """
    rows = docs.select(F.col(id_col), F.split(F.coalesce(F.col(text_col), F.lit("")), LINE_BREAK).alias("lines"), headings(F.coalesce(F.col(text_col), F.lit("")), labels).alias("h"))
    whole = F.array(F.struct(F.lit(0).alias("line"), F.lit("Document").alias("title"), F.lit(1).alias("level"), F.lit("general").alias("label"), F.lit(0.40).alias("confidence"))).cast(f"array<{HEADING}>")
    rows = rows.withColumn("h", F.when(F.size("h") > 0, F.col("h")).otherwise(whole))
    ends = F.concat(F.transform(F.slice("h", 2, F.size("h")), lambda x: x["line"] - 1), F.array(F.size("lines") - 1))
    placed = F.zip_with("h", ends, lambda x, e: F.struct(x.alias("h"), e.alias("end_line")))
    out = rows.select(id_col, "lines", F.explode_outer(placed).alias("s"))
    start, end = F.col("s.h.line"), F.col("s.end_line")
    content = strip(F.array_join(F.slice("lines", start + 1, end - start + 1), "\n"))
    return out.select(id_col, "s.h.title", "s.h.label", "s.h.level", start.alias("start_line"), end.alias("end_line"), "s.h.confidence", content.alias("content"))
