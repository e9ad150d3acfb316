"""Metadata of documents by ladders: the first rung that has a value counts, and the rung is told.

Values come from label-and-value lines, from tables of changes, from the lines around the document's own id, and from the text. Lines are read in
the document's own row; the blocks and rows of tables, of texts that can hold one, are rows. What is best is a maximum of a struct, and nothing is carried from line to line.

Defined cases: null and empty texts have a row with null values. Ids may be null or repeat (row tells them apart). Extra columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import lines as L
from docloom.functions.text import normalize_date
from docloom.operators import blocks as B
from docloom.operators.tables import canonical_version, version_key

# Forms of ids and versions, words of table headers, and the labels of each field.
ID_TOKEN = r"(?i)\b(?:SOP|DOC|WI|QM|POL)[-_/][A-Z0-9]+(?:[-_/][A-Z0-9]+)*\b"
ID_STRICT = r"(?i)^SOP-[A-Z]{2,6}-\d{2,5}$"
HISTORY = "änd|chang|hist"
VERSION_WORDS = "revision|version|ausgabe|stand|dokument"
DATE_WORDS = "datum|date|effective|freigabe|approved"
VERSION = r"(?i)^(?:version|revision|rev|v)?\.?\s*(\d+(?:\.\d+)*)$"
NEAR = r"(?i)(?:Version|Revision|Rev\.?|Dokument-Version|Stand|Ausgabe)\s*[:#]?\s*(V?\d+(?:\.\d+)?)\b"
BEFORE, AFTER = 4, 5
LABELS = {
    "title": ["title", "titel", "document title"],
    "version": ["version", "revision", "rev", "ausgabe", "stand"],
    "effective_date": ["effective date", "effective", "valid from", "gültig ab", "date", "datum"],
    "status": ["status", "document status"],
    "department": ["department", "abteilung", "bereich"],
    "owner": ["owner", "document owner", "verantwortlich"],
}
TITLE_LINES = 40


def best_id(text: Column) -> Column:
    """The best of a text's id tokens, in upper case: of the strict form, with digits, with more parts, earlier, longer; null without one."""
    found = F.regexp_extract_all(text, F.lit(ID_TOKEN), F.lit(0))
    rank = lambda t, i: F.struct(t.rlike(ID_STRICT).alias("strict"), t.rlike(r"\d").alias("digit"), F.regexp_count(t, F.lit("[-/]")).alias("parts"), (-i).alias("early"), F.length(t).alias("size"), F.upper(t).alias("id"))
    return F.array_max(F.transform(found, rank))["id"]


def version_of(cell: Column) -> Column:
    """The canonical version that a cell is, or null."""
    number = F.regexp_extract(F.trim(cell), VERSION, 1)
    plain = F.trim(cell).rlike(r"^\d")
    rev = F.trim(cell).rlike(r"(?i)^rev")
    return F.when(number != "", F.when(plain, number).when(rev, canonical_version(F.concat(F.lit("rev "), number))).otherwise(F.concat(F.lit("V"), number)))


def version_from_tables(blocks: DataFrame) -> DataFrame:
    """(row, version): of a table of changes the row with the latest date, without dates the greatest version; else the greatest of other tables' version columns.

    A table of changes is one whose header speaks of changes or history; without a version column its cells are tried.
    """
    tables = blocks.filter("type = 'table' and size(cells) > 1").select("row", "block", F.transform(F.col("cells")[0], lambda h: F.lower(h)).alias("head"), F.slice("cells", 2, F.size("cells")).alias("cells"))
    places = lambda words: F.filter(F.transform("head", lambda h, i: F.when(h.rlike(words), i)), lambda i: i.isNotNull())
    short = r"^\s*(?:rev|ver)\.?\s*$|\b(?:rev|ver)\b.*(?:nr|no|num|#)|(?:nr|no|num|#).*\b(?:rev|ver)\b"
    tables = tables.withColumn("history", F.exists("head", lambda h: h.rlike(HISTORY))).withColumn("versions", places(f"{VERSION_WORDS}|{short}")).withColumn("dates", places(DATE_WORDS))
    rows = tables.filter("history or size(versions) > 0").select("row", "block", "history", "versions", "dates", F.posexplode("cells").alias("at", "cell"))
    pick = lambda which: F.transform(which, lambda i: F.get(F.col("cell"), i))
    full = F.filter(pick("versions"), lambda c: F.coalesce(c, F.lit("")) != "")
    tried = F.when(F.col("history") & (F.size("versions") > 0), F.slice(full, 1, 1)).when(F.col("history"), F.col("cell")).otherwise(full)
    found = F.filter(F.transform(tried, lambda c: version_of(c)), lambda v: v.isNotNull())
    dated = F.get(F.filter(F.transform(pick("dates"), lambda c: normalize_date(c)), lambda d: d.isNotNull()), F.lit(0))
    date = F.when(F.size("versions") > 0, dated)
    rows = rows.select("row", "block", "at", "history", date.alias("date"), F.posexplode(found).alias("k", "version"))
    has_date = F.col("history") & F.col("date").isNotNull()
    key = version_key(F.col("version"))
    first = [(-F.col(c)).alias(c) for c in ("block", "at", "k")]  # of equals the first
    rank = F.struct(F.col("history").cast("int").alias("history"), has_date.cast("int").alias("dated"), F.when(has_date, F.col("date")).alias("date"), F.when(~has_date, key).alias("key"), *first)
    return rows.groupBy("row").agg(F.max_by("version", rank).alias("version"))


def around(docs: DataFrame, needle: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", before: int = BEFORE, after: int = AFTER) -> DataFrame:
    """(row, id, found): group 1 of the pattern in the lines around the first line that holds the needle (a column) and has a match."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(needle).alias("needle"), L.split_text(F.col(text_col)).alias("lines"))
    return rows.filter("needle <> ''").select("row", "id", _around(F.col("lines"), F.col("needle"), pattern, before, after).alias("found")).filter("found is not null")


def _around(lines: Column, needle: Column, pattern: str, before: int, after: int) -> Column:
    """The same in a row: only lines that hold the needle are looked around; null without a match."""
    places = F.filter(F.transform(lines, lambda x, i: F.when(x.contains(needle), i + 1)), lambda i: i.isNotNull())
    near = lambda i: F.array_join(F.slice(lines, F.greatest(F.lit(1), i - before), F.least(i - 1, F.lit(before)) + 1 + after), "\n")
    return F.get(F.filter(F.transform(places, lambda i: F.regexp_extract(near(i), pattern, 1)), lambda x: x != ""), F.lit(0))


def metadata(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, number, title, version, version_from, effective_date, status, department, owner), a row for each document.

    version: a labelled line, a table of changes, the lines around the number, in that order. title: a labelled line, else the first line of up to
    120 characters among the first 40 that is a heading; the number and separators before it are off.
    """
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # only a text with two bars in a line can hold a table
    barred = source.filter(F.col("text").rlike(r"\|[^\n]*\|")).select(F.col("row").alias("of"), "text")
    blocks = B.blocks_of_markdown(barred, "of", "text").drop("row").withColumnRenamed("id", "row")
    rows = source.select("row", "id", best_id(F.col("text")).alias("number"), L.split_text(F.col("text")).alias("lines"), L.split_text(F.upper("text")).alias("upper"))
    # every value is found in the document's own row: lines are neither rows nor shuffled
    squeezed = F.filter(F.transform(F.filter("lines", lambda x: x.contains(":")), lambda x: L.squeezed(x)), L.is_pair)
    pairs = F.transform(squeezed, lambda x, i: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("label"), i.alias("at"), F.trim(F.regexp_extract(x, r"^[^:]*:\s*(.+)$", 1)).alias("value")))
    head = F.filter(F.transform(F.slice("lines", 1, TITLE_LINES), lambda x: L.squeezed(x)), lambda x: (x != "") & (F.length(x) <= 120) & L.is_heading(x) & ~L.is_pair(x))
    near = F.when(F.col("number") != "", _around(F.col("upper"), F.col("number"), NEAR, BEFORE, AFTER))
    rows = rows.select("row", "id", "number", pairs.alias("pairs"), F.get(head, F.lit(0)).alias("head"), near.alias("near"))
    rows = rows.select("row", "id", "number", "head", "near", *[_labelled(names).alias(f"labelled_{name}") for name, names in LABELS.items()])
    rows = rows.join(version_from_tables(blocks).withColumnRenamed("version", "tabled"), "row", "left")
    own = version_of(F.col("labelled_version"))
    beside = version_of(F.col("near"))
    clean = lambda c: F.nullif(F.trim(F.regexp_replace(c, rf"^(?:{ID_TOKEN}|\d+(?:\.\d+)*[.)]?|[\s:|–-]+)+", "")), F.lit(""))
    return rows.select(
        "row",
        "id",
        "number",
        clean(F.coalesce("labelled_title", "head")).alias("title"),
        F.coalesce(own, F.col("tabled"), beside).alias("version"),
        F.when(own.isNotNull(), "label").when(F.col("tabled").isNotNull(), "table").when(beside.isNotNull(), "near number").alias("version_from"),
        normalize_date(F.col("labelled_effective_date")).alias("effective_date"),
        F.lower("labelled_status").alias("status"),
        F.col("labelled_department").alias("department"),
        F.col("labelled_owner").alias("owner"),
    )


def _labelled(names: list[str]) -> Column:
    """The value of the label that is the earliest among its names, the first such line; null without one."""
    found = F.filter("pairs", lambda p: p["label"].isin(names))
    place = lambda p: F.array_position(F.array(*map(F.lit, names)), p["label"])
    return F.array_min(F.transform(found, lambda p: F.struct(place(p).alias("rung"), p["at"].alias("at"), p["value"].alias("value"))))["value"]
