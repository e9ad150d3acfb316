"""Typed blocks of plain text and markdown, and the sections they form.

Each line gets its kind by expressions, and what depends on the lines around it (runs of list items, a
paragraph's lines, tables, underlined headings) follows, for plain text, from windows over the lines of a document: no line is handled by Python, and no
state is carried but counts. All those steps are partitioned by the document's row, so lines are shuffled once. The
lists of a window are those of one document; a block's lines are gathered by a group of their own. For markdown it follows from counts in numpy over the
flags of a batch's lines, and a document stays in its own row.

Blocks are rows (row, id, block, type, level, text, left, right, items, cells): type is section_heading (level up to 2), heading, paragraph,
bullet_list, numbered_list, two_column_row or table. row numbers the input's rows, so that repeated ids stay apart.

Defined cases: null, empty and blank texts have no blocks, and a document without blocks no rows. An id may be null or repeat. Extra columns aren't read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from docloom.functions import lines as L
from docloom.functions.structure import strip

# Forms of markdown lines.
HEAD = r"^(#{1,6})\s+(.+)$"
UNDERLINE = r"^(?:-{3,}|\*{3,}|_{3,})$"
MARKED_BULLET = r"^\s*[-*+]\s+(.+)$"
MARKED_NUMBER = r"^\s*\d+\.\s+(.+)$"
IMAGE = r"^!\[([^\]]*)\]\(([^)]+)\)\s*$"
PAGE_MARK = r"^(?:-{20,}|\d{1,4})$"
SEPARATOR = r"^\|?[\s:|-]+\|?$"
#: What a line of markdown can be by itself: blank, page mark, image, heading by hashes, of two bars or more, underline, bullet, number.
FLAGS = [
    lambda x: strip(x) == "",
    lambda x: strip(x).rlike(PAGE_MARK),
    lambda x: strip(x).rlike(IMAGE),
    lambda x: strip(x).rlike(HEAD),
    lambda x: F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit(""))) >= 2,
    lambda x: strip(x).rlike(UNDERLINE),
    lambda x: x.rlike(MARKED_BULLET),
    lambda x: x.rlike(MARKED_NUMBER),
]
#: Two lines that are one, as scans split them: a line of the first, before a line of the second form.
SPLIT_FIRST, SPLIT_SECOND = "SOP", r"(?i)^ID\s*:"
BODY = "Document Body"
#: Words that open a chunk, and the type that each gives it, the first type that fits.
HEADERS = "Purpose|Scope|Procedure|Responsibilities|Definitions|Records|References|Zweck|Ziel|Geltungsbereich|Verantwortung|Vorgehen|Ablauf"
CHUNK_TYPES = {
    "purpose": ["purpose", "objective", "zweck", "ziel"],
    "scope": ["scope", "geltungsbereich"],
    "definitions": ["definition", "begriffe"],
    "responsibilities": ["responsib", "verantwort"],
    "procedure": ["procedure", "process", "vorgehen", "ablauf"],
    "records": ["record", "documentation", "protokoll"],
    "references": ["reference", "referenz"],
}
HEADER_LINE = rf"(?i)^(?:#+\s*|\*+\s*|\d+(?:\.\d+)*[.)]\s*)?(?:{HEADERS})\b"
CHUNK_TITLE = 120


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, at, line) of all lines."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), L.split_text(F.col(text_col)).alias("lines"))
    return rows.select("row", "id", F.posexplode("lines").alias("at", "line"))


def _gathered(lines: DataFrame, value: Column) -> DataFrame:
    """A row for each (row, block): its kind, level and the values of its lines in order."""
    got = lines.groupBy("row", "id", "block").agg(F.min_by("kind", "at").alias("kind"), F.min_by("level", "at").alias("level"), F.array_sort(F.collect_list(F.struct("at", value.alias("v")))).alias("vs"))
    return got.withColumn("vs", F.transform("vs", lambda x: x["v"]))


def _shape(kind: Column, level: Column, vs: Column) -> Column:
    """A block's type, level and content as a struct."""
    joined, first = strip(F.array_join(vs, "\n")), F.get(vs, F.lit(0))
    items = F.filter(vs, lambda x: F.trim(x) != "")
    cells = L.normal_rows(F.transform(F.filter(vs, lambda x: (F.trim(x) != "") & ~F.trim(x).rlike(SEPARATOR)), _row_cells))
    is_list, nothing = kind.isin("bullet", "number"), F.lit(None)
    return F.struct(
        F.when(kind == "heading", F.when(level <= 2, "section_heading").otherwise("heading"))
        .when(kind == "bullet", "bullet_list")
        .when(kind == "number", "numbered_list")
        .when(kind == "pair", "two_column_row")
        .when(kind == "table", "table")
        .otherwise("paragraph")
        .alias("type"),
        F.when(kind == "heading", level).alias("level"),
        F.when(kind.isin("heading", "paragraph", "image"), joined).alias("text"),
        F.when(kind == "pair", L.squeezed(F.substring_index(first, ":", 1))).alias("left"),
        F.when(kind == "pair", L.squeezed(F.substring(first, F.instr(first, ":") + 1, F.length(first)))).alias("right"),
        F.when(is_list, items).alias("items"),
        F.when(kind == "table", cells).otherwise(nothing.cast("array<array<string>>")).alias("cells"),
    )


def _full(b: Column) -> Column:
    """Whether a struct of _shape() has content."""
    kind = b["type"]
    return F.when(kind == "table", F.size(b["cells"]) > 0).when(kind.endswith("_list"), F.size(b["items"]) > 0).when(kind == "two_column_row", F.lit(True)).otherwise(b["text"] != "")


def _shaped(blocks: DataFrame) -> DataFrame:
    """Numbered without gaps, as block rows; blocks without content go."""
    rows = blocks.select("row", "id", "block", _shape(F.col("kind"), F.col("level"), F.col("vs")).alias("b")).filter(_full(F.col("b")))
    order = Window.partitionBy("row").orderBy("block")
    return rows.select("row", "id", F.row_number().over(order).alias("block"), "b.*")


def blocks_of_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of plain text: label and value, headings, runs of bullets and of numbered items, paragraphs of what is left."""
    order = Window.partitionBy("row").orderBy("at")
    lines = _lines(docs, id_col, text_col).withColumn("line", L.squeezed(F.col("line"))).filter("line <> ''")
    upper = lambda c: F.upper(c) == SPLIT_FIRST
    before, after = F.lag("line").over(order), F.lead("line").over(order)
    lines = lines.withColumn("joins", F.coalesce(upper(F.col("line")) & after.rlike(SPLIT_SECOND), F.lit(False))).withColumn("joined", F.coalesce(upper(before) & F.col("line").rlike(SPLIT_SECOND), F.lit(False)))
    whole = F.when(F.col("joined"), F.concat(F.lit(SPLIT_FIRST + " "), F.col("line"))).otherwise(F.col("line"))
    lines = lines.filter(~F.col("joins")).withColumn("line", whole)
    lines = lines.withColumn("kind", L.kind_of(F.col("line"))).withColumn("level", L.level_of(F.col("line")))
    alone = F.col("kind").isin("pair", "heading")
    opens = alone | F.coalesce(F.lag("kind").over(order) != F.col("kind"), F.lit(True))
    lines = lines.withColumn("block", F.sum(opens.cast("int")).over(order))
    value = F.when(F.col("kind") == "bullet", F.regexp_replace("line", L.BULLET, "")).when(F.col("kind") == "number", F.regexp_replace("line", L.NUMBER, "")).otherwise(F.col("line"))
    return _shaped(_gathered(lines, value))


def _inline(c: Column) -> Column:
    """Marks of bold, italics and code off."""
    out = strip(c)
    for mark in (r"\*\*([^*]+)\*\*", r"\*([^*]+)\*", r"`([^`]+)`"):
        out = F.regexp_replace(out, mark, "$1")
    return strip(out)


def _row_cells(line: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(strip(line), r"^\|+|\|+$", ""), r"\|"), _inline)


_RUNS = ArrayType(StructType([StructField("kind", StringType()), StructField("at", ArrayType(IntegerType()))]))


@F.arrow_udf(_RUNS)
def _markdown_runs(flags: pa.Array) -> pa.Array:
    """The kind of each block of a text, and the places of its lines, from FLAGS of the lines."""
    bounds = flags.offsets.to_numpy().astype(np.int64)
    values = flags.values.slice(bounds[0], bounds[-1] - bounds[0]).to_numpy(zero_copy_only=False)
    bounds = bounds - bounds[0]
    blank, mark, image, hashed, bars, line, bullet, number = ((values & (1 << k)) != 0 for k in range(len(FLAGS)))
    of = np.repeat(np.arange(len(flags)), np.diff(bounds))
    first = np.diff(of, prepend=-1) != 0

    def before(flag: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """How many of the lines before this one, from the last start on, have the flag."""
        n = np.cumsum(flag) - flag
        return n - n[np.flatnonzero(starts)[np.cumsum(starts) - 1]]

    under = np.append(line[1:] & ~first[1:], np.zeros(min(1, len(line)), bool))
    # islands of lines that a table may hold, and within each whether a table has begun before the line
    opened = bars | blank
    island = ~opened | first
    begins = bars & ~mark & ~image & ~hashed & ~under
    inside = opened & (before(begins, island) > 0)
    can = ~blank & ~mark & ~image & ~hashed & under & ~inside
    heads = can & (before(can, ~can | first) % 2 == 0)
    used = np.append(np.zeros(min(1, len(heads)), bool), heads[:-1]) & ~first
    kind = np.select([used, inside | begins, blank, mark, image, hashed | heads, bullet, number], [0, 1, 2, 0, 3, 4, 5, 6], 7)
    # of the lines that aren't used up, where a block opens; then blank ones go
    at = np.flatnonzero(kind != 0)
    k, i, d = kind[at], np.cumsum(island)[at], of[at]
    same = (k[1:] == k[:-1]) & ((k[1:] != 1) | (i[1:] == i[:-1])) & (d[1:] == d[:-1])
    opens = np.isin(k, (3, 4)) | ~np.append(np.zeros(min(1, len(k)), bool), same)
    block = np.cumsum(opens)[k != 2]
    at, k, d = at[k != 2], k[k != 2], d[k != 2]
    starts = np.flatnonzero(np.diff(block, prepend=0))
    places = pa.ListArray.from_arrays(pa.array(np.append(starts, len(at)), pa.int32()), pa.array(at - bounds[d], pa.int32()))
    names = pa.array(["used", "table", "blank", "image", "heading", "bullet", "number", "paragraph"]).take(pa.array(k[starts]))
    ends = np.searchsorted(d[starts], np.arange(len(flags) + 1))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([names, places], ["kind", "at"]))


def _flags(line: Column) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), [F.when(f(line), 1 << k).otherwise(0) for k, f in enumerate(FLAGS)])


def blocks_of_markdown(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of markdown: headings by hashes or by a line under them, lists, tables, images as their title, paragraphs.

    Page numbers and page breaks are passed over. A table begins at a line of two bars or more and holds what
    follows of such lines, blank ones between them included. An underlined heading uses up the line under it, so that
    of several such lines every other one can be a heading: where the condition holds on end, it counts at even places.
    A document's blocks are made in its own row, and nothing is shuffled; Python sees only the flags of lines.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), L.split_text(F.col(text_col)).alias("lines"))
    rows = rows.withColumn("runs", _markdown_runs(F.transform("lines", _flags)))

    def value(kind: Column, line: Column) -> Column:
        s = strip(line)
        alt = _inline(F.regexp_extract(s, IMAGE, 1))
        return (
            F.when(kind == "image", F.concat(F.lit("["), F.when(alt == "", "Image").otherwise(alt), F.lit("]")))
            .when(kind == "heading", _inline(F.when(s.rlike(HEAD), F.regexp_extract(s, HEAD, 2)).otherwise(s)))
            .when(kind == "bullet", _inline(F.regexp_extract(line, MARKED_BULLET, 1)))
            .when(kind == "number", _inline(F.regexp_extract(line, MARKED_NUMBER, 1)))
            .when(kind == "table", s)
            .otherwise(_inline(s))
        )

    def read(run: Column) -> Column:
        first = strip(F.get(F.col("lines"), run["at"][0]))
        level = F.when(first.rlike(HEAD), F.least(F.lit(3), F.length(F.regexp_extract(first, HEAD, 1)))).otherwise(F.lit(1)).cast("int")
        vs = F.transform(run["at"], lambda i: value(run["kind"], F.get(F.col("lines"), i)))
        return F.struct(run["kind"].alias("kind"), level.alias("level"), vs.alias("vs"))

    blocks = F.transform(F.transform("runs", read), lambda b: _shape(b["kind"], b["level"], b["vs"]))
    return rows.select("row", "id", F.posexplode(F.filter(blocks, _full)).alias("block", "b")).select("row", "id", (F.col("block") + 1).alias("block"), "b.*")


def block_text() -> Column:
    """The text of a block row: a table's rows with bars between cells, one a line; list items one a line; label: value."""
    rows = F.array_join(F.transform("cells", lambda r: F.array_join(F.filter(r, lambda x: x != ""), " | ")), "\n\n")
    return F.when(F.col("type") == "table", rows).when(F.col("type").endswith("_list"), F.array_join("items", "\n\n")).when(F.col("type") == "two_column_row", F.concat("left", F.lit(": "), "right")).otherwise(F.col("text"))


def flat_text(blocks: DataFrame, pairs: bool = False) -> DataFrame:
    """(row, id, text): the blocks of each document with a blank line between them; pairs of label and value only if asked for."""
    rows = blocks if pairs else blocks.filter("type <> 'two_column_row'")
    got = rows.select("row", "id", "block", block_text().alias("t")).groupBy("row", "id").agg(F.array_sort(F.collect_list(F.struct("block", "t"))).alias("ts"))
    return got.select("row", "id", F.array_join(F.transform("ts", lambda x: x["t"]), "\n\n").alias("text"))


def hierarchy(blocks: DataFrame) -> DataFrame:
    """(row, id, section, section_title, section_level, subsection, subsection_title, block, ...): where each block stands.

    Headings up to level 2 open sections, deeper ones subsections; what comes before any is in a section named
    Document Body, level 1. subsection is 0 before a section's first one. Rows of headings are kept, as a section may have no content.
    """
    order = Window.partitionBy("row").orderBy("block")
    top, sub = F.col("type").isin("section_heading", "heading") & (F.col("level") <= 2), F.col("type").isin("section_heading", "heading") & (F.col("level") > 2)
    rows = blocks.withColumn("opens", top).withColumn("opens_sub", sub).withColumn("nth", F.sum(F.col("opens").cast("int")).over(order))
    section = Window.partitionBy("row", "nth").orderBy("block")
    rows = rows.withColumn("subsection", F.sum(F.col("opens_sub").cast("int")).over(section))
    rows = rows.withColumn("section_title", F.when(F.col("nth") == 0, BODY).otherwise(F.first("text").over(section))).withColumn("section_level", F.when(F.col("nth") == 0, 1).otherwise(F.first("level").over(section)).cast("int"))
    inner = Window.partitionBy("row", "nth", "subsection").orderBy("block")
    rows = rows.withColumn("subsection_title", F.when(F.col("subsection") > 0, F.first("text").over(inner)))
    # numbered from 1 whether or not there is a body section
    body = F.min("nth").over(Window.partitionBy("row"))
    rows = rows.withColumn("section", F.col("nth") + 1 - body)
    return rows.select("row", "id", "section", "section_title", "section_level", "subsection", "subsection_title", "block", (F.col("opens") | F.col("opens_sub")).alias("is_heading"), "type", "level", "text", "left", "right", "items", "cells")


def nested(placed: DataFrame) -> DataFrame:
    """(row, id, sections): one nested value for each document of hierarchy()'s rows; to_json() makes it the document's JSON."""
    node = F.when(~F.col("is_heading"), F.struct("block", "type", "text", F.col("left").alias("label"), F.col("right").alias("value"), "items", F.col("cells").alias("rows")))
    parts = placed.groupBy("row", "id", "section", "section_title", "section_level", "subsection", "subsection_title").agg(F.array_sort(F.collect_list(node)).alias("content"), F.min("block").alias("first"))
    plain = lambda c: F.transform(c, lambda x: x.dropFields("block"))
    subs = F.array_sort(F.collect_list(F.when(F.col("subsection") > 0, F.struct("first", F.col("subsection_title").alias("title"), plain(F.col("content")).alias("content")))))
    own = F.flatten(F.collect_list(F.when(F.col("subsection") == 0, plain(F.col("content")))))
    sections = parts.groupBy("row", "id", "section", "section_title", "section_level").agg(own.alias("content"), subs.alias("subs"))
    one = F.struct("section", F.col("section_title").alias("title"), F.col("section_level").alias("level"), "content", F.transform("subs", lambda x: x.dropFields("first")).alias("subsections"))
    return sections.groupBy("row", "id").agg(F.array_sort(F.collect_list(one)).alias("sections"))


def _quoted(c: Column) -> Column:
    """A text as a JSON string."""
    whole = F.to_json(F.struct(c.alias("t")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def _node(kind: str, content: Column, attrs: Column | None = None) -> Column:
    head = F.lit(f'{{"type":"{kind}"') if attrs is None else F.concat(F.lit(f'{{"type":"{kind}","attrs":'), attrs)
    return F.concat(head, F.lit(',"content":['), content, F.lit("]}"))


def _leaf(c: Column, bold: bool = False) -> Column:
    """A text node; none for an empty text."""
    marks = ',"marks":[{"type":"bold"}]' if bold else ""
    return F.when(c != "", F.concat(F.lit('{"type":"text","text":'), _quoted(c), F.lit(marks + "}"))).otherwise("")


def _paragraph(c: Column) -> Column:
    """Lines with hard breaks between them."""
    return _node("paragraph", F.array_join(F.transform(F.split(c, "\n"), lambda x: _leaf(x)), ',{"type":"hardBreak"},'))


def block_node() -> Column:
    """The JSON of a block row's node."""
    items = F.array_join(F.transform("items", lambda x: _node("listItem", _paragraph(x))), ",")
    headers = L.header_rows(F.col("cells"))
    row = lambda r, head: _node("tableRow", F.array_join(F.transform(r, lambda c: F.when(head, _node("tableHeader", _paragraph(c))).otherwise(_node("tableCell", _paragraph(c)))), ","))
    table = F.transform(F.array(headers), lambda n: _node("table", F.array_join(F.transform("cells", lambda r, i: row(r, i < n)), ",")))[0]
    level = F.concat(F.lit('{"level":'), F.greatest(F.lit(1), F.least(F.lit(3), F.col("level"))).cast("string"), F.lit("}"))
    return (
        F.when(F.col("type").endswith("heading"), _node("heading", _leaf(F.col("text")), level))
        .when(F.col("type") == "bullet_list", _node("bulletList", items))
        .when(F.col("type") == "numbered_list", _node("orderedList", items))
        .when(F.col("type") == "table", table)
        .when(F.col("type") == "two_column_row", _node("paragraph", F.concat_ws(",", F.nullif(_leaf(F.concat("left", F.lit(": ")), True), F.lit("")), F.nullif(_leaf(F.col("right")), F.lit("")))))
        .otherwise(_paragraph(F.col("text")))
    )


def trees(blocks: DataFrame) -> DataFrame:
    """(row, id, tree): each document's blocks as one tree in JSON, made from the blocks' own nodes without recursion."""
    got = blocks.select("row", "id", "block", block_node().alias("n")).groupBy("row", "id").agg(F.array_sort(F.collect_list(F.struct("block", "n"))).alias("ns"))
    return got.select("row", "id", _node("doc", F.array_join(F.transform("ns", lambda x: x["n"]), ",")).alias("tree"))


def header_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, chunk, title, section_type, chunk_type, start_line, end_line, content): a chunk begins at each line that a section's word opens.

    What comes before is titled Intro; blank chunks go. A title has CHUNK_TITLE characters at most, the content is whole.
    """
    order = Window.partitionBy("row").orderBy("at")
    lines = _lines(docs, id_col, text_col).withColumn("head", strip(F.col("line")).rlike(HEADER_LINE))
    lines = lines.withColumn("nth", F.sum(F.col("head").cast("int")).over(order))
    got = lines.groupBy("row", "id", "nth").agg(F.min("at").alias("start_line"), F.max("at").alias("end_line"), F.min_by("line", "at").alias("first"), F.array_sort(F.collect_list(F.struct("at", "line"))).alias("ls"))
    content = strip(F.array_join(F.transform("ls", lambda x: x["line"]), "\n"))
    title = F.when(F.col("nth") == 0, "Intro").otherwise(F.substring(strip(F.col("first")), 1, CHUNK_TITLE))
    kind = F.lit(None).cast("string")
    for label, words in reversed(CHUNK_TYPES.items()):
        kind = F.when(F.lower("title").rlike("|".join(words)), label).otherwise(kind)
    out = got.select("row", "id", "nth", title.alias("title"), "start_line", "end_line", content.alias("content")).filter("content <> ''")
    out = out.withColumn("chunk", F.row_number().over(Window.partitionBy("row").orderBy("nth")))
    return out.select("row", "id", "chunk", "title", F.coalesce(kind, F.lit("general")).alias("section_type"), F.when(F.col("title") == "Intro", "intro").otherwise("header").alias("chunk_type"), "start_line", "end_line", "content")
