"""Queries of document structure: blocks of lines and markdown, sections, chunks by header words, tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import lines as L
from docloom.functions import tree as J
from docloom.operators import blocks as B
from docloom.operators import metadata as M
from docloom.plans.registry import query
from docloom.session import table


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, each under a heading, a pair and a list made of its columns, so that all kinds of blocks occur."""
    docs = table(spark, sf_dir, "documents")
    head = F.concat(F.lit("1. Purpose of "), F.col("lang"), F.lit("\nSource: "), F.col("source"), F.lit("\n- id "), F.col("doc_id"), F.lit("\n-  size "), F.col("n_chars"), F.lit("\n1) read\n2) keep\n1.1 "), F.col("source"), F.lit("\n"))
    return docs.select("doc_id", F.concat(head, F.coalesce("text", F.lit(""))).alias("text"))


_WORDS_IN = "CASE WHEN trim({c}) = '' THEN 0 ELSE len(regexp_split_to_array(trim({c}), '\\s+')) END"
_HOLDS = lambda c, words: "(" + " OR ".join(f"contains(upper({c}), '{w}')" for w in words) + ")"
_UPPER = lambda c: f"(upper({c}) = {c} AND lower({c}) <> {c})"
_TITLE = "trim(regexp_extract(line, '^\\d+(?:\\.\\d+)*\\.\\s+(.+)$', 1))"
_NUMBERED = f"({_TITLE} <> '' AND length({_TITLE}) <= 72 AND {_WORDS_IN.format(c=_TITLE)} <= 7 AND ({_HOLDS(_TITLE, L.SECTION_WORDS)} OR ({_UPPER(_TITLE)} AND {_WORDS_IN.format(c=_TITLE)} <= 5)))"
_KIND = f"""CASE WHEN regexp_matches(line, '{L.ID_LINE}') OR regexp_matches(line, '{L.PAIR}') THEN 'pair'
    WHEN CASE WHEN regexp_matches(line, '^\\d+\\.\\d+') THEN regexp_matches(line, '^\\d+(?:\\.\\d+)+[).]?\\s+\\S+') ELSE {_NUMBERED} END
      OR (length(line) <= 100 AND CASE WHEN regexp_matches(line, '^\\d+[).]\\s+') THEN {_NUMBERED}
          ELSE regexp_matches(line, '^(\\d+\\.)+\\s+[A-ZÄÖÜ]') OR ({_UPPER('line')} AND {_WORDS_IN.format(c='line')} < 6) OR ({_HOLDS('line', L.SHORT_WORDS)} AND {_WORDS_IN.format(c='line')} < 4) END) THEN 'heading'
    WHEN regexp_matches(line, '^[-*•]\\s+.') THEN 'bullet' WHEN regexp_matches(line, '^\\d+[).]\\s+.') AND NOT {_NUMBERED} THEN 'number' ELSE 'paragraph' END"""
_BLOCKS = f"""
src AS (SELECT row_number() OVER () AS rid, doc_id, '1. Purpose of ' || lang || chr(10) || 'Source: ' || source || chr(10) || '- id ' || doc_id || chr(10) || '-  size ' || n_chars || chr(10) || '1) read' || chr(10) || '2) keep' || chr(10) || '1.1 ' || source || chr(10) || coalesce(text, '') AS text FROM documents),
raw AS (SELECT rid, doc_id, unnest(regexp_split_to_array(text, '\\r\\n|[\\n\\r]')) AS l, generate_subscripts(regexp_split_to_array(text, '\\r\\n|[\\n\\r]'), 1) AS pos FROM src),
cl AS (SELECT rid, doc_id, pos, trim(regexp_replace(regexp_replace(l, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'), '\\s+', ' ', 'g')) AS line FROM raw),
k AS (SELECT rid, doc_id, pos, line, {_KIND} AS kind FROM cl WHERE line <> ''),
g AS (SELECT *, sum(CASE WHEN kind IN ('pair', 'heading') OR prev IS NULL OR prev <> kind THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY pos) AS block
      FROM (SELECT *, lag(kind) OVER (PARTITION BY rid ORDER BY pos) AS prev FROM k)),
v AS (SELECT *, CASE kind WHEN 'bullet' THEN regexp_replace(line, '^[-*•]\\s+', '') WHEN 'number' THEN regexp_replace(line, '^\\d+[).]\\s+', '') ELSE line END AS v,
        CASE WHEN regexp_extract(line, '^(\\d+(?:\\.\\d+)*)', 1) = '' THEN 2 ELSE least(3, len(string_split(regexp_extract(line, '^(\\d+(?:\\.\\d+)*)', 1), '.')) + 1) END AS lv FROM g),
b AS (SELECT rid, doc_id, block, first(kind) AS kind, CASE WHEN first(kind) = 'heading' THEN first(lv) END AS level, string_agg(v, chr(10) ORDER BY pos) AS text, count(*) AS n_lines FROM v GROUP BY rid, doc_id, block)"""
_TYPE = "CASE kind WHEN 'heading' THEN CASE WHEN level <= 2 THEN 'section_heading' ELSE 'heading' END WHEN 'pair' THEN 'two_column_row' WHEN 'bullet' THEN 'bullet_list' WHEN 'number' THEN 'numbered_list' ELSE 'paragraph' END"
_PAIR_TEXT = "CASE WHEN kind = 'pair' THEN trim(split_part(text, ':', 1)) || ': ' || trim(substr(text, instr(text, ':') + 1)) ELSE text END"


@query(f"WITH {_BLOCKS} SELECT doc_id, block, {_TYPE} AS type, CAST(level AS INTEGER) AS level, md5({_PAIR_TEXT}) AS text_md5 FROM b")
def line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed blocks of each text's lines."""
    found = B.blocks_of_lines(_documents(spark, sf_dir))
    text = F.when(F.col("type").endswith("_list"), F.array_join("items", "\n")).otherwise(B.block_text())
    return found.select(F.col("id").alias("doc_id"), F.col("block").cast("long"), "type", "level", F.md5(text).alias("text_md5"))


@query(
    f"""WITH {_BLOCKS},
    s AS (SELECT *, sum(CASE WHEN kind = 'heading' AND level <= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY block) AS nth FROM b),
    u AS (SELECT *, sum(CASE WHEN kind = 'heading' AND level > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY rid, nth ORDER BY block) AS sub FROM s),
    t AS (SELECT *, first(text) OVER (PARTITION BY rid, nth ORDER BY block) AS st, first(text) OVER (PARTITION BY rid, nth, sub ORDER BY block) AS ut, first(level) OVER (PARTITION BY rid, nth ORDER BY block) AS sl, min(nth) OVER (PARTITION BY rid) AS low FROM u)
    SELECT doc_id, CAST(nth + 1 - low AS BIGINT) AS section, CASE WHEN nth = 0 THEN 'Document Body' ELSE st END AS section_title, CAST(CASE WHEN nth = 0 THEN 1 ELSE sl END AS INTEGER) AS section_level,
      CAST(sub AS BIGINT) AS subsection, CASE WHEN sub > 0 THEN ut END AS subsection_title, count(*) FILTER (kind <> 'heading') AS n_nodes FROM t GROUP BY ALL"""
)
def section_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections and subsections with the number of nodes in each."""
    placed = B.hierarchy(B.blocks_of_lines(_documents(spark, sf_dir)))
    keys = ["section", "section_title", "section_level", "subsection", "subsection_title"]
    return placed.groupBy("row", F.col("id").alias("doc_id"), *keys).agg(F.count_if(~F.col("is_heading")).alias("n_nodes")).drop("row")


@query(f"WITH {_BLOCKS} SELECT doc_id, md5(string_agg(CASE WHEN kind IN ('bullet', 'number') THEN replace(text, chr(10), chr(10) || chr(10)) ELSE text END, chr(10) || chr(10) ORDER BY block)) AS text_md5 FROM b WHERE kind <> 'pair' GROUP BY rid, doc_id")
def flat_block_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of a document's blocks, one after another."""
    return B.flat_text(B.blocks_of_lines(_documents(spark, sf_dir))).select(F.col("id").alias("doc_id"), F.md5("text").alias("text_md5"))


@query()
def markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of markdown: each text under a title, a table and an image made of its columns."""
    docs = table(spark, sf_dir, "documents")
    cells = F.concat(F.lit("|id|"), F.col("doc_id"), F.lit("|\n|---|---|\n| lang | "), F.col("lang"), F.lit(" |\n\n|**size**|"))
    text = F.concat(F.col("source"), F.lit("\n===\n## *about* "), F.col("lang"), F.lit("\n"), cells, F.lit("\n![a page](p.png)\nScans\n---\n12\n"), F.coalesce("text", F.lit("")))
    found = B.blocks_of_markdown(docs.select("doc_id", text.alias("text")))
    return found.select(F.col("id").alias("doc_id"), "block", "type", "level", F.md5(B.block_text()).alias("text_md5"))


@query()
def nested_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as one nested value, as JSON."""
    placed = B.nested(B.hierarchy(B.blocks_of_lines(_documents(spark, sf_dir))))
    return placed.select(F.col("id").alias("doc_id"), F.size("sections").alias("n_sections"), F.sha2(F.to_json("sections"), 256).alias("json_sha256"))


_TYPES = "CASE " + " ".join(f"WHEN regexp_matches(lower(title), '{'|'.join(w)}') THEN '{k}'" for k, w in B.CHUNK_TYPES.items()) + " ELSE 'general' END"


@query(
    f"""WITH src AS (SELECT row_number() OVER () AS rid, doc_id, text || chr(10) || '## Scope of ' || source || chr(10) || lang AS text FROM documents),
    l AS (SELECT rid, doc_id, unnest(regexp_split_to_array(text, '\\r\\n|[\\n\\r]')) AS line, generate_subscripts(regexp_split_to_array(text, '\\r\\n|[\\n\\r]'), 1) - 1 AS pos FROM src),
    h AS (SELECT *, sum(CASE WHEN regexp_matches(trim(line), '{B.HEADER_LINE}') THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY pos) AS nth FROM l),
    c AS (SELECT rid, doc_id, nth, CASE WHEN nth = 0 THEN 'Intro' ELSE substr(trim(first(line ORDER BY pos)), 1, 120) END AS title, min(pos) AS start_line, max(pos) AS end_line,
          regexp_replace(string_agg(line, chr(10) ORDER BY pos), '^\\s+|\\s+$', '', 'g') AS content FROM h GROUP BY rid, doc_id, nth)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY rid ORDER BY nth) AS INTEGER) AS chunk, title, {_TYPES} AS section_type, CASE WHEN title = 'Intro' THEN 'intro' ELSE 'header' END AS chunk_type,
      CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line, md5(content) AS content_md5 FROM c WHERE content <> ''"""
)
def header_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that begin at lines with a section's word (L6); each text ends with such a line."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit("\n## Scope of "), "source", F.lit("\n"), "lang").alias("text"))
    found = B.header_chunks(docs)
    return found.select(F.col("id").alias("doc_id"), "chunk", "title", "section_type", "chunk_type", "start_line", "end_line", F.md5("content").alias("content_md5"))


@query(
    """WITH c AS (SELECT *, CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 3 END AS n, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r FROM customer),
    h AS (SELECT c_nationkey, greatest(count(*) FILTER (n = 3) + 1, count(*) FILTER (n = 2)) AS most, count(*) + 1 AS total FROM c WHERE r <= 38 GROUP BY c_nationkey)
    SELECT c_nationkey, count(*) + 1 AS n_rows, 1 AS n_headers, md5('No.|Name|Segment;' || string_agg(c_custkey || '|' || c_name || '|' || CASE WHEN n = 2 THEN '' ELSE c_mktsegment END, ';' ORDER BY c_custkey)) AS cells_md5
    FROM c JOIN h USING (c_nationkey) WHERE most >= 0.6 * total GROUP BY c_nationkey HAVING count(*) > 1"""
)
def plain_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables found in plain text by their columns, padded, with their header rows (K20); a text for each nation."""
    one = F.concat(F.col("c_custkey"), F.lit("\t"), F.col("c_name"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.concat(F.lit("   "), "c_mktsegment")))
    texts = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", one.alias("t")))).alias("ts"))
    lines = F.concat(F.array(F.lit("No.\tName\tSegment"), F.lit("a line of prose")), F.transform("ts", lambda x: x["t"]))
    rows = texts.filter(F.size("ts") > 1).select("c_nationkey", lines.alias("lines")).filter(L.looks_like_table(F.col("lines"))).withColumn("rows", L.table_of(F.col("lines")))
    cells = F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), ";")
    return rows.select("c_nationkey", F.size("rows").cast("long").alias("n_rows"), L.header_rows(F.col("rows")).alias("n_headers"), F.md5(cells).alias("cells_md5"))


@query(
    f"""WITH {_BLOCKS} SELECT doc_id, md5(string_agg(CASE kind WHEN 'paragraph' THEN replace(text, chr(10), '') WHEN 'pair' THEN {_PAIR_TEXT} ELSE text END, chr(10) ORDER BY block)) AS text_md5 FROM b GROUP BY rid, doc_id"""
)
def block_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's blocks as one tree, read back as text."""
    trees = B.trees(B.blocks_of_lines(_documents(spark, sf_dir)))
    return trees.select(F.col("id").alias("doc_id"), F.md5(J.tree_text("tree")).alias("text_md5"))


@query(
    """SELECT doc_id, 'SOP-QA-' || lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0') AS number, CASE doc_id % 3 WHEN 0 THEN '2.' || (doc_id % 7) WHEN 1 THEN 'V' || (doc_id % 9) ELSE '4.' || (doc_id % 5) END AS version,
      CASE doc_id % 3 WHEN 0 THEN 'label' WHEN 1 THEN 'table' ELSE 'near number' END AS version_from, '2024-03-' || lpad(CAST(1 + doc_id % 28 AS VARCHAR), 2, '0') AS effective_date, lower(source) AS status, CASE WHEN doc_id % 3 = 0 THEN 'on ' || source END AS title FROM documents"""
)
def document_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number, version with the rung it came from, date, status and title of whole texts with a head made of their columns."""
    docs, n = table(spark, sf_dir, "documents"), F.col("doc_id")
    number = F.concat(F.lit("SOP-QA-"), F.lpad((n % 1000).cast("string"), 3, "0"))
    head = (
        F.when(n % 3 == 0, F.concat(F.lit("Title: "), number, F.lit(" - on "), "source", F.lit("\nVersion: 2."), n % 7))
        .when(n % 3 == 1, F.concat(F.lit("| Change | Version | Date |\n|---|---|---|\n| a | V99 | 2020-01-01 |\n| b | V"), n % 9, F.lit(" | 02.01.2020 |\n")))
        .otherwise(F.concat(F.lit("a line\nRevision: 4."), n % 5, F.lit(" of it")))
    )
    text = F.concat(number, F.lit("\n"), head, F.lit("\nEffective date: "), 1 + n % 28, F.lit(". März 2024\nStatus: "), F.upper("source"), F.lit("\n\n"), F.coalesce("text", F.lit("")))
    found = M.metadata(docs.select("doc_id", text.alias("text")))
    return found.select(F.col("id").alias("doc_id"), "number", "version", "version_from", "effective_date", "status", F.when(F.col("id") % 3 == 0, F.col("title")).alias("title"))
