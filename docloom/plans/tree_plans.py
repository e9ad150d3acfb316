"""Queries of document trees, labelled values, references, placeholders and record files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import nlp as N
from docloom.functions import text as X
from docloom.functions import tree as J
from docloom.operators import tables as B
from docloom.plans.registry import query
from docloom.session import scratch, table
from docloom.sources import records


def _node(kind: str, *content: Column, **attrs: Column) -> Column:
    """JSON of a node, made in the row."""
    inner = F.concat_ws(",", *content)
    head = F.concat(F.lit(f'{{"type":"{kind}"'), *[x for k, v in attrs.items() for x in (F.lit(f',"attrs":{{"{k}":'), v.cast("string"), F.lit("}"))])
    return F.concat(head, F.lit(',"content":['), inner, F.lit("]}"))


def _leaf(text: Column) -> Column:
    return F.concat(F.lit('{"type":"text","text":'), F.to_json(F.struct(text.alias("t"))).substr(F.lit(6), F.length(F.to_json(F.struct(text.alias("t")))) - 6), F.lit("}"))


def _trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree for each part: its brand as heading, its name and type as paragraphs."""
    tree = _node("doc", _node("heading", _leaf(F.col("p_brand")), level=F.lit(2)), _node("paragraph", _leaf(F.col("p_name"))), _node("list", _node("paragraph", _leaf(F.col("p_type")))))
    return table(spark, sf_dir, "part").select("p_partkey", tree.alias("tree"))


@query("SELECT p_partkey, p_brand || chr(10) || p_name || chr(10) || p_type AS text FROM part")
def tree_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of a tree, one per line."""
    return _trees(spark, sf_dir).select("p_partkey", J.tree_text("tree").alias("text"))


@query("SELECT p_partkey, p_brand AS name, 2 AS level, p_name || chr(10) || p_type AS text FROM part")
def tree_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text under its last heading (L3)."""
    rows = _trees(spark, sf_dir).select("p_partkey", F.explode(J.tree_sections("tree")).alias("s"))
    return rows.select("p_partkey", "s.name", "s.level", "s.text")


@query("SELECT p_partkey, '0.0' AS path, p_brand AS text FROM part UNION ALL SELECT p_partkey, '1.0', p_name FROM part UNION ALL SELECT p_partkey, '2.0.0', p_type FROM part")
def tree_text_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Editable text nodes by path."""
    return _trees(spark, sf_dir).select("p_partkey", F.explode(J.text_nodes("tree")).alias("n")).select("p_partkey", "n.path", "n.text")


@query("SELECT p_partkey, p_brand || chr(10) || 'new ' || p_partkey || chr(10) || p_type AS text FROM part")
def tree_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A patched text node; blank patches and unknown paths change nothing."""
    patch = lambda path, text: F.struct(F.lit(path).alias("path"), text.alias("text"))
    patches = F.array(patch("1.0", F.concat(F.lit("new "), F.col("p_partkey"))), patch("0.0", F.lit(" ")), patch("9.9", F.lit("x")))
    return _trees(spark, sf_dir).select("p_partkey", J.tree_text(J.apply_patches("tree", patches)).alias("text"))


@query("SELECT p_partkey, p_brand AS owner, p_type AS kind, CAST(NULL AS VARCHAR) AS missing FROM part")
def labelled_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What follows a label, up to the next label."""
    text = F.concat(F.lit("Owner: "), F.col("p_brand"), F.lit(" Kind: "), F.col("p_type"), F.lit("\nrest"))
    pick = lambda label: N.labelled_value(text, label, ["Owner", "Kind", "Due"])
    return table(spark, sf_dir, "part").select("p_partkey", pick("Owner").alias("owner"), pick("Kind").alias("kind"), pick("Due").alias("missing"))


@query("SELECT o_orderkey, 'CAPA-' || o_orderkey || ',CAPA-A' || o_custkey AS refs FROM orders")
def entity_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record ids in a text, each once, in the order of first sight."""
    text = F.concat(F.lit("see capa-"), F.col("o_orderkey"), F.lit(", CAPA-A"), F.col("o_custkey"), F.lit(" and CAPA-"), F.col("o_orderkey"), F.lit(" or DEV-1"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(X.entity_refs(text, "CAPA"), ",").alias("refs"))


@query("SELECT c_custkey, 'Dear ' || c_name || ' of ' || c_mktsegment || ', {{unknown}}' AS text FROM customer")
def filled_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placeholders from a map, by name and then in any case; unknown ones stay."""
    values = F.create_map(F.lit("name"), F.col("c_name"), F.lit("Segment"), F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", N.fill_placeholders(F.lit("Dear {{ name }} of {{segment}}, {{unknown}}"), values).alias("text"))


@query("SELECT n_nationkey, TRUE AS numbered, length(n_name) - length(replace(n_name, ' ', '')) < 5 AS capitals, FALSE AS plain FROM nation")
def heading_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line predicates."""
    is_heading = lambda c: N.is_heading(c)
    return table(spark, sf_dir, "nation").select("n_nationkey", is_heading(F.concat(F.lit("1.2 "), F.initcap("n_name"))).alias("numbered"), is_heading(F.upper("n_name")).alias("capitals"), is_heading(F.concat(F.lit("we met "), F.lower("n_name"))).alias("plain"))


@query("SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda x: contains(lower(x), 'the '))) > 0 AS BOOLEAN) AS any_line FROM documents")
def evidence_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a text has lines that hold a term (J9 gives the first sentences themselves)."""
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.exists(F.split("text", "\n"), lambda x: F.lower(x).contains("the ")), F.lit(False)).alias("any_line"))


@query("SELECT s_suppkey, n_nationkey AS matched FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey")
def resolved_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored keys found by a ladder of columns."""
    incoming = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name"), "s_nationkey").select("s_suppkey", F.lit(None).cast("int").alias("n_nationkey"), "n_name")
    stored = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return B.resolve(incoming, stored, "n_nationkey", ["n_name"]).select("s_suppkey", "matched")


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders")
def json_lines_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as JSON lines and read back by a given schema."""
    path = scratch(spark, "json")
    records.write_jsonl(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), path)
    return records.read_json_lines(spark, path, "o_orderkey long, o_orderstatus string, o_orderpriority string")


_BANKS = {"std": ["les", "der"], "ids": ["of", "to"], "timing": ["and", "und"], "controls": ["the", "die", "los", "que"], "records": ["with", "mit"], "approvals": ["from", "von"], "review": ["is", "ist"], "escalation": ["this", "ein"], "labels": ["in", "en", "de"]}
_POINTS = {"std": (10, 2), "ids": (4, 5), "timing": (4, 5), "controls": (5, 7), "records": (4, 5), "approvals": (4, 4), "review": (4, 3), "escalation": (3, 3), "labels": (4, 7)}
_SPLIT = f"string_split(regexp_replace(lower(text), '[^{N.LETTERS}]+', ' ', 'g'), ' ')"


@query(
    f"WITH w AS (SELECT doc_id, {_SPLIT} AS w FROM documents) SELECT doc_id, CAST(least(100, "
    + " + ".join(f"{p} * least({m}, {' + '.join(f"list_contains(w, '{t}')::INT" for t in _BANKS[k])})" for k, (p, m) in _POINTS.items())
    + ") AS BIGINT) AS score FROM w"
)
def compliance_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The compliance formula: nine counts with their points and limits, at most 100 (N8); banks of the tables' languages."""
    terms = sorted({t for bank in _BANKS.values() for t in bank})
    held = table(spark, sf_dir, "documents").select("doc_id", N._held_terms(F.col("text"), terms).alias("held"))
    counts = {k: sum((F.array_contains("held", t).cast("int") for t in bank), F.lit(0)) for k, bank in _BANKS.items()}
    return held.select("doc_id", N.capped_score(counts, _POINTS).alias("score"))
