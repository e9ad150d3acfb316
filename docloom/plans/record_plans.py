"""Queries of record texts, filters, sorts and states; the test tables stand in for records (see relational_plans)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import records as R
from docloom.functions import structure as T
from docloom.functions import text as X
from docloom.operators import search as S
from docloom.operators import tables as B
from docloom.plans.registry import query
from docloom.session import table


@query("SELECT c_custkey, trim('Name: ' || coalesce(c_name, '') || chr(10) || 'Segment: ' || coalesce(c_mktsegment, '') || chr(10) || 'Balance: ' || coalesce(CAST(c_custkey AS VARCHAR), '')) AS text FROM customer")
def entity_search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed labelled lines."""
    return table(spark, sf_dir, "customer").select("c_custkey", R.labelled_text({"Name": F.col("c_name"), "Segment": F.col("c_mktsegment"), "Balance": F.col("c_custkey")}).alias("text"))


@query("SELECT o_orderkey, 'Order: ' || o_orderkey || CASE WHEN o_orderstatus = 'P' THEN '' ELSE chr(10) || 'Status: ' || o_orderstatus END AS text FROM orders")
def entity_text_without_blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines without a value are left out."""
    status = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))
    return table(spark, sf_dir, "orders").select("o_orderkey", R.labelled_text({"Order": F.col("o_orderkey"), "Status": status}, drop_blank=True).alias("text"))


@query("SELECT p_partkey, coalesce(nullif(trim(p_brand), ''), p_type, 'Untitled') AS ref, substr(p_name, 1, 255) AS title, coalesce(p_type, p_brand) AS department FROM part")
def entity_display_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Display fields by a ladder of columns."""
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(R.first_of(F.col("p_brand"), F.col("p_type")), F.lit("Untitled")).alias("ref"), F.substring("p_name", 1, 255).alias("title"), R.first_of(F.col("p_type"), F.col("p_brand")).alias("department"))


@query("SELECT o_orderkey, o_custkey || '/v' || o_orderkey AS source_path, coalesce(nullif(o_orderstatus, 'P'), 'draft') AS status, strftime(o_orderdate, '%Y-%m-%d') AS updated FROM orders")
def public_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path, status with its default, ISO date."""
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.col("o_custkey"), F.lit("/v"), F.col("o_orderkey")).alias("source_path"), F.coalesce(F.nullif(F.col("o_orderstatus"), F.lit("P")), F.lit("draft")).alias("status"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("updated"))


@query(
    """SELECT CAST(o_orderkey AS BIGINT) AS id, 'order' AS type, coalesce(o_orderpriority, 'none') AS title, o_orderstatus AS status FROM orders
    UNION ALL SELECT p_partkey, 'part', p_name, 'open' FROM part UNION ALL SELECT s_suppkey, 'supplier', s_name, 'open' FROM supplier"""
)
def case_tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of several kinds in one list, defaults for what a kind lacks."""
    one = lambda t, key, kind, title, status: table(spark, sf_dir, t).select(F.col(key).cast("long").alias("id"), F.lit(kind).alias("type"), F.coalesce(title, F.lit("none")).alias("title"), status.alias("status"))
    parts = one("part", "p_partkey", "part", F.col("p_name"), F.lit("open")).unionByName(one("supplier", "s_suppkey", "supplier", F.col("s_name"), F.lit("open")))
    return one("orders", "o_orderkey", "order", F.col("o_orderpriority"), F.col("o_orderstatus")).unionByName(parts)


_STATES = [("urgent", "critical"), ("high", "high"), ("medium|not", "medium"), ("low", "low")]


@query("SELECT o_orderkey, CASE WHEN lower(o_orderpriority) LIKE '%urgent%' THEN 'critical' WHEN lower(o_orderpriority) LIKE '%high%' THEN 'high' WHEN regexp_matches(lower(o_orderpriority), 'medium|not') THEN 'medium' WHEN lower(o_orderpriority) LIKE '%low%' THEN 'low' ELSE '' END AS risk FROM orders")
def risk_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First pattern that is found (C11)."""
    return table(spark, sf_dir, "orders").select("o_orderkey", R.canonical(F.col("o_orderpriority"), _STATES).alias("risk"))


@query("SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank, substr(trim(regexp_replace(text, '[\\s]+', ' ', 'g')), 1, 280) AS snippet FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 12".replace("\\\\", "\\"))
def debug_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 12 of a source with a snippet."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", F.substring(F.trim(F.regexp_replace("text", r"\s+", " ")), 1, 280).alias("snippet"))
    return S.top_k(docs, 12, ["source"], [F.desc("n_chars"), F.col("doc_id")]).select("doc_id", "source", "rank", "snippet")


@query("SELECT doc_id FROM documents WHERE lang = 'en' AND source = 'src1'")
def payload_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equalities that are given, others not."""
    exact = {"lang": (F.col("lang"), "en"), "source": (F.col("source"), "src1"), "tenant": (F.lit("x"), None)}
    return table(spark, sf_dir, "documents").filter(R.payload_filter(exact)).select("doc_id")


@query("SELECT doc_id, 'listed' AS origin FROM documents WHERE doc_id IN (1, 5, 9, 12) UNION ALL SELECT doc_id, 'unrestricted' FROM documents WHERE lang = 'de'")
def allow_list_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An allow-list, a missing one and an empty one that matches nothing."""
    docs = table(spark, sf_dir, "documents")
    part = lambda exact, ids, name: docs.filter(R.payload_filter(exact, (F.col("doc_id"), ids))).select("doc_id", F.lit(name).alias("origin"))
    german = {"lang": (F.col("lang"), "de")}
    return part({}, [1, 5, 9, 12], "listed").union(part(german, None, "unrestricted")).union(part(german, [], "empty"))


@query("SELECT DISTINCT d.doc_id FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 1")
def ready_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a ready row, by a semi-join that lists none twice."""
    ready = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return table(spark, sf_dir, "documents").join(ready, "doc_id", "left_semi").select("doc_id").distinct()


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name || ' ' || p_type || ' ' || p_brand), 'st') AND p_size >= 10 ORDER BY p_partkey".replace(" AND p_size >= 10", ""))
def term_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A term in the joined texts of a record."""
    return table(spark, sf_dir, "part").filter(R.any_contains("st", F.concat_ws(" ", "p_name", "p_type", "p_brand"))).select("p_partkey", "p_name")


@query("SELECT o_orderkey FROM orders WHERE lower(o_orderpriority) LIKE '1-%' OR o_orderstatus = 'P'")
def critical_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").filter(F.lower("o_orderpriority").startswith("1-") | (F.col("o_orderstatus") == "P")).select("o_orderkey")


@query(
    """WITH s AS (SELECT user_id, event_id, value, max(value - 50) OVER (PARTITION BY user_id) AS best FROM events)
    SELECT user_id, event_id, best < 0 AS degraded, round(CASE WHEN best < 0 THEN 0 ELSE value - 50 END, 6) AS score FROM s WHERE best < 0 OR value - 50 > -5"""
)
def rerank_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a list: all below 0 keep the order with score 0 and a mark, else those of -5 or less go."""
    score = F.col("value") - 50
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", score.alias("s")).withColumn("best", F.max("s").over(Window.partitionBy("user_id")))
    kept = rows.filter("best < 0 or s > -5")
    return kept.select("user_id", "event_id", (F.col("best") < 0).alias("degraded"), F.round(F.when(F.col("best") < 0, 0.0).otherwise(F.col("s")), 6).alias("score"))


@query("SELECT DISTINCT a.o_orderkey AS src, b.o_orderkey AS dst FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey WHERE a.o_orderstatus = 'F' AND b.o_orderstatus = 'P'")
def extracted_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record of one kind with each of another within a document (E10, E11): an equality join by document."""
    orders = table(spark, sf_dir, "orders")
    left = orders.filter("o_orderstatus = 'F'").select("o_custkey", F.col("o_orderkey").alias("src"))
    right = orders.filter("o_orderstatus = 'P'").select("o_custkey", F.col("o_orderkey").alias("dst"))
    return left.join(right, "o_custkey").select("src", "dst").distinct()


@query("SELECT event_type, count(*) AS fetched, count(*) FILTER (value > 50) AS queued, count(*) FILTER (value IS NULL OR value <= 50) AS missing FROM events GROUP BY event_type")
def sync_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a synchronisation by kind."""
    queued = F.coalesce(F.col("value") > 50, F.lit(False))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("fetched"), F.count_if(queued).alias("queued"), F.count_if(~queued).alias("missing"))


@query("SELECT user_id, min_by(event_id, (ts, event_id)) AS claimed FROM events WHERE event_type <> 'error' GROUP BY user_id".replace("min_by(event_id, (ts, event_id))", "first(event_id ORDER BY ts, event_id)"))
def fifo_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest open job of each queue (G15, O1): a struct minimum, partial before the shuffle."""
    jobs = table(spark, sf_dir, "events").filter("event_type <> 'error'")
    return jobs.groupBy("user_id").agg(F.min(F.struct("ts", "event_id")).alias("m")).select("user_id", F.col("m.event_id").alias("claimed"))


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_mktsegment = 'BUILDING' DESC, c_custkey DESC LIMIT 3")
def active_first_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").orderBy(F.desc(F.col("c_mktsegment") == "BUILDING"), F.desc("c_custkey")).limit(3).select("c_custkey", "c_name")


@query("SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey) AS pos FROM part")
def title_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in an order by title."""
    return table(spark, sf_dir, "part").select("p_partkey", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_name", "p_partkey")).alias("pos"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def missing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of a source that the output lacks."""
    return table(spark, sf_dir, "customer").select("c_custkey").join(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query(
    r"""SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS spaced, regexp_replace(regexp_replace(lower(source), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS key,
    CAST(len(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_/-]*')) AS BIGINT) AS tokens, CAST(len(string_split(text, chr(10))) AS BIGINT) AS lines,
    CASE WHEN length(text) > 60 THEN rtrim(substr(text, 1, 57)) || '...' ELSE text END AS cut, coalesce(length(text) - length(replace(replace(text, '*', ''), '_', '')), 0) AS marks FROM documents"""
)
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Space, key, tokens, lines and cuts."""
    t = F.col("text")
    marks = (F.length(t) - F.length(F.translate(t, "*_", ""))).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.normalize_space(t)).alias("spaced"), X.normalize_key(F.col("source")).alias("key"), F.size(X.tokens(t)).cast("long").alias("tokens"), F.size(R.split_lines(t)).cast("long").alias("lines"), X.truncate(t, 60).alias("cut"), marks.alias("marks"))


@query(
    """SELECT p_partkey, regexp_matches(lower(p_type), '(^|[^a-z0-9])steel([^a-z0-9]|$)') AS steel,
    array_to_string(list_filter(['brass', 'steel', 'tin'], lambda w: regexp_matches(lower(p_type), '(^|[^a-z0-9])' || w || '([^a-z0-9]|$)')), ',') AS hits,
    nullif(regexp_extract(p_type, '([A-Z]+)$', 1), '') AS last_word FROM part"""
)
def keyword_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-word terms, hits and first matches."""
    t = F.col("p_type")
    return table(spark, sf_dir, "part").select("p_partkey", X.contains_term(t, "steel").alias("steel"), F.array_join(X.keyword_hits(t, ["tin", "steel", "brass"]), ",").alias("hits"), R.first_match(t, ["([A-Z]+)$", "(x)"]).alias("last_word"))


@query(
    """SELECT p_partkey, 'note ' || p_partkey AS clean, p_name AS plain, round(p_partkey / 7.0, 3) AS rounded, least(1.0, greatest(0.0, p_partkey / 100.0)) AS clamped,
    CASE WHEN p_partkey % 5 = 0 THEN 0.0 ELSE p_partkey / CAST(p_partkey % 5 AS DOUBLE) END AS ratio,
    substr(md5(p_name), 1, 8) || '-' || substr(md5(p_name), 9, 4) || '-' || substr(md5(p_name), 13, 4) || '-' || substr(md5(p_name), 17, 4) || '-' || substr(md5(p_name), 21, 12) AS uuid,
    CAST(NULL AS VARCHAR) AS no_uuid, round(least(0.97, 1 - exp(-(p_partkey % 9) / 3.2)), 3) AS confidence FROM part"""
)
def value_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control characters and markdown off, safe numbers, identifiers, confidence."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        R.strip_controls(F.concat(F.lit("note\x00 \x07"), k)).alias("clean"),
        R.strip_markdown(F.concat(F.lit("﻿## **"), F.col("p_name"), F.lit("**"))).alias("plain"),
        R.safe_round(k / 7).alias("rounded"),
        R.clamp(k / 100).alias("clamped"),
        R.ratio(k.cast("double"), (k % 5).cast("double")).alias("ratio"),
        R.uuid_or_null(F.concat(F.lit("{"), F.upper(F.md5("p_name")), F.lit("}"))).alias("uuid"),
        R.uuid_or_null(F.col("p_name")).alias("no_uuid"),
        X.confidence_from_score((k % 9).cast("double")).alias("confidence"),
    )


@query("SELECT o_orderkey, o_orderdate::TIMESTAMP AS at, CAST(NULL AS TIMESTAMP) AS bad FROM orders")
def date_to_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ISO strings to timestamps, null for others (K2)."""
    stamp = lambda c: c.try_cast("timestamp_ntz")
    return table(spark, sf_dir, "orders").select("o_orderkey", stamp(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).alias("at"), stamp(F.col("o_orderpriority")).alias("bad"))


@query("SELECT o_orderkey, 'V' || (o_orderkey % 7) || '.' || (o_orderkey % 3) AS v, 'Rev. ' || lpad(CAST(o_orderkey % 12 AS VARCHAR), 2, '0') AS rev, CAST(o_orderkey % 4 AS VARCHAR) AS plain FROM orders")
def version_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical version labels."""
    k = F.col("o_orderkey")
    form = lambda *parts: B.canonical_version(F.concat(*parts))
    return table(spark, sf_dir, "orders").select("o_orderkey", form(F.lit(" version "), k % 7, F.lit("."), k % 3).alias("v"), form(F.lit("Revision "), k % 12).alias("rev"), form((k % 4).cast("string")).alias("plain"))


@query("SELECT o_custkey, max(o_orderkey % 7) AS major FROM orders GROUP BY o_custkey")
def newest_version_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greatest label by its sort key, not by its letters."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.concat(F.lit("V"), F.col("o_orderkey") % 7, F.lit(".10")).alias("label"))
    best = rows.groupBy("o_custkey").agg(F.max_by("label", B.version_key(F.col("label"))).alias("label"))
    return best.select("o_custkey", F.regexp_extract("label", r"^V(\d+)", 1).cast("long").alias("major"))


@query(
    """SELECT c_custkey, c_name, CASE WHEN c_nationkey < 8 THEN 'new' ELSE c_mktsegment END AS segment FROM customer WHERE c_nationkey < 8 OR c_mktsegment <> 'BUILDING'"""
)
def upsert_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored rows replaced and new ones added by key."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_mktsegment").alias("segment"), "c_nationkey")
    stored = rows.filter("segment <> 'BUILDING'").drop("c_nationkey")
    incoming = rows.filter("c_nationkey < 8").drop("c_nationkey").withColumn("segment", F.lit("new"))
    return B.upsert(stored, incoming, "c_custkey")


@query("SELECT l_orderkey, l_linenumber, 'old' AS origin FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O') UNION ALL SELECT o_orderkey, 0, 'new' FROM orders WHERE o_orderstatus = 'O'")
def replace_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stored chunks of a document replaced by its new ones (B2)."""
    stored = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.lit("old").alias("origin"))
    new = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(0).cast(stored.schema["l_linenumber"].dataType).alias("l_linenumber"), F.lit("new").alias("origin"))
    return B.replace_scope(stored, new, ["l_orderkey"])


@query("SELECT 'orders' AS entity, count(*) AS kept, (SELECT count(*) FROM orders) - count(*) AS purged FROM orders WHERE o_orderstatus <> 'P'")
def purge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a purge keeps and deletes, in one pass."""
    gone = F.col("o_orderstatus") == "P"
    return table(spark, sf_dir, "orders").agg(F.count_if(~gone).alias("kept"), F.count_if(gone).alias("purged")).select(F.lit("orders").alias("entity"), "kept", "purged")


@query(
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'ok' WHEN o_orderstatus = 'F' THEN 'wrong status' ELSE 'unknown action' END AS verdict,
    CASE WHEN o_orderstatus = 'O' THEN 'closed' ELSE o_orderstatus END AS new_status FROM orders"""
)
def guarded_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests against a state machine."""
    rules = spark.createDataFrame([("close", ["O"], "closed", False)], "action string, from_status array<string>, to_status string, needs_note boolean")
    action = F.when(F.col("o_orderstatus") == "P", "unknown").otherwise("close")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", action.alias("action"), F.col("o_orderstatus").alias("status"), F.lit(None).cast("string").alias("note"))
    return B.guard_transition(rows, rules).select("o_orderkey", "verdict", "new_status")


@query(
    """WITH f AS (SELECT user_id, event_type, min(struct_pack(ts := ts, id := event_id)) AS first FROM events GROUP BY user_id, event_type)
    SELECT user_id, string_agg(event_type, ',' ORDER BY first) AS types, count(*) AS n FROM f GROUP BY user_id"""
)
def merged_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of list columns per key, in the order of first sight."""
    rows = table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("o"), F.array("event_type").alias("types"))
    return B.merge_lists(rows, "user_id", ["types"], "o").select("user_id", F.array_join("types", ",").alias("types"), F.size("types").cast("long").alias("n"))



@query(
    """SELECT n_nationkey, t.title, t.label, t.level, t.start_line, t.end_line, t.confidence FROM nation,
    (VALUES ('Purpose', 'purpose', 1, 0, 1, 0.98::DOUBLE), ('SCOPE', 'scope', 1, 2, 3, 0.98), ('Review', 'review', 2, 4, 4, 0.98), ('Records', 'records', 1, 5, 5, 0.98)) t(title, label, level, start_line, end_line, confidence)"""
)
def section_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings, labels, levels, ends and a doubled heading of a text made for each nation."""
    text = F.concat(F.lit("1. Purpose\nto do "), F.col("n_name"), F.lit(" well\nSCOPE\nSCOPE\n2.1 Review\nRecords:"))
    found = T.sections(table(spark, sf_dir, "nation").select("n_nationkey", text.alias("text")), "n_nationkey")
    return found.select("n_nationkey", "title", "label", "level", "start_line", "end_line", "confidence")


@query(
    """WITH stored AS (SELECT o_custkey AS src, o_orderkey AS dst FROM orders WHERE o_orderkey % 2 = 0), found AS (SELECT DISTINCT a.o_custkey AS src, l.l_orderkey AS dst FROM orders a JOIN lineitem l ON l.l_orderkey = a.o_orderkey)
    SELECT src, dst FROM found EXCEPT SELECT src, dst FROM stored"""
)
def absent_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links found in documents that aren't stored yet, each once."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"))
    found = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("dst")).join(orders, "dst").select("src", "dst")
    return B.insert_absent(orders.filter("dst % 2 = 0"), found, ["src", "dst"])


@query(
    """SELECT kind, count(*) AS n, sum(src) AS srcs FROM (
      SELECT l_returnflag AS kind, l_orderkey AS src, l_linenumber AS dst FROM lineitem WHERE (l_returnflag, l_orderkey, l_linenumber) NOT IN (SELECT l_returnflag, l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < 5 AND l_returnflag IN ('A', 'R'))
      UNION ALL SELECT l_returnflag, l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45 AND l_returnflag IN ('A', 'R')) GROUP BY kind
    UNION ALL SELECT 'refused', count(*), sum(l_orderkey) FROM lineitem WHERE (l_quantity < 5 OR l_quantity > 45) AND l_returnflag NOT IN ('A', 'R')"""
)
def link_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links after requests to create and delete some; requests of an unknown kind are refused."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("kind"), F.col("l_orderkey").alias("src"), F.col("l_linenumber").alias("dst"), "l_quantity")
    requests = rows.filter("l_quantity < 5 or l_quantity > 45").withColumn("action", F.when(F.col("l_quantity") < 5, "delete").otherwise("create")).drop("l_quantity")
    links, refused = B.apply_links(rows.drop("l_quantity"), requests, ["A", "R"])
    both = links.select("kind", "src").unionByName(refused.select(F.lit("refused").alias("kind"), "src"))
    return both.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("src").alias("srcs"))


@query(
    """WITH s AS (SELECT c_custkey AS number, c_acctbal > 0 AS analysed FROM customer WHERE c_custkey % 3 <> 0),
    r AS (SELECT o_orderkey, o_custkey AS number, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth FROM orders)
    SELECT o_orderkey, CASE WHEN analysed THEN 'existing' WHEN analysed IS NOT NULL OR nth > 1 THEN 'new version' ELSE 'created' END AS action FROM r LEFT JOIN s USING (number)"""
)
def document_creation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What requests to create documents come to."""
    stored = table(spark, sf_dir, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("number"), (F.col("c_acctbal") > 0).alias("analysed"))
    requests = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("number"))
    return B.document_requests(stored, requests, "o_orderkey").select("o_orderkey", "action")


@query(
    """WITH s AS (SELECT user_id, arg_max(event_id, struct_pack(ts := ts, id := event_id)) AS stored FROM events WHERE event_type = 'signup' GROUP BY user_id),
    x AS (SELECT event_id, CASE WHEN stored IS NOT NULL THEN 's' || stored WHEN event_id % 2 = 0 THEN 'c' || event_id END AS session, stored IS NULL AS is_new, ts FROM events LEFT JOIN s USING (user_id) WHERE event_type = 'view')
    SELECT event_id, session, 'user' AS role, is_new, ts AS at FROM x WHERE session IS NOT NULL UNION ALL SELECT event_id, session, 'assistant', is_new, ts + INTERVAL 1 MILLISECOND FROM x WHERE session IS NOT NULL"""
)
def chat_exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two rows of each exchange, in the stored, the client's or a new session (B11); new ones have a hashed name and aren't compared."""
    events = table(spark, sf_dir, "events").withColumn("document", F.lit(1))
    sessions = events.filter("event_type = 'signup'").select(F.concat(F.lit("s"), "event_id").alias("session"), "document", F.col("user_id").alias("user"), F.struct("ts", "event_id").alias("at"))
    client = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("c"), "event_id")).otherwise(" ")
    asked = events.filter("event_type = 'view'").select("document", F.col("user_id").alias("user"), client.alias("client_session"), F.col("event_id").cast("string").alias("question"), F.col("event_id").cast("string").alias("response"), F.col("ts").alias("at"))
    rows = B.exchange_rows(asked, sessions).filter(F.col("session").rlike("^[sc][0-9]+$"))
    return rows.select(F.col("content").cast("long").alias("event_id"), "session", "role", "is_new", "at")


@query(
    """SELECT c_custkey, c_name AS name, CASE WHEN c_nationkey % 2 = 0 THEN 'client' ELSE c_mktsegment END AS segment, c_custkey || '' AS hidden, CASE WHEN c_nationkey % 2 = 0 THEN 'extra' END AS extra FROM customer"""
)
def metadata_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A client's values over stored ones; blank ones and names with an underscore don't count."""
    even = F.col("c_nationkey") % 2 == 0
    stored = F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment"), F.lit("_id"), F.col("c_custkey").cast("string"))
    client = F.create_map(F.lit("name"), F.lit("  "), F.lit("segment"), F.when(even, "client"), F.lit("_id"), F.lit("forged"), F.lit("extra"), F.when(even, "extra").otherwise(""))
    rows = table(spark, sf_dir, "customer").select("c_custkey", B.merged_metadata(stored, client).alias("m"))
    return rows.select("c_custkey", F.col("m")["name"].alias("name"), F.col("m")["segment"].alias("segment"), F.col("m")["_id"].alias("hidden"), F.col("m")["extra"].alias("extra"))
