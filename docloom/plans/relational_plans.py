"""Relational queries: search, counts, versions, paging, the record graph, incremental state, events.

The test tables stand in for records: region -> nation -> customer -> order -> part is the chain of
linked record types, orders are versions of a customer, events are jobs of a user.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.operators import graph as G
from docloom.operators import incremental as I
from docloom.operators import search as S
from docloom.operators import vectors as V
from docloom.plans.registry import query
from docloom.session import table


def union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(" UNION ALL ".join(f"SELECT '{t}' AS entity, count(*) AS n FROM {t}" for t in ("customer", "orders", "part", "supplier", "nation")))
def stats_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return union_all([table(spark, sf_dir, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("entity"), "n") for t in ("customer", "orders", "part", "supplier", "nation")])


_SEARCHED = {"customer": ("c_custkey", ["c_name", "c_mktsegment"], 95), "supplier": ("s_suppkey", ["s_name"], 88), "part": ("p_partkey", ["p_name", "p_type", "p_brand"], 85), "nation": ("n_nationkey", ["n_name"], 80)}


@query(
    " UNION ALL ".join(
        f"SELECT '{t}' AS entity, CAST({k} AS BIGINT) AS id, {cols[0]} AS title, {score} AS match_percent FROM {t} WHERE {' OR '.join(c + " ILIKE '%1_ri%' OR " + c + " ILIKE '%red%'" for c in cols)}"
        for t, (k, cols, score) in _SEARCHED.items()
    )
)
def search_ilike_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A term over several columns and tables; wildcards in the term stay wildcards."""
    parts = []
    for t, (key, cols, score) in _SEARCHED.items():
        any_of = F.lit(False)
        for c in cols:
            any_of = any_of | F.col(c).ilike("%1_ri%") | F.col(c).ilike("%red%")
        parts.append(table(spark, sf_dir, t).filter(any_of).select(F.lit(t).alias("entity"), F.col(key).cast("long").alias("id"), F.col(cols[0]).alias("title"), F.lit(score).alias("match_percent")))
    return union_all(parts)


def token_filter(question: str, columns: list[str]) -> Column:
    """Any of the question's first eight tokens of three letters or more in any column."""
    import re

    found = re.findall("[a-z0-9]+", question.lower())
    out = F.lit(False)
    for token in [t for t in found if len(t) >= 3][:8]:
        for c in columns:
            out = out | F.col(c).ilike(f"%{token}%")
    return out


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%blue%' OR p_type ILIKE '%blue%' OR p_name ILIKE '%widget%' OR p_type ILIKE '%widget%' OR p_name ILIKE '%for%' OR p_type ILIKE '%for%'")
def token_or_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").filter(token_filter("a blue widget for", ["p_name", "p_type"])).select("p_partkey", "p_name")


@query("SELECT o_orderkey, lower(coalesce(nullif(o_orderstatus, 'P'), 'draft')) AS status FROM orders WHERE lower(coalesce(nullif(o_orderstatus, 'P'), 'draft')) = 'draft'")
def status_default_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.lower(F.coalesce(F.nullif(F.col("o_orderstatus"), F.lit("P")), F.lit("draft")))
    return table(spark, sf_dir, "orders").select("o_orderkey", status.alias("status")).filter("status = 'draft'")


@query(
    """WITH v AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders)
    SELECT c_custkey, coalesce(o_orderkey, -1) AS version, coalesce(o_orderstatus, 'none') AS status FROM customer LEFT JOIN v ON o_custkey = c_custkey AND r = 1"""
)
def latest_version_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = I.latest(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    rows = table(spark, sf_dir, "customer").join(newest, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.select("c_custkey", F.coalesce("o_orderkey", F.lit(-1)).alias("version"), F.coalesce("o_orderstatus", F.lit("none")).alias("status"))


@query(
    """SELECT d.doc_id, 'stored' AS origin FROM documents d JOIN labels l USING (doc_id)
    UNION ALL SELECT doc_id, 'auto' AS origin FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"""
)
def fallback_union_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored rows where there are any, made ones elsewhere: one left join instead of a semi and an anti join."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("__has"))
    return table(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left").select("doc_id", F.when(F.col("__has") == 1, "stored").otherwise("auto").alias("origin"))


def _edges(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Typed edges: nation -> customer -> order -> part -> supplier, and nation -> supplier."""
    pair = lambda t, a, b: table(spark, sf_dir, t).select(F.col(a).cast("long").alias("src"), F.col(b).cast("long").alias("dst"))
    return {
        "sop_dev": pair("customer", "c_nationkey", "c_custkey"),
        "dev_capa": pair("orders", "o_custkey", "o_orderkey"),
        "capa_audit": pair("lineitem", "l_orderkey", "l_partkey"),
        "audit_dec": pair("lineitem", "l_partkey", "l_suppkey"),
        "dec_sop": pair("supplier", "s_suppkey", "s_nationkey"),
    }


@query(
    """WITH sd AS (SELECT DISTINCT c_nationkey::BIGINT s, c_custkey d FROM customer), dc AS (SELECT DISTINCT o_custkey s, o_orderkey d FROM orders),
    ca AS (SELECT DISTINCT l_orderkey s, l_partkey d FROM lineitem), ad AS (SELECT DISTINCT l_partkey s, l_suppkey d FROM lineitem),
    ds AS (SELECT DISTINCT s_suppkey s, s_nationkey::BIGINT d FROM supplier),
    r AS (SELECT n_nationkey::BIGINT AS root FROM nation),
    dev0 AS (SELECT DISTINCT root, d AS id FROM r JOIN sd ON s = root), dec0 AS (SELECT DISTINCT root, s AS id FROM r JOIN ds ON d = root),
    aud0 AS (SELECT DISTINCT root, s AS id FROM dec0 JOIN ad ON d = id), capa0 AS (SELECT DISTINCT root, d AS id FROM dev0 JOIN dc ON s = id),
    aud AS (SELECT * FROM aud0 UNION SELECT root, d FROM capa0 JOIN ca ON s = id),
    capa AS (SELECT * FROM capa0 UNION SELECT root, s FROM aud JOIN ca ON d = id),
    dev AS (SELECT * FROM dev0 UNION SELECT root, s FROM capa JOIN dc ON d = id),
    dec AS (SELECT * FROM dec0 UNION SELECT root, d FROM aud JOIN ad ON s = id),
    sops AS (SELECT DISTINCT root, d AS id FROM dec JOIN ds ON s = id WHERE d <> root),
    x AS (SELECT root, 'deviation' AS type, id FROM dev UNION ALL SELECT root, 'capa', id FROM capa UNION ALL SELECT root, 'audit', id FROM aud
          UNION ALL SELECT root, 'decision', id FROM dec UNION ALL SELECT root, 'sop', id FROM sops)
    SELECT root, type, count(*) AS n, sum(id)::BIGINT AS id_sum FROM x GROUP BY root, type"""
)
def graph_traversal(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _edges(spark, sf_dir)
    roots = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("root"), F.col("n_nationkey").cast("long").alias("id"))
    found = G.quality_context(roots, e["sop_dev"], e["dev_capa"], e["capa_audit"], e["audit_dec"], e["dec_sop"])
    return found.groupBy("root", "type").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("id_sum"))


@query(
    """SELECT c_custkey AS root, count(DISTINCT o_orderkey) AS capas, count(DISTINCT l_partkey) AS audits, count(DISTINCT l_suppkey) AS decisions
    FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY c_custkey"""
)
def forward_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey").join(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    chain = chain.join(table(spark, sf_dir, "customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"))
    one = lambda c: F.countDistinct(c)
    return chain.groupBy(F.col("c_custkey").alias("root")).agg(one("o_orderkey").alias("capas"), one("l_partkey").alias("audits"), one("l_suppkey").alias("decisions"))


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus IN ('F', 'O')) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus NOT IN ('F', 'O'))")
def orphan_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that only deleted (F or O) orders point to."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst"), "o_orderstatus")
    gone = orders.filter(F.col("o_orderstatus").isin("F", "O")).select(F.col("src").alias("id"))
    return G.delete_orphans(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), orders.select("src", "dst"), gone)


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus IS NOT DISTINCT FROM l_linestatus)")
def stale_chunk_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_linestatus")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    same = (F.col("l_orderkey") == F.col("o_orderkey")) & F.col("l_linestatus").eqNullSafe(F.col("o_orderstatus"))
    return lines.join(orders, same, "left_anti").select("l_orderkey", "l_linenumber", "l_partkey")


@query(
    """WITH s AS (SELECT a.vec_id AS source_id, b.label AS target_id, max(round(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6)) AS score
      FROM embeddings a JOIN embeddings b ON a.label <> b.label WHERE a.vec_id % 50 = 0 GROUP BY ALL)
    SELECT source_id, target_id, score, CASE WHEN score >= least(0.99, 0.25 + 0.05) THEN 'accepted' ELSE 'pending' END AS status FROM s WHERE score >= 0.25
    QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY score DESC, target_id) <= 10"""
)
def link_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    best = V.best_by_label(vectors, vectors.filter("vec_id % 50 = 0"), 0.25, "vec_id", "label", "embedding")  # a stated query set against all rows
    scores = best.select(F.col("query_id").alias("source_id"), F.col("label").alias("target_id"), F.round("score", 6).alias("score"))
    return G.infer_links(scores, 0.25).select("source_id", "target_id", "score", "status")


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS accepted, count(*) FILTER (o_orderstatus = 'O') AS pending, count(*) FILTER (o_orderstatus = 'P') AS rejected FROM orders GROUP BY o_orderpriority")
def status_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)
    return counts.select("o_orderpriority", F.col("F").alias("accepted"), F.col("O").alias("pending"), F.col("P").alias("rejected"))


@query(
    """WITH m AS (SELECT date_trunc('month', max(o_orderdate)) AS last FROM orders),
    s AS (SELECT unnest(generate_series(last::TIMESTAMP - INTERVAL 5 MONTH, last::TIMESTAMP, INTERVAL 1 MONTH)) AS month FROM m)
    SELECT strftime(month, '%Y-%m') AS month, count(o_orderkey) AS n FROM s LEFT JOIN orders ON date_trunc('month', o_orderdate) = month GROUP BY month"""
)
def monthly_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.trunc(F.col("o_orderdate").cast("date"), "MM")
    counts = table(spark, sf_dir, "orders").groupBy(month.alias("m")).agg(F.count(F.lit(1)).alias("n"))
    six = counts.agg(F.max("m").alias("last")).select(F.explode(F.expr("sequence(add_months(last, -5), last, interval 1 month)")).alias("m"))
    return six.join(counts, "m", "left").select(F.date_format("m", "yyyy-MM").alias("month"), F.coalesce("n", F.lit(0)).alias("n"))


_CAUSES = {"metal": ["ring", "gear", "bolt"], "colour": ["red", "blue", "green"], "size": ["small", "large"], "trade": ["promo", "economy"]}


@query(" UNION ALL ".join(f"SELECT '{k}' AS bucket, count(*) FILTER ({' OR '.join(f"contains(lower(p_name || ' ' || p_type), '{w}')" for w in words)}) AS n FROM part" for k, words in _CAUSES.items()))
def cause_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping keyword buckets, all counted in one pass."""
    text = F.lower(F.concat_ws(" ", "p_name", "p_type"))
    held = lambda words: sum((text.contains(w).cast("int") for w in words), F.lit(0)) > 0
    totals = table(spark, sf_dir, "part").agg(*[F.count_if(held(words)).alias(k) for k, words in _CAUSES.items()])
    return totals.unpivot([], list(_CAUSES), "bucket", "n")


@query("SELECT o_custkey, CAST(coalesce(max(try_cast(string_split(o_orderpriority, '-')[1] AS INT)), 0) + 1 AS BIGINT) AS next_version FROM orders GROUP BY o_custkey")
def next_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.split_part(F.col("o_orderpriority"), F.lit("-"), F.lit(1)).try_cast("int")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg((F.coalesce(F.max(number), F.lit(0)) + 1).cast("long").alias("next_version"))


@query("SELECT user_id, event_type, min(event_id) AS first_pos, arg_max(value, event_id) AS last_value FROM events GROUP BY ALL")
def dedup_first_pos_last_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_pos"), F.max_by("value", "event_id").alias("last_value"))


@query("SELECT DISTINCT p_brand, p_type, upper(p_brand || '/' || p_type) AS ref FROM part")
def distinct_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_brand", "p_type").distinct().withColumn("ref", F.upper(F.concat_ws("/", "p_brand", "p_type")))


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 50 OFFSET 100")
def page_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page 3 of size 50, ordered by key."""
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").orderBy("c_custkey").offset(100).limit(50)


@query("SELECT o_orderkey, o_orderstatus, o_orderdate FROM orders ORDER BY CASE WHEN o_orderstatus IN ('O', 'P') THEN 0 ELSE 1 END, o_orderdate DESC, o_orderkey LIMIT 6")
def open_first_top6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    return rows.orderBy(F.when(F.col("o_orderstatus").isin("O", "P"), 0).otherwise(1), F.desc("o_orderdate"), "o_orderkey").limit(6)


@query("SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn // 2, CASE WHEN role = 'user' THEN 0 ELSE 1 END, turn) AS pos FROM conversations")
def message_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy(F.floor(F.col("turn") / 2), F.when(F.col("role") == "user", 0).otherwise(1), "turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.row_number().over(w).alias("pos"))


@query("SELECT conv_id, turn, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6")
def last_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.top_k(table(spark, sf_dir, "conversations"), 6, ["conv_id"], [F.desc("turn")]).select("conv_id", "turn", "text")


@query(
    """WITH e AS (SELECT event_id, user_id, event_type, lag(event_type) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    d AS (SELECT *, coalesce(before = event_type, FALSE) AS dup FROM e JOIN events USING (event_id, user_id, event_type)),
    l AS (SELECT *, count(*) FILTER (NOT dup) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM d)
    SELECT event_id, user_id, CASE WHEN dup THEN 'deduplicated' WHEN later > 0 THEN 'cancelled' ELSE 'pending' END AS action FROM l"""
)
def enqueue_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.enqueue(table(spark, sf_dir, "events"), "user_id", "event_type", [F.col("ts"), F.col("event_id")]).select("event_id", "user_id", "action")


@query("SELECT user_id, event_type AS state, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_job_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """max_by over a struct: partial results on the map side, no sort of each key's history."""
    newest = F.max(F.struct("ts", "event_id", F.col("event_type").alias("state"))).alias("m")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(newest).select("user_id", "m.state", "m.event_id")


@query(
    """WITH e AS (SELECT user_id, ts, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
    c AS (SELECT * FROM e WHERE before IS NULL OR before <> event_type)
    SELECT user_id, event_type, ts AS valid_from, lead(ts) OVER w AS valid_to, lead(ts) OVER w IS NULL AS is_active FROM c WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""
)
def scd2_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.scd2(table(spark, sf_dir, "events"), "user_id", "event_type", "ts", "event_id").select("user_id", "event_type", "valid_from", "valid_to", "is_active")


@query("SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id AND l.quality = CASE WHEN documents.n_chars >= 1000 THEN 1 ELSE 0 END)")
def unchanged_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose digest (here whether they have 1000 characters) isn't the indexed one (quality)."""
    current = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") >= 1000).cast("int").alias("digest"))
    indexed = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("digest"))
    return I.changed(current, indexed, ["doc_id"], "digest").select("doc_id")


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY ALL")
def json_path_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, sf_dir, "events").groupBy("event_type", k.alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT 'union' AS op, key FROM (SELECT c_nationkey AS key FROM customer UNION SELECT s_nationkey FROM supplier)
    UNION ALL SELECT 'intersect', key FROM (SELECT c_custkey AS key FROM customer INTERSECT SELECT o_custkey FROM orders)
    UNION ALL SELECT 'except', key FROM (SELECT c_custkey AS key FROM customer EXCEPT SELECT o_custkey FROM orders)"""
)
def set_ops_union_except_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("key")).union(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long"))).distinct()
    customers, ordered = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")), table(spark, sf_dir, "orders").select("o_custkey")
    named = lambda op, df: df.select(F.lit(op).alias("op"), "key")
    return union_all([named("union", nations), named("intersect", customers.intersect(ordered)), named("except", customers.subtract(ordered))])


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return events.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


@query(
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM e)
    SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, session"""
)
def event_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("user_id", F.col("w.start").alias("session_start"), "n")


@query(
    """WITH e AS (SELECT event_id, user_id, event_type, ts, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS step FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    r AS (SELECT *, sum(step) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM e)
    SELECT user_id, CAST(run AS BIGINT) AS run, any_value(event_type) AS event_type, count(*) AS n FROM r GROUP BY user_id, run"""
)
def consecutive_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.runs(table(spark, sf_dir, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], "event_type")
    return rows.groupBy("user_id", "run").agg(F.first("event_type").alias("event_type"), F.count(F.lit(1)).alias("n"))


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
    h AS (SELECT *, max(CASE WHEN length(line) BETWEEN 1 AND 40 THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS head FROM l)
    SELECT doc_id, coalesce(head, 0) AS head_line, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM h GROUP BY doc_id, head"""
)
def sections_forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines belong to the last heading-like line before them (here: 1 to 40 characters)."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    head = F.when(F.length("line").between(1, 40), F.col("i") + 1)
    w = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("head_line", F.coalesce(F.last(head, ignorenulls=True).over(w), F.lit(0)))
    return rows.groupBy("doc_id", "head_line").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))
