"""Queries that match texts, versions, messages and vectors with each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import contain as C
from docloom.operators import vectors as I
from docloom.operators import versions as V
from docloom.plans.registry import query
from docloom.session import table

_CLEAN = "trim(regexp_replace(lower({c}), '\\s+', ' ', 'g'))"
_PAIRS = f"""s AS (SELECT row_number() OVER () AS rid, item_id, {_CLEAN.format(c="coalesce(text, '')")} AS c FROM benchmark),
t AS (SELECT doc_id, lower(coalesce(text, '')) AS l, {_CLEAN.format(c="coalesce(text, '')")} AS c FROM documents),
e AS (SELECT rid, item_id, doc_id, CASE WHEN contains(t.c, s.c) THEN 'in text' ELSE 'holds text' END AS how FROM s, t WHERE s.c <> '' AND (contains(t.c, s.c) OR (t.c <> '' AND contains(s.c, t.c)))),
p AS (SELECT rid, item_id, doc_id, 'probe' AS how FROM s, t WHERE rid NOT IN (SELECT rid FROM e) AND len(string_split(s.c, ' ')) > 5 AND contains(l, array_to_string(string_split(s.c, ' ')[1:5], ' '))),
m AS (SELECT * FROM e UNION ALL SELECT * FROM p)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.containment(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), "item_id", "doc_id")


@query(f"WITH {_PAIRS} SELECT item_id, doc_id, how FROM m")
def snippet_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item against all documents: held, holding, or found by its first five words."""
    return _pairs(spark, sf_dir).select(F.col("snippet_id").alias("item_id"), F.col("text_id").alias("doc_id"), "how")


@query(f"WITH {_PAIRS} SELECT item_id, min(struct_pack(doc_id := doc_id, how := how)).doc_id AS doc_id, min(struct_pack(doc_id := doc_id, how := how)).how AS how FROM m GROUP BY item_id")
def snippet_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each benchmark item."""
    return C.first_match(_pairs(spark, sf_dir)).select(F.col("snippet_id").alias("item_id"), F.col("text_id").alias("doc_id"), "how")


@query(
    """WITH r AS (SELECT l_orderkey, list(struct_pack(ref := l_partkey || '-' || l_suppkey, title := CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE 'part ' || l_partkey END, status := l_linestatus, score := l_discount) ORDER BY l_linenumber, l_partkey || '-' || l_suppkey, l_linestatus, l_discount) AS raw,
      list(struct_pack(ref := CAST(l_partkey % 100 AS VARCHAR), title := 'on part ' || l_partkey) ORDER BY l_linenumber, CAST(l_partkey % 100 AS VARCHAR), 'on part ' || l_partkey) AS cited FROM lineitem GROUP BY l_orderkey),
    c AS (SELECT l_orderkey, raw, unnest(cited) AS c, generate_subscripts(cited, 1) AS pos, list_position(list_transform(cited, lambda x: x.ref), unnest(cited).ref) AS first FROM r),
    m AS (SELECT l_orderkey, pos, c.ref AS ref, list_filter(raw, lambda x: contains(x.ref, c.ref) OR (x.title <> '' AND contains(c.title, x.title)))[1] AS m FROM c WHERE pos = first)
    SELECT l_orderkey, ref, coalesce(m.status, '') AS status, coalesce(m.score, 0) AS score FROM m"""
)
def citation_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations with the status of the first raw one that fits, once per ref (E15); an order's lines stand for an answer's citations."""
    part, even = F.col("l_partkey").cast("string"), F.col("l_linenumber") % 2 == 0
    raw = F.struct("l_linenumber", F.concat(part, F.lit("-"), "l_suppkey").alias("ref"), F.when(even, "").otherwise(F.concat(F.lit("part "), part)).alias("title"), F.col("l_linestatus").alias("status"), F.col("l_discount").alias("score"))
    cited = F.struct("l_linenumber", (F.col("l_partkey") % 100).cast("string").alias("ref"), F.concat(F.lit("on part "), part).alias("title"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(raw)).alias("raw"), F.array_sort(F.collect_list(cited)).alias("cited"))
    return rows.select("l_orderkey", F.explode(C.enriched(F.col("cited"), F.col("raw"))).alias("c")).select("l_orderkey", "c.ref", "c.status", "c.score")


#: Section labels that messages are matched with.
LABELS = ["1. License and terms", "Contact", "The author", "Données personnelles", "Zweck", "Results of it"]
_LABELS = "[" + ", ".join(f"'{x}'" for x in LABELS) + "]"
#: DuckDB's levenshtein counts bytes: letters of two bytes are put as capitals, which normal text hasn't, so that it counts letters.
_LETTERS = "translate({c}, 'äöüßéèêëàâçñíóúáîïôûùœæìòÿ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"
_NORMAL = "trim(regexp_replace(regexp_replace(lower({c}), '^\\s*\\d+(?:\\.\\d+)*[.)\\]:-]?\\s*', ''), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


@query(
    f"""WITH m AS (SELECT row_number() OVER () AS rid, conv_id, turn, {_LETTERS.format(c=_NORMAL.format(c="coalesce(text, '')"))} AS t FROM conversations WHERE role = 'user'),
    l AS (SELECT label, {_LETTERS.format(c=_NORMAL.format(c='label'))} AS n, i FROM (SELECT unnest({_LABELS}) AS label, generate_subscripts({_LABELS}, 1) AS i)),
    h AS (SELECT rid, label, length(n) AS size, i FROM m, l WHERE t <> '' AND n <> '' AND (contains(t, n) OR len(list_filter(list_filter(string_split(n, ' '), lambda x: length(x) > 2),
      lambda x: contains(t, x || ' section') OR contains(t, 'in ' || x) OR len(list_filter(string_split(t, ' '), lambda w: abs(length(w) - length(x)) <= 2 AND levenshtein(w, x) <= 2)) > 0)) > 0)),
    b AS (SELECT rid, arg_min(label, struct_pack(a := -size, i := i)) AS label FROM h GROUP BY rid)
    SELECT conv_id, turn, label FROM m LEFT JOIN b USING (rid)"""
)
def section_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The section that each user's message speaks of."""
    asked = table(spark, sf_dir, "conversations").filter("role = 'user'")
    return asked.select("conv_id", "turn", C.mentioned_section(F.coalesce("text", F.lit("")), F.array(*map(F.lit, LABELS))).alias("label"))


def _edited(text: Column) -> Column:
    """Another version of a text: a word replaced, one taken out, a sentence put at the end."""
    return F.concat(F.regexp_replace(F.regexp_replace(text, r"\b(the|der|los|les)\b", "that"), r"\b(and|und|et|y) ", ""), F.lit(" An added end."))


@query()
def word_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words removed, added and kept between two versions of each document (J30); both versions are rebuilt from the runs."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("old")).withColumn("new", _edited(F.col("old")))
    rows = rows.withColumn("runs", V.word_diff("old", "new"))
    text = lambda *kinds: F.array_join(F.transform(F.filter("runs", lambda r: r["kind"].isin(*kinds)), lambda r: r["text"]), "")
    return rows.select("doc_id", F.size("runs").alias("n_runs"), F.length(text("same")).alias("same"), F.length(text("removed")).alias("removed"), F.length(text("added")).alias("added"), ((text("same", "removed") == F.col("old")) & (text("same", "added") == F.col("new"))).alias("rebuilt"))


@query()
def version_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of two versions of each document matched by id, place and type (E16); every third line has an id."""
    block = lambda line, i: F.struct(F.when(i % 3 == 0, F.concat(F.lit("b"), i)).alias("id"), F.when(F.length(line) < 60, "heading").otherwise("paragraph").alias("type"), line.alias("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), block).alias("old"))
    kept = F.filter("old", lambda b, i: i % 5 != 1)
    changed = F.transform(kept, lambda b, i: F.when(i % 4 == 2, b.withField("text", F.concat(b["text"], F.lit(" revised")))).otherwise(b))
    rows = rows.withColumn("new", F.concat(changed, F.array(F.struct(F.lit(None).cast("string").alias("id"), F.lit("paragraph").alias("type"), F.lit("An added block.").alias("text")))))
    return rows.select("doc_id", F.explode(V.block_matches("old", "new")).alias("m")).select("doc_id", "m.*")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


@query()
def vector_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 50 against all, by the lists that it opens (E12, E13, H4); ``knn_cross_topk`` is the exact way."""
    rows = _vectors(spark, sf_dir)
    centroids = I.fit(rows)
    if centroids is None:
        return I.exact(rows, rows)
    return I.search(I.build(rows, centroids), centroids, rows.filter("id % 50 = 0"))


@query()
def vector_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of the exact ten nearest that the index finds."""
    rows = _vectors(spark, sf_dir)
    return I.recall(vector_index_topk(spark, sf_dir), I.exact(rows, rows.filter("id % 50 = 0"))).withColumn("enough", F.col("recall") >= 0.9)
