"""Ranking: BM25, vector search, fusion, caps and context packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import dot, space_terms
from docloom.session import written


def term_frequencies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(id, term, tf, dl): exploded and summed before the shuffle; keep restricts the terms, not dl."""
    rows = docs.select(F.col(id_col).alias("id"), space_terms(F.col(text_col)).alias("terms")).select("id", F.size("terms").alias("dl"), F.explode("terms").alias("term"))
    if keep is not None:
        rows = rows.filter(F.col("term").isin(keep))
    return rows.groupBy("id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25(docs: DataFrame, queries: dict[str, str], id_col: str = "doc_id", text_col: str = "text", k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """Okapi BM25 of every matching document for each query: (query, id, score).

    Terms whose idf is negative get epsilon times the mean idf of the corpus; a term counts
    as often as the query has it. The corpus is read twice: once for document frequencies, counted on the
    map side over each document's distinct terms (an empty term carries the corpus's size and length), and once for
    the frequencies of the queries' own terms; only those postings are shuffled.
    """
    terms = space_terms(F.col(text_col))
    # explode_outer: for explode Spark would add a filter that splits each text once more
    split = docs.select(F.array_distinct(terms).alias("t"), F.size(terms).alias("dl"))
    rows = split.select(F.explode_outer(F.concat(F.array(F.lit("")), "t")).alias("term"), "dl")
    df = written(rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum(F.when(F.col("term") == "", F.col("dl"))).alias("words")), "document-frequencies")
    sizes = df.filter("term = ''").select(F.col("df").alias("n_docs"), (F.col("words") / F.col("df")).alias("avgdl"))
    df = df.filter("term <> ''").crossJoin(F.broadcast(sizes))  # one row of totals
    df = df.withColumn("raw_idf", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = df.agg(F.avg("raw_idf").alias("mean_idf"))
    spark = docs.sparkSession
    asked = spark.createDataFrame([(q, t, n) for q, text in queries.items() for t, n in _counts(text).items()], "query string, term string, qn int")
    wanted = sorted({t for text in queries.values() for t in _counts(text)})
    idf = df.filter(F.col("term").isin(wanted)).crossJoin(F.broadcast(mean))
    idf = idf.withColumn("idf", F.when(F.col("raw_idf") < 0, epsilon * F.col("mean_idf")).otherwise(F.col("raw_idf")))
    idf = idf.select("term", "idf", "avgdl").join(asked, "term")
    split = docs.select(F.col(id_col).alias("id"), terms.alias("t"), F.size(terms).alias("dl"))
    ours = split.select("id", "dl", F.explode_outer("t").alias("term")).filter(F.col("term").isin(wanted))
    hits = ours.groupBy("id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    hits = hits.join(F.broadcast(idf), "term")  # as many rows as the queries have terms
    part = F.col("qn") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return hits.groupBy("query", "id").agg(F.sum(part).alias("score"))


def padded_top_k(scored: DataFrame, docs: DataFrame, queries: dict[str, str], k: int, id_col: str = "doc_id") -> DataFrame:
    """The k best of each query; where fewer match, documents of score 0 follow, the greatest ids first."""
    best = top_k(scored, k, ["query"], [F.desc("score"), F.desc("id")]).drop("rank")
    # at most k matches a query: of the k + k greatest ids at least k don't match
    last = docs.select(F.col(id_col).alias("id")).distinct().orderBy(F.desc("id")).limit(2 * k)
    names = docs.sparkSession.createDataFrame([(q,) for q in queries], "query string")
    pad = last.join(F.broadcast(names)).join(best.select("query", "id"), ["query", "id"], "left_anti").select("query", "id", F.lit(0.0).alias("score"))
    return top_k(best.unionByName(pad), k, ["query"], [F.desc("score"), F.desc("id")])


def _counts(text: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for t in text.lower().split():
        out[t] = out.get(t, 0) + 1
    return out


def top_k(scored: DataFrame, k: int, by: list[str], order: list[Column]) -> DataFrame:
    """The first k rows of each key, with rank; Spark keeps k rows per task before the shuffle."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)


def vector_scores(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, vector) of a bounded query set against (id, vector): every score.

    Without a hint Spark broadcasts a query set below its threshold, and else pairs the blocks (partitions) of
    both sides, a task each; the top k that follows is cut in each task before the shuffle.
    """
    return corpus.join(queries.select("query_id", F.col("vector").alias("query_vector"))).select("query_id", "id", dot(F.col("query_vector"), F.col("vector")).alias("score"))


def min_max(score: Column, by: Column) -> Column:
    """Scores of a result list scaled to 0 to 1; a flat list is all 1."""
    low, high = F.min(score).over(Window.partitionBy(by)), F.max(score).over(Window.partitionBy(by))
    return F.when(high - low < 1e-9, F.lit(1.0)).otherwise((score - low) / (high - low))


def fuse(dense: DataFrame, lexical: DataFrame, weight: float = 0.7) -> DataFrame:
    """Two lists (query, id, score) by normalised, weighted scores; a missing side counts 0."""
    d = dense.select("query", "id", min_max(F.col("score"), F.col("query")).alias("dense"))
    x = lexical.select("query", "id", min_max(F.col("score"), F.col("query")).alias("lexical"))
    both = d.join(x, ["query", "id"], "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return both.select("query", "id", (weight * zero("dense") + (1 - weight) * zero("lexical")).alias("score"))


def cap_per_source(ranked: DataFrame, per_source: int, limit: int, source: str, order: list[Column], by: list[str]) -> DataFrame:
    """At most per_source rows of a source and limit rows of a list, in order."""
    one = F.row_number().over(Window.partitionBy(*by, source).orderBy(*order))
    kept = ranked.withColumn("source_rank", one).filter(F.col("source_rank") <= per_source)
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= limit)


def pack_context(rows: DataFrame, budget: int, by: list[str], order: list[Column], text: str, skip_blank: bool) -> DataFrame:
    """The rows whose texts fit a budget of characters, up to the first that does not.

    A blank text ends the context, or is passed over with skip_blank; a null text is neither and takes no room.
    Each text but null ones has a character or more where blanks end it, so the budget can't hold more than
    budget + 1 of them: the rest is cut task by task before any list is gathered, and lists carry lengths only.
    """
    blank = F.coalesce(F.trim(F.col(text)) == "", F.lit(False))
    rows = rows.withColumn("__blank", blank).withColumn("__n", F.length(text))
    rows = rows.filter(~F.col("__blank")) if skip_blank else rows
    one = Window.partitionBy(*by).orderBy(*order)
    sized = rows.filter(F.col("__n").isNotNull()).withColumn("__at", F.row_number().over(one)).filter(F.col("__at") <= budget + 2).drop("__at")
    none = rows.filter(F.col("__n").isNull())
    run = one.rowsBetween(Window.unboundedPreceding, 0)
    first = sized.unionByName(none).withColumn("used", F.sum("__n").over(run))
    first = first.withColumn("__bad", F.max((F.col("__blank") | (F.col("used") > budget)).cast("int")).over(run))
    # no row after the last one that was looked at
    return first.filter("__bad = 0 or __bad is null").drop("__bad", "__blank", "__n")


def similar_sets(left: DataFrame, right: DataFrame, percent: int) -> DataFrame:
    """(a, w) and (b, w), w arrays of distinct words -> (a, b, jaccard) of pairs with percent or more.

    Sets are put in one order, rarest words first (by left and right counts, then by word); two similar sets share a
    word of their prefixes of n - ceil(percent n) + 1 words. Candidates are compared by their whole sets.
    A right set that is too small or too large for any left one can't be similar to it, as the smaller of two sets has at
    least percent of the greater one's words: it goes before its words become rows.
    """
    size = F.size("w")
    bounds = left.filter(size > 0).agg(F.min(size).alias("least"), F.max(size).alias("most"))
    fits = (100 * size >= percent * F.col("least")) & (percent * size <= 100 * F.col("most"))
    right = written(right.join(F.broadcast(bounds), fits).select("b", "w"), "near-sets")  # one row of bounds
    words = left.select(F.explode("w").alias("word")).unionAll(right.select(F.explode("w").alias("word")))
    counts = written(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "word-counts")

    def prefix(rows: DataFrame, key: str) -> DataFrame:
        ranked = rows.select(key, F.explode("w").alias("word")).join(counts, "word").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("o"))
        keep = F.size("o") - F.ceil(F.size("o") * percent / 100) + 1
        return ranked.select(key, F.explode(F.slice("o", 1, keep.cast("int"))).alias("x")).select(key, "x.word")

    pairs = prefix(left, "a").join(prefix(right, "b"), "word").select("a", "b").distinct()
    both = pairs.join(left.withColumnRenamed("w", "wa"), "a").join(right.withColumnRenamed("w", "wb"), "b")
    common = F.size(F.array_intersect("wa", "wb"))
    both = both.select("a", "b", common.alias("common"), (F.size("wa") + F.size("wb") - common).alias("union"))
    return both.filter(100 * F.col("common") >= percent * F.col("union")).select("a", "b", (F.col("common") / F.col("union")).alias("jaccard"))
