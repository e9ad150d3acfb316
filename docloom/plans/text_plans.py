"""Text features of documents, conversations and pages, row by row or per document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import nlp as N
from docloom.functions import text as X
from docloom.plans.registry import query
from docloom.session import table

_TERMS = "list_filter(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '')"
_WORDS = "list_distinct(regexp_extract_all(lower({c}), '[a-z0-9]{{3,}}'))"


@query(f"SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_TERMS}) AS term FROM documents) GROUP BY term")
def term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.operators.search import term_frequencies

    # per document first: then both counts are plain sums
    return term_frequencies(table(spark, sf_dir, "documents")).groupBy("term").agg(F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("df"))


@query(
    """WITH t AS (SELECT list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: length(x) > 2) AS w FROM documents),
    g AS (SELECT array_to_string(w[i:i + k - 1], ' ') AS phrase, k AS words FROM (SELECT w, k, unnest(range(1, len(w) - k + 2)) AS i FROM t, (VALUES (2), (3)) v(k)))
    SELECT phrase, CAST(words AS INT) AS words, count(*) AS n FROM g GROUP BY phrase, words HAVING count(*) >= 2"""
)
def ngram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of two and of three words found twice or more."""
    from docloom.operators.ngrams import phrase_counts

    return phrase_counts(table(spark, sf_dir, "documents"))


@query(f"SELECT doc_id, CAST(ceil(len({_TERMS}) / 0.75) AS BIGINT) AS tokens FROM documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


@query("SELECT doc_id, sha256(concat_ws(chr(10) || chr(10), source, lang, text)) AS content_sha256 FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.content_hash(F.array("source", "lang", "text")).alias("content_sha256"))


@query(
    """WITH h AS (SELECT doc_id, md5(doc_id || '_chunk_0') AS m FROM documents)
    SELECT doc_id, substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21, 12) AS chunk_id FROM h"""
)
def chunk_uuid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.chunk_uuid(F.col("doc_id"), F.lit(0)).alias("chunk_id"))


@query("SELECT p_partkey, CAST(CAST('0x' || md5(p_name) AS UHUGEINT) % 2147483647 AS BIGINT) AS sparse_index FROM part")
def hash_modulo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", X.hash_modulo(F.col("p_name"), 2**31 - 1).alias("sparse_index"))


@query("SELECT o_orderkey, 'CAPA-EMB-' || upper(substr(sha1(o_custkey || ':CAPA:' || o_orderpriority), 1, 10)) AS ref FROM orders")
def synthetic_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", X.synthetic_ref("CAPA", F.col("o_custkey").cast("string"), F.col("o_orderpriority")).alias("ref"))


@query(
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS from_day_first, strftime(o_orderdate, '%Y-%m-%d') AS from_iso, strftime(o_orderdate, '%Y-%m-%d') AS from_name FROM orders"""
)
def date_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    written = {"from_day_first": F.date_format(d, "d.M.yyyy"), "from_iso": F.date_format(d, "yyyy-MM-dd"), "from_name": F.date_format(d, "d MMMM yyyy")}
    return table(spark, sf_dir, "orders").select("o_orderkey", *[X.normalize_date(c).alias(k) for k, c in written.items()])


@query(
    r"""WITH a AS (SELECT page_id, regexp_replace(html, '<(script|style)\b.*?</(script|style)>', ' ', 'gis') AS t FROM pages),
    b AS (SELECT page_id, regexp_replace(regexp_replace(t, '<br\s*/?>|</(?:p|li|div|h[1-6]|tr)>', chr(10), 'gi'), '<[^>]+>', '', 'gs') AS t FROM a),
    c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS t FROM b)
    SELECT page_id, md5(trim(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), '\n\s*\n+', chr(10), 'g'), ' ')) AS text_md5 FROM c"""
)
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(X.html_to_text(F.col("html"))).alias("text_md5"))


def _light_sql(words: list[str]) -> str:
    return " + ".join(f"len(regexp_extract_all(' ' || regexp_replace(lower(text), '[^a-zäöüß]+', '  ', 'g') || ' ', ' {w} '))" for w in words)


@query(f"WITH h AS (SELECT doc_id, {_light_sql(N.GERMAN)} AS de, {_light_sql(N.ENGLISH)} AS en FROM documents) SELECT doc_id, CAST(de AS BIGINT) AS de_hits, CAST(en AS BIGINT) AS en_hits, CASE WHEN de >= 3 AND en >= 3 THEN 'bilingual' WHEN de > en THEN 'de' ELSE 'en' END AS language FROM h")
def language_light(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", *N.language_light(F.col("text")))


@query(
    """SELECT doc_id, round(len(regexp_extract_all(text, '[A-Za-z]')) / greatest(length(text), 1), 6) AS latin_ratio,
    round(len(regexp_extract_all(text, '[äöüßÄÖÜ]')) / greatest(length(text), 1), 6) AS german_ratio,
    round(len(regexp_extract_all(text, '[0-9]')) / greatest(length(text), 1), 6) AS digit_ratio FROM documents"""
)
def script_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", *N.script_ratios(F.col("text")))


@query(
    """WITH s AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])[ \t]+', '\\1' || chr(10), 'g'), chr(10)), lambda x: len(string_split(trim(regexp_replace(x, '\\s+', ' ', 'g')), ' ')) >= 3) AS s FROM documents)
    SELECT doc_id, CAST(len(s) AS BIGINT) AS n_sentences FROM s""".replace("\\\\", "\\")
)
def style_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(X.sentences(F.col("text"))).cast("long").alias("n_sentences"))


@query(N.bank_sql())
def bank_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.classify_banks(table(spark, sf_dir, "documents"), N.BANKS)


@query(
    """WITH b AS (SELECT doc_id, trim(regexp_extract(text, '^[^\n]*')) AS head, text FROM documents),
    g AS (SELECT doc_id, (length(text) < 200)::INT AS short, (NOT regexp_matches(text, '[0-9]'))::INT AS no_number, (length(head) > 160)::INT AS long_head, (NOT contains(text, chr(10)))::INT AS one_line FROM b)
    SELECT doc_id, CAST(least(100, round(short * 9 * 0.9 + no_number * 5 * 0.7 + long_head * 2 * 0.6 + one_line * 12 * 0.8)) AS BIGINT) AS risk_score,
    CAST(short + no_number + long_head + one_line AS BIGINT) AS n_gaps FROM g"""
)
def gap_risk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    head = F.trim(F.regexp_extract(t, r"^[^\n]*", 0))
    gaps = [
        N.gap(F.length(t) < 200, "short_text", "high", 0.9),
        N.gap(~t.rlike("[0-9]"), "no_number", "medium", 0.7),
        N.gap(F.length(head) > 160, "long_title", "low", 0.6),
        N.gap(~t.contains("\n"), "one_line", "critical", 0.8),
    ]
    rows = table(spark, sf_dir, "documents").select("doc_id", F.array_compact(F.array(*gaps)).alias("gaps"))
    return rows.select("doc_id", N.risk_score(F.col("gaps")).alias("risk_score"), F.size("gaps").cast("long").alias("n_gaps"))


@query(
    f"""WITH u AS (SELECT conv_id, turn, {_WORDS.format(c='text')} AS w, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations WHERE role = 'user'),
    o AS (SELECT a.conv_id, a.turn, CASE WHEN b.w IS NULL OR greatest(len(a.w), len(b.w)) = 0 THEN 0 ELSE len(list_intersect(a.w, b.w)) / greatest(len(a.w), len(b.w)) END AS v
          FROM u a LEFT JOIN u b ON a.conv_id = b.conv_id AND b.r BETWEEN a.r - 3 AND a.r - 1)
    SELECT conv_id, turn, round(max(v), 6) AS overlap FROM o GROUP BY conv_id, turn"""
)
def repetition_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greatest word overlap of a user's turn with one of the three before it."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", X.word_set(F.col("text")).alias("w"))
    before = F.collect_list("w").over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-3, -1))
    most = lambda b: F.greatest(F.size("w"), F.size(b))
    overlaps = F.transform("before", lambda b: F.when(most(b) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect("w", b)) / most(b)))
    return rows.withColumn("before", before).select("conv_id", "turn", F.round(F.coalesce(F.array_max(overlaps), F.lit(0.0)), 6).alias("overlap"))


@query(
    f"""WITH b AS (SELECT item_id, {_WORDS.format(c='text')} AS w FROM benchmark), d AS (SELECT doc_id, {_WORDS.format(c='text')} AS w FROM documents),
    s AS (SELECT item_id, doc_id, len(list_intersect(b.w, d.w)) AS c, len(b.w) AS nb, len(d.w) AS nd FROM b, d WHERE len(b.w) > 0)
    SELECT item_id, doc_id, round(c / (nb + nd - c), 6) AS jaccard FROM s WHERE 10 * c >= 4 * (nb + nd - c)"""
)
def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items and documents whose word sets have a Jaccard similarity of 0.4 or more.

    Prefix filter: with both sets in one order, rarest words first, similar sets share a word of their first
    n - ceil(0.4 n) + 1; so common words are never joined on.
    """
    from docloom.operators.search import similar_sets

    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("a"), X.word_set(F.col("text")).alias("w"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("b"), X.word_set(F.col("text")).alias("w"))
    found = similar_sets(items, docs, 40)
    return found.select(F.col("a").alias("item_id"), F.col("b").alias("doc_id"), F.round("jaccard", 6).alias("jaccard"))


@query("SELECT a.n_name AS name, b.n_name AS other, CAST(levenshtein(a.n_name, b.n_name) AS BIGINT) AS distance FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND abs(length(a.n_name) - length(b.n_name)) <= 2 AND levenshtein(a.n_name, b.n_name) <= 2")
def levenshtein_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fuzzy name match within a dimension table of fixed size (25 nations)."""
    n = table(spark, sf_dir, "nation")
    a, b = n.select(F.col("n_nationkey").alias("ka"), F.col("n_name").alias("name")), n.select(F.col("n_nationkey").alias("kb"), F.col("n_name").alias("other"))
    near = (F.col("ka") < F.col("kb")) & (F.abs(F.length("name") - F.length("other")) <= 2)
    distance = F.levenshtein("name", "other")
    return a.join(F.broadcast(b), near & (distance <= 2)).select("name", "other", distance.cast("long").alias("distance"))


#: Named licences stand in for named standards: the test texts hold these.
STANDARDS = {"apache": "Apache License", "gpl": "GNU General Public License", "cc": "CC BY(?:-NC)?(?:-SA)? [0-9.]+", "mit": "MIT License"}


@query(
    " UNION ALL ".join(
        f"SELECT doc_id, '{k}' AS standard, CAST(len(regexp_extract_all(text, '{p}')) AS INT) AS hits, round(0.9::DOUBLE + least(0.07::DOUBLE, 0.02::DOUBLE * len(regexp_extract_all(text, '{p}'))), 3) AS confidence FROM documents WHERE regexp_matches(text, '{p}')"
        for k, p in STANDARDS.items()
    )
)
def regulatory_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.patterns_held(table(spark, sf_dir, "documents"), STANDARDS)


@query(
    """WITH c AS (SELECT doc_id, len(string_split(text, chr(10))) AS lines, len(regexp_extract_all(text, '[0-9]+')) AS numbers, len(regexp_extract_all(text, '@')) AS contacts, len(regexp_extract_all(text, '[|]')) AS bars FROM documents),
    s AS (SELECT doc_id, CAST(least(100, 10 * least(lines, 4) + 4 * least(numbers, 5) + 5 * least(contacts, 4) + 4 * least(bars, 5)) AS BIGINT) AS score FROM c)
    SELECT doc_id, score, CASE WHEN score >= 80 THEN 'A' WHEN score >= 65 THEN 'B' WHEN score >= 50 THEN 'C' ELSE 'D' END AS grade FROM s"""
)
def compliance_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    counts = {"lines": F.size(F.split(t, "\n")), "numbers": F.regexp_count(t, F.lit("[0-9]+")), "contacts": F.regexp_count(t, F.lit("@")), "bars": F.regexp_count(t, F.lit("[|]"))}
    score = N.capped_score(counts, {"lines": (10, 4), "numbers": (4, 5), "contacts": (5, 4), "bars": (4, 5)})
    return table(spark, sf_dir, "documents").select("doc_id", score.alias("score")).withColumn("grade", N.grade(F.col("score")))


#: Function words stand in for the words of a flow's stages.
FLOWS = {"english": (["the", "and", "with", "from"], ["the", "and"], ["with"]), "german": (["der", "und", "nicht", "mit"], ["der", "und"], ["nicht"])}


def _flow_sql(name: str, stages: list[str], core: list[str], required: list[str]) -> str:
    held = lambda s: f"contains(text, '{s}')::INT"
    total = lambda names: "(" + " + ".join(map(held, names)) + ")"
    n = total(stages)
    raw = f"0.18::DOUBLE + 0.36::DOUBLE * ({n} / {len(stages)}) + 0.34::DOUBLE * ({total(core)} / {len(core)}) + 0.10::DOUBLE * ({n} >= 2)::INT + 0.12::DOUBLE * ({total(required)} = {len(required)})::INT"
    return f"SELECT doc_id, '{name}' AS flow, round(CASE WHEN {n} > 0 THEN greatest(0, least(1, {raw})) ELSE 0 END, 6) AS score FROM documents"


@query("SELECT * FROM (" + " UNION ALL ".join(_flow_sql(k, *v) for k, v in FLOWS.items()) + ") WHERE score >= 0.55")
def workflow_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = F.array(*[F.struct(F.lit(k).alias("flow"), F.round(N.workflow(F.col("text"), *v), 6).alias("score")) for k, v in FLOWS.items()])
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.filter(scored, lambda x: x["score"] >= 0.55)).alias("f"))
    return rows.select("doc_id", "f.flow", "f.score")


@query("SELECT conv_id, string_agg(DISTINCT role, ',' ORDER BY role) AS roles, count(*) AS turns FROM conversations GROUP BY conv_id")
def raci_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_set("role")).alias("r"), F.count(F.lit(1)).alias("turns"))
    return rows.select("conv_id", F.array_join("r", ",").alias("roles"), "turns")


@query(
    """SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines, CAST(len(regexp_extract_all(text, '[A-ZÄÖÜÉÈÀÑ]')) AS BIGINT) AS capitals,
    CAST(len(regexp_extract_all(text, '[,;:]')) AS BIGINT) AS pauses, round(len(regexp_extract_all(text, '[!?]')) / greatest(length(text), 1), 6) AS emphasis FROM documents"""
)
def style_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    count = lambda p: F.regexp_count(t, F.lit(p)).cast("long")
    emphasis = F.round(count("[!?]") / F.greatest(F.length(t), F.lit(1)), 6)
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.split(t, "\n")).cast("long").alias("n_lines"), count("[A-ZÄÖÜÉÈÀÑ]").alias("capitals"), count("[,;:]").alias("pauses"), emphasis.alias("emphasis"))
