"""Benchmark decontamination: a broadcast hash set of test n-grams scanned over training texts.

Any window of ``n`` words holds one full anchor of k = (n + 1) // 2 words that starts
at a multiple of n - k + 1. So documents are hashed at those starts only, the
benchmark at all starts; matching anchors give candidate windows, and each
candidate is verified word by word against the few words around its anchor, which travel
with it. So a document's cost grows with its length and no text is shuffled. All of it is
DataFrame expressions.

Defined cases. Null or wordless texts have no words, no hits and stay. An item
of fewer than ``n`` words, but not none, is one window. Rows are judged by their own
text: repeated rows (null doc_id included) give as many result rows. Items that
share a window are all reported; null item_ids are reported as none. Empty tables
give empty results (documents) or no hits (benchmark). Very long texts are read whole, in one row,
in time in proportion to their length. Other columns pass through
``decontaminate`` untouched, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import ascii_lower, let, quoted, written

#: Words: runs of ASCII letters and digits and of all that is not ASCII, after lower-casing A-Z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Anchor rows of the benchmark that one broadcast may hold (about 60 bytes each);
#: a larger benchmark is scanned in blocks of this size.
BLOCK_ROWS = 1_000_000
ANCHORS = "array<struct<p:int,len:int,h:bigint,from:int,near:array<string>>>"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), "")


def anchor(length: int) -> tuple[int, int]:
    """Words of an anchor and the step between document anchors for windows of a length."""
    size = (length + 1) // 2
    return size, length - size + 1


def doc_anchors(length: int) -> Column:
    """Anchors of a document (words in column w) for windows of one length: start, length, hash, and the
    words of every window that can hold the anchor, from word ``from`` on."""
    size, step = anchor(length)
    starts = F.sequence(F.lit(0), F.size("w") - size, F.lit(step))
    begin = lambda i: F.greatest(i - (length - size), F.lit(0))
    found = F.transform(
        starts,
        lambda i: F.struct(
            i.alias("p"),
            F.lit(length).alias("len"),
            F.xxhash64(F.slice("w", i + 1, size)).alias("h"),
            begin(i).alias("from"),
            F.slice("w", begin(i) + 1, i + length - begin(i)).alias("near"),
        ),
    )
    return F.when(F.size("w") >= length, found).otherwise(F.array().cast(ANCHORS))


def item_windows(benchmark: DataFrame, n: int) -> DataFrame:
    """Distinct windows: window id, words, length and the items that hold them."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - n, F.lit(0)))
    return (
        items.select("item", "w", F.explode(starts).alias("s"))
        .select("item", F.slice("w", F.col("s") + 1, n).alias("window"))
        .groupBy("window")
        .agg(F.collect_set("item").alias("items"))
        .select(F.xxhash64("window").alias("wid"), "window", "items", F.size("window").alias("len"))
    )


def hit_words(hits: Column) -> Column:
    """The sorted places of the words in word intervals, each once."""
    return F.sort_array(F.array_distinct(F.flatten(F.transform(hits, lambda x: F.sequence(x["s"], x["e"] - 1)))))


def spans_of(places: Column) -> Column:
    """Sorted places to maximal intervals, in one pass over neighbours."""
    n = F.size(places)
    before = F.concat(F.array(F.lit(-2)), F.slice(places, 1, F.greatest(n - 1, F.lit(0))))
    after = F.concat(F.slice(places, 2, n), F.array(F.lit(2**31 - 1)))
    starts = F.array_compact(F.zip_with(places, before, lambda a, b: F.when(a - b > 1, a)))
    ends = F.array_compact(F.zip_with(places, after, lambda a, b: F.when(b - a > 1, a + 1)))
    return F.when(n > 0, F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("s"), b.alias("e")))).otherwise(F.array().cast("array<struct<s:int,e:int>>"))


def scan(documents: DataFrame, windows: DataFrame, n: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per document row: doc_id, text_key, n_words, n_hit, spans (merged word intervals), items."""
    lengths = sorted(r[0] for r in windows.select("len").distinct().collect())  # 1 to n: at most n values
    anchors = windows.select("wid", "len", "window", F.explode(F.expr("sequence(0, len - (len + 1) div 2)")).alias("o")).select(
        "wid", "len", "o", F.xxhash64(F.slice("window", F.col("o") + 1, F.expr("(len + 1) div 2"))).alias("h")
    )
    blocks = max(1, math.ceil(anchors.count() / block_rows)) if lengths else 1
    docs = documents.select("doc_id", F.xxhash64("text").alias("text_key"), words_of(F.col("text")).alias("w"))
    # one marker row (p = -1) for each document, so that those without a hit stay
    grams = [F.array(F.struct(F.lit(-1).alias("p"), F.lit(0).alias("len"), F.lit(0).cast("long").alias("h"), F.size("w").alias("from"), F.array().cast("array<string>").alias("near")))]
    grams += [doc_anchors(length) for length in lengths]
    rows = docs.select("doc_id", "text_key", F.explode(F.concat(*grams)).alias("g")).select("doc_id", "text_key", "g.*")
    parts = []
    for block in range(blocks):
        mine = F.pmod("wid", F.lit(blocks)) == block
        found = (
            rows.join(F.broadcast(anchors.filter(mine)), ["h", "len"], "left")
            .filter((F.col("p") < 0) | F.col("wid").isNotNull())
            .select("doc_id", "text_key", "len", "wid", "p", "from", "near", (F.col("p") - F.col("o")).alias("s"))
            .join(F.broadcast(windows.filter(mine).select("wid", "window", "items")), "wid", "left")
        )
        # arrays_equal as a test, not as a join key: the words are compared for candidates only
        at = F.greatest(F.col("s") - F.col("from"), F.lit(0)) + 1
        same = (F.col("s") >= 0) & F.array_contains(F.array(F.slice("near", at, F.col("len"))), F.col("window"))
        parts.append(
            found.filter((F.col("p") < 0) | same).select(
                "doc_id",
                "text_key",
                F.when(F.col("p") < 0, F.col("from")).alias("n_words"),
                F.when(F.col("p") >= 0, F.struct(F.col("s").alias("s"), (F.col("s") + F.col("len")).alias("e"))).alias("hit"),
                "items",
            )
        )
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.unionByName(part)
    return (
        hits.groupBy("doc_id", "text_key")
        .agg(
            F.max("n_words").cast("long").alias("n_words"),
            (F.count("n_words") / blocks).cast("int").alias("copies"),
            F.collect_set("hit").alias("hits"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        )
        .withColumn("places", hit_words(F.col("hits")))
        .select("doc_id", "text_key", "n_words", F.size("places").cast("long").alias("n_hit"), spans_of(F.col("places")).alias("spans"), "items", "copies")
    )


def contamination(documents: DataFrame, benchmark: DataFrame, n: int = 13, min_percent: int = 5, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, spans, items, contaminated.

    contaminated: at least one hit, and hits are ``min_percent`` of the words or more.
    """
    windows = written(item_windows(benchmark, n), "windows")
    found = scan(documents, windows, n, block_rows)
    verdict = (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= min_percent * F.col("n_words"))
    return found.withColumn("contaminated", verdict)


def decontaminate(documents: DataFrame, benchmark: DataFrame, n: int = 13, min_percent: int = 5, remove: str = "documents", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The documents without contaminated ones, or with all hit spans cut out (``remove="spans"``).

    Columns are those of ``documents``; in span mode ``text`` changes where spans were hit
    and ``n_chars``, where there is one, is counted anew.
    """
    found = contamination(documents, benchmark, n, min_percent, block_rows)
    both = F.col("d.doc_id").eqNullSafe(F.col("v.doc_id")) & F.xxhash64("d.text").eqNullSafe(F.col("v.text_key"))
    if remove == "documents":
        bad = written(found.filter("contaminated").select("doc_id", "text_key"), "contaminated")
        return documents.alias("d").join(bad.alias("v"), both, "left_anti")
    if remove != "spans":
        raise ValueError(f"remove is 'documents' or 'spans', not {remove!r}")
    hit = written(found.filter("n_hit > 0").select("doc_id", "text_key", "spans"), "spans")
    joined = documents.alias("d").join(hit.alias("v"), both, "left")
    text = F.when(F.col("v.spans").isNull(), F.col("d.text")).otherwise(cut(F.col("d.text"), F.col("v.spans")))
    kept = [text.alias(c[1:-1]) if c == "`text`" else F.col(f"d.{c}") for c in quoted(documents)]
    out = joined.select(*kept)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def cut(text: Column, spans: Column) -> Column:
    """The text without the words in spans and without the gaps after them: the pieces between spans, joined."""
    pieces = F.regexp_extract_all(text, F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+|[^0-9A-Za-z\x{80}-\x{10FFFF}]+"), F.lit(0))
    first = F.when(text.rlike(r"\A[0-9A-Za-z\x{80}-\x{10FFFF}]"), 0).otherwise(1)  # the index of the first word's piece
    begins = F.concat(F.array(F.lit(0)), F.transform(spans, lambda x: 2 * x["e"] + first))

    def between(p: Column) -> Column:
        ends = F.concat(F.transform(spans, lambda x: 2 * x["s"] + first), F.array(F.size(p)))
        return F.zip_with(begins, ends, lambda a, b: F.slice(p, a + 1, F.greatest(b - a, F.lit(0))))

    return F.array_join(F.flatten(let(pieces, between)), "")
