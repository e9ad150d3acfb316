"""Quality rules from cross-document line frequency, with per-document base rules.

Lines are normalised (ASCII lower case, white space runs to one space, trimmed) and
hashed; per host, distinct documents are counted per line hash. Exact copies of a
text count as one document, so a group of copies does not make its own lines
"frequent". A line is over the limit when it stands in ``min_docs`` documents or more
and in more than ``max_percent`` per cent of its host's documents; such lines are
removed, and a document left with less than ``min_left_percent`` of its words is
depleted and rejected. So at most 100 / max_percent times the mean number of lines
of a document can be over the limit per host, and they are joined back as one array a host.
With ``max_docs``, a line in so many documents of its host is over the limit whatever its share,
as a licence line of a large host is. Such lines grow with the corpus, so they are
joined by host and line, and each document gets its own.

Documents are counted as distinct texts, since exact copies are for deduplication to settle: counted one by
one, ten copies of an article would make all its lines frequent and remove every copy.

Defined cases. Very long texts are judged whole. Null or wordless texts have no words and fail the base rule. A null
host is a host of its own. Repeated rows are judged each by their own text; the
order of rows plays no part. Empty tables give empty results. Columns of the input
pass through, except that columns with the names of the added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import ascii_lower, blank_words, count_blank_words, let, quoted, without, written

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_DOCS = 5
MAX_PERCENT = 1
#: Documents of one host that make a line common whatever its share.
MAX_DOCS = 1000
MIN_LEFT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
WORD_COUNTS = ("n_words", "word_chars", "n_repeat_words")
ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_words_left", "kept")


def lines_of(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def line_key(line: Column) -> Column:
    return F.xxhash64(F.trim(F.regexp_replace(ascii_lower(line), r"[\x20\x09-\x0D]+", " ")))


#: Low bits of a packed window that hold its place; a text of more words takes the longer way.
PLACE = (1 << 24) - 1


def repeated_words(words: Column) -> Column:
    """Words in 3-word windows that are found twice or more.

    A window is packed into a long: high bits of its hash, low bits its place. Equal neighbours
    of the sorted longs are candidates; their words are compared. Where any two differ (a
    collision) or places don't fit, the windows themselves are sorted instead.
    """

    def packed(h: Column) -> Column:
        window = lambda x, i: F.xxhash64(x, h[i + 1], h[i + 2]).bitwiseAND(F.lit(~PLACE)).bitwiseOR(i.cast("long"))
        return F.sort_array(F.transform(F.slice(h, 1, F.greatest(F.size(h) - 2, F.lit(0))), window))

    def candidates(s: Column) -> Column:
        place = lambda x: x.bitwiseAND(F.lit(PLACE)).cast("int")
        both = lambda a, b: F.when(F.shiftright(a, 24) == F.shiftright(b, 24), F.struct(place(a).alias("a"), place(b).alias("b")))
        return F.array_compact(F.zip_with(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), F.slice(s, 2, F.size(s)), both))

    def starts(pairs: Column) -> Column:
        other = lambda x: (words[x["a"]] != words[x["b"]]) | (words[x["a"] + 1] != words[x["b"] + 1]) | (words[x["a"] + 2] != words[x["b"] + 2])
        ends = F.flatten(F.transform(pairs, lambda x: F.array(x["a"], x["b"])))
        return F.when((F.size(words) > PLACE) | F.exists(pairs, other), repeat_starts(word_windows(words))).otherwise(F.sort_array(F.array_distinct(ends)))

    none = F.lit(0).cast("long")
    found = lambda p: F.when(F.size(p) > 0, let(starts(p), covered_words)).otherwise(none)
    return let(F.transform(words, lambda x: F.xxhash64(x)), lambda h: let(packed(h), lambda s: let(candidates(s), found)))


def word_windows(words: Column) -> Column:
    return F.regexp_extract_all(F.array_join(words, " "), F.lit(r"(?=([^ ]+ [^ ]+ [^ ]+))[^ ]+"), F.lit(1))


def repeat_starts(windows: Column) -> Column:
    """Sorted places of the windows that are found twice or more."""
    placed = F.sort_array(F.arrays_zip(windows.alias("w"), F.sequence(F.lit(0), F.size(windows) - 1).alias("p")))
    places = lambda a, b: F.when(a["w"] == b["w"], F.array(a["p"], b["p"]))
    pairs = lambda s: F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1), places)
    return F.sort_array(F.array_distinct(F.flatten(F.array_compact(let(placed, pairs)))))


def covered_words(starts: Column) -> Column:
    """Each start covers three words, or only those before the next start."""
    gaps = F.zip_with(starts, F.slice(starts, 2, F.size(starts)), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    return F.aggregate(gaps, F.lit(0).cast("long"), lambda acc, x: acc + x)


def base_stats(text: Column) -> dict[str, Column]:
    """The base counts, given a text that is not null."""
    return {
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines_of(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    }


def word_stats(words: Column) -> dict[str, Column]:
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_repeat_words": repeated_words(words),
    }


def document_lines(documents: DataFrame, host_col: str) -> DataFrame:
    """host, doc (hash of the text) and keys, the hashes of its distinct lines."""
    host = F.col("`" + host_col.replace("`", "``") + "`")
    keys = F.transform(lines_of(F.col("text")), line_key)
    return documents.select(host.alias("host"), F.xxhash64("text").alias("doc"), F.array_distinct(keys).alias("keys"))


def frequent_lines(documents: DataFrame, host_col: str, min_docs: int, max_percent: int, max_docs: int | None = None) -> DataFrame:
    """Per host: the hashes of its lines over the limit, a row each."""
    seen = (
        document_lines(documents, host_col)
        # a null key stands for the document itself, so that one pass counts documents too
        .select("host", "doc", F.explode(F.concat("keys", F.array(F.lit(None).cast("long")))).alias("line"))
        .distinct()
        .groupBy("host", "line")
        .agg(F.count(F.lit(1)).alias("docs"))
        .filter((F.col("docs") >= min_docs) | F.col("line").isNull())
    )
    counts = written(seen, "line-counts")
    totals = counts.filter(F.col("line").isNull()).select(F.col("host").alias("of"), F.col("docs").alias("total"))
    over = F.col("docs") * 100 > F.col("total") * max_percent
    if max_docs is not None:
        over = over | (F.col("docs") >= max_docs)
    return counts.filter(F.col("line").isNotNull()).join(totals, F.col("host").eqNullSafe(F.col("of"))).filter(over).select("host", "line")


def assess(
    documents: DataFrame,
    host_col: str = "source",
    min_docs: int = MIN_DOCS,
    max_percent: int = MAX_PERCENT,
    min_left_percent: int = MIN_LEFT_PERCENT,
    min_words: int = MIN_WORDS,
    max_repeat_percent: int = MAX_REPEAT_PERCENT,
    max_docs: int | None = None,
) -> DataFrame:
    """The documents' columns with ``text`` rid of frequent lines, and the verdict's columns.

    ``text`` is unchanged where no line is over the limit; counts are those of the text
    as it came, n_words_left is counted after the removal.
    """
    lines = frequent_lines(documents, host_col, min_docs, max_percent, max_docs)
    if max_docs is None:
        held, by = lines, ["host"]
    else:
        each = document_lines(documents, host_col).select("host", "doc", F.explode("keys").alias("line")).alias("e")
        same = F.col("e.host").eqNullSafe(F.col("f.host")) & (F.col("e.line") == F.col("f.line"))
        held, by = each.join(written(lines, "over-limit").alias("f"), same, "left_semi"), ["host", "doc"]
    over = written(held.groupBy(*by).agg(F.collect_set("line").alias("over")), "frequent-lines")
    docs = without(documents, *ADDED)
    host = F.col("d.`" + host_col.replace("`", "``") + "`")
    text = F.col("d.text")
    theirs = host.eqNullSafe(F.col("o.host"))
    if max_docs is not None:
        theirs = theirs & (F.xxhash64("d.text") == F.col("o.doc"))
    rows = docs.alias("d").join(over.alias("o"), theirs, "left")
    left = F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(F.col("o.over"), line_key(x)))
    cleaned = F.when(F.col("o.over").isNull(), text).otherwise(F.array_join(left, "\n"))
    whole = F.coalesce(text, F.lit(""))

    def verdict(s: Column) -> Column:
        left_words = F.when(cleaned.eqNullSafe(text), s["n_words"]).otherwise(count_blank_words(cleaned))
        failed = (s["n_words"] < min_words) | (100 * s["n_repeat_words"] > max_repeat_percent * s["n_words"])
        both = F.struct(left_words.alias("left"), failed.alias("failed"))
        kept = lambda v: ~v["failed"] & (100 * v["left"] >= min_left_percent * s["n_words"])
        return let(both, lambda v: F.struct(*[s[k].alias(k) for k in WORD_COUNTS], v["left"].alias("n_words_left"), v["failed"].alias("base_failed"), kept(v).alias("kept")))

    # one expression for all that hangs on the words: a filter on the verdict, pushed
    # below this select, then works it out once and not once for each mention
    in_words = let(let(blank_words(whole), lambda w: F.struct(*[v.alias(k) for k, v in word_stats(w).items()])), verdict)
    rows = rows.select(
        *[F.col(f"d.{c}") for c in quoted(docs)],
        in_words.alias("__dl_words"),
        *[v.alias(f"__dl_{k}") for k, v in base_stats(whole).items()],
        cleaned.alias("__dl_cleaned"),
    )
    value = lambda k: F.col(f"__dl_{k}") if k in ("n_symbols", "n_dup_lines") else F.col("__dl_words")[k]
    return rows.select(*[F.col("__dl_cleaned").alias("text") if c == "`text`" else F.col(c) for c in quoted(docs)], *[value(k).alias(k) for k in ADDED])


def keep_good(documents: DataFrame, **rules) -> DataFrame:
    """The kept documents in the columns they came with, without lines over the limit."""
    kept = assess(documents, **rules).filter("kept")
    n_chars = {"`n_chars`": F.length("text").cast("long").alias("n_chars")}
    return kept.select(*[n_chars.get(c, F.col(c)) for c in quoted(documents)])
