"""Text, date, hash and vector functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[A-Za-z][A-Za-z0-9_/-]*"
#: English and German month names by number, and their usual short forms.
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
    "januar": 1, "februar": 2, "märz": 3, "mai": 5, "juni": 6, "juli": 7, "oktober": 10, "dezember": 12,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12, "mär": 3, "mrz": 3, "okt": 10, "dez": 12,
}


def normalize_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize_key(c: Column) -> Column:
    """Lower case; runs of other than a-z0-9 to one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def space_terms(c: Column) -> Column:
    """Lower-cased terms between Unicode white space, as the ranking functions take them."""
    return F.array_remove(F.split(F.lower(F.coalesce(c, F.lit(""))), r"(?U)\s+"), "")


def sentences(c: Column, min_words: int = 3) -> Column:
    """Split after . ! ? before space, and at line ends; keep sentences of min_words."""
    parts = F.split(c, r"(?<=[.!?])[ \t]+|\n+")
    return F.filter(F.transform(parts, normalize_space), lambda s: F.size(F.split(s, " ")) >= min_words)


def contains_term(c: Column, term: str) -> Column:
    """The term as a whole word, in any case."""
    escaped = "".join("\\" + x if not x.isalnum() and x != " " else x for x in term)
    return c.rlike(rf"(?iU)(?<![\p{{L}}\p{{N}}_]){escaped}(?![\p{{L}}\p{{N}}_])")


def keyword_hits(c: Column, terms: list[str]) -> Column:
    """Sorted terms that the text holds as whole words."""
    return F.array_sort(F.array_compact(F.array(*[F.when(contains_term(c, t), F.lit(t)) for t in terms])))


def evidence(c: Column, terms: list[str], limit: int = 3, cut: int = 450) -> Column:
    """The first sentences that hold any of the terms as a substring."""
    any_of = lambda s: F.exists(F.array(*[F.lit(t.lower()) for t in terms]), lambda t: F.lower(s).contains(t))
    return F.transform(F.slice(F.filter(sentences(c), any_of), 1, limit), lambda s: F.substring(s, 1, cut))


def truncate(c: Column, limit: int, mark: str = "...") -> Column:
    return F.when(F.length(c) > limit, F.concat(F.rtrim(F.substring(c, 1, limit - len(mark))), F.lit(mark))).otherwise(c)


def entity_refs(c: Column, prefix: str) -> Column:
    """First-seen distinct record ids such as CAPA-001."""
    return F.array_distinct(F.regexp_extract_all(F.upper(c), F.lit(rf"\b{prefix}-[A-Z0-9][A-Z0-9\-]*\b"), F.lit(0)))


def synthetic_ref(prefix: str, parent: Column, text: Column) -> Column:
    """PREFIX-EMB- and ten hex digits from parent, prefix and text."""
    return F.concat(F.lit(f"{prefix}-EMB-"), F.upper(F.substring(F.sha1(F.concat_ws(":", parent, F.lit(prefix), text)), 1, 10)))


def chunk_uuid(source_id: Column, index: Column) -> Column:
    h = F.md5(F.concat(source_id.cast("string"), F.lit("_chunk_"), index.cast("string")))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def hash_modulo(c: Column, modulus: int) -> Column:
    """The MD5 of a string as a 128-bit number, modulo a number below 2**63 (Horner over hex digits)."""
    digits = F.transform(F.split(F.md5(c), ""), lambda d: F.conv(d, 16, 10).cast("decimal(38,0)"))
    step = lambda acc, d: F.pmod(acc * F.lit(16) + d, F.lit(modulus).cast("decimal(38,0)")).cast("decimal(38,0)")
    return F.aggregate(digits, F.lit(0).cast("decimal(38,0)"), step).cast("long")


def content_hash(parts: Column) -> Column:
    """SHA-256 of an array of parts joined by blank lines."""
    return F.sha2(F.array_join(parts, "\n\n"), 256)


def token_estimate(c: Column) -> Column:
    """Language-model tokens from words: ceil(words / 0.75)."""
    return F.ceil(F.size(space_terms(c)) / F.lit(0.75)).cast("long")


def word_set(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]{3,}"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    """Dot product in doubles; the cosine of unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def confidence_from_score(score: Column, cap: float = 0.97) -> Column:
    return F.bround(F.least(F.lit(cap), 1 - F.exp(-F.greatest(score, F.lit(0.0)) / 3.2)), 3)


def normalize_date(c: Column) -> Column:
    """ISO dates as they are, day-first numeric and named-month dates to yyyy-MM-dd; no calendar check."""
    text = F.trim(c)
    iso = F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})", 1)
    numeric = r"^(\d{1,2})[./-](\d{1,2})[./-](\d{4}|\d{2})\b"
    year = F.regexp_extract(text, numeric, 3).try_cast("int")
    year = F.when(year >= 100, year).when(year >= 70, 1900 + year).otherwise(2000 + year)
    part = lambda p, i: F.regexp_extract(text, p, i).try_cast("int")
    month_of = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    day_first, month_first = r"^(\d{1,2})(?:\. ?|[ -])(\p{L}+)\.?[ -](\d{4})\b", r"^(\p{L}+)\.? (\d{1,2}),? (\d{4})\b"
    form = lambda y, m, d: F.format_string("%04d-%02d-%02d", y, m, d)
    named = lambda p, m: month_of[F.lower(F.regexp_extract(text, p, m))]
    return (
        F.when(iso != "", iso)
        .when(text.rlike(numeric), form(year, part(numeric, 2), part(numeric, 1)))
        .when(text.rlike(day_first) & named(day_first, 2).isNotNull(), form(part(day_first, 3), named(day_first, 2), part(day_first, 1)))
        .when(text.rlike(month_first) & named(month_first, 1).isNotNull(), form(part(month_first, 3), named(month_first, 1), part(month_first, 2)))
    )


def html_to_text(c: Column) -> Column:
    """Tags off: line breaks at br, p, li and headings, the five common entities decoded."""
    out = F.regexp_replace(c, r"(?is)<(script|style)\b.*?(?:</\1>|\z)", " ")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>|</(?:p|li|div|h[1-6]|tr)>", "\n")
    out = F.regexp_replace(out, r"(?s)<[^>]+>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"\n\s*\n+", "\n"))


def window_chunks(c: Column, size: int = 1200, overlap: int = 200) -> Column:
    """Sliding character windows; a text no longer than size is one chunk as it is, blanks go."""
    step = size - overlap
    strip = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    # the text is cut into pieces of a step once; a window is made of its piece and the next ones. Where no more than the overlap is left, the window before had it all.
    pieces = F.regexp_extract_all(c, F.lit(rf"(?s).{{1,{step}}}"), F.lit(0))
    rest = lambda all_, i: F.array_join(F.slice(all_, i + 1, -(-size // step)), "")
    window = lambda t, i: F.when((i == 0) | (F.length(t) > overlap), strip(F.substring(t, 1, size))).otherwise("")
    made = lambda all_: F.transform(all_, lambda x, i: window(rest(all_, i), i))
    windows = F.filter(F.flatten(F.transform(F.array(pieces), made)), lambda x: x != "")
    return F.when(F.length(c) <= size, F.array(c)).otherwise(windows)
