"""Which texts hold which snippets: a substring join without a nested loop.

Snippets are a stated set, taken in blocks of BLOCK_BYTES, which is what is broadcast. A snippet is looked for by one anchor: eight bytes of it,
which fit a 64-bit number, so that comparing numbers is comparing bytes. One scan of the texts counts all snippets' anchors,
and each snippet keeps its rarest; one of which a text has none is in no text. A second scan looks the texts' bytes up
among the anchors kept, and compares whole snippets where one stands. Shorter snippets have anchors of their own length.
Texts that stand within a snippet are found the same way round: a text no longer than the longest snippet looks
its own first bytes up among those of the snippets. Each scan is a map over the texts: nothing of a text is shuffled.

Compared are texts in lower case with white space squeezed. Defined cases: null and blank snippets match nothing, and null and
blank texts are held by nothing. Repeated snippets and texts give a row for each pair. Ids may be null. Extra columns aren't read; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.lines import squeezed
from docloom.session import written

BLOCK_BYTES = 2_000_000
ANCHOR = 8
#: Bytes of text of one numpy pass; a longer text is a pass of its own.
PASS_BYTES = 4_000_000
PROBE_WORDS = 5


def grams(data: np.ndarray, size: int) -> np.ndarray:
    """The number that each run of size bytes is."""
    n = len(data) - size + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(size):
        out = (out << np.uint64(8)) | data[k : k + len(out)].astype(np.uint64)
    return out


def _passes(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, bounds) of runs of rows."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        last = min(len(texts), max(row + 1, int(np.searchsorted(offsets, offsets[row] + PASS_BYTES, "right")) - 1))
        yield row, last, data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row]
        row = last


def _anchors(snippets: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By anchor length: the numbers of all places, sorted, with their snippets and places."""
    out: dict[int, list] = {}
    for i, s in enumerate(snippets):
        size = min(ANCHOR, len(s))
        g = grams(np.frombuffer(s, np.uint8), size)
        out.setdefault(size, []).append((g, np.full(len(g), i), np.arange(len(g))))
    done = {}
    for size, parts in out.items():
        g, who, at = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(g, kind="stable")
        done[size] = (g[order], who[order], at[order])
    return done


def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers from each first up to its last, and which pair each is of."""
    sizes = last - first
    which = np.repeat(np.arange(len(first)), sizes)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first, sizes)


def _rarest(texts: DataFrame, snippets: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The anchor of each snippet that texts have least often; none for snippets of which they lack one."""
    places = _anchors(snippets)
    wanted = {size: np.unique(g) for size, (g, _, _) in places.items()}
    shared = texts.sparkSession.sparkContext.broadcast(wanted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {size: np.zeros(len(g), np.int64) for size, g in shared.value.items()}
        for b in batches:
            for _, _, data, _ in _passes(b.column("clean")):
                for size, g in shared.value.items():
                    seen = grams(data, size)
                    at = np.searchsorted(g, seen)
                    at[at == len(g)] = 0
                    sums[size] += np.bincount(at[g[at] == seen], minlength=len(g))
        for size, n in sums.items():
            held = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), size)), pa.array(held), pa.array(n[held])], ["size", "at", "n"])

    counts = {size: np.zeros(len(g), np.int64) for size, g in wanted.items()}
    # as many rows as the block of snippets has places, at most
    for r in texts.select("clean").mapInArrow(count, "size long, at long, n long").groupBy("size", "at").agg(F.sum("n").alias("n")).collect():
        counts[r["size"]][r["at"]] = r["n"]
    kept = {}
    for size, (g, who, at) in places.items():
        n = counts[size][np.searchsorted(wanted[size], g)]
        order = np.lexsort((at, n, who))
        first = order[np.flatnonzero(np.diff(who[order], prepend=-1))]
        first = first[n[first] > 0]
        first = first[np.argsort(g[first], kind="stable")]
        if len(first):
            kept[size] = (g[first], who[first], at[first])
    return kept


def _block(texts: DataFrame, snippets: list[bytes], both_ways: bool) -> DataFrame:
    """(nth, text_id, how) for the snippets of one block."""
    sc = texts.sparkSession.sparkContext
    shared = sc.broadcast((snippets, _rarest(texts, snippets), _anchors(snippets) if both_ways else {}))

    def held(data: np.ndarray, bounds: np.ndarray, snippets: list[bytes], kept: dict) -> set[tuple[int, int]]:
        """(row, snippet) of the texts that hold one."""
        out = set()
        whole = data.tobytes()
        for size, (g, who, at) in kept.items():
            seen = grams(data, size)
            first, last = np.searchsorted(g, seen, "left"), np.searchsorted(g, seen, "right")
            hit = np.flatnonzero(last > first)
            which, entry = _spread(first[hit], last[hit])
            begin = hit[which] - at[entry]
            row = np.searchsorted(bounds, hit[which], "right") - 1
            for r, b, i in zip(row.tolist(), begin.tolist(), who[entry].tolist(), strict=True):
                if (r, i) not in out and b >= bounds[r] and b + len(snippets[i]) <= bounds[r + 1] and whole[b : b + len(snippets[i])] == snippets[i]:
                    out.add((r, i))
        return out

    def within(text: bytes, snippets: list[bytes], places: dict) -> set[int]:
        """The snippets that a text stands in."""
        size = min(ANCHOR, len(text))
        key, out = grams(np.frombuffer(text[:size], np.uint8), size)[0], set()
        for length, (g, who, at) in places.items():
            if size > length:
                continue
            # a shorter text's bytes are the first ones of a place's number
            shift = np.uint64(8 * (length - size))
            low = int(key << shift)
            first, last = np.searchsorted(g, np.uint64(low), "left"), np.searchsorted(g, np.uint64(low + (1 << int(shift)) - 1), "right")
            out.update(i for i, p in zip(who[first:last].tolist(), at[first:last].tolist(), strict=True) if snippets[i][p : p + len(text)] == text)
            if size < length:  # the places after the last whole number
                out.update(i for i in np.unique(who).tolist() if text in snippets[i][-(length - 1) :])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        snippets, kept, places = shared.value
        longest = max(map(len, snippets))
        for b in batches:
            nth, ids, how = [], [], []
            for row, _, data, bounds in _passes(b.column("clean")):
                pairs = held(data, bounds, snippets, kept)
                for r, i in sorted(pairs):
                    nth.append(i)
                    ids.append(row + r)
                    how.append("in text")
                if places:
                    for r in np.flatnonzero((np.diff(bounds) <= longest) & (np.diff(bounds) > 0)).tolist():
                        for i in sorted(within(data[bounds[r] : bounds[r + 1]].tobytes(), snippets, places)):
                            if (r, i) not in pairs:
                                nth.append(i)
                                ids.append(row + r)
                                how.append("holds text")
            yield pa.RecordBatch.from_arrays([pa.array(nth, pa.int64()), b.column("id").take(pa.array(ids, pa.int64())), pa.array(how, pa.string())], ["nth", "text_id", "how"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(run, f"nth long, text_id {kind}, how string")


def clean(c: Column) -> Column:
    return squeezed(F.lower(F.coalesce(c, F.lit(""))))


def _join(snippets: DataFrame, texts: DataFrame, both_ways: bool, block_bytes: int) -> DataFrame:
    """(snippet row, text_id, how); snippets: (row, clean), texts: (id, clean)."""
    spark = texts.sparkSession
    kind = texts.schema["id"].dataType.simpleString()
    total = snippets.agg(F.sum(F.octet_length("clean"))).first()[0] or 0
    blocks, out = max(1, -(-total // block_bytes)), None
    for b in range(blocks):
        mine = snippets.filter((F.pmod(F.xxhash64("row"), F.lit(blocks)) == b) & (F.col("clean") != "")).collect()  # about block_bytes
        if not mine:
            continue
        found = _block(texts, [r.clean.encode() for r in mine], both_ways)
        rows = spark.createDataFrame([(i, r.row) for i, r in enumerate(mine)], "nth long, row long")
        part = found.join(F.broadcast(rows), "nth").select("row", "text_id", "how")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], f"row long, text_id {kind}, how string")


def containment(snippets: DataFrame, texts: DataFrame, snippet_id: str, text_id: str, snippet_text: str = "text", text_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(snippet_id, text_id, how): in text, holds text, or, for snippets of over five words without either, probe: a text whose lower case holds the first five."""
    asked = written(snippets.select(F.monotonically_increasing_id().alias("row"), F.col(snippet_id).alias("snippet_id"), clean(F.col(snippet_text)).alias("clean")), "snippets")
    rows = texts.select(F.col(text_id).alias("id"), F.col(text_text).alias("raw"))
    exact = written(_join(asked, rows.select("id", clean(F.col("raw")).alias("clean")), True, block_bytes), "contained")
    rest = asked.join(exact.select("row").distinct(), "row", "left_anti")
    words = F.split("clean", " ")
    probes = rest.filter(F.size(words) > PROBE_WORDS).select("row", F.array_join(F.slice(words, 1, PROBE_WORDS), " ").alias("clean"))
    probed = _join(written(probes, "probes"), rows.select("id", F.lower(F.coalesce("raw", F.lit(""))).alias("clean")), False, block_bytes).withColumn("how", F.lit("probe"))
    return exact.unionByName(probed).join(asked.select("row", "snippet_id"), "row").select("snippet_id", "text_id", "how")


def first_match(pairs: DataFrame) -> DataFrame:
    """(snippet_id, text_id, how): the smallest text id of each snippet."""
    return pairs.groupBy("snippet_id").agg(F.min_by(F.struct("text_id", "how"), F.struct("text_id", "how")).alias("m")).select("snippet_id", "m.*")


def enriched(cited: Column, raw: Column) -> Column:
    """Each citation (ref, title) once by its ref, with status and score of the first raw citation (ref, title, status, score) whose ref holds its ref or whose title its title holds.

    An empty ref is held by any; a raw citation with an empty title is found by its ref only.
    """
    fits = lambda c: lambda r: r["ref"].contains(c["ref"]) | ((r["title"] != "") & c["title"].contains(r["title"]))
    some = lambda x: F.coalesce(x, F.lit(""))
    plain = F.transform(cited, lambda c: F.struct(some(c["ref"]).alias("ref"), some(c["title"]).alias("title")))
    known = F.transform(raw, lambda r: F.struct(some(r["ref"]).alias("ref"), some(r["title"]).alias("title"), r["status"].alias("status"), r["score"].alias("score")))

    def made(known: Column) -> Column:
        def one(c: Column) -> Column:
            pick = lambda m: F.struct(c["ref"].alias("ref"), c["title"].alias("title"), some(m["status"]).alias("status"), F.coalesce(m["score"], F.lit(0.0)).alias("score"))
            return F.transform(F.array(F.get(F.filter(known, fits(c)), F.lit(0))), pick)[0]

        refs = F.transform(plain, lambda c: c["ref"])
        return F.transform(F.filter(plain, lambda c, i: F.array_position(refs, c["ref"]) == i + 1), one)

    return F.transform(F.array(known), made)[0]


def normal_label(c: Column) -> Column:
    """Lower case, without a number at the begin, other than letters and digits to blanks."""
    plain = F.regexp_replace(F.lower(c), r"^\s*\d+(?:\.\d+)*[.)\]:-]?\s*", "")
    return F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " "))


def mentioned_section(message: Column, labels: Column) -> Column:
    """The longest label that a message speaks of, the first of equally long ones; null if none.

    By its name, by a word of it of over two letters with "section" after or "in" before it, or by a word at most two edits from such a word.
    """
    text = normal_label(message)

    def speaks(text: Column, words: Column) -> Column:
        def of(label: Column) -> Column:
            tokens = F.filter(F.split(label, " "), lambda t: F.length(t) > 2)
            near = lambda t: F.exists(words, lambda w: (F.abs(F.length(w) - F.length(t)) <= 2) & (F.levenshtein(w, t) <= 2))
            by_word = F.exists(tokens, lambda t: text.contains(F.concat(t, F.lit(" section"))) | text.contains(F.concat(F.lit("in "), t)) | near(t))
            return (label != "") & (text != "") & (text.contains(label) | by_word)

        keyed = F.transform(labels, lambda x, i: F.struct((-F.length(normal_label(x))).alias("size"), i.alias("i"), x.alias("label"), normal_label(x).alias("normal")))
        return F.array_min(F.filter(keyed, lambda x: of(x["normal"])))["label"]

    return F.transform(F.array(text), lambda t: F.transform(F.array(F.split(t, " ")), lambda w: speaks(t, w))[0])[0]
