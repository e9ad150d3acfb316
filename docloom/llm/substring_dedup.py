"""Substring deduplication by content-defined chunks of a gear rolling hash.

A text's UTF-8 bytes are cut where ``mask_bits`` bits of the gear hash, which the last 16 bytes
decide, are zero, no closer than ``min_bytes`` and no further than ``max_bytes``, where the first
smallest hash of the second half stands in: periodic text has no other cuts. All ASCII white space counts as blanks. Cuts
depend on nearby bytes only, so an insertion moves the cuts next to it and no others.
Chunks are counted by a 64-bit digest; those that two documents or more hold are
shared. A run of neighbouring shared chunks is a repeated passage if it holds ``min_words``
words, or if some window of ``min_words`` words around its middle chunk stands in another document too:
the cuts seldom fall on a passage's ends, so a passage just over the limit has a run that is shorter.
The first document (smallest doc_id) that holds a chunk keeps it, the others lose it.
A passage can be missed, as where no whole chunk falls inside it: against all windows of sf0.1, 6 of 2,080 documents are.

A chunk that holds more than one HOT-th of all chunk rows is joined through a broadcast table, which has
fewer than HOT rows at any size of the corpus; the others are joined by a shuffle, in which no key
then has more than a HOT-th of the rows.

Words are what stands between ASCII white space. Defined cases: null and empty texts have no chunks. Very long texts are cut whole; their chunks leave a
task in batches of BATCH_ROWS. Repeats within one document are not this operator's: a passage
counts once a document, and ties between documents go to the smallest doc_id. Repeated rows (same doc_id, same text) are
one document here; equal texts under different doc_ids are repeats of one another. Rows without a doc_id
take part as document "null" of their text. Empty tables give empty results. Only doc_id and text
are read; remove_repeats passes other columns through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import quoted, written
from docloom.llm.shingles import PASS_BYTES, mix

MASK_BITS = 5
MIN_BYTES = 16
MAX_BYTES = 128
#: A repeated passage is of over 50 words.
MIN_WORDS = 51
BATCH_ROWS = 65_536
HOT = 1000
_PAD = 32
#: Bits of the gear hash below this one depend on the last 16 bytes alone.
_TOP = 16
#: Chunks before a shared run in which its passage may begin: cuts within the hash's 16 bytes of warm-up may differ.
_BEFORE = 3
_BLANK = np.zeros(256, bool)
_BLANK[[0, 32]] = True  # 0: the padding between texts
_BLANKS = bytes.maketrans(b"\t\n\v\f\r", b"     ")
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) >> np.uint64(32)).astype(np.uint32)


def gear(data: np.ndarray, pad: np.ndarray) -> np.ndarray:
    """The gear hash h = (h << 1) + G[byte] in 32 bits at every byte; bytes in pad count as nothing."""
    h = np.where(pad, np.uint32(0), _GEAR[data])
    for shift in (1, 2, 4, 8, 16):  # the sum over the last 2 * shift bytes from two sums over shift bytes
        h[shift:] += h[:-shift] << np.uint32(shift)
    return h


def cuts(candidates: list[int], text: bytes, hashes: np.ndarray, min_bytes: int, max_bytes: int) -> list[int]:
    """Ends of the chunks of a text, given where the hash would cut and the hash before each byte; never within a character."""
    out, last, end = [], 0, len(text)
    for c in [*candidates, end]:
        while c - last > max_bytes:
            half = last + max_bytes // 2 + 1
            last = half + int(hashes[half : last + max_bytes + 1].argmin())
            while last < end and text[last] & 0xC0 == 0x80:
                last += 1
            out.append(last)
        if c - last >= min_bytes or c == end and c > last:
            out.append(c)
            last = c
    return out


def chunks_of(texts: pa.Array, mask_bits: int, min_bytes: int, max_bytes: int) -> Iterator[tuple[list[int], list[int], np.ndarray]]:
    """For each text the ends of its chunks, their digests, and the words that begin before each edge (0 and the ends)."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    row, n = 0, len(texts)
    lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    while row < n:
        last, size = row, 0
        while last < n and (last == row or size + lengths[last] <= PASS_BYTES):
            size += lengths[last]
            last += 1
        parts = [t.as_py().translate(_BLANKS) for t in texts.slice(row, last - row)]
        data = np.frombuffer(b"".join(bytes(_PAD) + p for p in parts), np.uint8)
        starts = np.cumsum([0] + [len(p) + _PAD for p in parts])
        pad = np.zeros(len(data), bool)
        for s in starts[:-1]:
            pad[s : s + _PAD] = True
        with np.errstate(over="ignore"):
            low = (gear(data, pad) & np.uint32((1 << _TOP) - 1)).astype(np.uint16)
        marks = np.flatnonzero(low < 1 << _TOP - mask_bits) + 1
        low[:-1][data[1:] & 0xC0 == 0x80] = 0xFFFF  # no cut within a character
        marks = marks[data[np.minimum(marks, len(data) - 1)] & 0xC0 != 0x80]
        blank = _BLANK[data]
        begun = np.cumsum(~blank[1:] & blank[:-1], dtype=np.int32)  # words that begin up to the next byte
        first = np.searchsorted(marks, starts[:-1] + _PAD, "right")
        after = np.searchsorted(marks, starts[1:], "left")
        for p, s, a, b in zip(parts, starts[:-1] + _PAD, first, after, strict=True):
            ends = cuts((marks[a:b] - s).tolist(), p, low[s - 1 : s - 1 + len(p)], min_bytes, max_bytes)
            words = begun[np.array([0, *ends]) + (s - 2)] - begun[s - 2]
            yield ends, [xxhash.xxh3_64_intdigest(p[x:y]) for x, y in zip([0, *ends], ends, strict=False)], words
        row = last


def chunk_table(documents: DataFrame, mask_bits: int = MASK_BITS, min_bytes: int = MIN_BYTES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """One row per chunk: doc_id, text_key, seq, start, end (bytes), words, before, after (words that begin in it, in the chunks before, in the next), digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column("doc_id"), batch.column("text_key")
            rows, found, size = [], [], 0

            def flush(rows: list, found: list) -> pa.RecordBatch:
                row = pa.array(np.repeat(np.array(rows, np.int64), [len(e) for e, *_ in found]))
                whole = lambda parts, kind: pa.array(np.concatenate([*parts, np.zeros(0, np.int64)]).astype(kind))
                seqs = whole([np.arange(len(e)) for e, *_ in found], np.int32)
                starts = whole([np.array([0, *e[:-1]][: len(e)], np.int64) for e, *_ in found], np.int32)
                ends = whole([np.array(e, np.int64) for e, *_ in found], np.int32)
                words = whole([np.diff(w) for *_, w in found], np.int32)
                before = [w[:-1] - w[np.maximum(np.arange(len(w) - 1) - _BEFORE, 0)] for *_, w in found]
                after = [w[np.minimum(np.arange(1, len(w)) + 1, len(w) - 1)] - w[1:] for *_, w in found]
                digests = whole([np.array(d, np.uint64).view(np.int64) for _, d, _ in found], np.int64)
                columns = [ids.take(row), keys.take(row), seqs, starts, ends, words, whole(before, np.int32), whole(after, np.int32), digests]
                return pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "seq", "start", "end", "words", "before", "after", "digest"])

            for i, (e, d, w) in enumerate(chunks_of(batch.column("text"), mask_bits, min_bytes, max_bytes)):
                rows.append(i)
                found.append((e, d, w))
                size += len(e)
                if size >= BATCH_ROWS:
                    yield flush(rows, found)
                    rows, found, size = [], [], 0
            yield flush(rows, found)

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, f"doc_id {kind}, text_key long, seq int, start int, end int, words int, before int, after int, digest long")


def held_twice(rows: DataFrame, key: str, name: str) -> DataFrame:
    """The rows whose key two documents or more hold, with ``first``, the smallest (doc_id, text_key) of them."""
    owner = F.struct("doc_id", "text_key")
    shared = rows.groupBy(key).agg(F.min(owner).alias("first"), F.max(owner).alias("last"), F.count(F.lit(1)).alias("n"))
    shared = written(shared.filter("first <> last").select(key, "first", "n"), name)
    total = shared.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(shared.filter(F.col("n") * HOT > total).select(key, F.col("first").alias("hot_first")))  # fewer than HOT rows
    cold = shared.filter(F.col("n") * HOT <= total).select(F.col(key).alias("key"), F.col("first").alias("cold_first"))
    # rows of hot keys are done; they pass the shuffle under keys of their own, spread over all tasks
    marked = rows.join(hot, key, "left").withColumn("key", F.when(F.col("hot_first").isNull(), F.col(key)).otherwise(F.xxhash64("text_key", "seq")))
    found = marked.join(cold, "key", "left").withColumn("first", F.coalesce("hot_first", "cold_first")).filter("first is not null")
    return found.select(*rows.columns, "first")


def windows_around(documents: DataFrame, anchors: DataFrame, min_words: int) -> DataFrame:
    """The windows of min_words words that begin low to high words from the first word of an anchor.

    anchors: doc_id, text_key, start (byte), low, high. One row per anchor and window: doc_id, text_key,
    start (the anchor's), seq (the window's first word), window (its hash).
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (text, spans) in enumerate(zip(batch.column("text"), batch.column("spans"), strict=True)):
                found = list(_WORD.finditer(text.as_py().encode()))
                words = [m.group() for m in found]
                begins = np.array([m.start() for m in found], np.int64)
                spans = spans.as_py()
                firsts = np.searchsorted(begins, [x["start"] for x in spans])
                at = [(x["start"], y) for x, a in zip(spans, firsts, strict=True) for y in range(max(0, a + x["low"]), min(a + x["high"], len(words) - min_words) + 1)]
                for k in range(0, len(at), BATCH_ROWS):
                    part = at[k : k + BATCH_ROWS]
                    hashes = [xxhash.xxh3_64_intdigest(b" ".join(words[y : y + min_words])) for _, y in part]
                    row = pa.array([i] * len(part), pa.int64())
                    columns = [batch.column("doc_id").take(row), batch.column("text_key").take(row), *(pa.array(x, pa.int32()) for x in zip(*part, strict=True))]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(np.array(hashes, np.uint64).view(np.int64))], ["doc_id", "text_key", "start", "seq", "window"])

    spans = anchors.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "low", "high")).alias("spans"))
    texts = documents.select("doc_id", F.xxhash64("text").alias("text_key"), "text").alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & F.col("d.text_key").eqNullSafe(F.col("s.text_key"))
    kind = documents.schema["doc_id"].dataType.simpleString()
    wanted = texts.join(spans.alias("s"), same).select("d.doc_id", "d.text_key", "text", "spans")
    return wanted.mapInArrow(hashed, f"doc_id {kind}, text_key long, start int, seq int, window long")


def repeated_passages(documents: DataFrame, min_words: int = MIN_WORDS, **chunking: int) -> DataFrame:
    """One row per repeated passage of a document, first or later.

    doc_id, text_key, start, end (byte offsets of its whole chunks), n_chunks, first_doc_id (the smallest
    doc_id that holds a chunk of it), removed_bytes (0 in the first document),
    removed (byte spans that the document loses).
    """
    found = written(held_twice(chunk_table(documents, **chunking), "digest", "shared-digests").distinct(), "shared-chunks")
    one = Window.partitionBy("doc_id", "text_key").orderBy("seq")
    run = Window.partitionBy("doc_id", "text_key", "run")
    lost = ~F.struct("doc_id", "text_key").eqNullSafe(F.col("first"))
    runs = (
        found.withColumn("run", F.col("seq") - F.row_number().over(one))
        .withColumn("prior", F.sum("words").over(run.orderBy("seq")) - F.col("words"))  # words of the run before the chunk
        .withColumn("total", F.sum("words").over(run))
        .groupBy("doc_id", "text_key", "run")
        .agg(
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            F.sum("words").alias("words"),
            F.min_by("before", "seq").alias("before"),
            F.max_by("after", "seq").alias("after"),
            # the chunk with the run's middle word: a passage just over the limit holds over half of its run
            F.max_by(F.struct("digest", "start", "words", "prior"), F.when(2 * F.col("prior") <= F.col("total"), F.col("seq"))).alias("anchor"),
            F.count(F.lit(1)).alias("n_chunks"),
            F.min("first").alias("first"),
            F.sum(F.when(lost, F.col("end") - F.col("start")).otherwise(0)).alias("removed_bytes"),
            F.array_sort(F.collect_list(F.when(lost, F.struct("start", "end")))).alias("removed"),
        )
        .filter(F.col("before") + F.col("words") + F.col("after") >= min_words)
    )
    runs = written(runs, "runs")
    # a run's last word may end beyond it, hence one word more
    long, short = runs.filter(F.col("words") > min_words), runs.filter(F.col("words") <= min_words)
    low = F.greatest(F.col("anchor.words") - 1 - min_words, -F.col("anchor.prior") - F.col("before"))
    high = F.least(F.lit(0), F.col("words") - F.col("anchor.prior") + F.col("after") + 1 - min_words)
    wanted = short.groupBy("anchor.digest").agg(F.min(low).cast("int").alias("low"), F.max(high).cast("int").alias("high"))
    # whoever holds the anchor shows its windows, in long runs too
    anchors = found.join(wanted, "digest").select("doc_id", "text_key", "start", "low", "high")
    windows = written(windows_around(documents, anchors, min_words), "windows")
    sure = written(held_twice(windows, "window", "shared-windows").select("doc_id", "text_key", "start").distinct(), "sure-runs")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{d}")) for c, d in (("doc_id", "doc_id"), ("text_key", "text_key"), ("anchor.start", "start"))]
    passages = long.unionByName(short.alias("r").join(sure.alias("s"), same, "left_semi"))
    return passages.select("doc_id", "text_key", "start", "end", "n_chunks", F.col("first.doc_id").alias("first_doc_id"), "removed_bytes", "removed")


def remove_repeats(documents: DataFrame, **settings) -> DataFrame:
    """The documents without the passages that an earlier document keeps; all columns pass through."""
    gone = repeated_passages(documents, **settings).filter("removed_bytes > 0")
    spans = gone.groupBy("doc_id", "text_key").agg(F.sort_array(F.flatten(F.collect_list("removed"))).alias("spans"))
    spans = written(spans, "removed-spans")
    same = F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & F.xxhash64("d.text").eqNullSafe(F.col("s.text_key"))
    rows = documents.alias("d").join(spans.alias("s"), same, "left")
    text = F.when(F.col("s.spans").isNull(), F.col("d.text")).otherwise(without_bytes(F.col("d.text"), F.col("s.spans")))
    return rows.select(*[text.alias("text") if c == "`text`" else F.col(f"d.{c}") for c in quoted(documents)])


def without_bytes(text: Column, spans: Column) -> Column:
    """The text without sorted byte spans (cuts never split a character)."""
    data = text.cast("binary")
    stops = F.concat(F.transform(spans, lambda x: x["start"]), F.array(F.octet_length(text)))
    begins = F.concat(F.array(F.lit(0)), F.transform(spans, lambda x: x["end"]))
    parts = F.zip_with(begins, stops, lambda a, b: F.hex(F.substr(data, a + 1, b - a)))
    return F.unhex(F.array_join(parts, "")).cast("string")
