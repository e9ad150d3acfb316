"""Phrases of two and three words, counted.

Most phrases of a text are new ones, so that counting them as rows shuffles about all of them. A task therefore counts its pieces of text by
numbers for words, and hands on a row for each piece and bucket: its phrases, sorted, as one compressed text, and their counts. Buckets are dealt
by a hash of the phrase; each is added up whole by one task, which holds one at a time.

Defined cases: null and empty texts have no words. Extra columns aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bytes of text that a task counts at once, buckets for each shuffle partition, and bytes of whole buckets that are added up at once.
PIECE = 4_000_000
BUCKETS = 16
AT_ONCE = 4_000_000
BLANK, BREAK = pa.scalar(" ", pa.large_string()), pa.scalar("\n", pa.large_string())


def _pieces(texts: pa.Array) -> Iterator[pa.Array]:
    """Runs of texts of up to PIECE bytes; a longer text is a piece of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + PIECE, side="right")))
        yield texts.slice(at, to - at)
        at = to


def _words(texts: pa.Array, least: int) -> tuple[pa.Array, np.ndarray]:
    """The runs of a-z of at least so many letters, and the text that each is of; every text ends with another character."""
    texts = pa.concat_arrays([texts.cast(pa.large_string())])  # without what a slice leaves before and after it
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    raw = np.frombuffer(raw, np.uint8)[: bounds[-1]] if raw is not None else np.empty(0, np.uint8)
    letter = np.zeros(len(raw) + 2, np.int8)
    letter[1:-1] = (raw - np.uint8(97)) < 26
    letter[1 : 1 + bounds[0]] = 0
    turn = np.flatnonzero(np.diff(letter))
    starts, ends = turn[::2], turn[1::2]
    long = ends - starts >= least
    starts, ends = starts[long], ends[long]
    # only the letters of these words stay, one word after another
    marks = np.zeros(len(raw) + 1, np.int8)
    marks[starts] += 1
    marks[ends] -= 1
    kept = raw[np.cumsum(marks[:-1], dtype=np.int8).view(bool)]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(kept)))
    return words, np.searchsorted(bounds, starts, side="right")


def _counted(words: pa.Array, of: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Phrases of two and of three words that are of one text, each once and sorted: (phrases, hashes, counts)."""
    encoded = words.dictionary_encode()
    order = pc.sort_indices(encoded.dictionary).to_numpy()
    known = encoded.dictionary.take(pa.array(order))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    codes, size = place[encoded.indices.to_numpy()], max(1, len(order))
    hashes = np.fromiter((zlib.crc32(w) for w in known.cast(pa.large_binary()).to_pylist()), np.uint64, len(known))
    mixed = lambda a, b: (a * np.uint64(0x9E3779B97F4A7C15) ^ (a >> np.uint64(29))) + b
    pair = np.flatnonzero(of[1:] == of[:-1])
    pairs, nth, n = np.unique(codes[pair] * size + codes[pair + 1], return_inverse=True, return_counts=True)
    a, b = pairs // size, pairs % size
    both = pc.binary_join_element_wise(known.take(pa.array(a)), known.take(pa.array(b)), BLANK)
    hashed = mixed(hashes[a], hashes[b])
    yield both, hashed, n
    # a pair's number and the word after it: no overflow, however many words there are
    at = np.full(len(codes), -1)
    at[pair] = nth
    three = np.flatnonzero(of[2:] == of[:-2])
    threes, n = np.unique(at[three] * size + codes[three + 2], return_counts=True)
    a, b = threes // size, threes % size
    yield pc.binary_join_element_wise(both.take(pa.array(a)), known.take(pa.array(b)), BLANK), mixed(hashed[a], hashes[b]), n


def _packed(least: int, buckets: int):
    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for batch in batches:
            for piece in _pieces(batch.column(0)):
                words, of = _words(piece, least)
                if len(words) < 2:
                    continue
                for phrases, hashes, n in _counted(words, of):
                    bucket = ((hashes ^ (hashes >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(33)) % np.uint64(buckets)
                    order = np.argsort(bucket.astype(np.int32), kind="stable")
                    phrases, n, bucket = phrases.take(pa.array(order)), n[order].astype("<i4"), bucket[order]
                    starts = np.flatnonzero(np.diff(bucket, prepend=np.uint64(buckets)))
                    bounds = np.append(starts, len(bucket)).astype(np.int64)
                    lists = pa.LargeListArray.from_arrays(pa.array(bounds), phrases)
                    joined = pc.binary_join(lists, BREAK)
                    counts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds * 4), pa.py_buffer(n)])
                    small = pa.array([codec.compress(x.as_buffer(), asbytes=True) for x in joined], pa.binary())
                    size = pc.binary_length(joined).cast(pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(bucket[starts].astype(np.int32)), size, small, counts.cast(pa.binary())], ["bucket", "size", "phrases", "counts"])

    return pack


def _summed(least: int):
    def sums(rows: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        phrases = pa.concat_arrays([pc.split_pattern(pa.array([r[0]], pa.large_binary()).cast(pa.large_string()), "\n").values for r in rows])
        counts = np.concatenate([np.frombuffer(r[1], "<i4") for r in rows]).astype(np.int64)
        encoded = phrases.dictionary_encode()
        n = np.zeros(len(encoded.dictionary), np.int64)
        np.add.at(n, encoded.indices.to_numpy(), counts)
        often = np.flatnonzero(n >= least)
        found = encoded.dictionary.take(pa.array(often))
        words = pc.add(pc.count_substring(found, " "), 1).cast(pa.int32())
        return pa.RecordBatch.from_arrays([found.cast(pa.string()), words, pa.array(n[often])], ["phrase", "words", "n"])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, last, codec = [], 0, None, pa.Codec("zstd")
        for batch in batches:
            for bucket, size, phrases, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != last and held >= AT_ONCE:
                    yield sums(rows)
                    rows, held = [], 0
                rows.append((codec.decompress(phrases, size, asbytes=True), counts))
                held += size + len(counts)
                last = bucket
        if rows:
            yield sums(rows)

    return add


def phrase_counts(docs: DataFrame, text_col: str = "text", letters: int = 3, least: int = 2) -> DataFrame:
    """(phrase, words, n): phrases of two and of three words of so many letters or more, found in all texts so many times or more."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.concat(F.lower(text_col), F.lit("\n")).alias("t"))
    packed = texts.mapInArrow(_packed(letters, partitions * BUCKETS), "bucket int, size int, phrases binary, counts binary")
    dealt = packed.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(_summed(least), "phrase string, words int, n long")
