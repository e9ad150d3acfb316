"""Token counts by byte-pair merging with a heap and a linked list.

A text is cut at the vocabulary's special strings, each of which is one token, and what is between by the vocabulary's
word pattern. A word's bytes are the first symbols, in a doubly linked list; a heap holds its adjacent pairs by the rank of their
merge, then by place. The lowest pair is popped and merged, its two new neighbours are pushed, and pairs that a merge
has made stale are passed over. The count is the symbols at first less the merges: no identifiers are made, and the vocabulary's
identifiers aren't read. A word of n bytes takes O(n log n) steps, so a text without blanks is no special case.

The driver reads the vocabulary file (its path is a parameter) and broadcasts its merges, at most MAX_MERGES. A Python worker
keeps the counts of the words that it has seen, and starts anew once there are over CACHE of them, so common words are merged about once.

Which characters are letters depends on the Unicode version. The characters that the pattern's library and Python's own tables
don't agree on are put to the vocabulary's pre-tokenizer once, on the driver; texts that hold one that it takes for
no letter or number are split by a pattern that says so.

Defined cases: a null text counts as an empty one, 0 bytes and 0 tokens. Repeated rows are counted each. A very long text is split
as a stream; a worker's memory grows with the text and with its longest word. Columns named like the results are replaced, all others
stay. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import without

LIMIT = 512
CACHE = 1 << 19
MAX_MERGES = 1_000_000
#: Characters from which on a text is split as a stream and not into one list.
STREAM = 1_000_000
#: The word pattern of byte-level vocabularies (a fixed value), with the characters that count as neither letter nor number.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?{other}+|\s+(?!\S)|\s+"


@dataclass(frozen=True)
class Vocabulary:
    merges: tuple[tuple[str, str], ...]
    specials: tuple[str, ...]
    #: Ranges of characters that the pattern's library counts as letters or numbers, and the vocabulary's doesn't.
    strangers: str
    digest: str


def byte_symbols() -> dict[int, str]:
    """A printable character for each byte, as byte-level vocabularies write them: printable ones stand for themselves, the others follow from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


def _strangers(path: str) -> str:
    from tokenizers import Tokenizer

    split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    known = regex.compile(r"[\p{L}\p{N}]")
    asked = [c for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) == "Cn" and known.match(chr(c))]
    # one word of "a" and a letter, and of "1" and a number; a stranger stands alone in both
    found = [c for c in asked if len(split("a" + chr(c))) == 2 and len(split("1" + chr(c))) == 2]
    runs: list[list[int]] = []
    for c in found:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(rf"\U{a:08X}-\U{b:08X}" for a, b in runs)


@lru_cache(maxsize=4)
def read_vocabulary(path: str) -> Vocabulary:
    """A byte-level BPE file of the tokenizers library; an error if it asks for anything that isn't done here."""
    with open(path, encoding="utf-8") as f:
        raw = json.load(f)
    model, first = raw["model"], raw["pre_tokenizer"] or {}
    plain = model.get("type") == "BPE" and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or raw.get("normalizer") or first.get("type") != "ByteLevel" or first.get("add_prefix_space") or not first.get("use_regex", True):
        raise ValueError(f"{path} is no plain byte-level BPE vocabulary")
    added = raw.get("added_tokens") or []
    if any(t.get(x) for t in added for x in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"{path} has added tokens with conditions")
    merges = tuple(tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"])
    if len(merges) > MAX_MERGES:
        raise ValueError(f"{path} has over {MAX_MERGES} merges")
    specials, strangers = tuple(sorted((t["content"] for t in added), key=len, reverse=True)), _strangers(path)
    return Vocabulary(merges, specials, strangers, hashlib.sha256(repr((merges, specials, strangers)).encode()).hexdigest())


def word_counter(merges: tuple[tuple[str, str], ...]) -> Callable[[str], int]:
    """The number of tokens of one word."""
    ranks = {pair: i for i, pair in enumerate(merges)}
    rank = ranks.get
    symbols = {i: s for i, s in byte_symbols().items()}

    def count(word: str) -> int:
        part: list = list(word.encode().decode("latin-1").translate(symbols))
        size = n = len(part)
        # a pair is its rank above the bits of its place: one number, ordered as (rank, place)
        bits = n.bit_length()
        place = (1 << bits) - 1
        heap = [r << bits | i for i, pair in enumerate(zip(part, part[1:])) if (r := rank(pair)) is not None]  # noqa: B905
        if not heap:
            return size
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            r = heappop(heap)
            i = r & place
            j = after[i]
            left = part[i]
            if j >= n or left is None or rank((left, part[j])) != r >> bits:
                continue  # stale
            part[i] = merged = left + part[j]
            part[j] = None
            size -= 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank((merged, part[k]))) is not None:
                    heappush(heap, r << bits | i)
            h = before[i]
            if h >= 0 and (r := rank((part[h], merged))) is not None:
                heappush(heap, r << bits | h)
        return size

    return count


class Counts(dict):
    """The counts of words, worked out where they are missing."""

    def __init__(self, count: Callable[[str], int]) -> None:
        super().__init__()
        self.count = count

    def __missing__(self, word: str) -> int:
        self[word] = n = self.count(word)
        return n


def text_counter(vocabulary: Vocabulary) -> Callable[[str], int]:
    counts = Counts(word_counter(vocabulary.merges))
    count = counts.__getitem__
    usual = regex.compile(WORDS.format(letter=r"\p{L}", number=r"\p{N}", other=r"[^\s\p{L}\p{N}]"))
    odd = vocabulary.strangers
    stranger = regex.compile(f"[{odd}]") if odd else None
    strict = regex.compile("(?V1)" + WORDS.format(letter=rf"[\p{{L}}--[{odd}]]", number=rf"[\p{{N}}--[{odd}]]", other=rf"(?:[{odd}]|[^\s\p{{L}}\p{{N}}])")) if odd else usual
    special = regex.compile("|".join(map(regex.escape, vocabulary.specials))) if vocabulary.specials else None

    def strange(text: str) -> bool:
        """Whether a text holds a stranger; the first 256 characters are none."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return stranger is not None and stranger.search(text) is not None
        return False

    def plain(text: str) -> int:
        words = strict if strange(text) else usual
        if len(text) < STREAM:
            return sum(map(count, words.findall(text)))
        n = 0
        for m in words.finditer(text):
            n += count(m[0])
            if len(counts) > CACHE:
                counts.clear()
        return n

    def total(text: str) -> int:
        if len(counts) > CACHE:
            counts.clear()
        if special is None or not any(s in text for s in vocabulary.specials):
            return plain(text)
        pieces = special.split(text)
        return sum(map(plain, pieces)) + len(pieces) - 1

    return total


_COUNTERS: dict[str, Callable[[str], int]] = {}


def token_counts(documents: DataFrame, path: str, limit: int = LIMIT, text_col: str = "text") -> DataFrame:
    """The documents with n_bytes (UTF-8), n_tokens and over_limit (more tokens than limit)."""
    vocabulary = read_vocabulary(path)
    digest, shared = vocabulary.digest, documents.sparkSession.sparkContext.broadcast(vocabulary)

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from docloom.llm.token_counts import _COUNTERS, text_counter  # this worker's, kept between tasks

        if digest not in _COUNTERS:
            _COUNTERS.clear()
            _COUNTERS[digest] = text_counter(shared.value)
        count = _COUNTERS[digest]
        for texts in batches:
            yield pd.Series([count(t) if t else 0 for t in texts], dtype="int64")

    text = F.col(text_col)
    rows = documents.select(*without(documents, "n_bytes", "n_tokens", "over_limit").columns, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), tokens(text).alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
