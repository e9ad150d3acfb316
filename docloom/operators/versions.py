"""Two versions of a document: which blocks belong together, and which words changed.

Blocks are matched in the document's own row; a word diff is a row's work too, in Arrow batches, as neither can be said in
expressions. The diff keeps a longest common subsequence of the two token lists, from bit vectors with a row for each token. Long lists are
halved first (two passes of bit vectors say where the other list is cut), so that the rows kept take DIRECT bits at most; the rest of the memory is in proportion to the
lists and their frequent tokens, and nothing recurses.

Defined cases: a null version is an empty one. Equal versions give one run, two empty ones none. Block ids may be null, repeat (the last block
of an id counts) or stand in one version only.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

TOKENS = re.compile(r"\s+|\w+|[^\w\s]")
#: A token that stands more often has its places kept as one long number; the others' are made each time.
FREQUENT = 32
#: Lists of fewer tokens keep the places of all of them.
SHORT = 4096
#: Pairs of lists of which no more bits are needed are read back from all their rows; others are halved until they are.
DIRECT = 1 << 25
#: Rows of an Arrow batch whose runs are Python objects at once.
DIFF_ROWS = 64
RUNS = ArrayType(StructType([StructField("kind", StringType()), StructField("text", StringType())]))
MATCHES = ArrayType(StructType([StructField("old_index", IntegerType()), StructField("new_index", IntegerType()), StructField("status", StringType())]))


def _rows(a: list[int], b: list[int]) -> Iterator[int]:
    """After each token of a: a number whose bit j is 0 where the longest common subsequence with b[:j + 1] is one longer than with b[:j]."""
    places: dict[int, list[int]] = {}
    for j, t in enumerate(b):
        places.setdefault(t, []).append(j)
    masks: dict[int, int] = {}

    def mask(t: int) -> int:
        at = places.get(t)
        if at is None:
            return 0
        number = masks.get(t)
        if number is None:
            number = 0
            if len(at) <= FREQUENT:
                for j in at:
                    number |= 1 << j
            else:
                bits = np.zeros(len(b), np.uint8)
                bits[at] = 1
                number = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
            if len(at) > FREQUENT or len(b) < SHORT:
                masks[t] = number
        return number

    every = v = (1 << len(b)) - 1
    for t in a:
        u = v & mask(t)
        if u:
            v = ((v + u) | (v - u)) & every
        yield v


def _prefix_lengths(a: list[int], b: list[int]) -> np.ndarray:
    """For each j the length of the longest common subsequence of a and b[:j]."""
    for v in _rows(a, b):  # noqa: B007  the last one counts
        pass
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _traced(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, read back from all rows."""
    rows, out = list(_rows(a, b)), []
    i, j = len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if not i or rows[i - 1] >> (j - 1) & 1:
                j -= 1
                out.append((i, j))
    return out


def common(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places (in a, in b) of a longest common subsequence, in order."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, k, j, m = todo.pop()
        while i < k and j < m and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < k and j < m and a[k - 1] == b[m - 1]:
            k, m = k - 1, m - 1
            out.append((k, m))
        if i == k or j == m:
            continue
        if (k - i) * (m - j) <= DIRECT or k - i == 1:
            out += [(i + p, j + q) for p, q in _traced(a[i:k], b[j:m])]
            continue
        middle = (i + k) // 2
        left = _prefix_lengths(a[i:middle], b[j:m])
        right = _prefix_lengths(a[middle:k][::-1], b[j:m][::-1])[::-1]
        cut = j + int((left + right).argmax())
        todo += [(i, middle, j, cut), (middle, k, cut, m)]
    return sorted(out)


def runs(old: str | None, new: str | None) -> list[dict]:
    """Runs of same, removed and added text; removed before added where both stand at one place."""
    a, b = TOKENS.findall(old or ""), TOKENS.findall(new or "")
    numbers: dict[str, int] = {}
    code = lambda ts: [numbers.setdefault(t, len(numbers)) for t in ts]
    out: list[dict] = []

    def put(kind: str, tokens: list[str]) -> None:
        if not tokens:
            return
        if out and out[-1]["kind"] == kind:
            out[-1]["text"].extend(tokens)
        else:
            out.append({"kind": kind, "text": list(tokens)})

    i = j = 0
    for p, q in [*common(code(a), code(b)), (len(a), len(b))]:
        put("removed", a[i:p])
        put("added", b[j:q])
        put("same", a[p : p + 1])
        i, j = p + 1, q + 1
    return [{"kind": r["kind"], "text": "".join(r["text"])} for r in out]


@F.arrow_udf(RUNS)
def word_diff(old: pa.Array, new: pa.Array) -> pa.Array:
    """The runs that make the old text (same and removed) and the new one (same and added); Python objects of DIFF_ROWS rows at a time."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string())]))
    parts = [pa.array([runs(a.as_py(), b.as_py()) for a, b in zip(old.slice(i, DIFF_ROWS), new.slice(i, DIFF_ROWS), strict=True)], kind) for i in range(0, len(old), DIFF_ROWS)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


class _Free:
    """Places that aren't used up, and the first of them from a place on."""

    def __init__(self, places: list[int]) -> None:
        self.places, self.next = places, list(range(len(places) + 1))

    def first(self, start: int) -> int | None:
        k = at = bisect_left(self.places, start)
        while self.next[at] != at:
            at = self.next[at]
        while self.next[k] != at:  # so that the way is short the next time
            self.next[k], k = at, self.next[k]
        return self.places[at] if at < len(self.places) else None

    def use(self, place: int) -> None:
        at = bisect_left(self.places, place)
        if at < len(self.places) and self.places[at] == place:
            self.next[at] = at + 1


def matches(old, new) -> list[dict]:
    """(old_index, new_index, status) of the new blocks in order, then the old ones that are left.

    A new block with an id belongs to the old one of that id, or is added. One without takes the old block without id at its own place,
    else the first unused one of its type from there on, else the first unused one at all. An old block without id is used once.
    """
    old, new = ([] if x is None else list(x) for x in (old, new))
    by_id = {b["id"]: i for i, b in enumerate(old) if b["id"]}
    loose = [i for i, b in enumerate(old) if not b["id"]]
    free = {t: _Free([i for i in loose if old[i]["type"] == t]) for t in {old[i]["type"] for i in loose}}
    every, used, out = _Free(loose), set(), []

    def take(i: int, j: int) -> None:
        used.add(i)
        every.use(i)
        if not old[i]["id"]:
            free[old[i]["type"]].use(i)
        same = old[i]["type"] == new[j]["type"] and old[i]["text"] == new[j]["text"]
        out.append({"old_index": i, "new_index": j, "status": "same" if same else "modified"})

    for j, block in enumerate(new):
        if block["id"]:
            at = by_id.get(block["id"])
        elif j < len(old) and j not in used and not old[j]["id"]:
            at = j
        else:
            kind = every if not block["type"] else free.get(block["type"])
            at = kind.first(j) if kind else None
            at = every.first(0) if at is None else at
        if at is None:
            out.append({"old_index": None, "new_index": j, "status": "added"})
        else:
            take(at, j)
    return out + [{"old_index": i, "new_index": None, "status": "removed"} for i in range(len(old)) if i not in used]


@F.pandas_udf(MATCHES)
def block_matches(old: pd.Series, new: pd.Series) -> pd.Series:
    """Versions are arrays of (id, type, text)."""
    return pd.Series([matches(a, b) for a, b in zip(old, new, strict=True)], dtype=object)
