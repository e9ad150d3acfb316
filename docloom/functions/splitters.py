"""Texts in chunks by a ladder of separators, and in segments that join up again.

Where one piece ends hangs on where the last one did, so a text is walked from begin to end in Arrow batches; a piece that is
too long goes back on a stack with the separators that are left, so nothing recurses.
"""

from __future__ import annotations

import re
from collections import deque

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

# The ladder and sizes of chunks, and the size of segments.
SEPARATORS = ("\n\n", "\n", ". ", " ", "")
CHUNK, OVERLAP, SEGMENT = 500, 50, 1400
SEGMENTS = ArrayType(StructType([StructField("text", StringType()), StructField("joiner", StringType())]))


def _cut(text: str, separator: str) -> list[str]:
    """The pieces of a text, each with the separator before it; characters for an empty separator."""
    if not separator:
        return list(text)
    first, *rest = text.split(separator)
    return [p for p in (first, *(separator + r for r in rest)) if p]


def _packed(pieces: list[str], size: int, overlap: int) -> list[str]:
    """Neighbouring pieces joined up to size, white space off; the last ones, of overlap characters at most, are repeated in the next chunk."""
    out, held, total = [], deque(), 0
    for p in pieces:
        if held and total + len(p) > size:
            out.append("".join(held).strip())
            while total > overlap or (total and total + len(p) > size):
                total -= len(held.popleft())
        held.append(p)
        total += len(p)
    out.append("".join(held).strip())
    return [c for c in out if c]


def chunks(text: str | None, size: int = CHUNK, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks by the first separator of the ladder that a text holds; pieces of size or more by the next ones.

    A piece for which no separator is left stays whole.
    """
    out: list[str] = []
    todo: list[tuple[str, int] | list[str]] = [(text or "", 0)]
    while todo:
        now = todo.pop()
        if isinstance(now, list):
            out += _packed(now, size, overlap)
            continue
        piece, at = now
        if at == len(separators):
            out.append(piece)
            continue
        while at < len(separators) - 1 and separators[at] and separators[at] not in piece:
            at += 1
        left = len(separators) if not separators[at] or separators[at] not in piece else at + 1
        later: list[tuple[str, int] | list[str]] = []
        short: list[str] = []
        for p in _cut(piece, separators[at]):
            if len(p) < size:
                short.append(p)
                continue
            if short:
                later.append(short)
                short = []
            later.append((p, left))
        if short:
            later.append(short)
        todo += reversed(later)
    return out


def _hard(text: str, size: int) -> list[str]:
    """Pieces of size at most, cut at the last blank unless it stands in the first third."""
    out, at = [], 0
    while len(text) - at > size:
        blank = text.rfind(" ", at, at + size)
        cut = blank if blank - at >= size // 3 else at + size
        out.append(text[at:cut])
        at = cut
        while at < len(text) and text[at].isspace():
            at += 1
    return [p for p in [*out, text[at:]] if p]


def _sentences(text: str, size: int) -> list[str]:
    """Sentences joined by blanks up to size; longer ones are cut."""
    parts = re.split(r"(?<=[.!?])\s+", text)
    if len(parts) == 1:
        return _hard(text, size)
    out, held, total = [], [], 0

    def flush() -> None:
        nonlocal held, total
        if held:
            out.append(" ".join(held))
        held, total = [], 0

    for p in (p.strip() for p in parts):
        if not p:
            continue
        if len(p) > size:
            flush()
            out.extend(_hard(p, size))
            continue
        if held and total + 1 + len(p) > size:
            flush()
        total += len(p) + bool(held)
        held.append(p)
    flush()
    return out


def segments(text: str | None, size: int = SEGMENT) -> list[tuple[str, str]]:
    """(text, joiner): paragraphs joined up to size, longer ones by sentences; the joiner stands between a segment and what follows.

    Paragraphs that are joined keep the break between them, the first two as well.
    """
    raw = text or ""
    if len(raw) <= size:
        return [(raw, "")]
    pieces = re.split(r"(\n\s*\n)", raw)
    out: list[tuple[str, str]] = []
    held, joiner = "", ""

    def flush() -> None:
        nonlocal held, joiner
        if held:
            out.append((held, joiner))
        held, joiner = "", ""

    for k in range(0, len(pieces), 2):
        piece, after = pieces[k], pieces[k + 1] if k + 1 < len(pieces) else ""
        if not piece.strip() and not after:
            continue
        if len(piece) > size:
            flush()
            parts = _sentences(piece, size)
            out += [(p, after if n == len(parts) - 1 else " ") for n, p in enumerate(parts)]
            continue
        joined = held + joiner + piece if held else piece
        if len(joined) <= size:
            joiner = after or (joiner if held else "")
            held = joined
        else:
            flush()
            held, joiner = piece, after
    flush()
    return out or [(raw, "")]


def recursive_chunks(c: Column, size: int = CHUNK, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> Column:
    """Array of chunks; null and blank texts have none."""

    @F.pandas_udf(ArrayType(StringType()))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: chunks(t, size, overlap, separators))

    return run(c)


def text_segments(c: Column, size: int = SEGMENT) -> Column:
    """Array of (text, joiner)."""

    @F.pandas_udf(SEGMENTS)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"text": a, "joiner": b} for a, b in segments(t, size)])

    return run(c)
