"""Many phrases in one pass: a bank of phrases as one tree-shaped pattern, sentences, and the text of chosen sections.

The pattern branches by letters, so at a place in the text only the phrases with the letters read so far are still open: its time
hardly grows with the number of phrases. At each place the longest phrase is found; phrases that begin
others are in a pattern of their own (a layer), so that all are found, overlapping ones too.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions import structure
from docloom.functions.text import TOKEN, normalize_space

#: What may not stand beside a whole phrase.
WORD = r"[\p{L}\p{N}_]"
# Where a sentence ends, its least number of words and the length at which evidence is cut.
SENTENCE_END = r"(?U)(?<=[.!?])\s+|\n(?=\s*(?:[-*•]|\d+[.)]|[A-Z][A-Za-z ]{2,}:))|\n{2,}"
SENTENCE_WORDS = 3
EVIDENCE_CUT = 450


def _tree(phrases: Iterable[str]) -> str:
    """A pattern that matches the longest of the phrases."""
    tree: dict = {}
    for p in phrases:
        node = tree
        for c in p:
            node = node.setdefault(c, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        rest = [re.escape(c) + pattern(n) for c, n in sorted(node.items()) if c]
        if not rest:
            return ""
        body = rest[0] if len(rest) == 1 and "" not in node else "(?:" + "|".join(rest) + ")"
        return body + ("?" if "" in node else "")

    return pattern(tree)


def layers(phrases: Iterable[str]) -> list[list[str]]:
    """The phrases in lists of which none begins another of its list, the longest first."""
    out: list[list[str]] = []
    depth: dict[str, int] = {}
    for p in sorted({p.lower() for p in phrases if p}, key=lambda p: (-len(p), p)):
        depth[p] = max((d + 1 for q, d in depth.items() if q.startswith(p)), default=0)
        if depth[p] == len(out):
            out.append([])
        out[depth[p]].append(p)
    return out


def found(lower_text: Column, phrases: Iterable[str], whole: bool = True, endings: str = "") -> Column:
    """The phrases that a lower-case text holds, each as often as it stands there; as whole words, or anywhere. endings: a pattern that may follow a phrase."""
    before, after = (f"(?<!{WORD})", f"{endings}(?!{WORD})") if whole else ("", endings)
    # a place is looked at only where a first letter stands
    first = lambda layer: "(?=[" + "".join(sorted({re.escape(p[0]) for p in layer})) + "])"
    parts = [F.regexp_extract_all(lower_text, F.lit(f"{first(layer)}{before}(?=({_tree(layer)}){after})"), F.lit(1)) for layer in layers(phrases)]
    return F.flatten(F.array(*parts)) if parts else F.array().cast("array<string>")


def any_of(lower_text: Column, phrases: Iterable[str]) -> Column:
    """Whether a lower-case text holds one of the phrases, anywhere."""
    phrases = [p.lower() for p in phrases if p]
    return lower_text.rlike(_tree([p for p in phrases if not any(q != p and p.startswith(q) for q in phrases)])) if phrases else F.lit(False)


def sentence_list(c: Column) -> Column:
    """Sentences of three words or more, white space squeezed: they end after . ! ? before white space, at blank lines, and before lines that begin an item or a label."""
    parts = F.transform(F.split(c, SENTENCE_END), lambda s: normalize_space(s))
    return F.filter(parts, lambda s: F.size(F.split(s, " ")) >= SENTENCE_WORDS)


def let(value: Column, body) -> Column:
    """body(value) with value worked out once, however often body names it, in a lambda too."""
    return F.transform(F.array(value), body)[0]


def scoped_text(text: Column, heads: Column, labels: Iterable[str], least_words: int) -> Column:
    """The text of the sections of these labels, one after another; null if it has fewer than least_words words. heads: structure.headings(text)."""
    wanted = F.array(*map(F.lit, labels))

    def content(h: Column) -> Column:
        lines = F.split(text, structure.LINE_BREAK)
        ends = F.concat(F.transform(F.slice(h, 2, F.size(h)), lambda x: x["line"] - 1), F.array(F.size(lines) - 1))
        parts = F.zip_with(h, ends, lambda x, e: F.when(F.array_contains(wanted, x["label"]), structure.strip(F.array_join(F.slice(lines, x["line"] + 1, e - x["line"] + 1), "\n"))))
        return F.array_join(F.array_compact(parts), "\n")

    return let(let(heads, lambda h: F.when(F.exists(h, lambda x: F.array_contains(wanted, x["label"])), content(h))), lambda t: F.when(F.regexp_count(t, F.lit(TOKEN)) >= least_words, t))
