"""Document trees (nested JSON of typed nodes): text, sections, editable nodes, patches.

A tree is {"type": "doc", "content": [...]} with headings, paragraphs, lists, tables and text
nodes at any depth. Spark has no recursive type, so a small walk per row in Arrow batches
turns a tree into flat columns; what follows is DataFrame work.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

LEAVES = ("paragraph", "heading", "codeBlock")


def _rows(**fields) -> ArrayType:
    return ArrayType(StructType([StructField(k, t()) for k, t in fields.items()]))


BLOCK = _rows(path=StringType, type=StringType, level=IntegerType, block_id=StringType, text=StringType)
SECTION = _rows(name=StringType, level=IntegerType, text=StringType)
NODE = _rows(path=StringType, text=StringType)


def readable(raw: str | None) -> dict | None:
    """The tree; null where the text is null, no JSON object or nested too deep for the JSON reader."""
    try:
        tree = json.loads(raw or "")
    except (ValueError, RecursionError):
        return None
    return tree if isinstance(tree, dict) else None


def parse(raw: str | None) -> dict:
    """The tree, or an empty one where there is none that can be read."""
    return readable(raw) or {}


def kids(node: dict) -> list[tuple[int, dict]]:
    content = node.get("content")
    return [(i, c) for i, c in enumerate(content) if isinstance(c, dict)] if isinstance(content, list) else []


def walk(node: dict, path: tuple = ()) -> Iterator[tuple[tuple, dict]]:
    """Every node with its path, in document order; without recursion, so depth costs no stack."""
    todo = [(path, node)]
    while todo:
        at, now = todo.pop()
        yield at, now
        todo.extend(((*at, i), c) for i, c in reversed(kids(now)))


def inner_text(node: dict) -> str:
    return "".join(n.get("text") or "" for _, n in walk(node) if n.get("type") == "text")


def blocks_of(tree: dict) -> list[dict]:
    return [
        {"path": ".".join(map(str, p)), "type": n["type"], "level": int((n.get("attrs") or {}).get("level") or 0), "block_id": (n.get("attrs") or {}).get("block-id"), "text": " ".join(inner_text(n).split())}
        for p, n in walk(tree)
        if n.get("type") in LEAVES
    ]


def sections_of(tree: dict, merge: bool) -> list[dict]:
    """Text under its last heading; equal headings are one section if merge is set."""
    out: list[dict] = []
    now = {"name": "General", "level": 0, "text": ""}
    for b in blocks_of(tree):
        if b["type"] == "heading" and b["text"]:
            same = [s for s in out if s["name"] == b["text"]] if merge else []
            now = same[0] if same else {"name": b["text"], "level": b["level"], "text": ""}
        elif b["text"]:
            now["text"] = (now["text"] + "\n" + b["text"]).strip()
        if not any(s is now for s in out):
            out.append(now)  # where it is first seen
    return [s for s in out if s["text"]]


def patched(tree: dict, patches: dict[str, str]) -> dict:
    """New texts for text nodes by their path; blank texts and unknown paths change nothing."""
    for p, n in walk(tree):
        new = patches.get(".".join(map(str, p)))
        if n.get("type") == "text" and new and new.strip():
            n["text"] = new
    return tree


def pruned(node: dict) -> dict:
    """Without empty text nodes and without the paragraphs that this leaves empty, innermost first."""
    for _, n in reversed(list(walk(node))):
        if "content" in n:
            n["content"] = [c for _, c in kids(n) if not (c.get("type") == "text" and not c.get("text")) and not (c.get("type") == "paragraph" and not c.get("content"))]
    return node


@F.pandas_udf(StringType())
def tree_text(trees: pd.Series) -> pd.Series:
    """Paragraphs, headings and list items, one per line."""
    return trees.map(lambda t: "\n".join(b["text"] for b in blocks_of(parse(t)) if b["text"]))


@F.pandas_udf(BLOCK)
def tree_blocks(trees: pd.Series) -> pd.Series:
    return trees.map(lambda t: blocks_of(parse(t)))


@F.pandas_udf(SECTION)
def tree_sections(trees: pd.Series) -> pd.Series:
    return trees.map(lambda t: sections_of(parse(t), merge=False))


@F.pandas_udf(SECTION)
def tree_sections_merged(trees: pd.Series) -> pd.Series:
    return trees.map(lambda t: sections_of(parse(t), merge=True))


@F.pandas_udf(NODE)
def text_nodes(trees: pd.Series) -> pd.Series:
    """The editable text nodes."""
    return trees.map(lambda t: [{"path": ".".join(map(str, p)), "text": n.get("text") or ""} for p, n in walk(parse(t)) if n.get("type") == "text"])


#: Nodes that a rewrite in plain text leaves in place, and how much of a rewrite is taken over.
PRESERVED = ("table", "bulletList", "orderedList", "heading")
MAX_LINES, MAX_LINE = 120, 1200


def fingerprints(tree: dict) -> list[list[int]]:
    """For each table the number of cells of each of its rows."""
    tables = [[len(kids(r)) for _, r in kids(n) if r.get("type") == "tableRow"] for _, n in walk(tree) if n.get("type") == "table"]
    return [t for t in tables if t]


def merged(raw: str | None, text: str | None, append: bool) -> str | None:
    """A tree with a text's lines as paragraphs: after all that is there, or in its place but for tables, lists and headings if there are tables. A tree that can't be read comes back as it is."""
    tree = readable(raw)
    if tree is None:
        return raw
    lines = [x.strip() for x in re.split(r"[\r\n]+", text or "") if x.strip()][:MAX_LINES]
    new = [{"type": "paragraph", "content": [{"type": "text", "text": x[:MAX_LINE]}]} for x in lines]
    old = [n for _, n in kids(tree)]
    if not append:
        old = [n for n in old if n.get("type") in PRESERVED] if any(n.get("type") == "table" for _, n in walk(tree)) else []
    try:
        return json.dumps(pruned({"type": "doc", "content": old + new}) if old or new else {"type": "doc", "content": [{"type": "paragraph"}]}, ensure_ascii=False)
    except RecursionError:
        return raw


def structure_fault(before: str | None, after: str | None) -> str | None:
    """Why a patched tree isn't taken: its tables changed, or under half of its blocks or 40 % of its texts are left; null if it is."""
    old, new = parse(before), parse(after)
    count = lambda t: sum(n.get("type") == "text" for _, n in walk(t))
    if fingerprints(old) != fingerprints(new):
        return "tables"
    blocks, texts = len(old.get("content") or []), count(old)
    if blocks and len(new.get("content") or []) < max(1, blocks // 2):
        return "blocks"
    return "texts" if texts and count(new) < max(1, int(texts * 0.4)) else None


@F.pandas_udf(ArrayType(ArrayType(IntegerType())))
def table_fingerprints(trees: pd.Series) -> pd.Series:
    return trees.map(lambda t: fingerprints(parse(t)))


@F.pandas_udf(IntegerType())
def text_node_count(trees: pd.Series) -> pd.Series:
    return trees.map(lambda t: sum(n.get("type") == "text" for _, n in walk(parse(t))))


@F.pandas_udf(StringType())
def merge_text(trees: pd.Series, texts: pd.Series, append: pd.Series) -> pd.Series:
    """Trees with a plain text taken over; append is a boolean column."""
    return pd.Series([merged(t, x, bool(a)) for t, x, a in zip(trees, texts, append, strict=True)], dtype=object)


@F.pandas_udf(StringType())
def structure_faults(before: pd.Series, after: pd.Series) -> pd.Series:
    return pd.Series([structure_fault(a, b) for a, b in zip(before, after, strict=True)], dtype=object)


@F.pandas_udf(StringType())
def apply_patches(trees: pd.Series, patches: pd.Series) -> pd.Series:
    """Patches are an array of (path, text) structs. A tree that can't be read comes back as it is."""

    def done(raw: str | None, given) -> str | None:
        tree = readable(raw)
        if tree is None:
            return raw
        try:
            return json.dumps(pruned(patched(tree, {x["path"]: x["text"] for x in (given if given is not None else [])})), ensure_ascii=False)
        except RecursionError:
            return raw

    return pd.Series([done(t, p) for t, p in zip(trees, patches, strict=True)])
