"""N-gram Jaccard join by a token-group matrix.

A document's set holds the hashes of its distinct word shingles. Equal sets are one
node. The steps:

1. Each node's *l-prefix*: its smallest hashes, so many that two sets of the wanted
   similarity have l of them in common (l grows with the set). A node with too few
   prefix tokens that any other node has can't have a partner and is set aside.
2. The others are dealt into groups of similar nodes (by the token that they share with
   most other nodes, split so that groups stay small), and the matrix keeps for each group
   the union of its members' prefix tokens.
3. A node's overlap with a group's union bounds its overlap with every member, so
   only groups that reach the needed overlap are opened.
4. Opened groups are verified exactly, over whole sets, in blocks of a group and a bounded
   number of queries: a block gives each query's number of links and edges that span its links, never all pairs.
5. Components come from the edges by label propagation.

No bucket is capped and nothing is approximate but for 64-bit hashes (128 bits for equal
sets). Defined cases: null or wordless texts have an empty set and link with
nothing; fewer words than a shingle make one shingle. Repeated rows and equal texts share a
node. component_id is the smallest doc_id of the component, null where none has an id.
An empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import forget, quoted, written
from docloom.llm.shingles import mix, shingle_sets

GROUP_SIZE = 256
#: Tokens of one group's members, which a task holds; a longer document is a group of its own.
GROUP_TOKENS = 4_000_000
#: Queries of one task's block, and their tokens; they are read one by one, only the group's members are held.
BLOCK_QUERIES = 512
BLOCK_TOKENS = 16_000_000


def prefix_need(n, percent: int):
    """l of the l-prefix scheme for sets of n tokens (int, array or Column expression string)."""
    return 1 + (n * (100 - percent) // 100 + 1) // 2


def sketch(documents: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, text_key, n, node, sig, toks (the l-prefix)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, node, sig, toks = [], [], [], []
            with np.errstate(over="ignore"):
                for s in shingle_sets(batch.column("text"), words):
                    n.append(len(s))
                    node.append(int(np.sum(mix(s ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64).view(np.int64)))
                    sig.append(int(np.sum(mix(s ^ np.uint64(0x14057B7EF767814F)), dtype=np.uint64).view(np.int64)))
                    toks.append(s[: len(s) * (100 - percent) // 100 + prefix_need(len(s), percent)].view(np.int64))
            lengths = np.concatenate([[0], np.cumsum([len(t) for t in toks])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(lengths, pa.array(np.concatenate([*toks, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(n, pa.int32()), pa.array(node, pa.int64()), pa.array(sig, pa.int64()), lists],
                ["doc_id", "text_key", "n", "node", "sig", "toks"],
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(
        run, f"doc_id {kind}, text_key long, n int, node long, sig long, toks array<long>"
    )


def full_sets(texts: DataFrame, words: int) -> DataFrame:
    """(node, copies, text) -> (node, copies, toks): the whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.view(np.int64) for s in shingle_sets(batch.column("text"), words)]
            lengths = np.concatenate([[0], np.cumsum([len(t) for t in sets])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(lengths, pa.array(np.concatenate([*sets, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("copies"), lists], ["node", "copies", "toks"])

    return texts.select("node", "copies", "text").mapInArrow(run, "node long, copies long, toks array<long>")


def shared_tokens(rows: DataFrame, percent: int) -> DataFrame:
    """The (token, node, n) whose token another node has too, of nodes that have enough of them."""
    common = rows.groupBy("token").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a < b").select("token")
    shared = written(rows.join(common, "token").distinct(), "shared-tokens")
    enough = shared.groupBy("node", "n").agg(F.count(F.lit(1)).alias("have")).filter(F.col("have") >= least_shared(percent)).select("node")
    out = written(shared.join(enough, "node"), "prefix")
    forget(shared)
    return out


def least_shared(percent: int) -> Column:
    """Prefix tokens that a set of n shares with any partner: l of the smallest partner."""
    return F.expr(f"1 + ((((n * {percent} + 99) div 100) * {100 - percent}) div 100 + 1) div 2")


def verify(blocks: DataFrame, percent: int) -> DataFrame:
    """Rows (grp, chunk, query, node, copies, toks), all of a block together -> (src, dst, links)."""

    def prepare(members: list) -> tuple:
        ids = np.array([m[0] for m in members])
        copies = np.array([m[1] for m in members])
        sizes = np.array([len(m[2]) for m in members])
        vocabulary, where = np.unique(np.concatenate([m[2] for m in members]), return_inverse=True)
        holder = np.repeat(np.arange(len(members)), sizes)[np.argsort(where, kind="stable")]
        begins = np.concatenate([[0], np.cumsum(np.bincount(where, minlength=len(vocabulary)))])
        return ids, copies, sizes, vocabulary, holder, begins, np.arange(len(members))

    def answer(group: tuple, node: int, toks: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """The query's first link with its number of links, and edges that join what it links."""
        ids, copies, sizes, vocabulary, holder, begins, label = group
        at = np.searchsorted(vocabulary, toks)
        at[at == len(vocabulary)] = 0
        at = at[vocabulary[at] == toks]
        counts = begins[at + 1] - begins[at]
        flat = np.repeat(begins[at] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        overlap = np.bincount(holder[flat], minlength=len(ids))
        linked = np.flatnonzero((100 * overlap >= percent * (len(toks) + sizes - overlap)) & (ids != node))
        if len(linked):
            yield node, int(ids[linked[0]]), int(copies[linked].sum())
            labels = np.unique(label[linked])
            for other in labels[1:]:
                yield int(ids[labels[0]]), int(ids[other]), 0
            if len(labels) > 1:
                label[np.isin(label, labels)] = labels[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members, group = None, [], None  # of a block the members come first
        for batch in batches:
            toks, found = batch.column("toks"), []
            offsets, values = toks.offsets.to_numpy(), toks.values.to_numpy(zero_copy_only=False)
            columns = [batch.column(c).to_pylist() for c in ("grp", "chunk", "query", "node", "copies")]
            for i, (grp, chunk, query, node, copies) in enumerate(zip(*columns, strict=True)):
                if (grp, chunk) != key:
                    key, members, group = (grp, chunk), [], None
                mine = values[offsets[i] : offsets[i + 1]]
                if not query:
                    members.append((node, copies, mine.copy()))
                    continue
                group = group or prepare(members)
                found.extend(answer(group, node, mine))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], ["src", "dst", "links"])

    return blocks.mapInArrow(run, "src long, dst long, links long")


def components(edges: DataFrame) -> DataFrame:
    """(src, dst) -> (node, label, old): the smallest node of each component, by min-label rounds with jumps."""
    both = written(edges.select("src", "dst").union(edges.select("dst", "src")).distinct(), "edges")
    labels = written(both.groupBy(F.col("src").alias("node")).agg(F.least(F.col("node"), F.min("dst")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("label").alias("near"))
        low = labels.join(near, "node").select("node", F.least("label", "near").alias("low"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("to"))
        new = written(low.join(jump, "low").select("node", F.least("low", "to").alias("label"), "old"), "labels")
        done = new.filter("label <> old").isEmpty()
        forget(labels)
        labels = new
        if done:
            forget(both)
            return labels


def link_edges(sketches: DataFrame, documents: DataFrame, classes: DataFrame, words: int, percent: int, group_size: int) -> DataFrame:
    """(src, dst, links) between nodes: spanning edges, and each node's number of linked documents.

    Each table on the way is deleted when the next one is written: the token tables are larger than the texts.
    """
    rows = sketches.select(F.explode("toks").alias("token"), "node", "n")
    some = shared_tokens(rows, percent)
    # of the nodes left, some shared a token only with nodes that are gone
    prefix = shared_tokens(some.select("token", "node", "n"), percent)
    forget(some)

    common = prefix.groupBy("token").agg(F.count(F.lit(1)).alias("held"))
    groups = prefix.join(common, "token").groupBy("node", "n").agg(F.max(F.struct("held", "token"))["token"].alias("lead"))
    sizes = groups.groupBy("lead").agg(F.ceil(F.greatest(F.count(F.lit(1)) / group_size, F.sum("n") / GROUP_TOKENS)).alias("parts"))
    members = written(
        groups.join(sizes, "lead").select("node", F.xxhash64("lead", F.pmod(F.xxhash64("node"), F.col("parts"))).alias("grp")), "groups"
    )
    matrix = prefix.join(members, "node").select("token", "grp").distinct()
    opened = (
        prefix.join(matrix, "token").groupBy("node", "n", "grp").agg(F.count(F.lit(1)).alias("have")).filter(F.col("have") >= least_shared(percent)).select("node", "n", "grp")
    )
    opened = written(opened, "opened")
    forget(prefix)
    chosen = classes.join(members.select("node"), "node", "left_semi").select("node", "copies", "doc_id", "text_key")
    texts = documents.select("doc_id", F.xxhash64("text").alias("text_key"), "text").alias("d").join(
        chosen.alias("c"), F.col("d.text_key").eqNullSafe(F.col("c.text_key")) & F.col("d.doc_id").eqNullSafe(F.col("c.doc_id"))
    )
    sets = written(full_sets(texts.select("c.node", "c.copies", "d.text"), words).dropDuplicates(["node"]), "sets")
    chunks = opened.groupBy("grp").agg(F.count(F.lit(1)).alias("queries"), F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_QUERIES, F.sum("n") / BLOCK_TOKENS)).cast("int").alias("parts"))
    chunks = written(chunks.filter("queries > 1"), "chunks")  # alone in its group's queries: only its own member
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    asked = opened.join(chunks, "grp").select("grp", part.alias("chunk"), F.lit(True).alias("query"), "node")
    held = members.join(chunks, "grp").select("grp", F.explode(F.expr("sequence(0, parts - 1)")).alias("chunk"), F.lit(False).alias("query"), "node")
    blocks = asked.union(held).join(sets, "node").select("grp", "chunk", "query", "node", "copies", "toks")
    ordered = blocks.repartition("grp", "chunk").sortWithinPartitions("grp", "chunk", "query")
    links = written(verify(ordered, percent), "links")
    for done in (members, sets, opened, chunks):
        forget(done)
    return links


def link_documents(documents: DataFrame, words: int = 5, percent: int = 80, group_size: int = GROUP_SIZE) -> DataFrame:
    """One row per document row: doc_id, text_key, n_shingles, component_id, n_links, component.

    Two documents link when 100 * |A and B| >= percent * |A or B|; n_links counts the
    other documents (rows) that a document links with. component tells components apart whose smallest
    doc_ids are equal; null for an empty set.
    """
    return link_tables(documents, words, percent, group_size)[0]


def link_tables(documents: DataFrame, words: int, percent: int, group_size: int = GROUP_SIZE) -> tuple[DataFrame, list[DataFrame]]:
    """link_documents's result and the scratch tables that it reads."""
    sketches = written(sketch(documents, words, percent), "sketches")
    some = sketches.filter("n > 0")
    classes = some.groupBy("node", "sig", "n").agg(F.min(F.struct("doc_id", "text_key")).alias("one"), F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    classes = written(classes.select("node", "first", "copies", "one.doc_id", "one.text_key"), "classes")
    edges = link_edges(some, documents, classes, words, percent, group_size)
    labels = components(edges)
    links = edges.groupBy(F.col("src").alias("node")).agg(F.sum("links").alias("links"))
    linked = written(labels.select("node", "label").join(links, "node", "left").join(classes.select("node", "first"), "node"), "linked")
    forget(edges)
    forget(labels)
    smallest = linked.groupBy("label").agg(F.min("first").alias("smallest"))
    known = linked.join(smallest, "label").select("node", "label", "smallest", "links")
    nodes = classes.join(known, "node", "left").select(
        "node",
        F.coalesce("smallest", "first").alias("component_id"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("label", "node").alias("component"),
    )
    empty = sketches.filter("n = 0").select("doc_id", "text_key", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component"))
    found = some.join(nodes, "node").select("doc_id", "text_key", F.col("n").cast("long").alias("n_shingles"), "component_id", "n_links", "component").union(empty)
    return found, [sketches, classes, linked]


def keep_one(documents: DataFrame, **settings) -> DataFrame:
    """One document of each component, in the columns they came with: that of the smallest doc_id.

    Documents without an id stay, as none of them can be told from another, and so do those with an empty set. Repeated
    rows of one doc_id in a component are one document: one row of the smallest text hash stays. Rows of
    one doc_id in two components are two documents, and both stay.
    """
    found, tables = link_tables(documents, **settings)
    keep = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "component", "text_key")
    keep = written(keep.groupBy("doc_id", "component", F.when(F.col("component").isNull() | F.col("doc_id").isNull(), F.col("text_key")).alias("own")).agg(F.min("text_key").alias("text_key"), F.count(F.lit(1)).alias("rows")), "kept")
    for done in tables:
        forget(done)
    best = written(keep.select("doc_id", "text_key").distinct(), "kept")
    same = F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & F.xxhash64("d.text").eqNullSafe(F.col("k.text_key"))
    kept = documents.alias("d").join(best.alias("k"), same, "left_semi").select(*[F.col(f"d.{c}") for c in quoted(documents)])
    again = written(keep.filter("rows > 1 and doc_id is not null").select("doc_id", "text_key").distinct(), "repeated")
    forget(keep)
    if again.isEmpty():
        return kept
    # only the few rows that may repeat are compared with each other
    same = (F.col("d.doc_id") == F.col("k.doc_id")) & (F.xxhash64("d.text") == F.col("k.text_key"))
    once = kept.alias("d").join(again.alias("k"), same).select("d.*", F.col("k.text_key").alias("__dl_key")).dropDuplicates(["doc_id", "__dl_key"]).drop("__dl_key")
    return kept.alias("d").join(again.alias("k"), same, "left_anti").unionByName(once)
