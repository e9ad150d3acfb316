"""Ranked lexical search over a sharded index with variable blocks.

``build_index`` makes the index without a shuffle: a task reads its documents, and every SHARD_TOKENS terms it closes a shard, in which
documents are numbered in the order of their ids. A shard has for each term the postings (document, impact), where impact is the part of
the score that doesn't depend on the query. Each list is cut into blocks of variable length, and a block keeps its greatest impact,
which bounds all its documents. Dynamic programming chooses the ends: of all cuts into blocks of up to BLOCK_PARTS
parts of PART postings it takes the one with the least sum over postings of (bound - impact), plus BLOCK_COST a block. All
lists of a shard go through it together, one part a step. One more row for each shard holds its ids.

``search`` then looks, shard by shard, for the k best documents of each query, exactly. The ends of all blocks
of the query's lists cut the shard into ranges of documents; a range's bound is the sum of weight * greatest impact of the
blocks over it, which is the pivot test of WAND, done for all ranges at once. Ranges are scored from the highest bound down,
and only the blocks over them are read; once the next bound is below the k-th best score so far, nothing is left that could enter. A bound equal
to that score is still looked at, as ties go by id. The k-th scores over SEED_SHARDS shards are where the other shards start, so
that few of their documents leave them. The lists of k are then merged by a window, of which Spark keeps k rows per task and query before the shuffle.

Queries are a stated set, searched in blocks of BLOCK_TERMS terms; a block's terms and weights are what is broadcast.

Terms are compared by 64-bit hashes. Defined cases: null texts and texts without terms are no part of the counts and are found by nothing; a query without terms has
no rows. Repeated rows are documents of their own. A null id comes after all others. Weights of terms that all documents hold are 0, so that a query of such terms
finds nothing. Extra columns aren't read. A text of more than SHARD_TOKENS terms ends its shard; a task's memory grows with it. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import forget, written
from docloom.llm.shingles import PASS_BYTES, word_hashes

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
K = 50
SHARD_TOKENS = 2_000_000
PART, BLOCK_PARTS = 8, 32
BLOCK_COST = 4_000_000
SEED_SHARDS = 4
BLOCK_TERMS = 200_000
#: Ranges of the first step of a search; each further step takes twice as many.
FIRST_RANGES = 64
INDEX = "shard long, term long, df int, docs array<int>, impacts array<int>, ends array<int>, tops array<int>"


def _folded() -> np.ndarray:
    """Bytes of terms as they are (A-Z lower-cased), all others a blank."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    for a, b in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
        table[a : b + 1] = 0x20
    return table


_FOLDED = _folded()


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts, and where each begins and the last ends."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8), offsets


def _passes(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The folded bytes of some texts laid end to end, and where each begins and the last ends; bounded bytes at a time."""
    data, offsets = _bytes(texts)
    row = 0
    while row < len(texts):
        last = min(len(texts), max(row + 1, int(np.searchsorted(offsets, offsets[row] + PASS_BYTES, "right")) - 1))
        yield _FOLDED[data[offsets[row] : offsets[last]]], offsets[row : last + 1] - offsets[row]
        row = last


def term_counts(texts: pa.Array) -> Iterator[np.ndarray]:
    """The number of terms of each text, as term_hashes() finds them."""
    for data, bounds in _passes(texts):
        solid = data != 0x20
        begins = solid.copy()
        begins[1:] &= ~solid[:-1]
        first = bounds[:-1][bounds[:-1] < len(data)]
        begins[first] = solid[first]  # a text's first byte follows no other
        yield np.diff(np.concatenate([[0], np.cumsum(begins)])[bounds])


def term_hashes(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The hashes of the terms of some texts laid end to end, and the number of each text's terms."""
    with np.errstate(over="ignore"):
        for data, bounds in _passes(texts):
            hashes, first = word_hashes(data, bounds)
            yield hashes.view(np.int64), np.diff(first)


def _spans(begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers from each begin up to its end, one after another."""
    sizes = ends - begins
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    jumps = np.repeat(begins - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    return jumps + np.arange(total)


def block_ends(impacts: np.ndarray, begins: np.ndarray, sizes: np.ndarray, cost: int = BLOCK_COST, part: int = PART, parts: int = BLOCK_PARTS) -> tuple[np.ndarray, np.ndarray]:
    """The cut of each list with the least bound error: (list, end within the list), in order.

    begins and sizes: where each list stands in impacts, one after another. Lists are sorted by their number of parts, so those that are still
    open at a step are the first ones.
    """
    n_parts = -(-sizes // part)
    where = np.concatenate([[0], np.cumsum(n_parts)])
    nth = np.arange(where[-1]) - np.repeat(where[:-1], n_parts)
    top = np.maximum.reduceat(impacts, np.repeat(begins, n_parts) + nth * part).astype(np.int64) if len(nth) else np.zeros(0, np.int64)
    held = np.minimum(part, np.repeat(sizes, n_parts) - nth * part)
    order = np.argsort(-n_parts, kind="stable")
    long = n_parts[order]
    offset = np.concatenate([[0], np.cumsum(long)])
    moved = _spans(where[order], where[order] + long)
    top, held = top[moved], held[moved]
    # best[offset + list + j]: least sum of bound * postings over the first j parts
    base = offset[:-1] + np.arange(len(long))
    best, took = np.zeros(offset[-1] + len(long), np.int64), np.zeros(offset[-1] + len(long), np.int64)
    for j in range(1, int(long[0]) + 1 if len(long) else 0):
        open_lists = int(np.searchsorted(-long, -j, "right"))
        back = np.arange(min(parts, j))
        here = (offset[:open_lists] + j - 1)[:, None] - back
        bound = np.maximum.accumulate(top[here], axis=1) * np.cumsum(held[here], axis=1)
        total = bound + best[(base[:open_lists] + j - 1)[:, None] - back] + cost
        least = total.argmin(axis=1)
        best[base[:open_lists] + j] = total[np.arange(open_lists), least]
        took[base[:open_lists] + j] = least + 1
    lists, ends = [], []
    place, rows = long.copy(), np.arange(len(long))
    while len(rows):
        lists.append(order[rows])
        ends.append(np.minimum(place[rows] * part, sizes[order[rows]]))
        place[rows] -= took[base[rows] + place[rows]]
        rows = rows[place[rows] > 0]
    if not lists:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    which, end = np.concatenate(lists), np.concatenate(ends)
    sort = np.lexsort((end, which))
    return which[sort], end[sort]


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(values.astype(np.int32)))


def make_shard(number: int, ids: pa.Array, hashes: np.ndarray, counts: np.ndarray, n_docs: int, n_terms: int) -> pa.RecordBatch:
    """The rows of one shard: its terms' lists, and its ids in the row whose term is null."""
    order = pc.sort_indices(ids).to_numpy()  # nulls come last
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    doc = np.repeat(rank, counts)
    sort = np.lexsort((doc, hashes))
    h, doc = hashes[sort], doc[sort]
    begin = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])) if len(h) else np.zeros(0, np.int64)
    tf = np.diff(np.concatenate([begin, [len(h)]]))
    h, doc = h[begin], doc[begin]
    size = counts[order][doc].astype(np.int64)
    m = 100 - 50 + (50 * size * n_docs) // n_terms
    impact = (1_000_000_000 * tf) // (1000 * tf + 20 * m)
    term_at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    sizes = np.diff(np.concatenate([term_at, [len(h)]]))
    which, end = block_ends(impact, term_at, sizes)
    n_blocks = np.bincount(which, minlength=len(sizes))
    absolute = term_at[which] + end
    starts = np.concatenate([[0], absolute[:-1]])
    top = np.maximum.reduceat(impact, starts) if len(starts) and len(impact) else np.zeros(0, np.int64)
    n = len(sizes)
    none = np.zeros(1, np.int64)
    columns = {
        "shard": pa.array(np.full(n + 1, number)),
        "term": pa.concat_arrays([pa.array(h[term_at]), pa.nulls(1, pa.int64())]),
        "df": pa.array(np.concatenate([sizes, none]).astype(np.int32)),
        "docs": _lists(doc, np.concatenate([sizes, none])),
        "impacts": _lists(impact, np.concatenate([sizes, none])),
        "ends": _lists(end, np.concatenate([n_blocks, none])),
        "tops": _lists(top, np.concatenate([n_blocks, none])),
        "ids": pa.ListArray.from_arrays(np.concatenate([np.zeros(n + 1), [len(ids)]]).astype(np.int32), ids.take(pa.array(order))),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def build_index(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> tuple[DataFrame, int, int]:
    """The written index, the number of documents with a term, and that of all their terms."""
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = terms = 0
        for batch in batches:
            for c in term_counts(batch.column("text")):
                docs, terms = docs + int(np.count_nonzero(c)), terms + int(c.sum())
        yield pa.RecordBatch.from_arrays([pa.array([docs]), pa.array([terms])], ["docs", "terms"])

    totals = rows.select("text").mapInArrow(count, "docs long, terms long").agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).first()
    n_docs, n_terms = totals.docs or 0, totals.terms or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, hashes, counts, tokens = [], [], [], 0
        for batch in batches:
            row = 0
            for h, c in term_hashes(batch.column("text")):
                ids.append(batch.column("id").slice(row, len(c)))
                hashes.append(h)
                counts.append(c)
                tokens += len(h)
                row += len(c)
                if tokens >= shard_tokens:
                    yield make_shard(number, pa.concat_arrays(ids), np.concatenate(hashes), np.concatenate(counts), n_docs, n_terms)
                    ids, hashes, counts, tokens, number = [], [], [], 0, number + 1
        if tokens:
            yield make_shard(number, pa.concat_arrays(ids), np.concatenate(hashes), np.concatenate(counts), n_docs, n_terms)

    kind = rows.schema["id"].dataType.simpleString()
    return written(rows.mapInArrow(run, f"{INDEX}, ids array<{kind}>"), "search-index"), n_docs, n_terms


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, id, terms): a number for each row, and its distinct terms' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for h, c in term_hashes(batch.column("text")):
                found += [np.unique(x) for x in np.split(h, np.cumsum(c)[:-1])]
            terms = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32), pa.array(np.concatenate([*found, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([batch.column("id"), terms], ["id", "terms"])

    kind = queries.schema[id_col].dataType.simpleString()
    rows = queries.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, terms array<long>")
    return written(rows.select(F.monotonically_increasing_id().alias("item"), "id", "terms").filter("size(terms) > 0"), "queries")


class Shard:
    """A shard's lists of the terms that are asked for."""

    def __init__(self, rows: pa.Table) -> None:
        head = pc.is_null(rows["term"])
        self.ids = rows.filter(head)["ids"].combine_chunks().flatten()
        rows = rows.filter(pc.invert(head)).combine_chunks()
        flat = lambda c: rows[c].combine_chunks().flatten().to_numpy().astype(np.int64)
        edges = lambda c: np.concatenate([[0], np.cumsum(pc.list_value_length(rows[c]).to_numpy())]).astype(np.int64)
        term = rows["term"].to_numpy()
        self.order = np.argsort(term)
        self.terms = term[self.order]
        self.docs, self.impacts, self.tops = flat("docs"), flat("impacts"), flat("tops")
        posting, self.block = edges("docs"), edges("ends")
        self.end = flat("ends") + np.repeat(posting[:-1], np.diff(self.block))
        self.begin = np.concatenate([[0], self.end[:-1]])[: len(self.end)]
        self.first, self.last = self.docs[self.begin], self.docs[self.end - 1]

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of the k best that reach the floor, best first."""
        empty = np.zeros(0, np.int64)
        if not len(self.terms):
            return empty, empty
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        held = (self.terms[at] == terms) & (weights > 0)
        rows, weights = self.order[at[held]], weights[held]
        if not len(rows):
            return empty, empty
        blocks = _spans(self.block[rows], self.block[rows + 1])
        weight = np.repeat(weights, self.block[rows + 1] - self.block[rows])
        first, after = self.first[blocks], self.last[blocks] + 1
        edges = np.unique(np.concatenate([first, after]))
        change = np.zeros(len(edges), np.int64)
        np.add.at(change, np.searchsorted(edges, first), weight * self.tops[blocks])
        np.subtract.at(change, np.searchsorted(edges, after), weight * self.tops[blocks])
        bounds = np.cumsum(change)[:-1]
        order = np.argsort(-bounds, kind="stable")
        falling = -bounds[order]
        scores = np.zeros(len(self.ids), np.int64)
        least, done, step = max(floor, 1), 0, FIRST_RANGES
        while done < len(order):
            upto = min(done + step, int(np.searchsorted(falling, -least, "right")))
            if upto <= done:
                break
            now = np.sort(order[done:upto])
            low, high = edges[now], edges[now + 1]
            near = np.minimum(np.searchsorted(high, first, "right"), len(now) - 1)
            read = (low[near] < after) & (high[near] > first)
            postings = _spans(self.begin[blocks[read]], self.end[blocks[read]])
            docs = self.docs[postings]
            place = np.minimum(np.searchsorted(high, docs, "right"), len(now) - 1)
            inside = (low[place] <= docs) & (docs < high[place])
            gains = np.repeat(weight[read], self.end[blocks[read]] - self.begin[blocks[read]]) * self.impacts[postings]
            np.add.at(scores, docs[inside], gains[inside])
            done, step = upto, step * 2
            if np.count_nonzero(scores >= least) >= k:
                least = max(least, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
        found = np.flatnonzero(scores >= least)
        found = found[np.lexsort((found, -scores[found]))][:k]
        return found, scores[found]


def _best(index: DataFrame, items: list, weights: dict[int, int], floors: dict[int, int], k: int) -> DataFrame:
    """(item, doc_id, score): at most k of each shard and item."""
    spark = index.sparkSession
    asked = [(r.item, np.array(r.terms, np.int64), np.array([weights.get(t, 0) for t in r.terms], np.int64), floors.get(r.item, 0)) for r in items]
    shared = spark.sparkContext.broadcast(asked)
    terms = spark.createDataFrame([(t,) for t in weights], "term long")
    lists = index.join(F.broadcast(terms), "term", "left_semi")  # BLOCK_TERMS rows at most
    rows = lists.unionByName(index.filter("term is null"))

    def run(table: pa.Table) -> pa.Table:
        shard = Shard(table)
        item, doc, score = [], [], []
        for number, wanted, weight, floor in shared.value:
            found, points = shard.search(wanted, weight, k, floor)
            item.append(np.full(len(found), number, np.int64))
            doc.append(found)
            score.append(points)
        return pa.table({"item": np.concatenate(item), "doc_id": shard.ids.take(pa.array(np.concatenate(doc))), "score": np.concatenate(score)})

    kind = index.schema["ids"].dataType.elementType.simpleString()
    return rows.groupBy("shard").applyInArrow(run, f"item long, doc_id {kind}, score long")


def _merged(found: DataFrame, k: int) -> DataFrame:
    first = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)


def search(index: DataFrame, n_docs: int, asked: DataFrame, k: int = K, seed_shards: int = SEED_SHARDS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item, rank, doc_id, score) of the k best documents of each query of query_terms()."""
    total = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, -(-total // block_terms))
    seeds = [r.shard for r in index.filter("term is null").select("shard").orderBy(F.xxhash64("shard"), "shard").limit(seed_shards + 1).collect()]
    out = None
    for b in range(blocks):
        mine = asked.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)
        items = mine.select("item", "terms").collect()  # about block_terms terms
        terms = mine.select(F.explode("terms").alias("term")).distinct()
        counts = index.filter("term is not null").select("term", "df").join(F.broadcast(terms), "term").groupBy("term").agg(F.sum("df").alias("df"))
        weights = {r.term: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r.df + 1))) for r in counts.collect()}
        floors = {}
        if len(seeds) > seed_shards:
            tried = _merged(_best(index.filter(F.col("shard").isin(seeds[:seed_shards])), items, weights, {}, k), k)
            floors = {r.item: r.score for r in tried.filter(F.col("rank") == k).collect()}
        part = _merged(_best(index, items, weights, floors, k), k)
        out = part if out is None else out.unionByName(part)
    return out.select("item", "rank", "doc_id", "score")


def ranked(documents: DataFrame, queries: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text", shard_tokens: int = SHARD_TOKENS, seed_shards: int = SEED_SHARDS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """The k best documents of each query: the query's id, rank, doc_id, score."""
    index, n_docs, _ = build_index(documents, id_col, text_col, shard_tokens)
    asked = query_terms(queries, query_id, query_text)
    found = written(search(index, n_docs, asked, k, seed_shards, block_terms), "ranked")
    forget(index)
    return found.join(asked.select("item", F.col("id").alias(query_id)), "item").select(query_id, "rank", "doc_id", "score")
