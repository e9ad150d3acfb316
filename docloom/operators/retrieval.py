"""BM25 over sections for many questions at once: an index of shards written once, searched shard by shard.

``build`` counts the terms of each section, deals its documents, as hashes of their terms, to runs of about RUN_TOKENS tokens and writes each run as
shards of SHARD_TOKENS: a shard is one row with its terms, their weights, their documents (numbered in the order of their ids) and their numbers in
these, each as the bytes of a numpy array, in a row group of its own, so that Spark's reader and writer hold a shard at a time and not a file of them.
Texts aren't shuffled, and a search reads none. ``search`` scores every document of a shard for a batch of questions:
terms of many documents by a product of matrices, the others by a count. A task keeps the k best of each question over all shards
of a run, so what is shuffled afterwards is k rows a question and run, in one packed row; it doesn't grow with the shards.

Weights are Okapi's with each section as a corpus: a term in more than half of the documents gets epsilon times the section's mean. Such a mean may be
negative, and the score with it. Every document of a section has a score, 0 without a common term, so lists are padded to k.

Defined cases: null texts are documents without terms; a question without terms gets the padding; a null section is a section of its own, and so is a null id's document
a document, which comes last of equals. Equal scores go by the greater id. An id may be a struct of the id and what later steps need of its document,
which then need no join. Extra columns aren't read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import space_terms
from docloom.session import written

SHARD_TOKENS = 1_000_000
#: Documents of a shard and of a run at most, for those with few tokens or none.
SHARD_DOCS = 100_000
RUN_DOCS = 2_000_000
#: Tokens of a run: what one task searches, shard by shard.
RUN_TOKENS = 16_000_000
#: A term in more than one of DENSE documents of a shard is a row of a matrix.
DENSE = 8
#: Questions that are scored together, and scores that a task holds at once.
BLOCK = 256
BATCH_SCORES = 1_000_000
#: Rows of a count that a task holds at once: terms of questions times their documents.
BATCH_HITS = 2_000_000
#: Documents of a shard that reach a question's k-th score beyond which equal ones are cut before they are sorted (the name is an older one's).
FIRST_RANGES = 160
#: Terms of the questions that one search broadcasts.
QUESTION_TERMS = 500_000
K1, B, EPSILON = 1.5, 0.75, 0.25
DIGITS = 6
#: A shard's columns of bytes.
BYTES = {"terms": np.int64, "idf": np.float64, "starts": np.int32, "docs": np.int32, "tf": np.int32, "sizes": np.int32}
#: A shard is some 5 MB. Parquet's writer would look at its size only after 100 rows, and its reader decodes up to 4,096 rows of a row group at once.
ROW_GROUPS = {"compression": "zstd", "parquet.block.size": "4194304", "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1", "parquet.enable.dictionary": "false"}


@dataclass(frozen=True)
class Index:
    postings: DataFrame


def _terms(text: Column) -> Column:
    return F.transform(space_terms(F.coalesce(text, F.lit(""))), lambda t: F.xxhash64(t))


def _shard(section: str | None, run: int, ids: pa.Array, tokens: np.ndarray, sizes: np.ndarray, mean: float, known: np.ndarray, idf: np.ndarray) -> pa.RecordBatch:
    """A shard of documents in the order of their ids; known and idf: the section's terms, sorted, and their weights."""
    doc = np.repeat(np.arange(len(ids)), sizes)
    sort = np.lexsort((doc, tokens))
    term, doc = tokens[sort], doc[sort]
    begin = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])])) if len(term) else np.zeros(0, np.int64)
    tf = np.diff(np.concatenate([begin, [len(term)]]))
    term, doc = term[begin], doc[begin]
    at = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
    columns = {
        "section": pa.array([section], pa.string()),
        "run": pa.array([run], pa.int64()),
        "mean": pa.array([mean], pa.float64()),
        "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
    }
    values = {"terms": term[at], "idf": idf[np.searchsorted(known, term[at])] if len(at) else np.zeros(0), "starts": np.concatenate([at, [len(term)]]), "docs": doc, "tf": tf, "sizes": sizes}
    columns |= {c: pa.array([values[c].astype(kind).tobytes()], pa.binary()) for c, kind in BYTES.items()}
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def build(docs: DataFrame, id_col: str = "doc_id", section_col: str = "source", text_col: str = "text", shard_tokens: int = SHARD_TOKENS, run_tokens: int = RUN_TOKENS) -> Index:
    """The index of all documents."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(section_col).cast("string").alias("section"), _terms(F.col(text_col)).alias("terms"))
    # documents and tokens of a section are counted under the null term
    named = rows.select("section", F.size("terms").cast("long").alias("n"), F.explode(F.concat(F.array_distinct("terms"), F.array(F.lit(None).cast("long")))).alias("term"))
    counts = written(named.groupBy("section", "term").agg(F.count(F.lit(1)).alias("df"), F.sum(F.when(F.col("term").isNull(), F.col("n"))).alias("tokens")), "terms")
    heads = counts.filter("term is null").select(F.col("section").alias("of"), F.col("df").alias("n_docs"), (F.col("tokens") / F.col("df")).alias("mean"), F.greatest(F.lit(1), F.ceil(F.col("tokens") / run_tokens), F.ceil(F.col("df") / RUN_DOCS)).cast("long").alias("runs"))
    heads = written(heads, "sections")
    raw = counts.filter("term is not null").join(heads, F.col("section").eqNullSafe(F.col("of"))).select("of", "runs", "mean", "term", (F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    low = raw.groupBy(F.col("of").alias("section")).agg(F.avg("raw").alias("low"))
    idf = raw.join(low, F.col("section").eqNullSafe(F.col("of"))).select("section", "runs", "mean", "term", F.when(F.col("raw") < 0, EPSILON * F.col("low")).otherwise(F.col("raw")).alias("idf"))
    packed = idf.groupBy("section", "runs", "mean", F.pmod("term", F.lit(64))).agg(F.collect_list(F.struct("term", "idf")).alias("v"))
    kind = rows.schema["id"].dataType.simpleString()
    weights = packed.select("section", F.explode(F.sequence(F.lit(0).cast("long"), F.col("runs") - 1)).alias("run"), F.lit(0).alias("kind"), F.lit(None).cast(kind).alias("id"), F.col("v.term").alias("terms"), F.col("v.idf").alias("idf"), "mean")
    placed = rows.join(heads, F.col("section").eqNullSafe(F.col("of"))).select("section", F.pmod(F.xxhash64("id"), F.col("runs")).alias("run"), F.lit(1).alias("kind"), "id", "terms", F.lit(None).cast("array<double>").alias("idf"), "mean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, mean, known, weight = None, 1.0, [], []
        ids, tokens, sizes, held = [], [], [], 0

        def shard() -> pa.RecordBatch:
            nonlocal known, weight, ids, tokens, sizes, held
            terms, idf = np.concatenate([np.zeros(0, np.int64), *known]), np.concatenate([np.zeros(0), *weight])
            order = np.argsort(terms)
            known, weight = [terms[order]], [idf[order]]
            out = _shard(*key, pa.concat_arrays(ids), np.concatenate([np.zeros(0, np.int64), *tokens]), np.concatenate(sizes), mean or 1.0, known[0], weight[0])
            ids, tokens, sizes, held = [], [], [], 0
            return out

        for batch in batches:
            keys = list(zip(batch.column("section").to_pylist(), batch.column("run").to_pylist(), strict=True))
            kinds, means = batch.column("kind").to_numpy(), batch.column("mean").to_numpy()
            lengths = pc.list_value_length(batch.column("terms")).to_numpy().astype(np.int64)
            flat = batch.column("terms").flatten().to_numpy()
            idf = batch.column("idf").flatten().to_numpy()  # null lists have none
            starts = np.concatenate([[0], np.cumsum(lengths)])
            at = np.concatenate([[0], np.cumsum(np.where(kinds == 0, lengths, 0))])
            for i, mine in enumerate(keys):
                if mine != key:
                    if ids:
                        yield shard()
                    key, mean, known, weight = mine, means[i], [], []
                if kinds[i] == 0:
                    known.append(flat[starts[i] : starts[i + 1]].copy())
                    weight.append(idf[at[i] : at[i + 1]].copy())
                    continue
                ids.append(batch.column("id").slice(i, 1))
                tokens.append(flat[starts[i] : starts[i + 1]])
                sizes.append(lengths[i : i + 1])
                held += int(lengths[i])
                if held >= shard_tokens or len(ids) >= SHARD_DOCS:
                    yield shard()
        if ids:
            yield shard()

    total = heads.agg(F.sum("runs")).first()[0] or 1
    parts = min(4 * max(total, spark.sparkContext.defaultParallelism), 2000)
    dealt = placed.unionByName(weights).repartition(parts, "section", "run").sortWithinPartitions(F.asc_nulls_first("section"), "run", "kind", F.asc_nulls_first("id"))
    schema = f"section string, run long, mean double, ids array<{kind}>, " + ", ".join(f"{c} binary" for c in BYTES)
    return Index(written(dealt.mapInArrow(run, schema), "postings", **ROW_GROUPS))


class Asked:
    """A block of questions: their numbers, and for each term of a question its place among the block's terms."""

    def __init__(self, rows: list) -> None:
        self.numbers = np.array([r.question for r in rows], np.int64)
        counted = [np.unique(np.array(r.terms, np.int64), return_counts=True) for r in rows]
        self.starts = np.concatenate([[0], np.cumsum([len(t) for t, _ in counted])])
        self.terms, self.place = np.unique(np.concatenate([t for t, _ in counted]), return_inverse=True)
        self.times = np.concatenate([n for _, n in counted])


class Best:
    """The k best of each question so far, by score, then position."""

    def __init__(self, questions: int, k: int) -> None:
        self.k = k
        self.scores, self.places = np.full((questions, k), -np.inf), np.full((questions, k), -1, np.int64)

    def take(self, first: int, scores: np.ndarray, offset: int) -> None:
        """Scores of the questions from first on, by document; documents are numbered from offset on."""
        k, n = self.k, scores.shape[1]
        least = self.scores[first : first + len(scores), k - 1].copy()
        new = np.isneginf(least)
        if n > k and new.any():
            least[new] = np.round(np.partition(scores[new], n - k, axis=1)[:, n - k], DIGITS)
        reach = scores >= (least - 0.6 * 10.0**-DIGITS)[:, None]  # what rounds to the k-th or more
        at = np.flatnonzero(reach)
        many = np.flatnonzero(np.bincount(at // n, minlength=len(reach)) > max(k, FIRST_RANGES))
        for q in many:  # equal scores: of those of the k-th, the last k will do
            value = np.round(scores[q], DIGITS)
            value = np.where(reach[q], value, -np.inf)
            kth = np.partition(value, n - k)[n - k]
            reach[q] = value > kth
            reach[q, np.flatnonzero(value == kth)[-k:]] = True
        at = np.flatnonzero(reach) if len(many) else at
        if not len(at):
            return
        q, doc = np.divmod(at, n)
        some = q[np.concatenate([[True], q[1:] != q[:-1]])]
        value = np.round(scores.ravel()[at], DIGITS) + 0.0
        q = np.concatenate([q, np.repeat(some, k)]) + first
        value = np.concatenate([value, self.scores[some + first].ravel()])
        place = np.concatenate([doc + offset, self.places[some + first].ravel()])
        order = np.lexsort((-place, -value, q))
        q, value, place = q[order], value[order], place[order]
        nth = np.arange(len(q)) - np.searchsorted(q, q, "left")
        keep = nth < k
        self.scores[q[keep], nth[keep]] = value[keep]
        self.places[q[keep], nth[keep]] = place[keep]


def _score(shard: dict, asked: Asked, best: Best, offset: int) -> int:
    """Scores a shard's documents for all questions; their number."""
    n, terms, starts, docs, tf = len(shard["sizes"]), shard["terms"], shard["starts"].astype(np.int64), shard["docs"], shard["tf"]
    impacts = tf * (K1 + 1) / (tf + (K1 * (1 - B + B * shard["sizes"] / shard["mean"]))[docs])
    row = np.searchsorted(terms, asked.terms)
    held = np.zeros(len(asked.terms), bool)
    held[row < len(terms)] = terms[row[row < len(terms)]] == asked.terms[row < len(terms)]
    size = np.zeros(len(asked.terms), np.int64)
    size[held] = starts[row[held] + 1] - starts[row[held]]
    common = np.flatnonzero(size > n / DENSE)
    matrix = np.zeros((len(common), n))
    for i, t in enumerate(common):
        a, b = starts[row[t]], starts[row[t] + 1]
        matrix[i, docs[a:b]] = impacts[a:b]
    nth = np.full(len(asked.terms), -1)
    nth[common] = np.arange(len(common))
    weights = np.zeros(len(asked.terms))
    weights[held] = shard["idf"][row[held]]
    step = max(1, min(BLOCK, BATCH_SCORES // max(n, 1)))
    hits = np.concatenate([[0], np.cumsum(np.where(nth < 0, size, 0)[asked.place])])[asked.starts]
    after = 0
    while after < len(asked.numbers):
        first, after = after, max(after + 1, min(after + step, len(asked.numbers), int(np.searchsorted(hits, hits[after] + BATCH_HITS, "right")) - 1))
        mine = slice(asked.starts[first], asked.starts[after])
        t = asked.place[mine]
        q = np.repeat(np.arange(after - first), np.diff(asked.starts[first : after + 1]))
        weight = asked.times[mine] * weights[t]
        rare = held[t] & (nth[t] < 0)
        counts = size[t[rare]]
        at = np.repeat(starts[row[t[rare]]] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        scores = np.bincount(np.repeat(q[rare] * n, counts) + docs[at], np.repeat(weight[rare], counts) * impacts[at], (after - first) * n).astype(np.float64, copy=False).reshape(-1, n)
        if len(common):
            share = np.zeros((after - first, len(common)))
            often = nth[t] >= 0
            share[q[often], nth[t[often]]] = weight[often]
            scores += share @ matrix
        best.take(first, scores, offset)
    return n


def by_run(index: Index, questions: DataFrame, k: int = 20, question_terms: int = QUESTION_TERMS) -> DataFrame | None:
    """(question, section, ids, scores): the k best documents of every run for each question, best first; None without questions."""
    spark = questions.sparkSession
    asked = written(questions.select("question", _terms(F.col("text")).alias("terms")), "questions")
    total = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks, out = max(1, -(-total // question_terms)), None
    kind = index.postings.schema["ids"].dataType.elementType.simpleString()
    for b in range(blocks):
        mine = asked.filter(F.pmod(F.xxhash64("question"), F.lit(blocks)) == b).collect()  # about question_terms terms
        if not mine:
            continue
        shared = spark.sparkContext.broadcast(Asked(mine))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            asked, key, ids, best, offset = shared.value, None, [], None, 0

            def found() -> Iterator[pa.RecordBatch]:
                every, slices = pa.concat_arrays(ids), max(1, 200_000 // k)
                for first in range(0, len(asked.numbers), slices):
                    places, scores = best.places[first : first + slices], best.scores[first : first + slices]
                    sizes = (places >= 0).sum(axis=1)
                    at = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                    columns = [pa.array(asked.numbers[first : first + slices]), pa.array([key[0]] * len(sizes), pa.string()), pa.ListArray.from_arrays(at, every.take(pa.array(places[places >= 0]))), pa.ListArray.from_arrays(at, pa.array(scores[places >= 0]))]
                    yield pa.RecordBatch.from_arrays(columns, ["question", "section", "ids", "scores"])

            for batch in batches:
                for i in range(batch.num_rows):
                    one = (batch.column("section")[i].as_py(), batch.column("run")[i].as_py())
                    if one != key:
                        if ids:
                            yield from found()
                        key, ids, best, offset = one, [], Best(len(asked.numbers), k), 0
                    shard = {c: np.frombuffer(batch.column(c)[i].as_buffer(), kind) for c, kind in BYTES.items()}
                    offset += _score(shard | {"mean": batch.column("mean")[i].as_py()}, asked, best, offset)
                    mine = batch.column("ids")[i].values
                    ids.append(mine.take(pa.array(np.arange(len(mine)))))  # a copy: a view would hold the batch
            if ids:
                yield from found()

        part = index.postings.mapInArrow(run, f"question long, section string, ids array<{kind}>, scores array<double>")
        out = part if out is None else out.unionByName(part)
    return out


def search(index: Index, questions: DataFrame, k: int = 20, question_terms: int = QUESTION_TERMS) -> DataFrame:
    """(question, section, id, score, rank): the k best documents of every section for each question.

    questions: (question, text), question a long that tells them apart.
    """
    out = by_run(index, questions, k, question_terms)
    if out is None:
        kind = index.postings.schema["ids"].dataType.elementType.simpleString()
        return questions.sparkSession.createDataFrame([], f"question long, section string, id {kind}, score double, rank int")
    rows = out.repartition("question", "section").select("question", "section", F.explode(F.arrays_zip(F.col("ids").alias("id"), F.col("scores").alias("score"))).alias("x")).select("question", "section", "x.*")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("question", "section").orderBy(F.desc("score"), F.desc_nulls_last("id")))).filter(F.col("rank") <= k)


def fused(lexical: DataFrame, dense: DataFrame | None = None, weight: float = 0.7, keep: int = 10) -> DataFrame:
    """(question, section, id, score, rank): both lists scaled to 0 to 1 within their question and section (a flat list is all 1), weighted and added; the keep best."""
    by = Window.partitionBy("question", "section")

    def scaled(rows: DataFrame, name: str) -> DataFrame:
        low, high = F.min("score").over(by), F.max("score").over(by)
        return rows.select("question", "section", "id", F.when(high - low < 1e-9, 1.0).otherwise((F.col("score") - low) / (high - low)).alias(name))

    both = scaled(lexical, "lexical").withColumn("dense", F.lit(None).cast("double"))
    if dense is not None:
        both = scaled(lexical, "lexical").join(scaled(dense, "dense"), ["question", "section", "id"], "full")
    some = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    rows = both.select("question", "section", "id", F.round(weight * some("dense") + (1 - weight) * some("lexical"), DIGITS).alias("score"))
    return rows.withColumn("rank", F.row_number().over(by.orderBy(F.desc("score"), F.desc_nulls_last("id")))).filter(F.col("rank") <= keep)


def allowed(ranked: DataFrame, allow: DataFrame | None) -> DataFrame:
    """The rows whose (section, id) are allowed; null allows all, an empty table none."""
    return ranked if allow is None else ranked.join(allow.select("section", "id").distinct(), ["section", "id"], "left_semi")


def by_section(ranked: DataFrame, sources: DataFrame | None, top: int, per_source: int, limit: int) -> DataFrame:
    """The top rows of each question and section, at most per_source of a source and limit in all; sources: (id, origin), or null if ranked has the origin."""
    first = Window.partitionBy("question", "section").orderBy("rank")
    rows = ranked.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= top)
    rows = rows if sources is None else rows.join(sources, "id", "left")
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("question", "section", "origin").orderBy("rank"))).filter((F.col("nth") <= per_source) | F.col("origin").isNull()).drop("nth")
    return rows.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= limit)
