"""Whitening, token counts and ranked search against plain versions."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.llm import ranked_search, token_counts, whitening
from docloom.llm.common import written
from tests.llm import fixtures
from tests.llm.fixtures import prose

# 11


def vectors(spark, rows=None):
    return spark.createDataFrame(fixtures.embedding_rows() if rows is None else rows, fixtures.EMBEDDINGS)


def plain_whitening(rows, k=16):
    """(vec_id, x) of the rows that count, S, n, eigenvalues, eigenvectors, trace: by a whole covariance matrix."""
    good = [(r[0], r[1]) for r in rows if r[1] is not None and len(r[1]) == 20 and all(v is not None and np.isfinite(v) for v in r[1])]
    x = np.floor(64 * np.array([np.array(v, np.float32) for _, v in good], np.float64)).astype(np.int64) + 1_000_000
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(axis=0)
    c = u - s / n
    values, found = np.linalg.eigh(c.T @ c / n)
    return [i for i, _ in good], x, s, n, values[::-1][:k], found[:, ::-1][:, :k], values.sum()


def check_whitening(got, rows, k=16):
    ids, x, s, n, values, axes, trace = plain_whitening(rows, k)
    want = ((x - s / n) @ axes) / np.sqrt(values)
    deviation = ((n * x - s) ** 2).sum(axis=1)
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r)
    assert len(got) == len(ids) * k and {r.n for r in got} == {n}
    signs = np.zeros(k)
    for i, at in {i: j for j, i in enumerate(ids)}.items():
        for c in range(1, k + 1):
            found = by[i, int(deviation[at])][c]
            assert len(found) == sum(1 for j, w in enumerate(ids) if w == i and deviation[j] == deviation[at])
            assert abs(abs(found[0].whitened) - abs(want[at, c - 1])) < 1e-9
            assert abs(found[0].explained * trace / values[c - 1] - 1) < 1e-9
            if abs(want[at, c - 1]) > 1e-3:
                sign = np.sign(found[0].whitened * want[at, c - 1])
                assert signs[c - 1] in (0, sign)
                signs[c - 1] = sign
    assert max(r.identity_error for r in got) < 1e-9


def test_whitening_equals_a_whole_covariance(spark):
    rows = fixtures.embedding_rows()
    check_whitening(whitening.whiten(vectors(spark)).collect(), rows)


def test_small_blocks_need_more_passes_and_give_the_same(spark):
    rows = fixtures.embedding_rows()
    check_whitening(whitening.whiten(vectors(spark), k=3, block=3).collect(), rows, k=3)
    usable, d = whitening.points(vectors(spark), "vec_id", "embedding")
    distinct = written(usable.select("x").distinct(), "t")
    found = whitening.fit(distinct, d, 3, 3)
    assert found.passes > 3 and found.residual <= whitening.TOLERANCE
    assert whitening.fit(distinct, d, 16, 32).passes == 1  # a block as wide as the space


def test_many_tasks_are_merged_in_two_steps(spark, monkeypatch):
    monkeypatch.setattr(whitening, "MERGERS", 2)
    usable, d = whitening.points(vectors(spark).repartition(6), "vec_id", "embedding")
    distinct = usable.select("x").groupBy("x").count().select("x").repartition(5)
    found = whitening.fit(written(distinct, "t"), d, 4, 8)
    assert np.allclose(found.values, plain_whitening(fixtures.embedding_rows(), 4)[4], rtol=1e-12)


def test_vectors_without_variance_and_with_too_few_rows(spark):
    one = [(i, [0.5] * 4, 1, 1, "") for i in range(3)]
    assert whitening.whiten(vectors(spark, one)).collect() == []
    two = [(1, [0.0, 0.0], 1, 1, ""), (2, [1.0, 1.0], 1, 1, ""), (3, [1.0, 1.0], 1, 1, "")]
    got = whitening.whiten(vectors(spark, two)).collect()
    assert {r.component for r in got} == {1} and len(got) == 3 and all(abs(abs(r.whitened) - 1) < 1e-12 for r in got)


def test_large_entries_keep_exact_deviations_or_none(spark):
    rows = [(1, [1e6, 0.0], 1, 1, ""), (2, [0.0, 1.0], 1, 1, ""), (3, [1e30, 2.0], 1, 1, "")]
    got = {(r.vec_id, r.component): r.deviation for r in whitening.whiten(vectors(spark, rows[:2])).collect()}
    assert got[1, 1] == 2 * 0 + (2 * 64_000_000 - 64_000_000) ** 2 + 64**2
    assert {r.deviation for r in whitening.whiten(vectors(spark, rows)).collect()} == {None}


# 12


@pytest.fixture(scope="module")
def path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


ODD = [
    "",
    None,
    "a<|endoftext|>b<|endoftext|><|endoftext|>",
    "<|endoftext",
    "It's we'll they'RE  I'd\t\n\n x  ",
    "x" * 5000,
    "ab" * 20000 + " end",
    "größe naïve дом 漢字かな交じり文 한국어 ١٢٣ ⅷ ²",
    "😀👩‍👩‍👧    \x1c\x85 ﻿ ​",
    "՘a ࢏1 \U0001e5d0\U0003134a z͸",
    "1234567890 !!??...---___ {}[]",
]


def test_tokens_equal_the_library(spark, path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    texts = [r[1] for r in fixtures.document_rows()] + ODD
    rows = spark.createDataFrame([(i, t, 9, True) for i, t in enumerate(texts)], "doc_id long, text string, N_TOKENS int, other boolean")
    got = token_counts.token_counts(rows, path, limit=100)
    assert got.columns == ["doc_id", "text", "other", "n_bytes", "n_tokens", "over_limit"]
    for r in got.collect():
        want = len(library.encode(r.text or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), want, want > 100), r.text[:40]


def test_every_character_is_split_as_the_library_does(path):
    from tokenizers import Tokenizer

    library, count = Tokenizer.from_file(path), token_counts.text_counter(token_counts.read_vocabulary(path))
    for a in range(0, 0x110000, 64):
        text = "".join(f"a{chr(c)}1{chr(c)}!{chr(c)} " for c in range(a, a + 64) if not 0xD800 <= c < 0xE000)
        assert count(text) == len(library.encode(text, add_special_tokens=False).ids), hex(a)


def test_streamed_texts_count_alike(path, monkeypatch):
    count = token_counts.text_counter(token_counts.read_vocabulary(path))
    text = prose(4, 3000)
    whole = count(text)
    monkeypatch.setattr(token_counts, "STREAM", 10)
    assert count(text) == whole


def test_other_vocabularies_are_an_error():
    import public_tokenizers

    with pytest.raises(ValueError):
        token_counts.read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))


# 13


def plain_ranking(documents, queries, k):
    import math
    import re

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    docs = [(i, words(t)) for i, t in documents]
    n_docs, n_terms = sum(1 for _, w in docs if w), sum(len(w) for _, w in docs)
    df = {}
    for _, w in docs:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in queries:
        scored = []
        for i, w in docs:
            if not w:
                continue
            m = 50 + (50 * len(w) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * w.count(t)) // (1000 * w.count(t) + 20 * m)) for t in set(words(text)) if t in df)
            if s > 0:
                scored.append((i, s))
        scored.sort(key=lambda x: (-x[1], x[0] is None, x[0] or 0))
        out += [(item, r, *x) for r, x in enumerate(scored[:k], 1)]
    return sorted(map(repr, out))


@pytest.mark.parametrize(("shard_tokens", "seeds", "block_terms"), [(2_000_000, 4, 200_000), (500, 2, 200_000), (2000, 1, 40), (1, 0, 1000)])
def test_shards_seeds_and_query_blocks_give_the_same(spark, shard_tokens, seeds, block_terms):
    docs = [(i, prose(300 + i % 60, 40 + i % 50, 12)) for i in range(150)] + [(500, None), (501, ""), (None, prose(301, 41, 12)), (3, prose(303, 43, 12))]
    asked = [(k, prose(300 + k, 12, 12)) for k in range(12)] + [(None, prose(333, 20, 12)), (2, "nothing of that"), (20, ""), (21, None), (2, prose(350, 5, 12))]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(9)
    q = spark.createDataFrame(asked, "item_id long, text string")
    got = ranked_search.ranked(d, q, k=7, shard_tokens=shard_tokens, seed_shards=seeds, block_terms=block_terms)
    assert sorted(repr(tuple(r)) for r in got.collect()) == plain_ranking(docs, asked, 7)


def test_block_ends_have_the_least_error():
    r = random.Random(5)
    lists = [[r.randrange(1, 1000) for _ in range(n)] for n in (1, 2, 7, 40, 23, 40, 1)]
    impacts, sizes = np.array([x for v in lists for x in v]), np.array([len(v) for v in lists])
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    for cost in (0, 700, 10**6):
        which, ends = ranked_search.block_ends(impacts, begins, sizes, cost=cost, part=1, parts=12)
        for at, v in enumerate(lists):
            mine = ends[which == at].tolist()
            paid = sum(max(v[a:b]) * (b - a) + cost for a, b in zip([0, *mine[:-1]], mine, strict=True))
            best = [0] + [10**12] * len(v)
            for j in range(1, len(v) + 1):
                best[j] = min(best[i] + max(v[i:j]) * (j - i) + cost for i in range(max(0, j - 12), j))
            assert mine[-1] == len(v) and paid == best[-1]


def test_low_blocks_are_not_read(monkeypatch):
    """Of 20,000 documents with the query's term, only some of the 500 short ones are looked at."""
    counts = np.array([3 if 7000 <= i < 7500 else 200 for i in range(20_000)])
    hashes = np.concatenate([[7] + [1000 + i] * (c - 1) for i, c in enumerate(counts)])
    shard = ranked_search.make_shard(0, pa.array(range(20_000)), hashes, counts, 20_000, int(counts.sum()))
    lists = ranked_search.Shard(pa.Table.from_batches([shard]))
    read, spans = [], ranked_search._spans
    monkeypatch.setattr(ranked_search, "FIRST_RANGES", 1)
    monkeypatch.setattr(ranked_search, "_spans", lambda a, b: read.append(int((b - a).sum())) or spans(a, b))
    docs, scores = lists.search(np.array([7]), np.array([3]), 5, 0)
    assert docs.tolist() == [7000, 7001, 7002, 7003, 7004] and len(set(scores.tolist())) == 1
    assert 5 <= sum(read[1:]) < 2000


def test_index_holds_every_row_once(spark):
    docs = spark.createDataFrame(fixtures.document_rows(), fixtures.DOCUMENTS).repartition(2)
    index, n_docs, n_terms = ranked_search.build_index(docs, shard_tokens=2000)
    heads = index.filter("term is null")
    assert heads.count() >= 2 and index.agg(F.sum("df")).first()[0] == index.filter("term is not null").agg(F.sum(F.size("docs"))).first()[0]
    assert n_docs == docs.filter(F.regexp_count("text", F.lit(ranked_search.TERM)) > 0).count() and n_terms > 30000
