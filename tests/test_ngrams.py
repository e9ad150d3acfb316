"""Phrases against a plain count, with texts cut into small pieces, and how they are shuffled."""

import re
from collections import Counter

from docloom.operators import ngrams as G


def plain(texts, least=2):
    out = Counter()
    for t in texts:
        w = [x for x in re.findall("[a-z]+", (t or "").lower()) if len(x) > 2]
        out.update((" ".join(w[i : i + k]), k) for k in (2, 3) for i in range(len(w) - k + 1))
    return {k: n for k, n in out.items() if n >= least}


TEXTS = [None, "", "abc", "the end", "end the", "the end", "The END of all the end", "café abc\nabcéabc def", "abc def", "a-the.end", "no the the the the", "x" * 300 + " the end", "  ", "straße für alle", "Straße FÜR ALLE", "KELVIN KK", *[f"w{'abcdefgh'[i % 8]}x yyy zzz" for i in range(50)]]


def test_phrases_equal_a_plain_count(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id int, text string").repartition(3)
    got = {(r.phrase, r.words): r.n for r in G.phrase_counts(docs).collect()}
    assert got == plain(TEXTS) and got[("the end", 2)] == 6
    once = G.phrase_counts(docs, least=1).collect()
    assert len(once) == len(plain(TEXTS, 1)) and {(r.phrase, r.words): r.n for r in once} == plain(TEXTS, 1)
    assert G.phrase_counts(docs.filter("text is null")).collect() == []


def test_small_pieces_and_buckets_give_the_same(monkeypatch):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([None if t is None else t.lower() + "\n" for t in TEXTS])], ["t"])
    for piece, at_once, buckets in ((1, 1, 1), (40, 1, 7), (10**6, 10**6, 300)):
        monkeypatch.setattr(G, "PIECE", piece)
        monkeypatch.setattr(G, "AT_ONCE", at_once)
        for part in (batch, batch.slice(4, 30)):
            packed = pa.Table.from_batches(list(G._packed(3, buckets)([part]))).sort_by("bucket")
            got = [r for b in G._summed(2)(packed.to_batches(max_chunksize=5)) for r in b.to_pylist()]
            texts = TEXTS if part is batch else TEXTS[4:34]
            assert len(got) == len(plain(texts)) and {(r["phrase"], r["words"]): r["n"] for r in got} == plain(texts), (piece, len(texts))


def test_no_phrase_is_shuffled_as_a_row(spark, small):
    import __spark_entry__

    plan = __spark_entry__.queries()["ngram_counts"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "Generate" not in plan and "HashAggregate" not in plan
