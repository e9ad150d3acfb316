"""Each stage of the pipeline on its own input, against plain Python."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
from docloom.llm import mixing
from docloom.llm.common import written
from tests.llm import fixtures
from tests.llm.test_operators import brute_components, brute_targets

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words_of(text):
    return [w for w in SPACE.split(text or "") if w]


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def quality(rows):
    """(doc_id, text) kept: base rules, then lines in 1 % and five of the host's distinct texts are cut."""
    hosts, held = defaultdict(set), defaultdict(set)
    norm = lambda line: SPACE.sub(" ", low(line)).strip(" ")
    for _, text, host in rows:
        hosts[host].add(text)
        for line in (text or "").split("\n"):
            if words_of(line):
                held[host, norm(line)].add(text)
    out = []
    for i, text, host in rows:
        w = words_of(text)
        windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        repeated = {p for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
        over = lambda x, h=host: len(held[h, norm(x)]) >= 5 and 100 * len(held[h, norm(x)]) > len(hosts[h])
        left = "\n".join(x for x in (text or "").split("\n") if not (words_of(x) and over(x)))
        if len(w) >= 50 and 2 * len(repeated) <= len(w) and 2 * len(words_of(left)) >= len(w):
            out.append((i, left))
    return sorted(out)


def clean(rows, items):
    tokens = lambda t: [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t)) if x]
    windows = set()
    for item in items:
        w = tokens(item)
        windows |= {tuple(w[k : k + 13]) for k in range(max(1, len(w) - 12))} if w else set()
    out = []
    for i, text in rows:
        w = tokens(text)
        hit = {p for n in {len(x) for x in windows} for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in windows for p in range(k, k + n)}
        if not (hit and 20 * len(hit) >= len(w)):
            out.append(i)
    return sorted(out)


def test_stages_against_brute_force(spark, tmp_path):
    rows = [r for r in fixtures.document_rows() if r[0] != 15]
    path = fixtures.write(spark, tmp_path, documents=rows)
    key = lambda df: sorted((r.doc_id, r.text) for r in df.collect())
    docs = spark.read.parquet(f"{path}/documents.parquet")

    good = written(corpus_pipeline.quality_rules(spark, docs, path), "t")
    assert good.columns == docs.columns and key(good) == quality([(r[0], r[1], r[3]) for r in rows])

    one = written(corpus_pipeline.near_duplicates(spark, good, path), "t")
    before = key(good)
    components = brute_components(before, 5, 80)
    assert {i for i, _ in key(one)} == {c for _, _, c, _ in components} and one.count() == len({c for _, _, c, _ in components})

    kept = written(corpus_pipeline.decontamination(spark, one, path), "t")
    assert sorted(r.doc_id for r in kept.collect()) == clean(key(one), [t for _, t in fixtures.benchmark_rows()]) and kept.count() < one.count()

    mixed = written(corpus_pipeline.mixture(spark, kept, path), "t")
    sizes, copies = defaultdict(int), Counter(r.doc_id for r in mixed.collect())
    for r in kept.collect():
        sizes[r.source] += len(words_of(r.text))
    targets = brute_targets(sizes)
    for source, target in targets.items():
        mine = [(len(words_of(r.text)), copies[r.doc_id]) for r in kept.collect() if r.source == source]
        assert abs(sum(n * c for n, c in mine) - target) <= max(n for n, _ in mine) / 2 + 1e-6 and all(c <= mixing.MAX_EPOCHS for _, c in mine)

    shards = corpus_pipeline.shards(spark, mixed, path)
    assert key(shards) == key(mixed) and all(r.shard and r.shard_bytes > 0 for r in shards.collect())
