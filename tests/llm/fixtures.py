"""Small tables with the cases that operators must define."""

from __future__ import annotations

import math
import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon größe naïve дом".split()


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    words = [r.choice(WORDS) + str(r.randrange(vocabulary)) for _ in range(n)]
    return " ".join(w + ("\n" if r.random() < 0.08 else "") for w in words).replace("\n ", "\n")


def benchmark_rows() -> list[tuple]:
    return [(1, prose(1001, 30)), (2, prose(1002, 13)), (3, "Only Five Words In here"), (4, ""), (5, None), (6, "single9"), (7, prose(1001, 30)), (None, prose(1003, 20))]


def document_rows() -> list[tuple]:
    """doc_id, text, lang, source, n_chars and columns whose names operators use."""
    base, passage = prose(5, 300), prose(77, 70)
    edited = base.split(" ")
    edited[40], edited[200] = "changed", "again"
    spam = "Click here to subscribe now"
    texts: list[tuple] = [
        (0, base, "a"),
        (1, base, "a"),
        (2, " ".join(edited), "b"),
        (3, None, "b"),
        (4, "", "b"),
        (5, " \t\n \r\x0b ", None),
        (6, "one two", None),
        (7, "one  TWO", "c"),
        (8, "w " * 120, "c"),
        (9, prose(9, 60) + "\n" + prose(1001, 30).upper() + "\nthe end", "c"),
        (10, "x " + prose(1002, 13), "a"),
        (11, "He said only five words in HERE, and single9!", "d"),
        (12, prose(12, 80) + "\n" + passage + "\n" + prose(13, 50), "a"),
        (13, prose(14, 20) + "\n" + passage, "b"),
        (14, "# * $ % & | < >\n\n# * $ % & | < >\na\na\na \n", "a"),
        (15, prose(15, 30000), "a"),
        (16, "дом ΑΒΓ ÄÖÜ größe Größe " * 12, None),
        (10, "x " + prose(1002, 13), "a"),
        (20, 'api_key = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and commit f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda', "config/app.yml"),
        (20, 'api_key = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and commit f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda', "config/app.yml"),
        (None, "export TOKEN=ghp_Zk3vQ9xT1mB7rW5nC8yL2dH6sJ4fG0pAqEuX", None),
    ]
    texts += [(100 + i, f"{prose(200 + i, 60)}\n{spam}\n  {spam.upper()} ", "host") for i in range(14)]
    texts += [(150 + i, f"{spam}\n" * 20, "host") for i in range(2)]
    return [(i, t, "en", s, None if t is None else len(t), -1, "clash", True, 3.5) for i, t, s in texts]


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, n_words long, text_key string, kept boolean, target double"


def embedding_rows() -> list[tuple]:
    """vec_id, embedding, label and columns whose names the results use; 20 dimensions, of which the last repeats the first."""
    r = random.Random(3)
    rows: list[tuple] = []
    for i in range(120):
        v = [round(r.gauss(0, 1 + d / 7), 4) for d in range(19)]
        rows.append((i, [*v, v[0]], 1, 5, "clash"))
    rows += [(200 + i, rows[7][1], 1, 5, "clash") for i in range(60)]
    rows += [(300, None, 1, 5, "c"), (301, [], 1, 5, "c"), (302, [1.0] * 19 + [None], 1, 5, "c"), (303, [1.0] * 19 + [math.nan], 1, 5, "c"), (304, [1.0] * 19 + [math.inf], 1, 5, "c"), (305, [1.0, 2.0], 1, 5, "c")]
    return [*rows, (7, rows[7][1], 1, 5, "c"), (None, rows[8][1], None, None, None)]


EMBEDDINGS = "vec_id long, embedding array<float>, n int, component int, whitened string"


def write(spark, path, documents=None, benchmark=None, pages=None, embeddings=None) -> str:
    spark.createDataFrame(embedding_rows() if embeddings is None else embeddings, EMBEDDINGS).write.parquet(f"{path}/embeddings.parquet")
    spark.createDataFrame(document_rows() if documents is None else documents, DOCUMENTS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(benchmark_rows() if benchmark is None else benchmark, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(page_rows() if pages is None else pages, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return str(path)


def page_rows() -> list[tuple]:
    page = "<html><body><nav><a href='/'>Home</a></nav><article><h1>Title</h1><p>Some &amp; text</p></article></body></html>"
    return [(1, "http://a/1", page), (2, None, page), (3, "http://a/3\r\nX: y", page), (4, "u", None), (5, "u", ""), (6, "u", "ü" * 49), (7, "u", "ü" * 49), (8, "u", "ü" * 50), (9, "u", "ü" * 50), (8, "u", "ü" * 50), (10, "u", "<p>" + "long text " * 20000)]


def views(path: str) -> dict[str, str]:
    return {t: f"{path}/{t}.parquet/*.parquet" for t in ("documents", "benchmark", "pages")}
