import pytest

from docloom.plans import catalog
from tests.oracle import TABLES, assert_same


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_oracle(spark, small, name):
    df = catalog.queries()[name](spark, small)
    assert_same(df, catalog.oracle_sql()[name], {t: f"{small}/{t}.parquet" for t in TABLES})


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_hash_modulo_equals_python(spark):
    import hashlib

    from pyspark.sql import functions as F

    from docloom.functions.text import hash_modulo

    texts = ["", "a", "größe", "token 42"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for m in (2**31 - 1, 2**63 - 1):
        got = [r[0] for r in df.select(hash_modulo(F.col("t"), m)).collect()]
        assert got == [int(hashlib.md5(t.encode()).hexdigest(), 16) % m for t in texts]


def test_dates(spark):
    from pyspark.sql import functions as F

    from docloom.functions.text import normalize_date

    cases = {"2024-03-05": "2024-03-05", "5.3.2024": "2024-03-05", "05/03/71": "1971-03-05", "5.3.69": "2069-03-05", "3. März 2024": "2024-03-03", "March 3, 2024": "2024-03-03", "31.02.2024": "2024-02-31", "soon": None, "20-May-2026": "2026-05-20", "3 Sept. 2021": "2021-09-03", "Dec. 24, 2020": "2020-12-24", "1.Okt 2019": "2019-10-01", "7 Foo 2020": None}
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    assert [r[0] for r in df.select(normalize_date(F.col("t"))).collect()] == list(cases.values())


def test_terms_and_refs(spark):
    from pyspark.sql import functions as F

    from docloom.functions.text import contains_term, entity_refs, truncate

    df = spark.createDataFrame([("See capa-001, CAPA-A9 and capa-001. Größen C++",)], "t string")
    c = F.col("t")
    r = df.select(entity_refs(c, "CAPA"), contains_term(c, "größen"), contains_term(c, "größe"), truncate(c, 10)).first()
    assert r[0] == ["CAPA-001", "CAPA-A9"] and r[1] and not r[2] and r[3] == "See cap..."


def test_labels_headings_and_placeholders(spark):
    from pyspark.sql import functions as F

    from docloom.functions import nlp as N

    df = spark.createDataFrame([("Owner: Ana Ruiz Status: open\nScope : all", {"Name": "x$1", "b": "y"})], "t string, m map<string,string>")
    c = F.col("t")
    r = df.select(N.labelled_value(c, "owner", ["status"]), N.labelled_value(c, "scope", ["status"]), N.labelled_value(c, "missing", ["status"])).first()
    assert tuple(r) == ("Ana Ruiz", "all", None)
    heads = spark.createDataFrame([("1.2 Scope",), ("PURPOSE AND SCOPE",), ("a plain line",), ("ONE TWO THREE FOUR FIVE SIX",), ("123",)], "l string")
    assert [x[0] for x in heads.select(N.is_heading(F.col("l"))).collect()] == [True, True, False, False, False]
    filled = df.select(N.fill_placeholders(F.lit("{{ Name }} {{name}} {{b}} {{ c }}"), F.col("m"))).first()[0]
    assert filled == "x$1 x$1 y {{ c }}"
