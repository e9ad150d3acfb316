import pytest
from pyspark.sql import functions as F

from docloom.functions import nlp as N
from docloom.functions import records as R
from docloom.functions import structure as T
from docloom.operators import search as S


@pytest.mark.parametrize(
    ("title", "headings", "body", "want"),
    [("Alpha plan", "", "Alpha plan of all", 0.849), ("x", "", "one gamma here", 0.068), ("beta", "beta", "beta and delta", 0.854)],
)
def test_bank_confidence_goldens(spark, title, headings, body, want):
    """A title-class hit in title and body; one medium hit in the body; a high hit in three zones less a negative."""
    bank = {"title": ["alpha plan"], "high": ["beta"], "medium": ["gamma"], "negative": ["delta"]}
    terms = [t for kind in bank.values() for t in kind]
    zones = F.struct(*[N._held_terms(F.lit({"title": title, "headings": headings, "body": body}.get(z, "")), terms).alias(z) for z in N.ZONES])
    assert spark.range(1).select(N.bank_confidence(N.bank_score(zones, bank))).first()[0] == want


def test_ties_go_to_the_more_specific_bank(spark):
    docs = spark.createDataFrame([(1, "omega")], "doc_id long, text string")
    banks = {"wide": {"high": ["omega"]}, "narrow": {"high": ["omega"]}}
    found = N.classify_banks(docs, banks, specificity={"narrow": 80}).collect()
    assert [r.label for r in found] == ["narrow", "wide"]


def test_sections_of_plain_text(spark):
    text = "\n".join(["intro line", "# Scope of it", "a sentence that is long enough to be none of them.", "3.1.2 Widgets", "body", "Records:", "log", "Odd words:", "QUITE LOUD"])
    rows = spark.createDataFrame([(1, text), (2, "no heading here"), (3, None), (4, "")], "doc_id long, text string")
    found = sorted((r.doc_id, r.start_line, r.end_line, r.title, r.label, r.level, r.confidence) for r in T.sections(rows).collect())
    assert found[:4] == [
        (1, 1, 2, "Scope of it", "scope", 1, 0.86),
        (1, 3, 4, "Widgets", "general", 3, 0.88),
        (1, 5, 7, "Records", "records", 1, 0.98),
        (1, 8, 8, "QUITE LOUD", "general", 1, 0.74),
    ]
    assert [f[3:] for f in found[4:]] == [("Document", "general", 1, 0.40)] * 3


def test_record_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(R.safe_round(F.lit(float("nan")))) == 0.0 and one(R.safe_round(F.lit(None).cast("double"))) == 0.0
    assert one(R.uuid_or_null(F.lit("urn:uuid:0123456789ABCDEF0123456789abcdef"))) == "01234567-89ab-cdef-0123-456789abcdef" and one(R.uuid_or_null(F.lit("x"))) is None
    assert one(R.strip_markdown(F.lit("## *Bold*  text"))) == "Bold text" and one(R.any_contains(" ", F.lit(None).cast("string"))) is True
    assert one(R.id_rank(F.lit("SOP-QA-001"), F.lit(9)) > R.id_rank(F.lit("QA001-longer"), F.lit(0))) is True


def test_fewer_matches_than_k_are_padded(spark):
    docs = spark.createDataFrame([(i, "x" if i == 3 else "y") for i in range(6)], "doc_id long, text string")
    scored = spark.createDataFrame([("q", 3, 1.5)], "query string, id long, score double")
    found = S.padded_top_k(scored, docs, {"q": "x"}, 3)
    assert sorted((r["rank"], r.id, r.score) for r in found.collect()) == [(1, 3, 1.5), (2, 5, 0.0), (3, 4, 0.0)]
