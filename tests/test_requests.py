"""Links, documents and exchanges: nulls, repeats and empty tables."""

import datetime as dt

from pyspark.sql import functions as F

from docloom.operators import tables as B


def test_absent_rows_come_once(spark):
    rows = lambda *x: spark.createDataFrame(x, "a int, b string")
    got = B.insert_absent(rows((1, "x"), (None, "y")), rows((1, "x"), (None, "y"), (2, None), (2, None), (1, None)), ["a", "b"])
    assert sorted(map(repr, map(tuple, got.collect()))) == ["(1, None)", "(2, None)"]
    assert B.insert_absent(rows((1, "x")).limit(0), rows((1, "x")), ["a", "b"]).count() == 1 and B.insert_absent(rows((1, "x")), rows((1, "x")).limit(0), ["a", "b"]).count() == 0


def test_links_are_created_twice_deleted_and_refused(spark):
    stored = spark.createDataFrame([("x", 1, 2), ("x", 1, 2), ("y", 1, 2)], "kind string, src int, dst int")
    asked = spark.createDataFrame([("create", "x", 1, 2), ("create", "x", 1, 2), ("delete", "y", 1, 2), ("create", "z", 1, 1), (None, "x", 3, 3), ("drop", "x", 4, 4)], "action string, kind string, src int, dst int")
    links, refused = B.apply_links(stored, asked, ["x", "y"])
    assert sorted(map(tuple, links.collect())) == [("x", 1, 2)] * 4 and refused.count() == 3


def test_requests_of_unknown_and_null_numbers(spark):
    stored = spark.createDataFrame([("a", True), ("b", False)], "number string, analysed boolean")
    asked = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "c"), (5, None), (6, None)], "at int, number string")
    got = {r["at"]: r.action for r in B.document_requests(stored, asked, "at").collect()}
    assert got == {1: "existing", 2: "new version", 3: "created", 4: "new version", 5: "created", 6: "created"}


def test_exchanges_find_their_session(spark):
    t = dt.datetime(2024, 1, 1)
    sessions = spark.createDataFrame([("old", 1, 7, 1), ("new", 1, 7, 2)], "session string, document int, user int, at int")
    asked = spark.createDataFrame([(1, 7, "c", "q", "r", t), (1, 8, "c", "q2", None, t), (2, 7, " ", "q3", "r3", t)], "document int, user int, client_session string, question string, response string, at timestamp")
    rows = sorted((r.content or "", r.session, r.role, r.at.microsecond, r.is_new) for r in B.exchange_rows(asked, sessions).collect())
    assert [(x[0], x[2], x[3], x[4]) for x in rows] == [("", "assistant", 1000, True), ("q", "user", 0, False), ("q2", "user", 0, True), ("q3", "user", 0, True), ("r", "assistant", 1000, False), ("r3", "assistant", 1000, True)]
    assert rows[1][1] == "new" and rows[0][1] == rows[2][1] == "c" and len(rows[3][1]) == 32 == len(rows[5][1])


def test_metadata_of_nulls(spark):
    df = spark.createDataFrame([({"a": "1", "_k": "2"}, {"a": " ", "b": "3", "_k": "9", "_n": "x"}), (None, {"a": "1"}), ({"a": "1"}, None), (None, None)], "s map<string,string>, c map<string,string>").coalesce(1)
    assert [r[0] for r in df.select(B.merged_metadata(F.col("s"), F.col("c"))).collect()] == [{"a": "1", "_k": "2", "b": "3"}, {"a": "1"}, {"a": "1"}, {}]
