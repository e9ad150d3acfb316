"""Record tables: upserts by several keys, deletes, guarded transitions, ordered merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def resolve(incoming: DataFrame, stored: DataFrame, key: str, ladder: list[str]) -> DataFrame:
    """incoming with matched: the stored key found by the first column of the ladder that matches.

    One equality join per column; of several stored rows with a value the smallest key counts.
    """
    out, found = incoming, []
    for i, c in enumerate([key, *ladder]):
        side = stored.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias(f"__v{i}")).agg(F.min(key).alias(f"__k{i}"))
        out = out.join(side, out[c] == F.col(f"__v{i}"), "left").drop(f"__v{i}")
        found.append(F.col(f"__k{i}"))
    return out.withColumn("matched", F.coalesce(*found)).drop(*[f"__k{i}" for i in range(len(found))])


def upsert(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Stored rows replaced by incoming rows of the same key, and new ones added."""
    return stored.join(incoming.select(key), key, "left_anti").unionByName(incoming)


def replace_scope(stored: DataFrame, incoming: DataFrame, scope: list[str]) -> DataFrame:
    """All stored rows of the scopes that incoming has are replaced (nulls are equal)."""
    s = incoming.select(*scope).distinct().alias("s")
    same = F.lit(True)
    for c in scope:
        same = same & F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}"))
    return stored.alias("r").join(s, same, "left_anti").unionByName(incoming)


def guard_transition(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """requests (action, status, note, ...) against rules (action, from_status, to_status, needs_note).

    verdict is ok or the first failure: unknown action, wrong status, missing note; the rules are a
    small table that Spark broadcasts by its size.
    """
    r = rules.select("action", "from_status", "to_status", "needs_note")
    rows = requests.join(r, "action", "left")
    blank = F.trim(F.coalesce("note", F.lit(""))) == ""
    verdict = (
        F.when(F.col("to_status").isNull(), "unknown action")
        .when(~F.array_contains("from_status", F.col("status")), "wrong status")
        .when(F.col("needs_note") & blank, "missing note")
        .otherwise("ok")
    )
    new = F.when(verdict == "ok", F.col("to_status")).otherwise(F.col("status"))
    return rows.withColumn("verdict", verdict).withColumn("new_status", new).drop("from_status", "to_status", "needs_note")


def version_key(version: Column) -> Column:
    """Sort key of version labels: V2.1 above Rev. 02 above plain numbers, then the numbers, of any length."""
    text = F.upper(F.trim(version))
    kind = F.when(text.rlike(r"^V\d"), 3).when(text.rlike(r"^REV"), 2).when(text.rlike(r"^\d"), 1).otherwise(0)
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0)), _number_key)
    return F.struct(kind.alias("kind"), numbers.alias("numbers"))


def _number_key(digits: Column) -> Column:
    """Orders digits as numbers: without leading zeros the longer is the greater, and equally long ones compare as texts."""
    plain = F.regexp_replace(digits, "^0+", "")
    return F.struct(F.length(plain).alias("size"), plain.alias("digits"))


def canonical_version(version: Column) -> Column:
    """V2.1, Rev. 02 or a plain number; others as they are."""
    text = F.trim(version)
    rev = F.regexp_extract(text, r"(?i)^rev(?:ision)?\.?\s*(\d+)$", 1)
    v = F.regexp_extract(text, r"(?i)^v(?:ersion)?\.?\s*(\d+(?:\.\d+)*)$", 1)
    return F.when(rev != "", F.concat(F.lit("Rev. "), F.when(F.length(F.regexp_replace(rev, "^0+", "")) < 2, F.lpad(F.regexp_replace(rev, "^0+", ""), 2, "0")).otherwise(F.regexp_replace(rev, "^0+", "")))).when(v != "", F.concat(F.lit("V"), v)).otherwise(text)


def merge_lists(rows: DataFrame, by: str, lists: list[str], order: str) -> DataFrame:
    """Union of list columns per key, each value where it was first seen."""
    collected = [F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, c))), _pick(c)))).alias(c) for c in lists]
    return rows.groupBy(by).agg(*collected)


def _pick(name: str):
    return lambda x: x[name]


def insert_absent(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """The incoming rows whose keys aren't stored, each once (nulls are equal): what has to be appended."""
    new = incoming.dropDuplicates(keys).alias("n")
    same = F.lit(True)
    for c in keys:
        same = same & F.col(f"n.`{c}`").eqNullSafe(F.col(f"s.`{c}`"))
    return new.join(stored.select(*keys).distinct().alias("s"), same, "left_anti")


def apply_links(stored: DataFrame, requests: DataFrame, kinds: list[str]) -> tuple[DataFrame, DataFrame]:
    """(links after the requests, refused requests). Links and requests have kind, src and dst; requests an action, create or delete.

    A create adds a row even if there is one; a delete takes all stored rows of its link away, and none that the same requests create. A kind that isn't known, or
    another action, is refused.
    """
    known = F.coalesce(F.col("kind").isin(kinds) & F.col("action").isin("create", "delete"), F.lit(False))
    names = ["kind", "src", "dst"]
    kept = stored.join(requests.filter(known & (F.col("action") == "delete")).select(*names).distinct(), names, "left_anti")
    return kept.unionByName(requests.filter(known & (F.col("action") == "create")).select(*stored.columns)), requests.filter(~known)


def document_requests(stored: DataFrame, requests: DataFrame, order: str) -> DataFrame:
    """What each request (number, ...) to create a document comes to: existing, new version or created.

    stored: (number, analysed), one row a number. A number that is stored and analysed is returned as it is, one that isn't analysed gets a new version; of requests of
    an unknown number the first creates it and the others are versions of it. A null number is always created.
    """
    nth = F.row_number().over(Window.partitionBy("number").orderBy(order))
    rows = requests.withColumn("nth", nth).join(stored.select("number", "analysed"), "number", "left")
    action = F.when(F.col("number").isNull(), "created").when(F.col("analysed"), "existing").when(F.col("analysed").isNotNull() | (F.col("nth") > 1), "new version").otherwise("created")
    return rows.withColumn("action", action).drop("nth", "analysed")


def exchange_rows(exchanges: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session, role, content, at, is_new): the user's row of each exchange at its time, the assistant's a millisecond after.

    exchanges: (document, user, client_session, question, response, at). The session is the newest stored one of the document and user (sessions: session, document, user, at), else
    the client's, else a new one named by a hash of document, user and time.
    """
    known = sessions.groupBy("document", "user").agg(F.max_by("session", F.struct("at", "session")).alias("stored"))
    rows = exchanges.join(known, ["document", "user"], "left")
    made = F.md5(F.concat_ws("|", F.col("document").cast("string"), F.col("user").cast("string"), F.col("at").cast("string")))
    rows = rows.withColumn("session", F.coalesce("stored", F.nullif(F.trim("client_session"), F.lit("")), made)).withColumn("is_new", F.col("stored").isNull())
    one = lambda role, content, ms: F.struct(F.lit(role).alias("role"), F.col(content).alias("content"), F.timestamp_add("MILLISECOND", F.lit(ms), F.col("at")).alias("at"))
    return rows.select("session", "is_new", F.explode(F.array(one("user", "question", 0), one("assistant", "response", 1))).alias("m")).select("session", "m.role", "m.content", "m.at", "is_new")


def merged_metadata(stored: Column, client: Column) -> Column:
    """A map of stored values under the client's: the client's count unless blank, and names that begin with an underscore are the stored ones'."""
    own = F.coalesce(client, F.create_map().cast("map<string,string>"))
    old = F.coalesce(stored, F.create_map().cast("map<string,string>"))
    fresh = F.map_filter(own, lambda k, v: (F.coalesce(F.trim(v), F.lit("")) != "") & ~k.startswith("_"))
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(fresh), k)), fresh)
