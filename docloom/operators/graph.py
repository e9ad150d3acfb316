"""Typed record graph: hops over edge tables, similarity links and orphan deletion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.session import written

#: Similarity rules of link inference: (source type, target type, threshold).
LINK_RULES = (("sop", "deviation", 0.63), ("deviation", "capa", 0.62), ("capa", "audit", 0.62), ("audit", "decision", 0.60), ("decision", "sop", 0.64))


def hop(frontier: DataFrame, edges: DataFrame, start: str = "src", end: str = "dst") -> DataFrame:
    """Distinct (root, id) one edge further, for many roots at once."""
    e = edges.select(F.col(start).alias("id"), F.col(end).alias("__next"))
    return frontier.join(e, "id").select("root", F.col("__next").alias("id")).distinct()


def expand(frontier: DataFrame, *steps: tuple[DataFrame, str, str]) -> DataFrame:
    for edges, start, end in steps:
        frontier = hop(frontier, edges, start, end)
    return frontier


def _mask_hop(frontier: DataFrame, edges: DataFrame, start: str = "src", end: str = "dst") -> DataFrame:
    """(id, word, bits) one edge further; ids repeat until _merged."""
    e = edges.select(F.col(start).alias("id"), F.col(end).alias("__next"))
    return frontier.join(e, "id").select(F.col("__next").alias("id"), "word", "bits")


def _merged(rows: DataFrame) -> DataFrame:
    return rows.groupBy("id", "word").agg(F.bit_or("bits").alias("bits"))


def quality_context(roots: DataFrame, sop_dev: DataFrame, dev_capa: DataFrame, capa_audit: DataFrame, audit_dec: DataFrame, dec_sop: DataFrame) -> DataFrame:
    """Records related to each root document, in one pass over both directions: (root, type, id).

    Edges are (src, dst) from the first-named type to the second, repeated ones count once; roots is (root, id). Roots are numbered, and a record carries
    those that reach it as bits, 64 to a row: what is joined and shuffled grows with the records, not with records times roots.
    A frontier that two hops or more start from is written to the shared folder, so that its own hops run once.
    """
    names = written(roots.select("root").distinct(), "roots")
    few = max(1, -(-names.count() // 1_000_000))  # numbers of a partition are dense
    names = written(names.coalesce(few).select("root", F.monotonically_increasing_id().alias("nth")), "roots")
    number = [F.shiftright("nth", 6).alias("word"), F.expr("shiftleft(1L, cast(nth & 63L AS INT))").alias("bits")]
    begin = roots.select(F.col("root").alias("of"), "id").join(names, F.col("of").eqNullSafe(F.col("root"))).select("id", *number)
    begin = written(_merged(begin), "roots")
    dev0 = _merged(_mask_hop(begin, sop_dev))
    dec0 = _merged(_mask_hop(begin, dec_sop, "dst", "src"))
    aud0 = _mask_hop(dec0, audit_dec, "dst", "src")
    capa0 = written(_merged(_mask_hop(dev0, dev_capa)), "capa")
    aud = written(_merged(aud0.union(_mask_hop(capa0, capa_audit))), "audits")
    capa = written(_merged(capa0.union(_mask_hop(aud, capa_audit, "dst", "src"))), "capa")
    dev = _merged(dev0.union(_mask_hop(capa, dev_capa, "dst", "src")))
    dec = written(_merged(dec0.union(_mask_hop(aud, audit_dec))), "decisions")
    own = begin.select(F.col("id").alias("of"), F.col("word").alias("own_word"), F.col("bits").alias("own"))
    sops = _merged(_mask_hop(dec, dec_sop))
    sops = sops.join(own, (F.col("id") == F.col("of")) & (F.col("word") == F.col("own_word")), "left")
    sops = sops.select("id", "word", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("own", F.lit(0).cast("long")))).alias("bits"))
    kinds = {"deviation": dev, "capa": capa, "audit": aud, "decision": dec, "sop": sops}
    out = None
    for kind, rows in kinds.items():
        part = rows.select(F.lit(kind).alias("type"), "id", "word", "bits")
        out = part if out is None else out.union(part)
    held = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftright", F.col("bits"), i).bitwiseAND(F.lit(1).cast("long")) == 1)
    reached = out.select("type", "id", F.explode(F.transform(held, lambda i: F.shiftleft("word", 6) + i)).alias("nth"))
    return reached.join(names, "nth").select("root", "type", "id")


def infer_links(scores: DataFrame, threshold: float, limit: int = 10) -> DataFrame:
    """(source_id, target_id, score) chunk scores -> the best per target, filtered and marked accepted or pending."""
    from docloom.operators.search import top_k

    best = scores.groupBy("source_id", "target_id").agg(F.max("score").alias("score")).filter(F.col("score") >= threshold)
    ranked = top_k(best, limit, ["source_id"], [F.desc("score"), F.col("target_id")])
    accept = F.least(F.lit(0.99), F.lit(threshold + 0.05))
    return ranked.withColumn("status", F.when(F.col("score") >= accept, "accepted").otherwise("pending"))


def delete_orphans(children: DataFrame, edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Children (id) reached only by edges from parents in gone (id): those to delete too."""
    touched = edges.join(gone.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
    alive = edges.join(gone.select(F.col("id").alias("src")), "src", "left_anti").select(F.col("dst").alias("id")).distinct()
    return children.join(touched, "id", "left_semi").join(alive, "id", "left_anti")
