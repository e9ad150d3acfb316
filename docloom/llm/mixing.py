"""Mixing sources to target weights by repetition rates.

Tokens (words between ASCII white space) are summed per source; targets share
``budget_percent`` of all tokens by weight, stop at ``max_epochs`` times their source and
pass the excess on by weight until none is above. A source's rate is target / size; each
document is emitted floor(rate) times and once more if its hash-seeded coin falls
below its source's mark.

The coin is one of COINS values. With the mark at the fraction of the rate the copies would be
independent draws, and the words taken would stray from the target by as much as a source has few or
unequal documents. So the mark is set where the words of the coins below it come nearest to the
words that the fraction asks for: words are summed by source and coin value in the same pass that
sums the sources. A source's taken words then differ from its target by at most half of the words
on one coin value, which is a document or two, or one COINS-th of a large source.

The excess rule has a closed form: there is one level L with sum(min(cap, L * weight)) equal
to the budget; sources are filled in the order of cap / weight. It is worked out over the
table of sources (one row each), never over documents.

Defined cases. A null source is a source of its own, the last in order. Null texts
have size 0; very long ones are counted whole. Documents of equal doc_id share a coin, those without one
if their texts are equal, so reruns and repeated rows agree. All sizes 0: targets 0, and such documents are taken at rate 0.
Empty tables give empty results. Other columns pass through; columns named like the
added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import count_blank_words, quoted, without, written

WEIGHTS = (5, 2, 1)
BUDGET_PERCENT = 150
MAX_EPOCHS = 2
SEED = "mix-1"
COINS = 65536
ADDED = ("size", "source_size", "target", "copies", "taken")


def coin(key: Column, text: Column, seed: str) -> Column:
    """0 to COINS - 1 from the document's id (its text where that is null) and the seed: 16 bits of an MD5."""
    named = F.coalesce(key.cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(F.md5(F.concat(named, F.lit(f"|{seed}"))), 1, 4), 16, 10).cast("int")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget_percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """sizes (source, source_size) -> the same with weight and target."""
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * max_epochs)
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.col("budget") - F.col("cap_before")) / (F.col("weight_all") - F.col("weight_before"))
    filled = (
        ranked.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("weight_all", F.sum("weight").over(everything))
        .withColumn("budget", F.sum("source_size").over(everything) * (budget_percent / 100))
        .withColumn("level", level)
        # the first source in filling order that its level does not fill sets the level of all after it;
        # taking later ones for filled only lowers the level, so the first has the highest
        .withColumn("final", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(everything))
    )
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("final") * F.col("weight"), F.col("cap").cast("double")))
    return filled.select("source", "source_size", "weight", target.alias("target"))


def marks(words: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, coin, words) and targets -> source, mark: coins below the mark give one copy more."""
    fraction = F.coalesce(F.col("t.target") / F.col("t.source_size"), F.lit(0.0))
    wanted = F.col("t.target") - F.floor(fraction) * F.col("t.source_size")
    below = F.sum("w.words").over(Window.partitionBy("w.source").orderBy("w.coin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("w.words")
    # a source has at most COINS rows here, and its window no documents
    rows = words.alias("w").join(targets.alias("t"), F.col("w.source").eqNullSafe(F.col("t.source")))
    rows = rows.select(F.col("w.source").alias("source"), F.col("w.coin").alias("coin"), wanted.alias("wanted"), (below + F.col("w.words") / 2).alias("middle"))
    return rows.filter("middle <= wanted and wanted > 0").groupBy("source").agg((F.max("coin") + 1).alias("mark"))


def rates(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget_percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The documents' columns with size, source_size, target, copies and taken."""
    toss = lambda d="": coin(F.col(f"{d}doc_id"), F.col(f"{d}text"), seed)
    sized = documents.select("source", toss().alias("coin"), count_blank_words(F.col("text")).alias("size"))
    words = written(sized.groupBy("source", "coin").agg(F.sum("size").alias("words")), "coin-words")
    sizes = words.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = written(source_targets(sizes, weights, budget_percent, max_epochs), "targets")
    both = targets.alias("t").join(marks(words, targets).alias("m"), F.col("t.source").eqNullSafe(F.col("m.source")), "left")
    both = written(both.select("t.source", "t.source_size", "t.target", F.coalesce("m.mark", F.lit(0)).alias("mark")), "marks")
    docs = without(documents, *ADDED)
    rows = docs.alias("d").join(both.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
    rate = F.coalesce(F.col("t.target") / F.col("t.source_size"), F.lit(0.0))
    rows = rows.select(
        *[F.col(f"d.{c}") for c in quoted(docs)],
        count_blank_words(F.col("d.text")).alias("size"),
        F.col("t.source_size").alias("source_size"),
        F.col("t.target").alias("target"),
        (F.floor(rate) + F.when(toss("d.") < F.col("t.mark"), 1).otherwise(0)).cast("long").alias("copies"),
    )
    return rows.select("*", (F.col("size") * F.col("copies")).alias("taken"))


def mix(documents: DataFrame, **settings) -> DataFrame:
    """The mixed corpus: each document as often as it is taken, in its own columns."""
    rows = rates(documents, **settings).filter("copies > 0")
    return rows.withColumn("__dl_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*quoted(documents))
