"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

Each source wants its weight's share of all words, but no more than ``cap`` times what it has.
Sources at their cap are clamped and their excess goes to the others by weight, until no source is above: the
water level is found in one pass over the sources in order of cap per weight. A source takes each
document as often as the whole part of target / size says, and one more time the documents
that come first in a seeded order, up to the fraction's words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.llm.common import WORD, drop_stash, stash

CAP = 3
#: Bins of the seeded order; only the documents of one bin per source are ordered one by one.
BIN_DIGITS = 3


def seeded_order(doc_id: Column, seed: int) -> Column:
    """The hex text that orders documents: md5 of seed and id."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def targets(sources: DataFrame, cap: int = CAP) -> DataFrame:
    """Add ``target`` to ``source, source_size, weight``. The table has one row per source."""
    # water level: the first source, in order of cap per weight, that the rest's share does not fill
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "weight", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    full = Window.partitionBy()
    level = (F.sum("source_size").over(full) - F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0))) / F.sum("weight").over(rest)
    # the level rises while sources are clamped and falls afterwards, so its maximum is the one that holds
    x = sources.withColumn("level", level).withColumn("water", F.max("level").over(full))
    share = F.col("water") * F.col("weight")
    capped = (F.col("source_size") * cap).cast("double")
    return x.withColumn("target", F.when(share >= capped, capped).otherwise(share)).drop("level", "water")


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size.alias("size"), seeded_order(F.col("doc_id").cast("long"), seed).alias("rank"))


def plan(sized: DataFrame, cap: int = CAP, weights: Column | None = None) -> DataFrame:
    """One row per source: ``p_source, source_size, target, whole`` and ``stop``, the last place of the seeded order that counts once more."""
    weights = F.col("place") % 3 + 1 if weights is None else weights
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    base = sized.withColumn("bin", F.substring("rank", 1, BIN_DIGITS))
    bins = stash(base.groupBy("source", "bin").agg(F.sum("size").alias("bin_size")))
    named = bins.groupBy("source").agg(F.sum("bin_size").alias("source_size"))
    placed = named.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    goals = targets(placed.withColumn("weight", weights.cast("long")).select("source", "source_size", "weight"), cap)
    goals = goals.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goals = stash(goals.withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size")).withColumnRenamed("source", "p_source"))
    # the bin in which the fraction's words end, and in it the document
    upto = F.sum("bin_size").over(Window.partitionBy("source").orderBy("bin"))
    cuts = bins.withColumn("upto", upto).join(goals, same("source", "p_source"))
    edge = cuts.where((F.col("upto") > F.col("extra")) & (F.col("upto") - F.col("bin_size") <= F.col("extra")))
    edge = stash(edge.select(F.col("source").alias("e_source"), F.col("bin").alias("e_bin"), (F.col("upto") - F.col("bin_size")).alias("e_before"), "extra"))
    x = base.join(edge, same("source", "e_source") & (F.col("bin") == F.col("e_bin")))
    run = F.sum("size").over(Window.partitionBy("source").orderBy("rank", "doc_id")) + F.col("e_before")
    # a document in which the fraction ends counts if that comes nearer
    last = x.withColumn("run", run).where(F.col("run") - F.col("size") / 2 <= F.col("extra")).groupBy(F.col("e_source").alias("l_source")).agg(F.max("rank").alias("l_rank"))
    stops = edge.join(last, same("e_source", "l_source"), "left").select("e_source", F.coalesce("l_rank", "e_bin").alias("stop"))
    out = stash(goals.join(stops, same("p_source", "e_source"), "left").select("p_source", "source_size", "target", "whole", F.when(F.col("whole") < cap, F.col("stop")).alias("stop")))
    for x in (bins, goals, edge):
        drop_stash(x)
    return out


def repeats(rank: Column) -> Column:
    """How often a document at ``rank`` is taken, next to its source's row of the plan."""
    return (F.col("whole") + F.coalesce(rank <= F.col("stop"), F.lit(False)).cast("long")).cast("long")


def mix(docs: DataFrame, cap: int = CAP, seed: int = 7, weights: Column | None = None) -> DataFrame:
    """How many words of each document the mix takes: ``doc_id, source, size, source_size, target, repeats, taken``.

    ``docs`` needs ``doc_id``, ``text`` and ``source``; other columns are ignored. Size is the number of words; null or blank texts
    have size 0 and take nothing. ``weights`` is an expression over ``place``, the
    source's place from 0 in code point order with null last; the default is 1, 2, 3, repeating. Rows
    with the same id share their place in the seeded order. A text of any length counts with all its words. An empty table gives an empty table.
    """
    sized = stash(_sized(docs, seed))
    out = sized.join(plan(sized, cap, weights), F.col("source").eqNullSafe(F.col("p_source"))).withColumn("repeats", repeats(F.col("rank")))
    return out.select("doc_id", "source", "size", "source_size", "target", "repeats", (F.col("size") * F.col("repeats")).alias("taken"))


def draw(docs: DataFrame, cap: int = CAP, seed: int = 7) -> DataFrame:
    """The mix itself: every row of ``docs``, with all its columns, as often as the mix takes it.

    Nulls, blank and very long texts, repeated rows and empty tables count as ``mix`` says; documents that the mix takes no words of are gone, unless
    they have none: those come as often as their place in the order says.
    """
    goals = plan(stash(_sized(docs, seed)), cap).select("p_source", "whole", "stop")
    rank = seeded_order(docs["doc_id"].cast("long"), seed)
    held = docs.select(F.struct(*docs.columns).alias("row"), docs["source"].alias("r_source"), rank.alias("r_rank"))
    taken = held.join(goals, F.col("r_source").eqNullSafe(F.col("p_source"))).withColumn("n", repeats(F.col("r_rank"))).where("n > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy")).select("row.*")
