"""Exact deduplication by content sort, in DataFrame operations only.

Normalised texts are range-partitioned on sampled splitters and sorted in each partition, so
equal texts stand next to each other: a text that differs from its neighbour begins a run of equal ones, and a run's
rows read their group from it. Splitters are the first characters and a hash of a text, so what the driver samples is small however long
the texts are; texts that agree in both are told apart by comparing them whole.

A first pass counts texts by hash. Those with more rows than a share of a partition - there can only be a few of them for each partition -
are dealt over several places by a salt, and the runs of one text are combined by its digest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.llm.common import ascii_lower, drop_stash, one_of_each, stash

#: Characters of a text in the splitters.
HEAD = 64
#: A text is hot with more rows than this, and than a partition's rows divided by HOT_SHARE.
HOT_ROWS, HOT_SHARE = 1000, 4


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Texts are equal when identical after
    lower-casing A-Z; null counts as empty. Of equal texts the row with the largest ``doc_id``
    stays; a null id is smaller than any other. Rows that share the largest id are told apart
    by nothing here, so all of them are marked. Texts of any length are compared whole. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), ascii_lower(F.coalesce(F.col("text"), F.lit(""))).alias("norm"))
    keyed = base.withColumn("mark", F.xxhash64("norm"))
    counts = stash(keyed.groupBy("mark").agg(F.count("*").alias("n")))
    rows = counts.agg(F.sum("n")).first()[0] or 0
    most = max(HOT_ROWS, rows // (HOT_SHARE * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    # at most HOT_SHARE times as many hashes as partitions are that frequent, so their table may go to every task
    hot = F.broadcast(counts.where(F.col("n") > most).select("mark", F.ceil(F.col("n") / most).cast("int").alias("places")))
    # rows without an id are dealt by where they come from
    spread = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")).otherwise(F.spark_partition_id().cast("long"))
    salt = F.when(F.col("places").isNotNull(), F.pmod(spread, F.col("places").cast("long")).cast("int"))
    laid = keyed.join(hot, "mark", "left").select("doc_id", "norm", F.substring("norm", 1, HEAD).alias("head"), "mark", salt.alias("salt"))
    laid = laid.repartitionByRange("head", "mark", "salt")
    # each range is sorted where it lies; each text is compared with the one before
    beside = Window.partitionBy("head", "mark", "salt").orderBy("norm", "doc_id")
    compared = laid.withColumn("begins", ~F.lag("norm").over(beside).eqNullSafe(F.col("norm")))
    numbered = compared.withColumn("run", F.sum(F.col("begins").cast("int")).over(beside.rowsBetween(Window.unboundedPreceding, 0)))
    short = numbered.select("doc_id", "head", "mark", "salt", "run", F.when(F.col("begins"), F.sha2("norm", 256)).alias("sha"))
    run = Window.partitionBy("head", "mark", "salt", "run")
    placed = stash(short.select("doc_id", F.max("sha").over(run).alias("text_sha256"), "salt", F.max("doc_id").over(run).alias("keep_id"), F.count("*").over(run).alias("group_size")))
    drop_stash(counts)
    # the runs of a hot text, which stand in several places
    several = placed.where("salt is not null")
    runs = several.groupBy("text_sha256", "salt").agg(F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"))
    whole = runs.groupBy("text_sha256").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    keys = runs.select("text_sha256", "salt").join(whole, "text_sha256")
    joined = several.select("doc_id", "text_sha256", "salt").join(keys, ["text_sha256", "salt"])
    columns = ["doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"]
    return placed.where("salt is null").select(*columns).unionByName(joined.select(*columns))


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """Of each set of equal texts the row with the largest ``doc_id``, with all its columns; of rows that share that id too, the first by their other columns.

    Nulls, empty and very long texts and empty tables count as ``exact_dedup`` says.
    """
    kept = exact_dedup(docs).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    return one_of_each(docs, kept, {"_id": docs["doc_id"].cast("long"), "_sha": F.sha2(ascii_lower(F.coalesce(docs["text"], F.lit(""))), 256)})
