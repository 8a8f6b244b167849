"""How good an order is, and what a build made."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _positions(ordered: DataFrame, pick: str) -> DataFrame:
    """Of equal names the first or the last position."""
    return ordered.groupBy("doc_id", "event_name").agg(getattr(F, pick)("pos").alias("pos"))


def _in_order(later: np.ndarray) -> int:
    """The pairs i < j with later[i] < later[j], by merging sorted blocks: n log n steps at a time."""
    rank = np.unique(later, return_inverse=True)[1].astype(np.int64)
    n, found, width = len(rank), 0, 1
    place = np.arange(n)
    while width < n:
        block = place // (2 * width)
        key = block * (n + 1) + rank
        right = (place // width) % 2 == 1
        left_keys = key[~right]  # both halves are sorted, so their keys are
        first = np.searchsorted(left_keys, block[right] * (n + 1))
        found += int((np.searchsorted(left_keys, key[right]) - first).sum())
        rank = rank[np.argsort(key, kind="stable")]
        width *= 2
    return found


def concordance(pairs: DataFrame) -> DataFrame:
    """``doc_id, pairs, agree`` of ``doc_id, g, s``: the pairs of rows that differ in ``g``, and those of them that ``s`` orders alike.

    A document's positions are sorted and merged in one task, in n log n steps; pairs are never rows.
    """

    def run(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["g", "s"], ascending=[True, False])  # rows with the same g do not agree
        same = x["g"].value_counts().to_numpy().astype(np.int64)
        n = len(x)
        total = n * (n - 1) // 2 - int((same * (same - 1) // 2).sum())
        return pd.DataFrame({"doc_id": [x["doc_id"].iloc[0]], "pairs": [total], "agree": [_in_order(x["s"].to_numpy())]})

    held = pairs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("g").cast("long").alias("g"), F.col("s").cast("long").alias("s"))
    return held.groupBy("doc_id").applyInPandas(run, "doc_id string, pairs long, agree long").where("pairs > 0")


def pairwise_accuracy(system: DataFrame, gold: DataFrame) -> DataFrame:
    """``doc_id, pairwise_accuracy``: the share of gold pairs that the system orders alike; null with fewer than two shared names.

    Both sides are ``(doc_id, pos, event_name)``. Of names that come twice the gold side counts the first, the system side the last.
    """
    both = _positions(gold, "min").withColumnRenamed("pos", "g").join(_positions(system, "max").withColumnRenamed("pos", "s"), ["doc_id", "event_name"])
    return gold.select("doc_id").distinct().join(concordance(both), "doc_id", "left").select("doc_id", F.round(F.col("agree") / F.col("pairs"), 4).alias("pairwise_accuracy"))


def kendall_tau(system: DataFrame, gold: DataFrame) -> DataFrame:
    """``doc_id, kendall_tau``: (concordant - discordant) over all pairs of the gold names that the system has; names given twice count as discordant with themselves."""
    used = gold.join(_positions(system, "max").withColumnRenamed("pos", "s"), ["doc_id", "event_name"]).select("doc_id", F.col("pos").alias("g"), "s")
    return gold.select("doc_id").distinct().join(concordance(used), "doc_id", "left").select("doc_id", F.round((2 * F.col("agree") - F.col("pairs")) / F.col("pairs"), 4).alias("kendall_tau"))


def summary(doc_ids: DataFrame, events: DataFrame) -> DataFrame:
    """One row per document, also for those without events: counts, merges and rates."""
    sums = events.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("category") == "major").alias("major"), F.count_if(F.col("category") == "minor").alias("minor"), F.sum(F.col("merge_count") - 1).alias("merges"),
        F.count_if(F.size("source_pages") > 0).alias("traced"), F.sum(F.greatest(F.size("source_pages"), F.lit(0))).alias("pages"),
    )
    x = doc_ids.select("doc_id").distinct().join(sums, "doc_id", "left").na.fill(0)
    raw, n = F.col("n") + F.col("merges"), F.greatest(F.col("n"), F.lit(1))
    return x.select(
        "doc_id", F.col("n").alias("events_total"), F.col("major").alias("events_major"), F.col("minor").alias("events_minor"), "merges", raw.alias("raw_events"),
        F.round(F.when(raw > 0, F.col("merges") / raw).otherwise(0.0), 4).alias("duplicate_rate"), F.round(F.col("traced") / n, 4).alias("page_traceability"), F.round(F.col("pages") / n, 2).alias("avg_pages_per_event"),
    )


def row_counts(doc_ids: DataFrame, **tables: DataFrame) -> DataFrame:
    """``doc_id`` and for each table its number of rows of the document."""
    out = doc_ids.select("doc_id").distinct()
    for name, df in tables.items():
        out = out.join(df.groupBy("doc_id").agg(F.count("*").alias(name)), "doc_id", "left").na.fill(0, [name])
    return out


def run_averages(runs: DataFrame) -> DataFrame:
    """``doc_id, runs`` and rounded averages of latency and tokens of both pipelines."""
    mean = lambda c: F.bround(F.coalesce(F.avg(c), F.lit(0.0)), 0).cast("int").alias(f"avg_{c}")
    return runs.groupBy("doc_id").agg(F.count("*").alias("runs"), *map(mean, ("naive_ms", "timeline_ms", "naive_tokens", "timeline_tokens")))


def stage_distribution(events: DataFrame) -> DataFrame:
    """``doc_id, timeline_anchor, n``: events by anchor as written."""
    return events.groupBy("doc_id", "timeline_anchor").agg(F.count("*").alias("n"))


def stage_map(events: DataFrame) -> DataFrame:
    """``doc_id, stages``: the distribution as one map."""
    rows = F.array_sort(F.collect_list(F.struct("timeline_anchor", "n")))
    return stage_distribution(events).groupBy("doc_id").agg(F.map_from_entries(F.filter(rows, lambda r: r["timeline_anchor"].isNotNull())).alias("stages"))


def as_positions(events: DataFrame, *order: str) -> DataFrame:
    """``doc_id, pos, event_name`` by an order."""
    return events.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)).alias("pos"), "event_name")
