"""Nearest chunks and events, and the working set of a question."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions import text
from loomline.functions.vectors import cosine


def top_k(rows: DataFrame, query: list[float], k: int, key: list[str], doc_id: str | None = None) -> DataFrame:
    """The ``k`` rows whose ``embedding`` is nearest to the query, best first, with ``score``; rows without a usable vector never come. Ties go by ``key``.

    The query is a literal in the plan, and each task keeps its own best ``k`` only.
    """
    q = F.array(*(F.lit(float(v)) for v in query))
    length = F.lit(math.sqrt(sum(float(v) * float(v) for v in query)))
    own = rows if doc_id is None else rows.where(F.col("doc_id") == doc_id)
    scored = own.withColumn("score", cosine(F.col("embedding"), q, length)).where("score is not null and not isnan(score)")
    return scored.orderBy(F.col("score").desc(), *key).limit(k)


def top_k_each(rows: DataFrame, queries: DataFrame, k: int, key: list[str]) -> DataFrame:
    """The ``k`` nearest rows for each of ``queries(query_id, doc_id, query)`` within its document."""
    scored = rows.join(queries, "doc_id").withColumn("score", cosine(F.col("embedding"), F.col("query"))).where("score is not null and not isnan(score)")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), *key))
    return scored.withColumn("place", place).where(F.col("place") <= k)


def by_ids(events: DataFrame, ids: DataFrame) -> DataFrame:
    return events.join(ids.select("doc_id", "id").distinct(), ["doc_id", "id"], "left_semi")


def working_set(events: DataFrame, seeds: DataFrame, expanded: DataFrame) -> DataFrame:
    """Seeds and the other expanded events, in story order with ``place`` from 1 and ``is_seed``."""
    own = by_ids(events, seeds).withColumn("is_seed", F.lit(True))
    extra = by_ids(events, expanded).join(seeds.select("doc_id", "id"), ["doc_id", "id"], "left_anti").withColumn("is_seed", F.lit(False))
    pool = own.unionByName(extra)
    order = Window.partitionBy("doc_id").orderBy("stage_order", "first_page", "event_name", "id")
    return pool.withColumn("place", F.row_number().over(order))


def cited(pool: DataFrame, used: Column, fallback: int = 5) -> DataFrame:
    """The pool's events that an answer used, or its first ``fallback`` if it used none of them. ``used`` is an array of ids."""
    hit = F.coalesce(F.array_contains(used, F.col("id")), F.lit(False))
    any_ = F.max(hit).over(Window.partitionBy("doc_id"))
    return pool.withColumns({"_hit": hit, "_any": any_}).where("_hit or (not _any and place <= %d)" % fallback).drop("_hit", "_any")


def event_context(pool: DataFrame, slim: bool = False) -> DataFrame:
    """``doc_id, context``: the pool's events as text blocks in story order."""
    block = text.event_block(F.col("place"), F.col("id"), F.col("event_name"), F.col("timeline_anchor"), F.col("core_event"), F.col("source_pages"), slim)
    rows = pool.where("place <= 10") if slim else pool
    return rows.groupBy("doc_id").agg(text.ordered_text(["place"], block, "\n\n").alias("context"))


def passage_context(hits: DataFrame, short: bool = False) -> DataFrame:
    """``doc_id, context``: passages by rank; the short form takes three."""
    block = text.passage_block(F.col("place"), F.col("score"), F.col("content"), short)
    rows = hits.where("place <= 3") if short else hits
    return rows.groupBy("doc_id").agg(text.ordered_text(["place"], block, "\n\n---\n\n").alias("context"))


def retrieved_passages(hits: DataFrame) -> DataFrame:
    return hits.select(F.col("place").alias("rank"), F.round("score", 4).alias("score"), F.array("page_start", "page_end").alias("pages"), text.page_list(F.col("page_start"), F.col("page_end")).alias("cited_pages"), F.substring("content", 1, 280).alias("preview"))


def retrieved_events(pool: DataFrame) -> DataFrame:
    return pool.select(F.col("place").alias("rank"), "id", F.col("event_name").alias("name"), F.col("timeline_anchor").alias("stage"), "category", F.col("source_pages").alias("pages"), F.substring("core_event", 1, 280).alias("preview"))


def final_answer(hits: DataFrame, answers: DataFrame) -> DataFrame:
    """``doc_id, answer``: of ``answers(doc_id, first, second)`` the first unless it refuses, then the second, then a sentence made from the hits' pages."""
    span = hits.groupBy("doc_id").agg(F.min("page_start").alias("low"), F.max("page_start").alias("high"))
    x = answers.join(span, "doc_id", "left")
    made = F.format_string(
        "No answer: the nearest passages lie between p. %d and p. %d, and similarity alone does not tell what came first.", "low", "high"
    )
    made = F.when(F.col("low").isNull(), F.lit(None)).otherwise(made)
    second = F.coalesce("second", F.lit(""))
    out = F.when(~text.says_any(F.col("first"), text.REFUSALS), F.col("first")).when((second != "") & ~text.says_any(second, text.REFUSALS_AGAIN), second).otherwise(made)
    return x.select("doc_id", out.alias("answer"))
