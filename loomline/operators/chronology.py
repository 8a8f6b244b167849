"""Story time: framing, clean pages, stage order, and the total order of a document's events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions import stages
from loomline.functions.text import FRAME_HINTS, event_id, says_any

#: The total order of events; ``seq`` settles ties.
ORDER = ("stage_order", "first_page", "event_name", "seq")


def frame_target(taxonomy: Column) -> Column:
    """The last framing stage, or the last stage."""
    framing = F.filter(taxonomy, lambda s: s["is_framing"])
    return F.coalesce(F.try_element_at(framing, F.lit(-1))["name"], F.try_element_at(taxonomy, F.lit(-1))["name"])


def clean_pages(pages: Column) -> Column:
    return F.array_sort(F.array_distinct(F.coalesce(pages, F.array().cast("array<int>"))))


def chronology(events: DataFrame, taxonomies: DataFrame | None = None) -> DataFrame:
    """Events with clean ``source_pages``, ``first_page``, overridden ``timeline_anchor``, ``stage_order``, ``stage_name`` and their ``rank`` from 1.

    ``taxonomies(doc_id, taxonomy)`` gives each document's stages; documents without use the default ones.
    """
    # before the join, so that it need not move the texts
    hinted = says_any(F.concat_ws(" ", F.coalesce("event_name", F.lit("")), F.coalesce("core_event", F.lit(""))), FRAME_HINTS)
    events = events.withColumn("_hinted", hinted)
    if taxonomies is not None:
        own = taxonomies.select("doc_id", stages.normalize(F.col("taxonomy")).alias("tax"), (F.size("taxonomy") > 0).alias("has"))
        x = events.join(own, "doc_id", "left").withColumn("tax", F.when(F.col("has"), F.col("tax")).otherwise(stages.default_stages(framing=False))).drop("has")
    else:
        x = events.withColumn("tax", stages.default_stages(framing=False))
    x = x.withColumn("source_pages", clean_pages(F.col("source_pages")))
    x = x.withColumns({"first_page": F.coalesce(F.try_element_at("source_pages", F.lit(1)), F.lit(0)), "timeline_anchor": F.when(F.col("_hinted"), frame_target(F.col("tax"))).otherwise(F.col("timeline_anchor"))})
    names = stages.names(F.col("tax"))
    x = x.withColumn("stage_order", stages.stage_index(F.col("timeline_anchor"), names))
    x = x.withColumn("stage_name", F.try_element_at(names, F.col("stage_order") + 1)).drop("tax", "_hinted")
    return ranked(x)


def ranked(events: DataFrame) -> DataFrame:
    order = Window.partitionBy("doc_id").orderBy(*(c for c in ORDER if c in events.columns))
    return events.withColumn("rank", F.row_number().over(order))


def with_ids(events: DataFrame) -> DataFrame:
    return events.withColumn("id", event_id(F.col("doc_id"), F.col("seq"), F.col("event_name")))
