"""The ordered merge of event instructions into events, per document.

An instruction either adds an event or extends the latest event of the name that it
points to. ``fold`` is one ``aggregate`` over a document's instructions in order, so the whole operator is a
single shuffle by document and runs in the JVM; ``fold_arrow`` does the same in Python, in
linear time for documents with very many events.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVENT = "struct<seq:int,event_name:string,category:string,timeline_anchor:string,location:string,characters:array<string>,core_event:string,antecedent_cause:string,consequent_effect:string,source_pages:array<int>,merge_count:int>"
FIELDS = ("seq", "event_name", "category", "timeline_anchor", "location", "characters", "core_event", "antecedent_cause", "consequent_effect", "source_pages", "merge_count")


def flat(instructions: DataFrame) -> DataFrame:
    """Instructions with their inferred event's fields as columns, and ``seq``-able by (batch, pos)."""
    e = F.col("inferred_event")
    text = lambda c: F.coalesce(c, F.lit(""))
    pages = F.array_sort(F.array_distinct(F.filter(F.coalesce(e["source_pages"], F.array().cast("array<int>")), lambda p: p > 0)))
    return instructions.select(
        "doc_id", "batch", "pos", F.coalesce("is_duplicate", F.lit(False)).alias("dup"), text(F.col("matched_event_name")).alias("matched"), text(e["event_name"]).alias("event_name"), "category",
        e["timeline_anchor"].alias("timeline_anchor"), text(e["location"]).alias("location"), F.coalesce(e["characters_present"], F.array().cast("array<string>")).alias("characters"), text(e["core_event"]).alias("core_event"),
        text(e["antecedent_cause"]).alias("antecedent_cause"), text(e["consequent_effect"]).alias("consequent_effect"), pages.alias("source_pages"),
    )


def _joined(held: Column, more: Column) -> Column:
    """Text extended by more text that it does not hold yet."""
    longer = F.regexp_replace(F.concat(held, F.lit(" | "), more), r"^[ |]+|[ |]+$", "")
    return F.when((more != "") & ~F.contains(held, more), longer).otherwise(held)


def fold(instructions: DataFrame) -> DataFrame:
    """Events of every document: ``doc_id`` and the fields of EVENT; ``seq`` is the order in which they came to be."""
    rows = F.array_sort(F.collect_list(F.struct(*(c for c in flat(instructions).columns if c not in ("doc_id",)))))
    docs = flat(instructions).groupBy("doc_id").agg(rows.alias("rows"))

    def step(events: Column, x: Column) -> Column:
        back = F.array_position(F.reverse(F.transform(events, lambda e: e["event_name"])), x["matched"])
        at = F.when(x["dup"] & (x["matched"] != "") & (back > 0), F.size(events) - back)

        def extended(e: Column) -> Column:
            return F.struct(
                e["seq"].alias("seq"), e["event_name"].alias("event_name"), e["category"].alias("category"), e["timeline_anchor"].alias("timeline_anchor"), e["location"].alias("location"),
                F.concat(e["characters"], F.array_distinct(F.array_except(x["characters"], e["characters"]))).alias("characters"), e["core_event"].alias("core_event"),
                _joined(e["antecedent_cause"], x["antecedent_cause"]).alias("antecedent_cause"), _joined(e["consequent_effect"], x["consequent_effect"]).alias("consequent_effect"),
                F.array_sort(F.array_union(e["source_pages"], x["source_pages"])).alias("source_pages"), (e["merge_count"] + 1).alias("merge_count"),
            ).cast(EVENT)

        new = F.struct(F.size(events).alias("seq"), *(x[c].alias(c) for c in FIELDS[1:-1]), F.lit(1).alias("merge_count")).cast(EVENT)
        return F.when(at.isNull(), F.concat(events, F.array(new))).otherwise(F.transform(events, lambda e, i: F.when(i == at, extended(e)).otherwise(e)))

    folded = F.aggregate("rows", F.array().cast(f"array<{EVENT}>"), step)
    return docs.select("doc_id", F.explode(folded).alias("e")).select("doc_id", "e.*")


class Folder:
    """The fold's state for one document: events in order, and the latest event of each name."""

    def __init__(self, events: list[dict] | None = None):
        self.events = events or []
        self.latest = {e["event_name"]: i for i, e in enumerate(self.events)}
        self.added = self.merged = 0

    def take(self, x) -> None:
        pages = [int(p) for p in x["source_pages"]]
        at = self.latest.get(x["matched"]) if x["dup"] and x["matched"] else None
        if at is None:
            self.latest[x["event_name"]] = len(self.events)
            self.events.append({"seq": len(self.events), **{c: x[c] for c in FIELDS[1:-1]}, "characters": list(x["characters"]), "source_pages": pages, "merge_count": 1})
            self.added += 1
            return
        e = self.events[at]
        e["source_pages"] = sorted({*e["source_pages"], *pages})
        for c in ("antecedent_cause", "consequent_effect"):
            if x[c] and x[c] not in e[c]:
                e[c] = f"{e[c]} | {x[c]}".strip(" |")
        for name in x["characters"]:
            if name not in e["characters"]:
                e["characters"].append(name)
        e["merge_count"] += 1
        self.merged += 1


EVENT_COLUMNS = EVENT.removeprefix("struct<").removesuffix(">").replace("seq:int", "doc_id:string,seq:int", 1)


def fold_arrow(instructions: DataFrame) -> DataFrame:
    """``fold`` in Python, one document at a time."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        folder = Folder()
        for x in rows.sort_values(["batch", "pos"]).to_dict("records"):
            folder.take(x)
        return pd.DataFrame([{"doc_id": rows["doc_id"].iloc[0], **e} for e in folder.events])

    schema = ", ".join(" ".join(x.split(":", 1)) for x in _top_level(EVENT_COLUMNS))
    return flat(instructions).groupBy("doc_id").applyInPandas(run, schema)


def _top_level(fields: str) -> list[str]:
    """Split a field list at its outer commas."""
    out, depth = [""], 0
    for c in fields:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def light_index(events: DataFrame) -> DataFrame:
    """``doc_id, known``: what a model is told of each document's events, as JSON in a fixed order."""
    order = ["seq"] if "seq" in events.columns else []
    rows = F.array_sort(F.collect_list(F.struct(*order, "event_name", "category", "timeline_anchor", "core_event")))
    return events.groupBy("doc_id").agg(F.to_json(F.transform(rows, lambda r: F.struct(*(r[c].alias(c) for c in ("event_name", "category", "timeline_anchor", "core_event"))))).alias("known"))


def merge_prompt(batches: DataFrame, index: DataFrame, lines: DataFrame, pages: int | DataFrame) -> DataFrame:
    """``doc_id, batch, user``: each batch with the stages and the events known before it. ``pages`` is the number of pages, or a table ``doc_id, pages`` of it."""
    x = batches.join(index, "doc_id", "left").join(lines, "doc_id", "left")
    x = x.withColumn("pages", F.lit(pages)) if isinstance(pages, int) else x.join(pages, "doc_id", "left")
    known, stages = F.coalesce("known", F.lit("[]")), F.coalesce("lines", F.lit(""))
    return x.select("doc_id", "batch", F.concat(F.lit("PAGES "), F.coalesce("pages", F.lit(1)).cast("string"), F.lit("\n"), stages, F.lit("\nKNOWN EVENTS: "), known, F.lit("\nOBSERVATIONS:\n"), "text").alias("user"))


def stats(instructions: DataFrame, events: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """``doc_id, added, merged, failed``: instructions that made events, that extended them, and batches without a result."""
    total = instructions.groupBy("doc_id").agg(F.count("*").alias("n"))
    made = events.groupBy("doc_id").agg(F.count("*").alias("added"))
    out = total.join(made, "doc_id", "left").select("doc_id", F.coalesce("added", F.lit(0)).alias("added"), (F.col("n") - F.coalesce("added", F.lit(0))).alias("merged"))
    if failed is None:
        return out.withColumn("failed", F.lit(0).cast("long"))
    bad = failed.groupBy("doc_id").agg(F.count("*").alias("failed"))
    return out.join(bad, "doc_id", "full").na.fill(0, ["added", "merged", "failed"])
