"""Stage taxonomies: normalising them, and placing free-text anchors in them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomline.functions.text import strip
from loomline.schemas import STAGE

# The stages that stand in where a document has none.
DEFAULT_STAGES = ("Beginning / Setup", "Rising Action", "Midpoint / Complication", "Climax", "Resolution / Aftermath")
LEAST, MOST = 5, 7


def stage(name: Column, description: Column, framing: Column) -> Column:
    return F.struct(name.alias("name"), description.alias("description"), framing.alias("is_framing")).cast(STAGE)


def default_stages(framing: bool = True) -> Column:
    last = len(DEFAULT_STAGES) - 1
    return F.array(*(stage(F.lit(n), F.lit(""), F.lit(framing and i == last)) for i, n in enumerate(DEFAULT_STAGES)))


def normalize(stages: Column) -> Column:
    """Named stages only, seven at most, padded to five, and one of them framing."""
    blank = F.lit("")
    clean = F.transform(F.coalesce(stages, F.array().cast(f"array<{STAGE}>")), lambda s: stage(strip(F.coalesce(s["name"], blank)), strip(F.coalesce(s["description"], blank)), F.coalesce(s["is_framing"], F.lit(False))))
    named = F.slice(F.filter(clean, lambda s: s["name"] != ""), 1, MOST)
    missing = F.filter(default_stages(), lambda d: ~F.exists(named, lambda s: s["name"] == d["name"]))
    full = F.when(F.size(named) >= LEAST, named).otherwise(F.slice(F.concat(named, missing), 1, LEAST))
    framed = F.transform(full, lambda s, i: stage(s["name"], s["description"], i == F.size(full) - 1))
    return F.when(F.exists(full, lambda s: s["is_framing"]), full).otherwise(framed)


def names(stages: Column) -> Column:
    """The stages' names, or the default ones."""
    found = F.filter(F.transform(stages, lambda s: strip(F.coalesce(s["name"], F.lit("")))), lambda n: n != "")
    return F.when(F.size(found) > 0, found).otherwise(F.array(*map(F.lit, DEFAULT_STAGES)))


def parse(json: Column) -> Column:
    """Stages from JSON text; missing or broken text gives the default ones, anything else is normalised."""
    found = F.from_json(json, f"array<{STAGE}>")
    return F.when(found.isNull() | (F.size(found) == 0), default_stages()).otherwise(normalize(found))


def view(stages: Column) -> Column:
    """Named stages as they are, without the limits on their number."""
    return F.filter(stages, lambda s: strip(F.coalesce(s["name"], F.lit(""))) != "")


def line(place: Column, one: Column) -> Column:
    """A stage as it stands in a prompt; ``place`` counts from 0."""
    framing = F.when(one["is_framing"], " [FRAMING]").otherwise("")
    described = F.when(F.coalesce(one["description"], F.lit("")) == "", "").otherwise(F.concat(F.lit(" - "), one["description"]))
    return F.concat((place + 1).cast("string"), F.lit(". "), one["name"], framing, described)


def _words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.regexp_replace(text, "[/-]", " "), r"\s+"), lambda t: F.length(t) > 2))


def stage_index(anchor: Column, stage_names: Column) -> Column:
    """The place of a free-text anchor: exact name, else containment either way, else most shared words, else the second stage."""
    n = F.size(stage_names)
    default = F.least(F.lit(1), n - 1)
    place = lambda name: n - F.array_position(F.reverse(stage_names), name).cast("int")  # noqa: E731  of equal names the last counts
    distinct = F.array_distinct(stage_names)
    low = strip(F.lower(F.coalesce(anchor, F.lit(""))))
    holds = F.filter(distinct, lambda s: low.contains(F.lower(s)) | F.contains(F.lower(s), low))
    scores = F.transform(distinct, lambda s: F.struct(F.size(F.array_intersect(_words(low), _words(F.lower(s)))).alias("score"), s.alias("name")))
    best = F.array_max(F.transform(scores, lambda s: s["score"]))
    first = F.try_element_at(F.filter(scores, lambda s: s["score"] == best), F.lit(1))["name"]
    out = F.when(F.array_contains(stage_names, F.coalesce(anchor, F.lit(""))) & anchor.isNotNull(), place(anchor))
    out = out.when(low == "", default).when(F.size(holds) > 0, place(F.try_element_at(holds, F.lit(1)))).when(best > 0, place(first)).otherwise(default)
    return out.cast("int")
