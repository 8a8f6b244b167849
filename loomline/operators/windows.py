"""Overlapping windows over a document's characters and pages, and ordered batches.

Both window counts have a closed form, so a document is cut by one ``sequence``; the only shuffle brings a document's pages together.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.text import ordered_text, strip


def starts(length: Column, size: int, overlap: int) -> Column:
    """Offsets of the windows over ``length`` items: the last one is the first that reaches the end. Null for nothing."""
    step = max(1, size - overlap)
    last = F.greatest(F.lit(0), F.ceil((length - size) / step)).cast("int")
    return F.when(length > 0, F.transform(F.sequence(F.lit(0), last), lambda k: k * step))


def lines_as_pages(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """A document's lines as its pages."""
    return docs.select(F.col(id_column).alias("doc_id"), F.posexplode(F.split(text_column, "\n")).alias("page_no", "content")).withColumn("page_no", F.col("page_no") + 1)


def char_chunks(pages: DataFrame, size: int = 1200, overlap: int = 200) -> DataFrame:
    """``doc_id, chunk_index, page_start, page_end, content`` of ``pages(doc_id, page_no, content)``.

    Blank windows take no index. A page's text owns the line feed after it. Time grows with a document's length: its text is cut
    once into pieces that windows are made of, and every page says for how many windows it holds the first or the last character, which by
    arithmetic gives the pages of all windows without a lookup.
    """
    step = max(1, size - overlap)
    piece = math.gcd(step, size)
    content = F.coalesce("content", F.lit(""))
    before = Window.partitionBy("doc_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    laid = pages.select("doc_id", "page_no", content.alias("content"), F.coalesce(F.sum(F.length(content) + 1).over(before), F.lit(0)).cast("long").alias("at"))
    docs = laid.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "content", "at"))).alias("p"))
    docs = docs.select("doc_id", F.transform("p", lambda x: F.struct(x["page_no"].alias("page_no"), x["at"].alias("at"), F.length(x["content"]).alias("n"))).alias("marks"), F.array_join(F.transform("p", lambda x: x["content"]), "\n").alias("full"))

    def holders(offset: int) -> Column:
        """For k = 0, 1, ... the page that holds the character ``k * step + offset``."""

        def times(m: Column) -> Column:
            low, high = F.greatest(m["at"] - offset, F.lit(0)), m["at"] + m["n"] - offset
            return F.when(high >= 0, F.greatest(F.lit(0), F.floor(high / step) - F.ceil(low / step) + 1)).otherwise(0).cast("int")

        return F.flatten(F.transform("marks", lambda m: F.array_repeat(m["page_no"], times(m))))

    n = F.length("full")
    end = F.element_at(F.filter("marks", lambda m: m["at"] < n), -1)["page_no"]
    pieces = F.regexp_extract_all("full", F.lit(f"(?s).{{1,{piece}}}"), F.lit(0))
    # one column for all that the windows read, so that it is made once for each document
    made = docs.where("full <> ''").select("doc_id", F.struct(n.alias("n"), pieces.alias("pieces"), holders(0).alias("first"), holders(size - 1).alias("last"), end.alias("end"), starts(n, size, overlap).alias("starts")).alias("d"))
    d = F.col("d")

    def window(at: Column, k: Column) -> Column:
        whole = at + size <= d["n"]
        text = F.array_join(F.slice(d["pieces"], F.floor(at / piece).cast("int") + 1, F.lit(size // piece)), "")
        return F.struct(at.alias("at"), strip(text).alias("content"), F.get(d["first"], k).cast("int").alias("page_start"), F.when(whole, F.get(d["last"], k)).otherwise(d["end"]).cast("int").alias("page_end"))

    cuts = made.select("doc_id", F.explode(F.transform(d["starts"], window)).alias("w")).select("doc_id", "w.*").where("content <> ''")
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy("at")) - 1
    return cuts.select("doc_id", index.alias("chunk_index"), "page_start", "page_end", "content")


def page_windows(pages: DataFrame, size: int = 10, overlap: int = 2) -> DataFrame:
    """``doc_id, window_id, page_start, page_end, text``: windows over pages, each page under a mark with its number."""
    docs = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", F.coalesce("content", F.lit("")).alias("content")))).alias("p"))
    out = docs.select("doc_id", "p", F.explode(starts(F.size("p"), size, overlap)).alias("at"))
    part = F.slice("p", F.col("at") + 1, F.lit(size))
    body = F.array_join(F.transform(part, lambda x: F.concat(F.lit("[PAGE "), x["page_no"].cast("string"), F.lit("]\n"), x["content"])), "\n")
    out = out.select("doc_id", (F.col("at") + 1).alias("page_start"), F.least(F.col("at") + size, F.size("p")).alias("page_end"), strip(body).alias("text"))
    return out.select("doc_id", F.concat(F.lit("win_"), F.col("page_start").cast("string"), F.lit("_"), F.col("page_end").cast("string")).alias("window_id"), "page_start", "page_end", "text")


def observation_block(start: Column, end: Column, text: Column) -> Column:
    return F.concat(F.lit("--- pages "), start.cast("string"), F.lit("-"), end.cast("string"), F.lit(" ---\n"), text)


def digest(observations: DataFrame, max_chars: int | None = 12000) -> DataFrame:
    """``doc_id, digest`` of ``observations(doc_id, page_start, page_end, raw_text)``: blocks from the start, middle and end within a budget, or whole ones if ``max_chars`` is None."""
    order = Window.partitionBy("doc_id").orderBy("page_start", "page_end", "raw_text")
    n = F.count("*").over(Window.partitionBy("doc_id"))
    x = observations.withColumns({"i": F.row_number().over(order) - 1, "n": n})
    third = lambda k: F.floor(F.col("n") * k / 4)
    picked = (F.col("n") <= 8) | (F.col("i") < 2) | (F.col("i") >= F.col("n") - 2) | F.col("i").isin(third(1), third(2), third(3))
    x = x.where(picked).select("doc_id", "i", observation_block(F.col("page_start"), F.col("page_end"), F.coalesce("raw_text", F.lit(""))).alias("block"))
    if max_chars is None:
        return x.groupBy("doc_id").agg(ordered_text(["i"], F.col("block"), "\n\n").alias("digest"))
    used = F.coalesce(F.sum(F.length("block")).over(Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = x.withColumn("left", F.lit(max_chars) - used)
    x = x.where((F.col("left") > 200) | (F.col("i") == 0))
    cut = F.concat(F.substring(F.col("block"), F.lit(1), F.greatest(F.lit(0), F.col("left") - 20).cast("int")), F.lit("\n…"))
    x = x.withColumn("block", F.when(F.length("block") > F.col("left"), cut).otherwise(F.col("block")))
    return x.groupBy("doc_id").agg(ordered_text(["i"], F.col("block"), "\n\n").alias("digest"))


def batches(observations: DataFrame, batch_size: int = 2, concurrency: int = 5) -> DataFrame:
    """``doc_id, batch, round, text``: observations in page order, some to a batch; batches of one round see the same events."""
    i = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_start", "page_end", "raw_text")) - 1
    x = observations.withColumn("i", i).withColumn("batch", F.floor(F.col("i") / batch_size).cast("int"))
    block = observation_block(F.col("page_start"), F.col("page_end"), F.coalesce("raw_text", F.lit("")))
    x = x.groupBy("doc_id", "batch").agg(ordered_text(["i"], block, "\n\n").alias("text"))
    return x.select("doc_id", "batch", F.floor(F.col("batch") / concurrency).cast("int").alias("round"), "text")
