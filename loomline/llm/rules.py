"""Quality rules with thresholds from the corpus itself.

Each language and source gets its own limits: the quartiles of every measure come from mergeable
quantile sketches, and a text is an outlier where it lies far beyond them. A sketch is a
histogram over fixed bins that are exact for small values and 1/32 wide (relatively) above; sketches
merge by adding counts, so they are built with map-side sums, and a group with few texts borrows the merged sketch of
its language or of the whole corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.llm.common import BASES, WordHashes, chunks, drop_stash, hashed_words, mixed, small_batches, stash

WINDOW = 5
#: Texts that a group needs for limits of its own.
MIN_GROUP = 100
#: A text is an outlier beyond the outer quartile by this many quartile distances plus the measure's slack.
REACH = 6
#: Measures (integers per text) and their slack; each also has an upper limit, and those in LOWER a lower one.
MEASURES = {"symbols": 60, "stutters": 150, "doubles": 120, "word_size": 150, "shouts": 250}
LOWER = ("word_size",)
_BASE = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _flags(chars: bytes) -> np.ndarray:
    table = np.zeros(256, np.int64)
    table[list(chars)] = 1
    return table


_SPACE, _SYMBOL, _INNER, _SHOUT = _flags(b" \t\n\x0b\x0c\r"), _flags(b"[#*$%&|<>]"[1:-1]), _flags(bytes(range(0x80, 0xC0))), _flags(b"!" + bytes(range(65, 91)))


def repeated_words(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each text the number of words inside WINDOW-word windows that it holds twice or more."""
    n = len(ends) - 1
    number = np.maximum(np.diff(ends) - WINDOW + 1, 0)
    doc = np.repeat(np.arange(n), number)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number) + ends[doc]
    value = mixed(doc.astype(np.uint64) * np.uint64(BASES[1]))
    for k in range(WINDOW):
        value = mixed(value * np.uint64(BASES[0]) + words[at + k])
    order = np.argsort(value)
    s = value[order]
    same = s[1:] == s[:-1]
    twice = np.zeros(len(s), bool)
    twice[1:] |= same
    twice[:-1] |= same
    hit = at[order[twice]]
    change = np.bincount(hit, minlength=len(words) + 1) - np.bincount(np.minimum(hit + WINDOW, len(words)), minlength=len(words) + 1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(change[:-1]) > 0)])
    return covered[ends[1:]] - covered[ends[:-1]]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    for batch, texts in chunks(batches, "text"):
        words, ends = hashed_words(texts, known)
        data = np.frombuffer(b"".join(texts), np.uint8)
        at = np.cumsum([0, *map(len, texts)])

        def count(table: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(table[data])])
            return total[at[1:]] - total[at[:-1]]

        doubles = []
        for text in texts:
            lines = [x for x in text.split(b"\n") if x and not x.isspace()]
            doubles.append(len(lines) - len(set(lines)))
        n_words = np.diff(ends)
        stutter = np.zeros(len(words) + 1, np.int64)
        if len(words):
            stutter[1:-1] = words[1:] == words[:-1]
            stutter[ends[:-1][n_words > 0]] = 0
        stutter = np.cumsum(np.append(0, stutter))
        values = [n_words, np.diff(at) - count(_INNER) - count(_SPACE), count(_SYMBOL), np.array(doubles, np.int64), repeated_words(words, ends), count(_SHOUT), stutter[ends[1:]] - stutter[ends[:-1]]]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *map(pa.array, values)], ["doc_id", "lang", "source", *_BASE[1:], "n_shouts", "n_stutters"])


def measures(docs: DataFrame) -> DataFrame:
    """The raw counts of every whole text, with ``lang`` and ``source``."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", "text")
    return base.mapInArrow(_measure, "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_shouts long, n_stutters long")


def sketch_bin(value: Column) -> Column:
    """The sketch's bin: the value below 64, then its six leading bits and their place."""
    shift = F.length(F.bin(value)) - 6
    return F.when(value < 64, value).otherwise(F.call_function("shiftright", value, shift.cast("int")) + 32 * shift).cast("int")


def bin_floor(at: Column) -> Column:
    """The least value of a bin."""
    shift = F.floor(at / 32) - 1
    return F.when(at < 64, at.cast("long")).otherwise(F.call_function("shiftleft", (at - 32 * shift).cast("long"), shift.cast("int"))).cast("long")


def _rates(x: DataFrame) -> DataFrame:
    n = F.greatest("n_words", F.lit(1))
    per = lambda a, scale: F.floor(F.col(a) * scale / n).cast("long")
    return x.withColumns({"symbols": per("n_symbols", 1000), "stutters": per("n_stutters", 1000), "doubles": per("n_dup_lines", 1000), "word_size": per("word_chars", 100), "shouts": F.floor(F.col("n_shouts") * 1000 / F.greatest("word_chars", F.lit(1))).cast("long")})


def sketches(rated: DataFrame) -> DataFrame:
    """``lang, source, measure, bin, n``: one sketch per language, source and measure."""
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), sketch_bin(F.col(m)).alias("bin")) for m in MEASURES)))
    return rated.select("lang", "source", pairs.alias("p")).groupBy("lang", "source", "p.measure", "p.bin").agg(F.count("*").alias("n"))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Merge sketches over all but ``keys`` and read ``total, q1, q2, q3``."""
    merged = sketch.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "measure")
    run = merged.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("total", F.sum("n").over(w))
    reads = [F.min(F.when(F.col("upto") * 4 >= F.col("total") * k, bin_floor(F.col("bin")))).alias(f"q{k}") for k in (1, 2, 3)]
    return run.groupBy(*keys, "measure").agg(F.max("total").alias("total"), *reads)


def limits(sketch: DataFrame) -> DataFrame:
    """``l_lang, l_source`` and a lower and an upper limit for each measure."""
    own, lang, all_ = quartiles(sketch, ["lang", "source"]), quartiles(sketch, ["lang"]), quartiles(sketch, [])
    lang = lang.select(F.col("lang").alias("b_lang"), F.col("measure").alias("b_measure"), *(F.col(c).alias(f"b_{c}") for c in ("total", "q1", "q3")))
    all_ = all_.select(F.col("measure").alias("c_measure"), *(F.col(c).alias(f"c_{c}") for c in ("q1", "q3")))
    x = own.join(lang, F.col("lang").eqNullSafe(F.col("b_lang")) & (F.col("measure") == F.col("b_measure"))).join(all_, F.col("measure") == F.col("c_measure"))
    pick = lambda q: F.when(F.col("total") >= MIN_GROUP, F.col(q)).when(F.col("b_total") >= MIN_GROUP, F.col(f"b_{q}")).otherwise(F.col(f"c_{q}"))
    x = x.withColumn("lo", pick("q1")).withColumn("hi", pick("q3"))
    slack = F.element_at(F.create_map(*(F.lit(v) for kv in MEASURES.items() for v in kv)), F.col("measure"))
    x = x.withColumn("reach", (F.col("hi") - F.col("lo")) * REACH + slack)
    out = [F.max(F.when(F.col("measure") == m, F.col("hi") + F.col("reach"))).alias(f"{m}_most") for m in MEASURES]
    out += [F.max(F.when(F.col("measure") == m, F.col("lo") - F.col("reach"))).alias(f"{m}_least") for m in LOWER]
    return x.groupBy(F.col("lang").alias("l_lang"), F.col("source").alias("l_source")).agg(*out)


def quality_rules(docs: DataFrame) -> DataFrame:
    """``doc_id``, the five counts, ``base_failed`` and ``kept`` for every row.

    ``docs`` needs ``doc_id, text, lang, source``; other columns are ignored. A null text has no words and fails the base rules.
    Null languages and sources form groups of their own. Texts that fail the base rules
    are not part of the sketches. Repeated rows count and are judged as often as they come. A text of any length is measured whole. An empty table gives an empty table.
    """
    small_batches(docs.sparkSession)
    x = measures(docs)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rated = stash(_rates(x).withColumn("base_failed", failed))
    held = stash(sketches(rated.where(~F.col("base_failed"))))
    bounds = stash(limits(held))
    drop_stash(held)
    joined = rated.join(bounds, F.col("lang").eqNullSafe(F.col("l_lang")) & F.col("source").eqNullSafe(F.col("l_source")), "left")
    fine = F.lit(True)
    for m in MEASURES:
        fine &= F.col(m) <= F.col(f"{m}_most")
    for m in LOWER:
        fine &= F.col(m) >= F.col(f"{m}_least")
    return joined.select(*_BASE, "base_failed", (~F.col("base_failed") & F.coalesce(fine, F.lit(False))).alias("kept"))
