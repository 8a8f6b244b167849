"""Substring deduplication by recompression.

Every text is parsed bottom-up in rounds. A round first names runs of equal
neighbouring symbols, then names pairs whose left symbol lies in one half of the
alphabet and whose right symbol lies in the other. A symbol's name is a function of the
names it is made of, so the naming is the same in every task without a shuffle
per round, and equal stretches of words get equal symbols except near their
ends. For each symbol the parse keeps the span of words that its existence
depends on (its context); where that context lies inside a window, each copy of
the window holds the same symbol at the same place.

Each window of ``width`` words picks one symbol whose context it contains: from
the highest level that has one, the one with the least scrambled name.
Neighbouring windows with the same choice make a segment. Segments whose symbol
occurs in one document only end there; the others are verified by the words of the whole segment,
and only where these differ by the words of each single window.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import BASES, SpanHasher, WordHashes, chunks, drop_stash, hashed_words, mixed, signed, small_batches, stash, text_key

ROUNDS = 4
#: Bytes of text that are parsed at once; the parse keeps some hundred bytes for each word.
PARSE_BYTES = 3 << 19


class Level:
    """Symbols in order of position: name, words [start, end), context [low, high)."""

    def __init__(self, name, start, end, low, high, doc):
        self.name, self.start, self.end, self.low, self.high, self.doc = name, start, end, low, high, doc


def first_level(words: np.ndarray, ends: np.ndarray) -> Level:
    at = np.arange(len(words))
    return Level(mixed(words), at, at + 1, at, at + 1, np.repeat(np.arange(len(ends) - 1), np.diff(ends)))


def next_level(x: Level, ends: np.ndarray, salt: int) -> Level:
    """One round: name runs, then pairs."""
    return _pairs(_runs(x, ends), ends, salt)


def _neighbours(x: Level, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The contexts' ends with the neighbours counted in. At a text's ends the context is larger than the text, so no window holds it."""
    n = len(x.name)
    low, high = np.empty(n, np.int64), np.empty(n, np.int64)
    low[1:], high[:-1] = x.low[:-1], x.high[1:]
    edge = np.ones(n, bool)
    edge[1:] = x.doc[1:] != x.doc[:-1]
    low[edge] = ends[x.doc[edge]] - 1
    edge = np.append(edge[1:], True)
    high[edge] = ends[x.doc[edge] + 1] + 1
    return low, high


def _runs(x: Level, ends: np.ndarray) -> Level:
    n = len(x.name)
    if not n:
        return x
    low, high = _neighbours(x, ends)
    head = np.ones(n, bool)
    head[1:] = (x.name[1:] != x.name[:-1]) | (x.doc[1:] != x.doc[:-1])
    first = np.flatnonzero(head)
    last = np.append(first[1:], n) - 1
    length = last - first + 1
    name = x.name[first]
    many = length > 1
    name[many] = mixed(name[many] * np.uint64(BASES[0]) + length[many].astype(np.uint64) * np.uint64(BASES[1]))
    return Level(name, x.start[first], x.end[last], low[first], high[last], x.doc[first])


def _pairs(x: Level, ends: np.ndarray, salt: int) -> Level:
    n = len(x.name)
    if not n:
        return x
    low, high = _neighbours(x, ends)
    left = (mixed(x.name + np.uint64(salt)) & np.uint64(1)).astype(bool)
    joins = np.zeros(n, bool)  # this symbol and the next become one
    joins[:-1] = left[:-1] & ~left[1:] & (x.doc[:-1] == x.doc[1:])
    second = np.append(False, joins[:-1])
    low, high = np.where(left, x.low, low), np.where(left, high, x.high)
    keep = np.flatnonzero(~second)
    paired = joins[keep]
    other = np.minimum(keep + 1, n - 1)
    name = np.where(paired, mixed(x.name[keep] * np.uint64(BASES[1]) + mixed(x.name[other] + np.uint64(BASES[2]))), x.name[keep])
    end = np.where(paired, x.end[other], x.end[keep])
    low = np.where(paired, x.low[keep], low[keep])
    high = np.where(paired, x.high[other], high[keep])
    return Level(name, x.start[keep], end, low, high, x.doc[keep])


def choose(levels: list[Level], ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window: its first word, the level and the index of the symbol that it picks."""
    total = int(ends[-1])
    inside = np.zeros(total + 1, np.int64)
    counts = np.diff(ends)
    long = counts >= width
    np.add.at(inside, ends[:-1][long], 1)
    np.add.at(inside, ends[1:][long] - width + 1, -1)
    windows = np.flatnonzero(np.cumsum(inside[:-1]))
    level, symbol = np.full(len(windows), -1, np.int64), np.zeros(len(windows), np.int64)
    open_ = np.arange(len(windows))
    for k in range(len(levels) - 1, -1, -1):
        x = levels[k]
        if not len(open_) or not len(x.name):
            continue
        below = np.cumsum(np.bincount(x.low + 1, minlength=total + 2))  # symbols whose context begins before a word
        until = np.cumsum(np.bincount(np.minimum(x.high, total + 1), minlength=total + 2))
        w = windows[open_]
        a, b = below[w], until[w + width]
        has = b > a
        a, b, at = a[has], b[has], open_[has]
        if len(at):
            symbol[at] = _least(mixed(x.name ^ np.uint64(BASES[2])), a, b)
            level[at] = k
        open_ = open_[~has]
    return windows, level, symbol


def _least(key: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The index of the least key in each range [a, b), the leftmost of equal ones."""
    out = np.empty(len(a), np.int64)
    power = np.frexp((b - a).astype(np.float64))[1] - 1
    table = np.arange(len(key))
    for k in range(int(power.max()) + 1):
        at = np.flatnonzero(power == k)
        i, j = table[a[at]], table[b[at] - (1 << k)]
        out[at] = np.where(key[i] <= key[j], i, j)
        step = 1 << k
        if step < len(table):
            i, j = table[: len(table) - step], table[step:]
            table = np.where(key[i] <= key[j], i, j)
    return out


def _segments(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    for batch, texts in chunks(batches, "text", PARSE_BYTES):
        words, ends = hashed_words(texts, known)
        levels = [first_level(words, ends)]
        for k in range(ROUNDS):
            levels.append(next_level(levels[-1], ends, 0x5851F42D4C957F2D * (k + 1) & (2**64 - 1)))
        windows, level, symbol = choose(levels, ends, width)
        if not len(windows):
            continue
        cut = np.ones(len(windows), bool)
        cut[1:] = (windows[1:] != windows[:-1] + 1) | (level[1:] != level[:-1]) | (symbol[1:] != symbol[:-1])
        doc_of = np.repeat(np.arange(len(texts)), np.diff(ends))
        cut[1:] |= doc_of[windows[1:]] != doc_of[windows[:-1]]
        head = np.flatnonzero(cut)
        first, last = windows[head], windows[np.append(head[1:], len(windows)) - 1]
        low, high, start = (np.empty(len(head), np.int64) for _ in range(3))
        for k, x in enumerate(levels):
            at = np.flatnonzero(level[head] == k)
            s = symbol[head[at]]
            low[at], high[at], start[at] = x.low[s], x.high[s], x.start[s]
        # the symbol with its context, and the words of all windows of the segment
        hook = mixed(SpanHasher(words, BASES[0])(low, high) + (start - low).astype(np.uint64) * np.uint64(BASES[1]) + level[head].astype(np.uint64) + (high - low).astype(np.uint64) * np.uint64(BASES[2]))
        whole = mixed(SpanHasher(words, BASES[1])(first, last + width) + (first - low).astype(np.uint64) * np.uint64(BASES[0]) + (last - first).astype(np.uint64))
        doc = doc_of[first]
        rows = pa.array(doc)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(rows), batch.column(1).take(rows), signed(hook), signed(whole), pa.array((first - ends[doc]).astype(np.int32)), pa.array((last - ends[doc]).astype(np.int32))],
            ["id", "tkey", "hook", "whole", "first", "last"],
        )


def _windows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The words' hash of every window of the listed segments."""
    known = WordHashes()
    for batch, texts in chunks(batches, "text", PARSE_BYTES):
        words, ends = hashed_words(texts, known)
        spans = batch.column(3)
        lists = np.repeat(np.arange(len(texts)), np.diff(spans.offsets.to_numpy()))
        fields = spans.flatten()
        hook, first, last = (fields.field(i).to_numpy() for i in range(3))
        count = last - first + 1
        seg = np.repeat(np.arange(len(count)), count)
        at = first[seg].astype(np.int64) + np.arange(len(seg)) - np.repeat(np.cumsum(count) - count, count)
        doc = lists[seg]
        begin = at + ends[doc]
        rows = pa.array(doc)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(hook[seg]), signed(SpanHasher(words, BASES[2])(begin, begin + width)), pa.array(at.astype(np.int32))], ["id", "tkey", "hook", "words", "first"]
        )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in chunks(batches, "text"):
        n_words, n_removed, kept = [], [], []
        for text, spans in zip(texts, batch.column(2).to_pylist()):
            words = text.split()
            n_words.append(len(words))
            if spans:
                change = np.zeros(len(words) + 1, np.int64)
                for s in spans:
                    change[s["s"]] += 1
                    change[min(s["e"], len(words))] -= 1
                left = np.cumsum(change[:-1]) == 0
                words = [w for w, k in zip(words, left.tolist()) if k]
            n_removed.append(n_words[-1] - len(words))
            kept.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])


def substring_dedup(docs: DataFrame, width: int = 50) -> DataFrame:
    """Remove each word that lies in a window of ``width`` words which also starts in a document with a smaller id.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored, whatever
    their names. Returns ``doc_id, n_words, n_removed, kept_text``, one row per
    input row. A null or blank text has no words and keeps an empty text. A
    text with fewer than ``width`` words stays whole. Rows with a null id stay
    whole and are nobody's source. Rows with the same id are one document:
    neither is a source for the other. An empty table gives an empty table.
    """
    small_batches(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("id"), text_key(F.col("text")).alias("tkey"), "text")
    found = base.where("id is not null").mapInArrow(partial(_segments, width=width), "id long, tkey long, hook long, whole long, first int, last int")
    found = stash(found)
    # symbols of more than one document
    common = stash(found.groupBy("hook").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("hook", "least"))
    shared = stash(found.join(common, "hook"))
    # one row per content of a segment, from the document with the smallest id
    forms = shared.groupBy("hook", "whole").agg(F.min(F.struct("id", "tkey", "first", "last")).alias("r"), F.first("least").alias("least"))
    forms = stash(forms.select("hook", "whole", F.col("r.id").alias("src"), F.col("r.tkey").alias("tkey"), F.col("r.first").alias("first"), F.col("r.last").alias("last"), "least"))
    by_segment = shared.join(forms.select("hook", "whole", "src"), ["hook", "whole"]).where("src < id").select("id", "tkey", F.col("first").alias("s"), (F.col("last") + width).alias("e"))
    # contents that differ around the same symbol: verify window by window
    open_ = stash(forms.groupBy("hook").agg(F.min("src").alias("low"), F.max("src").alias("top")).where("low < top").select("hook"))
    wanted = forms.join(open_, "hook").groupBy(F.col("src").alias("id"), "tkey").agg(F.collect_list(F.struct("hook", "first", "last")).alias("spans"))
    single = stash(base.join(wanted, ["id", "tkey"]).select("id", "tkey", "text", "spans").mapInArrow(partial(_windows, width=width), "id long, tkey long, hook long, words long, first int"))
    origin = stash(single.groupBy("hook", "words").agg(F.min("id").alias("src"), F.max("id").alias("most")).where("src < most").drop("most"))
    for x in (found, common, open_):
        drop_stash(x)
    by_window = single.join(origin, ["hook", "words"]).where("src < id").select("id", "tkey", F.col("first").alias("s"), (F.col("first") + width).alias("e"))
    spans = by_segment.unionByName(by_window).groupBy("id", "tkey").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    return base.join(spans, ["id", "tkey"], "left").select("id", "text", "spans").mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept_text string")
