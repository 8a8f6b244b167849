"""Line deduplication over levelled sorted runs of line hashes.

A store keeps runs of (hash, documents, holder), each a table that is bucketed by hash and sorted in its buckets, so that joins with
it neither shuffle nor sort it. Each batch of documents is merge-anti-joined with the runs: hashes that no run holds are new, and the
batch's own run says who holds them. The rest is known and only adds to the count. When a level has ``fan`` runs they are merged into one
run of the next level, so a store has few runs however many batches came. Batches come with the largest ids first, so
a line's first holder is the one that keeps it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.common import SPACES, chunks, drop_stash, small_batches, stash, stash_bucketed

MIN_CHARS = 20
MIN_DOCS = 3
#: Documents of one batch, and the batches that one table is fed in at most: each batch reads what the earlier ones held.
BATCH_DOCS, MOST_BATCHES = 100_000, 8
#: Runs of a level that are merged.
FAN = 3
HASH = ["h1", "h2"]
_SPACES = SPACES.encode()


def line_hash(line: bytes, min_chars: int) -> tuple[int, int] | None:
    """128 bits for a line's key: without white space at both ends, A-Z lower-cased. None for a key of less than ``min_chars`` code points."""
    key = line.strip(_SPACES).lower()
    if len(key) < min_chars or not key.isascii() and len(key.decode()) < min_chars:
        return None
    h = xxhash.xxh3_128_intdigest(key)
    return (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)


def _hashes(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    for batch, texts in chunks(batches, "text"):
        ids, first, second = [], [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), texts):
            found = {line_hash(line, min_chars) for line in set(text.split(b"\n"))} - {None}
            ids += [doc_id] * len(found)
            first += [h[0] for h in found]
            second += [h[1] for h in found]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, first, second)], ["doc_id", *HASH])


def _cut(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    for batch, texts in chunks(batches, "text"):
        n_lines, n_dropped, kept = [], [], []
        for text, lost in zip(texts, batch.column(2).to_pylist()):
            lines = text.split(b"\n")
            n_lines.append(len(lines))
            if lost:
                gone = {(x["h1"], x["h2"]) for x in lost}
                lines = [x for x in lines if line_hash(x, min_chars) not in gone]
                text = b"\n".join(lines)
            n_dropped.append(n_lines[-1] - len(lines))
            kept.append(text)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_text"])


class RunStore:
    """Levels of sorted runs ``h1, h2, n_docs, holder``. No hash is in two runs; what later batches add to its count waits in ``again``."""

    SCHEMA = "h1 long, h2 long, n_docs long, holder long"

    def __init__(self, spark: SparkSession, fan: int = FAN):
        self.spark, self.fan, self.levels, self.again = spark, fan, [], []

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def add(self, batch: DataFrame) -> DataFrame:
        """Take a batch of ``(h1, h2, doc_id)``, one row per line key and document; returns its hashes that are new to the store."""
        own = _sorted(batch.groupBy(*HASH).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("holder")))
        new = own
        for r in self.runs():
            new = new.hint("merge").join(r.select(*HASH), HASH, "left_anti")
        if new is not own:
            new = _sorted(new)
            self.again.append(_sorted(own.hint("merge").join(new.select(*HASH), HASH, "left_anti").select(*HASH, "n_docs")))
            drop_stash(own)
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(new)
        return new

    def compact(self, full: bool = False) -> None:
        """Merge levels that are full; with ``full``, everything into one run that has all counts."""
        if full:
            self.levels = [self.runs()] if self.levels else []
        k = 0
        while k < len(self.levels):
            old = self.levels[k]
            if len(old) > 1 and (full or len(old) >= self.fan):
                self.levels[k] = []
                to = k if full else k + 1
                if to == len(self.levels):
                    self.levels.append([])
                self.levels[to].append(_sorted(_union(old)))
                for r in old:
                    drop_stash(r)
            k += 1
        if full and self.again:
            more = _union(self.again).groupBy(*HASH).agg(F.sum("n_docs").alias("more"))
            run = self.levels[0][0]
            self.levels = [[_sorted(run.hint("merge").join(more, HASH, "left").select(*HASH, (F.col("n_docs") + F.coalesce("more", F.lit(0))).alias("n_docs"), "holder"))]]
            for r in (run, *self.again):
                drop_stash(r)
            self.again = []

    def table(self) -> DataFrame:
        self.compact(full=True)
        runs = self.runs()
        return runs[0] if runs else self.spark.createDataFrame([], self.SCHEMA)


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for x in tables[1:]:
        out = out.unionByName(x)
    # a merged run is laid as one again
    return out.repartition(int(out.sparkSession.conf.get("spark.sql.shuffle.partitions")), *HASH) if len(tables) > 1 else out


def _sorted(run: DataFrame) -> DataFrame:
    return stash_bucketed(run, *HASH, ordered=True)


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Drop repeated lines: keys of ``min_chars`` code points or more in ``min_docs`` documents or more stay only in the largest ``doc_id``.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. A text is split at line feeds; null or empty is one empty
    line. A key is the line without ASCII white space at both ends, A-Z lower-cased. Returns
    ``doc_id, n_lines, n_dropped, kept_text`` for every row. Rows with the same id are one document;
    rows with a null id count as no document and lose no line. A text of any length is split whole, in time in proportion to its lines. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keys = base.where("doc_id is not null").mapInArrow(partial(_hashes, min_chars=min_chars), "doc_id long, h1 long, h2 long").distinct()
    # cuts of the ids into batches of about equal size, the largest ids first
    n_batches = min(MOST_BATCHES, max(2, -(-base.count() // BATCH_DOCS)))
    cuts = base.agg(F.percentile_approx("doc_id", [k / n_batches for k in range(1, n_batches)], 1000)).first()[0] or []
    batch = sum((F.when(F.col("doc_id") < c, 1).otherwise(0) for c in sorted(set(cuts))), F.lit(0))
    fed = stash(keys.withColumn("batch", batch.cast("int")), partition_by="batch")
    store = RunStore(spark)
    for b in range(n_batches):
        store.add(fed.where(F.col("batch") == b).select(*HASH, "doc_id"))
        store.compact()
    runs = store.table()
    common = stash(runs.where(F.col("n_docs") >= min_docs).select(*HASH, "holder"))
    for x in store.runs():
        drop_stash(x)
    losing = fed.join(common, HASH).where("doc_id <> holder").groupBy("doc_id").agg(F.collect_list(F.struct(*HASH)).alias("gone"))
    return base.join(losing, "doc_id", "left").select("doc_id", "text", "gone").mapInArrow(partial(_cut, min_chars=min_chars), "doc_id long, n_lines long, n_dropped long, kept_text string")
