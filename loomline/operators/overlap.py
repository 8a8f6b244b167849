"""Pairs of token sets that share enough tokens, counted block by block in Python tasks.

A document's sets are dealt into blocks, each pair of blocks is a cell, and a cell's task counts the common tokens of all its
pairs by an inverted index in memory. Only the sets travel, once for each block that they meet; pairs leave a task as results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.session import importable

#: Characters of the texts of both sides that a block has about.
BLOCK_CHARS = 128 << 20
#: Bytes of effects that are looked up at once, and pairs that a task holds.
CHUNK_BYTES, HELD = 16 << 20, 200_000
#: Common tokens that a pair must have besides its smaller set's most frequent ones before its whole sets are compared.
SURE = 4


def needed(sizes: np.ndarray, shared: float) -> np.ndarray:
    """For each size of the smaller set the least number of common tokens, 1 at least, that makes up the share."""
    n = np.maximum(sizes, 1).astype(np.float64)
    c = np.ceil(n * shared)
    c = np.where((c - 1) / n >= shared, c - 1, c)
    return np.maximum(np.where(c / n >= shared, c, c + 1), 1).astype(np.int64)


def _lists(texts: list[pa.Array]) -> tuple[pa.Array, np.ndarray]:
    """The tokens of all texts in one array, and each text's number of them."""
    split = pc.split_pattern(pa.concat_arrays(texts).cast(pa.large_string()), " ")
    return split.flatten(), pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places from each start on, in one array."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class _Index:
    """The rows in which a token stands."""

    def __init__(self, codes: np.ndarray, rows: np.ndarray, n_tokens: int, n: int):
        self.rows = np.sort(codes * n + rows) % n
        self.sizes = np.bincount(codes, minlength=n_tokens)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def of(self, codes: np.ndarray) -> np.ndarray:
        return self.rows[spans(self.starts[codes], self.sizes[codes])]


class _Cell:
    """One block of causes with its index, met by effects.

    If two sets need t common tokens, and the q most frequent tokens of one are left out, at least t - q of the rest are common. So the smaller set of a pair
    is looked at without as many of its most frequent tokens as leave SURE common ones, which passes by nearly all of the index; the pairs found are then counted by their whole sets.
    """

    def __init__(self, doc: str, causes: list[pa.RecordBatch], shared: float):
        values, sizes = _lists([b.column("t") for b in causes])
        coded = values.dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        rarest = np.argsort(np.bincount(codes, minlength=len(coded.dictionary)), kind="stable")
        number = np.empty(len(rarest), np.int64)
        number[rarest] = np.arange(len(rarest))
        self.doc, self.shared, self.tokens, v = doc, shared, coded.dictionary.take(pa.array(rarest)), len(rarest)
        large = np.argsort(-sizes, kind="stable")  # the largest sets first
        self.rows = pa.Table.from_batches(causes).drop_columns("t").take(pa.array(large)).combine_chunks()
        self.sizes, self.n, self.need = sizes[large], len(sizes), needed(sizes[large], shared)
        self.ends = np.cumsum(self.sizes)
        place = np.empty(self.n, np.int64)
        place[large] = np.arange(self.n)
        keys = np.sort(np.repeat(place, sizes) * v + number[codes])  # by set, its rarest tokens first
        del coded, values, codes, number
        of, self.codes = np.repeat(np.arange(self.n), self.sizes), keys % v
        rare = np.arange(len(of)) - (self.ends - self.sizes)[of] < (self.sizes - np.maximum(self.need - SURE, 0))[of]
        self.whole, self.part = _Index(self.codes, of, v, self.n), _Index(self.codes[rare], of[rare], v, self.n)
        self.sure, self.mark = np.minimum(self.need, SURE), np.zeros(v, np.int32)

    def meet(self, effects: list[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
        """The effects with the numbers of rows of effects and of causes that make pairs."""
        rows = pa.Table.from_batches(effects).drop_columns("t").combine_chunks()
        values, sizes = _lists([b.column("t") for b in effects])
        codes = pc.fill_null(pc.index_in(values, value_set=self.tokens), -1).to_numpy().astype(np.int64)
        v = len(self.tokens) + 1
        codes = np.sort(np.repeat(np.arange(len(sizes)), sizes) * v + codes + 1) % v - 1  # each set's rarest tokens first
        need, ends = needed(sizes, self.shared), np.cumsum(sizes)
        kept = ends - np.maximum(need - SURE, 0)
        smaller = np.searchsorted(-self.sizes, -sizes, side="right")  # causes before are at least as large as the effect
        src, dst, held = [], [], 0
        for k, (a, b, c, p) in enumerate(zip((ends - sizes).tolist(), ends.tolist(), kept.tolist(), smaller.tolist(), strict=True)):
            own = codes[a:b]
            first, rest = self.whole.of(own[: c - a][own[: c - a] >= 0]), self.part.of(own := own[own >= 0])
            hits = np.sort(np.concatenate([first[first < p], rest[rest >= p]]))
            if not len(hits):
                continue
            cuts = np.concatenate([[-1], np.flatnonzero(hits[1:] != hits[:-1]), [len(hits) - 1]])
            met, times = hits[cuts[1:]], np.diff(cuts)
            near = met[times >= np.where(met < p, min(need[k], SURE), self.sure[met])]
            if len(near):
                self.mark[own] = 1
                n = self.sizes[near]
                common = np.add.reduceat(self.mark[self.codes[spans(self.ends[near] - n, n)]], np.cumsum(n) - n)
                self.mark[own] = 0
                found = near[common >= np.minimum(self.need[near], need[k])]
                src.append(np.full(len(found), k))
                dst.append(found)
                held += len(found)
            if held >= HELD:
                yield rows, np.concatenate(src), np.concatenate(dst)
                src, dst, held = [], [], 0
        if held:
            yield rows, np.concatenate(src), np.concatenate(dst)


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of one cell and side each."""
    if batch.num_rows:
        keys = [pc.dictionary_encode(batch.column("doc_id")).indices.to_numpy(), *(batch.column(c).to_numpy() for c in ("i", "j", "side"))]
        cuts = [0, *(np.flatnonzero(np.any([x[1:] != x[:-1] for x in keys], axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def _cells(batches: Iterator[pa.RecordBatch], shared: float) -> Iterator[tuple[_Cell, pa.Table, np.ndarray, np.ndarray]]:
    """Pairs of each cell; rows come by cell, the causes first."""
    key, causes, cell, effects, size = None, [], None, [], 0

    def flush():
        nonlocal cell, effects, size
        if causes and effects:
            cell = cell or _Cell(key[0], causes, shared)
            for found in cell.meet(effects):
                yield cell, *found
        effects, size = [], 0

    for run in (r for b in batches for r in _runs(b)):
        now = tuple(run.column(c)[0].as_py() for c in ("doc_id", "i", "j"))
        if now != key:
            yield from flush()
            key, causes, cell = now, [], None
        if run.column("side")[0].as_py() == 0:
            causes.append(run)
        elif causes:
            effects.append(run)
            size += run.column("t").nbytes
            if size >= CHUNK_BYTES:
                yield from flush()
    yield from flush()


def _pairs(batches: Iterator[pa.RecordBatch], shared: float, ranked: bool) -> Iterator[pa.RecordBatch]:
    for cell, rows, s, d in _cells(batches, shared):
        src, dst = rows.column("id").take(pa.array(s)), cell.rows.column("id").take(pa.array(d))
        out = {"doc_id": pa.array([cell.doc]).take(pa.array(np.zeros(len(s), np.int32))), "src": src, "dst": dst}
        if ranked:
            out |= {"src_rank": rows.column("rank").take(pa.array(s)), "dst_rank": cell.rows.column("rank").take(pa.array(d))}
        yield from pa.table(out).filter(pc.not_equal(src, dst)).to_batches()


def _links(batches: Iterator[pa.RecordBatch], shared: float) -> Iterator[pa.RecordBatch]:
    for cell, rows, s, d in _cells(batches, shared):
        a, b = rows.column("rank").to_numpy()[s], cell.rows.column("rank").to_numpy()[d]
        a, b = a[a < b], b[a < b].astype("<i4")  # rows of one effect stand together
        if len(a):
            cuts = np.concatenate([[0], np.flatnonzero(a[1:] != a[:-1]) + 1, [len(a)]])
            to = [b[x:y].tobytes() for x, y in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)]
            yield pa.record_batch({"doc_id": pa.array([cell.doc] * len(to), pa.string()), "src_rank": pa.array(a[cuts[:-1]], pa.int32()), "to": pa.array(to, pa.binary())})


def _dealt(sets: DataFrame, chars: DataFrame) -> DataFrame:
    """Rows ``doc_id, i, j, side, id, t`` and ``rank`` if given, sorted by cell: side 0 a cause, which the index takes, side 1 an effect."""
    large = chars.where(F.col("chars") > BLOCK_CHARS).select("doc_id", F.ceil(F.col("chars") / BLOCK_CHARS).cast("int").alias("blocks"))
    x = sets.join(F.broadcast(large), "doc_id", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))  # at most a row for every BLOCK_CHARS of all texts
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    all_ = F.sequence(F.lit(0), F.col("blocks") - 1)
    cell = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    x = x.withColumn("own", own)
    cells = F.concat(F.transform(all_, lambda k: cell(k, F.col("own"), 0)), F.transform(all_, lambda k: cell(F.col("own"), k, 1)))
    ranks = ["rank"] if "rank" in sets.columns else []
    sent = x.select("doc_id", "id", *ranks, "cause", "effect", F.explode(cells).alias("c"))
    sent = sent.select("doc_id", "c.i", "c.j", "c.side", "id", *ranks, F.when(F.col("c.side") == 0, F.col("cause")).otherwise(F.col("effect")).alias("t")).where("t <> ''")
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    importable(sets.sparkSession)
    return sent.repartition(parts, "doc_id", "i", "j").sortWithinPartitions("doc_id", "i", "j", "side")


def pairs(sets: DataFrame, chars: DataFrame, shared: float) -> DataFrame:
    """``doc_id, src, dst`` of ``sets(doc_id, id, effect, cause)``, each side distinct tokens joined by spaces; with ``rank``, also ``src_rank, dst_rank``.

    ``chars(doc_id, chars)`` says how much text a document has.
    """
    ranked = "rank" in sets.columns
    return _dealt(sets, chars).mapInArrow(partial(_pairs, shared=shared, ranked=ranked), "doc_id string, src string, dst string" + (", src_rank int, dst_rank int" if ranked else ""))


def links(sets: DataFrame, chars: DataFrame, shared: float) -> DataFrame:
    """The pairs that lead to a higher rank, packed: ``doc_id, src_rank, to``, the ranks as four bytes each; an event may have several rows."""
    return _dealt(sets, chars).mapInArrow(partial(_links, shared=shared), "doc_id string, src_rank int, to binary")
