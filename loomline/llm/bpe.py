"""Byte-level BPE encoding and decoding over the corpus' distinct words.

One pass cuts the texts into pre-tokens and notes, block by block, the distinct ones with a
block-local number and every text's sequence of numbers (the positions). The words of all blocks
meet in one shuffle by word: there each distinct word of the corpus is encoded once, and its ids are joined back to the
blocks that hold it. Each block then reassembles its texts by position. Positions
never cross the network: they wait in a table that is bucketed by block. A word crosses once per block, not once per
occurrence, which also keeps frequent words from making a hot partition.

Words are the same when their bytes are. Up to 15 bytes make an exact key of 128 bits; longer words are
compared as bytes.

Decoding joins ids with the table of token bytes. That table is bounded by the
vocabulary, so every task holds it and the join is a lookup.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import BASES, chunks, mixed, release, small_batches, stash_bucketed

#: Bytes of text in one block.
BLOCK_BYTES = 4 << 20
#: Tokens that are decoded at a time.
TOKENS = 1 << 16
#: Bytes of a word that its key holds; longer words are numbered.
KEY_BYTES = 15


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: lines of base64 token bytes and their rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


#: The pre-token pattern that has a vectorised form here; texts are cut by any other with the regex library.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPACE, _LETTER, _NUMBER, _OTHER, _FREE = range(5)
# The characters with the White_Space property.
_WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@cache
def classes() -> np.ndarray:
    """The pattern's class of every code point. Those without a category in this interpreter's Unicode tables are _FREE: on newer
    ones pattern engines may disagree, so texts with such a character are not cut here but encoded whole by the library."""
    kinds = {"L": _LETTER, "N": _NUMBER}
    out = np.fromiter((_FREE if (k := unicodedata.category(chr(c))) == "Cn" else kinds.get(k[0], _OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[_WHITE] = _SPACE
    return out


def cut(codes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Which code points begin a pre-token of PATTERN; ``begins`` has the first code point of each text, and the total."""
    n = len(codes)
    kind = classes()[codes]
    new = np.zeros(n + 1, bool)
    new[begins] = True
    starts = new[:n].copy()
    starts[1:] |= kind[1:] != kind[:-1]
    last = np.zeros(n, bool)  # white space before something else in the same text
    last[:-1] = (kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & ~new[1:n]
    starts |= last
    joins = np.flatnonzero(last & (codes == 0x20)) + 1  # a space belongs to what follows
    starts[joins] = False
    # apostrophes that begin a pre-token before letters: the listed endings are pre-tokens of their own
    at = np.flatnonzero((codes[:-1] == 0x27) & starts[:-1] & (kind[1:] == _LETTER) & ~new[1:n]) if n > 1 else np.zeros(0, np.int64)
    if len(at):
        first = codes[at + 1]
        there = (at + 2 < n) & ~new[np.minimum(at + 2, n)]
        second = np.where(there, codes[np.minimum(at + 2, n - 1)], 0)
        one = np.isin(first, [ord(c) for c in "stmd"])
        two = ((first == ord("r")) | (first == ord("v"))) & (second == ord("e")) | (first == ord("l")) & (second == ord("l"))
        starts[at[one | two] + 1] = False
        rest = np.concatenate([at[one] + 2, at[two] + 3])
        rest = rest[rest < n]
        starts[rest] = True
    free = np.flatnonzero(kind == _FREE)
    if len(free):
        for t in np.unique(np.searchsorted(begins, free, "right") - 1):
            starts[begins[t] : begins[t + 1]] = False
            starts[begins[t]] = True
    return starts


def exact_keys(data: np.ndarray, start: np.ndarray, size: np.ndarray, long_words: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit halves of a key for each word of ``data``; words have the same key if and only if they have the same bytes.

    The key of a short word is its bytes and its length, that of a longer one its number in ``long_words``.
    """
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", padded.data, strides=(1,))  # the eight bytes from each place on
    mask = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    low = eight[start] & mask[np.minimum(size, 8)]
    high = eight[np.minimum(start + 8, len(eight) - 1)] & mask[np.clip(size - 8, 0, KEY_BYTES - 8)]
    high |= np.minimum(size, 255).astype(np.uint64) << np.uint64(56)
    for i in np.flatnonzero(size > KEY_BYTES).tolist():
        word = data[start[i] : start[i] + size[i]].tobytes()
        low[i], high[i] = long_words.setdefault(word, len(long_words)), 255 << 56
    return low, high


def group_keys(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of equal pairs: the first place, every pair's group, and the groups' sizes."""
    _, first, group, count = np.unique(mixed(low ^ mixed(high + np.uint64(BASES[0]))), return_index=True, return_inverse=True, return_counts=True)
    if (low != low[first][group]).any() or (high != high[first][group]).any():  # two pairs share a hash: sort the pairs themselves
        order = np.lexsort((low, high))
        new = np.ones(len(order), bool)
        new[1:] = (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        first, count = order[new], np.bincount(group)
    return first, group, count


class Block:
    """The pre-tokens of some texts: their keys in order, and where to find each one's bytes."""

    def __init__(self, pattern: str):
        self.pattern = pattern
        self.parts: list[tuple] = []
        self.long_words: dict[bytes, int] = {}
        self.size = 0

    def add(self, ids: pa.Array, texts: list[bytes]) -> None:
        whole = [t.decode() for t in texts]
        begins = np.cumsum([0, *map(len, whole)])
        codes = np.frombuffer("".join(whole).encode("utf-32-le", "surrogatepass"), np.uint32)
        if self.pattern == PATTERN:
            start = np.flatnonzero(cut(codes, begins))
        else:
            import regex

            find = regex.compile(self.pattern).finditer
            free = classes()[codes] == _FREE
            spans = [[0] if free[a:b].any() else [m.start() for m in find(t)] for t, a, b in zip(whole, begins, begins[1:])]
            start = np.concatenate([np.array(x, np.int64) + a for x, a in zip(spans, begins)] or [np.zeros(0, np.int64)]).astype(np.int64)
        counts = np.diff(np.searchsorted(start, begins))
        data = b"".join(texts)
        if len(data) != len(codes):  # from code points to bytes
            width = 1 + (codes >= 0x80).astype(np.int8) + (codes >= 0x800) + (codes >= 0x10000)
            start = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])[start]
        size = np.diff(np.append(start, len(data)))[: len(start)]
        keys = exact_keys(np.frombuffer(data, np.uint8), start, size, self.long_words)
        self.parts.append((ids, counts, data, start.astype(np.int32), size.astype(np.int32), *keys))
        self.size += len(data)

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """Each pre-token's number, frequent ones first, and for each number one place where it stands."""
        first, group, count = group_keys(*(np.concatenate([p[i] for p in self.parts]) for i in (5, 6)))
        order = np.lexsort((first, -count))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return rank[group], first[order]

    def words(self, places: np.ndarray) -> list[bytes]:
        edges = np.cumsum([0, *(len(p[3]) for p in self.parts)])
        part = np.searchsorted(edges, places, "right") - 1
        out: list[bytes] = []
        for p, i in zip(part.tolist(), (places - edges[part]).tolist()):
            _, _, data, start, size, *_ = self.parts[p]
            out.append(data[start[i] : start[i] + size[i]])
        return out


def _blocks(batches: Iterator[pa.RecordBatch], pattern: str, most: int) -> Iterator[tuple[int, Block]]:
    name = TaskContext.get().partitionId() << 32
    block = Block(pattern)
    for batch, texts in chunks(batches, "text", 1 << 19):
        if block.size and block.size + sum(map(len, texts)) > most:
            yield name, block
            name, block = name + 1, Block(pattern)
        block.add(batch.column(0), texts)
    if block.parts:
        yield name, block


def _packed(values: np.ndarray) -> bytes:
    """Small numbers as planes of bytes, compressed."""
    planes = values.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


#: Rows of cut texts. Without a bucket: some texts' ids, their numbers of pre-tokens (pieces), and the pre-tokens' numbers in order (the positions);
#: and one row without ids for the block, which has for each bucket how many of the block's words are in it, and their numbers, each as the step from the one before.
#: With a bucket: the block's words of that bucket, and their lengths.
CUT = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("ids", pa.list_(pa.int64())), ("pieces", pa.binary()), ("stream", pa.binary()), ("sizes", pa.binary()), ("words", pa.binary())])
CUT_DDL = "block long, bucket int, ids array<long>, pieces binary, stream binary, sizes binary, words binary"


def _cut_blocks(batches: Iterator[pa.RecordBatch], pattern: str, buckets: int, most: int) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3).compress
    for name, block in _blocks(batches, pattern, most):
        number, places = block.distinct()
        words = block.words(places)
        at = 0
        for ids, counts, *_ in block.parts:
            total = int(counts.sum())
            yield pa.RecordBatch.from_pylist([{"block": name, "ids": ids.to_pylist(), "pieces": _packed(counts), "stream": _packed(number[at : at + total])}], CUT)
            at += total
        block.parts.clear()
        bucket = np.fromiter((xxhash.xxh64_intdigest(w) % buckets for w in words), np.int64, len(words))
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        steps = np.diff(order, prepend=0)
        first = edges[:-1][edges[:-1] < edges[1:]]
        steps[first] = order[first]
        rows = [{"block": name, "pieces": _packed(np.diff(edges)), "stream": _packed(steps)}]
        for b in range(buckets):
            own = order[edges[b] : edges[b + 1]]
            if len(own):
                held = [words[i] for i in own.tolist()]
                rows.append({"block": name, "bucket": b, "sizes": _packed(np.fromiter(map(len, held), np.int64, len(held))), "words": pack(b"".join(held))})
        yield pa.RecordBatch.from_pylist(rows, CUT)
    release()


def _encode_words(batches: Iterator[pa.RecordBatch], ranks: dict[bytes, int], pattern: str) -> Iterator[pa.RecordBatch]:
    """Ids of the words. Rows come by bucket, so all holders of a word follow each other: it is encoded once."""
    import tiktoken

    encode = tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    unpack = zstandard.ZstdDecompressor().decompress
    known: dict[bytes, list[int]] = {}
    bucket = None
    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] != bucket:
                bucket = row["bucket"]
                known.clear()
            data = unpack(row["words"])
            flat, counts, at = [], [], 0
            for end in np.cumsum(_unpacked(row["sizes"])).tolist():
                word = data[at:end]
                at = end
                ids = known.get(word)
                if ids is None:
                    ids = known[word] = encode(word.decode())
                flat += ids
                counts.append(len(ids))
            out = [pa.array([row["block"]], pa.int64()), pa.array([bucket], pa.int32()), pa.array([_packed(np.array(counts))], pa.binary()), pa.array([_packed(np.array(flat, np.int64))], pa.binary())]
            yield pa.RecordBatch.from_arrays(out, ["block", "bucket", "counts", "ids"])
    release()


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indices starts[i], starts[i] + 1, ... (counts[i] of them) for every i in order."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


def _assemble(docs: pa.Table, words: pa.Table) -> pa.Table:
    """A block's texts as token ids: the words' ids, put where the positions say."""
    rows = docs.to_pylist()
    dealt = next(r for r in rows if r["ids"] is None)
    ends, steps = np.cumsum(_unpacked(dealt["pieces"])), _unpacked(dealt["stream"])
    numbers, counts, ids = [], [], []
    for row in words.to_pylist():
        end = ends[row["bucket"]]
        counts.append(_unpacked(row["counts"]))
        numbers.append(np.cumsum(steps[end - len(counts[-1]) : end]))
        ids.append(_unpacked(row["ids"]).astype(np.int32))
    none = np.zeros(0, np.int64)
    number, count, flat = np.concatenate(numbers or [none]), np.concatenate(counts or [none]), np.concatenate(ids or [none.astype(np.int32)])
    starts, sizes = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
    starts[number], sizes[number] = np.cumsum(count) - count, count
    names, tokens, lengths = [], [], []
    for row in rows:
        if row["ids"] is None:
            continue
        stream, pieces = _unpacked(row["stream"]), _unpacked(row["pieces"])
        tokens.append(flat[spread(starts[stream], sizes[stream])])
        upto = np.concatenate([[0], np.cumsum(sizes[stream])])[np.concatenate([[0], np.cumsum(pieces)])]
        lengths.append(np.diff(upto))
        names += row["ids"]
    ends = np.concatenate([[0], np.cumsum(np.concatenate(lengths or [none]))]).astype(np.int32)
    release()
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(tokens or [none]).astype(np.int32)))
    return pa.table({"doc_id": pa.array(names, pa.int64()), "token_ids": lists})


def encode(docs: DataFrame, ranks_path: str, pattern: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, token_ids``: every whole text as token ids, one row per input row.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Null counts as empty and gives an empty
    list. Rows may share an id; ids may be null. A text of any length stays in one block, which is then as large as the text. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    small_batches(spark)
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))
    # words spread evenly over as many tasks as a shuffle has
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def cut_of(batches):
        return _cut_blocks(batches, pattern, tasks, block_bytes)

    def ids_of(batches):
        return _encode_words(batches, ranks.value, pattern)

    held = stash_bucketed(base.mapInArrow(cut_of, CUT_DDL), "block")
    asked = held.where("bucket is not null").select("bucket", "block", "sizes", "words")
    told = asked.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(ids_of, "block long, bucket int, counts binary, ids binary")
    texts = held.where("bucket is null").select("block", "ids", "pieces", "stream")
    return texts.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_assemble, "doc_id long, token_ids array<int>")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``encoded`` (with ``doc_id`` and ``token_ids``) and ``decoded``, the bytes that the ids stand for. A null list gives no bytes."""
    spark = encoded.sparkSession
    table = [token for token, _ in sorted(read_ranks(ranks_path).items(), key=lambda x: x[1])]
    held = spark.sparkContext.broadcast((b"".join(table), np.cumsum([0, *map(len, table)])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, begin = held.value
        data, length = np.frombuffer(data, np.uint8), np.diff(begin)
        for whole in batches:
            for at in range(0, max(1, whole.num_rows), 128):
                batch = whole.slice(at, 128)
                lists = batch.column(1)
                ids = lists.flatten().to_numpy(zero_copy_only=False)
                counts = np.array([len(x) if x is not None else 0 for x in lists], np.int64) if lists.null_count else np.diff(lists.offsets.to_numpy())
                # some tokens at a time: the index of every byte needs many times the bytes
                parts = [data[spread(begin[x], length[x])] for x in np.split(ids, range(TOKENS, len(ids), TOKENS))]
                sizes = np.concatenate([[0], np.cumsum(length[ids])])[np.concatenate([[0], np.cumsum(counts)])]
                decoded = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(sizes.astype(np.int32)), pa.py_buffer(np.concatenate(parts))])
                yield pa.RecordBatch.from_arrays([batch.column(0), lists, decoded], ["doc_id", "token_ids", "decoded"])
        release()

    return encoded.select("doc_id", "token_ids").mapInArrow(run, "doc_id long, token_ids array<int>, decoded binary")
