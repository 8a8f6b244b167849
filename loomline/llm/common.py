"""Shared pieces: staging tables, whole-text word splitting, hashing, batches."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.session import importable, shared_dir

#: One word of a text: what stands between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: The characters that separate words.
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes of text that one numpy step works on.
CHUNK_BYTES = 2 << 20


def stash(df: DataFrame, partition_by: str | None = None, compression: str = "none") -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back: it cuts the lineage and outlives lost executors.

    Most staging tables are hashes and ids, which do not compress; without a codec the writers hold no native buffers.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/stash-{uuid.uuid4().hex}"
    writer = df.write.option("compression", compression)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out._stash_path = at
    return out


def stash_bucketed(df: DataFrame, *by: str, ordered: bool = False, compression: str = "none") -> DataFrame:
    """Like ``stash``, in one bucket of ``by`` for each shuffle partition: joins and groupings on ``by`` read it without a shuffle.

    With ``ordered``, rows are sorted by ``by`` in each bucket and joins need no sort either, if each bucket is one file, as it is
    for results that were shuffled by the same columns.
    """
    spark = df.sparkSession
    name = f"loomline_{uuid.uuid4().hex}"
    at = f"{shared_dir(spark)}/stash-{name}"
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
    writer = df.write.format("parquet").option("path", at).option("compression", compression).bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), *by)
    if ordered:
        writer = writer.sortBy(*by)
    writer.saveAsTable(name)
    out = spark.table(name)
    out._stash_path, out._stash_table = at, name
    return out


def drop_stash(df: DataFrame) -> None:
    """Delete a stashed table that no pending plan reads any more."""
    spark = df.sparkSession
    if hasattr(df, "_stash_table"):
        spark.sql(f"DROP TABLE IF EXISTS {df._stash_table}")
    path = spark._jvm.org.apache.hadoop.fs.Path(df._stash_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; null stays null."""
    return F.translate(text, UPPER, UPPER.lower())


def crc_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(modulus))


def texts_of(column: pa.Array) -> list[bytes]:
    """The bytes of every text; null is empty."""
    return [b"" if x is None else x for x in column.to_pylist()]


def small_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Make the package importable in workers, and let the session send at most 8 MB of rows to Python at a time; by default it is 64 MB, held by the JVM and by Python at once."""
    importable(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = str(spark.conf.get(key)).lower().rstrip("b")
    if not held.isdigit() or int(held) > most:
        spark.conf.set(key, str(most))


def release() -> None:
    """Give memory that this Python worker no longer uses back to the system; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with about ``limit`` bytes of text each, and their texts. One longer text comes alone, whole."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column)).cast(pa.binary())
        start = size = 0
        for i, length in enumerate(pc.binary_length(texts).to_pylist()):
            length = length or 0
            if size and size + length > limit:
                yield batch.slice(start, i - start), texts_of(texts.slice(start, i - start))
                start, size = i, 0
            size += length
        if start < batch.num_rows:
            yield batch.slice(start), texts_of(texts.slice(start))
        release()


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a fixed number of distinct words."""

    LIMIT = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def hashed_words(texts: list[bytes], known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of every text in one array, and where each text's words begin (one more entry than texts)."""
    split = [t.split() for t in texts]  # bytes.split() cuts at exactly the six separators
    ends = np.cumsum([0, *map(len, split)])
    flat = np.fromiter((known[w] for ws in split for w in ws), np.uint64, int(ends[-1]))
    return flat, ends


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: The modulus of span hashes, a prime. (Modulo a power of two, texts of two words that alternate in a certain order would collide for every base.)
PRIME = (1 << 61) - 1
_P, _LOW, _29, _32, _61 = np.uint64(PRIME), np.uint64(0xFFFFFFFF), np.uint64(29), np.uint64(32), np.uint64(61)


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> _61)
    return np.where(x >= _P, x - _P, x)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME, of values below it."""
    a1, a0, b1, b0 = a >> _32, a & _LOW, b >> _32, b & _LOW
    middle, low = a1 * b0 + a0 * b1, a0 * b0
    return _reduced((low & _P) + (low >> _61) + (a1 * b1 << np.uint64(3)) + (middle >> _29) + ((middle & np.uint64((1 << 29) - 1)) << _32))


class SpanHasher:
    """Hashes of any spans of one array of word hashes, in constant time each (polynomial modulo a prime of 61 bits)."""

    _powers: dict[int, np.ndarray] = {}

    def __init__(self, words: np.ndarray, base: int):
        n = len(words)
        base %= PRIME
        self.inverse = self._power(pow(base, -1, PRIME), n + 1)
        held = _times(_reduced(words), self._power(base, n + 1)[:n])
        # running sums of the halves do not overflow
        low, high = (np.concatenate([[np.uint64(0)], np.cumsum(x)]) for x in (held & _LOW, held >> _32))
        self.sums = _reduced(_times(_reduced(high), np.full(n + 1, 1 << 32, np.uint64)) + low)

    @classmethod
    def _power(cls, base: int, n: int) -> np.ndarray:
        """base**0, base**1, ...; remembered, and doubled when more are needed."""
        held = cls._powers.get(base)
        if held is None:
            held = np.ones(1, np.uint64)
        while len(held) < n:
            held = np.concatenate([held, _times(held, np.full(len(held), pow(base, len(held), PRIME), np.uint64))])
        cls._powers[base] = held
        return held[:n]

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed(_times(_reduced(self.sums[end] + (_P - self.sums[start])), self.inverse[start]))


#: Multipliers, one per independent family of hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def text_key(text: Column) -> Column:
    """A 64-bit fingerprint that tells rows with the same id but other texts apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def one_of_each(docs: DataFrame, kept: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose ``keys`` (expressions over ``docs`` by the columns of ``kept``) stand in ``kept``: one row for each.

    ``kept`` has a row for each row of ``docs`` that may stay. Only keys that stand there more than once need a choice between rows.
    """
    marks = stash(kept.groupBy(*keys).agg(F.count("*").alias("_n")))
    named = lambda of: [expr.eqNullSafe(of[name]) for name, expr in keys.items()]
    single = marks.where("_n = 1")
    once = docs.join(single, named(single), "left_semi")
    several = marks.where("_n > 1")
    if several.isEmpty():
        return once
    again = docs.join(several, named(several)).select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), *keys)
    first = again.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.to_json("row"))))
    return once.unionByName(first.where("place = 1").select("row.*"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` (long ids): a staging table ``node, component`` with the smallest reachable id.

    Each batch of edges is first contracted by union-find where it lies; then rounds of
    large-star and small-star joins run until nothing changes. Every round is
    a written table, so a lost executor never forces the earlier rounds to run
    again. Nothing about the links reaches the driver except one count.
    """
    now = stash(edges.where("a is not null and b is not null and a <> b").mapInArrow(_contract, "a long, b long").distinct())
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stash(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        # large star: larger neighbours move to the least neighbour
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = large.unionByName(least.where("m < a").select("a", F.col("m").alias("b"))).distinct()
        large = stash(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
        # small star: smaller neighbours move to the least one
        low = stash(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = stash(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        for x in (now, least, large, low):
            drop_stash(x)
        now, before = new, mark
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
        if mark == before:
            roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
            out = stash(now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots))
            drop_stash(now)
            return out


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace each batch's edges by a star for each of its components."""
    for batch in batches:
        a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        if not len(a):
            continue
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = union_find(at[: len(a)], at[len(a) :], len(nodes))
        keep = root != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(nodes[root[keep]])], ["a", "b"])


def union_find(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least index of the component of each of ``n`` nodes."""
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return np.fromiter((find(i) for i in range(n)), np.int64, n)
