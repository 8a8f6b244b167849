"""Quality classifier: random Fourier features, ridge regression and isotonic calibration.

A text becomes a row of statistics; these are standardised and mapped by random cosines whose inner
products approximate a Gaussian kernel. Each task sums its part of the normal equations,
a second step sums these sums in a fixed number of groups, and the driver solves one
system of fixed size. Isotonic regression on labelled rows that the fit did not see turns raw scores into probabilities; it
reads them as a histogram of fixed size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import WordHashes, chunks, crc_bucket, drop_stash, hashed_words, small_batches, stash
from loomline.llm.rules import _flags, repeated_words

FEATURES, SIGMA, RIDGE = 256, 3.0, 1e-3
SEED = 11
#: Partial sums that reach the driver.
SLOTS = 16
BINS = 4096
HELD_OUT, MODULUS = 2, 4
#: Remainder of the rows that calibrate; the other labelled rows fit.
CALIBRATE = 3
THRESHOLD = 0.7

_CLASSES = [_flags(c) for c in (b" \t\x0b\x0c\r", b"\n", bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789", b"!?", b".,;:", b"|", b"#*$%&<>", b"\"'()[]{}", bytes(range(0x80, 0xC0)), bytes(range(0xC0, 0x100)), b"@/\\_=+~^`")]
N_STATS = len(_CLASSES) + 9


def statistics(texts: list[bytes], known: WordHashes) -> np.ndarray:
    """A row of statistics for every whole text."""
    words, ends = hashed_words(texts, known)
    data = np.frombuffer(b"".join(texts), np.uint8)
    at = np.cumsum([0, *map(len, texts)])
    size = np.maximum(np.diff(at), 1)
    n_words = np.diff(ends)
    per_word = np.maximum(n_words, 1)
    out = np.zeros((len(texts), N_STATS))
    for k, table in enumerate(_CLASSES):
        total = np.concatenate([[0], np.cumsum(table[data])])
        out[:, k] = np.sqrt((total[at[1:]] - total[at[:-1]]) / size)
    again = np.zeros(len(words) + 1, np.int64)
    if len(words):
        again[1:-1] = words[1:] == words[:-1]
        again[ends[:-1][n_words > 0]] = 0
    again = np.cumsum(np.append(0, again))
    k = len(_CLASSES)
    out[:, k] = np.log1p(n_words)
    out[:, k + 1] = np.log1p(size / per_word)
    out[:, k + 2] = repeated_words(words, ends) / per_word
    out[:, k + 3] = (again[ends[1:]] - again[ends[:-1]]) / per_word
    for i, text in enumerate(texts):
        own = words[ends[i] : ends[i + 1]]
        if not len(own):
            continue
        _, times = np.unique(own, return_counts=True)
        share = times / len(own)
        lines = text.split(b"\n")
        out[i, k + 4] = np.log(len(times)) / np.log(len(own) + 1)
        out[i, k + 5] = share.max()
        out[i, k + 6] = -(share * np.log(share)).sum() / np.log(len(own) + 1)
        out[i, k + 7] = 1 - len(set(lines)) / len(lines)
        out[i, k + 8] = np.log1p(len(own) / len(lines))
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    for batch, texts in chunks(batches, "text"):
        x = statistics(texts, known).astype(np.float32)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * N_STATS), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "stats"])


def summed(df: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """The sum of ``part`` over all batches; tasks sum first, then SLOTS groups, and SLOTS arrays reach the driver."""

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                total += part(batch)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % SLOTS], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["slot", "sums"])

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for raw in batch.column(1).to_pylist():
                total += np.frombuffer(raw).reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    parts = df.mapInArrow(within, "slot int, sums binary").repartition(SLOTS, "slot").mapInArrow(across, "sums binary")
    return sum((np.frombuffer(r.sums).reshape(shape) for r in parts.collect()), np.zeros(shape))


def _matrix(batch: pa.RecordBatch, column: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, N_STATS).astype(np.float64)


class QualityModel:
    """Standardisation, cosines, ridge weights and the calibration steps."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = mean, scale
        self.w = rng.normal(0, 1 / SIGMA, (N_STATS, FEATURES))
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros(FEATURES + 1)
        self.knots = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def features(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        z = np.sqrt(2 / FEATURES) * np.cos(x @ self.w + self.b)
        return np.hstack([z, np.ones((len(z), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.features(x) @ self.weights, -0.5, 1.5)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), *self.knots), 0.0, 1.0)


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the non-decreasing fit of the mean ``y`` at ``x`` with weights ``n``, as knots."""
    blocks: list[list[float]] = []
    for xi, yi, ni in zip(x, y, n):
        blocks.append([xi * ni, yi * ni, ni])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def fit(stats: DataFrame, labels: DataFrame) -> QualityModel:
    """Fit on the labelled rows of ``labels(doc_id, quality)`` that are not held out; all of them count."""
    own = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("l_id"), F.col("quality").cast("double").alias("y"))
    rows = stats.join(own, stats.doc_id == own.l_id).withColumn("fold", crc_bucket(F.col("doc_id"), MODULUS)).where(F.col("fold") != HELD_OUT)
    rows = stash(rows.select("stats", "y", "fold"))
    fitted = rows.where(F.col("fold") != CALIBRATE)

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x = _matrix(batch, 0)
        return np.vstack([np.full(N_STATS, len(x)), x.sum(0), (x * x).sum(0)])

    n, total, square = summed(fitted, moments, (3, N_STATS))
    n = np.maximum(n, 1)
    model = QualityModel(total / n, np.sqrt(np.maximum(square / n - (total / n) ** 2, 0)) + 1e-3)

    def normal(batch: pa.RecordBatch) -> np.ndarray:
        z = model.features(_matrix(batch, 0))
        return np.vstack([z.T @ z, z.T @ batch.column(1).to_numpy()])

    sums = summed(fitted, normal, (FEATURES + 2, FEATURES + 1))
    gram, target = sums[:-1], sums[-1]
    model.weights = np.linalg.solve(gram + RIDGE * max(n[0], 1) * np.eye(FEATURES + 1), target)

    def histogram(batch: pa.RecordBatch) -> np.ndarray:
        at = ((model.raw(_matrix(batch, 0)) + 0.5) / 2 * (BINS - 1)).round().astype(np.int64)
        return np.vstack([np.bincount(at, minlength=BINS), np.bincount(at, batch.column(1).to_numpy(), minlength=BINS)])

    count, good = summed(rows.where(F.col("fold") == CALIBRATE), histogram, (2, BINS))
    used = np.flatnonzero(count)
    if len(used):
        model.knots = isotonic(used / (BINS - 1) * 2 - 0.5, good[used] / count[used], count[used])
    drop_stash(rows)
    return model


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every whole text.

    ``docs`` needs ``doc_id`` and ``text``, ``labels`` ``doc_id`` and ``quality``; other columns are ignored. Rows whose
    crc32(id as text) mod 4 is 2 teach nothing. Null and empty texts have all-zero statistics and are scored like any
    other. Without any label every score is that of an untrained model. Null ids are scored, never learned from. Repeated rows and repeated
    labels teach as often as they come and get equal scores. A text of any length is read whole. An empty table gives an empty table.
    """
    small_batches(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    stats = stash(base.mapInArrow(_scan, "doc_id long, stats array<float>"))
    model = fit(stats, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_matrix(batch, 1)))], ["doc_id", "score"])

    out = stats.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", (crc_bucket(F.col("doc_id"), MODULUS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
