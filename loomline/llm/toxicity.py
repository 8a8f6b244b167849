"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

Input of a word: a hashed word vector plus the mean of hashed vectors of its character n-grams. Two gated recurrent
layers read a window of words in both directions, attention weighs the words' states, and a
logistic output scores the window. A text's score comes from its highest window; all windows of the whole text
overlap their neighbours and all are scored. What a word adds to the gates before recurrence is computed once per distinct
word of a batch.

Training runs in one task over a bounded sample of labelled rows (``SAMPLE`` per class), which never reaches the driver.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import chunks, crc_bucket, drop_stash, mixed, release, small_batches, stash

#: Labelled texts per class that are used at most for training, in a fixed pseudo-random order of ids.
SAMPLE = 3000
#: Labelled rows with longer texts are not picked for the sample; the task that trains holds the sample's whole texts.
SAMPLE_CHARS = 50_000
HELD_OUT, MODULUS = 0, 5
#: Words of a window, and words from one window's start to the next.
WIDTH, STRIDE = 48, 32
HIDDEN, DIM = 8, 16
WORD_ROWS, GRAM_ROWS = 1 << 14, 1 << 13
#: Rounds over the windows; small samples are read up to ten times, until STEPS batches.
EPOCHS, BATCH, RATE, STEPS = 2, 128, 0.07, 300
SEED = 5
#: Different sampled texts that must hold a word before it gets a vector.
MIN_TEXTS = 8
THRESHOLD = 0.5
_EDGE = b"\x22'()[]{}<>.,;:!?*#$%&|-_~"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Vocabulary:
    """Distinct words of a batch: their row in the word table and their n-grams' rows."""

    def __init__(self):
        self.number: dict[bytes, int] = {}

    def numbers(self, text: bytes) -> np.ndarray:
        words = text.split()
        get = self.number.setdefault
        return np.fromiter((get(w, len(self.number)) for w in words), np.int64, len(words))

    def inputs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word rows; n-gram rows, and where each word's n-grams begin. A slice of words at a time bounds what is held besides."""
        words = list(self.number)
        parts = [self._inputs(words[i : i + 20_000]) for i in range(0, max(1, len(words)), 20_000)]
        rows, grams, counts = (np.concatenate(x) for x in zip(*parts))
        return rows, grams, np.concatenate([[0], np.cumsum(counts)])

    @staticmethod
    def _inputs(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words = [w.lower().strip(_EDGE) for w in words]
        rows = np.fromiter((xxhash.xxh32_intdigest(w) % WORD_ROWS for w in words), np.int32, len(words))
        marked = [b"^" + w + b"$" for w in words]
        size = np.fromiter(map(len, marked), np.int64, len(marked))
        data = np.concatenate([np.frombuffer(b"".join(marked), np.uint8), np.zeros(4, np.uint8)]).astype(np.uint64)
        n = len(data) - 4
        left = np.repeat(np.cumsum(size), size) - np.arange(n)  # bytes to the word's end
        grams, owner = [], []
        word = np.repeat(np.arange(len(words)), size)
        for k in (3, 4):
            value = np.full(n, k, np.uint64)
            for i in range(k):
                value = value * np.uint64(257) + data[i : n + i]
            whole = left >= k
            grams.append((mixed(value[whole]) % np.uint64(GRAM_ROWS)).astype(np.int32))
            owner.append(word[whole])
        grams, owner = np.concatenate(grams), np.concatenate(owner)
        order = np.argsort(owner, kind="stable")
        return rows, grams[order], np.bincount(owner, minlength=len(words))


def windows_of(n: int) -> np.ndarray:
    """Where the windows of a text of ``n`` words begin; a text has one at least, and the last ends at its end."""
    if n <= WIDTH:
        return np.zeros(1, np.int64)
    starts = np.arange(0, n - WIDTH, STRIDE)
    return np.append(starts, n - WIDTH)


class Network:
    def __init__(self):
        r = np.random.default_rng(SEED)
        f = lambda *s, scale=0.3: r.normal(0, scale, s).astype(np.float32)
        self.p = {"word": np.zeros((WORD_ROWS, DIM), np.float32), "gram": f(GRAM_ROWS, DIM, scale=0.1), "a": f(2 * HIDDEN), "out": f(2 * HIDDEN), "bias": np.array([-1.0], np.float32)}
        for d in "fb":
            self.p |= {f"w{d}": f(DIM, 3 * HIDDEN), f"u{d}": f(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.scale = (1.0, 0.0)

    def embed(self, rows: np.ndarray, grams: np.ndarray, begins: np.ndarray) -> np.ndarray:
        total = np.zeros((len(rows), DIM), np.float32)
        count = np.diff(begins)
        some = count > 0
        for start in range(0, len(rows), 20_000):  # a slice of words at a time bounds the gathered vectors
            stop = min(len(rows), start + 20_000)
            at = np.flatnonzero(some[start:stop]) + start
            if len(at):
                total[at] = np.add.reduceat(self.p["gram"][grams[begins[start] : begins[stop]]], begins[at] - begins[start], axis=0) / count[at, None]
        return total + self.p["word"][rows]

    def _direction(self, d: str, gates: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
        """States (steps, windows, HIDDEN); gates come in reading order."""
        steps, n = gates.shape[:2]
        u = self.p[f"u{d}"]
        h = np.zeros((n, HIDDEN), np.float32)
        out = np.empty((steps, n, HIDDEN), np.float32)
        for t in range(steps):
            x, hu = gates[t], h @ u
            zr = _sigmoid(x[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            new = np.tanh(x[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
            m = mask[t][:, None]
            step = m * (1 - z) * (new - h)
            if keep is not None:
                keep.append((h, z, r, new, hu[:, 2 * HIDDEN :], m))
            h = h + step
            out[t] = h
        return out

    def forward(self, gates_f: np.ndarray, gates_b: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows; all inputs are (WIDTH, windows, ...)."""
        kf, kb = ([], []) if keep is not None else (None, None)
        hf = self._direction("f", gates_f, mask, kf)
        hb = self._direction("b", gates_b[::-1], mask[::-1], kb)[::-1]
        h = np.concatenate([hf, hb], axis=2)
        s = np.where(mask, h @ self.p["a"], -1e9)
        e = np.exp(s - s.max(0)) * mask
        w = e / np.maximum(e.sum(0), 1e-9)
        pooled = (w[:, :, None] * h).sum(0)
        if keep is not None:
            keep |= {"f": kf, "b": kb, "h": h, "w": w, "pooled": pooled}
        return pooled @ self.p["out"] + self.p["bias"][0]

    def gates(self, x: np.ndarray, d: str) -> np.ndarray:
        return x @ self.p[f"w{d}"] + self.p[f"c{d}"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Of the mean cross-entropy: by parameter, and by input vector."""
        keep: dict = {}
        logit = self.forward(self.gates(x, "f"), self.gates(x, "b"), mask, keep)
        g: dict[str, np.ndarray] = {}
        dl = (_sigmoid(logit) - y).astype(np.float32) / len(y)
        g["out"], g["bias"] = keep["pooled"].T @ dl, np.array([dl.sum()], np.float32)
        h, w = keep["h"], keep["w"]
        dp = dl[:, None] * self.p["out"]
        dw = (h * dp).sum(2)
        ds = w * (dw - (w * dw).sum(0))
        g["a"] = np.einsum("tbh,tb->h", h, ds)
        dh = w[:, :, None] * dp + ds[:, :, None] * self.p["a"]
        dx = np.zeros_like(x)
        for d, part in (("f", dh[:, :, :HIDDEN]), ("b", dh[::-1, :, HIDDEN:])):
            u = self.p[f"u{d}"]
            gu, dgates = np.zeros_like(u), np.empty((len(x), x.shape[1], 3 * HIDDEN), np.float32)
            carry = np.zeros((x.shape[1], HIDDEN), np.float32)
            for t in range(len(x) - 1, -1, -1):
                h0, z, r, new, hun, m = keep[d][t]
                total = part[t] + carry
                dn = total * m * (1 - z) * (1 - new * new)
                dz = -total * m * (new - h0) * z * (1 - z)
                dr = dn * hun * r * (1 - r)
                dhu = np.concatenate([dz, dr, dn * r], axis=1)
                dgates[t] = np.concatenate([dz, dr, dn], axis=1)
                gu += h0.T @ dhu
                carry = total * (1 - m * (1 - z)) + dhu @ u.T
            dgates = dgates if d == "f" else dgates[::-1]
            g[f"u{d}"] = gu
            g[f"w{d}"] = np.einsum("tbi,tbj->ij", x, dgates, optimize=True)
            g[f"c{d}"] = dgates.sum((0, 1))
            dx += dgates @ self.p[f"w{d}"].T
        return g, dx

    def score_windows(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The logit of every window of every text, and where each text's windows begin."""
        vocabulary = Vocabulary()
        numbers = [vocabulary.numbers(t) for t in texts]
        flat = np.concatenate([*numbers, np.zeros(1, np.int64)])
        if not vocabulary.number:
            vocabulary.number[b""] = 0
        x = self.embed(*vocabulary.inputs())
        gf, gb = self.gates(x, "f"), self.gates(x, "b")
        sizes = [len(n) for n in numbers]
        starts = [windows_of(n) for n in sizes]
        count = np.array([len(s) for s in starts])
        base = np.repeat(np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64), count)
        first = np.concatenate(starts) + base
        length = np.minimum(np.repeat(sizes, count), WIDTH)
        logits = np.empty(len(first), np.float32)
        for i in range(0, len(first), 2048):
            at = first[i : i + 2048][None, :] + np.arange(WIDTH)[:, None]
            mask = np.arange(WIDTH)[:, None] < length[i : i + 2048][None, :]
            ids = np.where(mask, flat[np.minimum(at, len(flat) - 1)], 0)
            logits[i : i + 2048] = self.forward(gf[ids], gb[ids], mask)
        return logits, np.concatenate([[0], np.cumsum(count)])

    def score(self, texts: list[bytes]) -> np.ndarray:
        logits, begins = self.score_windows(texts)
        a, b = self.scale
        return _sigmoid(a * np.maximum.reduceat(logits, begins[:-1]).astype(np.float64) + b)


def train(texts: list[bytes], toxic: np.ndarray, weight: np.ndarray | None = None) -> Network:
    """Fit the network on windows of labelled texts, then the slope and offset of the texts' scores.

    Every round reads every window of every clean text. A window of a toxic text need not be toxic itself: the first round
    takes all of them, later ones each toxic text's highest window. ``weight`` has the labelled rows that each text stands for, so that
    scores are calibrated to the labels' own share of toxic texts and not to the sample's.
    """
    net = Network()
    if not len(texts) or toxic.min() == toxic.max():
        return net
    rng = np.random.default_rng(SEED)
    vocabulary = Vocabulary()
    numbers = [vocabulary.numbers(t) for t in texts]
    rows, grams, begins = vocabulary.inputs()
    # rare words would be learned by heart: only words of some different texts get vectors of their own
    spread, seen = np.zeros(WORD_ROWS, np.int64), set()
    for text, n in zip(texts, numbers):
        if text not in seen:
            seen.add(text)
            spread[np.unique(rows[n])] += 1
    common = spread >= MIN_TEXTS
    owner, start = [], []
    for i, n in enumerate(numbers):
        s = windows_of(len(n))
        owner += [i] * len(s)
        start += s.tolist()
    owner, start = np.array(owner), np.array(start)
    label = toxic[owner].astype(np.float32)
    squares = {k: np.full_like(v, 1e-6) for k, v in net.p.items()}
    for epoch in range(min(10, max(EPOCHS, -(-STEPS * BATCH // len(owner))))):
        use = np.arange(len(owner))
        if epoch:
            logits = _window_logits(net, numbers, owner, start, rows, grams, begins)
            top = np.full(len(texts), -np.inf)
            np.maximum.at(top, owner, logits)
            use = use[(label == 0) | (logits >= top[owner])]
        use = rng.permutation(use)
        for i in range(0, len(use), BATCH):
            b = use[i : i + BATCH]
            ids, mask = _batch(numbers, owner[b], start[b])
            kinds, place = np.unique(ids, return_inverse=True)
            place = place.reshape(ids.shape)
            count = begins[kinds + 1] - begins[kinds]
            own = np.concatenate([grams[begins[k] : begins[k + 1]] for k in kinds])
            x = net.embed(rows[kinds], own, np.concatenate([[0], np.cumsum(count)]))
            g, dx = net.gradients(x[place], mask, label[b])
            _, dk = summed(place.ravel(), (dx * mask[:, :, None]).reshape(-1, DIM))
            known = common[rows[kinds]]
            for name, at, grad in (("word", rows[kinds][known], dk[known]), ("gram", own, np.repeat(dk / np.maximum(count, 1)[:, None], count, axis=0))):
                k, total = summed(at, grad)
                squares[name][k] += total * total
                net.p[name][k] -= RATE * total / np.sqrt(squares[name][k])
            for name, grad in g.items():
                squares[name] += grad * grad
                net.p[name] -= RATE * grad / np.sqrt(squares[name])
    top = np.full(len(texts), -np.inf)
    np.maximum.at(top, owner, _window_logits(net, numbers, owner, start, rows, grams, begins))
    net.scale = _platt(top, toxic, np.ones(len(toxic)) if weight is None else weight)
    return net


def summed(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sums of ``rows`` by their place, places ascending."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else at
    return at[first], np.add.reduceat(rows[order], first, axis=0) if len(at) else rows


def _batch(numbers: list[np.ndarray], owner: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ids, mask = np.zeros((WIDTH, len(owner)), np.int64), np.zeros((WIDTH, len(owner)), bool)
    for j, (i, s) in enumerate(zip(owner, start)):
        own = numbers[i][s : s + WIDTH]
        ids[: len(own), j], mask[: len(own), j] = own, True
    return ids, mask


def _window_logits(net: Network, numbers, owner, start, rows, grams, begins) -> np.ndarray:
    x = net.embed(rows, grams, begins)
    gf, gb = net.gates(x, "f"), net.gates(x, "b")
    out = np.empty(len(owner), np.float32)
    for i in range(0, len(owner), 2048):
        ids, mask = _batch(numbers, owner[i : i + 2048], start[i : i + 2048])
        out[i : i + 2048] = net.forward(gf[ids], gb[ids], mask)
    return out


def _platt(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton steps with a little shrinkage."""
    a, b = 1.0, 0.0
    w = w * (len(w) / w.sum())
    for _ in range(50):
        p = _sigmoid(a * x + b)
        v = w * np.maximum(p * (1 - p), 1e-6)
        ga, gb = (w * (p - y) * x).sum() + 1e-2 * (a - 1), (w * (p - y)).sum()
        haa, hab, hbb = (v * x * x).sum() + 1e-2, (v * x).sum(), v.sum() + 1e-6
        det = haa * hbb - hab * hab + 1e-12
        a, b = a - np.clip((hbb * ga - hab * gb) / det, -1, 1), b - np.clip((haa * gb - hab * ga) / det, -3, 3)
    return float(max(a, 0.05)), float(b)


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, toxic, text, weight``: at most SAMPLE rows of each class, one for each id, in a fixed pseudo-random order of ids; ``weight`` is how many labelled rows of its class each stands for.

    Labels of one id that contradict each other teach nothing. Rows with the same id and other texts count as their least text. Ids that
    are held out, and texts of more than SAMPLE_CHARS, are left out before the rows are picked.
    """
    own = labels.where("toxic is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("l_id"), F.col("toxic").cast("int").alias("toxic"))
    own = own.where(crc_bucket(F.col("l_id"), MODULUS) != HELD_OUT).groupBy("l_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most and toxic in (0, 1)")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    whole = text.where(F.length("text") <= SAMPLE_CHARS)
    known = stash(own.join(whole.select(F.col("doc_id").alias("l_id")), "l_id", "left_semi").select("l_id", "toxic"))
    total = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    parts = []
    for kind in (0, 1):
        part = known.where(F.col("toxic") == kind).orderBy(F.xxhash64("l_id"), "l_id").limit(SAMPLE)
        parts.append(part.withColumn("weight", F.lit(max(1.0, total.get(kind, 0) / SAMPLE))))
    picked = parts[0].unionByName(parts[1])
    # at most two samples of ids, which may go to every task
    rows = whole.join(F.broadcast(picked), whole.doc_id == picked.l_id).groupBy("doc_id", "toxic", "weight").agg(F.min("text").alias("text"))
    rows = stash(rows)
    drop_stash(known)
    return rows


def _trained(batches: Iterator[pa.RecordBatch]) -> bytes:
    """The pickled parameters of the network that the rows train."""
    rows = pa.Table.from_batches(batches, pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("weight", pa.float64()), ("text", pa.string())])).sort_by("doc_id")
    texts, toxic, weight = rows["text"].cast(pa.binary()).to_pylist(), rows["toxic"].to_numpy().astype(np.int64), rows["weight"].to_numpy()
    del rows
    net = train(texts, toxic, weight)
    return pickle.dumps((net.p, net.scale))


def _train_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model = _trained(batches)
    release()  # nothing of the sample is held any more
    yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], ["model"])


def fit(docs: DataFrame, labels: DataFrame) -> Network:
    """Train on the texts of ``training_rows``, in one task; only the parameters reach the driver."""
    small_batches(docs.sparkSession)
    held = training_rows(docs, labels)
    found = held.select("doc_id", "toxic", "weight", "text").coalesce(1).mapInArrow(_train_task, "model binary").collect()
    drop_stash(held)
    net = Network()
    if found:
        net.p, net.scale = pickle.loads(found[0].model)  # noqa: S301  made by the task above
    return net


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every whole text.

    ``docs`` needs ``doc_id`` and ``text``, ``labels`` ``doc_id`` and ``toxic``; other columns are ignored. Rows whose
    crc32(id as text) mod 5 is 0 teach nothing. Null and empty texts have one window without words. A text of any length is scored by all
    its windows. With labels of one class only, or none, the untrained network scores. Null ids are scored, never learned from. Repeated
    rows get equal scores, one row each; an empty table gives an empty table.
    """
    net = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "text", 1 << 20):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(net.value.score(texts))], ["doc_id", "score"])

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = base.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", (crc_bucket(F.col("doc_id"), MODULUS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is below the threshold. Each text is scored where it lies.

    Nulls, empty and very long texts, repeated rows and empty tables are scored as ``toxicity_scores`` says; kept rows are unchanged.
    """
    net = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "text", 1 << 20):
            yield batch.filter(pa.array(net.value.score(texts) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
