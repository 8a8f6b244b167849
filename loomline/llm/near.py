"""Near-duplicate documents by SuperMinHash.

Signature: each shingle walks a pseudo-random permutation of the signature's
slots, seeded by its hash; at step k it offers k + u (u uniform) to the slot that it visits, and each
slot keeps the least offer. Steps run for all shingles of a batch together and stop for a document as soon as all
its slots hold values that later steps cannot improve (Ertl, 2017).

Banding: equal bands put documents into buckets. Documents with the same shingle
set are one class from the start and are represented by their smallest id, so copies never meet in a bucket.

Verification compares whole shingle sets and grows groups by the links that it has confirmed. First each
document is compared with one anchor, the member of its buckets that shares most buckets with others; a family of near copies mostly collapses into
one group around it. Buckets that still hold documents of more than one group are then compared in full,
without the pairs inside a group: a bucket's pairs are either in one group already or compared themselves. Tasks take
units of bounded size, whatever the sizes of buckets, anchors' followings and groups are. Union-find turns confirmed links into groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import BASES, WordHashes, chunks, components, drop_stash, hashed_words, mixed, one_of_each, release, signed, small_batches, stash, stash_bucketed, union_find

SHINGLE = 5
BANDS, ROWS = 64, 8
#: Documents of one block, and its shingles where texts are long; a task holds at most two blocks at a time.
BLOCK_DOCS, BLOCK_SHINGLES = 64, 2_000_000
#: Places that the rows of a hot anchor, group or cluster are spread over in joins with what is known of it.
SALTS = 32
#: Steps of the permutations that are traced through the swaps; for later ones, which only short texts need, permutations are kept.
TRACED = 16


def shingle_sets(texts: list[bytes], known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every lower-cased text, sorted within a text, and where each text's begin."""
    words, ends = hashed_words([t.lower() for t in texts], known)
    n = len(texts)
    counts = np.diff(ends)
    # whole sequences of texts with fewer words than a shingle
    number = np.where(counts >= SHINGLE, counts - SHINGLE + 1, (counts > 0).astype(np.int64))
    doc = np.repeat(np.arange(n), number)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number) + ends[doc]
    size = np.minimum(counts, SHINGLE)[doc]
    value = np.zeros(len(doc), np.uint64)
    padded = np.concatenate([words, np.zeros(SHINGLE, np.uint64)])
    for k in range(SHINGLE):
        step = mixed(padded[at + k] + np.uint64(BASES[k % 3] * (k + 1) & (2**64 - 1)))
        value = np.where(k < size, mixed(value * np.uint64(BASES[0]) + step), value)
    # by text, then by the value's leading bits: equal values of a text become neighbours
    key = (doc.astype(np.uint64) << np.uint64(44)) | (value >> np.uint64(20))
    order = np.argsort(key)
    key = key[order]
    if ((key[1:] == key[:-1]) & (value[order][1:] != value[order][:-1])).any():  # leading bits alone do not tell them apart
        order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    keep = np.ones(len(doc), bool)
    keep[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[keep], doc[keep]
    return value, np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))])


def superminhash(value: np.ndarray, begins: np.ndarray, slots: int) -> np.ndarray:
    """One row of ``slots`` values for every set; sets without elements get infinities."""
    n = len(begins) - 1
    held = np.full(n * slots, np.inf, np.float32)
    doc = np.repeat(np.arange(n), np.diff(begins))
    state, swaps, perm = value.copy(), [], None
    for k in range(slots):
        if not len(doc):
            break
        state = mixed(state + np.uint64(0x9E3779B97F4A7C15))
        u = (state >> np.uint64(40)).astype(np.float32) * np.float32(2**-24)
        # Fisher-Yates: step k swaps place k with a random place j from k on
        j = (((state & np.uint64(0xFFFFFFFF)) * np.uint64(slots - k) >> np.uint64(32)).astype(np.int16) + np.int16(k)).astype(np.int16)
        if k < TRACED:
            slot = j.copy()  # follow the place back through the few swaps so far
            for i in range(k - 1, -1, -1):
                slot[slot == swaps[i]] = i
            swaps.append(j)
        else:
            at = np.arange(len(doc))
            if perm is None:
                perm = np.tile(np.arange(slots, dtype=np.int16), (len(doc), 1))
                for i, s in enumerate(swaps):
                    old = perm[at, s]
                    perm[at, s] = perm[:, i]
                    perm[:, i] = old
            slot = perm[at, j]
            perm[at, j] = perm[:, k]
            perm[:, k] = slot
        np.minimum.at(held, doc * slots + slot, u + np.float32(k))
        if k % 4 == 3 or k < 2:
            live = (held.reshape(n, slots).max(1) >= k + 1)[doc]
            if not live.all():
                doc, state, swaps = doc[live], state[live], [s[live] for s in swaps]
                perm = None if perm is None else perm[live]
    return held.reshape(n, slots)


def _signed_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    for batch, texts in chunks(batches, "text", 1 << 20):
        value, begins = shingle_sets(texts, known)
        size = np.diff(begins)
        held = superminhash(value, begins, BANDS * ROWS).view(np.uint32).astype(np.uint64).reshape(len(texts), BANDS, ROWS)
        band = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(texts), 1))
        for r in range(ROWS):
            band = mixed(band * np.uint64(BASES[1]) + held[:, :, r])
        key = [np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.uint64)]
        for i, base in enumerate((BASES[0], BASES[2])):
            total = np.concatenate([[np.uint64(0)], np.cumsum(mixed(value * np.uint64(base)))])
            key[i] = mixed(total[begins[1:]] - total[begins[:-1]] + size.astype(np.uint64))
        full = pa.array(size == 0)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * BANDS), signed(band.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), signed(key[0]), signed(key[1]), pa.compute.if_else(full, pa.scalar(None, lists.type), lists)], ["doc_id", "n_shingles", "key_a", "key_b", "bands"])


def _with_anchor(unit: pd.DataFrame, threshold: int) -> pd.DataFrame:
    """The links between an anchor and some of the documents that are to be compared with it."""
    ids, is_anchor = unit["node"].to_numpy(), unit["is_anchor"].to_numpy()
    value, begins = shingle_sets([t.encode() for t in unit["text"]], WordHashes())
    size = np.diff(begins)
    doc = np.repeat(np.arange(len(ids)), size)
    linked = np.zeros(len(ids), bool)
    for k in np.flatnonzero(is_anchor):  # more than one if rows share the anchor's id
        own = value[begins[k] : begins[k + 1]]
        common = np.bincount(doc[np.isin(value, own)], minlength=len(ids))
        linked |= (100 * common >= threshold * (size + len(own) - common)) & (common > 0)
    linked &= ~is_anchor
    release()
    return pd.DataFrame({"a": ids[linked], "b": unit["anchor"].to_numpy()[linked]})


def _between_groups(unit: pd.DataFrame, threshold: int) -> pd.DataFrame:
    """A spanning forest of the links between documents of different groups, in one or two blocks."""
    ids = unit["node"].to_numpy()
    part = unit["part"].to_numpy() if unit["two"].iloc[0] else None
    value, begins = shingle_sets([t.encode() for t in unit["text"]], WordHashes())
    a, b = similar_pairs(value, begins, threshold, part, unit["component"].to_numpy())
    root = union_find(a, b, len(ids))
    root = _least_id(root, ids)
    keep = root != ids
    release()
    return pd.DataFrame({"a": ids[keep], "b": root[keep]})


def _least_id(root: np.ndarray, ids: np.ndarray) -> np.ndarray:
    low = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(low, root, ids)
    return low[root]


def similar_pairs(value: np.ndarray, begins: np.ndarray, threshold: int, *labels: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs with 100 * intersection >= threshold * union that differ in each of the ``labels``.

    Exact: a row of set sizes bounds who can be similar, and the sizes of the
    intersections come from products of 0/1 matrices, a strip of documents and a slice of elements at a time.
    """
    n, size = len(begins) - 1, np.diff(begins)
    doc = np.repeat(np.arange(n), size)
    elements, column, times = np.unique(value, return_inverse=True, return_counts=True)
    keep = times[column] > 1  # an element of one set adds to no intersection
    if not keep.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    _, column = np.unique(column[keep], return_inverse=True)
    doc = doc[keep]
    # elements of exactly the same sets count together
    held = np.zeros(int(column.max()) + 1, np.uint64)
    np.add.at(held, column, mixed(doc.astype(np.uint64) + np.uint64(1)))
    _, one, same, weight = np.unique(held, return_index=True, return_inverse=True, return_counts=True)
    first = np.zeros(len(held), bool)
    first[one] = True
    doc, column = doc[first[column]], same[column[first[column]]]
    order = np.argsort(column, kind="stable")
    column, doc = column[order], doc[order]
    width = min(len(weight), max(256, (8 << 20) // max(1, n)))
    out_a, out_b = [], []
    for start in range(0, n, 512):
        stop = min(n, start + 512)
        common = np.zeros((stop - start, n - start), np.float32)
        for c in range(0, int(column[-1]) + 1, width):
            lo, hi = np.searchsorted(column, [c, c + width])
            d, e = doc[lo:hi], column[lo:hi] - c
            late = d >= start
            d, e = d[late] - start, e[late]
            if not (d < stop - start).any():
                continue
            m = np.zeros((n - start, min(width, len(weight) - c)), np.float32)
            m[d, e] = 1
            common += (m[: stop - start] * weight[c : c + width].astype(np.float32)) @ m.T
        union = size[start:stop, None] + size[None, start:] - common
        linked = (100 * common.astype(np.float64) >= threshold * union) & (common > 0)
        for label in labels:
            if label is not None:
                linked &= label[start:stop, None] != label[None, start:]
        a, b = np.nonzero(linked)
        later = b > a
        out_a.append(a[later] + start)
        out_b.append(b[later] + start)
    return np.concatenate(out_a), np.concatenate(out_b)


def _blocks(count: Column, load: Column) -> Column:
    return F.greatest(F.ceil(count / BLOCK_DOCS), F.ceil(load / BLOCK_SHINGLES)).cast("int")


def _salted(hot: DataFrame) -> DataFrame:
    """A table with one row for each hot key, repeated for every place that a key's rows are spread over."""
    return stash(hot.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))


def _attach(df: DataFrame, salted: DataFrame, key: str) -> DataFrame:
    """Left-join what is known of hot keys to rows of which very many may have the same key."""
    return df.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(salted, [key, "salt"], "left").drop("salt")


def _part(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("node", F.lit(1)), blocks).cast("int")


def _star(held: DataFrame, pairs: DataFrame, threshold: int) -> DataFrame:
    """The confirmed links among ``pairs(node, anchor, n_shingles)``, in units of an anchor and some of its pairs."""
    parts = stash(pairs.groupBy("anchor").agg(_blocks(F.count("*"), F.sum("n_shingles")).alias("parts")))
    hot = _salted(parts.where("parts > 1"))
    placed = _attach(pairs, hot, "anchor").select("node", "anchor", F.coalesce(_part(F.col("parts")), F.lit(0)).alias("part"), F.lit(False).alias("is_anchor"))
    anchors = parts.select(F.col("anchor").alias("node"), "anchor", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("is_anchor"))
    placed = stash(placed.unionByName(anchors))

    def with_anchor(unit: pd.DataFrame) -> pd.DataFrame:
        return _with_anchor(unit, threshold)

    links = stash(held.join(placed, "node").groupBy("anchor", "part").applyInPandas(with_anchor, "a long, b long"))
    for x in (parts, hot, placed):
        drop_stash(x)
    return links


def _full(held: DataFrame, open_: DataFrame, threshold: int) -> DataFrame:
    """The links between documents of different groups that share a bucket of ``open_(node, bucket, component, n_shingles)``.

    Groups that meet in buckets form clusters. The pairs inside a cluster's largest group are never sent anywhere; its
    blocks meet only those of the rest.
    """
    meet = open_.groupBy("bucket").agg(F.min("component").alias("least"))
    ties = open_.join(meet, "bucket").select(F.col("component").alias("a"), F.col("least").alias("b"))
    clusters = components(ties.unionByName(open_.select(F.col("node").alias("a"), F.col("component").alias("b"))).distinct())
    nodes = open_.groupBy("node").agg(F.max("component").alias("component"), F.max("n_shingles").alias("n_shingles"))
    nodes = stash(nodes.join(clusters.select("node", F.col("component").alias("cluster")), "node"))
    groups = nodes.groupBy("cluster", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("load"))
    total = groups.groupBy("cluster").agg(F.max(F.struct("load", "n", "component")).alias("giant"), F.sum("n").alias("n"), F.sum("load").alias("load"))
    rest = _blocks(F.col("n") - F.col("giant.n"), F.col("load") - F.col("giant.load"))
    hot = _salted(total.where(_blocks(F.col("n"), F.col("load")) > 1).select("cluster", F.col("giant.component").alias("giant"), _blocks(F.col("giant.n"), F.col("giant.load")).alias("g"), rest.alias("r")))
    placed = _attach(nodes, hot, "cluster")
    in_giant = F.col("component") == F.col("giant")
    part = F.when(F.col("giant").isNull(), 0).when(in_giant, _part(F.col("g"))).otherwise(F.col("g") + _part(F.col("r")))
    other = F.when(F.col("giant").isNull(), F.array(F.lit(0))).when(in_giant, F.sequence(F.col("g"), F.col("g") + F.col("r") - 1)).otherwise(F.sequence(F.lit(0), F.col("g") + F.col("r") - 1))
    placed = placed.withColumn("part", part.cast("int")).withColumn("other", F.explode(other))
    placed = stash(placed.select("node", "component", "cluster", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), F.col("other")))
    units = held.join(placed, "node").withColumn("two", F.col("i") != F.col("j"))

    def between_groups(unit: pd.DataFrame) -> pd.DataFrame:
        return _between_groups(unit, threshold)

    links = stash(units.groupBy("cluster", "i", "j").applyInPandas(between_groups, "a long, b long"))
    for x in (clusters, nodes, hot, placed):
        drop_stash(x)
    return links


def near_duplicates(docs: DataFrame, threshold: int = 75) -> DataFrame:
    """Group documents linked by 100 * |intersection| >= ``threshold`` * |union| of their 5-word shingle sets.

    ``docs`` needs ``doc_id`` and ``text``. Returns ``doc_id, n_shingles,
    component_id, kept`` for every row. Null, empty and blank texts have no
    shingles and stand alone; so does a row with a null id (its component is null
    and it is kept). Rows with the same id are one node, so all of them get the same component. A text of any length counts with all
    its shingles. An empty table gives an empty table.
    """
    small_batches(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed_docs = stash(base.mapInArrow(_signed_documents, "doc_id long, n_shingles long, key_a long, key_b long, bands array<long>"))
    named = signed_docs.where("doc_id is not null and n_shingles > 0")
    classes = stash(named.groupBy("key_a", "key_b").agg(F.min("doc_id").alias("node")))
    # joins of whole tables are merges at every size
    member = stash(named.hint("merge").join(classes, ["key_a", "key_b"]).select("doc_id", "node", F.when(F.col("doc_id") == F.col("node"), F.col("bands")).alias("bands"), "n_shingles"))
    # buckets of more than one node, and each node's place in them
    hits = member.where("bands is not null").select("node", "n_shingles", F.explode("bands").alias("bucket"))
    buckets = stash(hits.groupBy("bucket").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.count("*").alias("n")).where("least < most").select("bucket", "n"))
    tied = stash(hits.hint("merge").join(buckets, "bucket").groupBy("node", "bucket").agg(F.max("n_shingles").alias("n_shingles"), F.max("n").alias("n")))
    for x in (classes, buckets):
        drop_stash(x)
    # the texts that are compared
    texts = base.where("text is not null").withColumnRenamed("doc_id", "node")
    held = stash_bucketed(texts.hint("merge").join(tied.select("node").distinct(), "node"), "node", ordered=True, compression="zstd")
    # each node with the anchor of its buckets, and what is open then
    ranked = tied.join(tied.groupBy("node").agg(F.sum("n").alias("rank")), "node")
    best = ranked.groupBy("bucket").agg(F.max(F.struct("rank", (-F.col("node")).alias("least"))).alias("best"))
    offers = ranked.join(best, "bucket").where("node <> -best.least")
    pairs = stash(offers.groupBy("node").agg(F.max("best").alias("best"), F.max("n_shingles").alias("n_shingles")).select("node", (-F.col("best.least")).alias("anchor"), "n_shingles"))
    links = _star(held, pairs, threshold)
    groups = components(links)
    labelled = tied.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    differ = labelled.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most").select("bucket")
    open_ = stash(labelled.join(differ, "bucket").select("node", "bucket", "component", "n_shingles"))
    more = _full(held, open_, threshold)
    for x in (tied, pairs, groups, held, open_):
        drop_stash(x)
    groups = components(links.unionByName(more))
    for x in (links, more):
        drop_stash(x)
    # classes and their copies, then rows with the same id
    own = member.select("doc_id", "node").unionByName(member.select(F.col("node").alias("doc_id"), "node")).distinct()
    found = own.join(groups, "node", "left").select("doc_id", F.coalesce("component", "node").alias("component_id"))
    found = found.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    out = signed_docs.select("doc_id", "n_shingles").join(found, "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_copies(docs: DataFrame, threshold: int = 75) -> DataFrame:
    """The rows of ``docs``, with all their columns, of the document that each group keeps; of its rows with the same text, the first by their other columns.

    Nulls, empty and very long texts and empty tables count as ``near_duplicates`` says.
    """
    kept = near_duplicates(docs, threshold).where("kept").select(F.col("doc_id").alias("_id"))
    repeated = stash(kept.groupBy("_id").agg(F.count("*").alias("_n")))
    kept = repeated.select("_id")
    rows = docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept["_id"]), "left_semi")
    if repeated.where("_n > 1").isEmpty():
        return rows
    texts = rows.select(F.col("doc_id").cast("long").alias("_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("_sha"), F.col("text").isNull().alias("_null"))
    return one_of_each(rows, texts, {"_id": rows["doc_id"].cast("long"), "_sha": F.sha2(F.coalesce(rows["text"], F.lit("")), 256), "_null": rows["text"].isNull()})
