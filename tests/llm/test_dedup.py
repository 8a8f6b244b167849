import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomline.llm import common, exact, lines, near, substring
from tests.llm import cases


def test_substring(spark):
    base = "a b c d e f g h i j k l m n o p q r s t u v w x y z".split()
    passage = [f"p{i}" for i in range(60)]
    own = [(100, " ".join(base + passage)), (101, " ".join(passage + base)), (102, " ".join(passage[:49])), (103, " ".join(["q"] + passage[3:58] + ["q"])), (104, " ".join((["ab", "cd"] * 80) + base)), (105, " ".join((["cd", "ab"] * 60) + passage[::-1]))]
    data = cases.rows() + [(k, t, "en", "s", None, "x", "y", "z", 1, 0.5) for k, t in own] + [(200 + r[0], *r[1:]) for r in cases.sample()]
    df = spark.createDataFrame(data, cases.SCHEMA)
    first = {}
    for k, t, *_ in data:
        w = cases.words(t)
        for i in range(len(w) - 49 if k is not None else 0):
            g = tuple(w[i : i + 50])
            first[g] = min(k, first.get(g, k))
    want = Counter()
    for k, t, *_ in data:
        w = cases.words(t)
        gone = set()
        for i in range(len(w) - 49 if k is not None else 0):
            if first[tuple(w[i : i + 50])] < k:
                gone.update(range(i, i + 50))
        want[(k, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))] += 1
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring.substring_dedup(df).collect())
    assert got == want
    assert substring.substring_dedup(cases.empty(spark)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=40), min_size=1, max_size=4), st.integers(3, 12))
def test_equal_windows_pick_the_same_symbol(texts, width):
    known = common.WordHashes()
    flat, ends = common.hashed_words([" ".join(t).encode() for t in texts], known)
    levels = [substring.first_level(flat, ends)]
    for k in range(3):
        levels.append(substring.next_level(levels[-1], ends, k + 1))
    windows, level, symbol = substring.choose(levels, ends, width)
    words = [w for t in texts for w in t]
    assert len(windows) == sum(max(0, len(t) - width + 1) for t in texts)
    picks = defaultdict(set)
    for w, k, s in zip(windows, level, symbol):
        x = levels[k]
        assert w <= x.low[s] and x.high[s] <= w + width
        picks[tuple(words[w : w + width])].add((int(k), int(x.start[s] - w), int(x.end[s] - w), int(x.low[s] - w), int(x.high[s] - w)))
    assert all(len(p) == 1 for p in picks.values())


def test_exact(spark):
    got = exact.exact_dedup(cases.frame(spark)).collect()
    groups = defaultdict(list)
    for k, t, *_ in cases.rows():
        groups[cases.ascii_lower(t)].append(k)
    want = Counter()
    for text, ids in groups.items():
        top = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[(i, top, len(ids), i == top, hashlib.sha256(text.encode()).hexdigest())] += 1
    assert Counter(map(tuple, got)) == want
    assert exact.exact_dedup(cases.empty(spark)).count() == 0
    kept = exact.drop_exact_copies(cases.frame(spark))
    assert kept.columns == cases.frame(spark).columns and Counter(r.doc_id for r in kept.collect()) == Counter(top for top in {r.keep_id: 1 for r in got})
    assert exact.drop_exact_copies(cases.empty(spark)).collect() == []


def test_exact_tells_texts_apart_that_share_head_and_hash(spark, monkeypatch):
    monkeypatch.setattr(exact, "HEAD", 0)
    monkeypatch.setattr(exact, "HOT_ROWS", 2)
    monkeypatch.setattr(exact.F, "xxhash64", lambda *c: exact.F.lit(7).cast("long"))
    data = [(i, f"text {i % 5}") for i in range(40)] + [(None, "text 1"), (None, None)]
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact.exact_dedup(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {(i, 35 + i % 5, 8 + (i % 5 == 1), i >= 35) for i in range(40)} | {(None, 36, 9, False), (None, None, 1, True)}


def test_exact_spreads_many_copies(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'Rare ' || id, 'COPY') as text")
    got = exact.exact_dedup(df).where("not kept").agg({"keep_id": "max", "group_size": "min"}).first()
    assert tuple(got) == (2999, 2000) or set(got) == {2999, 2000}
    plan = exact.exact_dedup(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def brute_lines(data):
    split = [(k, (t or "").split("\n")) for k, t, *_ in data]
    key = lambda x: cases.ascii_lower(x.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for k, ls in split:
        if k is not None:
            for x in ls:
                if len(key(x)) >= 20:
                    held[key(x)].add(k)
    out = Counter()
    for k, ls in split:
        kept = [x for x in ls if k is None or len(held[key(x)]) < 3 or len(key(x)) < 20 or max(held[key(x)]) == k]
        out[(k, len(ls), len(ls) - len(kept), "\n".join(kept))] += 1
    return out


def test_lines(spark):
    data = cases.rows() + [(300 + r[0], *r[1:]) for r in cases.sample()]
    got = lines.line_dedup(spark.createDataFrame(data, cases.SCHEMA)).collect()
    assert Counter(map(tuple, got)) == brute_lines(data)
    assert lines.line_dedup(cases.empty(spark)).count() == 0


def test_line_store_reports_new_hashes_and_compacts(spark):
    store = lines.RunStore(spark, fan=2)
    batch = lambda *ids: spark.createDataFrame([(h, h, d) for h, d in ids], "h1 long, h2 long, doc_id long")
    new = [sorted(r.h1 for r in store.add(batch(*b)).collect()) for b in (((1, 9), (2, 9)), ((2, 8), (3, 8)), ((1, 7), (4, 7)))]
    assert new == [[1, 2], [3], [4]]
    assert len(store.again) == 2
    store.compact()
    assert [len(x) for x in store.levels] == [0, 1]
    assert sorted(map(tuple, store.table().collect())) == [(1, 1, 2, 9), (2, 2, 2, 9), (3, 3, 1, 8), (4, 4, 1, 7)]


def test_runs_are_joined_without_shuffle_or_sort(spark):
    store = lines.RunStore(spark, fan=9)
    for k in (3, 2):
        store.add(spark.range(200).selectExpr("id * 7919 as h1", "id * 31 as h2", f"{k}L as doc_id"))
    run, other = store.runs()
    plan = run.hint("merge").join(other.select(*lines.HASH), lines.HASH, "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan and other.count() == 0


def test_many_lost_lines_are_linear(spark):
    many = [f"line number {i} that stands in all documents" for i in range(20_000)]
    got = {r.doc_id: (r.n_lines, r.n_dropped, len(r.kept_text)) for r in lines.line_dedup(spark.createDataFrame([(i, "\n".join(many)) for i in range(3)], "doc_id long, text string")).collect()}
    assert got == {0: (20_000, 20_000, 0), 1: (20_000, 20_000, 0), 2: (20_000, 0, len("\n".join(many)))}


def brute_near(data):
    sets = {}
    for k, t, *_ in data:
        w = cases.words(cases.ascii_lower(t))
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in ids}


def test_near(spark):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    data = []
    for i in range(60):
        w = list(base)
        for j in rng.choice(len(w), int(rng.integers(0, 8)), replace=False):
            w[j] = f"x{i}_{j}"
        data.append((i, " ".join(w)))
    data += [(500 + r[0], r[1]) for r in cases.sample()]
    want = brute_near(data)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == want


@pytest.mark.parametrize("center", [True, False])
def test_near_copies_of_one_text_are_sent_a_few_times(spark, monkeypatch, center):
    """A family of near copies, with the text that they all come from or without it, and another that is like both but linked with neither."""
    rng = np.random.default_rng(5)
    n, base = 1500, [f"w{i}" for i in range(200)]
    data = [(n, " ".join(base))] if center else []
    for i in range(n):
        w = list(base)
        for j in rng.choice(len(w), 3 if center else 2, replace=False):
            w[j] = f"x{i}_{j}"
        data.append((i, " ".join(w)))
    other = [f"w{i}" if i < 150 else f"v{i}" for i in range(200)]
    data += [(5000 + i, " ".join([*other, f"end{i}"])) for i in range(20)]
    sent, write = [], near.stash

    def recorded(df, *args, **more):
        out = write(df, *args, **more)
        if {"is_anchor", "other"} & set(df.columns):
            sent.append(out.count())
        return out

    monkeypatch.setattr(near, "stash", recorded)
    got = {r.doc_id: r.component_id for r in near.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {k: 5000 if k >= 5000 else 0 for k, _ in data}
    assert sum(sent) <= 4 * len(data)


def test_shingles_that_share_leading_bits_are_told_apart(monkeypatch):
    values = iter([7, 7 + 1, 7] * 2)
    monkeypatch.setattr(near, "mixed", lambda x: x)
    monkeypatch.setattr(near, "hashed_words", lambda texts, known: (np.fromiter((next(values) for _ in range(3)), np.uint64, 3), np.array([0, 3])))
    monkeypatch.setattr(near, "SHINGLE", 1)
    value, begins = near.shingle_sets([b"a b a"], None)
    assert len(value) == 2 and list(begins) == [0, 2]


def test_near_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK_DOCS", 4)
    data = [(i, " ".join(f"w{j}" if j != i else "x" for j in range(100))) for i in range(40)]
    got = {r.doc_id: r.component_id for r in near.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {k: v[1] for k, v in brute_near(data).items()}


def test_near_takes_awkward_rows(spark):
    got = near.near_duplicates(cases.frame(spark)).collect()
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add((r.component_id, r.kept))
    assert len(got) == len(cases.rows())
    assert by[3] == {(3, True)} and by[4] == {(4, True)} and by[2] == {(1, False)} and by[7] == {(6, False)} and by[None] == {(None, True)} and by[10] == {(9, False)}
    assert near.near_duplicates(cases.empty(spark)).count() == 0
    kept = near.drop_near_copies(cases.frame(spark))
    assert kept.columns == cases.frame(spark).columns
    texts = {(k, t) for k, t, *_ in cases.rows() if (k, True) in {(r.doc_id, r.kept) for r in got}}
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(texts)
    assert near.drop_near_copies(cases.empty(spark)).collect() == []


def test_superminhash_estimates_similarity():
    known = common.WordHashes()
    a = [f"t{i}" for i in range(400)]
    b = a[:300] + [f"u{i}" for i in range(100)]
    value, begins = near.shingle_sets([" ".join(x).encode() for x in (a, b)], known)
    held = near.superminhash(value, begins, 512)
    n = len(set(value[: begins[1]].tolist()) & set(value[begins[1] :].tolist()))
    assert abs((held[0] == held[1]).mean() - n / (len(value) - n)) < 0.07


@pytest.mark.parametrize("sizes", [[3, 300, 40], [1, 0, 2]])
def test_early_stopping_changes_nothing(sizes):
    rng = np.random.default_rng(1)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    value = rng.integers(0, 2**63, begins[-1]).astype(np.uint64)
    held = near.superminhash(value, begins, 64)
    for i in range(len(sizes)):
        alone = near.superminhash(value[begins[i] : begins[i + 1]], np.array([0, sizes[i]]), 64)
        assert (alone[0] == held[i]).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (103, 101), (200, 200)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0
