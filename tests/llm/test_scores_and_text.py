import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from loomline.llm import bpe, mixing, pii, quality, rules, toxicity
from loomline.llm.queries import token_digests
from tests.llm import cases

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def test_bpe(spark, library):
    data = cases.rows() + cases.sample()[:40]
    df = spark.createDataFrame(data, cases.SCHEMA)
    out = bpe.decode(bpe.encode(df, RANKS, public_tokenizers.PATTERN), RANKS).collect()
    want = Counter((k, tuple(library.encode_ordinary(t or "")), (t or "").encode()) for k, t, *_ in data)
    assert Counter((r.doc_id, tuple(r.token_ids), bytes(r.decoded)) for r in out) == want
    assert bpe.encode(cases.empty(spark), RANKS, public_tokenizers.PATTERN).count() == 0
    assert bpe.PATTERN == public_tokenizers.PATTERN


def test_bpe_many_blocks_and_other_patterns(spark, library):
    df = spark.createDataFrame(cases.sample()[:30], cases.SCHEMA)
    want = {k: library.encode_ordinary(t) for k, t, *_ in cases.sample()[:30]}
    for pattern in (public_tokenizers.PATTERN, "(?:" + public_tokenizers.PATTERN + ")"):
        assert {r.doc_id: r.token_ids for r in bpe.encode(df, RANKS, pattern, block_bytes=2000).collect()} == want


def test_bpe_tells_words_apart_that_collide_in_polynomial_hashes(spark, library):
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    texts = [word, word.translate(str.maketrans("ab", "ba")), word[:15], word[:16], word[:15] + "\0", word[:7], word[:8], word[:7] + "\0"]
    got = {r.doc_id: (r.token_ids, bytes(r.decoded)) for r in bpe.decode(bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), RANKS, public_tokenizers.PATTERN), RANKS).collect()}
    assert got == {i: (library.encode_ordinary(t), t.encode()) for i, t in enumerate(texts)}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=20).map(lambda x: bytes(c % 2 for c in x)), min_size=1, max_size=30))
def test_keys_are_equal_when_bytes_are(words):
    size = np.array(list(map(len, words)))
    low, high = bpe.exact_keys(np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size, size, {})
    assert [[(a, b) == (c, d) for a, b in zip(low, high)] for c, d in zip(low, high)] == [[a == b for a in words] for b in words]


def test_pairs_that_share_a_hash_are_grouped_by_value(monkeypatch):
    low, high = np.array([3, 1, 3, 2, 1], np.uint64), np.array([0, 5, 0, 5, 6], np.uint64)
    for mixing_of in (bpe.mixed, lambda x: x & np.uint64(1)):
        monkeypatch.setattr(bpe, "mixed", mixing_of)
        first, group, count = bpe.group_keys(low, high)
        assert sorted(first) == [0, 1, 3, 4] and group[0] == group[2] and len(set(group)) == 4 and sorted(count) == [1, 1, 1, 2] and (first[group] == [0, 1, 0, 3, 4]).all()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab's rtvelld'  \n\t1٣.,!é中\x1c\x85\xa0 ͸"), max_size=25), min_size=1, max_size=3))
def test_cut_is_the_pattern(texts):
    import regex

    begins = np.cumsum([0, *map(len, texts)])
    starts = np.flatnonzero(bpe.cut(np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), begins)) if begins[-1] else []
    want = []
    for t, b in zip(texts, begins):
        want += [int(b)] if "͸" in t else [m.start() + int(b) for m in regex.finditer(public_tokenizers.PATTERN, t)]
    assert list(starts) == want


def test_token_digests(spark, library):
    text = "it's 5 o'clock  here"
    r = token_digests(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    ids = library.encode_ordinary(text)
    assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def brute_spans(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("a.@-+ 0123456789.1@b()%é"), max_size=60))
def test_plain_spans(text):
    assert pii.plain_spans(text) == brute_spans(text)
    base, found = pii.all_spans(text)
    assert base == brute_spans(text) and set(base) <= set(found)


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


@pytest.mark.parametrize(
    "text, kind, hidden",
    [
        ("write to jane.doe [at] mail (dot) example [dot] org today", "email", "jane.doe [at] mail (dot) example [dot] org"),
        ("write to jane at example dot org now", "email", "jane at example dot org"),
        ("ask bosbt.42 at mail8.example.com, please", "email", "bosbt.42 at mail8.example.com"),
        ("jаne@exаmple.org is it", "email", "jаne@exаmple.org"),
        ("call four one five five five five zero one two three please", "phone", "four one five five five five zero one two three"),
        ("call plus one four one five five five five zero one two three", "phone", "plus one four one five five five five zero one two three"),
        ("host 10 dot 0 dot 0 dot 7 is up", "ip", "10 dot 0 dot 0 dot 7"),
        ("４１１１ １１１１ １１１１ １１１１ card", "card", "４１１１ １１１１ １１１１ １１１１"),
        ("zero​width a​b@x​y.org", "email", "a​b@x​y.org"),
    ],
)
def test_disguises(text, kind, hidden):
    _, found = pii.all_spans(text)
    assert (text.index(hidden), pii.KINDS.index(kind), text.index(hidden) + len(hidden)) in found, found


@pytest.mark.parametrize(
    "text, kind, hidden",
    [
        ("write to jane.doe [at] example dot org now", "email", "jane.doe [at] example dot org"),
        ("write to jane@example dot org now", "email", "jane@example dot org"),
        ("write to jane at example (dot) org now", "email", "jane at example (dot) org"),
        ("write to jane dot doe [at] mail.example (dot) org now", "email", "jane dot doe [at] mail.example (dot) org"),
        ("Mail: joe [@] firm (.) com", "email", "joe [@] firm (.) com"),
        ("host 10[.]0[.]0[.]7 is up", "ip", "10[.]0[.]0[.]7"),
        ("host 10 dot 0 (dot) 0.7 is up", "ip", "10 dot 0 (dot) 0.7"),
    ],
)
def test_mixed_disguises(text, kind, hidden):
    _, found = pii.all_spans(text)
    assert (text.index(hidden), pii.KINDS.index(kind), text.index(hidden) + len(hidden)) in found, found


@pytest.mark.parametrize("text, hidden", [("to jоhn.smith@example.com now", "jоhn.smith@example.com"), ("to john@example.cоm now", "john@example.cоm"), ("to jo\u200bhn@example.com now", "jo\u200bhn@example.com")])
def test_disguises_around_plain_fragments(text, hidden):
    base, found = pii.all_spans(text)
    assert base and set(base) <= set(found) and (text.index(hidden), 0, text.index(hidden) + len(hidden)) in found, found


@pytest.mark.parametrize("text, kind, hidden", [("mike@corp[.]io", "email", "mike@corp[.]io"), ("mike[@]corp.io", "email", "mike[@]corp.io"), ("10[.]0[.]0[.]1", "ip", "10[.]0[.]0[.]1")])
def test_signs_in_brackets_alone(text, kind, hidden):
    for around in ("{}", "x {} y", "{} see that dot"):
        whole = around.format(text)
        assert (whole.index(hidden), pii.KINDS.index(kind), whole.index(hidden) + len(hidden)) in pii.all_spans(whole)[1]


@settings(max_examples=300, deadline=None)
@given(st.text("abc", min_size=1, max_size=30), st.lists(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 4), st.sampled_from(["", "X", "YZ"])), max_size=5), max_size=3))
def test_tape_maps_back(text, rounds):
    tape, want = pii.Tape(text), [(c, i, i + 1) for i, c in enumerate(text)]
    for edits in rounds:
        own, last = [], 0
        for a, n, put in sorted(edits):
            if a >= last and a + n <= len(tape.text):
                own.append((a, a + n, put))
                last = a + n
        tape.rewrite(own)
        for a, b, put in own[::-1]:
            want[a:b] = [(c, want[a][1], want[b - 1][2]) for c in put]
    assert tape.text == "".join(c for c, _, _ in want)
    assert [tape.source(i, i + 1) for i in range(len(want))] == [(s, e) for _, s, e in want]


def test_many_disguises_are_linear():
    import time

    took = []
    for n in (4_000, 16_000):
        began = time.perf_counter()
        _, found = pii.all_spans("joe [at] corp.io and four one five five five five zero one two three; " * n)
        took.append(time.perf_counter() - began)
        assert len(found) == 2 * n
    assert took[1] < 8 * took[0]


def test_plain_spans_are_not_found_twice():
    text = "a\u200b and john@example.com, 10.0.0.7, +1 415 555 0123"
    base, found = pii.all_spans(text)
    assert len(base) == 3 and found == base


def test_mixed_patterns_are_linear():
    for c in ("a@a dot ", "a [at] a dot ", "a at a (.) a", "[", "a dot "):
        pii.all_spans(c * 3_000)


def test_clean_text_has_no_spans():
    for text in ("He was at home. The dot on the map is one of two or three.", "un deux trois soleil", "version 1.2.3 of 2024-01-02", "meet at noon at the dot com office", "look at example.org or at home.Then go", "un un un un un un un un un un", "It was 42. Then at home.She slept"):
        assert pii.all_spans(text) == ([], [])


def test_very_long_runs_are_linear():
    for c in ("a", "1", "@", ".", "+1", "one ", " dot ", "1.", "a@a."):
        pii.all_spans(c * 200_000)


def test_personal_data_takes_awkward_rows(spark):
    got = pii.find_personal_data(cases.frame(spark)).collect()
    assert len(got) == len(cases.rows()) and pii.find_personal_data(cases.empty(spark)).count() == 0


def test_rules_base_counts(spark):
    data = cases.rows() + cases.sample()
    got = Counter(tuple(r)[:7] for r in rules.quality_rules(spark.createDataFrame(data, cases.SCHEMA)).collect())
    want = Counter()
    for k, t, *_ in data:
        w = cases.words(t)
        at = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        seen = {j for i in range(len(w) - 4) if at[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        ls = [x for x in (t or "").split("\n") if cases.words(x)]
        symbols = len(re.findall(r"[#*$%&|<>]", t or ""))
        want[(k, len(w), sum(map(len, w)), symbols, len(ls) - len(set(ls)), len(seen), len(w) < 10 or 100 * len(seen) > 20 * len(w))] += 1
    assert got == want
    assert rules.quality_rules(cases.empty(spark)).count() == 0


def test_rules_find_outliers(spark):
    data = [(i, " ".join(f"word{j}" for j in range(50)), "en", "s") for i in range(200)] + [(999, " ".join(f"w###{j}" for j in range(50)), "en", "s")]
    got = {r.doc_id: r.kept for r in rules.quality_rules(spark.createDataFrame(data, "doc_id long, text string, lang string, source string")).collect()}
    assert not got.pop(999) and all(got.values())


def test_sketch_bins(spark):
    x = spark.range(0, 5000).withColumn("b", rules.sketch_bin(rules.F.col("id"))).withColumn("low", rules.bin_floor(rules.F.col("b")))
    for r in x.collect():
        assert r.low <= r.id and (r.id - r.low) * 32 <= max(r.id, 1) and (r.id >= 64 or r.low == r.id)


def test_mixing(spark):
    data = [(i, "w " * (i % 40), f"s{i % 7}" if i % 7 else None) for i in range(700)] + [(5000 + i, "w " * 30, "tiny") for i in range(3)] + [(6000, None, "none"), (None, "a b", "s1")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    assert len(got) == len(data)
    total = sum(r.size for r in got)
    goals = {r.source: (r.source_size, r.target) for r in got}
    assert sum(t for _, t in goals.values()) == pytest.approx(total) and all(t <= 3 * s + 1e-6 for s, t in goals.values())
    for source, (_, target) in goals.items():
        assert abs(sum(r.taken for r in got if r.source == source) - target) <= 40
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix(df.repartition(3)).collect()))
    drawn = Counter(r.doc_id for r in mixing.draw(df).collect())
    assert drawn == Counter({r.doc_id: r.repeats for r in got if r.repeats})
    assert mixing.mix(cases.empty(spark)).count() == 0 and mixing.mix(cases.frame(spark)).count() == len(cases.rows())
    assert mixing.draw(cases.frame(spark)).columns == cases.frame(spark).columns


def water(sizes, weights):
    total, done = sum(sizes), {}
    while True:
        rest = [i for i in range(len(sizes)) if i not in done]
        level = (total - sum(done.values())) / max(1, sum(weights[i] for i in rest))
        over = [i for i in rest if level * weights[i] > 3 * sizes[i]]
        if not over:
            return [done.get(i, level * weights[i]) for i in range(len(sizes))]
        done |= {i: 3 * sizes[i] for i in over}


def test_targets_are_the_water_level(spark):
    for sizes in ([10, 1000, 50, 3, 700], [1, 1, 1], [5], [0, 8, 100000, 7, 7, 7, 90]):
        weights = [i % 3 + 1 for i in range(len(sizes))]
        df = spark.createDataFrame([(f"s{i}", n, w) for i, (n, w) in enumerate(zip(sizes, weights))], "source string, source_size long, weight long")
        got = {r.source: r.target for r in mixing.targets(df).collect()}
        assert [got[f"s{i}"] for i in range(len(sizes))] == pytest.approx(water(sizes, weights))


def tables(spark, sf="sf0.01"):
    return spark.read.parquet(f"/root/testdata/{sf}/documents.parquet"), spark.read.parquet(f"/root/testdata/{sf}/labels.parquet")


def held_out_accuracy(df, labels, column, bucket):
    rows = df.join(labels, "doc_id").where("held_out").collect()
    assert rows and all((zlib.crc32(str(r.doc_id).encode()) % bucket[0]) == bucket[1] for r in rows)
    return np.mean([r.predicted == r[column] for r in rows])


def test_quality(spark):
    docs, labels = tables(spark)
    out = quality.quality_scores(docs, labels)
    assert held_out_accuracy(out, labels, "quality", (4, 2)) >= 0.95
    assert out.where("score < 0 or score > 1 or score is null").count() == 0
    assert quality.quality_scores(cases.frame(spark), cases.labels(spark, 12)).count() == len(cases.rows())
    assert quality.quality_scores(cases.frame(spark), cases.labels(spark)).count() == len(cases.rows())
    assert quality.quality_scores(cases.empty(spark), labels).count() == 0


def test_quality_is_the_dense_solution(spark):
    """Statistics, standardisation, normal equations and calibration of all labelled rows, on one machine."""
    docs, labels = tables(spark, "sf0.001")
    model = quality.fit(docs.select(quality.F.col("doc_id"), "text").mapInArrow(quality._scan, "doc_id long, stats array<float>"), labels)
    y = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None}
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect() if r.doc_id in y]
    fold = np.array([zlib.crc32(str(k).encode()) % 4 for k, _ in rows])
    x = quality.statistics([t for _, t in rows], quality.WordHashes()).astype(np.float32).astype(float)
    target = np.array([float(y[k]) for k, _ in rows])
    own = (fold == 0) | (fold == 1)
    mean, scale = x[own].mean(0), x[own].std(0) + 1e-3
    assert model.mean == pytest.approx(mean, abs=1e-5) and model.scale == pytest.approx(scale, abs=1e-4)
    rng = np.random.default_rng(quality.SEED)
    w, b = rng.normal(0, 1 / quality.SIGMA, (quality.N_STATS, quality.FEATURES)), rng.uniform(0, 2 * np.pi, quality.FEATURES)
    z = np.hstack([np.sqrt(2 / quality.FEATURES) * np.cos(np.clip((x - mean) / scale, -8, 8) @ w + b), np.ones((len(x), 1))])
    weights = np.linalg.solve(z[own].T @ z[own] + quality.RIDGE * own.sum() * np.eye(quality.FEATURES + 1), z[own].T @ target[own])
    raw = np.clip(z @ weights, -0.5, 1.5)
    assert model.raw(x) == pytest.approx(raw, abs=2e-3)
    scores = {r.doc_id: r.score for r in quality.quality_scores(docs, labels).collect()}
    assert [scores[k] for k, _ in rows] == pytest.approx(list(model.score(x)), abs=1e-6)


def test_isotonic():
    x, y = quality.isotonic(np.arange(6.0), np.array([0, 1, 0, 0, 1, 1.0]), np.ones(6))
    assert (np.diff(y) > 0).all() and y[0] == 0 and y[-1] == 1


def test_toxicity(spark):
    docs, labels = tables(spark, "sf0.1")
    out = toxicity.toxicity_scores(docs, labels).cache()
    rows = out.join(labels, "doc_id").where("held_out").collect()
    toxic, clean = ([r.predicted for r in rows if r.toxic == k] for k in (1, 0))
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows) and len(toxic) > 50
    assert np.mean(toxic) >= 0.85 and np.mean(clean) <= 0.03  # a constant fails one of the two
    assert out.where("score < 0 or score > 1 or score is null").count() == 0
    out.unpersist()
    assert toxicity.toxicity_scores(cases.frame(spark), cases.labels(spark)).count() == len(cases.rows())
    assert toxicity.toxicity_scores(cases.empty(spark), labels).count() == 0
    for kept in (toxicity.drop_toxic(cases.frame(spark), cases.labels(spark, 12)), toxicity.drop_toxic(cases.empty(spark), cases.labels(spark, 12))):
        assert kept.columns == cases.frame(spark).columns
    scores = Counter((r.doc_id, r.predicted) for r in toxicity.toxicity_scores(cases.frame(spark), cases.labels(spark, 12)).collect())
    assert Counter(r.doc_id for r in toxicity.drop_toxic(cases.frame(spark), cases.labels(spark, 12)).collect()) == Counter({k: n for (k, p), n in scores.items() if not p})


def test_training_rows_filter_before_they_are_picked(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE", 5)
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 10)
    docs = spark.createDataFrame([(i, "long text " * (i % 2) + "x") for i in range(100)] * 3 + [(2, "a"), (None, "n")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i > 50)) for i in range(100)] + [(4, 1), (None, 1)], "doc_id long, toxic int")
    rows = toxicity.training_rows(docs, labels).collect()
    assert Counter(r.toxic for r in rows) == {0: 5, 1: 5} and len({r.doc_id for r in rows}) == 10
    assert all(r.doc_id % 2 == 0 and r.doc_id != 4 and zlib.crc32(str(r.doc_id).encode()) % 5 for r in rows)
    assert {round(r.weight * 5) for r in rows if r.toxic} == {sum(1 for i in range(52, 100, 2) if zlib.crc32(str(i).encode()) % 5)}


def brute_score(net, text):
    """The network word by word, in plain loops."""
    sig = lambda v: 1 / (1 + np.exp(-v))
    vocabulary = toxicity.Vocabulary()
    numbers = vocabulary.numbers(text)
    if len(vocabulary.number):
        rows, grams, begins = vocabulary.inputs()
        vectors = [net.p["word"][rows[i]] + (net.p["gram"][grams[begins[i] : begins[i + 1]]].mean(0) if begins[i + 1] > begins[i] else 0) for i in range(len(rows))]
    best = -np.inf
    for s in toxicity.windows_of(len(numbers)):
        states = {}
        for d in "fb":
            h, held = np.zeros(toxicity.HIDDEN), []
            own = [vectors[n] for n in numbers[s : s + toxicity.WIDTH]]
            for x in own if d == "f" else own[::-1]:
                z, r, new = np.split(x @ net.p["w" + d] + net.p["c" + d], 3)
                uz, ur, un = np.split(h @ net.p["u" + d], 3)
                z, r = sig(z + uz), sig(r + ur)
                h = z * h + (1 - z) * np.tanh(new + r * un)
                held.append(h)
            states[d] = held if d == "f" else held[::-1]
        both = [np.concatenate(x) for x in zip(states["f"], states["b"])]
        weight = np.exp([x @ net.p["a"] for x in both])
        pooled = sum(w * x for w, x in zip(weight / weight.sum(), both)) if both else np.zeros(2 * toxicity.HIDDEN)
        best = max(best, pooled @ net.p["out"] + net.p["bias"][0])
    return sig(net.scale[0] * best + net.scale[1])


def test_scores_are_the_plain_network():
    docs = [(t or "").encode() for _, t, *_ in cases.sample()[:60]] + [b"", b"one", b"w " * 200]
    net = toxicity.train(docs, np.arange(len(docs)) % 2)
    assert net.score(docs) == pytest.approx([brute_score(net, t) for t in docs], abs=1e-3)


def test_gradients_match_differences():
    net = toxicity.Network()
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (toxicity.WIDTH, 3, toxicity.DIM)).astype(np.float32)
    mask = np.arange(toxicity.WIDTH)[:, None] < np.array([[5, toxicity.WIDTH, 1]])
    y = np.array([1.0, 0.0, 1.0], np.float32)
    g, dx = net.gradients(x, mask, y)

    def loss():
        p = toxicity._sigmoid(net.forward(net.gates(x, "f"), net.gates(x, "b"), mask).astype(np.float64))
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for name in ("uf", "ub", "wf", "wb", "a", "out", "cf"):
        p = net.p[name]
        at = np.unravel_index(int(np.abs(g[name]).argmax()), p.shape)
        held = p[at]
        p[at] = held + 1e-2
        high = loss()
        p[at] = held - 1e-2
        low = loss()
        p[at] = held
        assert (high - low) / 2e-2 == pytest.approx(float(g[name][at]), rel=0.05, abs=1e-4), name
    assert dx.shape == x.shape


def test_windows_cover_the_text():
    for n in (0, 1, toxicity.WIDTH, toxicity.WIDTH + 1, 500):
        s = toxicity.windows_of(n)
        assert s[0] == 0 and (np.diff(s) < toxicity.WIDTH).all() and (n <= toxicity.WIDTH or s[-1] == n - toxicity.WIDTH)
