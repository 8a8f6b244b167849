"""Queries over whole texts, against plain Python on a small table."""

import hashlib

import pytest

from loomline.conf import EngineConf
from loomline.functions import models
from loomline.plans.bindings import QUERIES

FILL = " ".join(["so it is as it was"] * 30)
TEXTS = [
    f"{FILL} {FILL} storm broke harbour wall",
    f"{FILL} harbour after storm came {FILL} {FILL}",
    f"{FILL} {FILL} quiet night {FILL} many years later",
    "storm",
    "",
    f"harbour {FILL} {FILL} {FILL} harbour",
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("whole")
    rows = [(i + 1, t, "en", f"s{i // 6}", len(t)) for i, t in enumerate(TEXTS * 2)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    return str(at)


def halves(text):
    words = text.split(" ")
    half = -(-len(words) // 2)
    return [{w for w in part if len(w) > 4} for part in (words[:half], words[half:])]


def test_causal_pairs_of_whole_texts(spark, folder):
    want = set()
    for s in (0, 6):
        for i, a in enumerate(TEXTS):
            for j, b in enumerate(TEXTS):
                effect, cause = halves(a)[1], halves(b)[0]
                if i != j and effect and cause and len(effect & cause) / min(len(effect), len(cause)) >= 0.5:
                    want.add((f"s{s // 6}", str(s + i + 1), str(s + j + 1)))
    got = {(r.doc_id, r.src, r.dst) for r in QUERIES["g2_causal_pairs"](spark, folder).collect()}
    assert ("s0", "1", "2") in want and got == want
    rank = {(r.doc_id, r.id): r.rank for r in QUERIES["e6_e10_story_order"](spark, folder).collect()}
    edges = {(r.doc_id, r.src, r.dst) for r in QUERIES["g3_g6_dag_edges"](spark, folder).collect()}
    assert {(d, a, b) for d, a, b in want if rank[d, a] < rank[d, b]} <= edges


def test_hints_of_whole_texts(spark, folder):
    order = {r.id: r.timeline_anchor for r in QUERIES["e6_e10_story_order"](spark, folder).collect()}
    assert {k for k, v in order.items() if v != "en"} == {"3", "9"}


def test_long_pages_and_conversations(spark, tmp_path):
    long = "word " * 5000 + "end"
    spark.createDataFrame([(1, long)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(1, 0, long), (1, 1, "last")], "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    assert QUERIES["t5_sanitize_whole"](spark, str(tmp_path)).first().clean_md5 == md5(long)
    assert QUERIES["t7_digest_whole"](spark, str(tmp_path)).first().digest_md5 == md5(f"--- pages 1-1 ---\n{long}\n\n--- pages 2-2 ---\nlast")


def test_cut_prompts_are_reported(spark):
    asked = spark.createDataFrame([("a", "s", "x" * 14000), ("b", "s", "x" * 14001)], "id string, system string, user string")
    told = lambda **how: {r.id: r.truncated for r in models.chat(asked, lambda: models.OfflineClient(4), "system", "user", **how).collect()}
    assert told() == {"a": False, "b": True}
    assert told(ladder=EngineConf(prompt_chars=(20000,)).prompt_chars) == {"a": False, "b": False}
