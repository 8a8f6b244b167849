"""Causal edges by blocks, and the graph's queries without a shuffle of edges."""

import random

import pytest

from loomline.operators import graph, overlap
from loomline.plans.bindings import QUERIES


def stories(spark, n, seed):
    r = random.Random(seed)
    words = [f"token{i}" for i in range(60)] + ["a", "is"]
    text = lambda: " ".join(min(r.choice(words), r.choice(words)) for _ in range(r.choice((0, 1, 2, 5, 20, 60))))
    rows = [(f"d{i % 2}", str(i), i // 2 + 1, text(), text()) for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id string, id string, rank int, consequent_effect string, antecedent_cause string")


@pytest.mark.parametrize("block", [300, 1 << 20])
def test_blocks_lose_no_pair(spark, monkeypatch, block):
    monkeypatch.setattr(overlap, "BLOCK_CHARS", block)
    rows, events = stories(spark, 80, block)
    sets = [(d, i, k, {w for w in e.split() if len(w) > 4}, {w for w in c.split() if len(w) > 4}) for d, i, k, e, c in rows]
    want = {(d, i, j, a, b) for d, i, a, e, _ in sets for f, j, b, _, c in sets if d == f and i != j and e and c and len(e & c) / min(len(e), len(c)) >= 0.5}
    got = [(r.doc_id, r.src, r.dst, r.src_rank, r.dst_rank) for r in graph.causal(events).collect()]
    assert len(want) > 100 and sorted(got) == sorted(want)


def test_pairs_are_not_shuffled(spark):
    plan = QUERIES["g2_causal_pairs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    above, found, _ = plan.partition("MapInArrow")
    assert found and "Exchange" not in above


@pytest.mark.parametrize("name", ["s17_g11_stored_edges", "s18_graph_read", "g3_g6_dag_edges", "g8_reachable", "x7_build_summary", "g7_repair_stats", "g9_neighbours"])
def test_edges_are_not_combined_by_a_shuffle(spark, monkeypatch, name):
    def combine(edges):
        raise AssertionError("all edges of all documents would move")

    monkeypatch.setattr(graph, "combine", combine)
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_packed_links_tell_what_edges_tell(spark):
    _, events = stories(spark, 80, 7)
    x = events.withColumn("stage_order", events.rank * 0)
    edges = graph.build(x).cache()
    pairs = spark.createDataFrame([(f"d{i % 2}", str(i), str(i // 3 * 2 + i % 2)) for i in range(0, 80)] + [("d0", "0", "nobody")], "doc_id string, src string, dst string")
    key = lambda r: (r.doc_id, r.src, r.dst, r.relation, r.hops)
    for most in (2, 80):
        want = sorted(set(map(key, graph.reachable(edges, pairs, most).collect())))
        assert sorted(set(map(key, graph.hops(graph.causal_links(events), x, pairs, most).collect()))) == want
    seeds = events.where("id in ('10', '31')").select("doc_id", "id")
    near = lambda df: sorted((r.doc_id, r.id) for r in df.collect())
    assert near(graph.around(graph.causal_links(events), x, seeds, 2)) == near(graph.neighbours(edges, seeds, 2))
    candidates = graph.chain(x).unionByName(graph.causal(events))
    assert graph.ordered_stats(candidates, x).exceptAll(graph.repair_stats(candidates, graph.combine(candidates), x)).count() == 0
