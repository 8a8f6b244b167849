import json

import pytest

from loomline.conf import EngineConf
from loomline.functions import models
from loomline.operators import merge
from loomline.plans.engine import Engine
from loomline.streaming import merging
from tests.test_merge import FIXTURE, instructions


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("engine")
    (at / "in").mkdir()
    pages = [f"Anna met number {i} at the harbour wall. The storm broke over Peter. Then they slept until morning." for i in range(1, 25)]
    (at / "in" / "my_book.txt").write_text("\f".join(pages))
    (at / "in" / "blank.txt").write_text("  \n ")
    engine = Engine(spark, EngineConf(root=str(at / "db")))
    docs = engine.ingest(str(at / "in")).collect()
    return engine, docs, at


def test_ingest_rejects_blank_files(built):
    _, docs, _ = built
    assert [(d.title, d.page_count) for d in docs] == [("My Book", 24)]


def test_build_ask_and_measure(built):
    engine, docs, _ = built
    doc = docs[0].id
    engine.build(doc, "naive")
    job = engine.jobs.get(engine.build(doc, "timeline")).first()
    assert job.status == "done" and job.finished_at is not None and json.loads(job.detail)["edges"]["is_dag"]
    events = engine.events(doc).collect()
    assert events and [(e.stage_order, e.first_page, e.event_name) for e in events] == sorted((e.stage_order, e.first_page, e.event_name) for e in events)
    both = engine.compare(doc, "Did Anna sleep before the storm?")
    assert both["naive"]["answer"] and both["timeline"]["answer"] and len(both["timeline"]["citations"]) == 3
    m = engine.metrics(doc)
    assert m["runs"] == 1 and m["events_total"] == len(events) and m["pairwise_accuracy"] is None
    gold = engine.spark.createDataFrame([(doc, i, e.event_name) for i, e in enumerate(events)], "doc_id string, pos int, event_name string")
    assert engine.metrics(doc, gold)["pairwise_accuracy"] is not None
    listed = engine.documents().first()
    assert listed.naive_ready and listed.timeline_ready
    before = engine._skimmed().count()
    assert engine.observe(engine.ids(doc)).count() == 1  # nothing is skimmed twice
    assert engine._skimmed().count() == before
    nodes, edges = engine.graph(doc)
    assert nodes.count() == len(events) and edges.count() >= len(events) - 1


def test_reupload_changes_the_title_only(built):
    engine, docs, _ = built
    spark = engine.spark
    new = spark.createDataFrame([(docs[0].id, "Other", "x.txt", 1)], "id string, title string, filename string, page_count int")
    engine.store.put_documents(new)
    got = engine.store.read("documents").collect()
    assert [(d.title, d.page_count) for d in got] == [("Other", 24)]


def test_builds_of_many_documents_equal_single_ones(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"book_{k}.txt").write_text("\f".join(f"There Anna{k} met number {i} at the wall. Then {k} ships left." for i in range(1, 13 + 9 * k)))
    one, all_ = (Engine(spark, EngineConf(root=str(tmp_path / x), buckets=2)) for x in ("one", "all"))
    docs = [d.id for e in (one, all_) for d in e.ingest(str(tmp_path / "in")).collect()]
    assert len(set(docs)) == 3
    for kind in ("naive", "timeline"):
        for d in sorted(set(docs)):
            one.build(d, kind)
        jobs = all_.build_all(all_.ids(*set(docs), "nobody"), kind).collect()
        assert {j.doc_id for j in jobs} == set(docs)
        states = {s.doc_id: s for s in (all_.jobs.get(j.job_id).first() for j in jobs)}
        assert {s.status for s in states.values()} == {"done"}
        for d in set(docs):
            assert json.loads(states[d].detail) == json.loads(one.jobs.latest(d).where(f"kind = '{kind}'").first().detail)
    for t in ("chunks", "observations", "instructions", "events", "edges", "appears_in"):
        assert sorted(map(str, one.store.read(t).collect())) == sorted(map(str, all_.store.read(t).collect())) != []


def test_replaced_rows_are_visible_when_their_heads_are(spark, tmp_path):
    store = Engine(spark, EngineConf(root=str(tmp_path), buckets=3, job_updates=3)).store
    rows = lambda *x: spark.createDataFrame(x, "doc_id string, page_no int, content string")
    held = lambda **how: sorted(map(tuple, store.read("pages", **how).collect()))
    store._put_rows("pages", rows(("z", 1, "lost")), 7)  # a write that did not get to its heads
    assert held() == []
    store.replace("pages", rows(("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")))
    store.replace("pages", rows(("a", 1, "new")))
    store._put_rows("pages", rows(("b", 1, "lost")), store._next_version())
    assert held() == [("a", 1, "new"), ("b", 1, "z")] and held(doc_ids="a") == [("a", 1, "new")]
    store.compact("pages")
    assert held() == [("a", 1, "new"), ("b", 1, "z")]
    store.replace("pages", rows(), spark.createDataFrame([("b",)], "doc_id string"))
    assert held() == [("a", 1, "new")] and held(doc_ids=spark.createDataFrame([("b",), ("b",)], "doc_id string")) == []


def test_job_log_is_compacted(spark, tmp_path):
    engine = Engine(spark, EngineConf(root=str(tmp_path), job_updates=3))
    job = engine.jobs.create("d", "naive")
    for i in range(6):
        engine.jobs.update(job, progress=i / 10)
    assert engine.store._generations("job_events")[-1] == 2
    state = engine.jobs.get(job).first()
    assert state.status == "queued" and round(state.progress, 3) == 0.5


def test_unknown_documents_and_kinds(built):
    engine, docs, _ = built
    with pytest.raises(LookupError):
        engine.pages("nobody")
    with pytest.raises(ValueError):
        engine.build(docs[0].id, "other")


def test_delete_keeps_jobs(built):
    engine, docs, _ = built
    engine.delete(docs[0].id)
    assert engine.documents().count() == 0 and engine.store.read("events").count() == 0 and engine.store.read("query_runs").count() == 0
    assert engine.jobs.latest(docs[0].id).count() == 2


class Stubborn:
    def __init__(self, failures):
        self.failures, self.seen = failures, []

    def chat(self, system, user, temperature, max_tokens):
        self.seen.append(len(user))
        if len(self.seen) <= self.failures:
            raise models.FilteredError("content_filter")
        return " fine ", 3, 1


def test_attempts_send_less():
    client = Stubborn(2)
    got = models.ask(client, "s", "x" * 20000, 0.1, 100, sleep=lambda _: None)
    assert got["reply"] == "fine" and [n - len(models.PREFIX) for n in client.seen] == [14000, 4500, 2000]
    lost = models.ask(Stubborn(9), "s", "x", 0.1, 100, sleep=lambda _: None)
    assert lost["reply"] is None and lost["filtered"]


def test_stream_equals_batch(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    whole = instructions(spark, FIXTURE)
    for number, rows in enumerate((FIXTURE[:3], FIXTURE[3:])):
        x = instructions(spark, rows).selectExpr("doc_id", f"{number} as batch", *whole.columns[2:])
        x.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(whole.schema).parquet(source)
        merging.start(stream, out, str(tmp_path / "state")).awaitTermination(120)
    changes = spark.read.parquet(out)
    latest = changes.selectExpr("doc_id", "seq", "struct(micro, event_name, merge_count, consequent_effect) as v").groupBy("doc_id", "seq").agg({"v": "max"}).toDF("doc_id", "seq", "v")
    got = sorted((r.seq, r.v.event_name, r.v.merge_count, r.v.consequent_effect) for r in latest.collect())
    assert got == sorted((r.seq, r.event_name, r.merge_count, r.consequent_effect) for r in merge.fold(whole).collect())
