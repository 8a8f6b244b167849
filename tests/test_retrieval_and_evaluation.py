from pyspark.sql import functions as F

from loomline.operators import evaluation, retrieval


def test_cosine_top(spark):
    rows = [("d", "a", [1.0, 0.0]), ("d", "b", [1.0, 1.0]), ("d", "c", [0.0, 1.0]), ("d", "n", None), ("d", "z", [0.0, 0.0]), ("e", "o", [1.0, 0.0])]
    x = spark.createDataFrame(rows, "doc_id string, id string, embedding array<float>")
    top = retrieval.top_k(x, [1.0, 0.0], 2, ["id"], "d")
    assert [(r.id, round(r.score, 4)) for r in top.collect()] == [("a", 1.0), ("b", 0.7071)]
    assert "TakeOrderedAndProject" in top._jdf.queryExecution().executedPlan().toString()


def test_citations_fall_back(spark):
    pool = spark.createDataFrame([("d", str(i), i) for i in range(1, 8)], "doc_id string, id string, place int")
    used = lambda *ids: F.array(*map(F.lit, ids)).cast("array<string>")
    assert [r.id for r in retrieval.cited(pool, used("7", "x")).collect()] == ["7"]
    assert [r.id for r in retrieval.cited(pool, used()).orderBy("place").collect()] == list("12345")


def test_refusals(spark):
    hits = spark.createDataFrame([("d", 4), ("d", 9)], "doc_id string, page_start int")
    ask = lambda a, b: retrieval.final_answer(hits, spark.createDataFrame([("d", a, b)], "doc_id string, first string, second string")).first().answer
    assert ask("BEFORE", None) == "BEFORE"
    assert ask("The text is INSUFFICIENT", "AFTER") == "AFTER"
    made = ask("unable to determine", "not enough")
    assert "p. 4" in made and "p. 9" in made


def order(spark, *names):
    return spark.createDataFrame([("d", i, n) for i, n in enumerate(names)], "doc_id string, pos int, event_name string")


def measure(spark, system, gold):
    s, g = order(spark, *system), order(spark, *gold)
    return evaluation.pairwise_accuracy(s, g).first().pairwise_accuracy, evaluation.kendall_tau(s, g).first().kendall_tau


def test_order_measures(spark):
    assert measure(spark, "acbe", "abcd") == (0.6667, 0.3333)
    assert measure(spark, "a", "ab") == (None, None)
    assert measure(spark, "abcd", "abcd") == (1.0, 1.0)
    assert measure(spark, "dcba", "abcd") == (0.0, -1.0)


def test_summary(spark):
    rows = [("d", "major", 2, [2, 3, 5]), ("d", "minor", 2, []), ("d", "minor", 2, [9, 10])]
    events = spark.createDataFrame(rows, "doc_id string, category string, merge_count int, source_pages array<int>")
    docs = spark.createDataFrame([("d",), ("empty",)], "doc_id string")
    got = {r.doc_id: r for r in evaluation.summary(docs, events).collect()}
    d = got["d"]
    assert (d.events_total, d.raw_events, d.duplicate_rate, d.page_traceability, d.avg_pages_per_event) == (3, 6, 0.5, 0.6667, 1.67)
    assert got["empty"].events_total == 0 and got["empty"].duplicate_rate == 0.0
