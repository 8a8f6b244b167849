from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from loomline.operators import chronology, merge
from loomline.schemas import TABLES


def instructions(spark, rows, doc="d"):
    data = [(doc, 0, i, dup, matched, "major", (name, "At Sea", "", chars, "", cause, effect, pages)) for i, (dup, matched, name, pages, chars, cause, effect) in enumerate(rows)]
    return spark.createDataFrame(data, TABLES["instructions"])


FIXTURE = [
    (False, "", "A", [3, 0, 2], ["X", "X"], "c1", "e1"), (True, "A", "A2", [5], ["Y", "X"], "c1", "e2"), (True, "Z", "B", [], [], "", ""),
    (True, "B", "Q", [], [], "k |", ""), (False, "", "A", [9], [], "", ""), (True, "A", "R", [9, 10], [], "", ""),
]


def test_fixture(spark):
    x = instructions(spark, FIXTURE)
    for fold in (merge.fold, merge.fold_arrow):
        got = [(r.event_name, r.source_pages, r.characters, r.antecedent_cause, r.consequent_effect, r.merge_count) for r in fold(x).orderBy("seq").collect()]
        assert got == [("A", [2, 3, 5], ["X", "X", "Y"], "c1", "e1 | e2", 2), ("B", [], [], "k", "", 2), ("A", [9, 10], [], "", "", 2)]
    s = merge.stats(x, merge.fold(x)).first()
    assert (s.added, s.merged, s.failed) == (3, 3, 0)


row = st.tuples(st.booleans(), st.sampled_from(["", "A", "B", "C"]), st.sampled_from("ABC"), st.lists(st.integers(0, 4), max_size=3), st.lists(st.sampled_from("XYZ"), max_size=3), st.sampled_from(["", "c", "cc", "d|"]), st.sampled_from(["", "e", " e"]))


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(row, min_size=1, max_size=10))
def test_both_folds_agree(spark, rows):
    x = instructions(spark, rows)
    assert sorted(map(tuple, merge.fold(x).select(sorted(merge.FIELDS)).collect()), key=str) == sorted(map(tuple, merge.fold_arrow(x).select(sorted(merge.FIELDS)).collect()), key=str)


def test_chronology_frames_and_orders(spark):
    rows = [("d", 0, "Epilogue at sea", "At Sea", [4, 2, 2], ""), ("d", 1, "Fight", "fight", None, None), ("d", 2, "Fight", "fight", [], "")]
    events = spark.createDataFrame(rows, "doc_id string, seq int, event_name string, timeline_anchor string, source_pages array<int>, core_event string")
    tax = spark.createDataFrame([("d", [(n, "", n == "Return Home") for n in ("Shore / Setup", "At Sea", "The Fight", "Night", "Return Home")])], "doc_id string, taxonomy array<struct<name:string,description:string,is_framing:boolean>>")
    got = chronology.chronology(events, tax).orderBy("rank").collect()
    assert [(r.seq, r.stage_order, r.first_page, r.timeline_anchor) for r in got] == [(1, 2, 0, "fight"), (2, 2, 0, "fight"), (0, 4, 2, "Return Home")]
    assert got[2].source_pages == [2, 4]
