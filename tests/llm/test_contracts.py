"""The registered queries over the smallest tables, and their SQL."""

import glob
import hashlib
import os
from collections import Counter

import duckdb
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from loomline.llm import bpe, exact, mixing, pii, toxicity
from loomline.llm.queries import ORACLES, QUERIES
from tests.llm import cases
from tests.llm.test_dedup import brute_near
from tests.llm.test_scores_and_text import brute_spans, water
from tests.test_queries import rows

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": ["doc_id", "n_words", "n_removed", "kept_sha256"], "op2": ["doc_id", "held_out", "score", "predicted"], "op3": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op4": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"], "op5": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"], "op6": ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
    "op7": ["doc_id", "size", "source_size", "target", "taken"], "op8": ["doc_id", "n_shingles", "component_id", "kept"], "op9": ["doc_id", "held_out", "score", "predicted"], "op10": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_contract(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns == COLUMNS[name.split("_")[0]]
    data = [tuple(r) for r in df.collect()]
    assert len(data) == spark.read.parquet(f"{SF}/documents.parquet").count()
    if name in ORACLES:
        con = duckdb.connect()
        for p in glob.glob(f"{SF}/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
        want = con.execute(ORACLES[name])
        columns = [c[0] for c in want.description]
        assert sorted(columns) == sorted(df.columns) and rows(df.columns, data) == rows(columns, want.fetchall())


def test_pipeline_by_hand(spark, tmp_path):
    """Each stage against a plain version of it, on what its predecessor kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "byte_bpe":
            assert docs.columns == columns, name
        kept.append(docs.collect())
    raw, mild, single, apart, mixed, encoded = kept
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mix_sources", "byte_bpe"]
    table = spark.read.parquet(f"{SF}/documents.parquet")
    scores = {r.doc_id: r.predicted for r in toxicity.toxicity_scores(table, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert sorted(map(tuple, mild)) == sorted(tuple(r) for r in raw if not scores[r.doc_id])
    last = {}
    for r in mild:
        last[cases.ascii_lower(r.text)] = max(r.doc_id, last.get(cases.ascii_lower(r.text), -1))
    assert sorted(map(tuple, single)) == sorted(tuple(r) for r in mild if last[cases.ascii_lower(r.text)] == r.doc_id)
    groups = brute_near([(r.doc_id, r.text) for r in single])
    assert sorted(map(tuple, apart)) == sorted(tuple(r) for r in single if groups[r.doc_id][1] == r.doc_id)
    size = lambda r: len(cases.words(r.text))
    sources = sorted({r.source for r in apart})
    have = [sum(size(r) for r in apart if r.source == s) for s in sources]
    for s, target in zip(sources, water(have, [i % 3 + 1 for i in range(len(sources))])):
        assert abs(sum(size(r) for r in mixed if r.source == s) - target) <= max(size(r) for r in apart if r.source == s)
    assert {tuple(r) for r in mixed} <= {tuple(r) for r in apart} and max(Counter(map(tuple, mixed)).values()) <= 3
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    assert Counter((r.doc_id, tuple(r.token_ids)) for r in encoded) == Counter((r.doc_id, tuple(library.encode_ordinary(r.text))) for r in mixed)
    run = corpus_pipeline.run(spark, SF).select("doc_id", "ids_sha256").collect()
    assert sorted(map(tuple, run)) == sorted((r.doc_id, r.ids_sha256) for r in encoded)


@pytest.mark.parametrize("table", ["awkward", "empty"])
def test_pipeline_takes_awkward_tables(spark, tmp_path, table):
    held = cases.frame(spark) if table == "awkward" else cases.empty(spark)
    held.write.parquet(f"{tmp_path}/documents.parquet")
    cases.labels(spark, 12).write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = held, []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == held.columns or name == "byte_bpe"
        kept.append(docs.collect())
    mild, single, apart, mixed, encoded = kept
    last = {}
    for r in mild:
        key = cases.ascii_lower(r.text)
        last[key] = r.doc_id if key not in last or last[key] is None else max(last[key], r.doc_id if r.doc_id is not None else last[key])
    assert Counter((r.doc_id, cases.ascii_lower(r.text)) for r in single) == Counter((k, t) for t, k in last.items())
    groups = brute_near([(r.doc_id, r.text) for r in single if r.doc_id is not None])
    assert Counter((r.doc_id, r.text) for r in apart) == Counter((r.doc_id, r.text) for r in single if r.doc_id is None or groups[r.doc_id][1] == r.doc_id)
    assert {(r.doc_id, r.text) for r in mixed} <= {(r.doc_id, r.text) for r in apart}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    assert Counter((r.doc_id, tuple(r.token_ids)) for r in encoded) == Counter((r.doc_id, tuple(library.encode_ordinary(r.text or ""))) for r in mixed)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(encoded)


def test_native_plans_have_no_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for df in (exact.exact_dedup(docs), mixing.mix(docs), mixing.draw(docs), exact.drop_exact_copies(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_base_spans_of_all_documents(spark):
    """The query's base columns against plain patterns, over whole texts."""
    want = {}
    for k, t, *_ in cases.sample("sf0.01"):
        spans = brute_spans(t or "")
        said = ",".join(f"{pii.KINDS[kind]}:{a}:{b}" for a, kind, b in spans)
        want[k] = (*(sum(1 for s in spans if s[1] == i) for i in range(4)), hashlib.sha256(said.encode()).hexdigest(), said)
    for r in QUERIES["op3_personal_data"](spark, "/root/testdata/sf0.01").collect():
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == want[r.doc_id][:5]
        assert set(filter(None, want[r.doc_id][5].split(","))) <= set(r.spans.split(","))
