"""The contract queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.bpe import decode, encode
from loomline.llm.exact import exact_dedup
from loomline.llm.lines import line_dedup
from loomline.llm.mixing import mix
from loomline.llm.near import near_duplicates
from loomline.llm.pii import KINDS, find_personal_data
from loomline.llm.quality import quality_scores
from loomline.llm.rules import quality_rules
from loomline.llm.substring import substring_dedup
from loomline.llm.toxicity import toxicity_scores

RANKS = "byte_bpe_multi_50k.tiktoken"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(_documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_documents(spark, sf_dir), _labels(spark, sf_dir))


def _is_kind(kind: str) -> Callable[[Column], Column]:
    return lambda span: span["kind"] == kind


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(_documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["plain"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [F.size(F.filter(base, _is_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_documents(spark, sf_dir))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_documents(spark, sf_dir))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(_documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(_documents(spark, sf_dir), _labels(spark, sf_dir))


def token_digests(docs: DataFrame, keep_ids: bool = False) -> DataFrame:
    """Encode and decode, and the digests of both."""
    import public_tokenizers

    path = public_tokenizers.path(RANKS)
    out = decode(encode(docs, path, public_tokenizers.PATTERN), path)
    ids = F.array_join(F.col("token_ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), *(["token_ids"] if keep_ids else []))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(_documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_substring_dedup, op2_quality, op3_personal_data, op4_quality_rules, op5_exact_dedup, op6_line_dedup, op7_mixing, op8_near_duplicates, op9_toxicity, op10_byte_bpe)}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op1_substring_dedup": f"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 49, 0) + 1)) AS i FROM w),
g AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS k FROM p),
m AS (SELECT k, min(doc_id) AS src FROM g GROUP BY k),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS place FROM g JOIN m USING (k) WHERE src < doc_id),
gone AS (SELECT doc_id, list(place) AS places FROM r GROUP BY doc_id),
k AS (SELECT w.doc_id, len(ws) AS n, ws, coalesce(gone.places, []) AS places FROM w LEFT JOIN gone USING (doc_id)),
x AS (SELECT doc_id, places, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM k),
e AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM x WHERE NOT list_contains(places, i) GROUP BY doc_id)
SELECT k.doc_id, CAST(n AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM k LEFT JOIN e ON k.doc_id = e.doc_id""",
    "op4_quality_rules": f"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, {_WORDS} AS ws FROM documents),
u AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
g AS (SELECT doc_id, i, md5(w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o) AS k, w = lag(w) OVER o AS stutter FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
h AS (SELECT doc_id, k FROM g WHERE k IS NOT NULL GROUP BY doc_id, k HAVING count(*) > 1),
p AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT g.doc_id, unnest(range(i, i + 5)) AS place FROM g JOIN h ON g.doc_id = h.doc_id AND g.k = h.k) GROUP BY doc_id),
st AS (SELECT doc_id, count(*) FILTER (stutter) AS n FROM g GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
c AS (SELECT d.doc_id, lang, source, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
      coalesce(l.n, 0) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words, length(regexp_replace(text, '[^A-Z!]', '', 'g')) AS n_shouts, coalesce(st.n, 0) AS n_stutters
      FROM d LEFT JOIN l USING (doc_id) LEFT JOIN p USING (doc_id) LEFT JOIN st USING (doc_id)),
r AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, n_symbols * 1000 // greatest(n_words, 1) AS symbols, n_stutters * 1000 // greatest(n_words, 1) AS stutters,
      n_dup_lines * 1000 // greatest(n_words, 1) AS doubles, word_chars * 100 // greatest(n_words, 1) AS word_size, n_shouts * 1000 // greatest(word_chars, 1) AS shouts FROM c),
m AS (UNPIVOT (SELECT lang, source, symbols, stutters, doubles, word_size, shouts FROM r WHERE NOT base_failed) ON symbols, stutters, doubles, word_size, shouts INTO NAME measure VALUE v),
b AS (SELECT lang, source, measure, CASE WHEN v < 64 THEN v ELSE (v >> (length(bin(v)) - 6)) << (length(bin(v)) - 6) END AS v FROM m),
q1 AS (SELECT lang, source, measure, count(*) AS total, quantile_disc(v, 0.25) AS lo, quantile_disc(v, 0.75) AS hi FROM b GROUP BY ALL),
q2 AS (SELECT lang, measure, count(*) AS total, quantile_disc(v, 0.25) AS lo, quantile_disc(v, 0.75) AS hi FROM b GROUP BY ALL),
q3 AS (SELECT measure, quantile_disc(v, 0.25) AS lo, quantile_disc(v, 0.75) AS hi FROM b GROUP BY ALL),
q AS (SELECT q1.lang, q1.source, q1.measure, CASE WHEN q1.total >= 100 THEN q1.lo WHEN q2.total >= 100 THEN q2.lo ELSE q3.lo END AS lo, CASE WHEN q1.total >= 100 THEN q1.hi WHEN q2.total >= 100 THEN q2.hi ELSE q3.hi END AS hi
      FROM q1 JOIN q2 ON q1.lang IS NOT DISTINCT FROM q2.lang AND q1.measure = q2.measure JOIN q3 ON q1.measure = q3.measure),
e AS (SELECT *, (hi - lo) * 6 + CASE measure WHEN 'symbols' THEN 60 WHEN 'stutters' THEN 150 WHEN 'doubles' THEN 120 WHEN 'word_size' THEN 150 ELSE 250 END AS reach FROM q),
z AS (SELECT lang, source, max(hi + reach) FILTER (measure = 'symbols') AS a, max(hi + reach) FILTER (measure = 'stutters') AS b, max(hi + reach) FILTER (measure = 'doubles') AS c,
      max(hi + reach) FILTER (measure = 'word_size') AS d, max(lo - reach) FILTER (measure = 'word_size') AS e, max(hi + reach) FILTER (measure = 'shouts') AS f FROM e GROUP BY lang, source)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       base_failed, NOT base_failed AND coalesce(symbols <= z.a AND stutters <= z.b AND doubles <= z.c AND word_size BETWEEN z.e AND z.d AND shouts <= z.f, false) AS kept
FROM r LEFT JOIN z ON r.lang IS NOT DISTINCT FROM z.lang AND r.source IS NOT DISTINCT FROM z.source""",
    "op5_exact_dedup": f"""
WITH n AS (SELECT doc_id, {_LOWER} AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM n JOIN g USING (norm)""",
    "op6_line_dedup": r"""
WITH l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.*, c.holder IS NOT NULL AND c.holder <> k.doc_id AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY doc_id""",
    "op7_mixing": f"""
WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size, md5('7:' || CAST(doc_id AS VARCHAR)) AS rank FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
o AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER (ORDER BY source_size / weight, weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY source_size / weight, weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, CASE WHEN (max(level) OVER ()) * weight >= CAST(source_size * 3 AS DOUBLE) THEN CAST(source_size * 3 AS DOUBLE) ELSE (max(level) OVER ()) * weight END AS target FROM o),
f AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
x AS (SELECT d.*, source_size, target, whole, target - whole * source_size AS extra, sum(size) OVER (PARTITION BY d.source ORDER BY rank, doc_id) AS run
      FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN whole < 3 AND run - size / 2 <= extra THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM x""",
    "op8_near_duplicates": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 4], ' ')) AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, least(len(ws), 1)) + 1)) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * common >= 75 * (p.n + q.n - common)),
r AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
m AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, coalesce(component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.x = d.doc_id""",
}
