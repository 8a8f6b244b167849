"""DuckDB SQL with the rows of the bound queries, where SQL can express them."""

from __future__ import annotations

_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"

_STORY = r"""
ev AS (SELECT source AS doc_id, CAST(doc_id AS VARCHAR) AS id, CAST(doc_id AS INT) AS seq, 'doc ' || doc_id || CASE WHEN doc_id % 50 = 0 THEN ' Epilogue' ELSE '' END AS event_name,
  CASE WHEN n_chars % 2 = 0 THEN 'major' ELSE 'minor' END AS category, lang AS anchor0, lang, text AS core_event,
  array_to_string(string_split_regex(lower(text), '\s+')[1:CAST(ceil(len(string_split_regex(text, '\s+')) / 2) AS BIGINT)], ' ') AS cause, array_to_string(string_split_regex(text, '\s+')[CAST(ceil(len(string_split_regex(text, '\s+')) / 2) AS BIGINT) + 1:], ' ') AS effect, CAST(doc_id % 97 AS INT) AS p FROM documents),
st AS (SELECT *, CASE WHEN event_name LIKE '%Epilogue%' OR regexp_matches(lower(core_event), 'years later|epilogue|prologue frame|frame narrative|framing device|looking back|afterwards|aftermath') THEN 'Beginning / Setup' ELSE anchor0 END AS timeline_anchor,
  least(p, 90) AS first_page, CASE WHEN p = 90 THEN '90' ELSE least(p, 90) || ',' || greatest(p, 90) END AS source_pages FROM ev),
so AS (SELECT *, CASE timeline_anchor WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 WHEN 'es' THEN 3 ELSE 4 END AS stage_order FROM st),
s AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY stage_order, first_page, event_name, seq) AS INT) AS rank FROM so)"""

_GRAPH = (
    _STORY
    + r""",
chain AS (SELECT doc_id, id AS src, lead(id) OVER o AS dst, CASE WHEN lead(stage_order) OVER o > stage_order THEN 0.95 ELSE 0.9 END AS confidence, 'sequence' AS kind FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY rank)),
tok AS (SELECT doc_id, id, list_distinct(list_filter(string_split_regex(lower(effect), '\s+'), lambda t: length(t) > 4)) AS e, list_distinct(list_filter(string_split_regex(lower(cause), '\s+'), lambda t: length(t) > 4)) AS c FROM ev),
causal AS (SELECT a.doc_id, a.id AS src, b.id AS dst, 0.55 AS confidence, 'causal' AS kind FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND a.id <> b.id
  WHERE len(a.e) > 0 AND len(b.c) > 0 AND len(list_intersect(a.e, b.c)) / least(len(a.e), len(b.c)) >= 0.5),
cand AS (SELECT * FROM chain WHERE dst IS NOT NULL UNION ALL SELECT * FROM causal),
comb AS (SELECT doc_id, src, dst, max(confidence) AS confidence, arg_max(kind, confidence) AS kind FROM cand GROUP BY ALL),
both_ranks AS (SELECT comb.*, a.rank AS src_rank, b.rank AS dst_rank FROM comb JOIN s a ON a.doc_id = comb.doc_id AND a.id = src JOIN s b ON b.doc_id = comb.doc_id AND b.id = dst),
dag AS (SELECT * FROM both_ranks WHERE src_rank < dst_rank)"""
)

_CHUNKS = rf"""
d AS (SELECT doc_id, text AS t, length(text) AS n FROM documents),
k AS (SELECT *, unnest(range(0, CAST(greatest(0, ceil((n - 1200) / 1000)) AS BIGINT) + 1)) * 1000 AS k0 FROM d WHERE n > 0),
c AS (SELECT doc_id, k0, {_STRIP.format("substring(t, k0 + 1, 1200)")} AS content, k0 - length(replace(substring(t, 1, k0), chr(10), '')) + 1 AS page_start,
      greatest(k0, least(k0 + 1200, n) - 1) - length(replace(substring(t, 1, greatest(k0, least(k0 + 1200, n) - 1)), chr(10), '')) + 1 AS page_end FROM k),
ch AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k0) - 1 AS INT) AS chunk_index, CAST(page_start AS INT) AS page_start, CAST(page_end AS INT) AS page_end, content FROM c WHERE content <> '')"""

_TALK = "tk AS (SELECT CAST(conv_id AS VARCHAR) AS doc_id, 'win_' || (turn + 1) AS window_id, CAST(turn + 1 AS INT) AS page_start, text AS raw_text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)"

_SOURCE_STAGES = r"""
sx AS (SELECT DISTINCT source AS doc_id, CAST(doc_id % (3 + CAST(regexp_extract(source, '(\d+)', 1) AS INT) % 8) AS INT) AS k, CAST(regexp_extract(source, '(\d+)', 1) AS INT) AS num FROM documents WHERE source IS NOT NULL),
sy AS (SELECT doc_id, k, CASE WHEN k = 1 THEN 'Climax' ELSE 'Stage ' || k END AS name, num % 2 = 0 AND k = 2 AS framing, num, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS place, count(*) OVER (PARTITION BY doc_id) AS n FROM sx),
pad AS (SELECT doc_id, n, dname, dplace, row_number() OVER (PARTITION BY doc_id ORDER BY dplace) - 1 AS j FROM (SELECT doc_id, max(n) AS n, bool_or(k = 1) AS climax FROM sy GROUP BY doc_id HAVING max(n) < 5), (VALUES ('Beginning / Setup', 0), ('Rising Action', 1), ('Midpoint / Complication', 2), ('Climax', 3), ('Resolution / Aftermath', 4)) v(dname, dplace)
  WHERE dname <> 'Climax' OR NOT climax),
al AS (SELECT doc_id, place, name, framing FROM sy WHERE place < 7 UNION ALL SELECT doc_id, n + j, dname, dplace = 4 FROM pad WHERE n + j < 5),
sn AS (SELECT doc_id, CAST(place AS INT) AS place, name, CASE WHEN bool_or(framing) OVER (PARTITION BY doc_id) THEN framing ELSE place = max(place) OVER (PARTITION BY doc_id) END AS is_framing FROM al)"""

_MERGE = r"""
mi AS (SELECT CAST(user_id AS VARCHAR) AS doc_id, event_id, event_type, event_type || '_' || event_id % 3 AS name, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, row_number() OVER (PARTITION BY user_id, event_type || '_' || event_id % 3 ORDER BY event_id) AS nth FROM events),
mg AS (SELECT *, sum(CASE WHEN nth = 1 OR event_id % 2 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, name ORDER BY i) AS grp FROM mi),
mf AS (SELECT doc_id, name, grp, event_type, min(i) AS first_i, arg_min(event_id, i) AS first_id, count(*) AS merge_count FROM mg GROUP BY ALL),
ms AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY first_i) - 1 AS INT) AS seq FROM mf),
mp AS (SELECT doc_id, name, grp, string_agg(CAST(p AS VARCHAR), ',' ORDER BY p) AS source_pages, count(*) AS n_pages FROM (SELECT DISTINCT doc_id, name, grp, p FROM (SELECT *, unnest([event_id % 9, 3]) AS p FROM mg) WHERE p > 0) GROUP BY ALL),
mc AS (SELECT doc_id, name, grp, string_agg(x, ',' ORDER BY i) AS marks FROM (SELECT doc_id, name, grp, '<' || event_id % 5 || '>' AS x, min(i) AS i FROM mg GROUP BY ALL) GROUP BY ALL),
ma AS (SELECT doc_id, name, grp, string_agg(x, ' | ' ORDER BY i) AS cause FROM (SELECT doc_id, name, grp, '<' || event_id % 4 || '>' AS x, min(i) AS i FROM mg GROUP BY ALL) GROUP BY ALL),
me AS (SELECT ms.doc_id, seq, name AS event_name, CASE WHEN first_id % 2 = 0 THEN 'major' ELSE 'minor' END AS category, event_type || ',' || marks AS characters, cause AS antecedent_cause, source_pages, n_pages, CAST(merge_count AS INT) AS merge_count
  FROM ms JOIN mp USING (doc_id, name, grp) JOIN mc USING (doc_id, name, grp) JOIN ma USING (doc_id, name, grp))"""
_MERGED = f"WITH {_MERGE} SELECT doc_id, seq, event_name, category, characters, antecedent_cause, source_pages, merge_count FROM me"

_JOBS = r"""
jl AS (SELECT user_id || '-' || event_type || '-' || event_id % 2 AS job_id, event_id AS seq, CAST(user_id AS VARCHAR) AS doc_id, event_type AS kind, CASE WHEN event_id % 3 = 0 THEN CASE WHEN event_id % 7 = 0 THEN 'done' ELSE 'running' END END AS status,
  CASE WHEN event_id % 4 = 0 THEN 'stage ' || event_id % 10 END AS stage, CASE WHEN event_id % 5 = 0 THEN value END AS progress, ts FROM events),
jc AS (SELECT job_id, max(doc_id) AS doc_id, max(kind) AS kind, arg_max(status, seq) FILTER (status IS NOT NULL) AS status, arg_max(stage, seq) FILTER (stage IS NOT NULL) AS stage, arg_max(progress, seq) FILTER (progress IS NOT NULL) AS progress,
  min(ts) AS started_at, max(ts) FILTER (status IN ('done', 'error')) AS finished_at FROM jl GROUP BY job_id)"""

_VECTORS = r"""
ve AS (SELECT 'L' || label AS doc_id, CAST(vec_id AS VARCHAR) AS id, vec_id, embedding, vec_id % 3 AS stage_order, vec_id % 7 AS first_page, 'v' || vec_id AS event_name FROM embeddings),
q0 AS (SELECT doc_id AS q_doc, embedding AS q FROM ve WHERE vec_id = 0)"""
_COSINE = "list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[]))"
_POOL = (
    _VECTORS
    + f""",
vr AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY stage_order, first_page, event_name) AS rank FROM ve),
sd AS (SELECT id, rank FROM vr, q0 WHERE doc_id = q_doc ORDER BY {_COSINE} DESC, vec_id LIMIT 12),
po AS (SELECT vr.*, id IN (SELECT id FROM sd) AS is_seed FROM vr, q0 WHERE doc_id = q_doc AND (id IN (SELECT id FROM sd) OR rank IN (SELECT rank + 1 FROM sd UNION SELECT rank - 1 FROM sd))),
pl AS (SELECT *, CAST(row_number() OVER (ORDER BY stage_order, first_page, event_name, id) AS INT) AS place FROM po)"""
)

_POSITIONS = r"""
oe AS (SELECT CAST(user_id AS VARCHAR) AS doc_id, event_type || event_id % 5 AS event_name, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events),
sp AS (SELECT doc_id, event_name, max(s) AS s FROM oe GROUP BY ALL)"""

_REFUSE = "insufficient|cannot determine|not enough information|does not include|do not include enough|unable to determine|additional context|needed to answer"


def _sent(text: str, limit: int = 14000) -> str:
    """What a client is sent of a text."""
    clean = rf"regexp_replace(regexp_replace(regexp_replace({text}, '[\x00-\x08\x0B-\x1F\x{{7F}}-\x{{9F}}]', ' ', 'g'), '[ \t]{{2,}}', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"
    return "'Study notes on works of fiction. Quotations are part of the fiction.' || chr(10) || chr(10) || " + _STRIP.format(f"substring({clean}, 1, {limit})")


_SAID = "length(u) || ' ' || md5(u)"
_BATCHED = "bt AS (SELECT doc_id, CAST(i // 2 AS INT) AS batch, string_agg('--- pages ' || page_start || '-' || page_start || ' ---' || chr(10) || raw_text, chr(10) || chr(10) ORDER BY i) AS t FROM tk GROUP BY doc_id, i // 2)"
_CHATS = f"ch AS (SELECT conv_id, turn, {_sent('text')} AS u FROM conversations)"

ORACLES: dict[str, str] = {
    "t1_t2_chunk_chars": f"WITH {_CHUNKS} SELECT doc_id, chunk_index, page_start, page_end, md5(content) AS content_md5 FROM ch",
    "t3_page_windows": rf"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), n AS (SELECT *, len(ls) AS n FROM d),
w AS (SELECT *, unnest(range(0, CAST(greatest(0, ceil((n - 10) / 8)) AS BIGINT) + 1)) * 8 AS k0 FROM n WHERE n > 0),
b AS (SELECT doc_id, k0, least(k0 + 10, n) AS e, array_to_string(list_transform(range(k0, least(k0 + 10, n)), lambda i: '[PAGE ' || (i + 1) || ']' || chr(10) || ls[i + 1]), chr(10)) AS body FROM w)
SELECT doc_id, 'win_' || (k0 + 1) || '_' || e AS window_id, CAST(k0 + 1 AS INT) AS page_start, CAST(e AS INT) AS page_end, md5({_STRIP.format("body")}) AS text_md5 FROM b""",
    "t4_bullet_pages": r"""
SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(regexp_extract('[PAGE ' || (turn + 1) || ', ' || (conv_id % 7) || '] ' || text, '\[PAGE\s+([0-9,\s]+)\]', 1), '\d+'), lambda x: CAST(x AS INT)))), ',') AS pages FROM conversations""",
    "t5_sanitize": rf"""
WITH a AS (SELECT page_id, regexp_replace(html, '[\x00-\x08\x0B-\x1F\x{{7F}}-\x{{9F}}]', ' ', 'g') AS h FROM pages),
b AS (SELECT page_id, substring(regexp_replace(regexp_replace(h, '[ \t]{{2,}}', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), 1, 12000) AS h FROM a)
SELECT page_id, md5({_STRIP.format("h")}) AS clean_md5 FROM b""",
    "t6_embedding_input": "SELECT doc_id, md5(substring(replace(text, chr(10), ' '), 1, 8000)) AS input_md5 FROM documents",
    "t7_digest": f"""
WITH {_TALK},
p AS (SELECT doc_id, i, '--- pages ' || page_start || '-' || page_start || ' ---' || chr(10) || raw_text AS b FROM tk WHERE n <= 8 OR i IN (0, 1, n // 4, n // 2, 3 * n // 4, n - 2, n - 1)),
u AS (SELECT *, 12000 - coalesce(sum(length(b)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM p),
c AS (SELECT doc_id, i, CASE WHEN length(b) > room THEN substring(b, 1, CAST(greatest(0, room - 20) AS BIGINT)) || chr(10) || '…' ELSE b END AS b FROM u WHERE room > 200 OR i = 0)
SELECT doc_id, md5(string_agg(b, chr(10) || chr(10) ORDER BY i)) AS digest_md5 FROM c GROUP BY doc_id""",
    "t8_t9_batches": f"""
WITH {_TALK} SELECT doc_id, CAST(i // 2 AS INT) AS batch, CAST(i // 4 AS INT) AS round, md5(string_agg('--- pages ' || page_start || '-' || page_start || ' ---' || chr(10) || raw_text, chr(10) || chr(10) ORDER BY i)) AS text_md5 FROM tk GROUP BY doc_id, i // 2, i // 4""",
    "t10_event_text": f"WITH {_STORY} SELECT id, md5(event_name || '. ' || core_event || ' Characters: ' || lang || '. Location: .') AS text_md5 FROM ev",
    "t11_page_label": """
WITH t AS (SELECT conv_id, count(*) AS n, min(turn) + 1 AS a, max(turn) + 1 AS b FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN conv_id % 5 = 0 THEN 'n/a' WHEN n = 1 THEN 'p. ' || a ELSE 'pp. ' || a || '-' || b END AS label FROM t""",
    "t12_event_blocks": f"""
WITH {_STORY}, b AS (SELECT *, CASE WHEN contains(source_pages, ',') THEN 'pp. ' || replace(source_pages, ',', '-') ELSE 'p. ' || source_pages END AS lab FROM s)
SELECT doc_id, md5(string_agg('[' || rank || '] id=' || id || chr(10) || 'Event: ' || event_name || chr(10) || 'Stage: ' || timeline_anchor || chr(10) || 'What: ' || substring(core_event, 1, 240) || chr(10) || 'Source: ' || lab, chr(10) || chr(10) ORDER BY rank)) AS full_md5,
  md5(string_agg('[' || rank || '] ' || event_name || ' | ' || timeline_anchor || ' | ' || lab || chr(10) || substring(core_event, 1, 160), chr(10) || chr(10) ORDER BY rank) FILTER (rank <= 10)) AS slim_md5 FROM b GROUP BY doc_id""",
    "t13_t15_passages": f"""
WITH {_CHUNKS}, h AS (SELECT *, chunk_index + 1 AS place, 1 / (chunk_index + 2) AS score FROM ch)
SELECT doc_id, md5(string_agg('[Passage ' || place || ' | similarity ' || printf('%.3f', score) || ']' || chr(10) || substring(content, 1, 420), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY place)) AS full_md5,
  md5(string_agg('[Passage ' || place || ']' || chr(10) || substring(content, 1, 220), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY place) FILTER (place <= 3)) AS short_md5,
  CAST(max(page_end - page_start + 1) FILTER (place = 1) AS INT) AS n_pages, md5(max(substring(content, 1, 280)) FILTER (place = 1)) AS preview_md5 FROM h GROUP BY doc_id""",
    "t16_light_index": f"WITH {_STORY} SELECT doc_id, count(*) AS n, md5(string_agg(event_name || '|' || category || '|' || anchor0 || '|' || core_event, ';' ORDER BY event_name)) AS index_md5 FROM ev GROUP BY doc_id",
    "t17_stage_lines": f"WITH {_SOURCE_STAGES} SELECT doc_id, string_agg((place + 1) || '. ' || name || CASE WHEN is_framing THEN ' [FRAMING]' ELSE '' END, chr(10) ORDER BY place) AS lines FROM sn GROUP BY doc_id",
    "t18_merge_prompts": f"""
WITH {_TALK}, b AS (SELECT doc_id, CAST(i // 2 AS INT) AS batch, string_agg('--- pages ' || page_start || '-' || page_start || ' ---' || chr(10) || raw_text, chr(10) || chr(10) ORDER BY i) AS t FROM tk GROUP BY doc_id, i // 2)
SELECT doc_id, batch, md5('PAGES 7' || chr(10) || '1. A' || chr(10) || 'KNOWN EVENTS: []' || chr(10) || 'OBSERVATIONS:' || chr(10) || t) AS user_md5 FROM b""",
    "e1_stage_normalize": f"WITH {_SOURCE_STAGES} SELECT * FROM sn",
    "e2_s14_s15_taxonomy_json": rf"""
WITH {_SOURCE_STAGES}, g AS (SELECT doc_id, string_agg(name, '/' ORDER BY place) AS names FROM sn GROUP BY doc_id), c AS (SELECT doc_id, count(*) AS n, max(num) AS num FROM sy GROUP BY doc_id)
SELECT doc_id, CASE WHEN num % 3 = 0 THEN names ELSE 'Beginning / Setup/Rising Action/Midpoint / Complication/Climax/Resolution / Aftermath' END AS names, CAST(n AS INT) AS n_named FROM g JOIN c USING (doc_id)""",
    "e3_stage_fuzzy": r"""
WITH a AS (SELECT DISTINCT unnest([event_type, upper(event_type) || ' (day 2)', 'fault-' || reverse(event_type) || ' made', substring(event_type, 1, 3), '', 'zzz', 'Click / Tap']) AS anchor FROM events),
g AS (SELECT * FROM (VALUES ('Click / Tap', 0), ('sign up', 1), ('Purchase Made', 2), ('view', 3), ('Error / Fault', 4)) v(name, i)),
x AS (SELECT anchor, trim(lower(anchor)) AS low, name, i, len(list_intersect(list_distinct(list_filter(string_split_regex(regexp_replace(trim(lower(anchor)), '[/-]', ' ', 'g'), '\s+'), lambda t: length(t) > 2)),
      list_distinct(list_filter(string_split_regex(regexp_replace(lower(name), '[/-]', ' ', 'g'), '\s+'), lambda t: length(t) > 2)))) AS score FROM a, g)
SELECT anchor, CAST(coalesce(min(i) FILTER (anchor = name), CASE WHEN max(low) = '' THEN 1 END, min(i) FILTER (contains(low, lower(name)) OR contains(lower(name), low)), CASE WHEN max(score) > 0 THEN arg_max(i, score * 10 - i) END, 1) AS INT) AS stage_order FROM x GROUP BY anchor""",
    "e4_merge_fold": _MERGED,
    "e4_merge_fold_arrow": _MERGED,
    "e5_merge_stats": f"WITH {_MERGE} SELECT doc_id, count(*) AS added, CAST(sum(merge_count - 1) AS BIGINT) AS merged, CAST(0 AS BIGINT) AS failed FROM me GROUP BY doc_id",
    "e6_e10_story_order": f"WITH {_STORY} SELECT doc_id, id, timeline_anchor, CAST(stage_order AS INT) AS stage_order, timeline_anchor AS stage_name, CAST(first_page AS INT) AS first_page, source_pages, rank FROM s",
    "e10_event_ids": f"WITH {_STORY} SELECT doc_id, seq, 'ev_' || substring(sha1(doc_id || chr(31) || seq || chr(31) || event_name), 1, 12) AS id FROM ev",
    "g1_chain_edges": f"WITH {_GRAPH} SELECT doc_id, src, dst, CAST(confidence AS DOUBLE) AS confidence, kind FROM chain WHERE dst IS NOT NULL",
    "g2_causal_pairs": f"WITH {_GRAPH} SELECT doc_id, src, dst, CAST(confidence AS DOUBLE) AS confidence, kind FROM causal",
    "g3_g6_dag_edges": f"WITH {_GRAPH} SELECT doc_id, src, dst, CAST(confidence AS DOUBLE) AS confidence, kind FROM dag",
    "g7_repair_stats": f"""
WITH {_GRAPH}, n AS (SELECT doc_id, count(*) AS candidate_edges FROM cand GROUP BY doc_id), f AS (SELECT doc_id, count(*) FILTER (src_rank < dst_rank) AS final_edges, count(*) FILTER (src_rank >= dst_rank) AS dropped_edges FROM both_ranks GROUP BY doc_id),
k AS (SELECT doc_id, bool_and(src_rank < dst_rank) AS forward FROM dag GROUP BY doc_id), u AS (SELECT doc_id, count(DISTINCT rank) = count(*) AS strict FROM s GROUP BY doc_id)
SELECT doc_id, candidate_edges, final_edges, dropped_edges, round(dropped_edges / greatest(1, candidate_edges), 4) AS cycle_rate, coalesce(k.forward, true) AND u.strict AS is_dag FROM n JOIN f USING (doc_id) LEFT JOIN k USING (doc_id) JOIN u USING (doc_id)""",
    "g8_reachable": f"""
WITH RECURSIVE {_GRAPH},
e AS (SELECT doc_id, arg_min(id, rank) AS a, arg_max(id, rank) AS b, arg_max(id, rank) FILTER (rank <= 4) AS c FROM s GROUP BY doc_id),
p AS (SELECT doc_id, a AS src, b AS dst FROM e UNION ALL SELECT doc_id, b, c FROM e UNION ALL SELECT doc_id, a, 'nobody' FROM e),
f AS (SELECT DISTINCT doc_id, x AS root FROM (SELECT doc_id, src AS x FROM p UNION ALL SELECT doc_id, dst FROM p)),
r AS (SELECT doc_id, root, root AS node, 0 AS hops FROM f UNION SELECT r.doc_id, root, dag.dst, hops + 1 FROM r JOIN dag ON dag.doc_id = r.doc_id AND dag.src = r.node WHERE hops < 80),
m AS (SELECT doc_id, root, node, min(hops) AS hops FROM r GROUP BY ALL)
SELECT p.doc_id, p.src, p.dst, CASE WHEN x.hops IS NOT NULL AND p.src <> p.dst THEN 'before' WHEN y.hops IS NOT NULL AND p.src <> p.dst THEN 'after' ELSE 'incomparable' END AS relation, CAST(CASE WHEN p.src = p.dst THEN 0 ELSE coalesce(x.hops, y.hops, 0) END AS INT) AS hops
FROM p LEFT JOIN m x ON x.doc_id = p.doc_id AND x.root = p.src AND x.node = p.dst LEFT JOIN m y ON y.doc_id = p.doc_id AND y.root = p.dst AND y.node = p.src""",
    "g9_neighbours": f"""
WITH {_GRAPH}, sd AS (SELECT doc_id, id FROM s WHERE CAST(id AS BIGINT) % 100 = 0), f1 AS (SELECT DISTINCT d.doc_id, d.dst AS id FROM dag d JOIN sd ON sd.doc_id = d.doc_id AND sd.id = d.src), b1 AS (SELECT DISTINCT d.doc_id, d.src AS id FROM dag d JOIN sd ON sd.doc_id = d.doc_id AND sd.id = d.dst)
SELECT * FROM f1 UNION SELECT * FROM b1 UNION SELECT d.doc_id, d.dst FROM dag d JOIN f1 ON f1.doc_id = d.doc_id AND f1.id = d.src UNION SELECT d.doc_id, d.src FROM dag d JOIN b1 ON b1.doc_id = d.doc_id AND b1.id = d.dst""",
    "g10_appears_in": "SELECT DISTINCT CAST(user_id AS VARCHAR) AS doc_id, user_id || '::' || event_type AS character_uid, event_type AS name, CAST(event_id AS VARCHAR) AS event_id FROM events",
    "g10_characters": "SELECT DISTINCT source || '::' || lang AS character_uid, source AS doc_id, lang AS name FROM documents",
    "s18_graph_read": f"""
WITH {_GRAPH}, k AS (SELECT doc_id, id FROM s WHERE category = 'major'), e AS (SELECT d.doc_id, count(*) AS edges FROM dag d JOIN k a ON a.doc_id = d.doc_id AND a.id = d.src JOIN k b ON b.doc_id = d.doc_id AND b.id = d.dst GROUP BY d.doc_id)
SELECT doc_id, count(*) AS nodes, coalesce(max(edges), 0) AS edges FROM k LEFT JOIN e USING (doc_id) GROUP BY doc_id""",
    "v1_cosine_topk_chunks": f"WITH {_VECTORS} SELECT vec_id, round({_COSINE}, 6) AS score FROM ve, q0 ORDER BY {_COSINE} DESC, vec_id LIMIT 8",
    "v2_cosine_topk_events": f"WITH {_VECTORS} SELECT vec_id, doc_id, event_name, round({_COSINE}, 6) AS score FROM ve, q0 WHERE doc_id = q_doc ORDER BY {_COSINE} DESC, vec_id LIMIT 12",
    "v1_topk_each": f"""
WITH {_VECTORS}, a AS (SELECT vec_id AS query_id, doc_id, embedding AS q FROM ve WHERE vec_id % 100 = 0), x AS (SELECT query_id, vec_id, {_COSINE} AS sc FROM ve JOIN a USING (doc_id)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sc DESC, vec_id) AS INT) AS place FROM x) SELECT query_id, vec_id, place, round(sc, 6) AS score FROM r WHERE place <= 5""",
    "v3_v5_seed_expand": f"WITH {_POOL} SELECT doc_id, id, event_name, place, is_seed FROM pl",
    "v6_v7_citations": f"WITH {_POOL} SELECT 'hit' AS branch, id, place FROM pl WHERE id = '0' UNION ALL SELECT 'none', id, place FROM pl WHERE place <= 5",
    "m12_refusals": f"""
WITH a AS (SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'I Cannot Determine that' ELSE 'BEFORE' END AS x, CASE WHEN conv_id % 2 = 0 THEN 'not enough to say' ELSE 'AFTER' END AS y, min(turn) + 1 AS lo, max(turn) + 1 AS hi FROM conversations GROUP BY conv_id)
SELECT CAST(conv_id AS VARCHAR) AS doc_id, CASE WHEN NOT regexp_matches(lower(x), '{_REFUSE}') THEN x WHEN NOT contains(lower(y), 'not enough') THEN y
  ELSE 'No answer: the nearest passages lie between p. ' || lo || ' and p. ' || hi || ', and similarity alone does not tell what came first.' END AS answer FROM a""",
    "x1_pairwise_accuracy": f"""
WITH {_POSITIONS}, gp AS (SELECT doc_id, event_name, min(g) AS g FROM oe GROUP BY ALL), u AS (SELECT doc_id, event_name, g, s FROM gp JOIN sp USING (doc_id, event_name)),
r AS (SELECT a.doc_id, round(avg(CASE WHEN a.s < b.s THEN 1 ELSE 0 END), 4) AS v FROM u a JOIN u b ON a.doc_id = b.doc_id AND a.g < b.g GROUP BY a.doc_id)
SELECT DISTINCT oe.doc_id, v AS pairwise_accuracy FROM oe LEFT JOIN r USING (doc_id)""",
    "x2_kendall_tau": f"""
WITH {_POSITIONS}, u AS (SELECT oe.doc_id, g, sp.s FROM oe JOIN sp USING (doc_id, event_name)),
r AS (SELECT a.doc_id, round(sum(CASE WHEN a.s < b.s THEN 1 ELSE -1 END) / count(*), 4) AS v FROM u a JOIN u b ON a.doc_id = b.doc_id AND a.g < b.g GROUP BY a.doc_id)
SELECT DISTINCT oe.doc_id, v AS kendall_tau FROM oe LEFT JOIN r USING (doc_id)""",
    "x3_summary": f"""
WITH {_MERGE}, a AS (SELECT doc_id, count(*) AS n, count(*) FILTER (category = 'major') AS major, count(*) FILTER (category = 'minor') AS minor, CAST(sum(merge_count - 1) AS BIGINT) AS merges, count(*) FILTER (n_pages > 0) AS traced, CAST(sum(n_pages) AS BIGINT) AS pages FROM me GROUP BY doc_id)
SELECT CAST(c_custkey AS VARCHAR) AS doc_id, coalesce(n, 0) AS events_total, coalesce(major, 0) AS events_major, coalesce(minor, 0) AS events_minor, coalesce(merges, 0) AS merges, coalesce(n + merges, 0) AS raw_events,
  CASE WHEN n + merges > 0 THEN round(merges / (n + merges), 4) ELSE 0.0 END AS duplicate_rate, CAST(round(coalesce(traced / n, 0), 4) AS DOUBLE) AS page_traceability, CAST(round(coalesce(pages / n, 0), 2) AS DOUBLE) AS avg_pages_per_event FROM customer LEFT JOIN a ON a.doc_id = CAST(c_custkey AS VARCHAR)""",
    "x4_row_counts": """
SELECT c_custkey AS doc_id, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS chunks, (SELECT count(*) FROM events WHERE user_id = c_custkey) AS observations FROM customer""",
    "x5_run_averages": """
WITH r AS (SELECT o_custkey AS doc_id, CAST(floor(o_totalprice) AS BIGINT) % 4000 AS a, CAST(floor(o_totalprice) AS BIGINT) % 7000 AS b, o_orderkey % 901 AS c, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 17 END AS d FROM orders)
SELECT doc_id, count(*) AS runs, CAST(round_even(coalesce(avg(a), 0), 0) AS INT) AS avg_naive_ms, CAST(round_even(coalesce(avg(b), 0), 0) AS INT) AS avg_timeline_ms, CAST(round_even(coalesce(avg(c), 0), 0) AS INT) AS avg_naive_tokens, CAST(round_even(coalesce(avg(d), 0), 0) AS INT) AS avg_timeline_tokens FROM r GROUP BY doc_id""",
    "x6_stage_distribution": f"WITH {_STORY} SELECT doc_id, timeline_anchor, count(*) AS n FROM s GROUP BY ALL",
    "x6_stage_map": f"WITH {_STORY} SELECT doc_id, CAST(count(DISTINCT timeline_anchor) AS INT) AS n_stages, nullif(count(*) FILTER (timeline_anchor = 'en'), 0) AS n_en FROM s GROUP BY doc_id",
    "x7_build_summary": f"""
WITH {_GRAPH}, f AS (SELECT doc_id, count(*) FILTER (src_rank < dst_rank) AS final_edges, count(*) FILTER (src_rank >= dst_rank) AS dropped_edges FROM both_ranks GROUP BY doc_id)
SELECT doc_id, count(*) AS events_total, count(*) FILTER (category = 'major') AS events_major, count(*) FILTER (category = 'minor') AS events_minor, CAST(0 AS BIGINT) AS merges, max(final_edges) AS final_edges, max(dropped_edges) AS dropped_edges FROM s JOIN f USING (doc_id) GROUP BY doc_id""",
    "s2_content_id": "SELECT doc_id, 'doc_' || substring(sha1(text), 1, 16) AS content_id FROM documents",
    "s3_s4_upload_check": "SELECT p_partkey, p_partkey % 2 = 0 AS is_pdf, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title FROM part",
    "s5_upsert_documents": """
WITH h AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS title, c_mktsegment AS filename, c_nationkey AS page_count FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT CAST(c_custkey AS VARCHAR) AS id, upper(c_mktsegment) AS title FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(h.id, n.id) AS id, coalesce(n.title, h.title) AS title, CASE WHEN h.id IS NULL THEN 'new' ELSE filename END AS filename, CASE WHEN h.id IS NULL THEN 1 ELSE page_count END AS page_count FROM h FULL JOIN n ON h.id = n.id""",
    "s6_s12_replace_rows": "SELECT o_custkey AS doc_id, CASE WHEN o_custkey % 5 = 0 THEN -o_orderkey ELSE o_orderkey END AS o_orderkey FROM orders WHERE o_custkey % 5 <> 0 OR o_orderkey % 2 = 0",
    "s8_document_list": """
SELECT id, title, chunks, events, chunks > 0 AS naive_ready, events > 0 AS timeline_ready FROM (SELECT c_custkey AS id, c_name AS title, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS chunks, (SELECT count(*) FROM events WHERE user_id = c_custkey) AS events FROM customer)""",
    "s9_delete_cascade": "SELECT o_custkey AS doc_id, o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
    "s13_s7_ordered_scan": "SELECT doc_id, CAST(generate_subscripts(ls, 1) AS INT) AS page_no, CAST(length(unnest(ls)) AS INT) AS n_chars FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)",
    "s16_observation_list": "SELECT CAST(turn + 1 AS INT) AS page_start, md5(text) AS window_id FROM conversations ORDER BY turn, md5(text) LIMIT 20",
    "s21_job_state": f"WITH {_JOBS} SELECT job_id, doc_id, kind, status, stage, round(progress, 3) AS progress, strftime(started_at, '%Y-%m-%d %H:%M:%S') AS started_at, strftime(finished_at, '%Y-%m-%d %H:%M:%S') AS finished_at FROM jc",
    "s21_latest_job": f"WITH {_JOBS}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY started_at DESC, job_id) AS k FROM jc) SELECT doc_id, kind, job_id FROM r WHERE k = 1",
    "s22_duplicate_keys": "SELECT CAST(doc_id % 500 AS VARCHAR) AS id, count(*) AS n FROM documents GROUP BY doc_id % 500 HAVING count(*) > 1",
    "s24_health": "SELECT true AS healthy",
    "s25_titles": """
SELECT CAST(o.o_custkey AS VARCHAR) AS doc_id, coalesce(nullif(CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END, ''), CAST(o.o_custkey AS VARCHAR)) AS title FROM (SELECT DISTINCT o_custkey FROM orders) o LEFT JOIN customer ON c_custkey = o.o_custkey AND c_custkey % 4 <> 0""",
    "m8_s19_pending": f"WITH {_TALK} SELECT doc_id, window_id FROM tk WHERE CAST(doc_id AS BIGINT) % 2 <> 0 AND window_id <> 'win_1'",
    "m2_m9_stages": "SELECT DISTINCT CAST(conv_id AS VARCHAR) AS doc_id, 'Beginning / Setup/Rising Action/Midpoint / Complication/Climax/Resolution / Aftermath' AS names FROM conversations",
    "m4_closed_schema": """SELECT '{"$defs": {"x": {"additionalProperties": false, "properties": {"c": {"type": "integer"}}, "required": ["c"]}}, "additionalProperties": false, "properties": {"a": {"$ref": "#/$defs/x"}, "b": {"type": "string"}}, "required": ["a", "b"], "type": "object"}' AS schema""",
}

ORACLES |= {
    "m1_chat": f"WITH {_CHATS} SELECT conv_id, turn, {_SAID} AS reply, CAST(length(u) AS INT) AS prompt_tokens, CAST(length({_SAID}) AS INT) AS completion_tokens, false AS filtered, false AS truncated FROM ch",
    "m7_usage_sums": f"WITH {_CHATS} SELECT CAST(sum(length(u)) AS BIGINT) AS prompt_tokens, CAST(sum(length({_SAID})) AS BIGINT) AS completion_tokens FROM ch",
    "m5_m6_attempts": rf"""
WITH a AS (SELECT conv_id, turn, [{_sent('text', 400)}, {_sent('text', 100)}, {_sent('text', 20)}] AS sent, rtrim(text) AS t FROM conversations),
b AS (SELECT conv_id, turn, length(t) AS n, list_filter(sent, lambda x: NOT contains(x[70:], 'z'))[1] AS u, list_position(list_transform(sent, lambda x: NOT contains(x[70:], 'z')), true) AS k FROM a)
SELECT conv_id, turn, {_SAID} AS reply, u IS NULL AS filtered, CASE WHEN k = 1 THEN n > 400 WHEN k = 2 THEN n > 100 ELSE n > 20 END AS truncated FROM b""",
    "m3_embed_order": r"""
WITH a AS (SELECT doc_id, substring(replace(coalesce(text, ''), chr(10), ' '), 1, 8000) AS t FROM documents) SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, CAST(length(t) - length(replace(t, 'e', '')) AS BIGINT) AS n_e, CAST(CASE WHEN t = '' THEN 0 ELSE unicode(t) END AS BIGINT) AS first FROM a""",
    "m8_skim_windows": rf"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), n AS (SELECT *, len(ls) AS n FROM d),
w AS (SELECT *, unnest(range(0, CAST(greatest(0, ceil((n - 10) / 8)) AS BIGINT) + 1)) * 8 AS k0 FROM n WHERE n > 0),
b AS (SELECT doc_id, 'win_' || (k0 + 1) || '_' || least(k0 + 10, n) AS window_id, '[Text Window]' || chr(10) || chr(10) || {_STRIP.format("array_to_string(list_transform(range(k0, least(k0 + 10, n)), lambda i: '[PAGE ' || (i + 1) || ']' || chr(10) || ls[i + 1]), chr(10))")} AS body FROM w),
c AS (SELECT doc_id, window_id, {_sent('body')} AS u, {_sent('body', 100000000)} AS whole FROM b)
SELECT doc_id, window_id, {_SAID} AS reply, length(whole) > 14000 + 70 AS truncated FROM c""",
    "m10_merge_rounds": f"""
WITH {_TALK}, {_BATCHED}, p AS (SELECT doc_id, batch, {_sent("'PAGES 7' || chr(10) || '1. A' || chr(10) || 'KNOWN EVENTS: []' || chr(10) || 'OBSERVATIONS:' || chr(10) || t")} AS u FROM bt)
SELECT doc_id, batch, CAST(0 AS INT) AS pos, md5(u) AS event_name, CAST(length(u) AS VARCHAR) AS source_pages FROM p""",
    "m11_timeline_answers": f"""
WITH {_STORY}, b AS (SELECT *, CASE WHEN contains(source_pages, ',') THEN 'pp. ' || replace(source_pages, ',', '-') ELSE 'p. ' || source_pages END AS lab FROM s WHERE rank <= 3)
SELECT doc_id, string_agg(event_name || ' (' || lab || ').', ' Then ' ORDER BY rank) AS answer, string_agg(id, ',' ORDER BY rank) AS cited FROM b GROUP BY doc_id""",
    "v5_pair_relation": f"""
WITH {_VECTORS}, vr AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY stage_order, first_page, event_name) AS rank FROM ve),
sd AS (SELECT id, rank, row_number() OVER (ORDER BY {_COSINE} DESC, vec_id) AS k FROM vr, q0 WHERE doc_id = q_doc), a AS (SELECT id, rank FROM sd WHERE k = 1), b AS (SELECT id AS b_id, rank AS b_rank FROM sd WHERE k = 2)
SELECT id AS src, b_id AS dst, CASE WHEN abs(b_rank - rank) > 80 THEN 'incomparable' WHEN rank < b_rank THEN 'before' ELSE 'after' END AS relation, CAST(CASE WHEN abs(b_rank - rank) > 80 THEN 0 ELSE abs(b_rank - rank) END AS INT) AS hops FROM a, b""",
    "s10_stored_chunks": f"WITH {_CHUNKS} SELECT doc_id, CAST(CASE WHEN CAST(doc_id AS BIGINT) % 2 = 0 THEN 1 ELSE count(*) END AS BIGINT) AS n, md5(string_agg(content, '' ORDER BY chunk_index) FILTER (CAST(doc_id AS BIGINT) % 2 <> 0 OR chunk_index = 0)) AS text_md5 FROM ch GROUP BY doc_id",
    "s11_stored_observations": f"WITH {_TALK} SELECT doc_id, window_id, CASE WHEN CAST(doc_id AS BIGINT) % 3 = 0 THEN 'again ' || md5(raw_text) ELSE md5(raw_text) END AS raw_md5 FROM tk WHERE CAST(doc_id AS BIGINT) % 5 <> 0",
    "s17_g11_stored_edges": ORACLES["g3_g6_dag_edges"],
    "s17_stored_appearances": ORACLES["g10_appears_in"],
    "s20_stored_runs": ORACLES["x5_run_averages"].replace("FROM orders)", "FROM orders WHERE o_custkey <> (SELECT min(o_custkey) FROM orders))"),
    "x8_metrics_with_gold": f"""
WITH {_POSITIONS}, one AS (SELECT CAST(min(user_id) AS VARCHAR) AS doc_id FROM events), gp AS (SELECT event_name, min(g) AS g FROM oe JOIN one USING (doc_id) GROUP BY ALL), u AS (SELECT event_name, g, s FROM gp JOIN (SELECT event_name, s FROM sp JOIN one USING (doc_id)) USING (event_name)),
r AS (SELECT round(avg(CASE WHEN a.s < b.s THEN 1 ELSE 0 END), 4) AS v FROM u a JOIN u b ON a.g < b.g), w AS (SELECT g, sp.s FROM oe JOIN sp USING (doc_id, event_name) JOIN one USING (doc_id)),
k AS (SELECT round(sum(CASE WHEN a.s < b.s THEN 1 ELSE -1 END) / count(*), 4) AS v FROM w a JOIN w b ON a.g < b.g)
SELECT doc_id, (SELECT count(*) FROM oe JOIN one USING (doc_id)) AS events_total, CAST(r.v AS DOUBLE) AS pairwise_accuracy, CAST(k.v AS DOUBLE) AS kendall_tau FROM one, r, k""",
}

ORACLES["t5_sanitize_whole"] = ORACLES["t5_sanitize"].replace(", 1, 12000)", ", 1)")
ORACLES["t7_digest_whole"] = ORACLES["t7_digest"].replace("12000 -", "1000000000000 -")
