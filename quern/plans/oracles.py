r"""DuckDB SQL for the catalogue's rows. Tables are views of the same Parquet files."""

from __future__ import annotations

D = "(SELECT doc_id, text, strlen(text)::BIGINT AS n FROM documents WHERE text IS NOT NULL AND strlen(text) > 0)"
INDEX = f"(SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) % 4)::INTEGER AS shard, ((row_number() OVER (ORDER BY doc_id) - 1) // 4)::BIGINT AS span, n AS token_count, n AS cbytes FROM {D})"
OFFSETS = f"(SELECT *, coalesce(sum(cbytes) OVER (PARTITION BY shard ORDER BY span ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM {INDEX})"
PIECES = r" ?\p{L}+| ?\p{N}+| ?[^ \t\n\r\f\x0B\p{L}\p{N}]+|[ \t\n\r\f\x0B]+"


def bits(value: str) -> str:
    """The first 60 bits of an MD5."""
    return f"('0x' || substr(md5({value}), 1, 15))::BIGINT"


def holdout(lane: str) -> str:
    """doc_id, n, lane and held_out by the greedy rule at 10 percent."""
    return f"""
o AS (SELECT doc_id, n, {lane} AS lane, row_number() OVER (PARTITION BY {lane} ORDER BY doc_id) AS i FROM {D}),
f AS (
  SELECT lane, i, doc_id, n, n AS seen, CASE WHEN 0 < floor(n * 0.1::DOUBLE) THEN n ELSE 0 END AS held, 0 < floor(n * 0.1::DOUBLE) AS held_out FROM o WHERE i = 1
  UNION ALL
  SELECT o.lane, o.i, o.doc_id, o.n, f.seen + o.n, f.held + CASE WHEN f.held < floor((f.seen + o.n) * 0.1::DOUBLE) THEN o.n ELSE 0 END, f.held < floor((f.seen + o.n) * 0.1::DOUBLE)
  FROM f JOIN o ON o.lane = f.lane AND o.i = f.i + 1)"""


#: Packing with one lane, C = 2048, M = 64, over s(grp, i, id, n): one row per segment.
#: A row's state is the step, whether it began with a carry, the place to write at, the span to go on with and what is left of it.
PACK = """
p AS (
  SELECT grp, 0::BIGINT AS step, false AS cont, 0::BIGINT AS seg, i, id, n, 0::BIGINT AS read_off, 0::BIGINT AS write_off, least(n, 2048) AS write_count FROM s WHERE i = 1
  UNION ALL
  SELECT s.grp,
    p.step + CASE WHEN full_ THEN 1 ELSE 0 END,
    CASE WHEN full_ THEN carried ELSE p.cont END,
    CASE WHEN full_ THEN 0 ELSE p.seg + 1 END,
    s.i, s.id, s.n,
    CASE WHEN carried THEN p.read_off + p.write_count ELSE 0 END,
    CASE WHEN full_ THEN 0 ELSE p.write_off + p.write_count + 1 END,
    CASE WHEN full_ AND carried THEN least(p.n - p.read_off - p.write_count, 2048) WHEN full_ THEN least(s.n, 2048) ELSE least(s.n, 2048 - (p.write_off + p.write_count + 1)) END
  FROM (SELECT *,
      n - read_off - write_count >= 64 AND write_off + write_count = 2048 AS carried,
      write_off + write_count = 2048 OR 2048 - (write_off + write_count + 1) <= 64 AS full_ FROM p) p
  JOIN s ON s.grp = p.grp AND s.i = p.i + CASE WHEN carried THEN 0 ELSE 1 END)"""
BY_HASH = f"s AS (SELECT 0 AS grp, row_number() OVER (ORDER BY md5('1234|5678|' || doc_id::VARCHAR), doc_id) AS i, doc_id AS id, n FROM {D})"
HEX = "regexp_extract_all(hex(encode(text)), '..')"

#: Packing with four lanes over s(i, shard, span, n): a state machine, of which each row is one move. e_i is the span it wrote, null if it wrote none.
#: A lane begins (phase 0) with what it carries in c, then draws spans (phase 1) until it is full, then the next one begins.
PACK4 = """
p AS (
  SELECT 0::BIGINT AS step, 0 AS lane, 0 AS phase, 0::BIGINT AS put, false AS cont, 0::BIGINT AS seg, 1::BIGINT AS i, list_value(NULL, NULL, NULL, NULL)::STRUCT(i BIGINT, done BIGINT, rest BIGINT)[] AS c, false AS wrote,
    NULL::BIGINT AS e_i, 0::BIGINT AS e_step, 0 AS e_lane, false AS e_cont, 0::BIGINT AS e_seg, 0::BIGINT AS e_read, 0::BIGINT AS e_write, 0::BIGINT AS e_count
  UNION ALL
  SELECT
    CASE WHEN advance AND lane = 3 THEN step + 1 ELSE step END, CASE WHEN advance THEN (lane + 1) % 4 ELSE lane END, CASE WHEN advance THEN 0 ELSE 1 END,
    CASE WHEN carried THEN least(held.rest + 1, 2048) WHEN draws THEN least(put + n + 1, 2048) ELSE 0 END,
    CASE WHEN phase = 0 THEN carried ELSE cont END,
    CASE WHEN carried THEN 1 WHEN draws THEN seg + 1 ELSE 0 END,
    CASE WHEN draws THEN i + 1 ELSE i END,
    CASE WHEN carried THEN list_concat(c[1:lane], [CASE WHEN held.rest - 2048 >= 64 THEN {'i': held.i, 'done': held.done + 2048, 'rest': held.rest - 2048} END], c[lane + 2:4])
         WHEN draws AND put + n - 2048 >= 64 THEN list_concat(c[1:lane], [{'i': i, 'done': 2048 - put, 'rest': put + n - 2048}], c[lane + 2:4]) ELSE c END,
    CASE WHEN advance AND lane = 3 THEN false ELSE wrote OR carried OR draws END,
    CASE WHEN carried THEN held.i WHEN draws THEN i END, step, lane, CASE WHEN phase = 0 THEN carried ELSE cont END, CASE WHEN carried THEN 0 ELSE seg END,
    CASE WHEN carried THEN held.done ELSE 0 END, CASE WHEN carried THEN 0 ELSE put END, CASE WHEN carried THEN least(held.rest, 2048) ELSE least(n, 2048 - put) END
  FROM (
    SELECT p.*, s.n, c[lane + 1] AS held, phase = 0 AND c[lane + 1] IS NOT NULL AS carried,
      phase = 1 AND 2048 - put > 64 AND s.n IS NOT NULL AS draws, phase = 1 AND NOT (2048 - put > 64 AND s.n IS NOT NULL) AS advance
    FROM p LEFT JOIN s ON s.i = p.i)
  WHERE NOT (advance AND lane = 3 AND NOT wrote))"""

#: The rows of a one-lane plan as their tokens, padding between segments.
ROWS = f"""
t AS (SELECT doc_id, list_transform({HEX}, lambda h: ('0x' || h)::INTEGER) AS ids FROM documents),
r AS (SELECT step, cont, seg, write_off, t.ids[read_off + 1:read_off + write_count] AS part FROM p JOIN t ON t.doc_id = p.id),
b AS (SELECT step, bool_or(cont) AS cont, flatten(list(CASE WHEN write_off > 0 THEN list_concat([-1], part) ELSE part END ORDER BY seg)) AS tokens FROM r GROUP BY step)"""

EPOCH = f"""
ix AS (SELECT shard, span, token_count AS n FROM {INDEX}),
e AS (SELECT unnest(range(5678, 5678 + {{epochs}})) AS epoch),
perm AS (SELECT epoch, shard, span, n, row_number() OVER (PARTITION BY epoch, shard ORDER BY md5('1234|' || (epoch + shard)::VARCHAR || '|' || span::VARCHAR), span) - 1 AS pos, ceil(count(*) OVER (PARTITION BY epoch, shard) / {{ranks}})::BIGINT AS m FROM ix, e),
sl AS (SELECT *, (pos // m)::INTEGER AS rank, pos % m AS k FROM perm),
lst AS (SELECT epoch, shard, c, row_number() OVER (PARTITION BY epoch ORDER BY md5('1234|' || epoch::VARCHAR || '|' || (shard * 16 + c)::VARCHAR), shard, c) - 1 AS place FROM (SELECT DISTINCT shard FROM ix), (SELECT unnest(range(16)) AS c), e),
pl AS (SELECT *, row_number() OVER (PARTITION BY epoch, shard ORDER BY place) - 1 AS nth, count(*) OVER (PARTITION BY epoch) AS l FROM lst),
inter AS (SELECT sl.epoch, sl.rank, sl.shard, sl.span, sl.n, (k // 16) * l + place AS vt FROM sl JOIN pl ON pl.epoch = sl.epoch AND pl.shard = sl.shard AND pl.nth = k % 16)"""

FOUR = f"{EPOCH.format(epochs=1, ranks=1)}, s AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vt) AS i, shard, span, n FROM inter)"

STORED = f"st AS (SELECT i.shard, i.span, i.off, i.token_count, i.cbytes, d.text AS data FROM {OFFSETS} i JOIN {D} d USING (doc_id))"
FOOTERS = f"fo AS (SELECT shard, count(*) AS n_spans, sum(cbytes)::BIGINT AS data_bytes, bit_xor({bits("off::VARCHAR || '|' || token_count::VARCHAR")}) AS index_hash, bit_xor({bits('data')}) AS data_hash, 14 AS version, 1 AS token_bytes FROM st GROUP BY shard)"


def verified(broken: str, version: str) -> str:
    return f"""
WITH {STORED}, {FOOTERS},
br AS ({broken}),
nx AS (SELECT *, lead(off) OVER (PARTITION BY shard ORDER BY span) AS nxt FROM br),
re AS (SELECT shard, count(*) AS r_n, sum(cbytes)::BIGINT AS r_bytes, count(*) FILTER (nxt <= off) AS falls, count(*) FILTER (nxt - off <> cbytes) AS gaps, max_by(off + cbytes, span) AS r_end, bit_xor({bits("off::VARCHAR || '|' || token_count::VARCHAR")}) AS r_index, bit_xor({bits('data')}) AS r_data FROM nx GROUP BY shard),
j AS (SELECT fo.* REPLACE ({version} AS version), re.* EXCLUDE (shard) FROM fo JOIN re USING (shard)),
v AS (
  SELECT 'V2' AS rule, shard FROM j WHERE version <> 14
  UNION ALL SELECT 'V3', shard FROM j WHERE data_bytes <> r_bytes
  UNION ALL SELECT 'V4', shard FROM j WHERE falls > 0
  UNION ALL SELECT 'V5', shard FROM j WHERE index_hash <> r_index
  UNION ALL SELECT 'V6', shard FROM j WHERE data_hash <> r_data
  UNION ALL SELECT 'count', shard FROM j WHERE n_spans <> r_n
  UNION ALL SELECT 'size', shard FROM j WHERE gaps > 0 OR r_end <> data_bytes)
SELECT rule, count(shard)::BIGINT AS n_shards, coalesce(sum(shard), 0)::BIGINT AS sum_shards
FROM (SELECT unnest(['V2', 'V3', 'V4', 'V5', 'V6', 'count', 'size']) AS rule) LEFT JOIN v USING (rule) GROUP BY rule"""


METRICS = f"FROM labels JOIN {D} d USING (doc_id)"
TURNS = "(SELECT conv_id, turn, coalesce(strlen(text), 0)::BIGINT AS len FROM conversations)"
CU = f"(SELECT conv_id, turn, sum(len) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) - len AS s, sum(len) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS e, max(len) OVER (PARTITION BY conv_id) AS longest FROM {TURNS} WHERE len > 0)"
SEGMENTS = "step::INTEGER AS step, cont AS is_continuation, seg::INTEGER AS seg, id AS doc_id, read_off::INTEGER AS read_off, write_off::INTEGER AS write_off, write_count::INTEGER AS write_count FROM p"

ORACLES: dict[str, str] = {
    "q01_scan_text": "SELECT doc_id, strlen(text)::BIGINT AS n_bytes, length(text)::BIGINT AS n_code_points FROM documents",
    "q02_file_slice": """
WITH f AS (SELECT file, row_number() OVER (ORDER BY file) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT 'data/' || source AS file FROM documents)),
g AS (SELECT unnest(range(6)) AS node)
SELECT node, count(file)::BIGINT AS n_files, min(file) AS first_file, max(file) AS last_file
FROM g LEFT JOIN f ON i >= node * ceil(n / 6) AND i < least((node + 1) * ceil(n / 6), n) GROUP BY node""",
    "q03_rank_start": "SELECT n_name AS hostname, (n_regionkey + 1)::BIGINT AS rank_count, coalesce(sum(n_regionkey + 1) OVER (ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rank_start, (sum(n_regionkey + 1) OVER ())::BIGINT AS world FROM nation",
    "q04_chunk4": f"SELECT i // 4 AS chunk, count(*) AS n_docs, sum(n)::BIGINT AS n_bytes, min(doc_id) AS first_doc FROM (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM {D}) GROUP BY 1",
    "q05_strided_shard": f"SELECT (i % 8)::INTEGER AS shard, count(*) AS n_docs, sum(n)::BIGINT AS n_tokens FROM (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM {D}) GROUP BY 1",
    "q06_contiguous_shard": f"SELECT (t - 1)::INTEGER AS shard, count(*) AS n_docs, sum(n)::BIGINT AS n_tokens FROM (SELECT *, ntile(8) OVER (ORDER BY doc_id) AS t FROM {D}) GROUP BY 1",
    "q07_byte_token_stats": "SELECT lang, count(*) AS n_docs, sum(strlen(text))::BIGINT AS n_tokens, max(strlen(text))::BIGINT AS longest FROM documents GROUP BY lang",
    "q08_byte_tokens": f"SELECT doc_id, strlen(text)::BIGINT AS n_tokens, list_sum(list_transform({HEX}, lambda h: ('0x' || h)::INTEGER))::BIGINT AS sum_ids, md5(unhex(regexp_replace(hex(encode(text)), '(..)', '\\1000000', 'g'))) AS ids_md5 FROM documents",
    "q09_regex_tokens": f"SELECT doc_id, len(p)::BIGINT AS n_tokens, md5(array_to_string(p, chr(1))) AS pieces_md5 FROM (SELECT doc_id, regexp_extract_all(text, '{PIECES}') AS p FROM documents)",
    "q10_token_ids_hash": f"SELECT lang, count(*) AS n_tokens, min(id) AS least_id, max(id) AS greatest_id, sum(id)::BIGINT AS sum_ids FROM (SELECT lang, ('0x' || substr(md5(p), 1, 7))::BIGINT % 50304 AS id FROM (SELECT lang, unnest(regexp_extract_all(text, '{PIECES}')) AS p FROM documents)) GROUP BY lang",
    "q11_holdout_split": f"WITH RECURSIVE {holdout('0')} SELECT doc_id, n, held_out FROM f",
    "q12_holdout_summary": f"WITH RECURSIVE {holdout('0')} SELECT held_out, count(*) AS n_docs, sum(n)::BIGINT AS n_tokens, max(n) AS longest FROM f GROUP BY held_out",
    "q13_holdout_lanes": f"WITH RECURSIVE {holdout('(doc_id % 4)::INTEGER')} SELECT lane, count(*) AS n_docs, count(*) FILTER (held_out) AS n_held, (sum(n) FILTER (held_out))::BIGINT AS held_tokens FROM f GROUP BY lane",
    "q14_shard_assign": f"SELECT doc_id, shard, span FROM {INDEX}",
    "q15_offsets": f'SELECT doc_id, shard, span, cbytes, off AS "offset" FROM {OFFSETS}',
    "q16_span_sizes": f'SELECT shard, span, off AS "offset", (coalesce(lead(off) OVER (PARTITION BY shard ORDER BY span), sum(cbytes) OVER (PARTITION BY shard)) - off)::BIGINT AS size FROM {OFFSETS}',
    "q17_rotation": f"""
WITH RECURSIVE ix AS (SELECT shard, span, cbytes FROM {INDEX}),
f AS (
  SELECT shard, span, cbytes, 0 AS file, 0::BIGINT AS off FROM ix WHERE span = 0
  UNION ALL
  SELECT ix.shard, ix.span, ix.cbytes, f.file + CASE WHEN f.off + f.cbytes >= 100000 THEN 1 ELSE 0 END, CASE WHEN f.off + f.cbytes >= 100000 THEN 0 ELSE f.off + f.cbytes END
  FROM f JOIN ix ON ix.shard = f.shard AND ix.span = f.span + 1)
SELECT shard, span, file, off AS "offset" FROM f""",
    "q18_manifest": f"SELECT shard, 'data_' || shard || '.bin' AS data_file, 'index_' || shard || '.bin' AS index_file, count(*) AS n_spans, sum(token_count)::BIGINT AS n_tokens, sum(cbytes)::BIGINT AS data_bytes, (SELECT sum(n)::BIGINT FROM {D}) AS total_tokens FROM {INDEX} GROUP BY shard",
    "q19_footer_xor": f"WITH {STORED}, {FOOTERS} SELECT shard, n_spans, data_bytes, index_hash, data_hash, version, token_bytes FROM fo",
    "q20_verify_clean": verified("SELECT * FROM st", "version"),
    "q21_verify_corrupt": verified("SELECT * REPLACE (CASE WHEN shard = 1 AND span = 2 THEN 0 ELSE off END AS off, CASE WHEN shard = 2 AND span = 1 THEN data || '?' ELSE data END AS data) FROM st WHERE NOT (shard = 3 AND span = 3)", "CASE WHEN shard = 0 THEN 13 ELSE version END"),
    "q22_permutation": f"WITH {EPOCH.format(epochs=1, ranks=1)} SELECT shard, span, pos FROM perm",
    "q23_rank_slice": f"WITH {EPOCH.format(epochs=1, ranks=7)} SELECT shard, rank, count(*) AS n_spans FROM sl GROUP BY ALL UNION ALL SELECT * FROM (VALUES (99, 0, 2), (99, 1, 2), (99, 2, 1)) v(shard, rank, n_spans)",
    "q24_shard_order": f"WITH {EPOCH.format(epochs=1, ranks=1)} SELECT place, shard, nth::INTEGER AS nth FROM pl",
    "q25_interleave": f"WITH {EPOCH.format(epochs=1, ranks=2)} SELECT rank, shard, span, row_number() OVER (PARTITION BY epoch, rank ORDER BY vt) - 1 AS seq FROM inter",
    "q26_pack_b1": f"WITH RECURSIVE {BY_HASH}, {PACK} SELECT {SEGMENTS}",
    "q27_steps_b1": f"WITH RECURSIVE {BY_HASH}, {PACK} SELECT step::INTEGER AS step, count(*) AS n_segments, sum(write_count)::BIGINT AS n_tokens, max(write_off + write_count) AS num_tokens FROM p GROUP BY step",
    "q28_pack_bn": f"WITH RECURSIVE {FOUR}, {PACK4} SELECT e_step::INTEGER AS step, e_lane AS lane, e_cont AS is_continuation, e_seg::INTEGER AS seg, shard, span, e_read::INTEGER AS read_off, e_write::INTEGER AS write_off, e_count::INTEGER AS write_count FROM p JOIN s ON s.i = p.e_i",
    "q29b_batches_bn": f"WITH RECURSIVE {FOUR}, {PACK4} SELECT e_step::INTEGER AS step, count(DISTINCT e_lane) AS n_rows, max(e_write + e_count)::INTEGER AS num_tokens, sum(e_count)::BIGINT AS n_tokens FROM p WHERE e_i IS NOT NULL GROUP BY e_step",
    "q29_batches": f"WITH RECURSIVE {BY_HASH}, {PACK}, {ROWS} SELECT step::INTEGER AS step, 0 AS row, cont AS is_continuation, len(tokens)::INTEGER AS num_tokens, list_sum(tokens)::BIGINT AS sum_tokens, md5(array_to_string(tokens, ',')) AS tokens_md5 FROM b",
    "q30_resume": f"WITH RECURSIVE {BY_HASH}, {PACK} SELECT {SEGMENTS} WHERE step >= 100",
    "q31_multi_epoch": f"WITH RECURSIVE {EPOCH.format(epochs=3, ranks=2)}, s AS (SELECT epoch * 2 + rank AS grp, row_number() OVER (PARTITION BY epoch, rank ORDER BY vt) AS i, shard * 1000000000 + span AS id, n FROM inter), {PACK} SELECT (grp // 2)::INTEGER AS epoch, (grp % 2)::INTEGER AS rank, max(step) + 1 AS total_steps, sum(write_count)::BIGINT AS n_tokens, count(*) AS n_segments FROM p GROUP BY grp",
    "q32_pad_ratio": f"WITH RECURSIVE {BY_HASH}, {PACK}, w AS (SELECT sum(write_count) AS t, max(write_off + write_count) AS w FROM p GROUP BY step) SELECT sum(t)::BIGINT AS emitted, (sum(w) - sum(t))::BIGINT AS padding, ((SELECT sum(n) FROM s) - sum(t))::BIGINT AS dropped, round(sum(t) / sum(w), 6) AS fill FROM w",
    "q33_shift_targets": f"WITH RECURSIVE {BY_HASH}, {PACK}, {ROWS}, c AS (SELECT step, tokens[1:greatest(len(tokens) - 2, 0)] AS a, tokens[2:greatest(len(tokens) - 1, 1)] AS b1, tokens[3:len(tokens)] AS b2 FROM b) SELECT step::INTEGER AS step, len(list_filter(b1, lambda x: x <> -1))::BIGINT AS n_target1, len(list_filter(b2, lambda x: x <> -1))::BIGINT AS n_target2, list_sum(a)::BIGINT AS sum_inputs, list_sum(b1)::BIGINT AS sum_target1, list_sum(b2)::BIGINT AS sum_target2 FROM c",
    "q34_train_metrics": f"""
WITH x AS (SELECT doc_id // 100 AS step, doc_id % 4 AS rank, CASE WHEN n % 5 = 0 THEN -1 ELSE quality END AS t, toxic, n {METRICS}),
r AS (SELECT step, rank, avg(n::DOUBLE) AS loss, count(*) FILTER (t <> -1) AS tokens, count(*) FILTER (toxic = t AND t <> -1) AS correct FROM x GROUP BY step, rank),
a AS (SELECT step, avg(loss) AS loss, sum(tokens)::BIGINT AS tokens, sum(correct)::BIGINT AS correct FROM r GROUP BY step)
SELECT step, round(loss, 6) AS loss, tokens, correct, round(100.0::DOUBLE * correct / nullif(tokens, 0), 6) AS accuracy, (sum(tokens) OVER (ORDER BY step ROWS UNBOUNDED PRECEDING))::BIGINT AS tokens_so_far FROM a""",
    "q35_masked_loss": f"SELECT doc_id % 10 AS step, round((avg(ln(n + 1.0::DOUBLE)) FILTER (NOT (n % 5 = 0)) + avg(ln(n + 2.0::DOUBLE)) FILTER (NOT (n % 5 = 0))) * 0.5::DOUBLE, 6) AS loss {METRICS} GROUP BY 1",
    "q36_lr_schedule": "SELECT s AS step, round(CASE WHEN s < 100 THEN 0.01::DOUBLE * (s + 1) / 100 WHEN s < 1280 THEN 0.01::DOUBLE ELSE 0.01::DOUBLE * (1 - sqrt((s - 1280) / 320.0::DOUBLE)) END, 12) AS lr FROM (SELECT unnest(range(1601)) AS s)",
    "q37_cu_seqlens": f'SELECT conv_id, turn, s::BIGINT AS start, e::BIGINT AS "end", longest FROM {CU}',
    "q38_unpad_gather": f"SELECT conv_id, turn, min(i)::BIGINT AS first, max(i)::BIGINT AS last, sum(i)::BIGINT AS total FROM (SELECT conv_id, turn, conv_id * 32768 + unnest(range(s::BIGINT, e::BIGINT)) AS i FROM {CU}) GROUP BY conv_id, turn",
    "q39_checkpoint_retention": """
WITH c AS (SELECT 'step_' || (doc_id + 2) || '.pth' AS name, doc_id FROM documents)
SELECT 'name' AS by, min(name) AS name FROM c HAVING count(*) > 1 UNION ALL SELECT 'number', arg_min(name, doc_id) FROM c HAVING count(*) > 1""",
    "q40_update_average": "SELECT label, (i - 1)::INTEGER AS idx, round(avg(embedding[i]::DOUBLE), 6) AS value FROM embeddings, unnest(range(1, 65)) AS r(i) GROUP BY label, i",
    "q41_diloco_fold": """
WITH RECURSIVE u AS (SELECT label, j, vec_id, embedding[j]::DOUBLE AS u, row_number() OVER (PARTITION BY label, j ORDER BY vec_id) AS i FROM embeddings, unnest(range(1, 65)) AS r(j)),
f AS (
  SELECT label, j, i, vec_id, u AS held, 1 AS n, 0.0::DOUBLE AS speed, -0.1::DOUBLE * u AS value FROM u WHERE i = 1
  UNION ALL
  SELECT u.label, u.j, u.i, u.vec_id, CASE WHEN f.n = 3 THEN 0.0 ELSE f.held + u.u END, (f.n + 1) % 4,
    CASE WHEN f.n = 3 THEN 0.9::DOUBLE * f.speed + (f.held + u.u) / 4 ELSE f.speed END,
    CASE WHEN f.n = 3 THEN f.value - 0.7::DOUBLE * ((f.held + u.u) / 4 + 0.9::DOUBLE * (0.9::DOUBLE * f.speed + (f.held + u.u) / 4)) ELSE f.value - 0.1::DOUBLE * u.u END
  FROM f JOIN u ON u.label = f.label AND u.j = f.j AND u.i = f.i + 1)
SELECT label::VARCHAR AS name, (j - 1)::INTEGER AS idx, vec_id AS seq, round(value, 6) AS value FROM f""",
    "q42_rms_norm": "SELECT vec_id, (i - 1)::INTEGER AS idx, round(embedding[i]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / len(embedding) + 1e-6::DOUBLE), 6) AS value FROM embeddings, unnest(range(1, 65)) AS r(i)",
    "q43_byte_planes": "SELECT doc_id, list_sum(list_transform(t, lambda x: x & 255))::BIGINT AS plane0, list_sum(list_transform(t, lambda x: (x >> 8) & 255))::BIGINT AS plane1, list_sum(list_transform(t, lambda x: (x >> 16) & 255))::BIGINT AS plane2, list_sum(list_transform(t, lambda x: (x >> 24) & 255))::BIGINT AS plane3 FROM (SELECT doc_id, list_transform(string_split(text, ''), lambda c: unicode(c)) AS t FROM documents)",
    "q44_codec_roundtrip": "SELECT doc_id, (strlen(text) * 4)::BIGINT AS n_bytes, true AS framed, md5(unhex(regexp_replace(hex(encode(text)), '(..)', '\\1000000', 'g'))) AS back_md5 FROM documents",
    "q45_split_invariants": f"""
WITH RECURSIVE {holdout('0')}
SELECT 'corpus' AS what, count(*) AS n FROM {D} UNION ALL SELECT 'train', count(*) FILTER (NOT held_out) FROM f UNION ALL SELECT 'holdout', count(*) FILTER (held_out) FROM f
UNION ALL SELECT 'both', 0 UNION ALL SELECT 'lost', (SELECT count(*) FROM {D}) - (SELECT count(*) FROM f) UNION ALL SELECT 'invented', 0""",
    "q46_worker_registry": "SELECT user_id, arg_max(event_id, (ts, event_id)) AS last_event, arg_max(event_type, (ts, event_id)) AS event_type, count(*) AS n_events FROM events GROUP BY user_id",
    "q47_rejected": "WITH t AS (SELECT CASE WHEN turn = 3 THEN NULL WHEN turn = 4 THEN '' ELSE text END AS text FROM conversations) SELECT count(*) FILTER (text IS NULL) AS n_null, count(*) FILTER (text = '') AS n_empty, count(*) FILTER (text <> '') AS n_kept, (sum(strlen(text)) FILTER (text <> ''))::BIGINT AS n_tokens FROM t",
    "q48_compression_ratio": f"SELECT lang, round(sum(strlen(text)) / sum(len(regexp_extract_all(text, '{PIECES}'))), 6)::DOUBLE AS ratio FROM documents GROUP BY lang",
    "q49_idempotent_ingest": "SELECT DISTINCT 'data/' || source AS file FROM documents WHERE NOT ('data/' || source < 'data/src15')",
    "q50_running_tokens": "SELECT l_orderkey, l_linenumber, tokens, (sum(tokens) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS UNBOUNDED PRECEDING))::BIGINT AS tokens_so_far FROM (SELECT l_orderkey, l_linenumber, sum(l_quantity::BIGINT)::BIGINT AS tokens FROM lineitem GROUP BY ALL)",
    "q51_resume_state": "SELECT max(doc_id) // 100 AS epoch, max(doc_id) % 100 AS step, arg_max(strlen(text), doc_id)::BIGINT AS total_tokens, max(doc_id) % 100 + 1 AS start_step, max(doc_id) // 100 + 1 AS next_epoch FROM documents",
    "q52_work_items": "SELECT user_id AS worker, 'work_' || md5('3|' || user_id::VARCHAR) AS work_item_id, 'model' AS model, 50 AS num_steps, 0.001::DOUBLE AS learning_rate, 32 AS batch_size FROM (SELECT DISTINCT user_id FROM events)",
    "q53_step_limit": f"WITH RECURSIVE {BY_HASH}, {PACK} SELECT step::INTEGER AS step, count(*) AS n_segments, sum(write_count)::BIGINT AS n_tokens FROM p WHERE step < 200 GROUP BY step",
    "q54_verify_progress": "SELECT done, total, round(seconds / done * (total - done), 6)::DOUBLE AS seconds_left FROM (SELECT row_number() OVER (ORDER BY source) AS done, count(*) OVER () AS total, (sum(n) OVER (ORDER BY source))::DOUBLE / 1e6::DOUBLE AS seconds FROM (SELECT source, sum(n_chars) AS n FROM documents GROUP BY source)) WHERE done % 10 = 1",
    "q55_bpe_roundtrip": "SELECT doc_id, strlen(text)::BIGINT AS n_bytes, md5(text) AS text_md5, true AS ids_fit FROM documents",
}
