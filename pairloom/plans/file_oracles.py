"""DuckDB forms of the queries of sources and sinks."""

from __future__ import annotations

from ..functions.cells import flat_class, wide_class
from .picture_oracles import _taps
from .views import EDITS, METRICS, PIXELS

BYTE = "least(greatest(floor({} + 0.5 + 1e-9), 0.0), 255.0)"
LIST = "printf('{0}/%06d.png', doc_id)"


def _pictures() -> str:
    colour = lambda v: f"[floor(least(abs({v}), 1.0) * 255)::BIGINT, floor(least(1 - least(abs({v}), 1.0), 1.0) * 255)::BIGINT, floor(least({v} * {v}, 1.0) * 255)::BIGINT]"
    return f"""WITH {PIXELS}, pr AS (SELECT a.id // 2 AS id, a.p, a.v AS a, b.v AS b FROM px a JOIN px b ON b.id = a.id + 1 AND b.p = a.p WHERE a.id % 2 = 0),
 {_taps("bicubic", "SELECT * FROM (VALUES (7, 8), (5, 8)) s(n, m)", "taps")},
 small AS (SELECT DISTINCT id, r, c, k, ((id * 31 + 7 * r + 13 * c + 50 * k) % 256)::DOUBLE AS v FROM pr, (SELECT unnest(range(7)) AS r) x, (SELECT unnest(range(5)) AS c) y, (SELECT unnest(range(3)) AS k) z),
 across AS (SELECT id, r, k, i AS c, {BYTE.format("sum(v * weight)")} AS v FROM small JOIN taps ON n = 5 AND x = c GROUP BY id, r, k, i),
 back AS (SELECT id, i AS r, k, c, {BYTE.format("sum(v * weight)")}::BIGINT AS v FROM across JOIN taps ON n = 7 AND x = r GROUP BY id, i, k, c),
 share AS (SELECT id, count(*) FILTER (WHERE b > 0.07 AND NOT a > 0.07)::DOUBLE / greatest(count(*) FILTER (WHERE a > 0.07), 1) AS ratio FROM pr GROUP BY id),
 bytes AS (SELECT 'bg/' AS folder, id, 3 AS channels, p * 3 + k AS place, ({colour("a")})[k + 1] AS v FROM pr, (SELECT unnest(range(3)) AS k) z
  UNION ALL SELECT 'shot/', id, 3, p * 3 + k, ({colour("b")})[k + 1] FROM pr, (SELECT unnest(range(3)) AS k) z
  UNION ALL SELECT 'masks/mask_', id, 1, p, CASE WHEN a > 0.07 THEN 255 ELSE 0 END FROM pr
  UNION ALL SELECT 'masks_object/', pr.id, 1, p, CASE WHEN a > 0.07 THEN 255 ELSE 0 END FROM pr JOIN share ON share.id = pr.id WHERE ratio > 0.8
  UNION ALL SELECT 'results/', id, 3, (r * 8 + c) * 3 + k, v FROM back)
 SELECT printf('%s%06d.png', folder, id) AS name, 8::BIGINT AS width, 8::BIGINT AS height, channels::BIGINT AS channels, sum(v)::BIGINT AS total, sum(v * (place + 1))::BIGINT AS placed FROM bytes GROUP BY folder, id, channels"""


PARTS = """WITH t AS (SELECT p_partkey, p_name AS a, format('{:g}', p_retailprice) AS b, p_size::VARCHAR AS c FROM part),
 n AS (SELECT *, CASE WHEN instr(b, '.') > 0 THEN length(b) - instr(b, '.') ELSE -1 END AS own FROM t),
 w AS (SELECT greatest(max(length(a)), 8)::INT AS wa, greatest(max(length(b) - own) + max(own), 15)::INT AS wb, greatest(max(length(c)), 8)::INT AS wc, max(own) AS most, min(p_partkey) AS first FROM n),
 x AS (SELECT p_partkey, first, wa, wb, wc, rpad(a, wa, ' ') AS a, lpad(b || repeat(' ', (most - own)::INT), wb, ' ') AS b, lpad(c, wc, ' ') AS c FROM n, w),
 h AS (SELECT *, rpad('p_name', wa, ' ') AS a, lpad('p_retailprice', wb, ' ') AS b, lpad('p_size', wc, ' ') AS c, '+' || repeat('-', wa + 2) || '+' || repeat('-', wb + 2) || '+' || repeat('-', wc + 2) || '+' AS rule FROM w)"""
FILE_SQL: dict[str, str] = {
    "shard_scan": f"""WITH {EDITS}, s AS (SELECT "row" % 5 AS shard, row_number() OVER (PARTITION BY "row" % 5 ORDER BY "row") - 1 AS place, "row", category FROM edits) SELECT * FROM s WHERE shard <> 3""",
    "shard_categories": f"""WITH {EDITS} SELECT "row" % 5 AS shard, category, count(*) AS n FROM edits WHERE "row" % 5 <> 3 GROUP BY 1, 2""",
    "one_shard": f"""WITH {EDITS} SELECT "row", source FROM edits WHERE "row" % 5 = 2""",
    "manifest_zip": f"""SELECT row_number() OVER (ORDER BY doc_id) - 1 AS idx, CASE WHEN doc_id % 3 = 0 THEN '/elsewhere/' ELSE '/data/' END || {LIST.format("shot")} AS shot, '/data/' || {LIST.format("mask")} AS mask, '/data/' || {LIST.format("sam")} AS sam, '/data/' || {LIST.format("bg")} AS bg FROM documents""",
    "manifest_lines": f"SELECT row_number() OVER (ORDER BY doc_id) - 1 AS line, '/data/' || {LIST.format('shot')} AS path FROM documents",
    "delimited_lines": "SELECT p_partkey AS key, replace(p_brand, ' ', '_') AS brand, p_size::BIGINT AS size FROM part",
    "json_map": f"SELECT {LIST.format('x')} AS stem, md5('say \"é\" \\ ' || text) AS prompt_md5 FROM documents",
    "variant_columns": """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'none' ELSE json_extract_string(props, '$.k') END AS k,
 CASE WHEN event_id % 3 = 2 AND event_type = 'signup' THEN '[' || user_id || ']' ELSE 'none' END AS signup, CASE WHEN event_id % 3 = 2 AND event_type = 'purchase' THEN '[' || user_id || ']' ELSE 'none' END AS purchase,
 CASE WHEN event_id % 3 = 2 AND event_type = 'error' THEN '[' || user_id || ']' ELSE 'none' END AS error, CASE WHEN event_id % 3 = 2 AND event_type = 'view' THEN '[' || user_id || ']' ELSE 'none' END AS "view",
 CASE WHEN event_id % 3 = 2 AND event_type = 'click' THEN '[' || user_id || ']' ELSE 'none' END AS click FROM events""",
    "prompt_cache": "SELECT vec_id, round(embedding[2]::DOUBLE - (SELECT avg(embedding[2]::DOUBLE) FROM embeddings), 6) + 0.0 AS off FROM embeddings",
    "header_sizes": "SELECT doc_id, CASE WHEN doc_id % 7 < 3 THEN n_chars % 5000 + 1 ELSE 512 END AS width, CASE WHEN doc_id % 7 < 3 THEN doc_id % 4000 + 1 ELSE 512 END AS height FROM documents",
    "picture_files": _pictures(),
    "sample_grid": f"""WITH {PIXELS}, own AS (SELECT id // 9 AS step, id, row_number() OVER (PARTITION BY id // 9 ORDER BY id) - 1 AS tile FROM (SELECT vec_id AS id FROM embeddings) WHERE (id // 9) % 4 <> 0 OR id % 9 = 0),
 four AS (SELECT * FROM own WHERE tile < 4), n AS (SELECT step, count(*) AS n FROM four GROUP BY step), g AS (SELECT step, n, CASE WHEN n = 1 THEN 8 ELSE 12 END AS grid_height, CASE WHEN n = 1 THEN 8 ELSE 10 * n + 2 END AS grid_width FROM n),
 spots AS (SELECT g.*, p, p // grid_width - CASE WHEN n = 1 THEN 0 ELSE 2 END AS y, p % grid_width - CASE WHEN n = 1 THEN 0 ELSE 2 END AS x FROM g, LATERAL (SELECT unnest(range(grid_height * grid_width)) AS p) u)
 SELECT s.step, grid_height::BIGINT AS grid_height, grid_width::BIGINT AS grid_width, s.p, round(coalesce(px.v, 0.0), 6) + 0.0 AS v FROM spots s LEFT JOIN four ON four.step = s.step AND s.x >= 0 AND s.y >= 0 AND s.y < 8 AND s.x % 10 < 8 AND four.tile = s.x // 10 LEFT JOIN px ON px.id = four.id AND px.r = s.y AND px.c = s.x % 10""",
    "metric_log": f"WITH {METRICS} SELECT metric, count(*) AS n, round(sum(value), 4) + 0.0 AS total, max(step) AS last FROM metrics GROUP BY metric",
    "worker_log": """WITH s AS (SELECT printf('%09d', event_id) AS stem, CASE WHEN event_type = 'error' THEN 'image_load_error' WHEN value > 50 THEN 'high_noise' ELSE 'pass' END AS reason FROM events),
 w AS (SELECT *, (ntile(4) OVER (ORDER BY stem) - 1)::BIGINT AS worker FROM s) SELECT worker, reason, count(*) AS n, min(stem) AS first FROM w GROUP BY worker, reason""",
    "checkpoint_files": "SELECT step, count(*) AS n, sum(p_size + step)::BIGINT AS weights, step = 1000 AS is_latest FROM part, (VALUES (10::BIGINT), (100), (1000)) s(step) GROUP BY step",
    "visible_width": f"""WITH lines AS (SELECT conv_id, turn, role, unnest(string_split(text || CASE WHEN turn % 2 = 0 THEN chr(10) || '日本語テキスト ＡＢＣ 한국어' ELSE 'é ä' END, chr(10))) AS line FROM conversations),
 w AS (SELECT conv_id, turn, any_value(role) AS role, max(length(line) + length(regexp_replace(line, '[^' || substr('{wide_class()}', 2), '', 'g')) - length(regexp_replace(line, '[^' || substr('{flat_class()}', 2), '', 'g'))) AS width FROM lines GROUP BY conv_id, turn)
 SELECT conv_id, turn, width::BIGINT AS width, length(role) + 6::BIGINT AS one_line FROM w""",
    "point_aligned": """WITH c AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_retailprice::DECIMAL(18,2)::VARCHAR WHEN 1 THEN p_size::VARCHAR ELSE p_retailprice::DECIMAL(18,2)::DECIMAL(18,1)::VARCHAR END || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '   ' ELSE ' ' END AS cell FROM part)
 SELECT p_partkey, lpad(cell, greatest(14, length(cell))::INT, ' ') AS aligned FROM c""",
    "bytes_as_text": "SELECT doc_id, md5(text || chr(65533)) AS text_md5 FROM documents",
    "text_table_grid": f"""{PARTS}, r AS (SELECT rule FROM h)
 SELECT 0::BIGINT AS section, NULL::BIGINT AS p_partkey, k AS place, CASE k WHEN 0 THEN rule WHEN 1 THEN '| ' || a || ' | ' || b || ' | ' || c || ' |' ELSE replace(rule, '-', '=') END AS line FROM h, (SELECT unnest(range(3)) AS k) u
 UNION ALL SELECT 1, p_partkey, CASE WHEN p_partkey = first THEN 0 ELSE 1 END, '| ' || a || ' | ' || b || ' | ' || c || ' |' FROM x
 UNION ALL SELECT 1, p_partkey, 0, rule FROM x, r WHERE p_partkey <> first UNION ALL SELECT 2, NULL, 0, rule FROM r""",
    "text_table_html": f"""{PARTS}, cell AS (SELECT 1 AS section, p_partkey, 'td' AS tag, a, b, c FROM x UNION ALL SELECT 0, NULL, 'th', a, b, c FROM h),
 line AS (SELECT section, p_partkey, '<tr><' || tag || '>' || replace(replace(replace(a, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</' || tag || '><' || tag || ' style="text-align: right;">' || b || '</' || tag || '><' || tag || ' style="text-align: right;">' || c || '</' || tag || '></tr>' AS line FROM cell)
 SELECT section::BIGINT AS section, p_partkey, CASE section WHEN 0 THEN 2 ELSE 0 END::BIGINT AS place, line FROM line
 UNION ALL SELECT 0, NULL, k, CASE k WHEN 0 THEN '<table>' WHEN 1 THEN '<thead>' WHEN 3 THEN '</thead>' ELSE '<tbody>' END FROM (SELECT unnest([0, 1, 3, 4]) AS k) u
 UNION ALL SELECT 2, NULL, k, CASE k WHEN 0 THEN '</tbody>' ELSE '</table>' END FROM (SELECT unnest([0, 1]) AS k) u""",
}
