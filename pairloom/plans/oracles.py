"""DuckDB forms of the registered queries, by name."""

from __future__ import annotations

from .curation_oracles import CURATION_SQL
from .file_oracles import FILE_SQL
from .picture_oracles import PICTURE_SQL
from .views import ADD, BOXES, CELLS, EDITS, METRICS, PIXELS, PROMPTS, REMOVE, RESOLUTIONS, images_sql

BG, SHOT = images_sql("bg"), images_sql("shot")
STEM = "regexp_extract(path, '([^/]*?)(\\.[^./]*)?$', 1)"
LAST = f"b AS (SELECT {STEM} AS stem, max(path) AS bg_path FROM bg GROUP BY 1), s AS (SELECT {STEM} AS stem, max(path) AS shot_path FROM shot GROUP BY 1)"
IOU_AREA = "greatest(least(d.x2, s.x2) - greatest(d.x1, s.x1), 0) * greatest(least(d.y2, s.y2) - greatest(d.y1, s.y1), 0)"
MATCHED = f"""{BOXES}, d AS (SELECT *, (x2 - x1) * (y2 - y1) AS area FROM boxes WHERE kind = 'diff'), s AS (SELECT *, (x2 - x1) * (y2 - y1) AS area FROM boxes WHERE kind = 'semantic'),
pairs AS (SELECT d.sample, d.pos, s.pos AS match_pos, s.area AS s_area, CASE WHEN d.area + s.area - {IOU_AREA} > 0 THEN ({IOU_AREA})::DOUBLE / (d.area + s.area - {IOU_AREA}) ELSE 0.0 END AS iou FROM d JOIN s ON d.sample = s.sample),
best AS (SELECT * FROM pairs WHERE iou > 0 QUALIFY row_number() OVER (PARTITION BY sample, pos ORDER BY iou DESC, match_pos) = 1),
matched AS (SELECT d.sample, d.pos, d.area, best.match_pos, coalesce(best.iou, 0.0) AS iou, coalesce(best.s_area, 0) AS s_area FROM d LEFT JOIN best ON d.sample = best.sample AND d.pos = best.pos)"""
VALIDATED = f"""{MATCHED}, judged AS (SELECT *, CASE WHEN iou >= 0.3 AND area::DOUBLE / greatest(s_area, 1) > 2.0 THEN 'scale_overflow_aligned' WHEN iou >= 0.3 THEN 'keep'
 WHEN iou > 0 AND area::DOUBLE / greatest(s_area, 1) > 2.0 THEN 'background_collapse' ELSE 'drop' END AS verdict, row_number() OVER (PARTITION BY sample ORDER BY area DESC, pos) AS place FROM matched),
per AS (SELECT sample, min_by(verdict, place) FILTER (WHERE verdict IN ('scale_overflow_aligned', 'background_collapse')) AS broken, count(*) FILTER (WHERE verdict = 'keep') AS kept FROM judged GROUP BY sample),
every AS (SELECT DISTINCT sample FROM boxes), dets AS (SELECT DISTINCT sample FROM s),
results AS (SELECT e.sample, CASE WHEN p.sample IS NULL THEN 'no_diff_regions' WHEN t.sample IS NULL THEN 'no_semantic_targets' WHEN p.broken IS NOT NULL THEN p.broken WHEN p.kept = 0 THEN 'no_valid_regions' ELSE 'pass' END AS reason, p.kept
 FROM every e LEFT JOIN per p ON e.sample = p.sample LEFT JOIN dets t ON e.sample = t.sample)"""
BATCHES = f"""{RESOLUTIONS}, numbered AS (SELECT *, row_number() OVER (PARTITION BY width, height ORDER BY md5('1-' || idx), idx) - 1 AS i, count(*) OVER (PARTITION BY width, height) AS n FROM res),
bat AS (SELECT idx, width, height, i // 8 AS chunk, i % 8 AS place FROM numbered WHERE i // 8 < n // 8)"""
PAIRED = f"{PIXELS}, pr AS (SELECT a.id // 2 AS id, a.p, a.r, a.c, a.v AS a, b.v AS b FROM px a JOIN px b ON b.id = a.id + 1 AND b.p = a.p WHERE a.id % 2 = 0)"
HEAT = 0.07
BINARY = f"CASE WHEN v > {HEAT} THEN 1 ELSE 0 END"
LABELLED = f"""{PIXELS}, m AS (SELECT * FROM px WHERE v > {HEAT}), reach AS (SELECT id, p, r, c, p AS label FROM m UNION SELECT n.id, n.p, n.r, n.c, x.label FROM reach x JOIN m n ON n.id = x.id AND abs(n.r - x.r) <= 1 AND abs(n.c - x.c) <= 1),
lab AS (SELECT id, p, r, c, min(label) AS label FROM reach GROUP BY ALL), comp AS (SELECT id, label, count(*) AS area, min(c) AS x1, min(r) AS y1, max(c) + 1 AS x2, max(r) + 1 AS y2 FROM lab GROUP BY id, label)"""
BARE = "regexp_replace(cell, '\\x1b\\[[0-9;]*[A-Za-z]', '', 'g')"
THOUSANDS = "regexp_full_match(cell, '[+-]?[0-9]{1,3}(,[0-9]{3})*(\\.[0-9]*)?|(\\.[0-9]+)?')"
IS_INT = f"(regexp_full_match(cell, '\\s*[+-]?[0-9]+\\s*') OR ({THOUSANDS} AND regexp_matches(cell, '[0-9]') AND NOT contains(cell, '.')))"
IS_NUMBER = f"(regexp_full_match(cell, '\\s*[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?\\s*') OR ({THOUSANDS} AND regexp_matches(cell, '[0-9]')))"
RANK = f"CASE WHEN cell IS NULL OR cell = '' THEN 0 WHEN cell IN ('True', 'False') THEN 1 WHEN {IS_INT} THEN 2 WHEN {IS_NUMBER} THEN 3 ELSE 5 END"
NAME = "['none', 'bool', 'int', 'float', 'bytes', 'str']"
DECIMALS = f"CASE WHEN NOT {IS_NUMBER} OR {IS_INT} THEN -1 WHEN instr(cell, '.') > 0 THEN length(cell) - instr(cell, '.') WHEN instr(lower(cell), 'e') > 0 THEN length(cell) - instr(lower(cell), 'e') ELSE -1 END"
#: Squared distances from each pixel to the nearest one inside (or outside) a mask.
SOBEL_AT = "list_extract(l, {} + 1)"


def _sobel() -> str:
    mirror = lambda k: -k if k < 0 else 14 - k if k > 7 else k
    at = lambda r, c: f"e[{mirror(r) * 8 + mirror(c) + 1}]"
    terms = []
    for r in range(8):
        for c in range(8):
            gx = f"({at(r - 1, c + 1)} - {at(r - 1, c - 1)} + 2 * ({at(r, c + 1)} - {at(r, c - 1)}) + {at(r + 1, c + 1)} - {at(r + 1, c - 1)})"
            gy = f"({at(r + 1, c - 1)} - {at(r - 1, c - 1)} + 2 * ({at(r + 1, c)} - {at(r - 1, c)}) + {at(r + 1, c + 1)} - {at(r - 1, c + 1)})"
            terms.append(f"sqrt({gx} * {gx} + {gy} * {gy})")
    return " + ".join(terms)


def _morph(source: str, to: str, how: str) -> str:
    """A dilation (max) or erosion (min) by the disk of radius 1, pixels outside left out."""
    return f"{to} AS (SELECT a.id, a.p, a.r, a.c, {how}(b.v) AS v FROM {source} a JOIN {source} b ON a.id = b.id AND (a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c) <= 1 GROUP BY a.id, a.p, a.r, a.c)"


#: Two grids of a pair as lists, one row a pair; and one row a pixel beside both lists, without a join of pixels.
LISTS = "lists AS (SELECT a.vec_id // 2 AS id, a.embedding::DOUBLE[] AS a, b.embedding::DOUBLE[] AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0)"
SPOTS = f"{LISTS}, spots AS (SELECT id, i - 1 AS p, (i - 1) // 8 AS r, (i - 1) % 8 AS c, a, b FROM lists, LATERAL (SELECT unnest(range(1, 65)) AS i))"


def _heat() -> str:
    """The difference of two pictures whose red, green and blue are |v|, 1 - |v| and v * v, each times 255."""
    rgb = lambda v: (f"(255 * least(abs({v}), 1.0))", f"(255 * (1 - least(abs({v}), 1.0)))", f"(255 * least({v} * {v}, 1.0))")
    mixed = lambda x: f"(0.299::DOUBLE * {x[0]} + 0.587::DOUBLE * {x[1]} + 0.114::DOUBLE * {x[2]})"
    light = lambda v: mixed([f"pow({x} / 255, 2.2)" for x in rgb(v)])
    straight = lambda x: f"(CASE WHEN {x} / 255 > 0.04045 THEN pow(({x} / 255 + 0.055) / 1.055, 2.4) ELSE {x} / 255 / 12.92 END)"
    axes = (("x", (0.412453, 0.357580, 0.180423), 0.950456), ("y", (0.212671, 0.715160, 0.072169), 1.0), ("z", (0.019334, 0.119193, 0.950227), 1.088754))
    sums = ", ".join(f"({' + '.join(f'{w}::DOUBLE * {straight(x)}' for w, x in zip(weights, rgb(f'{side}[p + 1]'), strict=True))}) / {white} AS {name}{side}" for side in "ab" for name, weights, white in axes)
    bent = lambda x: f"(CASE WHEN {x} > 216.0::DOUBLE / 24389 THEN cbrt({x}) ELSE {x} * (841.0::DOUBLE / 108) + 16.0::DOUBLE / 116 END)"
    at = lambda side, dr, dc: mixed(rgb(f"{side}[((7 - abs(7 - abs(r + {dr}))) * 8 + 7 - abs(7 - abs(c + {dc})) + 1)::BIGINT]"))
    edge = lambda side, turn: " + ".join(f"{k} * ({at(side, *((d, 1) if turn else (1, d)))} - {at(side, *((d, -1) if turn else (-1, d)))})" for d, k in ((-1, 1), (0, 2), (1, 1)))
    steep = lambda side: f"sqrt(pow({edge(side, True)}, 2) + pow({edge(side, False)}, 2))"
    scaled = lambda n: f"CASE WHEN q{n} > 0 THEN least(greatest({n} / (q{n} + 1e-6), 0.0), 1.0) ELSE 0.0 END"
    return f"""WITH {SPOTS}, xyz AS (SELECT *, {sums} FROM spots),
 parts AS (SELECT id, p, abs(ln({light("a[p + 1]")} + 1e-3) - ln({light("b[p + 1]")} + 1e-3)) AS l,
 sqrt(pow(500 * ({bent("xa")} - {bent("ya")} - {bent("xb")} + {bent("yb")}), 2) + pow(200 * ({bent("ya")} - {bent("za")} - {bent("yb")} + {bent("zb")}), 2)) AS k, abs({steep("a")} - {steep("b")}) AS t FROM xyz),
 q AS (SELECT id, quantile_cont(l, 0.99) FILTER (WHERE l > 0) AS ql, quantile_cont(k, 0.99) FILTER (WHERE k > 0) AS qk, quantile_cont(t, 0.99) FILTER (WHERE t > 0) AS qt FROM parts GROUP BY id)
 SELECT id, p, round(least(greatest(0.6 * {scaled("l")} + 0.3 * {scaled("k")} + 0.1 * {scaled("t")}, 0.0), 1.0), 6) + 0.0 AS v FROM parts JOIN q USING (id)"""


def _lab() -> str:
    straight = lambda x: f"(CASE WHEN {x} > 0.04045 THEN pow(({x} + 0.055) / 1.055, 2.4) ELSE {x} / 12.92 END)"
    bent = lambda x: f"(CASE WHEN {x} > 216.0::DOUBLE / 24389 THEN cbrt({x}) ELSE {x} * (841.0::DOUBLE / 108) + 16.0::DOUBLE / 116 END)"
    return f"""WITH {PIXELS}, lin AS (SELECT id, p, {straight("least(abs(v), 1.0)")} AS r, {straight("(1 - least(abs(v), 1.0))")} AS g, {straight("(least(abs(v), 1.0) * least(abs(v), 1.0))")} AS b FROM px),
 xyz AS (SELECT id, p, (0.412453::DOUBLE * r + 0.357580::DOUBLE * g + 0.180423::DOUBLE * b) / 0.950456 AS x, 0.212671::DOUBLE * r + 0.715160::DOUBLE * g + 0.072169::DOUBLE * b AS y, (0.019334::DOUBLE * r + 0.119193::DOUBLE * g + 0.950227::DOUBLE * b) / 1.088754 AS z FROM lin),
 f AS (SELECT id, p, {bent("x")} AS x, {bent("y")} AS y, {bent("z")} AS z FROM xyz)
 SELECT id, p, round(116 * y - 16, 5) + 0.0 AS l, round(500 * (x - y), 5) + 0.0 AS a, round(200 * (y - z), 5) + 0.0 AS b FROM f"""


SQL: dict[str, str] = {
    **PICTURE_SQL,
    **FILE_SQL,
    **CURATION_SQL,
    "ordered_pairs": f"""WITH {EDITS}, used AS (SELECT * FROM edits WHERE shard NOT IN (3) AND category IN ('{ADD}', '{REMOVE}')),
 n AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY shard, "row") - 1 + CASE WHEN category = '{ADD}' THEN 0 ELSE (SELECT count(*) FROM used WHERE category = '{ADD}') END AS id FROM used)
 SELECT printf('%06d', id) AS stem, category, CASE WHEN category = '{ADD}' THEN source ELSE edited END AS bg, CASE WHEN category = '{ADD}' THEN edited ELSE source END AS shot, instruction AS prompt FROM n""",
    "shard_stats": f"""WITH {EDITS}, c AS (SELECT shard, count(*) FILTER (WHERE category = '{ADD}') AS n_add, count(*) FILTER (WHERE category = '{REMOVE}') AS n_remove FROM edits GROUP BY shard)
 SELECT shard, n_add, n_remove, (sum(n_add) OVER (ORDER BY shard) - n_add)::BIGINT AS first_add, (sum(n_add) OVER () + sum(n_remove) OVER (ORDER BY shard) - n_remove)::BIGINT AS first_remove FROM c""",
    "heldout_exclusion": f"WITH {EDITS} SELECT shard, count(*) AS n FROM edits WHERE shard <> 3 GROUP BY shard",
    "category_totals": f"WITH {EDITS} SELECT count(*) FILTER (WHERE category = '{ADD}') AS n_add, count(*) FILTER (WHERE category = '{REMOVE}') AS n_remove FROM edits",
    "stem_pairs": f"WITH {BG}, {SHOT}, {LAST} SELECT stem, bg_path, shot_path FROM b JOIN s USING (stem)",
    "pairs_with_prompt": f"WITH {BG}, {SHOT}, {LAST}, {PROMPTS}, p AS (SELECT stem, max_by(prompt, seq) AS prompt FROM prompts GROUP BY stem) SELECT stem, bg_path, shot_path, coalesce(prompt, 'edited region') AS prompt FROM b JOIN s USING (stem) LEFT JOIN p USING (stem)",
    "last_wins_union": f"WITH {PROMPTS} SELECT stem, max_by(prompt, seq) AS prompt FROM prompts GROUP BY stem",
    "common_stems": f"WITH {BG}, {SHOT} SELECT {STEM} AS stem FROM bg INTERSECT SELECT {STEM} FROM shot",
    "unmatched_images": f"WITH {BG}, {SHOT}, {LAST} SELECT path AS image FROM bg WHERE {STEM} NOT IN (SELECT stem FROM s)",
    "fallback_pairs": f"WITH {BG}, {SHOT}, {LAST} SELECT s.stem, path AS image, shot_path AS mask FROM bg JOIN s ON {STEM} = s.stem",
    "positional_pairs": f"WITH {BG}, {SHOT}, a AS (SELECT row_number() OVER (ORDER BY path) - 1 AS idx, path AS bg_path FROM bg), z AS (SELECT row_number() OVER (ORDER BY path) - 1 AS idx, path AS shot_path FROM shot) SELECT idx, bg_path, shot_path FROM a JOIN z USING (idx)",
    "counted_pairs": f"WITH {BG}, {SHOT}, a AS (SELECT row_number() OVER (ORDER BY path) AS i, path AS image FROM bg), z AS (SELECT row_number() OVER (ORDER BY path) AS i, path AS mask FROM shot) SELECT regexp_extract(image, '([^/]*?)(\\.[^./]*)?$', 1) AS stem, image, mask FROM a JOIN z USING (i)",
    "ext_priority_lookup": f"""WITH {BG}, {SHOT}, best AS (SELECT {STEM} AS stem, path AS image FROM shot QUALIFY row_number() OVER (PARTITION BY {STEM} ORDER BY CASE WHEN path LIKE '%.png' THEN 1 ELSE 2 END) = 1)
 SELECT best.stem, replace(path, 'bg/', 'masks/mask_') AS mask, image FROM bg JOIN best ON {STEM} = best.stem""",
    "path_parts": f"WITH {BG} SELECT path, {STEM} AS stem, regexp_extract(path, '(\\.[^./]*)$', 1) AS suffix, {STEM} AS bare FROM bg",
    "worker_ranges": f"WITH {BG}, u AS (SELECT DISTINCT {STEM} AS stem FROM bg) SELECT stem, (ntile(8) OVER (ORDER BY stem) - 1)::BIGINT AS worker FROM u",
    "worker_sizes": f"WITH {BG}, u AS (SELECT DISTINCT {STEM} AS stem FROM bg), t AS (SELECT stem, (ntile(8) OVER (ORDER BY stem) - 1)::BIGINT AS worker FROM u) SELECT worker, count(*) AS n, min(stem) AS first, max(stem) AS last FROM t GROUP BY worker",
    "start_offset": f"WITH {BG}, u AS (SELECT DISTINCT {STEM} AS stem FROM bg) SELECT stem FROM u QUALIFY row_number() OVER (ORDER BY stem) > 50",
    "prompt_broadcast": f"WITH {BG}, {SHOT}, {LAST} SELECT stem, 'remove the object' AS prompt, 0.5::DOUBLE AS first FROM b JOIN s USING (stem)",
    "ragged_columns": """WITH n AS (SELECT l_orderkey, l_partkey, l_returnflag = 'R' AS r, row_number() OVER (PARTITION BY l_orderkey, l_returnflag = 'R' ORDER BY l_partkey) - 1 AS pos FROM lineitem),
 a AS (SELECT * FROM n WHERE r), b AS (SELECT * FROM n WHERE NOT r) SELECT coalesce(a.l_orderkey, b.l_orderkey) AS l_orderkey, coalesce(a.pos, b.pos) AS pos, coalesce(a.l_partkey, -1) AS returned, coalesce(b.l_partkey, -1) AS other FROM a FULL JOIN b ON a.l_orderkey = b.l_orderkey AND a.pos = b.pos""",
    "topk_detections": f"WITH {BOXES} SELECT sample, pos, row_number() OVER (PARTITION BY sample ORDER BY score DESC, pos) AS rank, score FROM boxes WHERE kind = 'semantic' QUALIFY rank <= 3",
    "main_regions": f"""WITH {BOXES}, d AS (SELECT sample, pos, (x2 - x1) * (y2 - y1) AS area FROM boxes WHERE kind = 'diff'), k AS (SELECT *, max(area) OVER (PARTITION BY sample) AS most FROM d)
 SELECT sample, pos, area, row_number() OVER (PARTITION BY sample ORDER BY area DESC, pos) AS rank FROM k WHERE area >= most * 0.3""",
    "iou_best_match": f"WITH {MATCHED} SELECT sample, pos, coalesce(match_pos, -1) AS match_pos, round(iou, 6) AS iou FROM matched WHERE sample IN (SELECT sample FROM boxes)",
    "validate_boxes": f"WITH {VALIDATED} SELECT sample, reason = 'pass' AS is_valid, reason, CASE WHEN reason = 'pass' THEN kept ELSE 0 END AS n_kept FROM results",
    "reason_counts": f"WITH {VALIDATED} SELECT CASE WHEN reason = 'pass' THEN 'success' ELSE reason END AS reason, count(*) AS n FROM results GROUP BY 1",
    "overlap_semi": f"""WITH {BOXES}, d AS (SELECT *, (x2 - x1) * (y2 - y1) // 2 AS area FROM boxes WHERE kind = 'diff'), s AS (SELECT * FROM boxes WHERE kind = 'semantic')
 SELECT sample, pos, area FROM d WHERE EXISTS (SELECT 1 FROM s WHERE s.sample = d.sample AND {IOU_AREA} > d.area * 0.5)""",
    "bucket_batches": f"WITH {BATCHES} SELECT idx, width, height, chunk, place FROM bat",
    "rank_batches": f"""WITH {BATCHES}, w AS (SELECT DISTINCT width, height, chunk FROM bat), k AS (SELECT *, row_number() OVER (ORDER BY md5('1-' || width || '-' || height || '-' || chunk), width, height, chunk) - 1 AS batch_no, count(*) OVER () AS n FROM w)
 SELECT width, height, chunk, batch_no, batch_no % 3 AS rank FROM k WHERE batch_no < n // 3 * 3""",
    "batches_per_rank": f"WITH {RESOLUTIONS}, c AS (SELECT count(*) AS n FROM res GROUP BY width, height) SELECT (sum(n // 8) // 3)::BIGINT AS n_floor, (sum((n + 7) // 8) // 3)::BIGINT AS n_ceil FROM c",
    "mode_choice": f"""WITH {BATCHES}, w AS (SELECT DISTINCT width, height, chunk FROM bat), k AS (SELECT *, ('0x' || substr(md5('mode-' || width || '-' || height || '-' || chunk), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM w),
 m AS (SELECT *, CASE WHEN u < 0.35 THEN 'shrink' WHEN u < 0.55 THEN 'expand' WHEN u < 0.65 THEN 'holes' WHEN u < 0.7 THEN 'shift' ELSE 'sam' END AS mode FROM k)
 SELECT width, height, chunk, round(u, 9) AS u, CASE WHEN mode = 'sam' AND chunk % 2 <> 0 THEN 'shrink' ELSE mode END AS mode FROM m""",
    "align16_sizes": f"WITH {RESOLUTIONS} SELECT idx, ((width + idx % 17 + 15) // 16 * 16)::BIGINT AS width, ((height + idx % 23 + 15) // 16 * 16)::BIGINT AS height FROM res",
    "cap_long_edge": f"""WITH {RESOLUTIONS}, k AS (SELECT idx, width * (1 + idx % 7) AS w, height * (1 + idx % 5) AS h FROM res), s AS (SELECT *, CASE WHEN greatest(w, h) > 1024 THEN 1024.0::DOUBLE / greatest(w, h) ELSE 1.0::DOUBLE END AS f FROM k)
 SELECT idx, greatest(16, floor(floor(w * f + 1e-9) / 16) * 16)::BIGINT AS width, greatest(16, floor(floor(h * f + 1e-9) / 16) * 16)::BIGINT AS height FROM s""",
    "short_edge_sizes": f"""WITH {RESOLUTIONS}, k AS (SELECT idx, width + idx % 41 AS w, height AS h, 320.0::DOUBLE / least(width + idx % 41, height) AS f FROM res)
 SELECT idx, (floor((floor(w * f + 0.5) + 15) / 16) * 16)::BIGINT AS train_w, (floor((floor(h * f + 0.5) + 15) / 16) * 16)::BIGINT AS train_h,
 (floor((floor(w * least(f, 1.0) + 0.5) + 15) / 16) * 16)::BIGINT AS infer_w, (floor((floor(h * least(f, 1.0) + 0.5) + 15) / 16) * 16)::BIGINT AS infer_h FROM k""",
    "binarize": f"WITH {PIXELS} SELECT id, p, {BINARY}::BIGINT AS v FROM px",
    "heat_p99": f"""WITH {PIXELS}, q AS (SELECT id, quantile_cont(v, 0.99) FILTER (WHERE v > 0) AS p99 FROM px GROUP BY id)
 SELECT q.id, round(p99, 6) AS p99, round(sum(CASE WHEN p99 > 0 THEN least(greatest(v / (p99 + 1e-6), 0.0), 1.0) ELSE 0.0 END), 6) AS heat FROM q JOIN px ON q.id = px.id GROUP BY q.id, p99""",
    "weighted_heatmap": _heat(),
    "lab_colors": _lab(),
    "soft_edge": f"""WITH {PIXELS}, m AS (SELECT id, p, r, c, v > 0.15 AS s FROM px), d AS (SELECT a.id, a.p, sqrt(min((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c))) AS d FROM m a JOIN m b ON a.id = b.id AND b.s GROUP BY a.id, a.p)
 SELECT m.id, m.p, round(coalesce(least(greatest(1 - d / 3, 0.0), 1.0), 0.0), 6) + 0.0 AS v FROM m LEFT JOIN d ON m.id = d.id AND m.p = d.p""",
    "byte_thresholds": f"WITH {PIXELS} SELECT id, count(*) FILTER (WHERE floor(abs(v) * 100.0) + 110 > 127) AS over_127, count(*) FILTER (WHERE floor(abs(v) * 100.0) + 110 > 128) AS over_128 FROM px GROUP BY id",
    "linear_light": f"WITH {PIXELS} SELECT id, round(sum(pow(abs(v) * 255.0 / 255.0, 2.2)), 6) AS light FROM px GROUP BY id",
    "gradient_sum": f"WITH g AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings) SELECT id, round({_sobel()}, 5) AS gradient FROM g",
    "maxpool": f"WITH {PIXELS} SELECT id, r // 4 * 2 + c // 4 AS p, round(max(v), 6) AS v FROM px GROUP BY ALL",
    "area_downsample": f"WITH {PIXELS} SELECT id, r // 2 * 4 + c // 2 AS p, round(avg(v), 6) AS v FROM px GROUP BY ALL",
    "nearest_resize": f"WITH {PIXELS}, t AS (SELECT i AS p, (i // 5) * 8 // 3 AS r, (i % 5) * 8 // 5 AS c FROM range(15) x(i)) SELECT id, t.p, round(v, 6) AS v FROM px JOIN t ON px.r = t.r AND px.c = t.c",
    "pack_latents": f"WITH {PIXELS} SELECT id, r // 2 * 4 + c // 2 AS patch, r % 2 * 2 + c % 2 AS k, round(v, 6) AS v FROM px",
    "unpack_latents": "SELECT vec_id AS id, true AS same FROM embeddings",
    "position_grid": f"WITH {PIXELS} SELECT id, p, r AS y, c AS x FROM px",
    "mask_bbox": f"WITH {PIXELS} SELECT id, min(c) AS x1, min(r) AS y1, max(c) AS x2, max(r) AS y2 FROM px WHERE v > 0.2 GROUP BY id",
    "mask_area": f"WITH {PIXELS} SELECT id, sum({BINARY})::BIGINT AS area FROM px GROUP BY id",
    "shift_mask": f"""WITH g AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, i - 1 AS p, (i - 1) // 8 - (vec_id % 3 - 1) AS r, (i - 1) % 8 - (vec_id % 5 - 2) AS c FROM embeddings, LATERAL (SELECT unnest(range(1, 65)) AS i))
 SELECT id, p, (CASE WHEN r BETWEEN 0 AND 7 AND c BETWEEN 0 AND 7 AND e[(r * 8 + c + 1)::BIGINT] > {HEAT} THEN 1 ELSE 0 END)::BIGINT AS v FROM g""",
    "mask_fuse": f"WITH {SPOTS} SELECT id, p, (CASE WHEN a[p + 1] > {HEAT} OR b[p + 1] > {HEAT} THEN 1 ELSE 0 END)::BIGINT AS v FROM spots",
    "mask_difference": f"WITH {PAIRED} SELECT id, count(*) FILTER (WHERE a > {HEAT} AND NOT b > {HEAT}) AS left_over, count(*) FILTER (WHERE a > {HEAT} AND NOT b > {HEAT}) AS outside FROM pr GROUP BY id",
    "effect_ratio": f"""WITH {PAIRED}, k AS (SELECT id, count(*) FILTER (WHERE a > {HEAT})::DOUBLE AS o, count(*) FILTER (WHERE b > {HEAT} AND NOT a > {HEAT})::DOUBLE AS s FROM pr GROUP BY id), q AS (SELECT id, CASE WHEN o > 0 THEN s / o ELSE 0.0 END AS x FROM k) SELECT id, round(x, 6) AS ratio, x > 0.25 AS has_effect FROM q""",
    "hard_blend": f"WITH {PAIRED} SELECT id, round(sum(CASE WHEN a > {HEAT} THEN b ELSE a END), 6) + 0.0 AS hard, round(sum(b / (1 + exp(-a * 4)) + a * (1 - 1 / (1 + exp(-a * 4)))), 6) + 0.0 AS soft FROM pr GROUP BY id",
    "range_scaling": f"WITH {PIXELS} SELECT id, p, round(v * 2.0 - 1.0, 6) + 0.0 AS signed, round(least(greatest((v * 3.0 + 1.0) / 2.0, 0.0), 1.0), 6) + 0.0 AS unit, trunc(least(greatest(v, 0.0), 1.0) * 255.0)::BIGINT AS byte, round((v - 0.48) / 0.27, 6) + 0.0 AS normal FROM px",
    "noising": f"WITH {PAIRED} SELECT id, round(sum(a * 0.6 + b * 0.4), 6) + 0.0 AS noised, round(sum(a), 6) + 0.0 AS restored FROM pr GROUP BY id",
    "masked_l1": f"WITH {PAIRED}, k AS (SELECT id, sum(CASE WHEN a > {HEAT} THEN abs(a - b) ELSE 0.0 END) / greatest(sum(CASE WHEN a > {HEAT} THEN 1.0::DOUBLE ELSE 0.0 END), 1e-4) AS e FROM pr GROUP BY id) SELECT round(avg(e), 6) AS loss FROM k",
    "dice": f"WITH {PAIRED} SELECT round(1 - (2 * sum(abs(a) * abs(b)) + 1) / (sum(abs(a)) + sum(abs(b)) + 1), 6) AS loss FROM pr",
    "bce_logits": f"""WITH {PAIRED} SELECT id, round(sum(greatest(a * 5, 0.0) - a * 5 * abs(b) + ln(1 + exp(-abs(a * 5)))) / 64, 6) AS plain,
 round(sum((greatest(a, 0.0) - a + ln(1 + exp(-abs(a)))) * abs(b)) / greatest(sum(abs(b)), 1e-4), 6) AS weighted FROM pr GROUP BY id""",
    "zip_shorter": f"""WITH {BOXES}, n AS (SELECT sample, pos, kind, row_number() OVER (PARTITION BY sample, kind ORDER BY pos) - 1 AS place FROM boxes)
 SELECT a.sample, a.place, a.pos AS a, b.pos AS b, b.pos - a.pos AS gap FROM n a JOIN n b ON a.sample = b.sample AND a.place = b.place AND a.kind = 'diff' AND b.kind = 'semantic'""",
    "feature_concat": f"WITH {PAIRED} SELECT id, 128::BIGINT AS n, round(b, 6) AS middle FROM pr WHERE p = 0",
    "components": f"WITH RECURSIVE {LABELLED} SELECT id, label, area, x1, y1, x2, y2 FROM comp",
    "quality_audit": f"""WITH RECURSIVE {LABELLED}, top AS (SELECT *, max(area) OVER (PARTITION BY id) AS most FROM comp), k AS (SELECT id, count(*) FILTER (WHERE area >= most * 0.3) AS main, coalesce(sum(area) FILTER (WHERE area < most * 0.3), 0)::DOUBLE / sum(area) AS noise FROM top GROUP BY id),
 v AS (SELECT e.vec_id AS id, main, noise, CASE WHEN main IS NULL THEN 'empty_mask' WHEN main > 4 THEN 'too_many_objects' WHEN noise > 0.3 THEN 'high_noise' ELSE 'pass' END AS reason FROM embeddings e LEFT JOIN k ON e.vec_id = k.id)
 SELECT id, reason = 'pass' AS is_hq, reason, CASE WHEN reason IN ('pass', 'too_many_objects') THEN main ELSE -1 END AS main_count, CASE WHEN reason = 'high_noise' THEN round(noise, 3) END AS noise_ratio FROM v""",
    "expand_mask": f"""WITH {PIXELS}, m AS (SELECT id, p, r, c, v > {HEAT} AS s FROM px), n AS (SELECT id, count(*) FILTER (WHERE s) AS n FROM m GROUP BY id),
 d AS (SELECT a.id, a.p, min((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c)) AS d FROM m a JOIN m b ON a.id = b.id AND b.s WHERE NOT a.s GROUP BY a.id, a.p), k AS (SELECT d.*, row_number() OVER (PARTITION BY d.id ORDER BY d) AS o, count(*) OVER (PARTITION BY d.id) AS outside, floor(n * 1.5)::BIGINT - n AS more FROM d JOIN n ON d.id = n.id),
 cut AS (SELECT id, max(d) FILTER (WHERE o <= more) AS cut, bool_or(more >= outside) AS whole FROM k WHERE more > 0 GROUP BY id)
 SELECT m.id, m.p, (CASE WHEN s OR coalesce(whole, false) OR coalesce(d.d <= cut.cut, false) THEN 1 ELSE 0 END)::BIGINT AS v FROM m LEFT JOIN d ON m.id = d.id AND m.p = d.p LEFT JOIN cut ON m.id = cut.id""",
    "shrink_mask": f"""WITH {PIXELS}, m AS (SELECT id, p, r, c, v > 0 AS s FROM px), n AS (SELECT id, count(*) FILTER (WHERE s) AS n FROM m GROUP BY id),
 d AS (SELECT a.id, a.p, min((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c)) AS d FROM m a JOIN m b ON a.id = b.id AND NOT b.s WHERE a.s GROUP BY a.id, a.p), k AS (SELECT d.*, row_number() OVER (PARTITION BY d.id ORDER BY d) AS o, n - floor(n * 0.6)::BIGINT AS less FROM d JOIN n ON d.id = n.id),
 cut AS (SELECT id, max(d) FILTER (WHERE o <= less) AS cut FROM k WHERE less > 0 GROUP BY id)
 SELECT m.id, m.p, (CASE WHEN s AND coalesce(d.d > cut.cut, true) THEN 1 ELSE 0 END)::BIGINT AS v FROM m LEFT JOIN d ON m.id = d.id AND m.p = d.p LEFT JOIN cut ON m.id = cut.id""",
    "open_close": f"WITH {PIXELS}, a0 AS (SELECT id, p, r, c, CASE WHEN v > -0.1 THEN 1 ELSE 0 END AS v FROM px), {_morph('a0', 'a1', 'min')}, {_morph('a1', 'a2', 'max')}, {_morph('a2', 'a3', 'max')}, {_morph('a3', 'a4', 'min')} SELECT id, p, v::BIGINT AS v FROM a4",
    "metric_means": f"WITH {METRICS} SELECT step, metric, round(avg(value), 6) AS mean, count(*) AS n FROM metrics GROUP BY step, metric",
    "logged_steps": f"WITH {METRICS} SELECT step, (step // 3) % 2 AS turn, count(*) AS n FROM metrics WHERE step % 5 = 0 OR step = 1 GROUP BY step",
    "grad_norms": f"WITH {METRICS} SELECT metric || '.weight' AS \"group\", round(sqrt(sum(value * value)), 4) AS norm FROM metrics GROUP BY metric",
    "parameter_totals": "SELECT round(sum(p_partkey * p_size) / 1e6, 2) AS total_m, round(sum(CASE WHEN p_size > 25 THEN p_partkey * p_size ELSE 0 END) / 1e6, 2) AS trainable_m FROM part",
    "mean_time": "SELECT round(coalesce(sum(value) FILTER (WHERE event_type <> 'error'), 0.0) / count(*), 6) AS mean_seconds, count(*) AS n FROM events",
    "checkpoint_retention": "SELECT 'checkpoint-' || o_orderkey AS name, o_orderkey AS step FROM orders QUALIFY row_number() OVER (ORDER BY o_orderkey DESC) >= 3",
    "first_images": "SELECT event_id // 50 AS step, event_id AS pos, row_number() OVER (PARTITION BY event_id // 50 ORDER BY event_id) - 1 AS rank, (row_number() OVER (PARTITION BY event_id // 50 ORDER BY event_id) - 1) // 4 AS grid_row, (row_number() OVER (PARTITION BY event_id // 50 ORDER BY event_id) - 1) % 4 AS grid_col FROM events QUALIFY rank < 4",
    "cell_types": f'WITH {CELLS} SELECT "row", "column", {NAME}[{RANK} + 1] AS type FROM cells',
    "column_types": f'WITH {CELLS} SELECT "column", {NAME}[greatest(max({RANK}), 1) + 1] AS type FROM cells GROUP BY "column"',
    "column_widths": f'WITH {CELLS} SELECT "column", max(length(cell))::BIGINT AS width, max({DECIMALS})::BIGINT AS decimals FROM cells GROUP BY "column"',
    "thousands_numbers": f'WITH {CELLS} SELECT "row", "column", {THOUSANDS} AS thousands FROM cells',
    "decimal_places": f'WITH {CELLS} SELECT "row", "column", ({DECIMALS})::BIGINT AS decimals FROM cells',
    "padded_cells": f"""WITH {CELLS}, k AS (SELECT *, greatest(12 - length(cell), 0) AS n FROM cells)
 SELECT "row", "column", '|' || cell || repeat(' ', n) || '|' AS "left", '|' || repeat(' ', n) || cell || '|' AS "right", '|' || repeat(' ', n // 2) || cell || repeat(' ', n - n // 2) || '|' AS "center" FROM k""",
    "escaped_cells": """SELECT r_regionkey, '&lt;' || r_name || '&gt; &amp; 100% &quot;a&quot;_{&#x27;b&#x27;}' AS html, r_name || '\\_50\\%\\&\\#' AS latex, '..' AS rst FROM region""",
}
