"""DuckDB forms of the queries of the curation plan."""

from __future__ import annotations

from .picture_oracles import CHAMFER, COMPONENTS, HULL
from .views import PIXELS

CELL = "+".join(f"e[((r // 3 * 2 + {a}) * 8 + c // 3 * 2 + {b} + 1)::BIGINT]" for a in (0, 1) for b in (0, 1))


def _spread(source: str, to: str, how: str) -> str:
    return f"{to} AS (SELECT a.id, a.p, a.r, a.c, {how}(b.s) AS s FROM {source} a JOIN {source} b ON a.id = b.id AND abs(a.r - b.r) + abs(a.c - b.c) <= 1 GROUP BY a.id, a.p, a.r, a.c)"


def _joined(source: str, to: str, value: str, near: str) -> str:
    """Components of the pixels of a value, each named by its smallest place."""
    return f"""{to}_reach AS (SELECT id, p, r, c, p AS label FROM {source} WHERE s = {value} UNION SELECT n.id, n.p, n.r, n.c, x.label FROM {to}_reach x JOIN {source} n ON n.s = {value} AND n.id = x.id AND {near}),
{to} AS (SELECT id, p, r, c, min(label) AS label FROM {to}_reach GROUP BY ALL)"""


EIGHT, FOUR = "abs(n.r - x.r) <= 1 AND abs(n.c - x.c) <= 1", "abs(n.r - x.r) + abs(n.c - x.c) = 1"
COMMON = "greatest(least(d.x2, s.x2) - greatest(d.x1, s.x1), 0) * greatest(least(d.y2, s.y2) - greatest(d.y1, s.y1), 0)"

CURATED = f"""WITH RECURSIVE ids AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
fault AS (SELECT id, CASE WHEN id % 17 = 0 THEN 'image_load_error' WHEN id % 19 = 0 THEN 'shape_mismatch' WHEN id % 23 = 0 THEN 'error' END AS fault FROM ids),
m0 AS (SELECT id, r * 12 + c AS p, r, c, CASE WHEN ({CELL}) / 4 > 0.03 THEN 1 ELSE 0 END AS s FROM ids, (SELECT unnest(range(12)) AS r) x, (SELECT unnest(range(12)) AS c) y WHERE id % 17 <> 0 AND id % 19 <> 0 AND id % 23 <> 0),
{_spread("m0", "m1", "min")}, {_spread("m1", "m2", "max")}, {_spread("m2", "m3", "max")}, {_spread("m3", "m4", "min")},
{_joined("m4", "first", "1", EIGHT)}, large AS (SELECT id, label FROM first GROUP BY id, label HAVING count(*) >= 6),
m5 AS (SELECT m4.id, m4.p, m4.r, m4.c, CASE WHEN large.id IS NOT NULL THEN 1 ELSE 0 END AS s FROM m4 LEFT JOIN first ON first.id = m4.id AND first.p = m4.p LEFT JOIN large ON large.id = first.id AND large.label = first.label),
{_joined("m5", "gap", "0", FOUR)}, hole AS (SELECT id, label FROM gap GROUP BY id, label HAVING count(*) <= 3 AND NOT bool_or(r IN (0, 11) OR c IN (0, 11))),
m6 AS (SELECT m5.id, m5.p, m5.r, m5.c, CASE WHEN m5.s = 1 OR hole.id IS NOT NULL THEN 1 ELSE 0 END AS s FROM m5 LEFT JOIN gap ON gap.id = m5.id AND gap.p = m5.p LEFT JOIN hole ON hole.id = gap.id AND hole.label = gap.label),
{_joined("m6", "last", "1", EIGHT)}, comp AS (SELECT id, label, count(*) AS px, min(c) AS x1, min(r) AS y1, max(c) + 1 AS x2, max(r) + 1 AS y2, max(count(*)) OVER (PARTITION BY id) AS most FROM last GROUP BY id, label),
audit AS (SELECT id, count(*) FILTER (WHERE px >= most * 0.6) AS main, 1 - (sum(px) FILTER (WHERE px >= most * 0.6))::DOUBLE / sum(px) AS noise FROM comp GROUP BY id),
d AS (SELECT id, x1, y1, x2, y2, (x2 - x1) * (y2 - y1) AS area, row_number() OVER (PARTITION BY id ORDER BY px DESC, label) AS pos FROM comp WHERE px >= most * 0.6),
found AS (SELECT id, k, ((id * 13 + k * 7) % 10) / 10.0::DOUBLE AS score, (id * 7 + k * 5) % 8 AS x1, (id * 3 + k * 4) % 8 AS y1, (id * 7 + k * 5) % 8 + 3 + (id + k) % 5 AS x2, (id * 3 + k * 4) % 8 + 3 + (id * 2 + k) % 6 AS y2 FROM ids, (SELECT unnest(range(5)) AS k) x WHERE id % 11 <> 0),
s AS (SELECT *, (x2 - x1) * (y2 - y1) AS area, row_number() OVER (PARTITION BY id ORDER BY score DESC, k) AS pos FROM found WHERE score >= 0.3 QUALIFY pos <= 3),
met AS (SELECT d.id, d.pos, s.pos AS match_pos, s.area AS s_area, ({COMMON})::DOUBLE / (d.area + s.area - {COMMON}) AS iou FROM d JOIN s ON d.id = s.id),
best AS (SELECT * FROM met WHERE iou > 0 QUALIFY row_number() OVER (PARTITION BY id, pos ORDER BY iou DESC, match_pos) = 1),
judged AS (SELECT d.*, CASE WHEN best.iou >= 0.3 AND d.area::DOUBLE / greatest(s_area, 1) > 2 THEN 'scale_overflow_aligned' WHEN best.iou >= 0.3 THEN 'keep' WHEN best.iou > 0 AND d.area::DOUBLE / greatest(s_area, 1) > 2 THEN 'background_collapse' ELSE 'drop' END AS verdict FROM d LEFT JOIN best ON best.id = d.id AND best.pos = d.pos),
per AS (SELECT id, min_by(verdict, pos) FILTER (WHERE verdict NOT IN ('keep', 'drop')) AS broken, count(*) FILTER (WHERE verdict = 'keep') AS kept FROM judged GROUP BY id),
told AS (SELECT f.id, CASE WHEN fault IS NOT NULL THEN fault WHEN a.id IS NULL THEN 'diff_quality_empty_mask' WHEN main > 1 THEN 'diff_quality_too_many_objects' WHEN noise > 0.3 THEN 'diff_quality_high_noise'
 WHEN t.id IS NULL THEN 'no_semantic_targets' WHEN broken IS NOT NULL THEN broken WHEN kept = 0 THEN 'no_valid_regions' ELSE 'pass' END AS reason
 FROM fault f LEFT JOIN audit a ON a.id = f.id LEFT JOIN per ON per.id = f.id LEFT JOIN (SELECT DISTINCT id FROM s) t ON t.id = f.id),
kept AS (SELECT j.* FROM judged j JOIN told ON told.id = j.id AND reason = 'pass' WHERE verdict = 'keep'),
covered AS (SELECT DISTINCT d.id, d.label FROM comp d JOIN kept s ON s.id = d.id WHERE ({COMMON})::DOUBLE / d.px > 0.5),
m7 AS (SELECT m6.id, m6.p, m6.r, m6.c, max(CASE WHEN covered.id IS NOT NULL OR (m6.id % 5 <> 0 AND (m6.r + m6.c + m6.id) % 3 > 0 AND m6.c >= k.x1 AND m6.c < k.x2 AND m6.r >= k.y1 AND m6.r < k.y2) THEN 1 ELSE 0 END) AS s
 FROM m6 JOIN kept k ON k.id = m6.id LEFT JOIN last ON last.id = m6.id AND last.p = m6.p LEFT JOIN covered ON covered.id = last.id AND covered.label = last.label GROUP BY m6.id, m6.p, m6.r, m6.c),
size AS (SELECT id, sum(s)::BIGINT AS n FROM m7 GROUP BY id),
far AS (SELECT a.id, a.p, min((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c)) AS dist FROM m7 a JOIN m7 b ON a.id = b.id AND b.s = 1 WHERE a.s = 0 GROUP BY a.id, a.p),
placed AS (SELECT far.*, row_number() OVER (PARTITION BY far.id ORDER BY dist) AS o, count(*) OVER (PARTITION BY far.id) AS outside, floor(n * 1.2::DOUBLE)::BIGINT - n AS more FROM far JOIN size ON size.id = far.id),
cut AS (SELECT id, max(dist) FILTER (WHERE o <= more) AS cut, bool_or(more >= outside) AS whole FROM placed WHERE more > 0 GROUP BY id),
final AS (SELECT m7.id, m7.p FROM m7 LEFT JOIN far ON far.id = m7.id AND far.p = m7.p LEFT JOIN cut ON cut.id = m7.id WHERE m7.s = 1 OR coalesce(whole, false) OR coalesce(dist <= cut, false))"""

_DRAW = "('0x' || substr(md5({}), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


def _augmented() -> str:
    """Modes by batch, then each mode's pixels; holes are left out."""
    draw = lambda what: _DRAW.format(f"'5-{what}-' || id")
    return f"""WITH RECURSIVE {PIXELS}, drawn AS (SELECT vec_id AS id, {_DRAW.format("'5-' || (vec_id // 8)")} AS u FROM embeddings),
 chosen AS (SELECT id, CASE WHEN u < 0.35 THEN 'shrink' WHEN u < 0.55 THEN 'expand' WHEN u < 0.65 THEN 'holes' WHEN u < 0.7 THEN 'shift' WHEN id % 3 <> 0 THEN 'sam' ELSE 'shrink' END AS mode,
  0.5 + (0.7 - 0.5)::DOUBLE * {draw("keep")} AS keep, floor({draw("kernel")} * 3)::BIGINT * (1 + floor({draw("times")} * 2)::BIGINT) AS reach, floor({draw("dx")} * 7)::BIGINT - 3 AS dx, floor({draw("dy")} * 7)::BIGINT - 3 AS dy FROM drawn),
 m AS (SELECT px.id, p, r, c, v > 0 AS s, v > 0.1 AS sam, mode, keep, reach, dx, dy FROM px JOIN chosen ON chosen.id = px.id),
 {COMPONENTS}, {HULL},
 n AS (SELECT id, any_value(keep) AS keep, count(*) FILTER (WHERE s) AS n FROM m GROUP BY id),
 d AS (SELECT a.id, a.p, coalesce(min({CHAMFER.format(dr="abs(a.r - b.r)", dc="abs(a.c - b.c)")}), 536870911) AS d FROM m a LEFT JOIN m b ON a.id = b.id AND NOT b.s WHERE a.s GROUP BY a.id, a.p),
 k AS (SELECT d.*, row_number() OVER (PARTITION BY d.id ORDER BY d) AS o, n - floor(n * keep)::BIGINT AS less FROM d JOIN n ON d.id = n.id), cut AS (SELECT id, max(d) FILTER (WHERE o <= less) AS cut FROM k GROUP BY id),
 shrunk AS (SELECT m.id, m.p FROM m JOIN d ON d.id = m.id AND d.p = m.p LEFT JOIN cut ON cut.id = m.id WHERE coalesce(d.d > cut.cut, true) AND mode = 'shrink'),
 grown AS (SELECT DISTINCT m.id, m.p FROM m JOIN hull ON hull.id = m.id AND abs(hull.r - m.r) <= m.reach AND abs(hull.c - m.c) <= m.reach WHERE mode = 'expand'),
 moved AS (SELECT id, p + dy * 8 + dx AS p FROM m WHERE s AND mode = 'shift' AND r + dy BETWEEN 0 AND 7 AND c + dx BETWEEN 0 AND 7),
 after AS (SELECT * FROM shrunk UNION ALL SELECT * FROM grown UNION ALL SELECT * FROM moved UNION ALL SELECT id, p FROM m WHERE sam AND mode = 'sam'),
 told AS (SELECT id, count(*) AS n, sum(p)::BIGINT AS placed FROM after GROUP BY id)
 SELECT c.id, mode, n.n AS before, CASE WHEN mode = 'holes' THEN -1 ELSE coalesce(t.n, 0) END AS after, CASE WHEN mode = 'holes' THEN -1 ELSE coalesce(placed, 0) END AS placed FROM chosen c JOIN n ON n.id = c.id LEFT JOIN told t ON t.id = c.id"""


CURATION_SQL: dict[str, str] = {
    "curated_pairs": f"{CURATED} SELECT told.id AS sample, reason = 'pass' AS is_valid, reason, count(final.id) AS area, coalesce(sum(final.p), 0)::BIGINT AS placed FROM told LEFT JOIN final ON final.id = told.id GROUP BY told.id, reason",
    "curation_reasons": f"{CURATED} SELECT CASE WHEN reason = 'pass' THEN 'success' ELSE reason END AS reason, count(*) AS n FROM told GROUP BY 1",
    "augmented_batches": _augmented(),
}
