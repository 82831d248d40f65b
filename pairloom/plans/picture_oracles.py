"""DuckDB forms of the queries of resizing, pasting and mask augmentation."""

from __future__ import annotations

from .views import PIXELS

PI = "3.141592653589793::DOUBLE"
SHAPES = """shapes AS (SELECT vec_id AS id, CASE vec_id % 4 WHEN 0 THEN 8 WHEN 1 THEN 4 WHEN 2 THEN 16 ELSE 2 END AS h, embedding::DOUBLE[] AS e FROM embeddings),
pic AS (SELECT id, h, 64 // h AS w, h // 2 + 3 AS th, 64 // h // 2 + 3 AS tw, e FROM shapes)"""
#: The value of each kernel at t, and how far it reaches.
VALUES = {
    "bilinear": ("greatest(1 - abs(t), 0.0)", 1),
    "bicubic": ("CASE WHEN abs(t) < 1 THEN 1.5 * pow(abs(t), 3) - 2.5 * pow(t, 2) + 1 WHEN abs(t) < 2 THEN -0.5 * pow(abs(t), 3) + 2.5 * pow(t, 2) - 4 * abs(t) + 2 ELSE 0.0 END", 2),
    "lanczos": (f"CASE WHEN t = 0 THEN 1.0 WHEN abs(t) < 3 THEN 3 * sin({PI} * t) * sin({PI} * t / 3) / ({PI} * {PI} * t * t) ELSE 0.0 END", 3),
}


def _taps(kernel: str, sides: str, name: str) -> str:
    """name(n, m, i, x, weight): what source pixel x of n gives target pixel i of m; sides selects n and m."""
    value, reach = VALUES[kernel]
    return f"""{name}_at AS (SELECT n, m, i, x, greatest(n::DOUBLE / m, 1.0) AS wide, (i + 0.5::DOUBLE) * n::DOUBLE / m AS mid FROM ({sides}) s, LATERAL (SELECT unnest(range(m)) AS i) a, LATERAL (SELECT unnest(range(n)) AS x) b),
{name}_t AS (SELECT n, m, i, x, (x + 0.5::DOUBLE - mid) / wide AS t FROM {name}_at WHERE x >= floor(mid - {reach} * wide + 0.5) AND x < floor(mid + {reach} * wide + 0.5)),
{name} AS (SELECT n, m, i, x, ({value})::DOUBLE / sum(({value})::DOUBLE) OVER (PARTITION BY n, m, i) AS weight FROM {name}_t)"""


def _resized(kernel: str) -> str:
    return f"""WITH {SHAPES}, {_taps(kernel, "SELECT h AS n, th AS m FROM pic UNION SELECT w, tw FROM pic", "taps")}
 SELECT id, a.i * tw + b.i AS p, round(sum(a.weight * b.weight * e[a.x * w + b.x + 1]), 6) + 0.0 AS v FROM pic JOIN taps a ON a.n = h AND a.m = th JOIN taps b ON b.n = w AND b.m = tw GROUP BY id, a.i, b.i, tw"""


def _pasted() -> str:
    sides = "SELECT th AS n, h AS m FROM pic UNION SELECT tw, w FROM pic"
    byte = "least(greatest(floor({} + 0.5 + 1e-9), 0.0), 255.0)"
    return f"""WITH {SHAPES}, {_taps("bicubic", sides, "cubic")}, {_taps("bilinear", sides, "tri")},
 small AS (SELECT id, h, w, th, tw, r, c, k, (CASE WHEN k < 3 THEN (id * 31 + 7 * r + 13 * c + 50 * k) % 256 ELSE (id + 5 * r + 3 * c) % 5 * 255 // 4 END)::DOUBLE AS v FROM pic, LATERAL (SELECT unnest(range(th)) AS r) a, LATERAL (SELECT unnest(range(tw)) AS c) b, (SELECT unnest(range(4)) AS k) d),
 taps AS (SELECT *, true AS own FROM cubic UNION ALL SELECT *, false FROM tri),
 across AS (SELECT id, h, w, th, r, k, i AS c, CASE WHEN tw = w THEN sum(v * weight) ELSE {byte.format("sum(v * weight)")} END AS v FROM small JOIN taps ON n = tw AND m = w AND x = c AND own = (k < 3) GROUP BY id, h, w, th, tw, r, k, i),
 down AS (SELECT id, w, i AS r, k, c, CASE WHEN th = h THEN sum(v * weight) ELSE {byte.format("sum(v * weight)")} END::BIGINT AS v FROM across JOIN taps ON n = th AND m = h AND x = r AND own = (k < 3) GROUP BY id, h, w, th, i, k, c),
 under AS (SELECT id, p // w AS r, p % w AS c, k, (CASE k WHEN 0 THEN floor(least(abs(e[p + 1]), 1.0) * 255) WHEN 1 THEN floor(least(1 - least(abs(e[p + 1]), 1.0), 1.0) * 255) ELSE floor(least(e[p + 1] * e[p + 1], 1.0) * 255) END)::BIGINT AS v FROM pic, (SELECT unnest(range(64)) AS p) a, (SELECT unnest(range(3)) AS k) b)
 SELECT u.id, (u.r * o.w + u.c) * 3 + u.k AS p, ((o.v * a.v + u.v * (255 - a.v)) * 2 + 255) // 510 AS v FROM under u JOIN down o ON o.id = u.id AND o.r = u.r AND o.c = u.c AND o.k = u.k JOIN down a ON a.id = u.id AND a.r = u.r AND a.c = u.c AND a.k = 3"""


MASK = f"{PIXELS}, m AS (SELECT id, p, r, c, v > 0.07 AS s FROM px)"
RING = "least(r, c, 7 - r, 7 - c)"
NESTED = f"{PIXELS}, m AS (SELECT id, p, r, c, CASE WHEN id % 2 = 1 THEN v > 0.07 WHEN {RING} = 0 THEN true WHEN {RING} = 1 THEN false ELSE v > 0.07 END AS s FROM px)"
#: Components of m by eight neighbours.
COMPONENTS = """reach AS (SELECT id, p, r, c, p AS label FROM m WHERE s UNION SELECT n.id, n.p, n.r, n.c, x.label FROM reach x JOIN m n ON n.s AND n.id = x.id AND abs(n.r - x.r) <= 1 AND abs(n.c - x.c) <= 1),
lab AS (SELECT id, p, r, c, min(label) AS label FROM reach GROUP BY ALL)"""
#: Unset pixels of m that reach the border by four neighbours.
GROUND = "ground AS (SELECT id, r, c FROM m WHERE NOT s AND (r IN (0, 7) OR c IN (0, 7)) UNION SELECT n.id, n.r, n.c FROM ground x JOIN m n ON NOT n.s AND n.id = x.id AND abs(n.r - x.r) + abs(n.c - x.c) = 1)"
#: Pixels on no outer side of an edge of their component's hull.
HULL = """ends AS (SELECT id, label, r AS y, min(c) AS x FROM lab GROUP BY id, label, r UNION SELECT id, label, r, max(c) FROM lab GROUP BY id, label, r),
edges AS (SELECT a.id, a.label, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM ends a JOIN ends b ON a.id = b.id AND a.label = b.label AND (a.x <> b.x OR a.y <> b.y) JOIN ends q ON q.id = a.id AND q.label = a.label
 GROUP BY ALL HAVING min((b.x - a.x) * (q.y - a.y) - (b.y - a.y) * (q.x - a.x)) >= 0),
spans AS (SELECT id, label, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM lab GROUP BY id, label),
in_box AS (SELECT s.id, s.label, m.r, m.c FROM spans s JOIN m ON m.id = s.id AND m.r BETWEEN r0 AND r1 AND m.c BETWEEN c0 AND c1),
hull AS (SELECT DISTINCT i.id, i.r, i.c FROM (SELECT i.id, i.label, i.r, i.c FROM in_box i LEFT JOIN edges e ON e.id = i.id AND e.label = i.label GROUP BY ALL HAVING coalesce(min((bx - ax) * (i.r - ay) - (by_ - ay) * (i.c - ax)), 0) >= 0) i)"""
#: The chamfer distance of two pixels that are dr and dc apart, in 65,536ths.
CHAMFER = "(CASE WHEN least({dr}, {dc}) * 2 <= greatest({dr}, {dc}) THEN 143976 * least({dr}, {dc}) + 65536 * (greatest({dr}, {dc}) - 2 * least({dr}, {dc})) ELSE 143976 * (greatest({dr}, {dc}) - least({dr}, {dc})) + 91750 * (2 * least({dr}, {dc}) - greatest({dr}, {dc})) END)"
DRAWN = "('0x' || substr(md5({}), 1, 8))::BIGINT / 4294967296.0::DOUBLE"

PICTURE_SQL: dict[str, str] = {
    "bicubic_resize": _resized("bicubic"),
    "lanczos_resize": _resized("lanczos"),
    "paste_back_result": _pasted(),
    "expand_hull": f"""WITH RECURSIVE {MASK}, {COMPONENTS}, {HULL}, reaches AS (SELECT *, CASE id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 10 END * (id % 2 + 1) AS reach FROM m)
 SELECT m.id, m.p, (count(hull.id) > 0)::BIGINT AS v FROM reaches m LEFT JOIN hull ON hull.id = m.id AND abs(hull.r - m.r) <= m.reach AND abs(hull.c - m.c) <= m.reach GROUP BY m.id, m.p""",
    "outer_contours": f"""WITH RECURSIVE {NESTED}, {COMPONENTS}, {GROUND}, {HULL},
 outer_ones AS (SELECT DISTINCT lab.id, lab.label FROM lab LEFT JOIN ground g ON g.id = lab.id AND abs(g.r - lab.r) + abs(g.c - lab.c) = 1 WHERE lab.r IN (0, 7) OR lab.c IN (0, 7) OR g.id IS NOT NULL),
 a AS (SELECT id, count(DISTINCT label) AS n FROM lab GROUP BY id), b AS (SELECT id, count(*) AS n FROM outer_ones GROUP BY id), h AS (SELECT id, count(*) AS n FROM hull GROUP BY id)
 SELECT e.vec_id AS id, coalesce(a.n, 0) AS n_components, coalesce(b.n, 0) AS n_outer, coalesce(h.n, 0) AS hull_area FROM embeddings e LEFT JOIN a ON a.id = e.vec_id LEFT JOIN b ON b.id = e.vec_id LEFT JOIN h ON h.id = e.vec_id""",
    "random_holes": f"""WITH {PIXELS}, m AS (SELECT id, p, r, c, v > 0 AS s, {DRAWN.format("'holes-' || id || '-' || p")} < 0.04 AS seed, CASE id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 20 END AS reach FROM px),
 cut AS (SELECT a.id, a.p, a.s, a.s AND count(b.id) = 0 AS stays FROM m a LEFT JOIN m b ON b.id = a.id AND b.seed AND abs(a.r - b.r) <= a.reach AND abs(a.c - b.c) <= a.reach GROUP BY a.id, a.p, a.s),
 n AS (SELECT id, count(*) FILTER (WHERE stays) < count(*) FILTER (WHERE s) * 0.4::DOUBLE AS undone FROM cut GROUP BY id)
 SELECT cut.id, p, (CASE WHEN undone THEN s ELSE stays END)::BIGINT AS v FROM cut JOIN n ON n.id = cut.id""",
    "shrink_chamfer": f"""WITH {PIXELS}, m AS (SELECT id, p, r, c, v > -0.1 AS s FROM px), n AS (SELECT id, count(*) FILTER (WHERE s) AS n, 0.5 + 0.2 * {DRAWN.format("'shrink-' || id")} AS keep FROM m GROUP BY id),
 d AS (SELECT a.id, a.p, coalesce(min({CHAMFER.format(dr="abs(a.r - b.r)", dc="abs(a.c - b.c)")}), 536870911) AS d FROM m a LEFT JOIN m b ON a.id = b.id AND NOT b.s WHERE a.s GROUP BY a.id, a.p),
 k AS (SELECT d.*, row_number() OVER (PARTITION BY d.id ORDER BY d) AS o, n - floor(n * keep)::BIGINT AS less FROM d JOIN n ON d.id = n.id), cut AS (SELECT id, max(d) FILTER (WHERE o <= less) AS cut FROM k GROUP BY id)
 SELECT m.id, m.p, (CASE WHEN s AND coalesce(d.d > cut.cut, true) THEN 1 ELSE 0 END)::BIGINT AS v FROM m LEFT JOIN d ON m.id = d.id AND m.p = d.p LEFT JOIN cut ON m.id = cut.id""",
    "fill_holes": f"""WITH RECURSIVE {NESTED}, gaps AS (SELECT id, p, r, c, p AS label FROM m WHERE NOT s UNION SELECT n.id, n.p, n.r, n.c, x.label FROM gaps x JOIN m n ON NOT n.s AND n.id = x.id AND abs(n.r - x.r) + abs(n.c - x.c) = 1),
 lab AS (SELECT id, p, r, c, min(label) AS label FROM gaps GROUP BY ALL), small AS (SELECT id, label FROM lab GROUP BY id, label HAVING count(*) <= 3 AND NOT bool_or(r IN (0, 7) OR c IN (0, 7)))
 SELECT m.id, m.p, (m.s OR small.id IS NOT NULL)::BIGINT AS v FROM m LEFT JOIN lab ON lab.id = m.id AND lab.p = m.p LEFT JOIN small ON small.id = lab.id AND small.label = lab.label""",
    "drop_small": f"""WITH RECURSIVE {MASK}, {COMPONENTS}, big AS (SELECT id, label FROM lab GROUP BY id, label HAVING count(*) >= 4)
 SELECT m.id, m.p, (big.id IS NOT NULL)::BIGINT AS v FROM m LEFT JOIN lab ON lab.id = m.id AND lab.p = m.p LEFT JOIN big ON big.id = lab.id AND big.label = lab.label""",
    "core_masks": f"""WITH {PIXELS}, m AS (SELECT id, p, r, c, v > 0.2 AS s, v > 0 AS whole FROM px), n AS (SELECT id, count(*) FILTER (WHERE s) AS n FROM m GROUP BY id),
 d AS (SELECT a.id, a.p, min((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c)) AS d FROM m a JOIN m b ON a.id = b.id AND b.s WHERE NOT a.s GROUP BY a.id, a.p),
 k AS (SELECT d.*, row_number() OVER (PARTITION BY d.id ORDER BY d) AS o, floor(n * 1.2)::BIGINT - n AS more FROM d JOIN n ON d.id = n.id), cut AS (SELECT id, max(d) FILTER (WHERE o <= more) AS cut FROM k GROUP BY id),
 g AS (SELECT m.id, s, whole, s OR coalesce(d.d <= cut.cut, false) AS e FROM m LEFT JOIN d ON m.id = d.id AND m.p = d.p LEFT JOIN cut ON m.id = cut.id),
 t AS (SELECT id, count(*) FILTER (WHERE s) AS area, CASE WHEN count(*) FILTER (WHERE e) > 0 THEN count(*) FILTER (WHERE whole AND NOT e)::DOUBLE / count(*) FILTER (WHERE e) ELSE 0.0 END AS ratio FROM g GROUP BY id)
 SELECT id, round(ratio, 6) AS ratio, area FROM t WHERE ratio > 0.15""",
}
