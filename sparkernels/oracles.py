"""The kernels' queries as DuckDB SQL, written from their definitions."""

from __future__ import annotations

from .operators import raytrace, stencil
from .queries import CLUSTERS, HEIGHT, LEHMER_SEED, MASK, PREFIX, WIDTH, WORKERS
from .sources import random

SQL: dict[str, str] = {}

_Z, _W = random.state()
SQL["prng_mwc"] = f"""
WITH RECURSIVE s(n, z, w) AS (
  SELECT 0::BIGINT, {_Z}::BIGINT, {_W}::BIGINT
  UNION ALL
  SELECT n + 1, 36969 * (z & 65535) + (z >> 16), 18000 * (w & 65535) + (w >> 16) FROM s WHERE n < (SELECT count(*) FROM customer))
SELECT n, ((((z & 65535) << 16) + w) & 4294967295)::BIGINT AS u FROM s WHERE n > 0"""
SQL["prng_lehmer"] = f"""
WITH RECURSIVE s(n, v) AS (
  SELECT 0::BIGINT, {LEHMER_SEED}::BIGINT
  UNION ALL
  SELECT n + 1, v * 48271 % 2147483647 FROM s WHERE n < (SELECT count(*) FROM customer))
SELECT n, round(v / 2147483647.0::DOUBLE, 12) AS r FROM s WHERE n > 0"""

_NATURALS = "nat AS (SELECT p_partkey + 1 AS n FROM part)"
_SIGMA = f"{_NATURALS}, sig AS (SELECT n, list_sum(list_filter(range(1, n + 1), lambda d: n % d = 0))::BIGINT AS sigma FROM nat)"
_ABUNDANCE = f"{_SIGMA}, ab AS (SELECT n, (sigma // gcd(sigma, n))::BIGINT AS num, (n // gcd(sigma, n))::BIGINT AS den FROM sig)"
SQL["fn_sigma"] = f"WITH {_SIGMA} SELECT n, sigma FROM sig"
SQL["fn_abundance"] = f"WITH {_ABUNDANCE} SELECT n, num, den FROM ab"
SQL["fn_friend_pairs"] = f"WITH {_ABUNDANCE} SELECT count(*)::BIGINT AS pairs FROM ab a JOIN ab b ON a.num = b.num AND a.den = b.den AND a.n > b.n"
SQL["fn_friends"] = f"WITH {_ABUNDANCE} SELECT a.n AS a, b.n AS b FROM ab a JOIN ab b ON a.num = b.num AND a.den = b.den AND a.n > b.n"
SQL["fn_balance"] = f"""
WITH {_NATURALS}, p AS (SELECT n, n - min(n) OVER () AS i, max(n) OVER () - min(n) OVER () + 1 AS k FROM nat)
SELECT n, (CASE WHEN k % 2 = 0 THEN least(i, k - 1 - i) % {WORKERS} WHEN i = 0 THEN 0 ELSE (least(i, k - i) - 1) % {WORKERS} END)::INT AS worker FROM p"""


def _image(mask: int) -> str:
    return f"""side AS (SELECT ceil(sqrt(max(event_id) + 1))::BIGINT AS w FROM events),
px AS (SELECT r.i // w AS y, r.i % w AS x, coalesce(floor(value)::INT & {mask}, 0)::INT AS v
  FROM side, range((SELECT w * w FROM side)) r(i) LEFT JOIN events ON event_id = r.i)"""


_RING = ", ".join(f"({k}, {dx}, {dy})" for k, (dx, dy) in enumerate(stencil.RING))
_GATHER = f"""{_image(127)},
ring(k, dx, dy) AS (VALUES {_RING}),
g AS (SELECT a.y, a.x, k, a.v AS p, b.v AS q FROM side, px a CROSS JOIN ring
  LEFT JOIN px b ON a.x + dx >= 0 AND a.y + dy >= 0 AND b.y = (a.y * w + dy * w + a.x + dx) // w AND b.x = (a.y * w + dy * w + a.x + dx) % w)"""
_CLASS = f"""{_GATHER},
c AS (SELECT y, x, k, (CASE WHEN q >= p + 20 THEN 1 WHEN q <= p - 20 THEN -1 ELSE 0 END)::INT AS class FROM g)"""
_CORNERS = f"""{_CLASS},
r AS (SELECT y, x, list(class ORDER BY k) AS l FROM c GROUP BY y, x),
corner AS (SELECT y, x FROM r WHERE len(list_filter(range(0, 16), lambda s: abs(list_sum(list_transform(range(0, 12), lambda i: l[(s + i) % 16 + 1]))) = 12)) > 0)"""
SQL["fast_ring"] = f"WITH {_GATHER} SELECT y, x, k, p, q FROM g"
SQL["fast_class"] = f"WITH {_CLASS} SELECT y, x, k, class FROM c"
SQL["fast_corners"] = f"WITH {_CORNERS} SELECT y, x FROM corner"
SQL["fast_count"] = f"WITH {_CORNERS} SELECT count(*)::BIGINT AS corners FROM corner"

_N = MASK // 2
_MASK = f"""m AS (SELECT dy, dx, exp(-((dy * dy + dx * dx) / 2.0::DOUBLE * 0.8::DOUBLE * 0.8::DOUBLE)) AS e
  FROM (SELECT (i // {MASK} - {_N})::INT AS dy, (i % {MASK} - {_N})::INT AS dx FROM range({MASK * MASK}) t(i))),
mask AS (SELECT dy, dx, e / sum(e) OVER () AS w FROM m)"""
SQL["gf_mask"] = f"WITH {_MASK} SELECT dy, dx, round(w, 10) AS w FROM mask"
SQL["gf_filter"] = f"""
WITH {_image(255)}, {_MASK},
s AS (SELECT a.y, a.x, sum(b.v * mask.w) AS t FROM side, px a CROSS JOIN mask JOIN px b ON b.y = a.y + dy AND b.x = a.x + dx
  WHERE a.y >= {_N} AND a.x >= {_N} AND a.y < side.w - {_N} AND a.x < side.w - {_N} GROUP BY a.y, a.x)
SELECT px.y, px.x, (CASE WHEN t IS NULL THEN 0 ELSE least(255, floor(round(t, 6))) END)::INT AS v FROM px LEFT JOIN s USING (y, x)"""

SQL["is_max"] = "SELECT max(l_partkey) AS max FROM lineitem"
_HIST = """b AS (SELECT least(255, l_partkey // greatest(1, (SELECT max(l_partkey) FROM lineitem) // 256))::INT AS bucket FROM lineitem),
h AS (SELECT bucket, count(*)::BIGINT AS cnt FROM b GROUP BY bucket)"""
SQL["is_bucket_hist"] = f"WITH {_HIST} SELECT bucket, cnt FROM h"
SQL["is_offsets"] = f"WITH {_HIST} SELECT bucket, cnt, (sum(cnt) OVER (ORDER BY bucket) - cnt)::BIGINT AS start FROM h"
SQL["is_sort"] = "SELECT row_number() OVER (ORDER BY l_partkey) - 1 AS pos, l_partkey AS a FROM lineitem"


def _dist(centres: str, at: str) -> str:
    return f"""SELECT p.vec_id AS id, c.cid, sqrt(list_sum(list_transform(range(1, len(p.embedding) + 1),
  lambda i: (p.embedding[i]::DOUBLE - c.center[i]) * (p.embedding[i]::DOUBLE - c.center[i])))) AS dist FROM embeddings p CROSS JOIN {centres} c{at}"""


_FIRST = f"c0 AS (SELECT (row_number() OVER (ORDER BY vec_id) - 1)::INT AS cid, list_transform(embedding, lambda v: v::DOUBLE) AS center FROM embeddings ORDER BY vec_id LIMIT {CLUSTERS})"


def _round(k: int) -> str:
    """Distances, assignment and centres of round k; ties keep the cluster of the round before, else take the lowest."""
    was = f" LEFT JOIN a{k - 1} o ON o.id = d.id" if k else ""
    keep = "d.cid <> coalesce(o.cid, -1), " if k else ""
    return f"""d{k} AS ({_dist(f"c{k}", "")}),
a{k} AS (SELECT id, cid, dist FROM (SELECT d.id, d.cid, d.dist, row_number() OVER (PARTITION BY d.id ORDER BY d.dist, {keep}d.cid) AS nth FROM d{k} d{was}) WHERE nth = 1),
t{k} AS (SELECT a.cid, u.d, count(*)::BIGINT AS population, sum(u.v) AS total FROM a{k} a JOIN embeddings e ON e.vec_id = a.id,
  LATERAL (SELECT unnest(range(0, len(e.embedding)))::INT AS d, unnest(e.embedding)::DOUBLE AS v) u GROUP BY a.cid, u.d),
c{k + 1} AS (SELECT c.cid, coalesce(m.center, list_transform(c.center, lambda v: 0.0::DOUBLE)) AS center FROM c{k} c
  LEFT JOIN (SELECT cid, list(total / population ORDER BY d) AS center FROM t{k} GROUP BY cid) m USING (cid))"""


SQL["km_distance"] = f"WITH {_FIRST}, {_round(0)} SELECT id, cid, round(dist, 6) AS dist FROM d0"
SQL["km_assign"] = f"WITH {_FIRST}, {_round(0)} SELECT id, cid, round(dist, 6) AS dist FROM a0"
SQL["km_population"] = f"WITH {_FIRST}, {_round(0)} SELECT cid, count(*)::BIGINT AS population FROM a0 GROUP BY cid"
SQL["km_centroids"] = f"WITH {_FIRST}, {_round(0)} SELECT cid, unnest(range(0, len(center)))::INT AS d, round(unnest(center), 6) AS v FROM c1"
SQL["km_partial_agg"] = f"WITH {_FIRST}, {_round(0)} SELECT cid, population, d, round(total, 4) AS total FROM t0"
SQL["km_iterate"] = f"WITH {_FIRST}, {_round(0)}, {_round(1)}, {_round(2)} SELECT id, cid FROM a2"

_GRAM = """e AS (SELECT vec_id, unnest(range(0, len(embedding)))::INT AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
g AS (SELECT a.i, b.i AS j, sum(a.v * b.v) AS v FROM e a JOIN e b USING (vec_id) GROUP BY a.i, b.i)"""
SQL["lu_pivot"] = f"WITH {_GRAM} SELECT i, j, round(v, 4) AS v FROM g ORDER BY abs(v) DESC, i, j LIMIT 1"
SQL["lu_reduce"] = f"""
WITH {_GRAM}, top AS (SELECT j, v FROM g WHERE i = 0), m AS (SELECT i, v / (SELECT v FROM top WHERE j = 0) AS m FROM g WHERE j = 0)
SELECT g.i, g.j, round(CASE WHEN g.i = 0 THEN g.v WHEN g.j = 0 THEN m.m ELSE g.v - m.m * top.v END, 4) AS v FROM g JOIN m USING (i) JOIN top USING (j)"""
_LU = f"""{_GRAM}, f(k, i, j, v) AS (
  SELECT 0, i, j, v FROM g
  UNION ALL
  SELECT a.k + 1, a.i, a.j, CASE WHEN a.i <= a.k THEN a.v WHEN a.j < a.k THEN a.v WHEN a.j = a.k THEN a.v / d.v ELSE a.v - h.v / d.v * t.v END
  FROM f a JOIN f d ON d.i = a.k AND d.j = a.k JOIN f t ON t.i = a.k AND t.j = a.j JOIN f h ON h.i = a.i AND h.j = a.k
  WHERE a.k < (SELECT max(i) FROM g)),
packed AS (SELECT i, j, v FROM f WHERE k = (SELECT max(i) FROM g))"""
SQL["lu_factor"] = f"WITH RECURSIVE {_LU} SELECT i, j, round(v, 3) AS v FROM packed"
SQL["lu_split"] = f"""WITH RECURSIVE {_LU}
SELECT i, j, round(CASE WHEN j < i THEN v WHEN j = i THEN 1 ELSE 0 END, 3) AS l, round(CASE WHEN j >= i THEN v ELSE 0 END, 3) AS u FROM packed"""

_TOWNS = """t AS (SELECT (s_suppkey % 9)::INT AS t, (sum(s_nationkey * 4) % 100)::INT AS x, (sum(floor(abs(s_acctbal))::BIGINT) % 100)::INT AS y FROM supplier GROUP BY 1),
d AS (SELECT a.t AS src, b.t AS dst, floor(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)))::INT AS dist FROM t a CROSS JOIN t b)"""
_PATHS = f"""{_TOWNS}, f(hops, path, len) AS (
  SELECT 1, [0], 0
  UNION ALL
  SELECT hops + 1, list_append(path, dst), (len + dist)::INT FROM f JOIN d ON src = path[-1] AND NOT list_contains(path, dst))"""
SQL["tsp_distances"] = f"WITH {_TOWNS} SELECT src, dst, dist, (row_number() OVER (PARTITION BY src ORDER BY dist, dst) - 1)::INT AS rank FROM d"
SQL["tsp_prefixes"] = f"WITH RECURSIVE {_PATHS} SELECT array_to_string(path, '-') AS path, len FROM f WHERE hops = {PREFIX}"
SQL["tsp_min"] = f"WITH RECURSIVE {_PATHS} SELECT min(len)::BIGINT AS len FROM f WHERE hops = (SELECT count(*) FROM t)"
SQL["tsp_cuts"] = f"""
WITH RECURSIVE {_TOWNS}, walk(path, len) AS (
  SELECT [0], 0
  UNION ALL
  SELECT list_append(path, n.dst), (len + n.dist)::INT FROM walk, LATERAL (SELECT arg_min(dst, dist * 1000 + dst) AS dst, min(dist) AS dist FROM d WHERE src = path[-1] AND NOT list_contains(path, dst)) n WHERE n.dst IS NOT NULL),
bound AS (SELECT max(len) AS bound FROM walk WHERE len(path) = (SELECT count(*) FROM t)),
f(hops, path, len) AS (
  SELECT 1, [0], 0
  UNION ALL
  SELECT hops + 1, list_append(path, dst), (len + dist)::INT FROM f JOIN d ON src = path[-1] AND NOT list_contains(path, dst) WHERE len < (SELECT bound FROM bound)),
n AS (SELECT unnest(range(2, (SELECT count(*) FROM t) + 1))::INT AS hops)
SELECT n.hops, c.cuts, (c.cuts * factorial(((SELECT count(*) FROM t) - n.hops)::INT))::BIGINT AS paths
FROM n, LATERAL (SELECT count(*)::BIGINT AS cuts FROM f WHERE f.hops = n.hops AND len >= (SELECT bound FROM bound)) c"""

_BODIES = "b AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"
_FORCES = f"""{_BODIES},
p AS (SELECT a.id, a.x - b.x AS dx, a.y - b.y AS dy, a.z - b.z AS dz, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS r2 FROM b a JOIN b ON a.id <> b.id),
f AS (SELECT b.id, coalesce(-sum(dx / (r2 * sqrt(r2))), 0) AS fx, coalesce(-sum(dy / (r2 * sqrt(r2))), 0) AS fy, coalesce(-sum(dz / (r2 * sqrt(r2))), 0) AS fz, least(100, coalesce(min(r2), 100)) AS rmin
  FROM b LEFT JOIN p ON p.id = b.id AND r2 > 0 GROUP BY b.id)"""
SQL["nb_forces"] = f"WITH {_FORCES} SELECT id, round(fx, 2) AS fx, round(fy, 2) AS fy, round(fz, 2) AS fz, round(rmin, 2) AS rmin FROM f"
SQL["nb_maxforce"] = f"WITH {_FORCES} SELECT round(log10(max(sqrt(fx * fx + fy * fy + fz * fz) / rmin)), 6) AS log_max_f FROM f"
_A0 = 2 / (0.001 * 0.002)
SQL["nb_step"] = f"""WITH {_FORCES}
SELECT id, {", ".join(f"round((f{c} + {2 * _A0!r}::DOUBLE * {c} - {_A0!r}::DOUBLE * {c}) / {_A0!r}::DOUBLE, 5) AS {c}" for c in "xyz")} FROM b JOIN f USING (id)"""

_SPHERES = ", ".join(f"({i}, {s.center[0]}::DOUBLE, {s.center[1]}::DOUBLE, {s.center[2]}::DOUBLE, {s.radius}::DOUBLE, {s.surface[0]}::DOUBLE, {s.surface[1]}::DOUBLE, {s.surface[2]}::DOUBLE, {s.emission[0]}::DOUBLE)" for i, s in enumerate(raytrace.SCENE))
_RAYS = f"""ss(sid, cx, cy, cz, r, sr, sg, sb, e) AS (VALUES {_SPHERES}),
raw AS (SELECT (i // {WIDTH})::INT AS y, (i % {WIDTH})::INT AS x,
  (2 * ((i % {WIDTH} + 0.5) / {WIDTH}) - 1) * tan(pi() * 0.5 * 30 / 180) * ({WIDTH}::DOUBLE / {HEIGHT}) AS xx,
  (1 - 2 * ((i // {WIDTH} + 0.5) / {HEIGHT})) * tan(pi() * 0.5 * 30 / 180) AS yy FROM range({WIDTH * HEIGHT}) t(i)),
ray AS (SELECT y, x, xx / sqrt(xx * xx + yy * yy + 1) AS dx, yy / sqrt(xx * xx + yy * yy + 1) AS dy, -1 / sqrt(xx * xx + yy * yy + 1) AS dz FROM raw)"""
_HITS = f"""{_RAYS},
tc AS (SELECT *, cx * dx + cy * dy + cz * dz AS tca, cx * cx + cy * cy + cz * cz AS ll FROM ray CROSS JOIN ss),
hit AS (SELECT *, tca - sqrt(r * r - (ll - tca * tca)) AS t0, tca + sqrt(r * r - (ll - tca * tca)) AS t1 FROM tc WHERE tca >= 0 AND ll - tca * tca <= r * r)"""
_NEAR = f"""{_HITS},
near AS (SELECT * FROM (SELECT *, CASE WHEN t0 < 0 THEN t1 ELSE t0 END AS t, row_number() OVER (PARTITION BY y, x ORDER BY CASE WHEN t0 < 0 THEN t1 ELSE t0 END, sid) AS nth FROM hit) WHERE nth = 1)"""
SQL["rt_rays"] = f"WITH {_RAYS} SELECT y, x, round(dx, 6) AS dx, round(dy, 6) AS dy, round(dz, 6) AS dz FROM ray"
SQL["rt_intersect"] = f"WITH {_HITS} SELECT y, x, sid, round(t0, 4) AS t0, round(t1, 4) AS t1 FROM hit"
SQL["rt_nearest"] = f"WITH {_NEAR} SELECT ray.y, ray.x, sid, round(t, 4) AS t FROM ray LEFT JOIN near USING (y, x)"
SQL["rt_diffuse"] = f"""WITH {_NEAR},
pt AS (SELECT y, x, sid, sr, sg, sb, e, dx, dy, dz, dx * t AS px, dy * t AS py, dz * t AS pz, dx * t - cx AS ax, dy * t - cy AS ay, dz * t - cz AS az FROM near),
nn AS (SELECT *, ax / sqrt(ax * ax + ay * ay + az * az) AS n1, ay / sqrt(ax * ax + ay * ay + az * az) AS n2, az / sqrt(ax * ax + ay * ay + az * az) AS n3 FROM pt),
fl AS (SELECT *, CASE WHEN dx * n1 + dy * n2 + dz * n3 > 0 THEN -1 ELSE 1 END AS s FROM nn),
fr AS (SELECT * EXCLUDE (n1, n2, n3), n1 * s AS n1, n2 * s AS n2, n3 * s AS n3, px + n1 * s * 0.001::DOUBLE AS ox, py + n2 * s * 0.001::DOUBLE AS oy, pz + n3 * s * 0.001::DOUBLE AS oz FROM fl),
lr AS (SELECT fr.*, l.cx - px AS lx, l.cy - py AS ly, l.cz - pz AS lz FROM fr, ss l WHERE l.e > 0),
ln AS (SELECT * EXCLUDE (lx, ly, lz), lx / sqrt(lx * lx + ly * ly + lz * lz) AS lx, ly / sqrt(lx * lx + ly * ly + lz * lz) AS ly, lz / sqrt(lx * lx + ly * ly + lz * lz) AS lz FROM lr),
sh AS (SELECT DISTINCT y, x FROM (SELECT ln.y, ln.x, o.r, (o.cx - ox) * lx + (o.cy - oy) * ly + (o.cz - oz) * lz AS tca,
  (o.cx - ox) * (o.cx - ox) + (o.cy - oy) * (o.cy - oy) + (o.cz - oz) * (o.cz - oz) AS ll FROM ln, ss o WHERE o.sid <> 5) WHERE tca >= 0 AND ll - tca * tca <= r * r),
lit AS (SELECT ln.*, CASE WHEN sh.y IS NULL THEN greatest(0, n1 * lx + n2 * ly + n3 * lz) * 3 ELSE 0 END AS k FROM ln LEFT JOIN sh USING (y, x))
SELECT y, x, sid, round(sr * k + e, 4) AS r, round(sg * k + e, 4) AS g, round(sb * k + e, 4) AS b FROM lit"""
