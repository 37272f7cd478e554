"""Anchors, invariants and re-derivations of the kernels."""

import os
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkernels.operators import friendly, intsort, kmeans, lu, nbody, raytrace, stencil, tsp
from sparkernels.plans.classes import problem
from sparkernels.sources import random, sinks


def test_random_streams(spark):
    assert random.mwc(np.arange(1, 6), 0).tolist() == [820856226, 2331188998, 4033440000, 3169966213, 2572821606]
    assert (random.mwc(np.arange(1, 100_001), 0) & 0xFFFFF).sum() == 52342923481
    assert random.prng_mwc(spark, 1_000_000, 0).selectExpr("sum(u & 1048575) s").first().s == 524411442014
    assert random.lehmer(np.arange(1, 4), 123456789).tolist() == pytest.approx([0.05380315429242475, 0.13206084963495882, 0.7092727290975268], abs=1e-15)
    first = random.bodies(spark, 50).orderBy("id").first()
    assert (first.x, first.y, first.z) == pytest.approx((0.05380315429242475, 0.13206084963495882, 0.7092727290975268), abs=1e-15)
    z, w = random.state(7)
    want = []
    for _ in range(2000):
        z, w = 36969 * (z & 65535) + (z >> 16), 18000 * (w & 65535) + (w >> 16)
        want.append(((z << 16) + w) & 0xFFFFFFFF)
    assert [r.u for r in random.prng_mwc(spark, 2000, 7).orderBy("n").collect()] == want
    assert [(r.t, r.x, r.y) for r in random.towns(spark, 3).orderBy("t").collect()] == [(0, 51, 88), (1, 25, 82), (2, 97, 34)]
    spread = random.normals(spark, 20_000, 5.0, 2.0).selectExpr("avg(v) m", "stddev(v) s").first()
    assert abs(spread.m - 5) < 0.1 and abs(spread.s - 2) < 0.1


@pytest.mark.parametrize("last,pairs", [(200, 3), (2000, 39), (20000, 386)])
def test_friendly_numbers(spark, last, pairs):
    assert friendly.friend_pairs(friendly.interval(spark, 1, last)).first().pairs == pairs


def test_abundance_in_lowest_terms(spark):
    for r in friendly.abundance(friendly.interval(spark, 1, 300)).collect():
        s = sum(d for d in range(1, r.n + 1) if r.n % d == 0)
        assert (r.num, r.den) == (s // math.gcd(s, r.n), r.n // math.gcd(s, r.n))


@pytest.mark.parametrize("n,k", [(8, 3), (9, 3), (1, 2), (7, 1)])
def test_balance(spark, n, k):
    got = [r.worker for r in friendly.balance(friendly.interval(spark, 5, 4 + n), k).orderBy("n").collect()]
    want, j = [0] * n, 0
    for i in range(n % 2, n // 2 + n % 2):
        want[i] = want[n - i - (1 - n % 2)] = j
        j = (j + 1) % k
    assert got == want


@pytest.mark.parametrize("side,wrap,interior", [(64, 265, 246), (128, 1063, 1026)])
def test_corners_of_the_random_image(spark, side, wrap, interior):
    pixels = random.image(spark, side, signed=True)
    assert stencil.count(stencil.corners(pixels, side)).first().corners == wrap
    assert stencil.count(stencil.corners(pixels, side, edge="interior")).first().corners == interior


def test_bands_do_not_change_the_images(spark, monkeypatch):
    pixels, gray = random.image(spark, 48, signed=True).cache(), random.image(spark, 48, signed=False).cache()
    corners = sorted((r.y, r.x) for r in stencil.corners(pixels, 48).collect())
    smooth = sorted(map(tuple, stencil.smooth(gray, 48).collect()))
    monkeypatch.setattr(stencil, "BAND", 48 * 9)
    assert sorted((r.y, r.x) for r in stencil.corners(pixels, 48).collect()) == corners
    assert sorted(map(tuple, stencil.smooth(gray, 48).collect())) == smooth


def test_smoothing_the_random_image(spark):
    gray = random.image(spark, 70, signed=False)
    assert gray.selectExpr("sum(v) s").first().s == 626077
    assert stencil.smooth(gray, 70).selectExpr("sum(v) s").first().s == 520390
    w = stencil.gauss(7)
    assert w.sum() == pytest.approx(1) and (w[3, 3], w[0, 0]) == pytest.approx((0.10268619123294535, 0.00032357564819422116), abs=1e-15)
    rows = sinks.rows_of(stencil.smooth(gray, 70)).orderBy("y").collect()
    assert len(rows) == 70 and rows[0].line == " ".join(["0"] * 70)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=60))
def test_sort_is_an_ordered_permutation(spark, values):
    ints = spark.createDataFrame([(v,) for v in values], "a long")
    got = intsort.sort(ints).orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(len(values))) and [r.a for r in got] == sorted(values)
    if values:
        assert sum(r.cnt for r in intsort.histogram(ints).collect()) == len(values)


def test_kmeans_rounds(spark):
    points = random.points(spark, 300, 4).cache()
    x = np.array([r.features for r in points.orderBy("id").collect()])
    centres, cid = x[:5].astype(float), np.full(300, -1)
    while True:
        d = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
        new = np.where((cid >= 0) & (d[np.arange(300), cid] == d.min(axis=1)), cid, d.argmin(axis=1))
        if (new == cid).all():
            break
        cid = new
        centres = np.array([x[cid == c].mean(axis=0) if (cid == c).any() else np.zeros(4) for c in range(5)])
    got = kmeans.iterate(points, 5)
    assert [r.cid for r in got.orderBy("id").collect()] == cid.tolist()
    assert sum(r.population for r in kmeans.population(got).collect()) == 300


def test_an_empty_cluster_is_the_zero_vector_and_a_tie_stays(spark):
    points = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [-1.0, 0.0], 0)], "id long, features array<double>, cid int")
    same = kmeans.assign(points, np.array([[0.0, 1.0], [0.0, -1.0], [9.0, 9.0]]))
    assert {r.id: (r.cid, r.changed) for r in same.collect()} == {0: (1, False), 1: (0, False)}
    assert {r.cid: r.center for r in kmeans.centroids(same, 3, 2).collect()} == {0: [-1.0, 0.0], 1: [1.0, 0.0], 2: [0.0, 0.0]}


@pytest.mark.parametrize("panel", [64, 5, 1])
def test_factors_multiply_to_the_matrix(spark, panel):
    a = np.random.default_rng(3).normal(size=(18, 18)) + 9 * np.eye(18)
    matrix = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(a)], "i int, row array<double>")
    rows = lu.split(lu.factor(matrix, panel)).orderBy("i").collect()
    assert np.array([r.l for r in rows]) @ np.array([r.u for r in rows]) == pytest.approx(a, abs=1e-9)


def test_full_pivoting_and_zero_pivots(spark):
    a = np.array([[0.0, 2.0, 1.0], [1.0, 0.0, 3.0], [4.0, 1.0, 0.0]])
    matrix = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(a)], "i int, row array<double>")
    with pytest.raises(lu.ZeroPivot):
        lu.factor(matrix)
    packed, rows, columns = lu.factor_pivoted(matrix)
    split = lu.split(packed).orderBy("i").collect()
    assert np.array([r.l for r in split]) @ np.array([r.u for r in split]) == pytest.approx(a[np.ix_(rows, columns)], abs=1e-12)


def test_shortest_paths(spark):
    towns = random.towns(spark, 14)
    assert tsp.shortest(towns).first().len == 245 and tsp.shortest(towns, closed=True).first().len == 295
    d = tsp.matrix(random.towns(spark, 6))
    assert tsp.greedy(d) >= tsp.shortest(random.towns(spark, 6)).first().len
    assert tsp.prefixes(spark, d, 6).selectExpr("min(len) m", "count(*) c").first()[:] == (tsp.shortest(random.towns(spark, 6)).first().len, 120)
    assert [tsp.hops(n) for n in (14, 15, 17, 19, 20)] == [3] * 5 and tsp.hops(17, 16) == 4


def test_momentum_is_kept(spark, monkeypatch):
    bodies = random.bodies(spark, 60).cache()
    whole = nbody.forces(bodies)
    assert whole.selectExpr("abs(sum(fx)) + abs(sum(fy)) + abs(sum(fz)) e", "sum(abs(fx)) s").selectExpr("e / s").first()[0] < 1e-9
    monkeypatch.setattr(nbody, "BLOCK", 17)
    a, b = ({r.id: (r.fx, r.fy, r.fz, r.rmin) for r in df.collect()} for df in (whole, nbody.forces(bodies)))
    assert all(a[i] == pytest.approx(b[i], rel=1e-9) for i in a) and len(b) == 60
    after, time = nbody.simulate(bodies, 2)
    assert after.count() == 60 and time > 0
    assert nbody.next_step(1e12, 0.001, 0.001) == (1e-6, 0.001) and nbody.next_step(1e-9, 0.001, 0.001) == (0.002, 0.001)


def trace(o, d, depth, limit):
    """One ray at a time, by recursion."""
    unit = lambda v: v / np.sqrt(v @ v) if v @ v > 0 else v

    def hit(s, o, d):
        to = np.array(s.center, float) - o
        along = to @ d
        d2 = to @ to - along * along
        if along < 0 or d2 > s.radius**2:
            return None
        half = math.sqrt(s.radius**2 - d2)
        return along + half if along - half < 0 else along - half

    met = [(t, i) for i, s in enumerate(raytrace.SCENE) if (t := hit(s, o, d)) is not None]
    if not met:
        return np.full(3, 2.0)
    t, i = min(met)
    s = raytrace.SCENE[i]
    p = o + d * t
    n = unit(p - np.array(s.center, float))
    within = d @ n > 0
    n = -n if within else n
    if (s.reflection > 0 or s.transparency > 0) and depth < limit:
        fresnel = (1 + d @ n) ** 3 * 0.9 + 0.1
        back = trace(p + 1e-3 * n, unit(d - 2 * (d @ n) * n), depth + 1, limit) * fresnel
        through = np.zeros(3)
        if s.transparency > 0:
            eta = 1.1 if within else 1 / 1.1
            c = -(n @ d)
            k = max(0, 1 - eta * eta * (1 - c * c))
            through = trace(p - 1e-3 * n, unit(d * eta + n * (eta * c - math.sqrt(k))), depth + 1, limit) * (1 - fresnel) * s.transparency
        return (back + through) * np.array(s.surface) + np.array(s.emission)
    c = np.array(s.emission, float)
    for j, light in enumerate(raytrace.SCENE):
        if light.emission[0] > 0:
            to = unit(np.array(light.center, float) - p)
            if all(hit(x, p + 1e-3 * n, to) is None for m, x in enumerate(raytrace.SCENE) if m != j):
                c = c + np.array(s.surface) * max(0, n @ to) * np.array(light.emission)
    return c


def test_picture_against_recursion(spark, tmp_path):
    width, height, depth = 24, 14, 4
    got = {(r.y, r.x): (r.r, r.g, r.b) for r in raytrace.render(spark, width, height, depth).collect()}
    tan = math.tan(math.pi * 15 / 180)
    for y in range(height):
        for x in range(width):
            d = np.array([(2 * ((x + 0.5) / width) - 1) * tan * width / height, (1 - 2 * ((y + 0.5) / height)) * tan, -1])
            want = np.minimum(1, trace(np.zeros(3), d / np.sqrt(d @ d), 0, depth)) * 255
            assert np.abs(np.array(got[y, x]) - want).max() <= 1
    sinks.write_ppm(raytrace.render(spark, width, height, depth), width, height, str(tmp_path / "a.ppm"))
    assert (tmp_path / "a.ppm").read_bytes()[:13] == b"P6\n24 14\n255\n" and (tmp_path / "a.ppm").stat().st_size == 13 + 3 * width * height


def test_nearest_spheres_of_the_scene(spark):
    counts = dict(raytrace.nearest(raytrace.rays(spark, 64, 36)).groupBy("s.sid").count().collect())
    assert counts == {0: 398, 1: 570, 2: 271, 3: 45, 4: 486, None: 534}


def test_problem_classes():
    assert problem("kmeans").sizes == (16384, 1024) and problem("tsp", "huge").sizes == (20,)
    with pytest.raises(ValueError):
        problem("kmeans", "gigantic")


def test_empty_inputs(spark):
    assert friendly.friend_pairs(spark.createDataFrame([], "n long")).first().pairs == 0
    assert stencil.count(stencil.corners(spark.createDataFrame([], "y long, x long, v int"), 0)).first().corners == 0
    assert intsort.sort(spark.createDataFrame([], "a long")).count() == 0
    assert kmeans.iterate(spark.createDataFrame([], "id long, features array<double>"), 3).count() == 0
    assert nbody.forces(random.bodies(spark, 5).where("id < 0")).count() == 0
    assert tsp.shortest(spark.createDataFrame([], "t int, x int, y int")).first().len == 0


def test_kmeans_query_runs_until_nothing_changes(spark, sf_dir):
    from sparkernels import queries

    rows = sorted((r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect())
    x = np.array([e for _, e in rows], np.float64)
    centres, at, rounds = x[: queries.CLUSTERS], None, 0
    while True:
        new = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        rounds += 1
        if at is not None and (new == at).all():
            break
        at = new
        centres = np.array([x[at == c].mean(axis=0) if (at == c).any() else np.zeros(x.shape[1]) for c in range(len(centres))])
    assert rounds > queries.ROUNDS
    found = {r.id: r.cid for r in queries.QUERIES["km_converge"](spark, sf_dir).collect()}
    assert found == {i: int(c) for (i, _), c in zip(rows, at, strict=True)}


def test_polar_numbers_against_the_sequential_method(spark):
    u, at, want = random.mwc(np.arange(1, 40_000), 5).tolist(), 0, []
    while len(want) < 3001:
        a, b = (-1 + x / (2**31 - 1) * 2 for x in u[at : at + 2])
        at += 2
        w = a * a + b * b
        if 0 < w < 1:
            m = np.sqrt(-2 * np.log(w) / w)
            want += [a * m, b * m]
    got = [r.v for r in random.polar(spark, 3001, 0.0, 1.0, 5).orderBy("n").collect()]
    assert got == pytest.approx(want[:3001], rel=1e-12)
    sizes = [r.a for r in random.half_normals(spark, 3001, seed=5).collect()]
    assert sorted(sizes) == sorted(int(abs(65536 * v)) + 1 for v in want[:3001])


def test_a_drawn_start_against_the_sequential_one(spark):
    points = random.points(spark, 200, 4).cache()
    u = random.mwc(np.arange(1, 2000), 3).tolist()
    want, k, at = [-1] * 200, 6, 0
    for c in range(k):
        want[u[at] % 200] = c
        at += 1
    for i in range(200):
        if want[i] < 0:
            want[i], at = u[at] % k, at + 1
    assert [r.cid for r in random.mapping(spark, 200, k, 3).orderBy("id").collect()] == want
    centres, begun = kmeans.drawn_points(points, k, 3)
    assert centres.tolist() == [points.where(f"id = {u[c] % 200}").first().features for c in range(k)] and begun.count() == 200
    ends = kmeans.iterate(points, k, seed=3)
    assert ends.where("changed").count() == 0 and ends.count() == 200


def test_too_many_towns_are_refused(spark):
    with pytest.raises(ValueError, match="20 towns"):
        tsp.distances(random.towns(spark, 30))
    assert tsp.distances(random.towns(spark, 20)).count() == 400


@pytest.mark.parametrize("waves", [1, 2, 7])
def test_the_shared_bound_keeps_the_shortest_path(spark, waves):
    assert tsp.shortest(random.towns(spark, 12), waves=waves).first().len == tsp.shortest(random.towns(spark, 12), waves=1).first().len


def test_one_value_is_dealt_over_partitions(spark):
    ints = spark.createDataFrame([(7,)] * 4000 + [(1,)] * 10, "a long").repartition(4)
    out = intsort.sort(ints)
    assert [tuple(r) for r in out.orderBy("pos").collect()] == list(enumerate([1] * 10 + [7] * 4000))
    from pyspark.sql import functions as F

    from sparkernels.plans import loops

    keys = ints.withColumn("_any", F.rand(1)).repartitionByRange(4, "a", "_any").groupBy(F.spark_partition_id()).count()
    assert max(r["count"] for r in keys.collect()) < 2500
    moved = loops.traffic(ints.groupBy("a").count())
    # The rows dealt out, and one row a value and task of the counts.
    assert 4012 <= moved.read_records <= 4018 and moved.written_bytes > 0


def test_distances_of_many_centres(spark):
    points = random.points(spark, 20, 4).cache()
    centres = np.random.default_rng(0).random((900, 4)) * 60000
    got = {(r.id, r.cid): r.dist for r in kmeans.distances(points, centres).collect()}
    x = {r.id: np.array(r.features, np.float64) for r in points.collect()}
    assert len(got) == 20 * 900 and all(d == pytest.approx(np.linalg.norm(x[i] - centres[c])) for (i, c), d in got.items())


def test_steps_in_time_against_plain_loops(spark):
    bodies = random.bodies(spark, 12)
    rows = sorted(tuple(r) for r in bodies.collect())
    at = {i: (np.array(p[:3]), p[3], np.array(p[4:])) for i, *p in rows}
    dt = old = nbody.FIRST_STEP
    clock = 0.0
    for _ in range(3):
        pull, near = {}, {}
        for i, (p, _, _) in at.items():
            others = [(p - q, m) for j, (q, m, _) in at.items() if j != i]
            pull[i] = -sum(m * d / (d @ d) ** 1.5 for d, m in others)
            near[i] = min(100.0, *(d @ d for d, _ in others))
        top = max(0.0, *(np.sqrt(pull[i] @ pull[i]) / near[i] for i in at))
        a0, a2 = 2 / (dt * (dt + old)), 2 / (old * (dt + old))
        at = {i: ((pull[i] + (a0 + a2) * p - a2 * q) / a0, m, p) for i, (p, m, q) in at.items()}
        new = max(1e-6, 1 / np.sqrt(top))
        if new < dt:
            dt, old = new, dt
        elif new > 4 * dt:
            dt, old = 2 * dt, dt
        clock += old
    after, time = nbody.simulate(bodies, 3)
    assert time == pytest.approx(clock)
    for r in after.collect():
        assert (r.x, r.y, r.z) == pytest.approx(tuple(at[r.id][0]), rel=1e-6)


def test_positions_are_written_as_rows(spark):
    from sparkernels.sources import sinks

    bodies = random.bodies(spark, 3)
    want = {r.id: f"{r.x:.5f} | {r.y:.5f} | {r.z:.5f}" for r in bodies.collect()}
    assert {r.id: r.line for r in sinks.positions_of(bodies).collect()} == want


def folder_bytes(spark):
    from sparkernels.plans import loops

    loops.checkpointed(spark.range(1))
    at = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(at) for f in names)


@pytest.mark.parametrize("history,copies", [(None, 0.0), (1, 1.0), (60, 1.0)])
def test_rounds_of_kmeans_leave_one_copy_of_the_points_at_most(spark, monkeypatch, history, copies):
    points = spark.createDataFrame([(i, [float((i * 37) % 101), float((i * 53) % 97)]) for i in range(4000)], "id long, features array<double>")
    want = sorted((r.id, r.cid, r.dist) for r in kmeans.iterate(points, 6).collect())
    if history:
        monkeypatch.setattr(kmeans, "HISTORY", history)
    before = folder_bytes(spark)
    got = sorted((r.id, r.cid, r.dist) for r in kmeans.iterate(points, 6).collect())
    # A copy takes some 80 bytes a point; the small margin is the probe of folder_bytes.
    assert folder_bytes(spark) - before <= copies * 4000 * 100 + 10_000
    assert got == want


@pytest.mark.parametrize("history", [1, 1 << 18])
def test_ties_over_many_rounds_of_kmeans(spark, monkeypatch, history):
    """Equal starting centres, lattice points and mirrored ones: ties in every round."""
    monkeypatch.setattr(kmeans, "HISTORY", history)
    rows = [(i, [float(v) for v in p]) for i, p in enumerate([(0, 0), (0, 0), (0, 0), (3, 3), (3, 3), *[(a, b) for a in range(-6, 7) for b in range(-6, 7)]])]
    x, k = np.array([p for _, p in rows]), 5
    centres, cid = x[:k], np.full(len(x), -1)
    while True:
        d = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
        new = np.where((cid >= 0) & (d[np.arange(len(x)), cid] == d.min(axis=1)), cid, d.argmin(axis=1))
        if (new == cid).all():
            break
        cid = new
        centres = np.array([x[cid == c].mean(axis=0) if (cid == c).any() else np.zeros(2) for c in range(k)])
    got = kmeans.iterate(spark.createDataFrame(rows, "id long, features array<double>"), k).collect()
    assert [r.cid for r in sorted(got)] == cid.tolist() and not any(r.changed for r in got)
