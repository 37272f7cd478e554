"""Ray casting of spheres: the steps as column expressions over a literal scene, and the whole picture."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import dot, normalize, subtract, vector

BIAS, INDEX, VIEW, BACKGROUND = 1e-3, 1.1, 30.0, 2.0


class Sphere(NamedTuple):
    center: tuple[float, float, float]
    radius: float
    surface: tuple[float, float, float]
    reflection: float = 0.0
    transparency: float = 0.0
    emission: tuple[float, float, float] = (0.0, 0.0, 0.0)


#: The scene.
SCENE = (
    Sphere((0, -10004, -20), 10000, (0.2, 0.2, 0.2)),
    Sphere((0, 0, -20), 4, (1, 0.32, 0.36), 1, 0.5),
    Sphere((5, -1, -15), 2, (0.9, 0.76, 0.46), 1),
    Sphere((5, 0, -25), 3, (0.65, 0.77, 0.97), 1),
    Sphere((-5.5, 0, -15), 3, (0.9, 0.9, 0.9), 1),
    Sphere((0, 30, -30), 3, (0, 0, 0), 0, 0, (3, 3, 3)),
)


def _literal(v: tuple[float, float, float]) -> Column:
    return vector(*map(F.lit, map(float, v)))


def scene(spheres: tuple[Sphere, ...] = SCENE) -> Column:
    """The spheres as an array of structs."""
    return F.array(*[
        F.struct(F.lit(i).alias("sid"), _literal(s.center).alias("center"), F.lit(float(s.radius)).alias("radius"), _literal(s.surface).alias("surface"), F.lit(float(s.reflection)).alias("reflection"), F.lit(float(s.transparency)).alias("transparency"), _literal(s.emission).alias("emission"))
        for i, s in enumerate(spheres)
    ])


def rays(spark: SparkSession, width: int, height: int) -> DataFrame:
    """(y, x, o, d): a ray through each pixel's centre, from the origin towards -z."""
    tan, aspect = math.tan(math.pi * 0.5 * VIEW / 180), width / height
    grid = spark.range(width * height).select(F.floor(F.col("id") / width).cast("int").alias("y"), (F.col("id") % width).cast("int").alias("x"))
    xx = (2 * ((F.col("x") + 0.5) / width) - 1) * tan * aspect
    yy = (1 - 2 * ((F.col("y") + 0.5) / height)) * tan
    return grid.select("y", "x", _literal((0, 0, 0)).alias("o"), normalize(vector(xx, yy, F.lit(-1.0))).alias("d"))


def _crossing(o: Column, d: Column, s: Column) -> tuple[Column, Column, Column]:
    """Whether a ray meets a sphere before it, and where it enters and leaves."""
    to = subtract(s["center"], o)
    along = dot(to, d)
    d2 = dot(to, to) - along * along
    r2 = s["radius"] * s["radius"]
    half = F.sqrt(F.greatest(r2 - d2, F.lit(0.0)))
    return (along >= 0) & (d2 <= r2), along - half, along + half


def intersections(cast: DataFrame, spheres: tuple[Sphere, ...] = SCENE) -> DataFrame:
    """(y, x, o, d, s, t0, t1): a row for each ray and sphere that meet. The scene is a literal, so nothing is joined."""
    each = cast.select("y", "x", "o", "d", F.explode(scene(spheres)).alias("s"))
    hit, t0, t1 = _crossing(F.col("o"), F.col("d"), F.col("s"))
    return each.where(hit).select("y", "x", "o", "d", "s", t0.alias("t0"), t1.alias("t1"))


def nearest(cast: DataFrame, spheres: tuple[Sphere, ...] = SCENE) -> DataFrame:
    """(y, x, o, d, s, t): each ray's nearest sphere, the first of equals; s and t are null where it meets none."""

    def met(s: Column) -> Column:
        hit, t0, t1 = _crossing(F.col("o"), F.col("d"), s)
        return F.when(hit, F.struct(F.when(t0 < 0, t1).otherwise(t0).alias("t"), s["sid"].alias("sid"), s.alias("s")))

    # The least struct: by distance, then by sphere.
    first = F.array_min(F.array_compact(F.transform(scene(spheres), met)))
    return cast.select("y", "x", "o", "d", first.alias("h")).select("y", "x", "o", "d", F.col("h.s").alias("s"), F.col("h.t").alias("t"))


def _direct(p: np.ndarray, n: np.ndarray, surface: np.ndarray, spheres: tuple[Sphere, ...]) -> np.ndarray:
    """What the lights that no other sphere hides add at points p with normals n."""
    colour = np.zeros((len(p), 3))
    for i, light in enumerate(spheres):
        if light.emission[0] > 0:
            to = _unit(np.array(light.center, float) - p)
            others = tuple(s for j, s in enumerate(spheres) if j != i)
            seen = _meet(p + BIAS * n, to, others)[1] < 0
            colour += surface * (np.maximum(0, (n * to).sum(axis=1)) * seen)[:, None] * np.array(light.emission)
    return colour


def _shader(spheres: tuple[Sphere, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surface, emission, center = (np.array([getattr(s, k) for s in spheres], float) for k in ("surface", "emission", "center"))
        for batch in batches:
            y, x, sid = (batch.column(k).to_numpy() for k in range(3))
            o, d = (np.stack([batch.column(k + i).to_numpy() for i in range(3)], axis=1).reshape(-1, 3) for k in (3, 6))
            p = o + d * batch.column(9).to_numpy()[:, None]
            n = _unit(p - center[sid])
            n = np.where((d * n).sum(axis=1, keepdims=True) > 0, -n, n)
            c = _direct(p, n, surface[sid], spheres) + emission[sid]
            yield pa.RecordBatch.from_arrays([pa.array(y), pa.array(x), pa.array(sid), *[pa.array(c[:, k].copy()) for k in range(3)]], ["y", "x", "sid", "r", "g", "b"])

    return run


def shaded(hits: DataFrame, spheres: tuple[Sphere, ...] = SCENE) -> DataFrame:
    """(y, x, sid, r, g, b): direct light where a ray ends: from lights that no other sphere hides, and the sphere's own."""
    flat = hits.where("s is not null").select("y", "x", F.col("s.sid").alias("sid"), *[F.col(f"{v}.{c}").alias(f"{v}{c}") for v in "od" for c in "xyz"], "t")
    return flat.mapInArrow(_shader(spheres), "y int, x int, sid int, r double, g double, b double")


def tone(c: Column) -> Column:
    """A colour component as a byte."""
    return F.floor(F.least(F.lit(1.0), c) * 255).cast("int")


def _meet(o: np.ndarray, d: np.ndarray, spheres: tuple[Sphere, ...]) -> tuple[np.ndarray, np.ndarray]:
    best, who = np.full(len(o), np.inf), np.full(len(o), -1)
    for i, s in enumerate(spheres):
        to = np.array(s.center, float) - o
        along = (to * d).sum(axis=1)
        d2 = (to * to).sum(axis=1) - along * along
        with np.errstate(invalid="ignore"):
            half = np.sqrt(s.radius**2 - d2)
            t = np.where(along - half < 0, along + half, along - half)
            closer = (along >= 0) & (d2 <= s.radius**2) & (t < best)
        best[closer], who[closer] = t[closer], i
    return best, who


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return np.divide(v, n, out=v.copy(), where=n > 0)


def _trace(o: np.ndarray, d: np.ndarray, spheres: tuple[Sphere, ...], depth: int) -> np.ndarray:
    """The colours of rays: a frontier that carries each ray's weight, as colours are linear in those of later rays."""
    colour = np.zeros((len(o), 3))
    of, weight = np.arange(len(o)), np.ones((len(o), 3))
    surface, emission = np.array([s.surface for s in spheres], float), np.array([s.emission for s in spheres], float)
    mirror, clear = np.array([s.reflection for s in spheres]), np.array([s.transparency for s in spheres])
    for level in range(depth + 1):
        if not len(o):
            break
        t, who = _meet(o, d, spheres)
        np.add.at(colour, of[who < 0], BACKGROUND * weight[who < 0])
        o, d, t, of, weight, who = (v[who >= 0] for v in (o, d, t, of, weight, who))
        p = o + d * t[:, None]
        n = _unit(p - np.array([s.center for s in spheres], float)[who]) if len(o) else np.zeros((0, 3))
        within = (d * n).sum(axis=1) > 0
        n = np.where(within[:, None], -n, n)
        np.add.at(colour, of, weight * emission[who])
        deeper = ((mirror[who] > 0) | (clear[who] > 0)) & (level < depth)
        flat = ~deeper
        np.add.at(colour, of[flat], weight[flat] * _direct(p[flat], n[flat], surface[who[flat]], spheres))
        o, d, p, n, of, weight, who, within = (v[deeper] for v in (o, d, p, n, of, weight, who, within))
        cosine = -(d * n).sum(axis=1)
        fresnel = (1 - cosine) ** 3 * 0.9 + 0.1
        thick = clear[who] > 0
        eta = np.where(within, INDEX, 1 / INDEX)
        # No ray comes out where all light is thrown back: the root would not be real.
        k = np.maximum(0, 1 - eta * eta * (1 - cosine * cosine))
        through = _unit(d * eta[:, None] + n * (eta * cosine - np.sqrt(k))[:, None])
        back = _unit(d + 2 * cosine[:, None] * n)
        o = np.concatenate([p + BIAS * n, (p - BIAS * n)[thick]])
        d = np.concatenate([back, through[thick]])
        weight = np.concatenate([weight * surface[who] * fresnel[:, None], (weight * surface[who] * ((1 - fresnel) * clear[who])[:, None])[thick]])
        of = np.concatenate([of, of[thick]])
    return colour


def _painter(width: int, height: int, depth: int, spheres: tuple[Sphere, ...]):
    tan, aspect = math.tan(math.pi * 0.5 * VIEW / 180), width / height

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            y, x = ids // width, ids % width
            d = _unit(np.stack([(2 * ((x + 0.5) / width) - 1) * tan * aspect, (1 - 2 * ((y + 0.5) / height)) * tan, -np.ones(len(x))], axis=1))
            rgb = (np.minimum(1, _trace(np.zeros_like(d), d, spheres, depth)) * 255).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(y.astype(np.int32)), pa.array(x.astype(np.int32)), *[pa.array(rgb[:, k].copy()) for k in range(3)]], ["y", "x", "r", "g", "b"])

    return run


def render(spark: SparkSession, width: int, height: int, depth: int, spheres: tuple[Sphere, ...] = SCENE) -> DataFrame:
    """(y, x, r, g, b): the picture. A pixel needs only the scene, so rays and their offspring never leave their task."""
    return spark.range(width * height).mapInArrow(_painter(width, height, depth, spheres), "y int, x int, r int, g int, b int")
