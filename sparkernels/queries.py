"""Every kernel step as a query over whole warehouse tables; the SQL for each stands in oracles.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import friendly, intsort, kmeans, lu, nbody, raytrace, stencil, tsp
from .sources import random, tables

#: Sizes that are parameters of the queries and of their SQL.
WORKERS, CLUSTERS, ROUNDS, MASK, PREFIX = 7, 8, 3, 7, 4
WIDTH, HEIGHT, DEPTH = 64, 36, 5
LEHMER_SEED = 123456789

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def prng_mwc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return random.prng_mwc(spark, tables.table(spark, sf_dir, "customer").count())


@query
def prng_lehmer(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = random.prng_lehmer(spark, tables.table(spark, sf_dir, "customer").count(), LEHMER_SEED)
    return out.select("n", F.round("r", 12).alias("r"))


@query
def fn_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return friendly.sigma(tables.naturals(spark, sf_dir))


@query
def fn_abundance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return friendly.abundance(tables.naturals(spark, sf_dir))


@query
def fn_friend_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return friendly.friend_pairs(tables.naturals(spark, sf_dir))


@query
def fn_friends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return friendly.friends(tables.naturals(spark, sf_dir))


@query
def fn_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return friendly.balance(tables.naturals(spark, sf_dir), WORKERS)


@query
def fast_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.ring(*tables.image(spark, sf_dir, 127))


@query
def fast_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.classes(stencil.ring(*tables.image(spark, sf_dir, 127)))


@query
def fast_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.corners(*tables.image(spark, sf_dir, 127)).select("y", "x")


@query
def fast_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.count(stencil.corners(*tables.image(spark, sf_dir, 127)))


@query
def gf_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.mask(spark, MASK).select("dy", "dx", F.round("w", 10).alias("w"))


@query
def gf_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.smooth(*tables.image(spark, sf_dir, 255), MASK)


@query
def is_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intsort.largest(tables.integers(spark, sf_dir))


@query
def is_bucket_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intsort.histogram(tables.integers(spark, sf_dir))


@query
def is_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intsort.offsets(tables.integers(spark, sf_dir))


@query
def is_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intsort.sort(tables.integers(spark, sf_dir))


def _first_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = tables.points(spark, sf_dir)
    return kmeans.assign(points, kmeans.first_points(points, CLUSTERS))


def _dim(spark: SparkSession, sf_dir: str) -> int:
    return tables.points(spark, sf_dir).agg(F.max(F.size("features"))).first()[0]


@query
def km_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = tables.points(spark, sf_dir)
    return kmeans.distances(points, kmeans.first_points(points, CLUSTERS)).select("id", "cid", F.round("dist", 6).alias("dist"))


@query
def km_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _first_round(spark, sf_dir).select("id", "cid", F.round("dist", 6).alias("dist"))


@query
def km_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.population(_first_round(spark, sf_dir))


@query
def km_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = kmeans.centroids(_first_round(spark, sf_dir), CLUSTERS, _dim(spark, sf_dir))
    return means.select("cid", F.posexplode("center").alias("d", "v")).select("cid", "d", F.round("v", 6).alias("v"))


@query
def km_partial_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = kmeans.totals(kmeans.partial_sums(_first_round(spark, sf_dir), CLUSTERS, _dim(spark, sf_dir)))
    return merged.select("cid", "population", "d", F.round("total", 4).alias("total"))


@query
def km_iterate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.iterate(tables.points(spark, sf_dir), CLUSTERS, ROUNDS).select("id", "cid")


@query
def km_converge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds until no point changes its cluster; km_iterate is the first ROUNDS of them, as far as SQL is written out."""
    return kmeans.iterate(tables.points(spark, sf_dir), CLUSTERS).select("id", "cid")


@query
def lu_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lu.pivot(tables.gram(spark, sf_dir)).select("i", "j", F.round("v", 4).alias("v"))


@query
def lu_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lu.reduce(tables.gram(spark, sf_dir), 0)
    return done.select("i", F.posexplode("row").alias("j", "v")).select("i", "j", F.round("v", 4).alias("v"))


@query
def lu_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lu.factor(tables.gram(spark, sf_dir)).select("i", F.posexplode("row").alias("j", "v")).select("i", "j", F.round("v", 3).alias("v"))


@query
def lu_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = lu.split(lu.factor(tables.gram(spark, sf_dir)))
    cells = packed.select("i", F.posexplode(F.arrays_zip("l", "u")).alias("j", "c"))
    return cells.select("i", "j", F.round("c.l", 3).alias("l"), F.round("c.u", 3).alias("u"))


@query
def tsp_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tsp.distances(tables.towns(spark, sf_dir))


@query
def tsp_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tsp.prefixes(spark, tsp.matrix(tables.towns(spark, sf_dir)), PREFIX)
    return found.select(F.array_join(F.transform("path", lambda t: t.cast("string")), "-").alias("path"), "len")


@query
def tsp_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tsp.shortest(tables.towns(spark, sf_dir))


@query
def tsp_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tsp.cuts(spark, tsp.matrix(tables.towns(spark, sf_dir)))


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if c in columns else F.col(c) for c in df.columns])


@query
def nb_forces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(nbody.forces(tables.bodies(spark, sf_dir)), 2, "fx", "fy", "fz", "rmin")


@query
def nb_maxforce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbody.max_force(nbody.forces(tables.bodies(spark, sf_dir))).select((F.round(F.log10(F.greatest("max_f", F.lit(1e-300))), 6)).alias("log_max_f"))


@query
def nb_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = tables.bodies(spark, sf_dir)
    after = nbody.moved(bodies, nbody.forces(bodies), nbody.FIRST_STEP, nbody.FIRST_STEP)
    return _rounded(after.select("id", "x", "y", "z"), 5, "x", "y", "z")


@query
def nb_simulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(nbody.simulate(tables.bodies(spark, sf_dir), 2)[0].select("id", "x", "y", "z"), 4, "x", "y", "z")


@query
def rt_rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raytrace.rays(spark, WIDTH, HEIGHT).select("y", "x", *[F.round(f"d.{c}", 6).alias(f"d{c}") for c in "xyz"])


@query
def rt_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = raytrace.intersections(raytrace.rays(spark, WIDTH, HEIGHT))
    return met.select("y", "x", F.col("s.sid").alias("sid"), F.round("t0", 4).alias("t0"), F.round("t1", 4).alias("t1"))


@query
def rt_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = raytrace.nearest(raytrace.rays(spark, WIDTH, HEIGHT))
    return hits.select("y", "x", F.col("s.sid").alias("sid"), F.round("t", 4).alias("t"))


@query
def rt_diffuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    lit = raytrace.shaded(raytrace.nearest(raytrace.rays(spark, WIDTH, HEIGHT)))
    return _rounded(lit, 4, "r", "g", "b")


@query
def rt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raytrace.render(spark, WIDTH, HEIGHT, DEPTH)
