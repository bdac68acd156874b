"""Queries of the shape and keypoint operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.vectors import rounded
from ..operators import shape as G
from ..sources import recordings as R
from . import progress_sql as S
from .dataset_queries import r6
from .progress_queries import _STEP, curve

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_W = "OVER (PARTITION BY episode ORDER BY frame ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING)"
_BACK = S.squares(f"q{{i}} - lag(q{{i}}) {S._E}")
_NET = "sqrt(" + " + ".join(f"power(last(q{i}) {_W} - first(q{i}) {_W}, 2)" for i in range(4)) + ")"
_SHAPE = f"""h0 AS (SELECT *, coalesce(sum(step) {S._E}, 0) AS arc FROM (SELECT *, {_BACK} AS step FROM f)),
h1 AS (SELECT episode, frame, q0, q1, last(arc) {_W} - first(arc) {_W} AS path, {_NET} AS net, last(frame) {_W} - first(frame) {_W} AS span FROM h0),
h AS (SELECT *, path / greatest(net, 1e-3) AS tau, path / greatest(span, 1) * 30 AS speed,
    CASE WHEN path < 900 THEN 'still' WHEN path / greatest(net, 1e-3) > 20 THEN 'hunt' ELSE 'transit' END AS phase FROM h1)"""


def _shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = G.local_shape(R.supplier_recordings(spark, sf_dir))
    return x.withColumn("phase", G.phase(F.col("path"), F.col("tau"), 900.0, 20.0))


@query(f"WITH {S.SUPPLIERS}, {_SHAPE} SELECT episode, frame::BIGINT AS frame, round(path, 5) AS path, round(net, 5) AS net, round(tau, 4) AS tau, round(speed, 4) AS speed, phase FROM h")
def local_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shape(spark, sf_dir).select("episode", "frame", F.round("path", 5).alias("path"), F.round("net", 5).alias("net"), F.round("tau", 4).alias("tau"), F.round("speed", 4).alias("speed"), "phase")


_DENSITY = f"""ends AS (SELECT episode, total, step, ceil(round(total / step, 9))::BIGINT AS n FROM c WHERE frame = 0),
targets AS (SELECT episode, i * step AS target FROM (SELECT *, unnest(generate_series(0, n - 1)) AS i FROM ends WHERE n > 0)),
dn AS (SELECT episode, least(floor(t), last)::BIGINT AS frame, count(*) AS points FROM (SELECT targets.episode, k.last, k.frame + CASE WHEN k.next_x IS NULL THEN 0 ELSE (target - x) / (next_x - x) END AS t
    FROM targets ASOF JOIN k ON targets.episode = k.episode AND target >= k.x) GROUP BY ALL)"""


@query(f"WITH {S.curve()}, {S.knots()}, {_DENSITY} SELECT episode, sum(points)::BIGINT AS points, count(*)::BIGINT AS frames, max(points)::BIGINT AS most FROM dn GROUP BY episode")
def resample_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = G.resample_density(curve(spark, sf_dir))
    return d.groupBy("episode").agg(F.sum("points").alias("points"), F.count(F.lit(1)).alias("frames"), F.max("points").alias("most"))


@query(f"""WITH {S.curve()}, {S.knots()}, {_DENSITY}, {_SHAPE}, j AS (SELECT phase, count(*) AS frames, coalesce(sum(points), 0) AS points FROM h LEFT JOIN dn USING (episode, frame) GROUP BY phase)
    SELECT phase, frames::BIGINT AS frames, points::BIGINT AS points, round((points / sum(points) OVER ()) / (frames / sum(frames) OVER ()), 6) AS ratio FROM j""")
def phase_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.phase_density(_shape(spark, sf_dir), G.resample_density(curve(spark, sf_dir))).select("phase", "frames", "points", *r6("ratio"))


@query(f"""WITH {S.SUPPLIERS}, {_SHAPE}, b AS (SELECT (path >= 800)::INT + (path >= 900)::INT AS row, (tau >= 10)::INT + (tau >= 20)::INT + (tau >= 40)::INT AS c FROM h)
    SELECT row::INT AS row, {', '.join(f"round(count(*) FILTER (WHERE c = {i}) / sum(count(*)) OVER (), 6) AS t{i}" for i in range(4))}, round(count(*) / sum(count(*)) OVER (), 6) AS total FROM b GROUP BY row""")
def path_tortuosity_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.path_tortuosity_table(_shape(spark, sf_dir), [800.0, 900.0], [10.0, 20.0, 40.0]).select("row", *r6("t0", "t1", "t2", "t3", "total"))


@query(f"""WITH {S.SUPPLIERS}, {_SHAPE}, v AS (SELECT round(tau, 4) AS tau, on_ AS pos FROM h JOIN f USING (episode, frame)),
    r AS (SELECT pos, rank() OVER (ORDER BY tau) + (count(*) OVER (PARTITION BY tau) - 1) / 2 AS rk FROM v)
    SELECT round((sum(rk) FILTER (WHERE pos) - count(*) FILTER (WHERE pos) * (count(*) FILTER (WHERE pos) + 1) / 2) / (count(*) FILTER (WHERE pos) * count(*) FILTER (WHERE NOT pos)), 6) AS auc FROM r""")
def event_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well tortuosity tells the frames whose command is on."""
    on = R.supplier_recordings(spark, sf_dir).select("episode", "frame", (F.col("commands")[0] > 0.5).alias("on"))
    rows = _shape(spark, sf_dir).join(on, ["episode", "frame"]).select(F.round("tau", 4).alias("tau"), "on")
    return G.auc(rows, "tau", "on").select(rounded(F.col("auc")).alias("auc"))


@query(f"""WITH {S.SUPPLIERS}, e AS (SELECT floor(q0 / 10)::BIGINT AS v0, floor(q1 / 10)::BIGINT AS v1, episode, sum(sqrt(q1)) AS s, count(*) AS n FROM f GROUP BY ALL),
    o AS (SELECT episode, sum(s) AS es, sum(n) AS en FROM e GROUP BY episode), t AS (SELECT sum(es) AS ts, sum(en) AS tn FROM o),
    p AS (SELECT e.*, sum(s) OVER w - s AS os, sum(n) OVER w - n AS oth FROM e WINDOW w AS (PARTITION BY v0, v1))
    SELECT v0, v1, episode, n::BIGINT AS n, round(s / n, 6) AS own, round(CASE WHEN oth > 0 THEN os / oth ELSE (ts - es) / (tn - en) END, 6) AS prior FROM p JOIN o USING (episode), t""")
def occupancy_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = R.supplier_recordings(spark, sf_dir).select("episode", G.voxel(F.slice("q", 1, 2), 10.0).alias("voxel"), F.sqrt(F.col("q")[1]).alias("v"))
    out = G.occupancy_prior(x, "v")
    return out.select(F.col("voxel")[0].alias("v0"), F.col("voxel")[1].alias("v1"), "episode", "n", *r6("own", "prior"))


_LAST = "e AS (SELECT episode, max(frame) AS last FROM f GROUP BY episode), grid AS (SELECT episode, last, unnest(generate_series(0, 39)) AS i FROM e)"
_ARC = f"cs AS (SELECT episode, frame AS pos, coalesce(sum(step) {S._E}, 0) + frame * 1e-12 AS c FROM (SELECT *, {_BACK} AS step FROM f))"
_BEND = S.squares(f"(lead(q{{i}}) {S._E} - q{{i}}) - (q{{i}} - lag(q{{i}}) {S._E})")
_CURV = f"""b0 AS (SELECT *, {_BEND} AS bend FROM f), b1 AS (SELECT *, coalesce(bend, lead(bend) {S._E}, lag(bend) {S._E}) AS b FROM b0),
cs AS (SELECT episode, frame + 1 AS pos, sum(power(b + 1e-12, 1.0 / 3)) {S._E} + (frame + 1) * 1e-12 AS c FROM b1 UNION ALL SELECT episode, 0, 0.0 FROM f WHERE frame = 0)"""
_PLACE = """ck AS (SELECT *, lead(c) OVER (PARTITION BY episode ORDER BY pos) AS nc, max(c) OVER (PARTITION BY episode) AS top FROM cs),
tg AS (SELECT grid.episode, i, last, i * top / 39 AS target FROM grid JOIN (SELECT episode, top FROM ck WHERE pos = 0) USING (episode)),
ps AS (SELECT tg.episode, i, last, pos + CASE WHEN nc IS NULL THEN 0 ELSE (target - c) / (nc - c) END AS p FROM tg ASOF JOIN ck ON tg.episode = ck.episode AND target >= c)"""
_GAP = """pu AS (SELECT *, max(p - i) OVER (PARTITION BY episode ORDER BY i) + i AS pp FROM ps), pe AS (SELECT *, max(pp) OVER (PARTITION BY episode) AS pend FROM pu),
pl AS (SELECT *, CASE WHEN pend > last THEN least(greatest(min(pp - i) OVER (PARTITION BY episode ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) + i, 0), last) ELSE pp END AS position FROM pe)"""


@query(f"WITH {S.SUPPLIERS}, {_LAST} SELECT episode, i::INT AS i, round(i * last / 39, 5) AS position FROM grid")
def keypoints_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.keypoints(R.supplier_recordings(spark, sf_dir), "time", 40).withColumn("position", F.round("position", 5))


@query(f"WITH {S.SUPPLIERS}, {_LAST}, {_ARC}, {_PLACE} SELECT episode, i::INT AS i, round(p, 5) AS position FROM ps")
def keypoints_arc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.keypoints(R.supplier_recordings(spark, sf_dir), "arc", 40).withColumn("position", F.round("position", 5))


@query(f"WITH {S.SUPPLIERS}, {_LAST}, {_CURV}, {_PLACE}, {_GAP} SELECT episode, i::INT AS i, round(position, 5) AS position FROM pl")
def keypoints_curvature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.keypoints(R.supplier_recordings(spark, sf_dir), "curvature", 40).withColumn("position", F.round("position", 5))


@query(f"WITH {S.SUPPLIERS}, {_LAST}, {_CURV}, {_PLACE} SELECT episode, round(avg((g < 1)::INT), 6) AS crowded FROM (SELECT *, p - lag(p) OVER (PARTITION BY episode ORDER BY i) AS g FROM ps) GROUP BY episode")
def keypoint_crowding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.crowding(R.supplier_recordings(spark, sf_dir), 40).select("episode", *r6("crowded"))


_KEYS = """kk AS (SELECT DISTINCT episode, least(greatest(round_even(p, 0), 0), last)::BIGINT AS frame FROM {0}),
kf AS (SELECT f.*, lead(f.frame) OVER w AS nf, """ + ", ".join(f"lead(q{i}) OVER w AS n{i}" for i in range(4)) + " FROM f JOIN kk USING (episode, frame) WINDOW w AS (PARTITION BY episode ORDER BY f.frame)),\n"
_LINEAR = _KEYS + "rb AS (SELECT f.*, " + ", ".join(f"coalesce(kf.q{i} + (kf.n{i} - kf.q{i}) * ((f.frame - kf.frame) / (kf.nf - kf.frame)), kf.q{i}) AS r{i}" for i in range(4)) + " FROM f ASOF JOIN kf ON f.episode = kf.episode AND f.frame >= kf.frame),\ner AS (SELECT episode, quantile_cont(" + S.squares("q{i} - r{i}") + ", 0.95) AS p FROM rb GROUP BY episode)"


@query(f"WITH {S.SUPPLIERS}, {_LAST}, {_ARC}, {_PLACE}, {_LINEAR.format('ps')} SELECT episode, round(p, 6) AS p95 FROM er")
def reconstruction_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = R.supplier_recordings(spark, sf_dir)
    r = G.reconstruct(x, G.keypoints(x, "arc", 40))
    return r.groupBy("episode").agg(rounded(F.percentile(V.distance(F.col("q"), F.col("r")), F.lit(0.95))).alias("p95"))


@query(f"""WITH {S.SUPPLIERS}, {_LAST}, {_CURV}, {_PLACE}, {_GAP}, pq AS (SELECT episode, last, position AS p FROM pl), {_LINEAR.format('pq')}
    SELECT 'curvature' AS rule, 40 AS budget, round(median(p), 6) AS p95 FROM er""")
def budget_curvature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.budget_errors(R.supplier_recordings(spark, sf_dir), ["curvature"], [40]).select("rule", "budget", *r6("p95"))


def budget_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule and budget with both reconstructions, on the short recordings."""
    x = R.user_recordings(spark, sf_dir)
    out = [G.budget_errors(x, ["time", "arc", "curvature"], [10, 20], how).withColumn("how", F.lit(how)) for how in ("linear", "pchip")]
    return out[0].unionByName(out[1]).select("rule", "budget", "how", *r6("p95"))


QUERIES["budget_study"] = budget_study


@query(f"""WITH {S.USERS}, seg AS (SELECT episode, q0 AS a0, frame AS a1, lead(q0) {S._E} AS b0, lead(frame) {S._E} AS b1 FROM f),
    pt AS (SELECT episode, frame, q0 + 0.5 AS p0, frame AS p1 FROM f), sg AS (SELECT * FROM seg WHERE b0 IS NOT NULL),
    j AS (SELECT pt.episode, pt.frame, p0, p1, a0, a1, b0, b1, (b0 - a0) * (b0 - a0) + (b1 - a1) * (b1 - a1) AS l2, ((p0 - a0) * (b0 - a0) + (p1 - a1) * (b1 - a1)) AS dt FROM pt JOIN sg ON pt.episode = sg.episode),
    u AS (SELECT *, greatest(0, least(1, dt / CASE WHEN l2 > 0 THEN l2 ELSE 1 END)) AS u FROM j)
    SELECT episode, frame::BIGINT AS frame, round(min(sqrt(power(p0 - a0 - u * (b0 - a0), 2) + power(p1 - a1 - u * (b1 - a1), 2))), 5) AS gap FROM u GROUP BY episode, frame""")
def distance_to_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moved points against the path of their episode, value over frame."""
    x = R.user_recordings(spark, sf_dir).select(F.col("episode").alias("key"), "frame", F.array(F.col("q")[0], F.col("frame").cast("double")).alias("q"))
    moved = x.select("key", F.col("frame").alias("i"), F.array(F.col("q")[0] + 0.5, F.col("q")[1]).alias("p"))
    out = G.nearest_on_path(moved, x.select("key", F.col("frame").alias("j"), "q"))
    return out.select(F.col("key").alias("episode"), F.col("i").alias("frame"), F.round("gap", 5).alias("gap"))


@query(f"""WITH {S.SUPPLIERS}, a AS (SELECT *, coalesce(sum(step) {S._E}, 0) AS s, max(frame) OVER (PARTITION BY episode) AS last FROM (SELECT *, {_BACK} AS step FROM f)),
    w AS (SELECT episode, frame, s + 125.0 AS target FROM a) SELECT w.episode, w.frame::BIGINT AS frame, least(a.last, a.frame + 2)::BIGINT AS until FROM w ASOF JOIN a ON w.episode = a.episode AND w.target >= a.s""")
def path_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = R.supplier_recordings(spark, sf_dir)
    return G.path_ahead(x, x.select("episode", "frame", F.lit(100.0).alias("arc")))


@query(f"""WITH {S.USERS}, n AS (SELECT episode, max(frame) AS last FROM f GROUP BY episode), lo AS (SELECT episode, unnest(generate_series(0, last - 21, 10)) AS lo FROM n WHERE last >= 21),
    w AS (SELECT lo.episode, lo, frame, q0 FROM lo JOIN f ON lo.episode = f.episode AND frame BETWEEN lo AND lo + 20),
    m AS (SELECT episode, lo, avg(q0) AS m FROM w GROUP BY ALL), z AS (SELECT w.episode, w.lo, frame, (q0 + m) / 2 AS r FROM w JOIN m USING (episode, lo))
    SELECT a.episode, a.lo::BIGINT AS lo, round(quantile_cont(abs(a.r - b.r), 0.95), 6) AS jitter FROM z a JOIN z b ON a.episode = b.episode AND b.lo = a.lo + 10 AND a.frame = b.frame GROUP BY ALL""")
def window_jitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows pulled half way to their means, compared where neighbours overlap."""
    from pyspark.sql import Window

    w = G.sliding(R.user_recordings(spark, sf_dir), 20, 10)
    mean = F.avg(F.col("q")[0]).over(Window.partitionBy("episode", "lo"))
    r = w.withColumn("r", F.array((F.col("q")[0] + mean) / 2))
    return G.replan_jitter(r, 10).select("episode", "lo", *r6("jitter"))


@query(f"""WITH {S.SUPPLIERS}, s AS (SELECT episode, frame, ({' + '.join(f"{(59 - 5 * i * i) / 231!r} * {'lag' if i < 0 else 'lead'}(q0, {abs(i)}) {S._E}" for i in range(-4, 5))}) AS smooth, q0 FROM f)
    SELECT episode, frame::BIGINT AS frame, round(smooth, 5) + 0.0 AS smooth FROM s WHERE smooth IS NOT NULL""")
def smoothed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = G.smoothed(R.supplier_recordings(spark, sf_dir).withColumn("q", F.slice("q", 1, 1)))
    return x.where("smooth IS NOT NULL").select("episode", "frame", rounded(F.col("smooth")[0], 5).alias("smooth"))


@query("""WITH e(space, budget, p95) AS (VALUES ('wide', 10, 40.0), ('wide', 20, 20.0), ('narrow', 20, 30.0), ('narrow', 100, 10.0), ('narrow', 200, 4.0)),
    b AS (SELECT budget * 3 AS size, p95, lead(budget * 3) OVER (ORDER BY budget) AS ns, lead(p95) OVER (ORDER BY budget) AS np FROM e WHERE space = 'narrow')
    SELECT budget AS wide_budget, budget * 22 AS size, e.p95::DOUBLE AS wide_p95, round((b.p95 + CASE WHEN ns IS NULL THEN 0 ELSE (budget * 22 - b.size) / (ns - b.size) END * (coalesce(np, b.p95) - b.p95))::DOUBLE, 6) AS narrow_p95
    FROM e JOIN b ON budget * 22 >= b.size AND (budget * 22 < ns OR ns IS NULL) WHERE space = 'wide'""")
def payload_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.createDataFrame([("wide", 10, 40.0), ("wide", 20, 20.0), ("narrow", 20, 30.0), ("narrow", 100, 10.0), ("narrow", 200, 4.0)], "space string, budget int, p95 double")
    return G.payload_errors(e).select("wide_budget", "size", "wide_p95", *r6("narrow_p95"))
