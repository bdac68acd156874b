"""Queries of the playback and kinematics operators, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.vectors import rounded
from ..operators import kinematics as K
from ..operators import playback as B
from ..operators import progress as P
from ..sources import recordings as R
from ..streaming import follower as L
from . import progress_sql as S
from .dataset_queries import r6
from .progress_queries import _GRID, curve

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _as_chunks(frames: DataFrame) -> DataFrame:
    return frames.select(F.col("episode").alias("chunk"), (F.col("frame") + 1).alias("k"), "q")


_TIMED = f"""t0 AS (SELECT episode, frame, q0, greatest(coalesce(abs(q0 - lag(q0) {S._E}), abs(lead(q0) {S._E} - q0), 0) / 50, 0.06) AS dt FROM f),
tm AS (SELECT episode, frame, q0, sum(dt) {S._E} AS time FROM t0),
t1 AS (SELECT *, (lead(q0) {S._E} - q0) / (lead(time) {S._E} - time) AS s FROM tm), t2 AS (SELECT *, lag(s) {S._E} AS b FROM t1),
tg AS (SELECT *, CASE WHEN b IS NULL THEN s WHEN s IS NULL THEN b WHEN b * s <= 0 THEN 0.0 ELSE greatest(-3 * least(abs(b), abs(s)), least(3 * least(abs(b), abs(s)), (b + s) / 2)) END AS m FROM t2)"""


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.tangents(B.schedule(_as_chunks(R.user_recordings(spark, sf_dir)), 50.0, 0.06))


@query(f"WITH {S.USERS}, {_TIMED} SELECT episode AS chunk, (frame + 1)::BIGINT AS k, round(time, 6) AS time, round(m, 5) + 0.0 AS m FROM tg")
def playback_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _timed(spark, sf_dir).select("chunk", "k", *r6("time"), rounded(F.col("m")[0], 5).alias("m"))


def _ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _timed(spark, sf_dir)
    ends = c.groupBy("chunk").agg(F.floor(F.max("time") / 0.5).alias("n"))
    at = ends.select("chunk", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), "n"), lambda i: i * 0.5)).alias("tau"))
    return B.evaluate(c, at)


_TICKS = f"""{_TIMED}, tk AS (SELECT episode, i * 0.5 AS tau FROM (SELECT episode, unnest(generate_series(0, floor(max(time) / 0.5)::BIGINT)) AS i FROM tm GROUP BY episode)),
kn AS (SELECT *, lead(time) {S._E} AS nt, lead(q0) {S._E} AS nq, lead(m) {S._E} AS nm FROM tg), fi AS (SELECT episode, q0 AS first FROM tg WHERE frame = 0),
ev AS (SELECT tk.episode, tk.tau, first, kn.* EXCLUDE (episode), nt - time AS h, (tau - time) / (nt - time) AS u FROM tk JOIN fi USING (episode) ASOF LEFT JOIN kn ON tk.episode = kn.episode AND tk.tau >= kn.time),
vl AS (SELECT episode, tau, (frame IS NULL OR nt IS NULL OR (frame = 0 AND tau <= time)) AS held, coalesce(q0, first) AS hq,
    (2*u*u*u - 3*u*u + 1) * q0 + (u*u*u - 2*u*u + u) * m * h + (3*u*u - 2*u*u*u) * nq + (u*u*u - u*u) * nm * h AS q,
    ((6*u*u - 6*u) * q0 + (3*u*u - 4*u + 1) * m * h + (6*u - 6*u*u) * nq + (3*u*u - 2*u) * nm * h) / h AS v FROM ev),
pv AS (SELECT episode, tau, CASE WHEN held THEN hq ELSE q END AS q, CASE WHEN held THEN 0.0 ELSE v END AS v FROM vl)"""


@query(f"WITH {S.USERS}, {_TICKS} SELECT episode AS chunk, round(tau, 3)::DOUBLE AS tau, round(q, 7) + 0.0 AS q, round(degrees(v), 4) + 0.0 AS v FROM pv")
def playback_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position and velocity at every half second; velocities in degrees, as in halves and quarters they fall on ties."""
    return _ticks(spark, sf_dir).select("chunk", F.round("tau", 3).alias("tau"), rounded(F.col("q")[0], 7).alias("q"), rounded(F.degrees(F.col("v")[0]), 4).alias("v"))


@query(f"""WITH {S.USERS}, {_TICKS}, j AS (SELECT *, abs(v - lag(v) OVER (PARTITION BY episode ORDER BY tau)) AS jump FROM pv)
    SELECT episode AS chunk, count(*)::BIGINT AS ticks, round(quantile_cont(jump, 0.99), 4) AS p99, round(max(jump), 4) AS largest FROM j GROUP BY episode""")
def velocity_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.velocity_jumps(_ticks(spark, sf_dir)).select("chunk", "ticks", F.round("p99", 4).alias("p99"), F.round("largest", 4).alias("largest"))


@query("""SELECT label AS episode, vec_id, CASE WHEN list_position(list_transform(embedding, lambda x: x > 0.2), true) > 0 THEN list_position(list_transform(embedding, lambda x: x > 0.2), true)::BIGINT END AS step FROM embeddings""")
def first_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return x.select(F.col("label").alias("episode"), "vec_id", B.first_trigger(F.col("embedding"), 0.2).alias("step"))


@query(f"""WITH {S.SUPPLIERS}, e AS (SELECT episode, frame // 50 AS chunk, arg_min([q0, q1, q2, q3], frame) AS a, arg_max([q0, q1, q2, q3], frame) AS b FROM f GROUP BY ALL),
    g AS (SELECT *, list_distance(a, lag(b) OVER (PARTITION BY episode ORDER BY chunk)) AS gap FROM e) SELECT episode, chunk::BIGINT AS chunk, round(gap, 5) AS gap FROM g WHERE gap IS NOT NULL""")
def chunk_seams(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = R.supplier_recordings(spark, sf_dir).select("episode", F.floor(F.col("frame") / 50).alias("chunk"), F.col("frame").alias("k"), "q")
    return B.seams(x).withColumn("gap", F.round("gap", 5))


@query(f"""WITH {S.curve()}, {S.knots()}, {_GRID}, {S.located('targets')}, r AS (SELECT p.episode, round_even(t, 0)::BIGINT AS fr FROM p)
    SELECT episode, count(*)::BIGINT AS picked, count(DISTINCT fr)::BIGINT AS "distinct", round((max(fr) + 1) / count(*), 6) AS speedup FROM r GROUP BY episode""")
def retimed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.retimed(P.resample(curve(spark, sf_dir))).select("episode", "picked", "distinct", *r6("speedup"))


_BACK4 = S.squares(f"q{{i}} - lag(q{{i}}) {S._E}")
_BACK4V = S.squares(f"v{{i}} - lag(v{{i}}) OVER (PARTITION BY episode ORDER BY sample)")


@query(f"""WITH {S.curve()}, {S.knots()}, {_GRID}, {S.located('targets')}, a AS (SELECT episode, sum(d) AS a FROM (SELECT p.episode, {_BACK4V} AS d FROM p) GROUP BY episode),
    b AS (SELECT episode, sum(d) AS b FROM (SELECT episode, {_BACK4} AS d FROM f) GROUP BY episode) SELECT episode, round(a / b, 6) AS ratio FROM a JOIN b USING (episode)""")
def overshoot(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = P.resample(curve(spark, sf_dir)).select("episode", F.col("sample").alias("frame"), "q")
    return B.overshoot(r, R.supplier_recordings(spark, sf_dir)).select("episode", *r6("ratio"))


_PAIRS = """pr AS (SELECT episode % 2 AS task, frame % 7 = 0 AS on_now, CASE WHEN on_ THEN frame % 50 + 1 END AS label, CASE WHEN on_ AND q3 > 0.02 OR q0 = 50 THEN (frame + q0::BIGINT) % 50 + 1 END AS predicted FROM f)"""


@query(f"""WITH {S.SUPPLIERS}, {_PAIRS}, d AS (SELECT *, predicted - label AS delta FROM pr WHERE NOT on_now)
    SELECT task, round(CASE WHEN count(label) > 0 THEN count(delta) / count(label) * 100 END, 4) AS recall, (count(predicted) - count(delta))::BIGINT AS false_fires, count(delta)::BIGINT AS compared,
    quantile_cont(delta, 0.5)::DOUBLE AS p50, round(quantile_cont(abs(delta), 0.9), 4)::DOUBLE AS p90, round(avg((abs(delta) <= 5)::INT), 6) AS within_5 FROM d GROUP BY task""")
def suction_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigger steps against made-up predictions."""
    x = R.supplier_recordings(spark, sf_dir)
    on, k = F.col("commands")[0] > 0.5, F.col("frame") % 50 + 1
    guess = F.when((on & (F.col("q")[3] > 0.02)) | (F.col("q")[0] == 50), (F.col("frame") + F.rint(F.col("q")[0]).cast("long")) % 50 + 1)
    rows = x.select((F.col("episode") % 2).alias("task"), (F.col("frame") % 7 == 0).alias("on_now"), F.when(on, k).alias("label"), guess.alias("predicted"))
    return B.suction_report(rows).select("task", F.round("recall", 4).alias("recall"), "false_fires", "compared", "p50", F.round("p90", 4).alias("p90"), *r6("within_5"))


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = R.supplier_recordings(spark, sf_dir)
    near = F.transform("q", lambda v, i: v + F.sin(F.col("frame") + i) * (F.col("frame") % 50 + 1) / 100)
    return x.select((F.col("frame") % 50 + 1).alias("k"), F.col("q").alias("label"), near.alias("predicted"))


_OFF = [f"sin(frame + {i}) * (frame % 50 + 1) / 100" for i in range(4)]


@query(f"""WITH {S.SUPPLIERS}, d AS (SELECT frame % 50 + 1 AS k, sqrt({' + '.join(f"power(q{i} - (q{i} + {o}), 2)" for i, o in enumerate(_OFF))}) AS d FROM f)
    SELECT k::BIGINT AS k, round(quantile_cont(d, 0.5), 6) AS p50, round(quantile_cont(d, 0.95), 6) AS p95, round(max(d), 6) AS largest FROM d GROUP BY k""")
def horizon_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error by step against made-up predictions."""
    return B.horizon_errors(_predicted(spark, sf_dir)).select("k", *r6("p50", "p95", "largest"))


@query(f"""WITH {S.SUPPLIERS}, d AS ({' UNION ALL '.join(f"SELECT {i} AS dim, abs(q{i} - (q{i} + {o})) AS e FROM f" for i, o in enumerate(_OFF))})
    SELECT dim::INT AS dim, round(avg(e), 6) AS error FROM d GROUP BY dim ORDER BY error DESC, dim LIMIT 1""")
def worst_joint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.worst_joint(_predicted(spark, sf_dir)).select("dim", *r6("error"))


def rate_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = B.limited(_ticks(spark, sf_dir), B.Limits(60.0, 400.0, 4000.0), 0.5)
    return out.groupBy("chunk").agg(F.count(F.lit(1)).alias("ticks"), F.round(F.max(F.abs(F.col("v")[0])), 4).alias("fastest"))


def replan_splices(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = P.progress_curve(R.user_recordings(spark, sf_dir), P.ProgressConfig(approach=2))
    steps = P.look_ahead(c)
    asked = B.replan_frames(steps, 10)
    return B.splice(steps, asked, 10).groupBy("episode").agg(F.countDistinct("chunk").alias("chunks"), F.count(F.lit(1)).alias("points"))


def junction_speeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = B.junction_speeds(R.supplier_recordings(spark, sf_dir), [30.0, 60.0, 0.05, 0.04], [300.0, 600.0, 0.5, 0.4])
    return out.select("episode", "frame", *(F.round(F.col("v")[i], 5).alias(f"v{i}") for i in range(4)))


def greedy_keypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.greedy_keypoints(R.supplier_recordings(spark, sf_dir), 60)


def spline_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.spline_errors(R.supplier_recordings(spark, sf_dir), 40).select("episode", *r6("p95"))


def window_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = B.window_budgets(R.supplier_recordings(spark, sf_dir), 200, 40, 25)
    return out.groupBy("episode").agg(F.count(F.lit(1)).alias("windows"), *(F.round(F.median(c), 5).alias(c) for c in ("anchored", "causal")))


def principal_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.principal_paths(R.vector_recordings(spark, sf_dir)).select("episode", *(F.round(F.col("ratios")[i], 5).alias(f"ratio{i}") for i in range(2)))


#: A planar arm of two links, for which the tip has a closed form.
ARM = [K.Joint("shoulder", (0.0, 0.0, 0.0), (0.0, 0.0, 0.0), (0.0, 0.0, 1.0)), K.Joint("elbow", (0.5, 0.0, 0.0), (0.0, 0.0, 0.0), (0.0, 0.0, 1.0)), K.Joint("tip", (0.3, 0.0, 0.0), (0.0, 0.0, 0.0), None)]


@query("""SELECT vec_id, round(0.5 * cos(a) + 0.3 * cos(a + b), 5) + 0.0 AS x, round(0.5 * sin(a) + 0.3 * sin(a + b), 5) + 0.0 AS y
    FROM (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings)""")
def tip_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    p = x.select("vec_id", K.tip_position(ARM, F.slice(F.col("embedding").cast("array<double>"), 1, 2)).alias("p"))
    return p.select("vec_id", rounded(F.col("p")[0], 5).alias("x"), rounded(F.col("p")[1], 5).alias("y"))


@query("""WITH v AS (SELECT embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, label FROM embeddings),
    e AS (SELECT label, sqrt(power(0.5 * cos(a) + 0.3 * cos(a + b) - 0.5 * cos(a + 0.01) - 0.3 * cos(a + b + 0.01), 2) + power(0.5 * sin(a) + 0.3 * sin(a + b) - 0.5 * sin(a + 0.01) - 0.3 * sin(a + b + 0.01), 2)) * 1000 AS mm FROM v)
    SELECT label, round(quantile_cont(mm, 0.5), 4) AS p50, round(quantile_cont(mm, 0.95), 4) AS p95 FROM e GROUP BY label""")
def tip_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Millimetres at the tip for an error of 0.01 at the shoulder."""
    x = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("label", F.slice(F.col("embedding").cast("array<double>"), 1, 2).alias("q"))
    off = F.array(F.col("q")[0] + 0.01, F.col("q")[1])
    mm = x.select("label", (V.distance(K.tip_position(ARM, F.col("q")), K.tip_position(ARM, off)) * 1000).alias("mm"))
    return mm.groupBy("label").agg(*(F.round(F.percentile("mm", F.lit(p)), 4).alias(n) for p, n in ((0.5, "p50"), (0.95, "p95"))))


def _chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = R.vector_recordings(spark, sf_dir).select(F.col("episode").alias("robot"), F.floor(F.col("frame") / 10).alias("seq"), "frame", F.slice("q", 1, 4).alias("q"))
    rows = x.groupBy("robot", "seq").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("frame", "q"))), lambda r: r["q"])).alias("chunk"))
    return rows.select("robot", "seq", "chunk", F.lit(4).alias("width"), F.lit(0.05).alias("latency"), F.lit(40).alias("ticks"))


def chunk_follower(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = L.follow_batch(_chunk_rows(spark, sf_dir), L.PlaybackConfig(limits=B.Limits(2.0, 20.0, 400.0)))
    return out.groupBy("robot").agg(F.count(F.lit(1)).alias("ticks"), F.round(F.max(F.array_max(F.transform("v", lambda v: F.abs(v)))), 4).alias("fastest"))


for _f in (rate_limited, replan_splices, junction_speeds, greedy_keypoints, spline_errors, window_budgets, principal_paths, chunk_follower):
    QUERIES[_f.__name__] = _f
