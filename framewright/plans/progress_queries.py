"""Queries of the progress operators over the encodings, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import rounded
from ..operators import progress as P
from ..sources import recordings as R
from . import progress_sql as S

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.progress_curve(R.supplier_recordings(spark, sf_dir))


_SUMMARY = """SELECT episode, count(*)::BIGINT AS frames, (count(*) FILTER (WHERE event))::BIGINT AS event_frames,
    (count(*) FILTER (WHERE dwell))::BIGINT AS dwell_frames, round(any_value(total), 6) AS total, round(any_value(step), 6) AS step,
    round_even(round(any_value(total) / any_value(step), 9), 0)::BIGINT AS samples FROM c GROUP BY episode"""


def _summary(c: DataFrame) -> DataFrame:
    return P.curve_summary(c).withColumn("total", rounded(F.col("total"))).withColumn("step", rounded(F.col("step")))


@query(f"WITH {S.curve()} {_SUMMARY}")
def progress_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(curve(spark, sf_dir))


@query(f"WITH {S.curve(metric='arc', deadzone=0.002)} {_SUMMARY}")
def progress_summary_arc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(P.progress_curve(R.supplier_recordings(spark, sf_dir), P.ProgressConfig(metric="arc", deadzone=0.002)))


@query(f"WITH {S.curve(S.USERS, approach=2)} {_SUMMARY}")
def progress_summary_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(P.progress_curve(R.user_recordings(spark, sf_dir), P.ProgressConfig(approach=2)))


@query(f"WITH {S.curve()} SELECT episode, frame::BIGINT AS frame, approach, dwell, round(raw, 6) AS raw, round(ds, 6) AS ds, round(s, 6) AS s FROM c")
def progress_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = curve(spark, sf_dir)
    return c.select("episode", "frame", "approach", "dwell", *(F.round(x, 6).alias(x) for x in ("raw", "ds", "s")))


@query(f"WITH {S.curve()} SELECT episode, kind, onset::BIGINT AS onset, measured::BIGINT AS measured, sealed::BIGINT AS sealed, end_::BIGINT AS end_frame FROM w")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = P.event_windows(R.supplier_recordings(spark, sf_dir))
    return w.select("episode", "kind", "onset", "measured", "sealed", F.col("end").alias("end_frame"))


@query(f"""WITH {S.curve()} SELECT episode, min(frame)::BIGINT AS lo, (max(frame) + 1)::BIGINT AS hi, count(*)::BIGINT AS frames,
    round(sum(ds), 6) AS progress FROM c WHERE event GROUP BY episode, island""")
def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-open spans of consecutive event frames."""
    c = curve(spark, sf_dir).where("event")
    return c.groupBy("episode", "island").agg(F.min("frame").alias("lo"), (F.max("frame") + 1).alias("hi"), F.count(F.lit(1)).alias("frames"), rounded(F.sum("ds")).alias("progress")).drop("island")


_GRID = """ends AS (SELECT episode, total, step, round_even(round(total / step, 9), 0)::BIGINT AS n FROM c WHERE frame = 0),
targets AS (SELECT episode, i AS sample, least(i * step, total) AS target FROM (SELECT *, unnest(generate_series(0, n)) AS i FROM ends))"""
_FOUR = ", ".join(f"round(v{i}, 5) + 0.0 AS q{i}" for i in range(4))


@query(f"WITH {S.curve()}, {S.knots()}, {_GRID}, {S.located('targets')} SELECT episode, sample, round(t, 5) AS t, command::DOUBLE AS command, at_event AS event, {_FOUR} FROM p")
def resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = P.resample(curve(spark, sf_dir))
    return r.select("episode", "sample", F.round("t", 5).alias("t"), F.col("commands")[0].alias("command"), "event", *(rounded(F.col("q")[i], 5).alias(f"q{i}") for i in range(4)))


_AHEAD = """targets AS (SELECT episode, frame, h, least(s + h * step, total) AS target FROM (SELECT episode, frame, s, step, total, unnest(generate_series(1, 50)) AS h FROM c))"""


@query(f"""WITH {S.curve()}, {S.knots()}, {_AHEAD}, q AS (SELECT targets.frame AS own, targets.episode AS ep, targets.h, targets.target, k.* FROM targets ASOF JOIN k ON targets.episode = k.episode AND targets.target >= k.x),
    r AS (SELECT *, frame + CASE WHEN next_x IS NULL THEN 0.0 ELSE (target - x) / (next_x - x) END AS t FROM q)
    SELECT episode, own::BIGINT AS frame, round(avg(t), 4) AS mean_t, round(max(t), 4) AS reach,
    (count(*) FILTER (WHERE CASE WHEN frame = last THEN before_event WHEN round_even(t, 0) > frame AND frame + 1 < last THEN next_event ELSE event END))::BIGINT AS key_steps
    FROM r GROUP BY episode, own""")
def look_ahead_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per frame: mean and furthest source frame of its chunk, and how many of its steps are weighted."""
    steps = P.look_ahead(curve(spark, sf_dir))
    return steps.groupBy("episode", "frame").agg(F.round(F.avg("t"), 4).alias("mean_t"), F.round(F.max("t"), 4).alias("reach"), F.count_if(F.col("weight") > 1).alias("key_steps"))


def look_ahead_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat chunk and weights of every frame, on the short recordings."""
    c = P.progress_curve(R.user_recordings(spark, sf_dir), P.ProgressConfig(approach=2))
    out = P.chunks(P.look_ahead(c))
    first = P.unflatten(F.col("action_chunk"), 2)[0]
    return out.select("episode", "frame", F.size("action_chunk").alias("width"), rounded(first[0], 5).alias("first_q"), rounded(F.aggregate("action_loss_weight", F.lit(0.0), lambda a, w: a + w), 5).alias("weight"))


QUERIES["look_ahead_columns"] = look_ahead_columns
_STEP = S.squares(f"lead(q{{i}}) {S._E} - q{{i}}")
_STILL = "still AS (SELECT episode, coalesce(min(CASE WHEN step > 1e-3 THEN frame END), count(*))::BIGINT AS still FROM (SELECT *, " + _STEP + " AS step FROM f) GROUP BY episode)"


@query(f"WITH {S.SUPPLIERS}, {_STILL} SELECT episode, still FROM still")
def still_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.still_until(R.supplier_recordings(spark, sf_dir))


@query(f"WITH {S.USERS}, {_STILL} SELECT episode, count(*)::BIGINT AS kept, min(frame)::BIGINT AS first_frame FROM f JOIN still USING (episode) WHERE frame >= greatest(still - 15, 0) GROUP BY episode")
def lead_in_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = R.user_recordings(spark, sf_dir)
    kept = trim_lead_in(frames, P.still_until(frames))
    return kept.groupBy("episode").agg(F.count(F.lit(1)).alias("kept"), F.min("frame").alias("first_frame"))


def trim_lead_in(frames: DataFrame, still: DataFrame, margin: int = 15) -> DataFrame:
    return frames.join(still, "episode").where(F.col("frame") >= F.greatest(F.col("still") - margin, F.lit(0))).drop("still")
