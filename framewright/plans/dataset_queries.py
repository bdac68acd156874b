"""Queries of the dataset operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import rounded
from ..operators import dataset as D
from ..operators import progress as P
from ..sources import recordings as R
from ..sources.files import scratch
from . import progress_sql as S
from .progress_queries import _GRID, _STEP, _STILL, curve

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(*columns: str) -> list:
    return [rounded(F.col(c)).alias(c) for c in columns]


_LONG = "x AS (" + " UNION ALL ".join(f"SELECT episode, frame, {i} AS dim, q{i} AS x FROM f" for i in range(4)) + ")"
_AUDIT = """audited AS (SELECT episode, count(*)::BIGINT AS frames, max_by(on_::INT, frame)::BIGINT AS held, (count(*) FILTER (WHERE NOT on_ AND was))::BIGINT AS releases
    FROM (SELECT *, lag(on_) OVER (PARTITION BY episode ORDER BY frame) AS was FROM f) GROUP BY episode)"""
_DECIDE = """done AS (SELECT *, releases >= 1 AS done FROM audited),
lim AS (SELECT quantile_cont(frames, 0.95) AS lim FROM done WHERE done),
decided AS (SELECT episode, frames, held, releases, done AND NOT frames > lim AS keep, CASE WHEN NOT done THEN 'incomplete' WHEN frames > lim THEN 'slow' END AS reason FROM done, lim)"""


@query(f"WITH {S.SUPPLIERS}, {_AUDIT} SELECT * FROM audited")
def episode_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.audit(R.supplier_recordings(spark, sf_dir))


@query(f"WITH {S.USERS}, {_AUDIT}, {_DECIDE} SELECT * FROM decided")
def episode_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.decide(D.audit(R.user_recordings(spark, sf_dir)))


_BUILT = f"""{S.SUPPLIERS.replace("f AS (", "f AS MATERIALIZED (", 1)}, {_AUDIT}, {_DECIDE}, {_STILL},
kept AS (SELECT episode, greatest(still - 15, 0) AS start, frames - greatest(still - 15, 0) AS frames FROM decided JOIN still USING (episode) WHERE keep),
num AS (SELECT *, row_number() OVER (ORDER BY episode) - 1 AS new_index, coalesce(sum(frames) OVER (ORDER BY episode ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM kept)"""


@query(f"""WITH {_BUILT} SELECT new_index::BIGINT AS new_index, (frame - start)::BIGINT AS frame_index, (off + frame - start)::BIGINT AS "index",
    round((frame - start) / 30, 4) AS timestamp, q0 FROM f JOIN num USING (episode) WHERE frame >= start""")
def built_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = R.supplier_recordings(spark, sf_dir)
    b = D.build(frames, D.decide(D.audit(frames)), P.still_until(frames))
    return b.select(F.col("new_index").cast("long").alias("new_index"), "frame_index", F.col("index").cast("long").alias("index"), F.round(F.col("frame_index") / 30, 4).alias("timestamp"), F.col("q")[0].alias("q0"))


def _tasked(spark: SparkSession, frames: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    tasks = spark.createDataFrame(list(enumerate(names)), "task_index long, task string")
    return frames.select("episode", "frame", "q", (F.col("episode") % len(names)).alias("task_index")), tasks


@query(f"""WITH {S.SUPPLIERS}, u AS (SELECT user_id AS episode, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame FROM events),
    a AS (SELECT 0 AS part, episode, frame, episode % 2 AS task FROM f UNION ALL SELECT 1, episode, frame, 2 FROM u),
    n AS (SELECT part, episode, count(*) AS frames FROM a GROUP BY ALL),
    m AS (SELECT *, row_number() OVER (ORDER BY part, episode) - 1 AS new_index, coalesce(sum(frames) OVER (ORDER BY part, episode ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM n)
    SELECT new_index::BIGINT AS new_index, CASE part WHEN 0 THEN 'lines' ELSE 'events' END AS source, episode AS source_episode, task::BIGINT AS task_index,
    count(*)::BIGINT AS frames, min(off + frame)::BIGINT AS first_index, max(off + frame)::BIGINT AS last_index FROM a JOIN m USING (part, episode) GROUP BY ALL""")
def merged_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _tasked(spark, R.supplier_recordings(spark, sf_dir), ["pick", "place"])
    b = _tasked(spark, R.user_recordings(spark, sf_dir), ["sort"])
    frames, _ = D.merge([("lines", *a), ("events", *b)])
    out = frames.groupBy("new_index", "source", "source_episode", "task_index").agg(F.count(F.lit(1)).alias("frames"), F.min("index").alias("first_index"), F.max("index").alias("last_index"))
    return out.withColumn("new_index", F.col("new_index").cast("long"))


@query(f"""WITH {S.SUPPLIERS} SELECT episode % 2 AS task_index, CASE episode % 2 WHEN 0 THEN 'pick' ELSE 'place' END AS task, count(DISTINCT episode)::BIGINT AS episodes, count(*)::BIGINT AS frames FROM f GROUP BY ALL""")
def episodes_per_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames, tasks = _tasked(spark, R.supplier_recordings(spark, sf_dir), ["pick", "place"])
    per = frames.groupBy("task_index", "episode").agg(F.count(F.lit(1)).alias("n")).groupBy("task_index").agg(F.count(F.lit(1)).alias("episodes"), F.sum("n").alias("frames"))
    return per.join(F.broadcast(tasks), "task_index").select("task_index", "task", "episodes", "frames")


@query("""WITH RECURSIVE e AS (SELECT 'merged' AS dataset, s_suppkey AS idx, 'built' || (s_suppkey % 2) AS source, s_suppkey // 2 AS source_index, 0 AS trimmed FROM supplier
    UNION ALL SELECT 'built' || (s_suppkey % 2), s_suppkey // 2, 'recordings', s_suppkey, s_suppkey % 7 FROM supplier),
    r AS (SELECT dataset, idx, source, source_index, trimmed, 1 AS hops FROM e UNION ALL
          SELECT r.dataset, r.idx, e.source, e.source_index, r.trimmed + e.trimmed, hops + 1 FROM r JOIN e ON r.source = e.dataset AND r.source_index = e.idx)
    SELECT dataset, idx AS "index", source, source_index, trimmed::BIGINT AS trimmed, hops::INT AS hops FROM r
    WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.dataset = r.source AND e.idx = r.source_index)""")
def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("k"))
    built, half = F.concat(F.lit("built"), F.col("k") % 2), F.floor(F.col("k") / 2)
    one = x.select(F.lit("merged").alias("dataset"), F.col("k").alias("index"), built.alias("source"), half.alias("source_index"), F.lit(0).cast("long").alias("trimmed"))
    two = x.select(built.alias("dataset"), half.alias("index"), F.lit("recordings").alias("source"), F.col("k").alias("source_index"), (F.col("k") % 7).alias("trimmed"))
    return D.resolve_lineage(one.unionByName(two))


@query(f"WITH {S.SUPPLIERS}, {_LONG} SELECT dim::INT AS dim, round(min(x), 6) + 0.0 AS min, round(max(x), 6) AS max, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, count(*)::BIGINT AS count FROM x GROUP BY dim")
def dim_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.dim_stats(R.supplier_recordings(spark, sf_dir)).select("dim", *r6("min", "max", "mean", "std"), "count")


@query(f"WITH {S.SUPPLIERS}, {_LONG} SELECT episode, dim::INT AS dim, round(min(x), 6) + 0.0 AS min, round(max(x), 6) AS max, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, count(*)::BIGINT AS count FROM x GROUP BY episode, dim")
def episode_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.dim_stats(R.supplier_recordings(spark, sf_dir), by=["episode"]).select("episode", "dim", *r6("min", "max", "mean", "std"), "count")


_NORM = """s AS (SELECT dim, avg(x) AS mean, stddev_pop(x) AS std, {lo} AS q01, {hi} AS q99, min(x) AS a, max(x) AS b FROM y GROUP BY dim)
SELECT dim::INT AS dim, round(mean, 6) AS mean, round(std, 6) AS std, round(q01, 6) + 0.0 AS q01, round(q99, 6) AS q99,
    round(greatest(abs(2 * (a - q01) / (q99 - q01 + 1e-6) - 1), abs(2 * (b - q01) / (q99 - q01 + 1e-6) - 1)), 5) AS absmax, q99 = q01 AS degenerate FROM s"""
_PINNED = _LONG + ", y AS (SELECT dim, x FROM x UNION ALL SELECT 4, on_::INT FROM f)"


def _norm(spark: SparkSession, sf_dir: str, scheme: str) -> DataFrame:
    frames = R.supplier_recordings(spark, sf_dir).withColumn("v", F.concat("q", "commands"))
    out = D.norm_stats(frames, scheme, (4,), "v")
    return out.select("dim", *r6("mean", "std", "q01", "q99"), rounded(F.col("absmax"), 5).alias("absmax"), "degenerate")


@query(f"WITH {S.SUPPLIERS}, {_PINNED}, " + _NORM.format(lo="CASE WHEN dim = 4 THEN 0.0 ELSE quantile_cont(x, 0.01) END", hi="CASE WHEN dim = 4 THEN 1.0 ELSE quantile_cont(x, 0.99) END"))
def norm_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _norm(spark, sf_dir, "quantile")


@query(f"WITH {S.SUPPLIERS}, {_PINNED}, " + _NORM.format(lo="CASE WHEN dim = 4 THEN 0.0 ELSE min(x) END", hi="CASE WHEN dim = 4 THEN 1.0 ELSE max(x) END"))
def norm_statistics_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _norm(spark, sf_dir, "minmax")


_SHARE = f"""{S.SUPPLIERS}, {_LONG}, m AS (SELECT dim, avg(x) AS m FROM x GROUP BY dim),
e AS (SELECT episode, dim, count(*) AS n, sum(x - m) AS s1, sum((x - m) * (x - m)) AS s2, min(x) AS lo, max(x) AS hi FROM x JOIN m USING (dim) GROUP BY episode, dim),
t AS (SELECT *, sum(n) OVER w AS an, sum(s1) OVER w AS a1, sum(s2) OVER w AS a2, min(lo) OVER w AS low, max(hi) OVER w AS high, sum((hi > lo)::INT) OVER w AS moved FROM e WINDOW w AS (PARTITION BY dim)),
a AS (SELECT episode, dim::INT AS dim, CASE WHEN greatest(a2 / an - power(a1 / an, 2), 0) > 0 THEN 1 - greatest((a2 - s2) / (an - n) - power((a1 - s1) / (an - n), 2), 0) / greatest(a2 / an - power(a1 / an, 2), 0) END AS share,
    moved::BIGINT AS moved, low, high FROM t),
lim(dim, range) AS (VALUES (0, 100.0), (1, 200.0), (2, 0.5)),
sp AS (SELECT a.*, (high - low) / range AS span_ratio FROM a LEFT JOIN lim USING (dim))"""


def _attributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = spark.createDataFrame([(0, 100.0), (1, 200.0), (2, 0.5)], "dim int, range double")
    return D.span_ratios(D.attribution(R.supplier_recordings(spark, sf_dir)), limits)


@query(f"WITH {_SHARE} SELECT episode, dim, round(share, 6) + 0.0 AS share, moved, round(span_ratio, 6) AS span_ratio FROM sp")
def variance_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attributed(spark, sf_dir).select("episode", "dim", *r6("share"), "moved", *r6("span_ratio"))


@query(f"WITH {_SHARE} SELECT episode, dim, round(share, 6) AS share, round(span_ratio, 6) AS span_ratio FROM sp WHERE span_ratio > 1e-3 AND share >= 0.011")
def variance_suspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.suspects(_attributed(spark, sf_dir), share=0.011).select("episode", "dim", *r6("share", "span_ratio"))


@query(f"WITH {_SHARE} SELECT dim, round(max(share), 6) AS share, arg_max(episode, share) AS episode FROM a GROUP BY dim ORDER BY share DESC LIMIT 3")
def top_variance_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.top_dims(_attributed(spark, sf_dir), 3).select("dim", *r6("share"), "episode")


_PARKED = f"c2 AS (SELECT *, {_STEP} <= {{eps}} AS parked FROM c)"
_TALLY = f"""{S.curve()}, {S.knots()}, {_GRID}, {S.located('targets')}, {_PARKED.format(eps=20)},
i AS (SELECT episode, frame, parked, event, dwell FROM c2 WHERE frame < last),
pt AS (SELECT p.episode, least(greatest(round_even(t, 0), 0), last - 1)::BIGINT AS frame FROM p),
j AS (SELECT i.* FROM pt JOIN i USING (episode, frame)),
a1 AS (SELECT count(*) AS frames, count(*) FILTER (WHERE parked) AS pf, count(*) FILTER (WHERE event) AS ef, count(*) FILTER (WHERE dwell) AS df FROM i),
a2 AS (SELECT count(*) AS samples, count(*) FILTER (WHERE parked) AS ps, count(*) FILTER (WHERE event) AS es, count(*) FILTER (WHERE dwell) AS ds FROM j),
n AS (SELECT episode, a.n / b.m AS r FROM (SELECT episode, count(*) AS n FROM i GROUP BY episode) a JOIN (SELECT episode, count(*) AS m FROM j GROUP BY episode) b USING (episode)),
a3 AS (SELECT count(*) AS episodes, min(r) AS r0, median(r) AS r5, max(r) AS r1 FROM n)"""


def _tally(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = scratch(curve(spark, sf_dir), "curve")  # read three times below
    return c, D.supervision_tally(c, P.resample(c), 20.0)


@query(f"""WITH {_TALLY} SELECT frames::BIGINT AS frames, samples::BIGINT AS samples, pf::BIGINT AS parked_frames, ps::BIGINT AS parked_samples, ef::BIGINT AS event_frames, es::BIGINT AS event_samples,
    df::BIGINT AS dwell_frames, ds::BIGINT AS dwell_samples, episodes::BIGINT AS episodes, round(r0, 5) AS compression_min, round(r5, 5) AS compression_median, round(r1, 5) AS compression_max FROM a1, a2, a3""")
def supervision_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tally(spark, sf_dir)[1]
    return t.select("frames", "samples", *(f"{c}_{s}" for c in ("parked", "event", "dwell") for s in ("frames", "samples")), "episodes", *(F.round(c, 5).alias(c) for c in ("compression_min", "compression_median", "compression_max")))


@query(f"""WITH {_TALLY}, v AS (SELECT * FROM a1, a2, a3),
    ck AS (SELECT unnest([
      {{'check': 'parked frames get less than half of their share', 'passed': CASE WHEN pf > 0 THEN (ps / samples) / (pf / frames) ELSE 0 END < 0.5}},
      {{'check': 'built rows equal the recording minus the trim', 'passed': true}},
      {{'check': 'event share is not compressed', 'passed': round(100 * es / samples, 2) >= round(100 * ef / frames, 2)}},
      {{'check': 'dwell share is not compressed', 'passed': round(100 * ds / samples, 2) >= round(100 * df / frames, 2)}},
      {{'check': 'compression fits the span', 'passed': round(r5, 3) BETWEEN 1.8 AND 4.2}},
      {{'check': 'episodes match the report', 'passed': episodes = (SELECT count(DISTINCT episode) FROM f)}}]) AS x FROM v)
    SELECT x['check'] AS "check", x['passed'] AS passed FROM ck""")
def acceptance_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = R.supplier_recordings(spark, sf_dir)
    still = P.still_until(frames)
    every = D.audit(frames).select("episode", "frames", F.lit(True).alias("keep"))
    built = D.build(frames, every, still).agg(F.count(F.lit(1)).alias("built"))
    expected = every.join(still, "episode").agg(F.sum(F.col("frames") - F.greatest(F.col("still") - 15, F.lit(0))).alias("expected"), F.count(F.lit(1)).alias("report"))
    return D.acceptance(_tally(spark, sf_dir)[1], built.join(expected), F.col("report"))


@query("SELECT 0::BIGINT AS only_stored, 0::BIGINT AS only_computed, 0.0::DOUBLE AS largest")
def stored_against_computed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that went through Parquet against chunks computed anew."""
    c = P.progress_curve(R.user_recordings(spark, sf_dir), P.ProgressConfig(approach=2))
    made = P.chunks(P.look_ahead(c))
    return D.largest_difference(scratch(made, "chunks"), made, ["episode", "frame"], "action_chunk").select("only_stored", "only_computed", F.round("largest", 5).alias("largest"))


@query(f"""WITH {S.SUPPLIERS}, st AS (SELECT * FROM (SELECT episode, {_STEP} AS step FROM f) WHERE step > 0)
    SELECT episode, count(*)::BIGINT AS n, round(avg(step), 6) AS mean, round(quantile_cont(step, 0.05), 6) AS p05, round(quantile_cont(step, 0.5), 6) AS p50,
    round(quantile_cont(step, 0.95), 6) AS p95, round(stddev_pop(step) / avg(step), 6) AS cv FROM st GROUP BY episode""")
def step_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.spread(D.steps_of(R.supplier_recordings(spark, sf_dir)), ["episode"]).select("episode", "n", *r6("mean", "p05", "p50", "p95", "cv"))


@query(f"""WITH {S.SUPPLIERS}, st AS (SELECT * FROM (SELECT episode, {_STEP} AS step FROM f) WHERE step IS NOT NULL),
    e AS (SELECT episode, quantile_cont(step, 0.95) AS p FROM st GROUP BY episode) SELECT round(median(p), 6) AS median_p95, count(*)::BIGINT AS episodes FROM e""")
def median_of_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = D.steps_of(R.supplier_recordings(spark, sf_dir)).groupBy("episode").agg(F.percentile("step", F.lit(0.95)).alias("p"))
    return per.agg(rounded(F.median("p")).alias("median_p95"), F.count(F.lit(1)).alias("episodes"))


_D = lambda a, b: ", ".join(f"lead({a}{i}) {S._E} - {a}{i} AS {b}{i}" for i in range(4))
_SQ = lambda a: " + ".join(f"{a}{i} * {a}{i}" for i in range(4))


@query(f"""WITH {S.SUPPLIERS}, d1 AS (SELECT *, {_D('q', 'r')} FROM f), d2 AS (SELECT *, {_D('r', 's')} FROM d1), d3 AS (SELECT *, {_D('s', 't')} FROM d2)
    SELECT episode, round(sqrt(avg({_SQ('s')})), 5) AS acceleration, round(sqrt(avg({_SQ('t')})), 5) AS jerk FROM d3 GROUP BY episode""")
def roughness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.roughness(R.supplier_recordings(spark, sf_dir)).select("episode", F.round("acceleration", 5).alias("acceleration"), F.round("jerk", 5).alias("jerk"))


@query(f"""WITH {S.SUPPLIERS}, v AS ({' UNION ALL '.join(f"SELECT {i} AS dim, abs(lead(q{i}) {S._E} - q{i}) * 30 AS v FROM f" for i in range(4))}),
    s AS (SELECT dim, quantile_cont(v, 0.99) AS seen FROM v GROUP BY dim), l AS (SELECT coalesce(0.25 * median(seen), 0.1) AS fl FROM s WHERE seen > 1e-2)
    SELECT dim::INT AS dim, round(seen, 6) AS seen, round(greatest(seen, fl), 6) AS ceiling, seen < fl AS raised FROM s, l""")
def speed_ceilings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.speed_ceilings(R.supplier_recordings(spark, sf_dir)).select("dim", *r6("seen", "ceiling"), "raised")


@query(f"""WITH {S.SUPPLIERS}, e AS (SELECT episode, row_number() OVER (ORDER BY episode) - 1 AS i, greatest(1, count(*) OVER () // 30) AS m FROM (SELECT DISTINCT episode FROM f))
    SELECT episode FROM e WHERE i % m = 0 AND i // m < 30""")
def systematic_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.systematic_sample(R.supplier_recordings(spark, sf_dir), 30)


@query("SELECT (l_suppkey % 2)::INT AS task, least(12, count(DISTINCT l_suppkey))::BIGINT AS n FROM lineitem GROUP BY 1")
def stratified_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of a random sample of 12 episodes of each task."""
    e = R.supplier_recordings(spark, sf_dir).select("episode", (F.col("episode") % 2).cast("int").alias("task")).distinct()
    return D.stratified_sample(e, "task", 12).groupBy("task").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT * FROM (VALUES (true, 40::BIGINT), (false, 60::BIGINT)) t(event, n)")
def oversampled_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the strata of a sample of 100 frames, 40 of them from events."""
    return D.oversampled(curve(spark, sf_dir), 100).groupBy("event").agg(F.count(F.lit(1)).alias("n"))


def prompt_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of prompts that a dropout of 0.3 replaces."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text")
    return D.drop_prompts(rows, "text", "do the task", 0.3).agg(F.round(F.avg((F.col("text") == "do the task").cast("int")), 2).alias("share"))


QUERIES["prompt_dropout"] = prompt_dropout
