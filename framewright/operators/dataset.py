"""Datasets of episodes: audit, selection, merging, statistics, attribution and acceptance checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.ranks import quantiles
from .progress import by_episode, in_order


def long_form(frames: DataFrame, vector: str = "q") -> DataFrame:
    """(episode, frame, dim, x) of a vector column."""
    return frames.select("episode", "frame", F.posexplode(vector).alias("dim", "x"))


def audit(frames: DataFrame, channels: int = 1) -> DataFrame:
    """(episode, frames, held, releases): commands still on at the end, and commands that went off again."""
    x = frames
    held, fell = F.lit(0), F.lit(0)
    for c in range(channels):
        on = F.col("commands")[c] > 0.5
        x = x.withColumn(f"fall{c}", (~on & F.lag(on).over(in_order())).cast("int"))
        held = held + F.max_by(on.cast("int"), "frame")
        fell = fell + F.coalesce(F.sum(f"fall{c}"), F.lit(0))
    return x.groupBy("episode").agg(F.count(F.lit(1)).alias("frames"), held.cast("long").alias("held"), fell.cast("long").alias("releases"))


def decide(audited: DataFrame, kind: str = "place", quantile: float = 0.95) -> DataFrame:
    """audited with keep and reason: episodes that didn't do the task are incomplete, and of the others those longer
    than the quantile of their durations are slow."""
    done = (F.col("held") >= 1) if kind == "pick" else (F.col("releases") >= 1)
    x = audited.withColumn("done", done)
    limit = x.where("done").agg(F.percentile("frames", F.lit(quantile)).alias("limit"))
    x = x.join(F.broadcast(limit))  # one row
    slow = F.col("done") & (F.col("frames") > F.col("limit"))
    reason = F.when(~F.col("done"), "incomplete").when(slow, "slow")
    return x.select("episode", "frames", "held", "releases", (F.col("done") & ~F.coalesce(slow, F.lit(False))).alias("keep"), reason.alias("reason"))


def numbered(lengths: DataFrame, order: list[str]) -> DataFrame:
    """lengths (one row per episode, with `frames`) with new_index and the running row offset `offset`.

    The only window without a partition runs over one small row per episode, never over frames.
    """
    w = Window.partitionBy(F.lit(0)).orderBy(*order)
    return lengths.withColumn("new_index", F.row_number().over(w) - 1).withColumn("offset", F.coalesce(F.sum("frames").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def build(frames: DataFrame, decided: DataFrame, still: DataFrame, margin: int = 15) -> DataFrame:
    """Kept episodes, renumbered, without their lead-in, with a running row index and time at 30 frames a second."""
    start = F.greatest(F.col("still") - margin, F.lit(0))
    kept = decided.where("keep").join(still, "episode").select("episode", start.alias("start"), (F.col("frames") - start).alias("frames"))
    x = frames.join(numbered(kept, ["episode"]), "episode").where("frame >= start")
    at = F.col("frame") - F.col("start")
    return x.select("episode", "new_index", at.alias("frame_index"), (F.col("offset") + at).alias("index"), (at / 30).cast("float").alias("timestamp"), "q", "commands")


def merge(parts: list[tuple[str, DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """(frames, tasks) of several datasets (name, frames, tasks) of the same columns: episodes are renumbered in order,
    tasks follow each other, the row index runs on. Frames keep their source and source episode."""
    columns = set(parts[0][1].columns)
    for name, frames, _ in parts:
        if set(frames.columns) != columns:
            raise ValueError(f"{name} has other columns than {parts[0][0]}")
    every, tasks, offset = None, None, 0
    for i, (name, frames, own) in enumerate(parts):
        x = frames.withColumn("part", F.lit(i)).withColumn("source", F.lit(name)).withColumn("task_index", F.col("task_index") + offset)
        y = own.select((F.col("task_index") + offset).alias("task_index"), "task")
        every, tasks = (x, y) if every is None else (every.unionByName(x), tasks.unionByName(y))
        offset += own.count()
    lengths = numbered(every.groupBy("part", "episode").agg(F.count(F.lit(1)).alias("frames")), ["part", "episode"])
    out = every.join(lengths.select("part", "episode", "new_index", "offset"), ["part", "episode"])
    return out.withColumn("index", F.col("offset") + F.col("frame")).withColumnRenamed("episode", "source_episode").drop("part", "offset"), tasks


def resolve_lineage(edges: DataFrame, most_hops: int = 16) -> DataFrame:
    """(dataset, index, source, source_index, trimmed, hops) to the recordings, from one row per episode and step
    (dataset, index, source, source_index, trimmed); hop after hop, as deep as the lineage goes."""
    found = edges.withColumn("hops", F.lit(1))
    step = edges.select(F.col("dataset").alias("source"), F.col("index").alias("source_index"), F.col("source").alias("to"), F.col("source_index").alias("to_index"), F.col("trimmed").alias("more"))
    for _ in range(most_hops):
        joined = found.join(step, ["source", "source_index"], "left")
        if not joined.where("to IS NOT NULL").head(1):
            return found
        on = F.col("to").isNotNull()
        pick = lambda a, b: F.when(on, F.col(a)).otherwise(F.col(b))
        found = joined.select("dataset", "index", pick("to", "source").alias("source"), pick("to_index", "source_index").alias("source_index"), (F.col("trimmed") + F.coalesce("more", F.lit(0))).alias("trimmed"), (F.col("hops") + on.cast("int")).alias("hops"))
    raise ValueError("the lineage is deeper than most_hops")


def dim_stats(frames: DataFrame, vector: str = "q", by: list[str] | None = None) -> DataFrame:
    """min, max, mean, population std and count of each dimension (and group)."""
    x = long_form(frames, vector)
    return x.groupBy(*(by or []), "dim").agg(F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.count("x").alias("count"))


def norm_stats(frames: DataFrame, scheme: str = "quantile", pinned: tuple[int, ...] = (), vector: str = "q") -> DataFrame:
    """Per dimension mean, std, q01, q99 (or min and max), pinned dimensions from 0 to 1, and the largest normalised
    value (2 (x - q01) / (span + 1e-6) - 1)."""
    x = long_form(frames, vector)
    s = x.groupBy("dim").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    s = s.withColumns({"q01": F.col("min"), "q99": F.col("max")}) if scheme == "minmax" else s.join(quantiles(x, "dim", "x", {"q01": 0.01, "q99": 0.99}), "dim")
    fixed = F.col("dim").isin(list(pinned)) if pinned else F.lit(False)
    s = s.withColumn("q01", F.when(fixed, 0.0).otherwise(F.col("q01"))).withColumn("q99", F.when(fixed, 1.0).otherwise(F.col("q99")))
    scaled = lambda c: F.abs(2 * (F.col(c) - F.col("q01")) / (F.col("q99") - F.col("q01") + 1e-6) - 1)
    return s.withColumn("absmax", F.greatest(scaled("min"), scaled("max"))).withColumn("degenerate", F.col("q99") == F.col("q01")).drop("min", "max")


def attribution(frames: DataFrame, vector: str = "q") -> DataFrame:
    """(episode, dim, share, moved, low, high): how much of a dimension's variance goes if the episode is left out.

    Closed form from counts and sums, centred first, so no pass per episode. Negative if leaving the episode out raises
    the variance; null for constant dimensions. moved: episodes in which the dimension moves at all.
    """
    x = long_form(frames, vector)
    centre = x.groupBy("dim").agg(F.avg("x").alias("centre"))
    x = x.join(F.broadcast(centre), "dim").withColumn("c", F.col("x") - F.col("centre"))
    e = x.groupBy("episode", "dim").agg(F.count("c").alias("n"), F.sum("c").alias("s1"), F.sum(F.col("c") * F.col("c")).alias("s2"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    dim = Window.partitionBy("dim")
    e = e.select("*", *(F.sum(c).over(dim).alias(f"all_{c}") for c in ("n", "s1", "s2")), F.min("lo").over(dim).alias("low"), F.max("hi").over(dim).alias("high"), F.sum((F.col("hi") > F.col("lo")).cast("int")).over(dim).alias("moved"))
    variance = lambda n, a, b: F.greatest(b / n - (a / n) * (a / n), F.lit(0.0))
    rest = variance(F.col("all_n") - F.col("n"), F.col("all_s1") - F.col("s1"), F.col("all_s2") - F.col("s2"))
    whole = variance(F.col("all_n"), F.col("all_s1"), F.col("all_s2"))
    return e.select("episode", "dim", F.when(whole > 0, 1 - rest / whole).alias("share"), "moved", "low", "high")


def span_ratios(attributed: DataFrame, limits: DataFrame) -> DataFrame:
    """attributed with span_ratio, a dimension's range over its limit range from limits (dim, range); null without one."""
    return attributed.join(F.broadcast(limits), "dim", "left").withColumn("span_ratio", (F.col("high") - F.col("low")) / F.col("range")).drop("range")


def suspects(attributed: DataFrame, share: float = 0.5, span: float = 1e-3) -> DataFrame:
    """Cells in which one episode makes up most of a dimension whose range is real, largest share first."""
    return attributed.where((F.col("span_ratio") > span) & (F.col("share") >= share)).orderBy(F.desc("share"), "episode", "dim")


def top_dims(attributed: DataFrame, n: int = 8) -> DataFrame:
    """The n dimensions with the largest share of any episode, and that episode."""
    best = attributed.where("share IS NOT NULL").groupBy("dim").agg(F.max(F.struct("share", (-F.col("episode")).alias("e"))).alias("b"))
    return best.select("dim", F.col("b.share").alias("share"), (-F.col("b.e")).alias("episode")).orderBy(F.desc("share"), "dim").limit(n)


def parked(frames: DataFrame, eps: float = 1e-3) -> Column:
    """Whether neither the command nor the arm moves in the interval that starts at a frame; null at the last."""
    return F.greatest(V.distance(F.lead("q").over(in_order()), F.col("q")), V.distance(F.lead("measured").over(in_order()), F.col("measured"))) <= eps


def supervision_tally(curve: DataFrame, resampled: DataFrame, eps: float = 1e-3) -> DataFrame:
    """One row: how frames and resampled points share out between parked, event and dwell intervals, and compression."""
    x = curve.withColumn("parked", parked(curve, eps)).where(F.col("frame") < F.col("last")).select("episode", "frame", "last", "parked", "event", "dwell")
    at = F.least(F.greatest(F.rint("t"), F.lit(0.0)).cast("long"), F.col("last") - 1)
    ends = curve.where("frame = 0").select("episode", "last")
    points = resampled.join(ends, "episode").select("episode", at.alias("frame")).join(x, ["episode", "frame"])
    count = lambda df, side: df.agg(F.count(F.lit(1)).alias(side), *(F.count_if(c).alias(f"{c}_{side}") for c in ("parked", "event", "dwell")))
    both = count(x, "frames").join(count(points, "samples"))
    per = x.groupBy("episode").agg(F.count(F.lit(1)).alias("n")).join(points.groupBy("episode").agg(F.count(F.lit(1)).alias("m")), "episode")
    speed = per.agg(F.count(F.lit(1)).alias("episodes"), F.min(F.col("n") / F.col("m")).alias("compression_min"), F.median(F.col("n") / F.col("m")).alias("compression_median"), F.max(F.col("n") / F.col("m")).alias("compression_max"))
    return both.join(speed)


def acceptance(tally: DataFrame, built_rows: DataFrame, expected_episodes: int | Column, frames_per_step: float = 4.0) -> DataFrame:
    """(check, passed) of the six acceptance checks; built_rows: one row with built and expected."""
    x = tally.join(built_rows)
    share = lambda c, side: F.col(f"{c}_{side}") / F.col(side)
    ratio = F.when(F.col("parked_frames") > 0, share("parked", "samples") / share("parked", "frames")).otherwise(0.0)
    checks = {
        "parked frames get less than half of their share": ratio < 0.5,
        "built rows equal the recording minus the trim": F.col("built") == F.col("expected"),
        "event share is not compressed": F.round(100 * share("event", "samples"), 2) >= F.round(100 * share("event", "frames"), 2),
        "dwell share is not compressed": F.round(100 * share("dwell", "samples"), 2) >= F.round(100 * share("dwell", "frames"), 2),
        "compression fits the span": F.round("compression_median", 3).between(0.45 * frames_per_step, 1.05 * frames_per_step),
        "episodes match the report": F.col("episodes") == expected_episodes,
    }
    return x.select(F.explode(F.array(*(F.struct(F.lit(k).alias("check"), v.alias("passed")) for k, v in checks.items()))).alias("c")).select("c.*")


def largest_difference(stored: DataFrame, computed: DataFrame, keys: list[str], column: str) -> DataFrame:
    """One row: rows only stored, rows only computed, and the largest element-wise difference of an array column."""
    a, b = stored.select(*keys, F.col(column).alias("a")), computed.select(*keys, F.col(column).alias("b"))
    x = a.join(b, keys, "full")
    gap = F.array_max(F.zip_with("a", "b", lambda p, q: F.abs(p - q)))
    return x.agg(F.count_if(F.col("b").isNull()).alias("only_stored"), F.count_if(F.col("a").isNull()).alias("only_computed"), F.max(gap).alias("largest"))


def spread(steps: DataFrame, by: list[str], column: str = "step") -> DataFrame:
    """Per group: count, mean, p05, p50, p95 and coefficient of variation of the steps that aren't zero (of all, if all are)."""
    moving = F.max(F.when(F.col(column) > 0, 1).otherwise(0))
    # Of all rows: one row beside them. By group: as wide as the group, which is an episode or the like.
    x = steps.withColumn("_m", moving.over(Window.partitionBy(*by))) if by else steps.crossJoin(F.broadcast(steps.agg(moving.alias("_m"))))
    x = x.where((F.col("_m") == 0) | (F.col(column) > 0))
    p = lambda q: F.percentile(column, F.lit(q))
    return x.groupBy(*by).agg(F.count(column).alias("n"), F.avg(column).alias("mean"), p(0.05).alias("p05"), p(0.5).alias("p50"), p(0.95).alias("p95"), (F.stddev_pop(column) / F.avg(column)).alias("cv"))


def steps_of(frames: DataFrame) -> DataFrame:
    """(episode, frame, step): the distance to the next frame."""
    return frames.withColumn("step", V.distance(F.lead("q").over(in_order()), F.col("q"))).where("step IS NOT NULL").select("episode", "frame", "step")


def roughness(frames: DataFrame) -> DataFrame:
    """Per episode the root mean square of second and third differences."""
    x = frames.withColumn("d1", V.minus(F.lead("q").over(in_order()), F.col("q"))).withColumn("d2", V.minus(F.lead("d1").over(in_order()), F.col("d1"))).withColumn("d3", V.minus(F.lead("d2").over(in_order()), F.col("d2")))
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda a, b: a + b * b)
    return x.groupBy("episode").agg(F.sqrt(F.avg(square(F.col("d2")))).alias("acceleration"), F.sqrt(F.avg(square(F.col("d3")))).alias("jerk"))


def speed_ceilings(frames: DataFrame, quantile: float = 0.99, floor: float = 0.25, fps: float = 30.0) -> DataFrame:
    """Per dimension the quantile of its speed, at least floor times the median of the dimensions that move."""
    x = frames.withColumn("v", F.transform(V.minus(F.lead("q").over(in_order()), F.col("q")), lambda d: F.abs(d) * fps))
    seen = quantiles(x.select(F.posexplode("v").alias("dim", "v")), "dim", "v", {"seen": quantile})
    low = seen.where("seen > 1e-2").agg(F.coalesce(floor * F.median("seen"), F.lit(0.1)).alias("floor"))
    return seen.join(F.broadcast(low)).select("dim", "seen", F.greatest("seen", "floor").alias("ceiling"), (F.col("seen") < F.col("floor")).alias("raised"))


def systematic_sample(episodes: DataFrame, n: int) -> DataFrame:
    """Every m-th episode in order, m = floor(count / n) and at least 1, and of these the first n."""
    w = Window.partitionBy(F.lit(0)).orderBy("episode")
    x = episodes.select("episode").distinct().withColumn("i", F.row_number().over(w) - 1).withColumn("every", F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))) / n)))
    return x.where((F.col("i") % F.col("every") == 0) & (F.floor(F.col("i") / F.col("every")) < n)).select("episode")


def stratified_sample(rows: DataFrame, stratum: str, n: int, seed: int = 0) -> DataFrame:
    """n random rows of each stratum; the same rows for the same seed and rows."""
    w = Window.partitionBy(stratum).orderBy(F.xxhash64(F.lit(seed), *rows.columns), *rows.columns)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def oversampled(curve: DataFrame, n: int, share: float = 0.4, seed: int = 0) -> DataFrame:
    """n frames, the given share of them from events."""
    x = curve.where(F.col("frame") < F.col("last")).select("episode", "frame", "event")
    key = F.xxhash64(F.lit(seed), "episode", "frame")
    inside = round(n * share)
    return x.where("event").orderBy(key).limit(inside).unionByName(x.where("NOT event").orderBy(key).limit(n - inside))


def drop_prompts(rows: DataFrame, prompt: str, neutral: str, p: float, seed: int = 0) -> DataFrame:
    """rows with the prompt replaced by a neutral one with probability p, decided by a hash of the row."""
    u = F.pmod(F.xxhash64(F.lit(seed), *rows.columns), F.lit(1_000_000)) / 1_000_000
    return rows.withColumn(prompt, F.when(u < p, F.lit(neutral)).otherwise(F.col(prompt)))


def one_row(spark: SparkSession) -> DataFrame:
    return spark.range(1).drop("id")
