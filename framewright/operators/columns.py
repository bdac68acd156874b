"""Names of dimensions, optional inputs, merged settings, and checks of counts and spacing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from .progress import by_episode, in_order

#: Dimensions that are end effectors rather than joints.
EFFECTOR = "suction|vacuum"


def of_class(dims: DataFrame, kind: str) -> DataFrame:
    """Rows (…, name) of joints, of the end effector, or of all."""
    is_effector = F.col("name").rlike(EFFECTOR)
    return dims if kind == "all" else dims.where(is_effector if kind == "end_effector" else ~is_effector)


def short_name(name: Column, shorter: dict[str, str]) -> Column:
    """A name with the first of these prefixes that it has put shorter."""
    return reduce(lambda c, p: F.when(name.startswith(p), F.concat(F.lit(shorter[p]), F.substring(name, len(p) + 1, 1000))).otherwise(c), reversed(list(shorter)), name)


def with_optional(rows: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """rows with exactly the wanted columns (name to type); null where rows lack one."""
    return rows.select(*((F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in wanted.items()))


def merged_settings(old: Column, new: Column) -> Column:
    """Two maps as one, the new keys winning."""
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k)), new)


def count_mismatches(expected: DataFrame, found: DataFrame, key: str = "episode") -> DataFrame:
    """(key, expected, found) of keys whose row counts differ or that one side lacks; both (key, n)."""
    x = expected.select(key, F.col("n").alias("expected")).join(found.select(key, F.col("n").alias("found")), key, "full")
    return x.where(~F.col("expected").eqNullSafe(F.col("found")))


def step_profile(curve: DataFrame) -> DataFrame:
    """Per phase (approach, dwell, free) the count, smallest, mean and largest progress of an interval, in steps."""
    phase = F.when(F.col("dwell"), "dwell").when(F.col("approach"), "approach").otherwise("free")
    x = curve.where("ds IS NOT NULL").select(phase.alias("phase"), (F.col("ds") / F.col("step")).alias("x"))
    return x.groupBy("phase").agg(F.count("x").alias("n"), F.min("x").alias("least"), F.avg("x").alias("mean"), F.max("x").alias("most"))


def speeds(samples: DataFrame, least_dt: float = 1e-9) -> DataFrame:
    """(episode, frame, speed) between samples (episode, frame, t, q) that lie apart in time."""
    dt = F.lead("t").over(in_order()) - F.col("t")
    x = samples.select("episode", "frame", dt.alias("dt"), V.distance(F.lead("q").over(in_order()), F.col("q")).alias("d"))
    return x.where(F.col("dt") > least_dt).select("episode", "frame", (F.col("d") / F.col("dt")).alias("speed"))


def at_fractions(frames: DataFrame, n: int) -> DataFrame:
    """(episode, i, q): n rows per episode at equal fractional indices, linear in between; each frame makes its own."""
    x = frames.withColumn("last", F.max("frame").over(by_episode())).withColumn("ahead", F.lead("q").over(in_order()))
    at = lambda i: i * F.col("last") / (n - 1)
    x = x.withColumn("i", F.explode(F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(at(i)) == F.col("frame"))))
    return x.select("episode", "i", F.when(F.col("ahead").isNull(), F.col("q")).otherwise(V.blend(F.col("q"), F.col("ahead"), at(F.col("i")) - F.col("frame"))).alias("q"))


def spacing(placed: DataFrame) -> DataFrame:
    """Per rule the mean and coefficient of variation of the distances between neighbours of (rule, episode, i, q)."""
    w = Window.partitionBy("rule", "episode").orderBy("i")
    x = placed.withColumn("d", V.distance(F.col("q"), F.lag("q").over(w)))
    return x.groupBy("rule").agg(F.count("d").alias("n"), F.avg("d").alias("mean"), (F.stddev_pop("d") / F.avg("d")).alias("cv"))
