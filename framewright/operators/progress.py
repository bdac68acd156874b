"""Progress along an episode: events, the curve s(frame), its inversion, resampling, look-ahead chunks and weights.

All operators take a frame table (see sources.recordings) and work by window functions partitioned by episode, so an
episode's frames meet once; further operators on the same key reuse that partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import vectors as V


@dataclass(frozen=True)
class ProgressConfig:
    """curvature spaces samples by the cube root of the second difference, arc by distance."""

    metric: str = "curvature"
    weights: tuple[float, ...] | None = None
    threshold: float = 0.5
    min_dwell: int = 0
    max_dwell: int = 120
    deadzone: float = 0.0
    approach: int = 15
    event_points: int = 32
    span: int = 200
    horizon: int = 50

    @property
    def frames_per_step(self) -> float:
        return self.span / self.horizon


def config_from_lineage(report: dict) -> ProgressConfig:
    """The config a dataset was built with, from its stored lineage; older reports name a scale instead of a span."""
    c = report["config"]
    span = c["span_frames"] if c.get("span_frames") is not None else c["speed_scale"] * c["action_horizon"]
    rest = {"event_points": c["event_points"]} if "event_points" in c else {}
    return ProgressConfig(metric=c.get("metric", "arc"), min_dwell=c["min_dwell_frames"], deadzone=c["deadzone"], approach=c["approach_frames"], span=int(round(span)), horizon=c["action_horizon"], **rest)


def by_episode() -> WindowSpec:
    return Window.partitionBy("episode")


def in_order() -> WindowSpec:
    return by_episode().orderBy("frame")


def backwards() -> WindowSpec:
    return by_episode().orderBy(F.desc("frame"))


def up_to_here() -> WindowSpec:
    return in_order().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _channel(frames: DataFrame, channel: int, cfg: ProgressConfig) -> dict[str, Column]:
    """Per frame: whether this channel's command rises or falls here, and how long until the feedback follows."""
    on = F.col("commands")[channel] > 0.5
    was = F.lag(on).over(in_order())
    held = F.col("feedback")[channel] > cfg.threshold
    following = backwards().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    above = F.min(F.when(held, F.col("frame"))).over(following)
    below = F.min(F.when(~held, F.col("frame"))).over(following)
    return {"rise": on & ~was, "fall": ~on & was, "above": above, "below": below}


def event_windows(frames: DataFrame, cfg: ProgressConfig = ProgressConfig(), channels: int = 1) -> DataFrame:
    """(episode, channel, kind, onset, measured, sealed, end) of each command edge: from the edge until the feedback
    crosses the threshold, at least min_dwell and at most max_dwell frames; sealed may lie past the last frame."""
    parts = []
    for c in range(channels):
        x = frames.select("episode", "frame", F.max("frame").over(by_episode()).alias("last"), *(v.alias(k) for k, v in _channel(frames, c, cfg).items()))
        hit = F.when(F.col("rise"), F.col("above")).otherwise(F.col("below"))
        measured = F.coalesce(hit - F.col("frame"), F.lit(cfg.max_dwell))
        x = x.where("rise or fall").withColumn("measured", measured)
        dwell = F.least(F.greatest("measured", F.lit(cfg.min_dwell)), F.lit(cfg.max_dwell))
        parts.append(
            x.select(
                "episode", F.lit(c).alias("channel"), F.when(F.col("rise"), "grasp").otherwise("release").alias("kind"),
                F.col("frame").alias("onset"), "measured", (F.col("frame") + F.col("measured")).alias("sealed"), F.least(F.col("frame") + dwell, F.col("last")).alias("end"),
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def progress_curve(frames: DataFrame, cfg: ProgressConfig = ProgressConfig(), channels: int = 1) -> DataFrame:
    """The frame table with raw, approach, dwell, event, ds (of the interval that starts at the frame; null at the last),
    s, last, total, step and run, the number of frames of the event run.

    The first interval takes the second one's curvature. Dwell wins over approach. Each run of event intervals gets
    event_points samples, at most one per frame, spread evenly. Episodes of fewer than three frames have no curvature
    and so no progress.
    """
    q = V.weighted(F.col("q"), cfg.weights)
    x = frames.withColumn("last", F.max("frame").over(by_episode()))
    edge, end = F.lit(False), F.lit(None).cast("long")
    for c in range(channels):
        ch = _channel(frames, c, cfg)
        hit = F.coalesce(F.when(ch["rise"], ch["above"]).otherwise(ch["below"]) - F.col("frame"), F.lit(cfg.max_dwell))
        own = F.when(ch["rise"] | ch["fall"], F.least(F.col("frame") + F.least(F.greatest(hit, F.lit(cfg.min_dwell)), F.lit(cfg.max_dwell)), F.col("last")))
        edge = edge | F.coalesce(ch["rise"] | ch["fall"], F.lit(False))
        end = F.greatest(end, own)
    x = x.withColumn("qw", q).withColumn("edge", edge).withColumn("end", end)
    if cfg.metric == "curvature":
        ahead, behind = F.lead("qw").over(in_order()), F.lag("qw").over(in_order())
        bend = V.norm(V.minus(V.minus(ahead, F.col("qw")), V.minus(F.col("qw"), behind)))
        x = x.withColumn("bend", bend)
        raw = F.power(F.when(F.col("frame") == 0, F.lead("bend").over(in_order())).otherwise(F.col("bend")) + 1e-12, 1 / 3)
    else:
        raw = V.distance(F.lead("qw").over(in_order()), F.col("qw"))
    inside = F.col("frame") < F.col("last")
    x = x.withColumn("raw", F.when(inside, raw))
    dwell = inside & F.coalesce(F.max("end").over(up_to_here()) > F.col("frame"), F.lit(False))
    near = F.max(F.col("edge").cast("int")).over(in_order().rowsBetween(1, cfg.approach)) == 1
    x = x.withColumn("dwell", dwell).withColumn("approach", inside & ~F.col("dwell") & F.coalesce(near, F.lit(False)))
    x = x.withColumn("event", F.col("dwell") | F.col("approach"))
    free = F.when(F.col("event"), 0.0).when(inside, F.greatest(F.col("raw") - cfg.deadzone, F.lit(0.0)))
    x = x.withColumn("free", free)
    n_free = F.sum(F.when(inside & ~F.col("event") & F.col("raw").isNotNull(), 1).otherwise(0)).over(by_episode())
    n = F.count("raw").over(by_episode())
    x = x.withColumn("n_free", n_free).withColumn("n", n).withColumn("total_free", F.coalesce(F.sum("free").over(by_episode()), F.lit(0.0)))
    step = F.when((F.col("n_free") <= 0) | (F.col("total_free") <= 0), F.greatest("total_free", F.lit(1.0)) / F.greatest("n", F.lit(1)))
    x = x.withColumn("step", step.otherwise(F.col("total_free") * cfg.frames_per_step / F.col("n_free")))
    starts = (F.col("event") & ~F.coalesce(F.lag("event").over(in_order()), F.lit(False))).cast("int")
    x = x.withColumn("start", starts).withColumn("island", F.when(F.col("event"), F.sum("start").over(up_to_here())))
    x = x.withColumn("run", F.when(F.col("event"), F.count(F.lit(1)).over(Window.partitionBy("episode", "island"))))
    ds = F.when(F.col("event"), F.col("step") * F.least(F.lit(cfg.event_points), F.col("run")) / F.col("run")).otherwise(F.col("free"))
    x = x.withColumn("ds", F.when(F.col("raw").isNotNull(), ds))
    s = F.coalesce(F.sum("ds").over(in_order().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    x = x.withColumn("s", s).withColumn("total", F.coalesce(F.sum("ds").over(by_episode()), F.lit(0.0)))
    return x.drop("qw", "edge", "end", "bend", "free", "start", "n_free", "total_free", "n")


def curve_summary(curve: DataFrame) -> DataFrame:
    """Per episode: frames, event and dwell frames, total, step, samples."""
    return curve.groupBy("episode").agg(
        F.count(F.lit(1)).alias("frames"),
        F.count_if("event").alias("event_frames"),
        F.count_if("dwell").alias("dwell_frames"),
        F.first("total").alias("total"),
        F.first("step").alias("step"),
        F.rint(F.round(F.first("total") / F.first("step"), 9)).cast("long").alias("samples"),
    )


def knots(curve: DataFrame) -> DataFrame:
    """The curve with tangents `m` of a shape-preserving cubic through q, and its next knot (null at the last)."""
    x = curve.withColumn("slope", V.minus(F.lead("q").over(in_order()), F.col("q")))
    x = x.withColumn("back", F.lag("slope").over(in_order()))
    one, two = F.lead("slope").over(in_order()), F.lag("back").over(in_order())
    first = F.when(one.isNull(), F.col("slope")).otherwise(F.zip_with("slope", one, V.end_slope))
    last = F.when(two.isNull(), F.col("back")).otherwise(F.zip_with("back", two, V.end_slope))
    x = x.withColumn("m", F.when(F.col("last") == 0, F.transform("q", lambda v: v * 0)).when(F.col("frame") == 0, first).when(F.col("slope").isNull(), last).otherwise(F.zip_with("back", "slope", V.harmonic_slope)))
    x = x.withColumn("x", F.col("s") + F.col("frame") * F.greatest("total", F.lit(1.0)) * 1e-12)
    nexts = [F.lead(c).over(in_order()).alias(f"next_{c}") for c in ("x", "q", "m", "commands", "event")]
    before = F.lag("event").over(in_order()).alias("before_event")
    return x.select("episode", "frame", "x", "q", "m", "commands", "event", "last", "total", "step", "s", before, *nexts)


def on_grid(knot_table: DataFrame, n: Column) -> DataFrame:
    """The multiples sample * step, sample = 0 .. n, up to total, each with its knot, u and t as located() has them.

    An interval makes the multiples that lie in it, so there is no join and no further sort.
    """
    low = F.greatest(F.floor(F.col("x") / F.col("step")) - 1, F.lit(0))
    high = F.when(F.coalesce(F.col("next_x") > F.col("total"), F.lit(True)), n).otherwise(F.least(n, F.ceil(F.col("next_x") / F.col("step")) + 1))
    made = knot_table.select("episode", F.struct(*knot_table.columns).alias("knot"), F.explode(F.when(high >= low, F.sequence(low, high))).alias("sample"))
    made = made.withColumn("at", F.least(F.col("sample") * F.col("knot.step"), F.col("knot.total")))
    inside = (F.col("at") >= F.col("knot.x")) & F.coalesce(F.col("at") < F.col("knot.next_x"), F.lit(True))
    return _between(made.where(inside), ["sample"])


def _between(found: DataFrame, names: list[str]) -> DataFrame:
    u = F.when(F.col("knot.next_x").isNull(), 0.0).otherwise((F.col("at") - F.col("knot.x")) / (F.col("knot.next_x") - F.col("knot.x")))
    return found.select("episode", F.col("at").alias("target"), "knot", u.alias("u"), (F.col("knot.frame") + u).alias("t"), *names)


def located(knot_table: DataFrame, targets: DataFrame) -> DataFrame:
    """targets (episode, target, ...) with the knot at or before each, as `knot`, and the fractional frame `t`.

    An as-of join by union and one running window per episode: it sorts once and holds no more than the last knot.
    """
    names = [c for c in targets.columns if c not in ("episode", "target")]
    left = knot_table.select("episode", F.col("x").alias("at"), F.lit(0).alias("kind"), F.struct(*knot_table.columns).alias("knot"), *(F.lit(None).cast(targets.schema[c].dataType).alias(c) for c in names))
    right = targets.select("episode", F.col("target").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(left.schema["knot"].dataType).alias("knot"), *names)
    order = Window.partitionBy("episode").orderBy("at", "kind", F.col("knot.frame"))
    both = left.unionByName(right).withColumn("knot", F.last("knot", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("kind = 1")
    return _between(both, names)


def sampled(found: DataFrame) -> DataFrame:
    """found with `q` by the cubic, `commands` of the nearest frame, and `event` of the nearest interval."""
    k = lambda c: F.col(f"knot.{c}")
    parts = F.arrays_zip(k("q").alias("p0"), k("next_q").alias("p1"), k("m").alias("m0"), k("next_m").alias("m1"))
    curve = F.when(k("next_q").isNull(), k("q")).otherwise(F.transform(parts, lambda z: V.hermite(z["p0"], z["p1"], z["m0"], z["m1"], F.col("u"))))
    nearest = F.rint("t") > k("frame")
    command = F.transform(F.when(nearest, k("next_commands")).otherwise(k("commands")), lambda c: F.rint(c))
    # the last frame starts no interval; the one before it stands in
    event = F.when(k("frame") == k("last"), k("before_event")).when(nearest & (k("frame") + 1 < k("last")), k("next_event")).otherwise(k("event"))
    return found.withColumn("q", curve).withColumn("commands", command).withColumn("event", event)


def resample(curve: DataFrame) -> DataFrame:
    """(episode, sample, target, t, q, commands, event): each episode at equal steps of progress."""
    n = F.rint(F.round(F.col("total") / F.col("step"), 9)).cast("long")
    return sampled(on_grid(knots(curve), n)).select("episode", "sample", (F.col("sample") * F.col("knot.step")).alias("s"), "t", "q", "commands", "event")


def look_ahead(curve: DataFrame, cfg: ProgressConfig = ProgressConfig(), key_weight: float = 2.0) -> DataFrame:
    """(episode, frame, k, t, q, commands, weight) for k = 1 .. horizon steps ahead of every frame; targets stop at the
    episode's end. weight is key_weight where the source frame is in an event."""
    steps = F.sequence(F.lit(1), F.lit(cfg.horizon))
    targets = curve.select("episode", "frame", "last", F.explode(steps).alias("k"), "s", "step", "total").select("episode", "frame", "k", F.least(F.col("s") + F.col("k") * F.col("step"), F.col("total")).alias("target"))
    out = sampled(located(knots(curve), targets))
    return out.select("episode", "frame", "k", "t", "q", "commands", F.when(F.col("event"), key_weight).otherwise(1.0).alias("weight"))


def chunks(steps: DataFrame) -> DataFrame:
    """look_ahead() as one row per frame: a flat array of horizon vectors (joints, then commands) and the weights."""
    row = F.struct("k", F.concat("q", "commands").alias("v"), "weight")
    out = steps.groupBy("episode", "frame").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return out.select("episode", "frame", F.flatten(F.transform("rows", lambda r: r["v"])).alias("action_chunk"), F.transform("rows", lambda r: r["weight"]).alias("action_loss_weight"))


def unflatten(chunk: Column, width: int) -> Column:
    """A flat chunk as an array of vectors of one width."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(chunk) / width).cast("int") - 1), lambda i: F.slice(chunk, i * width + 1, width))


def still_until(frames: DataFrame, eps: float = 1e-3) -> DataFrame:
    """(episode, still): the first interval in which the arm moves or is told to by more than eps; frames if none does."""
    step = F.greatest(V.distance(F.lead("q").over(in_order()), F.col("q")), V.distance(F.lead("measured").over(in_order()), F.col("measured")))
    x = frames.withColumn("step", step)
    return x.groupBy("episode").agg(F.coalesce(F.min(F.when(F.col("step") > eps, F.col("frame"))), F.count(F.lit(1))).alias("still"))
