"""Local shape of paths, supervision density, keypoint placement and reconstruction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.ranks import running_sum
from .progress import by_episode, in_order, knots, located, on_grid, up_to_here


def local_shape(frames: DataFrame, w: int = 15, fps: float = 30.0) -> DataFrame:
    """(episode, frame, path, net, tau, speed) over the frames at most w away, fewer at the ends."""
    x = frames.withColumn("step", V.distance(F.col("q"), F.lag("q").over(in_order())))
    x = x.withColumn("s", F.coalesce(F.sum("step").over(up_to_here()), F.lit(0.0)))
    around = in_order().rowsBetween(-w, w)
    ends = [f(c).over(around) for c in ("s", "q", "frame") for f in (F.first, F.last)]
    x = x.select("episode", "frame", *(e.alias(n) for e, n in zip(ends, ("s0", "s1", "q0", "q1", "f0", "f1"), strict=True)))
    path, net = F.col("s1") - F.col("s0"), V.distance(F.col("q1"), F.col("q0"))
    return x.select("episode", "frame", path.alias("path"), net.alias("net"), (path / F.greatest(net, F.lit(1e-3))).alias("tau"), (path / F.greatest(F.col("f1") - F.col("f0"), F.lit(1)) * fps).alias("speed"))


def phase(path: Column, tau: Column, floor: float, hunting: float) -> Column:
    """still below a path length, else hunt beyond a tortuosity, else transit."""
    return F.when(path < floor, "still").when(tau > hunting, "hunt").otherwise("transit")


def resample_density(curve: DataFrame) -> DataFrame:
    """(episode, frame, points): resampled points that land in each interval, the last one closed."""
    n = F.ceil(F.round(F.col("total") / F.col("step"), 9)) - 1
    t = on_grid(knots(curve), n)
    return t.groupBy("episode", F.least(F.floor("t"), F.col("knot.last")).alias("frame")).agg(F.count(F.lit(1)).alias("points"))


def path_tortuosity_table(shape: DataFrame, path_edges: list[float], tau_edges: list[float]) -> DataFrame:
    """Share of frames by path bucket (rows) and tortuosity bucket (columns t0, t1, ...), with row totals."""
    bucket = lambda c, edges: sum(((F.col(c) >= e).cast("int") for e in edges), F.lit(0))
    x = shape.select(bucket("path", path_edges).alias("row"), F.concat(F.lit("t"), bucket("tau", tau_edges)).alias("column"))
    out = x.groupBy("row").pivot("column", [f"t{i}" for i in range(len(tau_edges) + 1)]).count().na.fill(0)
    names = [f"t{i}" for i in range(len(tau_edges) + 1)]
    every = F.sum(sum((F.col(n) for n in names), F.lit(0))).over(Window.partitionBy(F.lit(0)))  # a few rows
    return out.select("row", *((F.col(n) / every).alias(n) for n in names), (sum((F.col(n) for n in names), F.lit(0)) / every).alias("total"))


def auc(rows: DataFrame, score: str, positive: str) -> DataFrame:
    """One row with the area under the ROC curve; tied scores share their rank. Scores are counted before they are
    ranked, and ranked in ranges, so no task holds them all."""
    x = rows.groupBy(score).agg(F.count_if(F.col(positive)).alias("p"), F.count(F.lit(1)).alias("n"))
    x = running_sum(x, [score], "n", "below").withColumn("rank", F.col("below") + (F.col("n") + 1) / 2)
    pos, neg = F.sum("p"), F.sum(F.col("n") - F.col("p"))
    return x.agg(F.when((pos > 0) & (neg > 0), (F.sum(F.col("rank") * F.col("p")) - pos * (pos + 1) / 2) / (pos * neg)).alias("auc"))


def voxel(v: Column, size: float) -> Column:
    return F.transform(v, lambda x: F.floor(x / size))


def occupancy_prior(points: DataFrame, value: str) -> DataFrame:
    """points (episode, voxel, value) with `prior`, the mean value of other episodes in the voxel, else of all others."""
    e = points.groupBy("voxel", "episode").agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    v, one = Window.partitionBy("voxel"), e.groupBy("episode").agg(F.sum("s").alias("es"), F.sum("n").alias("en"))
    both = one.agg(F.sum("es").alias("ts"), F.sum("en").alias("tn"))
    e = e.select("*", (F.sum("s").over(v) - F.col("s")).alias("os"), (F.sum("n").over(v) - F.col("n")).alias("on")).join(one, "episode").join(F.broadcast(both))
    prior = F.when(F.col("on") > 0, F.col("os") / F.col("on")).otherwise((F.col("ts") - F.col("es")) / (F.col("tn") - F.col("en")))
    return e.select("voxel", "episode", "n", (F.col("s") / F.col("n")).alias("own"), prior.alias("prior"))


def phase_density(shape: DataFrame, density: DataFrame) -> DataFrame:
    """Per phase its share of frames, of points, and their ratio."""
    x = shape.join(density, ["episode", "frame"], "left").groupBy("phase").agg(F.count(F.lit(1)).alias("frames"), F.coalesce(F.sum("points"), F.lit(0)).alias("points"))
    w = Window.partitionBy(F.lit(0))
    a, b = F.col("frames") / F.sum("frames").over(w), F.col("points") / F.sum("points").over(w)
    return x.select("phase", "frames", "points", (b / a).alias("ratio"))


def _density(frames: DataFrame, exponent: float) -> DataFrame:
    """(episode, at, c): running sums of the curvature density, one more entry than frames."""
    bend = V.norm(V.minus(V.minus(F.lead("q").over(in_order()), F.col("q")), V.minus(F.col("q"), F.lag("q").over(in_order()))))
    x = frames.withColumn("bend", bend).withColumn("bend", F.coalesce("bend", F.lead("bend").over(in_order()), F.lag("bend").over(in_order())))
    x = x.withColumn("c", F.sum(F.power(F.col("bend") + 1e-12, exponent)).over(up_to_here())).select("episode", (F.col("frame") + 1).alias("at"), "c")
    return x.unionByName(frames.where("frame = 0").select("episode", F.lit(0).cast("long").alias("at"), F.lit(0.0).alias("c"))).withColumn("c", F.col("c") + F.col("at") * 1e-12)


def _arc(frames: DataFrame) -> DataFrame:
    step = V.distance(F.col("q"), F.lag("q").over(in_order()))
    x = frames.withColumn("step", step).withColumn("c", F.coalesce(F.sum("step").over(up_to_here()), F.lit(0.0)) + F.col("frame") * 1e-12)
    return x.select("episode", F.col("frame").alias("at"), "c")


def keypoints(frames: DataFrame, rule: str, n: int, min_gap: float = 1.0, exponent: float = 1 / 3) -> DataFrame:
    """(episode, i, position) of n keypoints per episode at equal time, arc or curvature.

    Curvature keeps points at least min_gap frames apart: pushed right where they crowd, then pulled back to the end.
    """
    last = frames.groupBy("episode").agg(F.max("frame").alias("last"))
    grid = last.select("episode", "last", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    if rule == "time":
        return grid.select("episode", "i", (F.col("i") * F.col("last") / (n - 1)).alias("position"))
    c = _arc(frames) if rule == "arc" else _density(frames, exponent)
    w = by_episode().orderBy("at")
    c = c.select("episode", F.col("at").alias("frame"), F.col("c").alias("x"), F.lead("c").over(w).alias("next_x"), F.max("c").over(by_episode()).alias("top"))
    ends = c.where("frame = 0").select("episode", "top")
    targets = grid.join(ends, "episode").select("episode", "i", "last", (F.col("i") * F.col("top") / (n - 1)).alias("target"))
    out = located(c, targets).select("episode", "i", "last", F.col("t").alias("position"))
    if rule == "arc" or min_gap <= 0:
        return out.select("episode", "i", "position")
    # max over j <= i of (p[j] + (i - j) gap) is a running maximum of p[j] - j gap
    order = by_episode().orderBy("i")
    pushed = F.max(F.col("position") - F.col("i") * min_gap).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("i") * min_gap
    out = out.withColumn("pushed", pushed).withColumn("end", F.max("pushed").over(by_episode()))
    back = by_episode().orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pulled = F.min(F.col("pushed") - F.col("i") * min_gap).over(back) + F.col("i") * min_gap
    clipped = F.least(F.greatest(pulled, F.lit(0.0)), F.col("last").cast("double"))
    return out.select("episode", "i", F.when(F.col("end") > F.col("last"), clipped).otherwise(F.col("pushed")).alias("position"))


def reconstruct(frames: DataFrame, placed: DataFrame, how: str = "linear") -> DataFrame:
    """frames with `r`, rebuilt from the rows at the rounded keypoints alone: linear, or a shape-preserving cubic."""
    last = frames.groupBy("episode").agg(F.max("frame").alias("last"))
    rows = placed.join(last, "episode").select("episode", F.least(F.greatest(F.rint("position"), F.lit(0.0)), F.col("last").cast("double")).cast("long").alias("frame"))
    rows = rows.distinct()
    few = Window.partitionBy("episode")
    rows = rows.withColumn("n", F.count(F.lit(1)).over(few))
    ends = last.join(rows.where("n = 1").select("episode").distinct(), "episode").select("episode", F.explode(F.array(F.lit(0).cast("long"), F.col("last"))).alias("frame"))
    rows = rows.where("n > 1").select("episode", "frame").unionByName(ends).distinct().withColumn("key", F.lit(True))
    x = frames.join(rows, ["episode", "frame"], "left")
    k = x.where("key").select("episode", "frame", "q")
    k = k.withColumn("h", F.lead("frame").over(in_order()) - F.col("frame")).withColumn("d", F.transform(V.minus(F.lead("q").over(in_order()), F.col("q")), lambda v: v / F.col("h")))
    if how == "pchip":
        k = k.withColumn("hb", F.lag("h").over(in_order())).withColumn("db", F.lag("d").over(in_order()))
        h, hb = F.col("h"), F.col("hb")
        inner = F.zip_with("db", "d", lambda a, b: F.when(a * b > 0, 3 * (h + hb) / ((2 * h + hb) / a + (h + 2 * hb) / b)).otherwise(0.0))

        def end(near: Column, far: Column, hn: Column, hf: Column) -> Column:
            def one(a: Column, b: Column) -> Column:
                m = ((2 * hn + hf) * a - hn * b) / (hn + hf)
                return F.when(m * a <= 0, 0.0).when((a * b < 0) & (F.abs(m) > 3 * F.abs(a)), 3 * a).otherwise(m)

            return F.when(far.isNull(), near).otherwise(F.zip_with(near, far, one))

        first = end(F.col("d"), F.lead("d").over(in_order()), h, F.lead("h").over(in_order()))
        final = end(F.col("db"), F.lag("db").over(in_order()), hb, F.lag("hb").over(in_order()))
        k = k.withColumn("m", F.when(F.col("db").isNull(), first).when(F.col("d").isNull(), final).otherwise(inner))
    else:
        k = k.withColumn("m", F.col("d"))
    nexts = [F.lead(c).over(in_order()).alias(f"next_{c}") for c in ("q", "m")]
    k = k.select("episode", "frame", F.struct("frame", "q", "h", "m", *nexts).alias("k"))
    x = x.select("episode", "frame", "q").join(k, ["episode", "frame"], "left")
    x = x.withColumn("k", F.last("k", ignorenulls=True).over(up_to_here()))
    u = (F.col("frame") - F.col("k.frame")) / F.col("k.h")
    if how == "pchip":
        parts = F.arrays_zip(F.col("k.q").alias("p0"), F.col("k.next_q").alias("p1"), F.col("k.m").alias("m0"), F.col("k.next_m").alias("m1"))
        value = F.transform(parts, lambda z: V.hermite(z["p0"], z["p1"], z["m0"] * F.col("k.h"), z["m1"] * F.col("k.h"), u))
    else:
        value = V.blend(F.col("k.q"), F.col("k.next_q"), u)
    return x.select("episode", "frame", "q", F.when(F.col("k.next_q").isNull(), F.col("k.q")).otherwise(value).alias("r"))


def budget_errors(frames: DataFrame, rules: list[str], budgets: list[int], how: str = "linear") -> DataFrame:
    """(rule, budget, p95): the median over episodes of the 95th percentile of the reconstruction error."""
    out = None
    for rule in rules:
        for n in budgets:
            r = reconstruct(frames, keypoints(frames, rule, n), how)
            e = r.groupBy("episode").agg(F.percentile(V.distance(F.col("q"), F.col("r")), F.lit(0.95)).alias("p"))
            e = e.agg(F.median("p").alias("p95")).select(F.lit(rule).alias("rule"), F.lit(n).alias("budget"), "p95")
            out = e if out is None else out.unionByName(e)
    return out


def crowding(frames: DataFrame, n: int) -> DataFrame:
    """(episode, crowded): share of neighbouring uncapped curvature keypoints closer than one frame."""
    p = keypoints(frames, "curvature", n, min_gap=0.0)
    gap = F.col("position") - F.lag("position").over(by_episode().orderBy("i"))
    return p.withColumn("gap", gap).groupBy("episode").agg(F.avg((F.col("gap") < 1).cast("int")).alias("crowded"))


def payload_errors(errors: DataFrame, wide: int = 22, narrow: int = 3) -> DataFrame:
    """What each budget of narrow keypoints costs against the wide budget of the same size, by interpolation.

    errors: (space, budget, p95) with space wide or narrow.
    """
    a = errors.where("space = 'wide'").select((F.col("budget") * wide).alias("size"), F.col("p95").alias("wide_p95"), F.col("budget").alias("wide_budget"))
    b = errors.where("space = 'narrow'").select((F.col("budget") * narrow).alias("size"), "p95").withColumn("next_size", F.lead("size").over(Window.partitionBy(F.lit(0)).orderBy("size"))).withColumn("next_p95", F.lead("p95").over(Window.partitionBy(F.lit(0)).orderBy("size")))
    hit = a.join(b, (a["size"] >= b["size"]) & ((a["size"] < b["next_size"]) | b["next_size"].isNull()))
    u = F.when(b["next_size"].isNull(), 0.0).otherwise((a["size"] - b["size"]) / (b["next_size"] - b["size"]))
    return hit.select("wide_budget", a["size"].alias("size"), "wide_p95", (F.col("p95") + u * (F.coalesce("next_p95", "p95") - F.col("p95"))).alias("narrow_p95"))


def nearest_on_path(points: DataFrame, path: DataFrame) -> DataFrame:
    """points (key, i, p) with `gap`, the distance to the nearest place on the polyline path (key, j, q) of its key.

    Each point meets the segments of its own key only; the minimum is taken as they meet.
    """
    w = Window.partitionBy("key").orderBy("j")
    seg = path.withColumn("b", F.lead("q").over(w)).where("b IS NOT NULL").select("key", F.col("q").alias("a"), "b")
    d = V.minus(F.col("b"), F.col("a"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    x = points.join(seg, "key").withColumn("d", d).withColumn("l2", dot(F.col("d"), F.col("d")))
    u = F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(V.minus(F.col("p"), F.col("a")), F.col("d")) / F.when(F.col("l2") > 0, F.col("l2")).otherwise(1.0)))
    x = x.withColumn("gap", V.distance(F.col("p"), V.blend(F.col("a"), F.col("b"), u)))
    return x.groupBy("key", "i").agg(F.min("gap").alias("gap"))


def path_ahead(frames: DataFrame, wanted: DataFrame, margin: float = 0.25) -> DataFrame:
    """wanted (episode, frame, arc) with `until`: the last frame of the recorded path that covers arc and a margin."""
    x = frames.withColumn("step", V.distance(F.col("q"), F.lag("q").over(in_order()))).withColumn("s", F.coalesce(F.sum("step").over(up_to_here()), F.lit(0.0)))
    x = x.select("episode", "frame", F.col("s").alias("x"), F.lead("s").over(in_order()).alias("next_x"), F.max("frame").over(by_episode()).alias("last"))
    start = wanted.join(x.select("episode", "frame", F.col("x").alias("s")), ["episode", "frame"])
    targets = start.select("episode", F.col("frame").alias("start"), (F.col("s") + F.col("arc") * (1 + margin)).alias("target"))
    found = located(x, targets)
    return found.select("episode", F.col("start").alias("frame"), F.least(F.col("knot.last"), F.col("knot.frame") + 2).alias("until"))


def replan_jitter(windows: DataFrame, stride: int) -> DataFrame:
    """Distances between consecutive windows (episode, lo, frame, r) where both speak, per pair."""
    b = windows.select("episode", (F.col("lo") - stride).alias("lo"), "frame", F.col("r").alias("r2"))
    return windows.join(b, ["episode", "lo", "frame"]).groupBy("episode", "lo").agg(F.percentile(V.distance(F.col("r"), F.col("r2")), F.lit(0.95)).alias("jitter"))


def smoothed(frames: DataFrame, size: int = 9) -> DataFrame:
    """frames with `smooth`: a quadratic or cubic least-squares fit over size frames, at their middle (Savitzky-Golay);
    null within size // 2 of the ends."""
    m = size // 2
    scale = (2 * m - 1) * (2 * m + 1) * (2 * m + 3) / 3
    weights = [(3 * m * m + 3 * m - 1 - 5 * i * i) / scale for i in range(-m, m + 1)]
    rows = F.collect_list("q").over(in_order().rowsBetween(-m, m))
    x = frames.withColumn("near", rows)
    fit = F.aggregate(F.zip_with("near", F.array(*map(F.lit, weights)), lambda v, w: F.transform(v, lambda y: y * w)), F.transform("q", lambda y: y * 0), lambda s, v: F.zip_with(s, v, lambda a, b: a + b))
    return x.withColumn("smooth", F.when(F.size("near") == size, fit)).drop("near")


def sliding(frames: DataFrame, span: int, stride: int) -> DataFrame:
    """(episode, lo, frame, q) of every window of span + 1 frames, each stride frames."""
    n = frames.groupBy("episode").agg(F.max("frame").alias("last"))
    lows = n.where(F.col("last") - span - 1 >= 0).select("episode", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last") - span - 1, F.lit(stride).cast("long"))).alias("lo"))
    # an equality on the episode and on blocks of frames, so frames meet only windows near them
    block = lambda c: F.floor(F.col(c) / (span + 1))
    spread = lows.withColumn("block", F.explode(F.array(block("lo"), block("lo") + 1)))
    x = frames.select("episode", "frame", "q", block("frame").alias("block"))
    return x.join(spread, ["episode", "block"]).where((F.col("frame") >= F.col("lo")) & (F.col("frame") <= F.col("lo") + span)).select("episode", "lo", "frame", "q")


