"""Playing chunks back: scheduling, shape-preserving tangents, blending, rate limits, replanning, junction speeds.

What depends only on neighbours is window functions. Recurrences, in which every tick needs the one before it, run per
episode in a grouped map; its state is a few vectors, its input one episode.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import vectors as V


def by_point() -> WindowSpec:
    return Window.partitionBy("chunk").orderBy("k")



def schedule(points: DataFrame, speed: float, least: float) -> DataFrame:
    """(chunk, k, q) points with `time`: when each is due, at the speed but at least `least` seconds after the one before.

    The first point lies a step ahead, so it gets the time of the step that follows it.
    """
    near = F.coalesce(V.distance(F.col("q"), F.lag("q").over(by_point())), V.distance(F.lead("q").over(by_point()), F.col("q")), F.lit(0.0))
    x = points.withColumn("dt", F.greatest(near / speed, F.lit(least)))
    return x.withColumn("time", F.sum("dt").over(by_point().rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("dt")


def tangents(timed: DataFrame) -> DataFrame:
    """timed points with `m`: the mean of neighbouring slopes, 0 where they disagree, at most three times the smaller."""
    h = F.lead("time").over(by_point()) - F.col("time")
    x = timed.withColumn("s", F.transform(V.minus(F.lead("q").over(by_point()), F.col("q")), lambda d: d / h)).withColumn("b", F.lag("s").over(by_point()))

    def inner(a: Column, b: Column) -> Column:
        bound = 3 * F.least(F.abs(a), F.abs(b))
        mean = (a + b) / 2
        return F.when(a * b <= 0, 0.0).otherwise(F.greatest(-bound, F.least(bound, mean)))

    m = F.when(F.col("s").isNull() & F.col("b").isNull(), F.transform("q", lambda v: v * 0)).when(F.col("b").isNull(), F.col("s")).when(F.col("s").isNull(), F.col("b")).otherwise(F.zip_with("b", "s", inner))
    return x.withColumn("m", m).drop("s", "b")


def evaluate(curve: DataFrame, at: DataFrame) -> DataFrame:
    """Positions and velocities of timed points with tangents at (chunk, tau); ends are held, with no velocity."""
    nexts = [F.lead(c).over(by_point()).alias(f"next_{c}") for c in ("time", "q", "m")]
    k = curve.select("chunk", "time", F.struct("k", "time", "q", "m", *nexts).alias("p"), F.min("time").over(Window.partitionBy("chunk")).alias("start"))
    left = k.select("chunk", F.col("time").alias("tau"), F.lit(0).alias("kind"), "p", "start")
    right = at.select("chunk", "tau", F.lit(1).alias("kind"), F.lit(None).cast(k.schema["p"].dataType).alias("p"), F.lit(None).cast("double").alias("start"))
    w = Window.partitionBy("chunk").orderBy("tau", "kind")
    both = left.unionByName(right).withColumn("p", F.last("p", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    first = k.where("p.k = 1").select("chunk", F.col("p.q").alias("first"))
    both = both.where("kind = 1").join(first, "chunk")
    h = F.col("p.next_time") - F.col("p.time")
    u = (F.col("tau") - F.col("p.time")) / h
    parts = F.arrays_zip(F.col("p.q").alias("p0"), F.col("p.next_q").alias("p1"), F.col("p.m").alias("m0"), F.col("p.next_m").alias("m1"))
    held = F.col("p").isNull() | F.col("p.next_q").isNull() | ((F.col("p.k") == 1) & (F.col("tau") <= F.col("p.time")))
    q = F.transform(parts, lambda z: V.hermite(z["p0"], z["p1"], z["m0"], z["m1"], u, h))
    v = F.transform(parts, lambda z: V.hermite_velocity(z["p0"], z["p1"], z["m0"], z["m1"], u, h) / h)
    still = F.transform("first", lambda x: x * 0)
    return both.select("chunk", "tau", F.when(held, F.coalesce("p.q", "first")).otherwise(q).alias("q"), F.when(held, still).otherwise(v).alias("v"))


def velocity_jumps(ticks: DataFrame) -> DataFrame:
    """Per playback (column `chunk`): 99th percentile and largest change of velocity between ticks, and the ratio of the
    largest to the smallest moving speed."""
    w = Window.partitionBy("chunk").orderBy("tau")
    speed = V.norm(F.col("v"))
    x = ticks.withColumn("jump", V.distance(F.col("v"), F.lag("v").over(w))).withColumn("speed", speed)
    return x.groupBy("chunk").agg(F.count(F.lit(1)).alias("ticks"), F.percentile("jump", F.lit(0.99)).alias("p99"), F.max("jump").alias("largest"), (F.max("speed") / F.min(F.when(F.col("speed") > 0, F.col("speed")))).alias("spread"))


def first_trigger(chunk: Column, threshold: float = 0.5) -> Column:
    """The 1-based step at which a command first goes on, null if it doesn't."""
    return F.nullif(F.array_position(F.transform(chunk, lambda x: x > threshold), F.lit(True)), F.lit(0).cast("long"))


def seams(points: DataFrame) -> DataFrame:
    """(episode, chunk, gap): from the last point of the chunk before to the first of this one; points (episode, chunk, k, q)."""
    ends = points.groupBy("episode", "chunk").agg(F.min_by("q", "k").alias("first"), F.max_by("q", "k").alias("last"))
    gap = V.distance(F.col("first"), F.lag("last").over(Window.partitionBy("episode").orderBy("chunk")))
    return ends.select("episode", "chunk", gap.alias("gap")).where("gap IS NOT NULL")


def overshoot(travelled: DataFrame, path: DataFrame) -> DataFrame:
    """(episode, ratio) of the distance travelled to the length of the path; both (episode, frame, q)."""

    def length(x: DataFrame, name: str) -> DataFrame:
        w = Window.partitionBy("episode").orderBy("frame")
        return x.withColumn("d", V.distance(F.col("q"), F.lag("q").over(w))).groupBy("episode").agg(F.sum("d").alias(name))

    return length(travelled, "a").join(length(path, "b"), "episode").select("episode", (F.col("a") / F.col("b")).alias("ratio"))


def retimed(resampled: DataFrame) -> DataFrame:
    """Per episode the source frame shown at each sample, and how much is shown: picked frames, distinct ones, speed-up."""
    x = resampled.select("episode", F.rint("t").cast("long").alias("frame"))
    return x.groupBy("episode").agg(F.count(F.lit(1)).alias("picked"), F.countDistinct("frame").alias("distinct"), ((F.max("frame") + 1) / F.count(F.lit(1))).alias("speedup"))


def suction_report(predictions: DataFrame) -> DataFrame:
    """Per task, from (task, on_now, label, predicted) first trigger steps: recall, false fires, step errors."""
    x = predictions.where("NOT on_now")
    both = F.col("label").isNotNull() & F.col("predicted").isNotNull()
    delta = F.when(both, F.col("predicted") - F.col("label"))
    return x.groupBy("task").agg(
        F.when(F.count("label") > 0, F.count_if(both) / F.count("label") * 100).alias("recall"),
        (F.count("predicted") - F.count_if(both)).alias("false_fires"),
        F.count_if(both).alias("compared"),
        F.percentile(delta, F.lit(0.5)).alias("p50"),
        F.percentile(F.abs(delta), F.lit(0.9)).alias("p90"),
        F.avg((F.abs(delta) <= 5).cast("int")).alias("within_5"),
    )


def horizon_errors(pairs: DataFrame) -> DataFrame:
    """(k, p50, p95, largest) of the distance between (k, label, predicted) vectors by step."""
    d = V.distance(F.col("label"), F.col("predicted"))
    return pairs.groupBy("k").agg(F.percentile(d, F.lit(0.5)).alias("p50"), F.percentile(d, F.lit(0.95)).alias("p95"), F.max(d).alias("largest"))


def worst_joint(pairs: DataFrame) -> DataFrame:
    """The dimension with the largest mean absolute error; the first of equals."""
    x = pairs.select(F.posexplode(F.zip_with("label", "predicted", lambda a, b: F.abs(a - b))).alias("dim", "e")).groupBy("dim").agg(F.avg("e").alias("error"))
    return x.orderBy(F.desc("error"), "dim").limit(1)


# Recurrences.


@dataclass(frozen=True)
class Limits:
    speed: float
    acceleration: float
    jerk: float
    settle: float = 0.10


def limit_run(targets: np.ndarray, feeds: np.ndarray, limits: Limits, dt: float, motion: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Motions (tick, position/velocity/acceleration, joint) that follow targets moving at feeds, and the last of them.

    At each tick the accelerations within reach are those that jerk allows from the present one and the limit allows at
    all. Of these the nearest is taken to the one that would reach the wanted velocity at once: the target's own, and
    what closes the offset in `settle` seconds.
    """
    out = np.empty((len(targets), *motion.shape))
    reach = limits.jerk * dt
    for tick in range(len(targets)):
        p, v, a = motion
        wanted = np.clip(feeds[tick] + (targets[tick] - p) / limits.settle, -limits.speed, limits.speed)
        nearest = np.minimum(np.maximum((wanted - v) / dt, np.maximum(a - reach, -limits.acceleration)), np.minimum(a + reach, limits.acceleration))
        velocity = np.clip(v + nearest * dt, -limits.speed, limits.speed)
        motion = out[tick] = np.stack([p + velocity * dt, velocity, nearest])
    return out, motion


def at_rest(position: np.ndarray) -> np.ndarray:
    """The motion that stands still at a position."""
    return np.stack([position, np.zeros_like(position), np.zeros_like(position)]).astype(float)


def per_episode(frames: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str, key: str = "episode", order: str = "frame") -> DataFrame:
    """f over each episode's rows in order."""
    return frames.groupBy(key).applyInPandas(lambda p: f(p.sort_values(order, ignore_index=True)), schema)


def limited(ticks: DataFrame, limits: Limits, dt: float) -> DataFrame:
    """(chunk, tau, q, v) that follows ticks of the same columns within the limits."""

    def follow(p: pd.DataFrame) -> pd.DataFrame:
        target = np.stack(p["q"])
        moved, _ = limit_run(target, np.stack(p["v"]), limits, dt, at_rest(target[0]))
        return pd.DataFrame({"chunk": p["chunk"], "tau": p["tau"], "q": list(moved[:, 0]), "v": list(moved[:, 1])})

    ticks = ticks.where("q IS NOT NULL AND v IS NOT NULL")  # a tick without a target isn't one
    return per_episode(ticks, follow, "chunk long, tau double, q array<double>, v array<double>", "chunk", "tau")


def replan_frames(steps: DataFrame, replan: int) -> DataFrame:
    """(episode, frame) at which a controller that plays `replan` steps of a chunk asks again.

    steps: look_ahead() rows; only the step played to is read.
    """

    def walk(p: pd.DataFrame) -> pd.DataFrame:
        ahead, frame, out = p["t"].round().astype(int).to_numpy(), 0, []
        while frame < len(ahead) - 1:
            out.append(frame)
            frame = ahead[frame] if ahead[frame] > frame else frame + 1
        return pd.DataFrame({"episode": p["episode"].iloc[0], "frame": out}, columns=["episode", "frame"])

    last = steps.groupBy("episode").agg(F.max("k").alias("h"))
    played = steps.join(last, "episode").where(F.col("k") == F.least(F.lit(replan), F.col("h"))).select("episode", "frame", "t")
    return per_episode(played, walk, "episode long, frame long")


def splice(steps: DataFrame, asked: DataFrame, replan: int) -> DataFrame:
    """(episode, chunk, k, q): the executed prefixes of the chunks asked for, in order."""
    return steps.where(F.col("k") <= replan).join(asked, ["episode", "frame"]).select("episode", F.col("frame").alias("chunk"), "k", "q")


def along(limits: np.ndarray, direction: np.ndarray) -> np.ndarray:
    """The largest scalar along each direction that keeps every joint within its limit; infinite without a direction."""
    share = np.abs(direction)
    with np.errstate(divide="ignore"):
        return np.where(share > 1e-9, limits / share, np.inf).min(1)


def climb(squares: np.ndarray, gains: np.ndarray) -> np.ndarray:
    """The largest squares of speeds below these that gain at most so much from each to the next.

    In sums of the gains, a speed's bound is the least of all before it, so the sweep is a running minimum.
    """
    sums = np.concatenate([[0.0], np.cumsum(gains)])
    return sums + np.minimum.accumulate(squares - sums)


def junction_velocities(points: np.ndarray, speed: np.ndarray, acceleration: np.ndarray, margin: float = 0.25) -> np.ndarray:
    """Velocities at which a path may be passed through at its points, by limits of each joint; zero at both ends.

    A point's speed is bounded by what the joints allow along the way out, by the turn (the velocity must swing by the
    chord between the ways in and out, within the shorter of the two segments) and by what the segments on both sides
    can build up and shed. All of it is then taken times the margin.
    """
    steps = np.diff(points, axis=0)
    length = np.linalg.norm(steps, axis=1)
    unit = steps / np.maximum(length, 1e-300)[:, None]
    direction, bound = np.zeros_like(points), np.zeros(len(points))
    inner = np.flatnonzero((length[:-1] >= 1e-9) & (length[1:] >= 1e-9)) + 1
    direction[inner] = unit[inner]
    push = along(acceleration, direction)
    push[np.isinf(push)] = acceleration.min()
    swing = np.linalg.norm(unit[inner] - unit[inner - 1], axis=1)
    turn = np.sqrt(push[inner] * np.minimum(length[inner - 1], length[inner]) / np.maximum(swing, 1e-300))
    bound[inner] = np.minimum(along(speed, direction[inner]), np.where(swing > 1e-6, turn, np.inf))
    gains = 2 * np.minimum(push[:-1], push[1:]) * length
    squares = climb(climb(bound**2, gains)[::-1], gains[::-1])[::-1]
    return direction * (margin * np.sqrt(np.maximum(squares, 0.0)))[:, None]


def junction_speeds(frames: DataFrame, speed: list[float], acceleration: list[float], margin: float = 0.25) -> DataFrame:
    """(episode, frame, v) by junction_velocities(); frames without q are left out."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        v = junction_velocities(np.stack(p["q"]).astype(float), np.array(speed), np.array(acceleration), margin)
        return pd.DataFrame({"episode": p["episode"], "frame": p["frame"], "v": list(v)})

    return per_episode(frames.where("q IS NOT NULL"), run, "episode long, frame long, v array<double>")


def greedy_order(path: np.ndarray, up_to: int) -> list[int]:
    """Keypoints in the order in which each is worst off without itself, linear in between; a prefix answers any budget.

    Only the interval that a new point splits is rebuilt.
    """
    n = len(path)
    error = np.zeros(n)

    def rebuild(lo: int, hi: int) -> None:
        u = (np.arange(lo, hi + 1) - lo)[:, None] / max(hi - lo, 1)
        error[lo : hi + 1] = np.linalg.norm(path[lo] + (path[hi] - path[lo]) * u - path[lo : hi + 1], axis=1)
        error[[lo, hi]] = -1.0

    order = list(dict.fromkeys([0, n - 1]))
    rebuild(0, n - 1)
    while len(order) < min(up_to, n):
        pick = int(np.argmax(error))
        below, above = max(k for k in order if k < pick), min(k for k in order if k > pick)
        order.append(pick)
        rebuild(below, pick)
        rebuild(pick, above)
    return order


def greedy_keypoints(frames: DataFrame, up_to: int) -> DataFrame:
    """(episode, i, frame): the greedy order of each episode."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        order = greedy_order(np.stack(p["q"]), up_to)
        return pd.DataFrame({"episode": p["episode"].iloc[0], "i": range(len(order)), "frame": order})

    return per_episode(frames, run, "episode long, i long, frame long")


def spline_basis(t: np.ndarray, knots: np.ndarray, degree: int = 3) -> np.ndarray:
    """B-spline basis functions at t, by Cox-de Boor."""
    t = np.clip(t, knots[0], knots[-1])
    at = np.clip(np.searchsorted(knots, t, side="right") - 1, degree, len(knots) - degree - 2)
    b = np.zeros((len(t), len(knots) - 1))
    b[np.arange(len(t)), at] = 1
    for k in range(1, degree + 1):
        left = np.divide(t[:, None] - knots[None, : -k - 1], knots[k:-1] - knots[: -k - 1], out=np.zeros((len(t), len(knots) - k - 1)), where=knots[k:-1] > knots[: -k - 1])
        right = np.divide(knots[None, k + 1 :] - t[:, None], knots[k + 1 :] - knots[1:-k], out=np.zeros((len(t), len(knots) - k - 1)), where=knots[k + 1 :] > knots[1:-k])
        b = left * b[:, :-1] + right * b[:, 1:]
    return b


def fit_spline(path: np.ndarray, n: int, least_gap: float = 1.5) -> np.ndarray:
    """The least-squares cubic spline of n coefficients (fewer where knots would crowd), at every frame."""
    t, last = np.arange(len(path), dtype=float), len(path) - 1.0
    inner = max(0, min(n - 4, int(last / least_gap) - 1))  # as many as the gap leaves room for
    kept = np.linspace(0, last, inner + 2)[1:-1]
    basis = spline_basis(t, np.concatenate([np.zeros(4), kept, np.full(4, last)]))
    return basis @ np.linalg.lstsq(basis, path, rcond=None)[0]


def spline_errors(frames: DataFrame, n: int) -> DataFrame:
    """(episode, p95) of the distance to the fitted spline."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        q = np.stack(p["q"])
        return pd.DataFrame({"episode": [p["episode"].iloc[0]], "p95": [float(np.quantile(np.linalg.norm(fit_spline(q, n) - q, axis=1), 0.95))]})

    return per_episode(frames, run, "episode long, p95 double")


def window_budgets(frames: DataFrame, span: int, stride: int, n: int) -> DataFrame:
    """(episode, lo, anchored, causal): 95th percentiles of the linear reconstruction error of each window from n arc
    keypoints of its own, with its far end pinned, and with only its near end and its keypoints."""

    def error(q: np.ndarray, keys: np.ndarray, end: int) -> float:
        keys = np.unique(np.rint(keys).astype(int))
        r = np.stack([np.interp(np.arange(end + 1), keys, q[keys, j]) for j in range(q.shape[1])], 1)
        return float(np.quantile(np.linalg.norm(r - q[: end + 1], axis=1), 0.95))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        path, rows = np.stack(p["q"]), []
        for lo in range(0, len(path) - span - 1, stride):
            q = path[lo : lo + span + 1]
            s = np.concatenate([[0.0], np.cumsum(np.linalg.norm(np.diff(q, axis=0), axis=1))]) + np.arange(len(q)) * 1e-12
            keys = np.interp(np.linspace(0, s[-1], n + 1)[:-1], s, np.arange(len(q), dtype=float))
            end = int(keys[-1])
            if end > 1:
                rows.append((int(p["episode"].iloc[0]), lo, error(q, np.append(keys, span), span), error(q, np.append(0, np.append(keys[keys < end], end)), end)))
        return pd.DataFrame(rows, columns=["episode", "lo", "anchored", "causal"])

    return per_episode(frames, run, "episode long, lo long, anchored double, causal double")


def principal_paths(frames: DataFrame, n: int = 2) -> DataFrame:
    """(episode, ratios): shares of the variance along each episode's first n principal directions."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        q = np.stack(p["q"])
        s = np.linalg.svd(q - q.mean(0), compute_uv=False) ** 2
        return pd.DataFrame({"episode": [p["episode"].iloc[0]], "ratios": [(s[:n] / max(s.sum(), 1e-300)).tolist()]})

    return per_episode(frames, run, "episode long, ratios array<double>")
