"""The online chunk follower: chunks are pushed as they arrive, and every tick gives a position and a velocity.

A state is a value: the chunk that is played, the one before it, when each began, and the limited motion. Ticks between
two pushes are one run, evaluated as arrays. In batch it is run per robot over ordered rows; as a stream the state is
kept per robot in typed columns. Both use the same two functions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.playback import Limits, at_rest, limit_run

OUT = "robot long, tick long, q array<double>, v array<double>, exhausted boolean"
STATE = "tick long, width int, points array<double>, began double, earlier array<double>, earlier_began double, pushed long, motion array<double>"


@dataclass(frozen=True)
class PlaybackConfig:
    speed: float = 0.75
    least_dt: float = 0.06
    dt: float = 0.02
    blend: float = 0.2
    limits: Limits | None = None


class Curve:
    """A chunk's points at scheduled times, with a cubic in each interval whose slopes don't overshoot."""

    def __init__(self, points: np.ndarray, cfg: PlaybackConfig):
        self.points = points
        d = np.linalg.norm(np.diff(points, axis=0), axis=1)
        self.times = np.cumsum(np.maximum(np.concatenate([d[:1] if len(d) else [0.0], d]) / cfg.speed, cfg.least_dt))
        self.cubics = np.zeros((0, 4, points.shape[1]))
        if len(points) > 1:
            h = np.diff(self.times)[:, None]
            slope = np.diff(points, axis=0) / h
            least = 3 * np.minimum(np.abs(slope[:-1]), np.abs(slope[1:]))
            bent = np.where(slope[:-1] * slope[1:] <= 0, 0.0, np.clip((slope[:-1] + slope[1:]) / 2, -least, least))
            tangent = np.concatenate([slope[:1], bent, slope[-1:]])
            m, w = tangent[:-1], tangent[1:]
            self.cubics = np.stack([points[:-1], m, (3 * slope - 2 * m - w) / h, (m + w - 2 * slope) / h**2], 1)

    def at(self, tau: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and velocities; before its first and after its last time the curve stands still."""
        tau = np.asarray(tau, float)
        outside = (tau <= self.times[0]) | (tau >= self.times[-1])
        q = np.where((tau <= self.times[0])[:, None], self.points[0], self.points[-1])
        v = np.zeros_like(q)
        if not outside.all():
            within = tau[~outside]
            i = np.searchsorted(self.times, within, side="right") - 1
            u, (a, b, c, d) = (within - self.times[i])[:, None], self.cubics[i].transpose(1, 0, 2)
            q[~outside], v[~outside] = a + u * (b + u * (c + u * d)), b + u * (2 * c + u * 3 * d)
        return q, v


@dataclass(frozen=True)
class Playing:
    """tick: ticks so far. points began at `began` (seconds), what was played before at `earlier_began`, and since tick
    `pushed` the one blends into the other. motion: see playback.limit_run()."""

    tick: int = 0
    points: np.ndarray | None = None
    began: float = 0.0
    earlier: np.ndarray | None = None
    earlier_began: float = 0.0
    pushed: int = 0
    motion: np.ndarray | None = None


def pushed(state: Playing, points: np.ndarray, latency: float, cfg: PlaybackConfig) -> Playing:
    """The state after a chunk has come that was asked for `latency` seconds ago."""
    return replace(state, points=points, began=state.tick * cfg.dt - latency, earlier=state.points, earlier_began=state.began, pushed=state.tick)


def played(state: Playing, n: int, cfg: PlaybackConfig) -> tuple[Playing, np.ndarray, np.ndarray, np.ndarray]:
    """The state n ticks later, and their positions, velocities and whether the chunk has then run out. No chunk, no ticks."""
    if state.points is None or n <= 0:
        width = 0 if state.points is None else state.points.shape[1]
        return state, np.zeros((0, width)), np.zeros((0, width)), np.zeros(0, bool)
    ticks = state.tick + np.arange(n)
    curve = Curve(state.points, cfg)
    q, v = curve.at(ticks * cfg.dt - state.began)
    share = np.clip((ticks - state.pushed) * cfg.dt / cfg.blend, 0.0, 1.0) if cfg.blend > 0 else np.ones(n)
    if state.earlier is not None and share[0] < 1:
        weight = (share * share * (3 - 2 * share))[:, None]
        q0, v0 = Curve(state.earlier, cfg).at(ticks * cfg.dt - state.earlier_began)
        q, v = q0 + weight * (q - q0), v0 + weight * (v - v0)
    motion = state.motion
    if cfg.limits is not None:
        moved, motion = limit_run(q, v, cfg.limits, cfg.dt, at_rest(q[0]) if motion is None else motion)
        q, v = moved[:, 0], moved[:, 1]
    done = (ticks + 1) * cfg.dt - state.began > curve.times[-1]
    return replace(state, tick=state.tick + n, motion=motion), q, v, done


def play(state: Playing, robot: int, rows: pd.DataFrame, cfg: PlaybackConfig) -> tuple[Playing, pd.DataFrame]:
    """Ticks of rows (seq, chunk, width, latency, ticks): push the flat chunk, if there is one, then play `ticks` ticks."""
    out = []
    for r in rows.sort_values("seq").itertuples():
        if r.chunk is not None and len(r.chunk):
            state = pushed(state, np.asarray(r.chunk, float).reshape(-1, r.width), r.latency, cfg)
        state, q, v, done = played(state, int(r.ticks), cfg)
        first = state.tick - len(q) + 1
        out.append(pd.DataFrame({"robot": robot, "tick": np.arange(first, first + len(q)), "q": list(q), "v": list(v), "exhausted": done}))
    return state, pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=["robot", "tick", "q", "v", "exhausted"])


def follow_batch(rows: DataFrame, cfg: PlaybackConfig) -> DataFrame:
    return rows.groupBy("robot").applyInPandas(lambda key, p: play(Playing(), int(key[0]), p, cfg)[1], OUT)


def to_row(s: Playing) -> tuple:
    flat = lambda x: None if x is None else x.ravel().tolist()
    return s.tick, 0 if s.points is None else s.points.shape[1], flat(s.points), s.began, flat(s.earlier), s.earlier_began, s.pushed, flat(s.motion)


def from_row(r: tuple) -> Playing:
    tick, width, points, began, earlier, earlier_began, at, motion = r
    shaped = lambda x: None if x is None else np.asarray(x, float).reshape(-1, width)
    return Playing(tick, shaped(points), began, shaped(earlier), earlier_began, at, shaped(motion))


class FollowerProcessor(StatefulProcessor):
    """The follower per robot, for transformWithStateInPandas."""

    def __init__(self, cfg: PlaybackConfig):
        self.cfg = cfg

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("player", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = from_row(tuple(self.kept.get())) if self.kept.exists() else Playing()
        state, out = play(state, int(key[0]), pd.concat(list(rows)), self.cfg)  # a robot's rows of one micro-batch, in order
        yield out
        self.kept.update(to_row(state))

    def close(self) -> None:
        pass


def follow_stream(rows: DataFrame, cfg: PlaybackConfig) -> DataFrame:
    return rows.groupBy("robot").transformWithStateInPandas(FollowerProcessor(cfg), OUT, "Append", "None")
