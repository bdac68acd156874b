"""Progress operators against plain numpy on random and edge-case episodes."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from framewright.operators import progress as P

SCHEMA = "episode long, frame long, q array<double>, measured array<double>, commands array<double>, feedback array<double>"


def table(spark, episodes):
    rows = []
    for e, (q, on, level) in enumerate(episodes):
        rows += [(e, f, [float(v) for v in np.atleast_1d(q[f])], [float(v) for v in np.atleast_1d(q[f])], [float(on[f])], [float(level[f])]) for f in range(len(q))]
    return spark.createDataFrame(rows, SCHEMA)


def plain_curve(q, on, level, cfg):
    """The curve by loops."""
    q = np.asarray(q, float).reshape(len(on), -1)
    t, n = len(q), len(q) - 1
    if t < 3:
        return [0.0] * t, [False] * max(n, 0)
    raw = [np.linalg.norm(q[max(i, 1) + 1] - 2 * q[max(i, 1)] + q[max(i, 1) - 1]) for i in range(n)]
    raw = [(r + 1e-12) ** (1 / 3) for r in raw]
    dwell, near = [False] * n, [False] * n
    for f in range(1, t):
        if on[f] != on[f - 1]:
            ok = [g for g in range(f, t) if (level[g] > cfg.threshold) == bool(on[f])]
            length = min(max(ok[0] - f if ok else cfg.max_dwell, cfg.min_dwell), cfg.max_dwell)
            for g in range(f, min(f + length, t - 1)):
                dwell[g] = True
            for g in range(max(f - cfg.approach, 0), f):
                near[g] = True
    event = [d or a for d, a in zip(dwell, near)]
    free = [0.0 if e else max(r - cfg.deadzone, 0.0) for e, r in zip(event, raw)]
    n_free, total = n - sum(event), sum(free)
    step = max(total, 1.0) / max(n, 1) if n_free <= 0 or total <= 0 else total * cfg.frames_per_step / n_free
    ds, i = list(free), 0
    while i < n:
        if event[i]:
            j = i
            while j < n and event[j]:
                j += 1
            ds[i:j] = [step * min(cfg.event_points, j - i) / (j - i)] * (j - i)
            i = j
        else:
            i += 1
    return np.concatenate([[0.0], np.cumsum(ds)]).tolist(), event


def check(spark, episodes, cfg):
    got = {}
    for r in P.progress_curve(table(spark, episodes), cfg).collect():
        got.setdefault(r.episode, {})[r.frame] = r
    for e, (q, on, level) in enumerate(episodes):
        s, event = plain_curve(q, on, level, cfg)
        rows = [got[e][f] for f in range(len(on))]
        assert np.allclose([r.s for r in rows], s, atol=1e-9)
        if len(on) > 2:
            assert [bool(r.event) for r in rows[:-1]] == event


EDGES = {
    "one frame": ([0.0], [0], [0]),
    "two frames": ([0.0, 1.0], [0, 1], [0, 1]),
    "three frames": ([0.0, 1.0, 4.0], [0, 0, 0], [0, 0, 0]),
    "on at the start": ([0, 1, 3, 4, 4, 9.0], [1, 1, 1, 1, 1, 1], [0] * 6),
    "edge on the last frame": ([0, 1, 3, 4, 4, 9.0], [0, 0, 0, 0, 0, 1], [0] * 6),
    "never held": (np.arange(200.0) ** 1.5, [0] * 20 + [1] * 180, [0] * 200),
    "release already low": (np.arange(40.0) ** 1.5, [1] * 20 + [0] * 20, [0] * 40),
    "still": ([2.0] * 50, [0] * 50, [0] * 50),
    "all event": (np.arange(12.0) ** 2, [0, 1] * 6, [0, 1] * 6),
}


def test_edge_cases(spark):
    check(spark, list(EDGES.values()), P.ProgressConfig(approach=5))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seed=st.integers(0, 10_000), approach=st.integers(1, 8), deadzone=st.sampled_from([0.0, 0.2]))
def test_random_episodes(spark, seed, approach, deadzone):
    rng = np.random.default_rng(seed)
    episodes = []
    for _ in range(4):
        t = int(rng.integers(3, 60))
        episodes.append((rng.normal(size=(t, 2)).cumsum(0), (rng.random(t) < 0.1).cumsum() % 2, rng.random(t)))
    check(spark, episodes, P.ProgressConfig(approach=approach, deadzone=deadzone, event_points=4))


def test_resampling_stays_on_the_path(spark):
    rng = np.random.default_rng(3)
    q = rng.normal(size=80).cumsum()
    on = np.array([0] * 30 + [1] * 20 + [0] * 30)
    level = np.array([0] * 34 + [1] * 46)
    curve = P.progress_curve(table(spark, [(q, on, level)]), P.ProgressConfig(span=20, horizon=10, approach=4)).cache()
    rows = sorted(P.resample(curve).collect(), key=lambda r: r.sample)
    t = np.array([r.t for r in rows])
    assert t[0] == 0 and (np.diff(t) >= 0).all() and t[-1] <= 79
    for r in rows:
        near = q[int(np.floor(r.t)) : int(np.floor(r.t)) + 2]
        assert near.min() - 1e-9 <= r.q[0] <= near.max() + 1e-9
        assert r.commands[0] in (0.0, 1.0)
    s = np.array([r.s for r in sorted(curve.collect(), key=lambda r: r.frame)])
    strict = s + np.arange(80) * max(s[-1], 1) * 1e-12
    assert np.allclose(t, np.interp(np.minimum([r.s for r in rows], s[-1]), strict, np.arange(80)), atol=1e-6)


def test_chunks_and_unflatten(spark):
    from pyspark.sql import functions as F

    cfg = P.ProgressConfig(span=8, horizon=4, approach=2)
    q = np.arange(20.0) ** 2
    curve = P.progress_curve(table(spark, [(q, [0] * 20, [0] * 20)]), cfg)
    rows = P.chunks(P.look_ahead(curve, cfg, 3.0)).withColumn("u", P.unflatten(F.col("action_chunk"), 2)).collect()
    assert len(rows) == 20
    for r in rows:
        assert len(r.action_chunk) == 8 and len(r.u) == 4 and [x for v in r.u for x in v] == r.action_chunk
        assert set(r.action_loss_weight) <= {1.0, 3.0}
    assert np.allclose([r.u[-1][0] for r in rows if r.frame == 19], q[-1])


@pytest.mark.parametrize("report, span", [({"span_frames": 200}, 200), ({"speed_scale": 4.0}, 200)])
def test_config_from_lineage(report, span):
    c = P.config_from_lineage({"config": {"min_dwell_frames": 0, "deadzone": 0.002, "approach_frames": 15, "action_horizon": 50, **report}})
    assert (c.span, c.metric, c.deadzone, c.event_points) == (span, "arc", 0.002, 32)
