"""Playback, kinematics and keypoints against plain numpy, and invariants of the recurrences."""

import math

import numpy as np

from framewright.operators import kinematics as K
from framewright.operators import playback as B
from framewright.operators import shape as G
from framewright.streaming import follower as L


def test_limiter_keeps_its_bounds():
    lim, dt = B.Limits(1.0, 5.0, 50.0), 0.02
    targets = np.stack([[np.sign(np.sin(i / 20)), 3.0] for i in range(300)])
    moved, last = B.limit_run(targets, np.zeros((300, 2)), lim, dt, B.at_rest(np.zeros(2)))
    p, v, a = moved.transpose(1, 0, 2)
    assert (np.abs(v) <= lim.speed + 1e-12).all() and (np.abs(a) <= lim.acceleration + 1e-12).all()
    assert (np.abs(np.diff(a, axis=0)) <= lim.jerk * dt + 1e-9).all() and (np.abs(np.diff(v, axis=0)) <= lim.acceleration * dt + 1e-9).all()
    assert np.allclose(np.diff(p, axis=0), v[1:] * dt) and (last == moved[-1]).all()
    half, state = B.limit_run(targets[:150], np.zeros((150, 2)), lim, dt, B.at_rest(np.zeros(2)))
    assert (np.concatenate([half, B.limit_run(targets[150:], np.zeros((150, 2)), lim, dt, state)[0]]) == moved).all()


def test_curve_hits_its_knots_and_does_not_overshoot():
    points = np.random.default_rng(0).normal(size=(12, 3))
    c = L.Curve(points, L.PlaybackConfig())
    assert np.allclose(c.at(c.times)[0], points)
    for a, b, p, q in zip(c.times, c.times[1:], points, points[1:]):
        found = c.at(np.linspace(a, b, 7))[0]
        assert (found >= np.minimum(p, q) - 1e-9).all() and (found <= np.maximum(p, q) + 1e-9).all()
    assert np.allclose(c.at([-1.0])[0], points[0]) and not c.at([1e9])[1].any()
    middle = (c.times[1:] + c.times[:-1]) / 2
    assert np.allclose(c.at(middle)[1], (c.at(middle + 1e-6)[0] - c.at(middle - 1e-6)[0]) / 2e-6, atol=1e-4)
    assert L.Curve(points[:1], L.PlaybackConfig()).at([0.0, 5.0])[0].tolist() == [points[0].tolist()] * 2


def test_blend_is_continuous_and_ticks_may_be_cut_anywhere():
    cfg = L.PlaybackConfig(limits=B.Limits(2.0, 20.0, 400.0))
    for cfg in (L.PlaybackConfig(), cfg):
        runs = []
        for parts in ([20], [1] * 20, [7, 13]):
            state, out = L.pushed(L.Playing(), np.linspace(0, 1, 10)[:, None], 0.0, cfg), []
            for again in range(2):
                for n in parts:
                    state, q, *_ = L.played(L.from_row(L.to_row(state)), n, cfg)
                    out += q[:, 0].tolist()
                if not again:
                    state = L.pushed(state, np.linspace(out[-1] + 0.3, 2, 10)[:, None], 0.02, cfg)
            runs.append(out)
        assert np.allclose(runs[0], runs[1]) and np.allclose(runs[0], runs[2]) and np.abs(np.diff(runs[0])).max() < 0.1
    assert len(L.played(L.Playing(), 5, cfg)[1]) == 0


def junctions_by_force(points, speed, acceleration, margin):
    """The rule, point by point: ceilings along the way out, the turn, and what each segment can build up or shed."""
    n, dims = len(points), range(len(speed))
    length = [math.dist(a, b) for a, b in zip(points, points[1:])]
    way = [None] * n
    for i in range(1, n - 1):
        if length[i - 1] >= 1e-9 and length[i] >= 1e-9:
            way[i] = [(points[i + 1][k] - points[i][k]) / length[i] for k in dims]
    most = lambda limit, w: min(limit[k] / abs(w[k]) for k in dims if abs(w[k]) > 1e-9)
    push = [most(acceleration, w) if w else min(acceleration) for w in way]
    v = [0.0] * n
    for i in range(1, n - 1):
        if way[i]:
            before = [(points[i][k] - points[i - 1][k]) / length[i - 1] for k in dims]
            angle = math.acos(max(-1.0, min(1.0, sum(a * b for a, b in zip(before, way[i])))))
            v[i] = most(speed, way[i])
            if 2 * math.sin(angle / 2) > 1e-6:
                v[i] = min(v[i], math.sqrt(push[i] * min(length[i - 1], length[i]) / (2 * math.sin(angle / 2))))
    for order, step in ((range(1, n), -1), (range(n - 2, -1, -1), 1)):
        for i in order:
            j = i + step
            v[i] = min(v[i], math.sqrt(v[j] ** 2 + 2 * min(push[i], push[j]) * length[min(i, j)]))
    return [[margin * v[i] * w for w in way[i]] if way[i] else [0.0] * len(speed) for i in range(n)]


def test_junction_velocities_by_force():
    rng = np.random.default_rng(2)
    straight = np.outer(np.arange(30.0), [0.1, 0.2, 0.0])
    still = np.repeat(rng.normal(size=(6, 3)), 3, 0)
    speed, acceleration = np.array([1.0, 2.0, 0.5]), np.array([2.0, 9.0, 1.0])
    for points in (rng.normal(size=(60, 3)).cumsum(0) / 20, straight, still, np.concatenate([straight, straight[::-1]]), straight[:2], straight[:1]):
        found = B.junction_velocities(points, speed, acceleration)
        assert np.allclose(found, junctions_by_force(points.tolist(), speed.tolist(), acceleration.tolist(), 0.25), atol=1e-9)


def test_tip_of_a_planar_arm():
    arm = [K.Joint("a", (0, 0, 0), (0, 0, 0), (0, 0, 1)), K.Joint("b", (0.5, 0, 0), (0, 0, 0), (0, 0, 1)), K.Joint("t", (0.3, 0, 0), (0, 0, 0), None)]
    v = np.array([[0.3, -0.7], [1.0, 2.0]])
    want = [(0.5 * math.cos(a) + 0.3 * math.cos(a + b), 0.5 * math.sin(a) + 0.3 * math.sin(a + b), 0) for a, b in v]
    assert np.allclose(K.tips(arm, v), want)
    assert np.allclose(K.from_euler(0, 0, math.pi / 2) @ [1, 0, 0], [0, 1, 0]) and np.allclose(K.from_euler(math.pi / 2, 0, 0) @ [0, 1, 0], [0, 0, 1])


def test_tip_column_defines_nulls(spark):
    from pyspark.sql import functions as F

    arm = [K.Joint("a", (0, 0, 0), (0, 0, 0), (0, 0, 1)), K.Joint("t", (1.0, 0, 0), (0, 0, math.pi / 2), None), K.Joint("b", (1.0, 0, 0), (0, 0, 0), (0, 1, 0)), K.Joint("e", (0, 0, 2.0), (0, 0, 0), None)]
    rows = spark.createDataFrame([(0, [0.0, 0.0]), (1, None), (2, [math.pi / 2]), (3, [None, math.pi / 2, 9.0])], "i int, q array<double>")
    found = {r.i: r.p for r in rows.select("i", K.tip_position(arm, F.col("q")).alias("p")).collect()}
    assert found[1] is None
    for i, want in ((0, [1, 1, 2]), (2, [-1, 1, 2]), (3, [1, 3, 0])):
        assert np.allclose(found[i], want)


def test_chain_from_urdf(spark, tmp_path):
    from framewright.sources.files import urdf_joints

    (tmp_path / "arm.urdf").write_text('<robot name="r"><joint name="j1" type="revolute"><origin xyz="0 0 1" rpy="0 0 0"/><parent link="base"/><child link="l1"/><axis xyz="0 0 1"/></joint><joint name="j2" type="fixed"><origin xyz="1 0 0" rpy="0 0 0"/><parent link="l1"/><child link="tip"/></joint><joint name="x"/></robot>')
    chain = K.chain_to(urdf_joints(spark, str(tmp_path / "arm.urdf")), "tip")
    assert [j.name for j in chain] == ["j1", "j2"] and chain[1].axis is None
    assert np.allclose(K.tips(chain, np.array([[math.pi / 2]])), [[0, 1, 1]])


def test_greedy_prefix_and_spline():
    path = np.cumsum(np.random.default_rng(1).normal(size=(60, 2)), 0)
    order = B.greedy_order(path, 30)
    assert order[:2] == [0, 59] and len(set(order)) == 30
    worst = []
    for n in (5, 15, 30):
        keys = np.sort(order[:n])
        r = np.stack([np.interp(np.arange(60), keys, path[keys, j]) for j in range(2)], 1)
        worst.append(np.linalg.norm(r - path, axis=1).max())
    assert worst[0] >= worst[1] >= worst[2]
    t = np.linspace(0, 1, 50)[:, None]
    assert np.allclose(B.fit_spline(t**3 - t, 10), t**3 - t, atol=1e-8)
    assert np.allclose(B.spline_basis(np.arange(20.0), np.concatenate([np.zeros(4), [5, 9], np.full(4, 19.0)])).sum(1), 1)


def test_pchip_reconstruction_hits_keypoints(spark):
    from pyspark.sql import functions as F

    q = np.random.default_rng(4).normal(size=30).cumsum()
    frames = spark.createDataFrame([(0, f, [float(x)]) for f, x in enumerate(q)], "episode long, frame long, q array<double>")
    keys = [0, 4, 11, 12, 20, 29]
    placed = spark.createDataFrame([(0, i, float(k)) for i, k in enumerate(keys)], "episode long, i int, position double")
    for how in ("linear", "pchip"):
        r = {x.frame: x.r[0] for x in G.reconstruct(frames, placed, how).select("frame", "r").collect()}
        assert all(abs(r[k] - q[k]) < 1e-9 for k in keys)
        for a, b in zip(keys, keys[1:]):
            assert all(min(q[a], q[b]) - 1e-9 <= r[f] <= max(q[a], q[b]) + 1e-9 for f in range(a, b + 1))
    one = spark.createDataFrame([(0, 0, 5.0)], "episode long, i int, position double")
    assert G.reconstruct(frames, one).where(F.col("frame").isin(0, 29)).where("r = q").count() == 2


def test_stream_equals_batch(spark, tmp_path):
    from framewright.plans import extra_queries, playback_queries

    sf = "/root/testdata/sf0.001"
    key = lambda rows: sorted(map(tuple, rows))
    assert key(extra_queries.streamed_follower(spark, sf).collect()) == key(playback_queries.chunk_follower(spark, sf).collect())


def summed_in_order(folder):
    """DuckDB over the events of a folder, its running sums taken from left to right."""
    import duckdb

    con = duckdb.connect()
    con.execute("SET debug_window_mode='separate'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    return con


def test_ticks_are_the_doubles_of_the_sql(spark):
    """Unrounded: on a tie of decimals the last bit chooses the side, so operations must come in the SQL's order."""
    from framewright.plans import playback_queries as Q

    folder = "/root/testdata/sf0.01"
    sql = f"WITH {Q.S.USERS}, {Q._TICKS} SELECT episode, tau::DOUBLE, q, v FROM pv"
    ours = {(r.chunk, r.tau): (r.q[0], r.v[0]) for r in Q._ticks(spark, folder).collect()}
    theirs = {(e, tau): (q, v) for e, tau, q, v in summed_in_order(folder).execute(sql).fetchall()}
    assert len(ours) > 10000 and {k for k in ours.keys() | theirs.keys() if ours.get(k) != theirs.get(k)} == set()


def test_jumps_are_those_of_the_sql(spark):
    """Ticks and largest jumps bit for bit; DuckDB fuses a product and a sum in its quantiles, which moves the last bit."""
    from framewright.plans import playback_queries as Q

    folder = "/root/testdata/sf0.01"
    sql = f"""WITH {Q.S.USERS}, {Q._TICKS}, j AS (SELECT *, abs(v - lag(v) OVER (PARTITION BY episode ORDER BY tau)) AS jump FROM pv)
        SELECT episode, count(*), max(jump), quantile_cont(jump, 0.99) FROM j GROUP BY episode"""
    ours = {r.chunk: (r.ticks, r.largest, r.p99) for r in B.velocity_jumps(Q._ticks(spark, folder)).collect()}
    theirs = {e: tuple(r) for e, *r in summed_in_order(folder).execute(sql).fetchall()}
    assert len(ours) > 100 and {e: r[:2] for e, r in ours.items()} == {e: r[:2] for e, r in theirs.items()}
    assert all(math.isclose(ours[e][2], theirs[e][2], rel_tol=1e-14) for e in ours)
