"""SQL of the progress operators over the encodings, for an engine to compare with."""

SUPPLIERS = """
f AS (SELECT l_suppkey AS episode,
        row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) - 1 AS frame,
        l_quantity AS q0, l_extendedprice / 1000 AS q1, l_discount + 0.0 AS q2, l_tax AS q3,
        (l_extendedprice > 89000 AND l_discount + 0.0 >= 0.09) AS on_, l_quantity / 50 > 0.5 AS held
      FROM lineitem)"""
USERS = """
f AS (SELECT user_id AS episode, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame,
        value AS q0, 0.0 AS q1, 0.0 AS q2, 0.0 AS q3, value > 150 AS on_, value > 60 AS held
      FROM events)"""

_E = "OVER (PARTITION BY episode ORDER BY frame)"
_REST = "OVER (PARTITION BY episode ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


def squares(form: str) -> str:
    return "sqrt(" + " + ".join(f"power({form.format(i=i)}, 2)" for i in range(4)) + ")"


def curve(source: str = SUPPLIERS, metric: str = "curvature", approach: int = 15, deadzone: float = 0.0) -> str:
    """CTEs f (frames), g (with edges), w (windows) and c (the curve)."""
    if metric == "curvature":
        bend = squares(f"(lead(q{{i}}) {_E} - q{{i}}) - (q{{i}} - lag(q{{i}}) {_E})")
        raw = f"power((CASE WHEN frame = 0 THEN lead(bend) {_E} ELSE bend END) + 1e-12, 1.0 / 3)"
    else:
        bend, raw = squares(f"lead(q{{i}}) {_E} - q{{i}}"), "bend"
    return f"""{source},
g0 AS (SELECT *, max(frame) OVER (PARTITION BY episode) AS last, lag(on_) {_E} AS was,
        min(CASE WHEN held THEN frame END) {_REST} AS above, min(CASE WHEN NOT held THEN frame END) {_REST} AS below,
        {bend} AS bend FROM f),
g AS (SELECT *, coalesce(on_ AND NOT was, false) AS rise, coalesce(NOT on_ AND was, false) AS fall FROM g0),
g1 AS (SELECT *, rise OR fall AS edge, coalesce((CASE WHEN rise THEN above ELSE below END) - frame, 120) AS measured,
        CASE WHEN frame < last THEN {raw} END AS raw FROM g),
w AS (SELECT episode, CASE WHEN rise THEN 'grasp' ELSE 'release' END AS kind, frame AS onset, measured,
        frame + measured AS sealed, least(frame + least(measured, 120), last) AS end_ FROM g1 WHERE edge),
g2 AS (SELECT *, frame < last AND coalesce(max(CASE WHEN edge THEN least(frame + least(measured, 120), last) END) {_E} > frame, false) AS dwell,
        frame < last AND coalesce(max(edge::INT) OVER (PARTITION BY episode ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND {approach} FOLLOWING) = 1, false) AS near FROM g1),
g3 AS (SELECT *, near AND NOT dwell AS approach, near OR dwell AS event FROM g2),
g4 AS (SELECT *, CASE WHEN event THEN 0.0 WHEN frame < last THEN greatest(raw - {deadzone}, 0.0) END AS free,
        sum((event AND NOT coalesce(prev, false))::INT) {_E} AS island
       FROM (SELECT *, lag(event) {_E} AS prev FROM g3)),
g5 AS (SELECT *, count(*) FILTER (WHERE frame < last AND NOT event AND raw IS NOT NULL) OVER (PARTITION BY episode) AS n_free,
        count(raw) OVER (PARTITION BY episode) AS n, coalesce(sum(free) OVER (PARTITION BY episode), 0) AS total_free,
        CASE WHEN event THEN count(*) OVER (PARTITION BY episode, event, island) END AS run FROM g4),
g6 AS (SELECT *, CASE WHEN n_free <= 0 OR total_free <= 0 THEN greatest(total_free, 1) / greatest(n, 1) ELSE total_free * 4.0 / n_free END AS step FROM g5),
g7 AS (SELECT *, CASE WHEN raw IS NOT NULL THEN CASE WHEN event THEN step * least(32, run) / run ELSE free END END AS ds FROM g6),
c AS (SELECT *, coalesce(sum(ds) OVER (PARTITION BY episode ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s,
        coalesce(sum(ds) OVER (PARTITION BY episode), 0) AS total FROM g7)"""


def _tangent(i: int) -> str:
    end = "CASE WHEN (3 * {a} - {b}) / 2 * {a} <= 0 THEN 0.0 WHEN {a} * {b} < 0 AND abs((3 * {a} - {b}) / 2) > 3 * abs({a}) THEN 3 * {a} ELSE (3 * {a} - {b}) / 2 END"
    first = end.format(a=f"d{i}", b=f"e{i}")
    last = end.format(a=f"b{i}", b=f"a{i}")
    return f"""CASE WHEN last = 0 THEN 0.0 WHEN frame = 0 THEN CASE WHEN e{i} IS NULL THEN d{i} ELSE {first} END
        WHEN d{i} IS NULL THEN CASE WHEN a{i} IS NULL THEN b{i} ELSE {last} END
        WHEN b{i} * d{i} > 0 THEN 2 * b{i} * d{i} / (b{i} + d{i}) ELSE 0.0 END AS m{i}"""


def knots() -> str:
    """CTE k: the curve with tangents and the next knot, after curve()."""
    slope = ", ".join(f"lead(q{i}) {_E} - q{i} AS d{i}" for i in range(4))
    back = ", ".join(f"lag(d{i}) {_E} AS b{i}, lead(d{i}) {_E} AS e{i}" for i in range(4))
    before = ", ".join(f"lag(b{i}) {_E} AS a{i}" for i in range(4))
    tangents = ", ".join(_tangent(i) for i in range(4))
    nexts = ", ".join(f"lead({c}) {_E} AS next_{c}" for c in ["x", "on_", "event", *(f"{a}{i}" for a in "qm" for i in range(4))])
    return f"""
k1 AS (SELECT *, s + frame * greatest(total, 1) * 1e-12 AS x, {slope} FROM c),
k2 AS (SELECT *, {back} FROM k1), k3 AS (SELECT *, {before} FROM k2), k4 AS (SELECT *, {tangents} FROM k3),
k AS (SELECT *, {nexts}, lag(event) {_E} AS before_event FROM k4)"""


def located(targets: str) -> str:
    """CTE p after knots(): for the CTE named by targets (episode, target, ...), t, command, event and q0 to q3."""
    u = "CASE WHEN k.next_x IS NULL THEN 0.0 ELSE (target - k.x) / (k.next_x - k.x) END"
    q = ", ".join(
        f"CASE WHEN next_x IS NULL THEN q{i} ELSE (2*u*u*u - 3*u*u + 1) * q{i} + (u*u*u - 2*u*u + u) * m{i} + (3*u*u - 2*u*u*u) * next_q{i} + (u*u*u - u*u) * next_m{i} END AS v{i}"
        for i in range(4)
    )
    return f"""
p0 AS (SELECT {targets}.*, k.* EXCLUDE (episode), {u} AS u FROM {targets} ASOF JOIN k ON {targets}.episode = k.episode AND {targets}.target >= k.x),
p1 AS (SELECT *, k_frame + u AS t, round_even(k_frame + u, 0) > k_frame AS nearest FROM (SELECT * EXCLUDE (frame), frame AS k_frame FROM p0)),
p AS (SELECT *, CASE WHEN nearest THEN next_on_ ELSE on_ END AS command,
        CASE WHEN k_frame = last THEN before_event WHEN nearest AND k_frame + 1 < last THEN next_event ELSE event END AS at_event, {q} FROM p1)"""
