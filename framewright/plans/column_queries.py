"""Queries of the column operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import columns as C
from ..operators import dataset as D
from ..sources import recordings as R
from . import progress_sql as S
from .dataset_queries import r6
from .progress_queries import curve

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_NAMES = [(0, "arm_left_joint1"), (1, "arm_right_joint1"), (2, "suction_left"), (3, "body_pitch")]


@query(f"""WITH {S.SUPPLIERS}, s AS ({" UNION ALL ".join(f"SELECT {i} AS dim, max(q{i}) - min(q{i}) AS span FROM f" for i in range(4))}),
    n(dim, name, short) AS (VALUES (0, 'arm_left_joint1', 'L_joint1'), (1, 'arm_right_joint1', 'R_joint1'), (3, 'body_pitch', 'body_pitch'))
    SELECT short, round(span, 6) AS span FROM s JOIN n USING (dim)""")
def joint_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of the joints, without end effectors, under short names."""
    names = C.of_class(spark.createDataFrame(_NAMES, "dim int, name string"), "joints")
    s = D.dim_stats(R.supplier_recordings(spark, sf_dir)).join(F.broadcast(names), "dim")
    return s.select(C.short_name(F.col("name"), {"arm_left_": "L_", "arm_right_": "R_"}).alias("short"), F.round(F.col("max") - F.col("min"), 6).alias("span"))


@query("""SELECT o_orderkey AS episode, l.n AS expected, o.n AS found FROM (SELECT l_orderkey AS k, count(*)::BIGINT AS n FROM lineitem GROUP BY 1) l
    FULL JOIN (SELECT o_orderkey, o_orderkey AS k, 4::BIGINT AS n FROM orders) o USING (k) WHERE l.n IS DISTINCT FROM o.n AND o_orderkey IS NOT NULL""")
def count_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose lines aren't four."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("episode")).agg(F.count(F.lit(1)).alias("n"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("episode"), F.lit(4).cast("long").alias("n"))
    return C.count_mismatches(lines, orders).where("found IS NOT NULL")


@query(f"""WITH {S.curve()} SELECT CASE WHEN dwell THEN 'dwell' WHEN approach THEN 'approach' ELSE 'free' END AS phase, count(*)::BIGINT AS n,
    round(min(ds / step), 6) AS least, round(avg(ds / step), 6) AS mean, round(max(ds / step), 6) AS most FROM c WHERE ds IS NOT NULL GROUP BY 1""")
def step_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.step_profile(curve(spark, sf_dir)).select("phase", "n", *r6("least", "mean", "most"))


@query(f"""WITH {S.USERS}, t AS (SELECT episode, frame, abs(lead(q0) {S._E} - q0) AS d, (lead(frame) {S._E} // 2 - frame // 2) / 30 AS dt FROM f)
    SELECT episode, frame::BIGINT AS frame, round(d / dt, 4) AS speed FROM t WHERE dt > 1e-9""")
def sample_speeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speeds where time goes on every other frame only."""
    x = R.user_recordings(spark, sf_dir).withColumn("t", F.floor(F.col("frame") / 2) / 30)
    return C.speeds(x).withColumn("speed", F.round("speed", 4))


@query(f"""WITH {S.SUPPLIERS}, e AS (SELECT episode, max(frame) AS last FROM f GROUP BY episode), g AS (SELECT episode, last, unnest(generate_series(0, 59)) AS i FROM e),
    n AS (SELECT *, lead(q0) {S._E} AS n0, lead(q1) {S._E} AS n1, lead(q2) {S._E} AS n2, lead(q3) {S._E} AS n3 FROM f),
    p AS (SELECT g.episode, i, {", ".join(f"coalesce(q{j} + (n{j} - q{j}) * (i * last / 59 - frame), q{j}) AS p{j}" for j in range(4))} FROM g JOIN n ON g.episode = n.episode AND frame = floor(i * last / 59)),
    d AS (SELECT {S.squares("p{i} - lag(p{i}) OVER (PARTITION BY episode ORDER BY i)")} AS d FROM p)
    SELECT 'time' AS rule, count(d)::BIGINT AS n, round(avg(d), 5) AS mean, round(stddev_pop(d) / avg(d), 5) AS cv FROM d""")
def placement_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spacing of 60 rows per episode at equal time."""
    p = C.at_fractions(R.supplier_recordings(spark, sf_dir), 60).withColumn("rule", F.lit("time"))
    return C.spacing(p).select("rule", "n", F.round("mean", 5).alias("mean"), F.round("cv", 5).alias("cv"))


@query("SELECT n_nationkey AS key, 'b' AS kind, n_name AS name, NULL::DOUBLE AS weight FROM nation")
def optional_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings merged, and columns taken where there are any."""
    x = spark.read.parquet(f"{sf_dir}/nation.parquet")
    kind = C.merged_settings(F.create_map(F.lit("kind"), F.lit("a"), F.lit("x"), F.lit("y")), F.create_map(F.lit("kind"), F.lit("b")))
    x = x.select(F.col("n_nationkey").alias("key"), kind["kind"].alias("kind"), F.col("n_name").alias("name"))
    return C.with_optional(x, {"key": "int", "kind": "string", "name": "string", "weight": "double"})
