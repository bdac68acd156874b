"""Queries beyond the recordings: relational and streaming forms on the other tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import playback as B
from ..sources.files import scratch, shared_folder
from ..streaming import follower as L
from .playback_queries import _chunk_rows

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
    round(avg(l_quantity), 6) AS avg_qty, count(*)::BIGINT AS count_order FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = t(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("date"))
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return x.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 2).alias("sum_disc_price"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.count(F.lit(1)).alias("count_order"))


@query("""SELECT strategy, budget, count(*)::BIGINT AS episodes FROM (VALUES ('time'), ('arc')) s(strategy), (VALUES (20), (40)) b(budget), (SELECT DISTINCT l_suppkey FROM lineitem) e GROUP BY ALL""")
def strategy_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every strategy and budget with every episode: small parameter rows, exploded per episode rather than joined."""
    params = F.array(*(F.struct(F.lit(s).alias("strategy"), F.lit(b).alias("budget")) for s in ("time", "arc") for b in (20, 40)))
    x = t(spark, sf_dir, "lineitem").select("l_suppkey").distinct().select(F.explode(params).alias("p"))
    return x.groupBy("p.strategy", "p.budget").agg(F.count(F.lit(1)).alias("episodes"))


@query("SELECT user_id, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id")
def streamed_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running totals of the events as a stream, drained to its end."""
    path = f"{sf_dir}/events.parquet"
    source = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "*.parquet").parquet(path if _is_folder(spark, path) else sf_dir + "/events*.parquet")
    totals = source.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    out = _drained(spark, totals, "complete")
    return out.select("user_id", "n", F.round("total", 4).alias("total"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def _drained(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """All that a stream gives until it has seen its source, written to the shared folder batch by batch."""
    path = f"{shared_folder(spark)}/drained/{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/{'all' if mode == 'complete' else f'batch-{number}'}")

    running = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    running.awaitTermination()
    if running.exception():
        raise running.exception()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(f"{path}/rows")


def streamed_follower(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk follower as a stateful stream; it gives what the batch form gives."""
    rows = _chunk_rows(spark, sf_dir)
    kept = scratch(rows, "chunk-stream")
    stream = spark.readStream.schema(rows.schema).parquet(kept.inputFiles()[0].rsplit("/", 1)[0])
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out = _drained(spark, L.follow_stream(stream, L.PlaybackConfig(limits=B.Limits(2.0, 20.0, 400.0))), "append")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return out.groupBy("robot").agg(F.count(F.lit(1)).alias("ticks"), F.round(F.max(F.array_max(F.transform("v", lambda v: F.abs(v)))), 4).alias("fastest"))


QUERIES["streamed_follower"] = streamed_follower
