"""Frame tables: one row per (episode, frame) with joints, commands and feedback as vectors.

q: commanded joint targets; measured: joints as measured; commands: one binary command per channel as 0 or 1;
feedback: one level per channel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _frames(rows: DataFrame, episode: str, order: list[str], **columns) -> DataFrame:
    number = F.row_number().over(Window.partitionBy(episode).orderBy(*order)) - 1
    return rows.select(F.col(episode).cast("long").alias("episode"), number.cast("long").alias("frame"), *(c.alias(n) for n, c in columns.items()))


def supplier_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as recordings: a supplier's lines in order of shipping, with one command channel."""
    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    discount = F.col("l_discount") + F.lit(0.0)
    q = F.array("l_quantity", F.col("l_extendedprice") / 1000, discount, "l_tax")
    command = ((F.col("l_extendedprice") > 89000) & (discount >= 0.09)).cast("double")
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"]
    return _frames(x, "l_suppkey", order, q=q, measured=q, commands=F.array(command), feedback=F.array(F.col("l_quantity") / 50))


def user_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as short recordings: a user's events in order of time, one joint, one command channel."""
    x = spark.read.parquet(f"{sf_dir}/events.parquet")
    q = F.array("value")
    return _frames(x, "user_id", ["ts", "event_id"], q=q, measured=q, commands=F.array((F.col("value") > 150).cast("double")), feedback=F.array(F.when(F.col("value") > 60, 1.0).otherwise(0.0)))


def vector_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as recordings of 22 joints: the vectors of a label in order of vec_id."""
    x = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("v", F.col("embedding").cast("array<double>"))
    q = F.slice("v", 1, 22)
    return _frames(x, "label", ["vec_id"], q=q, measured=q, commands=F.array((F.col("v")[22] > 0).cast("double")), feedback=F.array(F.when(F.greatest(F.col("v")[23], F.col("v")[24]) > 0, 1.0).otherwise(0.0)))
