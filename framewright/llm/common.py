"""What the corpus operators share: text splitting, written tables, hot keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space and tab to carriage return.
SPACES = " \t\n\u000b\f\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Keys followed by the frequent-item sketch, how many of them may be called hot, and the rows from which on any is.
TRACKED_KEYS, MOST_HOT_KEYS, MOST_COLD_ROWS = 20_000, 4_000, 20_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on a local master a fresh folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="framewright-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a table into the shared folder and read it back; this cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/tables/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def bucketed(df: DataFrame, keys: list[str], label: str, buckets: int | None = None, lies_so: bool = False) -> DataFrame:
    """materialize(), hash-partitioned and sorted by keys: joins and aggregations by them don't move this side again.

    A table by the same keys and number of buckets (by default the session's number of shuffle partitions) lies alike.
    lies_so: df comes from an aggregation or join by these keys, so its rows need not be moved to be written.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"{label}_{uuid.uuid4().hex}".replace("-", "_")
    path = f"{shared_dir(spark)}/tables/{name}"
    (df if lies_so else df.repartition(buckets, *keys)).write.bucketBy(buckets, *keys).sortBy(*keys).format("parquet").option("path", path).saveAsTable(name)
    out = spark.table(name)
    out.written_to, out.table_name = path, name
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        if hasattr(df, "table_name"):
            spark.sql(f"DROP TABLE IF EXISTS {df.table_name}")
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def words_of(text: Column) -> Column:
    """Words of non-space characters, in order; none for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_CLASS + "+"))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; lower() does just that on pure ASCII, and fast."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def hot_list(df: DataFrame, key: str) -> list:
    """Keys that hold more than 1/2000 of the rows (and 200 rows), or MOST_COLD_ROWS, by a fixed-size frequent-item sketch.

    The result has at most MOST_HOT_KEYS rows, whatever the input, so it may be broadcast. It only routes rows
    between two exact ways of doing the same work: a key that the sketch misses is done the other way.
    """
    row = df.agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k({key}, {MOST_HOT_KEYS}, {TRACKED_KEYS})").alias("top")).first()
    least = min(MOST_COLD_ROWS, max(200, (row["n"] or 0) // 2000))
    return [x["item"] for x in row["top"] or [] if x["count"] >= least and x["item"] is not None]


def hot_keys(df: DataFrame, key: str, found: list | None = None) -> DataFrame:
    """hot_list() as a table, or `found` if that is known."""
    found = hot_list(df, key) if found is None else found
    return df.sparkSession.createDataFrame([(x,) for x in found], f"{key} {df.schema[key].dataType.simpleString()}")


def split_hot(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows of hot keys, and the others."""
    hot = F.broadcast(hot_keys(df, key))
    return df.join(hot, key, "left_semi"), df.join(hot, key, "left_anti")


def tidy(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """f, giving the memory of what it remembered back to the system when a task ends, as workers are used again."""

    def run(batches: Iterator) -> Iterator:
        import ctypes
        import gc

        import pyarrow as pa

        yield from f(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        if hasattr(ctypes.CDLL(None), "malloc_trim"):
            ctypes.CDLL(None).malloc_trim(0)

    return run
