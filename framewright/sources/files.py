"""Files: episode directories and tars, JSON metadata, YAML, Markdown, URDF and page texts; and sinks for them."""

from __future__ import annotations

import io
import tarfile
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; on a local master without one, a fresh folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="framewright-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back."""
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/scratch/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def episode_files(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet files of one episode each, with the number in their name as `episode` and only the columns asked for."""
    x = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "episode_*.parquet").parquet(path)
    number = F.regexp_extract(F.col("_metadata.file_name"), r"episode_(\d+)", 1).cast("long")
    return x.select(number.alias("episode"), *(columns or x.columns))


def write_episodes(frames: DataFrame, path: str) -> None:
    """One directory per episode."""
    frames.repartition("episode").sortWithinPartitions("episode", "frame").write.mode("overwrite").partitionBy("episode").parquet(path)


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Write (name, content) rows as files of a shared folder; returns (name, length), a written table.

    A file is written beside its place and then moved there, so a repeated task replaces it by the same.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        where, path = fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)
        for batch in batches:
            for name, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                where.create_dir(f"{path}/{name}".rpartition("/")[0], recursive=True)
                beside = f"{path}/{name}.{uuid.uuid4().hex}"
                with where.open_output_stream(beside, compression=None) as out:
                    out.write(content)
                where.move(beside, f"{path}/{name}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(c) for c in batch.column(1).to_pylist()], pa.int64())], names=["name", "length"])

    return scratch(files.select("name", F.col("content").cast("binary").alias("content")).mapInArrow(write, "name string, length long"), "written-files")


def episode_contents(frames: DataFrame) -> DataFrame:
    """(name, content): a Parquet file for each episode, its frames in order."""

    def make(rows):
        out = io.BytesIO()
        rows.sort_values("frame").drop(columns="episode").to_parquet(out, index=False)
        import pandas as pd

        return pd.DataFrame({"name": [f"episode_{int(rows['episode'].iloc[0]):06d}.parquet"], "content": [out.getvalue()]})

    return frames.groupBy("episode").applyInPandas(make, "name string, content binary")


def tar_contents(files: DataFrame, per_tar: int = 16) -> DataFrame:
    """(name, content): tars of some per_tar files each, dealt by a hash of the name."""

    def make(rows):
        import pandas as pd

        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w") as tar:
            for r in rows.sort_values("name").itertuples():
                member = tarfile.TarInfo(r.name)
                member.size = len(r.content)
                tar.addfile(member, io.BytesIO(r.content))
        return pd.DataFrame({"name": [f"part-{int(rows['tar'].iloc[0]):05d}.tar"], "content": [out.getvalue()]})

    tars = max(1, -(-files.count() // per_tar))
    return files.withColumn("tar", F.pmod(F.xxhash64("name"), F.lit(tars))).groupBy("tar").applyInPandas(make, "name string, content binary")


def tar_episodes(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of the episode_*.parquet members of tar files, with `episode` from the member's name; one task per tar."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        import pyarrow.parquet as pq

        for batch in batches:
            for content in batch.column("content"):
                with tarfile.open(fileobj=io.BytesIO(content.as_py())) as tar:
                    for m in tar:
                        if found := re.search(r"episode_(\d+)\.parquet$", m.name):
                            rows = pq.read_table(io.BytesIO(tar.extractfile(m).read()))
                            yield from rows.append_column("episode", pa.array([int(found[1])] * len(rows), pa.int64())).to_batches()

    x = spark.read.format("binaryFile").option("pathGlobFilter", "*.tar").load(path).select("content")
    return x.mapInArrow(members, schema + ", episode long")


def json_document(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per line that isn't blank."""
    return spark.read.json(path)


def yaml_list(spark: SparkSession, text: str, key: str, schema: str) -> DataFrame:
    """The list under a key of a YAML document, with the fields of a schema; missing ones are null."""
    import yaml

    names = [f.split()[0] for f in schema.split(", ")]
    rows = [tuple(None if r.get(n) is None else str(r[n]) for n in names) for r in (yaml.safe_load(text) or {}).get(key, [])]
    return spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names)).select(*(F.expr(f"cast({f.split()[0]} as {f.split()[1]})").alias(f.split()[0]) for f in schema.split(", ")))


def markdown_files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(name, text) of Markdown files."""
    x = spark.read.option("recursiveFileLookup", recursive).option("pathGlobFilter", "*.md").text(path, wholetext=True)
    return x.select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))


def urdf_joints(spark: SparkSession, path: str) -> DataFrame:
    """(name, type, parent, child, xyz, rpy, axis) of the joints of a URDF file."""
    schema = "_name string, _type string, parent struct<_link: string>, child struct<_link: string>, origin struct<_xyz: string, _rpy: string>, axis struct<_xyz: string>"
    x = spark.read.format("xml").option("rowTag", "joint").schema(schema).load(path)
    numbers = lambda c: F.transform(F.split(F.trim(F.coalesce(c, F.lit("0 0 0"))), r"\s+"), lambda v: v.cast("double"))
    return x.where("child IS NOT NULL").select(F.col("_name").alias("name"), F.col("_type").alias("type"), F.col("parent._link").alias("parent"), F.col("child._link").alias("child"), numbers(F.col("origin._xyz")).alias("xyz"), numbers(F.col("origin._rpy")).alias("rpy"), F.when(F.col("axis._xyz").isNotNull(), numbers(F.col("axis._xyz"))).alias("axis"))


def paged_lines(lines: DataFrame, marker: str = r"^=+ page (\d+) =+$") -> DataFrame:
    """(doc, line, text) rows with `page`, that of the last page marker at or above a line; markers go."""
    w = Window.partitionBy("doc").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    number = F.regexp_extract("text", marker, 1)
    x = lines.withColumn("page", F.last(F.when(number != "", number.cast("int")), ignorenulls=True).over(w))
    return x.where(number == "")


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(file, length) of all files below a folder, from the file system's own listing; empty files have no splits, so
    a scan would not see them."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    top, found, files = fs.getFileStatus(root).getPath().toString() + "/", [], fs.listFiles(root, True)
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString().removeprefix(top), f.getLen()))
    return spark.createDataFrame(found, "file string, length long")


def folder_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(part, files, bytes) of the top-level parts of a folder."""
    part = F.substring_index("file", "/", 1)
    return listing(spark, path).groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


def missing_files(spark: SparkSession, path: str, wanted: list[str]) -> DataFrame:
    """(file, problem) of the wanted files that a folder lacks or has empty."""
    want = spark.createDataFrame([(w,) for w in wanted], "file string")
    return want.join(listing(spark, path), "file", "left").where("length IS NULL OR length = 0").select("file", F.when(F.col("length").isNull(), "missing").otherwise("empty").alias("problem"))


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
