"""Queries over files: each writes a table's rows in a format, reads them back by the operator, and answers from that."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus as C
from ..operators import kinematics as K
from ..sources import files as S
from ..sources import recordings as R
from . import progress_sql as SQL

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(spark: SparkSession, label: str) -> str:
    return f"{S.shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


_SUMS = f"WITH {SQL.SUPPLIERS} SELECT episode, count(*)::BIGINT AS frames, round(sum(q0), 4) AS q0, round(sum(q1 * frame), 3) AS moment FROM f GROUP BY episode"


def _sums(frames: DataFrame) -> DataFrame:
    q = F.col("q")
    return frames.groupBy("episode").agg(F.count(F.lit(1)).alias("frames"), F.round(F.sum(q[0]), 4).alias("q0"), F.round(F.sum(q[1] * F.col("frame")), 3).alias("moment"))


@query(_SUMS)
def episode_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Parquet file for each episode, of which only two columns are read."""
    folder = fresh(spark, "episodes")
    S.write_files(S.episode_contents(R.supplier_recordings(spark, sf_dir).select("episode", "frame", "q")), folder)
    return _sums(S.episode_files(spark, folder, ["frame", "q"]))


@query(_SUMS)
def episode_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh(spark, "folders")
    S.write_episodes(R.supplier_recordings(spark, sf_dir).select("episode", "frame", "q"), folder)
    return _sums(spark.read.schema("frame long, q array<double>, episode long").parquet(folder))


@query(_SUMS)
def tarred_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh(spark, "tars")
    contents = S.scratch(S.episode_contents(R.supplier_recordings(spark, sf_dir).select("episode", "frame", "q")), "contents")
    S.write_files(S.tar_contents(contents), folder)
    return _sums(S.tar_episodes(spark, folder, "frame long, q array<double>"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh(spark, "json")
    S.write_json(t(spark, sf_dir, "nation"), folder)
    return S.json_lines(spark, folder).select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("int").alias("n_regionkey"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh(spark, "csv")
    S.write_csv(t(spark, sf_dir, "nation"), folder)
    return spark.read.schema("n_nationkey int, n_name string, n_regionkey int").csv(folder, header=True)


@query("SELECT count(*)::BIGINT AS regions, sum(length(r_name))::BIGINT AS letters FROM region")
def json_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document over several lines: all regions in one list."""
    folder = fresh(spark, "document")
    whole = t(spark, sf_dir, "region").agg(F.array_sort(F.collect_list(F.struct("r_regionkey", "r_name"))).alias("regions"))
    text = F.regexp_replace(F.to_json(F.struct("regions")), ",", ",\n")
    S.write_files(whole.select(F.lit("regions.json").alias("name"), text.alias("content")), folder)
    x = S.json_document(spark, folder).select(F.explode("regions").alias("r"))
    return x.agg(F.count(F.lit(1)).alias("regions"), F.sum(F.length("r.r_name")).alias("letters"))


@query("SELECT o_orderpriority AS priority, 2 * count(*)::BIGINT AS entries FROM orders GROUP BY 1")
def appended_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh(spark, "log")
    for _ in range(2):
        S.append_log(t(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("priority")), folder)
    return S.json_lines(spark, folder).groupBy("priority").agg(F.count(F.lit(1)).alias("entries"))


@query("SELECT 'item_' || item_id || '.md' AS name, sha256('# Item' || chr(10) || text) AS digest FROM benchmark WHERE text IS NOT NULL")
def markdown_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh(spark, "notes")
    items = t(spark, sf_dir, "benchmark").where("text IS NOT NULL")
    S.write_files(items.select(F.concat(F.lit("item_"), F.col("item_id").cast("string"), F.lit(".md")).alias("name"), F.concat(F.lit("# Item\n"), "text").alias("content")), folder)
    return S.markdown_files(spark, folder).select("name", F.sha2("text", 256).alias("digest"))


@query("SELECT 'r' || r_regionkey AS part, count(*)::BIGINT AS files, sum(strlen(n_name))::BIGINT AS bytes FROM nation JOIN region ON n_regionkey = r_regionkey WHERE length(n_name) > 0 GROUP BY 1")
def folder_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh(spark, "sizes")
    x = t(spark, sf_dir, "nation")
    S.write_files(x.select(F.concat(F.lit("r"), "n_regionkey", F.lit("/n"), "n_nationkey").alias("name"), F.col("n_name").alias("content")), folder)
    return S.folder_sizes(spark, folder)


@query("SELECT 'n' || n_nationkey AS file, CASE WHEN n_regionkey = 1 THEN 'empty' ELSE 'missing' END AS problem FROM nation WHERE n_regionkey IN (0, 1)")
def missing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of nations; those of one region are empty, those of another are not written."""
    folder = fresh(spark, "missing")
    x = t(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("name"), F.when(F.col("n_regionkey") == 1, "").otherwise(F.col("n_name")).alias("content"), "n_regionkey")
    S.write_files(x.where("n_regionkey <> 0"), folder)
    return S.missing_files(spark, folder, [r[0] for r in x.select("name").collect()])


@query("SELECT n_nationkey AS joint, 'j' || n_nationkey AS name, n_regionkey / 10.0::DOUBLE AS x FROM nation")
def urdf_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A robot whose joints are the nations in order, read from its description and walked from the tip to the root."""
    folder = fresh(spark, "robot")
    n = F.col("n_nationkey")
    joint = F.concat(F.lit('<joint name="j'), n, F.lit('" type="revolute"><origin xyz="'), F.col("n_regionkey") / 10, F.lit(' 0 0" rpy="0 0 0"/><parent link="l'), n, F.lit('"/><child link="l'), n + 1, F.lit('"/><axis xyz="0 0 1"/></joint>'))
    text = t(spark, sf_dir, "nation").agg(F.concat(F.lit('<robot name="r">'), F.array_join(F.collect_list(joint), ""), F.lit("</robot>")).alias("content"))
    S.write_files(text.select(F.lit("arm.urdf").alias("name"), "content"), folder)
    last = t(spark, sf_dir, "nation").agg(F.max("n_nationkey")).first()[0] + 1
    chain = K.chain_to(S.urdf_joints(spark, folder + "/arm.urdf"), f"l{last}")
    return spark.createDataFrame([(i, j.name, j.offset[0]) for i, j in enumerate(chain)], "joint int, name string, x double")


@query("SELECT doc_id, 'http://x/abs/' || doc_id || 'v2' AS id, doc_id::VARCHAR AS paper, source AS title, lang AS summary FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL")
def feed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An Atom feed of one entry for each document, taken apart again."""
    x = t(spark, sf_dir, "documents").where("source IS NOT NULL AND lang IS NOT NULL")
    feed = F.concat(F.lit("<feed><entry><id>http://x/abs/"), "doc_id", F.lit("v2</id><title>"), "source", F.lit("</title><summary>"), "lang", F.lit("</summary></entry></feed>"))
    e = x.select("doc_id", F.explode(C.entries_of_feed(feed)).alias("e"))
    return e.select("doc_id", "e.id", C.paper_id(F.col("e.id")).alias("paper"), "e.title", "e.summary")


@query("SELECT doc_id, 'W' || doc_id AS id, source AS title, (1900 + doc_id % 100)::INT AS year, lang AS venue, 'b ' || lang || ' b' AS abstract FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL")
def search_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search reply of one work for each document, with its abstract as an inverted index."""
    x = t(spark, sf_dir, "documents").where("source IS NOT NULL AND lang IS NOT NULL")
    work = F.struct(
        F.concat(F.lit("W"), "doc_id").alias("id"), F.col("source").alias("title"), (1900 + F.col("doc_id") % 100).cast("int").alias("publication_year"),
        F.struct(F.struct(F.col("lang").alias("display_name")).alias("source")).alias("primary_location"),
        F.create_map(F.lit("b"), F.array(F.lit(0), F.lit(2)), F.col("lang"), F.array(F.lit(1))).alias("abstract_inverted_index"),
    )
    w = x.select("doc_id", F.explode(C.works_of(F.to_json(F.struct(F.array(work).alias("results"))))).alias("w"))
    return w.select("doc_id", "w.*")
