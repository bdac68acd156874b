"""Queries of the corpus operators over documents, labels, conversations, events and pages, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus as C
from ..sources import files as S

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


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").join(t(spark, sf_dir, "labels"), "doc_id", "left")


_LABELLED = "l AS (SELECT d.*, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id))"


@query(f"WITH {_LABELLED} SELECT f AS field, n::BIGINT AS missing FROM (SELECT count(*) FILTER (WHERE lang IS NULL OR lang = '') AS lang, count(*) FILTER (WHERE source IS NULL) AS source, count(*) FILTER (WHERE quality IS NULL) AS quality, count(*) FILTER (WHERE text IS NULL OR text = '') AS text FROM l) UNPIVOT (n FOR f IN (lang, source, quality, text))")
def missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.missing_fields(_labelled(spark, sf_dir), ["lang", "source", "quality", "text"])


@query("SELECT sha256(text) AS title, count(*)::BIGINT AS n FROM documents WHERE text <> '' GROUP BY text HAVING count(*) > 1")
def repeated_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = t(spark, sf_dir, "documents").where("text != ''").select(F.sha2("text", 256).alias("title"))
    return C.repeated(x, "title")


@query(f"WITH {_LABELLED} SELECT coalesce(quality::VARCHAR, 'unknown') AS quality, count(*)::BIGINT AS n FROM l GROUP BY 1")
def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.distribution(_labelled(spark, sf_dir).withColumn("quality", F.col("quality").cast("string")), "quality")


@query("SELECT h AS heading, (SELECT count(*) FROM documents WHERE NOT coalesce(contains(text, h), false))::BIGINT AS missing FROM (VALUES ('the'), ('une'), ('Der '), ('$$$')) v(h)")
def missing_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.missing_headings(t(spark, sf_dir, "documents"), ["the", "une", "Der ", "$$$"])


@query("SELECT doc_id, CASE WHEN l IS NULL THEN 'left' ELSE 'right' END AS side FROM (SELECT doc_id, d.doc_id AS d, l.doc_id AS l FROM documents d FULL JOIN labels l USING (doc_id)) WHERE d IS NULL OR l IS NULL")
def one_sided_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.one_sided(t(spark, sf_dir, "documents"), t(spark, sf_dir, "labels"), "doc_id")


@query(r"SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Z][a-z]{9,}')) AS id FROM (SELECT text FROM documents UNION ALL SELECT text FROM conversations)")
def mentioned_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long capitalised words of documents and conversations, as one set."""
    both = t(spark, sf_dir, "documents").select("text").unionByName(t(spark, sf_dir, "conversations").select("text"))
    return C.mentions(both, "[A-Z][a-z]{9,}")


@query(r"WITH d AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Z][a-z]{9,}')) AS id FROM documents), c AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Z][a-z]{9,}')) AS id FROM conversations) SELECT id, 'left' AS side FROM (SELECT * FROM d EXCEPT SELECT * FROM c) UNION ALL SELECT id, 'right' FROM (SELECT * FROM c EXCEPT SELECT * FROM d)")
def unreferenced_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (C.mentions(t(spark, sf_dir, n), "[A-Z][a-z]{9,}") for n in ("documents", "conversations"))
    return C.one_sided(a, b, "id")


@query(r"SELECT w AS level, coalesce((SELECT sum(len(regexp_extract_all(text, '\| ' || w || ' \|'))) FROM documents), 0)::BIGINT AS n FROM (VALUES ('onhe'), ('heble'), ('stupid')) v(w)")
def level_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.level_counts(t(spark, sf_dir, "documents"), ["onhe", "heble", "stupid"])


@query(r"SELECT doc_id, sha256(trim(regexp_replace(text, '[ \t\n\f\r\x0B]+', ' ', 'g'))) AS digest, length(trim(regexp_replace(text, '[ \t\n\f\r\x0B]+', ' ', 'g')))::BIGINT AS chars FROM documents")
def squeezed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = t(spark, sf_dir, "documents").withColumn("s", C.squeezed(F.col("text")))
    return x.select("doc_id", F.sha2("s", 256).alias("digest"), F.length("s").cast("long").alias("chars"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, TRY_CAST(json_extract_string(props, '$.n') AS BIGINT) AS n FROM events")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of a JSON column, null where absent."""
    p = F.from_json("props", "k string, n bigint")
    return t(spark, sf_dir, "events").select("event_id", p["k"].alias("k"), p["n"].alias("n"))


@query("SELECT doc_id, substr(text, 1, 100) AS head, substr(source, 1, 3) AS kind FROM documents")
def text_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 100).alias("head"), F.substring("source", 1, 3).alias("kind"))


@query("SELECT page_id, regexp_replace(string_split(url, '/')[-1], 'v[0-9]+$', '') AS id, string_split(url, '/')[3] AS host FROM pages")
def ids_of_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "pages").select("page_id", C.paper_id(F.col("url")).alias("id"), F.split("url", "/")[2].alias("host"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y') AS year FROM events")
def date_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts").cast("string")
    return t(spark, sf_dir, "events").select("event_id", F.substring(ts, 1, 10).alias("day"), F.substring(ts, 1, 4).alias("year"))


@query("SELECT doc_id, array_to_string(list_sort(string_split(source, 'r')), ' ') AS words FROM documents")
def inverted_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text from its inverted index: the sorted parts of the source, put at positions."""
    parts = F.array_sort(F.split("source", "r"))
    index = F.map_from_arrays(F.array_distinct(parts), F.transform(F.array_distinct(parts), lambda w: F.transform(F.filter(F.transform(parts, lambda p, i: F.struct(p.alias("w"), i.alias("i"))), lambda x: x["w"] == w), lambda x: x["i"])))
    return t(spark, sf_dir, "documents").select("doc_id", C.from_inverted(index).alias("words"))


@query("SELECT conv_id, turn, text, n::BIGINT AS turns FROM (SELECT conv_id, turn, text, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) WHERE r <= 2")
def first_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top two turns of each conversation."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id")
    x = t(spark, sf_dir, "conversations").withColumn("turns", F.count(F.lit(1)).over(w)).withColumn("r", F.row_number().over(w.orderBy("turn")))
    return x.where("r <= 2").select("conv_id", "turn", "text", "turns")


@query("SELECT doc_id, replace(replace('./' || source || '\\' || doc_id || '.pdf', '\\', '/'), './', '') AS path FROM documents")
def normalised_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("./"), "source", F.lit("\\"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    return t(spark, sf_dir, "documents").select("doc_id", C.same_path(path).alias("path"))


def linked_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations made from document ids, linked; look-around is beyond the other engine."""
    n = F.lpad((F.col("doc_id") % 1000).cast("string"), 3, "0")
    text = F.concat(F.lit("see paper_"), n, F.lit(", [paper_"), n, F.lit("], 2401.0"), F.lpad(n, 4, "0"), F.lit(" and paper_001/002"))
    return t(spark, sf_dir, "documents").select("doc_id", C.linked(text).alias("text"))


@query("SELECT p AS page, count(*)::BIGINT AS lines FROM (SELECT doc_id, i // 5 AS p FROM (SELECT doc_id, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS i FROM documents)) GROUP BY p")
def paged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines per page, after page markers were put before every fifth line."""
    lines = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("i", "text"))
    marks = lines.where("i % 5 = 0").select("doc", (F.col("i") * 2).alias("line"), F.concat(F.lit("=== page "), F.floor(F.col("i") / 5), F.lit(" ===")).alias("text"))
    x = S.paged_lines(lines.select("doc", (F.col("i") * 2 + 1).alias("line"), "text").unionByName(marks))
    return x.groupBy(F.col("page").cast("long").alias("page")).agg(F.count(F.lit(1)).alias("lines"))


QUERIES["linked_texts"] = linked_texts
