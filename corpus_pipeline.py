"""From raw documents to packed token sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet and reads it back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import materialize
from framewright.llm.decontamination import decontaminate
from framewright.llm.line_dedup import drop_repeated_lines
from framewright.llm.ngram_join import one_of_each
from framewright.llm.packing import pack_documents
from framewright.llm.quality_rules import quality_rules


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, with all their columns; see quality_rules().

    Null and empty texts have no words and go. Rows with a null or repeated doc_id are judged one by one; a null lang adds
    to no reference. An empty table gives an empty table.
    """
    return quality_rules(docs).where("kept").select("doc.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document has; n_chars follows the text; see drop_repeated_lines().

    A text that loses nothing stays as it is, null included. Rows that share a doc_id are one document, and one without
    a doc_id neither loses nor takes lines. An empty table gives an empty table.
    """
    out = drop_repeated_lines(docs)
    text = F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("doc.text"))
    columns = [F.col(f"doc.{c}").alias(c) for c in docs.columns]
    new = {"text": text, "n_chars": F.when(F.col("n_dropped") > 0, F.length("kept_text").cast("long")).otherwise(F.col("doc.n_chars"))}
    return out.select(*(new[c].alias(c) if c in new else x for c, x in zip(docs.columns, columns, strict=True)))


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that of the smallest doc_id; see one_of_each().

    A null doc_id counts as the largest. Texts without words stay, those of equal doc_id and text once. An empty table
    gives an empty table.
    """
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark, with all their columns; see benchmark_hits().

    Null texts, and all texts if the benchmark has no words, are clean. Rows with a null or repeated doc_id are judged
    by their texts. An empty table gives an empty table.
    """
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences; see pack_documents().

    A null text is empty and has one id. Rows with a null or repeated doc_id are packed each by itself. An empty table
    gives no rows.
    """
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


STAGES = [("quality_rules", quality), ("line_dedup", line_dedup), ("ngram_join", ngram_join), ("decontamination", decontamination), ("packing", packing)]

#: Shingle classes and BM25 packing are beyond SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
