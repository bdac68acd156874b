"""Line deduplication across documents, with DataFrame operations only.

Hashes of line keys are range-partitioned and sorted within partitions by document and position; a streaming
window keeps the first document of every key. What comes back per document is a keep bitmap, not text.
Keys that the sketch finds hot are aggregated map-side instead, so no key has to fit one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, ascii_lower, materialize, split_hot


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_keys(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """(h1, h2, doc_id, th, pos) of every line whose key is long enough; rows without doc_id give none."""
    # The hash in a step of its own: beside the generator it would be taken anew for every line.
    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("text").alias("th"), "text")
    lines = rows.select("doc_id", "th", F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    key = ascii_lower(F.btrim(F.col("line"), F.lit(SPACES)))
    lines = lines.select("doc_id", "th", "pos", key.alias("key")).where(F.length("key") >= min_chars)
    return lines.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "th", "pos")


def keep_bitmaps(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """(doc_id, th, keep, n_dropped) of the documents that lose lines.

    keep has a bit for each line, 64 to an element, up to the last element from which a line goes.
    """
    keys = materialize(line_keys(docs, min_chars), "line-keys")
    hot, cold = split_hot(keys, "h1")
    least = hot.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"))
    late_hot = hot.join(F.broadcast(least), ["h1", "h2"]).where("doc_id > first")
    in_order = Window.partitionBy("h1", "h2").orderBy("doc_id", "pos")
    late_cold = cold.repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2", "doc_id", "pos").withColumn("first", F.first("doc_id").over(in_order)).where("doc_id > first")
    late = late_hot.select("doc_id", "th", "pos").unionByName(late_cold.select("doc_id", "th", "pos"))
    late = late.select("doc_id", "th", F.expr("cast(pos div 64 as int)").alias("word"), F.expr("shiftleft(1L, pos % 64)").alias("bit"))
    words = late.repartition("doc_id", "th").groupBy("doc_id", "th", "word").agg(F.bit_or("bit").alias("drop"))
    by_row = words.groupBy("doc_id", "th").agg(
        F.collect_list(F.struct("word", F.bitwise_not("drop").alias("bits"))).alias("some"),
        F.max("word").alias("last"),
        F.sum(F.bit_count("drop")).cast("long").alias("n_dropped"),
    )
    # Every element with all bits, then those that lose some, in order: of equal words the latter come last.
    every = F.transform(F.sequence(F.lit(0), F.col("last")), lambda w: F.struct(w.alias("word"), F.lit(False).alias("known"), F.lit(-1).cast("long").alias("bits")))
    some = F.transform("some", lambda s: F.struct(s["word"].alias("word"), F.lit(True).alias("known"), s["bits"].alias("bits")))
    both = by_row.select("doc_id", "th", "n_dropped", F.sort_array(F.concat(every, some)).alias("both"))
    last = F.zip_with("both", F.slice("both", 2, F.size("both")), lambda a, b: F.when(b.isNull() | (a["word"] != b["word"]), a["bits"]))
    return both.select("doc_id", "th", F.filter(last, lambda x: x.isNotNull()).alias("keep"), "n_dropped")


def drop_repeated_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """All columns of docs in the struct `doc`, with n_lines, n_dropped and the remaining text in `kept_text`.

    A line's key is the line without white space at its ends, A-Z lower-cased. A key of at least min_chars code
    points loses its lines in all documents but that with the smallest doc_id, where every copy stays.

    Null or empty text is one empty line. Rows that share a doc_id count as one document and each gives a row of its
    own. A null doc_id neither drops lines nor lets others drop theirs. An empty table gives an empty table.
    Further columns stay inside `doc` and so clash with nothing.
    """
    # Repeated rows have one bitmap between them: it is found by doc_id and the hash of the text.
    maps = keep_bitmaps(docs, min_chars).withColumnsRenamed({"doc_id": "_doc_id", "th": "_th"})
    rows = docs.select(F.struct("*").alias("doc"))
    joined = rows.join(maps, (F.col("doc.doc_id") == F.col("_doc_id")) & (F.xxhash64("doc.text") == F.col("_th")), "left")
    bits = lambda i: F.coalesce(F.get("keep", F.floor(i / 64).cast("int")), F.lit(-1).cast("long"))
    stays = lambda _, i: F.expr("1L") == F.call_function("shiftrightunsigned", bits(i), i % 64).bitwiseAND(F.lit(1).cast("long"))
    kept = F.array_join(F.filter(_lines(F.col("doc.text")), stays), "\n")
    return joined.select(
        "doc",
        F.size(_lines(F.col("doc.text"))).cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        "keep",
        F.when(F.col("keep").isNull(), F.coalesce("doc.text", F.lit(""))).otherwise(kept).alias("kept_text"),
    )
