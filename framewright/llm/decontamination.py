"""Benchmark decontamination by a prefix-filtered join, with DataFrame operations only.

Every item window is a set of word shingles of length one. Ordered by rarity over the whole corpus, an exact
containment needs the first of them, so a window's prefix is its rarest word. Positions of prefix words in documents
are joined to the windows; the word's offset in the window bounds where the window would start (positional bound),
the document's length where it may end (length bound), and the words in between are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize

#: What separates words: all of ASCII but digits and (lower-cased) letters.
BREAK_CLASS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
WINDOW = 13
#: Item windows handled in one pass over the documents. Windows are dealt by their hash, those of one item as well, so
#: larger benchmarks and items take more passes, and what is broadcast stays bounded. Also the most words looked up.
BLOCK_WORDS = 200_000


def folded_words(text: Column) -> Column:
    """Words of a lower-cased text; none for null."""
    bare = F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAK_CLASS + "+")
    return F.filter(bare, lambda w: w != "")


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, words) of each distinct window; an item shorter than a window is one window, one without words none."""
    words = items.select("item_id", folded_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - window))
    return words.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, window))).alias("words")).distinct()


def _corpus_counts(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, n): how often these words are in the documents, in one scan whatever the size of the benchmark.

    A vocabulary of at most BLOCK_WORDS is looked up before anything is counted; for a larger one, which is neither
    collected nor broadcast, all words are counted, with partial sums before they move.
    """
    found = folded_words(F.col("text"))
    known = [r[0] for r in vocabulary.limit(BLOCK_WORDS + 1).collect()]
    if len(known) <= BLOCK_WORDS:
        found = F.filter(found, lambda w: w.isin(known))
    counts = docs.select(F.explode(found).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts if len(known) <= BLOCK_WORDS else counts.join(vocabulary, "word", "left_semi")


def _signatures(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """Each window with its block, its rarest word `word` and that word's offset `at`.

    Words are ranked by an aggregate of each window, so no task gathers the windows that share a word; the counts of
    at most BLOCK_WORDS words are broadcast, more of them are joined with their frequent words split at run time.
    """
    vocabulary = materialize(windows.select(F.explode("words").alias("word")).distinct(), "vocabulary")
    counts = materialize(_corpus_counts(docs, vocabulary), "counts")
    counts = F.broadcast(counts) if vocabulary.count() <= BLOCK_WORDS else counts
    tokens = windows.select("item_id", "block", "words", F.posexplode("words").alias("at", "word")).join(counts, "word", "left")
    first = tokens.groupBy("item_id", "block", "words").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "at")).alias("first"))
    return materialize(first.where("first.n > 0").select("item_id", "block", "words", "first.word", "first.at"), "signatures")


def benchmark_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, th, n_words, n_hit, n_items, item_ids, contaminated) of every row of docs; th is xxhash64 of the text.

    A word inside any occurrence of an item's window is hit. Contaminated means n_hit > 0 and
    20 * n_hit >= n_words. Null text has no words. Rows that share a doc_id are judged one by one. Items without
    words, and items whose id is null, match nothing. Empty tables on either side are fine, further columns unused.
    """
    items = items.where(F.col("item_id").isNotNull()).select("item_id", "text")
    windows = materialize(item_windows(items, window), "windows")
    total = windows.agg(F.sum(F.size("words"))).first()[0] or 0
    blocks = max(1, -(-total // (window * BLOCK_WORDS)))
    signatures = _signatures(docs.select("text"), windows.withColumn("block", F.pmod(F.xxhash64("words"), F.lit(blocks))))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("th"), "text")
    rows = rows if blocks == 1 else materialize(rows, "rows")  # each pass must see the same row numbers
    hits = None
    for block in range(blocks):
        found = _hits_of(rows, signatures.where(F.col("block") == block), window)
        hits = found if hits is None else hits.unionByName(found)
    spans = F.collect_set(F.when(F.col("item_id").isNotNull(), F.struct("start", "length")))
    by_row = hits.groupBy("row", "doc_id", "th").agg(F.max("n_words").cast("long").alias("n_words"), spans.alias("spans"), F.collect_set(F.col("item_id").cast("string")).alias("ids"))
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1))))
    out = by_row.select("doc_id", "th", "n_words", F.size(covered).cast("long").alias("n_hit"), F.size("ids").cast("long").alias("n_items"), F.array_sort("ids").alias("item_ids"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def _hits_of(rows: DataFrame, signatures: DataFrame, window: int) -> DataFrame:
    """(row, doc_id, th, n_words, item_id, start, length) of each occurrence; a document without any has nulls."""
    prefixes = [r[0] for r in signatures.select("word").distinct().collect()] or [""]
    ids = ["row", "doc_id", "th"]
    words = rows.select(*ids, folded_words(F.col("text")).alias("w"))
    at = F.filter(F.transform("w", lambda w, i: F.struct(i.alias("pos"), w.alias("word"))), lambda x: x["word"].isin(prefixes))
    lead = lambda pos: F.greatest(F.lit(0), pos - (window - 1))
    around = F.transform(at, lambda x: F.struct(x["pos"].alias("pos"), x["word"].alias("word"), F.slice("w", lead(x["pos"]) + 1, 2 * window - 1).alias("context")))
    near = words.select(*ids, F.size("w").alias("n_words"), F.explode_outer(around).alias("c"))
    start, size = F.col("c.pos") - F.col("at"), F.size("words")
    same = F.slice("c.context", start - lead(F.col("c.pos")) + 1, size) == F.col("words")
    fits = (F.col("c.word") == F.col("word")) & (start >= 0) & (start + size <= F.col("n_words"))
    joined = near.join(F.broadcast(signatures), fits & same, "left")
    return joined.select(*ids, "n_words", "item_id", start.alias("start"), size.alias("length"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without its contaminated rows, as benchmark_hits judges them; all columns stay."""
    bad = benchmark_hits(docs, items, window).where("contaminated").select(F.col("doc_id").alias("_doc_id"), F.col("th").alias("_th")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_doc_id"]) & (F.xxhash64(docs["text"]) == bad["_th"]), "left_anti")
