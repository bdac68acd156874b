"""Incremental substring deduplication over words with a log-structured fingerprint index.

Every window of 50 words is known by the block it lies in (anchors.py): a fingerprint of an anchor and of all words
around it. The index is a list of immutable runs in the shared folder, all bucketed and sorted alike by fingerprint, so
a new batch of documents is merge-joined with them and history is never shuffled again:

- blocks: each fingerprint's first place. A block of the batch that history or a smaller document has goes as a whole.
- anchors: how many blocks an anchor has. Blocks that share an anchor and differ are compared window by window.
- windows: the hashes of such windows, with their first places. A block that was alone at its anchor until now is
  hashed when the first different one comes, from the text that the index keeps.

What hashes say is merged into spans, and each span's words are compared with those of its first place before anything
is removed. A batch then becomes a run of each kind; when there are MOST_RUNS, they are compacted into one before the
next batch is joined, and the old ones are deleted.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import Sums, WordHashes, _columns, block_rows, claims_of, numbered, removed, spans_of
from .common import bucketed, discard, materialize, tidy

LENGTH, GRAM = 50, 10
BATCHES, MOST_RUNS = 3, 2
#: What a null doc_id counts as: no document is larger, and equal ones don't touch each other.
LAST = (1 << 63) - 1
#: The kinds of runs, and the keys by which each is bucketed and sorted.
KINDS = {"blocks": ["b", "a"], "anchors": ["a"], "windows": ["h", "a"]}
WINDOW = "h long, a long, d long, row long, s int"


class FingerprintIndex:
    """The runs of each kind, and the texts of all batches."""

    def __init__(self, spark: SparkSession, length: int = LENGTH, gram: int = GRAM, most_runs: int = MOST_RUNS):
        self.spark, self.length, self.gram, self.most_runs = spark, length, gram, most_runs
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: dict[str, list[DataFrame]] = {kind: [] for kind in KINDS}
        self.texts: list[DataFrame] = []
        self.next_row = 0

    def _merged(self, df: DataFrame, kind: str, column: str) -> DataFrame:
        """df with `old`: the column's values in the runs that have its key, in an array."""
        names = df.columns
        for i, run in enumerate(self.runs[kind]):
            run = run.where("NOT known") if "known" in run.columns else run  # a batch's table also has what was known
            df = df.join(run.select(*KINDS[kind], F.col(column).alias(f"old{i}")), KINDS[kind], "left")
        found = F.array_compact(F.array(*(F.col(f"old{i}") for i in range(len(self.runs[kind]))))) if self.runs[kind] else None
        return df.select(*names, F.lit(None).alias("old") if found is None else found.alias("old"))

    def _first(self, df: DataFrame, kind: str) -> DataFrame:
        """df with src: the place of history, or else the batch's first place if a larger document has the key as well."""
        if not self.runs[kind]:
            return df.withColumns({"known": F.lit(False), "src": F.when(F.col("first.d") < F.col("last_d"), F.col("first"))})
        df = self._merged(df, kind, "first")
        old = F.get("old", F.lit(0))
        return df.withColumns({"known": old.isNotNull(), "src": F.coalesce(old, F.when(F.col("first.d") < F.col("last_d"), F.col("first")))}).drop("old")

    def compact(self) -> None:
        """Merge-join the runs of each kind into one, bucket by bucket and so without moving them, and delete them. A
        fingerprint is in one run, that of its first place; an anchor's numbers of blocks are added up."""
        for kind, keys in KINDS.items():
            merged = None
            for run in self.runs[kind]:
                own = (run.where("NOT known") if "known" in run.columns else run).select(*keys, "first", *(["n"] if kind == "anchors" else []))
                if merged is not None:
                    both = merged.join(own.withColumnsRenamed({"first": "first1", "n": "n1"}), keys, "full_outer")
                    n = [(F.coalesce("n", F.lit(0)) + F.coalesce("n1", F.lit(0))).alias("n")] if kind == "anchors" else []
                    own = both.select(*keys, F.least("first", "first1").alias("first"), *n)
                merged = own
            merged = bucketed(merged, keys, f"compacted-{kind}", self.buckets, lies_so=True)
            discard(*self.runs[kind])
            self.runs[kind] = [merged]

    def ingest(self, docs: DataFrame) -> DataFrame:
        """(doc_id, n, n_removed, n_spans, kept) of a batch of documents, which then belongs to the index.

        Batches come in order of doc_id: a window counts as repeated if a smaller one has it in this batch or before.
        """
        if len(self.runs["blocks"]) >= self.most_runs:
            self.compact()
        texts = numbered(docs, LAST, self.next_row)
        self.next_row = (texts.agg(F.max("row")).first()[0] or self.next_row) + 1
        self.texts.append(texts)
        rows = materialize(block_rows(texts, self.length, self.gram, words=True), "block-rows")
        # One row for each block, summed up before it moves, so no repeated passage meets in one task.
        blocks = rows.groupBy("b", "a").agg(F.min(F.struct("d", "row", "s0", "nw")).alias("first"), F.max("d").alias("last_d"))
        blocks = bucketed(self._first(blocks, "blocks"), KINDS["blocks"], "blocks", self.buckets, lies_so=True)
        anchors = blocks.where("NOT known").groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("first"))
        anchors = bucketed(anchors, KINDS["anchors"], "anchors", self.buckets, lies_so=True)
        mixed, alone = self._mixed(anchors)
        flagged = blocks.select("b", "a", "src", "known").join(mixed.select("a", F.lit(True).alias("mixed")), "a", "left")
        flagged = materialize(flagged.select("b", "a", "src", (~F.col("known") & F.col("mixed").isNotNull()).alias("mixed")).where("src IS NOT NULL OR mixed"), "flagged")
        marks = rows.join(flagged, ["b", "a"])
        covered = F.coalesce(F.col("d") > F.col("src.d"), F.lit(False))
        marks = materialize(marks.select("row", "d", "a", "s0", "nw", "rep", "src", covered.alias("covered")).where("covered OR mixed"), "marks")
        found = marks.where("covered").select("row", "s0", "nw", "rep", F.col("src.row").alias("src"), F.col("src.s0").alias("src0"))
        found = found.unionByName(self._windows(texts, marks.where("NOT covered"), alone))
        spans = materialize(spans_of(found, self.length), "spans")
        claims = materialize(claims_of(spans, self.texts, words=True), "claims")
        self.runs["blocks"].append(blocks)
        self.runs["anchors"].append(anchors)
        discard(rows, mixed, flagged, marks, spans)
        return removed(texts, claims, words=True)

    def _mixed(self, anchors: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """Anchors of new blocks that have another block here or in history; and the blocks of history that were alone."""
        if not self.runs["anchors"]:
            return materialize(anchors.where("n > 1").select("a"), "mixed"), None
        known = self._merged(anchors, "anchors", "n").withColumnRenamed("old", "ns")
        known = self._merged(known, "anchors", "first").select("a", "n", F.aggregate("ns", F.lit(0).cast("long"), lambda a, x: a + x).alias("old_n"), F.get("old", F.lit(0)).alias("lone"))
        mixed = materialize(known.where("n + old_n > 1"), "mixed")
        return mixed, mixed.where("old_n = 1").select("a", "lone.*")

    def _windows(self, texts: DataFrame, marks: DataFrame, alone: DataFrame | None) -> DataFrame:
        """Marks of the repeated windows of blocks that share an anchor with a different one; their hashes become a run."""
        spread = marks.select("row", "d", "a", "s0", (F.col("nw") * F.col("rep")).alias("nw"))
        own = materialize(window_hashes([texts], spread, self.length), "windows")
        late = None if alone is None else materialize(window_hashes(self.texts[:-1], alone.select("row", "d", "a", "s0", "nw"), self.length), "late-windows")
        every = own if late is None else own.unionByName(late)
        firsts = every.groupBy("h", "a").agg(F.min(F.struct("d", "row", "s")).alias("first"), F.max("d").alias("last_d"))
        firsts = bucketed(self._first(firsts, "windows"), KINDS["windows"], "windows", self.buckets, lies_so=True)
        found = own.join(firsts.where("src IS NOT NULL").select("h", "a", "src"), ["h", "a"]).where("d > src.d")
        found = found.select("row", F.col("s").alias("s0"), F.lit(1).alias("nw"), F.lit(1).alias("rep"), F.col("src.row").alias("src"), F.col("src.s").alias("src0"))
        found = materialize(found, "window-marks")
        self.runs["windows"].append(firsts)
        discard(own, *([] if late is None else [late]))
        return found


def window_hashes(texts: list[DataFrame], marks: DataFrame, length: int) -> DataFrame:
    """WINDOW rows: the hash of every window of the marked blocks (row, d, a, s0, nw), with its anchor. The marks move to
    the bucketed texts, which stay where they lie."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        loose, hashes = zstandard.ZstdDecompressor(), WordHashes()
        for batch in batches:
            for row, d, z, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums = Sums(hashes.symbols(loose.decompress(z).split()))
                s0, nw = (np.array([m[k] for m in own], np.int64) for k in ("s0", "nw"))
                a = np.repeat(np.array([m["a"] for m in own], np.int64), nw)
                s = np.repeat(s0 - np.concatenate(([0], np.cumsum(nw)[:-1])), nw) + np.arange(nw.sum())
                h = sums.spans(s, np.full(len(s), length)).view(np.int64)
                yield _columns(WINDOW, [h, a, np.full(len(s), d), np.full(len(s), row), s])

    lists = marks.groupBy("row").agg(F.min("d").alias("d"), F.collect_list(F.struct("a", "s0", "nw")).alias("marks"))
    joined = [own.select("row", "z").join(lists, "row").select("row", "d", "z", "marks") for own in texts]
    return reduce(DataFrame.unionByName, joined).mapInArrow(tidy(find), WINDOW)


def drop_repeated_windows(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, batches: int = BATCHES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of each row of docs, ingested into a new index in batches by doc_id.

    A window is `length` consecutive words of one document. Each word covered by a window whose word sequence also
    starts in a document with a smaller doc_id is removed; windows are judged on the input.

    Null text has no words. A null doc_id counts as the largest. Rows that share a doc_id are one document, in which
    nothing counts as smaller, and give a row each, whatever their texts. An empty table gives an empty table; further
    columns are not read.
    """
    d = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST).cast("long"))
    at = [i / batches for i in range(1, batches)]
    cuts = sorted(set(docs.where(F.col("doc_id").isNotNull()).select(d.alias("d")).stat.approxQuantile("d", at, 0.01))) if at else []
    edges = [None, *map(int, cuts), None]
    index, out = FingerprintIndex(docs.sparkSession, length, gram), None
    for low, high in zip(edges, edges[1:], strict=False):
        found = index.ingest(docs.where((F.lit(True) if low is None else d > low) & (F.lit(True) if high is None else d <= high)))
        out = found if out is None else out.unionByName(found)
    return out.select("doc_id", F.col("n").alias("n_words"), "n_removed", "kept")
