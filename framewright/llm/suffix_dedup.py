"""Exact substring deduplication with a sampled suffix array.

Every string of LENGTH bytes that also starts elsewhere is removed wherever it occurs. Suffixes are sampled at
content-defined anchors (anchors.py). Suffixes of blocks that share an anchor and differ are sorted: sampled splitters
range-partition them by the tokens at their anchor, each bucket sorts its suffixes by multikey quicksort on 8-byte
digits, and neighbours in order are compared over LENGTH bytes. Equal leading tokens always go to one bucket, so there
is nothing to compare across a boundary; an anchor that is hot is spread over many buckets by the offset of the suffix
to its anchor, which equal suffixes have in common. Blocks with an equal twin need no sorting among each other: one of
them is sorted for all, and the bytes of the others are compared with that one's before they are removed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .anchors import _columns, block_rows, claims_of, mix, numbered, removed, spans_of
from .common import discard, hot_keys, materialize, tidy

LENGTH, GRAM = 200, 32
#: Windows to a slice of a hot anchor's block, and suffixes that a bucket sorts at once (a larger group in parts).
SLICE, SORTED_AT_ONCE = 16, 150_000
FRAGMENT = "lead long, a long, slice int, row long, s0 int, body binary"


def shared_blocks(rows: DataFrame) -> DataFrame:
    """Blocks whose anchor occurs more than once, with src (a block's first place) and flags covered, expand and hot.

    covered: the block has a twin. expand: this is its first place, and its suffixes must be sorted with those of other
    blocks at the anchor. Rows of hot anchors are aggregated map-side and joined back, the others meet in one task per
    anchor.
    """
    keys = F.broadcast(hot_keys(rows, "a"))
    cold, hot = rows.join(keys, "a", "left_anti"), rows.join(keys, "a", "left_semi")
    anchor, block = Window.partitionBy("a"), Window.partitionBy("a", "b")
    place = F.struct("row", "s0")
    cold = cold.repartition("a").select("*", F.sum("rep").over(anchor).alias("n_a"), F.sum("rep").over(block).alias("n_ab"), F.min(place).over(block).alias("src"))
    by_block = materialize(hot.groupBy("a", "b").agg(F.sum("rep").alias("n_ab"), F.min(place).alias("src")), "hot-blocks")
    by_anchor = by_block.groupBy("a").agg(F.sum("n_ab").alias("n_a"))
    hot = hot.join(by_block, ["a", "b"]).join(F.broadcast(by_anchor), "a").withColumn("hot", F.lit(True))
    both = cold.where("n_a > 1").withColumn("hot", F.lit(False)).unionByName(hot.where("n_a > 1"))
    covered, expand = F.col("n_ab") > 1, (place == F.col("src")) & (F.col("n_ab") < F.col("n_a"))
    return both.select("row", "a", "s0", "nw", "off", "rep", "src", covered.alias("covered"), expand.alias("expand"), "hot").where("covered or expand")


def fragments(texts: DataFrame, marks: DataFrame, length: int) -> DataFrame:
    """FRAGMENT rows: the bytes under the windows of blocks to expand, keyed by the tokens at their anchor."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        loose = zstandard.ZstdDecompressor()
        for batch in batches:
            for row, z, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text, rows = loose.decompress(z), []
                for m in own:
                    at = m["s0"] + m["off"]
                    lead = int.from_bytes(text[at : at + 8].ljust(8, b"\0"), "big", signed=True)
                    start, end = m["s0"], m["s0"] + m["nw"]
                    while start < end:
                        # slices are counted back from the anchor, so equal windows are in equal slices
                        piece = (at - start) // SLICE if m["hot"] else 0
                        stop = min(end, at - piece * SLICE + 1) if m["hot"] else end
                        rows.append((lead, m["a"], piece, row, start, text[start : stop + length - 1]))
                        start = stop
                yield _columns(FRAGMENT, list(zip(*rows, strict=True)))

    lists = marks.where("expand").groupBy("row").agg(F.collect_list(F.struct("a", "s0", "nw", "off", "hot")).alias("marks"))
    return texts.select("row", "z").join(lists, "row").select("row", "z", "marks").mapInArrow(tidy(cut), FRAGMENT)


def equal_suffixes(bodies: list[bytes], group: np.ndarray, length: int) -> list[np.ndarray]:
    """For each body the offsets whose next `length` bytes also start at another place of its group.

    Many suffixes are sorted in parts of about SORTED_AT_ONCE, or one large group takes an executor's memory: a hash of
    their first and last 8 bytes deals them, so equal suffixes are in one part.
    """
    size = np.fromiter(map(len, bodies), np.int64, len(bodies))
    starts = np.concatenate(([0], np.cumsum(size)[:-1]))
    eights = np.lib.stride_tricks.sliding_window_view(np.frombuffer(b"".join(bodies) + b"\0" * 8, np.uint8), 8)
    windows = size - length + 1
    first, total = np.cumsum(windows) - windows, int(windows.sum())

    def digits(place: np.ndarray) -> np.ndarray:
        return eights[place].view(">u8").ravel().astype(np.uint64)

    def places(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        body = np.searchsorted(first, numbers, side="right") - 1
        return numbers + (starts - first)[body], group[body]

    parts = min(max(1, total // SORTED_AT_ONCE), 1 << 16)
    dealt = []
    for at in range(0, total, SORTED_AT_ONCE) if parts > 1 else ():
        place, _ = places(np.arange(at, min(at + SORTED_AT_ONCE, total)))
        dealt.append((mix(digits(place) + mix(digits(place + length - 8))) % np.uint64(parts)).astype(np.uint16))
    if dealt:
        part = np.concatenate(dealt)
        numbers = np.split(np.argsort(part, kind="stable"), np.cumsum(np.bincount(part, minlength=parts))[:-1])
    else:
        numbers = [np.arange(total)]
    equal = [place for own in numbers for place in _sorted_equal(*places(own), digits, length)]
    place = np.sort(np.concatenate(equal)) if equal else np.empty(0, np.int64)
    body = np.searchsorted(starts, place, side="right") - 1
    cuts = np.searchsorted(body, np.arange(1, len(bodies)))
    return [p - s for p, s in zip(np.split(place, cuts), starts, strict=True)]


def _sorted_equal(place: np.ndarray, segment: np.ndarray, digits: Callable[[np.ndarray], np.ndarray], length: int) -> Iterator[np.ndarray]:
    """Those of the places whose suffix has an equal one in its segment.

    Multikey quicksort with digits of 8 bytes, all segments of a round at once: a segment is parted in three by the
    digit of its middle element, the middle part goes on to the next digit, and a suffix that is left alone is in its
    place and has no equal. The segments that come to the end of `length` bytes hold equal suffixes.
    """
    depth = np.zeros(len(place), np.int64)
    while len(place):
        new = np.concatenate(([True], segment[1:] != segment[:-1]))
        alone = new & np.append(new[1:], True)
        done = ~alone & (depth >= length)
        yield place[done]
        place, segment, depth = (x[~(alone | done)] for x in (place, segment, depth))
        if not len(place):
            break
        first = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
        count = np.diff(np.append(first, len(place)))
        digit = digits(place + np.minimum(depth, length - 8))
        pivot = np.repeat(digit[first + count // 2], count)
        side = 1 + (digit > pivot).astype(np.int64) - (digit < pivot)
        segment = 3 * np.repeat(np.arange(len(first)), count) + side
        depth = depth + 8 * (side == 1)
        order = np.argsort(segment, kind="stable")
        place, segment, depth = place[order], segment[order], depth[order]


def runs(offsets: np.ndarray, length: int) -> list[tuple[int, int]]:
    """The merged spans [from, to) of windows that start at sorted offsets."""
    if not len(offsets):
        return []
    cut = np.flatnonzero(np.diff(offsets) > length)
    return list(zip(offsets[np.append(0, cut + 1)].tolist(), (offsets[np.append(cut, len(offsets) - 1)] + length).tolist(), strict=True))


def sorted_buckets(pieces: DataFrame, length: int) -> DataFrame:
    """(row, start, size) of repeated spans, from FRAGMENT rows."""
    found = "row long, start int, size int"

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows: list[tuple]) -> pa.RecordBatch:
            new = [i == 0 or rows[i][:3] != rows[i - 1][:3] for i in range(len(rows))]
            equal = equal_suffixes([r[5] for r in rows], np.cumsum(new), length)
            out = [(r[3], r[4] + a, b - a) for r, offsets in zip(rows, equal, strict=True) for a, b in runs(offsets, length)]
            return _columns(found, list(zip(*out, strict=True)) or [[]] * 3)

        held: list[tuple] = []
        weight = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if weight > SORTED_AT_ONCE and held and row[:3] != held[-1][:3]:
                    yield flush(held)
                    held, weight = [], 0
                held.append(row)
                weight += len(row[5]) - length + 1
        if held:
            yield flush(held)

    order = ["lead", "a", "slice"]
    return pieces.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(tidy(sort), found)


def drop_repeated_substrings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of each row of docs.

    Texts are UTF-8 bytes (null: empty). Every byte covered by a string of `length` bytes that also starts at any other
    place, the same document included, is removed; strings are judged on the input, matches never cross documents.
    Repeated rows are places of their own, so each loses what the other holds. Rows with a null or repeated doc_id are
    documents like any other, known by a row number. An empty table gives an empty table; further columns are not read.
    """
    texts = numbered(docs)
    blocks = materialize(block_rows(texts, length, gram, words=False).drop("d"), "blocks")
    marks = materialize(shared_blocks(blocks), "marks")
    discard(blocks)
    pieces = materialize(fragments(texts, marks, length), "suffixes")
    repeated = materialize(sorted_buckets(pieces, length), "repeated")
    discard(pieces)
    twins = F.col("covered") & ((F.struct("row", "s0") != F.col("src")) | (F.col("rep") > 1))
    # The first of equal blocks is its own source, which needs no proof once the others are held against it.
    src = F.when(twins, F.col("src.row")).otherwise(F.lit(-1).cast("long"))
    whole = marks.where("covered").select("row", "s0", "nw", "rep", src.alias("src"), F.when(twins, F.col("src.s0")).otherwise(F.col("s0")).alias("src0"))
    spans = materialize(spans_of(whole, length), "spans")
    sorted_spans = repeated.select("row", "start", "size", F.lit(1).alias("rep"), F.lit(1).alias("step"), F.lit(-1).cast("long").alias("src"), F.col("start").alias("src_start"))
    claims = materialize(claims_of(spans.unionByName(sorted_spans), [texts], words=False), "claims")
    discard(marks, spans, repeated)
    return removed(texts, claims, words=False).withColumnRenamed("n", "n_bytes")
