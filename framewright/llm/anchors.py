"""Content-defined anchors: which long windows of a sequence may occur elsewhere, found from a few of its positions.

Every window of `length` symbols is served by one anchor: the k-gram of least hash in it, the leftmost of equals.
Equal windows have equal anchors at equal offsets, wherever they occur. Consecutive windows with the same anchor form a
block. Blocks are compared first, by the hash of their anchor and of all their symbols; single windows only in blocks
that share an anchor with a different block. So nothing is missed, and a text of n symbols takes about
2n / (length - k) rows instead of n.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucketed, hot_keys, hot_list, tidy

#: Multiplier of the rolling hash (odd, so it has an inverse), that of a span's size, and symbols handled at once.
BASE, SIZED, PIECE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 1 << 20
WORDS_KEPT = 250_000
#: Over how many copies of a hot source its spans are dealt.
SALTS = 16
BLOCK = "row long, d long, a long, b long, s0 int, nw int, off int, rep int"


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of BASE and of its inverse modulo 2**64."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 1 << 16)
            inverse = pow(BASE, -1, 1 << 64)
            cls.up, cls.down = (np.cumprod(np.append(np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)), dtype=np.uint64) for b in (BASE, inverse))
        return cls.up[:n], cls.down[:n]


class Sums:
    """Hashes of any span of a sequence of 64-bit symbols."""

    def __init__(self, symbols: np.ndarray):
        up, self.down = Powers.of(len(symbols) + 1)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(symbols * up[:-1], dtype=np.uint64)))

    def spans(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        return mix((self.sums[start + size] - self.sums[start]) * self.down[start] + np.uint64(SIZED) * np.asarray(size).astype(np.uint64))

    def every(self, size: int) -> np.ndarray:
        """Hashes of all spans of one size."""
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * self.down[:n] + np.uint64(SIZED * size % (1 << 64)))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def blocks_of(symbols: np.ndarray, length: int, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(a, b, s0, nw, off, rep) of the blocks: hashes of anchor and block, first window, number of windows, anchor's
    offset, and how often the block comes in a row. Where a text repeats itself, equal blocks follow each other; they
    make one row, or a page of one word would make a hot key of its own."""
    low = np.uint64((1 << 24) - 1)
    for at in range(0, max(0, len(symbols) - length + 1), PIECE):
        sums = Sums(symbols[at : at + PIECE + length - 1])
        grams = sums.every(k)
        anchor = (sliding_min((grams & ~low) | np.arange(len(grams), dtype=np.uint64), length - k + 1) & low).astype(np.int64)
        s0 = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        nw = np.diff(np.append(s0, len(anchor)))
        off = anchor[s0] - s0
        b = mix(sums.spans(s0, nw + length - 1) ^ (off.astype(np.uint64) * np.uint64(BASE)))
        a = grams[anchor[s0]]
        new = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (nw[1:] != nw[:-1]) | (off[1:] != off[:-1]))))
        yield a[new], b[new], s0[new] + at, nw[new], off[new], np.diff(np.append(new, len(a)))


class WordHashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= WORDS_KEPT:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found

    def symbols(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def byte_symbols() -> np.ndarray:
    """A 64-bit symbol for each byte."""
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


def _columns(schema: str, columns: list) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    names = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, names, strict=True)], names=[n for n, _ in names])


def numbered(docs: DataFrame, last: int | None = None, base: int = 0, **more: Column) -> DataFrame:
    """(row, doc_id, d, size, more, z), written and bucketed by row: a number from base on for each row of docs, its
    doc_id, that with null as last (or 0), its text's bytes, longs, and the text compressed (null for null).

    Rows are known by their numbers from here on, so equal or null doc_ids and equal texts can't be mistaken.
    """

    names = ["row", "doc_id", "d", "size", *more]

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                z = [None if t is None else press.compress(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(z, pa.binary())], names=[*names, "z"])

    d = F.coalesce(F.col("doc_id").cast("long"), F.lit(last or 0).cast("long"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    out = docs.select((F.monotonically_increasing_id() + base).alias("row"), "doc_id", d.alias("d"), size.alias("size"), *(c.alias(n) for n, c in more.items()), F.col("text").cast("binary").alias("text"))
    schema = f"row long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, d long, size long, {''.join(f'{n} long, ' for n in more)}z binary"
    return bucketed(out.mapInArrow(tidy(squeeze), schema), ["row"], "texts")


def block_rows(docs: DataFrame, length: int, k: int, words: bool) -> DataFrame:
    """BLOCK rows of numbered documents; symbols are words or bytes."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        loose, hashes, table = zstandard.ZstdDecompressor(), WordHashes(), byte_symbols()
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                found: list[list[np.ndarray]] = [[] for _ in range(8)]
                for row, d, z in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    text = loose.decompress(z)
                    symbols = hashes.symbols(text.split()) if words else table[np.frombuffer(text, np.uint8)]
                    for a, b, *rest in blocks_of(symbols, length, k):
                        for column, x in zip(found, (np.full(len(a), row), np.full(len(a), d), a.view(np.int64), b.view(np.int64), *rest), strict=True):
                            column.append(x)
                if found[0]:
                    yield _columns(BLOCK, [np.concatenate(c) for c in found])

    least = F.col("size") >= (2 * length - 1 if words else length)
    return docs.where(least).select("row", "d", "z").mapInArrow(tidy(find), BLOCK)


MARK = "row long, s0 int, nw int, rep int, src long, src0 int"
SPAN = "row long, start int, size int, rep int, step int, src long, src_start int"
CLAIM = "row long, start int, size int, rep int, step int, body binary"


def spans_of(marks: DataFrame, length: int) -> DataFrame:
    """SPAN rows from MARK rows, neighbours that continue each other at the same source merged.

    A mark says that the nw windows of a row from s0 on, and that again rep times in a row, are those of src from src0
    on. A span is the symbols under them: size symbols from start on, repeated rep times every step symbols.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            row, s0, nw, rep, src, src0 = (np.asarray(c) for c in batch.columns)
            on = (row[1:] == row[:-1]) & (src[1:] == src[:-1]) & (s0[1:] - src0[1:] == s0[:-1] - src0[:-1]) & (s0[1:] <= s0[:-1] + nw[:-1] + length - 1)
            on &= (rep[1:] == 1) & (rep[:-1] == 1)
            first = np.flatnonzero(np.concatenate(([True], ~on)))
            last = np.append(first[1:], len(row)) - 1
            yield _columns(SPAN, [row[first], s0[first], s0[last] + nw[last] + length - 1 - s0[first], rep[first], nw[first], src[first], src0[first]])

    return marks.repartition("row").sortWithinPartitions("row", "s0").select(*(x.split()[0] for x in MARK.split(", "))).mapInArrow(merge, SPAN)


def _cut(z: bytes, words: bool):
    """A function from (start, size) to that part of a compressed text: bytes, or words joined by a space."""
    import zstandard

    text = zstandard.ZstdDecompressor().decompress(z)
    if not words:
        return lambda start, size: text[start : start + size]
    split = text.split()
    return lambda start, size: b" ".join(split[start : start + size])


def claims_of(spans: DataFrame, texts: list[DataFrame], words: bool) -> DataFrame:
    """CLAIM rows: each span with what its source has there. Spans with a src below 0 need no proof and get null.

    spans is a written table. Spans move to the tables of texts, which stay where they lie. A hot source, one of many
    spans, is copied SALTS times and its spans are dealt over the copies by their rows.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part = None, None
        for batch in batches:
            for at in range(0, len(batch), 500):
                columns = [c.to_pylist() for c in batch.slice(at, 500).columns]
                body = []
                for src, start, size, z in zip(columns[5], columns[6], columns[2], columns[7], strict=True):
                    if src != known:
                        known, part = src, _cut(z, words)
                    body.append(part(start, size))
                yield _columns(CLAIM, [*columns[:5], body])

    names = [x.split()[0] for x in SPAN.split(", ")]
    proved = spans.where("src >= 0")
    sources = [own.select(F.col("row").alias("src"), "z") for own in texts]
    joined, found = [], hot_list(proved, "src")
    if found:
        hot = F.broadcast(hot_keys(proved, "src", found))
        dealt = proved.join(hot, "src", "left_semi").withColumn("salt", F.pmod(F.hash("row"), F.lit(SALTS)))
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        copies = [own.join(hot, "src", "left_semi").select("src", "z", salts) for own in sources]
        joined.append(dealt.join(reduce(DataFrame.unionByName, copies), ["src", "salt"]).select(*names, "z"))
        proved = proved.join(hot, "src", "left_anti")
    joined += [proved.join(own, "src").select(*names, "z") for own in sources]
    proved = reduce(DataFrame.unionByName, joined).mapInArrow(tidy(cut), CLAIM)
    return proved.unionByName(spans.where("src < 0").select(*names[:5], F.lit(None).cast("binary").alias("body")))


def removed(docs: DataFrame, claims: DataFrame, words: bool) -> DataFrame:
    """(doc_id, n, n_removed, n_spans, kept) of each numbered document: its symbols, those under claims, their maximal
    runs, and what stays. A claim that isn't true, as two passages had equal 64-bit hashes, raises an error.
    """

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 200):
                rows = []
                for doc_id, z, own in zip(*(batch.column(n).slice(at, 200).to_pylist() for n in ("doc_id", "z", "claims")), strict=True):
                    merged: list[list[int]] = []
                    part = _cut(z, words) if any(c["body"] is not None for c in own or []) else None
                    for c in sorted(own or [], key=lambda c: c["start"]):
                        if c["body"] is not None and any(part(c["start"] + i * c["step"], c["size"]) != c["body"] for i in range(c["rep"])):
                            raise ValueError("different passages have equal hashes; use another anchors.BASE")
                        end = c["start"] + (c["rep"] - 1) * c["step"] + c["size"]
                        if merged and c["start"] <= merged[-1][1]:
                            merged[-1][1] = max(end, merged[-1][1])
                        else:
                            merged.append([c["start"], end])
                    kept, n, gone = _without(z, merged, words)
                    rows.append((doc_id, n, gone, len(merged), kept))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field("doc_id").type), *(pa.array(c, pa.int64()) for c in columns[1:4]), pa.array(columns[4], pa.binary())], names=["doc_id", "n", "n_removed", "n_spans", "kept"])

    by_row = claims.groupBy("row").agg(F.collect_list(F.struct("start", "size", "rep", "step", "body")).alias("claims"))
    joined = docs.join(by_row, "row", "left").select("doc_id", "z", "claims")
    return joined.mapInArrow(tidy(remove), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, n_removed long, n_spans long, kept binary")


def _without(z: bytes | None, spans: list[list[int]], words: bool) -> tuple[bytes, int, int]:
    """What is left of a text without these disjoint spans, its symbols, and how many went."""
    import zstandard

    text = b"" if z is None else zstandard.ZstdDecompressor().decompress(z)
    symbols = text.split() if words else text
    edges = [0, *(x for span in spans for x in span), len(symbols)]
    parts = [symbols[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]
    gone = len(symbols) - sum(map(len, parts))
    return (b" ".join(w for p in parts for w in p) if words else b"".join(parts)), len(symbols), gone
