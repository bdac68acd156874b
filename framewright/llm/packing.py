"""Packing by lexical retrieval: a sharded BM25 index fills each document's last window with unused neighbours.

Texts are encoded once into a table of ids; document frequencies and the mean length are counted over all of it.
A shard is a run of rows of one partition, of a bounded number of documents and tokens, so nothing is shuffled, and
retrieval doesn't reach beyond it. Within a shard an inverted index over token ids is built; each seed document fills windows of its own, and its last
window takes unused neighbours in order of BM25 score over all terms of the seed, and rows in file order only when no
unused document of the shard scores above zero. The neighbour that doesn't fit is cut, and its rest seeds the
next window. What remains at the end of a shard is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, tidy

WINDOW = 1024
SHARD_DOCS, SHARD_TOKENS = 2048, 2_000_000
#: BM25's constants, and the share of a shard's documents from which on a term's weights are held as a dense row.
K1, B, COMMON = 1.2, 0.75, 0.05

# The byte-to-character table and the word pattern of byte-level BPE, in the possessive form that tiktoken
# publishes for it, which splits alike without backtracking.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


class Encoder:
    """Ids of a byte-level BPE as its tokenizers file gives them without added special tokens.

    The same merges run in tiktoken, which is some times as fast; texts that hold the string of an added token go to
    tokenizers itself.
    """

    def __init__(self, file: str):
        import tiktoken

        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        self.file, self.library = file, None
        self.added = [x["content"] for x in spec.get("added_tokens", [])]
        others = [b for b in range(256) if b not in set(PRINTABLE)]
        byte_of = {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(others)}
        ranks = {bytes(byte_of[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in self.added}
        self.fast = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if any(a in text for a in self.added):
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_file(self.file)
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4")


@dataclass
class Statistics:
    """Documents, their mean length, and in how many of them each id is (terms ascending)."""

    n: int
    mean: float
    terms: np.ndarray
    df: np.ndarray


class Shard:
    """BM25 over the documents of one shard, by the statistics of all documents; without any, by its own."""

    def __init__(self, docs: list[np.ndarray], known: Statistics | None = None):
        n = len(docs)
        found = [np.unique(d, return_counts=True) for d in docs]
        sizes = np.array([len(t) for t, _ in found])
        terms, owner = np.concatenate([t for t, _ in found]), np.repeat(np.arange(n), sizes)
        tf = np.concatenate([c for _, c in found]).astype(np.float32)
        length = np.array([len(d) for d in docs], np.float32)
        order = np.argsort(terms, kind="stable")
        self.vocabulary, self.first = np.unique(terms[order], return_index=True)
        self.first = np.append(self.first, len(terms))
        if known is None:
            known = Statistics(n, float(length.mean()), self.vocabulary, np.diff(self.first))
        df = known.df[np.searchsorted(known.terms, self.vocabulary)]
        idf = np.log(1 + (known.n - df + 0.5) / (df + 0.5)).astype(np.float32)
        slot = np.searchsorted(self.vocabulary, terms)
        weight = idf[slot] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[owner] / np.float32(known.mean)))
        self.owner, self.weight = owner[order], weight[order]
        # terms of many documents as dense rows, as adding rows is much faster than counting up their postings
        many = np.flatnonzero(np.diff(self.first) > COMMON * n)
        self.row = np.full(len(self.vocabulary), -1)
        self.row[many] = np.arange(len(many))
        self.dense, self.columns = np.zeros((len(many), n), np.float32), np.arange(n)
        at = self.row[slot[order]]
        self.dense[at[at >= 0], self.owner[at >= 0]] = self.weight[at >= 0]
        ends = np.cumsum(sizes)
        self.queries = [slot[a:b] for a, b in zip(ends - sizes, ends, strict=True)]
        self.unused = np.ones(n, bool)

    def neighbours(self, seed: int) -> np.ndarray:
        """Unused documents that share any term with the seed, best first, ties by position."""
        return np.fromiter(best_first(*self.scores(seed)), np.int64)

    def scores(self, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Those documents in order of position, and their scores."""
        left = self.unused[self.columns]
        if 4 * left.sum() < 3 * len(left):  # columns of used documents go
            self.dense, self.columns = np.compress(left, self.dense, 1), self.columns[left]
        row = self.row[self.queries[seed]]
        score = np.zeros(len(self.unused))
        score[self.columns] = np.add.reduce(self.dense[row[row >= 0]], 0)
        if spans := [slice(self.first[t], self.first[t + 1]) for t in self.queries[seed][row < 0]]:
            score += np.bincount(np.concatenate([self.owner[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), len(score))
        found = np.flatnonzero((score > 0) & self.unused)
        return found, score[found]


def best_first(found: np.ndarray, score: np.ndarray) -> Iterator[int]:
    """All of found by score, the best first, ties in their order. Sorted piece by piece, as a window asks for few."""
    size = 16
    while len(found) > size:
        top = score >= np.partition(score, -size)[-size]
        yield from found[top][np.argsort(-score[top], kind="stable")].tolist()
        found, score, size = found[~top], score[~top], 4 * size
    yield from found[np.argsort(-score, kind="stable")].tolist()


def pack_shard(docs: list[np.ndarray], known: Statistics | None = None) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length); all but the last few hold WINDOW ids."""
    shard, lengths = Shard(docs, known), [len(d) for d in docs]
    sequences: list[list[tuple[int, int, int]]] = []
    window: list[tuple[int, int, int]] = []
    room, fresh, upcoming = WINDOW, 0, iter(())
    while True:
        # the next document: the best unused neighbour of the window's seed, or the next unused one
        doc = next((d for d in upcoming if shard.unused[d]), None)
        if doc is None:
            while fresh < len(docs) and not shard.unused[fresh]:
                fresh += 1
            if fresh == len(docs):
                break
            doc = fresh
        shard.unused[doc] = False
        start = 0
        while start < lengths[doc]:
            if room == WINDOW:  # this document seeds the window
                upcoming = iter(()) if lengths[doc] - start >= WINDOW else best_first(*shard.scores(doc))
            size = min(room, lengths[doc] - start)
            window.append((doc, start, size))
            start, room = start + size, room - size
            if not room:
                sequences.append(window)
                window, room = [], WINDOW
    left = WINDOW - room
    while left:  # the rest, in powers of two
        size = 1 << (left.bit_length() - 1)
        part, left = [], left - size
        while size:
            doc, start, length = window.pop(0)
            take = min(size, length)
            part.append((doc, start, take))
            size -= take
            if take < length:
                window.insert(0, (doc, start + take, length - take))
        sequences.append(part)
    return sequences


ENCODED = "doc_id long, wide boolean, ids binary"


def encoded(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """ENCODED of each row of docs: the ids of its text and then end_id, in four bytes each if wide, or else in two."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                tokens = [np.append(encoder.ids(text.as_py() or ""), np.uint32(end_id)) for text in part.column("text")]
                wide = [bool(own.max() >= 1 << 16) for own in tokens]
                ids = [own.astype("<u4" if w else "<u2").tobytes() for own, w in zip(tokens, wide, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(wide, pa.bool_()), pa.array(ids, pa.binary())], names=["doc_id", "wide", "ids"])

    return docs.select("doc_id", "text").mapInArrow(tidy(encode), ENCODED)


def decoded(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for wide, ids in zip(batch.column("wide").to_pylist(), batch.column("ids"), strict=True):
        yield np.frombuffer(ids.as_buffer(), "<u4" if wide else "<u2")


def distinct(ids: np.ndarray) -> np.ndarray:
    """The different ids, ascending. Two-byte ids stay so, as they sort several times as fast."""
    ids = np.sort(ids)
    return ids[np.append(True, ids[1:] != ids[:-1])]


def statistics(rows: DataFrame) -> Statistics:
    """Those of all ENCODED rows; what comes to the driver is a row for each id of the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, total = np.zeros(0, np.int64), 0, 0
        for batch in batches:
            docs = list(decoded(batch))
            n, total = n + len(docs), total + sum(map(len, docs))
            own = [distinct(d) for d in docs]
            if own:
                new = np.bincount(np.concatenate(own), minlength=len(df))
                new[: len(df)] += df
                df = new
        terms = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append([-2, -1], terms), pa.int64()), pa.array(np.append([n, total], df[terms]), pa.int64())], names=["term", "n"])

    found = rows.mapInArrow(tidy(count), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).orderBy("term").collect()
    n, total = (next((r["n"] for r in found if r["term"] == x), 0) for x in (-2, -1))
    terms = [r for r in found if r["term"] >= 0]
    return Statistics(n, total / max(1, n), np.array([r["term"] for r in terms], np.int64), np.array([r["n"] for r in terms], np.int64))


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are those of its text and then end_id; null text is empty, so it has one id. Each id is in one
    piece, and a sequence's pieces follow without gaps. Sequences hold 1024 ids or a power of two. Rows with a null or
    repeated doc_id are packed like any other, each row by itself. An empty table gives no rows. Other columns are not
    read. sequence_id holds the number of the partition of the table of ids in its upper bits.
    """
    rows = materialize(encoded(docs, tokenizer, end_id), "ids")
    known = statistics(rows)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        ids: list[int | None] = []
        tokens: list[np.ndarray] = []
        total = 0

        def flush() -> pa.RecordBatch:
            nonlocal number
            out: list[tuple] = []
            for sequence in pack_shard(tokens, known):
                offset = 0
                for doc, start, length in sequence:
                    own = tokens[doc]
                    out.append((ids[doc], start, length, zlib.crc32(own[start : start + length].tobytes()), len(own), number, offset))
                    offset += length
                number += 1
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

        for batch in batches:
            for doc_id, own in zip(batch.column("doc_id"), decoded(batch), strict=True):
                tokens.append(own.astype("<u4"))
                ids.append(doc_id.as_py())
                total += len(tokens[-1])
                if len(tokens) >= SHARD_DOCS or total >= SHARD_TOKENS:
                    yield flush()
                    ids, tokens, total = [], [], 0
        if tokens:
            yield flush()

    return rows.mapInArrow(tidy(pack), SCHEMA)
