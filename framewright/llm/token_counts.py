"""Exact token counts at every prefix of a text, by dynamic programming over a BPE vocabulary.

For a text of n characters the table holds n counts: entry i is the number of tokens of the first i + 1 characters
taken as a text of their own. It is built left to right: the last token of a prefix is the one piece that ends there,
may follow the last token of the prefix before it (two pieces may stand side by side only if the pair, encoded alone,
stays that pair), and its count is one more than that prefix's. Truncation and budget questions read the table.

Pieces hold no white-space mark behind other characters, so no token crosses the start of a word; the program runs
once per distinct word and worker, and a text's table is its words' tables shifted by running sums.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import tidy

MARK = "▁"
#: Distinct words and pairs remembered by a worker before it starts anew, and the longest word remembered.
MEMORY, PAIRS, LONG_WORD = 700_000, 400_000, 64


class PrefixCounter:
    """Prefix tables for a sentencepiece BPE model with byte fallback and no other normalisation than space marks."""

    def __init__(self, model: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        own = [i for i in range(self.library.get_piece_size()) if not (self.library.is_byte(i) or self.library.is_control(i) or self.library.is_unknown(i))]
        self.score = {self.library.id_to_piece(i): self.library.get_score(i) for i in own}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.score):
            raise ValueError("a piece of this model crosses the start of a word")
        import ahocorasick

        self.pieces = ahocorasick.Automaton()
        for piece in self.score:
            if len(piece) > 1 and self._merge(piece) == [piece]:  # some pieces can't be reached by merges
                self.pieces.add_word(piece, piece)
        self.pieces.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.words: dict[str, bytes] = {}

    def _merge(self, text: str) -> list[str]:
        """Plain BPE of a short text: the best-scored adjacent pair first, the leftmost of equals."""
        parts, get = list(text), self.score.get
        scores = [get(a + b, -np.inf) for a, b in zip(parts, parts[1:], strict=False)]
        while scores:
            best = max(scores)
            if best == -np.inf:
                break
            at = scores.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            if at:
                scores[at - 1] = get(parts[at - 1] + parts[at], -np.inf)
            if at < len(scores):
                scores[at] = get(parts[at] + parts[at + 1], -np.inf)
        return parts

    def _may_follow(self, a: str, b: str) -> bool:
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            found = self.pairs[a, b] = self._merge(a + b) == [a, b]
        return found

    def word_steps(self, word: str) -> bytes:
        """By how much the count of each prefix of a word (with its leading marks) differs from the one before, as signed bytes."""
        score, pairs, n = self.score, self.pairs, len(word)
        ends: list[list[str]] = [[] for _ in range(n)]
        for at, piece in self.pieces.iter(word):
            ends[at].append(piece)
        last: list[str] = [""] * (n + 1)
        counts = [0] * (n + 1)
        for end in range(1, n + 1):
            for piece in ends[end - 1]:
                start = end - len(piece)
                before = last[start]
                if not start or (ok := pairs.get((before, piece))) or (ok is None and self._may_follow(before, piece)):
                    last[end], counts[end] = piece, counts[start] + 1
                    break
            else:  # a single character is always a token: a piece, or bytes if it is none
                piece = word[end - 1]
                last[end], counts[end] = piece, counts[end - 1] + (1 if piece in score else len(piece.encode("utf-8", "surrogatepass")))
        return bytes([(b - a) & 255 for a, b in zip(counts, counts[1:], strict=False)])

    def _new(self, word: str) -> bytes:
        steps = self.word_steps(MARK + word.replace(" ", MARK))
        if len(word) <= LONG_WORD:
            if len(self.words) >= MEMORY:
                self.words.clear()
            self.words[word] = steps
        return steps

    def steps(self, text: str) -> np.ndarray:
        """Differences of the counts of the first 1, 2, ... characters of a text; the counts are their running sums."""
        if not text:
            return np.empty(0, np.int8)
        get, new = self.words.get, self._new
        if MARK in text:  # a mark in the text is as good as a space
            text = text.replace(MARK, " ")
        if "  " in text or text[0] == " ":
            words = [w[1:] for w in re.findall(" +[^ ]*|[^ ]+", " " + text)]
        else:
            words = text.split(" ")
        steps = np.frombuffer(b"".join([get(w) or new(w) for w in words]), np.int8)
        first, rest = int(steps[0]), steps[1:].copy()  # the mark put before the text belongs to its first character
        rest[0] += first
        return rest

    def table(self, text: str) -> np.ndarray:
        """Counts of the first 1, 2, ... characters of a text."""
        return np.cumsum(self.steps(text), dtype=np.int64)


def longest_prefix(table: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix of at most budget tokens; counts may fall as a prefix grows."""
    fits = np.flatnonzero(table <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def pack_steps(steps: np.ndarray) -> bytes:
    return zlib.compress(steps.tobytes(), 1)


def unpack_table(data: bytes) -> np.ndarray:
    """The counts of every prefix, from what pack_steps() made."""
    return np.cumsum(np.frombuffer(zlib.decompress(data), np.int8), dtype=np.int64)


def prefix_token_counts(docs: DataFrame, model: str, budget: int = 4096, store: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, budget_chars, prefix_table) of each row of docs.

    n_tokens is the last entry of the prefix table, budget_chars the longest prefix within the budget, and
    prefix_table the packed table (see unpack_table), or null without store. Null and empty texts have no bytes and
    no tokens. doc_id may be null or repeat: each row is counted by itself. Other columns are not read.
    """
    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, budget_chars long, prefix_table binary"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PrefixCounter(model)
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                rows: list[list] = [[], [], [], [], []]
                for text in part.column("text"):
                    text = text.as_py() or ""
                    steps = counter.steps(text)
                    table = np.cumsum(steps, dtype=np.int64)
                    total = int(table[-1]) if len(table) else 0
                    for column, value in zip(rows, (len(text.encode()), total, total > budget, longest_prefix(table, budget) if total > budget else len(text), pack_steps(steps) if store else None), strict=True):
                        column.append(value)
                kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *(pa.array(v, k) for v, k in zip(rows, kinds, strict=True))], names=[x.split()[0] for x in schema.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(tidy(count), schema)
