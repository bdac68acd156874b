"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy.

The network reads a text's UTF-8 bytes in stretches of SPAN bytes, each with CONTEXT bytes on either side: the states of
both directions start at zero at the ends of that window, run over spaces and words alike, and label every byte of the
stretch. A document's probabilities pool the log-probabilities of all its bytes. Stretches are independent of each
other, so a long text is as parallel as many short ones; the network is trained on windows as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import tidy

#: Bytes that a window labels, those it only reads on either side, hidden units of each direction.
SPAN, CONTEXT, HIDDEN = 1024, 32, 8
#: The bounded sample that is learned from: documents of each language, and windows (of so many characters) of each document.
SAMPLE_DOCS, SAMPLE_WINDOWS, WINDOW_CHARS = 250, 32, 72
#: Steps for up to STEP_LANGUAGES languages; with more, in proportion, so that a language is met as often.
STEPS, BATCH, RATE, STEP_LANGUAGES = 240, 256, 0.03, 64
#: Share of the training windows that are put in capitals.
CAPITALS = 0.1
#: Windows that run side by side, and how many are gathered to sort them by size.
LANES, GATHERED = 1024, 8192


@dataclass
class Model:
    """Per direction: w (bytes to gates), u (state to gates), b; then v and c from both states to languages."""

    languages: list[str]
    weights: dict[str, np.ndarray]

    def positions(self, codes: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Log-probabilities (time, segment, language) of padded segments; codes and mask are (time, segment)."""
        both = np.concatenate([_run(self.weights, "f", codes, mask)[0], _run(self.weights, "r", codes[::-1], mask[::-1])[0][::-1]], 2)
        return _log_softmax(both @ self.weights["v"] + self.weights["c"])

    def window_sums(self, windows: list[tuple[bytes, int, int]]) -> np.ndarray:
        """For each window (bytes, from, to) the sum of the log-probabilities of its positions from <= i < to.

        Windows lie side by side, the longest first, so those that still run are always the first ones.
        """
        out = np.zeros((len(windows), len(self.languages)), np.float64)
        order = sorted(range(len(windows)), key=lambda i: -len(windows[i][0]))
        for at in range(0, len(order), LANES):
            own = order[at : at + LANES]
            out[own] = self._lanes([windows[i] for i in own])
        return out

    def _lanes(self, windows: list[tuple[bytes, int, int]]) -> np.ndarray:
        n = len(windows[0][0])
        codes = np.ascontiguousarray(np.frombuffer(b"".join(w.ljust(n, b"\0") for w, _, _ in windows), np.uint8).reshape(len(windows), n).T)
        sizes, start, stop = (np.array(x) for x in zip(*((len(w), a, b) for w, a, b in windows), strict=True))
        active = np.searchsorted(-sizes, -np.arange(n), side="left")  # windows longer than t
        states = [self._states(d, codes, active) for d in "fr"]
        v, c, h = self.weights["v"].T, self.weights["c"][:, None], self.weights["uf"].shape[0]
        vf, vr = np.ascontiguousarray(v[:, :h]), np.ascontiguousarray(v[:, h:])
        total = np.zeros((len(self.languages), len(windows)), np.float64)
        for t in range(n):
            m = active[t]
            x = vf @ states[0][t][:, :m] + vr @ states[1][t][:, :m] + c
            x -= x.max(0)
            x -= np.log(np.exp(x).sum(0))
            total[:, :m] += x * ((start[:m] <= t) & (t < stop[:m]))
        return total.T

    def _states(self, d: str, codes: np.ndarray, active: np.ndarray) -> np.ndarray:
        """(time, unit, window): states of one direction; a window's first state comes from zero."""
        n = self.weights["u" + d].shape[0]
        w = np.ascontiguousarray((self.weights["w" + d] + self.weights["b" + d]).T)
        gates, new = np.ascontiguousarray(self.weights["u" + d][:, : 2 * n].T), np.ascontiguousarray(self.weights["u" + d][:, 2 * n :].T)
        out = np.empty((len(codes), n, codes.shape[1]), np.float32)
        h = np.zeros((n, codes.shape[1]), np.float32)
        for t in range(len(codes)) if d == "f" else range(len(codes) - 1, -1, -1):
            m = active[t]
            x, own = w[:, codes[t, :m]], h[:, :m]
            zr = gates @ own
            zr += x[: 2 * n]
            zr *= 0.5  # the logistic function by tanh
            np.tanh(zr, out=zr)
            zr += 1
            zr *= 0.5
            q = new @ (zr[n:] * own)
            q += x[2 * n :]
            np.tanh(q, out=q)
            q -= own
            q *= zr[:n]
            own += q
            out[t, :, :m] = own
        return out


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(-1, keepdims=True)
    return x - np.log(np.exp(x).sum(-1, keepdims=True))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def padded(segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    n = max(map(len, segments))
    codes = np.frombuffer(b"".join(s.ljust(n, b"\0") for s in segments), np.uint8).reshape(len(segments), n).T
    sizes = np.fromiter(map(len, segments), int, len(segments))
    return codes, (np.arange(n)[:, None] < sizes).astype(np.float32)


def _run(p: dict[str, np.ndarray], d: str, codes: np.ndarray, mask: np.ndarray):
    """States of one direction, and what the way back needs. Where the mask is 0 the state stays."""
    w, u, b = p["w" + d], p["u" + d], p["b" + d]
    h, n = np.zeros((codes.shape[1], u.shape[0]), np.float32), u.shape[0]
    states, kept = [], []
    for code, m in zip(codes, mask, strict=True):
        x = w[code] + b
        zr = _sigmoid(x[:, : 2 * n] + h @ u[:, : 2 * n])
        z, r = zr[:, :n], zr[:, n:]
        q = np.tanh(x[:, 2 * n :] + (r * h) @ u[:, 2 * n :])
        new = h + (m[:, None] * z) * (q - h)
        kept.append((h, z, r, q))
        states.append(h := new)
    return np.stack(states), kept


def _back(p: dict[str, np.ndarray], d: str, codes: np.ndarray, mask: np.ndarray, kept: list, grad: np.ndarray, out: dict[str, np.ndarray]) -> None:
    """Backpropagation through time of one direction; grad is that of each state."""
    u, n = p["u" + d], p["u" + d].shape[0]
    dw, du, db = np.zeros_like(p["w" + d]), np.zeros_like(u), np.zeros_like(p["b" + d])
    carry = np.zeros_like(grad[0])
    for t in range(len(codes) - 1, -1, -1):
        h, z, r, q = kept[t]
        m, g = mask[t][:, None], grad[t] + carry
        dq = g * m * z * (1 - q * q)
        dz = g * m * (q - h) * z * (1 - z)
        drh = dq @ u[:, 2 * n :].T
        dr = drh * h * r * (1 - r)
        dzr = np.concatenate([dz, dr], 1)
        carry = g * (1 - m * z) + drh * r + dzr @ u[:, : 2 * n].T
        du[:, : 2 * n] += h.T @ dzr
        du[:, 2 * n :] += (r * h).T @ dq
        dx = np.concatenate([dzr, dq], 1)
        db += dx.sum(0)
        np.add.at(dw, codes[t], dx)
    out["w" + d], out["u" + d], out["b" + d] = dw, du, db


def loss_and_gradient(p: dict[str, np.ndarray], codes: np.ndarray, mask: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy over all positions, each of which has its segment's label."""
    f, kept_f = _run(p, "f", codes, mask)
    r, kept_r = _run(p, "r", codes[::-1], mask[::-1])
    both, n = np.concatenate([f, r[::-1]], 2), f.shape[2]
    logs = _log_softmax(both @ p["v"] + p["c"])
    total = mask.sum()
    grad = np.exp(logs)
    grad[:, np.arange(len(label)), label] -= 1
    grad *= mask[..., None] / total
    out = {"v": np.einsum("tbh,tbk->hk", both, grad), "c": grad.sum((0, 1))}
    back = grad @ p["v"].T
    _back(p, "f", codes, mask, kept_f, back[..., :n], out)
    _back(p, "r", codes[::-1], mask[::-1], kept_r, back[::-1, :, n:], out)
    return float(-(logs[:, np.arange(len(label)), label] * mask).sum() / total), out


def windows_of(text: bytes, span: int = SPAN, context: int = CONTEXT) -> Iterator[tuple[bytes, int, int]]:
    """(bytes, from, to) windows, whose stretches [from, to) hold every byte of a text once."""
    for at in range(0, len(text), span):
        low, end = max(0, at - context), min(len(text), at + span)
        yield text[low : end + context], at - low, end - low


def train(texts: dict[str, list[str]], seed: int = 7, steps: int = STEPS) -> Model:
    """Fit the network to windows of text by language, with Adam on batches balanced by language."""
    rng = np.random.default_rng(seed)
    languages = sorted(texts)
    pools = [[(t.upper() if rng.random() < CAPITALS else t).encode("utf-8", "replace")[: WINDOW_CHARS + CONTEXT] for t in texts[language]] for language in languages]
    k = len(languages)
    n = min(4 * HIDDEN, max(HIDDEN, k // 4))
    steps = -(-steps * max(k, STEP_LANGUAGES) // STEP_LANGUAGES)
    normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    p = {"v": normal(2 * n, k, scale=0.2), "c": np.zeros(k, np.float32)}
    for d in "fr":
        p |= {"w" + d: normal(256, 3 * n, scale=0.3), "u" + d: normal(n, 3 * n, scale=0.25), "b" + d: np.zeros(3 * n, np.float32)}
    first, second = ({x: np.zeros_like(y) for x, y in p.items()} for _ in range(2))
    for step in range(1, steps + 1 if k > 1 else 1):
        label = rng.integers(0, k, BATCH)
        codes, mask = padded([pools[x][rng.integers(len(pools[x]))] for x in label])
        _, grad = loss_and_gradient(p, codes, mask, label)
        rate = RATE * (1 - 0.9 * step / steps)
        for x, g in grad.items():
            first[x] = 0.9 * first[x] + 0.1 * g
            second[x] = 0.99 * second[x] + 0.01 * g * g
            p[x] = p[x] - rate * (first[x] / (1 - 0.9**step)) / (np.sqrt(second[x] / (1 - 0.99**step)) + 1e-8)
    return Model(languages, {x: y.astype(np.float32) for x, y in p.items()})


def is_held_out(doc_id: Column) -> Column:
    """crc32 of doc_id as text, mod 4, is 2; false for null."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def sample_texts(docs: DataFrame, per_language: int = SAMPLE_DOCS) -> dict[str, list[str]]:
    """Windows of at most per_language training documents of each language, chosen by a hash of doc_id.

    SAMPLE_WINDOWS windows at places given by a hash are cut from a document where it lies, so what comes to the driver
    is bounded by the number of languages, however long the texts or often a doc_id.
    """
    may = docs.where(F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rank = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = may.select("doc_id", "lang").withColumn("r", F.row_number().over(rank)).where(f"r <= {per_language}")
    places = F.greatest(F.lit(1), F.length("text") - WINDOW_CHARS + 1)
    at = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(SAMPLE_WINDOWS - 1)), lambda i: F.pmod(F.xxhash64(F.col("doc_id"), i), places).cast("int")))
    cut = F.transform(at, lambda i: F.substring(F.col("text"), i + 1, F.lit(WINDOW_CHARS)))
    rows = may.select("doc_id", "lang", "text").join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi").select("doc_id", "lang", cut.alias("cut"))
    again = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "cut")  # a chosen doc_id may have many rows
    rows = rows.withColumn("r", F.row_number().over(again)).where(f"r <= {per_language}")
    out: dict[str, list[str]] = {}
    for lang, cuts in sorted(rows.select("lang", "cut").collect()):
        out.setdefault(lang, []).extend(cuts)
    return out


SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """SCHEMA for each row of docs, from text alone; und with score 0 where text is null or has no letter."""

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                texts = [t or "" for t in part.column("text").to_pylist()]
                spoken = [bool(model.languages) and any(map(str.isalpha, t)) for t in texts]
                total = np.zeros((len(texts), len(model.languages)))
                all_windows = ((i, w) for i, t in enumerate(texts) if spoken[i] for w in windows_of(t.encode("utf-8", "replace")))
                while gathered := list(islice(all_windows, GATHERED)):
                    np.add.at(total, [i for i, _ in gathered], model.window_sums([w for _, w in gathered]))
                langs, scores = ["und"] * len(texts), [0.0] * len(texts)
                for i in np.flatnonzero(spoken):
                    mean = total[i] / len(texts[i].encode("utf-8", "replace"))
                    shares = np.exp(mean - mean.max())
                    best = int(shares.argmax())
                    langs[i], scores[i] = model.languages[best], float(shares[best] / shares.sum())
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(tidy(label), SCHEMA)


def identify_languages(docs: DataFrame) -> DataFrame:
    """Train on a sample of the labelled documents that aren't held out, and label every row of docs.

    Every language is learned, from at most SAMPLE_WINDOWS windows of each of SAMPLE_DOCS documents of it. Returns
    SCHEMA. lang, source and doc_id are no inputs of a prediction. Rows with a null lang or doc_id teach nothing and
    and are labelled all the same; a null doc_id is not held out. Without any labelled document all is und. Repeated
    rows are labelled one by one, an empty table gives an empty table, further columns are not read.
    """
    texts = sample_texts(docs)
    return predict(docs, train(texts) if texts else Model([], {}))
