"""Token counts, language identification, WARC and packing against their libraries and round trips."""

import base64
import gzip
import hashlib
import json
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framewright.llm import language_id as LI
from framewright.llm import packing as PK
from framewright.llm import token_counts as TC
from framewright.llm import warc as WA

from .fixtures import documents, key, texts

tokens = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def counter():
    return TC.PrefixCounter(tokens.path("piece_bpe_32k.model"))


@settings(max_examples=300, deadline=None)
@given(text=st.text(st.one_of(st.sampled_from("aetnoi  \n\t.,▁é語👍<>/s"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_every_prefix(counter, text):
    assert counter.table(text).tolist() == [len(counter.library.encode(text[: i + 1])) for i in range(len(text))]


def test_counts(spark, counter):
    rows = texts() + [(200, "<s> </s> <unk> [INST]", None, None, 1), (201, "x" * 5000, None, None, 1), (202, "the cat " * 3000, None, None, 1)]
    out = TC.prefix_token_counts(documents(spark, rows), tokens.path("piece_bpe_32k.model")).collect()
    want = sorted(((d, len((t or "").encode()), n := len(counter.library.encode(t or "")), n > 4096) for d, t, *_ in rows), key=key)
    assert sorted((tuple(r)[:4] for r in out), key=key) == want
    for r in out:
        table = TC.unpack_table(bytes(r.prefix_table))
        assert len(table) == 0 or table[-1] == r.n_tokens
        assert r.budget_chars == (TC.longest_prefix(table, 4096) if r.over_limit else len(table))
    assert TC.prefix_token_counts(documents(spark, []), tokens.path("piece_bpe_32k.model")).count() == 0


def test_encoder_is_the_library():
    from tokenizers import Tokenizer

    ours, theirs = PK.Encoder(tokens.path("byte_bpe_50k.json")), Tokenizer.from_file(tokens.path("byte_bpe_50k.json"))
    for t in [x[1] or "" for x in texts()] + ["a<|endoftext|>b", "<|endoftext", "  \n\n x y", "don't I'll", "١٢٣ ½", "​👩‍👩‍👧"]:
        assert ours.ids(t).tolist() == theirs.encode(t, add_special_tokens=False).ids


def whole(rows, docs, encoder):
    """Checks a packing: every id once, sequences without gaps, of 1024 ids or a power of two. Returns their sizes."""
    want = Counter()
    for d, t, *_ in docs:
        want[d, len(encoder.ids(t or "")) + 1] += 1
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id, r.doc_tokens].append(r)
    assert set(pieces) == set(want)
    for k, own in pieces.items():
        assert sum(r.length for r in own) == k[1] * want[k]
    sizes = Counter()
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= 1024 and (at == 1024 or at & (at - 1) == 0)
        sizes[at] += 1
    return sizes


def test_packing(spark):
    rows = texts() + [(300 + i, f"document {i} about topic{i % 7} " * (i % 50), None, None, 1) for i in range(300)]
    encoder = PK.Encoder(tokens.path("byte_bpe_50k.json"))
    out = PK.pack_documents(documents(spark, rows).repartition(3), tokens.path("byte_bpe_50k.json")).collect()
    sizes = whole(out, rows, encoder)
    assert sum(n for s, n in sizes.items() if s < 1024) <= 3 * 10
    ids = defaultdict(list)
    for d, t, *_ in rows:
        ids[d].append(np.append(encoder.ids(t or ""), 0).astype("<u4"))
    for r in out:
        assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
    assert PK.pack_documents(documents(spark, []), tokens.path("byte_bpe_50k.json")).count() == 0


def test_packing_prefers_neighbours():
    """A seed's window takes documents of its own vocabulary first."""
    rng = np.random.default_rng(0)
    docs = [np.append(rng.integers(1 + 1000 * (i % 5), 60 + 1000 * (i % 5), 200), 0).astype("<u4") for i in range(100)]
    mixed = [{d % 5 for d, _, _ in s} for s in PK.pack_shard(docs)]
    assert sum(len(m) == 1 for m in mixed) > 0.6 * len(mixed)


def test_bm25_scores():
    docs = [np.array(x, "<u4") for x in ([5, 5, 6, 0], [5, 7, 0], [8, 9, 0], [6, 5, 5, 7, 0])]
    shard = PK.Shard(docs)
    n, avg = 4, np.mean([len(d) for d in docs])
    score = lambda q, d: sum(np.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (PK.K1 + 1) / (tf + PK.K1 * (1 - PK.B + PK.B * len(docs[d]) / avg)) for t in set(docs[q].tolist()) if (tf := docs[d].tolist().count(t)) for df in [sum(t in x.tolist() for x in docs)])
    shard.unused[0] = False
    assert shard.neighbours(0).tolist() == sorted([1, 2, 3], key=lambda d: -score(0, d))


def test_bm25_statistics_are_those_of_all_documents(spark):
    """Over partitions and shards; a term rare in a shard but common in the table counts as common."""
    rows = [(i, f"common word{i % 9} text {'x ' * (i % 40)}", None, None, 1) for i in range(90)] + [(500, "\U0001f44d é", None, None, 1), (501, None, None, None, 1)]
    encoder = PK.Encoder(tokens.path("byte_bpe_50k.json"))
    ids = [np.append(encoder.ids(t or ""), 0) for _, t, *_ in rows]
    df = Counter(int(x) for d in ids for x in np.unique(d))
    known = PK.statistics(PK.encoded(documents(spark, rows).repartition(5), tokens.path("byte_bpe_50k.json")))
    assert known.n == len(rows) and abs(known.mean - np.mean([len(d) for d in ids])) < 1e-9
    assert dict(zip(known.terms.tolist(), known.df.tolist())) == df
    docs = [np.array(x, "<u4") for x in ([5, 6, 0], [5, 7, 0], [6, 8, 0], [6, 9, 0])]
    few = PK.Statistics(1000, 3.0, np.array([0, 5, 6, 7, 8, 9]), np.array([1000, 900, 3, 5, 5, 5]))
    for shard, first in ((PK.Shard(docs), 1), (PK.Shard(docs, few), 2)):
        shard.unused[0] = False
        assert shard.neighbours(0)[0] == first


def test_packing_asks_every_term_and_all_neighbours():
    """Windows of tiny documents take their own kind to the end, by terms beyond the seed's heaviest too."""
    docs = [np.array([1 + i % 2, 10 + i, 0], "<u4") for i in range(1400)]
    first = PK.pack_shard(docs)[0]
    assert {d % 2 for d, _, _ in first} == {0}
    docs = [np.arange(1, 60), np.arange(100, 150), np.append(np.arange(30, 60), 500)]
    rare = np.append(np.arange(1, 13), 600)
    shard = PK.Shard([np.append(d, 0).astype("<u4") for d in [*docs, rare]])
    shard.unused[0] = False
    assert set(shard.neighbours(0).tolist()) == {1, 2, 3} and shard.neighbours(0)[0] == 2
    ids = [np.append(np.full(9, 1 + t), 0).astype("<u4") for t in range(40)]
    seed = np.append(np.arange(1, 41), 0).astype("<u4")
    shard = PK.Shard([seed, *ids])
    shard.unused[0] = False
    assert len(shard.neighbours(0)) == 40


def test_gradients():
    """Backpropagation through time against finite differences."""
    LIN = LI.train({"a": ["xa ya za " * 20], "b": ["ub vb wb " * 20]}, steps=2)
    p = {k: v.astype(np.float64) for k, v in LIN.weights.items()}
    codes, mask = LI.padded([b"xa ", b"ubv", b"w"])
    label = np.array([0, 1, 1])
    _, grad = LI.loss_and_gradient(p, codes, mask, label)
    for k in p:
        at = (ord("x"), 5) if k[0] == "w" else tuple(0 for _ in p[k].shape)
        low, high = ({a: b.copy() for a, b in p.items()} for _ in range(2))
        low[k][at] -= 1e-5
        high[k][at] += 1e-5
        slope = (LI.loss_and_gradient(high, codes, mask, label)[0] - LI.loss_and_gradient(low, codes, mask, label)[0]) / 2e-5
        assert abs(slope - grad[k][at]) < 1e-6


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = LI.identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    held = {d for d, in docs.select("doc_id").collect() if zlib.crc32(str(d).encode()) % 4 == 2}
    assert {r.doc_id for r in out} == held and all(0 <= r.score <= 1 for r in out)
    assert sum(r.lang_pred == r.lang for r in out) >= 0.95 * len(out)


def test_language_edge_cases(spark):
    out = LI.identify_languages(documents(spark)).collect()
    assert len(out) == len(texts())
    by_text = Counter((r.doc_id, r.lang_pred == "und") for r in out)
    assert by_text == Counter((d, not any(map(str.isalpha, t or ""))) for d, t, *_ in texts())
    assert {r.lang_pred for r in out} <= {"en", "de", "und"}
    nothing = LI.identify_languages(documents(spark).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in nothing} == {"und"} and LI.identify_languages(documents(spark, [])).count() == 0


def test_every_language_is_learned(spark):
    """More than 64 languages, the last by name among them."""
    word = lambda k: f"{chr(0x4E00 + 97 * k)}{chr(0x4E01 + 97 * k)}"
    rows = [(100 * k + i, f"{word(k)} " * 12, f"l{k:02d}", None, 1) for k in range(70) for i in range(6)]
    docs = documents(spark, rows, extra=False)
    assert set(LI.sample_texts(docs)) == {r[2] for r in rows}
    found = {(r.doc_id // 100, r.lang_pred) for r in LI.identify_languages(docs).collect()}
    assert sum(p == f"l{k:02d}" for k, p in found) >= 0.9 * 70 and {p for k, p in found if k >= 64} & {f"l{k}" for k in range(64, 70)}


def test_windows_hold_every_byte_once():
    for _, t, *_ in texts():
        data = (t or "").encode()
        for span, context in ((512, 32), (7, 3), (1, 5)):
            found = list(LI.windows_of(data, span, context))
            assert b"".join(w[a:b] for w, a, b in found) == data
            assert all(a <= context and len(w) - b <= context for w, a, b in found)


def labels_by_force(model, text, span, context):
    """The network byte by byte, with a loop over units' formulas and nothing side by side."""
    p, data, total = model.weights, text.encode(), 0
    n = p["uf"].shape[0]
    sigma = lambda x: 1 / (1 + np.exp(-x))

    def states(d, window):
        h, out = np.zeros(n), []
        for byte in window:
            x = p["w" + d][byte] + p["b" + d]
            z, r = (sigma(x[i * n : i * n + n] + h @ p["u" + d][:, i * n : i * n + n]) for i in (0, 1))
            q = np.tanh(x[2 * n :] + (r * h) @ p["u" + d][:, 2 * n :])
            h = (1 - z) * h + z * q
            out.append(h)
        return out

    for at in range(0, len(data), span):
        low = max(0, at - context)
        window = data[low : at + span + context]
        both = [np.concatenate(x) for x in zip(states("f", window), states("r", window[::-1])[::-1])]
        for h in both[at - low : at - low + span]:
            x = h @ p["v"] + p["c"]
            total = total + x - np.log(np.exp(x).sum())
    shares = np.exp(total / len(data))
    return shares / shares.sum()


def test_predictions_by_force(spark, monkeypatch):
    """Whole texts, labelled byte by byte in plain loops; the windows small, so that a text has many."""
    monkeypatch.setattr(LI, "LANES", 3)
    monkeypatch.setattr(LI, "GATHERED", 7)
    monkeypatch.setattr(LI.windows_of, "__defaults__", (48, 8))
    rows = texts()
    model = LI.train({"en": [t for _, t, lang, *_ in rows if lang == "en" and t], "de": [t for _, t, lang, *_ in rows if lang == "de" and t]}, steps=40)
    found = sorted((r.doc_id is None, str(r.doc_id), r.lang_pred, round(r.score, 4)) for r in LI.predict(documents(spark), model).collect())
    expected = []
    for d, t, *_ in rows:
        if any(map(str.isalpha, t or "")):
            shares = labels_by_force(model, t, 48, 8)
            expected.append((d is None, str(d), model.languages[int(shares.argmax())], round(float(shares.max()), 4)))
        else:
            expected.append((d is None, str(d), "und", 0.0))
    assert [x[:3] for x in found] == [x[:3] for x in sorted(expected)]
    assert all(abs(a[3] - b[3]) < 1e-3 for a, b in zip(found, sorted(expected)))


def test_samples_are_bounded(spark):
    """A chosen doc_id with many rows, and a very long text, bring no more than the bound."""
    rows = [(1, f"wort {i}", "de", None, 1) for i in range(600)] + [(4, "word " * 200_000, "en", None, 1)]
    found = LI.sample_texts(documents(spark, rows, extra=False))
    assert len(found["de"]) <= LI.SAMPLE_DOCS * LI.SAMPLE_WINDOWS and len(found["en"]) <= LI.SAMPLE_WINDOWS
    assert all(len(w) <= LI.WINDOW_CHARS for own in found.values() for w in own)


PAGES = [(5, "http://a/ b\r\n", "<p>x</p>"), (2, None, "<p>x</p>"), (2, "u", "<p>x</p>"), (9, "u9", None), (3, "u3", ""), (None, "n", "<p>x</p>"), (None, "n", "only null"), (None, "m", "only null"), (7, "u7", "é" * 70_000), (8, "u8", "Content-Length: 3\r\n\r\nx")]


def pages(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("first", F.lit(1)).withColumn("payload", F.lit("z"))


def expected(rows, least=0):
    groups = defaultdict(list)
    for p, _, h in rows:
        groups[h or ""].append(p)
    for p, _, h in rows:
        b = (h or "").encode()
        ids = [x for x in groups[h or ""] if x is not None]
        first = min(ids) if ids and len(groups[h or ""]) > 1 and len(b) >= least else None
        yield p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), *(("revisit", first) if first is not None and p != first else ("response", None))


@pytest.mark.parametrize("least", [0, 5])
def test_warc_round_trip(spark, least):
    index = WA.write_archives(pages(spark).repartition(3), least_revisit_bytes=least)
    out = WA.read_records(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload").collect()
    assert sorted((tuple(r)[:5] for r in out), key=key) == sorted(expected(PAGES, least), key=key)
    texts_of = {WA.digest_of((h or "").encode()): (h or "").encode() for _, _, h in PAGES}
    assert all(bytes(r.payload) == texts_of[r.payload_digest] for r in out if r.record_type == "response")
    assert WA.write_archives(pages(spark, [])).count() == 0


def test_warc_files_are_gzip_members_in_index_order(spark):
    index = WA.write_archives(pages(spark).coalesce(1)).orderBy("file", "offset").collect()
    data = open(index[0].file.removeprefix("file://"), "rb").read()
    assert [r.offset for r in index] == [sum(x.length for x in index[:i]) for i in range(len(index))] and sum(r.length for r in index) == len(data)
    assert gzip.decompress(data).count(b"WARC/1.1\r\n") == len(index)
    some = spark.createDataFrame(index[2:4], WA.INDEX)
    assert WA.read_records(some).count() == 2


def test_coalesced_ranges():
    ranges = [(0, 10), (10, 5), (100, 10), (300, 50)]
    assert WA.coalesced(ranges, gap=0, most=1000) == [(0, 2, 0, 15), (2, 3, 100, 10), (3, 4, 300, 50)]
    assert WA.coalesced(ranges, gap=90, most=1000) == [(0, 3, 0, 110), (3, 4, 300, 50)]
    assert WA.coalesced(ranges, gap=1000, most=120) == [(0, 3, 0, 110), (3, 4, 300, 50)]


def test_added_tokens_are_those_of_the_file():
    spec = json.load(open(tokens.path("byte_bpe_50k.json"), encoding="utf-8"))
    assert PK.Encoder(tokens.path("byte_bpe_50k.json")).added == [x["content"] for x in spec["added_tokens"]]
