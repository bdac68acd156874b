"""Quality rules, line deduplication and decontamination against brute force."""

import hashlib
import time
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from framewright.llm import decontamination as DC
from framewright.llm import line_dedup as LD
from framewright.llm import quality_rules as QR

from .fixtures import PASSAGE, SCHEMA, documents, key, texts

WS = "\t\n\x0b\x0c\r "
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def same(a, b):
    assert sorted(map(tuple, a), key=key) == sorted(map(tuple, b), key=key)


def base_counts(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen, hit = Counter(tri), set()
    for i, x in enumerate(tri):
        if seen[x] > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def test_quality_counts(spark):
    out = QR.quality_rules(documents(spark)).select("doc.doc_id", *QR.FEATURES, "base_failed", "kept").collect()
    same([r[:7] for r in out], [(d, *(c := base_counts(t)), c[0] < 50 or 100 * c[4] > 50 * c[0]) for d, t, *_ in texts()])
    assert all(not r.kept for r in out if r.base_failed)
    assert QR.quality_rules(documents(spark, [])).count() == 0


def test_quality_counts_when_packed_hashes_collide(spark, monkeypatch):
    """With a few bits of hash left, every text has windows of equal packed hashes; the words decide."""
    monkeypatch.setattr(QR, "SPARE_BITS", 48)
    found = QR.features(documents(spark)).select("doc.doc_id", "n_repeat_words").collect()
    monkeypatch.undo()
    same(found, QR.features(documents(spark)).select("doc.doc_id", "n_repeat_words").collect())


def test_quality_of_a_very_long_text(spark):
    rows = [(1, " ".join(map(str, range(1_000_000))), "en", "s", 1)]
    assert QR.features(documents(spark, rows, extra=False)).first().n_repeat_words == 0


def test_quality_distances(spark):
    """Histograms and Jensen-Shannon distances as numpy has them."""
    docs = documents(spark, extra=False).where("text IS NOT NULL")
    found = QR.features(docs)
    known = QR.references(found)
    for r in QR.judge(found, known).collect():
        t = r.doc.text
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        marks = re.findall(r"[!\x22'()+,./:;=?@\[\\\]^_`{}~-]", t)
        counts = [len(t) - sum(map(len, w)), len(t.encode()) - len(t), len(re.findall(r"[#*$%&|<>]", t)), len(re.findall("[0-9]", t)), len(marks)]
        assert list(r.classes) == [*counts, max(0, len(t) - sum(counts))]
        common = Counter(x for x in w if x in QR.COMMON_WORDS)
        assert sorted(r.common[:-1]) == sorted(common.get(c, 0) for c in QR.COMMON_WORDS) and r.common[-1] == len(w) - sum(common.values())
        if r.class_distance is not None:
            p = np.array(r.classes) / sum(r.classes)
            best = min(distance(p, np.array(k[0])) for k in known)
            assert abs(best - r.class_distance) < 1e-9


def distance(p, q):
    m = (p + q) / 2
    part = lambda a: sum(x * np.log2(x / y) for x, y in zip(a, m) if x > 0)
    return np.sqrt(max(0.0, (part(p) + part(q)) / 2))


def test_quality_references_of_every_language(spark):
    """More than 64 languages: the smallest one, of digits only, has a reference too."""
    rows = [(i, f"the word{'abcdefgh'[i % 8]} of " * 40, f"l{i:02d}", None, 1) for i in range(70)] + [(99, " ".join(f"{i:06d}" for i in range(60)), "zz", None, 1)]
    docs = documents(spark, rows, extra=False)
    known = QR.references(QR.features(docs))
    assert len(known) == 71
    out = {r.doc.doc_id: r for r in QR.judge(QR.features(docs), known).collect()}
    assert out[99].kept and out[99].class_distance < 1e-6 and len(out) == 71
    for r in out.values():
        p = np.array(r.common) / sum(r.common)
        assert abs(r.word_distance - min(distance(p, np.array(k[1])) for k in known)) < 1e-6


def test_quality_without_references(spark):
    rows = [(i, PASSAGE, None, None, 1) for i in range(3)]
    assert all(r.kept for r in QR.quality_rules(documents(spark, rows)).collect())


def test_quality_filter_keeps_columns(spark):
    docs = documents(spark)
    out = QR.quality_rules(docs).where("kept").select("doc.*")
    assert out.columns == docs.columns and out.count() > 0


def lines_by_force(rows, least=10):
    k = lambda x: x.strip(WS).translate(LOWER)
    first = {}
    for d, t, *_ in rows:
        if d is not None:
            for x in (t or "").split("\n"):
                if len(k(x)) >= least:
                    first[k(x)] = min(d, first.get(k(x), d))
    for d, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or len(k(x)) < least or first[k(x)] == d]
        yield d, len(lines), len(lines) - len(kept), "\n".join(kept)


def test_lines(spark):
    out = LD.drop_repeated_lines(documents(spark)).select("doc.doc_id", "n_lines", "n_dropped", "kept_text")
    same(out.collect(), lines_by_force(texts()))
    assert LD.drop_repeated_lines(documents(spark, [])).count() == 0


def test_many_lines(spark):
    """A text of 128,000 lines in time that grows with them."""
    body = "\n".join(f"a line of text, number {i}" for i in range(128_000))
    rows = [(1, body, "en", "s", 1), (2, body + "\nand one line more", "en", "s", 1)]
    began = time.time()
    out = {r.doc_id: r for r in LD.drop_repeated_lines(documents(spark, rows, extra=False)).select("doc.doc_id", "n_dropped", "kept_text").collect()}
    assert (out[1].n_dropped, out[1].kept_text) == (0, body) and (out[2].n_dropped, out[2].kept_text) == (128_000, "and one line more")
    assert time.time() - began < 60


def test_hot_lines(spark):
    """A line that half of all documents hold goes the aggregated way."""
    rows = [(i, f"a line that is everywhere\nown line number {i}\n" + "x" * 70 + "\n" * (i % 130), "en", "s", 1) for i in range(900)]
    out = LD.drop_repeated_lines(documents(spark, rows, extra=False)).select("doc.doc_id", "n_lines", "n_dropped", "kept_text")
    same(out.collect(), lines_by_force(rows))


def hits_by_force(rows, items, n=13):
    words = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER)) if w]
    windows = {}
    for item, t in items:
        w = words(t)
        if item is not None and w:
            for i in range(max(1, len(w) - n + 1)):
                windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    sizes = {len(w) for w in windows}
    for d, t, *_ in rows:
        w, hit, ids = words(t), set(), set()
        for s in sizes:
            for i in range(len(w) - s + 1):
                if (found := windows.get(tuple(w[i : i + s]))) is not None:
                    hit |= set(range(i, i + s))
                    ids |= found
        yield d, len(w), len(hit), len(ids), ",".join(sorted(map(str, ids))), bool(hit) and 20 * len(hit) >= len(w)


ITEMS = [(1, PASSAGE), (2, " ".join(PASSAGE.split()[:20])), (10, "one"), (3, ""), (None, PASSAGE), (4, None), (5, "a B c"), (6, "der DER der der der der der der der der der der der der"), (7, "ÉTÉ"), (1, "a second text of item one")]


def test_decontamination(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("w", F.lit(1))
    out = DC.benchmark_hits(documents(spark), items).withColumn("ids", F.array_join("item_ids", ","))
    same(out.select("doc_id", "n_words", "n_hit", "n_items", "ids", "contaminated").collect(), hits_by_force(texts(), ITEMS))
    assert DC.benchmark_hits(documents(spark, []), items).count() == 0
    assert DC.benchmark_hits(documents(spark), items.where("false")).where("n_hit > 0").count() == 0


def test_decontamination_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(DC, "BLOCK_WORDS", 40)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = DC.benchmark_hits(documents(spark), items)
    assert {(r.doc_id, r.n_hit) for r in out.collect()} == {(d, n) for d, _, n, *_ in hits_by_force(texts(), ITEMS)}


def test_decontaminate_drops_rows(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = documents(spark)
    out = DC.decontaminate(docs, items)
    assert out.columns == docs.columns
    same([(r.doc_id, r.text) for r in out.collect()], [(r[0], r[1]) for r, h in zip(texts(), hits_by_force(texts(), ITEMS)) if not h[-1]])


def test_item_ids_digest_is_of_sorted_strings(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = spark.createDataFrame([(1, "one " + PASSAGE, None, None, 1)], SCHEMA)
    row = DC.benchmark_hits(docs, items).first()
    assert row.item_ids == ["1", "10", "2"] and hashlib.sha256(b"1,10,2").hexdigest()
