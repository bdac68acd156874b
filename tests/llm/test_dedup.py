"""Substring deduplication, suffix-array deduplication and the n-gram join against brute force."""

import os
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.llm import anchors, common, components, ngram_join, substring_dedup, suffix_dedup

from .fixtures import documents, key, texts


def same(a, b):
    assert sorted(map(tuple, a), key=key) == sorted(map(tuple, b), key=key)


def words_of(t):
    return (t or "").encode().split()


def windows_by_force(rows, n):
    first = {}
    d_of = lambda d: substring_dedup.LAST if d is None else d
    for d, t, *_ in rows:
        w = words_of(t)
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            first[k] = min(d_of(d), first.get(k, d_of(d)))
    for d, t, *_ in rows:
        w = words_of(t)
        gone = {j for i in range(len(w) - n + 1) if first[tuple(w[i : i + n])] < d_of(d) for j in range(i, i + n)}
        yield d, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone)


@pytest.mark.parametrize("length, gram", [(50, 10), (12, 4)])
def test_windows(spark, length, gram):
    out = substring_dedup.drop_repeated_windows(documents(spark), length, gram)
    same([(r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in out.collect()], windows_by_force(texts(), length))


def test_windows_of_nothing(spark):
    assert substring_dedup.drop_repeated_windows(documents(spark, [])).count() == 0


def test_index_runs_and_compaction(spark):
    """Batch by batch, each answered from its own texts and the runs; what a later batch reads has been compacted."""
    rows = [r for r in texts(5) if r[0] is not None]
    docs = documents(spark, rows, extra=False)
    index, found, tables = substring_dedup.FingerprintIndex(spark, length=12, gram=4, most_runs=2), [], []
    for low, high in [(0, 8), (8, 20), (20, 27), (27, 31), (31, 31), (31, 1000)]:
        out = index.ingest(docs.where(f"doc_id >= {low} AND doc_id < {high}"))
        found += [(r.doc_id, r.n_removed) for r in out.collect()]
        assert all(len(runs) <= 2 for runs in index.runs.values())
        tables += [t for runs in index.runs.values() for t in runs]
    same(found, [(r[0], r[2]) for r in windows_by_force(rows, 12)])
    kept = {t.table_name for runs in index.runs.values() for t in runs}
    assert {t.table_name for t in tables} > kept
    for t in tables:
        assert os.path.exists(t.written_to.removeprefix("file:").replace("//", "/", 1)) == (t.table_name in kept)
    for kind in ("blocks", "windows"):
        index.compact()
        assert index.runs[kind][0].groupBy(*substring_dedup.KINDS[kind]).count().where("count > 1").count() == 0


def test_history_is_not_shuffled(spark):
    docs = documents(spark, extra=False).where("doc_id IS NOT NULL")
    index = substring_dedup.FingerprintIndex(spark, length=12, gram=4)
    index.ingest(docs.where("doc_id < 15"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        batch = index.runs["blocks"][0].groupBy("b", "a").agg(F.min("first").alias("first"), F.max("first.d").alias("last_d"))
        plan = index._first(batch, "blocks")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hot_sources(spark, monkeypatch):
    """Spans of a source that very many documents repeat are dealt over its copies."""
    seen = []
    monkeypatch.setattr(anchors, "hot_list", lambda df, k: seen.append(common.hot_list(df, k)) or seen[-1])
    shared = " ".join(f"common{i}" for i in range(60))
    rows = [(i, f"begin{i} {shared} end{i}", "en", "s0", 1) for i in range(300)]
    docs = documents(spark, rows, extra=False)
    out = substring_dedup.drop_repeated_windows(docs, batches=1)
    same([(r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in out.collect()], windows_by_force(rows, 50))
    out = suffix_dedup.drop_repeated_substrings(docs)
    same([(r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in out.collect()], [(d, b, g, k) for d, b, g, _, k in bytes_by_force(rows, 200)])
    assert len(seen) == 2 and all(seen)


def test_rows_of_no_or_equal_ids_are_told_apart(spark):
    """Texts whose 32-bit hashes are equal, in rows without a doc_id, and in rows that share one."""
    text = lambda j: f"t{j} " + " ".join(f"{j}w{k}" for k in range(60))
    made = F.concat(F.lit("t"), "id", F.lit(" "), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(59)), lambda k: F.concat(F.col("id").cast("string"), F.lit("w"), k.cast("string"))), " "))
    twice = spark.range(250_000).select("id", F.hash(made).alias("h")).groupBy("h").agg(F.collect_list("id").alias("ids")).where(F.size("ids") > 1).orderBy("h").first().ids
    pair = text(twice[0]), text(twice[1])
    assert spark.createDataFrame([(t,) for t in pair], "t string").select(F.hash("t")).distinct().count() == 1
    for d in (None, 5):
        rows = [(d, t, None, None, 1) for t in pair] + [(9, pair[0] + " and more", None, None, 1), (None, pair[0], None, None, 1)]
        docs = documents(spark, rows, extra=False)
        same([(*r[:4], bytes(r.kept)) for r in suffix_dedup.drop_repeated_substrings(docs).collect()], bytes_by_force(rows, 200))
        same([(r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in substring_dedup.drop_repeated_windows(docs).collect()], windows_by_force(rows, 50))
        same(ngram_join.similar_documents(docs).select("doc_id", "class_id", "n_links").collect(), links_by_force(rows))
        assert {r.text for r in ngram_join.one_of_each(docs).collect()} == {pair[0], pair[1]} if d is not None else True


def test_equal_hashes_are_held_against_the_texts(spark, monkeypatch):
    """With hashes that can't tell symbols apart, different passages look equal; that is an error and not a removal."""
    monkeypatch.setattr(anchors, "byte_symbols", lambda: np.ones(256, np.uint64))
    rows = [(i, chr(97 + i) * 300, None, None, 1) for i in range(3)]
    with pytest.raises(Exception, match="different passages have equal hashes"):
        suffix_dedup.drop_repeated_substrings(documents(spark, rows, extra=False)).collect()


def bytes_by_force(rows, n):
    seen = Counter()
    for _, t, *_ in rows:
        b = (t or "").encode()
        seen.update(b[i : i + n] for i in range(len(b) - n + 1))
    for d, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        yield d, len(b), sum(gone), sum(1 for x in bytes(gone).split(b"\0") if x), bytes(x for x, g in zip(b, gone) if not g)


@pytest.mark.parametrize("length, gram", [(200, 32), (40, 8), (30, 9)])
def test_substrings(spark, length, gram):
    out = suffix_dedup.drop_repeated_substrings(documents(spark), length, gram)
    same([(*r[:4], bytes(r.kept)) for r in out.collect()], bytes_by_force(texts(), length))


def test_substrings_of_nothing(spark):
    assert suffix_dedup.drop_repeated_substrings(documents(spark, [])).count() == 0


def test_hot_anchors(spark):
    """A passage in every document makes hot anchors, whose blocks are sliced and spread."""
    rng = random.Random(1)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(90))
    rows = [(i, "".join(rng.choice("abcdefgh ") for _ in range(60)) + shared + "".join(rng.choice("abcdefgh ") for _ in range(50)), None, None, 1) for i in range(700)]
    out = suffix_dedup.drop_repeated_substrings(documents(spark, rows, extra=False), 40, 8)
    same([(*r[:4], bytes(r.kept)) for r in out.collect()], bytes_by_force(rows, 40))
    out = substring_dedup.drop_repeated_windows(documents(spark, [(i, " ".join(t), *r) for i, t, *r in rows], extra=False), 40, 8)
    same([(r.doc_id, r.n_removed) for r in out.collect()], [(r[0], r[2]) for r in windows_by_force([(i, " ".join(t), *r) for i, t, *r in rows], 40)])


def test_equal_suffixes():
    rng = np.random.default_rng(0)
    bodies = [rng.integers(97, 99, 40).astype(np.uint8).tobytes() for _ in range(12)]
    group = np.repeat([0, 1, 2], 4)
    found = suffix_dedup.equal_suffixes(bodies, group, 12)
    for i, b in enumerate(bodies):
        others = Counter(c[k : k + 12] for j, c in enumerate(bodies) if group[j] == group[i] for k in range(len(c) - 11))
        assert found[i].tolist() == [k for k in range(len(b) - 11) if others[b[k : k + 12]] > 1]


def test_large_groups_are_sorted_in_parts():
    rng = np.random.default_rng(3)
    middle = b"g" * 32
    bodies = [rng.integers(97, 123, 168, dtype=np.uint8).tobytes() + middle + rng.integers(97, 123, 168, dtype=np.uint8).tobytes() for _ in range(6_000)]
    bodies[17] = bodies[4_321][:260] + bodies[17][260:]
    tracemalloc.start()
    found = suffix_dedup.equal_suffixes(bodies, np.zeros(len(bodies), np.int64), 200)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {i: f.tolist() for i, f in enumerate(found) if len(f)} == {17: list(range(61)), 4_321: list(range(61))}
    assert most < 60e6  # a million suffixes sorted at once take 105 MB


def test_anchors_do_not_depend_on_the_place(monkeypatch):
    """Equal windows have equal anchors and offsets, in any sequence and also across pieces."""
    monkeypatch.setattr(anchors, "PIECE", 64)
    rng = np.random.default_rng(2)
    shared = anchors.mix(rng.integers(0, 5, 60).astype(np.uint64))
    served = []
    for n in (0, 7, 90):
        s = np.concatenate((anchors.mix(rng.integers(5, 99, n).astype(np.uint64)), shared, anchors.mix(rng.integers(5, 99, 9).astype(np.uint64))))
        at = {}
        for a, _, s0, nw, off, rep in anchors.blocks_of(s, 20, 5):
            for x, y, z, o, r in zip(a, s0, nw, off, rep):
                at |= {y + i: (int(x), int(o) - i % z) for i in range(z * r)}
        served.append([at[n + i] for i in range(41)])
    assert served[0] == served[1] == served[2]


def sets_by_force(rows, n=5):
    for d, t, *_ in rows:
        w = words_of(t)
        yield d, {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def links_by_force(rows, at=0.8):
    sets = list(sets_by_force(rows))
    group, links = list(range(len(sets))), Counter()

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and len(a & b) >= at * len(a | b) - 1e-9:
                links[i] += 1
                links[j] += 1
                group[root(i)] = root(j)
    least = defaultdict(lambda: substring_dedup.LAST)
    for i, (d, _) in enumerate(sets):
        least[root(i)] = min(least[root(i)], substring_dedup.LAST if d is None else d)
    for i, (d, _) in enumerate(sets):
        c = least[root(i)]
        yield d, None if c == substring_dedup.LAST else c, links[i]


def near_copies(n, size=120, seed=0):
    rng = random.Random(seed)
    base = [f"b{rng.randrange(900)}" for _ in range(size)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(size)] = f"n{rng.randrange(9999)}"
        rows.append((i, " ".join(w), None, None, 1))
    return rows


def test_similar(spark):
    out = ngram_join.similar_documents(documents(spark))
    same(out.select("doc_id", "class_id", "n_links").collect(), links_by_force(texts()))
    assert ngram_join.similar_documents(documents(spark, [])).count() == 0


def test_similar_groups_beyond_a_block(spark, monkeypatch):
    """Near copies by the hundred: splitting, dense buckets, pairs of blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK", 50)
    monkeypatch.setattr(ngram_join, "SMALL", 20)
    rows = near_copies(260) + [(1000 + i, t, *r) for i, t, *r in near_copies(40, 30, 1)]
    out = ngram_join.similar_documents(documents(spark, rows, extra=False))
    same(out.select("doc_id", "class_id", "n_links").collect(), links_by_force(rows))


def test_similar_at_the_threshold(spark):
    """Pairs at exactly 0.8 are linked, those of one shingle less are not."""
    rows = []
    for i, (least, most) in enumerate([(12, 15), (24, 30), (28, 35), (44, 55), (1600, 2000), (11, 14), (43, 54), (1599, 2000)]):
        words = [f"p{i}w{j}" for j in range(most + 4)]
        rows += [(10 * i, " ".join(words), None, None, 1), (10 * i + 1, " ".join(words[: least + 4]), None, None, 1)]
    out = ngram_join.similar_documents(documents(spark, rows, extra=False)).collect()
    assert {r.doc_id: r.n_links for r in out} == {d: int(d < 50) for d, *_ in rows}
    same([(r.doc_id, r.class_id, r.n_links) for r in out], links_by_force(rows))


def test_one_of_each(spark):
    docs = documents(spark)
    out = ngram_join.one_of_each(docs)
    assert out.columns == docs.columns
    want = {(d, c) for d, c, _ in links_by_force(texts()) if d == c and d is not None}
    got = [(r.doc_id, r.text) for r in out.collect() if r.doc_id is not None]
    assert {d for d, _ in got} == {d for d, _ in want} and len(got) == len(set(got))


def test_intersections():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, 40)).astype(np.uint64) for _ in range(25)] + [np.arange(3, dtype=np.uint64)]
    got = ngram_join.intersections(sets)
    for i in range(len(sets)):
        for j in range(i):
            assert got[i, j] == len(np.intersect1d(sets[i], sets[j]))
    assert (ngram_join.intersections(sets, 9) == got[:9, 9:]).all()


def test_recall_of_runs():
    met = 0.8 * (1 - 0.2**ngram_join.BRANCHES) ** ngram_join.LEVELS
    runs = ngram_join.runs_for(0.99999999, 0.8)
    assert (1 - met) ** runs <= 1e-8 < (1 - met) ** (runs - 1)


def test_recall_on_planted_pairs(spark):
    """3,000 pairs at 0.8 to 0.82, and as many below: at least 0.99 of the first are found, none of the others."""
    rng, rows, linked = random.Random(5), [], 0
    for i in range(6000):
        size = rng.randrange(40, 120)
        words = [f"p{i}w{j}" for j in range(size + 4)]
        least = -(-8 * size // 10) if i < 3000 else -(-8 * size // 10) - rng.randrange(1, 6)
        rows += [(2 * i, " ".join(words), None, None, 1), (2 * i + 1, " ".join(words[: least + 4]), None, None, 1)]
    found = {r.doc_id: r.n_links for r in ngram_join.similar_documents(documents(spark, rows, extra=False)).collect()}
    assert sum(found[2 * i] == found[2 * i + 1] == 1 for i in range(3000)) >= 0.99 * 3000
    assert not any(found[2 * i] for i in range(3000, 6000))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got[i] for i in range(41)} == {0} and got[100] == got[95] == got[90] == 90
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_shared_folder_is_needed_on_a_cluster():
    class Fake:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "yarn"

    with pytest.raises(ValueError):
        common.shared_dir(Fake)
