"""The pipeline, stage by stage, each judged on its own input by brute force; and queries against SQL."""

from collections import Counter

import duckdb
import pytest

from framewright.llm import queries
from framewright.llm.common import materialize

from .fixtures import documents
from . import test_dedup, test_models, test_native

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), name)
        out.append((name, docs))
    return out


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def test_columns_stay(stages):
    for _, df in stages[:-1]:
        assert df.columns == stages[0][1].columns


def test_quality(stages):
    before, after = rows(stages[0][1]), rows(stages[1][1])
    passed = {r for r in before if not ((c := test_native.base_counts(r[1]))[0] < 50 or 100 * c[4] > 50 * c[0])}
    assert set(after) <= passed and len(after) > 0.9 * len(passed)


def test_lines(stages):
    want = {d: t for d, _, _, t in test_native.lines_by_force(rows(stages[1][1]))}
    assert {r[0]: r[1] for r in rows(stages[2][1])} == want and all(r[4] == len(r[1]) for r in rows(stages[2][1]))


def test_classes(stages):
    before = rows(stages[2][1])
    assert {r[0] for r in rows(stages[3][1])} == {d for d, c, _ in test_dedup.links_by_force(before) if d == c}


def test_contamination(spark, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    before = rows(stages[3][1])
    assert {r[0] for r in rows(stages[4][1])} == {h[0] for h in test_native.hits_by_force(before, items) if not h[-1]}


def test_packing(stages):
    import public_tokenizers

    from framewright.llm.packing import Encoder

    test_models.whole(stages[5][1].collect(), rows(stages[4][1]), Encoder(public_tokenizers.path("byte_bpe_50k.json")))


def test_stages_on_edge_cases(spark, tmp_path):
    """Nulls in any column, empty and long texts, ties, repeated rows and clashing columns through every stage; then nothing."""
    import corpus_pipeline

    items = spark.createDataFrame(test_native.ITEMS, "item_id long, text string")
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    texts = Counter((r[0], r[1]) for r in documents(spark).select("doc_id", "text").collect())
    docs = documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        every = stage(spark, documents(spark), str(tmp_path))
        assert name == "packing" or every.columns == docs.columns
        if name not in ("line_dedup", "packing"):
            assert not Counter((r.doc_id, r.text) for r in every.select("doc_id", "text").collect()) - texts
        elif name == "line_dedup":
            assert every.count() == docs.count()
        else:
            assert {r[0] for r in every.select("doc_id").distinct().collect()} == {d for d, _ in texts}
        assert stage(spark, documents(spark, []), str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ours, theirs = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLES[name])
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    at = [theirs.columns.index(c) for c in columns]
    test_native.same([tuple(r[c] for c in columns) for r in ours.collect()], [tuple(r[i] for i in at) for r in theirs.fetchall()])


def test_every_operator_has_a_query():
    assert {q.split("_")[0] for q in queries.QUERIES} == {*(f"op{n}" for n in range(1, 11)), "pipeline"}
