"""Sources and sinks on small files, and corpus operators that SQL can't mirror."""

import io
import json
import tarfile

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from framewright.operators import corpus as C
from framewright.operators import dataset as D
from framewright.sources import files as S


def test_episode_files_and_tar(spark, tmp_path):
    t = pa.table({"state": [[1.0, 2.0], [3.0, 4.0]], "other": [1, 2]})
    (tmp_path / "data").mkdir()
    for e in (3, 12):
        pq.write_table(t, tmp_path / "data" / f"episode_{e:06d}.parquet")
    pq.write_table(t, tmp_path / "data" / "notes.parquet")
    x = S.episode_files(spark, str(tmp_path / "data"), ["state"])
    assert x.columns == ["episode", "state"] and sorted({r.episode for r in x.collect()}) == [3, 12]
    with tarfile.open(tmp_path / "all.tar", "w") as tar:
        for e in (3, 12):
            tar.add(tmp_path / "data" / f"episode_{e:06d}.parquet", f"data/episode_{e:06d}.parquet")
        info = tarfile.TarInfo("readme.txt")
        tar.addfile(info, io.BytesIO())
    y = S.tar_episodes(spark, str(tmp_path), "state array<double>, other long")
    assert sorted((r.episode, tuple(r.state)) for r in y.collect()) == sorted((e, s) for e in (3, 12) for s in ((1.0, 2.0), (3.0, 4.0)))
    S.write_episodes(spark.createDataFrame([(1, 0, 2.0), (2, 0, 3.0)], "episode long, frame long, v double"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_json_yaml_markdown(spark, tmp_path):
    (tmp_path / "info.json").write_text(json.dumps({"a": {"b": 1}}, indent=2))
    assert S.json_document(spark, str(tmp_path / "info.json")).select("a.b").first()[0] == 1
    (tmp_path / "e.jsonl").write_text('{"i": 1}\n\n{"i": 2}\n')
    assert S.json_lines(spark, str(tmp_path / "e.jsonl")).count() == 2
    y = S.yaml_list(spark, "papers:\n- id: p1\n  year: 2024\n- id: p2\n", "papers", "id string, year int")
    assert [tuple(r) for r in y.orderBy("id").collect()] == [("p1", 2024), ("p2", None)]
    (tmp_path / "n" / "deep").mkdir(parents=True)
    (tmp_path / "n" / "a.md").write_text("# A\nx\n")
    (tmp_path / "n" / "deep" / "b.md").write_text("# B\n")
    assert S.markdown_files(spark, str(tmp_path / "n")).count() == 1
    assert S.markdown_files(spark, str(tmp_path / "n"), recursive=True).count() == 2


def test_folder_checks_and_sinks(spark, tmp_path):
    d = tmp_path / "set"
    (d / "part").mkdir(parents=True)
    (d / "part" / "x.bin").write_bytes(b"12345")
    (d / "part" / "y.bin").write_bytes(b"")
    assert [tuple(r) for r in S.folder_sizes(spark, str(d)).collect()] == [("part", 2, 5)]
    found = {r.file: r.problem for r in S.missing_files(spark, str(d), ["part/x.bin", "part/y.bin", "z"]).collect()}
    assert found == {"part/y.bin": "empty", "z": "missing"}
    df = spark.createDataFrame([(1, "a")], "i int, s string")
    for _ in range(2):
        S.append_log(df, str(tmp_path / "log"))
    S.write_csv(df, str(tmp_path / "csv"))
    S.write_json(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2 and spark.read.csv(str(tmp_path / "csv"), header=True).count() == 1


def test_links_are_idempotent(spark):
    texts = ["see paper_001, [paper_002], paper_003/004 and 2401.01234.", "[paper_001](https://a.b/paper_001) [2401.01234](https://a.b) 12401.01234", "[paper_001, paper_002]", ""]
    x = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("once", C.linked(F.col("t"))).withColumn("twice", C.linked(F.col("once")))
    rows = x.collect()
    assert all(r.once == r.twice for r in rows) and rows[1].once == rows[1].t
    assert rows[0].once.count("](https://") == 5 and rows[2].once.count("](https://") == 2


def test_links_of_chains_groups_and_neighbours(spark):
    u = "https://example.org/"
    link = lambda x: f"[{x}]({u}{x})"
    cases = {
        "paper_001/002/003.": f"{link('paper_001')}, {link('paper_002')}, {link('paper_003')}.",
        "[paper_001, paper_015, Sec V-A]": f"{link('paper_001')}, {link('paper_015')}, Sec V-A",
        "(2505.15558), 2403.12945": f"({link('2505.15558')}), {link('2403.12945')}",
        "12403.12945 and 2403.129456 and 2403.12945.md and [2403.12945": "12403.12945 and 2403.129456 and 2403.12945.md and [2403.12945",
        "[see paper_001](x) paper_002\nnext [no id] end": f"[see paper_001](x) {link('paper_002')}\nnext [no id] end",
    }
    found = spark.createDataFrame([(t,) for t in cases], "t string").withColumn("once", C.linked(F.col("t"))).withColumn("twice", C.linked(F.col("once"))).collect()
    assert {r.t: r.once for r in found} == cases and all(r.twice == r.once for r in found)


def test_matrix_feed_and_replies(spark):
    lines = ["## RQ1 first", "| [paper_001](u) | direct | yes |", "| name | x | y |", "## RQ2", "| paper_002 | weak | no |"]
    rows = spark.createDataFrame([(0, i, t) for i, t in enumerate(lines)], "doc int, line int, text string")
    assert sorted((r.section, r.paper, tuple(r.cells[1:])) for r in C.matrix_rows(rows).collect()) == [("RQ1 first", "paper_001", ("direct", "yes")), ("RQ2", "paper_002", ("weak", "no"))]
    feed = "<feed><entry><id>http://x/abs/1v2</id><title>T</title></entry><entry><id>b</id></entry></feed>"
    got = spark.createDataFrame([(feed,)], "x string").select(F.explode(C.entries_of_feed(F.col("x"))).alias("e")).select(C.paper_id(F.col("e.id")).alias("i"), "e.title").collect()
    assert [tuple(r) for r in got] == [("1", "T"), ("b", None)]
    reply = json.dumps({"results": [{"id": "W1", "title": "T", "publication_year": 2020, "abstract_inverted_index": {"b": [1], "a": [0, 2]}}, {"id": "W2", "primary_location": {"source": None}}]})
    works = spark.createDataFrame([(reply,)], "x string").select(F.explode(C.works_of(F.col("x"))).alias("w")).select("w.*").collect()
    assert works[0].abstract == "a b a" and works[1].title is None and works[1].venue is None


def test_merge_wants_equal_columns_and_lineage_stops(spark):
    a = spark.createDataFrame([(0, 0, 0)], "episode long, frame long, task_index long")
    tasks = spark.createDataFrame([(0, "t")], "task_index long, task string")
    with pytest.raises(ValueError):
        D.merge([("a", a, tasks), ("b", a.withColumn("z", F.lit(1)), tasks)])
    loop = spark.createDataFrame([("a", 0, "a", 0, 1)], "dataset string, index long, source string, source_index long, trimmed long")
    with pytest.raises(ValueError):
        D.resolve_lineage(loop, 3)


def test_leaving_one_out_can_be_negative(spark):
    rows = [(0, 0, [1.0]), (0, 1, [-1.0]), (1, 0, [0.0]), (1, 1, [0.0])]
    out = {r.episode: r.share for r in D.attribution(spark.createDataFrame(rows, "episode long, frame long, q array<double>")).collect()}
    assert out[1] < 0 < out[0]
    still = spark.createDataFrame([(0, 0, [1.0]), (1, 0, [1.0])], "episode long, frame long, q array<double>")
    assert all(r.share is None for r in D.attribution(still).collect())
