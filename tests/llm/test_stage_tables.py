"""What the stages of the pipeline leave in the shared folder."""

from __future__ import annotations

from pathlib import Path

import pytest

import corpus_pipeline
from climagest.sources import shared
from climagest.sources.shared import fresh_path, noted, scratch, settled, shared_folder, written

RESULTS = {"toxicity", "exact-dedup", "near-dedup", "mixing", "encoding"}


def tables(spark) -> set[str]:
    return {path.name for path in Path(shared_folder(spark).removeprefix("file:")).iterdir()}


def label(name: str) -> str:
    return name.rpartition("-")[0]


@pytest.fixture
def folder(spark, tmp_path) -> str:
    rows = [(i, f"document {i} has words of its own {i * 17} and {i * 31}", "en", f"src{i % 7}") for i in range(40)]
    rows += [(50, rows[3][1].upper(), "en", "src1"), (51, rows[3][1] + " " + rows[3][1], "de", None), (None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 1)], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_a_run_leaves_its_result_only(spark, folder, monkeypatch):
    before, beside = tables(spark), []

    def watched(df, name="table"):
        beside.append({label(x) for x in tables(spark) - before} & RESULTS)
        return shared.written(df, name)

    monkeypatch.setattr(corpus_pipeline, "written", watched)
    done = corpus_pipeline.run(spark, folder)
    assert [label(x) for x in tables(spark) - before] == ["encoding"]
    # of earlier results, only the one that is being read
    assert beside == [set(), {"toxicity"}, {"exact-dedup"}, {"near-dedup"}, {"mixing"}]
    assert done.count() > 0 and done.where("doc_id = 3").count() == 0


def test_stages_that_others_write_leave_no_texts(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[1:4]):
        before = tables(spark)
        stage(spark, docs, folder).write.parquet(f"{folder}/{i}")
        left = tables(spark) - before
        assert {label(x) for x in left} <= {"gone", "cutoffs"}
        assert all("text" not in spark.read.parquet(f"{shared_folder(spark)}/{x}").columns for x in left)
        docs = spark.read.parquet(f"{folder}/{i}")
    assert docs.count() > 0


def test_tables_on_the_way_go(spark):
    before = tables(spark)

    def make():
        return written(written(spark.range(5), "first").where("id > 1"), "second").where("id < 4")

    found = settled(spark, make, "third")
    assert sorted(r.id for r in found.collect()) == [2, 3]
    assert [label(x) for x in tables(spark) - before] == ["third"]

    with pytest.raises(ZeroDivisionError):
        settled(spark, lambda: written(spark.range(5), "first").limit(1 // 0), "fourth")
    with scratch(spark):
        assert settled(spark, make, "fifth").count() == 2
    with noted(spark) as outer:
        with noted(spark) as inner:
            path = fresh_path(spark, "sixth")
        assert inner == outer == [path]
    assert [label(x) for x in tables(spark) - before] == ["third"]
