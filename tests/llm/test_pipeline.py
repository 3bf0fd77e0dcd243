"""The pipeline's stages on the small tables and on awkward rows."""

from __future__ import annotations

import brute
import pytest

import corpus_pipeline
from filingmill.llm import secrets

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        to = str(tmp_path_factory.mktemp(name) / "t")
        stage(spark, docs, SF).write.parquet(to)
        out.append((docs, docs := spark.read.parquet(to)))
    return out


def test_columns(steps):
    for before, after in steps[:-1]:
        assert after.columns == before.columns and after.dtypes == before.dtypes


def test_language_keeps_nearly_all(steps):
    before, after = steps[0]
    assert before.count() * 0.98 <= after.count() <= before.count()


def test_lines(steps):
    before, after = steps[1]
    true = {d: kept for d, (*_, kept) in brute.line_dedup([(r.doc_id, r.text) for r in before.collect()]).items()}
    assert {r.doc_id: r.text for r in after.collect()} == true


def test_one_of_each_class(steps):
    before, after = steps[2]
    classes, _ = brute.near_classes({r.doc_id: r.text for r in before.collect()})
    assert sorted(r.doc_id for r in after.collect()) == sorted(set(classes.values()))


def test_no_secret_is_left(steps):
    before, after = steps[3]
    assert after.count() == before.count()
    assert not any(brute.base_spans(r.text.replace("<secret>", " ")) for r in after.collect())
    assert secrets.KINDS[3] == "random"


def test_every_document_is_packed(spark, steps):
    before, after = steps[4]
    words = {r.doc_id: len(r.text.split()) for r in before.collect()}
    assert {r.doc_id: r.n for r in after.groupBy("doc_id").sum("n_tokens").toDF("doc_id", "n").collect()} == words
    assert after.groupBy("bin_id").sum("n_tokens").toDF("b", "n").where("b is not null and n > 2048").count() == 0


def test_run_and_awkward_rows(spark, edges, nothing):
    assert corpus_pipeline.run(spark, SF).count() > 0
    for docs in (edges, nothing):
        for name, stage in corpus_pipeline.STAGES:
            done = stage(spark, docs, SF)
            assert name == "packing" or done.columns == docs.columns
            assert done.count() >= (docs is edges)
