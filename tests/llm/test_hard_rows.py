"""Every operator on an empty table, a table of nulls, hard rows and clashing column names."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hypso.llm import audio, langid, mixing, neardup, pieces, pii, quality, queries, repeats, sharding

QUERIES = queries.queries()


@pytest.mark.parametrize("name", QUERIES)
def test_empty(spark, empty_dir, name):
    assert QUERIES[name](spark, empty_dir).collect() == []


@pytest.mark.parametrize("name", QUERIES)
def test_nulls(spark, null_dir, name):
    found = QUERIES[name](spark, null_dir).collect()
    assert len(found) == 3 and all(r["doc_id"] is None for r in found)


@pytest.mark.parametrize("name", QUERIES)
def test_hard_rows(spark, mixed_dir, rows, name):
    found = QUERIES[name](spark, mixed_dir)
    assert sorted(str(r["doc_id"]) for r in found.select("doc_id").collect()) == sorted(str(r["doc_id"]) for r in rows)


CLASHING = ["_row", "_text", "_doc", "_t", "_k", "_m", "_p", "_n", "_order", "_bucket", "_source", "size", "target", "positions", "n_words", "kept", "spans", "ids", "decoded", "shard", "slot", "clean_text", "removed", "_hits", "class_id", "score", "a`b", "a.b"]
OPERATORS = {
    "near_dedup": neardup.one_of_each,
    "mixing": lambda d: mixing.mixed(d).select("_row.*"),
    "training_order": mixing.training_order,
    "sharding": sharding.feistel_shards,
    "spans": repeats.without_repeated_spans,
    "language": lambda d: langid.predicted(d, langid.learn(d)),
    "pieces": pieces.encoded,
    "lines": repeats.without_repeated_lines,
    "line_stage": repeats.line_stage,
    "quality": lambda d: quality.judged(d).select("_row.*"),
    "quality_stage": quality.quality_stage,
    "audio": lambda d: audio.recordings(d, "doc_id", audio.text_as_sound(F.col("text"))),
    "pii": pii.personal_data,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_names(spark, mixed_dir, name):
    docs = spark.read.parquet(f"{mixed_dir}/documents.parquet").where("doc_id IS NULL OR doc_id < 40 OR doc_id > 900000")
    extra = docs.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHING)])
    found = OPERATORS[name](extra)
    assert found.count() > 0
    if name in ("near_dedup", "mixing", "training_order", "line_stage", "quality", "quality_stage"):
        assert found.columns == extra.columns
        assert found.select("`a.b`").distinct().collect() == [(CLASHING.index("a.b"),)]


def test_pipeline_on_hard_rows(spark, mixed_dir, empty_dir, tmp_path):
    for folder, some in ((mixed_dir, True), (empty_dir, False)):
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            before = docs.columns
            stage(spark, docs, folder).write.parquet(f"{tmp_path}/{some}{k}")
            docs = spark.read.parquet(f"{tmp_path}/{some}{k}")
            assert (docs.count() > 0) == some
            if k + 1 < len(corpus_pipeline.STAGES):
                assert docs.columns == before
