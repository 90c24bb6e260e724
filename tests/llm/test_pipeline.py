"""The pipeline's stages, each against what it must do to its own input."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
import pytest
from conftest_llm import plain

from logloom.llm import packing, quality, simhash
from logloom.llm.common import staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SF_DIR = "/root/testdata/sf0.01"


def test_stages(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    docs, seen = spark.read.parquet(f"{SF_DIR}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, staged(stage(spark, docs, SF_DIR))
        seen.append((name, before, docs))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == COLUMNS
    assert [n for n, _, _ in seen] == [
        "quality classifier", "line dedup", "SimHash near-dedup", "mixing sources to target weights", "best-fit packing",
    ]
    _, raw, good = seen[0]
    kept = {r["doc_id"] for r in good.collect()}
    judged = [(labels[r["doc_id"]], r["doc_id"] in kept) for r in raw.collect() if r["doc_id"] in labels]
    assert sum(stays == bool(label) for label, stays in judged) > 0.97 * len(judged)
    scored = quality.classify(raw, spark.read.parquet(f"{SF_DIR}/labels.parquet")).where("predicted = 1")
    assert plain(scored, "doc_id") == plain(good, "doc_id")
    _, before, after = seen[1]
    assert plain(before, "doc_id") == plain(after, "doc_id")
    _, before, after = seen[2]
    groups = {r["component_id"] for r in simhash.near_duplicates(before).collect()}
    assert Counter(r["doc_id"] for r in after.collect()) == Counter(groups)
    _, before, after = seen[4]
    assert sum(r["piece"] == 0 for r in after.collect()) == before.count()


@pytest.mark.parametrize("name", ["messy", "odd", "empty"])
def test_messy_documents(spark, request, tmp_path, name):
    folder = str(tmp_path)
    docs = request.getfixturevalue(name)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(6, 1, 0), (11, 0, 0), (100, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    made = corpus_pipeline.run(spark, folder)
    assert made.columns == [*(x.split()[0] for x in packing.PIECE.split(", ")), "sequence_id", "offset"]
    assert (made.count() > 0) == (name != "empty")
