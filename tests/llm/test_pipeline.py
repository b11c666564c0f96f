"""The pipeline against a plain version of its stages, and on odd rows."""

from collections import Counter

import corpus_pipeline as pipeline
import pytest
from test_against_brute_force import grouped, plain

from fleetseal.llm import toxicity

COLUMNS = list(pipeline.COLUMNS)


def staged(spark, docs, sf, upto, tmp_path):
    for k, (name, step) in enumerate(pipeline.STAGES[:upto]):
        step(spark, docs, sf).write.parquet(f"{tmp_path}/{k}-{name}")
        docs = spark.read.parquet(f"{tmp_path}/{k}-{name}")
    return docs


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    folder, out = tmp_path_factory.mktemp("stages"), [spark.read.parquet(f"{sf}/documents.parquet")]
    for name, step in pipeline.STAGES:
        step(spark, out[-1], sf).write.parquet(f"{folder}/{name}")
        out.append(spark.read.parquet(f"{folder}/{name}"))
    return out


def test_stages_against_plain_versions(spark, sf, stages):
    docs, clean, single, masked, mixed, packed = stages
    assert all(s.columns == COLUMNS for s in stages[:5])
    model = toxicity.fit(toxicity.labelled_sample(docs, spark.read.parquet(f"{sf}/labels.parquet")), 3)
    flagged = {r.doc_id for r in toxicity.grade(docs, model).filter("toxic").collect()}
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in clean.collect()} == flagged
    kept = sorted((r.doc_id, r.text) for r in clean.collect())
    assert sorted(r.doc_id for r in single.collect()) == sorted({c for _, _, c in grouped(kept)})
    before = {r.doc_id: r.text for r in single.collect()}
    for r in masked.collect():
        assert plain(before[r.doc_id]) == [] and r.text == before[r.doc_id] or plain(r.text) == [] and r.n_chars == len(r.text)
    taken = Counter(r.doc_id for r in mixed.collect())
    assert set(taken) <= {r.doc_id for r in masked.collect()} and max(taken.values()) <= 3
    assert Counter(r.doc_id for r in packed.filter("piece = 0").collect()) == taken


def test_odd_rows_pass_through(spark, sf, odd_docs, tmp_path):
    docs = odd_docs.withColumn("lang", odd_docs["source"])
    out = staged(spark, docs, sf, 5, tmp_path)
    assert out.count() >= 1
    empty = staged(spark, docs.filter("false"), sf, 5, tmp_path / "none")
    assert empty.count() == 0
