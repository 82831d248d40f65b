"""The stages of the pipeline over a small table, each held against what it should leave."""

import pytest

import corpus_pipeline
from pairloom.llm.common import Scratch
from pairloom.llm.mixing import mix_sources

from .test_overlaps import kept_ids

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out, scratch = corpus_pipeline.documents(spark, SF), [], Scratch(spark, "t")
    for name, stage in corpus_pipeline.STAGES:
        out.append((docs, scratch.save(stage(spark, docs, SF), name)))
        docs = out[-1][1]
    return out


def test_columns(stages):
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "toxicity" and len(stages) == 5
    first = stages[0][0].columns
    assert all(after.columns == first for _, after in stages[:-1])


def test_decisions(spark, stages):
    (docs, clean), (_, single), (_, masked), (_, mixed), (_, encoded) = stages
    assert 0 < clean.count() < docs.count()
    # the stage's rule is a similarity of 0.8 on five words, checked against all pairs
    rows = [tuple(r) for r in clean.select("doc_id", "text").collect()]
    assert sorted(str(r.doc_id) for r in single.select("doc_id").collect()) == kept_ids(rows)
    assert masked.count() == single.count() and masked.filter("text like '%[email]%'").count() > 0
    assert mixed.count() == mix_sources(masked).agg({"copies": "sum"}).first()[0]
    assert encoded.count() == mixed.count() and encoded.filter("not round_trip").count() == 0


def test_run(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    key = lambda df: sorted((r.doc_id, r.ids_sha256) for r in df.select("doc_id", "ids_sha256").collect())
    assert key(got) == key(stages[-1][1])
