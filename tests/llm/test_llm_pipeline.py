from __future__ import annotations

import zlib

import pytest

import corpus_pipeline
from basketry.llm import pii, queries, toxicity
from basketry.llm.common import prepare
from test_llm_jaccard import brute as classes
from test_llm_line_dedup import brute as without_lines

NAMES = [name for name, _ in corpus_pipeline.STAGES]


@pytest.fixture(scope="module")
def stages(spark, sample_dir):
    """Rows before the first stage and after each."""
    docs = prepare(spark).read.parquet(f"{sample_dir}/documents.parquet")
    found = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        found.append(stage(spark, spark.createDataFrame(found[-1], docs.schema), sample_dir).collect())
    return found


def test_each_stage_against_a_plain_version(spark, sample_dir, stages):
    raw, clean, lines, unique, masked, packed = stages
    model = queries.toxicity_model(spark, spark.read.parquet(f"{sample_dir}/documents.parquet"), sample_dir)
    scorer = toxicity.Scorer(model.terms, model.worth)
    kept = [r for r in raw if sum(f * w for f, w in zip(scorer.features(r.text), model.weights)) < 0]
    assert sorted(kept) == sorted(clean) and 0 < len(clean) < len(raw)

    want = {doc: text for doc, _, _, text in without_lines([(r.doc_id, r.text) for r in clean])}
    assert {r.doc_id: r.text for r in lines} == want
    assert all(r.n_chars == len(r.text) for r in lines)

    first = {doc for doc, _, least in classes([(r.doc_id, r.text) for r in lines]) if doc == least}
    assert {r.doc_id for r in unique} == first and len(unique) == len(first)

    texts = {r.doc_id: r.text for r in unique}
    for r in masked:
        assert not pii.base_spans(r.text), r.text
        if not pii.windows(texts[r.doc_id]):
            assert r.text == texts[r.doc_id]
    assert {r.doc_id for r in packed} == first
    assert all(r.length <= 2048 for r in packed)


def test_columns(stages):
    for rows in stages[:-1]:
        assert rows[0].asDict().keys() == stages[0][0].asDict().keys()


def test_pieces_hold_their_ids(stages):
    for r in stages[-1]:
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32


def test_run_gives_what_the_stages_give(spark, sample_dir, stages):
    got = corpus_pipeline.run(spark, sample_dir).groupBy("doc_id").agg({"length": "sum"}).collect()
    want = {}
    for r in stages[-1]:
        want[r.doc_id] = want.get(r.doc_id, 0) + r.length
    assert dict(map(tuple, got)) == want


@pytest.mark.parametrize("name", NAMES)
def test_awkward_rows(spark, sample_dir, awkward, nothing, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    for docs in (awkward, awkward.unionAll(awkward), nothing):
        result = stage(spark, docs, sample_dir)
        if name != NAMES[-1]:
            assert result.columns == docs.columns
        assert (result.count() > 0) == (docs is not nothing)
