"""Stages of the pipeline on nulls, ties, repeated rows, clashing columns and empty tables."""

import pytest

import corpus_pipeline
from tests.llm.test_operators import SMALL, prose

KINDS = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [
    (1, prose(1, 90), "en", "src1", 1), (2, prose(1, 90), "en", "src1", 1), (2, prose(1, 90), "en", "src1", 1), (3, None, None, None, None), (4, "", "de", "src2", 0),
    (None, prose(3, 70), "en", "src3", 1), (None, None, None, "src3", None), (5, prose(5, 8000), "fr", None, 1), (6, "one line of text\none line of text", "en", "src1", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, KINDS)


def ids(df):
    return sorted((r.doc_id is None, r.doc_id or 0) for r in df.select("doc_id").collect())


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_take_empty_tables(spark, docs, name, stage):
    out = stage(spark, docs.limit(0), SMALL)
    assert out.count() == 0 and (name == corpus_pipeline.STAGES[-1][0] or out.columns == corpus_pipeline.COLUMNS)


def test_what_each_stage_does_with_its_rows(spark, docs):
    stages = dict(corpus_pipeline.STAGES)
    more = docs.selectExpr("*", "'x' score", "1 predicted", "'y' rep", "2 lines", "3 tokens", "array(4) ids")
    run = lambda name: stages[name](spark, more, SMALL)
    every = ids(docs)
    judged = run("quality classifier")
    assert judged.columns == corpus_pipeline.COLUMNS and set(ids(judged)) <= set(every)
    lines = run("line dedup").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in lines) == every
    assert {r.doc_id: r.text for r in lines if r.doc_id in (1, 2, 3, 6)} == {1: ROWS[0][1], 2: "", 3: "", 6: ROWS[-1][1]} and all(r.n_chars == len(r.text) for r in lines)
    # The copy, the repeated row and the second empty text go; rows without an id stay.
    assert ids(run("MinHash near-dedup")) == [(False, 1), (False, 3), (False, 5), (False, 6), (True, 0), (True, 0)]
    mixed = ids(run("mixing sources to target weights"))
    assert set(mixed) <= {x for x in every if not x[0]} and mixed.count((False, 2)) in (0, 2)
    coded = run("SentencePiece encoding").collect()
    assert len(coded) == len(every) and all(r.n_tokens == len(r.ids) == len(r.ends) for r in coded) and sum(r.n_tokens == 0 for r in coded) == 3
