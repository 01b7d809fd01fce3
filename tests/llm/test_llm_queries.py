import pytest
from compare import SF, same

from snapfold.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_duckdb(spark, name):
    same(spark, QUERIES[name], ORACLES[name])


def test_pipeline(spark):
    """Every stage against what it is given: rejected, leaking and repeated documents go, and nothing else does."""
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = None
    for name, stage in p.STAGES:
        out = stage(spark, docs, SF).cache()
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        had = {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids <= had and len(ids) == out.count()
        if name != p.STAGES[-1][0]:
            assert out.columns == p.COLUMNS
        if name == "line dedup":
            assert ids == had
        if name == "SentencePiece encoding and decoding":
            assert ids == had
        docs, before = out, docs
    assert before is not None
