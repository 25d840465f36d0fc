import pytest

import corpus_pipeline
from courierworks.llm.queries import ORACLES, QUERIES
from courierworks.llm import quality
from tests.compare import rows_of
from tests.llm.test_dedup import plain as plain_spans
from tests.llm.test_jaccard import plain as plain_classes

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_their_sql(name, spark, duck):
    df = QUERIES[name](spark, SMALL)
    columns, rows = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = duck.execute(ORACLES[name])
    assert (columns, rows) == rows_of([d[0] for d in result.description], result.fetchall())


def test_whole_pipeline_against_plain_code(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    good = {r.doc_id for r in quality.score_documents(docs, labels).where("predicted = 1").collect()}
    left = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect() if r.doc_id in good]
    first = plain_classes([t for _, t in left], [i for i, _ in left])
    left = [(i, t) for i, t in left if first[i][0] == i]
    out, work = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        work = corpus_pipeline.stage(stage(spark, work, SMALL))
        out[name] = work
    assert set(out["quality"].columns) == set(out["suffix_dedup"].columns) == set(docs.columns)
    assert {r.doc_id for r in out["jaccard"].collect()} == {i for i, _ in left}
    spans = {i: s for (i, _), s in zip(left, plain_spans([t for _, t in left]))}
    for r in out["suffix_dedup"].collect():
        size, gone, count, _ = spans[r.doc_id]
        assert r.n_chars == len(r.text) and size - gone <= len(r.text.encode()) <= size - gone + 6 * count
    packed = corpus_pipeline.run(spark, SMALL).collect()
    assert sorted(r.doc_id for r in packed) == [i for i, _ in left]
