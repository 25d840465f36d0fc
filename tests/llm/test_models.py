import random
import zlib

import numpy as np
import pyarrow as pa

from courierworks.llm import common, quality, vectors
from tests.llm.cases import frame, odd_texts, words


def test_top_k_equals_all_products(spark):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) * rng.choice([0.1, 1, 3]) for _ in range(8)]) for i in range(160)]
    rows += [(200 + i, rows[7][1]) for i in range(20)] + [(300, None), (301, [None] * 8), (302, [float("nan")] * 8), (303, [float("inf")] * 8), (None, [1.0] * 8), (50, rows[50][1]), (350, [0.0] * 8), (400, [])]
    have = {}
    for key, vec in rows:
        if key is not None and vec is not None and all(x is not None and np.isfinite(x) for x in vec):
            have[key] = [int(np.floor(256 * float(np.float32(x)))) for x in vec] + [0] * (8 - len(vec))
    want = set()
    for q in have:
        if q % 50 == 0:
            order = sorted((-sum(a * b for a, b in zip(have[q], have[c])), c) for c in have if c != q)
            want |= {(q, r + 1, c, -s) for r, (s, c) in enumerate(order[:5])}
    table = spark.createDataFrame([(k, v, "clash", 1) for k, v in rows], "vec_id long, embedding array<float>, score string, rank int")
    assert {tuple(r) for r in vectors.top_k(table).collect()} == want


def test_top_k_over_several_chunks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "HEAD", 16)
    monkeypatch.setattr(vectors, "BLOCK", 3)
    test_top_k_equals_all_products(spark)


def test_top_k_of_few_or_no_vectors(spark):
    table = spark.createDataFrame([(0, [1.0, 2.0]), (50, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert {tuple(r) for r in vectors.top_k(table).collect()} == {(0, 1, 50, 256 * 128 + 512 * 128), (50, 1, 0, 256 * 128 + 512 * 128)}
    assert vectors.top_k(table.limit(0)).count() == 0


def test_huge_components_are_exact():
    a = np.array([[float(1 << 40), 3.0]])
    assert vectors.product(a, np.array([[float(1 << 20), 1.0], [1.0, 1.0]])).tolist() == [[(1 << 60) + 3, (1 << 40) + 3]]


def test_isotonic_is_the_closest_rising_fit():
    assert quality.isotonic(np.array([1.0, 3.0, 2.0, 2.0, 5.0, 4.0]), np.array([1.0, 1, 1, 2, 1, 3])).tolist() == [1.0, 2.25, 2.25, 2.25, 4.25, 4.25]


def test_compression_sees_the_whole_text():
    head = words(12_000, 21).encode()
    assert len(head) > 1 << 16
    for tail in (b" again" * 20_000, words(20_000, 22).encode(), random.Random(4).randbytes(100_000)):
        assert abs(quality.statistics(head + tail)[-1] - len(zlib.compress(head + tail, 1)) / len(head + tail)) < 1e-3
    assert quality.statistics(head[:5000])[-1] == len(zlib.compress(head[:5000], 1)) / 5000


def test_held_out_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    marks = {r.doc_id: r.quality for r in labels.collect()}
    held = [r for r in quality.score_documents(docs, labels).collect() if r.held_out and r.doc_id in marks]
    assert len(held) > 80 and np.mean([r.predicted == marks[r.doc_id] for r in held]) > 0.95
    assert {r.doc_id for r in quality.keep_good(docs, labels).collect()} == {r.doc_id for r in quality.score_documents(docs, labels).where("predicted = 1").collect()}


def test_quality_without_learning_rows_and_with_odd_texts(spark):
    docs = frame(spark, odd_texts() + [words(5, 1)], [*range(len(odd_texts())), None])
    labels = spark.createDataFrame([(1, None, "x"), (None, 1, "x")], "doc_id long, quality int, text string")
    got = quality.score_documents(docs, labels).collect()
    assert len(got) == len(odd_texts()) + 1 and all(r.score == 0.5 and r.predicted == 1 for r in got)
    some = spark.createDataFrame([(i, i % 2, "x") for i in range(20)], "doc_id long, quality int, text string")
    assert all(0 <= r.score <= 1 for r in quality.score_documents(docs, some).collect())
    assert quality.score_documents(frame(spark, []), some).count() == 0
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_labels_of_the_held_out_third_never_matter(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    from pyspark.sql import functions as F

    from courierworks.llm.common import held_out

    turned = labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")).cast("int"))
    order = lambda df: sorted(tuple(r) for r in df.collect())
    assert order(quality.score_documents(docs, labels)) == order(quality.score_documents(docs, turned))


def test_one_array_reaches_the_driver_however_many_partitions_there_are(spark, monkeypatch):
    def work(batches):
        out = np.zeros(1000)
        for batch in batches:
            out += np.asarray(batch.column(0)).sum() * 0.1 + np.arange(1000) / 7
        return out

    df = spark.createDataFrame([(i,) for i in range(500)], "doc_id long")
    arrays = [np.frombuffer(r.part, np.float64) for r in df.repartition(60, "doc_id").mapInArrow(
        lambda batches: [pa.RecordBatch.from_pydict({"part": pa.array([work(batches).tobytes()], pa.binary())})], "part binary").collect()]
    want = arrays[0].copy()
    for one in arrays[1:]:
        want = want + one
    sent = []

    def watched(self, plain=type(df).collect):
        rows = plain(self)
        sent.append(sum(len(x) for r in rows for x in r if isinstance(x, (bytes, bytearray))))
        return rows

    monkeypatch.setattr(type(df), "collect", watched)
    got = common.partials(df, work, "doc_id", 60)
    assert len(arrays) == 60 and got.tobytes() == want.tobytes()
    assert sum(sent) == 8 * 1000
    assert common.partials(df, lambda batches: None, "doc_id", 60) is None
