"""What a worker process of the corpus pipeline holds: bounded tables, slices of batches, one kind of memory at a time."""

import numpy as np
import pyarrow as pa

import corpus_pipeline
from courierworks.llm import dedup, quality, shingles
from courierworks.llm.common import ARROW_BYTES, HASH_BYTES, memory
from courierworks.llm.tokens import Encoder, vocabulary_path
from tests.llm.cases import frame, words


def test_powers_of_a_long_text_are_not_kept():
    memory("statistics")  # nothing is held
    assert len(shingles.prefix_sums(np.zeros(0, np.uint8))) == 1  # a worker's first slice may hold empty texts only
    long = np.tile(np.arange(1, 120, dtype=np.uint8), 30_000)
    start = np.array([0, 119, 1190, 2_000_000 // 119 * 119])
    whole = shingles.substring_hash(shingles.prefix_sums(long), start, start + 500)
    short = shingles.substring_hash(shingles.prefix_sums(long[:5000]), start[:3], start[:3] + 500)
    assert len(long) > 3 * HASH_BYTES and len(set(whole.tolist())) == 1 and (short == whole[:3]).all()
    assert sum(t.nbytes for t in memory("powers")["tables"]) <= 16 * (HASH_BYTES + 1)
    for n in (1, 2, 70_000, HASH_BYTES, HASH_BYTES + 1, HASH_BYTES + 2):
        up, down = shingles.powers(n)
        assert len(up) == len(down) == n and (up * down == 1).all() and (up[1:] == up[:-1] * shingles.BASE).all()


def test_a_task_of_another_kind_drops_the_encoder():
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1], pa.int64()), "text": pa.array(["two words"])})
    for other in (lambda: list(quality.measured(iter([batch]))), lambda: shingles.powers(10)):
        encoder = Encoder.load(vocabulary_path())
        assert Encoder.load(vocabulary_path()) is encoder
        other()
        assert Encoder.load(vocabulary_path()) is not encoder


def test_spans_are_cut_slice_by_slice():
    texts = [None, "", *(f"{i} " + "é" * 50_000 for i in range(40))]
    marks = [None, [], *([{"kind": 0, "a": 0, "n": 2 * i + 1}] for i in range(40))]
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("a", pa.int32()), ("n", pa.int32())]))
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(42), pa.int64()), "text": pa.array(texts), "__marks": pa.array(marks, kind)})
    out = list(dedup.stripped(iter([batch]), ["doc_id", "text"], "text"))
    assert len(out) >= 4 and max(b.nbytes for b in out) <= 1.1 * dedup.STRIPPED
    got = pa.Table.from_batches(out)
    assert got["doc_id"].to_pylist() == list(range(42)) and got["text"].to_pylist()[:2] == [None, ""]
    for i, text in enumerate(got["text"].to_pylist()[2:]):
        raw = texts[i + 2].encode()
        assert text.encode() == raw[2 * i + dedup.SPAN:] or text.encode() == raw[2 * i + dedup.SPAN - 1:]


def test_batches_of_the_pipeline_are_bounded_by_bytes(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        for name, stage in corpus_pipeline.STAGES:
            spark.conf.set(key, before)
            docs = frame(spark, [words(80, i) for i in range(5)], clash=False)
            stage(spark, docs, "/root/testdata/sf0.001")
            assert int(spark.conf.get(key)) == ARROW_BYTES, name

        def sizes(batches):
            for batch in batches:
                yield pa.RecordBatch.from_pydict({"size": pa.array([batch.nbytes], pa.int64())})

        rows = spark.range(0, 400, 1, 1).selectExpr("repeat(cast(id as string), 20000) text").mapInArrow(sizes, "size long").collect()
        assert len(rows) > 3 and max(r["size"] for r in rows) < 1.2 * ARROW_BYTES
    finally:
        spark.conf.set(key, before)
