import hashlib

from courierworks.llm import fingerprints
from tests.llm.cases import frame, odd_texts, words
from pyspark.sql import functions as F


def apart(a, b):
    return bin(int(a, 16) ^ int(b, 16)).count("1")


def test_edited_texts_and_likeness(spark):
    texts = odd_texts()
    got = {r.doc_id: r for r in fingerprints.fingerprint_documents(frame(spark, texts, [10 * i for i in range(len(texts))]), every=20).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        text, after = text or "", texts[(i + 1) % len(texts)] or ""
        r, cut = got[10 * i], len(text) // 4
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256((text[:len(text) - cut] + after[:cut]).encode()).hexdigest()
        assert r.near_edited == 1 - apart(r.fingerprint, r.edited_fingerprint) / 64
        assert r.near_next == 1 - apart(r.fingerprint, got[10 * ((i + 1) % len(texts))].fingerprint) / 64
        near = sum(apart(r.fingerprint, o.fingerprint) <= fingerprints.RADIUS for o in got.values()) - 1
        assert r.near_docs == (near if i % 2 == 0 else None)
    assert got[60].fingerprint == got[70].fingerprint and got[10].fingerprint == "0" * 16


def test_votes_equal_a_plain_sum(spark):
    text = words(50, 3)
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    terms = df.select(F.explode(fingerprints.terms(F.col("text"))).alias("t")).select("t.h", "t.w").collect()
    bits = sum(1 << b for b in range(64) if sum(r.w if r.h >> b & 1 else -r.w for r in terms) > 0)
    assert fingerprints.voted(df, ["doc_id"], "text").first().fp % (1 << 64) == bits


def test_every_neighbour_within_the_radius_is_found(spark):
    import random

    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(20)]
    values = [b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(6))) for b in base for _ in range(12)] + base[:5]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    table = spark.createDataFrame([(v,) for v in signed], "fp long")
    got = {r.fp: r.near for r in fingerprints.within_radius(table, table).collect()}
    assert got == {s: sum(bin(v ^ o).count("1") <= 3 for o in values) for s, v in zip(signed, values)}


def test_null_ids_repeated_rows_one_row_and_none(spark):
    rows = fingerprints.fingerprint_documents(frame(spark, ["a b c d", "e f g h", "e f g h"], [None, 4, 4])).collect()
    assert sorted((r.doc_id is None, r.n_chars) for r in rows) == [(False, 7), (True, 7)]
    alone = fingerprints.fingerprint_documents(frame(spark, ["one two three"], [50])).first()
    assert alone.near_next == 1.0 and alone.near_docs == 0
    assert fingerprints.fingerprint_documents(frame(spark, [])).count() == 0


def test_no_python_in_the_plan(spark):
    plan = fingerprints.fingerprint_documents(frame(spark, odd_texts()))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
