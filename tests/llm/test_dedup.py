import cProfile
import hashlib
import pstats
import random

import numpy as np
import pyarrow as pa

from courierworks.llm import dedup
from courierworks.llm.dedup import _removals
from courierworks.llm.suffixes import permuted_prefixes, suffix_array
from tests.llm.cases import frame, odd_texts, words

SPAN = dedup.SPAN


def plain(texts):
    """Removal by the definition: a set of all windows seen so far, document by document."""
    seen, out = set(), []
    for text in texts:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - SPAN + 1):
            window = raw[i:i + SPAN]
            if window in seen:
                gone[i:i + SPAN] = b"\1" * SPAN
            seen.add(window)
        spans = sum(1 for i in range(len(raw)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest()))
    return out


def test_suffix_array_and_prefixes_of_many_strings():
    rng = random.Random(5)
    for trial in range(150):
        n, letters = rng.randrange(1, 400), rng.choice([1, 2, 3, 20, 250])
        x = np.array([rng.randrange(letters) for _ in range(n)], np.int64)
        if trial % 5 == 0:
            x = np.tile(x[:max(1, n // 7)], 8)
        sa = suffix_array(x)
        raw = x.astype(np.uint8).tobytes()
        assert sa.tolist() == sorted(range(len(x)), key=lambda i: raw[i:])
        common = permuted_prefixes(x.astype(np.uint8), sa, np.zeros(len(x), bool), len(x) + 8)
        for a, b in zip(sa[:-1].tolist(), sa[1:].tolist()):
            k = 0
            while max(a, b) + k < len(x) and raw[a + k] == raw[b + k]:
                k += 1
            assert common[b] == k


def rows(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def test_removal_equals_the_definition(spark):
    texts = odd_texts()
    assert list(dict(sorted(rows(dedup.dedup_documents(frame(spark, texts))).items())).values()) == plain(texts)


def test_hot_hashes_give_the_same_result(spark, monkeypatch):
    passage = words(16, 50)
    texts = [words(20, 100 + i) + " " + passage[: 70 + i % 30] + " " + words(25, 300 + i % 7) for i in range(60)] + odd_texts()[6:18]
    want = plain(texts)
    for hot in (2, 10_000):
        monkeypatch.setattr(dedup, "HOT", hot)
        assert list(dict(sorted(rows(dedup.dedup_documents(frame(spark, texts, clash=False))).items())).values()) == want


def test_pieces_of_long_texts(spark, monkeypatch):
    text = words(9_000, 11)
    texts = [text, words(50, 12) + text[20_000:23_000], text[:500]]
    monkeypatch.setattr(dedup, "PIECE", 4096)
    data = np.frombuffer(texts[0].encode(), np.uint8)
    row, begin, finish = dedup._cut(data, np.array([0]), np.array([len(data)]))
    assert len(row) > 5 and (begin[1:] + SPAN - 1 == finish[:-1]).all()
    assert dedup.dedup_documents(frame(spark, texts)).orderBy("doc_id").collect()[1].n_removed == plain(texts)[1][1]


def test_null_ids_repeated_rows_and_empty_tables(spark):
    text = words(40, 20)
    got = dedup.dedup_documents(frame(spark, [text, text, text], [None, 7, 7])).collect()
    assert sorted((r.doc_id is None, r.n_removed) for r in got) == [(False, len(text.encode())), (False, len(text.encode())), (True, 0)]
    assert dedup.dedup_documents(frame(spark, [])).count() == 0


def test_strip_keeps_columns_and_code_points(spark):
    passage = "".join(chr(0x4E00 + 7 * i) for i in range(60))
    docs = frame(spark, [passage + "a", "b" + passage + "c", None, ""])
    out = dedup.strip_documents(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: r.text for r in out.collect()} == {0: passage + "a", 1: "bc", 2: None, 3: ""}


def test_shared_and_missing_ids_are_told_apart_by_text(spark):
    twice, other = words(60, 1) + " " + words(60, 1), words(80, 2)
    for key in (None, 4):
        rows = [(key, twice), (key, other), (9, other + " tail"), (key, other)]
        docs = frame(spark, [t for _, t in rows], [i for i, _ in rows])
        got = sorted((r.doc_id is None, r.doc_id, r.n_bytes, r.n_removed) for r in dedup.dedup_documents(docs).collect())
        of_other = [g[3] for g in got if g[2] == len(other.encode())]
        assert of_other == [0, 0] and [g[3] for g in got if g[2] == len(twice.encode())] == [len(words(60, 1).encode())]
        assert [g[3] for g in got if g[1] == 9] == [len(other.encode())]
        cut = sorted(r.text for r in dedup.strip_documents(docs).collect())
        assert cut.count(other) == 2 and " tail" in cut


def test_induced_sorting_takes_few_calls():
    """The scan goes over short stretches, so its time is that of the calls made for each."""
    rng = random.Random(4)
    lexicon = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    x = np.frombuffer(" ".join(rng.choice(lexicon) for _ in range(30_000)).encode(), np.uint8).astype(np.int64)
    profile = cProfile.Profile()
    sa = profile.runcall(suffix_array, x)
    text = x.astype(np.uint8).tobytes()
    assert all(text[a:a + 200] <= text[b:b + 200] for a, b in zip(sa[:-1].tolist(), sa[1:].tolist()))
    stats = pstats.Stats(profile)
    placed = next(calls for (_, _, name), (calls, *_) in stats.stats.items() if name == "_place")
    assert stats.total_calls <= 30 * placed


def test_marks_of_rows_without_dictionaries():
    marks = pa.array([None, [(0, 3, 5), (1, 3, 5)], [], [(4, 7, 2)]], pa.list_(pa.struct([("kind", pa.int32()), ("a", pa.int32()), ("n", pa.int32())])))
    assert _removals(marks) == [[], [(0, 3, 5), (1, 3, 5)], [], [(4, 7, 2)]]
    assert _removals(marks.slice(1, 3)) == [[(0, 3, 5), (1, 3, 5)], [], [(4, 7, 2)]]
    assert _removals(marks.slice(0, 1)) == [[]]
