import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from courierworks.llm import packing, pieces, tokens
from tests.llm.cases import frame, odd_texts, words


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary_path())


def test_files_hold_the_ids_of_the_library(spark):
    texts = odd_texts() + ["<|endoftext|> inside", "don't  stop  here \r\n\r\n x", "  lead", "tail  ", "´¨ ①②③ 🎉🎉"]
    ids = list(range(len(texts)))
    random.Random(1).shuffle(ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tokens.write_and_read(frame(spark, texts, ids)).collect()}
    tokenizer, start = library(), 0
    for key, text in sorted(zip(ids, texts)):
        want = tokenizer.encode(text or "", add_special_tokens=False).ids + [tokens.END]
        assert got[key] == (start, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        start += len(want)
    assert tokens.write_and_read(frame(spark, [])).count() == 0


def test_the_standard_library_cuts_all_but_the_widest_characters(monkeypatch):
    """Cuts equal those of the pattern for all characters, alone and beside others; up to WIDE the slower module is not asked."""
    import public_tokenizers
    import regex

    plain, asked = regex.compile(public_tokenizers.PATTERN).findall, []
    real = regex.compile

    class Watched:
        def __init__(self, pattern):
            self.findall = lambda text, exact=real(pattern).findall: asked.append(text) or exact(text)

    monkeypatch.setattr(regex, "compile", Watched)
    split = tokens._splitter(public_tokenizers.PATTERN)
    every = "".join(chr(i) for i in range(tokens.WIDE) if not 0xD800 <= i < 0xE000)
    rng = random.Random(6)
    mixed = ["".join(rng.choice(["a", "Z", "7", " ", "  ", "'s", "'ll", "'", "_", "-", "\n", "\t", "é", rng.choice(every)]) for _ in range(40)) for _ in range(3000)]
    texts = ["", every, " ".join(every), "x".join(every), "7".join(every), *mixed, "a 🎉 'll b", *odd_texts()]
    for text in texts:
        assert split(text or "") == plain(text or "")
    assert asked and all(max(text) >= chr(tokens.WIDE) for text in asked)


def test_small_shards_give_the_same_starts(spark, tmp_path):
    docs = frame(spark, [words(30 + i % 9, i) for i in range(80)], [3 * i - 50 for i in range(80)])
    want = sorted(tuple(r) for r in tokens.write_and_read(docs).collect())
    tokens.write_tokens(docs, str(tmp_path / "t"), shard_tokens=300)
    shards = spark.read.schema(tokens.SHARD).parquet(str(tmp_path / "t"))
    assert shards.count() > 20 and sorted(tuple(r) for r in tokens.read_tokens(shards).collect()) == want


def test_any_id_is_read_without_decoding_blocks():
    rng = random.Random(2)
    for ids in ([], [0], [255, 256, 65535, 65536, 1 << 31], [rng.randrange(1 << rng.choice([4, 9, 17, 30])) for _ in range(5000)]):
        codes = tokens.Codes(tokens.pack(np.array(ids, np.uint32)))
        assert codes.range(0, len(ids)).tolist() == ids
        assert [codes.get(i) for i in range(0, len(ids), 7)] == ids[::7]
        for _ in range(20):
            a = rng.randrange(len(ids) + 1)
            b = rng.randrange(a, len(ids) + 1)
            assert codes.range(a, b).tolist() == ids[a:b]
        with pytest.raises(IndexError):
            codes.get(len(ids))


def test_boundaries_have_the_least_padding():
    from itertools import combinations

    rng = random.Random(4)
    for _ in range(20):
        tops = sorted(rng.sample(range(1, 60), 7))
        cells = [(t, n := rng.randrange(1, 9), n * t) for t in tops]
        cost = lambda cut: sum(n * (min(c for c in cut if c >= t) - t) for t, n, _ in cells)
        for k in (1, 2, 3, 9):
            cut = packing.boundaries(cells, k)
            assert len(cut) <= k and cost(cut) == min(cost((*c, tops[-1])) for c in combinations(tops[:-1], min(k, 7) - 1))


def test_batches_keep_the_budget_and_every_document(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice([3, 3, 3, rng.randrange(1, 500), 9000])) for i in range(3000)] + [(None, None), (5, 3), (5, 3)]
    packed = packing.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long"), buckets=5, budget=4000)
    got = packed.collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in got) == sorted((i or -1, n or 0) for i, n in rows)
    sizes: dict = {}
    for r in got:
        assert r.n_tokens <= r.bucket_tokens and r.padding == r.bucket_tokens - r.n_tokens
        sizes.setdefault(r.batch, []).append(r)
    assert len({r.bucket for r in got}) == 5
    assert all(len({r.bucket for r in b}) == 1 and (len(b) == 1 or sum(r.bucket_tokens for r in b) <= 4000) for b in sizes.values())
    assert packing.batches(packed).count() == len(sizes)


def test_lengths_are_those_of_the_library(spark):
    tokenizer = library()
    got = {r.doc_id: r.n_tokens for r in packing.pack_documents(frame(spark, odd_texts())).collect()}
    assert got == {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in enumerate(odd_texts())}
    assert packing.pack_documents(frame(spark, [])).count() == 0


def unigram():
    """The library's own Viterbi search over the pieces of the model, as a stand-in for brute force."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(pieces.model_path(), "rb") as file:
        model.ParseFromString(file.read())
    model.trainer_spec.model_type = 1
    for piece in model.pieces:  # scores of -1e9 swamp the library's 32-bit sums
        piece.score = max(piece.score, -1e5)
    out = sentencepiece.SentencePieceProcessor()
    out.LoadFromSerializedProto(model.SerializeToString())
    return out


def test_pieces_are_those_of_a_plain_viterbi(spark):
    library_ = unigram()
    texts = ["Hello world", "a  b   c", " lead and tail ", "naïve café déjà vu", "the quick brown fox jumps", "x" * 60, "an internationalization", "Привет мир", words(12, 3)]
    loaded = pieces.Pieces.load(pieces.model_path())
    for text, code in zip(texts, loaded.encode(texts)):
        assert np.frombuffer(code, "<i4").tolist() == library_.encode(text), text


def test_scores_are_the_best_of_all_cuts():
    loaded = pieces.Pieces.load(pieces.model_path())
    score = {}
    for length, (keys, scores, ids) in loaded.lengths.items():
        score |= {loaded.bytes[i].decode(): s for i, s in zip(ids.tolist(), scores.tolist())}

    def best(word):
        top = {0: 0.0}
        for end in range(1, len(word) + 1):
            top[end] = max([top[k] + score[word[k:end]] for k in range(end) if word[k:end] in score], default=top[end - 1] + loaded.unknown_score)
        return top[len(word)]

    for word in ("▁hello", "▁unbelievable", "▁xqzt", "zzzzzzz"):
        ids = np.frombuffer(loaded.viterbi([word])[0], "<i4").tolist()
        assert sum(score[loaded.bytes[i].decode()] for i in ids) == best(word.replace("▁", " "))


def test_decoding_returns_every_text(spark):
    texts = odd_texts() + ["▁ literal ▁▁ marks", " ", "  two", "tab\tand\r\nline", "🎉 emoji", " ", "á"]
    encoded = pieces.encode(frame(spark, texts))
    got = {r.doc_id: r for r in encoded.collect()}
    assert all(r.round_trip and r.n_ids == len(r.ids) for r in got.values()) and got[0].n_ids == 0
    assert {r.doc_id: r.text for r in pieces.decode(encoded).collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert pieces.encode(frame(spark, [])).count() == 0


def test_rows_of_one_id_and_without_id_over_many_shards(spark, tmp_path):
    texts = [words(200, 1), words(200, 2), words(30, 3), words(10, 4), words(10, 4), None, words(50, 5)]
    ids = [7, 7, 7, None, None, None, 9]
    tokens.write_tokens(frame(spark, texts, ids), str(tmp_path / "t"), shard_tokens=150)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tokens.read_tokens(spark.read.schema(tokens.SHARD).parquet(str(tmp_path / "t"))).collect())
    tokenizer = library()
    want = {}
    for key, text in zip(ids, texts):
        code = tokenizer.encode(text or "", add_special_tokens=False).ids + [tokens.END]
        want.setdefault(key, []).append((len(code), zlib.crc32(np.array(code, "<u4").tobytes())))
    at = 0
    for start, _, n, _ in got:
        assert start == at
        at += n
    assert [g[1] for g in got] == [None, None, None, 7, 7, 7, 9]
    for key, rows in want.items():
        assert sorted(g[2:] for g in got if g[1] == key) == sorted(rows)


def test_counts_are_those_of_the_ids():
    encoder = tokens.Encoder(tokens.vocabulary_path())
    texts = [x or "" for x in odd_texts()] + ["<|endoftext|> inside", "a  b \n c"]
    assert encoder.count(texts) == [len(x) // 4 for x in encoder.encode(texts)] == [len(library().encode(x, add_special_tokens=False).ids) for x in texts]


def test_buckets_over_the_whole_histogram_and_refined_cells(spark, monkeypatch):
    rng = random.Random(6)
    lengths = [int(rng.lognormvariate(6, 1)) for _ in range(4000)]
    df = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, n_tokens long")
    cells = sorted((n, lengths.count(n), n * lengths.count(n)) for n in set(lengths))
    padding = lambda tops: sum(min(t for t in tops if t >= n) - n for n in lengths)
    least = padding(packing.boundaries(cells, 8))
    got = packing.pack(df, 8).collect()
    assert sum(r.padding for r in got) == least and len(got) == len(lengths)
    monkeypatch.setattr(packing, "EXACT", 100)
    monkeypatch.setattr(packing, "FINE", 4)
    coarse = padding(packing.boundaries(packing.histogram(df), 8))
    got = packing.pack(df, 8).collect()
    assert least <= sum(r.padding for r in got) <= coarse and sum(r.padding for r in got) < least + (coarse - least) / 2


def test_boundaries_come_from_every_length_however_many_there_are(spark):
    rng = np.random.default_rng(7)
    lengths = np.concatenate([rng.choice(np.arange(1, 60_000), packing.EXACT + 500, False), rng.choice([90_001, 90_002, 90_400], 3000)])
    tops, counts = np.unique(lengths, return_counts=True)
    assert len(tops) > packing.EXACT
    docs, tokens = (np.concatenate([[0], np.cumsum(x)]) for x in (counts, tops * counts))
    least = tops * docs[1:] - tokens[1:]  # of one bucket over the first i + 1 lengths
    for _ in range(3):
        before = np.concatenate([[0], least])
        least = np.array([(before[:i + 1] + tops[i] * (docs[i + 1] - docs[:i + 1]) - (tokens[i + 1] - tokens[:i + 1])).min() for i in range(len(tops))])
    rows = spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths)], "doc_id long, n_tokens long")
    packed = packing.pack(rows, 4)
    got = packed.agg(F.sum("padding"), F.count("*"), F.sum("n_tokens")).first()
    assert tuple(got) == (least[-1], len(lengths), lengths.sum())


def test_boundaries_are_those_of_all_pairs():
    rng = random.Random(3)
    for _ in range(300):
        tops = sorted(rng.sample(range(60), rng.randrange(1, 30)))
        cells = [(t, d, t * d - rng.randrange(min(t + 1, 3))) for t in tops for d in [rng.randrange(1, 4)]]
        buckets = rng.randrange(1, 9)
        padding = lambda low, high: sum(cells[high - 1][0] * d - k for _, d, k in cells[low:high])
        best = {0: (0, [])}
        for _ in range(buckets):
            best = {end: min([(best[s][0] + padding(s, end), s, best[s][1] + [tops[end - 1]]) for s in range(end) if s in best])[::2] for end in range(1, len(tops) + 1)} | {0: (0, [])}
        got = packing.boundaries(cells, buckets)
        assert len(got) <= buckets and got[-1] == tops[-1]
        at = [0] + [tops.index(t) + 1 for t in got]
        assert sum(padding(a, b) for a, b in zip(at, at[1:])) == best[len(tops)][0]


def test_ids_are_those_of_the_library_for_any_characters():
    rng = random.Random(5)
    pool = [chr(i) for i in range(0x300)] + list("Ⅰ〇一  ​́١😀") + list(" '_stlvre \n\n  ") * 8
    texts = ["".join(rng.choices(pool, k=rng.randrange(40))) for _ in range(4000)]
    encoder = tokens.Encoder(tokens.vocabulary_path())
    want = [code.ids for code in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == want
    assert encoder.count(texts) == [len(x) for x in want]


def test_new_pieces_go_to_the_model_without_a_second_cut():
    """The pieces of ordinary texts are cut once: the library's own splitter, most of the time of a new piece, is left to line ends."""
    encoder, want = tokens.Encoder(tokens.vocabulary_path()), library()

    class Refuses:
        def encode(self, text, **_):
            assert "\n" in text, text
            return want.encode(text, add_special_tokens=False)

        def encode_batch_fast(self, texts, **_):
            raise AssertionError(texts)

    encoder.tokenizer = Refuses()
    texts = [x for x in odd_texts() if x] + ["a  b \n c", "\x00\x7f\x85\xa0\xad tab\t", "naïve 北京 🎉 don't", words(3000, 5)]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [want.encode(x, add_special_tokens=False).ids for x in texts]
