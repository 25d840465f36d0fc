import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from courierworks.llm import perplexity
from tests.llm.cases import DOCS, frame, odd_texts, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
START = ("start",)


def plain_base(text):
    ws = WORD.findall(text or "")
    windows = Counter(tuple(ws[i:i + 5]) for i in range(len(ws) - 4))
    covered = {i + k for i in range(len(ws) - 4) if windows[tuple(ws[i:i + 5])] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def off(counts):
    n = [sum(c == k for c in counts) for k in range(5)]
    out = []
    for k in (1, 2, 3):
        d = k - (k + 1) * n[1] / (n[1] + 2 * n[2]) * n[k + 1] / n[k] if n[1] and n[k] else 0
        out.append(d if 0 < d < k else k / 2)
    return out


def plain_model(texts, symbols):
    """A function from (context of three, character) to its probability, from dictionaries."""
    tables = [Counter()]
    for text in texts:
        line = [START] * 3 + list(text)
        tables[0].update(tuple(line[i - 3:i + 1]) for i in range(3, len(line)))
    for _ in range(3):
        tables.append(Counter(gram[1:] for gram in tables[-1]))
    cuts = [off(t.values()) for t in tables]
    contexts = []
    for table in tables:
        by = defaultdict(list)
        for gram, n in table.items():
            by[gram[:-1]].append(n)
        contexts.append(by)

    def p(k, gram):
        lower = 1.0 / (symbols + 1) if k == 3 else p(k + 1, gram[1:])
        seen = contexts[k].get(gram[:-1])
        if not seen:
            return lower
        cut = lambda n: 0 if n == 0 else cuts[k][min(n, 3) - 1]
        n = tables[k].get(gram, 0)
        return (max(n - cut(n), 0) + sum(map(cut, seen)) * lower) / sum(seen)

    return lambda gram: p(0, gram)


def plain_bits(texts):
    joined = [" ".join(WORD.findall(t or "")) for t in texts]
    half = [zlib.crc32((t or "").encode()) & 1 for t in texts]
    symbols = len({c for t in joined for c in t})
    models = [plain_model([t for t, h in zip(joined, half) if h != k], symbols) for k in (0, 1)]
    out = []
    for text, h in zip(joined, half):
        line = [START] * 3 + list(text)
        out.append((len(text), -sum(math.log2(models[h](tuple(line[i - 3:i + 1]))) for i in range(3, len(line)))))
    return out


def corpus():
    rng = random.Random(2)
    texts = odd_texts()
    texts[texts.index(words(30_000, 9))] = words(3000, 9)
    return texts + [words(rng.randrange(12, 60), 100 + i, size=50) for i in range(80)] + ["".join(chr(rng.randrange(33, 1000)) for _ in range(90)) + " a b c d e f g h i j k" for _ in range(2)]


@pytest.fixture(scope="module")
def texts():
    return corpus()


@pytest.mark.parametrize("limit", [8_000_000, 0])
def test_base_counts_and_bits_against_dictionaries(spark, texts, limit, monkeypatch):
    monkeypatch.setattr(perplexity, "MODEL_ENTRIES", limit)
    monkeypatch.setattr(perplexity, "HELD", 3000)
    monkeypatch.setattr(perplexity, "SLICE", 5000)
    got = {r.doc_id: r for r in perplexity.measured(frame(spark, texts).repartition(3)).collect()}
    assert len(got) == len(texts)
    for i, (text, (chars, bits)) in enumerate(zip(texts, plain_bits(texts))):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_base(text), text
        assert r.chars == chars and r.bits == pytest.approx(bits, rel=1e-5, abs=1e-6)


def test_probabilities_sum_to_one(texts):
    joined = [" ".join(WORD.findall(t or "")) for t in texts]
    symbols = sorted({c for t in joined for c in t})
    p = plain_model(joined[:40], len(symbols))
    for context in (START, START, START), (START, START, "w"), (" ", "w", "1"), ("ß", "ß", "ß"):
        assert sum(p((*context, c)) for c in [*symbols, "never"]) == pytest.approx(1)


def test_verdicts_follow_the_bands(spark, texts):
    rows = [(i % 200, t, ["en", None, "de"][i % 3] if i < 90 else "en", "s", 0) for i, t in enumerate(texts)] + [(None, texts[30], "en", "s", 0), (40, texts[31], "xx", None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    for name in ("half", "h", "bits", "rate", "chars", "kept", "n", "a", "cell", "middle", "key"):
        docs = docs.withColumn(name, F.lit("clash"))
    got = perplexity.judge(docs).collect()
    assert sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == sorted(plain_base(t) for _, t, *_ in rows)
    bits = plain_bits([t for _, t, *_ in rows])
    judged = defaultdict(list)
    for (_, text, lang, *_), (chars, cost) in zip(rows, bits):
        base = plain_base(text)
        if base[0] >= 10 and 100 * base[4] <= 20 * base[0]:
            judged[lang or ""].append(math.floor(cost / chars * 512))
    limits = {}
    for lang, cells in judged.items():
        if len(cells) >= 30:
            middle = sorted(cells)[(len(cells) - 1) // 2]
            spread = sorted(abs(c - middle) for c in cells)[(len(cells) - 1) // 2]
            limits[lang] = (middle + 0.5) / 512, max(perplexity.LEAST_WIDTH, 1.4826 * perplexity.WIDTH * spread / 512)
    want = []
    for (doc_id, text, lang, *_), (chars, cost) in zip(rows, bits):
        base = plain_base(text)
        failed = base[0] < 10 or 100 * base[4] > 20 * base[0]
        fits = True
        if (lang or "") in limits and chars:
            middle, width = limits[lang or ""]
            fits = abs(cost / chars - middle) <= width * math.sqrt(1 + perplexity.SHORT / chars)
        want.append((str(doc_id), base, failed, not failed and fits))
    assert sorted((str(r.doc_id), (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words), r.base_failed, r.kept) for r in got) == sorted(want)
    assert set(limits) == {"en"} and {k for _, _, f, k in want if not f} == {True, False}


def test_empty_and_one_sided_tables(spark):
    assert perplexity.judge(frame(spark, [])).collect() == []
    one = perplexity.judge(frame(spark, [words(20, 1), words(20, 1)], clash=False)).collect()
    assert [(r.base_failed, r.kept, r.lower) for r in one] == [(False, True, None)] * 2
    assert [(r.n_words, r.base_failed, r.kept, r.perplexity) for r in perplexity.judge(frame(spark, [None, ""])).collect()] == [(0, True, False, None)] * 2
