"""Quality rules: counts on each text, and perplexity bands from a modified Kneser-Ney model of the corpus.

The model is one of characters: four in a row, over a text's words joined by single spaces. Spark counts all grams of all documents, and
continuation counts, discounts and interpolated probabilities are joins and windows over the table of distinct grams. The documents fall into
two halves by a digest of their text; each half is scored by the model of the other, so that no document vouches for itself, and copies
of a text, which share its half, do not either. The probabilities of the grams that a half holds end as arrays sorted by hash.

The arrays are sent to the workers while they hold at most MODEL_ENTRIES grams, which is counted first; beyond that the grams of the
documents are joined with the table, with the same result. Bands are the median of a language's bits per character plus and minus a multiple of its
median deviation, both exact on a grid of 1/GRID bit.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courierworks.llm.common import slices, stage
from courierworks.llm.shingles import mix
from courierworks.operators.keyed import join_checked

ORDER = 4
START = 0x110000  # stands before the first character; no character has this code
MIN_WORDS = 10
REPEAT_PERCENT = 20
WINDOW = 5
SYMBOLS = b"#*$%&|<>"
MODEL_ENTRIES = 8_000_000  # 12 bytes each
GRID = 512
WIDTH = 5.0  # deviations that a band reaches to either side
LEAST_WIDTH = 0.15  # bits; for languages whose documents are all alike
SHORT = 400.0  # characters at which a text's own chance doubles the squared width of its band
MIN_DOCS = 30  # judged documents that a language needs for a band
SLICE = 4 << 20
HELD = 2_000_000  # distinct grams that a counting task holds before it hands them on
_TAIL = bytes(b for b in range(256) if b & 0xC0 != 0x80)
BASE = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of WINDOW words that occur twice or more in the text, the first occurrence included."""
    if len(words) <= WINDOW:
        return 0
    one = pd.factorize(np.array(words, dtype=object))[0].astype(np.int64)
    name = one
    for width in range(1, WINDOW):  # the windows of width + 1 get exact names from those of width
        name = name[:-1] * len(one) + one[width:]
        name = np.unique(name, return_inverse=True)[1] if width + 1 < WINDOW else name
    values, inverse, times = np.unique(name, return_inverse=True, return_counts=True)
    if len(values) == len(name):
        return 0
    at = np.flatnonzero(times[inverse] > 1)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + WINDOW, -1)
    return int((np.cumsum(change) > 0).sum())


def base_counts(text: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    joined = b"".join(words)
    lines = [line for line in text.split(b"\n") if line.strip()]  # as bytes.split, strip takes ASCII white space
    return (len(words), len(joined) - len(joined.translate(None, _TAIL)), len(text) - len(text.translate(None, SYMBOLS)),
            len(lines) - len(set(lines)), repeated_words(words))


def gram_table(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct grams as rows of ORDER codes, gram at every character, characters of every text)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    padded = np.full(len(codes) + (ORDER - 1) * len(texts), START, np.int64)
    place = np.arange(len(codes)) + (ORDER - 1) * (owner + 1)
    padded[place] = codes
    if not len(codes):
        return np.zeros((0, ORDER), np.int64), np.zeros(0, np.int64), sizes
    alphabet = np.flatnonzero(np.bincount(padded, minlength=START + 1))
    small = np.zeros(START + 1, np.int64)
    small[alphabet] = np.arange(len(alphabet))
    coded = small[padded]
    pairs, pair = _dense(coded[:-1] * len(alphabet) + coded[1:], len(alphabet) ** 2)
    grams, gram = _dense(pair[place - 3] * len(pairs) + pair[place - 1], len(pairs) ** 2)
    left, right = pairs[grams // len(pairs)], pairs[grams % len(pairs)]
    a = len(alphabet)
    return alphabet[np.stack([left // a, left % a, right // a, right % a], axis=1)], gram, sizes


def _dense(values: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, ascending, and the number of each value among them); by a table where that is small."""
    if bound > 1 << 24:
        return np.unique(values, return_inverse=True)
    there = np.flatnonzero(np.bincount(values, minlength=bound))
    number = np.zeros(bound, np.int64)
    number[there] = np.arange(len(there))
    return there, number[values]


def gram_hash(grams: np.ndarray) -> np.ndarray:
    """64-bit hash of each row of ORDER codes."""
    g = grams.astype(np.uint64)
    return mix(mix(g[:, 0] | g[:, 1] << np.uint64(21) | g[:, 2] << np.uint64(42)) ^ g[:, 3] * np.uint64(0x9E3779B97F4A7C15))


def _split(batch: pa.RecordBatch, column: int) -> tuple[list[bytes], list[list[bytes]], list[str], np.ndarray]:
    """(texts, their words, words joined by spaces, half) of a slice."""
    texts = batch.column(column).cast(pa.binary()).to_pylist()
    words = [text.split() for text in texts]
    return texts, words, [b" ".join(w).decode() for w in words], np.array([zlib.crc32(text) & 1 for text in texts], np.int64)


def gram_counts(docs: DataFrame) -> DataFrame:
    """a, b, c, d, n0, n1 of every distinct gram: its codes and how often each half holds it; `docs` has doc_id, lang, text."""

    def merged(held):
        grams, halves = np.concatenate([g for g, _ in held]), np.concatenate([n for _, n in held])
        _, first, number = np.unique(gram_hash(grams), return_index=True, return_inverse=True)
        total = np.zeros((len(first), 2), np.int64)
        np.add.at(total, number, halves)
        return grams[first], total

    def batch_of(grams, total):
        for lo in range(0, len(grams), 100_000):
            columns = [*grams[lo:lo + 100_000].T.astype(np.int32), *total[lo:lo + 100_000].T]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["a", "b", "c", "d", "n0", "n1"])

    def run(batches):
        held, size = [], 0
        for batch in slices(batches, 2, SLICE):
            if not batch.num_rows:
                continue
            _, _, texts, half = _split(batch, 2)
            grams, gram, sizes = gram_table(texts)
            side = np.repeat(half, sizes)
            held.append((grams, np.stack([np.bincount(gram[side == h], minlength=len(grams)) for h in (0, 1)], axis=1)))
            size += len(grams)
            if size > HELD:
                held = [merged(held)]
                size = len(held[0][0])
                if size > HELD // 2:
                    yield from batch_of(*held[0])
                    held, size = [], 0
        if held:
            yield from batch_of(*merged(held))

    counted = docs.mapInArrow(run, "a int, b int, c int, d int, n0 long, n1 long")
    return counted.groupBy("a", "b", "c", "d").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Discounts for counts of one, two, and three or more; k / 2 where the counts of counts give none that keeps probabilities above zero."""
    of = [n1, n2, n3, n4]
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    found = [k - (k + 1) * y * of[k] / of[k - 1] if of[k - 1] else 0.0 for k in (1, 2, 3)]
    return tuple(d if 0 < d < k else k / 2 for k, d in zip((1, 2, 3), found))


def _by_half(values: dict[int, float]) -> Column:
    """The value of a row's half."""
    return F.when(F.col("half") == 0, F.lit(float(values[0]))).otherwise(F.lit(float(values[1])))


def _discounted(levels: dict[int, tuple[float, float, float]]) -> tuple[Column, list[Column]]:
    """(the part of count n that stays, the discounts as columns)."""
    d = [_by_half({h: levels[h][k] for h in (0, 1)}) for k in range(3)]
    n = F.col("n")
    off = F.when(n == 0, 0.0).when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2])
    return F.greatest(n - off, F.lit(0.0)), d


def _count_counts(level: DataFrame) -> dict[int, dict]:
    """Per half: the counts of counts one to four, of three and more, and the sum."""
    of = lambda test: F.count(F.when(test, 1))
    n = F.col("n")
    rows = level.groupBy("half").agg(*[of(n == k).alias(f"n{k}") for k in (1, 2, 3, 4)], of(n >= 3).alias("more"), F.sum("n").alias("total"), F.count("*").alias("rows"))
    found = {r.half: r.asDict() for r in rows.collect()}  # two rows
    return {h: found.get(h, dict.fromkeys(("n1", "n2", "n3", "n4", "more", "total", "rows"), 0)) for h in (0, 1)}


def gram_bits(counts: DataFrame) -> DataFrame:
    """half, a, b, c, d, bits: the cost of every gram that a half holds, by the model of the other half; `counts` is a written table."""
    side = lambda h: F.struct(F.lit(h).alias("half"), F.col(f"n{1 - h}").alias("n"), (F.col(f"n{h}") > 0).alias("here"))
    rows = counts.select("a", "b", "c", "d", F.explode(F.array(side(0), side(1))).alias("at")).select("a", "b", "c", "d", "at.*")
    names = ["a", "b", "c", "d"]
    levels = [rows]
    for k in range(1, ORDER):
        levels.append(stage(levels[-1].groupBy("half", *names[k:]).agg(F.count(F.when(F.col("n") > 0, 1)).alias("n"))))
    lowest = levels[-1]
    of = _count_counts(lowest)
    stays, d = _discounted({h: discounts(*(of[h][f"n{k}"] for k in (1, 2, 3, 4))) for h in (0, 1)})
    total = _by_half({h: of[h]["total"] or 0 for h in (0, 1)})
    free = sum((d[k] * _by_half({h: of[h][c] for h in (0, 1)}) for k, c in enumerate(("n1", "n2", "more"))), F.lit(0.0))
    even = _by_half({h: 1.0 / (of[h]["rows"] + 1) for h in (0, 1)})  # the characters of both halves and one for any other
    p = lowest.select("half", "d", F.when(total > 0, (stays + free * even) / total).otherwise(even).alias("lower"))
    for k in range(ORDER - 2, -1, -1):
        level, suffix = levels[k], names[k + 1:]
        of = _count_counts(level)
        stays, d = _discounted({h: discounts(*(of[h][f"n{i}"] for i in (1, 2, 3, 4))) for h in (0, 1)})
        context = Window.partitionBy("half", *names[k:-1])
        n = F.col("n")
        times = [F.count(F.when(n == 1, 1)).over(context), F.count(F.when(n == 2, 1)).over(context), F.count(F.when(n >= 3, 1)).over(context)]
        free = d[0] * times[0] + d[1] * times[1] + d[2] * times[2]
        extra = ["here"] if k == 0 else []
        level = level.select("half", *names[k:], *extra, stays.alias("stays"), free.alias("free"), F.sum("n").over(context).alias("total"))
        p = level.join(p, ["half", *suffix]).select(
            "half", *names[k:], *extra, F.when(F.col("total") > 0, (F.col("stays") + F.col("free") * F.col("lower")) / F.col("total")).otherwise(F.col("lower")).alias("lower"))
    return p.where("here").select("half", *names, (-F.log2("lower")).alias("bits"))


def hashed(bits: DataFrame) -> DataFrame:
    """half, h, bits: the grams by their hash."""

    def run(batches):
        for batch in batches:
            grams = np.stack([np.asarray(batch.column(c)) for c in ("a", "b", "c", "d")], axis=1) if batch.num_rows else np.zeros((0, ORDER), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("half"), pa.array(gram_hash(grams).view(np.int64)), batch.column("bits").cast(pa.float32())], ["half", "h", "bits"])

    return bits.mapInArrow(run, "half int, h long, bits float")


def _sorted_arrays(model: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hashes, ascending, and bits) of each half; the model was counted before."""
    table = model.toArrow()
    half, h, bits = (np.asarray(table.column(c).combine_chunks()) for c in range(3)) if table.num_rows else (np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.float32))
    out = []
    for k in (0, 1):
        keys, values = h[half == k].view(np.uint64), bits[half == k]
        order = np.argsort(keys)
        out.append((keys[order], values[order]))
    return out


def _base_columns(batch: pa.RecordBatch, texts: list[bytes], words: list[list[bytes]]) -> list[pa.Array]:
    counted = np.array([base_counts(t, w) for t, w in zip(texts, words)], np.int64).reshape(-1, 5)
    return [batch.column(0), batch.column(1), *[pa.array(np.ascontiguousarray(c)) for c in counted.T]]


_NAMES = ["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measured_by_arrays(docs: DataFrame, model: DataFrame) -> DataFrame:
    """The columns of BASE, chars and bits of every document, with the model as sorted arrays in every worker."""
    arrays = docs.sparkSession.sparkContext.broadcast(_sorted_arrays(model))

    def run(batches):
        for batch in slices(batches, 2, SLICE):
            texts, words, joined, half = _split(batch, 2)
            sizes, bits = np.array([len(t) for t in joined], np.int64), np.zeros(len(joined))
            for h in (0, 1):
                mine = np.flatnonzero(half == h)
                grams, gram, lengths = gram_table([joined[i] for i in mine])
                if not len(gram):
                    continue
                keys, values = arrays.value[h]
                cost = values[np.searchsorted(keys, gram_hash(grams))].astype(np.float64)[gram]
                ends = np.concatenate([[0.0], np.cumsum(cost)])
                stop = np.cumsum(lengths)
                bits[mine] = ends[stop] - ends[stop - lengths]
            yield pa.RecordBatch.from_arrays([*_base_columns(batch, texts, words), pa.array(sizes), pa.array(bits)], [*_NAMES, "chars", "bits"])

    return docs.mapInArrow(run, BASE + ", chars long, bits double")


def measured_by_join(docs: DataFrame, model: DataFrame) -> DataFrame:
    """As `measured_by_arrays`, for a model of any size: the documents' grams, counted per document, meet it in a join."""

    def run(batches):
        key = TaskContext.get().partitionId() << 33
        for batch in slices(batches, 2, SLICE):
            texts, words, joined, half = _split(batch, 2)
            lists = []
            for text in joined:
                grams, gram, _ = gram_table([text])
                h, times = gram_hash(grams).view(np.int64).tolist(), np.bincount(gram, minlength=len(grams)).tolist()
                lists.append([{"h": x, "times": t} for x, t in zip(h, times)])
            keys = np.arange(len(texts)) + key
            key += len(texts)
            yield pa.RecordBatch.from_arrays(
                [*_base_columns(batch, texts, words), pa.array([len(t) for t in joined], pa.int64()), pa.array(keys), pa.array(half.astype(np.int32)),
                 pa.array(lists, pa.list_(pa.struct([("h", pa.int64()), ("times", pa.int64())])))], [*_NAMES, "chars", "key", "half", "grams"])

    held = stage(docs.mapInArrow(run, BASE + ", chars long, key long, half int, grams array<struct<h: long, times: long>>"))
    asked = held.select("key", "half", F.explode("grams").alias("g")).select("key", "half", "g.*")
    costs = join_checked(asked, model, ["half", "h"]).groupBy("key").agg(F.sum(F.col("times") * F.col("bits").cast("double")).alias("bits"))
    return held.drop("grams", "half").join(costs, "key", "left").select(*_NAMES, "chars", F.coalesce("bits", F.lit(0.0)).alias("bits"))


def measured(docs: DataFrame) -> DataFrame:
    """The columns of BASE, chars and bits of every document: its counts, and what its characters cost by the other half's model."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    model = stage(hashed(gram_bits(stage(gram_counts(named)))))
    return (measured_by_arrays if model.count() <= MODEL_ENTRIES else measured_by_join)(named, model)


def _median(counts: DataFrame, value: str, name: str) -> DataFrame:
    """lang and the lower median of `value` per language, from a table of values and their number `n`."""
    upto = Window.partitionBy("lang").orderBy(value)
    ranked = counts.select("lang", value, F.sum("n").over(upto).alias("upto"), F.sum("n").over(Window.partitionBy("lang")).alias("all"))
    return ranked.where(2 * F.col("upto") >= F.col("all")).groupBy("lang").agg(F.min(value).alias(name), F.first("all").alias("docs"))


def bands(documents: DataFrame) -> DataFrame:
    """lang, middle, width of every language with at least MIN_DOCS judged documents: a band of bits per character.

    Documents are counted per language and grid cell first; a language has at most some ten thousand cells.
    """
    cells = documents.where("NOT base_failed AND chars > 0").groupBy("lang", F.floor(F.col("rate") * GRID).alias("cell")).agg(F.count("*").alias("n"))
    cells = stage(cells)
    middle = _median(cells, "cell", "middle")
    away = cells.join(middle, "lang").groupBy("lang", F.abs(F.col("cell") - F.col("middle")).alias("away")).agg(F.sum("n").alias("n"))
    spread = _median(away, "away", "spread").drop("docs")
    return middle.where(F.col("docs") >= MIN_DOCS).join(spread, "lang").select(
        "lang", ((F.col("middle") + 0.5) / GRID).alias("middle"), F.greatest(F.lit(LEAST_WIDTH), 1.4826 * WIDTH * F.col("spread") / GRID).alias("width"))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, perplexity, lower, upper of every document.

    Fewer than MIN_WORDS words or more than REPEAT_PERCENT per cent of them in repeated windows fail the base. Other documents are kept
    while their perplexity per character lies between the two limits of their language; short texts have wider limits. A null text is
    empty and fails; a null language is one of its own; a language with fewer than MIN_DOCS judged documents has no limits (null). Rows of
    equal id are judged each for itself; an empty table gives none; other columns are ignored.
    """
    rate = F.when(F.col("chars") > 0, F.col("bits") / F.col("chars"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    documents = stage(measured(docs).select("*", rate.alias("rate"), failed.alias("base_failed")))
    reach = F.col("width") * F.sqrt(1 + SHORT / F.greatest("chars", F.lit(1)))
    lower, upper = F.col("middle") - reach, F.col("middle") + reach
    fits = F.coalesce(F.col("rate").between(lower, upper), F.lit(True))
    return join_checked(documents, bands(documents), ["lang"], "left").select(
        *[c for c in _NAMES if c != "lang"], "base_failed", (~F.col("base_failed") & fits).alias("kept"),
        F.pow(F.lit(2.0), "rate").alias("perplexity"), F.pow(F.lit(2.0), lower).alias("lower"), F.pow(F.lit(2.0), upper).alias("upper"))
