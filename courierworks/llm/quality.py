"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Each text becomes a few dozen numbers (sizes, character classes, repetition of words and lines). Random Fourier features approximate a
Gaussian kernel over the standardised numbers; the normal equations of the ridge fit are summed per partition (a fixed number of partitions,
each giving one array), and pool-adjacent-violators over score bins turns ridge scores into probabilities.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courierworks.llm.common import held_out, memory, partials, slices, stage

FEATURES = 192  # random Fourier features
RIDGE = 1e-3
BINS = 256  # score bins of the calibration
MAX_TRAINING_ROWS = 2_000_000  # labelled rows used at most; beyond it a hash of the id picks them
SEED = 20260
PIECE = 1 << 16  # bytes that are compressed at once
TEXT_SLICE = 2 << 20  # text that is measured at once

_GROUPS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".", b",", b"!", b"?", b"#", b"$%&*@^~", b"|",
           b"<>{}[]()=+/\\_", b"\"'`", b":;-", bytes(range(128, 256)), bytes(i for i in range(32) if i != 10)]
_CLASS = np.full(256, len(_GROUPS))
for _i, _group in enumerate(_GROUPS):
    _CLASS[list(_group)] = _i
WIDTH = len(_GROUPS) + 1 + 17


def _packed(raw: bytes) -> int:
    """Size of the whole text when compressed, without holding the result."""
    packer, view = zlib.compressobj(1), memoryview(raw)
    return sum(len(packer.compress(view[at:at + PIECE])) for at in range(0, len(raw), PIECE)) + len(packer.flush())


def statistics(raw: bytes) -> np.ndarray:
    """The numbers of one text; all zero for an empty one."""
    out = np.zeros(WIDTH)
    if not raw:
        return out
    n = len(raw)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    groups = np.bincount(_CLASS, counts, minlength=len(_GROUPS) + 1)
    out[:len(groups)] = np.sqrt(groups / n)
    share = counts[counts > 0] / n
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x]
    total = max(1, len(words))
    seen = Counter(words)
    sizes = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    pairs = Counter(zip(words, words[1:]))
    folded = Counter(w.lower() for w in words)
    squared = sum(v * v for v in seen.values()) / total ** 2
    tail = len(groups)
    out[tail:] = [
        np.log1p(n), np.log1p(len(words)), np.log1p(len(lines)), -(share * np.log(share)).sum(), len(seen) / total, max(seen.values(), default=0) / total,
        squared, len(folded) / max(1, len(seen)), len(pairs) / max(1, len(words) - 1), max(pairs.values(), default=0) / max(1, len(words) - 1),
        len(set(lines)) / max(1, len(lines)), max(Counter(lines).values(), default=0) / max(1, len(lines)), sizes.mean(), sizes.std(),
        min(40.0, float(sizes.max())), sum(w.isupper() for w in seen) / max(1, len(seen)), _packed(raw) / n,
    ]
    return out


def measured(batches):
    memory("statistics")  # nothing is kept; what other tasks left goes
    for batch in slices(batches, 1, TEXT_SLICE):
        rows = [statistics(x.encode() if x else b"") for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).cast(pa.int64()), "stats": pa.array([r.tobytes() for r in rows], pa.binary())})


def _matrix(batch: pa.RecordBatch, name: str = "stats") -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(name).to_pylist()), np.float64).reshape(-1, WIDTH)


class Model:
    """What a fit leaves: standardisation, random directions, ridge weights and the calibration steps."""

    def __init__(self, mean, scale, weights, prior, knots, values):
        self.mean, self.scale, self.weights, self.prior, self.knots, self.values = mean, scale, weights, prior, knots, values

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return features(stats, self.mean, self.scale) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(stats), self.prior)
        return np.clip(np.interp(self.raw(stats), self.knots, self.values), 0.0, 1.0)


def features(stats: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Random Fourier features of a Gaussian kernel, the standardised numbers themselves, and a constant."""
    rng = np.random.default_rng(SEED)
    z = np.clip((stats - mean) / scale, -6, 6)
    directions = rng.normal(size=(WIDTH, FEATURES)) / np.sqrt(2 * WIDTH)
    phases = rng.uniform(0, 2 * np.pi, FEATURES)
    return np.hstack([np.cos(z @ directions + phases) * np.sqrt(2 / FEATURES), 0.1 * z, np.ones((len(z), 1))])


def isotonic(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the non-decreasing fit to `value`."""
    blocks: list[list[float]] = []
    for v, w in zip(value, weight):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else np.zeros(0)


def fit(stats: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> Model:
    """Learn from labelled rows outside the held-out third; `stats` has doc_id and stats.

    Two thirds of the training rows give the ridge fit, the rest the calibration. Rows without a label take no part; a document with
    several labels counts with their mean. Without any training row the score is 0.5, with a single class it is that class.
    """
    marks = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("y")))
    rows = stage(stats.dropDuplicates(["doc_id"]).join(marks, "doc_id"))
    total, ones = rows.agg(F.count("*"), F.sum("y")).first()
    if not total or ones in (0.0, float(total)):
        return Model(None, None, None, 0.5 if not total else ones / total, None, None)
    if total > max_rows:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * max_rows / total))
    role = F.pmod(F.xxhash64("doc_id", F.lit("role")), F.lit(3))

    def moments(batches):
        out = np.zeros(2 * WIDTH + 1)
        for batch in batches:
            m = _matrix(batch)
            out += np.concatenate([m.sum(0), (m * m).sum(0), [len(m)]])
        return out

    sums = partials(rows.select("doc_id", "stats"), moments, "doc_id")
    n = max(1.0, sums[-1])
    mean = sums[:WIDTH] / n
    scale = np.sqrt(np.maximum(sums[WIDTH:2 * WIDTH] / n - mean ** 2, 0))
    scale = np.where(scale > 1e-6, scale, 1.0)
    size = FEATURES + WIDTH + 1

    def equations(batches):
        out = np.zeros((size, size + 1))
        for batch in batches:
            z, y = features(_matrix(batch), mean, scale), batch.column("y").to_numpy()
            out += np.hstack([z.T @ z, (z.T @ y)[:, None]])
        return out.ravel()

    learned = partials(rows.where(role > 0).select("doc_id", "stats", "y"), equations, "doc_id")
    learned = np.zeros((size, size + 1)) if learned is None else learned.reshape(size, size + 1)
    weights = np.linalg.solve(learned[:, :size] + RIDGE * (1 + n / 1000) * np.eye(size), learned[:, size])
    model = Model(mean, scale, weights, ones / total, None, None)

    def histogram(batches):
        out = np.zeros((BINS, 3))
        for batch in batches:
            s, y = model.raw(_matrix(batch)), batch.column("y").to_numpy()
            at = np.clip(((s + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
            out += np.stack([np.bincount(at, w, BINS) for w in (np.ones(len(s)), y, s)], 1)
        return out.ravel()

    bins = partials(rows.where(role == 0).select("doc_id", "stats", "y"), histogram, "doc_id")
    bins = np.zeros((0, 3)) if bins is None else bins.reshape(BINS, 3)
    bins = bins[bins[:, 0] > 0]
    if len(bins):
        level = isotonic(bins[:, 1] / bins[:, 0], bins[:, 0])
        model.knots, model.values = np.concatenate([[bins[0, 2] / bins[0, 0] - 1e-9], bins[:, 2] / bins[:, 0]]), np.concatenate([level[:1], level])
        order = np.argsort(model.knots, kind="stable")
        model.knots, model.values = model.knots[order], np.maximum.accumulate(model.values[order])
        if model.values[0] == model.values[-1]:
            model.knots, model.values = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    else:
        model.knots, model.values = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def keep_good(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """The rows of `docs` that the classifier accepts, with all their columns; texts are scored where they are read, nothing is shuffled."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = fit(stage(named.mapInArrow(measured, "doc_id long, stats binary")), labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality"), max_rows)
    column = docs.columns.index("text")

    def run(batches):
        memory("statistics")
        for batch in slices(batches, column, TEXT_SLICE):
            stats = np.array([statistics(x.encode() if x else b"") for x in batch.column(column).to_pylist()]).reshape(-1, WIDTH)
            yield batch.filter(pa.array(model.score(stats) >= 0.5))

    return docs.mapInArrow(run, docs.schema)


def score_documents(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher is better) and predicted (1 from 0.5) of every document.

    Only the text is an input of a score; null texts count as empty and empty texts are scored like any other. Repeated rows are scored
    alike, a null doc_id is scored and never learned from, tables without rows give none, and other columns are ignored.
    """
    # labels join on the id alone, so clashing extra columns of either table never meet
    stats = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
                  .mapInArrow(measured, "doc_id long, stats binary"))
    model = fit(stats, labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality"), max_rows)

    def scored(batches):
        for batch in batches:
            values = model.score(_matrix(batch)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(values, pa.float64()), "predicted": pa.array((values >= 0.5).astype(np.int32), pa.int32())})

    return (stats.mapInArrow(scored, "doc_id long, score double, predicted int")
            .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted"))
