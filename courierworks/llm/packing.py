"""Packing by optimal length buckets.

The global histogram of token counts, every length on its own, goes to a dynamic programme that chooses the bucket lengths with the least padding; every document is
padded to the length of the smallest bucket that holds it, and batches of at most `budget` tokens form inside each bucket. Ranks inside a
bucket are counted per group of a few thousand documents, whose number follows from the histogram, so no task ranks a whole bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courierworks.llm.common import slices, stage
from courierworks.llm.tokens import TEXT_SLICE, Encoder, vocabulary_path

BUCKETS = 16
BUDGET = 65_536  # padded tokens of a batch
FINE = 256  # lengths up to this are cells of their own in a coarse histogram; above, a cell spans 1/256 of its length
EXACT = 20_000  # distinct lengths beyond which `histogram` is coarse
GROUP = 4096  # documents that are ranked together


def token_lengths(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens of every row of `docs`, with the end id; a null text counts as empty and has one token."""
    path = vocabulary or vocabulary_path()

    def run(batches):
        encoder = Encoder.load(path)
        for batch in slices(batches, 1, TEXT_SLICE):
            counts = encoder.count([x or "" for x in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_tokens": pa.array([n + 1 for n in counts], pa.int64())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long")


def cell(length: Column) -> Column:
    """Histogram cell of a length; monotone in the length."""
    return F.when(length <= FINE, length).otherwise(FINE + F.floor(FINE * F.log2(length / F.lit(float(FINE))))).cast("long")


def _cells(lengths: DataFrame, key: Column) -> list[tuple[int, int, int]]:
    rows = lengths.groupBy(key.alias("cell")).agg(F.max("n_tokens").alias("top"), F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens")).orderBy("cell").collect()
    return [(r.top, r.docs, r.tokens) for r in rows]


def histogram(lengths: DataFrame) -> list[tuple[int, int, int]]:
    """(largest length, documents, tokens) of each cell, in order: an overview of at most some thousand rows. `pack` takes `every_length`."""
    if lengths.select("n_tokens").distinct().limit(EXACT + 1).count() <= EXACT:
        return _cells(lengths, F.col("n_tokens"))
    return _cells(lengths, cell(F.col("n_tokens")))


def every_length(lengths: DataFrame) -> np.ndarray:
    """Length, documents and tokens (rows of int64, ascending) of every length that occurs.

    There are less than the root of twice the tokens of all documents, so that even 10^12 tokens give at most 1.5 million rows of 24 bytes.
    """
    rows = lengths.groupBy("n_tokens").agg(F.count("*").alias("docs")).select(F.col("n_tokens").cast("long"), "docs").toArrow()
    top, docs = (rows.column(c).to_numpy().astype(np.int64) for c in ("n_tokens", "docs"))
    order = np.argsort(top)
    return np.stack([top[order], docs[order], top[order] * docs[order]], 1)


def _best_starts(before: np.ndarray, tops: np.ndarray, docs: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each end 1..n the least `before[start]` plus padding of one bucket over the cells start..end-1, and the first such start.

    That start never goes back as the end grows, so ends are settled from far apart to close: each looks only between the starts of its
    settled neighbours, and every round compares about as many pairs as there are cells.
    """
    n = len(tops)
    least, starts = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    step = 1 << (n.bit_length() - 1)
    while step:
        ends = np.arange(step, n + 1, 2 * step)
        after = ends + step
        low = starts[ends - step]
        high = np.minimum(np.where(after <= n, starts[np.minimum(after, n)], n), ends - 1)
        sizes = high - low + 1
        first = np.cumsum(sizes) - sizes
        start = np.arange(sizes.sum()) - np.repeat(first - low, sizes)
        end = np.repeat(ends, sizes)
        totals = before[start] + tops[end - 1] * (docs[end] - docs[start]) - (tokens[end] - tokens[start])
        least[ends] = np.minimum.reduceat(totals, first)
        hits = np.flatnonzero(totals == np.repeat(least[ends], sizes))
        starts[ends] = start[hits[np.searchsorted(hits, first)]]
        step //= 2
    return least, starts


def boundaries(cells: list[tuple[int, int, int]] | np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Bucket lengths (ascending, the last is the longest length) with the least total padding over the cells."""
    if not len(cells):
        return []
    tops, docs, tokens = np.asarray(cells, np.int64).T
    docs, tokens = (np.concatenate([[0], np.cumsum(x)]) for x in (docs, tokens))
    n, k = len(tops), min(buckets, len(tops))
    best = np.concatenate([[0], tops]) * docs - tokens  # of one bucket
    cut = [np.zeros(n + 1, np.int64)]
    for _ in range(1, k):
        best, starts = _best_starts(best, tops, docs, tokens)
        cut.append(starts)
    out, end, left = [], n, k
    while end > 0:
        out.append(int(tops[end - 1]))
        end, left = int(cut[left - 1][end]), left - 1
    return out[::-1]


def pack(lengths: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """Bucket and batch of every row of `lengths` (doc_id, n_tokens).

    Columns: doc_id, n_tokens, bucket (from 0), bucket_tokens (its padded length), batch (text, one per batch), padding. A batch holds at
    most `budget` padded tokens, or one document that is longer. Null lengths count as 0; rows of one id are packed apart; an empty table
    gives none.
    """
    sized = stage(lengths.select("doc_id", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens")))
    cells = every_length(sized)
    tops = boundaries(cells, buckets)
    if not tops:
        return sized.select("doc_id", "n_tokens", F.lit(0).alias("bucket"), F.lit(0).cast("long").alias("bucket_tokens"), F.lit("").alias("batch"), F.lit(0).cast("long").alias("padding")).limit(0)
    held = np.zeros(len(tops), np.int64)
    np.add.at(held, np.searchsorted(tops, cells[:, 0]), cells[:, 1])
    bucket, groups, capacity, width = F.lit(len(tops) - 1), F.lit(1), F.lit(1), F.lit(tops[-1])
    for i in reversed(range(len(tops))):
        fits = F.col("n_tokens") <= tops[i]
        bucket = F.when(fits, F.lit(i)).otherwise(bucket)
        groups = F.when(fits, F.lit(int(-(-held[i] // GROUP)) or 1)).otherwise(groups)
        capacity = F.when(fits, F.lit(int(max(1, budget // max(1, tops[i]))))).otherwise(capacity)
        width = F.when(fits, F.lit(tops[i])).otherwise(width)
    rows = sized.select("doc_id", "n_tokens", bucket.alias("bucket"), width.cast("long").alias("bucket_tokens"), capacity.alias("capacity"),
                        F.pmod(F.xxhash64("doc_id"), groups.cast("long")).alias("part"))
    rank = F.row_number().over(Window.partitionBy("bucket", "part").orderBy("n_tokens", "doc_id")) - 1
    batch = F.concat_ws("-", "bucket", "part", F.floor(rank / F.col("capacity")).cast("long"))
    return rows.withColumn("batch", batch).select("doc_id", "n_tokens", "bucket", "bucket_tokens", "batch", (F.col("bucket_tokens") - F.col("n_tokens")).alias("padding"))


def pack_documents(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """`pack` for the token counts of the whole texts; other columns are ignored."""
    return pack(token_lengths(docs), buckets, budget)


def batches(packed: DataFrame) -> DataFrame:
    """batch, bucket_tokens, doc_ids, n_tokens, padding of every batch; a batch is bounded by the token budget."""
    return packed.groupBy("batch", "bucket_tokens").agg(F.sort_array(F.collect_list("doc_id")).alias("doc_ids"), F.sum("n_tokens").alias("n_tokens"), F.sum("padding").alias("padding"))
