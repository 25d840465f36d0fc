"""Small helpers the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from courierworks.session import checkpoint, stage

SLICE_BYTES = 8 << 20  # text that is handled at once inside a task
HASH_BYTES = 1 << 20  # the same where every byte takes a hundred bytes of arrays
ARROW_BYTES = 4 << 20  # of one Arrow batch, which is held by the executor and by its Python worker
SPANS = 16  # that arrays are cut into to be summed
PARTS, PART_ROWS = 48, 20_000  # least partitions that short rows are gathered in, and rows of one

__all__ = ["ARROW_BYTES", "HASH_BYTES", "SLICE_BYTES", "documents", "gathered", "held_out", "lookup", "map_batches", "memory", "partials", "slices", "small_batches", "stage", "table", "text_slices"]

_memory: dict[str, dict] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of a session by their bytes, not only by their rows: 10,000 texts may be any size."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def memory(kind: str) -> dict:
    """What this worker process remembers between the tasks of one kind.

    Workers outlive jobs and run tasks of many kinds, so a task of another kind drops what the last one left: memories never add up.
    """
    if kind not in _memory:
        _memory.clear()
        pa.default_memory_pool().release_unused()
        _memory[kind] = {}
    return _memory[kind]


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """`df`, about so many short rows, in no more partitions than they need: a task that writes a file costs as much as thousands of them."""
    return df.coalesce(max(PARTS, rows // PART_ROWS))


def map_batches(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """`mapInArrow` under a name that says what it does; `work` never holds more than a few slices of its partition."""
    return df.mapInArrow(work, schema)


def slices(batches: Iterator[pa.RecordBatch], column: int = 1, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of one slice stay under `limit` bytes (one longer text is a slice of its own)."""
    for batch in batches:
        sizes = np.asarray(pa.compute.binary_length(batch.column(column)).fill_null(0), dtype=np.int64) if batch.num_rows else np.zeros(0, np.int64)
        start, total = 0, 0
        for row, size in enumerate(sizes):
            if total and total + size > limit:
                yield batch.slice(start, row - start)
                start, total = row, 0
            total += size
        if start < batch.num_rows:
            yield batch.slice(start)


def text_slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.RecordBatch]]:
    """(bytes, starts, ends, slice): the texts of column 1 as one byte buffer with their bounds; null is the empty text."""
    for piece in slices(batches, 1, limit):
        values = piece.column(1).cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(values.buffers()[1], np.int64, len(values) + 1, values.offset * 8) if len(values) else np.zeros(1, np.int64)
        raw = values.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        yield data, offsets[:-1] - offsets[0], offsets[1:] - offsets[0], piece


def held_out(doc_id: Column, folds: int = 3, fold: int = 1) -> Column:
    """Whether a document is kept from learning: crc32 of the id's text modulo `folds` is `fold`."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def partials(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], np.ndarray], key: str, parts: int = 24) -> np.ndarray | None:
    """Sum of one array that `work` makes of each of `parts` partitions.

    The arrays are cut into spans, which other tasks sum, in the order of the partitions: what reaches the driver is one array, however many
    partitions there are.
    """

    def run(batches):
        total, part = work(batches), TaskContext.get().partitionId()
        if total is not None:
            for span, piece in enumerate(np.array_split(total.astype(np.float64), SPANS)):
                yield pa.RecordBatch.from_pydict({"span": pa.array([span], pa.int32()), "part": pa.array([part], pa.int32()), "piece": pa.array([piece.tobytes()], pa.binary())})

    def summed(batches):
        last, total = None, None
        for batch in batches:
            for span, piece in zip(batch.column("span").to_pylist(), batch.column("piece").to_pylist()):
                one = np.frombuffer(piece, np.float64)
                if span != last and last is not None:
                    yield pa.RecordBatch.from_pydict({"span": pa.array([last], pa.int32()), "piece": pa.array([total.tobytes()], pa.binary())})
                total = total + one if span == last else one.copy()
                last = span
        if last is not None:
            yield pa.RecordBatch.from_pydict({"span": pa.array([last], pa.int32()), "piece": pa.array([total.tobytes()], pa.binary())})

    cut = df.repartition(parts, key).mapInArrow(run, "span int, part int, piece binary")
    rows = cut.repartition(SPANS, "span").sortWithinPartitions("span", "part").mapInArrow(summed, "span int, piece binary").collect()
    return np.concatenate([np.frombuffer(r.piece, np.float64) for r in sorted(rows, key=lambda r: r.span)]) if rows else None


def lookup(rows: DataFrame, dim: DataFrame, on: list[str], share: int = 10_000, least: int = 2_000) -> DataFrame:
    """`rows` (a written table) with the columns of `dim`, which has one row per key; rows whose key is missing there go.

    Keys with more than max(least, rows / share) rows are hot; there are at most `share` of them at any size, so their rows of `dim` are
    broadcast. All other keys are joined by a shuffle.
    """
    bound = max(least, rows.count() // share)
    hot = checkpoint(rows.groupBy(*on).agg(F.count("*").alias("__n")).where(F.col("__n") > bound).select(*on))
    if hot.isEmpty():
        return rows.join(dim, on)
    spread = rows.join(F.broadcast(dim.join(F.broadcast(hot), on)), on)
    return spread.unionByName(rows.join(F.broadcast(hot), on, "left_anti").join(dim, on))
