"""Exact top-k search by integer inner product over norm-sorted vectors.

Vectors are put in order of descending length and packed into chunks of a few thousand; queries are packed into blocks. The longest vectors
of all (one bounded chunk) give every query a first threshold and the rotation (singular vectors) that moves most of the length into the
first components. A chunk is skipped for a block when Cauchy-Schwarz (longest vector times longest query) stays below the lowest threshold;
inside a pair of chunk and block the partial sum over the first rotated components plus the product of the residual lengths bounds every
score, and only vectors whose bound reaches the threshold are scored, in whole numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courierworks.llm.common import stage

HEAD = 4096  # vectors in the chunk that sets the first thresholds; also the size of every chunk
BLOCK = 1024  # queries in a block
CELLS = 4  # groups of chunks and of blocks; every pair of groups meets in one key of the join
EXACT = float(1 << 53)


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ids and floored vectors of a batch; null vectors, null or non-finite components and null ids are left out."""
    ids, out = [], []
    for key, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        if key is None or vector is None or any(x is None for x in vector):
            continue
        values = np.floor(256.0 * np.asarray(vector, np.float64))
        if np.isfinite(values).all():
            ids.append(key)
            out.append(values)
    return np.asarray(ids, np.int64), out


def floored(batches):
    """(vec_id, norm, whole-number vector as binary float64) of every vector that takes part."""
    for batch in batches:
        ids, rows = _rows(batch)
        yield pa.RecordBatch.from_pydict({
            "vec_id": pa.array(ids, pa.int64()),
            "norm": pa.array([float(np.sqrt(v @ v)) for v in rows], pa.float64()),
            "vec": pa.array([v.tobytes() for v in rows], pa.binary()),
        })


def stack(rows: list[np.ndarray], dim: int) -> np.ndarray:
    """Rows as one matrix; shorter vectors are filled with zeros."""
    out = np.zeros((len(rows), dim))
    for i, row in enumerate(rows):
        out[i, :len(row)] = row
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows, as int64 (saturated where they leave its range)."""
    if a.size and b.size and np.abs(a).max() * np.abs(b).max() * a.shape[1] >= EXACT:
        whole = np.array([[int(x) for x in row] for row in a], object) @ np.array([[int(x) for x in row] for row in b], object).T
        return np.array([[max(-(1 << 63), min((1 << 63) - 1, x)) for x in row] for row in whole], np.int64).reshape(len(a), len(b))
    return (a @ b.T).astype(np.int64)


def best(scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best allowed scores of each row, ties to the smaller id."""
    low = np.iinfo(np.int64).min
    masked = np.where(allowed, scores, low)
    if masked.shape[1] > k:
        kth = np.partition(masked, masked.shape[1] - k, axis=1)[:, masked.shape[1] - k]
        allowed = allowed & (masked >= kth[:, None])
    row, col = np.nonzero(allowed)
    order = np.lexsort((ids[col], ~scores[row, col], row))  # ~x falls as x rises, without overflow
    row, col = row[order], col[order]
    first = np.searchsorted(row, row)
    keep = np.arange(len(row)) - first < k
    return row[keep], col[keep]


def top_k(table: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The `k` highest integer inner products of each query (ids divisible by `every`) against all other vectors.

    Returns query_id, rank (from 1), vec_id, score; all there are if fewer than `k`, ties to the smaller id. Components are floor(256 x).
    Null ids, null vectors and vectors with null or non-finite components take no part; a vector never meets rows of its own id; repeated
    equal rows count once; shorter vectors are filled with zeros; an empty table gives no rows; other columns are ignored.
    """
    named = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    vectors = stage(named.mapInArrow(floored, "vec_id long, norm double, vec binary").dropDuplicates(["vec_id", "vec"]))
    head = vectors.orderBy(F.desc("norm"), "vec_id").limit(HEAD).collect()  # one bounded chunk
    dim = max((vectors.agg(F.max(F.length("vec"))).first()[0] or 0) // 8, 1)
    matrix = stack([np.frombuffer(r.vec, np.float64) for r in head], dim)
    ids = np.array([r.vec_id for r in head], np.int64)
    turn = np.linalg.svd(matrix.T @ matrix / max(1.0, float(np.abs(matrix).max(initial=1.0)) ** 2))[0]
    parts = vectors.sparkSession.sparkContext.defaultParallelism

    def packed(batches, size: int, seeds: bool):
        """Rows of up to `size` vectors: ids, matrix, lengths, and for queries the thresholds the head gives."""
        keys, rows = [], []

        def row():
            own, block = np.array(keys, np.int64), stack(rows, dim)
            lengths = np.sqrt((block * block).sum(1))
            low = np.full(len(own), -np.inf)
            if seeds:
                for i, line in enumerate(np.where(ids[None, :] != own[:, None], product(block, matrix).astype(np.float64), -np.inf)):
                    if len(line) >= k:
                        low[i] = np.partition(line, len(line) - k)[len(line) - k]
            return pa.RecordBatch.from_pydict({
                "cell": pa.array([int(own.view(np.uint64).sum() % np.uint64(1 << 31))], pa.int64()), "longest": pa.array([float(lengths.max())], pa.float64()),
                "lowest": pa.array([float(low.min())], pa.float64()), "ids": pa.array([own.tobytes()], pa.binary()),
                "rows": pa.array([block.astype(np.float64).tobytes()], pa.binary()), "low": pa.array([low.tobytes()], pa.binary())})

        for batch in batches:
            for key, value in zip(batch.column("vec_id").to_pylist(), batch.column("vec").to_pylist()):
                keys.append(key)
                rows.append(np.frombuffer(value, np.float64))
                if len(keys) == size:
                    yield row()
                    keys.clear()
                    rows.clear()
        if keys:
            yield row()

    schema = "cell long, longest double, lowest double, ids binary, rows binary, low binary"
    chunks = (vectors.repartitionByRange(2 * parts, F.desc("norm"), "vec_id").sortWithinPartitions(F.desc("norm"), "vec_id")
              .mapInArrow(lambda b: packed(b, HEAD, False), schema).select(F.col("longest").alias("c_longest"), F.col("ids").alias("c_ids"), F.col("rows").alias("c_rows"), F.pmod("cell", F.lit(CELLS)).alias("cy"))
              .withColumn("cx", F.explode(F.sequence(F.lit(0), F.lit(CELLS - 1)))))
    blocks = (vectors.where(F.col("vec_id") % every == 0).repartitionByRange(parts, F.desc("norm"), "vec_id").sortWithinPartitions(F.desc("norm"), "vec_id")
              .mapInArrow(lambda b: packed(b, BLOCK, True), schema).withColumn("cx", F.pmod("cell", F.lit(CELLS)))
              .withColumn("cy", F.explode(F.sequence(F.lit(0), F.lit(CELLS - 1)))))
    pairs = blocks.join(chunks, (blocks.cx == chunks.cx) & (blocks.cy == chunks.cy) & (F.col("longest") * F.col("c_longest") * (1 + 1e-9) >= F.col("lowest")))

    def scored(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                qi, ci = (np.frombuffer(batch.column(c)[i].as_py(), np.int64) for c in ("ids", "c_ids"))
                low = np.frombuffer(batch.column("low")[i].as_py(), np.float64)
                q, c = (np.frombuffer(batch.column(n)[i].as_py(), np.float64).reshape(-1, dim) for n in ("rows", "c_rows"))
                bound = _bounds(q @ turn, c @ turn)
                may = (bound >= low[:, None]) & (qi[:, None] != ci[None, :])
                cols = np.flatnonzero(may.any(axis=0))
                scores = product(q, c[cols])
                row, col = best(scores, may[:, cols] & (scores >= low[:, None]), ci[cols], k)
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(qi[row], pa.int64()), "vec_id": pa.array(ci[cols][col], pa.int64()), "score": pa.array(scores[row, col], pa.int64())})

    found = pairs.select("ids", "rows", "low", "c_ids", "c_rows").mapInArrow(scored, "query_id long, vec_id long, score long").dropDuplicates(["query_id", "vec_id"])
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _bounds(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """An upper bound of every inner product: the first rotated components in full, the rest by Cauchy-Schwarz."""
    first = max(1, q.shape[1] // 3)
    rest = [np.sqrt(np.maximum((m[:, first:] ** 2).sum(1), 0)) for m in (q, c)]
    whole = [np.sqrt((m ** 2).sum(1)) for m in (q, c)]
    slack = 1e-9 * (1 + np.outer(*whole))
    return q[:, :first] @ c[:, :first].T + np.outer(*rest) + slack
