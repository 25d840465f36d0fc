"""Exact removal of repeated byte spans with suffix arrays over shards.

Every window of `SPAN` bytes belongs to the smallest hash of its 32-byte substrings; windows that follow each other with the same smallest
substring form a run, and equal windows fall into runs of the same hash. Hashes that occur once need no further look. Equal runs are
combined first and only the earliest copy goes on; the different runs of one hash form part of a shard, whose suffix array (induced sorting)
and permuted common prefixes show every window that also starts earlier. A hash with very many different runs is split into its windows,
which are combined like any sum. What is found goes back to the documents by id.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courierworks.llm.common import HASH_BYTES, slices, stage, text_slices
from courierworks.operators.keyed import join_checked
from courierworks.llm.shingles import gram_hashes, prefix_sums, substring_hash
from courierworks.llm.suffixes import permuted_prefixes, suffix_array

SPAN = 100
GRAM_DOUBLINGS = 5  # the substrings whose hashes name the runs have 32 bytes
GRAM = 1 << GRAM_DOUBLINGS
SHARD_BYTES = 1 << 20  # text of one suffix array
HOT = 400  # different runs of one hash from which on its windows are taken apart
STRIPPED = 1 << 20  # text whose spans are taken out at once
PIECE = 8 << 20  # longer texts are cut into overlapping pieces of this size while their runs are found
NO_ID = -(1 << 63)  # stands for a null id, which counts as smaller than any other
_INDEX = np.uint64((1 << 24) - 1)


def runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, hash) of every run of a buffer of texts; at most 2**24 bytes."""
    none = np.zeros(0, np.int64)
    if len(data) < SPAN:
        return none, none, np.zeros(0, np.uint64)
    grams = gram_hashes(data, GRAM_DOUBLINGS)
    low = (grams & ~_INDEX) | np.arange(len(grams), dtype=np.uint64)  # ties go to the leftmost
    width, wanted = 1, SPAN - GRAM + 1
    while 2 * width <= wanted:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < wanted:
        low = np.minimum(low[:width - wanted], low[wanted - width:])
    place = (low & _INDEX).astype(np.int64)
    change = np.zeros(len(place) + 1, np.int64)
    fits = ends - starts >= SPAN
    np.add.at(change, starts[fits], 1)
    np.add.at(change, ends[fits] - SPAN + 1, -1)
    valid = np.cumsum(change)[:-1] > 0
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1]) | ~valid[:-1]
    new[starts[fits]] = True
    first = np.flatnonzero(valid & new)
    stop = np.ones(len(place), bool)
    stop[:-1] = new[1:] | ~valid[1:]
    last = np.flatnonzero(valid & stop)
    return first, last - first + 1, grams[place[first]]


def _cut(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """(row, offset, piece bounds): texts longer than PIECE as overlapping pieces, so that every window is whole in one piece."""
    row, begin, finish = [], [], []
    for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
        while b - a > PIECE + SPAN:
            row.append(i)
            begin.append(a)
            finish.append(a + PIECE + SPAN - 1)
            a += PIECE
        row.append(i)
        begin.append(a)
        finish.append(b)
    return np.array(row, np.int64), np.array(begin, np.int64), np.array(finish, np.int64)


def found_runs(texts: DataFrame) -> DataFrame:
    """h, s, id, a, n of every run: hash, hash of the run's text, document, first window, number of windows."""

    def run(batches):
        for data, starts, ends, piece in text_slices(batches, HASH_BYTES):
            ids = np.asarray(piece.column(0))
            if len(data) <= PIECE:
                parts = [(data, starts, ends, np.arange(len(ids)), np.zeros(len(ids), np.int64))]
            else:
                rows, begin, finish = _cut(data, starts, ends)
                parts = [(data[a:b], np.array([0]), np.array([b - a]), np.array([r]), np.array([a - starts[r]])) for r, a, b in zip(rows, begin, finish)]
            for buffer, lo, hi, row, shift in parts:
                first, count, h = runs(buffer, lo, hi)
                prefix = prefix_sums(buffer)
                owner = np.searchsorted(lo, first, side="right") - 1 if len(first) else first
                # empty texts share their start with the next one: take the last text that starts here
                yield pa.RecordBatch.from_pydict({
                    "h": pa.array(h.view(np.int64)), "s": pa.array(substring_hash(prefix, first, first + count + SPAN - 1).view(np.int64)), "id": pa.array(ids[row[owner]], pa.int64()),
                    "a": pa.array((first - lo[owner] + shift[owner]).astype(np.int32)), "n": pa.array(count.astype(np.int32))})

    return texts.mapInArrow(run, "h long, s long, id long, a int, n int")


def context_rows(asked: DataFrame) -> DataFrame:
    """The texts of the runs in `wanted` (list of a, n, h, hot): one row with the run's bytes, or one per window with its hash if hot."""

    def run(batches):
        for data, starts, ends, piece in text_slices(batches, HASH_BYTES):
            wanted = piece.column(2)
            sizes = np.asarray(wanted.value_lengths().fill_null(0))
            flat = wanted.flatten()
            a, n, h, hot = (np.asarray(flat.field(i)) for i in range(4))
            row = np.repeat(np.arange(len(starts)), sizes)
            at = starts[row] + a
            ids = np.asarray(piece.column(0))
            raw = data.tobytes()
            cold = np.flatnonzero(~hot.astype(bool))
            if len(cold):
                yield pa.RecordBatch.from_pydict({"h": pa.array(h[cold]), "w": pa.nulls(len(cold), pa.int64()), "id": pa.array(ids[row[cold]]), "a": pa.array(a[cold]),
                                                  "body": pa.array([raw[p:p + c + SPAN - 1] for p, c in zip(at[cold].tolist(), n[cold].tolist())], pa.binary())})
            hot = np.flatnonzero(hot)
            if len(hot):
                prefix = prefix_sums(data)
                for part in np.array_split(hot, len(hot) // 4000 + 1):
                    step = np.arange(n[part].sum()) - np.repeat(np.cumsum(n[part]) - n[part], n[part])
                    spot = np.repeat(at[part], n[part]) + step
                    yield pa.RecordBatch.from_pydict({"h": pa.array(np.repeat(h[part], n[part])), "w": pa.array(substring_hash(prefix, spot, spot + SPAN).view(np.int64)),
                                                      "id": pa.array(np.repeat(ids[row[part]], n[part])), "a": pa.array((np.repeat(a[part], n[part]) + step).astype(np.int32)), "body": pa.nulls(len(spot), pa.binary())})

    return asked.select("id", "text", "wanted").mapInArrow(run, "h long, w long, id long, a int, body binary")


def repeated_windows(bodies: list[bytes], ids: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(body, offset) of every window of the bodies that equals a window with a smaller (id, start), by suffix array."""
    sizes = np.array([len(x) for x in bodies], np.int64)
    text = np.frombuffer(b"\0".join(bodies) + b"\0", np.uint8)
    starts = np.concatenate([[0], np.cumsum(sizes[:-1] + 1)])
    coded = text.astype(np.int64) + 1
    coded[starts + sizes] = 0
    fresh = np.zeros(len(text), bool)
    fresh[starts] = True
    sa = suffix_array(coded)
    common = permuted_prefixes(text, sa, fresh, int(sizes.max()) + 8)[sa]
    body = np.repeat(np.arange(len(bodies)), sizes + 1)
    offset = np.arange(len(text)) - starts[body]
    whole = (offset + SPAN <= sizes[body])[sa]
    group = np.cumsum(~((common >= SPAN) & whole & np.concatenate([[False], whole[:-1]])))
    spot, group = sa[whole], group[whole]
    start = a[body[spot]].astype(np.int64) + offset[spot]
    order = np.lexsort((start, ids[body[spot]], group))
    owner, start, group = ids[body[spot]][order], start[order], group[order]
    new = np.concatenate([[True], group[1:] != group[:-1]])[:len(group)]
    first = np.maximum.accumulate(np.where(new, np.arange(len(group)), 0))
    later = (owner != owner[first]) | (start != start[first])  # a repeated row brings the same window again, which is not a later one
    hit = spot[order[later]]
    return body[hit], offset[hit]


def _stretches(owner: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, first, count) of maximal stretches of consecutive positions."""
    order = np.lexsort((at, owner))
    owner, at = owner[order], at[order]
    new = np.ones(len(at), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    return owner[first], at[first], np.diff(np.append(first, len(at)))


def sorted_shards(contexts: DataFrame) -> DataFrame:
    """id, a, n: stretches of windows that also start earlier, from the suffix arrays of all shards; runs of one hash share a shard."""

    def solve(rows):
        ids, a = np.concatenate([r[1] for r in rows]), np.concatenate([r[2] for r in rows])
        body, offset = repeated_windows([x for r in rows for x in r[3]], ids, a)
        owner, first, count = _stretches(body, offset)
        return pa.RecordBatch.from_pydict({"id": pa.array(ids[owner], pa.int64()), "a": pa.array((a[owner] + first).astype(np.int32)), "n": pa.array(count.astype(np.int32))})

    def run(batches):
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            h, ids, a, bodies = np.asarray(batch.column("h")), np.asarray(batch.column("id")), np.asarray(batch.column("a")), batch.column("body").to_pylist()
            edges = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1, [len(h)]])
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if size >= SHARD_BYTES and held and held[-1][0] != h[lo]:
                    yield solve(held)
                    held, size = [], 0
                held.append((h[lo], ids[lo:hi], a[lo:hi], bodies[lo:hi]))
                size += sum(map(len, bodies[lo:hi]))
        if held:
            yield solve(held)

    return contexts.select("h", "id", "a", "body").repartition(F.col("h")).sortWithinPartitions("h", "id", "a").mapInArrow(run, "id long, a int, n int")


def removed_bytes(marks: list, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the maximal removed stretches of a document from its marks (kind, a, n).

    Kinds: 0 a run whose hash repeats, 1 the earliest of equal runs, 2 windows found by a suffix array, 3 an earliest window of a run that
    was taken apart, 4 such a run.
    """
    by = [[], [], [], [], []]
    for kind, a, n in marks:
        by[kind].append((a, n))
    earliest = set(by[1])
    first, count = [], []
    for a, n in [x for x in by[0] if x not in earliest] + by[2]:
        first.append(a)
        count.append(n)
    if by[4]:
        spots = np.unique(np.concatenate([np.arange(a, a + n) for a, n in by[4]]))
        spots = np.setdiff1d(spots, np.array([a for a, _ in by[3]], np.int64))
        first += spots.tolist()
        count += [1] * len(spots)
    if not first:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lo = np.array(first, np.int64)
    hi = np.minimum(lo + np.array(count) + SPAN - 1, size)
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > hi[:-1]
    edge = np.flatnonzero(new)
    return lo[edge], hi[np.append(edge[1:] - 1, len(lo) - 1)]


def marked(texts: DataFrame) -> DataFrame:
    """id and marks of every document that holds a repeated hash; `texts` has id and text."""
    occurrences = found_runs(texts)
    repeated = occurrences.groupBy("h").agg(F.count("*").alias("times")).where("times > 1").select(F.col("h").alias("r"))
    again = stage(occurrences.join(repeated, F.col("h") == F.col("r")).drop("r"))
    earliest = stage(again.groupBy("h", "s").agg(F.min(F.struct("id", "a")).alias("at"), F.max("n").alias("n")).select("h", "at.id", "at.a", "n"))
    several = earliest.groupBy(F.col("h").alias("m")).agg(F.count("*").alias("different")).where("different > 1")
    different = earliest.join(several, F.col("h") == F.col("m")).select("h", "id", "a", "n", (F.col("different") > HOT).alias("hot"))
    asked = different.groupBy(F.col("id").alias("asker")).agg(F.collect_list(F.struct("a", "n", "h", "hot")).alias("wanted"))
    contexts = context_rows(texts.join(asked, F.col("id") == F.col("asker")))
    mark = lambda df, kind, n="n": df.select("id", F.struct(F.lit(kind).alias("kind"), F.col("a"), F.col(n).alias("n") if isinstance(n, str) else F.lit(1).alias("n")).alias("mark"))
    found = mark(again, 0).unionByName(mark(earliest, 1)).unionByName(mark(sorted_shards(contexts.where("body IS NOT NULL")), 2))
    if not several.where(F.col("different") > HOT).isEmpty():
        first = contexts.where("body IS NULL").groupBy("h", "w").agg(F.min(F.struct("id", "a")).alias("at")).select("at.id", "at.a")
        found = found.unionByName(mark(first, 3, 1)).unionByName(mark(different.where("hot"), 4))
    return found.groupBy(F.col("id").alias("owner")).agg(F.collect_list("mark").alias("marks"))


def with_row_key(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with `__rid`, a number that orders documents by id (null first) and tells apart different texts of one id.

    It is the id where no two rows share one. Else the distinct pairs of id and text digest are sorted over ranges and numbered.
    """
    named = docs.withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
    if named.groupBy("__id").agg(F.count("*").alias("__n")).where("__n > 1").isEmpty():
        return named.withColumnRenamed("__id", "__rid")
    named = named.withColumn("__digest", F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))

    def number(batches):
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"__id": batch.column(0), "__digest": batch.column(1), "part": pa.array(np.full(batch.num_rows, part, np.int32)),
                                              "at": pa.array(np.arange(at, at + batch.num_rows))})
            at += batch.num_rows

    pairs = stage(named.select("__id", "__digest").distinct())
    placed = stage(pairs.repartitionByRange("__id", "__digest").sortWithinPartitions("__id", "__digest").mapInArrow(number, "__id long, __digest string, part int, at long"))
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))  # one row per range
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    keys = placed.join(F.broadcast(before), "part").select("__id", "__digest", (F.col("before") + F.col("at")).alias("__rid"))
    return join_checked(named, keys, ["__id", "__digest"]).drop("__id", "__digest")


def _removals(marks: pa.Array) -> list[list[tuple[int, int, int]]]:
    """The marks of each row, none where the row's list is null."""
    ends = np.cumsum(np.asarray(marks.value_lengths().fill_null(0), dtype=np.int64)).tolist()
    flat = marks.flatten()
    each = list(zip(*(np.asarray(flat.field(c)).tolist() for c in ("kind", "a", "n"))))
    return [each[a:b] for a, b in zip([0, *ends], ends)]


def dedup_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document.

    A byte goes when a string of SPAN bytes that covers it also starts earlier (smaller doc_id, or the same document further left), judged on
    the input. A null text is empty; empty and short texts lose nothing; rows without an id come first; different texts of one id, or without
    one, are ordered by a digest; rows that share id and text are one document and get equal results; an empty table gives none; other
    columns are ignored.
    """
    rows = with_row_key(docs.select("doc_id", F.col("text").cast("string").alias("text"))).select(F.col("__rid").alias("id"), "text", F.col("doc_id").cast("long").alias("doc_id"))
    texts = rows.select("id", "text")

    def run(batches):
        for data, starts, ends, piece in text_slices(batches, 4 << 20):
            size, removed, spans, digest = [], [], [], []
            raw = memoryview(data.tobytes())
            for a, b, marks in zip(starts.tolist(), ends.tolist(), _removals(piece.column("marks"))):
                lo, hi = removed_bytes(marks, b - a)
                kept, at = hashlib.sha256(), a
                for p, q in zip(lo.tolist(), hi.tolist()):
                    kept.update(raw[at:a + p])
                    at = a + q
                kept.update(raw[at:b])
                size.append(b - a)
                removed.append(int((hi - lo).sum()))
                spans.append(len(lo))
                digest.append(kept.hexdigest())
            yield pa.RecordBatch.from_pydict({"doc_id": piece.column("doc_id"), "n_bytes": pa.array(size, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
                                              "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(digest, pa.string())})

    joined = rows.join(marked(texts), F.col("id") == F.col("owner"), "left").select("id", "text", "marks", "doc_id")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def stripped(batches, names: list[str], text_col: str):
    """The columns `names` of batches that also have `__marks`, their texts without the marked spans, one slice after the other."""
    for batch in slices(batches, names.index(text_col), STRIPPED):
        out = []
        for text, marks in zip(batch.column(text_col).to_pylist(), _removals(batch.column("__marks"))):
            if not text or not marks:
                out.append(text)
                continue
            raw = text.encode()
            lo, hi = removed_bytes(marks, len(raw))
            kept, at = [], 0
            for p, q in zip(lo.tolist(), hi.tolist()):
                while p < len(raw) and raw[p] & 0xC0 == 0x80:
                    p += 1
                while q > p and q < len(raw) and raw[q] & 0xC0 == 0x80:
                    q -= 1
                kept.append(raw[at:p])
                at = max(at, q)
            kept.append(raw[at:])
            out.append(b"".join(kept).decode())
        new = pa.array(out, pa.string())
        yield pa.RecordBatch.from_arrays([new if c == text_col else batch.column(c) for c in names], names)


def strip_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with the repeated spans taken out of the texts, all other columns as they were; a removed span never splits a code point.

    Ids that are null or shared are told apart by their texts, as in `dedup_documents`.
    """
    keyed = with_row_key(docs, text_col)
    texts = keyed.select(F.col("__rid").alias("id"), F.col(text_col).cast("string").alias("text"))
    marks = marked(texts).withColumnRenamed("owner", "__owner").withColumnRenamed("marks", "__marks")
    names = docs.columns
    joined = keyed.join(marks, F.col("__rid") == F.col("__owner"), "left").select(*names, "__marks")
    return joined.mapInArrow(lambda batches: stripped(batches, names, text_col), docs.schema)
