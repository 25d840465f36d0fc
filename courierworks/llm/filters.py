"""Audit of five text filters in every order, with radix tries for the copies.

Filters A to D look at one text; filter E asks whether the same text has a smaller id anywhere in the table. Copies are found in two steps:

- where the texts are read, equal texts of one task are put together: only the rows with the smallest id of a text so far go on, all others
  are known to fail E and travel without their text;
- what goes on is partitioned by ranges of adaptive text prefixes: a prefix that many bytes share is made longer, again and again, until
  it holds little or the whole text. Equal texts have equal prefixes, so each meets its copies in one compressed trie. Whole texts are inserted; a
  terminal holds the smallest id, and a walk over the terminals settles E.

A text that a third of all documents share so costs hardly more than a row a task, and a trie holds the texts of a few neighbouring prefixes.
What is left of a document is a mask of five bits. Masks are counted per part, and every figure of every order follows from 32 counts.
"""

from __future__ import annotations

import hashlib
import json
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courierworks.llm.common import slices, stage
from courierworks.operators.keyed import join_checked
from courierworks.session import checkpoint

FILTERS = "ABCDE"
MIN_WORDS = 50
DISTINCT_PERCENT = 65
CAPITAL_PERCENT = 5
SYMBOLS = b"#$%&*|"
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
FIRST_PREFIX = 16  # characters of the first prefix; a crowded one grows by GROWTH
GROWTH = 8
CROWDED = 16 << 20  # bytes of candidates that one prefix may hold before it grows
TRIE_BYTES = 32 << 20  # text after which a trie is walked and a new one begun
SEEN = 500_000  # digests of texts that a reading task remembers; it then starts anew, which only sends more rows on
SLICE = 4 << 20


def own_faults(text: bytes) -> int:
    """Bits of the filters A to D that a text fails; words are split at ASCII white space, as `bytes.split` does."""
    words = text.split()
    points = len(text) - len(text.translate(None, _TAIL))  # bytes that begin a code point
    mask = len(words) < MIN_WORDS
    mask |= (100 * len(set(words)) < DISTINCT_PERCENT * len(words)) << 1
    mask |= (100 * (len(text) - len(text.translate(None, CAPITALS))) > CAPITAL_PERCENT * points) << 2
    return int(mask | (len(text.translate(None, SYMBOLS)) < len(text)) << 3)


_TAIL = bytes(b for b in range(256) if b & 0xC0 != 0x80)


class RadixTrie:
    """A compressed trie over whole texts; a terminal holds the smallest id and the numbers of the rows that end there."""

    def __init__(self) -> None:
        self.root: list = [b"", {}, None]  # label, children by first byte, terminal [smallest id, rows]

    def insert(self, text: bytes, doc_id: int, row: int) -> None:
        node, at = self.root, 0
        while at < len(text):
            child = node[1].get(text[at])
            if child is None:
                node[1][text[at]] = [text[at:], {}, [doc_id, [row]]]
                return
            label = child[0]
            if text.startswith(label, at):
                node, at = child, at + len(label)
                continue
            same = common_length(label, text, at)
            middle = [label[:same], {label[same]: child}, None]
            child[0] = label[same:]
            node[1][text[at]] = middle
            node, at = middle, at + same
        if node[2] is None:
            node[2] = [doc_id, [row]]
        else:
            node[2][0] = min(node[2][0], doc_id)
            node[2][1].append(row)

    def terminals(self):
        """(smallest id, rows) of every text."""
        open_nodes = [self.root]
        while open_nodes:
            node = open_nodes.pop()
            if node[2] is not None:
                yield node[2]
            open_nodes.extend(node[1].values())


def common_length(label: bytes, text: bytes, at: int) -> int:
    """Bytes that `label` and `text[at:]` share from the start, by halving."""
    low, high = 0, min(len(label), len(text) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if text.startswith(label[:middle], at):
            low = middle
        else:
            high = middle - 1
    return low


def first_look(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask, n, text: rows of one slice with equal text, id and part as one.

    `text` is null for rows whose E is settled: those with a smaller id of the same text before them in the task or in their slice (bit
    set), and rows without an id, which have no smaller one and are no smaller one to others.
    """
    last = 1 << FILTERS.index("E")

    def run(batches):
        seen: dict[bytes, int] = {}
        for batch in slices(batches, 2, SLICE):
            groups: dict[bytes, dict] = {}
            for doc_id, part, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()):
                group = groups.setdefault(text, {})
                group[doc_id, part] = group.get((doc_id, part), 0) + 1
            out = []
            for text, group in groups.items():
                mask, digest = own_faults(text), hashlib.md5(text).digest()
                least = min((x for x in [seen.get(digest), *(doc_id for doc_id, _ in group)] if x is not None), default=None)
                for (doc_id, part), n in group.items():
                    known = doc_id is None or doc_id > least
                    out.append((doc_id, part, mask | (last if known and doc_id is not None else 0), n, None if known else text.decode()))
                if least is not None:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen[digest] = least
            if out:
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.string()))],
                                                 ["doc_id", "part", "mask", "n", "text"])

    return docs.mapInArrow(run, "doc_id long, part string, mask int, n long, text string")


def with_prefix(candidates: DataFrame) -> DataFrame:
    """`candidates` (a written table) with `prefix`: as many characters of the text as it takes until few bytes share them, or the whole text.

    The prefixes to be made longer are at most total / CROWDED a round; they are broadcast only when they are few.
    """
    done, rest, length = [], candidates.withColumn("prefix", F.substring("text", 1, FIRST_PREFIX)), FIRST_PREFIX
    while True:
        longer = F.when(F.char_length("text") > length, F.octet_length("text"))
        crowded = checkpoint(rest.groupBy("prefix").agg(F.sum(F.octet_length("text")).alias("bytes"), F.count(longer).alias("longer"))
                             .where((F.col("bytes") > CROWDED) & (F.col("longer") > 0)).select("prefix"))
        if crowded.isEmpty():
            done.append(rest)
            break
        done.append(join_checked(rest, crowded, ["prefix"], "left_anti"))
        length *= GROWTH
        rest = join_checked(rest, crowded, ["prefix"], "left_semi").withColumn("prefix", F.substring("text", 1, length))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more.select(out.columns))
    return out


def settled(candidates: DataFrame) -> DataFrame:
    """doc_id, part, mask, n of every candidate, E settled by the tries of its prefix range."""
    last = 1 << FILTERS.index("E")

    def flush(trie, held):
        fails = np.zeros(len(held), np.int32)
        for least, rows in trie.terminals():
            for row in rows:
                fails[row] = held[row][0] > least
        doc_id, part, mask, n = zip(*held)
        return pa.RecordBatch.from_pydict({"doc_id": pa.array(doc_id, pa.int64()), "part": pa.array(part, pa.string()),
                                           "mask": pa.array(np.array(mask, np.int32) | fails * last, pa.int32()), "n": pa.array(n, pa.int64())})

    def run(batches):
        trie, held, size, current = RadixTrie(), [], 0, None
        for batch in slices(batches, 4, SLICE):
            for prefix, doc_id, part, mask, text, n in zip(*(batch.column(c).to_pylist() for c in ("prefix", "doc_id", "part", "mask", "text", "n"))):
                if size >= TRIE_BYTES and prefix != current:
                    yield flush(trie, held)
                    trie, held, size = RadixTrie(), [], 0
                text = text.encode()
                trie.insert(text, doc_id, len(held))
                held.append((doc_id, part, mask, n))
                size += len(text)
                current = prefix
        if held:
            yield flush(trie, held)

    spread = candidates.repartitionByRange("prefix").sortWithinPartitions("prefix")
    return spread.select("prefix", "doc_id", "part", "mask", "text", "n").mapInArrow(run, "doc_id long, part string, mask int, n long")


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask, n: the filters that each document fails; equal rows of one id may come as one with their number."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    looked = stage(first_look(named))
    return settled(with_prefix(looked.where("text IS NOT NULL"))).unionByName(looked.where("text IS NULL").drop("text"))


def mask_counts(found: DataFrame, labels: DataFrame) -> DataFrame:
    """part, and per mask (arrays of 32) the documents, the good and the toxic ones; `found` is a written table.

    A document is what any of its label rows says; rows without an id need no label and stay out of the join.
    """
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    joined = found.where("doc_id IS NOT NULL").join(marks, "doc_id", "left").unionByName(found.where("doc_id IS NULL"), allowMissingColumns=True)
    counted = joined.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), *[F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic")])
    whole = lambda c: F.array(*[F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0)).cast("long") for m in range(32)])
    return counted.groupBy("part").agg(*[whole(c).alias(c) for c in ("n", "good", "toxic")])


def steps() -> Column:
    """The five steps of the 120 orders as one literal: filter_order, step, bit of the filter, mask of the filters before."""
    rows = []
    for order in permutations(FILTERS):
        before = 0
        for k, name in enumerate(order, 1):
            rows.append({"filter_order": "".join(order), "step": k, "bit": 1 << FILTERS.index(name), "before": before})
            before |= 1 << FILTERS.index(name)
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<filter_order: string, step: int, bit: int, before: int>>")


def audited(counts: DataFrame) -> DataFrame:
    """The figures of every step of every order, from the mask counts of each part."""
    rows = counts.withColumn("at", F.explode(steps())).select("part", "n", "good", "toxic", "at.*")

    def over(values: str, takes, share=lambda m: 1) -> Column:
        terms = [F.when(takes(F.lit(m)), F.col(values)[m] * share(m)).otherwise(0) for m in range(32)]
        total = terms[0]
        for term in terms[1:]:
            total = total + term
        return total.cast("long")

    bit, before = F.col("bit"), F.col("before")
    fails = lambda m: m.bitwiseAND(bit) != 0
    passed = lambda m: m.bitwiseAND(before) == 0
    removed = lambda m: fails(m) & passed(m)
    return rows.select(
        "part", "filter_order", "step", over("n", lambda m: ~fails(m) & passed(m)).alias("kept"), over("n", removed).alias("removed"),
        over("n", lambda m: fails(m) & ~passed(m)).alias("redundant"), over("n", lambda m: m == bit).alias("unique_fails"),
        over("good", removed).alias("good_lost"), over("toxic", removed).alias("toxic_lost"),
        over("n", fails, lambda m: 120 // max(1, bin(m).count("1"))).alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: 600 rows per part.

    A null text is empty and a null source the part ''; an empty text fails A and, where another empty text has a smaller id, E. Rows of
    one id with the same text are no copies of each other; rows without an id never fail E, are no smaller id to others, and have no label.
    Several label rows of one id count as one that has what any of them has. An empty table gives no rows; other columns are ignored.
    """
    return audited(mask_counts(stage(masks(docs)), labels))
