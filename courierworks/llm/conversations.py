"""Prefix trie of conversations by van Emde Boas recursion.

The depth range of the trie is cut at half, each half again, down to single turns; all parts of one level of the recursion are handled by
one job, so a trie of depth D takes about log2(D) jobs. Three passes use the same cuts:

- blocks: the turns of a conversation are combined in pairs, pairs of pairs and so on; a block of 2^k turns has a digest of 16 bytes;
- names: at every cut the prefix above it gets its name from the name at the top of the part and the digest of the block between; the parts
  above and below a cut then go on independently;
- totals: a part knows the totals of its subtrees as far as it reaches. Two neighbouring parts become one when the totals at the roots of the
  lower forest are grafted on all their ancestors in the upper trie.

A row is one turn, one block or one node, never a whole conversation, so neither a very long conversation nor a very common prefix gathers
anywhere: positions come from ranges of the sorted turns, prefixes are counted before they are shuffled, common ones are looked up by
broadcast (`lookup`), and the digest of the conversations that end at a node is fed from sorted pieces.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courierworks.llm.common import lookup, stage

HEADS = 6  # a conversation takes fewer than this many turns from its base
BASES = 100  # conversations whose ids share all but the last two digits have one base
PIECE_IDS = 1000  # ids that one piece of text for the digest of a node's ends holds at most
NOTHING = hashlib.sha256(b"").hexdigest()


def turn_tokens(conversations: DataFrame) -> DataFrame:
    """conv, turn, token, size of every turn that has a conversation: digest of (role, text) and code points of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    token = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    return conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn"), token.alias("token"), F.char_length(text).cast("long").alias("size"))


def numbered(turns: DataFrame) -> DataFrame:
    """conv, i, token, size: the place of every turn in its conversation, from 0, by (turn, token) with null first; `turns` is a written table.

    Turns are sorted over ranges and counted inside them; only conversations that go on in the next range (one a range at most) need the
    counts of the ranges before.
    """

    def run(batches):
        part, current, count = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = np.asarray(batch.column(0))
            first = np.concatenate([[True], conv[1:] != conv[:-1]])
            start = np.flatnonzero(first)
            i = np.arange(len(conv)) - np.repeat(start, np.diff(np.append(start, len(conv))))
            if conv[0] == current:
                i[:start[1] if len(start) > 1 else None] += count
            current, count = conv[-1], int(i[-1]) + 1
            yield pa.RecordBatch.from_pydict({"conv": batch.column(0), "part": pa.array(np.full(len(conv), part, np.int32)), "i": pa.array(i, pa.int64()),
                                              "token": batch.column(2), "size": batch.column(3)})

    placed = stage(turns.repartitionByRange("conv", "turn", "token").sortWithinPartitions("conv", "turn", "token").mapInArrow(
        run, "conv long, part int, i long, token binary, size long"))
    counts = placed.groupBy("conv", "part").agg(F.count("*").alias("n"))
    torn = counts.join(F.broadcast(counts.groupBy("conv").agg(F.count("*").alias("parts")).where("parts > 1").select("conv")), "conv")
    before = torn.withColumn("before", F.sum("n").over(Window.partitionBy("conv").orderBy("part")) - F.col("n")).where("before > 0")
    return placed.join(F.broadcast(before.select("conv", "part", "before")), ["conv", "part"], "left").select(
        "conv", (F.col("i") + F.coalesce("before", F.lit(0))).alias("i"), "token", "size")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, i, token, size), (conv, length): every conversation with its first turns taken from its base; `turns` is numbered and written."""
    head = F.crc32(F.col("conv").cast("string")) % HEADS
    lengths = stage(turns.groupBy("conv").agg(F.count("*").alias("n")))
    base = lengths.select(F.col("conv").alias("base"), F.least("n", F.lit(HEADS - 1)).alias("there"))
    plan = stage(
        lengths.select("conv", "n", head.alias("head"), (F.col("conv") - F.col("conv") % BASES).alias("base")).join(base, "base", "left")
        .withColumn("taken", F.least("head", F.coalesce("there", F.lit(0))))
        .select("conv", "base", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("head"), F.lit(0))).alias("length")))
    first = turns.where(F.col("i") < HEADS - 1).withColumnRenamed("conv", "base")
    heads = plan.join(first, "base").where("i < taken").select("conv", "i", "token", "size")
    own = lookup(turns.where(F.col("i") >= head), plan.select("conv", "taken"), ["conv"])
    own = own.select("conv", (F.col("i") - head + F.col("taken")).alias("i"), "token", "size")
    return stage(heads.unionByName(own)), plan.select("conv", "length")


def rounds_for(length: int) -> int:
    """Levels of the recursion over depths 0 to `length`."""
    return int(length).bit_length()


def prefix_names(turns: DataFrame, lengths: DataFrame, rounds: int) -> DataFrame:
    """conv, d, name: the name of every prefix of every conversation, the empty one included."""
    levels = [turns.select("conv", F.col("i").alias("j"), F.col("token").alias("digest"))]
    for _ in range(rounds - 1):
        side = lambda odd: F.max(F.when(F.col("j") % 2 == odd, F.col("digest")))
        pairs = levels[-1].groupBy("conv", F.shiftright("j", 1).alias("half")).agg(side(0).alias("a"), side(1).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
        levels.append(stage(pairs.select("conv", F.col("half").alias("j"), F.unhex(F.md5(F.concat("a", "b"))).alias("digest"))))
    names = lengths.select("conv", F.lit(0).cast("long").alias("j"), F.unhex(F.lit("")).alias("name"))
    for level in reversed(levels[:rounds]):
        upper = level.where(F.col("j") % 2 == 0).select("conv", F.shiftright("j", 1).alias("j"), "digest")
        cut = F.struct((2 * F.col("j") + 1).alias("j"), F.unhex(F.md5(F.concat("name", "digest"))).alias("name"))
        top = F.struct((2 * F.col("j")).alias("j"), F.col("name"))
        names = names.join(upper, ["conv", "j"], "left").select(
            "conv", F.explode(F.when(F.col("digest").isNull(), F.array(top)).otherwise(F.array(top, cut))).alias("at")).select("conv", "at.*")
    return names.withColumnRenamed("j", "d")


def grafted(totals: DataFrame, paths: DataFrame, rounds: int, columns: list[str]) -> DataFrame:
    """conv, d and `columns` summed over the subtree of every node; `totals` holds the nodes' own values, `paths` (conv, d, low) names the nodes."""
    for k in range(1, rounds + 1):
        span, half = 1 << k, 1 << (k - 1)
        roots = totals.where(F.col("d") % span == half)
        above = roots.select("conv", F.explode(F.sequence(F.col("d") - half, F.col("d") - 1)).alias("d"), *columns)
        gains = above.join(paths.where(F.col("d") % span < half).select("conv", "d", "low"), ["conv", "d"]).groupBy("low", "d").agg(*[F.sum(c).alias(f"more_{c}") for c in columns])
        totals = stage(totals.join(gains.withColumnRenamed("low", "conv"), ["conv", "d"], "left").select(
            "conv", "d", *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in columns]))
    return totals


def id_digests(ends: DataFrame) -> DataFrame:
    """low, d, digest: SHA-256 of the ids `conv` of every (low, d), ascending and joined by commas; `ends` is a written table.

    Ids are sorted over ranges and written as pieces of text there, so that a node where very many conversations end costs its last task one
    row per PIECE_IDS of them, which it feeds to the digest one after another.
    """

    def pieces(batches):
        for batch in batches:
            low, d, conv = (np.asarray(batch.column(i)) for i in range(3))
            edges = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (d[1:] != d[:-1])])) if len(low) else np.zeros(0, np.int64)
            starts = np.concatenate([np.arange(a, b, PIECE_IDS) for a, b in zip(edges, np.append(edges[1:], len(low)))]) if len(edges) else edges
            text = [",".join(map(str, conv[a:b].tolist())) for a, b in zip(starts, _stops(starts, edges, len(low)))]
            yield pa.RecordBatch.from_pydict({"low": pa.array(low[starts], pa.int64()), "d": pa.array(d[starts], pa.int64()), "first": pa.array(conv[starts], pa.int64()), "ids": pa.array(text, pa.string())})

    def digests(batches):
        current, state = None, None
        for batch in batches:
            done = []
            for low, d, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                if (low, d) == current:
                    state.update(b",")
                else:
                    if current is not None:
                        done.append((*current, state.hexdigest()))
                    current, state = (low, d), hashlib.sha256()
                state.update(ids.encode())
            yield _digest_rows(done)
        if current is not None:
            yield _digest_rows([(*current, state.hexdigest())])

    cut = ends.select("low", "d", "conv").repartitionByRange("low", "d", "conv").sortWithinPartitions("low", "d", "conv").mapInArrow(pieces, "low long, d long, first long, ids string")
    return cut.repartition("low", "d").sortWithinPartitions("low", "d", "first").mapInArrow(digests, "low long, d long, digest string")


def _stops(starts: np.ndarray, edges: np.ndarray, n: int) -> np.ndarray:
    """Where each piece ends: at the next piece, and never beyond its group, since every group starts a piece."""
    return np.append(starts[1:], n) if len(starts) else starts


def _digest_rows(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    low, d, digest = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_pydict({"low": pa.array(low, pa.int64()), "d": pa.array(d, pa.int64()), "digest": pa.array(digest, pa.string())})


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A null role or text is empty; a null turn comes first, and turns of equal number are ordered by the digest of role and text; repeated rows
    are turns of their own; rows without conv_id belong to no conversation; an empty table has no node, not even a root; other columns are
    ignored. Negative ids take the base that truncating division gives.
    """
    turns, lengths = rebuilt(stage(numbered(stage(turn_tokens(conversations)))))
    rounds = rounds_for(lengths.agg(F.max("length")).first()[0] or 0)
    names = stage(prefix_names(turns, lengths, rounds))
    members = names.groupBy("d", "name").agg(F.min("conv").alias("low"), F.count("*").alias("n"))
    paths = stage(lookup(names, members, ["d", "name"]).select("conv", "d", "low", "n"))
    parents = paths.select("conv", (F.col("d") + 1).alias("d"), F.col("low").alias("parent"))
    last = turns.select("conv", (F.col("i") + 1).alias("d"), "size")
    nodes = stage(paths.where("conv = low").select("conv", "d", "n").join(parents, ["conv", "d"], "left").join(last, ["conv", "d"], "left"))
    children = nodes.where("d > 0").groupBy(F.col("parent").alias("conv"), (F.col("d") - 1).alias("d")).agg(F.count("*").alias("n_children"))
    nodes = stage(nodes.join(children, ["conv", "d"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")))
    own = nodes.select("conv", "d", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"),
                       ((F.col("n") - 1) * F.coalesce("size", F.lit(0))).alias("saved"))
    totals = grafted(own, paths, rounds, ["leaves", "saved"])
    ends = stage(paths.join(lengths.withColumnRenamed("length", "d"), ["conv", "d"]).select("low", "d", "conv"))
    digests = id_digests(ends).withColumnRenamed("low", "conv")
    return nodes.join(totals, ["conv", "d"]).join(digests, ["conv", "d"], "left").select(
        F.col("conv").alias("conv_id"), F.col("d").alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children",
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("digest", F.lit(NOTHING)).alias("ends_sha256"))
