"""Jaccard join of word-shingle sets by chosen paths.

Each set samples about 1 / similarity of its shingles in each of several independent runs; sets that choose the same shingle in the same run
share a bucket. Inside a small bucket sketches are compared all against all, and the sets that may be similar are tied together. A large bucket
is compared with a few of its members as pivots; sets that they don't settle in all of their large buckets are open. Open sets choose again, on
longer paths: each path takes the smallest shingle under each of its steps' hashes, and sets with equal paths share a bucket. A path belongs to
a set, not to one of its buckets, so an open set has as many rows as paths however many large buckets it was in. Tied groups are then verified
on their whole shingle sets, in blocks of a bounded number of documents, so that every pair of a group meets in exactly one task. A pair of
the wanted similarity s shares no bucket of ten runs with probability at most exp(-10), and no path of r steps out of p with (1 - s ** r) ** p;
at 0.8 that is 4.5e-5, then 1.3e-5 (seven paths of one step) and 2.1e-5 (15 of three): at most 7.9e-5 of such pairs never meet, a recall over
0.9999 in small and in large buckets.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courierworks.llm.common import HASH_BYTES, gathered, stage, text_slices
from courierworks.llm.components import connected
from courierworks.llm.shingles import mix, word_shingles

SHINGLE = 5
RUNS = 10
STEPS = (1, 3)  # of the paths of each further split
LEVELS = len(STEPS)  # further splits of large buckets
PARTED = 2.2e-5  # probability at most with which a further split parts a similar pair
SMALL = 192  # sets in a bucket that are compared all against all
BINS = 128  # of a sketch
SLACK = 0.2  # a sketch may underrate a pair by this much: more than five standard deviations
PIVOTS = 3  # members of a large bucket that all others are compared with
FEW_PIVOTS = 20_000  # of all large buckets that are broadcast with their sketches
WIDER = 5  # what is still large after the last split is compared in blocks that are wider than small buckets, so each set is copied less often
# At 0.8: settled from 0.6 to a pivot, tied from 0.2. What is 0.8 to a settled member is at least 1 - 0.4 - 0.2 = 0.4 to the pivot, which lies more
# than four standard deviations of a sketch above 0.2.
LOOSE, CLOSE = 0.6, 0.2
BLOCK = 96  # documents of a group that are verified together
BLOCK_SHINGLES = 1_000_000


def _bytes(a: np.ndarray) -> list[bytes]:
    return [row.tobytes() for row in a]


def _limits(share: np.ndarray) -> np.ndarray:
    """Largest hash that a sample of this share takes."""
    return np.where(share >= 1.0, np.iinfo(np.uint64).max, (np.minimum(share, 0.999) * 2.0 ** 63).astype(np.uint64) * np.uint64(2))


def _lists(samples: list[tuple[np.ndarray, np.ndarray]], n: int) -> pa.Array:
    """For each of n owners a list with one list of values per sample (owner, value)."""
    each = len(samples)
    owner = np.concatenate([o * each + i for i, (o, _) in enumerate(samples)])
    value = np.concatenate([v for _, v in samples])
    order = np.argsort(owner, kind="stable")
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n * each))])
    inner = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(value[order]))
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * each, pa.int32()), inner)


def _paths(similarity: float, steps: int) -> int:
    """How many paths of so many steps a set needs to meet a similar one."""
    together = min(similarity, 1.0) ** steps
    return 1 if together >= 1.0 else int(np.ceil(np.log(PARTED) / np.log1p(-together)))


def _chosen(value: np.ndarray, at: np.ndarray, level: int, similarity: float) -> np.ndarray:
    """One row of paths for each set of values that starts at `at`; two sets take the same step as often as they are similar."""
    steps, out = STEPS[level], []
    for path in range(_paths(similarity, steps)):
        token = np.full(len(at), path, np.uint64)
        for step in range(steps):
            factor = mix(np.array([0x2000 + (level << 20) + path * steps + step], np.uint64)) | np.uint64(1)
            token = mix(token + np.minimum.reduceat(value * factor, at))
        out.append(token.astype(np.uint32).view(np.int32))  # equal tokens by chance join buckets, nothing else
    return np.stack(out, 1)


def profiles(docs: DataFrame, similarity: float, runs: int = RUNS) -> DataFrame:
    """doc_id, n, two sums that identify the set, sketch, the bucket keys of each run, and the paths of each further split."""

    def run(batches):
        for data, starts, ends, piece in text_slices(batches, HASH_BYTES):
            rows = len(starts)
            owner, value = word_shingles(data, starts, ends, SHINGLE)
            n = np.bincount(owner, minlength=rows)
            sums = [np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)]
            full = np.flatnonzero(n)
            deep = [np.zeros((rows, _paths(similarity, steps)), np.int32) for steps in STEPS]
            if len(full):
                at = np.concatenate([[0], np.cumsum(n)[:-1]])[full]
                for i, total in enumerate(sums):
                    total[full] = np.add.reduceat(mix(value + np.uint64(i + 1)), at)
                for level, paths in enumerate(deep):
                    paths[full] = _chosen(value, at, level, similarity)
            lanes = np.full(rows * BINS, np.iinfo(np.uint64).max)
            again = mix(value ^ np.uint64(0xA5A5A5A5A5A5A5A5))
            np.minimum.at(lanes, owner * BINS + (again & np.uint64(BINS - 1)).astype(np.int64), again >> np.uint64(7))
            sketch = np.where(lanes == np.iinfo(np.uint64).max, 0, 1 + mix(lanes) % np.uint64(255)).astype(np.uint8).reshape(rows, BINS)
            share = np.minimum(1.0 / (similarity * np.maximum(n, 1)), 1.0)
            limit = _limits(share)[owner]
            keys = []
            for r in range(runs):
                u = mix(value + np.uint64(0x1000 + r))
                hit = u <= limit
                keys.append((owner[hit], mix(u[hit] ^ np.uint64(0x5851F42D4C957F2D)).view(np.int64)))
            yield pa.RecordBatch.from_pydict({
                "doc_id": piece.column(0), "n": pa.array(n, pa.int64()), "s1": pa.array(sums[0].view(np.int64)), "s2": pa.array(sums[1].view(np.int64)),
                "sketch": pa.array(_bytes(sketch), pa.binary()), "keys": _lists(keys, rows),
                **{f"deep{level}": pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * paths.shape[1], pa.int32()), pa.array(paths.ravel())) for level, paths in enumerate(deep)}})

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return named.mapInArrow(run, "doc_id long, n long, s1 long, s2 long, sketch binary, keys array<array<long>>, " + ", ".join(f"deep{i} array<int>" for i in range(LEVELS)))


def _grouped(batches, keys: list[str]):
    """Groups of consecutive rows with equal keys, as tables; a group may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(k)) for k in keys]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:]):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _roots(linked: np.ndarray) -> np.ndarray:
    """Smallest index of each component of a symmetric matrix of links."""
    label = np.arange(len(linked))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(label)).min(1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def tied(buckets: DataFrame, similarity: float) -> DataFrame:
    """a, b: ties inside each bucket (key, id, n, sketch) between sets whose sketches allow the similarity."""

    def run(batches):
        for group in _grouped(batches, ["key"]):
            ids, size = np.asarray(group["id"]), np.asarray(group["n"]).astype(np.float64)
            order = np.argsort(ids, kind="stable")
            ids, size = ids[order], size[order]
            sketch = np.frombuffer(b"".join(group["sketch"].to_pylist()), np.uint8).reshape(-1, BINS)[order]
            equal = np.zeros((len(ids), len(ids)), np.int32)
            some = np.zeros((len(ids), len(ids)), np.int32)
            for at in range(0, BINS, 16):
                part = sketch[:, at:at + 16]
                full = part > 0
                equal += ((part[:, None, :] == part[None, :, :]) & full[:, None, :]).sum(2, dtype=np.int32)
                some += (full[:, None, :] | full[None, :, :]).sum(2, dtype=np.int32)
            linked = (equal >= (similarity - SLACK) * some) & (np.minimum(size[:, None], size[None, :]) >= similarity * np.maximum(size[:, None], size[None, :]) - 1e-9)
            root = _roots(linked)
            other = np.flatnonzero(root != np.arange(len(ids)))
            yield pa.RecordBatch.from_pydict({"a": pa.array(ids[root[other]], pa.int64()), "b": pa.array(ids[other], pa.int64())})

    ordered = buckets.select("key", "id", "n", "sketch").repartition(F.col("key")).sortWithinPartitions("key")
    return ordered.mapInArrow(run, "a long, b long").where("a <> b")


def bucket_pivots(large: DataFrame) -> DataFrame:
    """pivot: the pivots of large buckets (key, id, pivots); each bucket names them once, not once per member."""
    return large.select("key", "pivots").dropDuplicates(["key"]).select(F.explode("pivots").alias("pivot")).distinct()


def pivoted(large: DataFrame, sets: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(ties a, b; rows of `large` that stay open) from the comparison of large buckets (key, id, pivots) with their pivots.

    The pivots of all buckets of a set, a few for each of its sampled shingles, are gathered first: buckets of one group mostly share them.
    A member is tied to a pivot unless its sketch is far off, and settled if it is close: whatever is similar to a settled member is then
    near enough to the same pivot to be tied to it, so their group is verified as a whole and the member needs no further splits.
    The sketches of the pivots are broadcast if they are few (counted first), as most rows of a dense group have the same ones.
    """
    size = sets.count()

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BINS) for c in ("sketch", "other"))
            equal, some = ((x == y) & (x > 0)).sum(1), ((x > 0) | (y > 0)).sum(1)
            out = pa.RecordBatch.from_arrays([batch.column("pivot"), batch.column("id"), pa.array(equal >= (similarity - CLOSE) * some)], ["a", "b", "settled"])
            yield out.filter(pa.array(equal >= (similarity - LOOSE) * some))

    met = large.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_set("pivots"))).alias("pivots")).select("id", F.explode("pivots").alias("pivot"))
    others = sets.select(F.col("id").alias("pivot"), F.col("sketch").alias("other"))
    named = stage(gathered(bucket_pivots(large), size))
    if named.count() <= FEW_PIVOTS:
        others = F.broadcast(others.join(F.broadcast(named), "pivot"))
    both = met.join(sets.select("id", "sketch"), "id").join(others, "pivot")
    marks = stage(gathered(both, PIVOTS * size).mapInArrow(run, "a long, b long, settled boolean"))
    close = marks.where("settled").groupBy(F.col("b").alias("id")).agg(F.collect_list("a").alias("close"))
    left = large.join(close, "id", "left").where("close IS NULL OR NOT arrays_overlap(pivots, close)").select("key", "id")
    return marks.where("a <> b").select("a", "b"), left


def in_blocks(rows: DataFrame, small: int) -> DataFrame:
    """key, id: buckets (key, id, members) cut into blocks; every two blocks of a bucket, and each block, become one key."""
    cut = rows.withColumn("blocks", F.ceil(F.col("members") * 2 / small).cast("int"))
    cut = cut.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks").cast("long")).cast("int"))
    met = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return met.select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("key"), "id")


def candidates(sets: DataFrame, similarity: float, levels: int = LEVELS, small: int = SMALL) -> DataFrame:
    """a, b: ties of all buckets. `sets` has id, n, sketch, keys and the paths of further splits, one row per distinct set.

    Members of a large bucket are compared with a few pivots, which settles those of dense groups; the others are split again by their longer
    paths, once for all of their buckets, and what is still large after the last split is compared in blocks. The small buckets of all splits,
    and the blocks, meet their sketches in one join.
    """
    size, short = sets.count(), sets.select("id", "n", "sketch")
    rows = sets.select("id", F.explode(F.flatten("keys")).alias("key"))
    alike, ties = [], []  # buckets and blocks that are compared all against all; ties to pivots
    for level in range(levels + 1):
        pivots = F.array(*[F.min_by("id", F.xxhash64("id", F.lit(i))) for i in range(PIVOTS)])
        counted = rows.groupBy("key").agg(F.count("*").alias("members"), pivots.alias("pivots")).where("members > 1")
        shared = stage(gathered(rows.join(counted, "key"), RUNS * size))
        alike.append(shared.where(F.col("members") <= small).select(F.xxhash64(F.lit(level), "key").alias("key"), "id"))
        large = shared.where(F.col("members") > small)
        if large.isEmpty():
            break
        found, left = pivoted(large, sets, similarity)
        ties.append(found)
        left = stage(gathered(left, RUNS * size))
        if level == levels:
            again = left.join(left.groupBy("key").agg(F.count("*").alias("members")), "key")
            alike.append(in_blocks(again, WIDER * small))
        else:
            again = left.select("id").distinct().join(sets.select("id", f"deep{level}"), "id")
            rows = again.select("id", F.posexplode(f"deep{level}").alias("path", "token")).select("id", F.xxhash64("path", "token").alias("key"))
    return reduce(DataFrame.unionByName, [tied(reduce(DataFrame.unionByName, alike).join(short, "id"), similarity), *ties])


def _overlaps(owner: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Sizes of all pairwise intersections of n sets given as (owner, value)."""
    order = np.argsort(value, kind="stable")
    owner, value = owner[order], value[order]
    first = np.ones(len(value), bool)
    first[1:] = value[1:] != value[:-1]
    token = np.cumsum(first) - 1
    common = np.bincount(token)[token] > 1
    owner, token = owner[common], token[common]
    out = np.zeros((n, n), np.float32)
    if not len(token):
        return out
    _, token = np.unique(token, return_inverse=True)
    for at in range(0, int(token.max()) + 1, 4096):
        a, b = np.searchsorted(token, [at, at + 4096])
        matrix = np.zeros((n, min(4096, int(token[b - 1]) - at + 1)), np.float32)
        matrix[owner[a:b], token[a:b] - at] = 1.0
        out += matrix @ matrix.T
    return out


def verified(members: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """id, links, text_links, root per document and task: links verified on whole shingle sets inside (group, blocks).

    `members` has id, copies, grp, blocks (of its group) and block. Pairs inside a block meet in the task (block, block), pairs of two
    blocks in the task (smaller, larger).
    """

    def sets(batches):
        for data, starts, ends, piece in text_slices(batches, HASH_BYTES):
            owner, value = word_shingles(data, starts, ends, SHINGLE)
            bounds = np.searchsorted(owner, np.arange(len(starts) + 1))
            yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array([value[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary()),
                                              *(piece.column(c) for c in ("copies", "grp", "blocks", "block"))], ["id", "shingles", "copies", "grp", "blocks", "block"])

    def compared(batches):
        for group in _grouped(batches, ["grp", "lo", "hi"]):
            ids = np.asarray(group["id"])
            _, keep = np.unique(ids, return_index=True)  # repeated rows of one id count once
            ids, copies, block = ids[keep], np.asarray(group["copies"])[keep].astype(np.int64), np.asarray(group["block"])[keep]
            raw = group["shingles"].take(pa.array(keep)).to_pylist()
            parts = [np.frombuffer(x, np.uint64) for x in raw]
            size = np.array([len(p) for p in parts], np.float64)
            both = _overlaps(np.repeat(np.arange(len(ids)), size.astype(int)), np.concatenate(parts), len(ids)).astype(np.float64)
            linked = both >= similarity * (size[:, None] + size[None, :] - both) - 1e-9
            np.fill_diagonal(linked, False)
            if np.asarray(group["lo"])[0] != np.asarray(group["hi"])[0]:
                linked &= block[:, None] != block[None, :]
            root = _roots(linked)
            yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "links": pa.array((linked * copies[None, :]).sum(1), pa.int64()),
                                              "text_links": pa.array(linked.sum(1), pa.int64()), "root": pa.array(ids[root], pa.int64())})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    joined = texts.join(members, F.col("doc_id") == F.col("id")).select("id", "text", "copies", "grp", "blocks", "block")
    known = joined.mapInArrow(sets, "id long, shingles binary, copies long, grp long, blocks int, block int")
    met = (known.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
           .select("grp", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "id", "shingles", "copies", "block"))
    ordered = met.repartition(F.col("grp"), F.col("lo"), F.col("hi")).sortWithinPartitions("grp", "lo", "hi")
    return ordered.mapInArrow(compared, "id long, links long, text_links long, root long")


def join_documents(docs: DataFrame, similarity: float = 0.8, runs: int = RUNS) -> DataFrame:
    """Class and links of every document: word-shingle sets with a Jaccard similarity of at least `similarity` are linked.

    Columns: doc_id, class_id (smallest id of all documents reached through links), n_links (other documents linked to it, copies included),
    n_text_links (other distinct sets linked to it), n_shingles. Words are cut at ASCII white space; a text of fewer than five words has one
    shingle of all of them. Null and empty texts have no shingles: each is its own class without links. Rows without an id get a null class.
    Repeated rows count as copies; rows that share an id should share their text. An empty table gives none; other columns are ignored.
    """
    known = stage(profiles(docs, similarity, runs))
    copies = known.where("n > 0 AND doc_id IS NOT NULL").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"))
    size = known.count()
    copies = stage(gathered(copies, size))
    picked = known.join(copies.select(F.col("id"), F.col("s1").alias("c1"), F.col("s2").alias("c2")), (F.col("doc_id") == F.col("id")) & (F.col("s1") == F.col("c1")) & (F.col("s2") == F.col("c2")))
    sets = stage(gathered(picked.select("id", "n", "sketch", "keys", *[f"deep{i}" for i in range(LEVELS)]).dropDuplicates(["id"]), size))
    groups = connected(candidates(sets, similarity), rows=size)
    sized = groups.join(copies.select(F.col("id").alias("node"), "copies", "n"), "node").dropDuplicates(["node"])
    totals = sized.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / F.lit(BLOCK)), F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES))).cast("int").alias("blocks"))
    members = sized.join(totals, "root").select(F.col("node").alias("id"), "copies", F.col("root").alias("grp"), "blocks", F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int").alias("block"))
    links = stage(verified(members, docs, similarity))
    classes = connected(links.where("id <> root"), "id", "root", size)
    per_set = links.groupBy("id").agg(F.sum("links").alias("links"), F.sum("text_links").alias("text_links"))
    results = (copies.join(per_set, "id", "left").join(classes.select(F.col("node").alias("id"), "root"), "id", "left")
               .select(F.col("s1").alias("c1"), F.col("s2").alias("c2"), F.col("n").alias("cn"), F.coalesce("root", "id").alias("class"), "copies",
                       F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("text_links", F.lit(0)).alias("text_links")))
    mine = (F.col("s1") == F.col("c1")) & (F.col("s2") == F.col("c2")) & (F.col("n") == F.col("cn")) & F.col("doc_id").isNotNull()
    return known.select("doc_id", "n", "s1", "s2").join(results, mine, "left").select(
        "doc_id", F.coalesce("class", "doc_id").alias("class_id"), F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).alias("n_links"),
        F.coalesce("text_links", F.lit(0)).alias("n_text_links"), F.col("n").alias("n_shingles"))


def one_per_class(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """The documents that are the first of their class, with the columns of `docs`; of rows with one id and text one stays.

    Rows without an id are in no class and stay.
    """
    leaders = join_documents(docs, similarity).where("doc_id = class_id").select(F.col("doc_id").alias("__leader")).distinct()
    kept = docs.join(leaders, F.col("doc_id") == F.col("__leader"), "left").where("__leader IS NOT NULL OR doc_id IS NULL").select(*[docs[c] for c in docs.columns])
    order = F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("doc_id"))
    return kept.withColumn("__row", order).where("__row = 1").drop("__row")
