"""Token ids in directly addressable codes.

Ids are cut into 8-bit chunks, lowest first. Level k holds the k-th chunk of every id that has one, and a bitmap with one bit per entry that
says whether the id goes on in level k + 1; a rank directory counts the set bits before every 512th entry. The i-th id is read by following
its rank from level to level: no block is decoded. A file row is one shard: up to a few million ids of consecutive documents with their ids
and offsets.
"""

from __future__ import annotations

import re
import sys
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courierworks.llm.common import memory, slices, stage
from courierworks.session import new_folder

END = 2  # id that ends a document
CHUNK = 8  # bits of a chunk
RANK = 512  # entries between two counts of the rank directory
SHARD_TOKENS = 2_000_000
CACHE = 600_000  # pieces in each half of what a worker remembers
PIECE = 48  # characters of the longest piece that is remembered
WIDE = 0x10000
LINES = 1000  # pieces that go to the library as lines of one text
TEXT_SLICE = 2 << 20  # text that is encoded at once
VOCABULARY = "byte_bpe_50k.json"
# the character that a byte-level vocabulary writes for each byte: printable ones stand for themselves, the others follow 255
PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTES = {b: chr(b if b in PRINTABLE else 256 + sum(x not in PRINTABLE for x in range(b))) for b in range(256)}


# ---- encoding ----------------------------------------------------------------------------------------------------------------------------

def _ranges(characters: list[str]) -> str:
    """Sorted characters as the inside of a class of the standard library."""
    code = np.array(list(map(ord, characters)))
    cuts = np.flatnonzero(np.diff(code) > 1) + 1
    return "".join(re.escape(chr(run[0])) + "-" + re.escape(chr(run[-1])) for run in np.split(code, cuts))


# each alternative of the library's pattern as the standard library has it, the most frequent first: no text can start with two of them
# but a word mark and other signs, whose order stays
CUTS = [(r" ?\p{L}+", " [L]+|[L]+"), ("'s|'t|'re|'ve|'m|'ll|'d", "'(?:[stmd]|re|ve|ll)"), (r" ?\p{N}+", " ?[N]+"), (r" ?[^\s\p{L}\p{N}]+", " ?[^SLN]+"),
        (r"\s+(?!\S)|\s+", "[S]+(?![^S])|[S]+")]


def _splitter(pattern: str):
    """A function that cuts a text into the pieces of `pattern`, which the tokenizer cuts first.

    The pattern is written in classes (letters, numbers, space) that only the `regex` module has. The standard library is over three times as
    fast with the characters of these classes up to WIDE, as `regex` names them; texts with characters beyond are cut by `regex` itself.
    """
    import regex

    exact = regex.compile(pattern).findall
    if pattern != "|".join(CUTS[i][0] for i in (1, 0, 2, 3, 4)):
        return exact
    every = "".join(map(chr, range(WIDE)))
    classes = {name: _ranges(regex.findall(a, every)) for name, a in (("L", r"\p{L}"), ("N", r"\p{N}"), ("S", r"\s"))}
    fast = re.compile(re.sub(r"[LNS]", lambda m: classes[m[0]], "|".join(cut for _, cut in CUTS))).findall
    beyond = re.compile(f"[{chr(WIDE)}-{chr(sys.maxunicode)}]").search
    return lambda text: fast(text) if text.isascii() or not beyond(text) else exact(text)


def _raw(code) -> bytes:
    """The ids of an encoding of the library as little-endian unsigned 32-bit integers."""
    return np.array(code.ids, "<u4").tobytes()


def _inner(tokenizer):
    """The library's tokenizer without its cut into pieces: same model, texts written in the characters of BYTES and cut at line ends only.

    None unless the whole tokenizer is a byte-level one that neither changes a text nor adds to it.
    """
    from tokenizers import Tokenizer, pre_tokenizers

    cut = tokenizer.pre_tokenizer
    if tokenizer.normalizer is not None or not isinstance(cut, pre_tokenizers.ByteLevel) or cut.add_prefix_space:
        return None
    inner = Tokenizer(tokenizer.model)
    inner.pre_tokenizer = pre_tokenizers.Split(BYTES[10], "isolated")
    return inner


class Encoder:
    """Encodes texts with a byte-level BPE of the tokenizers library, each distinct piece of its own split once while it is remembered.

    The library cuts a text into pieces and merges inside each piece only, so a text's ids are those of its pieces in order. A text with a
    special token in it goes to the library as a whole. A worker remembers at most twice CACHE pieces of at most PIECE characters: when the
    young half is full it becomes the old one, and the pieces that are still used move on.
    """

    def __init__(self, path: str):
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            self.special = [t["content"] for t in json.load(file).get("added_tokens", [])]
        self.split = _splitter(public_tokenizers.PATTERN)
        self.inner = _inner(self.tokenizer)
        line = self.inner.encode(BYTES[10], add_special_tokens=False).ids if self.inner else []
        self.line_end = line[0] if len(line) == 1 else None
        self.known: dict[str, tuple[dict, dict]] = {"ids": ({}, {}), "len": ({}, {})}  # young, old

    @classmethod
    def load(cls, path: str) -> "Encoder":
        """One encoder per worker process and vocabulary, while the process runs tasks that encode."""
        loaded = memory("encoders")
        if path not in loaded:
            loaded[path] = cls(path)
        return loaded[path]

    def _batch(self, parts: list[str]) -> list[bytes]:
        """The ids of each piece. Pieces without line ends go to the library's model as lines of longer texts, which it cuts at the line ends only."""
        out: list[bytes] = []
        for at in range(0, len(parts), LINES):
            lines = parts[at:at + LINES]
            if self.line_end is not None:
                text = "\n".join(lines).encode().decode("latin-1").translate(BYTES)
                ids = np.array(self.inner.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
                ends = np.flatnonzero(ids == self.line_end)
                if len(ends) == len(lines) - 1:
                    raw = ids.tobytes()
                    out.extend(raw[a:b] for a, b in zip([0, *(4 * ends + 4).tolist()], [*(4 * ends).tolist(), len(raw)]))
                    continue
            out.extend(map(_raw, self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)))
        return out

    def _fresh(self, parts: list[str]) -> dict[str, bytes]:
        """The ids of each of these distinct pieces; those with a line end are encoded piece by piece."""
        together = [p for p in parts if p and "\n" not in p]
        found = dict(zip(together, self._batch(together)))
        found.update((p, _raw(self.tokenizer.encode(p, add_special_tokens=False))) for p in parts if p not in found)
        return found

    def _values(self, texts: list[str], kind: str, value, joined) -> list:
        """The value of every text from those of its pieces; pieces that are used again move from the old half of the memory to the young one."""
        young, old = self.known[kind]
        found, open_ = [], []
        for text in texts:  # one by one: the pieces of a text are short-lived, only unknown ones stay
            if any(s in text for s in self.special):
                found.append([value(_raw(self.tokenizer.encode(text, add_special_tokens=False)))])
                continue
            parts = self.split(text)
            values = list(map(young.get, parts))
            if None in values:
                at = [i for i, v in enumerate(values) if v is None]
                open_.append((values, at, [parts[i] for i in at]))
                found.append(values)
            else:
                found.append([joined(values)])
        needed = {p for _, _, parts in open_ for p in parts}
        fresh = {p: old[p] for p in needed if p in old}
        missing = [p for p in needed if p not in fresh]
        fresh.update((p, value(raw)) for p, raw in self._fresh(missing).items())
        for values, at, parts in open_:
            for i, p in zip(at, parts):
                values[i] = fresh[p]
        if len(young) + len(fresh) > CACHE:
            young, old = {}, young
            self.known[kind] = young, old
        young.update((p, v) for p, v in fresh.items() if len(p) <= PIECE)
        return list(map(joined, found))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        return self._values(texts, "ids", bytes, b"".join)

    def count(self, texts: list[str]) -> list[int]:
        """The number of ids of each text."""
        return self._values(texts, "len", lambda raw: len(raw) // 4, sum)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# ---- directly addressable codes ----------------------------------------------------------------------------------------------------------

def pack(ids: np.ndarray) -> list[dict[str, bytes]]:
    """Levels of the codes of `ids`: chunks, continuation bitmap, rank directory (uint32 counts)."""
    levels, left = [], ids.astype(np.uint64)
    while True:
        goes_on = left >> np.uint64(CHUNK) > 0
        bits = np.packbits(goes_on, bitorder="little")
        counts = np.concatenate([[0], np.cumsum(np.add.reduceat(goes_on, np.arange(0, len(goes_on), RANK)))]) if len(goes_on) else np.zeros(1)
        levels.append({"chunks": (left & np.uint64((1 << CHUNK) - 1)).astype(np.uint8).tobytes(), "more": bits.tobytes(), "ranks": counts.astype("<u4").tobytes()})
        if not goes_on.any():
            return levels
        left = left[goes_on] >> np.uint64(CHUNK)


class Codes:
    """Reads packed levels: any id by `get`, any range by `range`."""

    def __init__(self, levels: list[dict[str, bytes]]):
        self.chunks = [np.frombuffer(x["chunks"], np.uint8) for x in levels]
        self.bits = [np.frombuffer(x["more"], np.uint8) for x in levels]
        self.ranks = [np.frombuffer(x["ranks"], "<u4") for x in levels]

    def __len__(self) -> int:
        return len(self.chunks[0])

    def rank(self, level: int, at: int) -> int:
        """Set continuation bits before entry `at` of a level."""
        whole, start = at // RANK, at // RANK * RANK
        return int(self.ranks[level][whole]) + int(np.unpackbits(self.bits[level][start // 8:(at + 7) // 8], bitorder="little")[:at - start].sum())

    def get(self, at: int) -> int:
        if not 0 <= at < len(self):
            raise IndexError(at)
        value, shift = 0, 0
        for level in range(len(self.chunks)):
            value |= int(self.chunks[level][at]) << shift
            if not self.bits[level][at // 8] >> (at % 8) & 1:
                break
            at, shift = self.rank(level, at), shift + CHUNK
        return value

    def range(self, start: int, end: int) -> np.ndarray:
        """Ids start..end-1; only the entries of this range are touched."""
        values = np.zeros(max(0, end - start), np.uint32)
        where, shift = np.arange(len(values)), 0
        for level in range(len(self.chunks)):
            if end <= start:
                break
            values[where] |= self.chunks[level][start:end].astype(np.uint32) << np.uint32(shift)
            more = np.unpackbits(self.bits[level][start // 8:(end + 7) // 8], bitorder="little")[start % 8:start % 8 + end - start].astype(bool)
            where, shift = where[more], shift + CHUNK
            start, end = self.rank(level, start), self.rank(level, end)
        return values


SHARD = "shard long, nulls long, doc_ids binary, offsets binary, first_id long, n_tokens long, levels array<struct<chunks: binary, more: binary, ranks: binary>>"
SHARDS = 1 << 32  # shards that a partition may write


def encode_shards(docs: DataFrame, path: str, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per shard of the partition's documents (doc_id, text), in the order they come; every document ends with END.

    `shard` grows with partition and order, so it orders all shards of a table whose partitions are ranges; `nulls` counts the documents
    without id, which are the first of their shard.
    """

    def run(batches):
        encoder = Encoder.load(path)
        shard = TaskContext.get().partitionId() * SHARDS
        keys: list[int | None] = []
        parts: list[bytes] = []
        held = 0

        def row():
            ends = np.cumsum([0] + [len(p) // 4 for p in parts])
            nulls = sum(k is None for k in keys)
            return pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int64()), "nulls": pa.array([nulls], pa.int64()), "doc_ids": pa.array([np.array([0] * nulls + keys[nulls:], "<i8").tobytes()], pa.binary()),
                "offsets": pa.array([ends.astype("<i8").tobytes()], pa.binary()), "first_id": pa.array([keys[0]], pa.int64()), "n_tokens": pa.array([int(ends[-1])], pa.int64()),
                "levels": pa.array([pack(np.frombuffer(b"".join(parts), "<u4"))], pa.list_(pa.struct([("chunks", pa.binary()), ("more", pa.binary()), ("ranks", pa.binary())])))})

        stop = np.array([END], "<u4").tobytes()
        for batch in slices(batches, 1, TEXT_SLICE):
            for key, code in zip(batch.column(0).to_pylist(), encoder.encode([x or "" for x in batch.column(1).to_pylist()])):
                keys.append(key)
                parts.append(code + stop)
                held += len(code) // 4 + 1
                if held >= shard_tokens:
                    yield row()
                    shard += 1
                    keys, parts, held = [], [], 0
        if keys:
            yield row()

    return docs.mapInArrow(run, SHARD)


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None, shard_tokens: int = SHARD_TOKENS) -> None:
    """Write the ids of all documents to `path` in ascending doc_id order, as Parquet files of shards.

    Null texts are empty (only END is written); rows without an id come first, rows of one id are ordered by a digest of their text, and every
    row is written, so such rows may lie on several ranges and shards; an empty table writes no shard; other columns are ignored. Files
    hold ranges of ids, so their row groups are pruned by first_id; adaptive execution sizes the ranges by their bytes.
    """
    vocabulary = vocabulary or vocabulary_path()
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit("")))]
    encode_shards(named.repartitionByRange(*order).sortWithinPartitions(*order), vocabulary, shard_tokens).write.parquet(path)


def read_tokens(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in a table of shards; `start` counts the ids of all documents before it.

    Only the token counts of the shards take part in the global sum: inside each written range, then over the ranges, one row each.
    """
    sizes = shards.select("shard", "n_tokens").withColumn("spot", F.floor(F.col("shard") / SHARDS))
    ranges = sizes.groupBy("spot").agg(F.sum("n_tokens").alias("n"))
    before_range = ranges.select("spot", (F.sum("n").over(Window.orderBy("spot")) - F.col("n")).alias("before_range"))  # a row per written range
    inside = sizes.withColumn("inside", F.sum("n_tokens").over(Window.partitionBy("spot").orderBy("shard")) - F.col("n_tokens"))
    starts = inside.join(F.broadcast(before_range), "spot").select("shard", (F.col("inside") + F.col("before_range")).alias("shard_start"))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                codes = Codes(batch.column("levels")[i].as_py())
                ids = np.frombuffer(batch.column("doc_ids")[i].as_py(), "<i8")
                ends = np.frombuffer(batch.column("offsets")[i].as_py(), "<i8")
                values = codes.range(0, len(codes)).astype("<u4")
                crc = [zlib.crc32(values[a:b]) for a, b in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(ids, pa.int64(), mask=np.arange(len(ids)) < batch.column("nulls")[i].as_py()), "within": pa.array(ends[:-1], pa.int64()), "n_tokens": pa.array(np.diff(ends), pa.int64()),
                    "ids_crc32": pa.array(crc, pa.int64()), "shard": pa.array(np.full(len(ids), batch.column("shard")[i].as_py()), pa.int64())})

    read = shards.mapInArrow(run, "doc_id long, within long, n_tokens long, ids_crc32 long, shard long")
    return read.join(starts, "shard").select("doc_id", (F.col("shard_start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def write_and_read(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Write all documents to a folder beside the checkpoints, read the files back and digest them; the folder goes with the application."""
    spark = docs.sparkSession
    path = new_folder(spark, "tokens")
    write_tokens(docs, path, vocabulary)
    return read_tokens(spark.read.schema(SHARD).parquet(path))


__all__ = ["Codes", "Encoder", "encode_shards", "pack", "read_tokens", "stage", "write_and_read", "write_tokens"]
