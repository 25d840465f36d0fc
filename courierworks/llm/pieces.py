"""SentencePiece encoding and decoding by a batched Viterbi search in numpy.

A text is cut before every run of word marks; no piece crosses such a cut, so words are encoded apart, each distinct one once per worker.
Words of one length advance together: at every end position the hashes of all substrings up to the longest piece are probed in the sorted
keys of the pieces of that length, and the best sum of scores and its piece are kept for each word. Characters that no piece holds become
their UTF-8 bytes. Decoding joins the pieces' bytes and turns word marks back into spaces.

The result is the cut with the highest sum of the model's piece scores, as a unigram model defines it. A model file of another kind (byte-pair
merges) is read as a lexicon with scores: the cut then is still the best one by score, but not the one its merges would make.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courierworks.llm.common import slices

MODEL = "piece_bpe_32k.model"
MARK = "▁"
LITERAL = "\udc81"  # stands for a word mark that is part of the text; no text can hold this lone surrogate
CACHE = 1_500_000  # words a worker remembers
SPREAD = 48  # longer words of unequal length share a batch, filled up at their ends
BASE = np.uint64(0x9E3779B97F4A7C15)
UNKNOWN = -1


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def mixed(codes: np.ndarray) -> np.ndarray:
    """Spread code points over 64 bits."""
    x = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Pieces:
    """The pieces of a model: sorted keys per length, scores, bytes, and the words encoded so far."""

    _loaded: dict[str, "Pieces"] = {}

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        names = [model.id_to_piece(i) for i in range(size)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(size)]
        self.bytes = [b"" if model.is_control(i) else bytes([int(names[i][3:5], 16)]) if model.is_byte(i) else names[i].replace(MARK, " ").encode() for i in range(size)]
        self.byte_ids = {int(names[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.unknown_id = model.unk_id()
        usable = [i for i in range(size) if not special[i]]
        if any(MARK in names[i].lstrip(MARK) for i in usable):
            raise ValueError("a piece of this model holds a word mark after another character: words can't be encoded apart")
        self.unknown_score = min((model.get_score(i) for i in usable), default=0.0) - 10.0
        self.longest = max((len(names[i]) for i in usable), default=1)
        self.lengths: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for length in range(1, self.longest + 1):
            own = [i for i in usable if len(names[i]) == length]
            if own:
                codes = np.array([[ord(c) for c in names[i]] for i in own], np.uint64)
                keys = self._prefixes(codes)[:, -1]
                order = np.argsort(keys, kind="stable")
                if (np.diff(keys[order]) == 0).any():
                    raise ValueError("two pieces share a hash")
                self.lengths[length] = keys[order], np.array([model.get_score(i) for i in own])[order], np.array(own)[order]
        edge = "" if any("\n" in names[i] for i in usable) else "\n"
        self.cut = re.compile(f"{MARK}*[^{MARK}{edge}]+|{MARK}+" + ("|\n" if edge else "")).findall
        self.known: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str) -> "Pieces":
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    @staticmethod
    def _prefixes(codes: np.ndarray) -> np.ndarray:
        """Hash of every prefix of each row, the empty one first."""
        out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
        for j in range(codes.shape[1]):
            out[:, j + 1] = out[:, j] * BASE + mixed(codes[:, j])
        return out

    def viterbi(self, words: list[str]) -> list[bytes]:
        """Ids (little-endian int32) of each word; the longer piece wins a tie."""
        sizes = np.array([len(w) for w in words])
        width, rows = int(sizes.max()), len(words)
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        codes = np.zeros((rows, width), np.uint64)
        codes[np.arange(width)[None, :] < sizes[:, None]] = flat
        prefix = self._prefixes(codes)
        powers = np.array([pow(int(BASE), length, 1 << 64) for length in range(self.longest + 1)], np.uint64)
        best = np.full((rows, width + 1), -np.inf)
        best[:, 0] = 0.0
        piece = np.full((rows, width + 1), UNKNOWN)
        step = np.ones((rows, width + 1), np.int64)
        for end in range(1, width + 1):
            top = np.full(rows, -np.inf)
            for length in range(min(self.longest, end), 0, -1):
                if length not in self.lengths:
                    continue
                keys, scores, ids = self.lengths[length]
                probe = prefix[:, end] - prefix[:, end - length] * powers[length]
                at = np.searchsorted(keys, probe)
                at[at == len(keys)] = 0
                hit = np.flatnonzero(keys[at] == probe)
                if len(hit):
                    total = best[hit, end - length] + scores[at[hit]]
                    better = total > top[hit]
                    hit, total = hit[better], total[better]
                    top[hit] = total
                    piece[hit, end] = ids[at[hit]]
                    step[hit, end] = length
            bare = best[:, end - 1] + self.unknown_score
            none = bare > top
            piece[none, end] = UNKNOWN
            step[none, end] = 1
            best[:, end] = np.where(none, bare, top)
        taken, at, places = [], sizes.copy(), np.arange(rows)
        while (at > 0).any():
            taken.append(np.where(at > 0, piece[places, at], -2))
            at = np.maximum(at - np.where(at > 0, step[places, at], 0), 0)
        ids = np.stack(taken[::-1], 1) if taken else np.zeros((rows, 0), np.int64)
        out = []
        for word, row in zip(words, ids):
            row = row[row != -2]
            out.append((self._spelled(word, row) if (row == UNKNOWN).any() else row).astype("<i4").tobytes())
        return out

    def _spelled(self, word: str, row: np.ndarray) -> np.ndarray:
        """Ids with every unknown character replaced by its bytes."""
        out, at = [], 0
        for i in row.tolist():
            if i == UNKNOWN:
                raw = (MARK if word[at] == LITERAL else word[at]).encode()
                out += [self.byte_ids[b] for b in raw] if self.byte_ids else [self.unknown_id]
                at += 1
            else:
                out.append(i)
                at += len(self.bytes[i].decode())
        return np.array(out, np.int64)

    def learn(self, words: set[str]) -> None:
        if len(self.known) + len(words) > CACHE:
            self.known.clear()
        groups: dict[int, list[str]] = {}
        for word in words:
            size = len(word)
            groups.setdefault(size if size <= SPREAD else SPREAD * (1 << (size // SPREAD).bit_length()), []).append(word)
        for top, group in groups.items():
            group.sort(key=len)
            rows = max(1, 2_000_000 // top)
            for at in range(0, len(group), rows):
                part = group[at:at + rows]
                self.known.update(zip(part, self.viterbi(part)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian int32."""
        split = [self.cut(MARK + text.replace(MARK, LITERAL).replace(" ", MARK)) if text else [] for text in texts]
        fresh: set[str] = set()
        for words in split:
            fresh.update(words)
        missing = {w for w in fresh if w not in self.known}
        if missing:
            self.learn(fresh if len(self.known) + len(missing) > CACHE else missing)
        return [b"".join(map(self.known.__getitem__, words)) for words in split]

    def decode(self, ids: list[int]) -> str:
        """The text of a list of ids: bytes joined, the leading space that encoding adds taken off."""
        raw = b"".join(map(self.bytes.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_ids, ids (array<int>) and round_trip (whether decoding returns the text) of every document, with its sha256 after decoding.

    A null text counts as empty and has no ids; repeated rows give repeated results; a null id is kept; an empty table gives none; other
    columns are ignored.
    """
    path = model or model_path()

    def run(batches):
        pieces = Pieces.load(path)
        for batch in slices(batches, limit=4 << 20):
            texts = [x or "" for x in batch.column(1).to_pylist()]
            codes = pieces.encode(texts)
            sizes = np.array([len(c) // 4 for c in codes], np.int64)
            values = np.frombuffer(b"".join(codes), "<i4")
            decoded = [pieces.decode(np.frombuffer(c, "<i4").tolist()) for c in codes]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "n_ids": pa.array(sizes, pa.int64()),
                "ids": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, pa.int32())),
                "decoded_sha256": pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in decoded], pa.string()),
                "round_trip": pa.array([a == b for a, b in zip(texts, decoded)], pa.bool_())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_ids long, ids array<int>, decoded_sha256 string, round_trip boolean")


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, text from doc_id and ids; null ids give the empty text."""
    path = model or model_path()

    def run(batches):
        pieces = Pieces.load(path)
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "text": pa.array([pieces.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())})

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
