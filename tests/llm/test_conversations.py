import hashlib
import math
import random
import zlib

from pyspark.sql import functions as F

from courierworks.llm import conversations
from courierworks.llm.common import lookup, stage

ROWS = "conv_id long, turn long, role string, text string"


def plain(rows):
    """The nodes by dictionaries of whole prefixes."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            token = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own.setdefault(c, []).append(((turn is not None, turn or 0, token), (role, text)))
    own = {c: [turn for _, turn in sorted(turns)] for c, turns in own.items()}
    full = {}
    for c, turns in own.items():
        head = zlib.crc32(str(c).encode()) % 6
        full[c] = own.get(c - int(math.fmod(c, 100)), [])[:head] + turns[head:]
    nodes = {}
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for key in nodes:
        if key:
            kids.setdefault(key[:-1], []).append(key)
    out = set()
    for key, members in nodes.items():
        below = [k for k in nodes if k[:len(key)] == key]
        ends = sorted(c for c in members if len(full[c]) == len(key))
        out.add((min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members), len(kids.get(key, [])), sum(k not in kids for k in below),
                 sum((len(nodes[k]) - 1) * len(k[-1][1]) for k in below if k), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return out


def mixed(seed=3):
    rng = random.Random(seed)
    rows = []
    for c in [*range(40), 100, 101, 205, 399, -3, -105, 7_000_000_001]:
        for turn in range(37 if c == 101 else rng.randrange(9)):
            rows.append((c, rng.choice([turn, turn, turn, turn, None]), rng.choice(["user", "assistant", None]), rng.choice(["a", "bé", "", None, "漢字 text"])))
    return rows + [rows[3]] * 3 + [(None, 0, "user", "lost"), (None, None, None, None), (300, 0, "user", "x" * 100_000)]


def nodes_of(df):
    return [tuple(r) for r in df.collect()]


def test_trie_against_dictionaries_of_prefixes(spark):
    rows = mixed()
    df = spark.createDataFrame(rows, ROWS)
    for name in ("conv", "d", "i", "low", "n", "token", "size", "name", "depth", "part"):
        df = df.withColumn(name, F.lit("clash"))
    got = nodes_of(conversations.prefix_trie(df))
    assert len(got) == len(set(got)) and set(got) == plain(rows)


def test_no_conversations_and_one_without_turns(spark):
    assert nodes_of(conversations.prefix_trie(spark.createDataFrame([], ROWS))) == []
    lone = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1)
    rows = [(lone, 0, "user", "only")]
    got = nodes_of(conversations.prefix_trie(spark.createDataFrame(rows, ROWS)))
    assert set(got) == plain(rows) and [g[1] for g in got] == [0]


def test_copies_fill_several_pieces_and_ranges(spark, monkeypatch):
    monkeypatch.setattr(conversations, "PIECE_IDS", 7)
    rows = [(c, t, "user", f"t{t}") for c in range(1000, 1200) for t in range(6)]
    got = nodes_of(conversations.prefix_trie(spark.createDataFrame(rows, ROWS).repartition(5)))
    assert set(got) == plain(rows)


def test_a_long_conversation_over_many_ranges(spark):
    rows = [(700, t, "user", f"t{t % 11}") for t in range(3000)] + [(701, 0, "user", "t0")]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns = stage(conversations.numbered(stage(conversations.turn_tokens(spark.createDataFrame(rows, ROWS)))))
        assert [r.i for r in turns.where("conv = 700").orderBy("i").collect()] == list(range(3000))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_lookup_splits_hot_keys(spark):
    rows = stage(spark.range(1000).select(F.when(F.col("id") < 700, 1).otherwise(F.col("id") % 50).alias("k"), "id"))
    dim = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 3).alias("v"))
    want = sorted(map(tuple, rows.join(dim, ["k"]).collect()))
    assert sorted(map(tuple, lookup(rows, dim, ["k"], share=10, least=5).collect())) == want
    assert sorted(map(tuple, lookup(rows, dim, ["k"]).collect())) == want
