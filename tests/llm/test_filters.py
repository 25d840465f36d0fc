import random
import re
from itertools import permutations

from pyspark.sql import functions as F

from courierworks.llm import filters
from tests.llm.cases import DOCS, frame, odd_texts, words

LABELS = "doc_id long, quality int, toxic int"
COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def plain(rows, labels):
    """Every order applied to every document, one after another."""
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, t in labels if t == 1} - {None}
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    docs = {}
    for i, text, part in rows:
        text = text or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(ws) < 50, "B": 100 * len(set(ws)) < 65 * len(ws), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
                 "D": bool(re.search("[#$%&*|]", text)), "E": i is not None and i > first[text]}
        docs.setdefault(part or "", []).append(({f for f in fails if fails[f]}, i in good, i in toxic))
    out = {}
    for part, items in docs.items():
        shares = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = items
            for k, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                shares[f] += len(gone)
                left = [d for d in left if f not in d[0]]
                out[part, "".join(order), k] = [len(left), len(gone), sum(f in d[0] for d in items) - len(gone), sum(d[0] == {f} for d in items),
                                                sum(d[1] for d in gone), sum(d[2] for d in gone)]
        for key in out:
            if key[0] == part:
                out[key].append(shares[key[1][key[2] - 1]])
    return sorted((*key, *values) for key, values in out.items())


def result(docs, labels):
    df = filters.audit(docs, labels)
    assert df.columns == COLUMNS
    return sorted(tuple(r) for r in df.collect())


def mixed():
    rng = random.Random(5)
    texts = odd_texts() + [words(60, 20), words(60, 20) + " $", "A" * 9 + " " + words(80, 21), words(60, 20).replace("w", "W")] + [words(55, 30, size=30)] * 9
    rows = [(i, t, rng.choice(["s1", "s2", None])) for i, t in enumerate(texts)]
    rows += [(i + 500, t, rng.choice(["s1", "s2"])) for i, t in enumerate(texts)] + [(7, texts[7], "s1"), (7, texts[7], "s2"), (None, texts[7], "s1"), (None, "new", None), (None, None, "s2")]
    labels = [(i, rng.randrange(2), rng.choice([0, 1, None])) for i in range(0, 600, 3)] + [(3, 1, 1), (None, 1, 1), (9999, 1, 1)]
    return rows, labels


def table(spark, rows):
    df = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], DOCS)
    for name in ("part", "mask", "n", "prefix", "good", "toxic", "quality", "bit", "step", "at"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def test_audit_against_filtering_in_every_order(spark):
    rows, labels = mixed()
    marks = spark.createDataFrame(labels, LABELS).withColumn("n", F.lit(1)).withColumn("good", F.lit("x"))
    assert result(table(spark, rows).repartition(3), marks) == plain(rows, labels)


def test_crowded_prefixes_and_small_tries(spark, monkeypatch):
    for name, value in (("CROWDED", 200), ("TRIE_BYTES", 100), ("FIRST_PREFIX", 2), ("GROWTH", 2), ("SLICE", 500), ("SEEN", 2)):
        monkeypatch.setattr(filters, name, value)
    rows, labels = mixed()
    start = "the same long start of many texts "
    rows += [(2000 + i, start + words(20, i % 7), "s1") for i in range(40)] + [(3000 + i, start, "s2") for i in range(30)] + [(50_000 - i, start, "s2") for i in range(5)]
    assert result(table(spark, rows).repartition(4), spark.createDataFrame(labels, LABELS)) == plain(rows, labels)


def test_empty_tables(spark):
    rows, labels = mixed()
    assert result(frame(spark, []), spark.createDataFrame(labels, LABELS)) == []
    assert result(table(spark, rows[:9]), spark.createDataFrame([], LABELS)) == plain(rows[:9], [])


def test_trie_keeps_smallest_id_of_whole_texts():
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(12))) for _ in range(400)]
    trie, least = filters.RadixTrie(), {}
    for row, text in enumerate(texts):
        doc_id = rng.randrange(1000)
        trie.insert(text, doc_id, row)
        least.setdefault(text, [doc_id, []])
        least[text] = [min(least[text][0], doc_id), least[text][1] + [row]]
    assert sorted(trie.terminals()) == sorted(least.values())
