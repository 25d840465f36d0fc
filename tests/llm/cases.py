"""Small inputs shared by the tests of the training-data operators."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(n: int, seed: int = 0, size: int = 4000) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(size)}é" if rng.random() < 0.1 else f"w{rng.randrange(size)}" for _ in range(n))


def changed(text: str, every: int) -> str:
    parts = text.split(" ")
    parts[every // 2::every] = [f"x{i}" for i in range(len(parts[every // 2::every]))]
    return " ".join(parts)


def odd_texts() -> list[str | None]:
    """Null, empty, blank, short, repeated, near-equal, self-repeating and long texts."""
    base = words(200, 1)
    passage = words(60, 2)
    return [None, "", " \n\t ", "one", "one", "two words here", base, base, changed(base, 50), changed(base, 3), words(90, 3) + " " + passage + " " + words(40, 4),
            words(70, 5) + "\n" + passage + "\n" + words(10, 6), "abc" * 100, "a" * 450, words(30, 7) * 3, "漢字 " * 80, "é" * 120, "\0" * 130, "x" * 99, "x" * 100,
            "Licensed under the Apache License, Version 2.0.\n" + words(20, 8), words(30_000, 9), words(120, 10) + base[:400]]


def frame(spark, texts, ids=None, clash: bool = True):
    """A documents table; with `clash` it has extra columns named like the operators' own."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids, texts)]
    df = spark.createDataFrame(rows, DOCS)
    if clash:
        for name in ("id", "h", "n", "marks", "owner", "score", "key", "class_id", "start", "kind", "body", "part", "n_tokens", "bucket", "stats", "root"):
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit("clash"))
    return df
