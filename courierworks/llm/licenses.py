"""License scan: templates with optional and replaceable regions, compiled to automata over words.

A template is wording with two marks: `[[...]]` is an optional region, `<<n>>` a replaceable one of up to n words. It compiles to a
non-deterministic automaton over words; a text is accepted where all mandatory words follow each other exactly, with any choice in the
marked regions. Texts are lower-cased for A-Z only and cut into words of letters, digits and everything beyond ASCII.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courierworks.llm.common import slices

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_IS_WORD = np.ones(256, bool)
_IS_WORD[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False

BASE = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}

# Wording of public licenses and of the usual one-line notices.
TEMPLATES = {
    "apache-2.0": [
        "licensed under the apache license [[version]] 2 0 [[the license]]",
        "apache license version 2 0",
        "you may obtain a copy of the license at http www apache org licenses license 2 0",
    ],
    "mit-notice": [
        "[[released]] [[licensed]] [[distributed]] [[available]] under the [[terms of the]] mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
        "the software to deal in the software without restriction including without limitation the rights to use copy modify merge "
        "publish distribute sublicense and or sell copies of the software",
    ],
    "gpl-2.0": ["gnu general public license [[as published by the free software foundation either]] [[version 2]] [[v2]] 2 0 [[only]]",
                "general public license version 2 [[of the license]]"],
    "gpl-3.0": ["general public license [[as published by the free software foundation either]] version 3 [[of the license]]"],
    "gpl-notice": ["licensed under [[the terms of]] the gnu general public license", "redistribute it and or modify it under the terms of the gnu general public license"],
    "lgpl": ["gnu lesser general public license", "gnu library general public license"],
    "agpl": ["gnu affero general public license"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
            "bsd [[2 clause]] [[3 clause]] [[4 clause]] license"],
    "isc": ["permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted"],
    "mpl": ["mozilla public license [[version]] [[v]] <<1>> [[0]]"],
    "boost": ["boost software license version 1 0"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
    "cc-by": ["cc by [[4 0]] [[3 0]] [[2 0]]", "creative commons attribution [[4 0]] [[3 0]] [[international]]"],
    "cc-by-sa": ["cc by sa", "creative commons attribution sharealike", "creative commons attribution share alike"],
    "cc-by-nc": ["cc by nc", "creative commons attribution noncommercial", "creative commons attribution non commercial"],
    "cc-by-nd": ["cc by nd", "creative commons attribution noderivatives", "creative commons attribution no derivatives"],
    "cc0": ["cc0 1 0 universal", "creative commons zero"],
    "spdx-tag": ["spdx license identifier <<1>>"],
    "all-rights-reserved": ["copyright [[c]] <<6>> all rights reserved"],
}


class Automaton:
    """States 0..n over one template; `arcs[s]` has (word or None for any, next state), `jumps[s]` the states reached without a word."""

    def __init__(self, template: str):
        self.arcs: list[list[tuple[bytes | None, int]]] = [[]]
        self.jumps: list[list[int]] = [[]]
        self.literal: set[bytes] = set()
        for part in re.split(r"(\[\[.*?\]\]|<<\d+>>)", template):
            if part.startswith("<<"):
                first = len(self.arcs) - 1
                for _ in range(int(part[2:-2])):
                    self._word(None)
                for state in range(first, len(self.arcs) - 1):
                    self.jumps[state].append(len(self.arcs) - 1)
            elif part.startswith("[["):
                first = len(self.arcs) - 1
                for word in part[2:-2].split():
                    self._word(word.encode())
                self.jumps[first].append(len(self.arcs) - 1)
            else:
                for word in part.split():
                    self._word(word.encode())
                    self.literal.add(word.encode())
        self.end = len(self.arcs) - 1
        self.starts = {w for s in self._closed({0}) for w, _ in self.arcs[s]}

    def _word(self, word: bytes | None) -> None:
        self.arcs[-1].append((word, len(self.arcs)))
        self.arcs.append([])
        self.jumps.append([])

    def _closed(self, states: set[int]) -> set[int]:
        todo, out = list(states), set(states)
        while todo:
            for nxt in self.jumps[todo.pop()]:
                if nxt not in out:
                    out.add(nxt)
                    todo.append(nxt)
        return out

    def match(self, words: list[bytes], at: int) -> int:
        """Number of words of the longest acceptance that starts at word `at`; 0 if there is none."""
        states, length, pos = self._closed({0}), 0, at
        while states:
            if self.end in states:
                length = pos - at
            if pos == len(words):
                break
            word = words[pos]
            states = self._closed({nxt for s in states for w, nxt in self.arcs[s] if w is None or w == word})
            pos += 1
        return length


def compiled(templates: dict[str, list[str]] = TEMPLATES) -> list[tuple[str, Automaton]]:
    return [(label, Automaton(text)) for label, texts in templates.items() for text in texts]


def _words(raw: bytes) -> int:
    mask = _IS_WORD[np.frombuffer(raw, np.uint8)]
    return int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum()) if raw else 0


def scan_text(raw: bytes, automata: list[tuple[str, Automaton]], base: dict[str, str] = BASE) -> dict:
    """Places and labels of one text; `raw` is its UTF-8."""
    low = raw.lower()  # bytes change A-Z only
    phrases = [(label, phrase.encode().split()) for label, phrase in base.items()]
    hopeful = [(label, a) for label, a in automata if all(w in low for w in a.literal)]
    places: list[int] = []
    found: dict[str, None] = {}
    more: dict[str, None] = {}
    if not hopeful and not any(all(w in low for w in phrase) for _, phrase in phrases):
        return {"n_words": _words(low), "n_base": 0, "first": None, "last": None, "base": "", "labels": "", "score": 0.0}
    words = WORD.findall(low)
    covered = np.zeros(len(words), bool)
    where: dict[bytes, list[int]] = {}
    wanted = {phrase[0] for _, phrase in phrases} | {w for _, a in hopeful for w in a.starts if w is not None}
    for i, word in enumerate(words):
        if word in wanted:
            where.setdefault(word, []).append(i)
    for label, phrase in phrases:
        for i in where.get(phrase[0], ()):
            if words[i:i + len(phrase)] == phrase:
                places.append(i)
                found[label] = None
                covered[i:i + len(phrase)] = True
    for label, automaton in hopeful:
        for start in (range(len(words)) if None in automaton.starts else [i for w in automaton.starts for i in where.get(w, ())]):
            if length := automaton.match(words, start):
                more[label] = None
                covered[start:start + length] = True
    return {"n_words": len(words), "n_base": len(places), "first": min(places, default=None), "last": max(places, default=None),
            "base": ",".join(sorted(found)), "labels": ",".join(sorted({*found, *more})), "score": float(covered.mean()) if len(words) else 0.0}


def scan(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """Per document: words, places of the base phrases, labels, and the share of its words that stand in license wording (`score`).

    Columns: doc_id, n_words, n_base, first_word, last_word (null without a place), base_labels, labels, score. A null text is empty, an
    empty text has no words, labels or places and score 0; repeated rows give repeated results; a null id is kept; an empty table gives none.
    """
    automata = compiled(templates)

    def run(batches):
        for batch in slices(batches):
            rows = [scan_text((x or "").encode(), automata) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "n_words": pa.array([r["n_words"] for r in rows], pa.int64()), "n_base": pa.array([r["n_base"] for r in rows], pa.int64()),
                "first_word": pa.array([r["first"] for r in rows], pa.int64()), "last_word": pa.array([r["last"] for r in rows], pa.int64()),
                "base_labels": pa.array([r["base"] for r in rows], pa.string()), "labels": pa.array([r["labels"] for r in rows], pa.string()),
                "score": pa.array([r["score"] for r in rows], pa.float64())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
