"""Licence scans: base phrases, and notices found by a positional index of their rare words."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealane.llm.common import documents
from sealane.llm.words import Chunk, Words, chunks, lowered, words

# The base phrases with their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Short public notices, their labels and the phrases that each must have.
NOTICES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction", ["permission is hereby granted free of charge"]),
    ("apache-2", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license", ["apache license"]),
    ("apache-2", "licensed under the apache license version 2 0", ["apache license", "2 0"]),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ["general public license", "version 3"]),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2", ["general public license", "version 2"]),
    ("lgpl", "licensed under the terms of the gnu lesser general public license", ["lesser general public license"]),
    ("agpl-3", "licensed under the terms of the gnu affero general public license version 3", ["affero general public license"]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee is hereby granted"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["public domain"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["by nc"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"]),
    ("all-rights-reserved", "all rights reserved", ["all rights reserved"]),
]

#: Words of highest inverse document frequency that a notice is looked up by.
RARE = 8
#: Places may be off by so many words, through edits in between.
SLACK = 3
#: Least share of a notice's rare weight that must stand at the right relative places.
LEAST_SHARE = 0.6

_BETWEEN = np.zeros(256, bool)
_BETWEEN[:128] = True
_BETWEEN[[*range(0x30, 0x3A), *range(0x61, 0x7B)]] = False


def license_words(chunk: Chunk) -> Words:
    return words(chunk, lowered(chunk.data), between=_BETWEEN)


def _vocabulary() -> list[str]:
    texts = [*PHRASES, *(text for _, text, _ in NOTICES), *(p for _, _, must in NOTICES for p in must)]
    return sorted({w for text in texts for w in text.split()})


class Vocabulary:
    """Numbers of the licence words, found by hash in a chunk."""

    def __init__(self) -> None:
        self.words = _vocabulary()
        joined = pa.array(self.words)
        hashes = np.concatenate([license_words(c).hash for c in chunks(joined)])
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], order.astype(np.int32)
        self.number = {w: k for k, w in enumerate(self.words)}

    def find(self, w: Words) -> np.ndarray:
        """The number of each word of a chunk, -1 for others."""
        if not len(w.hash):
            return np.empty(0, np.int32)
        at = np.minimum(np.searchsorted(self.hashes, w.hash), len(self.hashes) - 1)
        return np.where(self.hashes[at] == w.hash, self.numbers[at], -1).astype(np.int32)

    def ids(self, phrase: str) -> list[int]:
        return [self.number[w] for w in phrase.split()]


def places(found: np.ndarray, doc: np.ndarray, phrase: list[int]) -> np.ndarray:
    """Where the words of a phrase stand one after the other in one text."""
    n = len(found) - len(phrase) + 1
    if n <= 0:
        return np.empty(0, np.int64)
    hit = doc[:n] == doc[len(phrase) - 1 :]
    for k, word in enumerate(phrase):
        hit &= found[k : k + n] == word
    return np.flatnonzero(hit)


def document_frequencies(docs: DataFrame) -> tuple[dict[str, int], int]:
    """In how many texts each licence word is, and the number of texts; over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary()
        total, n_docs = np.zeros(len(vocabulary.words), np.int64), 0
        for batch in batches:
            for chunk in chunks(batch.column(0)):
                w = license_words(chunk)
                found = vocabulary.find(w)
                some = found >= 0
                pairs = np.unique(w.doc[some].astype(np.int64) * len(total) + found[some])
                total += np.bincount(pairs % len(total), minlength=len(total))
                n_docs += len(chunk.bounds) - 1
        yield pa.RecordBatch.from_arrays([pa.array([*vocabulary.words, None]), pa.array([*total.tolist(), n_docs])], names=["word", "n"])

    rows = docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {r[0]: r[1] for r in rows}
    return {k: v for k, v in counts.items() if k is not None}, counts.get(None, 0)


class Index(NamedTuple):
    postings: dict[int, list[tuple[int, int, float]]]  # licence word -> (notice, place in it, weight)
    weight: list[float]  # of a notice's rare words
    rare: np.ndarray  # by word number


def build_index(frequencies: dict[str, int], n_docs: int, vocabulary: Vocabulary) -> Index:
    """Each notice by its RARE words of highest inverse document frequency, with their places."""
    idf = lambda w: math.log((n_docs + 1) / (frequencies.get(w, 0) + 0.5))
    postings, weights, rare = defaultdict(list), [], np.zeros(len(vocabulary.words), bool)
    for notice, (_, text, _) in enumerate(NOTICES):
        order = sorted({w: k for k, w in reversed(list(enumerate(text.split())))}.items(), key=lambda x: (-idf(x[0]), x[1]))[:RARE]
        for word, place in order:
            number = vocabulary.number[word]
            postings[number].append((notice, place, max(idf(word), 1e-6)))
            rare[number] = True
        weights.append(sum(max(idf(w), 1e-6) for w, _ in order))
    return Index(dict(postings), weights, rare)


def notices_in(found: np.ndarray, index: Index, vocabulary: Vocabulary) -> dict[str, float]:
    """Labels of the notices in one text and the share of their rare weight that is in place.

    Each rare word votes for where a notice would begin; votes within SLACK words of each other
    count together, each of the notice's words once.  A notice is found if its best beginning has
    LEAST_SHARE of the weight and all its mandatory phrases stand in the text.
    """
    votes: dict[int, list[tuple[int, int, float]]] = defaultdict(list)
    for at in np.flatnonzero((found >= 0) & index.rare[np.maximum(found, 0)]).tolist():
        for notice, place, weight in index.postings[int(found[at])]:
            votes[notice].append((at - place, place, weight))
    out: dict[str, float] = {}
    doc = np.zeros(len(found), np.int64)
    for notice, cast in votes.items():
        cast.sort()
        best, low, inside, total = 0.0, 0, defaultdict(int), 0.0
        for high, (start, place, weight) in enumerate(cast):
            inside[place] += 1
            total += weight * (inside[place] == 1)
            while cast[low][0] < start - SLACK:
                _, gone, less = cast[low]
                inside[gone] -= 1
                total -= less * (inside[gone] == 0)
                low += 1
            best = max(best, total)
        label, _, must = NOTICES[notice]
        share = best / index.weight[notice]
        if share >= LEAST_SHARE and all(len(places(found, doc, vocabulary.ids(p))) for p in must):
            out[label] = max(out.get(label, 0.0), min(1.0, share))
    return out


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def license_scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of each row.

    ``score`` is the largest share of a notice that is in place, 1 where a base phrase stands, 0
    without any label.  A null or empty text has no words and no labels (empty strings).  Frequencies
    come from all texts in a first pass and are bounded by the licence vocabulary; the second pass
    needs no shuffle.  Repeated rows get a row each; only doc_id and text are read; an empty table
    gives an empty result.
    """
    frequencies, n_docs = document_frequencies(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary()
        index = build_index(frequencies, n_docs, vocabulary)
        phrases = [(vocabulary.ids(p), label) for p, label in PHRASES.items()]
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                w, n = license_words(chunk), len(chunk.bounds) - 1
                found = vocabulary.find(w)
                base: list[list[tuple[int, str]]] = [[] for _ in range(n)]
                for phrase, label in phrases:
                    for at in places(found, w.doc, phrase).tolist():
                        base[w.doc[at]].append((at - int(w.of[w.doc[at]]), label))
                rare = np.bincount(w.doc[(found >= 0) & index.rare[np.maximum(found, 0)]], minlength=n)
                rows = []
                for k in range(n):
                    more = notices_in(found[w.of[k] : w.of[k + 1]], index, vocabulary) if rare[k] else {}
                    own = {label for _, label in base[k]}
                    starts = [at for at, _ in base[k]]
                    rows.append((len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), ",".join(sorted(own | more.keys())), 1.0 if own else max(more.values(), default=0.0)))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                names = [part.split()[0] for part in SCHEMA.split(", ")]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, n), pa.array(np.diff(w.of)), *columns], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))
