"""Quality rules: base counts of a text and how much of it lies in repeated n-grams and lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sealane.llm.common import documents
from sealane.llm.words import U, Chunk, chunks, mix, ngrams, prefix, span_hash, words

#: Largest share of a text's word characters inside repeats of an n-gram after its first place: one
#: and a half times what Rae et al. (2021) used on web pages, as short texts that repeat one line
#: of boilerplate are labelled good here.
MOST_REPEATED = {5: 0.225, 6: 0.21, 7: 0.195, 8: 0.18, 9: 0.165, 10: 0.15}
#: Largest share inside all places of the one most frequent n-gram, if found at least TOP_LEAST times.
MOST_TOP = {2: 0.20, 3: 0.18, 4: 0.16}
TOP_LEAST = 3
#: Largest share of the characters in lines that lies in repeats of an earlier line.
MOST_LINE_CHARS = 0.20

LEAST_WORDS, MOST_REPEAT_PERCENT = 50, 50
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " base_failed boolean, kept boolean, repeated_share double, top_share double, line_share double, line_char_share double"
)


def _again(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(found elsewhere too, found before) of each key."""
    both, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    order = np.argsort(key)
    same = np.flatnonzero(key[order][1:] == key[order][:-1])
    if len(same):
        group = np.concatenate([[0], np.cumsum(np.diff(same) > 1)])  # neighbours in a run of equal keys
        at = np.unique(np.concatenate([same, same + 1]))
        group = group[np.searchsorted(same, at, "right") - 1]
        place = order[at]
        both[place] = later[place] = True
        later[np.minimum.reduceat(place, np.flatnonzero(np.diff(group, prepend=-1)))] = False
    return both, later


def _covered(at: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of ``total`` words lie in one of the n-word runs that begin at ``at``."""
    steps = np.zeros(total + 1, np.int64)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + n, -1)
    return np.cumsum(steps[:-1]) > 0


def measure(chunk: Chunk) -> dict[str, np.ndarray]:
    """The measures of each text of a chunk; hashes of n-grams and lines are 64 bits."""
    data, n_docs = chunk.data, len(chunk.bounds) - 1
    sums = prefix(data)
    w = words(chunk, sums=sums)
    total = len(w.start)
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    chars = points[w.end] - points[w.start]
    per_doc = lambda doc, weight=None: np.bincount(doc, weight, n_docs)
    word_chars = per_doc(w.doc, chars)
    symbols = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_SYMBOL[data], out=symbols[1:])

    salt = mix(np.arange(n_docs).astype(U) + U(77))
    repeated = np.zeros(n_docs)
    for n, most in MOST_REPEATED.items():
        at, key = ngrams(w, n)
        _, later = _again(key ^ salt[w.doc[at]])
        inside = _covered(at[later], n, total)
        repeated = np.maximum(repeated, per_doc(w.doc[inside], chars[inside]) / np.maximum(word_chars, 1) / most)
    at, key = ngrams(w, 3)
    both, _ = _again(key ^ salt[w.doc[at]])
    n_repeat = per_doc(w.doc[_covered(at[both], 3, total)])
    char_sums = np.concatenate([[0], np.cumsum(chars)])
    top = np.zeros(n_docs)
    for n, most in MOST_TOP.items():
        at, key = ngrams(w, n)
        key = key ^ salt[w.doc[at]]
        order = np.argsort(key)
        first = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]])) if len(key) else np.empty(0, np.int64)
        count, place = np.diff(np.append(first, len(key))), at[order][first]
        often = count >= TOP_LEAST
        best = np.zeros(n_docs)
        np.maximum.at(best, w.doc[place[often]], (count * (char_sums[place + n] - char_sums[place]))[often])
        top = np.maximum(top, best / np.maximum(word_chars, 1) / most)

    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([chunk.bounds[:-1][np.diff(chunk.bounds) > 0], breaks + 1]))
    starts = starts[starts < len(data)]
    ends = np.minimum(np.append(starts[1:], len(data)), len(data))
    ends = np.where((ends > starts) & (data[np.maximum(ends, 1) - 1] == 10), ends - 1, ends) if len(data) else ends
    line_doc = np.searchsorted(chunk.bounds, starts, "right") - 1
    has_word = np.searchsorted(w.start, ends) > np.searchsorted(w.start, starts)
    starts, ends, line_doc = starts[has_word], ends[has_word], line_doc[has_word]
    _, later = _again(span_hash(sums, starts, ends) ^ salt[line_doc])
    length = points[ends] - points[starts]
    dup_lines, lines = per_doc(line_doc[later]), per_doc(line_doc)
    line_share = dup_lines / np.maximum(lines, 1)
    line_chars = per_doc(line_doc[later], length[later]) / np.maximum(per_doc(line_doc, length), 1)

    n_words = np.diff(w.of)
    failed = (n_words < LEAST_WORDS) | (100 * n_repeat > MOST_REPEAT_PERCENT * n_words)
    good = (repeated <= 1) & (top <= 1) & (line_chars <= MOST_LINE_CHARS)
    whole = lambda x: x.astype(np.int64)
    return {
        "n_words": whole(n_words), "word_chars": whole(word_chars), "n_symbols": symbols[chunk.bounds[1:]] - symbols[chunk.bounds[:-1]],
        "n_dup_lines": whole(dup_lines), "n_repeat_words": whole(n_repeat), "base_failed": failed, "kept": ~failed & good,
        "repeated_share": repeated, "top_share": top, "line_share": line_share, "line_char_share": line_chars,
    }


def quality(docs: DataFrame) -> DataFrame:
    """One row of counts and verdicts for each row of ``docs``, in one pass and without a shuffle.

    A null or empty text has no words, so it fails the base rules.  ``repeated_share`` and
    ``top_share`` are the largest shares over their limits (above 1: rejected).  Repeated rows get
    a row each; only doc_id and text are read; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                found = measure(chunk)
                ids = batch.column(0).slice(chunk.first, len(chunk.bounds) - 1)
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, found.values())], names=["doc_id", *found])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir))
