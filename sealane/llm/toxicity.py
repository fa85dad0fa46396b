"""Toxicity scores of texts that are first restored by a noisy-channel decoder."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealane.llm.common import documents, durable, labels, tidy
from sealane.llm.words import Chunk, Words, chunks, words

#: The model is fitted on so many labelled texts at most, each read whole.
MOST_TOXIC, MOST_CLEAN = 3_000, 6_000
#: Evidence of a word counts from so many toxic texts on; weight of the prior in texts.
LEAST_SUPPORT, PRIOR = 3, 2.0
MOST_REMEMBERED = 100_000
#: A text with this score is predicted to be toxic.
LEAST_TOXIC = 0.5

# ---- Character language model: trigrams over a-z, one class for all other letters, and a break.
BREAK, OTHER, N_SYMBOLS = 0, 27, 28
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[97:123] = _SYMBOL[65:91] = np.arange(1, 27)
_SYMBOL[0xC0:] = OTHER


def symbol(char: str) -> int:
    return ord(char) - 96 if "a" <= char <= "z" else OTHER if char > "\x7f" and char.isalpha() else BREAK


def trigram_counts(chunk: Chunk) -> np.ndarray:
    """Counts of the trigrams of a chunk's texts, which a break separates."""
    at = np.flatnonzero((chunk.data & 0xC0) != 0x80)
    ids = _SYMBOL[chunk.data[at]]
    edges = np.searchsorted(at, chunk.bounds)
    ids = np.insert(ids, np.repeat(edges, 2), BREAK)
    return np.bincount((ids[:-2] * N_SYMBOLS + ids[1:-1]) * N_SYMBOLS + ids[2:], minlength=N_SYMBOLS**3)


def language_model(docs: DataFrame) -> np.ndarray:
    """Costs (negative logs) of each symbol after two others, from counts over all texts.

    Counts are summed within tasks and then over tasks; what comes to the driver is one row for
    each trigram of the fixed alphabet at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(N_SYMBOLS**3, np.int64)
        for batch in batches:
            for chunk in chunks(batch.column(0)):
                total += trigram_counts(chunk)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["gram", "n"])

    rows = docs.select("text").mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(N_SYMBOLS**3)
    for gram, n in rows:
        counts[gram] = n
    return costs(counts)


def costs(counts: np.ndarray) -> np.ndarray:
    """Trigram probabilities, smoothed by bigrams and these by single symbols (Witten-Bell)."""
    tri = counts.reshape(N_SYMBOLS, N_SYMBOLS, N_SYMBOLS)
    bi, uni = tri.sum(0), tri.sum((0, 1))
    p = (uni + 1) / (uni.sum() + N_SYMBOLS)
    for table in (bi, tri):
        kinds, total = (table > 0).sum(-1, keepdims=True), table.sum(-1, keepdims=True)
        lower = p if table is bi else p[None]
        p = np.where(total > 0, (table + kinds * lower) / np.maximum(total + kinds, 1), lower)
    return -np.log(np.maximum(p, 1e-12))


# ---- The channel: what a written character may stand for, and at what cost.
# Letters that look like a digit or sign.
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "*": "aeiou", "#": "h"}
FILLERS = " ._-*~'`^,/|+="
COST_LOOK, COST_FILLER, COST_BREAK, COST_COLLAPSE, COST_STAY = 1.0, 0.3, 3.0, 0.3, 6.0


def restore(span: str, lm: np.ndarray) -> str:
    """The most likely text behind a written span, by Viterbi over its character lattice.

    States are the last two symbols.  A letter stands for itself; a run of three or more equal
    letters for one or two of them; digits and signs for letters that look alike; fillers for
    nothing or for a word break; anything may stay a break at a cost.
    """
    span = span.lower()
    # A path is a linked list from its end: branches that lose are freed, and long spans stay linear.
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(BREAK, BREAK): (0.0, None)}
    i, n = 0, len(span)
    while i < n:
        char, j = span[i], i + 1
        while j < n and span[j] == char:
            j += 1
        if symbol(char):
            arcs = [(char * (j - i), 0.0)] if j - i < 3 else [(char, COST_COLLAPSE), (char * 2, COST_COLLAPSE)]
        else:
            j = i + 1
            arcs = [(like, COST_LOOK) for like in LOOKS.get(char, "")]
            arcs += [("", COST_FILLER)] * (char in FILLERS)
            arcs.append((" ", COST_BREAK if char in FILLERS else COST_STAY))
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (cost, path) in states.items():
            for out, extra in arcs:
                x, y, total = a, b, cost + extra
                for c in out:
                    s = symbol(c)
                    total += lm[x, y, s]
                    x, y = y, s
                if (x, y) not in after or total < after[x, y][0]:
                    after[x, y] = (total, (path, out) if out else path)
        states, i = after, j
    least = min(cost + lm[a, b, BREAK] for (a, b), (cost, _) in states.items())
    return min(_written(path) for (a, b), (cost, path) in states.items() if cost + lm[a, b, BREAK] == least)


def _written(path: tuple | None) -> str:
    parts = []
    while path:
        path, out = path
        parts.append(out)
    return "".join(reversed(parts))


_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[65:91] = True
_LETTER[0x80:] = True
_DISGUISE = np.zeros(256, bool)
_DISGUISE[[ord(c) for c in {*LOOKS, *FILLERS} if ord(c) < 128 and c not in " ,'"]] = True
#: Signs and digits that look like letters; the first byte of the one outside ASCII is found with the next two.
_LOOK = np.zeros(256, bool)
_LOOK[[ord(c) for c in LOOKS if ord(c) < 128]] = True
_EURO = np.frombuffer("€".encode(), np.uint8)
#: Restored spans of up to so many characters are remembered.
LEAST_SPACED, LEAST_LOOKS, LONGEST_REMEMBERED = 4, 3, 200


def disguised(chunk: Chunk, w: Words) -> np.ndarray:
    """Words to decode: 1 for one with a sign or digit before a letter, with a sign that looks like
    a letter after a letter, with LEAST_LOOKS or more such signs and no letter at all, or with a
    letter three times in a row; 2 for one in a run of LEAST_SPACED or more one-letter words."""
    data, n = chunk.data, len(chunk.data)
    flags = np.zeros(len(w.start), np.int8)
    if n < 3 or not len(w.start):
        return flags
    low = data | 0x20
    letter, sign, look = _LETTER[data], _DISGUISE[data], _LOOK[data]
    at = np.flatnonzero((data[:-2] == _EURO[0]) & (data[1:-1] == _EURO[1]) & (data[2:] == _EURO[2]))
    euro = (at[:, None] + np.arange(3)).ravel()
    letter[euro], sign[euro], look[euro] = False, True, True
    hit = np.zeros(n, bool)
    hit[:-2] = letter[:-2] & (low[:-2] == low[1:-1]) & (low[1:-1] == low[2:]) & (data[:-2] < 0x80)
    hit[:-1] |= sign[:-1] & letter[1:]
    # Before a letter any sign counts, after one (end of a sentence) only what looks like a letter.
    after = np.zeros(n, bool)
    after[1:] = look[1:] & letter[:-1]
    for found, first, last in ((hit, 0, 1), (after, 1, 0)):
        at = np.flatnonzero(found)
        word = np.searchsorted(w.start, at, "right") - 1
        ok = (word >= 0) & (at >= w.start[np.maximum(word, 0)] + first) & (at < w.end[np.maximum(word, 0)] - last)
        flags[word[ok]] = 1
    sums = np.zeros((2, n + 1), np.int64)
    whole = look.copy()
    whole[euro.reshape(-1, 3)[:, 1:].ravel()] = False
    np.cumsum(whole, out=sums[0, 1:])
    np.cumsum(letter, out=sums[1, 1:])
    looks, letters = sums[:, w.end] - sums[:, w.start]
    flags[(looks >= LEAST_LOOKS) & (letters == 0)] = 1
    points = np.zeros(n + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    long = points[w.end] - points[w.start]
    one = ((long == 1) | (long == 2) & letter[w.start] & ~letter[w.end - 1]) & (letter[w.start] | sign[w.start])
    at = np.flatnonzero(one)
    if len(at):
        run = np.cumsum(np.concatenate([[True], (np.diff(at) > 1) | (np.diff(w.doc[at]) > 0)])) - 1
        flags[at[np.bincount(run)[run] >= LEAST_SPACED]] = 2
    return flags


EDGES = " \t\r\n.,;:!?\"'()[]{}<>«»¿¡#*$%&|_-"


def features(word: str) -> tuple[int, int, int]:
    """Hashes of a word and of its beginnings."""
    return tuple(xxhash.xxh64_intdigest(f"{kind}{part}") >> 1 for kind, part in (("w", word), ("4", word[:4]), ("5", word[:5])))


class Reader:
    """Distinct words of the restored texts of a batch."""

    def __init__(self, lm: np.ndarray) -> None:
        self.lm, self.restored = lm, {}

    def _restore(self, span: str) -> list[str]:
        if len(span) > LONGEST_REMEMBERED:
            return restore(span, self.lm).split()
        if span not in self.restored:
            if len(self.restored) > MOST_REMEMBERED:
                self.restored.clear()
            self.restored[span] = restore(span, self.lm).split()
        return self.restored[span]

    def texts(self, column: pa.Array) -> Iterator[set[str]]:
        for chunk in chunks(column):
            w = words(chunk)
            flags = disguised(chunk, w)
            raw = chunk.data.tobytes()
            for k in range(len(chunk.bounds) - 1):
                found = set(raw[chunk.bounds[k] : chunk.bounds[k + 1]].decode("utf-8", "replace").lower().split())
                a, b = w.of[k], w.of[k + 1]
                at = a + np.flatnonzero(flags[a:b])
                if len(at):
                    group = np.flatnonzero(np.concatenate([[True], (np.diff(at) > 1) | (flags[at[1:]] != 2) | (flags[at[:-1]] != 2)]))
                    for i, j in zip(group, [*group[1:], len(at)], strict=True):
                        span = raw[w.start[at[i]] : w.end[at[j - 1]]].decode("utf-8", "replace").lower()
                        if j - i > 1:
                            span = " ".join(span.split())
                        found.update(self._restore(span))
                yield found


class Model(NamedTuple):
    evidence: dict[int, float]  # of a word feature, above 0
    weights: np.ndarray  # of what summary() gives


class Evidence(dict):
    """Evidence of a word as written, looked up once for each distinct word."""

    def __init__(self, table: dict[int, float]) -> None:
        self.table = table

    def __missing__(self, word: str) -> float:
        if len(self) > MOST_REMEMBERED:
            self.clear()
        bare = word.strip(EDGES)
        self[word] = found = max((self.table.get(f, 0.0) for f in features(bare)), default=0.0) if len(bare) >= 3 else 0.0
        return found


#: The largest evidence also counts by how far it is above these: one certain word can decide.
KNOTS = (2.5, 3.5, 4.5)


def summary(evidence: list[float]) -> list[float]:
    top = sorted(evidence, reverse=True)
    first, second, third = (top + [0.0, 0.0, 0.0])[:3]
    return [1.0, first, second, third, math.log1p(len(top)), *(max(0.0, first - k) for k in KNOTS)]


def score(model: Model, evidence: list[float]) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(np.dot(model.weights, summary(evidence)))))))


def evidence_of(keys: np.ndarray, toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> dict[int, float]:
    """Smoothed log odds of features by how many toxic and clean texts have them, where positive and with support."""
    ratio = n_toxic / max(n_clean, 1)
    value = np.log((toxic + PRIOR * ratio) / (clean + PRIOR) / max(ratio, 1e-9))
    keep = (toxic >= LEAST_SUPPORT) & (value > 0.5)
    return dict(zip(keys[keep].tolist(), value[keep].tolist(), strict=True))


def _by_word(keys: np.ndarray, table: dict[int, float]) -> list[float]:
    """The evidence of those words, three features each, that have any."""
    found = np.asarray([table.get(f, 0.0) for f in keys.tolist()]).reshape(-1, 3).max(1)
    return found[found > 0].tolist()


def plain_weights(n_toxic: int, n: int) -> np.ndarray:
    """Weights by which every score is the share of toxic texts."""
    rate, plain = (n_toxic + 0.5) / (n + 1) if n else 0.0, np.zeros(len(summary([])))
    plain[0] = math.log(max(rate, 1e-6) / max(1 - rate, 1e-6))
    return plain


def regression(x: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression of the label on what summary() gives."""
    y, w = toxic.astype(float), plain_weights(int(toxic.sum()), len(toxic))
    penalty = np.diag([1e-3] + [0.05] * (len(w) - 1))
    for _ in range(50):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (p - y) + penalty @ w)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def held_out(column="doc_id"):
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def sample(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """(doc_id, toxic, half, text) of at most MOST_TOXIC and MOST_CLEAN labelled rows that are not held out, those with
    the smallest hashes; of equal texts one, toxic if any of them is."""
    known = marks.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id", F.lit(5))
    some = known.where("toxic = 1").orderBy(order).limit(MOST_TOXIC).unionByName(known.where("toxic = 0").orderBy(order).limit(MOST_CLEAN))
    texts = docs.select("doc_id", "text").where("text IS NOT NULL").withColumn("print", F.xxhash64("text"))
    once = texts.join(F.broadcast(some), "doc_id").groupBy("print").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))
    half = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)).cast("int")
    return texts.join(F.broadcast(durable(once.withColumn("half", half))), ["doc_id", "print"]).select("doc_id", "toxic", "half", "text")


def _features(reader: Reader, column: pa.Array) -> Iterator[np.ndarray]:
    """The features of each text's distinct words, three for each word."""
    for found in reader.texts(column):
        bare = sorted({x for word in found if len(x := word.strip(EDGES)) >= 3})
        yield np.asarray([features(word) for word in bare], np.int64).ravel()


def train(docs: DataFrame, marks: DataFrame, lm_var) -> Model:
    """Evidence of words from labelled texts that are not held out, and a logistic regression on top of it.

    Spark counts in how many texts of each label and half a feature is; features with the support
    come to the driver.  The regression sees each half of the texts with the other half's evidence, so
    that it learns how far evidence holds on new texts; of each text only the summary comes to the
    driver.  Without both labels the score is the share of toxic ones.
    """
    some = sample(docs, marks)
    sizes = {(r.toxic, r.half): r.n for r in some.groupBy("toxic", "half").agg(F.count("*").alias("n")).collect()}
    n = lambda toxic, halves=(0, 1): sum(sizes.get((toxic, h), 0) for h in halves)
    if not n(1) or not n(0):
        return Model({}, plain_weights(n(1), n(0) + n(1)))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(lm_var.value)
        for batch in batches:
            keys = [np.unique(f) for f in _features(reader, batch.column(2))]
            group = np.repeat(2 * batch.column(0).to_numpy() + batch.column(1).to_numpy(), [len(k) for k in keys])
            both, times = np.unique(np.stack([np.concatenate([*keys, np.empty(0, np.int64)]), group], 1), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(times)], names=["key", "kind", "n"])

    rows = some.select("toxic", "half", "text").mapInArrow(counted, "key long, kind long, n long")
    kinds = [F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(4)]
    table = rows.groupBy("key").agg(*kinds).where(F.col("n2") + F.col("n3") >= LEAST_SUPPORT).toArrow()
    keys, *c = (table.column(k).to_numpy() for k in range(5))
    whole = evidence_of(keys, c[2] + c[3], c[0] + c[1], n(1), n(0))
    halves = docs.sparkSession.sparkContext.broadcast([evidence_of(keys, c[3 - h], c[1 - h], n(1, (1 - h,)), n(0, (1 - h,))) for h in (0, 1)])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(lm_var.value)
        for batch in batches:
            out = [summary(_by_word(f, halves.value[h])) for f, h in zip(_features(reader, batch.column(2)), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], names=["toxic", "x"])

    seen = some.select("toxic", "half", "text").mapInArrow(summed, "toxic int, x array<double>").toArrow()
    order = np.lexsort(np.asarray(seen.column(1).to_pylist()).T[::-1])  # sums are the same in every run
    return Model(whole, regression(np.asarray(seen.column(1).to_pylist())[order], seen.column(0).to_numpy()[order] == 1))


def toxicity(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row for each row of ``docs``.

    The language model counts all texts; the classifier is fitted on a bounded sample of labelled
    texts that are not held out.  A text is read whole.  Null and empty texts have no evidence and
    get the score of a text without any.  Repeated rows get equal scores.  Labels without a
    document, repeated labels (toxic if any says so) and null labels are allowed.  Only doc_id and
    text are read.  Without usable labels all scores are the observed rate; an empty table gives an
    empty result.
    """
    scores = scorer(docs, marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in scores(batches, 2):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found), pa.array((found >= LEAST_TOXIC).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def scorer(docs: DataFrame, marks: DataFrame):
    """What gives each batch with the scores of its texts, by a model fitted on ``docs``."""
    context = docs.sparkSession.sparkContext
    lm_var = context.broadcast(language_model(docs))
    model_var = context.broadcast(train(docs, marks, lm_var))

    def scores(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        model, reader = model_var.value, Reader(lm_var.value)
        seen = Evidence(model.evidence)
        for batch in batches:
            yield batch, np.asarray([score(model, [e for e in map(seen.__getitem__, found) if e]) for found in reader.texts(batch.column(text))], float)

    return scores


def without_toxic(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """``docs`` without the rows that :func:`toxicity` predicts to be toxic, each judged by its own text."""
    scores, text = scorer(docs, marks), docs.columns.index("text")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in scores(batches, text):
            yield batch.filter(pa.array(found < LEAST_TOXIC))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), labels(spark, sf_dir))
