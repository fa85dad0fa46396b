"""Phrases whose words stand together more often than apart, mined by fingerprints of word n-grams."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sealane.llm.common import Shelf, documents, text_or_empty
from sealane.llm.words import Chunk, Powers, U, _bytes, _words, chunks, lowered, mix

#: Words of the longest phrase.
LONGEST = 3
#: A candidate occurs so often at least.
LEAST = 10
#: A phrase goes if a longer one around it has this percentage of its occurrences.
SWALLOWED = 50
#: Phrases of each language in the report.
TOP = 2000
#: N-grams that a task counts together before it sends them.
FLUSH = 250_000
#: Bits of the filter of frequent n-grams that tasks are sent: BITS_EACH for each, MOST_BITS (32 MB) at most.
#: A full filter lets rare n-grams pass, which are then counted and left out.
BITS_EACH, LEAST_BITS, MOST_BITS = 32, 1 << 20, 1 << 28
#: Parts of a language whose best phrases are found side by side before the last choice.
SHARES = 32
#: Bits of a fingerprint that are used; fewer make collisions, which tests want.
FINGERPRINT = U(0xFFFFFFFFFFFFFFFF)

_BLANK = np.zeros(256, bool)
_BLANK[[9, 32]] = True
_CUT = np.zeros(256, bool)
_CUT[[*b".,;:!?", *range(10, 14)]] = True
_BETWEEN = _BLANK | _CUT
_SECOND_BYTES = np.random.default_rng(20_240).integers(1, 1 << 63, 256, np.uint64)


class Words(NamedTuple):
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    of: np.ndarray  # n + 1 offsets: the words of each text
    piece: np.ndarray  # words of one text and one number stand in one piece
    hashes: list[np.ndarray]  # two independent ones of each word


def _spans(values: np.ndarray, powers: Powers, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each range of ``values`` from prefix sums of a polynomial."""
    up, down = powers.get(len(values) + 1)
    sums = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[:-1], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U))


def split(chunk: Chunk) -> Words:
    """The words of a chunk's texts, lower-cased, with the piece that each stands in."""
    data = lowered(chunk.data)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_BETWEEN[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[chunk.bounds] = True
    word = inside[1:-1]
    start = np.flatnonzero(word & (~inside[:-2] | edge[:-1]))
    end = np.flatnonzero(word & (~inside[2:] | edge[1:])) + 1
    of = np.searchsorted(start, chunk.bounds)
    doc = np.repeat(np.arange(len(chunk.bounds) - 1), np.diff(of))
    piece = np.cumsum(_CUT[data])[start] if len(start) else start
    # The second hash reads the bytes through a table of random numbers, so no two texts collide in both by rule.
    hashes = [_spans(values, _bytes, start, end) for values in (data + U(1), _SECOND_BYTES[data])]
    return Words(start, end, doc, of, piece, hashes)


def places(words: Words, n: int) -> np.ndarray:
    """Index of the first word of every n-gram, all of whose words stand in one piece of one text."""
    at = np.arange(max(0, len(words.start) - n + 1))
    last = at + n - 1
    return at[(words.doc[at] == words.doc[last]) & (words.piece[at] == words.piece[last])] if len(at) else at


def fingerprints(words: Words, n: int, at: np.ndarray, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent fingerprints of the n-grams that begin at ``at``; ``lang`` has two hashes of each text's language."""
    one, two = (mix(_spans(values, _words, at, at + n) ^ lang[words.doc[at], k]) for k, values in enumerate(words.hashes))
    return one & FINGERPRINT, two


def _language(names: pa.Array) -> np.ndarray:
    """Two hashes of each name."""
    known: dict[str, bytes] = {}
    raw = b"".join(known.setdefault(x, hashlib.blake2b(x.encode(), digest_size=16).digest()) for x in names.to_pylist())
    return np.frombuffer(raw, U).reshape(-1, 2)


class Filter:
    """Bits that are set for all frequent n-grams, and by chance for some others."""

    def __init__(self, n_bits: int, rows: list) -> None:
        self.n_bits, self.bits = n_bits, np.zeros(n_bits // 8, np.uint8)
        for bucket, bits in rows:
            self.bits[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(bits, np.uint8)

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = (mix(keys) & U(self.n_bits - 1)).astype(np.int64)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def filter_of(table: DataFrame) -> Filter:
    """A filter of the table's keys, whose bits Spark sets: what reaches the driver is MOST_BITS at most, however many keys there are."""
    wanted = BITS_EACH * table.count()
    n_bits = LEAST_BITS
    while n_bits < min(wanted, MOST_BITS):
        n_bits *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = (mix(batch.column(0).to_numpy().view(U)) & U(n_bits - 1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at + 1)], names=["at"])

    at = table.select("key").mapInArrow(run, "at long")
    rows = at.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    return Filter(n_bits, rows.collect())


def texts_of(docs: DataFrame) -> DataFrame:
    """(row, lang, text): null languages are ``und``, null texts empty; ``row`` is a hash of id and text."""
    d = docs.select(F.struct("doc_id", text_or_empty().alias("text"), F.coalesce("lang", F.lit("und")).alias("lang")).alias("d"))
    return d.select(F.xxhash64("d.doc_id", "d.text").alias("row"), "d.lang", "d.text")


def _allowed(w: Words, n: int, lang: np.ndarray, shorter: Filter | None) -> np.ndarray:
    """Places of the n-grams whose first and last n - 1 words ``shorter`` lets pass: no other can be frequent."""
    at = places(w, n)
    if shorter is None or not len(at):
        return at
    passes = np.zeros(len(w.start) + 1, bool)
    parts = places(w, n - 1)
    passes[parts] = shorter.has(fingerprints(w, n - 1, parts, lang)[0])
    return at[passes[at] & passes[at + 1]]


def tallied(texts: DataFrame, n: int, shorter=None) -> DataFrame:
    """(key, times): fingerprints of n-grams and nothing else, a row for each in FLUSH of a task's n-grams.

    ``shorter`` is a broadcast :class:`Filter` of frequent (n - 1)-grams.
    """

    def counted(parts: list[np.ndarray]) -> pa.RecordBatch:
        key = np.sort(np.concatenate(parts))
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(key[first].view(np.int64)), pa.array(np.diff(np.r_[first, len(key)]))], names=["key", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            langs = _language(batch.column(0))
            for chunk in chunks(batch.column(1)):
                w, lang = split(chunk), langs[chunk.first :]
                parts.append(fingerprints(w, n, _allowed(w, n, lang, shorter and shorter.value), lang)[0])
                held += len(parts[-1])
                if held >= FLUSH:
                    yield counted(parts)
                    parts, held = [], 0
        if parts:
            yield counted(parts)

    return texts.select("lang", "text").mapInArrow(run, "key long, times long")


def occurrences(texts: DataFrame, filters) -> DataFrame:
    """(key, n, second, times, row, at) of n-grams that the broadcast filters by length let pass.

    Both fingerprints, and where one occurrence stands: the hash of its text's row and the number of
    its first word.  A task counts FLUSH n-grams together, so a common one is one row of it.  With
    n = 0 come all words of each language.
    """

    def counted(parts: list) -> pa.RecordBatch:
        key, n, second, row, at, times = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        if (same & ((second[order][1:] != second[order][:-1]) | (n[order][1:] != n[order][:-1]))).any():  # texts collide here already
            order = np.lexsort((second, n, key))
            same = (key[order][1:] == key[order][:-1]) & (second[order][1:] == second[order][:-1]) & (n[order][1:] == n[order][:-1])
        first = np.flatnonzero(np.r_[True, ~same]) if len(key) else order
        times = np.add.reduceat(times[order], first) if len(key) else times
        where = order[first]  # both sorts are stable: the first occurrence
        by_place = np.argsort(where)  # neighbours in a text stay neighbours, which compresses
        where = where[by_place]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (key[where].view(np.int64), n[where], second[where].view(np.int64), times[by_place], row[where], at[where])], names=["key", "n", "second", "times", "row", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            rows, langs = batch.column(0).to_numpy(), _language(batch.column(1))
            for chunk in chunks(batch.column(2)):
                w, lang = split(chunk), langs[chunk.first :]
                words, k = np.diff(w.of), len(chunk.bounds) - 1
                here = np.flatnonzero(words)
                total = mix(lang[:k] + U(7))[here]
                parts.append((total[:, 0] & FINGERPRINT, np.zeros(len(here), np.int32), total[:, 1], rows[chunk.first + here], np.zeros(len(here), np.int32), words[here].astype(np.int64)))
                for n, frequent in enumerate(filters.value, 1):
                    at = places(w, n)
                    one, two = fingerprints(w, n, at, lang)
                    hit = frequent.has(one)
                    at, doc = at[hit], w.doc[at[hit]]
                    parts.append((one[hit], np.full(len(at), n, np.int32), two[hit], rows[chunk.first + doc], (at - w.of[doc]).astype(np.int32), np.ones(len(at), np.int64)))
                    held += len(at)
                if held >= FLUSH:
                    yield counted(parts)
                    parts, held = [], 0
        if parts:
            yield counted(parts)

    return texts.mapInArrow(run, "key long, n int, second long, times long, row long, at int")


def frequent(grams: DataFrame, least: int) -> DataFrame:
    """(key, n, times, low, high, row, at) of fingerprints that occur often enough, and of all words.

    ``low`` and ``high`` are the smallest and largest second fingerprint: they differ if several
    texts share the first one.  ``row`` and ``at`` are of one row, as both take the first that they see.
    """
    sums = grams.groupBy("key", "n").agg(F.sum("times").alias("times"), F.min("second").alias("low"), F.max("second").alias("high"), F.first("row").alias("row"), F.first("at").alias("at"))
    return sums.where((F.col("n") == 0) | (F.col("times") >= least))


def materialised(texts: DataFrame, pointers: DataFrame) -> DataFrame:
    """(key, n, times, lang, phrase) of ``pointers`` (key, n, times, low, high, row, at); phrase is null if it is not the text of all occurrences.

    Texts go by the hash of their row to the pointers into them.  The fingerprints of the words that
    stand there are taken again from the text: the first must be the pointer's and the second that
    of all occurrences that were counted, else texts collide in the first one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, names, wanted = _language(batch.column(0)), batch.column(0), batch.column(2)
            sizes = wanted.value_lengths().to_numpy()
            fields = {name: wanted.flatten().field(name).to_numpy() for name in ("key", "n", "times", "low", "high", "at")}
            offsets = np.r_[0, np.cumsum(sizes)]
            for chunk in chunks(batch.column(1)):
                w, k = split(chunk), len(chunk.bounds) - 1
                a, b = offsets[chunk.first], offsets[chunk.first + k]
                key, n, times, low, high, at = (x[a:b] for x in fields.values())
                doc = np.repeat(np.arange(k), sizes[chunk.first : chunk.first + k])
                first = w.of[doc] + at
                right = (n == 0) | (first + n <= w.of[doc + 1])
                one, two = np.zeros(len(n), U), np.zeros(len(n), U)
                for m in range(1, LONGEST + 1):
                    some = np.flatnonzero(right & (n == m))
                    one[some], two[some] = fingerprints(w, m, first[some], langs[chunk.first :])
                total = mix(langs[chunk.first + doc] + U(7))
                one, two = np.where(n == 0, total[:, 0] & FINGERPRINT, one), np.where(n == 0, total[:, 1], two)
                right &= (one.view(np.int64) == key) & (two.view(np.int64) == low) & (low == high)
                data = lowered(chunk.data).tobytes()
                word = lambda i: data[w.start[i] : w.end[i]].decode()  # noqa: B023, E731
                phrase = [" ".join(word(f + i) for i in range(m)) if ok else None for ok, f, m in zip(right.tolist(), first.tolist(), n.tolist(), strict=True)]
                lang = names.take(pa.array(chunk.first + doc))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n), pa.array(times), lang, pa.array(phrase, pa.string())], names=["key", "n", "times", "lang", "phrase"])

    by_row = pointers.groupBy("row").agg(F.collect_list(F.struct("key", "n", "times", "low", "high", "at")).alias("wanted"))
    found = texts.join(by_row, "row").select("lang", "text", "wanted").mapInArrow(run, "key long, n int, times long, lang string, phrase string")
    # A row's hash may be that of several rows: repeated ones say the same, others leave the phrase null.
    best = found.groupBy("key", "n", "times").agg(F.max(F.when(F.col("phrase").isNotNull(), F.struct("lang", "phrase"))).alias("best"))
    return best.select("key", "n", "times", "best.lang", "best.phrase")


def recounted(texts: DataFrame, clashing: DataFrame, least: int) -> DataFrame:
    """(n, lang, phrase, times): what has one of the ``clashing`` fingerprints (key, n), counted by its text."""
    session, some = texts.sparkSession, filter_of(clashing)
    wanted = session.sparkContext.broadcast(some)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = _language(batch.column(1))
            for chunk in chunks(batch.column(2)):
                w, lang = split(chunk), langs[chunk.first :]
                data, names = lowered(chunk.data).tobytes(), batch.column(1).slice(chunk.first).to_pylist()
                words = np.diff(w.of)
                rows = [(k, 0, names[d], "", int(words[d])) for d, k in enumerate((mix(lang[: len(words)] + U(7))[:, 0] & FINGERPRINT).view(np.int64).tolist()) if words[d]]
                for n in range(1, LONGEST + 1):
                    at = places(w, n)
                    key = fingerprints(w, n, at, lang)[0]
                    for i, k in zip(at[hit := wanted.value.has(key)].tolist(), key[hit].view(np.int64).tolist(), strict=True):
                        rows.append((k, n, names[w.doc[i]], " ".join(data[w.start[j] : w.end[j]].decode() for j in range(i, i + n)), 1))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["key", "n", "lang", "phrase", "times"])

    exact = texts.mapInArrow(run, "key long, n int, lang string, phrase string, times long").groupBy("key", "n", "lang", "phrase").agg(F.sum("times").alias("times"))
    return exact.join(clashing, ["key", "n"], "left_semi").where((F.col("n") == 0) | (F.col("times") >= least)).select("n", "lang", "phrase", "times")


def counts(docs: DataFrame, shelf: Shelf, least: int = LEAST) -> DataFrame:
    """(n, lang, phrase, times) of all phrases of up to LONGEST words that occur ``least`` times, and, with n = 0, of all words.

    A pass for each length tallies fingerprints alone and leaves a filter of the frequent ones, by
    which the next length is thinned.  Only what passes these filters is sent with pointers.
    """
    texts, context, filters = texts_of(docs), docs.sparkSession.sparkContext, []
    for n in range(1, LONGEST + 1):
        tally = tallied(texts, n, context.broadcast(filters[-1]) if filters else None)
        keys = shelf.put(f"keys {n}", tally.groupBy("key").agg(F.sum("times").alias("times")).where(F.col("times") >= least).select("key"))
        filters.append(filter_of(keys))
        shelf.drop(f"keys {n}")
    pointers = shelf.put("pointers", frequent(occurrences(texts, context.broadcast(filters)), least))
    found = shelf.put("found", materialised(texts, pointers))
    sure = found.where("phrase IS NOT NULL").select("n", "lang", "phrase", "times")
    clashing = found.where("phrase IS NULL").select("key", "n")
    if not clashing.isEmpty():
        sure = sure.unionByName(recounted(texts, clashing, least))
    out = shelf.put("phrases", sure)
    shelf.drop("pointers", "found")
    return out


def _part(first: int | Column, n: int | Column) -> Column:
    return F.array_join(F.slice("words", first, n), " ")


def scored(known: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, score) of candidates: the lowest-scoring cut of each, the smallest of equal ones."""
    parts = known.where("n > 0").select("lang", "phrase", "times")
    cuts = known.where("n > 1").select("lang", "phrase", "n", F.col("times").alias("a"), F.split("phrase", " ").alias("words"))
    cuts = cuts.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n") - 1)))
    cuts = cuts.select("lang", "phrase", "n", "a", "k", _part(F.lit(1), F.col("k")).alias("left"), _part(F.col("k") + 1, F.col("n") - F.col("k")).alias("right"))
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("times").alias("l")), ["lang", "left"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("right"), F.col("times").alias("r")), ["lang", "right"])
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (whole("a") * whole("a")), whole("l") * whole("r"))
    best = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best")
    return cuts.groupBy("lang", "phrase", "n", "a").agg(best).select("lang", "phrase", "n", "a", "best.l", "best.r", "best.score")


def standing(candidates: DataFrame) -> DataFrame:
    """Candidates that no longer one around them has at least SWALLOWED percent of the occurrences of."""
    inner = candidates.where("n > 2").select("lang", "n", "a", F.split("phrase", " ").alias("words"))
    inner = inner.withColumn("m", F.explode(F.sequence(F.lit(2), F.col("n") - 1)))
    inner = inner.withColumn("first", F.explode(F.sequence(F.lit(1), F.col("n") - F.col("m") + 1))).select("lang", _part(F.col("first"), F.col("m")).alias("phrase"), "a")
    around = inner.groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    swallowed = 100 * F.col("around") >= SWALLOWED * F.col("a")
    return candidates.join(around, ["lang", "phrase"], "left").where(~F.coalesce(swallowed, F.lit(False))).drop("around")


def best_phrases(docs: DataFrame, top: int = TOP, least: int = LEAST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of two and three words.

    A null language is ``und`` and a null text empty; doc_id only tells rows apart and may be null or
    repeated: every row's words count.  Ties of score go by ``a`` and then the phrase's bytes.  Words
    and texts may be of any length; other columns are not read.  An empty table gives no rows.
    """
    shelf = Shelf(docs.sparkSession)
    known = counts(docs, shelf, least)
    ranked = standing(shelf.put("scored", scored(known)))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(SHARES))
    # A language's best are among the best of its shares, so no task sorts all that a language has.
    near = ranked.withColumn("share", share).withColumn("rank", F.row_number().over(W.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= top)
    first = near.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    totals = known.where("n = 0").groupBy("lang").agg(F.sum("times").alias("n"))
    out = first.drop("n").join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
    return out


def query(spark, sf_dir: str) -> DataFrame:
    return best_phrases(documents(spark, sf_dir))


ORACLE = """
WITH t AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM t),
ws AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM pieces),
placed AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM ws WHERE len(ws) > 0),
grams AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM placed, (SELECT unnest([1, 2, 3]) AS k) WHERE i + k - 1 <= len(ws)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
cuts AS (SELECT lang, k, phrase, a, w, unnest(range(1, k)) AS cut FROM c),
judged AS (
    SELECT cuts.*, x.f AS l, y.f AS r, 1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f) AS score
    FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = array_to_string(w[1:cut], ' ')
    JOIN f y ON y.lang = cuts.lang AND y.phrase = array_to_string(w[cut + 1:], ' ')
),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS nth FROM judged),
inner_ones AS (
    SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM c WHERE k = 3
    UNION ALL SELECT lang, array_to_string(w[2:3], ' ') AS phrase, a FROM c WHERE k = 3
),
around AS (SELECT lang, phrase, max(a) AS around FROM inner_ones GROUP BY ALL),
kept AS (
    SELECT best.* FROM best LEFT JOIN around ON best.lang = around.lang AND best.phrase = around.phrase
    WHERE nth = 1 AND NOT coalesce(100 * around >= 50 * a, false)
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT ranked.lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN totals ON ranked.lang = totals.lang WHERE rank <= 2000
"""
