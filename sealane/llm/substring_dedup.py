"""Removal of word windows that an earlier document has, over a log-structured fingerprint index."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealane.llm.common import documents, durable, lookup
from sealane.llm.words import U, Chunk, Spans, Words, chunks, mix, ngrams, sliding_min, words

WINDOW = 50
#: A window's fingerprint is the smallest hash of its runs of so many words.
SHINGLE = 16
#: Windows with one fingerprint are told apart further by where in them it stands, to so many words:
#: a passage's inner windows then form runs that do not depend on what surrounds the passage.
PART = 8
#: Batches by ascending doc_id in which the query's table goes through the index.
BATCHES = 3
#: Runs of one level that are merged into one of the next.
FAN_IN = 2
UNPACKED_AT_ONCE = 1 << 22
LAST = (1 << 63) - 1  # stands for a null doc_id: larger than any other


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


class Windows:
    """All WINDOW-word windows of a chunk's texts and their fingerprints."""

    def __init__(self, chunk: Chunk) -> None:
        self.words: Words = words(chunk)
        at, key = ngrams(self.words, SHINGLE)
        # Shingles stand at every word but a text's last ones; those places get the largest value.
        full = np.full(len(self.words.hash), U(0xFFFFFFFFFFFFFFFF), U)
        full[at] = key
        n = len(full) - WINDOW + 1
        if n > 0:
            low, place = sliding_min(full[: len(full) - SHINGLE + 1], WINDOW - SHINGLE + 1)
            at = np.flatnonzero(self.words.doc[:n] == self.words.doc[WINDOW - 1 :])
        else:
            low, place, at = np.empty(0, U), np.empty(0, np.int64), np.empty(0, np.int64)
        self.at, self.fingerprint = at, low[at]
        # Like the fingerprint, the part depends on nothing but the window's words.
        self.part = mix(self.fingerprint + ((place[at] - at) // PART).astype(U))
        self.of = np.searchsorted(self.words.doc[at], np.arange(len(chunk.bounds)))

    def segments(self, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, length) into ``at`` of maximal runs of adjoining kept windows of one part."""
        k = np.flatnonzero(keep)
        if not len(k):
            return k, k
        new = np.concatenate([[True], (np.diff(self.at[k]) != 1) | (self.part[k[1:]] != self.part[k[:-1]]) | (self.words.doc[self.at[k[1:]]] != self.words.doc[self.at[k[:-1]]])])
        first = np.flatnonzero(new)
        return k[first], np.diff(np.append(first, len(k)))


def kept_digest(raw: bytes) -> str:
    return hashlib.sha256(b" ".join(raw.split())).hexdigest()  # bytes.split() splits at ASCII white space


def scanned(docs: DataFrame) -> DataFrame:
    """(id, text_key, doc_id, n_words, sha, fingerprints): one row for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(3)):
                win, raw, n = Windows(chunk), chunk.data.tobytes(), len(chunk.bounds) - 1
                marks = [np.unique(win.fingerprint[a:b]) for a, b in zip(win.of, win.of[1:], strict=False)]
                offsets = np.concatenate([[0], np.cumsum([len(m) for m in marks])]).astype(np.int32)
                values = _signed(np.concatenate(marks) if marks else np.empty(0, U))
                sha = [kept_digest(raw[a:b]) for a, b in zip(chunk.bounds, chunk.bounds[1:], strict=False)]
                own = [batch.column(k).slice(chunk.first, n) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.diff(win.words.of)), pa.array(sha), pa.ListArray.from_arrays(offsets, values)], names=["id", "text_key", "doc_id", "n_words", "sha", "marks"])

    keyed = _keyed(docs).select("id", "text_key", "doc_id", "text")
    return keyed.mapInArrow(run, "id long, text_key long, doc_id long, n_words long, sha string, marks array<long>")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("id"), F.xxhash64("text").alias("text_key"), "doc_id", "text")


def packed(keyed: DataFrame) -> DataFrame:
    """(id, text_key, packed): texts compressed, for their way through a shuffle and a checkpoint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            out = [press((t.as_py() or "").encode()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["id", "text_key", "packed"])

    return keyed.select("id", "text_key", "text").mapInArrow(run, "id long, text_key long, packed binary")


def unpacked(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of a packed column, some texts at a time."""
    expand, first, out, held = zstandard.ZstdDecompressor().decompress, 0, [], 0
    for value in column:
        out.append(expand(value.as_buffer().to_pybytes()))
        held += len(out[-1])
        if held >= UNPACKED_AT_ONCE:
            yield first, out
            first, out, held = first + len(out), [], 0
    if out:
        yield first, out


class FingerprintIndex:
    """Sorted immutable runs (mark, n): marks of past batches and in how many texts they are.

    A run is hash-partitioned and sorted by mark and written to the shared folder; Spark knows both
    of what it reads back, so a batch is merge-joined with the runs without moving them.  FAN_IN
    runs of a level are merged into one of the next level, so a table of B batches has O(log B) runs.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = []

    def _run(self, counted: DataFrame) -> DataFrame:
        return durable(counted.repartition(self.parts, "mark").sortWithinPartitions("mark"))

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, marks: DataFrame) -> DataFrame:
        """Take in a batch (mark of each text); returns its marks that other texts have too."""
        new = self._run(marks.groupBy("mark").agg(F.count("*").alias("n")))
        met = new.where("n > 1").select("mark")
        for run in self.runs():
            met = met.union(new.join(run.select("mark").hint("merge"), "mark", "left_semi").select("mark"))
        met = durable(met.distinct())
        self._push(new, 0)
        return met

    def _push(self, run: DataFrame, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= FAN_IN:
            merged = self._run(self._merged(self.levels[level]))
            self.levels[level] = []
            self._push(merged, level + 1)

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        whole = runs[0]
        for run in runs[1:]:
            whole = whole.unionByName(run)
        return whole.groupBy("mark").agg(F.sum("n").alias("n"))

    def counts(self) -> DataFrame:
        """(mark, n) over all runs."""
        return self._merged(self.runs())


def _batches(rows: DataFrame, n: int) -> list[DataFrame]:
    """Parts of the rows by ascending id; rows with one id stay together.

    Rows without an id come in the last part and choose no cut.  Cuts come as doubles, which for
    large ids only stand near a quantile; as longs they part the ids exactly all the same.
    """
    named = rows.where(F.col("id") < LAST)
    cuts = sorted({min(int(c), LAST - 1) for c in named.approxQuantile("id", [k / n for k in range(1, n)], 0.01)}) if n > 1 else []
    edges = [None, *cuts, None]
    out = []
    for low, high in zip(edges, edges[1:], strict=False):
        part = rows if low is None else rows.where(F.col("id") > low)
        out.append(part if high is None else part.where(F.col("id") <= high))
    return out


SEGMENT = "id long, text_key long, part long, d1 long, d2 long, pos long, length long"


def segments(involved: DataFrame) -> DataFrame:
    """Runs of windows with a shared mark: place, number of windows, 128-bit hash of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for win, chosen, ids, keys in _with_marks(batch, "fingerprint"):
                first, length = win.segments(chosen)
                start = win.at[first]
                d1, d2 = Spans(win.words).get(start, start + length - 1 + WINDOW)
                doc = win.words.doc[start]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[doc]), pa.array(keys[doc]), _signed(win.part[first]), _signed(d1), _signed(d2), pa.array(start - win.words.of[doc]), pa.array(length)],
                    names=["id", "text_key", "part", "d1", "d2", "pos", "length"],
                )

    return involved.select("id", "text_key", "packed", "marks").mapInArrow(run, SEGMENT)


def single_windows(involved: DataFrame) -> DataFrame:
    """(id, text_key, h1, h2, places) of every distinct window of one of the row's parts (in marks).

    ``places`` has the window's places in its text as (pos, length) of adjoining ones, so a text that
    repeats one word thousands of times is one row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for win, chosen, ids, keys in _with_marks(batch, "part"):
                start = win.at[chosen]
                h1, h2 = Spans(win.words).get(start, start + WINDOW)
                order = np.lexsort((start, h2, h1, win.words.doc[start]))
                start, h1, h2 = start[order], h1[order], h2[order]
                doc = win.words.doc[start]
                new = np.ones(len(start), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
                apart = new.copy()
                apart[1:] |= np.diff(start) != 1
                group, first = np.flatnonzero(new), np.flatnonzero(apart)
                length = np.diff(np.append(first, len(start)))
                ranges = pa.StructArray.from_arrays([pa.array(start[first] - win.words.of[doc[first]]), pa.array(length)], names=["pos", "length"])
                offsets = np.append(np.searchsorted(first, group), len(first)).astype(np.int32)
                columns = [pa.array(ids[doc[group]]), pa.array(keys[doc[group]]), _signed(h1[group]), _signed(h2[group]), pa.ListArray.from_arrays(offsets, ranges)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "text_key", "h1", "h2", "places"])

    return involved.select("id", "text_key", "packed", "marks").mapInArrow(run, "id long, text_key long, h1 long, h2 long, places array<struct<pos:long,length:long>>")


def _with_marks(batch: pa.RecordBatch, by: str):
    """The windows of a batch's texts and which of them have their ``by`` among their row's marks."""
    all_ids, all_keys, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
    for row, texts in unpacked(batch.column(2)):
        for chunk in chunks(pa.array(texts, pa.large_binary()).cast(pa.large_string())):
            win, n, first = Windows(chunk), len(chunk.bounds) - 1, row + chunk.first
            value, chosen = getattr(win, by), np.zeros(len(win.at), bool)
            for k, (a, b) in enumerate(zip(win.of, win.of[1:], strict=False)):
                wanted = np.sort(marks[first + k].values.to_numpy(zero_copy_only=False).view(U))
                if b > a and len(wanted):
                    chosen[a:b] = wanted[np.minimum(np.searchsorted(wanted, value[a:b]), len(wanted) - 1)] == value[a:b]
            yield win, chosen, all_ids[first : first + n], all_keys[first : first + n]


def _cut(found: DataFrame) -> DataFrame:
    """(id, text_key, n_removed, sha) after removing the words that the windows at ``places`` cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, sha, expand = [], [], zstandard.ZstdDecompressor().decompress
            for text, places in zip(batch.column(2), batch.column(3), strict=True):
                parts = expand(text.as_buffer().to_pybytes()).split()
                steps = np.zeros(len(parts) + 1, np.int64)
                flat = places.values
                pos, length = flat.field(0).to_numpy(), flat.field(1).to_numpy()
                np.add.at(steps, pos, 1)
                np.add.at(steps, pos + length - 1 + WINDOW, -1)
                gone = np.cumsum(steps[:-1]) > 0
                removed.append(int(gone.sum()))
                sha.append(hashlib.sha256(b" ".join([p for p, g in zip(parts, gone.tolist(), strict=True) if not g])).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], names=["id", "text_key", "n_removed", "cut_sha"])

    return found.select("id", "text_key", "packed", "places").mapInArrow(run, "id long, text_key long, n_removed long, cut_sha string")


def substring_dedup(docs: DataFrame, n_batches: int = BATCHES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), one row for each row of ``docs``.

    A window's fingerprint is the minimum over the hashes of its SHINGLE-word runs, so equal windows
    have equal fingerprints and neighbouring windows mostly share one; every window has one.  The
    table goes through the index in batches by doc_id.  Texts with fingerprints that others share
    are then verified by 128-bit hashes of the words themselves: first whole runs of windows with
    one fingerprint and part, whose owners but the first lose them; then, where a part has several
    different runs, the first owners' single windows.

    Windows never span rows.  Rows with one doc_id do not remove each other's words, and a null
    doc_id is larger than all others.  Null, empty and short texts lose nothing.  Only doc_id and
    text are read.  An empty table gives an empty result.
    """
    rows = durable(scanned(docs))
    index = FingerprintIndex(docs.sparkSession)
    met = None
    for part in _batches(rows.select("id", "marks"), n_batches):
        hits = index.add(part.select(F.explode("marks").alias("mark")))
        met = hits if met is None else met.union(hits)
    shared = durable(index.counts().join(met.distinct(), "mark", "left_semi"))

    held = rows.select("id", "text_key", F.explode("marks").alias("mark"))
    total = rows.agg(F.sum(F.size("marks"))).first()[0] or 0
    by_text = lookup(held, shared, ["mark"], "n", total, how="inner").groupBy("id", "text_key").agg(F.collect_set("mark").alias("marks"))
    texts = packed(_keyed(docs))
    involved = durable((texts.dropDuplicates(["id", "text_key"]) if _repeated(rows) else texts).join(by_text, ["id", "text_key"]))

    runs = durable(segments(involved))
    n_runs = runs.count()
    key = ["part", "d1", "d2", "length"]
    classes = durable(runs.groupBy(*key).agg(F.min("id").alias("first"), F.count("*").alias("n")))
    later = lookup(runs, classes, key, "n", n_runs).where("id > first").select("id", "text_key", F.array(F.struct("pos", "length")).alias("places"))
    contested = classes.groupBy("part").agg(F.count("*").alias("k")).where("k > 1")
    owners = classes.where(F.col("first") < LAST).join(contested, "part", "left_semi").groupBy(F.col("first").alias("id")).agg(F.collect_set("part").alias("wanted"))
    # Rows without an id share one number, so each takes its own parts by its text; it only loses words.
    nameless = runs.where(F.col("id") == LAST).join(contested, "part", "left_semi").groupBy("id", "text_key").agg(F.collect_set("part").alias("wanted"))
    wanted = involved.where(F.col("id") < LAST).join(owners, "id").select("id", "text_key", "packed", "wanted")
    wanted = wanted.unionByName(involved.join(nameless, ["id", "text_key"]).select("id", "text_key", "packed", "wanted"))
    single = durable(single_windows(wanted.withColumnRenamed("wanted", "marks")))
    firsts = single.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n")).where("first < last").drop("last")
    earlier = lookup(single, durable(firsts), ["h1", "h2"], "n", single.count(), how="inner").where("id > first")
    places = later.unionByName(earlier.select("id", "text_key", "places")).groupBy("id", "text_key").agg(F.flatten(F.collect_list("places")).alias("places"))
    changed = _cut(involved.select("id", "text_key", "packed").join(places, ["id", "text_key"]))

    whole = rows.select("id", "text_key", "doc_id", "n_words", "sha").join(changed, ["id", "text_key"], "left")
    return whole.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("cut_sha", "sha").alias("kept_sha256"))


def _repeated(rows: DataFrame) -> bool:
    """Whether some row is there twice, so that its text would be taken twice."""
    return not rows.groupBy("id", "text_key").count().where("count > 1").isEmpty()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir))


ORACLE = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)),
firsts AS (SELECT win, min(doc_id) AS doc_id FROM windows GROUP BY win),
repeats AS (SELECT w.doc_id, w.i FROM windows w JOIN firsts f ON w.win = f.win AND w.doc_id > f.doc_id),
covered AS (SELECT DISTINCT doc_id, i + k AS place FROM repeats, range(50) AS t(k)),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS place FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS text, count(*) AS n FROM words ANTI JOIN covered USING (doc_id, place) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, len(ws)::BIGINT - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
