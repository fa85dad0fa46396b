"""Similarity join of documents by the Jaccard index of their word shingles."""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from sealane.llm.common import Shelf, components, documents, lookup, tidy
from sealane.llm.words import U, chunks, lowered, mix, ngrams, words

#: Words of a shingle.
SHINGLE = 3
#: Two sets link when 100 * intersection >= PERCENT * union.
PERCENT = 90
#: Similarities below this would need prefixes longer than the sets (see :func:`extended`).
LEAST_PERCENT = 75
#: Shingles found in more of a prefix index's sets than this are indexed in pairs.
FREQUENT = 32
#: At most so many shingles are set back to the end of the order, as the most widespread ones.
MOST_BACK = 1 << 20
LEAST_BACK = 16
#: Places over which the rows of one widespread shingle are dealt.
SALTS = 4096
#: Ids (or, without ids, nodes) whose sets are needed are broadcast up to this number, else joined by shuffle.
BROADCAST_IDS = 500_000
#: Shingles that a task counts together when it looks for widespread ones.
COUNTED_AT_ONCE = 2_000_000
#: Sets whose prefix a task has given already, to give copies' prefixes once; forgotten when so many.
MOST_SEEN = 200_000
#: 64-bit words of a set's parity signature.
PARITY = 8
#: Sets of so many shingles also carry the number of their elements in each of COUNTS places: parities
#: of longer sets are as good as random, and a partner may differ in more elements than random ones show.
LONG, COUNTS = 1_000, 256
#: Keys by which a set first meets others, and how many at each.
STAR_KEYS, CENTRES = 12, 4
#: Counters of words, by hash; they only tell which shingles look rare.
WORD_PLACES = 1 << 14
#: Sets of one key that one task compares with each other.
BLOCK = 1_000
#: Smallest keys by which a pair that meets at many keys is known to have met before.
SKETCH = 8
#: Pairs are compared and checked in so many parts one after the other (checked ones: times itself), so
#: that shuffles of signatures and whole sets never lie on disk all at once.
PARTS = 2


def shingle_sets(batch: pa.RecordBatch, size: int = SHINGLE, rarity: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray | None]]:
    """(row, sorted distinct 64-bit shingle hashes, how common each looks) of each text, A-Z lower-cased.

    A shingle looks as common as its words are (``rarity``, see :func:`commonness`), in 255 steps.
    """
    for chunk in chunks(batch.column(1)):
        w = words(chunk, lowered(chunk.data))
        at, keys = ngrams(w, size)
        first = np.searchsorted(w.doc[at], np.arange(len(chunk.bounds)))
        looks = None
        if rarity is not None:
            common = rarity[_place(w.hash)]
            looks = np.minimum(255, sum(common[at + k] for k in range(size)) * (8 / size)).astype(np.uint8) if len(at) else np.empty(0, np.uint8)
        for k, (a, b) in enumerate(zip(first, first[1:], strict=False)):
            if b > a:
                found, place = np.unique(keys[a:b], return_index=True)
                yield chunk.first + k, found, looks[a:b][place] if looks is not None else None
            elif w.of[k + 1] > w.of[k]:  # fewer words: the whole sequence is the one shingle
                few = w.hash[w.of[k] : w.of[k + 1]]
                key = mix(few[:1] + U(1))
                for i in range(1, len(few)):
                    key = mix(key + few[i : i + 1])
                yield chunk.first + k, key, np.zeros(1, np.uint8)
            else:
                yield chunk.first + k, np.empty(0, U), np.empty(0, np.uint8)


def _place(word: np.ndarray) -> np.ndarray:
    """Where a word is counted: words share WORD_PLACES counters."""
    return (word >> U(48)).astype(np.int64) % WORD_PLACES


def commonness(counts: DataFrame) -> np.ndarray:
    """Logarithm of the number of words at each counter, over all texts."""
    out = np.zeros(WORD_PLACES, np.float32)
    for place, times in counts.groupBy("place").agg(F.sum("times")).collect():
        out[place] = np.log2(1 + times)
    return out


def set_id(shingles: np.ndarray) -> int:
    """A digest of a set: sets are the same node if this and their size agree."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def members_and_counts(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """One pass over the texts: (doc_id, node, n) of each row, (shingle, times) of shingles that texts
    share, and (place, times) of words.

    Rows with ``n`` are documents, those with ``place`` words, all others shingles.  A task counts the
    shingles of its texts, some texts at a time, and reports those that several of these hold.
    """

    def rows(k: int, doc_id=None, node=None, n=None, shingle=None, place=None, times=None) -> pa.RecordBatch:
        kinds = {"doc_id": (doc_id, pa.int64()), "node": (node, pa.int64()), "n": (n, pa.int32()), "shingle": (shingle, pa.int64()), "place": (place, pa.int32()), "times": (times, pa.int64())}
        return pa.RecordBatch.from_arrays([pa.nulls(k, t) if x is None else pa.array(x, t) for x, t in kinds.values()], names=list(kinds))

    def shared(sets: list[np.ndarray]) -> pa.RecordBatch:
        key, count = np.unique(np.concatenate(sets), return_counts=True)
        often = count > 1
        return rows(int(often.sum()), shingle=_signed(key[often]), times=count[often])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, held, total = [], 0, np.zeros(WORD_PLACES, np.int64)
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                total += np.bincount(_place(words(chunk, lowered(chunk.data)).hash), minlength=WORD_PLACES)
            node, n = [], []
            for _, s, _ in shingle_sets(batch, size):
                node.append(set_id(s))
                n.append(len(s))
                if len(s):
                    sets.append(s)
                    held += len(s)
                if held >= COUNTED_AT_ONCE:
                    yield shared(sets)
                    sets, held = [], 0
            yield rows(len(node), doc_id=batch.column(0), node=node, n=n)
        if sets:
            yield shared(sets)
        some = np.flatnonzero(total)
        yield rows(len(some), place=some, times=total[some])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, node long, n int, shingle long, place int, times long")


def widespread(counts: DataFrame, n_shingles: int) -> np.ndarray:
    """Sorted hashes of the most widespread shingles, MOST_BACK at most.

    A sum of at least ``n_shingles / MOST_BACK`` can be reached by MOST_BACK shingles at most.  The
    choice only sets an order of shingles, so it bears on speed alone.
    """
    least = max(LEAST_BACK, -(-n_shingles // MOST_BACK))
    often = counts.groupBy("shingle").agg(F.sum("times").alias("times")).where(F.col("times") >= least).select("shingle")
    return np.sort(often.toArrow().column(0).to_numpy().view(U))


def lacking(n: int, percent: int = PERCENT) -> int:
    """At most so many elements of a set of ``n`` are missing in a set that it links with."""
    return n - -(-percent * n // 100)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """First elements that are looked at: a quarter more than can be missing, and two."""
    e = lacking(n, percent)
    return min(n, e + e // 4 + 2)


def extended(n: int, percent: int = PERCENT) -> int:
    """Of so many first elements two linked sets share two that stand side by side in both.

    Sets of ``n`` and ``m <= 100 n / percent`` that link differ in at most
    (n + m)(100 - percent) / (100 + percent) elements, d.  Of the first lacking(n) + d + 2 elements
    they share d + 2, in whose d + 1 gaps the d elements that only one of them has can stand.
    """
    return min(n, lacking(n, percent) + (n + 100 * n // percent) * (100 - percent) // (100 + percent) + 2)


class Order(NamedTuple):
    """The common order of shingles: rare-looking ones first, the most widespread ones last."""

    last: np.ndarray  # sorted hashes of the widespread ones
    rarity: np.ndarray

    def widespread(self, s: np.ndarray) -> np.ndarray:
        if not len(self.last):
            return np.zeros(len(s), bool)
        return self.last[np.minimum(np.searchsorted(self.last, s), len(self.last) - 1)] == s

    def sorted(self, s: np.ndarray, looks: np.ndarray) -> np.ndarray:
        """``s``, sorted by hash, in this order; equal looks stay in the order of hashes."""
        return s[np.argsort(looks.astype(np.int16) + 256 * self.widespread(s), kind="stable")]


def prefixes(docs: DataFrame, order, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """(shingle, salt, node, n, pos): the first elements of each set that can link with another.

    A task gives the prefix of equal sets once.  Rows of widespread shingles get a salt above 0 and
    are dealt over many places: what they are is known already.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, seen = order.value, set()
        for batch in batches:
            out, held = [], 0
            for _, s, looks in shingle_sets(batch, size, common.rarity):
                if len(s) * (100 - percent) < percent or len(s) < 2:
                    continue  # a set this small links only with its equals, which are the same node
                node = set_id(s)
                if node in seen:
                    continue
                if len(seen) >= MOST_SEEN:
                    seen.clear()
                seen.add(node)
                out.append((common.sorted(s, looks)[: prefix_length(len(s), percent)], node, len(s)))
                held += len(out[-1][0])
                if held >= COUNTED_AT_ONCE // 4:
                    yield rows(out, common)
                    out, held = [], 0
            if out:
                yield rows(out, common)

    def rows(out: list, common: Order) -> pa.RecordBatch:
        lengths = [len(p) for p, _, _ in out]
        shingle = np.concatenate([p for p, _, _ in out])
        node, n = np.repeat(np.asarray([x for _, x, _ in out], np.int64), lengths), np.repeat(np.asarray([x for _, _, x in out], np.int32), lengths)
        pos = np.concatenate([np.arange(k, dtype=np.int32) for k in lengths])
        salt = np.where(common.widespread(shingle), 1 + node % SALTS, 0).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (_signed(shingle), salt, node, n, pos)], names=["shingle", "salt", "node", "n", "pos"])

    return docs.select("doc_id", "text").mapInArrow(run, "shingle long, salt int, node long, n int, pos int")


def _lacking(n: Column, percent: int) -> Column:
    return n - F.ceil(F.lit(percent) * n / 100)


def linkable(prefix: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node, n, tokens) of the sets that share enough of their prefix with other sets at all.

    Of a linked set's prefix all but ``lacking(n)`` elements are in the partner's.  ``tokens`` has the
    shared ones as (pos, shingle, often) in order: more than FREQUENT prefixes hold those with ``often``.
    One exchange by shingle tells how many hold each; those known to be widespread need no count.
    """
    one = W.partitionBy("shingle", "salt")
    held = prefix.withColumns({"_n": F.count("*").over(one), "_low": F.min("node").over(one), "_high": F.max("node").over(one)})
    held = held.where("salt > 0 OR _low < _high").select("node", "n", "pos", "shingle", ((F.col("salt") > 0) | (F.col("_n") > FREQUENT)).alias("often"))
    sets = held.groupBy("node", "n").agg(F.collect_set(F.struct("pos", "shingle", "often")).alias("tokens"))
    return sets.where(F.size("tokens") >= _least_shared(percent)).select("node", "n", F.array_sort("tokens").alias("tokens"))


def _least_shared(percent: int) -> Column:
    """Elements of its prefix that a linked set shares with the partner's, which may be as small as percent allows."""
    least = F.ceil(F.lit(percent) * F.col("n") / 100)
    lack = _lacking(least, percent)
    return F.least(least - lack, F.floor(lack / 4) + 2)


def sets_of(docs: DataFrame, order, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """(node, n, shingles, pairs, parity, counts) of each row: its set, the keys of neighbours in its
    extended prefix, and a signature.

    Bit k of ``parity`` is the parity of the number of elements whose hash falls on k: two sets
    differ in at least as many elements as their signatures in bits.  So they do in the sum of the
    differences of their ``counts``, which shorter sets have not (null).
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = order.value
        for batch in batches:
            out, held = [], 0
            for _, s, looks in shingle_sets(batch, size, common.rarity):
                places = np.bincount((mix(s) >> U(32)).astype(np.int64) % (64 * PARITY), minlength=64 * PARITY)
                counts = np.minimum(places.reshape(-1, COUNTS).sum(0), 32_767).astype(np.int16) if len(s) >= LONG else None
                ahead = common.sorted(s, looks)[: extended(len(s), percent)]
                out.append((set_id(s), len(s), s, mix(mix(ahead[:-1]) + ahead[1:]), np.packbits((places & 1).astype(np.uint8), bitorder="little").view(U), counts))
                held += len(s)
                if held >= COUNTED_AT_ONCE:
                    yield rows(out)
                    out, held = [], 0
            if out:
                yield rows(out)

    def rows(out: list) -> pa.RecordBatch:
        node, n, *lists, counts = zip(*out, strict=True)
        many = lambda x: pa.ListArray.from_arrays(np.cumsum([0, *map(len, x)]).astype(np.int32), pa.array(_signed(np.concatenate(x))))
        return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(n, pa.int32()), *map(many, lists), pa.array(counts, pa.list_(pa.int16()))], names=["node", "n", "shingles", "pairs", "parity", "counts"])

    return docs.select("doc_id", "text").mapInArrow(run, "node long, n int, shingles array<long>, pairs array<long>, parity array<long>, counts array<short>")


def sets_for(docs: DataFrame, owners: DataFrame, members: DataFrame, order, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """What :func:`sets_of` gives for the nodes of ``owners`` (node, n, doc_id), once each.

    Sets come from the rows of one id of each node and, for nodes that only null-id rows hold, from
    a pass over these rows.
    """
    ids = owners.where("doc_id IS NOT NULL").select("doc_id").distinct()
    n_ids, n_nameless = owners.agg(F.count_distinct("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    ids = F.broadcast(ids) if n_ids <= BROADCAST_IDS else ids
    found = sets_of(docs.select("doc_id", "text").join(ids, "doc_id", "left_semi"), order, percent, size)
    repeated = members.join(ids, "doc_id", "left_semi").count() > n_ids
    if n_nameless:
        nameless = owners.where("doc_id IS NULL").select("node", "n")
        rows = sets_of(docs.where("doc_id IS NULL"), order, percent, size)
        found = found.unionByName(rows.join(F.broadcast(nameless) if n_nameless <= BROADCAST_IDS else nameless, ["node", "n"], "left_semi"))
    return found.dropDuplicates(["node", "n"]) if repeated or n_nameless else found


def indexed(tokens: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node, n, first, keys, signature): single rare shingles of prefixes, and pairs of neighbours of extended ones.

    If two linked sets share a shingle of their prefixes that is not frequent, they have it as a
    key.  Else all that their prefixes share are frequent, and both sets are indexed by the pairs of
    neighbours in the extended prefix, of which they share one.  Keys grow with the length of a set,
    not with its square.  ``first`` is the place of the first shingle that another prefix has too.
    """
    rare = F.transform(F.filter("tokens", lambda t: ~t["often"]), lambda t: F.xxhash64(F.lit(1), t["shingle"]))
    crowded = F.size(F.filter("tokens", lambda t: t["often"])) >= _least_shared(percent)
    keyed = tokens.select("node", "n", F.get("tokens", F.lit(0))["pos"].alias("first"), rare.alias("rare"), crowded.alias("crowded"))
    found = keyed.join(sets.select("node", "n", "pairs", F.struct("parity", "counts").alias("signature")), ["node", "n"])
    return found.select("node", "n", "first", F.when(F.col("crowded"), F.array_distinct(F.concat("rare", "pairs"))).otherwise(F.col("rare")).alias("keys"), "signature")


def _least(a: str, b: str, percent: int) -> Column:
    """Elements that sets of these sizes must share."""
    return F.ceil(F.lit(percent) * (F.col(f"{a}.n") + F.col(f"{b}.n")) / F.lit(100 + percent))


def _may_link(percent: int) -> Column:
    """Whether sizes and first shared places of ``a`` and ``b`` allow a link: what stands before a set's
    first element that any other prefix has is missing in every partner."""
    least = _least("a", "b", percent)
    alike = F.least("a.n", "b.n") * 100 >= F.greatest("a.n", "b.n") * percent
    return alike & (F.col("first_a") <= F.col("a.n") - least) & (F.col("first_b") <= F.col("b.n") - least)


def _signatures_allow(percent: int) -> Column:
    """Whether the signatures of ``a`` and ``b`` differ in no more than linked sets may; counts bear on two long sets."""
    a, b = F.col("signature_a"), F.col("signature_b")
    most = F.col("a.n") + F.col("b.n") - 2 * _least("a", "b", percent)
    bits = sum((F.bit_count(a["parity"][k].bitwiseXOR(b["parity"][k])) for k in range(PARITY)), F.lit(0))
    apart = F.zip_with(a["counts"], b["counts"], lambda x, y: F.abs(x.cast("int") - y.cast("int")))
    return (bits <= most) & F.coalesce(F.aggregate(apart, F.lit(0), lambda total, x: total + x) <= most, F.lit(True))


def _attach(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """Add ``column`` of both nodes of each pair, as <column>_a and <column>_b."""
    one = table.select(F.struct("node", "n").alias("b"), F.col(column).alias(f"{column}_b"))
    two = table.select(F.struct("node", "n").alias("a"), F.col(column).alias(f"{column}_a"))
    return pairs.join(one, "b").join(two, "a")


def _part_of(column: Column) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(PARTS))


def verified(pairs: DataFrame, sets: DataFrame, shelf: Shelf, percent: int = PERCENT) -> DataFrame:
    """(a, b) of those pairs whose whole sets link, part by part on the shelf as ``links``."""
    shared = F.size(F.array_intersect("shingles_a", "shingles_b"))
    table = sets.select(F.struct("node", "n").alias("v"), "shingles")
    ends = {(x, k): table.where(_part_of(F.col("v")) == k).select(F.col("v").alias(x), F.col("shingles").alias(f"shingles_{x}")) for x in "ab" for k in range(PARTS)}
    found = []
    for k, m in itertools.product(range(PARTS), repeat=2):
        part = pairs.where((_part_of(F.col("a")) == k) & (_part_of(F.col("b")) == m))
        both = part.join(ends["b", m], "b").join(ends["a", k], "a")
        found.append(shelf.put("links", both.where(shared * (100 + percent) >= percent * (F.col("a.n") + F.col("b.n"))).select("a", "b")))
    return functools.reduce(DataFrame.unionByName, found)


def links(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> tuple[DataFrame, DataFrame, Shelf]:
    """(node of every document, root of every linked node, the shelf that holds both).

    Candidate pairs are taken in two steps.  First every set is checked against a few sets of each of
    some of its keys only: what thousands of near copies share costs thousands of pairs and not
    their square.  Then, for keys whose sets are still in different
    components, pairs across components are compared by size, place and signature, block by block,
    and those that these leave open are checked.  Links inside a component are not needed.
    """
    if not LEAST_PERCENT <= percent <= 100:
        raise ValueError(f"percent must be from {LEAST_PERCENT} to 100")
    shelf = Shelf(docs.sparkSession)
    both = shelf.put("members", members_and_counts(docs, size))
    members = both.where("n IS NOT NULL").select("doc_id", "node", "n")
    last = widespread(both.where("shingle IS NOT NULL"), members.agg(F.sum("n")).first()[0] or 0)
    order = docs.sparkSession.sparkContext.broadcast(Order(last, commonness(both.where("place IS NOT NULL"))))
    tokens = shelf.put("tokens", linkable(prefixes(docs, order, percent, size), percent))
    owners = shelf.put("owners", members.groupBy("node", "n").agg(F.min("doc_id").alias("doc_id")).join(tokens.select("node", "n"), ["node", "n"], "left_semi"))
    sets = shelf.put("sets", sets_for(docs, owners, members, order, percent, size))
    index = shelf.put("index", indexed(tokens, sets, percent))
    shelf.drop("tokens", "owners")

    stars = shelf.put("stars", to_centres(index, shelf, percent))
    found = verified(stars, sets, shelf, percent)
    roots = components(found, shelf)
    rest = shelf.put("rest", across(index, roots, shelf, percent).join(stars, ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        roots = components(found.unionByName(verified(rest, sets, shelf, percent)), shelf)
    shelf.drop("sets", "index", "centres", "stars", "links", "open", "rest", "split", "met")
    return members, roots, shelf


def to_centres(index: DataFrame, shelf: Shelf, percent: int = PERCENT) -> DataFrame:
    """(a, b): each set with CENTRES sets of each of its STAR_KEYS smallest keys, if size, place and signature allow a link.

    Which sets of a key are its centres depends on a hash of both, so a group that shares many keys has many centres.
    """
    v = F.struct("node", "n")
    keys = index.select(F.explode(F.slice(F.array_sort("keys"), 1, STAR_KEYS)).alias("key"), v.alias("b"), F.col("first").alias("first_b"))
    some = [F.min(F.struct(F.xxhash64(F.lit(k), "key", "b").alias("at"), "b", "first_b")) for k in range(CENTRES)]
    centres = keys.groupBy("key").agg(F.array_distinct(F.array(*some)).alias("centres"), F.count("*").alias("size")).where("size > 1")
    centres = shelf.put("centres", centres.select("key", "size", F.transform("centres", lambda c: F.struct(c["b"].alias("a"), c["first_b"].alias("first_a"))).alias("centres")))
    pairs = lookup(keys, centres, ["key"], "size", centres.agg(F.sum("size")).first()[0] or 0, how="inner")
    pairs = pairs.select("b", "first_b", F.inline("centres")).where((F.col("a") != F.col("b")) & _may_link(percent)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return _attach(pairs, index, "signature").where(_signatures_allow(percent)).select("a", "b")


def across(index: DataFrame, roots: DataFrame, shelf: Shelf, percent: int = PERCENT) -> DataFrame:
    """(a, b) of sets that share a key, are in different components and may link.

    The sets of a key with many are dealt into blocks of about BLOCK, each of which meets all, so no
    task compares more than BLOCK sets of a key with the others.  Sets that are alike but not enough
    share hundreds of keys; a pair that shares one of its SKETCH smallest keys is taken at the
    smallest such key alone.  That key is held by two components, so the pair does meet there.
    """
    v = F.struct("node", "n")
    placed = index.select(v.alias("v"), "first", "keys", "signature", F.slice(F.array_sort("keys"), 1, SKETCH).alias("sketch")).join(roots.select(F.col("node").alias("v"), "root"), "v", "left").withColumn("root", F.coalesce("root", "v"))
    # A key of one component alone needs no look.  What goes by key is thin: of most keys nothing is left.
    at = placed.select(F.explode("keys").alias("key"), F.col("root.node").alias("r"), F.col("root.n").alias("m"))
    ends = [f(c).alias(f"{name}_{c}") for c in ("r", "m") for name, f in (("low", F.min), ("high", F.max))]
    split = at.groupBy("key").agg(*ends, F.count("*").alias("size")).where("low_r != high_r OR low_m != high_m")
    split = shelf.put("split", split.select("key", "size"))
    # One row of ``split`` a key: where a key is hot, AQE splits the rows that meet it.
    met = index.select("node", "n", F.explode("keys").alias("key")).join(split, "key")
    met = shelf.put("met", met.select(v.alias("v"), "key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")))
    placed = placed.select("v", "first", "root", "signature", "sketch")
    found = [shelf.put("open", meetings(met.where(_part_of(F.col("key")) == k), placed, percent).distinct()) for k in range(PARTS)]
    return functools.reduce(DataFrame.unionByName, found).distinct()


def meetings(met: DataFrame, placed: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b) of sets of different components that meet at a key of ``met`` and may link."""
    side = lambda x: [F.col("v").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("first", "root", "signature", "sketch")]]
    open_pair = (F.col("a") < F.col("b")) & (F.col("root_a") != F.col("root_b")) & _may_link(percent) & _signatures_allow(percent)
    open_pair &= F.coalesce(F.array_min(F.array_intersect("sketch_a", "sketch_b")) >= F.col("key"), F.lit(True))
    rows = met.join(placed, "v")
    a = rows.select("key", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int").alias("block"), *side("a"))
    b = rows.select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), *side("b"))
    return a.join(b, ["key", "block"]).where(open_pair).select("a", "b")


def similar_components(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each row of ``docs``.

    Documents with the same set are one node, so copies cost nothing.  A text without words (null,
    empty, blank) has an empty set and is linked with nothing, not even its like.  Repeated rows
    get a row each.  Only doc_id and text are read.  An empty table gives an empty result.
    """
    members, roots, shelf = links(docs, percent, size)
    roots = roots.select(F.col("node.node").alias("node"), F.col("node.n").alias("n"), F.col("root.node").alias("r_node"), F.col("root.n").alias("r_n"))
    sizes = members.where("n > 0").groupBy("node", "n").agg(F.count("*").alias("size"), F.min("doc_id").alias("least"))
    classes = shelf.put("classes", sizes.join(roots, ["node", "n"], "left").select("node", "n", "size", "least", F.coalesce("r_node", "node").alias("r_node"), F.coalesce("r_n", "n").alias("r_n")))
    smallest = classes.groupBy("r_node", "r_n").agg(F.min("least").alias("component_id"))
    classes = shelf.put("classes", classes.join(smallest, ["r_node", "r_n"]).select("node", "n", "size", "component_id"))
    named = lookup(members, classes, ["node", "n"], "size", members.count())
    return named.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """``docs`` with one row of each component, the one with the smallest id (nulls last).

    Rows are told apart by id and set together, so rows that share an id, or have none, are each
    judged by their own text.  Of several rows with the smallest id and the same set, the one with
    the least text stays.  A row without words is in no component and stays.
    """
    members, roots, shelf = links(docs, percent, size)
    roots = roots.select(F.col("node.node").alias("node"), F.col("node.n").alias("n"), F.col("root.node").alias("r_node"), F.col("root.n").alias("r_n"))
    rows = members.where("n > 0").groupBy("node", "n", "doc_id").agg(F.count("*").alias("copies"))
    sets = rows.groupBy("node", "n").agg(F.sum("copies").alias("size"), F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "copies")).alias("first"))
    sets = shelf.put("sets", sets.join(roots, ["node", "n"], "left").select("node", "n", "size", "first", F.coalesce("r_node", "node").alias("r_node"), F.coalesce("r_n", "n").alias("r_n")))
    stays = sets.groupBy("r_node", "r_n").agg(F.sum("size").alias("total"), F.min(F.struct("first.nameless", "first.doc_id", "node", "n")).alias("stays")).where("total > 1")
    judged = sets.join(stays, ["r_node", "r_n"]).select("node", "n", "size", (F.col("stays.node").eqNullSafe(F.col("node")) & F.col("stays.n").eqNullSafe(F.col("n"))).alias("stays"), F.col("first.doc_id").alias("keep_id"), F.col("first.copies").alias("copies"))
    judged = shelf.put("judged", judged.select("node", "n", "size", F.struct("stays", "keep_id", "copies").alias("judged")))
    n_judged, n_repeated = judged.agg(F.count("*"), F.count_if(F.col("judged.stays") & (F.col("judged.copies") > 1))).first()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(0)
            texts = pa.RecordBatch.from_arrays([row.field("doc_id"), row.field("text")], names=["doc_id", "text"])
            found = [(set_id(s), len(s)) for _, s, _ in shingle_sets(texts, size)]
            node, n = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([row, pa.array(node, pa.int64()), pa.array(n, pa.int32())], names=["d", "node", "n"])

    placed = docs.select(F.struct(*docs.columns).alias("d"))  # apart from whatever the columns are called
    placed = placed.mapInArrow(run, StructType([*placed.schema.fields, StructField("node", LongType()), StructField("n", IntegerType())]))
    if n_judged <= BROADCAST_IDS:
        placed = placed.join(F.broadcast(judged.drop("size")), ["node", "n"], "left")
    else:
        placed = lookup(placed, judged, ["node", "n"], "size", members.count())
    first = F.col("judged.stays") & F.col("d.doc_id").eqNullSafe(F.col("judged.keep_id"))
    kept = placed.where(F.col("judged").isNull() | first & (F.col("judged.copies") == 1)).select("d.*")
    if not n_repeated:
        return kept
    one = placed.where(first & (F.col("judged.copies") > 1)).groupBy("node", "n").agg(F.min_by("d", F.col("d.text")).alias("d"))
    return kept.unionByName(one.select("d.*"))


def query(spark, sf_dir: str) -> DataFrame:
    return similar_components(documents(spark, sf_dir))


ORACLE = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
places AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM w WHERE len(ws) > 0),
shingles AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS shingle FROM places),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
sized AS (SELECT doc_id, shingle, n FROM shingles JOIN sizes USING (doc_id)),
shared AS (
    SELECT a.doc_id AS one, b.doc_id AS other, a.n + b.n AS both_n, count(*) AS k
    FROM sized a JOIN sized b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n
    GROUP BY ALL
),
links AS (SELECT one, other FROM shared WHERE 100 * k >= 90 * (both_n - k)),
reached AS (SELECT doc_id, doc_id AS other FROM w UNION SELECT r.doc_id, l.other FROM reached r JOIN links l ON r.other = l.one)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(r.other) AS component_id
FROM w LEFT JOIN sizes USING (doc_id) JOIN reached r ON w.doc_id = r.doc_id GROUP BY w.doc_id, n
"""
