"""What filters remove in every order in which they can be applied, and each one's Shapley share."""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sealane.llm.common import WS, documents, labels, text_or_empty

FILTERS = "ABCDE"
BIT = {name: 1 << k for k, name in enumerate(FILTERS)}
ALL = (1 << len(FILTERS)) - 1
#: What is counted of each coalition: all documents, those of quality 1 and those that are toxic.
MEASURES = ["lost", "good", "toxic"]


def own_failures(text: Column) -> Column:
    """Bits of the filters that look at one text alone: too few words, too few different ones, capitals, signs."""
    words = F.array_remove(F.split(text, WS), "")
    n, different = F.size(words), F.size(F.array_distinct(words))
    fails = {
        "A": n < 200,
        "B": 100 * different.cast("long") < 50 * n.cast("long"),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") > 2 * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }
    return sum((F.when(fails[name], BIT[name]).otherwise(0) for name in fails), F.lit(0))


def judged(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): how many documents of a part fail exactly the filters of ``mask``.

    Texts are read once.  What a text fails by itself is the same for all its copies, so copies are
    counted together by SHA-256 and length: of a text's rows those with its smallest doc_id pass E.
    Before anything is sent by text, each task adds up the copies that it holds.
    """
    text = F.col("d.text")
    rows = docs.select(F.struct("doc_id", text_or_empty().alias("text"), F.coalesce("source", F.lit("")).alias("part")).alias("d"))
    rows = rows.select("d.doc_id", "d.part", own_failures(text).alias("mask"), F.unhex(F.sha2(text, 256)).alias("sha"), F.octet_length(text).alias("n_bytes"))
    # Null ids match no label; they are dealt out by a number of their own and not all to one task.
    rows = rows.withColumns({"nameless": F.col("doc_id").isNull(), "key": F.coalesce("doc_id", F.xxhash64(F.monotonically_increasing_id()))})
    known = marks.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("key"), F.lit(False).alias("nameless"))
    known = known.agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    marked = rows.join(known, ["key", "nameless"], "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})

    kind = ["sha", "n_bytes", "part", "mask", "good", "toxic"]
    per_id = marked.groupBy(*kind, "nameless", "doc_id").agg(F.count("*").alias("n"))
    groups = per_id.groupBy(*kind).agg(F.sum("n").alias("n"), F.min(F.struct("nameless", "doc_id", "n")).alias("first"))
    least = F.min(F.struct("first.nameless", "first.doc_id")).over(W.partitionBy("sha", "n_bytes"))
    groups = groups.withColumn("passing", F.when(least.eqNullSafe(F.struct("first.nameless", "first.doc_id")), F.col("first.n")).otherwise(0))
    both = F.array(F.struct(F.col("mask"), F.col("passing").alias("n")), F.struct((F.col("mask") + BIT["E"]).alias("mask"), (F.col("n") - F.col("passing")).alias("n")))
    return groups.select("part", "good", "toxic", F.inline(both)).groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def removal_games(counts: DataFrame) -> DataFrame:
    """(part, total, lost, good, toxic): for each part and measure its 32 coalitions' values, in an array by coalition.

    The value of a coalition of filters is the number of documents that fail one of them at least.
    """
    every = counts.withColumn("coalition", F.explode(F.sequence(F.lit(0), F.lit(ALL))))
    hit = F.when(F.col("mask").bitwiseAND(F.col("coalition")) != 0, F.col("n")).otherwise(0)
    sums = every.groupBy("part", "coalition").agg(F.sum("n").alias("total"), F.sum(hit).alias("lost"), F.sum(F.when(F.col("good"), hit).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), hit).otherwise(0)).alias("toxic"))
    games = sums.groupBy("part").agg(F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("coalition", *MEASURES))).alias("games"))
    return games.select("part", "total", *[F.col("games")[name].alias(name) for name in MEASURES])


def potentials(values: Column) -> Column:
    """Hart and Mas-Colell's potential of each coalition, times the factorial of its size, which makes it whole.

    A coalition's potential is its value and the potentials of the coalitions without one of its
    members, divided by its size s.  Times s! that is (s - 1)! values plus the others' as they stand.
    The numbers of smaller coalitions come first, so one walk over the 32 has what it needs.
    """
    sizes = F.lit([factorial(max(0, k.bit_count() - 1)) for k in range(ALL + 1)]).cast("array<bigint>")

    def step(known: Column, k: Column) -> Column:
        without = sum((F.when(k.bitwiseAND(bit) != 0, F.get(known, k - bit)).otherwise(0) for bit in BIT.values()), F.lit(0).cast("bigint"))
        return F.array_append(known, F.get(sizes, k) * F.get(values, k) + without)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ALL)), F.array(F.lit(0).cast("bigint")), step)


def audit(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of each part, order and step.

    ``shapley`` is the filter's ``removed`` over all orders, from the potentials: the grand
    coalition's minus that of all others.  A step's counts are differences of two coalitions.
    Null texts are empty (they fail A only, and E where another empty text has a smaller id); null
    sources are the part of the empty string; a null doc_id is larger than any other and has no
    label, and rows of one id never fail E for each other.  Repeated rows count each.  Of several
    labels of one id any 1 counts; null labels are 0.  Columns other than doc_id, text and source
    are not read.  Texts of any length are taken whole.  An empty table has no part, so no rows.
    """
    games = removal_games(judged(docs, marks)).withColumn("potential", potentials(F.col("lost")))
    orders = F.lit(["".join(p) for p in permutations(FILTERS)])
    steps = games.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    at = {name: F.instr("filter_order", name) for name in FILTERS}
    before = sum((F.when(at[name] < F.col("step"), bit).otherwise(0) for name, bit in BIT.items()), F.lit(0))
    own = sum((F.when(at[name] == F.col("step"), bit).otherwise(0) for name, bit in BIT.items()), F.lit(0))
    steps = steps.withColumns({"before": before, "own": own}).withColumn("after", F.col("before") + F.col("own"))
    value = lambda name, coalition: F.get(name, coalition)
    change = lambda name: value(name, F.col("after")) - value(name, F.col("before"))
    grand, rest = F.get("potential", F.lit(ALL)), F.get("potential", ALL - F.col("own"))
    return steps.select(
        "part",
        "filter_order",
        "step",
        (F.col("total") - value("lost", F.col("after"))).alias("kept"),
        change("lost").alias("removed"),
        (value("lost", F.col("own")) - change("lost")).alias("redundant"),
        (value("lost", F.lit(ALL)) - value("lost", ALL - F.col("own"))).alias("unique_fails"),
        change("good").alias("good_lost"),
        change("toxic").alias("toxic_lost"),
        (grand - len(FILTERS) * rest).alias("shapley"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir), labels(spark, sf_dir))


ORACLE = """
WITH marks AS (SELECT doc_id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
t AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
judged AS (
    SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [
        len(ws) < 200,
        100 * len(list_distinct(ws)) < 50 * len(ws),
        100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 2 * length(text),
        regexp_matches(text, '[#$%&*|]'),
        coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY text), min(t.doc_id) OVER (PARTITION BY text) IS NOT NULL)
    ] AS fails
    FROM t LEFT JOIN marks ON t.doc_id = marks.doc_id
),
counts AS (SELECT part, good, toxic, fails, count(*) AS n FROM judged GROUP BY ALL),
letters AS (SELECT unnest(range(1, 6)) AS k),
orders AS (
    SELECT [a.k, b.k, c.k, d.k, e.k] AS ks FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5
),
steps AS (SELECT ks, unnest(range(1, 6)) AS step FROM orders),
gone AS (
    SELECT part, ks, step, n, good, toxic, fails[ks[step]] AS here, len(list_filter(ks[1:step - 1], lambda k: fails[k])) > 0 AS earlier,
           len(list_filter(fails, lambda f: f)) AS n_fails
    FROM counts, steps
),
summed AS (
    SELECT part, ks, step, sum(n) FILTER (NOT here AND NOT earlier) AS kept, sum(n) FILTER (here AND NOT earlier) AS removed,
           sum(n) FILTER (here AND earlier) AS redundant, sum(n) FILTER (here AND n_fails = 1) AS unique_fails,
           sum(n) FILTER (here AND NOT earlier AND good) AS good_lost, sum(n) FILTER (here AND NOT earlier AND toxic) AS toxic_lost
    FROM gone GROUP BY ALL
)
SELECT part, array_to_string(list_transform(ks, lambda k: chr((64 + k)::INTEGER)), '') AS filter_order, step::INTEGER AS step,
       coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
       coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       sum(coalesce(removed, 0)) OVER (PARTITION BY part, ks[step])::BIGINT AS shapley
FROM summed
"""
