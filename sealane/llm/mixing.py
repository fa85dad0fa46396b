"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sealane.llm.common import WORD, documents, durable, text_or_empty

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_COPIES = 2.0
#: Documents or residuals that one fold of the reduction tree takes, on average.
LEAF = 32
#: Source tables beyond so many rows are joined by shuffle rather than broadcast.
BROADCAST_SOURCES = 50_000
SEED = 20260101
#: What tells rows apart: the id, a hash of source and text, and a number for rows that agree in these.
KEY = ["doc_id", "print", "nth"]


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, print, nth, source, size) of each row."""
    size = F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long")
    return numbered(docs.select("doc_id", _print().alias("print"), "source", size.alias("size")))


def _print() -> Column:
    return F.xxhash64(F.col("source").isNull(), "source", F.col("text").isNull(), "text")


def numbered(rows: DataFrame) -> DataFrame:
    """Rows that agree in id, source and text are alike, so any order among them gives the same mix."""
    return rows.withColumn("nth", F.row_number().over(W.partitionBy("doc_id", "print").orderBy(F.lit(0))))


def targets(rows: DataFrame, share: float = SHARE, most: float = MOST_COPIES, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source, src, source_size, n_docs, target) of each source.

    Shares above ``most`` times a source's size are cut and the excess goes to the other sources by
    weight until no share is above: each source gets min(most * size, level * weight).  With the
    sources in order of most * size / weight, the level is the largest of (what is left after
    the caps before) / (the weights from here on) over all positions.
    """
    table = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    table = table.withColumn("src", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("src") % len(weights) + 1).cast("int"))
    table = table.withColumn("weight", weight).withColumn("cap", F.lit(most) * F.col("source_size"))
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), "src")
    before, onward, every = by_ratio.rowsBetween(W.unboundedPreceding, -1), by_ratio.rowsBetween(0, W.unboundedFollowing), W.partitionBy(F.lit(0))
    wanted = F.lit(share) * F.sum("source_size").over(every)
    table = table.withColumn("level", (wanted - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
    table = table.withColumn("target", F.least("cap", F.max("level").over(every) * F.col("weight")))
    return table.select("source", "src", "source_size", "n_docs", "target")


def _with_source(rows: DataFrame, table: DataFrame, on: str) -> DataFrame:
    """Join a checked small table by broadcast, a large one by shuffle (where AQE splits hot keys)."""
    if table.count() <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    same = rows[on].eqNullSafe(table[on])
    return rows.join(table, same, "left").drop(table[on])


def _coin(level: int, a: Column, b: Column) -> Column:
    """Uniform in [0, 1), the same in every run: a hash of the two documents and the round."""
    return (F.pmod(F.xxhash64(F.lit(SEED + level), *[a[k] for k in KEY], *[b[k] for k in KEY]), F.lit(1 << 52)) / F.lit(float(1 << 52))).cast("double")


def _step(level: int):
    """Fold a fractional document b into the state (carried document a, if any; settled ones)."""

    def fold(state: Column, b: Column) -> Column:
        a = state["carry"]
        a_words, b_words = a["x"] * a["size"], b["x"] * b["size"]
        a_room, b_room = (1 - a["x"]) * a["size"], (1 - b["x"]) * b["size"]
        up, down = F.least(a_room, b_words), F.least(a_words, b_room)  # words that can go from b to a, and back
        to_a = _coin(level, a, b) * (up + down) < down
        # to_a: a becomes whole if its room is the smaller, else b becomes empty; else the reverse.
        a_settles = F.when(to_a, a_room <= b_words).otherwise(a_words <= b_room)
        b_settles = F.when(to_a, b_words <= a_room).otherwise(b_room <= a_words)
        new_a = F.when(to_a, a["x"] + up / a["size"]).otherwise(a["x"] - down / a["size"])
        new_b = F.when(to_a, b["x"] - up / b["size"]).otherwise(b["x"] + down / b["size"])
        settled = lambda d, gets: F.struct(*[d[k].alias(k) for k in KEY], d["size"].alias("size"), (d["base"] + gets.cast("int")).alias("copies"))
        item = lambda d, x: F.struct(d["mix"].alias("mix"), *[d[k].alias(k) for k in KEY], d["size"].alias("size"), d["base"].alias("base"), x.alias("x"))
        none = F.lit(None).cast(ITEM)
        out = F.concat(state["done"], F.when(a_settles, F.array(settled(a, to_a))).otherwise(F.array().cast(f"array<{DONE}>")), F.when(b_settles, F.array(settled(b, ~to_a))).otherwise(F.array().cast(f"array<{DONE}>")))
        carry = F.when(a_settles & b_settles, none).when(a_settles, item(b, new_b)).otherwise(item(a, new_a))
        return F.when(a.isNull(), F.struct(item(b, b["x"]).alias("carry"), state["done"].alias("done"))).otherwise(F.struct(carry.alias("carry"), out.alias("done")))

    return fold


ITEM = "struct<mix:bigint,doc_id:bigint,print:bigint,nth:int,size:bigint,base:int,x:double>"
DONE = "struct<doc_id:bigint,print:bigint,nth:int,size:bigint,copies:int>"


def pivotal_copies(rows: DataFrame, table: DataFrame) -> DataFrame:
    """(doc_id, print, nth, src, size, copies) with whole copies, whose words sum to each source's target.

    Every document starts with target / source_size expected copies.  Two fractional documents
    of a source pass words between them, in a random direction whose odds keep both expectations,
    until one of them is integral; the sum of words does not change.  A leaf of the tree folds
    about LEAF documents that a hash puts together, so a hot source is many leaves; each leaf hands
    at most one fractional document to the next round, which folds LEAF residuals.  The one
    document that is left at a source's root is rounded to the nearest number of copies.
    """
    ratio = F.least(F.lit(MOST_COPIES), F.coalesce(F.col("target") / F.col("source_size"), F.lit(0.0)))
    rows = _with_source(rows, table, "source").withColumn("ratio", ratio)
    rows = rows.withColumn("base", F.floor(F.col("ratio") + 1e-12).cast("int"))
    rows = rows.withColumn("x", F.when((F.col("size") > 0) & (F.col("ratio") - F.col("base") > 1e-9), F.col("ratio") - F.col("base")).otherwise(F.lit(0.0)))
    mix = F.xxhash64(F.lit(SEED), *KEY)
    node = F.pmod(F.shiftrightunsigned(mix, 7), F.ceil(F.col("n_docs") / LEAF))
    rows = durable(rows.select(*KEY, "src", "size", "base", "x", mix.alias("mix"), node.alias("node"), "n_docs"))
    parts = [rows.where("x = 0").select(*KEY, "src", "size", F.col("base").alias("copies"))]
    items = rows.where("x > 0").select("src", "node", F.struct("mix", *KEY, "size", "base", "x").cast(ITEM).alias("item"))
    widest = -(-(rows.agg(F.max("n_docs")).first()[0] or 0) // LEAF)
    level = 0
    while True:
        start = F.struct(F.lit(None).cast(ITEM).alias("carry"), F.array().cast(f"array<{DONE}>").alias("done"))
        folded = items.groupBy("src", "node").agg(F.array_sort(F.collect_list("item")).alias("items"))
        folded = durable(folded.select("src", "node", F.aggregate("items", start, _step(level)).alias("state")))
        parts.append(folded.select("src", F.explode("state.done").alias("d")).select(*[f"d.{k}" for k in KEY], "src", "d.size", "d.copies"))
        items = folded.where("state.carry IS NOT NULL").select("src", F.floor(F.col("node") / LEAF).alias("node"), F.col("state.carry").alias("item"))
        if widest <= 1:
            break
        widest, level = -(-widest // LEAF), level + 1
    parts.append(items.select(*[f"item.{k}" for k in KEY], "src", "item.size", (F.col("item.base") + F.round("item.x").cast("int")).alias("copies")))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def mix_sources(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken), one row for each row of ``docs``.

    A null text has size 0 and is taken with no words.  A null source is a source of its own and
    comes last.  Rows with one doc_id are separate documents.  A source without words has target 0.
    Only doc_id, source and text are read.  An empty table gives an empty result.
    """
    rows = durable(sizes(docs))
    table = durable(targets(rows))
    whole = pivotal_copies(rows, table)
    totals = table.select("src", "source_size", "target")
    return _with_source(whole, totals, "src").select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), F.col("copies"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with its columns as they are, whatever their names.

    A document without words weighs nothing in the mix and stays as it is.  Rows that repeat one
    another are taken each by its own share.
    """
    rows = durable(sizes(docs))
    whole = pivotal_copies(rows, durable(targets(rows)))
    copies = whole.select(F.struct(*KEY).alias("key"), F.when(F.col("size") == 0, 1).otherwise(F.col("copies")).alias("copies")).where("copies > 0")
    marked = numbered(docs.select(F.struct(*docs.columns).alias("d"), "doc_id", _print().alias("print"))).select("d", F.struct(*KEY).alias("row_key"))
    joined = marked.join(copies, F.col("row_key").eqNullSafe(F.col("key")))
    return joined.select("d", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("d.*")


def query(spark, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir))
