"""Numbers of rows in a total order, without one task that sorts them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

#: Rows that one task sorts, about, and rows looked at for each cut between tasks.
ROWS_A_PART, SEEN_A_CUT = 1_000_000, 32


def numbered(rows: DataFrame, keys: dict[str, Column], name: str, first: int = 1, rows_a_part: int = ROWS_A_PART) -> DataFrame:
    """``rows`` with their number, from ``first`` on, in ascending order of ``keys`` (nulls first).

    Rows are dealt out by ranges of the whole key, as many as tasks can take.  The cuts are keys of
    rows chosen by a hash, so they are the same each time, and a row's range is found among them by
    halving; how many rows stand in each range is one count, and a range's numbers begin after those
    of the ranges before it.  Rows with equal keys stand in one range, in
    any order.  ``rows`` are read four times, so they should be at rest.
    """
    keyed = rows.select(F.struct(*rows.columns).alias("_row"), F.struct(*[c.alias(k) for k, c in keys.items()]).alias("_key"))
    n = keyed.count()
    # Ranges beyond the number of tasks would only share tasks with others, so they make no sort smaller.
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_parts = min(-(-n // rows_a_part), max(tasks, -(-n // ROWS_A_PART)))
    cuts: list = []
    if n_parts > 1:
        every = max(1, n // (SEEN_A_CUT * n_parts))
        seen = keyed.where(F.pmod(F.xxhash64("_key"), F.lit(every)) == 0).groupBy("_key").agg(F.count("*").alias("k"))
        # One of the chosen keys in so many, whatever their number: at most about SEEN_A_CUT rows a part come to the driver.
        chosen = seen.orderBy("_key").limit(4 * SEEN_A_CUT * n_parts).collect()
        cuts = [chosen[k * len(chosen) // n_parts]["_key"] for k in range(1, n_parts)] if chosen else []
    part = F.lit(0)
    if cuts:
        kinds = {f.name: f.dataType for f in keyed.schema["_key"].dataType}
        at = [F.struct(*[F.lit(c[k]).cast(kind).alias(k) for k, kind in kinds.items()]) for c in dict.fromkeys(cuts)]
        part = _not_above(F.array(*at).cast(ArrayType(keyed.schema["_key"].dataType)), len(at), F.col("_key"))
    keyed = keyed.select("_row", "_key", part.alias("_part"))
    sizes = {r["_part"]: r["n"] for r in keyed.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    before, at = [], first
    for p in range(len(cuts) + 1):
        before.append(at)
        at += sizes.get(p, 0)
    start = F.get(F.array(*[F.lit(x).cast("long") for x in before]), F.col("_part"))
    number = F.row_number().over(W.partitionBy("_part").orderBy("_key")) + start - 1
    return keyed.withColumn("_n", number.cast("long")).select("_row.*", F.col("_n").alias(name))


def _not_above(cuts: Column, n: int, key: Column) -> Column:
    """How many of ``n`` cuts, given in ascending order, are not above ``key``: as many looks as ``n`` has binary digits."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))])
    find = lambda key: F.aggregate(steps, F.lit(0), lambda low, step: F.when(F.get(cuts, low + step - 1) <= key, low + step).otherwise(low))
    return F.get(F.transform(F.array(key), find), F.lit(0))  # a variable, as the key would otherwise be made anew at each look
