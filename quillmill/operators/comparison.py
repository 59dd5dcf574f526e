"""Two models on the same items: the paired table, its exact tail, and an interval by resampling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions.dialect import let

REPLICATES, LEVEL = 200, 0.95
#: Steps of the distribution function of a Poisson count with mean 1, as far as 53 bits tell.
STEPS = tuple(math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1)) for k in range(18))


def paired(first: DataFrame, second: DataFrame) -> DataFrame:
    """idx, a, b: whether either model is right, of items that both answered; from idx, correct of each."""
    told = lambda df, name: df.select("idx", F.coalesce("correct", F.lit(False)).alias(name))
    return told(first, "a").join(told(second, "b"), "idx")


def tail(fewer: Column, more: Column) -> Column:
    """McNemar's exact two-sided probability of discordant counts, summed in logs; 1 where nothing differs."""
    m, k = fewer + more, F.least(fewer, more)
    start = (-m * math.log(2)).cast("double")
    zero = F.struct(start.alias("term"), start.alias("total"))

    def step(s: Column, i: Column) -> Column:
        term = s["term"] + F.ln((m - i + 1).cast("double")) - F.ln(i.cast("double"))
        high, low = F.greatest(s["total"], term), F.least(s["total"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("total"))

    summed = let(F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("bigint"), k)).otherwise(F.array().cast("array<bigint>")), zero, step), lambda s: s["total"])
    return F.when(m == 0, 1.0).otherwise(F.least(F.lit(1.0), F.exp(summed + math.log(2))))


def compared(pairs: DataFrame) -> DataFrame:
    """One row: total, both_right, only_first, only_second, both_wrong, accuracies (0 without rows) and p_value."""
    n = lambda c: F.count_if(c)
    a, b = F.col("a"), F.col("b")
    sums = pairs.agg(F.count("*").alias("total"), n(a & b).alias("both_right"), n(a & ~b).alias("only_first"), n(~a & b).alias("only_second"), n(~a & ~b).alias("both_wrong"))
    rate = lambda c: F.coalesce(F.try_divide(F.col("both_right") + F.col(c), F.col("total")), F.lit(0.0))
    return sums.withColumns({"accuracy_first": rate("only_first"), "accuracy_second": rate("only_second"), "p_value": tail(F.col("only_first"), F.col("only_second"))})


def weight(idx: Column, replicate: Column, seed: int) -> Column:
    """How often a replicate draws an item: a Poisson count with mean 1, the same in every run."""
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), idx, replicate), 11).cast("double") / float(1 << 53)
    return let(u, lambda x: sum((F.when(x >= s, 1).otherwise(0) for s in STEPS), F.lit(0)))


def interval(pairs: DataFrame, replicates: int = REPLICATES, level: float = LEVEL, seed: int = 42) -> DataFrame:
    """One row: difference of accuracies (second less first), low and high; null without rows.

    One pass: each item adds its weight to every replicate, combined before the
    shuffle, so ``replicates`` rows leave each task.
    """
    diff = F.col("b").cast("int") - F.col("a").cast("int")
    each = pairs.select(diff.alias("d"), "idx", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("r")).withColumn("w", weight(F.col("idx"), F.col("r"), seed))
    by = each.groupBy("r").agg(F.try_divide(F.sum(F.col("w") * F.col("d")), F.sum("w")).alias("value"), F.count("*").alias("n"), F.sum("d").alias("d"))
    row = by.agg(F.sort_array(F.collect_list("value")).alias("v"), F.max("n").alias("n"), F.max("d").alias("d"))

    def at(q: float) -> Column:
        """Between the two nearest of the sorted values."""
        place = (F.size("v") - 1) * q
        low = F.floor(place).cast("int")
        one, two = F.get("v", low), F.coalesce(F.get("v", low + 1), F.get("v", low))
        return one + (two - one) * (place - low)

    return row.select(F.try_divide("d", "n").alias("difference"), at((1 - level) / 2).alias("low"), at((1 + level) / 2).alias("high"))
