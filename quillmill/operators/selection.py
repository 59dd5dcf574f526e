"""Exact shares of rows without a global sort: the k-th least key by refined histograms.

Each round counts the keys of the range that is still open in ``BUCKETS`` parts, a
map-side combined count by stratum, and goes on with the part that the k-th falls
into; ranges shrink ``BUCKETS``-fold, so a few rounds do. A driver holds no more than
``BUCKETS`` counts for each stratum, of which there are at most ``STRATA``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS, FEW, STRATA = 256, 1000, 1000


def keyed_hash(seed: int, pos: str = "pos") -> Column:
    """60 bits of the MD5 of ``seed:pos``, so that reruns agree."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(pos).cast("string"))), 1, 15), 16, 10).cast("bigint")


def thresholds(rows: DataFrame, quota: Callable[[int], int], *, by: str, key: str, tie: str | None) -> dict:
    """Stratum to the (key, tie) of the last of its ``quota(rows)`` least rows; None where that is no row. Rows with the same key and tie go together."""
    spark = rows.sparkSession
    slim = rows.select(F.col(by).alias("by"), F.col(key).alias("key"), F.col(tie or key).alias("tie"))
    found = slim.groupBy("by").agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).limit(STRATA + 1).collect()
    if len(found) > STRATA:
        raise ValueError(f"more than {STRATA} strata")
    out, open_ = {r["by"]: None for r in found}, {r["by"]: (r["lo"], r["hi"], quota(r["n"]), r["n"]) for r in found if quota(r["n"]) > 0}
    while open_:
        last = {s: x for s, x in open_.items() if x[3] <= FEW or x[0] == x[1]}
        wide = {s: x for s, x in open_.items() if s not in last}
        kind = "by {}, lo long, hi long, width long".format(rows.schema[by].dataType.simpleString())
        state = spark.createDataFrame([(s, lo, hi, (hi - lo) // BUCKETS + 1) for s, (lo, hi, _, _) in open_.items()], kind)
        inside = slim.join(F.broadcast(state.withColumnRenamed("by", "s")), F.col("by").eqNullSafe(F.col("s"))).where("key BETWEEN lo AND hi")
        for s, (lo, hi, need, n) in last.items():
            own = inside.where(F.col("by").eqNullSafe(F.lit(s)))
            if tie is None and lo == hi:
                out[s] = (lo, lo)
            elif n <= FEW:
                out[s] = tuple(own.select("key", "tie").orderBy("key", "tie").limit(need).collect()[-1])
            else:  # one key with many rows: on by the tie
                out[s] = (lo, thresholds(own.select("by", "tie"), lambda _, need=need: need, by="by", key="tie", tie=None)[s][0])
        counts = inside.groupBy("by", F.expr("(key - lo) DIV width").alias("at")).count().collect() if wide else []
        open_ = {}
        for s, (lo, hi, need, _) in wide.items():
            width, before = (hi - lo) // BUCKETS + 1, 0
            for at, n in sorted((r["at"], r["count"]) for r in counts if r["by"] == s):
                if before + n >= need:
                    open_[s] = (lo + at * width, min(lo + (at + 1) * width - 1, hi), need - before, n)
                    break
                before += n
    return out


def among_least(rows: DataFrame, quota: Callable[[int], int], *, by: str, key: str, tie: str) -> DataFrame:
    """Adds ``held``: whether the row is among the ``quota(rows)`` least of its stratum."""
    found = thresholds(rows, quota, by=by, key=key, tie=tie)
    told = [(s, x is not None, *(x or (0, 0))) for s, x in found.items()]
    state = rows.sparkSession.createDataFrame(told, f"s {rows.schema[by].dataType.simpleString()}, some boolean, t_key long, t_tie long")
    within = F.struct(F.col(key), F.col(tie)) <= F.struct("t_key", "t_tie")
    return rows.join(F.broadcast(state), F.col(by).eqNullSafe(F.col("s"))).select(*rows.columns, (F.col("some") & within).alias("held"))


def share(fraction: float) -> Callable[[int], int]:
    return lambda n: round(fraction * n)


def holdout(rows: DataFrame, fraction: float = 0.05, by: str | None = None, seed: int = 42, pos: str = "pos") -> DataFrame:
    """Adds ``held``: exactly round(fraction * n) rows of each value of ``by`` (of all rows without), those with the least keyed hashes."""
    keyed = rows.withColumns({"__key": keyed_hash(seed, pos), "__by": F.lit(0) if by is None else F.col(by)})
    return among_least(keyed, share(fraction), by="__by", key="__key", tie=pos).select(*rows.columns, "held")


def first_rows(rows: DataFrame, n: int, pos: str = "pos") -> DataFrame:
    """The ``n`` rows of the least ``pos``, which is a number of each row's own."""
    keyed = rows.withColumn("__by", F.lit(0))
    return among_least(keyed, lambda total: min(n, total), by="__by", key=pos, tie=pos).where("held").select(*rows.columns)
