"""Deterministic dedup: keep-best by question, keep-first by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions import text as T


def key_hash(question: Column) -> Column:
    """A question's key as 16 bytes, so long keys are neither sorted nor sent."""
    return F.unhex(F.md5(T.question_key(question)))


def rank(score: Column, pos: Column) -> Column:
    """One number that is least for the highest score and then the earliest place; hash aggregation can hold it."""
    return (-score).cast("decimal(10,0)") * F.lit(str(1 << 63)).cast("decimal(19,0)") + pos.cast("decimal(19,0)")


def keep_best(samples: DataFrame, key: Column | None = None, score: str = "quality_score", pos: str = "pos") -> DataFrame:
    """Of each key the row with the highest score, the earliest of equals; ``first_pos`` is the key's first place.

    One shuffle under the key's hash, combined on the map side: a hot key
    arrives as one row for each task. Keys are made once; looking the winners up
    afterwards would make them twice and send as many rows.
    """
    key = T.question_key(F.col("input")) if key is None else key
    rows = samples.withColumn("dedup_key", key)
    best = rows.groupBy(F.unhex(F.md5("dedup_key")).alias("__h")).agg(F.min_by(F.struct(*rows.columns), rank(F.col(score), F.col(pos))).alias("row"), F.min(pos).alias("first_pos"))
    return best.select("row.*", "first_pos")


def keep_first(rows: DataFrame, question: str = "input", output: str = "output", pos: str = "pos") -> DataFrame:
    """The first row of each normalized (question, output), combined on the map side under the texts' hash."""
    key = F.concat_ws("\x00", T.dedup_text(F.col(question)), T.dedup_text(F.col(output)))
    # a column of its own, as calls that count as not deterministic can't be grouped by directly
    first = rows.withColumn("__h", F.unhex(F.sha2(key, 256))).groupBy("__h").agg(F.min_by(F.struct(*rows.columns), pos).alias("row"))
    return first.select("row.*")
