"""Counters, ratios, examples and reports, long-form for queries and as one row for sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quillmill.functions import rules as R
from quillmill.functions import text as T
from quillmill.operators import dedup as D


def counted(df: DataFrame, by: str) -> DataFrame:
    """A1, A2, A10: by, n."""
    return df.groupBy(by).agg(F.count("*").alias("n"))


def label_histogram(df: DataFrame, hits: str = "hits", pos: str = "pos") -> DataFrame:
    """A5: label, n, first_pos, in the order of falling counts, ties by first seen."""
    each = df.select(F.col(pos).alias("p"), F.posexplode(hits).alias("k", "label"))
    # place and rank within the row as one number, which hash aggregation can hold
    first = F.min(F.col("p").cast("decimal(20,0)") * 1024 + F.col("k"))
    sums = each.groupBy("label").agg(F.count("*").alias("n"), F.min("p").alias("first_pos"), first.alias("first"))
    return sums.orderBy(F.desc("n"), "first").select("label", "n", "first_pos")


def ratio(df: DataFrame, flag: Column, name: str = "ratio") -> DataFrame:
    """Total, hits and their unrounded ratio, 0.0 without rows."""
    sums = df.agg(F.count("*").alias("total"), F.coalesce(F.sum(flag.cast("bigint")), F.lit(0)).alias("hits"))
    return sums.withColumn(name, F.coalesce(F.try_divide("hits", "total"), F.lit(0.0)))


def named_audit(rows: DataFrame) -> DataFrame:
    """Adds hits of the named rules to rows with output."""
    return rows.withColumn("hits", T.named_residue(F.coalesce("output", F.lit(""))))


def told_while(audited: DataFrame, hits: str = "hits", pos: str = "pos") -> tuple[DataFrame, Callable[[], dict]]:
    """The rows, and A5 to A7 of them once an action has read them all: total, hits and the histogram by named rule.

    Spark adds the counts up beside whatever the action does, so a report's counts
    and its examples take one scan.
    """
    names = [name for name, _, _ in R.NAMED_RULES]
    seen = Observation()
    each = [x for k, name in enumerate(names) for x in (
        F.count_if(F.array_contains(hits, name)).alias(f"n{k}"),
        F.min(F.when(F.array_contains(hits, name), F.col(pos).cast("decimal(20,0)") * 1024 + F.array_position(hits, name))).alias(f"first{k}"),
    )]

    def told() -> dict:
        got = seen.get
        found = [(-got[f"n{k}"], got[f"first{k}"], name) for k, name in enumerate(names) if got[f"n{k}"]]
        return {"total": got["total"], "hits": got["hits"], "histogram": {name: -n for n, _, name in sorted(found)}}

    return audited.observe(seen, F.count(F.lit(1)).alias("total"), F.count_if(F.size(hits) > 0).alias("hits"), *each), told


def strict_audit(rows: DataFrame) -> DataFrame:
    """Adds hits of the spot check's nine rules (R2)."""
    return rows.withColumn("hits", T.strict_residue(F.col("output"), class_rule=False, keywords=False))


def examples(audited: DataFrame, limit: int, preview: int, pos: str = "pos") -> DataFrame:
    """The first rows with hits, by pos, with previews."""
    own = [F.substring("input", 1, 300).alias("input")] if "input" in audited.columns else []
    return audited.where(F.size("hits") > 0).orderBy(pos).limit(limit).select(pos, "hits", *own, F.substring("output", 1, preview).alias("output_preview"))


def first_example(rows: DataFrame) -> DataFrame:
    """The first row as a struct, null without rows."""
    return rows.agg(F.min_by(F.struct("instruction", "input", "output"), "pos").alias("output_example"))


SCALARS = ("raw_count", "valid_count_before_dedup", "valid_count_after_dedup", "duplicate_removed", "samples_with_code_after_dedup")


def build_report(parsed: DataFrame) -> DataFrame:
    """A3, A4 long form: section, name, n; scalars without rows are 0.

    One pass over the parsed rows: they are reduced to one small row for each
    reason and for each key's best sample, which then add to their counters.
    """
    slim = parsed.select("reason", "style", "turns", "has_code", F.when(F.col("reason").isNull(), D.key_hash(F.col("input"))).alias("h"), D.rank(F.col("quality_score"), F.col("pos")).alias("r"))
    told = F.struct("style", "turns", "has_code")
    each = slim.groupBy("reason", "h").agg(F.count("*").alias("n"), F.min_by(told, "r").alias("best"))
    add = lambda section, name, n: F.struct(F.lit(section).alias("section"), name.cast("string").alias("name"), n.cast("bigint").alias("n"))
    one, n = F.lit(1), F.col("n")
    kept = (n, n, one, n - 1, F.col("best.has_code").cast("int"))
    of_key = F.array(*(add("scalar", F.lit(s), v) for s, v in zip(SCALARS, kept, strict=True)), add("style_count_after_dedup", F.col("best.style"), one), add("turns_count_after_dedup", F.col("best.turns"), one))
    of_reason = F.array(add("scalar", F.lit("raw_count"), n), add("skipped_reasons", F.col("reason"), n))
    counters = each.select(F.inline(F.when(F.col("reason").isNull(), of_key).otherwise(of_reason)))
    zeros = parsed.sparkSession.range(1).select(F.inline(F.array(*(add("scalar", F.lit(s), F.lit(0)) for s in SCALARS))))
    return counters.unionByName(zeros).groupBy("section", "name").agg(F.sum("n").alias("n"))


def as_map(long: DataFrame, key: str, value: str) -> dict:
    """A counter's rows as a dict for a report; keys are reasons, styles or rule names, so few."""
    return {r[0]: r[1] for r in long.select(key, value).collect()}
