"""Exact shares and model comparison against plain Python."""

from __future__ import annotations

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from quillmill.operators import comparison, hooks, selection


def plain_holdout(rows, fraction, seed=42):
    groups = {}
    for pos, by in rows:
        groups.setdefault(by, []).append((int(hashlib.md5(f"{seed}:{pos}".encode()).hexdigest()[:15], 16), pos))
    return {pos for own in groups.values() for _, pos in sorted(own)[: round(fraction * len(own))]}


@pytest.mark.parametrize("few", [20, 1000])
def test_holdout_is_exact(spark, monkeypatch, few):
    """Refined by histograms alone, by some, or sorted at once: always the same rows."""
    monkeypatch.setattr(selection, "FEW", few)
    rng = random.Random(1)
    rows = [(k * 7 - 100, rng.choice(["a", "b", "b", "b", None])) for k in range(1200)] + [(10**12, "single"), (10**12 + 1, "pair"), (10**12 + 2, "pair")]
    df = spark.createDataFrame(rows, "pos long, style string").repartition(5)
    for fraction in (0.05, 0.0, 1.0):
        got = selection.holdout(df, fraction, "style").collect()
        assert len(got) == len(rows) and {r["pos"] for r in got if r["held"]} == plain_holdout(rows, fraction)
    assert selection.holdout(df.where("false"), 0.05, "style").count() == 0
    assert selection.holdout(df, 0.05).where("held").count() == round(0.05 * len(rows))


def test_first_rows_and_ties(spark, monkeypatch):
    monkeypatch.setattr(selection, "FEW", 2)
    rng = random.Random(2)
    values = list({rng.randint(-(1 << 62), (1 << 62) - 1) for _ in range(300)})
    df = spark.createDataFrame([(v,) for v in values], "pos long")
    for n in (0, 17, 400):
        assert sorted(r["pos"] for r in selection.first_rows(df, n).collect()) == sorted(values)[:n]
    same = spark.range(50).selectExpr("0 AS by", "cast(5 AS bigint) AS key", "id AS tie")
    held = selection.among_least(same, lambda n: 20, by="by", key="key", tie="tie").where("held")
    assert sorted(r["tie"] for r in held.collect()) == list(range(20))


def test_the_split_takes_its_share_of_the_first_rows(spark):
    df = spark.range(1000).selectExpr("id AS pos", "cast(id % 3 AS string) AS style", "'x' AS text").repartition(4)
    train, held = hooks.training_split(df, 400, 0.05, by="style")
    assert train.columns == df.columns and train.count() == 379
    assert {r["style"]: r["count"] for r in held.groupBy("style").count().collect()} == {"0": 7, "1": 7, "2": 7}
    assert held.agg(F.max("pos")).first()[0] < 400 and train.intersect(held).count() == 0


@pytest.mark.parametrize(("b", "c"), [(0, 0), (0, 1), (5, 5), (3, 12), (40, 20), (0, 30), (2000, 2200)])
def test_tail(spark, b, c):
    m, k = b + c, min(b, c)
    wanted = min(1.0, 2 * sum(math.comb(m, i) for i in range(k + 1)) / 2**m) if m else 1.0
    got = spark.range(1).select(comparison.tail(F.lit(b).cast("bigint"), F.lit(c).cast("bigint")).alias("p")).first()["p"]
    assert got == pytest.approx(wanted, rel=1e-9)


def test_table_and_interval(spark):
    rng = random.Random(3)
    first = [(k, rng.random() < 0.5) for k in range(400)]
    second = [(k, x if rng.random() < 0.6 else rng.random() < 0.9) for k, x in first[50:]] + [(1000, True), (1001, None)]
    a, b = (spark.createDataFrame(x, "idx long, correct boolean") for x in (first, second))
    pairs = comparison.paired(a, b)
    other = dict(second)
    both = [(x, other[k]) for k, x in first if k in other]
    row = comparison.compared(pairs).first()
    count = lambda x, y: sum(p == (x, y) for p in both)
    assert (row["total"], row["both_right"], row["only_first"], row["only_second"], row["both_wrong"]) == (350, count(True, True), count(True, False), count(False, True), count(False, False))
    # the interval from the same weights, item by item
    replicates = 50
    weights = {(r["idx"], r["r"]): r["w"] for r in pairs.select("idx", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("r")).withColumn("w", comparison.weight(F.col("idx"), F.col("r"), 42)).collect()}
    d = {k: int(other[k]) - int(x) for k, x in first if k in other}
    values = sorted(sum(weights[k, r] * v for k, v in d.items()) / sum(weights[k, r] for k in d) for r in range(replicates))
    between = lambda q: values[int(q * 49)] + (values[min(int(q * 49) + 1, 49)] - values[int(q * 49)]) * (q * 49 - int(q * 49))
    got = comparison.interval(pairs, replicates).first()
    assert got["difference"] == pytest.approx(sum(d.values()) / len(d))
    assert (got["low"], got["high"]) == (pytest.approx(between(0.025)), pytest.approx(between(0.975)))
    assert got["low"] < got["difference"] < got["high"]
    assert [comparison.interval(pairs.repartition(n), replicates).first() == got for n in (1, 7)] == [True, True]
    mean = sum(weights.values()) / len(weights)
    assert abs(mean - 1) < 0.05 and abs(sum((w - mean) ** 2 for w in weights.values()) / len(weights) - 1) < 0.06
    none = comparison.paired(a.where("false"), b)
    assert comparison.interval(none).first()["low"] is None and comparison.compared(none).first()["p_value"] == 1.0
