"""Toxicity by a character n-gram linear classifier with naive Bayes scaling.

Features are the n-grams of 3 to 8 characters of the lower-cased text (white-space
runs count as one space, the text stands between spaces), present or not, hashed
to ``BUCKETS``. Each is scaled by its naive Bayes log-count ratio, the log of
its smoothed share of the toxic texts' features over that of the others', and a
logistic regression is fitted to the scaled features.

The fit takes a bounded sample: at most ``PER_CLASS`` labelled texts of each
class, those with the smallest hashes, and ``SAMPLE_BYTES`` of texts, half of them
of either class; a text that would pass that is left out. Rows that repeat an id
and its text train once. Only features present in at
least ``MIN_TEXTS`` of them and with a log-count ratio of ``LEAST_RATIO`` or more
either way count. Every text is scored whole, whatever its
length; a long text's n-grams are gathered in slices. The intercept is set for
the classes' shares among all labelled rows.

Null text counts as empty and, like any text without known features, gets the
score of the intercept. Labels that are null don't train; a doc_id with several
labels trains with each. Without labels of both classes every score is the
toxic share (0 without any labels). Rows that repeat are scored each; rows with a
null doc_id are scored too and are not held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import discard, materialize, table

ORDERS, BUCKETS, BASE = (3, 4, 5, 6, 7, 8), 1 << 20, np.uint64(0x100000001B3)
#: Texts that the fit takes: rows of each class, and bytes of both.
SAMPLE_BYTES = 24 << 20
PER_CLASS, MIN_TEXTS, SMOOTHING, LEAST_RATIO, RIDGE = 3000, 4, 1.0, 0.4, 1e-6
SLICE = 1 << 16


def scratch() -> np.ndarray:
    """Working space of ``features``, to be made once for many texts."""
    return np.zeros(BUCKETS, dtype=np.int32)


def distinct(found: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The distinct buckets: each writes its place, and those whose place stands stay."""
    place = np.arange(len(found), dtype=np.int32)
    last[found] = place
    return found[last[found] == place]


def features(text: str | None, last: np.ndarray) -> np.ndarray:
    """The distinct buckets of the text's n-grams; slices are made distinct as they come,
    so a text of any length holds ``BUCKETS`` and one slice at most."""
    words = " " + " ".join((text or "").lower().split()) + " "
    own = np.frombuffer(words.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    got, top = np.array([], dtype=np.int32), max(ORDERS) - 1
    for at in range(0, len(own), SLICE):
        part = own[at : at + SLICE + top]
        key, found = part, [got]
        for n in range(2, top + 2):
            key = key[:-1] * BASE + part[n - 1 :]
            if n in ORDERS:
                mixed = (key[:SLICE] + np.uint64(n << 56)) * np.uint64(0x9E3779B97F4A7C15)
                found.append((mixed >> np.uint64(44)).astype(np.int32))
        got = distinct(np.concatenate(found), last)
    return got


def log_count_ratio(p, q, n_toxic: float, n_other: float):
    """ln of a feature's smoothed share of the toxic texts over that of the others; columns or numbers."""
    return F.log((p + SMOOTHING) / (n_toxic + 2 * SMOOTHING)) - F.log((q + SMOOTHING) / (n_other + 2 * SMOOTHING))


class Rows:
    """Sparse binary rows: the features of all texts, end to end, and the texts of all features, end to end."""

    def __init__(self, rows: list[np.ndarray], size: int):
        self.n, self.size = len(rows), size
        self.ids = np.concatenate(rows) if rows else np.array([], dtype=np.int32)
        self.full, self.starts = self._runs(np.array([len(r) for r in rows], dtype=np.int64))
        order = np.argsort(self.ids, kind="stable")
        self.rows = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])[order]
        self.present, self.begins = self._runs(np.bincount(self.ids, minlength=size))

    @staticmethod
    def _runs(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which runs have members, and where those begin."""
        full = np.flatnonzero(sizes)
        return full, (np.cumsum(sizes) - sizes)[full]

    def times(self, w: np.ndarray) -> np.ndarray:
        """For each text the sum of its features' values."""
        out = np.zeros(self.n)
        if len(self.full):
            out[self.full] = np.add.reduceat(w[self.ids], self.starts)
        return out

    def gathered(self, v: np.ndarray) -> np.ndarray:
        """For each feature the sum of its texts' values."""
        out = np.zeros(self.size)
        if len(self.present):
            out[self.present] = np.add.reduceat(v[self.rows], self.begins)
        return out


def fit(rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, share: float) -> tuple[np.ndarray, float]:
    """Weight of each feature (its ratio included) and the intercept, by L2-regularized
    logistic regression: Newton steps, each solved by conjugate gradients."""
    m = len(ratios)
    x, y = Rows(rows, m), labels.astype(float)
    scale = ratios / np.sqrt(max(1e-9, float(np.mean(x.times(ratios**2)))))
    w, b, n, start = np.zeros(m), 0.0, len(y), None
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x.times(scale * w) + b, -40, 40)))
        gw, gb = scale * x.gathered((p - y) / n) + RIDGE * w, float((p - y).sum() / n)
        h = np.maximum(p * (1 - p), 1e-6) / n
        dw, db, rw, rb = np.zeros(m), 0.0, -gw, -gb
        sw, sb, rr = rw.copy(), rb, float(rw @ rw + rb * rb)
        first = rr
        start = rr if start is None else start
        if rr <= 1e-8 * start:  # at the top, or without any feature
            break
        for _ in range(20):
            v = h * (x.times(scale * sw) + sb)
            aw, ab = scale * x.gathered(v) + RIDGE * sw, float(v.sum())
            step = rr / max(float(sw @ aw + sb * ab), 1e-30)
            dw, db, rw, rb = dw + step * sw, db + step * sb, rw - step * aw, rb - step * ab
            new = float(rw @ rw + rb * rb)
            if new < 1e-3 * first:
                break
            sw, sb, rr = rw + new / rr * sw, rb + new / rr * sb, new
        w, b = w + dw, b + db
    sampled = float(y.mean())
    return w * scale, b + float(np.log(share / (1 - share)) - np.log(sampled / (1 - sampled)))


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums, last = np.zeros((2, BUCKETS), dtype=np.int64), scratch()
    for pdf in batches:
        for toxic, text in zip(pdf["toxic"], pdf["text"], strict=True):
            sums[int(toxic), features(text, last)] += 1
    seen = np.flatnonzero(sums.any(axis=0))
    yield pd.DataFrame({"bucket": seen, "other": sums[0, seen], "toxic": sums[1, seen]})


def bounded(rows: DataFrame, per_class: int) -> DataFrame:
    """toxic, at of the rows to train with, at most ``per_class`` of a class, in the order of their hash ``at``."""
    sizes = materialize(rows.select("toxic", "at", F.octet_length("text").alias("n")).distinct(), "sizes")
    kept = []
    for k in (0, 1):
        left = SAMPLE_BYTES // 2
        for at, n in sizes.where(F.col("toxic") == k).select("at", "n").orderBy("at").limit(per_class).collect():
            if n <= left or left == SAMPLE_BYTES // 2:
                kept.append((k, at))
                left -= n
    discard(sizes)
    return rows.sparkSession.createDataFrame(kept, "toxic int, at long")


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[np.ndarray, np.ndarray, float]:
    """Buckets, their weights, and the intercept, fitted on the sample.

    The driver gets the informative features of at most 2 * per_class texts.
    """
    known = labels.where("toxic is not null and doc_id is not null").select("doc_id", (F.col("toxic") == 1).cast("int").alias("toxic"))
    counts = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return np.array([], np.int64), np.array([]), 40.0 if counts.get(1) else -40.0
    share = counts[1] / (counts[0] + counts[1])
    sample = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(sample[0].unionByName(sample[1])), "doc_id")
    rows = rows.select("toxic", F.xxhash64("doc_id", "text").alias("at"), "text")
    picked = materialize(rows.join(F.broadcast(bounded(rows, per_class)), ["toxic", "at"]).dropDuplicates(["toxic", "at"]).select("toxic", "text"), "sample")
    sizes = {r[0]: r[1] for r in picked.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return np.array([], np.int64), np.array([]), float(np.log(share / (1 - share)))
    sums = picked.mapInPandas(_counts, "bucket long, other long, toxic long").groupBy("bucket").agg(F.sum("other").alias("q"), F.sum("toxic").alias("p"))
    ratio = log_count_ratio(F.col("p"), F.col("q"), sizes[1], sizes[0])
    told = sums.where(F.col("p") + F.col("q") >= MIN_TEXTS).select("bucket", ratio.alias("r")).where(F.abs("r") >= LEAST_RATIO).orderBy("bucket").toArrow()
    buckets, ratios = told["bucket"].to_numpy(), told["r"].to_numpy()
    place = np.full(BUCKETS, -1, dtype=np.int32)
    place[buckets] = np.arange(len(buckets))
    held = docs.sparkSession.sparkContext.broadcast(place)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = scratch()
        for pdf in batches:
            own = (held.value[features(t, last)] for t in pdf["text"])
            yield pd.DataFrame({"toxic": pdf["toxic"], "own": [p[p >= 0].astype("<i4").tobytes() for p in own]})

    got = picked.mapInPandas(run, "toxic int, own binary").toArrow()
    discard(picked)
    rows = [np.frombuffer(x.as_py(), dtype="<i4") for x in got["own"]]
    weights, intercept = fit(rows, got["toxic"].to_numpy(), ratios, share)
    return buckets, weights, intercept


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """doc_id, score for each row; only texts go to Python, ids stay in the JVM."""
    buckets, weights, intercept = model
    dense = np.zeros(BUCKETS, dtype=np.float32)
    dense[buckets] = weights
    held = docs.sparkSession.sparkContext.broadcast(dense)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w, last = held.value, scratch()
        for texts in batches:
            z = np.array([float(w[features(t, last)].sum(dtype=np.float64)) for t in texts]) + intercept
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -40, 40))))

    # not deterministic by name only: a column that is read twice must not be made twice
    scored = F.pandas_udf(run, "double").asNondeterministic()
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), scored(F.col("text").cast("string")).alias("score"))


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the id as text leaves 0 modulo 5; null ids are not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
