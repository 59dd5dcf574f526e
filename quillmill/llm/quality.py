"""Quality rules with host verdicts, in DataFrame functions only.

Each document is measured, the failures of the rules are summed by host (the
``source`` column; null is a host of its own), each host's failure rate is
shrunk towards all hosts' by an empirical beta prior, and the verdict of the
host is joined back: a host is rejected if the ``TAIL`` quantile of its beta
posterior exceeds ``HOST_LIMIT``, so with 95 % certainty over half its documents
fail. A document is kept if it passes the base rules itself and its host is not
rejected.

Null or empty text: no words, so the base rules fail. Rows that repeat count
and are judged each, those with a null doc_id too. An empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import ASCII_SPACE, beta_quantile, beta_quantile_sql, materialize, small, table, words_of

MIN_WORDS = 50
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
HOST_LIMIT, TAIL = 0.5, 0.05


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    Repeats are found by sorting the hashes of a text's 3-word windows, with
    their places only where some hash repeats, so the cost of a text of n words
    is n log n whatever repeats in it.
    """
    hashes = F.transform("__w", lambda w, i: F.xxhash64(w, F.get("__w", i + 1), F.get("__w", i + 2)))
    windows = F.when(F.size("__w") < 3, F.array().cast("array<bigint>")).otherwise(F.slice(hashes, 1, F.greatest(F.size("__w") - 2, F.lit(0))))
    placed = F.sort_array(F.transform("__t", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    at = lambda j: F.get("__s", j)["h"]
    again = F.filter("__s", lambda e, j: F.when(j > 0, at(j - 1) == e["h"]).otherwise(F.lit(False)) | F.coalesce(at(j + 1) == e["h"], F.lit(False)))
    covered = F.aggregate(F.transform("__p", lambda p, j: F.least(F.lit(3), F.coalesce(F.get("__p", j + 1) - p, F.lit(3)))), F.lit(0).cast("bigint"), lambda a, x: a + x)
    lines = F.filter(F.split("__text", "\n"), lambda s: F.btrim(s, F.lit(ASCII_SPACE)) != "")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        docs.withColumn("__text", F.coalesce(F.col(text), F.lit("")))
        .withColumn("__w", words_of(F.col("__text")))
        .withColumns({
            "__t": windows,
            "n_words": F.size("__w").cast("bigint"),
            "word_chars": F.aggregate("__w", F.lit(0).cast("bigint"), lambda a, w: a + F.length(w)),
            "n_symbols": F.regexp_count("__text", F.lit(r"[#*$%&|<>]")).cast("bigint"),
            "__lines": lines,
        })
        .withColumns({
            "__s": F.when(F.size(F.array_distinct("__t")) < F.size("__t"), placed).otherwise(none),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint"),
        })
        .withColumn("__p", F.sort_array(F.transform(again, lambda e: e["i"])))
        .withColumn("n_repeat_words", covered)
        .withColumn("base_failed", failed)
        # a generator, as a filter on a measure must not be pushed below, into the lambdas
        .select(*docs.columns, F.inline(F.array(F.struct(*MEASURES))))
    )


def rule_failed() -> Column:
    """Any rule that counts against the host: the base rules, symbols, repeated lines."""
    return F.col("base_failed") | (10 * F.col("n_symbols") > F.col("n_words")) | (20 * F.col("n_dup_lines") > F.col("n_words"))


def host_verdicts(judged: DataFrame, host: str = "source", failed: str = "failed", rows: str | None = None) -> DataFrame:
    """host, n_docs, n_failed, rate (shrunk), rejected: one row for each host.

    The beta prior is fitted by moments over the hosts: its mean is the rate of
    all rows, its strength follows from the variance between hosts beyond the
    binomial one, held to 1..10000. The driver sees one row of sums. ``rows``
    names a column of row counts, where the rows are summed already.
    """
    many = F.col(rows) if rows else F.lit(1)
    hosts = judged.groupBy(F.col(host).alias("host")).agg(F.sum(many).cast("bigint").alias("n_docs"), F.sum(F.when(F.col(failed), many).otherwise(0)).cast("bigint").alias("n_failed"))
    n, f = F.col("n_docs").cast("double"), F.col("n_failed").cast("double")
    s = hosts.agg(F.sum(n).alias("n"), F.sum(f).alias("f"), F.count("*").alias("h"), F.sum(f * f / n).alias("q")).first()
    total, bad = s["n"] or 1.0, s["f"] or 0.0
    p = min(max(bad / total, 1e-6), 1 - 1e-6)
    between = (s["q"] or 0.0) / total - (bad / total) ** 2 - p * (1 - p) * s["h"] / total
    m = min(max(p * (1 - p) / max(between, 1e-12) - 1, 1.0), 1e4)
    rate = (f + m * p) / (n + m)
    return hosts.select("host", "n_docs", "n_failed", rate.alias("rate"), (beta_quantile(f + m * p, n - f + m * (1 - p), TAIL) > HOST_LIMIT).alias("rejected"))


def quality_report(docs: DataFrame) -> DataFrame:
    """doc_id, the measures, base_failed, host_rate, kept, for each row."""
    base = docs.select("doc_id", "source", "text")
    judged = materialize(measured(base).drop("text").withColumn("failed", rule_failed()), "quality")
    verdicts = host_verdicts(judged).select(F.col("host").alias("__host"), F.round("rate", 9).alias("host_rate"), "rejected")
    verdicts = small(materialize(verdicts, "verdicts"))
    return judged.join(verdicts, F.col("source").eqNullSafe(F.col("__host")), "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~F.col("rejected")).alias("kept"), "host_rate"
    )


def keep_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all its columns, that the rules and their host's verdict keep.

    The texts are measured twice, for the hosts and for the rows, and neither
    shuffled nor written; rejected hosts are broadcast while few.
    """
    names = docs.columns
    hosts = measured(docs.select("source", "text")).select("source", rule_failed().alias("failed")).groupBy("source", "failed").agg(F.count("*").alias("n"))
    hosts = materialize(hosts, "hosts")
    rejected = small(materialize(host_verdicts(hosts, rows="n").where("rejected").select(F.col("host").alias("__host")), "rejected"))
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("__row"), F.col("source").alias("__source"), F.col("text").alias("__own"))
    own = measured(packed, "__own").where("not base_failed")
    return own.join(rejected, F.col("__source").eqNullSafe(F.col("__host")), "left_anti").select("__row.*")


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT r, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS s FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), c AS (
  SELECT r, count(DISTINCT p) AS n FROM (
    SELECT r, unnest([i, i+1, i+2]) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS k FROM g) WHERE k > 1
  ) GROUP BY r
), l AS (
  SELECT r, count(*) - count(DISTINCT x) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY r
), m AS (
  SELECT d.r, doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN c USING (r) LEFT JOIN l USING (r)
), j AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         base_failed OR 10 * n_symbols > n_words OR 20 * n_dup_lines > n_words AS failed FROM m
), h AS (SELECT source, count(*)::DOUBLE AS n, sum(failed::INT)::DOUBLE AS f FROM j GROUP BY source
), s AS (
  SELECT greatest(least(sum(f)/sum(n), 1 - 1e-6), 1e-6) AS p, sum(f)/sum(n) AS p0, sum(f*f/n)/sum(n) AS q, count(*)/sum(n) AS k FROM h
), z AS (SELECT p, least(greatest(p*(1-p) / greatest(q - p0*p0 - p*(1-p)*k, 1e-12) - 1, 1.0), 1e4) AS m FROM s
), y AS (SELECT source, (f + m*p) / (n + m) AS rate, f + m*p AS a, n - f + m*(1-p) AS b FROM h, z
), v AS (SELECT source, rate, BOUND AS bound FROM y
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT bound > 0.5 AS kept, round(rate, 9) AS host_rate
FROM j JOIN v ON j.source IS NOT DISTINCT FROM v.source
""".replace("BOUND", beta_quantile_sql("a", "b", TAIL))
