"""URL filters, in DataFrame functions only.

Rules decide first: the longest rule whose host is the url's host or a parent
of it and whose path begins the url's path. Other urls are judged by empirical-
Bayes host reputation: labelled page outcomes are counted by host, and each
level's bad rate is shrunk towards the next one's through a beta-binomial prior,
host to registered domain to suffix to all pages; a host is blocked if the
``TAIL`` quantile of its beta posterior exceeds ``BLOCK_ABOVE``: with 95 %
certainty more than that share of its pages is bad.

The suffix is the last two labels of the host if ``SUFFIXES`` has them, else the
last label; the registered domain is the suffix and one label more (a host that
is a suffix itself is its own domain). Null urls and urls without ``://`` have
empty host and path and are judged by the posterior of the empty host. Rows that
repeat are judged each, those with a null page_id too, which no outcome meets.
Without any outcome all posteriors are the prior's mean of 1/2 with nothing
behind it, which no bound lets block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import beta_quantile, beta_quantile_sql, lower_ascii, materialize, small, table

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
BLOCK_ABOVE, TAIL = 0.5, 0.05
#: Suffixes of two labels under which names are registered; others have one. A parameter, to be given the public list where it is at hand.
SUFFIXES = tuple(
    f"{second}.{country}"
    for country, seconds in (
        ("ar", "com edu gov net org"), ("au", "com edu gov net org id"), ("br", "com edu gov net org"), ("cn", "ac com edu gov net org"), ("hk", "com edu gov net org"), ("id", "ac co go or web"),
        ("il", "ac co gov net org"), ("in", "ac co edu gov net org"), ("jp", "ac co go ne or"), ("ke", "ac co go or"), ("kr", "ac co go or re"), ("mx", "com edu gob net org"), ("my", "com edu gov net org"),
        ("nz", "ac co govt net org"), ("pl", "com edu gov net org"), ("sg", "com edu gov net org"), ("th", "ac co go in or"), ("tr", "com edu gov net org"), ("tw", "com edu gov net org"), ("ua", "com edu gov net org"),
        ("uk", "ac co gov ltd me net org plc sch"), ("za", "ac co gov net org web"),
    )
    for second in seconds.split()
)
#: Bounds of a level's prior strength, in pages.
LEAST, MOST = 1.0, 1000.0


def parsed(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path."""
    rest = F.expr(f"substring({url}, instr({url}, '://') + 3)")
    there = F.coalesce(F.instr(F.col(url), "://") > 0, F.lit(False))
    host = lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return pages.withColumns({"host": F.when(there, host).otherwise(""), "path": F.when(there, path).otherwise("")})


def by_rule(rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else null; ``rules`` is a short list."""
    rule = verdict = F.lit(None).cast("string")
    for say, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, say).otherwise(verdict)
    return rule, verdict


def _strength(groups: DataFrame) -> float:
    """Prior strength by moments: the variance of the groups' rates around their parents' beyond the binomial one."""
    n, b, p = F.col("n"), F.col("bad"), F.col("parent")
    s = groups.where("n > 0").agg(F.sum(n).alias("n"), F.sum(n * (b / n - p) ** 2).alias("s"), F.sum(p * (1 - p)).alias("w"), F.sum(n * p * (1 - p)).alias("v")).first()
    if not s["n"]:
        return LEAST
    between = (s["s"] - s["w"]) / s["n"]
    return min(max(s["v"] / s["n"] / max(between, 1e-12) - 1, LEAST), MOST)


def levels(hosts: DataFrame, suffixes=SUFFIXES) -> DataFrame:
    """Adds suffix and domain to hosts."""
    two = F.substring_index("host", ".", -2)
    long = two.isin(*suffixes) if suffixes else F.lit(False)
    return hosts.withColumns({"suffix": F.when(long, two).otherwise(F.substring_index("host", ".", -1)), "domain": F.when(long, F.substring_index("host", ".", -3)).otherwise(two)})


def reputations(pages: DataFrame, outcomes: DataFrame, suffixes=SUFFIXES) -> DataFrame:
    """host, alpha, beta, bound: the posterior of each host of ``pages`` (parsed).

    ``outcomes`` has page_id and bad (boolean; null rows don't count); several
    outcomes of a page count as one, bad if any is. Pages are summed by page_id
    and host before the join, hosts are stored once, and the driver sees one row
    of sums for each level.
    """
    once = outcomes.where("bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    labelled = pages.where("page_id is not null").groupBy("page_id", "host").agg(F.count("*").cast("double").alias("pages")).join(once, "page_id")
    sums = labelled.groupBy("host").agg(F.sum("pages").alias("n"), F.sum(F.when(F.col("bad"), F.col("pages")).otherwise(0.0)).alias("bad"))
    every = pages.select("host", F.lit(0.0).alias("n"), F.lit(0.0).alias("bad")).distinct()
    hosts = materialize(levels(every.unionByName(sums).groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), suffixes), "hosts")
    total = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    overall = ((total["bad"] or 0.0) + 1) / ((total["n"] or 0.0) + 2)
    parent = None
    for level in ("suffix", "domain"):
        sums = hosts.groupBy("domain", "suffix") if level == "domain" else hosts.groupBy("suffix")
        groups = sums.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
        groups = groups.withColumn("parent", F.lit(overall)) if parent is None else groups.join(parent, "suffix")
        m = _strength(groups)
        parent = groups.select(level, ((F.col("bad") + m * F.col("parent")) / (F.col("n") + m)).alias("parent"))
    judged = hosts.select("host", "n", "bad", "domain").join(parent, "domain")
    m = _strength(judged)
    a, b = F.col("bad") + m * F.col("parent"), F.col("n") - F.col("bad") + m * (1 - F.col("parent"))
    return judged.select("host", a.alias("alpha"), b.alias("beta")).withColumn("bound", beta_quantile(F.col("alpha"), F.col("beta"), TAIL))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, suffixes=SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict for each row.

    Only blocked hosts are joined back, by broadcast while their bytes are few.
    """
    known = parsed(pages.select("page_id", "url")).drop("url")
    blocked = reputations(known, outcomes, suffixes).where(F.col("bound") > BLOCK_ABOVE).select(F.col("host").alias("__host"))
    blocked = small(materialize(blocked, "blocked"))
    rule, verdict = by_rule(rules)
    other = F.when(F.col("__host").isNotNull(), "block").otherwise("allow")
    return known.join(blocked, F.col("host") == F.col("__host"), "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, other).alias("verdict"))


def op6_url_filters(spark, sf_dir: str) -> DataFrame:
    """A page's outcome is its row of ``labels``: bad if toxic or of quality 0."""
    bad = (F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    return judge(table(spark, sf_dir, "pages"), outcomes)


OP6_SQL = r"""
WITH p AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), k AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM p
), o AS (
  SELECT doc_id AS page_id, max((coalesce(toxic, 0) = 1 OR coalesce(quality, 1) = 0)::INT) AS bad FROM labels GROUP BY 1
), h AS (
  SELECT host, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad,
         CASE WHEN array_to_string(string_split(host, '.')[-2:], '.') IN (SUFFIXES) THEN array_to_string(string_split(host, '.')[-3:], '.') ELSE array_to_string(string_split(host, '.')[-2:], '.') END AS domain,
         CASE WHEN array_to_string(string_split(host, '.')[-2:], '.') IN (SUFFIXES) THEN array_to_string(string_split(host, '.')[-2:], '.') ELSE string_split(host, '.')[-1] END AS suffix
  FROM k LEFT JOIN o USING (page_id) GROUP BY host
), g AS (SELECT (coalesce(sum(bad), 0) + 1) / (coalesce(sum(n), 0) + 2) AS p FROM h
), s AS (
  SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(p) AS p FROM h, g GROUP BY suffix
), ms AS (
  SELECT coalesce(least(greatest((sum(n*p*(1-p)) / sum(n)) / greatest((sum(n*(bad/n-p)*(bad/n-p)) - sum(p*(1-p))) / sum(n), 1e-12) - 1, 1.0), 1000.0), 1.0) AS m
  FROM s WHERE n > 0
), sp AS (SELECT suffix, (bad + m*p) / (n + m) AS p FROM s, ms
), d AS (
  SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad, any_value(p) AS p FROM h JOIN sp USING (suffix) GROUP BY domain, suffix
), md AS (
  SELECT coalesce(least(greatest((sum(n*p*(1-p)) / sum(n)) / greatest((sum(n*(bad/n-p)*(bad/n-p)) - sum(p*(1-p))) / sum(n), 1e-12) - 1, 1.0), 1000.0), 1.0) AS m
  FROM d WHERE n > 0
), dp AS (SELECT domain, (bad + m*p) / (n + m) AS p FROM d, md
), x AS (SELECT host, n, bad, p FROM h JOIN dp USING (domain)
), mh AS (
  SELECT coalesce(least(greatest((sum(n*p*(1-p)) / sum(n)) / greatest((sum(n*(bad/n-p)*(bad/n-p)) - sum(p*(1-p))) / sum(n), 1e-12) - 1, 1.0), 1000.0), 1.0) AS m
  FROM x WHERE n > 0
), y AS (SELECT host, bad + m*p AS a, n - bad + m*(1-p) AS b FROM x, mh
), z AS (SELECT host, BOUND AS bound FROM y
), r AS (
  SELECT page_id, host, path, bound,
    CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
         WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
         WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
         WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
  FROM k LEFT JOIN z USING (host)
)
SELECT page_id, host, path, rule,
  CASE rule WHEN 'net/' THEN 'block' WHEN 'example.com/de/' THEN 'block' WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow'
       ELSE CASE WHEN bound > 0.5 THEN 'block' ELSE 'allow' END END AS verdict
FROM r
""".replace("SUFFIXES", ", ".join(f"'{s}'" for s in SUFFIXES)).replace("BOUND", beta_quantile_sql("a", "b", TAIL))
