"""Secret scans over an incremental blob ledger.

Each version of a text is addressed by the SHA-256 of its content. A ledger
holds one row for each (blob, rule version) already scanned, findings included;
only blobs that the ledger lacks under the present rule version are scanned,
once however many paths hold them, and the findings are joined back to all
paths. ``scan`` returns the rows to add to the ledger.

A ledger is a folder in storage that all machines see: each run appends its new
rows as one write, which counts once it is whole, under its rule version. The
query and the pipeline's stage use the folder that the session names in
``LEDGER_SETTING``; without one they begin with an empty ledger of their own.
``findings`` takes any key columns, so a table of paths and versions is scanned
over its whole history at once.

Null text counts as empty. Rows that repeat get the findings each, rows with a
null doc_id too. Spans are in code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillmill.llm.common import exists, materialize, small, table

RULE_VERSION = "2"
LEDGER_SETTING = "spark.quillmill.secrets.ledger"
#: kind, pattern, group to measure, least length; found spans shorter than that are dropped.
RULES = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    # runs under 32 are dropped anyway; asking for 32 here finds the same runs
    ("hex", re.compile(r"[0-9a-f]{32,}"), 0, 32),
    ("pem", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]*PRIVATE KEY-----)?"), 0, 1),
    ("github", re.compile(r"gh[pousr]_[A-Za-z0-9]+"), 0, 40),
    ("slack", re.compile(r"xox[abprs]-[A-Za-z0-9-]+"), 0, 20),
    # only where a run of its characters begins, so that each run is looked through once
    ("jwt", re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"), 0, 40),
)
N_BASE = 3
#: A text without any of these (lower-cased where the rule ignores case) can't match the rule.
NEEDS = {"assign": ("password", "passwd", "secret", "token", "apikey", "api_key"), "access": ("AKIA",), "pem": ("-----BEGIN",), "github": ("gh",), "slack": ("xox",), "jwt": ("eyJ",)}
COLUMNS = (("n_assign", "long"), ("n_access", "long"), ("n_hex", "long"), ("base_sha256", "string"), ("spans", "string"))
NAMES = [c for c, _ in COLUMNS]
FOUND = ", ".join(f"{c} {t}" for c, t in COLUMNS)


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, index of the rule, end) of each finding, ascending."""
    low, found = text.lower(), []
    for k, (kind, pattern, group, least) in enumerate(RULES):
        if kind not in NEEDS or any(x in (low if kind == "assign" else text) for x in NEEDS[kind]):
            found += [(m.start(), k, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(found)


def digest(text: str) -> tuple:
    found = find(text)
    say = lambda some: ",".join(f"{RULES[k][0]}:{a}:{b}" for a, k, b in some)
    count = [sum(k == n for _, k, _ in found) for n in range(N_BASE)]
    return (*count, hashlib.sha256(say([x for x in found if x[1] < N_BASE]).encode()).hexdigest(), say(found))


def _scan(batches):
    for pdf in batches:
        got = pd.DataFrame([digest(t) for t in pdf["text"]], columns=NAMES)
        got.insert(0, "blob", pdf["blob"].to_numpy())
        yield got


def addressed(docs: DataFrame) -> DataFrame:
    """Adds ``blob``, the SHA-256 of the text, as 32 bytes."""
    return docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("blob", F.unhex(F.sha2("text", 256)))


def scan(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """The ledger's new rows: blob, rule_version and the findings of each unseen blob."""
    blobs = addressed(docs.select("text"))
    if ledger is not None:
        blobs = blobs.join(ledger.where(F.col("rule_version") == RULE_VERSION).select("blob"), "blob", "left_anti")
    unseen = blobs.groupBy("blob").agg(F.first("text").alias("text"))
    return unseen.mapInPandas(_scan, f"blob binary, {FOUND}").withColumn("rule_version", F.lit(RULE_VERSION))


def ledger_at(spark: SparkSession, path: str | None) -> DataFrame | None:
    """The rows of the ledger in ``path``; none before its first write."""
    return spark.read.parquet(path) if path and exists(spark, path) else None


def known(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """blob and findings of every text of ``docs``: what the ledger in the folder ``ledger`` lacks is scanned and appended to it."""
    spark = docs.sparkSession
    old = ledger_at(spark, ledger)
    new = materialize(scan(docs, old), "ledger")
    if ledger:
        new.write.mode("append").parquet(ledger)
    held = new if old is None else old.where(F.col("rule_version") == RULE_VERSION).select(*new.columns).unionByName(new)
    # two runs that began together may both have scanned a blob
    return held.drop("rule_version") if old is None else held.drop("rule_version").dropDuplicates(["blob"])


def findings(docs: DataFrame, ledger: str | None = None, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The key columns and the findings for each row, from the ledger where it has them.

    Every blob is in the ledger by then, so a path whose blob has no findings
    there gets the empty result without a join of its own.
    """
    paths = addressed(docs.select(*keys, "text")).drop("text").withColumnRenamed("blob", "__sha")
    hits = small(known(docs, ledger).where("spans <> ''"))
    told = [F.coalesce(c, F.lit(v)).cast(t).alias(c) for (c, t), v in zip(COLUMNS, digest(""), strict=True)]
    return paths.join(hits, F.col("__sha") == F.col("blob"), "left").select(*keys, *told)


@F.pandas_udf(StringType())
def _blanked(texts: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([blanked(t, s) if s else None for t, s in zip(texts, spans, strict=True)], dtype=object)


# else the text would be made again for n_chars
_blanked = _blanked.asNondeterministic()


def redacted(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """All columns of ``docs``; each finding in ``text`` gives way to ``[KIND]``, n_chars follows.

    Overlapping findings give way together, named by the first. The blobs with
    findings are broadcast while their bytes are few, and joined by a shuffle
    beyond. Only texts and spans go to Python, other columns stay as they are.
    """
    hits = known(docs.select("text"), ledger).where("spans <> ''").select("blob", "spans")
    # the row is one column, so no name of its own can clash
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("sha"))
    paths = rows.join(small(hits), F.col("sha") == F.col("blob"), "left")
    found, text = F.col("spans").isNotNull(), F.col("row")["text"]
    out = paths.withColumn("clean", _blanked(F.when(found, text.cast("string")), F.col("spans"))).withColumn("clean", F.when(found, F.col("clean")).otherwise(text))
    new = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.coalesce(F.length("clean"), F.lit(0)).cast(docs.schema["n_chars"].dataType)
    return out.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def blanked(text: str, spans: str) -> str:
    out, end = [], 0
    for kind, a, b in (x.split(":") for x in spans.split(",")):
        a, b = int(a), int(b)
        if a >= end:
            out += [text[end:a], f"[{kind.upper()}]"]
        end = max(end, b)
    return "".join(out) + text[end:]


def session_ledger(spark: SparkSession) -> str | None:
    return spark.conf.get(LEDGER_SETTING, None)


def op10_secret_scans(spark, sf_dir: str) -> DataFrame:
    return findings(table(spark, sf_dir, "documents"), session_ledger(spark))
