"""The training-data operators against plain versions on small tables.

The table holds null ids and texts, an empty and a very long text, repeated
rows, exact and near copies, ties, and extra columns with clashing names.
"""

from __future__ import annotations

import hashlib
import os
import random
import re
import subprocess
import sys
import time
import zlib
from collections import Counter
from math import comb
from pathlib import Path

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillmill.llm import common, licenses, mixing, packing, quality, queries, secrets, simhash, substrings, syncmers, toxicity, urls

REPO = Path(__file__).resolve().parents[2]
EXTRA = ["size", "rid", "target", "blocks", "n_words", "key", "start", "length", "blob", "fp", "score", "rank", "source_size"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)
WORDS = [a + b for a in ("an", "be", "co", "du", "el", "fi", "go") for b in ("ra", "lo", "mi", "tu", "ne", "sa", "ko", "pi")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def make_rows():
    rng = random.Random(5)
    base = [prose(rng, rng.randint(60, 200)) for _ in range(24)]
    passage = prose(rng, 60)
    texts = [*base, base[0], base[0], base[1] + " end", base[2][:-3], passage + " " + base[3], base[4] + "\n" + passage, "é" + base[5][2:], None, "", " \t\n", "ab", "one two", "one two three four"]
    texts += [prose(rng, 6000), "x" * 5000, "\n".join([base[6]] * 8), base[7] + " password = 'abcDEF123456' and AKIA" + "Q" * 16 + " " + "0af1" * 10, "MIT License\n" + base[8] + " This work is licensed under the GNU General Public License, version 3. CC-BY cc by 4.0"]
    texts += [base[9] + " 日本語 <|endoftext|> 🙂", "token: secret=short api_key:x passwd=12345678 " + base[10], "-----BEGIN PRIVATE KEY-----\nabc\n-----END PRIVATE KEY----- " + base[11]]
    rows = [(k, t, "en", None if k % 11 == 3 else f"s{k % 4}", len(t or "")) for k, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, base[12], "en", "s1", 5), (None, None, None, None, None)]
    return [(*r, *("x" for _ in EXTRA)) for r in rows]


ROWS = make_rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def same(got, wanted):
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, wanted))


# ---- all ----

#: Longs that a double can't hold.
BIG = [(1 << 60) + 1, None, (1 << 60) + 3, (1 << 60) + 2]


@pytest.fixture(scope="module")
def big(spark):
    rng = random.Random(11)
    rows = [(i, prose(rng, 80), "en", "s", 1, *("x" for _ in EXTRA)) for i in BIG]
    rows[3] = (rows[3][0], rows[0][1] + " token=abcdefgh1", *rows[3][2:])
    return spark.createDataFrame(rows, SCHEMA).coalesce(1)


def test_ids_stay_exact_beside_nulls(spark, big):
    labels = spark.createDataFrame([(BIG[0], 1), (BIG[2], 0)], "doc_id long, toxic int")
    outs = {
        1: syncmers.fingerprint_report(big), 2: toxicity.score(big, toxicity.train(big, labels)), 3: packing.pack(packing.pieces(big)), 4: mixing.mixture(big), 5: simhash.groups(big),
        7: substrings.removed(big), 8: licenses.scanned(big), 9: quality.quality_report(big), 10: secrets.findings(big), "stage 9": quality.keep_documents(big), "stage 10": secrets.redacted(big),
    }
    for op, out in outs.items():
        assert Counter(r["doc_id"] for r in out.collect()) == Counter(BIG), op
    pages = big.select(F.col("doc_id").alias("page_id"), F.lit("http://a.b/").alias("url"))
    assert Counter(r["page_id"] for r in urls.judge(pages, labels.select(F.col("doc_id").alias("page_id"), F.lit(True).alias("bad"))).collect()) == Counter(BIG)
    assert set(r["doc_id"] for r in mixing.mixed(big, 2).select("__row.doc_id").collect()) <= set(BIG)


def test_one_row_of_each_group_stays_whatever_the_ids(spark, big):
    kept = [r["doc_id"] for r in simhash.keep_one(big).collect()]
    prints = [plain_print(r["text"]) for r in big.collect()]
    assert len(kept) == len(set(plain_groups(prints))) and {BIG[0], None, BIG[2]} <= set(kept)


def test_workers_need_not_have_the_package(tmp_path):
    """A session whose workers don't find the repository on their path."""
    code = f"""
import sys
sys.path.insert(0, {str(REPO)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {str(tmp_path)!r}).config("spark.sql.warehouse.dir", {str(tmp_path / "w")!r}).getOrCreate()
def there(_):
    import importlib.util
    yield int(importlib.util.find_spec("quillmill") is not None)
assert spark.sparkContext.parallelize([0], 1).mapPartitions(there).collect() == [0]
from quillmill.llm import packing, secrets, simhash, substrings, toxicity
docs = spark.createDataFrame([(k, f"some words token=abcdefgh{{k}} of text " * 9) for k in range(6)], "doc_id long, text string")
labels = spark.createDataFrame([(k, k % 2) for k in range(6)], "doc_id long, toxic int")
for out in (toxicity.score(docs, toxicity.train(docs, labels)), packing.pack(packing.pieces(docs)), simhash.groups(docs), simhash.keep_one(docs), substrings.removed(docs), secrets.findings(docs), secrets.redacted(docs)):
    out.collect()
"""
    place = tmp_path / "elsewhere"
    place.mkdir()
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONPATH": os.pathsep.join(p for p in sys.path if p and p != str(REPO) and not p.startswith(str(REPO) + os.sep))}
    subprocess.run([sys.executable, "-c", code], cwd=place, check=True, env=env)


def test_beta_quantile(spark):
    cases = [(0.05, 1.0), (1.0, 1.0), (3.0, 9.0), (50.0, 20.0), (1000.0, 3000.0), (20.0, 0.05)]
    got = spark.createDataFrame(cases, "a double, b double").select("a", "b", common.beta_quantile(F.col("a"), F.col("b"), 0.05).alias("q")).collect()
    rng = np.random.default_rng(1)
    for r in got:
        assert r["q"] == pytest.approx(np.quantile(rng.beta(r["a"], r["b"], 500_000), 0.05), abs=2e-3)


def test_small_sides_are_measured_in_bytes(spark):
    held = common.materialize(spark.range(10).select(F.repeat(F.lit("x"), 100).alias("s"), F.array(F.lit("y")).alias("a"), "id"), "small")
    assert "ResolvedHint" in common.small(held)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in common.small(held, 500)._jdf.queryExecution().analyzed().toString()
    common.discard(held)
    assert not common.exists(spark, held._stored_at)


SQL_QUERIES = sorted(queries.ORACLE_SQL)


@pytest.mark.parametrize("name", SQL_QUERIES)
def test_queries_equal_their_sql(spark, docs, tmp_path, name):
    """The registered query and its SQL over the rows above and a few urls."""
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    hosts = ["a.bad.co.uk", "b.bad.co.uk", "fine.co.uk", "bad.com", "fine.com", "example.net"]
    pages = [(k, f"http://{hosts[k % 6]}/en/{k}" if k % 50 else None, "x" * 9) for k in range(600)] + [(None, "http://a.bad.co.uk/" + "y" * 50_000, "x"), (3, "http://bad.com/", "x")]
    labels = [(k, int(k % 6 not in (0, 1, 3)), int(k % 12 == 0)) for k in range(500)] + [(None, 0, 1), (5, None, None)]
    spark.createDataFrame(pages, "page_id long, url string, host string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    items = [(1, " ".join(ROWS[0][1].split()[5:40])), (10, ROWS[3][1].upper()), (2, " ".join(ROWS[0][1].split()[20:60])), (3, "one two three"), (4, None), (None, "..."), (2, "lonely")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = queries.QUERIES[name](spark, str(tmp_path))
    wanted = con.sql(queries.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(wanted.columns)
    rows = got.select(*wanted.columns).collect()
    same(rows, wanted.fetchall())
    if name.startswith("op6"):
        verdict = {(r["host"], r["verdict"]) for r in rows if r["rule"] is None}
        assert verdict == {("a.bad.co.uk", "block"), ("b.bad.co.uk", "block"), ("bad.com", "block"), ("fine.co.uk", "allow"), ("fine.com", "allow"), ("example.net", "allow"), ("", "allow")} - {("example.net", "allow")}


# ---- 1: fingerprints ----


def plain_order():
    pairs = [(r[0], r[1] or "") for r in ROWS]
    return sorted(pairs, key=lambda p: (p[0] is None, -(p[0] or 0), -signed_hash(p[1]), p[1]))


def signed_hash(text):
    h = xxhash.xxh64(text.encode(), seed=42).intdigest()
    return h - (1 << 64) if h >> 63 else h


def test_heavy_ids_are_divided(spark):
    """A third of the rows without an id, a third with one id."""
    rng = random.Random(0)
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else k, f"text {rng.random()}") for k in range(3000)] + [(7, "twice"), (7, "twice")]
    got = syncmers.with_next(spark.createDataFrame(rows, "doc_id long, text string"))
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), -signed_hash(r[1]), r[1]))
    assert Counter(map(tuple, got.collect())) == Counter((*a, b[1]) for a, b in zip(order, order[1:] + order[:1]))
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 1100


@pytest.mark.parametrize("op", ["op1_syncmer_fingerprints", "op2_toxicity", "op3_best_fit_packing", "op4_mixing", "op5_simhash_near_dedup", "op7_repeated_substrings", "op10_secret_scans"])
def test_registered_queries_without_sql(spark, docs, tmp_path, op):
    """Each row of the table comes out, under the contract's columns; the empty table gives none."""
    columns = {
        "op1_syncmer_fingerprints": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        "op2_toxicity": ["doc_id", "held_out", "score", "predicted"],
        "op3_best_fit_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
        "op4_mixing": ["doc_id", "size", "source_size", "target", "taken"],
        "op5_simhash_near_dedup": ["doc_id", "fingerprint", "component_id"],
        "op7_repeated_substrings": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        "op10_secret_scans": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    }[op]
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(k, k % 2, k % 3 and 1) for k in range(40)] + [(None, 1, 1), (2, 0, 0), (2, 0, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = queries.QUERIES[op](spark, str(tmp_path))
    assert set(columns) <= set(got.columns)
    rows = got.where("piece = 0") if "piece" in got.columns else got
    assert Counter(r["doc_id"] for r in rows.collect()) == Counter(r[0] for r in ROWS)
    if op == "op5_simhash_near_dedup":
        prints = [plain_print(r[1]) for r in ROWS]
        assert Counter(r["fingerprint"] for r in got.collect()) == Counter(f"{p:016x}" for p in prints)
        assert len({r["component_id"] for r in got.collect()}) == len(set(plain_groups(prints)))
    elif op == "op7_repeated_substrings":
        own = sorted(((r[0], r[1]) for r in ROWS), key=lambda r: (r[0] is None, r[0] or 0, r[1] is None))
        same(got.select(*columns).collect(), plain_removed(own))
    elif op == "op10_secret_scans":
        same(got.select(*columns).collect(), [(r[0], *plain_secrets(r[1]), plain_spans(r[1])) for r in ROWS])


def test_fingerprints(spark, docs, empty):
    got = syncmers.fingerprint_report(docs).collect()
    assert len(got) == len(ROWS)
    ordered, wanted = plain_order(), []
    for k, (i, t) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][1]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        wanted.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest()))
    same([(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got], wanted)
    by_text = {}
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        text = {i: t for i, t in ordered}.get(r["doc_id"])
        if r["doc_id"] is not None:
            assert by_text.setdefault(text, r["fingerprint"]) == r["fingerprint"]
    clean = {r["doc_id"]: r for r in got}
    assert clean[25]["near_next"] == 1.0  # its successor is the same text
    assert 0.1 < clean[37]["near_edited"] < 0.8
    assert clean[10]["near_next"] < 0.1
    assert syncmers.fingerprint_report(empty).count() == 0


def test_anchors_are_closed_syncmers_with_places(spark):
    text = prose(random.Random(1), 40)
    moved = "some other words first " + text
    df = spark.createDataFrame([(0, text), (1, moved), (2, "a b"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: {(a["pos"], a["hash"]) for a in r["anchors"]} for r in syncmers.anchors(df).collect()}
    assert {(p + 4, h) for p, h in got[0]} <= got[1]  # context-free: moved along with the text
    assert 0.3 < len(got[0]) / 36 < 0.75
    assert len(got[2]) == 1 and got[3] == set()
    tie = spark.createDataFrame([(0, "w " * 30)], "doc_id long, text string")
    assert len(syncmers.anchors(tie).first()["anchors"]) == 26


def test_chains_of_anchors_at_one_relative_position(spark):
    rng = random.Random(12)
    text, other = prose(rng, 200), prose(rng, 150)
    words = text.split()
    pairs = [(text, text), (text, other + " " + text), (text, " ".join(words[100:] + words[:100])), (text, other), (text, ""), ("", None), ("a b", "a b"), ("w " * 60, "w " * 50)]
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "k int, a string, b string")
    found = syncmers.anchors(syncmers.anchors(df, "a", "x"), "b", "y").select("k", syncmers.placed_likeness("x", "y").alias("placed"), syncmers.likeness("x", "y").alias("near"), "x", "y")
    for r in found.collect():
        a, b = ({(p["pos"], p["hash"]) for p in r[c]} for c in ("x", "y"))
        tried = sorted({h for _, h in a} & {h for _, h in b})[: syncmers.TRIED]
        first = lambda own, h: min(p for p, x in own if x == h)
        chains = [len(a & {(p + first(a, h) - first(b, h), x) for p, x in b}) for h in tried]
        wanted = max((n / (len(a) + len(b) - n) for n in chains), default=0.0) if a or b else 1.0
        assert r["placed"] == pytest.approx(wanted), r["k"]
    got = {r["k"]: (r["placed"], r["near"]) for r in found.collect()}
    assert got[0] == (1.0, 1.0) and 0.4 < got[1][0] < 0.7 and got[5] == (1.0, 1.0)
    assert got[2][1] > 0.9 and got[2][0] < 0.7  # the same passages in another order
    assert got[3][0] == got[4][0] == 0.0


def plain_anchors(text):
    def chained(*longs):
        seed = 42
        for v in longs:
            seed = xxhash.xxh64(v.to_bytes(8, "little", signed=True), seed=seed).intdigest()
        return seed - (1 << 64) if seed >> 63 else seed

    def of_word(w):
        h = xxhash.xxh64(w.encode(), seed=42).intdigest()
        return h - (1 << 64) if h >> 63 else h

    h = [of_word(w) for w in text.lower().split()]
    m = [chained(a, b) for a, b in zip(h, h[1:])]
    return [(i, chained(m[i], m[i + 2], h[i + 4]) & 0xFFFFFFFF) for i in range(len(h) - 4) if min(m[i], m[i + 3]) <= min(m[i + 1], m[i + 2])]


def test_fingerprints_hold_all_anchors_of_long_texts(spark):
    rng = random.Random(8)
    passage = prose(rng, 40)
    texts = [prose(rng, 3000) + " " + passage + " " + prose(rng, 3000), prose(rng, 2000) + " " + passage, prose(rng, 500)]
    df = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r for r in syncmers.fingerprint_report(df).collect()}
    for k, t in enumerate(texts):
        after = texts[k - 1]  # by descending doc_id, the last beside the first
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        for column, x in (("fingerprint", t), ("edited_fingerprint", edited)):
            assert got[k][column] == "".join(f"{p:08x}{h:08x}" for p, h in plain_anchors(x))
        for column, x in (("near_edited", edited), ("near_next", after)):
            a, b = ({h for _, h in plain_anchors(y)} for y in (t, x))
            assert got[k][column] == len(a & b) / len(a | b)
    assert got[1]["near_next"] > 0  # a passage of 40 words in thousands


# ---- 2: toxicity ----


def test_toxicity(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for k in range(600):
        toxic = k % 4 == 0
        words = prose(rng, rng.randint(20, 200)).split()
        for _ in range(4 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(["zwonk", "grubbly", "vexfool"]))
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    rows += [(1000, None), (1001, ""), (1002, "anra grubbly belo zwonk comi vexfool " * 10_000), (None, "zwonk")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(d, known.where(~toxicity.held_out()), per_class=200)
    got = {r["doc_id"]: r for r in toxicity.score(d, model).collect()}
    assert len(got) == len(rows)
    held = [k for k, _ in labels if zlib.crc32(str(k).encode()) % 5 == 0]
    right = [(got[k]["score"] >= 0.5) == bool(labels[k][1]) for k in held]
    assert len(held) > 80 and sum(right) >= 0.97 * len(held)
    assert 0 <= got[1000]["score"] == got[1001]["score"] < 0.5 < got[1002]["score"] <= 1
    none = toxicity.train(d, known.limit(0))
    assert {r["score"] for r in toxicity.score(d, none).collect()} == {1 / (1 + np.exp(40.0))}
    assert toxicity.score(d.limit(0), model).count() == 0


def plain_grams(text):
    words = " " + " ".join((text or "").lower().split()) + " "
    return {words[k : k + n] for n in toxicity.ORDERS for k in range(len(words) - n + 1)}


def test_features_are_the_distinct_grams():
    rng = random.Random(12)
    space = toxicity.scratch()
    for text in (prose(rng, 300), "Ünï  cødé\n" * 3, "", None, "a", "xx " * 5000):
        got, wanted = toxicity.features(text, space), plain_grams(text)
        assert len(set(got.tolist())) == len(got)
        assert len(wanted) * 0.98 - 2 <= len(got) <= len(wanted)  # some share a bucket


def test_model_against_a_plain_one(spark):
    """Ratios from plain counts; the weights are an optimum of the plain loss; scores are the plain sums."""
    rng = random.Random(4)
    space, texts, labels = toxicity.scratch(), [], []
    for k in range(120):
        words = prose(rng, 40).split()
        if k % 3 == 0:
            words[5:5] = [rng.choice(["zwonk", "grubbly"])]
        texts.append(" ".join(words))
        labels.append(int(k % 3 == 0 and k % 7 > 0))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    buckets, weights, intercept = toxicity.train(docs, spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int"))
    rows, y = [set(toxicity.features(t, space).tolist()) for t in texts], np.array(labels, dtype=float)
    p, q = Counter(b for r, t in zip(rows, labels) for b in r if t), Counter(b for r, t in zip(rows, labels) for b in r if not t)
    n1, n0 = sum(labels), len(labels) - sum(labels)
    ratio = {b: np.log((p[b] + 1) / (n1 + 2)) - np.log((q[b] + 1) / (n0 + 2)) for b in p.keys() | q.keys()}
    told = {b: r for b, r in ratio.items() if p[b] + q[b] >= toxicity.MIN_TEXTS and abs(r) >= toxicity.LEAST_RATIO}
    assert set(buckets.tolist()) == set(told)
    x = np.array([[told[b] if b in r else 0.0 for b in buckets.tolist()] for r in rows])
    x /= np.sqrt((x**2).sum(axis=1).mean())
    w = weights / np.array([told[b] for b in buckets.tolist()]) * np.sqrt(np.mean([sum(told[b] ** 2 for b in r if b in told) for r in rows]))
    loss_gradient = lambda w, b: np.append(x.T @ ((1 / (1 + np.exp(-(x @ w + b))) - y) / len(y)) + toxicity.RIDGE * w, ((1 / (1 + np.exp(-(x @ w + b))) - y) / len(y)).sum())
    assert np.linalg.norm(loss_gradient(w, intercept)) < 1e-3 * np.linalg.norm(loss_gradient(0 * w, 0.0))
    weight = dict(zip(buckets.tolist(), weights.tolist(), strict=True))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, (buckets, weights, intercept)).collect()}
    for k, r in enumerate(rows):
        assert got[k] == pytest.approx(1 / (1 + np.exp(-(sum(weight.get(b, 0.0) for b in r) + intercept))), abs=1e-4)


def test_features_do_not_depend_on_slices(monkeypatch):
    text = prose(random.Random(2), 300)
    space = toxicity.scratch()
    whole = toxicity.features(text, space).tolist()
    monkeypatch.setattr(toxicity, "SLICE", 64)
    again = toxicity.features(text, space).tolist()
    assert set(again) == set(whole) and len(again) == len(set(again)) == len(whole)


# ---- 3: packing ----


def test_packing(spark, docs, empty):
    from tokenizers import Tokenizer

    tokens = Tokenizer.from_file(packing.tokenizer_paths()[0])
    got = packing.pack(packing.pieces(docs)).collect()
    wanted = []
    for r in ROWS:
        ids = np.array([*tokens.encode(r[1] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        first = len(ids) % 2048 or 2048
        starts = [0, *range(first, len(ids), 2048)]
        ends = [*starts[1:], len(ids)]
        wanted += [(r[0], k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(starts, ends, strict=True))]
    same([tuple(r)[:5] for r in got], wanted)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) == -(-sum(r["length"] for r in got) // 2048)
    assert packing.pack(packing.pieces(empty)).count() == 0


def test_fullest_is_the_best_subset():
    rng = np.random.default_rng(1)
    for _ in range(50):
        counts = np.zeros(41, dtype=np.int64)
        for n in rng.integers(5, 40, 4):
            counts[n] += rng.integers(1, 3)
        room = int(rng.integers(1, 41))
        used = packing.fullest(counts, room)
        assert all(k <= counts[n] for n, k in used)
        reach = {0}
        for n in np.flatnonzero(counts):
            for _ in range(counts[n]):
                reach |= {x + int(n) for x in reach if x + n <= room}
        assert sum(n * k for n, k in used) == max(reach)


# ---- 4: mixing ----


def test_mixture(spark, docs, empty):
    got = mixing.mixture(docs).collect()
    sizes = Counter()
    for r in ROWS:
        sizes[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    total, target = float(sum(sizes.values())), {}
    free, left = set(sizes), total
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 3 * sizes[s]}
        if not over:
            target |= {s: weight[s] * level for s in free}
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(target[s] for s in over)
        free -= over
    source = {r[0]: r[3] for r in ROWS if r[0] is not None}
    for r in got:
        if r["doc_id"] is not None:
            s = source[r["doc_id"]]
            assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(target[s])
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
    longest = Counter()
    for r in ROWS:
        longest[r[3]] = max(longest[r[3]], len((r[1] or "").split()))
    for s in sizes:
        mine = [r["taken"] for r in got if source.get(r["doc_id"], "s1" if r["size"] else None) == s]
        assert abs(sum(mine) - target[s]) <= max(longest[s] / 2, 1)
    same(mixing.mixture(docs.repartition(5)).collect(), map(tuple, got))
    assert mixing.mixture(empty).count() == 0
    rows = mixing.mixed(docs, 4).select("__row.*", "shard").collect()
    copies = Counter(r["doc_id"] for r in rows if r["doc_id"] is not None)
    assert {k: v for k, v in copies.items() if k not in (0,)} == {r["doc_id"]: r["taken"] // r["size"] for r in got if r["doc_id"] not in (None, 0) and r["taken"]} | {k: v for k, v in copies.items() if not sum(1 for r in got if r["doc_id"] == k and r["size"])}
    assert {len(r) for r in rows} == {len(docs.columns) + 1}
    assert mixing.mixed(empty, 4).count() == 0


def test_mixture_deals_copies_through_the_tree(spark, docs, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 100)
    told = Counter()
    for r in mixing.mixture(docs, 4).collect():
        shards, places = (r[c].split("|") if r[c] else [] for c in ("shards", "places"))
        assert len(shards) == len(places) and r["taken"] == len(shards) * r["size"]
        told.update((r["doc_id"], int(s), int(p)) for s, p in zip(shards, places, strict=True))
    wanted = mixing.mixed(docs, 4).select("__row.doc_id", "shard", "place").collect()
    assert told == Counter(map(tuple, wanted)) and {s for _, s, _ in told} == {0, 1, 2, 3}


@pytest.mark.parametrize("rows", [1, 7])
def test_cells_are_cut_until_they_are_small(spark, docs, monkeypatch, rows):
    """Finer cells change which documents are taken, not how near the target is met."""
    monkeypatch.setattr(mixing, "EDGE_ROWS", rows)
    monkeypatch.setattr(mixing, "BLOCKS", 3)
    got = mixing.mixture(docs, 4).collect()
    longest = max(len((r[1] or "").split()) for r in ROWS)
    by_target = Counter()
    for r in got:
        by_target[r["target"]] += r["taken"]
        assert r["taken"] <= 3 * r["size"]
    assert len(got) == len(ROWS)
    for target, words in by_target.items():
        assert abs(words - target) <= longest
    copies = Counter(r["doc_id"] for r in mixing.mixed(docs, 4).select("__row.doc_id").collect())
    told = Counter()
    for r in got:
        told[r["doc_id"]] += len(r["shards"].split("|")) if r["shards"] else 0
    assert +told == copies


def keyed(*values):
    """Spark's xxhash64 of the seed and values: (int, bytes of it), strings, or nulls, which leave the hash as it is."""
    h = 42
    for v in ((mixing.SEED, 4), *values):
        if v is not None:
            raw = v.encode() if isinstance(v, str) else v[0].to_bytes(v[1], "little", signed=True)
            h = xxhash.xxh64(raw, seed=h).intdigest()
    return h - (1 << 64) if h >> 63 else h


def plain_draw(u, own, units, draws):
    low, high = max(0, draws - (units - own)), min(own, draws)
    mode = min(high, max(low, (draws + 1) * (own + 1) // (units + 2)))
    order = [mode, *range(mode + 1, high + 1), *range(mode - 1, low - 1, -1)]
    weight = {k: comb(own, k) * comb(units - own, draws - k) for k in order}
    goal, total = u * sum(weight.values()), 0
    for k in order:
        total += weight[k]
        if total >= goal:
            return k


def plain_tree(units, shards):
    """{source: [units of each shard]} by a recursion over the shards."""
    order = sorted(units, key=lambda s: (s is None, s or ""))

    def split(node, level, own, width):
        if width == 1:
            return [own]
        total = sum(own.values())
        half = (total + keyed((node, 8)) % 2) // 2
        used = drawn = 0
        left = {}
        for s in order:
            u = (keyed("draw", (node, 8), str(level), s or "") % (1 << 40) + 0.5) / (1 << 40)
            left[s] = plain_draw(u, own[s], total - used, half - drawn)
            used, drawn = used + own[s], drawn + left[s]
        return split(2 * node, level + 1, left, width // 2) + split(2 * node + 1, level + 1, {s: own[s] - left[s] for s in order}, width // 2)

    leaves = split(0, 0, units, shards)
    return {s: [leaf[s] for leaf in leaves] for s in order}


def test_shards_against_a_plain_tree(spark, docs, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 100)
    got = mixing.mixture(docs, 8).collect()
    sizes = Counter()
    for r in ROWS:
        sizes[r[3]] += len((r[1] or "").split())
    text = {(r[0], len((r[1] or "").split())): r for r in ROWS}
    rows, copies = [], Counter()
    for r in got:
        given = text[r["doc_id"], r["size"]]
        blocks = max(1, min(mixing.BLOCKS, -(-sizes[given[3]] // 100)))
        block = (given[3], keyed(given[3], (given[0], 8) if given[0] is not None else None, given[1]) % blocks)
        mine = [int(x) for x in r["shards"].split("|")] if r["shards"] else []
        copies[block] = max(copies[block], len(mine))
        rows.append((block, mine))
    units = {s: sum(n for (t, _), n in copies.items() if t == s) for s in sizes}
    units = {s: n for s, n in units.items() if n}
    shard_of = {}
    for s, quota in plain_tree(units, 8).items():
        mine = sorted(((at, c) for (t, at), n in copies.items() if t == s for c in range(1, n + 1)), key=lambda x: (keyed("unit", (x[0], 4), (x[1], 4)), x))
        each = [k for k, n in enumerate(quota) for _ in range(n)]
        shard_of |= {(s, *x): k for x, k in zip(mine, each, strict=True)}
    assert sum(units.values()) > 40
    for (s, at), mine in rows:
        assert mine == [shard_of[s, at, c] for c in range(1, len(mine) + 1)]


def test_rows_that_repeat_are_taken_in_part(spark):
    """Equal rows differ in nothing, so some of them are taken."""
    rows = [(None, "same words here and there", "a")] * 60 + [(k, "one two three", "b") for k in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixture(df, 2).where("doc_id is null").collect()
    assert len(got) == 60 and abs(sum(r["taken"] for r in got) - got[0]["target"]) <= 3
    assert mixing.mixed(df, 2).where("__row.doc_id is null").count() * 5 == sum(r["taken"] for r in got)


def test_many_sources_are_drawn_in_groups(spark, monkeypatch):
    units = [(f"s{k}", k % 7) for k in range(300)] + [(None, 40)]
    df = spark.createDataFrame(units, "source string, units long")
    for fan in (64, 4):
        monkeypatch.setattr(mixing, "FAN", fan)
        got = mixing.quotas(df, 4).collect()
        shards, sources = Counter(), Counter()
        for r in got:
            assert r["quota"] >= 0
            shards[r["shard"]] += r["quota"]
            sources[r["source"]] += r["quota"]
        assert sources == dict(units) and max(shards.values()) - min(shards.values()) <= 1


def test_draws_over_wide_ranges(spark):
    u = (F.col("id") + 0.5) / 2000
    got = np.array([r[0] for r in spark.range(2000).select(mixing._draw(u, F.lit(200_000), F.lit(1_000_000), F.lit(500_000))).collect()])
    sd = (500_000 * 0.2 * 0.8 * 0.5) ** 0.5
    assert got.mean() == pytest.approx(100_000, abs=1) and got.std() == pytest.approx(sd, rel=0.01)


def test_tree_splits_exactly(spark):
    units = spark.createDataFrame([("a", 1000), ("b", 37), ("c", 0), (None, 5), ("d", 333)], "source string, units int")
    got = mixing.quotas(units, 8).collect()
    by_shard, by_source = Counter(), Counter()
    for r in got:
        assert r["quota"] >= 0
        by_shard[r["shard"]] += r["quota"]
        by_source[r["source"]] += r["quota"]
    assert by_source == {"a": 1000, "b": 37, "c": 0, None: 5, "d": 333} and max(by_shard.values()) - min(by_shard.values()) <= 1


def test_draws_are_hypergeometric(spark):
    u = (F.col("id") + 0.5) / 20000
    got = spark.range(20000).select(mixing._draw(u, F.lit(6), F.lit(20), F.lit(8)).alias("k")).groupBy("k").count().collect()
    for r in got:
        assert r["count"] / 20000 == pytest.approx(comb(6, r["k"]) * comb(14, 8 - r["k"]) / comb(20, 8), abs=2e-3)


# ---- 5: near duplicates ----


def plain_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]+", lambda m: m[0].lower(), (text or "").encode()))
    grams = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    return [find(k) for k in range(len(prints))]


def test_near_duplicates(spark, docs, empty):
    prints = [plain_print(r[1]) for r in ROWS]
    roots = plain_groups(prints)
    least = {}
    for r, g in zip(ROWS, roots, strict=True):
        least[g] = min(x for x in (least.get(g), r[0]) if x is not None) if (least.get(g), r[0]) != (None, None) else None
    found = simhash.groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id").collect()
    same(found, [(r[0], f"{p:016x}", least[g]) for r, p, g in zip(ROWS, prints, roots, strict=True)])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(set(roots))
    assert simhash.groups(empty).count() == 0 and simhash.keep_one(empty).count() == 0


@pytest.mark.parametrize("members", [4, 10_000])
def test_links_join_all_within_the_budget(spark, members):
    rng = random.Random(9)
    centre = rng.getrandbits(64)
    prints = {rng.getrandbits(64) for _ in range(200)} | {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(150)}
    prints |= {p ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for p in list(prints)[:60]}
    prints = sorted(prints)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    df = spark.createDataFrame(signed, "fp long")
    found = simhash.components(simhash.links(df, members)).collect()
    label = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in found}
    mine = Counter(label.get(p, p) for p in prints)
    assert sorted(mine.values()) == sorted(Counter(plain_groups(prints)).values())


@pytest.mark.parametrize("lookup", [0, 1 << 40])
def test_both_ways_to_search_a_key_join_the_same(monkeypatch, lookup):
    monkeypatch.setattr(simhash, "LOOKUP", lookup)
    rng = random.Random(2)
    for kind in (0, 5):
        bits = simhash.free_bits(kind)[5:17]
        prints = sorted({sum(1 << b for b in bits if rng.random() < 0.3) for _ in range(60)})
        two, three = map(int, simhash._chain_masks(kind))
        wanted = list(range(len(prints)))
        for _ in prints:  # labels spread until nothing changes
            for i, a in enumerate(prints):
                for j, b in enumerate(prints):
                    d = a ^ b
                    if d.bit_count() <= 3 and (d & two).bit_count() <= 1 and (d & three).bit_count() <= 2:
                        wanted[i] = wanted[j] = min(wanted[i], wanted[j])
        root = {p: p for p in prints}
        for a, b in simhash._search(kind, np.array(prints, dtype=np.uint64)):
            old, new = root[b], root[a]
            root = {p: new if r == old else r for p, r in root.items()}
        groups = lambda labels: sorted(sorted(p for p, x in zip(prints, labels) if x == y) for y in set(labels))
        assert groups([root[p] for p in prints]) == groups(wanted)


# ---- 6: urls ----


def test_urls(spark):
    pages = [(1, "HTTP://A.Example.NET/en/x?q", 1), (2, "https://example.com/de/", 1), (3, "http://x.org/fr/a#b", 1), (4, "http://net", 1), (5, "http://www.net/y", 1), (6, None, 1), (7, "no scheme", 1), (8, "x://?q", 1), (8, "x://?q", 1), (None, "http://b.com/", 1)]
    pages += [(100 + k, f"http://bad.com/{k}", 1) for k in range(60)] + [(200 + k, f"http://fine.com/{k}", 1) for k in range(60)]
    df = spark.createDataFrame(pages, "page_id long, url string, bad int")
    outcomes = spark.createDataFrame([(100 + k, True) for k in range(40)] + [(200 + k, False) for k in range(40)] + [(100, True), (6, None), (999, True)], "page_id long, bad boolean")
    got = {r["page_id"]: tuple(r)[1:] for r in urls.judge(df, outcomes).collect()}
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[2] == ("example.com", "/de/", "example.com/de/", "block")
    assert got[3] == ("x.org", "/fr/a", "org/fr/", "allow")
    assert got[4] == ("net", "", None, "allow") and got[5] == ("www.net", "/y", "net/", "block")
    assert got[6][:3] == got[7][:3] == got[8][:3] == ("", "", None)
    assert got[150][3] == "block" and got[250][3] == "allow"
    assert urls.judge(df, outcomes).count() == len(pages)
    assert urls.judge(df, outcomes.limit(0)).where("page_id = 150 and verdict = 'allow'").count() == 1
    assert urls.judge(df.limit(0), outcomes).count() == 0


# ---- 7: repeated substrings ----


def plain_removed(rows):
    """In the order of doc_id; rows that repeat a doc_id have equal texts here or are told apart by none of the digests."""
    seen, out = set(), []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            s = b[k : k + 100]
            if s in seen:
                gone[k : k + 100] = b"\x01" * 100
            seen.add(s)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [4096, 2])
def test_repeated_substrings(spark, docs, empty, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "SORTED", 500)
    rows = sorted(((r[0], r[1]) for r in ROWS), key=lambda r: (r[0] is None, r[0] or 0, r[1] is None))
    got = substrings.removed(docs, digest=True).select("doc_id", "n_bytes", "n_removed", "n_spans", F.lower(F.hex("kept"))).collect()
    same(got, plain_removed(rows))
    assert substrings.removed(empty).count() == 0


def test_suffix_array_is_in_order(monkeypatch):
    rng = np.random.default_rng(3)
    flat = rng.integers(0, 2, 3000).astype(np.uint8)  # zero bytes, too
    flat[1500:2000] = flat[200:700]
    at = rng.permutation(len(flat) - 99)
    doc, rid = rng.integers(0, 3, len(at)), rng.integers(0, 2, len(at))
    sa, shares = substrings.suffix_array(flat, at, doc, rid, at)
    raw = flat.tobytes()
    wanted = sorted(range(len(at)), key=lambda k: (raw[at[k] : at[k] + 100], doc[k], rid[k], at[k]))
    assert sa.tolist() == wanted and shares.any()
    assert [raw[at[a] : at[a] + 100] == raw[at[b] : at[b] + 100] for a, b in zip(wanted, wanted[1:])] == shares[1:].tolist()


def test_no_table_is_left_behind(spark, docs):
    before = {t.name for t in spark.catalog.listTables()}
    out = substrings.removed(docs)
    assert {t.name for t in spark.catalog.listTables()} == before and out.count() == len(ROWS)


def test_parse_does_not_depend_on_slices(monkeypatch):
    raw = np.frombuffer(prose(random.Random(4), 2000).encode(), dtype=np.uint8)
    cuts, found = substrings.cuts(raw), substrings.anchors(raw)
    monkeypatch.setattr(substrings, "SLICE", 1000)
    assert cuts.tolist() == substrings.cuts(raw).tolist()
    again = substrings.anchors(raw)
    assert sorted(set(found[0])) == sorted(set(again[0]))
    spread = lambda x: {k: p for p, _, a, b in zip(*x, strict=True) for k in range(a, b + 1)}
    assert spread(found) == spread(again)


# ---- 8: licenses ----


def test_licenses(spark, docs, empty):
    got = licenses.scanned(docs).collect()
    assert len(got) == len(ROWS)
    phrases = [(p.split(), label) for p, label in licenses.BASE]
    wanted = []
    for r in ROWS:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), r[1] or ""))
        at = [(k, label) for p, label in phrases for k in range(len(words)) if words[k : k + len(p)] == p]
        places = [k for k, _ in at]
        wanted.append((r[0], len(words), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({label for _, label in at}))))
    same([tuple(r)[:6] for r in got], wanted)
    for r in got:
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    found = next(r for r in got if r["doc_id"] == 41)
    assert found["labels"] == "cc-by,gpl,gpl-3.0,mit" and found["score"] == 1.0
    assert licenses.scanned(empty).count() == 0


def test_standard_notices_are_labelled(spark):
    gpl = "* This program is free software; you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version {} of the License, or\n * (at your option) any later version."
    mit = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'
    rows = [(0, gpl.format(2)), (1, gpl.format(3)), (2, mit), (3, gpl.format(3).replace("either version 3 of the License", "and so on"))]
    got = {r["doc_id"]: r for r in licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k]["labels"] for k in range(4)] == ["gpl,gpl-2.0", "gpl,gpl-3.0", "mit", "gpl"]
    assert [got[k]["score"] for k in range(3)] == [1.0, 1.0, 1.0]


def test_whole_licence_texts_are_labelled(spark):
    filler = "some code here then more code " * 30
    rows = [(k, f"{filler} {text} {filler}") for k, (_, text, _) in enumerate(licenses.TEMPLATES)]
    n = len(rows)
    mit = licenses.MIT_TEXT.replace("the software without restriction", "the software program without restriction")
    rows += [(n, f"{filler} {mit}"), *((n + 1 + k, filler + " ".join(part)) for k, part in enumerate((licenses.ZLIB_TEXT.split()[:60], licenses.ZLIB_TEXT.split()[60:])))]
    got = {r["doc_id"]: r for r in licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (label, _, _) in enumerate(licenses.TEMPLATES):
        assert label in got[k]["labels"].split(","), label
        assert got[k]["score"] == 1.0
    assert got[n]["labels"] == "mit"  # a word put in moves no vote away
    halves = [got[n + 1], got[n + 2]]
    assert [r["labels"] for r in halves] == ["", ""] and 0 < max(r["score"] for r in halves) < 1


# ---- 9: quality ----


def plain_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    times = Counter(grams)
    covered = {k + j for k, g in enumerate(grams) if times[g] > 1 for j in range(3)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_quality(spark, docs, empty):
    got = quality.quality_report(docs).collect()
    same([tuple(r)[:7] for r in got], [(r[0], *plain_measures(r[1])) for r in ROWS])
    rejected = {r["host"]: r["rejected"] for r in quality.host_verdicts(quality.measured(docs.select("source", "text")).withColumn("failed", quality.rule_failed())).collect()}
    source = {r[0]: r[3] for r in ROWS if r[0] is not None}
    assert all(r["kept"] == (not r["base_failed"] and not rejected[source[r["doc_id"]]]) for r in got if r["doc_id"] is not None)
    kept = quality.keep_documents(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got)
    assert quality.quality_report(empty).count() == 0 and quality.keep_documents(empty).count() == 0


def test_bad_hosts_lose_their_documents(spark):
    rng = random.Random(6)
    rows = [(k, "short" if k % 20 else prose(rng, 80), "bad") for k in range(200)] + [(k + 200, prose(rng, 80) if k % 20 else "short", "good") for k in range(200)]
    got = quality.quality_report(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert got.where("kept").count() == 190
    assert got.where("kept and doc_id < 200").count() == 0


def test_the_query_rejects_a_bad_host(spark, tmp_path):
    rng = random.Random(6)
    rows = [(k, "short" if k % 20 else prose(rng, 80), "bad" if k < 100 else None) for k in range(200)] + [(k + 200, prose(rng, 80) if k % 20 else "short", "good") for k in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op9_quality_rules"](spark, str(tmp_path))
    assert got.where("kept").count() == 190 and got.where("not base_failed and not kept").count() == 10


# ---- 10: secrets ----


def plain_secrets(text):
    text = text or ""
    assign = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    said = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))
    return *(sum(k == n for _, k, _ in found) for n in range(3)), hashlib.sha256(said.encode()).hexdigest()


def plain_spans(text):
    """All kinds, those of the method's own by runs of characters."""
    text = text or ""
    base = ("assign", r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 8), ("access", "(AKIA[A-Z0-9]+)", 0, 16), ("hex", "([0-9a-f]+)", 0, 32)
    found = [(m.start(), k, m.end(), kind) for k, (kind, p, flags, least) in enumerate(base) for m in re.finditer(p, text, flags) if len(m[1]) >= least]
    found += [(m.start(), 3, m.end(), "pem") for m in re.finditer("-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\\s]*(-----END [A-Z ]*PRIVATE KEY-----)?", text)]
    for k, kind, heads, more, least in ((4, "github", [f"gh{c}_" for c in "pousr"], "", 40), (5, "slack", [f"xox{c}-" for c in "abprs"], "-", 20)):
        at = 0
        while at < len(text):
            end = at + len(heads[0])
            if text[at:end] in heads:
                while end < len(text) and (text[end].isascii() and text[end].isalnum() or text[end] in more and more):
                    end += 1
                if end > at + len(heads[0]):
                    found += [(at, k, end, kind)] if end - at >= least else []
                    at = end
                    continue
            at += 1
    runs, k = [(m.start(), m.end()) for m in re.finditer("[A-Za-z0-9_-]+", text)], 0
    while k + 2 < len(runs):
        (a, b), (c, d), (e, f) = runs[k : k + 3]
        if text[b:c] == text[d:e] == "." and all(text[x : x + 3] == "eyJ" and y - x > 3 for x, y in ((a, b), (c, d))):
            found += [(a, 6, f, "jwt")] if f - a >= 40 else []
            k += 3
        else:
            k += 1
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found))


def test_own_kinds_of_secrets():
    rng = random.Random(9)
    parts = ["eyJ", "eyJabc", ".", "a1_", "-", " ", "ghp_", "gho_", "x" * 40, "xoxb-", "xoxz-", "12-ab-" * 4, "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----", "AbC+/=", "\n", "AKIA" + "Z" * 14, "0af1" * 9, "token=", "é"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert secrets.digest(text) == (*plain_secrets(text), plain_spans(text)), text


def test_secrets(spark, docs, empty):
    got = secrets.findings(docs).collect()
    same([tuple(r)[:5] for r in got], [(r[0], *plain_secrets(r[1])) for r in ROWS])
    assert next(r for r in got if r["doc_id"] == 44)["spans"].startswith("pem:0:")
    assert secrets.findings(empty).count() == 0
    clean = secrets.redacted(docs)
    assert clean.columns == docs.columns and clean.count() == len(ROWS)
    text = clean.where("doc_id = 40").first()["text"]
    assert "[ASSIGN]" in text and "[ACCESS]" in text and "[HEX]" in text and plain_secrets(text)[:3] == (0, 0, 0)


def test_ledger_scans_only_unseen_blobs(spark, docs, tmp_path, monkeypatch):
    first = secrets.scan(docs)
    blobs = len({r[1] or "" for r in ROWS})
    assert first.count() == blobs
    ledger = str(tmp_path / "ledger")
    plain = list(map(tuple, secrets.findings(docs).collect()))
    rows = lambda: secrets.ledger_at(spark, ledger).count()
    for _ in range(2):  # the second run finds all blobs in the ledger
        same(secrets.findings(docs, ledger).collect(), plain)
        assert rows() == blobs
    new = docs.union(docs.limit(1).withColumn("text", F.lit("fresh token=abcdefgh1")))
    assert secrets.scan(new, secrets.ledger_at(spark, ledger)).count() == 1
    assert secrets.findings(new, ledger).count() == len(ROWS) + 1 and rows() == blobs + 1
    monkeypatch.setattr(secrets, "RULE_VERSION", "next")
    same(secrets.findings(docs, ledger).collect(), plain)
    assert rows() == 2 * blobs + 1


def test_every_version_of_a_path_is_scanned(spark):
    rows = [("a", 1, "token=abcdefgh1"), ("a", 2, "clean"), ("b", 7, "clean"), ("a", 3, None), (None, 4, "token=abcdefgh1")]
    history = spark.createDataFrame(rows, "path string, version long, text string")
    got = {(r["path"], r["version"]): r["n_assign"] for r in secrets.findings(history, keys=("path", "version")).collect()}
    assert got == {("a", 1): 1, ("a", 2): 0, ("b", 7): 0, ("a", 3): 0, (None, 4): 1}


def test_the_query_uses_the_sessions_ledger(spark, tmp_path):
    query = queries.QUERIES["op10_secret_scans"]
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    plain = list(map(tuple, query(spark, str(tmp_path)).collect()))
    spark.conf.set(secrets.LEDGER_SETTING, str(tmp_path / "ledger"))
    try:
        for _ in range(2):
            same(query(spark, str(tmp_path)).collect(), plain)
    finally:
        spark.conf.unset(secrets.LEDGER_SETTING)
    assert secrets.ledger_at(spark, str(tmp_path / "ledger")).count() == len({r[1] or "" for r in ROWS})


# ---- rows that repeat, ties, names ----


def test_ties_are_told_by_texts(spark):
    """Rows that share an id, or have none, give the same whatever the order and partitions of the input."""
    rng = random.Random(8)
    passage, own = prose(rng, 60), [prose(rng, 40) for _ in range(8)]
    rows = [(k, f"{own[n]} {passage} {own[-n]}") for n in range(8) for k in (7, None)]
    kept = []
    for order, parts in ((rows, 1), (rows[::-1], 1), (rng.sample(rows, len(rows)), 4)):
        docs = spark.createDataFrame(order, "doc_id long, text string").repartition(parts)
        out = substrings.removed(docs.sortWithinPartitions(F.rand(parts)) if parts > 1 else spark.createDataFrame(order, "doc_id long, text string").coalesce(1))
        kept.append(sorted((str(r["doc_id"]), r["n_removed"], bytes(r["kept"])) for r in out.collect()))
    assert kept[0] == kept[1] == kept[2] and len({n for _, n, _ in kept[0]}) > 1


def test_a_failed_run_leaves_no_table(spark, monkeypatch):
    def fails(*args, **named):
        raise RuntimeError("killed")

    monkeypatch.setattr(substrings, "_parse", fails)
    with pytest.raises(Exception, match="killed|_parse"):
        substrings.removed(spark.createDataFrame([(1, "x" * 300)], "doc_id long, text string"))
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("quillmill_texts")]


def test_equal_pieces_are_spread(spark):
    """Rows that are equal in id and text are ranked in many parts."""
    held = common.materialize(spark.range(0, 4000, 1, 8).selectExpr("cast(null AS bigint) AS doc_id", "0 AS piece", "'' AS tie", "1 AS length"), "equal")
    out = packing.ranked(held)
    assert sorted(r["rank"] for r in out.collect()) == list(range(4000))
    parts = held.select(F.pmod(F.xxhash64("_metadata.file_name", "_metadata.row_index"), F.lit(4)).alias("p")).groupBy("p").count().collect()
    assert len(parts) == 4 and max(r["count"] for r in parts) < 1500


def test_the_fit_takes_a_bounded_sample(spark, monkeypatch):
    rows = [(k % 4, f"text {j} of {k % 4}") for k in range(400) for j in (k % 50,)] + [(9, "long " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(0, 0), (1, 1), (2, 0), (3, 1), (9, 1)], "doc_id long, toxic int")
    joined = docs.join(labels, "doc_id").select("toxic", F.xxhash64("doc_id", "text").alias("at"), "text")
    assert {k: n for k, n in toxicity.bounded(joined, 5).groupBy("toxic").count().collect()} == {0: 5, 1: 5}
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 200)
    kept = toxicity.bounded(joined, 50).join(joined, ["toxic", "at"]).select("toxic", "text").distinct().collect()
    for k in (0, 1):
        own = [len(r["text"]) for r in kept if r["toxic"] == k]
        assert own and (sum(own) <= 100 or len(own) == 1)


def test_secrets_in_linear_time():
    for text in ("eyJ" * 350_000, "eyJ." * 250_000, ("eyJ" + "a" * 1000 + ".") * 1000, "xox" * 300_000, "ghp_" * 250_000, "-----BEGIN " * 90_000, "password" + " " * 1_000_000, "AKIA" * 250_000, "token=" * 150_000):
        began = time.process_time()
        secrets.find(text)
        assert time.process_time() - began < 1, text[:20]
    token = "eyJ" + "a" * 20 + ".eyJ" + "b" * 20 + ".sig-_9"
    assert [(a, b) for a, k, b in secrets.find(f"a {token} b") if secrets.RULES[k][0] == "jwt"] == [(2, 2 + len(token))]


def test_stages_take_any_column_names(spark):
    names = ["source", "k_id", "k_none", "k_fp", "__k_id", "blob", "spans", "__blob", "__spans", "sha", "row", "clean", "a.b", "row.text", "doc id"]
    rows = [(k, "words of text token=abcdefgh1 " * (1 + k % 2), 30, *(f"{n}{k}" for n in names)) for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, " + ", ".join(f"`{n}` string" for n in names))
    for out, left in ((simhash.keep_one(docs), 2), (secrets.redacted(docs), 4), (quality.keep_documents(docs), None)):
        assert out.columns == docs.columns
        got = [tuple(r) for r in out.collect()]
        assert left is None or len(got) == left
        assert all(r[3:] == tuple(f"{n}{r[0]}" for n in names) for r in got)
