"""Decontamination against a plain search of all windows."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from quillmill.llm import common, decontamination

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain(docs, items):
    """(doc_id, n_words, n_hit, ids, longest matches) of each row."""
    out = []
    for doc_id, text in docs:
        w, hit, ids, spans = words_of(text), set(), set(), set()
        for item_id, item in items:
            v = words_of(item)
            m, item_id = min(10, len(v)), "" if item_id is None else item_id
            for p in range(len(w)):
                for s in range(len(v)):
                    if m and s + m <= len(v) and w[p : p + m] == v[s : s + m]:
                        hit |= {*range(p, p + m)}
                        ids.add(item_id)
                        if not (s and p and w[p - 1] == v[s - 1]):
                            n = next(n for n in range(m, len(v) + 1) if s + n == len(v) or w[p + n : p + n + 1] != [v[s + n]])
                            spans.add((item_id, s, p, n))
        out.append((doc_id, len(w), len(hit), tuple(sorted(ids)), tuple(sorted(spans))))
    return sorted(out, key=repr)


def made(seed, n_docs=40):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "gamma", "é", "日本", "x9", "Zed", "delta"]
    say = lambda n, k=8: " ".join(rng.choice(words[:k]) for _ in range(n))
    items = [(f"i{k}", say(rng.randint(3, 40))) for k in range(12)]
    items += [("i1", say(14)), (None, say(12)), ("short", "one lonely"), ("none", "..."), ("null", None), ("same", items[3][1].upper()), ("same2", items[3][1]), ("run", "beta " * 12)]
    docs = []
    for k in range(n_docs):
        own = [say(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 4)):
            v = words_of(rng.choice(items)[1])
            a = rng.randint(0, max(len(v) - 1, 0))
            own += [rng.choice([", ", "-", " "]).join(v[a : a + rng.randint(1, 30)]), say(rng.randint(0, 6))]
        docs.append((k // 2 if k % 5 else None, " ".join(own)))
    docs += [docs[0], docs[0], (7, None), (8, ""), (9, "One,lonely one! lonely"), (10, "beta " * 60), (11, items[3][1] + " " + items[4][1] + "\n" + items[3][1])]
    return docs, items


def frames(spark, docs, items):
    rows = [(*d, "x", 1) for d in docs]
    return spark.createDataFrame(rows, "doc_id long, text string, spans string, `a.b` long"), spark.createDataFrame(items, "item_id string, text string")


def collected(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["item_ids"]), tuple(sorted(map(tuple, r["spans"])))) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_contamination(spark, seed):
    docs, items = made(seed)
    d, i = frames(spark, docs, items)
    wanted = plain(docs, items)
    assert sum(w[2] > 0 for w in wanted) > 10 and any(w[2] == 0 and w[1] > 10 for w in wanted)
    assert collected(decontamination.contamination(d.repartition(3), i)) == wanted


def test_blocks_of_items(spark, monkeypatch):
    """Items beyond the size of a broadcast are further passes with the same result."""
    docs, items = made(3, 16)
    monkeypatch.setattr(common, "BROADCAST_BYTES", 400)
    d, i = frames(spark, docs, items)
    assert len(list(decontamination.blocks_of(i))) >= 3
    assert collected(decontamination.contamination(d, i)) == plain(docs, items)


def test_shards_and_long_documents(monkeypatch):
    docs, items = made(4)
    texts = [(t or "").encode() for _, t in docs]
    told = decontamination.Items([("" if i is None else i, t) for i, t in items if t is not None])
    whole = decontamination.spans_of(texts, told)
    monkeypatch.setattr(decontamination, "SHARD", 300)
    monkeypatch.setattr(decontamination, "PLACES", 3)
    assert decontamination.spans_of(texts, told) == whole
    for long in (1, 7, 25):
        monkeypatch.setattr(decontamination, "LONG", long)
        counts, spans = decontamination.spans_of(texts, told)
        own = lambda x: sorted(map(repr, x))
        assert counts == whole[0] and [own(x) for x in spans] == [own(x) for x in whole[1]]


def test_suffix_array_is_in_order():
    rng = random.Random(6)
    for _ in range(60):
        seq = np.array([rng.randint(0, 3) for _ in range(rng.randint(1, 60))] + [0] * 10)
        at = np.flatnonzero(seq > 0)
        for depth in (1, 3, 10):
            key = lambda p: [*seq[p : p + depth].tolist(), *[0] * (depth - len(seq[p : p + depth]))]  # noqa: E731, B023
            assert [key(p) for p in decontamination.suffix_array(seq, at, depth)] == sorted(key(p) for p in at)


def test_affected_documents_go(spark):
    docs, items = made(5)
    d, i = frames(spark, docs, items)
    kept = decontamination.decontaminated(d, i)
    assert kept.columns == d.columns
    clean = [w for w in plain(docs, items) if not w[2]]
    assert sorted(repr((r["doc_id"], len(words_of(r["text"])))) for r in kept.collect()) == sorted(repr(w[:2]) for w in clean)
    best = {r["item_id"]: r["length"] for r in decontamination.longest_matches(d, i).collect()}
    wanted = {}
    for w in plain(docs, items):
        for item_id, _, _, n in w[4]:
            wanted[item_id] = max(wanted.get(item_id, 0), n)
    assert best == wanted


def test_empty_sides(spark):
    docs, items = made(7, 4)
    d, i = frames(spark, docs, items)
    none, no_items = frames(spark, [], [])
    assert decontamination.contamination(none, i).count() == 0
    assert collected(decontamination.contamination(d, no_items)) == plain(docs, [])
    assert decontamination.decontaminated(d, no_items).count() == len(docs)


def test_query_of_windows_across_partitions(spark, tmp_path):
    docs, items = made(8)
    d, i = frames(spark, docs, items)
    d.repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    i.write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = decontamination.op12_decontamination(spark, str(tmp_path))
    wanted = [(a, n, hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), hit > 0) for a, n, hit, ids, _ in plain(docs, items)]
    assert sorted(map(repr, map(tuple, rows.collect()))) == sorted(map(repr, wanted))
