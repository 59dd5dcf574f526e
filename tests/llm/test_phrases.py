"""Phrase collocations against a plain count of all phrases."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from quillmill.llm import phrases, tokens

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, top=2000):
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    candidates = {p: n for p, n in f.items() if len(p[1]) > 1 and n >= 30}
    out = []
    for (lang, words), a in candidates.items():
        cuts = [(2000000 * a // (f[lang, words[:k]] + f[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        holds = lambda big: any(big[i : i + len(words)] == words for i in range(len(big) - len(words) + 1))
        if not any(other == lang and len(big) > len(words) and 100 * n >= 80 * a and holds(big) for (other, big), n in candidates.items()):
            out.append((lang, -score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]]))
    told, rank = [], Counter()
    for lang, score, a, phrase, left, right in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            told.append((lang, rank[lang], phrase.decode(), -a, left, right, total[lang], -score))
    return told


def rows_of(seed):
    rng = random.Random(seed)
    words = ["a", "b", "C", "dé", "日本", "f\x85g", "x" * 300]
    rows = [(rng.choice(["en", None, "und", "", "\0"]), "".join(rng.choice(words) + rng.choice([" ", "  ", "\t", " ", " ", ". ", "\n", ",", "\r\n"]) for _ in range(rng.randint(0, 200)))) for _ in range(400)]
    return [*rows, *rows[:5], ("en", None), ("en", ""), ("en", " \t"), ("en", "a b c dé " * 4000), ("fr", "...")]


COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collected(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(lang, text, "x", 1) for lang, text in rows], "lang string, text string, phrase string, n long")


@pytest.mark.parametrize("top", [2000, 3])
def test_collocations(spark, top):
    rows = rows_of(1)
    wanted = plain(rows, top)
    assert len({w[0] for w in wanted}) >= 4 and any(" " in w[2].replace(" ", "", 1) for w in wanted)
    assert collected(phrases.collocations(frame(spark, rows).repartition(5), top)) == sorted(wanted)


@pytest.mark.parametrize("bits", [3, 9])
def test_full_buckets_change_nothing(spark, monkeypatch, bits):
    """With so few buckets nearly all are set; what passes in vain goes by the exact count."""
    monkeypatch.setattr(phrases, "BITS", bits)
    monkeypatch.setattr(phrases, "SEGMENT", 3)
    rows = rows_of(2)
    assert collected(phrases.collocations(frame(spark, rows))) == sorted(plain(rows))


def test_no_rows_without_candidates(spark):
    assert phrases.collocations(frame(spark, [])).count() == 0
    assert phrases.collocations(frame(spark, [("en", "a b c"), (None, None)])).count() == 0


def test_long_texts_are_cut_at_marks(monkeypatch):
    monkeypatch.setattr(phrases, "SLICE", 50)
    text = b"one two. three four, five six; " * 20 + b"x" * 200
    groups = list(phrases.pieces([text, b"", b"short", text]))
    assert b"".join(t for g in groups for k, t in g if k == 0) == text
    assert all(sum(len(t) for _, t in g) <= 50 or len(g) == 1 for g in groups)


def test_hashes_do_not_depend_on_place(monkeypatch):
    words = [b"a", b"bc", b"x" * 100, b"", "é".encode(), b"a"]
    whole = []
    for chunk in (1 << 18, 7):
        monkeypatch.setattr(tokens, "CHUNK", chunk)
        monkeypatch.setattr(tokens, "POWERS", tuple(tokens.powers(b) for b in tokens.BASES))
        raw, begins = tokens.joined(words)
        start, end = tokens.runs(raw != 10)
        h = tokens.hashes(raw, start, end)
        assert h[0] == h[-1] and len(set(h.tolist())) == 4
        whole.append(h.tolist())
    assert whole[0] == whole[1] and np.all(begins == [0, 2, 5, 106, 107, 110])


def test_equal_first_hashes_are_told_apart():
    h, other = np.array([5, 5, 5, 7], dtype=np.uint64), np.array([1, 2, 1, 1], dtype=np.uint64)
    first, n = phrases.distinct(h, other)
    assert sorted(zip(first.tolist(), n.tolist(), strict=True)) == [(0, 2), (1, 1), (3, 1)]
