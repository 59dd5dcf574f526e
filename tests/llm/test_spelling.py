"""Spelling variants against a plain comparison of all words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from quillmill.llm import spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    a, b = sorted((a, b), key=len)
    if a == b or len(b) - len(a) > 1:
        return False
    return sum(x != y for x, y in zip(a, b, strict=True)) == 1 if len(a) == len(b) else any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_counts(docs):
    found = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def plain(docs):
    counts = plain_counts(docs)
    around = {w: [v for v in counts if near(v, w)] for w in counts}
    best = {w: min(v, key=lambda x: (-counts[x], x)) if v else None for w, v in around.items()}
    form = {w: v if v and counts[v] >= 10 * counts[w] else None for w, v in best.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w] or "", root(w), n, len(around[w]), counts.get(form[w], 0)) for w, n in counts.items())


def texts(seed):
    """Words of one stem with edits, in counts that make chains of forms."""
    rng = random.Random(seed)
    letters = "abé"
    stems = ["".join(rng.choice(letters) for _ in range(rng.randint(7, 9))) for _ in range(12)] + ["ab" * 40, "ab" * 40 + "a", "aaaaaaa", "aaaaaaaa", "straßenà"]
    words = []
    for stem in stems:
        words += [stem.title()] * rng.choice([2, 30, 400])
        for _ in range(10):
            k, kind = rng.randrange(len(stem)), rng.randrange(3)
            edited = stem[:k] + ("" if kind == 0 else rng.choice(letters)) + stem[k + (kind != 2) :]
            words += [edited] * rng.choice([2, 3, 25])
    rng.shuffle(words)
    docs = [(k if k % 7 else None, rng.choice([" ", ", ", "\n", "1"]).join(words[a : a + 50])) for k, a in enumerate(range(0, len(words), 50))]
    return [*docs, docs[0], (5, None), (6, ""), (7, "x" * 3000 + " " + "x" * 3000 + " " + "x" * 2999 + " " + "x" * 2999)]


def collected(df):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"] or 0) for r in df.collect())


def frame(spark, docs):
    return spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, word string, id long")


@pytest.mark.parametrize(("seed", "unit"), [(1, 14), (2, 3), (4, 0), (6, 1)])
def test_variants(spark, monkeypatch, seed, unit):
    """Units of any size, as small as one word, give the same pairs."""
    monkeypatch.setattr(spelling, "UNIT", unit)
    docs = texts(seed)
    wanted = plain(docs)
    assert any(w[1] and w[2] != w[1] for w in wanted) and max(w[4] for w in wanted) > 3 and any(len(w[0]) > spelling.SHORT for w in wanted)
    assert collected(spelling.variants(frame(spark, docs).repartition(3))) == wanted


def test_each_pair_comes_up_once():
    rng = random.Random(1)
    for _ in range(200):
        words = sorted({"".join(rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(1, 60))})
        at, pairs, wild = {w: k for k, w in enumerate(words)}, [], {}
        for under, text, k in spelling.merged(words, {}):
            if under:
                wild.setdefault(text, []).append(k)
            elif text in at:
                pairs.append(tuple(sorted((k, at[text]))))
        pairs += [(a, b) for group in wild.values() for i, a in enumerate(sorted(group)) for b in sorted(group)[i + 1 :]]
        assert sorted(pairs) == [(a, b) for a in range(len(words)) for b in range(a + 1, len(words)) if near(words[a], words[b])]


def test_words_are_sent_a_few_times():
    """Small-to-large: a word is below few light children, whatever the shape of the trie."""
    rng = random.Random(2)
    for words in (sorted({"".join(rng.choice("abcdefgh") for _ in range(8)) for _ in range(3000)}), ["a" * k for k in range(1, 400)], sorted("a" * k + "b" for k in range(400))):
        sent = Counter(k for _, _, k in spelling.merged(words, {}))
        assert max(sent.values()) <= 4 * (len(words).bit_length() + 1)


def test_no_words(spark):
    assert spelling.variants(frame(spark, [])).count() == 0
    assert spelling.variants(frame(spark, [(1, "short words only"), (2, None)])).count() == 0


def test_roots_of_long_chains(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(18)], "id long, up long")
    assert sorted(map(tuple, spelling.roots(links).collect())) == [(k, 18) for k in range(18)]
