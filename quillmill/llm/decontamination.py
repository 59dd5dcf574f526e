"""Benchmark decontamination by suffix arrays of the training texts.

Each task makes word-level suffix arrays of its documents, a shard of some
``SHARD`` bytes at a time, ordered by as many words as a window has. All suffixes
of the test items are looked up in each shard at once, word by word: a binary
search inside the range that the words before left. What is left after a whole
window are all its places. Places that can't be extended to the left are followed
to the right, which gives the longest verbatim matches: where they begin in the
document and in the item, and how long they are.

A window is ``WINDOW`` words of an item; an item of fewer, but not none, is one
window. A document that holds one is affected; ``decontaminated`` removes it.

Documents aren't shuffled. The items are what every shard is asked for, so they
are broadcast, ``BROADCAST_BYTES`` of text at a time by measured size; further
blocks of items are further passes, between which spans are stored beside the rows.
Matches never cross documents; documents that are longer than a shard are cut
into parts that share a window less a word, and the matches are joined again.

Null text has no words. Rows that repeat are judged each. Items that share an
item_id count as one; a null item_id reads as ''. Without items no document is
affected.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm import common
from quillmill.llm.common import materialize, table
from quillmill.llm.tokens import hashes, joined, runs, slices

WINDOW = 10
SHARD = 8 << 20
#: Words of a document that go into one shard, and places that are followed at a time.
LONG, PLACES = 1 << 21, 1 << 20
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
SPANS = "array<struct<item_id:string,item_start:int,doc_start:bigint,length:int>>"
FOUND = f"struct<n_words:bigint,spans:{SPANS}>"
SPAN = pa.struct([("item_id", pa.string()), ("item_start", pa.int32()), ("doc_start", pa.int64()), ("length", pa.int32())])


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of each word, and the number of the text that it is in."""
    raw, begins = joined(texts)
    start, end = runs(IS_WORD[raw])
    return hashes(raw, start, end, 0), hashes(raw, start, end, 1), np.searchsorted(begins, start, side="right") - 1


class Items:
    """Distinct word sequences of test items, one after another, and the ids that have each."""

    def __init__(self, rows: list[tuple[str, str]]):
        h, other, of = words_of([t.encode() for _, t in rows])
        ids = defaultdict(set)
        for k, (item_id, _) in enumerate(rows):
            lo, hi = np.searchsorted(of, [k, k + 1])
            if lo < hi:
                ids[h[lo:hi].tobytes(), other[lo:hi].tobytes()].add(item_id)
        self.ids = [sorted(x) for x in ids.values()]
        self.h, self.other = (np.frombuffer(b"".join(k[n] for k in ids), dtype=np.uint64) for n in (0, 1))
        size = np.array([len(k[0]) // 8 for k in ids], dtype=np.int64)
        self.item = np.repeat(np.arange(len(size)), size)
        self.start = np.arange(len(self.h)) - np.repeat(np.cumsum(size) - size, size)
        self.left = np.repeat(size, size) - self.start  # words from here to the item's end
        window = np.repeat(np.minimum(size, WINDOW), size)
        self.suffixes = np.flatnonzero(self.left >= window)
        self.window = window[self.suffixes]


def suffix_array(seq: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The places ``at``, ascending, of ``seq`` in the order of the ``depth`` symbols from there; beyond its end symbols are 0."""
    if not len(at):
        return at
    bits = max(int(seq.max()).bit_length(), 1)
    done = max(1, min(depth, 62 // bits))
    padded = np.concatenate([seq, np.zeros(done, dtype=np.int64)])
    key = np.zeros(len(seq), dtype=np.int64)
    for k in range(done):
        key = key << bits | padded[k : k + len(seq)]
    order = np.argsort(key[at], kind="stable")
    sa = at[order]
    own = key[sa]
    new = np.append(True, own[1:] != own[:-1])
    # a suffix's rank is the place of the first of its equals; those equal so far are ordered by the ranks further on
    rank = np.zeros(len(seq) + 1, dtype=np.int64)
    slot = np.arange(len(sa))
    head = np.maximum.accumulate(np.where(new, slot, 0))
    rank[sa] = head + 1
    while done < depth:
        alone = new & np.append(new[1:], True)
        open_ = np.flatnonzero(~alone)
        if not len(open_):
            break
        p = sa[open_]
        pair = rank[p] << 32 | rank[np.minimum(p + done, len(seq))]
        order = np.argsort(pair, kind="stable")
        sa[open_], pair = p[order], pair[order]
        new[open_] = np.append(True, pair[1:] != pair[:-1])
        rank[sa[open_]] = np.maximum.accumulate(np.where(new, slot, 0))[open_] + 1
        done *= 2
    return sa


def narrowed(seq: np.ndarray, sa: np.ndarray, symbols: np.ndarray, suffixes: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix of ``symbols`` the range of ``sa`` that shares its ``window`` symbols; -1 in ``symbols`` is in no text."""
    lo, hi = np.zeros(len(suffixes), dtype=np.int64), np.full(len(suffixes), len(sa), dtype=np.int64)

    def bound(which: np.ndarray, goal: np.ndarray, depth: int) -> np.ndarray:
        """First slot of each range whose symbol at ``depth`` is not below the goal."""
        a, b = lo[which].copy(), hi[which].copy()
        while (some := a < b).any():
            mid = (a + b) >> 1
            below = np.zeros(len(a), dtype=bool)
            below[some] = seq[sa[mid[some]] + depth] < goal[some]
            a, b = np.where(below, mid + 1, a), np.where(some & ~below, mid, b)
        return a

    for depth in range(int(window.max(initial=0))):
        which = np.flatnonzero((window > depth) & (lo < hi))
        if not len(which):
            break
        goal = symbols[suffixes[which] + depth]
        a, b = bound(which, goal, depth), bound(which, goal + 1, depth)
        lo[which], hi[which] = a, np.where(goal > 0, b, a)
    return lo, hi


def matches(h: np.ndarray, other: np.ndarray, doc: np.ndarray, items: Items) -> np.ndarray:
    """Longest matches of a shard's words, rows of (place, index into the items' words, length)."""
    vocabulary, first, rank = np.unique(h, return_index=True, return_inverse=True)
    # a 0 after each document; ranks from 1
    gap = doc - (doc[0] if len(doc) else 0)
    place = np.arange(len(h)) + gap
    seq = np.zeros(len(h) + (int(gap[-1]) if len(gap) else 0) + 1 + WINDOW, dtype=np.int64)
    seq[place] = rank + 1
    back = np.full(len(seq), -1, dtype=np.int64)
    back[place] = np.arange(len(h))
    sa = suffix_array(seq, place, WINDOW)
    known = np.minimum(np.searchsorted(vocabulary, items.h), max(len(vocabulary) - 1, 0))
    same = (vocabulary[known] == items.h) & (other[first[known]] == items.other) if len(vocabulary) else np.zeros(len(items.h), dtype=bool)
    symbols = np.where(same, known + 1, -1)
    lo, hi = narrowed(seq, sa, symbols, items.suffixes, items.window)
    found, n = [np.zeros((0, 3), dtype=np.int64)], hi - lo
    for a, b in slices(n, PLACES):
        if not (size := n[a:b]).sum():
            continue
        own = np.repeat(np.arange(a, b), size)
        p = sa[np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size) + lo[own]]
        at, length = items.suffixes[own], items.window[own]
        before = np.where(items.start[at] > 0, symbols[at - 1], -2)
        keep = (p == 0) | (seq[p - 1] != before)  # else the place to the left has the longer match
        p, at, length = p[keep], at[keep], length[keep].copy()
        going = np.arange(len(p))
        while len(going):
            ahead = going[length[going] < items.left[at[going]]]
            same = seq[np.minimum(p[ahead] + length[ahead], len(seq) - 1)] == symbols[at[ahead] + length[ahead]]
            going = ahead[same]
            length[going] += 1
        found.append(np.stack([back[p], at, length], axis=1))
    return np.concatenate(found)


def longest(h: np.ndarray, other: np.ndarray, doc: np.ndarray, items: Items) -> np.ndarray:
    """``matches`` of any number of words; documents of over ``LONG`` words are cut and their matches joined."""
    size = np.bincount(doc - doc[0]) if len(doc) else np.array([], np.int64)
    if not len(size) or size.max() <= LONG:
        return matches(h, other, doc, items)
    found, end = [], np.cumsum(size)
    for lo, hi in zip((end - size).tolist(), end.tolist(), strict=True):
        for at in range(lo, max(hi - WINDOW + 1, lo + 1), LONG):
            part = slice(at, min(at + LONG + WINDOW - 1, hi))
            found.append(matches(h[part], other[part], doc[part], items) + [at, 0, 0])
    rows = np.concatenate(found)
    # one after another on a diagonal of an item and a document
    diagonal = rows[:, 0] - items.start[rows[:, 1]]
    item = items.item[rows[:, 1]]
    order = np.lexsort((rows[:, 0], diagonal, item, doc[rows[:, 0]] if len(rows) else diagonal))
    rows, diagonal, item = rows[order], diagonal[order], item[order]
    out = []
    for row, d, i in zip(rows.tolist(), diagonal.tolist(), item.tolist(), strict=True):
        if out and out[-1][3:] == [d, i] and row[0] <= out[-1][0] + out[-1][2] and doc[row[0]] == doc[out[-1][0]]:
            out[-1][2] = max(out[-1][2], row[0] + row[2] - out[-1][0])
        else:
            out.append([*row, d, i])
    return np.array([x[:3] for x in out], dtype=np.int64).reshape(-1, 3)


def spans_of(texts: list[bytes], items: Items) -> tuple[list[int], list[list[dict]]]:
    """Number of words and the longest matches of each text."""
    counts, spans = [0] * len(texts), [[] for _ in texts]
    for a, b in slices(np.array([len(t) for t in texts]), SHARD):
        h, other, doc = words_of(texts[a:b])
        n = np.bincount(doc, minlength=b - a)
        counts[a:b] = n.tolist()
        begin = np.cumsum(n) - n
        rows = longest(h, other, doc, items)
        for p, at, length in rows[np.lexsort((rows[:, 1], rows[:, 0]))].tolist():
            k = int(doc[p])
            for item_id in items.ids[items.item[at]]:
                spans[a + k].append({"item_id": item_id, "item_start": int(items.start[at]), "doc_start": p - int(begin[k]), "length": length})
    return counts, spans


def finder(items):
    """The words and spans of a column of texts; ``items`` is a broadcast."""

    @F.arrow_udf(FOUND)
    def find(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            counts, spans = spans_of([b"" if x is None else x for x in batch.cast(pa.binary()).to_pylist()], items.value)
            yield pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(spans, pa.list_(SPAN))], names=["n_words", "spans"])

    return find.asNondeterministic()  # else it would run once for each use


def blocks_of(items: DataFrame) -> list[Items]:
    """The items in blocks of some ``BROADCAST_BYTES``, each fetched when its turn comes."""
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    size = rows.agg(F.sum(F.octet_length("text") + F.octet_length("item_id"))).first()[0] or 0
    n = max(1, -(-size // common.BROADCAST_BYTES))
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k)
        yield Items([tuple(r) for r in part.collect()])


def found(docs: DataFrame, items: DataFrame) -> DataFrame:
    """row (all columns of ``docs``), n_words and spans of each row."""
    spark = docs.sparkSession
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.lit(0).cast("bigint").alias("n_words"), F.array().cast(SPANS).alias("spans"))
    own = None
    for own in blocks_of(items):
        if "found" in rows.columns:
            rows = materialize(told(rows), "spans")
        rows = rows.withColumn("found", finder(spark.sparkContext.broadcast(own))(F.col("row.text").cast("string")))
    return told(rows)


def told(rows: DataFrame) -> DataFrame:
    return rows.select("row", "found.n_words", F.concat("spans", "found.spans").alias("spans"))


def covered(spans: Column) -> Column:
    """How many words lie in any of the spans."""
    ends = F.transform(spans, lambda x: F.struct(x["doc_start"].alias("a"), (x["doc_start"] + x["length"]).alias("b")))
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end"))
    step = lambda s, x: F.struct((s["n"] + F.greatest(x["b"] - F.greatest(x["a"], s["end"]), F.lit(0))).cast("bigint").alias("n"), F.greatest(s["end"], x["b"]).alias("end"))
    return F.aggregate(F.array_sort(ends), zero, step, lambda s: s["n"])


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, item_ids (distinct, sorted) and spans of each row."""
    rows = found(docs.select("doc_id", "text"), items)
    ids = F.array_sort(F.array_distinct(F.transform("spans", lambda x: x["item_id"])))
    return rows.select("row.doc_id", "n_words", covered(F.col("spans")).alias("n_hit"), ids.alias("item_ids"), "spans")


def longest_matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, length, doc_id, doc_start, item_start: of each item that occurs its longest match, the first by document and place."""
    rows = found(docs.select("doc_id", "text"), items).select("row.doc_id", F.explode("spans").alias("s"))
    best = rows.groupBy("s.item_id").agg(F.min(F.struct((-F.col("s.length")).alias("less"), F.col("doc_id").isNull().alias("none"), "doc_id", "s.doc_start", "s.item_start")).alias("best"))
    return best.select("item_id", (-F.col("best.less")).alias("length"), "best.doc_id", "best.doc_start", "best.item_start")


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no window of an item."""
    clean = found(docs, items).where(F.size("spans") == 0)
    return clean.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def op12_decontamination(spark, sf_dir: str) -> DataFrame:
    rows = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
OP12_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, {_WORDS} AS w FROM benchmark),
sized AS (SELECT *, least({WINDOW}, len(w)) AS m FROM i WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, m, list_slice(w, pos, pos + m - 1) AS gram FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS pos FROM sized)),
grams AS (SELECT rid, m, pos, list_slice(w, pos, pos + m - 1) AS gram FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS pos FROM d, (SELECT DISTINCT m FROM sized) WHERE len(w) >= m)),
hits AS (SELECT rid, item_id, pos, m FROM grams JOIN windows USING (m, gram)),
places AS (SELECT rid, count(DISTINCT place) AS n_hit FROM (SELECT rid, unnest(range(pos, pos + m)) AS place FROM (SELECT DISTINCT rid, pos, m FROM hits)) GROUP BY rid),
ids AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS told FROM (SELECT DISTINCT rid, item_id FROM hits) GROUP BY rid)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(told, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (rid) LEFT JOIN ids USING (rid)
"""
