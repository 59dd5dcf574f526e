"""Phrase collocations by hashed bucket counts and a-priori pruning.

Phrases of 2 to ``LONGEST`` words are counted by language, level by level:

1. The pass that counts phrases of k words exactly also counts all phrases of
   k + 1 words under a hash, in ``2 ** BITS`` buckets. Counts stop at ``LEAST``:
   a sum of stopped counts reaches it just if the sum does.
2. What reached ``LEAST`` becomes two bitmaps of ``2 ** BITS`` bits, which are
   broadcast: one of the buckets, one of the hashes of the frequent phrases of k
   words. Their size does not depend on the input.
3. The next pass counts just those phrases of k + 1 words whose bucket is set and
   whose two parts of k words are frequent. The counts that come out are exact: a
   bitmap lets too much pass at most, and what is rare after all goes then.

Tasks cut texts into words by arrays and count the phrases of a slice before
rows leave them; sums are combined before each shuffle. Each pass reads the
texts again; only counts are stored between.

Null text counts as empty, a null language as ``und``. Words never join across a
mark, a line end or two rows; rows that repeat count each time. A table without
candidates gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.llm.common import discard, materialize, table
from quillmill.llm.tokens import BLANK, CUT, WORD, hashes, joined, mixed, runs, slices

LONGEST, LEAST, TOP = 4, 30, 2000
#: A candidate goes if a longer one that holds it has this share of its count, in hundredths.
HELD = 80
BITS, SEGMENT = 25, 18
SLICE = 4 << 20
#: Ranks are taken in as many parts of a language first.
PARTS = 64
CLASS = np.zeros(256, dtype=np.uint8)
CLASS[[0x20, 0x09]] = BLANK
CLASS[[*b".,;:!?", 10, 11, 12, 13]] = CUT
U = np.uint64
SCHEMA = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64()), ("segment", pa.int32()), ("counts", pa.binary())])
ROWS = "lang string, phrase string, n long, segment int, counts binary"


def bucket(h: np.ndarray) -> np.ndarray:
    return (h >> U(64 - BITS)).astype(np.int64)


def held(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = bucket(h)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def longer(h: np.ndarray, words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the phrases of k words from those of k - 1 words that begin at the same words."""
    return mixed(h[: len(words) - k + 1] * U(0x9E3779B97F4A7C15) + words[k - 1 :])


def distinct(h: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of the first, and number, of equal values of both hashes together."""
    own, first, where, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    odd = other != other[first][where]
    if not odd.any():
        return first, n
    order = np.lexsort((other, h))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (other[order][1:] != other[order][:-1])
    at = np.flatnonzero(new)
    return order[at], np.diff(np.append(at, len(order)))


def pieces(texts: list[bytes]) -> Iterator[list[tuple[int, bytes]]]:
    """The texts in groups of some ``SLICE`` bytes with their places in the list; a longer text is cut at its marks."""
    parts = []
    for k, text in enumerate(texts):
        while len(text) > SLICE:
            at = 1 + max(text.rfind(mark, 0, SLICE) for mark in (b".", b",", b";", b":", b"!", b"?", b"\n", b"\r"))
            if not at:
                break
            parts.append((k, text[:at]))
            text = text[at:]
        parts.append((k, text))
    for a, b in slices(np.array([len(t) for _, t in parts]), SLICE):
        yield parts[a:b]


class Words:
    """Words of some texts in place, and hashes of the phrases that begin at each; a phrase's hash begins with its language."""

    def __init__(self, langs: list[str], texts: list[bytes]):
        self.raw, begins = joined(texts)
        kind = CLASS[self.raw]
        self.start, self.end = runs(kind == WORD)
        self.piece = np.searchsorted(np.flatnonzero(kind == CUT), self.start)
        self.names = sorted(set(langs))
        number = {x: k for k, x in enumerate(self.names)}
        self.code = np.array([number[x] for x in langs], dtype=np.int64)[np.searchsorted(begins, self.start, side="right") - 1]

    def chain(self, most: int, which: int = 0) -> list[np.ndarray]:
        """Hashes of the phrases of 1 to ``most`` words, from place 1 on."""
        named = [np.frombuffer(x.encode() + b"\0", dtype=np.uint8) for x in self.names]
        seed = np.array([hashes(x, np.array([0]), np.array([len(x)]), which)[0] for x in named], dtype=np.uint64)
        words = hashes(self.raw, self.start, self.end, which)
        out = [words, mixed(words ^ seed[self.code])]
        for k in range(2, most + 1):
            out.append(longer(out[-1], words, k) if len(words) >= k else words[:0])
        return out


class Level:
    """One pass: counts phrases of ``k`` words exactly and buckets of phrases of ``k + 1`` words."""

    def __init__(self, k: int, frequent: bytes | None, buckets: bytes | None):
        self.k = k
        self.frequent, self.buckets = (None if b is None else np.frombuffer(b, dtype=np.uint8) for b in (frequent, buckets))
        self.counts = np.zeros(1 << BITS, dtype=np.uint8) if k < LONGEST else None

    def kept(self, chain: list[np.ndarray], piece: np.ndarray) -> np.ndarray:
        """Which words begin a phrase of k words that may be frequent."""
        k, h = self.k, chain[self.k]
        one = piece[: len(h)] == piece[k - 1 :]
        if k > 1:
            own = held(self.frequent, chain[k - 1])
            one = one & own[: len(h)] & own[1:] & held(self.buckets, h)
        return one

    def count(self, langs: list[str], texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        for group in pieces(texts):
            yield from self.slice([langs[k] for k, _ in group], [t for _, t in group])

    def slice(self, langs: list[str], texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        words, k = Words(langs, texts), self.k
        start, end, piece = words.start, words.end, words.piece
        if len(start) < k:
            return
        chain = words.chain(min(k + 1, LONGEST))
        kept = self.kept(chain, piece)
        at = np.flatnonzero(kept)
        first, n = distinct(chain[k][at], words.chain(k, 1)[k][at])
        first = at[first]
        data = words.raw.tobytes()
        told = [b" ".join(data[start[j] : end[j]] for j in range(i, i + k)).decode(errors="replace") for i in first.tolist()]
        lang = pa.array([words.names[c] for c in words.code[first].tolist()], pa.string())
        yield pa.RecordBatch.from_arrays([lang, pa.array(told, pa.string()), pa.array(n.astype(np.int64)), pa.nulls(len(told), pa.int32()), pa.nulls(len(told), pa.binary())], schema=SCHEMA)
        if self.counts is not None and len(start) > k:
            both = kept[:-1] & kept[1:] & (piece[: len(start) - k] == piece[k:])
            own, n = np.unique(bucket(chain[k + 1][both]), return_counts=True)
            self.counts[own] = np.minimum(self.counts[own] + np.minimum(n, LEAST), LEAST)

    def close(self) -> Iterator[pa.RecordBatch]:
        """The task's bucket counts, a row for each segment: places in it and counts."""
        if self.counts is None:
            return
        for segment in range(1 << (BITS - SEGMENT)):
            part = self.counts[segment << SEGMENT : (segment + 1) << SEGMENT]
            at = np.flatnonzero(part)
            if len(at):
                packed = (at.astype(np.uint32) << 8 | part[at]).tobytes()
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.array([segment], pa.int32()), pa.array([packed], pa.binary())], schema=SCHEMA)


def _counted(batches: Iterator[pa.RecordBatch], k: int, frequent, buckets) -> Iterator[pa.RecordBatch]:
    level = Level(k, frequent and frequent.value, buckets and buckets.value)
    for batch in batches:
        texts = [b"" if x is None else x for x in batch.column("text").cast(pa.binary()).to_pylist()]
        yield from level.count(batch.column("lang").to_pylist(), texts)
    yield from level.close()


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by segment; counts of a segment become its bits."""
    schema = pa.schema([("segment", pa.int32()), ("bits", pa.binary())])

    def bits(counts):
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(counts >= LEAST, bitorder="little").tobytes()], pa.binary())], schema=schema)

    now, counts = None, None
    for batch in batches:
        for segment, packed in zip(batch.column("segment").to_pylist(), batch.column("counts"), strict=True):
            if segment != now:
                if now is not None:
                    yield bits(counts)
                now, counts = segment, np.zeros(1 << SEGMENT, dtype=np.uint16)
            part = np.frombuffer(packed.as_buffer(), dtype=np.uint32)
            at = part >> 8
            counts[at] = np.minimum(counts[at] + (part & 255), LEAST)
    if now is not None:
        yield bits(counts)


def _marked(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Hashes of frequent phrases of k words as segments in which each counts enough."""
    level = Level(1, None, None)
    for batch in batches:
        if len(batch):
            words = Words(batch.column("lang").to_pylist(), batch.column("phrase").cast(pa.binary()).to_pylist())
            level.counts[bucket(words.chain(k)[k][::k])] = LEAST
    for rows in level.close():
        yield rows.select(["segment", "counts"])


def bitmap(rows: DataFrame):
    """Segments and packed counts as one bitmap of ``2 ** BITS`` bits, broadcast: 4 MB, whatever the input."""
    spark = rows.sparkSession
    bits = rows.repartition("segment").sortWithinPartitions("segment").mapInArrow(_summed, "segment int, bits binary")
    whole = bytearray(1 << (BITS - 3))
    size = 1 << (SEGMENT - 3)
    for segment, part in bits.collect():
        whole[segment * size : (segment + 1) * size] = part
    return spark.sparkContext.broadcast(bytes(whole))


def counted(docs: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """lang, phrase, k, n of all phrases of 1 to ``LONGEST`` words that occur ``LEAST`` times; n of all words by language; stored tables beneath."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    frequent = buckets = sizes = None
    stored = []
    for k in range(1, LONGEST + 1):
        rows = materialize(texts.mapInArrow(partial(_counted, k=k, frequent=frequent, buckets=buckets), ROWS), f"phrases{k}")
        own = rows.where("segment IS NULL").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
        stored.append(materialize(own.where(F.col("n") >= LEAST).select("lang", "phrase", F.lit(k).alias("k"), "n"), f"frequent{k}"))
        if k == 1:
            sizes = materialize(rows.where("segment IS NULL").groupBy("lang").agg(F.sum("n").alias("total")), "sizes")
        if k < LONGEST:
            frequent = bitmap(stored[-1].select("lang", "phrase").mapInArrow(partial(_marked, k=k), "segment int, counts binary"))
            buckets = bitmap(rows.where("segment IS NOT NULL").select("segment", "counts"))
        discard(rows)
    return reduce(DataFrame.unionByName, stored), sizes, [*stored, sizes]


def exact(c: Column, times: int) -> Column:
    return c.cast("decimal(19,0)") * F.lit(times).cast("decimal(9,0)")


def part(words: Column, first: Column, n: Column) -> Column:
    return F.array_join(F.slice(words, first, n), " ")


def scored(phrases: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score of the candidates that no longer one stands for."""
    words = F.split("phrase", " ")
    candidates = phrases.where("k > 1").withColumn("words", words)
    cuts = candidates.select("lang", "phrase", F.col("n").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"), "k")
    cuts = cuts.select("lang", "phrase", "a", "cut", part(F.col("words"), F.lit(1), F.col("cut")).alias("left"), part(F.col("words"), F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    counts = lambda side, n: phrases.select("lang", F.col("phrase").alias(side), F.col("n").alias(n))
    both = cuts.join(counts("left", "l"), ["lang", "left"]).join(counts("right", "r"), ["lang", "right"])
    # a is at most l and r, so the score is a million at most
    both = both.withColumn("score", F.expr("cast(2000000BD * cast(a AS decimal(19,0)) AS decimal(27,0)) DIV (cast(l AS decimal(19,0)) + cast(r AS decimal(19,0)))"))
    best = both.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "cut", "l", "r")).alias("low"))
    # every shorter phrase of two words and more inside a candidate, once for each place
    places = F.filter(F.flatten(F.transform(F.sequence(F.lit(2), F.greatest(F.col("k") - 1, F.lit(2))), lambda n: F.transform(F.sequence(F.lit(1), F.col("k") - n + 1), lambda at: part(F.col("words"), at, n)))), lambda x: x != F.col("phrase"))
    inside = candidates.where("k > 2").select("lang", F.explode(places).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("over"))
    told = best.join(inside, ["lang", "phrase"], "left")
    stands = F.coalesce(exact(F.col("over"), 100) >= exact(F.col("a"), HELD), F.lit(False))
    return told.where(~stands).select("lang", "phrase", "a", "low.l", "low.r", F.col("low.score").cast("bigint").alias("score"))


def ranked(rows: DataFrame, top: int = TOP) -> DataFrame:
    """Adds rank, from 1; the first ``top`` of each language. Parts of a language are cut first, so at most PARTS * top rows meet."""
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    parts = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*order)
    cut = rows.withColumn("rank", F.row_number().over(parts)).where(F.col("rank") <= top)
    return cut.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's strongest phrases."""
    phrases, sizes, stored = counted(docs)
    sizes = sizes.withColumnRenamed("total", "n")
    out = materialize(ranked(scored(phrases), top).join(sizes, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"), "collocations")
    discard(*stored)
    return out


def op13_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def _grams() -> str:
    """Phrases of 1 to LONGEST words of every piece."""
    return " UNION ALL ".join(f"SELECT lang, {k} AS k, unnest(list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(list_slice(w, i, i + {k - 1}), ' '))) AS phrase FROM pieces" for k in range(1, LONGEST + 1))


OP13_SQL = f"""
WITH split AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
pieces AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM split),
grams AS ({_grams()}),
f AS (SELECT lang, k, phrase, count(*) AS n FROM grams GROUP BY ALL),
total AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND n >= {LEAST}),
cuts AS (SELECT lang, phrase, a, i, array_to_string(list_slice(w, 1, i), ' ') AS lp, array_to_string(list_slice(w, i + 1, k), ' ') AS rp FROM (SELECT *, unnest(range(1, k)) AS i FROM cand)),
told AS (SELECT c.lang, c.phrase, c.a, c.i, x.n AS l, y.n AS r, CAST(2000000::HUGEINT * c.a // (x.n::HUGEINT + y.n) AS BIGINT) AS score FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.lp JOIN f y ON y.lang = c.lang AND y.phrase = c.rp),
low AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) AS nth FROM told) WHERE nth = 1),
held AS (SELECT lang, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase, max(a) AS over FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM cand WHERE k > 2)) GROUP BY ALL),
kept AS (SELECT low.* FROM low LEFT JOIN held USING (lang, phrase) WHERE over IS NULL OR 100::HUGEINT * over < {HELD}::HUGEINT * a)
SELECT lang, rank, phrase, a, l, r, total.n AS n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN total USING (lang) WHERE rank <= {TOP}
"""
