"""Removal of repeated byte strings by prefix-free parsing and suffix arrays.

A byte goes if a string of ``LENGTH`` = 100 bytes that covers it also starts
earlier (smaller doc_id, or the same document, further left). Matches stay
inside documents; strings are judged on the input.

1. Parse: a rolling hash over 16 bytes triggers cuts, on average every ``EVERY``
   bytes, that depend on the bytes alone. A phrase is a cut to the next one and
   the 99 bytes after it, so each string starts in one phrase and lies inside.
2. Order of the parse: suffixes of the parse are ordered by their first phrase,
   then by corpus order; no more is asked for, as no string leaves its phrase. The
   first of each phrase's places enters the dictionary; all strings that start at
   its other places are repeats at once. The earliest place of any string lies in
   a dictionary phrase, so only those are looked into further. On highly
   repetitive text the dictionary is small.
3. Suffix array of the dictionary, in ranges: equal strings have to meet. Each
   one's least rolling hash over 32 bytes (its anchor) is at the same place in
   equal strings, and ranges of anchors, not of first bytes, divide the array:
   that sends each byte about once, not 100 times. Anchors that occur once are set
   aside; for the others the bytes around them are sent to their range, where the
   suffixes are sorted by their first 100 bytes.
4. Combination: suffixes that share 100 bytes with the one before stand in corpus
   order in that array, and all but the first of them are repeats.
5. Marks: repeats of both kinds are gathered by document and cut out.

Suffixes of an anchor with over ``HOT`` places are sent one by one, by two 64-bit
hashes of their 100 bytes in place of the bytes, after equal ones of a batch have
been settled, so no common passage ends in one task. Anchors that a sample of
rows shows to be hot aren't brought together to be counted either. The texts are
shuffled once, into a table bucketed by row; all later steps read it beside small
tables dealt the same way. That table and those between are deleted at the end.

Null text counts as empty. A null doc_id comes after all others. Rows that
repeat a doc_id, or have none, are separate documents in the order of two 64-bit
hashes of their texts; between rows that are equal in both nothing tells, so as
a whole the result does not depend on the order or partitions of the input.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmill.llm.common import delete, discard, materialize, partitions, run_dir, table

LENGTH, EVERY, TRIGGER, ANCHOR = 100, 512, 16, 32
REACH = LENGTH - ANCHOR + 1
HOT = 4096
#: A sample of rows, one in SAMPLE, shows which anchors are hot ahead of counting; at most HEAVY of them. It routes work and decides nothing.
SAMPLE, HEAVY = 32, 65_536
SLICE = 1 << 19
#: Suffixes that are sorted at a time, but for a key with more (HOT * REACH at most).
SORTED = 1 << 16
PLACE_BITS = np.uint64(20)
_rng = np.random.default_rng(7)
#: Two rolling hashes: a random 64-bit value for each byte, and an odd base.
TABLES = _rng.integers(1, 1 << 63, size=(2, 256), dtype=np.uint64)
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
U = np.uint64


def power(base: np.uint64, n: int) -> np.uint64:
    return U(pow(int(base), n, 1 << 64))


def doubled(raw: np.ndarray, top: int, which: int = 0) -> dict[int, np.ndarray]:
    """Rolling hashes over 1, 2, 4, ... ``top`` bytes at each place."""
    h, out, n = TABLES[which][raw], {}, 1
    out[1] = h
    while n < top:
        h = h[:-n] * power(BASES[which], n) + h[n:] if len(h) > n else h[:0]
        n *= 2
        out[n] = h
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
    return h ^ (h >> U(29))


def whole(raw: np.ndarray, which: int) -> np.ndarray:
    """Hash of the LENGTH = 64 + 32 + 4 bytes from each place."""
    n = len(raw) - LENGTH + 1
    if n <= 0:
        return np.array([], dtype=np.uint64)
    h, base = doubled(raw, 64, which), BASES[which]
    return mixed(h[64][:n] * power(base, 36) + h[32][64 : 64 + n] * power(base, 4) + h[4][96 : 96 + n])


def cuts(raw: np.ndarray) -> np.ndarray:
    """0 and the places where a trigger begins."""
    found = [np.array([0])]
    for at in range(0, len(raw), SLICE):
        h = mixed(doubled(raw[at : at + SLICE + TRIGGER - 1], TRIGGER)[TRIGGER])
        found.append(np.flatnonzero((h >> U(40)) % U(EVERY) == 0) + at)
    return np.unique(np.concatenate(found))


def phrases(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """start, number of strings and 128-bit content hash of each phrase with a string."""
    last = len(raw) - LENGTH + 1  # strings start before this
    if last <= 0:
        return np.array([], np.int64), np.array([], np.int64), []
    start = cuts(raw)
    start = start[start < last]
    n = np.diff(np.append(start, last))
    return start, n, [xxhash.xxh3_128_digest(raw[s : s + k + LENGTH - 1]) for s, k in zip(start.tolist(), n.tolist(), strict=True)]


def anchors(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash, first, last) of each anchor: the strings that start from first to last have it."""
    n = len(raw) - LENGTH + 1
    parts = []
    for at in range(0, max(n, 0), SLICE):
        part = raw[at : at + SLICE + LENGTH - 1]
        m = len(part) - LENGTH + 1
        h = mixed(doubled(part, ANCHOR)[ANCHOR])
        low = (h >> PLACE_BITS << PLACE_BITS) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while 2 * width <= REACH:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        low = np.minimum(low[:m], low[REACH - width : REACH - width + m])
        place = (low & U((1 << 20) - 1)).astype(np.int64)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        last = np.append(first[1:], m) - 1
        parts.append((place[first] + at, h[place[first]], first + at, last + at))
    if not parts:
        none = np.array([], np.int64)
        return none, none.astype(np.uint64), none, none
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _texts(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(b, dtype=np.uint8) if (b := x.as_buffer()).size else np.array([], np.uint8) for x in batch.column("text")]


def _lists(batch: pa.RecordBatch, name: str) -> list[np.ndarray]:
    """Each row's list of structs of longs as a 2-d array, ascending; empty where null."""
    col = batch.column(name)
    flat = col.flatten()
    fields = np.stack([f.to_numpy(zero_copy_only=False).astype(np.int64) for f in flat.flatten()], axis=1) if len(flat) else np.zeros((0, flat.type.num_fields), np.int64)
    sizes = np.array([0 if s is None else s for s in pa.compute.list_value_length(col).to_pylist()], dtype=np.int64)
    ends = np.cumsum(sizes)
    return [(part := fields[e - s : e])[np.lexsort(part.T[::-1])] for s, e in zip(sizes, ends, strict=True)]


def first_of(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Of rows put in ``order``, whether each differs in its keys from the one before."""
    new = np.ones(len(order), dtype=bool)
    if len(order) > 1:
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    return new


#: What orders documents in the corpus; the last names a row.
CORPUS = ("doc", "tie", "tie2", "rid")
PARSED = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("doc", pa.int64()), ("tie", pa.int64()), ("tie2", pa.int64()), ("rid", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("known", pa.bool_())])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phrases of each document; ``known`` ones repeat an earlier one of the batch."""
    for batch in batches:
        names = (batch.column(c).to_numpy(zero_copy_only=False) for c in CORPUS)
        rows, digests = [], []
        for *name, raw in zip(*names, _texts(batch), strict=True):
            start, n, own = phrases(raw)
            rows.append(np.stack([*(np.full(len(start), x) for x in name), start, n]))
            digests += own
        if not digests:
            continue
        *name, start, n = np.concatenate(rows, axis=1).astype(np.int64)
        k1, k2 = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2).T
        order = np.lexsort((start, *name[::-1], k2, k1))
        known = np.empty(len(order), dtype=bool)
        known[order] = ~first_of(order, k1, k2)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.ascontiguousarray(k1), np.ascontiguousarray(k2), *name, start, n, known)], schema=PARSED)


def _inside(first: np.ndarray, last: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cuts the ranges first..last to the runs (start, n), ascending and apart; a range may meet several.

    Gives (index of the range, first, last) of each piece.
    """
    if not len(runs) or not len(first):
        none = np.array([], np.int64)
        return none, none, none
    begin, end = runs[:, 0], runs[:, 0] + runs[:, 1] - 1
    lo, hi = np.searchsorted(end, first), np.searchsorted(begin, last, side="right")
    many = np.maximum(hi - lo, 0)
    which = np.repeat(np.arange(len(first)), many)
    run = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many) + lo[which]
    return which, np.maximum(first[which], begin[run]), np.minimum(last[which], end[run])


ANCHORED = pa.schema([("hash", pa.int64()), ("rid", pa.int64()), ("place", pa.int64()), ("heavy", pa.bool_())])


def _anchored(batches: Iterator[pa.RecordBatch], heavy: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Anchors of the strings that start in dictionary phrases; whether each is among ``heavy`` ones."""
    for batch in batches:
        hashes, rids, places = [], [], []
        for r, raw, runs in zip(batch.column("rid").to_pylist(), _texts(batch), _lists(batch, "runs"), strict=True):
            if not len(runs):
                continue
            place, h, first, last = anchors(raw)
            which, _, _ = _inside(first, last, runs)
            at = np.unique(place[which], return_index=True)
            hashes.append(h[which][at[1]])
            places.append(at[0])
            rids.append(np.full(len(at[0]), r))
        if hashes:
            found = np.concatenate(hashes).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.concatenate(rids).astype(np.int64)), pa.array(np.concatenate(places).astype(np.int64)), pa.array(np.isin(found, heavy))], schema=ANCHORED)


SENT = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("doc", pa.int64()), ("tie", pa.int64()), ("tie2", pa.int64()), ("rid", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("bytes", pa.binary())])
MARKS = pa.schema([("rid", pa.int64()), ("start", pa.int64()), ("n", pa.int64())])


def _sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The strings around anchors that occur again: as bytes under the anchor's
    hash, or one by one under their own hashes for hot anchors. Strings of hot
    anchors that repeat an earlier one of the batch come as marks (n below 0)."""
    for batch in batches:
        cold, hot = [], []
        for *name, raw, runs, again in zip(*(batch.column(c).to_pylist() for c in CORPUS), _texts(batch), _lists(batch, "runs"), _lists(batch, "again"), strict=True):
            if not len(again) or not len(runs):
                continue
            place, h, first, last = anchors(raw)
            at = np.searchsorted(again[:, 0], place)
            held = (at < len(again)) & (again[np.minimum(at, len(again) - 1), 0] == place)
            is_hot = again[np.minimum(at, len(again) - 1), 1] == 1
            keep = np.flatnonzero(held)
            which, lo, hi = _inside(first[keep], last[keep], runs)
            which = keep[which]
            for w, a, b in zip(which.tolist(), lo.tolist(), hi.tolist(), strict=True):
                part = raw[a : b + LENGTH]
                if is_hot[w]:
                    hot.append((whole(part, 0).view(np.int64), whole(part, 1).view(np.int64), *(np.full(b - a + 1, x) for x in name), np.arange(a, b + 1)))
                else:
                    cold.append((int(h[w].view(np.int64)), 0, *name, a, b - a + 1, part.tobytes()))
        if cold:
            yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*cold, strict=True), SENT, strict=True)], schema=SENT)
        if hot:
            k1, k2, *name, start = (np.concatenate(x).astype(np.int64) for x in zip(*hot, strict=True))
            order = np.lexsort((start, *name[::-1], k2, k1))
            n = np.empty(len(order), dtype=np.int64)
            n[order] = np.where(first_of(order, k1, k2), 1, -1)
            key = np.where(n > 0, k1, name[-1])
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in (key, k2, *name, start, n)), pa.nulls(len(n), pa.binary())], schema=SENT)


def _marks_of(rid: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """Joins neighbouring starts into runs."""
    order = np.lexsort((start, rid))
    rid, start = rid[order], start[order]
    new = np.ones(len(rid), dtype=bool)
    new[1:] = (rid[1:] != rid[:-1]) | (start[1:] > start[:-1] + 1)
    at = np.flatnonzero(new)
    end = np.append(at[1:], len(rid)) - 1
    return pa.RecordBatch.from_arrays([pa.array(rid[at]), pa.array(start[at]), pa.array(start[end] - start[at] + 1)], schema=MARKS)


def suffix_array(flat: np.ndarray, at: np.ndarray, *corpus: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of ``flat`` at the places ``at`` (as their indices) by their first
    LENGTH bytes, then in corpus order, and whether each shares those bytes with the one before."""
    order = np.lexsort(corpus[::-1])
    own = np.lib.stride_tricks.sliding_window_view(flat, LENGTH)[at[order]].view(f"S{LENGTH}").ravel()
    sa = np.argsort(own, kind="stable")
    own = own[sa]
    shares = np.zeros(len(sa), dtype=bool)
    shares[1:] = own[1:] == own[:-1]
    return order[sa], shares


def _settled(rows: pa.Table) -> pa.RecordBatch | None:
    """Marks of all strings in the rows but the first of equal ones; a key's rows are here all."""
    n = rows["n"].to_numpy()
    *name, start, k1, k2 = (rows[c].to_numpy() for c in (*CORPUS, "start", "k1", "k2"))
    rid = name[-1]
    done = n < 0
    own = np.flatnonzero(n > 0)
    raw = [b if b is not None else b"" for b in rows["bytes"].take(pa.array(own)).to_pylist()]
    direct = np.array([not b for b in raw], dtype=bool)
    found_r, found_s = [rid[done]], [start[done]]
    # suffixes with their bytes: whole keys, some SORTED of them at a time
    packed, bytes_of = own[~direct], [b for b in raw if b]
    total = np.cumsum(n[packed])
    key_ends = np.append(np.flatnonzero(k1[packed][1:] != k1[packed][:-1]) + 1, len(packed))
    begin = 0
    while begin < len(packed):
        goal = total[begin] - n[packed[begin]] + SORTED
        fits = key_ends[(key_ends > begin) & (total[key_ends - 1] <= goal)]
        end = int(fits[-1]) if len(fits) else int(key_ends[key_ends > begin][0])
        part = packed[begin:end]
        flat, count = np.frombuffer(b"".join(bytes_of[begin:end]), dtype=np.uint8), n[part]
        base = np.cumsum(count + LENGTH - 1) - (count + LENGTH - 1)
        step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        of, s = np.repeat(part, count), np.repeat(start[part], count) + step
        sa, shares = suffix_array(flat, np.repeat(base, count) + step, *(x[of] for x in name), s)
        found_r.append(rid[of][sa[shares]])
        found_s.append(s[sa[shares]])
        begin = end
    # suffixes of hot anchors, by their hashes
    one = own[direct]
    order = one[np.lexsort((start[one], *(x[one] for x in name[::-1]), k2[one], k1[one]))]
    again = order[~first_of(order, k1, k2)]
    rr, ss = np.concatenate([*found_r, rid[again]]), np.concatenate([*found_s, start[again]])
    return _marks_of(rr, ss) if len(rr) else None


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by k1; a key may run on into the next batch."""
    rest = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if rest is None else pa.concat_tables([rest, rows])
        k1 = rows["k1"].to_numpy()
        if not len(k1):
            continue
        cut = int(np.searchsorted(k1, k1[-1]))
        rest = rows.slice(cut)
        if cut and (got := _settled(rows.slice(0, cut))) is not None:
            yield got
    if rest is not None and len(rest) and (got := _settled(rest)) is not None:
        yield got


CUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])


def _cut(batches: Iterator[pa.RecordBatch], digest: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, spans, kept, size = [], [], [], []
        for raw, marks in zip(_texts(batch), _lists(batch, "marks"), strict=True):
            size.append(len(raw))
            if len(marks):
                edge = np.zeros(len(raw) + 1, dtype=np.int32)
                np.add.at(edge, marks[:, 0], 1)
                np.add.at(edge, marks[:, 0] + marks[:, 1] + LENGTH - 1, -1)
                gone = np.cumsum(edge[:-1]) > 0
                removed.append(int(gone.sum()))
                spans.append(int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1)))
                raw = raw[~gone]
            else:
                removed.append(0)
                spans.append(0)
            kept.append(hashlib.sha256(raw).digest() if digest else raw.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, type=pa.int64()) for x in (size, removed, spans)), pa.array(kept, type=pa.binary())], schema=CUT)


def _bucketed(docs: DataFrame, n: int) -> tuple[str, str]:
    """Name and folder of a table of n buckets that holds the rows with a row number and is dealt by it."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ties = {"tie": F.xxhash64("text"), "tie2": F.xxhash64(F.lit(7), "text")}
    rows = rows.withColumns({"rid": F.monotonically_increasing_id(), "doc": F.coalesce("doc_id", F.lit((1 << 63) - 1)), **ties})
    name = f"quillmill_texts_{uuid.uuid4().hex}"
    path = f"{run_dir(docs.sparkSession)}/{name}"
    rows.repartition(n, "rid").write.bucketBy(n, "rid").option("path", path).format("parquet").saveAsTable(name)
    return name, path


def removed(docs: DataFrame, digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes left, or their SHA-256 if ``digest``) for each row."""
    spark = docs.sparkSession
    n = partitions(spark)
    name, path = _bucketed(docs, n)
    try:
        return _removed(spark.table(name), n, digest)
    finally:
        spark.sql(f"DROP TABLE {name}")
        delete(spark, path)


def _removed(texts: DataFrame, n: int, digest: bool) -> DataFrame:
    spark = texts.sparkSession
    long = texts.where(F.octet_length("text") >= LENGTH)

    def beside(small: DataFrame, rows: DataFrame = long, how: str = "inner") -> DataFrame:
        return rows.join(small.hint("shuffle_hash"), "rid", how)

    parsed = long.select(*CORPUS, "text").mapInArrow(_parse, "k1 long, k2 long, doc long, tie long, tie2 long, rid long, start long, n long, known boolean")
    parsed = materialize(parsed, "phrases")
    # combined before the shuffle, so a phrase of all documents comes as one row for each task
    first = parsed.where("not known").groupBy("k1", "k2").agg(F.min(F.struct(*CORPUS, "start", "n")).alias("first"))
    dictionary = materialize(first.select("first.rid", "first.start", "first.n"), "dictionary")
    later = parsed.where("not known").join(dictionary.select("rid", "start"), ["rid", "start"], "left_anti")
    runs = dictionary.groupBy("rid").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    schema = "hash long, rid long, place long, heavy boolean"
    none = np.array([], dtype=np.int64)
    sampled = F.pmod(F.xxhash64("rid"), F.lit(SAMPLE)) == 0
    sample = beside(runs.where(sampled), long.where(sampled)).select("rid", "text", "runs").mapInArrow(lambda batches: _anchored(batches, none), schema)
    common = sample.groupBy("hash").count().where(F.col("count") > HOT // SAMPLE).orderBy(F.desc("count"), "hash").limit(HEAVY)
    heavy = spark.sparkContext.broadcast(np.array([r[0] for r in common.collect()], dtype=np.int64))
    found = beside(runs).select("rid", "text", "runs").mapInArrow(lambda batches: _anchored(batches, heavy.value), schema)
    # heavy anchors are known to repeat and need not meet to be counted
    places = F.count("*").over(Window.partitionBy("hash", F.when(F.col("heavy"), F.col("rid")).otherwise(0)))
    again = found.withColumn("places", places).where("heavy or places > 1").select("rid", "place", (F.col("heavy") | (F.col("places") > HOT)).cast("bigint").alias("hot"))
    again = materialize(again.groupBy("rid").agg(F.collect_list(F.struct("place", "hot")).alias("again")), "anchors")
    sent = beside(again.join(runs, "rid")).select(*CORPUS, "text", "runs", "again").mapInArrow(_sent, "k1 long, k2 long, doc long, tie long, tie2 long, rid long, start long, n long, bytes binary")
    settled = sent.repartition(n, "k1").sortWithinPartitions("k1").mapInArrow(_settle, "rid long, start long, n long")
    marks = parsed.where("known").select("rid", "start", "n").unionByName(later.select("rid", "start", "n")).unionByName(settled)
    marks = marks.groupBy("rid").agg(F.collect_list(F.struct("start", "n")).alias("marks"))
    held = beside(marks, texts, "left").select("doc_id", "text", "marks")
    out = materialize(held.mapInArrow(lambda batches: _cut(batches, digest), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"), "kept")
    discard(parsed, dictionary, again)
    return out


def op7_repeated_substrings(spark, sf_dir: str) -> DataFrame:
    out = removed(table(spark, sf_dir, "documents"), digest=True)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.lower(F.hex("kept")).alias("kept_sha256"))
