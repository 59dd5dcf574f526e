"""Best-fit packing of token sequences by minimum bin slack.

Each bin takes the largest piece left and, of all combinations of the lengths
left, one that fills the rest of the bin fullest, found by subset-sum dynamic
programming over bitsets (bit s: some combination has length s). The choice
depends on how many pieces of each length there are, not on which, so the driver
packs a histogram of at most ``capacity`` lengths: a combination is repeated
while the counts allow it, giving a short table of patterns. Pieces are then
ranked within their length, in parallel, and looked up in that table.

A document's ids end with ``END_ID``. Only documents longer than a bin are cut,
into full bins from the end; the first piece may be shorter. Null text counts
as empty: one piece of length 1. Rows that repeat are packed each, those with a
null doc_id too, each as a document of its own. An empty table gives no sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import materialize, partitions, table

CAPACITY, END_ID = 2048, 0
#: More than a length can have pieces; lengths times this stay within 63 bits.
RANKS = np.int64(1) << 44
TOKENIZER = "byte_bpe_50k"
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, tie bigint"


def vocabulary(json_path: str, ranks_path: str) -> dict:
    """The tokenizer of ``json_path`` as pattern, ranks and special tokens: what
    an encoder needs that gives the same ids several times as fast. Read on the
    driver, as executors need not have the files."""
    import base64
    import json

    import public_tokenizers

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(json_path) as f:
        special = {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}
    return {"pat_str": public_tokenizers.PATTERN, "mergeable_ranks": ranks, "special_tokens": special}


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(f"{TOKENIZER}.json"), public_tokenizers.path(f"{TOKENIZER}.tiktoken")


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full ones from the end, the first may be shorter."""
    first = n % capacity or capacity
    return [(0, min(first, n)), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, capacity: int = CAPACITY, paths: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece; tie: its first ids' mark, to order equal doc_ids."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary(*(paths or tokenizer_paths())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        # special tokens' strings in a text become their ids, as by the tokenizer file
        enc, kinds = tiktoken.Encoding("own", **held.value), (pa.int32(), *[pa.int64()] * 4)
        for batch in batches:
            out = []
            for row, text in enumerate(batch.column("text").to_pylist()):
                ids = np.array([*enc.encode(text or "", allowed_special="all"), END_ID], dtype="<u4")
                whole = zlib.crc32(ids.tobytes())
                out += [(row, k, s, n, zlib.crc32(ids[s : s + n].tobytes()), whole) for k, (s, n) in enumerate(cut(len(ids), capacity))]
            if out:
                row, *others = zip(*out, strict=True)
                own = [batch.column("doc_id").take(pa.array(row)), *(pa.array(x, type=t) for x, t in zip(others, kinds, strict=True))]
                yield pa.RecordBatch.from_arrays(own, names=["doc_id", "piece", "start", "length", "ids_crc32", "tie"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def fullest(counts: np.ndarray, room: int) -> list[tuple[int, int]]:
    """(length, how many) of a combination of the counted lengths that fills ``room`` fullest.

    Lengths enter longest first, in powers of two of their count; reading back,
    a length is used only where the total can't be reached by longer ones.
    """
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for n in np.flatnonzero(counts[: room + 1])[::-1].tolist():
        have = min(int(counts[n]), room // n)
        part = 1
        while have and not reach >> room & 1:
            take = min(part, have)
            steps.append((reach, n, take))
            reach |= reach << (n * take) & mask
            have -= take
            part *= 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for before, n, take in reversed(steps):
        if not before >> at & 1:
            at -= n * take
            used[n] = used.get(n, 0) + take
    return sorted(used.items(), reverse=True)


def patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """(bins, [(length, pieces of it in each bin)]) until no piece is left."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for n, c in histogram.items():
        counts[n] = c
    out = []
    while counts.any():
        top = int(np.flatnonzero(counts)[-1])
        counts[top] -= 1
        used = dict(fullest(counts, capacity - top))
        counts[top] += 1
        used[top] = used.get(top, 0) + 1
        bins = min(int(counts[n]) // k for n, k in used.items())
        for n, k in used.items():
            counts[n] -= k * bins
        out.append((bins, sorted(used.items(), reverse=True)))
    return out


def slots(found: list[tuple[int, list[tuple[int, int]]]]) -> pd.DataFrame:
    """length, first (rank within the length), k (pieces in a bin), bin, base (offset): a row for each length of a pattern."""
    rows, seen, at = [], {}, 0
    for bins, used in found:
        base = 0
        for n, k in used:
            rows.append((n, seen.get(n, 0), k, at, base))
            seen[n] = seen.get(n, 0) + k * bins
            base += n * k
        at += bins
    return pd.DataFrame(rows, columns=["length", "first", "k", "bin", "base"]).sort_values(["length", "first"], ignore_index=True)


def ranked(cut_up: DataFrame) -> DataFrame:
    """Adds ``rank`` from 0 within each length to a stored table, without bringing a length together.

    Rows are spread over parts by a hash of their file and place in it, so rows
    that are equal spread too; each part ranks its own rows of a length and is
    offset by the parts before it.
    """
    n = partitions(cut_up.sparkSession)
    part = F.pmod(F.xxhash64("_metadata.file_name", "_metadata.row_index"), F.lit(n)).cast("int")
    spread = cut_up.select(*cut_up.columns, part.alias("part"))
    sums = spread.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = sums.select("length", "part", F.expr("sum(n) over (partition by length order by part) - n").alias("before"))
    own = spread.withColumn("own", F.expr("row_number() over (partition by part, length order by doc_id, piece, tie) - 1"))
    return own.join(before, ["part", "length"]).select(*cut_up.columns, (F.col("own") + F.col("before")).alias("rank"))


def pack(cut_up: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces with a ``length`` of 1 to ``capacity``."""
    held = materialize(cut_up, "pieces")
    histogram = {r[0]: r[1] for r in held.groupBy("length").count().collect()}
    found = slots(patterns(histogram, capacity))
    arrays = {c: found[c].to_numpy(dtype=np.int64) for c in found}
    keys = arrays["length"] * RANKS + arrays["first"]

    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        at = np.searchsorted(keys, n * RANKS + r, side="right") - 1
        own, k = r - arrays["first"][at], arrays["k"][at]
        return pd.DataFrame({"sequence_id": arrays["bin"][at] + own // k, "offset": arrays["base"][at] + own % k * n})

    # only length and rank go to Python, and once, though two columns are read from the result
    placed = F.pandas_udf(place, "sequence_id bigint, offset bigint").asNondeterministic()
    rows = ranked(held).withColumn("at", placed("length", "rank"))
    return rows.select(*(c for c in held.columns if c != "tie"), "at.sequence_id", "at.offset")


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents")))
