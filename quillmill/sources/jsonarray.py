"""JSON arrays of any size as rows: files are read by byte ranges in parallel.

Spark's text reader, told to end its records at commas, cuts a file at its split
size wherever it stands, in any store that Spark reads. Whether a comma divides
elements depends on all before it, so a file is read in three steps:

1. Each task puts what it reads into blocks of some ``BLOCK`` bytes and tells of
   each block, for every state it may begin in (outside a string, inside, after a
   backslash), the state it ends in, how the depth changes, and how many containers
   open and commas stand at the depths that may turn out to matter.
2. A file's summaries, some hundred bytes a block, are composed in order: each
   block learns its state, depth and element at the beginning.
3. The blocks are read once more and cut into elements. Those that lie in a block
   come out as they are; pieces of those that run over its ends are brought
   together by their place. Blocks themselves are not shuffled unless there are so
   many that their summaries can't be broadcast.

An element's place is its number in the array. With ``member`` the array may also
be that member of an object at the top.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import quillmill

# Python functions travel by value, so executors need not have the package.
cloudpickle.register_pickle_by_value(quillmill)

BLOCK = 4 << 20
#: What the blocks begin with is broadcast up to this size, some 100 000 blocks.
SUMMED_BYTES = 8 << 20
OUTSIDE, INSIDE, ESCAPED = 0, 1, 2
QUOTE, BACKSLASH, COMMA = 0x22, 0x5C, 0x2C
#: +1 opens, -1 closes, 2 divides.
KIND = np.zeros(256, dtype=np.int8)
KIND[[*b"[{"]], KIND[[*b"]}"]], KIND[COMMA] = 1, -1, 2
BLANKS = b" \t\n\r"
#: Elements lie at depth 1 of an array, 2 of an object's member.
DEEPEST = 2


def structure(raw: np.ndarray, state: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Places and kinds of the marks outside strings, and the state at the end, from the state at the beginning."""
    quotes, slashes = np.flatnonzero(raw == QUOTE), np.flatnonzero(raw == BACKSLASH)
    trailing = 0
    if len(slashes):
        # a quote after an odd number of backslashes stays inside
        first = np.flatnonzero(np.diff(slashes, prepend=-2) != 1)
        begin, length = slashes[first], np.diff(np.append(first, len(slashes)))
        if state == ESCAPED and begin[0] == 0:
            length[0] -= 1
        run = np.searchsorted(begin + np.diff(np.append(first, len(slashes))), quotes)
        ends = begin + np.diff(np.append(first, len(slashes)))
        at = np.minimum(run, len(ends) - 1)
        quotes = quotes[~((ends[at] == quotes) & (length[at] % 2 == 1))]
        trailing = int(length[-1] % 2) if ends[-1] == len(raw) else 0
    if state == ESCAPED and len(quotes) and quotes[0] == 0:
        quotes = quotes[1:]
    kind = KIND[raw]
    places = np.flatnonzero(kind)
    inside = (np.searchsorted(quotes, places) + (state != OUTSIDE)) % 2 == 1
    places = places[~inside]
    ends_inside = (len(quotes) + (state != OUTSIDE)) % 2 == 1
    if ends_inside and state == ESCAPED and not len(raw):
        return places, kind[places], ESCAPED
    return places, kind[places], (ESCAPED if trailing else INSIDE) if ends_inside else OUTSIDE


def depths(kinds: np.ndarray) -> np.ndarray:
    """Depth after each mark, from 0 at the beginning."""
    return np.cumsum(np.where(kinds == 2, 0, kinds), dtype=np.int64)


def told(raw: np.ndarray, state: int) -> list[int]:
    """End state, change of depth, then (depth, containers opened, commas, commas after the last opened) of depths up to ``DEEPEST``."""
    _, kinds, end = structure(raw, state)
    depth = depths(kinds)
    out = [end, int(depth[-1]) if len(depth) else 0]
    opens, commas = kinds == 1, kinds == 2
    for d in np.unique(depth[(opens | commas) & (depth <= DEEPEST)]).tolist():
        own = depth == d
        last = np.flatnonzero(own & opens)
        after = int(np.count_nonzero((own & commas)[last[-1] :])) if len(last) else 0
        out += [d, len(last), int(np.count_nonzero(own & commas)), after]
    return out


BLOCKS = "file string, start bigint, seq int, bytes binary"
BLOCK_ROWS = pa.schema([("file", pa.string()), ("start", pa.int64()), ("seq", pa.int32()), ("bytes", pa.binary())])


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Records of a split joined by commas again, up to ``most`` bytes and a record; splits come one after another."""
    now, seq, parts, size = None, 0, [], 0

    def block() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]], pa.int64()), pa.array([seq], pa.int32()), pa.array([b",".join([*parts, b""])], pa.binary())], schema=BLOCK_ROWS)

    for batch in batches:
        for value, *where in zip(batch.column("value").cast(pa.binary()).to_pylist(), batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
            if now != where or size >= most:
                if parts:
                    yield block()
                seq, parts, size = (seq + 1 if now == where else 0), [], 0
                now = where
            parts.append(value)
            size += len(value) + 1
    if parts:
        yield block()


SUMMARIES = pa.schema([("file", pa.string()), ("start", pa.int64()), ("seq", pa.int32()), ("first", pa.int32()), ("states", pa.list_(pa.list_(pa.int64())))])


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        blocks = batch.column("bytes").to_pylist()
        first = [(b.lstrip(BLANKS)[:1] or b"\0")[0] for b in blocks]
        states = [[told(np.frombuffer(b, dtype=np.uint8), s) for s in (OUTSIDE, INSIDE, ESCAPED)] for b in blocks]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("file", "start", "seq")), pa.array(first, pa.int32()), pa.array(states, SUMMARIES.field("states").type)], schema=SUMMARIES)


BEGINS = pa.schema([("file", pa.string()), ("start", pa.int64()), ("seq", pa.int32()), ("state", pa.int32()), ("depth", pa.int64()), ("target", pa.int64()), ("container", pa.int64()), ("element", pa.int64())])
BEGIN = "file string, start bigint, seq int, state int, depth bigint, target bigint, container bigint, element bigint"


def _begins(rows: pa.Table, member: str | None) -> pa.Table:
    """What each block of a file begins with: state, depth, number of the container, of the element in it; raises if the file isn't what was asked for."""
    rows = rows.sort_by([("start", "ascending"), ("seq", "ascending")])
    first = next((chr(b) for b in rows["first"].to_pylist() if b), "")
    if first != "[" and not (member and first == "{"):
        raise ValueError(f"the top level of the JSON file must be a list: {rows['file'][0].as_py()}")
    target = 1 if first == "[" else 2
    state, depth, container, element, out = OUTSIDE, 0, -1, 0, []
    for states in rows["states"].to_pylist():
        out.append((state, depth, target, container, element))
        state, change, *marks = states[state]
        for k in range(0, len(marks), 4):
            if depth + marks[k] == target:
                container += marks[k + 1]
                element = marks[k + 3] if marks[k + 1] else element + marks[k + 2]
        depth += change
    if state != OUTSIDE or depth != 0:
        raise ValueError(f"the JSON file ends too early: {rows['file'][0].as_py()}")
    columns = [pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), list(BEGINS)[3:], strict=True)]
    return pa.Table.from_arrays([rows[c].combine_chunks() for c in ("file", "start", "seq")] + columns, schema=BEGINS)


#: Kinds of pieces: a whole element, part of one, text outside the containers.
WHOLE, PART, OUTER = 0, 1, 2
PIECES = pa.schema([("file", pa.string()), ("start", pa.int64()), ("seq", pa.int32()), ("kind", pa.int32()), ("container", pa.int64()), ("element", pa.int64()), ("closed", pa.bool_()), ("bytes", pa.binary())])
PIECE = "file string, start bigint, seq int, kind int, container bigint, element bigint, closed boolean, bytes binary"


def cut(block: bytes, state: int, depth: int, target: int, container: int, element: int) -> Iterator[tuple[int, int, int, bool, bytes]]:
    """(kind, container, element, whether the container ends there, bytes) of the pieces of a block, in order.

    Text outside containers counts to the container that it stands before, the bracket included.
    """
    places, kinds, _ = structure(np.frombuffer(block, dtype=np.uint8), state)
    after = depths(kinds) + depth
    opens, closes, commas = (kinds == 1) & (after == target), (kinds == -1) & (after == target - 1), (kinds == 2) & (after == target)
    at, inside, entire = 0, depth >= target, False
    for k in np.flatnonzero(opens | closes | commas).tolist():
        place = int(places[k])
        if opens[k]:
            yield OUTER, container + 1, 0, False, block[at : place + 1]
            container, element, inside = container + 1, 0, True
        else:
            yield (WHOLE if entire else PART), container, element, bool(closes[k]), block[at:place]
            element, inside = element + 1, not closes[k]
        at, entire = place + 1, inside
        if closes[k]:
            at = place
    if at < len(block) or inside:
        yield (PART, container, element, False, block[at:]) if inside else (OUTER, container + 1, 0, False, block[at:])


def _pieces(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    """The whole elements of blocks, or all else."""
    for batch in batches:
        for row in batch.to_pylist():
            got = [x for x in cut(row["bytes"], *(row[c] for c in ("state", "depth", "target", "container", "element"))) if (x[0] == WHOLE) == whole]
            if got:
                columns = [pa.array(x, f.type) for x, f in zip(zip(*got, strict=True), list(PIECES)[3:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([row[c]] * len(got), PIECES.field(c).type) for c in ("file", "start", "seq")] + columns, schema=PIECES)


def key_before(text: Column) -> Column:
    """The key of the array that the text ends by opening; '' of a whole array."""
    key = F.regexp_extract(text, r'(?s)("(?:[^"\\]|\\.)*")\s*:\s*\[\z', 1)
    return F.when(F.ltrim(text) == "[", "").when(key != "", F.from_json(F.concat(F.lit("["), key, F.lit("]")), "array<string>")[0])


def elements(spark: SparkSession, path: str, member: str | None = None) -> DataFrame:
    """file (its path), pos, text of each element of the JSON arrays in ``path``.

    An object at the top raises unless ``member`` names its array; of members of
    one name the last counts, as in Python; without it there are no rows. A file
    that ends inside an array, and text after the array, raise. An empty file
    gives no rows; all but the structure is left to the parser of the elements.
    """
    raw = spark.read.option("lineSep", ",").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    blocks = raw.mapInArrow(partial(_blocks, most=BLOCK), BLOCKS)
    summaries = blocks.mapInArrow(_summaries, "file string, start bigint, seq int, first int, states array<array<bigint>>")
    begins = summaries.groupBy("file").applyInArrow(lambda rows: _begins(rows, member), BEGIN)
    begins = begins.persist(StorageLevel.MEMORY_AND_DISK)
    size = begins.agg(F.sum(F.octet_length("file") + 48)).first()[0] or 0
    # beside the few rows of a broadcast blocks stay where they are read; beyond its bound they are shuffled
    placed = blocks.join(F.broadcast(begins) if size <= SUMMED_BYTES else begins, ["file", "start", "seq"])
    whole = placed.mapInArrow(partial(_pieces, whole=True), PIECE).select("file", "container", "element", "closed", "bytes")
    parts = placed.mapInArrow(partial(_pieces, whole=False), PIECE)
    ordered = F.array_sort(F.collect_list(F.struct("start", "seq", "bytes")))
    text = F.aggregate(F.transform(ordered, lambda x: x["bytes"]), F.lit(b""), lambda a, b: F.concat(a, b))
    joined = parts.groupBy("file", (F.col("kind") == OUTER).alias("outer"), "container", "element").agg(F.max("closed").alias("closed"), text.alias("bytes"))
    items = whole.unionByName(joined.where("NOT outer").drop("outer")).withColumn("text", F.col("bytes").cast("string"))
    # a container without elements holds blanks up to its end
    items = items.where(~((F.col("element") == 0) & F.col("closed") & (F.btrim("text", F.lit(BLANKS.decode())) == "")))
    if member is None:
        # the last record of a file got a comma too
        after = F.btrim(F.regexp_replace(F.col("bytes").cast("string"), r",\z", ""), F.lit("]" + BLANKS.decode()))
        after = joined.where("outer AND container > 0").select("file", after.alias("text"))
        extra = F.raise_error(F.concat(F.lit("text after the JSON array: "), F.substring("text", 1, 80))).cast("string")
        faults = after.where("text <> ''").select("file", F.lit(0).cast("bigint").alias("pos"), F.when(F.col("text") != "", extra).alias("text"))
        return items.select("file", F.col("element").alias("pos"), "text").unionByName(faults)
    keys = joined.where("outer").select("file", "container", key_before(F.col("bytes").cast("string")).alias("name")).where(F.col("name").isin(member, ""))
    own = keys.groupBy("file").agg(F.max("container").alias("container"))
    return items.join(own, ["file", "container"]).select("file", F.col("element").alias("pos"), "text")
