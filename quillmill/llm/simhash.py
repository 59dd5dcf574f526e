"""SimHash near-duplicates by pigeonring filtering.

Texts are lower-cased (A-Z), cut into words at ASCII white space and into
3-word shingles, repeats included (fewer words: the whole sequence). A bit of
the fingerprint is 1 if set in over half of the shingles' XXH64 (seed 42);
without words it is zero, linked like any other. Fingerprints that differ in at
most ``BUDGET`` = 3 bits are linked; groups are the connected components.

Pigeonring: on a ring of m = 4 segments of 16 bits, any two fingerprints within
the budget have a segment from which every chain of l segments differs in at
most floor(3 l / 4) bits: 0, 1, 2, 3. So each distinct fingerprint is filed under
each start segment (equal there) and each half of the segment after it (a chain
of two may differ in one bit, so one half is equal): 8 keys of 24 bits. Inside a
key, chains of two and three segments are checked before the full distance.

A key's members are searched breadth-first: each member is compared with those
not yet reached, so the links found join the key's components without listing
all pairs of a group. A key with over ``MEMBERS`` members is refined first: the
bits outside it are cut into 4 parts, of which one must be equal, and so on up to
``LEVELS`` times, after which a key leaves under 20 bits open, so it has a bounded
number of members; no link is lost. Where few bits vary among many members, each
looks its neighbours up under the flips of up to three of those bits instead.

Components join by minimum-label hooking over tables in the shared folder. Null
text counts as empty. A null doc_id takes no part in choosing component_id; a
group of null ids alone has a null component_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from quillmill.llm.common import discard, materialize, partitions, small, table

BUDGET, SEGMENTS, WIDTH, SHINGLE, SEED = 3, 4, 16, 3, 42
MEMBERS = 8192
PARTS, LEVELS = 4, 3
HUB = 100_000
#: A lookup costs about as much as this many comparisons.
LOOKUP = 16


def fingerprint(text: str | None) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE)), strict=False)) if len(words) >= SHINGLE else [b" ".join(words)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), dtype="<u8")
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        votes += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<u8")[0])


@F.pandas_udf(LongType())
def _print_of(texts: pd.Series) -> pd.Series:
    """The fingerprint beside its row: only the text goes to Python, ids stay in the JVM."""
    return pd.Series(np.fromiter(map(fingerprint, texts), dtype=np.uint64, count=len(texts)).view(np.int64))


# else a null check inferred from the join would be pushed below and make each fingerprint once more
_print_of = _print_of.asNondeterministic()


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) for each row."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _print_of(F.col("text").cast("string")).alias("fp"))


def _bits(fp, low: int, width: int):
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))


def filed(distinct: DataFrame) -> DataFrame:
    """fp, kind (start segment and half), key, rest (the low bits not in the key are found from these)."""
    rows = []
    for i in range(SEGMENTS):
        after = (i + 1) % SEGMENTS
        for half in range(2):
            own = _bits(F.col("fp"), i * WIDTH, WIDTH)
            key = F.shiftleft(own, WIDTH // 2).bitwiseOR(_bits(F.col("fp"), after * WIDTH + half * WIDTH // 2, WIDTH // 2))
            rows.append(F.struct(F.lit(2 * i + half).alias("kind"), key.alias("key")))
    return distinct.select("fp", F.explode(F.array(*rows)).alias("at")).select("fp", "at.kind", "at.key")


def free_bits(kind: int) -> list[int]:
    """Bits that a kind's key leaves open, ascending."""
    i, half = divmod(kind, 2)
    start, other = i * WIDTH, (i + 1) % SEGMENTS * WIDTH + half * WIDTH // 2
    taken = {*range(start, start + WIDTH), *range(other, other + WIDTH // 2)}
    return [b for b in range(64) if b not in taken]


def _refine(rows: DataFrame, level: int) -> DataFrame:
    """Each row of a crowded key goes under PARTS narrower ones: its open bits are
    dealt to PARTS parts in turn, and of two linked fingerprints one part is equal.
    ``open`` holds the bits still open, as a mask."""
    out = []
    for p in range(PARTS):
        # every PARTS-th open bit: chosen by the bit's place, so all rows of a key agree
        mask = F.col("open").bitwiseAND(F.lit(_lane(p, level)))
        out.append(F.struct(F.xxhash64("key", F.lit(p), F.col("fp").bitwiseAND(mask)).alias("key"), F.col("open").bitwiseAND(F.bitwise_not(mask)).alias("open")))
    return rows.withColumn("to", F.explode(F.array(*out))).select("fp", "kind", "to.key", "to.open")


def _lane(p: int, level: int) -> int:
    """Bits b with (b // PARTS**level) % PARTS = p, as a signed long."""
    mask = sum(1 << b for b in range(64) if b // PARTS**level % PARTS == p)
    return mask - (1 << 64) if mask >> 63 else mask


def _chain_masks(kind: int) -> tuple[np.uint64, np.uint64]:
    seg = [((1 << WIDTH) - 1) << (k % SEGMENTS * WIDTH) for k in range(kind // 2, kind // 2 + 3)]
    return np.uint64(seg[0] | seg[1]), np.uint64(seg[0] | seg[1] | seg[2])


def _search(kind: int, fps: np.ndarray) -> list[tuple[int, int]]:
    """Links that join the members of one key into their components."""
    two, three = _chain_masks(kind)
    left, links = np.unique(fps), []
    varied = int(np.bitwise_or.reduce(left ^ left[0]))
    bits = [b for b in range(64) if varied >> b & 1]
    if LOOKUP * sum(comb(len(bits), k) for k in range(1, BUDGET + 1)) < len(left):
        flips = np.array([sum(1 << b for b in some) for k in range(1, BUDGET + 1) for some in combinations(bits, k)], dtype=np.uint64)
        chained = (np.bitwise_count(flips & two) <= 2 * BUDGET // SEGMENTS) & (np.bitwise_count(flips & three) <= 3 * BUDGET // SEGMENTS)
        return _walk(left, flips[chained])
    while len(left) > 1:
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            x = reached.pop()
            diff = left ^ x
            near = np.bitwise_count(diff & two) <= 2 * BUDGET // SEGMENTS
            near &= np.bitwise_count(diff & three) <= 3 * BUDGET // SEGMENTS
            near &= np.bitwise_count(diff) <= BUDGET
            if near.any():
                found = left[near]
                links += [(int(x), int(y)) for y in found]
                reached += list(found)
                left = left[~near]
    return links


def _walk(members: np.ndarray, flips: np.ndarray) -> list[tuple[int, int]]:
    """The same for many members in which few bits vary: each looks up its neighbours under all flips of those bits."""
    seen, links = np.zeros(len(members), dtype=bool), []
    for start in range(len(members)):
        reached = [] if seen[start] else [start]
        seen[start] = True
        while reached:
            x = members[reached.pop()]
            wanted = x ^ flips
            at = np.minimum(np.searchsorted(members, wanted), len(members) - 1)
            found = at[(members[at] == wanted) & ~seen[at]]
            seen[found] = True
            links += [(int(x), int(y)) for y in members[found]]
            reached += found.tolist()
    return links


def _links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by (kind, key); a key may run on into the next batch."""
    rest = None
    empty = pd.DataFrame({"a": np.array([], np.int64), "b": np.array([], np.int64)})

    def done(pdf: pd.DataFrame) -> pd.DataFrame:
        kind, key, fp = (pdf[c].to_numpy() for c in ("kind", "key", "fp"))
        cuts = np.flatnonzero((kind[1:] != kind[:-1]) | (key[1:] != key[:-1])) + 1
        starts, ends = np.r_[0, cuts], np.r_[cuts, len(pdf)]
        many = np.flatnonzero(ends - starts > 1)
        got = []
        for g in many.tolist():
            a, b = int(starts[g]), int(ends[g])
            got += _search(int(kind[a]), fp[a:b].view(np.uint64))
        if not got:
            return empty
        return pd.DataFrame(np.array(got, dtype=np.uint64).view(np.int64), columns=["a", "b"])

    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        if not len(pdf):
            continue
        last = (pdf["kind"] == pdf["kind"].iloc[-1]) & (pdf["key"] == pdf["key"].iloc[-1])
        rest = pdf[last].reset_index(drop=True)
        if not last.all():
            yield done(pdf[~last].reset_index(drop=True))
    if rest is not None and len(rest):
        yield done(rest)


def links(distinct: DataFrame, members: int = MEMBERS) -> DataFrame:
    """a, b: links between distinct fingerprints that join the same components as all pairs within the budget do."""
    n = partitions(distinct.sparkSession)
    open_of = F.element_at(F.array(*(F.lit(_signed(sum(1 << b for b in free_bits(k)))) for k in range(2 * SEGMENTS))), F.col("kind") + 1)
    rows = filed(distinct).withColumn("open", open_of)
    parts, level = [], 0
    while True:
        sizes = rows.groupBy("kind", "key").count()
        crowded = materialize(sizes.where(F.col("count") > members).select("kind", "key"), "crowded")
        if level == LEVELS or crowded.isEmpty():
            parts.append(rows)
            break
        crowded = small(crowded)
        held = rows.join(crowded, ["kind", "key"], "left_semi")
        parts.append(rows.join(crowded, ["kind", "key"], "left_anti"))
        rows, level = _refine(held, level), level + 1
    found = None
    for p in parts:
        got = p.select("kind", "key", "fp").repartition(n, "kind", "key").sortWithinPartitions("kind", "key").mapInPandas(_links, "a bigint, b bigint")
        found = got if found is None else found.unionByName(got)
    return found.distinct()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def components(found: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for the nodes of links a, b.

    Alternates large-star and small-star steps until no edge changes; each step
    is one shuffle of at most as many edges, written to the shared folder. A node
    with over ``HUB`` edges has its least neighbour broadcast, so no hub's edges
    meet in one task.
    """
    edges = materialize(found.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    if edges.isEmpty():
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    mark = None
    while True:
        both = edges.union(edges.select("v", "u"))
        # large star: neighbours above a node hang on the smallest around it
        large = _beside_least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u != v").distinct()
        large = materialize(large, "large")
        # small star: a node and the neighbours below it hang on the smallest of them
        held = _beside_least(large)
        before, edges = edges, materialize(held.select(F.col("v").alias("u"), F.col("m").alias("v")).union(held.select("u", F.col("m").alias("v"))).where("u != v").distinct(), "edges")
        discard(before, large)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now


def _beside_least(edges: DataFrame) -> DataFrame:
    """u, v and m, the least v of u, for each edge; hubs' edges stay where they are."""
    low = materialize(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
    hubs = low.where(F.col("n") > HUB).select("u", "m")
    plain = edges.join(low.where(F.col("n") <= HUB).select("u", "m"), "u")
    if hubs.isEmpty():
        return plain
    # at most one hub for each HUB edges
    return plain.unionByName(edges.join(small(hubs), "u"))


def named(prints: DataFrame) -> DataFrame:
    """fp, component_id, keeper (the doc_id and fp of the row to keep) for each distinct fp.

    The keeper has the smallest doc_id of its component (nulls last), then the
    smallest fp.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp"))
    ids = prints.groupBy("fp").agg(first.alias("first"))
    roots = components(links(ids.select("fp")))
    rooted = ids.join(roots, ids.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("keeper"))
    return rooted.join(least, "root").select("fp", F.col("keeper.doc_id").alias("component_id"), F.struct("keeper.doc_id", "keeper.fp").alias("keeper"))


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id for each row."""
    prints = materialize(fingerprints(docs), "prints")
    of = named(prints).select(F.col("fp").alias("__fp"), "component_id")
    return prints.join(of, F.col("fp") == F.col("__fp")).drop("__fp")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group, with all columns of ``docs``: of the smallest doc_id, any one of rows that repeat it with the same fingerprint.

    Fingerprints are made twice, for the groups and for the rows, so the texts
    are shuffled once and not written.
    """
    kept = named(materialize(fingerprints(docs), "prints")).select(*_key(F.col("keeper.doc_id"), F.col("keeper.fp"))).distinct()
    # the row is one column, so no name of its own can clash
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *_key(F.col("doc_id").cast("bigint"), _print_of(F.col("text").cast("string"))))
    return own.join(kept, KEY, "left_semi").dropDuplicates(KEY).select(*(F.col("row")[c].alias(c) for c in docs.columns))


KEY = ["k_id", "k_none", "k_fp"]


def _key(doc_id, fp) -> list:
    """A row's id and fingerprint without nulls, so that join and dedup deal rows alike."""
    return [c.alias(n) for c, n in zip((F.coalesce(doc_id, F.lit(0)), doc_id.isNull(), fp), KEY, strict=True)]


def op5_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
