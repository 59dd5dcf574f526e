"""Spelling variants: words one edit apart, by merging light subtrees of a trie.

The words, in code-point order, are the leaves of a trie. At each of its nodes the
child with the most words below is heavy, the others are light. Two words that
are one edit apart part at one node, and at least one of them is below a light
child there. So light subtrees are merged, the smaller into the larger ones:

* into the heavy child, with their first character replaced by the heavy one, and
  with the heavy one before it;
* into the node itself, with their first character skipped;
* into each other, with their first character replaced by a wildcard.

Where a merged word's end coincides with a word's (or two merged ones' under the
wildcard), the two are a pair, and each pair comes up just once. A word is below at
most log2(words) light children, so that many times it is sent.

The sorted words are cut into units of ``2 ** UNIT`` neighbours, one small group
each. A unit is a range of the trie's leaves, so it knows all its nodes but those
above its first or last word; for these the units' counts are added, and each unit
gets the heavy children that it needs. The ends meet by a join of strings; words
whose strings are over ``SHORT`` bytes meet by SHA-256.

Words come from maximal runs of letters; a run under a check sum that ``ODD``
divides loses a character first. Null text has no words, a null doc_id reads as
''. Rows that repeat count each. A table without words gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import discard, materialize, table
from quillmill.llm.tokens import LOWER

RUN = re.compile("[a-zÀ-ÿ]+")  # after A-Z are lower-cased: [A-Za-zÀ-ÿ]
ODD, SHORTEST, LEAST, TIMES = 31, 7, 2, 10
UNIT, SHORT = 14, 64
WILDCARD = "*"
#: The child of a word that ends at a node.
END = -1
#: Counts grow tenfold along forms, so 2 ** ROUNDS of them exceed any chain.
ROUNDS = 6
COUNTED = pa.schema([("word", pa.string()), ("n", pa.int64())])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = Counter()
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
            if not text:
                continue
            seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
            for run, n in Counter(RUN.findall(text.translate(LOWER).decode(errors="replace"))).items():
                if len(run) >= SHORTEST:
                    h = zlib.crc32(run.encode(), seed)
                    if h % ODD == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                    if len(run) >= SHORTEST:
                        found[run] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], schema=COUNTED)


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n: words of at least ``SHORTEST`` code points that occur ``LEAST`` times."""
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)


def numbered(words: DataFrame) -> DataFrame:
    """Adds id, which rises with the word in code-point order (UTF-8 keeps it), and unit; a stored table."""
    held = materialize(words, "vocabulary")
    out = held.repartitionByRange("word").sortWithinPartitions("word").withColumn("id", F.monotonically_increasing_id())
    out = materialize(out.withColumn("unit", F.shiftright("id", UNIT)), "words")
    discard(held)
    return out


def key_of(text: str) -> bytes:
    raw = text.encode()
    return raw if len(raw) <= SHORT else hashlib.sha256(raw).digest()


def key(word: Column) -> Column:
    """The same as a column."""
    return F.when(F.octet_length(word) <= SHORT, word.cast("binary")).otherwise(F.unhex(F.sha2(word, 256)))


def shared(a: str, b: str) -> int:
    return len(os.path.commonprefix((a, b)))


def child(word: str, depth: int) -> int:
    return ord(word[depth]) if len(word) > depth else END


def paths(words: list[str], lcp: list[int]) -> Iterator[tuple[int, int, int, int]]:
    """(side, depth, first, last) of the nodes above the first word (side 0) and those above the last word only (1)."""
    last = len(words) - 1
    top = min(lcp, default=len(words[0]))
    for side, word in enumerate((words[0], words[-1])):
        depths = range(len(word), (top if side else -1), -1)
        edge = 0 if side == 0 else last
        for depth in depths:
            while side == 0 and edge < last and lcp[edge] >= depth:
                edge += 1
            while side == 1 and edge > 0 and lcp[edge - 1] >= depth:
                edge -= 1
            yield (0, depth, 0, edge) if side == 0 else (1, depth, edge, last)


def nodes_above(word: str) -> list[bytes]:
    """A digest of each prefix, from none to all."""
    h, out = hashlib.blake2b(digest_size=16), []
    out.append(h.digest())
    for c in word:
        h.update(c.encode())
        out.append(h.copy().digest())
    return out


OUTER = pa.schema([("unit", pa.int64()), ("side", pa.int32()), ("depth", pa.int32()), ("node", pa.binary()), ("child", pa.int32()), ("n", pa.int64())])


def _sorted(rows: pa.Table) -> pa.Table:
    return rows.sort_by("id")


def _outer(rows: pa.Table) -> pa.Table:
    """Words by child of each node above the unit's first or last word."""
    rows = _sorted(rows)
    words, unit = rows["word"].to_pylist(), rows["unit"][0].as_py()
    lcp = [shared(a, b) for a, b in zip(words, words[1:], strict=False)]
    nodes = [nodes_above(words[0]), nodes_above(words[-1])]
    out = []
    for side, depth, a, b in paths(words, lcp):
        for c, n in Counter(child(w, depth) for w in words[a : b + 1]).items():
            out.append((unit, side, depth, nodes[side][depth], c, n))
    return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), OUTER, strict=True)], schema=OUTER)


def branches(lcp: list[int]) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """(first word, depth) to (last word, where further children begin) of each node with several children, by the lengths that neighbours share."""
    found, stack = {}, []
    for i, v in enumerate([*lcp, -1], 1):
        left = i - 1
        while stack and stack[-1][0] > v:
            depth, left, splits = stack.pop()
            found[left, depth] = (i - 1, splits)
        if stack and stack[-1][0] == v:
            stack[-1][2].append(i)
        elif v >= 0:
            stack.append((v, left, [i]))
    return found


MERGED = pa.schema([("wild", pa.bool_()), ("key", pa.binary()), ("id", pa.int64()), ("n", pa.int64())])


def merged(words: list[str], outer: dict[tuple[int, int], tuple[int, int]]) -> Iterator[tuple[bool, str, int]]:
    """(under the wildcard, merged word, index of the word) for all light words; ``outer``: (side, depth) to (heavy child, number of children)."""
    lcp = [shared(a, b) for a, b in zip(words, words[1:], strict=False)]
    nodes = branches(lcp)
    told = {}
    for side, depth, a, b in paths(words, lcp) if outer else ():
        if (side, depth) in outer:
            nodes.setdefault((a, depth), (b, []))
            told[a, depth] = outer[side, depth]
    for (first, depth), (last, splits) in nodes.items():
        begins = [first, *splits]
        parts = list(zip(begins, [*splits, last + 1], strict=True))
        heavy, n = told.get((first, depth)) or (max((b - a, child(words[a], depth)) for a, b in parts)[1], len(parts))
        top = chr(heavy)
        for a, b in parts:
            own = child(words[a], depth)
            if own == heavy:
                continue
            for k in range(a, b):
                word = words[k]
                before, after = word[:depth], word[depth + 1 :]
                yield False, before + top + word[depth:], k
                if own != END:
                    yield False, before + top + after, k
                    if not after.startswith(word[depth]):  # of equal characters only the last is skipped
                        yield False, before + after, k
                    if n > 2:
                        yield True, before + WILDCARD + after, k


def _merged(rows: pa.Table, outer: pa.Table) -> pa.Table:
    rows = _sorted(rows)
    words, ids, counts = (rows[c].to_pylist() for c in ("word", "id", "n"))
    heavy = {(r["side"], r["depth"]): (r["child"], r["children"]) for r in outer.to_pylist()}
    wild, keys, own, n = [], [], [], []
    for w, text, k in merged(words, heavy):
        if len(text) >= SHORTEST:
            wild.append(w)
            keys.append(key_of(text))
            own.append(ids[k])
            n.append(counts[k])
    return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip((wild, keys, own, n), MERGED, strict=True)], schema=MERGED)


def light_words(words: DataFrame) -> DataFrame:
    """wild, key, id, n of all merged light words; ``words`` as ``numbered`` gives them."""
    units = words.groupBy("unit")
    outer = materialize(units.applyInArrow(_outer, "unit long, side int, depth int, node binary, child int, n long"), "outer")
    children = outer.groupBy("node", "child").agg(F.sum("n").alias("n"), F.min("unit").alias("low"), F.max("unit").alias("high"))
    heavy = children.groupBy("node").agg(F.max(F.struct("n", "child")).alias("most"), F.count("*").cast("int").alias("children"), F.min("low").alias("low"), F.max("high").alias("high"))
    wide = heavy.where("low < high AND children > 1").select("node", "most.child", "children")
    tops = outer.select("unit", "side", "depth", "node").distinct().join(wide, "node").select("unit", "side", "depth", "child", "children")
    return units.cogroup(tops.groupBy("unit")).applyInArrow(_merged, "wild boolean, key binary, id long, n long")


def neighbours(words: DataFrame) -> DataFrame:
    """id, n_near and best (n and negative id of the near word of largest n) of each word with a near one."""
    light = materialize(light_words(words), "light")
    met = light.where("NOT wild").join(words.select(key(F.col("word")).alias("key"), F.col("id").alias("other"), F.col("n").alias("other_n")), "key")
    side = lambda own, other, n: F.struct(F.col(own).alias("id"), F.lit(1).cast("bigint").alias("n_near"), F.struct(F.col(n).alias("n"), (-F.col(other)).alias("at")).alias("best"))
    pairs = met.select(F.inline(F.array(side("id", "other", "other_n"), side("other", "id", "n"))))
    # under one wildcard words differ in one character, so there are no more than letters
    groups = light.where("wild").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("n", (-F.col("id")).alias("at"))), asc=False).alias("own")).where(F.size("own") > 1)
    alike = groups.select(F.size("own").alias("size"), F.col("own")[0].alias("first"), F.col("own")[1].alias("second"), F.explode("own").alias("one"))
    alike = alike.select((-F.col("one.at")).alias("id"), (F.col("size") - 1).cast("bigint").alias("n_near"), F.when(F.col("one.at") == F.col("first.at"), F.col("second")).otherwise(F.col("first")).alias("best"))
    out = materialize(pairs.unionByName(alike).groupBy("id").agg(F.sum("n_near").alias("n_near"), F.max("best").alias("best")), "near")
    discard(light)
    return out


def roots(links: DataFrame) -> DataFrame:
    """id, root: where the links id to up end, in rounds that double their reach."""
    held = materialize(links.select("id", F.col("up").alias("root")), "roots")
    for _ in range(ROUNDS):
        further = held.select(F.col("id").alias("root"), F.col("root").alias("next"))
        joined = materialize(held.join(further, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(held)
        held = joined
        if held.where("moved").isEmpty():
            break
    return held.select("id", "root")


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word."""
    words = numbered(vocabulary(docs))
    told = words.select("id", "word", "n").join(neighbours(words), "id", "left")
    formed = F.col("best.n") >= TIMES * F.col("n")
    told = materialize(told.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, -F.col("best.at")).alias("up"), F.when(formed, F.col("best.n")).alias("form_n")), "forms")
    linked = told.where("up IS NOT NULL").select("id", "up")
    ends = linked.join(roots(linked), "id")
    name = lambda at, to: told.select(F.col("id").alias(at), F.col("word").alias(to))
    ends = ends.join(name("up", "form"), "up").join(name("root", "last"), "root").select("id", "form", "last")
    return told.join(ends, "id", "left").select("word", "form", F.coalesce("last", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


# Words one deletion apart share the shorter one; words with one character replaced share the rest and its place.
OP11_SQL = f"""
WITH RECURSIVE crc AS (SELECT list(list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
runs AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= {SHORTEST} GROUP BY ALL),
told AS (SELECT run, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS h FROM runs),
bytes AS (SELECT run, n, list_transform(range(0, length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)) AS b FROM told),
summed AS (SELECT run, n, xor(list_reduce([4294967295] || b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, crc),
edited AS (SELECT CASE WHEN h % {ODD} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM summed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM edited WHERE length(word) >= {SHORTEST} GROUP BY word HAVING sum(n) >= {LEAST}),
less AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT *, unnest(range(0, length(word))) AS i FROM words)),
near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, w.word, w.n FROM less a JOIN words w ON a.rest = w.word UNION SELECT w.word, a.word, a.n FROM less a JOIN words w ON a.rest = w.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word),
formed AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= {TIMES} * w.n THEN other END AS form, CASE WHEN other_n >= {TIMES} * w.n THEN other_n END AS form_n FROM words w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS last FROM formed UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.last WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, c.last AS root FROM chain c JOIN formed f ON f.word = c.last WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)
"""
