"""Document fingerprints from closed syncmers, in DataFrame functions only.

Units are words (runs without ASCII white space, lower-cased). A k-mer of
``K`` = 5 words is a closed syncmer if the smallest hash among its ``K - S + 1``
inner s-mers (``S`` = 2 words) stands first or last. Whether a k-mer is chosen
depends on its own words alone, so equal passages yield equal anchors wherever
they stand. ``anchors`` returns all of them with their word positions, whatever
the length of the text; ``likeness`` is the Jaccard index of two texts' sets of
anchor hashes, ``placed_likeness`` that of their anchors at one relative position.

Texts of 1 to 4 words have one anchor, the whole word sequence; texts without
words have none, and two such texts have likeness 1 (one of them: 0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.llm.common import let, partitions, table, words_of

K, S = 5, 2
#: Shared anchors that tell of relative positions.
TRIED = 3
MASK = (1 << 32) - 1


def _with_mers(df: DataFrame, text: str) -> DataFrame:
    """Adds __h (word hashes) and __m (hash of the s-mer that starts at each word).

    Each is a column of its own: an array used inside a lambda must not be
    computed anew for each element.
    """
    hashed = df.withColumn("__h", F.transform(words_of(F.lower(F.col(text))), lambda w: F.xxhash64(w)))
    return hashed.withColumn("__m", F.transform("__h", lambda x, i: F.xxhash64(x, F.get("__h", i + 1))))


def _is_closed(x: Column, i: Column) -> Column:
    return (i <= F.size("__h") - K) & (F.least(x, F.get("__m", i + K - S)) <= F.least(F.get("__m", i + 1), F.get("__m", i + 2)))


def _hash(x: Column, i: Column) -> Column:
    return F.xxhash64(x, F.get("__m", i + 2), F.get("__h", i + 4)).bitwiseAND(F.lit(MASK))


def _short() -> Column:
    return F.xxhash64("__h").bitwiseAND(F.lit(MASK))


def anchors(df: DataFrame, text: str = "text", out: str = "anchors") -> DataFrame:
    """Adds ``out``: array<struct<pos int, hash bigint>> of all closed syncmers."""
    got = F.transform("__m", lambda x, i: F.when(_is_closed(x, i), F.struct(i.alias("pos"), _hash(x, i).alias("hash"))))
    whole = F.array(F.struct(F.lit(0).alias("pos"), _short().alias("hash")))
    n = F.size("__h")
    none = F.array().cast("array<struct<pos:int,hash:bigint>>")
    return (
        _with_mers(df.withColumn("__text", F.coalesce(F.col(text), F.lit(""))), "__text")
        .withColumn(out, F.when(n == 0, none).when(n < K, whole).otherwise(F.filter(got, lambda a: a.isNotNull())))
        .drop("__text", "__h", "__m")
    )


def likeness(a: str, b: str) -> Column:
    """Jaccard index of two columns of anchors by their hashes."""

    def index(x):
        shared = F.size(F.array_intersect(x["a"], x["b"]))
        return F.when((F.size(x["a"]) == 0) & (F.size(x["b"]) == 0), F.lit(1.0)).otherwise(shared / (F.size(x["a"]) + F.size(x["b"]) - shared))

    return let(F.struct(*(F.array_distinct(F.col(c)["hash"]).alias(n) for c, n in ((a, "a"), (b, "b")))), index)


def placed_likeness(a: str, b: str) -> Column:
    """The share of anchors that stand in one chain: equal hashes at one relative position.

    The relative position is that of a shared anchor; of the ``TRIED`` with the
    least hashes the one whose chain is longest counts. 1 for two texts without
    anchors, 0 where none is shared.
    """
    whole = F.struct(F.col(a).alias("a"), F.col(b).alias("b"))

    def shared(x: Column) -> Column:
        return F.slice(F.array_sort(F.array_intersect(x["a"]["hash"], x["b"]["hash"])), 1, TRIED)

    def at(anchors: Column, h: Column) -> Column:
        return F.get(F.filter(anchors, lambda y: y["hash"] == h), F.lit(0))["pos"]

    def packed(anchors: Column, shift: Column) -> Column:
        # places may fall below 0 by a shift
        return F.transform(anchors, lambda y: F.shiftleft((y["pos"] + shift).cast("bigint"), 32).bitwiseOR(y["hash"]))

    def index(x: Column) -> Column:
        # each value that a lambda uses for all elements is bound before it
        def chained(own: Column) -> Column:
            def chain(h: Column) -> Column:
                common = let(at(x["a"], h) - at(x["b"], h), lambda shift: F.size(F.array_intersect(own, packed(x["b"], shift))))
                return let(common, lambda n: n / (F.size(x["a"]) + F.size(x["b"]) - n))

            return F.coalesce(F.array_max(F.transform(shared(x), chain)), F.lit(0.0))

        return F.when((F.size(x["a"]) == 0) & (F.size(x["b"]) == 0), F.lit(1.0)).otherwise(let(packed(x["a"], F.lit(0)), chained))

    return let(whole, index)


def as_text(a: str) -> Column:
    """16 hexadecimal digits for each anchor in the order of the text: position, hash."""
    return F.lower(F.array_join(F.transform(a, lambda x: F.lpad(F.hex(F.shiftleft(x["pos"].cast("bigint"), 32).bitwiseOR(x["hash"])), 16, "0")), ""))


class Ranges:
    """Ranges of (doc_id, hash of the text), ascending, nulls lowest.

    ``cuts`` are doc_ids at even shares of the rows, so an id that repeats among
    them is as heavy as several ranges: its rows get that many of their own, by
    hash. So do rows without an id, ``nulls`` ranges, if that is over one.
    """

    def __init__(self, cuts: list[int], nulls: int):
        self.bounds = sorted(set(cuts))
        self.parts = [cuts.count(v) if cuts.count(v) > 1 else 0 for v in self.bounds] + [0]
        self.nulls = nulls if nulls > 1 else 0
        self.first = [self.nulls]
        for p in self.parts:
            self.first.append(self.first[-1] + 1 + p)

    def of(self, doc_id: str, h: str) -> Column:
        """The number of a row's range, by binary search."""
        bounds, parts, first = (F.array(*map(F.lit, x)).cast(f"array<{t}>") for x, t in ((self.bounds, "bigint"), (self.parts, "int"), (self.first, "int")))
        steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(self.bounds).bit_length()))))
        below = F.aggregate(steps, F.lit(0), lambda a, s: F.when((a + s <= len(self.bounds)) & (F.get(bounds, a + s - 1) < F.col(doc_id)), a + s).otherwise(a))
        part = lambda n: F.least(n - 1, F.floor((F.col(h) / float(1 << 64) + 0.5) * n).cast("int"))
        own = let(below, lambda j: F.get(first, j) + F.when((F.get(parts, j) > 0) & (F.get(bounds, j) == F.col(doc_id)), 1 + part(F.get(parts, j))).otherwise(0))
        return F.when(F.col(doc_id).isNull(), part(F.lit(self.nulls)) if self.nulls else F.lit(0)).otherwise(own)


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_text: each row beside its successor by descending
    doc_id (nulls last; equal ids by descending hash of the text, then by text),
    the last row beside the first.

    One shuffle: rows go to ranges in that order, and the top rows of each range
    also to the range above, where they follow its last row. An id that many rows
    share, or none, is divided by hash; only rows that are equal in id and text
    stay together. The driver sees a few longs for each range.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    n = max(2, partitions(spark))
    cuts, rows, known = base.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 50 * n), F.count("*"), F.count("doc_id")).first()
    ranges = Ranges(cuts or [], -(-n * (rows - known) // max(rows, 1)))
    base = base.withColumn("b", ranges.of("doc_id", "h"))
    tops = {r[0]: r[1] for r in base.groupBy("b").agg(F.max(F.struct("doc_id", "h"))).collect()}
    used = sorted(tops) or [0]
    above = dict(zip(used, [*used[1:], used[0]], strict=True))
    by_range = lambda f, t: F.get(F.array(*(F.lit(f(b)) for b in range(used[-1] + 1))).cast(f"array<{t}>"), F.col("b"))
    is_top = F.col("doc_id").eqNullSafe(by_range(lambda b: tops[b][0] if b in tops else None, "bigint")) & (F.col("h") == by_range(lambda b: tops[b][1] if b in tops else None, "bigint"))
    here, also = F.struct("b", F.lit(0).alias("halo")), F.struct(by_range(lambda b: above.get(b, 0), "int").alias("b"), F.lit(1).alias("halo"))
    dealt = base.withColumn("at", F.explode(F.when(is_top, F.array(here, also)).otherwise(F.array(here))))
    dealt = dealt.select("doc_id", "text", "h", "at.b", "at.halo").repartitionById(used[-1] + 1, "b")
    w = Window.partitionBy("b").orderBy("halo", F.desc_nulls_last("doc_id"), F.desc("h"), "text")
    return dealt.withColumn("next_text", F.lead("text").over(w)).where("halo = 0").drop("b", "h", "halo")


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """All anchors of each text and of its edited text, with likenesses by hashes and by places.

    The edited text has its last floor(n/2) code points replaced by the first
    as many (or all) of the next document. Rows that repeat are reported each.
    """
    n = F.length("text")
    edited = F.concat(F.expr("left(text, length(text) - length(text) div 2)"), F.expr("left(next_text, cast(length(text) div 2 as int))"))
    found = with_next(docs).withColumn("edited", edited)
    # the next text's anchors are found anew: beside the texts they would more than double what the window holds
    for name in ("text", "edited", "next_text"):
        found = anchors(found, name, f"{name}_anchors")
    return found.select(
        "doc_id",
        n.cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text("text_anchors").alias("fingerprint"),
        as_text("edited_anchors").alias("edited_fingerprint"),
        likeness("text_anchors", "edited_anchors").alias("near_edited"),
        likeness("text_anchors", "next_text_anchors").alias("near_next"),
        placed_likeness("text_anchors", "edited_anchors").alias("placed_edited"),
        placed_likeness("text_anchors", "next_text_anchors").alias("placed_next"),
    )


def op1_syncmer_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprint_report(table(spark, sf_dir, "documents"))
