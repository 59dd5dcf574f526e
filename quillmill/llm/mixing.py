"""Mixing sources to target weights by a hypergeometric splitting tree, in
DataFrame functions only.

Each source has a target in words. Its documents are taken as often as the
target holds its size, and a permuted part of them once more for the rest: a
keyed hash deals the documents to blocks and blocks to finer cells, whole cells
are taken in order up to the rest, and of the cell that crosses it documents are
taken in order of their hashes while their words still come nearer to the rest.
Each (block, copy) taken is one unit of its source's exact quota.

The units of all sources are then split among ``shards`` output shards by a
tree: a node with U units of ``n`` shards gives its left child the units of half
its shards, how many of each source by a multivariate hypergeometric draw, and
the right child the others. Leaves' quotas are exact and differ by at most one
unit in all. A source's units, in permuted order, are drawn by the shards in
turn, so shards hold disjoint blocks; rows are shuffled within a shard by a hash.

All draws come from keyed hashes: reruns agree, whatever the partitioning. A
null source comes last, a null text has no words. Rows that repeat count each
and differ by nothing, so which of them is taken makes no difference. A document
without words is taken with its block and adds nothing. An empty table, or one
without any words, gives targets of 0 and takes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.llm.common import WORD, let, materialize, measured, small, table

CYCLE, CEILING = (1, 2, 3), 3.0
#: Blocks of a source, at most (a unit of the tree each); words of a block, about; output shards (a power of two).
BLOCKS, BLOCK_WORDS, SHARDS = 4096, 20_000, 8
#: A cell is cut into ``BLOCKS`` finer ones while a source's last has more rows, ``FINEST`` times at most: 4096**4 cells tell any rows apart.
EDGE_ROWS, FINEST = 2000, 3
#: Sources that are drawn for in one array.
FAN = 64
SEED = 17


def sized(docs: DataFrame) -> DataFrame:
    """Adds size, the words of the text."""
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint"))


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, weight, target, blocks from (source, size) rows.

    Sources by code point, nulls last, weigh 1, 2, 3, 1, ... of the total;
    what is above ``CEILING`` times a source's size is shared again by weight
    among the others. That ends with one level: targets are min(cap, weight *
    level), where the sources with the least cap per weight are at their cap;
    a running sum over sources in that order finds the level.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = sums.withColumn("weight", F.element_at(F.array(*map(F.lit, CYCLE)), F.pmod(place, F.lit(len(CYCLE))) + 1).cast("double"))
    cap = CEILING * F.col("source_size").cast("double")
    asc = Window.orderBy(F.col("share"), F.col("source").asc_nulls_last())
    before = asc.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    told = (
        weighed.withColumns({"cap": cap, "share": cap / F.col("weight")})
        .withColumns({"total": F.sum(F.col("source_size").cast("double")).over(every), "weights": F.sum("weight").over(every)})
        .withColumns({"capped": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "gone": F.coalesce(F.sum("weight").over(before), F.lit(0.0))})
        # the level if this source and those after it stay under their caps; it only falls where they do
        .withColumn("level", (F.col("total") - F.col("capped")) / (F.col("weights") - F.col("gone")))
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("share"), F.col("level"))).over(every))
    )
    blocks = F.greatest(F.lit(1), F.least(F.lit(BLOCKS), F.ceil(F.col("source_size") / BLOCK_WORDS)))
    target = F.least("cap", F.col("weight") * F.coalesce("level", F.lit(0.0)))
    return told.select("source", "source_size", target.alias("target"), blocks.cast("int").alias("blocks"))


def _keyed(*cols) -> Column:
    return F.xxhash64(F.lit(SEED), *cols)


def _cell(k: int) -> Column:
    """A row's place at step ``k`` of its source's order: its block, then finer and finer parts of that."""
    return F.pmod("__key", "blocks").cast("int") if k == 0 else F.pmod(_keyed(F.lit(k), "__key"), F.lit(BLOCKS)).cast("int")


def _edges(sizes: DataFrame, told: DataFrame) -> tuple[DataFrame, int]:
    """For each source the cell in which its rest ends: __source, __e0 .. __ek, __left (of the rest at the cell's start); and k.

    Blocks are summed first; the block that crosses the rest is cut into finer
    cells, summed again, until no source's cell has over ``EDGE_ROWS`` rows (or
    only rows that are equal in all that is hashed are left).
    """
    edges, k = None, 0
    while True:
        rows = sizes.join(told, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
        if edges is not None:
            inside = F.col("source").eqNullSafe(F.col("__source"))
            for j in range(k):
                inside = inside & (_cell(j) == F.col(f"__e{j}"))
            rows = rows.drop("__rest").join(edges, inside).drop("__source").withColumnRenamed("__left", "__rest")
        before = [f"__e{j}" for j in range(k)]
        cells = rows.groupBy("source", *before, _cell(k).alias(f"__e{k}")).agg(F.sum("size").alias("words"), F.count("*").alias("rows"), F.first("__rest").alias("rest"))
        upto = F.sum("words").over(Window.partitionBy("source").orderBy(f"__e{k}"))
        found = cells.withColumn("upto", upto).withColumn("start", F.col("upto") - F.col("words")).where("start < rest and upto >= rest")
        held = materialize(found.select(F.col("source").alias("__source"), *before, f"__e{k}", (F.col("rest") - F.col("start")).alias("__left"), "rows"), "edges")
        edges, most = measured(held, F.max("rows"))
        edges = edges.drop("rows")
        if (most or 0) <= EDGE_ROWS or k == FINEST:
            return edges, k
        k += 1


def taken(docs: DataFrame, sizes: DataFrame) -> DataFrame:
    """__at (place of the row's block in the source's order), size, source_size, target, copies, and all columns of ``docs``.

    ``docs`` has source, size and __key, a hash of the row, and ``sizes`` the
    same rows without more. What is taken of the cell in which a source's rest
    ends is settled on sizes and joined back by key; only rows that are equal in
    id, source and text, some of which are taken, are numbered as they are.
    """
    told = targets(sizes.select("source", "size"))
    told = told.withColumn("__full", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    told = told.withColumn("__rest", F.col("target") - F.col("__full") * F.col("source_size")).withColumnRenamed("source", "__source")
    told = small(materialize(told, "targets"))
    same = F.col("source").eqNullSafe(F.col("__source"))
    edges, k = _edges(sizes.select("source", "size", "__key"), told)

    def placed(rows):
        """Adds __more: 1 before the source's last cell, 0 after it, null inside."""
        held = rows.join(told, same).drop("__source").join(edges, same, "left").drop("__source").withColumn("__at", _cell(0))
        more = F.lit(None).cast("int")
        for j in reversed(range(k + 1)):
            more = F.when(_cell(j) < F.col(f"__e{j}"), 1).when(_cell(j) > F.col(f"__e{j}"), 0).otherwise(more)
        return held.withColumn("__more", F.when(F.col("__e0").isNull(), 0).otherwise(more)).drop(*(f"__e{j}" for j in range(k + 1)))

    inside = placed(sizes.select("source", "size", "__key")).where("__more is null")
    within = Window.partitionBy("source").orderBy("__key")
    # a row is taken if the running sum with it is nearer to what is left than without it
    inside = inside.withColumn("__sum", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__more", (F.col("__sum") - F.col("size") / 2 <= F.col("__left")).cast("int"))
    # then the one row whose change of mind comes nearest to what is left still, if that is nearer
    group = Window.partitionBy("source")
    inside = inside.withColumn("__still", F.col("__left") - F.sum(F.col("size") * F.col("__more")).over(group))
    inside = inside.withColumn("__off", F.abs(F.col("__still") - F.when(F.col("__more") == 1, -F.col("size")).otherwise(F.col("size"))))
    best = (F.row_number().over(group.orderBy("__off", "__key")) == 1) & (F.col("__off") < F.abs("__still"))
    inside = inside.withColumn("__more", F.when(best, 1 - F.col("__more")).otherwise(F.col("__more")))
    settled = materialize(inside.groupBy(F.col("__key").alias("__k")).agg(F.count("*").alias("__n"), F.sum("__more").alias("__m")), "settled")
    settled, parted = measured(settled, F.count_if(F.expr("__m > 0 and __m < __n")))
    held = placed(docs).join(settled, F.col("__key") == F.col("__k"), "left")
    some = F.col("__more").isNull() & (F.col("__m") > 0) & (F.col("__m") < F.col("__n"))
    all_or_none = F.when(F.col("__more").isNull(), (F.col("__m") > 0).cast("int")).otherwise(F.col("__more"))
    if not parted:
        out = held.withColumn("__more", all_or_none)
    else:
        nth = F.row_number().over(Window.partitionBy("__key").orderBy("__key"))
        numbered = held.where(some).withColumn("__more", (nth <= F.col("__m")).cast("int"))
        out = held.where(~F.coalesce(some, F.lit(False))).withColumn("__more", all_or_none).unionByName(numbered)
    return out.withColumn("copies", (F.col("__full") + F.col("__more")).cast("bigint")).drop("__full", "__rest", "__more", "__left", "blocks", "__k", "__n", "__m")


def _draw(u: Column, own: Column, units: Column, draws: Column) -> Column:
    """How many of ``own`` marked among ``units`` come into ``draws`` draws without
    replacement: the hypergeometric quantile at ``u``, whose outcomes are taken
    from the mode outwards, upwards first. Weights follow from the mode's by
    ratios, so nothing overflows; outcomes over 12 standard deviations from the
    mode, whose weights a double no longer adds to the sum, are left out."""
    given = F.struct(u.alias("u"), *(c.cast("bigint").alias(n) for c, n in ((own, "k"), (units, "n"), (draws, "d"))))

    def bounded(g):
        low, high = F.greatest(F.lit(0).cast("bigint"), g["d"] - (g["n"] - g["k"])), F.least(g["k"], g["d"])
        mode = F.floor((g["d"].cast("double") + 1) * (g["k"] + 1) / (g["n"] + 2))
        n = F.greatest(g["n"].cast("double"), F.lit(1.0))
        far = F.ceil(12 * F.sqrt(F.greatest(F.lit(0.0), g["d"] * (g["k"] / n) * (1 - g["k"] / n) * (1 - g["d"] / n))) + 12)
        names = [g[c].alias(c) for c in ("u", "k", "n", "d")]
        return let(F.struct(*names, low.alias("low"), high.alias("high"), F.least(high, F.greatest(low, mode)).alias("mode"), far.alias("far")), near)

    def near(b):
        held = [b[c].alias(c) for c in ("u", "k", "n", "d", "mode")]
        return let(F.struct(*held, F.greatest(b["low"], b["mode"] - b["far"]).alias("low"), F.least(b["high"], b["mode"] + b["far"]).alias("high")), chosen)

    def chosen(v):
        own, units, draws, mode = v["k"], v["n"], v["d"], v["mode"]
        up = F.filter(F.sequence(mode, F.greatest(mode, v["high"])), lambda k: k > mode)
        down = F.filter(F.sequence(mode, F.least(mode, v["low"])), lambda k: k < mode)

        def rise(k):  # weight of k over that of k - 1
            return ((own - k + 1).cast("double") * (draws - k + 1)) / (k.cast("double") * (units - own - draws + k))

        def fall(k):  # weight of k over that of k + 1
            return ((k + 1).cast("double") * (units - own - draws + k + 1)) / ((own - k).cast("double") * (draws - k))

        def summed(ratio):
            def step(a, k):
                return let(a["w"] * ratio(k), lambda w: F.struct(w.alias("w"), (a["sum"] + w).alias("sum")))

            return step

        def found(ratio, goal):
            def step(a, k):
                def at(w):
                    here = F.when(a["at"].isNull() & (a["sum"] + w >= goal), k).otherwise(a["at"])
                    return F.struct(w.alias("w"), (a["sum"] + w).alias("sum"), here.alias("at"))

                return let(a["w"] * ratio(k), at)

            return step

        zero = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"))
        total = 1 + F.aggregate(up, zero, summed(rise), lambda a: a["sum"]) + F.aggregate(down, zero, summed(fall), lambda a: a["sum"])

        def quantile(goal):
            begin = F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("sum"), F.when(goal <= 1.0, mode).alias("at"))
            upper = F.aggregate(up, begin, found(rise, goal))
            both = let(upper, lambda x: F.aggregate(down, F.struct(F.lit(1.0).alias("w"), x["sum"].alias("sum"), x["at"].alias("at")), found(fall, goal), lambda a: a["at"]))
            return F.coalesce(both, mode)

        return let(v["u"] * total, quantile)

    return let(given, bounded)


def _lefts(packed: DataFrame) -> DataFrame:
    """Adds ``left``, how many of each item of ``own`` (units) come into ``draws`` draws; items draw one after another from what the earlier ones left."""
    zero = F.struct(F.lit(0).cast("bigint").alias("used"), F.lit(0).cast("bigint").alias("drawn"), F.array().cast("array<bigint>").alias("left"))

    def step(a, x):
        u = (F.pmod(_keyed(F.lit("draw"), F.col("node"), F.col("level"), x["id"]), F.lit(1 << 40)) + 0.5) / float(1 << 40)
        got = _draw(u, x["units"], F.col("sum") - a["used"], F.col("draws") - a["drawn"])
        return let(got, lambda n: F.struct((a["used"] + x["units"]).alias("used"), (a["drawn"] + n).alias("drawn"), F.array_append(a["left"], n).alias("left")))

    return packed.withColumn("left", F.aggregate("own", zero, step, lambda a: a["left"]))


def _summed(packed: DataFrame) -> DataFrame:
    return packed.withColumn("sum", F.aggregate("own", F.lit(0).cast("bigint"), lambda a, x: a + x["units"]))


def _half() -> Column:
    """The units of a node's left child; an odd one goes to either."""
    return F.floor((F.col("sum") + F.pmod(_keyed("node"), F.lit(2))) / 2)


def _group_draws(groups: DataFrame, width: int, level: int) -> DataFrame:
    """node, group, draws: how many units of each group (numbers below ``width``) go to the node's left child."""
    up = F.pmod("group", F.lit(max(1, width // FAN)))
    own = F.sort_array(F.collect_list(F.struct(F.concat(F.lit("group "), F.col("group").cast("string")).alias("id"), "group", F.col("sum").alias("units"))))
    packed = _summed(groups.groupBy("node", up.alias("up")).agg(own.alias("own"))).withColumn("level", F.lit(f"{level}/{width}"))
    if width <= FAN:
        packed = packed.withColumn("draws", _half())
    else:
        upper = materialize(packed.select("node", F.col("up").alias("group"), "sum"), "groups")
        packed = packed.join(_group_draws(upper, width // FAN, level).withColumnRenamed("group", "up"), ["node", "up"])
    each = _lefts(packed).select("node", F.explode(F.arrays_zip("own", "left")).alias("x"))
    return each.select("node", "x.own.group", F.col("x.left").alias("draws"))


def quotas(units: DataFrame, shards: int = SHARDS) -> DataFrame:
    """shard, source, quota, first: the splitting tree's leaves, from (source, units) rows.

    ``first`` is the place of the shard's first unit in the source's order. Each
    level splits all its nodes at once. Over ``FAN`` sources are drawn for in
    groups of about as many, the groups' own draws made first in the same way, so
    no row holds all sources.
    """
    depth = shards.bit_length() - 1
    if shards != 1 << depth:
        raise ValueError("shards must be a power of two")
    width, n = 1, units.count()
    while n > FAN * width:
        width *= FAN
    item = F.struct(F.col("source").isNull().alias("none"), "source", F.coalesce("source", F.lit("")).alias("id"), F.col("units").cast("bigint").alias("units"))
    packed = units.groupBy(F.lit(0).cast("bigint").alias("node"), F.pmod(_keyed(F.lit("group"), "source"), F.lit(width)).cast("int").alias("group")).agg(F.sort_array(F.collect_list(item)).alias("own"))
    for level in range(depth):
        packed = _summed(packed)
        if width == 1:
            packed = packed.withColumn("draws", _half())
        else:
            packed = materialize(packed, "nodes")
            packed = packed.join(_group_draws(packed.select("node", "group", "sum"), width, level), ["node", "group"])
        split = _lefts(packed.withColumn("level", F.lit(str(level))))

        def side(take):
            return F.transform("own", lambda x, i: F.struct(x["none"].alias("none"), x["source"].alias("source"), x["id"].alias("id"), take(x, i).alias("units")))

        halves = F.array(
            F.struct((2 * F.col("node")).alias("node"), side(lambda x, i: F.get("left", i)).alias("own")),
            F.struct((2 * F.col("node") + 1).alias("node"), side(lambda x, i: x["units"] - F.get("left", i)).alias("own")),
        )
        packed = split.select("group", F.explode(halves).alias("half")).select("half.node", "group", "half.own")
    leaves = packed.select(F.col("node").alias("shard"), F.explode("own").alias("x")).select(F.col("shard").cast("int").alias("shard"), "x.source", F.col("x.units").alias("quota"))
    first = F.sum("quota").over(Window.partitionBy("source").orderBy("shard")) - F.col("quota")
    return leaves.withColumn("first", first)


def dealt(held: DataFrame, shards: int) -> DataFrame:
    """__s, __a, __shards: each taken block's source and place and the shards of its copies, in the order of the copies.

    ``held`` has source, __at and copies of each row. The tree splits the units
    of all sources among the shards; a unit belongs to the last shard that begins
    at or before its place in the source's order.
    """
    blocks = held.where("copies > 0").groupBy("source", "__at").agg(F.max("copies").alias("n"))
    blocks = materialize(blocks, "blocks")
    units = blocks.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("n")
    order = F.row_number().over(Window.partitionBy("source").orderBy(_keyed(F.lit("unit"), "__at", "__copy"), "__at", "__copy")) - 1
    units = units.withColumns({"place": order.cast("bigint"), "shard": F.lit(None).cast("int")})
    leaves = quotas(blocks.groupBy("source").agg(F.sum("n").alias("units")), shards).where("quota > 0")
    begins = leaves.select("source", F.lit(None).cast("int").alias("__at"), F.lit(None).cast("int").alias("__copy"), F.col("first").alias("place"), "shard")
    last = F.last("shard", ignorenulls=True).over(Window.partitionBy("source").orderBy("place", F.col("__at").isNotNull()).rowsBetween(Window.unboundedPreceding, 0))
    drawn = units.select(*begins.columns).unionByName(begins).withColumn("shard", last).where("__at is not null")
    told = drawn.groupBy(F.col("source").alias("__s"), F.col("__at").alias("__a")).agg(F.sort_array(F.collect_list(F.struct("__copy", "shard"))).alias("got"))
    return materialize(told.select("__s", "__a", F.col("got.shard").alias("__shards")), "units")


def _sharded(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Adds __shards to rows of ``taken``: the shard of each copy; none for a row that is not taken."""
    on = F.col("source").eqNullSafe(F.col("__s")) & (F.col("__at") == F.col("__a"))
    got = F.slice(F.col("__shards"), F.lit(1), F.col("copies").cast("int"))
    return rows.join(small(blocks), on, "left").drop("__s", "__a").withColumn("__shards", F.coalesce(got, F.array().cast("array<int>")))


def _place(key, copy) -> Column:
    """Rows stand in a shard in the order of this hash."""
    return _keyed(F.lit("place"), key, copy)


def mixed(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """__row (a struct of all columns of ``docs``), shard and place, one row for each copy taken; rows stand in a shard in the order of place."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row")
    rows = sized(docs.select(whole, "source", "doc_id", "text")).withColumn("__key", _keyed("source", "doc_id", "text")).drop("text")
    sizes = materialize(rows.drop("__row"), "sizes")
    held = taken(rows, sizes).where("copies > 0").select("__row", "source", "__key", "__at", "copies")
    copied = _sharded(held, dealt(taken(sizes, sizes), shards)).select("__row", "__key", F.posexplode("__shards").alias("__copy", "shard"))
    return copied.select("__row", "shard", _place("__key", F.col("__copy") + 1).alias("place"))


def mixture(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, source_size, target, taken, shards, places for each row.

    ``shards`` has the output shard of each copy of the row and ``places`` its
    place there, joined by bars; ``taken`` counts the copies dealt.
    """
    small = docs.select("doc_id", "source", "text").withColumn("__key", _keyed("source", "doc_id", "text"))
    sizes = materialize(sized(small).drop("text"), "sizes")
    held = materialize(taken(sizes, sizes), "taken")
    rows = _sharded(held, dealt(held, shards))
    places = F.transform("__shards", lambda x, i: _place(F.col("__key"), i + 1))
    return rows.select("doc_id", "size", "source_size", "target", (F.size("__shards") * F.col("size")).alias("taken"), F.array_join("__shards", "|").alias("shards"), F.array_join(places, "|").alias("places"))


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"))
