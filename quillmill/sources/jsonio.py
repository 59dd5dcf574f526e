"""JSON-array and JSONL sources with exact positions; JSONL and report sinks.

JSON arrays are read by byte ranges (``jsonarray``), JSONL is split as usual.
``pos`` is the place in the array or file order; it decides all ties later.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillmill.sources import commit
from quillmill.sources.jsonarray import elements

#: The eight datasets are train_{full,ablated}_{one of these}.jsonl.
DATASETS = ("clean", "codeonly", "gsm8kstyle", "mathstyle")
SFT = ("instruction", "input", "output")


def read_json_array(spark: SparkSession, path: str, member: str | None = None) -> DataFrame:
    """Pos, item (variant), text and file of each element of the arrays in ``path``, read by byte ranges.

    A top level that is no list raises; with ``member`` it may be an object that
    holds the list under that name (Q16). Raises where an element isn't JSON.
    """
    found = elements(spark, settled(spark, path), member)
    return found.select("pos", F.parse_json("text").alias("item"), "text", F.element_at(F.split("file", "/"), -1).alias("file"))


def field(item: str, name: str) -> Column:
    """A field as text; null where missing or null."""
    return F.try_variant_get(F.col(item), f"$.{name}", "string")


def field_or_none(item: str, name: str) -> Column:
    """A field as text, a JSON null as 'None', null where missing."""
    found = F.variant_get(F.col(item), f"$.{name}", "variant")
    return F.when(F.is_variant_null(found), "None").otherwise(F.try_variant_get(F.col(item), f"$.{name}", "string"))


def truthy(item: str, *names: str) -> Column:
    """P3 over dynamic types: the first field that is no '', 0, false, null or []; as text, else ''."""
    found = []
    for n in names:
        v = F.try_variant_get(F.col(item), f"$.{n}", "variant")
        s, kind = F.try_variant_get(F.col(item), f"$.{n}", "string"), F.schema_of_variant(v)
        zero = kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)") & (s.try_cast("double") == 0)
        empty = v.isNull() | F.is_variant_null(v) | (s == "") | zero | ((kind == "BOOLEAN") & (s == "false")) | (s == "[]") | (s == "{}")
        found.append(F.when(~F.coalesce(empty, F.lit(True)), s))
    return F.coalesce(*found, F.lit(""))


def indented(c: Column) -> Column:
    """JSON text as ``indent=2`` has it for a member of a list's element; any value, so by Python."""

    @F.pandas_udf(StringType())
    def told(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else json.dumps(json.loads(t, strict=False), ensure_ascii=False, indent=2).replace("\n", "\n      "))

    return told(c)


def conversations(spark: SparkSession, path: str) -> DataFrame:
    """Pos, conversations, source (the file's name, P11)."""
    kind = "array<struct<`from`:string,`value`:string>>"
    items = read_json_array(spark, path)
    return items.select("pos", F.try_variant_get("item", "$.conversations", kind).alias("conversations"), F.col("file").alias("source"))


#: The table of splits is broadcast up to this size.
SPLIT_BYTES = 8 << 20


def split_starts(splits: DataFrame) -> DataFrame:
    """f, b, shift: what turns a row's id into its line number, from f, b, n, first of each split.

    Prefix sums on three levels, none of which brings all splits together: the splits of
    a file, the files of a range of names, and the ranges, as many as shuffle partitions.
    """
    own = splits.withColumn("before", F.sum("n").over(Window.partitionBy("f").orderBy("b")) - F.col("n"))
    files = splits.groupBy("f").agg(F.sum("n").alias("lines")).repartitionByRange("f").withColumn("part", F.spark_partition_id())
    within = files.withColumn("within", F.sum("lines").over(Window.partitionBy("part").orderBy("f")) - F.col("lines"))
    parts = files.groupBy("part").agg(F.sum("lines").alias("lines")).select("part", (F.sum("lines").over(Window.orderBy("part")) - F.col("lines")).alias("ahead"))
    told = within.join(parts, "part").select("f", (F.col("within") + F.col("ahead")).alias("ahead"))
    return own.join(told, "f").select("f", "b", (F.col("ahead") + F.col("before") - F.col("first") + 1).alias("shift"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no (from 1, blank lines count) and line of a text file or a folder of them.

    Within a split Spark's row ids rise by one. A first pass, which makes no
    lines, counts each split's; what lies before it, in the order of files and
    offsets, is added. The table of splits, one row for each 128 MB or so, is
    broadcast while it is small.
    """
    raw = spark.read.text(settled(spark, path)).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("id"))
    splits = raw.groupBy("f", "b").agg(F.count("id").alias("n"), F.min("id").alias("first")).persist(StorageLevel.MEMORY_AND_DISK)
    size = splits.agg(F.sum(F.octet_length("f") + 16)).first()[0] or 0
    starts = split_starts(splits)
    return raw.join(F.broadcast(starts) if size <= SPLIT_BYTES else starts, ["f", "b"]).select((F.col("id") + F.col("shift")).alias("line_no"), "line")


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """line_no, item (variant), blank lines skipped; raises with the line number on bad JSON."""
    held = numbered_lines(spark, path).where(F.regexp_replace("line", r"\s+", "") != "")
    parsed = F.try_parse_json("line")
    bad = F.raise_error(F.concat(F.lit("line "), F.col("line_no").cast("string"), F.lit(": not JSON")))
    return held.select("line_no", F.when(parsed.isNotNull(), parsed).otherwise(bad.cast("variant")).alias("item"))


def instruction_rows(spark: SparkSession, path: str) -> DataFrame:
    """T4: pos, is_object, instruction, input, output; missing fields null, JSON nulls 'None'."""
    items = read_jsonl(spark, path)
    texts = [field_or_none("item", c).alias(c) for c in ("instruction", "input", "output")]
    return items.select((F.col("line_no") - 1).alias("pos"), F.schema_of_variant("item").startswith("OBJECT").alias("is_object"), *texts)


def strict_rows(spark: SparkSession, path: str) -> DataFrame:
    """As ``instruction_rows``; a blank line or a row without output raises."""
    lines = numbered_lines(spark, path)
    output = field("item", "output")
    missing = F.raise_error(F.concat(F.lit("line "), F.col("line_no").cast("string"), F.lit(": no output")))
    held = lines.select("line_no", F.parse_json("line").alias("item"))
    return held.select((F.col("line_no") - 1).alias("pos"), F.when(output.isNotNull(), output).otherwise(missing.cast("string")).alias("output"))


def write_jsonl(rows: DataFrame, path: str, columns: tuple[str, ...] = SFT, order: str = "pos", single: bool = True) -> None:
    """JSON lines in the order of ``order`` as Python writes them; one file, or a folder of parts whose names sort in that order."""
    spark = rows.sparkSession
    folder = commit.folder_of(spark, path)
    staged, name = commit.stage(spark, folder), path.rstrip("/").rsplit("/", 1)[-1]
    lines = rows.select(order, commit.line(rows, *columns).alias("value"))
    lines.repartitionByRange(order).sortWithinPartitions(order).select("value").write.text(f"{staged}/parts")
    if single:
        commit.join_parts(spark, f"{staged}/parts", f"{staged}/whole")
    commit.publish(spark, folder, staged, {name: "whole" if single else "parts"})


def write_fan_out(rows: DataFrame, path: str, single: bool = True) -> None:
    """The eight datasets as JSON lines under their own names, written in one job and published together.

    A dataset without rows is an empty file or folder.
    """
    spark = rows.sparkSession
    make_folder(spark, path)
    staged = commit.stage(spark, path)
    name = F.concat(F.lit("train_"), F.col("mode"), F.lit("_"), F.when(F.col("subset") == "all", "clean").otherwise(F.col("subset")))
    named = rows.select(name.alias("dataset"), "pos", commit.line(rows, *SFT).alias("value"))
    named.repartitionByRange("dataset", "pos").sortWithinPartitions("dataset", "pos").select("dataset", "value").write.partitionBy("dataset").text(f"{staged}/sets")
    names = {}
    for mode in ("full", "ablated"):
        for subset in DATASETS:
            own = f"train_{mode}_{subset}"
            names[f"{own}.jsonl"] = own if single else f"sets/dataset={own}"
            if single:
                commit.join_parts(spark, f"{staged}/sets/dataset={own}", f"{staged}/{own}")
            else:
                make_folder(spark, f"{staged}/sets/dataset={own}")
    commit.publish(spark, path, staged, names)


def settled(spark: SparkSession, path: str) -> str:
    """The path, after a publication in its folder that was broken off is made whole."""
    commit.settle(spark, commit.parent_of(spark, path))
    return path


def exists(spark: SparkSession, path: str) -> bool:
    """S9."""
    fs, at = commit.file_system(spark, path)
    return fs.exists(at)


def require(spark: SparkSession, path: str) -> str:
    """The path, if there is something."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return path


def make_folder(spark: SparkSession, path: str) -> None:
    """The folder and those above it, where they are missing."""
    fs, at = commit.file_system(spark, path)
    fs.mkdirs(at)


def _listed(rows: DataFrame, order: str, indent: int, given: dict, staged: str, head: str, tail: str) -> None:
    """A list of rows as ``indent=2`` has it, between ``head`` and ``tail``: elements by the tasks, streamed together."""
    spark = rows.sparkSession
    values = rows.select(F.col(order).alias("__order"), commit.block(rows, indent + 2, **given).alias("value"))
    values.repartitionByRange("__order").sortWithinPartitions("__order").select("value").write.option("lineSep", ",\n").text(f"{staged}/parts")
    some = bool(commit.parts_of(spark, f"{staged}/parts"))
    commit.join_parts(spark, f"{staged}/parts", f"{staged}/whole", f"{head}[" + "\n" * some, f"\n{' ' * indent}" * some + f"]{tail}", 2 if some else 0)


def write_array(rows: DataFrame, path: str, order: str = "pos", **given: Column) -> None:
    """A JSON list of the rows as objects, as Python writes it with ``indent=2``."""
    folder = commit.folder_of(rows.sparkSession, path)
    staged = commit.stage(rows.sparkSession, folder)
    _listed(rows, order, 0, given, staged, "", "")
    commit.publish(rows.sparkSession, folder, staged, {path.rstrip("/").rsplit("/", 1)[-1]: "whole"})


def write_report(spark: SparkSession, report: dict, path: str, **listed: tuple[DataFrame, str, dict]) -> None:
    """Pretty JSON wherever Spark can write, the old report whole until the new one is.

    ``listed``: one more member, a list of rows: name to (rows, the column that
    orders them, columns that are JSON text already). Its elements are written by
    the tasks and streamed together; the report itself is small by nature.
    """
    folder = commit.folder_of(spark, path)
    staged, name = commit.stage(spark, folder), path.rstrip("/").rsplit("/", 1)[-1]
    text = json.dumps(report, ensure_ascii=False, indent=2, default=str)
    for member, (rows, order, given) in listed.items():
        head = f'{text.removesuffix("}").rstrip()}{"," if report else ""}\n  "{member}": '
        _listed(rows, order, 2, given, staged, head, "\n}")
    if not listed:
        commit.write_text(spark, f"{staged}/whole", text)
    commit.publish(spark, folder, staged, {name: "whole"})
