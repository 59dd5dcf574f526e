"""Sinks that appear whole: staged by Spark's own commit, published by a journal.

1. Spark writes part files into a staging folder beside the target; its output
   committer takes one attempt of each task, so a retried task leaves no double
   rows and a killed job nothing that counts.
2. Where single files are asked for, the parts are streamed together in order of
   their names, which is the order of the rows. One writer makes a file: a set that
   is too large for that stays a folder of parts (``single=False``).
3. One journal names all moves from the staging folder to the targets. It appears by
   a rename. Before that the old files are whole; from then on the new ones count:
   the moves are made, and if the driver dies among them, ``settle`` makes the rest
   before the next read or write. A file replaces the old one in one step.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions.dialect import replaced

JOURNAL, STAGED = "_publish-", "_staged-"
#: What json.dumps escapes in two characters.
SHORT = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
OTHERS = [(chr(k), f"\\u{k:04x}") for k in range(32) if chr(k) not in SHORT]


# ---- JSON text as Python writes it ----


def quoted(c: Column) -> Column:
    """json.dumps(text, ensure_ascii=False); null as 'null'."""
    told = replaced(c, *SHORT.items())
    told = F.when(told.rlike("[\\x00-\\x1f]"), replaced(told, *OTHERS)).otherwise(told)
    return F.coalesce(F.concat(F.lit('"'), told, F.lit('"')), F.lit("null"))


def number(c: Column) -> Column:
    """Whole numbers and booleans; null as 'null'."""
    return F.coalesce(c.cast("string"), F.lit("null"))


def _value(df: DataFrame, name: str, given: dict[str, Column]) -> Column:
    if name in given:
        return given[name]
    kind = df.schema[name].dataType.simpleString()
    if kind not in ("string", "boolean", "int", "bigint"):
        raise ValueError(f"no JSON text for {name}: {kind}")
    return quoted(F.col(name)) if kind == "string" else number(F.col(name))


def line(df: DataFrame, *names: str) -> Column:
    """The columns as one line."""
    parts = [x for n in names for x in (F.lit(f'{"" if n == names[0] else ", "}"{n}": '), _value(df, n, {}))]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def block(df: DataFrame, indent: int, **given: Column) -> Column:
    """The columns as ``indent=2`` has them, for a list that stands ``indent`` deep; ``given`` tells of columns that are JSON text already."""
    pad = " " * indent
    parts = [x for n in df.columns for x in (F.lit(f'{"" if n == df.columns[0] else ","}\n{pad}  "{n}": '), _value(df, n, given))]
    return F.concat(F.lit(f"{pad}{{"), *parts, F.lit(f"\n{pad}}}"))


# ---- files ----


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path for it: local or shared alike."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def parent_of(spark: SparkSession, path: str) -> str:
    fs, at = file_system(spark, path)
    return fs.makeQualified(at).getParent().toString()


def folder_of(spark: SparkSession, path: str) -> str:
    """The folder above, made if it is missing."""
    parent = parent_of(spark, path)
    fs, at = file_system(spark, parent)
    fs.mkdirs(at)
    return parent


def stage(spark: SparkSession, folder: str) -> str:
    """A new staging folder, after what an earlier run left to be done."""
    settle(spark, folder)
    return f"{folder}/{STAGED}{uuid.uuid4().hex}"


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, at = file_system(spark, path)
    out = fs.create(at, True)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()


def parts_of(spark: SparkSession, folder: str) -> list:
    """The part files of a folder by name; none if the folder is missing."""
    fs, at = file_system(spark, folder)
    found = [f for f in fs.listStatus(at) if f.getPath().getName().startswith("part-") and f.getLen()] if fs.exists(at) else []
    return sorted(found, key=lambda f: f.getPath().getName())


def join_parts(spark: SparkSession, folder: str, path: str, head: str = "", tail: str = "", less: int = 0) -> None:
    """One file: ``head``, the parts without the last ``less`` bytes, ``tail``; buffers only are held."""
    fs, at = file_system(spark, path)
    copy = spark._jvm.org.apache.commons.io.IOUtils.copyLarge
    out = fs.create(at, True)
    try:
        out.write(bytearray(head, "utf-8"))
        found = parts_of(spark, folder)
        for f in found:
            size = f.getLen() - (less if f is found[-1] else 0)
            source = fs.open(f.getPath())
            try:
                copy(source, out, 0, size)
            finally:
                source.close()
        out.write(bytearray(tail, "utf-8"))
    finally:
        out.close()


def scratch(spark: SparkSession) -> str:
    """A new folder that goes with the driver, in the shared folder of ``spark.checkpoint.dir``; in local mode without one, a temporary one."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not base and context._jsc.sc().getCheckpointDir().isDefined():
        base = context._jsc.sc().getCheckpointDir().get()
    if not base:
        if context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="quillmill-")
    fs, at = file_system(spark, f"{base}/quillmill-{context.applicationId}-{uuid.uuid4().hex}")
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return at.toString()


# ---- publishing ----


def publish(spark: SparkSession, folder: str, staged: str, names: dict[str, str]) -> None:
    """``names``: target in ``folder`` to what it is called in ``staged``; all targets are replaced together."""
    journal = f"{folder}/{JOURNAL}{uuid.uuid4().hex}.json"
    write_text(spark, f"{staged}/journal", json.dumps({"staged": staged, "names": names}, ensure_ascii=False))
    fs, at = file_system(spark, journal)
    if not fs.rename(file_system(spark, f"{staged}/journal")[1], at):
        raise OSError(f"{journal} could not be made")
    settle(spark, folder)


def settle(spark: SparkSession, folder: str) -> None:
    """Makes the moves of journals that are still there; whole once they are gone."""
    fs, at = file_system(spark, folder)
    if not fs.exists(at) or not fs.getFileStatus(at).isDirectory():
        return
    journals = sorted((f for f in fs.listStatus(at) if f.getPath().getName().startswith(JOURNAL)), key=lambda f: (f.getModificationTime(), f.getPath().getName()))
    for f in journals:
        source = fs.open(f.getPath())
        try:
            told = json.loads(bytes(source.readAllBytes()).decode())
        finally:
            source.close()
        for target, name in told["names"].items():
            move(spark, f"{told['staged']}/{name}", f"{folder}/{target}")
        fs.delete(file_system(spark, told["staged"])[1], True)
        fs.delete(f.getPath(), False)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Puts a staged file or folder in place of the old one; nothing if that is done."""
    fs, a = file_system(spark, source)
    b = file_system(spark, target)[1]
    if not fs.exists(a):
        return
    if fs.getFileStatus(a).isDirectory() or (fs.exists(b) and fs.getFileStatus(b).isDirectory()):
        fs.delete(b, True)
    options = spark.sparkContext._gateway.new_array(getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    options[0] = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(a, b, options)
