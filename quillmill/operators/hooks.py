"""Hooks for what Spark doesn't do itself: running code, generating answers.

Running code that a model wrote is arbitrary code execution: without an
executor handed in by the caller nothing runs, and results are null.
"""

from __future__ import annotations

import os
import signal
import subprocess
import sys
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from subprocess import PIPE

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.operators.selection import first_rows, holdout
from quillmill.sources.commit import file_system

Executor = Callable[[str], tuple[bool, str, str]]


#: What is told of code that did not run to its end.
NOTHING_TO_RUN, TOO_LATE = (False, "", "empty_code"), (False, "", "timeout")


#: Sets the limits, then runs what comes by standard input as the main module.
RUNNER = """
import resource, sys
for kind, most in ((resource.RLIMIT_AS, int(sys.argv[1])), (resource.RLIMIT_CPU, int(sys.argv[2]))):
    if most:
        resource.setrlimit(kind, (most, most))
sys.argv = ["-"]
exec(compile(sys.stdin.read(), "<code>", "exec"), {"__name__": "__main__"})
"""


def subprocess_executor(timeout: float = 5, memory_mb: int = 1024, cpu_seconds: int = 10) -> Executor:
    """(ok, stdout, stderr) of the code in an interpreter of its own; no sandbox.

    The code comes by standard input, so nothing is written. The interpreter
    leads a process group, which is killed whole once the time is up; code that
    asks for more memory than its limit fails with Python's MemoryError, code
    that spends its CPU seconds counts as too late. 0 sets no limit.
    """

    def run(code: str) -> tuple[bool, str, str]:
        if not code or code.isspace():
            return NOTHING_TO_RUN
        child = subprocess.Popen([sys.executable, "-c", RUNNER, str(memory_mb << 20), str(cpu_seconds)], stdin=PIPE, stdout=PIPE, stderr=PIPE, start_new_session=True, encoding="utf-8", errors="replace")
        try:
            told = child.communicate(code, timeout)
        except subprocess.TimeoutExpired:
            os.killpg(child.pid, signal.SIGKILL)
            child.communicate()
            return TOO_LATE
        if child.returncode in (-signal.SIGXCPU, -signal.SIGKILL):
            return TOO_LATE
        out, err = map(str.strip, told)
        return child.returncode == 0, out, err

    return run


RAN = "h binary, code_executable boolean, exec_stdout string, exec_stderr string"


def executed(details: DataFrame, executor: Executor | None = None, pool: int = 4) -> DataFrame:
    """Adds code_executable, exec_stdout, exec_stderr where has_code; null and empty elsewhere or without an executor.

    Each distinct code runs once, by its SHA-256, in as many interpreters at a
    time as ``pool`` for a task; only codes go to Python.
    """
    if executor is None:
        return details.withColumns({"code_executable": F.lit(None).cast("boolean"), "exec_stdout": F.lit(""), "exec_stderr": F.lit("")})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(pool) as threads:
            for pdf in batches:
                got = pd.DataFrame(list(threads.map(executor, pdf["code"])), columns=["code_executable", "exec_stdout", "exec_stderr"])
                got.insert(0, "h", pdf["h"].to_numpy())
                yield got

    rows = details.withColumn("__h", F.when(F.col("has_code"), F.unhex(F.sha2("code", 256))))
    codes = rows.where(F.col("__h").isNotNull()).groupBy(F.col("__h").alias("h")).agg(F.first("code").alias("code"))
    ran = codes.mapInPandas(run, RAN)
    told = [F.coalesce(c, F.lit("")).alias(c) for c in ("exec_stdout", "exec_stderr")]
    return rows.join(ran, F.col("__h") == F.col("h"), "left").select(*details.columns, "code_executable", *told)


#: Characters of the prompts of one batch, the longest counted for each.
BUDGET = 1 << 16


def _batches(prompts: Iterator[pd.DataFrame], column: str, budget: int) -> Iterator[pd.DataFrame]:
    """Rows in batches of ``budget`` characters, each row counted as long as the batch's longest; prompts come from short to long."""
    for pdf in prompts:
        begin = 0
        for end, size in enumerate(pdf[column].str.len().fillna(0).astype(int) + 1):
            if end > begin and (end - begin + 1) * size > budget:
                yield pdf.iloc[begin:end].reset_index(drop=True)
                begin = end
        if begin < len(pdf):
            yield pdf.iloc[begin:].reset_index(drop=True)


def generated(prompts: DataFrame, make: Callable[[], Callable[[list[str]], list[str]]], column: str = "prompt", log: str | None = None, budget: int = BUDGET) -> DataFrame:
    """Adds answer_raw to rows with a pos of their own; ``make`` builds a batch generator once in each task.

    Prompts of like length go together, by a budget. With ``log``, a folder, each
    task's answers are kept there as the task ends, whether or not the job does;
    a rerun prompts only what the log lacks.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for pdf in _batches(batches, column, budget):
            yield pd.DataFrame({"pos": pdf["pos"], "answer_raw": model(pdf[column].tolist())})

    def answers(rows: DataFrame) -> DataFrame:
        asked = rows.select(F.col("pos").cast("bigint").alias("pos"), F.col(column).alias(column))
        return asked.sortWithinPartitions(F.length(column), "pos").mapInPandas(run, "pos bigint, answer_raw string")

    if log is None:
        told = answers(prompts)
    else:
        spark = prompts.sparkSession
        fs, at = file_system(spark, log)
        old = spark.read.schema("pos bigint, answer_raw string").parquet(log) if fs.exists(at) else None
        todo = prompts if old is None else prompts.join(old, "pos", "left_anti")
        # version 2 commits each task by itself
        answers(todo).write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").mode("append").parquet(log)
        told = spark.read.schema("pos bigint, answer_raw string").parquet(log).dropDuplicates(["pos"])
    return prompts.join(told, "pos")


def training_split(rows: DataFrame, max_samples: int, val_fraction: float = 0.05, seed: int = 42, by: str | None = None) -> tuple[DataFrame, DataFrame]:
    """X4's share of data preparation: the first rows by pos, and of them exactly the fraction held out, of each value of ``by`` where it is given."""
    split = holdout(first_rows(rows, max_samples), val_fraction, by, seed)
    return split.where("NOT held").drop("held"), split.where("held").drop("held")
