"""Sinks: Python's bytes, and old files whole whatever is killed."""

from __future__ import annotations

import json
import os
import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillmill.sources import commit, jsonio

REPO = Path(__file__).resolve().parents[1]
SETS = [f"train_{m}_{s}.jsonl" for m in ("full", "ablated") for s in jsonio.DATASETS]


def texts(n):
    rng = random.Random(3)
    marks = [chr(k) for k in range(36)] + ["\\", "\\u000b", "é", "日本", "😀", "\x7f", "\x85", " ", "/", "a" * 50]
    return ["".join(rng.choice(marks) for _ in range(rng.randint(0, 12))) for _ in range(n)]


def rows_of(n):
    t = texts(3 * n)
    return [(k, t[3 * k], t[3 * k + 1] if k % 7 else None, t[3 * k + 2]) for k in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "pos long, instruction string, input string, output string")


def lines(rows):
    return "".join(json.dumps(dict(zip(jsonio.SFT, r[1:], strict=True)), ensure_ascii=False) + "\n" for r in rows).encode()


def test_lines_are_pythons(spark, tmp_path):
    rows = rows_of(600)
    df = frame(spark, rows).repartition(7)
    jsonio.write_jsonl(df, str(tmp_path / "new/rows.jsonl"))
    assert (tmp_path / "new/rows.jsonl").read_bytes() == lines(rows)
    jsonio.write_jsonl(df, str(tmp_path / "new/rows.jsonl"), single=False)
    parts = sorted(p for p in (tmp_path / "new/rows.jsonl").iterdir() if p.name.startswith("part-"))
    assert b"".join(p.read_bytes() for p in parts) == lines(rows)
    jsonio.write_jsonl(df.limit(0), str(tmp_path / "new/rows.jsonl"))
    assert (tmp_path / "new/rows.jsonl").read_bytes() == b""
    assert [p.name for p in (tmp_path / "new").iterdir() if not p.name.endswith(".crc")] == ["rows.jsonl"]


def test_reports_are_pythons(spark, tmp_path):
    rows = rows_of(50)
    df = frame(spark, rows).withColumn("ok", F.col("pos") % 3 == 0).withColumn("raw", F.lit('{"b": [1, {"a": "x\\ny"}], "c": 1.50, "e": []}'))
    wanted = [{**dict(zip(("pos", *jsonio.SFT), r, strict=True)), "ok": r[0] % 3 == 0, "raw": {"b": [1, {"a": "x\ny"}], "c": 1.5, "e": []}} for r in rows]
    for report, own, rest in (({"mode": "é", "n": [1, 2]}, df, wanted), ({}, df.limit(1), None), ({"mode": 1}, df.where("false"), [])):
        jsonio.write_report(spark, report, str(tmp_path / "r.json"), details=(own.select("pos", *jsonio.SFT, "ok", "raw"), "pos", {"raw": jsonio.indented(F.col("raw"))}))
        written = (tmp_path / "r.json").read_text(encoding="utf-8")
        if rest is not None:
            assert json.loads(written) == {**report, "details": rest}
        assert written == json.dumps(json.loads(written), ensure_ascii=False, indent=2)


def sets(spark, rows, tag=""):
    df = frame(spark, rows).withColumn("output", F.concat(F.coalesce("output", F.lit("")), F.lit(tag)))
    modes = df.withColumn("mode", F.explode(F.array(F.lit("full"), F.lit("ablated"))))
    return modes.withColumn("subset", F.explode(F.array(F.lit("all"), F.when(F.col("pos") % 2 == 0, "codeonly").otherwise("mathstyle")))).withColumn("output", F.concat("output", "mode", "subset"))


def read(folder):
    return {name: (folder / name).read_bytes() for name in SETS}


@pytest.mark.parametrize("single", [True, False])
def test_eight_sets(spark, tmp_path, single):
    rows = rows_of(40)
    jsonio.write_fan_out(sets(spark, rows).repartition(5), str(tmp_path), single)
    bodies = {p.name: p.read_bytes() if single else b"".join(x.read_bytes() for x in sorted(p.iterdir()) if x.name.startswith("part-")) for p in tmp_path.iterdir() if not p.name.endswith(".crc")}
    assert sorted(bodies) == sorted(SETS)
    own = [(*r[:3], f"{r[3]}ablatedcodeonly") for r in rows if r[0] % 2 == 0]
    assert bodies["train_ablated_codeonly.jsonl"] == lines(own) and bodies["train_full_gsm8kstyle.jsonl"] == b""


def test_a_killed_job_leaves_the_old_sets(spark, tmp_path):
    jsonio.write_fan_out(sets(spark, rows_of(20)), str(tmp_path))
    old = read(tmp_path)
    broken = sets(spark, rows_of(20), "new").withColumn("output", F.when(F.col("pos") == 13, F.raise_error(F.lit("killed")).cast("string")).otherwise(F.col("output")))
    with pytest.raises(Exception, match="killed"):
        jsonio.write_fan_out(broken, str(tmp_path))
    assert read(tmp_path) == old
    jsonio.write_fan_out(sets(spark, rows_of(20), "new"), str(tmp_path))
    assert read(tmp_path) != old


@pytest.mark.parametrize("after", (0, 3, 7))
def test_a_driver_killed_among_the_moves(spark, tmp_path, monkeypatch, after):
    """Once the journal is there the new sets count; the next read or write makes the rest of the moves."""
    rows = rows_of(4)
    jsonio.write_fan_out(sets(spark, rows), str(tmp_path))
    move, made = commit.move, []

    def killed(*args):
        if len(made) == after:
            raise KeyboardInterrupt
        made.append(args)
        move(*args)

    with monkeypatch.context() as m:
        m.setattr(commit, "move", killed)
        with pytest.raises(KeyboardInterrupt):
            jsonio.write_fan_out(sets(spark, rows, "new"), str(tmp_path))
    found = jsonio.instruction_rows(spark, str(tmp_path / "train_full_clean.jsonl"))
    assert found.where("output LIKE '%newfullall'").count() == 4
    assert all(b"new" in body for name, body in read(tmp_path).items() if "gsm8k" not in name)
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")) == sorted(SETS)


def test_a_retried_task_leaves_no_double_rows(tmp_path):
    """A task that dies after it wrote some rows is run again, in a session that retries."""
    code = f"""
import sys
sys.path.insert(0, {str(REPO)!r})
from pyspark import TaskContext
from pyspark.sql import SparkSession, functions as F
from quillmill.sources import jsonio
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.sql.warehouse.dir", {str(tmp_path / "w")!r}).getOrCreate()
def told(batches):
    for b in batches:
        yield b
    if TaskContext.get().attemptNumber() == 0 and TaskContext.get().partitionId() == 1:
        raise RuntimeError("killed")
rows = spark.range(0, 3000, 1, 3).selectExpr("id AS pos", "'i' AS instruction", "'q' AS input", "cast(id AS string) AS output")
jsonio.write_jsonl(rows.mapInArrow(told, rows.schema), {str(tmp_path / "rows.jsonl")!r})
"""
    done = subprocess.run([sys.executable, "-c", code], env=os.environ | {"PYTHONPATH": str(REPO)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "killed" in done.stderr
    assert [json.loads(x)["output"] for x in (tmp_path / "rows.jsonl").read_text().splitlines()] == [str(k) for k in range(3000)]
