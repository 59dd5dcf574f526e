"""Hooks: generation that can be taken up again, code that runs once and within limits."""

from __future__ import annotations

import json

import pandas as pd
import pytest

from quillmill.operators import hooks
from quillmill.plans import flows


def prompts(spark, n, parts):
    return spark.range(0, n, 1, parts).selectExpr("id AS pos", "concat('prompt ', id, repeat('x', cast(id % 40 AS int))) AS prompt", "id % 2 AS other")


def recorder(path, bad=None):
    """A generator that notes each batch and dies of the prompt that is ``bad``."""

    def make():
        def answer(batch):
            if bad is not None and any(p.startswith(f"prompt {bad}x") for p in batch):
                raise RuntimeError("killed")
            with open(path, "a") as f:
                f.write(json.dumps(batch) + "\n")
            return [p.upper() for p in batch]

        return answer

    return make


def asked(path):
    return [json.loads(x) for x in path.read_text().splitlines()] if path.exists() else []


def test_a_rerun_prompts_only_what_is_missing(spark, tmp_path):
    rows = prompts(spark, 80, 8)
    with pytest.raises(Exception, match="killed"):
        hooks.generated(rows, recorder(tmp_path / "first", bad=75), log=str(tmp_path / "log")).collect()
    kept = {r["pos"] for r in spark.read.parquet(str(tmp_path / "log")).collect()}
    assert kept and 75 not in kept and len(kept) % 10 == 0  # whole tasks
    done = hooks.generated(rows, recorder(tmp_path / "second"), log=str(tmp_path / "log")).collect()
    assert {r["pos"]: r["answer_raw"] for r in done} == {r["pos"]: r["prompt"].upper() for r in rows.collect()}
    again = [p for batch in asked(tmp_path / "second") for p in batch]
    assert len(again) == 80 - len(kept) and len(set(again)) == len(again)
    hooks.generated(rows, recorder(tmp_path / "third"), log=str(tmp_path / "log")).collect()
    assert asked(tmp_path / "third") == []


def test_batches_keep_to_the_budget(spark, tmp_path):
    rows = prompts(spark, 200, 2)
    out = hooks.generated(rows, recorder(tmp_path / "asked"), budget=300)
    assert out.columns == ["pos", "prompt", "other", "answer_raw"] and out.count() == 200
    batches = asked(tmp_path / "asked")
    assert all(len(b) * (max(map(len, b)) + 1) <= 300 or len(b) == 1 for b in batches) and max(map(len, batches)) > 3
    # like lengths go together: within a task from short to long
    assert sum(max(map(len, b)) - min(map(len, b)) for b in batches) / len(batches) < 10
    sizes = [len(b) for b in hooks._batches(iter([pd.DataFrame({"p": ["a" * 1000, None, ""]})]), "p", 10)]
    assert sum(sizes) == 3


def counting(path):
    def run(code):
        with open(path, "a") as f:
            f.write("x")
        return True, code[:5], ""

    return run


def test_equal_codes_run_once(spark, tmp_path):
    rows = spark.range(0, 1000, 1, 4).selectExpr("id AS idx", "id % 10 <> 0 AS has_code", "CASE WHEN id % 10 = 0 THEN '' WHEN id < 990 THEN 'print(1)' ELSE 'print(2)' END AS code")
    got = hooks.executed(rows, counting(tmp_path / "runs")).collect()
    assert len(got) == 1000 and (tmp_path / "runs").read_text() == "xx"
    assert {(r["has_code"], r["code_executable"], r["exec_stdout"]) for r in got} == {(True, True, "print"), (False, None, "")}


def test_limits():
    run = hooks.subprocess_executor(timeout=20, memory_mb=256, cpu_seconds=1)
    ok, out, err = run("x = bytearray(1 << 32)")
    assert (ok, out) == (False, "") and "MemoryError" in err
    assert run("while True: pass") == hooks.TOO_LATE
    assert run("print(sum(range(10)))") == (True, "45", "")
    assert run("import sys\nprint(__name__, sys.argv)\nsys.exit(2)")[:2] == (False, "__main__ ['-']")


def test_two_reports_are_compared(spark, tmp_path):
    for name, own in (("a", [1, 1, 0, 0, 1]), ("b", [1, 0, 1, 1, 1])):
        report = {"mode": name, "details": [{"idx": k, "is_correct": bool(x)} for k, x in enumerate(own)]}
        (tmp_path / f"{name}.json").write_text(json.dumps(report))
    told = flows.compare(spark, str(tmp_path / "a.json"), str(tmp_path / "b.json"), str(tmp_path / "c.json"))
    assert (told["total"], told["both_right"], told["only_first"], told["only_second"], told["p_value"]) == (5, 2, 1, 2, 1.0)
    assert json.loads((tmp_path / "c.json").read_text()) == told and told["low"] <= told["difference"] <= told["high"]
