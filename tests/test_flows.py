"""The dataflows over JSON files, and the contracts of their parts."""

from __future__ import annotations

import json
import random
import unicodedata
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from quillmill.functions import numbers
from quillmill.operators import conversations, dedup, hooks, reports, scoring
from quillmill.plans import flows
from quillmill.sources import jsonio
from quillmill.streaming import flows as streams

LONG = "A long enough answer that says how it is done, step by step, and ends."


def talk(*pairs):
    return {"conversations": [{"from": a, "value": b} for a, b in pairs]}


CASES = [
    (talk(("system", "s"), ("user", "q one"), ("assistant", LONG)), None),
    (talk(("human", "q two"), ("gpt", LONG), ("human", "bye")), None),
    (talk(("system", "s"), ("user", "q three"), ("assistant", LONG + " ```python\nx```"), ("user", "```\n42\n```"), ("assistant", "所以 42 " + LONG)), None),
    (talk(("user", "q four"), ("assistant", LONG), ("user", "r"), ("assistant", "B " + LONG), ("user", "last")), None),
    ({"conversations": []}, "missing_or_empty_conversations"),
    ({"other": 1}, "missing_or_empty_conversations"),
    (talk(("user", "q"), ("assistant", " ")), "too_few_valid_messages"),
    (talk(("user", "q"), ("assistant", LONG)), "unsupported_turns_2"),
    (talk(("user", "q"), ("assistant", LONG), ("user", "r"), ("assistant", LONG)), "unsupported_turns_4"),
    (talk(("system", "s"), ("system", "s"), ("assistant", LONG)), "missing_user_question"),
    (talk(("system", "s"), ("assistant", LONG), ("user", "q")), "missing_response_after_question"),
    (talk(("system", "s"), ("user", "q"), ("user", "r")), "missing_assistant_answer"),
    (talk(("system", "s"), ("user", "q"), ("assistant", "too short")), "full_output_too_short"),
    (talk(("system", "s"), ("user", "q"), ("assistant", "```python\n" + LONG + "```")), "ablated_output_too_short"),
    (talk(("system", "s"), ("user", "q"), ("assistant", LONG + " class five")), "ablated_code_residue"),
    (talk(("user", "题目：Q, one!"), ("assistant", LONG + " \\boxed{1} " * 3), ("user", "x")), None),
]


def test_build(spark, tmp_path):
    path = tmp_path / "train.json"
    path.write_text(json.dumps([c for c, _ in CASES], ensure_ascii=False), encoding="utf-8")
    df = jsonio.conversations(spark, str(path))
    got = {r["pos"]: r for r in conversations.parsed(df, F.col("source")).collect()}
    assert [got[k]["reason"] for k in range(len(CASES))] == [r for _, r in CASES]
    assert got[0]["source"] == "train.json"
    assert got[2]["full_output"].split("\n\n")[1] == "代码执行结果：\n42"
    assert "代码执行结果：\nr\nlast" in got[3]["full_output"]  # without a system turn the last user's text is taken too
    assert got[2]["has_code"] and "x" not in got[2]["ablated_output"].split("\n\n")[0][len(LONG) :]

    report = flows.build(spark, str(path), str(tmp_path / "out"))
    assert report["raw_count"] == len(CASES)
    assert report["valid_count_before_dedup"] == 5
    assert report["duplicate_removed"] == 1  # 'q one' and 'Q, one!' share a key
    assert sum(report["skipped_reasons"].values()) + 5 == len(CASES)
    names = {p.name for p in (tmp_path / "out").iterdir() if p.suffix == ".jsonl"}
    assert names == {f"train_{m}_{s}.jsonl" for m in ("full", "ablated") for s in ("clean", "codeonly", "gsm8kstyle", "mathstyle")}
    rows = spark.read.json(str(tmp_path / "out/train_full_clean.jsonl"))
    assert rows.count() == 4 and rows.columns == ["input", "instruction", "output"]
    assert spark.read.json(str(tmp_path / "out/train_ablated_codeonly.jsonl")).count() == report["samples_with_code_after_dedup"]
    assert json.loads((tmp_path / "out/clean_report.json").read_text(encoding="utf-8")) == report


def test_missing_input_and_shared_paths(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        flows.build(spark, str(tmp_path / "none.json"), str(tmp_path / "out"))
    jsonio.write_report(spark, {"a": "é"}, f"file://{tmp_path}/deep/er/r.json")
    assert json.loads((tmp_path / "deep/er/r.json").read_text(encoding="utf-8")) == {"a": "é"}
    assert jsonio.exists(spark, f"file://{tmp_path}/deep/er") and not jsonio.exists(spark, str(tmp_path / "other"))


def test_lines_are_numbered_over_splits_and_files(spark, tmp_path):
    texts = [[f"a{k}" for k in range(3000)], ["", "b1", ""], [f"c{k}" * 7 for k in range(500)]]
    for k, lines in enumerate(texts):
        (tmp_path / f"part{k}.txt").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        got = [tuple(r) for r in jsonio.numbered_lines(spark, str(tmp_path)).orderBy("line_no").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == list(enumerate((x for lines in texts for x in lines), 1))


def test_build_rejects_other_json(spark, tmp_path):
    path = tmp_path / "bad.json"
    path.write_text("{}")
    with pytest.raises(Exception, match="must be a list"):
        jsonio.conversations(spark, str(path)).collect()


def test_keep_best_whatever_the_partitions(spark):
    rows = [(0, "k1", 5), (1, "k2", 9), (2, "k1", 7), (3, "k1", 7)]
    for n in (1, 3):
        df = spark.createDataFrame(rows, "pos long, k string, quality_score int").repartition(n)
        kept = dedup.keep_best(df, F.col("k")).orderBy("first_pos").collect()
        assert [(r["k"], r["pos"]) for r in kept] == [("k1", 2), ("k2", 1)]


def test_clean(spark, tmp_path):
    code = "```python\nprint(1)\n```"
    rows = [
        {"instruction": "i", "input": "题目：q", "output": f"So.\n{code}\nFinal Answer: 3.0"},
        {"instruction": "i", "input": "题目：q", "output": f"So. \n{code}\n\nFinal  Answer:  3.0"},
        {"instruction": "i", "input": "q", "output": None},
        {"instruction": "i", "input": "q"},
        {"instruction": "", "input": "", "output": code},
        {"instruction": "题目: own", "input": "", "output": f"{code} 5"},
        {"input": "q", "output": "no code 5"},
        {"input": "q", "output": "```python\nx\n```"},
        {"input": "q", "output": "```python\n" + "x" * 2501 + "\n``` 5"},
        [1],
    ]
    path = tmp_path / "rows.jsonl"
    path.write_text("\n\n".join(json.dumps(r, ensure_ascii=False) for r in rows), encoding="utf-8")
    report = flows.clean(spark, str(path), str(tmp_path / "clean.jsonl"))
    # a JSON null is the text 'None', which holds no code
    assert report["reason_counter"] == {"ok": 3, "empty_output": 1, "empty_question": 1, "no_python_code": 2, "no_final_answer": 1, "code_too_long": 1, "not_dict": 1}
    assert report["cleaned_count_after_dedup"] == 2 and report["duplicate_removed"] == 1
    assert report["output_example"]["output"] == f"So.\n\n{code}\n\nFinal Answer: 3"
    assert report["output_example"]["input"] == "题目：q"


def test_bad_line_is_named(spark, tmp_path):
    path = tmp_path / "bad.jsonl"
    path.write_text('{"output": "a"}\n\nnot json\n')
    with pytest.raises(Exception, match="line 3"):
        jsonio.read_jsonl(spark, str(path)).collect()
    with pytest.raises(Exception):  # noqa: B017  a blank line is an error here
        jsonio.strict_rows(spark, str(path)).collect()


def test_audit(spark, tmp_path):
    path = tmp_path / "ablated.jsonl"
    path.write_text('{"output": "fine"}\n\n{"output": "x = 5\\nprint(1)", "input": "q"}\n')
    report = flows.audit(spark, str(path), str(tmp_path / "r.json"))
    assert (report["total_samples"], report["residue_samples"], report["residue_ratio"]) == (2, 1, 0.5)
    assert report["reason_counter"] == {"print_call": 1, "assign_like_code": 1}
    assert report["examples"][0]["line_no"] == 3
    none = tmp_path / "none.jsonl"
    none.write_text('{"output": null, "instruction": null}\n{"output": "x = 5", "instruction": null, "input": null}\n{"input": "i"}\n')
    told = flows.audit(spark, str(none), str(tmp_path / "n.json"))
    assert told["total_samples"] == 3 and told["residue_samples"] == 1
    assert (told["examples"][0]["instruction"], told["examples"][0]["input"]) == (None, "")
    strict = tmp_path / "s.jsonl"
    strict.write_text('{"output": "fine"}\n{"output": "```x"}\n')
    assert flows.spot_check(spark, str(strict))[0] == 1
    assert flows.fence_ratio(spark, str(strict)) == 0.5


def test_audit_takes_one_job(spark, tmp_path):
    """Counts equal those of the queries' own operators; rows are read by one job beside the count of splits."""
    rng = random.Random(4)
    marks = ["x = 5", "print (1)", "import os", "return 3", "for i in x:", "fine", "words", "代码执行结果", "```python", "if a:\n  b"]
    rows = [{"output": "\n".join(rng.choice(marks) for _ in range(rng.randint(0, 3))), "input": "i" * 400} for _ in range(400)]
    path = tmp_path / "rows.jsonl"
    path.write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows), encoding="utf-8")
    report = flows.audit(spark, str(path), str(tmp_path / "r.json"))
    held = reports.named_audit(spark.createDataFrame([(k + 1, r["output"]) for k, r in enumerate(rows)], "pos long, output string"))
    assert list(report["reason_counter"].items()) == [(r["label"], r["n"]) for r in reports.label_histogram(held).collect()]
    total = reports.ratio(held, F.size("hits") > 0).first()
    assert (report["total_samples"], report["residue_samples"]) == (total["total"], total["hits"])
    assert [e["line_no"] for e in report["examples"]] == [r["pos"] for r in held.where(F.size("hits") > 0).orderBy("pos").limit(50).collect()]
    (tmp_path / "none.jsonl").write_text("")
    assert flows.audit(spark, str(tmp_path / "none.jsonl"), str(tmp_path / "n.json"))["residue_ratio"] == 0.0


def test_evaluations(spark, tmp_path):
    items = [{"instruction": "", "question": "q", "answer": 0, "label": "#### 18"}, {"input": "r", "gold_answer": "0"}, {}]
    path = tmp_path / "qa.json"
    path.write_text(json.dumps(items))
    got = flows.qa_items(spark, str(path)).orderBy("pos").collect()
    assert [(r["question"], r["gold_raw"]) for r in got] == [("q", "#### 18"), ("r", "0"), ("", "")]
    answered = flows.qa_items(spark, str(path)).withColumn("answer_raw", F.lit("Final Answer: 18"))
    assert flows.evaluate_segments(answered, "base", "t", str(tmp_path / "a.json"))["summary"] == {"total": 3, "correct": 1, "accuracy": 0.333333}
    with pytest.raises(ValueError):
        scoring.check_mode("other")

    path.write_text(json.dumps([{"Body": " b ", "Question": "q? ", "Answer": 1300.0}, {"Answer": "n"}]))
    answered = flows.body_items(spark, str(path)).withColumn("model_output", F.when(F.col("pos") == 0, "answer is 1,300 answer is 1300").otherwise("none"))
    assert answered.orderBy("pos").first()["question"] == "b\nq?"
    report = flows.evaluate_simple(answered, "base", "B", str(tmp_path / "b.json"))
    written = (tmp_path / "b.json").read_text(encoding="utf-8")
    told = json.loads(written)
    assert list(told) == ["mode", "dataset", "total", "correct", "accuracy", "type_counter", "results"] and {k: v for k, v in told.items() if k != "results"} == report
    assert [list(r) for r in told["results"]] == [["id", "question", "gold", "pred", "correct", "type", "model_output", "raw_item"]] * 2
    assert [r["raw_item"] for r in told["results"]] == [{"Body": " b ", "Question": "q? ", "Answer": 1300.0}, {"Answer": "n"}]
    assert written == json.dumps(told, ensure_ascii=False, indent=2)
    assert report["type_counter"] == {"correct": 1, "extract_error": 1} and report["accuracy"] == 0.5
    with pytest.raises(Exception, match="no items"):
        scoring.accuracy(spark.createDataFrame([], "is_correct boolean"), empty=None).collect()


def echo(base_model=None, adapter_path=None, max_new_tokens=None):
    return lambda prompts: [f"Final Answer: {max_new_tokens}" if "格式" in p else "the answer is 3" for p in prompts]


def test_command_line_evaluations(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(type(spark), "stop", lambda self: None)
    (tmp_path / "a.json").write_text(json.dumps([{"question": "q", "answer": 7}, {"question": "r", "answer": "8"}]))
    flows.main(["segments", "--mode", "base", "--test_path", str(tmp_path / "a.json"), "--output_path", str(tmp_path / "a.out"), "--generator", "tests.test_flows:echo", "--max_new_tokens", "7"])
    assert json.loads((tmp_path / "a.out").read_text())["summary"] == {"total": 2, "correct": 1, "accuracy": 0.5}
    (tmp_path / "b.json").write_text(json.dumps([{"Body": "b", "Question": "q", "Answer": 3.0}, {"Body": "b", "Question": "q", "Answer": 4}, {"Answer": 5}]))
    flows.main(["simple", "--mode", "full_v2", "--data_path", str(tmp_path / "b.json"), "--output_path", str(tmp_path / "b.out"), "--generator", "tests.test_flows:echo", "--limit", "2"])
    told = json.loads((tmp_path / "b.out").read_text())
    assert (told["total"], told["correct"], told["type_counter"]) == (2, 1, {"correct": 1, "reasoning_error": 1})


def test_analyse_runs_code_only_when_told(spark, tmp_path):
    path = tmp_path / "p.json"
    path.write_text(json.dumps([{"prediction": "```python\nprint(7)\n``` 7", "label": 7}, {"output": "```\n1/0\n``` 3", "answer": "4"}, {"response": "5", "answer": "5"}]))
    quiet = flows.analyse(spark, str(path), str(tmp_path / "o.json"))
    assert quiet["executable_code_count"] == 0 and quiet["code_count"] == 2
    told = flows.analyse(spark, str(path), str(tmp_path / "o.json"), hooks.subprocess_executor())
    assert told.pop("wrong") == [1]
    written = json.loads((tmp_path / "o.json").read_text(encoding="utf-8"))
    assert written["summary"] == told and [d["code_executable"] for d in written["details"]] == [True, False, None]
    assert told == {"pred_file": str(path), "total": 3, "correct": 2, "code_count": 2, "executable_code_count": 1, "accuracy": 0.6667, "code_generation_rate": 0.6667, "code_executability_rate": 0.5}
    run = hooks.subprocess_executor(3)
    assert hooks.subprocess_executor(0.5)("while True: pass") == (False, "", "timeout")
    assert run(" \n") == (False, "", "empty_code")
    ok, out, err = run("import sys\nprint('é')\nsys.exit(3)")
    assert (ok, out, err) == (False, "é", "")
    assert run("1/0")[0] is False and "ZeroDivisionError" in run("1/0")[2]


def test_segments_feed_the_analysis(spark, tmp_path):
    """What D6 writes, details under their name, is what D8 reads."""
    items = [{"question": f"q {k}, [\"x\"]", "answer": k} for k in range(40)]
    (tmp_path / "qa.json").write_text(json.dumps(items), encoding="utf-8")
    report = flows.segments(spark, "base", str(tmp_path / "qa.json"), str(tmp_path / "d6.json"), lambda: lambda prompts: [f"```python\nprint(1)\n```\n\\\\boxed{{{k % 7}}}" for k, _ in enumerate(prompts)])
    written = (tmp_path / "d6.json").read_text(encoding="utf-8")
    told = json.loads(written)
    assert written == json.dumps(told, ensure_ascii=False, indent=2) and [d["idx"] for d in told["details"]] == list(range(1, 41))
    assert list(told["details"][0]) == ["idx", "question", "gold_raw", "gold_answer", "answer_raw", "pred_answer", "is_correct"]
    rescored = flows.analyse(spark, str(tmp_path / "d6.json"), str(tmp_path / "d8.json"))
    assert (rescored["total"], rescored["code_count"], rescored["correct"]) == (40, 40, report["summary"]["correct"])
    again = json.loads((tmp_path / "d8.json").read_text(encoding="utf-8"))
    assert [d["question"] for d in again["details"]] == [x["question"] for x in items]
    assert flows.analyse(spark, str(tmp_path / "d8.json"), str(tmp_path / "again.json"))["total"] == 40


def test_numbers_of_other_scripts(spark):
    texts = ["１２", "٣", "٣/٤", "1_000", "1__0", "_1", "1_", "1_0/4", "-२.५", "1_0e0_1", "x", "٣x"]

    def plain(t):
        t = unicodedata.normalize("NFKC", t)
        try:
            return float(Fraction(t)) if "/" in t else float(t)
        except ValueError:
            return None

    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", numbers.parse_number(F.col("t")).alias("v"))
    assert {r["k"]: r["v"] for r in df.collect()} == {k: plain(t) for k, t in enumerate(texts)}


def test_rounding_is_pythons(spark):
    rng = random.Random(2)
    values = [0.125, 13 / 160, 0.5, 1.5, 2.5, 2.675, 1e-9, 0.0, -0.125, 1e300, 5e15, 0.00005, 0.00015, 1 / 3, None] + [rng.randint(0, 40_000) / 32_768 for _ in range(2000)] + [rng.random() for _ in range(2000)]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double")
    for digits in (0, 2, 4, 6):
        got = {r["k"]: r["r"] for r in df.select("k", numbers.rounded(F.col("v"), digits).alias("r")).collect()}
        assert got == {k: None if v is None else round(v, digits) for k, v in enumerate(values)}


def test_limits(spark):
    df = spark.range(10).withColumnRenamed("id", "pos")
    assert [scoring.limited(df, n).count() for n in (0, None, 3, -4, -20)] == [10, 10, 3, 6, 0]
    train, held = hooks.training_split(df, 8, 0.5)
    assert train.count() + held.count() == 8


def test_invariant_raises(spark):
    bad = spark.createDataFrame([(0, "import os")], "pos long, output string")
    with pytest.raises(ValueError, match="1 ablated"):
        conversations.validate_ablated(bad)
    assert conversations.residue_rows(bad).count() == 1


def test_histogram_order(spark):
    df = spark.createDataFrame([(0, ["b", "a"]), (1, ["a"]), (2, ["c"]), (3, ["b"])], "pos long, hits array<string>")
    assert [r["label"] for r in reports.label_histogram(df).collect()] == ["b", "a", "c"]


def test_streams(spark, tmp_path):
    schema = "ts timestamp, input string, output string"
    spark.createDataFrame([("2024-01-01 00:00:00", "q", "x = 5"), ("2024-01-01 00:00:01", "q", "x  = 5"), ("2024-01-01 00:00:02", "q", "fine")], "ts string, input string, output string").select(F.to_timestamp("ts").alias("ts"), "input", "output").write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for name, df, n in (("hits", streams.residue_stream(rows), 2), ("first", streams.keep_first_stream(rows, "ts"), 2)):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").start()
        q.processAllAvailable()
        q.stop()
        assert spark.table(name).count() == n
    q = streams.residue_counts(rows, "ts").writeStream.format("memory").queryName("counts").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select max(n) from counts where label = 'assign_like_code'").first()[0] == 2
