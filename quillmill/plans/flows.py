"""The four dataflows end to end, with their sinks, and a command line for them."""

from __future__ import annotations

import argparse
import functools
import importlib

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions.numbers import rounded
from quillmill.functions.text import has_fence
from quillmill.operators import cleaning, comparison, conversations, dedup, hooks, reports, scoring
from quillmill.sources import jsonio


def build(spark: SparkSession, input_path: str, out_dir: str, single: bool = True) -> dict:
    """Conversations to eight instruction datasets (files, or folders of parts) and clean_report.json; returns the report."""
    df = jsonio.conversations(spark, jsonio.require(spark, input_path))
    jsonio.make_folder(spark, out_dir)
    parsed = conversations.parsed(df, F.col("source")).persist(StorageLevel.MEMORY_AND_DISK)
    kept = dedup.keep_best(conversations.valid(parsed)).persist(StorageLevel.MEMORY_AND_DISK)
    rows = conversations.fan_out(kept.withColumn("pos", F.col("first_pos")))
    jsonio.write_fan_out(rows, out_dir, single)
    conversations.validate_ablated(rows.where("mode = 'ablated'"))
    report = {}
    for r in reports.build_report(parsed).collect():
        if r["section"] == "scalar":
            report[r["name"]] = r["n"]
        else:
            report.setdefault(r["section"], {})[r["name"]] = r["n"]
    jsonio.write_report(spark, report, f"{out_dir}/clean_report.json")
    kept.unpersist()
    parsed.unpersist()
    return report


def clean(spark: SparkSession, input_path: str, output_path: str, report_path: str | None = None, single: bool = True) -> dict:
    """Code-bearing rows to cleaned ones and a report; returns the report."""
    done = cleaning.cleaned(jsonio.instruction_rows(spark, input_path), "is_object").persist(StorageLevel.MEMORY_AND_DISK)
    ok = done.where("outcome = 'ok'")
    first = dedup.keep_first(ok).persist(StorageLevel.MEMORY_AND_DISK)
    jsonio.write_jsonl(first, output_path, single=single)
    outcomes = reports.as_map(reports.counted(done, "outcome"), "outcome", "n")
    kept, example = first.count(), reports.first_example(first).first()[0]
    report = {
        "input_path": input_path, "output_path": output_path, "raw_count": sum(outcomes.values()), "cleaned_count_before_dedup": outcomes.get("ok", 0),
        "cleaned_count_after_dedup": kept, "duplicate_removed": outcomes.get("ok", 0) - kept, "reason_counter": outcomes, "output_example": example.asDict() if example else None,
    }
    jsonio.write_report(spark, report, report_path or f"{output_path.removesuffix('.jsonl')}.report.json")
    first.unpersist()
    done.unpersist()
    return report


def audit(spark: SparkSession, input_path: str, report_path: str) -> dict:
    """D3: named-rule residue of outputs, counts and examples in one job; returns the report."""
    items = jsonio.read_jsonl(spark, input_path)
    # a JSON null is the text 'None' as an output, stays null as an instruction, and has no text as an input
    told = F.when(F.is_variant_null(F.try_variant_get("item", "$.instruction", "variant")), F.lit(None)).otherwise(F.coalesce(jsonio.field("item", "instruction"), F.lit("")))
    rows = items.select("line_no", told.alias("instruction"), jsonio.field("item", "input").alias("input"), F.coalesce(jsonio.field_or_none("item", "output"), F.lit("")).alias("output"))
    held, told = reports.told_while(reports.named_audit(rows), pos="line_no")
    found = held.where(F.size("hits") > 0).orderBy("line_no").limit(50)
    shown = [r.asDict() for r in found.select("line_no", "hits", "instruction", F.substring(F.coalesce("input", F.lit("")), 1, 300).alias("input"), F.substring("output", 1, 800).alias("output_preview")).collect()]
    seen = told()
    report = {
        "input_path": input_path, "total_samples": seen["total"], "residue_samples": seen["hits"], "clean_samples": seen["total"] - seen["hits"],
        "residue_ratio": round(seen["hits"] / seen["total"], 6) if seen["total"] else 0.0, "reason_counter": seen["histogram"], "examples": shown,
    }
    jsonio.write_report(spark, report, report_path)
    return report


def spot_check(spark: SparkSession, input_path: str) -> tuple[int, list]:
    """How many outputs hit the nine rules, and the first ten."""
    held = reports.strict_audit(jsonio.strict_rows(spark, input_path))
    return held.where(F.size("hits") > 0).count(), reports.examples(held, 10, 800).collect()


def fence_ratio(spark: SparkSession, input_path: str) -> float:
    """D5."""
    return reports.ratio(jsonio.strict_rows(spark, input_path), has_fence(F.col("output"))).first()["ratio"]


def qa_items(spark: SparkSession, path: str) -> DataFrame:
    """Pos, question, gold_raw."""
    items = jsonio.read_json_array(spark, path)
    return items.select("pos", jsonio.truthy("item", "instruction", "question", "input").alias("question"), jsonio.truthy("item", "gold_answer", "answer", "label").alias("gold_raw"))


def body_items(spark: SparkSession, path: str) -> DataFrame:
    """Pos, question, answer, raw_item (the item's JSON text)."""
    items = jsonio.read_json_array(spark, path)
    texts = items.select("pos", F.col("text").alias("raw_item"), jsonio.field("item", "Body").alias("Body"), jsonio.field("item", "Question").alias("Question"), F.coalesce(jsonio.field_or_none("item", "Answer"), F.lit("")).alias("answer"))
    return texts.select("pos", scoring.body_question("Body", "Question").alias("question"), "answer", "raw_item")


def evaluate_segments(answered: DataFrame, mode: str, test_path: str, output_path: str) -> dict:
    """D6 after generation: details and summary of pos, question, gold_raw, answer_raw."""
    scoring.check_mode(mode)
    details = scoring.scored_segments(answered)
    s = scoring.accuracy(details).withColumn("accuracy", rounded(F.col("accuracy"), 6)).first()
    report = {"mode": mode, "test_path": test_path, "summary": {"total": s["total"], "correct": s["correct"], "accuracy": s["accuracy"]}}
    jsonio.write_report(details.sparkSession, report, output_path, details=(details, "idx", {}))
    return report


def evaluate_simple(answered: DataFrame, mode: str, dataset: str, output_path: str) -> dict:
    """D7 after generation."""
    results = scoring.scored_simple(answered)
    s = scoring.accuracy(results, "correct", empty=None).withColumn("accuracy", rounded(F.col("accuracy"), 4)).first()
    kinds = reports.as_map(results.groupBy("type").agg(F.count("*").alias("n"), F.min("id").alias("first")).orderBy("first"), "type", "n")
    report = {"mode": mode, "dataset": dataset, "total": s["total"], "correct": s["correct"], "accuracy": s["accuracy"], "type_counter": kinds}
    raw = {"raw_item": jsonio.indented(F.col("raw_item"))} if "raw_item" in results.columns else {}
    jsonio.write_report(results.sparkSession, report, output_path, results=(results, "id", raw))
    return report


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """Pos, question, gold_answer, answer_raw; of a list, or of the ``details`` that ``segments`` and ``analyse`` write."""
    items = jsonio.read_json_array(spark, path, "details")
    return items.select("pos", jsonio.truthy("item", "instruction", "question").alias("question"), jsonio.truthy("item", "gold_answer", "answer", "label").alias("gold_answer"), jsonio.truthy("item", "answer_raw", "prediction", "pred", "output", "response").alias("answer_raw"))


def analyse(spark: SparkSession, pred_file: str, out_file: str, executor: hooks.Executor | None = None) -> dict:
    """Rescoring of saved predictions, as a list or as the object that ``segments`` wrote; code runs only with an executor.

    Returns the summary and, as told on the console, the first wrong ids.
    """
    details = hooks.executed(scoring.analysed(predictions(spark, pred_file)), executor).persist(StorageLevel.MEMORY_AND_DISK)
    rates = {k: rounded(F.col(k), 4) for k in ("accuracy", "code_generation_rate", "code_executability_rate")}
    s = {"pred_file": pred_file, **scoring.analysis_summary(details).withColumns(rates).first().asDict()}
    told = details.select("idx", "question", "gold_answer", "pred_answer", "is_correct", "has_code", "code_executable", "exec_stdout", "exec_stderr", "answer_raw")
    jsonio.write_report(spark, {"summary": s}, out_file, details=(told, "idx", {}))
    wrong = [r[0] for r in scoring.wrong_ids(details).collect()]
    details.unpersist()
    return s | {"wrong": wrong}


#: Where reports keep their rows: names of the item and of whether it is right.
OUTCOMES = {"details": ("idx", "is_correct"), "results": ("id", "correct")}


def compare(spark: SparkSession, first: str, second: str, out_file: str, member: str = "details") -> dict:
    """Two reports on the same items: paired table, exact tail and interval of the difference; returns the report."""
    idx, correct = OUTCOMES[member]

    def told(path: str) -> DataFrame:
        items = jsonio.read_json_array(spark, jsonio.require(spark, path), member)
        return items.select(F.try_variant_get("item", f"$.{idx}", "bigint").alias("idx"), F.try_variant_get("item", f"$.{correct}", "boolean").alias("correct"))

    pairs = comparison.paired(told(first), told(second)).persist(StorageLevel.MEMORY_AND_DISK)
    report = {"first": first, "second": second, **comparison.compared(pairs).first().asDict(), **comparison.interval(pairs).first().asDict()}
    pairs.unpersist()
    jsonio.write_report(spark, report, out_file)
    return report


def summary_lines(report: dict) -> str:
    """What is told on the console."""
    return "\n".join(f"{k}: {v}" for k, v in report.items() if not isinstance(v, (list, dict))) + "".join(f"\n{k}: " + ", ".join(f"{a}={b}" for a, b in sorted(v.items())) for k, v in report.items() if isinstance(v, dict))


def generator(name: str, **told):
    """``module:factory`` as a hook that makes a batch generator; the factory gets what was told of the model."""
    module, _, factory = name.partition(":")
    make = getattr(importlib.import_module(module), factory)
    return functools.partial(make, **{k: v for k, v in told.items() if v is not None})


def segments(spark: SparkSession, mode: str, test_path: str, output_path: str, make, log: str | None = None) -> dict:
    """D6 with generation: items are prompted, answered by the hook's generator, and scored; ``log`` keeps answers for a rerun."""
    scoring.check_mode(mode)
    items = qa_items(spark, jsonio.require(spark, test_path))
    answered = hooks.generated(items.withColumn("prompt", scoring.number_prompt(F.col("question"))), make, log=log).drop("prompt").persist(StorageLevel.MEMORY_AND_DISK)
    report = evaluate_segments(answered, mode, test_path, output_path)
    answered.unpersist()
    return report


def simple(spark: SparkSession, mode: str, data_path: str, output_path: str, make, limit: int | None = None, log: str | None = None) -> dict:
    """D7 with generation; the generator gives prompt and answer together, as the task's does."""
    items = scoring.limited(body_items(spark, jsonio.require(spark, data_path)), limit)
    prompts = items.select("pos", scoring.boxed_prompt(F.col("question")).alias("prompt"))
    answers = hooks.generated(prompts, make, log=log).select("pos", F.col("answer_raw").alias("model_output"))
    answered = items.join(answers, "pos").persist(StorageLevel.MEMORY_AND_DISK)
    report = evaluate_simple(answered, mode, data_path, output_path)
    answered.unpersist()
    return report


def main(argv: list[str] | None = None) -> None:
    """Build --input --out_dir [--parts] | clean --input --output [--report] [--parts] | audit --input --report | spot --input | fences --input
    | segments --mode --test_path --output_path --generator [--base_model] [--max_new_tokens] [--log]
    | simple --mode --data_path --output_path --generator [--base_model_path] [--adapter_path] [--limit] [--max_new_tokens] [--log]
    | compare --first --second --out_file [--member]
    | analyse --pred_file --out_file [--run_code]. A generator is ``module:factory``."""
    parser = argparse.ArgumentParser(prog="quillmill")
    sub = parser.add_subparsers(dest="flow", required=True)
    for name, needed, optional in (
        ("build", ("--input", "--out_dir"), ()), ("clean", ("--input", "--output"), ("--report",)), ("audit", ("--input", "--report"), ()),
        ("spot", ("--input",), ()), ("fences", ("--input",), ()), ("analyse", ("--pred_file", "--out_file"), ()),
        ("segments", ("--mode", "--test_path", "--output_path", "--generator"), ("--base_model",)),
        ("compare", ("--first", "--second", "--out_file"), ()),
        ("simple", ("--mode", "--data_path", "--output_path", "--generator"), ("--base_model_path", "--adapter_path")),
    ):
        p = sub.add_parser(name)
        for n in needed:
            p.add_argument(n, required=True)
        for n in optional:
            p.add_argument(n)
        if name == "analyse":
            p.add_argument("--run_code", action="store_true")
        if name in ("build", "clean"):
            p.add_argument("--parts", action="store_true")
        if name == "compare":
            p.add_argument("--member", choices=sorted(OUTCOMES), default="details")
        if name in ("segments", "simple"):
            p.add_argument("--log")
            p.add_argument("--max_new_tokens", type=int, default=512 if name == "segments" else 256)
        if name == "simple":
            p.add_argument("--limit", type=int)
    a = parser.parse_args(argv)
    spark = SparkSession.builder.appName("quillmill").getOrCreate()
    if a.flow == "build":
        print(summary_lines(build(spark, a.input, a.out_dir, not a.parts)))
    elif a.flow == "clean":
        print(summary_lines(clean(spark, a.input, a.output, a.report, not a.parts)))
    elif a.flow == "audit":
        print(summary_lines(audit(spark, a.input, a.report)))
    elif a.flow == "spot":
        n, shown = spot_check(spark, a.input)
        print(f"outputs with residue: {n}", *(f"{r['pos']}: {r['hits']}\n{r['output_preview']}" for r in shown), sep="\n")
    elif a.flow == "fences":
        print(f"share of outputs with a fence: {fence_ratio(spark, a.input):.2%}")
    elif a.flow == "segments":
        print(summary_lines(segments(spark, a.mode, a.test_path, a.output_path, generator(a.generator, base_model=a.base_model, max_new_tokens=a.max_new_tokens), a.log)))
    elif a.flow == "simple":
        make = generator(a.generator, base_model=a.base_model_path, adapter_path=a.adapter_path, max_new_tokens=a.max_new_tokens)
        print(summary_lines(simple(spark, a.mode, a.data_path, a.output_path, make, a.limit, a.log)))
    elif a.flow == "compare":
        print(summary_lines(compare(spark, a.first, a.second, a.out_file, a.member)))
    else:
        told = analyse(spark, a.pred_file, a.out_file, hooks.subprocess_executor() if a.run_code else None)
        print(summary_lines(told), f"wrong sample idx: {told['wrong']}", sep="\n")


if __name__ == "__main__":
    main()


