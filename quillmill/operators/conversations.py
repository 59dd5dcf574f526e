"""Conversations to validated samples with full and ablated outputs.

Input rows have ``pos`` (the order of the source) and ``conversations``, an
array of structs (from, value). One pass of built-in expressions; a rejected row
keeps the first reason that holds, in the cascade's order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions import rules as R
from quillmill.functions import text as T
from quillmill.functions.dialect import strip

SAMPLE = ("instruction", "input", "full_output", "ablated_output", "style", "source", "turns", "has_code", "quality_score")


def packed(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """pos and conversations from one row for each turn; a conversation's turns meet in one row by nature."""
    turns = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), F.col(role).alias("from"), F.col(text).alias("value"))))
    return rows.groupBy(F.col(key).alias("pos")).agg(F.transform(turns, lambda x: F.struct(x["from"].alias("from"), x["value"].alias("value"))).alias("conversations"))


def role_of(c: Column) -> Column:
    """Aliases by table, other roles as they are."""
    table = F.create_map(*(F.lit(x) for pair in R.ROLES.items() for x in pair))
    return F.coalesce(F.try_element_at(table, c), c, F.lit(""))


def messages(c: Column) -> Column:
    """Roles mapped, contents normalized, messages without either dropped."""
    mapped = F.transform(c, lambda m: F.struct(role_of(m["from"]).alias("role"), T.normalize_chat(m["value"]).alias("content")))
    return F.filter(mapped, lambda m: (m["role"] != "") & (m["content"] != ""))


def _contents(items: Column, role: str) -> Column:
    return F.transform(F.filter(items, lambda m: m["role"] == role), lambda m: m["content"])


def _joined(*parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*(strip(p) for p in parts)), lambda x: x != ""), "\n\n")


def parsed(df: DataFrame, source: Column | None = None) -> DataFrame:
    """All columns of the sample, and ``reason``: null for valid rows. Keeps pos and other columns of ``df``."""
    first, final = F.col("first_answer"), F.col("last_answer")
    other = F.when(final != first, final)
    n = F.col("turns")
    results = F.filter(F.transform(F.col("later_users"), T.execution_result), lambda x: x != "")
    titled = F.when(F.size("results") > 0, F.concat(F.lit(R.EXECUTION_TITLE), F.array_join("results", "\n")))
    several = F.size("answers") > 1
    staged = (
        df.withColumn("msgs", messages(F.col("conversations")))
        .withColumns({"turns": F.size("msgs"), "had_system": F.coalesce(F.get("msgs", F.lit(0))["role"] == "system", F.lit(False))})
        .withColumn("after", F.slice("msgs", F.when(F.col("had_system"), 2).otherwise(1), F.greatest(n, F.lit(0))))
        .withColumn("user_at", F.coalesce(F.array_position(F.transform("after", lambda m: m["role"]), "user"), F.lit(0)).cast("int"))
        .withColumn("question", F.when(F.col("user_at") > 0, T.with_prefix(F.get("after", F.col("user_at") - 1)["content"])))
        .withColumn("tail", F.when(F.col("user_at") > 0, F.slice("after", F.col("user_at") + 1, F.greatest(n, F.lit(0)))))
        .withColumns({"answers": _contents(F.col("tail"), "assistant"), "later_users": _contents(F.col("tail"), "user")})
        .withColumns({"first_answer": F.get("answers", F.lit(0)), "last_answer": F.try_element_at("answers", F.lit(-1)), "results": F.when(several, results)})
        .withColumns({
            "full_output": T.normalize_chat(F.when(several, _joined(first, titled, other)).otherwise(first)),
            "ablated_first": T.ablated(first),
            "ablated_other": F.when(several, T.ablated(other)),
        })
        .withColumn("ablated_output", T.normalize_chat(F.when(several, _joined(F.col("ablated_first"), F.col("ablated_other"))).otherwise(F.col("ablated_first"))))
        .withColumn("residue", T.strict_residue(F.col("ablated_output")))
    )
    reason = (
        F.when(F.col("conversations").isNull() | (F.size("conversations") == 0), "missing_or_empty_conversations")
        .when(n < 2, "too_few_valid_messages")
        .when(~n.isin(3, 5), F.concat(F.lit("unsupported_turns_"), n.cast("string")))
        .when(F.col("user_at") == 0, "missing_user_question")
        .when(F.size("tail") == 0, "missing_response_after_question")
        .when(F.size("answers") == 0, "missing_assistant_answer")
        .when(F.length("full_output") < 30, "full_output_too_short")
        .when(F.length("ablated_output") < 20, "ablated_output_too_short")
        .when(F.size("residue") > 0, "ablated_code_residue")
    )
    instruction = F.when(F.col("had_system"), F.get("msgs", F.lit(0))["content"]).otherwise(R.DEFAULT_SYSTEM)
    done = staged.withColumns({"reason": reason, "instruction": instruction, "input": F.col("question"), "has_code": F.coalesce(T.has_code(first), F.lit(False)), "source": source if source is not None else F.lit("")})
    done = done.withColumn("style", T.style(F.col("question")))
    done = done.withColumn("quality_score", T.quality_score(F.col("question"), F.col("full_output"), F.col("ablated_output"), n, F.col("has_code"), F.col("had_system")))
    keep = [c for c in df.columns if c not in ("conversations", *SAMPLE)]
    # a generator, as a filter on the reason must not be pushed below: it would carry all of the above once more
    return done.select(*keep, F.inline(F.array(F.struct(*SAMPLE, "reason"))))


def valid(df: DataFrame) -> DataFrame:
    return df.where("reason is null").drop("reason")


def subsets(samples: DataFrame) -> dict[str, DataFrame]:
    """F17."""
    return {"all": samples, "codeonly": samples.where("has_code"), "gsm8kstyle": samples.where("style = 'gsm8kstyle'"), "mathstyle": samples.where("style = 'mathstyle'")}


def instruction_rows(samples: DataFrame, mode: str) -> DataFrame:
    """Instruction, input, output; ``mode`` full or ablated."""
    return samples.select("pos", "instruction", "input", F.col("full_output" if mode == "full" else "ablated_output").alias("output"))


def fan_out(samples: DataFrame) -> DataFrame:
    """S7 as rows: subset, mode and the instruction row, one for each subset and mode a sample is in."""
    own = F.array_compact(F.array(F.lit("all"), F.when(F.col("has_code"), "codeonly"), F.when(F.col("style").isin("gsm8kstyle", "mathstyle"), F.col("style"))))
    both = F.array(F.struct(F.lit("full").alias("mode"), F.col("full_output").alias("output")), F.struct(F.lit("ablated").alias("mode"), F.col("ablated_output").alias("output")))
    return samples.withColumn("subset", F.explode(own)).withColumn("m", F.explode(both)).select("subset", "m.mode", "pos", "instruction", "input", "m.output")


def residue_rows(rows: DataFrame, limit: int = 50) -> DataFrame:
    """R4's examples: pos, hits, preview of outputs with residue, the first by pos."""
    hits = rows.withColumn("hits", T.strict_residue(F.col("output"))).where(F.size("hits") > 0)
    return hits.select("pos", "hits", F.substring("output", 1, 1200).alias("preview")).orderBy("pos").limit(limit)


def validate_ablated(rows: DataFrame) -> None:
    """Raises if any output has residue."""
    bad = rows.where(F.size(T.strict_residue(F.col("output"))) > 0).count()
    if bad:
        raise ValueError(f"{bad} ablated outputs hold code residue")
