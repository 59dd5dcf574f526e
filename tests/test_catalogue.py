"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from quillmill.plans import catalogue, fixtures

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("conversations", "documents", "benchmark", "orders", "lineitem"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    wanted = duck.sql(catalogue.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(wanted.columns)
    order = [wanted.columns.index(c) for c in df.columns]
    key = lambda rows: sorted(map(repr, rows))
    assert key(tuple(r) for r in df.collect()) == key(tuple(r[i] for i in order) for r in wanted.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_every_turn_is_read(spark):
    given = spark.read.parquet(f"{SF}/conversations.parquet")
    wanted = sorted(map(tuple, given.select("conv_id", "turn").collect()))
    for name in ("exec_result_extract", "code_block_removal", "ablated_output"):
        # ids below 0 are the fixture's own
        assert sorted(map(tuple, catalogue.QUERIES[name](spark, SF).where("conv_id >= 0").select("conv_id", "turn").collect())) == wanted
    sizes = given.groupBy("conv_id").count()
    kept = catalogue._parsed(spark, SF).join(sizes, sizes["conv_id"] == F.col("pos")).where("reason IS NULL")
    assert {r["count"] - r["turns"] for r in kept.collect()} == {0}


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_every_reason_is_met(spark):
    reasons = {r["reason"] for r in catalogue.QUERIES["reject_reason_histogram"](spark, "/root/testdata/sf0.01").collect()}
    assert {"missing_or_empty_conversations", "too_few_valid_messages", "missing_user_question", "missing_response_after_question", "missing_assistant_answer", "full_output_too_short", "ablated_output_too_short", "ablated_code_residue", "ok"} <= reasons
    assert any(r.startswith("unsupported_turns_") for r in reasons)
    outcomes = {r["outcome"] for r in catalogue.QUERIES["clean_v2_reasons"](spark, SF).collect()}
    assert outcomes == {"ok", "not_dict", "empty_output", "empty_question", "no_python_code", "no_final_answer", "code_too_long"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_texts_are_whole(spark):
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.col("text").alias("whole"))
    for sql, pos, column in ((fixtures.ANSWERS, "pos", "answer_raw"), (fixtures.ANSWERS, "pos", "question"), (fixtures.QUESTIONS, "doc_id", "question"), (fixtures.CODE_ROWS, "pos", "output"), (fixtures.RESIDUE, "doc_id", "output")):
        rows = catalogue._input(spark, SF, "documents", sql).select(F.col(pos).alias("id"), column).join(texts, F.col("id") == F.col("doc_id"))
        assert rows.count() == texts.count() and rows.where(~F.contains(column, "whole")).count() == 0, column
    turns = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", F.col("text").alias("whole"))
    rows = catalogue._turns(spark, SF).join(turns, ["conv_id", "turn"])
    assert rows.count() == turns.count() and rows.where(~F.contains("text", "whole")).count() == 0
    rows = catalogue.prompts_and_fields(spark, SF).join(texts, "doc_id")
    assert rows.where(~F.endswith("number_prompt", "whole")).count() == 0
