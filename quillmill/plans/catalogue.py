"""Registered queries over the driver's tables, each with its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions import answers as A
from quillmill.functions import numbers as N
from quillmill.functions import rules as R
from quillmill.functions import text as T
from quillmill.functions.dialect import findall
from quillmill.operators import cleaning, comparison, conversations, dedup, reports, scoring, selection
from quillmill.plans import duck as D
from quillmill.plans import fixtures as X
from quillmill.sources import commit, jsonio

FLAGSHIP = "build_flagship"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def _input(spark: SparkSession, sf_dir: str, table: str, sql: str) -> DataFrame:
    """A fixture's rows; the table is read by the columns the fixture names."""
    spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(f"quillmill_{table}")
    return spark.sql(sql.replace("{{", "{").replace("}}", "}").replace(f"FROM {table}", f"FROM quillmill_{table}"))


def _duck(sql: str) -> str:
    return sql.replace("{{", "{").replace("}}", "}").replace("AS STRING", "AS VARCHAR")


def _pos(q: str) -> str:
    return f"({_duck(q)})"


def _joined(c: str) -> F.Column:
    return F.array_join(c, "|")


# ---- conversations ----


def _turns(spark, sf_dir):
    return _input(spark, sf_dir, "conversations", X.TURNS)


def _conversations(spark, sf_dir):
    held = conversations.packed(_turns(spark, sf_dir))
    kind = held.schema["conversations"].dataType
    none = F.when(F.col("pos") % 2 == 0, F.lit(None)).otherwise(F.array()).cast(kind)
    empty = _input(spark, sf_dir, "conversations", X.EMPTY).select("pos", none.alias("conversations"))
    return held.unionByName(empty)


def _parsed(spark, sf_dir):
    return conversations.parsed(_conversations(spark, sf_dir), F.lit("conversations"))


_PARSED = f"""
t AS ({_duck(X.TURNS)}),
p AS (SELECT conv_id AS pos, list(struct_pack(r := role, v := text) ORDER BY turn) AS c FROM t GROUP BY 1 UNION ALL SELECT pos, CASE WHEN pos % 2 <> 0 THEN [] END FROM ({X.EMPTY})),
m AS (SELECT pos, list_filter(list_transform(c, lambda x: struct_pack(role := CASE x.r WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE coalesce(x.r, '') END, content := {D.n1("x.v")})), lambda x: x.role <> '' AND x.content <> '') AS msgs, c FROM p),
a AS (SELECT *, len(msgs)::INT AS turns, coalesce(msgs[1].role = 'system', false) AS sys FROM m),
b AS (SELECT *, CASE WHEN sys THEN msgs[2:] ELSE msgs END AS rest FROM a),
u AS (SELECT *, coalesce(list_position(list_transform(rest, lambda x: x.role), 'user'), 0) AS ua FROM b),
q AS (SELECT *, CASE WHEN ua > 0 THEN {D.prefixed("rest[ua].content")} END AS question, CASE WHEN ua > 0 THEN rest[ua + 1:] END AS tail FROM u),
s AS (SELECT *, list_transform(list_filter(tail, lambda x: x.role = 'assistant'), lambda x: x.content) AS ans, list_transform(list_filter(tail, lambda x: x.role = 'user'), lambda x: x.content) AS later FROM q),
f AS (SELECT *, ans[1] AS fa, ans[-1] AS la, list_filter(list_transform(later, lambda x: {D.c3("x")}), lambda x: x <> '') AS res FROM s),
o AS (SELECT *, {D.n1(f"CASE WHEN len(ans) > 1 THEN array_to_string(list_filter([{D.strip('fa')}, CASE WHEN len(res) > 0 THEN '代码执行结果：' || chr(10) || array_to_string(res, chr(10)) END, CASE WHEN la <> fa THEN {D.strip('la')} END], lambda x: x IS NOT NULL AND x <> ''), chr(10) || chr(10)) ELSE fa END")} AS full_output,
  {D.c5("fa")} AS af, CASE WHEN len(ans) > 1 AND la <> fa THEN {D.c5("la")} END AS ao FROM f),
o2 AS (SELECT *, {D.n1("CASE WHEN len(ans) > 1 THEN array_to_string(list_filter([af, ao], lambda x: x IS NOT NULL AND x <> ''), chr(10) || chr(10)) ELSE af END")} AS ablated_output FROM o),
z AS (SELECT *, {D.strict("ablated_output")} AS residue, coalesce({D.has("fa", "(?i)```python")} OR {D.has("fa", "(?i)" + D.re2(R.FENCED))}, false) AS has_code FROM o2),
samples AS (SELECT pos, CASE WHEN sys THEN msgs[1].content ELSE {D.q(R.DEFAULT_SYSTEM)} END AS instruction, question AS input, full_output, ablated_output, {D.style("question")} AS style, 'conversations' AS source, turns, has_code,
  (CASE WHEN sys THEN 2 ELSE 0 END + CASE WHEN turns IN (3, 5) THEN 2 ELSE 0 END + CASE WHEN has_code THEN 1 ELSE 0 END + CASE WHEN contains(full_output, chr(92) || 'boxed') THEN 2 ELSE 0 END + CASE WHEN length(question) >= 8 THEN 1 ELSE 0 END
   + CASE WHEN length(full_output) >= 80 THEN 2 ELSE 0 END + CASE WHEN length(ablated_output) >= 50 THEN 1 ELSE 0 END - CASE WHEN length(full_output) > 5000 THEN 2 ELSE 0 END)::INT AS quality_score,
  CASE WHEN c IS NULL OR len(c) = 0 THEN 'missing_or_empty_conversations' WHEN turns < 2 THEN 'too_few_valid_messages' WHEN turns NOT IN (3, 5) THEN 'unsupported_turns_' || turns WHEN ua = 0 THEN 'missing_user_question'
   WHEN len(tail) = 0 THEN 'missing_response_after_question' WHEN len(ans) = 0 THEN 'missing_assistant_answer' WHEN length(full_output) < 30 THEN 'full_output_too_short' WHEN length(ablated_output) < 20 THEN 'ablated_output_too_short'
   WHEN len(residue) > 0 THEN 'ablated_code_residue' END AS reason FROM z)"""
_KEPT = f"""{_PARSED},
keyed AS (SELECT *, {D.key("input")} AS dedup_key FROM samples WHERE reason IS NULL),
kept AS (SELECT * FROM (SELECT *, min(pos) OVER (PARTITION BY dedup_key) AS first_pos, row_number() OVER (PARTITION BY dedup_key ORDER BY quality_score DESC, pos) AS k FROM keyed) WHERE k = 1)"""


@query(f"WITH {_PARSED} SELECT pos, turns, array_to_string(list_transform(msgs, lambda x: x.role), '|') AS roles FROM a")
def role_map_turn_counts(spark, sf_dir):
    msgs = _conversations(spark, sf_dir).withColumn("msgs", conversations.messages(F.col("conversations")))
    return msgs.select("pos", F.size("msgs").alias("turns"), F.array_join(F.transform("msgs", lambda m: m["role"]), "|").alias("roles"))


@query(f"WITH {_PARSED} SELECT coalesce(reason, 'ok') AS reason, count(*) AS n FROM samples GROUP BY 1")
def reject_reason_histogram(spark, sf_dir):
    return reports.counted(_parsed(spark, sf_dir).withColumn("reason", F.coalesce("reason", F.lit("ok"))), "reason")


@query(f"WITH {_PARSED} SELECT pos, instruction, input, full_output, ablated_output, style, source, turns, has_code, quality_score FROM samples WHERE reason IS NULL")
def parsed_samples(spark, sf_dir):
    return conversations.valid(_parsed(spark, sf_dir))


@query(f"SELECT conv_id, turn, {D.c3('text')} AS result FROM {_pos(X.TURNS)}")
def exec_result_extract(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "turn", T.execution_result(F.col("text")).alias("result"))


@query(f"SELECT conv_id, turn, {D.n1('text')} AS text, {D.c4('text')} AS bare FROM {_pos(X.TURNS)}")
def code_block_removal(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "turn", T.normalize_chat(F.col("text")).alias("text"), T.without_blocks(F.col("text")).alias("bare"))


@query(f"SELECT doc_id, {D.c5('output')} AS ablated FROM {_pos(X.RESIDUE)}")
def strong_ablation_lines(spark, sf_dir):
    return _input(spark, sf_dir, "documents", X.RESIDUE).select("doc_id", T.ablated(F.col("output")).alias("ablated"))


@query(f"SELECT conv_id, turn, {D.c5('text')} AS ablated FROM {_pos(X.TURNS)}")
def ablated_output(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "turn", T.ablated(F.col("text")).alias("ablated"))


# ---- residue ----


def _residue(spark, sf_dir):
    return _input(spark, sf_dir, "documents", X.RESIDUE)


@query(f"SELECT doc_id, array_to_string({D.strict('output')}, '|') AS strict_hits, array_to_string({D.strict('output', False, False)}, '|') AS spot_hits FROM {_pos(X.RESIDUE)}")
def residue_rules_strict(spark, sf_dir):
    c = F.col("output")
    return _residue(spark, sf_dir).select("doc_id", _joined(T.strict_residue(c)).alias("strict_hits"), _joined(T.strict_residue(c, False, False)).alias("spot_hits"))


@query(f"SELECT doc_id, array_to_string({D.named('output')}, '|') AS hits FROM {_pos(X.RESIDUE)}")
def residue_rules_named(spark, sf_dir):
    return _residue(spark, sf_dir).select("doc_id", _joined(T.named_residue(F.col("output"))).alias("hits"))


@query(f"SELECT label, count(*) AS n, min(doc_id) AS first_pos FROM (SELECT doc_id, unnest({D.named('output')}) AS label FROM {_pos(X.RESIDUE)}) GROUP BY label")
def residue_histogram(spark, sf_dir):
    return reports.label_histogram(reports.named_audit(_residue(spark, sf_dir)), pos="doc_id")


@query(f"SELECT count(*) AS total, count(*) FILTER (len({D.named('output')}) > 0) AS hits, count(*) FILTER (len({D.named('output')}) > 0) / count(*) AS residue_ratio FROM {_pos(X.RESIDUE)}")
def residue_ratio(spark, sf_dir):
    return reports.ratio(reports.named_audit(_residue(spark, sf_dir)), F.size("hits") > 0, "residue_ratio")


@query(f"SELECT doc_id, array_to_string(hits, '|') AS hits, substring(output, 1, 800) AS output_preview FROM (SELECT doc_id, output, {D.named('output')} AS hits FROM {_pos(X.RESIDUE)}) WHERE len(hits) > 0 ORDER BY doc_id LIMIT 50")
def residue_examples_top50(spark, sf_dir):
    return reports.examples(reports.named_audit(_residue(spark, sf_dir)), 50, 800, "doc_id").withColumn("hits", _joined("hits"))


@query(f"WITH {_KEPT} SELECT count(*) AS rows, count(*) FILTER (len(residue_again) > 0) AS bad FROM (SELECT {D.strict('ablated_output')} AS residue_again FROM kept)")
def validation_invariant(spark, sf_dir):
    rows = conversations.instruction_rows(dedup.keep_best(conversations.valid(_parsed(spark, sf_dir))), "ablated")
    return rows.agg(F.count("*").alias("rows"), F.count_if(F.size(T.strict_residue(F.col("output"))) > 0).alias("bad"))


@query(f"SELECT count(*) AS total, count(*) FILTER (contains(lower(output), repeat(chr(96), 3))) AS hits, count(*) FILTER (contains(lower(output), repeat(chr(96), 3))) / count(*) AS ratio FROM {_pos(X.RESIDUE)}")
def full_fence_ratio(spark, sf_dir):
    return reports.ratio(_residue(spark, sf_dir), T.has_fence(F.col("output")))


# ---- style, score, dedup ----


def _questions(spark, sf_dir):
    return _input(spark, sf_dir, "documents", X.QUESTIONS)


@query(f"SELECT doc_id, {D.style('question')} AS style, {D.hints('lower(question)')}::INT AS hints FROM {_pos(X.QUESTIONS)}")
def style_class(spark, sf_dir):
    c = F.col("question")
    return _questions(spark, sf_dir).select("doc_id", T.style(c).alias("style"), T.hint_count(F.lower(c)).alias("hints"))


@query(f"SELECT style, count(*) AS n FROM (SELECT {D.style('text')} AS style FROM benchmark) GROUP BY style")
def style_counts(spark, sf_dir):
    return reports.counted(spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(T.style(F.col("text")).alias("style")), "style")


@query(f"WITH {_PARSED} SELECT pos, quality_score FROM samples WHERE reason IS NULL")
def quality_score(spark, sf_dir):
    return conversations.valid(_parsed(spark, sf_dir)).select("pos", "quality_score")


@query(f"SELECT doc_id, {D.key('question')} AS dedup_key FROM {_pos(X.QUESTIONS)}")
def dedup_key(spark, sf_dir):
    return _questions(spark, sf_dir).select("doc_id", T.question_key(F.col("question")).alias("dedup_key"))


_BEST = f"(SELECT doc_id AS pos, text AS input, (length(text) % 5 + doc_id % 3)::BIGINT AS quality_score, {D.key('text')} AS dedup_key FROM documents)"


def _best(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("pos"), F.col("text").alias("input"))
    return rows.withColumn("quality_score", (F.length("input") % 5 + F.col("pos") % 3).cast("bigint"))


@query(f"SELECT pos, quality_score, first_pos FROM (SELECT *, min(pos) OVER (PARTITION BY dedup_key) AS first_pos, row_number() OVER (PARTITION BY dedup_key ORDER BY quality_score DESC, pos) AS k FROM {_BEST}) WHERE k = 1")
def dedup_keep_best(spark, sf_dir):
    return dedup.keep_best(_best(spark, sf_dir)).select("pos", "quality_score", "first_pos")


@query(f"SELECT count(*) - count(DISTINCT dedup_key) AS removed FROM {_BEST}")
def dedup_removed_count(spark, sf_dir):
    keys = _best(spark, sf_dir).groupBy(T.question_key(F.col("input")).alias("k")).agg(F.count("*").alias("n"))
    return keys.agg((F.sum("n") - F.count("*")).alias("removed"))


@query(f"SELECT pos FROM (SELECT doc_id AS pos, row_number() OVER (PARTITION BY {D.sub(D.n2('text'), f'[{D.SPACES}]+', "' '")} ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def dedup_keep_first(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("pos"), F.col("text").alias("output"), F.lit("").alias("input"))
    return dedup.keep_first(rows).select("pos")


_FAN = "SELECT * FROM (SELECT 'all' AS subset, * FROM kept UNION ALL SELECT 'codeonly', * FROM kept WHERE has_code UNION ALL SELECT style, * FROM kept WHERE style <> 'general'), (VALUES ('full'), ('ablated')) v(mode)"


@query(f"WITH {_KEPT} SELECT subset, mode, count(*) AS n FROM ({_FAN}) GROUP BY 1, 2")
def subset_fanout_counts(spark, sf_dir):
    rows = conversations.fan_out(dedup.keep_best(conversations.valid(_parsed(spark, sf_dir))))
    return rows.groupBy("subset", "mode").agg(F.count("*").alias("n"))


@query(f"WITH {_KEPT} SELECT pos, instruction, input, full_output AS output FROM kept WHERE has_code")
def sft_full(spark, sf_dir):
    kept = dedup.keep_best(conversations.valid(_parsed(spark, sf_dir)))
    return conversations.instruction_rows(conversations.subsets(kept)["codeonly"], "full")


@query(f"WITH {_KEPT} SELECT pos, instruction, input, ablated_output AS output FROM kept")
def sft_ablated(spark, sf_dir):
    return conversations.instruction_rows(dedup.keep_best(conversations.valid(_parsed(spark, sf_dir))), "ablated")


@query(f"""WITH {_KEPT}, c AS (SELECT (SELECT count(*) FROM samples) AS raw, (SELECT count(*) FROM samples WHERE reason IS NULL) AS ok, (SELECT count(*) FROM kept) AS kept, (SELECT count(*) FROM kept WHERE has_code) AS code)
SELECT 'scalar' AS section, 'raw_count' AS name, raw AS n FROM c UNION ALL SELECT 'scalar', 'valid_count_before_dedup', ok FROM c UNION ALL SELECT 'scalar', 'valid_count_after_dedup', kept FROM c
UNION ALL SELECT 'scalar', 'duplicate_removed', ok - kept FROM c UNION ALL SELECT 'scalar', 'samples_with_code_after_dedup', code FROM c
UNION ALL SELECT 'skipped_reasons', reason, count(*) FROM samples WHERE reason IS NOT NULL GROUP BY reason
UNION ALL SELECT 'style_count_after_dedup', style, count(*) FROM kept GROUP BY style UNION ALL SELECT 'turns_count_after_dedup', turns::VARCHAR, count(*) FROM kept GROUP BY turns""")
def build_report_long(spark, sf_dir):
    return reports.build_report(_parsed(spark, sf_dir))


@query(f"WITH {_KEPT} SELECT pos, first_pos, dedup_key, style, turns, has_code, quality_score, length(full_output) AS full_chars, length(ablated_output) AS ablated_chars FROM kept")
def build_flagship(spark, sf_dir):
    kept = dedup.keep_best(conversations.valid(_parsed(spark, sf_dir)))
    return kept.select("pos", "first_pos", "dedup_key", "style", "turns", "has_code", "quality_score", F.length("full_output").cast("bigint").alias("full_chars"), F.length("ablated_output").cast("bigint").alias("ablated_chars"))


# ---- code-bearing rows ----

_CODE = f"""
r AS (SELECT pos, coalesce({D.n2("instruction")}, '') AS i, coalesce({D.n2("input")}, '') AS q, coalesce({D.n2("output")}, '') AS o, is_object FROM {_pos(X.CODE_ROWS)}),
c AS (SELECT *, CASE WHEN q <> '' THEN {D.strip(D.sub("q", f"^题目[:：][{D.SPACES}]*"))} ELSE {D.strip(D.sub(D.strip(D.sub("i", "(?s)^你是一个数学解题大师.*?(题目[:：])", r"'\1'")), f"^题目[:：][{D.SPACES}]*"))} END AS question, {D.c1("o")} AS code, {D.e1("o")} AS answer, {D.c8("o")} AS rest FROM r),
d AS (SELECT *, CASE WHEN NOT is_object THEN 'not_dict' WHEN o = '' THEN 'empty_output' WHEN question = '' THEN 'empty_question' WHEN code IS NULL THEN 'no_python_code' WHEN answer IS NULL OR answer = '' THEN 'no_final_answer' WHEN length(code) > 2500 THEN 'code_too_long' ELSE 'ok' END AS outcome FROM c),
e AS (SELECT *, {D.c9("rest")} AS core FROM d),
done AS (SELECT pos, {D.q(R.STANDARD_INSTRUCTION)} AS instruction, '题目：' || question AS input, CASE WHEN core <> '' THEN core || chr(10) || chr(10) || 'Final Answer: ' || answer ELSE 'Final Answer: ' || answer END AS output, outcome FROM e)"""


def _cleaned(spark, sf_dir):
    return cleaning.cleaned(_input(spark, sf_dir, "documents", X.CODE_ROWS), "is_object")


@query(f"WITH {_CODE} SELECT pos, instruction, input, output FROM done WHERE outcome = 'ok'")
def clean_v2_rows(spark, sf_dir):
    return _cleaned(spark, sf_dir).where("outcome = 'ok'").drop("outcome")


@query(f"WITH {_CODE} SELECT outcome, count(*) AS n FROM done GROUP BY outcome")
def clean_v2_reasons(spark, sf_dir):
    return reports.counted(_cleaned(spark, sf_dir), "outcome").orderBy("outcome")


@query(f"WITH {_CODE} SELECT output AS output_example FROM done WHERE outcome = 'ok' ORDER BY pos LIMIT 1")
def clean_v2_example(spark, sf_dir):
    return reports.first_example(_cleaned(spark, sf_dir).where("outcome = 'ok'")).select("output_example.output").toDF("output_example")


@query(f"SELECT pos, {D.c8('output')} AS output FROM {_pos(X.CODE_ROWS)}")
def strip_exec_sections(spark, sf_dir):
    return _input(spark, sf_dir, "documents", X.CODE_ROWS).select("pos", T.without_execution(F.col("output")).alias("output"))


# ---- numbers ----


def _numbers(spark, sf_dir):
    return _input(spark, sf_dir, "orders", X.NUMBERS)


@query(f"SELECT o_orderkey, array_to_string({D.findall('txt', D.NUM)}, '|') AS found, {D.n6('txt')} AS last_plain FROM {_pos(X.NUMBERS)}")
def number_extract_all(spark, sf_dir):
    c = F.col("txt")
    return _numbers(spark, sf_dir).select("o_orderkey", _joined(findall(c, R.NUMBER)).alias("found"), N.last_plain_number(c).alias("last_plain"))


_TOLD = "regexp_replace(txt, '^pay | in all$', '', 'g')"


@query(f"SELECT o_orderkey, {D.as_double(f"replace({D.n3(_TOLD)}, ',', '')")} AS whole, {D.n5('txt')} AS tail FROM {_pos(X.NUMBERS)}")
def number_parse(spark, sf_dir):
    told = F.regexp_replace("txt", "^pay | in all$", "")
    return _numbers(spark, sf_dir).select("o_orderkey", N.parse_number(told).alias("whole"), N.parse_last_number(F.col("txt")).alias("tail"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity::BIGINT % 5 <> 0 THEN l_suppkey::DOUBLE / (l_quantity::BIGINT % 5) END AS value FROM lineitem")
def fraction_parse(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    text = F.concat(F.col("l_suppkey").cast("string"), F.lit("/"), (F.col("l_quantity").cast("bigint") % 5).cast("string"))
    return rows.select("l_orderkey", "l_linenumber", N.as_double(text).alias("value"))


@query(f"SELECT o_orderkey, array_to_string({D.numbers('txt')}, '|') AS canon FROM {_pos(X.NUMBERS)}")
def canonical_number(spark, sf_dir):
    found = F.transform(findall(F.replace(F.col("txt"), F.lit(","), F.lit("")), R.NUMBER), N.canonical)
    return _numbers(spark, sf_dir).select("o_orderkey", _joined(found).alias("canon"))


# ---- answers and scores ----


def _answers(spark, sf_dir):
    return _input(spark, sf_dir, "documents", X.ANSWERS)


@query(f"SELECT pos, {D.e1('t')} AS answer FROM (SELECT pos, {D.n2('answer_raw')} AS t FROM {_pos(X.ANSWERS)})")
def answer_extract_clean(spark, sf_dir):
    return _answers(spark, sf_dir).select("pos", A.clean_answer(F.col("answer_raw")).alias("answer"))


_SEG = f"SELECT pos, {D.n3('answer_raw')} AS t, {D.n3('gold')} AS g FROM {_pos(X.ANSWERS)}"
_SEG2 = f"SELECT pos, t, g, {D.e2_segment('t')} AS ts, {D.e2_segment('g')} AS gs FROM ({_SEG})"
_SEG3 = f"SELECT *, {D.e2_number('ts', 't')} AS tn, {D.e2_number('gs', 'g')} AS gn FROM ({_SEG2})"
_SEG4 = f"SELECT *, {D.as_double("replace(tn, ',', '')")} AS a, {D.as_double("replace(gn, ',', '')")} AS b FROM ({_SEG3})"
_SEG5 = f"SELECT *, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN {D.close('a', 'b')} ELSE ts = gs END AS is_correct FROM ({_SEG4})"


@query(f"SELECT pos, ts AS segment, tn AS number FROM ({_SEG3})")
def answer_extract_segment(spark, sf_dir):
    c = F.col("answer_raw")
    return _answers(spark, sf_dir).select("pos", A.final_segment(c).alias("segment"), A.final_number(c).alias("number"))


@query(f"SELECT pos, {D.e3('answer_raw')} AS answer FROM {_pos(X.ANSWERS)}")
def answer_extract_simple(spark, sf_dir):
    return _answers(spark, sf_dir).select("pos", A.simple_answer(F.col("answer_raw")).alias("answer"))


@query(f"SELECT pos, {D.e4('answer_raw')} AS answer FROM {_pos(X.ANSWERS)}")
def answer_extract_analysis(spark, sf_dir):
    return _answers(spark, sf_dir).select("pos", A.analysis_answer(F.col("answer_raw")).alias("answer"))


_NUDGED = "o_totalprice * (1 + CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 5e-7 WHEN 2 THEN 3e-6 ELSE 0.1 END)"


@query(f"SELECT o_orderkey, {D.close('o_totalprice', 'x')} AS close, abs(o_totalprice - x) < 1e-6 AS strict FROM (SELECT o_orderkey, o_totalprice, {_NUDGED} AS x FROM orders)")
def score_isclose(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice", F.expr(_NUDGED.replace("5e-7", "5e-7D").replace("3e-6", "3e-6D").replace("0.1", "0.1D")).alias("x"))
    a, b = F.col("o_totalprice"), F.col("x")
    return rows.select("o_orderkey", N.is_close(a, b).alias("close"), (F.abs(a - b) < R.TOLERANCE).alias("strict"))


_GAP = "(CASE o_orderkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 7 END)"


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN false WHEN o_orderkey % 5 = 1 THEN true ELSE {_GAP} = 0 END AS equal FROM orders")
def score_abs(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_orderkey").cast("string").alias("t"), F.expr(f"cast(o_orderkey + {_GAP} as string)").alias("u"))
    key = F.col("o_orderkey") % 5
    pred = F.when(key == 0, "x y").when(key == 1, " same ").otherwise(F.col("t"))
    gold = F.when(key == 0, F.lit(None).cast("string")).when(key == 1, "same").otherwise(F.concat(F.col("u"), F.lit(".0")))
    return rows.select("o_orderkey", N.equal_or_text(pred, gold).alias("equal"))


_ANA = f"SELECT pos, answer_raw, gold, {D.e4('answer_raw')} AS p FROM {_pos(X.ANSWERS)}"
_ANA2 = f"SELECT *, {D.n5('p')} AS a, {D.n5('gold')} AS b, {D.c2('answer_raw')} AS code FROM ({_ANA})"
_ANA3 = f"SELECT *, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN {D.close('a', 'b')} ELSE {D.n3c('p')} = {D.n3c('gold')} END AS is_correct, code <> '' AS has_code FROM ({_ANA2})"


@query(f"SELECT pos, {D.n3c('p')} AS pred_key, {D.n3c('gold')} AS gold_key, is_correct FROM ({_ANA3})")
def score_text_fallback(spark, sf_dir):
    rows = _answers(spark, sf_dir).withColumn("p", A.analysis_answer(F.col("answer_raw")))
    p, g = F.col("p"), F.col("gold")
    return rows.select("pos", T.answer_key(p).alias("pred_key"), T.answer_key(g).alias("gold_key"), A.analysis_equal(p, g).alias("is_correct"))


@query(f"SELECT count(*) AS total, count(*) FILTER (is_correct) AS correct, count(*) FILTER (is_correct) / count(*) AS accuracy FROM ({_SEG5})")
def eval_a_summary(spark, sf_dir):
    return scoring.accuracy(scoring.scored_segments(_answers(spark, sf_dir).withColumnRenamed("gold", "gold_raw")))


@query(f"SELECT pos + 1 AS idx, gn AS gold_answer, tn AS pred_answer, is_correct FROM ({_SEG5})")
def eval_a_details(spark, sf_dir):
    return scoring.scored_segments(_answers(spark, sf_dir).withColumnRenamed("gold", "gold_raw")).select("idx", "gold_answer", "pred_answer", "is_correct")


_SIMPLE = f"SELECT pos, {D.n6('gold')} AS g, {D.e3('answer_raw')} AS p FROM {_pos(X.ANSWERS)}"
_SIMPLE2 = f"SELECT pos, g, p, CASE WHEN p IS NULL THEN 'extract_error' WHEN coalesce(abs({D.as_double('p')} - {D.as_double('g')}) < 1e-6, p = coalesce(g, 'None')) THEN 'correct' ELSE 'reasoning_error' END AS type FROM ({_SIMPLE})"


def _simple(spark, sf_dir):
    return scoring.scored_simple(_answers(spark, sf_dir).selectExpr("pos", "question", "gold AS answer", "answer_raw AS model_output"))


@query(f"SELECT count(*) AS total, count(*) FILTER (type = 'correct') AS correct, count(*) FILTER (type = 'correct') / count(*) AS accuracy FROM ({_SIMPLE2})")
def eval_b_summary(spark, sf_dir):
    return scoring.accuracy(_simple(spark, sf_dir), "correct", empty=None)


@query(f"SELECT type, count(*) AS n FROM ({_SIMPLE2}) GROUP BY type")
def eval_b_types(spark, sf_dir):
    return reports.counted(_simple(spark, sf_dir), "type")


@query(f"SELECT pos + 1 AS id, g AS gold, coalesce(p, 'NONE') AS pred, type FROM ({_SIMPLE2})")
def eval_b_results(spark, sf_dir):
    return _simple(spark, sf_dir).select("id", "gold", "pred", "type")


def _analysed(spark, sf_dir):
    return scoring.analysed(_answers(spark, sf_dir).withColumnRenamed("gold", "gold_answer"))


@query(f"SELECT count(*) AS total, count(*) FILTER (is_correct) AS correct, count(*) FILTER (has_code) AS code_count, count(*) FILTER (is_correct) / count(*) AS accuracy, count(*) FILTER (has_code) / count(*) AS code_generation_rate FROM ({_ANA3})")
def analysis_summary(spark, sf_dir):
    return scoring.analysis_summary(_analysed(spark, sf_dir)).select("total", "correct", "code_count", "accuracy", "code_generation_rate")


@query(f"SELECT pos AS idx, code FROM ({_ANA2})")
def code_extract_last(spark, sf_dir):
    return _analysed(spark, sf_dir).select("idx", "code")


@query(f"SELECT pos AS idx FROM ({_ANA3}) WHERE NOT is_correct ORDER BY pos LIMIT 50")
def wrong_ids_top50(spark, sf_dir):
    return scoring.wrong_ids(_analysed(spark, sf_dir))


_BOTH = f"SELECT a.pos, a.is_correct AS a, b.type = 'correct' AS b FROM ({_SEG5}) a JOIN ({_SIMPLE2}) b ON a.pos = b.pos"
_TABLE = f"SELECT count(*) AS total, count(*) FILTER (a AND b) AS both_right, count(*) FILTER (a AND NOT b) AS only_first, count(*) FILTER (NOT a AND b) AS only_second, count(*) FILTER (NOT a AND NOT b) AS both_wrong FROM ({_BOTH})"


def _pairs(spark, sf_dir):
    first = scoring.scored_segments(_answers(spark, sf_dir).withColumnRenamed("gold", "gold_raw")).select("idx", F.col("is_correct").alias("correct"))
    return comparison.paired(first, _simple(spark, sf_dir).select(F.col("id").alias("idx"), "correct"))


@query(f"""SELECT total, both_right, only_first, only_second, both_wrong, (both_right + only_first) / total AS accuracy_first, (both_right + only_second) / total AS accuracy_second,
  round(CASE WHEN m = 0 THEN 1 ELSE least(1, 2 * (SELECT sum(exp(lgamma(m + 1) - lgamma(i + 1) - lgamma(m - i + 1) - m * ln(2))) FROM range(0, k + 1) r(i))) END, 9) AS p_value
  FROM (SELECT *, only_first + only_second AS m, least(only_first, only_second) AS k FROM ({_TABLE}))""")
def model_comparison(spark, sf_dir):
    return comparison.compared(_pairs(spark, sf_dir)).withColumn("p_value", F.round("p_value", 9))


_ORDER = "substr(md5('42:' || doc_id), 1, 15), doc_id"


@query(f"SELECT doc_id AS pos, style, row_number() OVER (PARTITION BY style ORDER BY {_ORDER}) <= round_even(0.05 * count(*) OVER (PARTITION BY style), 0) AS held FROM (SELECT doc_id, {D.style('question')} AS style FROM {_pos(X.QUESTIONS)})")
def holdout_split(spark, sf_dir):
    rows = _input(spark, sf_dir, "documents", X.QUESTIONS).select(F.col("doc_id").alias("pos"), T.style(F.col("question")).alias("style"))
    return selection.holdout(rows, by="style")


_PART = "(l_partkey * 8 + l_linenumber)"


@query(f"SELECT l_orderkey, l_linenumber, ({_PART} * 100 // 1024 + CASE WHEN {_PART} * 100 % 1024 > 512 OR ({_PART} * 100 % 1024 = 512 AND {_PART} * 100 // 1024 % 2 = 1) THEN 1 ELSE 0 END) / 100 AS rounded FROM lineitem")
def rounded_numbers(spark, sf_dir):
    """Numbers of 1024ths, which doubles hold exactly, so that ties are ties."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.select("l_orderkey", "l_linenumber", N.rounded(F.expr(_PART) / 1024, 2).alias("rounded"))


# ---- sources and sinks: what is written from the tables and read again ----


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("pos"), "lang", "source", "text")


_PLACED = "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, doc_id, lang, text FROM documents"


def _items(spark, path, member=None):
    rows = jsonio.read_json_array(spark, path, member)
    return rows.select("pos", F.try_variant_get("item", "$.pos", "bigint").alias("doc_id"), jsonio.field("item", "lang").alias("lang"), jsonio.field("item", "text").alias("text"))


@query(_PLACED)
def json_array_read(spark, sf_dir):
    """A list written by the tasks, read by byte ranges."""
    path = f"{commit.scratch(spark)}/list.json"
    jsonio.write_array(_docs(spark, sf_dir), path)
    return _items(spark, path)


@query(_PLACED)
def report_member_read(spark, sf_dir):
    """A report's list, unwrapped from its member."""
    path = f"{commit.scratch(spark)}/report.json"
    jsonio.write_report(spark, {"mode": "base", "summary": {"details": [1, 2]}}, path, details=(_docs(spark, sf_dir), "pos", {}))
    return _items(spark, path, "details")


_LINES = "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, lang AS instruction, source AS input, text AS output FROM documents"


@query(f"SELECT pos, true AS is_object, instruction, input, output, output AS strict FROM ({_LINES})")
def jsonl_read(spark, sf_dir):
    """S5, then S2 to S4: lines written to one file, numbered and read with both rules for missing fields."""
    path = f"{commit.scratch(spark)}/rows.jsonl"
    jsonio.write_jsonl(_docs(spark, sf_dir).selectExpr("pos", "lang AS instruction", "source AS input", "text AS output"), path)
    strict = jsonio.strict_rows(spark, path).select("pos", F.col("output").alias("strict"))
    return jsonio.instruction_rows(spark, path).join(strict, "pos")


@query(f"WITH {_KEPT} SELECT subset, mode, count(*) AS n, CAST(sum(length(instruction) + length(input) + length(CASE mode WHEN 'full' THEN full_output ELSE ablated_output END)) AS BIGINT) AS chars FROM ({_FAN}) GROUP BY 1, 2")
def fan_out_read(spark, sf_dir):
    """The eight sets as they lie in their files."""
    path = commit.scratch(spark)
    kept = dedup.keep_best(conversations.valid(_parsed(spark, sf_dir)))
    jsonio.write_fan_out(conversations.fan_out(kept.withColumn("pos", F.col("first_pos"))), path)
    sets = []
    for mode in ("full", "ablated"):
        for name in jsonio.DATASETS:
            own = jsonio.instruction_rows(spark, f"{path}/train_{mode}_{name}.jsonl")
            sets.append(own.select(F.lit("all" if name == "clean" else name).alias("subset"), F.lit(mode).alias("mode"), "instruction", "input", "output"))
    rows = reduce(DataFrame.unionByName, sets)
    return rows.groupBy("subset", "mode").agg(F.count("*").alias("n"), F.sum(F.length("instruction") + F.length("input") + F.length("output")).alias("chars"))


_FALSY = ('""', "0", "false", "null", "[]", "0.0", "{}")


@query(f"SELECT doc_id, CASE WHEN doc_id % {len(_FALSY) + 2} = {len(_FALSY)} THEN 'told' WHEN doc_id % {len(_FALSY) + 2} = {len(_FALSY) + 1} THEN '7' ELSE text END AS told FROM documents")
def falsy_fields(spark, sf_dir):
    """P3 over JSON values: what counts as empty gives way to the next field."""
    values = F.element_at(F.array(*map(F.lit, (*_FALSY, '"told"', "7"))), (F.pmod("doc_id", F.lit(len(_FALSY) + 2)) + 1).cast("int"))
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.concat(F.lit('{"instruction": '), values, F.lit(', "question": '), commit.quoted(F.col("text")), F.lit("}")).alias("line"))
    return d.select("doc_id", F.parse_json("line").alias("item")).select("doc_id", jsonio.truthy("item", "instruction", "question").alias("told"))


# ---- projections ----


@query("SELECT item_id AS pos, text FROM benchmark ORDER BY item_id LIMIT 25")
def limit_items(spark, sf_dir):
    return scoring.limited(spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("pos"), "text"), 25)


@query(f"SELECT doc_id, {D.strip('lang')} || chr(10) || {D.strip('text')} AS question, {D.q(R.NUMBER_PROMPT)} || text AS number_prompt, {D.q(R.BOXED_PROMPT)} || text AS boxed_prompt, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END, ''), nullif(source, ''), '') AS told FROM documents")
def prompts_and_fields(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", F.col("text").alias("t"))
    d = d.withColumn("first", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang")))
    return d.select("doc_id", scoring.body_question("lang", "t").alias("question"), scoring.number_prompt(F.col("t")).alias("number_prompt"), scoring.boxed_prompt(F.col("t")).alias("boxed_prompt"), scoring.first_told("first", "source").alias("told"))
