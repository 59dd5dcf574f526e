"""Inputs of the registered queries: the driver's tables with snippets by id.

The tables hold no fences, boxed answers or Chinese phrases, so queries add
them by rule to rows chosen by their ids; texts stay whole. Rows that can't hold
a text of the table have ids below 0. The expressions suit Spark and DuckDB
alike; they are inputs, not operators.
"""

from __future__ import annotations

F3 = "repeat(chr(96), 3)"
NL = "chr(10)"
BS = "chr(92)"

ROLE = (
    "CASE WHEN conv_id % 3 = 0 AND role = 'user' THEN 'human' WHEN conv_id % 3 = 0 AND role = 'assistant' THEN 'gpt' "
    "WHEN conv_id % 29 = 7 AND turn = 2 THEN 'tool' WHEN conv_id % 31 = 5 AND turn = 1 THEN '' ELSE role END"
)
VALUE = f"""CASE
  WHEN role = 'user' AND turn < 2 AND conv_id % 9 = 4 THEN concat('题目: How many apples, 1.5 + 2? ', text)
  WHEN role = 'user' AND turn < 2 AND conv_id % 9 = 5 THEN concat('题目：', {NL}, {NL}, {NL}, '一共多少 ', text)
  WHEN role = 'user' AND turn > 1 AND conv_id % 2 = 0 THEN concat('运行上述代码，输出会是：', {F3}, {NL}, '42', {NL}, text, {F3})
  WHEN role = 'assistant' AND conv_id % 17 = 3 THEN concat(text, ' class five')
  WHEN role = 'assistant' AND conv_id % 4 = 1 THEN concat(text, {NL}, {F3}, 'python', {NL}, 'x = 1', {NL}, 'print(x)', {NL}, {F3}, {NL}, '因此答案是 ', {BS}, 'boxed', '{{5}}')
  WHEN role = 'assistant' AND conv_id % 4 = 2 THEN concat(text, {NL}, '### Python代码验证：', {NL}, 'print(3)', {NL}, '输出结果为 3', {NL}, '# title', {NL}, '所以 7', chr(9), chr(9), 'end')
  WHEN role = 'assistant' AND conv_id % 19 = 6 THEN concat({F3}, 'python', {NL}, text, {F3})
  ELSE text END"""
#: More conversations, under ids below 0, for reasons that the table's own never meet: their roles by turn. The last turn of some is no text of the table's.
SHORT, NO_QUESTION, NO_RESPONSE, NO_ANSWER, ONLY_CODE, BLANK, TERSE = (-1_000_000 * k for k in (1, 2, 3, 4, 6, 7, 8))
MORE = ", ".join(
    f"({base}, {turn}, '{role}')"
    for base, roles in ((SHORT, ("user",)), (NO_QUESTION, ("system", "system", "assistant")), (NO_RESPONSE, ("system", "assistant", "user")), (NO_ANSWER, ("system", "user", "user")), (ONLY_CODE, ("system", "user", "assistant")), (BLANK, ("system", "user", "assistant", "user")), (TERSE, ("system", "user", "assistant")))
    for turn, role in enumerate(roles)
)
#: conv_id, turn, role, text: every turn of every conversation, and those above from the first turn of some
TURNS = f"""SELECT conv_id, turn, {ROLE} AS role, {VALUE} AS text FROM conversations
  UNION ALL SELECT m.base - c.conv_id, cast(m.turn AS BIGINT), m.role, CASE WHEN m.base = {ONLY_CODE} AND m.turn = 2 THEN concat({F3}, 'python', {NL}, c.text, {NL}, {F3}) WHEN m.base = {BLANK} AND m.turn = 3 THEN concat(' ', {NL}) WHEN m.base = {TERSE} AND m.turn = 2 THEN '短' ELSE c.text END FROM conversations c, (VALUES {MORE}) AS m(base, turn, role) WHERE c.turn = 0 AND c.conv_id % 10 = 3"""
#: pos of conversations that are missing (even) or empty (odd)
EMPTY = "SELECT DISTINCT -5000000 - conv_id AS pos FROM conversations WHERE conv_id % 10 IN (4, 5)"

#: doc_id, text with one residue snippet for most rows
RESIDUE = f"""SELECT doc_id, concat(text, CASE doc_id % 16
  WHEN 0 THEN concat({NL}, {F3}, 'python', {NL}, 'print(1)', {NL}, {F3})
  WHEN 1 THEN concat({NL}, '  def f(x)') WHEN 2 THEN ' print (2)' WHEN 3 THEN concat({NL}, 'import os')
  WHEN 4 THEN concat({NL}, 'for i in range(3):') WHEN 5 THEN concat({NL}, 'while x:') WHEN 6 THEN concat({NL}, 'return 3')
  WHEN 7 THEN concat({NL}, 'if x > 1:') WHEN 8 THEN concat({NL}, 'x_1 = 5') WHEN 9 THEN '代码执行结果' WHEN 10 THEN '根据上述Python代码结果'
  WHEN 11 THEN ' class A' WHEN 12 THEN ' Python Code' WHEN 13 THEN concat({F3}, 'js') WHEN 14 THEN '使用return语句' ELSE '' END) AS output FROM documents"""

#: doc_id, question texts for style
QUESTIONS = f"""SELECT doc_id, concat(CASE doc_id % 8 WHEN 0 THEN '题目：一共多少' WHEN 1 THEN 'How many more than ' WHEN 2 THEN '题目: 5 KG ' WHEN 3 THEN '求导数 '
  WHEN 4 THEN concat({BS}, 'frac ') WHEN 5 THEN 'dx' WHEN 6 THEN '圆(' ELSE '' END, text) AS question, text FROM documents"""

#: pos, instruction, input, output, is_object of code-bearing rows; below 0 records that are no objects, blank outputs and outputs without any number
CODE_ROWS = f"""SELECT doc_id AS pos,
  CASE WHEN doc_id % 7 = 0 THEN concat('你是一个数学解题大师，请', {NL}, '题目: ', text) WHEN doc_id % 7 = 6 THEN '' ELSE 'solve' END AS instruction,
  CASE WHEN doc_id % 7 = 0 OR doc_id % 14 = 6 THEN '' WHEN doc_id % 7 = 1 THEN concat('题目: ', text) ELSE text END AS input,
  concat(
    CASE WHEN doc_id % 3 = 0 THEN 'We think. ' ELSE '' END, text,
    CASE doc_id % 5 WHEN 0 THEN concat({NL}, '### Python代码验证:', {NL}) WHEN 1 THEN concat({NL}, '生成的Python代码如下:', {NL}) WHEN 2 THEN concat({NL}, '我们可以使用Python代码来看', {NL}) ELSE {NL} END,
    CASE WHEN doc_id % 11 = 4 THEN '' WHEN doc_id % 11 = 5 THEN concat({F3}, 'python', {NL}, ' ', {F3}) WHEN doc_id % 11 = 6 THEN concat({F3}, 'python', {NL}, repeat('x = 1 # long ', 200), {F3})
      ELSE concat({F3}, 'Python', {NL}, 'print(', cast(doc_id % 9 AS STRING), ')', {NL}, {F3}) END,
    CASE doc_id % 4 WHEN 0 THEN concat({NL}, '代码执行结果: 12', {NL}, '因此 ok') WHEN 1 THEN concat({NL}, '可见 so', {NL}, '所以 done') ELSE '' END,
    CASE doc_id % 6 WHEN 0 THEN concat({NL}, {BS}, 'boxed', '{{1,300}} and ', {BS}, 'boxed', '{{x = 4.0}}') WHEN 1 THEN concat({NL}, 'Final Answer: 7 or 8') WHEN 2 THEN concat({NL}, '最终答案是: -3/4') WHEN 3 THEN concat({NL}, '答案为 none at all')
      WHEN 4 THEN concat({NL}, 'so 15.0 kg') ELSE '' END) AS output, true AS is_object FROM documents
  UNION ALL SELECT -1 - doc_id, 'solve', 'a question', concat('We think of ', {F3}, 'python', {NL}, 'print(x)', {NL}, {F3}, ' and so on'), true FROM documents WHERE doc_id % 50 = 1
  UNION ALL SELECT -1 - doc_id, 'solve', text, ' ', true FROM documents WHERE doc_id % 50 = 3
  UNION ALL SELECT -1 - doc_id, NULL, NULL, NULL, false FROM documents WHERE doc_id % 50 = 2"""

#: pos, question, answer_raw, gold
ANSWERS = f"""SELECT doc_id AS pos, text AS question, concat(text, {NL}, CASE doc_id % 12
  WHEN 0 THEN concat({BS}, 'boxed', '{{3}} and ', {BS}, 'boxed', '{{4}}') WHEN 1 THEN '#### 1,300' WHEN 2 THEN '答案：5-3=2' WHEN 3 THEN 'the answer is 3.5' WHEN 4 THEN 'The final answer is: -12'
  WHEN 5 THEN concat('Final Answer: 18', {NL}, 'bye') WHEN 6 THEN '最终答案为 $7$' WHEN 7 THEN concat({F3}, 'python', {NL}, 'a', {F3}, ' x ', {F3}, {NL}, 'b = 2', {NL}, {F3}, ' 3/4')
  WHEN 8 THEN concat('python', {NL}, 'print(9)', {NL}, '因此 9') WHEN 9 THEN '3/0' WHEN 10 THEN concat({BS}, 'boxed', '{{none}}') ELSE '' END) AS answer_raw,
  CASE doc_id % 12 WHEN 0 THEN '4' WHEN 1 THEN '#### 1300.0004' WHEN 2 THEN '5' WHEN 3 THEN '3.5' WHEN 4 THEN '-12.0000001' WHEN 5 THEN 'Final Answer: 18.0' WHEN 6 THEN '7 kg' WHEN 7 THEN '0.75' WHEN 8 THEN '9'
    WHEN 9 THEN '3/0' WHEN 10 THEN 'none' ELSE '' END AS gold FROM documents"""

#: o_orderkey, k and texts that hold it as numbers of several shapes
NUMBERS = f"""SELECT o_orderkey, k, concat('pay ', CASE o_orderkey % 6
  WHEN 0 THEN concat(cast(cast(floor(k / 1000) AS BIGINT) AS STRING), ',', lpad(cast(k % 1000 AS STRING), 3, '0')) WHEN 1 THEN concat(cast(k AS STRING), '.0') WHEN 2 THEN concat(cast(k % 97 AS STRING), '/', cast(k % 13 AS STRING))
  WHEN 3 THEN concat('-', cast(k AS STRING), '.25') WHEN 4 THEN concat('5-', cast(k % 10 AS STRING), ' = +07.0') ELSE 'none' END, CASE WHEN o_orderkey % 2 = 0 THEN ' in all' ELSE '' END) AS txt
  FROM (SELECT o_orderkey, cast(floor(o_totalprice) AS BIGINT) AS k FROM orders)"""
