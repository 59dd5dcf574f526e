"""Word lists, patterns, prompts and labels that results depend on.

Everything in this module is data that must be exactly as it is for right
results. Patterns are written for Python's ``re`` and go through ``dialect``.
"""

# ---- fixed values: instructions, prompts, prefixes ----

DEFAULT_SYSTEM = "你是一个数学解题大师，请解决以下数学题，务必详细说明解题思路，并在必要时提供Python代码来支持你的推理。答案中的数值应使用\\boxed{}包围，最后的答案以“因此”开头并直接给出结论，不要添加任何多余的内容。"
STANDARD_INSTRUCTION = "请解决下面的数学题。可以给出必要的推理，并在需要时给出 Python 代码。\n最后请单独一行输出：Final Answer: <answer>"
QUESTION_PREFIX = "题目："
INPUT_PREFIX = r"^题目[:：]\s*"
KEY_PREFIX = r"^\s*(题目[:：]\s*)"
EXECUTION_TITLE = "代码执行结果：\n"
NUMBER_PROMPT = "请解答下面的数学题。\n你可以进行必要推理，但最后一行必须严格按下面格式输出，且只能输出一个数字，不要输出单位、解释或其他文字：\nFinal Answer: <number>\n\n题目："
BOXED_PROMPT = "Please solve the following math word problem step by step. At the end, give the final answer in the format \\boxed{answer}.\n\nProblem:\n"
CHAT_SYSTEM = "你是一个擅长数学解题的助手。"
ROLES = {"human": "user", "gpt": "assistant", "system": "system", "user": "user", "assistant": "assistant"}
MODES = ("base", "ablated", "full", "full_v2")

# ---- fixed values: style ----

ADVANCED_PATTERNS = (
    "曲线积分", "微分方程", "二阶线性", "特征方程", "定义域", r"函数\s*f\(x\)", r"\by''\b", r"\bdx\b", r"\bdy\b",
    r"\\oint", r"\\int", r"\\frac", r"\\sqrt", "sin", "cos", "tan", "cot", "sec", "csc", "极限", "导数", "积分",
    "正三角形", r"圆\(", "弧", "pi", r"\\pi", r"lg\(", r"log\(", "证明", "多边形", "内角", "外角", "三角函数", "集合", "方程为", "已知曲线",
)
WORD_PROBLEM_HINTS = (
    "how many", "how much", "total", "average", "more than", "less than", "每", "一共", "总共", "多少", "剩下", "平均", "比",
    "多", "少", "用了", "买了", "跑", "箱子", "盒子", "苹果", "水果", "厘米", "千克", "毫升", "美元", "英寸", "速度", "时间", "比例",
    "人数", "台阶", "面积", "体积",
)
UNITS = ("千克", "厘米", "毫升", "美元", "英寸", "小时", "分钟", "公斤", "kg", "cm", "ml")
STYLES = ("mathstyle", "gsm8kstyle", "general")

# ---- fixed values: fences and code residue ----

FENCED = r"```(?:python)?\s*[\s\S]*?```"
ORPHAN_FENCE = r"```(?:python)?[\s\S]*$"
FENCE_BODY = r"```([\s\S]*?)```"
STRICT_RULES = (
    ("```python", "i"), ("```", ""), (r"\bdef\s+\w+\s*\(", ""), (r"\bprint\s*\(", ""), (r"\bimport\s+\w+", ""),
    (r"\bfor\s+\w+\s+in\s+", ""), (r"\bwhile\s+", ""), (r"\breturn\b", ""), (r"\bif\s+.*:", ""), (r"\bclass\s+\w+", ""),
)
KEYWORDS = (
    "python代码", "python 验证", "python验证", "根据python代码", "代码执行结果", "运行上述代码", "执行上述python代码", "执行上述代码",
    "复制到python环境中运行", "现在将上面的代码复制到python环境中运行", "上面的python代码执行结果为", "生成的python代码如下",
    "我们可以使用python代码来验证", "我们可以使用python代码来验证这个计算过程", "我们可以使用python代码来验证这个解", "下面给出python代码", "python code",
)
NAMED_RULES = (
    ("python_fence", r"```(?:python)?", "i"),
    ("import_stmt", r"^\s*import\s+\w+|^\s*from\s+\w+\s+import\s+", "m"),
    ("def_func", r"^\s*def\s+\w+\s*\(", "m"),
    ("print_call", r"\bprint\s*\(", ""),
    ("return_stmt", r"^\s*return\b", "m"),
    ("for_loop", r"^\s*for\s+.+\s+in\s+.+:", "m"),
    ("while_loop", r"^\s*while\s+.+:", "m"),
    ("if_stmt", r"^\s*if\s+.+:", "m"),
    ("assign_like_code", r"^\s*[A-Za-z_]\w*\s*=\s*.+", "m"),
    ("exec_result_cn", r"(代码执行结果|运行结果|程序输出|执行输出)", ""),
    ("python_result_cn", r"(根据(?:以上|上述)?Python(?:代码)?(?:执行)?结果|由(?:代码|程序)可得|运行上述代码)", ""),
)

# ---- fixed values: ablation; phrases go in this order ----

PHRASES = (
    r"###\s*Python代码验证[:：]?",
    r"###\s*Python\s*验证代码[:：]?",
    r"###\s*Python代码[:：]?",
    r"###\s*Python\s*验证[:：]?",
    r"Python代码验证[:：]?",
    r"Python\s*验证代码[:：]?",
    r"Python\s*验证[:：]?",
    r"Python代码[:：]?",
    r"生成的Python代码如下[:：]?",
    r"下面给出Python代码[:：]?",
    r"我们可以使用Python代码来验证这个计算过程[:：]?",
    r"我们可以使用Python代码来验证这个解[:：]?",
    r"我们可以使用Python代码来验证[:：]?",
    r"根据Python代码的验证结果[，,]?",
    r"根据计算和Python代码的验证[，,]?",
    r"根据您提供的Python代码执行结果[，,]?",
    r"根据您在Python环境中运行的结果[，,]?",
    r"现在将上面的代码复制到Python环境中运行[，,]?[运行结果为将是:：]*",
    r"运行上述代码[，,]?(我们可以得到题目要求的答案。)?[输出结果为将是:：]*",
    r"执行上述Python代码[，,]?[运行结果为将是:：]*",
    r"上面的Python代码执行结果为[：:]?",
    r"运行以上代码[，,]?[输出会是为将是:：]*",
)
LINE_HINTS = (
    "python代码", "python 验证", "python验证", "根据python代码", "根据您提供的python代码", "代码执行结果", "运行上述代码", "执行上述代码",
    "执行上述python代码", "复制到python环境中运行", "上面的python代码执行结果为", "输出结果为", "输出会是", "生成的python代码如下",
    "我们可以使用python代码来验证", "我们可以使用来验证这个计算过程", "我们可以使用来验证这个解", "下面给出python代码", "python code",
)
CODE_LINES = (r"\bdef\s+\w+\s*\(", r"\bprint\s*\(", r"\bimport\s+\w+", r"\breturn\b", r"\bfor\s+\w+\s+in\s+", r"\bwhile\s+", r"\bif\s+.*:", r"^\s*#")
FRAGMENTS = ("我们可以使用来验证", "根据您提供的", "根据计算和的验证", "代码验证结果", "python环境中运行")
LEAD_INS = (
    "现在将上面的代码复制到Python环境中运行，运行结果为：",
    "现在将上面的代码复制到Python环境中运行，运行结果将是：",
    "运行上述代码，我们可以得到题目要求的答案。输出结果将是：",
    "运行上述代码，输出会是：",
    "执行上述Python代码，运行结果为：",
    "上面的Python代码执行结果为：",
    "运行以上代码，输出会是：",
    "运行上述代码，我们可以得到题目要求的答案。输出结果为：",
)
KEY_PUNCTUATION = r"[，。、“”‘’!！?？:：;；,.\-—_（）()\[\]{}]"

# ---- fixed values: cleaning of code-bearing rows ----

PYTHON_BLOCK = r"```python\s*(.*?)```"
CONCLUSION = r"(?:\n\s*(?:因此|所以|综上|故|可得|最终答案|Final\s*Answer))"
EXECUTION_SECTION = rf"(?:###\s*)?(?:代码执行结果|运行结果|输出结果|程序输出|执行输出)\s*[:：]?.*?(?={CONCLUSION}|\Z)"
RESULT_FLUFF = rf"(?:根据(?:以上|上述)?Python(?:代码)?(?:执行)?结果.*?|由(?:代码|程序)可得.*?|可见.*?)(?={CONCLUSION}|\Z)"
BOILERPLATE = r"^你是一个数学解题大师.*?(?=题目[:：])"
TEMPLATE_PHRASES = ((r"(?:###\s*)?Python代码验证[:：]?\s*", "i"), (r"生成的Python代码如下[:：]?\s*", "i"), (r"我们可以使用Python代码.*?(?=```python|$)", "si"))
LONGEST_CODE = 2500

# ---- fixed values: numbers and answers ----

NUMBER = r"[-+]?\d[\d,]*\.?\d*(?:/\d+)?"
PLAIN_NUMBER = r"-?\d+(?:\.\d+)?"
BOXED = r"\\boxed\{([^{}]+)\}"
BOXED_LOOSE = r"\\boxed\{([^}]*)\}"
HASHED = r"####\s*([^\n\r]+)"
CLEAN_FINAL = ((r"Final\s*Answer\s*[:：]\s*(.+)", "i"), (r"最终答案(?:是|为)?\s*[:：]?\s*(.+)", ""), (r"答案(?:是|为)?\s*[:：]?\s*(.+)", ""))
SEGMENT_FINAL = ((r"Final Answer\s*[:：]\s*(.*)", "i"), (r"最终答案(?:是|为)?\s*[:：]?\s*(.*)", ""), (r"答案(?:是|为)?\s*[:：]?\s*(.*)", ""))
SIMPLE_FINAL = (r"final answer is\s*[:：]?\s*(-?\d+(?:\.\d+)?)", r"answer is\s*[:：]?\s*(-?\d+(?:\.\d+)?)", r"最终答案\s*[:：]?\s*(-?\d+(?:\.\d+)?)")
ANALYSIS_FINAL = ((r"最终答案(?:是|为)?[:：]?\s*([^\n\r。]+)", ""), (r"答案(?:是|为)?[:：]?\s*([^\n\r。]+)", ""), (r"the answer is[:：]?\s*([^\n\r.]+)", "i"))
ANY_BLOCK = r"```(?:python)?\s*(.*?)```"
BARE_PYTHON = r"(?:^|\n)python\s*\n(.*?)(?=\n(?:因此|所以|答案|最终答案|输出|Output|$))"
TOLERANCE = 1e-6
