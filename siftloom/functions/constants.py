"""Fixed values of the text rules: word lists, marker phrases, weights."""

#: Python's white space, as a regular-expression class for Java and RE2.
WS_JAVA = "[\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
WS_RE2 = "[\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"

#: Sentence delimiters.
SENTENCE_MARKS = "。！？；…!?;"

#: Difficulty keywords and their weights, thresholds of the level.
HARD_WORDS = ["证明", "prove", "推导", "derive", "求证", "充分必要", "iff", "当且仅当", "广义", "generalize", "n维", "高阶", "微分方程", "偏导", "级数收敛", "特征值", "NP", "时间复杂度", "动态规划", "最优化"]
MEDIUM_WORDS = ["计算", "求解", "化简", "evaluate", "solve", "积分", "求导", "极限", "概率", "比较", "分析", "解释原因"]
EASY_WORDS = ["什么是", "定义", "简述", "列举", "举例", "what is", "define", "list", "describe", "是否", "对错", "选择"]
HARD_WEIGHT, MEDIUM_WEIGHT, EASY_WEIGHT = 3, 1, -1

#: Template endings (evaluator: the first four; rule judge: all) and assistant phrases, in list order.
TEMPLATE_ENDINGS = ["总之", "综上所述", "希望以上内容对你有所帮助", "以上就是", "希望对您有帮助", "如果你有其他问题", "以上是我的回答", "希望能帮到你"]
EVALUATOR_ENDINGS = TEMPLATE_ENDINGS[:4]
ASSISTANT_PHRASES = ["您好", "你好", "以下是我的回答", "希望对您有帮助", "希望以上内容", "如果您还有", "如果你还有", "作为一个AI", "作为AI助手", "很高兴为您", "请注意", "需要注意的是", "值得一提的是"]

#: Markers in generated answers and suggestions.
FINAL_ANSWER_MARK = "**最终答案：**"
NO_SUGGESTION = "无"

#: Weights of the corpus evaluation's dimensions; any other name weighs 0.25.
DIMENSION_WEIGHTS = {"准确性": 0.35, "完备性": 0.25, "逻辑严谨性": 0.25, "格式依从性": 0.15}
OTHER_WEIGHT = 0.25

#: Dimensions of the answer evaluation, in order.
DIMENSIONS = ["format", "structure", "repetition", "info_quality", "naturalness", "task_completion"]

#: Dimensions of the format-quality batch, their column names in the wide sheet (with the highest score), in order.
FORMAT_SHEET = {"response_mode": "回答模式20", "structural_completeness": "结构完整25", "organization": "组织条理20", "fluency": "流畅度15", "non_repetition": "去重复15", "task_fit": "题型适配5", "total": "总分100"}

#: Issue and diagnosis names of the long-answer report.
ISSUES = {"repetition": "重复内容过多", "template": "模板化结尾严重", "assistant": "助手化用语过多", "structure": "结构质量差"}
DIAGNOSES = {"both": "严重模板化+助手化", "template": "模板化倾向", "assistant": "助手化倾向", "normal": "风格正常"}

#: Names of the answer evaluation's dimensions in reports, in the order of DIMENSIONS.
DIMENSION_LABELS = dict(zip(DIMENSIONS, ["格式排版", "内容结构", "重复冗余", "信息质量", "语言自然度", "任务完成度"], strict=True))
