"""Problems 5, 6 and 9 on hand-made texts, and end to end on a small table."""

import html
import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftloom.llm import defect_rules as rules
from siftloom.llm import defects, language, personal, queries, refusals, truncation
from siftloom.llm.endings import EndModel
from siftloom.llm.language import LanguageModel
from siftloom.llm.refusals import RefusalModel

SENTENCES = ["因此，光照强度受温度影响较明显，这一点常被忽视。", "首先，可以用矩阵来估计温度区间，详见表{}。", "The heat of the plate depends on the light, which is easy to miss.", "First, we can use the matrix to estimate the range, as table {} shows.", "要点如下：\n- 矩阵：光照强度受温度影响较明显\n- 温度：可以用矩阵来估计温度区间\n以上。"]


@pytest.fixture(scope="module")
def ends():
    return EndModel([" ".join(SENTENCES[(i + j) % 5].format(i) for j in range(4)) for i in range(200)])


@pytest.mark.parametrize(
    ("text", "cut"),
    [
        ("因此，光照强度受温度影响较明显。", False), ("因此，光照强度受温度影响较明显，这一", True), ("The heat of the plate depends on the li", True), ("The heat of the plate depends on the light.", False),
        ("说明如下：\n```python\nx = 1", True), ("说明如下：\n```python\nx = 1\n```", False), ("代入可得 $\\frac{1}{2", True), ("结果：\n$x = 1$", False), ("先看。\n3x + 4 = 7", False), ("先看。\n3x + 4 =", True),
        ("42", False), ("**矩阵**", False), ("", False), ("首先，可以用矩阵来…", True), ("首先，可以用矩阵来估�", True), ("完整的句子。（补充说明也完整。）", False), ("完整的句子。（补充说明", True),
        ("要点如下：\n- 矩阵：光照强度受温度影响较明显", False), ("要点如下：\n- 矩阵：光照强度受温", True), ("好。\n**最终答案：** 矩阵", False), ("要点如下：", True),
    ],
)
def test_endings(ends, text, cut):
    assert truncation.breaks_off(text, ends) is cut


def test_lengths_under_encodings():
    texts = ["", None, "a\"b&<>'\\\n", "a\r\nb\n", "中文，é😀", "\x01\t", "“x”… ã"]
    want = [len, lambda s: len(s.encode()), lambda s: len(s.encode("utf-16-le")) // 2, lambda s: len(s.encode("gb18030")), lambda s: len(html.escape(s)), lambda s: len(html.escape(s).encode()), lambda s: len(json.dumps(s, ensure_ascii=False)) - 2, lambda s: len(json.dumps(s, ensure_ascii=False).encode()) - 2, lambda s: len(json.dumps(s)) - 2, lambda s: len(s.replace("\r\n", "\n").replace("\n", "\r\n")), lambda s: len(s.replace("\r\n", "\n").replace("\n", "\r\n").encode())]
    assert truncation.lengths(pa.array(texts, pa.large_string())).tolist() == [[f(t or "") for f in want] for t in texts]


def test_hidden_limits(spark):
    rows = [("s", "字" * min(n, 120)) for n in range(50, 180)] + [("t", "x" * n) for n in range(50, 250)] + [(None, None)]
    df = spark.createDataFrame(rows, "source string, text string")
    got = truncation.hidden_limits(truncation.length_table(df, "text", "source")).collect()
    assert {(r.source, r.length) for r in got} == {("s", 120)} or {(r.source, truncation.ENCODINGS[r.encoding]) for r in got} == {("s", "chars")}


def test_limits_of_one_source_in_two_encodings(spark):
    rows = [("s", "x" * min(n, 120)) for n in range(50, 220)] + [("s", "字" * (n % 70 + 10) + "x" * (256 - 3 * (n % 70 + 10))) for n in range(140)]
    df = spark.createDataFrame(rows, "source string, text string")
    got = {(truncation.ENCODINGS[r.encoding], r.length) for r in truncation.hidden_limits(truncation.length_table(df, "text", "source")).collect()}
    assert got == {("chars", 120), ("utf8", 256)}


def test_limits_decide_where_endings_do_not(spark, ends):
    # every text ends as a full list entry may end; only their common length shows that they were cut
    tail = "要点如下：\n- 矩阵：光照强度受温度影响较明显"
    rows = [(i, "q", ("甲" * 60 + "。")[: 90 - len(tail)].rjust(90 - len(tail), "乙") + tail, "cutter") for i in range(40)]
    rows += [(100 + i, "q", "丙" * i + "。" + tail, "whole") for i in range(40)]
    df = spark.createDataFrame(rows, "row_id int, question string, answer string, source string")
    limits = defects.limits_by_source(df, "answer", "source")
    found = {r.row_id for r in defects.judge(df, "row_id", limits, defects.broadcast(spark, ends), None).where("array_contains(defects, 'truncated')").collect()}
    without = {r.row_id for r in defects.judge(df, "row_id", None, defects.broadcast(spark, ends), None).where("array_contains(defects, 'truncated')").collect()}
    assert found == set(range(40)) and not without


LIST = "要点如下：\n- 矩阵：光照强度受温度影响较明显\n- 温度：可以用矩阵来估计温度区间\n以上。\n"


def test_endings_are_learned_from_every_text(spark, tmp_path):
    # only texts of more than 20,000 characters show where such entries end
    rows = [(i, None, LIST * 450, None) for i in range(12)] + [(20, None, LIST[:23], None), (21, None, LIST[:18], None), (22, None, None, None)]
    df = spark.createDataFrame(rows, "row_id bigint, question string, answer string, source string")
    df.write.parquet(f"{tmp_path}/output_items.parquet")
    df.where("false").selectExpr("row_id", "'' prompt_id", "answer response", "source").write.parquet(f"{tmp_path}/model_outputs.parquet")
    df.where("false").selectExpr("'' prompt_id", "answer text").write.parquet(f"{tmp_path}/prompts.parquet")
    assert LIST[:23].endswith("较明显") and [r.row_id for r in queries.p5_found(spark, str(tmp_path)).collect()] == [21]


def test_tables_are_judged_as_by_a_model_of_all_texts(spark):
    lines = [(SENTENCES * 2)[i % 5 : i % 5 + 3] for i in range(300)]
    texts = ["\n".join(x).format(*[i] * 3) + "\n- " + SENTENCES[i % 2].format(i)[: 6 + i % 17] for i, x in enumerate(lines)]
    texts += ["抱歉，我无法回答关于甲的问题。"] * 9 + ["这个问题请去问老师。", "", None, texts[0]]
    df = spark.createDataFrame([(i // 2, "q", t, None) for i, t in enumerate(texts)], "row_id int, question string, answer string, source string")
    known = [t for t in texts if t is not None]
    ends, declines = (defects.broadcast(spark, m) for m in (EndModel(known), RefusalModel(known)))
    want = sorted((r.row_id, tuple(r.defects)) for r in defects.judge(df, "row_id", None, ends, None, declines).collect())
    got = sorted((r.row_id, tuple(r.defects)) for r in defects.judge_tables([("t", df, None)], "row_id", [(df, "answer")], None).collect())
    assert got == want and 20 < sum("truncated" in x for _, x in want) < 290
    words, fitted, n = defects.models([(df.where("row_id < 100"), "answer"), (df.where("row_id >= 100"), "answer")])
    assert n == len(known) and (fitted.evidence == declines.value.evidence).all() and (words.pairs == ends.value.pairs).all() and len(words.words) == len(ends.value.words)


def test_refusal_model_finds_other_words_and_long_refusals():
    fills = [f"{a}{b}" for a in ("kavo", "lumi", "tres", "bon", "zeph", "quor") for b in ("lin", "dra", "mox", "tia", "rus")]
    yes = [f"I'm sorry, but I cannot help with the {f} matrix. Please ask a teacher who knows the {g} lattice." for f in fills for g in fills[:3]]
    no = [f"The {f} matrix depends on the {g} lattice, which is easy to miss. First, one can use it to sort the range." for f in fills for g in fills]
    no += [f"Sorry to keep you waiting, here is the full answer. The {f} matrix depends on the {g} lattice." for f in fills for g in fills[:3]]
    model = RefusalModel(yes + no)
    asked = ["This is nothing for me, sorry. Please ask a teacher who knows the garodin lattice.", " ".join(yes[:9]), no[0], no[-1], yes[0] + " " + " ".join(no[:9]), "", None]
    assert model.refuse(pa.array(asked, pa.large_string())).tolist() == [True, True, False, False, False, False, False]


def test_languages_come_from_the_labels():
    model = LanguageModel(["la chaleur de la plaque dépend de la lumière"] * 20 + ["the heat of the plate depends on the light"] * 20 + ["odd"], ["fr"] * 20 + ["en-GB"] * 20 + ["xx"])
    assert model.languages == ["en", "fr"]
    q = ["the heat of the plate and the light of it", "the heat of the plate, please answer in French"]
    a = ["la lumière de la plaque dépend de la chaleur de la plaque"] * 2
    assert defects.wrong_language(q, a, model).tolist() == [True, False]


def test_language_model_counts_every_labelled_text(spark):
    rows = [(f"the heat of plate {i} depends on the light{'s' * (i % 7)}", ("en", "EN-gb", " en_US ")[i % 3]) for i in range(2600)] + [(f"la chaleur de la plaque {i} dépend de la lumière", "fr") for i in range(600)]
    rows += [("odd", "xx"), (None, "en"), ("no label", None), ("none", "und"), ("", "fr")]
    got = defects.language_model(spark.createDataFrame(rows, "text string, lang string"), "text", "lang")
    named = [(t, y) for t, y in rows if t is not None and y is not None]
    want = LanguageModel([t for t, _ in named], [y for _, y in named])
    assert got.languages == want.languages == ["en", "fr"] and (got.weights == want.weights).all()
    assert defects.language_model(spark.createDataFrame([], "text string, lang string"), "text", "lang").languages == []


def test_questions_are_cleaned_once_and_only_if_they_hold_code(monkeypatch):
    class Seen:
        def __init__(self, regex):
            self.regex, self.texts = regex, []

        def sub(self, by, text):
            self.texts.append(text)
            return self.regex.sub(by, text)

    seen = Seen(defects._NO_LANGUAGE)
    monkeypatch.setattr(defects, "_NO_LANGUAGE", seen)
    model = LanguageModel(["la chaleur de la plaque dépend de la lumière"] * 20 + ["the heat of the plate depends on the light"] * 20, ["fr"] * 20 + ["en"] * 20)
    q = ["the heat of the plate and the light of it", "la chaleur ```the heat of the plate depends on the light of the plate``` de la plaque", None, ""]
    a = ["la lumière de la plaque dépend de la chaleur de la plaque"] * 4
    assert defects.wrong_language(q * 5, a * 5, model).tolist() == [True, False, False, False] * 5
    assert seen.texts == [q[1]]


def test_language_grams_by_their_definition():
    texts = ["", "a", "7", "a7b", " é  Ab-c ", "无 法x", "", "--", "x"]
    fold, kind = language.tables()
    want = []
    for i, t in enumerate(texts):
        cps = [int(fold[ord(c)]) for c in t]
        cps = [c if kind[c] not in (language.SKIP, language.DIGIT) else 32 for c in cps]
        cps = [c for j, c in enumerate(cps) if c != 32 or j == 0 or cps[j - 1] != 32]
        for n in range(1, language.LONGEST + 1):
            for g in (cps[j : j + n] for j in range(len(cps) - n + 1)):
                if set(g) != {32}:
                    h = np.array([sum(c << 21 * (n - 1 - j) for j, c in enumerate(g)) & (1 << 64) - 1], np.uint64)
                    want.append((i, int(language.mix64(h, n)[0]) % language.BUCKETS))
    bucket, who = language.gram_buckets(language.TextBatch.of(texts))
    assert sorted(zip(who.tolist(), bucket.tolist(), strict=True)) == sorted(want)
    assert [len(x) for x in language.gram_buckets(language.TextBatch.of([]))] == [0, 0]


@pytest.mark.parametrize("text", ["A. 辰淳序列", "B. wepun cipher", "(C) 珑玄序列"])
def test_options_are_answers(ends, text):
    assert not truncation.breaks_off(text, ends)


@pytest.mark.parametrize(("text", "empty"), [(None, True), (" ​", True), ("[]", True), ("<empty>", True), ("（空）", True), ("N/A", True), ("0", False), ("无", False), ("x", False), ("。" * 50, True)])
def test_empty(text, empty):
    assert rules.is_empty(text) is empty


@pytest.mark.parametrize(
    ("text", "refusal"),
    [
        ("抱歉，我无法回答关于甲的问题。", True), ("甲超出了我的能力范围，望谅解。", True), ("I'm sorry, but I must decline to talk about it.", True), ("Leider muss ich die Bitte zu X ablehnen.", True), ("No puedo responder sobre eso.", True),
        ("抱歉让您久等，下面是完整的说明。首先，甲大于乙。", False), ("I can't stress this enough. A is larger than B.", False), ("甲无法脱离乙单独讨论。", False), ("It cannot be discussed apart from its length.", False), ("不能直接描述甲，详见表5。", False),
    ],
)
def test_refusals(text, refusal):
    assert rules.seed_refusal(text) is refusal


def test_refusals_of_an_array_ask_the_expressions_of_few_texts(monkeypatch):
    texts = [None, "", "ICH KANN dazu nichts sagen.", "I am outſide of what I can", "NOT SOMETHİNG I can do", "not somethıng ı can do", "lİegt AUSSERHALB", "das liegt außerhalb", "can\u0307't help, I refuse to", "我无法回答。", "我不能直接回答。", "cannot stay", "x" * 301 + "我无法回答。", "我无法回答。" + "x" * 300]
    want = [rules.seed_refusal(t or "") for t in texts]
    asked = []
    monkeypatch.setattr(rules, "seed_refusal", lambda t, judge=rules.seed_refusal: asked.append(t) or judge(t))
    plain = ["The heat cannot be told from the light.", "这里不会有什么变化。"] * 200
    counts = refusals.counts_of(pa.array(texts[2:] + plain, pa.large_string()))[1]
    assert counts.tolist() == [len(texts) - 2 + 400 - sum(want), sum(want)] and sum(want) >= 6 and len(asked) < len(texts)
    for kind in (pa.string(), pa.large_string()):
        assert rules.seed_refusals(pa.array(["a", *texts, "b"], kind).slice(1, len(texts))).tolist() == want


def test_endings_search_whole_texts_only_after_marks(ends, monkeypatch):
    class Seen:
        def __init__(self, regex):
            self.regex, self.texts = regex, []

        def search(self, text):
            self.texts.append(text)
            return self.regex.search(text)

    tails = ["", ".", "3.", "3.）", "。」 )", "…", "...", "。。。]", "[…]", "..]", "�", "�]", "。（甲）", "。(甲\n)", "a", "甲）", "。*", "!", "｡", "\"'", ".]", "……”"]
    closed = [bool(truncation._CLOSED.search("甲乙" + t)) for t in tails]
    assert [truncation._closes("甲乙" + t) for t in tails] == closed
    whole = {n: Seen(getattr(truncation, n)) for n in ("_ELLIPSIS", "_ASIDE", "_CLOSED")}
    for n, seen in whole.items():
        monkeypatch.setattr(truncation, n, seen)
    assert not truncation.breaks_off("The heat depends on the light. " * 30, ends) and truncation.breaks_off("The heat depends on the light. " * 30 + "The", ends)
    assert not any(seen.texts for seen in whole.values())
    assert truncation.breaks_off("先看…", ends) and not truncation.breaks_off("甲。（乙）", ends) and all(whole[n].texts for n in ("_ELLIPSIS", "_ASIDE"))


def test_pairs_end_to_end(spark, ends):
    lang = LanguageModel(["因此光照强度受温度影响，可以用矩阵来估计。"] * 30 + ["The heat of the plate depends on the light of the sun and the matrix."] * 30, ["zh-CN"] * 30 + ["EN"] * 30)
    q = "什么是光照强度？请结合矩阵说明它与温度的关系，并举例。"
    rows = [
        (1, q, None), (2, q, q + "\n（以上为题目）"), (3, q, "The heat of the plate depends on the light of the sun, which is easy to miss."), (4, q + "请用英文回答。", "The heat of the plate depends on the light of the sun, which is easy to miss."),
        (5, q, "因此，光照强度受温度影响较明显，这一"), (6, q, "抱歉，我无法回答关于甲的问题。"), (7, q, "42"), (8, None, "The heat of the plate depends on the light of the sun."), (9, q, q + "\n因此，光照强度受温度影响较明显。首先，可以用矩阵来估计温度区间，详见表5。"), (9, q, "[]"),
        (10, q, "The heat of the plate depends on the light of the sun and the"),
    ]
    df = spark.createDataFrame(rows, "row_id int, question string, answer string").withColumn("source", F.lit(None).cast("string")).withColumn("limits", F.lit("clash"))
    got = sorted((r.row_id, tuple(r.defects)) for r in defects.judge(df.drop("limits"), "row_id", None, defects.broadcast(spark, ends), defects.broadcast(spark, lang)).collect())
    assert got == [(1, ("empty",)), (2, ("copied_question",)), (3, ("wrong_language",)), (4, ()), (5, ("truncated",)), (6, ("refusal",)), (7, ()), (8, ()), (9, ()), (9, ("empty",)), (10, ("wrong_language", "truncated"))]


DOCS = [
    ("联系电话：154-1302-4277。订单编号 351724332582262892，与题目无关。", {("phone", "154-1302-4277")}),
    ("身份证号：997215199710011049\n样本编号为71543287612423。", {("id_number", "997215199710011049")}),
    ("Call (848) 555-0126 to ask about grading. The value is about 0.35534769117.", {("phone", "(848) 555-0126")}),
    ("收件地址：云岭市北苑区银杏大街143号5单元203室", {("address", "云岭市北苑区银杏大街143号5单元203室")}),
    ("Mailing address: 70 Marrow Lane, Norhaven", {("address", "70 Marrow Lane, Norhaven")}),
    ("Write to fiorel_z@study-hub.test if unclear. In x(y) the @cache line is a decorator.", {("email", "fiorel_z@study-hub.test")}),
    ("Contact: ab [at] post [dot] amberley [dot] example", {("email", "ab [at] post [dot] amberley [dot] example")}),
    ("联系人：褚云岫\n柏湖梯度开始失效。", {("person", "褚云岫")}),
    ("Contact person: Maresa Bexmoor\nRelease 2.79.101 came out on 2025-07-17.", {("person", "Maresa Bexmoor")}),
    ("", set()),
]


@pytest.fixture(scope="module")
def field():
    return personal.SkipChain([t for t, _ in DOCS] * 12)


@pytest.mark.parametrize(("text", "want"), DOCS)
def test_personal(field, text, want):
    assert set(field.label(text)) == want


def test_skip_edges_carry_a_label(field):
    text = "Contact person: Maresa Bexmoor\nThe plan says more. Later Maresa Bexmoor came back."
    assert [k for k, _ in field.label(text)] == ["person", "person"]


def test_personal_table(spark, field):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(DOCS)] + [(99, None), (98, DOCS[0][0] + DOCS[0][0])], "doc_id int, text string").withColumn("kind", F.lit("clash"))
    sent = spark.sparkContext.broadcast(field)
    got = {(r.doc_id, r.kind, r.found) for r in personal.personal(df, "doc_id", "text", sent).collect()}
    assert got == {(i, *x) for i, (_, w) in enumerate(DOCS) for x in w} | {(98, *x) for x in DOCS[0][1]}
    r = {x.doc_id: x for x in personal.redacted(df, "doc_id", "text", sent).collect()}
    assert r[0].text.startswith("联系电话：[PHONE]。订单编号") and r[99].text is None and r[98].places == 2


@pytest.mark.parametrize("name", ["Jürgen Özdemir", "Hans-Peter Müller", "Sean O'Brien", "Ian McDonald", "María García López", "Ludwig van Beethoven", "Müller, Anna-Lena"])
def test_names_of_many_forms_are_candidates(name):
    text = f"Contact person: {name}, thanks. Korrigiert von {name}."
    assert [text[a:b] for a, b, k in personal.candidates(text) if k == "name"] == [name, name]


def test_field_is_fitted_and_labels_places():
    texts = [f"联系人：洪建{c}。今天天气好，谢谢。批改人：洪建{c}。\n步骤一。" for c in "国华民强军明亮光宇航"] + [f"电话：1541375325{i}。编号：20231375325{i}，谢谢。" for i in range(10)]
    field = personal.SkipChain(texts * 4)
    assert field.skip != 1.0
    text = "联系人：洪建国。\n后来，洪建国说好，谢谢。"
    assert [(text[a:b], k) for a, b, k in field.spans(text)] == [("洪建国", "person")] * 2
    assert field.spans("") == [] and personal.SkipChain([]).label("联系人：洪建国") is not None
