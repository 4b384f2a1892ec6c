"""Sources, sinks, pipelines, streaming, configuration, and the catalogue's SQL twins on a small scale."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from siftloom.functions.constants import DIMENSIONS
from siftloom.plans import catalogue, config, judging, pipeline
from siftloom.session import work_table
from siftloom.sources import readers, writers
from siftloom.streaming import ingest


def test_jsonl_numbers_lines(spark, tmp_path):
    p = tmp_path / "c.jsonl"
    p.write_text('{"question": "a"}\n\n{"id": 7, "question": "b", "answer": "c", "metadata": {"k": "v"}}\n{"answer": "no question"}\n', encoding="utf-8")
    got = [(r.pos, r.id, r.question, r.answer) for r in readers.read_corpus(spark, str(p), strict=False).orderBy("pos").collect()]
    assert got == [(0, "0", "a", ""), (2, "7", "b", "c")]
    with pytest.raises(Exception, match="no question"):
        readers.read_corpus(spark, str(p)).collect()
    with pytest.raises(ValueError):
        readers.detect_format("x.pdf")


def test_office_files(spark, tmp_path):
    df = spark.createDataFrame([("1", "问？", "答 & <b>\n二")], "id string, question string, answer string")
    writers.write_docx(df, str(tmp_path / "a.docx"))
    text = readers.read_docx(spark, str(tmp_path / "a.docx")).first().text
    assert "【问题】\n问？" in text and "答 & <b>" in text
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>id</t></si><si><t>文</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>x</t></is></c></row><row><c r="A2"><v>5</v></c><c r="B2" t="s"><v>1</v></c></row></sheetData></worksheet>')
    assert readers.read_xlsx(spark, str(tmp_path / "b.xlsx")).first().fields == {"id": "5", "col_1": "文", "x": ""}


def test_answer_key_and_json(spark, tmp_path):
    (tmp_path / "k.json").write_text(json.dumps({"p1": {"A": "m1", "B": "m2"}}))
    assert tuple(readers.load_answer_key(spark, str(tmp_path / "k.json")).first()) == ("p1", "m1", "m2")
    (tmp_path / "rows.jsonl").write_text('{"prompt_id": "p1", "A": "x", "B": "y"}\n')
    assert tuple(readers.load_answer_key(spark, str(tmp_path / "rows.jsonl")).first()) == ("p1", "x", "y")
    (tmp_path / "a.json").write_text('[\n{"id": 1},\n{"id": 2}\n]')
    assert readers.read_raw(spark, str(tmp_path / "a.json")).count() == 2


def test_pipeline_reworks_and_survives_errors(spark):
    class Model:
        def ask(self, message, temperature):
            if "坏" in message:
                raise RuntimeError("down")
            return "好答案。" + "详细内容，一二三四五六七八九十。" * 2 + "结尾不同。" if "建议" in message or "补充" in message else "短"

    corpus = spark.createDataFrame([(0, "0", "什么是力？", ""), (1, "1", "什么是力？", ""), (2, "2", "坏问题", "")], "pos bigint, id string, question string, answer string")
    got = {r.pos: r for r in pipeline.run(corpus, Model(), pipeline.PipelineConfig(pass_threshold=8.0)).collect()}
    assert set(got) == {0, 2}
    assert got[0].rework_count == 1 and got[0].answer.startswith("好答案")
    assert got[2].answer == "" and got[2].evaluation is None


def test_pipeline_stores_answers_once_and_moves_no_passed_rows(spark, monkeypatch):
    class Model:
        def ask(self, message, temperature):
            return "好" if "易" in message or "改" in message else "短"

    def evaluate(items, threshold):
        return items.withColumn("evaluation", F.struct(F.col("answer").startswith("好").alias("passed"), F.lit("改").alias("suggestion")))

    seen, plans = {}, {}

    def noting(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        seen[name] = work_table(df, name)
        return seen[name]

    for module in (pipeline, judging):
        monkeypatch.setattr(module, "work_table", noting)
    corpus = spark.createDataFrame([(i, str(i), f"{'易' if i % 4 else '难'}{chr(0x4E00 + i) * 3}", "旧") for i in range(12)], "pos bigint, id string, question string, answer string")
    got = pipeline.run(corpus, Model(), evaluate=evaluate)
    assert {(r.pos, r.rework_count) for r in got.collect()} == {(i, int(i % 4 == 0)) for i in range(12)} and all(r.evaluation.passed for r in got.collect())
    assert seen["rework-1"].count() == 3
    assert not {"message", "reply"} & {c for df in seen.values() for c in df.columns}
    assert "Join" not in plans["judged-2"]


def test_model_boundary(spark):
    df = spark.createDataFrame([("a",), ("b",)], "message string").withColumn("temperature", F.lit(0.0))
    got = {r.message: (r.reply, r.error) for r in judging.call(df, judging.TableModel({"a": "x"}), attempts=1).collect()}
    assert got["a"] == ("x", None) and got["b"][0] is None and "KeyError" in got["b"][1]
    scored = judging.parsed_scores(spark.createDataFrame([('{"scores": {"format": 3}}',)], "reply string")).first().scores
    assert scored.format == 3 and all(scored[d] == 0 for d in DIMENSIONS[1:])


def test_format_quality(spark):
    rows = spark.createDataFrame([("1", "s", "题", ["甲", "乙"])], "id string, subset string, instruction string, predictions array<string>")

    class Judge:
        def ask(self, message, temperature):
            return 'ok {"best": "C2", "evaluations": [{"label": "C2", "total": 90}, {"total": 50}]}'

    r = pipeline.format_quality(rows, Judge(), 2).first().asDict()
    assert r["best"] == "C2" and r["C2_总分100"] == "90" and r["C1_总分100"] == "90" and r["error"] is None


def test_streaming(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.jsonl").write_text('{"id": "1", "question": "同 一 题"}\n{"id": "2", "question": "同一题"}\n{"id": "3", "question": "另一题"}\n', encoding="utf-8")
    stream = ingest.deduplicated(readers.stream_corpus(spark, str(src)).withColumn("at", F.lit("2025-01-01").cast("timestamp")), "question", "at")
    q = ingest.to_parquet(ingest.measured(stream), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_config(tmp_path, monkeypatch):
    (tmp_path / "c.yaml").write_text("project:\n  name: x\neval:\n  modes: [pairwise]\nconsistency:\n  num_rounds: 5\nanomaly:\n  length_percentile: [10, 90]\n")
    monkeypatch.setenv("SIFTLOOM_JUDGE__TEMPERATURE", "0.5")
    c = config.load(str(tmp_path / "c.yaml"), {"anomaly.low_percent": 1})
    assert (c.name, c.modes, c.consistency.num_rounds, c.judge.temperature, c.anomaly.low_percent, c.anomaly.high_percent, c.report.formats) == ("x", ["pairwise"], 5, 0.5, 1, 90, ["markdown", "csv"])
    with pytest.raises(KeyError):
        config.load(overrides={"nothing": 1})
    with pytest.raises(FileNotFoundError):
        config.load(str(tmp_path / "none.yaml"))


def test_every_twin_has_a_query():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())


def test_steps_are_verified_and_reworked(spark):
    from siftloom.plans import steps

    class Generator:
        def ask(self, message, temperature):
            if "坏" in message:
                return "no json"
            wrong = "Step 1 错误 [算术]: 加错了" not in message
            return json.dumps({"thinking": "想", "steps": [{"step_number": 1, "step_type": "calc", "content": "错" if wrong else "对", "formula": "1+1=2"}], "final_answer": "2"}, ensure_ascii=False)

    class Judge:
        def ask(self, message, temperature):
            good = "错" not in message
            return "评: " + json.dumps({"step_verifications": [{"step_number": 1, "is_correct": good, "error_type": "算术", "explanation": "加错了"}], "final_answer_correct": good, "chain_coherence": 0.9, "suggestion": "改"})

    items = spark.createDataFrame([(0, "0", "一加一"), (1, "1", "坏")], "pos bigint, id string, question string")
    got = {r.pos: r for r in steps.run(items, Generator(), Judge()).collect()}
    assert got[0].rework_count == 1 and got[0].cot_evaluation.passed and "**最终答案：** 2" in got[0].answer and "$$\n1+1=2\n$$" in got[0].answer
    assert got[1].cot_steps is None and got[1].cot_evaluation is None and got[1].answer == ""
    vote = steps.self_consistency(items.where("pos = 0"), judging.TableModel({"一加一": "最终答案：2。"})).first()
    assert (vote.best_answer, vote.confidence, vote.paths) == ("2", 1.0, 5)
    p = steps.plan(judging.TableModel({"做\n\na": 'x {"task_type": "cot", "domain": "math", "system_prompt": "s"}'}), "做", ["a"])
    assert (p.task_type, p.domain, p.prompts) == ("generate", "math", {"system_prompt": "s"})


def test_equations(spark):
    from siftloom.operators import mathcheck

    cases = {"1+1=2": True, "$\\frac{6}{4} = 1.5$": True, "2^3 = 9": False, "x + 1 = 2": None, "1/0 = 1": None, "": None, None: None, "9**9**9 = 1": None, "3×4=12": True}
    df = spark.createDataFrame(list(cases.items()), "s string, want boolean")
    assert all(r.got == r.want for r in df.select("want", mathcheck.holds(F.col("s")).alias("got")).collect())
