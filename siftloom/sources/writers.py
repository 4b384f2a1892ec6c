"""Writing results: JSON lines, CSV, text, DOCX, Markdown; small reports are gathered, tables are not."""

from __future__ import annotations

import json
import zipfile
from pathlib import Path
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftloom.functions import constants as k
from siftloom.functions import text as t
from siftloom.sources.readers import detect_format

#: Rows that a gathered file (DOCX, Markdown table) may have.
GATHERED_ROWS = 100_000


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines with nulls kept."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with header, quotes doubled, line breaks kept."""
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def rendered(df: DataFrame) -> DataFrame:
    """(value): each item as text (B3): rule, id, question, answer, then score, dimensions and suggestion if it was evaluated, and reworks."""
    empty = lambda c: F.coalesce(c, F.lit(""))
    parts = [F.lit("=" * 60 + "\n["), empty(F.col("id").cast("string")), F.lit("]\n\n【问题】\n"), t.text("question"), F.lit("\n\n【回答】\n"), t.text("answer"), F.lit("\n")]
    if "evaluation" in df.columns:
        e = F.col("evaluation")
        one = lambda d: F.concat(F.lit("  - "), empty(d["dimension"]), F.lit(": "), t.one_decimal(d["score"]), F.lit(" — "), empty(d["reason"]), F.lit("\n"))
        fields = {f.name for f in df.schema["evaluation"].dataType.fields}
        lines = F.array_join(F.coalesce(F.transform(e["dimensions"], one), F.array().cast("array<string>")), "") if "dimensions" in fields else F.lit("")
        hint = F.when(~empty(e["suggestion"]).isin("", k.NO_SUGGESTION), F.concat(F.lit("【建议】"), e["suggestion"], F.lit("\n"))).otherwise("")
        score = F.concat(F.lit("\n【评分】"), t.one_decimal(e["total_score"]), F.lit("/10 ("), F.when(e["passed"], "通过").otherwise("未通过"), F.lit(")\n"), lines, hint)
        parts.append(F.when(e.isNotNull(), score).otherwise(""))
    if "rework_count" in df.columns:
        parts.append(F.when(F.coalesce("rework_count", F.lit(0)) > 0, F.concat(F.lit("【重写次数】"), F.col("rework_count").cast("string"), F.lit("\n"))).otherwise(""))
    return df.select(F.concat(*parts).alias("value"))


def write_txt(df: DataFrame, path: str) -> None:
    rendered(df).write.mode("overwrite").text(path)


def _gathered(df: DataFrame) -> list:
    rows = df.limit(GATHERED_ROWS + 1).collect()
    if len(rows) > GATHERED_ROWS:
        raise ValueError(f"more than {GATHERED_ROWS} rows for one document; write a table instead")
    return rows


def write_docx(df: DataFrame, path: str) -> None:
    """One DOCX document of rendered items."""
    paragraphs = "".join(f"<w:p><w:r><w:t xml:space=\"preserve\">{escape(line)}</w:t></w:r></w:p>" for r in _gathered(rendered(df)) for line in r.value.split("\n"))
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>')
        z.writestr("_rels/.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>')
        z.writestr("word/document.xml", f'<?xml version="1.0"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{paragraphs}</w:body></w:document>')


def write_items(df: DataFrame, path: str) -> None:
    """Items in the format of the path's suffix (B1)."""
    {"jsonl": write_jsonl, "txt": write_txt, "docx": write_docx, "csv": write_csv}[detect_format(path)](df, path)


def write_report(report: DataFrame, path: str) -> None:
    """A one-row report as a JSON document."""
    row = report.limit(1).collect()
    Path(path).write_text(json.dumps(row[0].asDict(recursive=True) if row else {}, ensure_ascii=False, indent=2, default=str), encoding="utf-8")


def markdown_table(df: DataFrame) -> str:
    rows = _gathered(df)
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns), *("| " + " | ".join(cell(v) for v in r) + " |" for r in rows)])


def markdown_report(title: str, sections: dict[str, DataFrame]) -> str:
    """A Markdown document with one table a section."""
    return f"# {title}\n\n" + "\n\n".join(f"## {name}\n\n{markdown_table(df)}" for name, df in sections.items()) + "\n"


def anomaly_sheet(flags: DataFrame) -> DataFrame:
    """(prompt_id, anomaly_types, details) with types joined and details cut to 300 characters."""
    rest = [c for c in flags.columns if c not in ("prompt_id", "anomaly_types")]
    return flags.select("prompt_id", F.array_join("anomaly_types", "; ").alias("anomaly_types"), F.substring(F.to_json(F.struct(*rest)), 1, 300).alias("details"))
