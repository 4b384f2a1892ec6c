"""Reading corpora, prompts and model outputs: JSON lines, JSON documents, CSV, text, DOCX, XLSX.

Formats are chosen by suffix. Everything is a Spark scan with an explicit schema; only office files
go through a small unzip-and-parse function over binaryFile rows. Line numbers come from the scan
itself, counted by file block.
"""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftloom.functions import text as t

#: File suffixes and the format each stands for.
FORMATS = {".jsonl": "jsonl", ".json": "jsonl", ".txt": "txt", ".docx": "docx", ".doc": "docx", ".csv": "csv", ".xlsx": "xlsx", ".xls": "xlsx"}
CORPUS = T.StructType([T.StructField("id", T.StringType()), T.StructField("question", T.StringType()), T.StructField("answer", T.StringType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))])


#: Columns that a workbook may have: their number is checked.
MOST_COLUMNS = 16_384


def load_file(spark: SparkSession, path: str) -> DataFrame:
    """A corpus file by its suffix (A2): rows (pos, id, question, answer, metadata) of JSON lines, or (path, text) of text and DOCX files."""
    kind = detect_format(path)
    if kind in ("txt", "docx"):
        return (read_whole_text if kind == "txt" else read_docx)(spark, path)
    return read_corpus(spark, path) if kind == "jsonl" else read_raw(spark, path)


def detect_format(path: str) -> str:
    """The format by suffix (A1)."""
    try:
        return FORMATS[Path(path).suffix.lower()]
    except KeyError:
        raise ValueError(f"unknown file format: {path}") from None


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(pos, line) with the 0-based physical line number over all files in the order of their names; blank lines drop out.

    Lines are counted by file block; a block's offset is the sum over the blocks before it, joined back by broadcast: a row
    for each block of the input, so its size is that of the input by the block size.
    """
    block = ["_file", "_start"]
    rows = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"))
    counts = rows.groupBy(*block).agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("_first"))
    before = Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*block, "_first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    placed = rows.join(F.broadcast(offsets), block)
    return placed.select((F.col("_before") + F.col("_at") - F.col("_first")).alias("pos"), "line").where(t.compact("line") != "")


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """(pos, line) of the lines that a lenient read leaves out: no JSON object with a question."""
    return numbered_lines(spark, path).where(F.from_json("line", CORPUS)["question"].isNull())


def read_corpus(spark: SparkSession, path: str, strict: bool = True, fields: dict[str, str] | None = None) -> DataFrame:
    """(pos, id, question, answer, metadata) of JSON lines.

    A missing id is the line number, a missing answer empty. A line that is no object with a question stops a strict
    read and drops out of a lenient one (bad_lines shows it). fields maps id, question and answer to the names they have
    in the file.
    """
    names = {n: (fields or {}).get(n, n) for n in ("id", "question", "answer")}
    parsed = F.from_json("line", CORPUS)
    if fields:
        theirs = F.from_json("line", T.StructType([T.StructField(n, T.StringType()) for n in dict.fromkeys(names.values())]))
        parsed = F.struct(*[theirs[names[n]].alias(n) for n in names], parsed["metadata"].alias("metadata"))
    rows = numbered_lines(spark, path).select("pos", parsed.alias("r"), "line")
    good = F.col("r.question").isNotNull()
    if strict:
        rows = rows.withColumn("r", F.when(good, F.col("r")).otherwise(F.raise_error(F.concat(F.lit("no question in line "), F.col("pos").cast("string")))))
    else:
        rows = rows.where(good)
    return rows.select("pos", F.coalesce("r.id", F.col("pos").cast("string")).alias("id"), F.col("r.question").alias("question"), t.text("r.answer").alias("answer"), F.coalesce("r.metadata", F.create_map().cast("map<string,string>")).alias("metadata"))


def read_whole_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text), one row a file (A5)."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def docx_text(content: bytes) -> str:
    """Paragraphs that are not blank, then table rows with cells joined by bars."""
    body = ET.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{_W}body")
    words = lambda e: "".join(x.text or "" for x in e.iter(f"{_W}t"))
    lines = [words(p) for p in body.findall(f"{_W}p")]
    for row in body.findall(f"{_W}tbl/{_W}tr"):
        lines.append(" | ".join(words(c).strip() for c in row.findall(f"{_W}tc")))
    return "\n".join(x for x in lines if x.strip())


def xlsx_rows(content: bytes) -> list[dict[str, str]]:
    """Rows of the first sheet by header; blank headers become col_0, col_1, ..., missing cells empty."""
    z = zipfile.ZipFile(io.BytesIO(content))
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(x.text or "" for x in si.iter(f"{_S}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{_S}si")]
    table: list[dict[int, str]] = []
    sheet = min(n for n in z.namelist() if n.startswith("xl/worksheets/sheet"))
    for row in ET.fromstring(z.read(sheet)).iter(f"{_S}row"):
        cells: dict[int, str] = {}
        for i, c in enumerate(row.findall(f"{_S}c")):
            letters = re.match(r"[A-Z]+", c.get("r", ""))
            at = sum((ord(x) - 64) * 26**p for p, x in enumerate(reversed(letters.group()))) - 1 if letters else i
            v = c.find(f"{_S}v")
            if c.get("t") == "s" and v is not None:
                cells[at] = shared[int(v.text)]
            elif c.get("t") == "inlineStr":
                cells[at] = "".join(x.text or "" for x in c.iter(f"{_S}t"))
            else:
                cells[at] = v.text if v is not None and v.text else ""
        table.append(cells)
    if not table:
        return []
    width = max((max(r, default=-1) for r in table), default=-1) + 1
    head = [table[0].get(i, "").strip() or f"col_{i}" for i in range(width)]
    return [{h: r.get(i, "") for i, h in enumerate(head)} for r in table[1:]]


def _office(spark: SparkSession, path: str, schema: str, rows_of) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield rows_of(p, content)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of DOCX files."""
    return _office(spark, path, "path string, text string", lambda p, c: pa.RecordBatch.from_pydict({"path": [p], "text": [docx_text(c)]}))


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, fields: map) of the first sheet of XLSX files."""
    kind = pa.map_(pa.string(), pa.string())

    def rows(p: str, c: bytes) -> pa.RecordBatch:
        got = xlsx_rows(c)
        return pa.RecordBatch.from_arrays([pa.array([p] * len(got), pa.string()), pa.array(range(len(got)), pa.int64()), pa.array([list(r.items()) for r in got], kind)], ["path", "pos", "fields"])

    return _office(spark, path, "path string, pos bigint, fields map<string,string>", rows)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header and strings only; a byte-order mark is dropped."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8", inferSchema=False, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return df.toDF(*[c.lstrip("\ufeff") for c in df.columns])


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, or one document: an array of objects or one object over several lines."""
    first = spark.read.text(path).where(t.compact("value") != "").limit(1).collect()
    head = first[0].value.strip() if first else ""
    whole = head.startswith("[") or (head.startswith("{") and not head.endswith("}"))
    return spark.read.json(path, multiLine=whole)


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Rows of any supported tabular file (A2, A10)."""
    kind = detect_format(path)
    if kind == "csv":
        return read_csv(spark, path)
    if kind == "jsonl":
        return read_json(spark, path)
    if kind == "xlsx":
        fields = read_xlsx(spark, path)
        names = sorted(r.n for r in fields.select(F.explode(F.map_keys("fields")).alias("n")).distinct().limit(MOST_COLUMNS + 1).collect())
        if len(names) > MOST_COLUMNS:
            raise ValueError(f"more than {MOST_COLUMNS} columns in {path}")
        return fields.select(*[F.col("fields")[n].alias(n) for n in names])
    raise ValueError(f"no table in {path}")


def _rest(df: DataFrame, used: set[str]):
    others = [c for c in df.columns if c not in used]
    if not others:
        return F.create_map().cast("map<string,string>")
    pairs = F.array(*[F.struct(F.lit(c).alias("k"), F.col(f"`{c}`").cast("string").alias("v")) for c in others])
    return F.map_from_entries(F.filter(pairs, lambda x: x["v"].isNotNull()))


def load_prompts(df: DataFrame, id_field: str = "prompt_id", text_field: str = "text", category_field: str = "category") -> DataFrame:
    """(prompt_id, text, category, metadata); all other fields go to metadata as strings."""
    category = t.text(category_field) if category_field in df.columns else F.lit("")
    return df.select(F.col(id_field).cast("string").alias("prompt_id"), t.text(text_field).alias("text"), category.alias("category"), _rest(df, {id_field, text_field, category_field}).alias("metadata"))


def load_outputs(df: DataFrame, version: str, id_field: str = "prompt_id", response_field: str = "response") -> DataFrame:
    """(prompt_id, model_version, response, metadata) of one version's file."""
    return df.select(F.col(id_field).cast("string").alias("prompt_id"), F.lit(version).alias("model_version"), t.text(response_field).alias("response"), _rest(df, {id_field, response_field}).alias("metadata"))


def load_answer_key(spark: SparkSession, path: str) -> DataFrame:
    """(prompt_id, a_model, b_model) from {id: {A, B}} or from rows prompt_id, A, B."""
    text = spark.read.text(path, wholetext=True).select("value")
    nested = text.select(F.explode(F.from_json("value", "map<string,struct<A:string,B:string>>"))).where("value.A is not null or value.B is not null").select(F.col("key").alias("prompt_id"), F.col("value.A").alias("a_model"), F.col("value.B").alias("b_model"))
    if nested.limit(1).count():
        return nested
    return spark.read.schema("prompt_id string, A string, B string").json(path).where("prompt_id is not null").select("prompt_id", F.col("A").alias("a_model"), F.col("B").alias("b_model"))


def stream_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """A stream over the JSON-lines files that arrive in a folder (A4)."""
    return spark.readStream.schema(CORPUS).json(folder).where("question is not null")
