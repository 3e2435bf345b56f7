"""Reading and writing the JSON, text and archive shapes that forms arrive in."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load_json(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    """JSON documents of a fixed schema; an empty table if the path does not exist."""
    try:
        return spark.read.schema(schema).option("multiLine", multi_line).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def load_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; malformed lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def _listed(raw: str) -> str:
    rows = [" | ".join(cell.strip() for cell in row) for row in csv.reader(io.StringIO(raw.removeprefix("\ufeff")))]
    return "\n".join(x for x in rows if x.strip())


def _indented(raw: str) -> str:
    return json.dumps(json.loads(raw), indent=2, ensure_ascii=False)


def _shaped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The content of CSV and JSON files as text, or what is wrong with it; (path, text, error)."""
    for batch in batches:
        out = []
        for path, kind, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            try:
                out.append((path, (_listed if kind == "csv" else _indented)(raw or ""), None))
            except (ValueError, csv.Error) as e:
                out.append((path, None, f"malformed: {type(e).__name__}"))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in range(3)], ["path", "text", "error"])


def corpus_text(files: DataFrame) -> DataFrame:
    """(path, text, error) of (path, content): CSV cells joined by |, JSON indented, texts stripped; other extensions and null paths are errors.

    Quoted CSV cells may hold commas and line breaks; empty rows vanish. Malformed JSON is an error of its row. Only CSV
    and JSON files pass through Python; the others stay expressions.
    """
    kind = F.coalesce(F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)), F.lit(""))
    body = F.decode("content", F.lit("UTF-8")) if dict(files.dtypes)["content"] == "binary" else F.col("content")
    rows = files.select("path", kind.alias("kind"), body.alias("body"))
    plain = F.when(F.col("kind").isin("txt", "md", "markdown"), F.btrim(F.col("body"), F.lit(" \t\n\r\f\x0b")))
    wrong = F.when(plain.isNull(), F.concat(F.lit("unsupported: "), "kind"))
    shaped = rows.filter(F.col("kind").isin("csv", "json")).mapInArrow(_shaped, "path string, text string, error string")
    return rows.filter(~F.col("kind").isin("csv", "json")).select("path", plain.alias("text"), wrong.alias("error")).unionByName(shaped)


def _html(raw: str) -> str:
    from html.parser import HTMLParser

    out: list[str] = []

    class Reader(HTMLParser):
        hidden = 0

        def handle_starttag(self, tag, attrs):
            self.hidden += tag in ("script", "style", "head")

        def handle_endtag(self, tag):
            if tag in ("script", "style", "head") and self.hidden:
                self.hidden -= 1

        def handle_data(self, data):
            if not self.hidden and data.strip():
                out.append(data.strip())

    reader = Reader()
    reader.feed(raw)
    reader.close()
    return "\n".join(out)


def _xml(raw: str) -> str | None:
    from xml.etree import ElementTree

    try:
        return "\n".join(x.strip() for x in ElementTree.fromstring(raw).itertext() if x.strip())
    except ElementTree.ParseError:
        return None


def _mapped(convert):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else convert(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return run


def html_text(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(id, text): visible text nodes of each page, one a line."""
    return pages.select(F.col(key).cast("long").alias("id"), F.col(html).alias("text")).mapInArrow(_mapped(_html), "id long, text string")


def xml_text(rows: DataFrame, key: str, xml: str) -> DataFrame:
    """(id, text): texts and tails in document order, one a line; null where the document is malformed."""
    return rows.select(F.col(key).cast("long").alias("id"), F.col(xml).alias("text")).mapInArrow(_mapped(_xml), "id long, text string")
