"""Readers of files into the engine's tables. Optional libraries are used only where they are installed."""

from __future__ import annotations

import importlib.util

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from blockloom.functions import vocabulary as V
from blockloom.functions.text import source_from_filename

WORDS = "source string, page int, page_w double, page_h double, word_no int, text string, x0 double, x1 double, top double, bottom double, fontname string, size double"


def markdown_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, file, text`` of Markdown files, one row each; an empty file has none."""
    rows = spark.read.option("pathGlobFilter", "*.md").text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))


def record_files(files: DataFrame) -> DataFrame:
    """Files that may hold records: not on the skip list, name not beginning with an underscore."""
    return files.where(~F.col("file").isin(V.SKIPPED_FILES) & ~F.startswith("file", F.lit("_")))


def text_pages(spark: SparkSession, path: str, mark: str = "\f") -> DataFrame:
    """``source, page, text`` of plain-text files whose pages a form feed ends; pages count from 1."""
    rows = spark.read.text(path, wholetext=True)
    name = source_from_filename(F.col("_metadata.file_name"))
    return rows.select(name.alias("source"), F.posexplode(F.split("value", mark, -1)).alias("p", "text")).select("source", (F.col("p") + 1).alias("page"), "text")


def sheet(spark: SparkSession, path: str, name: str = "daggerheart_adversaries") -> DataFrame:
    """A table with headers in its first row: CSV or Parquet by suffix, a spreadsheet where a reader is installed."""
    if path.lower().endswith((".xlsx", ".xls")):
        if importlib.util.find_spec("openpyxl") is None:
            raise RuntimeError("reading spreadsheets needs openpyxl")
        import pandas as pd

        frame = pd.read_excel(path, sheet_name=name)
        # Cells that say NULL are empty ones.
        return spark.createDataFrame(frame.mask(frame == "NULL", ""))
    if path.lower().endswith(".parquet"):
        return spark.read.parquet(path)
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


class PdfWords(DataSource):
    """``spark.read.format("pdf_words")``: positioned words, one task for each file of the comma-separated ``paths``."""

    @classmethod
    def name(cls) -> str:
        return "pdf_words"

    def schema(self) -> str:
        return WORDS

    def reader(self, schema) -> DataSourceReader:
        return _PdfReader(self.options)


class _PdfReader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in options.get("paths", options.get("path", "")).split(",") if p]

    def partitions(self):
        return [InputPartition(p) for p in self.paths]

    def read(self, partition):
        if importlib.util.find_spec("pdfplumber") is None:
            raise RuntimeError("reading PDF files needs pdfplumber")
        import pdfplumber

        stem = partition.value.rsplit("/", 1)[-1]
        with pdfplumber.open(partition.value) as pdf:
            for number, page in enumerate(pdf.pages, 1):
                words = page.extract_words(extra_attrs=["fontname", "size"])
                if not words:
                    # Such a page is one row, number -1, with the text that a plain extraction gives.
                    yield stem, number, float(page.width), float(page.height), -1, page.extract_text() or "", None, None, None, None, None, None
                for i, w in enumerate(words):
                    yield stem, number, float(page.width), float(page.height), i, w["text"], w["x0"], w["x1"], w["top"], w["bottom"], w["fontname"], w["size"]


def lines_from_pdf(rows: DataFrame) -> DataFrame:
    """Lines of ``pdf_words`` rows: pages with words by their layout, pages without by their plain text."""
    from blockloom.operators.layout import lines_from_words
    from blockloom.sources.pages import lines_from_pages, pages_without_words

    words = rows.where("word_no >= 0")
    raw = rows.where("word_no < 0").select("source", "page", "text")
    return lines_from_words(words).unionByName(lines_from_pages(pages_without_words(words, raw)))


def read_stat_blocks(spark: SparkSession, path: str, fmt: str | None = None):
    """Records of one source by its suffix, any case: ``.pdf`` and ``.txt`` give all outcomes, ``.md`` adversaries only."""
    from blockloom.operators.markdown import parse_markdown
    from blockloom.operators.records import parse_lines
    from blockloom.sources.pages import lines_from_pages

    fmt = fmt or path.rsplit(".", 1)[-1].lower()
    if fmt == "md":
        return parse_markdown(markdown_files(spark, path))
    if fmt == "txt":
        return parse_lines(lines_from_pages(text_pages(spark, path)))
    if fmt == "pdf":
        spark.dataSource.register(PdfWords)
        rows = spark.read.format("pdf_words").option("paths", path).load().withColumn("source", source_from_filename(F.col("source")))
        return parse_lines(lines_from_pdf(rows))
    raise ValueError(f"no reader for .{fmt} files")
