"""An extension: stat blocks from a drop folder, file by file, with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from blockloom.operators.blocks import blocks_of, page_state, parts_of_pages
from blockloom.operators.markdown import parse_markdown
from blockloom.operators.records import Parsed, outcomes, parsed_blocks
from blockloom.session import settled
from blockloom.sources.pages import lines_from_pages


def markdown_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Adversaries of Markdown files as they arrive. A file is a row, so no state or watermark is needed."""
    files = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.md").load(folder)
    return parse_markdown(files.selectExpr("_metadata.file_path AS path", "value AS text"))


def _head(section: str, tier: str) -> Column:
    return F.concat_ws(" ", F.lit("TIER"), F.col(tier).cast("string"), F.col(section))


def page_batch(rows: DataFrame, epoch: int, handle: Callable[[Parsed, int], None], state: str, last: bool = False) -> None:
    """Parses a batch of ``source, page, text`` with what the batch before left open; ``handle`` gets what is settled.

    Open is each source's last page so far, whose last block may go on, and the section in force where it begins: a row
    for each source in the folder ``state``, a table for each batch. A batch that runs again reads the same table and
    writes the same. ``last``: nothing follows, so nothing stays open.
    """
    spark = rows.sparkSession
    pages = rows.select("source", F.col("page").cast("int"), "text")
    if epoch > 0:
        held = spark.read.schema(STATE).parquet(f"{state}/epoch-{epoch - 1}")
        # The section in force stands as a page of its own before the open one; the real page there is done with.
        heads = held.where("section IS NOT NULL").select("source", (F.col("page") - 1).alias("page"), _head("section", "tier").alias("text"))
        pages = pages.unionByName(held.select("source", "page", "text"))
        every = pages.unionByName(heads)
    else:
        every = pages
    parts = parts_of_pages(lines_from_pages(every))
    ends = settled(pages.groupBy("source").agg(F.max_by(F.struct("page", "text"), "page").alias("p")).select("source", F.col("p.page").alias("page"), F.col("p.text").alias("text")))
    force = page_state(parts).select("source", "page", F.col("carried.section").alias("section"), F.col("carried.tier").alias("tier"))
    kept = ends.join(force, ["source", "page"], "left").select("source", "page", "text", "section", "tier")
    (kept.limit(0) if last else kept).write.mode("overwrite").parquet(f"{state}/epoch-{epoch}")
    p = outcomes(parsed_blocks(blocks_of(parts)))
    open_ = ends.select("source", "page")
    settle = (lambda df: df) if last else (lambda df: df.join(open_, ["source", "page"], "left_anti"))
    handle(Parsed(settle(p.adversaries), settle(p.environments), settle(p.rejected)), epoch)


STATE = "source string, page int, text string, section string, tier int"


def page_stream(pages: DataFrame, handle: Callable[[Parsed, int], None], checkpoint: str) -> StreamingQuery:
    """Runs ``handle`` on the outcomes that each batch of a stream of ``source, page, text`` settles.

    A source's pages come in order, in any number of batches; sections and blocks go on from batch to batch. The last
    page of each source is settled by ``page_flush``.
    """
    return pages.writeStream.foreachBatch(lambda rows, epoch: page_batch(rows, epoch, handle, f"{checkpoint}/open")).option("checkpointLocation", checkpoint).start()


def page_flush(spark: SparkSession, handle: Callable[[Parsed, int], None], checkpoint: str, epoch: int) -> None:
    """Settles what is open after batch ``epoch``, once no more pages come."""
    page_batch(spark.createDataFrame([], "source string, page int, text string"), epoch + 1, handle, f"{checkpoint}/open", last=True)
