"""Normalising Markdown files: gates, attribution, rewriting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.functions.regex import strip
from blockloom.operators.catalog import attribute, attribute_indexed, fill_sources
from blockloom.operators.markdown import first_records, parse_markdown
from blockloom.operators.render import readable_adversary
from blockloom.operators.validate import adversary_issues, core_stats, has_fence

LEAST_STATS = 2


def normalized(files: DataFrame, sources: DataFrame | None = None, index: DataFrame | None = None) -> DataFrame:
    """One row a file of ``path, text``: ``path, name, skipped, skip_reason, success, changed, source_added, issues, error, new_text``.

    Bank files and files with fewer than two core stats are skipped. With ``sources`` (pos, source, page, text) records
    without a source get the first that has their name; ``index`` is a word index of the sources, in place of their texts.
    """
    files = files.withColumn("bank", has_fence(F.col("text")))
    records = first_records(parse_markdown(files.where(~F.col("bank")).select("path", "text")))
    if sources is not None or index is not None:
        names = records.where(F.col("name").isNotNull()).select("name").distinct()
        records = fill_sources(records, attribute(names, sources) if index is None else attribute_indexed(names, index))
    else:
        records = records.withColumn("source_added", F.lit(False))
    few = core_stats() < LEAST_STATS
    parsed = records.select("path", "name", few.alias("few"), "source_added", adversary_issues().alias("found"), readable_adversary().alias("new"))
    rows = files.join(parsed, "path", "left")
    skipped = F.col("bank") | F.coalesce("few", F.lit(False))
    works = ~skipped & F.col("new").isNotNull()
    changed = works & (strip(F.col("text")) != strip(F.col("new")))
    stem = F.regexp_replace(F.regexp_replace("path", "^.*/", ""), r"\.[^.]*$", "")
    return rows.select(
        "path",
        F.when(F.col("bank"), stem).when(skipped, F.coalesce(F.nullif("name", F.lit("")), stem)).otherwise(F.col("name")).alias("name"),
        skipped.alias("skipped"),
        F.when(F.col("bank"), "bank format").when(skipped, "no stat block found").alias("skip_reason"),
        (skipped | works).alias("success"),
        changed.alias("changed"),
        F.coalesce(works & F.col("source_added"), F.lit(False)).alias("source_added"),
        F.when(works, F.col("found")).otherwise(F.expr("array()").cast("array<string>")).alias("issues"),
        F.when(~skipped & ~works, "Failed to parse adversary").alias("error"),
        F.when(changed, F.col("new")).alias("new_text"),
    )
