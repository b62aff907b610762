"""Validation messages, completeness, reports and the gates of normalising."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.functions import vocabulary as V
from blockloom.functions.regex import has
from blockloom.operators.ranking import ranked


def _messages(*checks: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(m)) for c, m in checks]))


def _blank(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) == ""


def adversary_issues() -> Column:
    return _messages(
        (_blank("name"), "Missing name"),
        (F.col("tier").isNull(), "Missing tier"),
        (_blank("adversary_type"), "Missing adversary type"),
        (F.col("difficulty").isNull(), "Missing Difficulty"),
        (F.col("threshold_minor").isNull() & F.col("threshold_major").isNull() & _blank("thresholds_raw"), "Missing Thresholds"),
        (F.col("hp").isNull(), "Missing HP"),
        (F.col("stress").isNull(), "Missing Stress"),
        (F.coalesce(F.size("features"), F.lit(0)) <= 0, "No features found"),
    )


def place_issues() -> Column:
    return _messages(
        (_blank("name"), "Missing name"),
        (F.col("tier").isNull(), "Missing tier"),
        (_blank("environment_type"), "Missing environment type"),
        (F.col("difficulty").isNull(), "Missing Difficulty"),
        (_blank("impulses"), "Missing Impulses"),
        (F.coalesce(F.size("features"), F.lit(0)) <= 0, "No features found"),
    )


def complete_adversary() -> Column:
    ok = ~_blank("name") & ~_blank("adversary_type")
    for c in ("tier", "difficulty", "threshold_minor", "threshold_major", "hp", "stress"):
        ok = ok & F.col(c).isNotNull()
    return ok


def complete_place() -> Column:
    return ~_blank("name") & F.col("tier").isNotNull() & ~_blank("environment_type") & F.col("difficulty").isNotNull() & ~_blank("impulses")


def issue_counts(records: DataFrame) -> DataFrame:
    """One row: ``total, complete, with_issues`` of records with ``issues``."""
    return records.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.size("issues") == 0).alias("complete"), F.count_if(F.size("issues") > 0).alias("with_issues"))


def validation_report(records: DataFrame, order: list[str]) -> DataFrame:
    """One row a failing record: ``rn`` and ``entry``, its part of the report in Markdown."""
    failing = records.where(F.size("issues") > 0)
    head = F.concat(F.lit("## "), F.coalesce(F.nullif("name", F.lit("")), F.lit("UNNAMED")))
    lines = F.concat(F.array(head), F.transform("issues", lambda m: F.concat(F.lit("- "), m)), F.array(F.lit("")))
    read = dict.fromkeys([*order, "name", "issues"])
    return ranked(failing.select(*read), order).select("rn", F.array_join(lines, "\n").alias("entry"))


def report_summary(records: DataFrame) -> DataFrame:
    """One row ``summary``: the head of the report, from records of both kinds with ``kind`` and ``issues``."""
    n = lambda c: F.count_if(c).cast("string")
    places = F.count_if(F.col("kind") == "environment")
    return records.agg(
        F.concat_ws(
            "\n",
            F.concat(F.lit("**Total adversaries:** "), n(F.col("kind") == "adversary")),
            F.when(places > 0, F.concat(F.lit("**Total environments:** "), places.cast("string"))),
            F.concat(F.lit("**Complete:** "), n(F.size("issues") == 0)),
            F.concat(F.lit("**With issues:** "), n(F.size("issues") > 0)),
        ).alias("summary")
    )


def has_fence(text: Column) -> Column:
    """Whether a file is a bank file already."""
    return has(text, rf"^```{V.FENCE}\s*$", "m")


def core_stats() -> Column:
    """How many of the six core values a Markdown record has."""
    attack = F.coalesce(F.col("attack").isNotNull() & (F.concat_ws("", "attack.modifier", "attack.weapon_name", "attack.range", "attack.damage") != ""), F.lit(False))
    thresholds = F.col("threshold_minor").isNotNull() | F.col("threshold_major").isNotNull() | ~_blank("thresholds_raw")
    parts = [F.col("tier").isNotNull(), F.col("difficulty").isNotNull(), F.col("hp").isNotNull(), F.col("stress").isNotNull(), thresholds, attack]
    return sum((p.cast("int") for p in parts[1:]), parts[0].cast("int"))


def normalize_summary(log: DataFrame) -> DataFrame:
    """One row of counts from ``success, changed, skipped, source_added, issues, error`` (one row a file).

    A skipped file counts neither as a success nor as a failure.
    """
    ok = F.col("success") & ~F.col("skipped")
    return log.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(ok).alias("success"),
        F.count_if(F.col("changed")).alias("changed"),
        F.count_if(ok & (F.size("issues") > 0)).alias("with_issues"),
        F.count_if(~F.col("success") & ~F.col("skipped")).alias("failed"),
        F.count_if(F.col("source_added")).alias("sources_added"),
        F.count_if(F.col("skipped")).alias("skipped"),
    )
