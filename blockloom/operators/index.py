"""Groupings, counts and index pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.functions.text import thresholds_text
from blockloom.operators.ranking import ranked


def tier_name(tier: Column) -> Column:
    return F.when(tier > 0, F.concat(F.lit("Tier "), tier.cast("string"))).otherwise("Unknown Tier")


def by_tier(records: DataFrame) -> DataFrame:
    return records.groupBy(F.coalesce("tier", F.lit(0)).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


def kind_key(kind: str = "adversary_type") -> Column:
    return F.coalesce(F.nullif(kind, F.lit("")), F.lit("Unknown"))


def by_type(records: DataFrame) -> DataFrame:
    return records.groupBy(kind_key().alias("adversary_type")).agg(F.count(F.lit(1)).alias("n"))


def tier_order(records: DataFrame, tie: list[str]) -> DataFrame:
    """Records with ``rn``, their place in their tier by name."""
    return ranked(records.withColumn("tier", F.coalesce("tier", F.lit(0))), [F.coalesce("name", F.lit("")), *tie], within=("tier",))


def type_order(records: DataFrame, tie: list[str]) -> DataFrame:
    """Records with ``rn``, their place in their type by tier and name."""
    return ranked(records.withColumn("adversary_type", kind_key()), [F.coalesce("tier", F.lit(0)), F.coalesce("name", F.lit("")), *tie], within=("adversary_type",))


def _dash(value: Column) -> Column:
    return F.coalesce(F.nullif(value.cast("string"), F.lit("")), F.lit("-"))


def _row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


#: Places of a page's lines: its parts in order; in a group the heading, the rows, the end.
_TITLE, _FIGHTERS, _PLACES, _SUMMARY, _TOTALS = 0, 1, 3, 5, 6
_HEAD, _BODY, _END = range(3)
_PLACE = ["part", "grp", "slot", "name", "source", "page", "block", "sub"]


def _lines(rows: DataFrame, part: int, slot: int, texts: list[Column | str], group: Column | None = None, **place: Column) -> DataFrame:
    """``rows`` as lines of a page: these texts for each, in order, at this place."""
    at = {"name": F.lit(""), "source": F.lit(""), "page": F.lit(0), "block": F.lit(0)} | place
    kinds = {"name": "string", "source": "string", "page": "int", "block": "int"}
    told = F.posexplode(F.array(*[F.lit(t) if isinstance(t, str) else t for t in texts])).alias("sub", "text")
    return rows.select(F.lit(part).alias("part"), (F.lit("") if group is None else group.cast("string")).alias("grp"), F.lit(slot).alias("slot"), *[F.coalesce(at[c].cast(k), F.lit("" if k == "string" else 0)).alias(c) for c, k in kinds.items()], told)


def _page(parts: list[DataFrame]) -> DataFrame:
    """``line_no, text`` of the lines of all parts, by their places; no row is longer than a line."""
    lines = parts[0]
    for part in parts[1:]:
        lines = lines.unionByName(part)
    return ranked(lines, _PLACE, name="line_no").select("line_no", "text")


def _by_tier_lines(records: DataFrame, row: Column, head: list[str], level: str, part: int) -> list[DataFrame]:
    """The tables of all tiers: a heading and the column names, a line for each record, an empty line."""
    tier = F.lpad(F.coalesce("tier", F.lit(0)).cast("string"), 12, "0")
    keyed = records.select("*", row.alias("_row"), tier.alias("_tier"))
    tiers = by_tier(records).withColumn("_tier", F.lpad(F.col("tier").cast("string"), 12, "0"))
    return [
        _lines(tiers, part, _HEAD, [F.concat(F.lit(f"{level} "), tier_name(F.col("tier"))), "", *head], F.col("_tier")),
        _lines(keyed, part, _BODY, [F.col("_row")], F.col("_tier"), name=F.col("name"), source=F.col("source"), page=F.col("page"), block=F.col("block")),
        _lines(tiers, part, _END, [""], F.col("_tier")),
    ]


def _totals(records: DataFrame, what: str, part: int) -> list[DataFrame]:
    """How many records there are, and how many of each tier."""
    tiers = by_tier(records).withColumn("_tier", F.lpad(F.col("tier").cast("string"), 12, "0"))
    total = records.agg(F.count(F.lit(1)).alias("n"))
    return [
        _lines(total, part, _HEAD, [F.concat(F.lit(f"**Total {what}:** "), F.col("n").cast("string"))]),
        _lines(tiers, part, _BODY, [F.concat(F.lit("- "), tier_name(F.col("tier")), F.lit(": "), F.col("n").cast("string"))], F.col("_tier")),
    ]


def master_index(adversaries: DataFrame, environments: DataFrame | None = None, title: str = "Adversaries Master Index") -> DataFrame:
    """``line_no, text``: the index page by tier, places after adversaries if there are any, counts at the end."""
    thresholds = thresholds_text(F.col("threshold_minor"), F.col("threshold_major"), F.col("thresholds_raw"))
    name = F.coalesce(F.nullif("name", F.lit("")), F.lit("Unknown"))
    two = environments is not None and bool(environments.take(1))
    level = "###" if two else "##"
    one = adversaries.sparkSession.range(1)
    head = ["| Name | Type | Difficulty | Thresholds | HP | Stress |", "|------|------|------------|------------|----|----|"]
    row = _row(name, _dash(F.col("adversary_type")), _dash(F.col("difficulty")), _dash(thresholds), _dash(F.col("hp")), _dash(F.col("stress")))
    parts = [_lines(one, _TITLE, 0, [f"# {title}", "", *(["## Adversaries", ""] if two else [])]), *_by_tier_lines(adversaries, row, head, level, _FIGHTERS)]
    if two:
        head = ["| Name | Type | Difficulty | Impulses |", "|------|------|------------|----------|"]
        row = _row(name, _dash(F.col("environment_type")), _dash(F.col("difficulty")), _dash(F.col("impulses")))
        parts += [_lines(one, _PLACES - 1, 0, ["## Environments", ""]), *_by_tier_lines(environments, row, head, level, _PLACES)]
    parts += [_lines(one, _SUMMARY, 0, ["## Summary", ""]), *_totals(adversaries, "adversaries", _TOTALS)]
    if two:
        parts += [_lines(one, _TOTALS + 1, 0, [""]), *_totals(environments, "environments", _TOTALS + 2)]
    return _page(parts)


def type_index(adversaries: DataFrame, title: str = "Adversaries by Type") -> DataFrame:
    """``line_no, text``: the index page by type."""
    tier = F.coalesce("tier", F.lit(0))
    entry = F.concat(F.lit("- **"), F.coalesce("name", F.lit("None")), F.lit("** ("), F.when(tier != 0, F.concat(F.lit("Tier "), F.col("tier").cast("string"))).otherwise("?"), F.lit(")"))
    rows = adversaries.select("*", kind_key().alias("_kind"), entry.alias("_entry"), F.concat(F.lpad(tier.cast("string"), 12, "0"), F.lit(" "), F.coalesce("name", F.lit(""))).alias("_at"))
    kinds = by_type(adversaries)
    return _page([
        _lines(adversaries.sparkSession.range(1), _TITLE, 0, [f"# {title}", ""]),
        _lines(kinds, _FIGHTERS, _HEAD, [F.concat(F.lit("## "), F.col("adversary_type")), ""], F.col("adversary_type")),
        _lines(rows, _FIGHTERS, _BODY, [F.col("_entry")], F.col("_kind"), name=F.col("_at"), source=F.col("source"), page=F.col("page"), block=F.col("block")),
        _lines(kinds, _FIGHTERS, _END, [""], F.col("adversary_type")),
    ])


def listing(records: DataFrame, order: list[str]) -> DataFrame:
    """``rn, name, tier, type, issue_count`` as the console lists them."""
    tier = F.concat(F.lit("Tier "), F.when(F.coalesce("tier", F.lit(0)) != 0, F.col("tier").cast("string")).otherwise("?"))
    read = dict.fromkeys([*order, "name", "tier", "adversary_type", "issues"])
    return ranked(records.select(*read), order).select("rn", "name", tier.alias("tier"), F.coalesce(F.nullif("adversary_type", F.lit("")), F.lit("Unknown")).alias("type"), F.size("issues").alias("issue_count"))


def tier_type_cube(records: DataFrame) -> DataFrame:
    """An extension: counts over every combination of tier and type, with subtotals."""
    keyed = records.select(F.coalesce("tier", F.lit(0)).alias("tier"), kind_key().alias("adversary_type"))
    return keyed.cube("tier", "adversary_type").agg(F.count(F.lit(1)).alias("n"))
