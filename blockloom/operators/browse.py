"""The browsing table: filters, counts, sorting, options."""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NumericType

from blockloom.functions import vocabulary as V
from blockloom.functions.text import html_escape
from blockloom.operators.ranking import ranked

_COMPARE = {">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, "=": lambda a, b: a == b}


def _shown(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def _numeric(column: str) -> Column:
    return F.nullif(F.col(column).cast("string"), F.lit("")).try_cast("double")


def _typed(rows: DataFrame, column: str) -> bool:
    return isinstance(rows.schema[column].dataType, NumericType)


def _against(rows: DataFrame, column: str, sign: str, value: float) -> Column:
    """A comparison with a number; of a column of whole numbers with a whole number, so that it reaches the scan."""
    if not _typed(rows, column):
        return _COMPARE[sign](_numeric(column), F.lit(float(value)))
    if isinstance(rows.schema[column].dataType, IntegralType):
        if sign == "=" and value != int(value):
            return F.lit(False)
        value = {">=": math.ceil, "<=": math.floor, "=": int}[sign](value)
    return _COMPARE[sign](F.col(column), F.lit(value))


def predicate(rows: DataFrame, filters: dict) -> Column:
    """All filters at once, as comparisons of the columns as they are; one that is not set (None or empty) holds.

    ``search``: part of the name. Dropdown columns: the shown value. Exact columns: a number. Range columns:
    ``(operator, number)`` with >=, <= or =. Text columns: part of the text. Case does not count; an empty cell fails a
    numeric filter.
    """
    parts: list[Column] = []
    for column, value in filters.items():
        if value is None or value == "":
            continue
        if column == "search":
            parts.append(F.contains(F.lower("name"), F.lit(str(value).lower())))
        elif column in V.DROPDOWNS and _typed(rows, column):
            shown = re.fullmatch(r"-?[0-9]+", str(value)) and str(int(value)) == str(value)
            parts.append(_against(rows, column, "=", int(value)) if shown else _shown(column) == str(value))
        elif column in V.DROPDOWNS:
            parts.append(F.col(column).cast("string") == str(value))
        elif column in V.EXACT:
            parts.append(_against(rows, column, "=", float(value)))
        elif column in V.RANGES:
            sign, bound = value
            if sign not in _COMPARE:
                raise ValueError(f"{sign} is no comparison")
            parts.append(_against(rows, column, sign, float(bound)))
        elif column in V.TEXTS:
            parts.append(F.contains(F.lower(F.col(column).cast("string")), F.lit(str(value).lower())))
        else:
            raise ValueError(f"{column} has no filter")
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def stored(rows: DataFrame, path: str, by: tuple[str, ...] = ("tier", "difficulty", "hp")) -> DataFrame:
    """``rows`` as a Parquet table in ranges of ``by``, so that filters skip the files and row groups of other values."""
    keys = [c for c in by if c in rows.columns]
    (rows.repartitionByRange(*keys).sortWithinPartitions(*keys) if keys else rows).write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def browse(rows: DataFrame, filters: dict) -> DataFrame:
    return rows.where(predicate(rows, filters))


def counts(rows: DataFrame, filters: dict) -> DataFrame:
    """One row ``shown, total``."""
    return rows.agg(F.count_if(predicate(rows, filters)).alias("shown"), F.count(F.lit(1)).alias("total"))


def numeric_columns(rows: DataFrame) -> list[str]:
    """Columns whose values all are numbers or empty; name and damage never are."""
    names = [c for c in rows.columns if c not in V.NEVER_NUMERIC]
    if not names:
        return []
    found = rows.agg(*[F.min((_numeric(c).isNotNull() | (_shown(c) == "")).cast("int")).alias(c) for c in names]).first()
    return [c for c in names if found[c] != 0]


def sorted_rows(rows: DataFrame, column: str, descending: bool = False, numeric: bool | None = None, tie: list[str] | None = None) -> DataFrame:
    """``rows`` with ``rn``, their place by one column; empty cells come last either way, equal ones keep input order.

    ``tie`` names the columns of the input order. Damage cannot be sorted by.
    """
    if column in V.TEXTS:
        raise ValueError(f"{column} cannot be sorted by")
    numeric = column in numeric_columns(rows.select(column)) if numeric is None else numeric
    key = _numeric(column) if numeric else F.lower(F.nullif(_shown(column), F.lit("")))
    order = key.desc_nulls_last() if descending else key.asc_nulls_last()
    return ranked(rows, [order, *(tie or [])])


def next_sort(current: tuple[str, bool] | None, column: str) -> tuple[str, bool]:
    """``(column, descending)`` once a column is chosen: the same one again turns round, another begins ascending."""
    return column, bool(current) and current[0] == column and not current[1]


def options(rows: DataFrame) -> DataFrame:
    """``column, rn, value``: the distinct values of each dropdown column that is there, numbers before texts."""
    names = [c for c in V.DROPDOWNS if c in rows.columns]
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), _shown(c).alias("value")) for c in names])).alias("x")).select("x.*").where("value != ''").distinct()
    order = Window.partitionBy("column").orderBy(F.col("value").try_cast("double").asc_nulls_last(), "value")
    return long.withColumn("rn", F.row_number().over(order))


def column_facts(rows: DataFrame) -> DataFrame:
    """``column, pos, filter, filled, least, greatest``: the shown columns in order, whether each has a filter box, how many
    of its cells are filled, and the first and last filled one as texts."""
    names, boxes = shown_columns(rows), set(filter_columns(rows))
    cell = {c: F.nullif(_shown(c), F.lit("")) for c in names}
    found = rows.agg(*[F.struct(F.lit(i).cast("long").alias("pos"), F.lit(c).alias("column"), F.lit(c in boxes).alias("filter"), F.count(cell[c]).alias("filled"), F.min(cell[c]).alias("least"), F.max(cell[c]).alias("greatest")).alias(f"c{i}") for i, c in enumerate(names)])
    return found.select(F.explode(F.array(*[f"c{i}" for i in range(len(names))])).alias("c")).select("c.column", "c.pos", "c.filter", "c.filled", "c.least", "c.greatest")


def shown_columns(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c not in V.LEFT_OUT]


def filter_columns(rows: DataFrame) -> list[str]:
    return [c for c in [*V.DROPDOWNS, *V.EXACT, *V.RANGES, *V.TEXTS] if c in rows.columns]


def embedded_json(rows: DataFrame) -> DataFrame:
    """``json`` of each row, nulls as empty texts, fit to stand in a script element."""
    filled = [F.coalesce(F.col(c).cast("variant"), F.lit("").cast("variant")).alias(c) for c in rows.columns]
    return rows.select(F.replace(F.to_json(F.struct(*filled)), F.lit("</"), F.lit("<\\/")).alias("json"))


def table_cells(rows: DataFrame) -> DataFrame:
    """``html`` of each row: the shown columns as the cells of a table row, escaped, empty ones for nulls."""
    cells = [F.concat(F.lit("<td>"), html_escape(_shown(c)), F.lit("</td>")) for c in shown_columns(rows)]
    return rows.select(F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("html"))
