"""Places of rows in an order, without a task that holds a whole table or a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockloom.session import settled

_ROW_BITS = (1 << 33) - 1


def ranked(rows: DataFrame, order: list[str | Column], within: tuple[str, ...] = (), name: str = "rn") -> DataFrame:
    """``rows`` with ``name`` (long, from 1): the place by ``order`` among all rows, or among those equal in ``within``.

    Rows are split by ranges of (within, order), so the rows of a frequent value lie in many tasks; each task numbers
    its own, and the counts of the tasks before it, one row a task and value, are added. Rows are written once between
    the two, as ranges come from a sample. Columns of ``within`` hold no nulls; ties of ``order`` fall as they come, so
    callers end it with a key. An empty table gives an empty one.
    """
    kept = [F.col(f"`{c}`") for c in rows.columns if c != name]
    by = [*[F.col(c).asc() for c in within], *order]
    spread = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    placed = settled(spread.select(*kept, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS)).alias("_at")))
    sizes = placed.groupBy(*within, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*within, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_more"))
    return placed.join(offsets, [*within, "_part"]).select(*kept, (F.col("_at") + F.col("_more")).alias(name))
