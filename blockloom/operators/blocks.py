"""Lines to stat blocks: tier-line anchors, name starts, section headers, continuation over a page break.

In-page steps are windows over a page. What goes from page to page (the section in force, the tail of a block) goes
through a table of one row a page, so a long source never has its lines in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockloom.functions import vocabulary as V
from blockloom.functions.regex import has
from blockloom.operators.linemarks import LINE, marked, told
from blockloom.session import settled, spread

PAGE = ["source", "page"]


def placed_lines(lines: DataFrame) -> DataFrame:
    """Lines with their marks, block number, the section header in force above them, and whether one closed the block.

    A block begins at the name above a tier line. Block 0 is what stands before the first block of a page.
    """
    w = Window.partitionBy(*PAGE).orderBy("line_no")
    upto, above, page = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*PAGE)
    # Lines are numbered before they are read: windows go over narrow rows, and reading is compiled by itself.
    rows = marked(lines.withColumn("i", F.row_number().over(w) - 1))
    rows = rows.withColumn("heads", (F.coalesce("style", F.lit("")) == "HEADING") & F.col("header").isNull() & ~F.col("levels")).withColumn("before", F.lag("t").over(w))
    # The last line with text above, with its own predecessor; and where the run of headings above begins.
    spoken = F.last(F.when(F.col("t") != "", F.struct("i", "t", "before")), ignorenulls=True)
    run = F.coalesce(F.last(F.when(~F.col("heads"), F.col("i")), ignorenulls=True).over(upto) + 1, F.lit(0))
    rows = rows.withColumns({"above": spoken.over(above), "run": run, "any_style": F.max(F.col("style").isNotNull()).over(page), "under": F.coalesce(F.lag("heads").over(w), F.lit(False)), "governing": F.last("header", ignorenulls=True).over(above)})
    colon = lambda c: F.coalesce(F.endswith(c, F.lit(":")), F.lit(False))
    plain = F.col("above.i") - ((F.col("above.i") >= 1) & ~colon(F.col("above.t")) & colon(F.col("above.before"))).cast("int")
    start = F.when(F.col("tier.anchor"), F.when(F.col("any_style") & F.col("under"), F.lag("run").over(w)).otherwise(plain))
    rows = rows.withColumn("start", start).withColumn("starts", F.collect_set("start").over(page))
    rows = rows.withColumn("opens", F.array_contains("starts", F.col("i"))).withColumn("block", F.sum(F.col("opens").cast("int")).over(upto))
    inside = Window.partitionBy(*PAGE, "block").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    closes = F.col("header").isNotNull() & ((F.col("block") == 0) | ~F.col("opens"))
    rows = rows.withColumn("closed", F.max(closes).over(inside))
    return told(rows.drop("above", "run", "any_style", "under", "start", "starts", "before", "heads", "opens", "levels"))


def parts_of_pages(lines: DataFrame) -> DataFrame:
    """One row for each block of a page and for the head before the first, with its lines; written, as several steps
    read it."""
    rows = placed_lines(lines)
    line = F.struct(F.col("i").alias("line_no"), "text", "style", "t", "first", "tier", "heading", "weapon", "attack")
    spoken = F.when(F.col("t") != "", F.struct("i", "t", "heading"))
    groups = rows.groupBy(*PAGE, "block").agg(
        F.sort_array(F.collect_list(F.when(~F.col("closed"), line))).cast(f"array<{LINE}>").alias("lines"),
        F.max("closed").alias("closed"),
        F.min_by(spoken, F.when(F.col("t") != "", F.col("i"))).alias("opening"),
        F.min("i").alias("start"),
        F.min_by("governing", "i").alias("governing"),
        F.max(F.when(F.col("header").isNotNull(), F.struct("i", "header"))).alias("last_header"),
        F.max((F.col("t") != "") & ~F.col("closed")).alias("spoken"),
    )
    opens = has(F.col("opening.t"), r"^\p{Ll}") | F.col("opening.heading").isNotNull() | F.startswith(F.upper("opening.t"), F.lit(V.FEATURES))
    return settled(groups.withColumn("opens", F.coalesce(opens, F.lit(False))).drop("opening"))


def page_state(parts: DataFrame) -> DataFrame:
    """One row a page: its place in the source, how many blocks it has, and the section in force when it begins."""
    pages = parts.groupBy(*PAGE).agg(F.max("block").alias("n_blocks"), F.max("last_header").alias("last"))
    w = Window.partitionBy("source").orderBy("page")
    carried = F.last("last.header", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return pages.select("source", "page", "n_blocks", F.row_number().over(w).alias("nth"), carried.alias("carried"))


def blocks(lines: DataFrame) -> DataFrame:
    """One row a block: ``source, page, block, start, section, section_tier, reaches_page_end, lines``.

    With it ``tail``, the lines at the head of the next page up to a section header, if the block may go on there, and
    ``bare``: that page has no block of its own, so more evidence is asked for (``opens``: its first words give it).
    """
    return blocks_of(parts_of_pages(lines))


def blocks_of(parts: DataFrame) -> DataFrame:
    """``blocks`` of the written parts of pages."""
    state = page_state(parts)
    head = parts.where("block = 0").join(state, PAGE)
    tails = head.select("source", (F.col("nth") - 1).alias("nth"), F.col("lines").alias("tail"), (F.col("n_blocks") == 0).alias("bare"), F.col("opens").alias("goes_on"))
    # Pages meet the heads behind them first, a row a page; the blocks, which are wide, are dealt out and joined once. Of
    # their size Spark knows only that of the table they were made from, so a broadcast is ruled out.
    own = spread(parts.where("block > 0 AND spoken"), *PAGE).hint("merge").join(state.join(tails, ["source", "nth"], "left"), PAGE)
    section = F.coalesce("governing", "carried")
    own = own.withColumn("reaches_page_end", (F.col("block") == F.col("n_blocks")) & ~F.col("closed"))
    ends = F.col("reaches_page_end")
    return own.select(
        "source", "page", "block", "start", "reaches_page_end", section["section"].alias("section"), section["tier"].alias("section_tier"), "lines",
        F.when(ends, F.col("tail")).alias("tail"), F.coalesce(ends & F.col("bare"), F.lit(False)).alias("bare"), F.coalesce("goes_on", F.lit(False)).alias("opens"),
    )
