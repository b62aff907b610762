"""Plain pages to lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.functions.regex import ALL
from blockloom.functions.text import clean_text
from blockloom.operators.layout import cuts_word, is_kept
from blockloom.session import spread


def lines_from_pages(pages: DataFrame) -> DataFrame:
    """``source, page, line_no, text, style`` (style null) from ``source, page, text``, cleaned.

    Pages are dealt out once, and a page's lines are put together (``layout.cleaned_lines``) while they are one array,
    so the steps that follow need no further shuffle: a page's lines are already in one task.
    """
    none = F.lit(None).cast("string")
    split = F.split(clean_text(F.col("text")), "\n", -1)
    lines = F.filter(F.transform(split, lambda s, i: F.struct(i.alias("line_no"), s.alias("text"))), lambda x: is_kept(none, x["text"]))
    rows = spread(pages.select("source", "page", "text"), "source", "page").select("source", "page", lines.alias("lines"))
    before = F.concat(F.array(none), F.transform("lines", lambda x: x["text"]))
    rows = rows.select("source", "page", F.zip_with("lines", F.slice(before, F.lit(1), F.size("lines")), lambda x, b: F.struct(x["line_no"].alias("line_no"), x["text"].alias("text"), cuts_word(b, x["text"]).alias("joins"))).alias("lines"))
    # A line that goes on with the one before stands behind it without its hyphen; no line has a line end in it.
    whole = F.array_join(F.transform("lines", lambda x: F.concat(F.when(x["joins"], "\n-").otherwise("\n "), x["text"])), "")
    mended = F.slice(F.split(F.replace(F.when(F.exists("lines", lambda x: x["joins"]), whole), F.lit("-\n-"), F.lit("")), "\n ", -1), 2, ALL)
    numbers = F.filter("lines", lambda x: ~x["joins"])
    joined = F.zip_with(numbers, mended, lambda x, t: F.struct(x["line_no"].alias("line_no"), t.alias("text"), x["joins"].alias("joins")))
    return rows.select("source", "page", F.inline(F.coalesce(joined, "lines"))).select("source", "page", "line_no", "text", none.alias("style"))


def pages_without_words(words: DataFrame, raw: DataFrame) -> DataFrame:
    """Pages of ``raw`` (source, page, text) that have no words: their text is read as plain."""
    return raw.join(words.select("source", "page").distinct(), ["source", "page"], "left_anti")
