"""Words with positions to styled lines: columns, visual lines, spacing, dominant font.

Every step works within a page, so pages are the unit of partitioning; one page never exceeds one task. Spark deals out
and sorts the words by page once; columns and visual lines are worked out from batches of whole pages in Python tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockloom.functions import vocabulary as V
from blockloom.functions.text import decode_digits, is_furniture, mend_scan_errors
from blockloom.functions.regex import has, nothing
from blockloom.session import once

PAGE = ["source", "page"]


def style_of(font: Column, size: Column) -> Column:
    """The role of a font; its name may follow a subset tag and a plus sign."""
    name = F.substring_index(F.coalesce(font, F.lit("")), "+", -1)
    return (
        F.when(name.isin(V.ART_FONTS), "ART")
        .when(name.isin(V.HEADING_FONTS), F.when(F.coalesce(size, F.lit(8.0)) >= V.HEADING_SIZE, "HEADING").otherwise("PAGE_NUMBER"))
        .when(name.isin(V.TIER_FONTS), "TIER")
        .when(name.isin(V.QUESTION_FONTS), "QUESTION")
        .otherwise("BODY")
    )


def is_visible() -> Column:
    """Whether a word's middle lies on its page."""
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("top") + F.col("bottom")) / 2
    return x.between(0, F.col("page_w")) & y.between(0, F.col("page_h"))


def visible_words(words: DataFrame) -> DataFrame:
    """Words whose middle lies on the page, with private-use digits decoded."""
    return words.where(is_visible()).withColumn("text", decode_digits(F.col("text")))


def _by_page(words: DataFrame, use: Callable[[pa.Table, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """The rows that ``use`` makes of whole pages of words, several at a time, with the number of each word's page.

    Spark deals out the words by page and sorts them, and numbers them in their page: a page begins at each 1.
    """
    at = F.row_number().over(Window.partitionBy("page", "source").orderBy("x0", "word_no"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            begins = np.flatnonzero(held["_at"].to_numpy() == 1)
            if len(begins) > 1:
                yield from made(held.slice(0, begins[-1]))
                held = held.slice(begins[-1])
        if held is not None and held.num_rows:
            yield from made(held)

    def made(pages: pa.Table) -> list[pa.RecordBatch]:
        return use(pages.drop_columns("_at"), np.cumsum(pages["_at"].to_numpy() == 1) - 1).to_batches()

    return words.withColumn("_at", at).mapInArrow(run, schema)


def _column_keys(words: pa.Table, page: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word a number for the column of a page that it stands in, in order, and the first of its page.

    A page wider than high is a spread: its halves are split each by itself, at the middle if no gap is wide enough.
    Each half is split at its widest central gap, of equal ones at the first, if that is wide enough. Gaps are between
    left edges rounded half to even.
    """
    x0, w, h = (words[c].to_numpy() for c in ("x0", "page_w", "page_h"))
    wide = w > h
    right = wide & (x0 >= w / 2)
    lo, hi, half = np.where(right, w / 2, 0.0), np.where(wide & ~right, w / 2, w), page * 2 + right
    order = np.lexsort((x0, half))
    x, at, low, span = np.rint(x0)[order], half[order], lo[order][:-1], (hi - lo)[order][:-1]
    gap, mid = x[1:] - x[:-1], (x[1:] + x[:-1]) / 2
    central = (mid > low + span * V.GAP_ZONE[0]) & (mid < low + span * V.GAP_ZONE[1])
    found = np.flatnonzero((at[1:] == at[:-1]) & (gap > 0) & central)
    found = found[np.lexsort((mid[found], -gap[found], at[found]))]
    best = found[np.unique(at[found], return_index=True)[1]]
    best = best[gap[best] >= span[best] * V.GAP_SHARE]
    split = np.full(2 * (page[-1] + 1), np.nan)
    split[at[best]] = mid[best]
    cut = np.where(np.isnan(split[half]) & wide, (lo + hi) / 2, split[half])
    places, key = np.unique(half * 2 + (x0 >= cut), return_inverse=True)
    return key, np.searchsorted(places, page * 4)


def _line_numbers(words: pa.Table, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word the number of its visual line, in order of columns and lines, and the first of its column.

    Words in order of ``top`` join the current line while they are no further from its first word than a share of the
    largest size in it so far; that share moves with each word, so this is a fold over the column's sorted words.
    """
    order = np.lexsort((_numbers(words), words["x0"].to_numpy(), words["top"].to_numpy(), key))
    column, line, first, most = -1, -1, 0.0, 0.0
    lines, begins = [], []
    for k, top, size in zip(key[order].tolist(), words["top"].to_numpy()[order].tolist(), _sizes(words)[order].tolist(), strict=True):
        if k == column and top - first <= most * V.LINE_RATIO:
            most = max(most, size)
        else:
            line, first, most = line + 1, top, size
            if k != column:
                column = k
                begins.append(line)
        lines.append(line)
    out = np.empty(len(key), dtype=np.int64)
    out[order] = lines
    return out, np.array(begins, dtype=np.int64)[key]


def _numbers(words: pa.Table) -> np.ndarray:
    return pc.fill_null(words["word_no"].cast("int64"), -(1 << 63)).to_numpy()


def _sizes(words: pa.Table) -> np.ndarray:
    """Sizes, 8 where there is none; what is no number is more than all, as in Spark."""
    size = pc.fill_null(words["size"].cast("float64"), 8.0).to_numpy()
    return np.where(np.isnan(size), np.inf, size)


def _with(words: pa.Table, **new: np.ndarray) -> pa.Table:
    for name, values in new.items():
        words = words.append_column(name, pa.array(values.astype(np.int32)))
    return words


def _types(words: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in words.schema)


def columns(words: DataFrame) -> DataFrame:
    """Visible ``words`` with ``col``, the number of the text column on the page."""

    def use(words: pa.Table, page: np.ndarray) -> pa.Table:
        key, first = _column_keys(words, page)
        return _with(words, col=key - first)

    return _by_page(words, use, f"{_types(words)}, col int")


def rows_of_words(words: DataFrame) -> DataFrame:
    """Visible ``words`` with ``col`` and ``row``: the text column on the page and the visual line in it."""

    def use(words: pa.Table, page: np.ndarray) -> pa.Table:
        key, first = _column_keys(words, page)
        line, top = _line_numbers(words, key)
        return _with(words, col=key - first, row=line - top)

    return _by_page(words, use, f"{_types(words)}, col int, row int")


def rendered_lines(words: DataFrame) -> DataFrame:
    """``source, page, col, row, text, style`` of visible words.

    A space stands where the gap to the word before exceeds a share of that word's size. The style is that of most
    characters; of equal ones, the one that comes first.
    """
    told = words.select(*PAGE, "page_w", "page_h", "word_no", "text", "x0", "x1", "top", "size", style_of(F.col("fontname"), F.col("size")).alias("style"))

    def use(words: pa.Table, page: np.ndarray) -> pa.Table:
        key, first = _column_keys(words, page)
        line, top = _line_numbers(words, key)
        order = np.lexsort((_numbers(words), words["x0"].to_numpy(), line))
        words, at, place = words.take(order), line[order], _with(words.select(PAGE), col=key - first, row=line - top).take(order)
        begins = np.flatnonzero(np.diff(at, prepend=-1))
        x0, x1, there = words["x0"].to_numpy(), words["x1"].to_numpy(), words["text"].is_valid().to_numpy()
        apart = np.zeros(len(at), dtype=bool)
        apart[1:] = (at[1:] == at[:-1]) & (x0[1:] - x1[:-1] > _sizes(words)[:-1] * V.SPACE_RATIO)
        text = pc.fill_null(words["text"], "").combine_chunks()
        parts = pc.binary_join_element_wise(pa.array([" ", ""]).take(pa.array(1 - (apart & there))), text, "")
        styles = words["style"].combine_chunks().dictionary_encode()
        kinds, since, kind = np.unique(at * len(styles.dictionary) + styles.indices.to_numpy(), return_index=True, return_inverse=True)
        said = np.bincount(kind, pc.utf8_length(text).to_numpy())
        said[np.bincount(kind, there) == 0] = -1
        of = kinds // len(styles.dictionary)
        most = np.lexsort((since, -said, of))[np.flatnonzero(np.diff(of, prepend=-1))]
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(begins, len(at)).astype(np.int32)), parts), "")
        return place.take(begins).append_column("text", joined).append_column("style", styles.dictionary.take(pa.array(kinds[most] % len(styles.dictionary))))

    types = dict(told.dtypes)
    return _by_page(told, use, f"source {types['source']}, page {types['page']}, col int, row int, text string, style string")


def is_kept(style: Column, text: Column) -> Column:
    """Whether a line is no art, page number or furniture."""
    return ~F.coalesce(style, F.lit("")).isin("ART", "PAGE_NUMBER") & ~is_furniture(text)


def cuts_word(before: Column, text: Column) -> Column:
    """Whether a line goes on with a word that the end of the line before cut."""
    return F.coalesce(F.endswith(before, F.lit("-")) & has(before, r"\w-$(?<!\n)") & has(text, r"^\w"), F.lit(False))


def cleaned_lines(lines: DataFrame, within: list[str], order: list[str]) -> DataFrame:
    """Lines without art, page numbers and furniture, and with words that a line end cut put together again.

    A line joins the one before (the last that was kept) if that ends in a word character and a hyphen and it begins
    with a word character; so chains of cut words become one line.
    """
    kept = lines.where(is_kept(F.col("style"), F.col("text")))
    w = Window.partitionBy(*within).orderBy(*order)
    before = F.lag("text").over(w)
    joins = cuts_word(before, F.col("text"))
    island = F.sum((~F.col("_joins")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    numbered = kept.withColumn("_joins", joins).withColumn("_island", island).withColumn("_at", F.row_number().over(w))
    more = F.lead("_joins").over(w)
    part = F.when(F.coalesce(more, F.lit(False)), F.substr("text", F.lit(1), F.length("text") - 1)).otherwise(F.col("text"))
    parts = numbered.withColumn("_part", part).groupBy(*within, "_island").agg(
        F.min_by("style", "_at").alias("style"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_part"))), lambda p: p["_part"]), "").alias("text"), *[F.min(c).alias(c) for c in order]
    )
    return parts.drop("_island")


def _mended(lines: Column) -> Column:
    """What ``cleaned_lines`` makes of the lines of a page, each with ``joins``, as one array."""
    plain = lambda x: F.struct(x["text"].alias("text"), x["style"].alias("style"))

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        text = F.concat(F.substr(last["text"], F.lit(1), F.length(last["text"]) - 1), x["text"])
        longer = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(text.alias("text"), last["style"].alias("style"))))
        return F.when(x["joins"], longer).otherwise(F.concat(acc, F.array(plain(x))))

    return F.when(F.exists(lines, lambda x: x["joins"]), F.aggregate(lines, nothing("struct<text:string,style:string>"), step)).otherwise(F.transform(lines, plain))


def lines_from_words(words: DataFrame) -> DataFrame:
    """``source, page, line_no, text, style`` of whole pages in reading order, mended and cleaned column by column."""
    rows = rendered_lines(visible_words(words)).withColumn("text", mend_scan_errors(F.col("text"))).where(is_kept(F.col("style"), F.col("text")))
    pages = once(rows.groupBy(*PAGE).agg(F.collect_list(F.struct("col", "row", "text", "style")).alias("lines")), {"lines": F.sort_array("lines")})
    before = F.concat(F.array(F.struct(F.lit(None).cast("int").alias("col"), F.lit(None).cast("string").alias("text"))), F.transform("lines", lambda x: F.struct(x["col"].alias("col"), x["text"].alias("text"))))
    joins = F.zip_with("lines", F.slice(before, F.lit(1), F.size("lines")), lambda x, b: F.struct(x["text"].alias("text"), x["style"].alias("style"), F.coalesce((x["col"] == b["col"]) & cuts_word(b["text"], x["text"]), F.lit(False)).alias("joins")))
    pages = once(pages, {"lines": joins})
    return pages.select(*PAGE, F.posexplode(_mended(F.col("lines"))).alias("line_no", "line")).select(*PAGE, "line_no", "line.text", "line.style")
