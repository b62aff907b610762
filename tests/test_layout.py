import random

import pytest

from blockloom.operators import layout
from blockloom.operators.blocks import blocks
from blockloom.plans import synth as S
from blockloom.session import ROWS_OF_TASK, spread
from blockloom.sources.readers import WORDS, lines_from_pdf


def word(page, no, text, x0, top, x1=None, font="Plain", size=10.0, w=600.0, h=800.0):
    return ("s", page, w, h, no, text, float(x0), float(x1 if x1 is not None else x0 + 5 * len(text)), float(top), float(top) + size, font, size)


def lines(spark, words):
    rows = layout.lines_from_words(spark.createDataFrame(words, WORDS)).orderBy("page", "line_no").collect()
    return [(r.page, r.text, r.style) for r in rows]


def test_words_off_the_page_ligatures_and_jitter(spark):
    words = [word(1, 0, "a", 50, 100), word(1, 1, "off", -90, 100, x1=-60), word(1, 2, "fl", 60, 101, x1=70), word(1, 3, "ail", 70.5, 102)]
    assert lines(spark, words) == [(1, "a flail", "BODY")]


@pytest.mark.parametrize(("width", "n"), [(600.0, 2), (1200.0, 4)])
def test_columns(spark, width, n):
    words = [word(1, i * 2 + j, f"c{i}", 40 + 300 * i, 100 + 20 * j, w=width) for i in range(n) for j in range(2)]
    assert [t for _, t, _ in lines(spark, words)] == [f"c{i}" for i in range(n) for _ in range(2)]


def test_narrow_gutter_of_a_spread_splits_at_the_middle(spark):
    words = [word(1, i, f"w{i}", 210 + 9 * i, 100, x1=214 + 9 * i, w=1200.0) for i in range(20)]
    assert len(lines(spark, words)) == 2


def test_styles_and_private_digits(spark):
    words = [word(1, 0, "NAME", 50, 100, font="AB+EvelethCleanRegular", size=12.0), word(1, 1, "Tier", 50, 130, font="AB+QuestaSlab-BoldItalic"), word(1, 2, chr(0xE542), 80, 130, font="AB+QuestaSlab-BoldItalic"), word(1, 3, "77", 50, 700, font="AB+EvelethCleanRegular", size=7.5), word(1, 4, "Art", 50, 160, font="EllisHandRegular")]
    assert lines(spark, words) == [(1, "NAME", "HEADING"), (1, "Tier 2", "TIER")]


def test_heading_run_names_a_block(spark):
    text = [("TIER 2 ADVERSARIES", "HEADING"), ("(LEVELS 2-4)", "HEADING"), ("GREY MOTH", "HEADING"), ("OF THE MILL", "HEADING"), ("Tier 2 Skulk", "TIER"), ("It waits.", "BODY")]
    df = spark.createDataFrame([("s", 1, i, t, s) for i, (t, s) in enumerate(text)], "source string, page int, line_no int, text string, style string")
    (b,) = blocks(df).collect()
    assert b.start == 2 and b.section == "ADVERSARIES" and b.section_tier == 2 and [x.text for x in b.lines][:2] == ["GREY MOTH", "OF THE MILL"]


def test_empty_table(spark):
    assert lines(spark, []) == []


def test_scan_errors_are_mended_in_words(spark):
    words = [word(1, 0, "Diffi", 50, 100), word(1, 1, "culty:", 80, 100), word(1, 2, "12", 115, 100), word(1, 3, "Melee", 50, 120), word(1, 4, "–", 80, 120), word(1, 5, "1d6", 90, 120), word(1, 6, "phy", 110, 120), word(1, 7, "damage", 130, 120)]
    assert [t for _, t, _ in lines(spark, words)] == ["Difficulty: 12", "Melee - 1d6 phy"]


def test_pages_without_words_are_read_as_text(spark):
    rows = [word(1, 0, "Spoken", 50, 100), ("s", 2, 600.0, 800.0, -1, "plain – text\nof a page", None, None, None, None, None, None), ("s", 3, 600.0, 800.0, -1, "", None, None, None, None, None, None)]
    got = lines_from_pdf(spark.createDataFrame(rows, WORDS)).orderBy("page", "line_no").collect()
    assert [(r.page, r.text) for r in got if r.text] == [(1, "Spoken"), (2, "plain - text"), (2, "of a page")]


def scan(spark, n=40):
    """Pages of many words, of which some lie in the same place, in two columns."""
    rng = random.Random(7)
    return spark.createDataFrame([word(p, i, rng.choice(["ab", "c-", "12", "x"]), rng.choice([40, 60, 340, 380]), rng.choice([100, 101, 103, 120, 160])) for p in range(n) for i in range(30)], WORDS)


def test_pages_are_whole_whatever_the_batches(spark):
    pages = scan(spark).coalesce(1)
    key, read = "spark.sql.execution.arrow.maxRecordsPerBatch", lambda: sorted(map(str, layout.lines_from_words(pages).collect()))
    whole, before = read(), spark.conf.get(key)
    spark.conf.set(key, "7")
    try:
        assert read() == whole and len({r.page for r in layout.lines_from_words(pages).collect()}) == 40
    finally:
        spark.conf.set(key, before)


def test_words_are_dealt_out_once_and_lines_once(spark, sf):
    """Words of the tables come dealt out by page, and no step joins them again: the lines are put together, no more."""
    plan = layout.lines_from_words(S.words(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 2 and "Join" not in plan


def test_a_task_gets_no_more_rows_of_a_larger_table(spark):
    rows = spark.range(10)
    parts = [spread(rows, "id", rows=n * ROWS_OF_TASK).rdd.getNumPartitions() for n in (100, 400)]
    assert parts == [100, 400]
