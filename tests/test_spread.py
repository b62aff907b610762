"""Small files of many rows are dealt out before texts are made of them, and a page's lines are what they were."""

import random

from pyspark.sql import functions as F

from blockloom.functions import text as T
from blockloom.functions.regex import strip, sub
from blockloom.operators.catalog import index_rows
from blockloom.operators.layout import cleaned_lines
from blockloom.operators.linemarks import attack_marks, feature_heading
from blockloom.plans import synth as S
from blockloom.sources.pages import lines_from_pages


def test_blocks_of_a_small_file_are_read_by_many_tasks(spark, sf):
    parts = lines_from_pages(S.pages(spark, sf)).groupBy(F.spark_partition_id()).count().count()
    assert parts > 1 and S.synth(spark, sf).groupBy(F.spark_partition_id()).count().count() > 1


def test_lines_of_a_page_are_those_of_the_lines_one_by_one(spark):
    rng = random.Random(5)
    pieces = ["a-", "b-", "tow", "-x", "", " ", "12", "Page 3", "3 Chapter 2: x", "é-", "c d", "y -", "-"]
    rows = [("s", i, "\n".join(rng.choice(pieces) for _ in range(rng.randrange(9)))) for i in range(400)]
    pages = spark.createDataFrame(rows, "source string, page int, text string")
    split = pages.select("source", "page", F.posexplode(F.split(T.clean_text(F.col("text")), "\n", -1)).alias("line_no", "text")).withColumn("style", F.lit(None).cast("string"))
    columns = ["source", "page", "line_no", "text", "style"]
    want = sorted(map(str, cleaned_lines(split, ["source", "page"], ["line_no"]).select(*columns).collect()))
    assert sorted(map(str, lines_from_pages(pages).collect())) == want


def test_strip_takes_what_unicode_calls_space(spark):
    codes = [(c, f"{chr(c)} x{chr(c)}y{chr(c)}\n") for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame(codes, "c int, v string")
    wrong = rows.where(strip(F.col("v")) != sub(F.col("v"), r"^\s+|\s+$", ""))
    assert not wrong.collect()


def test_what_a_line_needs_twice_is_worked_out_once(spark):
    """Inside lambdas nothing is shared by itself, so what is read in several places must be bound."""
    line = spark.createDataFrame([("Edge - Passive: It cuts",), ("ATK: +2 | Hook: Far | 1d6 phy",), ("atK: +1 | Claw: Melee | 1d4 mag",), ("Item seen at dusk",)], "t string")
    heading, attack = (line.select(f(F.col("t")).alias("m")) for f in (feature_heading, attack_marks))
    plan = [str(df._jdf.queryExecution().analyzed()) for df in (heading, attack)]
    assert plan[0].count("initcap(") <= 2 and plan[1].count("^[-+−0-9d]+") <= 1
    assert [r.m and r.m.name for r in heading.collect()] == ["Edge", None, None, None]
    assert [r.m and (r.m.payload, r.m.modifier) for r in attack.collect()] == [None, ("+2 | Hook: Far | 1d6 phy", "+2"), ("+1 | Claw: Melee | 1d4 mag", "+1"), None]


def test_the_word_index_is_made_behind_one_shuffle(spark):
    pages = spark.createDataFrame([(1, "s", 1, "a b a"), (1, "s", 2, "b")], "pos int, source string, page int, text string")
    rows = index_rows(pages)
    assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert sorted((r.page, r.places) for r in rows.collect()) == [(1, [0, 2]), (1, [1]), (2, [0])]
