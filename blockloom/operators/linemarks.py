"""What a line says, read word by word: section headers, tier lines, feature headings, weapons and attack labels.

Each line is read once, as flat columns; the steps that put blocks together look at the marks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.functions import vocabulary as V
from blockloom.functions.regex import number, one, rest, rx, strip
from blockloom.session import once

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = "0123456789"
NAME_OF_FEATURE = 70


def only(text: Column, characters: str) -> Column:
    """Whether a text has characters, and none but these."""
    return (text != "") & (F.translate(text, characters, "") == "")


def first_word(text: Column) -> Column:
    return F.upper(F.regexp_extract(text, rx(r"^\w+"), 0))


def section_header(words: Column) -> Column:
    """``section, tier`` of a line that begins with the words TIER, a number and a section's name."""
    section = first_word(F.get(words, F.lit(2)))
    good = (F.upper(F.get(words, F.lit(0))) == "TIER") & only(F.get(words, F.lit(1)), DIGITS) & section.isin(V.SECTIONS)
    return F.when(good, F.struct(section.alias("section"), number(F.get(words, F.lit(1))).alias("tier")))


def is_level_range(line: Column) -> Column:
    """Whether a line is nothing but levels in brackets: the word, then a number or two around a dash."""
    inner = F.split(strip(F.substr(line, F.lit(2), F.length(line) - 2)), r"\s+", 2)
    numbers = F.split(F.regexp_replace(F.translate(F.get(inner, F.lit(1)), "–—", "--"), r"\s", ""), "-", -1)
    good = F.upper(F.get(inner, F.lit(0))).isin("LEVEL", "LEVELS") & (F.size(numbers) <= 2) & F.forall(numbers, lambda n: only(n, DIGITS))
    return F.startswith(line, F.lit("(")) & F.endswith(line, F.lit(")")) & F.coalesce(good, F.lit(False))


def _bracket(text: Column) -> Column:
    """The bracket that a text begins with; empty without one."""
    return F.when(F.startswith(text, F.lit("(")) & F.contains(text, F.lit(")")), F.concat(F.substring_index(text, ")", 1), F.lit(")"))).otherwise("")


def _behind(text: Column, lead: Column) -> Column:
    return F.ltrim(F.substr(text, F.length(lead) + 1))


def is_remark(text: Column) -> Column:
    """Whether what follows a tier line's type is a stat and no sentence: behind a separator, two words at most and then
    a number, before which a colon may stand."""

    def tokens(part: Column) -> Column:
        return F.filter(F.split(F.translate(part, ";,", "  "), r"\s+"), lambda w: w != "")

    def read(halves: Column) -> Column:
        said, told = tokens(F.get(halves, F.lit(0))), tokens(F.get(halves, F.lit(1)))
        words = F.when(told.isNull(), F.slice(said, F.lit(1), F.greatest(F.size(said) - 1, F.lit(0)))).otherwise(said)
        values = F.when(told.isNull(), F.slice(F.reverse(said), 1, 1)).otherwise(told)
        plain = F.forall(words, lambda w: only(F.upper(w), LETTERS)) & (F.size(words) <= 2)
        return plain & (F.size(values) == 1) & only(F.rtrim(F.get(values, F.lit(0)), F.lit(".")), DIGITS)

    return F.substr(text, F.lit(1), F.lit(1)).isin(";", ",") & F.coalesce(one(F.split(F.substr(text, F.lit(2)), ":", 2), read), F.lit(False))


def feature_heading(line: Column) -> Column:
    """``name, kind, rest`` of ``Name - Kind: rest``; the name goes up to the first spaced dash with a kind behind it."""

    def read(parts: Column) -> Column:
        kind = lambda p: F.initcap(strip(F.substring_index(p, ":", 1)))
        fits = F.transform(parts, lambda p, i: (i > 0) & F.contains(p, F.lit(":")) & kind(p).isin(V.FEATURE_TYPES))


        def at(place: Column) -> Column:
            name = F.array_join(F.slice(parts, F.lit(1), F.greatest(place - 1, F.lit(0))), " - ")
            told = F.element_at(parts, F.greatest(place, F.lit(1)))
            more = F.array_join(F.concat(F.array(F.substr(told, F.instr(told, F.lit(":")) + 1)), rest(parts, F.greatest(place, F.lit(1)) + 1)), " - ")
            return F.when((place > 0) & F.length(name).between(1, NAME_OF_FEATURE), F.struct(strip(name).alias("name"), kind(told).alias("kind"), strip(more).alias("rest")))

        return one(F.array_position(fits, F.lit(True)).cast("int"), at)

    spaced = F.translate(line, "–—", "--")
    return F.when(F.contains(spaced, F.lit("-")) & F.contains(line, F.lit(":")), one(F.split(spaced, r"\s+-\s+", -1), read))


def weapon_line(line: Column) -> Column:
    """``weapon_name, range, damage`` of ``Name: Range | damage`` (or a hyphen); null for other lines."""

    def read(v: Column) -> Column:
        low = F.lower(v)
        reach = F.coalesce(*[F.when(F.startswith(low, F.lit(r.lower())), F.lit(len(r))) for r in V.REACHES])
        behind = F.ltrim(F.substr(v, reach + 1))
        words = F.split(F.ltrim(F.substr(behind, F.lit(2))), r"\s+")
        stop = F.array_position(F.transform(words, lambda w: F.upper(F.substring_index(w, ":", 1)).isin("THRESHOLD", "THRESHOLDS") & F.contains(w, F.lit(":"))), F.lit(True)).cast("int")
        damage = F.array_join(F.when(stop > 1, F.slice(words, F.lit(1), stop - 1)).otherwise(words), " ")
        return F.when(F.substr(behind, F.lit(1), F.lit(1)).isin("-", "|"), F.struct(strip(F.substring_index(line, ":", 1)).alias("weapon_name"), F.substr(v, F.lit(1), reach).alias("range"), strip(damage).alias("damage")))

    return F.when(F.instr(line, F.lit(":")) > 1, one(F.ltrim(F.substr(line, F.instr(line, F.lit(":")) + 1)), read))


def modifier_of(text: Column, bare_die: bool = False) -> Column:
    """The modifier that a text is: a number or dice with a number, each perhaps signed; a hyphen for every minus.

    Null for all else. ``bare_die``: a signed one may begin with the die.
    """

    def read(t: Column) -> Column:
        signed = F.substr(t, F.lit(1), F.lit(1)).isin("+", "-")
        body = F.when(signed, F.substr(t, F.lit(2))).otherwise(t)
        halves = F.split(body, "d", 3)
        dice, sides = F.get(halves, F.lit(0)), F.split(F.get(halves, F.lit(1)), "[+-]", -1)
        counted = only(dice, DIGITS) | ((dice == "") & signed & (F.size(halves) == 2) if bare_die else F.lit(False))
        rolled = F.coalesce((F.size(sides) <= 2) & F.forall(sides, lambda s: only(s, DIGITS)), F.lit(True))
        return F.when(counted & rolled & (F.size(halves) <= 2), t)

    return one(F.translate(text, "−–—", "---"), read)


def _after(text: Column, word: str) -> Column:
    return rest(F.split(text, rx(rf"\b{word}\b", "i"), -1))


def attack_marks(line: Column) -> Column:
    """``payload, modifier, on_stats`` of a line that names an attack label; null for others.

    ``payload`` is what follows the first label with pipes behind it, unless the line begins as a weapon line; the long
    label needs its colon. ``modifier`` is the first that follows the short label and a colon, ``on_stats`` whether one
    of the stats stands before it.
    """
    short = _after(line, V.ATTACK_LABELS[0])
    long = F.filter(_after(line, V.ATTACK_LABELS[1]), lambda tail: F.startswith(F.ltrim(tail), F.lit(":")))

    def read(tails: Column) -> Column:
        # The first label is the one with most behind it; what comes later in the line is behind it as well.
        size = F.array_max(F.transform(tails, lambda t: F.length(t["whole"])))
        first = one(size, lambda n: F.get(F.filter(tails, lambda t: F.length(t["whole"]) == n), F.lit(0)))

        def payload(first: Column) -> Column:
            told = F.ltrim(first["whole"])
            told = strip(F.when(F.startswith(told, F.lit(":")), F.substr(told, F.lit(2))).otherwise(told))
            before = F.substr(line, F.lit(1), F.length(line) - F.length(first["whole"]) - first["label"])
            return F.when(F.contains(first["whole"], F.lit("|")), one(told, lambda t: F.when(F.contains(t, F.lit("|")) & weapon_line(before).isNull(), t)))

        given = F.filter(F.transform(F.filter(tails, lambda t: F.startswith(t["whole"], F.lit(":")) & (t["label"] == len(V.ATTACK_LABELS[0]))), lambda t: F.struct(modifier_of(F.regexp_extract(F.ltrim(F.substr(t["whole"], F.lit(2))), "^[-+−0-9d]+", 0)).alias("modifier"), F.length(t["whole"]).alias("left"))), lambda g: g["modifier"].isNotNull())

        def made(mark: Column) -> Column:
            stats = F.regexp_replace(F.upper(F.substr(line, F.lit(1), F.length(line) - mark["left"])), r"\s+:", ":")
            beside = one(stats, lambda s: F.exists(F.array(*[F.lit(f"{x.upper()}:") for x in V.STAT_LABELS]), lambda x: F.contains(s, x)))
            return F.struct(one(first, payload).alias("payload"), mark["modifier"].alias("modifier"), (mark.isNotNull() & beside).alias("on_stats"))

        return one(F.get(given, F.lit(0)), made)

    def whole(label: int) -> object:
        return lambda t: F.struct(t.alias("whole"), F.lit(len(V.ATTACK_LABELS[label])).alias("label"))

    tails = F.concat(F.transform(short, whole(0)), F.transform(long, whole(1)))
    # Letters of any case are matched, and the Kelvin sign is a k that has no other capital.
    named = one(F.upper(line), lambda u: F.contains(u, F.lit("ATK")) | F.contains(u, F.lit("ATTACK")) | F.contains(u, F.lit("\u212a")))
    return F.when(F.contains(F.upper(line), F.lit("AT")) & named, one(F.filter(tails, lambda t: t["whole"].isNotNull()), lambda t: F.when(F.size(t) > 0, read(t))))


#: The marks of a line, as they go with it into its block.
TIER_MARK = "struct<tier:int,kind:string,word:string,anchor:boolean>"
HEADING_MARK = "struct<name:string,kind:string,rest:string>"
WEAPON_MARK = "struct<weapon_name:string,range:string,damage:string>"
ATTACK_MARK = "struct<payload:string,modifier:string,on_stats:boolean>"
LINE = f"struct<line_no:int,text:string,style:string,t:string,first:string,tier:{TIER_MARK},heading:{HEADING_MARK},weapon:{WEAPON_MARK},attack:{ATTACK_MARK}>"


def marked(lines: DataFrame) -> DataFrame:
    """``lines`` with ``t`` (the text without outer space) and what blocks are found by: ``first, header, levels, tier``.
    Each step is a column of its own, worked out once."""
    t = F.col("t")
    rows = lines.withColumn("t", strip(F.col("text"))).withColumn("first", first_word(t)).withColumn("_words", F.when(F.col("first") == "TIER", F.split(t, r"\s+", 4)))
    is_tier = (F.col("first") == "TIER") & (F.size("_words") > 1)
    rows = rows.withColumns({"header": section_header(F.col("_words")), "levels": is_level_range(t), "_rest": F.when(is_tier, F.ltrim(F.substr(t, F.lit(5))))})
    rows = rows.withColumn("_number", F.regexp_extract("_rest", "^[0-9]+", 0)).withColumn("_a", _behind(F.col("_rest"), F.col("_number")))
    rows = rows.withColumn("_before", _bracket(F.col("_a"))).withColumn("_b", _behind(F.col("_a"), F.col("_before")))
    rows = rows.withColumn("_word", F.regexp_extract("_b", rx(r"^\w+"), 0)).withColumn("_c", _behind(F.col("_b"), F.col("_word")))
    rows = rows.withColumn("_more", _bracket(F.col("_c"))).withColumn("_d", _behind(F.col("_c"), F.col("_more")))
    known = F.lower("_word").isin([x.lower() for x in V.TYPES])
    kind = F.when(F.col("_word") != "", F.concat_ws(" ", "_word", F.coalesce(F.nullif("_before", F.lit("")), F.nullif("_more", F.lit("")))))
    anchor = known & ((F.col("_d") == "") | is_remark(F.col("_d")))
    tier = F.struct(number(F.nullif("_number", F.lit(""))).alias("tier"), kind.alias("kind"), F.col("_word").alias("word"), anchor.alias("anchor"))
    return rows.withColumn("tier", F.when(F.col("_rest").isNotNull(), tier).cast(TIER_MARK)).drop("_words", "_rest", "_number", "_a", "_before", "_b", "_word", "_c", "_more", "_d")


def told(lines: DataFrame) -> DataFrame:
    """``marked`` lines with ``heading, weapon, attack``. Blocks are found without them, so they are read after lines
    were sorted."""
    t = F.col("t")
    body = F.when(F.startswith(F.upper(t), F.lit(V.FEATURES)), F.ltrim(F.substr(t, F.lit(len(V.FEATURES) + 1)))).otherwise(t)
    return once(lines, {"heading": feature_heading(body).cast(HEADING_MARK), "weapon": weapon_line(t).cast(WEAPON_MARK), "attack": attack_marks(t).cast(ATTACK_MARK)})
