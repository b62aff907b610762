"""Markdown files to adversary records, in both layouts: one record a file, or many under second-level headings.

A text is read as lines. A line is told by how it begins (heading, quote, stars, rule); what it says is taken apart at
its stars, bars and colons. No pattern spans lines: a field that goes on over lines is the lines up to the next mark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockloom.functions.regex import found, nothing, number, one, rest, rx, strip
from blockloom.functions.text import clean_text, number_pair, source_of_footer
from blockloom.operators.fields import ATTACK, FEATURE_TYPE, attack_of_parts

# Labels of a record, as Markdown files print them.
DIFFICULTY, THRESHOLDS, HP, STRESS, ATK, EXPERIENCE, TIER, FEATURES = "Difficulty", "Thresholds", "HP", "Stress", "ATK", "Experience", "Tier", "FEATURES"
MOTIVES = ["Motives & Tactics", "Motives and Tactics"]
RULE, FOOTERS = "---", ["*Source:", "*This stat block is"]
#: What a heading in capitals is made of.
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ :-'\t"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _begins(line: Column, *marks: str) -> Column:
    out = F.startswith(line, F.lit(marks[0]))
    for m in marks[1:]:
        out = out | F.startswith(line, F.lit(m))
    return out


def _at(lines: Column, test) -> Column:
    """The place (from 1) of the first line that passes; 0 if none does."""
    return F.array_position(F.transform(lines, lambda s: F.coalesce(test(s), F.lit(False))), F.lit(True)).cast("int")


def _from(lines: Column, place: Column) -> Column:
    return F.slice(lines, F.greatest(place, F.lit(1)), F.greatest(F.size(lines), F.lit(1)))


def _until(lines: Column, test) -> Column:
    """The lines before the first that passes."""
    return one(_at(lines, test), lambda n: F.when(n > 0, F.slice(lines, F.lit(1), n - 1)).otherwise(lines))


def _first(items: Column) -> Column:
    return F.get(F.filter(items, lambda x: x.isNotNull()), F.lit(0))


def _last(items: Column) -> Column:
    """The last item that is not null, as later lines overwrite earlier ones."""
    return F.try_element_at(F.filter(items, lambda x: x.isNotNull()), F.lit(-1))


def _bound(use, **values: Column) -> Column:
    """``use`` of a struct that holds the values, each worked out once."""
    return one(F.struct(*[v.alias(n) for n, v in values.items()]), use)


def starred(text: Column) -> Column:
    """``stars, inner, rest`` of a text that begins with up to three stars and has as many again; null otherwise."""

    def cut(v: Column) -> Column:
        body = F.substr(v["text"], v["n"] + 1)
        close = lambda w: F.when(w["close"] > 1, F.struct(v["n"].alias("stars"), F.substr(body, F.lit(1), w["close"] - 1).alias("inner"), F.substr(body, w["close"] + v["n"]).alias("rest")))
        return _bound(close, close=F.instr(body, F.repeat(F.lit("*"), v["n"])))

    return F.when(F.startswith(text, F.lit("*")), _bound(cut, text=text, n=F.length(F.regexp_extract(text, r"^(\*{0,3})", 1))))


def cell(text: Column) -> Column:
    """``label, value`` of a text such as ``**Label:** value`` or ``Label: value``; stars do not count."""
    parts = F.split(F.replace(text, F.lit("**"), F.lit("")), ":", 2)
    return one(parts, lambda p: F.struct(F.trim(F.get(p, F.lit(0))).alias("label"), strip(F.get(p, F.lit(1))).alias("value")))


def cells(line: Column) -> Column:
    return F.transform(F.split(line, r"\|"), cell)


def _value(line: Column, labels: list[str]) -> Column:
    """What a line says after its bold label; null for other lines."""
    return F.coalesce(*[F.when(_begins(line, f"**{label}:**"), strip(F.substr(line, F.lit(len(label) + 6)))) for label in labels])


def is_collection(text: Column) -> Column:
    """Whether more than one second-level heading in capitals stands in the text."""

    def capital(line: Column) -> Column:
        title = strip(F.substr(line, F.lit(3)))
        return F.rlike(line, F.lit(r"^##\s")) & (F.length(title) > 1) & (F.translate(title, CAPITALS, "") == "") & F.rlike(title, F.lit("^[A-Z]"))

    return F.size(F.filter(_lines(text), capital)) > 1


def tier_and_type(text: Column, any_words: bool = False, horde_types: bool = True) -> Column:
    """``tier, kind`` of ``Tier 2 Kind``; nulls where it is none.

    A kind is one word, which ``horde_types`` lets a parenthesis follow, or with ``any_words`` all that follows.
    """
    words = F.split(strip(text), r"\s+", 3)
    tier, kind = number(F.get(words, F.lit(1))), F.nullif(strip(F.get(words, F.lit(2))), F.lit(""))
    more = strip(F.substr(kind, F.instr(kind, F.lit(" "))))
    fits = F.instr(kind, F.lit(" ")) == 0
    if horde_types:
        fits = fits | (_begins(more, "(") & F.endswith(more, F.lit(")")))
    good = (F.lower(F.get(words, F.lit(0))) == TIER.lower()) & tier.isNotNull() & (F.lit(True) if any_words else fits)
    return F.struct(F.when(good, tier).alias("tier"), F.when(good, kind).alias("kind"))


def feature_of(text: Column) -> Column:
    """``name, feature_type, description`` of a text that begins with a starred heading ``name - type``; null otherwise.

    Under two or three stars the colon stands inside them, under one star after them.
    """

    def read(v: Column) -> Column:
        inside = v["s"]["stars"] > 1
        bare = F.when(inside, F.substr(v["kind"], F.lit(1), F.length(v["kind"]) - 1)).otherwise(v["kind"])
        told = F.when(inside, v["s"]["rest"]).otherwise(F.substr(v["s"]["rest"], F.lit(2)))
        good = F.when(inside, F.endswith(v["kind"], F.lit(":"))).otherwise(_begins(v["s"]["rest"], ":")) & (v["name"] != "")
        made = lambda w: F.when(good & (w["bare"] != "") & ~F.contains(w["bare"], F.lit(":")), F.struct(v["name"].alias("name"), w["bare"].alias("feature_type"), strip(told).alias("description")).cast(FEATURE_TYPE))
        return _bound(made, bare=strip(bare))

    def halves(v: Column) -> Column:
        return _bound(read, s=v["s"], name=strip(F.get(v["head"], F.lit(0))), kind=strip(F.get(v["head"], F.lit(1))))

    def head(s: Column) -> Column:
        return F.when(s.isNotNull(), _bound(halves, s=s, head=F.split(F.translate(s["inner"], "–—", "--"), "-", 2)))

    return F.when(F.contains(text, F.lit("*")), one(starred(strip(text)), head))


def _features(body: Column, stars: int, leading: bool) -> Column:
    """The features of these lines: each begins at a line with a heading of so many stars and goes on up to the next.

    ``leading``: what stands before the first such line is read as a feature too, if it begins as one.
    """
    mark = "*" * stars
    opens = lambda s: _begins(s, mark) & ~_begins(s, mark + "*") & feature_of(s).isNotNull()
    item = "array<array<string>>"

    def step(acc: Column, line: Column) -> Column:
        n = F.size(acc)
        new = F.concat(acc, F.array(F.array(line)))
        longer = F.concat(F.slice(acc, F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(F.concat(F.element_at(acc, -1), F.array(line))))
        return F.when(F.coalesce(opens(line), F.lit(False)), new).when(n > 0, longer).otherwise(new if leading else acc)

    blocks = F.aggregate(body, F.expr("array()").cast(item), step)
    return F.filter(F.transform(blocks, lambda b: feature_of(F.array_join(b, "\n"))), lambda f: f.isNotNull())


def _motives(lines: Column, stops: list[str]) -> Column:
    """What follows the label, up to an empty line or one that begins with one of ``stops``; null if neither comes."""
    start = _at(lines, lambda s: _value(s, MOTIVES).isNotNull())

    def read(n: Column) -> Column:
        tail = _from(lines, n)
        ended = _at(F.slice(tail, F.lit(2), F.greatest(F.size(tail), F.lit(1))), lambda s: (s == "") | _begins(s, *stops))
        whole = F.array_join(F.slice(tail, F.lit(1), ended), "\n")
        return F.when((n > 0) & (ended > 0), F.nullif(_value(whole, MOTIVES), F.lit("")))

    return one(start, read)


def single_record(text: Column, horde_types: bool = True) -> Column:
    """The record of a one-record file.

    ``horde_types`` also reads types of several words, such as a horde with its parenthesis.
    """

    is_stats = lambda s: _bold(s, DIFFICULTY) | _bold(s, HP)

    def told(lines: Column, place: Column) -> Column:
        body = F.ltrim(F.array_join(_from(lines, place + 1), "\n"), F.lit(" \t\n"))
        good = lambda s: (place > 0) & (s["stars"] == 1) & (strip(F.substring_index(s["rest"], "\n", 1)) == "") & F.contains(s["rest"], F.lit("\n"))
        return one(starred(body), lambda s: F.when(good(s), strip(s["inner"])))

    def record(v: Column) -> Column:
        lines = v["lines"]
        tt = one(F.array_max(F.transform(v["tiers"], lambda m: m["stars"])), lambda most: tier_and_type(F.get(F.filter(v["tiers"], lambda m: m["stars"] == most), F.lit(0))["inner"], horde_types=horde_types))
        under = [_at(lines, lambda s, k=k: _begins(s, "*" * k + TIER) & (starred(s)["stars"] == k)) for k in (3, 1)]
        said = lambda label, kind: _last(F.transform(v["stats"], lambda c: F.when(c["label"] == label, found(c["value"], kind))))
        of = lambda label: number(said(label, r"^([0-9]+)"))
        line_of = lambda test, label: _last(F.transform(F.filter(v["quoted"], test), lambda s: F.nullif(strip(F.substring_index(s, f"**{label}:**", -1)), F.lit(""))))
        atk = line_of(lambda s: ~is_stats(s) & _bold(s, ATK), ATK)
        experience = line_of(lambda s: ~is_stats(s) & ~_bold(s, ATK) & _bold(s, EXPERIENCE), EXPERIENCE)
        title = F.filter(F.transform(F.filter(lines, lambda s: F.startswith(s, F.lit("#")) & ~F.startswith(s, F.lit("##"))), lambda s: strip(F.substr(s, F.lit(2)))), lambda s: s != "")

        def features(heading: Column) -> Column:
            body = _until(_from(lines, heading + 1), lambda s: (F.trim(s) == RULE) | _begins(s, *FOOTERS))
            return F.when(heading > 0, one(body, lambda b: _features(b, 3, leading=True))).otherwise(nothing(FEATURE_TYPE))

        def filled(w: Column) -> Column:
            pair = lambda p: F.struct(p["minor"].alias("minor"), p["major"].alias("major"), F.when(p["minor"].isNull() | p["major"].isNull(), w["printed"]).alias("raw"))
            return _bound(
                lambda x: F.struct(
                    F.get(title, F.lit(0)).alias("name"),
                    x["tt"]["tier"].alias("tier"),
                    x["tt"]["kind"].alias("adversary_type"),
                    F.coalesce(*[one(u, lambda place: told(lines, place)) for u in under]).alias("description"),
                    _motives(lines, [">", "##"]).alias("motives_tactics"),
                    of(DIFFICULTY).alias("difficulty"),
                    x["th"]["minor"].alias("threshold_minor"),
                    x["th"]["major"].alias("threshold_major"),
                    x["th"]["raw"].alias("thresholds_raw"),
                    of(HP).alias("hp"),
                    of(STRESS).alias("stress"),
                    F.when(w["atk"].isNotNull(), attack_of_parts(w["atk"])).alias("attack"),
                    experience.alias("experience"),
                    one(_at(lines, lambda s: F.startswith(s, F.lit("##")) & (F.upper(F.regexp_replace(s, r"\s", "")) == f"##{FEATURES}")), features).alias("features"),
                    x["source"]["name"].alias("source_name"),
                    x["source"]["page"].alias("source_page"),
                ),
                tt=tt, th=one(number_pair(w["printed"]), pair), source=source_of_footer(text),
            )

        return _bound(filled, atk=atk, printed=said(THRESHOLDS, r"^((?:[0-9]+|None)(?:/(?:[0-9]+|None))?)"))

    def read(v: Column) -> Column:
        marked = F.filter(F.transform(F.filter(v["lines"], lambda s: F.contains(s, F.lit(TIER))), lambda s: starred(strip(s))), lambda m: m.isNotNull())
        tiers = F.filter(marked, lambda m: tier_and_type(m["inner"], horde_types=horde_types)["tier"].isNotNull())
        return _bound(record, lines=v["lines"], tiers=tiers, quoted=v["quoted"], stats=F.flatten(F.transform(F.filter(v["quoted"], is_stats), cells)))

    def quoted(lines: Column) -> Column:
        said = F.filter(F.transform(F.filter(lines, lambda s: _begins(s, ">")), lambda s: strip(F.substr(s, F.lit(2)))), lambda s: s != "")
        return _bound(read, lines=lines, quoted=said)

    return one(_lines(text), quoted)


def _bold(line: Column, label: str) -> Column:
    return F.contains(line, F.lit(f"**{label}:**"))


def collection_record(section: Column) -> Column:
    """The record of one section of a collection, which begins with its name."""

    labels = F.array(*[F.lit(x) for x in (DIFFICULTY, THRESHOLDS, HP, STRESS)])

    def record(v: Column) -> Column:
        lines, bold = v["lines"], F.filter(v["marked"], lambda m: m["stars"] == 2)
        alone = F.filter(v["marked"], lambda m: (m["stars"] == 1) & (F.trim(m["rest"]) == ""))
        atk = _first(F.transform(bold, lambda m: F.when(_begins(m["inner"], f"{ATK}:"), strip(F.substr(m["inner"], F.lit(len(ATK) + 2))))))
        stats = F.get(F.filter(F.transform(F.filter(bold, lambda m: _begins(m["inner"], DIFFICULTY)), lambda m: cells(m["inner"])), lambda c: F.transform(c, lambda x: x["label"]) == labels), F.lit(0))

        def told(w: Column) -> Column:
            text = strip(F.array_join(F.slice(lines, w["tier"] + 1, F.greatest(w["motives"] - w["tier"] - 1, F.lit(0))), "\n"))
            return F.when((w["tier"] > 0) & (w["motives"] > w["tier"]), F.nullif(text, F.lit("")))

        def features(heading: Column) -> Column:
            body = _until(_from(lines, heading + 1), lambda s: _begins(s, RULE))
            return F.when(heading > 0, one(body, lambda b: _features(b, 1, leading=False))).otherwise(nothing(FEATURE_TYPE))

        # Four numbers in a row count, or none of them.
        whole = lambda c: F.when(F.forall(c, lambda x: F.rlike(x["value"], F.lit(r"^[0-9]+(/[0-9]+)?$"))) & F.contains(F.get(c, F.lit(1))["value"], F.lit("/")), F.transform(c, lambda x: x["value"]))

        def filled(w: Column) -> Column:
            return F.struct(
                strip(F.get(lines, F.lit(0))).alias("name"),
                w["tt"]["tier"].alias("tier"),
                w["tt"]["kind"].alias("adversary_type"),
                _bound(told, tier=_at(lines, lambda s: _begins(s, f"*{TIER}")), motives=_at(lines, lambda s: _begins(s, "**Motives"))).alias("description"),
                _motives(lines, [f"**{DIFFICULTY}"]).alias("motives_tactics"),
                number(F.get(w["values"], F.lit(0))).alias("difficulty"),
                w["th"]["minor"].alias("threshold_minor"),
                w["th"]["major"].alias("threshold_major"),
                F.lit(None).cast("string").alias("thresholds_raw"),
                number(F.get(w["values"], F.lit(2))).alias("hp"),
                number(F.get(w["values"], F.lit(3))).alias("stress"),
                F.when(w["atk"].isNotNull(), attack_of_parts(w["atk"])).cast(ATTACK).alias("attack"),
                _first(F.transform(lines, lambda s: F.nullif(_value(s, [EXPERIENCE]), F.lit("")))).alias("experience"),
                one(_at(lines, lambda s: F.startswith(s, F.lit("***")) & (F.upper(strip(s)) == f"***{FEATURES}***")), features).alias("features"),
                F.lit(None).cast("string").alias("source_name"),
                F.lit(None).cast("int").alias("source_page"),
            )

        values = lambda w: _bound(filled, values=w["values"], th=number_pair(F.get(w["values"], F.lit(1))), tt=tier_and_type(F.get(alone, F.lit(0))["inner"], any_words=True), atk=atk)
        return _bound(values, values=one(stats, whole))

    def read(lines: Column) -> Column:
        marked = F.filter(F.transform(F.filter(lines, lambda s: F.contains(s, F.lit("*"))), lambda s: starred(strip(s))), lambda m: m.isNotNull())
        return _bound(record, lines=lines, marked=marked)

    return one(_lines(section), read)


def parse_markdown(files: DataFrame, horde_types: bool = True) -> DataFrame:
    """One row a record of ``files`` (path, text): ``path, record_no`` and an adversary's columns."""
    cleaned = files.select("path", clean_text(F.col("text")).alias("text"))
    sections = rest(F.split(F.col("text"), rx(r"^##\s+", "m"), -1))
    many = F.filter(F.transform(sections, lambda s: F.when(strip(s) != "", collection_record(s))), lambda r: r.isNotNull() & (F.coalesce(r["name"], F.lit("")) != ""))
    records = F.when(is_collection(F.col("text")), many).otherwise(F.array(single_record(F.col("text"), horde_types)))
    return cleaned.select("path", F.posexplode(records).alias("record_no", "r")).select("path", "record_no", "r.*")


def first_records(records: DataFrame) -> DataFrame:
    """The first record of each file, as normalising takes it."""
    w = Window.partitionBy("path").orderBy("record_no")
    return records.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
