"""Cleaning, naming and small parsers, as Column functions."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from blockloom.functions import vocabulary as V
from blockloom.functions.regex import found, has, nothing, number, one, strip, sub


def decode_digits(text: Column) -> Column:
    """Digits that display fonts put into the private use area; other private characters stay."""
    return F.translate(text, V.PRIVATE_DIGITS, "0123456789")


def is_furniture(line: Column, footer: bool = True) -> Column:
    """Whether a line is a folio, running head or (with ``footer``) running foot. Blank lines are not."""
    patterns = [*V.FURNITURE, *([V.FOOTER] if footer else [])]
    return has(strip(line), "^(?:" + "|".join(patterns) + ")", "i")


def drop_furniture(text: Column) -> Column:
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda s: ~is_furniture(s, footer=False)), "\n")


def mend_scan_errors(text: Column) -> Column:
    """Words that extraction splits, spelt-out damage types, and the three dashes as hyphens; curly quotes stay."""


    def mended(text: Column) -> Column:
        for head, tail in V.SPLIT_WORDS:
            text = sub(text, rf"{head}\s*{tail}", head + tail)
        for kind in V.DAMAGE_KINDS:
            text = sub(text, rf"\b{kind}\s+damage\b", kind)
        return text

    # Most texts have none of the words that are looked for, which is told faster than by patterns.
    marks = [head for head, _ in V.SPLIT_WORDS] + ["damage"]
    known = lambda t: reduce(lambda a, b: a | b, [F.contains(t, F.lit(m)) for m in marks])
    return F.translate(one(text, lambda t: F.when(known(t), mended(t)).otherwise(t)), "–—−", "---")


def even_space(text: Column) -> Column:
    """One space for each run that has no line end, none at the end of a line, at most one empty line."""
    text = sub(text, r"[^\S\n]+", " ")
    return sub(sub(text, r" +(?=\n|\z)", ""), r"\n{3,}", "\n\n")


def rejoin_words(text: Column) -> Column:
    return sub(text, r"(\w)-\n(\w)", "$1$2")


def clean_text(text: Column) -> Column:
    """All of the above in order, after a byte order mark; null becomes empty."""
    text = sub(F.coalesce(text, F.lit("")), "^﻿+", "")
    return rejoin_words(even_space(mend_scan_errors(drop_furniture(text))))


def damage_type(text: Column) -> Column:
    text = sub(strip(text), r"\s+", " ")
    for old, new in V.DAMAGE_WORDS.items():
        text = sub(text, rf"\b{old}\b", new, "i")
    return text


def first_number(text: Column) -> Column:
    return number(found(text, r"(\d+)"))


def number_pair(text: Column) -> Column:
    """``minor, major`` of a pair such as 8/15; nulls without one."""
    return F.struct(*[number(found(text, r"(\d+)\s*/\s*(\d+)", i)).alias(n) for i, n in ((1, "minor"), (2, "major"))])


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _window_hashes(codes: np.ndarray, window: int) -> np.ndarray:
    """A 64-bit hash of each run of ``window`` codes: of two runs half as long, and for odd lengths the last code."""
    if window == 1:
        return codes
    half = _window_hashes(codes, window // 2)
    n = len(codes) - window + 1
    out = _mixed(half[:n], half[window // 2 : window // 2 + n])
    return _mixed(out, codes[window - 1 :]) if window % 2 else out


def _repeat_place(text: str | None, window: int) -> int | None:
    """Where, from 1, the second half first has the first of the first half's stretches (each begins half a window behind
    the one before) that it has at all. Hashes of all windows say which stretches after the first are compared as text."""
    mid = len(text or "") // 2
    if mid <= window:
        return None
    first = text.find(text[:window], mid)
    if first >= 0:
        return first - mid + 1
    codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    starts = np.arange(0, mid - window, window // 2)
    asked, there = _window_hashes(codes[:mid], window)[starts], _window_hashes(codes[mid:], window)
    bits = np.uint64((1 << (16 * len(starts)).bit_length()) - 1)
    table = np.zeros(int(bits) + 1, dtype=bool)
    table[asked & bits] = True
    known = np.isin(asked, there[table[there & bits]])
    places = (text.find(text[i : i + window], mid) - mid + 1 for i in starts[known].tolist())
    return next((p for p in places if p > 0), None)


@cache
def _repeat_places(window: int):
    @F.pandas_udf("int")
    def places(texts: pd.Series) -> pd.Series:
        return pd.Series([_repeat_place(t, window) for t in texts], dtype="Int32")

    return places


def without_repeated_half(text: Column, window: int = 100) -> Column:
    """The text up to where its second half repeats a stretch of the first (columns read twice).

    Work is in proportion to the text: its windows are hashed once, in Python tasks.
    """
    mid = F.floor(F.length(text) / 2).cast("int")
    cut = _repeat_places(window)(text)
    return F.when((F.length(text) < 2 * window) | cut.isNull(), text).otherwise(strip(F.substr(text, F.lit(1), mid + cut - 1)))


# --- names ---------------------------------------------------------------------------------------------------------


@cache
def _plain_letters() -> str:
    """Characters that stand for ASCII letters or digits once they are decomposed, with these; and marks, with nothing.

    Worked out from the Unicode tables; a text of pairs, as ``str_to_map`` reads it.
    """
    pairs = []
    for c in map(chr, range(0x80, sys.maxunicode + 1)):
        plain = "".join(p for p in unicodedata.normalize("NFKD", c) if not unicodedata.combining(p)) if not 0xD800 <= ord(c) < 0xE000 else c
        if plain != c and (plain == "" or re.search("[A-Za-z0-9]", plain)):
            pairs.append(f"{c}\x02{plain}")
    return "\x01".join(pairs)


def safe_filename(name: Column) -> Column:
    """A stem of ASCII letters, digits and underscores: accents dropped, each word capitalised, 120 characters at most.

    Characters outside ASCII are looked up one by one, so nothing leaves the JVM.
    """
    known = F.str_to_map(F.lit(_plain_letters()), F.lit("\x01"), F.lit("\x02"))
    characters = F.regexp_extract_all(name, F.lit("(?s)(.)"), F.lit(1))
    ascii_ = F.array_join(F.transform(characters, lambda c: F.when(F.octet_length(c) > 1, F.coalesce(F.try_element_at(known, c), c)).otherwise(c)), "")
    plain = F.when(has(name, r"[^\x00-\x7F]"), ascii_).otherwise(name)
    words = F.filter(F.split(F.regexp_replace(F.translate(plain, V.APOSTROPHES, ""), "[^A-Za-z0-9]+", "_"), "_"), lambda w: w != "")
    titled = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substr(w, F.lit(1), F.lit(1))), F.lower(F.substr(w, F.lit(2))))), "_")
    capped = F.regexp_replace(F.substr(titled, F.lit(1), F.lit(V.FILE_LENGTH)), "_+$", "")
    return F.coalesce(F.nullif(capped, F.lit("")), F.lit(V.NO_NAME))


def _capital(word: Column) -> Column:
    return F.concat(F.upper(F.substr(word, F.lit(1), F.lit(1))), F.lower(F.substr(word, F.lit(2))))


def display_name(name: Column) -> Column:
    """Title case by words of ASCII letters; after an apostrophe only contraction endings stay small."""
    marks = re.escape(V.APOSTROPHES)
    # Pieces: runs of letters, single apostrophes, and all else.
    pieces = F.regexp_extract_all(name, F.lit(rf"([A-Za-z]+|[{marks}]|[^A-Za-z{marks}]+)"), F.lit(1))

    def step(acc: Column, piece: Column) -> Column:
        letters = piece.rlike("^[A-Za-z]")
        tail = (acc["last"] == "mark") & F.lower(piece).isin(V.CONTRACTIONS)
        shown = F.when(letters & tail, F.lower(piece)).when(letters, _capital(piece)).otherwise(piece)
        mark = piece.rlike(f"^[{marks}]$") & (acc["last"] == "word")
        return F.struct(F.concat(acc["out"], shown).alias("out"), F.when(letters, "word").when(mark, "mark").otherwise("other").alias("last"))

    shown = F.aggregate(pieces, F.struct(F.lit("").alias("out"), F.lit("other").alias("last")), step, lambda a: a["out"])
    return F.coalesce(F.nullif(shown, F.lit("")), F.lit("Unknown"))


def slug(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def link_slug(name: Column, overrides: dict[str, str] | None = None) -> Column:
    out = slug(name)
    for known, value in (overrides or {}).items():
        out = F.when(name == known, F.lit(value)).otherwise(out)
    return out


def source_tag(source: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in V.SOURCE_TAGS.items() for x in pair])
    return F.when(F.coalesce(source, F.lit("")) == "", F.lit(V.NO_SOURCE)).otherwise(F.coalesce(F.try_element_at(known, source), slug(source)))


def search_form(text: Column) -> Column:
    """Upper case, only A-Z, 0-9 and single spaces."""
    return strip(sub(sub(F.upper(text), r"[^A-Z0-9\s]", ""), r"\s+", " "))


def source_from_filename(name: Column) -> Column:
    """A source's display name from its file name."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    words = strip(sub(F.translate(stem, "-_", "  "), r"\s+", " "))
    for plain, shown in V.SOURCE_WORDS.items():
        words = F.replace(words, F.lit(plain), F.lit(shown))
    tight = F.replace(F.lower(words), F.lit(" "), F.lit(""))
    out = words
    for part, shown in reversed(V.SOURCE_PARTS.items()):
        out = F.when(F.contains(tight, F.lit(part)), shown).otherwise(out)
    for start, shown in V.SOURCE_STARTS.items():
        out = F.when(F.startswith(tight, F.lit(start)) & ~reduce(lambda a, b: a | b, [F.contains(tight, F.lit(x)) for x in V.SOURCE_PARTS]), shown).otherwise(out)
    return out


def base_type(kind: Column) -> Column:
    return strip(F.substring_index(F.coalesce(kind, F.lit("")), "(", 1))


# --- small renderings -----------------------------------------------------------------------------------------------


def thresholds_text(minor: Column, major: Column, raw: Column) -> Column:
    return (
        F.when(minor.isNotNull() & major.isNotNull(), F.concat_ws("/", minor, major))
        .when(F.coalesce(raw, F.lit("")) != "", raw)
        .when(minor.isNotNull(), F.concat(minor.cast("string"), F.lit("/")))
        .when(major.isNotNull(), F.concat(F.lit("/"), major.cast("string")))
        .otherwise(F.lit(""))
    )


def tier_line(tier: Column, kind: Column) -> Column:
    return F.concat_ws(" ", F.concat(F.lit("Tier "), tier.cast("string")), F.nullif(kind, F.lit("")))


def attack_text(attack: Column) -> Column:
    weapon = F.concat_ws(": ", F.nullif(attack["weapon_name"], F.lit("")), F.nullif(attack["range"], F.lit("")))
    return F.concat_ws(" | ", F.nullif(attack["modifier"], F.lit("")), F.nullif(weapon, F.lit("")), F.nullif(attack["damage"], F.lit("")))


def feature_text(feature: Column) -> Column:
    return F.concat(F.lit("***"), feature["name"], F.lit(" - "), feature["feature_type"], F.lit(":*** "), feature["description"])


def source_label(name: Column, page: Column) -> Column:
    return F.when(F.coalesce(name, F.lit("")) != "", F.concat_ws(", p. ", name, page.cast("string")))


def source_of_footer(text: Column) -> Column:
    """``name, page`` of a closing ``*Source: Name, p. 12*``. A comma in the name is kept."""
    body = found(text, r"\*Source:\s*([^*]+)\*")
    page = number(found(body, r",\s*p\.\s*(\d+)\s*$"))
    return F.struct(strip(sub(body, r",\s*p\.\s*\d+\s*$", "")).alias("name"), page.alias("page"))


def as_number_or_text(value: Column) -> Column:
    """A VARIANT: an integer where the text is one, the text itself otherwise."""
    return F.coalesce(strip(value).try_cast("int").cast("variant"), F.nullif(value, F.lit("")).cast("variant"))


def script_safe(json: Column) -> Column:
    return F.replace(json, F.lit("</"), F.lit("<\\/"))


def html_escape(text: Column) -> Column:
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(name))
    return text


def title_of_column(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def truthy(value: Column) -> Column:
    return F.coalesce(F.lower(strip(value.cast("string"))).isin("true", "1", "yes", "on"), F.lit(False))


def yaml_scalar(value: Column) -> Column:
    """A JSON string, which YAML reads, with the controls that JSON leaves raw but YAML forbids escaped."""
    quoted = F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    bad = "[\\x7F-\\x9F\uFFFE\uFFFF]"
    escaped = F.array_join(F.transform(F.split(quoted, ""), lambda c: F.when(c.rlike(bad), F.format_string("\\u%04x", F.ascii(c))).otherwise(c)), "")
    quoted = F.when(quoted.rlike(bad), escaped).otherwise(quoted)
    return F.when(value.isNotNull(), quoted)

