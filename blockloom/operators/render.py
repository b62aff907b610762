"""Records to text: readable Markdown, bank files with YAML, properties, library JSON, index tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.functions import vocabulary as V
from blockloom.functions.regex import strip
from blockloom.functions.text import attack_text, display_name, feature_text, source_label, source_tag, thresholds_text, tier_line, yaml_scalar

HARD = "  "


def _given(value: Column) -> Column:
    return F.nullif(value.cast("string"), F.lit(""))


def _line(*parts: Column | str) -> Column:
    """The parts in one line; null (no line) if any is null."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _joined(*lines: Column) -> Column:
    return F.array_join(F.array_compact(F.array(*lines)), "\n")


def _thresholds() -> Column:
    return thresholds_text(F.col("threshold_minor"), F.col("threshold_major"), F.col("thresholds_raw"))


def _attack(part: str) -> Column:
    return F.col(f"attack.{part}")


def _text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def _footer() -> Column:
    label = source_label(F.col("source_name"), F.col("source_page"))
    return F.coalesce(F.concat(F.lit("---\n\n*Source: "), label, F.lit("*\n")), F.lit(""))


def _feature_lines() -> Column:
    items = F.array_join(F.transform("features", lambda f: F.concat(feature_text(f), F.lit("\n"))), "\n")
    return F.when(F.size("features") > 0, F.concat(F.lit("## FEATURES\n\n"), items, F.lit("\n"))).otherwise(F.lit(""))


def readable_adversary() -> Column:
    """A readable Markdown page; lines end in two spaces where the next belongs to the same paragraph."""
    name = F.coalesce(_given(F.upper("name")), F.lit("UNKNOWN"))
    tier = _given(tier_line(F.col("tier"), F.col("adversary_type")))
    attack = _given(attack_text(F.col("attack")))
    stats = F.concat(F.lit("**Difficulty:** "), _text(F.col("difficulty")), F.lit(" | **Thresholds:** "), _thresholds(), F.lit(" | **HP:** "), _text(F.col("hp")), F.lit(" | **Stress:** "), _text(F.col("stress")))
    head = _joined(_line("# ", name, "\n"), _line("***", tier, "***", HARD), _line("*", strip(_given(F.col("description"))), "*", HARD), _line("**Motives & Tactics:** ", _given(F.col("motives_tactics"))))
    quote = _joined(_line("> ", stats, HARD), _line("> **ATK:** ", attack, HARD), _line("> **Experience:** ", _given(F.col("experience"))))
    return F.concat(head, F.lit("\n\n"), quote, F.lit("\n\n"), _feature_lines(), _footer())


def readable_place() -> Column:
    name = F.coalesce(_given(F.upper("name")), F.lit("UNKNOWN"))
    tier = _given(tier_line(F.col("tier"), F.col("environment_type")))
    head = _joined(_line("# ", name, "\n"), _line("***", tier, "***", HARD), _line("*", strip(_given(F.col("description"))), "*", HARD), _line("**Impulses:** ", _given(F.col("impulses"))))
    quote = _joined(_line("> **Difficulty:** ", _text(F.col("difficulty")), HARD), _line("> **Potential Adversaries:** ", _given(F.col("potential_adversaries"))))
    asked = F.transform("features", lambda f: F.concat(feature_text(f), F.when(F.size(f["questions"]) > 0, F.concat(F.lit("\n\n*"), F.array_join(f["questions"], " "), F.lit("*"))).otherwise(F.lit("")), F.lit("\n")))
    features = F.when(F.size("features") > 0, F.concat(F.lit("## FEATURES\n\n"), F.array_join(asked, "\n"), F.lit("\n"))).otherwise(F.lit(""))
    return F.concat(head, F.lit("\n\n"), quote, F.lit("\n\n"), features, _footer())


def _bare_or_quoted(value: Column) -> Column:
    """A YAML scalar of a text that is a number where it can be one."""
    whole = strip(value).try_cast("int").cast("string")
    return F.coalesce(whole, yaml_scalar(_given(value)))


def _pairs(*pairs: tuple[str, Column]) -> Column:
    """``key: value`` lines of the values that are there."""
    return _joined(*[_line(f"{k}: ", v) for k, v in pairs])


def _yaml_items(fields: list[tuple[str, str]], questions: bool = False) -> Column:
    def item(f: Column) -> Column:
        lines = F.array_compact(F.array(*[F.concat(F.lit(f"{k}: "), yaml_scalar(_given(f[c]))) for k, c in fields]))
        if questions:
            asked = F.when(F.size(f["questions"]) > 0, F.concat(F.array(F.lit("questions:")), F.transform(f["questions"], lambda q: F.concat(F.lit("  - "), yaml_scalar(q)))))
            lines = F.concat(lines, F.coalesce(asked, F.expr("array()").cast("array<string>")))
        return F.when(F.size(lines) > 0, F.concat(F.lit("  - "), F.array_join(lines, "\n    "))).otherwise(F.lit("  - {}"))

    return F.when(F.size("features") > 0, F.concat(F.lit("features:\n"), F.array_join(F.transform("features", item), "\n")))


_NUM = lambda c: F.col(c).cast("string")
_STR = lambda c: yaml_scalar(_given(F.col(c)))


def _attack_pairs() -> list[tuple[str, Column]]:
    return [("attack", _bare_or_quoted(_attack("modifier"))), ("weapon", yaml_scalar(_given(_attack("weapon_name")))), ("range", yaml_scalar(_given(_attack("range")))), ("damage", yaml_scalar(_given(_attack("damage"))))]


def _shown_name() -> Column:
    return F.when(_given(F.col("name")).isNotNull(), yaml_scalar(display_name(F.col("name"))))


def adversary_yaml() -> Column:
    body = _pairs(
        ("name", _shown_name()), ("tier", _NUM("tier")), ("type", _STR("adversary_type")), ("desc", _STR("description")), ("difficulty", _NUM("difficulty")), *_attack_pairs(),
        ("thresholds", yaml_scalar(_given(_thresholds()))), ("hp", _NUM("hp")), ("stress", _NUM("stress")), ("xp", _STR("experience")), ("motives", _STR("motives_tactics")),
        ("source", yaml_scalar(source_label(F.col("source_name"), F.col("source_page")))),
    )
    return _joined(_given(body), _yaml_items([("name", "name"), ("type", "feature_type"), ("desc", "description")]))


def place_yaml() -> Column:
    body = _pairs(
        ("name", _shown_name()), ("tier", _NUM("tier")), ("type", _STR("environment_type")), ("desc", _STR("description")), ("difficulty", _bare_or_quoted(F.col("difficulty"))),
        ("impulses", _STR("impulses")), ("potential_adversaries", _STR("potential_adversaries")), ("source", yaml_scalar(source_label(F.col("source_name"), F.col("source_page")))),
    )
    return _joined(_given(body), _yaml_items([("name", "name"), ("type", "feature_type"), ("desc", "description")], questions=True))


def bank_file(yaml: Column) -> Column:
    """A bank file: the display name as title and the record in a fenced block."""
    return F.concat(F.lit("# "), display_name(F.coalesce("name", F.lit(""))), F.lit(f"\n\n```{V.FENCE}\n"), yaml, F.lit("\n```\n"))


def adversary_properties() -> Column:
    """The properties block: filterable values, the source without its page, always the number of features."""
    return F.concat(F.lit("---\n"), _pairs(
        ("name", _shown_name()), ("tier", _NUM("tier")), ("type", _STR("adversary_type")), ("difficulty", _NUM("difficulty")), ("hp", _NUM("hp")), ("stress", _NUM("stress")), *_attack_pairs(),
        ("motives", _STR("motives_tactics")), ("desc", _STR("description")), ("source", _STR("source_name")), ("feature_count", F.size("features").cast("string")),
    ), F.lit("\n---\n"))


def place_properties() -> Column:
    return F.concat(F.lit("---\n"), _pairs(
        ("name", _shown_name()), ("tier", _NUM("tier")), ("type", _STR("environment_type")), ("difficulty", _bare_or_quoted(F.col("difficulty"))), ("impulses", _STR("impulses")),
        ("potential_adversaries", _STR("potential_adversaries")), ("desc", _STR("description")), ("source", _STR("source_name")), ("feature_count", F.size("features").cast("string")),
    ), F.lit("\n---\n"))


def _variant(value: Column) -> Column:
    return F.coalesce(strip(value).try_cast("int").cast("variant"), _given(value).cast("variant"))


def _sparse_features(questions: bool) -> Column:
    def entry(f: Column) -> Column:
        parts = [_given(f["name"]).alias("name"), _given(f["feature_type"]).alias("type"), _given(f["description"]).alias("desc")]
        if questions:
            parts.append(F.when(F.size(f["questions"]) > 0, f["questions"]).alias("questions"))
        return F.struct(*parts)

    return F.when(F.size("features") > 0, F.transform("features", entry))


def library_adversary(tag: str | None = None) -> Column:
    """A sparse JSON object: only values that are there, but always ``xp``."""
    source = F.lit(tag) if tag else source_tag(F.col("source_name"))
    return F.to_json(F.struct(
        _given(F.upper("name")).alias("name"), F.col("tier"), _given(F.col("adversary_type")).alias("type"), _given(F.col("description")).alias("desc"), F.col("difficulty").cast("int").alias("difficulty"), _given(F.col("motives_tactics")).alias("motives"),
        F.col("hp"), F.col("stress"), _variant(_attack("modifier")).alias("attack"), _given(_attack("weapon_name")).alias("weapon"), _given(_attack("range")).alias("range"), _given(_attack("damage")).alias("damage"),
        _given(_thresholds()).alias("thresholds"), _text(F.col("experience")).alias("xp"), source.alias("source"), _sparse_features(False).alias("features"),
    ))


def library_place(tag: str | None = None) -> Column:
    source = F.lit(tag) if tag else source_tag(F.col("source_name"))
    return F.to_json(F.struct(
        _given(F.upper("name")).alias("name"), F.col("tier"), _given(F.col("environment_type")).alias("type"), _given(F.col("description")).alias("desc"), _variant(F.col("difficulty")).alias("difficulty"),
        _given(F.col("impulses")).alias("impulses"), _given(F.col("potential_adversaries")).alias("potential_adversaries"), source.alias("source"), _sparse_features(True).alias("features"),
    ))


def library(adversaries: DataFrame, environments: DataFrame, tag: str | None = None) -> DataFrame:
    """``kind_ord, source, page, block, json``: the entries of the library file, adversaries first."""
    keys = ["source", "page", "block"]
    a = adversaries.select(F.lit(0).alias("kind_ord"), *keys, library_adversary(tag).alias("json"))
    return a.unionByName(environments.select(F.lit(1).alias("kind_ord"), *keys, library_place(tag).alias("json")))
