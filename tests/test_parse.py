"""Plain pages to records: each source is a case, all parsed in one run. Names and texts are invented."""

import pytest

from blockloom.operators.records import parse_lines
from blockloom.sources.pages import lines_from_pages

STATS = "Difficulty: 12 | Thresholds: 8/15 | HP: 4 | Stress: 2\nATK: +2 | Hook: Close | 1d8+2 physical\n"
BODY = "Quick and grey.\nMotives & Tactics: Hide, wait\n" + STATS
FEATURES = "FEATURES\nEdge - Passive: It cuts\ntwice."


def block(name, tier="Tier 1 Skulk", body=BODY, features=FEATURES):
    return f"{name}\n{tier}\n{body}{features}"


CASES = {
    "two": [block("GREY MOTH") + "\n\n" + block("RED MOTH")],
    "none": ["Only prose here.\nTier matters to no one."],
    "place": ["OLD MILL\nTier 2 Exploration\nIt creaks.\nImpulses: Grind, stall\nDifficulty: 11 Potential Adversaries: Rats (Tier 1)\nFEATURES\nWheel - Action: It turns."],
    "no_hp": [block("LOST MOTH", body=BODY.replace("HP: 4 | ", ""))],
    "no_features": [block("BARE MOTH", features="")],
    "pips": [block("PIP MOTH", body="Difficulty: 12 | Thresholds: 8/15\nHP: O O O\nStress: O O\nATK: +2 | Hook: Close | 1d8 phy\n")],
    "pips_before": [block("ODD MOTH", body="HP: 3\nDifficulty: 12 O O O\nStress:\nThresholds: 8/15\nATK: +2 | Hook: Close | 1d8 phy\n")],
    "many_pips": [block("HUGE MOTH", body="HP: 3\nDifficulty: 12" + " O" * 150 + "\nStress:\nThresholds: 8/15\nATK: +2 | Hook: Close | 1d8 phy\n")],
    "many_labels": [block("TOLD MOTH", body="Quick.\n" + "Impulses: x\n" * 10_050 + "Experience: Guard +2\n" + STATS)],
    "minion": [block("TINY MOTH", "Tier 1 Minion", BODY.replace("8/15", "None"))],
    "half": [block("HALF MOTH", body=BODY.replace("8/15", "5/None"))],
    "stress_none": [block("CALM MOTH", body=BODY.replace("Stress: 2", "Stress: None"))],
    "prose_attack": [block("SHY MOTH", body="It flees from attackers.\nAttack when cornered. ATK: -1 | Wing: Far | 1d4 magic\n" + STATS.split("ATK")[0])],
    "weapon_line": [block("WEAPON MOTH", body="Bite: Melee | ATK: +1 | 1d6+2 phy\nDifficulty: 9 Thresholds: 3/6\nHP: 2 Stress: 1\n")],
    "split_line": [block("SPLIT MOTH", body="A tale of ATK: +9 told.\nDifficulty: 9 | HP: 2 | Stress: 1 | ATK: +3\nLong Wing: Very Far - 2d6 physical\nThresholds: 3/6\n")],
    "dice_modifier": [block("DICE MOTH", body=STATS.replace("+2 |", "+2d4+1 |"))],
    "minus": [block("MINUS MOTH", body=STATS.replace("+2 |", "−1 |"))],
    "unsigned": [block("PLAIN MOTH", body=STATS.replace("+2 |", "2 |"))],
    "tier_clause": [block("CLAUSE MOTH", "Tier 1 Skulk; Difficulty 13", BODY.replace("Difficulty: 12 | ", ""))],
    "paren": [block("SWARM ONE", "Tier 4 (10/HP) Horde") + "\n\n" + block("SWARM TWO", "Tier 4 Horde (10/HP)")],
    "prose_tier": [block("REAL MOTH", body="Tier 2 Skulk, such as these hunt alone.\n" + BODY)],
    "break": [block("FIRST MOTH", features=""), FEATURES + "\n\n" + block("SECOND MOTH")],
    "break_header": [block("FIRST MOTH", features=""), "TIER 2 ADVERSARIES\n" + block("SECOND MOTH")],
    "index_page": [block("WHOLE MOTH"), "Index\nMoths, 12\nWings, 14"],
    "mid_sentence": [block("LONG MOTH"), "and then it sleeps."],
    "spilled": [block("SPILL MOTH"), "Echo - Reaction: It rings."],
    "unfinished": [block("OPEN MOTH", features=""), "Some heading\nFEATURES\nEdge - Action: It cuts."],
    "inner_label": ["SAD MILL\nTier 2 Event\nImpulses: Cause distress: panic and noise\nDifficulty: 11\nFEATURES\nWheel - Action: It turns."],
    "special": ["ODD MILL\nTier 2 Event\nImpulses: Spin\nDifficulty: Special (see \"Wheel\")\nFEATURES\nWheel - Action: It turns."],
    "colon_name": ["Moth Lord:\nThe Pale One\nTier 3 Solo\n" + BODY + FEATURES],
    "section_tier": ["TIER 3 ADVERSARIES (LEVELS 5-7)\n" + block("CARRY MOTH", "Tier Skulk")],
    "hyphen": [block("HYPHEN MOTH", features="FEATURES\nEdge - Passive: It goes under-\nground and strikes -\nthen rests.")],
    "furniture": ["12\nADVERSARIES\n" + block("CLEAN MOTH") + "\nPage 12\n3 of 9"],
    "typographic": [block("QUOTE MOTH", features="FEATURES\nInto the Moth’s Web: Part 2 – reaction: It spins.")],
    "experience": [block("WISE MOTH", body="Quick.\nExperience: Guard +2\n" + STATS)],
    "no_experience": [block("RAW MOTH", body="Quick.\nExperience:\n" + STATS)],
}


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(s, i + 1, t) for s, pages in CASES.items() for i, t in enumerate(pages)]
    out = parse_lines(lines_from_pages(spark.createDataFrame(rows, "source string, page int, text string")))
    group = {}
    for kind in ("adversaries", "environments", "rejected"):
        for r in getattr(out, kind).orderBy("source", "page", "block").collect():
            group.setdefault((kind, r.source), []).append(r)
    return lambda source, kind="adversaries": group.get((kind, source), [])


def test_two_blocks_on_a_page(parsed):
    assert [r.name for r in parsed("two")] == ["GREY MOTH", "RED MOTH"]
    r = parsed("two")[0]
    assert (r.tier, r.adversary_type, r.difficulty, r.threshold_minor, r.threshold_major, r.hp, r.stress) == (1, "Skulk", 12, 8, 15, 4, 2)
    assert r.attack.asDict() == {"modifier": "+2", "weapon_name": "Hook", "range": "Close", "damage": "1d8+2 phy"}
    assert (r.description, r.motives_tactics, r.source_page) == ("Quick and grey.", "Hide, wait", 1)
    assert [f.asDict() for f in r.features] == [{"name": "Edge", "feature_type": "Passive", "description": "It cuts twice."}]


def test_nothing_without_anchor(parsed):
    assert not parsed("none") and not parsed("none", "rejected")


def test_place(parsed):
    (r,) = parsed("place", "environments")
    assert (r.name, r.tier, r.environment_type, r.impulses, r.difficulty, r.potential_adversaries) == ("OLD MILL", 2, "Exploration", "Grind, stall", "11", "Rats (Tier 1)")


@pytest.mark.parametrize(("case", "opening"), [("no_hp", "p1: LOST MOTH / Tier 1 Skulk"), ("no_features", "p1: BARE MOTH / Tier 1 Skulk")])
def test_incomplete_blocks_are_named(parsed, case, opening):
    assert not parsed(case) and [r.description for r in parsed(case, "rejected")] == [opening]


def test_pips(parsed):
    assert [(r.hp, r.stress) for c in ("pips", "pips_before") for r in parsed(c)] == [(3, 2), (3, 3)]


def test_no_field_has_a_bound(parsed):
    assert [r.stress for r in parsed("many_pips")] == [150]
    assert [r.experience for r in parsed("many_labels") + parsed("many_labels", "rejected")] == ["Guard +2"]


def test_thresholds(parsed):
    got = [(r.threshold_minor, r.threshold_major, r.thresholds_raw) for c in ("minion", "half") for r in parsed(c)]
    assert got == [(None, None, "None"), (5, None, "5/None")]


def test_no_stress_track(parsed):
    assert parsed("stress_none")[0].stress == 0


@pytest.mark.parametrize(
    ("case", "attack"),
    [
        ("prose_attack", ("-1", "Wing", "Far", "1d4 mag")),
        ("weapon_line", ("+1", "Bite", "Melee", "1d6+2 phy")),
        ("split_line", ("+3", "Long Wing", "Very Far", "2d6 phy")),
        ("dice_modifier", ("+2d4+1", "Hook", "Close", "1d8+2 phy")),
        ("minus", ("-1", "Hook", "Close", "1d8+2 phy")),
        ("unsigned", ("2", "Hook", "Close", "1d8+2 phy")),
    ],
)
def test_attacks(parsed, case, attack):
    assert tuple(parsed(case)[0].attack) == attack


def test_tier_lines(parsed):
    assert parsed("tier_clause")[0].difficulty == 13
    assert [r.adversary_type for r in parsed("paren")] == ["Horde (10/HP)", "Horde (10/HP)"]
    assert [r.name for r in parsed("prose_tier")] == ["REAL MOTH"]
    assert (parsed("section_tier")[0].tier, parsed("section_tier")[0].adversary_type) == (3, "Skulk")


def test_page_breaks(parsed):
    assert [(r.name, r.page, len(r.features)) for r in parsed("break")] == [("FIRST MOTH", 1, 1), ("SECOND MOTH", 2, 1)]
    assert [r.name for r in parsed("break_header")] == ["SECOND MOTH"] and len(parsed("break_header", "rejected")) == 1
    assert parsed("index_page")[0].features[0].description == "It cuts twice."
    assert parsed("mid_sentence")[0].features[0].description == "It cuts twice. and then it sleeps."
    assert [f.name for f in parsed("spilled")[0].features] == ["Edge", "Echo"]
    assert [f.feature_type for f in parsed("unfinished")[0].features] == ["Action"]


def test_fields(parsed):
    assert parsed("inner_label", "environments")[0].impulses == "Cause distress: panic and noise"
    assert parsed("special", "environments")[0].difficulty == 'Special (see "Wheel")'
    assert parsed("experience")[0].experience == "Guard +2" and parsed("no_experience")[0].experience is None


def test_names_and_text(parsed):
    assert parsed("colon_name")[0].name == "Moth Lord: The Pale One"
    assert parsed("hyphen")[0].features[0].description == "It goes underground and strikes - then rests."
    assert len(parsed("furniture")) == 1 and parsed("furniture")[0].features[0].description == "It cuts twice."
    f = parsed("typographic")[0].features[0]
    assert (f.name, f.feature_type) == ("Into the Moth’s Web: Part 2", "Reaction")
