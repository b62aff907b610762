"""Fixed values of the stat-block format."""

# Type keywords of a tier line; those of places only, and those of both kinds.
TYPES = ["Bruiser", "Leader", "Skulk", "Support", "Solo", "Standard", "Ranged", "Horde", "Social", "Minion", "Traversal", "Event", "Exploration"]
PLACE_TYPES = ["traversal", "event", "exploration"]
SHARED_TYPES = ["social"]
# Ranges, feature types, labels that end a field.
REACHES = ["Very Close", "Very Far", "Melee", "Close", "Far"]
FEATURE_TYPES = ["Passive", "Action", "Reaction", "Evolution"]
FIELD_LABELS = ["Impulses", "Motives & Tactics", "Motives and Tactics", "Motives", "Difficulty", "Thresholds", "Threshold", "Potential Adversaries", "ATK", "Attack", "Experience", "HP", "Stress"]
SECTIONS = ["ADVERSARIES", "ENVIRONMENTS"]
ATTACK_LABELS, STAT_LABELS, FEATURES = ["ATK", "Attack"], ["Difficulty", "Threshold", "Thresholds", "HP", "Stress"], "FEATURES"
# First words of lines that end a description, for fighters and for places; starts of lines that end the motives.
STOPS = ["MOTIVES", "IMPULSES", "DIFFICULTY", "THRESHOLD", "THRESHOLDS", "ATK", "FEATURES"]
PLACE_STOPS = ["IMPULSES", "MOTIVES", "DIFFICULTY", "POTENTIAL", "FEATURES"]
MOTIVES_STOPS = ["THRESHOLD:", "THRESHOLDS:", "ATK:", "DIFFICULTY:", "EXPERIENCE:", "FEATURES"]
# Page furniture (each at the start of a stripped line, any case).
FURNITURE = [r"\d+\s*$", r"Page\s+\d+", r"\d+\s+of\s+\d+", r"ADVERSARIES?\s*$", r"DAGGERHEART\s*$", r"SRD\s*$"]
FOOTER = r"\d*\s*Chapter\s+\d+:"
# Private-use digits: 0 at U+E53F, 1 to 9 from U+E541.
PRIVATE_DIGITS = chr(0xE53F) + "".join(chr(0xE540 + n) for n in range(1, 10))
# Fonts by role, the least size of a heading, layout ratios.
ART_FONTS, HEADING_FONTS = ["EllisHandRegular"], ["EvelethCleanRegular"]
TIER_FONTS, QUESTION_FONTS = ["QuestaSlab-BoldItalic"], ["QuestaSlab-Italic"]
HEADING_SIZE, SPACE_RATIO, LINE_RATIO, GAP_SHARE, GAP_ZONE = 10.0, 0.11, 0.30, 0.03, (0.2, 0.8)
# Source tags by display name, and the tag without a source.
SOURCE_TAGS = {
    "Age of Umbra Adversaries": "age-of-umbra",
    "Martial Adversaries": "martial",
    "Undead Adversaries": "undead",
    "Adversaries: Environments v1.5": "environments",
    "Menagerie of Mayhem": "menagerie",
    "Daggerheart System Reference Document": "corebook",
    "Hope and Fear": "hope-and-fear",
}
NO_SOURCE = "homebrew"
# Known sources in order: file, display name, kind.
SOURCE_CATALOG = [
    ("Age-of-Umbra-Adversaries.pdf", "Age of Umbra Adversaries", "pdf"),
    ("Adversaries-Environments-v1.5-.pdf", "Adversaries: Environments v1.5", "pdf"),
    ("Menagerie_of_Mayhem-MUnderwood.md", "Menagerie of Mayhem", "md"),
    ("martialadversaries-compressed.pdf", "Martial Adversaries", "pdf"),
    ("undeadadversaries-compressed.pdf", "Undead Adversaries", "pdf"),
]
# Anchors that head sections rather than records.
ANCHOR = "define-adversary-"
SECTION_ANCHORS = ["action", "action-list", "benchmarks", "benchmarks-experiences", "benchmarks-hit-points", "type", "feature", "conditions", "fear-features", "fear-gain", "hope-loss", "passive-list", "reaction-list"]
SECTION_ANCHOR_START = "benchmarks-type-"
# Apostrophes inside words, and endings that stay in lower case after one.
APOSTROPHES = "'‘’ʼ`´"
CONTRACTIONS = ["s", "t", "d", "m", "ll", "re", "ve"]
NAME_LENGTH, FILE_LENGTH, NO_NAME = 120, 120, "unknown"
# Files that are no record, by name; the fence of a bank file; link slugs that differ from the name.
SKIPPED_FILES = ["_SAMPLE.md", "Adversaries_Master_Index.md", "Adversaries_Index.md", "Adversaries_By_Type.md", "README.md", "CLAUDE.md"]
# Columns of the browsing table by kind of filter, and those it leaves out.
DROPDOWNS, EXACT, RANGES, TEXTS, LEFT_OUT = ["tier", "type", "difficulty"], ["atk_bonus"], ["hp", "stress", "low_threshold", "high_threshold"], ["damage_dice"], ["battle_points"]
NEVER_NUMERIC = ["name", "damage_dice"]
FENCE = "daggerheart"
SLUG_OVERRIDES = {"Outer Realms Corrupter": "outer-realms-corruptor"}
# Words that extraction splits, damage kinds before the word damage, damage words and what stands for them.
SPLIT_WORDS = [("Diffi", "culty"), ("fl", "ail")]
DAMAGE_KINDS = ["phy", "mag"]
DAMAGE_WORDS = {"physical": "phy", "magic": "mag", "magical": "mag"}
# A source's display name by what its file name holds or begins with, spaces left out.
SOURCE_WORDS = {"Adversaries Environments": "Adversaries: Environments"}
SOURCE_PARTS = {"martialadversaries": "Martial Adversaries", "undeadadversaries": "Undead Adversaries", "hopeandfear": "Hope and Fear"}
SOURCE_STARTS = {"hf": "Hope and Fear"}
