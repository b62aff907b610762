"""Blocks to records: adversaries, places (environments) and rejected blocks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.functions import vocabulary as V
from blockloom.functions.text import base_type
from blockloom.operators import fields as P
from blockloom.operators.blocks import blocks
from blockloom.session import once, settled

ADVERSARY = ["name", "tier", "adversary_type", "description", "motives_tactics", "difficulty", "threshold_minor", "threshold_major", "thresholds_raw", "hp", "stress", "attack", "experience", "features", "source_name", "source_page"]
PLACE = ["name", "tier", "environment_type", "description", "impulses", "difficulty", "potential_adversaries", "features", "source_name", "source_page"]


@dataclass
class Parsed:
    """The three outcomes of a parse; each keeps ``source, page, block`` as its place in reading order."""

    adversaries: DataFrame
    environments: DataFrame
    rejected: DataFrame

    def union(self) -> DataFrame:
        """Both kinds in one table, adversaries first: ``kind, kind_ord`` and the columns of both."""
        a = self.adversaries.withColumns({"kind": F.lit("adversary"), "kind_ord": F.lit(0), "difficulty": F.col("difficulty").cast("string"), "features": _with_questions(F.col("features"))})
        e = self.environments.withColumns({"kind": F.lit("environment"), "kind_ord": F.lit(1)})
        return a.unionByName(e, allowMissingColumns=True)


def _with_questions(features: Column) -> Column:
    return F.transform(features, lambda f: F.struct(f["name"], f["feature_type"], f["description"], F.expr("array()").cast("array<string>").alias("questions"))).cast(f"array<{P.PLACE_FEATURE_TYPE}>")


def _good_name(name: Column) -> Column:
    return (name != "") & (F.length(name) <= V.NAME_LENGTH)


def fields(rows: DataFrame) -> DataFrame:
    """``rows`` (with ``lines, section, section_tier``) with the fields of both kinds, and ``place``.

    Each stage is one selection over the columns of the stage before, so what several fields need is worked out once.
    """
    lines, t, said, place = F.col("lines"), F.col("text"), F.col("said"), F.col("place")
    rows = once(rows, {"text": P.block_text(lines), "name": P.name_of(lines), "_tt": P.tier_mark(lines)})
    rows = once(rows, {"said": P.entries(t), "place": P.is_place(P.tier_keyword(lines), t, F.col("section")), "_th": P.thresholds(t)})
    stops = F.when(place, F.array(*[F.lit(x) for x in V.PLACE_STOPS])).otherwise(F.array(*[F.lit(x) for x in V.STOPS]))
    return once(
        rows,
        {
            "tier": F.coalesce("_tt.tier", "section_tier"),
            "adversary_type": F.col("_tt.kind"),
            "environment_type": F.nullif(base_type(F.col("_tt.kind")), F.lit("")),
            "description": P.description(lines, F.col("name"), stops),
            "motives_tactics": P.motives(lines, t),
            "impulses": P.field(said, "Impulses"),
            "difficulty": P.difficulty(t),
            "place_difficulty": P.place_difficulty(said),
            "potential_adversaries": P.field(said, "Potential Adversaries"),
            "threshold_minor": F.col("_th.minor"),
            "threshold_major": F.col("_th.major"),
            "thresholds_raw": F.col("_th.raw"),
            "hp": P.stat(t, "HP"),
            "stress": P.stat(t, "Stress"),
            "attack": P.attack(lines),
            "experience": P.field(said, "Experience"),
            "features": P.features(lines, place),
        },
    ).drop("_tt", "_th", "said")


def outcome() -> Column:
    """What a row of ``fields`` is: a record of either kind if it has what one must have, else rejected."""
    there = _good_name(F.col("name")) & F.col("tier").isNotNull() & (F.size("features") > 0)
    fighter = (F.coalesce("adversary_type", F.lit("")) != "") & F.col("difficulty").isNotNull() & F.col("hp").isNotNull() & F.col("stress").isNotNull()
    spot = F.col("environment_type").isNotNull() & F.col("place_difficulty").isNotNull()
    return F.when(F.coalesce(there & F.col("place") & spot, F.lit(False)), "environment").when(F.coalesce(there & ~F.col("place") & fighter, F.lit(False)), "adversary").otherwise("rejected")


KEYS = ["source", "page", "block"]
#: Blocks that stand up alone up to which their keys are broadcast.
BROADCAST_KEYS = 100_000


def candidates(found: DataFrame) -> DataFrame:
    """Blocks with the lines that go on after the page break joined on, in one or two versions.

    The head of a page that has blocks of its own always belongs to the block before. A page without any does only if
    it opens in mid-sentence or on a feature, or if the block does not stand up without it: such a block is ``asked``
    and comes without the tail (version 0) and with it (1).
    """
    has_tail = F.coalesce(F.size("tail") > 0, F.lit(False))
    asked = has_tail & F.col("bare") & ~F.col("opens")
    longer = F.concat("lines", "tail")
    versions = F.when(asked, F.array("lines", longer)).when(has_tail, F.array(longer)).otherwise(F.array("lines"))
    rows = found.withColumn("asked", asked).select(*KEYS, "section", "section_tier", "asked", F.posexplode(versions).alias("version", "lines"))
    return rows


def parsed_blocks(found: DataFrame) -> DataFrame:
    """One row a block: its fields and ``outcome``. Both versions of an asked block are parsed in the same pass, which is
    written; then the one that counts is chosen."""
    rows = fields(candidates(found))
    rows = rows.withColumn("opening", rejected_line(F.col("page"), F.col("lines"))).drop("lines", "text", "section", "section_tier")
    rows = settled(rows.withColumn("outcome", outcome()))
    alone = rows.where("asked AND version = 0 AND outcome <> 'rejected'").select(*KEYS, F.lit(True).alias("alone"))
    n = alone.count()
    if not n:
        return rows.where("NOT asked OR version = 1").drop("asked", "version")
    chosen = rows.join(F.broadcast(alone) if n <= BROADCAST_KEYS else alone, KEYS, "left")
    return chosen.where("NOT asked OR version = if(alone, 0, 1)").drop("asked", "version", "alone")


def rejected_line(page: Column, lines: Column) -> Column:
    """A rejected block by its page and first two lines with text."""
    said = F.filter(F.transform(lines, lambda x: x["t"]), lambda s: s != "")
    return F.concat(F.lit("p"), page.cast("string"), F.lit(": "), F.when(F.size(said) > 0, F.array_join(F.slice(said, 1, 2), " / ")).otherwise("(empty)"))


def outcomes(rows: DataFrame) -> Parsed:
    """The outcomes of a table of parsed blocks, which may be a written one."""
    rows = rows.withColumns({"source_name": F.col("source"), "source_page": F.col("page")})
    plain = F.transform("features", lambda f: F.struct(f["name"].alias("name"), f["feature_type"].alias("feature_type"), f["description"].alias("description")))
    a = rows.where("outcome = 'adversary'").withColumn("features", plain.cast(f"array<{P.FEATURE_TYPE}>"))
    e = rows.where("outcome = 'environment'").withColumn("difficulty", F.col("place_difficulty"))
    r = rows.where("outcome = 'rejected'").select(*KEYS, F.col("opening").alias("description"))
    return Parsed(a.select(*KEYS, *ADVERSARY), e.select(*KEYS, *PLACE), r)


def parse_lines(lines: DataFrame) -> Parsed:
    """Adversaries, environments and rejected blocks of ``source, page, line_no, text, style``.

    ``source`` names the records' source. The blocks and then all outcomes in one table are written to the checkpoint
    folder; the outcomes are parts of that table.
    """
    return outcomes(parsed_blocks(blocks(lines)))
