"""Whole conversions: a source file to record files, index and library; a folder of Markdown normalised in place.

    python -m blockloom.convert convert SOURCE -o FOLDER [--list] [--report] [--readable] [--properties] [--index] [--library FILE] [--response FILE] [--overwrite]
    python -m blockloom.convert normalize FOLDER [--sources TEXTS] [--word-index FOLDER] [--backup] [--dry-run]
    python -m blockloom.convert table SHEET -o FILE [--sort COLUMN] [--descending]
"""

from __future__ import annotations

import argparse
import json
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from blockloom.operators import index, render
from blockloom.operators.catalog import source_catalog, word_index, write_word_index
from blockloom.operators.normalize import normalized
from blockloom.operators.ranking import ranked
from blockloom.operators.records import PLACE, Parsed
from blockloom.operators.validate import adversary_issues, normalize_summary, place_issues, report_summary, validation_report
from blockloom.session import settled
from blockloom.sources import readers, sinks

ORDER = ["kind_ord", "source", "page", "block"]


@dataclass
class Options:
    readable: bool = False
    properties: bool = False
    index: bool = False
    library: str | None = None
    response: str | None = None
    overwrite: bool = False


def read(spark: SparkSession, path: str) -> Parsed:
    """All outcomes of a source; Markdown has adversaries only. Each outcome is settled, as several sinks read it."""
    found = readers.read_stat_blocks(spark, path)
    if isinstance(found, DataFrame):
        rows = found.select(F.col("path").alias("source"), F.col("record_no").alias("page"), F.lit(0).alias("block"), *[c for c in found.columns if c not in ("path", "record_no")])
        text = {"tier": "int", "source_page": "int", "features": "array<struct<name:string,feature_type:string,description:string,questions:array<string>>>"}
        none = spark.createDataFrame([], "source string, page int, block int, " + ", ".join(f"{c} {text.get(c, 'string')}" for c in PLACE))
        return Parsed(settled(rows), none, spark.createDataFrame([], "source string, page int, block int, description string"))
    return Parsed(settled(found.adversaries), settled(found.environments), settled(found.rejected))


def with_issues(p: Parsed) -> DataFrame:
    """Both kinds with ``kind, kind_ord, name, issues`` and their place."""
    keys = ["source", "page", "block", "name", "tier"]
    a = p.adversaries.select(F.lit("adversary").alias("kind"), F.lit(0).alias("kind_ord"), *keys, "adversary_type", adversary_issues().alias("issues"))
    return a.unionByName(p.environments.select(F.lit("environment").alias("kind"), F.lit(1).alias("kind_ord"), *keys, F.col("environment_type").alias("adversary_type"), place_issues().alias("issues")))


def files_of(p: Parsed, options: Options) -> DataFrame:
    """``kind_ord, source, page, block, name, issues, text``: the file of each record."""
    a = render.readable_adversary() if options.readable else render.bank_file(render.adversary_yaml())
    e = render.readable_place() if options.readable else render.bank_file(render.place_yaml())
    if options.properties:
        a, e = F.concat(render.adversary_properties(), a), F.concat(render.place_properties(), e)
    keys = ["source", "page", "block", "name"]
    return p.adversaries.select(F.lit(0).alias("kind_ord"), *keys, adversary_issues().alias("issues"), a.alias("text")).unionByName(p.environments.select(F.lit(1).alias("kind_ord"), *keys, place_issues().alias("issues"), e.alias("text")))


def convert(spark: SparkSession, p: Parsed, folder: str, options: Options) -> dict[str, int]:
    """Writes the files of all records (and what else is asked for) and returns the counts."""
    os.makedirs(folder, exist_ok=True)
    there = [] if options.overwrite else [(f[:-3],) for f in os.listdir(folder) if f.endswith(".md")]
    files = settled(sinks.allocate_names(files_of(p, options), ORDER, spark.createDataFrame(there, "stem string") if there else None))
    # The counts are taken while the files are written.
    written = Observation("written")
    fine = F.size("issues") == 0
    sinks.write_text_files(files.observe(written, F.count_if(F.col("kind_ord") == 0).alias("adversaries"), F.count_if(F.col("kind_ord") == 1).alias("environments"), F.count_if(fine).alias("complete"), F.count_if(~fine).alias("with_issues")), folder)
    if options.index:
        lines = index.master_index(p.adversaries, p.environments).orderBy("line_no")
        sinks.one_file(spark, os.path.join(folder, "Adversaries_Index.md"), [sinks.Part(lines)])
    if options.library:
        sinks.one_file(spark, options.library, sinks.json_array(render.library(p.adversaries, p.environments), ORDER))
    counts = written.get | {"rejected": p.rejected.count()}
    if options.response:
        sinks.one_file(spark, options.response, response(p, files, folder, options, counts))
    return counts


def response(p: Parsed, files: DataFrame, folder: str, options: Options, counts: dict[str, int]) -> list[str | sinks.Part]:
    """The pieces of one JSON object that tells of a conversion."""
    records, rejected = counts["adversaries"] + counts["environments"], counts["rejected"]
    pages = ["Adversaries_Index.md"] if options.index else []
    warnings = with_issues(p).where(F.size("issues") > 0).orderBy(*ORDER)
    lists = {
        "files_written": (F.concat("stem", F.lit(".md")), files.orderBy(*ORDER), records, pages),
        "validation_warnings": (F.struct(F.coalesce(F.nullif("name", F.lit("")), F.lit("UNNAMED")).alias("name"), "issues"), warnings, counts["with_issues"], []),
        "unparsed_blocks": (F.col("description"), p.rejected.orderBy("source", "page", "block"), rejected, []),
    }
    out: list[str | sinks.Part] = [json.dumps({"success": True, "adversary_count": counts["adversaries"], "environment_count": counts["environments"], "library_file": options.library})[:-1]]
    for key, (value, rows, n, more) in lists.items():
        out += [f', "{key}": [', sinks.Part(sinks.dumped(rows.select(F.to_json(F.struct(value.alias("v"))).alias("json"))), ", ")]
        out.append((", " if n and more else "") + ", ".join(json.dumps(x, ensure_ascii=False) for x in more) + "]")
    written = records + len(pages)
    said = [
        (True, f"{counts['adversaries']} adversaries converted."),
        (counts["environments"], f"{counts['environments']} environments converted."),
        (written, f"{written} files written to {folder}."),
        (counts["with_issues"], f"{counts['with_issues']} have validation warnings."),
        (rejected, f"{rejected} of {records + rejected} stat blocks could not be parsed."),
    ]
    return [*out, f', "summary": {json.dumps(" ".join(text for there, text in said if there), ensure_ascii=False)}}}\n']


def source_pages(spark: SparkSession, path: str) -> DataFrame:
    """``pos, source, page, text`` of plain-text sources: known ones in the order of the catalogue, then by name."""
    pages = readers.text_pages(spark, path)
    known = source_catalog(spark).groupBy(F.col("display_name").alias("source")).agg(F.min("pos").alias("at"))
    order = ranked(pages.select("source").distinct().join(known, "source", "left"), [F.col("at").asc_nulls_last(), "source"], name="pos")
    return pages.join(order.select("source", "pos"), "source").select("pos", "source", "page", "text")


def normalize(spark: SparkSession, folder: str, backup: bool = False, dry_run: bool = False, sources: str | None = None, index_at: str | None = None) -> dict[str, int]:
    """Rewrites the record files of a folder that are not in normal form; returns the counts.

    ``sources`` is a file or folder of plain texts; records without a source get the first whose pages name them. With
    ``index_at`` a word index of the texts is written there once; later runs look names up in it and read no texts.
    """
    files = readers.record_files(readers.markdown_files(spark, folder))
    if index_at and not os.path.isdir(index_at) and sources:
        write_word_index(source_pages(spark, sources), index_at)
    if index_at:
        log = settled(normalized(files.select("path", "text"), index=word_index(spark, index_at)))
    else:
        log = settled(normalized(files.select("path", "text"), source_pages(spark, sources) if sources else None))
    if not dry_run:
        sinks.rewrite_files(log.where("changed").select("path", F.col("new_text").alias("text")), backup)
    return normalize_summary(log).first().asDict()


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="blockloom.convert")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("convert")
    one.add_argument("source")
    one.add_argument("-o", "--output", default="output")
    for flag in ("list", "report", "readable", "properties", "index", "overwrite"):
        one.add_argument(f"--{flag}", action="store_true")
    one.add_argument("--library")
    one.add_argument("--response")
    two = commands.add_parser("normalize")
    two.add_argument("folder")
    two.add_argument("--backup", action="store_true")
    two.add_argument("--dry-run", action="store_true")
    two.add_argument("--sources")
    two.add_argument("--word-index")
    three = commands.add_parser("table")
    three.add_argument("sheet")
    three.add_argument("-o", "--output", default="table.html")
    three.add_argument("--title", default="Adversaries")
    three.add_argument("--sort")
    three.add_argument("--descending", action="store_true")
    a = parser.parse_args(args)
    spark = SparkSession.builder.appName("blockloom").getOrCreate()
    if a.command == "normalize":
        print(normalize(spark, a.folder, a.backup, a.dry_run, a.sources, a.word_index))
        return
    if a.command == "table":
        sinks.one_file(spark, a.output, sinks.html_table(readers.sheet(spark, a.sheet), a.title, a.sort, a.descending))
        return
    p = read(spark, a.source)
    if a.list:
        for r in index.listing(with_issues(p), ORDER).orderBy("rn").toLocalIterator():
            print(f"{r.rn}. {r.name} - {r.tier} {r.type}" + (f" ({r.issue_count} issues)" if r.issue_count else ""))
    elif a.report:
        print(report_summary(with_issues(p)).first().summary + "\n\n# Adversary Validation Report\n")
        for r in validation_report(with_issues(p), ORDER).orderBy("rn").toLocalIterator():
            print(r.entry)
    else:
        print(convert(spark, p, a.output, Options(a.readable, a.properties, a.index, a.library, a.response, a.overwrite)))
    for r in p.rejected.orderBy("source", "page", "block").limit(5).collect():
        print(f"not parsed: {r.description}")


if __name__ == "__main__":
    main()
