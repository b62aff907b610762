"""Every stat-block query of the driver contract, by name, with its SQL where SQL can say it.

The tables hold no stat blocks, so blocks are made from their columns (``synth``); the engine parses the text, and the
SQL reads the columns the text was made from.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.functions import text as T
from blockloom.functions import vocabulary as V
from blockloom.operators import blocks, browse, catalog, index, layout, ranking, render, validate
from blockloom.operators.markdown import parse_markdown
from blockloom.operators.normalize import normalized
from blockloom.operators.records import Parsed, parse_lines
from blockloom.plans import synth as S
from blockloom.session import settled, shared_folder
from blockloom.sources import sinks
from blockloom.sources.pages import lines_from_pages

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

_WITH = f"WITH synth AS ({S.SYNTH}), places AS ({S.PLACES}), good AS (SELECT * FROM synth WHERE difficulty IS NOT NULL) "


def query(sql: str | None = None):
    """Registers a query under its function's name; ``sql`` may read ``synth``, ``places``, ``good`` and the tables."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = (_WITH + sql) if "WITH" not in sql[:10] else _WITH.rstrip() + ", " + sql.strip()[5:]
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _parsed(spark: SparkSession, sf_dir: str, head: str = S.HEAD) -> Parsed:
    return parse_lines(lines_from_pages(S.pages(spark, sf_dir, head)))


# --- parsing ---------------------------------------------------------------------------------------------------------


@query("SELECT tier, row_number() OVER (PARTITION BY tier ORDER BY name) AS rn, name, n_features FROM good")
def q_tier_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = settled(_parsed(spark, sf_dir).adversaries.select("page", "block", "tier", "name", F.size("features").alias("n_features")))
    return index.tier_order(rows, ["page", "block"]).select("tier", "rn", "name", "n_features")


@query("SELECT type AS adversary_type, row_number() OVER (PARTITION BY type ORDER BY tier, name) AS rn, tier, name FROM good")
def q_type_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = settled(_parsed(spark, sf_dir).adversaries.select("page", "block", "adversary_type", "tier", "name"))
    return index.type_order(rows, ["page", "block"]).select("adversary_type", "rn", "tier", "name")


@query("""SELECT k AS page, name, tier, type AS adversary_type, 'Item seen in ' || lower(name) AS description, 'Wait, watch' AS motives, difficulty, minor AS threshold_minor, major AS threshold_major,
    CASE WHEN k % 7 IN (0, 1) THEN thresholds END AS thresholds_raw, hp, stress, 'Guard +2' AS experience, n_features, 'book-' || CAST(CAST(floor(k / 100) AS INT) AS STRING) AS source_name FROM good""")
def q_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _parsed(spark, sf_dir).adversaries
    return a.select("page", "name", "tier", "adversary_type", "description", F.col("motives_tactics").alias("motives"), "difficulty", "threshold_minor", "threshold_major", "thresholds_raw", "hp", "stress", "experience", F.size("features").alias("n_features"), "source_name")


@query("SELECT k AS page, 'p' || CAST(k AS STRING) || ': ' || name || ' / Tier ' || CAST(tier AS STRING) || ' ' || type AS description FROM synth WHERE difficulty IS NULL")
def q_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).rejected.select("page", "description")


@query("SELECT k AS page, thresholds FROM good")
def q_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _parsed(spark, sf_dir).adversaries
    return a.select("page", T.thresholds_text(F.col("threshold_minor"), F.col("threshold_major"), F.col("thresholds_raw")).alias("thresholds"))


@query("SELECT hp, k % 2 = 1 AS pips, count(*) AS n FROM good GROUP BY ALL")
def q_pips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).adversaries.groupBy("hp", (F.col("page") % 2 == 1).alias("pips")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT k AS page, modifier, CASE WHEN modifier LIKE '%d%' THEN '"' || modifier || '"' ELSE CAST(CAST(modifier AS INT) AS STRING) END AS shown, 'Hook' AS weapon, 'Very Close' AS "range", '1d6+' || CAST(tier AS STRING) || ' phy' AS damage FROM good""")
def q_attack_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _parsed(spark, sf_dir).adversaries
    return a.select("page", "attack.modifier", F.to_json(T.as_number_or_text(F.col("attack.modifier"))).alias("shown"), F.col("attack.weapon_name").alias("weapon"), "attack.range", "attack.damage")


@query("""SELECT k AS page, modifier, 'Long Hook' AS weapon, 'Very Far' AS "range", '2d6+' || CAST(tier AS STRING) || ' mag' AS damage FROM synth""")
def q_attack_split_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir, S.SPLIT_HEAD).adversaries.select("page", "attack.modifier", F.col("attack.weapon_name").alias("weapon"), "attack.range", "attack.damage")


@query("""SELECT k AS page, i AS pos, CASE i WHEN 0 THEN 'Edge' WHEN 1 THEN 'Phase 1: Trap' ELSE 'Echo' END AS name, CASE i WHEN 0 THEN 'Passive' WHEN 1 THEN 'Action' ELSE 'Reaction' END AS feature_type,
    CASE i WHEN 0 THEN 'It cuts twice.' WHEN 1 THEN 'It shuts.' ELSE 'It rings.' END AS description FROM good, (SELECT unnest(range(3))::INT AS i) WHERE i < n_features""")
def q_features_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).adversaries.select("page", F.posexplode("features").alias("pos", "f")).select("page", "pos", "f.name", "f.feature_type", "f.description")


@query("""SELECT k AS page, name, tier, kind AS environment_type, 'A windy stretch of road.' AS description, 'Delay, divert' AS impulses, difficulty, potential AS potential_adversaries, 2 AS n_features,
    CASE n_questions WHEN 0 THEN '' WHEN 1 THEN 'What does the wind carry?' ELSE 'What does the wind carry?;Who hears it?' END AS questions, 'The wind turns.' AS first_text FROM places""")
def q_environments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = parse_lines(S.styled_places(spark, sf_dir)).environments
    first = F.element_at("features", 1)
    return e.select("page", "name", "tier", "environment_type", "description", "impulses", "difficulty", "potential_adversaries", F.size("features").alias("n_features"), F.array_join(first["questions"], ";").alias("questions"), first["description"].alias("first_text"))


@query("""SELECT k AS page, CASE WHEN k % 3 = 0 THEN 'environment' WHEN k % 3 = 1 THEN 'adversary' WHEN k % 2 = 0 THEN 'environment' ELSE 'rejected' END AS outcome FROM places""")
def q_social_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parse_lines(lines_from_pages(S.social_pages(spark, sf_dir)))
    kinds = [(p.adversaries, "adversary"), (p.environments, "environment"), (p.rejected, "rejected")]
    a, b, c = (d.select("page", F.lit(k).alias("outcome")) for d, k in kinds)
    return a.unionByName(b).unionByName(c)


@query("SELECT CAST(floor(k / 5) AS INT) AS page, name, n_features, tier FROM good")
def q_page_continuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_lines(lines_from_pages(S.broken_pages(spark, sf_dir))).adversaries.select("page", "name", F.size("features").alias("n_features"), "tier")


@query("SELECT CAST(floor(k / 5) AS INT) AS page, count(*) AS n_blocks, CAST(floor(k / 20) AS INT) * 4 % 3 + 1 AS section_tier FROM synth GROUP BY ALL")
def q_section_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = blocks.blocks(lines_from_pages(S.broken_pages(spark, sf_dir)))
    return found.groupBy("page", "section_tier").agg(F.count(F.lit(1)).alias("n_blocks")).select("page", "n_blocks", "section_tier")


@query(f"SELECT CAST(floor(k / 10) AS INT) AS f, k % 10 AS record_no, regexp_replace(name, '[^A-Z ]', '', 'g') AS name, tier, split_part(type, ' ', 1) AS adversary_type, coalesce(difficulty, 1) AS difficulty, hp AS threshold_minor, hp + 5 AS threshold_major, hp, stress, modifier, 2 AS n_features, 'It rings.' AS last_text FROM synth")
def q_markdown_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parse_markdown(S.collection_files(spark, sf_dir))
    n = F.regexp_extract("path", r"set-(\d+)", 1).cast("int")
    return rows.select(n.alias("f"), "record_no", "name", "tier", "adversary_type", "difficulty", "threshold_minor", "threshold_major", "hp", "stress", "attack.modifier", F.size("features").alias("n_features"), F.element_at("features", -1)["description"].alias("last_text"))


def _readable_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readable pages of the parsed records, as files; some as bank files, notes, or with loose line ends."""
    k = F.col("page") % 10
    page = F.when(k == 0, render.bank_file(render.adversary_yaml())).when(k == 1, F.lit("# Notes\n\nNothing here.\n")).when(k == 2, F.replace(render.readable_adversary(), F.lit("\n## FEATURES"), F.lit("\n\n\n## FEATURES"))).otherwise(render.readable_adversary())
    return _parsed(spark, sf_dir).adversaries.select(F.concat(F.lit("notes/"), F.col("page").cast("string"), F.lit(".md")).alias("path"), page.alias("text"))


@query("""SELECT k AS page, name, tier, type AS adversary_type, difficulty, minor AS threshold_minor, CASE WHEN k % 7 = 0 THEN 'None' WHEN k % 7 = 1 THEN thresholds END AS thresholds_raw, hp, stress, modifier, 'Guard +2' AS experience, n_features, k AS source_page FROM good WHERE k % 7 <> 1
    UNION ALL SELECT k, name, tier, type, difficulty, NULL, thresholds, hp, stress, modifier, 'Guard +2', n_features, k FROM good WHERE k % 7 = 1""")
def q_markdown_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    loose = F.when(F.col("page") % 10 == 2, F.replace(render.readable_adversary(), F.lit("\n## FEATURES"), F.lit("\n\n\n## FEATURES"))).otherwise(render.readable_adversary())
    rows = parse_markdown(_parsed(spark, sf_dir).adversaries.select(F.concat(F.col("page").cast("string"), F.lit(".md")).alias("path"), loose.alias("text")))
    k = F.regexp_extract("path", r"(\d+)\.md", 1).cast("int")
    return rows.select(k.alias("page"), "name", "tier", "adversary_type", "difficulty", "threshold_minor", "thresholds_raw", "hp", "stress", "attack.modifier", "experience", F.size("features").alias("n_features"), "source_page")


@query("""SELECT count(*) AS total, count(*) FILTER (k % 10 > 1) AS success, count(*) FILTER (k % 10 = 2) AS changed, 0 AS with_issues, 0 AS failed, 0 AS sources_added, count(*) FILTER (k % 10 <= 1) AS skipped FROM good""")
def q_normalize_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.normalize_summary(normalized(settled(_readable_files(spark, sf_dir))))


@query("SELECT k AS page, k % 23 <> 0 AND k % 2 = 1 AND k % 3 = 0 AS source_added, CASE WHEN k % 2 = 0 THEN 'Hope and Fear' WHEN k % 23 <> 0 AND k % 3 = 0 THEN 'Atlas' END AS source_name FROM synth")
def q_sources_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record read back from its page; those without a source get one whose pages name them."""
    named = S.records(spark, sf_dir).withColumn("name", F.coalesce(F.nullif("name", F.lit("")), F.lit("STRAY MOTH")))
    files = settled(named.select(F.concat(F.lit("notes/"), F.col("page").cast("string"), F.lit(".md")).alias("path"), render.readable_adversary().alias("text")))
    pages = S.synth(spark, sf_dir).select(F.lit(1).alias("pos"), F.lit("Atlas").alias("source"), F.col("k").alias("page"), F.when(F.col("k") % 3 == 0, F.concat(F.lit("The "), F.lower("name"), F.lit(", seen."))).otherwise("None seen.").alias("text"))
    log = normalized(files, pages)
    after = parse_markdown(log.select("path", F.coalesce("new_text", F.lit("")).alias("text")).where("text <> ''").unionByName(log.where("new_text IS NULL").select("path").join(files, "path")))
    k = lambda: F.regexp_extract("path", r"(\d+)\.md", 1).cast("int")
    return log.select(k().alias("page"), "source_added").join(after.select(k().alias("page"), F.nullif("source_name", F.lit("")).alias("source_name")), "page")


# --- layout -----------------------------------------------------------------------------------------------------------

_WORDS = """
base AS (SELECT CAST(l_orderkey AS INT) AS page, CAST(l_linenumber AS INT) AS ln, CAST(min(l_partkey) AS INT) AS pk, l_orderkey % 7 = 0 AS spread FROM lineitem GROUP BY l_orderkey, l_linenumber),
placed AS (SELECT *, CASE WHEN spread THEN ln % 4 ELSE ln % 2 END AS c, CASE WHEN spread THEN CAST(floor(ln / 4) AS INT) ELSE CAST(floor(ln / 2) AS INT) END AS r FROM base),
seen AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY page ORDER BY c) - 1 AS INT) AS col FROM placed)
"""


@query("SELECT count(*) FILTER (w < 2 OR pk % 11 <> 0) AS shown, count(*) AS words FROM (SELECT CAST(min(l_partkey) AS INT) AS pk, unnest([0, 1, 2]) AS w FROM lineitem GROUP BY l_orderkey, l_linenumber)")
def q_visible_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = S.words(spark, sf_dir)
    return words.agg(F.count_if(layout.is_visible()).alias("shown"), F.count(F.lit(1)).alias("words"))


@query(f"WITH {_WORDS} SELECT page, ln * 3 + w AS word_no, col FROM seen, (SELECT unnest([0, 1, 2]) AS w) WHERE w < 2 OR pk % 11 <> 0")
def q_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.columns(layout.visible_words(S.words(spark, sf_dir)).select("source", "page", "page_w", "page_h", "word_no", "x0")).select("page", "word_no", "col")


@query(f"WITH {_WORDS} SELECT page, ln * 3 + w AS word_no, CAST(dense_rank() OVER (PARTITION BY page, col ORDER BY r) - 1 AS INT) AS \"row\" FROM seen, (SELECT unnest([0, 1, 2]) AS w) WHERE w < 2 OR pk % 11 <> 0")
def q_line_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.rows_of_words(layout.visible_words(S.words(spark, sf_dir)).select("source", "page", "page_w", "page_h", "word_no", "x0", "top", "size")).select("page", "word_no", "row")


@query(f"""WITH {_WORDS} SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY col, r) - 1 AS INT) AS line_no, 'Item ' || CAST(pk AS STRING) || CASE WHEN pk % 11 = 0 THEN '' ELSE 'x' END AS text,
    CASE WHEN pk % 3 = 0 THEN 'QUESTION' WHEN length(CAST(pk AS STRING)) + CASE WHEN pk % 11 = 0 THEN 0 ELSE 1 END <= 4 THEN 'HEADING' ELSE 'BODY' END AS style FROM seen""")
def q_line_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.lines_from_words(S.words(spark, sf_dir)).select("page", "line_no", "text", "style")


@query(f"""WITH {_WORDS} SELECT style, count(*) AS n FROM (SELECT CASE WHEN pk % 3 = 0 THEN 'QUESTION' WHEN length(CAST(pk AS STRING)) + CASE WHEN pk % 11 = 0 THEN 0 ELSE 1 END <= 4 THEN 'HEADING' ELSE 'BODY' END AS style FROM seen) GROUP BY style""")
def q_dominant_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.lines_from_words(S.words(spark, sf_dir)).groupBy("style").agg(F.count(F.lit(1)).alias("n"))


# --- text -------------------------------------------------------------------------------------------------------------


@query("SELECT CAST(p_partkey AS INT) AS k, 'Tier ' || CAST(p_partkey AS STRING) || chr(58688) AS text FROM part")
def q_pua_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = F.translate(F.col("p_partkey").cast("string"), "0123456789", V.PRIVATE_DIGITS)
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("k"), T.decode_digits(F.concat(F.lit("Tier "), coded, F.lit(chr(58688)))).alias("text"))


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace('a - b' || chr(10) || regexp_replace(text, '[ \t]+', ' ', 'g') || chr(10) || chr(10) || 'undertow' , ' +(\n|$)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '[–—−]', '-', 'g')) AS digest FROM documents""")
def q_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirty = F.concat(F.lit("﻿12\na \t–  b\nPage 3 of 9\n"), F.col("text"), F.lit("\n\n\n\nSRD\nunder-\ntow"))
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(T.clean_text(dirty)).alias("digest"))


_CAP = "upper(substr(w, 1, 1)) || lower(substr(w, 2))"


@query(f"SELECT CAST(p_partkey AS INT) AS k, array_to_string(list_transform(list_filter(string_split(regexp_replace(p_name || ' é-' || p_brand, '[^A-Za-z0-9é]+', '_', 'g'), '_'), lambda w: w <> ''), lambda w: {_CAP.replace('w,', 'replace(w, chr(233), chr(101)),')}), '_') AS stem FROM part")
def q_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.col("p_name"), F.lit(" é-"), F.col("p_brand"))
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("k"), T.safe_filename(name).alias("stem"))


@query(f"SELECT CAST(p_partkey AS INT) AS k, array_to_string(list_transform(string_split(p_name, ' '), lambda w: {_CAP}), ' ') || '''s O''Brien' AS shown FROM part")
def q_display_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.upper(F.concat(F.col("p_name"), F.lit("'s o'brien")))
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("k"), T.display_name(name).alias("shown"))


@query("SELECT n_nationkey, trim(regexp_replace(lower(n_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM nation")
def q_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "nation").select("n_nationkey", T.slug(F.col("n_name")).alias("slug"))


@query("SELECT doc_id, CASE WHEN coalesce(source, '') = '' THEN 'homebrew' ELSE trim(regexp_replace(lower(source), '[^a-z0-9]+', '-', 'g'), '-') END AS tag FROM documents")
def q_source_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", T.source_tag(F.col("source")).alias("tag"))


@query("SELECT CAST(p_partkey AS INT) AS k, CASE p_partkey % 4 WHEN 0 THEN 'Martial Adversaries' WHEN 1 THEN 'Hope and Fear' WHEN 2 THEN 'Set Adversaries: Environments' ELSE p_name || ' ' || CAST(p_partkey AS STRING) END AS source FROM part")
def q_source_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("p_partkey"), F.col("p_partkey").cast("string")
    file = F.when(k % 4 == 0, F.concat(F.lit("martial-Adversaries_"), n, F.lit(".pdf"))).when(k % 4 == 1, F.concat(F.lit("HF-"), n, F.lit(".md"))).when(k % 4 == 2, F.lit("Set-Adversaries-Environments.pdf")).otherwise(F.concat(F.translate("p_name", " ", "_"), F.lit("--"), n, F.lit(".v.txt")))
    return _table(spark, sf_dir, "part").select(k.cast("int").alias("k"), F.regexp_replace(T.source_from_filename(file), r"\.v$", "").alias("source"))


@query("""SELECT CAST(p_partkey AS INT) AS k, 3 + p_partkey % 5 AS minor, p_size AS major, p_size AS "first", CASE WHEN p_partkey % 2 = 0 THEN '2d6 phy or mag' ELSE '1d4 mag' END AS damage, 'Horde' AS base,
   'Tier ' || CAST(p_partkey % 4 + 1 AS STRING) || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ' Solo' END AS tier_line, p_partkey % 3 = 0 AS truthy, 'Low ' || upper(substr(p_name, 1, 1)) || substr(split_part(p_name, ' ', 1), 2) AS title, '&lt;b a=&quot;' || p_name || '&quot;&gt; &amp;amp;' AS html FROM part""")
def q_small_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    pair = T.number_pair(F.concat(F.lit("at "), (3 + k % 5).cast("string"), F.lit(" / "), size))
    return _table(spark, sf_dir, "part").select(
        k.cast("int").alias("k"), pair["minor"].cast("long").alias("minor"), pair["major"].cast("long").alias("major"), T.first_number(F.concat(F.lit("HP: "), size, F.lit(" of 99"))).cast("long").alias("first"),
        T.damage_type(F.when(k % 2 == 0, "  2d6  Physical or magical ").otherwise("1d4\tMAGIC")).alias("damage"), T.base_type(F.concat(F.lit("Horde ("), size, F.lit("/HP)"))).alias("base"),
        T.tier_line((k % 4 + 1).cast("int"), F.when(k % 3 == 0, "").otherwise("Solo")).alias("tier_line"), T.truthy(F.when(k % 6 == 0, " Yes ").when(k % 3 == 0, "1").when(k % 3 == 1, "off")).alias("truthy"),
        T.title_of_column(F.concat(F.lit("low_"), F.split_part("p_name", F.lit(" "), F.lit(1)))).alias("title"), T.html_escape(F.concat(F.lit('<b a="'), F.col("p_name"), F.lit('"> &amp;'))).alias("html"),
    )


@query(r"SELECT doc_id, md5(CASE WHEN length(text) > 100 THEN regexp_replace(text, '^\s+|\s+$', '', 'g') ELSE text || text END) AS digest FROM documents")
def q_repeated_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(T.without_repeated_half(F.concat("text", "text"))).alias("digest"))


@query("SELECT CAST(p_partkey AS INT) AS page, 0 AS \"row\", 'Part ' || p_name || ' undertow' AS text FROM part UNION ALL SELECT CAST(p_partkey AS INT), 4, 'end-' FROM part")
def q_cleaned_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word cut at a line end, over a picture's line and a page number that are left out."""
    line = lambda i, text, style: F.struct(F.lit(i).alias("row"), text.alias("text"), F.lit(style).alias("style"))
    made = F.array(line(0, F.concat(F.lit("Part "), F.col("p_name"), F.lit(" under-")), "BODY"), line(1, F.lit("x art"), "ART"), line(2, F.col("p_size").cast("string"), "PAGE_NUMBER"), line(3, F.lit("tow"), "BODY"), line(4, F.lit("end-"), "BODY"))
    rows = _table(spark, sf_dir, "part").select(F.lit("s").alias("source"), F.col("p_partkey").cast("int").alias("page"), F.inline(made))
    return layout.cleaned_lines(rows, ["source", "page"], ["row"]).select("page", "row", "text")


# --- links and attribution ----------------------------------------------------------------------------------------------


def _linked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw pages with anchors to the parts of even number and to sections added to them."""
    html = F.concat(F.lit('<a href="#define-adversary-'), T.slug(F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string"))), F.lit('">x</a><a href="#define-adversary-benchmarks-type-solo">y</a><a href="#define-adversary-action">z</a>'))
    parts = _table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(html.alias("html"))
    return _table(spark, sf_dir, "pages").select("html").unionByName(parts)


_SLUGS = "trim(regexp_replace(lower(p_name || ' ' || CAST(p_partkey AS STRING)), '[^a-z0-9]+', '-', 'g'), '-')"


def _part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select(F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("name"))


@query(f"SELECT DISTINCT {_SLUGS} AS slug FROM part WHERE p_partkey % 2 = 0")
def q_anchor_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.anchor_slugs(_linked_pages(spark, sf_dir))


@query(f"SELECT p_name || ' ' || CAST(p_partkey AS STRING) AS name, 'https://example.org/#define-adversary-' || {_SLUGS} AS url FROM part WHERE p_partkey % 2 = 0")
def q_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.linked(_part_names(spark, sf_dir), catalog.anchor_slugs(_linked_pages(spark, sf_dir)), "https://example.org/")


@query("SELECT p_name || ' ' || CAST(p_partkey AS STRING) AS name FROM part WHERE p_partkey % 2 = 1")
def q_unlinked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.unlinked(_part_names(spark, sf_dir), catalog.anchor_slugs(_linked_pages(spark, sf_dir)))


_FORM = "trim(regexp_replace(regexp_replace(upper({}), '[^A-Z0-9\\s]', '', 'g'), '\\s+', ' ', 'g'))"


_ATTRIBUTED = f"""WITH needles AS (SELECT DISTINCT array_to_string(string_split(replace(text, 'ß', 'ss'), ' ')[1:item_id % 9 + 1], ' ') AS name FROM benchmark),
keyed AS (SELECT name, {_FORM.format('name')} AS key FROM needles),
docs AS (SELECT doc_id, source, dense_rank() OVER (ORDER BY source) AS pos, ' ' || {_FORM.format("replace(text, 'ß', 'ss')")} || ' ' AS t FROM documents)
SELECT name, arg_min(source, (pos, doc_id)) AS source, arg_min(doc_id, (pos, doc_id)) AS page FROM keyed JOIN docs ON contains(t, ' ' || key || ' ') WHERE key <> '' GROUP BY name"""


def _named_sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Names of one to nine words, and the texts that may have them."""
    names = _table(spark, sf_dir, "benchmark").select(F.array_join(F.slice(F.split(F.replace("text", F.lit("ß"), F.lit("ss")), " "), F.lit(1), (F.col("item_id") % 9 + 1).cast("int")), " ").alias("name")).distinct()
    docs = _table(spark, sf_dir, "documents")
    order = ranking.ranked(docs.select("source").distinct(), [F.col("source").asc_nulls_last()], name="pos")
    # Joined by shuffle, all texts of a source would come to one task.
    order = F.broadcast(order) if order.count() <= catalog.BROADCAST_NAMES else order
    pages = docs.join(order.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select("pos", "source", F.col("doc_id").alias("page"), F.replace("text", F.lit("ß"), F.lit("ss")).alias("text"))
    return names, pages


@query(_ATTRIBUTED)
def q_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.attribute(*_named_sources(spark, sf_dir))


@query(_ATTRIBUTED)
def q_attribution_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a word index, written first."""
    names, pages = _named_sources(spark, sf_dir)
    path = f"{shared_folder(spark)}/words-{uuid.uuid4().hex}"
    catalog.write_word_index(pages, path)
    return catalog.attribute_indexed(names, catalog.word_index(spark, path))


_KNOWN = ", ".join(f"({i}, '{f}', '{n}', '{t}')" for i, (f, n, t) in enumerate(V.SOURCE_CATALOG))


@query(f"""WITH here AS (SELECT DISTINCT c_custkey % 400 AS n FROM customer WHERE c_acctbal > 5000)
SELECT file, display_name, type = 'md' AS enabled FROM (VALUES {_KNOWN}) v(pos, file, display_name, type) WHERE pos IN (SELECT n FROM here)""")
def q_available_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder with a file for each customer of some means: the first few numbers have the names of known sources."""
    known = catalog.source_catalog(spark)
    keys = _table(spark, sf_dir, "customer").where("c_acctbal > 5000").select((F.col("c_custkey") % 400).alias("n"))
    files = keys.join(F.broadcast(known.select(F.col("pos").alias("n"), "file")), "n", "left").select(F.coalesce("file", F.concat(F.lit("file-"), F.col("n").cast("string"), F.lit(".pdf"))).alias("file"))
    return catalog.available_sources(known, files, pdf_reader=False).select("file", "display_name", "enabled")


# --- validation, browsing, indexes -----------------------------------------------------------------------------------

_RECORDS = """
recs AS (SELECT k, CASE WHEN k % 23 = 0 THEN '' ELSE name END AS name, CASE WHEN k % 19 = 0 THEN NULL ELSE tier END AS tier, CASE WHEN k % 17 = 0 THEN NULL ELSE type END AS type, difficulty, hp, stress, k % 29 = 0 AS bare,
  CASE WHEN k % 7 = 1 THEN minor WHEN k % 7 = 0 THEN NULL ELSE minor END AS lo, major AS hi, CASE WHEN k % 7 = 1 THEN thresholds WHEN k % 14 = 0 THEN 'None' END AS raw FROM synth),
checked AS (SELECT *, list_filter([CASE WHEN name = '' THEN 'Missing name' END, CASE WHEN tier IS NULL THEN 'Missing tier' END, CASE WHEN type IS NULL THEN 'Missing adversary type' END, CASE WHEN difficulty IS NULL THEN 'Missing Difficulty' END,
  CASE WHEN lo IS NULL AND hi IS NULL AND raw IS NULL THEN 'Missing Thresholds' END, CASE WHEN bare THEN 'No features found' END], lambda x: x IS NOT NULL) AS issues FROM recs)
"""


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.records(spark, sf_dir).withColumn("issues", validate.adversary_issues())


@query(f"WITH {_RECORDS} SELECT k AS page, array_to_string(issues, ';') AS issues FROM checked")
def q_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir).select("page", F.array_join("issues", ";").alias("issues"))


@query(f"WITH {_RECORDS} SELECT count(*) AS total, count(*) FILTER (len(issues) = 0) AS complete, count(*) FILTER (len(issues) > 0) AS with_issues FROM checked")
def q_issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.issue_counts(_checked(spark, sf_dir))


@query(f"WITH {_RECORDS} SELECT row_number() OVER (ORDER BY k) AS rn, '## ' || CASE WHEN name = '' THEN 'UNNAMED' ELSE name END || chr(10) || array_to_string(list_transform(issues, lambda m: '- ' || m), chr(10)) || chr(10) AS entry FROM checked WHERE len(issues) > 0")
def q_validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.validation_report(_checked(spark, sf_dir), ["page"])


@query(f"WITH {_RECORDS} SELECT '**Total adversaries:** ' || CAST(count(*) AS STRING) || chr(10) || '**Complete:** ' || CAST(count(*) FILTER (len(issues) = 0) AS STRING) || chr(10) || '**With issues:** ' || CAST(count(*) FILTER (len(issues) > 0) AS STRING) AS summary FROM checked")
def q_report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.report_summary(_checked(spark, sf_dir).withColumn("kind", F.lit("adversary")))


@query(f"WITH {_RECORDS} SELECT count(*) FILTER (name <> '' AND tier IS NOT NULL AND type IS NOT NULL AND difficulty IS NOT NULL AND lo IS NOT NULL AND hi IS NOT NULL) AS complete FROM checked")
def q_complete_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.records(spark, sf_dir).agg(F.count_if(validate.complete_adversary()).alias("complete"))


_PLACE_GAPS = """
gaps AS (SELECT k, CASE WHEN k % 7 = 0 THEN '' ELSE name END AS name, CASE WHEN k % 5 = 1 THEN NULL ELSE tier END AS tier, CASE WHEN k % 6 = 2 THEN NULL ELSE kind END AS environment_type, CASE WHEN k % 8 = 3 THEN NULL ELSE difficulty END AS difficulty, CASE WHEN k % 9 = 4 THEN '' ELSE 'Delay' END AS impulses, k % 10 = 5 AS bare FROM places)
"""


def _gap_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places with values missing, as the SQL's ``gaps``."""
    miss = lambda value, n, r, none=None: F.when(F.col("k") % n == r, F.lit(none)).otherwise(value)
    feature = F.array(F.struct(F.lit("Gusts").alias("name")))
    return S.places(spark, sf_dir).select(
        F.col("k").alias("page"), miss(F.col("name"), 7, 0, "").alias("name"), miss(F.col("tier"), 5, 1).alias("tier"), miss(F.col("kind"), 6, 2).alias("environment_type"), miss(F.col("difficulty"), 8, 3).alias("difficulty"),
        miss(F.lit("Delay"), 9, 4, "").alias("impulses"), F.when(F.col("k") % 10 == 5, F.slice(feature, 1, 0)).otherwise(feature).alias("features"),
    )


@query(f"""WITH {_PLACE_GAPS} SELECT k AS page, array_to_string(list_filter([CASE WHEN name = '' THEN 'Missing name' END, CASE WHEN tier IS NULL THEN 'Missing tier' END, CASE WHEN environment_type IS NULL THEN 'Missing environment type' END,
   CASE WHEN difficulty IS NULL THEN 'Missing Difficulty' END, CASE WHEN impulses = '' THEN 'Missing Impulses' END, CASE WHEN bare THEN 'No features found' END], lambda x: x IS NOT NULL), ';') AS issues FROM gaps""")
def q_place_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gap_places(spark, sf_dir).select("page", F.array_join(validate.place_issues(), ";").alias("issues"))


@query(f"WITH {_PLACE_GAPS} SELECT count(*) FILTER (name <> '' AND tier IS NOT NULL AND environment_type IS NOT NULL AND difficulty IS NOT NULL AND impulses <> '') AS complete FROM gaps")
def q_complete_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gap_places(spark, sf_dir).agg(F.count_if(validate.complete_place()).alias("complete"))


@query(f"WITH {_RECORDS} SELECT row_number() OVER (ORDER BY k) AS rn, name, 'Tier ' || coalesce(CAST(tier AS STRING), '?') AS tier, coalesce(type, 'Unknown') AS type, len(issues)::INT AS issue_count FROM checked")
def q_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.listing(_checked(spark, sf_dir), ["page"])


@query(f"WITH {_RECORDS} SELECT coalesce(tier, 0) AS tier, count(*) AS n FROM checked GROUP BY ALL")
def q_tier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.by_tier(_checked(spark, sf_dir))


@query(f"WITH {_RECORDS} SELECT coalesce(type, 'Unknown') AS adversary_type, count(*) AS n FROM checked GROUP BY ALL")
def q_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.by_type(_checked(spark, sf_dir))


@query(f"WITH {_RECORDS} SELECT tier, adversary_type, count(*) AS n FROM (SELECT coalesce(tier, 0) AS tier, coalesce(type, 'Unknown') AS adversary_type FROM checked) GROUP BY CUBE (tier, adversary_type)")
def q_tier_type_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.tier_type_cube(_checked(spark, sf_dir))


@query(f"""WITH {_RECORDS}, cells AS (SELECT coalesce(tier, 0) AS t, name, k, '| ' || CASE WHEN name = '' THEN 'Unknown' ELSE name END || ' | ' || coalesce(type, '-') || ' | ' || coalesce(CAST(difficulty AS STRING), '-') || ' | '
   || CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN CAST(lo AS STRING) || '/' || CAST(hi AS STRING) ELSE coalesce(raw, '-') END || ' | ' || CAST(hp AS STRING) || ' | ' || CAST(stress AS STRING) || ' |' AS line FROM checked),
tiers AS (SELECT t, count(*) AS n, CASE WHEN t > 0 THEN 'Tier ' || CAST(t AS STRING) ELSE 'Unknown Tier' END AS title, string_agg(line, chr(10) ORDER BY name, k) AS body FROM cells GROUP BY t)
SELECT CAST(unnest(range(1, len(lines) + 1)) AS BIGINT) AS line_no, unnest(lines) AS text FROM (SELECT string_split(text, chr(10)) AS lines FROM (
SELECT '# Adversaries Master Index' || chr(10) || chr(10) || string_agg('## ' || title || chr(10) || chr(10) || '| Name | Type | Difficulty | Thresholds | HP | Stress |' || chr(10) || '|------|------|------------|------------|----|----|' || chr(10) || body || chr(10) || chr(10), '' ORDER BY t)
  || '## Summary' || chr(10) || chr(10) || '**Total adversaries:** ' || CAST(sum(n) AS STRING) || string_agg(chr(10) || '- ' || title || ': ' || CAST(n AS STRING), '' ORDER BY t) AS text FROM tiers))""")
def q_master_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.master_index(S.records(spark, sf_dir))


@query(f"""WITH {_RECORDS}, groups AS (SELECT coalesce(type, 'Unknown') AS kind, string_agg('- **' || name || '** (' || CASE WHEN tier IS NULL THEN '?' ELSE 'Tier ' || CAST(tier AS STRING) END || ')', chr(10) ORDER BY coalesce(tier, 0), name, k) AS body FROM checked GROUP BY 1)
SELECT CAST(unnest(range(1, len(lines) + 1)) AS BIGINT) AS line_no, unnest(lines) AS text FROM (SELECT string_split(text, chr(10)) AS lines FROM (
SELECT '# Adversaries by Type' || chr(10) || chr(10) || string_agg('## ' || kind || chr(10) || chr(10) || body || chr(10), chr(10) ORDER BY kind) AS text FROM groups))""")
def q_type_index_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.type_index(S.records(spark, sf_dir))


_BROWSE = """
browse AS (SELECT k, name, tier, CASE WHEN k % 17 = 0 THEN NULL ELSE type END AS type, difficulty, CASE WHEN modifier LIKE '%d%' THEN NULL ELSE CAST(modifier AS INT) END AS atk_bonus,
  hp, stress, minor AS low_threshold, major AS high_threshold, '1d' || CAST(hp AS STRING) || CASE WHEN k % 2 = 0 THEN ' PHY' ELSE ' mag' END AS damage_dice FROM synth)
"""
_FILTERS = {"search": "no1", "tier": 2, "atk_bonus": 1, "hp": (">=", 3), "low_threshold": ("<=", 50), "damage_dice": "MAG", "type": "", "stress": None}
_WHERE = "contains(lower(name), 'no1') AND tier = 2 AND coalesce(atk_bonus = 1, false) AND hp >= 3 AND coalesce(low_threshold <= 50, false) AND contains(lower(damage_dice), 'mag')"


@query(f"WITH {_BROWSE} SELECT k, name, atk_bonus, hp FROM browse WHERE {_WHERE}")
def q_browse_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table is stored first, so that the filters reach its scan."""
    rows = browse.stored(S.browse_rows(spark, sf_dir), f"{shared_folder(spark)}/browse-{uuid.uuid4().hex}")
    return browse.browse(rows, _FILTERS).select("k", "name", "atk_bonus", "hp")


@query(f"WITH {_BROWSE} SELECT count(*) FILTER ({_WHERE}) AS shown, count(*) AS total FROM browse")
def q_browse_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browse.counts(S.browse_rows(spark, sf_dir), _FILTERS)


@query(f"WITH {_BROWSE} SELECT k, row_number() OVER (ORDER BY difficulty DESC NULLS LAST, k) AS rn, difficulty FROM browse")
def q_browse_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browse.sorted_rows(S.browse_rows(spark, sf_dir), "difficulty", descending=True, numeric=True, tie=["k"]).select("k", "rn", "difficulty")


@query(f"WITH {_BROWSE} SELECT k, row_number() OVER (ORDER BY lower(type) NULLS LAST, k) AS rn, type FROM browse")
def q_browse_sort_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browse.sorted_rows(S.browse_rows(spark, sf_dir), "type", numeric=False, tie=["k"]).select("k", "rn", "type")


@query(f"""WITH {_BROWSE}, vals AS (SELECT DISTINCT 'tier' AS "column", CAST(tier AS STRING) AS value, tier AS v FROM browse UNION SELECT DISTINCT 'difficulty', CAST(difficulty AS STRING), difficulty FROM browse WHERE difficulty IS NOT NULL UNION SELECT DISTINCT 'type', type, NULL FROM browse WHERE type IS NOT NULL)
SELECT "column", row_number() OVER (PARTITION BY "column" ORDER BY v NULLS LAST, value) AS rn, value FROM vals""")
def q_browse_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browse.options(S.browse_rows(spark, sf_dir)).select("column", "rn", "value")


@query("SELECT unnest(['k', 'tier', 'difficulty', 'atk_bonus', 'hp', 'stress', 'low_threshold', 'high_threshold', 'battle_points']) AS \"column\"")
def q_numeric_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(c,) for c in browse.numeric_columns(S.browse_rows(spark, sf_dir))], "column string")


_FACTS = [("k", False), ("name", False), ("tier", True), ("type", True), ("difficulty", True), ("atk_bonus", True), ("hp", True), ("stress", True), ("low_threshold", True), ("high_threshold", True), ("damage_dice", True)]


@query(f"WITH {_BROWSE} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({i} AS BIGINT) AS pos, {str(box).lower()} AS filter, count({c}) AS filled, min(CAST({c} AS STRING)) AS least, max(CAST({c} AS STRING)) AS greatest FROM browse" for i, (c, box) in enumerate(_FACTS)))
def q_table_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browse.column_facts(S.browse_rows(spark, sf_dir))


@query(f"""WITH {_BROWSE} SELECT '{{"k":' || CAST(k AS STRING) || ',"name":"' || name || '","tier":' || CAST(tier AS STRING) || ',"type":"' || replace(coalesce(type, ''), '</', '<\\/') || '","difficulty":' || coalesce(CAST(difficulty AS STRING), '""') || ',"atk_bonus":' || coalesce(CAST(atk_bonus AS STRING), '""')
   || ',"hp":' || CAST(hp AS STRING) || ',"stress":' || CAST(stress AS STRING) || ',"low_threshold":' || coalesce(CAST(low_threshold AS STRING), '""') || ',"high_threshold":' || coalesce(CAST(high_threshold AS STRING), '""') || ',"damage_dice":"' || damage_dice || '","battle_points":' || CAST(k % 3 AS STRING) || '}}' AS json FROM browse""")
def q_embedded_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browse.embedded_json(S.browse_rows(spark, sf_dir))


# --- unions, renderings, sinks -----------------------------------------------------------------------------------------


@query("SELECT 0 AS kind_ord, 'adversary' AS kind, name, CAST(difficulty AS STRING) AS difficulty, n_features FROM good UNION ALL SELECT 1, 'environment', name, difficulty, 2 FROM places")
def q_union_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, e = _parsed(spark, sf_dir), parse_lines(S.styled_places(spark, sf_dir))
    return Parsed(a.adversaries, e.environments, a.rejected).union().select("kind_ord", "kind", "name", "difficulty", F.size("features").alias("n_features"))


_FEATURE_JSON = """'{"name":"Edge","type":"Passive","desc":"It cuts twice."}' || CASE WHEN n_features >= 2 THEN ',{"name":"Phase 1: Trap","type":"Action","desc":"It shuts."}' ELSE '' END || CASE WHEN n_features >= 3 THEN ',{"name":"Echo","type":"Reaction","desc":"It rings."}' ELSE '' END"""


@query(f"""SELECT k AS page, '{{"name":"' || name || '","tier":' || CAST(tier AS STRING) || ',"type":"' || type || '","desc":"Item seen in ' || lower(name) || '","difficulty":' || CAST(difficulty AS STRING) || ',"motives":"Wait, watch","hp":' || CAST(hp AS STRING) || ',"stress":' || CAST(stress AS STRING)
   || ',"attack":' || CASE WHEN modifier LIKE '%d%' THEN '"' || modifier || '"' ELSE CAST(CAST(modifier AS INT) AS STRING) END || ',"weapon":"Hook","range":"Very Close","damage":"1d6+' || CAST(tier AS STRING) || ' phy","thresholds":"' || thresholds || '","xp":"Guard +2","source":"book-' || CAST(CAST(floor(k / 100) AS INT) AS STRING) || '","features":[' || {_FEATURE_JSON} || ']}}' AS json FROM good""")
def q_json_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parsed(spark, sf_dir)
    return render.library(p.adversaries, p.environments).select("page", "json")


@query("""SELECT k AS page, '{"name":"' || name || '","tier":' || CAST(tier AS STRING) || ',"type":"' || kind || '","desc":"A windy stretch of road.","difficulty":' || CASE WHEN difficulty LIKE 'S%' THEN '"' || replace(difficulty, '"', '\\"') || '"' ELSE difficulty END
   || ',"impulses":"Delay, divert"' || coalesce(',"potential_adversaries":"' || potential || '"', '') || ',"source":"atlas-' || CAST(k % 16 AS STRING) || '","features":[{"name":"Gusts","type":"Passive","desc":"The wind turns."'
   || CASE n_questions WHEN 0 THEN '' WHEN 1 THEN ',"questions":["What does the wind carry?"]' ELSE ',"questions":["What does the wind carry?","Who hears it?"]' END || '},{"name":"Slide","type":"Action","desc":"Stones fall."}]}' AS json FROM places""")
def q_json_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = parse_lines(S.styled_places(spark, sf_dir)).environments
    return e.select("page", render.library_place().alias("json"))


_SHOWN = f"array_to_string(list_transform(string_split(name, ' '), lambda w: {_CAP}), ' ')"
_YAML = f"""'name: "' || {_SHOWN} || '"' || chr(10) || 'tier: ' || CAST(tier AS STRING) || chr(10) || 'type: "' || type || '"' || chr(10) || 'desc: "Item seen in ' || lower(name) || '"' || chr(10) || 'difficulty: ' || CAST(difficulty AS STRING) || chr(10)
   || 'attack: ' || CASE WHEN modifier LIKE '%d%' THEN '"' || modifier || '"' ELSE CAST(CAST(modifier AS INT) AS STRING) END || chr(10) || 'weapon: "Hook"' || chr(10) || 'range: "Very Close"' || chr(10) || 'damage: "1d6+' || CAST(tier AS STRING) || ' phy"' || chr(10)"""


@query(f"""SELECT k AS page, {_YAML} || 'thresholds: "' || thresholds || '"' || chr(10) || 'hp: ' || CAST(hp AS STRING) || chr(10) || 'stress: ' || CAST(stress AS STRING) || chr(10) || 'xp: "Guard +2"' || chr(10) || 'motives: "Wait, watch"' || chr(10) || 'source: "book-' || CAST(CAST(floor(k / 100) AS INT) AS STRING) || ', p. ' || CAST(k AS STRING) || '"' || chr(10)
   || 'features:' || chr(10) || '  - name: "Edge"' || chr(10) || '    type: "Passive"' || chr(10) || '    desc: "It cuts twice."'
   || CASE WHEN n_features >= 2 THEN chr(10) || '  - name: "Phase 1: Trap"' || chr(10) || '    type: "Action"' || chr(10) || '    desc: "It shuts."' ELSE '' END
   || CASE WHEN n_features >= 3 THEN chr(10) || '  - name: "Echo"' || chr(10) || '    type: "Reaction"' || chr(10) || '    desc: "It rings."' ELSE '' END AS yaml FROM good""")
def q_yaml_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).adversaries.select("page", render.adversary_yaml().alias("yaml"))


@query(f"""SELECT k AS page, '---' || chr(10) || 'name: "' || {_SHOWN} || '"' || chr(10) || 'tier: ' || CAST(tier AS STRING) || chr(10) || 'type: "' || type || '"' || chr(10) || 'difficulty: ' || CAST(difficulty AS STRING) || chr(10) || 'hp: ' || CAST(hp AS STRING) || chr(10) || 'stress: ' || CAST(stress AS STRING) || chr(10)
   || 'attack: ' || CASE WHEN modifier LIKE '%d%' THEN '"' || modifier || '"' ELSE CAST(CAST(modifier AS INT) AS STRING) END || chr(10) || 'weapon: "Hook"' || chr(10) || 'range: "Very Close"' || chr(10) || 'damage: "1d6+' || CAST(tier AS STRING) || ' phy"' || chr(10)
   || 'motives: "Wait, watch"' || chr(10) || 'desc: "Item seen in ' || lower(name) || '"' || chr(10) || 'source: "book-' || CAST(CAST(floor(k / 100) AS INT) AS STRING) || '"' || chr(10) || 'feature_count: ' || CAST(n_features AS STRING) || chr(10) || '---' || chr(10) AS properties FROM good""")
def q_properties_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).adversaries.select("page", render.adversary_properties().alias("properties"))


@query("""SELECT k AS page, '# ' || name || chr(10) || chr(10) || '***Tier ' || CAST(tier AS STRING) || ' ' || type || '***  ' || chr(10) || '*Item seen in ' || lower(name) || '*  ' || chr(10) || '**Motives & Tactics:** Wait, watch' || chr(10) || chr(10)
   || '> **Difficulty:** ' || CAST(difficulty AS STRING) || ' | **Thresholds:** ' || thresholds || ' | **HP:** ' || CAST(hp AS STRING) || ' | **Stress:** ' || CAST(stress AS STRING) || '  ' || chr(10)
   || '> **ATK:** ' || modifier || ' | Hook: Very Close | 1d6+' || CAST(tier AS STRING) || ' phy  ' || chr(10) || '> **Experience:** Guard +2' || chr(10) || chr(10) || '## FEATURES' || chr(10) || chr(10)
   || '***Edge - Passive:*** It cuts twice.' || chr(10) || chr(10) || CASE WHEN n_features >= 2 THEN '***Phase 1: Trap - Action:*** It shuts.' || chr(10) || chr(10) ELSE '' END || CASE WHEN n_features >= 3 THEN '***Echo - Reaction:*** It rings.' || chr(10) || chr(10) ELSE '' END
   || '---' || chr(10) || chr(10) || '*Source: book-' || CAST(CAST(floor(k / 100) AS INT) AS STRING) || ', p. ' || CAST(k AS STRING) || '*' || chr(10) AS text FROM good""")
def q_readable_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).adversaries.select("page", render.readable_adversary().alias("text"))


_PLACE_HEAD = """'name: "Supplier ' || substr(name, 10) || '"' || chr(10) || 'tier: ' || CAST(tier AS STRING) || chr(10) || 'type: "' || kind || '"' || chr(10)"""
_PLACE_DIFFICULTY = """'difficulty: ' || CASE WHEN difficulty LIKE 'S%' THEN '"' || replace(difficulty, '"', '\\"') || '"' ELSE difficulty END || chr(10)"""
_PLACE_DRIVES = """'impulses: "Delay, divert"' || chr(10) || coalesce('potential_adversaries: "' || potential || '"' || chr(10), '')"""
_PLACE_DESC = """'desc: "A windy stretch of road."' || chr(10)"""


@query(f"""SELECT k AS page, '---' || chr(10) || {_PLACE_HEAD} || {_PLACE_DIFFICULTY} || {_PLACE_DRIVES} || {_PLACE_DESC} || 'source: "atlas-' || CAST(k % 16 AS STRING) || '"' || chr(10) || 'feature_count: 2' || chr(10) || '---' || chr(10)
   || '# Supplier ' || substr(name, 10) || chr(10) || chr(10) || '```{V.FENCE}' || chr(10) || {_PLACE_HEAD} || {_PLACE_DESC} || {_PLACE_DIFFICULTY} || {_PLACE_DRIVES} || 'source: "atlas-' || CAST(k % 16 AS STRING) || ', p. ' || CAST(k AS STRING) || '"' || chr(10)
   || 'features:' || chr(10) || '  - name: "Gusts"' || chr(10) || '    type: "Passive"' || chr(10) || '    desc: "The wind turns."' || chr(10)
   || CASE WHEN n_questions > 0 THEN '    questions:' || chr(10) || '      - "What does the wind carry?"' || chr(10) ELSE '' END || CASE WHEN n_questions > 1 THEN '      - "Who hears it?"' || chr(10) ELSE '' END
   || '  - name: "Slide"' || chr(10) || '    type: "Action"' || chr(10) || '    desc: "Stones fall."' || chr(10) || '```' || chr(10) AS bank,
   '# ' || name || chr(10) || chr(10) || '***Tier ' || CAST(tier AS STRING) || ' ' || kind || '***  ' || chr(10) || '*A windy stretch of road.*  ' || chr(10) || '**Impulses:** Delay, divert' || chr(10) || chr(10) || '> **Difficulty:** ' || difficulty || '  ' || chr(10)
   || coalesce('> **Potential Adversaries:** ' || potential || chr(10), '') || chr(10) || '## FEATURES' || chr(10) || chr(10) || '***Gusts - Passive:*** The wind turns.' || chr(10) || chr(10)
   || CASE n_questions WHEN 0 THEN '' WHEN 1 THEN '*What does the wind carry?*' || chr(10) || chr(10) ELSE '*What does the wind carry? Who hears it?*' || chr(10) || chr(10) END
   || '***Slide - Action:*** Stones fall.' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '*Source: atlas-' || CAST(k % 16 AS STRING) || ', p. ' || CAST(k AS STRING) || '*' || chr(10) AS readable FROM places""")
def q_place_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = parse_lines(S.styled_places(spark, sf_dir)).environments
    return e.select("page", F.concat(render.place_properties(), render.bank_file(render.place_yaml())).alias("bank"), render.readable_place().alias("readable"))


@query("""SELECT CAST(p_partkey AS INT) AS k, upper(substr(split_part(p_type, ' ', 1), 1, 1)) || lower(substr(split_part(p_type, ' ', 1), 2)) || CASE WHEN row_number() OVER (PARTITION BY split_part(p_type, ' ', 1) ORDER BY p_partkey) = 1 THEN '' ELSE '_' || CAST(row_number() OVER (PARTITION BY split_part(p_type, ' ', 1) ORDER BY p_partkey) - 1 AS STRING) END AS stem FROM part""")
def q_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("k"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("name"))
    return sinks.allocate_names(rows, ["k"]).select("k", "stem")


@query("""SELECT CAST(p_partkey AS INT) AS k, split_part(p_type, ' ', 1) || CASE WHEN row_number() OVER (PARTITION BY split_part(p_type, ' ', 1) ORDER BY p_partkey) = 1 THEN '' ELSE ' (' || CAST(row_number() OVER (PARTITION BY split_part(p_type, ' ', 1) ORDER BY p_partkey) - 1 AS STRING) || ')' END AS key FROM part""")
def q_record_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("k"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("name"))
    return sinks.allocate_keys(rows, ["k"]).select("k", "key")
