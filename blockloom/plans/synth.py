"""Stat blocks made from the driver's tables by SQL that Spark and DuckDB read alike, and pages, words and files of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from blockloom.session import spread

SYNTH = """
SELECT CAST(p_partkey AS INT) AS k,
       upper(p_name) || ' NO' || CAST(p_partkey AS STRING) AS name,
       CAST(p_partkey % 4 + 1 AS INT) AS tier,
       split_part('Bruiser,Leader,Skulk,Support,Solo,Standard,Ranged,Horde,Minion', ',', CAST(p_partkey % 9 + 1 AS INT))
         || CASE WHEN p_partkey % 9 = 7 THEN ' (' || CAST(p_size AS STRING) || '/HP)' ELSE '' END AS type,
       CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE CAST(8 + p_size % 15 AS INT) END AS difficulty,
       CASE WHEN p_partkey % 7 = 0 THEN 'None'
            WHEN p_partkey % 7 = 1 THEN CAST(5 + p_size AS STRING) || '/None'
            ELSE CAST(5 + p_size AS STRING) || '/' || CAST(10 + 2 * p_size AS STRING) END AS thresholds,
       CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(5 + p_size AS INT) END AS minor,
       CASE WHEN p_partkey % 7 IN (0, 1) THEN NULL ELSE CAST(10 + 2 * p_size AS INT) END AS major,
       CAST(1 + p_size % 12 AS INT) AS hp,
       CASE WHEN p_partkey % 11 = 0 THEN 0 ELSE CAST(1 + p_partkey % 6 AS INT) END AS stress,
       CASE WHEN p_partkey % 5 = 0 THEN '+2d4' WHEN p_partkey % 5 = 1 THEN '-1' ELSE '+' || CAST(p_partkey % 6 AS STRING) END AS modifier,
       CAST(1 + p_partkey % 3 AS INT) AS n_features
FROM part"""

#: What stands before the features of a block, and the features.
HEAD = """name || chr(10) || 'Tier ' || CAST(tier AS STRING) || ' ' || type || chr(10)
    || 'Item seen in ' || lower(name) || chr(10)
    || 'Motives & Tactics: Wait, watch' || chr(10)
    || CASE WHEN difficulty IS NULL THEN '' ELSE 'Difficulty: ' || CAST(difficulty AS STRING) || ' | ' END
    || 'Thresholds: ' || thresholds || ' | HP: '
    || CASE WHEN k % 2 = 0 THEN CAST(hp AS STRING) ELSE trim(repeat('O ', hp)) END
    || ' | Stress: ' || CASE WHEN stress = 0 THEN 'None' ELSE CAST(stress AS STRING) END || chr(10)
    || 'ATK: ' || modifier || ' | Hook: Very Close | 1d6+' || CAST(tier AS STRING) || ' physical' || chr(10)
    || 'Experience: Guard +2'"""
FEATURES = """'FEATURES' || chr(10)
    || 'Edge - Passive: It cuts' || chr(10) || 'twice.'
    || CASE WHEN n_features >= 2 THEN chr(10) || 'Phase 1: Trap - Action: It shuts.' ELSE '' END
    || CASE WHEN n_features >= 3 THEN chr(10) || 'Echo - reaction: It rings.' ELSE '' END"""
SPLIT_HEAD = """name || chr(10) || 'Tier ' || CAST(tier AS STRING) || ' ' || type || chr(10)
    || 'Difficulty: 12 | Thresholds: 5/9 | HP: 4 | Stress: 2 | ATK: ' || modifier || chr(10)
    || 'Long Hook: Very Far - 2d6+' || CAST(tier AS STRING) || ' magical' || chr(10)
    || 'It says ATK: +9 in prose.'"""

PLACES = """
SELECT CAST(s_suppkey AS INT) AS k,
       upper(replace(s_name, '#', ' ')) AS name,
       CAST(s_suppkey % 4 + 1 AS INT) AS tier,
       split_part('Traversal,Event,Exploration,Social', ',', CAST(s_suppkey % 4 + 1 AS INT)) AS kind,
       CASE WHEN s_suppkey % 5 = 0 THEN 'Special (see "Weather")' ELSE CAST(10 + s_suppkey % 7 AS STRING) END AS difficulty,
       CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'Wolves (Tier ' || CAST(s_suppkey % 4 + 1 AS STRING) || ')' END AS potential,
       CAST(s_suppkey % 3 AS INT) AS n_questions
FROM supplier"""

PAGE_OF = "CAST(floor(k / 5) AS INT)"


def synth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SYNTH.replace("FROM part", "FROM {part}"), part=spread(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_partkey"))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PLACES.replace("FROM supplier", "FROM {supplier}"), supplier=spread(spark.read.parquet(f"{sf_dir}/supplier.parquet"), "s_suppkey"))


def pages(spark: SparkSession, sf_dir: str, head: str = HEAD) -> DataFrame:
    """One block a page: page ``k`` of one source for every hundred blocks, so no source holds all."""
    return spark.sql(f"SELECT 'book-' || CAST(CAST(floor(k / 100) AS INT) AS STRING) AS source, k AS page, {head} || chr(10) || {FEATURES} AS text FROM {{synth}}", synth=synth(spark, sf_dir))


def broken_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five blocks to a page; the features of each page's last block stand at the head of the next.

    Every fourth page begins with a section header, before which the features of the block before it stand.
    """
    rows = spark.sql(
        f"""
        WITH parts AS (
          SELECT {PAGE_OF} AS page, k, 1 AS ord, {HEAD} || CASE WHEN k % 5 = 4 THEN '' ELSE chr(10) || {FEATURES} END AS text FROM {{synth}}
          UNION ALL
          SELECT {PAGE_OF} + 1, k, 0, {FEATURES} FROM {{synth}} WHERE k % 5 = 4
          UNION ALL
          SELECT DISTINCT {PAGE_OF} AS page, {PAGE_OF} * 5 AS k, 0.5, 'TIER ' || CAST({PAGE_OF} % 3 + 1 AS STRING) || ' ADVERSARIES' FROM {{synth}} WHERE {PAGE_OF} % 4 = 0)
        SELECT 'book' AS source, page, array_join(transform(array_sort(collect_list(struct(ord, k, text))), x -> x.text), chr(10) || chr(10)) AS text
        FROM parts GROUP BY page""",
        synth=synth(spark, sf_dir),
    )
    return rows


def styled_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of places, one to a page: a heading, the tier line, fields, a feature and its wrapped questions."""
    return spark.sql(
        """
        WITH texts AS (
          SELECT k, posexplode(array(
              named_struct('text', name, 'style', 'HEADING'),
              named_struct('text', 'Tier ' || CAST(tier AS STRING) || ' ' || kind, 'style', 'TIER'),
              named_struct('text', 'A windy stretch of road.', 'style', 'BODY'),
              named_struct('text', 'Impulses: Delay, divert', 'style', 'BODY'),
              named_struct('text', 'Difficulty: ' || difficulty || coalesce(' Potential Adversaries: ' || potential, ''), 'style', 'BODY'),
              named_struct('text', 'FEATURES', 'style', 'BODY'),
              named_struct('text', 'Gusts - Passive: The wind', 'style', 'BODY'),
              named_struct('text', 'turns.', 'style', 'BODY'),
              named_struct('text', CASE WHEN n_questions >= 1 THEN 'What does the wind' END, 'style', 'QUESTION'),
              named_struct('text', CASE WHEN n_questions >= 1 THEN 'carry?' || CASE WHEN n_questions = 2 THEN ' Who hears it?' ELSE '' END END, 'style', 'QUESTION'),
              named_struct('text', 'Slide - Action: Stones fall.', 'style', 'BODY'))) AS (line_no, l) FROM {places})
        SELECT 'atlas-' || CAST(k % 16 AS STRING) AS source, k AS page, line_no, l.text AS text, l.style AS style FROM texts WHERE l.text IS NOT NULL""",
        places=places(spark, sf_dir),
    )


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positioned words: an order is a page, its lines are spread over two columns and rows, each of three words.

    Every seventh order is a spread page of four columns. A word of each eleventh line lies off the page.
    """
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("CAST(l_orderkey AS INT) AS page", "l_linenumber", "l_partkey")
    return spark.sql(
        """
        WITH base AS (
          SELECT page, CAST(l_linenumber AS INT) AS ln, CAST(min(l_partkey) AS INT) AS pk, page % 7 = 0 AS spread FROM {lineitem} GROUP BY page, l_linenumber),
        placed AS (
          SELECT *, CASE WHEN spread THEN ln % 4 ELSE ln % 2 END AS col, CASE WHEN spread THEN CAST(floor(ln / 4) AS INT) ELSE CAST(floor(ln / 2) AS INT) END AS row FROM base)
        SELECT 'scan' AS source, page, CASE WHEN spread THEN 1200.0D ELSE 600.0D END AS page_w, 800.0D AS page_h,
               ln * 3 + w AS word_no,
               CASE w WHEN 0 THEN 'Item' WHEN 1 THEN CAST(pk AS STRING) ELSE 'x' END AS text,
               CASE WHEN w = 2 AND pk % 11 = 0 THEN -50.0D ELSE 40.0D + col * 300 + CASE w WHEN 0 THEN 0 WHEN 1 THEN 17 ELSE 23 END END AS x0,
               CASE WHEN w = 2 AND pk % 11 = 0 THEN -40.0D ELSE 45.0D + col * 300 + CASE w WHEN 0 THEN 0 WHEN 1 THEN 17 ELSE 23 END END AS x1,
               100.0D + row * 20 + w * 1.0D AS top, 110.0D + row * 20 + w * 1.0D AS bottom,
               CASE WHEN pk % 3 = 0 THEN 'AAAA+QuestaSlab-Italic' WHEN w = 0 THEN 'AAAA+EvelethCleanRegular' ELSE 'Plain' END AS fontname, 10.0D AS size
        FROM placed LATERAL VIEW explode(array(0, 1, 2)) t AS w""",
        lineitem=spread(lines, "page", rows=lines.count()),
    )


def social_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of the shared type: with a place's field, with a fighter's, or with neither under one of both headers."""
    return spark.sql(
        """
        SELECT 'talks-' || CAST(k % 16 AS STRING) AS source, k AS page,
               CASE WHEN k % 3 = 2 THEN 'TIER 2 ' || CASE WHEN k % 2 = 0 THEN 'ENVIRONMENTS' ELSE 'ADVERSARIES' END || chr(10) ELSE '' END
               || name || chr(10) || 'Tier 2 Social' || chr(10) || 'Difficulty: 12' || chr(10)
               || CASE WHEN k % 3 = 0 THEN 'Impulses: Gather' || chr(10) WHEN k % 3 = 1 THEN 'HP: 3 | Stress: 2' || chr(10) ELSE '' END
               || 'FEATURES' || chr(10) || 'Talk - Action: It speaks.' AS text
        FROM {places}""",
        places=places(spark, sf_dir),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adversary records straight from ``synth``, some with values missing: every 13th its difficulty, 17th its type,
    19th its tier, 23rd its name, 29th its features."""
    feature = "named_struct('name', 'Edge', 'feature_type', 'Passive', 'description', 'It cuts twice.')"
    return spark.sql(
        f"""
        SELECT 'book' AS source, k AS page, 1 AS block, CASE WHEN k % 23 = 0 THEN '' ELSE name END AS name, CASE WHEN k % 19 = 0 THEN NULL ELSE tier END AS tier,
               CASE WHEN k % 17 = 0 THEN NULL ELSE type END AS adversary_type, 'Seen by day' AS description, 'Wait, watch' AS motives_tactics, difficulty,
               CASE WHEN k % 7 = 1 THEN minor WHEN k % 7 = 0 THEN NULL ELSE minor END AS threshold_minor, major AS threshold_major,
               CASE WHEN k % 7 = 1 THEN thresholds WHEN k % 14 = 0 THEN 'None' END AS thresholds_raw, hp, stress,
               named_struct('modifier', modifier, 'weapon_name', 'Hook', 'range', 'Far', 'damage', '1d6 phy') AS attack, 'Guard +2' AS experience,
               CASE WHEN k % 29 = 0 THEN slice(array({feature}), 1, 0) ELSE array({feature}) END AS features, CASE WHEN k % 2 = 0 THEN 'Hope and Fear' END AS source_name, CASE WHEN k % 4 = 0 THEN k END AS source_page
        FROM {{synth}}""",
        synth=synth(spark, sf_dir),
    )


def browse_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The browsing table, with empty cells."""
    return spark.sql(
        """
        SELECT k, name, tier, CASE WHEN k % 17 = 0 THEN NULL ELSE type END AS type, difficulty, CASE WHEN modifier LIKE '%d%' THEN NULL ELSE CAST(modifier AS INT) END AS atk_bonus,
               hp, stress, minor AS low_threshold, major AS high_threshold, '1d' || CAST(hp AS STRING) || CASE WHEN k % 2 = 0 THEN ' PHY' ELSE ' mag' END AS damage_dice, k % 3 AS battle_points
        FROM {synth}""",
        synth=synth(spark, sf_dir),
    )


def collection_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown collections of ten records each, in the many-records layout."""
    return spark.sql(
        """
        WITH parts AS (
          SELECT CAST(floor(k / 10) AS INT) AS f, k, '## ' || regexp_replace(name, '[^A-Z ]', '') || chr(10) || '*Tier ' || CAST(tier AS STRING) || ' ' || split_part(type, ' ', 1) || '*' || chr(10) || chr(10)
            || 'It waits.' || chr(10) || chr(10) || '**Motives & Tactics:** Wait' || chr(10) || chr(10)
            || '**Difficulty: ' || CAST(coalesce(difficulty, 1) AS STRING) || ' | Thresholds: ' || CAST(hp AS STRING) || '/' || CAST(hp + 5 AS STRING) || ' | HP: ' || CAST(hp AS STRING) || ' | Stress: ' || CAST(stress AS STRING) || '**' || chr(10)
            || '**ATK: ' || modifier || ' | Hook: Far | 1d6 phy**' || chr(10) || '**Experience:** Guard +2' || chr(10) || chr(10) || '***FEATURES***' || chr(10)
            || '*Edge - Passive*: It cuts.' || chr(10) || '*Echo - Action*: It rings.' || chr(10) || '---' || chr(10) AS t
          FROM {synth})
        SELECT 'set-' || CAST(f AS STRING) || '.md' AS path, '# A set' || chr(10) || chr(10) || array_join(transform(array_sort(collect_list(struct(k, t))), x -> x.t), chr(10)) AS text FROM parts GROUP BY f""",
        synth=synth(spark, sf_dir),
    )
