"""Links by slug, sources by name, tags, known sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.functions import vocabulary as V
from blockloom.functions.regex import nothing, one
from blockloom.functions.text import link_slug, search_form
from blockloom.session import settled


def source_catalog(spark: SparkSession) -> DataFrame:
    """The known sources in order: ``pos, file, display_name, type``."""
    return spark.createDataFrame([(i, *x) for i, x in enumerate(V.SOURCE_CATALOG)], "pos int, file string, display_name string, type string")


def available_sources(catalog: DataFrame, files: DataFrame, pdf_reader: bool) -> DataFrame:
    """Known sources whose file is there, with whether they can be read: PDF ones need a reader."""
    here = catalog.join(files.select("file").distinct(), "file", "left_semi")
    return here.withColumn("enabled", (F.col("type") != "pdf") | F.lit(pdf_reader))


def anchor_slugs(pages: DataFrame, html: str = "html", anchor: str = V.ANCHOR) -> DataFrame:
    """The distinct record slugs that pages link to: fragments after ``anchor``, without those of sections."""
    links = pages.select(F.explode(F.regexp_extract_all(F.col(html), F.lit(f'href="#{anchor}([^"]+)"'), F.lit(1))).alias("slug"))
    return links.where(~F.col("slug").isin(V.SECTION_ANCHORS) & ~F.startswith("slug", F.lit(V.SECTION_ANCHOR_START))).distinct()


def linked(names: DataFrame, slugs: DataFrame, base: str, anchor: str = V.ANCHOR) -> DataFrame:
    """``name, url`` of the names whose slug is linked to. Neither side's size is known, so Spark chooses the join."""
    keyed = names.select("name", link_slug(F.col("name"), V.SLUG_OVERRIDES).alias("slug"))
    return keyed.join(slugs.distinct(), "slug").select("name", F.concat(F.lit(f"{base}#{anchor}"), "slug").alias("url"))


def unlinked(names: DataFrame, slugs: DataFrame) -> DataFrame:
    return names.withColumn("slug", link_slug(F.col("name"), V.SLUG_OVERRIDES)).join(slugs, "slug", "left_anti").drop("slug")


#: Words of a name that its hash covers; names up to which their hashes are broadcast.
HASHED_WORDS, BROADCAST_NAMES = 8, 1_000_000


def _run_hashes(words: Column, lengths: list[int]) -> Column:
    """The hashes of all runs of these numbers of words; a run's is that of the run one word shorter and its last word."""

    def grown(single: Column, shorter: Column, n: int) -> Column:
        if n > max(lengths):
            return nothing("bigint")
        longer = F.zip_with(F.slice(shorter, 1, F.greatest(F.size(shorter) - 1, F.lit(0))), F.slice(single, n, F.greatest(F.size(single), F.lit(1))), lambda a, b: F.xxhash64(F.lit(n), a, b))
        return one(longer, lambda g: F.concat(g if n in lengths else nothing("bigint"), grown(single, g, n + 1)))

    return one(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.concat(h if 1 in lengths else nothing("bigint"), grown(h, h, 2)))


def _hash_of(words: Column) -> Column:
    """The hash that a run of these words has."""
    hashes = F.transform(words, lambda w, i: F.struct((i + 1).alias("n"), F.xxhash64(w).alias("h")))
    start = F.lit(0).cast("long")
    return F.aggregate(hashes, start, lambda acc, x: F.when(x["n"] == 1, x["h"]).otherwise(F.xxhash64(x["n"], acc, x["h"])))


def attribute(names: DataFrame, pages: DataFrame) -> DataFrame:
    """``name, source, page``: the first source in order, then the first page, that has the name as whole words.

    ``pages`` has ``pos, source, page, text``. Normal forms are words with single spaces between, so a name stands in a
    text as whole words exactly if it is one of the text's runs of words. Runs of the lengths that names have, up to
    ``HASHED_WORDS`` words, are compared by 64-bit hashes, each got from the run one word shorter; a longer name is
    known by its first words. What this finds is compared as strings: the first hit of each name, and all hits of the
    longer names. Names whose first hit was a chance match (none, in practice) are looked for again as strings.
    A name without letters or digits matches nothing.
    """
    wanted = names.select("name", search_form(F.col("name")).alias("key")).where(F.col("key") != "").distinct()
    wanted = wanted.withColumn("words", F.split("key", " ")).withColumn("long", F.size("words") > HASHED_WORDS)
    wanted = settled(wanted.withColumn("words", F.slice("words", 1, HASHED_WORDS)).select("name", "key", "long", F.size("words").alias("len"), _hash_of(F.col("words")).alias("h")))
    lengths, n = wanted.agg(F.collect_set("len"), F.count(F.lit(1))).first()
    place = ["pos", "source", "page"]
    if not n:
        return pages.select(F.col("text").alias("name"), "source", "page").limit(0)
    runs = pages.select(*place, F.explode(_run_hashes(F.split(search_form(F.col("text")), " "), sorted(lengths))).alias("h"))
    few = n <= BROADCAST_NAMES
    keys = wanted.select("name", "h", "long")
    hits = runs.join(F.broadcast(keys) if few else keys, "h")
    firsts = hits.where(~F.col("long")).groupBy("name").agg(F.min(F.struct("pos", "page", "source")).alias("b")).select("name", "b.*")
    found = settled(firsts.unionByName(hits.where("long").select("name", *place).distinct()))
    told = wanted.select("name", "key")
    asked = found.join(told, "name")
    sure = pages.alias("t").join(asked.alias("a"), (F.col("t.pos") == F.col("a.pos")) & (F.col("t.page") == F.col("a.page")) & F.col("t.source").eqNullSafe(F.col("a.source")))
    holds = F.contains(F.concat(F.lit(" "), search_form(F.col("t.text")), F.lit(" ")), F.concat(F.lit(" "), F.col("a.key"), F.lit(" ")))
    sure = settled(sure.where(holds).select("a.name", "a.pos", "a.source", "a.page"))
    missed = found.select("name").distinct().join(wanted.where(~F.col("long")), "name").join(sure.select("name").distinct(), "name", "left_anti").select("name", "key")
    if missed.isEmpty():
        return _first(sure)
    again = pages.join(F.broadcast(missed) if few else missed, F.contains(F.concat(F.lit(" "), search_form(F.col("text")), F.lit(" ")), F.concat(F.lit(" "), F.col("key"), F.lit(" "))))
    return _first(sure.unionByName(again.select("name", *place)))


def _first(hits: DataFrame) -> DataFrame:
    best = hits.groupBy("name").agg(F.min(F.struct("pos", "page", "source")).alias("b"))
    return best.select("name", "b.source", "b.page")


INDEX = "h bigint, pos int, source string, page int, places array<int>"


def index_rows(pages: DataFrame) -> DataFrame:
    """The rows of the word index, in ranges of the hash and the page."""
    words = pages.select(F.col("pos").cast("int"), "source", F.col("page").cast("int"), F.posexplode(F.split(search_form(F.col("text")), " ")).alias("i", "w")).where("w <> ''")
    # Ranges of words and pages also hold all places of a word in a page, so places are put together behind one shuffle.
    ranges = words.select(F.xxhash64("w").alias("h"), "pos", "source", "page", "i").repartitionByRange("h", "pos", "page")
    return ranges.groupBy("h", "pos", "source", "page").agg(F.sort_array(F.collect_list("i")).alias("places"))


def write_word_index(pages: DataFrame, path: str) -> None:
    """Where every word stands: a row for each word (by its hash) of each page, with its places in order.

    Rows lie in ranges of the hash, so that a look-up reads the row groups of the words it asks for.
    """
    index_rows(pages).sortWithinPartitions("h", "pos", "page").write.mode("errorifexists").parquet(path)


def word_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(path)


def attribute_indexed(names: DataFrame, index: DataFrame) -> DataFrame:
    """What ``attribute`` finds, from a written word index and without the texts.

    A name of n words stands where its words, by 64-bit hashes, stand at n places in a row. Each name is looked for from
    its rarest word, so frequent words are read for the pages that have it alone.
    """
    wanted = names.select("name", F.split(search_form(F.col("name")), " ").alias("words")).where(F.col("words") != F.array(F.lit(""))).distinct()
    words = settled(wanted.select("name", F.size("words").alias("n"), F.posexplode("words").alias("k", "w")).select("name", "n", "k", F.xxhash64("w").alias("h")))
    rows = settled(index.join(words.select("h").distinct(), "h"))
    common = rows.groupBy("h").agg(F.sum(F.size("places")).alias("often"))
    rarest = words.join(common, "h", "left").groupBy("name").agg(F.min_by(F.struct("h", "k"), F.struct(F.coalesce("often", F.lit(0)), "k")).alias("r")).select("name", "r.h", "r.k")
    starts = rows.join(rarest, "h").select("name", "pos", "source", "page", F.explode(F.transform("places", lambda p: p - F.col("k"))).alias("start"))
    each = starts.join(words, "name").select("name", "n", "pos", "source", "page", "start", "h", (F.col("start") + F.col("k")).alias("at"))
    same = (F.col("e.h") == F.col("r.h")) & (F.col("e.pos") == F.col("r.pos")) & (F.col("e.page") == F.col("r.page")) & F.col("e.source").eqNullSafe(F.col("r.source"))
    there = each.alias("e").join(rows.alias("r"), same).where(F.array_contains("r.places", F.col("e.at")))
    whole = there.groupBy("e.name", "e.n", "e.pos", "e.source", "e.page", "e.start").agg(F.count(F.lit(1)).alias("found")).where("found = n")
    return _first(whole)


def fill_sources(records: DataFrame, found: DataFrame) -> DataFrame:
    """Records with the source found for their name where they have none, and whether one was added."""
    none = F.coalesce("source_name", F.lit("")) == ""
    joined = records.join(found.select("name", F.col("source").alias("_s"), F.col("page").alias("_p")), "name", "left")
    added = none & F.col("_s").isNotNull()
    return joined.withColumns({"source_added": added, "source_page": F.when(added, F.col("_p")).otherwise(F.col("source_page")), "source_name": F.when(added, F.col("_s")).otherwise(F.col("source_name"))}).drop("_s", "_p")

