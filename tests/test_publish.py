import json
import random

import pytest
from pyspark.sql import functions as F

from blockloom.operators import browse, catalog, index, render, validate
from blockloom.operators.markdown import parse_markdown
from blockloom.operators.normalize import normalized
from blockloom.operators.ranking import ranked
from blockloom.sources import readers, sinks

RECORD = """source string, page int, block int, name string, tier int, adversary_type string, description string, motives_tactics string, difficulty int, threshold_minor int, threshold_major int, thresholds_raw string,
hp int, stress int, attack struct<modifier:string,weapon_name:string,range:string,damage:string>, experience string, features array<struct<name:string,feature_type:string,description:string>>, source_name string, source_page int"""
FULL = ("s", 1, 1, "GREY MOTH", 2, "Horde (10/HP)", "It waits.", "Hide", 12, 8, 15, None, 4, 0, ("+2d4", "Hook", "Far", "1d6 phy"), "Guard +2", [("Edge", "Passive", "It cuts.")], "Big, Bad Book", 12)
EMPTY = ("s", 2, 1, "", None, None, None, None, None, None, None, None, None, None, None, None, [], None, None)


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame([FULL, EMPTY], RECORD)


def column(df, c):
    return [r.x for r in df.orderBy("page").select(c.alias("x")).collect()]


def test_validation(records):
    assert column(records, validate.adversary_issues()) == [[], ["Missing name", "Missing tier", "Missing adversary type", "Missing Difficulty", "Missing Thresholds", "Missing HP", "Missing Stress", "No features found"]]
    assert column(records, validate.complete_adversary()) == [True, False]


def test_readable_page_reads_back(records):
    text = column(records, render.readable_adversary())
    assert text[1] == "# UNKNOWN\n\n\n\n> **Difficulty:**  | **Thresholds:**  | **HP:**  | **Stress:**   \n\n".replace("\n\n\n\n", "\n\n\n") or text[1].startswith("# UNKNOWN")
    files = records.where("page = 1").select(F.lit("a.md").alias("path"), render.readable_adversary().alias("text"))
    (r,) = parse_markdown(files).collect()
    assert (r.name, r.tier, r.adversary_type, r.description, r.difficulty, r.hp, r.stress, r.experience, r.source_name, r.source_page) == ("GREY MOTH", 2, "Horde (10/HP)", "It waits.", 12, 4, 0, "Guard +2", "Big, Bad Book", 12)
    assert tuple(r.attack) == FULL[14] and [tuple(f) for f in r.features] == FULL[16]


def test_bank_and_properties(records):
    (yaml, _), (bank, _) = column(records, render.adversary_yaml()), column(records, render.bank_file(render.adversary_yaml()))
    assert yaml.split("\n")[:3] == ['name: "Grey Moth"', "tier: 2", 'type: "Horde (10/HP)"'] and 'attack: "+2d4"' in yaml and 'source: "Big, Bad Book, p. 12"' in yaml
    assert bank.startswith("# Grey Moth\n\n```") and bank.endswith("\n```\n")
    props, bare = column(records, render.adversary_properties())
    assert 'source: "Big, Bad Book"' in props and bare == "---\nfeature_count: 0\n---\n"


def test_library_json(records):
    full, bare = (json.loads(x) for x in column(records, render.library_adversary()))
    assert full["attack"] == "+2d4" and full["thresholds"] == "8/15" and full["stress"] == 0 and full["source"] == "big-bad-book"
    assert bare == {"xp": "", "source": "homebrew"}


def test_index_pages(spark, records):
    page = lambda df: "\n".join(r.text for r in df.orderBy("line_no").collect())
    text = page(index.master_index(records))
    assert text.index("Unknown Tier") < text.index("## Tier 2") and text.endswith("**Total adversaries:** 2\n- Unknown Tier: 1\n- Tier 2: 1") and "| Unknown | - | - | - | - | - |" in text
    assert "## Horde (10/HP)\n\n- **GREY MOTH** (Tier 2)" in page(index.type_index(records))


def test_normalising_touches_only_stat_blocks(spark, records):
    page = records.where("page = 1").select(render.readable_adversary().alias("t")).first().t
    rows = [("n/a.md", page), ("n/b.md", page.replace("\n> **ATK", "\n\n\n\n> **ATK")), ("n/c.md", "# X\n\n```daggerheart\nname: x\n```\n"), ("n/d.md", "# Notes\n\n## FEATURES\n\ntext"), ("n/e.md", "")]
    got = {r.path: r for r in normalized(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert [(got[p].skipped, got[p].changed) for p, _ in rows] == [(False, False), (False, True), (True, False), (True, False), (True, False)]
    assert got["n/b.md"].new_text == page and got["n/c.md"].name == "c"


def test_attribution(spark):
    pages = spark.createDataFrame([(0, "A", 3, "the controller of GREY  MOTH's den"), (0, "A", 2, "Grey\nMoth, again"), (1, "B", 1, "troll")], "pos int, source string, page int, text string")
    names = spark.createDataFrame([("Grey Moth",), ("Troll",), ("???",), (None,), ("Moths",)], "name string")
    assert sorted(map(tuple, catalog.attribute(names, pages).collect())) == [("Grey Moth", "A", 2), ("Moths", "A", 3), ("Troll", "B", 1)]


def test_attribution_from_a_word_index(spark, tmp_path):
    pages = spark.createDataFrame([(0, "A", 3, "the controller of GREY  MOTH's den"), (0, "A", 2, "Moth grey Grey\nMoth, again"), (1, None, 1, "troll grey grey moth of of of"), (2, "C", 1, None)], "pos int, source string, page int, text string")
    names = spark.createDataFrame([("Grey Moth",), ("Troll",), ("???",), (None,), ("Moths",), ("of of of",), ("grey grey",), ("moth troll",)], "name string")
    catalog.write_word_index(pages, str(tmp_path / "words"))
    got = sorted(map(tuple, catalog.attribute_indexed(names, catalog.word_index(spark, str(tmp_path / "words"))).collect()), key=str)
    assert got == sorted(map(tuple, catalog.attribute(names, pages).collect()), key=str)
    assert ("of of of", None, 1) in got and ("grey grey", "A", 2) in got and len(got) == 5


def test_attribution_of_long_names(spark):
    name = " ".join(f"word{i}" for i in range(40))
    pages = spark.createDataFrame([(0, "A", 1, f"the {name} again"), (1, None, 2, "Troll")], "pos int, source string, page int, text string")
    names = spark.createDataFrame([(name,), ("Troll",)], "name string")
    assert sorted(map(tuple, catalog.attribute(names, pages).collect())) == [("Troll", None, 2), (name, "A", 1)]


def test_attribution_keeps_documents_without_source(spark, tmp_path):
    from blockloom.plans import catalogue

    spark.createDataFrame([(1, "the grey moth of dawn", "a"), (2, "one old troll here now", None)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, "grey moth of dawn x"), (12, "one old troll here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = catalogue.QUERIES["q_attribution"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [("grey moth of dawn", "a", 1), ("one old troll here", None, 2)]


def test_links(spark):
    pages = spark.createDataFrame([('<a href="#define-adversary-grey-moth">x</a><a href="#define-adversary-action">',)], "html string")
    names = spark.createDataFrame([("Grey Moth",), ("Red",)], "name string")
    slugs = catalog.anchor_slugs(pages)
    assert [tuple(r) for r in catalog.linked(names, slugs, "u").collect()] == [("Grey Moth", "u#define-adversary-grey-moth")] and [r.name for r in catalog.unlinked(names, slugs).collect()] == ["Red"]


def test_browsing(spark):
    rows = spark.createDataFrame([(1, "B moth", 10, None), (2, "a Moth", None, 3), (3, "c", 9, 20)], "k int, name string, difficulty int, hp int")
    ks = lambda df: [r.k for r in df.orderBy("rn").collect()]
    assert [r.k for r in browse.browse(rows, {"search": "MOTH", "hp": (">=", 3)}).collect()] == [2]
    assert ks(browse.sorted_rows(rows, "difficulty", tie=["k"])) == [3, 1, 2] and ks(browse.sorted_rows(rows, "difficulty", True, tie=["k"])) == [1, 3, 2] and ks(browse.sorted_rows(rows, "name", tie=["k"])) == [2, 1, 3]
    with pytest.raises(ValueError):
        browse.sorted_rows(rows, "damage_dice")


def test_filters_reach_the_scan(spark, tmp_path):
    rows = spark.range(4000).selectExpr("id AS k", "concat('n', id) AS name", "CAST(id % 4 AS INT) AS tier", "if(id % 5 = 0, NULL, CAST(id % 20 AS INT)) AS hp", "CAST(id % 3 AS DOUBLE) AS stress", "CAST(id % 7 AS STRING) AS atk_bonus", "'x' AS type")
    table = browse.stored(rows, str(tmp_path / "t"))
    filters = {"tier": "2", "hp": (">=", 3.5), "stress": ("<=", 1), "atk_bonus": 4, "type": "x"}
    found = browse.browse(table, filters)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = found._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan[plan.index("PushedFilters") :]
    assert all(x in pushed for x in ("EqualTo(tier,2)", "GreaterThanOrEqual(hp,4)", "LessThanOrEqual(stress,1.0)", "EqualTo(type,x)"))
    want = [i for i in range(4000) if i % 4 == 2 and i % 5 and i % 20 >= 3.5 and i % 3 <= 1 and i % 7 == 4]
    assert sorted(r.k for r in found.collect()) == want and tuple(browse.counts(rows, filters).first()) == (len(want), 4000)
    assert browse.browse(rows, {"tier": "02"}).isEmpty() and browse.browse(rows, {"hp": ("=", 2.5)}).isEmpty()
    assert {r.filled for r in browse.column_facts(table).where("column = 'hp'").collect()} == {3200}


def test_file_names(spark, tmp_path):
    df = spark.createDataFrame([(0, "A 1"), (1, "A"), (2, "A"), (3, "B"), (4, "B"), (5, None)], "k int, name string")
    assert [r.stem for r in sinks.allocate_names(df, ["k"]).orderBy("k").collect()] == ["A_1", "A", "A_2", "B", "B_1", "unknown"]
    taken = spark.createDataFrame([("B",)], "stem string")
    assert [r.stem for r in sinks.allocate_names(df, ["k"], taken).orderBy("k").collect()][3:5] == ["B_1", "B_2"]
    sinks.write_text_files(df.select(F.concat(F.lit("f"), F.col("k").cast("string")).alias("stem"), F.coalesce("name", F.lit("")).alias("text")), str(tmp_path))
    assert sorted(p.name for p in tmp_path.glob("*.md")) == [f"f{i}.md" for i in range(6)] and (tmp_path / "f1.md").read_text() == "A"
    files = readers.record_files(readers.markdown_files(spark, str(tmp_path)))
    assert files.count() == 5  # an empty file has no row
    assert sinks.rewrite_files(files.where("file = 'f1.md'").withColumn("text", F.lit("new")), backup=True) == 1 and (tmp_path / "f1.md").read_text() == "new" and (tmp_path / "f1.md.bak").read_text() == "A"
    with pytest.raises(ValueError):
        sinks.inside(str(tmp_path), "../x")


def _first_free(names, taken):
    seen, out = set(taken), []
    for base in names:
        name, i = base, 1
        while name in seen:
            name, i = f"{base}_{i}", i + 1
        seen.add(name)
        out.append(name)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_file_names_equal_one_by_one_allocation(spark, seed):
    rng = random.Random(seed)
    bases = ["A", "A_1", "A_2", "A_1_1", "A_1_1_1", "A_10", "B", "B_01", "B_1", "C_3", "C"]
    names = [rng.choice(bases[: rng.choice([3, 6, 11])]) for _ in range(120)]
    taken = rng.sample(["A", "A_3", "A_1_2", "B_2", "C_3", "C_3_1", "Z"], seed)
    df = spark.createDataFrame(list(enumerate(names)), "k int, name string").repartition(5)
    held = spark.createDataFrame([(t,) for t in taken], "stem string") if taken else None
    got = {r.k: r.stem for r in sinks.allocate_names(df, ["k"], held).collect()}
    assert [got[k] for k in range(120)] == _first_free(names, taken)


def test_many_nameless_records_are_numbered_in_many_tasks(spark):
    df = spark.range(100_000).select(F.col("id").alias("k"), F.lit(None).cast("string").alias("name")).repartition(8)
    named = sinks.allocate_names(df, ["k"])
    got = named.agg(F.count_distinct("stem").alias("n"), F.max(F.when(F.col("k") == 0, F.col("stem"))).alias("a"), F.max(F.when(F.col("k") == 99_999, F.col("stem"))).alias("z")).first()
    assert tuple(got) == (100_000, "unknown", "unknown_99999")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # Spark would put this little into one task
    sizes = [r.n for r in sinks.allocate_keys(df, ["k"]).groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(sizes) < 50_000


def test_rewriting_is_all_or_nothing(spark, tmp_path):
    for i in range(6):
        (tmp_path / f"f{i}.md").write_text(f"old {i}")
    rows = [(f"file:{tmp_path}/f{i}.md", f"new {i}") for i in range(6)]
    frame = spark.createDataFrame(rows, "path string, text string").repartition(4)
    late = frame.withColumn("text", F.when(F.col("text") == "new 4", F.raise_error(F.lit("a task failed")).cast("string")).otherwise(F.col("text")))
    nowhere = frame.unionByName(spark.createDataFrame([(f"{tmp_path}/nowhere/f9.md", "new 9")], "path string, text string"))
    for broken, said in ((late, "a task failed"), (nowhere, "nowhere")):
        with pytest.raises(Exception, match=said):
            sinks.rewrite_files(broken, backup=True)
    assert sorted(f.name for f in tmp_path.iterdir()) == [f"f{i}.md" for i in range(6)]
    assert all((tmp_path / f"f{i}.md").read_text() == f"old {i}" for i in range(6))
    assert sinks.rewrite_files(spark.createDataFrame(rows, "path string, text string").repartition(4), backup=True) == 6
    assert all((tmp_path / f"f{i}.md").read_text() == f"new {i}" and (tmp_path / f"f{i}.md.bak").read_text() == f"old {i}" for i in range(6))
    assert len(list(tmp_path.iterdir())) == 12
    assert sinks.rewrite_files(spark.createDataFrame([], "path string, text string")) == 0


def test_one_file_of_many_tasks(spark, tmp_path):
    rows = spark.range(500).select(F.when(F.col("id") % 50 == 0, F.lit("")).otherwise(F.concat(F.lit("é"), F.col("id").cast("string"))).alias("text"), "id").repartitionByRange(7, "id").sortWithinPartitions("id")
    path = tmp_path / "out.txt"
    sinks.one_file(spark, str(path), ["<ü>\n", sinks.Part(rows, ",\n"), "\n", sinks.Part(rows.limit(0)), sinks.Part(rows.where("id = 1")), "</ü>"])
    want = ["" if i % 50 == 0 else f"é{i}" for i in range(500)]
    assert path.read_bytes().decode() == "<ü>\n" + ",\n".join(want) + "\né1</ü>" and [f.name for f in tmp_path.iterdir()] == ["out.txt"]
    with pytest.raises(Exception, match="no such thing"):
        sinks.one_file(spark, str(path), [sinks.Part(rows.withColumn("text", F.when(F.col("id") == 400, F.raise_error(F.lit("no such thing")).cast("string")).otherwise(F.col("text"))))])
    assert path.read_text().startswith("<ü>") and [f.name for f in tmp_path.iterdir()] == ["out.txt"]
    entries = spark.createDataFrame([(2, '{"a": "é", "b": [1, {}]}'), (1, '{"a": "x\\ny"}')], "k int, json string")
    sinks.one_file(spark, str(path), sinks.json_array(entries, ["k"]))
    wanted = [json.loads(r.json) for r in entries.orderBy("k").collect()]
    assert path.read_text() == json.dumps(wanted, indent=2, ensure_ascii=False) + "\n"
    sinks.one_file(spark, str(path), sinks.json_array(entries.limit(0), ["k"]))
    assert json.loads(path.read_text()) == []


def test_index_pages_are_lines(spark):
    rows = spark.range(3000).selectExpr("concat('N', lpad(id, 5, '0')) AS name", "CAST(id % 3 AS INT) AS tier", "'Solo' AS adversary_type", "CAST(id AS INT) AS difficulty", "1 AS threshold_minor", "2 AS threshold_major", "CAST(NULL AS STRING) AS thresholds_raw", "3 AS hp", "4 AS stress", "'s' AS source", "CAST(id AS INT) AS page", "0 AS block")
    places = rows.selectExpr("name", "tier", "'Event' AS environment_type", "CAST(difficulty AS STRING) AS difficulty", "'x' AS impulses", "source", "page", "block").limit(2)
    lines = index.master_index(rows, places).orderBy("line_no").collect()
    assert [r.line_no for r in lines] == list(range(1, len(lines) + 1)) and max(len(r.text) for r in lines) < 80
    text = "\n".join(r.text for r in lines)
    assert text.startswith("# Adversaries Master Index\n\n## Adversaries\n\n### Unknown Tier\n\n| Name | Type") and "\n\n### Tier 1\n\n| Name" in text
    assert text.endswith("## Summary\n\n**Total adversaries:** 3000\n- Unknown Tier: 1000\n- Tier 1: 1000\n- Tier 2: 1000\n\n**Total environments:** 2\n- Unknown Tier: 1\n- Tier 1: 1")
    none = rows.limit(0)
    assert [r.text for r in index.master_index(none).orderBy("line_no").collect()] == ["# Adversaries Master Index", "", "## Summary", "", "**Total adversaries:** 0"]


def test_reading_pages_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "my-book.txt").write_text("one\ftwo")
    assert [tuple(r) for r in readers.text_pages(spark, str(tmp_path / "in")).orderBy("page").collect()] == [("my book", 1, "one"), ("my book", 2, "two")]
    from blockloom.streaming.folder import markdown_stream

    (tmp_path / "md").mkdir()
    (tmp_path / "md" / "a.md").write_text("# MOTH\n\n***Tier 1 Skulk***\n\n> **Difficulty:** 9 | **HP:** 3 \n")
    q = markdown_stream(spark, str(tmp_path / "md")).writeStream.format("memory").queryName("moths").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r.name, r.tier, r.hp) for r in spark.table("moths").collect()] == [("MOTH", 1, 3)]


def test_next_sort():
    assert browse.next_sort(None, "hp") == ("hp", False) and browse.next_sort(("hp", False), "hp") == ("hp", True)
    assert browse.next_sort(("hp", True), "hp") == ("hp", False) and browse.next_sort(("hp", True), "tier") == ("tier", False)


def test_ranked(spark):
    rows = [(i, "ab"[i % 7 == 0], (i * 37) % 101) for i in range(500)]
    df = spark.createDataFrame(rows, "i int, g string, v int").repartition(7)
    got = {r.i: r.rn for r in ranked(df, ["v", "i"], within=("g",)).collect()}
    for g in "ab":
        wanted = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0]))
        assert [got[r[0]] for r in wanted] == list(range(1, len(wanted) + 1))
    got = {r.i: r.place for r in ranked(df, ["v", "i"], name="place").collect()}
    assert [got[r[0]] for r in sorted(rows, key=lambda r: (r[2], r[0]))] == list(range(1, 501))
    assert ranked(df.limit(0), ["v"]).count() == 0
