import pytest
from pyspark.sql import functions as F

from blockloom.functions import text as T


def run(spark, f, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_clean_text(spark):
    assert run(spark, T.clean_text, "﻿7\nDiffi culty – 3\t x  \n\n\n\nunder-\nground\nSRD\nADVERSARY", None, "") == ["Difficulty - 3 x\n\nunderground\nADVERSARY", "", ""]
    assert run(spark, T.clean_text, "1d8 phy damage “kept”") == ["1d8 phy “kept”"]


@pytest.mark.parametrize(
    ("name", "stem"),
    [("CONVERGENCE, THE CITY", "Convergence_The_City"), ("Mîller’s Wéb", "Millers_Web"), ("../../x", "X"), ("???", "unknown"), ("", "unknown"), (None, "unknown"), ("a" * 200, "A" + "a" * 119), ("ﬁne ①", "Fine_1")],
)
def test_safe_filename(spark, name, stem):
    assert run(spark, T.safe_filename, name) == [stem]


def test_display_name(spark):
    names = ["o'connor's CHICKEN-foot hut", "ARCHMAGE’S TOWER", "it'll", "", None, "élan 3rd"]
    assert run(spark, T.display_name, *names) == ["O'Connor's Chicken-Foot Hut", "Archmage’s Tower", "It'll", "Unknown", "Unknown", "éLan 3Rd"]


def test_slugs_and_tags(spark):
    assert run(spark, T.slug, "Cave Ogre!", "--a--") == ["cave-ogre", "a"]
    assert run(spark, T.source_tag, "Hope and Fear", "My Book 2", None) == ["hope-and-fear", "my-book-2", "homebrew"]
    assert run(spark, T.source_from_filename, "Age-of-Umbra-Adversaries.pdf", "Adversaries-Environments-v1.5-.pdf", "undeadadversaries-compressed.pdf", "HF_ch4.pdf") == ["Age of Umbra Adversaries", "Adversaries: Environments v1.5", "Undead Adversaries", "Hope and Fear"]


def test_small_parsers(spark):
    assert run(spark, T.damage_type, "1d6  Physical", "2 magical", "magic") == ["1d6 phy", "2 mag", "mag"]
    assert [tuple(x) for x in run(spark, T.number_pair, "8 / 15", "none")] == [(8, 15), (None, None)]
    assert [tuple(x) for x in run(spark, T.source_of_footer, "*Source: Big, Bad Book, p. 12*", "*Source: Plain*", "-")] == [("Big, Bad Book", 12), ("Plain", None), (None, None)]
    assert run(spark, lambda v: F.to_json(T.as_number_or_text(v)), "+4", "+2d4", " 7 ") == ["4", '"+2d4"', "7"]
    assert run(spark, T.truthy, "Yes", "0", None, " on ") == [True, False, False, True]


def test_yaml_and_escapes(spark):
    assert run(spark, T.yaml_scalar, 'a"b\x85\x7f', "é", None) == ['"a\\"b\\u0085\\u007f"', '"é"', None]
    assert run(spark, T.script_safe, "</script>") == ["<\\/script>"] and run(spark, T.html_escape, '<a b="&">') == ["&lt;a b=&quot;&amp;&quot;&gt;"]


def test_repeated_half(spark):
    a = "".join(chr(97 + i % 26) + str(i) for i in range(120))
    assert run(spark, T.without_repeated_half, a + a, "short") == [a, "short"]


def test_repeated_half_takes_time_in_proportion_to_the_text(spark):
    import random
    import time

    rng = random.Random(7)
    plain = "".join(rng.choice("abé😀 ") for _ in range(1_000_000))
    late = plain + "x" * 50 + plain[400_000:]
    began = time.time()
    assert run(spark, T.without_repeated_half, plain, late) == [plain, _by_find(late)]
    assert time.time() - began < 30


def _by_find(text, window=100):
    mid = len(text) // 2
    places = (text.find(text[i : i + window], mid) for i in range(0, mid - window, window // 2))
    return text[: next(p for p in places if p >= 0)].strip()


def test_repeated_half_of_any_alphabet(spark):
    import random

    from blockloom.functions.text import _repeat_place

    rng = random.Random(3)
    for _ in range(2000):
        window = rng.choice([2, 3, 5, 7, 10])
        text = "".join(rng.choice("aé😀"[: rng.choice([1, 2, 3])]) for _ in range(rng.randrange(60)))
        mid = len(text) // 2
        places = (text.find(text[i : i + window], mid) - mid + 1 for i in range(0, mid - window, window // 2))
        assert _repeat_place(text, window) == next((p for p in places if p > 0), None), (text, window)


def test_names_of_every_script_decompose_as_unicode_says(spark):
    import random
    import re
    import unicodedata

    rng = random.Random(4)
    pool = [c for c in map(chr, [*range(0x20, 0x3000), *range(0xF900, 0xFFF0), *range(0x1D400, 0x1D800)]) if unicodedata.category(c) not in ("Cn", "Cs") and c not in T.V.APOSTROPHES]
    names = ["".join(rng.choice(pool) for _ in range(12)) for _ in range(400)] + ["Å\u0301ngström ﬁre ½", "e\u0301clair"]

    def plain(name):
        ascii_ = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c) and c not in T.V.APOSTROPHES)
        return "_".join(w[0].upper() + w[1:].lower() for w in re.sub("[^A-Za-z0-9]+", "_", ascii_).split("_") if w) or "unknown"

    rows = spark.createDataFrame([(n,) for n in names], "name string").select("name", T.safe_filename(F.col("name")).alias("stem"))
    assert "Python" not in rows._jdf.queryExecution().toString()
    wrong = [(r.name, r.stem, plain(r.name)) for r in rows.collect() if r.stem != plain(r.name)]
    assert not wrong, wrong[:5]
