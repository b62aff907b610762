"""A stream of pages, cut anywhere, settles what one parse of all pages finds."""

import itertools

from blockloom.operators.records import parse_lines
from blockloom.sources.pages import lines_from_pages
from blockloom.streaming.folder import page_flush, page_stream
from tests.test_parse import CASES, FEATURES, block

SOURCES = {k: CASES[k] for k in ("break", "break_header", "index_page", "mid_sentence", "spilled", "unfinished", "two")} | {
    "carry": ["TIER 3 ADVERSARIES", block("ONE MOTH", "Tier Skulk"), block("TWO MOTH", "Tier Skulk", features=""), FEATURES + "\n\n" + block("THREE MOTH", "Tier Skulk"), "TIER 2 ADVERSARIES\n" + block("FOUR MOTH", "Tier Skulk")],
}


def listed(p):
    out = [("a", r.source, r.page, r.name, r.tier, len(r.features), r.features[-1].description) for r in p.adversaries.collect()]
    return out + [("e", r.source, r.page, r.name) for r in p.environments.collect()] + [("r", r.source, r.page, r.description) for r in p.rejected.collect()]


def test_a_stream_cut_anywhere_equals_one_parse(spark, tmp_path):
    rows = [(s, i + 1, t) for s, pages in SOURCES.items() for i, t in enumerate(pages)]
    schema = "source string, page int, text string"
    want = sorted(map(str, listed(parse_lines(lines_from_pages(spark.createDataFrame(rows, schema))))))
    assert len(want) > 12
    # The sources are cut after one, two or three pages, each elsewhere.
    cut = {s: 1 + n % 3 for n, s in enumerate(SOURCES)}
    batches = [[r for r in rows if r[1] <= cut[r[0]]], [r for r in rows if cut[r[0]] < r[1] <= cut[r[0]] + 1], [r for r in rows if r[1] > cut[r[0]] + 1]]
    (tmp_path / "in").mkdir()
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in/{n}")
    got = {}
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).json(str(tmp_path / "in"))
    query = page_stream(stream, lambda p, epoch: got.__setitem__(epoch, listed(p)), str(tmp_path / "cp"))
    query.processAllAvailable()
    query.stop()
    assert sorted(got) == [0, 1, 2]
    page_flush(spark, lambda p, epoch: got.__setitem__(epoch, listed(p)), str(tmp_path / "cp"), 2)
    assert sorted(map(str, itertools.chain(*got.values()))) == want
