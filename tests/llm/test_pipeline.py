import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from blockloom.llm import decontaminate as D
from blockloom.llm import near_dup as N
from blockloom.llm import queries
from blockloom.llm.common import table
from tests.llm.conftest import ODD
from tests.llm.test_decontaminate import brute
from tests.llm.test_near_dup import classes


def test_stages_follow_each_other(spark, sf):
    docs = table(spark, sf, "documents")
    before = docs
    for name, stage in C.STAGES:
        after = stage(spark, before, sf).cache()
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in before.select("doc_id").collect()}
        if name != C.STAGES[-1][0]:
            assert after.columns == docs.columns and after.dtypes == docs.dtypes
        rows = [(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()]
        if name == "language":
            assert len(ids) == before.count()
        if name == "near_duplicates":
            assert ids == {d for d, c in classes(rows, N.word_weights(before)).items() if c == d}
        if name == "decontamination":
            items = [(str(r.item_id), r.text) for r in table(spark, sf, "benchmark").collect()]
            found = brute([t for _, t in rows], items)
            assert ids == {d for (d, _), (n, _, hit) in zip(rows, found) if not (hit and 20 * hit >= n)}
        if name == "mix":
            words = lambda df: df.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
            assert abs(words(after) - 1.5 * words(before)) <= 40
        if name == "shards":
            per = [r["count"] for r in after.groupBy("shard").count().collect()]
            assert len(per) == C.SHARDS and max(per) - min(per) <= 1 and after.count() == before.count()
        before = after


@pytest.mark.parametrize(("name", "stage"), C.STAGES)
def test_stages_take_odd_rows_and_empty_tables(spark, sf, docs_of, name, stage):
    """Nulls, empty and long texts, repeated rows and columns with names that the operators use themselves."""
    rows = docs_of([*ODD, (4, "alpha beta", None)])
    extra = [] if name != C.STAGES[-1][0] else ["shard", "slot"]
    got = stage(spark, rows, sf)
    assert got.columns == [*C.COLUMNS, *extra]
    n = len(got.collect())
    assert n == {"near_duplicates": 5, "decontamination": 8, "shards": 8}.get(name, n) and n <= 16
    assert stage(spark, docs_of([]), sf).collect() == []


def test_repeated_rows_leave_one(spark, docs_of):
    rows = docs_of([(1, "same words here and there", "a"), (1, "same words here and there", "a"), (2, "same words here and there", "a"), (3, None, "a"), (3, None, "a"), (None, "other text of some length", "b")])
    got = C.one_of_each_group(spark, rows, "").collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(1, "same words here and there"), (3, None), (None, "other text of some length")], key=str)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs_on_whole_tables(spark, sf, name):
    """One row for each row of the table; for each conversation; for the ten best documents of each item."""
    rows = queries.QUERIES[name](spark, sf).count()
    if name == "op11_conversation_repair":
        assert rows == table(spark, sf, "conversations").select("conv_id").distinct().count()
        return
    if name == "op12_lexical_search":
        assert rows == 10 * table(spark, sf, "benchmark").count()
        return
    source = {"op5_embedding_near_dedup": "embeddings", "op9_language_fusion": "pages"}.get(name, "documents")
    assert rows == table(spark, sf, source).count()


def test_licence_sql(spark, sf):
    import duckdb

    c = duckdb.connect()
    c.execute(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    want = c.execute(queries.ORACLE_SQL["op7_licence_rules"]).fetchall()
    got = queries.QUERIES["op7_licence_rules"](spark, sf).select("doc_id", "n_sentences", "sentence_ids", "licences").collect()
    assert sorted(map(tuple, got)) == sorted(want) and D.WINDOW == 13
