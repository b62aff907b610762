import pytest
from pyspark.sql import Row


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from ``(doc_id, text, source)`` rows, with columns that clash with those operators make."""

    def make(rows):
        full = [Row(doc_id=d, text=t, lang="en", source=s, n_chars=len(t or ""), node="x", key="x", score="x", spans="x", shard=-1, slot=-1, size="x", t="x", id="x") for d, t, s in rows]
        schema = "doc_id long, text string, lang string, source string, n_chars long, node string, key string, score string, spans string, shard int, slot int, size string, t string, id string"
        return spark.createDataFrame(full, schema)

    return make


ODD = [(1, None, None), (2, "", "a"), (None, "alpha beta", "a"), (4, "alpha beta", None), (4, "alpha beta", None), (5, "x " * 30_000, "b"), (6, "é中\U0001f600 \x00 \t\n", "c")]
