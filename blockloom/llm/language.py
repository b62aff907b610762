"""Language identification by Bayesian fusion of evidence.

Four kinds of evidence are multiplied: how likely each language makes the text (letter trigrams, trained here on a
bounded sample of labelled documents; tempered, as neighbouring trigrams are not independent), the language that the
markup declares, the address suffix, and a prior of the host. What a declaration or a suffix tells is counted over all
rows, against the languages that the texts alone suggest; the prior of a host is counted likewise, without the row
itself, and smoothed towards that of its domain, which is smoothed towards that of all. One class more, ``und``, stands
for text in none of the languages: it makes all trigrams alike.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from blockloom.llm.common import cut, let, level_of, spread_join, texts_of

UNKNOWN = "und"
BITS = 16
#: Training documents of each language; weight of a trigram; strength of the smoothing.
SAMPLE_DOCS, TEMPER, SMOOTH = 1000, 1 / 3, 5.0
PRIOR_UNKNOWN = 0.02
_OPENS = re.compile(r"<(?:(script|style)\b|!--)?", re.I)
_CLOSES = {name: re.compile(rf"</{name}\s*+>", re.I) for name in ("script", "style")}
_TAG = re.compile(r"<html\b", re.I)
_LANG = re.compile(r"\slang\s*+=\s*+[\"']?([A-Za-z]+)", re.I)


def trigrams(text: str | None) -> np.ndarray:
    """Hash buckets of the byte trigrams of the text's lower-cased words, each between spaces."""
    if not text:
        return np.empty(0, np.int64)
    raw = np.frombuffer(b" " + text.lower().encode() + b" ", np.uint8)
    letter = (raw >= 128) | ((raw >= 97) & (raw <= 122))
    keep = letter | np.concatenate(([True], letter[:-1]))
    run = np.where(letter, raw, 32)[keep].astype(np.uint32)
    key = (run[:-2] << 16) | (run[1:-1] << 8) | run[2:]
    key = key[(run[1:-1] != 32)]
    return ((key * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64)


def visible(page: str | None) -> str:
    """The text of an HTML page without tags, scripts, styles and comments; what is not closed ends no earlier tag.

    One pass from each opening to its end: a kind of end that was once not found is not looked for again.
    """
    if not page:
        return ""
    out, at, found = [], 0, _OPENS.search(page)
    missing: set[str] = set()
    while found:
        name, end = (found[1] or found[0]).lower(), -1
        if name in _CLOSES and name not in missing:
            closed = _CLOSES[name].search(page, found.end())
            end = closed.end() if closed else -1
        elif name == "<!--" and name not in missing:
            end = page.find("-->", found.end()) + 3
            end = -1 if end == 2 else end
        if end < 0:
            missing.add(name)
            end = page.find(">", found.start() + 1) + 1
            if not end:
                break
        out += page[at : found.start()], " "
        at = end
        found = _OPENS.search(page, at)
    out.append(page[at:])
    return _html.unescape("".join(out))


def declared_in(page: str | None) -> str | None:
    """The language that the page's first ``html`` tag with a language declares."""
    tag = _TAG.search(page) if page else None
    while tag:
        end = page.find(">", tag.end())
        end = len(page) if end < 0 else end
        if found := _LANG.search(page, tag.end(), end):
            return found[1].lower()
        tag = _TAG.search(page, end)
    return None


def train(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", most: int = SAMPLE_DOCS) -> tuple[list[str], np.ndarray]:
    """Languages, in order, and the log probability of each trigram bucket in each, then in ``und``.

    Trained on nearly ``most`` documents of each language at most, those with the smallest hashes of key and text
    (repeated rows count once). Every language declared is a class, however many there are; each takes 256 KB.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in texts_of(batches):
            for lang, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                np.add.at(counts.setdefault(lang, np.zeros(1 << BITS, np.int64)), trigrams(t), 1)
        for lang, n in counts.items():
            there = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(there), pa.string()), pa.array(there, pa.int32()), pa.array(n[there], pa.int64())], ["lang", "bucket", "n"])

    rank = F.xxhash64(F.col(key), F.col(text), F.lit(20260101))
    known = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.lower(lang).alias("lang"), F.col(text).alias("t"), rank.alias("h"))
    # Over all rows only counts by language and level of the hash are put together; one row a language is broadcast.
    levels = known.select("lang", "h").distinct().groupBy("lang", level_of(F.col("h")).alias("level")).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("lang").orderBy(F.desc("level"))
    bound = levels.withColumn("_n", F.sum("n").over(upto)).where(F.col("_n") <= most).groupBy("lang").agg(F.min("level").alias("_low"))
    chosen = known.join(F.broadcast(cut(bound)), "lang").where(level_of(F.col("h")) >= F.col("_low")).dropDuplicates(["lang", "h"]).select("lang", "t")
    rows = chosen.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(rows["lang"].to_pylist()))
    counts = np.zeros((1 << BITS, len(names) + 1))
    place = {name: i for i, name in enumerate(names)}
    counts[rows["bucket"].to_numpy(), [place[x] for x in rows["lang"].to_pylist()]] = rows["n"].to_numpy()
    logs = np.log((counts + 0.5) / (counts.sum(0) + 0.5 * (1 << BITS)))
    logs[:, -1] = -np.log(1 << BITS)
    return names, logs.astype(np.float32)


def _host(address: str | None) -> tuple[str, str, str]:
    """Host, domain (its last two labels) and suffix of an address; a name without dots has no suffix."""
    host = re.split(r"[/?#]", (address or "").split("://")[-1], maxsplit=1)[0].rpartition("@")[2].partition(":")[0].lower().strip(".")
    labels = host.split(".")
    return host, ".".join(labels[-2:]), labels[-1] if len(labels) > 1 else ""


EVIDENCE = [StructField("_ll", ArrayType(DoubleType())), StructField("_n", LongType()), StructField("_host", StringType()), StructField("_domain", StringType()), StructField("_suffix", StringType()), StructField("_said", StringType())]


def _evidence(rows: DataFrame, model, names: list[str], text: str, address: str, declared: str | None, markup: bool, keep: bool) -> DataFrame:
    plain = [F.col(f"`{c}`") for c in rows.columns] if keep else []
    kinds = [f for f in rows.schema.fields] if keep else []
    known = set(names)
    source = rows.select(*plain, F.col(text).alias("_text"), F.col(address).cast("string").alias("_address"), (F.col(declared).cast("string") if declared else F.lit(None).cast("string")).alias("_declared"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = model.value
        for batch in texts_of(batches):
            n = len(kinds)
            out: list[list] = [[] for _ in EVIDENCE]
            for t, a, said in zip(*(batch.column(n + i).to_pylist() for i in range(3)), strict=True):
                if markup:
                    t, said = visible(t), declared_in(t) if said is None else said
                grams = trigrams(t)
                said = re.split("[-_]", said.strip().lower())[0] if said else "none"
                row = (np.array([logs[grams[i : i + 8192]].sum(0, dtype=np.float64) for i in range(0, len(grams), 8192)]).sum(0).tolist() if len(grams) else [0.0] * logs.shape[1], len(grams), *_host(a), said if said in known or said == "none" else "other")
                for column, v in zip(out, row, strict=True):
                    column.append(v)
            arrays = [pa.array(c, pa.list_(pa.float64()) if i == 0 else pa.int64() if i == 1 else pa.string()) for i, c in enumerate(out)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *arrays], [*batch.schema.names[:n], *[f.name for f in EVIDENCE]])

    return source.mapInArrow(run, StructType([*kinds, *EVIDENCE]))


def _total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def _posterior(logs: Column) -> Column:
    """Probabilities from log weights; each step is worked out once."""
    exps = let(logs, lambda v: let(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp(x - top))))
    return let(exps, lambda e: let(_total(e), lambda s: F.transform(e, lambda x: x / s)))


def _add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _sums(rows: DataFrame, by: list[str], n: int, of: str = "_p") -> DataFrame:
    """Sums of the vectors ``of`` by group: one aggregate a place, so partial sums are taken before the shuffle."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"), *[F.sum(F.col(of)[i]).alias(f"_s{i}") for i in range(n)]).select(*by, "_rows", F.array(*[f"_s{i}" for i in range(n)]).alias("_sum"))


def identify(rows: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", address: str = "source", declared: str | None = None, markup: bool = False) -> DataFrame:
    """``rows`` with ``language``, ``confidence`` (its posterior probability) and ``host``.

    ``markup``: ``text`` is HTML, whose tags are left out and whose declared language is read. A text without letters
    (null, empty) is ``und`` with confidence 0. A null address is a host of its own name (empty). Texts are scored
    whole. Repeated rows agree, and equal posteriors go to the first language by name. The three columns, and such that
    begin with ``_``, are replaced. An empty table gives an empty one. Rows are read twice and never shuffled while the
    hosts are few; the second pass joins tables of counts.
    """
    names, logs = model
    classes = [*names, UNKNOWN]
    n = len(classes)
    rows = rows.drop("language", "confidence", "host", *[c for c in rows.columns if c.startswith("_")])
    shared = rows.sparkSession.sparkContext.broadcast(logs)
    start = np.log(np.array([(1 - PRIOR_UNKNOWN) / max(1, n - 1)] * (n - 1) + [PRIOR_UNKNOWN]))
    prior = F.array(*[F.lit(float(x)) for x in start])
    tempered = F.transform("_ll", lambda x: x * TEMPER)

    seen = _evidence(rows, shared, names, text, address, declared, markup, keep=False).where(F.col("_n") > 0)
    seen = cut(seen.withColumn("_ll", tempered).withColumn("_p", _posterior(_add(F.col("_ll"), prior))))
    totals = F.array(*[F.lit(float(x or 0)) for x in seen.agg(*[F.sum(F.col("_p")[i]) for i in range(n)]).first()])

    def likelihood(by: str, out: str) -> DataFrame:
        """Log probability of each value of ``by`` in each language, with one row's worth of smoothing for each of about ten values."""
        return _sums(seen, [by], n).select(by, "_rows", F.zip_with("_sum", totals, lambda s, t: F.log((s + 1) / (t + 10))).alias(out))

    # A said language is one of the model's or "none" or "other".
    said, suffix = cut(likelihood("_said", "_by_said").drop("_rows")), cut(likelihood("_suffix", "_by_suffix"))
    fused = spread_join(seen.join(F.broadcast(said), "_said"), suffix, ["_suffix"], "_rows", F.xxhash64("_n", "_ll"))
    fused = fused.withColumn("_p", _posterior(_add(_add(_add(F.col("_ll"), prior), F.col("_by_said")), F.col("_by_suffix"))))
    hosts = cut(_sums(fused, ["_host", "_domain", "_suffix"], n))
    domains = cut(_sums(hosts, ["_domain"], n, "_sum").withColumnRenamed("_sum", "_dsum"))
    whole = [float(x or 0) for x in hosts.agg(*[F.sum(F.col("_sum")[i]) for i in range(n)]).first()]
    overall = F.array(*[F.lit((x + 1) / (sum(whole) + n)) for x in whole])
    table = spread_join(hosts.withColumnRenamed("_rows", "_n_rows").withColumnRenamed("_sum", "_hsum"), domains, ["_domain"], "_rows", F.xxhash64("_host"), "left")
    table = spread_join(table, suffix, ["_suffix"], "_rows", F.xxhash64("_host"))
    table = cut(table.select("_host", F.col("_n_rows").alias("_rows"), "_hsum", "_dsum", "_by_suffix"))

    out = _evidence(rows, shared, names, text, address, declared, markup, keep=True)
    nothing = F.array(*[F.lit(0.0)] * n)
    out = spread_join(out.join(F.broadcast(said), "_said", "left"), table, ["_host"], "_rows", F.xxhash64("_n", "_ll"), "left")
    out = out.withColumn("_base", _add(_add(F.transform("_ll", lambda x: x * TEMPER), F.coalesce("_by_said", nothing)), F.coalesce("_by_suffix", nothing)))
    own = _posterior(_add(F.col("_base"), prior))
    minus = lambda v, p: F.zip_with(F.coalesce(v, nothing), p, lambda x, y: F.greatest(F.lit(0.0), x - y))
    out = out.withColumn("_own", own).withColumn("_d", minus("_dsum", F.col("_own"))).withColumn("_h", minus("_hsum", F.col("_own")))
    out = out.withColumn("_dp", let(_total(F.col("_d")), lambda n: F.zip_with("_d", overall, lambda s, g: (s + SMOOTH * g) / (n + SMOOTH))))
    out = out.withColumn("_hp", let(_total(F.col("_h")), lambda n: F.zip_with("_h", "_dp", lambda s, g: F.log((s + SMOOTH * g) / (n + SMOOTH)))))
    out = out.withColumn("_p", _posterior(_add(F.col("_base"), F.col("_hp"))))
    best = F.array_max("_p")
    language = F.element_at(F.array(*[F.lit(c) for c in classes]), F.array_position("_p", best).cast("int"))
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], F.when(F.col("_n") > 0, language).otherwise(UNKNOWN).alias("language"), F.when(F.col("_n") > 0, F.round(best, 6)).otherwise(0.0).alias("confidence"), F.col("_host").alias("host"))
