"""File names and writers: one file for each record, one file of many rows, in-place rewriting."""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from blockloom.functions.regex import nothing
from blockloom.functions.text import safe_filename
from blockloom.operators.ranking import ranked
from blockloom.session import settled


#: Bases with passed numbers up to which these are broadcast.
BROADCAST_BASES = 100_000


def _free_number(k: Column, passed: Column) -> Column:
    """The number that the record with ``k`` others of its base before it gets, if it passes these (in order)."""
    return F.aggregate(F.coalesce(passed, nothing("bigint")), k, lambda n, p: F.when(p <= n, n + 1).otherwise(n))


def _passed_numbers(placed: DataFrame, taken: DataFrame | None) -> DataFrame | None:
    """``_base, _passed``: the numbers (0 is the bare base) that a base's records find taken, in order; None for none.

    A name ``b_i`` can be claimed by the records of ``b`` when they come to the number i, and by the first record of the
    base ``b_i``; who comes first has it. Whether ``b`` passes i depends on the numbers before i alone, and on whether
    ``b`` itself went to the base that it ends in a number of; so bases are settled by the number of such endings, all
    of a kind at once. Only bases and the times of single records are looked at, no group of records.
    """
    bases = placed.groupBy("_base").agg(F.min("_t").alias("f"), F.count(F.lit(1)).alias("n"))
    claims = bases.select(F.col("_base").alias("name"), "f")
    if taken is not None:
        claims = claims.unionByName(taken.select(F.col("stem").alias("name"), F.lit(-1).cast("long").alias("f"))).groupBy("name").agg(F.min("f").alias("f"))
    ending = r"^(.*)_([1-9][0-9]{0,8})$"
    claims = claims.withColumns({"parent": F.regexp_extract("name", ending, 1), "i": F.regexp_extract("name", ending, 2).try_cast("long")})
    parents = bases.select(F.col("_base").alias("parent"), "n")
    kin = settled(claims.join(parents, "parent").where("i IS NOT NULL").select("parent", "n", "name", "i", "f"))
    gone = claims.where("f = -1").join(bases.select(F.col("_base").alias("name")), "name", "left_semi").select("name")
    blocked = settled(gone)
    if kin.isEmpty() and blocked.isEmpty():
        return None
    depth = F.size(F.regexp_extract_all(F.regexp_extract("_base", r"((?:_[1-9][0-9]{0,8})*)$", 1), F.lit("_"), F.lit(0)))
    open_ = settled(kin.select(F.col("parent").alias("_base")).unionByName(blocked.select(F.col("name").alias("_base"))).distinct().withColumn("depth", depth))
    out = None
    # A base is blocked by a claim of the kind before it, so kinds with children go one deeper than their parents.
    for d in range(64):
        if out is not None and open_.where(F.col("depth") >= d).isEmpty():
            break
        now = open_.where(F.col("depth") == d).join(blocked.distinct().withColumn("held", F.lit(True)), F.col("_base") == F.col("name"), "left").select("_base", F.coalesce("held", F.lit(False)).alias("held"))
        mine = kin.join(now.select(F.col("_base").alias("parent")), "parent")
        mine = mine.withColumn("j", F.row_number().over(Window.partitionBy("parent").orderBy("i")))
        asked = mine.select(F.col("parent").alias("_base"), F.explode(F.sequence(F.greatest(F.col("i") - F.col("j"), F.lit(0).cast("long")), F.col("i"))).alias("_k")).distinct()
        times = placed.select("_base", "_k", "_t").join(asked, ["_base", "_k"]).groupBy("_base").agg(F.map_from_entries(F.collect_list(F.struct("_k", "_t"))).alias("times"))
        children = mine.groupBy(F.col("parent").alias("_base")).agg(F.array_sort(F.collect_list(F.struct("i", "f", "name"))).alias("children"))
        rows = now.join(children, "_base", "left").join(times, "_base", "left")

        def step(acc: Column, child: Column) -> Column:
            t = F.try_element_at(F.col("times"), child["i"] - F.size(acc["passed"]))
            late = t.isNotNull() & (child["f"] < t)
            won = t.isNotNull() & ~late
            return F.struct(F.when(late, F.concat(acc["passed"], F.array(child["i"]))).otherwise(acc["passed"]).alias("passed"), F.when(won, F.concat(acc["won"], F.array(child["name"]))).otherwise(acc["won"]).alias("won"))

        start = F.struct(F.when(F.col("held"), F.array(F.lit(0).cast("long"))).otherwise(nothing("bigint")).alias("passed"), nothing("string").alias("won"))
        done = settled(rows.select("_base", F.aggregate(F.coalesce("children", nothing("struct<i:bigint,f:bigint,name:string>")), start, step).alias("r")).select("_base", "r.passed", "r.won"))
        passed = done.where(F.size("passed") > 0).select("_base", F.col("passed").alias("_passed"))
        out = passed if out is None else out.unionByName(passed)
        won = done.select(F.explode("won").alias("name"))
        blocked = blocked.unionByName(won)
        open_ = open_.unionByName(won.join(bases.select(F.col("_base").alias("name")), "name", "left_semi").select(F.col("name").alias("_base"), F.lit(d + 1).alias("depth"))).distinct()
    return out


def allocate_names(records: DataFrame, order: list[str], taken: DataFrame | None = None) -> DataFrame:
    """``records`` with ``stem``: the safe file name, with _1, _2 ... appended while it is taken by an earlier record.

    ``taken`` (column ``stem``) are names that may not be used at all. Records get their places in the order and among
    those of their base by ranges and offsets, so no task holds a base's records; a number that another base or
    ``taken`` has is passed (see ``_passed_numbers``).
    """
    keys = [f.name for f in records.schema.fields]
    placed = ranked(records.withColumn("_base", safe_filename(F.col("name"))), order, name="_t")
    placed = settled(ranked(placed, ["_t"], within=("_base",), name="_k").withColumns({"_k": F.col("_k").cast("long") - 1, "_t": F.col("_t").cast("long")}))
    passed = _passed_numbers(placed, taken)
    number = F.col("_k")
    if passed is not None:
        n = passed.count()
        placed = placed.join(F.broadcast(passed) if n <= BROADCAST_BASES else passed, "_base", "left")
        number = _free_number(F.col("_k"), F.col("_passed"))
    placed = placed.withColumn("_n", number)
    return placed.select(*keys, F.when(F.col("_n") == 0, F.col("_base")).otherwise(F.concat_ws("_", "_base", F.col("_n").cast("string"))).alias("stem"))


def allocate_keys(records: DataFrame, order: list[str]) -> DataFrame:
    """``records`` with ``key``: the name, with (1), (2) ... for later records of the same name."""
    named = records.withColumn("_same", F.coalesce(F.concat(F.lit("="), F.col("name")), F.lit("")))
    placed = ranked(named, order, within=("_same",), name="_nth").drop("_same")
    nth = F.col("_nth") - 1
    return placed.withColumn("key", F.when(nth == 0, F.col("name")).otherwise(F.concat(F.col("name"), F.lit(" ("), nth.cast("string"), F.lit(")")))).drop("_nth")


class TextFiles(DataSource):
    """``df.write.format("text_files").save(folder)``: the file ``stem`` with ``text``, one for each row."""

    @classmethod
    def name(cls) -> str:
        return "text_files"

    def schema(self) -> str:
        return "stem string, text string"

    def writer(self, schema, overwrite) -> DataSourceWriter:
        return _TextWriter(self.options)


class _Written(WriterCommitMessage):
    def __init__(self, n: int):
        self.n = n


class _TextWriter(DataSourceWriter):
    """Writes to a folder that executors share; each file is moved into place when it is whole, so retries are safe."""

    def __init__(self, options):
        self.folder, self.suffix = options["path"].removeprefix("file:"), options.get("suffix", ".md")

    def write(self, iterator: Iterator) -> _Written:
        os.makedirs(self.folder, exist_ok=True)
        n = 0
        for n, row in enumerate(iterator, 1):
            part = os.path.join(self.folder, f".{row.stem}.{os.getpid()}")
            with open(part, "w", encoding="utf-8", newline="\n") as out:
                out.write(row.text)
            os.replace(part, os.path.join(self.folder, row.stem + self.suffix))
        return _Written(n)


def write_text_files(rows: DataFrame, folder: str) -> None:
    rows.sparkSession.dataSource.register(TextFiles)
    rows.select("stem", "text").write.format("text_files").mode("append").save(folder)


class StagedParts(DataSource):
    """``df.write.format("staged_parts").save(folder)``: a file ``part-<n>`` for each partition that has rows: their
    ``text`` with ``between`` between them. A file is moved into place when it is whole, so retries are safe."""

    @classmethod
    def name(cls) -> str:
        return "staged_parts"

    def schema(self) -> str:
        return "text string"

    def writer(self, schema, overwrite) -> DataSourceWriter:
        return _PartWriter(self.options)


class _PartWriter(DataSourceWriter):
    def __init__(self, options):
        self.folder, self.between = options["path"].removeprefix("file:"), options.get("between", "\n")

    def write(self, iterator: Iterator) -> _Written:
        name = os.path.join(self.folder, f"part-{TaskContext.get().partitionId()}")
        part, n, out = f"{name}.{uuid.uuid4().hex}", 0, None
        for row in iterator:
            if out is None:
                os.makedirs(self.folder, exist_ok=True)
                out = open(part, "w", encoding="utf-8", newline="\n")  # noqa: SIM115
            out.write((self.between if n else "") + row.text)
            n += 1
        if out is not None:
            out.close()
            os.replace(part, name)
        return _Written(n)


@dataclass
class Part:
    """Rows whose ``text`` goes into a file in their order, with ``between`` between them."""

    rows: DataFrame
    between: str = "\n"


def one_file(spark: SparkSession, path: str, pieces: list[str | Part]) -> None:
    """Writes one file of given texts and of rows, whose texts never come to the driver.

    Tasks write the texts of their partitions beside the file; their sizes, added up, say where each goes; then tasks
    copy them there. The folder must be one that executors share. The file appears when it is whole; if anything
    fails, an earlier one stays as it was.
    """
    spark.dataSource.register(StagedParts)
    path = os.path.abspath(path)
    mark = uuid.uuid4().hex
    folder, whole = f"{path}.parts-{mark}", f"{path}.new-{mark}"
    os.makedirs(folder)
    try:
        at, told, copied = 0, [], []
        for i, piece in enumerate(pieces):
            if isinstance(piece, str):
                told.append((at, piece.encode()))
                at += len(told[-1][1])
                continue
            inner = f"{folder}/{i}"
            piece.rows.select("text").write.format("staged_parts").option("between", piece.between).mode("append").save(inner)
            names = sorted(os.listdir(inner), key=lambda n: int(n.split("-")[1])) if os.path.isdir(inner) else []
            for k, name in enumerate(names):
                if k:
                    told.append((at, piece.between.encode()))
                    at += len(told[-1][1])
                copied.append((f"{inner}/{name}", at))
                at += os.path.getsize(f"{inner}/{name}")
        with open(whole, "wb") as out:
            out.truncate(at)
            for place, text in told:
                out.seek(place)
                out.write(text)
        if copied:
            spark.createDataFrame(copied, "part string, place long").repartition(len(copied), "place").foreachPartition(lambda rows: _copy(rows, whole))
        os.replace(whole, path)
    finally:
        shutil.rmtree(folder, ignore_errors=True)
        if os.path.exists(whole):
            os.remove(whole)


def _copy(parts: Iterator, whole: str) -> None:
    for part in parts:
        with open(part.part, "rb") as source, open(whole, "r+b") as out:
            out.seek(part.place)
            shutil.copyfileobj(source, out, 1 << 20)


def dumped(rows: DataFrame, indent: int | None = None) -> DataFrame:
    """``text`` of rows with ``json``: the value in the one field ``v``, or the whole, as Python prints it. ``indent``
    moves what is printed in by as many spaces too, as an element of a list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [json.loads(x) for x in batch.column(0).to_pylist()]
            if indent is None:
                texts = [json.dumps(v.get("v"), ensure_ascii=False) for v in values]
            else:
                texts = [" " * indent + json.dumps(v, indent=indent, ensure_ascii=False).replace("\n", "\n" + " " * indent) for v in values]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])

    return rows.select("json").mapInArrow(run, "text string")


def json_array(entries: DataFrame, order: list[str]) -> list[str | Part]:
    """The pieces of one JSON array of the rows' ``json``, indented by two spaces."""
    if entries.isEmpty():
        return ["[\n]\n"]
    return ["[\n", Part(dumped(entries.orderBy(*order), 2), ",\n"), "\n]\n"]


def html_table(rows: DataFrame, title: str, column: str | None = None, descending: bool = False) -> list[str | Part]:
    """The pieces of a page with a filter box for each column and one table.

    With ``column`` the rows are sorted by it, empty cells last; else they come in their own order.
    """
    import html

    from blockloom.operators import browse

    names = browse.shown_columns(rows)
    filters = set(browse.filter_columns(rows))
    head = f'<!DOCTYPE html>\n<html lang="en">\n<head><meta charset="utf-8"><title>{html.escape(title)}</title></head>\n<body>\n<h1>{html.escape(title)}</h1>\n<table>\n'
    head += "<thead><tr>" + "".join(f"<th>{html.escape(c.replace('_', ' ').title())}</th>" for c in names) + "</tr>\n"
    head += "<tr>" + "".join(f'<th><input name="{html.escape(c)}"></th>' if c in filters else "<th></th>" for c in names) + "</tr></thead>\n<tbody>\n"
    body = browse.sorted_rows(rows, column, descending) if column else rows
    cells = browse.table_cells(body.orderBy("rn").drop("rn") if column else body).withColumnRenamed("html", "text")
    return [head, Part(cells.withColumn("text", F.concat("text", F.lit("\n"))), ""), "</tbody>\n</table>\n</body>\n</html>\n"]


class RewrittenFiles(DataSource):
    """``df.write.format("rewritten_files")``: ``text`` takes the place of the file ``path``, all rows or none.

    Tasks put the new texts into folders beside the files; when all have, the files are moved into place, old ones kept
    as ``.bak`` first if asked.
    """

    @classmethod
    def name(cls) -> str:
        return "rewritten_files"

    def schema(self) -> str:
        return "path string, text string"

    def writer(self, schema, overwrite) -> DataSourceWriter:
        return _Rewriter(self.options)


class _Staged(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


def _local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


class _Rewriter(DataSourceWriter):
    def __init__(self, options):
        self.backup, self.mark, self.log = options.get("backup") == "true", options["mark"], options["log"]

    def write(self, iterator: Iterator) -> _Staged:
        files = []
        for row in iterator:
            path = _local(row.path)
            staged = os.path.join(os.path.dirname(path), self.mark, uuid.uuid4().hex)
            with open(staged, "w", encoding="utf-8", newline="\n") as out:
                out.write(row.text)
            shutil.copymode(path, staged)
            files.append((path, staged))
        return _Staged(files)

    def commit(self, messages: list) -> None:
        files = [f for m in messages if m is not None for f in m.files]
        for path, _ in files if self.backup else ():
            shutil.copy2(path, path + ".bak")
        for path, staged in files:
            os.replace(staged, path)
        with open(self.log, "w") as out:
            out.write(str(len(files)))


def rewrite_files(changes: DataFrame, backup: bool = False) -> int:
    """Writes ``text`` to ``path`` for every row (only changed files are rows), keeping the old file if asked; returns
    how many. A path may come once. The driver sees paths, no texts. If a task fails, all files stay as they were: what
    was written lies in folders that go in the end, and a task that is late finds none to write to.
    """
    spark = changes.sparkSession
    spark.dataSource.register(RewrittenFiles)
    folders = changes.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).distinct()
    mark = f".rewrite-{uuid.uuid4().hex}"
    made = [os.path.join(_local(r.folder), mark) for r in folders.collect()]
    if not made:
        return 0
    try:
        for folder in made:
            os.mkdir(folder)
        log = os.path.join(made[0], "count")
        changes.select("path", "text").write.format("rewritten_files").option("backup", str(backup).lower()).option("mark", mark).option("log", log).mode("append").save()
        with open(log) as told:
            return int(told.read())
    finally:
        for folder in made:
            shutil.rmtree(folder, ignore_errors=True)


def inside(folder: str, path: str) -> str:
    """``path`` made absolute, if it lies in ``folder``; an error otherwise."""
    root, full = os.path.realpath(folder), os.path.realpath(os.path.join(folder, path))
    if full != root and not full.startswith(root + os.sep):
        raise ValueError(f"{path} is outside {folder}")
    return full
