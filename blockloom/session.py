"""Session defaults for local runs and tests; a cluster's own settings win."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(name: str = "blockloom", cores: int | None = None) -> SparkSession:
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where ``spark.checkpoint.dir`` is unset, local mode gets a temporary folder and a
    cluster is refused."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


#: Rows that one task gets of a table dealt out by its number of rows.
ROWS_OF_TASK = 250_000


def spread(df: DataFrame, *keys: str, rows: int = 0) -> DataFrame:
    """``df`` dealt out by ``keys`` (or evenly) to all cores. A small file may hold many rows and be read by one task,
    and what is made of them is many times their size; rows of equal keys come to one task. Of a table of ``rows`` rows
    a task gets no more the larger the table is."""
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_OF_TASK))
    return df.repartition(n, *keys)


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the session's checkpoint folder, for plans that read a costly result more than once."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def once(rows: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """``rows`` with the fields, worked out once a row.

    They stand in one struct with a row's number. As that is no function of the row, the optimizer leaves the struct in
    one place, where it would otherwise repeat the fields in every filter and projection above.
    """
    made = rows.withColumn("_f", F.struct(*[c.alias(n) for n, c in fields.items()], F.monotonically_increasing_id().alias("_row")))
    return made.select(*[c for c in rows.columns if c not in fields], *[F.col(f"_f.{n}").alias(n) for n in fields])
