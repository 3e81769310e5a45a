"""Helpers shared by the corpus operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, remove_at_exit

BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet into the cluster's shared folder
    (``spark.checkpoint.dir``) and read back: cuts the lineage, outlives any
    executor.  The schema is given, so an empty frame reads back as well."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    remove_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def stored_all(spark: SparkSession, frames: Iterable[DataFrame], schema: str) -> DataFrame:
    """``stored`` for frames of one schema, written one after the other into
    one table."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{uuid.uuid4().hex}"
    spark.createDataFrame([], schema).write.mode("error").parquet(path)
    remove_at_exit(spark, path)
    for df in frames:
        df.write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's source files to the executors, once an application
    (``addPyFile``), so that tasks can import it wherever the driver runs."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(), "skytune_src.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


#: Rows come in batches of so many, whatever their length, unless a session says
#: otherwise.  An Arrow batch is held by the JVM twice, outside its heap, and by
#: a Python worker: here it is as long as one chunk at most.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": "3840k", "spark.sql.parquet.columnarReaderBatchSize": "512"}


def small_batches(spark: SparkSession) -> None:
    """Have the session's plans hand on long texts some MB at a time.  What the
    session has set itself stays."""
    for key, value in SMALL_BATCHES.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def scalar(df: DataFrame, expr):
    """One aggregate value of ``df`` (a single row reaches the driver)."""
    return df.agg(expr.alias("v")).first()["v"]


def pick(df: DataFrame, *cols: str) -> DataFrame:
    """Only the named columns, so that other columns cannot clash."""
    return df.select(*[F.col(f"`{c}`") for c in cols])
