"""Keyed daily cache as a Parquet table by month.

One row per date.  A month's rows lie in ``month=2020-01/version=3``; the highest
version of a month is the table.  An append reads and writes only the months it
touches: it writes their next version, old and new rows together, under a
staging name and then renames month by month.  A rename is there or not, so a
write that fails between two steps neither doubles nor loses a day, and the
same append, repeated, adds what is still missing.  (On an object store without
atomic rename the table format has to give that guarantee.)  One writer at a
time; readers keep the versions they have listed, which the next append removes.

Range reads are pruned to the months of the range: literal bounds when the plan
is made, bounds from data when the query runs (the months join the table on its
partition column).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.dedup import keep_first
from ..session import cut_lineage

_MONTH, _VERSION = "month", "version"


def month_of(c):
    return F.date_format(c, "yyyy-MM")


class DailyCache:
    def __init__(self, spark: SparkSession, path: str, key: str = "date"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    # -- files ---------------------------------------------------------------------

    def _fs(self):
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        root = hadoop.Path(self.path)
        return root.getFileSystem(self.spark._jsc.hadoopConfiguration()), root, hadoop.Path

    def _versions(self) -> dict[str, list[int]]:
        """Versions of each month (names only: as many as months)."""
        fs, root, _ = self._fs()
        out: dict[str, list[int]] = {}
        if not fs.exists(root):
            return out
        for s in fs.listStatus(root):
            name = s.getPath().getName()
            if name.startswith(("_", ".")):
                continue
            if not (s.isDirectory() and name.startswith(f"{_MONTH}=")):
                raise ValueError(f"{s.getPath().toString()} is no part of a daily cache")
            for v in fs.listStatus(s.getPath()):
                if v.getPath().getName().startswith(f"{_VERSION}="):
                    out.setdefault(name.split("=", 1)[1], []).append(int(v.getPath().getName().split("=", 1)[1]))
        return out

    def _existing(self) -> DataFrame | None:
        """The table with its ``month`` column, None where there is none yet."""
        paths = [f"{self.path}/{_MONTH}={m}/{_VERSION}={max(vs)}" for m, vs in sorted(self._versions().items())]
        if not paths:
            return None
        # the newest month's columns; months must stay text, whatever the session infers
        schema = self.spark.read.parquet(paths[-1]).schema.add(_MONTH, T.StringType()).add(_VERSION, T.IntegerType())
        return self.spark.read.option("basePath", self.path).schema(schema).parquet(*paths).drop(_VERSION)

    def _table(self) -> DataFrame:
        df = self._existing()
        if df is None:
            raise FileNotFoundError(self.path)
        return df

    # -- reads ---------------------------------------------------------------------

    def read_range(self, start, end) -> DataFrame:
        """Rows with start <= key <= end."""
        first, last = (F.lit(x).cast("date") for x in (start, end))
        return self._table().where(F.col(self.key).between(first, last) & F.col(_MONTH).between(month_of(first), month_of(last))).drop(_MONTH)

    def read_between(self, bounds: DataFrame) -> DataFrame:
        """S5 with data-derived bounds: ``bounds`` is one row (start, end).  Its
        months, a row for each with the days wanted of it, are broadcast and
        prune the scan; nothing is collected."""
        first = F.trunc("start", "month")
        months = (bounds.select("start", "end", F.explode(F.sequence(first, F.trunc("end", "month"), F.expr("interval 1 month"))).alias("_first"))
                  .where(F.col("_first") <= F.col("end")).select(month_of("_first").alias(_MONTH), "start", "end"))
        return self._table().join(F.broadcast(months), _MONTH).where(
            F.col(self.key).between(F.col("start"), F.col("end"))).drop(_MONTH, "start", "end")

    def completeness_between(self, bounds: DataFrame, min_ratio: float = 0.9) -> DataFrame:
        """S6 with data-derived bounds (one row, broadcast)."""
        rows = self.read_between(bounds).agg(F.count(F.lit(1)).alias("rows"))
        days = F.datediff(F.col("end"), F.col("start"))
        return rows.crossJoin(F.broadcast(bounds)).select(
            "rows", days.alias("days"), (F.col("rows") >= F.lit(min_ratio) * days).alias("complete"))

    def completeness(self, start, end, min_ratio: float = 0.9) -> DataFrame:
        """One row (rows, days, complete) with complete = rows >= ratio x days."""
        rows = self.read_range(start, end).agg(F.count(F.lit(1)).alias("rows"))
        days = F.datediff(F.lit(end).cast("date"), F.lit(start).cast("date"))
        return rows.select("rows", days.alias("days"), (F.col("rows") >= F.lit(min_ratio) * days).alias("complete"))

    # -- appends -------------------------------------------------------------------

    def _of_months(self, old: DataFrame, rows: DataFrame) -> DataFrame:
        """``old`` rows in the months of ``rows``: the others are not read."""
        months = rows.select(_MONTH).distinct().where(F.col(_MONTH) > "")
        return old.join(F.broadcast(months), _MONTH)

    def new_rows(self, df: DataFrame) -> DataFrame:
        """S7 plan: rows of ``df`` whose key is not cached yet (one per
        key: the first in the order of the other columns)."""
        fresh = keep_first(df.where(F.col(self.key).isNotNull()), [self.key], [c for c in df.columns if c != self.key] or [self.key])
        old = self._existing()
        if old is None:
            return fresh
        held = self._of_months(old, fresh.withColumn(_MONTH, month_of(self.key)))
        return fresh.join(held.select(self.key), self.key, "left_anti")

    def append(self, df: DataFrame) -> int:
        """Append the new keys; returns how many rows were added."""
        new = cut_lineage(self.new_rows(df).withColumn(_MONTH, month_of(self.key)))
        n = new.count()
        if n:
            self._commit(self._staged(new))
        return n

    def _staged(self, new: DataFrame) -> str:
        """The next version of every touched month, complete, under a name that
        readers skip."""
        old = self._existing()
        whole = new if old is None else self._of_months(old, new).unionByName(new, allowMissingColumns=True)
        stage = f"{self.path}/_staging-{uuid.uuid4().hex}"
        whole.write.mode("error").partitionBy(_MONTH).parquet(stage)
        return stage

    def _commit(self, stage: str) -> None:
        """Rename each staged month to its next version, then remove what older
        versions and failed attempts left."""
        fs, root, path = self._fs()
        versions = self._versions()
        for s in fs.listStatus(path(stage)):
            name = s.getPath().getName()
            if not name.startswith(f"{_MONTH}="):
                continue
            held = versions.get(name.split("=", 1)[1], [])
            fs.mkdirs(path(root, name))
            if not fs.rename(s.getPath(), path(f"{self.path}/{name}/{_VERSION}={max(held, default=0) + 1}")):
                raise OSError(f"could not rename {s.getPath().toString()}")
            for v in sorted(held)[:-1]:        # readers may still use the last one
                fs.delete(path(f"{self.path}/{name}/{_VERSION}={v}"), True)
        for s in fs.listStatus(root):
            if s.getPath().getName().startswith("_staging-"):
                fs.delete(s.getPath(), True)
