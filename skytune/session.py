"""SparkSession construction and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Set by test and bench sessions alone: their tables come as one row group
#: each, which no scan can split.  See ``sources.tables.spread``.
SPREAD = "spark.skytune.spread"


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "skytune", spread: int | None = None) -> SparkSession:
    """A local session for tests and the bench (UI off, AQE on, UTC)."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SKYTUNE_DRIVER_MEMORY", "12g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(SPREAD, str(spread if spread is not None else shuffle_partitions))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    The folder named by ``spark.checkpoint.dir`` is used as is.  A private
    scratch folder is created only where that is unset and the master is local
    (tests); on a cluster an unset folder is an error, since each executor
    would write to a disk that no other one sees.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: the server owns the folder
        sc = None
    path = spark.conf.get("spark.checkpoint.dir", None) or (sc.getCheckpointDir() if sc else None)
    if not path:
        require_local(sc.master if sc is not None else "connect")
        path = tempfile.mkdtemp(prefix="skytune-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if sc is not None and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def require_local(master: str) -> None:
    """A machine-local scratch folder serves ``local[...]`` masters only."""
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors share (master: {master})")


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Have the file system delete an intermediate table when the driver ends."""
    try:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    except Exception:  # noqa: BLE001 - Spark Connect: the server cleans its folder
        return
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(conf).deleteOnExit(target)


def fingerprint(spark: SparkSession, *paths: str) -> tuple:
    """Names, sizes and times of the files of stored tables (driver metadata
    only), so that new data under the same path is seen."""
    try:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    except Exception:  # noqa: BLE001 - Spark Connect: no reuse across calls
        return (uuid.uuid4().hex,)
    out = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(conf)
        if fs.exists(path):
            out.extend((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(path))
    return tuple(sorted(out))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a Parquet table under the shared checkpoint folder
    and read it back: one job (``Dataset.checkpoint`` would run the plan a
    second time to write an unpersisted RDD), survives the loss of any
    executor, and later scans get Parquet column pruning.  Never a
    machine-local checkpoint."""
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{root}/skytune-tables/{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    remove_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


_MATERIALIZED: dict[tuple, DataFrame] = {}


def forget_materialized() -> None:
    """Build all stored day-grain tables anew at their next use."""
    _MATERIALIZED.clear()


def materialize_once(spark: SparkSession, key: tuple, build, sources: tuple[str, ...] = ()) -> DataFrame:
    """Build ``build()`` once per application, key and state of the files in
    ``sources``, written into the shared checkpoint folder; later calls reuse
    it, changed files build it anew.

    Meant for day-grain tables (one row per calendar day) that many report
    queries read: the fact table is scanned once instead of once per report,
    and downstream plans stay shallow."""
    try:
        app = spark.sparkContext.applicationId
    except Exception:  # noqa: BLE001 - Spark Connect
        app = spark.conf.get("spark.app.id", "connect")
    k = (app, id(spark)) + tuple(key) + fingerprint(spark, *sources)
    df = _MATERIALIZED.get(k)
    if df is None:
        df = cut_lineage(build())
        _MATERIALIZED[k] = df
    return df
