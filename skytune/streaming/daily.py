"""Daily stream metrics (G1) kept up to date over a stream of chart files.

Chart files do not arrive in order of date: a backfill of an old day is an
ordinary event, so there is no watermark and nothing is ever late.  State is
one row per day, bounded by the calendar.  Each micro-batch emits the days it
changed; the sink keeps them by batch (written again on a retry, so a batch
counts once) and ``current_days`` reads the newest version of every day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.daily import SAD_THRESHOLD, STREAM_RATIOS, form_ratios, stream_measures, stream_rows
from ..session import ensure_checkpoint_dir


def daily_stream(songs: DataFrame, sad_threshold: float = SAD_THRESHOLD) -> DataFrame:
    """Streaming G1 without the median (it needs all values of a day)."""
    typed = songs.select(F.col("date").cast("date"), F.col("streams").cast("double"), F.col("valence").cast("double"))
    day = stream_rows(typed).groupBy("date").agg(*stream_measures(sad_threshold))
    return form_ratios(day, STREAM_RATIOS, ("valence_streams",))


def start_daily_stream(spark: SparkSession, source_dir: str, schema: StructType, sink: str, name: str,
                       fmt: str = "parquet", files_per_trigger: int = 16, available_now: bool = False) -> StreamingQuery:
    """Start the roll-up of a folder of song files into the folder ``sink``.
    Its progress lives under the session's shared checkpoint folder, by ``name``."""
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(source_dir)

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    writer = (daily_stream(source).writeStream.outputMode("update").queryName(name).foreachBatch(put)
              .option("checkpointLocation", f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}"))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def current_days(spark: SparkSession, sink: str) -> DataFrame:
    """The newest version of every day in ``sink``."""
    versions = spark.read.parquet(sink)
    values = [c for c in versions.columns if c not in ("date", "batch")]
    newest = versions.groupBy("date").agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return newest.select("date", "v.*")
