"""Day roll-ups kept as mergeable states (G1-G8 with S4 and S7; section 2.12 ``median``)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.dates import season
from ..operators import daily as D
from ..operators import daystate as DS
from ..session import cut_lineage, ensure_checkpoint_dir, remove_at_exit
from . import pipelines as P
from .catalog import O, query

EXTRACTS = 3


def _loaded(spark, sf, spec) -> DS.DayStates:
    """The chart rows as extracts that arrive one by one, days split among
    them; the second one is loaded twice, as after a failure."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/skytune-day-states-{uuid.uuid4().hex}"
    remove_at_exit(spark, path)
    store = DS.DayStates(spark, path, spec)
    rows = P.songs(spark, sf).withColumn("_extract", F.pmod(F.xxhash64("date", "rank", "streams", "artist", "genre"), F.lit(EXTRACTS)))
    for i in (0, 1, 1, 2):
        store.add(f"e{i}", rows.where(F.col("_extract") == i))
    return store


@query("incremental_daily_summary", O.build("SELECT * EXCLUDE (median_valence) FROM daily_summary", "daily_summary"))
def incremental_daily_summary(spark, sf):
    """The daily summary from merged day states of three extracts (its median is approximate: see approx_medians)."""
    features = list(D.AUDIO_FEATURES)
    store = _loaded(spark, sf, DS.summary_spec(features))
    return DS.summary(store.states(), features).drop("median_valence")


@query("incremental_stream_metrics", O.build("SELECT * EXCLUDE (median_valence) FROM early_metrics", "early_metrics"))
def incremental_stream_metrics(spark, sf):
    """Stream metrics per day from merged day states of three extracts."""
    spec = DS.stream_spec()
    rows = D.stream_rows(P.songs(spark, sf))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/skytune-day-states-{uuid.uuid4().hex}"
    remove_at_exit(spark, path)
    store = DS.DayStates(spark, path, spec)
    for i in range(EXTRACTS):
        store.add(f"e{i}", rows.where(F.pmod(F.xxhash64("date", "streams", "valence"), F.lit(EXTRACTS)) == i))
    return DS.stream_metrics(store.states(), ["date"]).drop("median_valence")


O.part("known_valence", ("song_day",),
       "SELECT date, valence, EXTRACT(month FROM date) AS m FROM song_day WHERE date IS NOT NULL AND valence IS NOT NULL")


@query("approx_medians", O.build("""
SELECT 'day' AS grain, strftime(date, '%Y-%m-%d') AS key, count(*) AS n, true AS within_bound FROM known_valence GROUP BY date
UNION ALL SELECT 'season', CASE WHEN m IN (12, 1, 2) THEN 'winter' WHEN m IN (3, 4, 5) THEN 'spring' WHEN m IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END,
       count(*), true FROM known_valence GROUP BY ALL
UNION ALL SELECT 'whole', 'all', count(*), true FROM known_valence""", "known_valence"))
def approx_medians(spark, sf):
    """G1 (approximate median): sketches per day, merged to seasons and the whole without reading the rows again;
    the rank of each median is then held against its bound (twice the 99 % one)."""
    spec = {"valence": ("moments", F.col("valence")), "valence_sketch": ("sketch", F.col("valence"))}
    rows = P.songs(spark, sf).select("date", "valence").where("date IS NOT NULL AND valence IS NOT NULL")
    days = cut_lineage(DS.states_of(rows, ["date"], spec))
    day = days.select("date", "valence_sketch", *[c for c in days.columns if c.startswith("valence_") and c != "valence_sketch"],
                      F.lit("day").alias("grain"), F.date_format("date", "yyyy-MM-dd").alias("key"))
    coarse = [DS.merged(days.select("*", F.lit(g).alias("grain"), k.alias("key")), ["grain", "key"], spec)
              for g, k in (("season", season(F.month("date"))), ("whole", F.lit("all")))]
    medians = day.drop("date").unionByName(coarse[0]).unionByName(coarse[1]).select(
        "grain", "key", DS.approximate_median("valence_sketch").alias("median"))
    medians = cut_lineage(medians)
    # ranks of the medians: each row meets those of its day, its season and the whole
    keyed = rows.select("valence", F.inline(F.array(
        F.struct(F.lit("day").alias("grain"), F.date_format("date", "yyyy-MM-dd").alias("key")),
        F.struct(F.lit("season").alias("grain"), season(F.month("date")).alias("key")),
        F.struct(F.lit("whole").alias("grain"), F.lit("all").alias("key")))))
    ranks = keyed.join(F.broadcast(medians), ["grain", "key"]).groupBy("grain", "key").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("valence") < F.col("median")).alias("less"),
        F.count_if(F.col("valence") <= F.col("median")).alias("upto"))
    slack = 2 * DS.rank_error() * F.col("n") + 1
    return ranks.select("grain", "key", "n", ((F.col("less") <= F.col("n") / 2 + slack) & (F.col("upto") >= F.col("n") / 2 - slack)).alias("within_bound"))
