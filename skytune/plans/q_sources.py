"""CSV in and out, lenient dates, samples (S1 S2 S4 S8-S10 P1-P3 P5 X7 ST4) over
files that are written from the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.datetext import with_dates
from ..functions.nulls import to_double
from ..operators.sample import bottom_k
from ..session import ensure_checkpoint_dir, remove_at_exit
from ..sources import csv as C
from ..sources import fixtures as X
from ..sources import sinks
from ..sources.tables import table
from .catalog import O, query

SAMPLE = 500


def _folder(spark) -> str:
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/skytune-csv-{uuid.uuid4().hex}"
    remove_at_exit(spark, path)
    return path


@query("csv_charts", O.build("""
SELECT date_raw, CAST(rank AS DOUBLE) AS rank, country, title, artist, streams, CASE WHEN ordinal % 3 <> 2 THEN url END AS url,
       CASE WHEN ordinal % 3 <> 2 THEN chart END AS chart FROM charts_raw""", "charts_raw"))
def csv_charts(spark, sf):
    """Chart rows written as three CSV extracts whose headers differ in names, order and columns, read back by role."""
    raw = X.charts_raw(spark, sf)
    part = lambda i: raw.where(F.col("ordinal") % 3 == i)
    extracts = {
        "first": part(0).select(F.col("date_raw").alias("date"), "rank", "country", "title", "artist", "url", "streams", "chart"),
        "second": part(1).select(F.col("chart").alias("Chart Type"), F.col("streams").alias("Streams"), F.col("url").alias("Spotify URL"),
                                 F.col("artist").alias("Artist Name"), F.col("title").alias("Track Name"), F.col("country").alias("Region"),
                                 F.col("rank").alias("Position"), F.col("date_raw").alias("Day")),
        "third": part(2).select("artist", "title", F.col("date_raw").alias("DATE"), F.col("rank").alias("Rank"), "country", "streams")}
    root = _folder(spark)
    paths = sinks.write_result_set(extracts, root, "csv")
    names = {"date": ["date", "day"], "rank": ["rank", "position"], "country": ["country", "region"], "title": ["title", "track_name"],
             "artist": ["artist", "artist_name"], "url": ["url", "spotify_url"], "streams": ["streams"], "chart": ["chart", "chart_type"]}
    frames = []
    for p in paths:                   # one source each: its roles by its own header
        df = C.read_text_csv(spark, p, embedded_newlines=False)
        role = C.roles_of(C.columns_of(df), names, {"url", "chart"})
        frames.append(df.select(*[C.text_or_null(role[r]).alias(r) for r in names]))
    both = frames[0].unionByName(frames[1]).unionByName(frames[2])
    return both.select(F.col("date").alias("date_raw"), to_double("rank").alias("rank"), "country", "title", "artist",
                       to_double("streams").alias("streams"), "url", "chart")


@query("csv_station_weather", O.build(
    "SELECT CAST(station AS VARCHAR) AS station, date, CAST(prcp AS DOUBLE) AS prcp, CAST(tsun AS DOUBLE) AS tsun FROM weather_station", "weather_station"))
def csv_station_weather(spark, sf):
    """Station readings as two extracts with other header cases and date spellings, each written to two places, read back together."""
    raw = X.weather_station(spark, sf)
    early = raw.where(F.year("date") < 1995).select(F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.col("prcp").alias("PRECIP_QUANTITY"),
                                                    F.col("tsun").alias("sun_duration"), F.col("station").alias("code"))
    late = raw.where(F.year("date") >= 1995).select(F.col("station").alias("CODE"), F.col("tsun").alias("Sun_Duration"),
                                                    F.date_format("date", "d MMMM yyyy").alias("Timestamp"), F.col("prcp").alias("precip_quantity"))
    root = _folder(spark)
    for name, df in (("early", early), ("late", late)):
        sinks.write_many(df, [("csv", f"{root}/csv/{name}"), ("parquet", f"{root}/tables/{name}")])
    frames = [C.station_weather_from_csv(spark, f"{root}/csv/{name}", embedded_newlines=False) for name in ("early", "late")]
    return frames[0].unionByName(frames[1]).select("station", "date", "prcp", "tsun")


def _spelled(n, day):
    """A date in one of ten spellings, the ninth of them none."""
    spell = lambda fmt: F.date_format(day, fmt)
    return (F.when(n == 0, spell("yyyy-MM-dd")).when(n == 1, spell("dd/MM/yyyy")).when(n == 2, spell("d MMM yyyy")).when(n == 3, spell("MMMM d, yyyy"))
            .when(n == 4, spell("dd.MM.yy")).when(n == 5, spell("yyyy-MM-dd'T'13:45:10'Z'")).when(n == 6, spell("yyyyMMdd"))
            .when(n == 7, spell("EEE, dd MMM yyyy 08:30 'AM'")).when(n == 8, F.concat(F.lit("week "), spell("D yyyy"))).otherwise(spell("yyyy/M/d")))


@query("date_lenient", """
SELECT l_orderkey, l_linenumber, CASE WHEN (l_orderkey + l_linenumber) % 10 <> 8 THEN CAST(l_shipdate AS DATE) END AS date FROM lineitem""")
def date_lenient(spark, sf):
    """Dates in ten spellings, day first by vote; what is no date is NULL."""
    li = table(spark, sf, "lineitem")
    spelled = li.select("l_orderkey", "l_linenumber", _spelled((F.col("l_orderkey") + F.col("l_linenumber")) % 10, F.col("l_shipdate").cast("date")).alias("text"))
    return with_dates(spelled, "text").drop("text")


@query("sample_rows", f"""
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
ORDER BY md5(concat_ws(chr(31), CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR))), l_orderkey, l_linenumber, l_partkey LIMIT {SAMPLE}""")
def sample_rows(spark, sf):
    """ST4: a bounded sample by row key, the same rows however the table is laid out."""
    return bottom_k(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey", "l_linenumber"], SAMPLE)
