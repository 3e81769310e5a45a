"""Views over the driver tables that give the reference's input shapes.

Each view exists twice: as a Spark plan (``song_day(spark, sf_dir)`` ...) and
as DuckDB CTE text (``SQL[name]``) for the oracle.  The definitions are the
same expressions; both read the whole tables.

* ``song_day``        - song x day chart rows with features (grain of the
                        matched song-level table).
* ``weather_station`` - station x day covariate readings with gaps and nulls.
* ``features_raw``    - feature lookup with noisy titles/artists and ids.
* ``charts_raw``      - raw chart rows: three date formats, padded country,
                        Top/Viral charts, missing ids and odd streams.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import spread, table


#: Audio numbers of the fixture's songs: name, key, modulus, divisor, base, and
#: the key whose multiples of 17 have none.
MORE_AUDIO = (
    ("speechiness", "l_suppkey", 83, 82.0, 0.0, "l_partkey"), ("tempo", "l_partkey", 121, 1.0, 60.0, "l_suppkey"),
    ("acousticness", "l_partkey", 97, 96.0, 0.0, "l_orderkey"), ("instrumentalness", "l_orderkey", 89, 88.0, 0.0, "l_partkey"),
    ("liveness", "l_suppkey", 71, 70.0, 0.0, "l_orderkey"), ("popularity", "l_orderkey", 101, 1.0, 0.0, "l_suppkey"),
)


def song_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    p = table(spark, sf_dir, "part")
    j = li.join(p, li.l_partkey == p.p_partkey)
    return j.select(
        F.col("l_shipdate").cast("date").alias("date"),
        F.col("l_quantity").alias("rank"),
        F.col("l_extendedprice").alias("streams"),
        F.col("p_type").alias("genre"),
        F.col("p_brand").alias("artist"),
        F.when(F.col("l_partkey") % 11 != 0, F.col("l_discount") * 10).alias("valence"),
        F.when(F.col("l_partkey") % 13 != 0, F.col("l_tax") * 12.5).alias("energy"),
        (F.col("p_size") / 50.0).cast("double").alias("danceability"),
        *[F.when(F.col(gap) % 17 != 0, (F.col(key) % n).cast("double") / d + b).alias(name)
          for name, key, n, d, b, gap in MORE_AUDIO],
        ((F.col("p_retailprice") - 900) / 100.0).alias("loudness"),
    )


def weather_station(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    rain = (F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT")
    return o.select(
        (F.col("o_custkey") % 40).alias("station"),
        F.col("o_orderdate").cast("date").alias("date"),
        F.when(F.col("o_orderkey") % 17 == 0, F.lit(None).cast("double"))
         .when(rain, F.col("o_totalprice") / 10000).otherwise(F.lit(0.0)).alias("prcp"),
        F.when(F.col("o_orderkey") % 19 == 0, F.lit(None).cast("double"))
         .when(F.col("o_orderstatus") == "O", F.col("o_totalprice") / 1000).otherwise(F.lit(0.0)).alias("tsun"),
        F.col("o_orderkey").alias("ordinal"),
    )


def _md5_22(k: str):
    return F.substring(F.md5(F.col(k).cast("string")), 1, 22)


def features_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spread(table(spark, sf_dir, "part"), "p_partkey")
    k = F.col("p_partkey")
    url = (F.when(k % 7 == 0, F.lit(None).cast("string"))
           .when(k % 2 == 0, F.concat(F.lit("https://open.spotify.com/track/"), _md5_22("p_partkey")))
           .otherwise(F.concat(F.lit("spotify:track:"), _md5_22("p_partkey"))))
    suffix = (F.when(k % 5 == 0, " (Rémix)").when(k % 5 == 1, " feat. Zoë")
              .when(k % 5 == 2, " [Live]").otherwise(""))
    guest = (F.when(k % 4 == 0, " & Señor X").when(k % 4 == 1, ", Guest")
             .when(k % 4 == 2, " x DJ").otherwise(""))
    return p.select(
        k.alias("ordinal"), url.alias("track_url"),
        F.concat(F.col("p_name"), F.lit(" "), (k % 50).cast("string"), suffix).alias("track_name"),
        F.concat(F.col("p_brand"), guest).alias("artists"),
        F.col("p_type").alias("track_genre"),
        F.when(k % 11 != 0, (k % 101).cast("double") / 100.0).alias("valence"),
        F.when(k % 13 != 0, ((k * 37) % 101).cast("double") / 100.0).alias("energy"),
        (F.col("p_size") / 50.0).cast("double").alias("danceability"),
        ((F.col("p_retailprice") - 900) / 100.0).alias("loudness"),
    )


def charts_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spread(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")
    p = table(spark, sf_dir, "part")
    j = li.join(p, li.l_partkey == p.p_partkey)
    ln = F.col("l_linenumber")
    date_raw = (F.when(ln % 3 == 0, F.date_format("l_shipdate", "yyyy-MM-dd"))
                .when(ln % 3 == 1, F.date_format("l_shipdate", "dd/MM/yyyy"))
                .otherwise(F.concat(F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit("T00:00:00"))))
    return j.select(
        (F.col("l_orderkey") * 100000000 + F.col("l_partkey") * 1000 + ln).alias("ordinal"),
        date_raw.alias("date_raw"),
        F.col("l_quantity").alias("rank"),
        F.when(F.col("l_suppkey") % 10 == 0, " Elsewhere").otherwise(" Home ").alias("country"),
        F.when(F.col("l_suppkey") % 9 == 0, "Viral 50").otherwise("Top 200").alias("chart"),
        F.when(F.col("l_partkey") % 3 != 0,
               F.concat(F.lit("spotify:track:"), _md5_22("l_partkey"))).alias("url"),
        F.concat(F.upper(F.col("p_name")), F.lit(" "), (F.col("p_partkey") % 50).cast("string")).alias("title"),
        F.concat(F.col("p_brand"), F.when(F.col("p_partkey") % 4 == 0, " and Senor X")
                 .when(F.col("p_partkey") % 4 == 1, ", Guest").otherwise("")).alias("artist"),
        F.when(ln == 7, F.lit(-1.0))
         .when((F.col("l_returnflag") == "R") & (ln == 6), F.lit(None).cast("double"))
         .otherwise(F.col("l_extendedprice")).alias("streams"),
        F.col("l_suppkey").alias("suppkey"),
        F.col("l_extendedprice").alias("price"),
    )


# DuckDB text of the same views (oracle side).
SQL = {
    "song_day": """
song_day AS (
  SELECT CAST(l_shipdate AS DATE) AS date, l_quantity AS rank, l_extendedprice AS streams,
         p_type AS genre, p_brand AS artist,
         CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_discount * 10 END AS valence,
         CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE l_tax * 12.5 END AS energy,
         CAST(p_size / 50.0 AS DOUBLE) AS danceability, (p_retailprice - 900) / 100.0 AS loudness,
         """ + ",\n         ".join(f"CASE WHEN {gap} % 17 = 0 THEN NULL ELSE CAST({key} % {n} AS DOUBLE) / {d} + {b} END AS {name}"
                                   for name, key, n, d, b, gap in MORE_AUDIO) + """
  FROM lineitem JOIN part ON l_partkey = p_partkey)""",
    "weather_station": """
weather_station AS (
  SELECT o_custkey % 40 AS station, CAST(o_orderdate AS DATE) AS date,
         CASE WHEN o_orderkey % 17 = 0 THEN NULL
              WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN o_totalprice / 10000 ELSE 0 END AS prcp,
         CASE WHEN o_orderkey % 19 = 0 THEN NULL
              WHEN o_orderstatus = 'O' THEN o_totalprice / 1000 ELSE 0 END AS tsun,
         o_orderkey AS ordinal
  FROM orders)""",
    "features_raw": """
features_raw AS (
  SELECT p_partkey AS ordinal,
         CASE WHEN p_partkey % 7 = 0 THEN NULL
              WHEN p_partkey % 2 = 0 THEN concat('https://open.spotify.com/track/', substr(md5(CAST(p_partkey AS VARCHAR)), 1, 22))
              ELSE concat('spotify:track:', substr(md5(CAST(p_partkey AS VARCHAR)), 1, 22)) END AS track_url,
         concat(p_name, ' ', CAST(p_partkey % 50 AS VARCHAR),
                CASE p_partkey % 5 WHEN 0 THEN ' (Rémix)' WHEN 1 THEN ' feat. Zoë' WHEN 2 THEN ' [Live]' ELSE '' END) AS track_name,
         concat(p_brand, CASE p_partkey % 4 WHEN 0 THEN ' & Señor X' WHEN 1 THEN ', Guest' WHEN 2 THEN ' x DJ' ELSE '' END) AS artists,
         p_type AS track_genre,
         CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE CAST(p_partkey % 101 AS DOUBLE) / 100.0 END AS valence,
         CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE CAST((p_partkey * 37) % 101 AS DOUBLE) / 100.0 END AS energy,
         CAST(p_size / 50.0 AS DOUBLE) AS danceability, (p_retailprice - 900) / 100.0 AS loudness
  FROM part)""",
    "charts_raw": """
charts_raw AS (
  SELECT l_orderkey * 100000000 + l_partkey * 1000 + l_linenumber AS ordinal,
         CASE l_linenumber % 3 WHEN 0 THEN strftime(l_shipdate, '%Y-%m-%d')
                               WHEN 1 THEN strftime(l_shipdate, '%d/%m/%Y')
                               ELSE concat(strftime(l_shipdate, '%Y-%m-%d'), 'T00:00:00') END AS date_raw,
         l_quantity AS rank,
         CASE WHEN l_suppkey % 10 = 0 THEN ' Elsewhere' ELSE ' Home ' END AS country,
         CASE WHEN l_suppkey % 9 = 0 THEN 'Viral 50' ELSE 'Top 200' END AS chart,
         CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE concat('spotify:track:', substr(md5(CAST(l_partkey AS VARCHAR)), 1, 22)) END AS url,
         concat(upper(p_name), ' ', CAST(p_partkey % 50 AS VARCHAR)) AS title,
         concat(p_brand, CASE p_partkey % 4 WHEN 0 THEN ' and Senor X' WHEN 1 THEN ', Guest' ELSE '' END) AS artist,
         CASE WHEN l_linenumber = 7 THEN -1.0
              WHEN l_returnflag = 'R' AND l_linenumber = 6 THEN NULL ELSE l_extendedprice END AS streams,
         l_suppkey AS suppkey, l_extendedprice AS price
  FROM lineitem JOIN part ON l_partkey = p_partkey)""",
}
