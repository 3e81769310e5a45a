"""skytune: daily chart x covariate analytics as lazy PySpark plans.

Every public function takes and returns ``DataFrame`` / ``Column`` objects;
nothing collects to the driver.  Sub-packages:

* ``functions`` - scalar Column builders (null helpers, text keys, dates,
  distribution tails).
* ``sources``   - CSV/Parquet readers with header resolution, the fixture views
  over the driver tables, the keyed daily cache and sinks.
* ``operators`` - DataFrame -> DataFrame operators (de-dup, matching, daily
  roll-ups, weather classes, entity shares, ranks, statistical tests,
  profiles, reshaping).
* ``plans``     - the three pipelines and the query catalogue.
* ``streaming`` - the daily roll-up applied to a stream of chart files.
"""

__version__ = "0.1.0"
