"""Spark schemas as Arrow schemas."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def to_arrow(spark: SparkSession, schema: str | StructType) -> pa.Schema:
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema) if hasattr(StructType, "fromDDL") else spark.createDataFrame([], schema).schema
    return to_arrow_schema(schema)
