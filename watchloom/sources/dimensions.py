"""Small configuration tables: rules, zones, cameras, retention."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from watchloom.schemas import ZONES


def from_json(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A configuration file of a list of records; a missing file is an empty table."""
    schema = StructType.fromDDL(ddl)
    if not os.path.exists(path):
        return spark.createDataFrame([], schema)
    with open(path) as f:
        return spark.createDataFrame([tuple(r.get(c) for c in schema.names) for r in json.load(f)], schema)


def zones(spark: SparkSession, path: str) -> DataFrame:
    return from_json(spark, path, ZONES)
