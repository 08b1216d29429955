"""All functions, table functions and sources under their SQL names."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .functions import media, tables
from .sources import files, tags


def register(spark: SparkSession) -> SparkSession:
    for module in (media, tables, files, tags):
        module.register(spark)
    return spark
