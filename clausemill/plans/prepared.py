"""Tables that several queries of a session read, written once to the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_folder

_PATHS: dict[tuple, str] = {}


def prepared(spark: SparkSession, name: str, source: DataFrame, write: Callable[[DataFrame, str], None]) -> DataFrame:
    """What write(source, path) wrote, once a session for a name and the files that the source reads."""
    key = (spark.sparkContext.applicationId, name, *sorted(source.inputFiles()))
    if key not in _PATHS:
        path = shared_folder(spark)
        write(source, path)
        _PATHS[key] = path
    return spark.read.parquet(_PATHS[key])
