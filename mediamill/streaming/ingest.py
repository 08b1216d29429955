"""Files as a stream: what arrives in a folder is inspected once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import detect, media
from ..sources.files import SCHEMA


def arrivals(spark: SparkSession, path: str, glob: str | None = None, per_trigger: int = 256) -> DataFrame:
    """A stream of files as rows of the batch reader's schema."""
    reader = spark.readStream.format("binaryFile").schema(SCHEMA).option("maxFilesPerTrigger", per_trigger)
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def inspected(files: DataFrame, delay: str = "1 day") -> DataFrame:
    """``path, sha256, file_type, probe`` of each new file; a copy of one that arrived within ``delay`` is left out, and the state of older ones goes."""
    named = files.withColumns({"sha256": F.sha2("content", 256), "file_type": detect.file_type(F.col("content")), "probe": media.probe(F.col("content"))})
    kept = named.withWatermark("modificationTime", delay).dropDuplicatesWithinWatermark(["sha256"])
    return kept.select("path", "modificationTime", "length", "sha256", "file_type", "probe")


def run(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Everything there is now, in batches, then stop."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
