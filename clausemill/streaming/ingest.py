"""Extensions beyond batch: new documents appended to a positional index, and windowed event counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..operators.corpus import tokens
from ..operators.search import build_index


def index_stream(spark: SparkSession, source: str, schema: str, index: str, checkpoint: str, tokenizer: Callable[[Column], Column] = T.ascii_words, **trigger) -> StreamingQuery:
    """Appends postings of documents that arrive as Parquet files; frequencies are taken from the whole index when searching.

    A batch writes a folder named by its number, so a repeated batch replaces itself.
    """

    def add(batch: DataFrame, number: int) -> None:
        build_index(tokens(batch, tokenizer)).write.mode("overwrite").parquet(f"{index}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_index(spark: SparkSession, index: str) -> DataFrame:
    return spark.read.parquet(index).select("term", "doc_id", "positions")


def windowed_events(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by event type and window; with a watermark, also on streams."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
