"""Incremental work on arriving rows with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.graph import merge_overlay


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stream of the files of one of the given tables, a Parquet file or folder."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]")


def append_partials(stream: DataFrame, partial: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> None:
    """Writes partial(batch) of every micro-batch that is available now below `path`, one folder a batch.

    A batch that is run again after a failure overwrites its own folder, so each row counts once.
    Rows that arrive late are part of some batch like any other; nothing is dropped for its time.
    """

    def write(batch: DataFrame, number: int) -> None:
        partial(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def month_counts(batch: DataFrame) -> DataFrame:
    """(month, n_calls, n_safe) of calls, to be added up over batches."""
    month = F.date_format("indexed_at", "yyyy-MM").alias("month")
    return batch.groupBy(month).agg(F.count(F.lit(1)).alias("n_calls"), F.count_if("is_safe").alias("n_safe"))


def symbol_states(batch: DataFrame) -> DataFrame:
    """The last known value of each property of the symbols in a batch, with its place in the order."""
    columns = ["name", "kind", "file_path", "line_number"]
    newest = batch.where("fqn is not null").groupBy("fqn").agg(*[F.max(F.when(F.col(c).isNotNull(), F.struct("ins_seq", c))).alias(c) for c in columns])
    return newest


def merge_symbol_states(states: DataFrame) -> DataFrame:
    """(fqn, name, kind, file_path, line_number) from the states of all batches, as one merge of all rows gives them."""
    columns = ["name", "kind", "file_path", "line_number"]
    return states.groupBy("fqn").agg(*[F.max(c).alias(c) for c in columns]).select("fqn", *[F.col(f"{c}.{c}").alias(c) for c in columns])


def merge_all(symbols: DataFrame) -> DataFrame:
    """The same from all rows at once."""
    return merge_overlay(symbols, "fqn", "ins_seq", ["name", "kind", "file_path", "line_number"])
