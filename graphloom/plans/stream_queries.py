"""Streaming queries over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.session import scratch_dir
from graphloom.streaming.incremental import append_partials, merge_symbol_states, month_counts, stream_table, symbol_states


def _run(spark: SparkSession, d: str, name: str, partial) -> DataFrame:
    root = f"{scratch_dir(spark)}/graphloom-stream-{uuid.uuid4().hex[:12]}"
    append_partials(stream_table(spark, d, name), partial, f"{root}/out", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/out").drop("batch")


def stream_call_months(spark: SparkSession, d: str) -> DataFrame:
    """Calls by month, added up over micro-batches."""
    return _run(spark, d, "calls", month_counts).groupBy("month").agg(F.sum("n_calls").alias("n_calls"), F.sum("n_safe").alias("n_safe"))


def stream_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Symbols merged over micro-batches."""
    return merge_symbol_states(_run(spark, d, "symbols", symbol_states))


QUERIES = {"stream_call_months": stream_call_months, "stream_symbols": stream_symbols}
ORACLE_SQL = {
    "stream_call_months": "SELECT strftime(indexed_at, '%Y-%m') AS month, count(*) AS n_calls, count_if(is_safe) AS n_safe FROM calls GROUP BY 1",
    "stream_symbols": "SELECT fqn, arg_max(name, ins_seq) AS name, arg_max(kind, ins_seq) AS kind, arg_max(file_path, ins_seq) AS file_path, arg_max(line_number, ins_seq) AS line_number FROM symbols WHERE fqn IS NOT NULL GROUP BY fqn",
}
