"""Per-key results where a few keys hold most rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import Scratch


def _partial_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up each run of equal keys in a sorted partition; one state a key and batch."""
    for batch in batches:
        if batch.num_rows:
            t = pa.Table.from_batches([batch]).group_by(["side", "key", "dim"], use_threads=False)
            t = t.aggregate([("n", "sum"), ("held", "sum")])
            yield from t.rename_columns(["side", "key", "dim", "n", "n_held"]).to_batches()


def key_states(rows: DataFrame, sides: dict[str, str], dims: dict[str, list[str]], partitions: int | None = None) -> DataFrame:
    """Rows and distinct values of each key, with balanced work: (side, key, dim, n, n_distinct).

    rows: any table; sides: name of a side -> its key column; dims: name of a side -> the columns
    whose distinct values are counted for its keys (the first also carries the number of rows; NULL
    values count as rows, not as values). A NULL key is a key of its own. Repeated rows count each
    time. Empty inputs give an empty result.

    Method: equal (key, value) pairs are added up in the scan's own tasks first. Then the pairs are
    range partitioned on the composite of key and value, with quantiles that Spark samples, so that
    a key with a third of all rows is split over as many partitions as its share asks for. Every
    partition holds a sorted stretch of pairs and gives one partial state per key in it; keys that
    cross a boundary have several states, which the last, small aggregation stitches. A pair is
    never split, so distinct values add up exactly.
    """
    spark = rows.sparkSession
    cols = [
        F.struct(F.lit(side).alias("side"), F.col(key).cast("string").alias("key"), F.lit(dim).alias("dim"), F.col(dim).cast("string").alias("value"))
        for side, key in sides.items() for dim in dims[side]
    ]
    pairs = (
        rows.select(F.explode(F.array(*cols)).alias("p")).select("p.*")
        .groupBy("side", "key", "dim", "value").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("held", F.col("value").isNotNull().cast("long"))
    )
    pairs = Scratch(spark).keep(pairs)  # the quantiles are sampled from what is written, not from a second run of the sums
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = pairs.repartitionByRange(parts, "side", "key", "dim", "value").sortWithinPartitions("side", "key", "dim", "value")
    states = spread.mapInArrow(_partial_states, "side string, key string, dim string, n long, n_held long")
    return states.groupBy("side", "key", "dim").agg(F.sum("n").alias("n"), F.sum("n_held").alias("n_distinct"))


def heavy_keys(rows: DataFrame, sides: dict[str, str], dims: dict[str, list[str]], share: float) -> DataFrame:
    """(side, key, n): keys, NULL left out, with at least `share` of all rows of the table."""
    first = {side: d[:1] for side, d in dims.items()}
    states = key_states(rows, sides, first)
    total = rows.agg(F.count(F.lit(1))).scalar()
    return states.where(F.col("key").isNotNull() & (F.col("n") >= F.lit(share) * total)).select("side", "key", "n")
