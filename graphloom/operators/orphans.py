"""Orphan references: rows that name a key no row of the parent table holds at that time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import Scratch

WORD = 6  # a word of a bitmap holds 2**6 neighbouring keys


def orphan_references(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """The rows of `refs` whose key no row of `parents` holds at the row's own time.

    refs: columns key (string), at (timestamp) and any others; parents: key, born, died
    (died NULL: still there). A parent holds its key at t if born <= t and t < died. The result
    has the columns of refs, repeated rows as often as refs has them. Rows of refs with a NULL
    key refer to nothing and are left out; a NULL `at` precedes every parent, so such a row is
    an orphan; parents with a NULL key or born hold nothing. Empty inputs are allowed.

    Method: keys become integers through a dictionary. For each word of 64 neighbouring keys and
    each month a bitmap says which keys are referred to and which get a parent that never goes
    away; words without a bit are not stored. References AND NOT the parents born in earlier
    months leaves the keys in doubt, which are decoded, and only their references meet the exact
    intervals. The bitmaps hold one row per word and month however many rows refer to a key, so
    a key that holds a third of all references costs no more than another.
    """
    spark = refs.sparkSession
    scratch = Scratch(spark)
    month = lambda c: F.year(c) * 12 + F.month(c)
    asked = refs.where(F.col("key").isNotNull()).select("key", F.coalesce(month(F.col("at")), F.lit(-1)).alias("period")).distinct()
    births = (
        parents.where(F.col("key").isNotNull() & F.col("born").isNotNull() & F.col("died").isNull())
        .groupBy("key").agg(F.min("born").alias("born"))
        .select("key", month(F.col("born")).alias("period"))
    )
    # The ids of distinct keys are fixed by writing the table: a lost task cannot number them anew.
    dictionary = scratch.keep(asked.select("key").distinct().select("key", F.monotonically_increasing_id().alias("id")))

    def words(df: DataFrame, name: str, other: str) -> DataFrame:
        bit = F.expr(f"shiftleft(1L, cast(id & {2**WORD - 1} as int))")
        return (
            df.join(dictionary, "key")
            .groupBy(F.shiftright("id", WORD).alias("word"), "period").agg(F.bit_or(bit).alias(name))
            .withColumn(other, F.lit(0).cast("long"))
            .select("word", "period", "asked", "born")
        )

    earlier = Window.partitionBy("word").orderBy("period").rowsBetween(Window.unboundedPreceding, -1)
    doubt = (
        words(asked, "asked", "born").unionAll(words(births, "born", "asked"))
        .groupBy("word", "period").agg(F.bit_or("asked").alias("asked"), F.bit_or("born").alias("born"))
        .withColumn("held", F.coalesce(F.bit_or("born").over(earlier), F.lit(0).cast("long")))
        .withColumn("bits", F.expr("asked & ~held")).where("bits <> 0")
        .withColumn("bit", F.explode(F.expr(f"filter(sequence(0, {2**WORD - 1}), i -> (shiftrightunsigned(bits, i) & 1L) = 1L)")))
        .select(F.expr(f"shiftleft(word, {WORD}) + bit").alias("id"), "period")
        .join(dictionary, "id").select("key", "period")
    )
    doubt = scratch.keep(doubt)
    r = refs.where(F.col("key").isNotNull()).withColumn("_period", F.coalesce(month(F.col("at")), F.lit(-1)))
    open_refs = r.join(doubt.withColumnRenamed("period", "_period"), ["key", "_period"], "left_semi").drop("_period").alias("r")
    p = parents.where(F.col("born").isNotNull()).select(F.col("key").alias("_key"), F.col("born").alias("_born"), F.col("died").alias("_died")).alias("p")
    holds = (F.col("r.key") == F.col("p._key")) & (F.col("p._born") <= F.col("r.at")) & (F.col("p._died").isNull() | (F.col("p._died") > F.col("r.at")))
    return open_refs.join(p, holds, "left_anti")
