"""Mixing sources to target weights."""

from __future__ import annotations

import math
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import Scratch

#: A source is cut into so many parts by hash; the cut of its last repetition falls into one of them, which alone is sorted.
PARTS = 1 << 14


def _token_counts(vocabulary: Broadcast):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64

        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.value.splitlines() if line.strip())}
        coder = tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            n = [len(coder.encode_ordinary(t)) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["doc_id", "source", "tokens"])

    return work


def token_sizes(documents: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, source, tokens): tokens of every text in a public byte-level vocabulary (a .tiktoken file of the driver, of about a megabyte, which is broadcast).

    source is trimmed and lower-cased; NULL and empty texts have 0 tokens.
    """
    name = F.lower(F.btrim("source", F.lit(" \t\r\n")))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), name.alias("source"), "text")
    ranks = documents.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())
    return rows.mapInArrow(_token_counts(ranks), "doc_id long, source string, tokens long")


def exact_total(sources: DataFrame) -> float:
    """The largest total at which every source that holds tokens meets its share within its repetitions.

    sources: target_share, cap. Shares of sources that are absent go to the others in proportion.
    """
    held = sources.where("target_share > 0 and cap > 0")
    r = held.agg(F.sum("target_share").alias("weight"), F.min(F.col("cap") / F.col("target_share")).alias("least")).first()
    return (r.weight or 0.0) * (r.least or 0.0)


def water_level(sources: DataFrame, total: float) -> float:
    """Tokens a unit of share gives in the capped mixture of `total` tokens: a source gives the least of its cap and level * share.

    sources: target_share, cap. Each round clamps the sources that ask for more than their cap and spreads
    what they lack over the others in proportion to their shares; it is one aggregation, whose two sums come to the
    driver. Levels only rise, so the rounds end when no further source is clamped; infinite if all are.
    """
    open_ = sources.where("target_share > 0")
    level, clamped = 0.0, -1
    while True:
        full = F.col("cap") < F.col("target_share") * F.lit(level)
        r = open_.agg(
            F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)).alias("given"),
            F.coalesce(F.sum(F.when(~full, F.col("target_share"))), F.lit(0.0)).alias("weight"), F.count_if(full).alias("n"),
        ).first()
        if r.n == clamped or r.weight <= 0:
            return level if r.weight > 0 else math.inf
        level, clamped = max(0.0, total - r.given) / r.weight, r.n


def water_filling(sources: DataFrame, total: float | str | None = None) -> DataFrame:
    """sources with planned_tokens and epochs: the largest mixture in target proportions, with repeats capped.

    sources: source, target_share, max_repeats, available_tokens; total: tokens
    aimed at, by default the sum of all available tokens; "exact": `exact_total`. A source whose share asks for more than it
    may give (available * repeats) is clamped there and what it lacks goes to the others in proportion to
    their shares, until no source asks for too much or all are clamped.
    """
    cap = (F.col("available_tokens") * F.greatest("max_repeats", F.lit(0))).cast("double")
    s = sources.withColumn("cap", cap)
    if total == "exact":
        total = exact_total(s)
    elif total is None:
        total = float(s.agg(F.sum("available_tokens")).first()[0] or 0)
    level = water_level(s, float(total))
    asked = F.col("cap") if math.isinf(level) else F.least(F.col("cap"), F.col("target_share") * F.lit(level))
    planned = F.when(F.col("target_share") > 0, asked).otherwise(F.lit(0.0))
    epochs = F.coalesce(F.try_divide("planned_tokens", "available_tokens"), F.lit(0.0))
    return s.withColumn("planned_tokens", planned).withColumn("epochs", epochs).drop("cap")


def _last_repetition(sizes: DataFrame, planned: DataFrame, seed: int, scratch: Scratch) -> DataFrame:
    """(doc_id, source, tokens, repeats, more): documents of planned sources with their whole repetitions, and whether they are in the last one.

    The documents of a source stand in the order of their hash; the last repetition takes them from the front until the planned
    tokens are reached, so at most one document is in doubt, which is taken if it comes nearer. Sums by part
    of the hash's range tell in which part the cut falls; only the documents in that part are put in order.
    """
    whole = F.floor("epochs").cast("int")
    rest = F.col("planned_tokens") - whole * F.col("available_tokens")
    chance = F.pmod(F.xxhash64(F.lit(seed), F.lit("mix"), "doc_id"), F.lit(1 << 40))
    d = sizes.join(planned.select("source", whole.alias("whole"), rest.alias("rest")), "source").withColumn("chance", chance)
    d = scratch.keep(d.withColumn("part", F.floor(F.col("chance") / F.lit((1 << 40) // PARTS)).cast("int")))
    parts = d.groupBy("source", "part").agg(F.sum("tokens").alias("held"), F.first("rest").alias("rest"))
    before = F.coalesce(F.sum("held").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    over = parts.withColumn("before", before).where("before + held > rest")
    cuts = scratch.keep(over.groupBy("source").agg(F.min("part").alias("cut"), F.min_by("before", "part").alias("before")))
    d = d.join(cuts, "source", "left").withColumn("cut", F.coalesce("cut", F.lit(PARTS)))
    so_far = F.coalesce(F.sum("tokens").over(Window.partitionBy("source", "part").orderBy("chance", "doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    more = F.col("before") + so_far + F.col("tokens") / 2 <= F.col("rest")
    columns = ["doc_id", "source", "tokens", "whole"]
    sure = d.where("part <> cut").select(*columns, (F.col("part") < F.col("cut")).alias("more"))
    return sure.unionByName(d.where("part = cut").select(*columns, more.alias("more")))


def mix_sources(documents: DataFrame, targets: DataFrame, vocabulary: str, seed: int = 42, total: float | str | None = None) -> tuple[DataFrame, DataFrame]:
    """(selection, report) of a mixture that meets target shares of tokens.

    documents: doc_id, source, text; targets: source, target_share, max_repeats, one row a source
    (repeated rows count once). selection: doc_id, source, tokens, repeats (1 or more; documents
    not selected have no row). report: source, target_share, available_tokens, planned_tokens,
    selected_tokens, actual_share, epochs, one row a target source, also absent ones. Sources
    without target, NULL among them, are not selected; NULL shares and repeats count as 0.
    total: tokens aimed at; None: as many as the target sources hold, so that small sources reach
    their most repetitions and miss their share; "exact": the most at which none does (`exact_total`).

    Method: capped water-filling on the tokens per source, as rounds of aggregations over the table of sources. Each
    source then gives floor(epochs) whole repetitions and a seeded part of one more, cut where the planned tokens are
    reached (`_last_repetition`), so what is selected differs from the plan by half a document a source at most. The result
    depends on seed and doc_id only, not on how the rows are spread.
    """
    scratch = Scratch(documents.sparkSession)
    sizes = scratch.keep(token_sizes(documents, vocabulary))
    wanted = targets.select(F.lower(F.btrim("source", F.lit(" \t\r\n"))).alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"))
    wanted = wanted.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    held = sizes.groupBy("source").agg(F.sum("tokens").alias("available_tokens"))
    sources = scratch.keep(wanted.join(held, "source", "left").withColumn("available_tokens", F.coalesce("available_tokens", F.lit(0))))
    planned = scratch.keep(water_filling(sources, total))
    taken = _last_repetition(sizes, planned, seed, scratch)
    selection = taken.select("doc_id", "source", "tokens", (F.col("whole") + F.col("more").cast("int")).alias("repeats")).where("repeats > 0")
    got = selection.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("selected_tokens"))
    report = planned.join(got, "source", "left").withColumn("selected_tokens", F.coalesce("selected_tokens", F.lit(0)))
    share = F.coalesce(F.try_divide(F.col("selected_tokens"), got.agg(F.sum("selected_tokens")).scalar()), F.lit(0.0))
    return selection, report.select("source", "target_share", "available_tokens", "planned_tokens", "selected_tokens", share.alias("actual_share"), "epochs")
