"""Evaluation passages inside corpus documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.textops import WordIds, sliding_min, window_hashes, words_of
from graphloom.session import Scratch, keyed

SHINGLE = 5


def _signatures(id_column: str, run: int):
    """Min-hashes of the shingle sets of the runs of `run` words in a text, each once."""
    width = run - SHINGLE + 1  # shingles of one run

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()
        for batch in batches:
            keys, hashes = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = ids(words_of(text or ""))
                if len(w) < run:
                    continue
                h = np.unique(sliding_min(window_hashes(w, SHINGLE), width))
                keys.append(np.full(len(h), key, np.int64))
                hashes.append(h)
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(hashes).view(np.int64))], [id_column, "h"])

    return work


def _verify(run: int):
    """Which of the candidate items' runs a document holds: shingle sets of whole runs by their hashes, then word by word."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()
        for batch in batches:
            doc, item = [], []
            for key, text, items, passages in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                w = words_of(text or "")
                held = window_hashes(ids(w), run)
                for i, passage in zip(items, passages, strict=True):
                    p = words_of(passage)
                    asked = window_hashes(ids(p), run)
                    _, at, there = np.intersect1d(held, asked, return_indices=True)
                    if any(w[x : x + run] == p[y : y + run] for x, y in zip(at.tolist(), there.tolist(), strict=True)):
                        doc.append(key)
                        item.append(i)
            if doc:
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(item, pa.int64())], ["doc_id", "item_id"])

    return work


def leaked_passages(documents: DataFrame, items: DataFrame, run: int = 15) -> DataFrame:
    """(doc_id, item_id): documents with at least `run` consecutive words of the item.

    documents: doc_id, text; items: item_id, text. Words are maximal runs of letters and digits,
    lower-cased. Texts that are NULL, empty or shorter than `run` words give no row; rows with a
    NULL id are left out; repeated rows give one row. Empty tables give an empty result.

    Method: MinHash containment search, partitioned by size. A short item is contained in a long
    document, whose own set would drown it, so both are cut into sets of one size: the five-word
    shingles of each run of `run` words. The run an item and a document share gives equal sets,
    so its min-hash, one hash function being enough at similarity 1, is among the min-hashes of
    both: the search misses nothing. Neighbouring runs mostly share their min-hash, so a text gives
    about a sixth as many hashes as words. Candidates are verified by exact containment of the words. Spark
    broadcasts the hashes of the items if they are small and joins by shuffle if they are not.
    """
    docs = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    its = items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    doc_side = docs.mapInArrow(_signatures("doc_id", run), "doc_id long, h long")
    item_side = its.mapInArrow(_signatures("item_id", run), "item_id long, h long").distinct()
    pairs = Scratch(documents.sparkSession).keep(doc_side.join(item_side, "h").select("doc_id", "item_id").distinct())
    texts = keyed(docs, pairs.select("doc_id").distinct(), ["doc_id"])
    passages = pairs.join(its.distinct(), "item_id").groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "text")).alias("c"))
    candidates = texts.join(passages, "doc_id").select("doc_id", "text", F.col("c.item_id").alias("items"), F.col("c.text").alias("passages"))
    return candidates.mapInArrow(_verify(run), "doc_id long, item_id long").distinct()
