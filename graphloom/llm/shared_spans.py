"""Long spans that occur letter by letter in more than one document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.textops import code_points, mix, selected, window_hashes
from graphloom.session import Scratch, keyed

#: Groups of more texts than this are not paired on a coarse digest but digested again more finely.
COARSE_GROUP = 64


def _digests(span: int, length: int):
    """Digests of units of `length` characters, at least one in every `span` characters of a text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(2).to_pylist():
                h = window_hashes(code_points(text), length)
                found.append(np.unique(h[selected(h, span - length + 1)]))
            row = pa.array(np.repeat(np.arange(len(found)), [len(h) for h in found]))
            if len(row):
                digests = pa.array(np.concatenate(found).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), digests], ["same", "same2", "digest"])

    return work


def _verify(span: int):
    """Whether two texts share a span, from all windows of `span` characters, compared letter by letter."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[int, np.ndarray] = {}

        def windows(key: int, text: str) -> np.ndarray:
            if key not in cache:
                if len(cache) > 64:
                    cache.clear()
                cache[key] = window_hashes(code_points(text), span)
            return cache[key]

        for batch in batches:
            out = []
            for a, b, ta, tb in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                ha, hb = windows(a, ta), windows(b, tb)
                in_a = np.flatnonzero(np.isin(ha, hb))
                if any(ta[i : i + span] in tb for i in in_a.tolist()):  # the digests' word is not taken for it
                    out.append((a, b))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["rep_a", "rep_b"])

    return work


class SharedSpans:
    """Pairs between representatives of equal texts, and who they stand for."""

    def __init__(self, members: DataFrame, pairs: DataFrame):
        self.members, self.pairs = members, pairs

    def document_pairs(self) -> DataFrame:
        """(doc_id_a, doc_id_b): every pair of documents that share a span, the smaller doc_id first."""
        a = self.members.select(F.col("rep").alias("rep_a"), F.col("doc_id").alias("x"))
        b = self.members.select(F.col("rep").alias("rep_b"), F.col("doc_id").alias("y"))
        between = self.pairs.select("rep_a", "rep_b").join(a, "rep_a").join(b, "rep_b").select("x", "y")
        copies = self.members.where("n > 1")
        within = copies.select("rep", F.col("doc_id").alias("x")).join(copies.select("rep", F.col("doc_id").alias("y")), "rep").where("x < y").select("x", "y")
        return between.unionByName(within).select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))


def shared_spans(documents: DataFrame, span: int = 400) -> SharedSpans:
    """Documents with an identical span of `span` or more characters (code points, blanks and line ends included).

    documents: doc_id (unique), text. Texts that are NULL or shorter than `span` share nothing.
    Equal texts form one class, whose smallest doc_id represents it.

    Method: unit hashing. A span may begin and end inside lines and paragraphs, so the units are not
    those but stretches of `span`/2 characters chosen by their content: the smallest digest of
    every window. Any `span` shared characters hold a unit that both texts choose. Digests are
    grouped globally; a digest of one text only is dropped before any pairing. Groups of more than
    COARSE_GROUP texts, a block of text that very many share, are not paired: their texts are digested again with units of
    nearly the full span, so that texts meet only if they share that much. Pairs are verified
    on all windows of `span` characters. Listing pairs is this function's purpose; `shared_windows` finds the spans without.
    """
    scratch = Scratch(documents.sparkSession)
    # Two hashes, 96 bits, name a text.
    docs = documents.where(F.col("doc_id").isNotNull() & (F.char_length("text") >= span)).select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("same"), F.hash("text").alias("same2")
    )
    named = scratch.keep(docs.select("doc_id", "same", "same2"))
    classes = scratch.keep(named.groupBy("same", "same2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")))
    members = named.join(classes, ["same", "same2"]).select("doc_id", "rep", "n")

    def digests(of: DataFrame, length: int) -> DataFrame:
        """One row a digest and class: copies of a text add nothing."""
        d = of.select("same", "same2", "text").mapInArrow(_digests(span, length), "same long, same2 int, digest long")
        return d.dropDuplicates(["digest", "same", "same2"])

    # Spread by digest and text, so that a digest of very many texts fills no partition; its size is added up before the shuffle.
    coarse = scratch.keep(digests(docs, span // 2))
    sizes = coarse.groupBy("digest").agg(F.count(F.lit(1)).alias("g")).where("g > 1")
    common = scratch.keep(coarse.join(sizes, "digest"))
    crowded = scratch.keep(common.where(F.col("g") > COARSE_GROUP).select("same", "same2").distinct())
    fine = digests(keyed(docs, crowded, ["same", "same2"]), span - span // 40)

    def pairs(d: DataFrame) -> DataFrame:
        r = d.join(classes, ["same", "same2"]).select("digest", "rep")
        return r.select("digest", F.col("rep").alias("rep_a")).join(r.select("digest", F.col("rep").alias("rep_b")), "digest").where("rep_a < rep_b").select("rep_a", "rep_b")

    candidates = scratch.keep(pairs(common.where(F.col("g") <= COARSE_GROUP)).unionByName(pairs(fine)).distinct())
    asked = scratch.keep(candidates.select(F.explode(F.array("rep_a", "rep_b")).alias("doc_id")).distinct())
    held = scratch.keep(keyed(docs.select("doc_id", "text"), asked, ["doc_id"]).withColumnRenamed("doc_id", "rep"))
    both = (
        candidates.join(held.select(F.col("rep").alias("rep_a"), F.col("text").alias("text_a")), "rep_a")
        .join(held.select(F.col("rep").alias("rep_b"), F.col("text").alias("text_b")), "rep_b")
        .select("rep_a", "rep_b", "text_a", "text_b")
    )
    found = scratch.keep(both.mapInArrow(_verify(span), "rep_a long, rep_b long"))
    return SharedSpans(members, found)


def _units(span: int, length: int):
    """Units of `length` characters with their places, at least one in every `span` characters of a text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, digests, places = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = window_hashes(code_points(text), length)
                at = selected(h, span - length + 1)
                keys.append(np.full(len(at), key, np.int64))
                digests.append(h[at].view(np.int64))
                places.append(at.astype(np.int32))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, digests, places)], ["doc_id", "digest", "place"])

    return work


def _windows(span: int, length: int):
    """Two digests of every window of `span` characters that holds one of the given units."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text, places in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                c = code_points(text)
                h, h2 = window_hashes(c, span), window_hashes(mix(c + np.uint64(1 << 32)), span)
                near = np.zeros(len(h) + 1, np.int32)
                places = np.array(places)
                np.add.at(near, np.clip(places - (span - length), 0, len(h)), 1)
                np.add.at(near, np.clip(places + 1, 0, len(h)), -1)
                at = np.flatnonzero(np.cumsum(near)[:-1] > 0)
                if len(at):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), key, np.int64)), pa.array(at.astype(np.int32)), pa.array(h[at].view(np.int64)), pa.array((h2[at] >> np.uint64(32)).astype(np.uint32).view(np.int32))],
                        ["doc_id", "start", "h", "h2"],
                    )

    return work


def shared_windows(documents: DataFrame, span: int = 400) -> tuple[DataFrame, DataFrame]:
    """(members, windows): the windows of `span` characters that several texts hold.

    members: doc_id, rep, n: the class of equal texts a document belongs to, its smallest doc_id and its size; only texts of
    `span` or more characters. windows: doc_id (representatives only), start, earlier (a text with a smaller doc_id holds it too).

    Method: unit hashing without any pairs. Units of span/2 characters, chosen by their content, are grouped
    globally by digest; units of one text only are dropped. Every window that holds a unit left is
    digested and grouped globally in the same way, with its earliest owner. Both groupings add up before they
    shuffle and keep two numbers a digest, so a passage that very many texts hold costs no more than its length in each.
    """
    scratch, length = Scratch(documents.sparkSession), span // 2
    docs = documents.where(F.col("doc_id").isNotNull() & (F.char_length("text") >= span)).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    named = scratch.keep(docs.select("doc_id", F.xxhash64("text").alias("same"), F.hash("text").alias("same2")).distinct())
    classes = scratch.keep(named.groupBy("same", "same2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")))
    members = named.join(classes, ["same", "same2"]).select("doc_id", "rep", "n")
    units = scratch.keep(keyed(docs.mapInArrow(_units(span, length), "doc_id long, digest long, place int"), classes.select(F.col("rep").alias("doc_id")), ["doc_id"]))
    several = units.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("digest")
    near = scratch.keep(units.join(several, "digest", "left_semi").groupBy("doc_id").agg(F.collect_set("place").alias("places")))
    texts = keyed(docs, near.select("doc_id"), ["doc_id"]).dropDuplicates(["doc_id"]).join(near, "doc_id").select("doc_id", "text", "places")
    windows = scratch.keep(texts.mapInArrow(_windows(span, length), "doc_id long, start int, h long, h2 int"))
    owners = windows.groupBy("h", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("h", "h2", "first")
    found = windows.join(owners, ["h", "h2"]).select("doc_id", F.col("start").cast("long").alias("start"), (F.col("doc_id") > F.col("first")).alias("earlier"))
    return members, found


def _runs(windows: DataFrame, span: int) -> DataFrame:
    """(doc_id, start, end): what windows cover, overlapping and touching ones joined."""
    return merged(windows.select("doc_id", "start", (F.col("start") + span).alias("end")), "doc_id")


def merged(spans: DataFrame, *key: str) -> DataFrame:
    """Overlapping and touching [start, end) of each key joined."""
    w = Window.partitionBy(*key).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_new", F.coalesce((F.col("start") > before).cast("int"), F.lit(1)))
    return marked.withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*key, "_g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_g")


def shared_parts(documents: DataFrame, span: int = 400) -> DataFrame:
    """(doc_id, n_chars, shared_chars, share) of every document: how much of it is found in another one, in spans of `span` or more.

    A NULL text has n_chars 0, and a text without characters share 0.
    """
    members, windows = shared_windows(documents, span)
    parts = _runs(windows, span).groupBy("doc_id").agg(F.sum(F.col("end") - F.col("start")).alias("part"))
    per = members.join(parts, "doc_id", "left").select("doc_id", F.when(F.col("n") > 1, F.lit(-1)).otherwise(F.coalesce("part", F.lit(0))).alias("shared"))
    n = F.coalesce(F.char_length("text"), F.lit(0)).cast("long")
    out = documents.select("doc_id", n.alias("n_chars")).join(per, "doc_id", "left")
    shared = F.when(F.col("shared") == -1, F.col("n_chars")).otherwise(F.coalesce("shared", F.lit(0)))
    return out.select("doc_id", "n_chars", shared.cast("long").alias("shared_chars"), F.when(F.col("n_chars") > 0, shared / F.col("n_chars")).otherwise(F.lit(0.0)).alias("share"))


def later_spans(documents: DataFrame, span: int = 400) -> DataFrame:
    """(doc_id, start, end): spans, at their original offsets, that a document with a smaller doc_id holds too; removing them keeps the earliest occurrence."""
    members, windows = shared_windows(documents, span)
    copies = members.where("doc_id <> rep").select("doc_id")
    whole = documents.join(copies, "doc_id", "left_semi").select("doc_id", F.lit(0).cast("long").alias("start"), F.char_length("text").cast("long").alias("end"))
    return whole.unionByName(_runs(windows.where("earlier"), span))
