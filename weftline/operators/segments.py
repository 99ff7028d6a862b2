"""Texts in segments of fixed size, and what spans cut out of them.

A span never carries the document it points into.  Documents are cut once into segments
of ``SEGMENT`` characters; a span meets only the segments it touches (an interval join
whose buckets are the segment numbers), each meeting gives a short piece, and the pieces
of a span are put together.  A source with very many spans, or a very long one, is many
keys, and equal spans are cut once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters of a segment.
SEGMENT = 4096


def text_segments(texts: DataFrame, text: str = "text", size: int = SEGMENT) -> DataFrame:
    """(source_id, seg, piece) of ``texts`` (source_id, text): whole texts, nulls and empty ones give no row."""
    many = F.ceil(F.length(text) / size).cast("int")
    numbers = F.when(F.length(text) > 0, F.sequence(F.lit(0), many - 1))
    cut = texts.select("source_id", F.col(text).alias("_text"), F.explode(numbers).alias("seg"))
    return cut.select("source_id", "seg", F.substring("_text", F.col("seg") * size + 1, F.lit(size)).alias("piece"))


def text_sizes(texts: DataFrame, text: str = "text") -> DataFrame:
    """(source_id, size): characters of each text, 0 for a null."""
    return texts.select("source_id", F.coalesce(F.length(text), F.lit(0)).alias("size"))


def cut_spans(spans: DataFrame, segments: DataFrame, size: int = SEGMENT) -> DataFrame:
    """(source_id, start, end, cut): what each distinct span holds of its text.

    Of a span that reaches beyond its text only the part inside is cut; one that holds
    nothing has no row.
    """
    asked = spans.select("source_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).distinct()
    inside = F.greatest("start", F.lit(0))
    touched = asked.where((F.col("end") > inside)).withColumn(
        "seg", F.explode(F.sequence(F.floor(inside / size).cast("int"), F.floor((F.col("end") - 1) / size).cast("int")))
    )
    base = F.col("seg").cast("long") * size
    first = F.greatest(inside - base, F.lit(0).cast("long"))
    last = F.least(F.col("end") - base, F.lit(size).cast("long"))
    pieces = touched.join(segments, ["source_id", "seg"]).select(
        "source_id", "start", "end", "seg", F.substring("piece", (first + 1).cast("int"), (last - first).cast("int")).alias("cut")
    )
    whole = pieces.groupBy("source_id", "start", "end").agg(F.sort_array(F.collect_list(F.struct("seg", "cut"))).alias("p"))
    return whole.select("source_id", "start", "end", F.array_join("p.cut", "").alias("cut")).where("cut <> ''")


def with_cut(spans: DataFrame, texts: DataFrame, text: str = "text", name: str = "cut") -> DataFrame:
    """``spans`` (source_id, start, end, ..) with the text they hold; '' where they hold nothing."""
    cuts = cut_spans(spans, text_segments(texts, text)).select(
        F.col("source_id").alias("_source"), F.col("start").alias("_start"), F.col("end").alias("_end"), F.col("cut").alias("_cut")
    )
    same = (F.col("source_id") == F.col("_source")) & (F.col("start") == F.col("_start")) & (F.col("end") == F.col("_end"))
    return spans.join(cuts, same, "left").select(*spans.columns, F.coalesce("_cut", F.lit("")).alias(name))


def count_before(points: DataFrame, texts: DataFrame, mark: str = "\n", text: str = "text") -> DataFrame:
    """(source_id, at, n): how often the character ``mark`` stands before each distinct point.

    Segments carry the running count of those in front of them, so only the segment that a
    point lies in is looked into.  Points beyond the text count all of it.
    """
    size = SEGMENT
    marks = lambda c: F.length(c) - F.length(F.replace(c, F.lit(mark), F.lit("")))
    segments = text_segments(texts, text)
    ahead = Window.partitionBy("source_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    counted = segments.select("source_id", "seg", marks("piece").alias("_n")).withColumn("_ahead", F.coalesce(F.sum("_n").over(ahead), F.lit(0)))
    last = counted.groupBy("source_id").agg(F.max("seg").alias("_last"))
    asked = points.select("source_id", F.col("at").cast("long").alias("at")).distinct()
    seg = F.least(F.floor(F.greatest("at", F.lit(0)) / size), F.col("_last")).cast("int")
    placed = asked.join(last, "source_id").select("source_id", "at", seg.alias("seg"))
    within = (F.greatest("at", F.lit(0)) - F.col("seg").cast("long") * size).cast("int")
    found = placed.join(segments, ["source_id", "seg"]).select("source_id", "seg", "at", marks(F.left("piece", within)).alias("_in"))
    return found.join(counted.select("source_id", "seg", "_ahead"), ["source_id", "seg"]).select(
        "source_id", "at", (F.col("_ahead") + F.col("_in")).alias("n")
    )


def counts_at(rows: DataFrame, counts: DataFrame, at: Column | str, name: str) -> DataFrame:
    """``rows`` with the count (of ``count_before``) at a point of their source, 0 where there is none."""
    own = counts.select(F.col("source_id").alias("_of"), F.col("at").alias("_at_"), F.col("n").alias("_n_"))
    at = F.col(at) if isinstance(at, str) else at
    joined = rows.join(own, (F.col("source_id") == F.col("_of")) & (at.cast("long") == F.col("_at_")), "left")
    return joined.withColumn(name, F.coalesce("_n_", F.lit(0))).drop("_of", "_at_", "_n_")
