"""From raw rows to sources and the frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import strip
from weftline.functions.values import padded
from weftline.operators.ordered import row_numbers_by_integer
from weftline.operators.ordered import global_ordinal

# A mapping is a dict: pid, unit, text [..], categories [..], measures [..], kind and
# labels {header: short name}; headers are keys of the cells map.


def _cell(header: str | None):
    if not header:
        return F.lit("")
    return strip(F.coalesce(F.element_at("cells", F.lit(header)), F.lit("")))


def source_id_build(df: DataFrame, ord_column: str = "ord") -> DataFrame:
    """Append ``source_id``: S-<pid>-<running ordinal> by a unique integer order."""
    numbered = row_numbers_by_integer(df.withColumn("_all", F.lit(0)), ["_all"], ord_column, "_n").drop("_all")
    n = (F.col("_n") - 1).cast("string")
    ordinal = F.when(F.length(n) >= 4, n).otherwise(F.lpad(n, 4, "0"))
    return numbered.withColumn(
        "source_id", F.concat_ws("-", F.lit("S"), padded("pid", 3), ordinal)
    ).drop("_n")


def build_sources(cells: DataFrame, mapping: dict) -> DataFrame:
    """One source per non-blank text cell, numbered in row and column order."""
    text = list(mapping.get("text", ()))
    if not text:
        raise ValueError("the mapping names no text column")
    rows = cells.select(
        "ord", _cell(mapping["pid"]).alias("pid"), _cell(mapping.get("unit")).alias("unit"),
        F.inline(
            F.array(*[F.struct(F.lit(i).alias("at"), F.lit(h).alias("header"), _cell(h).alias("text")) for i, h in enumerate(text)])
        ),
    ).where("pid <> '' and text <> ''")
    numbered = source_id_build(rows.withColumn("_at", F.col("ord").cast("long") * len(text) + F.col("at")), "_at")
    return numbered.select(
        "source_id", "pid", "unit", F.lit(mapping.get("kind", "response")).alias("kind"),
        F.regexp_replace("header", r"\A\d+[\.\)]\s*", "").alias("label"), "text",
    )


def frame_first_row(df: DataFrame, by: list[str], order: str = "ord") -> DataFrame:
    """The first row of each key, by an aggregate."""
    rest = [c for c in df.columns if c not in by and c != order]
    if not rest:
        return df.select(*by).distinct()
    return df.groupBy(*by).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in rest]), order).alias("_r")).select(*by, "_r.*")


def build_frame(cells: DataFrame, mapping: dict) -> DataFrame:
    """One row per (pid, unit) with its categories and measures; the first row stands."""
    labels = mapping.get("labels") or {}
    cols = [*mapping.get("categories", ()), *mapping.get("measures", ())]
    rows = cells.select(
        "ord", _cell(mapping["pid"]).alias("pid"), _cell(mapping.get("unit")).alias("unit"),
        *[_cell(h).alias(labels.get(h, h)) for h in cols],
    ).where("pid <> ''")
    return frame_first_row(rows, ["pid", "unit"])


def frame_order(frame: DataFrame) -> DataFrame:
    """``frame`` with ``place``: by participant, then unit, both as text."""
    return global_ordinal(frame, ["pid", "unit"])


def has_kind_flag(frame: DataFrame, sources: DataFrame, kind: str = "interview") -> DataFrame:
    """Append has_<kind>: whether the participant of a frame row has such a source."""
    has = sources.where(F.col("kind") == kind).select("pid").distinct().withColumn("_has", F.lit("yes"))
    return frame.join(has, "pid", "left").select(
        *frame.columns, F.coalesce("_has", F.lit("no")).alias(f"has_{kind}")
    )
