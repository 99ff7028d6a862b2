"""The reader's query and the logic of spans in a source."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import SPACES
from weftline.operators.ordered import global_ordinal
from weftline.operators.segments import with_cut
from weftline.project import Project, all_of


def facets_for_source(project: Project) -> DataFrame:
    """(source_id, facet..): the frame row's values, else what all of a participant's
    rows agree on, else blank."""
    facets = list(project.facets or project.categories)
    value = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(""))
    row = project.frame.groupBy("pid", "unit").agg(
        F.max(F.struct(*[value(c).alias(c) for c in facets])).alias("_row")
    )
    agree = project.frame.groupBy("pid").agg(
        F.struct(
            *[F.when(F.min(value(c)) == F.max(value(c)), F.min(value(c))).otherwise(F.lit("")).alias(c) for c in facets]
        ).alias("_pid")
    )
    s = project.sources.select("source_id", "pid", "unit").join(row, ["pid", "unit"], "left").join(agree, "pid", "left")
    return s.select(
        "source_id",
        *[
            F.when(F.col("_row").isNotNull(), F.col(f"_row.`{c}`")).otherwise(F.coalesce(F.col(f"_pid.`{c}`"), F.lit(""))).alias(c)
            for c in facets
        ],
    )


def filter_sources(
    project: Project, q: str = "", unit: str = "", pid: str = "", kind: str = "", status: str = "",
    valence: str = "", lens: str = "", facets: dict[str, str] | None = None,
) -> DataFrame:
    """Sources that satisfy all given conditions; existential ones are semi-joins."""
    s = project.sources
    s = s.where(
        all_of(
            ([F.contains(F.lower("text"), F.lit(q.strip().lower()))] if q.strip() else [])
            + [F.col(c) == v for c, v in (("unit", unit), ("pid", pid), ("kind", kind)) if v]
        )
    )
    spans = project.excerpts.select("excerpt_id", "source_id")
    if status:
        touched = spans.select("source_id").distinct()
        s = s.join(touched, "source_id", "left_semi" if status == "has" else "left_anti")
    if valence or lens:
        coded = project.codings.select("excerpt_id", "code_id", "valence")
        if valence:
            wanted = "" if valence == "unjudged" else valence
            judged = coded.where(F.coalesce("valence", F.lit("")) == wanted).select("excerpt_id").distinct()
            s = s.join(spans.join(judged, "excerpt_id").select("source_id").distinct(), "source_id", "left_semi")
        if lens:
            wanted = "" if lens == "__none__" else lens
            of_lens = project.codes.select("code_id", "lens")
            seen = coded.join(of_lens, "code_id", "left").where(F.coalesce("lens", F.lit("")) == wanted)
            seen = seen.select("excerpt_id").distinct()
            s = s.join(spans.join(seen, "excerpt_id").select("source_id").distinct(), "source_id", "left_semi")
    for c, v in (facets or {}).items():
        if v:
            fits = facets_for_source(project).where(F.col(f"`{c}`") == v).select("source_id")
            s = s.join(fits, "source_id", "left_semi")
    return s


def excerpt_order(excerpts: DataFrame) -> DataFrame:
    """``excerpts`` with ``place``: by source, then start as a number, then id."""
    return global_ordinal(excerpts.withColumn("_start", F.col("start").cast("long")), ["source_id", "_start", "excerpt_id"]).drop("_start")


def span_bounds(spans: DataFrame, sources: DataFrame) -> DataFrame:
    """Append ``ok``: 0 <= start < end <= length of the source."""
    size = sources.select("source_id", F.length(F.coalesce("text", F.lit(""))).alias("_len"))
    ok = (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.col("_len"))
    return spans.join(size, "source_id", "left").withColumn("ok", F.coalesce(ok, F.lit(False))).drop("_len")


def selection_trim(spans: DataFrame, sources: DataFrame) -> DataFrame:
    """Trim white space at both ends of a span; drop what is left under two characters."""
    trims = with_cut(spans, sources, name="_cut").where("_cut <> ''")
    n = F.length("_cut")
    return (
        trims.withColumn("_l", n - F.length(F.ltrim("_cut", F.lit(SPACES))))
        .withColumn("_r", n - F.length(F.rtrim("_cut", F.lit(SPACES))))
        .withColumn("start", F.col("start") + F.col("_l"))
        .withColumn("end", F.greatest(F.col("start"), F.col("end") - F.col("_r")))
        .where("end - start >= 2")
        .select(*spans.columns)
    )


def greedy_spans(excerpts: DataFrame) -> DataFrame:
    """(source_id, spans): spans by start, skipping those that start inside the last one kept.

    Only the first span at each start can be kept, so a source has at most as many
    candidates as characters.  Spans are then cut into islands that do not reach each
    other; the fold runs inside an island.
    """
    first = excerpts.groupBy("source_id", "start").agg(F.min(F.struct("excerpt_id", "end")).alias("f")).select(
        "source_id", "start", "f.end", "f.excerpt_id"
    )
    w = Window.partitionBy("source_id").orderBy("start")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = first.withColumn("_new", (F.col("start") >= F.coalesce(reach, F.lit(-1))).cast("int")).withColumn(
        "_island", F.sum("_new").over(w)
    )
    span = F.struct("start", "end", "excerpt_id")
    kept = islands.groupBy("source_id", "_island").agg(F.sort_array(F.collect_list(span)).alias("s")).select(
        "source_id",
        F.aggregate(
            "s",
            F.struct(F.lit(-1).alias("pos"), F.slice("s", 1, 0).alias("out")),
            lambda acc, x: F.when(
                x["start"] >= acc["pos"],
                F.struct(x["end"].cast("int").alias("pos"), F.concat(acc["out"], F.array(x)).alias("out")),
            ).otherwise(acc),
            lambda acc: acc["out"],
        ).alias("out"),
    )
    return kept.groupBy("source_id").agg(F.sort_array(F.flatten(F.collect_list("out"))).alias("spans"))


def overlap_clash(new_spans: DataFrame, excerpts: DataFrame) -> DataFrame:
    """(new_id, excerpt_id): for each new span the first existing one it overlaps.

    Rows that share a ``new_id`` are one new span: it gets one row, the first of what any
    of them overlaps.
    Existing spans are swept from the right: at position ``a`` the earliest-starting
    span among those that end after ``a`` decides.  No pair of spans is ever formed,
    and positions are made distinct first, so a source is at most its own length.
    """
    ends = excerpts.groupBy("source_id", F.col("end").alias("pos")).agg(
        F.min(F.struct("start", "excerpt_id")).alias("cand")
    ).withColumn("asks", F.lit(0))
    asks = new_spans.select("source_id", F.col("start").alias("pos")).distinct().withColumn(
        "cand", F.lit(None).cast(ends.schema["cand"].dataType)
    ).withColumn("asks", F.lit(1))
    w = Window.partitionBy("source_id").orderBy(F.desc("pos"), F.desc("asks"))
    swept = ends.unionByName(asks).withColumn(
        "best", F.min("cand").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    answer = swept.where("asks = 1 and best is not null").select("source_id", F.col("pos").alias("start"), "best")
    return (
        new_spans.join(answer, ["source_id", "start"])
        .where(F.col("best.start") < F.col("end"))
        .groupBy("new_id")
        .agg(F.min("best").alias("best"))
        .select("new_id", F.col("best.excerpt_id").alias("excerpt_id"))
    )
