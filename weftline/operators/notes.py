"""Anchors, coding notes and standing notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import strip
from weftline.operators.ordered import global_ordinal
from weftline.operators.statistics import codings_excerpts, plays
from weftline.project import Project, blank
from weftline.schema import UNCATEGORISED


def _pool(project: Project) -> DataFrame:
    coded = codings_excerpts(project).where(~blank("text"))
    return coded.withColumn("noted", ~blank("note")).withColumn("len", F.length("text"))


def anchor_pool_median(project: Project) -> DataFrame:
    """(code_id, median): median passage length, over annotated codings if there are any."""
    return _pool(project).groupBy("code_id").agg(
        F.bool_or("noted").alias("any_noted"),
        F.coalesce(
            F.percentile(F.when(F.col("noted"), F.col("len")), F.lit(0.5)), F.percentile("len", F.lit(0.5))
        ).alias("median"),
    )


def anchor_pick(project: Project, order: tuple[str, ...] = ("ord",)) -> DataFrame:
    """(code_id, excerpt_id, pinned): the passage that shows what a code means.

    The pinned anchor if it exists, else the annotated coding closest to the median
    length, the earliest on a tie.
    """
    mid = anchor_pool_median(project)
    chosen = (
        _pool(project).join(mid, "code_id")
        .where(F.col("noted") | ~F.col("any_noted"))
        .groupBy("code_id")
        .agg(F.min_by("excerpt_id", F.struct(F.abs(F.col("len") - F.col("median")), *order)).alias("auto"))
    )
    there = project.excerpts.select(F.col("excerpt_id").alias("pin")).distinct()
    pinned = (
        project.codes.select("code_id", strip(F.coalesce("anchor", F.lit(""))).alias("pin"))
        .where("pin <> ''").join(there, "pin", "left_semi")
        .groupBy("code_id").agg(F.max("pin").alias("pin"))
    )
    return chosen.join(pinned, "code_id", "full_outer").select(
        "code_id", F.coalesce("pin", "auto").alias("excerpt_id"), F.col("pin").isNotNull().alias("pinned")
    )


def notes_by_code(project: Project) -> DataFrame:
    """Coding notes with valence, passage and place, one row per note.

    Rows and not an array per code: a code may hold most of the notes of a corpus.
    """
    noted = project.codings.withColumn("note", strip(F.coalesce("note", F.lit("")))).where("note <> ''")
    x = project.excerpts.select("excerpt_id", "pid", "unit", "kind", strip(F.coalesce("text", F.lit(""))).alias("text"))
    lens = project.codes.groupBy("code_id").agg(F.max("lens").alias("lens"))
    return (
        noted.select("excerpt_id", "code_id", "coder", "valence", "note")
        .join(x, "excerpt_id", "left")
        .join(lens, "code_id", "left")
        .join(plays(project).select("code_id", "plays"), "code_id", "left")
        .select(
            F.coalesce(F.nullif("lens", F.lit("")), F.lit(UNCATEGORISED)).alias("lens"),
            "code_id", F.coalesce("plays", F.lit(0)).alias("plays"), "excerpt_id", "coder", "valence", "note",
            F.coalesce("text", F.lit("")).alias("text"),
            F.concat_ws(
                " · ", F.concat(F.lit("PID"), F.coalesce("pid", F.lit("?"))),
                F.nullif("unit", F.lit("")), F.nullif("kind", F.lit("")),
            ).alias("where"),
        )
    )


def _noted_codes(project: Project) -> DataFrame:
    """(lens, code_id, plays, notes, _most), one row per annotated code; ``_most`` orders by plays, most first."""
    codes = notes_by_code(project).groupBy("lens", "code_id").agg(F.max("plays").alias("plays"), F.count(F.lit(1)).alias("notes"))
    return codes.withColumn("_most", -F.col("plays"))


def notes_places(project: Project) -> DataFrame:
    """(lens, place, within, code_id, plays, notes): annotated codes in the order they are read.

    Lenses come in the order of their first code, codes of most frame rows first, ties by
    code id; ``within`` counts a lens' codes from 1.  One row per annotated code.
    """
    codes = _noted_codes(project)
    lead = codes.groupBy("lens").agg(F.min(F.struct("_most", "code_id")).alias("_l"))
    led = codes.join(lead.select("lens", F.col("_l._most").alias("_lm"), F.col("_l.code_id").alias("_lc")), "lens")
    within = Window.partitionBy("lens").orderBy("_most", "code_id")
    return global_ordinal(led, ["_lm", "_lc", "lens", "_most", "code_id"]).select(
        "lens", F.col("place").cast("long").alias("place"), F.row_number().over(within).cast("long").alias("within"), "code_id", "plays", "notes"
    )


def notes_by_lens(project: Project) -> DataFrame:
    """(lens, place, codes, notes): how many annotated codes and notes each lens has, in code rank order."""
    lenses = _noted_codes(project).groupBy("lens").agg(
        F.min(F.struct("_most", "code_id")).alias("_l"), F.count(F.lit(1)).alias("codes"), F.sum("notes").alias("notes")
    ).select("lens", "codes", "notes", F.col("_l._most").alias("_lm"), F.col("_l.code_id").alias("_lc"))
    return global_ordinal(lenses, ["_lm", "_lc"]).select("lens", F.col("place").cast("long").alias("place"), "codes", "notes")


def notes_haystack(project: Project) -> DataFrame:
    """(section, lens, key, ref, hay): lower-cased text that a search of the notes looks through.

    One row per note with its whole passage: ``coding`` notes under their code (ref: the
    excerpt), ``standing`` ones under their category (ref: the note's id).  A key matches
    when one of its rows does.
    """
    about = project.codes.groupBy("code_id").agg(
        F.max(F.coalesce("name", F.lit(""))).alias("name"), F.max(F.coalesce("definition", F.lit(""))).alias("definition")
    )
    hay = lambda *parts: F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in parts])).alias("hay")
    coding = notes_by_code(project).join(about, "code_id", "left").select(
        F.lit("coding").alias("section"), "lens", F.col("code_id").alias("key"), F.col("excerpt_id").alias("ref"),
        hay("code_id", "name", "definition", "note", "text"),
    )
    if project.notes is None:
        return coding
    standing = notes_evidence(project, keep=("title", "note")).select(
        F.lit("standing").alias("section"), F.lit("").alias("lens"), F.col("category").alias("key"), F.col("note_id").alias("ref"),
        hay("category", "note_id", "title", "note", "quote"),
    )
    return coding.unionByName(standing)


def _category():
    return strip(F.when(F.coalesce("category", F.lit("")) == "", F.lit(UNCATEGORISED)).otherwise(F.col("category")))


def note_categories(project: Project) -> DataFrame:
    """(category, n) of the standing notes."""
    return project.notes.groupBy(_category().alias("category")).agg(F.count(F.lit(1)).alias("n"))


def notes_evidence(project: Project, keep: tuple[str, ...] = ()) -> DataFrame:
    """Standing notes, with the columns ``keep``, and the excerpt or source their evidence names, if either exists."""
    n = project.notes.withColumn("evidence", strip(F.coalesce("evidence", F.lit(""))))
    x = project.excerpts.select(
        F.col("excerpt_id").alias("evidence"), strip(F.coalesce("text", F.lit(""))).alias("x_text"),
        F.col("pid").alias("x_pid"),
    )
    s = project.sources.select(
        F.col("source_id").alias("evidence"),
        strip(F.coalesce("text", F.lit(""))).alias("s_text"),
        F.col("pid").alias("s_pid"), F.coalesce("label", F.lit("")).alias("s_label"),
    )
    in_x, in_s = F.col("x_pid").isNotNull(), F.col("s_pid").isNotNull()
    named = F.btrim(F.concat(F.lit("PID"), "s_pid", F.lit(" · "), "s_label"), F.lit(" ·"))
    return n.join(x, "evidence", "left").join(s, "evidence", "left").select(
        strip(F.coalesce("note_id", F.lit(""))).alias("note_id"), _category().alias("category"), "evidence",
        F.coalesce(F.when(in_x, F.col("x_text")), F.when(in_s, F.col("s_text")), F.lit("")).alias("quote"),
        F.when(in_x, F.concat(F.lit("PID"), "x_pid")).when(in_s, named)
        .when(F.col("evidence") != "", F.lit("not found")).otherwise(F.lit("")).alias("where"), *keep,
    )
