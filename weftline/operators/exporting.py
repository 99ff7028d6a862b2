"""Tables for exchange: assembled documents, shifted offsets, selections, cases.

The unit of work is a *part*: the piece of a document one source contributes.  Its
place comes from a running sum of lengths, so a participant-unit pair that holds a
large share of the corpus is never one string in one task; documents small enough
to be a cell are also given whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import has_wide, strip
from weftline.functions.values import participant_label, stable_guid
from weftline.operators.ordered import running_sums
from weftline.operators.segments import count_before, counts_at, text_sizes, with_cut
from weftline.project import Project, blank, union_all

RULE = "─" * 66
LARGEST_CELL = 100_000_000


def newline_remap(spans: DataFrame, texts: DataFrame) -> DataFrame:
    """``spans`` (source_id, start, end, ..) after every line feed of ``texts`` became two characters."""
    points = spans.select("source_id", F.explode(F.array("start", "end")).alias("at"))
    feeds = count_before(points, texts)
    out = counts_at(counts_at(spans, feeds, "start", "_f"), feeds, "end", "_g")
    return out.withColumn("start", F.col("start") + F.col("_f")).withColumn("end", F.col("end") + F.col("_g")).select(*spans.columns)


def _lead(text: str = "text") -> Column:
    return F.length(text) - F.length(F.ltrim(F.col(text), F.lit(_spaces())))


def _spaces() -> str:
    from weftline.functions.text import SPACES

    return SPACES


def document_parts(project: Project, merge: bool = True, limit: int | None = None) -> DataFrame:
    """One row per source: its document, where its part starts, and the part's text.

    Columns: source_id, doc_id, pid, unit, name, head (heading length of the
    document), start (of the part in the document), shift (what to add to an offset in
    the source), piece.  Leading white space of a source is not written, which the
    shift takes back.
    """
    s = project.sources.select(
        "source_id", "pid", *[F.coalesce(c, F.lit("")).alias(c) for c in ("unit", "kind", "label", "text")]
    )
    alone = blank("unit") if merge else F.lit(True)
    kind_or = F.when(F.col("kind") == "", F.lit("source")).otherwise(F.col("kind"))

    # a source that stands alone, under a heading of its own
    if merge:
        name = F.concat(participant_label("pid"), F.lit(" · "), kind_or)
    else:
        where = F.coalesce(F.nullif("unit", F.lit("")), F.nullif("kind", F.lit("")), F.lit("-"))
        name = F.concat(participant_label("pid"), F.lit(" · "), where, F.lit(" · "), F.col("source_id"))
    what = F.when(blank("label"), F.col("kind")).otherwise(F.concat(kind_or, F.lit(" · "), "label"))
    whole = (
        s.where(alone)
        .withColumn("name", name)
        .withColumn("head_text", F.concat("name", F.lit("\n"), what, F.lit(" · "), "source_id", F.lit(f"\n{RULE}\n\n")))
        .select(
            "source_id", F.col("source_id").alias("doc_id"), "pid", "unit", "name",
            F.length("head_text").cast("long").alias("head"), F.length("head_text").cast("long").alias("start"),
            (F.length("head_text") - _lead()).cast("long").alias("shift"),
            F.concat(strip("text"), F.lit("\n")).alias("piece"),
        )
    )
    if not merge:
        return whole

    members = s.where(~alone).withColumn("_label", strip("label"))
    title = F.when(F.col("_label") == "", F.lit("")).otherwise(F.concat("_label", F.lit("\n\n")))
    heads = _merged_headings(members).select("pid", "unit", "doc_id", "name", "head")
    sized = members.select(
        "source_id", "pid", "unit",
        F.length(title).alias("_title"), _lead().alias("_lead"),
        F.concat(title, strip("text"), F.lit("\n\n")).alias("piece"),
    ).withColumn("_len", F.length("piece"))
    more = {} if limit is None else {"limit": limit}
    placed = running_sums(
        sized.drop("piece"), ["pid", "unit"], ["source_id"], F.col("_len"), "_before", **more
    )
    merged = (
        placed.join(heads, ["pid", "unit"])
        .join(sized.select("source_id", "piece"), "source_id")
        .select(
            "source_id", "doc_id", "pid", "unit", "name", "head",
            (F.col("head") + F.col("_before")).alias("start"),
            (F.col("head") + F.col("_before") + F.col("_title") - F.col("_lead")).alias("shift"),
            "piece",
        )
    )
    return merged.unionByName(whole)


def _merged_headings(members: DataFrame) -> DataFrame:
    """Heading of each merged document, its length computed without writing it."""
    kinds = F.array_join(F.sort_array(F.collect_set(F.nullif("kind", F.lit("")))), "/")
    agg = members.groupBy("pid", "unit").agg(
        F.count(F.lit(1)).alias("n"), kinds.alias("kinds"),
        F.sum(F.length("source_id") + 2).alias("ids_len"),
    )
    what = F.concat(
        F.when(F.col("kinds") == "", F.lit("source")).otherwise(F.col("kinds")), F.lit(" · "),
        F.col("n").cast("string"), F.when(F.col("n") == 1, F.lit(" source")).otherwise(F.lit(" sources")),
    )
    return (
        agg.withColumn("doc_id", F.concat_ws("-", F.lit("D"), "pid", "unit"))
        .withColumn("name", F.concat(participant_label("pid"), F.lit(" · "), "unit"))
        .withColumn("top", F.concat("name", F.lit("\n"), what, F.lit(" · ")))
        .withColumn("head", F.length("top") + F.col("ids_len") - 2 + len(f"\n{RULE}\n\n"))
    )


def assemble_documents(
    project: Project, merge: bool = True, limit: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(docs, placement): docs(doc_id, name, text, pid, unit), placement(source_id, doc_id, shift).

    ``text`` is null for a document too large to be one cell; its parts are in
    ``document_parts`` all the same.
    """
    parts = document_parts(project, merge, limit)
    placement = parts.select("source_id", "doc_id", "shift")
    fits = parts.groupBy("doc_id").agg(
        F.first("name").alias("name"), F.first("pid").alias("pid"), F.first("unit").alias("unit"),
        F.max(F.col("start") + F.length("piece")).alias("chars"),
    )
    pieces = parts.join(fits.where(F.col("chars") <= LARGEST_CELL).select("doc_id"), "doc_id", "left_semi")
    kind_label = project.sources.select("source_id", "kind", "label")
    body = (
        pieces.join(kind_label, "source_id")
        .groupBy("doc_id")
        .agg(
            F.sort_array(F.collect_list(F.struct("start", "source_id", "piece"))).alias("p"),
            F.array_join(F.sort_array(F.collect_set(F.nullif(F.coalesce("kind", F.lit("")), F.lit("")))), "/").alias("kinds"),
            F.first("name").alias("name"), F.first("pid").alias("pid"),
            F.first(F.coalesce("unit", F.lit(""))).alias("unit"),
            F.first(F.coalesce("kind", F.lit(""))).alias("kind"), F.first(F.coalesce("label", F.lit(""))).alias("label"),
        )
    )
    single = (strip("unit") == "") if merge else F.lit(True)
    kind_or = F.when(F.col("kind") == "", F.lit("source")).otherwise(F.col("kind"))
    what = F.when(
        single, F.when(blank("label"), F.col("kind")).otherwise(F.concat(kind_or, F.lit(" · "), "label"))
    ).otherwise(
        F.concat(
            F.when(F.col("kinds") == "", F.lit("source")).otherwise(F.col("kinds")), F.lit(" · "),
            F.size("p").cast("string"), F.when(F.size("p") == 1, F.lit(" source")).otherwise(F.lit(" sources")),
        )
    )
    full = F.concat(
        "name", F.lit("\n"), what, F.lit(" · "), F.array_join("p.source_id", ", "), F.lit(f"\n{RULE}\n\n"),
        F.array_join("p.piece", ""),
    )
    text = F.when(single, full).otherwise(F.concat(F.rtrim(full, F.lit(_spaces())), F.lit("\n")))
    docs = fits.select("doc_id", "name", "pid", "unit").join(
        body.select("doc_id", text.alias("text")), "doc_id", "left"
    )
    return docs.select("doc_id", "name", "text", "pid", "unit"), placement


def doc_place_shift(project: Project, placement: DataFrame) -> DataFrame:
    """(excerpt_id, doc_id, shift): the document each excerpt lands in."""
    return project.excerpts.select("excerpt_id", "source_id").join(placement, "source_id").select(
        "excerpt_id", "doc_id", "shift"
    )


def export_check(project: Project, merge: bool = True, parts: DataFrame | None = None) -> DataFrame:
    """(object_id, problem): everything that would make an export silently wrong.

    Offsets are verified against the parts as they will be written.
    """
    parts = document_parts(project, merge) if parts is None else parts
    x = project.excerpts.select("excerpt_id", "source_id", "start", "end", "text")
    first = with_cut(x, project.sources, name="_cut").join(text_sizes(project.sources), "source_id", "left").select(
        "excerpt_id", "source_id", "start", "end", "text",
        F.when(F.col("size").isNull(), F.concat(F.lit("source_missing: "), "source_id"))
        .when(F.col("_cut") != F.col("text"), F.lit("text_drift")).alias("problem"),
    )
    good = first.where("problem is null").drop("problem")
    placed = good.join(parts.select("source_id", "doc_id", (F.col("shift") - F.col("start")).alias("_move")), "source_id").select(
        "excerpt_id", "doc_id", "source_id", "text", (F.col("start") + F.col("_move")).alias("start"), (F.col("end") + F.col("_move")).alias("end")
    )
    landed = with_cut(placed, parts, "piece", "_cut")
    lands = (F.col("start") >= 0) & (F.col("_cut") == F.col("text"))
    wide = project.sources.where(has_wide("text")).select(
        F.col("source_id").alias("object_id"), F.lit("wide_characters").alias("problem")
    )
    by_code = project.codings.join(project.codes.select("code_id"), "code_id", "left_anti").select("code_id").distinct()
    by_excerpt = project.codings.join(project.excerpts.select("excerpt_id"), "excerpt_id", "left_anti").select("excerpt_id").distinct()
    return union_all(
        [
            wide,
            first.where("problem is not null").select(F.col("excerpt_id").alias("object_id"), "problem"),
            landed.where(~lands).select(
                F.col("excerpt_id").alias("object_id"),
                F.concat(F.lit("span_misplaced: "), "doc_id").alias("problem"),
            ),
            by_code.select(F.col("code_id").alias("object_id"), F.lit("code_undefined").alias("problem")),
            by_excerpt.select(F.col("excerpt_id").alias("object_id"), F.lit("excerpt_missing").alias("problem")),
        ]
    )


# ---------------------------------------------------------------- selections


def selections_by_valence(project: Project, placement: DataFrame, valence: bool = True) -> DataFrame:
    """One selection per (excerpt, valence) at the excerpt's place in its document."""
    v = F.lower(strip(F.coalesce("valence", F.lit("")))) if valence else F.lit("")
    groups = project.codings.groupBy("excerpt_id", v.alias("valence")).agg(
        F.sort_array(F.collect_set("code_id")).alias("codes")
    )
    many = groups.groupBy("excerpt_id").agg((F.count(F.lit(1)) > 1).alias("multi"))
    place = project.excerpts.select("excerpt_id", "source_id", "start", "end").join(placement, "source_id")
    return groups.join(many, "excerpt_id").join(place, "excerpt_id").select(
        "doc_id", "source_id", "excerpt_id", "valence",
        (F.col("start") + F.col("shift")).alias("start"), (F.col("end") + F.col("shift")).alias("end"),
        "codes", "multi",
    )


def export_positions(
    selections: DataFrame, base: int = 0, inclusive: bool = False, parts: DataFrame | None = None
) -> DataFrame:
    """Selections in the convention of an importer.

    With ``parts`` the positions are also moved for CRLF line ends: the line feeds of
    the parts in front are a running sum, the rest is counted inside the part.
    """
    start, end = F.col("start"), F.col("end")
    out = selections
    if parts is not None:
        at = parts.select("source_id", F.col("start").alias("_at"))
        out = out.join(at, "source_id").join(_newlines(parts), "source_id")
        out = out.withColumn("_p", start - F.col("_at")).withColumn("_q", end - F.col("_at"))
        feeds = count_before(out.select("source_id", F.explode(F.array("_p", "_q")).alias("at")), parts, text="piece")
        out = counts_at(counts_at(out, feeds, "_p", "_f"), feeds, "_q", "_g")
        start, end = start + F.col("_nl") + F.col("_f"), end + F.col("_nl") + F.col("_g")
    return out.withColumn("_s", start + base).withColumn("_e", end + base - int(inclusive)).withColumn(
        "start", F.col("_s")
    ).withColumn("end", F.col("_e")).select(*selections.columns)


def _newlines(parts: DataFrame) -> DataFrame:
    """(source_id, _nl): line feeds in front of each part.

    A heading always has four: after the name, after the ids, and two after the rule.
    """
    feeds = F.length("piece") - F.length(F.replace("piece", F.lit("\n"), F.lit("")))
    counted = running_sums(
        parts.select("source_id", "doc_id", "start", feeds.alias("_f")), ["doc_id"], ["start"], F.col("_f"), "_b"
    )
    return counted.select("source_id", (F.col("_b") + 4).alias("_nl"))


def shortest_passages(project: Project, parts: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` shortest passages with their final offsets, to look up after an import."""
    short = project.excerpts.select("excerpt_id", "source_id", "start", "end", "text").orderBy(
        F.length("text"), "excerpt_id"
    ).limit(k)
    return short.join(parts.select("source_id", "doc_id", "name", "shift"), "source_id").select(
        "excerpt_id", "doc_id", "name", (F.col("start") + F.col("shift")).alias("start"),
        (F.col("end") + F.col("shift")).alias("end"), "text",
    )


def export_counts(project: Project, valence: bool = True) -> DataFrame:
    """One row: files, sources, selections, codings, codes, cases, notes, split passages."""
    one = lambda df, c: df.agg(c).scalar()
    v = F.lower(strip(F.coalesce("valence", F.lit("")))) if valence else F.lit("")
    per = project.codings.groupBy("excerpt_id", v.alias("v")).agg(F.count(F.lit(1)).alias("n")).groupBy(
        "excerpt_id"
    ).agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    files = project.sources.select(
        F.when(blank("unit"), F.struct(F.col("source_id").alias("a"), F.lit("").alias("b"))).otherwise(
            F.struct(F.col("pid").alias("a"), F.col("unit").alias("b"))
        ).alias("f"),
        blank("unit").alias("alone"),
    )
    sel = F.coalesce(F.nullif("sel", F.lit(0)), F.col("excerpts"))
    return per.agg(
        F.coalesce(F.sum("k"), F.lit(0)).alias("sel"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.count_if(F.col("k") > 1).alias("split_passages"),
    ).withColumn("excerpts", one(project.excerpts, F.count_distinct("excerpt_id"))).select(
        one(files, F.count_distinct("alone", "f")).alias("files"),
        one(project.sources, F.count(F.lit(1))).alias("sources"),
        sel.alias("selections"),
        (F.col("n") + (sel if valence else F.lit(0))).alias("codings"),
        one(project.codes, F.count(F.lit(1))).alias("codes"),
        one(project.frame, F.count(F.lit(1))).alias("cases"),
        (one(project.notes, F.count(F.lit(1))) if project.notes is not None else F.lit(0)).alias("notes"),
        "split_passages",
    )


def export_ids(project: Project, selections: DataFrame) -> DataFrame:
    """(object_id, guid) of the selections and codings that would be written."""
    multi_key = F.when(F.col("multi"), F.concat_ws("|", "excerpt_id", "valence")).otherwise(F.col("excerpt_id"))
    sel = selections.select(multi_key.alias("object_id"), stable_guid("sel", multi_key).alias("guid"))
    key = F.concat_ws("|", "excerpt_id", "code_id", F.coalesce("coder", F.lit("")))
    cod = project.codings.select(key.alias("object_id"), stable_guid("coding", key).alias("guid"))
    return sel.unionByName(cod)


def duplicate_ids(df: DataFrame, col: str) -> DataFrame:
    """Values of an id column that occur more than once."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


# ---------------------------------------------------------------- cases


def case_table(project: Project) -> DataFrame:
    """(case_id, pid, unit, name, docs): one per frame row and one per loose source."""
    with_doc = project.sources.where(~blank("unit")).select("pid", "unit").distinct().withColumn("_has", F.lit(True))
    framed = project.frame.select("pid", "unit").join(with_doc, ["pid", "unit"], "left").select(
        F.concat_ws("|", "pid", "unit").alias("case_id"), "pid", "unit",
        F.concat(participant_label("pid"), F.lit(" · "), "unit").alias("name"),
        F.when(F.col("_has"), F.array(F.concat_ws("-", F.lit("D"), "pid", "unit")))
        .otherwise(F.array().cast("array<string>")).alias("docs"),
    )
    kind_or = F.when(blank("kind"), F.lit("source")).otherwise(F.col("kind"))
    loose = project.sources.where(blank("unit")).select(
        F.concat(F.lit("loose|"), "source_id").alias("case_id"), "pid", F.lit("").alias("unit"),
        F.concat(participant_label("pid"), F.lit(" · "), kind_or).alias("name"), F.array("source_id").alias("docs"),
    )
    return framed.unionByName(loose)


def assignment_attrs(cases: DataFrame, assign: DataFrame) -> DataFrame:
    """Append the pass and coder a participant is assigned to."""
    one = assign.groupBy("pid").agg(F.max(F.struct("pass", "coder")).alias("_a"))
    return cases.join(one, "pid", "left").select(
        *cases.columns, F.coalesce("_a.pass", F.lit("")).alias("pass"), F.coalesce("_a.coder", F.lit("")).alias("coder")
    )


def case_values_long(project: Project, assign: DataFrame | None = None) -> DataFrame:
    """(case_id, variable, type, value) of every non-blank value of every case."""
    cols = [c for c in project.frame.columns if c not in ("pid", "unit", "game")]
    as_rows = F.inline(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("variable"),
                    F.lit("Float" if c in project.measures else "Text").alias("type"),
                    F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias("value"),
                )
                for c in cols
            ]
        )
    )
    values = project.frame.select(F.concat_ws("|", "pid", "unit").alias("case_id"), as_rows).where(~blank("value"))
    if assign is None:
        return values
    attrs = assignment_attrs(case_table(project), assign).select(
        "case_id",
        F.inline(
            F.array(
                *[F.struct(F.lit(c).alias("variable"), F.lit("Text").alias("type"), F.col(c).alias("value")) for c in ("pass", "coder")]
            )
        ),
    )
    return values.unionByName(attrs.where("value <> ''"))
