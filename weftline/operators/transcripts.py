"""Transcripts: cues, who speaks, names out of the words, turns, bodies, linking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import _c, squash
from weftline.functions.values import padded

# ---- fixed values: cue shape, names and ids, words never replaced ----
CUE = r"(?s)(\d\d):(\d\d):(\d\d)[.,]\d+ --> .*?<v ([^>]+)>(.*?)</v>"
NAME_WORD = r"[A-Za-z]{4,}"
STUDENT_ID = r"[sS][0-9]{6,8}"
KEPT_WORDS = (
    "please", "provide", "your", "university", "email", "address", "full", "name",
    "travel", "arrangement", "purposes", "contact", "regarding", "plans", "study",
)
# ---- end of fixed values ----

CHUNK_BITS = 16


def _all(pattern: str, c: Column | str) -> Column:
    found = F.regexp_extract_all(F.coalesce(_c(c), F.lit("")), F.lit(f"({pattern})"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.lower(x)))


def transcript_parse(transcripts: DataFrame) -> DataFrame:
    """(path, seq, t, who, text): one row per cue with words in it."""
    cue = transcripts.select("path", F.posexplode(F.regexp_extract_all("text", F.lit(CUE), F.lit(0))).alias("seq", "cue"))
    part = lambda i: F.regexp_extract("cue", CUE, i)
    return cue.select(
        "path", "seq",
        (part(1).cast("int") * 3600 + part(2).cast("int") * 60 + part(3).cast("int")).alias("t"),
        part(4).alias("who"), squash(part(5)).alias("text"),
    ).where("text <> ''")


def speaker_role(turns: DataFrame, roster: DataFrame) -> DataFrame:
    """Append ``speaker``: PID<n> when the name shares a word or id with the roster entry.

    ``roster`` is (path, pid, blob), one confirmed entry per transcript; transcripts
    without one are left out.
    """
    person = roster.select("path", "pid", _all(NAME_WORD, "blob").alias("_w"), _all(STUDENT_ID, "blob").alias("_i"))
    known = F.arrays_overlap(_all(NAME_WORD, "who"), F.col("_w")) | F.arrays_overlap(_all(STUDENT_ID, "who"), F.col("_i"))
    return turns.join(person, "path").select(
        *turns.columns, "pid",
        F.when(known, F.concat(F.lit("PID"), "pid")).otherwise(F.lit("Interviewer")).alias("speaker"),
    )


def deidentify(turns: DataFrame, roster: DataFrame) -> DataFrame:
    """Replace roster words inside speech by the participant's label, longest first."""
    listed = F.array_distinct(F.regexp_extract_all("blob", F.lit(f"({NAME_WORD})"), F.lit(1)))
    names = F.filter(listed, lambda w: ~F.lower(w).isin(*KEPT_WORDS))
    by_length = F.array_sort(F.transform(names, lambda w: F.struct((-F.length(w)).alias("l"), w.alias("w"))))
    person = roster.select("path", F.col("pid").alias("_pid"), by_length.alias("_names"))
    said = F.aggregate(
        "_names", F.col("text"),
        lambda text, n: F.regexp_replace(text, F.concat(F.lit("(?i)"), n["w"]), F.concat(F.lit("PID"), F.col("_pid"))),
    )
    return turns.join(person, "path", "left").withColumn(
        "text", F.when(F.col("_pid").isNull(), F.col("text")).otherwise(said)
    ).select(*turns.columns)


def turns_merge(turns: DataFrame, bits: int = CHUNK_BITS) -> DataFrame:
    """Join consecutive cues of one speaker: (path, seq, t, speaker, text).

    A path is worked on in chunks of ``2**bits`` sequence numbers.  What a chunk needs
    from those in front, the last speaker and the last turn that began, is one row per
    chunk.
    """
    chunk = ["path", "_chunk"]
    t = turns.withColumn("_chunk", F.shiftright(F.col("seq").cast("long"), bits))
    inside, ahead = Window.partitionBy(*chunk).orderBy("seq"), Window.partitionBy("path").orderBy("_chunk")
    before = ahead.rowsBetween(Window.unboundedPreceding, -1)

    ends = t.groupBy(*chunk).agg(F.max_by("speaker", "seq").alias("_end"))
    carried = ends.select(*chunk, F.last("_end").over(before).alias("_carried"))
    previous = F.coalesce(F.lag("speaker").over(inside), F.col("_carried"))
    marked = t.join(carried, chunk).withColumn(
        "_began", F.when(previous.isNull() | (previous != F.col("speaker")), F.col("seq"))
    )
    begun = marked.groupBy(*chunk).agg(F.max("_began").alias("_b"))
    open_turn = begun.select(*chunk, F.max("_b").over(before).alias("_open"))
    turn = marked.join(open_turn, chunk).withColumn(
        "_turn", F.coalesce(F.max("_began").over(inside), F.col("_open"))
    )
    return turn.groupBy("path", F.col("_turn").alias("seq")).agg(
        F.min_by("t", turn["seq"]).alias("t"), F.min_by("speaker", turn["seq"]).alias("speaker"),
        F.array_join(F.sort_array(F.collect_list(F.struct(turn["seq"], "text")))["text"], " ").alias("text"),
    )


def transcript_body(turns: DataFrame, kind: str = "interview") -> DataFrame:
    """Sources of merged turns: ``[m:ss] who: text`` with a blank line between.

    ``turns`` carries the transcript's ``pid``.  A transcript comes out of one file, so
    its turns fit one text again.
    """
    line = F.concat(
        F.lit("["), F.floor(F.col("t") / 60).cast("string"), F.lit(":"), F.lpad((F.col("t") % 60).cast("string"), 2, "0"),
        F.lit("] "), "speaker", F.lit(": "), "text",
    )
    body = turns.groupBy("path", "pid").agg(
        F.sort_array(F.collect_list(F.struct("seq", line.alias("line")))).alias("l"),
        F.count(F.lit(1)).alias("n"), F.max_by("t", "seq").alias("last"),
    )
    return body.select(
        F.concat(F.lit("I-"), padded("pid", 3)).alias("source_id"), "pid", F.lit("").alias("unit"),
        F.lit(kind).alias("kind"),
        F.concat(F.col("n").cast("string"), F.lit(" turns, "), F.floor(F.col("last") / 60).cast("string"), F.lit(" min")).alias("label"),
        F.array_join("l.line", "\n\n").alias("text"),
    )


def roster_link(transcripts: DataFrame, roster: DataFrame) -> DataFrame:
    """(path, pid, via, evidence): whose transcript it is, and the evidence.

    A shared student number decides, the first person in roster order.  Otherwise two
    or more shared name words do, if one person shares more than all others; people and
    transcripts meet on *pairs* of words, so a common first name joins nobody.
    ``transcripts``: path, folder, speakers, ids.  ``roster``: ord, pid, blob.
    """
    digits = F.regexp_replace("pid", r"\D", "")
    people = roster.where(F.coalesce("pid", F.lit("")) != "").select(
        "ord", F.coalesce(F.nullif(digits, F.lit("")), "pid").alias("pid"),
        _all(NAME_WORD, "blob").alias("words"), _all(STUDENT_ID, "blob").alias("p_ids"),
    )
    hay = F.concat_ws(" ", "path", "folder", F.concat_ws(" ", "speakers"))
    files = transcripts.select(
        "path", _all(NAME_WORD, hay).alias("hay"), F.transform("ids", lambda i: F.lower(i)).alias("t_ids")
    )

    by_id = (
        files.select("path", F.explode("t_ids").alias("id"))
        .join(people.select("ord", "pid", F.explode("p_ids").alias("id")), "id")
        .groupBy("path", "ord", "pid").agg(F.array_join(F.sort_array(F.collect_set("id")), ", ").alias("evidence"))
        .groupBy("path").agg(F.min(F.struct("ord", "pid", "evidence")).alias("n"))
    )

    vocabulary = people.select(F.explode("words").alias("word")).distinct()
    known = (
        files.select("path", F.explode("hay").alias("word")).join(vocabulary, "word", "left_semi")
        .groupBy("path").agg(F.sort_array(F.collect_set("word")).alias("words"))
    )
    pairs = lambda: F.flatten(
        F.transform(
            "_s", lambda a: F.transform(F.filter("_s", lambda b: a < b), lambda b: F.xxhash64(a, b))
        )
    )
    left = known.withColumn("_s", F.col("words")).select("path", F.col("words").alias("hay"), F.explode(pairs()).alias("k"))
    right = people.withColumn("_s", F.sort_array("words")).select("ord", "pid", "words", F.explode(pairs()).alias("k"))
    scored = (
        left.join(right, "k").select("path", "ord", "pid", F.array_sort(F.array_intersect("words", "hay")).alias("shared"))
        .distinct().withColumn("n", F.size("shared")).where("n >= 2")
    )
    best = scored.groupBy("path").agg(F.max("n").alias("n"))
    leading = scored.join(best, ["path", "n"]).groupBy("path").agg(
        F.count(F.lit(1)).alias("tied"), F.min(F.struct("ord", "pid", F.array_join("shared", ", ").alias("evidence"))).alias("w")
    ).where("tied = 1")
    return (
        files.select("path").join(by_id, "path", "left").join(leading, "path", "left")
        .select(
            "path",
            F.coalesce("n.pid", "w.pid", F.lit("")).alias("pid"),
            F.when(F.col("n").isNotNull(), "student number").when(F.col("w").isNotNull(), "name match")
            .otherwise("unmatched").alias("via"),
            F.coalesce("n.evidence", "w.evidence", F.lit("")).alias("evidence"),
        )
    )
