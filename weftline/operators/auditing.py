"""Integrity checks and agreement between coders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import strip, word_count
from weftline.functions.values import kappa, kappa_band, pct
from weftline.operators.ordered import checkpointed, global_ordinal
from weftline.operators.segments import text_sizes, with_cut
from weftline.operators.statistics import codings_excerpts, in_frame
from weftline.project import Project, blank, keys, union_all

UNNAMED = "(unnamed)"
DOMINANT = 25


# ---------------------------------------------------------------- corpus


def corpus_summary(project: Project) -> DataFrame:
    """(kind, sources, words, median_words); the median is the upper one.

    Word counts are first folded into a histogram, whose size is bounded by the
    longest text, so the median needs no sort of a whole kind.
    """
    sized = project.sources.select(F.coalesce("kind", F.lit("")).alias("kind"), word_count("text").alias("w"))
    hist = sized.groupBy("kind", "w").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("kind")
    upto = w.orderBy("w").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = hist.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(w))
    return placed.groupBy("kind").agg(
        F.sum("n").alias("sources"),
        F.sum(F.col("n") * F.col("w")).alias("words"),
        F.min(F.when(F.col("upto") > F.floor(F.col("all") / 2), F.col("w"))).alias("median_words"),
    )


def blank_text(project: Project) -> DataFrame:
    """(source_id, words, class): sources with no text, and with one or two words."""
    sized = project.sources.select("source_id", word_count("text").alias("words"))
    return sized.where("words < 3").withColumn(
        "class", F.when(F.col("words") == 0, F.lit("empty")).otherwise(F.lit("tiny"))
    )


def frame_without_source(project: Project) -> DataFrame:
    """Frame keys nobody said anything about."""
    return keys(project.frame).join(keys(project.sources), ["pid", "unit"], "left_anti")


def source_outside_frame(project: Project) -> DataFrame:
    """(pid, unit, n, class) of source keys that are not in the frame."""
    counted = project.sources.groupBy("pid", "unit").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(keys(project.frame), ["pid", "unit"], "left_anti").withColumn(
        "class", F.when(F.col("unit") == "", F.lit("unitless")).otherwise(F.lit("real"))
    )


def _held_against_source(project: Project) -> DataFrame:
    x = project.excerpts.select("excerpt_id", "source_id", "start", "end", F.coalesce("text", F.lit("")).alias("_held"))
    x = with_cut(x, project.sources, name="_now").join(text_sizes(project.sources), "source_id", "left")
    inside = (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.col("size"))
    return x.withColumn(
        "status",
        F.when(F.col("size").isNull(), F.lit("missing"))
        .when(~F.coalesce(inside, F.lit(False)), F.lit("out_of_bounds"))
        .when(~blank("_held") & (F.col("_now") != F.col("_held")), F.lit("drift"))
        .otherwise(F.lit("ok")),
    )


def excerpts_sources(project: Project) -> DataFrame:
    """(excerpt_id, status): ok, missing, out_of_bounds (a null offset too) or drift.

    Sources are met by their sizes and by the segments that excerpts touch, never whole.
    """
    return _held_against_source(project).select("excerpt_id", "status")


def duplicate_passages(project: Project) -> DataFrame:
    """(text, n): passages coded more than once as separate excerpts."""
    text = F.lower(strip(F.coalesce("text", F.lit(""))))
    return (
        project.excerpts.select(text.alias("text")).where("text <> ''")
        .groupBy("text").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    )


# ---------------------------------------------------------------- codebook and coverage


def orphan_codes(project: Project) -> DataFrame:
    """(code_id, n): codes in use that are neither in the codebook nor retired."""
    used = project.codings.groupBy("code_id").agg(F.count(F.lit(1)).alias("n"))
    lost = used.join(project.codes.select("code_id"), "code_id", "left_anti")
    if project.retired is None:
        return lost
    return lost.join(project.retired.select(F.col("old_id").alias("code_id")), "code_id", "left_anti")


def unused_codes(project: Project) -> DataFrame:
    """Codebook codes with no coding."""
    used = project.codings.select("code_id").distinct()
    return project.codes.select("code_id").distinct().join(used, "code_id", "left_anti")


def no_lens_codes(project: Project) -> DataFrame:
    """Codes that will group under no lens."""
    return project.codes.where(blank("lens")).select("code_id")


def _per_pid(project: Project) -> DataFrame:
    return codings_excerpts(project).groupBy("pid").agg(F.count(F.lit(1)).alias("n"))


def silent_participants(project: Project) -> DataFrame:
    """Participants with sources and no codings."""
    return project.sources.select("pid").distinct().join(_per_pid(project), "pid", "left_anti")


def coverage(project: Project) -> DataFrame:
    """One row: frame keys and participants, and how many of each are touched."""
    one = lambda df, c: df.agg(c).scalar()
    touched = in_frame(project).agg(F.count_distinct("pid", "unit").alias("units_coded"))
    return touched.withColumn("units", one(keys(project.frame), F.count(F.lit(1)))).select(
        "units", "units_coded", pct(F.col("units_coded"), F.col("units"), 0).alias("pct"),
        one(project.sources, F.count_distinct("pid")).alias("participants"),
        one(_per_pid(project), F.count(F.lit(1))).alias("participants_quoted"),
    )


def dominance(project: Project) -> DataFrame:
    """The participant with most codings, their share and whether it is over a quarter."""
    total = project.codings.agg(F.count(F.lit(1))).scalar()
    share = F.lit(100.0) * F.col("n") / F.col("total")
    return (
        _per_pid(project).orderBy(F.desc("n"), "pid").limit(1).withColumn("total", total)
        .select("pid", "n", F.bround(share, 1).alias("share"), (share > DOMINANT).alias("flag"))
    )


#: Check -> severity, in the order of a report.
CHECKS = {
    "empty_sources": "problem",
    "tiny_sources": "note",
    "frame_without_source": "problem",
    "source_outside_frame": "problem",
    "missing_source": "problem",
    "out_of_bounds": "problem",
    "drift": "problem",
    "duplicate_passages": "note",
    "orphan_codes": "problem",
    "unused_codes": "note",
    "no_lens_codes": "note",
    "silent_participants": "note",
    "dominant_participant": "note",
}

# what a table says about a key
IN_FRAME, IN_SOURCES, CODED, USED, IN_BOOK, RETIRED = 1, 2, 4, 8, 16, 32
BUCKETS = 256


def _fact(kind, a, b="", flag: int = 0, when=None):
    """One statement of a row: ``kind`` tells what ``a`` and ``b`` are a key of; null unless ``when``."""
    lit = lambda v: F.lit(v) if v == "" else F.col(v) if isinstance(v, str) else v
    fact = F.struct(
        (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), lit(a).alias("a"), lit(b).alias("b"), F.lit(flag).alias("flag")
    )
    return fact if when is None else F.when(when, fact)


def _facts(df: DataFrame, *facts) -> DataFrame:
    """The statements of every row, in one pass over the table."""
    return df.select(F.explode(F.array_compact(F.array(*facts))).alias("f")).select("f.*")


def _all_facts(project: Project) -> list[DataFrame]:
    words, passage = word_count("text"), F.lower(strip("_held"))
    small = F.when(words == 0, F.lit("empty_sources")).otherwise(F.lit("tiny_sources"))
    same = Window.partitionBy("excerpt_id").orderBy("pid")
    placed = project.excerpts.select("excerpt_id", "pid", F.row_number().over(same).alias("_n"))
    coded = project.codings.select("excerpt_id", "code_id").join(placed, "excerpt_id", "left")
    once = F.coalesce(F.col("_n") == 1, F.lit(True))  # a coding of an excerpt id that stands twice is one coding
    kind = F.when(F.col("status") == "missing", F.lit("missing_source")).otherwise(F.col("status"))
    facts = [
        _facts(
            project.sources.select("source_id", "pid", "unit", "text"),
            _fact("key", "pid", "unit", IN_SOURCES), _fact("pid", "pid", flag=IN_SOURCES), _fact(small, "source_id", when=words < 3),
        ),
        _facts(project.frame, _fact("key", "pid", "unit", IN_FRAME)),
        _facts(
            _held_against_source(project).withColumn("passage", passage),
            _fact(kind, "excerpt_id", when=F.col("status") != "ok"), _fact("passage", "passage", when=F.col("passage") != ""),
        ),
        _facts(project.codes, _fact("code", "code_id", flag=IN_BOOK), _fact("no_lens_codes", "code_id", when=blank("lens"))),
        _facts(
            coded, _fact("code", "code_id", flag=USED, when=once), _fact("codings", "", when=once),
            _fact("pid", "pid", flag=CODED, when=F.col("_n").isNotNull()),
        ),
    ]
    if project.retired is not None:
        facts.append(_facts(project.retired, _fact("code", "old_id", flag=RETIRED)))
    return facts


def audit_report(project: Project, k: int = 5) -> DataFrame:
    """(check, severity, n, examples): every check that found something.

    Each table states once what it knows about its keys, one aggregate puts the statements
    of a key together, and what is wrong with it are its items.  Items are counted and their
    first ``k`` found in hashed buckets of each check, so that no task holds a whole check.
    Rows that repeat one source, code or excerpt id count one by one and are one example.
    """
    has = lambda flag: F.col("flags").bitwiseAND(F.lit(flag)) != 0
    known = union_all(_all_facts(project)).groupBy("kind", "a", "b").agg(
        F.bit_or("flag").alias("flags"), F.count(F.lit(1)).alias("rows"), F.sum(F.when(F.col("flag") == CODED, 1)).alias("codings")
    )
    kind, slashed = F.col("kind"), F.concat_ws("/", "a", "b")
    issue = lambda when, check, item, n=F.lit(1).cast("long"), total=F.lit(None).cast("long"): F.when(
        when, F.struct(F.lit(check).alias("check"), item.alias("item"), n.alias("n"), total.alias("total"))
    )
    item, key, pid, code = F.col("a"), kind == "key", kind == "pid", kind == "code"
    direct = ("empty_sources", "tiny_sources", "missing_source", "out_of_bounds", "drift", "no_lens_codes")
    issues = [issue(kind == check, check, item, F.col("rows")) for check in direct] + [
        issue(key & has(IN_FRAME) & ~has(IN_SOURCES), "frame_without_source", slashed),
        issue(key & has(IN_SOURCES) & ~has(IN_FRAME) & (F.col("b") != ""), "source_outside_frame", slashed),
        issue((kind == "passage") & (F.col("rows") > 1), "duplicate_passages", item),
        issue(code & has(USED) & ~has(IN_BOOK) & ~has(RETIRED), "orphan_codes", item),
        issue(code & has(IN_BOOK) & ~has(USED), "unused_codes", item),
        issue(pid & has(IN_SOURCES) & ~has(CODED), "silent_participants", item),
        issue(pid & has(CODED), "dominant_participant", item, F.col("codings")),
        issue(kind == "codings", "dominant_participant", F.lit(None).cast("string"), F.lit(0).cast("long"), F.col("rows")),
    ]
    found = known.select(F.explode(F.array_compact(F.array(*issues))).alias("i")).select("i.*")

    most = F.col("check") == "dominant_participant"
    bucket = ["check", "bucket"]
    # the first of a check are the least items; of the participants those with most codings, behind the total
    first = Window.partitionBy(*bucket).orderBy(
        F.when(most, -F.coalesce("total", "n")).otherwise(F.lit(0)), "item"
    )
    ranked = (
        found.withColumn("bucket", F.pmod(F.xxhash64("item"), F.lit(BUCKETS)))
        .withColumn("r", F.row_number().over(first))
        .withColumn("many", F.sum("n").over(Window.partitionBy(*bucket)))
        .where(F.col("r") <= k + 1)
    )
    per_check = ranked.groupBy("check").agg(
        F.sum(F.when(F.col("r") == 1, F.col("many"))).alias("n"), F.max("total").alias("total"),
        F.sort_array(F.collect_list("item")).alias("items"),
        F.max("n").alias("top"), F.min_by("item", F.when(F.col("item").isNotNull(), F.struct(-F.col("n"), F.col("item")))).alias("top_item"),
    )
    flagged = F.lit(100.0) * F.col("top") / F.col("total") > DOMINANT
    severity = F.create_map(*[F.lit(x) for pair in CHECKS.items() for x in pair])
    return per_check.where(~most | flagged).select(
        "check", severity[F.col("check")].alias("severity"),
        F.when(most, F.lit(1).cast("long")).otherwise(F.col("n")).alias("n"),
        F.when(most, F.array("top_item")).otherwise(F.slice("items", 1, k)).alias("examples"),
    )


# ---------------------------------------------------------------- reliability


def _named(project: Project) -> DataFrame:
    who = strip(F.coalesce("coder", F.lit("")))
    return project.codings.withColumn("coder", F.when(who == "", F.lit(UNNAMED)).otherwise(who))


def compared_coders(project: Project, other: str | None = None) -> tuple[str, str]:
    """The two coders a comparison is about: the first by name against the next or ``other``."""
    names = [r[0] for r in _named(project).select("coder").distinct().orderBy("coder").limit(2).collect()]
    if other is None:
        if len(names) < 2:
            raise ValueError("a comparison needs two coders")
        return names[0], names[1]
    first = [n for n in names if n != other]
    if not first:
        raise ValueError("a comparison needs two coders")
    return first[0], other


def _flags(project: Project, a: str, b: str) -> DataFrame:
    """(excerpt_id, code_id, a, b): who put the code on the excerpt."""
    return (
        _named(project).where(F.col("coder").isin(a, b))
        .groupBy("excerpt_id", "code_id")
        .agg(F.bool_or(F.col("coder") == a).alias("a"), F.bool_or(F.col("coder") == b).alias("b"))
    )


def _touched(flags: DataFrame) -> DataFrame:
    return flags.groupBy("excerpt_id").agg(
        F.bool_or("a").alias("by_a"), F.bool_or("b").alias("by_b"),
        F.bool_and(F.col("a") == F.col("b")).alias("same"),
    )


def overlap_sets(project: Project, a: str, b: str) -> DataFrame:
    """One row: excerpts coded by both, by the first only, by the second only."""
    return _touched(_flags(project, a, b)).agg(
        F.count_if(F.col("by_a") & F.col("by_b")).alias("both"),
        F.count_if(~F.col("by_b")).alias("only_a"),
        F.count_if(~F.col("by_a")).alias("only_b"),
    )


def set_operations(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """(which, n): how many distinct keys ``on`` are in both, in ``left`` only and in ``right`` only.

    One aggregate over both; null keys are equal.  Always three rows.
    """
    side = lambda df, bit: df.select(*on, F.lit(bit).alias("_in"))
    each = side(left, 1).unionByName(side(right, 2)).groupBy(*on).agg(F.bit_or("_in").alias("_in"))
    names = {"both": 3, "only_a": 1, "only_b": 2}
    counts = each.agg(*[F.count_if(F.col("_in") == bit).alias(n) for n, bit in names.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("which"), F.col(n).alias("n")) for n in names])).alias("s")).select("s.*")


def coder_pairs(project: Project) -> DataFrame:
    """(coder_a, coder_b, code_id, both, only_a, only_b, neither, agree, kappa, band) of all pairs of coders.

    As ``kappa_by_code``, for every two coders, in name order, that touched a common excerpt.
    An excerpt is reduced to who touched it and, per code, who put it there.  Equal
    combinations are counted before pairs are formed, so pairs cost by the number of
    different combinations and not by excerpts.
    """
    marks = F.array_sort(F.collect_set(F.struct("code_id", "coder")))
    per = _named(project).groupBy("excerpt_id").agg(marks.alias("_m"), F.array_sort(F.collect_set("coder")).alias("who")).where("size(who) > 1")
    names = lambda code: F.transform(F.filter("_m", lambda m: m["code_id"].eqNullSafe(code)), lambda m: m["coder"])
    put = F.transform(F.array_distinct(F.col("_m.code_id")), lambda c: F.struct(c.alias("code_id"), names(c).alias("by")))
    pair = F.explode(
        F.flatten(F.transform("who", lambda a: F.transform(F.filter("who", lambda b: b > a), lambda b: F.struct(a.alias("coder_a"), b.alias("coder_b")))))
    ).alias("p")
    two = ["coder_a", "coder_b"]
    shared = per.groupBy("who").agg(F.count(F.lit(1)).alias("n")).select(pair, "n").groupBy("p.coder_a", "p.coder_b").agg(F.sum("n").alias("shared"))
    words = per.select("who", F.explode(put).alias("c")).groupBy("who", "c.code_id", "c.by").agg(F.count(F.lit(1)).alias("n"))
    a, b = F.array_contains("by", F.col("p.coder_a")), F.array_contains("by", F.col("p.coder_b"))
    sum_if = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0).cast("long"))
    tally = words.select(pair, "code_id", "by", "n").where(a | b).groupBy(F.col("p.coder_a"), F.col("p.coder_b"), "code_id").agg(
        sum_if(a & b).alias("both"), sum_if(a & ~b).alias("only_a"), sum_if(~a & b).alias("only_b")
    )
    full = tally.join(shared, two).withColumn("neither", F.col("shared") - F.col("both") - F.col("only_a") - F.col("only_b"))
    k = kappa(F.col("both"), F.col("only_a"), F.col("only_b"), F.col("neither"))
    return full.withColumn("kappa", k).select(
        *two, "code_id", "both", "only_a", "only_b", "neither",
        ((F.col("both") + F.col("neither")) / F.col("shared")).alias("agree"), "kappa", kappa_band(F.col("kappa")).alias("band"),
    )


def kappa_order(kappas: DataFrame) -> DataFrame:
    """``kappas`` with ``place``: lowest agreement first, undefined last, ties by code."""
    # one row a code; numbering looks at its input more than once
    keyed = checkpointed(kappas.withColumn("_none", F.col("kappa").isNull()))
    return global_ordinal(keyed, ["_none", "kappa", "code_id"]).drop("_none")


def kappa_by_code(project: Project, a: str, b: str) -> DataFrame:
    """Agreement per code over the excerpts both coders touched.

    Only present codes are rows; the absent cell is what the shared total leaves.
    """
    flags = _flags(project, a, b)
    shared = _touched(flags).where("by_a and by_b").select("excerpt_id")
    n = shared.agg(F.count(F.lit(1))).scalar()
    tally = flags.join(shared, "excerpt_id", "left_semi").groupBy("code_id").agg(
        F.count_if(F.col("a") & F.col("b")).alias("both"),
        F.count_if(F.col("a") & ~F.col("b")).alias("only_a"),
        F.count_if(~F.col("a") & F.col("b")).alias("only_b"),
    )
    full = tally.withColumn("shared", n).withColumn(
        "neither", F.col("shared") - F.col("both") - F.col("only_a") - F.col("only_b")
    )
    k = kappa(F.col("both"), F.col("only_a"), F.col("only_b"), F.col("neither"))
    return (
        full.withColumn("kappa", k)
        .select(
            "code_id", "both", "only_a", "only_b", "neither",
            ((F.col("both") + F.col("neither")) / F.col("shared")).alias("agree"),
            "kappa", kappa_band(F.col("kappa")).alias("band"),
        )
        .orderBy(F.asc_nulls_last("kappa"), "code_id")
    )


def reliability_overall(project: Project, a: str, b: str) -> DataFrame:
    """One row: shared excerpts, exactly agreeing ones, mean kappa, lowest code."""
    touched = _touched(_flags(project, a, b)).where("by_a and by_b")
    exact = touched.agg(F.count_if("same")).scalar()
    shared = touched.agg(F.count(F.lit(1))).scalar()
    per_code = kappa_by_code(project, a, b)
    defined = F.col("kappa").isNotNull()
    return per_code.agg(
        F.count_if(defined).alias("codes"),
        F.avg("kappa").alias("mean_kappa"),
        F.min_by("code_id", F.when(defined, F.struct("kappa", "code_id"))).alias("lowest_code"),
        F.min("kappa").alias("lowest_kappa"),
    ).select(
        shared.alias("shared"), exact.alias("exact"), "codes", "mean_kappa",
        kappa_band(F.col("mean_kappa")).alias("band"), "lowest_code", "lowest_kappa",
    )


def reconcile_list(project: Project, a: str, b: str) -> DataFrame:
    """(excerpt_id, a_only, b_only, text) of shared excerpts whose codes differ."""
    per = _flags(project, a, b).groupBy("excerpt_id").agg(
        F.bool_or("a").alias("by_a"), F.bool_or("b").alias("by_b"),
        F.sort_array(F.collect_list(F.when(F.col("a") & ~F.col("b"), F.col("code_id")))).alias("a_only"),
        F.sort_array(F.collect_list(F.when(~F.col("a") & F.col("b"), F.col("code_id")))).alias("b_only"),
    )
    differ = per.where("by_a and by_b and (size(a_only) > 0 or size(b_only) > 0)")
    if "text" in project.excerpts.columns:
        text = project.excerpts.select("excerpt_id", strip(F.coalesce("text", F.lit(""))).alias("text"))
        differ = differ.join(text, "excerpt_id", "left")
    else:
        differ = differ.withColumn("text", F.lit(""))
    return differ.select("excerpt_id", "a_only", "b_only", F.coalesce("text", F.lit("")).alias("text"))


def valence_agreement(
    project: Project, a: str, b: str, order: tuple[str, ...] = ("ord",)
) -> DataFrame:
    """One row: (excerpt, code) pairs judged by both, and how many were judged alike."""
    v = strip(F.coalesce("valence", F.lit("")))
    judged = _named(project).withColumn("valence", v).where("valence <> ''").where(F.col("coder").isin(a, b))
    last = lambda who: F.max_by("valence", F.when(F.col("coder") == who, F.struct(*order)))
    pairs = judged.groupBy("excerpt_id", "code_id").agg(last(a).alias("va"), last(b).alias("vb"))
    both = pairs.where("va is not null and vb is not null")
    return both.agg(
        F.count_if(F.col("va") == F.col("vb")).alias("same"), F.count(F.lit(1)).alias("pairs")
    ).select("same", "pairs", pct(F.col("same"), F.col("pairs"), 0).alias("share"))
