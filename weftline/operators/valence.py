"""Valence of codings nobody has judged: requests, replies and reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import strip
from weftline.functions.values import pct
from weftline.operators.ordered import row_numbers
from weftline.project import Project, blank
from weftline.schema import VALENCES

REPLY = "judgements ARRAY<STRUCT<id: STRING, valence: STRING, why: STRING>>"


def valence_targets(project: Project) -> DataFrame:
    """Unjudged codings with their passage and what the codebook says about the code."""
    text = project.excerpts.select("excerpt_id", strip(F.coalesce("text", F.lit(""))).alias("text"))
    code = project.codes.groupBy("code_id").agg(
        F.max(F.struct("valence", "name", "definition")).alias("c")
    )
    extra = [c for c in ("coder", "ord") if c in project.codings.columns]
    return (
        project.codings.where(blank("valence"))
        .select("excerpt_id", "code_id", strip(F.coalesce("note", F.lit(""))).alias("note"), *extra)
        .join(text.where("text <> ''"), "excerpt_id")
        .join(code, "code_id", "left")
        .select(
            "excerpt_id", "code_id",
            F.lower(strip(F.coalesce("c.valence", F.lit("")))).alias("code_valence"),
            F.coalesce("c.name", F.lit("")).alias("name"),
            F.coalesce("c.definition", F.lit("")).alias("definition"),
            "text", "note", *extra,
        )
    )


def valence_cache_skip(targets: DataFrame, cache: DataFrame) -> DataFrame:
    """Targets without an earlier judgement."""
    judged = cache.where(~blank("model_valence")).select("excerpt_id", "code_id").distinct()
    return targets.join(judged, ["excerpt_id", "code_id"], "left_anti")


def batched(targets: DataFrame, n: int = 25, order: tuple[str, ...] = ("ord",)) -> DataFrame:
    """Append ``batch`` and the anonymous ``id`` of an item in its batch."""
    at = row_numbers(targets.withColumn("_all", F.lit(0)), ["_all"], list(order), "_rn").drop("_all")
    return (
        at.withColumn("batch", F.floor((F.col("_rn") - 1) / n).cast("long"))
        .withColumn("id", F.concat(F.lit("i"), ((F.col("_rn") - 1) % n).cast("string")))
        .drop("_rn")
    )


def valence_payload(targets: DataFrame, n: int = 25, order: tuple[str, ...] = ("ord",)) -> DataFrame:
    """(batch, id, json): what may be sent, with nothing that identifies anyone."""
    return batched(targets, n, order).select(
        "batch", "id",
        F.to_json(
            F.struct(
                "id", F.col("code_id").alias("code"), F.col("name").alias("code_name"),
                F.col("definition").alias("code_definition"), F.col("text").alias("passage"),
                F.nullif("note", F.lit("")).alias("coder_note"),
            )
        ).alias("json"),
    )


def judgement_join(
    targets: DataFrame, replies: DataFrame, n: int = 25, order: tuple[str, ...] = ("ord",)
) -> DataFrame:
    """(excerpt_id, code_id, valence, why) from reply texts keyed by batch."""
    told = replies.select("batch", F.posexplode(F.from_json("reply", REPLY)["judgements"]).alias("pos", "j")).select(
        "batch", "pos", F.col("j.id").alias("id"),
        F.lower(strip("j.valence")).alias("valence"),
        F.coalesce("j.why", F.lit("")).alias("why"),
    ).where(F.col("valence").isin(*VALENCES))
    return (
        batched(targets, n, order).select("batch", "id", "excerpt_id", "code_id")
        .join(told, ["batch", "id"])
        .groupBy("excerpt_id", "code_id")
        .agg(F.max_by(F.struct("valence", "why"), F.struct("batch", "pos")).alias("j"))
        .select("excerpt_id", "code_id", "j.valence", "j.why")
    )


def valence_settle(targets: DataFrame, judgements: DataFrame) -> DataFrame:
    """Append model_valence, why, agreement and the value that stands."""
    j = judgements.select("excerpt_id", "code_id", F.col("valence").alias("model_valence"), "why")
    t = targets.join(j, ["excerpt_id", "code_id"], "left").withColumn(
        "model_valence", F.coalesce("model_valence", F.lit(""))
    ).withColumn("why", F.coalesce("why", F.lit("")))
    c, m = F.col("code_valence"), F.col("model_valence")
    return t.withColumn(
        "agreement",
        F.when((c != "") & (m != "") & (c == m), F.lit("agree"))
        .when((c != "") & (m != ""), F.lit("disagree"))
        .when(m != "", F.lit("model only"))
        .when(c != "", F.lit("code only"))
        .otherwise(F.lit("no opinion")),
    ).withColumn(
        "settled",
        F.when(F.col("agreement") == "disagree", F.lit("")).otherwise(F.coalesce(F.nullif(m, F.lit("")), c)),
    )


def valence_agreement_rate(settled: DataFrame) -> DataFrame:
    """(agreement, n, rate): tally, and agreement where both had a view."""
    tally = settled.groupBy("agreement").agg(F.count(F.lit(1)).alias("n"))
    both = settled.agg(
        F.struct(
            F.count_if(F.col("agreement") == "agree").alias("agree"),
            F.count_if(F.col("agreement").isin("agree", "disagree")).alias("both"),
        )
    ).scalar()
    return tally.withColumn("b", both).select("agreement", "n", pct(F.col("b.agree"), F.col("b.both"), 0).alias("rate"))


def valence_apply(project: Project, settled: DataFrame) -> DataFrame:
    """Codings with blanks filled from settled judgements; judged ones untouched."""
    stands = settled.where("settled <> ''").groupBy("excerpt_id", "code_id").agg(F.max("settled").alias("_s"))
    filled = project.codings.join(stands, ["excerpt_id", "code_id"], "left").withColumn(
        "valence", F.when(blank("valence"), F.coalesce("_s", "valence")).otherwise(F.col("valence"))
    )
    return filled.select(*project.codings.columns)
