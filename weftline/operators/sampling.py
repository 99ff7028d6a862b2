"""A reproducible sample: proportional by kind, spread over participants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import word_count
from weftline.operators.ordered import row_numbers

USABLE_WORDS = 12


def usable_sources(df: DataFrame, min_words: int = USABLE_WORDS) -> DataFrame:
    """Sources long enough to read."""
    return df.where(word_count("text") >= min_words)


def restrict_kind(df: DataFrame, kind: str) -> DataFrame:
    return df.where(F.col("kind") == kind)


def restrict_pids(df: DataFrame, pids) -> DataFrame:
    """Keep listed participants, from a list or from a table with a pid column."""
    if isinstance(pids, DataFrame):
        column = next((c for c in pids.columns if c.lower() == "pid"), None)
        if column is None:
            raise ValueError("no pid column")
        listed = pids.select(F.trim(F.col(column)).alias("pid")).where("pid <> ''").distinct()
        return df.join(listed, "pid", "left_semi")
    return df.where(F.col("pid").isin([p.strip() for p in pids if p.strip()]))


def sample_quota(sources: DataFrame, pct: float = 10.0, n: int | None = None) -> DataFrame:
    """(kind, in_kind, want): how many sources each kind contributes."""
    usable = usable_sources(sources)
    size = usable.groupBy("kind").agg(F.count(F.lit(1)).alias("in_kind"))
    if n:
        share = F.lit(float(n)) * F.col("in_kind") / usable.agg(F.count(F.lit(1))).scalar()
        want = F.greatest(F.lit(1), F.bround(share).cast("long"))
    elif pct > 0:
        want = F.greatest(F.lit(1), F.bround(F.col("in_kind") * pct / 100).cast("long"))
    else:
        want = F.lit(0).cast("long")
    return size.select("kind", "in_kind", F.least("in_kind", want).alias("want"))


def stratified_draw(
    sources: DataFrame, pct: float = 10.0, n: int | None = None, seed: int = 1, limit: int | None = None
) -> DataFrame:
    """Drawn sources with the round they were drawn in.

    Taking turns by participant is the order (round, pid), where the round is a
    source's place among its participant's sources in a seeded hash order.  Both
    places are computed so that one talkative participant or one large kind does not
    have to fit a task.
    """
    more = {} if limit is None else {"limit": limit}
    slim = usable_sources(sources).select(
        "source_id", "kind", "pid", F.md5(F.concat_ws("|", F.lit(str(seed)), "source_id")).alias("_h")
    )
    turns = row_numbers(slim, ["kind", "pid"], ["_h", "source_id"], "round", **more)
    quota = sample_quota(sources, pct, n).select("kind", "want")
    early = turns.join(quota, "kind").where(F.col("round") <= F.col("want"))
    placed = row_numbers(early, ["kind"], ["round", "pid"], "_at", **more)
    picked = placed.where(F.col("_at") <= F.col("want")).select("source_id", "round")
    return sources.join(picked, "source_id")


def sample_report(sample: DataFrame) -> DataFrame:
    """(kind, n, words, participants) of a sample."""
    return sample.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.sum(word_count("text")).alias("words"),
        F.count_distinct("pid").alias("participants"),
    )
