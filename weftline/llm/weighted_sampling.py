"""Document fingerprints by consistent weighted sampling, in DataFrame operations only.

A document is a bag of word shingles, weighted by how often each occurs.  For slot k a
shingle of weight w draws r and c from Gamma(2, 1) and b from the unit interval, all of
them functions of (shingle, k), and takes t = floor(ln w / r + b) and
ln a = ln c - r (t - b + 1).  The slot keeps (shingle, t) of the smallest a.  Two
documents agree in a slot with the probability sum of min(w) / sum of max(w) over all
shingles: their generalised Jaccard similarity.

A Gamma(2, 1) draw is minus the logarithm of a product of two uniform numbers, each of 53
bits of a hash of its own: the minimum over a long text lies in the tails of the draws,
so these are exact.  The smallest a and its sample travel in one integer: all slots are
plain minima of one hash aggregate.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import written

SLOTS = 32
SHINGLE = 5
#: Documents of 2**8 neighbouring ids meet in one task, blocks in groups of 2**12.
BLOCK_BITS, GROUP_BITS = 8, 12
NO_ID = -(1 << 63)


def uniform(k: int, draw: int) -> Column:
    """A number above 0 and up to 1, from 53 bits of a hash of the term."""
    bits = F.shiftrightunsigned(F.xxhash64("term", F.lit(5 * k + draw)), 11)
    return (bits.cast("double") + 0.5) / float(1 << 53)


def shingle_terms(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, term, ln_weight): the distinct shingles of every row's whole text.

    Words are runs without blanks, in small letters; fewer words than a shingle has are
    one term; a text without words has none.
    """
    words = texts.select(*keys, F.split(F.lower(F.trim(F.regexp_replace(text, r"\s+", " "))), " ").alias("words")).where(
        (F.size("words") > 1) | (F.col("words")[0] != "")
    )
    each = words.select(*keys, "words", F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - SHINGLE, F.lit(0)))).alias("i"))
    term = F.when(F.size("words") >= SHINGLE, F.xxhash64(*(F.get("words", F.col("i") + k) for k in range(SHINGLE)))).otherwise(F.xxhash64("words"))
    counted = each.select(*keys, term.alias("term")).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("weight"))
    return counted.select(*keys, "term", F.log(F.col("weight").cast("double")).alias("ln_weight"))


def slot_minima(terms: DataFrame, keys: list[str], slots: int = SLOTS) -> DataFrame:
    """(keys, samples): per key one 32-bit sample for each slot."""
    low = F.lit((1 << 32) - 1)

    def least(k: int) -> Column:
        r = -F.log(uniform(k, 0) * uniform(k, 1))
        ln_c = F.log(-F.log(uniform(k, 2) * uniform(k, 3)))
        b = uniform(k, 4)
        t = F.floor(F.col("ln_weight") / r + b)
        ln_a = ln_c - r * (t - b + 1)
        rank = F.floor((ln_a + 128.0) * float(1 << 22))
        sample = F.col("term").bitwiseXOR(F.shiftrightunsigned("term", 32)).bitwiseXOR(t * F.lit(0x9E3779B1)).bitwiseAND(low)
        return F.min(F.shiftleft(rank, 32).bitwiseOR(sample))

    found = terms.groupBy(*keys).agg(*(least(k).alias(f"s{k}") for k in range(slots)))
    return found.select(*keys, F.array(*(F.col(f"s{k}").bitwiseAND(low) for k in range(slots))).alias("samples"))


def likeness(a: Column, b: Column, slots: int = SLOTS) -> Column:
    """The share of slots in which two fingerprints agree."""
    same = reduce(lambda x, y: x + y, ((F.get(a, F.lit(k)) == F.get(b, F.lit(k))).cast("int") for k in range(slots)))
    return same / float(slots)


def as_text(samples: Column, slots: int = SLOTS) -> Column:
    return F.lower(F.concat(*(F.lpad(F.hex(F.get(samples, F.lit(k))), 8, "0") for k in range(slots))))


def fingerprint(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, samples) of every document of ``docs`` (doc_id, text); ids are unique here.

    A null, empty or blank text has all samples 0, which agree with each other.
    """
    rows = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = slot_minima(shingle_terms(rows, ["doc_id"], "text"), ["doc_id"], slots)
    empty = F.array_repeat(F.lit(0).cast("long"), slots)
    return rows.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("samples", empty).alias("samples"))


def block_followers(rows: DataFrame) -> DataFrame:
    """(block, follower): for each block of ids the first id behind it, after the last the first.

    Blocks are ordered within groups of 4,096 of them; a group's last takes the next
    group's first, and only one row for a million ids meets in one task.
    """
    blocks = rows.groupBy("block").agg(F.min("key").alias("first")).withColumn("over", F.shiftright("block", GROUP_BITS))
    blocks = written(blocks, "blocks")
    over = blocks.groupBy("over").agg(F.min("first").alias("over_first"))
    lead = F.coalesce(F.lead("over_first").over(Window.orderBy("over")), F.min("over_first").over(Window.orderBy("over")))
    over = over.select("over", lead.alias("over_next"))
    within = blocks.withColumn("inner", F.lead("first").over(Window.partitionBy("over").orderBy("block")))
    return within.join(over, "over").select("block", F.coalesce("inner", "over_next").alias("follower"))


def edited_fingerprints(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Each document's fingerprint beside those of an edited text and of the next document.

    ``docs`` (doc_id, text); a null text is empty.  In the edited text the last half of
    the code points gives way to as many (or all) first ones of the next document by
    doc_id; the last document is followed by the first.  Rows without an id come first,
    rows of one id follow each other by a hash of their text.

    Texts are shuffled once, by blocks of neighbouring ids; within a block the next text
    is the next row's, and only each block's follower is fetched by a join.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    key = F.coalesce("doc_id", F.lit(NO_ID))
    rows = rows.select(key.alias("key"), F.shiftright(key, BLOCK_BITS).alias("block"), "text")
    follower = block_followers(rows.select("key", "block"))
    behind = rows.select("key", "text").join(follower, F.col("key") == F.col("follower")).groupBy("block").agg(
        F.min_by("text", F.xxhash64("text")).alias("behind")
    )
    # A text becomes many terms: tasks are made smaller than the shuffle of texts would need.
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = Window.partitionBy("block").orderBy("key", "mix")
    dealt = rows.repartition(parts, "block").withColumn("mix", F.xxhash64("text"))
    placed = dealt.select("block", "key", "text", F.row_number().over(order).alias("n"), F.lead("text").over(order).alias("then"))
    open_end = F.col("then").isNull()
    placed = placed.join(behind, (placed["block"] == behind["block"]) & open_end, "left").select(
        placed["block"], "n", "key", "text", F.coalesce("then", "behind").alias("then"), open_end.alias("last")
    )
    n_chars = F.length("text")
    half = F.floor(n_chars / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n_chars - half), F.substring("then", F.lit(1), half))
    placed = placed.select("block", "n", "key", "text", "then", "last", edited.alias("edited"))

    keys = ["block", "n", "side"]
    sides = F.explode(F.filter(F.array(
        F.struct(F.lit(0).alias("side"), F.col("text").alias("whole")),
        F.struct(F.lit(1).alias("side"), F.col("edited").alias("whole")),
        F.struct(F.when(F.col("last"), 2).alias("side"), F.col("then").alias("whole")),
    ), lambda s: s["side"].isNotNull()))
    texts = placed.select("block", "n", sides.alias("s")).select("block", "n", "s.side", "s.whole")
    samples = slot_minima(shingle_terms(texts, keys, "whole"), keys, slots)
    pick = lambda side: F.any_value(F.when(F.col("side") == side, F.col("samples")), F.lit(True)).alias(f"f{side}")
    prints = samples.groupBy("block", "n").agg(pick(0), pick(1), pick(2))

    # Both readers of the dealt texts need the same columns of it, so it is shuffled once.
    doc_id = F.when(F.col("key") != NO_ID, F.col("key")).alias("doc_id")
    facts = placed.select("block", "n", doc_id, "last", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    empty = F.array_repeat(F.lit(0).cast("long"), slots)
    joined = facts.join(prints, ["block", "n"], "left").select(*facts.columns, *(F.coalesce(f"f{i}", empty).alias(f"f{i}") for i in range(3)))
    after = F.when(F.col("last"), F.col("f2")).otherwise(F.lead("f0").over(Window.partitionBy("block").orderBy("n")))
    out = joined.select("doc_id", "n_chars", "edited_sha256", "f0", "f1", after.alias("f_next"))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("f0"), slots).alias("fingerprint"), as_text(F.col("f1"), slots).alias("edited_fingerprint"),
        likeness(F.col("f0"), F.col("f1"), slots).alias("near_edited"), likeness(F.col("f0"), F.col("f_next"), slots).alias("near_next"),
    )
