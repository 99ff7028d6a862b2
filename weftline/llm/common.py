"""What the operators share: shared scratch tables, arrow batches, bounded labelled samples."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that go to Python at a time: texts are long, so far fewer than Spark's default.
BATCH_ROWS = 256


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; an own one only on a single machine."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own for a table, in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: the plan above starts there."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow over small batches, since what is made of a batch of long texts has to fit into memory.

    Spark's own batches are bounded by bytes; they are cut here, the session's settings stay.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                yield batch.slice(at, BATCH_ROWS)

    return df.mapInArrow(lambda batches: work(cut(batches)), schema)


def set_aside(df: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with columns of these names renamed, and what gives a result its columns back."""
    other = {c: f"_own_{c}" if c in names else c for c in df.columns}
    return df.withColumnsRenamed(other), lambda out: out.select(*(F.col(n).alias(c) for c, n in other.items()))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out() -> Column:
    """The fold that no model learns from: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


#: Characters of a sample for the driver, whatever the number of labels.
SAMPLE_CHARS = 150_000_000


def labelled_sample(rows: DataFrame, label: str, text: str, per_label: int, most_labels: int, longest: int, labels: DataFrame | None = None):
    """A bounded sample of labelled whole texts, spread over the labels, for the driver.

    ``rows`` has (doc_id, text) and the label, or else ``labels`` has (doc_id, label).  At most
    ``most_labels`` labels (the most frequent) with about ``per_label`` rows each are taken, in
    the order of a hash of the text and id, so that the same table gives the same sample, and
    no more than ``SAMPLE_CHARS`` characters in all.  Texts of more than ``longest`` characters
    are not learned from.  Rows are drawn by hashes and lengths alone; only the texts drawn are
    fetched, by a broadcast of their ids.  Returns pandas rows (label, text, weight), where
    weight is what a row stands for.
    """
    spark = rows.sparkSession
    rows = rows.where(F.col(text).isNotNull() & (F.length(text) <= longest))
    hashed = F.xxhash64(F.col("doc_id"), F.col(text))
    if labels is None:
        light = rows.select("doc_id", F.col(label).alias("label"), hashed.alias("_h"), F.length(text).alias("_n"))
    else:
        own = labels.select("doc_id", F.col(label).alias("label"))
        light = rows.select("doc_id", hashed.alias("_h"), F.length(text).alias("_n")).join(own, "doc_id")
    light = light.where("label is not null")
    counts = light.groupBy("label").count().orderBy(F.desc("count"), "label").limit(most_labels).collect()
    if not counts:
        return light.select("label", F.lit("").alias("text"), F.lit(1.0).alias("weight")).limit(0).toPandas()
    share = {r[0]: min(1.0, per_label / r["count"]) for r in counts}
    wanted = F.lit(0.0)
    for value, p in share.items():
        wanted = F.when(F.col("label") == F.lit(value), F.lit(p)).otherwise(wanted)
    at = F.col("_h").bitwiseAND(F.lit((1 << 30) - 1)) / float(1 << 30)
    drawn = light.withColumn("_at", at).where(F.col("_at") < wanted).select("doc_id", "_h", "label", F.when(wanted > 0, 1.0 / F.nullif(wanted, F.lit(0.0))).alias("weight"), "_at", "_n").distinct()
    most, room, picked = int(1.5 * per_label * len(share)) + 100, SAMPLE_CHARS, []
    for row in drawn.orderBy("_at", "doc_id", "_h").limit(most).collect():
        room -= row["_n"]
        if room < 0:
            break
        picked.append(row)
    ids = spark.createDataFrame(picked, drawn.schema).withColumnRenamed("doc_id", "_id").drop("_n")
    texts = rows.select("doc_id", F.col(text).alias("text"), hashed.alias("_h")).join(F.broadcast(ids), "_h").where(F.col("doc_id").eqNullSafe(F.col("_id")))
    return texts.select("label", "text", "weight", "_at", "doc_id").toPandas().sort_values(["_at", "doc_id", "text"]).drop(columns=["_at", "doc_id"]).reset_index(drop=True)
