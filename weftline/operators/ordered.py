"""Ordinals and running sums that survive a hot group.

``row_number() over (partition by g order by o)`` sorts a whole group in one task.
When one group can hold a third of the data that task never finishes, so a group
above ``limit`` rows is cut into ranges of the order key, numbered range by range,
and lifted by the size of the ranges in front of it.  The cut is written to the
checkpoint folder first, so a lost executor cannot renumber it.  Results are equal
on both routes as long as ``order`` is a total order.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GROUP_LIMIT = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder; an own one only on a single machine where none is named."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage in the cluster's checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def largest_group(df: DataFrame, within: list[str]) -> int:
    """Rows of the biggest group; map-side combined, one number to the driver."""
    return df.groupBy(*within).count().agg(F.max("count")).first()[0] or 0


def _sorts(order) -> list[Column]:
    return [F.col(o).asc() if isinstance(o, str) else o for o in order]


def _ranged(df: DataFrame, within: list[str], sorts: list[Column]) -> DataFrame:
    cut = df.repartitionByRange(*[F.col(c).asc() for c in within], *sorts)
    return checkpointed(cut.withColumn("_range", F.spark_partition_id()))


def row_numbers(
    df: DataFrame, within: list[str], order: list, name: str = "ord", limit: int = GROUP_LIMIT
) -> DataFrame:
    """Append the 1-based position of every row in its group."""
    return running_sums(df, within, order, F.lit(1), name, inclusive=True, limit=limit)


def running_sums(
    df: DataFrame,
    within: list[str],
    order: list,
    value: Column,
    name: str,
    inclusive: bool = False,
    limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Append the sum of ``value`` over the rows in front of each row."""
    sorts = _sorts(order)
    last = Window.currentRow if inclusive else -1
    df = df.withColumn("_value", value.cast("long"))

    def over(partition):
        w = Window.partitionBy(*partition).orderBy(*sorts)
        return F.coalesce(
            F.sum("_value").over(w.rowsBetween(Window.unboundedPreceding, last)), F.lit(0)
        )

    if largest_group(df, within) <= limit:
        return df.withColumn(name, over(within)).drop("_value")

    cut = _ranged(df, within, sorts)
    chunk = [*within, "_range"]
    ahead = Window.partitionBy(*within).orderBy("_range")
    lifts = (
        cut.groupBy(*chunk)
        .agg(F.sum("_value").alias("_sum"))
        .select(
            *[F.col(c).alias(f"_w{i}") for i, c in enumerate(within)],
            F.col("_range").alias("_r"),
            F.coalesce(
                F.sum("_sum").over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ).alias("_lift"),
        )
    )
    same = F.col("_range") == F.col("_r")
    for i, c in enumerate(within):
        same = same & F.col(c).eqNullSafe(F.col(f"_w{i}"))
    return (
        cut.withColumn(name, over(chunk))
        .join(lifts, same, "left")
        .withColumn(name, F.col(name) + F.coalesce("_lift", F.lit(0)))
        .drop("_value", "_range", "_r", "_lift", *[f"_w{i}" for i in range(len(within))])
    )


def row_numbers_by_integer(
    df: DataFrame, within: list[str], ord_column: str, name: str = "n", bits: int = 20
) -> DataFrame:
    """Positions by a unique integer, fully lazy.

    ``ord_column >> bits`` cuts every group into chunks of at most ``2**bits`` integers
    whatever its size, because the integer is unique in the group.  Only the integers are
    numbered; the rows themselves are dealt by a hash of theirs and meet their number there,
    so no task holds a chunk of whole rows.
    """
    key, chunk = [*within, ord_column], [*within, "_chunk"]
    numbers = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_rows")).withColumn(
        "_chunk", F.shiftright(F.col(ord_column).cast("long"), bits)
    )
    before = lambda over: F.coalesce(F.sum("_rows").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = numbers.groupBy(*chunk).agg(F.sum("_rows").alias("_rows"))
    lifts = sizes.select(*chunk, before(Window.partitionBy(*within).orderBy("_chunk")).alias("_lift"))
    inside = numbers.withColumn("_inside", before(Window.partitionBy(*chunk).orderBy(ord_column)))
    ahead = inside.join(lifts, chunk).select(*key, (F.col("_lift") + F.col("_inside")).alias("_ahead"))
    w = Window.partitionBy(*key).orderBy(ord_column)
    return df.join(ahead, key).withColumn(name, F.row_number().over(w) + F.col("_ahead")).drop("_ahead")


#: Rows of the sample that range boundaries are taken from, for each range.
SAMPLE_A_RANGE = 32


def range_bounds(df: DataFrame, keys: list[str], ranges: int) -> Column:
    """Boundaries of about equally full ranges of the ascending ``keys``, as a literal array of structs.

    They come from ``SAMPLE_A_RANGE`` rows a range with the smallest hashes, so one bounded
    sample goes to the driver; they steer work and not results.
    """
    drawn = df.select(*keys).orderBy(F.xxhash64(*keys)).limit(SAMPLE_A_RANGE * ranges)
    rows = drawn.orderBy(*[F.col(k).asc_nulls_first() for k in keys]).collect()
    cut = [rows[i] for i in range(SAMPLE_A_RANGE, len(rows), SAMPLE_A_RANGE)]
    kinds = {f.name: f.dataType for f in df.select(*keys).schema}
    bound = lambda row: F.struct(*[F.lit(row[k]).cast(kinds[k]).alias(k) for k in keys])
    if not cut:
        return F.array().cast(f"array<{df.select(F.struct(*keys).alias('k')).schema['k'].dataType.simpleString()}>")
    return F.array(*map(bound, cut))


def _range_of(bounds: Column, key: Column) -> Column:
    """How many boundaries a key has reached, by halving."""
    n = F.size(bounds)

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        reached = F.element_at(bounds, middle + 1) <= key
        up = F.struct((middle + 1).alias("lo"), s["hi"].alias("hi"))
        down = F.struct(s["lo"].alias("lo"), middle.alias("hi"))
        return F.when(s["lo"] >= s["hi"], s).when(reached, up).otherwise(down)

    rounds = F.sequence(F.lit(0), F.ceil(F.log2(n + 1.0)).cast("int"))
    return F.aggregate(rounds, F.struct(F.lit(0).alias("lo"), n.alias("hi")), halve, lambda s: s["lo"])


def _stored(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder by columns and read it back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/ranges-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def global_ordinal(df: DataFrame, keys: list[str], name: str = "place", ranges: int | None = None) -> DataFrame:
    """Append the 1-based place of every row in the ascending order of ``keys``, nulls first.

    Rows are cut into ranges by fixed boundaries and written once with their range; ranges are
    numbered inside and lifted by the number of rows in the ranges in front, a table of one row a
    range, so that neither makes the rows and their ranges again.  The range of a
    row depends on its keys alone, so a lost executor cannot renumber anything, and no task
    has more than a range.  ``keys`` have to tell rows apart; equal ones get places in any
    order.
    """
    ranges = ranges or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8)
    bounds = range_bounds(df, keys, ranges)
    cut = _stored(df.withColumn("_range", _range_of(bounds, F.struct(*keys))))
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over one row a range
    lifts = cut.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows")).select(
        F.col("_range").alias("_of"), F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_lift")
    )
    own = Window.partitionBy("_range").orderBy(*[F.col(k).asc_nulls_first() for k in keys])
    numbered = cut.withColumn("_at", F.row_number().over(own)).join(F.broadcast(lifts), F.col("_range") == F.col("_of"))
    return numbered.withColumn(name, F.col("_at") + F.col("_lift")).drop("_range", "_of", "_at", "_lift")
