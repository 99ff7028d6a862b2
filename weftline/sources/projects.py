"""Project tables on disk: parquet or CSV under one root."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators.filing import alias_unit
from weftline.project import Project
from weftline.schema import TABLES


def _read(spark: SparkSession, stem: str) -> DataFrame | None:
    """``<stem>.parquet`` if it is there, else ``<stem>.csv``, else nothing."""
    if (found := _there(lambda: spark.read.parquet(f"{stem}.parquet"))) is not None:
        return found
    return _there(
        lambda: spark.read.csv(
            f"{stem}.csv", header=True, multiLine=True, escape='"', encoding="UTF-8", nullValue="\x00",
            ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
        )
    )


def _there(read) -> DataFrame | None:
    """What ``read`` gives, or nothing if the path is not there; other failures are raised."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of ``schema`` in order: missing ones blank, text never null."""
    if {"unit", "game"} & set(df.columns):
        df = alias_unit(df)
    out = []
    for f in schema:
        c = F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)
        if isinstance(f.dataType, T.StringType):
            c = F.coalesce(c.cast("string"), F.lit(""))
        else:
            c = F.expr(f"try_cast(`{f.name}` as {f.dataType.simpleString()})") if f.name in df.columns else c.cast(f.dataType)
        out.append(c.alias(f.name))
    return df.select(*out)


def scan_project(
    spark: SparkSession, root: str, categories=(), measures=(), facets=(), unit_label: str = "unit"
) -> Project:
    """The tables under ``root``; one that does not exist is empty."""
    tables = {}
    for name, (stem, schema) in TABLES.items():
        if name == "assignment":
            continue
        found = _read(spark, f"{root.rstrip('/')}/{stem}")
        tables[name] = spark.createDataFrame([], schema) if found is None else conform(found, schema)
    frame = _read(spark, f"{root.rstrip('/')}/frame")
    if frame is None:
        frame = spark.createDataFrame([], "pid string, unit string")
    else:
        frame = alias_unit(frame).drop("game") if {"unit", "game"} & set(frame.columns) else frame.withColumn("unit", F.lit(""))
    return Project(
        frame=frame.na.fill(""), categories=tuple(categories), measures=tuple(measures),
        facets=tuple(facets), unit_label=unit_label, **tables,
    )


def sink_tables(
    df: DataFrame, path: str, fields: list[str], partition_by: str | None = None, fmt: str = "parquet"
) -> None:
    """Write ``fields`` in order, missing text as ''; readers see the old or the new table.

    The table is written beside its target and swapped in, so ``df`` may read the very
    path it replaces.  With ``partition_by`` only the partitions present in ``df`` are
    replaced.
    """
    shaped = df.select(*[F.col(f) if f in df.columns else F.lit("").alias(f) for f in fields]).na.fill("")
    if partition_by:
        shaped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition_by).format(fmt).save(path)
        return
    staging = f"{path}.staging-{uuid.uuid4().hex}"
    writer = shaped.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = (
            writer.option("header", True).option("escape", '"').option("emptyValue", "").option("nullValue", "")
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        )
    writer.save(staging)
    _swap(df.sparkSession, staging, path)


def replace_coder(codings: DataFrame, path: str, coder: str, fmt: str = "parquet") -> None:
    """Store ``codings`` as all that ``coder`` has filed in the table at ``path``; others' rows stay.

    The table is one that ``sink_tables`` wrote with ``partition_by="coder"``.  The partition
    is named and not found in the data, so a filing of nothing leaves the coder with nothing.
    ``codings`` must not read ``path``.  Only that partition is written; a failed job can
    leave it empty and is run again.
    """
    spark, name = codings.sparkSession, f"filed_{uuid.uuid4().hex}"
    stored = spark.read.format(fmt).load(path)
    fields = [f for f in stored.schema if f.name != "coder"]
    shaped = codings.select(
        *[(F.col(f.name) if f.name in codings.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]
    ).na.fill("")
    columns = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["coder string"])
    quoted = lambda v: "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    spark.sql(f"create table {name} ({columns}) using {fmt} partitioned by (coder) location {quoted(path)}")
    try:
        spark.sql(f"insert overwrite table {name} partition (coder = {quoted(coder)}) select * from {{rows}}", rows=shaped)
    finally:
        spark.sql(f"drop table {name}")
    spark.catalog.refreshByPath(path)


def _swap(spark: SparkSession, staging: str, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    to = lambda p: hadoop.Path(p)
    fs = to(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    before = to(f"{path}.previous")
    fs.delete(before, True)
    if fs.exists(to(path)):
        fs.rename(to(path), before)
    if not fs.rename(to(staging), to(path)):
        raise OSError(f"could not move {staging} to {path}")
    fs.delete(before, True)
