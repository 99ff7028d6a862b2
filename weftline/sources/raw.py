"""A folder of raw material: tables of any shape, and transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.project import union_all
from weftline.sources.sheets import file_shapes, groups, read_group

# ---- fixed values: what marks a transcript ----
TIMECODE = r"(?m)\d\d:\d\d:\d\d[.,]\d+\s*-->|^\[\d+:\d\d\]"
VOICE = r"<v ([^>]+)>"
SPOKEN = r"(?s)<v [^>]+>(.*?)</v>"
STUDENT_ID = r"(?i)(\bs\d{6,8}\b)"
# ---- end of fixed values ----


def _relative(path: Column, root: str) -> Column:
    """Path below the scanned root, whatever the scheme in front of it."""
    base = root.split("://")[-1].rstrip("/")
    return F.regexp_replace(path, r"\A.*?\Q" + base + r"\E/", "")


def _plain_path(path: Column) -> Column:
    """File paths in row metadata are URL-encoded."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


#: A project's table of sources below its folder: one file, or a folder of part files.
PROJECT_TABLE = r"\A(.+/)sources\.(?:csv|parquet)(?:/[^/]+)?\z"


def _pruned(files: DataFrame, spark: SparkSession, root: str, skip) -> DataFrame:
    """Leave out hidden folders, named folders and folders that are projects already."""
    listed = files.withColumn("file", _relative(F.col("path"), root))
    folders = F.slice(F.split("file", "/"), F.lit(1), F.size(F.split("file", "/")) - 1)
    out = ["__pycache__", *skip]
    kept = listed.where(~F.exists(folders, lambda d: F.startswith(d, F.lit(".")) | d.isin(*out)))
    projects = (
        _files(spark, root, "*").select(_relative(F.col("path"), root).alias("file"))
        .select(F.regexp_extract("file", PROJECT_TABLE, 1).alias("prefix")).where("prefix <> ''").distinct()
    )
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(folders)),
        lambda i: F.concat(F.array_join(F.slice(folders, F.lit(1), i), "/"), F.lit("/")),
    )
    inside = (
        kept.where(F.size(folders) > 0).select("path", F.explode(prefixes).alias("prefix"))
        .join(projects, "prefix", "left_semi").select("path").distinct()
    )
    return kept.join(inside, "path", "left_anti")


def _files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob).load(path)
    )


def scan_tables_dir(spark: SparkSession, path: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """(file, ord, cells MAP): every row of every csv or tsv below a folder."""
    files = _pruned(_files(spark, path, "*.{csv,tsv,CSV,TSV}"), spark, path, skip)
    parts = []
    for g in groups(file_shapes(files)):
        df = read_group(spark, g["paths"], g["encoding"], g["sep"])
        cols = [c for c in df.columns if c not in ("_file", "_ord")]
        cells = F.create_map(*[x for c in cols for x in (F.lit(c), F.col(f"`{c}`"))])
        parts.append(df.select(_relative(_plain_path(F.col("_file")), path).alias("file"), F.col("_ord").alias("ord"), cells.alias("cells")))
    if not parts:
        return spark.createDataFrame([], "file string, ord bigint, cells map<string,string>")
    return union_all(parts)


def scan_transcripts(spark: SparkSession, path: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """(path, folder, text, speakers, ids, n_cues) of .vtt, .srt and timed .txt files."""
    texts = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.{vtt,srt,txt,VTT,SRT,TXT}")
        .text(path, wholetext=True)
        .select(_plain_path(F.col("_metadata.file_path")).alias("path"), F.col("value").alias("text"))
    )
    kept = _pruned(texts, spark, path, skip).where(~F.lower("file").endswith(".txt") | F.col("text").rlike(TIMECODE))
    distinct = lambda pattern: F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))))
    parts = F.split("path", "/")
    return kept.select(
        F.col("file").alias("path"), F.element_at(parts, F.size(parts) - 1).alias("folder"), "text",
        distinct(VOICE).alias("speakers"), distinct(STUDENT_ID).alias("ids"),
        F.regexp_count("text", F.lit(SPOKEN)).alias("n_cues"),
    )
