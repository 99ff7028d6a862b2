"""Coding sheets as people save them: any delimiter, several encodings, loose headers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.ordered import row_numbers_by_integer
from weftline.project import union_all

# ---- fixed values: accepted headers, and what bytes 0x80-0x9f mean in Windows-1252 ----
HEADERS = {
    "quote": ("quote", "quotation", "text", "excerpt", "passage", "extract", "data"),
    "code": ("code", "codes", "coding", "label"),
    "valence": ("valence", "direction", "polarity", "sentiment"),
    "note": ("note", "notes", "comment", "comments", "memo", "remark", "remarks"),
    "pid": ("pid", "participant", "participantid", "id"),
    "unit": ("unit", "game", "title"),
}
ANSI_BYTES = (
    "\x80\x82\x83\x84\x85\x86\x87\x88\x89\x8a\x8b\x8c\x8e"
    "\x91\x92\x93\x94\x95\x96\x97\x98\x99\x9a\x9b\x9c\x9e\x9f"
)
ANSI_CHARS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
# ---- end of fixed values ----

DELIMITERS = (",", ";", "\t")
SNIFFED = 4096


def file_shapes(files: DataFrame) -> DataFrame:
    """(path, encoding, sep, head) of ``binaryFile`` rows, decided on the executors."""
    text = F.when(
        F.is_valid_utf8("content"), F.decode("content", "UTF-8")
    ).otherwise(F.decode("content", "ISO-8859-1"))
    latin = F.decode("content", "ISO-8859-1").rlike("[\x81\x8d\x8f\x90\x9d]")
    head = F.regexp_extract(F.left("_text", F.lit(SNIFFED)), r"\A\x{feff}?([^\r\n]*)", 1)
    bare = F.regexp_replace("head", '"[^"]*"', "")
    count = lambda d: F.length(bare) - F.length(F.replace(bare, F.lit(d), F.lit("")))
    best = F.array_max(F.array(*[F.struct(count(d).alias("n"), F.lit(-i).alias("o"), F.lit(d).alias("d")) for i, d in enumerate(DELIMITERS)]))
    return (
        files.withColumn("_text", text).withColumn("head", head)
        .select(
            "path",
            F.when(F.is_valid_utf8("content"), "UTF-8").when(latin, "ISO-8859-1").otherwise("windows-1252").alias("encoding"),
            best["d"].alias("sep"), "head",
        )
    )


def read_group(spark: SparkSession, paths: list[str], encoding: str, sep: str) -> DataFrame:
    """Files of one shape as one DataFrame of text columns with ``_file`` and ``_ord``."""
    ansi = encoding == "windows-1252"
    df = spark.read.csv(
        paths, header=True, multiLine=True, escape='"', sep=sep,
        encoding="ISO-8859-1" if ansi else encoding, nullValue="\x00",
    )
    cols = df.columns
    value = lambda c: F.coalesce(F.translate(c, ANSI_BYTES, ANSI_CHARS) if ansi else c, F.lit(""))
    return df.select(
        F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_ord"),
        *[value(F.col(f"`{c}`")).alias(c) for c in cols],
    )


def groups(shapes: DataFrame) -> list:
    """Shapes with their files; as many rows as there are different headers."""
    return shapes.groupBy("encoding", "sep", "head").agg(F.sort_array(F.collect_list("path")).alias("paths")).orderBy(
        "encoding", "sep", "head"
    ).collect()


def _fields(columns: list[str]) -> dict[str, str]:
    import re

    found = {}
    for c in columns:
        key = re.sub(r"[^a-z0-9]", "", c.lower())
        for field, names in HEADERS.items():
            if key in names and field not in found:
                found[field] = c
                break
    return found


def scan_sheets(spark: SparkSession, path: str) -> DataFrame:
    """(sheet_id, sheet_row, ord, quote, code, valence, note, pid, unit) of a folder's sheets.

    Row 2 is the first row after the header.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{csv,tsv,txt,CSV,TSV,TXT}").load(path)
    parts = []
    for g in groups(file_shapes(files)):
        df = read_group(spark, g["paths"], g["encoding"], g["sep"])
        found = _fields([c for c in df.columns if not c.startswith("_")])
        for needed in ("quote", "code"):
            if needed not in found:
                raise ValueError(f"no column of {g['paths'][0]} is read as {needed!r}; its header: {g['head']}")
        parts.append(
            df.select(
                F.col("_file").alias("sheet_id"), F.col("_ord").alias("ord"),
                *[(F.col(f"`{found[f]}`") if f in found else F.lit("")).alias(f) for f in HEADERS],
            )
        )
    if not parts:
        raise ValueError(f"no sheets in {path}")
    numbered = row_numbers_by_integer(union_all(parts), ["sheet_id"], "ord", "_n")
    return numbered.withColumn("sheet_row", (F.col("_n") + 1).cast("int")).drop("_n")


def sheet_columns(spark: SparkSession, path: str) -> DataFrame:
    """(sheet_id, column, field): how headers were read; field is '' for extra columns."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{csv,tsv,txt,CSV,TSV,TXT}").load(path)
    rows = []
    for g in groups(file_shapes(files)):
        cols = [c for c in read_group(spark, g["paths"], g["encoding"], g["sep"]).columns if not c.startswith("_")]
        back = {c: f for f, c in _fields(cols).items()}
        rows += [(p, c, back.get(c, "")) for p in g["paths"] for c in cols]
    return spark.createDataFrame(rows, "sheet_id string, column string, field string")
