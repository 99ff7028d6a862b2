"""Table shapes, enumerations and thresholds of a coded corpus.

Blank (``''``) is a value at this layer: an unjudged valence, a source with no
unit, a code with no lens.  Null never leaves a scan.
"""

from pyspark.sql import types as T

# ---- fixed values: vocabulary and thresholds of the data model ----
VALENCES = ("pos", "neg", "mixed", "neutral")
VALENCE_ORDER = ("pos", "mixed", "neutral", "neg", "")
VALENCE_SPELLINGS = {
    "positive": "pos",
    "negative": "neg",
    "p": "pos",
    "n": "neg",
    "m": "mixed",
    "x": "neutral",
}
MIN_QUOTE = 8
FUZZY_FLOOR = 0.88
MAX_CATEGORY = 12
PROSE_MEAN = 40
WRITTEN_MEAN = 20
EXAMPLE_WIDTH = 60
NUMERIC = r"-?\d+(\.\d+)?"
CODE_ID = r"[A-Z]{2,5}-[A-Z0-9-]+"
CODE_MENTION = r"\b[A-Z]{2,6}-[A-Z0-9][A-Z0-9-]*\b"
UNCATEGORISED = "Uncategorised"
STUB_NOTE = "stub - needs a definition"
# ---- end of fixed values ----


def _strings(*names):
    return [T.StructField(n, T.StringType()) for n in names]


SOURCES = T.StructType(_strings("source_id", "pid", "unit", "kind", "label", "text"))
CODES = T.StructType(
    _strings(
        "code_id", "lens", "name", "definition", "valence",
        "include", "exclude", "anchor", "note",
    )
)
EXCERPTS = T.StructType(
    _strings("excerpt_id", "source_id", "pid", "unit", "kind", "label")
    + [T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]
    + _strings("text")
)
CODINGS = T.StructType(
    _strings("excerpt_id", "code_id", "valence", "coder", "note")
    + [T.StructField("sheet_row", T.IntegerType())]
)
RETIRED = T.StructType(
    _strings("old_id", "new_id", "note") + [T.StructField("date", T.DateType())]
)
NOTES = T.StructType(_strings("note_id", "category", "title", "note", "evidence"))
UNRESOLVED = T.StructType(
    [T.StructField("sheet_row", T.IntegerType())]
    + _strings("quote", "reason", "closest_source")
    + [T.StructField("similarity", T.DoubleType()), T.StructField("closest_start", T.IntegerType())]
    + [T.StructField("closest_end", T.IntegerType()), T.StructField("ratio", T.DoubleType())]
)
ASSIGNMENT = T.StructType(_strings("pid", "pass", "coder"))

# Where each table lives under a project root.
TABLES = {
    "sources": ("sources", SOURCES),
    "codes": ("codebook/codes", CODES),
    "excerpts": ("data/excerpts", EXCERPTS),
    "codings": ("data/codings", CODINGS),
    "retired": ("codebook/retired_codes", RETIRED),
    "notes": ("codebook/notes", NOTES),
    "assignment": ("coding_assignment", ASSIGNMENT),
}
