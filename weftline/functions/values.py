"""Numbers, identifiers, bands and other scalar rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.text import _c
from weftline.schema import NUMERIC

# ---- fixed values: agreement bands and the namespace of exported ids ----
KAPPA_BANDS = (
    (0.81, "almost perfect"),
    (0.61, "substantial"),
    (0.41, "moderate"),
    (0.21, "fair"),
    (0.0, "slight"),
)
ID_NAMESPACE = "6f1b0c2e-9a3d-5e47-8b21-4c7d0e9a1f36"
# ---- end of fixed values ----


def numeric_regex(c: Column | str) -> Column:
    """Whole value is a plain decimal number."""
    return F.coalesce(_c(c).rlike(rf"\A{NUMERIC}\z"), F.lit(False))


def number(c: Column | str) -> Column:
    """The value as a double where it is a plain number, else null."""
    return F.when(numeric_regex(c), _c(c).try_cast("double"))


def pct(hits: Column, total: Column, digits: int = 1) -> Column:
    """Rounded percentage, half to even; 0 when there is nothing to divide by."""
    return F.when(total > 0, F.bround(F.lit(100.0) * hits / total, digits)).otherwise(0.0)


def excerpt_id_build(source_id: Column | str, start: Column | str, end: Column | str) -> Column:
    return F.concat_ws("-", F.lit("X"), _c(source_id), _c(start).cast("string"), _c(end).cast("string"))


def digits_only(c: Column | str) -> Column:
    return F.coalesce(_c(c).rlike(r"\A[0-9]+\z"), F.lit(False))


def numeric_sort_key(pid: Column | str = "pid", unit: Column | str = "unit") -> list[Column]:
    """Ordering: numeric participants by number first, then the others as text."""
    p = _c(pid)
    is_num = digits_only(p)
    return [
        (~is_num).cast("int").asc(),
        F.coalesce(F.when(is_num, p.try_cast("decimal(38,0)")), F.lit(0)).asc(),
        F.when(is_num, _c(unit)).otherwise(F.concat(p, _c(unit))).asc(),
    ]


def padded(pid: Column | str, width: int) -> Column:
    """Zero-padded when the id is a number, unchanged otherwise."""
    p = _c(pid)
    n = F.regexp_replace(p, r"\A0+(?=[0-9])", "")
    return F.when(digits_only(p), F.when(F.length(n) >= width, n).otherwise(F.lpad(n, width, "0"))).otherwise(p)


def participant_label(pid: Column | str) -> Column:
    """``PID07`` for numeric ids, the id itself otherwise."""
    p = _c(pid)
    return F.when(digits_only(p), F.concat(F.lit("PID"), padded(p, 2))).otherwise(p)


def kappa(both: Column, only_a: Column, only_b: Column, neither: Column) -> Column:
    """Cohen's kappa of a 2x2 table; null where it is undefined."""
    n = (both + only_a + only_b + neither).cast("double")
    observed = (both + neither) / n
    chance = ((both + only_a) / n) * ((both + only_b) / n) + ((only_b + neither) / n) * (
        (only_a + neither) / n
    )
    return F.when((n > 0) & (chance < 1), (observed - chance) / (1 - chance))


def kappa_band(k: Column) -> Column:
    band = F.when(k.isNull(), F.lit("not defined"))
    for floor, word in KAPPA_BANDS:
        band = band.when(k >= floor, F.lit(word))
    return band.otherwise(F.lit("worse than chance"))


def stable_guid(kind: str, key: Column | str) -> Column:
    """Name-based (version 5) identifier in upper case, as one expression."""
    ns = ID_NAMESPACE.replace("-", "")
    name = F.concat(F.lit(f"{kind}:"), _c(key).cast("string"))
    h = F.sha1(F.concat(F.unhex(F.lit(ns)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.upper(
        F.concat_ws(
            "-",
            F.substring(h, 1, 8),
            F.substring(h, 9, 4),
            F.concat(F.lit("5"), F.substring(h, 14, 3)),
            F.concat(variant, F.substring(h, 18, 3)),
            F.substring(h, 21, 12),
        )
    )
