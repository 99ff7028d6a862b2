"""The project: lazy tables plus the few lists that describe the frame."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Project:
    """Lazy DataFrames and frame metadata; nothing here triggers a job."""

    sources: DataFrame | None = None
    frame: DataFrame | None = None
    codes: DataFrame | None = None
    excerpts: DataFrame | None = None
    codings: DataFrame | None = None
    retired: DataFrame | None = None
    notes: DataFrame | None = None
    categories: tuple[str, ...] = ()
    measures: tuple[str, ...] = ()
    facets: tuple[str, ...] = ()
    unit_label: str = "unit"

    def with_(self, **tables) -> "Project":
        return replace(self, **tables)

    @property
    def spark(self):
        first = next(t for t in (self.codings, self.sources, self.frame, self.codes) if t is not None)
        return first.sparkSession


def keys(df: DataFrame) -> DataFrame:
    """Distinct (pid, unit)."""
    return df.select("pid", "unit").distinct()


def blank(c: Column | str) -> Column:
    """True for null or whitespace only."""
    from weftline.functions.text import strip

    return F.coalesce(strip(c), F.lit("")) == ""


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def union_all(frames) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
