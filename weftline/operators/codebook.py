"""The codebook: register of merged codes, edits, references, lenses."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import strip
from weftline.operators.ordered import checkpointed
from weftline.project import Project, blank, union_all
from weftline.schema import CODE_ID, CODE_MENTION, CODES


def _upper_id(c="code_id"):
    return F.upper(strip(F.coalesce(c, F.lit(""))))


def lens_for_prefix(codes: DataFrame) -> DataFrame:
    """The lens most codes of an id prefix use; the first code id breaks a tie."""
    return (
        codes.where(~blank("lens"))
        .select(
            F.upper(F.substring_index("code_id", "-", 1)).alias("prefix"),
            strip("lens").alias("lens"),
            "code_id",
        )
        .groupBy("prefix", "lens")
        .agg(F.count(F.lit(1)).alias("n"), F.min("code_id").alias("first"))
        .groupBy("prefix")
        .agg(F.min_by("lens", F.struct(-F.col("n"), "first", "lens")).alias("lens"))
    )


# ---------------------------------------------------------------- register


def _jump(edges: DataFrame, doublings: int) -> DataFrame:
    """Follow every edge ``2**doublings`` steps; stops early when nothing moves.

    The stride doubles with each self-join, three of them to a materialised round.
    """
    reach = edges
    for _ in range(0, doublings, 3):
        start = reach.withColumn("was", F.col("new_id"))
        for _ in range(3):
            onward = start.select(F.col("old_id").alias("via"), F.col("new_id").alias("far"))
            start = start.join(onward, F.col("new_id") == F.col("via"), "left").select(
                "old_id", F.coalesce("far", "new_id").alias("new_id"), "was"
            )
        round_ = checkpointed(start)
        reach = round_.drop("was")
        if round_.where("was <> new_id").isEmpty():
            break
    return reach


def register_resolve(retired: DataFrame) -> DataFrame:
    """(old_id, new_id) with chains followed to their end.

    A chain into nothing gives ''.  A cycle stops at the first id met twice: a member
    of a cycle resolves to itself, a chain into a cycle to the member it enters by.
    """
    if "ord" in retired.columns:
        latest = F.max_by(strip(F.coalesce("new_id", F.lit(""))), "ord")
    else:
        latest = F.max_by(strip(F.coalesce("new_id", F.lit(""))), F.struct("date", "new_id"))
    direct = checkpointed(retired.groupBy("old_id").agg(latest.alias("new_id")))
    doublings = max(1, math.ceil(math.log2(direct.count() + 1)))
    far = _jump(direct, doublings)
    looping = (
        far.join(direct.select(F.col("old_id").alias("new_id")), "new_id", "left_semi")
        .select(F.col("new_id").alias("old_id"))
        .distinct()
    )
    looping = checkpointed(looping)
    if looping.isEmpty():
        return far
    entered = _jump(direct.join(looping, "old_id", "left_anti"), doublings)
    return entered.unionByName(looping.select("old_id", F.col("old_id").alias("new_id")))


def retire_map(df: DataFrame, resolved: DataFrame, col: str = "code_id") -> DataFrame:
    """Rewrite codes through the resolved register; '' leaves the original id."""
    to = resolved.select(F.col("old_id").alias(col), F.nullif(F.col("new_id"), F.lit("")).alias("_to"))
    return df.join(to, col, "left").withColumn(col, F.coalesce("_to", col)).drop("_to").select(*df.columns)


def dedupe_codings(codings: DataFrame, order: tuple[str, ...] = ("ord",)) -> DataFrame:
    """First row of each (excerpt, code, coder) by ``order``; aggregated map-side."""
    keys = ["excerpt_id", "code_id", "coder"]
    rest = [c for c in codings.columns if c not in keys]
    first = codings.withColumn("coder", F.coalesce("coder", F.lit(""))).groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")
    )
    return first.select(*keys, "_r.*").select(*codings.columns)


def _checked(violations: list[DataFrame]) -> None:
    bad = [r[0] for r in union_all([v.toDF("why") for v in violations]).limit(5).collect()]
    if bad:
        raise ValueError("; ".join(bad))


def code_merge(
    project: Project, pairs: DataFrame, order: tuple[str, ...] = ("ord",)
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(codes, codings, retired) after moving every coding from old to new.

    ``pairs``: old_id, new_id, note.  New must be in the codebook and must not be
    merged away by the same table; old must exist or be in use.
    """
    known = project.codes.select("code_id").distinct()
    used = project.codings.select("code_id").distinct()
    old, new = F.col("old_id"), F.col("new_id")
    _checked(
        [
            pairs.where(old == new).select(F.concat(old, F.lit(": a code cannot be merged into itself"))),
            pairs.join(known, new == F.col("code_id"), "left_anti").select(
                F.concat(F.lit("code_undefined: "), new)
            ),
            pairs.join(pairs.select(old.alias("o")), new == F.col("o"), "left_semi").select(
                F.concat(F.lit("target_merged_too: "), new)
            ),
            pairs.join(known.unionByName(used), old == F.col("code_id"), "left_anti").select(
                F.concat(F.lit("code_undefined: "), old)
            ),
        ]
    )
    return _apply_change(project, pairs, order)


def code_retire(
    project: Project, ids: DataFrame, force: bool = False, order: tuple[str, ...] = ("ord",)
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Drop codes with no replacement; refuses while codings use them unless forced."""
    pairs = ids.select(
        F.col("old_id"), F.lit("").alias("new_id"),
        (F.col("note") if "note" in ids.columns else F.lit("")).alias("note"),
    )
    known = project.codes.select("code_id").unionByName(project.codings.select("code_id")).distinct()
    checks = [
        pairs.join(known, F.col("old_id") == F.col("code_id"), "left_anti").select(
            F.concat(F.lit("code_undefined: "), F.col("old_id"))
        )
    ]
    if not force:
        checks.append(
            pairs.join(project.codings, F.col("old_id") == F.col("code_id"), "left_semi").select(
                F.concat(F.lit("code_in_use: "), F.col("old_id"))
            )
        )
    _checked(checks)
    return _apply_change(project, pairs, order)


def _apply_change(project, pairs, order):
    codings = dedupe_codings(retire_map(project.codings, pairs), order)
    codes = project.codes.join(pairs.select(F.col("old_id").alias("code_id")), "code_id", "left_anti")
    entry = pairs.select("old_id", "new_id", F.coalesce("note", F.lit("")).alias("note"), F.current_date().alias("date"))
    if project.retired is None:
        return codes, codings, entry
    earlier = project.retired.select(*entry.columns).join(pairs.select("old_id"), "old_id", "left_anti")
    return codes, codings, earlier.unionByName(entry)


# ---------------------------------------------------------------- definitions


def code_id_format(codes: DataFrame) -> DataFrame:
    """(code_id, violation) for every malformed, repeated or incomplete code."""
    c = codes.withColumn("code_id", _upper_id())
    repeated = c.groupBy("code_id").count().where("count > 1")
    return union_all(
        [
            c.where(~F.col("code_id").rlike(rf"\A{CODE_ID}\z")).select("code_id", F.lit("malformed id").alias("violation")),
            repeated.select("code_id", F.lit("already exists").alias("violation")),
            c.where(blank("lens")).select("code_id", F.lit("lens is required").alias("violation")),
            c.where(blank("name")).select("code_id", F.lit("name is required").alias("violation")),
        ]
    ).distinct()


def codebook_edits(project: Project, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(codes, violations) after a table of new or changed codes.

    A null field of an edit leaves the old value.  New codes need a well-formed id, a
    lens and a name; two edits of one id are refused.
    """
    fields = [f for f in CODES.fieldNames() if f in project.codes.columns]
    given = edits.withColumn("code_id", _upper_id())
    existing = project.codes.select("code_id")
    fresh = given.join(existing, "code_id", "left_anti")
    repeated = given.groupBy("code_id").count().where("count > 1").select(
        "code_id", F.lit("edited more than once").alias("violation")
    )
    violations = code_id_format(fresh).where("violation <> 'already exists'").unionByName(repeated)
    good = given.join(violations, "code_id", "left_anti")
    new = good.select(
        "code_id", *[strip(F.col(f)).alias(f"_{f}") for f in fields if f in edits.columns and f != "code_id"]
    )
    merged = project.codes.join(new, "code_id", "full_outer")
    values = {
        f: F.coalesce(*([F.col(f"_{f}")] if f"_{f}" in new.columns else []), F.col(f), F.lit(""))
        for f in fields
        if f != "code_id"
    }
    return merged.select("code_id", *[values[f].alias(f) for f in fields if f != "code_id"]), violations


def code_refs(codes: DataFrame) -> DataFrame:
    """Codes mentioned in include and exclude rules: (code_id, field, ref, known)."""
    rules = codes.select("code_id", "include", "exclude").unpivot(
        "code_id", ["include", "exclude"], "field", "rule"
    )
    refs = rules.select(
        "code_id", "field",
        F.explode(F.regexp_extract_all("rule", F.lit(CODE_MENTION), F.lit(0))).alias("ref"),
    ).distinct()
    known = codes.select(F.col("code_id").alias("ref")).distinct().withColumn("known", F.lit(True))
    return refs.join(known, "ref", "left").select(
        "code_id", "field", "ref", F.coalesce("known", F.lit(False)).alias("known")
    )


def search_haystack(project: Project) -> DataFrame:
    """Lower-cased text a codebook search looks through: (code_id, lens, hay)."""
    shown = [F.coalesce(F.col(f), F.lit("")) for f in ("code_id", "name", "definition", "include", "exclude")]
    return project.codes.select("code_id", "lens", F.lower(F.concat_ws(" ", *shown)).alias("hay"))


def codebook_tree(codes: DataFrame, valence: bool = False) -> DataFrame:
    """Parent/child edges of the exported code tree: (parent, child, label, description)."""
    lens_label = F.coalesce(F.nullif(strip(F.regexp_replace("lens", r"\A[^.]*\.", "")), F.lit("")), F.col("lens"))
    lenses = codes.select("lens").distinct().select(
        F.lit("").alias("parent"), F.col("lens").alias("child"), lens_label.alias("label"),
        F.concat(F.lit("Lens: "), lens_label).alias("description"),
    )
    part = lambda f, head: F.when(F.coalesce(F.col(f), F.lit("")) != "", F.concat(F.lit(head), F.col(f)))
    leaves = codes.select(
        F.col("lens").alias("parent"), F.col("code_id").alias("child"), F.col("code_id").alias("label"),
        F.concat_ws(
            "\n\n", part("name", ""), part("definition", ""), part("include", "INCLUDE: "),
            part("exclude", "EXCLUDE: "), part("valence", "Declared valence: "), part("note", "Note: "),
        ).alias("description"),
    )
    tree = lenses.unionByName(leaves)
    if valence:
        from weftline.schema import VALENCES

        root = codes.limit(1).select(
            F.explode(F.array(*[F.lit(v) for v in ("Valence", *VALENCES)])).alias("child")
        ).select(
            F.when(F.col("child") == "Valence", F.lit("")).otherwise(F.lit("Valence")).alias("parent"),
            "child", F.col("child").alias("label"),
            F.when(F.col("child") == "Valence", F.lit("Per-coding valence."))
            .otherwise(F.concat(F.lit("Coding judged "), F.col("child"), F.lit("."))).alias("description"),
        )
        tree = tree.unionByName(root)
    return tree
