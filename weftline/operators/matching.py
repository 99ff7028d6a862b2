"""Locating quotes in documents: exact placement, hints, and the closest miss.

No quote is compared with every document.  Each quote gives one *anchor*, a piece
that any document containing the quote is bound to contain as well, and documents
meet quotes by an equi-join on the anchor's hash; only those pairs are verified.

=============  =======================================================
quote          anchor
=============  =======================================================
4+ words       the longest pair of adjacent inner words
3 words        the inner word
2 words        four end letters of the first word, or four first letters
               of the second, whichever word is longer
1 word         its first eight characters
=============  =======================================================

Inner words are delimited by spaces inside the quote, hence are whole words of the
document too, which is why words need no character n-grams.  The outer words of a
quote may be cut in the middle of a document word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import (
    beyond_ascii,
    block_ratio,
    border_grams,
    fold,
    fold_offsets,
    is_plain,
    longest_block,
    occurrences,
)
from weftline.operators.ordered import checkpointed
from weftline.schema import FUZZY_FLOOR, MIN_QUOTE

BROADCAST_QUOTES = 200_000
BROADCAST_CHARS = 64_000_000
BROADCAST_SOURCES = 500_000
BROADCAST_GRAMS = 1_000_000


def folded_sources(sources: DataFrame) -> DataFrame:
    """(source_id, norm, same): folded text, and whether every offset stayed in place."""
    s = sources.select("source_id", "text", beyond_ascii("text").alias("_beyond"))
    s = s.withColumn("_plain", is_plain("text", F.col("_beyond")))
    return s.withColumn("norm", fold("text", F.col("_plain"), F.col("_beyond"), once=True)).select(
        "source_id", "norm", ((F.length("norm") == F.length("text")) & F.col("_plain")).alias("same")
    )


def named_sources(sources: DataFrame, rows: DataFrame) -> DataFrame:
    """The sources that ``rows`` name; behind a count of them no text is moved to tell."""
    ids = checkpointed(rows.select("source_id").distinct())
    return sources.join(F.broadcast(ids) if ids.count() <= BROADCAST_SOURCES else ids, "source_id", "left_semi")


def neighbours(texts: DataFrame) -> DataFrame:
    """(source_id, a, b): every word of a folded text and the next one, null behind the last.

    A row carries two words, never the text, which would be copied for each of its words.
    """
    w = F.split("norm", " ")
    pairs = F.arrays_zip(w.alias("a"), F.slice(w, F.lit(2), F.size(w)).alias("b"))
    return texts.select("source_id", F.inline_outer(pairs)).where("a is not null")  # the inner form cuts the text twice


def normalise_text(df: DataFrame, col: str = "text") -> DataFrame:
    """Append ``norm`` and, per folded character, where it starts and ends."""
    folded = df.withColumn("_plain", is_plain(col)).withColumn("norm", fold(col, F.col("_plain"))).withColumn(
        "_same", (F.length("norm") == F.length(col)) & F.col("_plain")
    ).drop("_plain")
    n = F.length("norm")
    nothing = F.array().cast("array<int>")
    upto = lambda first, last: F.when(n > 0, F.sequence(first, last)).otherwise(nothing)
    moved = fold_offsets(F.when(~F.col("_same"), F.col(col)), F.lit(None).cast("array<int>"))
    half = (F.size("_moved") / 2).cast("int")
    return (
        folded.withColumn("_moved", moved)
        .withColumn("idx", F.when(F.col("_same"), upto(F.lit(0), n - 1)).otherwise(F.slice("_moved", F.lit(1), half)))
        .withColumn("idx_end", F.when(F.col("_same"), upto(F.lit(1), n)).otherwise(F.slice("_moved", half + 1, half)))
        .drop("_moved", "_same")
    )


# ---------------------------------------------------------------- anchors


def _key(kind: str, *token: Column) -> Column:
    return F.xxhash64(F.lit(kind), *token)


def _pairs(w: Column) -> Column:
    n = F.size(w)
    return F.when(
        n >= 2,
        F.zip_with(
            F.slice(w, F.lit(1), n - 1), F.slice(w, F.lit(2), n - 1),
            lambda a, b: F.concat(a, F.lit(" "), b),
        ),
    ).otherwise(F.array().cast("array<string>"))


def quote_anchors(quotes: DataFrame) -> DataFrame:
    """(sheet_row, nq, kind, key): one anchor per quote of placeable length."""
    w = F.col("_w")
    n = F.size(w)
    inner = F.slice(w, F.lit(2), n - 2)
    longest_pair = F.array_max(
        F.transform(_pairs(inner), lambda p: F.struct(F.length(p).alias("l"), p.alias("t")))
    )["t"]
    left, right = F.substring_index(longest_pair, " ", 1), F.substring_index(longest_pair, " ", -1)
    first, second = F.element_at(w, 1), F.element_at(w, 2)
    by_end = F.length(first) >= F.length(second)
    return (
        quotes.where(F.length("nq") >= MIN_QUOTE)
        .withColumn("_w", F.split("nq", " "))
        .select(
            "sheet_row",
            "nq",
            F.when(n >= 4, F.struct(F.lit("pair").alias("kind"), _key("pair", left, right).alias("key")))
            .when(n == 3, F.struct(F.lit("word").alias("kind"), _key("word", F.element_at(w, 2)).alias("key")))
            .when(
                (n == 2) & by_end,
                F.struct(F.lit("end").alias("kind"), _key("end", F.right(first, F.lit(4))).alias("key")),
            )
            .when(
                n == 2,
                F.struct(F.lit("start").alias("kind"), _key("start", F.left(second, F.lit(4))).alias("key")),
            )
            .otherwise(
                F.struct(F.lit("gram").alias("kind"), _key("gram", F.substring("nq", 1, MIN_QUOTE)).alias("key"))
            )
            .alias("_a"),
        )
        .select("sheet_row", "nq", "_a.kind", "_a.key")
    )


def document_keys(texts: DataFrame, kinds: set[str]) -> DataFrame:
    """(source_id, key): anchor keys of folded texts, only of the kinds some quote uses."""
    a, b = F.col("a"), F.col("b")
    four = lambda key: F.when(F.length(a) >= 4, key)
    one = {
        "pair": F.when(b.isNotNull(), _key("pair", a, b)),
        "word": _key("word", a),
        "end": four(_key("end", F.right(a, F.lit(4)))),
        "start": four(_key("start", F.left(a, F.lit(4)))),
    }
    words = neighbours(texts)
    parts = [one[k] for k in one if k in kinds]
    if "gram" not in kinds and len(parts) == 1:
        return words.select("source_id", parts[0].alias("key"))
    keys = F.array(*parts) if parts else F.array().cast("array<bigint>")
    if "gram" in kinds:
        grams = F.when(F.length(a) >= MIN_QUOTE, F.regexp_extract_all(a, F.lit(r"(?s)(?=(.{8}))"), F.lit(1)))
        keys = F.concat(keys, F.coalesce(F.transform(grams, lambda g: _key("gram", g)), F.array().cast("array<bigint>")))
    return words.select("source_id", F.explode(keys).alias("key"))


# ---------------------------------------------------------------- matching


def match_quotes(quotes: DataFrame, sources: DataFrame, strategy: str = "auto") -> DataFrame:
    """Every occurrence of every quote: (sheet_row, source_id, start, end).

    ``quotes`` has ``sheet_row`` and the folded quote ``nq``; offsets are half open
    and point into the original text.  The keys of the documents meet the anchors without
    their text, by a hash join without a shuffle (``broadcast``) or by a ``shuffle`` of
    (key, source_id); ``auto`` looks at the size of the quote table.  Only the texts of the
    sources met so are read again and looked through.
    """
    anchors = checkpointed(quote_anchors(quotes))
    profile = anchors.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.length("nq")).alias("chars"),
        F.collect_set("kind").alias("kinds"),
    ).first()
    kinds = set(profile["kinds"])
    if strategy == "auto":
        small = profile["n"] <= BROADCAST_QUOTES and (profile["chars"] or 0) <= BROADCAST_CHARS
        strategy = "broadcast" if small else "shuffle"
    if not kinds:
        kinds = {"word"}

    asked = anchors.select("sheet_row", "nq", "key")
    met = document_keys(folded_sources(sources), kinds).join(F.broadcast(asked) if strategy == "broadcast" else asked, "key")
    pairs = checkpointed(met.select("sheet_row", "nq", "source_id").distinct())
    size = pairs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("nq")).alias("chars")).first()
    small = strategy == "broadcast" and size["n"] <= BROADCAST_SOURCES and (size["chars"] or 0) <= BROADCAST_CHARS
    candidates = folded_sources(named_sources(sources, pairs)).join(F.broadcast(pairs) if small else pairs, "source_id")

    hits = candidates.where(F.contains("norm", "nq")).select(
        "sheet_row",
        "source_id",
        "same",
        F.length("nq").alias("n"),
        F.explode(occurrences(F.col("norm"), F.col("nq"))).alias("p"),
    )
    # hits are few and used by several branches below; the corpus is read once
    return _original_offsets(checkpointed(hits), sources)


def _original_offsets(hits: DataFrame, sources: DataFrame) -> DataFrame:
    """Folded positions back to original offsets.

    Where folding kept every character in place the positions are the offsets.  For
    the others each source is folded once more, for the distinct positions that were
    hit (at most its own length).
    """
    plain = hits.where("same").select(
        "sheet_row", "source_id", F.col("p").alias("start"), (F.col("p") + F.col("n")).alias("end")
    )
    moved = hits.where(~F.col("same")).withColumn("q", F.col("p") + F.col("n") - 1)
    wanted = (
        moved.select("source_id", F.explode(F.array("p", "q")).alias("p"))
        .groupBy("source_id")
        .agg(F.sort_array(F.collect_set("p")).alias("at"))
        .join(named_sources(sources.select("source_id", "text"), moved), "source_id")
        .select("source_id", "at", fold_offsets("text", F.col("at")).alias("both"))
    )
    k = F.size("at")
    place = wanted.select(
        "source_id",
        F.explode(
            F.arrays_zip(
                F.col("at").alias("at"),
                F.slice("both", F.lit(1), k).alias("s"),
                F.slice("both", k + 1, k).alias("e"),
            )
        ).alias("z"),
    ).select("source_id", F.col("z.at").alias("at"), F.col("z.s").alias("s"), F.col("z.e").alias("e"))
    first = place.select("source_id", F.col("at").alias("p"), F.col("s").alias("start"))
    last = place.select("source_id", F.col("at").alias("q"), F.col("e").alias("end"))
    return plain.unionByName(
        moved.join(first, ["source_id", "p"])
        .join(last, ["source_id", "q"])
        .select("sheet_row", "source_id", "start", "end")
    )


def hint_narrow(hits: DataFrame, sheet: DataFrame) -> DataFrame:
    """Apply pid and unit hints to hits, but only where something survives them.

    ``hits`` carries the ``pid`` and ``unit`` of its source.  Rows of the sheet are
    judged by an aggregate, so one quote with very many hits is not gathered.
    """
    hints = sheet.select(
        "sheet_row",
        F.regexp_replace(F.trim(F.coalesce("pid", F.lit(""))), r"\A(?i:pid)\s*", "").alias("_pid"),
        F.lower(F.trim(F.coalesce("unit", F.lit("")))).alias("_unit"),
    ).where("_pid <> '' or _unit <> ''")
    fits = ((F.col("_pid") == "") | (F.col("pid") == F.col("_pid"))) & (
        (F.col("_unit") == "") | F.contains(F.lower("unit"), F.col("_unit"))
    )
    judged = hits.join(hints, "sheet_row", "left").withColumn(
        "_fits", F.when(F.col("_pid").isNotNull(), fits)
    )
    useful = judged.where("_fits").select("sheet_row").distinct().withColumn("_useful", F.lit(True))
    return (
        judged.join(useful, "sheet_row", "left")
        .where(F.col("_useful").isNull() | F.col("_fits"))
        .drop("_pid", "_unit", "_fits", "_useful")
    )


def hit_places(hits: DataFrame) -> DataFrame:
    """Where each quote occurs: (sheet_row, pid, unit, n), whole whatever its size."""
    return hits.groupBy("sheet_row", "pid", "unit").agg(F.count(F.lit(1)).alias("n"))


def resolve_unique(hits: DataFrame, quotes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(filed, ambiguous, unmatched) sheet rows.

    A row with exactly one occurrence is filed.  Two occurrences are ambiguous even
    inside one source.  The reason of an ambiguous row counts its hits and lists all places
    that a pid or unit hint can choose from; ``hit_places`` has them as rows.
    """
    hits = checkpointed(hits)
    counts = hits.groupBy("sheet_row").agg(
        F.count(F.lit(1)).alias("hits"),
        F.min(F.struct("source_id", "start", "end")).alias("_only"),
    )
    filed = counts.where("hits = 1").select("sheet_row", "_only.source_id", "_only.start", "_only.end")
    many = hits.join(counts.where("hits > 1").select("sheet_row"), "sheet_row", "left_semi")
    places = hit_places(many)
    per_row = places.groupBy("sheet_row").agg(F.sum("n").alias("hits"), F.count(F.lit(1)).alias("places"))
    listed = (
        places.select("sheet_row", F.concat(F.lit("PID"), "pid", F.lit("/"), "unit").alias("place"))
        .groupBy("sheet_row")
        .agg(F.array_join(F.sort_array(F.collect_set("place")), ", ").alias("where"))
    )
    ambiguous = per_row.join(listed, "sheet_row", "left").select(
        "sheet_row",
        "hits",
        "places",
        F.concat(F.lit("hits_many: "), F.col("hits").cast("string"), F.lit(" in "), F.col("where")).alias("reason"),
    )
    unmatched = quotes.join(counts.select("sheet_row"), "sheet_row", "left_anti")
    return filed, ambiguous, unmatched


# ---------------------------------------------------------------- closest miss


#: Quotes that share one copy of a source's text, on average, while their places are sought.
QUOTES_A_TEXT = 256


def closest_windows(pairs: DataFrame, sources: DataFrame) -> DataFrame:
    """(sheet_row, start, end, ratio): where in its source each quote of ``pairs`` comes closest.

    ``pairs`` has (sheet_row, nq, source_id), one row a quote.  The window begins where the
    longest piece that quote and folded source share begins, and is as long as the quote;
    the ratio is ``block_ratio`` of quote and window.  Offsets point into the original text.
    A source meets its quotes in bundles, so a source that many quotes come closest to is
    neither copied for each of them nor met in one task.
    """
    bundles = pairs.groupBy("source_id").agg(F.ceil(F.count(F.lit(1)) / QUOTES_A_TEXT).alias("_of"))
    dealt = pairs.join(bundles, "source_id").groupBy("source_id", F.pmod(F.xxhash64("sheet_row"), F.col("_of")).alias("_bundle")).agg(
        F.collect_list(F.struct("sheet_row", "nq")).alias("_asked")
    )
    met = dealt.join(folded_sources(named_sources(sources, pairs)), "source_id")
    block = F.transform("_asked", lambda q: F.struct(q["sheet_row"].alias("sheet_row"), q["nq"].alias("nq"), longest_block(q["nq"], F.col("norm"))["b"].alias("p")))
    found = met.select("source_id", "same", "norm", F.transform(block, lambda q: F.struct(
        q["sheet_row"].alias("sheet_row"), q["nq"].alias("nq"), q["p"].alias("p"),
        F.substring(F.col("norm"), q["p"] + 1, F.length(q["nq"])).alias("window"),
    )).alias("q")).select("source_id", "same", F.explode("q").alias("q")).select("source_id", "same", "q.*")
    found = checkpointed(found)
    places = _original_offsets(found.select("sheet_row", "source_id", "same", F.length("window").alias("n"), "p"), sources)
    return found.select("sheet_row", block_ratio(F.col("nq"), F.col("window")).alias("ratio")).join(places.drop("source_id"), "sheet_row")


def telling_grams(asked: DataFrame, sizes: DataFrame) -> DataFrame:
    """(sheet_row, gram, missing): the grams of a quote that sources are met on.

    These are the grams that no longer gram of the quote ends in.  A source may lack
    ``missing`` of all grams of the quote; where fewer than ``missing`` + 1 are left, all stay.
    """
    inside = asked.select("sheet_row", F.substr("gram", F.lit(2)).alias("gram"), F.lit(True).alias("_inside"))
    marked = asked.join(inside.distinct(), ["sheet_row", "gram"], "left")
    longest = marked.groupBy("sheet_row").agg(F.count_if(F.col("_inside").isNull()).alias("_longest"))
    return (
        marked.join(sizes, "sheet_row").join(longest, "sheet_row")
        .withColumn("missing", F.col("n") - F.col("need"))
        .where(F.col("_inside").isNull() | (F.col("_longest") <= F.col("missing")))
        .select("sheet_row", "gram", "missing")
    )


def held_grams(sources: DataFrame, grams: DataFrame) -> DataFrame:
    """(source_id, gram): which of ``grams`` a source holds.

    Borders are told by the shortest gram first; those left give their three grams.
    """
    grams = checkpointed(grams)
    few = (lambda df: F.broadcast(df)) if grams.count() <= BROADCAST_GRAMS else (lambda df: df)
    ends = grams.select(F.substr("gram", F.instr("gram", " ") - 1).alias("_end")).distinct()
    gram = lambda k: F.concat(F.right("a", F.lit(k)), F.lit(" "), F.left("b", F.lit(3)))
    borders = neighbours(folded_sources(sources)).where("b is not null").withColumn("_end", gram(1))
    told = borders.join(few(ends), "_end", "left_semi")
    return told.select("source_id", F.explode(F.array(gram(1), gram(2), gram(3))).alias("gram")).join(few(grams), "gram", "left_semi").distinct()


def fuzzy_closest(unmatched: DataFrame, sources: DataFrame, floor: float = FUZZY_FLOOR) -> DataFrame:
    """The source that holds most of each unmatched quote's word borders.

    The similarity is the share of the quote's distinct border grams (``border_grams``)
    that the source holds as well, whatever the size of the corpus.  Only sources at or
    above ``floor`` are closest: of n grams such a source holds at least ceil(floor * n),
    so it holds one of any n - ceil(floor * n) + 1; sources are met on the rarest of the
    ``telling_grams`` and then counted exactly.  Equal shares go to the smaller source_id.  Below the floor, and
    for a quote of one word, there is no source and the similarity is 0.

    ``closest_start``, ``closest_end`` and ``ratio`` tell where in that source the quote comes
    closest and how much of it is there in matched blocks (``closest_windows``); they are
    null where there is no source.
    """
    asked = unmatched.select("sheet_row", F.explode(border_grams("nq")).alias("gram"))
    asked = checkpointed(asked)
    sizes = asked.groupBy("sheet_row").agg(F.count(F.lit(1)).alias("n")).withColumn("need", F.ceil(F.col("n") * floor - 1e-9))
    telling = checkpointed(telling_grams(asked, sizes))
    held = checkpointed(held_grams(sources, telling.select("gram").distinct()))
    common = held.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    by_rarity = Window.partitionBy("sheet_row").orderBy(F.coalesce("df", F.lit(0)), "gram")
    ranked = telling.join(common, "gram", "left").withColumn("rank", F.row_number().over(by_rarity))
    rare = ranked.where("rank <= missing + 1").select("sheet_row", "gram")
    met = checkpointed(rare.join(held, "gram").select("sheet_row", "source_id").distinct())
    near = held_grams(named_sources(sources, met), asked.select("gram").distinct())
    shared = met.join(asked, "sheet_row").join(near, ["source_id", "gram"]).groupBy("sheet_row", "source_id").agg(F.count(F.lit(1)).alias("k"))
    best = shared.join(sizes, "sheet_row").where("k >= need").groupBy("sheet_row").agg(
        F.min_by("source_id", F.struct(-F.col("k"), F.col("source_id"))).alias("closest_source"),
        F.max(F.col("k") / F.col("n")).alias("share"),
    )
    best = checkpointed(best)
    pairs = best.select("sheet_row", F.col("closest_source").alias("source_id")).join(unmatched.select("sheet_row", "nq"), "sheet_row")
    best = best.join(closest_windows(pairs, sources), "sheet_row", "left")
    return unmatched.select("sheet_row").join(best, "sheet_row", "left").select(
        "sheet_row",
        F.coalesce("closest_source", F.lit("")).alias("closest_source"),
        F.bround(F.coalesce("share", F.lit(0.0)), 2).alias("similarity"),
        F.when(F.col("share").isNull(), F.lit("unmatched")).otherwise(F.lit("close_match")).alias("reason"),
        F.col("start").alias("closest_start"),
        F.col("end").alias("closest_end"),
        F.bround("ratio", 2).alias("ratio"),
    )
