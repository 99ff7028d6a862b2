"""Registered queries: each operator over projects derived from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from weftline.functions.text import fold, fold_valence, value_shape
from weftline.functions.values import (
    excerpt_id_build, kappa_band, numeric_regex, numeric_sort_key,
)
from weftline.operators import auditing as au
from weftline.operators import building as bu
from weftline.operators import codebook as cb
from weftline.operators import exporting as ex
from weftline.operators import filing as fi
from weftline.operators import matching as ma
from weftline.operators import notes as no
from weftline.operators import profiling as pr
from weftline.operators import reading as re_
from weftline.operators import sampling as sa
from weftline.operators import statistics as st
from weftline.operators import transcripts as tr
from weftline.operators import valence as va
from weftline.operators.ordered import row_numbers, shared_folder
from weftline.plans import adapters as ad
from weftline.plans.adapters import derive, given, raw_cells, star_project, text_project
from weftline.schema import CODINGS
from weftline.sources import replace_coder, scan_project, scan_sheets, scan_tables_dir, scan_transcripts, sheet_columns, sink_tables

QUERIES = {}
A, B = "ann", "jb"
STAR_ORDER = ("ord", "valence")
SEP = "; "


def query(f):
    QUERIES[f.__name__.rstrip("_")] = f
    return f


def star_query(f):
    QUERIES[f.__name__.rstrip("_")] = lambda spark, sf: f(star_project(spark, sf))
    return f


def text_query(f):
    QUERIES[f.__name__.rstrip("_")] = lambda spark, sf: f(text_project(spark, sf))
    return f


def joined(c: str):
    return F.array_join(c, SEP).alias(c)


def scratch(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, which every executor can reach."""
    return f"{shared_folder(spark).rstrip('/')}/weftline-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- scans and sinks


@query
def scan_project_(spark, sf):
    p, root = text_project(spark, sf), scratch(spark)
    for name in ("sources", "codes", "excerpts", "codings", "notes"):
        df = getattr(p, name)
        sink_tables(df, f"{root}/{ad_path(name)}.csv", df.columns, fmt="csv")
    sink_tables(p.frame, f"{root}/frame.parquet", p.frame.columns)
    return st.prevalence(scan_project(spark, root))


def ad_path(name):
    from weftline.schema import TABLES

    return TABLES[name][0]


@query
def sink_tables_(spark, sf):
    p, path = star_project(spark, sf), scratch(spark)
    fields = ["excerpt_id", "code_id", "valence", "coder", "note", "sheet_row"]
    sink_tables(p.codings, path, fields, partition_by="coder")
    back = spark.read.parquet(path)
    return back.groupBy("coder").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("excerpt_id").alias("excerpts"),
        F.count_if(F.coalesce("valence", F.lit("")) == "").alias("unjudged"),
        F.count_if(F.coalesce("sheet_row", F.lit("")) == "").alias("no_row"),
    )


@query
def scan_sheets_(spark, sf):
    return scan_sheets(spark, written_sheets(spark, sf)).select("quote", "code", "valence", "note", "pid", "unit", (F.col("sheet_row") >= 2).alias("numbered"))


@query
def sheet_columns_(spark, sf):
    return sheet_columns(spark, written_sheets(spark, sf)).select("column", "field").distinct()


def written_sheets(spark, sf):
    path = scratch(spark)
    sheet = derive(spark, sf, ad.SHEET).select(
        F.col("quote").alias("Quotation"), F.col("code").alias("CODES"), F.col("valence").alias("Direction "),
        F.col("note").alias("my-notes"), F.col("note").alias("Memo"), F.col("unit").alias("Game"),
    )
    sheet.repartition(2, "Memo").write.option("header", True).option("sep", ";").option("escape", '"').csv(path)
    return path


@query
def scan_tables_dir_(spark, sf):
    root = scratch(spark)
    for name, columns in (("customer", ["c_name", "c_mktsegment", "c_acctbal"]), ("orders", ["o_orderkey", "o_orderstatus"])):
        given(spark, sf, name).select(*columns).write.option("header", True).csv(f"{root}/raw/{name}")
    given(spark, sf, "supplier").select("s_name").write.option("header", True).csv(f"{root}/raw/.hidden")
    cells = scan_tables_dir(spark, f"{root}/raw")
    return cells.select(F.explode("cells").alias("column", "value")).groupBy("column").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("value").alias("distinct_values"), F.min("value").alias("least")
    )


def transcript_files(spark, sf):
    """(path, text, conv_id): cues of a file in order, at most fifty of them."""
    return derive(spark, sf, ad.CUES).groupBy("path", "conv_id").agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("slot", "cue")))["cue"], "\n").alias("text")
    )


@query
def scan_transcripts_(spark, sf):
    root = scratch(spark)
    files = transcript_files(spark, sf).withColumn("bucket", F.floor(F.col("conv_id") / 20).cast("long"))
    files.repartition("bucket").select("bucket", "text").write.partitionBy("bucket").text(root)
    found = scan_transcripts(spark, root)
    return found.agg(
        F.sum("n_cues").alias("cues"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("speakers")))), SEP).alias("speakers"),
    )


# ---------------------------------------------------------------- projections


@query
def alias_unit(spark, sf):
    rows = given(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus")).otherwise(F.lit("")).alias("unit"),
        F.when(F.col("o_orderkey") % 3 == 1, F.col("o_orderpriority")).otherwise(F.lit("")).alias("game"),
    )
    return fi.alias_unit(rows)


@query
def fold_valence_(spark, sf):
    return derive(spark, sf, ad.SHEET).select("sheet_row", fold_valence("valence").alias("valence"))


@query
def split_codes(spark, sf):
    return fi.split_codes(derive(spark, sf, ad.SHEET)).select("sheet_row", "pos", "code_id")


@text_query
def normalise_text(p):
    n = ma.normalise_text(p.sources)
    return n.select(
        "source_id", F.md5("norm").alias("norm"), F.size("idx").alias("n"),
        F.coalesce(F.try_element_at("idx", F.lit(1)), F.lit(-1)).alias("first"),
        F.coalesce(F.try_element_at("idx_end", F.lit(-1)), F.lit(-1)).alias("last_end"),
    )


@query
def source_id_build(spark, sf):
    rows = given(spark, sf, "orders").select((F.col("o_orderkey") * 3 + 1).alias("ord"), F.col("o_custkey").cast("string").alias("pid"))
    return bu.source_id_build(rows).select("ord", "pid", "source_id")


@text_query
def excerpt_id_build_(p):
    return p.excerpts.select(excerpt_id_build("source_id", "start", "end").alias("built"), "excerpt_id")


@query
def numeric_sort_key_(spark, sf):
    people = given(spark, sf, "customer").select(
        F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("x"), F.col("c_custkey").cast("string"))).otherwise(F.col("c_custkey").cast("string")).alias("pid"),
        F.col("c_mktsegment").alias("unit"),
    )
    return row_numbers(people.withColumn("_all", F.lit(0)), ["_all"], numeric_sort_key(), "place").drop("_all")


@text_query
def stub_codes(p):
    return fi.stub_codes(p, p.codings)


@star_query
def search_haystack(p):
    return cb.search_haystack(p)


# ---------------------------------------------------------------- filters


@text_query
def filter_sources(p):
    q = dict(q="The", kind="survey", status="has", valence="unjudged", lens="__none__", facets={"quality": "good"})
    return re_.filter_sources(p, **q).select("source_id", "pid", "unit")


@query
def sheet_row_gate(spark, sf):
    ok, bad = fi.sheet_row_gate(derive(spark, sf, ad.SHEET))
    return ok.select("sheet_row", F.lit("").alias("reason")).unionByName(bad.select("sheet_row", "reason"))


def sheet_project(spark, sf):
    return text_project(spark, sf).with_(retired=derive(spark, sf, ad.RETIRED))


@query
def code_known_gate(spark, sf):
    ok, bad = fi.code_known_gate(derive(spark, sf, ad.SHEET), sheet_project(spark, sf))
    return ok.select("sheet_row", joined("code_ids"), F.lit("").alias("reason")).unionByName(
        bad.select("sheet_row", F.lit("").alias("code_ids"), "reason")
    )


@query
def quote_min_length(spark, sf):
    sheet = derive(spark, sf, ad.SHEET)
    short = sheet.withColumn("quote", F.expr("substring(quote, 1, 2 + sheet_row % 12)")).withColumn("sheet_row", -F.col("sheet_row"))
    ok, bad = fi.quote_min_length(sheet.unionByName(short))
    return ok.select("sheet_row", "nq", F.lit("").alias("reason")).unionByName(bad.select("sheet_row", F.lit("").alias("nq"), "reason"))


@query
def code_id_format(spark, sf):
    edits = derive(spark, sf, ad.CODE_EDITS)
    return cb.code_id_format(edits.unionByName(edits.where("code_id like 'NEW%'")))


def odd_spans(p):
    return p.excerpts.select(
        "excerpt_id", "source_id", (F.col("start") - F.length("text") + 22).alias("start"),
        (F.col("end") + F.col("start") % 3 * 400).alias("end"),
    )


@text_query
def span_bounds(p):
    return re_.span_bounds(odd_spans(p), p.sources).select("excerpt_id", "start", "end", "ok")


@text_query
def selection_trim(p):
    return re_.selection_trim(p.excerpts.select("excerpt_id", "source_id", "start", "end"), p.sources).select("excerpt_id", "start", "end")


@query
def numeric_regex_(spark, sf):
    v = given(spark, sf, "lineitem").select(
        "l_orderkey", F.concat(F.col("l_quantity").cast("string"), F.when(F.col("l_partkey") % 2 == 0, F.lit("")).otherwise(F.lit("kg"))).alias("v")
    )
    return v.groupBy(numeric_regex("v").alias("numeric")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"))


@text_query
def blank_text(p):
    return au.blank_text(p)


@query
def restrict_pids(spark, sf):
    return sa.restrict_pids(text_project(spark, sf).sources, derive(spark, sf, ad.ASSIGNMENT)).select("source_id", "pid")


@text_query
def restrict_kind(p):
    return sa.restrict_kind(p.sources, "interview").select("source_id", "kind")


@text_query
def usable_sources(p):
    return sa.usable_sources(p.sources).select("source_id")


# ---------------------------------------------------------------- joins


def sheet_quotes(spark, sf):
    return derive(spark, sf, ad.SHEET).withColumn("nq", fold("quote"))


def sheet_hits(spark, sf):
    p = text_project(spark, sf)
    place = p.sources.select("source_id", "pid", "unit")
    return ma.match_quotes(sheet_quotes(spark, sf).select("sheet_row", "nq"), p.sources).join(place, "source_id")


@query
def match_quotes(spark, sf):
    return ma.match_quotes(sheet_quotes(spark, sf).select("sheet_row", "nq"), text_project(spark, sf).sources)


@query
def hint_narrow(spark, sf):
    return ma.hint_narrow(sheet_hits(spark, sf), derive(spark, sf, ad.SHEET)).select("sheet_row", "source_id", "start", "end")


@query
def resolve_unique(spark, sf):
    quotes = sheet_quotes(spark, sf)
    filed, many, none = ma.resolve_unique(ma.hint_narrow(sheet_hits(spark, sf), quotes), quotes)
    blank = F.lit("")
    return (
        filed.select("sheet_row", F.lit("filed").alias("outcome"), "source_id", "start", "end", blank.alias("reason"))
        .unionByName(many.select("sheet_row", F.lit("ambiguous").alias("outcome"), blank.alias("source_id"), F.lit(-1).alias("start"), F.lit(-1).alias("end"), "reason"))
        .unionByName(none.select("sheet_row", F.lit("unmatched").alias("outcome"), blank.alias("source_id"), F.lit(-1).alias("start"), F.lit(-1).alias("end"), blank.alias("reason")))
    )


@query
def fuzzy_closest(spark, sf):
    quotes = sheet_quotes(spark, sf).select("sheet_row", "nq")
    sources = text_project(spark, sf).sources
    unmatched = quotes.join(ma.match_quotes(quotes, sources).select("sheet_row"), "sheet_row", "left_anti")
    return ma.fuzzy_closest(unmatched, sources)


@star_query
def codings_excerpts(p):
    return st.codings_excerpts(p).groupBy("kind", "coder").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("pid").alias("pids"))


@star_query
def in_frame(p):
    return st.in_frame(p)


@star_query
def loose(p):
    return st.loose(p)


@text_query
def excerpts_sources(p):
    x = p.excerpts.withColumn("source_id", F.when(F.col("start") % 11 == 0, F.lit("S-gone")).otherwise(F.col("source_id")))
    x = x.withColumn("end", F.when(F.col("start") % 11 == 1, F.col("end") + 100000).otherwise(F.col("end")))
    x = x.withColumn("text", F.when(F.col("start") % 11 == 2, F.lit("changed")).otherwise(F.col("text")))
    return au.excerpts_sources(p.with_(excerpts=x))


def holed(p):
    """With frame rows added that nobody answered for, and sources that no frame row is about."""
    ghosts = p.frame.withColumn("unit", F.concat("unit", F.lit("-later"))).where("docs = '1'")
    strays = p.frame.where("docs = '2'").select(
        F.concat(F.lit("Z-"), "pid", F.lit("-"), "unit").alias("source_id"), "pid", F.concat("unit", F.lit("-astray")).alias("unit"),
        F.lit("survey").alias("kind"), F.lit("").alias("label"), F.lit("an answer to nothing").alias("text"),
    )
    return p.with_(frame=p.frame.unionByName(ghosts), sources=p.sources.unionByName(strays))


@text_query
def frame_without_source(p):
    return au.frame_without_source(holed(p))


@text_query
def source_outside_frame(p):
    return au.source_outside_frame(holed(p))


@text_query
def orphan_codes(p):
    return au.orphan_codes(p)


@text_query
def unused_codes(p):
    return au.unused_codes(p)


@star_query
def silent_participants(p):
    late = p.sources.where("label = '1-URGENT'").withColumn("pid", F.concat("pid", F.lit("-late")))
    return au.silent_participants(p.with_(sources=p.sources.unionByName(late)))


@query
def register_resolve(spark, sf):
    return cb.register_resolve(derive(spark, sf, ad.RETIRED))


@query
def retire_map(spark, sf):
    coded = given(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("OLD-"), F.col("l_partkey").cast("string")).alias("code_id"))
    mapped = cb.retire_map(coded, cb.register_resolve(derive(spark, sf, ad.RETIRED)))
    return mapped.groupBy("code_id").agg(F.count(F.lit(1)).alias("n"))


@text_query
def valence_targets(p):
    return va.valence_targets(p).select("excerpt_id", "code_id", "coder", "code_valence", "name", "text", "note")


@query
def valence_cache_skip(spark, sf):
    t = va.valence_targets(text_project(spark, sf))
    return va.valence_cache_skip(t, derive(spark, sf, ad.CACHE)).select("excerpt_id", "code_id", "coder")


def cached_judgements(spark, sf):
    return derive(spark, sf, ad.CACHE).select("excerpt_id", "code_id", F.col("model_valence").alias("valence"), "why")


def settled(spark, sf):
    return va.valence_settle(va.valence_targets(text_project(spark, sf)), cached_judgements(spark, sf))


@query
def valence_apply(spark, sf):
    return va.valence_apply(text_project(spark, sf), settled(spark, sf)).select("excerpt_id", "code_id", "coder", "valence")


@text_query
def facets_for_source(p):
    return re_.facets_for_source(p)


@query
def roster_link(spark, sf):
    people = derive(spark, sf, ad.PEOPLE)
    files = derive(spark, sf, ad.RECORDINGS).select(
        "path", "folder", F.array("speaker").alias("speakers"),
        F.filter(F.array("student"), lambda s: s != "").alias("ids"),
    )
    return tr.roster_link(files, people)


@text_query
def notes_evidence(p):
    return no.notes_evidence(p)


@query
def assignment_attrs(spark, sf):
    return ex.assignment_attrs(ex.case_table(text_project(spark, sf)), derive(spark, sf, ad.ASSIGNMENT)).select("case_id", "pass", "coder")


@text_query
def overlap_clash(p):
    moved = p.excerpts.select(F.concat(F.lit("N-"), "excerpt_id").alias("new_id"), "source_id", (F.col("start") + 15).alias("start"), (F.col("end") + 9).alias("end"))
    return re_.overlap_clash(moved, p.excerpts)


@text_query
def doc_place_shift(p):
    return ex.doc_place_shift(p, ex.document_parts(p).select("source_id", "doc_id", "shift"))


# ---------------------------------------------------------------- figures


@star_query
def prevalence(p):
    return st.prevalence(p)


@star_query
def valence_mix(p):
    return st.valence_mix(p)


@star_query
def split(p):
    return st.split(p, "priority")


@star_query
def measures(p):
    return st.measures(p)


@star_query
def order_by_gap(p):
    return st.split_places(p, "status").select("code_id", "value", "gap", "place")


@star_query
def order_by_abs_diff(p):
    return st.measures_places(p)


@star_query
def figure(p):
    """A figure asked for by its name."""
    return st.figure(p, "split", by="status", top=5)


@star_query
def dependence(p):
    return st.dependence(p)


@star_query
def cooccur_matrix(p):
    return st.cooccur_matrix(p)


@star_query
def cooccur_pairs(p):
    return st.cooccur_pairs(p)


@text_query
def cooccur_excerpts(p):
    return st.cooccur_pairs(p, level="excerpt")


@star_query
def headline_figures(p):
    return st.headline_figures(p)


@star_query
def rank_codes(p):
    return st.rank_codes(p)


@star_query
def top_codes(p):
    return st.top_codes(p, 10).select("code_id", "plays", "rank")


@text_query
def codebook_stats(p):
    spread = F.array_join(
        F.array_sort(F.transform(F.map_entries("valence"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), SEP
    )
    return st.codebook_stats(p).select("lens", "code_id", "plays", "pct", F.coalesce(spread, F.lit("")).alias("valence"), "anchor_excerpt", "pinned")


@text_query
def project_payload(p):
    return st.project_payload(p)


@star_query
def category_values(p):
    return st.category_values(p).select("column", joined("values"))


@star_query
def measure_columns(p):
    return st.measure_columns(p.with_(measures=()))


@star_query
def facet_candidates(p):
    return st.facet_candidates(p.with_(categories=(), facets=()))


# ---------------------------------------------------------------- audit and reliability


@text_query
def corpus_summary(p):
    return au.corpus_summary(p)


@text_query
def coverage(p):
    return au.coverage(p)


@star_query
def dominance(p):
    return au.dominance(p)


@text_query
def duplicate_passages(p):
    again = p.excerpts.where("start % 7 = 0").withColumn("text", F.concat(F.lit(" "), "text", F.lit("\n")))
    return au.duplicate_passages(p.with_(excerpts=p.excerpts.unionByName(again)))


@text_query
def no_lens_codes(p):
    return au.no_lens_codes(p)


@text_query
def audit_report(p):
    return au.audit_report(holed(p)).select("check", "severity", "n", joined("examples"))


@star_query
def kappa_by_code(p):
    k = au.kappa_by_code(p, A, B)
    return k.select("code_id", "both", "only_a", "only_b", "neither", F.round("agree", 6).alias("agree"), F.round("kappa", 6).alias("kappa"), "band")


@star_query
def kappa_order(p):
    k = au.kappa_by_code(p, A, B).withColumn("kappa", F.round("kappa", 6))
    return au.kappa_order(k).select("code_id", "kappa", "place")


@star_query
def excerpt_order(p):
    return re_.excerpt_order(p.excerpts).select("excerpt_id", "source_id", "place")


@star_query
def frame_order(p):
    return bu.frame_order(p.frame).select("pid", "unit", "place")


@text_query
def kappa_by_code_text(p):
    k = au.kappa_by_code(p, A, B)
    return k.select("code_id", "both", "only_a", "only_b", "neither", F.round("agree", 6).alias("agree"), F.round("kappa", 6).alias("kappa"), "band")


@query
def kappa_band_(spark, sf):
    k = given(spark, sf, "lineitem").select(((F.col("l_quantity") - 5) / 45).alias("k"))
    return k.groupBy(kappa_band(F.col("k")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@text_query
def reliability_overall(p):
    r = au.reliability_overall(p, A, B)
    return r.withColumn("mean_kappa", F.round("mean_kappa", 6)).withColumn("lowest_kappa", F.round("lowest_kappa", 6))


@star_query
def reconcile_list(p):
    return au.reconcile_list(p, A, B).select("excerpt_id", joined("a_only"), joined("b_only"))


@star_query
def overlap_sets(p):
    return au.overlap_sets(p, A, B)


@star_query
def set_operations(p):
    """Excerpts of each coder as sets: shared, and of one coder only."""
    of = lambda who: p.codings.where(F.col("coder") == who).select("excerpt_id")
    return au.set_operations(of(A), of(B), ["excerpt_id"])


@star_query
def coder_pairs(p):
    """Agreement of all pairs among six coders."""
    k = au.coder_pairs(p.with_(codings=p.codings.withColumn("coder", F.concat("coder", (F.col("ord") % 3).cast("string")))))
    return k.select("coder_a", "coder_b", "code_id", "both", "only_a", "only_b", "neither", F.round("agree", 6).alias("agree"), F.round("kappa", 6).alias("kappa"), "band")


@star_query
def valence_agreement(p):
    return au.valence_agreement(p, A, B, STAR_ORDER)


# ---------------------------------------------------------------- valence


@query
def valence_settle(spark, sf):
    return settled(spark, sf).select("excerpt_id", "code_id", "coder", "code_valence", "model_valence", "agreement", "settled")


@query
def valence_agreement_rate(spark, sf):
    return va.valence_agreement_rate(settled(spark, sf))


@text_query
def valence_payload(p):
    return va.valence_payload(va.valence_targets(p).drop("coder"), order=("ord", "code_id"))


@text_query
def judgement_join(p):
    t = va.valence_targets(p)
    order = ("ord", "code_id")
    asked = va.batched(t, 25, order).withColumn(
        "j",
        F.struct(
            "id",
            F.when(F.substring("id", -1, 1) == "3", F.lit("unsure")).when(F.substring("id", -1, 1) == "4", F.lit("NEG ")).otherwise(F.lit("pos")).alias("valence"),
            F.concat(F.lit("about "), "code_id").alias("why"),
        ),
    )
    replies = asked.groupBy("batch").agg(F.to_json(F.struct(F.collect_list("j").alias("judgements"))).alias("reply"))
    return va.judgement_join(t, replies, 25, order)


# ---------------------------------------------------------------- profiles


@query
def column_profile(spark, sf):
    return pr.column_profile(raw_cells(spark, sf)).select("file", "index", "column", "rows", "filled", "distinct", "mean_len", "numeric", joined("examples"))


def profiled(spark, sf):
    return pr.column_profile(raw_cells(spark, sf))


@query
def propose_roles(spark, sf):
    return pr.propose_roles(profiled(spark, sf)).select("file", "column", "role")


@query
def pick_response_table(spark, sf):
    return pr.pick_response_table(profiled(spark, sf))


@query
def best_roster_pid(spark, sf):
    return pr.best_roster_pid(profiled(spark, sf)).select("file", "pid_column", joined("match_columns"))


@query
def redaction_class(spark, sf):
    return pr.redaction_class(profiled(spark, sf)).select("file", "column", "class")


@query
def redacted_digest(spark, sf):
    return pr.redacted_digest(profiled(spark, sf)).select("file", "column", joined("values"))


@query
def value_shape_(spark, sf):
    return given(spark, sf, "customer").groupBy(value_shape("c_name").alias("shape")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- notes and anchors


@text_query
def notes_by_code(p):
    return no.notes_by_code(p).select("lens", "code_id", "plays", "excerpt_id", "coder", "valence", "note", "where")


@text_query
def notes_by_lens(p):
    return no.notes_by_lens(p)


@text_query
def notes_places(p):
    return no.notes_places(p)


@text_query
def notes_search(p):
    return no.notes_haystack(p).select("section", "lens", "key", "ref", F.md5("hay").alias("hay"))


@text_query
def note_categories(p):
    return no.note_categories(p)


@star_query
def lens_for_prefix(p):
    cut = p.codes.withColumn("code_id", F.regexp_replace("code_id", r"\ABRD-(\d)\d", "BRD$1-"))
    return cb.lens_for_prefix(cut)


@text_query
def anchor_pool_median(p):
    return no.anchor_pool_median(p).select("code_id", "median")


@text_query
def anchor_pick(p):
    return no.anchor_pick(p)


@star_query
def code_refs(p):
    return cb.code_refs(p.codes)


# ---------------------------------------------------------------- sampling


@text_query
def sample_quota(p):
    return sa.sample_quota(p.sources, pct=10)


@text_query
def sample_quota_n(p):
    return sa.sample_quota(p.sources, n=37)


@text_query
def stratified_draw(p):
    return sa.stratified_draw(p.sources, pct=10).select("source_id", "kind", "pid", "round")


@text_query
def sample_report(p):
    return sa.sample_report(sa.stratified_draw(p.sources, pct=10))


# ---------------------------------------------------------------- windows, documents, export


@star_query
def dedupe_codings(p):
    return cb.dedupe_codings(p.codings, STAR_ORDER).select("excerpt_id", "code_id", "coder", "valence")


@query
def frame_first_row(spark, sf):
    rows = given(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("pid"), F.col("o_orderstatus").alias("unit"),
        F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("ord"),
    )
    return bu.frame_first_row(rows, ["pid", "unit"])


@text_query
def assemble_documents(p):
    docs, _ = ex.assemble_documents(p)
    return docs.select("doc_id", "name", "pid", F.length("text").alias("chars"), F.md5("text").alias("digest"))


@text_query
def greedy_spans(p):
    wider = p.excerpts.withColumn("end", F.col("end") + 25)
    return re_.greedy_spans(wider).select("source_id", F.array_join(F.transform("spans", lambda s: s["excerpt_id"]), SEP).alias("spans"))


@text_query
def newline_remap(p):
    return ex.newline_remap(p.excerpts.select("excerpt_id", "source_id", "start", "end"), p.sources).select("excerpt_id", *(F.col(c).cast("int").alias(c) for c in ("start", "end")))


@text_query
def shortest_passages(p):
    return ex.shortest_passages(p, ex.document_parts(p)).select("excerpt_id", "doc_id", "name", "start", "end")


@text_query
def export_counts(p):
    return ex.export_counts(p)


@text_query
def export_check(p):
    x = p.excerpts.withColumn("text", F.when(F.col("start") % 13 == 5, F.lit("other words")).otherwise(F.col("text")))
    return ex.export_check(p.with_(excerpts=x))


def placement(p):
    return ex.document_parts(p).select("source_id", "doc_id", "shift")


@text_query
def selections_by_valence(p):
    return ex.selections_by_valence(p, placement(p)).select("doc_id", "excerpt_id", "valence", "start", "end", joined("codes"), "multi")


@text_query
def export_positions(p):
    parts = ex.document_parts(p)
    sel = ex.selections_by_valence(p, parts.select("source_id", "doc_id", "shift"))
    return ex.export_positions(sel, base=1, inclusive=True, parts=parts).select("doc_id", "excerpt_id", "valence", "start", "end")


@text_query
def stable_guid_(p):
    return ex.export_ids(p, ex.selections_by_valence(p, placement(p)))


@query
def duplicate_ids(spark, sf):
    rows = given(spark, sf, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"))
    return ex.duplicate_ids(rows, "id")


@text_query
def case_table(p):
    return ex.case_table(p).select("case_id", "pid", "unit", "name", joined("docs"))


@query
def case_values_long(spark, sf):
    return ex.case_values_long(text_project(spark, sf), derive(spark, sf, ad.ASSIGNMENT))


@text_query
def codebook_tree(p):
    return cb.codebook_tree(p.codes, valence=True)


# ---------------------------------------------------------------- upserts and edits


def second_filing(p):
    """What one coder files next: a code on every passage the other one marked."""
    return p.codings.where("coder = 'jb'").withColumn("coder", F.lit("ann")).withColumn("code_id", F.lit("TXT-1"))


@text_query
def file_upsert_coder(p):
    return fi.file_upsert_coder(p.codings, second_filing(p), "ann").select("excerpt_id", "code_id", "valence", "coder", "note")


@query
def file_upsert_disk(spark, sf):
    """What is stored after one coder's filing was replaced by nothing and the other's by a new one."""
    p, path = text_project(spark, sf), scratch(spark)
    sink_tables(p.codings, path, [f for f in CODINGS.fieldNames() if f != "sheet_row"], partition_by="coder")
    replace_coder(second_filing(p), path, "ann")
    replace_coder(p.codings.limit(0), path, "jb")
    return spark.read.parquet(path).select("excerpt_id", "code_id", "valence", "coder", "note")


@text_query
def excerpt_merge(p):
    new_ids = second_filing(p).select("excerpt_id").distinct()
    new = p.excerpts.join(new_ids, "excerpt_id", "left_semi").withColumn("label", F.lit("new"))
    return fi.excerpt_merge(p.excerpts, p.codings.where("coder = 'ann'"), new).select("excerpt_id", "label", "start", "end")


def span_edit_table(spark, sf):
    return derive(spark, sf, ad.SPAN_EDITS).withColumn("codes", F.array(F.struct("code_id", "valence"))).drop("code_id", "valence")


@query
def span_edits(spark, sf):
    p, rejects = fi.span_edits(text_project(spark, sf), span_edit_table(spark, sf))
    return p.codings.select("excerpt_id", "code_id", "valence", "coder", "note")


@query
def span_edits_rejects(spark, sf):
    return fi.span_edits(text_project(spark, sf), span_edit_table(spark, sf))[1]


@query
def codebook_edits(spark, sf):
    codes, _ = cb.codebook_edits(text_project(spark, sf), derive(spark, sf, ad.CODE_EDITS))
    return codes.select("code_id", "lens", "name", "definition", "valence")


@query
def code_merge(spark, sf):
    _, codings, _ = cb.code_merge(star_project(spark, sf), derive(spark, sf, ad.MERGES), STAR_ORDER)
    return codings.select("excerpt_id", "code_id", "coder", "valence")


@query
def code_merge_register(spark, sf):
    codes, _, retired = cb.code_merge(star_project(spark, sf), derive(spark, sf, ad.MERGES), STAR_ORDER)
    return codes.select("code_id", F.lit("").alias("new_id")).unionByName(retired.select(F.col("old_id").alias("code_id"), "new_id"))


@query
def code_merge_dates(spark, sf):
    _, _, retired = cb.code_merge(star_project(spark, sf), derive(spark, sf, ad.MERGES), STAR_ORDER)
    return retired.select("old_id", "date")


@query
def code_retire(spark, sf):
    p = star_project(spark, sf)
    codes, codings, _ = cb.code_retire(p, derive(spark, sf, ad.MERGES).select("old_id", "note"), force=True, order=STAR_ORDER)
    return codings.join(codes.select("code_id"), "code_id", "left_anti").groupBy("code_id").agg(F.count(F.lit(1)).alias("stranded"))


# ---------------------------------------------------------------- building and transcripts

MAPPING = {
    "pid": "Participant", "unit": "Language title", "text": ["1. What did you think?", "Participant"],
    "categories": ["Start"], "measures": ["Response"], "kind": "survey", "labels": {"Start": "size"},
}


def document_cells(spark, sf):
    return raw_cells(spark, sf).where("file = 'documents.csv'")


@query
def build_sources(spark, sf):
    s = bu.build_sources(document_cells(spark, sf), MAPPING)
    return s.select("source_id", "pid", "unit", "kind", "label", F.md5("text").alias("digest"))


@query
def build_frame(spark, sf):
    return bu.build_frame(document_cells(spark, sf), MAPPING)


@text_query
def has_kind_flag(p):
    asked = p.frame.unionByName(p.frame.where("docs = '1'").withColumn("pid", F.concat("pid", F.lit("-b"))))
    return bu.has_kind_flag(asked, p.sources).select("pid", "unit", "has_interview")


@query
def transcript_parse(spark, sf):
    return tr.transcript_parse(transcript_files(spark, sf))


def spoken(spark, sf):
    return derive(spark, sf, ad.CUES).select("path", F.col("slot").alias("seq"), "t", "who", "text")


@query
def speaker_role(spark, sf):
    return tr.speaker_role(spoken(spark, sf), derive(spark, sf, ad.ROSTER)).select("path", "seq", "speaker")


@query
def deidentify(spark, sf):
    return tr.deidentify(spoken(spark, sf), derive(spark, sf, ad.ROSTER)).select("path", "seq", F.md5("text").alias("digest"))


@query
def turns_merge(spark, sf):
    return tr.turns_merge(derive(spark, sf, ad.TURNS_SPOKEN)).select("path", "seq", "t", "speaker", F.md5("text").alias("digest"))


@query
def transcript_body(spark, sf):
    body = tr.transcript_body(derive(spark, sf, ad.TURNS_SPOKEN))
    return body.select("source_id", "pid", "unit", "kind", "label", F.md5("text").alias("digest"))


# ---------------------------------------------------------------- filing a sheet


@query
def unresolved_report(spark, sf):
    p = sheet_project(spark, sf)
    rows, gated = fi.gate_sheet(p, derive(spark, sf, ad.SHEET))
    hits = ma.match_quotes(rows.select("sheet_row", "nq"), p.sources).join(p.sources.select("source_id", "pid", "unit"), "source_id")
    _, many, none = ma.resolve_unique(ma.hint_narrow(hits, rows), rows)
    shown = rows.select("sheet_row", "quote")
    r5 = many.select("sheet_row", "reason").join(shown, "sheet_row")
    r6 = ma.fuzzy_closest(none.select("sheet_row", "nq"), p.sources).join(shown, "sheet_row")
    return fi.unresolved_report(gated, r5, r6)


@query
def file_sheet(spark, sf):
    _, codings, _ = fi.file_sheet(sheet_project(spark, sf), derive(spark, sf, ad.SHEET), coder="rk")
    return codings
