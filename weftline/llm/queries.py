"""The registered queries of the operators, with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from weftline.llm import (
    attribution, chat, decontaminate, language, line_runs, packing, phrases, secrets, simhash, token_files, toxicity, vector_codes,
    weighted_sampling,
)
from weftline.llm.common import documents, held_out, scratch, written

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-ids")
    token_files.write_token_ids(documents(spark, sf_dir), path, public_tokenizers.path(WORD_BPE), end_id=2)
    return token_files.read_token_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path(BYTE_BPE), end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(documents(spark, sf_dir))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "learned")
    return found.select(
        "doc_id", of("assign"), of("access"), of("hex"), F.sha2(secrets.spans_text(base), 256).alias("base_sha256"),
        secrets.spans_text(F.col("spans")).alias("spans"), of("learned"),
    )


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language.fit(docs.where(~held_out()))
    named = language.identify(docs.select("doc_id", "text"), model)
    return named.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_sampling.edited_fingerprints(documents(spark, sf_dir))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    model = toxicity.fit(docs.where(~held_out()).select("doc_id", "text"), labels.where(~held_out()))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.count_section_tokens(documents(spark, sf_dir), public_tokenizers.path(BYTE_BPE), rule="largest")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    trap = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", trap), (-7, 1, "assistant", trap)], turns.schema)
    return chat.read_back(chat.format_segments(turns.union(more)))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.find_passages(documents(spark, sf_dir).select("doc_id", "text"), items)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda s, h: s + h["last"] - h["first"] + 1)
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
    ).withColumn("contaminated", F.col("n_hit") > 0)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    coded = written(coded.select("vec_id", "label", vector_codes.hex_code(F.col("codes")).alias("code"), "error"), "vector-codes")
    totals = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    joined = coded.join(totals, F.col("label").eqNullSafe(F.col("of")))
    digest = F.sha2(F.lit(books.text() if books else ""), 256)
    return joined.select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_runs.drop_repeated_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine_phrases(documents(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_files, op2_packing, op3_secrets, op4_language, op5_fingerprints, op6_toxicity, op7_token_counts, op8_chat,
        op9_decontamination, op10_simhash, op11_vector_codes, op12_line_dedup, op13_phrases,
    )
} | {"pipeline": corpus_pipeline.run}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"



def _vector_codes_sql(rounds: int = 4) -> str:
    """Assignment and means, ``rounds`` times, and the last assignment."""

    def assigned(r: int) -> str:
        return f"""a{r} as materialized (
  select rid, p, any_value(q) as q, min({{'d': d, 'e': e}}) as m from (
    select rid, p, e, q, list_sum(list_transform(list_zip(q, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as d from parts join b{r} using (p)
  ) group by rid, p)"""

    def moved(r: int) -> str:
        return f"""m{r} as (
  select p, e, list((s - ((s % n) + n) % n) // n order by i) as c from (
    select p, e, i, sum(x) as s, count(*) as n from (
      select p, m.e as e, unnest(q) as x, generate_subscripts(q, 1) as i from a{r}) group by p, e, i) group by p, e
), b{r + 1} as materialized (select p, e, coalesce(n.c, o.c) as c from b{r} o left join m{r} n using (p, e))"""

    steps = ", ".join(f"{assigned(r)}, {moved(r)}" for r in range(rounds))
    return f"""
with kept as materialized (
  select row_number() over (order by vec_id) as rid, vec_id, label,
    list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as hugeint)) as v
  from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), parts as materialized (
  select rid, p, list_slice(v, p * (len(v) // 4) + 1, (p + 1) * (len(v) // 4)) as q from kept, range(4) t(p)
), b0 as materialized (select p, rid - 1 as e, q as c from parts where rid <= 256), {steps}, {assigned(rounds)}
, named as (
  select k.vec_id, k.label, string_agg(printf('%02x', m.e), '' order by p) as code, cast(sum(m.d) as bigint) as error
  from a{rounds} join kept k using (rid) group by k.rid, k.vec_id, k.label
), totals as (select label, cast(sum(error) as bigint) as label_error from named group by label
), books as (
  select sha256(string_agg(cast(x as varchar), ',' order by p, e, i)) as codebooks_sha256
  from (select p, e, unnest(c) as x, generate_subscripts(c, 1) as i from b{rounds}))
select n.vec_id, n.code, n.error, t.label_error, codebooks_sha256
from named n join totals t on n.label is not distinct from t.label, books"""


_LINE_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLES = {
    "op11_vector_codes": _vector_codes_sql(),
    "op12_line_dedup": rf"""
with split as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents
), l as (select doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as i from split
), k as (select *, translate(trim(line, {_LINE_BLANKS}), '{_UPPER}', '{_LOWER}') as key from l
), often as (
  select key, max(doc_id) as last from k where length(key) >= 20 group by key having count(distinct doc_id) >= 3
), told as (select doc_id, i, line, last is not null and last <> doc_id as gone from k left join often using (key))
select doc_id, count(*) as n_lines, cast(count(*) filter (gone) as bigint) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
from told group by doc_id""",
    "op13_phrases": rf"""
with pieces as materialized (
  select lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') as w from (
    select coalesce(lang, 'und') as lang,
      unnest(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) as piece from documents)
), runs as (
  select lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') as phrase from (
    select lang, w, k, unnest(generate_series(1, len(w) - k + 1)) as i from pieces, range(1, 5) t(k) where len(w) >= k)
), f as materialized (select lang, k, phrase, count(*) as f from runs group by all having count(*) >= 30
), n as (select lang, sum(len(w)) as n from pieces group by lang
), cuts as (
  select lang, k, phrase, f as a, unnest(range(1, k)) as cut, string_split(phrase, ' ') as w from f where k > 1
), cut_scores as (
  select c.lang, c.k, c.phrase, c.a, c.cut, x.f as l, y.f as r, cast(2000000::hugeint * c.a // (x.f::hugeint + y.f) as bigint) as score
  from cuts c join f x on x.lang = c.lang and x.phrase = array_to_string(list_slice(w, 1, cut), ' ')
  join f y on y.lang = c.lang and y.phrase = array_to_string(list_slice(w, cut + 1, c.k), ' ')
), candidates as materialized (
  select lang, k, phrase, a, m.l as l, m.r as r, m.score as score from (
    select lang, k, phrase, a, min({{'score': score, 'cut': cut, 'l': l, 'r': r}}) as m from cut_scores group by all)
), inside as (
  select lang, phrase, max(a) as most from (
    select lang, a, array_to_string(list_slice(w, i, i + s - 1), ' ') as phrase from (
      select lang, a, w, s, unnest(generate_series(1, k - s + 1)) as i from (
        select lang, a, k, string_split(phrase, ' ') as w, unnest(range(2, k)) as s from candidates where k > 2)))
  group by lang, phrase
), left_over as (
  select c.* from candidates c left join inside i using (lang, phrase) where i.most is null or 100 * i.most::hugeint < 80 * c.a::hugeint
), ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from left_over)
select lang, rank, phrase, a, l, r, cast(n as bigint) as n, score from ranked join n using (lang) where rank <= 2000""",
    "op8_chat": r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), placed as (
  select *, lag(role, 1, '') over (partition by conv_id order by turn, role, text) as before,
    case when role in ('system', 'user', 'assistant') then '### ' || upper(role[1]) || role[2:] || ': '
      else '### Role: ' || regexp_replace(role, '(\\|### (System|User|Assistant|Role):|</turn>)', '\\\1', 'g') || chr(10) end
    || regexp_replace(text, '(\\|### (System|User|Assistant|Role):|</turn>)', '\\\1', 'g') || ' </turn>' || chr(10) as shown
  from turns
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(string_agg(case when role = 'assistant' then text else '' end, '' order by turn, role, text)) as loss_sha256,
  cast(sum(length(shown)) as bigint) as formatted_chars,
  bool_and((before = '' and role in ('system', 'user')) or (before = 'system' and role = 'user')
    or (before = 'user' and role = 'assistant') or (before = 'assistant' and role = 'user')) as valid
from placed group by conv_id""",
    "op9_decontamination": rf"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), b as (
  select cast(item_id as varchar) as item_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark where text is not null
), windows as (
  select distinct item_id, size, list_slice(w, i, i + size - 1) as run from (
    select item_id, w, least(10, len(w)) as size, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) as i from b where len(w) > 0)
), runs as (
  select doc_id, i, size, list_slice(w, i, i + size - 1) as run from (
    select doc_id, w, s.size, unnest(generate_series(1, len(w) - s.size + 1)) as i from d, (select distinct size from windows) s where len(w) >= s.size)
), hit as (select r.doc_id, r.i, r.size, m.item_id from runs r join windows m on r.run = m.run and r.size = m.size
), words as (select distinct doc_id, unnest(generate_series(i, i + size - 1)) as at from hit
), n as (select doc_id, count(*) as n_hit from words group by doc_id
), m as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as names from (select distinct doc_id, item_id from hit) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join n using (doc_id) left join m using (doc_id)""",
}
