"""Coded projects derived from the given tables.

Each table is one SQL text that reads the same in Spark and in the checking engine;
``{name}`` stands for a given table and ``end_``, ``exclude_`` for columns whose names
are reserved words there.  ``star`` is a wide, skewed set of codings over
orders; ``text`` has documents, spans and quotes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.project import Project

GIVEN = ("customer", "supplier", "part", "orders", "lineitem", "documents", "benchmark", "labels", "conversations")

# ---------------------------------------------------------------- star

FRAME_STAR = """
select cast(o_custkey as string) pid, cast(o_orderkey as string) unit,
       o_orderpriority priority, o_orderstatus status,
       cast(o_totalprice as string) price, cast(o_orderkey % 97 as string) score
from {orders}
"""

CODES_STAR = """
select distinct upper(replace(p_brand, 'Brand#', 'BRD-')) code_id,
       case when cast(replace(p_brand, 'Brand#', '') as int) % 5 = 0 then ''
            else concat('Lens ', cast(cast(replace(p_brand, 'Brand#', '') as int) % 3 as string)) end lens,
       p_brand name,
       concat('Parts of ', p_brand) definition,
       case when cast(replace(p_brand, 'Brand#', '') as int) % 4 = 0 then 'neg'
            when cast(replace(p_brand, 'Brand#', '') as int) % 4 = 1 then 'pos' else '' end valence,
       concat('Anything by ', p_brand) include,
       concat('Use BRD-', cast((cast(replace(p_brand, 'Brand#', '') as int) * 7) % 40 as string), ' or PRT-X for the rest') exclude_,
       '' anchor, '' note
from {part}
"""

EXCERPTS_STAR = """
select concat('X-', cast(l_orderkey as string), '-', cast(l_linenumber as string)) excerpt_id,
       concat('O-', cast(o_orderkey as string)) source_id,
       cast(o_custkey as string) pid,
       case when l_linenumber = 7 then '' else cast(o_orderkey as string) end unit,
       case when l_linenumber <= 3 then 'survey' when l_linenumber <= 5 then 'diary' else 'interview' end kind,
       l_linenumber * 10 start, l_linenumber * 10 + 8 end_
from (select distinct l_orderkey, l_linenumber from {lineitem}) l join {orders} on l_orderkey = o_orderkey
"""

CODINGS_STAR = """
select concat('X-', cast(l_orderkey as string), '-', cast(l_linenumber as string)) excerpt_id,
       upper(replace(p_brand, 'Brand#', 'BRD-')) code_id,
       case when l_returnflag = 'R' then 'neg' when l_returnflag = 'A' then 'pos'
            when l_quantity > 40 then 'mixed' when l_quantity > 30 then 'neutral' else '' end valence,
       case when l_linestatus = 'O' then 'ann' else 'jb' end coder,
       case when l_suppkey % 50 = 0 then concat('note ', cast(l_partkey as string)) else '' end note,
       l_partkey * 1000000 + l_suppkey * 100 + cast(l_quantity as int) ord
from {lineitem} join {part} on l_partkey = p_partkey
"""

# codes merged in the past: chains of various depth, cycles and retirements
RETIRED = """
select concat('OLD-', cast(p_partkey as string)) old_id,
       case when p_partkey % 11 = 0 then ''
            when p_partkey % 13 = 0 then upper(replace(p_brand, 'Brand#', 'BRD-'))
            when p_partkey % 17 = 0 then concat('OLD-', cast(p_partkey - p_partkey % 34 as string))
            else concat('OLD-', cast(p_partkey + 1 as string)) end new_id,
       '' note, date '2024-01-01' as date
from {part}
"""

# ---------------------------------------------------------------- text

SOURCES_TEXT = """
select concat('S-', lpad(cast(doc_id as string), 6, '0')) source_id,
       cast(cast(floor(doc_id / 10) as bigint) as string) pid,
       case when doc_id % 10 = 9 then '' else lang end unit,
       case when doc_id % 10 = 9 then 'interview' else 'survey' end kind,
       source label, text
from {documents}
"""

EXCERPTS_TEXT = """
select concat('X-', source_id, '-', cast(s as string), '-', cast(e as string)) excerpt_id, source_id,
       pid, unit, kind, label, cast(s as int) start, cast(e as int) end_,
       substring(text, cast(s + 1 as int), cast(e - s as int)) text, doc_id, k
from (select concat('S-', lpad(cast(doc_id as string), 6, '0')) source_id, text, doc_id, k,
             cast(cast(floor(doc_id / 10) as bigint) as string) pid,
             case when doc_id % 10 = 9 then '' else lang end unit,
             case when doc_id % 10 = 9 then 'interview' else 'survey' end kind, source label,
             (doc_id * 13 + k * 57) % (length(text) - 40) s,
             (doc_id * 13 + k * 57) % (length(text) - 40) + 20 + doc_id % 20 e
      from {documents} {three_spans}
      where length(text) >= 48) x
"""

CODINGS_TEXT = """
select excerpt_id, concat('TXT-', cast((doc_id * 7 + k * 5) % 12 as string)) code_id,
       case when (doc_id + k) % 5 = 0 then 'pos' when (doc_id + k) % 5 = 1 then 'neg'
            when (doc_id + k) % 5 = 2 then 'mixed' else '' end valence, 'ann' coder,
       case when (doc_id + k) % 7 = 0 then concat('seen in ', excerpt_id) else '' end note,
       cast(doc_id * 10 + k as bigint) ord, cast(doc_id * 3 + k + 2 as int) sheet_row
from ({excerpts_text}) xa
union all
select excerpt_id, concat('TXT-', cast((doc_id * 7 + k * 5 + case when doc_id % 4 = 0 then 1 else 0 end) % 12 as string)),
       case when doc_id % 2 = 0 then 'pos' else '' end, 'jb', '',
       cast(doc_id * 10 + k + 5 as bigint), cast(doc_id * 3 + k + 2 as int)
from ({excerpts_text}) xb where doc_id % 3 = 0
"""

# codes come from the document numbers: TXT-11 is missing, TXT-12 and TXT-13 unused
CODES_TEXT = """
select concat('TXT-', cast(k as string)) code_id,
       case when k % 5 = 4 then '' else concat('Lens ', cast(k % 3 as string)) end lens,
       concat('Theme ', cast(k as string)) name, concat('What theme ', cast(k as string), ' is about') definition,
       case when k % 4 = 0 then 'pos' when k % 4 = 1 then 'neg' else '' end valence,
       concat('Everything like TXT-', cast((k + 3) % 15 as string)) include,
       concat('Not TXT-', cast((k + 1) % 14 as string), ' nor ABC-', cast(k as string)) exclude_,
       case when k % 6 = 4 then 'X-gone' when k % 6 = 3 then coalesce(xid, '') else '' end anchor, '' note
from (select doc_id % 14 k,
             max(case when doc_id < 14 and length(text) >= 48 then
                 concat('X-S-', lpad(cast(doc_id as string), 6, '0'), '-',
                        cast((doc_id * 13) % (length(text) - 40) as string), '-',
                        cast((doc_id * 13) % (length(text) - 40) + 20 + doc_id % 20 as string)) end) xid
      from {documents} group by doc_id % 14) d where k <> 11
"""

FRAME_TEXT = """
select pid, unit,
       case when max(quality) is null then '' when max(quality) = 1 then 'good' else 'poor' end quality,
       case when max(toxic) is null then '' else cast(max(toxic) as string) end toxic,
       cast(sum(n_chars) as string) chars, cast(count(*) as string) docs
from (select cast(cast(floor(d.doc_id / 10) as bigint) as string) pid,
             case when d.doc_id % 10 = 9 then '' else lang end unit, quality, toxic, n_chars
      from {documents} d left join {labels} l on d.doc_id = l.doc_id) x
where unit <> '' group by pid, unit
"""

NOTES_TEXT = """
select concat('N', cast(doc_id as string)) note_id,
       case when doc_id % 4 = 0 then '' else concat('Area ', cast(doc_id % 3 as string)) end category,
       concat('About ', source) title, concat('Written on ', lang) note,
       case when doc_id % 5 = 0 then '' when doc_id % 5 = 1 then concat('S-', lpad(cast(doc_id as string), 6, '0'))
            when doc_id % 5 = 2 then 'S-none'
            else (concat('X-S-', lpad(cast(doc_id as string), 6, '0'), '-',
                  cast((doc_id * 13) % (length(text) - 40) as string), '-',
                  cast((doc_id * 13) % (length(text) - 40) + 20 + doc_id % 20 as string))) end evidence
from {documents} where length(text) >= 48
"""

# the sheet somebody filled in: benchmark passages as quotes
SHEET = """
select cast(item_id + 2 as int) sheet_row, text quote,
       case when item_id % 13 = 12 then '' when item_id % 13 = 11 then 'NOPE-1; TXT-1'
            else concat('txt-', cast(item_id % 11 as string), case when item_id % 3 = 0 then ' | TXT-2' else '' end) end code,
       case when item_id % 9 = 8 then 'great' when item_id % 4 = 0 then 'Positive' when item_id % 4 = 1 then 'n' else '' end valence,
       concat('row ', cast(item_id as string)) note,
       case when item_id % 9 = 0 then 'PID3' when item_id % 10 = 5 then 'pid 999999' else '' end pid,
       case when item_id % 4 in (0, 3) then 'EN' else '' end unit
from {benchmark}
"""

TURNS = """
select cast(conv_id as string) path, cast(turn as int) seq, cast(turn * 37 as int) t, role speaker, text
from {conversations}
"""

# the same turns with made speakers, so that neighbours can be one turn
TURNS_SPOKEN = """
select concat('rec/', cast(conv_id as string), '-', cast(cast(floor(turn / 50) as int) as string), '.vtt') path,
       cast(turn % 50 as int) seq, cast(turn * 37 as int) t,
       case when turn % 3 = 0 then 'Interviewer' else concat('PID', cast(conv_id as string)) end speaker, text,
       cast(conv_id as string) pid
from {conversations}
"""

# fifty turns of a conversation are one transcript file
CUES = """
select concat('rec/', cast(conv_id as string), '-', cast(cast(floor(turn / 50) as int) as string), '.vtt') path,
       cast(turn % 50 as int) slot, turn,
       concat('00:', lpad(cast(cast(floor(turn % 50 / 2) as int) as string), 2, '0'), ':',
              case when turn % 2 = 0 then '05' else '35' end, '.250 --> 00:59:00.000\n<v ', role, '>', text, '</v>\n') cue,
       cast(cast(floor(turn % 50 / 2) as int) * 60 + case when turn % 2 = 0 then 5 else 35 end as int) t,
       role who, text, conv_id
from {conversations}
"""

ROSTER = """
select distinct concat('rec/', cast(conv_id as string), '-', cast(cast(floor(turn / 50) as int) as string), '.vtt') path,
       cast(conv_id as string) pid,
       case when conv_id % 2 = 0 then 'that user tion please' else 'the assistant s1234567 menta' end blob
from {conversations} where role <> 'assistant'
"""

# people with a unique name word and a common one, and recordings that name some of them
PEOPLE = """
select c_custkey ord, case when c_custkey % 40 = 39 then '' else concat('P-', cast(c_custkey as string)) end pid,
       concat('name', translate(lpad(cast(c_custkey as string), 6, '0'), '0123456789', 'abcdefghij'), ' nation',
              translate(cast(c_nationkey % 3 as string), '012', 'xyz'),
              case when c_custkey % 4 = 0 then concat(' s', lpad(cast(c_custkey as string), 7, '0')) else '' end) blob
from {customer}
"""

RECORDINGS = """
select concat('rec ', cast(s_suppkey as string), '.vtt') path, 'recordings' folder,
       concat('Name', translate(lpad(cast(s_suppkey * 7 as string), 6, '0'), '0123456789', 'abcdefghij'), ' Nation',
              translate(cast(s_nationkey % 3 as string), '012', 'xyz')) speaker,
       case when s_suppkey % 5 = 0 then concat('S', lpad(cast(s_suppkey * 4 as string), 7, '0')) else '' end student
from {supplier}
"""

# codes merged away: every fifth brand into the next
MERGES = """
select distinct upper(replace(p_brand, 'Brand#', 'BRD-')) old_id,
       concat('BRD-', cast(cast(replace(p_brand, 'Brand#', '') as int) + 1 as string)) new_id, 'too fine' note
from {part} where cast(replace(p_brand, 'Brand#', '') as int) % 5 = 3
"""

CODE_EDITS = """
select distinct case when k < 4 then concat('txt-', cast(k as string)) when k < 8 then concat('NEW-', cast(k as string))
                     else concat('bad', cast(k as string)) end code_id,
       case when k < 4 then null when k = 7 then '' else 'Lens 9' end lens,
       case when k < 4 then null else concat('New ', cast(k as string)) end name,
       concat('Edited ', cast(k as string)) definition
from (select doc_id % 10 k from {documents}) d
"""

SPAN_EDITS = """
select doc_id * 2 ord, case when doc_id % 4 = 2 then 'delete' else 'save' end op,
       concat('S-', lpad(cast(doc_id as string), 6, '0')) source_id,
       cast(case when doc_id % 4 = 2 then (doc_id * 13) % (length(text) - 40) else 5 end as int) start,
       cast(case when doc_id % 4 = 2 then (doc_id * 13) % (length(text) - 40) + 20 + doc_id % 20
                 when doc_id % 8 = 1 then length(text) + 10 else 25 end as int) end_,
       case when doc_id % 16 = 3 then 'ZZZ-1' else concat('TXT-', cast(doc_id % 10 as string)) end code_id,
       case when doc_id % 16 = 7 then 'odd' else 'pos' end valence, 'ann' coder, 'edited' note
from {documents} where length(text) >= 48
union all
select doc_id * 2 + 1, 'save', concat('S-', lpad(cast(doc_id as string), 6, '0')), 5, 25,
       'TXT-3', '', 'ann', 'again'
from {documents} where length(text) >= 48 and lang = 'en'
"""

# earlier judgements, and replies of a judge by batch
CACHE = """
select excerpt_id, code_id, case when quality = 0 then 'neg' else 'pos' end model_valence, 'earlier' why
from (select excerpt_id, concat('TXT-', cast((doc_id * 7 + k * 5) % 12 as string)) code_id, doc_id from ({excerpts_text}) xa) x
join {labels} l on x.doc_id = l.doc_id
"""

ASSIGNMENT = """
select distinct cast(cast(floor(doc_id / 10) as bigint) as string) pid,
       case when cast(floor(doc_id / 10) as bigint) % 4 = 3 then ''
            else concat('pass ', cast(cast(floor(doc_id / 10) as bigint) % 2 as string)) end pass,
       case when cast(floor(doc_id / 10) as bigint) % 3 = 0 then 'ann' else 'jb' end coder
from {documents}
"""


# three spans of a document: the two ways to write a list of three beside a row
THREE_LISTED = "cross join (select 0 k union all select 1 union all select 2) ks"
THREE_EXPLODED = "lateral view explode(array(0, 1, 2)) ks as k"


def expand(sql: str, **names: str) -> str:
    """The text for an engine where the given tables go by their own names."""
    tables = {t: t for t in GIVEN} | {"three_spans": THREE_LISTED}
    return sql.format(**tables, excerpts_text=EXCERPTS_TEXT.format(**tables), **names)


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, in the splits that the reader makes."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derive(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run an adapter text over the given tables."""
    if "{excerpts_text}" in sql:
        sql = sql.replace("{excerpts_text}", EXCERPTS_TEXT)
    sql = sql.replace("{three_spans}", THREE_EXPLODED)
    used = {t: given(spark, sf_dir, t) for t in GIVEN if "{" + t + "}" in sql}
    df = spark.sql(sql, **used)
    return df.withColumnsRenamed({"end_": "end", "exclude_": "exclude"})


def star_project(spark: SparkSession, sf_dir: str) -> Project:
    run = lambda sql: derive(spark, sf_dir, sql)
    sources = run(
        "select concat('O-', cast(o_orderkey as string)) source_id, cast(o_custkey as string) pid, "
        "cast(o_orderkey as string) unit, 'order' kind, o_orderpriority label, "
        "concat(o_orderpriority, ' ', o_orderstatus) text from {orders}"
    )
    return Project(
        sources=sources, frame=run(FRAME_STAR), codes=run(CODES_STAR), excerpts=run(EXCERPTS_STAR),
        codings=run(CODINGS_STAR), retired=run(RETIRED),
        categories=("priority", "status"), measures=("price", "score"), unit_label="order",
    )


def text_project(spark: SparkSession, sf_dir: str) -> Project:
    run = lambda sql: derive(spark, sf_dir, sql)
    return Project(
        sources=run(SOURCES_TEXT), frame=run(FRAME_TEXT), codes=run(CODES_TEXT),
        excerpts=run(EXCERPTS_TEXT).drop("doc_id", "k"),
        codings=run(CODINGS_TEXT), notes=run(NOTES_TEXT),
        categories=("quality", "toxic"), measures=("chars", "docs"), unit_label="language",
    )


def raw_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Given tables as raw response tables: (file, ord, cells MAP<STRING, STRING>)."""
    parts = []
    for name, key, columns in RAW_TABLES:
        df = given(spark, sf_dir, name)
        cells = F.create_map(
            *[x for header, c in columns.items() for x in (F.lit(header), F.coalesce(F.col(c).cast("string"), F.lit("")))]
        )
        parts.append(df.select(F.lit(f"{name}.csv").alias("file"), F.expr(key).cast("long").alias("ord"), cells.alias("cells")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# (given table, unique integer order, header -> column)
RAW_TABLES = (
    ("customer", "c_custkey", {"Customer name": "c_name", "Nation id": "c_nationkey", "Account balance": "c_acctbal", "Segment": "c_mktsegment"}),
    ("documents", "doc_id", {"Response": "doc_id", "Language title": "lang", "Participant": "source", "1. What did you think?": "text", "Start": "n_chars"}),
    ("conversations", "conv_id * 1000 + turn", {"PID": "conv_id", "Turn": "turn", "Task role": "role", "2) Said": "text"}),
    ("orders", "o_orderkey", {"Customer id": "o_custkey", "Status": "o_orderstatus", "Total": "o_totalprice", "Priority": "o_orderpriority"}),
)
