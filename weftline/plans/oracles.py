"""For each registered query, the same result in one SQL statement."""

from __future__ import annotations

from weftline.functions.text import FOLD_FROM, FOLD_TO
from weftline.operators.exporting import RULE
from weftline.plans import adapters as ad
from weftline.plans.adapters import expand

ORACLES: dict[str, str] = {}

WS = r"[\t\n\x0b\x0c\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(c):
    return f"regexp_replace({c}, '^{WS}|{WS}$', '', 'g')"


def squash(c):
    return f"trim(regexp_replace({c}, '{WS}', ' ', 'g'))"


def words(c):
    s = squash(c)
    return f"case when {s} = '' then 0 else length({s}) - length(replace({s}, ' ', '')) + 1 end"


def fold(c):
    return f"lower({squash(f'translate({c}, {quoted(FOLD_FROM)}, {quoted(FOLD_TO)})')})"


def pct(a, b, digits=1):
    return f"case when {b} > 0 then round_even(100.0::double * {a} / {b}, {digits}) else 0.0::double end"


def ctes(**named: str) -> str:
    return "with recursive " + ",\n".join(f"{n} as ({q})" for n, q in named.items())


SHARED = dict(
    coded="select c.*, x.source_id, x.pid, x.unit, x.kind from codings c join excerpts x on c.excerpt_id = x.excerpt_id",
    keys="select distinct pid, unit from frame",
    cells="select code_id, pid, unit, count(*) n from coded group by code_id, pid, unit",
    hits="select code_id, c.pid, c.unit from cells c join keys k on c.pid = k.pid and c.unit = k.unit",
    loosely="select distinct code_id, c.pid from cells c left join keys k on c.pid = k.pid and c.unit = k.unit where k.pid is null",
    ranked="select code_id, count(*) plays, cast(row_number() over (order by count(*) desc, code_id) as int) rank from hits group by code_id",
)
STAR = ctes(
    frame=expand(ad.FRAME_STAR), codes=expand(ad.CODES_STAR), excerpts=expand(ad.EXCERPTS_STAR),
    codings=expand(ad.CODINGS_STAR), retired=expand(ad.RETIRED), **SHARED,
)
TEXT = ctes(
    sources=expand(ad.SOURCES_TEXT), frame=expand(ad.FRAME_TEXT), codes=expand(ad.CODES_TEXT),
    excerpts=expand(ad.EXCERPTS_TEXT), codings=expand(ad.CODINGS_TEXT), notes=expand(ad.NOTES_TEXT), **SHARED,
)


def star(name, body, **more):
    extra = "".join(f",\n{n} as ({q})" for n, q in more.items())
    ORACLES[name] = f"{STAR}{extra}\n{body}"


def text(name, body, **more):
    extra = "".join(f",\n{n} as ({q})" for n, q in more.items())
    ORACLES[name] = f"{TEXT}{extra}\n{body}"


def plain(name, body, **named):
    ORACLES[name] = (ctes(**named) + "\n" if named else "") + body


PREVALENCE = f"""
select r.code_id, coalesce(c.name, '') as name, r.plays, (select count(*) from keys) as total,
       {pct('r.plays', '(select count(*) from keys)')} as pct, coalesce(l.loose, 0) as loose
from ranked r left join codes c on r.code_id = c.code_id
left join (select code_id, count(*) loose from loosely group by code_id) l on r.code_id = l.code_id
where r.rank <= 15
"""

# ---------------------------------------------------------------- scans and sinks

text("scan_project", PREVALENCE)
star("sink_tables", """
select coder, count(*) as n, count(distinct excerpt_id) as excerpts, count(*) filter (valence = '') as unjudged,
       count(*) as no_row from codings group by coder
""")
plain("scan_sheets", "select quote, code, valence, note, '' as pid, unit, true as numbered from sheet", sheet=expand(ad.SHEET))
plain("sheet_columns", """
select * from (values ('Quotation', 'quote'), ('CODES', 'code'), ('Direction', 'valence'), ('my-notes', ''), ('Memo', 'note'), ('Game', 'unit')) t("column", field)
""")
plain("scan_tables_dir", """
select "column", count(*) as n, count(distinct value) as distinct_values, min(value) as least from (
  select 'c_name' as "column", c_name as value from customer union all select 'c_mktsegment', c_mktsegment from customer
  union all select 'c_acctbal', cast(c_acctbal as varchar) from customer
  union all select 'o_orderkey', cast(o_orderkey as varchar) from orders union all select 'o_orderstatus', o_orderstatus from orders) t
group by "column"
""")
plain("scan_transcripts", "select cast(count(*) as bigint) as cues, (select string_agg(role, '; ' order by role) from (select distinct role from conversations)) as speakers from conversations")

# ---------------------------------------------------------------- projections

plain("alias_unit", """
select o_orderkey, case when unit <> '' then unit else game end as unit, case when game <> '' then game else unit end as game
from (select o_orderkey, case when o_orderkey % 3 = 0 then o_orderstatus else '' end unit,
             case when o_orderkey % 3 = 1 then o_orderpriority else '' end game from orders)
""")
FOLD_VALENCE = f"""case lower({strip('valence')}) when 'positive' then 'pos' when 'negative' then 'neg' when 'p' then 'pos'
 when 'n' then 'neg' when 'm' then 'mixed' when 'x' then 'neutral' else lower({strip('valence')}) end"""
plain("fold_valence", f"select sheet_row, {FOLD_VALENCE} as valence from sheet", sheet=expand(ad.SHEET))
SPLIT = dict(
    sheet=expand(ad.SHEET),
    bits="select sheet_row, p.i, upper(trim(string_split(regexp_replace(code, '[;|,]', ';', 'g'), ';')[p.i])) code_id from sheet, (select unnest(range(1, 20)) i) p where p.i <= len(string_split(regexp_replace(code, '[;|,]', ';', 'g'), ';'))",
    named="select sheet_row, cast(row_number() over (partition by sheet_row order by i) - 1 as int) pos, code_id from bits where code_id <> ''",
)
plain("split_codes", "select sheet_row, pos, code_id from named", **SPLIT)
text("normalise_text", f"""
select source_id, md5({fold('text')}) as norm, cast(length({fold('text')}) as int) as n,
       cast(case when {fold('text')} = '' then -1 else length(text) - length(regexp_replace(text, '^{WS}', '')) end as int) as first,
       cast(case when {fold('text')} = '' then -1 else length(regexp_replace(text, '{WS}$', '')) end as int) as last_end
from sources
""")
plain("source_id_build", """
select o_orderkey * 3 + 1 as ord, cast(o_custkey as varchar) as pid,
       concat('S-', case when length(cast(o_custkey as varchar)) >= 3 then cast(o_custkey as varchar) else lpad(cast(o_custkey as varchar), 3, '0') end, '-',
              case when n >= 10000 then cast(n as varchar) else lpad(cast(n as varchar), 4, '0') end) as source_id
from (select *, row_number() over (order by o_orderkey) - 1 n from orders)
""")
text("excerpt_id_build", "select concat('X-', source_id, '-', start, '-', end_) as built, excerpt_id from excerpts")
plain("numeric_sort_key", """
select pid, unit, row_number() over (order by case when num is null then 1 else 0 end, coalesce(num, 0), case when num is null then concat(pid, unit) else unit end) as place
from (select case when c_custkey % 3 = 0 then concat('x', c_custkey) else cast(c_custkey as varchar) end pid,
             case when c_custkey % 3 = 0 then null else c_custkey end num, c_mktsegment unit from customer)
""")
LENS_FOR_PREFIX = """
select prefix, lens from (select upper(split_part(code_id, '-', 1)) prefix, lens,
  row_number() over (partition by upper(split_part(code_id, '-', 1)) order by count(*) desc, min(code_id), lens) r
  from {codes} where trim(lens) <> '' group by 1, 2) where r = 1
"""
text("stub_codes", """
select code_id, coalesce(lens, '') as lens, replace(code_id, '-', ' ') as name, '' as definition, '' as valence, '' as include,
       '' as "exclude", '' as anchor, 'stub - needs a definition' as note
from (select distinct code_id from codings where code_id not in (select code_id from codes)) u
left join lp on upper(split_part(u.code_id, '-', 1)) = lp.prefix
""", lp=LENS_FOR_PREFIX.format(codes="codes"))
star("search_haystack", "select code_id, lens, lower(concat_ws(' ', code_id, name, definition, include, exclude_)) as hay from codes")

# ---------------------------------------------------------------- filters

text("filter_sources", """
select source_id, pid, unit from sources s where contains(lower(text), 'the') and kind = 'survey'
and source_id in (select source_id from excerpts)
and source_id in (select source_id from coded where valence = '')
and source_id in (select source_id from coded d left join codes c on d.code_id = c.code_id where coalesce(c.lens, '') = '')
and source_id in (select source_id from facets where quality = 'good')
""", facets="""select s.source_id, case when f.pid is not null then f.quality else coalesce(a.quality, '') end quality,
  case when f.pid is not null then f.toxic else coalesce(a.toxic, '') end toxic
  from sources s left join frame f on s.pid = f.pid and s.unit = f.unit
  left join (select pid, case when min(quality) = max(quality) then min(quality) else '' end quality,
                    case when min(toxic) = max(toxic) then min(toxic) else '' end toxic from frame group by pid) a on s.pid = a.pid""")
plain("sheet_row_gate", """
select sheet_row, case when quote = '' or code = '' then 'row_incomplete' else '' end as reason
from (select sheet_row, trim(quote) quote, trim(code) code from sheet) where quote <> '' or code <> ''
""", sheet=expand(ad.SHEET))

REGISTER = dict(
    retired=expand(ad.RETIRED),
    walk="""select old_id, new_id cur, [old_id] seen, 0 steps from retired
      union all select w.old_id, r.new_id, list_append(w.seen, w.cur), steps + 1 from walk w join retired r on w.cur = r.old_id
      where w.cur <> '' and not list_contains(w.seen, w.cur)""",
    resolved="select old_id, arg_max(cur, steps) new_id from walk group by old_id",
)
KNOWN = dict(
    mapped="""select n.sheet_row, n.pos, coalesce(nullif(r.new_id, ''), n.code_id) code_id from named n left join resolved r on n.code_id = r.old_id""",
    codebook=expand(ad.CODES_TEXT),
    judged="""select s.*, coalesce(j.all_codes, '') all_codes, coalesce(j.bad, '') bad from sheet s left join (
      select sheet_row, string_agg(m.code_id, '; ' order by pos) all_codes,
             string_agg(m.code_id, ', ' order by pos) filter (c.code_id is null) bad
      from mapped m left join codebook c on m.code_id = c.code_id group by sheet_row) j on s.sheet_row = j.sheet_row""",
)
plain("code_known_gate", """
select sheet_row, case when bad = '' then all_codes else '' end as code_ids,
       case when bad = '' then '' else concat('code_undefined: ', bad) end as reason from judged
""", **SPLIT, **REGISTER, **KNOWN)
plain("quote_min_length", f"""
select sheet_row, case when length(nq) >= 8 then nq else '' end as nq,
       case when length(nq) >= 8 then '' else 'quote_below_minimum' end as reason
from (select sheet_row, {fold('quote')} nq from (
 select sheet_row, quote from sheet union all select -sheet_row, substring(quote, 1, 2 + sheet_row % 12) from sheet))
""", sheet=expand(ad.SHEET))
plain("code_id_format", """
select distinct code_id, violation from (
  select code_id, 'malformed id' violation from c where not regexp_full_match(code_id, '[A-Z]{2,5}-[A-Z0-9-]+')
  union all select code_id, 'already exists' from c group by code_id having count(*) > 1
  union all select code_id, 'lens is required' from c where coalesce(trim(lens), '') = ''
  union all select code_id, 'name is required' from c where coalesce(trim(name), '') = '')
""", e=expand(ad.CODE_EDITS), c="select upper(trim(code_id)) code_id, lens, name from (select * from e union all select * from e where code_id like 'NEW%')")
text("span_bounds", """
select excerpt_id, start, end_ as "end", start >= 0 and start < end_ and end_ <= n as ok
from (select x.excerpt_id, cast(start - length(x.text) + 22 as int) start, cast(end_ + start % 3 * 400 as int) end_, length(s.text) n
      from excerpts x join sources s on x.source_id = s.source_id)
""")
text("selection_trim", f"""
select excerpt_id, cast(start + l as int) as start, cast(greatest(start + l, end_ - r) as int) as "end"
from (select excerpt_id, start, end_, length(text) - length(regexp_replace(text, '^{WS}', '')) l,
             length(text) - length(regexp_replace(text, '{WS}$', '')) r from excerpts)
where greatest(start + l, end_ - r) - (start + l) >= 2
""")
plain("numeric_regex", r"""
select regexp_full_match(v, '-?\d+(\.\d+)?') as numeric, count(*) as n, min(v) as least
from (select concat(cast(l_quantity as varchar), case when l_partkey % 2 = 0 then '' else 'kg' end) v from lineitem) group by 1
""")
text("blank_text", f"select source_id, cast({words('text')} as int) as words, case when {words('text')} = 0 then 'empty' else 'tiny' end as class from sources where {words('text')} < 3")
text("restrict_pids", "select source_id, pid from sources where pid in (select pid from assign)", assign=expand(ad.ASSIGNMENT))
text("restrict_kind", "select source_id, kind from sources where kind = 'interview'")
text("usable_sources", f"select source_id from sources where {words('text')} >= 12")

# ---------------------------------------------------------------- matching

MATCH = dict(
    sheet=expand(ad.SHEET), sources=expand(ad.SOURCES_TEXT),
    q=f"select sheet_row, {fold('quote')} nq from sheet",
    s=f"select source_id, pid, unit, text, {fold('text')} n from sources",
    pairs="select sheet_row, source_id, pid, unit, n, nq, text from q join s on contains(n, nq) where length(nq) >= 8",
    slots="select *, unnest(range(0, length(n) - length(nq) + 1)) p from pairs",
    spots="select * from slots where substr(n, p + 1, length(nq)) = nq",
    offs=f"""select source_id, text, i, length(regexp_replace(regexp_replace(left(text, i), '^{WS}', ''), '{WS}', ' ', 'g')) m
      from (select source_id, text, unnest(range(1, length(text) + 1)) i from (select distinct source_id, text from spots))""",
    first_at="select source_id, m, min(i) i from offs group by source_id, m",
    hits="""select t.sheet_row, t.source_id, t.pid, t.unit, cast(a.i - 1 as int) start, cast(b.i as int) end_
      from spots t join first_at a on t.source_id = a.source_id and a.m = t.p + 1
      join first_at b on t.source_id = b.source_id and b.m = t.p + length(t.nq)""",
)
NARROW = dict(
    hints=r"select sheet_row, regexp_replace(trim(pid), '^(?i:pid)\s*', '') hp, lower(trim(unit)) hu from sheet",
    fits="""select h.*, (hp = '' or h.pid = hp) and (hu = '' or contains(lower(h.unit), hu)) ok
      from hits h join hints i on h.sheet_row = i.sheet_row""",
    kept="select * from (select *, bool_or(ok) over (partition by sheet_row) any_ok from fits) where ok or not any_ok",
)
RESOLVE = dict(
    counts="select sheet_row, count(*) n, count(distinct concat(pid, '/', unit)) places from kept group by sheet_row",
    reasons="""select c.sheet_row, concat('hits_many: ', n, ' in ',
      (select string_agg(pl, ', ' order by pl) from (select distinct concat('PID', pid, '/', unit) pl from kept k where k.sheet_row = c.sheet_row))) reason
      from counts c where n > 1""",
)


def longest_block(a: str, b: str) -> str:
    """The longest piece of ``a`` that ``b`` holds as {k: size, ni: minus its place}, or null."""
    pieces = f"flatten(list_transform(range(length({a})), lambda i: list_transform(range(1, length({a}) - i + 1), lambda k: {{'k': k, 'ni': -i}})))"
    return f"list_max(list_filter({pieces}, lambda c: contains({b}, substr({a}, 1 - c.ni, c.k))))"


CLOSEST = dict(
    lost="select sheet_row, nq from q where length(nq) >= 8 and sheet_row not in (select sheet_row from hits)",
    lost_words="select sheet_row, string_split(nq, ' ') w from lost",
    lost_pairs="select sheet_row, w[i] a, w[i + 1] b from (select *, unnest(range(1, len(w))) i from lost_words)",
    lost_grams="select distinct sheet_row, concat(right(a, k), ' ', left(b, 3)) gram from (select *, unnest(range(1, least(3, length(a)) + 1)) k from lost_pairs)",
    held_words="select source_id, string_split(n, ' ') w from s",
    held_pairs="select source_id, w[i] a, w[i + 1] b from (select *, unnest(range(1, len(w))) i from held_words)",
    held_grams="select distinct source_id, concat(right(a, k), ' ', left(b, 3)) gram from (select *, unnest(range(1, least(3, length(a)) + 1)) k from held_pairs)",
    gram_shares="""select l.sheet_row, source_id, count(*)::double / any_value(t.n) share
      from lost_grams l join held_grams h on l.gram = h.gram join (select sheet_row, count(*) n from lost_grams group by all) t on t.sheet_row = l.sheet_row
      group by l.sheet_row, source_id having count(*) >= 0.88 * any_value(t.n) - 1e-9""",
    closest="""select o.sheet_row, coalesce(arg_min(source_id, (-share, source_id)), '') closest_source,
      round_even(coalesce(max(share), 0.0), 2) similarity, case when max(share) is null then 'unmatched' else 'close_match' end reason
      from lost o left join gram_shares g on o.sheet_row = g.sheet_row group by o.sheet_row""",
    near=f"""select sheet_row, source_id, nq, n, text, {longest_block('nq', 'n')} best
      from closest join lost using (sheet_row) join s on s.source_id = closest_source""",
    aimed="""select sheet_row, source_id, text, nq, p, substr(n, p + 1, length(nq)) near_text
      from (select *, strpos(n, substr(nq, 1 - best.ni, best.k)) - 1 p from near)""",
    opened=f"""select sheet_row, nq a, near_text b, {longest_block('nq', 'near_text')} best from aimed
      union all select sheet_row, x.a, x.b, {longest_block('x.a', 'x.b')} from (
        select sheet_row, unnest([{{'a': left(a, -best.ni), 'b': left(b, strpos(b, substr(a, 1 - best.ni, best.k)) - 1)}},
          {{'a': substr(a, 1 - best.ni + best.k), 'b': substr(b, strpos(b, substr(a, 1 - best.ni, best.k)) + best.k)}}]) x
        from opened where best is not null) where x.a <> '' and x.b <> ''""",
    matched="select sheet_row, sum(best.k) m from opened where best is not null group by sheet_row",
    near_offs=f"""select source_id, i, length(regexp_replace(regexp_replace(left(text, i), '^{WS}', ''), '{WS}', ' ', 'g')) m
      from (select source_id, text, unnest(range(1, length(text) + 1)) i from (select distinct source_id, text from aimed))""",
    near_at="select source_id, m, min(i) i from near_offs group by source_id, m",
    misses="""select c.*, cast(x.i - 1 as int) closest_start, cast(y.i as int) closest_end,
      round_even(2.0::double * d.m / (length(nq) + length(near_text)), 2) ratio
      from closest c left join aimed t on c.sheet_row = t.sheet_row left join matched d on d.sheet_row = t.sheet_row
      left join near_at x on x.source_id = t.source_id and x.m = t.p + 1
      left join near_at y on y.source_id = t.source_id and y.m = t.p + length(near_text)""",
)
plain("fuzzy_closest", "select * from misses", **MATCH, **CLOSEST)
plain("match_quotes", 'select sheet_row, source_id, start, end_ as "end" from hits', **MATCH)
plain("hint_narrow", 'select sheet_row, source_id, start, end_ as "end" from kept', **MATCH, **NARROW)
plain("resolve_unique", """
select k.sheet_row, 'filed' as outcome, source_id, start, end_ as "end", '' as reason from kept k join counts c on k.sheet_row = c.sheet_row and n = 1
union all select sheet_row, 'ambiguous', '', -1, -1, reason from reasons
union all select sheet_row, 'unmatched', '', -1, -1, '' from sheet where sheet_row not in (select sheet_row from counts)
""", **MATCH, **NARROW, **{k: v.replace("{unit}", "unit") for k, v in RESOLVE.items()})

# ---------------------------------------------------------------- joins

star("codings_excerpts", "select kind, coder, count(*) as n, count(distinct pid) as pids from coded group by kind, coder")
star("in_frame", "select code_id, pid, unit from hits")
star("loose", "select code_id, pid from loosely")
text("excerpts_sources", """
select excerpt_id, case when s.source_id is null then 'missing'
  when not (x.start >= 0 and x.start < x.end_ and x.end_ <= length(coalesce(s.text, ''))) then 'out_of_bounds'
  when trim(x.text) <> '' and substring(s.text, x.start + 1, x.end_ - x.start) <> x.text then 'drift' else 'ok' end as status
from broken x left join sources s on x.source_id = s.source_id
""", broken="""select excerpt_id, case when start % 11 = 0 then 'S-gone' else source_id end source_id, start,
  case when start % 11 = 1 then end_ + 100000 else end_ end end_, case when start % 11 = 2 then 'changed' else text end as text from excerpts""")
HOLED = dict(
    holed="select * from frame union all select pid, concat(unit, '-later'), quality, toxic, chars, docs from frame where docs = '1'",
    heard="""select source_id, pid, unit, text from sources union all
      select concat('Z-', pid, '-', unit), pid, concat(unit, '-astray'), 'an answer to nothing' from frame where docs = '2'""",
)
text("frame_without_source", "select pid, unit from holed except select pid, unit from heard", **HOLED)
text("source_outside_frame", """
select pid, unit, n, case when unit = '' then 'unitless' else 'real' end as class
from (select pid, unit, count(*) n from heard group by pid, unit) s where not exists (select 1 from holed h where h.pid = s.pid and h.unit = s.unit)
""", **HOLED)
text("orphan_codes", "select code_id, count(*) as n from codings where code_id not in (select code_id from codes) group by code_id")
text("unused_codes", "select code_id from codes where code_id not in (select code_id from codings)")
star("silent_participants", """
select distinct pid from (select cast(o_custkey as varchar) pid from orders union all select concat(o_custkey, '-late') from orders where o_orderpriority = '1-URGENT')
where pid not in (select pid from coded)
""")
plain("register_resolve", "select old_id, new_id from resolved", **REGISTER)
plain("retire_map", """
select coalesce(nullif(r.new_id, ''), c.code_id) as code_id, count(*) as n
from (select concat('OLD-', l_partkey) code_id from lineitem) c left join resolved r on c.code_id = r.old_id group by 1
""", **REGISTER)
TARGETS = dict(targets=f"""select c.excerpt_id, c.code_id, c.coder, c.ord, coalesce(lower(trim(k.valence)), '') code_valence, coalesce(k.name, '') name,
  coalesce(k.definition, '') definition, {strip('x.text')} text, c.note
  from codings c join excerpts x on c.excerpt_id = x.excerpt_id left join codes k on c.code_id = k.code_id
  where c.valence = '' and {strip('x.text')} <> ''""")
text("valence_targets", "select excerpt_id, code_id, coder, code_valence, name, text, note from targets", **TARGETS)
CACHED = dict(cache=expand(ad.CACHE))
text("valence_cache_skip", """
select excerpt_id, code_id, coder from targets t where not exists (select 1 from cache k where k.excerpt_id = t.excerpt_id and k.code_id = t.code_id)
""", **TARGETS, **CACHED)
SETTLE = dict(
    joined="select t.*, coalesce(k.model_valence, '') model_valence from targets t left join cache k on t.excerpt_id = k.excerpt_id and t.code_id = k.code_id",
    settled="""select *, case when code_valence <> '' and model_valence <> '' then case when code_valence = model_valence then 'agree' else 'disagree' end
      when model_valence <> '' then 'model only' when code_valence <> '' then 'code only' else 'no opinion' end agreement,
      case when code_valence <> '' and model_valence <> '' and code_valence <> model_valence then ''
           when model_valence <> '' then model_valence else code_valence end settled from joined""",
)
text("valence_settle", "select excerpt_id, code_id, coder, code_valence, model_valence, agreement, settled from settled", **TARGETS, **CACHED, **SETTLE)
text("valence_agreement_rate", f"""
select agreement, count(*) as n, (select {pct("count(*) filter (agreement = 'agree')", "count(*) filter (agreement in ('agree', 'disagree'))", 0)} from settled) as rate
from settled group by agreement
""", **TARGETS, **CACHED, **SETTLE)
text("valence_apply", """
select c.excerpt_id, c.code_id, c.coder, case when c.valence = '' then coalesce(s.v, '') else c.valence end as valence
from codings c left join (select excerpt_id, code_id, max(settled) v from settled where settled <> '' group by all) s
on c.excerpt_id = s.excerpt_id and c.code_id = s.code_id
""", **TARGETS, **CACHED, **SETTLE)
FACETS = dict(facets="""select s.source_id, case when f.pid is not null then f.quality else coalesce(a.quality, '') end quality,
  case when f.pid is not null then f.toxic else coalesce(a.toxic, '') end toxic
  from sources s left join frame f on s.pid = f.pid and s.unit = f.unit
  left join (select pid, case when min(quality) = max(quality) then min(quality) else '' end quality,
                    case when min(toxic) = max(toxic) then min(toxic) else '' end toxic from frame group by pid) a on s.pid = a.pid""")
text("facets_for_source", "select source_id, quality, toxic from facets", **FACETS)
plain("roster_link", """
select r.path, coalesce(i.pid, n.pid, '') as pid,
       case when i.pid is not null then 'student number' when n.pid is not null then 'name match' else 'unmatched' end as via,
       coalesce(i.evidence, n.evidence, '') as evidence
from recordings r
left join (select path, arg_min(pid, ord) pid, arg_min(sid, ord) evidence from by_id group by path) i on r.path = i.path
left join (select path, any_value(pid) pid, any_value(evidence) evidence from best where n = top group by path having count(*) = 1) n on r.path = n.path
""", people0=expand(ad.PEOPLE), recordings=expand(ad.RECORDINGS),
    people=r"""select ord, regexp_replace(pid, '\D', '', 'g') pid, regexp_extract(blob, '(name[a-j]+)', 1) w1, regexp_extract(blob, '(nation[xyz])', 1) w2,
      regexp_extract(blob, '(s[0-9]{6,8})', 1) sid from people0 where pid <> ''""",
    by_id="select path, ord, pid, sid from recordings join people on lower(student) = sid where student <> ''",
    best="""select path, ord, pid, n, concat_ws(', ', case when h1 then w1 end, case when h2 then w2 end) evidence, max(n) over (partition by path) top from (
      select path, ord, pid, w1, w2, contains(lower(speaker), w1) h1, contains(lower(speaker), w2) h2, cast(contains(lower(speaker), w1) as int) + cast(contains(lower(speaker), w2) as int) n
      from recordings, people) where n >= 2""")
text("notes_evidence", f"""
select note_id, case when n.category = '' then 'Uncategorised' else n.category end as category, evidence,
       coalesce(case when x.excerpt_id is not null then {strip('x.text')} end, case when s.source_id is not null then {strip('s.text')} end, '') as quote,
       case when x.excerpt_id is not null then concat('PID', x.pid) when s.source_id is not null then trim(concat('PID', s.pid, ' · ', s.label), ' ·')
            when evidence <> '' then 'not found' else '' end as where
from notes n left join excerpts x on n.evidence = x.excerpt_id left join sources s on n.evidence = s.source_id
""".replace("as where", 'as "where"'))
CASES = dict(
    who="select distinct pid, case when regexp_full_match(pid, '[0-9]+') then concat('PID', case when length(pid) >= 2 then pid else lpad(pid, 2, '0') end) else pid end label from sources",
    cases="""select concat(f.pid, '|', f.unit) case_id, f.pid, f.unit, concat(w.label, ' · ', f.unit) as name, concat('D-', f.pid, '-', f.unit) docs from frame f join who w on f.pid = w.pid
      union all select concat('loose|', source_id), s.pid, '', concat(w.label, ' · ', kind), source_id from sources s join who w on s.pid = w.pid where s.unit = ''""",
    assign=expand(ad.ASSIGNMENT),
)
text("assignment_attrs", "select case_id, coalesce(pass, '') as pass, coalesce(coder, '') as coder from cases c left join assign a on c.pid = a.pid", **CASES)
text("case_table", "select case_id, pid, unit, name, docs from cases", **CASES)
text("case_values_long", """
select * from (
  select concat(pid, '|', unit) as case_id, 'quality' as variable, 'Text' as type, quality as value from frame
  union all select concat(pid, '|', unit), 'toxic', 'Text', toxic from frame
  union all select concat(pid, '|', unit), 'chars', 'Float', chars from frame
  union all select concat(pid, '|', unit), 'docs', 'Float', docs from frame
  union all select case_id, 'pass', 'Text', pass from cases c join assign a on c.pid = a.pid
  union all select case_id, 'coder', 'Text', coder from cases c join assign a on c.pid = a.pid)
where trim(value) <> ''
""", **CASES)
text("overlap_clash", """
select new_id, arg_min(excerpt_id, (start, excerpt_id)) as excerpt_id from (
  select concat('N-', n.excerpt_id) new_id, e.excerpt_id, e.start from excerpts n join excerpts e
  on n.source_id = e.source_id and n.start + 15 < e.end_ and n.end_ + 9 > e.start) group by new_id
""")

# ---------------------------------------------------------------- figures

star("prevalence", PREVALENCE)
star("valence_mix", f"""
select code_id, valence, n, total, {pct('n', 'total')} as share, declared from (
  select d.code_id, d.valence, count(*) n, cast(sum(count(*)) over (partition by d.code_id) as bigint) total, any_value(k.valence) declared
  from coded d join ranked r on d.code_id = r.code_id and r.rank <= 15 join codes k on d.code_id = k.code_id group by d.code_id, d.valence)
""")
def split_sql(by, top):
    return f"""
select code_id, value, hits, denom, pct, rank, round_even(max(pct) over (partition by code_id) - min(pct) over (partition by code_id), 1) as gap from (
  select r.code_id, r.rank, g.value, coalesce(h.hits, 0) hits, g.denom, {pct('coalesce(h.hits, 0)', 'g.denom')} pct
  from ranked r cross join (select {by} value, count(*) denom from frame group by {by}) g
  left join (select code_id, {by} value, count(*) hits from hits h join frame f on h.pid = f.pid and h.unit = f.unit group by 1, 2) h
  on r.code_id = h.code_id and g.value = h.value where r.rank <= {top})"""


star("split", f"select code_id, value, hits, denom, pct, gap from ({split_sql('priority', 15)})")
star("figure", f"select code_id, value, hits, denom, pct, gap from ({split_sql('status', 5)})")
star("order_by_gap", f"select code_id, value, gap, cast(row_number() over (order by gap desc, rank, value) as int) as place from ({split_sql('status', 15)})")
MEASURED = """
select code_id, measure, round_even(mw, 2) as mean_with, round_even(mo, 2) as mean_without, round_even(mw - mo, 2) as diff, n, rank, slot from (
  select r.code_id, r.rank, m.measure, m.slot, count(*) filter (h.pid is not null) n, count(*) filter (h.pid is null) o,
         avg(v) filter (h.pid is not null) mw, avg(v) filter (h.pid is null) mo
  from (select * from ranked where rank <= 12) r
  cross join (select pid, unit, 'price' measure, 0 slot, cast(price as double) v from frame union all select pid, unit, 'score', 1, cast(score as double) from frame) m
  left join hits h on h.code_id = r.code_id and h.pid = m.pid and h.unit = m.unit group by all)
where n >= 5 and o >= 5 order by abs(round_even(mw - mo, 2)) desc, rank, slot limit 14"""
star("measures", f"select code_id, measure, mean_with, mean_without, diff, n from ({MEASURED})")
star("order_by_abs_diff", f"select code_id, measure, diff, cast(row_number() over (order by abs(diff) desc, rank, slot) as int) as place from ({MEASURED})")
star("dependence", """
select d.code_id, kind, count(*) as n, cast(sum(count(*)) over (partition by d.code_id) as bigint) as total
from coded d join ranked r on d.code_id = r.code_id and r.rank <= 15 group by d.code_id, kind
""")
GRID = dict(
    top12="select code_id, rank from ranked where rank <= 12",
    th="select h.* from hits h join top12 t on h.code_id = t.code_id",
    duo="select x.code_id a, y.code_id b, count(*) n from th x join th y on x.pid = y.pid and x.unit = y.unit group by 1, 2",
)
star("cooccur_matrix", "select p.code_id as a, q.code_id as b, coalesce(n, 0) as n from top12 p cross join top12 q left join duo on a = p.code_id and b = q.code_id", **GRID)
PAIRS = """
select p.a, p.b, p.n as "both", round_even(p.n::double / (x.n + y.n - p.n), 2) as jaccard
from duo p join duo x on x.a = p.a and x.b = p.a join duo y on y.a = p.b and y.b = p.b
join top12 ra on ra.code_id = p.a join top12 rb on rb.code_id = p.b
where ra.rank < rb.rank order by "both" desc, jaccard desc, ra.rank, rb.rank limit 10
"""
star("cooccur_pairs", PAIRS, **GRID)
text("cooccur_excerpts", PAIRS, top12=GRID["top12"],
     th="select distinct d.code_id, excerpt_id from coded d join top12 t on d.code_id = t.code_id",
     duo="select x.code_id a, y.code_id b, count(*) n from th x join th y on x.excerpt_id = y.excerpt_id group by 1, 2")
star("headline_figures", """
select (select count(distinct code_id) from codes) as codes, (select count(distinct lens) from codes where lens <> '') as lenses,
 (select count(*) from keys) as units, (select count(distinct pid) from frame) as participants,
 (select count(distinct excerpt_id) from codings) as excerpts, (select count(*) from codings) as codings,
 (select count(*) from (select distinct pid, unit from hits)) as units_coded
""")
star("rank_codes", "select code_id, plays, rank from ranked")
star("top_codes", "select code_id, plays, rank from ranked where rank <= 10")
ANCHOR = dict(
    pool=f"""select d.code_id, d.excerpt_id, d.ord, length(x.text) len, d.note <> '' noted from coded d join excerpts x on d.excerpt_id = x.excerpt_id where {strip('x.text')} <> ''""",
    mid="select code_id, bool_or(noted) any_noted, coalesce(quantile_cont(len, 0.5) filter (noted), quantile_cont(len, 0.5))::double median from pool group by code_id",
    auto="select p.code_id, arg_min(excerpt_id, (abs(len - median), ord)) excerpt_id from pool p join mid m on p.code_id = m.code_id where noted or not any_noted group by p.code_id",
    pin="select code_id, anchor from codes where anchor in (select excerpt_id from excerpts)",
    picked="select coalesce(a.code_id, p.code_id) code_id, coalesce(p.anchor, a.excerpt_id) excerpt_id, p.anchor is not null pinned from auto a full join pin p on a.code_id = p.code_id",
)
text("anchor_pool_median", "select code_id, median from mid", **ANCHOR)
text("anchor_pick", "select code_id, excerpt_id, pinned from picked", **ANCHOR)
text("codebook_stats", f"""
select case when k.lens = '' then 'Uncategorised' else k.lens end as lens, k.code_id, coalesce(r.plays, 0) as plays,
 {pct('coalesce(r.plays, 0)', '(select count(*) from keys)')} as pct, coalesce(v.valence, '') as valence, p.excerpt_id as anchor_excerpt, p.pinned
from codes k left join ranked r on k.code_id = r.code_id left join picked p on k.code_id = p.code_id
left join (select code_id, string_agg(concat(valence, '=', n), '; ' order by concat(valence, '=', n)) valence
           from (select code_id, valence, count(*) n from coded group by 1, 2) group by code_id) v on k.code_id = v.code_id
""", **ANCHOR)
text("project_payload", f"""
select code_id, plays, {pct('plays', '(select count(*) from keys)')} as pct from (
  select k.code_id, count(distinct (s.pid, s.unit)) filter (s.pid is not null) plays from codes k left join coded d on k.code_id = d.code_id
  left join sources s on d.source_id = s.source_id group by k.code_id)
""")
star("category_values", """
select 'priority' as "column", string_agg(distinct priority, '; ' order by priority) as "values" from frame
union all select 'status', string_agg(distinct status, '; ' order by status) from frame
""")
star("measure_columns", r"""
select c as "column" from (select 'priority' c, bool_and(priority = '' or regexp_full_match(priority, '-?\d+(\.\d+)?')) ok from frame
 union all select 'status', bool_and(status = '' or regexp_full_match(status, '-?\d+(\.\d+)?')) from frame
 union all select 'price', bool_and(price = '' or regexp_full_match(price, '-?\d+(\.\d+)?')) from frame
 union all select 'score', bool_and(score = '' or regexp_full_match(score, '-?\d+(\.\d+)?')) from frame) where ok
""")
star("facet_candidates", r"""
select c as "column", cast(row_number() over (order by num, slot) as int) as rank from (
 select 'priority' c, 0 slot, count(distinct priority) n, bool_and(regexp_full_match(priority, '-?\d+(\.\d+)?')) num from frame
 union all select 'status', 1, count(distinct status), bool_and(regexp_full_match(status, '-?\d+(\.\d+)?')) from frame
 union all select 'price', 2, count(distinct price), bool_and(regexp_full_match(price, '-?\d+(\.\d+)?')) from frame
 union all select 'score', 3, count(distinct score), bool_and(regexp_full_match(score, '-?\d+(\.\d+)?')) from frame)
where n between 2 and 12
""")

# ---------------------------------------------------------------- audit and reliability

text("corpus_summary", f"""
select kind, count(*) as sources, cast(sum(w) as bigint) as words, cast(list_sort(list(w))[count(*) // 2 + 1] as int) as median_words
from (select kind, {words('text')} w from sources) group by kind
""")
text("coverage", f"""
select units, units_coded, {pct('units_coded', 'units', 0)} as pct, participants, participants_quoted from (
 select (select count(*) from keys) units, (select count(*) from (select distinct pid, unit from hits)) units_coded,
 (select count(distinct pid) from sources) participants, (select count(distinct pid) from coded) participants_quoted)
""")
star("dominance", """
select pid, n, round_even(100.0::double * n / (select count(*) from codings), 1) as share, 100.0::double * n / (select count(*) from codings) > 25 as flag
from (select pid, count(*) n from coded group by pid) order by n desc, pid limit 1
""")
text("duplicate_passages", f"""
select lower({strip('text')}) as text, count(*) as n from (select text from excerpts union all select concat(' ', text, chr(10)) from excerpts where start % 7 = 0)
where {strip('text')} <> '' group by 1 having count(*) > 1
""")
text("no_lens_codes", "select code_id from codes where lens = ''")
text("audit_report", f"""
select "check", severity, count(*) as n, string_agg(item, '; ' order by item) filter (r <= 5) as examples from (
 select *, row_number() over (partition by "check" order by item) r from (
  select 'empty_sources' as "check", 'problem' severity, source_id item from heard where {words('text')} = 0
  union all select 'tiny_sources', 'note', source_id from heard where {words('text')} between 1 and 2
  union all select 'frame_without_source', 'problem', concat(pid, '/', unit) from (select pid, unit from holed except select pid, unit from heard)
  union all select 'source_outside_frame', 'problem', concat(pid, '/', unit) from (select distinct pid, unit from heard where unit <> '' except select pid, unit from holed)
  union all select 'duplicate_passages', 'note', t from (select lower({strip('text')}) t from excerpts group by 1 having count(*) > 1) where t <> ''
  union all select 'orphan_codes', 'problem', code_id from (select distinct code_id from codings where code_id not in (select code_id from codes))
  union all select 'unused_codes', 'note', code_id from codes where code_id not in (select code_id from codings)
  union all select 'no_lens_codes', 'note', code_id from codes where lens = ''
  union all select 'silent_participants', 'note', pid from (select distinct pid from heard where pid not in (select pid from coded))))
group by "check", severity
""", **HOLED)
FLAGS = dict(
    flags="select excerpt_id, code_id, bool_or(coder = 'ann') a, bool_or(coder = 'jb') b from codings group by 1, 2",
    touched="select excerpt_id, bool_or(a) by_a, bool_or(b) by_b, bool_and(a = b) same from flags group by 1",
    shared="select excerpt_id from touched where by_a and by_b",
    tally="""select code_id, count(*) filter (a and b) nboth, count(*) filter (a and not b) only_a, count(*) filter (b and not a) only_b,
      (select count(*) from shared) n from flags where excerpt_id in (select excerpt_id from shared) group by code_id""",
    boxes="select *, n - nboth - only_a - only_b neither, (nboth + n - nboth - only_a - only_b)::double / n po, ((nboth + only_a)::double / n) * ((nboth + only_b)::double / n) + ((only_b + n - nboth - only_a - only_b)::double / n) * ((only_a + n - nboth - only_a - only_b)::double / n) pe from tally",
    kappas="select *, case when pe < 1 then (po - pe) / (1 - pe) end kappa from boxes",
)
BAND = "case when {k} is null then 'not defined' when {k} >= 0.81 then 'almost perfect' when {k} >= 0.61 then 'substantial' when {k} >= 0.41 then 'moderate' when {k} >= 0.21 then 'fair' when {k} >= 0 then 'slight' else 'worse than chance' end"
KAPPA = f'''select code_id, nboth as "both", only_a, only_b, neither, round(po, 6) as agree, round(kappa, 6) as kappa, {BAND.format(k="kappa")} as band from kappas'''
star("kappa_by_code", KAPPA, **FLAGS)
star("kappa_order", """
select code_id, kappa, row_number() over (order by kappa is null, kappa, code_id) as place from (select code_id, round(kappa, 6) kappa from kappas)
""", **FLAGS)
star("excerpt_order", "select excerpt_id, source_id, row_number() over (order by source_id, cast(start as bigint), excerpt_id) as place from excerpts")
star("frame_order", "select pid, unit, row_number() over (order by pid, unit) as place from frame")
text("kappa_by_code_text", KAPPA, **FLAGS)
plain("kappa_band", f"select {BAND.format(k='((l_quantity - 5) / 45)')} as band, count(*) as n from lineitem group by 1")
text("reliability_overall", f"""
select (select count(*) from shared) as shared, (select count(*) from touched where by_a and by_b and same) as exact, count(kappa) as codes,
 round(avg(kappa), 6) as mean_kappa, {BAND.format(k='avg(kappa)')} as band, arg_min(code_id, (kappa, code_id)) filter (kappa is not null) as lowest_code, round(min(kappa), 6) as lowest_kappa
from kappas
""", **FLAGS)
star("reconcile_list", """
select excerpt_id, coalesce(string_agg(code_id, '; ' order by code_id) filter (a and not b), '') as a_only,
 coalesce(string_agg(code_id, '; ' order by code_id) filter (b and not a), '') as b_only
from flags where excerpt_id in (select excerpt_id from touched where by_a and by_b and not same) group by excerpt_id
""", **FLAGS)
star("overlap_sets", '''select count(*) filter (by_a and by_b) as "both", count(*) filter (not by_b) as only_a, count(*) filter (not by_a) as only_b from touched''', **FLAGS)
star("set_operations", """
select 'both' as which, count(*) as n from touched where by_a and by_b union all select 'only_a', count(*) from touched where not by_b
union all select 'only_b', count(*) from touched where not by_a
""", **FLAGS)
star("coder_pairs", f"""
select coder_a, coder_b, code_id, nboth as "both", only_a, only_b, neither, round(po, 6) as agree, round(kappa, 6) as kappa, {BAND.format(k='kappa')} as band
from (select *, case when pe < 1 then (po - pe) / (1 - pe) end kappa from (
 select *, (nboth + neither)::double / n po, ((nboth + only_a)::double / n) * ((nboth + only_b)::double / n) + ((only_b + neither)::double / n) * ((only_a + neither)::double / n) pe from (
  select *, n - nboth - only_a - only_b neither from both_of join (select coder_a, coder_b, count(*) n from met group by all) using (coder_a, coder_b))))
""", named="select distinct excerpt_id, code_id, concat(coder, cast(ord % 3 as varchar)) coder from codings",
    who="select distinct excerpt_id, coder from named",
    met="select a.excerpt_id, a.coder coder_a, b.coder coder_b from who a join who b on a.excerpt_id = b.excerpt_id and a.coder < b.coder",
    both_of="""select coder_a, coder_b, code_id, count(*) filter (a and b) nboth, count(*) filter (a and not b) only_a, count(*) filter (b and not a) only_b from (
      select coder_a, coder_b, m.excerpt_id, code_id, bool_or(coder = coder_a) a, bool_or(coder = coder_b) b
      from met m join named d on m.excerpt_id = d.excerpt_id and d.coder in (coder_a, coder_b) group by all) group by all""")
star("valence_agreement", f"""
select same, pairs, {pct('same', 'pairs', 0)} as share from (
 select count(*) filter (va = vb) same, count(*) pairs from (
  select excerpt_id, code_id, arg_max(valence, (ord, valence)) filter (coder = 'ann') va, arg_max(valence, (ord, valence)) filter (coder = 'jb') vb
  from codings where valence <> '' group by 1, 2) where va is not null and vb is not null)
""")

# ---------------------------------------------------------------- valence requests

text("valence_payload", """
select (rn - 1) // 25 as batch, concat('i', (rn - 1) % 25) as id,
 concat('{"id":"i', (rn - 1) % 25, '","code":', to_json(code_id), ',"code_name":', to_json(name), ',"code_definition":', to_json(definition), ',"passage":',
        to_json(text), case when note <> '' then concat(',"coder_note":', to_json(note)) else '' end, '}') as json
from (select *, row_number() over (order by ord, code_id) rn from targets)
""", **TARGETS)
text("judgement_join", """
select excerpt_id, code_id, arg_max(v, rn) as valence, arg_max(why, rn) as why from (
 select excerpt_id, code_id, rn, concat('about ', code_id) why, case when id like '%3' then 'unsure' when id like '%4' then 'neg' else 'pos' end v
 from (select *, concat('i', (rn - 1) % 25) id from (select *, row_number() over (order by ord, code_id) rn from targets)))
where v <> 'unsure' group by excerpt_id, code_id
""", **TARGETS)

# ---------------------------------------------------------------- profiles


def _long(table, key, columns):
    return " union all ".join(
        f"select '{table}.csv' file, {i} idx, {quoted(h)} col, {key} ord, coalesce(cast({c} as varchar), '') raw from {table}"
        for i, (h, c) in enumerate(columns.items())
    )


PROFILE = dict(
    long=" union all ".join(_long(*t) for t in ad.RAW_TABLES),
    vals=f"select *, {strip('raw')} v from long",
    dis="select file, idx, col, v, count(*) n, min(ord) first from vals where raw <> '' group by all",
    firsts="select * from (select *, row_number() over (partition by file, idx order by first) r from dis) where r <= 4",
    profile=r"""select t.file, t.idx, t.col, t."rows", coalesce(d.filled, 0) filled, coalesce(d.n_distinct, 0) n_distinct, coalesce(round_even(d.chars::double / d.filled, 1), 0.0) mean_len,
      coalesce(d.nums::double / d.filled > 0.9, false) isnum, e.examples, e.ex from
      (select file, idx, col, count(*) "rows" from vals group by all) t
      left join (select file, idx, cast(sum(n) as bigint) filled, count(*) n_distinct, sum(n * length(v)) chars, sum(case when regexp_full_match(v, '-?\d+(\.\d+)?') then n else 0 end) nums from dis group by all) d on t.file = d.file and t.idx = d.idx
      left join (select file, idx, string_agg(left(v, 60), '; ' order by first) examples, list(left(v, 60) order by first) ex from firsts group by all) e on t.file = e.file and t.idx = e.idx""",
)
plain("column_profile", """select file, cast(idx as int) as "index", col as "column", "rows", filled, n_distinct as "distinct", mean_len, isnum as "numeric", examples from profile""", **PROFILE)
IDRANK = "case when regexp_matches(lower(col), '(^|[^a-z])pid([^a-z]|$)') then 2 when contains(lower(col), 'participant') then 1 else 0 end"
PID_HINT = r"(?i)participant|\bpid\b|\bid\b|respondent"
ROLES = dict(
    pids=f"""select file, arg_max(col, ({IDRANK}, n_distinct, -idx)) pid from profile where filled > 0 and regexp_matches(col, '{PID_HINT}') and n_distinct > 12 and n_distinct <= "rows" * 0.9 group by file""",
    base="""select p.*, coalesce(p.col = i.pid, false) is_pid, filled = 0 or regexp_matches(col, '(?i)^(start|completion|submitted|timestamp)') skipped,
      n_distinct between 2 and 12 few from profile p left join pids i on p.file = i.file""",
    units="select file, arg_min(col, idx) unit from base where not is_pid and not skipped and few and regexp_matches(col, '(?i)game|title|condition|task|app|session|version') group by file",
    roles="""select b.file, b.idx, b.col, b."rows", case when is_pid then 'pid' when skipped then 'ignored' when b.col = u.unit then 'unit' when mean_len >= 40 and n_distinct > "rows" * 0.5 then 'text'
      when isnum then 'measure' when few then 'category' else 'ignored' end role from base b left join units u on b.file = u.file""",
)
plain("propose_roles", 'select file, col as "column", role from roles', **PROFILE, **ROLES)
plain("pick_response_table", """
select file, bool_or(role = 'pid') as has_pid, count(*) filter (role = 'text') as texts, max("rows") as "rows" from roles group by file
order by has_pid desc, texts desc, "rows" desc, file limit 1
""", **PROFILE, **ROLES)
plain("best_roster_pid", f"""
select i.file, i.pid_column, n.match_columns from
 (select file, arg_max(col, ({IDRANK}, n_distinct, -idx)) pid_column from profile where regexp_matches(col, '{PID_HINT}') and n_distinct > 12 group by file) i
 join (select file, string_agg(col, '; ' order by idx) match_columns from profile where regexp_matches(col, '(?i)name|email|e-mail|student|address') and mean_len > 4 and n_distinct > 12 group by file) n on i.file = n.file
""", **PROFILE)
CLASSES = dict(
    looks="select file, idx, bool_or(regexp_matches(left(v, 60), '[^@ ]+@[^@ ]+[.][A-Za-z]{2,}') or regexp_full_match(trim(left(v, 60)), '[A-Za-z]{0,2}[0-9]{6,9}')) ident, max(length(left(v, 60))) longest from firsts group by all",
    classes="""select p.*, case when mean_len >= 40 or coalesce(longest, 0) >= 60 then 'prose' when mean_len >= 20 and filled::double / greatest(n_distinct, 1) < 3 then 'prose'
      when coalesce(ident, false) or (regexp_matches(col, '(?i)name|email|e-mail|student|address|phone|postcode|birth') and n_distinct > 12) then 'identifying'
      when isnum then 'numeric' else 'category' end class from profile p left join looks l on p.file = l.file and p.idx = l.idx""",
)
plain("redaction_class", 'select file, col as "column", class from classes', **PROFILE, **CLASSES)
SHAPE = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({v}, '\\b[A-Z][A-Za-z]*', chr(1), 'g'), '[A-Za-z]+', 'aa', 'g'), chr(1), 'Aa', 'g'), '[0-9]+', '##', 'g')"
plain("redacted_digest", f"""
select c.file, c.col as "column", case when class = 'prose' then 'prose_withheld'
 when class = 'identifying' then (select string_agg({SHAPE.format(v='left(v, 48)')}, '; ' order by first) from firsts f where f.file = c.file and f.idx = c.idx and r <= 3)
 else examples end as "values" from classes c
""", **PROFILE, **CLASSES)
plain("value_shape", f"select {SHAPE.format(v='left(c_name, 48)')} as shape, count(*) as n from customer group by 1")

# ---------------------------------------------------------------- notes and codebook

NOTED = dict(noted="""select case when coalesce(k.lens, '') = '' then 'Uncategorised' else k.lens end lens, c.code_id, coalesce(r.plays, 0) plays, c.excerpt_id, c.coder, c.valence, c.note,
  concat_ws(' · ', concat('PID', coalesce(x.pid, '?')), nullif(x.unit, ''), nullif(x.kind, '')) place
  from codings c left join excerpts x on c.excerpt_id = x.excerpt_id left join codes k on c.code_id = k.code_id left join ranked r on c.code_id = r.code_id where c.note <> ''""")
text("notes_by_code", 'select lens, code_id, plays, excerpt_id, coder, valence, note, place as "where" from noted', **NOTED)
text("notes_by_lens", """
select lens, row_number() over (order by min(r)) as place, count(*) as codes, cast(sum(n) as bigint) as notes from (
 select lens, code_id, count(*) n, row_number() over (order by max(plays) desc, code_id) r from noted group by lens, code_id) group by lens
""", **NOTED)
text("notes_places", """
select lens, row_number() over (order by first, place) as place, row_number() over (partition by lens order by place) as within, code_id, plays, n as notes from (
 select *, min(place) over (partition by lens) first from (
  select lens, code_id, max(plays) plays, count(*) n, row_number() over (order by max(plays) desc, code_id) place from noted group by lens, code_id))
""", **NOTED)
text("notes_search", f"""
select 'coding' as section, n.lens, n.code_id as key, n.excerpt_id as ref,
 md5(lower(concat_ws(' ', n.code_id, coalesce(k.name, ''), coalesce(k.definition, ''), n.note, coalesce({strip('x.text')}, '')))) as hay
from noted n left join excerpts x on n.excerpt_id = x.excerpt_id left join codes k on n.code_id = k.code_id
union all
select 'standing', '', category, note_id, md5(lower(concat_ws(' ', category, note_id, title, note, coalesce({strip('x.text')}, {strip('s.text')}, '')))) from (
 select note_id, title, note, evidence, case when category = '' then 'Uncategorised' else category end category from notes) n
left join excerpts x on n.evidence = x.excerpt_id left join sources s on n.evidence = s.source_id
""", **NOTED)
text("note_categories", "select case when category = '' then 'Uncategorised' else category end as category, count(*) as n from notes group by 1")
star("lens_for_prefix", LENS_FOR_PREFIX.format(codes="cut"), cut=r"select regexp_replace(code_id, '^BRD-(\d)\d', 'BRD\1-') code_id, lens from codes")
star("code_refs", r"""
select distinct r.code_id, field, ref, k.code_id is not null as known from (
 select code_id, 'include' field, unnest(regexp_extract_all(include, '\b[A-Z]{2,6}-[A-Z0-9][A-Z0-9-]*\b')) ref from codes
 union all select code_id, 'exclude', unnest(regexp_extract_all(exclude_, '\b[A-Z]{2,6}-[A-Z0-9][A-Z0-9-]*\b')) from codes) r left join codes k on r.ref = k.code_id
""")
text("codebook_tree", r"""
select '' as parent, lens as child, lens as label, concat('Lens: ', lens) as description from (select distinct lens from codes)
union all select lens, code_id, code_id, concat_ws(chr(10) || chr(10), name, definition, concat('INCLUDE: ', include), concat('EXCLUDE: ', exclude_), case when valence <> '' then concat('Declared valence: ', valence) end) from codes
union all select case when v = 'Valence' then '' else 'Valence' end, v, v, case when v = 'Valence' then 'Per-coding valence.' else concat('Coding judged ', v, '.') end
 from (select unnest(['Valence', 'pos', 'neg', 'mixed', 'neutral']) v)
""")

# ---------------------------------------------------------------- sampling

SAMPLE = dict(
    usable=f"select * from sources where {words('text')} >= 12",
    quota="select kind, count(*) in_kind, least(count(*), greatest(1, cast(round_even(count(*) * 10.0::double / 100, 0) as bigint))) want from usable group by kind",
    turns="select *, row_number() over (partition by kind, pid order by md5(concat('1|', source_id)), source_id) round from usable",
    drawn="select * from (select t.*, q.want, row_number() over (partition by t.kind order by round, pid) slot from turns t join quota q on t.kind = q.kind) where slot <= want",
)
text("sample_quota", "select kind, in_kind, want from quota", **SAMPLE)
text("sample_quota_n", """
select kind, count(*) as in_kind, least(count(*), greatest(1, cast(round_even(37.0::double * count(*) / (select count(*) from usable), 0) as bigint))) as want from usable group by kind
""", usable=SAMPLE["usable"])
text("stratified_draw", "select source_id, kind, pid, round from drawn", **SAMPLE)
text("sample_report", f"select kind, count(*) as n, cast(sum({words('text')}) as bigint) as words, count(distinct pid) as participants from drawn group by kind", **SAMPLE)

# ---------------------------------------------------------------- windows and documents

star("dedupe_codings", """
select excerpt_id, code_id, coder, valence from (select *, row_number() over (partition by excerpt_id, code_id, coder order by ord, valence) r from codings) where r = 1
""")
plain("frame_first_row", """
select cast(o_custkey as varchar) as pid, o_orderstatus as unit, arg_min(o_orderpriority, o_orderkey) as priority, arg_min(o_totalprice, o_orderkey) as price
from orders group by 1, 2
""")
DOCS = dict(
    lab="select pid, any_value(case when length(pid) >= 2 then concat('PID', pid) else concat('PID', lpad(pid, 2, '0')) end) who from sources group by pid",
    src=f"select s.*, l.who, {strip('text')} body, length(text) - length(regexp_replace(text, '^{WS}', '')) lead from sources s join lab l on s.pid = l.pid",
    alone=f"""select source_id, source_id doc_id, pid, concat(who, ' · ', kind) as name, concat(who, ' · ', kind, chr(10), kind, ' · ', label, ' · ', source_id, chr(10), '{RULE}', chr(10), chr(10)) head, concat(body, chr(10)) piece, lead from src where unit = ''""",
    heads=f"""select pid, unit, concat('D-', pid, '-', unit) doc_id, concat(any_value(who), ' · ', unit) as name,
      concat(any_value(who), ' · ', unit, chr(10), string_agg(distinct kind, '/' order by kind), ' · ', count(*), case when count(*) = 1 then ' source' else ' sources' end, ' · ', string_agg(source_id, ', ' order by source_id), chr(10), '{RULE}', chr(10), chr(10)) head
      from src where unit <> '' group by pid, unit""",
    members="""select s.source_id, h.doc_id, h.pid, h.name, h.head, concat(label, chr(10), chr(10), body, chr(10), chr(10)) piece, length(label) + 2 title, lead,
      coalesce(sum(length(concat(label, chr(10), chr(10), body, chr(10), chr(10)))) over (partition by h.doc_id order by s.source_id rows between unbounded preceding and 1 preceding), 0) before
      from src s join heads h on s.pid = h.pid and s.unit = h.unit""",
    place="select source_id, doc_id, cast(length(head) - lead as bigint) shift, name from alone union all select source_id, doc_id, cast(length(head) + before + title - lead as bigint), name from members",
    docs=f"""select doc_id, name, pid, concat(head, piece) text from alone
      union all select doc_id, any_value(name), any_value(pid), concat(regexp_replace(concat(any_value(head), string_agg(piece, '' order by source_id)), '{WS}$', ''), chr(10)) from members group by doc_id""",
)
text("assemble_documents", "select doc_id, name, pid, cast(length(text) as int) as chars, md5(text) as digest from docs", **DOCS)
text("doc_place_shift", "select excerpt_id, p.doc_id, shift from excerpts x join place p on x.source_id = p.source_id", **DOCS)
text("shortest_passages", """
select excerpt_id, p.doc_id, name, start + shift as start, end_ + shift as "end" from (select * from excerpts order by length(text), excerpt_id limit 5) x join place p on x.source_id = p.source_id
""", **DOCS)
text("export_counts", """
select (select count(*) from (select distinct case when unit = '' then source_id else concat(pid, '|', unit) end from sources)) as files, (select count(*) from sources) as sources,
 cast(sum(k) as bigint) as selections, cast(sum(n) + sum(k) as bigint) as codings, (select count(*) from codes) as codes, (select count(*) from frame) as cases,
 (select count(*) from notes) as notes, count(*) filter (k > 1) as split_passages
from (select excerpt_id, count(distinct valence) k, count(*) n from codings group by excerpt_id)
""")
text("export_check", """
select excerpt_id as object_id, 'text_drift' as problem from excerpts where start % 13 = 5
union all select distinct code_id, 'code_undefined' from codings where code_id not in (select code_id from codes)
union all select source_id, 'wide_characters' from sources where regexp_matches(text, '[\\x{10000}-\\x{10FFFF}]')
union all select x.excerpt_id, concat('span_misplaced: ', p.doc_id) from excerpts x join place p on x.source_id = p.source_id join docs d on p.doc_id = d.doc_id
 where start % 13 <> 5 and substring(d.text, cast(start + shift + 1 as int), end_ - start) <> x.text
""".replace("\\\\", "\\"), **DOCS)
SELECTIONS = dict(
    groups="select excerpt_id, lower(trim(valence)) valence, string_agg(distinct code_id, '; ' order by code_id) codes from codings group by 1, 2",
    sel="""select p.doc_id, g.excerpt_id, g.valence, x.start + p.shift as start, x.end_ + p.shift as end_, g.codes, count(*) over (partition by g.excerpt_id) > 1 multi
      from groups g join excerpts x on g.excerpt_id = x.excerpt_id join place p on x.source_id = p.source_id""",
)
text("selections_by_valence", 'select doc_id, excerpt_id, valence, start, end_ as "end", codes, multi from sel', **DOCS, **SELECTIONS)
text("export_positions", """
select s.doc_id, excerpt_id, valence, start + length(left(text, start)) - length(replace(left(text, start), chr(10), '')) + 1 as start,
 end_ + length(left(text, end_)) - length(replace(left(text, end_), chr(10), '')) as "end" from sel s join docs d on s.doc_id = d.doc_id
""", **DOCS, **SELECTIONS)
GUID = """upper(concat(h[1:8], '-', h[9:12], '-5', h[14:16], '-', substr('89ab', cast(('0x' || h[17:17])::int % 4 + 1 as int), 1), h[18:20], '-', h[21:32]))"""
text("stable_guid", f"select object_id, {GUID} as guid from (select object_id, sha1(unhex('6f1b0c2e9a3d5e478b214c7d0e9a1f36') || encode(name)) h from named)", **DOCS, **SELECTIONS,
     ids="select case when multi then concat(excerpt_id, '|', valence) else excerpt_id end object_id, 'sel:' pre from sel union all select concat(excerpt_id, '|', code_id, '|', coder), 'coding:' from codings",
     named="select object_id, concat(pre, object_id) as name from ids")
plain("duplicate_ids", "select concat(l_orderkey, '-', l_linenumber) as id, count(*) as n from lineitem group by 1 having count(*) > 1")
text("greedy_spans", """
select source_id, string_agg(excerpt_id, '; ' order by start) as spans from walk group by source_id
""", sp="select source_id, excerpt_id, start, end_ + 25 end_ from excerpts",
     firsts="select * from (select *, row_number() over (partition by source_id, start order by excerpt_id) r from sp) where r = 1",
     walk="""select source_id, excerpt_id, start, end_ from (select *, row_number() over (partition by source_id order by start) r1 from firsts) where r1 = 1
      union all select source_id, excerpt_id, start, end_ from (select f.source_id, f.excerpt_id, f.start, f.end_, row_number() over (partition by f.source_id order by f.start) k
        from walk w join firsts f on w.source_id = f.source_id and f.start >= w.end_) where k = 1""")
text("newline_remap", """
select excerpt_id, cast(start + length(left(s.text, start)) - length(replace(left(s.text, start), chr(10), '')) as int) as start,
 cast(end_ + length(left(s.text, end_)) - length(replace(left(s.text, end_), chr(10), '')) as int) as "end" from excerpts x join sources s on x.source_id = s.source_id
""")

# ---------------------------------------------------------------- upserts and edits

NEXT = dict(nxt="select excerpt_id, 'TXT-1' code_id, valence, 'ann' coder, note from codings where coder = 'jb'")
text("file_upsert_coder", "select excerpt_id, code_id, valence, coder, note from codings where coder <> 'ann' union all select * from nxt", **NEXT)
text("file_upsert_disk", "select * from nxt", **NEXT)
text("excerpt_merge", """
select excerpt_id, case when excerpt_id in (select excerpt_id from nxt) then 'new' else label end as label, start, end_ as "end" from excerpts
where excerpt_id in (select excerpt_id from nxt) or excerpt_id in (select excerpt_id from codings where coder = 'ann')
""", **NEXT)
EDITS = dict(
    e0=expand(ad.SPAN_EDITS),
    e="select e0.*, concat('X-', e0.source_id, '-', start, '-', end_) xid, length(s.text) n from e0 left join sources s on e0.source_id = s.source_id",
    rejects="""select ord, xid excerpt_id, 'span_outside_text' reason from e where op = 'save' and not (start >= 0 and start < end_ and end_ <= n)
      union select ord, xid, concat('code_undefined: ', code_id) from e where op = 'save' and code_id not in (select code_id from codes)
      union select ord, xid, concat('valence_undefined: ', valence) from e where op = 'save' and valence not in ('', 'pos', 'neg', 'mixed', 'neutral')""",
    lasts="select * from (select *, row_number() over (partition by xid, coder order by ord desc) r from e where ord not in (select ord from rejects)) where r = 1",
)
text("span_edits_rejects", "select ord, excerpt_id, reason from rejects", **EDITS)
text("span_edits", """
select excerpt_id, code_id, valence, coder, note from codings c where not exists (select 1 from lasts l where l.xid = c.excerpt_id and l.coder = c.coder)
union all select xid, code_id, valence, coder, note from lasts where op = 'save'
""", **EDITS)
text("codebook_edits", """
select code_id, lens, name, definition, valence from codes where code_id not in (select code_id from g)
union all select g.code_id, coalesce(g.lens, c.lens, ''), coalesce(g.name, c.name, ''), g.definition, coalesce(c.valence, '') from g left join codes c on g.code_id = c.code_id
where c.code_id is not null or (regexp_full_match(g.code_id, '[A-Z]{2,5}-[A-Z0-9-]+') and trim(g.lens) <> '' and trim(g.name) <> '')
""", g=f"select upper(trim(code_id)) code_id, lens, name, definition from ({expand(ad.CODE_EDITS)})")
MERGED = dict(
    merges=expand(ad.MERGES),
    moved="select excerpt_id, coalesce(m.new_id, c.code_id) code_id, coder, valence, ord from codings c left join merges m on c.code_id = m.old_id",
)
star("code_merge", "select excerpt_id, code_id, coder, valence from (select *, row_number() over (partition by excerpt_id, code_id, coder order by ord, valence) r from moved) where r = 1", **MERGED)
star("code_merge_register", "select code_id, '' as new_id from codes where code_id not in (select old_id from merges) union all select old_id, new_id from retired union all select old_id, new_id from merges", **MERGED)
star("code_merge_dates", "select old_id, date from retired where old_id not in (select old_id from merges) union all select old_id, current_date from merges", **MERGED)
star("code_retire", "select code_id, count(*) as stranded from (select distinct excerpt_id, code_id, coder from codings) where code_id in (select old_id from merges) group by code_id", **MERGED)

# ---------------------------------------------------------------- building and transcripts

plain("build_sources", f"""
select concat('S-', pid, '-', case when n >= 10000 then cast(n as varchar) else lpad(cast(n as varchar), 4, '0') end) as source_id, pid, unit, 'survey' as kind,
 regexp_replace(header, '^\\d+[\\.\\)]\\s*', '') as label, md5(text) as digest from (
 select *, row_number() over (order by doc_id, slot) - 1 n from (
  select doc_id, 0 slot, '1. What did you think?' header, trim(source) pid, trim(lang) unit, {strip('text')} text from documents
  union all select doc_id, 1, 'Participant', trim(source), trim(lang), trim(source) from documents) where pid <> '' and text <> '')
""")
plain("build_frame", """
select source as pid, lang as unit, arg_min(cast(n_chars as varchar), doc_id) as size, arg_min(cast(doc_id as varchar), doc_id) as "Response" from documents group by 1, 2
""")
text("has_kind_flag", """
select pid, unit, case when pid in (select pid from sources where kind = 'interview') then 'yes' else 'no' end as has_interview
from (select pid, unit from frame union all select concat(pid, '-b'), unit from frame where docs = '1')
""")
CUES = dict(cues=expand(ad.CUES), roster=expand(ad.ROSTER))
plain("transcript_parse", f"""
select path, cast(row_number() over (partition by path order by slot) - 1 as int) as seq, t, who, {squash('text')} as text from cues qualify {squash('text')} <> ''
""", **CUES)
SPOKE = "case when c.who = (case when conv_id % 2 = 0 then 'user' else 'assistant' end) then concat('PID', r.pid) else 'Interviewer' end"
plain("speaker_role", f"select c.path, cast(c.slot as int) as seq, {SPOKE} as speaker from cues c join roster r on c.path = r.path", **CUES)
plain("deidentify", """
select c.path, c.slot as seq, md5(case when r.pid is null then text when conv_id % 2 = 0 then
  regexp_replace(regexp_replace(regexp_replace(text, '(?i)that', 'PID' || r.pid, 'g'), '(?i)tion', 'PID' || r.pid, 'g'), '(?i)user', 'PID' || r.pid, 'g')
  else regexp_replace(regexp_replace(text, '(?i)assistant', 'PID' || r.pid, 'g'), '(?i)menta', 'PID' || r.pid, 'g') end) as digest
from cues c left join roster r on c.path = r.path
""", **CUES)
TURNS = dict(
    turns=expand(ad.TURNS_SPOKEN),
    marks="select *, case when lag(speaker) over w is distinct from speaker then 1 else 0 end began from turns window w as (partition by path order by seq)",
    isles="select *, sum(began) over (partition by path order by seq) isle from marks",
)
plain("turns_merge", """
select path, min(seq) as seq, arg_min(t, seq) as t, any_value(speaker) as speaker, md5(string_agg(text, ' ' order by seq)) as digest from isles group by path, isle
""", **TURNS)
plain("transcript_body", """
select concat('I-', case when length(pid) >= 3 then pid else lpad(pid, 3, '0') end) as source_id, pid, '' as unit, 'interview' as kind,
 concat(count(*), ' turns, ', arg_max(t, seq) // 60, ' min') as label,
 md5(string_agg(concat('[', t // 60, ':', lpad(cast(t % 60 as varchar), 2, '0'), '] ', speaker, ': ', text), chr(10) || chr(10) order by seq)) as digest
from turns group by path, pid
""", turns=TURNS["turns"])

# ---------------------------------------------------------------- filing a sheet

FILING = {**SPLIT, **REGISTER, **KNOWN, **{k: v for k, v in MATCH.items() if k not in ("sheet", "q")}}
GATED = dict(
    gated=f"""select *, trim(quote) as q0, {FOLD_VALENCE} val, {fold('quote')} nq from judged where trim(quote) <> '' or trim(code) <> ''""",
    outcome="""select *, case when q0 = '' or trim(code) = '' then 'row_incomplete' when bad <> '' then concat('code_undefined: ', bad)
      when val not in ('', 'pos', 'neg', 'mixed', 'neutral') then concat('valence_undefined: ', val) when length(nq) < 8 then 'quote_below_minimum' end problem from gated""",
    q="select sheet_row, nq from outcome where problem is null",
)


def filing(name, body, unit):
    order = ["sheet", "bits", "named", "retired", "walk", "resolved", "mapped", "codebook", "judged"]
    parts = {k: FILING[k] for k in order}
    parts |= GATED
    parts |= {k: FILING[k] for k in ("sources", "s", "pairs", "slots", "spots", "offs", "first_at", "hits")}
    parts |= NARROW
    parts |= {k: v.replace("{unit}", unit) for k, v in RESOLVE.items()}
    parts |= CLOSEST
    plain(name, body, **parts)


filing("unresolved_report", f"""
select sheet_row, {strip('quote')} as quote, problem as reason, '' as closest_source, null::double as similarity,
  null::int as closest_start, null::int as closest_end, null::double as ratio from outcome where problem is not null
union all select r.sheet_row, {strip('o.quote')}, reason, '', null, null, null, null from reasons r join outcome o on r.sheet_row = o.sheet_row
union all select c.sheet_row, {strip('o.quote')}, c.reason, closest_source, similarity, closest_start, closest_end, ratio from misses c join outcome o on c.sheet_row = o.sheet_row
""", "language")
filing("file_sheet", f"""
select concat('X-', k.source_id, '-', k.start, '-', k.end_) as excerpt_id, m.code_id, o.val as valence, 'rk' as coder, o.note, o.sheet_row
from kept k join counts c on k.sheet_row = c.sheet_row and c.n = 1 join outcome o on k.sheet_row = o.sheet_row join mapped m on m.sheet_row = o.sheet_row
""", "language")
