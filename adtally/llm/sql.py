"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from adtally.llm.queries import MIX_EPOCHS, MIX_WEIGHTS

SQL: dict[str, str] = {}

_WEIGHTS = ", ".join(f"('{level}', '{name}', {weight})" for level, name, weight in MIX_WEIGHTS)


def _shared(parent: str, level: str, budget: str) -> str:
    """One level of the tree ``{parent}_budget``: nodes below share the parent's budget by weight, at most what they hold."""
    keys = [*parent.split(), level]
    own = ", ".join(keys)
    by = f"partition by {', '.join(parent.split())}" if parent else ""
    order = f"order by held * 1.0::double / weight, {level} nulls first"
    joined = (
        f"join {budget} up on " + " and ".join(f"n.{k} is not distinct from up.{k}" for k in parent.split()) if parent else f"cross join {budget} up"
    )
    return f"""
nodes_{level} as (
  select {", ".join("n." + k for k in keys)}, n.held, coalesce(w.weight, 1) weight, up.budget parent_budget
  from (select {own}, sum(held)::bigint held from leaves group by {own}) n
  {joined}
  left join weights w on w.level = '{level}' and w.name = n.{level}),
filled_{level} as (
  select *, coalesce(sum(held) over ({by} {order} rows between unbounded preceding and 1 preceding), 0)::hugeint before,
    sum(weight) over ({by} {order} rows between current row and unbounded following)::hugeint weights
  from nodes_{level}),
marked_{level} as (select *, held::hugeint * weights <= (parent_budget - before) * weight is_full from filled_{level}),
open_{level} as (
  select *, parent_budget - coalesce(sum(case when is_full then held end) over ({by}), 0)::hugeint rest,
    sum(case when is_full then 0 else weight end) over ({by})::hugeint open_all,
    sum(case when is_full then 0 else weight end) over ({by} {order} rows between unbounded preceding and current row)::hugeint open_upto
  from marked_{level}),
budget_{level} as (
  select {own}, (case when is_full then held
    else least(rest * open_upto // open_all - rest * (open_upto - weight) // open_all, held) end)::bigint budget
  from open_{level})"""


SQL["op4_source_mixing"] = f"""
with weights(level, name, weight) as (values {_WEIGHTS}),
rows as (
  select 'domain' || (try_cast(regexp_extract(source, '([0-9]+)$', 1) as bigint) % 4) "domain", lang, source, doc_id,
    coalesce((octet_length(encode(text)) + 3) // 4, 0)::bigint tokens
  from documents),
leaves as (select "domain", lang, source, sum(tokens)::bigint tokens, sum(tokens)::bigint * {MIX_EPOCHS} held from rows group by all),
root as (select least(sum(held), floor(sum(tokens) * 1.0::double))::bigint budget from leaves),
{_shared("", "domain", "root")},
{_shared("domain", "lang", "budget_domain")},
{_shared("domain lang", "source", "budget_lang")},
given as (
  select l.*, case when tokens > 0 then budget // tokens else 0 end whole
  from leaves l join budget_source b on l."domain" is not distinct from b."domain" and l.lang is not distinct from b.lang
    and l.source is not distinct from b.source),
drawn as (
  select r.*, g.whole, b.budget - g.whole * g.tokens part,
    md5('42:' || g.whole || ':' || coalesce(r.doc_id::varchar, 'null')) key
  from rows r join given g on r."domain" is not distinct from g."domain" and r.lang is not distinct from g.lang
    and r.source is not distinct from g.source
  join budget_source b on r."domain" is not distinct from b."domain" and r.lang is not distinct from b.lang
    and r.source is not distinct from b.source),
summed as (
  select *, sum(tokens) over (partition by "domain", lang, source order by key range between unbounded preceding and current row) upto
  from drawn)
select "domain", lang, source, doc_id, tokens, (whole + case when part > 0 and upto <= part then 1 else 0 end)::integer copies
from summed
"""

SQL["op6_norm_topk"] = """
with good as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) v
  from embeddings
  where vec_id is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)),
scored as (
  select q.vec_id query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint score
  from good q join good c on q.vec_id <> c.vec_id
  where q.vec_id % 100 = 0)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::integer rank, vec_id, score
from scored qualify rank <= 10
"""

SQL["op9_minhash_dedup"] = r"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') w
  from documents),
sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) end s
  from words),
shingles as (select doc_id, hash(unnest(s)) h from sets),
pairs as (
  select a.doc_id a, b.doc_id b, count(*) common
  from shingles a join shingles b on a.h = b.h and a.doc_id < b.doc_id group by all),
links as (
  select p.a, p.b from pairs p join sets x on p.a = x.doc_id join sets y on p.b = y.doc_id
  where 100 * common >= 80 * (len(x.s) + len(y.s) - common)),
both_ways as (select a, b from links union all select b, a from links),
reached as (
  select doc_id, doc_id other from documents
  union
  select r.doc_id, l.b from reached r join both_ways l on r.other = l.a)
select s.doc_id, len(s.s)::bigint n_shingles, min(r.other) component_id, s.doc_id = min(r.other) kept
from sets s join reached r using (doc_id) group by s.doc_id, s.s
"""

SQL["op11_fill_middle"] = """
with drawn as (
  select doc_id, coalesce(text, '') t, sha256('1:' || doc_id) h,
    regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') units
  from documents),
numbers as (
  select doc_id, t, units, len(units)::bigint n, ('0x' || h[1:8])::bigint h1, ('0x' || h[9:16])::bigint h2,
    ('0x' || h[17:24])::bigint h3, ('0x' || h[25:32])::bigint h4
  from drawn),
cuts as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) a, greatest(h1 % (n + 1), h2 % (n + 1)) b,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain'
      when h4 % 100 < 20 then 'spm' else 'psm' end form
  from numbers),
parts as (
  select *, array_to_string(units[1:a], '') prefix, array_to_string(units[a + 1:b], '') middle, array_to_string(units[b + 1:n], '') suffix
  from cuts)
select doc_id, n, form,
  case when form <> 'plain' then length(prefix) end prefix_chars,
  case when form <> 'plain' then length(middle) end middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) output_sha256,
  sha256(t) restored_sha256
from parts"""

_TERMS = (
    "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)

SQL["op13_pair_maxscore"] = f"""
with words as (select row, doc_id, unnest({_TERMS}) term from (select *, row_number() over () row from documents)),
counts as (select row, doc_id, term, count(*)::bigint tf from words group by all),
sizes as (select row, sum(tf)::bigint n from counts group by row),
total as (select count(*)::bigint docs, sum(n)::hugeint length from sizes),
weights as (
  select term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::bigint w
  from (select term, count(*)::bigint df from counts group by term) cross join total),
asked as (select distinct item_id, unnest({_TERMS}) term from benchmark),
scores as (
  select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50::hugeint * n * docs) // length))))::bigint score
  from asked join counts using (term) join weights using (term) join sizes using (row) cross join total
  group by item_id, row, doc_id)
select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int "rank", doc_id, score
from scores where score > 0 qualify "rank" <= 50"""
