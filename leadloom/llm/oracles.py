"""SQL counterparts of the corpus queries that SQL can express, for DuckDB on the same tables."""

_BYTES = "coalesce(text, '')"

#: Shingle sets by string functions, links by an inverted index, components by a recursive walk over the links.
PARITY_JOIN = f"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(translate({_BYTES}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') as w
  from documents),
sets as (
  select doc_id, list_distinct(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                                    when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s
  from words),
shingles as (select doc_id, len(s) as n, unnest(s) as g from sets),
pairs as (
  select a.doc_id as a, b.doc_id as b, any_value(a.n) as n, any_value(b.n) as m, count(*) as common
  from shingles a join shingles b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
links as (select a, b from pairs where 100 * common >= 90 * (n + m - common)),
both_ways as (select a, b from links union all select b, a from links),
walk as (select doc_id as node, doc_id as reached from sets union select w.node, l.b from walk w join both_ways l on l.a = w.reached)
select s.doc_id, len(any_value(s.s))::bigint as n_shingles, min(w.reached) as component_id
from sets s join walk w on w.node = s.doc_id group by s.doc_id"""

#: Every window of 100 bytes, as hexadecimal digits; a removed byte is covered by a window that is not the first of its kind.
PREFIX_FREE = f"""
with docs as (select doc_id, hex(encode({_BYTES})) as h from documents),
windows as (select doc_id, unnest(range(0, length(h) // 2 - 99)) as pos, h from docs where length(h) >= 200),
keyed as (select doc_id, pos, md5(substr(h, 2 * pos + 1, 200)) as w from windows),
later as (select doc_id, pos from (select doc_id, pos, row_number() over (partition by w order by doc_id, pos) as nth from keyed) where nth > 1),
steps as (select doc_id, pos, pos - lag(pos) over (partition by doc_id order by pos) as gap from later),
grouped as (select doc_id, pos, sum(case when gap is null or gap > 100 then 1 else 0 end) over (partition by doc_id order by pos) as run from steps),
spans as (select doc_id, run, min(pos) as a, max(pos) + 100 as b from grouped group by doc_id, run),
kept as (
  select d.doc_id, any_value(length(d.h) // 2) as n_bytes, coalesce(sum(s.b - s.a), 0) as n_removed, count(s.a) as n_spans,
         list(struct_pack(a := s.a, b := s.b) order by s.a) filter (where s.a is not null) as spans, any_value(d.h) as h
  from docs d left join spans s on s.doc_id = d.doc_id group by d.doc_id)
select doc_id, n_bytes::bigint as n_bytes, n_removed::bigint as n_removed, n_spans::bigint as n_spans,
       sha256(unhex(case when spans is null then h else array_to_string(
         list_transform(range(0, len(spans) + 1),
           lambda i: substr(h, case when i = 0 then 1 else 2 * spans[i].b + 1 end,
                            case when i = len(spans) then length(h) else 2 * spans[i + 1].a end - case when i = 0 then 0 else 2 * spans[i].b end)), '') end)) as kept_sha256
from kept"""


def crc32(text: str) -> str:
    """The unsigned checksum of ASCII text, bit by bit."""
    return f"""xor(4294967295::ubigint, list_reduce(
      list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i::int, 1))::ubigint),
      lambda c, b: list_reduce(range(1, 9)::ubigint[], lambda r, k: xor(r >> 1, 3988292384::ubigint * (r & 1)), xor(c, b)),
      4294967295::ubigint))"""


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::varchar)::varchar || ':' || {value}::varchar, '-')"


def _leaf(chars: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", chars, "text")) + ")"


#: Both kinds of trees level by level; a proof is the list of siblings with their side, folded by a reduce.
MERKLE = f"""
with recursive tampered as (select *, {crc32("doc_id::varchar")} % 7 = 0 as bad from documents),
leaves as (
  select doc_id, lang, {_leaf("n_chars")} as leaf, {_leaf("(case when bad then n_chars + 1 else n_chars end)")} as changed,
         row_number() over (partition by lang order by doc_id) - 1 as pos, count(*) over (partition by lang) as n
  from tampered),
nodes as (
  select lang, 0 as lvl, pos, n, leaf as h from leaves
  union all
  select lang, lvl + 1, pos // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' order by pos))
  from nodes where n > 1 group by lang, lvl, pos // 2),
subroots as (select lang, h, row_number() over (order by encode(lang) nulls first) - 1 as pos, count(*) over () as n from nodes where n = 1),
tops as (
  select 0 as lvl, pos, n, h from subroots
  union all
  select lvl + 1, pos // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' order by pos)) from tops where n > 1 group by lvl, pos // 2),
inner_steps as (
  select l.doc_id, o.lvl, o.pos % 2 as side, s.h
  from leaves l join nodes o on o.lang is not distinct from l.lang and o.pos = l.pos >> o.lvl and o.n > 1
  left join nodes s on s.lang is not distinct from l.lang and s.lvl = o.lvl and s.pos = xor(o.pos, 1)),
outer_steps as (
  select l.doc_id, 1000 + o.lvl as lvl, o.pos % 2 as side, s.h
  from leaves l join subroots r on r.lang is not distinct from l.lang join tops o on o.pos = r.pos >> o.lvl and o.n > 1
  left join tops s on s.lvl = o.lvl and s.pos = xor(o.pos, 1)),
proofs as (
  select doc_id, list(case when h is null then 'N' when side = 1 then 'L' || h else 'R' || h end order by lvl) as steps,
         coalesce(string_agg(h, '' order by lvl), '') as siblings
  from (from inner_steps union all from outer_steps) group by doc_id),
told as (
  select l.doc_id, l.leaf, r.h as subroot, (select h from tops where n = 1) as root, sha256(coalesce(p.siblings, '')) as proof_sha256,
         list_reduce(coalesce(p.steps, []), lambda a, s: case s[1] when 'N' then sha256(a) when 'L' then sha256(substr(s, 2) || a)
                                                         else sha256(a || substr(s, 2)) end, l.changed) as folded_root
  from leaves l join subroots r on r.lang is not distinct from l.lang left join proofs p on p.doc_id = l.doc_id)
select *, folded_root = root as verified from told"""

#: Stretches of places whose word comes back some words later, by the places' distance to their number within the distance.
PERIODIC = f"""
with split as (
  select doc_id, {crc32("doc_id::varchar")} as h,
         list_filter(regexp_split_to_array({_BYTES}, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') as w
  from documents),
sized as (select doc_id, h, h // 10 as g, w, len(w)::bigint as n from split),
planned as (select *, case when n > 0 then (g % n)::bigint end as a, case when n > 0 then 1 + (n - (g % n)::bigint) // (3 + g % 8)::bigint end as p from sized),
docs as (
  select doc_id, n, case when h % 10 = 0 and n > 0 then list_transform(range(0, n), lambda i: w[1 + case when i >= a then a + (i - a) % p else i end])
                         else w end as w
  from planned),
words as (select doc_id, n, unnest(w) as x, unnest(range(0, n)) as i from docs),
pairs as (
  select a.doc_id, a.i, b.i - a.i as q from words a join words b on a.doc_id = b.doc_id and a.x = b.x and b.i > a.i and 4 * (b.i - a.i) <= a.n),
numbered as (select *, i - row_number() over (partition by doc_id, q order by i) as stretch from pairs),
stretches as (select doc_id, q, min(i) as start, count(*) + q as length from numbered group by doc_id, q, stretch having count(*) + q >= greatest(6, 4 * q)),
runs as (select doc_id, start, length, min(q) as period from stretches group by doc_id, start, length),
longest as (
  select doc_id, count(*) as n_runs, arg_max({{'s': start, 'l': length, 'q': period}}, [length, -start, -period]) as t,
         string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as lines
  from runs group by doc_id),
dropped as (select distinct doc_id, unnest(range(start + period, start + length)) as i from runs),
kept as (
  select w.doc_id, string_agg(w.x, ' ' order by w.i) as collapsed
  from words w left join dropped d on d.doc_id = w.doc_id and d.i = w.i where d.i is null group by w.doc_id)
select d.doc_id, coalesce(l.n_runs, 0)::bigint as n_runs, l.t.s::bigint as start, l.t.l::bigint as length, l.t.q::bigint as period,
       (1000 * l.t.l // l.t.q)::bigint as exponent_milli, sha256(coalesce(l.lines, '')) as runs_sha256,
       sha256(coalesce(k.collapsed, '')) as collapsed_sha256
from docs d left join longest l on l.doc_id = d.doc_id left join kept k on k.doc_id = d.doc_id"""

ORACLES = {"op2_parity_join": PARITY_JOIN, "op8_prefix_free": PREFIX_FREE, "op12_merkle_witness": MERKLE,
           "op13_periodic_runs": PERIODIC}
