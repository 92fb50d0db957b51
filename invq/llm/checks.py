"""DuckDB SQL for the rows of registered queries."""

from __future__ import annotations


def _crc32(text: str) -> str:
    """Checksum of an ASCII text, bit by bit."""
    bytes_ = f"list_transform(string_split({text}, ''), lambda c: ord(c)::ubigint)"
    bit = "case when x & 1 = 1 then xor(x >> 1, 3988292384::ubigint) else x >> 1 end"
    whole = f"""list_reduce(list_prepend(4294967295::ubigint, {bytes_}), lambda acc, b:
        list_reduce([xor(acc, b), 0, 0, 0, 0, 0, 0, 0, 0]::ubigint[], lambda x, i: {bit}))"""
    return f"xor({whole}, 4294967295::ubigint)"


def _counted(value: str) -> str:
    return f"coalesce(strlen({value}::varchar)::varchar || ':' || {value}::varchar, '-')"


def _leaf(text: str) -> str:
    values = ["doc_id", "source", "lang", "n_chars", text]
    return f"sha256({' || '.join(map(_counted, values))})"


OP12_MANIFEST = f"""
with recursive leaves as (
  select *, coalesce('=' || source, '-') as g, {_leaf("text")} as leaf,
         {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as lowered,
         coalesce({_crc32("doc_id::varchar")} % 5 = 0, false) as forged
  from documents
), placed as (
  select doc_id, g, leaf, case when forged then lowered else leaf end as claimed,
         row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as pos
  from leaves
), nodes as (
  select g, 0 as level, pos, leaf as digest, count(*) over (partition by g) as held from placed
  union all
  select g, level + 1, pos, digest, count(*) over (partition by g) from (
    select g, level, pos // 16 as pos, sha256(string_agg(digest, '' order by pos)) as digest
    from nodes where held > 1 group by g, level, pos // 16)
), subroots as (
  select g, digest as subroot, row_number() over (order by g) - 1 as pos from nodes where held = 1
), upper_nodes as (
  select 0 as level, pos, subroot as digest, count(*) over () as held from subroots
  union all
  select level + 1, pos, digest, count(*) over () from (
    select level, pos // 16 as pos, sha256(string_agg(digest, '' order by pos)) as digest
    from upper_nodes where held > 1 group by level, pos // 16)
), runs as (
  select g, level, pos // 16 as run, string_agg(digest, '' order by pos) as digests
  from nodes where held > 1 group by g, level, pos // 16
), upper_runs as (
  select level, pos // 16 as run, string_agg(digest, '' order by pos) as digests
  from upper_nodes where held > 1 group by level, pos // 16
), walk as (
  select g, pos as leaf_pos, 0 as level, pos, claimed as folded, '' as siblings from placed
  union all
  select w.g, leaf_pos, w.level + 1, w.pos // 16,
         sha256(substr(digests, 1, 64 * (w.pos % 16)::int) || folded || substr(digests, 64 * (w.pos % 16)::int + 65)),
         siblings || substr(digests, 1, 64 * (w.pos % 16)::int) || substr(digests, 64 * (w.pos % 16)::int + 65)
  from walk w join runs r on r.g = w.g and r.level = w.level and r.run = w.pos // 16
), below as (
  select w.g, leaf_pos, folded, siblings from walk w
  qualify row_number() over (partition by w.g, leaf_pos order by level desc) = 1
), climb as (
  select b.g, leaf_pos, 0 as level, s.pos, folded, siblings from below b join subroots s using (g)
  union all
  select c.g, leaf_pos, c.level + 1, c.pos // 16,
         sha256(substr(digests, 1, 64 * (c.pos % 16)::int) || folded || substr(digests, 64 * (c.pos % 16)::int + 65)),
         siblings || substr(digests, 1, 64 * (c.pos % 16)::int) || substr(digests, 64 * (c.pos % 16)::int + 65)
  from climb c join upper_runs r on r.level = c.level and r.run = c.pos // 16
), proven as (
  select * from climb qualify row_number() over (partition by g, leaf_pos order by level desc) = 1
), top as (
  select digest as root from upper_nodes where held = 1
)
select p.doc_id, p.leaf, s.subroot, root, sha256(v.siblings) as proof_sha256, v.folded as folded_root,
       v.folded = root as verified
from placed p join proven v on v.g = p.g and v.leaf_pos = p.pos join subroots s on s.g = p.g cross join top
"""

_SPACES = r"\x20\x09-\x0D"

#: Rows of a conversation one after the other; `least` is the cheapest edits so far for each end of the roles.
OP11_CONVERSATIONS = rf"""
with recursive given as (
  select coalesce('=' || conv_id, '-') as conv, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         {_crc32("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as fate
  from conversations
), damaged as (
  select conv, turn, case when fate = 4 then 'user' else role end as role,
         case when fate = 1 then '' when fate = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from given, unnest(range(case when fate = 0 then 0 when fate = 3 then 2 else 1 end)) as copies(copy)
), ordered as (
  select *, row_number() over (partition by conv order by turn nulls first, md5(strlen(role) || ':' || role || text)) as nr
  from damaged
), judged as (
  select *, substr(role, 1, 1) as initial, not regexp_matches(text, '[^{_SPACES}]') as blank,
         row_number() over (partition by conv, role, text order by nr) > 1 as again,
         regexp_extract(text, '([^{_SPACES}])[{_SPACES}]*$', 1) not in ('.', '!', '?') as late,
         lag(substr(role, 1, 1)) over (partition by conv order by nr) as before
  from ordered
), faults as (
  select conv, count(*) as n,
         coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
         count(*) filter (where blank) as blank,
         count(*) filter (where not blank and again) as duplicate,
         count(*) filter (where not blank and not again and late) as truncated,
         count(*) filter (where before is not null and before || initial not in ('su', 'ua', 'au')) as illegal
  from judged group by conv
), inserts(state, letters, to_state) as (
  values ('', '', ''), ('', 'I', 'u'), ('', 'II', 'a'), ('s', '', 's'), ('s', 'I', 'u'), ('s', 'II', 'a'),
         ('u', '', 'u'), ('u', 'I', 'a'), ('u', 'II', 'u'), ('a', '', 'a'), ('a', 'I', 'u'), ('a', 'II', 'a')
), takes(state, role, letter, price, to_state) as (
  values ('', null, 'D', 3, ''), ('s', null, 'D', 3, 's'), ('u', null, 'D', 3, 'u'), ('a', null, 'D', 3, 'a'),
         ('', null, 'R', 2, 'u'), ('s', null, 'R', 2, 'u'), ('u', null, 'R', 2, 'a'), ('a', null, 'R', 2, 'u'),
         ('', 's', 'K', 0, 's'), ('', 'u', 'K', 0, 'u'), ('s', 'u', 'K', 0, 'u'), ('u', 'a', 'K', 0, 'a'), ('a', 'u', 'K', 0, 'u')
), least as (
  select distinct conv, 0::bigint as nr, '' as state, {{'cost': 0::bigint, 'audit': ''}} as best from judged
  union all
  select l.conv, j.nr, t.to_state,
         min({{'cost': l.best.cost + 2 * length(i.letters) + t.price + case when t.letter <> 'D' and late then 1 else 0 end,
               'audit': l.best.audit || i.letters || t.letter}})
  from least l join judged j on j.conv = l.conv and j.nr = l.nr + 1
  join inserts i on i.state = l.state
  join takes t on t.state = i.to_state and (t.role is null or t.role = initial)
    and (t.letter = 'D' or not (blank or again))
  group by l.conv, j.nr, t.to_state
), decided as (
  select l.conv, min({{'cost': l.best.cost + 2 * length(i.letters), 'audit': l.best.audit || i.letters}}) as best
  from least l join faults f on f.conv = l.conv and f.n = l.nr join inserts i on i.state = l.state
  where i.to_state in ('', 'a') group by l.conv
), letters as (
  select conv, p, substr(best.audit, p::int, 1) as letter,
         length(replace(substr(best.audit, 1, p::int), 'I', '')) as nr,
         length(replace(substr(best.audit, 1, p::int), 'D', '')) as place
  from decided, unnest(range(1, length(best.audit) + 1)) as t(p)
), messages as (
  select l.conv, l.place, letter, case when letter <> 'I' then j.text else '' end as text, j.role, initial,
         max(case when l.place = 1 and letter = 'K' and initial = 's' then 1 else 0 end) over (partition by l.conv) as led
  from letters l left join judged j on j.conv = l.conv and j.nr = l.nr where letter <> 'D'
), repaired as (
  select conv, string_agg(case when letter = 'K' then role when (place - led) % 2 = 1 then 'user' else 'assistant' end
                          || ':' || text, chr(10) order by place) as body
  from messages group by conv
)
select c.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
       coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(best.cost, 0) as cost,
       coalesce(best.audit, '') as audit, sha256(coalesce(body, '')) as repaired_sha256
from (select distinct conv_id from conversations) c
left join faults f on f.conv = coalesce('=' || conv_id, '-')
left join decided d on d.conv = coalesce('=' || conv_id, '-')
left join repaired r on r.conv = coalesce('=' || conv_id, '-')
"""
