"""The oracle of the conversation repair: damage, faults, cheapest edits and their result as one statement."""

_SQL = r"""
with recursive crc_table as (
  select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t
), spaced as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as k from conversations
), parted as (
  select conv_id, turn, role, text,
    xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, len(k) + 1), lambda i: ascii(k[i])::bigint)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) % 20 as part
  from spaced, crc_table
), damaged as (
  select conv_id, turn, case when part = 4 then 'user' else role end as role,
    case part when 1 then '' when 2 then translate(text, '.!?', '') else text end as text, unnest(case when part = 3 then [1, 2] else [1] end) as copy
  from parted where part <> 0
), told as (
  select conv_id, turn, role, text, copy, md5(len(role) || ':' || role || text) as h, left(role, 1) as initial, right(rtrim(text, E' \t\n\x0B\f\r'), 1) as last from damaged
), seen as (
  select *, row_number() over (partition by conv_id, h order by turn nulls first, copy) > 1 as again from told
), placed as (
  select *, row_number() over o as n, lag(initial) over o || initial as pair from seen window o as (partition by conv_id order by turn nulls first, h, again, copy)
), faults as (
  select *, case when last = '' then 'blank' when again then 'duplicate' when last not in ('.', '!', '?') then 'truncated' end as fault from placed
), marked as (
  select *, fault in ('blank', 'duplicate') and fault is not null as gone, case when fault = 'truncated' then 5 else 0 end as stay from faults
), counted as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
    count(*) filter (fault = 'truncated') as truncated, count(*) filter (pair not in ('su', 'ua', 'au')) as illegal, max(n) as rows
  from marked group by conv_id
),
-- the best edits so far for each state of the grammar: eight digits of cost, then the audit
steps(conv_id, n, v0, v1, v2, v3) as (
  select conv_id, 0::bigint, '00000000', null::varchar, null::varchar, null::varchar from counted
  union all
  select conv_id, n,
    plus(w0, 2, 'D'),
    least(plus(w1, 2, 'D'), case when not gone and initial = 's' then plus(w0, stay, 'K') end),
    least(plus(w2, 2, 'D'), case when not gone then plus(least(w0, w1, w3), stay + 1, 'R') end, case when not gone and initial = 'u' then plus(least(w0, w1, w3), stay, 'K') end),
    least(plus(w3, 2, 'D'), case when not gone then plus(w2, stay + 1, 'R') end, case when not gone and initial = 'a' then plus(w2, stay, 'K') end)
  from (
    select s.conv_id, m.n, gone, stay, initial, v0 as w0, v1 as w1, least(v2, plus(least(v0, v1, v3), 5, 'I')) as w2, least(v3, plus(least(v2, plus(least(v0, v1), 5, 'I')), 5, 'I')) as w3
    from steps s join marked m on m.conv_id is not distinct from s.conv_id and m.n = s.n + 1
  )
), ended as (
  select c.*, least(v0, v3, plus(least(v2, plus(least(v0, v1), 5, 'I')), 5, 'I')) as best from counted c join steps s on s.conv_id is not distinct from c.conv_id and s.n = c.rows
), audits as (
  select * exclude (best), cast(best[1:8] as bigint) as cost, best[9:] as audit from ended
), letters as (
  select conv_id, unnest(range(1, len(audit) + 1)) as k, unnest(string_split(audit, '')) as edit from audits where audit <> ''
), applied as (
  select l.*, sum(case when edit = 'I' then 0 else 1 end) over (partition by conv_id order by k) as n from letters l
), emitted as (
  select a.conv_id, k, edit, m.role, m.initial, case when edit = 'I' then '' else m.text end as text, row_number() over (partition by a.conv_id order by k) - 1 as e
  from applied a left join marked m on m.conv_id is not distinct from a.conv_id and m.n = a.n and edit <> 'I' where edit <> 'D'
), offsets as (
  select *, max(case when e = 0 and edit = 'K' and initial = 's' then 1 else 0 end) over (partition by conv_id) as s from emitted
), repaired as (
  select conv_id, string_agg(case when edit = 'K' then role when (e - s) % 2 = 0 then 'user' else 'assistant' end || ':' || text, chr(10) order by k) as lines from offsets group by conv_id
), every as (select distinct conv_id from conversations)
select e.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
  coalesce(illegal, 0)::bigint as illegal, coalesce(cost, 0)::bigint as cost, coalesce(audit, '') as audit, sha256(coalesce(lines, '')) as repaired_sha256
from every e left join audits a on a.conv_id is not distinct from e.conv_id left join repaired r on r.conv_id is not distinct from e.conv_id
"""


def _inlined(sql: str) -> str:
    """Writes out plus(v, k, letter): v with k more cost and one letter more."""
    while (at := sql.rfind("plus(")) >= 0:
        depth, cuts, end = 1, [], at + 5
        while depth:
            c = sql[end]
            depth += (c == "(") - (c == ")")
            if c == "," and depth == 1:
                cuts.append(end)
            end += 1
        v, k, letter = sql[at + 5 : cuts[0]].strip(), sql[cuts[0] + 1 : cuts[1]].strip(), sql[cuts[1] + 1 : end - 1].strip()
        made = f"list_transform([{v}], lambda x: lpad(cast(cast(x[1:8] as bigint) + {k} as varchar), 8, '0') || x[9:] || {letter})[1]"
        sql = sql[:at] + made + sql[end:]
    return sql


OP11_SQL = _inlined(_SQL)
