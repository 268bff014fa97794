"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"

LANGUAGE_MODEL = rf"""
with w as (
  select row_number() over () as r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '{_WORD}') as ws from documents
), s as (
  select r, unnest(list_concat(['<s>'], ws, ['</s>'])) as w, generate_subscripts(list_concat(['<s>'], ws, ['</s>']), 1) as t from w where len(ws) > 0
), seq as (
  select r, t, w, lag(w) over (partition by r order by t) as v, lag(w, 2) over (partition by r order by t) as u from s
), c1 as (select w, count(*)::double as c from seq group by 1),
c2 as (select v, w, count(*)::double as c from seq where v is not null group by 1, 2),
c3 as (select u, v, w, count(*)::double as c from seq where u is not null group by 1, 2, 3),
tot as (select sum(c) filter (w <> '<s>') as n, count(*) filter (w <> '<s>') as k from c1),
p1 as (select w, c, (c + 1) / (n + k + 1) as p from c1, tot),
p2 as (select c2.v, c2.w, c2.c, (c2.c - 0.75) / h.c as p, p1.p as less from c2 join c1 h on h.w = c2.v join p1 on p1.w = c2.w),
b1 as (select v, ln((1 - sum(p)) / (1 - sum(less))) as b from p2 group by 1),
p3 as (select c3.u, c3.v, c3.w, (c3.c - 0.75) / h.c as p, l.p as less from c3 join c2 h on h.v = c3.u and h.w = c3.v join p2 l on l.v = c3.v and l.w = c3.w),
b2 as (select u, v, ln((1 - sum(p)) / (1 - sum(less))) as b from p3 group by 1, 2),
lp as (
  select seq.r, case when p3.p is not null then ln(p3.p)
    else coalesce(b2.b, 0) + case when p2.p is not null then ln(p2.p) else coalesce(b1.b, 0) + ln(p1.p) end end as l
  from seq join p1 on p1.w = seq.w
  left join p2 on p2.v = seq.v and p2.w = seq.w
  left join b1 on b1.v = seq.v
  left join p3 on p3.u = seq.u and p3.v = seq.v and p3.w = seq.w
  left join b2 on b2.u = seq.u and b2.v = seq.v
  where seq.v is not null
), sums as (select r, sum(l) as l from lp group by 1)
select doc_id, len(ws)::bigint as n_words, round(coalesce(l, 0), 4) as log_prob,
  case when len(ws) > 0 then round(exp(-l / (len(ws) + 1)), 3) end as perplexity
from w left join sums using (r)
"""

CHAT = r"""
with t as (
  select conv_id, role, coalesce(role, '') as r, coalesce(text, '') as x,
    row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as k
  from conversations where conv_id is not null
), s as (
  select conv_id, role, k, '<|im_start|>' || r || chr(10) as head, x, '<|im_end|>' || chr(10) as tail from t
), b as (
  select *, strlen(head)::bigint as h, strlen(x)::bigint as n,
    coalesce(sum(strlen(head) + strlen(x) + strlen(tail)) over (partition by conv_id order by k rows between unbounded preceding and 1 preceding), 0)::bigint as before from s
)
select conv_id, string_agg(head || x || tail, '' order by k) as text, count(*)::bigint as n_turns,
  sum(h + n + strlen(tail))::bigint as n_bytes,
  coalesce(string_agg((before + h)::varchar || '-' || (before + h + n + 10)::varchar, ' ' order by k) filter (where role = 'assistant'), '') as loss_spans
from b group by conv_id
"""
