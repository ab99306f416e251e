"""Query of the source divergence audit and its SQL twin."""

from __future__ import annotations

from steward.llm import divergence_audit
from steward.llm.common import query, table

AUDIT_SQL = r"""
with docs as (
  select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w
  from documents),
words as (select r, lang, source, unnest(w) as term from docs),
vocab as (select lang, term from words group by lang, term having count(distinct r) >= 30),
sizes as (select lang, count(*) as v from vocab group by lang),
cells as (select w.lang, w.source, w.term, count(*) as n from words w join vocab k on k.lang = w.lang and k.term = w.term group by all),
grp as (select distinct lang, source from docs),
totals as (
  select g.lang, g.source, coalesce(sum(c.n), 0)::hugeint as total, coalesce(any_value(s.v), 0) as v
  from grp g left join cells c on c.lang = g.lang and c.source = g.source left join sizes s on s.lang = g.lang group by all),
lang_totals as (select lang, sum(total)::hugeint as total from totals group by lang),
p as (
  select t.lang, t.source, k.term, coalesce(c.n, 0) as n, (1 + 1000000000::hugeint * (coalesce(c.n, 0) + 5) // (t.total + 5 * t.v))::bigint as p
  from totals t join vocab k on k.lang = t.lang left join cells c on c.lang = t.lang and c.source = t.source and c.term = k.term),
q as (
  select k.lang, k.term, (1 + 1000000000::hugeint * (coalesce(c.n, 0) + 5) // (t.total + 5 * s.v))::bigint as q
  from vocab k join lang_totals t on t.lang = k.lang join sizes s on s.lang = k.lang
  left join (select lang, term, sum(n) as n from cells group by all) c on c.lang = k.lang and c.term = k.term),
pairs as (
  select a.lang, a.source, b.source as item, coalesce(d.value, 0)::bigint as value
  from grp a join grp b on a.lang = b.lang and a.source <> b.source
  left join (select x.lang, x.source, y.source as item, sum(abs(x.p - y.p)) as value
             from p x join p y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all) d
  on d.lang = a.lang and d.source = a.source and d.item = b.source),
terms as (
  select p.lang, p.source, p.term as item, p.p - q.q as value from p join q on q.lang = p.lang and q.term = p.term where p.n > 0 and p.p > q.q)
select lang, source, 'pair' as part, item, value, cast(row_number() over (partition by lang, source order by value desc, item) as integer) as rank from pairs
union all
select lang, source, 'term', item, value, cast(row_number() over (partition by lang, source order by value desc, item) as integer) as rank from terms
qualify rank <= 50
"""


@query(AUDIT_SQL)
def op13_divergence_audit(spark, sf_dir):
    return divergence_audit.audit(table(spark, sf_dir, "documents"))
