"""Query of the mix and its SQL twin."""

from __future__ import annotations

from steward.llm import source_mixing
from steward.llm.common import query, table

MIX_SQL = r"""
with sized as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
         cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || '|' || coalesce(text, '')), 1, 15) as bigint) as h
  from documents),
per as (
  select source, cast(sum(size) as bigint) as source_size,
         case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 3 when 1 then 1 else 2 end as weight
  from sized group by source),
ranked as (
  select *, sum(source_size) over () as total,
         coalesce(sum(source_size) over (order by source_size / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as smaller,
         sum(weight) over (order by source_size / weight, source nulls last rows between current row and unbounded following) as rest
  from per),
above as (select *, weight * (3 * total - 4 * smaller) > 4 * source_size * rest as is_above from ranked),
shared as (
  select source, source_size, weight, is_above,
         3 * total - 4 * coalesce(sum(source_size) filter (where is_above) over (), 0) as remaining,
         sum(weight) filter (where not is_above) over () as open
  from above),
targets as (
  select source, source_size,
         case when is_above then cast(2 * source_size as double)
              else cast(weight * remaining as double) / cast(2 * open as double) end as target
  from shared),
budgets as (
  select *, case when source_size > 0 then floor(target / source_size) else 0 end as whole from targets),
groups as (
  select s.source, s.h, sum(s.size) as words,
         coalesce(sum(sum(s.size)) over (partition by s.source order by s.h rows between unbounded preceding and 1 preceding), 0) as before
  from sized s group by s.source, s.h),
taken as (
  select g.source, g.h, b.source_size, b.target,
         b.whole + case when g.before <= b.target - b.whole * b.source_size
                        and 2 * (b.target - b.whole * b.source_size - g.before) >= g.words then 1 else 0 end as copies
  from groups g join budgets b on g.source is not distinct from b.source)
select s.doc_id, s.size, t.source_size, t.target, cast(t.copies * s.size as bigint) as taken
from sized s join taken t on s.h = t.h and s.source is not distinct from t.source
"""


@query(MIX_SQL)
def op9_source_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return source_mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")
