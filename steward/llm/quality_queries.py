"""Query of the quality rules and its SQL twin."""

from __future__ import annotations

from steward.llm import line_quality as lq
from steward.llm.common import query, table


def _sql(pattern: str) -> str:
    return pattern.replace("'", "''")


QUALITY_SQL = rf"""
with base as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
w as (select r, unnest(a) as word, generate_subscripts(a, 1) as i
      from (select r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as a from base)),
windows as (select r, i, word || ' ' || lead(word) over o || ' ' || lead(word, 2) over o as win
            from w window o as (partition by r order by i)),
again as (select r, i from (select r, i, count(*) over (partition by r, win) as n from windows where win is not null) where n > 1),
covered as (select r, count(*) as n from (select distinct r, i + k as i from again, (select unnest([0, 1, 2]) as k)) group by r),
counts as (select r, count(*) as n_words, sum(length(word)) as word_chars from w group by r),
lines as (
  select r, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as n,
         length(regexp_replace(line, '[^#*$%&|<>!?~^=+_]', '', 'g')) as signs,
         len(list_filter(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), lambda x: x in ('|', '>', '/', '»', '›', '·', '•'))) as separators
  from (select r, unnest(string_split(t, chr(10))) as line from base)
  where regexp_matches(line, '[^\x20\x09-\x0D]')),
judged as (
  select *, (n < {lq.SHORT_LINE} and not regexp_matches(line, '{_sql(lq.CLOSED)}'))
         or (signs >= {lq.LEAST_SIGNS} and signs > n)
         or (separators >= {lq.LEAST_SEPARATORS} and 4 * separators >= n)
         or (n <= {lq.BOILERPLATE_WORDS} and regexp_matches(line, '{_sql(lq.BOILERPLATE)}')) as fails
  from lines),
per_line as (select r, count(*) - count(distinct line) as n_dup_lines, sum(case when fails then n else 0 end) as lost from judged group by r),
facts as (
  select b.doc_id, coalesce(c.n_words, 0) as n_words, coalesce(c.word_chars, 0) as word_chars,
         length(regexp_replace(b.t, '[^#*$%&|<>]', '', 'g')) as n_symbols,
         coalesce(l.n_dup_lines, 0) as n_dup_lines, coalesce(v.n, 0) as n_repeat_words, coalesce(l.lost, 0) as lost_words
  from base b left join counts c using (r) left join covered v using (r) left join per_line l using (r))
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars,
       cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines,
       cast(n_repeat_words as bigint) as n_repeat_words,
       n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
       cast(lost_words as bigint) as lost_words,
       not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and 100 * lost_words <= 50 * n_words as kept
from facts
"""


@query(QUALITY_SQL)
def op3_line_quality(spark, sf_dir):
    return lq.quality(table(spark, sf_dir, "documents"))
