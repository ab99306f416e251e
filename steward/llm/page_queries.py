"""Queries over web pages."""

from __future__ import annotations

from steward.llm import language_fusion, warc_archive
from steward.llm.common import query, table

ARCHIVE_SQL = """
with p as (
  select page_id, coalesce(html, '') as html, strlen(coalesce(html, '')) as n, sha1(coalesce(html, '')) as digest from pages),
g as (select digest, n, max(page_id) as last, count(*) as copies from p where n >= 1000 group by digest, n)
select p.page_id, cast(p.n as bigint) as payload_bytes, p.digest as payload_digest,
       case when g.copies > 1 and coalesce(p.page_id < g.last, g.last is not null) then 'revisit' else 'response' end as record_type,
       case when g.copies > 1 and coalesce(p.page_id < g.last, g.last is not null) then g.last end as refers_to
from p left join g on p.digest = g.digest and p.n = g.n
"""


@query(ARCHIVE_SQL)
def op4_warc_archive(spark, sf_dir):
    found = warc_archive.archive(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op5_language_fusion(spark, sf_dir):
    return language_fusion.languages_of(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))
