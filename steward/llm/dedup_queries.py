"""Queries of the deduplication operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from steward.llm import near_embeddings, suffix_dedup, super_kmers, super_minhash
from steward.llm.common import query, table

SHINGLE_SQL = r"""
with recursive docs as (
  select row_number() over () as r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
w as (select r, doc_id, unnest(w) as word, generate_subscripts(w, 1) as i, len(w) as n from docs),
s as (
  select distinct r, doc_id, case when n < 5 then first_value(word) over o || coalesce(' ' || lead(word, 1) over o, '')
         || coalesce(' ' || lead(word, 2) over o, '') || coalesce(' ' || lead(word, 3) over o, '')
         else word || ' ' || lead(word, 1) over o || ' ' || lead(word, 2) over o || ' ' || lead(word, 3) over o || ' ' || lead(word, 4) over o end as gram
  from w window o as (partition by r order by i) qualify (n >= 5 and i <= n - 4) or (n < 5 and i = 1)),
sizes as (select r, doc_id, count(*) as n from s group by r, doc_id),
common as (
  select a.r as ra, b.r as rb, count(*) as k from s a join s b on a.gram = b.gram and a.r < b.r group by a.r, b.r),
edges as (
  select x.doc_id as u, y.doc_id as v from common c join sizes x on x.r = c.ra join sizes y on y.r = c.rb
  where 100 * c.k >= 85 * (x.n + y.n - c.k)),
bothways as (select u, v from edges union select v, u from edges),
reach as (select doc_id as node, doc_id as root from docs union select r.node, b.v from reach r join bothways b on b.u = r.root),
roots as (select node, min(root) as root from reach group by node)
select d.doc_id, cast(coalesce(z.n, 0) as bigint) as n_shingles, o.root as component_id, d.doc_id = o.root as kept
from docs d left join sizes z using (r) join roots o on o.node = d.doc_id
"""


@query(SHINGLE_SQL)
def op10_super_minhash(spark, sf_dir):
    return super_minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query()
def op7_suffix_dedup(spark, sf_dir):
    found = suffix_dedup.without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


EMBEDDING_SQL = """
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings),
good as (
  select vec_id, label, e, sqrt(list_dot_product(e, e)) as norm from v
  where label is not null and e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0
    and len(list_filter(e, lambda x: x <> 0)) > 0),
links as (
  select a.vec_id as u, b.vec_id as v from good a join good b
  on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_dot_product(a.e, b.e) >= 0.93 * a.norm * b.norm),
reach as (select vec_id as node, vec_id as root from v union select r.node, l.v from reach r join links l on l.u = r.root),
roots as (select node, min(root) as root from reach group by node),
counts as (select u, count(*) as n from links group by u)
select v.vec_id, cast(coalesce(c.n, 0) as bigint) as n_links, r.root as component_id, v.vec_id = r.root as kept
from v join roots r on r.node = v.vec_id left join counts c on c.u = v.vec_id
"""


@query(EMBEDDING_SQL)
def op1_near_embeddings(spark, sf_dir):
    return near_embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


WINDOW_SQL = r"""
with docs as (
  select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
starts as (select r, doc_id, w, unnest(generate_series(1, len(w))) as i from docs),
windows as (select r, i, w[i] as word, case when i + 34 <= len(w) then array_to_string(w[i:i + 34], ' ') end as s from starts),
flagged as (select r, i, word, s is not null and count(*) over (partition by s) > 1 as again from windows),
covered as (select r, i, word, max(again) over (partition by r order by i rows between 34 preceding and current row) as gone from flagged),
kept as (select r, count(*) filter (where gone) as n_removed, string_agg(word, ' ' order by i) filter (where not gone) as kept from covered group by r)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(k.n_removed, 0) as bigint) as n_removed, sha256(coalesce(k.kept, '')) as kept_sha256
from docs d left join kept k using (r)
"""


@query(WINDOW_SQL)
def op11_super_kmers(spark, sf_dir):
    found = super_kmers.without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
