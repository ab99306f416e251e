"""Query of the dataset manifest and its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from steward.llm import merkle_manifest
from steward.llm.common import query, table


def _frames(n_chars: str) -> str:
    values = (f"cast({c} as varchar)" for c in ("d.doc_id", "d.source", "d.lang", n_chars, "d.text"))
    return " || ".join(f"coalesce(cast(octet_length(encode({v})) as varchar) || ':' || {v}, '-')" for v in values)


#: The checking database has no crc32: the bits of each character go through the polynomial by hand.
MANIFEST_SQL = rf"""
with recursive crcs as (
  select row_number() over () as r, cast(doc_id as varchar) as s, 1 as i, cast(4294967295 as bigint) as c from documents where doc_id is not null
  union all
  select r, s, i + 1, list_reduce(list_prepend(xor(c, cast(ascii(s[i]) as bigint)), cast(range(8) as bigint[])),
         lambda a, k: case when a % 2 = 1 then xor(a // 2, 3988292384) else a // 2 end)
  from crcs where i <= length(s)),
hit as (select distinct cast(s as bigint) as doc_id, xor(c, 4294967295) % 7 = 0 as bad from crcs where i = length(s) + 1),
raw as (
  select d.doc_id, d.lang, sha256({_frames('d.n_chars')}) as leaf,
         case when h.bad then sha256({_frames('d.n_chars + 1')}) end as shown
  from documents d left join hit h on h.doc_id = d.doc_id),
leaves as (
  select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as p, dense_rank() over (order by lang nulls first) - 1 as g from raw),
low as (
  select 0 as lvl, g, p, count(*) over (partition by g) as n, leaf as h from leaves
  union all
  select lvl + 1, g, p // 2, (n + 1) // 2, sha256(h || coalesce(nxt, ''))
  from (select *, lead(h) over (partition by lvl, g order by p) as nxt from low where n > 1) where p % 2 = 0),
subroots as (select g, h as subroot, lvl as depth from low where n = 1),
high as (
  select 0 as lvl, g as p, count(*) over () as n, subroot as h from subroots
  union all
  select lvl + 1, p // 2, (n + 1) // 2, sha256(h || coalesce(nxt, ''))
  from (select *, lead(h) over (partition by lvl order by p) as nxt from high where n > 1) where p % 2 = 0),
steps as (
  select l.g, l.p, x.lvl, 0 as part, s.h, s.p < x.p as is_left
  from leaves l join low x on x.g = l.g and x.n > 1 and x.p = l.p >> x.lvl left join low s on s.g = x.g and s.lvl = x.lvl and s.p = xor(x.p, 1)
  union all
  select l.g, l.p, x.lvl, 1, s.h, s.p < x.p
  from leaves l join high x on x.n > 1 and x.p = l.g >> x.lvl left join high s on s.lvl = x.lvl and s.p = xor(x.p, 1)),
paths as (
  select g, p, list(struct_pack(h := h, is_left := is_left) order by part, lvl) as path, coalesce(string_agg(h, '' order by part, lvl), '') as joined
  from steps group by g, p),
fold as (
  select l.g, l.p, coalesce(l.shown, l.leaf) as acc, 1 as i, coalesce(t.path, []) as path from leaves l left join paths t on t.g = l.g and t.p = l.p
  union all
  select g, p, sha256(case when path[i].h is null then acc when path[i].is_left then path[i].h || acc else acc || path[i].h end), i + 1, path
  from fold where i <= len(path)),
done as (select g, p, acc from fold where i = len(path) + 1)
select l.doc_id, l.leaf, s.subroot, r.h as root, sha256(coalesce(t.joined, '')) as proof_sha256, f.acc as folded_root, f.acc = r.h as verified
from leaves l join subroots s on s.g = l.g join high r on r.n = 1 join done f on f.g = l.g and f.p = l.p left join paths t on t.g = l.g and t.p = l.p
"""


@query(MANIFEST_SQL)
def op12_merkle_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    rows = merkle_manifest.manifest(docs, tampered, {"n_chars": F.col("n_chars") + 1})
    again = rows.withColumn("folded_root", merkle_manifest.folded(F.col("presented"), F.col("steps")))
    return again.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(merkle_manifest.siblings(F.col("steps")), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
