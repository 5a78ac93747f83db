"""SQL of the numeric operators: plain forms of what their queries return."""

from __future__ import annotations


def clusters_sql(k: int, rounds: int, seed: int, size: int = 64, scale: int = 1024) -> str:
    """Lloyd's rounds, one after another, over (vector, component) rows."""
    parts = [
        "named as (select row_number() over () r, vec_id, embedding::double[] e from embeddings)",
        "items as (select r, vec_id, unnest(range(len(e))) d, unnest(e) v from named)",
        f"good as (select r from items group by r having count(*) = {size} and count(v) = {size} and bool_and(isfinite(v)))",
        f"p as materialized (select r, vec_id, d, floor({scale} * v)::bigint v from items where r in (select r from good))",
        f"c0 as materialized (select j, d, v from p join (select r, row_number() over (order by sha256('{seed}:' || vec_id) nulls last) - 1 j from (select distinct r, vec_id from p)) using (r) where j < {k})",
    ]
    for t in range(rounds + 1):
        parts += [
            f"t{t} as (select r, j, sum((p.v - c.v) * (p.v - c.v))::bigint x from p join c{t} c using (d) group by r, j)",
            f"a{t} as materialized (select r, j, x from (select *, row_number() over (partition by r order by x, j) n from t{t}) where n = 1)",
            f"m{t} as (select j, d, sum(v) s, count(*) n from a{t} join p using (r) group by j, d)",
            f"c{t + 1} as materialized (select j, d, coalesce((s - (s % n + n) % n) // n, v)::bigint v from c{t} left join m{t} using (j, d))",
        ]
    return f"""with {', '.join(parts)},
names as (select j, sha256(string_agg(v::varchar, ',' order by d)) h from c{rounds} group by j)
select vec_id, j::int "cluster", x distance, sum(x) over (partition by j)::bigint cluster_inertia, sum(x) over ()::bigint inertia, h centroid_sha256
from a{rounds} join (select distinct r, vec_id from p) using (r) join names using (j)"""


OP12_SQL = r"""
with recursive bits(b, i, v) as (select range, 0, range from range(256) union all select b, i + 1, xor(v >> 1, 3988292384 * (v & 1)) from bits where i < 8),
bytes as materialized (select b, v from bits where i = 8),
d as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') words from documents),
raw as materialized (select doc_id, unnest(words) w from d),
goal as materialized (select unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) w from benchmark),
words as (select w, hex(w) h from (select w from raw union select w from goal)),
steps(w, h, i, v) as (
  select w, h, 0, 4294967295 from words
  union all select w, h, i + 1, xor(s.v >> 8, bytes.v) from steps s join bytes on bytes.b = xor(s.v, ('0x' || substr(h, 2 * i + 1, 2))::bigint) & 255 where 2 * i < length(h)),
hashed as materialized (select w, xor(v, 4294967295) % 10000 bucket from steps where 2 * i = length(h)),
s as (select bucket, count(*) n from raw join hashed using (w) group by bucket),
t as (select bucket, count(*) n from goal join hashed using (w) group by bucket),
total as (select (select count(*) from raw)::double s, (select count(*) from goal)::double t),
gains as (select bucket, floor(1000 * ln((coalesce(t.n, 0) + 1) * (total.s + 10000) / ((coalesce(s.n, 0) + 1) * (total.t + 10000))))::bigint gain from s full join t using (bucket), total),
sums as (select doc_id, count(*) n, floor(sum(gain) / count(*))::bigint weight from raw join hashed using (w) join gains using (bucket) group by doc_id),
scored as (
  select doc_id, coalesce(n, 0) n_features, coalesce(weight, 0) weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint score
  from documents left join sums using (doc_id)),
placed as (select doc_id, row_number() over (order by score desc, doc_id) place, count(*) over () all_ from scored where n_features >= 20)
select doc_id, n_features, weight, score, case when place <= 10 * all_ // 100 then place end "rank" from scored left join placed using (doc_id)
"""

OP13_SQL = """
with named as (select distinct vec_id, embedding::double[] e from embeddings where vec_id is not null),
items as (select vec_id, e, unnest(e) v from named),
v as materialized (select vec_id, e from items group by vec_id, e having count(*) = count(v) and bool_and(isfinite(v)) and bool_or(v <> 0)),
pairs as (select q.vec_id query_id, c.vec_id, list_inner_product(q.e, c.e) score from v q join v c on len(q.e) = len(c.e) and (q.vec_id <> c.vec_id or q.e <> c.e) where q.vec_id % 20 = 0),
placed as (select *, row_number() over (partition by query_id order by score desc, vec_id) n from pairs)
select query_id, n::int "rank", vec_id, score from placed where n <= 20
"""
