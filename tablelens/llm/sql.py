"""DuckDB counterparts of the training-data queries that SQL can express."""

OP9 = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v
  from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
pairs as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
  from v q, v c where q.vec_id % 20 = 0 and c.vec_id <> q.vec_id
)
select query_id, cast(rank as int) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from pairs)
where rank <= 20
"""

OP10 = """
with d as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents
),
g as (
  select doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') as gram
  from d, lateral (select unnest(range(1, greatest(len(w) - 11, 1))) as i) r
  where len(w) >= 13
),
o as (select gram, min(doc_id) as owner from g group by gram),
hit as (select doc_id, i from g join o using (gram) where owner < doc_id),
gone as (select distinct doc_id, i + k as i from hit, (select unnest(range(0, 13)) as k) s),
lists as (select doc_id, list(i) as gone from gone group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(len(gone), 0) as bigint) as n_removed,
       sha256(array_to_string(case when gone is null then w
         else list_transform(list_filter(range(1, len(w) + 1), lambda i: not list_contains(gone, i)), lambda i: w[i]) end, ' ')) as kept_sha256
from d left join lists using (doc_id)
"""


OP12 = """
with terms as (
  select doc_id, row_number() over () as d, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w
  from documents
),
totals as (select count(*) as c_docs, cast(sum(len(w)) as bigint) as c_terms from terms where len(w) > 0),
sizes as (select d, doc_id, 75 + (25 * len(w) * c_docs) // c_terms as m from terms, totals where len(w) > 0),
tf as (select d, t, count(*) as tf from (select d, unnest(w) as t from terms) group by d, t),
weights as (
  select t, cast(floor(1000 * ln((2 * cast(c_docs as double) + 2) / (2 * count(*) + 1))) as bigint) as w from tf, totals group by t, c_docs
),
asked as (
  select i, item_id, t, count(*) as q
  from (select i, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t
        from (select *, row_number() over () as i from benchmark))
  group by i, item_id, t
),
scores as (
  select i, item_id, d, doc_id, cast(sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) as bigint) as score
  from asked join weights using (t) join tf using (t) join sizes using (d)
  group by i, item_id, d, doc_id
)
select item_id, cast(rank as int) as rank, doc_id, score
from (select *, row_number() over (partition by i order by score desc, doc_id) as rank from scores where score > 0)
where rank <= 20
"""


def statements() -> dict[str, str]:
    """DuckDB SQL by query name."""
    return {"op9_threshold_top_k": OP9, "op10_debruijn_dedup": OP10, "op12_limited_accumulators": OP12}
