"""SQL for DuckDB that gives the whole result of those queries that SQL can express."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Reachability: label is the smallest node that each node of ``links (a, b)`` reaches.
REACHED = "reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a)"

OP1 = f"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[ \\x09-\\x0D]+'), lambda x: x <> '') as w from documents
),
s as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) end as s, len(w) as n_words from w
),
e as (select doc_id, unnest(s) as g, n_words < 3 as short from s),
common as (select x.doc_id as a, y.doc_id as b, count(*) as n from e x join e y on x.g = y.g and x.short = y.short and x.doc_id <> y.doc_id group by all),
links as (select a, b from common join s x on x.doc_id = a join s y on y.doc_id = b where 100 * n >= 90 * (len(x.s) + len(y.s) - n)),
{REACHED}
select s.doc_id as doc_id, max(len(s.s))::bigint as n_shingles, least(s.doc_id, coalesce(min(r.b), s.doc_id)) as component_id from s left join reach r on r.a = s.doc_id group by s.doc_id
"""

OP5 = f"""
with recursive v as (
  select vec_id, embedding::double[] as e from embeddings where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
n as (select vec_id, e, sqrt(list_inner_product(e, e)) as n from v where list_inner_product(e, e) > 0),
links as (select x.vec_id as a, y.vec_id as b from n x join n y on x.vec_id <> y.vec_id and len(x.e) = len(y.e) where list_inner_product(x.e, y.e) / (x.n * y.n) >= 0.95),
{REACHED},
c as (select a, min(b) as least from reach group by 1), k as (select a, count(*) as n from links group by 1)
select vec_id, coalesce(k.n, 0)::bigint as n_links, least(vec_id, coalesce(c.least, vec_id)) as component_id, vec_id <= coalesce(c.least, vec_id) as kept from embeddings left join c on c.a = vec_id left join k on k.a = vec_id
"""

OP8 = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as e from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
p as (select q.vec_id as query_id, c.vec_id as vec_id, list_inner_product(q.e, c.e)::bigint as score from v q join v c on c.vec_id <> q.vec_id where q.vec_id % 100 = 0),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from p)
select query_id, rank, vec_id, score from r where rank <= 10
"""



def crc(text: str) -> str:
    """The unsigned crc32 of a string of ASCII characters, bit by bit."""
    byte = "list_reduce(list_concat([xor(acc, b)], [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda x, z: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)"
    codes = f"list_transform(range(1, len({text}) + 1), lambda i: ascii(({text})[i])::bigint)"
    return f"xor(list_reduce(list_concat([4294967295]::bigint[], {codes}), lambda acc, b: {byte}), 4294967295)"


OP11 = f"""
with d as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\x09-\\x0D]+'), lambda x: x <> '') as w, {crc("doc_id::varchar")} as h from documents),
g as (select doc_id, w, len(w) as n, h, case when h % 10 = 0 and len(w) > 0 then (h // 10) % len(w) end as a from d),
p as (select *, 1 + (n - a) // (3 + (h // 10) % 8) as p from g),
v as (select doc_id, n, case when a is null then w else list_transform(range(0, n), lambda i: w[1 + case when i < a then i else a + (i - a) % p end]) end as w from p),
e as (select doc_id, n, unnest(w) as x, unnest(range(0, n)) as i from v),
same as (select l.doc_id, r.i - l.i as q, l.i from e l join e r on l.doc_id = r.doc_id and l.x = r.x and r.i > l.i and 4 * (r.i - l.i) <= l.n),
isles as (select *, i - row_number() over (partition by doc_id, q order by i) as isle from same),
reps as (select doc_id, q, min(i) as s, count(*) + q as l from isles group by doc_id, q, isle having count(*) + q >= greatest(6, 4 * q)),
runs as (select doc_id, s, l, min(q) as q from reps group by doc_id, s, l),
best as (select doc_id, count(*) as n_runs, max({{'l': l, 's': -s, 'q': -q}}) as b, string_agg(s || ',' || l || ',' || q || chr(10), '' order by s, q) as t from runs group by doc_id),
gone as (select distinct doc_id, unnest(range(s + q, s + l)) as i from runs),
kept as (select doc_id, string_agg(x, ' ' order by i) as t from e anti join gone using (doc_id, i) group by doc_id)
select d.doc_id, coalesce(n_runs, 0)::bigint as n_runs, -b.s as start, b.l as length, -b.q as period, (1000 * b.l // -b.q)::bigint as exponent_milli,
  sha256(coalesce(best.t, '')) as runs_sha256, sha256(coalesce(kept.t, '')) as collapsed_sha256
from d left join best using (doc_id) left join kept using (doc_id)
"""

OP13 = f"""
with c as (
  select conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} order by turn nulls first, role, text) as p, {crc("any_value(conv_id)::varchar")} % 4 as h from conversations where conv_id is not null group by conv_id
),
r as (select c.conv_id, list_concat(list_slice(coalesce(f.p, []), 1, c.h), list_slice(c.p, c.h + 1, len(c.p))) as p from c left join c f on f.conv_id = c.conv_id - (c.conv_id % 20 + 20) % 20),
m as (select conv_id, p, unnest(range(0, len(p) + 1)) as d from r),
n as (select list_slice(p, 1, d) as p, d, min(conv_id) as conv_id, count(*) as n_convs, string_agg(conv_id::varchar, ',' order by conv_id) filter (len(p) = d) as ends from m group by all),
kids as (select list_slice(p, 1, d - 1) as p, count(*) as k from n where d > 0 group by 1),
own as (select n.*, coalesce(k, 0) as k, (n_convs - 1) * case when d = 0 then 0 else len(list_filter(regexp_split_to_array(p[d].t, '[ \\x09-\\x0D]+'), lambda x: x <> '')) end as s from n left join kids using (p)),
sums as (select list_slice(p, 1, a) as p, sum((k = 0)::int) as l, sum(s) as s from (select *, unnest(range(0, d + 1)) as a from own) group by 1)
select own.conv_id, own.d as depth, up.conv_id as parent_conv_id, own.n_convs, own.k as n_children, sums.l::bigint as n_leaves, sums.s::bigint as saved_tokens, sha256(coalesce(own.ends, '')) as ends_sha256
from own join sums using (p) left join n up on own.d > 0 and up.p = list_slice(own.p, 1, own.d - 1)
"""

SQL = {"op1_ngram_jaccard_join": OP1, "op5_grid_order_near_dedup": OP5, "op8_pivot_top_k": OP8, "op11_periodic_runs": OP11, "op13_prefix_trie": OP13}
