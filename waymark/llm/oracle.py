"""What SQL can express of the registered queries, for DuckDB over the same tables."""

from __future__ import annotations

ALPHABETS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
WORDS = r"'[^\x20\x09-\x0D]+'"

CHAT = """with recursive u as (select conv_id, turn, case when turn % 6 = 0 then 'lookup' else 'ask' end as tool, text, '{"turn":' || turn || ',"prompt":' || coalesce(to_json(text)::varchar, 'null') || '}' as arguments
    from conversations where role = 'user' and conv_id is not null and turn is not null),
  a as (select conv_id, turn, text as content from conversations where role = 'assistant' and conv_id is not null and turn is not null),
  c as (select conv_id, turn, min(tool) as tool, arg_min(text, arguments) as text, count(*) as n from u group by all),
  r as (select conv_id, turn - 1 as turn, min(content) as content, count(*) as n from a group by all),
  lv as (select c.conv_id, c.turn, 0 as level from c left join c p on p.conv_id = c.conv_id and p.turn = c.turn - 2 where p.turn is null
    union all select c.conv_id, c.turn, lv.level + 1 from lv join c on c.conv_id = lv.conv_id and c.turn = lv.turn + 2),
  j as (select c.*, lv.level, r.turn is not null as answered from c join lv on lv.conv_id = c.conv_id and lv.turn = c.turn left join r on r.conv_id = c.conv_id and r.turn = c.turn)
select conv_id, 'c' || turn as call_id, 'call' as kind, level::int as level, turn, case when answered then 'linked' else 'unanswered' end as status,
  list_concat(case when text is null then ['type of prompt'] else [] end, case when tool = 'lookup' then ['type of turn'] else [] end) as errors,
  '{"arguments":{"prompt":' || coalesce(to_json(text)::varchar, 'null') || ',"turn":' || turn || '},"id":"c' || turn || '","kind":"call","tool":"' || tool || '"}' as json from j
union all
select r.conv_id, 'c' || r.turn, 'result', coalesce(j.level, 0)::int, r.turn + 1, case when j.turn is null then 'orphan' else 'linked' end, [], '{"content":' || coalesce(to_json(r.content)::varchar, 'null') || ',"id":"c' || r.turn || '","kind":"result"}'
  from r left join j on j.conv_id = r.conv_id and j.turn = r.turn
union all select conv_id, 'c' || turn, 'call', null, turn, 'duplicate', [], null from (select *, unnest(range(1, n)) from c)
union all select conv_id, 'c' || turn, 'result', null, turn + 1, 'duplicate', [], null from (select *, unnest(range(1, n)) from r)"""

REACH = """reach(a, b) as (select a, b from link union select reach.a, link.b from reach join link on link.a = reach.b)"""

VECTORS = f"""with recursive v as (select vec_id, label, embedding::double[] as e from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x != 0)) > 0),
  unit as (select vec_id, label, e, sqrt(list_dot_product(e, e)) as norm from v),
  link as (select x.vec_id as a, y.vec_id as b from unit x join unit y on x.label = y.label and len(x.e) = len(y.e) and x.vec_id != y.vec_id where list_dot_product(x.e, y.e) / (x.norm * y.norm) >= 0.93),
  {REACH}
select e.vec_id, coalesce(n.n, 0) as n_links, least(e.vec_id, coalesce(m.low, e.vec_id)) as component_id, least(e.vec_id, coalesce(m.low, e.vec_id)) = e.vec_id as kept from embeddings e
  left join (select a, count(*) as n from link group by a) n on n.a = e.vec_id left join (select a, min(b) as low from reach group by a) m on m.a = e.vec_id"""

SHINGLES = f"""with recursive w as (select doc_id, regexp_extract_all(translate(text, {ALPHABETS}), {WORDS}) as w from documents),
  s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as s from w),
  n as (select doc_id, count(*) as n from s group by all),
  common as (select x.doc_id as a, y.doc_id as b, count(*) as shared from s x join s y on x.s = y.s and x.doc_id != y.doc_id group by all),
  link as (select a, b from common join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * shared >= 90 * (na.n + nb.n - shared)),
  {REACH}
select d.doc_id, coalesce(n.n, 0) as n_shingles, least(d.doc_id, coalesce(m.low, d.doc_id)) as component_id from documents d left join n on n.doc_id = d.doc_id left join (select a, min(b) as low from reach group by a) m on m.a = d.doc_id"""

MIXING = f"""with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, {WORDS})), 0)::bigint as size, (('0x' || substr(md5(coalesce(doc_id::varchar, 'null') || '|' || coalesce(len(regexp_extract_all(text, {WORDS})), 0)), 1, 13))::bigint + 0.5e0) / 4503599627370496e0 as u from documents),
  s as (select source, sum(size)::bigint as source_size, [3e0, 1e0, 2e0][(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight from d group by source),
  l as (select *, 2e0 * source_size as cap, (1.5e0 * sum(source_size) over () - coalesce(sum(2e0 * source_size) over (order by 2e0 * source_size / weight, source nulls last rows between unbounded preceding and 1 preceding), 0e0))
    / sum(weight) over (order by 2e0 * source_size / weight, source nulls last rows between current row and unbounded following) as level from s),
  t as (select *, case when cap <= level * weight then cap else weight * (select arg_min(level, cap / weight) from l where cap > level * weight) end as target from l),
  p as (select d.*, t.source_size, t.target, floor(case when t.source_size > 0 then t.target / t.source_size else 0e0 end) as whole from d join t on d.source is not distinct from t.source),
  q as (select *, target - whole * source_size as need from p),
  z as (select source, size, any_value(need) as need, count(*)::hugeint as n from q where size > 0 group by source, size),
  y as (select source, size, need - coalesce(sum(n * size) over (partition by source order by size desc rows between unbounded preceding and 1 preceding), 0)::double as rest, sum(n * size * size) over (partition by source order by size desc rows between current row and unbounded following)::double as squares from z),
  i as (select source, max(size) as largest, arg_max(rest / squares, size) as rate from y where rest * size <= squares group by source),
  o as (select q.*, case when size > coalesce(largest, 0) then case when size > 0 then 1e0 else 0e0 end else rate * size end as p from q left join i on q.source is not distinct from i.source),
  r as (select *, case when p >= 1 then 0e0 when p > 0 then (u / (1 - u)) / (p / (1 - p)) else 'infinity'::double end as ratio from o),
  a as (select *, coalesce(sum(size) over (partition by source order by ratio, doc_id, size rows between unbounded preceding and 1 preceding), 0) as ahead from r)
select doc_id, size, source_size, target, ((whole + case when ahead + size / 2e0 <= need then 1 else 0 end) * size)::bigint as taken from a"""

URLS = f"""with r(host, path, verdict) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
  p as (select page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), {ALPHABETS}) as host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path, row_number() over () as n from pages),
  m as (select p.n, arg_max(r.host || r.path, length(r.host) + length(r.path)) as rule, arg_max(r.verdict, length(r.host) + length(r.path)) as verdict from p join r on (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path) group by p.n)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from p left join m on m.n = p.n"""

TOP_K = """with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as v from embeddings where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
  s as (select q.vec_id as query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint as score from v q join v c on c.vec_id != q.vec_id where q.vec_id % 20 = 0)
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score from s qualify rank <= 20"""

ORACLE_SQL = {"op1_chat_tools": CHAT, "op2_vector_dedup": VECTORS, "op6_ngram_join": SHINGLES, "op8_mixing": MIXING, "op9_url_rules": URLS, "op12_top_k": TOP_K}
