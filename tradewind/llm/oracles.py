"""DuckDB SQL for the queries of this subpackage that SQL can express."""

OP1_URL_FILTERS = r"""
with parts as (
  select page_id, url,
         case when url is null or position('://' in url) = 0 then '' else substr(url, position('://' in url) + 3) end rest
  from pages),
split as (
  select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path, url
  from parts),
rules(h, p, v) as (values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
best as (
  select page_id, arg_max(h || p, length(h || p)) rule, arg_max(v, length(h || p)) verdict
  from split join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p)
  group by page_id)
select page_id, host, path, rule,
       coalesce(verdict, case when regexp_matches(url, '^[a-z]+://([^/?#]*\.)?doubleclick\.|/wp-(admin|login)(/|\.|$)|[?&]sessionid=|/cgi-bin/') then 'block' else 'allow' end) verdict
from split left join best using (page_id)
"""

OP9_QUALITY_RULES = r"""
with d as (select doc_id, coalesce(text, '') t, coalesce(source, '') host from documents),
w as (select doc_id, t, host, list_filter(regexp_split_to_array(t, '[ \t-\r]+'), lambda x: x <> '') ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) ls from d),
pos as (select doc_id, i, list_slice(ws, i, i + 7) win from (select doc_id, ws, unnest(range(1, len(ws) - 6)) i from w where len(ws) >= 8)),
rep as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, win) c from pos) where c > 1),
rw as (select doc_id, sum(least(8, coalesce(nxt - i, 8))) n from (select doc_id, i, lead(i) over (partition by doc_id order by i) nxt from rep) group by 1),
fig as (select w.doc_id, host, t, len(ws) n_words, length(array_to_string(ws, '')) word_chars,
               len(regexp_extract_all(t, '[#*$%&|<>]')) n_symbols, len(ls) - len(list_distinct(ls)) n_dup_lines,
               cast(coalesce(rw.n, 0) as bigint) n_repeat_words
        from w left join rw on rw.doc_id = w.doc_id),
judged as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words base_failed from fig),
lines as (select doc_id, host, t, trim(lower(regexp_replace(x, '[^\p{L}]+', ' ', 'g'))) line, len(regexp_extract_all(x, '[^ \t-\r]+')) n
          from (select doc_id, host, t, unnest(string_split(t, chr(10))) x from judged)),
sizes as (select host, count(distinct t) c from judged group by 1),
freq as (select l.host, line from lines l join sizes s on s.host = l.host where n >= 3 and line <> ''
         group by l.host, line, c having count(distinct t) > 20 or count(distinct t) >= 4 and count(distinct t) > 0.1 * c),
gone as (select doc_id, sum(n) n from lines join freq using (host, line) where n >= 3 group by 1)
select j.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       cast(n_words - coalesce(g.n, 0) as bigint) words_left,
       not base_failed and n_words - coalesce(g.n, 0) >= 20 and n_words - coalesce(g.n, 0) >= 0.3 * n_words kept
from judged j left join gone g on g.doc_id = j.doc_id
"""

OP4_SUBSTRING_DEDUP = r"""
with w as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') ws from documents),
pos as (select doc_id, i, md5(array_to_string(list_slice(ws, i, i + 34), ' ')) h from (select doc_id, ws, unnest(range(1, len(ws) - 33)) i from w where len(ws) >= 35)),
rep as (select doc_id, i from (select doc_id, i, count(*) over (partition by h) c from pos) where c > 1),
gone as (select distinct doc_id, i + k p from rep, (select unnest(range(35)) k)),
word as (select doc_id, unnest(ws) x, unnest(range(1, len(ws) + 1)) p from w),
kept as (select doc_id, string_agg(x, ' ' order by p) t from word anti join gone using (doc_id, p) group by 1),
n as (select doc_id, count(*) n from gone group by 1)
select w.doc_id, cast(len(ws) as bigint) n_words, cast(coalesce(n.n, 0) as bigint) n_removed, sha256(coalesce(t, '')) kept_sha256
from w left join n on n.doc_id = w.doc_id left join kept on kept.doc_id = w.doc_id
"""

OP6_EXACT_TOP_K = r"""
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) e from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id query_id, v.vec_id, cast(coalesce(list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2])), 0) as bigint) score
      from v q join v on q.vec_id <> v.vec_id where q.vec_id % 100 = 0)
select query_id, cast(rank as int) rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from s) where rank <= 10
"""

OP8_WARC = r"""
with p as (select page_id, coalesce(html, '') h from pages),
d as (select page_id, h, sha1(h) s, max(page_id) over (partition by h) top from p),
b as (select *, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + (((position(s[1 + 5 * i // 4] in '0123456789abcdef') - 1) * 16 + greatest(position(s[2 + 5 * i // 4] in '0123456789abcdef') - 1, 0)) >> (3 - 5 * i % 4)) % 32, 1)), '') digest from d)
select page_id, cast(octet_length(encode(h)) as bigint) payload_bytes, digest payload_digest, case when top = page_id then 'response' else 'revisit' end record_type,
       case when top <> page_id then top end refers_to
from b
"""

OP13_CONVERSATION_TRIE = r"""
with t as (select conv_id c, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) k,
                  coalesce(role, '') r, coalesce(text, '') x from conversations where conv_id is not null),
n as (select c, max(k) n, c - c % 5 b,
             xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(c::varchar, ''), lambda x: ascii(x)::bigint)),
               lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda v, i: case when v % 2 = 1 then xor(v // 2, 3988292384) else v // 2 end)), 4294967295) % 9 h
      from t group by c),
m as (select n.*, least(h, coalesce(o.n, 0)) m from n left join (select c oc, n from n) o on o.oc = n.b),
turns as (select m.c, t.k d, r, x from m join t on t.c = m.b and t.k <= m.m union all select m.c, t.k - h + m.m, r, x from m join t on t.c = m.c and t.k > h),
acc as (select c, d, x, md5(string_agg(md5(r) || md5(x), '' order by d) over (partition by c order by d rows between unbounded preceding and current row)) p from turns),
rows_ as (select c, d, p, x, lag(p, 1, '') over (partition by c order by d) q, d = max(d) over (partition by c) e from acc
          union all select m.c, 0, '', '', null, not exists (select 1 from turns where turns.c = m.c) from m),
nodes as (select d, p, min(c) c, count(*) n, min(q) q, min(octet_length(encode(x))) bytes, sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (e), '')) ends from rows_ group by d, p),
kids as (select v.d, v.p, count(w.p) k from nodes v left join nodes w on w.d = v.d + 1 and w.q = v.p group by v.d, v.p),
below as (select r.d, r.p, sum((v.n - 1) * v.bytes) saved, count(*) filter (k.k = 0) leaves
          from nodes v join kids k on k.d = v.d and k.p = v.p join rows_ r on r.c = v.c and r.d <= v.d group by r.d, r.p)
select v.c conv_id, v.d depth, u.c parent_conv_id, v.n n_convs, k.k n_children, cast(b.leaves as bigint) n_leaves, cast(b.saved as bigint) saved_tokens, v.ends ends_sha256
from nodes v join kids k using (d, p) join below b using (d, p) left join nodes u on u.d = v.d - 1 and u.p = v.q
"""

OP11_MINHASH_NEAR_DEDUP = r"""
with recursive
w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda x: x <> '') ws from documents),
s as (select distinct doc_id, case when len(ws) < 2 then array_to_string(ws, ' ') else ws[i] || ' ' || ws[i + 1] end g
      from (select doc_id, ws, unnest(range(1, greatest(len(ws), 2))) i from w where len(ws) > 0)),
n as (select doc_id, count(*) n from s group by 1),
sets as (select doc_id, sha256(string_agg(g, chr(10) order by g)) k from s group by 1),
one as (select min(doc_id) doc_id, k from sets group by k),
u as (select s.* from s semi join one using (doc_id)),
p as (select x.doc_id a, y.doc_id b, count(*) c from u x join u y on x.g = y.g and x.doc_id < y.doc_id group by 1, 2),
l as (select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 80 * (na.n + nb.n - c)
      union select o.doc_id, t.doc_id from sets t join one o using (k) where o.doc_id < t.doc_id),
e as (select a, b from l union select b, a from l),
r(a, b) as (select doc_id, doc_id from w union select r.a, e.b from r join e on r.b = e.a)
select w.doc_id, cast(coalesce(n.n, 0) as bigint) n_shingles, c.m component_id, c.m = w.doc_id kept
from w left join n using (doc_id) join (select a, min(b) m from r group by a) c on c.a = w.doc_id
"""
