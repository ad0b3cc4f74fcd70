"""DuckDB SQL of the registered queries, written from their stated results."""

CHAT_FORMAT = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(length(role) + length(text) + len(regexp_extract_all(role || chr(10) || text, '<\\*\|'))
    + length('<|im_start|><|im_sep|><|im_end|>') + 1) as bigint) as formatted_chars
from c group by conv_id
"""

# windows as blank-joined words, found as substrings of the blank-joined document
DECONTAMINATION = r"""
with w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents),
b as (
  select cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from benchmark),
windows as (
  select distinct item, case when len(words) < 10 then words else words[i:i+9] end as win
  from (select item, words, unnest(generate_series(1, greatest(len(words) - 9, 1))) as i from b where len(words) > 0)),
lens as (select distinct len(win) as n from windows),
spots as (
  select doc_id, i, n, words[i:i+n-1] as win
  from (select doc_id, words, n, unnest(generate_series(1, len(words) - n + 1)) as i from w, lens where len(words) >= n)),
found as (select s.doc_id, s.i, s.n, x.item from spots s join windows x on s.win = x.win),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(generate_series(i, i + n - 1)) as p from found) group by doc_id),
its as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as ids from (select distinct doc_id, item from found where item is not null) group by doc_id)
select w.doc_id, cast(len(words) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
  cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(ids, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 as contaminated
from w left join hit using (doc_id) left join its using (doc_id)
"""

NGRAM_JOIN = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') as words from documents),
sh as (
  select distinct doc_id, case when len(words) < 5 then words else words[i:i+4] end as s
  from (select doc_id, words, unnest(generate_series(1, greatest(len(words) - 4, 1))) as i from w where len(words) > 0)),
n as (select doc_id, count(*) as n from sh group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as c from sh a join sh b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
links as (select a, b from common join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
reach(a, b) as (select doc_id, doc_id from n union select r.a, l.b from reach r join links l on r.b = l.a),
top as (select a as doc_id, min(b) as c from reach group by a)
select w.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(top.c, w.doc_id) as component_id
from w left join n using (doc_id) left join top using (doc_id)
"""

EXACT_SEARCH = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * cast(x as double))) as e from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.e, c.e) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
where rank <= 10
"""

WARC = """
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as hex from pages),
d as (
  select *, min(page_id) over (partition by hex) as first,
    list_aggregate(list_transform(generate_series(0, 31), lambda g: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      cast((cast('0x' || substr(hex, (g // 8) * 10 + 1, 10) as bigint) >> (35 - 5 * (g % 8))) & 31 as bigint) + 1, 1)),
      'string_agg', '') as digest
  from p)
select page_id, cast(strlen(html) as bigint) as payload_bytes, digest as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id = first then null else first end as refers_to
from d
"""

SHARDING = """
with rows as (
  select doc_id, cast(coalesce(strlen(text), 0) as bigint) as n_bytes,
    cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15) as bigint) as h from documents),
tree as (select *, unnest(generate_series(0, 60)) as level from rows),
nodes as (
  select level, h >> (60 - level) as node, sum(n_bytes) as bytes, count(*) as n from tree group by 1, 2),
fit as (select * from nodes where bytes <= 67108864 or n = 1),
best as (
  select t.doc_id, t.n_bytes, t.h, min(t.level) as depth from tree t join fit f
  on t.level = f.level and t.h >> (60 - t.level) = f.node group by 1, 2, 3)
select b.doc_id, b.n_bytes, left(lpad(bin(b.h), 60, '0'), cast(b.depth as integer)) as shard,
  cast(b.depth as integer) as depth, cast(f.bytes as bigint) as shard_bytes, f.bytes > 67108864 as oversize
from best b join fit f on f.level = b.depth and f.node = b.h >> (60 - b.depth)
"""

LINE_DEDUP = r"""
with l as (
  select doc_id, i, line, translate(trim(line, e' \t\n\x0b\f\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from (select doc_id, unnest(ls) as line, unnest(generate_series(1, len(ls))) as i
        from (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents))),
often as (select k from l where k <> '' group by k having count(distinct doc_id) >= 10)
select doc_id, count(*) as n_lines, count(o.k) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (where o.k is null), '')) as kept_sha256
from l left join often o on l.k = o.k group by doc_id
"""

# every node as the hash of its turns; subtree sums by a join of nodes with their ancestors
PREFIX_TRIE = r"""
with t as (
  select conv_id, id, words, row_number() over (partition by conv_id order by turn nulls first, id) as p
  from (select conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as id,
          len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as words
        from conversations where conv_id is not null)),
l as (select conv_id, list({'id': id, 'w': words} order by p) as turns from t group by conv_id),
bits as (select conv_id, list_reduce(list_prepend(4294967295, list_transform(range(len(b) // 2),
           lambda i: cast('0x' || substr(b, 2 * i + 1, 2) as bigint))), lambda crc, x: list_reduce(list_prepend(xor(crc, x), range(8)),
           lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as crc
         from (select conv_id, hex(cast(conv_id as varchar)) as b from l)),
r as (
  select l.conv_id, list_concat(coalesce(f.turns[1:h], []), l.turns[h + 1:]) as turns
  from (select l.*, xor(bits.crc, 4294967295) % 4 as h from l join bits using (conv_id)) l
  left join l f on f.conv_id = l.conv_id - l.conv_id % 20),
paths as (
  select conv_id, len(turns) as length, turns, unnest(generate_series(0, len(turns))) as depth from r),
steps as (
  select conv_id, length, depth, md5(array_to_string(list_transform(turns[1:depth], lambda x: x.id), '')) as node,
    case when depth > 0 then md5(array_to_string(list_transform(turns[1:depth - 1], lambda x: x.id), '')) end as parent,
    case when depth > 0 then turns[depth].w else 0 end as words
  from paths),
nodes as (
  select depth, node, any_value(parent) as parent, any_value(words) as words, min(conv_id) as conv_id, count(*) as n_convs,
    sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (where length = depth), '')) as ends
  from steps group by depth, node),
kids as (select depth - 1 as depth, parent as node, count(*) as n from nodes where depth > 0 group by all),
own as (select n.*, coalesce(k.n, 0) as n_children from nodes n left join kids k using (depth, node)),
lines as (select distinct a.depth, a.node, b.depth as below_depth, b.node as below
          from steps a join steps b on a.conv_id = b.conv_id and b.depth >= a.depth),
sums as (select s.depth, s.node, sum(case when o.n_children = 0 then 1 else 0 end) as n_leaves, sum((o.n_convs - 1) * o.words) as saved
         from lines s join own o on o.depth = s.below_depth and o.node = s.below group by all)
select o.conv_id, o.depth, p.conv_id as parent_conv_id, o.n_convs, o.n_children, cast(n_leaves as bigint) as n_leaves,
  cast(saved as bigint) as saved_tokens, o.ends as ends_sha256
from own o join sums using (depth, node) left join nodes p on p.depth = o.depth - 1 and p.node = o.parent
"""


def _centroids(k: int = 40, rounds: int = 5, dim: int = 64) -> str:
    near = """a{r} as materialized (
  select n, v, d.d, d.c from (
    select x.n, x.v, min({{'d': list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'c': c.c}}) as d
    from vecs x cross join c{r} c group by x.n, x.v)),"""
    move = """m{r} as (
  select c, i, sum(x) as s, count(*) as n from (select c, unnest(v) as x, unnest(generate_series(1, {dim})) as i from a{r}) group by c, i),
c{s} as materialized (
  select c.c, coalesce(m.v, c.v) as v from c{r} c left join (
    select c, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) as v from m{r} group by c) m using (c)),"""
    steps = "\n".join(near.format(r=r) + "\n" + move.format(r=r, s=r + 1, dim=dim) for r in range(rounds))
    return f"""
with vecs as materialized (
  select vec_id, row_number() over () as n, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings where embedding is not null and len(embedding) = {dim}
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
c0 as materialized (
  select row_number() over (order by sha256('2:' || coalesce(cast(vec_id as varchar), '')), v) - 1 as c, v from vecs
  order by sha256('2:' || coalesce(cast(vec_id as varchar), '')), v limit {k}),
{steps}
{near.format(r=rounds)}
sums as (select c, sum(d) as d from a{rounds} group by c)
select x.vec_id, cast(a.c as integer) as cluster, cast(a.d as bigint) as distance, cast(s.d as bigint) as cluster_inertia,
  cast((select sum(d) from sums) as bigint) as inertia, sha256(array_to_string(c.v, ',')) as centroid_sha256
from vecs x join a{rounds} a using (n) join sums s on s.c = a.c join c{rounds} c on c.c = a.c
"""


CENTROIDS = _centroids()
