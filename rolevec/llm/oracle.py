"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP2 = rf"""
with dw as (select doc_id, regexp_extract_all({LOWER.format('text')}, '{ALNUM}') w from documents),
bw as (select item_id, regexp_extract_all({LOWER.format('text')}, '{ALNUM}') w from benchmark),
windows as (
  select distinct item_id, least(10, len(w)) k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') g
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) i from bw where len(w) > 0)),
sizes as (select distinct k from windows),
grams as (
  select doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') g
  from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) i from dw, sizes where len(w) >= k)),
found as (select doc_id, i, k, item_id from grams join windows using (k, g)),
hits as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + k)) p from (select distinct doc_id, i, k from found)) group by 1),
items as (select doc_id, count(distinct item_id) n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) s from found group by 1)
select doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items,
  sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from dw left join hits using (doc_id) left join items using (doc_id)
"""

OP3 = """
with p as (select page_id, coalesce(html, '') h from pages),
d as (select page_id, cast(strlen(h) as bigint) payload_bytes, sha1(h) payload_digest from p),
o as (select *, max(page_id) over (partition by payload_digest, payload_bytes) owner from d)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 1000 and owner <> page_id then 'revisit' else 'response' end record_type,
  case when payload_bytes >= 1000 and owner <> page_id then owner end refers_to
from o
"""

OP7 = """
with l as (select doc_id, unnest(string_split(text, chr(10))) t, generate_subscripts(string_split(text, chr(10)), 1) - 1 k from documents where text is not null),
big as (select * from l where strlen(t) >= 40),
d as (select t, min(row(doc_id, k)) f, strlen(t) n from big group by t),
near as (select distinct b.t from d a join d b on b.n between a.n - 2 and a.n + 2 and a.f < b.f and a.t <> b.t and levenshtein(a.t, b.t) <= 2),
gone as (select big.doc_id, list(distinct cast(k as integer) order by cast(k as integer)) r
  from big join d using (t) where row(big.doc_id, big.k) <> d.f or t in (select t from near) group by 1)
select doc_id, cast(case when text is null then 0 else len(string_split(text, chr(10))) end as bigint) n_lines,
  cast(coalesce(len(r), 0) as bigint) n_removed, coalesce(r, cast([] as integer[])) removed_lines
from documents left join gone using (doc_id)
"""

OP6 = rf"""
with recursive w as (select doc_id, regexp_extract_all({LOWER.format('text')}, '[^\x20\x09-\x0D]+') w from documents),
s as (
  select distinct doc_id, array_to_string(w[i:i + 2], ' ') g from (select doc_id, w, unnest(range(1, len(w) - 1)) i from w where len(w) >= 3)
  union select doc_id, array_to_string(w, ' ') from w where len(w) in (1, 2)),
n as (select doc_id, count(*) n from s group by 1),
pairs as (select a.doc_id x, b.doc_id y, count(*) c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
links as (select x, y from pairs join n p on p.doc_id = x join n q on q.doc_id = y where 100 * c >= 90 * (p.n + q.n - c)),
both_ways as (select x, y from links union all select y, x from links),
reach as (select doc_id x, doc_id y from documents union select r.x, l.y from reach r join both_ways l on r.y = l.x)
select doc_id, coalesce(n, 0) n_shingles, (select min(y) from reach where x = doc_id) component_id
from documents left join n using (doc_id)
"""

OP9 = """
with recursive v as (select vec_id, cast(embedding as double[]) e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0 and len(list_filter(embedding, lambda c: c <> 0)) > 0),
links as (select a.vec_id x, b.vec_id y from v a join v b on a.vec_id < b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.9),
both_ways as (select x, y from links union all select y, x from links),
reach as (select vec_id x, vec_id y from embeddings union select r.x, l.y from reach r join both_ways l on r.y = l.x)
select vec_id, (select count(*) from both_ways where x = vec_id) n_links, (select min(y) from reach where x = vec_id) component_id,
  vec_id = (select min(y) from reach where x = vec_id) kept
from embeddings
"""

#: CRC-32 of a value's decimal text, bit by bit.
CRC = ("xor(4294967295, list_reduce(flatten(list_transform(string_split(cast({0} as varchar), ''), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1])),"
       " lambda c, x: case when x >= 0 then xor(c, x) else xor(c >> 1, 3988292384 * (c & 1)) end, 4294967295))")


def _sealed(n_chars: str) -> str:
    columns = ("doc_id", "source", "lang", n_chars, "text")
    return "sha256(" + " || ".join(f"coalesce(cast(strlen(cast({c} as varchar)) as varchar) || ':' || cast({c} as varchar), '-')" for c in columns) + ")"


_UP = "list_transform(range(0, (len(l) + 1) // 2), lambda i: sha256(l[2 * i + 1] || coalesce(l[2 * i + 2], '')))"

OP11 = f"""
with recursive
d as (select doc_id, lang, {_sealed('n_chars')} leaf, {_sealed(f"(n_chars + case when doc_id is not null and {CRC.format('doc_id')} % 7 = 0 then 1 else 0 end)")} claim from documents),
p as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 pos from d),
lv as (select lang, 0 k, list(leaf order by pos) l from p group by lang union all select lang, k + 1, {_UP} from lv where len(l) > 1),
sub as (select lang, k h, l[1] subroot, row_number() over (order by lang nulls first) - 1 tree from lv where len(l) = 1),
tv as (select 0 k, list(subroot order by tree) l from sub union all select k + 1, {_UP} from tv where len(l) > 1),
top as (select l[1] root from tv where len(l) = 1),
st as (select lang, k s, k, l, false above from lv where len(l) > 1 union all select lang, h + tv.k, tv.k, l, true from sub, tv where len(l) > 1),
w as (select p.doc_id, p.lang, p.pos, sub.tree, p.leaf, sub.subroot, 0 s, p.claim digest, '' proof from p join sub on sub.lang is not distinct from p.lang
  union all
  select doc_id, w.lang, pos, tree, leaf, subroot, w.s + 1,
    case when i % 2 = 1 then sha256(l[i] || digest) else sha256(digest || coalesce(l[i + 2], '')) end,
    proof || case when i % 2 = 1 then l[i] else coalesce(l[i + 2], '') end
  from (select w.*, st.l, (case when above then tree else pos end) >> st.k i from w join st on st.lang is not distinct from w.lang and st.s = w.s) w)
select doc_id, leaf, subroot, root, sha256(proof) proof_sha256, digest folded_root, digest = root verified
from w cross join top where not exists (select 1 from st where st.lang is not distinct from w.lang and st.s = w.s)
"""

OP12 = rf"""
with recursive
t as (select conv_id, coalesce(role, '') r, coalesce(text, '') x,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) n
  from conversations where conv_id is not null),
c as (select conv_id, {CRC.format('conv_id')} % 4 h from (select distinct conv_id from t)),
b as (select c.conv_id, n, r, x, 0 own from c join t on t.conv_id = c.conv_id - c.conv_id % 20 and n <= h
  union all select c.conv_id, n, r, x, 1 from c join t using (conv_id) where n > h),
q as (select conv_id, row_number() over (partition by conv_id order by own, n) depth, sha256(strlen(r) || ':' || r || x) g, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) words from b),
m as (select conv_id, cast(0 as bigint) depth, '' k, cast(null as varchar) up, cast(0 as bigint) words from c
  union all select m.conv_id, q.depth, sha256(m.k || q.g), m.k, q.words from m join q on q.conv_id = m.conv_id and q.depth = m.depth + 1),
n as (select depth, k, min(up) up, min(words) words, min(conv_id) conv_id, count(*) n_convs from m group by depth, k),
kids as (select up, depth - 1 depth, count(*) n_children from n where depth > 0 group by up, depth),
u as (select n.*, coalesce(n_children, 0) n_children from n left join kids on kids.up = n.k and kids.depth = n.depth),
sums as (select m.depth, m.k, sum((u.n_convs - 1) * u.words) saved, count(*) filter (where u.n_children = 0) leaves
  from u join m on m.conv_id = u.conv_id and m.depth <= u.depth group by m.depth, m.k),
ends as (select depth, k, string_agg(cast(conv_id as varchar), ',' order by conv_id) s from m where depth = (select max(depth) from m z where z.conv_id = m.conv_id) group by depth, k)
select u.conv_id, u.depth, above.conv_id parent_conv_id, u.n_convs, u.n_children, cast(leaves as bigint) n_leaves, cast(saved as bigint) saved_tokens, sha256(coalesce(s, '')) ends_sha256
from u join sums on sums.depth = u.depth and sums.k = u.k left join ends on ends.depth = u.depth and ends.k = u.k
left join n above on above.k = u.up and above.depth = u.depth - 1
"""

#: Exact: up to ``LEAST`` distinct vectors the index is searched whole.
OP13 = """
with v as (select distinct vec_id, embedding, cast(embedding as double[]) e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0 and len(list_filter(embedding, lambda c: c <> 0)) > 0),
p as (select q.vec_id query_id, v.vec_id, list_inner_product(q.e, v.e) score from v q join v on q.vec_id <> v.vec_id and len(q.e) = len(v.e) where q.vec_id % 20 = 0)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) rank, vec_id, score from p qualify rank <= 20
"""

ORACLE: dict[str, str] = {
    "op2_benchmark_decontamination": OP2, "op3_warc": OP3, "op6_ngram_jaccard_join": OP6, "op7_line_dedup": OP7, "op9_embedding_near_dedup": OP9,
    "op11_merkle_manifest": OP11, "op12_conversation_trie": OP12, "op13_nearest_neighbours": OP13}
