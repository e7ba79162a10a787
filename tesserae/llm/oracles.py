"""What some of the ten operators return, as DuckDB SQL over the same tables."""

from __future__ import annotations

_BLANK = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"

LINE_DEDUP = f"""
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents),
k as (select *, translate(trim(line, {_BLANK}), '{_UPPER}', '{_LOWER}') as key from l),
common as (select key from k where length(key) >= 1 group by key having count(distinct doc_id) >= 10),
m as (select doc_id, pos, line, key in (select key from common) as gone from k)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256 from m group by doc_id
"""

DECONTAMINATION = f"""
with i as (select item_id, {_WORDS} as w from benchmark), d as (select doc_id, {_WORDS} as w from documents),
win as (select distinct item_id, array_to_string(w[p + 1 : p + least(10, len(w))], ' ') as s, least(10, len(w)) as n from i, unnest(range(greatest(1, len(w) - 9))) as t(p) where len(w) > 0),
place as (select doc_id, p, n, array_to_string(w[p + 1 : p + n], ' ') as s from d, (select distinct n from win) x, unnest(range(len(w) - n + 1)) as t(p) where len(w) >= n),
hit as (select doc_id, p, place.n, item_id from place join win on place.s = win.s and place.n = win.n),
words as (select doc_id, count(distinct p + k) as n_hit from hit, unnest(range(n)) as t(k) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(x, ',' order by x) as ids from (select distinct doc_id, item_id::varchar as x from hit) group by doc_id)
select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (doc_id) left join items using (doc_id)
"""

EMBEDDINGS = """
with recursive v as (select vec_id, label, embedding::double[] as e from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
link as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.98),
reach as (select vec_id as a, vec_id as b from embeddings union select r.a, l.b from reach r join link l on r.b = l.a),
c as (select a as vec_id, min(b) as component_id from reach group by a)
select vec_id, (select count(*) from link where a = vec_id) as n_links, component_id, vec_id = component_id as kept from c
"""

SUFFIXES = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents), w as (select doc_id, p, md5_number(substr(h, 2 * p + 1, 100)) as s from d, unnest(range(length(h) // 2 - 49)) as t(p) where length(h) >= 100),
low as (select s, min(doc_id) as first from w group by s having count(*) > 1), hit as (select doc_id, p from w join low using (s) where first < doc_id),
run as (select *, sum(new) over (partition by doc_id order by p) as k from (select *, case when p <= lag(p) over (partition by doc_id order by p) + 50 then 0 else 1 end as new from hit)),
span as (select doc_id, min(p) as a, max(p) + 50 as b from run group by doc_id, k),
kept as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as from_ from span),
parts as (select doc_id, cast(sum(b - a) as bigint) as n_removed, count(*) as n_spans, max(b) as last, string_agg(substr(h, 2 * from_ + 1, 2 * (a - from_)), '' order by a) as head from kept join d using (doc_id) group by doc_id)
select doc_id, length(h) // 2 as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) as kept_sha256
from d left join parts using (doc_id)
"""

ORACLE_SQL = {"op1_benchmark_decontamination": DECONTAMINATION, "op5_suffix_array_dedup": SUFFIXES, "op7_embedding_near_dedup": EMBEDDINGS, "op8_line_dedup": LINE_DEDUP}
