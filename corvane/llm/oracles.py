"""SQL of document operators that is longer than a line or two."""

from __future__ import annotations

#: Near-duplicate components: all shingles joined, links closed by recursion.
OP2_SQL = """
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(w[i : i + 4], ' ') as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from w where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b using (g) where a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
e as (select a, b from l union select b, a from l),
reach as (select doc_id as a, doc_id as b from documents union select r.a, e.b from reach r join e on r.b = e.a)
select doc_id, coalesce(n, 0) as n_shingles, component_id from (select a as doc_id, min(b) as component_id from reach group by 1) left join n using (doc_id)
"""
