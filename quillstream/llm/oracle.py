"""SQL that gives the same rows as the queries of this subpackage, where SQL can express them."""

from __future__ import annotations

#: A word, as in common.WORD.
W = r"[^\x20\x09-\x0D]+"
#: Sources are capped in the order of size by weight; the first one that its share does not exceed ends it.
OP7 = f"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{W}'))::bigint as size from documents),
s as (select source, sum(size)::hugeint as s from d group by source),
i as (select *, [1, 2, 3][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::hugeint as w from s),
o as (select *, row_number() over (order by s / w, source) as k, sum(s) over () as total, sum(w) over () as weights,
  coalesce(sum(s) over (order by s / w, source rows between unbounded preceding and 1 preceding), 0) as s0, coalesce(sum(w) over (order by s / w, source rows between unbounded preceding and 1 preceding), 0) as w0 from i),
c as (select min_by(total - 3 * s0, k) as rest, min_by(weights - w0, k) as weight, min(k) as k from o where (total - 3 * s0) * w <= 3 * s * (weights - w0)),
t as (select source, s::bigint as source_size, case when o.k < c.k then (3 * s)::double else rest::double * w::double / weight::double end as target from o, c),
r as (select d.*, source_size, target, least(3.0::double, coalesce(target / nullif(source_size, 0), 0)) as rate, ('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, '')), 1, 12))::bigint::double / 281474976710656::double as u from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target, (size * (floor(rate)::bigint + case when u < rate - floor(rate) then 1 else 0 end))::bigint as taken from r
"""
OP3 = f"""
with d as materialized (select doc_id, regexp_extract_all(coalesce(text, ''), '{W}') as w from documents),
win as materialized (select doc_id, i, array_to_string(w[i:i + 19], ' ') as x from (select doc_id, w, unnest(range(1, len(w) - 18)) as i from d where len(w) >= 20)),
f as (select x, min((doc_id, i)) as f from win group by x having count(*) > 1),
rep as (select doc_id, i from win join f using (x) where (doc_id, i) <> f),
cov as (select distinct doc_id, i + k as p from rep, range(0, 20) r(k)),
c as materialized (select doc_id, list(p) as p from cov group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(len(p), 0)::bigint as n_removed,
  sha256(array_to_string(case when p is null then w else list_filter(w, lambda x, j: not list_contains(p, j)) end, ' ')) as kept_sha256
from d left join c on c.doc_id = d.doc_id
"""
