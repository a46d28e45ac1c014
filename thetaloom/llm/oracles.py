"""The same results in SQL, where SQL can say them, for small tables: every pair and every window is spelled out."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

PASSAGES = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
w as (select doc_id, p, substr(h, 2 * p - 1, 100) as s from (select doc_id, h, unnest(generate_series(1, cast(len(h) // 2 - 49 as bigint))) as p from d where len(h) >= 100) x),
f as (select s, min(doc_id) as first from w group by s having min(doc_id) < max(doc_id)),
g as (select w.doc_id, w.p as a, w.p + 50 as b from w join f on w.s = f.s where f.first < w.doc_id),
m as (select *, max(b) over (partition by doc_id order by a rows between unbounded preceding and 1 preceding) as reach from g),
n as (select *, sum(case when reach is null or a > reach then 1 else 0 end) over (partition by doc_id order by a rows unbounded preceding) as run from m),
r as (select doc_id, run, min(a) as a, max(b) as b from n group by doc_id, run),
gaps as (
    select r.doc_id, run, substr(h, 2 * coalesce(lag(b) over (partition by r.doc_id order by run), 1) - 1, 2 * (r.a - coalesce(lag(b) over (partition by r.doc_id order by run), 1))) as piece
    from r join d on r.doc_id = d.doc_id
    union all select r.doc_id, max(run) + 1, substr(max(h), 2 * max(b) - 1) from r join d on r.doc_id = d.doc_id group by r.doc_id),
k as (select doc_id, string_agg(piece, '' order by run) as left_over from gaps group by doc_id),
t as (select doc_id, sum(b - a) as n_removed, count(*) as n_spans from r group by doc_id)
select d.doc_id, cast(len(h) // 2 as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, cast(coalesce(n_spans, 0) as bigint) as n_spans,
       sha256(unhex(coalesce(left_over, h))) as kept_sha256
from d left join t on d.doc_id = t.doc_id left join k on d.doc_id = k.doc_id
"""

NEAR = f"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select distinct doc_id, w[p : p + k - 1] as shingle from (select doc_id, w, least(len(w), 3) as k, unnest(generate_series(1, greatest(len(w) - 2, 1))) as p from d where len(w) > 0) x),
n as (select doc_id, count(*) as n from s group by doc_id),
l as (select a.doc_id as a, b.doc_id as b from s a join s b on a.shingle = b.shingle and a.doc_id <> b.doc_id join n x on a.doc_id = x.doc_id join n y on b.doc_id = y.doc_id
      group by a.doc_id, b.doc_id, x.n, y.n having 100 * count(*) >= 85 * (x.n + y.n - count(*))),
r(id, c) as (select doc_id, doc_id from d union select l.b, r.c from r join l on r.id = l.a)
select r.id as doc_id, cast(coalesce(max(n.n), 0) as bigint) as n_shingles, min(r.c) as component_id, r.id = min(r.c) as kept from r left join n on r.id = n.doc_id group by r.id
"""

LEAKS = f"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
i as (select item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark),
v as (select item_id, k, w[p : p + k - 1] as win from (select item_id, w, least(len(w), 10) as k, unnest(generate_series(1, greatest(len(w) - 9, 1))) as p from i where len(w) > 0) x),
u as (select doc_id, k, p, w[p : p + k - 1] as win from (select doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) as p from d cross join (select distinct k from v) s where len(w) >= k) y),
h as (select distinct u.doc_id, u.p, u.k, v.item_id from u join v on u.k = v.k and u.win = v.win),
c as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(generate_series(p, p + k - 1)) as q from h) z group by doc_id),
o as (select doc_id, count(*) as n_items, string_agg(name, ',' order by name) as names from (select distinct doc_id, cast(item_id as varchar) as name from h) z group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join c on d.doc_id = c.doc_id left join o on d.doc_id = o.doc_id
"""

MIDDLES = """
with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') as u, sha256('42:' || cast(doc_id as varchar)) as h from documents),
r as (select *, cast(len(u) as bigint) as n, [cast('0x' || substr(h, p, 8) as bigint) for p in [1, 9, 17, 25]] as k from d),
c as (select *, least(k[1] % (n + 1), k[2] % (n + 1)) as a, greatest(k[1] % (n + 1), k[2] % (n + 1)) as b,
      case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or k[3] % 100 >= 50 then 'plain' when k[4] % 100 < 80 then 'spm' else 'psm' end as form from r),
p as (select *, array_to_string(u[1 : a], '') as pre, array_to_string(u[a + 1 : b], '') as mid, array_to_string(u[b + 1 : n], '') as suf from c)
select doc_id, n, form, case when form <> 'plain' then cast(length(pre) as bigint) end as prefix_chars, case when form <> 'plain' then cast(length(mid) as bigint) end as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
       sha256(t) as restored_sha256
from p
"""

DIVERGENCE = f"""
with d as (select coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as r, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as w from documents),
t as (select lang, source, r, unnest(w) as term from d),
v as (select lang, term, cast(count(*) as hugeint) as total from t group by lang, term having count(distinct r) >= 3),
c as (select t.lang, t.source, t.term, cast(count(*) as hugeint) as n from t join v on t.lang = v.lang and t.term = v.term group by t.lang, t.source, t.term),
g as (select d.lang, d.source, cast(coalesce(max(own), 0) as hugeint) as own from (select distinct lang, source from d) d left join (select lang, source, sum(n) as own from c group by lang, source) x on d.lang = x.lang and d.source = x.source group by d.lang, d.source),
l as (select lang, sum(total) as own, count(*) as size from v group by lang),
p as (select g.lang, g.source, v.term, coalesce(n, 0) as n, 1 + (1000000000::hugeint * (coalesce(n, 0) + 1)) // (g.own + l.size) as p
      from g join l on g.lang = l.lang join v on g.lang = v.lang left join c on g.lang = c.lang and g.source = c.source and v.term = c.term),
q as (select v.lang, v.term, 1 + (1000000000::hugeint * (total + 1)) // (l.own + l.size) as q from v join l on v.lang = l.lang),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(sum(((x.p - y.p) * (x.p - y.p)) // y.p), 0) as value
          from g a join g b on a.lang = b.lang and a.source <> b.source left join p x on a.lang = x.lang and a.source = x.source left join p y on b.lang = y.lang and b.source = y.source and x.term = y.term
          where x.term is null or y.term is not null group by a.lang, a.source, b.source),
terms as (select p.lang, source, 'term' as part, p.term as item, ((p - q) * (p - q)) // q as value from p join q on p.lang = q.lang and p.term = q.term where n > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, encode(item)) as rank from (select * from pairs union all select * from terms) x)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as int) as rank from ranked where part = 'pair' or rank <= 200
"""

ORACLES = {
    "op1_suffix_array_dedup": PASSAGES,
    "op2_near_duplicates": NEAR,
    "op4_benchmark_decontamination": LEAKS,
    "op11_source_divergence": DIVERGENCE,
    "op13_fill_in_middle": MIDDLES,
}
