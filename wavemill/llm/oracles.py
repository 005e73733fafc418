"""SQL that gives the rows of corpus queries, where SQL can."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: SQL for the operators whose result it can express; the others are tested against brute force.
ORACLES: dict[str, str] = {
    "op2_decontamination": f"""
with d as (select doc_id, {_WORDS} w from documents),
b as (select item_id, {_WORDS} w from benchmark where item_id is not null),
k as (select distinct item_id, array_to_string(w[i:i + 9], ' ') k, least(len(w), 10) n from b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) t(i) where len(w) > 0),
p as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') k from d, (select distinct n from k) s, unnest(range(1, len(w) - n + 2)) t(i)),
m as (select p.doc_id, p.i, p.n, k.item_id from p join k on p.k = k.k and p.n = k.n),
h as (select doc_id, count(distinct q) n_hit from (select doc_id, unnest(range(i, i + n)) q from m) group by 1),
o as (select doc_id, count(*) n_items, string_agg(s, ',' order by s) s from (select distinct doc_id, item_id::varchar s from m) group by 1)
select d.doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join h using (doc_id) left join o using (doc_id)""",
    "op5_near_dedup": rf"""
with recursive d as (select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 4], chr(1)) k from d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) t(i) where len(w) > 0),
n as (select doc_id, count(*) n from s group by 1),
c as (select a.doc_id u, b.doc_id v, count(*) c from s a join s b on a.k = b.k and a.doc_id <> b.doc_id group by all),
l as (select u, v from c join n x on x.doc_id = u join n y on y.doc_id = v where 100 * c >= 85 * (x.n + y.n - c)),
r as (select u, v from l union select r.u, l.v from r join l on r.v = l.u),
f as (select u, min(v) v from r group by 1)
select d.doc_id, coalesce(n, 0)::bigint n_shingles, least(d.doc_id, coalesce(v, d.doc_id)) component_id, d.doc_id <= coalesce(v, d.doc_id) kept
from d left join n using (doc_id) left join f on d.doc_id = f.u""",
    "op11_line_dedup": r"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) l from documents),
x as (select doc_id, i, l[i] line, translate(regexp_replace(l[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') k from d, unnest(range(1, len(l) + 1)) t(i)),
c as (select k, max(doc_id) last from x where length(k) >= 20 group by 1 having count(distinct doc_id) >= 3),
y as (select x.*, c.last is not null and x.doc_id <> c.last gone from x left join c using (k))
select doc_id, count(*)::bigint n_lines, (count(*) filter (where gone))::bigint n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) kept_sha256
from y group by 1""",
    "op12_lexical_search": r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') w from documents),
b as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) t from benchmark where item_id is not null),
s as (select count(*)::bigint big_n, sum(len(w))::bigint l from d where len(w) > 0),
p as (select doc_id, len(w)::bigint n, unnest(w) t from d),
f as (select doc_id, n, t, count(*)::bigint tf from p where t in (select t from b) group by all),
g as (select t, count(*) df from f group by 1),
v as (select t, floor(1000 * ln((2 * big_n + 2)::double / (2 * df + 1)::double))::bigint w from g, s),
r as (select item_id, doc_id, sum(v.w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * big_n) // l)))))::bigint score from b join f using (t) join v using (t), s group by all),
k as (select *, row_number() over (partition by item_id order by score desc, doc_id) rank from r where score > 0)
select item_id, rank::integer rank, doc_id, score from k where rank <= 50""",
    "op13_filter_audit": r"""
with d as (select doc_id, coalesce(lang, '') part, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
m as (select doc_id, max((quality = 1)::int) good, max((toxic = 1)::int) toxic from labels group by 1),
x as (select part, coalesce(good, 0) good, coalesce(toxic, 0) toxic, len(w) < 100 a, 100 * len(list_distinct(w)) < 80 * len(w) b, 100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 10 * length(t) c, regexp_matches(t, '[#$%&*|]') d,
  coalesce(doc_id > min(doc_id) over (partition by t), false) e from d left join m using (doc_id)),
q as (select part, good, toxic, (case when a then 'A' else '' end) || (case when b then 'B' else '' end) || (case when c then 'C' else '' end) || (case when d then 'D' else '' end) || (case when e then 'E' else '' end) bad from x),
l as (select unnest(['A', 'B', 'C', 'D', 'E']) f),
o as (select f1.f || f2.f || f3.f || f4.f || f5.f filter_order from l f1, l f2, l f3, l f4, l f5 where len(list_distinct([f1.f, f2.f, f3.f, f4.f, f5.f])) = 5),
s as (select filter_order, step, filter_order[step] f, left(filter_order, step - 1) done from o, range(1, 6) t(step)),
z as (select part, filter_order, step, f, case when done = '' then false else regexp_matches(bad, '[' || (case when done = '' then '-' else done end) || ']') end gone, contains(bad, f) fails, bad = f alone, good, toxic from q, s),
r as (select part, filter_order, step, f, count(*) filter (where not gone and not fails) kept, count(*) filter (where not gone and fails) removed, count(*) filter (where gone and fails) redundant, count(*) filter (where alone) unique_fails,
  count(*) filter (where not gone and fails and good = 1) good_lost, count(*) filter (where not gone and fails and toxic = 1) toxic_lost from z group by all)
select part, filter_order, step::integer step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, f))::bigint shapley from r""",
}
