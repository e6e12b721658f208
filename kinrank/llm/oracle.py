"""DuckDB SQL of the training-data queries, written from their definitions.

Near-duplicates are found by comparing all documents that share a shingle.
Queries with trained models, raking, heap schedules, corpus thresholds on
floats or tokenizers have no SQL; tests/llm checks them by brute force.
"""

from __future__ import annotations

_WHITE = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]+"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL: dict[str, str] = {}

SQL["op1_minhash_dedup"] = rf"""
with recursive d as (
  select row_number() over (order by doc_id) as uid, doc_id,
         regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') as w
  from documents),
s as (
  select distinct uid, array_to_string(list_slice(w, i, i + 3), ' ') as g
  from (select uid, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) as i from d where len(w) > 0) t),
n as (select uid, count(*) as n from s group by uid),
c as (select a.uid as a, b.uid as b, count(*) as shared from s a join s b on a.g = b.g and a.uid <> b.uid group by all),
e as (
  select a, b from c join n na on na.uid = a join n nb on nb.uid = b
  where 100 * shared >= 80 * (na.n + nb.n - shared)),
reach(uid, other) as (
  select uid, uid from d union select r.uid, e.b from reach r join e on e.a = r.other),
m as (select r.uid, min(d.doc_id) as component_id from reach r join d on d.uid = r.other group by r.uid)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, m.component_id, d.doc_id = m.component_id as kept
from d join m on m.uid = d.uid left join n on n.uid = d.uid
"""

SQL["op3_chat_formatting"] = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
o as (
  select *, row_number() over w as i, count(*) over (partition by conv_id) as n,
         length('<turn>') + length('</turn>') + 2 + length(replace(replace(replace(replace(role,
           '\', '\\'), '</turn>', '<\/turn>'), '<turn>', '<\turn>'), chr(10), '<\nl>'))
         + length(replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '<turn>', '<\turn>')) as size
  from t window w as (partition by conv_id order by turn nulls first, role, text)),
p as (select *, sum(size) over (partition by conv_id order by i) as upto from o)
select conv_id, count(*)::bigint as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) as turns_sha256,
       coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by i) filter (where role = 'assistant'), '')) as loss_sha256,
       sum(upto) filter (where role = 'assistant' or i = n)::bigint as formatted_chars
from p group by conv_id
"""

SQL["op9_quality_rules"] = rf"""
with d as (
  select row_number() over (order by doc_id) as uid, doc_id, source as host, coalesce(text, '') as text,
         regexp_extract_all(coalesce(text, ''), '{_WORD}') as w
  from documents),
g as (
  select uid, i, array_to_string(list_slice(w, i, i + 4), ' ') as win
  from (select uid, w, unnest(range(1, len(w) - 3)) as i from d where len(w) >= 5) t),
twice as (select uid, i from (select uid, i, count(*) over (partition by uid, win) as c from g) t where c > 1),
rep as (
  select uid, count(distinct p) as n from (select uid, unnest(range(i, i + 5)) as p from twice) t group by uid),
l as (
  select uid, host, line, i
  from (select uid, host, unnest(string_split(text, chr(10))) as line,
               unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from d) t
  where regexp_matches(line, '[^\x20\x09-\x0D]')),
dup as (select uid, count(*) - count(distinct line) as n from l group by uid),
norm as (
  select uid, host, i, trim(regexp_replace({_LOWER.format('line')}, '{_WHITE}', ' ', 'g'), ' ') as line from l),
h as (select uid, host, i, substr(md5(line), 1, 15) as h, len(string_split(line, ' ')) as n from norm),
page as (select uid, string_agg(h, ' ' order by i) as context from h group by uid),
often as (
  select host, h from (select distinct host, h, context from h join page using (uid)) t
  group by host, h having count(*) > 20),
gone as (
  select uid, sum(n) as n from h join often o on o.host is not distinct from h.host and o.h = h.h group by uid),
f as (
  select d.doc_id, len(w)::bigint as n_words,
         length(regexp_replace(text, '{_WHITE}', '', 'g'))::bigint as word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
         coalesce(dup.n, 0)::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words,
         coalesce(gone.n, 0)::bigint as removed_words
  from d left join dup using (uid) left join rep using (uid) left join gone using (uid)),
r as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from f)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and not (removed_words > 0 and n_words - removed_words < 0.25 * n_words) as kept, removed_words
from r
"""

SQL["op10_line_dedup"] = r"""
with d as (select row_number() over (order by doc_id) as uid, doc_id, string_split(text, chr(10)) as lines from documents),
l as (select uid, doc_id, unnest(lines) as line, unnest(range(1, len(lines) + 1)) as i from d),
p as (
  select uid, doc_id, i, line || chr(10) || next as pair
  from (select *, lead(line) over (partition by uid order by i) as next from l) t
  where next is not null and regexp_matches(line || next, '[^\x20\x09-\x0D]')),
r as (
  select uid, i, seen from (
    select uid, i, row_number() over (partition by pair order by doc_id nulls first, uid, i) as seen,
           count(*) over (partition by pair) as n from p) t
  where n > 1),
gone as (
  select uid, unnest([i, i + 1]) as i from r where seen > 1
  except select uid, unnest([i, i + 1]) as i from r where seen = 1),
chunks as (
  select uid, count(*) as n from (select uid, i - lag(i) over (partition by uid order by i) as step from r) t
  where step is null or step > 1 group by uid),
cuts as (
  select uid, count(*) as n from (select uid, i - lag(i) over (partition by uid order by i) as step from gone) t
  where step is null or step > 1 group by uid),
k as (
  select l.uid, count(g.i) as removed, string_agg(line, chr(10) order by l.i) filter (where g.i is null) as clean
  from l left join gone g on g.uid = l.uid and g.i = l.i group by l.uid)
select d.doc_id, coalesce(len(d.lines), 0)::bigint as n_lines, coalesce(chunks.n, 0)::bigint as n_chunks,
       coalesce(cuts.n, 0)::bigint as removed_chunks, coalesce(k.removed, 0)::bigint as removed_lines,
       sha256(coalesce(k.clean, '')) as clean_sha256
from d left join k on k.uid = d.uid left join chunks on chunks.uid = d.uid left join cuts on cuts.uid = d.uid
"""

SQL["op11_filter_audit"] = rf"""
with recursive l(f) as (values ('A'), ('B'), ('C'), ('D'), ('E')),
o(filter_order, k) as (
  select f, 1 from l
  union all select o.filter_order || l.f, k + 1 from o join l on not contains(o.filter_order, l.f) where k < 5),
t as (
  select row_number() over () as uid, doc_id, coalesce(source, '') as part, coalesce(text, '') as text,
         regexp_extract_all(coalesce(text, ''), '{_WORD}') as w
  from documents),
m as (
  select uid, part,
    len(w) < 50 as a, 100 * len(list_distinct(w)) < 65 * len(w) as b,
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) as c,
    regexp_matches(text, '[#$%&*|]') as d,
    coalesce(min(doc_id) over (partition by text) < doc_id, false) as e,
    exists (select 1 from labels x where x.doc_id = t.doc_id and x.quality = 1) as good,
    exists (select 1 from labels x where x.doc_id = t.doc_id and x.toxic = 1) as toxic
  from t),
p as (
  select part, good, toxic,
         case when a then 'A' else '' end || case when b then 'B' else '' end || case when c then 'C' else '' end
         || case when d then 'D' else '' end || case when e then 'E' else '' end as fails, count(*) as n
  from m group by all),
s as (
  select part, filter_order, step, filter_order[step] as own,
         fails, n, good, toxic, contains(fails, filter_order[step]) as failing,
         regexp_matches(fails, '[' || filter_order[:step - 1] || '0]') as gone
  from p, (select filter_order, unnest(range(1, 6)) as step from o where k = 5)),
g as (
  select part, filter_order, step, own,
    sum(case when not gone and not failing then n else 0 end)::bigint as kept,
    sum(case when not gone and failing then n else 0 end)::bigint as removed,
    sum(case when gone and failing then n else 0 end)::bigint as redundant,
    sum(case when fails = own then n else 0 end)::bigint as unique_fails,
    sum(case when not gone and failing and good then n else 0 end)::bigint as good_lost,
    sum(case when not gone and failing and toxic then n else 0 end)::bigint as toxic_lost
  from s group by all)
select part, filter_order, step::integer as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) over (partition by part, own))::bigint as shapley
from g
"""

SQL["op12_substring_dedup"] = rf"""
with d as (
  select row_number() over (order by doc_id) as uid, doc_id,
         regexp_extract_all(coalesce(text, ''), '{_WORD}') as w
  from documents),
v as (
  select uid, i, array_to_string(list_slice(w, i, i + 19), ' ') as g
  from (select uid, w, unnest(range(1, greatest(len(w) - 18, 1))) as i from d) t),
r as (select uid, i, row_number() over (partition by g order by uid, i) as k from v),
x as (select distinct uid, unnest(range(i, i + 20)) as pos from r where k > 1),
k as (
  select uid, count(*) - count(gone) as left_, count(gone) as gone,
         coalesce(string_agg(word, ' ' order by pos) filter (where gone is null), '') as kept
  from (select d.uid, e.pos, d.w[e.pos] as word, x.pos as gone
        from d, unnest(range(1, len(d.w) + 1)) as e(pos) left join x on x.uid = d.uid and x.pos = e.pos) t
  group by uid)
select doc_id, len(w)::bigint as n_words, coalesce(gone, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join k using (uid)
"""
