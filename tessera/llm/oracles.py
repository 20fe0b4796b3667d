"""DuckDB SQL for the corpus queries that SQL can express."""

from string import Template

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
_ITEM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_WORD = r"'[^\x20\x09-\x0D]+'"

OP5 = f"""
with d as (select doc_id, regexp_extract_all({_FOLD}, {_ITEM}) as w from documents),
b as (select item_id::varchar as item, regexp_extract_all({_FOLD}, {_ITEM}) as w from benchmark),
p as (select distinct item, least(13, len(w)) as n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') as s
      from b, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) as t(i) where len(w) > 0),
sizes as (select distinct n from p),
h as (select doc_id, item, i, p.n from (select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as s
      from d, sizes, unnest(generate_series(1, len(w) - n + 1)) as t(i)) x join p on p.n = x.n and p.s = x.s),
hit as (select doc_id, count(distinct k) as n_hit from h, unnest(generate_series(i, i + n - 1)) as t(k) group by doc_id),
it as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from h) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join hit using (doc_id) left join it using (doc_id)
"""

_COMPONENTS = f"""
with recursive d as (select doc_id, regexp_extract_all({_FOLD}, {_WORD}) as w from documents),
s as (select distinct doc_id, array_to_string(w[i : i + $wide - 1], ' ') as g from d, unnest(generate_series(1, greatest(1, len(w) - $wide + 1))) as t(i) where len(w) > 0),
c as (select doc_id, count(*) as n from s group by doc_id),
pairs as (select a.doc_id as x, b.doc_id as y, count(*) as k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select x, y from pairs join c p on p.doc_id = x join c q on q.doc_id = y where 100 * k >= $percent * (p.n + q.n - k)),
e as (select x, y from l union all select y, x from l),
r as (select doc_id as x, doc_id as y from d union select r.x, e.y from r join e on r.y = e.x)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, m as component_id$more
from d left join c using (doc_id) join (select x as doc_id, min(y) as m from r group by x) using (doc_id)
"""

OP6 = Template(_COMPONENTS).substitute(wide=5, percent=75, more="")
OP11 = Template(_COMPONENTS).substitute(wide=4, percent=80, more=", d.doc_id = m as kept")

_HOST = rf"translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}')"
_PATH = r"coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '')"


def op8(rules: list[tuple[str, str]], topics: list[str], words: list[str]) -> str:
    """Hosts whose labels are in the list that topics and words make up are blocked where no rule fits."""
    table = ", ".join(f"('{v}', '{r}', '{r.split('/')[0]}', '/{r.partition('/')[2]}')" for v, r in rules)
    quoted = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    return f"""
with u as (select page_id, {_HOST} as host, {_PATH} as path from pages),
r(verdict, rule, rh, rp) as (values {table}),
m as (select page_id, max_by(rule, len(rule)) as rule, max_by(verdict, len(rule)) as verdict from u join r on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by page_id),
t as (select unnest({quoted(topics)}) as a), w as (select unnest({quoted(words)}) as b),
p as (select unnest([a || '-' || b, b || '-' || a, a || b, b || a]) as x from t, w),
l as (select distinct x || d as label from p, (select unnest(['', '1', '2', '3', '4']) as d)),
bad as (select distinct page_id from (select page_id, unnest(string_split(host, '.')) as label from u) join l using (label))
select page_id, host, path, rule, coalesce(verdict, case when bad.page_id is not null then 'block' else 'allow' end) as verdict from u left join m using (page_id) left join bad using (page_id)
"""


OP9 = f"""
with d as (select doc_id, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), {_WORD}) as w from documents),
win as (select doc_id, i, array_to_string(w[i : i + 4], ' ') as s from d, unnest(generate_series(1, len(w) - 4)) as t(i)),
twice as (select doc_id, s from win group by doc_id, s having count(*) > 1),
rep as (select doc_id, count(distinct k) as n from win join twice using (doc_id, s), unnest(generate_series(i, i + 4)) as t(k) group by doc_id),
x as (select doc_id, source, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda y: len(y))), 0)::bigint as word_chars,
        (len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
        list_filter(string_split(text, chr(10)), lambda y: regexp_matches(y, {_WORD})) as ln, coalesce(rep.n, 0)::bigint as n_repeat_words
      from d left join rep using (doc_id)),
y as (select *, (len(ln) - len(list_distinct(ln)))::bigint as n_dup_lines, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from x),
h as (select source, count(*) as n, sum(base_failed::int) as failed from y group by source),
f as (select least(greatest(sum(failed) / sum(n), 1e-6), 1 - 1e-6) as mean, var_pop(failed / n) as spread, avg(1 / n) as inverse from h),
g as (select mean, least(greatest(mean * (1 - mean) / greatest(spread - mean * (1 - mean) * inverse, 1e-9) - 1, 2), 1e6) as weight from f),
v as (select source, (failed + weight * mean) / (n + weight) as rate from h, g)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and rate <= 0.5 as kept
from y join v on y.source is not distinct from v.source
"""

OP10 = """
with p as (select page_id, sha256(coalesce(html, '')) as payload_digest, strlen(coalesce(html, ''))::bigint as payload_bytes from pages),
g as (select payload_digest, min(page_id) as first from p where payload_bytes >= 100 group by payload_digest)
select page_id, payload_bytes, p.payload_digest, case when page_id > first then 'revisit' else 'response' end as record_type,
  case when page_id > first then first end as refers_to
from p left join g on g.payload_digest = p.payload_digest and payload_bytes >= 100
"""

OP12 = """
with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, a.label as own, b.vec_id as id, b.label, list_inner_product(a.v, b.v)::bigint as score
  from e a join e b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
p as (select anchor_id, id as positive_id, score as positive_score from s where label = own qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select anchor_id, positive_id, row_number() over w::int as rank, id as negative_id, positive_score, score as negative_score
from p join s using (anchor_id) where label <> own and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
window w as (partition by anchor_id, positive_id order by score desc, id) qualify row_number() over w <= 3
"""

# crc32 by bits: the reversed polynomial is 0xEDB88320
_CRC = """xor(list_reduce([ord(x) for x in string_split(doc_id::varchar, '')], lambda c, x:
  list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, (y & 1) * 3988292384), xor(c, x::bigint)), 4294967295::bigint), 4294967295)"""

# a run with period q is a stretch of places from which six words recur q words on, and six more
OP13 = f"""
with d as (select doc_id, {_CRC} as h, regexp_extract_all(coalesce(text, ''), {_WORD}) as w from documents),
g as (select doc_id, h, w, len(w) as n, h // 10 as g from d),
a as (select *, case when n > 0 then g % n else 0 end as a from g),
p as (select *, 1 + (n - a) // (3 + g % 8) as p from a),
t as (select doc_id, n, case when h % 10 = 0 and n > 0 then [w[case when i < a then i + 1 else a + (i - a) % p + 1 end] for i in range(n)] else w end as w from p),
x as (select doc_id, i, array_to_string(w[i + 1 : i + 6], ' ') as s from t, unnest(range(n - 5)) as u(i)),
y as (select a.doc_id, a.i, b.i - a.i as q from x a join x b on a.doc_id = b.doc_id and a.s = b.s and a.i < b.i),
z as (select *, i - row_number() over (partition by doc_id, q order by i) as k from y),
s as (select doc_id, q, min(i) as start, max(i) + 6 + q as stop from z group by doc_id, q, k),
r as (select doc_id, start, stop - start as length, min(q) as period from s where stop - start >= greatest(12, 2 * q) group by doc_id, start, stop),
o as (select doc_id, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as runs from r group by doc_id),
b as (select * from r qualify row_number() over (partition by doc_id order by length desc, start, period) = 1),
c as (select doc_id, list(distinct k) as gone from r, unnest(range(start + period, start + length)) as u(k) group by doc_id)
select doc_id, coalesce(n_runs, 0)::bigint as n_runs, start, length, period, 1000 * length // period as exponent_milli, sha256(coalesce(runs, '')) as runs_sha256,
  sha256(array_to_string(case when gone is null then w else [w[i + 1] for i in range(n) if not list_contains(gone, i)] end, ' ')) as collapsed_sha256
from t left join o using (doc_id) left join b using (doc_id) left join c using (doc_id)
"""
