"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

OP2 = r"""
with w as (select doc_id, coalesce(source, '') as host, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from documents),
win as (select doc_id, i, array_to_string(ws[i:i + 7], ' ') as g from w, unnest(range(1, len(ws) - 6)) as u(i) where len(ws) >= 8),
rep as (select doc_id, g from win group by doc_id, g having count(*) >= 2),
cov as (select doc_id, count(distinct i + k) as n from win join rep using (doc_id, g), unnest(range(0, 8)) as v(k) group by doc_id),
c as (select doc_id, host, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, len(ls)::bigint as n_lines,
    (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(cov.n, 0)::bigint as n_repeat_words from w left join cov using (doc_id)),
f as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
    (n_words < 20)::int + (100 * n_repeat_words > 30 * n_words)::int + (10 * n_symbols > 3 * n_words)::int + (100 * n_dup_lines > 30 * n_lines)::int
    + (word_chars < 2 * n_words or word_chars > 15 * n_words)::int as n_failed_rules from c),
h as (select host, count(*) as host_documents, sum((n_failed_rules > 0)::bigint)::bigint as host_failures from f group by host),
m as (select greatest(least(sum(host_failures) / sum(host_documents), 1 - 1e-6), 1e-6)::double as mean, count(*) as hosts, sum(host_documents)::double as n, sum(host_failures)::double as k,
    sum(host_documents::double * host_documents) as n2, sum(host_failures::double * host_failures / host_documents) as kk from h),
z as (select mean, case when n - n2 / n - (hosts - 1) > 0 then ((kk - k * k / n) / (mean * (1 - mean)) - (hosts - 1)) / (n - n2 / n - (hosts - 1)) else 0 end as share from m),
p as (select mean, least(greatest(1 / greatest(share, 1e-9) - 1, 1.0), 1e6) as size from z),
r0 as (select h.*, (host_failures + mean * size) / (host_documents + size) as rate, host_documents + size as total, mean from h, p),
r1 as (select *, round(rate, 6) as host_rate, round(greatest(0.0, rate - 1.645 * sqrt(rate * (1 - rate) / (total + 1))), 6) as host_bound, round(mean, 6) as corpus_rate from r0),
r as (select host, host_documents, host_failures, host_rate, host_bound, corpus_rate, host_bound > corpus_rate as host_strict from r1)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    not base_failed and n_failed_rules <= (case when host_strict then 0 else 1 end) as kept,
    n_lines, n_failed_rules, host, host_documents, host_failures, host_rate, host_bound, corpus_rate, host_strict from f join r using (host)
"""

OP9 = r"""
with d as (select doc_id, source, text, coalesce(source, '') as host, string_split(text, chr(10)) as ls from documents),
n as (select host, count(*) as pages from d group by host),
c as (select host, line, count(*) as k from (select host, unnest(list_distinct(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) as line from d) group by host, line having count(*) >= 5),
b as (select host, list(line) as boiler from c join n using (host) where k > 0.1 * pages group by host),
m as (select d.*, len(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) as total,
    list_filter(ls, lambda x: not regexp_matches(x, '[^\x20\x09-\x0D]') or not list_contains(coalesce(boiler, []), x)) as kept from d left join b using (host)),
e as (select *, len(list_filter(kept, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) as rest from m)
select doc_id, source, case when text is null then text else array_to_string(kept, chr(10)) end as text,
    coalesce(total, 0)::bigint as line_total, (coalesce(total, 0) - coalesce(rest, 0))::bigint as line_dropped from e
"""


OP8 = r"""
with d as (select doc_id, string_split_regex(trim(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[\x20\x09-\x0D]+') as ws
    from documents where doc_id is not null and regexp_matches(text, '[^\x20\x09-\x0D]')),
s as (select count(*) as n, sum(len(ws)) / count(*) as mean from d),
q as (select distinct item_id as query_id, unnest(string_split_regex(trim(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[\x20\x09-\x0D]+')) as word from benchmark where item_id % 20 = 0),
p as (select doc_id, len(ws) as size, unnest(ws) as word from d),
tf as (select doc_id, size, word, count(*) as tf from p where word in (select word from q) group by doc_id, size, word),
df as (select word, count(*) as df from tf group by word),
r as (select query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 6) as score
    from tf join df using (word) join q using (word), s group by query_id, doc_id),
o as (select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) as rank from r)
select query_id, rank, doc_id, score from o where rank <= 10
"""


OP7 = r"""
with recursive d0 as (select doc_id, coalesce(text, '') as x, coalesce(source, '') as s, coalesce(lang, '') as l, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as n from documents),
d as (select doc_id, s, l, n, case when 10 * (length(x) - length(replace(x, '|', ''))) > n then 'table'
    when 10 * (length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g'))) > 3 * n then 'symbols' when n < 50 then 'short' when n >= 1000 then 'long' else 'prose' end as t from d0),
cells as (select s, l, t, sum(n)::double as tokens from d group by s, l, t),
gs as (select s, pow(sum(tokens), 0.7) / sum(pow(sum(tokens), 0.7)) over () as gs from cells group by s),
gl as (select l, pow(sum(tokens), 0.7) / sum(pow(sum(tokens), 0.7)) over () as gl from cells group by l),
gt as (select t, pow(sum(tokens), 0.7) / sum(pow(sum(tokens), 0.7)) over () as gt from cells group by t),
raked as (
    select 0 as i, s, l, t, tokens, tokens as w, gs, gl, gt from cells join gs using (s) join gl using (l) join gt using (t)
    union all
    select i + 1, s, l, t, tokens, case when w2 > 0 then w2 * gt / sum(w2) over (partition by t) else 0 end, gs, gl, gt from (
        select *, case when w1 > 0 then w1 * gl / sum(w1) over (partition by l) else 0 end as w2 from (
            select *, case when w > 0 then w * gs / sum(w) over (partition by s) else 0 end as w1 from raked where i < 40))),
fit as (select s, l, t, tokens, w from raked where i = 40),
-- Cells by weight a token: the first that the rest of the budget doesn't fill sets the factor.
o as (select *, sum(tokens) over () * 0.8 as b, coalesce(sum(tokens) over up, 0) as ct, coalesce(sum(w) over up, 0) as cw, sum(w) over () as total, row_number() over (order by w / tokens desc, s, l, t) as k
    from fit where w > 0 and tokens > 0 window up as (order by w / tokens desc, s, l, t rows between unbounded preceding and 1 preceding)),
lam as (select coalesce(arg_min((b - ct) / (total - cw), k) filter (w / tokens * (b - ct) / (total - cw) < 1), 'inf'::double) as lam from o),
f as (select s, l, t, round(w, 6) as mix_weight, round(case when tokens = 0 then 1.0 when w > 0 then least(1.0, lam * w / tokens) else 0.0 end, 6) as p from fit, lam),
r as (select d.*, f.mix_weight, case when n = 0 then 1.0 else p end as p, ('0x' || substr(md5(doc_id::varchar), 1, 8))::bigint / 4294967296.0 as u from d join f using (s, l, t))
select doc_id, n as mix_tokens, s as mix_source, l as mix_lang, t as mix_topic, mix_weight, p as mix_probability, u < p as mix_kept from r
"""


OP11 = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ts from documents),
s as (select count(*) as docs, sum(len(ts))::bigint as total from d where len(ts) > 0),
q as (select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
p as (select doc_id, row, len(ts)::bigint as n, unnest(ts) as term from (select *, row_number() over () as row from d)),
tf as (select doc_id, row, n, term, count(*)::bigint as tf from p where term in (select term from q) group by doc_id, row, n, term),
w as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w from tf, s group by term, docs),
r as (select item_id, doc_id, row, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total))))::bigint as score
    from tf join w using (term) join q using (term), s group by item_id, doc_id, row),
o as (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id)::int as rank from r where score > 0 and doc_id is not null)
select item_id, rank, doc_id, score from o where rank <= 10
"""


def _op12(rounds: int = 10) -> str:
    """Rounds of assignment and means, written out one after the other."""
    near = (
        "a{i} as materialized (select vec_id, row, arg_min(cluster, distance * 8 + cluster) as cluster, min(distance) as distance from "
        "(select vec_id, row, cluster, list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint as distance from v, c{i}) group by vec_id, row)"
    )
    # Exact floors: what is left over after division is taken off first.
    mean = (
        "m{i} as (select cluster, k, ((s - ((s % n) + n) % n) // n)::bigint as x from (select cluster, k, sum(v.x[k])::hugeint as s, count(*)::hugeint as n "
        "from a{i} join v using (row), unnest(range(1, 65)) as u(k) group by cluster, k)),\n"
        "c{j} as materialized (select cluster, coalesce(l, c) as c from c{i} left join (select cluster, list(x order by k) as l from m{i} group by cluster) using (cluster))"
    )
    steps = [near.format(i=0)]
    for i in range(rounds):
        steps += [mean.format(i=i, j=i + 1), near.format(i=i + 1)]
    last = rounds
    return f"""
with v as materialized (select vec_id, row_number() over () as row, list_transform(embedding, lambda e: floor(1024 * e::double)::bigint) as x from embeddings
    where len(embedding) = 64 and len(list_filter(embedding, lambda e: e is not null and isfinite(e))) = 64),
c0 as materialized (select (row_number() over (order by sha256('3:' || vec_id), x) - 1)::int as cluster, x as c from v qualify cluster < 8),
{(","+chr(10)).join(steps)},
h as (select cluster, sha256(array_to_string(c, ',')) as centroid_sha256 from c{last})
select vec_id, cluster, distance, (sum(distance) over (partition by cluster))::bigint as cluster_inertia, (sum(distance) over ())::bigint as inertia, centroid_sha256
from a{last} join h using (cluster)
"""


def _shrunk(k: str, n: str, towards: str, size: str) -> str:
    return f"round(({k} + {towards} * {size}) / ({n} + {size}), 9)"


def _prior(name: str, children: str, parent: str) -> str:
    return f"""{name} as (select least(greatest(1 / greatest(case when sum(room) > 1e-12 then sum(spread) / sum(room) else 0 end, 1e-9) - 1, 1.0), 1e6) as size from (
    select kk - K * K / N - (c - 1) * (K / N) * (1 - K / N) as spread, (N - nn / N - (c - 1)) * (K / N) * (1 - K / N) as room from (
        select {parent} as parent, count(*) as c, sum(n)::double as N, sum(k)::double as K, sum(n::double * n) as nn, sum(k::double * k / n) as kk from {children} where n > 0 group by 1)))"""


OP13 = rf"""
with p0 as (select page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) as path from pages),
lab as (select doc_id as page_id, bool_or(quality = 0 or toxic = 1) as bad from labels where doc_id is not null and (quality = 0 or toxic = 1) is not null group by doc_id),
p as (select p0.*, bad, case when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
    when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
    when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
    when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') then 'net/' end as rule from p0 left join lab using (page_id)),
h0 as (select host, count(bad) as n, count(*) filter (where bad) as k, rtrim(regexp_replace(string_split(host, '@')[-1], ':[0-9]*\z', ''), '.') as name from p group by host),
h1 as (select *, case when regexp_matches(name, '^[0-9.]+\z') or starts_with(name, '[') then 'address' when regexp_extract(name, '(?:^|\.)((?:ac|co|com|edu|gov|net|org)\.[a-z]{{2}})\z', 1) <> ''
    then regexp_extract(name, '(?:^|\.)((?:ac|co|com|edu|gov|net|org)\.[a-z]{{2}})\z', 1) else string_split(name, '.')[-1] end as suffix from h0),
h2 as (select *, string_split(substr(name, 1, greatest(length(name) - length(suffix) - 1, 0)), '.')[-1] as label from h1),
h as (select host, n, k, suffix, case when suffix = 'address' then name when label = '' then suffix else label || '.' || suffix end as domain from h2),
kn as (select * from h where host <> ''),
dm as (select domain, suffix, sum(n)::bigint as n, sum(k)::bigint as k from kn group by domain, suffix),
sx as (select suffix, 0 as top, sum(n)::bigint as n, sum(k)::bigint as k from dm group by suffix),
co as (select case when coalesce(sum(n), 0) > 0 then sum(k)::double / sum(n) else 0 end as corpus from sx),
{_prior("ps", "sx", "top")},
{_prior("pd", "dm", "suffix")},
{_prior("ph", "kn", "domain")},
sr as (select suffix, {_shrunk("k", "n", "corpus", "size")} as suffix_rate from sx, co, ps),
dr as (select domain, {_shrunk("k", "n", "suffix_rate", "size")} as domain_rate from dm join sr using (suffix), pd),
hr as (select h.host, n, k, {_shrunk("k", "n", "domain_rate", "size")} as rate, n + size as total from h left join dr using (domain), ph),
hb as (select *, round(greatest(0.0, rate - 1.645 * sqrt(rate * (1 - rate) / (total + 1))), 6) as rate_bound, round(corpus, 6) as corpus_rate from hr, co),
b as (select host, n as host_labels, k as host_bad, round(rate, 6) as host_rate, rate_bound, corpus_rate, coalesce(host <> '' and rate_bound > corpus_rate * 1.1, false) as host_blocked from hb)
select page_id, host, path, rule, case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow' when host_blocked then 'block' else 'allow' end as verdict,
    host_labels, host_bad, host_rate, rate_bound, corpus_rate, host_blocked from p join b using (host)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_host_quality": OP2,
        "op7_mixing": OP7,
        "op8_topk_search": OP8,
        "op9_line_dedup": OP9,
        "op11_item_search": OP11,
        "op12_kmeans": _op12(),
        "op13_url_filter": OP13,
    }
