"""The queries of this package as DuckDB SQL, where SQL can express them.

Samples are chosen by a hash that SQL does not have, so quality rules and secret scans are stated
for tables that do not exceed the sample bounds (20,000 trusted documents; 2,000 documents).
"""

from __future__ import annotations

from . import quality, secrets

_KEY = """translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"""

OP6 = f"""
with split as (
    select doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents),
lines as (
    select doc_id, unnest(parts) as line, unnest(range(len(parts))) as place from split),
keyed as (select *, {_KEY} as key from lines),
shared as (
    select key, max(doc_id) as holder from keyed where length(key) >= 20
    group by key having count(distinct doc_id) >= 3),
judged as (
    select k.*, s.key is not null and k.doc_id <> s.holder as gone
    from keyed k left join shared s on k.key = s.key)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
    sha256(coalesce(string_agg(line, chr(10) order by place) filter (not gone), '')) as kept_sha256
from judged group by doc_id
"""

OP10 = """
with whole as (
    select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))::bigint) as v
    from embeddings
    where vec_id is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
    select q.vec_id as query_id, x.vec_id,
        coalesce(list_sum(list_transform(list_zip(q.v, x.v), lambda p: p[1] * p[2])), 0)::bigint as score
    from whole q join whole x on q.vec_id <> x.vec_id and len(q.v) = len(x.v) where q.vec_id % 50 = 0),
ranked as (
    select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""

OP1 = rf"""
with recursive crc_table as (
    select list(c order by i) as t from (
        select i, list_reduce(list_prepend(i, range(8)), lambda c, k:
            case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c
        from (select unnest(range(256)) as i))),
split as (
    select doc_id, coalesce(text, '') as text,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words
    from documents),
placed as (select doc_id, unnest(words) as word, unnest(range(len(words))) as i from split),
vocabulary as (
    select word, hex(encode(word)) as h from (select distinct word from placed)),
coded as (
    select word, xor(list_reduce(
        list_prepend(4294967295, list_transform(range(len(h) // 2), lambda k:
            cast('0x' || substr(h, 2 * k + 1, 2) as bigint))),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) as code
    from vocabulary, crc_table),
ordered as (
    select doc_id, i, code, lag(code) over (partition by doc_id order by i) as before
    from placed join coded using (word)),
grams as (
    select doc_id, code % {quality.BUCKETS} as bucket from ordered
    union all
    select doc_id, (before * 31 + code * 17 + 7) % {quality.PAIR_PRIME} % {quality.BUCKETS}
    from ordered where before is not null),
trusted as (select distinct doc_id, 1 as good from labels where quality = 1),
counted as (
    select bucket, count(*) as raw, count(good) as good
    from grams left join trusted using (doc_id) group by bucket),
total as (select sum(raw)::double as raw, sum(good)::double as good from counted),
share as (
    select bucket, (c.raw + 1) / (t.raw + {quality.BUCKETS}) as p_raw, c.good, t.good as good_total
    from counted c, total t),
model as (
    select bucket, round({quality.UNIT} * ln((good + {quality.PRIOR} * p_raw)
        / (good_total + {quality.PRIOR}) / p_raw))::bigint as weight
    from share),
scored as (select doc_id, sum(weight)::bigint as total from grams join model using (bucket) group by doc_id),
windows as (
    select doc_id, i, count(*) over (partition by doc_id, w) as times from (
        select doc_id, unnest(range(1, len(words) - 3)) as i,
            array_to_string(words[i:i + 4], ' ') as w
        from split where len(words) >= 5)),
covered as (
    select doc_id, count(distinct i + k) as n from windows, (select unnest(range(5)) as k)
    where times > 1 group by doc_id),
lines as (
    select doc_id, list_filter(string_split(text, chr(10)),
        lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as own from split),
counts as (
    select s.doc_id, len(words)::bigint as n_words,
        coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::bigint as word_chars,
        (length(text) - length(translate(text, '#*$%&|<>', '')))::bigint as n_symbols,
        (len(own) - len(list_distinct(own)))::bigint as n_dup_lines,
        coalesce(c.n, 0)::bigint as n_repeat_words, coalesce(x.total, 0) as total
    from split s join lines using (doc_id)
    left join covered c on c.doc_id = s.doc_id left join scored x on x.doc_id = s.doc_id),
based as (
    select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from counts)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    not base_failed and total >= {round(quality.UNIT * quality.THRESHOLD)} * greatest(2 * n_words - 1, 0) as kept
from based
"""

_ASSIGN, _ACCESS, _HEX = (
    secrets.PATTERNS["assign"][0].replace("'", "''"), "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}")
_TOKEN = secrets.TOKEN


def _found(kind: int, pattern: str, group: int, least: int) -> str:
    return f"""
    select doc_id, {kind} as kind, unnest(m) as m, unnest(v) as v, unnest(range(1, len(m) + 1)) as i,
        m as all_m, p as pieces, {least} as least
    from (
        select doc_id, regexp_extract_all(text, '{pattern}', 0) as m,
            regexp_extract_all(text, '{pattern}', {group}) as v,
            string_split_regex(text, '{pattern}') as p
        from own)"""


OP9 = f"""
with own as (select doc_id, coalesce(text, '') as text from documents),
found as (
    {_found(0, _ASSIGN, 1, 6)} union all {_found(1, _ACCESS, 0, 20)}
    union all {_found(2, _HEX, 0, 24)} union all {_found(3, _TOKEN, 0, 20)}),
spans as (
    select doc_id, kind, v, start, start + length(m) as stop from (
        select *, (list_sum(list_transform(pieces[1:i], lambda x: length(x)))
            + coalesce(list_sum(list_transform(all_m[1:i - 1], lambda x: length(x))), 0))::bigint as start
        from found)
    where length(v) >= least),
base as (select * from spans where kind < 3),
random_pairs as (
    select substr(v, i, 2) as pair, count(*) as n
    from (select v, unnest(range(1, length(v))) as i from base) group by 1),
words as (
    select unnest(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(
        text, '{_ASSIGN}', ' ', 'g'), '{_ACCESS}', ' ', 'g'), '{_HEX}', ' ', 'g'), '{secrets.WORD}')) as w
    from own),
ordinary_pairs as (
    select substr(w, i, 2) as pair, count(*) as n
    from (select w, unnest(range(1, length(w))) as i from words) group by 1),
letters as (select unnest(string_split('{secrets.ALPHABET}', '')) as c),
every as (
    select a.c as a, b.c as b, coalesce(r.n, 0)::double as r, coalesce(o.n, 0)::double as o
    from letters a, letters b
    left join random_pairs r on r.pair = a.c || b.c left join ordinary_pairs o on o.pair = a.c || b.c),
model as (
    select a || b as pair, round({secrets.UNIT} * ln(
        (r + 1000.0::double / {len(secrets.ALPHABET)}) / (sum(r) over (partition by a) + 1000)
        / ((o + 0.5) / (sum(o) over (partition by a) + 0.5 * {len(secrets.ALPHABET)}))))::bigint as weight
    from every),
tokens as (select doc_id, v, start, stop from spans where kind = 3),
judged as (
    select t.doc_id, t.start, t.stop, any_value(t.v) as v, sum(weight) as total
    from (select *, unnest(range(1, length(v))) as i from tokens) t join model on pair = substr(v, i, 2)
    group by t.doc_id, t.start, t.stop),
added as (
    select doc_id, 3 as kind, start, stop from judged j
    where total >= {round(secrets.UNIT * secrets.THRESHOLD)} * (length(v) - 1)
        and not exists (select 1 from base b where b.doc_id = j.doc_id and b.start < j.stop and j.start < b.stop)),
named as (
    select doc_id, kind, start, ['assign', 'access', 'hex', 'random'][kind + 1] || ':' || start || ':' || stop as s
    from (select doc_id, kind, start, stop from base union all select * from added)),
joined as (
    select doc_id, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access,
        count(*) filter (kind = 2) as n_hex,
        coalesce(string_agg(s, ',' order by start, kind) filter (kind < 3), '') as base,
        string_agg(s, ',' order by start, kind) as spans
    from named group by doc_id)
select o.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access,
    coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from own o left join joined j on j.doc_id = o.doc_id
"""

# A table of CRC-32, as in OP1; its only use here is conv_id as decimal text.
_CRC = """
crc_table as (
    select list(c order by i) as t from (
        select i, list_reduce(list_prepend(i, range(8)), lambda c, k:
            case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c
        from (select unnest(range(256)) as i)))"""

OP11 = r"""
with doc_words as (
    select row_number() over () as r, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
item_words as (
    select item_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
windows as (
    select distinct item_id, least(len(w), 10) as n, array_to_string(w[i:i + 9], ' ') as x
    from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from item_words where len(w) > 0)),
placed as (
    select r, n, i, array_to_string(w[i:i + n - 1], ' ') as x
    from (select r, w, n, unnest(range(1, len(w) - n + 2)) as i
        from doc_words, (select distinct n from windows) where len(w) >= n)),
found as (select r, p.n, i, item_id from placed p join windows v on p.n = v.n and p.x = v.x),
hit as (
    select r, count(distinct i + k) as n_hit
    from (select r, i, unnest(range(n)) as k from (select distinct r, i, n from found)) group by r),
named as (
    select r, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids
    from (select distinct r, cast(item_id as varchar) as item_id from found where item_id is not null) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
    sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from doc_words d left join hit h on d.r = h.r left join named n on d.r = n.r
"""

OP12 = f"""
with recursive {_CRC},
turns as (
    select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
        row_number() over (partition by conv_id order by turn nulls first,
            sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as pos
    from conversations where conv_id is not null),
convs as (
    select conv_id as c, conv_id - conv_id % 100 as first, xor(list_reduce(
        list_prepend(4294967295, list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint)),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 6 as h
    from (select distinct conv_id from turns), crc_table),
parts as (
    select c, pos, role, text from convs join turns on conv_id = first and pos <= h
    union all select c, pos + 1000000, role, text from convs join turns on conv_id = c and pos > h),
rebuilt as (
    select c, row_number() over (partition by c order by pos) as depth, role, text from parts),
prefixes as (
    select c, depth, length(text) as chars, string_agg(sha256(length(role) || ':' || role || text), ',') over (
        partition by c order by depth) as key from rebuilt
    union all select c, 0, 0, '' from convs),
lasts as (select c, max(depth) as last from prefixes group by c),
nodes as (
    select depth, key, min(c) as conv_id, count(*) as n_convs, max(chars) as chars,
        sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (depth = last), '')) as ends_sha256
    from prefixes join lasts using (c) group by depth, key),
paths as (
    select n.conv_id, n.depth, n.n_convs, n.chars, n.ends_sha256, p.depth as up_depth, u.conv_id as up
    from nodes n join prefixes p on p.c = n.conv_id and p.depth <= n.depth
    join nodes u on u.depth = p.depth and u.key = p.key),
children as (
    select up as conv_id, up_depth as depth, count(*) as n from paths where up_depth = depth - 1 group by all),
totals as (
    select p.up as conv_id, p.up_depth as depth, count(*) filter (c.n is null) as n_leaves,
        sum((p.n_convs - 1) * p.chars)::bigint as saved_tokens
    from paths p left join children c on c.conv_id = p.conv_id and c.depth = p.depth group by all)
select n.conv_id, n.depth::bigint as depth, p.up as parent_conv_id, n.n_convs, coalesce(c.n, 0)::bigint as n_children,
    t.n_leaves, t.saved_tokens, n.ends_sha256
from nodes n join totals t on t.conv_id = n.conv_id and t.depth = n.depth
left join paths p on p.conv_id = n.conv_id and p.depth = n.depth and p.up_depth = n.depth - 1
left join children c on c.conv_id = n.conv_id and c.depth = n.depth
"""

OP13 = """
with whole as (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
        list_transform(embedding, lambda x: floor(256 * cast(x as double))::bigint) as v
    from embeddings
    where vec_id is not null and label is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
    select a.vec_id as anchor_id, x.vec_id, a.label = x.label as alike,
        coalesce(list_sum(list_transform(list_zip(a.v, x.v), lambda p: p[1] * p[2])), 0)::bigint as score
    from whole a join whole x on a.vec_id <> x.vec_id and len(a.v) = len(x.v) where a.vec_id % 50 = 0),
positives as (
    select anchor_id, vec_id as positive_id, score as positive_score from scored where alike
    qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
ranked as (
    select p.anchor_id, positive_id, positive_score, n.vec_id as negative_id, n.score as negative_score,
        row_number() over (partition by p.anchor_id, positive_id order by n.score desc, n.vec_id)::int as rank
    from positives p join scored n on n.anchor_id = p.anchor_id and not n.alike
        and 50 * positive_score <= 100 * n.score and 100 * n.score <= 95 * positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from ranked where rank <= 3
"""

ORACLES = {
    "op1_quality_rules": OP1, "op9_secret_scans": OP9, "op6_line_dedup": OP6, "op10_exact_topk": OP10,
    "op11_decontamination": OP11, "op12_prefix_trie": OP12, "op13_hard_negatives": OP13}
