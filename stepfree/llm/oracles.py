"""SQL for DuckDB that gives the rows of those operators' queries that SQL can express."""

#: Whole numbers of 128 bits; division of such that are not negative rounds down.
OP11 = r"""
with docs as (select row_number() over () as id, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
words as (
    select id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from docs),
kept as (select lang, term, count(*)::hugeint as total from words group by lang, term having count(distinct id) >= 3),
counts as (select lang, source, term, count(*)::hugeint as n from words semi join kept using (lang, term) group by lang, source, term),
langs as (select lang, count(*)::hugeint as v, sum(total)::hugeint as n_lang from kept group by lang),
sums as (select lang, source, sum(n)::hugeint as n_group from counts group by lang, source),
groups as (
    select g.lang, g.source, coalesce(n_group, 0) as n_group, v, n_lang
    from (select distinct lang, source from docs) g left join langs on g.lang = langs.lang left join sums on g.lang = sums.lang and g.source = sums.source),
chances as (
    select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + 1000000000 * (coalesce(c.n, 0) + 1) // (n_group + v) as p, 1 + 1000000000 * (total + 1) // (n_lang + v) as q
    from groups g join kept k on g.lang = k.lang left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term),
sides as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value from chances a join chances b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by a.lang, a.source, b.source),
distances as (
    select a.lang, a.source, b.source as item, coalesce(value, 0) as value
    from groups a join groups b on a.lang = b.lang and a.source <> b.source left join sides s on s.lang = a.lang and s.source = a.source and s.item = b.source),
telling as (select lang, source, term as item, (p - q) * (p - q) // q as value from chances where n > 0 and p > q),
ranked as (
    select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item) as rank from distances
    union all
    (select lang, source, 'term', item, value, row_number() over (partition by lang, source order by value desc, item) as rank from telling qualify rank <= 200))
select lang, source, part, item, value::bigint as value, rank::int as rank from ranked
"""

#: A-Z is lowered by translate, as lower() changes other letters too. Windows of items meet those of documents by their words joined
#: by spaces, which no word holds.
OP12 = r"""
with cut as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
items as (
    select coalesce(item_id::varchar, '') as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
sizes as (select distinct least(len(w), 10) as k from items where len(w) > 0),
starts as (select item, w, least(len(w), 10) as k, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from items where len(w) > 0),
windows as (select distinct item, k, array_to_string(w[i:i + k - 1], ' ') as win from starts),
places as (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from cut, sizes where len(w) >= k),
met as (select p.doc_id, p.i, p.k, item from places p join windows x on p.k = x.k and array_to_string(p.w[p.i:p.i + p.k - 1], ' ') = x.win),
hit as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + k)) as j from met) group by doc_id),
named as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as ids from (select distinct doc_id, item from met) group by doc_id)
select c.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from cut c left join hit on c.doc_id = hit.doc_id left join named on c.doc_id = named.doc_id
"""

#: CRC-32 of each doc_id's decimal digits, by its table of 256 remainders; then the words, planted runs of equal words at each
#: distance, and what is left of the words.
OP13 = r"""
with bytes as (
    select n, list_reduce(list_prepend(n, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from (select unnest(range(256)) as n)),
crc_table as (select list(c order by n) as tab from bytes),
hashed as (
    select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
        xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)), lambda c, b: xor(tab[1 + (xor(c, b) & 255)], c >> 8))) as h
    from documents, crc_table),
sized as (select *, len(w) as n, h // 10 as g, case when len(w) > 0 then (h // 10) % len(w) end as a from hashed),
parts as (select *, 1 + (n - a) // (3 + g % 8) as p from sized),
places as (select doc_id, n, w, h, a, p, unnest(range(n)) as i from parts),
words as (select doc_id, n, i, w[1 + case when h % 10 = 0 and i >= a then a + (i - a) % p else i end] as word from places),
alike as (select x.doc_id, y.i - x.i as q, x.i from words x join words y on x.doc_id = y.doc_id and x.word = y.word and y.i > x.i and 2 * (y.i - x.i) <= x.n),
stretched as (select doc_id, q, i, i - row_number() over (partition by doc_id, q order by i) as island from alike),
islands as (select doc_id, q, min(i) as start, count(*) + q as length from stretched group by doc_id, q, island having count(*) >= q and count(*) + q >= 12),
runs as (select doc_id, start, length, min(q) as period from islands group by doc_id, start, length),
summed as (
    select doc_id, count(*) as n_runs, arg_max(struct_pack(start := start, length := length, period := period), (length, -start, -period)) as best,
        string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as lines
    from runs group by doc_id),
gone as (select distinct r.doc_id, unnest(range(r.start + r.period, r.start + r.length)) as i from runs r),
kept as (select words.doc_id, string_agg(word, ' ' order by words.i) as collapsed from words anti join gone on words.doc_id = gone.doc_id and words.i = gone.i group by words.doc_id)
select d.doc_id, coalesce(n_runs, 0)::bigint as n_runs, best.start::bigint as start, best.length::bigint as length, best.period::bigint as period,
    (1000 * best.length // best.period)::bigint as exponent_milli, sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(collapsed, '')) as collapsed_sha256
from documents d left join summed on d.doc_id = summed.doc_id left join kept on d.doc_id = kept.doc_id
"""
