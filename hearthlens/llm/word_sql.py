"""SQL of the queries on words: what DuckDB computes for their rows without the operators' methods."""

#: The checksum of a list of bytes, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::bigint, {bytes}), lambda c, x:
              list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda d, k: xor(d >> 1, 3988292384 * (d & 1)))), 4294967295)"""
_BYTES = "list_transform(range(strlen({text})), lambda i: ('0x' || substr(hex(encode({text})), (2 * i + 1)::int, 2))::bigint)"

PERIODIC = rf"""
    with texts as (
        select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w,
               {_CRC.format(bytes="list_transform(string_split(doc_id::varchar, ''), lambda d: ascii(d)::bigint)")} as h from documents),
    places as (
        select doc_id, w, len(w) as n, case when h % 10 = 0 and len(w) > 0 then (h // 10) % len(w) end as a, 3 + (h // 10) % 8 as parts from texts),
    edited as (
        select doc_id, n, case when a is null then w else
            list_transform(range(n), lambda i: w[(case when i < a then i else a + (i - a) % (1 + (n - a) // parts) end + 1)::int]) end as w
        from places),
    words as (select doc_id, n, unnest(w) as word, unnest(range(n)) as i from edited where n >= 24),
    equal as (
        select x.doc_id, y.i - x.i as period, x.i
        from words x join words y on x.doc_id = y.doc_id and x.word = y.word and y.i > x.i and 3 * (y.i - x.i) <= x.n),
    islands as (
        select doc_id, period, i, i - row_number() over (partition by doc_id, period order by i) as island from equal),
    stretches as (
        select doc_id, period, min(i) as start, count(*) + period as length from islands group by doc_id, period, island
        having count(*) + period >= greatest(24, 3 * period)),
    runs as (select doc_id, start, length, min(period) as period from stretches group by doc_id, start, length),
    lists as (
        select doc_id, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as line,
               list((start, length, period)) as rows from runs group by doc_id),
    ranked as (
        select r.doc_id, r.start, r.length, r.period from runs r
        where not exists (select 1 from runs o where o.doc_id = r.doc_id and (o.length * r.period > r.length * o.period
            or (o.length * r.period = r.length * o.period and (o.start < r.start or (o.start = r.start and o.period < r.period)))))),
    dropped as (select distinct doc_id, unnest(range(start + period, start + length)) as i from runs),
    kept as (
        select x.doc_id, string_agg(x.word, ' ' order by x.i) as rest
        from words x anti join dropped d on d.doc_id = x.doc_id and d.i = x.i
        where x.doc_id in (select doc_id from lists) group by x.doc_id)
    select e.doc_id, coalesce(l.n_runs, 0) as n_runs, r.start, r.length, r.period, 1000 * r.length // r.period as exponent_milli,
           sha256(coalesce(l.line, '')) as runs_sha256, sha256(coalesce(k.rest, array_to_string(e.w, ' '))) as collapsed_sha256
    from edited e left join lists l using (doc_id) left join ranked r using (doc_id) left join kept k using (doc_id)
"""

SPELLING = rf"""
    with recursive found as (
        select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[a-z\x{{C0}}-\x{{FF}}]+')) as run from documents),
    counted as (select doc_id, run, count(*) as n, doc_id || ':' || run as own from found where length(run) >= 5 group by doc_id, run),
    sums as (select run, n, {_CRC.format(bytes=_BYTES.format(text="own"))} as h from counted),
    slipped as (
        select n, case when h % 97 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run) + 2)::int) else run end as word from sums),
    words as (select word, sum(n)::bigint as n from slipped where length(word) >= 5 group by word having sum(n) >= 3),
    places as (select word, n, unnest(range(1, length(word) + 1))::int as i from words),
    holes as (select word, n, i, substr(word, 1, i - 1) as ahead, substr(word, i + 1) as behind from places),
    replaced as (
        select a.word, b.word as other, b.n as other_n
        from holes a join holes b on a.i = b.i and a.ahead = b.ahead and a.behind = b.behind and a.word <> b.word),
    shortened as (select distinct h.word as long, h.n as long_n, w.word as short, w.n as short_n from holes h join words w on w.word = h.ahead || h.behind),
    near as (
        select * from replaced union all select long, short, short_n from shortened union all select short, long, long_n from shortened),
    best as (
        select word, count(*) as n_near, max(other_n) as top from near group by word),
    firsts as (select n.word, b.n_near, b.top, min(n.other) as other from near n join best b on b.word = n.word and n.other_n = b.top group by all),
    forms as (
        select w.word, w.n, coalesce(f.n_near, 0) as n_near, case when f.top >= 2 * w.n then f.other end as form,
               case when f.top >= 2 * w.n then f.top end as form_n
        from words w left join firsts f using (word)),
    path(word, place, form) as (
        select word, word, form from forms
        union all select p.word, f.word, f.form from path p join forms f on f.word = p.form)
    select f.word, f.form, p.place as root, f.n, f.n_near, f.form_n from forms f join path p on p.word = f.word and p.form is null
"""
