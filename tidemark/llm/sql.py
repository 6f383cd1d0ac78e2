"""DuckDB SQL of the queries that SQL can express on whole tables."""

from tidemark.llm.decontam import WINDOW
from tidemark.llm.link_graph import DAMPING, RATIO, ROUNDS, RULES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _low(column: str) -> str:
    return f"translate(coalesce({column}, ''), '{UPPER}', '{LOWER}')"


def op5_sql() -> str:
    return rf"""with recursive w as (select doc_id, list_filter(regexp_split_to_array({_low("text")}, '[\x20\x09-\x0D]+'), lambda x: x <> '') l from documents),
        s as (select distinct doc_id, unnest(case when len(l) = 0 then []::varchar[] when len(l) = 1 then l else list_transform(range(1, len(l)), lambda i: l[i] || ' ' || l[i + 1]) end) g from w),
        n as (select doc_id, count(*) n from s group by 1),
        p as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
        k as materialized (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
        e as materialized (select a, b from k union all select b, a from k),
        r(doc_id, m) as (select doc_id, doc_id from n union select e.b, r.m from r join e on e.a = r.doc_id)
        select w.doc_id, coalesce(n.n, 0)::bigint n_shingles, coalesce(c.m, w.doc_id) component_id, coalesce(c.m, w.doc_id) = w.doc_id kept
        from w left join n on n.doc_id = w.doc_id left join (select doc_id, min(m) m from r group by 1) c on c.doc_id = w.doc_id"""


def op6_sql() -> str:
    words = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    grams = "list_transform(range(1, len(l) - k + 2), lambda i: struct_pack(p := i, g := array_to_string(l[i:i + k - 1], ' ')))"
    return f"""with d as (select doc_id, regexp_extract_all({_low("text")}, {words}) l from documents),
        b as (select item_id::varchar i, regexp_extract_all({_low("text")}, {words}) l from benchmark),
        x as (select distinct i, k, g.g g from (select i, k, unnest({grams}) g from (select i, l, least({WINDOW}, len(l))::bigint k from b where len(l) > 0))),
        y as (select doc_id, k, unnest({grams}) g from d, (select distinct k from x) where len(l) >= k),
        z as materialized (select distinct y.doc_id, y.k, y.g.p p, x.i i from y join x on x.k = y.k and x.g = y.g.g),
        h as (select doc_id, count(distinct q) n from (select doc_id, unnest(range(p, p + k)) q from (select distinct doc_id, k, p from z)) group by 1),
        t as (select doc_id, count(distinct i) n, sha256(string_agg(distinct i, ',' order by i)) s from z group by 1)
        select d.doc_id, len(l)::bigint n_words, coalesce(h.n, 0)::bigint n_hit, coalesce(t.n, 0)::bigint n_items, coalesce(s, sha256('')) items_sha256, coalesce(h.n, 0) > 0 contaminated
        from d left join h on h.doc_id = d.doc_id left join t on t.doc_id = d.doc_id"""


def op10_sql() -> str:
    rule = "null"
    for verdict, h, p in sorted(RULES, key=lambda r: (len(r[1]) + len(r[2]), r[0] == "block")):
        rule = f"case when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{verdict} {h}{p}' else {rule} end"
    steps = [
        "u as (select page_id, html, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end x from pages)",
        f"n as (select page_id, html, {_low("regexp_extract(coalesce(x, ''), '^[^/?#]*')")} host, regexp_extract(coalesce(x, ''), '^[^/?#]*([^?#]*)', 1) path from u)",
        f"j as (select page_id, host, path, {rule} r from n)",
        rf"""l as (select host src, {_low("h")} dst from (select host, unnest(regexp_extract_all(coalesce(html, ''), '(?i)\bhref\s*=\s*["'']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''\s>]+)', 1)) h from n where host <> ''))""",
        "lw as (select src, dst, count(*)::double weight from l where src <> dst group by all)",
        "names as (select host from n where host <> '' union select dst from lw where dst <> '')",
        "c as (select unnest(list_transform(range(1, len(s) - 1), lambda i: struct_pack(a := array_to_string(s[i:], '.'), b := array_to_string(s[i + 1:], '.')))) e from (select string_split(host, '.') s from names) where len(s) > 2)",
        "up as (select distinct e.a a, e.b b from c)",
        "g as (select src, dst, sum(weight) weight from (select * from lw union all select a, b, 1.0 from up union all select b, a, 1.0 from up) group by all)",
        "way as (select 'trust' side, src, dst, weight from g union all select 'distrust', dst, src, weight from g)",
        "step as materialized (select side, src, dst, weight / sum(weight) over (partition by side, src) share from way)",
        "r0 as materialized (select case when r[:5] = 'allow' then 'trust' else 'distrust' end side, host, count(*)::double score from j where r is not null and host <> '' group by all)",
    ]
    for i in range(ROUNDS):
        steps.append(f"r{i + 1} as materialized (select side, host, sum(score) score from (select s.side, s.dst host, r.score * s.share * {DAMPING}::double score from r{i} r join step s on s.side = r.side and s.src = r.host union all select side, host, score * (1 - {DAMPING}::double) from r0) group by all)")
    steps.append(f"k as (select host, coalesce(sum(score) filter (side = 'trust'), 0) trust, coalesce(sum(score) filter (side = 'distrust'), 0) distrust from r{ROUNDS} group by 1)")
    return f"""with {", ".join(steps)} select page_id, j.host, path, substr(r, strpos(r, ' ') + 1) as rule, case when r is not null then split_part(r, ' ', 1) when coalesce(distrust, 0) > {RATIO} * coalesce(trust, 0) then 'block' else 'allow' end verdict,
        round(coalesce(trust, 0), 6) trust, round(coalesce(distrust, 0), 6) distrust from j left join k on k.host = j.host"""
