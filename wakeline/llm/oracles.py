"""DuckDB SQL that computes the same rows as the queries of this subpackage, by other means."""

from __future__ import annotations

QUALITY_RULES = r"""
with d as (
  select row_number() over () as r, doc_id, coalesce(text, '') as t from documents
), w as (
  select r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l
  from d
), win as (
  select r, unnest(range(1, len(w) - 6)) as p, w from w where len(w) >= 8
), keyed as (
  select r, p, array_to_string(w[p:p + 7], chr(31)) as k from win
), twice as (
  select r, p from (select r, p, count(*) over (partition by r, k) as c from keyed) where c >= 2
), covered as (
  select r, count(distinct q) as n from (select r, unnest(range(p, p + 8)) as q from twice) group by r
), m as (
  select doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols,
         (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
         coalesce(n, 0)::bigint as n_repeat_words, len(l) as n_lines,
         len(regexp_extract_all(t, '\p{Lu}')) as n_upper, len(regexp_extract_all(t, '\p{L}')) as n_letters
  from w left join covered using (r)
), f as (
  select *,
    (case when n_words < 20 then 1 else 0 end
    + case when 100 * n_repeat_words > 30 * n_words then 2 else 0 end
    + case when 10 * n_symbols > n_words then 4 else 0 end
    + case when n_letters >= 20 and 2 * n_upper > n_letters then 8 else 0 end
    + case when n_words > 0 and word_chars < 2 * n_words then 16 else 0 end
    + case when n_words > 0 and word_chars > 25 * n_words then 32 else 0 end
    + case when n_lines >= 4 and 10 * n_dup_lines > 3 * n_lines then 64 else 0 end
    + case when word_chars > 0 and 4 * n_letters < word_chars then 128 else 0 end)::bigint as fail_bits
  from m
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (fail_bits & 3) != 0 as base_failed, (fail_bits & (1 + 2 + 4 + 8 + 16 + 128)) = 0 as kept, fail_bits
from f
"""
_POLICIES = {"base": (0, 1), "v1": (0, 1, 2, 3), "v2": (0, 1, 2, 3, 4, 7), "strict": (0, 1, 2, 3, 4, 5, 6, 7)}
_RULES = ("few_words", "repeated_windows", "symbols", "shouting", "short_words", "long_words", "repeated_lines", "few_letters")


def quality_rules() -> str:
    """QUALITY_RULES with the verdict of every policy, bit by bit."""
    kept = ", ".join(f"not ({' or '.join(f'(fail_bits >> {b}) & 1 = 1' for b in bits)}) as kept_{p}" for p, bits in _POLICIES.items())
    return QUALITY_RULES.replace("as kept, fail_bits\nfrom f", f"as kept, fail_bits, {kept}\nfrom f")


def quality_ablation() -> str:
    """Per policy and rule, counted document by document from lists of failed rules."""
    plans = ", ".join(f"('{p}', {list(bits)}, {b}, '{_RULES[b]}')" for p, bits in _POLICIES.items() for b in bits)
    head = QUALITY_RULES[: QUALITY_RULES.rindex("select doc_id")]
    return (
        head
        + f""", plans as (select * from (values {plans}) p(policy, bits, bit, rule)),
b as (select fail_bits, list_filter(range(8), lambda i: (fail_bits >> i) & 1 = 1) as failed from f),
h as (select policy, rule, bit, fail_bits, list_intersect(failed, bits) as hit from b, plans)
select policy, rule, count(*) filter (where len(hit) = 0)::bigint as kept, count(*) filter (where len(hit) = 0 or (len(hit) = 1 and hit[1] = bit))::bigint as kept_without,
       count(*) filter (where len(hit) = 1 and hit[1] = bit)::bigint as only_this, bit_or(case when len(hit) = 0 then 0 else fail_bits end)::bigint as bits_seen
from h group by policy, rule"""
    )



LINE_DEDUP = r"""
with d as (
  select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents
), x as (
  select doc_id, unnest(l) as line, unnest(range(0, len(l))) as pos from d
), k as (
  select doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from x
), f as (
  select key, max(doc_id) as keeper from k where length(key) >= 40 group by key having count(distinct doc_id) >= 5
), s as (
  select k.*, f.key is not null and k.doc_id != f.keeper as gone from k left join f using (key)
)
select doc_id, count(*)::bigint as n_lines, count(*) filter (where gone)::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from s group by doc_id
"""


def _raked(rounds: int, temperature: float) -> tuple[str, int]:
    """Raking unrolled: one window a margin and round; the CTEs and the number of the last one."""
    dims = ("source", "lang", "topic")
    sql = [
        r"""d as (select doc_id, source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as n_tokens from documents)""",
        """k as (select *, case when n_tokens < 100 then 'brief' when n_tokens < 1000 then 'article' else 'long' end as topic from d)""",
        """c as (select source, lang, topic, sum(n_tokens)::double as t from k group by all)""",
    ]
    for dim in dims:
        sql.append(f"""m_{dim} as (select {dim} as v, pow(sum(t), {temperature}) as p from c group by {dim} having sum(t) > 0)""")
    shares = ", ".join(f"coalesce((select p / (select sum(p) from m_{dim}) from m_{dim} where v is not distinct from c.{dim}), 0) as t_{dim}" for dim in dims)
    sql.append(f"f0 as (select c.*, {shares}, 1.0::double as f from c)")
    n = 0
    for _ in range(rounds):
        for dim in dims:
            sql.append(f"g{n} as materialized (select *, sum(t * f) over (partition by {dim}) as h from f{n})")
            sql.append(f"f{n + 1} as materialized (select source, lang, topic, t, t_source, t_lang, t_topic, case when h > 0 then f * t_{dim} / h else f end as f from g{n})")
            n += 1
    return "with " + ",\n".join(sql) + f""",
o as (select max(f) filter (where t > 0) as top, sum(t * f) as total from f{n})
""", n


def mixing_margins(rounds: int = 8, temperature: float = 0.7) -> str:
    head, n = _raked(rounds, temperature)
    each = [f"select '{dim}' as dimension, {dim} as value, any_value(t_{dim}) as target, sum(t * f) / any_value(total) as share from f{n}, o group by {dim}" for dim in ("source", "lang", "topic")]
    return head + ", a as (" + " union all ".join(each) + ") select dimension, value, round(target, 6) as target, round(share, 6) as share, abs(share - target) < 1e-6 as met from a"


def mixing(rounds: int = 8, temperature: float = 0.7, seed: int = 17) -> str:
    head, n = _raked(rounds, temperature)
    u = f"('0x' || substr(md5('{seed}:' || coalesce(k.doc_id::varchar, 'null')), 1, 13))::bigint / 4503599627370496.0::double"
    p = "case when t > 0 and top > 0 then f / top else 1 end"
    return (
        head + f"""
select doc_id, k.source, k.lang, k.topic, n_tokens,
       round(case when total > 0 then t * f / total else 0 end, 9) as cell_weight, round({p}, 9) as probability, {u} < {p} as kept
from k join f{n} x on k.source is not distinct from x.source and k.lang is not distinct from x.lang and k.topic = x.topic, o"""
    )


def secret_scan() -> str:
    """Spans from marked matches: a private-use character before every match cuts the text, one after it ends the match."""
    either = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
    names = "|".join(either(w) for w in ("password", "passwd", "secret", "token")) + "|" + either("api") + "_?" + either("key")
    value = "[A-Za-z0-9+/_.=-]"
    kinds = [
        ("assign", f"""((?:{names})["\']?\\x20*[:=]\\x20*["\']?)({value}+)""", "length(b) >= 6"),
        ("access", "()(AKIA[A-Z0-9]+)", "length(b) >= 20"),
        ("hex", "()([0-9a-f]+)", "length(b) >= 24"),
        ("private_key", "()(-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?:[^-]*-----END (?:[A-Z]+ )*PRIVATE KEY-----)?)", "true"),
    ]
    parts = []
    for i, (kind, pattern, test) in enumerate(kinds):
        quoted = pattern.replace("'", "''")
        parts.append(
            f"""select r, {i} as k, '{kind}' as kind, s, s + length(a) + length(b) as e from (
    select r, sum(length(replace(replace(p, chr(57345), ''), chr(57346), ''))) over (partition by r order by n rows between unbounded preceding and 1 preceding) as s,
           string_split(string_split(p, chr(57346))[1], chr(57345))[1] as a, string_split(string_split(p, chr(57346))[1], chr(57345))[2] as b, n
    from (select r, unnest(q) as p, unnest(range(len(q))) as n from (
      select r, string_split(regexp_replace(t, '{quoted}', chr(57344) || '\\1' || chr(57345) || '\\2' || chr(57346), 'g'), chr(57344)) as q from d))
  ) where n > 0 and {test}"""
        )
    return (
        "with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents), f as (\n  "
        + "\n  union all ".join(parts)
        + """
), g as (
  select r, count(*) filter (where k = 0) as n_assign, count(*) filter (where k = 1) as n_access, count(*) filter (where k = 2) as n_hex,
         string_agg(kind || ':' || s || ':' || e, ',' order by s, k) filter (where k < 3) as base, string_agg(kind || ':' || s || ':' || e, ',' order by s, k) as spans
  from f group by r
)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join g using (r)"""
    )

URL_FILTER = r"""
with u as (
  select page_id, case when position('://' in coalesce(url, '')) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages
), p as (
  select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from u
), q as (
  select *, string_split(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.') as l from p
), x as (
  select page_id, host, path,
         array_to_string(l[-2:], '.') in ('co.uk', 'org.uk', 'ac.uk', 'com.au', 'co.jp', 'com.br', 'co.nz', 'co.in') as two, l from q
), h as (
  select page_id, host, path, array_to_string(case when two then l[-3:] else l[-2:] end, '.') as domain,
         array_to_string(case when two then l[-2:] else l[-1:] end, '.') as suffix
  from x
), said as (
  select doc_id, max(case when quality = 0 or toxic = 1 then 1 else 0 end) as bad from labels where quality is not null or toxic is not null group by doc_id
), hosts as (
  select host, any_value(domain) as domain, any_value(suffix) as suffix, count(bad) as n, coalesce(sum(bad), 0) as k from h left join said on doc_id = page_id group by host
), domains as (
  select domain, suffix, sum(n) as n, sum(k) as k from hosts group by all
), suffixes as (
  select suffix, sum(n) as n, sum(k) as k from domains group by all
), sums as (
  select 's' as level, n, k from suffixes union all select 'd', n, k from domains union all select 'h', n, k from hosts
), moments as (
  select level, count(*)::double as g, sum(n)::double as n, sum(k)::double as k, sum(n::double * n) as n2, sum(k::double * k / n) as k2 from sums where n > 0 group by level
), strengths as (
  select level, case when g >= 2 and k > 0 and k < n and n - n2 / n > g - 1 then
      1 / greatest(1 / 1001.0::double, least(0.5::double, ((k2 - n * (k / n) * (k / n)) / ((k / n) * (1 - k / n)) - (g - 1)) / (n - n2 / n - (g - 1)))) - 1
    else 1000.0::double end as m
  from moments
), m as (
  select coalesce((select m from strengths where level = 's'), 1000) as ms, coalesce((select m from strengths where level = 'd'), 1000) as md,
         coalesce((select m from strengths where level = 'h'), 1000) as mh, (select (coalesce(sum(k), 0) + 0.5::double) / (coalesce(sum(n), 0) + 1) from suffixes) as p0,
         (select coalesce(sum(n), 0) from suffixes) as n0
), ps as (
  select suffix, (k + ms * p0) / (n + ms) as ps, n as n1 from suffixes, m
), vs as (
  select suffix, ps, ps * (1 - ps) / (n1 + ms + 1) + power(ms / (n1 + ms), 2) * p0 * (1 - p0) / (n0 + 2) as vs from ps, m
), pd as (
  select domain, suffix, (k + md * ps) / (n + md) as pd, n as n2, vs from domains join vs using (suffix), m
), vd as (
  select domain, suffix, pd, pd * (1 - pd) / (n2 + md + 1) + power(md / (n2 + md), 2) * vs as vd from pd, m
), ph as (
  select host, n, mh, vd, (k + mh * pd) / (n + mh) as bad_rate from hosts join vd using (domain, suffix), m
), rated as (
  select host, bad_rate, bad_rate - 1.645 * sqrt(bad_rate * (1 - bad_rate) / (n + mh + 1) + power(mh / (n + mh), 2) * vd) as bound from ph
), rules as (
  select * from (values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')) t(rh, rp, rv)
), fit as (
  select page_id, host, path, rh || rp as rule, rv,
         row_number() over (partition by page_id order by length(rh || rp) desc, rh || rp) as place
  from p left join rules on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp)
)
select page_id, host, path, rule, coalesce(rv, case when bound > 0.5 then 'block' else 'allow' end) as verdict,
       round(bad_rate, 9) as bad_rate, round(bound, 9) as bound
from fit join rated using (host) where place = 1
"""


def quality_classifier() -> str:
    """The measurements of QUALITY_RULES, then counts, shrinkage and log odds."""
    measured = QUALITY_RULES[: QUALITY_RULES.index("), f as (")].replace("select row_number() over () as r, doc_id,", "select row_number() over () as r, doc_id, coalesce(source, '') as host, coalesce(lang, '') as path,")
    measured = measured.replace("select r, doc_id, t,", "select r, doc_id, host, path, t,").replace("select doc_id, len(w)", "select doc_id, host, path, len(w)")
    per = lambda a, b, times=20: f"case when {b} > 0 then least(20, {times} * {a} // {b}) else 0 end"
    bins = ", ".join([per("n_symbols", "n_words"), per("n_upper", "n_letters"), per("n_repeat_words", "n_words"), per("n_dup_lines", "n_lines"), per("word_chars", "n_words", 2), per("n_letters", "word_chars"), "least(20, length(bin(n_words)))"])
    strength = """case when g >= 2 and k > 0 and k < n and n - n2 / n > g - 1 then
      1 / greatest(1 / 1001.0::double, least(0.5::double, ((k2 - n * (k / n) * (k / n)) / ((k / n) * (1 - k / n)) - (g - 1)) / (n - n2 / n - (g - 1)))) - 1
    else 1000.0::double end"""
    moments = lambda t: f"(select {strength} from (select count(*)::double as g, sum(n)::double as n, sum(k)::double as k, sum(n::double * n) as n2, sum(k::double * k / n) as k2 from {t} where n > 0))"
    return (
        measured
        + f"""), x as (select doc_id, host, path, [{bins}] as bins from m),
said as (select doc_id, case when min(quality) = 1 then 1 else 0 end as good from labels where quality is not null group by doc_id),
lab as (select x.*, good from x join said using (doc_id)),
e as (select good, unnest(range(7)) * 21 + unnest(bins) as key from lab),
tot as (select sum(good) as all_good, sum(1 - good) as all_bad from lab),
llr as (select key, ln((sum(good) + 1)::double / (any_value(all_good) + 21)) - ln((sum(1 - good) + 1)::double / (any_value(all_bad) + 21)) as v from e, tot group by key),
sums as (select host, path, count(good) as n, coalesce(sum(good), 0) as k from x left join said using (doc_id) group by all),
hosts as (select host, sum(n) as n, sum(k) as k from sums group by all),
g as (select (sum(k) + 0.5::double) / (sum(n) + 1) as p0, {moments("hosts")} as mh, {moments("sums")} as mp from hosts),
ph as (select host, (k + mh * p0) / (n + mh) as ph from hosts, g),
pp as (select host, path, (k + mp * ph) / (n + mp) as site_rate from sums join ph using (host), g),
y as (select row_number() over () as r, * from x),
t as (select r, unnest(range(7)) * 21 + unnest(bins) as key from y),
ev as (select r, sum(coalesce(v, 0)) as evidence from t left join llr using (key) group by r),
z as (select doc_id, host, path, evidence, site_rate, 1 / (1 + exp(-(ln(site_rate / (1 - site_rate)) + evidence))) as score from y join ev using (r) join pp using (host, path))
select doc_id, host, path, round(evidence, 8) as evidence, round(site_rate, 9) as site_rate, round(score, 8) as score, score >= 0.5 as kept from z"""
    )


def merkle_manifest(levels: int = 6, over: int = 5) -> str:
    """Trees of 16 over at most 16 ** levels documents a source and 16 ** over sources, level by level."""
    size = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR END"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    fields = " || ".join(size(c) for c in ("doc_id", "source", "lang", "n_chars"))
    # CRC-32 bit by bit, reflected polynomial.
    step = "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)), lambda c, b: {step}), 4294967295)"

    def tree(name: str, height: int) -> str:
        """name0 (g, i, d, n) -> name1 ... , each with the siblings left (l) and right (r) of a node."""
        out = ""
        for k in range(height):
            run = "PARTITION BY g, i // 16 ORDER BY i ROWS BETWEEN"
            out += f""", {name}s{k} AS (SELECT g, i, n, coalesce(string_agg(d, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
                coalesce(string_agg(d, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k})
            , {name}{k + 1} AS (SELECT g, i // 16 AS i, CASE WHEN max(n) = 1 THEN max(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d, (max(n) + 15) // 16 AS n
                FROM {name}{k} GROUP BY g, i // 16)"""
        return out

    steps = [(f"a{k}", f"JOIN as{k} a{k} ON a{k}.g = q.g AND a{k}.i = q.i // {16**k}") for k in range(levels)]
    steps += [(f"b{k}", f"JOIN bs{k} b{k} ON b{k}.i = o.i // {16**k}") for k in range(over)]
    joins = [j for _, j in steps]
    folds = "".join(f", f{k + 1} AS (SELECT *, CASE WHEN n{k} > 1 THEN sha256(l{k} || f{k} || r{k}) ELSE f{k} END AS f{k + 1} FROM {f'f{k}' if k else 'met'})" for k in range(len(steps)))
    sides = " || ".join(f"l{k} || r{k}" for k in range(len(steps)))
    last = f"f{len(steps)}"
    return f"""
    WITH rows AS (SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS g, sha256({fields} || {size('text')}) AS d,
            CASE WHEN doc_id IS NOT NULL AND {crc} % 5 = 0 THEN sha256({fields} || {size(low)}) END AS t FROM documents)
    , q0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, d) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM rows)
    , a0 AS (SELECT g, i, d, n FROM q0) {tree('a', levels)}
    , subs AS (SELECT g AS s, d, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM a{levels})
    , b0 AS (SELECT '' AS g, i, d, n FROM subs) {tree('b', over)}
    , met AS (SELECT q.doc_id, q.d AS leaf, o.d AS subroot, coalesce(q.t, q.d) AS f0, {', '.join(f'{a}.l AS l{k}, {a}.r AS r{k}, {a}.n AS n{k}' for k, (a, _) in enumerate(steps))}
        FROM q0 q {' '.join(joins[:levels])} JOIN subs o ON o.s = q.g {' '.join(joins[levels:])})
    {folds}
    SELECT doc_id, leaf, subroot, (SELECT d FROM b{over}) AS root, sha256({sides}) AS proof_sha256, {last} AS folded_root, {last} = (SELECT d FROM b{over}) AS verified FROM {last}
    """
