"""DuckDB SQL for the operators that SQL can express, built from the operators' own parameters."""

from __future__ import annotations

from . import credentials, linededup, outliers

D, FLOORS, CROSS = outliers.D, outliers.FLOORS, outliers.CROSS


def _distance() -> str:
    y: list[str] = []
    for i in range(D):
        inner = "".join(f" - l{i}{j} * {y[j]}" for j in range(i))
        y.append(f"((x{i} - m{i}{inner}) / l{i}{i})")
    return " + ".join(f"{v} * {v}" for v in y)


def _cholesky() -> str:
    out = []
    for i in range(D):
        out.append(f"sqrt(greatest(a{i}{i}{''.join(f' - l{i}{k} * l{i}{k}' for k in range(i))}, {FLOORS[i] ** 2 / 4!r})) as l{i}{i}")
        for j in range(i + 1, D):
            out.append(f"(a{j}{i}{''.join(f' - l{j}{k} * l{i}{k}' for k in range(i))}) / l{i}{i} as l{j}{i}")
    return ", ".join(out)


PARTS = outliers.PARTS


def _moments(keys: str, source: str) -> str:
    sums = ", ".join([f"sum(x{i}) as s{i}" for i in range(D)] + [f"sum(x{i} * x{j}) as c{i}{j}" for i, j in CROSS])
    return f"select {keys}, count(*)::double as n, {sums} from {source}"


def _estimate(name: str, keys: str, factor: float) -> str:
    """From {name}_t to {name}_n."""
    means = ", ".join([f"s{i} / n as m{i}" for i in range(D)] + [f"c{i}{j} / n as q{i}{j}" for i, j in CROSS])
    cov = lambda i, j: f"(q{i}{j} - m{i} * m{j}) * {factor!r}"
    covs = ", ".join(f"greatest({cov(i, j)}, {FLOORS[i] ** 2!r}) as a{i}{j}" if i == j else f"{cov(i, j)} as a{i}{j}" for i, j in CROSS)
    det = " + ".join(f"ln(l{i}{i})" for i in range(D))
    return f"{name}_m as (select {keys}, {means} from {name}_t), {name}_a as (select *, {covs} from {name}_m), {name}_l as (select *, {_cholesky()} from {name}_a), {name}_n as (select {keys}, {', '.join(PARTS[:-1])}, 2 * ({det}) as det from {name}_l)"


def _step(name: str, before: str) -> str:
    o = outliers
    part = ", ".join(f"sum({c} * part) as {c}" for c in o.SUMS)
    falls = f"n.det < o.det - {o.STILL!r}"
    either = ", ".join(f"case when {falls} then n.{c} else o.{c} end as {c}" for c in PARTS)
    return f"""
{name}_d as (select g, s, x0, x1, x2, x3, x4, floor(ln({_distance()} + 1e-6) * 16) as b from told join {before} using (g)),
{name}_c as ({_moments("g, s, b", f"{name}_d")} group by 1, 2, 3),
{name}_k as (select *, coalesce(sum(n) over (partition by g, s order by b rows between unbounded preceding and 1 preceding), 0) as before_, sum(n) over (partition by g, s) as all_ from {name}_c),
{name}_p as (select *, least(1.0, ({o.KEEP!r} * all_ - before_) / n) as part from {name}_k where before_ < {o.KEEP!r} * all_),
{name}_t as (select g, s, {part} from {name}_p group by 1, 2),
{_estimate(name, "g, s", o.consistency(o.KEEP))}, {name} as materialized (select o.g, o.s, {either} from {before} o join {name}_n n on o.g = n.g and o.s = n.s)"""


def outlier_sql() -> str:
    o = outliers
    sql = "".join("," + _step(f"e{k + 1}", f"e{k}") for k in range(o.STEPS))
    quartiles = ", ".join(f"max(case when i = {i} then m end) as m{i}, greatest(max(case when i = {i} then s end), {FLOORS[i]!r}) as l{i}{i}" + "".join(f", 0.0 as l{i}{j}" for j in range(i)) for i in range(D))
    word, plain = r"[^\x20\x09-\x0D]", ", ".join(PARTS[:-1])
    return rf"""with d as (select row_number() over () as rid, doc_id, lang, source, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '{word}+') as ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}')) as ls, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) as n_symbols from d),
win as (select rid, i, array_to_string(ws[i:i + {o.WINDOW - 1}], ' ') as x from (select rid, ws, unnest(range(1, len(ws) - {o.WINDOW - 2})) as i from w)),
rep as (select rid, count(distinct p) as n from (select rid, unnest(range(i, i + {o.WINDOW})) as p from (select rid, i, count(*) over (partition by rid, x) as c from win) where c > 1) group by 1),
stats as (select w.rid, doc_id, lang, source, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars, n_symbols::bigint as n_symbols,
  (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words, len(ls)::bigint as n_lines from w left join rep using (rid)),
keyed as (select *, coalesce('=' || lang, '') as kl, coalesce('=' || source, '') as ks, ln(1 + n_words) as x0, ln(1 + word_chars / greatest(n_words, 1)) as x1, sqrt(n_symbols / greatest(word_chars, 1)) as x2,
  sqrt(n_dup_lines / greatest(n_lines, 1)) as x3, sqrt(n_repeat_words / greatest(n_words, 1)) as x4 from stats),
sizes as (select kl, ks, count(*) as c from keyed group by 1, 2), lefts as (select kl, coalesce(sum(case when c < {o.MIN_GROUP} then c end), 0) as l from sizes group by 1),
names as (select kl, ks, case when c >= {o.MIN_GROUP} then kl || chr(1) || ks when l >= {o.MIN_GROUP} then kl || chr(2) else chr(3) end as g from sizes join lefts using (kl)),
v as materialized (select * from keyed join names using (kl, ks)),
grouped as (select g, doc_id, n_words, x0, x1, x2, x3, x4 from v where g <> chr(3) union all select chr(3), doc_id, n_words, x0, x1, x2, x3, x4 from v),
group_sizes as (select g, count(*) as group_size from grouped group by 1), told as materialized (select * from grouped where n_words > 0),
cells as (select g, i, floor(x * 100) as b, count(*) as c from (select g, unnest([0, 1, 2, 3, 4]) as i, unnest([x0, x1, x2, x3, x4]) as x from told) group by 1, 2, 3),
placed as (select g, i, b, sum(c) over (partition by g, i order by b) as upto, sum(c) over (partition by g, i) as n from cells),
quart as (select g, i, min(case when upto >= 0.5 * n then (b + 0.5) / 100 end) as m, (min(case when upto >= 0.75 * n then (b + 0.5) / 100 end) - min(case when upto >= 0.25 * n then (b + 0.5) / 100 end)) / 1.349 as s from placed group by 1, 2),
q0 as (select g, {quartiles} from quart group by 1),
half_t as ({_moments("g, case when md5(doc_id::varchar)[1:1] < '8' then 1 else 2 end as s", "told")} group by 1, 2), {_estimate("half", "g, s", 1.0)},
e0 as materialized (select g, 0 as s, {plain}, 'inf'::double as det from q0 union all select g, s, {plain}, 'inf'::double from half_n){sql},
best as (select g, {plain} from e{o.STEPS} qualify row_number() over (partition by g order by det, s) = 1),
last_t as ({_moments("g", "(select told.* from told join best using (g) where " + _distance() + f" <= {o.chi_square_quantile(o.REWEIGHT, D)!r})")} group by 1), {_estimate("last", "g", o.consistency(o.REWEIGHT))},
judged as (select v.*, n_words < {o.MIN_WORDS} or 100 * n_repeat_words > {o.MAX_REPEAT_PERCENT} * n_words as base_failed,
  case when group_size >= {o.MIN_GROUP} and n_words > 0 then {_distance()} end as distance from v left join last_n using (g) join group_sizes using (g))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and coalesce(distance <= {o.chi_square_quantile(o.REJECT, D)!r}, true) as kept from judged"""


def line_sql() -> str:
    k, space = linededup, r"[ \t\x0B\f\r]"
    other = r"[^\n \t\x0B\f\r]"
    return rf"""with texts as (select distinct text from documents where text is not null),
split_ as (select text, unnest(string_split(regexp_replace(text, '{other}*[0-9]{other}*', '<*>', 'g'), chr(10))) as x, unnest(range(len(string_split(text, chr(10))))) as line from texts),
toks as (select text, line, string_split_regex(regexp_replace(x, '^{space}+|{space}+$', '', 'g'), '{space}+') as tokens from split_),
lines as (select *, (len(tokens)::varchar || chr(1) || array_to_string(tokens[1:{k.LEADING}], chr(1))) as leaf from toks where len(tokens) >= {k.MIN_TOKENS}),
forms as (select leaf, tokens, count(distinct text) as n from lines group by 1, 2),
spots as (select leaf, tokens, n, unnest(range(len(tokens))) as at_, unnest(tokens) as token from forms),
constants as (select leaf, at_, token from spots group by 1, 2, 3 having sum(n) >= {k.MIN_TEXTS}),
kept as (select leaf, tokens, list(at_::varchar || chr(2) || token order by at_) as kept from spots join constants using (leaf, at_, token) group by 1, 2),
named as (select leaf, tokens, leaf || chr(3) || array_to_string(kept, chr(3)) as template from kept where len(kept) >= {k.SIMILAR} * len(tokens)),
placed as (select text, line, len(tokens) as n, template from lines join named using (leaf, tokens)),
candidates as (select template from placed group by 1 having count(distinct text) >= {k.MIN_TEXTS}),
found as (select * from placed semi join candidates using (template)),
totals as (select text, sum(len(list_filter(tokens, lambda t: t <> ''))) as total from toks group by 1),
held as (select text, {k.COPY_PARTS} * sum(n) > {k.COPY_OF} * any_value(total) as copy, arg_min(template, line) as first_ from found join totals using (text) group by 1),
told as (select distinct template, copy, case when copy then first_ else text end as who from found join held using (text)),
recurring as (select template from told group by 1 having count(*) >= {k.MIN_TEXTS}),
drops as (select text, list(distinct line order by line) as gone, string_split(text, chr(10)) as ls from found join recurring using (template) group by 1)
select doc_id, case when gone is not null then array_to_string(list_transform(list_filter(range(1, len(ls) + 1), lambda i: not list_contains(gone, i - 1)), lambda i: ls[i]), chr(10)) else d.text end as text,
  coalesce(len(string_split(d.text, chr(10))), 0)::bigint as n_lines, coalesce(len(gone), 0)::bigint as n_dropped
from documents d left join drops j on j.text = d.text"""


def secret_sql() -> str:
    c = credentials
    quoted = lambda x: x.replace("'", "''")
    kinds = []
    for rank, (kind, pattern, _) in enumerate(c.BASE + c.WEAK):
        weak = kind.startswith("weak_")
        kinds.append(
            f"select rid, {rank} as rank, '{kind}' as kind, '{c.ROLES[kind]}' as role, {str(weak).lower()} as weak, string_split(regexp_replace(t, '{quoted(pattern)}', chr(1) || '\\0' || chr(2) || '\\1' || chr(3), 'g'), chr(1)) as ps from d"
        )
    tests = " when ".join(f"kind = '{k}' then length(g) >= {n}" for k, _, n in c.BASE)
    mixed = " and ".join(f"regexp_matches(g, '{p}')" for p in c.MIXED)
    said = lambda which: f"coalesce(string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank, stop) filter ({which}), '')"
    return f"""with d as (select row_number() over () as rid, doc_id, regexp_replace(coalesce(text, ''), '[\x01-\x03]', chr(4), 'g') as t from documents),
marked as ({" union all ".join(kinds)}),
pieces as (select rid, rank, kind, role, weak, length(ps[1]) as first_, unnest(ps[2:]) as p, unnest(range(len(ps) - 1)) as i from marked),
measured as (select *, length(split_part(p, chr(2), 1)) as m, split_part(split_part(p, chr(3), 1), chr(2), 2) as g, length(split_part(p, chr(3), 2)) as r from pieces),
placed as (select *, first_ + coalesce(sum(m + r) over (partition by rid, rank order by i rows between unbounded preceding and 1 preceding), 0) as at_ from measured),
parts as (select distinct rid, rank, kind, role, weak, (case when weak then at_ + m - length(g) else at_ end)::bigint as start, (at_ + m)::bigint as stop from placed
  where case when {tests} when kind = 'weak_secret' then {mixed} else true end),
met as (select w.rid, w.rank, w.start, w.stop, w.role, bool_or(o.role = 'id') as has_id, bool_or(o.role = 'secret') as has_secret from parts w join parts o on o.rid = w.rid and o.role <> w.role and o.start - w.stop <= {c.SCOPE} and w.start - o.stop <= {c.SCOPE} where w.weak group by 1, 2, 3, 4, 5),
linked as (select rid, rank, start, stop from met where case when role = 'endpoint' then has_id and has_secret else has_id or has_secret end),
kept as (select p.* from parts p left join linked l using (rid, rank, start, stop) where not p.weak or l.rid is not null)
select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex, sha256({said("kind is not null and not weak")}) as base_sha256, {said("kind is not null")} as spans
from d left join kept using (rid) group by rid, doc_id"""
