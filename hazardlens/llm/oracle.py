"""SQL counterparts, for an independent engine, of the corpus queries that SQL can express."""

from __future__ import annotations

from hazardlens.llm import urlfilter
from hazardlens.llm.neardup import SHINGLE, SIMILARITY
from hazardlens.llm.secrets import BASE_RULES, RULES, Rule

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def near_duplicates() -> str:
    """All pairs with a common shingle; components by reachability."""
    last = SHINGLE - 1
    return f"""
with recursive texts as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') w
  from documents),
shingles as (
  select distinct doc_id, array_to_string(w[i:i + {last}], ' ') s
  from texts, unnest(generate_series(1, greatest(len(w) - {last}, least(len(w), 1)))) t(i)),
sizes as (select doc_id, count(*) n from shingles group by doc_id),
pairs as (
  select a.doc_id x, b.doc_id y, count(*) c from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id
  group by all),
links as (
  select x, y from pairs join sizes p on p.doc_id = x join sizes q on q.doc_id = y
  where 100 * c >= {SIMILARITY} * (p.n + q.n - c)),
edges as (select x, y from links union all select y, x from links),
reach(doc_id, r) as (
  select doc_id, doc_id from texts union select y, r from reach join edges on reach.doc_id = x),
components as (select doc_id, min(r) component_id from reach group by doc_id)
select t.doc_id, coalesce(n, 0) n_shingles, component_id, t.doc_id = component_id kept
from texts t join components using (doc_id) left join sizes using (doc_id)"""


def _matches(number: int, rule: Rule) -> str:
    """Spans of a rule: the pieces between matches and the matches give the places."""
    pattern = rule.pattern.replace("'", "''")
    return f"""
select doc_id, {number} number, '{rule.kind}' kind, start, start + length(m[i]) stop
from (select doc_id, m, g, i,
    list_sum(list_transform(b[1:i], lambda x: length(x))) +
    coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) start
  from (select doc_id, string_split_regex(t, '{pattern}') b, regexp_extract_all(t, '{pattern}', 0) m,
      regexp_extract_all(t, '{pattern}', {rule.group}) g from d where regexp_matches(t, '{pattern}')) x,
    unnest(generate_series(1, len(m))) u(i))
where length(g[i]) >= {rule.least}"""


def secrets() -> str:
    spans = " union all ".join(_matches(i, r) for i, r in enumerate(RULES))
    counts = ", ".join(f"count(case when number = {i} then 1 end) n_{r.kind}" for i, r in enumerate(BASE_RULES))
    text = "kind || ':' || cast(start as bigint) || ':' || cast(stop as bigint)"
    base = f"number < {len(BASE_RULES)}"
    return f"""
with d as (select doc_id, coalesce(text, '') t from documents),
spans as ({spans})
select d.doc_id, {counts},
  sha256(coalesce(string_agg(case when {base} then {text} end, ',' order by start, number), '')) base_sha256,
  coalesce(string_agg({text}, ',' order by start, number), '') spans
from d left join spans using (doc_id) group by d.doc_id"""


def structure_repair() -> str:
    """Damage, faults, a recursion from each conversation's end over costs and audits by grammar
    state (0 start, 1 after s, 2 after u, 3 after a), and the repaired text read off the audit."""
    spaces = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    into = {0: 2, 1: 2, 2: 3, 3: 2}
    keeps = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    value = lambda cost, audit: f"{{'c': {cost}, 'a': {audit}}}"

    def edited(state: int) -> str:
        options = [value(f"v{state}.c + 4", f"'D' || v{state}.a")]
        more = "case when fault = 'truncated' then 3 else 0 end"
        gone = "fault in ('blank', 'duplicate')"
        end = into[state]
        options.append(value(f"case when {gone} then 1000000000 else v{end}.c + 3 + {more} end", f"'R' || v{end}.a"))
        for initial, end in keeps[state].items():
            kept = f"case when {gone} or initial <> '{initial}' then 1000000000 else v{end}.c + {more} end"
            options.append(value(kept, f"'K' || v{end}.a"))
        return f"list_min([{', '.join(options)}]) e{state}"

    def inserted(prefix: str, state: int) -> str:
        one, two = into[state], into[into[state]]
        options = [f"{prefix}{state}", value(f"{prefix}{one}.c + 3", f"'I' || {prefix}{one}.a"),
                   value(f"{prefix}{two}.c + 6", f"'II' || {prefix}{two}.a")]
        return f"list_min([{', '.join(options)}]) v{state}"

    ended = ", ".join(
        value(cost, audit) + f" v{state}" for state, (cost, audit) in enumerate([(0, "''"), (6, "'II'"), (3, "'I'"), (0, "''")])
    )
    return f"""
with recursive given as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations),
sums as (
  select *, xor(list_reduce(
    list_concat([4294967295::bigint], list_transform(string_split(key, ''), lambda x: ord(x)::bigint)),
    lambda crc, x: list_reduce(list_concat([xor(crc, x)], [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]),
      lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295) % 20 as kind from given),
damaged as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role,
    case when kind = 1 then '' when kind = 2 then translate(text, '.!?', '') else text end as text
  from sums, unnest(case when kind = 0 then [] when kind = 3 then [1, 2] else [1] end) t(i)),
numbered as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as pos,
    left(role, 1) as initial, trim(text, {spaces}) as visible from damaged),
rows_ as (
  select *, case when visible = '' then 'blank'
      when row_number() over (partition by conv_id, role, text order by pos) > 1 then 'duplicate'
      when right(visible, 1) not in ('.', '!', '?') then 'truncated' end as fault,
    lag(initial) over (partition by conv_id order by pos) || initial as pair from numbered),
counts as (
  select conv_id, max(pos) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps,
    count(case when fault = 'blank' then 1 end) as blank, count(case when fault = 'duplicate' then 1 end) as duplicate,
    count(case when fault = 'truncated' then 1 end) as truncated,
    count(case when pair not in ('su', 'ua', 'au') then 1 end) as illegal from rows_ group by conv_id),
walk(conv_id, pos, v0, v1, v2, v3) as (
  select conv_id, n::bigint, {ended} from counts
  union all
  select conv_id, pos, {", ".join(inserted("e", s) for s in range(4))} from (
    select w.conv_id, w.pos - 1 as pos, {", ".join(edited(s) for s in range(4))}
    from walk w join rows_ r on w.conv_id is not distinct from r.conv_id and w.pos = r.pos)),
audits as (select conv_id, v0.c::bigint as cost, v0.a as audit from walk where pos = 0),
letters as (
  select conv_id, i, string_split(audit, '')[i] as edit from audits, unnest(generate_series(1, length(audit))) t(i)),
placed as (
  select conv_id, i, edit, count(case when edit <> 'I' then 1 end) over w as pos,
    count(case when edit <> 'D' then 1 end) over w as place
  from letters window w as (partition by conv_id order by i rows unbounded preceding)),
told as (
  select p.*, r.role, r.text, max(case when place = 1 and edit = 'K' and initial = 's' then 1 else 0 end)
    over (partition by p.conv_id) as system
  from placed p left join rows_ r on p.conv_id is not distinct from r.conv_id and p.pos = r.pos and edit <> 'I'),
digests as (
  select conv_id, sha256(string_agg(case when edit = 'K' then role when (place - system) % 2 = 1 then 'user'
      else 'assistant' end || ':' || coalesce(text, ''), chr(10) order by i)) as digest
  from told where edit <> 'D' group by conv_id)
select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
  coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(cost, 0) as cost,
  coalesce(audit, '') as audit, coalesce(digest, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) o
left join counts c on o.conv_id is not distinct from c.conv_id
left join audits a on o.conv_id is not distinct from a.conv_id
left join digests d on o.conv_id is not distinct from d.conv_id"""


def _whole_vectors(scale: int, more: str = "", condition: str = "true") -> str:
    return f"""proper as (
  select vec_id, list_transform(embedding::double[], lambda x: floor({scale}::double * x)) as v, row_number() over () as i{more}
  from embeddings where vec_id is not null and embedding is not null and {condition}
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
vectors as (select * from proper where len(v) = (select mode(len(v)) from proper))"""


def knn_join() -> str:
    return f"""
with {_whole_vectors(1024)},
scored as (
  select q.i, q.vec_id as query_id, d.vec_id, list_inner_product(q.v, d.v)::bigint as score
  from vectors q join vectors d on q.i <> d.i where q.vec_id % 100 = 0),
ranked as (select *, row_number() over (partition by i order by score desc, vec_id)::int as rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= 10"""


def hard_negatives() -> str:
    label = ", case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label"
    return f"""
with {_whole_vectors(256, label, "label is not null")},
scored as (
  select a.i, a.vec_id as anchor_id, d.i as j, d.vec_id, a.label = d.label as alike,
    list_inner_product(a.v, d.v)::bigint as score
  from vectors a join vectors d on a.i <> d.i where a.vec_id % 100 = 0),
positives as (
  select *, row_number() over (partition by i order by score desc, vec_id) as place from scored where alike),
negatives as (
  select p.i, p.place, p.anchor_id, p.vec_id as positive_id, p.score as positive_score,
    n.vec_id as negative_id, n.score as negative_score,
    row_number() over (partition by p.i, p.place order by n.score desc, n.vec_id)::int as rank
  from positives p join scored n on p.i = n.i and not n.alike
  where place <= 5 and 30 * p.score <= 100 * n.score and 100 * n.score <= 90 * p.score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from negatives where rank <= 10"""


ORACLE_SQL = {
    "op2_url_filter": urlfilter.oracle_sql(),
    "op4_near_duplicates": near_duplicates(),
    "op9_secret_scan": secrets(),
    "op11_structure_repair": structure_repair(),
    "op12_knn_join": knn_join(),
    "op13_hard_negatives": hard_negatives(),
}
