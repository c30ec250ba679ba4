"""SQL twins (DuckDB) of the numbered queries that SQL can state."""

WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

OP3 = """
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0
), l as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98
), reach as (
  select vec_id as a, vec_id as b from v
  union
  select r.a, l.b from reach r join l on r.b = l.a
), least as (select a, min(b) as component_id from reach group by a),
n as (select a, count(*) as n_links from l group by a)
select e.vec_id, coalesce(n.n_links, 0) as n_links, coalesce(least.component_id, e.vec_id) as component_id,
  e.vec_id = coalesce(least.component_id, e.vec_id) as kept
from embeddings e left join least on e.vec_id = least.a left join n on e.vec_id = n.a
"""

OP4 = f"""
with d as (select doc_id, {WORDS} as w from documents),
k as (select doc_id, s, array_to_string(w[s:s + 19], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 18)) as s from d where len(w) >= 20)),
later as (select doc_id, s from (select doc_id, s, row_number() over (partition by g order by doc_id, s) as pos from k) where pos > 1),
gone as (select distinct doc_id, s + o.range as i from later, range(20) o),
kept as (
  select t.doc_id, string_agg(t.word, ' ' order by t.i) as text, count(*) as n
  from (select doc_id, unnest(range(1, len(w) + 1)) as i, unnest(w) as word from d) t
  left join gone g on t.doc_id = g.doc_id and t.i = g.i where g.i is null group by t.doc_id
)
select d.doc_id, len(w) as n_words, len(w) - coalesce(kept.n, 0) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
from d left join kept on d.doc_id = kept.doc_id
"""

_FIVE = ", ".join(f"('0x' || substr(h, {1 + 5 * g}, 5))::bigint" for g in range(8))
OP5 = f"""
with p as (select page_id, coalesce(html, '') as payload, sha1(coalesce(html, '')) as h from pages),
f as (select payload, min(page_id) as first from p group by payload)
select page_id, strlen(p.payload) as payload_bytes,
  array_to_string(list_transform(flatten(list_transform([{_FIVE}], lambda g: [g >> 15, (g >> 10) & 31, (g >> 5) & 31, g & 31])),
    lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (i + 1)::int, 1)), '') as payload_digest,
  case when page_id is not distinct from first then 'response' else 'revisit' end as record_type,
  case when page_id is distinct from first then first end as refers_to
from p join f on p.payload = f.payload
"""

_SPACE = "[\\x20\\x09-\\x0D]+"
_CLASSES = ["[a-z]+", _SPACE, "[A-Z]+", "[.,;:!?''\"()\\-]+", "[0-9]+", "[^\\x00-\\x7F]+"]
_STEPS = ", ".join(
    f"c{i + 1} as (select *, regexp_replace(r{i}, '{pattern}', '', 'g') as r{i + 1} from c{i})" for i, pattern in enumerate(_CLASSES)
)
_COUNTS = ", ".join([*(f"length(r{i}) - length(r{i + 1})" for i in range(6)), "length(r6)"])


def _distance(p: str, q: str) -> str:
    """Jensen-Shannon distance of two lists of counts."""
    own = f"list_transform({p}, lambda v: v / list_sum({p})::double)"
    other = f"list_transform({q}, lambda v: v / list_sum({q})::double)"
    part = "case when z[{0}] > 0 then z[{0}] * log2(2 * z[{0}] / (z[1] + z[2])) else 0 end"
    term = f"{part.format(1)} + {part.format(2)}"
    return f"sqrt(greatest(list_sum(list_transform(list_zip({own}, {other}), lambda z: {term})) / 2, 0))"


def op6(max_class: float, max_word: float, class_chars: int, histogram_words: int, common: int) -> str:
    return f"""
with d as (select doc_id, coalesce(lang, '') as lang, coalesce(text, '') as text, {WORDS} as w from documents),
c0 as (select doc_id, lang, text as r0 from d), {_STEPS},
classes as (select doc_id, lang, [{_COUNTS}] as c from c6),
class_ref as (select lang, [{", ".join(f"sum(c[{i}])" for i in range(1, 8))}] as q from classes group by lang),
bag as (select doc_id, lang, lower(unnest(w)) as word from d),
lang_words as (select lang, word, count(*) as n, row_number() over (partition by lang order by count(*) desc, word) as pos from bag group by lang, word),
word_ref as (
  select lang, list_append(list(n order by pos) filter (pos <= {common}), (sum(n) - sum(n) filter (pos <= {common}))) as q,
    list(word order by pos) filter (pos <= {common}) as common
  from lang_words group by lang
),
counted as (select b.doc_id, l.pos, count(*) as n from bag b join lang_words l on b.lang = l.lang and b.word = l.word and l.pos <= {common} group by b.doc_id, l.pos),
bins as (
  select x.doc_id, list_append(list(coalesce(counted.n, 0) order by x.pos), x.n - sum(coalesce(counted.n, 0))) as c
  from (select d.doc_id, len(d.w) as n, unnest(range(1, len(r.common) + 1)) as pos from d join word_ref r on d.lang = r.lang) x
  left join counted on x.doc_id = counted.doc_id and x.pos = counted.pos group by x.doc_id, x.n
),
win as (select doc_id, i, w[i:i + 2] as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d where len(w) >= 3)),
again as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as n from win) where n > 1),
covered as (select doc_id, count(distinct i + o.range) as n from again, range(3) o group by doc_id),
lines as (
  select doc_id, count(*) - count(distinct line) as n
  from (select doc_id, unnest(string_split(text, chr(10))) as line from d) where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by doc_id
),
base as (
  select d.doc_id, d.lang, len(w)::bigint as n_words, length(regexp_replace(text, '{_SPACE}', '', 'g')) as word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols, coalesce(lines.n, 0) as n_dup_lines,
    coalesce(covered.n, 0) as n_repeat_words
  from d left join lines on d.doc_id = lines.doc_id left join covered on d.doc_id = covered.doc_id
),
far as (
  select b.*, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
    case when list_sum(k.c) >= {class_chars} then {_distance('k.c', 'kr.q')} end as class_distance,
    case when n_words >= {histogram_words} then {_distance('bins.c', 'wr.q')} end as word_distance
  from base b join classes k on b.doc_id = k.doc_id left join class_ref kr on b.lang = kr.lang
  left join bins on b.doc_id = bins.doc_id left join word_ref wr on b.lang = wr.lang
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not coalesce(class_distance > {max_class}, false) and not coalesce(word_distance > {max_word}, false) as kept
from far
"""


_OVER = "least(before / target, 1.0)"


def _time(rate: float, end: float) -> str:
    root = f"sqrt(greatest({rate * rate} + {_OVER} * ({2 * (end - rate)}), 0.0))"
    return f"least(case when {root} + {rate} = 0 then 0.0 else {_OVER} * 2 / ({root} + {rate}) end, 1.0)"


OP7 = f"""
with s as (
  select doc_id, source, len({WORDS})::bigint as size, ('0x' || substr(md5('mix|' || coalesce(doc_id::varchar, '')), 1, 15))::bigint as k from documents
),
src as (
  select source, sum(size)::bigint as source_size, (row_number() over (order by source nulls last) - 1) % 3 as turn from s group by source
),
m as (select *, ([5.0, 2.0, 1.0][turn + 1])::double as weight, source_size * 3.0::double as most from src),
o as (select *, row_number() over (order by most / weight, source nulls last) as pos from m),
lv as (
  select *, ((sum(source_size) over ())::double - coalesce(sum(most) over (order by pos rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by pos rows between current row and unbounded following) as lvl from o
),
t as (select source, turn, source_size, least(most, (select min_by(lvl, pos) from lv where lvl * weight <= most) * weight) as target from lv),
b as (
  select s.doc_id, s.size, t.*, coalesce(sum(s.size) over (partition by s.source order by k, s.doc_id, s.size rows between unbounded preceding and 1 preceding), 0)::bigint as before
  from s join t on s.source is not distinct from t.source
),
e as (select *, [least(size, greatest(floor(target)::bigint - before - source_size * i, 0)) for i in [0, 1, 2]] as takes from b)
select doc_id, size, source_size, target, list_sum(takes)::bigint as taken,
  case when takes[1] > 0 then round(case turn when 0 then {_time(1.5, 0.5)} when 1 then {_time(1.0, 1.0)} else {_time(0.5, 1.5)} end, 6) end as first_time
from e
"""

OP10 = """
with t as (
  select conv_id // 2 as pair_id, conv_id % 2 as side, conv_id, row_number() over (partition by conv_id order by turn, role, text) as pos,
    coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null
),
h as (select *, '<|' || role || '|>' || chr(10) as head, text || '<|end|>' || chr(10) as body from t),
place as (
  select pair_id, pos, count(*) = 2 and min(role) = max(role) and min(text) = max(text) as shared from t group by pair_id, pos
),
cut as (select pair_id, coalesce(min(pos) filter (not shared) - 1, max(pos)) as prefix_turns from place group by pair_id),
part as (
  select h.*, prefix_turns, pos <= prefix_turns as common,
    coalesce(sum(length(head || body)) over (partition by h.pair_id, side, pos <= prefix_turns order by pos rows between unbounded preceding and 1 preceding), 0) + length(head) as start
  from h join cut on h.pair_id = cut.pair_id
),
ids as (
  select pair_id, max(conv_id) filter (side = 0) as chosen_id, max(conv_id) filter (side = 1) as rejected_id, min(prefix_turns) as prefix_turns,
    coalesce(string_agg(head || body, '' order by pos) filter (common and side = 0), '') as prompt,
    string_agg(head || body, '' order by pos) filter (not common and side = 0) as chosen,
    string_agg(head || body, '' order by pos) filter (not common and side = 1) as rejected,
    string_agg((start::bigint)::varchar || ':' || length(body)::varchar, ',' order by pos) filter (not common and side = 0 and role = 'assistant') as chosen_mask,
    string_agg((start::bigint)::varchar || ':' || length(body)::varchar, ',' order by pos) filter (not common and side = 1 and role = 'assistant') as rejected_mask
  from part group by pair_id
)
select pair_id, chosen_id, rejected_id, prefix_turns, prompt,
  case when chosen_id is not null then coalesce(chosen, '') end as chosen, case when rejected_id is not null then coalesce(rejected, '') end as rejected,
  case when chosen_id is not null then coalesce(chosen_mask, '') end as chosen_mask, case when rejected_id is not null then coalesce(rejected_mask, '') end as rejected_mask,
  case when chosen_id is null then 'no_chosen' when rejected_id is null then 'no_rejected' when chosen is null and rejected is null then 'equal' else 'pair' end as status
from ids
"""


_CRC_STEPS = "case when x >= 0 then xor(a, x) when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end"
_CRC_LIST = "flatten(list_transform(string_split(coalesce(doc_id::varchar, ''), ''), lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))"
CRC32 = f"xor(list_reduce(list_prepend(4294967295, {_CRC_LIST}), lambda a, x: {_CRC_STEPS}), 4294967295)"

OP11 = f"""
with o as (select doc_id, {WORDS} as w, {CRC32} as h from documents),
g as (select *, len(w) as n, (h // 10) as g from o),
s as (select *, case when n > 0 then g % n else 0 end as a from g),
d as (
  select doc_id, n, case when h % 10 = 0 and n > 0
    then list_transform(range(n), lambda i: w[1 + case when i >= a then a + (i - a) % (1 + (n - a) // (3 + g % 8)) else i end]) else w end as w
  from s
),
t as (select doc_id, n, unnest(range(n)) as i, unnest(w) as word from d),
apart as (select x.doc_id, x.i, y.i - x.i as q from t x join t y on x.doc_id = y.doc_id and x.word = y.word and y.i > x.i and 4 * (y.i - x.i) <= x.n),
islands as (select *, i - row_number() over (partition by doc_id, q order by i) as island from apart),
stretches as (
  select doc_id, q, min(i) as start, count(*) + q as length from islands group by doc_id, q, island having count(*) + q >= greatest(6, 4 * q)
),
runs as (select doc_id, start, length, min(q) as period from stretches group by doc_id, start, length),
total as (
  select doc_id, count(*) as n_runs, max({{'length': length, 'start': -start, 'period': -period}}) as best,
    string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as lines
  from runs group by doc_id
),
dropped as (select distinct doc_id, unnest(range(start + period, start + length)) as i from runs),
kept as (
  select t.doc_id, string_agg(t.word, ' ' order by t.i) as text from t left join dropped x on t.doc_id = x.doc_id and t.i = x.i where x.i is null group by t.doc_id
)
select d.doc_id, coalesce(n_runs, 0) as n_runs, -best.start as start, best.length as length, -best.period as period,
  (1000 * best.length) // -best.period as exponent_milli, sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(kept.text, '')) as collapsed_sha256
from d left join total on d.doc_id = total.doc_id left join kept on d.doc_id = kept.doc_id
"""


def _draw(i: int) -> str:
    return f"('0x' || substr(h, {1 + 8 * i}, 8))::bigint"


_PIECES = {"psm": "'<P>' || prefix || '<S>' || suffix || '<M>' || middle", "spm": "'<S>' || suffix || '<P>' || prefix || '<M>' || middle"}
OP12 = f"""
with u as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') as units, sha256('7:' || coalesce(doc_id::varchar, '')) as h
  from documents
),
c as (
  select *, len(units) as n, least({_draw(0)} % (len(units) + 1), {_draw(1)} % (len(units) + 1)) as a, greatest({_draw(0)} % (len(units) + 1), {_draw(1)} % (len(units) + 1)) as b,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or {_draw(2)} % 100 >= 100 then 'plain'
      when {_draw(3)} % 100 < 50 then 'spm' else 'psm' end as form
  from u
),
p as (
  select *, array_to_string(units[1:a], '') as prefix, array_to_string(units[a + 1:b], '') as middle, array_to_string(units[b + 1:], '') as suffix from c
)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
  sha256(case form when 'psm' then {_PIECES["psm"]} when 'spm' then {_PIECES["spm"]} else text end) as output_sha256, sha256(text) as restored_sha256
from p
"""

_FOLDED = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP13 = f"""
with d as (select doc_id, {_FOLDED} as w from documents),
b as (select item_id, {_FOLDED} as w from benchmark),
win as (
  select distinct item_id, len(g) as n, array_to_string(g, ' ') as phrase
  from (select item_id, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: w[i:i + 9])) as g from b where len(w) > 0)
),
p as (
  select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as phrase
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from win) where len(w) >= n)
),
m as (select p.doc_id, p.i, p.n, win.item_id from p join win on p.n = win.n and p.phrase = win.phrase),
hit as (select doc_id, count(distinct i + o) as n_hit from (select doc_id, i, unnest(range(n)) as o from (select distinct doc_id, i, n from m)) group by doc_id),
held as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct doc_id, item_id::varchar as item from m where item_id is not null) group by doc_id
)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit on d.doc_id = hit.doc_id left join held on d.doc_id = held.doc_id
"""
