"""DuckDB SQL of the operators that SQL can express, in plain forms.

Tokenizers (1, 9) and the classifiers (5, 11) have none; tests hold them against plain versions.
"""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: str) -> str:
    return f"translate({text}, '{UPPER}', '{LOWER}')"


def components(ids: str, edges: str) -> str:
    """CTEs with the least id that each id reaches: ``edges`` (a, b) in both directions."""
    return f"""reach(a, c) as (select id, id from {ids} union select reach.a, e.b from reach join {edges} e on e.a = reach.c),
comp as (select a, min(c) component_id from reach group by a)"""


OP2 = f"""with recursive v as (
  select vec_id id, embedding::double[] x, "label" from embeddings),
good as (
  select * from v where "label" is not null and x is not null and len(x) > 0
    and len(list_filter(x, lambda y: y is null or not isfinite(y))) = 0 and len(list_filter(x, lambda y: y <> 0)) > 0),
e as (
  select g.id a, h.id b from good g join good h on g."label" = h."label" and g.id <> h.id and len(g.x) = len(h.x)
  where list_cosine_similarity(g.x, h.x) >= 0.93),
n as (select a, count(*) n_links from e group by a),
{components('v', 'e')}
select id vec_id, coalesce(n_links, 0) n_links, component_id, id = component_id kept
from v join comp on comp.a = v.id left join n on n.a = v.id"""

OP3 = r"""with d as (
  select doc_id, source, len(regexp_extract_all(coalesce("text", ''), '[^\x20\x09-\x0D]+')) size from documents),
s as (select source, sum(size)::double size, row_number() over (order by source nulls last) k from d group by source),
w as (select *, ([3, 1, 2])[(k - 1) % 3 + 1]::double w from s),
ranked as (select *, row_number() over (order by size / w, k) r from w),
-- with the r - 1 smallest ratios at their limit, the rest shares what is left by weight
tried as (
  select a.r, (1.5 * (select sum(size) from w) - 2 * coalesce((select sum(size) from ranked b where b.r < a.r), 0)) rest,
    (select sum(w) from ranked b where b.r >= a.r) free, 2 * a.size / a.w most
  from ranked a),
cut as (select coalesce(min(r), 1000000000) r, arg_min(rest / free, r) rate from tried where rest / free <= most),
goal as (
  select source, size, case when ranked.r < cut.r then 2 * size else w * rate end target,
    ('0x' || substr(md5('7' || coalesce(':' || source, '')), 1, 13))::bigint / 4503599627370496.0 start
  from ranked, cut),
placed as (
  select d.*, g.size::bigint source_size, target, start, case when g.size > 0 then target / g.size else 0 end expected,
    row_number() over (partition by d.source order by d.size, d.doc_id) rank
  from d join goal g on d.source is not distinct from g.source)
select doc_id, size, source_size, target,
  (size * (floor(start + expected * rank) - floor(start + expected * (rank - 1))))::bigint taken
from placed"""

OP4 = rf"""with words as (
  select doc_id, regexp_extract_all({lowered('coalesce("text", ' + "''" + ')')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
items as (
  select item_id, regexp_extract_all({lowered('coalesce("text", ' + "''" + ')')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark where item_id is not null),
i_at as (select item_id, w, least(len(w), 10) n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) i from items where len(w) > 0),
windows as (select distinct item_id, n, array_to_string(w[i : i + n - 1], ' ') t from i_at),
d_at as (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) i from words, (select distinct n from windows)),
hits as (
  select doc_id, i, d.n, item_id from (select doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') t from d_at) d join windows on windows.t = d.t and windows.n = d.n),
inside as (select distinct doc_id, unnest(range(i, i + n)) i from hits),
n_hit as (select doc_id, count(*) n from inside group by doc_id),
found as (select doc_id, count(*) n, string_agg(item, ',' order by item) s from (select distinct doc_id, item_id::varchar item from hits) group by doc_id)
select words.doc_id, len(w)::bigint n_words, coalesce(n_hit.n, 0) n_hit, coalesce(found.n, 0) n_items,
  sha256(coalesce(s, '')) items_sha256, n_hit.n is not null contaminated
from words left join n_hit on n_hit.doc_id = words.doc_id left join found on found.doc_id = words.doc_id"""

_CONTROL = r"[<\[]\\*(?:s>|/s>|\|endoftext\|>|ROLE\]|TEXT\]|/ROLE\]|INST\]|/INST\]|SYS\]|/SYS\]|OUT\])"
OP6 = rf"""with t as (
  select conv_id, turn, coalesce("role", '') r, coalesce("text", '') x from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized as (
  select *, length(x) + len(regexp_extract_all(x, '{_CONTROL}'))
    + case r when 'user' then 13 when 'system' then 11 when 'assistant' then 9 else 19 + length(r) + len(regexp_extract_all(r, '{_CONTROL}')) end n
  from t),
c as (
  select conv_id, count(*) n_turns, sum(n) + 3 n, string_agg(r || chr(10) || x || chr(10), '' order by turn nulls first, r, x) whole,
    coalesce(string_agg(x, '' order by turn nulls first, r, x) filter (r = 'assistant'), '') loss
  from sized group by conv_id)
select conv_id, n_turns, sha256(whole) turns_sha256, length(loss)::bigint loss_chars, sha256(loss) loss_sha256, n::bigint formatted_chars from c"""

OP7 = rf"""with recursive words as (
  select doc_id, regexp_extract_all({lowered('coalesce("text", ' + "''" + ')')}, '[^\x20\x09-\x0D]+') w from documents),
places as (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) i from words where len(w) > 0),
sh as (select distinct doc_id, array_to_string(w[i : i + 4], ' ') s from places),
n as (select doc_id, count(*) n from sh group by doc_id),
both_in as (select a.doc_id a, b.doc_id b, count(*) i from sh a join sh b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
e as (
  select a, b from both_in join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 85 * (x.n + y.n - i)),
ids as (select doc_id id from documents),
{components('ids', 'e')}
select words.doc_id, coalesce(n.n, 0) n_shingles, component_id, words.doc_id = component_id kept
from words join comp on comp.a = words.doc_id left join n on n.doc_id = words.doc_id"""

OP8 = rf"""with r as (
  select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end rest from pages),
h as (select page_id, rest, regexp_extract(rest, '^[^/?#]*') raw from r),
p as (select page_id, {lowered('raw')} host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') path from h),
rules(h, q, v) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fits as (
  select page_id, arg_max(h || q, length(h || q)) rule, arg_max(v, length(h || q)) v
  from p join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, q) group by page_id)
select p.page_id, host, path, rule, coalesce(v, 'allow') verdict from p left join fits on fits.page_id = p.page_id"""

OP10 = f"""with split as (select doc_id, string_split(coalesce("text", ''), chr(10)) s from documents),
lines as (select doc_id, unnest(range(len(s))) i, unnest(s) line from split),
keyed as (select *, {lowered("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} k from lines),
again as (select k, min(doc_id) first_id from keyed where length(k) >= 10 group by k having count(distinct doc_id) > 1),
marked as (select keyed.*, coalesce(first_id <> doc_id, false) gone from keyed left join again on again.k = keyed.k)
select doc_id, count(*) n_lines, count(*) filter (gone) n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) kept_sha256
from marked group by doc_id"""

_SPACE = r"\x20\x09-\x0D"
_STEPS = ", ".join(["-1"] * 8)


def _crc32(text: str) -> str:
    """crc32 of an ASCII text: per byte an exclusive or and eight shifts."""
    ops = f"flatten(list_transform(string_split({text}, ''), lambda c: [ascii(c)::bigint, {_STEPS}]))"
    step = "lambda s, o: case when o >= 0 then xor(s, o) when s & 1 = 1 then xor(s >> 1, 3988292384) else s >> 1 end"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {ops}), {step}), 4294967295)"


def _edit(way: str, cost: str, initial: str) -> str:
    """A way (nine digits of cost, then initials) with one more edit."""
    return f"(lpad((left({way}, 9)::bigint + {cost})::varchar, 9, '0') || substr({way}, 10) || '{initial}')"


def _op12() -> str:
    stays = lambda states: ", ".join(f"case when ok and i = '{i}' then {_edit(s, 'c', 'K')} end" for s, i in states)
    moves = lambda states: ", ".join(f"case when ok then {_edit(s, '2 + c', 'R')} end" for s in states)
    return rf"""with recursive hashed as (
  select conv_id, turn, coalesce("role", ' ') r, coalesce("text", ' ') x, {_crc32("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 h from conversations),
damaged as (
  select conv_id, turn, case when h = 4 then 'user' else r end r, case h when 1 then '' when 2 then regexp_replace(x, '[.!?]', '', 'g') else x end x,
    unnest(range(case when h = 3 then 2 else 1 end)) k
  from hashed where h <> 0),
numbered as (
  select *, left(r, 1) i, row_number() over (partition by conv_id, r, x order by pos) nth
  from (select *, row_number() over (partition by conv_id order by turn nulls first, r, x, k) pos from damaged)),
faulty as (
  select *, case when not regexp_matches(x, '[^{_SPACE}]') then 1 when nth > 1 then 2 when not regexp_matches(x, '[.!?][{_SPACE}]*$') then 4 else 0 end f,
    lag(i) over (partition by conv_id order by pos) i0
  from numbered),
sums as (
  select conv_id, count(*) n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, count(*) filter (f = 1) blank, count(*) filter (f = 2) duplicate,
    count(*) filter (f = 4) truncated, count(*) filter (pos > 1 and i0 || i not in ('su', 'ua', 'au')) illegal
  from faulty group by conv_id),
ways as (
  select conv_id, 0::bigint pos, '000000000' v0, null::varchar v1, '000000002I' v2, '000000004II' v3 from sums
  union all
  select conv_id, pos, n0, n1, m2, least(n3, {_edit('m2', '2', 'I')}) from (
    select conv_id, pos, n0, n1, n3, least(n2, {_edit('n0', '2', 'I')}, {_edit('n1', '2', 'I')}, {_edit('n3', '2', 'I')}) m2 from (
      select conv_id, pos, {_edit('v0', '3', 'D')} n0, least({_edit('v1', '3', 'D')}, {stays([('v0', 's')])}) n1,
        least({_edit('v2', '3', 'D')}, {stays([('v0', 'u'), ('v1', 'u'), ('v3', 'u')])}, {moves(['v0', 'v1', 'v3'])}) n2,
        least({_edit('v3', '3', 'D')}, {stays([('v2', 'a')])}, {moves(['v2'])}) n3
      from (
        select ways.conv_id, rows.pos, v0, v1, v2, v3, i, f in (0, 4) ok, case when f = 4 then 1 else 0 end c
        from ways join faulty rows on rows.conv_id is not distinct from ways.conv_id and rows.pos = ways.pos + 1)))),
best as (select sums.*, least(v0, v3) way from sums join ways on ways.conv_id is not distinct from sums.conv_id and ways.pos = sums.n),
ops as (select conv_id, unnest(range(length(way) - 9)) + 1 step, substr(way, 10) audit from best where length(way) > 9),
walked as (
  select *, substr(audit, step, 1) op, count(*) filter (substr(audit, step, 1) <> 'I') over w pos, count(*) filter (substr(audit, step, 1) <> 'D') over w e
  from ops window w as (partition by conv_id order by step)),
said as (
  select walked.conv_id, step, e, op, case when op = 'I' then '' else x end x, r,
    max(case when op = 'K' and e = 1 and i = 's' then 1 else 0 end) over (partition by walked.conv_id) led
  from walked left join faulty rows on rows.conv_id is not distinct from walked.conv_id and rows.pos = walked.pos),
repaired as (
  select conv_id, string_agg((case when op = 'K' then r when (e - led) % 2 = 1 then 'user' else 'assistant' end) || ':' || x, chr(10) order by step) t
  from said where op <> 'D' group by conv_id)
select ids.conv_id, coalesce(gaps, 0) gaps, coalesce(blank, 0) blank, coalesce(duplicate, 0) duplicate, coalesce(truncated, 0) truncated,
  coalesce(illegal, 0) illegal, coalesce(left(way, 9)::bigint, 0) "cost", coalesce(substr(way, 10), '') audit, sha256(coalesce(t, '')) repaired_sha256
from (select distinct conv_id from conversations) ids left join best on best.conv_id is not distinct from ids.conv_id
  left join repaired on repaired.conv_id is not distinct from ids.conv_id"""


OP12 = _op12()

OP13 = rf"""with pieces as (
  select coalesce(lang, 'und') lang, regexp_extract_all(unnest(regexp_split_to_array({lowered('coalesce("text", ' + "''" + ')')}, '[.,;:!?
-
]')), '[^ 	]+') w from documents),
totals as (select lang, sum(len(w))::bigint n from pieces group by lang),
grams as (
  select lang, k, array_to_string(w[i : i + k - 1], ' ') phrase, count(*) n
  from (select lang, w, k, unnest(range(1, len(w) - k + 2)) i from pieces, (values (1), (2), (3)) sizes(k)) group by all),
long as (select lang, k, phrase, n a, string_split(phrase, ' ') w from grams where k > 1 and n >= 10),
cuts as (
  select lang, k, phrase, a, w, cut, array_to_string(w[1 : cut], ' ') p, array_to_string(w[cut + 1 :], ' ') q from (select *, unnest(range(1, k)) cut from long)),
scored as (
  select c.*, x.n l, y.n r, ((1000000::hugeint * a * a) // (x.n::hugeint * y.n))::bigint score
  from cuts c join grams x on x.lang = c.lang and x.phrase = c.p and x.k = c.cut join grams y on y.lang = c.lang and y.phrase = c.q and y.k = c.k - c.cut),
lowest as (select *, row_number() over (partition by lang, phrase, k order by score, cut) place from scored),
inside as (
  select lang, array_to_string(w[1 : 2], ' ') phrase, a from long where k = 3 union all select lang, array_to_string(w[2 : 3], ' '), a from long where k = 3),
covered as (select lang, phrase, max(a) most from inside group by lang, phrase),
held as (
  select x.*, row_number() over (partition by x.lang order by score desc, a desc, x.phrase) rank
  from lowest x left join covered c on c.lang = x.lang and c.phrase = x.phrase and x.k = 2
  where place = 1 and (most is null or 100 * most < 50 * a))
select held.lang, rank, phrase, a, l, r, n, score from held join totals on totals.lang = held.lang where rank <= 2000"""

ORACLE: dict[str, str] = {
    "op2_embedding_dedup": OP2, "op3_mixing": OP3, "op4_decontaminate": OP4, "op6_chat": OP6, "op7_minhash": OP7,
    "op8_url_filter": OP8, "op10_line_dedup": OP10, "op12_conversation_repair": OP12, "op13_collocations": OP13,
}
