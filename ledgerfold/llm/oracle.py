"""DuckDB SQL of the registered queries that SQL can express exactly."""

from __future__ import annotations

_WORDS = r"[^\x20\x09-\x0D]+"

# Strings of 50 bytes as 100 hexadecimal digits, cut from short pieces; a run of removed bytes is an island of starts at most 50 apart.
_OP2 = """
with hexed as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
sized as (select doc_id, h, len(h) // 2 as n from hexed),
pieces as (select doc_id, base, substr(h, 2 * base + 1, 2 * (128 + 49)) as piece from sized, unnest(range(0, n - 49, 128)) t(base)),
windows as (select doc_id, base + o as s, substr(piece, 2 * o + 1, 100) as k from pieces, unnest(range(0, len(piece) // 2 - 49)) t(o)),
firsts as (select k, min(doc_id) as first from windows group by k having count(*) > 1),
starts as (select doc_id, s from windows join firsts using (k) where first < doc_id),
marked as (select doc_id, s, case when s <= lag(s) over (partition by doc_id order by s) + 50 then 0 else 1 end as opens from starts),
numbered as (select doc_id, s, sum(opens) over (partition by doc_id order by s) as run from marked),
runs as (select doc_id, run, min(s) as lo, max(s) + 50 as hi from numbered group by doc_id, run),
edges as (select doc_id, lo, hi from runs union all select doc_id, n, n from sized),
gaps as (select doc_id, lo, hi, coalesce(lag(hi) over (partition by doc_id order by lo, hi), 0) as after from edges),
kept as (select doc_id, sum(hi - lo)::bigint as n_removed, (count(*) - 1)::bigint as n_spans, string_agg(substr(h, 2 * after + 1, 2 * (lo - after)), '' order by lo, hi) as rest
         from gaps join sized using (doc_id) group by doc_id)
select doc_id, n::bigint as n_bytes, n_removed, n_spans, sha256(unhex(coalesce(rest, ''))) as kept_sha256 from sized join kept using (doc_id)
"""

# The template's own characters: <|im_start|> is 12, a line break 1, <|im_end|> and a line break 11.
_OP3 = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
sized as (
  select *, replace(replace(role, '%', '%25'), chr(10), '%0A') as name, len(regexp_extract_all(text, '<\\*\|')) as marks from turns)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn nulls first, role, text), '')) as loss_sha256,
  sum(24 + length(name) + len(regexp_extract_all(name, '<\\*\|')) + length(text) + marks)::bigint as formatted_chars
from sized group by conv_id
"""

_OP5 = f"""
with listed as (select doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') as ws from documents),
words as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as p from listed),
pieces as (select doc_id, base, ws[base + 1:base + 64 + 19] as piece from listed, unnest(range(0, len(ws) - 19, 64)) t(base)),
windows as (select doc_id, base + o as s, array_to_string(piece[o:o + 19], ' ') as k from pieces, unnest(range(1, len(piece) - 18)) t(o)),
repeats as (select doc_id, s from windows qualify row_number() over (partition by k order by doc_id, s) > 1),
covered as (select distinct doc_id, s + o as p from repeats, range(20) t(o)),
kept as (select doc_id, count(*) as n, string_agg(word, ' ' order by p) as rest from words anti join covered using (doc_id, p) group by doc_id)
select doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(rest, '')) as kept_sha256
from listed left join kept using (doc_id)
"""

# Two sets this alike share one of the rarest shingles of each: those beyond its first 85 %, in one order over all.
_OP10 = f"""
with listed as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') as ws from documents),
shingles as (
  select distinct doc_id, array_to_string(piece[o:o + 2], ' ') as g
  from (select doc_id, ws[base + 1:base + 64 + 2] as piece from listed, unnest(range(0, greatest(len(ws) - 2, 1), 64)) t(base) where len(ws) > 0), unnest(range(1, greatest(len(piece) - 1, 2))) t(o)),
numbered as (select g, row_number() over (order by count(*), g) as id from shingles group by g),
members as (select doc_id, id, count(*) over (partition by doc_id) as n, row_number() over (partition by doc_id order by id) as place from shingles join numbered using (g)),
rare as (select * from members where place <= n - (85 * n + 99) // 100 + 1),
pairs as (select distinct a.doc_id as x, b.doc_id as y from rare a join rare b on a.id = b.id and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)),
shared as (select x, y, any_value(a.n) + any_value(b.n) as total, count(*) as common from pairs join members a on a.doc_id = x join members b on b.doc_id = y and b.id = a.id group by x, y),
links as (select x, y from shared where 100 * common >= 85 * (total - common)),
ways as (select x, y from links union all select y, x from links),
reached as (with recursive r(doc_id, root) as (select doc_id, doc_id from listed union select y, root from r join ways on x = doc_id where root < y) select doc_id, min(root) as root from r group by doc_id),
sizes as (select doc_id, count(*) as n from shingles group by doc_id)
select doc_id, coalesce(n, 0)::bigint as n_shingles, root::bigint as component_id, doc_id = root as kept from reached left join sizes using (doc_id)
"""

_OP12 = _OP10.replace("85", "90").replace(" as component_id, doc_id = root as kept", " as component_id")

_OP11 = """
with whole as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.vec_id as anchor_id, a.label as own, c.vec_id, c.label, list_inner_product(a.v, c.v)::bigint as score
  from whole a join whole c on a.vec_id % 100 = 0 and len(a.v) = len(c.v) and a.vec_id <> c.vec_id),
near as (select anchor_id, vec_id as positive_id, score as positive_score from scored where own = label qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
ranked as (
  select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as rank, vec_id as negative_id, positive_score, score as negative_score
  from near join scored using (anchor_id) where own <> label and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from ranked where rank <= 5
"""

# A run has equal strings of 16 words one period apart at every place but its last ones: of 24 words with a period to 8, and of two periods of more. Islands of such pairs are the runs.
_OP13 = f"""
with bytes as (select doc_id, unnest(range(1, len(doc_id::varchar) + 1)) as pos, ascii(substr(doc_id::varchar, pos::int, 1)) as b from documents),
codes as (
  select doc_id, xor(list_reduce(list_prepend(4294967295::bigint, list(b::bigint order by pos)), lambda acc, x: list_reduce(list_prepend(xor(acc, x), range(8)), lambda c, i: xor(c >> 1, (c & 1) * 3988292384::bigint))), 4294967295::bigint) as h
  from bytes group by doc_id),
listed as (select doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') as ws, len(ws)::bigint as n, coalesce(h, 1) as h, coalesce(h, 1) // 10 as g from documents left join codes using (doc_id)),
planted as (select doc_id, ws, n, h, g, case when h % 10 = 0 and n > 0 then g % n end as a from listed),
sized as (select *, 1 + (n - a) // (3 + g % 8) as p from planted),
texts as (select doc_id, n, case when a is null then ws else list_transform(range(n), lambda i: ws[(case when i < a then i else a + (i - a) % p end) + 1]) end as ws from sized),
pieces as (select doc_id, base, ws[base + 1:base + 64 + 15] as piece from texts, unnest(range(0, n - 15, 64)) t(base)),
windows as (select doc_id, base + o - 1 as i, md5_number(array_to_string(piece[o:o + 15], ' ')) as k from pieces, unnest(range(1, len(piece) - 14)) t(o)),
pairs as (select x.doc_id, x.i, y.i - x.i as q from windows x join windows y on x.doc_id = y.doc_id and x.k = y.k and x.i < y.i),
islands as (select doc_id, q, i, i - row_number() over (partition by doc_id, q order by i) as island from pairs),
stretches as (select doc_id, q, min(i) as s, max(i) - min(i) + 16 + q as n from islands group by doc_id, q, island),
runs as (select doc_id, s, n, min(q) as q from stretches where n >= greatest(24, 3 * q) group by doc_id, s, n),
best as (select doc_id, s, n, q from runs qualify row_number() over (partition by doc_id order by n::hugeint * 1000000000000 // q desc, s, q) = 1),
lines as (select doc_id, count(*) as n_runs, string_agg(s || ',' || n || ',' || q || chr(10), '' order by s, q) as said from runs group by doc_id),
gone as (select distinct doc_id, unnest(range(s + q, s + n)) as pos from runs),
words as (select doc_id, unnest(ws) as word, unnest(range(n)) as pos from texts),
kept as (select doc_id, string_agg(word, ' ' order by pos) as rest from words anti join gone using (doc_id, pos) group by doc_id)
select doc_id, coalesce(n_runs, 0)::bigint as n_runs, s::bigint as start, best.n::bigint as length, q::bigint as period, (1000 * best.n // q)::bigint as exponent_milli,
  sha256(coalesce(said, '')) as runs_sha256, sha256(coalesce(rest, '')) as collapsed_sha256
from texts left join best using (doc_id) left join lines using (doc_id) left join kept using (doc_id)
"""

ORACLE_SQL: dict[str, str] = {"op2_suffix_dedup": _OP2, "op3_chat_format": _OP3, "op5_substring_dedup": _OP5, "op10_minhash_near_dedup": _OP10, "op11_hard_negatives": _OP11, "op12_ngram_jaccard_join": _OP12, "op13_periodic_runs": _OP13}
