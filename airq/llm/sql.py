"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from airq.llm.chat_format import Template


def _chat_format() -> str:
    t = Template()

    def text(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def size(column: str) -> str:
        """Characters after escaping: one more for each escape character, two for each control string."""
        held = [f"2 * ((length({column}) - length(replace({column}, {text(c)}, ''))) // {len(c)})" for c in t.controls]
        return f"length({column}) + length({column}) - length(replace({column}, {text(t.escape)}, '')) + " + " + ".join(held)

    last = {state: role for roles in t.moves.values() for role, state in roles.items()}
    legal = [f"(before is not distinct from {text(last[s]) if s in last else 'null'} and role = {text(r)})"
             for s, roles in t.moves.items() for r in roles]
    ends = ", ".join(text(last[e]) for e in t.ends)
    return f"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), placed as (
  select *, lag(role) over w as before, lead(role) over w is null as is_last from rows
  window w as (partition by conv_id order by turn nulls first, role, text)
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum({len(t.turn) + len(t.text) + len(t.end)} + {size('role')} + {size('text')})::bigint as formatted_chars,
  bool_and({' or '.join(legal)}) and bool_or(is_last and role in ({ends})) as valid
from placed group by conv_id
"""


CHAT_FORMAT = _chat_format()

_WORDS = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")

DECONTAMINATE = f"""
with d as (select doc_id, {_WORDS} as w from documents),
i as (select item_id, {_WORDS} as w from benchmark),
needles as (
  select distinct item_id, n, array_to_string(w[b:b + n - 1], ' ') as k
  from (select item_id, w, least(13, len(w)) as n, unnest(range(1, len(w) - least(13, len(w)) + 2)) as b from i where len(w) > 0)
),
hay as (
  select doc_id, n, b, array_to_string(w[b:b + n - 1], ' ') as k
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as b from d, (select distinct n from needles) where len(w) >= n)
),
found as (select doc_id, item_id, b, hay.n from hay join needles on hay.k = needles.k and hay.n = needles.n),
hits as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(b, b + n)) as p from found) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as ids
          from (select distinct doc_id, item_id from found) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join hits using (doc_id) left join items using (doc_id)
"""

_SPACED = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"

SUBSTRING_DEDUP = f"""
with d as (select doc_id, {_SPACED.format("coalesce(text, '')")} as w from documents),
windows as (select doc_id, b, array_to_string(w[b:b + 19], ' ') as k from (select doc_id, w, unnest(range(1, len(w) - 18)) as b from d)),
again as (select doc_id, b from windows qualify row_number() over (partition by k order by doc_id, b) > 1),
gone as (select distinct doc_id, unnest(range(b, b + 20)) as p from again),
placed as (select doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as p from d),
kept as (select doc_id, string_agg(x, ' ' order by p) as t, count(*) as n from placed anti join gone using (doc_id, p) group by doc_id)
select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256
from d left join kept using (doc_id)
"""

NEAR_DEDUP = f"""
with recursive d as (
  select doc_id, {_SPACED.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as w from documents
), sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) = 1 then w
    else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end as s from d
), g as (select doc_id, unnest(s) as x from sets),
inter as (select a.doc_id as u, b.doc_id as v, count(*) as n from g a join g b on a.x = b.x and a.doc_id <> b.doc_id group by all),
links as (
  select u, v from inter join sets a on a.doc_id = u join sets b on b.doc_id = v where 100 * n >= 80 * (len(a.s) + len(b.s) - n)
), reach(doc_id, r) as (
  select doc_id, doc_id from d union select reach.doc_id, v from reach join links on r = u
)
select sets.doc_id, len(s)::bigint as n_shingles, min(r) as component_id, sets.doc_id = min(r) as kept
from sets join reach on sets.doc_id = reach.doc_id group by sets.doc_id, s
"""

WARC = """
with p as (select page_id, coalesce(html, '') as h from pages),
x as (select page_id, octet_length(encode(h)) as n, sha256(h) as s, min(page_id) over (partition by h) as f from p)
select page_id, n::bigint as payload_bytes, s as payload_digest,
  case when n >= 100 and f <> page_id then 'revisit' else 'response' end as record_type,
  case when n >= 100 and f <> page_id then f end as refers_to from x
"""


def mixing(block: int = 16, shard_words: int = 1 << 22, shard_rows: int = 1 << 10, most: int = 3, seed: int = 13, step: int = 1_640_531_513) -> str:
    """Every seat and every word is a row here."""
    return f"""
with sizes as (
  select row_number() over () as r, doc_id, source, len({_SPACED.format("coalesce(text, '')")})::bigint as size,
    ('0x' || substr(md5('{seed}:' || coalesce(doc_id::varchar, 'null')), 1, 15))::bigint as hash from documents
), s as (
  select source, sum(size)::bigint as words, count(*) as n, row_number() over (order by source nulls last) - 1 as sid from sizes group by source
), weighed as (select *, [5, 2, 1][sid % 3 + 1]::bigint as weight, (select sum(words) from s)::bigint as total from s),
run as (
  select *, total - coalesce(sum({most} * words) over (w rows between unbounded preceding and 1 preceding), 0) as rest,
    sum(weight) over (w rows between current row and unbounded following) as open
  from weighed window w as (order by words::hugeint * 60 // weight, sid)
), full_ as (select *, weight::hugeint * rest > {most} * words::hugeint * open as is_full from run),
level as (select max(total) - coalesce(sum({most} * words) filter (is_full), 0) as rest, coalesce(sum(weight) filter (not is_full), 1) as open from full_),
targets as (
  select sid, source, words, n, total, case when is_full then ({most} * words)::double else weight::double * level.rest::double / level.open::double end as target
  from full_, level
), seats as (
  select sid, k, target / (2 * k + 1) as q from (select sid, target, unnest(range(0, (target / {block})::bigint + (select count(*) from s) + 2)) as k from targets)
  where target > 0 qualify row_number() over (order by target / (2 * k + 1) desc, sid, k) <= (select (2 * max(total) + {block}) // {2 * block} from targets)
), blocks as (select sid, count(*) as blocks from seats group by sid),
sources as (
  select targets.*, coalesce(blocks, 0) as blocks, greatest(ceil(words / {shard_words}), ceil(n / {shard_rows}), 1)::bigint as shards
  from targets left join blocks using (sid)
), dealt as (
  select r, doc_id, size, hash, sid, words, target, blocks, hash % shards as shard from sizes join sources on sizes.source is not distinct from sources.source
), lines as (select sid, shard, sum(size)::bigint as line, max(blocks) as blocks from dealt group by sid, shard),
shard_seats as (
  select sid, shard from (select *, unnest(range(0, blocks)) as k from lines where line > 0)
  qualify row_number() over (partition by sid order by line / (2 * k + 1) desc, shard, k) <= blocks
), quotas as (
  select sid, shard, line, least({most} * line, {block} * count(shard_seats.shard)) as quota
  from lines left join shard_seats using (sid, shard) group by sid, shard, line
), placed as (
  select *, sum(size) over (partition by sid, shard order by hash, doc_id nulls first, size, r) - size as b,
    case when line > 0 then quota // line else 0 end as passes, case when line > 0 then quota % line else 0 end as more, line // {block} as whole
  from dealt join quotas using (sid, shard)
), words_ as (
  select r, w % {block} as inside, more - {block} * case when w // {block} < whole then (w // {block} * {step} + {seed}) % whole else whole end as room
  from (select r, more, whole, unnest(range(b::bigint, (b + size)::bigint)) as w from placed where more > 0)
), extra as (select r, count(*) as n from words_ where inside < room group by r)
select doc_id, size, words as source_size, target, (passes * size + coalesce(extra.n, 0))::bigint as taken
from placed left join extra using (r)
"""


MIXING = mixing()

_CRC = ("xor(list_reduce(list_concat([4294967295::bigint], flatten(list_transform(string_split({0}, ''), "
        "lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))), "
        "lambda x, y: case when y >= 0 then xor(x, y) when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end), 4294967295)")

PREFIX_TRIE = f"""
with rows_ as (
  select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 as pos
  from conversations where conv_id is not null
), convs as (select c, c - c % 100 as base, {_CRC.format('c::varchar')} % 6 as h, count(*) as own from rows_ group by c),
sized as (
  select convs.c, convs.base, convs.h, least(convs.h, coalesce(o.own, 0)) as taken, least(convs.h, coalesce(o.own, 0)) + greatest(convs.own - convs.h, 0) as k
  from convs left join convs o on o.c = convs.base
), turns as (
  select sized.c, pos, role, text from sized join rows_ on rows_.c = base where pos < h
  union all select sized.c, pos - h + taken, role, text from sized join rows_ using (c) where pos >= h
), pre as (
  select c, pos + 1 as depth, string_agg(sha256(role || chr(0) || text), '' order by pos) over (partition by c order by pos) as p, length(text) as chars from turns
  union all select c, 0, '', 0 from sized
), named as (select c, depth, chars, min(c) over (partition by depth, p) as node, count(*) over (partition by depth, p) as n from pre),
nodes as (
  select x.node, x.depth, x.n, x.chars, up.node as parent from named x left join named up on up.c = x.c and up.depth = x.depth - 1 where x.c = x.node
), children as (select parent as node, depth - 1 as depth, count(*) as n_children from nodes where parent is not null group by all),
own as (select nodes.*, coalesce(n_children, 0) as n_children from nodes left join children using (node, depth)),
below as (
  select named.node, named.depth, sum((own.n_children = 0)::bigint) as n_leaves, sum((own.n - 1) * own.chars) as saved
  from own join named on named.c = own.node and named.depth <= own.depth group by all
), ends as (
  select node, depth, sha256(string_agg(c::varchar, ',' order by c)) as digest from named join sized using (c) where depth = k group by all
)
select own.node as conv_id, depth::bigint as depth, parent as parent_conv_id, own.n::bigint as n_convs, n_children::bigint as n_children,
  n_leaves::bigint as n_leaves, saved::bigint as saved_tokens, coalesce(digest, sha256('')) as ends_sha256
from own join below using (node, depth) left join ends using (node, depth)
"""
