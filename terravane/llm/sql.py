"""DuckDB SQL of the queries that SQL can express."""

from . import rules

WORDS = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)"


def id_hash(seed: str, *cols: str) -> str:
    parts = ", ".join(f"coalesce(cast({c} as varchar), chr(0))" for c in cols)
    return f"cast('0x' || substr(md5(concat_ws(':', '{seed}', {parts})), 1, 15) as bigint)"


def _sainte_lague(name: str, source: str, group: str, order: str, weight: str, seats: str, out: str) -> str:
    every = f"over (partition by {group})" if group else "over ()"
    within = f"partition by {group} " if group else ""
    same = f"g.{group} is not distinct from r.{group} and " if group else ""
    return f"""
{name}_n as (select *, sum(case when {weight} > 0 then 1.0::double else 0 end) {every} as n_, sum({weight}) {every} as w_ from {source}),
{name}_i as (select *, case when {seats} > 0 and {weight} > 0 then {weight} * {seats} / w_ else 0 end as i_ from {name}_n),
{name}_k as (select *, case when i_ > 0 then greatest(0, ceil(i_ * (1 - n_ / (2.0::double * {seats})) - 0.5::double) - 1) else 0 end::bigint as sure_,
  case when i_ > 0 then floor(i_ * (1 + n_ / (2.0::double * {seats})) + 0.5::double) + 1 else 0 end::bigint as top_ from {name}_i),
{name}_f as (select *, {seats} - sum(sure_) {every} as free_ from {name}_k),
{name}_e as (select *, unnest(range(sure_, top_)) as k_ from {name}_f),
{name}_r as (select *, row_number() over ({within}order by {weight} / (2.0::double * k_ + 1.0::double) desc, {order}) as place_ from {name}_e),
{name} as (select g.*, sure_ + (select count(*) from {name}_r r where {same}r.{order.split()[0]} is not distinct from g.{order.split()[0]} and place_ <= r.free_) as {out} from {name}_f g)"""


def mixing(block: int = 256, words: int = 131072, most: int = 65536) -> str:
    """The mix with blocks of up to ``block`` words and shards of about ``words``."""
    return f"""
with sized as (select doc_id, source, {WORDS}::bigint as size, {id_hash('mix', 'doc_id')} as key from documents),
s0 as (select source, sum(size)::bigint as source_size from sized group by source),
s1 as (select *, [3.0::double, 1.0::double, 2.0::double][(row_number() over (order by source asc nulls last) - 1) % 3 + 1] as weight, 2.0::double * source_size as cap from s0),
s2 as (select *, cap / weight as ratio, row_number() over (order by cap / weight, source asc nulls last) as rn from s1),
s3 as (select *, (1.5::double * (sum(source_size) over ())::double - coalesce(sum(cap) over (order by rn rows between unbounded preceding and 1 preceding), 0))
  / (sum(weight) over () - coalesce(sum(weight) over (order by rn rows between unbounded preceding and 1 preceding), 0)) as level from s2),
s4 as (select *, (select arg_min(level, rn) from s3 where ratio >= level) as found from s3),
s5 as (select source, source_size, least(cap, coalesce(weight * found, cap)) as target from s4),
s6 as (select *, coalesce(least({block}, greatest(1, floor((select min(target) from s5 where target > 0) / 64))), 1)::bigint as block,
  least({most}, greatest(1, ceil(source_size / {words}.0::double)))::bigint as shards from s5),
s7 as (select *, round((select sum(target) from s5) / block)::bigint as blocks from s6),
{_sainte_lague('s8', 's7', '', 'source asc nulls last', 'target', 'blocks', 'source_blocks')},
rows_ as (select d.*, s.source_size, s.target, s.block, s.source_blocks, d.key % s.shards as shard from sized d join s8 s on d.source is not distinct from s.source),
h0 as (select source, block, source_blocks, shard, sum(size)::double as words from rows_ group by all),
{_sainte_lague('h1', 'h0', 'source', 'shard asc nulls last', 'words', 'source_blocks', 'quota')},
h2 as (select source as qsource, shard as qshard, words::bigint as words, least(quota * block, 2 * words::bigint)::bigint as take,
  ({id_hash('mix-start', 'source', 'shard')} % greatest(1, ceil(words / block))::bigint) * block as start from h1),
r as (select rows_.*, h2.*, sum(size) over (partition by source, shard order by key, doc_id, size rows unbounded preceding) as end_
  from rows_ join h2 on source is not distinct from qsource and shard = qshard)
select doc_id, source, size, source_size, target, shard::bigint as shard, ((take // greatest(1, words)) * size
  + greatest(0, least(end_, least(words, start + take % greatest(1, words))) - greatest(end_ - size, start))
  + greatest(0, least(end_, start + take % greatest(1, words) - words) - greatest(end_ - size, 0)))::bigint as taken from r
"""

def sharding(limit: int = 64 << 20) -> str:
    """The shortest hash prefixes whose documents are within the limit."""
    return f"""
with d as (select doc_id, coalesce(strlen(text), 0)::bigint as bytes, {id_hash('shard', 'doc_id')} as h from documents),
e as (select *, unnest(range(0, 61)) as depth from d),
p as (select depth, h >> (60 - depth)::int as prefix, sum(bytes)::bigint as shard_bytes, count(*) as shard_docs, min(h) = max(h) as single from e group by 1, 2),
m as (select e.doc_id, e.bytes, e.depth, prefix, shard_bytes, shard_docs, row_number() over (partition by e.doc_id, e.h order by e.depth) as nth
  from e join p on e.depth = p.depth and e.h >> (60 - e.depth)::int = prefix where shard_bytes <= {limit} or single)
select doc_id, bytes, depth::int as depth, ((1::bigint << depth::int) + prefix)::bigint as shard, shard_bytes, shard_docs from m where nth = 1
"""

_MARKS = "[.,;:!?''\"()\\-]"
_KINDS = ["[a-z]", "[A-Z]", "[0-9]", r"[\x20\x09-\x0D]", _MARKS, None, r"[^\x00-\x7F]", r"[\x00-\x08\x0E-\x1F\x7F]"]
_COUNT = "length(regexp_replace(text, '{}', '', 'g'))"


def _kinds() -> str:
    """Counts of the character classes; signs are what no other class holds."""
    counts = [None if k is None else f"(length(text) - {_COUNT.format(k)})" for k in _KINDS]
    counts[rules.SIGN] = "(length(text) - " + " - ".join(c for c in counts if c) + ")"
    return ", ".join(f"{c}::bigint" for c in counts)


def _distance(name: str, cells: str, many: int) -> str:
    """Jensen-Shannon distance of each document's histogram (doc_id, lang, i, n) from that of the rest of its language."""
    return f"""
{name}_r as (select c.lang, i, sum(n) as n from {cells} c join base using (doc_id) where not base_failed group by all), {name}_t as (select lang, sum(n) as t from {name}_r group by lang),
{name}_d as (select doc_id, any_value(c.lang) as lang, sum(n) as t, any_value(base_failed) as bad from {cells} c join base using (doc_id) group by doc_id having sum(n) > 0),
{name}_o as (select d.*, coalesce(tt.t, 0) - case when bad then 0 else d.t end as rest from {name}_d d left join {name}_t tt on tt.lang is not distinct from d.lang),
{name}_p as (select d.doc_id, coalesce(c.n, 0) / d.t::double as p, (coalesce(r.n, 0) - case when bad then 0 else coalesce(c.n, 0) end) / nullif(rest, 0)::double as q from {name}_o d cross join range(0, {many}) k(i)
  left join {name}_r r on r.lang is not distinct from d.lang and r.i = k.i left join {cells} c on c.doc_id = d.doc_id and c.i = k.i),
{name} as (select doc_id, any_value(rest) as rest, case when any_value(rest) > 0 then sqrt(greatest(0, sum(((case when p > 0 then p * log2(p / ((p + q) / 2)) else 0 end) + (case when q > 0 then q * log2(q / ((p + q) / 2)) else 0 end)) / 2))) end as d
  from {name}_p join {name}_o using (doc_id) group by doc_id)"""


OP4_RULES = f"""
with docs as (select doc_id, lang, coalesce(text, '') as text from documents),
l as (select doc_id, lang, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as w from docs),
g as (select doc_id, i, array_to_string(w[i:i + 4], ' ') as g from (select *, unnest(range(1, len(w) - 3)) as i from l)),
h as (select doc_id, i from (select *, count(*) over (partition by doc_id, g) as n from g) where n > 1),
rep as (select doc_id, count(distinct hit) as n from (select doc_id, unnest(range(i, i + 5)) as hit from h) group by doc_id),
lines as (select doc_id, count(*) - count(distinct line) as n from (select doc_id, unnest(string_split(text, chr(10))) as line from docs) where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by doc_id),
base as (select l.doc_id, len(w)::bigint as n_words, {_COUNT.format(r'[\x20\x09-\x0D]')}::bigint as word_chars, {_COUNT.format('[^#*$%&|<>]')}::bigint as n_symbols,
  coalesce(lines.n, 0)::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words, len(w) < 10 or 100 * coalesce(rep.n, 0) > 20 * len(w) as base_failed
  from l join docs using (doc_id) left join rep using (doc_id) left join lines using (doc_id)),
said as (select doc_id, lang, translate(unnest(w), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as w from l),
voc as (select lang, w, row_number() over (partition by lang order by n desc, w) - 1 as i from (select lang, w, count(*) as n from said join base using (doc_id) where not base_failed group by lang, w) qualify i < {rules.TOP}),
com as (select doc_id, any_value(said.lang) as lang, coalesce(voc.i, {rules.TOP}) as i, count(*) as n from said left join voc on voc.lang is not distinct from said.lang and voc.w = said.w group by doc_id, coalesce(voc.i, {rules.TOP})),
cls as (select doc_id, lang, unnest(range(0, 8)) as i, unnest([{_kinds()}]) as n from docs),
{_distance('dc', 'cls', 8)}, {_distance('dw', 'com', rules.TOP + 1)},
j as (select base.*, dc.d as c, dw.d as w, n_words >= 30 and dw.rest >= 1000 and (dc.d > 0.16::double + 0.8::double * (1 / sqrt(n_words)) or dw.d > 0.265::double + 1 / sqrt(n_words)) as strange
  from base left join dc using (doc_id) left join dw using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(c, 6) as class_distance, round(w, 6) as common_distance,
  not base_failed and not coalesce(strange, false) as kept from j
"""

OP8_TOPK = """
with v as (select vec_id, [floor(256.0::double * x::double)::bigint for x in embedding] as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, coalesce(list_sum([x[1] * x[2] for x in list_zip(q.e, c.e)]), 0)::bigint as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 50 = 0)
select query_id, rank::int as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5
"""

ORACLES = {
    "op1_mixing": mixing(), "op4_rules": OP4_RULES, "op8_topk": OP8_TOPK, "op9_sharding": sharding(),
    "mixing_small_shards": mixing(16, 2048), "sharding_small_limit": sharding(1 << 16), "topk_small_blocks": OP8_TOPK,
}
