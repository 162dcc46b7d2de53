"""SQL of the operators whose whole results SQL can express."""

_SMALL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: CRC-32 of a list of byte values, from the table of its 256 remainders.
_CRC_TABLE = """
remainders as (
  select list(r order by i) as t
  from (select i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
          lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as r
        from range(256) as b(i)))"""


def _crc(text: str) -> str:
    digits = "'0123456789ABCDEF'"
    byte = f"16 * instr({digits}, hex({text})[2 * i + 1]) + instr({digits}, hex({text})[2 * i + 2]) - 17"
    values = f"list_transform(range(strlen({text})), lambda i: ({byte})::bigint)"
    step = "lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {values}), {step}), 4294967295)"


COPIES = f"""
with digests as (
  select doc_id, sha256({_SMALL.format("coalesce(text, '')")}) as text_sha256 from documents)
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
  doc_id is not distinct from max(doc_id) over same as kept, text_sha256
from digests window same as (partition by text_sha256)"""

VARIANTS = f"""
with recursive {_CRC_TABLE.strip()},
runs as (
  select doc_id, run, count(*) as n
  from (select doc_id, unnest(regexp_extract_all({_SMALL.format("text")}, '[a-zÀ-ÿ]+')) as run from documents)
  where length(run) >= 7 group by all),
hashed as (select run, n, {_crc("(coalesce(doc_id::varchar, 'null') || ':' || run)")} as h from runs, remainders),
words as (
  select word, sum(n)::bigint as n
  from (select n, case when h % 31 = 0 then run[:h % length(run)] || run[h % length(run) + 2:] else run end as word
        from hashed)
  where length(word) >= 7 group by word having sum(n) >= 2),
shorter as (
  select word, n, i, word[:i] || word[i + 2:] as rest
  from (select word, n, unnest(range(length(word))) as i from words)),
deleted as (select distinct s.word as longer, s.n as longer_n, w.word, w.n from shorter s join words w on s.rest = w.word),
near as (
  select a.word, a.n, b.word as other, b.n as other_n
  from shorter a join shorter b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union all select word, n, longer, longer_n from deleted
  union all select longer, longer_n, word, n from deleted),
best as (
  select word, count(*) as n_near, arg_min(struct_pack(w := other, n := other_n), (-other_n, other)) as top
  from near group by word),
forms as (
  select w.word, case when top.n >= 10 * w.n then top.w end as form, w.n, coalesce(n_near, 0) as n_near,
    case when top.n >= 10 * w.n then top.n end as form_n
  from words w left join best using (word)),
follow as (
  select word, word as root, form as next from forms
  union all select follow.word, forms.word, forms.form from follow join forms on follow.next = forms.word)
select word, form, root, n, n_near, form_n
from forms join (select word, root from follow where next is null) using (word)"""


def _field(name: str) -> str:
    return f"coalesce(strlen({name}::varchar) || ':' || {name}::varchar, '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


def _levels(name: str, leaves: str) -> str:
    """Nodes of every level; ``width`` counts those of the level."""
    return f"""
{name} as (
  select tree, 0 as level, pos, node, count(*) over (partition by tree) as width from {leaves}
  union all
  select tree, level + 1, pos // 2, sha256(string_agg(node, '' order by pos)), (width + 1) // 2
  from {name} where width > 1 group by tree, level, pos // 2, width)"""


MANIFEST = f"""
with recursive {_CRC_TABLE.strip()},
rows as (
  select doc_id, lang as tree, row_number() over (partition by lang order by doc_id) - 1 as pos, {_leaf("n_chars")} as node,
    case when {_crc("doc_id::varchar")} % 7 = 0 then {_leaf("(n_chars + 1)")} end as tampered
  from documents, remainders),
{_levels("nodes", "rows").strip()},
subroots as (
  select tree as lang, '' as tree, row_number() over (order by tree nulls first) - 1 as pos, node
  from nodes where width = 1),
{_levels("tops", "subroots").strip()},
heights as (select tree, max(level) as height from nodes group by tree),
steps as (
  select doc_id, n.level as step, (rows.pos >> n.level) & 1 = 1 as right_one, s.node as sibling
  from rows join nodes n on n.tree is not distinct from rows.tree and n.pos = rows.pos >> n.level and n.width > 1
  left join nodes s on s.tree is not distinct from n.tree and s.level = n.level and s.pos = xor(n.pos, 1)
  union all
  select doc_id, height + n.level, (subroots.pos >> n.level) & 1 = 1, s.node
  from rows join subroots on subroots.lang is not distinct from rows.tree
  join heights on heights.tree is not distinct from rows.tree
  join tops n on n.pos = subroots.pos >> n.level and n.width > 1
  left join tops s on s.level = n.level and s.pos = xor(n.pos, 1)),
folded as (
  select doc_id, 0 as step, coalesce(tampered, node) as node from rows
  union all
  select doc_id, step + 1, sha256(case when sibling is null then node when right_one then sibling || node
    else node || sibling end)
  from folded join steps using (doc_id, step)),
ends as (select doc_id, arg_max(node, step) as folded_root from folded group by doc_id),
proofs as (select doc_id, sha256(coalesce(string_agg(sibling, '' order by step), '')) as proof from steps group by doc_id)
select doc_id, rows.node as leaf, subroots.node as subroot, tops.node as root,
  coalesce(proof, sha256('')) as proof_sha256, folded_root, folded_root = tops.node as verified
from rows join subroots on subroots.lang is not distinct from rows.tree
join tops on tops.width = 1 join ends using (doc_id) left join proofs using (doc_id)"""
