"""The queries of this package, and their SQL where SQL can say the same."""

from . import bpe, chat, decontam, html, linededup, lm, minhash, pii, toxicity, vectors

QUERIES = {
    "op1_minhash": minhash.op1_minhash,
    "op2_pii": pii.op2_pii,
    "op3_html": html.op3_html,
    "op4_chat": chat.op4_chat,
    "op5_decontam": decontam.op5_decontam,
    "op6_linededup": linededup.op6_linededup,
    "op7_bpe": bpe.op7_bpe,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_vectors": vectors.op9_vectors,
    "op10_lm": lm.op10_lm,
}

_ESCAPED = r"replace(replace(replace(coalesce({}, ''), '\', '\\'), '###', '\h'), '</turn>', '\e')"
_ROLE = r"replace(replace(" + _ESCAPED.format("role") + r", ':', '\c'), chr(10), '\n')"
ORACLE_SQL = {
    "op4_chat": rf"""
with t as (
  select conv_id, turn, role, text from conversations
  union all select -7, 0, 'user', '{chat.CONTROL}' union all select -7, 1, 'assistant', '{chat.CONTROL}'
), c as (
  select cast(conv_id as bigint) as conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text,
         length({_ROLE}) as role_chars, length({_ESCAPED.format("text")}) as text_chars
  from t
)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn) filter (where role = 'assistant'), '')) as loss_sha256,
       cast(sum({len(chat.HEAD) + len(chat.MID) + len(chat.TAIL)} + role_chars + text_chars) as bigint) as formatted_chars
from c group by conv_id""",
    "op9_vectors": """
with recursive v as (
  select vec_id, label, embedding::double[] as x, sqrt(list_sum(list_transform(embedding::double[], lambda c: c * c))) as norm from embeddings
), e as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
  where a.norm > 0 and b.norm > 0 and list_dot_product(a.x, b.x) / (a.norm * b.norm) >= 0.98
), reach as (
  select vec_id as a, vec_id as b from v union select r.a, e.b from reach r join e on r.b = e.a
), c as (select a, min(b) as component_id from reach group by a)
select v.vec_id, coalesce(n, 0) as n_links, component_id, v.vec_id = component_id as kept
from v join c on v.vec_id = c.a left join (select a, count(*) as n from e group by a) l on l.a = v.vec_id""",
}
