"""DuckDB twins of the queries that SQL can express.

Compression, main text, tokenizers, mined rules and decoded keys have no SQL form: tests/llm compares those queries with brute force.
"""

from __future__ import annotations

from . import scoring

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"
_ALNUM = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
with item as (select item_id, {_ALNUM} as w from benchmark),
gram as (select distinct item_id, least(10, len(w)) as width, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') as gram
         from item, unnest(generate_series(1, greatest(1, len(w) - 9))) as g(i) where len(w) > 0),
doc as (select doc_id, {_ALNUM} as w from documents),
win as (select doc_id, i, width, array_to_string(w[i:i + width - 1], ' ') as gram
        from doc, (select distinct width from gram), unnest(generate_series(1, len(w) - width + 1)) as g(i) where len(w) >= width),
hit as (select doc_id, i, width, item_id from win join gram using (width, gram)),
words as (select doc_id, count(distinct p) as n_hit from hit, unnest(generate_series(i, i + width - 1)) as g(p) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
          from (select distinct doc_id, cast(item_id as varchar) as item from hit) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from doc d left join words using (doc_id) left join items using (doc_id)"""

JACCARD = f"""
with recursive doc as (select doc_id, {_SPACED} as w from documents),
shingle as (select distinct doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') as s
            from doc, unnest(generate_series(1, greatest(1, len(w) - 4))) as g(i) where len(w) > 0),
size as (select doc_id, count(*) as n from shingle group by doc_id),
pairs as (select a.doc_id as u, b.doc_id as v, count(*) as c from shingle a join shingle b on a.s = b.s and a.doc_id <> b.doc_id group by all),
link as (select u, v from pairs join size x on x.doc_id = u join size y on y.doc_id = v where 100 * c >= 80 * (x.n + y.n - c)),
reach(doc_id, other) as (select doc_id, doc_id from doc union select r.doc_id, l.v from reach r join link l on l.u = r.other)
select d.doc_id, coalesce(n, 0) as n_shingles, component_id
from doc d left join size using (doc_id) join (select doc_id, min(other) as component_id from reach group by doc_id) using (doc_id)"""

CHAT = """
with turns as (select distinct conv_id, turn, coalesce(nullif(trim(regexp_replace(replace(role, '<|', '< |'), '[\r\n]+', ' ', 'g')), ''), 'unknown') as speaker, replace(coalesce(text, ''), '<|', '< |') as text
               from conversations),
people as (select distinct conv_id, speaker as perspective from turns where speaker <> 'system'),
formed as (select t.*, perspective, case when speaker = perspective then 'assistant' when speaker = 'system' then 'system' else 'user' end as role
           from turns t join people p on t.conv_id is not distinct from p.conv_id),
named as (select *, case when role = 'user' then speaker end as name from formed),
headed as (select *, '<|im_start|>' || role || coalesce(' name=' || name, '') || chr(10) as head from named),
built as (select *, head || text || '<|im_end|>' || chr(10) as segment from headed),
placed as (select *, row_number() over o - 1 as position, coalesce(sum(length(segment)) over (o rows between unbounded preceding and 1 preceding), 0) as start
           from built window o as (partition by conv_id, perspective order by turn nulls first, speaker, text))
select conv_id, perspective, position, turn, role, name, segment, cast(start as bigint) as start,
       cast(case when role = 'assistant' then start + length(head) end as bigint) as mask_start,
       cast(case when role = 'assistant' then start + length(segment) - 1 end as bigint) as mask_end
from placed"""

_MODEL = scoring.Model()
SCORING = f"""
with doc as (select doc_id, {_SPACED} as w, doc_id in (select doc_id from labels where quality = 1 and coalesce(toxic, 0) = 0) as target from documents),
word as (select doc_id, target, i, w[i] as word from doc, unnest(generate_series(1, len(w))) as g(i) where len(w) > 0),
pair as (select doc_id, target, word as t, coalesce(lag(word) over (partition by doc_id order by i), '') as b from word),
n2 as (select b, t, count(*) as n, count(*) filter (target) as m from pair group by all),
types as (select distinct t from n2 union all select ' '),
n1 as (select a.t, coalesce(sum(n), 0) + {_MODEL.added} as n, coalesce(sum(m), 0) + {_MODEL.added} as m from types a left join n2 using (t) group by a.t),
p1 as (select t, n / sum(n) over () as p, m / sum(m) over () as q from n1),
n0 as (select b, sum(n) as n, sum(m) as m from n2 group by b),
loss as (select b, t, -log2(case when n0.n > 0 then {_MODEL.bigram_weight} * n2.n / n0.n + {1 - _MODEL.bigram_weight:.12g} * p else p end) as lb,
                -log2(case when n0.m > 0 then {_MODEL.bigram_weight} * n2.m / n0.m + {1 - _MODEL.bigram_weight:.12g} * q else q end) as lt
         from n2 join n0 using (b) join p1 using (t)),
mean as (select doc_id, count(*) as n_tokens, avg(lt) as lt, avg(lb) as lb from pair join loss using (b, t) group by doc_id)
select d.doc_id, coalesce(n_tokens, 0) as n_tokens, round(lt, 6) as target_loss, round(lb, 6) as background_loss, round(lt - lb, 6) as score
from doc d left join mean using (doc_id)"""


NEGATIVES = """
with valid as (select vec_id, cast(label as bigint) as label, embedding from embeddings
               where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
vec as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v from valid),
pair as (select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, cast(list_dot_product(a.v, b.v) as bigint) as score
         from vec a join vec b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
positive as (select * from pair where same qualify row_number() over (partition by anchor_id order by score desc, id) <= 5),
win as (select p.anchor_id, p.id as positive_id, n.id as negative_id, p.score as positive_score, n.score as negative_score,
               row_number() over (partition by p.anchor_id, p.id order by n.score desc, n.id) as rank
        from positive p join pair n on n.anchor_id = p.anchor_id and not n.same and 80 * p.score <= 100 * n.score and n.score <= p.score)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from win where rank <= 5"""


LEXICAL = f"""
with doc as (select doc_id, row_number() over () as row, {_ALNUM} as w from documents),
tf as (select row, any_value(doc_id) as doc_id, any_value(len(w)) as n, t, count(*) as tf from (select row, doc_id, w, unnest(w) as t from doc) group by row, t),
total as (select count(*) as n_docs, cast(sum(n) as bigint) as n_terms from (select row, any_value(n) as n from tf group by row)),
weight as (select t, cast(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) as bigint) as w from tf, total group by t),
item as (select item_id, row, t, count(*) as times from (select item_id, row_number() over () as row, unnest({_ALNUM}) as t from benchmark) group by all),
impact as (select tf.row, doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms))) as impact from tf join weight using (t), total),
score as (select item.row, item_id, doc_id, cast(sum(times * impact) as bigint) as score from item join impact using (t) group by item.row, item_id, impact.row, doc_id),
placed as (select *, row_number() over (partition by row order by score desc, doc_id nulls last) as rank from score where score > 0)
select item_id, cast(rank as integer) as rank, doc_id, score from placed where rank <= 20"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": DECONTAMINATION, "op2_lm_scoring": SCORING, "op3_ngram_jaccard": JACCARD, "op4_chat_rotation": CHAT,
            "op11_lexical_search": LEXICAL, "op13_hard_negatives": NEGATIVES}
