"""One query per operator, with production parameters, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codexferry.llm import bpe, caps, chat, decontam, exact, langid, neardup, negatives, ngram, passages, phrases, pii, toxicity
from codexferry.llm.common import table
from codexferry.llm.registry import QUERIES, SQL, query

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def load():
    """(queries, sql) of all operators in this folder."""
    return dict(QUERIES), dict(SQL)


def key_hash(key: str = "doc_id") -> Column:
    """crc32 of the key as text; of the empty text for a null key."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))


@query("op1_deleted_interpolation")
def op1_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = key_hash() % 7 == 2
    found = ngram.scores(docs, ~held_out, F.floor(key_hash() / 7) % 10 == 0)
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


NEAR_SQL = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as t
  from documents
), s as (
  select doc_id, unnest(list_distinct(case when len(t) = 0 then [] when len(t) < 4 then [list_aggregate(t, 'string_agg', ' ')]
    else list_transform(range(1, len(t) - 2), lambda i: list_aggregate(t[i:i + 3], 'string_agg', ' ')) end)) as g
  from w
), n as (select doc_id, count(*) as n from s group by doc_id),
shared as (select g from s group by g having count(*) > 1),
p as (
  select a.doc_id as a, b.doc_id as b, count(*) as c
  from (select * from s where g in (from shared)) a join (select * from s where g in (from shared)) b
    on a.g = b.g and a.doc_id < b.doc_id group by all
), l as (
  select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)
), e as (select a, b from l union select b, a from l),
r as (select doc_id as d, doc_id as m from documents union select e.b, r.m from r join e on e.a = r.d where r.m < e.b)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, m.m as component_id, w.doc_id = m.m as kept
from w left join n using (doc_id) join (select d, min(m) as m from r group by d) m on m.d = w.doc_id
"""


@query("op2_minhash_near_dedup", NEAR_SQL)
def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query("op6_byte_bpe")
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return byte_bpe(docs)


def byte_bpe(docs: DataFrame) -> DataFrame:
    return bpe.digests(docs, RANKS, public_tokenizers.PATTERN)


LEAK_SQL = r"""
with dw as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as t from documents
), iw as (
  select item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as t from benchmark
), masks as (
  select unnest([[0, 2, 5, 6, 7], [0, 3, 4, 5, 7]]) as m, 8 as span
  union all select range(n), n from (select distinct len(t) as n from iw where len(t) between 1 and 7)
), ip as (select item_id, t, m, span, unnest(range(len(t) - span + 1)) as p from iw, masks
    where len(t) = span or (span = 8 and len(t) > 8)),
dp as (select doc_id, t, m, span, unnest(range(len(t) - span + 1)) as p from dw, masks where len(t) >= span),
ik as (select item_id, span, p, m, list_transform(m, lambda o: t[p + o + 1]) as k from ip),
dk as (select doc_id, span, p, m, list_transform(m, lambda o: t[p + o + 1]) as k from dp),
hit as (select distinct doc_id, item_id, dk.p - ik.p as d from dk join ik using (span, m, k)),
cmp as (
  select doc_id, item_id, least(len(iw.t), 13) as w, list_transform(range(len(iw.t)),
    lambda i: case when i + d >= 0 and i + d < len(dw.t) and dw.t[i + d + 1] = iw.t[i + 1] then 1 else 0 end) as e
  from hit join dw using (doc_id) join iw using (item_id)
), best as (
  select doc_id, item_id, w, list_max(list_transform(range(len(e) - w + 1), lambda j: list_sum(e[j + 1:j + w]))) as n from cmp
)
select doc_id, item_id, max(n)::int as "equal", w::int as "window" from best
where n >= w - [%s][w] group by doc_id, item_id, w
""" % ", ".join(str(decontam.tolerance(i)) for i in range(1, decontam.WINDOW + 1))


@query("op10_spaced_seed_decontamination", LEAK_SQL)
def op10_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The key of the surrogates in the registered queries; a real run brings its own.
PII_KEY = "registered-query"


@query("op9_surrogate_pii")
def op9_surrogate_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.pseudonymized(docs, PII_KEY, spans=True)
    return found.select("doc_id", "text", F.size("pii").cast("long").alias("n_found"), F.col("pii.kind").alias("kinds"))


def toxicity_model(docs: DataFrame, spark: SparkSession, sf_dir: str) -> toxicity.Model:
    """Learned from the labels whose key's hash is not divisible by 5."""
    return toxicity.fit(docs, table(spark, sf_dir, "labels"), key_hash() % 5 != 0)


@query("op5_nearest_toxicity")
def op5_nearest_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity_model(docs, spark, sf_dir))
    return found.select("doc_id", (key_hash() % 5 == 0).alias("held_out"), "score", "predicted", "evidence")


CAPS_SQL = """
with recursive v as (select vec_id, embedding::double[] as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
u as (select vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) as e from v),
l as (select a.vec_id as a, b.vec_id as b from u a join u b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  and list_inner_product(a.e, b.e) >= 0.95),
r as (select vec_id as d, vec_id as m from embeddings union select l.b, r.m from r join l on l.a = r.d where r.m < l.b),
m as (select d, min(m) as m from r group by d), n as (select a, count(*) as n from l group by a)
select vec_id, coalesce(n.n, 0)::bigint as n_links, m.m as component_id, vec_id = m.m as kept
from embeddings left join n on n.a = vec_id join m on m.d = vec_id
"""


@query("op7_cap_vector_dedup", CAPS_SQL)
def op7_cap_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.95)


CHAT_SQL = """
with last as (select conv_id, max(turn) as t from conversations group by conv_id),
b as (
  select distinct conv_id, turn, 'c' as side, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all
  select distinct conv_id, turn, 'r', coalesce(role, ''), case when role = 'assistant' and turn * 2 >= last.t
    then left(coalesce(text, ''), length(coalesce(text, '')) // 2) else coalesce(text, '') end
  from conversations join last using (conv_id)
), t as (
  select conv_id, turn, list((role, text) order by role, text) filter (side = 'c') as c,
    list((role, text) order by role, text) filter (side = 'r') as r from b group by all
), e as (select conv_id, min(turn) as fin from t where c is distinct from r group by conv_id),
m as (
  select conv_id, b.turn, b.turn // 256 as chunk, role, text,
    case when fin is null or b.turn < fin then 'p' else side end as part
  from b left join e using (conv_id) where side = 'c' or b.turn >= fin
), o as (
  select *, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) as s,
    row_number() over (partition by conv_id, chunk, part order by turn, role, text) as k,
    coalesce(sum(length(role) + length(text) + 13) over (partition by conv_id, chunk, part
      order by turn, role, text rows between unbounded preceding and 1 preceding), 0)::int as pos
  from m
), l as (select *, pos + length(role) + 5 as f, pos + length(role) + length(text) + 12 as g from o)
select conv_id, chunk::bigint as chunk,
  coalesce(string_agg(s, '' order by k) filter (part = 'p'), '') as prompt,
  coalesce(string_agg(s, '' order by k) filter (part = 'c'), '') as chosen,
  coalesce(string_agg(s, '' order by k) filter (part = 'r'), '') as rejected,
  coalesce(string_agg(f || '-' || g, ',' order by k) filter (part = 'c' and role = 'assistant'), '') as chosen_spans,
  coalesce(string_agg(f || '-' || g, ',' order by k) filter (part = 'r' and role = 'assistant'), '') as rejected_spans,
  count(*) filter (part = 'p')::int as prompt_turns, count(*) filter (part = 'c')::int as chosen_turns,
  count(*) filter (part = 'r')::int as rejected_turns
from l group by conv_id, chunk
"""


@query("op4_preference_chat", CHAT_SQL)
def op4_preference_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rejected side is derived: assistants break off half-way in the second half of the turns."""
    talks = table(spark, sf_dir, "conversations")
    last = talks.groupBy(F.col("conv_id").alias("c")).agg(F.max("turn").alias("last"))
    text = F.coalesce("text", F.lit(""))
    broken = (F.col("role") == "assistant") & (F.col("turn") * 2 >= F.col("last"))
    worse = F.when(broken, F.substring(text, F.lit(1), F.floor(F.length(text) / 2).cast("int"))).otherwise(text)
    rejected = talks.join(last, F.col("conv_id") == F.col("c")).select("conv_id", "turn", "role", worse.alias("text"))
    found = chat.preferences(talks, rejected)
    shown = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"], s["end"])), ",").alias(c)
    return found.withColumns({c: shown(c) for c in ("chosen_spans", "rejected_spans")})


@query("op3_fused_language")
def op3_fused_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = langid.fit(table(spark, sf_dir, "documents"))
    return langid.identify(table(spark, sf_dir, "pages"), model)


@query("op8_chained_passages")
def op8_chained_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


EXACT_SQL = r"""
with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents)
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = min(doc_id) over w as kept, sha256(t) as text_sha256
from t window w as (partition by t)
"""


@query("op13_exact_dedup", EXACT_SQL)
def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


NEGATIVES_SQL = """
with v as (
  select row_number() over () as row, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as e
  from embeddings where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.row as anchor, a.vec_id as anchor_id, b.row as other, b.vec_id as other_id, a.label = b.label as same,
    coalesce(list_sum(list_transform(range(len(a.e)), lambda i: a.e[i + 1] * b.e[i + 1])), 0)::bigint as score
  from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
), p as (
  select anchor, anchor_id, other as positive, other_id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor order by score desc, other_id, other) <= 5
)
select p.anchor_id, positive_id, row_number() over w::int as rank, other_id as negative_id, positive_score, score as negative_score
from p join s on s.anchor = p.anchor and not same and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score
window w as (partition by p.anchor, positive order by score desc, other_id, other)
qualify row_number() over w <= 5
"""


@query("op12_hard_negatives", NEGATIVES_SQL)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), label=label, anchors=F.col("vec_id") % 100 == 0)


COLLOCATIONS_SQL = r"""
with p as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as p from documents
), w as (select lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') as w from p),
g as (select lang, w, m, unnest(range(1, len(w) - m + 2)) as i from w, (select unnest(range(1, 6)) as m) where len(w) >= m),
f as (select lang, m, array_to_string(w[i:i + m - 1], ' ') as phrase, count(*) as a from g group by all),
n as (select lang, sum(a)::bigint as n from f where m = 1 group by lang),
c as (select * from f where m > 1 and a >= 100),
alone as (
  select c.*, string_split(phrase, ' ') as w from c where not exists (
    select 1 from c b where b.lang = c.lang and b.m > c.m and 100 * b.a >= 100 * c.a and contains(' ' || b.phrase || ' ', ' ' || c.phrase || ' '))
), k as (select *, unnest(range(1, m)) as k from alone),
s as (
  select k.lang, k.phrase, k.a, n.n, x.a as l, y.a as r, k.k, ((1000::hugeint * k.a * n.n) // (x.a::hugeint * y.a))::bigint as score
  from k join n using (lang) join f x on x.lang = k.lang and x.phrase = array_to_string(k.w[:k.k], ' ')
    join f y on y.lang = k.lang and y.phrase = array_to_string(k.w[k.k + 1:], ' ')
), b as (select * from s qualify row_number() over (partition by lang, phrase order by score, k) = 1)
select lang, row_number() over v as rank, phrase, a, l, r, n, score from b
window v as (partition by lang order by score desc, a desc, phrase) qualify row_number() over v <= 2000
"""


@query("op11_phrase_collocations", COLLOCATIONS_SQL)
def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))
