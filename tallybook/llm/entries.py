"""Queries of this subpackage for __spark_entry__.py: each applies one operator to its whole table."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tallybook.llm import ann, bpe, embed_dedup, langid, mixing, packing, quality, secrets, simhash, spelling, token_counts, toxicity, trie
from tallybook.llm.common import table


def vocabulary(name: str) -> str:
    """The text of a public vocabulary file, read on the driver."""
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_text(encoding="utf-8")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.learnt(docs, table(spark, sf_dir, "labels")))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scanned(table(spark, sf_dir, "documents"))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op4_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.counted(table(spark, sf_dir, "documents"), Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes())


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.learnt(docs, table(spark, sf_dir, "labels")))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_secrets, op3_ann, op4_embed_dedup, op5_token_counts, op6_quality, op7_langid, op8_simhash, op9_bpe, op10_packing, op11_mixing, op12_prefix_trie, op13_spelling)}

#: Exact links, components and tries; the others' rows follow from trained models, tokenizers, hashes or searches that SQL can't express.
ORACLES: dict[str, str] = {
    "op4_embed_dedup": """
with recursive v as (
  select vec_id, cast(embedding as double[]) e from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x != 0)) > 0
), l as (
  select a.vec_id x, b.vec_id y from v a join v b on a.vec_id != b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.9
), r as (
  select vec_id x, vec_id y from embeddings union select r.x, l.y from r join l on r.y = l.x
), n as (select x, count(*) n from l group by x), c as (select x, min(y) c from r group by x)
select vec_id, coalesce(n.n, 0) n_links, c.c component_id, c.c = vec_id kept from embeddings left join n on n.x = vec_id join c on c.x = vec_id
""",
    # h: the bits of crc32 one by one, eight after each character
    "op12_prefix_trie": """
with t as (
  select conv_id c, row_number() over (partition by conv_id order by turn nulls first) p, {'r': coalesce(role, ''), 'x': coalesce(text, '')} e from conversations where conv_id is not null
), b as (
  select c, count(*) n, list_reduce(
    list_prepend(cast(4294967295 as bigint), flatten(list_transform(string_split(cast(c as varchar), ''), lambda d: [cast(ascii(d) as bigint), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, d: case when d >= 0 then xor(a, d) else xor(a >> 1, 3988292384 * (a & 1)) end) z
  from t group by c
), k as (select c, n, xor(z, 4294967295) % 6 h, c - c % 100 g from b
), s as (
  select k.c, t.p, t.e from k join t on t.c = k.g and t.p <= k.h
  union all select k.c, t.p + least(k.h, coalesce(o.n, 0)) - k.h, t.e from k join t on t.c = k.c and t.p > k.h left join b o on o.c = k.g
), w as (select k.c, list(s.e order by s.p) filter (s.p is not null) l from k left join s on s.c = k.c group by k.c
), m as (select c, d, coalesce(l, [])[1:d] f, d = len(coalesce(l, [])) last from w, lateral (select unnest(range(0, len(coalesce(l, [])) + 1)) d)
), v as (
  select d, f, min(c) conv_id, count(*) n_convs, sha256(coalesce(string_agg(cast(c as varchar), ',' order by c) filter (last), '')) ends_sha256, (count(*) - 1) * case when d = 0 then 0 else length(f[d]['x']) end saved
  from m group by d, f
), u as (select v.d + 1 d, v.f, count(*) n from v join v a on a.d = v.d + 1 and a.f[1:v.d] = v.f group by v.d, v.f
), r as (
  select q.d, v.f[1:q.d] f, count(*) filter (u.n is null) n_leaves, sum(v.saved) saved_tokens
  from v left join u on u.d = v.d + 1 and u.f = v.f, lateral (select unnest(range(0, v.d + 1)) d) q group by q.d, v.f[1:q.d]
)
select v.conv_id, v.d depth, a.conv_id parent_conv_id, v.n_convs, coalesce(u.n, 0) n_children, r.n_leaves, cast(r.saved_tokens as bigint) saved_tokens, v.ends_sha256
from v join r on r.d = v.d and r.f = v.f left join u on u.d = v.d + 1 and u.f = v.f left join v a on a.d = v.d - 1 and a.f = v.f[1:v.d - 1]
""",
    # t: crc32 of one byte, for each; z: crc32 of each document's runs, byte by byte
    "op13_spelling": """
with recursive t as materialized (
  select list(list_reduce(list_prepend(cast(i as bigint), list_transform(range(8), lambda k: cast(k as bigint))), lambda a, k: xor(a >> 1, 3988292384 * (a & 1))) order by i) b from (select unnest(range(256)) i)
), l as (
  select id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') run, count(*) n
  from (select coalesce(cast(doc_id as varchar), '') id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) run from documents) group by 1, 2
), h as (select id, run, n, hex(encode(id || ':' || run)) x from l
), z as (
  select run, n, xor(list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(range(len(x) // 2), lambda i: cast('0x' || substr(x, 2 * i + 1, 2) as bigint))), lambda a, d: xor(a >> 8, t.b[1 + (xor(a, d) & 255)])), 4294967295) z from h, t
), w as materialized (
  select case when z % 199 = 0 then substr(run, 1, z % length(run)) || substr(run, z % length(run) + 2) else run end w, cast(sum(n) as bigint) n from z group by 1 having length(w) >= 6 and sum(n) >= 5
), s as (select w, n, substr(w, 1, i) a, substr(w, i + 2) b from (select w, n, unnest(range(length(w))) i from w)
), p as (
  select x.w, y.w v, y.n m from s x join s y on x.a = y.a and x.b = y.b and x.w != y.w where length(x.w) = length(y.w) and length(x.a) = length(y.a)
  union select s.w, w.w, w.n from s join w on w.w = s.a || s.b union select w.w, s.w, s.n from s join w on w.w = s.a || s.b
), f as (select w, count(*) n_near, first(v order by m desc, v) v, max(m) m from p group by w
), o as (select w.w, w.n, coalesce(f.n_near, 0) n_near, case when f.m >= 5 * w.n then f.v end form, case when f.m >= 5 * w.n then f.m end form_n from w left join f using (w)
), r as (select w, w here, form onto from o union all select r.w, r.onto, o.form from r join o on o.w = r.onto)
select o.w word, form, r.here root, o.n, n_near, form_n from o join r on r.w = o.w and r.onto is null
""",
}
