"""One query for each operator of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, fingerprints, jaccard, langid, media, mixing, sharding, toxicity, urls
from .common import crc_of_id, table

RULES = [urls.Rule("net/", "block"), urls.Rule("example.net/en/", "allow"), urls.Rule("example.com/de/", "block"), urls.Rule("org/fr/", "allow")]
TOXIC = 0.7
SHARDS = 24


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary_path())


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a PNG, read back."""
    read = media.features(media.store(table(spark, sf_dir, "documents")))
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.lower(F.hex("hash")).alias("feature"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from the perspective of each participant."""
    return chat.segments(table(spark, sf_dir, "conversations"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against its edited text and the next document."""
    return fingerprints.compare(table(spark, sf_dir, "documents"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents linked at 90 % of their 3-word shingles."""
    return jaccard.groups(table(spark, sf_dir, "documents"), n=3, percent=90)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a classifier that saw no label of the held-out third."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = crc_of_id() % 3 == 1
    scorer = toxicity.train(docs.filter(~held), labels.filter(~held))
    scored = toxicity.score(docs, scorer)
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "shards")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 24 shards of equal bytes."""
    placed = sharding.assign(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url under rules and trees."""
    pages = table(spark, sf_dir, "pages")
    return urls.judge(pages, urls.train(urls.seed_labels(pages)), RULES)


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned without the held-out quarter."""
    docs = table(spark, sf_dir, "documents")
    held = crc_of_id() % 4 == 2
    found = langid.identify(docs, langid.train(docs.filter(~held)))
    return found.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe, op2_media, op3_chat, op4_fingerprints, op5_jaccard, op6_toxicity, op7_mixing, op8_sharding, op9_urls, op10_langid)}


OP3_SQL = r"""
with m as (
  select conv_id, turn, coalesce(role, 'unknown') as speaker, regexp_replace(coalesce(text, ''), '<(\\*)\|', '<\\\1|', 'g') as text from conversations
), p as (
  select distinct conv_id, speaker as perspective from m where speaker <> 'system'
), s as (
  select m.conv_id, perspective, turn, speaker, text,
    case when speaker = perspective then '<|assistant|>' || chr(10)
         when speaker = 'system' then '<|system|>' || chr(10)
         else '<|user name=' || regexp_replace(regexp_replace(speaker, '<(\\*)\|', '<\\\1|', 'g'), '\|(\\*)>', '|\\\1>', 'g') || '|>' || chr(10) end as head
  from m join p on m.conv_id is not distinct from p.conv_id
), t as (
  select *, head || text || chr(10) as segment,
    coalesce(sum(length(head || text || chr(10))) over (partition by conv_id, perspective
      order by turn nulls first, speaker, text rows between unbounded preceding and 1 preceding), 0)::bigint as seg_start
  from s
)
select conv_id, perspective, turn, speaker, segment, seg_start, (seg_start + length(segment))::bigint as seg_end,
  case when speaker = perspective then seg_start + length(head) end::bigint as mask_start,
  case when speaker = perspective then seg_start + length(segment) end::bigint as mask_end,
  speaker = perspective as trained
from t
"""

OP5_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words from documents
), g as (
  select distinct doc_id, case when len(words) < 3 then words else words[i:i + 2] end as gram
  from (select doc_id, words, unnest(range(1, greatest(2, len(words) - 1))) as i from w where len(words) > 0)
), h as (
  select doc_id, gram, dense_rank() over (order by gram) as k from g
), n as (
  select doc_id, count(*) as n from h group by 1
), pairs as (
  select a.doc_id as a, b.doc_id as b, count(*) as both_ from h a join h b on a.k = b.k and a.doc_id < b.doc_id group by 1, 2
), link as (
  select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * both_ >= 90 * (x.n + y.n - both_)
), edge as (
  select a, b from link union select b, a from link
), reach as (
  select a as s, b as t from edge union select r.s, e.b from reach r join edge e on r.t = e.a
)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(r.low, d.doc_id))::bigint as component_id
from documents d left join n on n.doc_id = d.doc_id left join (select s, min(t) as low from reach group by 1) r on r.s = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_chat": OP3_SQL, "op5_jaccard": OP5_SQL}
