"""A training-data pipeline: each stage works on all that the one before has kept.

Empty tables pass through every stage as empty tables; further columns of ``documents`` stay up to the last stage, whatever their names, null
columns are handled as the operators' docstrings say, and rows are never dropped for any other reason than the stage's own decision. The
last stage returns the encoding alone: id, numbers and digests of tokens, and their ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulon.llm import bpe, jaccard, langid, mixing, toxicity
from tabulon.llm.common import WRITTEN, cleaned, crc_of_id, drop_written, stored, table
from tabulon.llm.queries import TOXIC, vocabulary_path


def packed(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text): whole rows in one column beside what a stage reads, so that no name of the stage's own meets one of theirs."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", "text")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the language models reject: no letter, null or empty, or unlike any language."""
    found = langid.identify(packed(docs), langid.train(docs), keep=["row"])
    return found.filter(~F.col("rejected")).select("row.*")


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier scores as toxic; it learns from the labels but those of the held-out third."""
    labels = table(spark, sf_dir, "labels").filter(crc_of_id() % 3 != 1)
    scored = toxicity.score(packed(docs), toxicity.train(docs.filter(crc_of_id() % 3 != 1), labels), keep=["row"])
    return scored.filter(F.col("score") < TOXIC).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group at 80 % of the 5-word shingles, and of rows with equal id and text one. An id's different
    texts are documents of their own. Rows without an id stay."""
    keyed = packed(docs.filter("doc_id is not null")).withColumn("key", F.xxhash64("doc_id", "text"))
    found = stored(jaccard.groups(keyed, n=5, percent=80, id_col="key")).select("key", "component_id").distinct()
    named = found.join(keyed.select("doc_id", "key").distinct(), "key")
    firsts = stored(named.groupBy("component_id").agg(F.min(F.struct("doc_id", "key"))["key"].alias("key")).select("key"))
    cleaned(spark)
    one = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("row")))
    kept = keyed.join(firsts, "key", "left_semi").withColumn("one", one).filter("one = 1").select("row.*")
    return kept.unionByName(docs.filter("doc_id is null"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: documents once for each pass that takes words of them."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with digests of the ids and of the decoded bytes."""
    return bpe.digests(docs, vocabulary_path(), with_ids=True)


STAGES = [("language ID", language_id), ("toxicity", toxicity_filter), ("n-gram Jaccard join", near_duplicates), ("mixing sources", mix_sources), ("byte-level BPE", encode)]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        since = len(WRITTEN)
        docs = stored(stage(spark, docs, sf_dir), spark)
        drop_written(spark, since)
        cleaned(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
