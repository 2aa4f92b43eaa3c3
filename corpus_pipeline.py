"""From raw documents to packed sequences: five stages, each by one operator of terrane.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm.common import within, written
from terrane.llm.mixing import mix
from terrane.llm.packing import packed
from terrane.llm.pii import pseudonymised, session_key
from terrane.llm.quality import judge
from terrane.llm.simhash import one_of_each


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, each row by itself. A null or empty text goes; an empty table stays one."""
    judged, q = judge(docs)
    return judged.where(f"`{q}`.kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: five-word shingles, a similarity of 0.8 or more.

    The smallest doc_id stays (null last), of repeated rows one; null and empty texts are copies of each other."""
    return one_of_each(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms in their texts, under the session's key; n_chars follows where a text has changed.

    Null and empty texts stay as they are, repeated rows stay repeated."""
    out, found = pseudonymised(docs, session_key(spark))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(found) > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a document that it doesn't take goes.

    Null and empty texts have size 0 and are taken like others of their source; a null source is a source. Copies are
    equal rows: packing tells them apart by their places only."""
    mixed, q = mix(docs)
    (turn,) = within(mixed.columns, "turn")
    return mixed.where(f"`{q}`.copies > 0").withColumn(turn, F.explode(F.sequence(F.lit(1).cast("long"), F.col(f"{q}.copies")))).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of the documents in sequences of 4096 tokens; a null or empty text is its separator alone."""
    return packed(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("pii", pii), ("mixing", mixing), ("packing", packing)]
#: SQL has no fingerprints, Feistel rounds or tokens; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the whole table of documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs)
    return docs
