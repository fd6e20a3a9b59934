"""A training-data pipeline of five stages over `documents`, each the next one's input.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. An empty
table gives an empty result in every stage, further columns are left out, and texts of any length are worked on whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keysieve.llm import byte_bpe, line_dedup, mixing, simhash, toxicity
from keysieve.llm.common import cut, documents

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.7 or more go. Null and empty texts score as texts without a term, and stay; repeated rows are each judged."""
    scored = toxicity.score(spark, docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.where("score < 0.7").select(COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that recur in five documents or more go but for one; n_chars follows the text. Every document stays; a null text becomes the empty one, and a row without doc_id keeps all its lines."""
    return line_dedup.line_dedup(spark, [docs.select(COLUMNS)]).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id stays (a null one last); of several with that doc_id, one. Texts without words are one group."""
    return simhash.one_of_each(spark, docs.select(COLUMNS)).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, the one at a source's budget edge as a whole. Wordless ones stay once. A null source is a source, a null doc_id draws one fixed key."""
    mixed = mixing.mix(spark, docs.select(COLUMNS))
    copies = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(1).cast("int")
    return mixed.where(copies > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), copies))).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of each row: doc_id, n_tokens and digests of its ids and of the text decoded again. A null text is the empty one; repeated rows give a row each."""
    return byte_bpe.encode_documents(spark, docs.select(COLUMNS))


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_lines), ("near-duplicates", drop_near_copies), ("mixing", mix_sources), ("byte BPE", encode)]

#: The toxicity, SimHash and BPE stages can't be expressed in SQL; the run is tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
