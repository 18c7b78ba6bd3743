"""Corpus preparation in five stages, each written as Parquet and read again as the next one's documents.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents. Nulls, empty texts, repeated rows, empty
tables and extra columns are handled as the operators' docstrings say; columns
beyond those of documents are dropped by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shapelake.llm.chosen_path import JoinParameters, near_duplicates
from shapelake.llm.fuzzy_lines import without_fuzzy_lines
from shapelake.llm.line_quality import WORD, clean_lines
from shapelake.llm.q_mixing import mix_documents
from shapelake.llm.q_packing import pack_documents
from shapelake.plans.rounds import result_only, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _with_text(docs: DataFrame) -> DataFrame:
    """The columns of documents, with the length of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def _with_row(docs: DataFrame) -> DataFrame:
    """The documents with a key of each row, written so that it stays the same: ids can be null or repeated."""
    return written(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("_row")))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the line-first rules reject; the others go on with their clean text."""
    # Written, the judgement is made once; a filter on it would repeat its expressions.
    judged = written(clean_lines(docs.select(*COLUMNS)).select("doc_id", "lang", "source", "clean_text", "kept"))
    return _with_text(judged.where("kept").withColumnRenamed("clean_text", "text"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated lines; a document that loses all its words this way goes."""
    left = without_fuzzy_lines(docs.select(*COLUMNS))
    return _with_text(left.where(F.col("removed").isNull() | F.col("text").rlike(WORD)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, on 5-word shingles."""
    docs = _with_row(docs)
    alone = docs.where("doc_id is null")  # each of these stands alone and stays
    named = docs.where("doc_id is not null")

    def kept() -> DataFrame:
        found = near_duplicates(named, JoinParameters(), id_column="_row").select(F.col("doc_id").alias("_row"), "component_id")
        # Of each group the row with the smallest doc_id stays; rows that share an id but not the text are two documents.
        own = named.select("_row", F.struct("doc_id", F.xxhash64("text").alias("h"), "_row").alias("own"))
        return found.join(own, "_row").groupBy("component_id").agg(F.min("own").alias("own")).select("own._row")

    stay = result_only(kept)
    return named.join(stay, "_row", "left_semi").select(*COLUMNS).unionAll(alone.select(*COLUMNS))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    docs = _with_row(docs)
    taken = mix_documents(docs, order=("doc_id", "text"), carry=("_row",))
    taken = taken.select("_row", F.when(F.col("size") > 0, (F.col("taken") / F.col("size")).cast("int")).otherwise(0).alias("uses"))
    uses = docs.join(taken.where("uses > 0"), "_row")
    return uses.withColumn("use", F.explode(F.sequence(F.lit(1), "uses"))).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    return pack_documents(docs)


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: The hashes of three stages and the tokenizer are outside SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
