"""op8: all documents mixed by source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shapelake.llm.mixing import mix, weighted_quotas, word_count


def mix_documents(docs: DataFrame, found: dict | None = None, **options) -> DataFrame:
    """doc_id, pattern, size and taken; ``found`` receives the patterns that the quotas were made for, ``mix`` the options."""
    quotas = weighted_quotas()

    def seen(patterns):
        if found is not None:
            found["patterns"] = patterns
        return quotas(patterns)

    return mix(docs, seen, F.array("source"), word_count("text"), **options)


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    found: dict = {}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = mix_documents(docs, found, order=("doc_id", "text"))  # rows that share an id, or have none, are in an order too
    patterns = found["patterns"]
    exact = weighted_quotas().exact(patterns)
    sources = spark.createDataFrame(
        [(s[0], n, float(exact[s[0]])) for s, n in patterns], "source string, source_size long, target double"
    )
    sources = F.broadcast(sources) if len(patterns) <= 10_000 else sources
    out = out.withColumn("source", F.get("pattern", F.lit(0)))
    joined = out.alias("o").join(sources.alias("s"), F.expr("o.source <=> s.source"))
    return joined.select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op8_mix_sources": op8_mix_sources}
ORACLE_SQL: dict[str, str] = {}
