"""op10: every page url judged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shapelake.llm.url_filter import Rule, judge

RULES = [
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
]
#: Pages that are read for their labels, at most about so many, drawn by hash of the url.
MAX_LABEL_PAGES = 40_000


def labelled_pages(pages: DataFrame, max_pages: int = MAX_LABEL_PAGES, junk_share: float = 0.02) -> DataFrame:
    """url and label of a bounded sample of pages: 1 where symbols are more than ``junk_share`` of the page's visible text."""
    every = max(1, -(-pages.count() // max_pages))
    sample = pages.where("html is not null")
    if every > 1:
        sample = sample.where(F.expr(f"pmod(xxhash64(29, url), {every}) = 0"))
    seen = F.regexp_replace("html", r"(?s)<(script|style)[^>]*>.*?</\1>|<[^>]*>|&[a-z]+;", " ")
    junk = F.regexp_count(seen, F.lit(r"[#*$%|]")) > junk_share * F.length(seen)
    return sample.select("url", junk.cast("double").alias("label"))


def op10_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    judged = judge(pages.select("page_id", "url"), RULES, labels=labelled_pages(pages.select("url", "html")))
    return judged.select("page_id", "host", "path", "rule", "verdict", "p_block")


QUERIES = {"op10_url_trees": op10_url_trees}
ORACLE_SQL: dict[str, str] = {}
