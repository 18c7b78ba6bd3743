"""Line-first cleaning: judge lines, remove those that fail, then judge what is left of the document.

Everything is a DataFrame expression over one row at a time: there is no
shuffle, so a hot source or a very long text costs what its length costs.

Defined results: a null text counts as empty; an empty text has no words and
is not kept; nulls in other columns and extra columns pass through untouched, but
a column named as one that is added here is replaced by it;
repeated rows are judged independently; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
#: Phrases that only page furniture holds, in lower case.
BOILERPLATE = (
    "all rights reserved",
    "licensed under",
    "terms of use",
    "terms of service",
    "privacy policy",
    "cookie policy",
    "copyright (c)",
    "subscribe to our",
    "enable javascript",
    "powered by",
)
#: What stands between the entries of a menu or a breadcrumb trail.
SEPARATORS = (" | ", " > ", " » ", " • ", " · ")
#: Prose of some length has at least one of these.
SENTENCE_MARK = r"[.!?…:;。]"


@dataclass(frozen=True)
class LineRules:
    """Thresholds; a line's pieces are what its spaces part."""

    min_words: int = 50  # of a document
    max_repeat_share: float = 0.5  # of a document's words, in 3-word windows found more than once
    max_lost_share: float = 0.5  # of a document's words, in lines removed
    min_unmarked_pieces: int = 25  # a line of so many pieces must hold a sentence mark
    max_symbol_share: float = 0.3  # symbol characters to pieces
    max_shout_share: float = 0.5  # exclamation marks to pieces
    max_separator_share: float = 0.2  # separators to pieces


def _found(text: Column, literal: str) -> Column:
    """How often a short literal occurs."""
    return (F.length(text) - F.length(F.replace(text, F.lit(literal), F.lit("")))) / len(literal)


def _unmarked(line: Column, pieces: Column, rules: LineRules) -> Column:
    return (pieces >= rules.min_unmarked_pieces) & ~line.rlike(SENTENCE_MARK)


def line_fails(line: Column, pieces: Column, rules: LineRules = LineRules()) -> Column:
    """True where a line with words breaks a punctuation, navigation or boilerplate rule."""
    low = F.lower(line)
    furniture = reduce(or_, (low.contains(x) for x in BOILERPLATE))
    separators = reduce(add, (_found(line, x) for x in SEPARATORS))
    return (
        (_found(line, "!") > rules.max_shout_share * pieces)
        | (F.regexp_count(line, F.lit(SYMBOL)) > rules.max_symbol_share * pieces)
        | (separators > rules.max_separator_share * pieces)
        | _unmarked(line, pieces, rules)
        | furniture
    )


def _may_fail(body: Column) -> Column:
    """False for texts in which only the sentence mark rule can find anything; most texts are such."""
    low = F.lower(body)
    return body.rlike("[!#*$%&<|>»•·]") | reduce(or_, (low.contains(x) for x in BOILERPLATE))


def _free_prefix(docs: DataFrame) -> str:
    """With which no column's name begins."""
    prefix = "_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    return prefix


def word_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (all long) over whole texts.

    A window's identity is a 64-bit hash of its three words; windows are
    compared within one text only.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    own = _free_prefix(docs)  # the columns that only this function sees
    words = F.filter(F.split(body, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(WORD))
    df = docs.withColumns({f"{own}words": words, f"{own}lines": lines})
    df = df.withColumns(
        {
            "n_words": F.size(f"{own}words").cast("long"),
            "word_chars": F.length(F.array_join(f"{own}words", "")).cast("long"),
            "n_symbols": F.regexp_count(body, F.lit(SYMBOL)).cast("long"),
            "n_dup_lines": (F.size(f"{own}lines") - F.size(F.array_distinct(f"{own}lines"))).cast("long"),
            f"{own}keys": F.when(
                F.size(f"{own}words") >= 3,
                F.transform(
                    F.sequence(F.lit(0), F.size(f"{own}words") - 3),
                    lambda i: F.xxhash64(
                        F.get(f"{own}words", i), F.get(f"{own}words", i + 1), F.get(f"{own}words", i + 2)
                    ),
                ),
            ).otherwise(F.array().cast("array<bigint>")),
        }
    ).drop(f"{own}words", f"{own}lines")
    # Most texts repeat no window: a sort of plain longs tells so; only the others sort keys with positions.
    df = df.withColumn(f"{own}repeats", F.size(f"{own}keys") > F.size(F.array_distinct(f"{own}keys")))
    at = F.transform(f"{own}keys", lambda k, i: F.struct(k.alias("k"), i.alias("i")))
    df = df.withColumn(f"{own}at", F.when(F.col(f"{own}repeats"), F.sort_array(at))).drop(f"{own}keys")
    same = lambda x, j: F.coalesce(F.get(f"{own}at", j)["k"] == x["k"], F.lit(False))
    starts = F.transform(F.filter(f"{own}at", lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"])
    df = df.withColumn(f"{own}starts", F.sort_array(starts)).drop(f"{own}at")
    reach = F.transform(f"{own}starts", lambda p, j: F.least(F.coalesce(F.get(f"{own}starts", j + 1) - p, F.lit(3)), F.lit(3)))
    total = F.aggregate(reach, F.lit(0).cast("long"), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", F.when(F.col(f"{own}repeats"), total).otherwise(F.lit(0).cast("long"))).drop(
        f"{own}starts", f"{own}repeats"
    )


def clean_lines(docs: DataFrame, rules: LineRules = LineRules(), text: str = "text") -> DataFrame:
    """Adds the statistics, base_failed, n_lost_words, clean_text and kept.

    ``clean_text`` is the text without its failing lines; blank lines stay.
    A document is kept if it passes the base rules and its failing lines hold
    at most ``max_lost_share`` of its words.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.transform(F.split(body, "\n"), lambda x: F.struct(x.alias("line"), (_found(x, " ") + 1).alias("pieces")))
    # The choice of rules stands outside the lambda, so that it is made once a text and not once a line.
    clean = lambda fails: F.filter(lines, lambda x: ~(fails(x["line"], x["pieces"], rules) & x["line"].rlike(WORD)))
    df = word_statistics(docs, text)
    clean = F.when(_may_fail(body), clean(line_fails)).otherwise(clean(_unmarked))
    df = df.withColumn("clean_text", F.array_join(F.transform(clean, lambda x: x["line"]), "\n"))
    lost = F.when(F.col("clean_text") == body, 0).otherwise(F.col("n_words") - F.regexp_count("clean_text", F.lit(WORD)))
    df = df.withColumn("n_lost_words", lost.cast("long"))
    failed = (F.col("n_words") < rules.min_words) | (
        F.col("n_repeat_words") > rules.max_repeat_share * F.col("n_words")
    )
    df = df.withColumn("base_failed", failed)
    return df.withColumn(
        "kept", ~F.col("base_failed") & (F.col("n_lost_words") <= rules.max_lost_share * F.col("n_words"))
    )
