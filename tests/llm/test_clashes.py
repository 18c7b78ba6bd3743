"""Columns whose names an operator might use itself go through untouched, or do not matter."""

import pytest
from pyspark.sql import functions as F

from shapelake.llm import chosen_path, line_quality, packing, q_mixing, substrings
from shapelake.llm.q_packing import pack_documents

SHARED = " ".join(f"word{k}" for k in range(60)) + "."
TEXTS = [SHARED, f"One more. {SHARED}", "# # # | |\n" + SHARED, "", None, "again and again and again and again.", SHARED]
PLAIN = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"s{i % 2}") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, PLAIN)


def clashing(df, *names):
    return df.withColumns({n: F.concat(F.lit(f"{n}-"), F.col("doc_id").cast("string")) for n in names})


def rows(df, *columns):
    return sorted(map(str, df.select(*columns).collect()))


def test_line_quality_keeps_what_it_is_given(docs):
    names = ["_words", "_lines", "_keys", "_at", "_starts", "_repeats", "__words", "words", "line", "pieces"]
    got = line_quality.clean_lines(clashing(docs, *names))
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "clean_text", "n_lost_words", "base_failed", "kept"]
    assert got.columns == [*docs.columns, *names, *added]
    assert rows(got, *docs.columns, *names) == rows(clashing(docs, *names), *docs.columns, *names)
    assert rows(got, "doc_id", *added) == rows(line_quality.clean_lines(docs), "doc_id", *added)


def test_near_documents(docs):
    p = chosen_path.JoinParameters(shingle=2)
    got = chosen_path.near_duplicates(clashing(docs, "id", "row", "tokens", "component_id", "kept", "h"), p)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, chosen_path.near_duplicates(docs, p).collect()))


def test_substrings(docs):
    got = substrings.repeated_spans(clashing(docs, "start", "end", "digest", "h", "removable", "pos"))
    want = substrings.repeated_spans(docs)
    assert rows(got, *want.columns) == rows(want, *want.columns) and want.count()


def test_packing(docs):
    got, want = (pack_documents(d.coalesce(1)) for d in (clashing(docs, "start", "length", "cost", "offset"), docs))
    assert rows(got, *want.columns) == rows(want, *want.columns) and packing.SCHEMA.startswith("doc_id")


def test_mixing_of_rows_without_ids(spark):
    words = lambda k: " ".join(f"w{k}x{j}" for j in range(k % 7 + 1))
    given = [(None, words(k), f"s{k % 3}", k, k) for k in range(600)]
    df = spark.createDataFrame(given, f"{PLAIN}, size int, taken int")
    got = q_mixing.mix_documents(df, order=("doc_id", "text"), bucket_rows=50)
    total = sum(len(t.split()) for _, t, *_ in given)
    found = got.collect()
    assert len(found) == 600 and abs(sum(r.taken for r in found) - 1.5 * total) < 30
    assert all(r.taken in (0, r.size, 2 * r.size) for r in found)
