"""op13 against a character-wise alignment with the vocabulary's own file and library."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from shapelake.llm import token_alignment as ta
from shapelake.llm.q_alignment import op13_token_alignment, tokenizers

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plain():
    """Ids and byte strings of both tokenizers for a text, without the operator's code."""
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    # Byte-level entries: printable bytes stand for themselves, the others for characters from 256 on, in order.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of_char = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in shown)}

    def encode(text):
        one = a.encode(" " + text, add_special_tokens=False)
        two = b.encode(text)
        piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
        return list(zip(one.ids, (bytes(of_char[c] for c in t) for t in one.tokens), strict=True)), [(i, piece(i)) for i in two]

    return encode


def brute(rows, encode):
    """The rows of op13 by their definition."""
    found = []
    for doc, text in rows:
        a, b = encode(text) if text else ([], [])
        whole = b" " + (text or "").encode()
        if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            a, b = [], []
        ends = [{}, {}]
        for side, tokens in zip(ends, (a, b), strict=True):
            at = 0
            for i, part in tokens:
                at += len(part)
                side[at] = i
        cuts = sorted(set(ends[0]) & set(ends[1]))
        parts = [[[str(i) for e, i in side.items() if s < e <= c] for side in ends] for s, c in zip([0, *cuts], cuts, strict=False)]
        text_out = ";".join("|".join(",".join(x) for x in p) for p in parts)
        links = [(ends[0][c], ends[1][c]) for c in cuts]
        overlaps = sum(len(x) + len(y) - 1 for x, y in parts)
        found.append((doc, len(a), len(b), len(cuts), links, text_out, overlaps))
    counts = Counter(x for f in found for x in f[4])
    top = defaultdict(int)
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    return [
        (d, na, nb, g, len(ls), sum(counts[x] == top[x[1]] for x in ls), sum(counts[x] for x in ls), hashlib.sha256(t.encode()).hexdigest() if na else "", o)
        for d, na, nb, g, ls, t, o in found
    ]


def key(rows):
    return sorted(map(str, (tuple(r) for r in rows)))


def test_query_equals_brute_force(spark, plain):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    got = op13_token_alignment(spark, DATA)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps"]
    assert key(got.collect()) == key(brute(rows, plain))


ODD = [
    (1, None), (2, ""), (None, " "), (3, "x"), (3, "x"), (4, "two  spaces\n\n\ttab \r\n"), (5, "<|endoftext|> and <s> and <0x41>"),
    (6, "a ▁ sign"), (7, "emoji 😀👩‍👩‍👧 and ünïcödé é ﬁ ½ Ⅻ 　wide"), (8, "nul\x00inside"), (9, "no" * 4000), (10, "1234567890" * 30),
    (None, "some words with no id"),
]


@pytest.mark.parametrize("hot", [1, 3, 65_536])
def test_odd_texts_at_any_split_of_pairs(spark, plain, hot):
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in ODD], "doc_id long, text string, links int, n_best int").repartition(3)
    got = ta.align_tokenizers(docs, *tokenizers(), digest=True, hot_pairs=hot)
    got = got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups", "n_overlaps")
    assert key(got.collect()) == key(brute(ODD, plain))
    assert ta.align_tokenizers(docs.limit(0), *tokenizers()).count() == 0


def test_groups_as_text(spark):
    docs = spark.createDataFrame([(1, "an unaligned pair of words")], "doc_id long, text string")
    row = ta.align_tokenizers(docs, *tokenizers()).first()
    groups = [[[int(i) for i in side.split(",")] for side in g.split("|")] for g in row.groups.split(";")]
    parts = [x.load()[1] for x in tokenizers()]
    cut = [[b"".join(p[i] for i in side) for p, side in zip(parts, g, strict=True)] for g in groups]
    assert all(x == y for x, y in cut) and b"".join(x for x, _ in cut) == b" an unaligned pair of words"
