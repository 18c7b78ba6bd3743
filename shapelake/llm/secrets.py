"""Secret scans: three fixed patterns, and character Markov models of random strings and ordinary identifiers.

Two first-order character models, one of each kind, are trained from labelled
samples: of the corpus, what the fixed patterns find is random and every other
long token is ordinary; a seeded set adds random strings of common alphabets
and ordinary dates, numbers, versions, paths and names, which a corpus may lack.
A token is a secret if its log-likelihood ratio is high in all and for each
character; nothing else is asked of it. A fifth of the samples, by hash of the
string, is held out: it sets the bound for each character, and precision and
recall are measured on it. Scanning is a pass over the rows with no shuffle.

Defined results: a null or empty text has no spans; ids go through untouched,
null ones included; a text of any length is scanned whole; repeated rows are
scanned alike; an empty table gives no rows; extra columns, whatever their
names, are left out of the result.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
#: Runs that are maximal by nature: asking for the least length finds what dropping short matches would leave.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Parts of the ordinary names of the seeded samples.
NAME_PARTS = (
    "get", "set", "user", "name", "list", "item", "file", "path", "data", "table", "index", "value", "config", "server", "client",
    "request", "response", "handler", "test", "main", "src", "lib", "util", "page", "image", "version", "update", "report", "http",
    "json", "order", "count", "total", "base", "url", "event", "log", "time", "key", "type", "model", "layer", "node", "group",
)
HOLD_OUT = 5  # one string in so many, by hash
BINS = 20  # of a score for each character, to one
KEYWORD_PARTS = ("passw", "secret", "token", "api")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
INDEX = {c: i for i, c in enumerate(ALPHABET)}


def _byte_table(chars: str) -> bytes:
    inside = set(chars.encode())
    return bytes(1 if i in inside else 0 for i in range(256))


_HEX_TABLE, _TOKEN_TABLE = _byte_table("0123456789abcdef"), _byte_table(ALPHABET)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, sorted; kind is an index of KINDS."""
    spans = []
    low = text.lower()
    if any(k in low for k in KEYWORD_PARTS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    if b"\x01" * 24 in text.encode().translate(_HEX_TABLE):
        spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def tokens(text: str, least: int) -> Iterator[tuple[int, int]]:
    """Spans of maximal runs of the alphabet with at least so many characters."""
    if b"\x01" * least in text.encode().translate(_TOKEN_TABLE):
        for m in re.finditer(rf"[A-Za-z0-9+/_=-]{{{least},}}", text):
            yield m.start(), m.end()


def labelled_strings(text: str, least: int) -> Iterator[tuple[str, int]]:
    """Strings with 1 where a fixed pattern finds them, and all other long tokens with 0."""
    spans = base_spans(text)
    for start, kind, end in spans:
        yield (ASSIGN.match(text, start)[2] if kind == 0 else text[start:end]), 1
    for start, end in tokens(text, least):
        if not any(s < end and start < e for s, _, e in spans):
            yield text[start:end], 0


def seeded_samples(n: int = 2000, seed: int = 23) -> list[tuple[str, int]]:
    """n random strings and n ordinary ones, whatever the corpus holds."""
    r, out = random.Random(seed), []
    digits, lower = "0123456789", "abcdefghijklmnopqrstuvwxyz"
    alphabets = (lower + lower.upper() + digits, lower + digits, lower.upper() + digits, digits + "abcdef", ALPHABET[:64], ALPHABET[:62] + "_-")
    number = lambda k: "".join(r.choice(digits) for _ in range(k))
    date = lambda: f"{r.randrange(1970, 2040)}-{r.randrange(1, 13):02}-{r.randrange(1, 29):02}"
    name = lambda k: [r.choice(NAME_PARTS) for _ in range(k)]
    for _ in range(n):
        out.append(("".join(r.choices(r.choice(alphabets), k=r.randrange(16, 49))), 1))
        parts = name(r.randrange(2, 6))
        if r.random() < 0.5:
            parts[-1] += r.choice(("", "_", "-", "v")) + number(r.randrange(1, 4))
        form = r.randrange(8)
        out.append(
            (
                ("_".join(parts), "-".join(parts), "/".join(parts), "".join(x.title() for x in parts), "_".join(parts).upper(),
                 date() + r.choice(("T", "_", "-")) + "-".join(f"{r.randrange(60):02}" for _ in range(3)) + r.choice(("", "Z")),
                 number(r.randrange(8, 21)), "-".join(number(r.randrange(1, 5)) for _ in range(r.randrange(3, 6))))[form],
                0,
            )
        )
    return out


def held_out(s: str) -> bool:
    return zlib.crc32(s.encode()) % HOLD_OUT == 0


def _pairs_of(s: str) -> Iterator[tuple[int, int]]:
    at = len(ALPHABET)
    for c in s:
        if (i := INDEX.get(c)) is not None:
            yield at, i
            at = i


class MarkovPair:
    """Log-likelihood ratio of two first-order models; holds one number for each pair of characters.

    A character that hardly ever follows another is as likely as it is by
    itself: ``backoff`` counts how often such a guess is worth.
    """

    def __init__(self, counts: dict[tuple[int, int, int], int], backoff: float = 5.0):
        n = len(ALPHABET)
        table = np.zeros((2, n + 1, n))  # row n: the first character
        for (kind, a, b), c in counts.items():
            table[kind, a, b] += c
        alone = table.sum(axis=1) + 0.5
        alone = alone / alone.sum(axis=1, keepdims=True)
        logs = np.log((table + backoff * alone[:, None, :]) / (table.sum(axis=2, keepdims=True) + backoff))
        self.ratio = (logs[1] - logs[0]).tolist()

    def score(self, s: str) -> float:
        return sum(self.ratio[a][b] for a, b in _pairs_of(s))


@dataclass(frozen=True)
class Scorer:
    """The models, the bounds of a secret's ratio, and what the bounds gave on the samples held out."""

    model: MarkovPair
    least_total: float
    least_mean: float
    precision: float
    recall: float

    def is_secret(self, token: str) -> float | None:
        """The token's ratio if it reaches both bounds."""
        score = self.model.score(token)
        return score if score >= self.least_total and score >= self.least_mean * len(token) else None


def _bin(score: float, s: str) -> int:
    return int(np.floor(BINS * score / max(len(s), 1)))


def train(
    docs: DataFrame, max_training_docs: int = 20_000, least: int = 8, least_candidate: int = 16, least_total: float = 9.2,
    least_precision: float = 0.995, id_column: str = "doc_id", text_column: str = "text",
) -> Scorer:
    """Models of labelled strings over about ``max_training_docs`` documents, drawn by hash of id and text.

    ``least_total`` is the log of prior odds of one secret in ten thousand
    tokens. The bound for each character is the lowest at which
    ``least_precision`` of what is found among as many secrets as ordinary
    tokens, held out and of ``least_candidate`` characters at least, is secret.
    The counts come to the driver: at most one for each kind and pair of the
    alphabet's characters, then one for each kind and step of the score.
    """
    every = max(1, -(-docs.count() // max_training_docs))
    texts = docs.select(docs[id_column].cast("long").alias("id"), docs[text_column].cast("string").alias("t"))
    sample = texts.where(F.expr(f"pmod(xxhash64(id, t), {every}) = 0")).select("t") if every > 1 else texts.select("t")
    seeded = seeded_samples()

    def tally(found: Counter, names: list[str]) -> pa.RecordBatch:
        columns = list(zip(*[(*k, n) for k, n in found.items()], strict=True)) or [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for text in batch.column(0).to_pylist():
                for s, kind in labelled_strings(text or "", least):
                    if not held_out(s):
                        found.update((kind, a, b) for a, b in _pairs_of(s))
            yield tally(found, ["kind", "a", "b", "n"])

    rows = sample.mapInArrow(count, "kind long, a long, b long, n long").groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).collect()
    counts = Counter({(r.kind, r.a, r.b): r.n for r in rows})
    for s, kind in seeded:
        if not held_out(s):
            counts.update((kind, a, b) for a, b in _pairs_of(s))
    model = MarkovPair(counts)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for text in batch.column(0).to_pylist():
                for s, kind in labelled_strings(text or "", least_candidate):
                    if held_out(s) and len(s) >= least_candidate:
                        total = model.score(s)
                        found[kind, _bin(total, s), int(total >= least_total)] += 1
            yield tally(found, ["kind", "bin", "sure", "n"])

    rows = sample.mapInArrow(score, "kind long, bin long, sure long, n long").groupBy("kind", "bin", "sure").agg(F.sum("n").alias("n")).collect()
    tested = Counter({(r.kind, r.bin, r.sure): r.n for r in rows})
    for s, kind in seeded:
        if held_out(s) and len(s) >= least_candidate:
            total = model.score(s)
            tested[kind, _bin(total, s), int(total >= least_total)] += 1
    every_kind = [sum(n for (k, _, _), n in tested.items() if k == kind) for kind in (0, 1)]
    for least_bin in range(0, 4 * BINS):
        hit = [sum(n for (k, b, sure), n in tested.items() if k == kind and sure and b >= least_bin) / max(every_kind[kind], 1) for kind in (0, 1)]
        precision = hit[1] / max(sum(hit), 1e-12)
        if precision >= least_precision:
            break
    return Scorer(model, least_total, least_bin / BINS, precision, hit[1])


def scan(
    docs: DataFrame, scorer: Scorer | None, least: int = 16, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row for each document: doc_id and spans, an array of (kind, start, end, score) by start, then kind.

    Positions are code points, the end exclusive. A token of at least
    ``least`` characters outside the fixed patterns' spans is of kind
    ``markov`` if the scorer takes it for a secret.
    """
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                base = base_spans(text)
                spans = [(s, k, e, None) for s, k, e in base]
                for start, end in tokens(text, least) if scorer else ():
                    if not any(s < end and start < e for s, _, e in base):
                        score = scorer.is_secret(text[start:end])
                        if score is not None:
                            spans.append((start, 3, end, score))
                out.append([{"kind": KINDS[k], "start": s, "end": e, "score": p} for s, k, e, p in sorted(spans, key=lambda x: x[:3])])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, type=pa.list_(span))], ["doc_id", "spans"])

    schema = "doc_id long, spans array<struct<kind:string,start:long,end:long,score:double>>"
    return docs.select(docs[id_column].cast("long"), docs[text_column].cast("string")).mapInArrow(run, schema)
