"""Secret scan: patterns, and strings that a token vocabulary can hardly shorten."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .files import ship_package

#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "random")
MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24
#: Strings of the token-efficiency test: at least this long, at most this many characters a token.
MIN_RANDOM = 20
MAX_CHARS_PER_TOKEN = 2.0
#: Letters of a word that is left off at the ends of such a string.
MIN_WORD = 3
#: Lengths of hexadecimal digests that are public by nature (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512).
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)

_ASSIGN = re.compile(
    r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
# What must stand directly before the sign of an assignment.
_KEY = re.compile(r"(?ai:password|passwd|secret|token|api_?key)[\"']?\Z")
_KEY_CHARS = len("password") + 1
_SIGN = re.compile(r"[:=]")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_RANDOM)
_UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_DIGEST = re.compile(r"[0-9a-f]+|[0-9A-F]+")
# Parts of a candidate: what stands between marks, with the marks before it; a UUID is one part.
_PART = re.compile(r"[+/_=-]*+(?:(?<![A-Za-z0-9])%s(?![A-Za-z0-9])|[A-Za-z0-9]++)|[+/_=-]++" % _UUID.pattern.replace("(-", "(?:-"))
_MARKS = "+/_=-"
_NUMBER = re.compile(r"[0-9/_=+-]+")

SCHEMA = "doc_id long, spans array<struct<kind: string, start: int, end: int>>"
_ARROW = pa.schema([
    ("doc_id", pa.int64()),
    ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))),
])


@lru_cache(maxsize=2)
def vocabulary(path: str):
    """The tiktoken encoding of a ranks file; one per worker process."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def known_string(text: str) -> bool:
    """Digests, identifiers and numbers: long, yet no secrets. Letters are left to the vocabulary."""
    return bool(
        (len(text) in DIGEST_LENGTHS and _DIGEST.fullmatch(text)) or _UUID.fullmatch(text) or _NUMBER.fullmatch(text)
    )


def uncovered(runs: list[tuple[int, int]], spans: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """What is left of runs outside of spans; runs are in order and disjoint, spans sorted by start."""
    i, done = 0, 0
    for start, end in runs:
        while i < len(spans) and spans[i][0] < end:
            s, e = spans[i]
            if s > max(start, done):
                yield max(start, done), s
            done, i = max(done, e), i + 1
        if max(start, done) < end:
            yield max(start, done), end


def heavy_runs(scores: list[float]) -> Iterator[tuple[int, int]]:
    """All maximal runs of the largest sums (Ruzzo and Tompa 1999), in linear time."""
    runs, total = [], 0.0  # start, end, sum before, sum at the end, number of the last run with a smaller sum before
    for i, score in enumerate(scores):
        before, total = total, total + score
        if score <= 0:
            continue
        start = i
        while True:
            at = len(runs) - 1
            while at >= 0 and runs[at][2] >= before:
                at = runs[at][4]
            if at < 0 or runs[at][3] >= total:
                break
            start, before = runs[at][0], runs[at][2]
            del runs[at:]
        runs.append((start, i + 1, before, total, at))
    return ((run[0], run[1]) for run in runs)


def random_spans(text: str, start: int, end: int, encoding, max_ratio: float) -> Iterator[tuple[int, int]]:
    """Spans of [start, end), a run of candidate characters, that the vocabulary can hardly shorten.

    The whole run without words at its ends, or else those parts between marks,
    alone or several in a row, that words joined to them would thin out.
    """

    def random(s: int, e: int) -> bool:
        string = text[s:e]
        return e - s >= MIN_RANDOM and not known_string(string) and e - s <= max_ratio * len(encoding.encode_ordinary(string))

    if end - start < MIN_RANDOM or known_string(text[start:end]):
        return
    parts = [m.span() for m in _PART.finditer(text, start, end)]
    if len(parts) < 2:
        if random(start, end):
            yield start, end
        return

    def core(first: int, last: int) -> tuple[int, int]:
        e = parts[last - 1][1]
        return e - len(text[parts[first][0]:e].lstrip(_MARKS)), e

    scores = []
    for s, e in parts:
        part = text[s:e].lstrip(_MARKS) or text[s:e]  # marks before a part weigh nothing
        if len(part) >= MIN_RANDOM and known_string(part):
            scores.append(-float(end - start) * max(1.0, max_ratio))  # no run goes across
        else:
            score = max_ratio * len(encoding.encode_ordinary(part)) - len(part) * (1 - 1e-9)
            scores.append(min(score, 0.0) if known_string(part) else score)
    if random(start, end):
        word = [s <= 0 and len(t := text[a:b].strip(_MARKS)) >= MIN_WORD and t.isalpha() for s, (a, b) in zip(scores, parts)]
        first = next((i for i, w in enumerate(word) if not w), 0)
        last = len(parts) - next((i for i, w in enumerate(reversed(word)) if not w), 0)
        s, e = core(first, last) if first else (start, parts[last - 1][1])
        yield (s, e) if random(s, e) else (start, end)
        return
    for first, last in heavy_runs(scores):
        if random(*(span := core(first, last))):
            yield span
        else:
            yield from (span for i in range(first, last) if random(*(span := core(i, i + 1))))


def assignments(text: str) -> Iterator[tuple[int, int]]:
    """Spans of values given to a secret's name, found from their rare sign.

    A key is followed by one sign only, so the sign leads to the one place where
    a match can start, and the order of signs is the order of matches.
    """
    done = 0
    for sign in _SIGN.finditer(text):
        at = sign.start()
        if at < done:
            continue
        end = at
        while end > done and text[end - 1] == " ":
            end -= 1
        key = _KEY.search(text, max(done, end - _KEY_CHARS), end)
        if key and (found := _ASSIGN.match(text, key.start())):
            done = found.end()
            if found.end(2) - found.start(2) >= MIN_VALUE:
                yield found.span()


def find_spans(text: str | None, ranks_path: str, max_ratio: float = MAX_CHARS_PER_TOKEN) -> list[tuple[int, int, str]]:
    """All spans of a text in code points, by start, then kind.

    Pattern spans are leftmost and do not overlap within a kind. Strings of kind
    ``random`` overlap no pattern span: at least ``MIN_RANDOM`` characters, not a
    known digest, identifier or number, and at most ``max_ratio`` characters a token.
    They are what pattern spans leave of a run of candidate characters, or parts of
    that between marks.
    """
    if not text:
        return []
    spans = [(s, e, 0) for s, e in assignments(text)]
    at, candidates = 0, []
    for word in text.split():
        if len(word) < MIN_ACCESS:
            continue
        at = text.find(word, at)
        spans += [(at + m.start(), at + m.end(), 1) for m in _ACCESS.finditer(word) if m.end() - m.start() >= MIN_ACCESS]
        spans += [(at + m.start(), at + m.end(), 2) for m in _HEX.finditer(word) if m.end() - m.start() >= MIN_HEX]
        candidates += [(at + m.start(), at + m.end()) for m in _CANDIDATE.finditer(word)]
        at += len(word)
    for start, end in uncovered(candidates, sorted((s, e) for s, e, _ in spans)):
        spans += [(*found, 3) for found in random_spans(text, start, end, vocabulary(ranks_path), max_ratio)]
    spans.sort(key=lambda x: (x[0], x[2]))
    return [(s, e, KINDS[k]) for s, e, k in spans]


def scan(
    docs: DataFrame, ranks_path: str, max_ratio: float = MAX_CHARS_PER_TOKEN, id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per input row: its id and its spans (kind, start, end; code points, end exclusive).

    Row by row, without a shuffle. Null and empty texts have no spans, null ids
    stay null, repeated rows are answered each, other columns are ignored.
    """
    ship_package(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                [{"kind": k, "start": s, "end": e} for s, e, k in find_spans(text.as_py(), ranks_path, max_ratio)]
                for text in batch.column(1)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _ARROW.field(1).type)], schema=_ARROW)

    return docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text")).mapInArrow(work, SCHEMA)


def span_texts(spans):
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame, base_kinds: tuple[str, ...]) -> DataFrame:
    """Counts of the pattern kinds, the hash of their spans and all spans as one string."""
    base = F.filter("spans", lambda s: s["kind"].isin(*base_kinds))
    # A lambda may have no second parameter: that would be the position.
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(kind).alias(f"n_{kind}") for kind in base_kinds]
    return found.select(
        "doc_id", *counts, F.sha2(span_texts(base).cast("binary"), 256).alias("base_sha256"),
        span_texts(F.col("spans")).alias("spans"),
    )
