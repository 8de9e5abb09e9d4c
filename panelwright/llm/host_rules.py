"""Quality rules: failures of documents added up by host, host verdicts joined back."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import stage
from .files import ship_package
from .groups import join_groups

#: Words of a window whose repetition counts.
WINDOW = 8
#: Base rules of a document.
MIN_WORDS, REPEAT_PERCENT = 20, 30
#: A host is rejected above this shrunk share of documents that fail a base rule or a rule below.
HOST_LIMIT = 0.5
#: A document that fails a rule below is rejected where more than this shrunk share of its host fails it too.
SUSPECT_LIMIT = 0.25
#: Weight of the prior, in documents, where the hosts cannot tell it (a single host).
LONE_PRIOR = 10.0

_SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\x0b\x0c\r"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

BASE_FAILED = f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words"

#: Rules that only a host's record makes binding; false for texts without words.
RULES = {
    "word_length": "word_chars < 3 * n_words OR word_chars > 10 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "10 * n_dup_lines > 3 * n_lines",
}


def host_of(column: Column) -> Column:
    """The host of a URL in lower case; what is no URL is a host's name itself. Null and empty have no host."""
    url = F.regexp_extract(column, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    named = F.lower(F.when(url != "", url).otherwise(F.trim(column)))
    return F.when(named != "", named)


def repeated_words(ids: np.ndarray, width: int = WINDOW) -> int:
    """Words in windows of ``width`` words that the text holds twice or more.

    Windows are ranked by doubling: those of 2 words by two ranks of words, those of
    4 by two ranks of 2 and so on, so equality is exact.
    """
    if len(ids) <= width:
        return 0
    rank, length = ids, 1
    while length < width:
        step = min(length, width - length)
        pairs = rank[: len(rank) - step] * np.int64(len(ids) + 1) + rank[step:]
        rank, length = np.unique(pairs, return_inverse=True)[1], length + step
        if rank.max() == len(rank) - 1:  # all differ, so longer ones do
            return 0
    starts = np.flatnonzero(np.bincount(rank)[rank] > 1)
    edge = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return int((np.cumsum(edge) > 0).sum())


def text_counts(text: str | None) -> tuple[int, ...]:
    """The ``COUNTS`` of one text."""
    if not text:
        return (0,) * len(COUNTS)
    data, known = text.encode(), {}
    words = data.split()
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))
    lines = [line for line in data.split(b"\n") if line.strip()]
    symbols, spaces = (sum(data.count(bytes([c])) for c in chars) for chars in (_SYMBOLS, _SPACE))
    return len(words), len(text) - spaces, symbols, len(lines), len(lines) - len(set(lines)), repeated_words(ids)


def with_counts(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, which becomes the ``COUNTS``."""
    kept = [c for c in docs.columns if c != text_column]
    at = docs.columns.index(text_column)
    places = [i for i in range(len(docs.columns)) if i != at]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([text_counts(t.as_py()) for t in batch.column(at)], dtype=np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in places), *(pa.array(c) for c in found.T)], names=[*kept, *COUNTS]
            )

    schema = docs.select(*kept).schema
    for name in COUNTS:
        schema = schema.add(name, "long")
    return docs.mapInArrow(work, schema)


def beta_prior(sums: Mapping[str, float]) -> tuple[float, float]:
    """(a, b) of the beta distribution of the hosts' failure rates, by moments.

    ``sums`` over the hosts: m their number, n documents, k failures, nn the squares
    of the documents, kkn of squared failures over documents. The correlation within
    hosts follows from the spread of the rates beyond what drawing alone gives; where
    it gives none, all hosts get the mean rate.
    """
    m, n, k = sums["m"] or 0, sums["n"] or 0, sums["k"] or 0
    if not n:
        return 1.0, 1.0
    p = k / n
    rest = n - sums["nn"] / n - (m - 1)
    if m < 2 or k in (0, n) or rest <= 0:
        strength = LONE_PRIOR
    else:
        drawn = p * (1 - p) * (m - 1)
        spread = (sums["kkn"] - k * k / n - drawn) / (p * (1 - p) * rest)
        strength = 1 / min(max(spread, 1e-9), 1.0) - 1
    # A prior of at least one failure and one success in a billion keeps both above 0.
    return max(strength * p, 1e-9), max(strength * (1 - p), 1e-9)


def host_verdicts(counted: DataFrame, host_limit: float = HOST_LIMIT) -> DataFrame:
    """One row per host: ``host, n_docs``, and for every rule and for ``any`` the failures and the
    shrunk rate, with the verdict ``host_rejected``.

    ``counted`` has ``host`` and the ``COUNTS``. The documents of a host are added up
    within tasks first, so a host with a third of the rows is no hot key. One row of
    sums over all hosts gives the priors.
    """
    failed = {**RULES, "any": " OR ".join([BASE_FAILED, *RULES.values()])}
    hosts = stage(
        counted.where("host is not null").groupBy("host").agg(
            F.count(F.lit(1)).alias("n_docs"), *[F.count_if(F.expr(c)).alias(f"{r}_failed") for r, c in failed.items()]
        ),
        "hosts",
    )
    n = F.col("n_docs").cast("double")
    of_rule = lambda r: F.struct(
        F.count(F.lit(1)).alias("m"), F.sum(n).alias("n"), F.sum(F.col(f"{r}_failed").cast("double")).alias("k"),
        F.sum(n * n).alias("nn"), F.sum(F.col(f"{r}_failed") * F.col(f"{r}_failed") / n).alias("kkn"),
    ).alias(r)
    sums = hosts.agg(*[of_rule(r) for r in failed]).first()
    for r in failed:
        a, b = beta_prior(sums[r].asDict())
        hosts = hosts.withColumn(f"{r}_rate", (F.col(f"{r}_failed") + a) / (F.col("n_docs") + a + b))
    return hosts.withColumn("host_rejected", F.col("any_rate") > host_limit)


def judged(
    docs: DataFrame, host_column: str = "source", text_column: str = "text", id_column: str = "doc_id",
    host_limit: float = HOST_LIMIT, suspect_limit: float = SUSPECT_LIMIT,
) -> DataFrame:
    """One row per input row: doc_id, host, the ``COUNTS``, base_failed, failed_rules, host_rejected, kept.

    A document is rejected if it fails a base rule, if its host is rejected, or if it
    fails a rule of ``RULES`` that its host fails often. Null and empty texts have no
    words and fail. Documents without a host are judged by the base rules alone.
    Repeated rows are judged and counted each. An empty table gives no row; other
    columns are ignored, whatever their names.
    """
    ship_package(docs.sparkSession)
    table = docs.select(
        docs[id_column].cast("long").alias("doc_id"), host_of(docs[host_column].cast("string")).alias("host"),
        docs[text_column].alias("text"),
    )
    counted = stage(with_counts(table), "rule_counts")
    verdicts = stage(host_verdicts(counted, host_limit), "host_verdicts")
    known = join_groups(
        counted, verdicts.select("host", "host_rejected", *[f"{r}_rate" for r in RULES]), "host",
        F.struct("doc_id", "word_chars"),
    )
    rejected, base_failed = F.coalesce("host_rejected", F.lit(False)), F.expr(BASE_FAILED)
    suspect = F.lit(False)
    for r, failed in RULES.items():
        suspect = suspect | (F.expr(failed) & F.coalesce(F.col(f"{r}_rate") > suspect_limit, F.lit(False)))
    return known.select(
        "doc_id", "host", *COUNTS, base_failed.alias("base_failed"),
        F.filter(F.array(*[F.when(F.expr(c), F.lit(r)) for r, c in RULES.items()]), lambda r: r.isNotNull()).alias("failed_rules"),
        rejected.alias("host_rejected"), (~(base_failed | rejected | suspect)).alias("kept"),
    )


def keep_documents(docs: DataFrame, **settings) -> DataFrame:
    """The documents that ``judged`` keeps, with all their columns.

    Rows that share an id and a text are judged alike; the verdict is joined by id
    and the counts of the text, so an id with several texts keeps the good ones.
    Rows with a null id are matched as well.
    """
    ship_package(docs.sparkSession)
    id_column, text_column = settings.get("id_column", "doc_id"), settings.get("text_column", "text")
    host = host_of(docs[settings.get("host_column", "source")].cast("string"))
    verdict = judged(docs, **settings)
    bad = verdict.where("not kept").select(
        F.struct("doc_id", "host", *COUNTS).alias("_judged")
    ).distinct()
    mark = "_row"
    while mark in docs.columns:
        mark += "_"
    whole = docs.select(
        docs[id_column].cast("long").alias("doc_id"), host.alias("host"), docs[text_column].alias("text"),
        F.struct(*[docs[f"`{c}`"].alias(c) for c in docs.columns]).alias(mark),
    )
    counted = with_counts(whole).withColumn("_judged", F.struct("doc_id", "host", *COUNTS))
    return counted.join(bad, "_judged", "left_anti").select(*[F.col(mark)[c].alias(c) for c in docs.columns])
