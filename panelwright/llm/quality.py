"""Quality by importance resampling: hashed n-gram models of good and of all text, Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from ..operators.order import add_row_id
from ..session import stage
from .files import ship_package, small_batches
from .memory import keeps, with_tables_of
from .minhash import _mix

#: Buckets of hashed word, word pair and form pair n-grams.
WORD_BUCKETS, PAIR_BUCKETS, FORM_BUCKETS = 1 << 14, 1 << 14, 1 << 12
#: At most this many labelled documents teach the target and the share to keep (the first ones in hash order).
LABELLED_SAMPLE = 20_000
#: Counts added to every bucket of the target and of the raw model.
PRIOR = 20.0
#: Scale of the Gumbel noise against the log weights; 1 samples in proportion to the weights.
TEMPERATURE = 1.0
#: Bytes of the words, and of what goes with each, that a worker remembers.
REMEMBERED_BYTES, ENTRY_BYTES = 48 << 20, 180
SEED = 9176

_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_SECTIONS = (0, WORD_BUCKETS, WORD_BUCKETS + PAIR_BUCKETS, WORD_BUCKETS + PAIR_BUCKETS + FORM_BUCKETS)
BUCKETS = _SECTIONS[-1]


def _form(word: bytes) -> int:
    """Hash of a word's form: its case and the marks it ends with."""
    core = word.rstrip(_MARKS)
    text = core.decode("utf-8", "replace")
    case = "none" if not text else "upper" if len(text) > 1 and text.isupper() else "title" if text[:1].isupper() else (
        "lower" if text.isalpha() else "mixed"
    )
    return xxhash.xxh32_intdigest(case.encode() + word[len(core):][:8])


class _Words(dict):
    """Two 32-bit hashes of each word seen, its own and its form's, in one integer."""

    size = 0

    def __missing__(self, word: bytes) -> int:
        self.size += len(word) + ENTRY_BYTES
        if self.size > REMEMBERED_BYTES:
            self.clear()
            self.size = len(word) + ENTRY_BYTES
        found = self[word] = xxhash.xxh32_intdigest(word) << 32 | _form(word)
        return found


@lru_cache(maxsize=1)
def _words() -> _Words:
    return _Words()


keeps("quality", _words.cache_clear)


def ngrams(text: str | None) -> np.ndarray:
    """Bucket numbers of the n-grams of a text: words, pairs of words, pairs of forms.

    A word that repeats the one before has the form "again".
    """
    words = text.encode().split() if text else []
    if not words:
        return np.empty(0, dtype=np.int64)
    both = np.fromiter(map(_words().__getitem__, words), dtype=np.uint64, count=len(words))
    own, form = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
    before = np.concatenate([[np.uint64(0)], own[:-1]])
    form = np.where(own == before, np.uint64(1), form)
    form_before = np.concatenate([[np.uint64(0)], form[:-1]])
    return np.concatenate([
        _SECTIONS[0] + (_mix(own) % np.uint64(WORD_BUCKETS)).astype(np.int64),
        _SECTIONS[1] + (_mix(own ^ (before << np.uint64(32))) % np.uint64(PAIR_BUCKETS)).astype(np.int64),
        _SECTIONS[2] + (_mix(form ^ (form_before << np.uint64(32))) % np.uint64(FORM_BUCKETS)).astype(np.int64),
    ])


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log of target over raw probability per bucket, each section a distribution of its own.

    Raw counts are brought to the total of the target's, then both get ``PRIOR``
    more per bucket: n-grams too rare to tell anything weigh next to nothing, so a
    document that taught the target is not preferred to one that did not.
    """
    out = np.zeros(BUCKETS)
    for a, b in zip(_SECTIONS, _SECTIONS[1:]):
        t, r = target[a:b].astype(float), raw[a:b].astype(float)
        if t.sum() and r.sum():
            out[a:b] = np.log((t + PRIOR) / (r * (t.sum() / r.sum()) + PRIOR))
    return out


def log_weight(grams: np.ndarray, ratios: np.ndarray) -> float:
    return float(ratios[grams].sum())


def gumbel_key(weight: float, doc_id, text: str | None, temperature: float) -> float:
    """Log weight plus Gumbel noise drawn from a hash of the row, so every pass draws alike."""
    mark = xxhash.xxh64_intdigest(f"{SEED}:{doc_id}:".encode() + (text or "").encode())
    uniform = ((mark >> 11) + 0.5) / 2**53
    return weight + temperature * float(-np.log(-np.log(uniform)))


def labelled_sample(labels: DataFrame, rows: int = LABELLED_SAMPLE) -> DataFrame:
    """(doc_id, good, teaches) of at most ``rows`` labelled documents, the first in hash order.

    Half of them teach the target model, the others settle the cut, since a
    document weighs more in a model that it taught. Rows without id or label count
    for nothing; an id with several labels is good if all say so.
    """
    return (
        labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg((F.min("quality") >= 1).alias("good")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        .withColumn("teaches", F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(2)) == 0)
    )


def count_ngrams(docs: DataFrame, sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of the good documents that teach and of all documents by bucket.

    Each task adds up its own documents and hands on one row per bucket that it
    met; what reaches the driver has ``BUCKETS`` rows.
    """
    teachers = F.broadcast(sample.where("good and teaches"))  # at most the rows of the sample
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(teachers, "doc_id", "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS), dtype=np.int64)
        for batch in batches:
            for text, mark in zip(batch.column(0), batch.column(1).to_pylist()):
                grams = ngrams(text.as_py())
                np.add.at(counts[1], grams, 1)
                if mark:
                    np.add.at(counts[0], grams, 1)
        met = np.flatnonzero(counts[1])
        yield pa.RecordBatch.from_pydict({"bucket": met, "target": counts[0][met], "raw": counts[1][met]})

    rows = marked.select("text", "good").mapInArrow(
        with_tables_of("quality", work), "bucket long, target long, raw long"
    ).groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw")).collect()
    out = np.zeros((2, BUCKETS), dtype=np.int64)
    for row in rows:
        out[:, row["bucket"]] = row["target"], row["raw"]
    return out[0], out[1]


SCORES = (("doc_id", "long"), ("n_words", "long"), ("log_weight", "double"), ("gumbel_key", "double"), ("mark", "long"))


def scores(docs: DataFrame, ratios: np.ndarray, temperature: float = TEMPERATURE, prefix: str = "", whole: bool = False) -> DataFrame:
    """Per row: doc_id, n_words, log_weight, gumbel_key and a hash of the text that settles ties.

    With ``whole`` these columns, named with ``prefix``, follow all those of the documents.
    """
    kept = docs.columns if whole else []
    at_text = docs.columns.index("text") if whole else 1
    names = [prefix + n for n, _ in SCORES]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, weights, keys, marks = [], [], [], []
            at_id = batch.num_columns - 1 if whole else 0
            for doc_id, text in zip(batch.column(at_id).to_pylist(), batch.column(at_text)):
                text = text.as_py()
                grams = ngrams(text)
                words.append(len(grams) // 3)
                weights.append(log_weight(grams, ratios))
                keys.append(gumbel_key(weights[-1], doc_id, text, temperature))
                marks.append(xxhash.xxh64_intdigest((text or "").encode()) >> 1)
            yield pa.RecordBatch.from_arrays([
                *batch.columns[: len(kept)], batch.column(at_id), pa.array(words, pa.int64()), pa.array(weights, pa.float64()),
                pa.array(keys, pa.float64()), pa.array(marks, pa.int64()),
            ], names=[*kept, *names])

    given = docs.select(docs["doc_id"].cast("long").alias(names[0]), docs["text"])
    if whole:
        given = docs.withColumn(names[0], docs["doc_id"].cast("long"))
    fields = [*(docs.schema.fields if whole else []), *(T.StructField(prefix + n, T._parse_datatype_string(t)) for n, t in SCORES)]
    return given.mapInArrow(with_tables_of("quality", work), T.StructType(fields))


def best_cut(weights: np.ndarray, good: np.ndarray) -> float:
    """The log weight that tells good from bad best on the sample: the middle of the best gap.

    Best is the largest sum of the shares of good documents kept and of bad ones
    rejected. Without a bad document nothing is rejected.
    """
    if not good.any() or good.all():
        return -np.inf
    order = np.argsort(weights, kind="stable")
    w, g = weights[order], good[order]
    gain = np.concatenate([[0.0], np.cumsum(np.where(g, -1 / g.sum(), 1 / (~g).sum()))])
    usable = np.concatenate([[True], w[1:] > w[:-1], [True]])
    best = int(np.where(usable, gain, -np.inf).argmax())
    if best in (0, len(w)):
        return -np.inf if best == 0 else np.inf
    return float((w[best - 1] + w[best]) / 2)


def resample(
    docs: DataFrame, labels: DataFrame, temperature: float = TEMPERATURE, sample_rows: int = LABELLED_SAMPLE, whole: bool = False,
):
    """Score all documents and find the last one that is kept.

    Returns (scored, last, rows, prefix): the scores with ``selected``, the
    (gumbel_key, doc_id, mark) of the last selected row, None if nothing is selected,
    and the written table of the scores, which with ``whole`` has the documents too and
    the names of the scores after ``prefix``.

    k is the number of documents on the good side of the cut that serves the
    held-out half of the labelled sample best; the k rows with the largest Gumbel keys are selected.
    """
    spark = docs.sparkSession
    ship_package(spark)
    prefix = "_" if whole else ""
    while whole and any(c.startswith(prefix) for c in docs.columns):
        prefix += "_"
    sample = stage(labelled_sample(labels, sample_rows), "labelled")
    with small_batches(spark):
        ratios = log_ratios(*count_ngrams(docs, sample))
        rows = stage(scores(docs, ratios, temperature, prefix, whole), "scores")
    scored = rows.select(*[F.col(prefix + n).alias(n) for n, _ in SCORES])
    judged = (
        scored.join(F.broadcast(sample.where("not teaches")), "doc_id").groupBy("doc_id")
        .agg(F.min("log_weight").alias("log_weight"), F.first("good").alias("good")).collect()
    )  # at most the rows of the sample
    cut = best_cut(np.array([r["log_weight"] for r in judged]), np.array([r["good"] for r in judged], dtype=bool))
    k = scored.where(F.col("log_weight") >= F.lit(cut)).count()
    ordered = add_row_id(
        scored.withColumn("_down", -F.col("gumbel_key")), ["_down", "doc_id", "mark"], "rank"
    ).drop("_down")
    last = ordered.where(F.col("rank") == k).first() if k else None
    chosen = ordered.withColumn("selected", F.col("rank") <= k)
    return chosen, last and (last["gumbel_key"], last["doc_id"], last["mark"]), rows, prefix


def classify(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """One row per input row: doc_id, n_words, log_weight, gumbel_key, selected.

    The target model is learnt from the good ones of at most ``sample_rows``
    labelled documents, the raw model from all documents, whole texts. Null and
    empty texts have weight 0. Ties go by id (null first) and a hash of the text;
    repeated rows have one key. Without labels, or with one class of them,
    everything is selected. An empty table gives no row.
    """
    return resample(docs, labels, **settings)[0].select("doc_id", "n_words", "log_weight", "gumbel_key", "selected")


def keep_selected(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The selected documents with all their columns.

    Scoring writes the documents with their keys, so what is kept is a filter against
    the last selected key. Null and empty texts have weight 0 and are kept or not like
    others; rows with equal id and text share one key and go or stay together as far
    as ties at the last place allow: all of them stay if one does. Clashing column
    names do no harm; an empty table gives no row.
    """
    _, last, rows, prefix = resample(docs, labels, whole=True, **settings)
    if last is None:
        return rows.select(*docs.columns).where("false")
    key, doc_id, mark = (F.col(f"`{prefix}{n}`") for n in ("gumbel_key", "doc_id", "mark"))
    same_id = doc_id.eqNullSafe(F.lit(last[1]).cast("long"))
    before_id = (doc_id.isNull() & F.lit(last[1] is not None)) | F.coalesce(doc_id < F.lit(last[1]).cast("long"), F.lit(False))
    kept = (key > last[0]) | ((key == last[0]) & (before_id | (same_id & (mark <= last[2]))))
    return rows.where(kept).select(*[F.col(f"`{c}`") for c in docs.columns])
