"""Benchmark decontamination with DataFrame functions only: token windows of the test items, found in documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..session import stage
from .groups import written_keys

WINDOW = 10
#: The window hashes are a literal set in the plan up to this many distinct windows. Beyond, they are a table that is
#: broadcast as a hash set up to so many bytes (``ENTRY_BYTES`` a window), and joined by a shuffle only above that.
BROADCAST_WINDOWS = 20_000
BROADCAST_BYTES, ENTRY_BYTES = 256 << 20, 48

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# All ASCII characters but digits and lower-case letters separate words.
_SEPARATORS = "".join(chr(c) for c in [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def normal_words(text: Column) -> Column:
    """The words of a text in order, A-Z in lower case; none for null."""
    trimmed = F.btrim(F.translate(text, _UPPER, _LOWER), F.lit(_SEPARATORS))
    return F.when(trimmed.isNull() | (trimmed == ""), F.array().cast("array<string>")).otherwise(F.split(trimmed, _SPLIT, -1))


@dataclass
class Windows:
    """The windows of a benchmark: table (gram, length, hash, items), their lengths and, if few enough, the hashes."""

    table: DataFrame
    lengths: list[int]
    hashes: list[int] | None
    first_words: list[str] | None
    broadcast: bool = True

    @property
    def small(self) -> bool:
        return self.hashes is not None


def _slice_hash(words: Column, at: Column, length: int) -> Column:
    return F.xxhash64(F.slice(words, at, length))


def benchmark_windows(
    benchmark: DataFrame, window: int = WINDOW, broadcast_windows: int = BROADCAST_WINDOWS, broadcast_bytes: int = BROADCAST_BYTES,
    item_column: str = "item_id", text_column: str = "text",
) -> Windows:
    """All windows of ``window`` consecutive words of the items; an item of fewer words is one window.

    Items without a word have none. Items are listed as strings; a null item id is
    found in documents but not listed.
    """
    items = benchmark.select(
        benchmark[item_column].cast("string").alias("item"), normal_words(benchmark[text_column]).alias("words")
    ).where(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("words") - length + 1)
    grams = items.select("item", F.explode(F.transform(starts, lambda i: F.slice("words", i, length))).alias("words"))
    table = stage(
        grams.groupBy("words").agg(F.collect_set("item").alias("items")).select(
            F.array_join("words", " ").alias("gram"), F.size("words").alias("length"), F.xxhash64("words").alias("hash"),
            F.element_at("words", 1).alias("first"), "items",
        ),
        "windows",
    )
    lengths = sorted(r["length"] for r in table.select("length").distinct().collect())  # at most ``window``
    count = table.count()
    if count > broadcast_windows:
        return Windows(table, lengths, None, None, count * ENTRY_BYTES <= broadcast_bytes)
    few = table.select("hash", "first").collect()
    return Windows(table, lengths, sorted({r["hash"] for r in few}), sorted({r["first"] for r in few}))


def _one_of(value: Column, values: list) -> Column:
    """Membership in a fixed set, which the executors hold as a hash set."""
    return value.isin(*values) if values else F.lit(False)


def _hit(words: Column, at: Column, length: int) -> Column:
    return F.struct(
        at.alias("at"), F.lit(length).alias("length"), F.array_join(F.slice(words, at, length), " ").alias("gram")
    )


def _places(words: Column, length: int) -> Column:
    n = F.size(words)
    return F.when(n >= length, F.sequence(F.lit(1), n - (length - 1))).otherwise(F.array().cast("array<int>"))


def _candidates(words: Column, windows: Windows) -> Column:
    """Places whose first word and hash are those of a window, with the words there."""
    def of(length: int) -> Column:
        def is_window(i):
            return _one_of(F.element_at(words, i), windows.first_words) & _one_of(
                _slice_hash(words, i, length), windows.hashes
            )

        return F.transform(F.filter(_places(words, length), is_window), lambda i: _hit(words, i, length))

    found = [of(length) for length in windows.lengths]
    return F.concat(*found) if found else F.array().cast("array<struct<at:int,length:int,gram:string>>")


def _joined_candidates(keyed: DataFrame, windows: Windows) -> DataFrame:
    """The same for any number of windows: hashes meet in a join, then the words at those places are read.

    As long as the hashes can be broadcast, the places never leave their task; only what met is grouped by row.
    """
    hashes = windows.table.select("hash").distinct()
    hashes = F.broadcast(hashes) if windows.broadcast else hashes
    def of(length: int) -> Column:
        return F.transform(_places(F.col("words"), length), lambda i: F.struct(
            i.alias("at"), F.lit(length).alias("length"), _slice_hash(F.col("words"), i, length).alias("hash")
        ))

    places = F.flatten(F.array(*[of(length) for length in windows.lengths]))
    met = (
        keyed.select("key", F.explode(places).alias("p")).select("key", "p.*")
        .join(hashes, "hash", "left_semi")
        .groupBy("key").agg(F.collect_set(F.struct("at", "length")).alias("met"))
    )
    read = F.transform("met", lambda p: F.struct(
        p["at"].alias("at"), p["length"].alias("length"),
        F.array_join(F.slice("words", p["at"], p["length"]), " ").alias("gram"),
    ))
    return keyed.join(met, "key", "left").withColumn(
        "hits", F.coalesce(read, F.array().cast("array<struct<at:int,length:int,gram:string>>"))
    )


def row_key(doc_id: Column, text: Column) -> Column:
    """Names a row by its content; repeated rows share it, and their answer."""
    return F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), text).cast("binary"))


def find_hits(docs: DataFrame, windows: Windows, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: doc_id, key, n_words and the candidate hits (at, length, gram); one pass over the texts."""
    keyed = docs.select(
        docs[id_column].alias("doc_id"), row_key(docs[id_column], docs[text_column]).alias("key"),
        normal_words(docs[text_column]).alias("words"),
    )
    if windows.small or not windows.lengths:
        keyed = keyed.withColumn("hits", _candidates(F.col("words"), windows))
    else:
        keyed = _joined_candidates(keyed, windows)
    return keyed.select("doc_id", "key", F.size("words").cast("long").alias("n_words"), "hits")


def _verified(found: DataFrame, windows: Windows) -> DataFrame:
    """Hits whose words are those of a window, not only their hash: (key, at, length, items)."""
    table = windows.table.select("gram", "length", "items")
    if windows.small:
        table = F.broadcast(table)  # at most BROADCAST_WINDOWS rows
    hits = found.where(F.size("hits") > 0).select("key", F.explode("hits").alias("h")).select("key", "h.*")
    return hits.join(table, ["gram", "length"])


def _covered(spans: Column) -> Column:
    """How many words the sorted spans (at, length) cover together."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    return F.aggregate(
        F.array_sort(spans), start,
        lambda acc, s: F.struct(
            F.greatest(acc["end"], s["at"] + s["length"]).alias("end"),
            (acc["n"] + F.greatest(F.lit(0), s["at"] + s["length"] - F.greatest(acc["end"], s["at"]))).alias("n"),
        ),
        lambda acc: acc["n"],
    )


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """One row per input row: doc_id, n_words, n_hit, n_items, items, contaminated.

    A document word inside any occurrence of a window is hit. Null and empty texts
    have no words; without benchmark items nothing is hit; repeated rows are
    answered each; other columns are ignored.
    """
    windows = benchmark_windows(benchmark, window, broadcast_windows)
    found = stage(find_hits(docs, windows), "hits")
    verified = stage(_verified(found, windows).distinct(), "verified")
    hit = verified.groupBy("key").agg(F.collect_set(F.struct("at", "length")).alias("spans")).select(
        "key", _covered(F.col("spans")).cast("long").alias("n_hit")
    )
    items = verified.select("key", F.explode("items").alias("item")).groupBy("key").agg(
        F.array_sort(F.collect_set("item")).alias("items")
    )
    return (
        found.select("doc_id", "key", "n_words").join(hit, "key", "left").join(items, "key", "left")
        .select(
            "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        )
        .withColumn("n_items", F.size("items").cast("long")).withColumn("contaminated", F.col("n_hit") > 0)
    )


def remove_contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """The documents without those that hold a window of the benchmark; all columns stay as they are.

    Texts stay in their tasks as long as the keys of the rows that go can be broadcast.
    """
    windows = benchmark_windows(benchmark, window, broadcast_windows)
    # Staged before any filter: a filter would be moved below the words and split every text anew for each of them.
    found = stage(find_hits(docs, windows).select("key", "hits"), "hits")
    bad = written_keys(_verified(found, windows).select(F.unhex("key").alias("_contaminated_key")).distinct(), "contaminated")
    return docs.join(bad, F.unhex(row_key(docs["doc_id"], docs["text"])) == bad["_contaminated_key"], "left_anti")
