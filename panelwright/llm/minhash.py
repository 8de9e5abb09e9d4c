"""Near-duplicate documents: fast similarity sketches, banding, exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import stage
from .files import ship_package, small_batches
from .graph import star_components, star_step
from .groups import written_keys
from .memory import keeps, with_tables_of

SHINGLE_WORDS = 5
#: 32 bands of 6 miss fewer than one in 10,000 of the pairs at THRESHOLD.
BANDS, ROWS = 32, 6
#: Links have 100 * intersection >= THRESHOLD * union.
THRESHOLD = 80
#: Centres a bucket tries in the first round; with each round there are so many times as many.
FIRST_CENTRES, MORE_CENTRES = 2, 8
#: Bytes of the words, and of what goes with each, that a worker remembers.
REMEMBERED_BYTES, ENTRY_BYTES = 16 << 20, 180
#: Classes of shingles by hash, for the bound of an intersection (a power of 2).
CLASSES = 64
#: Members of a bucket that meet its centres in one group.
GROUP = 512

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MIX_A, _MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x + _GOLDEN
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


_WEIGHTS = _mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


class _WordHashes(dict):
    """The 64-bit hash of each word seen."""

    size = 0

    def __missing__(self, word: bytes) -> int:
        self.size += len(word) + ENTRY_BYTES
        if self.size > REMEMBERED_BYTES:
            self.clear()
            self.size = len(word) + ENTRY_BYTES
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


@lru_cache(maxsize=1)
def word_hashes() -> _WordHashes:
    return _WordHashes()


keeps("minhash", word_hashes.cache_clear)


def shingles(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes.

    A-Z become lower case; words are what ASCII white space separates. Fewer words
    than a shingle make one shingle together, no word makes none.
    """
    found = text.encode().lower().split() if text else []
    if not found:
        return np.empty(0, dtype=np.uint64)
    hashes = np.fromiter(map(word_hashes().__getitem__, found), dtype=np.uint64, count=len(found))
    n = max(1, len(hashes) - words + 1)
    total = np.full(n, min(len(hashes), words), dtype=np.uint64)
    for k in range(min(words, len(hashes))):
        total += hashes[k : k + n] * _WEIGHTS[k]
    return np.unique(_mix(total))


def sketch(elements: np.ndarray, bins: int) -> np.ndarray:
    """The fast similarity sketch of a set that is not empty.

    In round i < bins every element is thrown into a hashed bin with a value that
    counts the round before the hash; in round bins + j all elements compete for
    bin j. So after at most 2 * bins rounds every bin holds its smallest value;
    as a rule the bins are full after the elements have been thrown about
    bins * log(bins) times in all, and the rest is left out. Bins of two sets agree
    with a probability equal to their similarity.
    """
    out = np.full(bins, np.iinfo(np.uint64).max, dtype=np.uint64)
    block, i = int(min(bins, max(1, 1024 // len(elements)))), 0
    while i < 2 * bins and (out == np.iinfo(np.uint64).max).any():
        last = min(i + block, bins if i < bins else 2 * bins)
        rounds = np.arange(i, last, dtype=np.uint64)
        hashed = _mix(elements[:, None] ^ _mix(rounds)[None, :])
        value = (hashed & np.uint64(0xFFFFFFFF)) | (rounds << np.uint64(32))[None, :]
        if i < bins:
            place = ((hashed >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
            np.minimum.at(out, place.ravel().astype(np.intp), value.ravel())
        else:
            np.minimum(out[i - bins : last - bins], value.min(axis=0), out=out[i - bins : last - bins])
        i = last
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band; equal bands of different numbers have different keys."""
    parts = (signature.reshape(bands, rows) * _WEIGHTS[:rows]).sum(axis=1, dtype=np.uint64)
    return _mix(parts ^ _mix(np.arange(bands, dtype=np.uint64)))


_SKETCHED = pa.schema([
    ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("keys", pa.list_(pa.int64())),
])


def sketches(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, words: int = SHINGLE_WORDS) -> DataFrame:
    """Per row of (doc_id, text): size and 128-bit hash of its shingle set, and the keys of its bands."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, marks, keys = [], [], []
            for text in batch.column(1):
                found = shingles(text.as_py(), words)
                sizes.append(len(found))
                marks.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                keys.append(band_keys(sketch(found, bands * rows), bands, rows).astype(np.int64) if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(marks, pa.binary()),
                 pa.array(keys, pa.list_(pa.int64()))], schema=_SKETCHED,
            )

    return docs.mapInArrow(with_tables_of("minhash", work), "doc_id long, n_shingles long, set_key binary, keys array<long>")


def set_mark(set_key: bytes) -> int:
    """The first half of a set's hash."""
    return int.from_bytes(set_key[:8], "big", signed=True)


def shingle_sets(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """(node, mark, shingles, totals) of rows (doc_id, text), for verification.

    ``mark`` tells the sets of one node apart; ``totals`` counts the shingles of each class.
    """
    schema = pa.schema([
        ("node", pa.int64()), ("mark", pa.int64()), ("shingles", pa.list_(pa.int64())), ("totals", pa.list_(pa.int32())),
    ])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(text.as_py(), words) for text in batch.column(1)]
            marks = [set_mark(xxhash.xxh3_128_digest(found.tobytes())) for found in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(marks, pa.int64()),
                 pa.array([found.astype(np.int64) for found in sets], schema.field(2).type),
                 pa.array([np.bincount(found % np.uint64(CLASSES), minlength=CLASSES).astype(np.int32) for found in sets],
                          schema.field(3).type)], schema=schema,
            )

    return docs.mapInArrow(with_tables_of("minhash", work), "node long, mark long, shingles array<long>, totals array<int>")


def shared_classes(sets: DataFrame) -> DataFrame:
    """(node, mark, shared, classes): how many shingles of a set another set has too, in all and by class.

    A shingle is alone if one set has it, in however many rows. ``classes`` is null
    where a count exceeds 16 bits.
    """
    holders = sets.select("mark", F.explode("shingles").alias("s")).groupBy("s").agg(
        F.min("mark").alias("mark"), F.max("mark").alias("last")
    )
    of_class = (F.col("s").bitwiseAND(CLASSES - 1)).cast("int")
    alone = holders.where("mark = last").groupBy("mark", of_class.alias("c")).agg(
        F.count(F.lit(1)).cast("int").alias("n")
    ).groupBy("mark").agg(F.map_from_entries(F.collect_list(F.struct("c", "n"))).alias("alone"))  # an entry a class
    known = sets.groupBy("node", "mark").agg(F.first("totals").alias("totals")).join(alone, "mark", "left")
    classes = F.transform("totals", lambda n, i: n - F.coalesce(F.try_element_at("alone", i), F.lit(0)))
    counted = known.select("node", "mark", classes.alias("counts")).withColumn(
        "shared", F.aggregate("counts", F.lit(0), lambda a, b: a + b)
    )
    small = F.array_max("counts") < (1 << 15)
    return counted.select("node", "mark", "shared", F.when(small, F.col("counts").cast("array<short>")).alias("classes"))


def _verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose full sets, that of a_mark and that of b_mark, are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("mark").alias("a_mark"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("mark").alias("b_mark"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    return (
        pairs.join(left, ["a", "a_mark"]).join(right, ["b", "b_mark"])
        .where(100 * common >= threshold * (F.size("sa") + F.size("sb") - common)).select("a", "b").distinct()
    )


def _components(buckets: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """(node, component) of all nodes that have a link.

    ``buckets`` has (key, node, mark, n, earlier, shared, classes, size, u): every set in every
    bucket with its node, its size and the upper halves of the keys of its earlier bands, how many of its
    shingles any other compared set has, in all and by class, the size of the bucket and the node's hash in [0, 1). A node has several sets if
    an id occurs with several texts. In each round a growing
    share of a bucket's members are centres, in the first one also the member with
    the fewest shingles of its own, which as a rule is what the others were copied
    from. Centres meet those members that belong to another component so far and
    were not centres before. Copies collapse into one component after the first
    centres, so they are never compared all with all; a bucket in one component is
    done. Where texts differ, the rounds go on until every pair of a bucket has met,
    is connected or can't be similar: an intersection is no larger than either
    side's ``shared``, nor than the sum over the classes of the lesser count. A pair
    passes only in the first band that both have in common (keys are told apart by their
    upper halves, so one pair in 10^8 is missed beside those that banding misses), and the members of a large
    bucket are dealt to groups that each get its centres. Between rounds a few star steps tell most of what is
    connected; that is only to save comparisons, so they need not come to an end.
    """
    origin = buckets.groupBy("key").agg(F.min(F.struct(F.col("n") - F.col("shared"), "u", "node"))["node"].alias("origin"))
    now, edges, done = buckets.withColumn("component", F.col("node")), None, 0
    groups = F.ceil(F.col("size") / GROUP).cast("int")
    while True:
        reach = MORE_CENTRES * done + FIRST_CENTRES
        open_members = now.where(F.col("u") * F.col("size") >= done)
        chosen = open_members.where(F.col("u") * F.col("size") < reach)
        if not done:
            first = now.join(origin, (now["key"] == origin["key"]) & (now["node"] == origin["origin"]), "left_semi")
            chosen = chosen.union(first).distinct()
        centres = chosen.select(
            "key", *[F.col(c).alias(f"c_{c}") for c in ("mark", "n", "shared", "classes", "earlier", "component")],
            F.col("node").alias("c"), F.explode(F.sequence(F.lit(0), groups - 1)).alias("group"),
        )
        members = open_members.withColumn("group", F.pmod(F.xxhash64("node", "mark"), groups).cast("int"))
        larger = F.col("node") > F.col("c")
        common = F.aggregate(F.zip_with("classes", "c_classes", lambda a, b: F.least(a, b).cast("int")), F.lit(0), lambda a, b: a + b)
        met = F.exists(F.zip_with("earlier", "c_earlier", lambda a, b: a == b), lambda same: same)
        pairs = members.join(centres, ["key", "group"]).where(
            (F.col("component") != F.col("c_component"))
            & (100 * F.least("n", "c_n") >= threshold * F.greatest("n", "c_n"))
            & ((100 + threshold) * F.least("shared", "c_shared") >= threshold * (F.col("n") + F.col("c_n")))
            & ~met & F.coalesce((100 + threshold) * common >= threshold * (F.col("n") + F.col("c_n")), F.lit(True))
        ).select(
            F.greatest("node", "c").alias("a"), F.when(larger, F.col("mark")).otherwise(F.col("c_mark")).alias("a_mark"),
            F.least("node", "c").alias("b"), F.when(larger, F.col("c_mark")).otherwise(F.col("mark")).alias("b_mark"),
        ).distinct()
        found = stage(_verified(pairs, sets, threshold), "pairs")
        edges = found if edges is None else edges.union(found)
        for _ in range(2):  # each step written, so that no plan holds two
            edges = stage(star_step(edges), "stars")
        labels = edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
        left = now.where(F.col("size") > reach).drop("component").join(labels, "node", "left").withColumn(
            "component", F.coalesce("component", "node")
        )
        split = left.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi")
        now, done = stage(left.join(split.select("key"), "key", "left_semi"), "buckets"), reach
        if now.isEmpty():
            return star_components(edges)


def near_duplicates(
    docs: DataFrame, threshold: int = THRESHOLD, bands: int = BANDS, rows: int = ROWS, words: int = SHINGLE_WORDS,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * intersection >= ``threshold`` * union of their
    shingle sets. A pair at that similarity s shares a band with probability
    1 - (1 - s^rows)^bands (0.9999 at 0.80); all links found are confirmed on the
    full sets, and components are those of the links.

    Documents with one and the same set are one node from the start, however many
    they are. Null and empty texts have an empty set and stay alone. Rows with a
    null id link with nothing. Repeated rows are answered each; rows that share an
    id are one document with several texts. Other columns are ignored.
    """
    spark = docs.sparkSession
    ship_package(spark)
    table = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text"))
    with small_batches(spark):
        sketched = stage(sketches(table, bands, rows, words), "sketches")
    groups = stage(
        sketched.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(
            F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n"),
            F.first("keys").alias("keys"),
        ),
        "groups",
    )
    # The first 8 bytes of the set's hash as a number, as in set_mark.
    mark = F.conv(F.hex(F.substring("set_key", 1, 8)), 16, -10).cast("long")
    known = groups.withColumn("mark", mark)
    members = known.select("node", "mark", "n", F.posexplode("keys").alias("band", "key"))
    shared = members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    share = F.shiftrightunsigned(F.xxhash64("node"), 11) / F.lit(float(2**53))
    buckets = stage(members.join(shared, "key").withColumn("u", share), "members")
    compared = buckets.select("node").distinct()
    with small_batches(spark):
        sets = stage(
            shingle_sets(table.join(compared, table["doc_id"] == compared["node"], "left_semi"), words), "sets"
        )
    uppers = known.select("node", "mark", F.transform("keys", lambda k: F.shiftright(k, 32).cast("int")).alias("uppers"))
    buckets = stage(
        buckets.join(shared_classes(sets), ["node", "mark"]).join(uppers, ["node", "mark"])
        .withColumn("earlier", F.slice("uppers", F.lit(1), F.col("band"))).drop("uppers", "band"), "buckets",
    )
    components = _components(buckets, sets, threshold)
    marked = groups.join(components, "node", "left").where("copies > 1 or component is not null").select(
        "set_key", F.coalesce("component", "node").alias("component")
    )
    answered = sketched.join(marked, "set_key", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")
    )
    return answered.withColumn(
        "component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _one_row_per_id(docs: DataFrame) -> DataFrame:
    """Of rows that share an id the first by text; the aggregation combines within tasks first."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    first = docs.groupBy("doc_id").agg(F.min_by(row, F.struct(F.col("text").isNull(), "text")).alias("row"))
    return first.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def drop_near_duplicates(docs: DataFrame, **settings) -> DataFrame:
    """One document of each group, that with the smallest id; all columns stay as they are.

    Of rows that share an id the first by text stays. Rows with a null id stay. Texts
    stay in their tasks as long as the ids that go can be broadcast.
    """
    found = stage(near_duplicates(docs, **settings), "duplicates").where("doc_id is not null")
    dropped = written_keys(found.where("not kept").select(F.col("doc_id").alias("_dropped")).distinct(), "dropped")
    repeated = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(
        F.col("doc_id").alias("_repeated")
    )
    left = docs.join(dropped, docs["doc_id"] == dropped["_dropped"], "left_anti")
    if repeated.isEmpty():
        return left
    repeated = written_keys(repeated, "repeated")
    once = left.join(repeated, left["doc_id"] == repeated["_repeated"], "left_anti")
    more = left.join(repeated, left["doc_id"] == repeated["_repeated"], "left_semi")
    return once.union(_one_row_per_id(more))
