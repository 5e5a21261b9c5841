"""SimHash near-duplicates by anchor-point covering.

Every 64-bit fingerprint is cut into two halves. Two fingerprints with at most
three differing bits differ in at most one bit of some half. The words of the
Hamming code of length 31 are the anchors of a half: they cover its 31 bits
with radius one, so each half has one home anchor. A half is replicated to all
anchors within the covering radius plus its threshold of one, at most 16 of
2^26. If two halves differ in one bit, the home anchor of one is among the
anchors of the other, so each linked pair meets at an anchor. Per anchor, whole
fingerprints are compared.

Texts enter only through their fingerprints, and equal fingerprints are one
node. An anchor hands on a spanning forest of its links, not all its pairs.
Anchors with more than ``crowd`` fingerprints are split once more by the bytes
of the other half, of which one at least agrees.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.components import components
from driftline.llm.shared import ready, stored, text_bytes, worker_cache

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
CROWD = 20_000  # fingerprints of an anchor that are compared in one group
SHINGLES_AT_ONCE = 100_000
SMALL_GROUP = 24


def shingle_hashes(words: list[bytes], width: int) -> Iterator[np.ndarray]:
    """XXH64 of all word shingles, in slices of bounded length."""
    if len(words) < width:
        if words:
            yield np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], dtype=np.uint64)
        return
    for begin in range(0, len(words) - width + 1, SHINGLES_AT_ONCE):
        part = words[begin:begin + SHINGLES_AT_ONCE + width - 1]
        joined = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), dtype=np.int64, count=len(part)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[: len(part) - width + 1]
        digest = xxhash.xxh64_intdigest
        yield np.fromiter(
            (digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[width - 1:].tolist(), strict=True)),
            dtype=np.uint64, count=len(starts),
        )


def fingerprint(text: bytes, width: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit SimHash of UTF-8 bytes; 0 without words."""
    ones, total = np.zeros(64, dtype=np.int64), 0
    for hashes in shingle_hashes(text.lower().split(), width):  # bytes: only A-Z and ASCII blanks count
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp): the fingerprint of every row as a signed long."""
    ready(docs)

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("simhash")
        for batch in batches:
            found = [fingerprint(text.as_py(), width) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.array(found, dtype=np.uint64).view(np.int64))], ["doc_id", "fp"]
            )

    return docs.select("doc_id", text_bytes().alias("text")).mapInArrow(of_batches, "doc_id long, fp long")


def _half(fp: Column, half: int) -> Column:
    """31 of the 32 bits; leaving one out can only lower a distance."""
    return F.shiftrightunsigned(fp, 32 * half).bitwiseAND(F.lit((1 << 31) - 1))


def _syndrome(bits: Column) -> Column:
    """XOR of the positions 1 to 31 of the set bits: 0 on the Hamming code's words."""
    parity = F.lit(0)
    for j in range(5):
        mask = sum(1 << (position - 1) for position in range(1, 32) if position >> j & 1)
        parity = parity + F.bit_count(bits.bitwiseAND(F.lit(mask))) % 2 * (1 << j)
    return parity.cast("int")


def _flip(position: Column) -> Column:
    """The bit at a position from 1 to 31; none at position 0."""
    one = F.lit(1).cast("long")
    return F.when(position == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", one, position - 1))


def anchored(nodes: DataFrame) -> DataFrame:
    """(key, home, fp): each fingerprint at every anchor within radius plus threshold, in both halves."""
    halves = []
    for half in (0, 1):
        own = nodes.select("fp", _half(F.col("fp"), half).alias("bits"))
        own = own.select("fp", "bits", _syndrome(F.col("bits")).alias("s"))
        # The flips {a, a xor s} are the error patterns of weight 1 (a = 0) and 2 that lead to a code word.
        reach = own.withColumn("a", F.explode(F.expr(
            "filter(sequence(0, 31), a -> s = 0 and a = 0 or s <> 0 and a < (a ^ s))"
        )))
        word = F.col("bits").bitwiseXOR(_flip(F.col("a"))).bitwiseXOR(_flip(F.col("a").bitwiseXOR(F.col("s"))))
        halves.append(reach.select((word + F.lit(half << 31)).alias("key"), (F.col("a") == 0).alias("home"), "fp"))
    return halves[0].unionByName(halves[1])


def _split_crowded(places: DataFrame, crowd: int) -> DataFrame:
    """Give crowded anchors a key for each byte of the other half; four bytes, at most three differ."""
    crowded = places.groupBy("key").count().filter(F.col("count") > crowd).select("key")
    crowded = stored(crowded)
    if not crowded.take(1):
        return places
    other = F.when(F.col("key") < F.lit(1 << 31), F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp"))
    parts = F.array(*[
        F.xxhash64("key", F.lit(j), F.shiftrightunsigned(other, 8 * j).bitwiseAND(F.lit(255))) for j in range(4)
    ])
    split = places.join(crowded, "key", "left_semi").select(F.explode(parts).alias("key"), "home", "fp")
    return places.join(crowded, "key", "left_anti").unionByName(split)


def forest_of_group(home: np.ndarray, fps: np.ndarray, max_bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of one anchor's links, found breadth first; memory is linear in the group."""
    edges, open_ = [], np.arange(len(fps))
    while len(open_) > 1:
        frontier, open_ = open_[:1], open_[1:]
        while len(frontier) and len(open_):
            parent = np.full(len(open_), -1, dtype=np.int64)
            for node in frontier.tolist():
                near = np.bitwise_count(fps[open_] ^ fps[node]) <= max_bits
                if not home[node]:
                    near &= home[open_]
                parent[near & (parent < 0)] = node
            found = parent >= 0
            edges.append((fps[parent[found]], fps[open_[found]]))
            frontier, open_ = open_[found], open_[~found]
    return edges


def links_at_anchors(keys: np.ndarray, home: np.ndarray, fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows sorted by key: small groups by shifted comparison, large ones as forests."""
    bounds = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
    sizes = np.diff(bounds)
    left, right = [], []
    size_of_row = np.repeat(sizes, sizes)
    rows = np.flatnonzero((size_of_row > 1) & (size_of_row <= SMALL_GROUP))
    for shift in range(1, SMALL_GROUP):
        rows = rows[rows + shift < len(keys)]
        rows = rows[keys[rows] == keys[rows + shift]]
        if not len(rows):
            break
        near = (np.bitwise_count(fps[rows] ^ fps[rows + shift]) <= max_bits) & (home[rows] | home[rows + shift])
        left.append(fps[rows[near]])
        right.append(fps[rows[near] + shift])
    for group in np.flatnonzero(sizes > SMALL_GROUP).tolist():
        part = slice(bounds[group], bounds[group + 1])
        for a, b in forest_of_group(home[part], fps[part], max_bits):
            left.append(a)
            right.append(b)
    none = np.zeros(0, dtype=fps.dtype)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def links(nodes: DataFrame, max_bits: int = MAX_BITS, crowd: int = CROWD) -> DataFrame:
    """(u, v): enough links between distinct fingerprints to connect all that are linked."""
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"max_bits must be 0 to {MAX_BITS}")
    spark = ready(nodes)
    places = _split_crowded(anchored(nodes), crowd)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def found(until_last: bool) -> Iterator[pa.RecordBatch]:
            keys, home, fps = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = len(keys) if until_last else int(np.searchsorted(keys, keys[-1]))
            held[:] = [(keys[cut:], home[cut:], fps[cut:])]
            if cut:
                u, v = links_at_anchors(keys[:cut], home[:cut], fps[:cut], max_bits)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        for batch in batches:
            if batch.num_rows:
                held.append((
                    batch.column("key").to_numpy(), batch.column("home").to_numpy(zero_copy_only=False),
                    batch.column("fp").to_numpy().view(np.uint64),
                ))
                yield from found(until_last=False)
        if held:
            yield from found(until_last=True)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return places.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(compare, "u long, v long")


def near_duplicates(docs: DataFrame, width: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, crowd: int = CROWD) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    Null and blank texts have fingerprint zero and are linked like any other.
    Repeated rows get a row each. A component is named by its smallest doc_id;
    rows without a doc_id belong to components but never name them, so a
    component of such rows alone has a null id. An empty table gives no rows;
    other columns are not read.
    """
    prints = stored(fingerprints(docs, width))
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(nodes.select("fp"), max_bits, crowd))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one_of_each(docs: DataFrame, width: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of the document that names each component; rows without doc_id stay.

    Of rows that repeat a doc_id, the one with the least values stays.
    """
    named = near_duplicates(docs, width, max_bits)
    kept = named.filter(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    whole = docs.select("doc_id", F.struct(*docs.columns).alias("doc"))  # a struct, so that no column name clashes
    order = Window.partitionBy("doc_id").orderBy("doc")
    once = whole.join(kept, "doc_id", "left_semi").withColumn("nth", F.row_number().over(order)).filter("nth = 1")
    return once.select("doc.*").unionByName(docs.filter(F.col("doc_id").isNull()))
