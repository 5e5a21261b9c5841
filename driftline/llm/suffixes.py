"""Removal of repeated byte strings by merged Burrows-Wheeler transforms.

Every string of ``span`` bytes is filed under its anchor: of all k-grams in it,
the one with the least hash, the leftmost among equals. Consecutive strings of
a text with one anchor make a piece, so equal strings lie in pieces with equal
anchors, and a string occurs in a piece once at most. Pieces are compared as
follows, each step over all texts.

1. A piece that occurs twice or more is repeated as a whole.
2. An anchor with a single different piece has no other repeats.
3. The different pieces of the remaining anchors are fetched and dealt into
   buckets by anchor. In a bucket, pieces form shards; each shard's suffixes are
   sorted once and kept as a Burrows-Wheeler transform, and the transforms are
   merged by refining their interleave: one round reads the transforms' symbols
   in the present interleave and sorts them stably, which orders all suffixes by
   one symbol more. Places where neighbours part give the common prefixes;
   suffixes that have not parted when ``span`` bytes are read are repeats.

A symbol of the transforms is a block of ``SYMBOL`` bytes, named by a 64-bit
hash; so five rounds read 200 bytes. Anchors with more than ``crowd`` different
pieces are cut anew under a second order of hashes, which splits their strings
into more groups without parting equal ones. Groups that are crowded even then,
as those of a passage that very many texts share, are compared string by string:
128-bit hashes of all their strings are counted over all tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.shared import ready, stored, text_bytes

SPAN = 200
GRAM = 48
SYMBOL = 40
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
CHUNK = 1 << 20  # bytes that are hashed at once; places in a chunk fit into 21 bits


@dataclass(frozen=True)
class Settings:
    crowd: int = 3_000  # different pieces of an anchor beyond which it is cut anew, and pieces then compared in one place
    bucket_bytes: int = 1_000_000
    shard_bytes: int = 300_000


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class RollingHash:
    """Hashes of all substrings of one length, from prefix sums modulo 2^64."""

    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self, size: int) -> None:
        names = np.random.default_rng(20_240_607).integers(0, 1 << 63, size=256, dtype=np.uint64)
        self.names = names * np.uint64(2) + np.uint64(1)
        powers = np.full(size + 1, self.BASE, dtype=np.uint64)
        powers[0] = 1
        self.powers = np.multiply.accumulate(powers)
        inverse = np.full(size + 1, pow(self.BASE, -1, 1 << 64), dtype=np.uint64)
        inverse[0] = 1
        self.inverse = np.multiply.accumulate(inverse)

    def of(self, data: np.ndarray, length: int) -> np.ndarray:
        """One hash for every start; data has at most ``size`` bytes."""
        n = len(data) - length + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.names[data] * self.powers[:len(data)], out=sums[1:])
        return _scrambled((sums[length:] - sums[:n]) * self.inverse[:n])


_rolling: dict[int, RollingHash] = {}


def rolling(size: int) -> RollingHash:
    size = max(CHUNK + 4 * SPAN, 1 << int(size).bit_length())
    if size not in _rolling:
        _rolling.clear()
        _rolling[size] = RollingHash(size)
    return _rolling[size]


def least_in_windows(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    done, now = 1, x
    while done * 2 <= width:
        now = np.minimum(now[:-done], now[done:])
        done *= 2
    return np.minimum(now[:len(x) - width + 1], now[width - done:]) if done < width else now


def anchors(data: np.ndarray, order: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of the anchor of every SPAN-byte string of a chunk."""
    grams = rolling(len(data)).of(data, GRAM)
    if order:
        grams = _scrambled(grams + np.uint64(order) * np.uint64(0xA0761D6478BD642F))
    ranked = (grams >> np.uint64(21) << np.uint64(21)) | np.arange(len(grams), dtype=np.uint64)
    place = least_in_windows(ranked, SPAN - GRAM + 1) & np.uint64((1 << 21) - 1)
    return grams, place.astype(np.int64)


def chunks(texts: list[bytes]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, number of the text, its offset in the text, its begin in the chunk) for runs of whole texts or parts of long ones.

    Parts of a long text overlap by SPAN - 1 bytes, so each string is in one chunk.
    """
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def pack() -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        lengths = np.array([len(part) for _, _, part in held])
        return (
            b"".join(part for _, _, part in held), np.array([n for n, _, _ in held]),
            np.array([at for _, at, _ in held]), np.cumsum(lengths) - lengths,
        )

    for nth, text in enumerate(texts):
        for at in range(0, max(0, len(text) - SPAN + 1), CHUNK - SPAN + 1):
            part = text[at:at + CHUNK]
            if size + len(part) > CHUNK and held:
                yield pack()
                held, size = [], 0
            held.append((nth, at, part))
            size += len(part)
    if held:
        yield pack()


def pieces(texts: list[bytes], order: int = 0) -> tuple[np.ndarray, ...]:
    """(text, start, strings, anchor, name) of the pieces of all texts; name is a hash of the piece's bytes."""
    found: list[tuple[np.ndarray, ...]] = []
    for data, numbers, offsets, begins in chunks(texts):
        grams, place = anchors(np.frombuffer(data, dtype=np.uint8), order)
        ends = np.append(begins[1:], len(data))
        owner = np.repeat(np.arange(len(begins)), ends - begins)
        starts = np.arange(len(place))
        whole = owner[starts] == owner[starts + SPAN - 1]  # no string goes from one text into the next
        starts = starts[whole]
        first = np.flatnonzero(np.concatenate(([True], (place[starts][1:] != place[starts][:-1]) | (owner[starts][1:] != owner[starts][:-1]))))
        begin = starts[first]
        count = np.diff(np.append(first, len(starts)))
        name = xxhash.xxh3_64_intdigest
        names = np.fromiter(
            (name(data[a:b]) for a, b in zip(begin.tolist(), (begin + count + SPAN - 1).tolist(), strict=True)),
            dtype=np.uint64, count=len(begin),
        )
        own = owner[begin]
        found.append((numbers[own], offsets[own] + begin - begins[own], count, grams[place[begin]], names))
    if not found:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    return tuple(np.concatenate(column) for column in zip(*found, strict=True))


@dataclass
class Transform:
    """A shard: of its suffixes in order, the symbol before each, whether there is one, and their places; the short ones stand first."""

    symbols: np.ndarray
    follows: np.ndarray
    places: np.ndarray
    short: int


def transform(parts: list[bytes]) -> tuple[Transform, np.ndarray, np.ndarray]:
    """The transform of a shard's pieces, with the number and offset of the piece for every place."""
    lengths = np.array([len(part) for part in parts])
    begins = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1]  # a place for the empty suffix of each
    data = np.frombuffer(b"\0".join(parts) + b"\0", dtype=np.uint8)
    number = np.repeat(np.arange(len(parts)), lengths + 1)
    offset = np.arange(len(data)) - begins[number]
    left = lengths[number] - offset
    names = np.zeros(len(data), dtype=np.uint64)
    hashes = rolling(len(data)).of(data, SYMBOL)
    names[:len(hashes)] = hashes
    short = np.flatnonzero(left < SYMBOL)
    order = np.concatenate((short, np.flatnonzero(left >= SYMBOL)))
    for _ in range(int(lengths.max()) // SYMBOL + 1):
        before = order[offset[order] >= SYMBOL] - SYMBOL
        order = np.concatenate((short, before[np.argsort(names[before], kind="stable")]))
    follows = offset[order] >= SYMBOL
    symbols = np.where(follows, names[np.where(follows, order - SYMBOL, 0)], 0)
    return Transform(symbols, follows, order, len(short)), number, offset


def merged_repeats(shards: list[Transform]) -> list[np.ndarray]:
    """For every shard, the places whose first SPAN bytes stand at another place too.

    The interleave is the list of shard numbers in the order of all suffixes.
    """
    sizes = [len(shard.places) for shard in shards]
    symbols = np.concatenate([shard.symbols for shard in shards])
    follows = np.concatenate([shard.follows for shard in shards])
    interleave = np.repeat(np.arange(len(shards), dtype=np.uint16), sizes)
    shorts = np.repeat(np.arange(len(shards), dtype=np.uint16), [shard.short for shard in shards])
    common = np.zeros(len(interleave), dtype=np.int64)  # equal numbers: not parted so far
    for _ in range(SPAN // SYMBOL):
        at = np.empty(len(interleave), dtype=np.int64)
        at[np.argsort(interleave, kind="stable")] = np.arange(len(interleave))
        use = follows[at]
        read = symbols[at[use]]
        order = np.argsort(read, kind="stable")
        read, group = read[order], common[use][order]
        parted = np.concatenate(([True], (read[1:] != read[:-1]) | (group[1:] != group[:-1])))[:len(read)]
        interleave = np.concatenate((shorts, interleave[use][order]))
        common = np.concatenate((np.arange(len(shorts)), len(shorts) + np.cumsum(parted) - 1))
    # Suffixes shorter than SPAN got numbers of their own when they ran out of symbols.
    again = (np.bincount(common) > 1)[common]
    again[:len(shorts)] = False
    return [shard.places[again[interleave == nth]] for nth, shard in enumerate(shards)]


def repeats_in(parts: list[bytes], shard_bytes: int) -> list[np.ndarray]:
    """Offsets of the repeated SPAN-byte strings of every piece."""
    shards, owners, sizes, at = [], [], 0, 0
    for nth, part in enumerate(parts):
        sizes += len(part)
        if sizes >= shard_bytes or nth == len(parts) - 1:
            shards.append(transform(parts[at:nth + 1]))
            owners.append(at)
            sizes, at = 0, nth + 1
    found: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(parts)
    for (_, number, offset), first, places in zip(shards, owners, merged_repeats([s[0] for s in shards]), strict=True):
        places = np.sort(places)
        cuts = np.flatnonzero(np.diff(number[places])) + 1
        for own in np.split(places, cuts) if len(places) else []:
            found[first + int(number[own[0]])] = offset[own]
    return found


def scanned(docs: DataFrame) -> DataFrame:
    """A row per document: _row, doc_id, two hashes of the text, its bytes, its SHA-256 and its pieces."""
    ready(docs)
    piece = pa.struct([("anchor", pa.int64()), ("name", pa.int64()), ("place", pa.int64())])

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            number, start, count, anchor, name = pieces(texts)
            place = start * 256 + count
            rows = pa.StructArray.from_arrays(
                [pa.array(anchor.view(np.int64)), pa.array(name.view(np.int64)), pa.array(place)], fields=list(piece)
            )
            bounds = np.searchsorted(number, np.arange(len(texts) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("_row", "doc_id", "h1", "h2")] + [
                    pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
                    pa.ListArray.from_arrays(pa.array(bounds), rows),
                ], ["_row", "doc_id", "h1", "h2", "n_bytes", "sha256", "pieces"],
            )

    return keyed(docs).withColumn("_row", F.monotonically_increasing_id()).mapInArrow(
        of_batches, "_row long, doc_id long, h1 long, h2 long, n_bytes long, sha256 string, "
        "pieces array<struct<anchor:long,name:long,place:long>>"
    )


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text as bytes, and a 128-bit key of the text."""
    with_bytes = docs.select("doc_id", text_bytes().alias("text"))
    return with_bytes.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text")})


def _looked_up(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Texts with what is wanted of them, by the key of the text; a shuffle join at every size."""
    return keyed(docs).join(wanted.hint("merge"), ["h1", "h2"])


def fetched(docs: DataFrame, open_: DataFrame, scan: DataFrame) -> DataFrame:
    """The bytes of open pieces: anchor, part, _row, start, wanted (its repeats are to be reported)."""
    per_row = open_.groupBy("_row").agg(F.collect_list(F.struct("anchor", "name", "place", "wanted", "crowded")).alias("pieces"))
    wanted = per_row.join(scan.select("_row", "h1", "h2"), "_row")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ("anchor", "name", "part", "_row", "start", "wanted")
        for batch in batches:
            out: list[tuple] = []
            for text, row, own in zip(*(batch.column(c).to_pylist() for c in ("text", "_row", "pieces")), strict=True):
                for p in own:
                    start, count = p["place"] >> 8, p["place"] & 255
                    part = text[start:start + count + SPAN - 1]
                    if not p["crowded"]:
                        out.append((p["anchor"], p["name"], part, row, start, p["wanted"]))
                        continue
                    for _, a, n, second, name in zip(*(x.tolist() for x in pieces([part], order=1)), strict=True):
                        both = xxhash.xxh3_64_intdigest(f"{p['anchor']} {second}".encode())
                        out.append((both - (1 << 63), name - (1 << 63), part[a:a + n + SPAN - 1], row, start + a, p["wanted"]))
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)], list(columns)
            )

    texts = _looked_up(docs, wanted).select("text", "_row", "pieces")
    found = texts.mapInArrow(cut, "anchor long, name long, part binary, _row long, start long, wanted boolean")
    return found.dropDuplicates(["anchor", "name", "_row", "start"])  # a text that stands in several rows is fetched by each


def merged(found: DataFrame, settings: Settings) -> DataFrame:
    """(_row, low, high): byte ranges that are repeated, from the pieces of every bucket."""
    total = found.agg(F.sum(F.octet_length("part"))).first()[0] or 0
    buckets = max(1, -(-total // settings.bucket_bytes))

    def of_bucket(table: pa.Table) -> pa.Table:
        parts, wanted = table["part"].to_pylist(), table["wanted"].to_pylist()
        places: dict[bytes, int] = {}
        index = [places.setdefault(part, len(places)) for part in parts]  # cut pieces can be equal
        times = np.bincount(index)
        each = repeats_in(list(places), settings.shard_bytes)
        rows, low, high = [], [], []
        for nth, row, start, part, report in zip(index, table["_row"].to_pylist(), table["start"].to_pylist(), parts, wanted, strict=True):
            if not report:
                continue
            offsets = each[nth] if times[nth] == 1 else np.arange(len(part) - SPAN + 1)
            if len(offsets):
                cuts = np.flatnonzero(np.diff(offsets) > 1) + 1
                for own in np.split(offsets, cuts):
                    rows.append(row)
                    low.append(start + int(own[0]))
                    high.append(start + int(own[-1]) + SPAN)
        return pa.table({"_row": pa.array(rows, pa.int64()), "low": pa.array(low, pa.int64()), "high": pa.array(high, pa.int64())})

    return found.withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets))).groupBy("bucket").applyInArrow(
        lambda table: of_bucket(table), "_row long, low long, high long"
    )


def by_strings(found: DataFrame) -> DataFrame:
    """(_row, low, high): byte ranges that are repeated, from counts of the pieces' strings; no group is ever in one place."""
    string = pa.struct([("h1", pa.int64()), ("h2", pa.int64())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, sizes = [], []
            for part in batch.column("part").to_pylist():
                n = len(part) - SPAN + 1
                digests = b"".join(xxhash.xxh3_128_digest(part[i:i + SPAN]) for i in range(n))
                hashes.append(np.frombuffer(digests, dtype=np.int64).reshape(-1, 2))
                sizes.append(n)
            both = np.concatenate(hashes) if hashes else np.zeros((0, 2), dtype=np.int64)
            strings = pa.StructArray.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], fields=list(string))
            bounds = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("_row", "start", "wanted")), pa.ListArray.from_arrays(bounds, strings)],
                ["_row", "start", "wanted", "strings"],
            )

    parts = found.select("part", "_row", "start", "wanted").mapInArrow(
        hashed, "_row long, start long, wanted boolean, strings array<struct<h1:long,h2:long>>"
    )
    # Stored, so that both sides of the join are plain shuffles, of which adaptive execution splits a hot string's.
    each = stored(parts.select("_row", "start", "wanted", F.posexplode("strings").alias("at", "s")).select(
        "_row", "start", "wanted", "at", "s.h1", "s.h2"
    ))
    again = stored(each.groupBy("h1", "h2").count().filter("count > 1").select("h1", "h2"))
    low = F.col("start") + F.col("at")
    spans = each.filter("wanted").join(again, ["h1", "h2"], "left_semi").groupBy("_row", "start").agg(
        F.collect_list(F.struct(low.alias("low"), (low + SPAN).alias("high"))).alias("spans")
    )
    return spans.select("_row", F.explode(_united("spans")).alias("s")).select("_row", "s.low", "s.high")


def compared(found: DataFrame, settings: Settings) -> DataFrame:
    """(_row, low, high) of all open pieces: groups of at most ``crowd`` pieces in buckets, larger ones by strings."""
    crowds = stored(found.groupBy("anchor").count().filter(F.col("count") > settings.crowd).select("anchor"))
    few = merged(found.join(crowds, "anchor", "left_anti"), settings)
    return few.unionByName(by_strings(found.join(crowds, "anchor", "left_semi")))


def _united(spans: str | Column) -> Column:
    """Sorted ranges with those that touch made one."""
    empty = F.array().cast("array<struct<low:bigint,high:bigint>>")
    return F.aggregate(F.array_sort(spans), empty, lambda done, s: F.when(
        (F.size(done) > 0) & (F.element_at(done, -1)["high"] >= s["low"]),
        F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
            F.element_at(done, -1)["low"].alias("low"), F.greatest(F.element_at(done, -1)["high"], s["high"]).alias("high"),
        ))),
    ).otherwise(F.concat(done, F.array(s))))


def repeated_spans(docs: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """The scan of the documents, and (_row, spans): maximal ranges of bytes that repeated strings cover."""
    scan = stored(scanned(docs))
    each = scan.select("_row", F.explode("pieces").alias("p")).select("_row", "p.*")
    # An anchor that stands once in all texts has no repeats; most pieces end here.
    # Stored, so that both sides of the join are plain shuffles, of which adaptive execution splits a hot anchor's.
    standing = stored(each.groupBy("anchor").count().filter("count > 1").select("anchor"))
    each = stored(each.join(standing, "anchor", "left_semi"))
    # Row and place are those of one occurrence: the only one, or any to fetch the bytes from.
    kinds = stored(each.groupBy("anchor", "name").agg(
        F.count("*").alias("n"), F.first("_row").alias("_row"), F.first("place").alias("place")
    ))
    shared = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    open_ = kinds.join(shared, "anchor").select(
        "anchor", "name", "_row", "place", (F.col("n") == 1).alias("wanted"), (F.col("kinds") > settings.crowd).alias("crowded")
    )
    whole = each.join(kinds.filter("n > 1").select("anchor", "name"), ["anchor", "name"]).select(
        "_row", F.expr("place div 256").alias("low"), F.expr(f"place div 256 + place % 256 + {SPAN - 1}").alias("high")
    )
    parts = stored(compared(stored(fetched(docs, open_, scan)), settings))
    ranges = whole.unionByName(parts).groupBy("_row").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    return scan, ranges.select("_row", _united("spans").alias("spans"))


def without_repeats(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes, null where nothing is removed) of every row.

    Null texts are empty. A row that repeats another repeats all its strings,
    so nothing of either stays if it has ``SPAN`` bytes. An empty table gives
    no rows; other columns are not read.
    """
    scan, spans = repeated_spans(docs, settings)
    spans = stored(spans)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["high"] - s["low"])
    judged = stored(scan.select("_row", "doc_id", "h1", "h2", "n_bytes", "sha256").join(spans, "_row", "left").withColumn(
        "n_removed", F.coalesce(removed, F.lit(0))
    ))
    partial = judged.filter((F.col("n_removed") > 0) & (F.col("n_removed") < F.col("n_bytes")))
    # Equal texts have equal spans, unless all of them are gone; so a key has one row here.
    wanted = partial.select("h1", "h2", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for text, own in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                ends = [0] + [s["high"] for s in own]
                starts = [s["low"] for s in own] + [len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(ends, starts, strict=True)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("h1"), batch.column("h2"), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), pa.array(kept, pa.binary())],
                ["h1", "h2", "sha_left", "kept"],
            )

    left = _looked_up(docs, wanted).select("h1", "h2", "text", "spans").mapInArrow(
        cut, "h1 long, h2 long, sha_left string, kept binary"
    )
    whole = judged.filter((F.col("n_removed") == 0) | (F.col("n_removed") == F.col("n_bytes"))).select(
        "doc_id", "n_bytes", "n_removed", "spans",
        F.when(F.col("n_removed") == 0, F.col("sha256")).otherwise(F.lit(EMPTY_SHA)).alias("kept_sha256"),
        F.when(F.col("n_removed") > 0, F.lit(b"")).alias("kept"),
    )
    rest = partial.join(left, ["h1", "h2"]).select(
        "doc_id", "n_bytes", "n_removed", "spans", F.col("sha_left").alias("kept_sha256"), "kept"
    )
    return whole.unionByName(rest).select(
        "doc_id", "n_bytes", "n_removed", F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"), "kept_sha256", "kept", "spans"
    )
