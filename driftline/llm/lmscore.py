"""Language-model scores from a log-frequency Bloom filter.

Training texts are counted in one pass: every task sums the unigrams and
bigrams of its texts, cuts the sums into buckets of a 64-bit hash, and a bucket
is summed in one place. Counts c are quantised to levels 1 + floor(log c /
log base); an n-gram is put into the filter once for every level up to its own,
so its level is found by asking for level 1, 2, ... until the answer is no. A
filter has a block per bucket, as large as the bucket's entries need, so the
rate of wrong answers does not depend on the size of the corpus. Inside a
bucket an n-gram is known by 32 bits of its hash; words have exact counts by
64 bits besides.

A filter of at most ``filter_bits`` is broadcast. A larger one stays in its
blocks: texts are kept as slices of word hashes, the different n-grams of a
slice are sent to the blocks of their buckets, and the levels come back to the
slice. Probabilities are smoothed towards unigrams:
    p(w | v) = (c(v w) + k p(w)) / (c(v) + k),  p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1))
with all counts from the filter. The base score uses exact counts: those of the
``broadcast_words`` most frequent words are broadcast, those of all others are
joined by shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.shared import drop_unused_shuffles, ready, stored, text_bytes

END = b"\n"  # no word has it
HELD_OUT_DIVISOR = 5
CACHED_WORDS = 200_000
WORDS_HELD = 50_000  # as Python objects, before they are hashed
KEYS_AT_ONCE = 1 << 17  # of a bucket, while its block is filled
PROBES_IN_A_ROW = 1024  # so that a batch of rows stays small
ARROW_BITS = 8 * ((1 << 31) - 64)  # of one value; the text of a bucket needs far fewer


@dataclass(frozen=True)
class Settings:
    base: float = 1.5  # of the logarithm that quantises counts
    bits_per_entry: int = 10
    hashes: int = 4
    filter_bits: int = 1 << 26  # 8 MB, up to which the filter is broadcast; one way of scoring for all that is larger
    broadcast_words: int = 1_000_000
    bucket_bytes: int = 12_000_000  # text per counting bucket, which one task holds
    strength: float = 4.0  # k above
    slice_words: int = 250_000


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def unigram_keys(words: np.ndarray) -> np.ndarray:
    return mixed(words + np.uint64(0x9E3779B97F4A7C15))


def bigram_keys(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mixed(mixed(before) * np.uint64(3) + words)


def buckets_of(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def inner(keys: np.ndarray) -> np.ndarray:
    """What tells the keys of a bucket apart: 32 bits, for a bucket has a few million entries and wrong answers are commoner by far."""
    return keys & np.uint64(0xFFFFFFFF)


class HashedWords(dict):
    """Hashes of the words asked for so far."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = word_hash(word)
        return found


class Slices:
    """Word hashes of texts, in slices of bounded length that may cut a text."""

    def __init__(self, words_at_once: int) -> None:
        self.words_at_once, self.cache = words_at_once, HashedWords()

    def hashes(self, words: list[bytes]) -> np.ndarray:
        if len(self.cache) > CACHED_WORDS:
            self.cache.clear()
        return np.fromiter(map(self.cache.__getitem__, words), dtype=np.uint64, count=len(words))

    def of(self, texts: Iterator[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(hashes, hashes of the words before, number of the text); before a text stands an end."""
        waiting: list[bytes] = []
        hashed, owners, sizes, starts, held, last = [], [], [], [], 0, END

        def flush() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            nonlocal held
            own = np.concatenate([*hashed, self.hashes(waiting)])
            lengths = np.array(sizes)
            before = np.roll(own, 1)
            before[np.cumsum(lengths) - lengths] = self.hashes(starts)
            out = own, before, np.repeat(np.array(owners), lengths)
            waiting.clear(), hashed.clear(), owners.clear(), sizes.clear(), starts.clear()
            held = 0
            return out

        for nth, text in enumerate(texts):
            words = text.lower().split()  # of bytes: A-Z and ASCII white space only
            words.append(END)
            last = END
            for at in range(0, len(words), self.words_at_once):
                part = words[at:at + self.words_at_once]
                waiting += part
                owners.append(nth)
                sizes.append(len(part))
                starts.append(last)
                last = part[-1]
                held += len(part)
                if held >= self.words_at_once:
                    yield flush()
                elif len(waiting) >= WORDS_HELD:
                    hashed.append(self.hashes(waiting))
                    waiting.clear()
        if sizes:
            yield flush()


def levels(counts: np.ndarray, base: float) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / math.log(base) + 1e-9).astype(np.int64)


def level_values(base: float, most: int = 130) -> np.ndarray:
    """The count that stands for a level: the middle of its range; 0 for level 0."""
    values = (base ** np.arange(-1, most - 1) + base ** np.arange(0, most)) / 2
    values[0], values[1] = 0.0, 1.0
    return values


def bit_places(keys: np.ndarray, level: np.ndarray | int, sizes: np.ndarray, hashes: int) -> Iterator[np.ndarray]:
    y = mixed(keys + np.asarray(level, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    step = mixed(y) | np.uint64(1)
    for _ in range(hashes):
        yield y % sizes
        y = y + step


def filter_block(keys: np.ndarray, counts: np.ndarray, most_bits: int, settings: Settings) -> np.ndarray:
    """Bytes of a bucket's block."""
    level = levels(counts, settings.base)
    size = max(64, min(most_bits, int(level.sum()) * settings.bits_per_entry)) // 8 * 8
    bits, sizes = np.zeros(size, dtype=bool), np.uint64(size)
    for first in range(0, len(keys), KEYS_AT_ONCE):
        some, own = inner(keys[first:first + KEYS_AT_ONCE]), level[first:first + KEYS_AT_ONCE]
        for nth in range(1, int(own.max(initial=0)) + 1):
            for place in bit_places(some[own >= nth], nth, sizes, settings.hashes):
                bits[place] = True
    return np.packbits(bits, bitorder="little")


def smoothed(own: np.ndarray, context: np.ndarray, both: np.ndarray, unit: float, k: float) -> np.ndarray:
    """log10 p(w | v) from the counts of the word, the word before and both."""
    return np.log10((np.minimum(both, context) + k * (own + 0.5) / unit) / (context + k))


@dataclass
class Model:
    bits: np.ndarray  # of all blocks; none if the filter is not broadcast
    block_starts: np.ndarray  # in bits, one more than blocks
    words: np.ndarray  # sorted hashes of the broadcast words
    counts: np.ndarray
    all_words: bool  # the broadcast words are all training words
    train_tokens: int
    train_words: int
    entries: int
    settings: Settings
    blocks: DataFrame | None = None  # (bucket, block) of a filter that is not broadcast

    @property
    def false_positive_rate(self) -> float:
        total = max(1, int(self.block_starts[-1]))
        return float((1 - math.exp(-self.settings.hashes * self.entries / total)) ** self.settings.hashes)

    def filter_levels(self, keys: np.ndarray) -> np.ndarray:
        """Levels by repeated membership probes, 0 for what is not in the filter."""
        n = len(self.block_starts) - 1
        level = np.zeros(len(keys), dtype=np.int64)
        alive, nth = np.arange(len(keys)), 1
        blocks, keys = buckets_of(keys, n).astype(np.int64), inner(keys)
        while n and len(alive) and nth < 120:
            block = blocks[alive]
            starts = self.block_starts[block]
            sizes = (self.block_starts[block + 1] - starts).astype(np.uint64)
            there = np.ones(len(alive), dtype=bool)
            for place in bit_places(keys[alive], nth, np.maximum(sizes, np.uint64(1)), self.settings.hashes):
                at = starts + place.astype(np.int64)
                there &= (self.bits[np.minimum(at >> 3, len(self.bits) - 1)] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            there &= sizes > 0
            alive = alive[there]
            level[alive] = nth
            nth += 1
        return level

    def filter_counts(self, keys: np.ndarray) -> np.ndarray:
        """Quantised counts."""
        return level_values(self.settings.base)[self.filter_levels(keys)]

    def exact_counts(self, words: np.ndarray) -> np.ndarray:
        """Exact counts of broadcast words, -1 for others."""
        if not len(self.words):
            return np.full(len(words), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, self.counts[at], -1)

    @property
    def unit(self) -> float:
        return self.train_tokens + 0.5 * (self.train_words + 1)

    def log_probabilities(self, words: np.ndarray, before: np.ndarray) -> np.ndarray:
        kinds, place = np.unique(np.concatenate((words, before)), return_inverse=True)
        single = self.filter_counts(unigram_keys(kinds))
        own, context = single[place[: len(words)]], single[place[len(words):]]
        both = self.filter_counts(bigram_keys(before, words))
        return smoothed(own, context, both, self.unit, self.settings.strength)

    def base_parts(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every word: whether its exact count is at hand, whether it is known, and its part of the base score."""
        kinds, place = np.unique(words, return_inverse=True)
        resolved, known, part = self.base_parts_of_kinds(kinds)
        return resolved[place], known[place], part[place]

    def base_parts_of_kinds(self, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for different words in the order of their hashes."""
        exact = self.exact_counts(kinds)
        resolved = exact >= 0 if not self.all_words else np.ones(len(kinds), dtype=bool)
        count = np.maximum(exact, 0)
        return resolved, count > 0, np.where(resolved, np.log10((count + 0.5) / self.unit), 0.0)


def count_ngrams(texts: DataFrame, settings: Settings) -> tuple[DataFrame, int]:
    """(bucket, word, n, block, entries): word rows with exact counts, and a row with each bucket's filter block; number of buckets."""
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(1, -(-total // settings.bucket_bytes))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = Slices(settings.slice_words * 4)
        texts = (x.as_py() for batch in batches for x in batch.column("text"))
        for own, before, _ in slices.of(texts):
            for kind, keys in ((1, own), (2, bigram_keys(before, own))):
                keys, n = np.unique(keys, return_counts=True)
                if kind == 1:
                    order_key = buckets_of(unigram_keys(keys), n_buckets)
                    order = np.argsort(order_key, kind="stable")
                    keys, n, order_key = keys[order], n[order], order_key[order]
                else:
                    order_key = buckets_of(keys, n_buckets)  # sorted, as the keys are
                cuts = np.flatnonzero(np.concatenate(([True], order_key[1:] != order_key[:-1], [True]))) if len(keys) else np.zeros(1, int)
                pairs = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array([int(order_key[a]) for a, _ in pairs], pa.int32()),
                    "kind": pa.array([kind] * len(pairs), pa.int32()),
                    "keys": pa.array([(keys[a:b] if kind == 1 else inner(keys[a:b]).astype(np.uint32)).tobytes() for a, b in pairs], pa.binary()),
                    "counts": pa.array([n[a:b].astype(np.uint32).tobytes() for a, b in pairs], pa.binary()),
                })

    def summed(table: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray]:
        rows = table.filter(pa.compute.equal(table["kind"], kind))
        stored_as = np.uint64 if kind == 1 else np.uint32
        keys = np.concatenate([np.frombuffer(x, dtype=stored_as) for x in rows["keys"].to_pylist()] or [np.zeros(0, stored_as)])
        counts = np.concatenate([np.frombuffer(x, dtype=np.uint32) for x in rows["counts"].to_pylist()] or [np.zeros(0, np.uint32)])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, int)
        return keys[first], np.add.reduceat(counts, first) if len(first) else counts

    def whole(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        words, n_words = summed(table, 1)
        pairs, n_pairs = summed(table, 2)
        keys, counts = np.concatenate((unigram_keys(words), pairs.astype(np.uint64))), np.concatenate((n_words, n_pairs))
        block = filter_block(keys, counts, ARROW_BITS, settings)
        rows = len(words) + 1
        return pa.table({
            "bucket": pa.array(np.full(rows, bucket, dtype=np.int32)),
            "word": pa.concat_arrays([pa.array(words.view(np.int64)), pa.nulls(1, pa.int64())]),
            "n": pa.concat_arrays([pa.array(n_words.astype(np.int64)), pa.nulls(1, pa.int64())]),
            "block": pa.array([None] * len(words) + [block.tobytes()], pa.binary()),
            "entries": pa.array([None] * len(words) + [int(levels(counts, settings.base).sum())], pa.int64()),
        })

    sums = texts.mapInArrow(partial, "bucket int, kind int, keys binary, counts binary")
    return sums.groupBy("bucket").applyInArrow(whole, "bucket int, word long, n long, block binary, entries long"), n_buckets


def fit(docs: DataFrame, usable: Column | None = None, settings: Settings = Settings()) -> tuple[Model, DataFrame]:
    """The model and the table of exact word counts (word, n) of all texts that ``usable`` admits.

    Null and blank texts count as their end token alone, repeated rows each
    time; rows for which ``usable`` is null are left out. Without any text all counts are 0.
    """
    ready(docs)
    texts = (docs if usable is None else docs.filter(usable)).select(text_bytes().alias("text"))
    counted, n_buckets = count_ngrams(texts, settings)
    counted = stored(counted)
    drop_unused_shuffles(docs.sparkSession)
    words = counted.filter("block IS NULL").select("word", "n")
    n_words, n_tokens = words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # At most broadcast_words rows, filter_bits bits and the sizes of the blocks reach the driver.
    top = (words if n_words <= settings.broadcast_words else words.orderBy(F.desc("n"), "word").limit(settings.broadcast_words)).toArrow()
    hashes = top["word"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    blocks = counted.filter("block IS NOT NULL").select("bucket", "block")
    sizes, parts, entries = np.zeros(n_buckets, dtype=np.int64), [b""] * n_buckets, 0
    measured = counted.filter("block IS NOT NULL").select("bucket", F.octet_length("block").alias("size"), "entries")
    for row in measured.toArrow().to_pylist():
        sizes[row["bucket"]] = 8 * row["size"]
        entries += row["entries"]
    fits = sizes.sum() <= settings.filter_bits
    if fits:
        for row in blocks.toArrow().to_pylist():
            parts[row["bucket"]] = row["block"]
    bits = np.frombuffer(b"".join(parts) or b"\0", dtype=np.uint8)
    model = Model(
        bits, np.concatenate(([0], np.cumsum(sizes))), hashes[order], top["n"].to_numpy()[order].astype(np.int64),
        n_words <= settings.broadcast_words, n_tokens, n_words, entries, settings, None if fits else blocks,
    )
    return model, words


def score(docs: DataFrame, model: Model, words: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row.

    Null and blank texts are their end token alone. Without training texts all
    counts are 0. Repeated rows get a row each, an empty table gives none.
    """
    spark = ready(docs)
    if model.blocks is not None:
        scored = _scored_in_blocks(docs, model)
        if not model.all_words:
            scored = _with_rare_words(stored(scored), words, model.unit)
        return _columns(scored, model)
    shared_model = spark.sparkContext.broadcast(model)  # bounded by the settings

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared_model.value
        slices = Slices(model.settings.slice_words)
        for batch in batches:
            rows = batch.num_rows
            tokens, known, base, score = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows), np.zeros(rows)
            open_words: list[list[int]] = [[] for _ in range(rows)]
            for own, before, owner in slices.of(x.as_py() for x in batch.column("text")):
                resolved, there, add = model.base_parts(own)
                for total, values in ((tokens, None), (known, there), (base, add), (score, model.log_probabilities(own, before))):
                    total += np.bincount(owner, values, minlength=rows).astype(total.dtype)
                for i in np.flatnonzero(~resolved).tolist():
                    open_words[owner[i]].append(int(own[i]) - (1 << 64) * (int(own[i]) >> 63))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n_tokens": tokens, "n_known": known, "base_score": base, "score": score,
                "open_words": pa.array(open_words, pa.list_(pa.int64())),
            })

    schema = "doc_id long, n_tokens long, n_known long, base_score double, score double, open_words array<long>"
    scored = docs.select("doc_id", text_bytes().alias("text")).mapInArrow(of_batches, schema)
    if not model.all_words:
        scored = _with_rare_words(stored(scored.withColumn("_row", F.monotonically_increasing_id())), words, model.unit)
    return _columns(scored, model)


def _columns(scored: DataFrame, model: Model) -> DataFrame:
    return scored.select(
        "doc_id", "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )


def _bucket_runs(keys: np.ndarray, n_buckets: int) -> list[tuple[int, bytes]]:
    """(bucket, inner keys of some of its keys) of sorted keys, in their order, which is that of their buckets."""
    bucket = buckets_of(keys, n_buckets)
    cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))).tolist()
    return [
        (int(bucket[a]), inner(keys[first:min(first + PROBES_IN_A_ROW, b)]).astype(np.uint32).tobytes())
        for a, b in zip(cuts[:-1], cuts[1:], strict=True) for first in range(a, b, PROBES_IN_A_ROW)
    ]


def _slice_words(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of a kept slice's different words, and the numbers among them of its words and of the words before."""
    kinds, sizes = np.frombuffer(row["kinds"], dtype=np.uint64), np.frombuffer(row["sizes"], dtype=np.int32)
    own = np.frombuffer(row["own"], dtype=np.int32)
    before = np.roll(own, 1)
    before[np.cumsum(sizes) - sizes] = np.frombuffer(row["starts"], dtype=np.int32)
    return kinds, own, before


def _scored_in_blocks(docs: DataFrame, model: Model) -> DataFrame:
    """Scores by a filter that stays in its blocks; n-grams go to the blocks and levels come back by shuffle."""
    settings, unit, n_buckets = model.settings, model.unit, len(model.block_starts) - 1
    blocks = model.blocks
    shared_model = docs.sparkSession.sparkContext.broadcast(replace(model, blocks=None))
    empty = np.zeros(0, dtype=np.uint64)
    block_model = replace(model, bits=empty, words=empty, counts=empty, blocks=None)

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, first_id = shared_model.value, TaskContext.get().partitionId() << 40
        ids: dict[int, int | None] = {}

        def texts() -> Iterator[bytes]:
            nth = 0
            for batch in batches:
                for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                    ids[nth] = doc_id.as_py()
                    nth += 1
                    yield text.as_py()

        for nth, (own, before, owner) in enumerate(Slices(settings.slice_words).of(texts())):
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            sizes = np.diff(np.append(first, len(own)))
            kinds, place = np.unique(np.concatenate((own, before[first])), return_inverse=True)
            place = place.astype(np.int32)
            resolved, there, add = (values[place[:len(own)]] for values in model.base_parts_of_kinds(kinds))
            open_at = np.flatnonzero(~resolved)
            rare = pa.ListArray.from_arrays(
                pa.array(np.searchsorted(open_at, np.append(first, len(own))).astype(np.int32)), pa.array(own[open_at].view(np.int64))
            )
            rows, n = owner[first].tolist(), len(first)
            yield pa.RecordBatch.from_pydict({
                "slice": pa.array([None] * n + [first_id + nth], pa.int64()),
                "_row": pa.array([first_id + i for i in rows] + [None], pa.int64()),
                "doc_id": pa.array([ids[i] for i in rows] + [None], pa.int64()),
                "n_tokens": pa.array([*sizes.tolist(), None], pa.int64()),
                "n_known": pa.array([*np.add.reduceat(there.astype(np.int64), first).tolist(), None], pa.int64()),
                "base_score": pa.array([*np.add.reduceat(add, first).tolist(), None], pa.float64()),
                "open_words": pa.concat_arrays([rare, pa.nulls(1, rare.type)]),
                **{
                    name: pa.array([None] * n + [values.tobytes()], pa.binary()) for name, values in (
                        ("kinds", kinds), ("own", place[:len(own)]), ("starts", place[len(own):]),
                        ("sizes", sizes.astype(np.int32)), ("rows", first_id + owner[first].astype(np.int64)),
                    )
                },
            })
            for i in [i for i in ids if i < rows[-1]]:
                del ids[i]

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                kinds, own, before = _slice_words(row)
                for kind, keys in ((1, np.sort(unigram_keys(kinds))), (2, np.unique(bigram_keys(kinds[before], kinds[own])))):
                    runs = _bucket_runs(keys, n_buckets)
                    yield pa.RecordBatch.from_pydict({
                        "slice": pa.array([row["slice"]] * len(runs), pa.int64()), "kind": pa.array([kind] * len(runs), pa.int32()),
                        "part": pa.array(range(len(runs)), pa.int32()),
                        "bucket": pa.array([bucket for bucket, _ in runs], pa.int32()), "keys": pa.array([keys for _, keys in runs], pa.binary()),
                    })

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by bucket, each bucket's block in front of its probes; one block and one batch are in memory."""
        place, filter_of = None, None
        for batch in batches:
            where = list(zip(batch.column("bucket").to_pylist(), batch.column("copy").to_pylist(), strict=True))
            block, keys = batch.column("block"), batch.column("keys")
            sizes = pa.compute.fill_null(pa.compute.binary_length(keys), 0).to_numpy() // 4
            levels_of, first = [], 0
            while first < len(where):
                if block[first].is_valid:
                    bits = np.frombuffer(block[first].as_py(), dtype=np.uint8)
                    place, filter_of = where[first], replace(block_model, bits=bits, block_starts=np.array([0, 8 * len(bits)]))
                    levels_of.append(None)
                    first += 1
                    continue
                end, held = first + 1, int(sizes[first])
                while end < len(where) and where[end] == where[first] and held < settings.slice_words:
                    held += int(sizes[end])
                    end += 1
                asked = np.frombuffer(b"".join(keys[first:end].to_pylist()), dtype=np.uint32).astype(np.uint64)
                there = place == where[first] and len(filter_of.bits)
                level = filter_of.filter_levels(asked).astype(np.uint8).tobytes() if there else bytes(len(asked))
                ends = np.cumsum(sizes[first:end]).tolist()
                levels_of += [level[a:b] for a, b in zip([0, *ends], ends, strict=False)]
                first = end
            probes_only = block.is_null()
            yield pa.RecordBatch.from_arrays(
                [c.filter(probes_only) for c in (*map(batch.column, ("slice", "kind", "part")), pa.array(levels_of, pa.binary()))],
                ["slice", "kind", "part", "levels"],
            )

    def gathered(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        (row,) = (r for r in rows if r["kind"] is None)
        values = level_values(settings.base)
        single, double = (
            values[np.frombuffer(b"".join(
                r["levels"] for r in sorted((r for r in rows if r["kind"] == kind), key=lambda r: r["part"])
            ), dtype=np.uint8)] for kind in (1, 2)
        )
        kinds, own, before = _slice_words(row)
        one = np.empty(len(kinds))
        one[np.argsort(unigram_keys(kinds))] = single
        pair = np.unique(bigram_keys(kinds[before], kinds[own]), return_inverse=True)[1]
        logs = smoothed(one[own], one[before], double[pair], unit, settings.strength)
        sizes = np.frombuffer(row["sizes"], dtype=np.int32)
        return pa.table({
            "_row": np.frombuffer(row["rows"], dtype=np.int64), "score": np.add.reduceat(logs, np.cumsum(sizes) - sizes),
        })

    hashes = "kinds binary, own binary, starts binary, sizes binary, rows binary"
    kept = stored(docs.select("doc_id", text_bytes().alias("text")).mapInArrow(
        sliced, "slice long, _row long, doc_id long, n_tokens long, n_known long, base_score double, "
        f"open_words array<long>, {hashes}"
    ))
    slices = kept.filter("slice IS NOT NULL").select("slice", "kinds", "own", "starts", "sizes", "rows")
    # A bucket's probes are split over copies of its block where far more text is scored than was learnt from.
    n_tokens = kept.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    copies = max(1, -(-n_tokens // max(1, 2 * model.train_tokens)))
    asked = slices.mapInArrow(probes, "slice long, kind int, part int, bucket int, keys binary").withColumn("copy", F.pmod("slice", F.lit(copies)))
    there = blocks.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))))
    dealt = asked.unionByName(there, allowMissingColumns=True).repartition("bucket", "copy")
    found = stored(dealt.sortWithinPartitions("bucket", "copy", F.col("block").isNull()).mapInArrow(
        answered, "slice long, kind int, part int, levels binary"
    ))
    del asked, there, dealt
    drop_unused_shuffles(docs.sparkSession)
    scores = slices.unionByName(found, allowMissingColumns=True).groupBy("slice").applyInArrow(gathered, "_row long, score double")
    parts = kept.filter("slice IS NULL").select("_row", "doc_id", "n_tokens", "n_known", "base_score", "open_words")
    return parts.unionByName(scores, allowMissingColumns=True).groupBy("_row").agg(
        F.max("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"),
        F.sum("base_score").alias("base_score"), F.sum("score").alias("score"),
        F.flatten(F.collect_list("open_words")).alias("open_words"),
    )


def _with_rare_words(scored: DataFrame, words: DataFrame, unit: float) -> DataFrame:
    """Add what the words that are not broadcast contribute to the base score."""
    rare = scored.select("_row", F.explode("open_words").alias("word")).groupBy("_row", "word").count()
    n = F.coalesce(F.col("n"), F.lit(0))
    added = rare.join(words, "word", "left").groupBy("_row").agg(
        F.sum(F.col("count") * F.log10((n + 0.5) / unit)).alias("more"),
        F.sum(F.when(n > 0, F.col("count")).otherwise(0)).alias("more_known"),
    )
    return scored.join(added, "_row", "left").withColumns({
        "base_score": F.col("base_score") + F.coalesce("more", F.lit(0.0)),
        "n_known": F.col("n_known") + F.coalesce("more_known", F.lit(0)),
    })
