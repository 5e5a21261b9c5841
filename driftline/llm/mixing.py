"""Mixing sources to target weights, in DataFrame functions only.

The words of a source are laid end to end, documents in a pseudorandom order,
and packed into blocks of ``block`` words. A source's target in words gives its
slots: whole passes over its blocks and a part of one more pass, whose last
slot is cut so that the words add up to the target. Every output shard draws
multinomial source counts, one draw per position; a source's draws beyond its
slots are void, and what the shards have left of it goes to the last shard.
The n-th slot of a source is mapped through the source's own pseudorandom
permutation of block numbers, one per pass, and blocks are joined by number.

Permutations are swap-or-not shuffles: 16 rounds in which a number and its
partner may change places, a bijection of any range that needs no table.
Nothing is random in a rerun: all draws are hashes of numbers and doc_ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.shared import BLANKS, stored

WEIGHTS = (5, 2, 1)
EXPANSION = (3, 2)  # the mix has 3/2 of all words
MOST_PASSES = 2
BLOCK = 256
SHARDS = 64
ROUNDS = 16
PRIME = 2_147_483_647
CHUNK = 2_000
ROWS_PER_BUCKET = 2_000
BROADCAST_ROWS = 100_000


def hashed(number: str, div: str = "div") -> str:
    """SQL for a hash of a non-negative number in [0, PRIME)."""
    linear = f"((({number}) % {PRIME} * 48271 + (({number}) {div} {PRIME}) % {PRIME} * 40692 + 12345) % {PRIME})"
    return f"({linear} * {linear} % {PRIME})"


def round_key(n: str, rank: str, epoch: str, turn: str) -> str:
    return f"({hashed(f'{n} + 7919 * {turn} + 104729 * {rank} + 15485863 * {epoch}')} % greatest({n}, 1))"


def swap(x: str, key: str, n: str, rank: str, epoch: str, turn: str, div: str = "div") -> str:
    """One round of the shuffle of [0, n); its own inverse."""
    partner = f"(({key} + {n} - {x}) % {n})"
    coin = hashed(f"greatest({x}, {partner}) * 17 + 1000003 * {turn} + 7907 * {rank} + 31 * {epoch}", div)
    return f"CASE WHEN {coin} {div} 32768 % 2 = 1 THEN {partner} ELSE {x} END"


def permuted(x: str, n: str, rank: str, epoch: str, keys: str, backwards: bool = False) -> Column:
    """The image of x under a source's permutation for a pass; ``keys`` has the round keys of the pass.

    The same as ``swap`` in all rounds, with the partner and the coin's number computed once.
    """
    turns = f"sequence({ROUNDS}, 1, -1)" if backwards else f"sequence(1, {ROUNDS})"
    number = f"greatest(x, p) * 17 + 1000003 * r + 7907 * {rank} + 31 * {epoch}"
    coin = f"transform(array({number}), v -> {hashed('v')} div 32768 % 2)[0]"
    partner = f"({keys}[r - 1] + {n} - x) % {n}"
    step = f"transform(array({partner}), p -> CASE WHEN {coin} = 1 THEN p ELSE x END)[0]"
    return F.expr(f"aggregate({turns}, CAST({x} AS BIGINT), (x, r) -> {step})")


def with_keys(sources: DataFrame, epochs: int = MOST_PASSES + 1) -> DataFrame:
    """Adds keys: the round keys of each pass."""
    key = round_key("blocks", "rank", "e", "r")
    return sources.withColumn("keys", F.expr(
        f"transform(sequence(0, {epochs - 1}), e -> transform(sequence(1, {ROUNDS}), r -> CAST({key} AS BIGINT)))"
    ))


def size_of(text: Column) -> Column:
    """Words of a text."""
    return F.size(words_of(text)).cast("long")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def targets(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK) -> DataFrame:
    """A row per source: rank, weight, source_size, target, and its blocks and slots.

    Targets are shares of the mix by weight, but not more than two passes over
    a source; what exceeds that is shared by the rest again. In the order of
    size by weight, the sources at that limit are a prefix, so running sums
    find them at once. The windows here hold one row per source.
    """
    sums = documents.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    ranked = sums.withColumn("rank", F.row_number().over(by_name).cast("long")).withColumn("weight", weight.cast("long"))
    everything = Window.partitionBy()
    by_room = Window.orderBy(F.expr("source_size / weight"), "rank")
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    after = by_room.rowsBetween(0, Window.unboundedFollowing)
    up, down = EXPANSION
    measured = ranked.withColumn("total", F.sum("source_size").over(everything)).withColumn(
        "taken_before", F.coalesce(F.sum("source_size").over(before), F.lit(0)) * MOST_PASSES
    ).withColumn("weights_left", F.sum("weight").over(after)).withColumn("full", F.expr(
        f"{MOST_PASSES * down} * source_size * weights_left <= weight * ({up} * total - {down} * taken_before)"
    ))
    shared = measured.withColumn(
        "full_words", F.sum(F.when(F.col("full"), F.col("source_size") * MOST_PASSES).otherwise(0)).over(everything)
    ).withColumn("open_weight", F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(everything))
    aimed = shared.withColumn("target", F.expr(
        f"CASE WHEN full THEN CAST({MOST_PASSES} * source_size AS DOUBLE) "
        f"ELSE weight * (total * CAST({up} AS DOUBLE) / {down} - full_words) / open_weight END"
    ))
    # epoch below passes: a whole pass; epoch equal to passes: the part of one
    cut = aimed.select("source", "rank", "weight", "source_size", "target").withColumn(
        "blocks", F.expr(f"(source_size + {block - 1}) div {block}")
    ).withColumn("last_words", F.expr(f"source_size - (blocks - 1) * {block}")).withColumn(
        "passes", F.expr("CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) div source_size ELSE 0 END")
    ).withColumn("rest", F.expr("CAST(floor(target) AS BIGINT) - passes * source_size"))
    return _with_slots(cut, block)


def _with_slots(sources: DataFrame, block: int) -> DataFrame:
    """Adds keys, short_at, the place of the short last block in the pass that is not completed, and slots."""
    placed = with_keys(sources).withColumn("short_at", F.when(
        F.col("blocks") > 0, permuted("blocks - 1", "blocks", "rank", "passes", "keys[passes]", backwards=True)
    ))
    return placed.withColumn("slots", F.expr(
        f"blocks * passes + CASE WHEN blocks = 0 THEN 0 WHEN (rest + {block - 1}) div {block} <= short_at "
        f"THEN (rest + {block - 1}) div {block} ELSE (rest + {block} - last_words + {block - 1}) div {block} END"
    ))


def _checked(side: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(side) if rows <= BROADCAST_ROWS else side


def shard_counts(sources: DataFrame, shards: int = SHARDS) -> DataFrame:
    """rank, shard, first and n: the multinomial draws of every shard, within each source's slots."""
    spark = sources.sparkSession
    n_sources, slots = sources.agg(F.count("*"), F.coalesce(F.sum("slots"), F.lit(0))).first()
    by_rank = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    ranges = sources.filter("slots > 0").select("rank", "slots").withColumn("from", F.coalesce(F.sum("slots").over(by_rank), F.lit(0)))
    per_shard = max(1, -(-slots // shards))
    cell = max(1, slots // 1024)
    cells = ranges.withColumn("cell", F.explode(F.expr(f"sequence(from div {cell}, (from + slots - 1) div {cell})")))
    drawn = spark.range(min(slots, per_shard * (shards - 1))).select(
        F.expr(f"id div {per_shard}").alias("shard"),
        F.expr(f"({hashed('id * 2 + 1')} * {PRIME} + {hashed('id * 2 + 2')}) % {max(1, slots)}").alias("at"),
    ).withColumn("cell", F.expr(f"at div {cell}"))
    counts = drawn.join(
        _checked(cells, n_sources + 1024), "cell"
    ).filter(F.expr("at >= from AND at < from + slots")).groupBy("rank", "shard").count()
    earlier = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    clipped = counts.withColumn("before", F.coalesce(F.sum("count").over(earlier), F.lit(0))).join(
        ranges.select("rank", "slots"), "rank"
    ).select(
        "rank", "shard", F.least("before", "slots").alias("first"),
        (F.least(F.col("before") + F.col("count"), "slots") - F.least("before", "slots")).alias("n"),
    )
    given = clipped.groupBy("rank").agg(F.sum("n").alias("given"))
    last = ranges.join(given, "rank", "left").select(
        "rank", F.lit(shards - 1).cast("long").alias("shard"), F.coalesce("given", F.lit(0)).alias("first"),
        (F.col("slots") - F.coalesce("given", F.lit(0))).alias("n"),
    )
    return clipped.unionByName(last).filter("n > 0")


def slot_table(sources: DataFrame, shards: int = SHARDS, block: int = BLOCK) -> DataFrame:
    """rank, shard, epoch, number (of the block) and words (taken from its start) of every slot."""
    counts = shard_counts(sources, shards)
    chunks = counts.withColumn("part", F.explode(F.expr(f"sequence(0L, (n - 1) div {CHUNK})"))).select(
        "rank", "shard", (F.col("first") + F.col("part") * CHUNK).alias("low"),
        F.expr(f"first + least(n, (part + 1) * {CHUNK}) - 1").alias("high"),
    )
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = chunks.repartition(parts, "rank", "low")  # few small rows, but much work for each
    per_source = sources.select("rank", "blocks", "last_words", "passes", "rest", "short_at", "keys")
    n_sources = sources.count()
    slots = dealt.join(_checked(per_source, n_sources), "rank").withColumn(
        "slot", F.explode(F.sequence("low", "high"))
    ).withColumn("epoch", F.expr("slot div blocks")).withColumn("place", F.expr("slot % blocks"))
    numbered = slots.withColumn("number", permuted("place", "blocks", "rank", "epoch", "keys[epoch]"))
    length = f"CASE WHEN number = blocks - 1 THEN last_words ELSE {block} END"
    done = f"(place * {block} - CASE WHEN place > short_at THEN {block} - last_words ELSE 0 END)"
    return numbered.select(
        "rank", "shard", "epoch", "number",
        F.expr(f"CASE WHEN epoch < passes THEN {length} ELSE least({length}, rest - {done}) END").alias("words"),
    )


def block_pieces(documents: DataFrame, sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """_row, rank, number, low and high: the words of a block that a document holds, counted in the block; offset of the document.

    Running sums go over buckets of the pseudorandom order first and then
    inside one bucket, so a large source is no single group.
    """
    documents = documents.select("doc_id", "source", "size", "_row")
    rows = documents.count()
    buckets = max(1, rows // ROWS_PER_BUCKET)
    key = F.expr(hashed(f"coalesce(doc_id, _row) & {(1 << 63) - 1}"))  # not abs: the least long has none
    placed = documents.filter("size > 0").withColumn("order", key).withColumn("bucket", F.expr(f"order * {buckets} div {PRIME}"))
    sums = placed.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("base", F.coalesce(F.sum("words").over(earlier), F.lit(0))).drop("words")
    inside = Window.partitionBy("source", "bucket").orderBy("order", "doc_id", "size", "_row").rowsBetween(Window.unboundedPreceding, -1)
    running = placed.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    same = running["source"].eqNullSafe(starts["source"]) & (running["bucket"] == starts["bucket"])
    offsets = running.join(starts, same).select(
        "_row", running["source"], "size", (F.col("base") + F.col("within")).alias("offset")
    )
    ranks = sources.select("rank", F.col("source").alias("_source"))
    named = offsets.join(ranks, F.col("source").eqNullSafe(F.col("_source")))
    return named.withColumn("number", F.explode(F.expr(f"sequence(offset div {block}, (offset + size - 1) div {block})"))).select(
        "_row", "rank", "number", "offset", F.expr(f"greatest(offset - number * {block}, 0L)").alias("low"),
        F.expr(f"least(offset + size - number * {block}, {block}L)").alias("high"),
    )


def packed_blocks(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, shards: int = SHARDS, block: int = BLOCK) -> DataFrame:
    """The mix as fixed-length blocks: shard, source, epoch, number, n_words and text, a row per slot.

    A block holds ``block`` consecutive words of its source, joined by spaces;
    fewer only a source's last one and the one that its target cuts. Shards
    take their sources' blocks by multinomial draws; the last shard takes what they leave.
    Null texts have no words, a null source is one of its own, an empty table gives no rows.
    """
    documents = _numbered(docs, F.col("text"))
    sources = stored(targets(documents, weights, block))
    slots = stored(slot_table(sources, shards, block))
    pieces = block_pieces(documents, sources, block).join(documents.select("_row", "text"), "_row").select(
        "rank", "number", "low", F.slice(
            words_of(F.col("text")), (F.expr(f"number * {block} + low - offset") + 1).cast("int"), (F.col("high") - F.col("low")).cast("int")
        ).alias("words"),
    )
    blocks = pieces.groupBy("rank", "number").agg(  # at most ``block`` words
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("low", "words"))), lambda p: p["words"])).alias("held")
    )
    named = slots.join(_checked(sources.select("rank", "source"), sources.count()), "rank")
    return named.join(blocks, ["rank", "number"]).select(
        "shard", "source", "epoch", "number", F.col("words").cast("long").alias("n_words"),
        F.array_join(F.slice("held", 1, F.col("words").cast("int")), " ").alias("text"),
    ).filter("n_words > 0")


def taken_pieces(documents: DataFrame, sources: DataFrame, shards: int = SHARDS, block: int = BLOCK) -> DataFrame:
    """_row, shard, epoch, start and n: the words of documents that the slots take."""
    pieces, slots = block_pieces(documents, sources, block), slot_table(sources, shards, block)
    met = pieces.join(slots, ["rank", "number"]).filter(F.col("words") > F.col("low"))
    return met.select(
        "_row", "shard", "epoch", F.expr(f"number * {block} + low - offset").alias("start"),
        (F.least("high", "words") - F.col("low")).alias("n"),
    )


def _numbered(docs: DataFrame, *more: Column) -> DataFrame:
    return stored(docs.select(
        "doc_id", "source", size_of(F.col("text")).alias("size"), F.monotonically_increasing_id().alias("_row"), *more
    ))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, shards: int = SHARDS, block: int = BLOCK) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of every row.

    Null and blank texts have no words and are taken 0 times; a null source is
    a source of its own, the last. Repeated rows are documents of their own.
    Without words every target is 0; an empty table gives no rows.
    """
    documents = _numbered(docs)
    sources = stored(targets(documents, weights, block))
    taken = taken_pieces(documents, sources, shards, block).groupBy("_row").agg(F.sum("n").alias("taken"))
    aims = sources.select(F.col("source").alias("_source"), "source_size", "target")
    return documents.join(taken, "_row", "left").join(
        aims, F.col("source").eqNullSafe(F.col("_source"))
    ).select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, shards: int = SHARDS, block: int = BLOCK) -> DataFrame:
    """The mix as documents: a row for each pass in which a document has taken words, with those words as its text.

    A document that a pass takes whole keeps its text; else the taken words are
    joined by spaces. The other columns stay, but for n_chars, which is counted anew.
    Null and blank texts have no words and so no row; a null source is a source of its own; repeated rows
    are documents of their own; an empty table gives no rows.
    """
    documents = _numbered(docs, F.struct(*docs.columns).alias("doc"))  # a struct, so that no column name clashes
    sources = stored(targets(documents, weights, block))
    passes = taken_pieces(documents, sources, shards, block).groupBy("_row", "epoch").agg(
        F.sort_array(F.collect_list(F.struct("start", "n"))).alias("pieces"), F.sum("n").alias("taken")
    )
    joined = F.transform(F.array(words_of(F.col("doc.text"))), lambda words: F.array_join(F.flatten(F.transform(
        "pieces", lambda piece: F.slice(words, (piece["start"] + 1).cast("int"), piece["n"].cast("int"))
    )), " "))[0]
    found = documents.join(passes, "_row").withColumn(
        "text", F.when(F.col("taken") == F.col("size"), F.col("doc.text")).otherwise(joined)
    )
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return found.select(*[new.get(c, F.col("doc")[c]).alias(c) for c in docs.columns])
