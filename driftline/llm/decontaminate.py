"""Benchmark decontamination by winnowing, in DataFrame functions only.

A text's k-grams of words are hashed, and of every run of consecutive k-grams
that fills a window of ``window`` words the least hash is kept. Equal windows
keep equal hashes, so any passage of ``window`` words that a document shares
with an item shares a kept fingerprint. Documents and items are joined on the
fingerprints; each hit is then extended to all windows that chose it, and a
window counts if it equals an item's window: the hashes of its first and last
k-gram, which cover it, must agree next to the fingerprint itself (three 64-bit
values). Items shorter than a window are windows of their own length and are
compared as words.

One scan of the documents explodes only kept fingerprints, about 2 of 7 words.
The benchmark's side is broadcast after its rows were counted; beyond
``broadcast_rows`` it is joined by shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.shared import ASCII_LOWER, ASCII_UPPER, stored

WINDOW = 10
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_ROWS = 2_000_000


def words_of(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), ASCII_UPPER, ASCII_LOWER)
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row; an optimizer may not copy it into the loops below."""
    return F.transform(F.array(value), body)[0]


def _range(n: Column) -> Column:
    """0 to n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _runs(words: Column, window: int) -> Column:
    """Per kept fingerprint its first window, its hash and the k-gram hashes of its windows."""
    k = window - window // 2
    grams_per_window = window - k + 1

    def of_grams(grams: Column) -> Column:
        least = F.transform(_range(F.size(grams) - (grams_per_window - 1)), lambda i: (
            F.least(*[grams[i + o] for o in range(grams_per_window)]) if grams_per_window > 1 else grams[i]
        ))
        return _let(least, lambda least: _let(
            F.filter(_range(F.size(least)), lambda i: (i == 0) | (least[i] != least[i - 1])),
            lambda starts: F.transform(starts, lambda s, j: F.struct(
                s.alias("start"), least[s].alias("print"),
                F.slice(grams, s + 1, F.coalesce(F.get(starts, j + 1), F.size(least)) - s + (grams_per_window - 1)).alias("grams"),
            )),
        ))

    return _let(
        F.transform(_range(F.size(words) - (k - 1)), lambda i: F.xxhash64(*[words[i + o] for o in range(k)])), of_grams
    )


def kept_fingerprints(texts: DataFrame, window: int, with_words: bool = False) -> DataFrame:
    """Adds n_words and runs, and the words where they are wanted."""
    found = _let(words_of(F.col("text")), lambda words: F.struct(
        F.size(words).alias("n_words"), F.when(F.size(words) >= window, _runs(words, window)).alias("runs"),
        *([words.alias("words")] if with_words else []),
    ))
    return texts.withColumn("_found", found).select(*texts.columns, "_found.*")


def _windows_of_runs(run: str, window: int) -> Column:
    """Start and the hashes of the first and last k-gram of every window of a run."""
    last, grams = window // 2, F.col(f"{run}.grams")
    return F.transform(_range(F.size(grams) - last), lambda i: F.struct(
        (F.col(f"{run}.start") + i).alias("start"), grams[i].alias("head"), grams[i + last].alias("tail")
    ))


def _short_windows(lengths: list[int]) -> Column:
    """All word sequences of the given lengths, as text."""
    return _let(words_of(F.col("text")), lambda words: F.flatten(F.array(*[
        F.transform(_range(F.size(words) - (n - 1)), lambda i: F.struct(
            i.alias("start"), F.lit(n).alias("n"), F.array_join(F.slice(words, i + 1, n), " ").alias("words")
        )) for n in lengths
    ])))


def _joined(side: DataFrame, rows: int, broadcast_rows: int) -> DataFrame:
    return F.broadcast(side) if rows <= broadcast_rows else side


def hits(texts: DataFrame, keys: list[str], benchmark: DataFrame, window: int = WINDOW, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Per distinct ``keys`` of texts: n_words, n_hit and the sorted item ids whose windows occur.

    ``keys`` must determine the text. Null texts have no words; a table without
    documents gives no rows, one without items no hits. Rows of the benchmark
    that repeat an item_id are windows of one item; items without an id mark
    words but are in no list.
    """
    items = kept_fingerprints(benchmark.select("item_id", "text"), window, with_words=True).filter("n_words > 0")
    long_items = items.filter(F.col("n_words") >= window).select("item_id", F.explode("runs").alias("run"))
    windows = long_items.select(
        "item_id", F.col("run.print").alias("print"), F.explode(_windows_of_runs("run", window)).alias("w")
    ).groupBy("print", F.col("w.head").alias("head"), F.col("w.tail").alias("tail")).agg(
        F.collect_set(F.col("item_id").cast("string")).alias("items")
    )
    windows = stored(windows)
    short = stored(items.filter(F.col("n_words") < window).groupBy(
        F.array_join("words", " ").alias("words"), F.col("n_words").alias("n")
    ).agg(F.collect_set(F.col("item_id").cast("string")).alias("items")))
    size = windows.agg(F.count("*"), F.coalesce(F.sum(F.size("items")), F.lit(0))).first()
    lengths = sorted(row.n for row in short.select("n").distinct().collect())  # fewer than ``window`` values

    prepared = kept_fingerprints(texts.select(*keys, "text"), window)
    prints = windows.select("print").distinct().withColumn("_known", F.lit(True))
    runs = prepared.select(*keys, "n_words", F.explode_outer("runs").alias("run"))
    met = runs.join(
        _joined(prints, size[0], broadcast_rows), F.col("run.print") == F.col("print"), "left"
    ).filter(F.col("_known") | F.coalesce(F.col("run.start"), F.lit(0)).eqNullSafe(0))  # a first row for every text
    extended = met.select(*keys, "n_words", F.col("print"), F.explode_outer(
        F.when(F.col("_known"), _windows_of_runs("run", window))
    ).alias("w"))
    found = extended.select(*keys, "n_words", "print", "w.start", "w.head", "w.tail").join(
        _joined(windows, sum(size), broadcast_rows), ["print", "head", "tail"], "left"
    ).select(
        *keys, "n_words",
        F.when(F.col("items").isNotNull(), F.struct("start", (F.col("start") + window).alias("end"))).alias("span"), "items",
    )
    if lengths:
        pieces = texts.select(*keys, F.size(words_of(F.col("text"))).alias("n_words"), F.explode(_short_windows(lengths)).alias("w"))
        n_short = short.count()
        found = found.unionByName(pieces.join(
            _joined(short, n_short, broadcast_rows),
            (F.col("w.words") == short["words"]) & (F.col("w.n") == short["n"]),
        ).select(*keys, "n_words", F.struct(F.col("w.start").alias("start"), (F.col("w.start") + F.col("w.n")).alias("end")).alias("span"), "items"))
    merged = found.groupBy(*keys, "n_words").agg(
        F.sort_array(F.collect_set("span")).alias("spans"), F.collect_set("items").alias("item_sets")
    )
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).alias("until"), F.lit(0).cast("long").alias("n")),
        lambda so_far, span: F.struct(
            F.greatest(so_far["until"], span["end"]).alias("until"),
            (so_far["n"] + F.greatest(F.lit(0), span["end"] - F.greatest(so_far["until"], span["start"]))).alias("n"),
        ),
        lambda so_far: so_far["n"],
    )
    return merged.select(
        *keys, F.col("n_words").cast("long").alias("n_words"), covered.alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten("item_sets"))).alias("items"), "spans",
    )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, n_words, n_hit, items and spans (word positions) for every row of ``docs``; repeated rows get one each.

    Row numbers are stored before they are used, as a task that is run again could number its rows otherwise.
    """
    rows = stored(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("_row")))
    return hits(rows, ["_row", "doc_id"], benchmark, window, broadcast_rows).drop("_row")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of ``docs``, all columns, whose text shares no window with an item.

    Null texts stay, repeated rows stay or go together, an empty table stays empty.
    """
    marked = docs.select(F.md5(F.col("text").cast("binary")).alias("key"), "text", F.struct(*docs.columns).alias("doc"))
    found = hits(marked.select("key", "text"), ["key"], benchmark, window, broadcast_rows)
    bad = found.filter((F.col("n_hit") > 0) & F.col("key").isNotNull()).select("key")
    return marked.join(bad, "key", "left_anti").select("doc.*")
