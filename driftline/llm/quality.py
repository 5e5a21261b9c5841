"""Quality rules judged by an isolation forest.

Every text gets rule statistics: counts the usual filters look at, as rates.
Random trees split them at random places; the shorter the mean path of a row,
the more anomalous it is. Splits are drawn before any row is seen, so every
tree counts all labelled good rows and is cut off where at most one is left:
what no good row looks like is isolated early. The threshold on the anomaly
score is calibrated on all labelled rows of both kinds: the one that separates
them best among those that keep nearly all good rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.shared import ready, stored, text_bytes
from driftline.operators.running import split_running_totals
from driftline.session import shuffle_partitions

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_upper", "n_letters", "n_marks", "n_bare", "n_distinct", "n_long_words")
SYMBOLS, MARKS = b"#*$%&|<>", b".,!?;:"
RATES = 11  # statistics of a row, see ``rates``
LEAST_WORDS, REPEAT_PERCENT = 50, 50
SHORT_WORDS = 50_000  # longer texts are counted in arrays, which need less memory
_LETTERS = bytes(c for c in range(256) if c >= 0x80 or chr(c).isalpha())
_NOT_UPPER = bytes(c for c in range(256) if not 0x41 <= c <= 0x5A)
_NOT_LETTER = bytes(c for c in range(256) if c not in _LETTERS)
_NOT_SYMBOL = bytes(c for c in range(256) if c not in SYMBOLS)
_NOT_MARK = bytes(c for c in range(256) if c not in MARKS)
_BLANK = b" \t\n\x0b\x0c\r"
_CONTINUES = bytes(range(0x80, 0xC0))


@dataclass(frozen=True)
class Settings:
    trees: int = 200
    depth: int = 12
    good_kept: float = 0.99  # least share of good labelled rows that the threshold keeps
    seed: int = 7


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows that the text has twice or more."""
    n = len(words)
    if n < 4:
        return 0
    if n <= SHORT_WORDS:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        times = Counter(windows)
        if len(times) == len(windows):
            return 0
        hit = {i for i, window in enumerate(windows) if times[window] > 1}
        return len(hit | {i + 1 for i in hit} | {i + 2 for i in hit})
    codes: dict[bytes, int] = {}
    ids = np.fromiter((codes.setdefault(w, len(codes)) for w in words), dtype=np.int64, count=n)
    pairs = np.unique(ids[:-1] * len(codes) + ids[1:], return_inverse=True)[1]
    _, which, times = np.unique(pairs[:-1] * len(codes) + ids[2:], return_inverse=True, return_counts=True)
    again = times[which] > 1
    hit = np.zeros(n, dtype=bool)
    for shift in range(3):
        hit[shift:n - 2 + shift] |= again
    return int(hit.sum())


def statistics(text: bytes) -> tuple[int, ...]:
    """All counts of a text in UTF-8, in the order of COUNTS and MORE."""
    words = text.split()  # of bytes: at the six ASCII white-space characters
    solid = text.translate(None, _BLANK + _CONTINUES)
    lines = text.split(b"\n")
    worded = [line for line in lines if line.strip(_BLANK)]
    letters = text.translate(None, _NOT_LETTER)
    return (
        len(words), len(solid), len(text.translate(None, _NOT_SYMBOL)), len(worded) - len(set(worded)), repeated_words(words),
        len(lines), len(text.translate(None, _NOT_UPPER)), len(letters), len(text.translate(None, _NOT_MARK)),
        sum(1 for w in words if not w.translate(None, _NOT_LETTER)), len(set(words)), sum(1 for w in words if len(w) > 30),
    )


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and all counts of every row; null texts count as empty."""
    ready(docs)
    names = COUNTS + MORE

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([statistics(text.as_py()) for text in batch.column("text")], dtype=np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(found[:, i]) for i in range(len(names)))], ["doc_id", *names]
            )

    schema = "doc_id long, " + ", ".join(f"{name} long" for name in names)
    return docs.select("doc_id", text_bytes().alias("text")).mapInArrow(of_batches, schema)


def rates(counts: np.ndarray) -> np.ndarray:
    """Rule statistics of rows of counts."""
    words, chars, symbols, dup_lines, repeats, lines, upper, letters, marks, bare, distinct, long_words = counts.T.astype(float)
    per_word = np.maximum(words, 1)
    return np.stack([
        np.log1p(words), chars / per_word, np.log1p(100 * symbols / per_word), dup_lines / np.maximum(lines, 1), repeats / per_word,
        np.log1p(words / np.maximum(lines, 1)), upper / np.maximum(letters, 1), np.log1p(100 * marks / per_word), bare / per_word,
        np.log1p(distinct) / np.log1p(per_word), long_words / per_word,
    ], axis=1)


@dataclass
class Forest:
    """Trees as arrays: feature (-1 for a leaf), split, children, and the path length that ends in the node."""

    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    path: np.ndarray
    usual: float
    threshold: float = 1.0

    def anomaly(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, split, left, path in zip(self.feature, self.split, self.left, self.path, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            while (inner := feature[node] >= 0).any():
                at = rows[inner]
                own = node[at]
                node[at] = left[own] + (x[at, feature[own]] >= split[own])
            total += path[node]
        return 2.0 ** (-total / len(self.feature) / self.usual) if len(x) else total


def mean_path(n: int) -> float:
    """Mean path of an unsuccessful search in a random tree of n rows."""
    return 0.0 if n <= 1 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n if n > 2 else 1.0


def calibrated(score: np.ndarray, good: np.ndarray, least_kept: float) -> float:
    """The same as ``threshold_of`` for scores that fit in an array."""
    order = np.argsort(-score, kind="stable")
    bad_out, good_out = np.cumsum(~good[order]), np.cumsum(good[order])
    last = np.append(score[order][1:] < score[order][:-1], True)
    fair = last & (good_out <= (1 - least_kept) * good.sum())
    gain = np.where(fair, bad_out / max(1, (~good).sum()) - good_out / max(1, good.sum()), -1.0)
    best = int(np.argmax(gain))
    if gain[best] <= 0:
        return np.inf
    below = score[order][best + 1] if best + 1 < len(score) else score[order][best]
    return float((score[order][best] + below) / 2) if below < score[order][best] else float(score[order][best])


@dataclass
class Cuts:
    """Random trees of full depth before any row was seen: node i has the children 2 i + 1 and 2 i + 2."""

    feature: np.ndarray  # (trees, inner nodes), -1 where the box has no width
    split: np.ndarray
    depth: int

    def leaves(self, x: np.ndarray, tree: int) -> np.ndarray:
        """Number among the leaves of full depth of each row."""
        node, rows = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, self.feature[tree, node]] >= self.split[tree, node])
        return node - ((1 << self.depth) - 1)


def drawn_cuts(low: np.ndarray, high: np.ndarray, settings: Settings) -> Cuts:
    """Splits are drawn over a node's part of the box from ``low`` to ``high``,

    so a place beyond all rows can be cut off as early as one among them.
    """
    rng = np.random.default_rng(settings.seed)
    inner = (1 << settings.depth) - 1
    feature, split = np.full((settings.trees, inner), -1, dtype=np.int16), np.zeros((settings.trees, inner))
    for tree in range(settings.trees):
        lo, hi, first = low[None], high[None], 0
        for _ in range(settings.depth):
            nodes = np.arange(len(lo))
            draw = np.where(hi > lo, rng.random(lo.shape), -1.0)
            f = draw.argmax(axis=1)
            wide = draw[nodes, f] >= 0
            at = lo[nodes, f] + rng.random(len(lo)) * (hi[nodes, f] - lo[nodes, f])
            feature[tree, first:first + len(lo)] = np.where(wide, f, -1)
            split[tree, first:first + len(lo)] = np.where(wide, at, np.inf)
            first += len(lo)
            lo, hi = np.repeat(lo, 2, axis=0), np.repeat(hi, 2, axis=0)
            hi[2 * nodes, f], lo[2 * nodes + 1, f] = at, at
    return Cuts(feature, split, settings.depth)


def forest_of(cuts: Cuts, counts: np.ndarray, settings: Settings) -> Forest:
    """Trees cut off where at most one good row is left; ``counts``: good rows by (tree, leaf of full depth)."""
    grown = []
    for tree in range(settings.trees):
        levels = [counts[tree]]
        while len(levels[0]) > 1:
            levels.insert(0, levels[0].reshape(-1, 2).sum(axis=1))
        rows = np.concatenate(levels)
        feature, split, left, path = [-1], [0.0], [0], [0.0]
        open_ = [(0, 0, 0)]  # place here, node of the full tree, depth
        while open_:
            here, node, depth = open_.pop()
            if depth >= settings.depth or rows[node] <= 1 or cuts.feature[tree, node] < 0:
                path[here] = depth + mean_path(int(rows[node]))
                continue
            feature[here], split[here], left[here] = int(cuts.feature[tree, node]), float(cuts.split[tree, node]), len(feature)
            for side in (1, 2):
                open_.append((len(feature), 2 * node + side, depth + 1))
                for name, value in ((feature, -1), (split, 0.0), (left, 0), (path, 0.0)):
                    name.append(value)
        grown.append((feature, split, left, path))
    size = max(len(t[0]) for t in grown)
    pad = lambda k, kind: np.array([t[k] + [0] * (size - len(t[k])) for t in grown], dtype=kind)
    return Forest(pad(0, np.int64), pad(1, float), pad(2, np.int64), pad(3, float), max(mean_path(int(counts[0].sum())), 1e-9))


def counted_leaves(labelled: DataFrame, cuts: Cuts) -> np.ndarray:
    """Good rows by (tree, leaf); a task adds up its rows, and the driver gets at most a number per leaf."""
    shared, trees, leaves = labelled.sparkSession.sparkContext.broadcast(cuts), len(cuts.feature), 1 << cuts.depth

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((trees, leaves), dtype=np.int64)
        for batch in batches:
            x = matrix(batch)
            for tree in range(trees):
                found[tree] += np.bincount(shared.value.leaves(x, tree), minlength=leaves)
        tree, leaf = np.nonzero(found)
        yield pa.RecordBatch.from_pydict({"tree": tree.astype(np.int32), "leaf": leaf.astype(np.int32), "n": found[tree, leaf]})

    parts = labelled.filter("good").select("x").mapInArrow(of_batches, "tree int, leaf int, n long")
    rows = parts.groupBy("tree", "leaf").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((trees, leaves), dtype=np.int64)
    out[rows["tree"].to_numpy(), rows["leaf"].to_numpy()] = rows["n"].to_numpy()
    return out


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def threshold_of(scores: DataFrame, n_good: int, n_bad: int, least_kept: float) -> float:
    """The threshold that rejects most bad rows, less good rows, among those that keep ``least_kept`` of the good.

    ``scores``: ``(anomaly, good)`` of all labelled rows. Rows are counted per
    score and added up in slices of the order, so any number of them will do.
    """
    counted = scores.groupBy(F.lit(0).alias("all"), (-F.col("anomaly")).alias("order")).agg(
        F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("b")
    )
    parts = shuffle_partitions(scores.sparkSession)
    ranked = split_running_totals(counted, ["all"], "order", ["g", "b"], parts).select("order", "g_upto", "b_upto")
    gain = F.col("b_upto") / F.lit(float(max(1, n_bad))) - F.col("g_upto") / F.lit(float(max(1, n_good)))
    fair = ranked.filter(F.col("g_upto") <= F.lit((1 - least_kept) * n_good)).withColumn("gain", gain)
    best = fair.agg(F.max(F.struct("gain", -F.col("order")))).first()[0]
    if best is None or best[0] <= 0:
        return np.inf
    score = best[1]
    below = ranked.filter(F.col("order") > F.lit(-score)).agg(F.min("order")).first()[0]
    return score if below is None else (score - below) / 2


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Forest | None:
    """A forest from all labelled rows; None without both kinds of label.

    Every tree counts all good rows, its box spans all labelled ones, and the threshold is judged on all of them.
    """
    spark = ready(docs)
    marked = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    chosen = marked.groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))
    names = COUNTS + MORE

    def with_rates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = rates(np.stack([batch.column(name).to_numpy() for name in names], axis=1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("good"), lists], ["good", "x"])

    # All texts are measured where they lie: counts are moved to the labels, not texts.
    picked = measured(docs.filter(F.col("doc_id").isNotNull())).join(chosen.hint("merge"), "doc_id")
    labelled = stored(picked.select("good", *names).mapInArrow(with_rates, "good boolean, x array<double>"))
    ends = [f(F.col("x")[i]).alias(f"{f.__name__}{i}") for f in (F.min, F.max) for i in range(RATES)]
    seen = labelled.agg(F.count_if("good").alias("n_good"), F.count_if(~F.col("good")).alias("n_bad"), *ends).first()
    n_good, n_bad = seen["n_good"], seen["n_bad"]
    if n_good < 2 or not n_bad:
        return None
    cuts = drawn_cuts(np.array(seen[2:2 + RATES], dtype=float), np.array(seen[2 + RATES:], dtype=float), settings)
    forest = forest_of(cuts, counted_leaves(labelled, cuts), settings)
    shared = spark.sparkContext.broadcast(forest)

    def anomalies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("good"), pa.array(shared.value.anomaly(matrix(batch)))], ["good", "anomaly"])

    scores = labelled.mapInArrow(anomalies, "good boolean, anomaly double")
    forest.threshold = threshold_of(scores, n_good, n_bad, settings.good_kept)
    return forest


def judge(docs: DataFrame, forest: Forest | None) -> DataFrame:
    """doc_id, the base counts, base_failed, anomaly and kept of every row.

    A row fails the base rules with fewer than 50 words or more than half of
    them repeated; the forest judges the others. Without a forest (no labels
    of both kinds) those are kept. Null and blank texts have no words and fail.
    Repeated rows are judged alike; an empty table gives no rows.
    """
    spark = ready(docs)
    shared_forest = spark.sparkContext.broadcast(forest)  # bounded by its settings
    names = COUNTS + MORE

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared_forest.value
        for batch in batches:
            counts = np.stack([batch.column(name).to_numpy() for name in names], axis=1)
            failed = (counts[:, 0] < LEAST_WORDS) | (100 * counts[:, 4] > REPEAT_PERCENT * counts[:, 0])
            anomaly = np.zeros(len(counts)) if forest is None else forest.anomaly(rates(counts))
            kept = ~failed if forest is None else ~failed & (anomaly < forest.threshold)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(batch.column(name) for name in COUNTS), pa.array(failed), pa.array(anomaly), pa.array(kept)],
                ["doc_id", *COUNTS, "base_failed", "anomaly", "kept"],
            )

    schema = "doc_id long, " + ", ".join(f"{name} long" for name in COUNTS) + ", base_failed boolean, anomaly double, kept boolean"
    return measured(docs).mapInArrow(of_batches, schema)
