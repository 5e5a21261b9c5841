"""Toxic spans by a linear-chain conditional random field.

A sentence is a chain over two tags, clean and toxic. Emissions come from a
token's word and stem (its first bytes) and from its two neighbours, transitions
from neighbouring tags. The labelled tokens for training are found in labelled
documents: in a toxic document, a token is tagged toxic if its word or stem
stands in significantly more different contexts of toxic than of clean
documents. Different contexts, not occurrences, are counted, so copies of one
document do not teach its rare words. Rare words and stems share one weight,
which is what a new word of an unseen text gets.

Forward-backward marginals of all tokens give the expected number of toxic
tokens of a document; a logistic curve, fitted on the labelled documents, turns
them into its score. Training uses at most ``Settings.train_rows`` labelled
rows; scoring reads every token of every text, sentence by sentence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.shared import ready, text_bytes, worker_cache

OFFENDING = 0.5  # marginal from which a token is reported as a toxic span
THRESHOLD = 0.7  # score from which a document is rejected
BREAK = b"\x01"
UNIT = re.compile(rb"[0-9a-z\x80-\xff]+|[.!?\n]")  # a word or a break, as in sentence_words
# Letters, digits and all bytes of other characters stay; sentence ends become a break; the rest separates words.
TO_WORDS = bytes(
    c if c >= 0x80 or chr(c).isalnum() else 1 if chr(c) in ".!?\n" else 32 for c in range(256)
)


@dataclass(frozen=True)
class Settings:
    train_rows: int = 4_000  # labelled rows, by a hash of doc_id; a quarter at least of each label that has so many
    train_bytes: int = 200_000  # longer labelled texts are left out of the training sample
    significance: float = 25.0  # likelihood ratio from which a word is taken as toxic
    least_contexts: int = 4  # words and stems with fewer are treated as unknown
    rounds: int = 20
    rate: float = 0.5
    penalty: float = 0.02
    longest_chain: int = 128  # tokens; longer sentences are several chains
    tokens_at_once: int = 400_000


STEM_BYTES = 6


@dataclass
class Model:
    """Weights of the toxic tag relative to the clean one; index 0 stands for any other word or stem."""

    words: dict[bytes, int] = field(default_factory=dict)
    stems: dict[bytes, int] = field(default_factory=dict)
    emission: tuple[np.ndarray, ...] = tuple(np.zeros(1) for _ in range(4))  # previous, own, next word; stem
    bias: float = -8.0
    transition: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    curve: np.ndarray = field(default_factory=lambda: np.array([-20.0, 0.0, 0.0]))

    def features(self, words: list[bytes]) -> tuple[np.ndarray, ...]:
        """Indices of the previous, own and next word and of the stem of each token."""
        own = np.fromiter(map(self.words.get, words, repeat(0)), dtype=np.int64, count=len(words))
        stem = np.fromiter(
            (self.stems.get(word[:STEM_BYTES], 0) for word in words), dtype=np.int64, count=len(words)
        )
        before, after = np.roll(own, 1), np.roll(own, -1)
        if len(own):
            before[0] = after[-1] = 0
        return before, own, after, stem

    def scores(self, features: tuple[np.ndarray, ...]) -> np.ndarray:
        return self.bias + sum(weights[x] for weights, x in zip(self.emission, features, strict=True))


def sentence_words(text: bytes) -> list[bytes]:
    """Lower-cased words with a break at each sentence end."""
    return text.lower().translate(TO_WORDS).replace(BREAK, b" \x01 ").split()


def marginals(model: Model, score: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(toxic) of each token, and expected counts of the four tag pairs; forward and backward over equal-sized batches."""
    result, pairs = np.zeros(len(score)), np.zeros((2, 2))
    if not len(length):
        return result, pairs
    odds, move = np.exp(np.clip(score, -30, 30)), np.exp(model.transition)
    order = np.argsort(length, kind="stable")
    padded = -(-length[order] // 4) * 4
    cuts = np.flatnonzero(np.concatenate(([True], padded[1:] != padded[:-1], [True])))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        chosen = order[a:b]
        steps = int(padded[a])
        at = begin[chosen][None, :] + np.arange(steps)[:, None]
        live = np.arange(steps)[:, None] < length[chosen][None, :]
        x = odds[np.where(live, at, 0)]
        toxic, total = np.empty_like(x), np.empty_like(x)
        clean_now, toxic_now = np.ones(len(chosen)), x[0].copy()
        for t in range(steps):
            if t:
                clean_now, toxic_now = (
                    clean_now * move[0, 0] + toxic_now * move[1, 0],
                    (clean_now * move[0, 1] + toxic_now * move[1, 1]) * x[t],
                )
            whole = clean_now + toxic_now
            clean_now, toxic_now = clean_now / whole, toxic_now / whole
            toxic[t], total[t] = toxic_now, whole
        clean_back, toxic_back = np.ones(len(chosen)), np.ones(len(chosen))
        for t in range(steps - 1, -1, -1):
            on, off = toxic[t] * toxic_back, (1 - toxic[t]) * clean_back
            whole = on + off
            inside = live[t] if t > steps - 4 else None  # before, all chains of the batch go on
            if t:
                scale = 1 / (whole * total[t])
                if inside is not None:
                    scale = scale * inside
                to_toxic = x[t] * toxic_back
                forward, backward = toxic[t - 1] * scale, to_toxic
                rest = scale - forward
                pairs += move * np.array([
                    [rest @ clean_back, rest @ backward], [forward @ clean_back, forward @ backward]
                ])
                new_clean = (move[0, 0] * clean_back + move[0, 1] * to_toxic) / total[t]
                new_toxic = (move[1, 0] * clean_back + move[1, 1] * to_toxic) / total[t]
                if inside is None:
                    clean_back, toxic_back = new_clean, new_toxic
                else:
                    clean_back, toxic_back = np.where(inside, new_clean, 1.0), np.where(inside, new_toxic, 1.0)
            toxic[t] = on / whole
        result[at[live]] = toxic[live]
    return result, pairs


def within(features: tuple[np.ndarray, ...], bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Features without neighbours from other documents."""
    before, own, after, stem = features
    filled = bounds[1:] > bounds[:-1]
    before[bounds[:-1][filled]] = 0
    after[bounds[1:][filled] - 1] = 0
    return before, own, after, stem


class Corpus:
    """Labelled texts as word numbers, and the stem number of every word; the break is number 0 of both."""

    def __init__(self, texts: list[bytes]) -> None:
        numbers: dict[bytes, int] = {BREAK: 0}
        self.documents = []
        for text in texts:
            words = sentence_words(text)
            self.documents.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int32, count=len(words)))
        self.words = list(numbers)
        stems: dict[bytes, int] = {}
        self.stem_of = np.array([stems.setdefault(w[:STEM_BYTES], len(stems)) for w in self.words], dtype=np.int32)
        self.stems = list(stems)

    def flat(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of the chosen documents, and the documents' bounds."""
        parts = [self.documents[i] for i in chosen.tolist()]
        bounds = np.concatenate(([0], np.cumsum([len(part) for part in parts]))).astype(np.int64)
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32), bounds

    def contexts(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Different contexts (both neighbours and the word) of each word and of each stem in the chosen documents."""
        own, bounds = self.flat(chosen)
        before, after = np.roll(own, 1), np.roll(own, -1)
        filled = bounds[1:] > bounds[:-1]
        before[bounds[:-1][filled]] = 0
        after[bounds[1:][filled] - 1] = 0
        order = np.lexsort((after, before, own))
        own, before, after = own[order], before[order], after[order]
        first = np.ones(len(own), dtype=bool)
        first[1:] = (own[1:] != own[:-1]) | (before[1:] != before[:-1]) | (after[1:] != after[:-1])
        words = own[first & (own != 0)]
        return np.bincount(words, minlength=len(self.words)), np.bincount(self.stem_of[words], minlength=len(self.stems))

    def features(self, model: Model, own: np.ndarray) -> tuple[np.ndarray, ...]:
        """As the model's features of the words."""
        word = np.fromiter(map(model.words.get, self.words, repeat(0)), dtype=np.int32, count=len(self.words))[own]
        stem = np.fromiter(map(model.stems.get, self.stems, repeat(0)), dtype=np.int32, count=len(self.stems))[self.stem_of[own]]
        before, after = np.roll(word, 1), np.roll(word, -1)
        if len(own):
            before[0] = after[-1] = 0
        return before, word, after, stem


def significant(toxic: np.ndarray, clean: np.ndarray, ratio: float) -> np.ndarray:
    """Whether the contexts of each unit lie in toxic documents far more often than chance would have it."""
    n_toxic, n_clean = max(1, int(toxic.sum())), max(1, int(clean.sum()))
    share = np.maximum(toxic + clean, 1) / (n_clean + n_toxic)
    value = 2 * (toxic * np.log(np.maximum(toxic, 1) / (share * n_toxic)) + clean * np.log(np.maximum(clean, 1) / (share * n_clean)))
    return (toxic > 0) & (value >= ratio) & (toxic / n_toxic > 10 * clean / n_clean)


def document_features(probability: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Constant, expected toxic tokens (log), and greatest marginal of each document."""
    sums = np.concatenate(([0.0], np.cumsum(probability)))
    expected = np.maximum(0.0, sums[bounds[1:]] - sums[bounds[:-1]])
    padded = np.append(probability, 0.0)
    most = np.maximum.reduceat(padded, bounds[:-1]) if len(bounds) > 1 else np.zeros(0)
    most = np.where(bounds[1:] > bounds[:-1], most, 0.0)
    return np.stack([np.ones(len(expected)), np.log1p(expected), most], axis=1)


def logistic_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 0.1) -> np.ndarray:
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6] + [penalty] * (x.shape[1] - 1))
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weight * (y - p)) - ridge @ w)
        w = w + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_field(corpus: Corpus, chosen: np.ndarray, labels: np.ndarray, settings: Settings) -> Model:
    """Tag the tokens of the chosen documents, then fit the field by gradient steps on its exact likelihood."""
    model = Model()
    tagged, known = [], []
    counts = [corpus.contexts(chosen[labels[chosen] == label]) for label in (0, 1)]
    for clean, toxic, units in zip(*counts, (corpus.words, corpus.stems), strict=True):
        tagged.append(significant(toxic, clean, settings.significance))
        known.append(sorted(units[i] for i in np.flatnonzero(clean + toxic >= settings.least_contexts).tolist()))
    model.words, model.stems = ({unit: i for i, unit in enumerate(units, 1)} for units in known)

    flat, bounds = corpus.flat(chosen)
    in_toxic = np.repeat(labels[chosen], np.diff(bounds)) == 1
    is_break = flat == 0
    marked = tagged[0][flat] | tagged[1][corpus.stem_of[flat]]
    tags = (marked & in_toxic).astype(np.float64)
    begin, length = document_chains(is_break, bounds, settings.longest_chain)
    features = within(corpus.features(model, flat), bounds)
    sizes = [len(model.words) + 1] * 3 + [len(model.stems) + 1]
    model.emission = tuple(np.zeros(size) for size in sizes)
    inside, first = np.zeros(len(flat), dtype=bool), np.zeros(len(flat), dtype=bool)
    inside[_spread(begin, length)] = True
    first[begin] = True
    at = np.flatnonzero(inside & ~first)
    seen = np.zeros((2, 2))
    np.add.at(seen, (tags[at - 1].astype(int), tags[at].astype(int)), 1)
    scale = 1 / max(1.0, tags.sum())
    squares = [np.zeros(size) for size in sizes] + [np.zeros((2, 2)), np.zeros(1)]
    for _ in range(settings.rounds):
        probability, pairs = marginals(model, model.scores(features), begin, length)
        residual = np.where(inside, tags - probability, 0.0)
        slopes = [
            (np.bincount(x, residual, minlength=size) - settings.penalty * strength * weights) * scale
            for x, size, weights, strength in zip(features, sizes, model.emission, (10, 1, 10, 1), strict=True)
        ]
        steps = []
        for square, slope in zip(squares, [*slopes, (seen - pairs) * scale, np.array([residual.sum() * scale])], strict=True):
            square += slope * slope
            steps.append(settings.rate * slope / np.sqrt(square + 1e-10))
        model.emission = tuple(np.clip(w + d, -12, 12) for w, d in zip(model.emission, steps[:4], strict=True))
        model.transition = np.clip(model.transition + steps[4], -6, 6)
        model.bias = float(model.bias + steps[5][0])
    return model


def train(texts: list[bytes], labels: np.ndarray, settings: Settings, toxic_share: float | None = None) -> Model:
    """The field of all labelled texts; its document curve is fitted on fields that have not seen the document.

    ``toxic_share`` is that of all labelled rows, where the texts hold more of one label than these.
    """
    if not len(labels) or labels.min() == labels.max():
        return Model()
    corpus, every = Corpus(texts), np.arange(len(labels))
    model = fit_field(corpus, every, labels, settings)
    x = np.zeros((len(labels), 3))
    for half in (0, 1):
        learn, judge = every[every % 2 != half], every[every % 2 == half]
        other = model if labels[learn].min() == labels[learn].max() else fit_field(corpus, learn, labels, settings)
        flat, bounds = corpus.flat(judge)
        x[judge] = judged(other, corpus.features(other, flat), flat == 0, bounds, settings)[0]
    own_share = labels.mean()
    share = own_share if toxic_share is None else toxic_share
    weight = np.where(labels == 1, share / own_share, (1 - share) / (1 - own_share))
    model.curve = logistic_curve(x, labels.astype(np.float64), weight)
    return model


def judged(
    model: Model, features: tuple[np.ndarray, ...], is_break: np.ndarray, bounds: np.ndarray, settings: Settings
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each document, the marginal of each token, and the documents' bounds."""
    begin, length = document_chains(is_break, bounds, settings.longest_chain)
    probability, _ = marginals(model, model.scores(within(features, bounds)), begin, length)
    return document_features(probability, bounds), probability, bounds


def field_features(model: Model, documents: list[list[bytes]], settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each document, the marginal of each token, and the documents' bounds."""
    bounds = np.concatenate(([0], np.cumsum([len(words) for words in documents]))).astype(np.int64)
    flat = [word for words in documents for word in words]
    is_break = np.fromiter((word == BREAK for word in flat), dtype=bool, count=len(flat))
    return judged(model, model.features(flat), is_break, bounds, settings)


def _spread(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All positions of the chains."""
    nth = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    return np.repeat(begin, length) + nth


def document_chains(is_break: np.ndarray, bounds: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Chains that end at breaks and at the ends of documents."""
    cut = np.zeros(len(is_break) + 1, dtype=bool)
    cut[bounds] = True
    cut[:-1] |= is_break
    edges = np.flatnonzero(cut)
    starts = edges[:-1] + np.append(is_break, False)[edges[:-1]]
    lengths = np.maximum(0, edges[1:] - starts)
    pieces = -(-lengths // longest)
    keep = np.repeat(np.arange(len(starts)), pieces)
    nth = np.arange(len(keep)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = starts[keep] + nth * longest
    return begin, np.minimum(longest, starts[keep] + lengths[keep] - begin)


def word_spans(text: bytes, toxic: np.ndarray) -> str:
    """start:end of the toxic words, in code points."""
    spans, at, points, nth = [], 0, 0, -1
    for match in UNIT.finditer(text.lower()):
        nth += 1
        if toxic[nth]:
            points += len(text[at:match.start()].decode("utf-8", "replace"))
            at = match.start()
            spans.append(f"{points}:{points + len(match[0].decode('utf-8', 'replace'))}")
    return ",".join(spans)


def score_texts(model: Model, texts: list[bytes], settings: Settings) -> tuple[list[float], list[float], list[str]]:
    """Score, expected toxic tokens and offending spans of each text; tokens are handled in slices of bounded size."""
    scores, expected, spans = [], [], []
    group: list[list[bytes]] = []
    members: list[bytes] = []

    def close() -> None:
        if not group:
            return
        features, probability, bounds = field_features(model, group, settings)
        scores.extend((1 / (1 + np.exp(-np.clip(features @ model.curve, -30, 30)))).tolist())
        expected.extend(np.expm1(features[:, 1]).tolist())
        offending = probability >= OFFENDING
        for k, text in enumerate(members):
            part = offending[bounds[k]:bounds[k + 1]]
            spans.append(word_spans(text, part) if part.any() else "")
        group.clear()
        members.clear()

    held = 0
    for text in texts:
        words = sentence_words(text)
        group.append(words)
        members.append(text)
        held += len(words)
        if held >= settings.tokens_at_once:
            close()
            held = 0
    close()
    return scores, expected, spans


def training_sample(
    docs: DataFrame, labels: DataFrame, settings: Settings, usable: Column
) -> tuple[list[bytes], np.ndarray, float | None]:
    """At most ``train_rows`` labelled texts, in an order that only depends on doc_id, and the toxic share of all labelled rows.

    Each label has its share, but a quarter at least where there are so many, so a rare one is learnt too.
    """
    marked = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & usable)
    each = marked.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    there = dict(each.groupBy("toxic").count().collect())
    clean, toxic = there.get(0, 0), there.get(1, 0)
    share = toxic / (clean + toxic) if clean + toxic else None
    least = settings.train_rows // 4
    of_toxic = min(toxic, min(max(round(settings.train_rows * (share or 0)), least), settings.train_rows - least))
    of_clean = min(clean, settings.train_rows - of_toxic)
    of_toxic = min(toxic, settings.train_rows - of_clean)
    first, second = (
        each.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        for label, n in ((0, of_clean), (1, of_toxic))
    )
    chosen = first.unionByName(second)
    texts = docs.select("doc_id", text_bytes().alias("text")).filter(F.octet_length("text") <= settings.train_bytes)
    rows = texts.join(F.broadcast(chosen), "doc_id").toArrow()  # the sample is bounded by its settings
    order = np.lexsort((np.array([xxhash.xxh64_intdigest(t) for t in rows["text"].to_pylist()], dtype=np.uint64), rows["doc_id"].to_numpy()))
    taken = rows.take(pa.array(order))
    return taken["text"].to_pylist(), taken["toxic"].to_numpy().astype(np.int64), share


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, settings: Settings = Settings()) -> Model:
    """A model from the labelled documents that ``usable`` (a condition on doc_id) admits."""
    texts, marks, share = training_sample(docs, labels, settings, F.lit(True) if usable is None else usable)
    return train(texts, marks, settings, share)


def score(docs: DataFrame, model: Model, settings: Settings = Settings()) -> DataFrame:
    """doc_id, score, expected_toxic and toxic_spans of every row.

    Null and empty texts have no tokens and get the curve's score for none.
    Repeated rows are scored alike. Without labels of both kinds the score is
    close to 0 for every text. An empty table gives no rows; other columns are
    not read.
    """
    spark = ready(docs)
    shared_model = spark.sparkContext.broadcast(model)  # bounded by the words of the training sample

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("toxicity")
        for batch in batches:
            found = score_texts(shared_model.value, batch.column("text").to_pylist(), settings)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(found[0], pa.float64()), pa.array(found[1], pa.float64()), pa.array(found[2], pa.string())
            ], ["doc_id", "score", "expected_toxic", "toxic_spans"])

    return docs.select("doc_id", text_bytes().alias("text")).mapInArrow(
        of_batches, "doc_id long, score double, expected_toxic double, toxic_spans string"
    )


def below(docs: DataFrame, model: Model, threshold: float = THRESHOLD, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs``, all columns, that score below the threshold; null and empty texts score as ``score`` says."""
    spark = ready(docs)
    shared_model, columns = spark.sparkContext.broadcast(model), docs.columns

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("toxicity")
        for batch in batches:
            texts = [text or b"" for text in batch.column(columns.index("text")).cast(pa.binary()).to_pylist()]
            scores = np.array(score_texts(shared_model.value, texts, settings)[0])
            yield batch.filter(pa.array(scores < threshold, pa.bool_()))

    return docs.mapInArrow(of_batches, docs.schema)
