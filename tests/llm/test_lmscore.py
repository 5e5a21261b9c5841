import math
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from llm_tables import frame, prose
from pyspark.sql import functions as F

from driftline.llm import lmscore
from driftline.llm.lmscore import END, Settings


def tokens(text):
    return [*(text or "").encode().lower().split(), END]


def brute(rows, usable):
    counts = Counter(t for doc_id, text in rows if usable(doc_id) for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    unit = n + 0.5 * (v + 1)
    return [
        (doc_id, len(tokens(text)), sum(counts[t] > 0 for t in tokens(text)), n, round(sum(math.log10((counts[t] + 0.5) / unit) for t in tokens(text)), 6))
        for doc_id, text in rows
    ]


@pytest.mark.parametrize("settings", [Settings(), Settings(broadcast_words=20, bucket_bytes=10_000, slice_words=50)])
def test_base_scores_equal_brute_force(spark, awkward, settings):
    rows = [*awkward, *((100 + i, prose(i, 40)) for i in range(20))]
    docs = frame(spark, rows)
    model, words = lmscore.fit(docs, F.coalesce(F.col("doc_id"), F.lit(0)) % 2 == 0, settings)
    got = [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in lmscore.score(docs, model, words).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute(rows, lambda i: (i or 0) % 2 == 0)))


def test_filter_counts_are_quantised_counts():
    rng = np.random.default_rng(1)
    settings = Settings(bits_per_entry=16)
    keys = lmscore.mixed(np.arange(1, 4001, dtype=np.uint64))
    counts = rng.zipf(1.6, size=len(keys)).clip(max=10_000)
    block = lmscore.filter_block(keys, counts, 1 << 30, settings)
    model = lmscore.Model(block, np.array([0, 8 * len(block)]), np.zeros(0, np.uint64), np.zeros(0, np.int64), True, 1, 1, 1, settings)
    got = model.filter_counts(keys)
    want = lmscore.level_values(settings.base)[lmscore.levels(counts, settings.base)]
    assert (got >= want).all() and (got > want).mean() < 0.01  # never below, seldom above
    absent = lmscore.mixed(np.arange(10_000, 20_000, dtype=np.uint64))
    assert (model.filter_counts(absent) > 0).mean() < 0.01
    assert np.allclose(want / counts, 1, atol=0.5)


def test_model_beats_unigrams_on_held_out_text(spark):
    rows = [(i, " ".join(f"w{(i + 3 * j) % 50} v{(i + 3 * j) % 50}" for j in range(60))) for i in range(60)]
    docs = frame(spark, rows)
    model, words = lmscore.fit(docs, F.col("doc_id") < 40)
    held = [r for r in lmscore.score(docs, model, words).collect() if r.doc_id >= 40]
    assert sum(r.score for r in held) > 0.6 * sum(r.base_score for r in held) and all(r.score < 0 for r in held)
    assert 0 < model.false_positive_rate < 0.05


@pytest.mark.parametrize("usable", ["true", "coalesce(doc_id, 0) % 10 = 0"])
def test_filter_beyond_the_broadcast_bound_scores_alike(spark, awkward, usable):
    docs = frame(spark, [*awkward, *((100 + i, prose(i, 40)) for i in range(40))]).repartition(3)
    found = []
    for bits in (1 << 29, 1_000):  # the second one is far less than the entries need
        settings = Settings(filter_bits=bits, broadcast_words=20, bucket_bytes=10_000, slice_words=50)
        model, words = lmscore.fit(docs, F.expr(usable), settings)
        assert (model.blocks is None) == (bits > 1_000) and 0 < model.false_positive_rate < 0.05
        rows = lmscore.score(docs, model, words).collect()
        found.append(sorted(str((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6))) for r in rows))
    assert found[0] == found[1]


def test_no_training_text_and_empty_table(spark, awkward):
    docs = frame(spark, awkward)
    model, words = lmscore.fit(docs, F.lit(False))
    got = lmscore.score(docs, model, words).collect()
    assert len(got) == len(awkward) and all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in got)
    assert lmscore.score(frame(spark, []), model, words).count() == 0


def plain_scores(rows, usable, settings):
    """Smoothed bigram scores from dictionaries of counts, quantised to their levels."""
    def pairs(text):
        words = tokens(text)
        return list(zip([END, *words], words))

    learnt = [text for doc_id, text in rows if usable(doc_id)]
    single, double = Counter(t for text in learnt for t in tokens(text)), Counter(p for text in learnt for p in pairs(text))
    unit = sum(single.values()) + 0.5 * (len(single) + 1)

    def quantised(c):
        return 0.0 if not c else 1.0 if c < settings.base else (lambda n: (settings.base ** (n - 1) + settings.base ** n) / 2)(
            1 + math.floor(math.log(c) / math.log(settings.base) + 1e-9)
        )

    def log_p(before, word):
        own, context, both = (quantised(c) for c in (single[word], single[before], double[before, word]))
        return math.log10((min(both, context) + settings.strength * (own + 0.5) / unit) / (context + settings.strength))

    return [(doc_id, round(sum(log_p(*p) for p in pairs(text)), 5)) for doc_id, text in rows]


@pytest.mark.parametrize("filter_bits", [1 << 29, 1_000])
def test_scores_equal_brute_force(spark, awkward, filter_bits):
    rows = [*awkward, *((100 + i, prose(i, 40)) for i in range(40)), (200, "the end " * 300)]
    settings = Settings(filter_bits=filter_bits, bits_per_entry=60, hashes=12, broadcast_words=20, bucket_bytes=9_000, slice_words=70)
    docs = frame(spark, rows).repartition(4)
    model, words = lmscore.fit(docs, F.coalesce(F.col("doc_id"), F.lit(0)) % 3 != 1, settings)
    got = [(r.doc_id, round(r.score, 5)) for r in lmscore.score(docs, model, words).collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain_scores(rows, lambda i: (i or 0) % 3 != 1, settings)))


def test_training_texts_that_are_all_null(spark):
    docs = frame(spark, [(1, None), (2, None), (3, "some words")])
    model, words = lmscore.fit(docs, F.col("doc_id") < 3)
    got = {r.doc_id: r for r in lmscore.score(docs, model, words).collect()}
    assert got[1].train_tokens == 2 and got[1].n_known == 1 and got[3].n_known == 1


def test_a_slice_holds_few_words_as_objects():
    texts = [" ".join(f"word{(i * 2_000 + j) % 5_000}" for j in range(2_000)).encode() for i in range(200)]
    tracemalloc.start()
    slices = lmscore.Slices(1_000_000)
    own, before, owner = next(slices.of(iter(texts)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = [lmscore.word_hash(t) for text in texts for t in tokens(text.decode())]
    assert own.tolist() == want and before[0] == lmscore.word_hash(END) and before[1:].tolist() == [
        a if same else lmscore.word_hash(END) for a, same in zip(want[:-1], owner[1:] == owner[:-1], strict=True)
    ]
    assert peak < 60 * len(own)  # 8 bytes a word in each of a few arrays


def test_a_block_is_filled_a_part_at_a_time():
    keys = lmscore.mixed(np.arange(1, 1_000_001, dtype=np.uint64))
    tracemalloc.start()
    block = lmscore.filter_block(keys, 1 + np.arange(len(keys)) % 3, 1 << 30, Settings())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    model = lmscore.Model(block, np.array([0, 8 * len(block)]), np.zeros(0, np.uint64), np.zeros(0, np.int64), True, 1, 1, 1, Settings())
    assert (model.filter_levels(keys) >= lmscore.levels(1 + np.arange(len(keys)) % 3, 1.5)).all()
    assert peak < 66 * len(keys)
