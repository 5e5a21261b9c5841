import itertools
import random

import numpy as np
import pytest
from llm_tables import frame, prose

from driftline.llm import toxicity
from driftline.llm.toxicity import Model, Settings

BAD = ("vilewort", "grubbel", "nastig")


def labelled(n=160):
    rng, rows, labels = random.Random(4), [], []
    for i in range(n):
        words = prose(1000 + i, 60).split(" ")
        toxic = i % 4 == 0
        for _ in range(4 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        rows.append((i, " ".join(words[:30]) + ". " + " ".join(words[30:])))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    model = Model(transition=rng.normal(size=(2, 2)))
    lengths = np.array([1, 5, 4, 3, 5])
    begin = np.cumsum(lengths) - lengths
    score = rng.normal(size=lengths.sum())
    got, pairs = toxicity.marginals(model, score, begin, lengths)
    want, want_pairs = np.zeros(len(score)), np.zeros((2, 2))
    for b, n in zip(begin, lengths, strict=True):
        total, mass, pair = 0.0, np.zeros(n), np.zeros((2, 2))
        for tags in itertools.product((0, 1), repeat=int(n)):
            weight = np.exp(sum(score[b + i] * t for i, t in enumerate(tags)) + sum(model.transition[x, y] for x, y in itertools.pairwise(tags)))
            total += weight
            mass += weight * np.array(tags)
            for x, y in itertools.pairwise(tags):
                pair[x, y] += weight
        want[b:b + n] = mass / total
        want_pairs += pair / total
    assert got == pytest.approx(want) and pairs == pytest.approx(want_pairs)


def test_held_out_documents_and_spans(spark):
    rows, labels = labelled()
    docs, marks = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    from pyspark.sql import functions as F

    model = toxicity.fit(docs, marks, usable=F.col("doc_id") < 120)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    for doc_id, _, toxic in labels[120:]:
        assert (got[doc_id].score >= toxicity.THRESHOLD) == bool(toxic)
    texts = dict(rows)
    spans = [texts[i][int(a):int(b)] for i, r in got.items() if r.toxic_spans for a, b in (s.split(":") for s in r.toxic_spans.split(","))]
    assert set(spans) <= set(BAD) and len(spans) > 100
    kept = toxicity.below(docs, model)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id >= 120) == [i for i, _, t in labels[120:] if not t]


def test_rare_toxic_rows_are_in_the_sample(spark):
    from pyspark.sql import functions as F

    rows, labels = labelled(800)
    labels = [(i, q, t) for i, q, t in labels if not t or i % 16 == 0]  # 50 toxic and 600 clean
    docs, marks = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    _, taken, share = toxicity.training_sample(docs, marks, Settings(train_rows=80), F.lit(True))
    assert len(taken) == 80 and taken.sum() == 20 and share == pytest.approx(50 / 650)
    _, taken, _ = toxicity.training_sample(docs, marks, Settings(), F.lit(True))
    assert len(taken) == 650 and taken.sum() == 50
    assert Settings().train_rows >= 4_000 and Settings().rounds >= 20


def test_awkward_rows_and_missing_labels(spark, awkward):
    docs = frame(spark, awkward)
    nothing = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, nothing)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(awkward) and all(0 <= r.score < 0.1 for r in got)
    assert toxicity.below(docs, model).count() == len(awkward)
    assert toxicity.score(frame(spark, []), model).count() == 0
    labels = spark.createDataFrame([(1, None, 1), (1, 1, 1), (3, 0, 0), (None, 1, 1), (4, 1, None)], "doc_id long, quality int, toxic int")
    few = toxicity.fit(docs, labels)
    assert all(0 <= r.score <= 1 for r in toxicity.score(docs, few).collect())


def test_long_text_in_slices_scores_as_whole():
    rows, labels = labelled()
    settings = Settings()
    model = toxicity.train([t.encode() for _, t in rows], np.array([t for _, _, t in labels]), settings)
    texts = [t.encode() for _, t in rows[:9]]
    one = toxicity.score_texts(model, texts, settings)
    many = toxicity.score_texts(model, texts, Settings(tokens_at_once=10))
    assert one[0] == pytest.approx(many[0]) and one[2] == many[2]
