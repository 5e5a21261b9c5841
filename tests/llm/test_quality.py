import random
import re
from collections import Counter

import numpy as np
import pytest
from llm_tables import frame, prose

from driftline.llm import quality


def brute(text):
    text = text or ""
    words, hit, seen, dup = re.findall(r"[^\x20\x09-\x0D]+", text), set(), set(), 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    times = Counter(windows)
    for i, w in enumerate(windows):
        if times[w] > 1:
            hit |= {i, i + 1, i + 2}
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def junk(i):
    rng = random.Random(i)
    return " ".join(w.upper() + rng.choice(["###", "$$$", "%%%"]) for w in prose(i, 80).split(" "))


def test_counts_equal_brute_force(spark, awkward, monkeypatch):
    rows = [*awkward, (50, "a b c\na b c\n \na b c\n x|y <z> ##"), (51, "A a A a A a b\n\n"), (52, junk(1))]
    got = quality.judge(frame(spark, rows), None).collect()
    want = []
    for doc_id, text in rows:
        n = brute(text)
        failed = n[0] < 50 or 100 * n[4] > 50 * n[0]
        want.append((doc_id, *n, failed, not failed))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, *(r[c] for c in quality.COUNTS), r.base_failed, r.kept)) for r in got)
    monkeypatch.setattr(quality, "SHORT_WORDS", 3)
    for _, text in rows:
        assert quality.statistics((text or "").encode())[:5] == brute(text)


def test_forest_tells_junk_from_prose(spark):
    rows = [(i, junk(i) if i % 5 == 0 else prose(i, 60 + 7 * i)) for i in range(120)]
    labels = [(i, int(i % 5 != 0), 0) for i in range(80)] + [(None, 1, 0), (500, 0, 1), (3, None, None)]
    docs = frame(spark, rows)
    forest = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r.kept for r in quality.judge(docs, forest).collect()}
    wrong = [i for i in range(80, 120) if got[i] != (i % 5 != 0)]
    assert len(wrong) <= 1
    again = quality.fit(docs.repartition(5), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert again.threshold == forest.threshold


def test_calibration_keeps_the_good():
    score = np.array([0.9, 0.8, 0.8, 0.7, 0.4, 0.3])
    good = np.array([False, False, True, False, True, True])
    assert 0.8 < quality.calibrated(score, good, 1.0) <= 0.9
    assert quality.calibrated(score, good, 0.5) <= 0.7
    assert quality.calibrated(score, np.ones(6, dtype=bool), 1.0) == np.inf


def test_no_labels_and_empty_table(spark, awkward):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = frame(spark, awkward)
    assert quality.fit(docs, none) is None
    assert quality.judge(frame(spark, []), None).count() == 0


def test_every_labelled_row_counts(spark):
    """Each tree counts all good rows, and the threshold is the one that all labelled rows ask for."""
    rows = [(i, junk(i) if i % 5 == 0 else prose(i, 60 + 7 * i)) for i in range(150)]
    docs, labels = frame(spark, rows), spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(150)], "doc_id long, quality int, toxic int")
    settings = quality.Settings(trees=5)
    forest = quality.fit(docs, labels, settings)
    x = quality.rates(np.array([quality.statistics(text.encode()) for _, text in rows]))
    good = np.array([i % 5 != 0 for i in range(150)])
    cuts = quality.drawn_cuts(x.min(axis=0), x.max(axis=0), settings)
    counts = np.array([np.bincount(cuts.leaves(x[good], t), minlength=1 << cuts.depth) for t in range(5)])
    assert (counts.sum(axis=1) == good.sum()).all()
    want = quality.forest_of(cuts, counts, settings)
    assert all((getattr(forest, a) == getattr(want, a)).all() for a in ("feature", "split", "left", "path")) and forest.usual == want.usual
    assert forest.threshold == pytest.approx(quality.calibrated(want.anomaly(x), good, settings.good_kept), abs=1e-12)
