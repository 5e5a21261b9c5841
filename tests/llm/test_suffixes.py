import hashlib
from collections import Counter

import numpy as np
import pytest
from llm_tables import frame, prose

from driftline.llm import suffixes
from driftline.llm.suffixes import SPAN, Settings


def brute(texts):
    """Bytes covered by a SPAN-byte string that starts somewhere else too."""
    count = Counter(t[i:i + SPAN] for t in texts for i in range(len(t) - SPAN + 1))
    masks = []
    for t in texts:
        mask = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - SPAN + 1):
            if count[t[i:i + SPAN]] > 1:
                mask[i:i + SPAN] = True
        masks.append(mask)
    return masks


def expected(rows):
    texts = [(t or "").encode() for _, t in rows]
    out = []
    for (doc_id, _), t, mask in zip(rows, texts, brute(texts), strict=True):
        kept = bytes(b for b, gone in zip(t, mask, strict=True) if not gone)
        spans = int((np.diff(np.concatenate(([0], mask.astype(int)))) == 1).sum())
        out.append(str((doc_id, len(t), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest())))
    return sorted(out)


@pytest.fixture(scope="module")
def rows(awkward):
    base = prose(30, 200)
    short = [r for r in awkward if len(r[1] or "") < 10_000]
    return [
        *short, (20, base), (21, base[:500] + "X" + base[501:]), (22, prose(31, 60) + base[100:320] + prose(32, 50)),
        (23, prose(33, 20) + base[100:299]), (24, "é" * 150), (25, "é" * 99 + "x" + "é" * 99), (26, "ab" * 400 + prose(34, 30)),
        (27, base[300:700] + "tail" + base[300:700]), (28, prose(35, 400)), (29, "q" * SPAN), (30, "r" * (SPAN + 1)),
    ]


@pytest.mark.parametrize("settings", [
    Settings(), Settings(crowd=1, bucket_bytes=2_000, shard_bytes=500),
])
def test_removal_equals_brute_force(spark, rows, settings):
    got = suffixes.without_repeats(frame(spark, rows), settings).collect()
    assert sorted(str((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got) == expected(rows)
    for r in got:
        assert (r.kept is None) == (r.n_removed == 0)
        assert r.kept is None or hashlib.sha256(r.kept).hexdigest() == r.kept_sha256


def test_passage_of_very_many_texts_is_never_compared_in_one_place(spark, monkeypatch):
    passage = prose(60, 100)[:230]
    rows = [(i, prose(600 + i, 40) + passage + prose(700 + i, 40)) for i in range(60)]
    rows += [(100 + i, prose(800 + i, 30) + passage[:150] + prose(900 + i, 30)) for i in range(60)]
    groups = []

    def watched(found, settings, merged=suffixes.merged):
        groups.extend(r["count"] for r in found.groupBy("anchor").count().collect())
        return merged(found, settings)

    monkeypatch.setattr(suffixes, "merged", watched)
    got = suffixes.without_repeats(frame(spark, rows), Settings(crowd=10)).collect()
    assert sorted(str((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got) == expected(rows)
    assert max(groups, default=0) <= 10


def test_long_text_over_several_chunks(monkeypatch):
    text = (prose(40, 3_000) + "#" + prose(41, 500) + prose(40, 300)).encode()
    whole = suffixes.pieces([text])
    monkeypatch.setattr(suffixes, "CHUNK", 2_000)
    cut = suffixes.pieces([text])
    strings = lambda p: Counter(text[s + i:s + i + SPAN] for s, n in zip(p[1].tolist(), p[2].tolist(), strict=True) for i in range(n))
    assert strings(whole) == strings(cut) and sum(strings(cut).values()) == len(text) - SPAN + 1


def test_merged_transforms_do_not_depend_on_shards():
    base = prose(50, 300).encode()
    parts = [base[:400], base[50:330], prose(51, 60).encode(), base[200:600], b"z" * 300]
    first = suffixes.repeats_in(parts, 1 << 30)
    for size in (1, 350, 700):
        for a, b in zip(first, suffixes.repeats_in(parts, size), strict=True):
            assert a.tolist() == b.tolist()
    masks = brute(parts)
    for part, offsets, mask in zip(parts, first, masks, strict=True):
        own = np.zeros(len(part), dtype=bool)
        for o in offsets:
            own[o:o + SPAN] = True
        assert (own == mask).all()


def test_empty_table(spark):
    assert suffixes.without_repeats(frame(spark, [])).count() == 0
