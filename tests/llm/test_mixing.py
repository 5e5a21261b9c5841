import re
from collections import Counter, defaultdict

import pytest
from llm_tables import frame, prose

from driftline.llm import mixing


def brute_targets(sizes):
    """Water filling: cap at twice the size, share the rest again until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        left = total - sum(2 * sizes[s] for s in full)
        rest = sum(weight[s] for s in names if s not in full)
        aims = {s: 2.0 * sizes[s] if s in full else weight[s] * left / rest for s in names}
        over = {s for s in names if s not in full and aims[s] >= 2 * sizes[s]}
        if not over:
            return aims
        full |= over
        if len(full) == len(names):
            return {s: 2.0 * sizes[s] for s in names}


@pytest.fixture(scope="module")
def rows(awkward):
    sources = ["b", "a", None, "é", "Z"]
    extra = [(100 + i, prose(i, 30 + 17 * i), sources[i % 5] if i % 3 else "b") for i in range(40)]
    return [(*r, sources[i % 5]) for i, r in enumerate(awkward)] + extra


def test_mix_meets_its_targets(spark, rows):
    got = mixing.mix(frame(spark, rows), block=16, shards=8).collect()
    assert len(got) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r["size"]
    want = brute_targets(dict(sizes))
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    assert all(abs(taken[s] - want[s]) < 1 for s in sizes)
    assert Counter((r.doc_id, r["size"], r.taken) for r in got) == Counter(
        (r.doc_id, r["size"], r.taken) for r in mixing.mix(frame(spark, rows).repartition(3), block=16, shards=3).collect()
    )


def test_permutations_are_bijections(spark):
    for n in (1, 2, 7, 64, 101):
        table = mixing.with_keys(spark.range(n).selectExpr("id AS x", f"{n}L AS blocks", "3L AS rank", "1L AS epoch"))
        there = table.withColumn("y", mixing.permuted("x", "blocks", "rank", "epoch", "keys[epoch]"))
        back = there.withColumn("z", mixing.permuted("y", "blocks", "rank", "epoch", "keys[epoch]", backwards=True)).collect()
        assert sorted(r.y for r in back) == list(range(n)) and all(r.z == r.x for r in back)


def test_slots_of_shards(spark, rows):
    documents = mixing._numbered(frame(spark, rows))
    sources = mixing.targets(documents, block=16).cache()
    slots = mixing.slot_table(sources, 8, 16).collect()
    by_rank = {r.rank: r for r in sources.collect()}
    assert sum(r.slots for r in by_rank.values()) == len(slots)
    assert max(Counter((r["rank"], r.epoch, r.number) for r in slots).values()) == 1
    assert {r.shard for r in slots} == set(range(8)) and all(0 < r.words <= 16 for r in slots)
    for rank, source in by_rank.items():
        assert sum(r.words for r in slots if r["rank"] == rank) == int(source.target)


def test_mixed_documents_hold_the_taken_words(spark, rows):
    docs = frame(spark, rows)
    mixed = mixing.mixed_documents(docs, block=16, shards=8)
    assert mixed.columns == docs.columns
    words = Counter()
    texts = defaultdict(set)
    for doc_id, text, *_ in rows:
        texts[doc_id].update((text or "").split())
    for r in mixed.collect():
        words[r.doc_id] += len([w for w in r.text.replace("\t", " ").replace("\n", " ").split(" ") if w])
        assert set(r.text.split()) <= texts[r.doc_id] and r.n_chars == len(r.text)
    want = Counter()
    for r in mixing.mix(docs, block=16, shards=8).collect():
        want[r.doc_id] += r.taken
    assert +words == +want


def test_no_rows_and_no_words(spark):
    assert mixing.mix(frame(spark, [])).count() == 0
    got = mixing.mix(frame(spark, [(1, None, "a"), (2, " ", None)])).collect()
    assert [(r.target, r.taken) for r in got] == [(0.0, 0)] * 2
    assert mixing.mixed_documents(frame(spark, [(1, None, "a")])).count() == 0


def test_least_long_as_id(spark):
    rows = [(-(1 << 63), prose(1, 50), "a"), ((1 << 63) - 1, prose(2, 50), "a"), (-1, prose(3, 50), "b")]
    assert {r.doc_id for r in mixing.mix(frame(spark, rows)).collect()} == {r[0] for r in rows}


def words_of(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def test_packed_blocks(spark, rows):
    docs = frame(spark, rows)
    blocks = mixing.packed_blocks(docs, block=16, shards=8).collect()
    sources = {r.source: r for r in mixing.targets(mixing._numbered(docs), block=16).collect()}
    words, short = Counter(), Counter()
    own = defaultdict(set)
    for _, text, source in rows:
        own[source].update(words_of(text))
    for b in blocks:
        held = b.text.split(" ")
        assert len(held) == b.n_words <= 16 and set(held) <= own[b.source]
        words[b.source] += b.n_words
        short[b.source] += b.n_words < 16
    assert {s: words[s] for s in sources} == {s: int(r.target) for s, r in sources.items()}
    assert all(short[s] <= r.passes + 2 for s, r in sources.items())
    assert {b.shard for b in blocks} == set(range(8))
    # Whole passes hold every word of a source once each.
    for source, r in sources.items():
        for epoch in range(r.passes):
            held = Counter(w for b in blocks if b.source == source and b.epoch == epoch for w in b.text.split(" "))
            assert held == Counter(w for _, text, s in rows if s == source for w in words_of(text))
    assert mixing.packed_blocks(frame(spark, [])).count() == 0


def test_shards_draw_their_sources_by_chance(spark):
    """Shares of a source in the shards scatter as draws do, neither equal nor all in one."""
    rows = [(i, prose(i, 600), "ab"[i % 2]) for i in range(60)]
    blocks = Counter((b.source, b.shard) for b in mixing.packed_blocks(frame(spark, rows), block=16, shards=10).collect())
    sizes = Counter()
    for (_, shard), n in blocks.items():
        sizes[shard] += n
    shares = [blocks["a", shard] / sizes[shard] for shard in range(9)]
    whole = sum(blocks["a", s] for s in range(10)) / sum(sizes.values())
    spread = sum((x - whole) ** 2 for x in shares) / len(shares)
    want = whole * (1 - whole) / (sum(sizes.values()) / 10)
    assert want / 4 < spread < want * 4
