import numpy as np
import xxhash
from llm_tables import frame, prose

from driftline.llm import simhash
from driftline.llm.components import components


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ")
    words = [w for w in words.replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, linked):
    """Least id reachable of every node."""
    label = dict.fromkeys(range(len(nodes)))
    for start in range(len(nodes)):
        if label[start] is None:
            label[start], open_ = start, [start]
            while open_:
                a = open_.pop()
                for b in range(len(nodes)):
                    if label[b] is None and linked(a, b):
                        label[b] = start
                        open_.append(b)
    return label


def test_near_duplicates_equal_brute_force(spark, awkward):
    got = simhash.near_duplicates(frame(spark, awkward)).collect()
    prints = [brute_fingerprint(text) for _, text in awkward]
    label = brute_components(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    least = {}
    for i, (doc_id, _) in enumerate(awkward):
        if doc_id is not None:
            least[label[i]] = min(doc_id, least.get(label[i], doc_id))
    want = [(doc_id, f"{prints[i]:016x}", least.get(label[i])) for i, (doc_id, _) in enumerate(awkward)]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)


def test_links_of_random_fingerprints(spark):
    """Chains, clusters and far points; with and without crowded anchors."""
    rng = np.random.default_rng(5)
    centers = rng.integers(0, 1 << 63, size=40, dtype=np.uint64)
    near = [c ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, size=k, replace=False))) for c in centers for k in (0, 1, 2, 3, 4, 5)]
    prints = np.unique(np.array(near, dtype=np.uint64))
    nodes = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long")
    label = brute_components(prints, lambda a, b: np.bitwise_count(prints[a] ^ prints[b]) <= 3)
    want = {frozenset(int(prints.view(np.int64)[i]) for i in label if label[i] == k) for k in set(label.values())}
    for crowd in (simhash.CROWD, 2):
        roots = components(simhash.links(nodes, crowd=crowd)).collect()
        groups = {}
        for r in roots:
            groups.setdefault(r.root, set()).add(r.node)
        assert {frozenset(g) for g in groups.values()} == {g for g in want if len(g) > 1}


def test_large_group_becomes_a_forest():
    rng = np.random.default_rng(2)
    fps = np.unique(np.array([1 << int(a) | 1 << int(b) for a, b in rng.integers(0, 64, size=(400, 2))], dtype=np.uint64))
    edges = simhash.forest_of_group(np.ones(len(fps), dtype=bool), fps, 3)
    linked = {tuple(sorted(e)) for a, b in edges for e in zip(a.tolist(), b.tolist(), strict=True)}
    assert len(linked) == len(fps) - 1  # all within four bits of each other through a chain
    assert all((a ^ b).bit_count() <= 3 for a, b in linked)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 140)] + [(5, 5), (200, 201), (201, 200)]
    roots = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert {roots[i] for i in range(61)} == {0} and {roots[i] for i in range(100, 140)} == {100}
    assert roots[200] == roots[201] == 200 and 5 in roots
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_one_of_each_stays(spark, awkward):
    docs = frame(spark, [*awkward, (20, prose(9, 80)), (21, prose(9, 80))])
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == [1, 3, 6, 7, 8, 9, 10, 20] and ids.count(None) == 2


def test_empty_table(spark):
    docs = frame(spark, [])
    assert simhash.near_duplicates(docs).count() == 0 and simhash.keep_one_of_each(docs).count() == 0
