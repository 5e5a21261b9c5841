import re

import numpy as np
import pytest
from fleet_tables import brute_cells, cell_table, fleet_frame
from pyspark.sql import functions as F

from driftline.operators import splits, trees
from driftline.operators.binning import bin_edges, prefix_rows
from driftline.operators.search import forward_cv
from driftline.operators.trees import boosting, fit_trees, random_forest
from driftline.spec import Layout, RunConfig

CONFIG = RunConfig.quick()
BY_LEVEL = Layout(task_rows=30)


@pytest.fixture(scope="module")
def frame():
    return fleet_frame(devices=2, hours=130)


@pytest.fixture(scope="module")
def table(spark, frame):
    return cell_table(spark, frame)


def imputed(frame, scheme, cell, rows=None):
    """Features of the rows before ``cell`` (or of ``rows``) with their devices' medians; and the targets."""
    every = brute_cells(frame)
    past = every[(every.block != "test") & (every[f"cell_{scheme}"] < cell)]
    out = past if rows is None else rows
    medians = past.groupby("device_id")[["a", "b", "t"]].median()
    x = out[["a", "b", "t"]].fillna(medians.loc[out.device_id].reset_index(drop=True).set_index(out.index))
    x["hour"], x["dow"] = out.ts.dt.hour, out.ts.dt.dayofweek
    return x.to_numpy(float), out.y.to_numpy(float)


def test_edges_are_exact_quantiles(spark, frame, monkeypatch):
    for most in (255, 20):  # few values, then more values than bins
        monkeypatch.setattr("driftline.operators.binning.MOST_BINS", most)
        table = cell_table(spark, frame)
        edges = bin_edges(table)
        for scheme, cell in (("train", 1), ("train", 4), ("final", 2)):
            x, _ = imputed(frame, scheme, cell)
            assert prefix_rows(table)[scheme, cell] == len(x)
            for f in range(x.shape[1]):
                kinds = np.unique(x[:, f])
                if len(kinds) <= most:
                    want = (kinds[1:] + kinds[:-1]) / 2
                else:
                    want = np.unique(np.percentile(x[:, f], np.linspace(0, 100, most + 1)[1:-1], method="midpoint"))
                assert edges[scheme, cell][f] == pytest.approx(want)
                assert np.array_equal(edges[scheme, cell][f], splits.column_edges(x[:, f:f + 1], most)[0])


def plain_boosting(x, y, edges, rate, turns, leaves, least, l2):
    """Best-first growth leaf by leaf on floating-point sums."""
    bins = np.column_stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)])
    predicted = np.full(len(y), y.mean())
    for _ in range(turns):
        r = y - predicted

        def best(rows):
            found = (0.0, 0, 0)
            score = lambda i: r[i].sum() ** 2 / (len(i) + l2)
            for f in range(x.shape[1]):
                for cut in np.unique(bins[rows, f])[:-1]:
                    left, right = rows[bins[rows, f] <= cut], rows[bins[rows, f] > cut]
                    if min(len(left), len(right)) >= least:
                        gain = score(left) + score(right) - score(rows)
                        if gain > found[0] + 1e-9:
                            found = gain, f, cut
            return found

        grown = [(best(np.arange(len(y))), np.arange(len(y)))]
        while len(grown) < leaves:
            (gain, f, cut), rows = max(grown, key=lambda g: g[0][0])
            if gain <= 0:
                break
            grown = [g for g in grown if g[1] is not rows]
            for part in (rows[bins[rows, f] <= cut], rows[bins[rows, f] > cut]):
                grown.append((best(part), part))
        for _, rows in grown:
            predicted[rows] += rate * r[rows].sum() / (len(rows) + l2)
    return predicted


@pytest.mark.parametrize("l2", [0.0, 5.0])
def test_boosting_equals_plain_growth(spark, frame, table, l2):
    x, y = imputed(frame, "train", 4)
    edges = bin_edges(table)["train", 4]
    fitted = boosting(learning_rate=0.3, max_iter=4, max_leaf_nodes=6, min_samples_leaf=5, l2_regularization=l2).fit_cells(table, "train", [4])
    got = fitted.models[0].predict(x)
    assert got == pytest.approx(plain_boosting(x, y, edges, 0.3, 4, 6, 5, l2), abs=1e-6)


def test_tree_shapes(table):
    one = boosting(max_iter=1, max_leaf_nodes=7, min_samples_leaf=9).fit_cells(table, "train", [4])
    rows = [r.asDict() for r in one.trees.filter("number = 0").collect()]
    tree = splits.Tree.unpacked(rows[0])
    assert (tree.feature < 0).sum() == 7
    none = boosting(max_iter=2, min_samples_leaf=10_000).fit_cells(table, "train", [4])
    assert all(len(splits.Tree.unpacked(r.asDict()).feature) == 1 for r in none.trees.filter("number >= 0").collect())


def same_trees(a, b):
    key = lambda rows: sorted((r["number"], r["node"], r["start"], *[bytes(r[k]) for k in splits.Tree.KINDS]) for r in rows)
    return key(a) == key(b)


def test_boosted_member_is_the_same_alone_with_others_and_by_level(spark, frame, table):
    settings = [dict(max_iter=12, max_leaf_nodes=5, min_samples_leaf=4, learning_rate=0.2, l2_regularization=0.5), dict(max_iter=3, max_leaf_nodes=9, min_samples_leaf=3)]
    models = [boosting(**s) for s in settings]
    together = fit_trees(table, models, "train", [2, 4])
    alone = fit_trees(table, models[:1], "train", [4])[0]
    level = fit_trees(cell_table(spark, frame, layout=BY_LEVEL, partitions=7), models, "train", [2, 4])
    of = lambda fitted, cell: fitted.trees.filter(F.col("member") == fitted.members[cell]).collect()
    assert same_trees(of(together[0], 4), of(alone, 4))
    for i in (0, 1):
        for cell in (2, 4):
            assert same_trees(of(together[i], cell), of(level[i], cell))
    assert same_trees(of(alone, 4), of(fit_trees(cell_table(spark, frame, partitions=5), models[:1], "train", [4])[0], 4))


def test_penalty_changes_scores(table):
    models = [boosting(max_iter=5, l2_regularization=x, min_samples_leaf=5) for x in (0.0, 50.0)]
    scores = forward_cv(table, models, by_device=False).toPandas().set_index(["candidate", "fold"]).rmse.sort_index()
    assert (scores[0] != scores[1]).all()


def plain_tree(x, y, weight, key, least, chosen):
    """Recursive growth, split by split."""
    value = lambda i: (weight[i] * y[i]).sum() / weight[i].sum()
    error = lambda i: (weight[i] * (y[i] - value(i)) ** 2).sum()

    def grow(rows, key):
        allowed = splits.drawn_features(np.array([key], dtype=np.uint64), x.shape[1], chosen)[0]
        found = (1e-9, None, None)
        for f in np.flatnonzero(allowed):
            kinds = np.unique(x[rows, f])
            for low, high in zip(kinds, kinds[1:]):
                left, right = rows[x[rows, f] <= low], rows[x[rows, f] > low]
                if min(len(left), len(right)) >= least:
                    gain = error(rows) - error(left) - error(right)
                    if gain > found[0] * (1 + 1e-9):
                        found = gain, f, (low + high) / 2
        if found[1] is None:
            return value(rows)
        left, right = splits.child_keys(np.array([key], dtype=np.uint64))
        there = x[rows, found[1]] <= found[2]
        return found[1], found[2], grow(rows[there], left[0]), grow(rows[~there], right[0])

    def predict(node, row):
        while isinstance(node, tuple):
            node = node[2] if row[node[0]] <= node[1] else node[3]
        return node

    root = grow(np.flatnonzero(weight), key)
    return np.array([predict(root, row) for row in x])


def test_forest_tree_equals_recursive_growth():
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.normal(size=120), rng.integers(0, 6, 120), rng.normal(size=120).round(1), rng.integers(0, 2, 120)]).astype(float)
    y = x[:, 0] + x[:, 1] ** 2 + rng.normal(size=120)
    key = splits.tree_key(1, 5)
    weight = splits.bootstrap(np.arange(120, dtype=np.int64), key)
    exponent = splits.unit(len(y), np.abs(y).max())
    there = weight > 0
    tree = splits.grow_exact(x[there], weight[there] * splits.in_units(y[there], exponent), weight[there], exponent, key, 2, 2)
    assert splits.Ensemble([tree]).predict(x) == pytest.approx(plain_tree(x, y, weight, key, 2, 2), abs=1e-6)


def test_depth_has_no_limit():
    x, weight, key = np.arange(80.0)[:, None], np.ones(80, dtype=int), splits.tree_key(0, 0)
    for least, depth in ((2, 31), (1, 60)):
        tree = splits.grow_exact(x, 3.0 ** np.arange(80), weight, 0, key, least, 1)  # each split peels rows off the top
        assert tree.depth() > depth
        assert np.unique(splits.Ensemble([tree]).predict(x), return_counts=True)[1].min() >= least


def test_bootstrap_and_feature_draws():
    keys = splits.tree_key(42, 7), splits.tree_key(42, 8)
    h = np.arange(200_000, dtype=np.int64)
    first, second = (splits.bootstrap(h, k) for k in keys)
    assert first.mean() == pytest.approx(1, abs=0.01) and first.var() == pytest.approx(1, abs=0.02)
    assert abs(np.corrcoef(first, second)[0, 1]) < 0.01
    drawn = splits.drawn_features(splits.mixed(np.arange(40_000, dtype=np.uint64)), 10, 5)
    assert (drawn.sum(axis=1) == 5).all() and drawn.mean(axis=0) == pytest.approx(np.full(10, 0.5), abs=0.02)


def test_forest_by_level_and_by_shuffle(spark, frame, table, monkeypatch):
    """Upper levels by aggregates, the rest by tasks; and trees that come to the rows."""
    forest = random_forest(trees=8, seed=3)
    level_table = cell_table(spark, frame, layout=BY_LEVEL)
    fitted = forest.fit_cells(level_table, "train", [4])
    kinds = {r["node"] for r in fitted.trees.select("node").collect()}
    assert -1 in kinds and max(kinds) > 0 and max(r["rows"] for r in fitted.trees.filter("node > 0").collect()) <= 30
    rows = level_table.cells("train", 4, 4)
    want = {(r["device_id"], r["ts"]): r["p"] for r in fitted.at(rows, 4, "p").collect()}
    fitted.models = None
    got = {(r["device_id"], r["ts"]): r["p"] for r in fitted.at(rows, 4, "p").collect()}
    assert got == pytest.approx(want)
    again = forest.fit_cells(cell_table(spark, frame, layout=BY_LEVEL, partitions=6), "train", [4])
    assert same_trees(fitted.trees.collect(), again.trees.collect())

    small = forest.fit_cells(table, "train", [4])
    want = {(r["device_id"], r["ts"]): r["p"] for r in small.at(rows, 4, "p").collect()}
    monkeypatch.setattr(trees, "MODEL_BYTES", 10)
    beyond = forest.fit_cells(table, "train", [4])
    assert beyond.models is None
    assert {(r["device_id"], r["ts"]): r["p"] for r in beyond.at(rows, 4, "p").collect()} == pytest.approx(want)
    x, y = imputed(frame, "train", 4)
    for model in (small.models[0],):
        assert np.sqrt(np.mean((model.predict(x) - y) ** 2)) < 0.5 * y.std()


def test_forest_trees_do_not_depend_on_their_company(spark, table):
    few, many = (random_forest(trees=n, seed=9).fit_cells(table, "train", [4]).trees for n in (3, 11))
    assert same_trees(few.collect(), many.filter("number < 3").collect())


def test_a_level_of_a_large_boosted_model_is_one_job(spark, frame):
    """Three leaves are two levels; besides them a tree may need its unit again, and some trees a write."""
    table = cell_table(spark, frame, layout=BY_LEVEL)
    bin_edges(table), prefix_rows(table)  # made once, for both
    jobs = {}
    for turns in (1, 5):
        member = trees.Member("boosting", "train", 4, 1, boosting(max_iter=turns, max_leaf_nodes=3, min_samples_leaf=4).settings)
        spark.sparkContext.setJobGroup(f"boosting {turns}", "trees")
        trees.boost_by_level(table, [member], [0])
        jobs[turns] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"boosting {turns}"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[5] - jobs[1] <= 4 * 3 + 2


def test_rows_go_down_a_tree_together(monkeypatch):
    """Rows at the leaves of a tree by their bins, some at a time, from the root or from nodes on the way, as one row goes alone."""
    monkeypatch.setattr(splits, "DESCENDED_AT_ONCE", 7)
    rng = np.random.default_rng(3)
    bins = rng.integers(0, 6, (100, 4)).astype(np.uint8)
    feature, cut, left = np.array([0, 2, -1, 3, -1, -1, -1]), np.array([2, 4, 0, 0, 0, 0, 0]), np.array([1, 3, -1, 5, -1, -1, -1])

    def alone(row, node):
        while feature[node] >= 0:
            node = left[node] + (row[feature[node]] > cut[node])
        return node

    for start in (np.zeros(100, dtype=np.int64), rng.choice([0, 1, 2, 3], 100)):
        found = splits.descended(bins, start, feature, cut, left)
        assert found.tolist() == [alone(row, node) for row, node in zip(bins, start)]
    assert len(splits.descended(bins[:0], np.zeros(0, dtype=np.int64), feature, cut, left)) == 0


def test_sums_of_bins_do_not_depend_on_how_many_rows_are_added_at_once(monkeypatch):
    rng = np.random.default_rng(4)
    bins, slot, weight = rng.integers(0, 5, (50, 3)).astype(np.uint8), rng.integers(0, 2, 50), rng.integers(0, 9, 50)
    want = np.zeros((2, 2, 3, 5))
    for row, s, w in zip(bins, slot, weight):
        for f, b in enumerate(row):
            want[:, s, f, b] += (1, w)
    for at_once in (7, 1000):
        monkeypatch.setattr(splits, "SUMMED_AT_ONCE", at_once)
        assert (splits.bin_sums(bins, slot, 2, 5, None, weight) == want).all()


def test_rows_of_a_large_forest_are_handed_over_packed(spark, frame, monkeypatch):
    """A task sends a record per node with its rows, none per row and tree; small blocks and single passes give the same trees."""
    plans, keep = [], trees.keep_columnar

    def kept(df):
        plans.append(df._jdf.queryExecution().analyzed().toString())
        return keep(df)

    monkeypatch.setattr(trees, "keep_columnar", kept)
    table, found = cell_table(spark, frame, layout=BY_LEVEL), []
    for block, slots in ((1 << 16, 256), (20, 2)):
        monkeypatch.setattr(trees, "BLOCK_ROWS", block)
        monkeypatch.setattr(trees, "SLOTS_AT_ONCE", slots)
        fitted = random_forest(4).fit_cells(table, "train", [4])
        found.append(sorted((r["number"], r["node"], r["rows"], bytes(r["threshold"]), bytes(r["value"])) for r in fitted.trees.collect()))
    assert found[0] == found[1] and len(found[0]) > 8
    finished = [line for text in plans for line in text.splitlines() if "FlatMapGroupsInArrow [number" in line]
    assert finished and all(re.search(r"\bw#\d+[,)\]]", line) for line in finished)  # packed: not a long of one row


def test_large_boosted_models_are_written_after_every_tree(spark, frame, monkeypatch):
    """With many rows a tree's values are added once and kept, not again at each level; the trees are the same."""
    kept, keep, found = [], trees.keep_columnar, []
    monkeypatch.setattr(trees, "keep_columnar", lambda df: kept.append(df.columns) or keep(df))
    for rows in (1 << 23, 1):
        monkeypatch.setattr(trees, "ROWS_OF_WRITES", rows)
        kept.clear()
        fitted = boosting(max_iter=5, max_leaf_nodes=4, min_samples_leaf=5).fit_cells(cell_table(spark, frame, layout=BY_LEVEL), "train", [4])
        found.append((kept.count(["y", "bins", "p"]), fitted.trees.collect()))
    assert [n for n, _ in found] == [2, 6]
    assert same_trees(*[grown for _, grown in found])
