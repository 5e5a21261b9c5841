"""Boosting and forest over all devices, grown as one job for many models.

A *member* is a boosted model or a tree of a forest, fitted on one prefix of
the rows. All members of a call are grown together:

- Members whose prefix has at most ``Layout.task_rows`` rows get their rows
  in one shuffle, and a task grows each of them.
- Larger boosted ones grow by level, a job of one stage each: tasks sum blocks of
  rows by (member, node, feature, bin), the driver adds up the tasks' sums.
- Larger forests grow by level. Tasks sum the rows by (tree, node,
  feature, bin), the best splits come back, one row per node, and the next level
  follows. Nodes with at most ``task_rows`` rows are then finished by one
  task each, to any depth.

Sums are exact (see ``splits``), bootstraps and feature draws are hashes of row
and node keys. So a member is the same grown alone or with others, and
a boosted one also in one task or in many. In a forest, nodes that one task
holds are split between any two neighbouring values, larger ones between bins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.columns import q
from driftline.operators import splits
from driftline.operators.binning import bin_edges, inputs, prefix_rows, with_fills
from driftline.operators.celltable import CellTable
from driftline.operators.estimators import Estimator, Fitted
from driftline.operators.splits import BestFirst, Ensemble, Tree
from driftline.session import drop_kept, keep_columnar, ship_package

LEAST_IN_LEAF = 2  # of a forest's trees
FEATURE_SHARE = 0.5  # of the features, drawn for each split of a forest's tree
SLOTS_AT_ONCE = 256  # nodes whose bins are summed by one pass
TREES_BETWEEN_WRITES, ROWS_OF_WRITES = 4, 1 << 23  # of a large boosted model; with so many rows every tree is followed by one
BLOCK_ROWS = 1 << 16  # of a large model, packed in one record, in a forest in one per node
SUMS_BYTES = 64 << 20  # of all tasks' sums that the driver adds up at once
PAIRS_AT_ONCE = 200_000_000  # rows times trees that one pass sends to the tasks that finish trees
MODEL_BYTES = 64 << 20  # up to which a model is broadcast

TREE_SCHEMA = (
    "member int, number int, node long, rows long, start double, "
    "feature binary, threshold binary, left binary, right binary, value binary"
)


@dataclass(frozen=True)
class Member:
    """One model to be fitted on the rows before a cell; ``kind`` is ``boosting`` or ``forest``."""

    kind: str
    scheme: str
    cell: int
    seed: int
    settings: dict


def hashed_row(table: CellTable) -> Column:
    return F.xxhash64(q(table.spec.device), q(table.spec.time))


def tree_row(member: int, number: int, tree: Tree, node: int = 0, rows: int = 0, start: float = 0.0) -> dict:
    return {"member": member, "number": number, "node": node, "rows": rows, "start": start, **tree.packed()}


TREE_ARROW = pa.schema([
    ("member", pa.int32()), ("number", pa.int32()), ("node", pa.int64()), ("rows", pa.int64()), ("start", pa.float64()),
    *[(name, pa.binary()) for name in Tree.KINDS],
])


def tree_table(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, TREE_ARROW)


def matrix(lists: pa.ChunkedArray | pa.ListArray, width: int) -> np.ndarray:
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


# --- members that one task can grow ---------------------------------------------------


def grow_in_tasks(table: CellTable, members: Sequence[Member], numbers: Sequence[int]) -> DataFrame:
    """Trees of the members ``numbers``, each grown by one task; a forest's trees are dealt over several."""
    ship_package(table.rows.sparkSession)
    cores = max(1, table.rows.sparkSession.sparkContext.defaultParallelism)
    trees = sum(members[m].settings["n_estimators"] for m in numbers if members[m].kind == "forest")
    at_once = max(1, math.ceil(trees / (2 * cores)))
    units = []  # (member, first tree, last tree)
    for m in numbers:
        count = members[m].settings["n_estimators"] if members[m].kind == "forest" else 0
        units += [(m, a, min(count, a + at_once)) for a in range(0, max(count, 1), at_once)]
    units.sort(key=lambda u: -members[u[0]].settings.get("max_iter", 0))
    wanted = F.array_compact(F.array(*[
        F.when(table.in_prefix(members[m].scheme, members[m].cell), F.lit(i)) for i, (m, _, _) in enumerate(units)
    ]))
    prefix = F.array(*[F.lit(table.prefix_number(members[m].scheme, members[m].cell)) for m, _, _ in units])[F.col("unit")]
    rows = with_fills(table, table.fit_rows).select(
        hashed_row(table).alias("h"), q(table.spec.target).alias("y"), F.explode(wanted).alias("unit"),
        *[q(c) for c in table.spec.features], "fills",
    )
    dealt = rows.select("unit", "h", "y", F.array(*inputs(table, prefix)).alias("x")).repartitionByRange(len(units), "unit")
    about = {m: members[m] for m in numbers}
    features = len(table.spec.features)

    def grow(part: pa.Table) -> pa.Table:
        m, first, last = units[part["unit"][0].as_py()]
        member = about[m]
        x, y, h = matrix(part["x"], features), part["y"].to_numpy(), part["h"].to_numpy()
        if member.kind == "forest":
            return tree_table([
                tree_row(m, t, whole_tree(x, y, h, member, t), rows=len(y)) for t in range(first, last)
            ])
        edges = splits.column_edges(x)
        start, grown = splits.boost(splits.binned(x, edges), y, edges, member.settings)
        empty = [tree_row(m, -1, Tree(*[np.zeros(0)] * 5), start=start)]  # the start value also of a model without trees
        return tree_table(empty + [tree_row(m, t, tree, rows=len(y), start=start) for t, tree in enumerate(grown)])

    return dealt.groupBy("unit").applyInArrow(grow, TREE_SCHEMA)


def chosen_features(features: int) -> int:
    return max(1, int(FEATURE_SHARE * features))


def whole_tree(x: np.ndarray, y: np.ndarray, h: np.ndarray, member: Member, number: int) -> Tree:
    key = splits.tree_key(member.seed, number)
    weight = splits.bootstrap(h, key)
    drawn = np.flatnonzero(weight)
    if not len(drawn):  # a bootstrap of very few rows may be empty
        drawn, weight = np.arange(len(y)), np.ones(len(y), dtype=np.int64)
    exponent = splits.unit(len(y), np.abs(y).max(initial=0.0))
    g = weight[drawn] * splits.in_units(y[drawn], exponent)
    return splits.grow_exact(x[drawn], g, weight[drawn], exponent, key, LEAST_IN_LEAF, chosen_features(x.shape[1]))


# --- members of any size, by level ----------------------------------------------------


def large_rows(table: CellTable, scheme: str, cell: int) -> DataFrame:
    """``(h, y, x, bins)`` of one prefix, kept."""
    ship_package(table.rows.sparkSession)
    edges, features = bin_edges(table)[scheme, cell], len(table.spec.features)
    prefix = F.lit(table.prefix_number(scheme, cell))
    rows = with_fills(table, table.fit_rows.filter(table.in_prefix(scheme, cell))).select(
        hashed_row(table).alias("h"), q(table.spec.target).alias("y"), F.array(*inputs(table, prefix)).alias("x")
    )

    def add_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = splits.binned(matrix(batch.column("x"), features), edges)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([row.tobytes() for row in bins], pa.binary())], ["h", "y", "x", "bins"]
            )

    return keep_columnar(rows.mapInArrow(add_bins, "h long, y double, x array<double>, bins binary"))


def bins_of(batch: pa.RecordBatch, features: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("bins").to_pylist()), dtype=np.uint8).reshape(-1, features)


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at least ``BLOCK_ROWS``, but for the last one."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= BLOCK_ROWS:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def exact_total(rows: DataFrame, n: int) -> tuple[int, float, int]:
    """Largest absolute target's unit, and the sum of the targets in it."""
    largest = rows.agg(F.max(F.abs("y"))).first()[0] or 0.0
    exponent = splits.unit(n, largest)
    total = rows.agg(F.sum(F.rint(F.col("y") * F.lit(math.ldexp(1.0, exponent))).cast("long"))).first()[0]
    return exponent, float(total or 0)


def summed_splits(
    rows: DataFrame, columns: list[str], sums_of, slots: int, features: int, l2: dict[int, float], least: dict[int, int],
    allowed: np.ndarray | None,
) -> dict[int, tuple]:
    """Best split of each slot, and its rows, weight and sum, from one record per task and slot.

    ``sums_of(batch)`` gives for some slots the bins of rows, their places among
    these slots (-1: none), weights and values. A task adds up its rows first.
    """
    width = splits.MOST_BINS

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((3, slots, features, width))
        for batch in batches:
            for mine, bins, place, weight, value in sums_of(batch):
                live = np.flatnonzero(place >= 0)
                held[:, mine] += splits.bin_sums(bins[live], place[live], len(mine), width, None, weight[live], value[live])
        there = np.flatnonzero(held[0].any(axis=(1, 2)))
        for first in range(0, len(there), 64):
            some = there[first:first + 64]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some.astype(np.int32)), pa.array([held[:, i].tobytes() for i in some], pa.binary())], ["slot", "sums"]
            )

    def best(part: pa.Table) -> pa.Table:
        number, total = part["slot"][0].as_py(), np.zeros((3, 1, features, width))
        for record in part["sums"]:
            total += np.frombuffer(record.as_buffer()).reshape(total.shape)
        n, w, s = total
        found = splits.best_splits(n, w, s, l2[number], least[number], None if allowed is None else allowed[number:number + 1]).row(0)
        whole = tuple(float(a[0, 0].sum()) for a in (n, w, s))
        return pa.table({"slot": pa.array([number], pa.int32()), "found": [[float(v) for v in (*found, *whole)]]})

    whole = rows.select(*columns).mapInArrow(add, "slot int, sums binary")
    out = whole.groupBy("slot").applyInArrow(best, "slot int, found array<double>").collect()  # one row per node
    return {r["slot"]: tuple(int(v) if i in (1, 2) else v for i, v in enumerate(r["found"])) for r in out}


@dataclass
class Grown:
    """Nodes of a finished boosted tree by bins, for rows whose predictions are brought up to date."""

    tree: BestFirst
    values: np.ndarray

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return self.values[self.tree.descend(bins, np.zeros(len(bins), dtype=np.int64))]


def packed_rows(rows: DataFrame, start: float, models: int) -> DataFrame:
    """``(y, bins, p)`` of up to ``BLOCK_ROWS`` rows a record, kept; ``p``: every model's start value."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def block() -> pa.RecordBatch:
            y = np.concatenate([batch.column("y").to_numpy() for batch in held])
            bins = b"".join(x for batch in held for x in batch.column("bins").to_pylist())
            return pa.RecordBatch.from_pydict({"y": [y.tobytes()], "bins": [bins], "p": [np.full((models, len(y)), start).tobytes()]})

        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK_ROWS):
                held.append(batch.slice(first, BLOCK_ROWS))
                size += held[-1].num_rows
                if size >= BLOCK_ROWS:
                    yield block()
                    held, size = [], 0
        if size:
            yield block()

    return keep_columnar(rows.select("y", "bins").mapInArrow(pack, "y binary, bins binary, p binary"))


def predicted_blocks(
    batches: Iterator[pa.RecordBatch], grown: Sequence[Sequence[Grown]], features: int, which: Sequence[int]
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, dict[int, np.ndarray]]]:
    """Of each block: its record, targets, bins, and the predictions of some models with their trees ``grown`` since."""
    for batch in batches:
        for k in range(batch.num_rows):
            record = batch.slice(k, 1)
            y, bins, p = (np.frombuffer(record.column(c)[0].as_buffer(), dtype=kind) for c, kind in (("y", float), ("bins", np.uint8), ("p", float)))
            bins, stored, predicted = bins.reshape(-1, features), p.reshape(len(grown), -1), {}
            for i in which:
                predicted[i] = stored[i]
                for tree in grown[i]:
                    predicted[i] = predicted[i] + tree.predict(bins)
            yield record, y, bins, predicted


def block_sums(
    blocks: DataFrame, asked: Mapping[int, list[int]], growing: Mapping[int, BestFirst], grown: Sequence[Sequence[Grown]],
    units: Mapping[int, int], features: int, width: int,
) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Of each model asked for: the largest residual, and counts and sums by (node, feature, bin) of its nodes."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = dict.fromkeys(asked, 0.0)
        held = {i: np.zeros((2, len(nodes), features, width)) for i, nodes in asked.items()}
        for _, y, bins, predicted in predicted_blocks(batches, grown, features, list(asked)):
            for i, nodes in asked.items():
                r, at = y - predicted[i], np.zeros(len(y), dtype=np.int64)
                most[i] = max(most[i], float(np.abs(r).max(initial=0.0)))
                slot = np.full(len(growing[i].split) if i in growing else 1, -1)
                slot[nodes] = np.arange(len(nodes))
                if i in growing:
                    at = growing[i].descend(bins, at)
                for total, part in zip(held[i], splits.node_sums(bins, at, slot, len(nodes), width, splits.in_units(r, units[i]))):
                    total += part
        yield pa.RecordBatch.from_pydict({
            "i": pa.array(list(asked), pa.int32()), "most": list(most.values()), "sums": [held[i].tobytes() for i in asked],
        })

    found = {i: (0.0, *np.zeros((2, len(nodes), features, width))) for i, nodes in asked.items()}
    for row in blocks.mapInArrow(add, "i int, most double, sums binary").toArrow().to_pylist():
        largest, counts, sums = found[row["i"]]
        more = np.frombuffer(row["sums"]).reshape(2, *counts.shape)
        found[row["i"]] = max(largest, row["most"]), counts + more[0], sums + more[1]
    return found


def boost_by_level(table: CellTable, members: Sequence[Member], numbers: Sequence[int]) -> list[dict]:
    """Trees of boosted members on one large prefix, all of them a level at a time."""
    first, features = members[numbers[0]], len(table.spec.features)
    edges, n = bin_edges(table)[first.scheme, first.cell], prefix_rows(table)[first.scheme, first.cell]
    rows = large_rows(table, first.scheme, first.cell)
    exponent, total = exact_total(rows, n)
    start = splits.start_value(n, total, exponent)
    every, settings = list(range(len(numbers))), [members[m].settings for m in numbers]
    blocks, width = packed_rows(rows, start, len(every)), max(len(e) for e in edges) + 1
    at_once = max(1, SUMS_BYTES // (16 * features * width * max(1, blocks.rdd.getNumPartitions())))
    out = [tree_row(m, -1, Tree(*[np.zeros(0)] * 5), start=start) for m in numbers]
    recent: list[list[Grown]] = [[] for _ in every]
    units = dict.fromkeys(every, exponent)
    between = max(1, min(TREES_BETWEEN_WRITES, ROWS_OF_WRITES // n))  # many rows are written sooner than predicted again at each level

    def summed(asked: list[tuple[int, int]], trees: Mapping[int, BestFirst]) -> tuple[dict, dict]:
        most, found = {}, {}
        for a in range(0, len(asked), at_once):
            mine: dict[int, list[int]] = {}
            for i, node in asked[a:a + at_once]:
                mine.setdefault(i, []).append(node)
            part = block_sums(blocks, mine, {i: trees[i] for i in mine if i in trees}, recent, {i: units[i] for i in mine}, features, width)
            for i, (largest, counts, sums) in part.items():
                most[i] = largest
                found.setdefault(i, {}).update(zip(mine[i], zip(counts, sums)))
        return most, found

    for turn in range(max(s["max_iter"] for s in settings)):
        active = [i for i in every if settings[i]["max_iter"] > turn]
        roots, unsure = {}, active
        while unsure:  # the unit follows from the largest residual and is mostly that of the tree before
            most, found = summed([(i, 0) for i in unsure], {})
            right = {i: splits.unit(n, most[i]) for i in unsure}
            roots.update({i: found[i] for i in unsure if right[i] == units[i]})
            unsure = [i for i in unsure if right[i] != units[i]]
            units.update(right)
        trees = {
            i: BestFirst(n, float(roots[i][0][1][0].sum()), settings[i]["max_leaf_nodes"], settings[i]["min_samples_leaf"]) for i in active
        }
        held: dict[int, dict] = {i: {} for i in active}
        found = roots
        while wanted := {i: nodes for i in active if (nodes := trees[i].wanted())}:
            if found is not roots:
                _, found = summed([(i, node) for i, nodes in wanted.items() for node in trees[i].summed(nodes, held[i])], trees)
            for i, nodes in wanted.items():
                learned = settings[i]["l2_regularization"], settings[i]["min_samples_leaf"]
                splits.learn_sums(trees[i], nodes, held[i], found[i], *learned)
            found = None
        for i in active:
            values = trees[i].leaf_values(settings[i]["learning_rate"], settings[i]["l2_regularization"], units[i])
            recent[i].append(Grown(trees[i], values))
            out.append(tree_row(numbers[i], turn, trees[i].tree(edges, values), rows=n, start=start))
        if (turn + 1) % between == 0:
            def advance(batches: Iterator[pa.RecordBatch], grown=recent) -> Iterator[pa.RecordBatch]:
                for record, _, _, predicted in predicted_blocks(batches, grown, features, every):
                    p = np.stack([predicted[i] for i in every]).tobytes()
                    yield pa.RecordBatch.from_arrays([record.column("y"), record.column("bins"), pa.array([p], pa.binary())], ["y", "bins", "p"])

            before, blocks = blocks, keep_columnar(blocks.mapInArrow(advance, "y binary, bins binary, p binary"))
            drop_kept(before)
            recent = [[] for _ in every]
    return out


@dataclass
class TopTree:
    """The upper part of a forest's tree. Leaves that are ``handed`` over have few rows and are finished by a task."""

    feature: list = field(default_factory=lambda: [-1])
    cut: list = field(default_factory=lambda: [0])
    left: list = field(default_factory=lambda: [-1])
    key: list = field(default_factory=list)
    n: list = field(default_factory=lambda: [0])
    weight: list = field(default_factory=lambda: [0.0])
    total: list = field(default_factory=lambda: [0.0])
    handed: set = field(default_factory=set)

    def descend(self, bins: np.ndarray) -> np.ndarray:
        return splits.descended(bins, np.zeros(len(bins), dtype=np.int64), *map(np.array, (self.feature, self.cut, self.left)))

    def tree(self, edges: list[np.ndarray], exponent: int) -> Tree:
        """With the mean of their rows at the leaves; handed ones are replaced by their subtrees."""
        threshold = [edges[f][c] if f >= 0 else 0.0 for f, c in zip(self.feature, self.cut)]
        right = [x + 1 if x >= 0 else -1 for x in self.left]
        value = [math.ldexp(t / w, -exponent) if w else 0.0 for t, w in zip(self.total, self.weight)]
        return Tree(np.array(self.feature), np.array(threshold), np.array(self.left), np.array(right), np.array(value))


def forest_by_level(table: CellTable, members: Sequence[Member], m: int) -> list[DataFrame]:
    """Trees of a forest on a large prefix: the upper levels by aggregates, small nodes by one task each."""
    spark, member, features = table.rows.sparkSession, members[m], len(table.spec.features)
    prefix = member.scheme, member.cell
    edges, n, most = bin_edges(table)[prefix], prefix_rows(table)[prefix], table.layout.task_rows
    rows = large_rows(table, *prefix)
    exponent, _ = exact_total(rows, n)
    count = member.settings["n_estimators"]
    keys = [splits.tree_key(member.seed, t) for t in range(count)]
    tops = [TopTree(key=[k]) for k in keys]
    open_nodes = [(t, 0) for t in range(count)]

    def drawn(batch: pa.RecordBatch, which: Iterator[int]) -> Iterator[tuple]:
        """Of each tree: the places of its drawn rows, how often they were drawn, bins and values."""
        bins, h = bins_of(batch, features), batch.column("h").to_numpy()
        g = splits.in_units(batch.column("y").to_numpy(), exponent)
        for t in which:
            weight = splits.bootstrap(h, keys[t])
            there = np.flatnonzero(weight)
            yield t, there, weight[there], bins[there], weight[there] * g[there]

    while open_nodes:
        following = []
        for a in range(0, len(open_nodes), SLOTS_AT_ONCE):
            chunk = open_nodes[a:a + SLOTS_AT_ONCE]
            mine: dict[int, list[tuple[int, int]]] = {}
            for slot, (t, node) in enumerate(chunk):
                mine.setdefault(t, []).append((node, slot))
            growing = {t: tops[t] for t in mine}

            def sums_of(batch: pa.RecordBatch, mine=mine, growing=growing):
                for t, _, weight, bins, g in drawn(batch, mine):
                    place = np.full(len(growing[t].feature), -1)
                    place[[node for node, _ in mine[t]]] = np.arange(len(mine[t]))
                    yield [slot for _, slot in mine[t]], bins, place[growing[t].descend(bins)], weight, g

            node_keys = np.array([tops[t].key[node] for t, node in chunk], dtype=np.uint64)
            allowed = splits.drawn_features(node_keys, features, chosen_features(features))
            best = summed_splits(
                rows, ["h", "y", "bins"], sums_of, len(chunk), features, dict.fromkeys(range(len(chunk)), 0.0),
                dict.fromkeys(range(len(chunk)), LEAST_IN_LEAF), allowed,
            )
            for slot, (t, node) in enumerate(chunk):
                if slot not in best:
                    continue
                top, (gain, feature, cut, n_left, w_left, s_left, n_all, w_all, s_all) = tops[t], best[slot]
                top.n[node], top.weight[node], top.total[node] = n_all, w_all, s_all
                if gain <= splits.ROUNDING * s_all**2 / w_all:
                    continue
                top.feature[node], top.cut[node], top.left[node] = feature, cut, len(top.feature)
                sides = ((n_left, w_left, s_left), (n_all - n_left, w_all - w_left, s_all - s_left))
                for (size, weight, total), key in zip(sides, splits.child_keys(np.array([top.key[node]], dtype=np.uint64))):
                    child = len(top.feature)
                    for name, value in (("feature", -1), ("cut", 0), ("left", -1), ("key", key[0]), ("n", size), ("weight", weight), ("total", total)):
                        getattr(top, name).append(value)
                    if size > most:
                        following.append((t, child))
                    else:
                        top.handed.add(child)
        open_nodes = following

    parts = []
    at_once = max(1, PAIRS_AT_ONCE // max(1, n))
    for first in range(0, count, at_once):
        last = min(count, first + at_once)
        some = tops[first:last]

        def hand_over(batches: Iterator[pa.RecordBatch], some=some, first=first) -> Iterator[pa.RecordBatch]:
            """The drawn rows of each handed node, those of a block of rows in one record."""
            for block in blocks_of(batches):
                x = matrix(block.column("x"), features)
                for t, there, weight, bins, g in drawn(block, range(first, first + len(some))):
                    top = some[t - first]
                    node = top.descend(bins)
                    few = np.flatnonzero(np.isin(node, list(top.handed)))
                    few = few[np.argsort(node[few], kind="stable")]
                    of, starts = np.unique(node[few], return_index=True)
                    weight, g, rows_of = weight[few].astype(np.uint8), g[few], there[few]
                    spans = list(zip(starts.tolist(), [*starts[1:].tolist(), len(few)]))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(of), t, dtype=np.int32)), pa.array(of.astype(np.int64)),
                        *[pa.array([values[a:b].tobytes() for a, b in spans], pa.binary()) for values in (weight, g, x[rows_of])],
                    ], ["number", "node", "w", "g", "x"])

        pairs = rows.select("h", "y", "x", "bins").mapInArrow(hand_over, "number int, node long, w binary, g binary, x binary")
        parts.append(pairs.groupBy("number", "node").applyInArrow(finisher(m, some, first, exponent, features), TREE_SCHEMA))
    upper = [tree_row(m, t, top.tree(edges, exponent), -1 if top.handed else 0, n) for t, top in enumerate(tops)]
    return [keep_columnar(part) for part in parts] + [spark.createDataFrame(tree_table(upper))]


def finisher(m: int, tops: list[TopTree], first: int, exponent: int, features: int):
    """Grows the rest of a tree below one of its handed nodes."""

    def finish(part: pa.Table) -> pa.Table:
        t, node = part["number"][0].as_py(), part["node"][0].as_py()
        w, g, x = (
            np.concatenate([np.frombuffer(record.as_buffer(), dtype=kind) for record in part[c]]) for c, kind in (("w", np.uint8), ("g", float), ("x", float))
        )
        x, w = x.reshape(-1, features), w.astype(np.int64)
        tree = splits.grow_exact(x, g, w, exponent, tops[t - first].key[node], LEAST_IN_LEAF, chosen_features(features))
        return tree_table([tree_row(m, t, tree, node, len(g))])

    return finish


# --- models ---------------------------------------------------------------------------


def grow(table: CellTable, members: Sequence[Member]) -> DataFrame:
    """All members' trees, kept: whole trees have ``node`` 0, upper parts -1, subtrees the upper part's leaf they hang on."""
    rows = prefix_rows(table)
    small = [i for i, m in enumerate(members) if rows[m.scheme, m.cell] <= table.layout.task_rows]
    parts = [grow_in_tasks(table, members, small)] if small else []
    large: dict[tuple, list[int]] = {}
    for i in sorted(set(range(len(members))) - set(small)):
        m = members[i]
        if m.kind == "boosting":
            large.setdefault((m.scheme, m.cell), []).append(i)
        else:
            parts += forest_by_level(table, members, i)
    grown = [row for numbers in large.values() for row in boost_by_level(table, members, numbers)]
    if grown:
        parts.append(table.rows.sparkSession.createDataFrame(tree_table(grown)))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return keep_columnar(whole)


def joined_tree(upper: Tree, below: dict[int, Tree]) -> Tree:
    """An upper part with its subtrees in place of the leaves they hang on."""
    arrays = [a.copy() for a in (upper.feature, upper.threshold, upper.left, upper.right, upper.value)]
    parts, size = [arrays], len(upper.feature)
    for node, tree in sorted(below.items()):
        shift = size - 1  # its root takes the leaf's place
        left, right = (np.where(a > 0, a + shift, a) for a in (tree.left, tree.right))
        own = (tree.feature, tree.threshold, left, right, tree.value)
        for a, b in zip(arrays, own):
            a[node] = b[0]
        parts.append([b[1:] for b in own])
        size += len(tree.feature) - 1
    return Tree(*[np.concatenate(columns) for columns in zip(*parts)])


def ensembles(trees: DataFrame, members: Sequence[Member]) -> dict[int, Ensemble]:
    """The members' models, brought to the driver; only where their size has been checked."""
    found: dict[int, dict[int, dict[int, Tree]]] = {i: {} for i in range(len(members))}
    starts = dict.fromkeys(found, 0.0)
    for row in trees.toArrow().to_pylist():
        starts[row["member"]] = row["start"]
        if row["number"] >= 0:
            found[row["member"]].setdefault(row["number"], {})[row["node"]] = Tree.unpacked(row)
    out = {}
    for i, by_number in found.items():
        whole = []
        for _, parts in sorted(by_number.items()):
            upper = parts.pop(-1, None)
            whole.append(parts[0] if upper is None else joined_tree(upper, parts))
        out[i] = Ensemble(whole, starts[i], len(whole) if members[i].kind == "forest" else 1.0)
    return out


@dataclass
class TreesFitted(Fitted):
    """One tree model per cell; broadcast if small, else its trees come to the rows by shuffle."""

    table: CellTable
    scheme: str
    members: dict[int, int]  # cell -> member
    trees: DataFrame = field(repr=False)
    models: dict[int, Ensemble] | None = field(repr=False)

    @property
    def cells(self) -> tuple[int, ...]:
        return tuple(sorted(self.members))

    def at(self, rows: DataFrame, cell: int, out: str) -> DataFrame:
        if self.models is not None:
            return add_tree_predictions(rows, {out: self}, [cell])
        prefix = F.lit(self.table.prefix_number(self.scheme, cell))
        values = F.array(*inputs(self.table, prefix))
        return self._by_shuffle(with_fills(self.table, rows).withColumn("_x", values).drop("fills"), cell, out)

    def _by_shuffle(self, rows: DataFrame, cell: int, out: str) -> DataFrame:
        """Each row goes to its subtree of every tree; the upper parts are few nodes and broadcast."""
        if rows.isStreaming:
            raise ValueError(f"a model above {MODEL_BYTES} bytes scores tables, not streams")
        member, features = self.members[cell], len(self.table.spec.features)
        own = self.trees.filter((F.col("member") == member) & (F.col("number") >= 0))
        count = own.agg(F.max("number")).first()[0] + 1
        upper = {r["number"]: Tree.unpacked(r.asDict()) for r in own.filter("node = -1").collect()}
        hangers = {t: set() for t in upper}
        for r in own.filter("node > 0").select("number", "node").collect():  # one per task_rows rows and tree
            hangers[r["number"]].add(r["node"])
        kept = keep_columnar(rows.withColumn("_rid", F.monotonically_increasing_id()))
        asked_rows = kept.count()
        copies = max(1, math.ceil(asked_rows / self.table.layout.task_rows))

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, rid = matrix(batch.column("_x"), features), batch.column("_rid")
                for t in range(count):
                    node = np.zeros(len(x), dtype=np.int64)
                    done = np.full(len(x), np.nan)
                    if t in upper:
                        tree = upper[t]
                        live = np.flatnonzero(tree.feature[node] >= 0)
                        while len(live):
                            at = node[live]
                            right = x[live, tree.feature[at]] > tree.threshold[at]
                            node[live] = np.where(right, tree.right[at], tree.left[at])
                            live = live[tree.feature[node[live]] >= 0]
                        ends = ~np.isin(node, list(hangers[t]))
                        done[ends] = tree.value[node[ends]]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(x), t, dtype=np.int32)), pa.array(node), rid, batch.column("_x"), pa.array(done, from_pandas=True),
                    ], ["number", "node", "_rid", "_x", "done"])

        def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows by subtree, the subtree in front of its rows; one subtree and one batch are in memory."""
            tree = None
            for batch in batches:
                heads = np.flatnonzero(batch.column("feature").is_valid().to_numpy(zero_copy_only=False)).tolist()
                value = np.full(batch.num_rows, np.nan)
                starts = heads if heads[:1] == [0] else [0, *heads]
                for a, b in zip(starts, [*starts[1:], batch.num_rows]):
                    if batch.column("feature")[a].is_valid:
                        tree = Ensemble([Tree.unpacked({name: batch.column(name)[a].as_py() for name in Tree.KINDS})])
                        a += 1
                    if b > a:
                        value[a:b] = tree.predict(matrix(batch.column("_x").slice(a, b - a), features))
                rows_only = batch.column("feature").is_null()
                yield pa.RecordBatch.from_arrays([batch.column("_rid").filter(rows_only), pa.array(value).filter(rows_only)], ["_rid", "v"])

        asked = kept.select("_rid", "_x").mapInArrow(route, "number int, node long, _rid long, _x array<double>, done double")
        ended = asked.filter("done IS NOT NULL").select("_rid", F.col("done").alias("v"))
        under = own.filter("node >= 0").select("number", "node", *Tree.KINDS)
        copy = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))).alias("copy")
        dealt = asked.filter("done IS NULL").drop("done").withColumn("copy", F.pmod(F.xxhash64("_rid"), F.lit(copies).cast("long"))).unionByName(
            under.select("*", copy), allowMissingColumns=True
        ).repartition("number", "node", "copy").sortWithinPartitions("number", "node", "copy", F.col("feature").isNull())
        sums = dealt.mapInArrow(finish, "_rid long, v double").unionByName(ended).groupBy("_rid").agg((F.sum("v") / F.lit(count)).alias(out))
        return kept.join(sums, "_rid").drop("_rid", "_x")


def add_tree_predictions(rows: DataFrame, fitted: Mapping[str, TreesFitted], cells: Sequence[int]) -> DataFrame:
    """Predictions of several broadcast models of one scheme by one pass; rows of several cells carry their ``cell``."""
    names, first = list(fitted), next(iter(fitted.values()))
    table, scheme = first.table, first.scheme
    spark, one = rows.sparkSession, len(cells) == 1
    ship_package(spark)
    models = spark.sparkContext.broadcast({c: [fitted[n].models[fitted[n].members[c]] for n in names] for c in cells})
    cell = F.lit(cells[0]) if one else F.col("cell")
    prefix = F.element_at(F.create_map(*[F.lit(x) for c in cells for x in (c, table.prefix_number(scheme, c))]), cell)

    @F.pandas_udf("array<double>")
    def predict(cell: pd.Series, *columns: pd.Series) -> pd.Series:
        x, own = np.column_stack([c.to_numpy(dtype=float) for c in columns]), cell.to_numpy()
        out = np.empty((len(x), len(names)))
        for c in np.unique(own):
            there = np.flatnonzero(own == c)
            for i, model in enumerate(models.value[int(c)]):
                out[there, i] = model.predict(x[there])
        return pd.Series(list(out))

    predicted = with_fills(table, rows).withColumn("_trees", predict(cell, *inputs(table, prefix))).drop("fills")
    return predicted.withColumns({n: F.col("_trees")[i] for i, n in enumerate(names)}).drop("_trees")


@dataclass
class TreeModel(Estimator):
    """Boosting or a forest on median-imputed features; hour and weekday stay numbers."""

    name: str
    kind: str
    seed: int
    settings: dict = field(default_factory=dict)

    def fit_cells(self, table: CellTable, scheme: str, cells: Sequence[int]) -> TreesFitted:
        return fit_trees(table, [self], scheme, cells)[0]


def fit_trees(table: CellTable, models: Sequence[TreeModel], scheme: str, cells: Sequence[int]) -> list[TreesFitted]:
    """Several tree models, all their cells grown together."""
    members = [Member(e.kind, scheme, c, e.seed, e.settings) for e in models for c in cells]
    trees = grow(table, members)
    sizes = trees.groupBy("member").agg(F.sum(sum((F.octet_length(c) for c in Tree.KINDS), F.lit(0))).alias("size")).collect()
    loaded = ensembles(trees, members) if sum(r["size"] for r in sizes) <= MODEL_BYTES else None
    return [
        TreesFitted(table, scheme, {c: i * len(cells) + j for j, c in enumerate(cells)}, trees, loaded) for i in range(len(models))
    ]


def random_forest(trees: int = 300, seed: int = 42) -> TreeModel:
    """Trees of any depth with at least two rows per leaf, half of the features per split, bootstrap samples."""
    return TreeModel("random_forest", "forest", seed, {"n_estimators": trees})


def boosting(
    seed: int = 42,
    learning_rate: float = 0.1,
    max_iter: int = 100,
    max_leaf_nodes: int = 31,
    min_samples_leaf: int = 20,
    l2_regularization: float = 0.0,
) -> TreeModel:
    """Boosted trees on squared error from the mean, grown best-first to a number of leaves, no early stopping."""
    return TreeModel("hist_gradient_boosting", "boosting", seed, {
        "l2_regularization": l2_regularization, "learning_rate": learning_rate, "max_iter": max_iter,
        "max_leaf_nodes": max_leaf_nodes, "min_samples_leaf": min_samples_leaf,
    })
