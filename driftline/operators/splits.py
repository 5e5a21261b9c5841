"""Tree growth on arrays: bins, sums per bin, best splits, best-first and exact growth, prediction.

Everything here works on the rows, or on the sums, that one task holds. Targets
are whole numbers of a common unit, so sums do not depend on the order or the
place in which rows are added up: a tree is the same whether its rows were in
one task or in many.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np

MOST_BINS = 255
EXACT_BITS = 52
WEIGHT_BITS = 5  # a bootstrap weight is below 32
PREDICTED_AT_ONCE = 1 << 21
SUMMED_AT_ONCE = 1 << 16
DESCENDED_AT_ONCE = 1 << 14  # so few that they stay in the processor's cache
ROUNDING = 1e-14


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def unit(rows: int, largest: float) -> int:
    """Exponent e such that sums of ``rows`` weighted values, each rounded to a multiple of 2**-e, are exact."""
    magnitude = int(np.frexp(largest)[1]) if largest > 0 else 0
    return EXACT_BITS - WEIGHT_BITS - int(rows).bit_length() - magnitude


def in_units(values: np.ndarray, exponent: int) -> np.ndarray:
    return np.rint(np.ldexp(values, exponent))


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin of each value: the number of edges below it."""
    return np.column_stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(edges)]).astype(np.uint8)


def edges_of(few: np.ndarray, below: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Middles between neighbouring values, or between the values around each cut, without repeats."""
    low, high = (few[:-1], few[1:]) if len(few) else (below, above)
    middle = low + (high - low) / 2
    return np.unique(np.where(middle < high, middle, low))


def column_edges(x: np.ndarray, most: int = MOST_BINS) -> list[np.ndarray]:
    """Edges of each column's bins from all its values; ``binning`` gives the same from counts."""
    none, out = np.zeros(0), []
    for column in np.sort(x, axis=0).T:
        kinds = column[np.concatenate(([True], column[1:] != column[:-1]))]
        if len(kinds) <= most:
            out.append(edges_of(kinds, none, none))
            continue
        reach = np.arange(1, most, dtype=np.int64) * (len(column) - 1)
        out.append(edges_of(none, column[reach // most], column[-(-reach // most)]))
    return out


def bin_sums(bins: np.ndarray, slot: np.ndarray, slots: int, width: int, *weights: np.ndarray | None) -> np.ndarray:
    """``(weights, slots, features, width)``: sums of each weight, and counts for None; some rows at a time."""
    features = bins.shape[1]
    out = np.zeros((len(weights), features, slots * width))
    for first in range(0, len(bins), SUMMED_AT_ONCE):
        own = slice(first, first + SUMMED_AT_ONCE)
        base = slot[own].astype(np.int64) * width
        for f in range(features):
            key = base + bins[own, f]
            for total, w in zip(out[:, f], weights):
                total += np.bincount(key, None if w is None else w[own], minlength=slots * width)
    return out.reshape(len(weights), features, slots, width).transpose(0, 2, 1, 3)


@dataclass
class Splits:
    """The best split of each slot; ``gain`` is 0 where there is none. Rows of at most ``bin`` go left."""

    gain: np.ndarray
    feature: np.ndarray
    bin: np.ndarray
    n_left: np.ndarray
    weight_left: np.ndarray
    sum_left: np.ndarray

    def row(self, i: int) -> tuple:
        return tuple(a[i].item() for a in (self.gain, self.feature, self.bin, self.n_left, self.weight_left, self.sum_left))


def best_splits(
    n: np.ndarray, weight: np.ndarray, total: np.ndarray, l2: float, least: int, allowed: np.ndarray | None = None
) -> Splits:
    """Largest fall of the penalised squared error over all features and bins; the first of equal ones."""
    slots, features, width = n.shape
    left_n, left_s = n.cumsum(axis=2), total.cumsum(axis=2)
    left_w = left_n if weight is n else weight.cumsum(axis=2)
    all_n, all_w, all_s = (a[:, :, -1:] for a in (left_n, left_w, left_s))
    fits = (left_n >= least) & (all_n - left_n >= least)
    if allowed is not None:
        fits &= allowed[:, :, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left_s**2 / (left_w + l2) + (all_s - left_s) ** 2 / (all_w - left_w + l2) - all_s**2 / (all_w + l2)
    gain = np.where(fits, gain, 0.0).reshape(slots, -1)
    at = gain.argmax(axis=1)
    rows = np.arange(slots)
    take = lambda a: a.reshape(slots, -1)[rows, at]
    return Splits(np.maximum(gain[rows, at], 0.0), at // width, at % width, take(left_n), take(left_w), take(left_s))


def descended(bins: np.ndarray, at: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Rows at the leaves below the nodes ``at`` by their bins; some rows at a time, those on the way kept together."""
    out, flat, width = np.array(at, dtype=np.int64), np.ascontiguousarray(bins).reshape(-1), bins.shape[1]
    inner = feature >= 0
    for first in range(0, len(out), DESCENDED_AT_ONCE):
        ends = out[first:first + DESCENDED_AT_ONCE]
        rows = np.flatnonzero(inner.take(ends))
        node, place = ends.take(rows), (rows + first) * width
        while len(rows):
            node = left.take(node) + (flat.take(place + feature.take(node)) > cut.take(node))
            more = inner.take(node)
            if not more.all():
                ended = np.flatnonzero(~more)
                ends[rows.take(ended)] = node.take(ended)
                kept = np.flatnonzero(more)
                rows, node, place = rows.take(kept), node.take(kept), place.take(kept)
    return out


@dataclass
class BestFirst:
    """One boosted tree under growth: always the leaf with the largest gain is split next, up to a number of leaves.

    A leaf's gain is known only once its bins have been summed. ``wanted``
    names the leaves that have to be summed before the order is certain, a
    whole level at a time; what turns out to come too late is left out in the end.
    """

    n: int
    total: float
    most_leaves: int
    least: int
    split: list = field(default_factory=lambda: [None])  # per node: None unknown, () no split, or (gain, feature, bin)
    size: list = field(default_factory=list)
    sums: list = field(default_factory=list)
    child: list = field(default_factory=lambda: [-1])  # the left one; the right one follows it
    parent: list = field(default_factory=lambda: [-1])
    chosen: set = field(default_factory=set)

    def __post_init__(self) -> None:
        self.size, self.sums = [self.n], [self.total]
        self._too_small(0)

    def _too_small(self, node: int) -> None:
        if self.size[node] < 2 * self.least:
            self.split[node] = ()

    def wanted(self) -> list[int]:
        heap, unknown, leaves = [], [], 1
        self.chosen = set()

        def consider(node: int) -> None:
            if self.split[node] is None:
                unknown.append(node)
            elif self.split[node]:
                heapq.heappush(heap, (-self.split[node][0], node))

        if self.most_leaves > 1:
            consider(0)
        while heap and leaves < self.most_leaves:
            _, node = heapq.heappop(heap)
            self.chosen.add(node)
            leaves += 1
            if leaves < self.most_leaves:
                consider(self.child[node])
                consider(self.child[node] + 1)
        return unknown

    def larger_siblings(self, wanted: list[int], summed: dict) -> dict[int, int]:
        """Wanted nodes whose smaller sibling is wanted too and whose parent has been summed, with that sibling."""
        pairs = {}
        for node in wanted:
            up = self.parent[node]
            if up in summed and node == self.child[up] and node + 1 in wanted:
                small, large = (node, node + 1) if self.size[node] <= self.size[node + 1] else (node + 1, node)
                pairs[large] = small
        return pairs

    def summed(self, wanted: list[int], held: dict) -> list[int]:
        """Of two wanted siblings the smaller one is summed; the other one is what is left of their parent, exactly."""
        rest = self.larger_siblings(wanted, held)
        return [node for node in wanted if node not in rest]

    def learn(self, node: int, found: tuple) -> None:
        gain, feature, cut, n_left, _, sum_left = found
        if gain <= 0:
            self.split[node] = ()
            return
        self.split[node] = (gain, feature, cut)
        self.child[node] = len(self.split)
        for n, s in ((n_left, sum_left), (self.size[node] - n_left, self.sums[node] - sum_left)):
            self.split.append(None)
            self.size.append(n)
            self.sums.append(s)
            self.child.append(-1)
            self.parent.append(node)
            self._too_small(len(self.split) - 1)

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature (-1: not split), bin and left child of every node, also of those that are left out."""
        known = [s or (0, -1, 0) for s in self.split]
        return np.array([s[1] for s in known]), np.array([s[2] for s in known]), np.array(self.child)

    def descend(self, bins: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rows at the deepest nodes that are known for them, from the nodes ``at``."""
        return descended(bins, at, *self.arrays())

    def leaf_values(self, rate: float, l2: float, exponent: int) -> np.ndarray:
        """Of every node: the value of the leaf of the finished tree that it belongs to."""
        values = np.zeros(len(self.split))
        for node in range(len(self.split)):  # parents come first
            up = self.parent[node]
            if up >= 0 and up not in self.chosen:
                values[node] = values[up]
            else:
                values[node] = rate * np.ldexp(self.sums[node] / (self.size[node] + l2), -exponent)
        return values

    def tree(self, edges: list[np.ndarray], values: np.ndarray) -> "Tree":
        """The finished tree alone, nodes renumbered."""
        order, place = [], {}
        waiting = [0]
        while waiting:
            node = waiting.pop()
            place[node] = len(order)
            order.append(node)
            if node in self.chosen:
                waiting += [self.child[node] + 1, self.child[node]]
        feature = np.full(len(order), -1, dtype=np.int16)
        threshold, left, right = np.zeros(len(order)), np.full(len(order), -1, dtype=np.int32), np.full(len(order), -1, dtype=np.int32)
        for i, node in enumerate(order):
            if node in self.chosen:
                _, f, cut = self.split[node]
                feature[i], threshold[i] = f, edges[f][cut]
                left[i], right[i] = place[self.child[node]], place[self.child[node] + 1]
        return Tree(feature, threshold, left, right, values[order])


@dataclass
class Tree:
    """Nodes by number, the root first; ``feature`` is -1 at leaves; values up to the threshold go left."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    KINDS = {"feature": np.int16, "threshold": np.float64, "left": np.int32, "right": np.int32, "value": np.float64}

    def packed(self) -> dict[str, bytes]:
        return {name: getattr(self, name).astype(kind).tobytes() for name, kind in self.KINDS.items()}

    @classmethod
    def unpacked(cls, row: dict) -> "Tree":
        return cls(*[np.frombuffer(row[name], dtype=kind) for name, kind in cls.KINDS.items()])

    def depth(self) -> int:
        deep, level = 0, np.array([0])
        while len(level := level[self.feature[level] >= 0]):
            level, deep = np.concatenate((self.left[level], self.right[level])), deep + 1
        return deep


class Ensemble:
    """Trees whose values are added up, on top of a start value, and divided by ``share``."""

    def __init__(self, trees: list[Tree], start: float = 0.0, share: float = 1.0) -> None:
        sizes = np.array([len(t.feature) for t in trees], dtype=np.int64)
        self.roots = np.cumsum(sizes) - sizes
        shift = np.repeat(self.roots, sizes)
        join = lambda name: np.concatenate([getattr(t, name) for t in trees]) if trees else np.zeros(0)
        self.feature, self.threshold, self.value = join("feature").astype(np.int64), join("threshold"), join("value")
        self.left, self.right = join("left").astype(np.int64) + shift, join("right").astype(np.int64) + shift
        self.start, self.share = start, share

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        step = max(1, PREDICTED_AT_ONCE // max(1, len(self.roots)))
        for first in range(0, len(x) if len(self.roots) else 0, step):
            part = x[first:first + step]
            node = np.repeat(self.roots[None], len(part), axis=0)
            rows, columns = (a.reshape(-1) for a in np.indices(node.shape))
            flat = node.reshape(-1)
            live = np.flatnonzero(self.feature[flat] >= 0)
            while len(live):
                at = flat[live]
                right = part[rows[live], self.feature[at]] > self.threshold[at]
                flat[live] = at = np.where(right, self.right[at], self.left[at])
                live = live[self.feature[at] >= 0]
            out[first:first + step] += self.value[flat].reshape(node.shape).sum(axis=1) / self.share
        return out


def node_sums(bins: np.ndarray, at: np.ndarray, slot: np.ndarray, slots: int, width: int, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts and sums by (slot, feature, bin) of the rows at nodes with a slot, some rows at a time."""
    features = bins.shape[1]
    counts, sums = np.zeros((2, features, slots * width))
    for first in range(0, len(bins), SUMMED_AT_ONCE):
        mine = slot[at[first:first + SUMMED_AT_ONCE]]
        live = np.flatnonzero(mine >= 0)
        columns, own, base = bins[first:first + SUMMED_AT_ONCE][live], g[first:first + SUMMED_AT_ONCE][live], mine[live] * width
        for f in range(features):
            key = base + columns[:, f]
            counts[f] += np.bincount(key, minlength=slots * width)
            sums[f] += np.bincount(key, own, minlength=slots * width)
    shaped = lambda a: np.ascontiguousarray(a.reshape(features, slots, width).transpose(1, 0, 2))
    return shaped(counts), shaped(sums)


def learn_sums(tree: BestFirst, wanted: list[int], held: dict, found: dict, l2: float, least: int) -> None:
    """Best splits of the wanted nodes from the sums ``found`` of some and those ``held`` of their parents, which end here."""
    rest = tree.larger_siblings(wanted, held)
    held.update(found)
    for node, smaller in rest.items():
        held[node] = tuple(a - b for a, b in zip(held.pop(tree.parent[node]), held[smaller]))
    counts, sums = (np.stack([held[node][k] for node in wanted]) for k in (0, 1))
    best = best_splits(counts, counts, sums, l2, least)
    for i, node in enumerate(wanted):
        tree.learn(node, best.row(i))


def boost(bins: np.ndarray, y: np.ndarray, edges: list[np.ndarray], settings: dict) -> tuple[float, list[Tree]]:
    """Start value and trees of one boosted model on the rows of one task."""
    n, width = len(y), max(len(e) for e in edges) + 1
    start = start_value(n, *exact_sum(y))
    predicted, trees = np.full(n, start), []
    rate, l2, least = settings["learning_rate"], settings["l2_regularization"], settings["min_samples_leaf"]
    for _ in range(settings["max_iter"]):
        residual = y - predicted
        exponent = unit(n, np.abs(residual).max(initial=0.0))
        g = in_units(residual, exponent)
        tree, at = BestFirst(n, g.sum(), settings["max_leaf_nodes"], least), np.zeros(n, dtype=np.int64)
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # counts and sums by bin of the nodes that were summed
        while wanted := tree.wanted():
            direct = tree.summed(wanted, held)
            slot = np.full(len(tree.split), -1)
            slot[direct] = np.arange(len(direct))
            learn_sums(tree, wanted, held, dict(zip(direct, zip(*node_sums(bins, at, slot, len(direct), width, g)))), l2, least)
            at = tree.descend(bins, at)
        values = tree.leaf_values(rate, l2, exponent)
        predicted = predicted + values[at]
        trees.append(tree.tree(edges, values))
    return start, trees


def exact_sum(y: np.ndarray) -> tuple[float, int]:
    exponent = unit(len(y), np.abs(y).max(initial=0.0))
    return in_units(y, exponent).sum(), exponent


def start_value(n: int, total: float, exponent: int) -> float:
    return float(np.ldexp(total / n, -exponent))


# Bootstrap and feature draws are hashes of a row's or node's own key, so they do not depend on where it is.
# Chances of 0, 1, 2, ... draws of a row: Poisson with mean 1.
_POISSON = np.cumsum(np.exp(-1.0) / np.concatenate(([1.0], np.cumprod(np.arange(1.0, 20.0)))))


def tree_key(seed: int, number: int) -> np.uint64:
    return mixed(mixed(np.array([seed], dtype=np.int64).view(np.uint64)) + np.uint64(number))[0]


def bootstrap(row_hash: np.ndarray, key: np.uint64) -> np.ndarray:
    """How often each row was drawn."""
    u = (mixed(row_hash.view(np.uint64) ^ key) >> np.uint64(11)).astype(np.float64) / (1 << 53)
    return np.searchsorted(_POISSON, u, side="right").clip(max=(1 << WEIGHT_BITS) - 1)


def child_keys(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return mixed(keys + np.uint64(1)), mixed(keys + np.uint64(2))


def drawn_features(keys: np.ndarray, features: int, chosen: int) -> np.ndarray:
    """``(nodes, features)``: whether a node may split on a feature."""
    draws = mixed(keys[:, None] ^ mixed(np.arange(3, 3 + features, dtype=np.uint64))[None])
    return draws.argsort(axis=1, kind="stable").argsort(axis=1, kind="stable") < chosen


def grow_exact(
    x: np.ndarray, g: np.ndarray, weight: np.ndarray, exponent: int, key: np.uint64, least: int, chosen: int
) -> Tree:
    """A regression tree of any depth on the rows of one task: all midpoints between neighbouring values are tried.

    ``g``: weighted targets in units; rows with weight 0 have been left out. A
    level at a time; a node is split as long as both sides keep ``least`` rows
    and the error falls.
    """
    rows, features = x.shape
    columns = np.asfortranarray(x)
    orders = [np.argsort(columns[:, f], kind="stable").astype(np.int32) for f in range(features)]  # half as much to move
    at = np.zeros(rows, dtype=np.int64)
    feature, threshold, left, right = [-1], [0.0], [-1], [-1]
    totals, weights, open_nodes, keys = [g.sum()], [weight.sum()], np.array([0]), np.array([key], dtype=np.uint64)
    while len(open_nodes):
        slots = np.full(len(feature), -1, dtype=np.int32)
        slots[open_nodes] = np.arange(len(open_nodes))
        slot = slots.take(at)
        allowed = np.asfortranarray(drawn_features(keys, features, chosen))
        best, cut, by = np.zeros(len(open_nodes)), np.zeros(len(open_nodes)), np.full(len(open_nodes), -1)
        sums_left, weights_left = np.zeros(len(open_nodes)), np.zeros(len(open_nodes))
        short = np.uint16 if len(open_nodes) <= 1 << 16 else np.int64  # 16 bits are sorted by their digits
        for f in range(features):
            s = slot.take(orders[f])
            there = np.flatnonzero(s >= 0)
            order, s = orders[f].take(there), s.take(there)
            turn = s.astype(short).argsort(kind="stable")
            orders[f] = order = order.take(turn)
            s = s.take(turn)
            drawn = np.flatnonzero(allowed[:, f].take(s))
            if not len(drawn):
                continue
            order, s = order.take(drawn), s.take(drawn)
            v = columns[:, f].take(order)
            first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
            size = np.diff(np.append(first, len(s)))
            cw, cg = weight.take(order).cumsum(), g.take(order).cumsum()
            before_w, before_g = np.concatenate(([0], cw)).take(first), np.concatenate(([0], cg)).take(first)
            end = first + size - 1
            n_left = np.arange(1, len(s) + 1) - np.repeat(first, size)
            fits = (n_left >= least) & (np.repeat(size, size) - n_left >= least)
            fits[:-1] &= v[1:] > v[:-1]
            i = np.flatnonzero(fits)
            if not len(i):
                continue
            own = np.repeat(np.arange(len(first)), np.add.reduceat(fits, first, dtype=np.int64))
            w_left, g_left = cw.take(i) - before_w.take(own), cg.take(i) - before_g.take(own)
            w_all, g_all = cw.take(end) - before_w, cg.take(end) - before_g
            whole = (g_all**2 / w_all).take(own)
            w_all, g_all = w_all.take(own), g_all.take(own)
            gain = g_left**2 / w_left + (g_all - g_left) ** 2 / (w_all - w_left) - whole
            gain[gain <= ROUNDING * whole] = 0.0  # equal targets
            si = s.take(i)
            heads = np.flatnonzero(np.concatenate(([True], si[1:] != si[:-1])))
            most = np.maximum.reduceat(gain, heads)
            runs = np.diff(np.append(heads, len(si)))
            tops = np.flatnonzero(gain == np.repeat(most, runs))
            tops = tops[np.concatenate(([True], si[tops][1:] != si[tops][:-1]))]
            node, j = si[tops], i[tops]
            better = gain[tops] > best[node]
            node, j, tops = node[better], j[better], tops[better]
            best[node], by[node] = gain[tops], f
            middle = v[j] + (v[j + 1] - v[j]) / 2
            cut[node] = np.where(middle < v[j + 1], middle, v[j])
            sums_left[node], weights_left[node] = g_left[tops], w_left[tops]
        split = np.flatnonzero(by >= 0)
        lefts = len(feature) + 2 * np.arange(len(split))
        for i, child in zip(split.tolist(), lefts.tolist()):
            node = open_nodes[i]
            feature[node], threshold[node], left[node], right[node] = int(by[i]), float(cut[i]), child, child + 1
            totals += [sums_left[i], totals[node] - sums_left[i]]
            weights += [weights_left[i], weights[node] - weights_left[i]]
        feature += [-1] * (2 * len(split))
        threshold += [0.0] * (2 * len(split))
        left += [-1] * (2 * len(split))
        right += [-1] * (2 * len(split))
        child_of = np.full(len(open_nodes), -1)
        child_of[split] = lefts
        moved = np.flatnonzero((slot >= 0) & (child_of[slot] >= 0))
        own = slot[moved]
        at[moved] = child_of[own] + (x[moved, by[own]] > cut[own])
        open_nodes = (lefts[:, None] + np.arange(2)).reshape(-1)
        keys = np.column_stack(child_keys(keys[split])).reshape(-1)
        large = np.bincount(at[moved], minlength=len(feature))[open_nodes] >= 2 * least
        open_nodes, keys = open_nodes[large], keys[large]
    value = np.ldexp(np.array(totals) / np.array(weights), -exponent)
    return Tree(np.array(feature, dtype=np.int16), np.array(threshold), np.array(left, dtype=np.int32), np.array(right, dtype=np.int32), value)
