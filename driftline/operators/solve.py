"""Small dense solves on the sums of products of some devices at once. A device's sizes depend on the number of features only."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from driftline.operators.preprocess import HOURS, WEEKDAYS

# A spread this small against the value itself is rounding, not variation.
FLAT = 1e-12


class DeviceSums:
    """Cell sums of some devices, ready to be added up over any prefix; the first axis of all results is the device.

    Basis: ``1, x_1..x_p, m_1..m_p, y, 24 hours, 7 weekdays``. ``products`` has a row per cell pair, ``levels`` one per
    cell pair, kind and level, both with ``_nth``, the device's number from 0; ``products`` is ordered by it.
    """

    def __init__(self, products: pa.Table, levels: pa.Table, width: int):
        self.width, self.p = width, (width - 2) // 2
        owner = products["_nth"].to_numpy()
        self.starts = np.flatnonzero(np.diff(owner, prepend=-1))
        self.cells = np.stack([products[c].to_numpy() for c in ("cell_train", "cell_final")], axis=1)
        heads = products.take(pa.array(self.starts))
        fills = _numbers(heads["fills"])
        self.fills = fills.reshape(len(self.starts), self.p, fills.size // max(1, len(self.starts) * self.p))
        self.centres, self.centre_y = _numbers(heads["centres"]).reshape(-1, self.p), heads["centre_y"].to_numpy()
        self.heads = heads

        size = width + HOURS + WEEKDAYS
        sums = np.zeros((len(owner), size, size))
        upper = np.triu_indices(width)
        packed = _numbers(products["products"]).reshape(len(owner), len(upper[0]))
        sums[:, upper[0], upper[1]] = packed
        sums[:, upper[1], upper[0]] = packed

        own = [owner, *self.cells.T]
        theirs = [levels[c].to_numpy() for c in ("_nth", "cell_train", "cell_final")]
        most = [1 + max(x.max(initial=0), y.max(initial=0)) for x, y in zip(own, theirs)]
        keys, wanted = (np.ravel_multi_index([x.astype(np.int64) for x in parts], most) for parts in (own, theirs))
        order = np.argsort(keys)
        where = order[np.searchsorted(keys, wanted, sorter=order)]
        is_hour = levels["kind"].to_numpy() == 0
        place = width + levels["level"].to_numpy() + np.where(is_hour, 0, HOURS)
        z = np.stack([levels[f"z{i}"].to_numpy() for i in range(width)], axis=1)
        sums[where, place, place] = z[:, 0]
        sums[where, place, :width] = z
        sums[where, :width, place] = z
        where, place = where[is_hour], place[is_hour]
        for day in range(WEEKDAYS):
            counts = levels[f"c{day}"].to_numpy()[is_hour]
            sums[where, place, width + HOURS + day] = counts
            sums[where, width + HOURS + day, place] = counts
        self.sums = sums

    def prefix(self, scheme: str, f: int) -> np.ndarray:
        return self._added(self._cell(scheme) < f)

    def held_out(self, scheme: str, f: int) -> np.ndarray:
        return self._added(self._cell(scheme) == f)

    def _cell(self, scheme: str) -> np.ndarray:
        return self.cells[:, 0 if scheme == "train" else 1]

    def _added(self, chosen: np.ndarray) -> np.ndarray:
        return np.add.reduceat(np.where(chosen[:, None, None], self.sums, 0.0), self.starts, axis=0)

    def design(self, sums: np.ndarray, prefix: int) -> np.ndarray:
        """Sums for ``1, imputed x_1..x_p, 24 hours, 7 weekdays, y`` with the medians of one prefix."""
        p, width, at = self.p, self.width, np.arange(self.p)
        turn = np.zeros((len(sums), 2 + p + HOURS + WEEKDAYS, sums.shape[-1]))
        turn[:, 0, 0] = 1.0
        turn[:, 1 + at, 1 + at] = 1.0
        turn[:, 1 + at, p + 1 + at] = self.fills[:, :, prefix] - self.centres
        turn[:, p + 1:-1, width:] = np.eye(HOURS + WEEKDAYS)
        turn[:, -1, width - 1] = 1.0
        return turn @ sums @ turn.transpose(0, 2, 1)


def _numbers(lists: pa.ChunkedArray) -> np.ndarray:
    """All numbers of a column of arrays, or of arrays of arrays, one after the other."""
    values = lists.combine_chunks()
    while pa.types.is_list(values.type) or pa.types.is_large_list(values.type):
        values = values.flatten()
    return values.to_numpy(zero_copy_only=False)


class RidgePath:
    """Ridge on scaled features and one-hot levels for many penalties, from one design of each device."""

    def __init__(self, design: np.ndarray, p: int, columns: list[int] | None = None):
        self.n = design[:, 0, 0]
        self.mean = design[:, 0, 1:] / self.n[:, None]
        spread = design[:, 1:, 1:] - self.n[:, None, None] * (self.mean[:, :, None] * self.mean[:, None, :])
        variance = np.diagonal(spread, axis1=1, axis2=2)[:, :p] / self.n[:, None]
        flat = variance <= FLAT * (np.diagonal(design, axis1=1, axis2=2)[:, 1:p + 1] / self.n[:, None])
        self.scale = np.ones((len(spread), spread.shape[-1] - 1))
        self.scale[:, :p] = np.where(flat, 1.0, np.sqrt(np.where(flat, 1.0, variance)))
        self.used = np.arange(self.scale.shape[1]) if columns is None else np.asarray(columns)
        scaled = spread[:, :-1, :-1] / (self.scale[:, :, None] * self.scale[:, None, :])
        self.values, self.vectors = np.linalg.eigh(scaled[:, self.used[:, None], self.used])
        towards = (spread[:, :-1, -1] / self.scale)[:, self.used]
        self.projected = (self.vectors.transpose(0, 2, 1) @ towards[:, :, None])[:, :, 0]

    def weights(self, alpha: float | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(intercepts, weights) against the unscaled, centred designs, with one penalty or one for each device."""
        w = np.zeros(self.scale.shape)
        shrunk = self.projected / (np.maximum(self.values, 0.0) + np.reshape(alpha, (-1, 1)))
        w[:, self.used] = (self.vectors @ shrunk[:, :, None])[:, :, 0]
        w /= self.scale
        return self.mean[:, -1] - (w * self.mean[:, :-1]).sum(axis=1), w


def squared_errors(design: np.ndarray, intercept: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sums of squared errors of a linear model of each device on the rows behind ``design``."""
    a = np.concatenate([-intercept[:, None], -weights, np.ones((len(weights), 1))], axis=1)
    return np.maximum(0.0, (a[:, None, :] @ design @ a[:, :, None])[:, 0, 0])


def single_lines(design: np.ndarray, feature: int) -> tuple[np.ndarray, np.ndarray]:
    """(intercepts, slopes) of y on one imputed feature; slope 0 when it does not vary."""
    n, x, y = design[:, 0, 0], design[:, 0, 1 + feature], design[:, 0, -1]
    own = design[:, 1 + feature, 1 + feature]
    spread = own - x * x / n
    flat = spread <= FLAT * own
    slope = np.where(flat, 0.0, (design[:, 1 + feature, -1] - x * y / n) / np.where(flat, 1.0, spread))
    return y / n - slope * x / n, slope


def least_squares_lines(means: np.ndarray, spreads: np.ndarray, used: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Intercepts and weights of least squares for many devices at once, on the ``used`` inputs of each.

    ``means`` (devices, b + 1) and ``spreads`` (co-variances) are those of the
    inputs and, last, the target. Of equally good weights the smallest are taken.
    """
    inner, outer = spreads[:, :-1, :-1], spreads[:, :-1, -1]
    mask = np.ones(outer.shape, dtype=bool) if used is None else used
    scale = np.sqrt(np.maximum(np.diagonal(inner, axis1=1, axis2=2), np.finfo(float).tiny))
    both = mask[:, :, None] & mask[:, None, :]
    correlations = np.where(both, inner / (scale[:, :, None] * scale[:, None, :]), 0.0)
    solved = np.linalg.pinv(correlations, rcond=1e-12, hermitian=True) @ np.where(mask, outer / scale, 0.0)[:, :, None]
    weights = np.where(mask, solved[:, :, 0] / scale, 0.0)
    return means[:, -1] - (weights * means[:, :-1]).sum(axis=1), weights


def nonnegative_lines(means: np.ndarray, spreads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least squares with an intercept and weights >= 0, exactly, for many devices at once and any number of inputs.

    Active sets: of the inputs left out, the one along which the error falls
    steepest joins; if that turns weights negative, the step ends where the
    first of them is 0 and it leaves. Every step lowers a device's error, so no
    set of inputs comes back; devices that are done wait for the others.
    """
    inner, outer = spreads[:, :-1, :-1], spreads[:, :-1, -1]
    devices, b = outer.shape
    own = np.diagonal(inner, axis1=1, axis2=2)
    varying = own > FLAT * (own + means[:, :-1] ** 2)
    scale = np.sqrt(np.where(varying, own, 1.0))
    target = np.sqrt(np.maximum(spreads[:, -1, -1], 0.0))
    weights, used = np.zeros((devices, b)), np.zeros((devices, b), dtype=bool)
    error = np.full(devices, np.inf)
    open_ = np.ones(devices, dtype=bool)
    while open_.any():
        # Correlation of each input left out with what is not explained yet.
        slope = (outer - (inner @ weights[:, :, None])[:, :, 0]) / (scale * np.where(target > 0, target, 1.0)[:, None])
        slope = np.where(varying & ~used, slope, -np.inf)
        best = slope.argmax(axis=1)
        left = spreads[:, -1, -1] - 2 * (weights * outer).sum(axis=1) + (weights * (inner @ weights[:, :, None])[:, :, 0]).sum(axis=1)
        open_ &= (slope[np.arange(devices), best] > 1e-10) & (left < error)
        error = np.where(open_, left, error)
        used[open_, best[open_]] = True
        moving = open_.copy()
        while moving.any():
            at = np.flatnonzero(moving)
            _, wanted = least_squares_lines(means[at], spreads[at], used[at])
            bad = used[at] & (wanted <= 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                reach = np.where(bad, weights[at] / (weights[at] - wanted), np.inf)
            reach = np.where(np.isnan(reach), 0.0, reach)
            step = np.minimum(reach.min(axis=1), 1.0)
            weights[at] += step[:, None] * (wanted - weights[at])
            first = bad & (reach <= step[:, None])
            used[at] &= ~first
            weights[at] = np.where(used[at], np.maximum(weights[at], 0.0), 0.0)
            moving[at] = bad.any(axis=1)
    return means[:, -1] - (weights * means[:, :-1]).sum(axis=1), weights


def nonnegative_line(mean: np.ndarray, spread: np.ndarray) -> tuple[float, np.ndarray]:
    """The same for one device."""
    intercepts, weights = nonnegative_lines(np.asarray(mean)[None], np.asarray(spread)[None])
    return float(intercepts[0]), weights[0]
