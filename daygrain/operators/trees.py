"""Growing trees from histograms: regularised boosting (G2a-c) and extremely randomised trees (G2d).

A grower asks for the histograms of some nodes and is told their sums; who adds them up, one task over its own rows or a Spark
job over all of them, makes no difference. Gradients are whole numbers (fixed point), so sums do not depend on
the order or the parting of the rows. A node is named by its path: 1 is the root, 2p and 2p + 1 are the children of p.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

from daygrain.operators.coding import Layout

ROOT = 1


def mix(*parts, start=np.uint64(0x9E3779B97F4A7C15)) -> np.ndarray:
    """A 64-bit hash of whole numbers or arrays of them; ``mix(a, b)`` is ``mix(b, start=mix(a))``."""
    h = start
    with np.errstate(over="ignore"):
        for p in parts:
            p = p.astype(np.uint64) if isinstance(p, np.ndarray) else np.uint64(int(p) & (2**64 - 1))
            h = (h ^ p) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            h = h ^ (h >> np.uint64(29))
    return h


def uniform(*parts, **start) -> np.ndarray:
    return (mix(*parts, **start) >> np.uint64(11)).astype(np.float64) * 2.0**-53


@dataclass
class Tree:
    """Nodes in preorder; a leaf has feature -1. A value at or below ``threshold`` goes left, a missing one where ``missing_left`` says."""

    feature: np.ndarray
    cut: np.ndarray
    threshold: np.ndarray
    missing_left: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def leaf_values(self, x: np.ndarray) -> np.ndarray:
        """Of raw rows x features, missing as NaN."""
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x)) if self.feature[0] >= 0 else np.zeros(0, np.int64)
        while len(rows):
            node = at[rows]
            v = x[rows, self.feature[node]]
            left = np.where(np.isnan(v), self.missing_left[node], v <= self.threshold[node])
            at[rows] = np.where(left, self.left[node], self.right[node])
            rows = rows[self.feature[at[rows]] >= 0]
        return self.value[at]


def build_tree(splits: dict[int, tuple[int, int, bool]], value: dict[int, float], layout: Layout) -> Tree:
    """The nodes reached from the root; a path without a split is a leaf of ``value``."""
    rows, todo = [], [(ROOT, None, None)]
    while todo:
        path, parent, side = todo.pop()
        if parent is not None:
            rows[parent][side] = len(rows)
        if path in splits:
            f, cut, missing_left = splits[path]
            threshold = layout.cuts[f][cut] if cut < len(layout.cuts[f]) else np.inf
            todo += [(2 * path + 1, len(rows), 5), (2 * path, len(rows), 4)]
            rows.append([f, cut, threshold, missing_left, 0, 0, 0.0])
        else:
            rows.append([-1, 0, 0.0, False, 0, 0, value[path]])
    columns = list(zip(*rows))
    kinds = (np.int32, np.int32, np.float64, bool, np.int32, np.int32, np.float64)
    return Tree(*[np.array(c, k) for c, k in zip(columns, kinds)])


class Cells:
    """A block's rows by node: a node's rows are those of its parent on its side of the split."""

    def __init__(self, codes: np.ndarray, bins: np.ndarray, rows: np.ndarray):
        self.codes, self.bins, self.rows = codes, bins, {ROOT: rows}

    def of(self, path: int, splits: dict) -> np.ndarray:
        if path not in self.rows:
            parent = path >> 1
            rows = self.of(parent, splits)
            f, cut, missing_left = splits[parent]
            code = self.codes[:, f].take(rows)
            right = code > cut
            if missing_left:
                right &= code != self.bins[f]
            self.rows[2 * parent], self.rows[2 * parent + 1] = rows[~right], rows[right]
        return self.rows[path]


def histogram(flat_codes: np.ndarray, rows: np.ndarray, channels: list[np.ndarray], size: int) -> np.ndarray:
    """(size, channels + 1) sums of whole numbers by bin; the last channel counts the rows."""
    at, width = flat_codes[rows].ravel(), flat_codes.shape[1]
    out = np.empty((size, len(channels) + 1), np.int64)
    for i, c in enumerate(channels):
        out[:, i] = np.bincount(at, weights=np.repeat(c[rows], width), minlength=size)
    out[:, -1] = np.bincount(at, minlength=size)
    return out


class Bundles:
    """Histograms of a block's rows, features taken together: features whose codes make at most ``limit`` combinations in all rows (one-hot
    columns of one value, transforms of one reading) are counted once by combination, and their own bins are sums over the combinations."""

    def __init__(self, codes: np.ndarray, layout: Layout, limit: int = 1024, sample: int = 4096):
        self.size, found = layout.size, []
        for f in np.argsort(layout.bins, kind="stable"):
            own, places = codes[:, f].astype(np.int64), int(layout.bins[f]) + 1
            for bundle in found:
                ids, of = bundle
                n = len(of[0])
                pair = ids[:sample] * places + own[:sample]
                if len(np.unique(pair)) > limit:
                    continue
                there = np.bincount(ids * places + own, minlength=n * places) > 0
                if there.sum() <= limit:
                    number, at = np.cumsum(there) - 1, np.flatnonzero(there)
                    bundle[0] = number[ids * places + own]
                    bundle[1] = [o[at // places] for o in of] + [layout.offset[f] + at % places]
                    break
            else:
                found.append([own, [layout.offset[f] + np.arange(places)]])
        # few bytes a row: the numbers of all parts are read for every node
        self.parts = [(ids.astype(np.min_scalar_type(len(of[0]))), np.concatenate(of), len(of), len(of[0])) for ids, of in found]

    def histogram(self, rows: np.ndarray, channels: list[np.ndarray]) -> np.ndarray:
        """As ``histogram``: whole numbers whose sums are exact in any order."""
        out, own = np.zeros((self.size, len(channels) + 1), np.int64), [c.take(rows) for c in channels]
        for ids, at, copies, n in self.parts:
            ids = ids.take(rows).astype(np.intp)
            for i, c in enumerate([*own, None]):
                sums = np.bincount(ids, c, minlength=n)
                if copies == 1:
                    out[at, i] = sums
                else:
                    out[:, i] += np.bincount(at, np.tile(sums, copies), minlength=self.size).astype(np.int64)
        return out


def left_sums(hists: np.ndarray, layout: Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, missing, total) of (nodes, size, channels): sums up to each bin of its feature, of its missing values, of the node."""
    running = np.cumsum(hists, axis=1)
    before = np.concatenate([np.zeros_like(running[:, :1]), running], axis=1)[:, layout.first]
    left = running - before
    return left, hists[:, layout.last], left[:, layout.last[0]]


# --- boosting -----------------------------------------------------------------------------------------------------------
class Boosted:
    """One boosted model: log-loss, second order, L1 and L2 in leaf values and gains.

    ``growth``: "leaf" splits the leaf of the largest gain until ``leaves`` are reached, "level" every node with a gain down to
    ``depth``, "symmetric" all nodes of a level by one split. Each tree sees ``column_share`` of the features and
    ``row_share`` of the rows, drawn by hash. ``wanted`` are the paths whose histograms (gradient, hessian, rows) come next;
    a sibling's are its parent's less these. ``trees`` begin with the constant of the log-odds.
    """

    def __init__(self, profile: dict, layout: Layout, seed: int, scale: float, base: float, ahead: bool = False):
        self.profile, self.layout, self.seed, self.scale, self.ahead = profile, layout, seed, scale, ahead
        self.l1, self.l2 = profile.get("l1", 0.0), profile.get("l2", 0.0)
        self.min_rows, self.min_hessian = max(1, profile.get("min_rows", 1)), profile.get("min_hessian", 0.0)
        self.symmetric = profile["growth"] == "symmetric"
        self.trees = [build_tree({}, {ROOT: base}, layout)]
        self._start()

    # rows and columns of a tree
    def _start(self) -> None:
        self.number, self.splits, self.sums, self.hists, self.best, self.level = len(self.trees), {}, {}, {}, {}, [ROOT]
        self.wanted = [] if self.number > self.profile["trees"] else [ROOT]
        n = len(self.layout.bins)
        share = self.profile.get("column_share", 1.0)
        drawn = np.argsort(mix(self.seed, self.number, 1, np.arange(n)), kind="stable")[:max(1, round(share * n))]
        self.columns = np.zeros(n, bool)
        self.columns[drawn] = True

    def sampled(self, h: np.ndarray) -> np.ndarray:
        return self.sample(h, self.profile, self.seed, self.number)

    @staticmethod
    def sample(h: np.ndarray, profile: dict, seed: int, number: int) -> np.ndarray:
        """The rows of a tree, by their keys' hashes."""
        return Boosted.sample_of(mix(h, seed), profile, number)

    @staticmethod
    def sample_of(seeded: np.ndarray, profile: dict, number: int) -> np.ndarray:
        """The same from ``mix(h, seed)``, which all trees share."""
        share = profile.get("row_share", 1.0)
        return uniform(number, 2, start=seeded) < share if share < 1 else np.ones(len(seeded), bool)

    # gains
    def _soft(self, g: np.ndarray) -> np.ndarray:
        return np.sign(g) * np.maximum(np.abs(g) - self.l1, 0.0) if self.l1 else g

    def _score(self, s: np.ndarray) -> np.ndarray:
        return self._soft(s[..., 0]) ** 2 / np.maximum(s[..., 1] + self.l2, 1e-300)

    def _real(self, hists: np.ndarray) -> np.ndarray:
        return hists * np.array([1 / self.scale, 1 / self.scale, 1.0])

    def gains(self, hists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(gains, left): nodes x (missing right, missing left) x places; -inf where a side breaks a bound."""
        left, missing, total = left_sums(self._real(hists), self.layout)
        sides = np.stack([left, left + missing], axis=1)
        rest = total[:, None, None] - sides
        allowed = self.layout.is_value & self.columns[self.layout.feature]
        gain = self._score(sides) + self._score(rest) - self._score(total)[:, None, None]
        if self.symmetric:
            return np.where(allowed, gain, -np.inf), sides
        good = allowed & (np.minimum(sides[..., 2], rest[..., 2]) >= self.min_rows) \
            & (np.minimum(sides[..., 1], rest[..., 1]) >= self.min_hessian)
        return np.where(good, gain, -np.inf), sides

    def _split_at(self, flat: int) -> tuple[int, int, bool]:
        variant, place = divmod(flat, self.layout.size)
        return int(self.layout.feature[place]), int(self.layout.place[place]), bool(variant)

    # histograms
    def receive(self, got: dict[int, np.ndarray]) -> None:
        for path in sorted(got):
            self.hists[path] = got[path]
            if path > ROOT:
                self.hists[path ^ 1] = self.hists[path >> 1] - got[path]
        if ROOT in got:
            self.sums[ROOT] = self._real(got[ROOT][:self.layout.bins[0] + 1].sum(axis=0))
        {"leaf": self._grow_leaves, "level": self._grow_level, "symmetric": self._grow_symmetric}[self.profile["growth"]]()

    def _find(self, paths: list[int]) -> None:
        """The best split (gain, flat place) of each path, and its children's sums."""
        new = [p for p in paths if p in self.hists and p not in self.best]
        if not new:
            return
        gain, sides = self.gains(np.stack([self.hists[p] for p in new]))
        for i, p in enumerate(new):
            at = int(np.argmax(gain[i]))
            self.best[p] = (float(gain[i].flat[at]), at)
            left = sides[i].reshape(-1, 3)[at]
            self.sums[2 * p], self.sums[2 * p + 1] = left, self.sums[p] - left

    def _open(self, path: int) -> bool:
        """Whether a split of the node can leave enough rows on both sides."""
        return path in self.hists or self.sums[path][2] >= 2 * self.min_rows

    def _ask(self, parents: list[int]) -> None:
        self.wanted = [min((2 * p, 2 * p + 1), key=lambda c: (self.sums[c][2], c)) for p in parents]

    def _grow_leaves(self) -> None:
        """Best first; where a chosen node's children are not known yet, they are asked for (``ahead``: all such nodes at once)."""
        self._find(sorted(self.hists))
        heap, chosen, unknown = [], [], []

        def offer(path: int) -> None:
            if path in self.best and self.best[path][0] > 0:
                heapq.heappush(heap, (-self.best[path][0], path))
        offer(ROOT)
        while heap and len(chosen) < self.profile["leaves"] - 1:
            path = heapq.heappop(heap)[1]
            chosen.append(path)
            self.splits[path] = self._split_at(self.best[path][1])
            if 2 * path in self.hists:
                offer(2 * path)
                offer(2 * path + 1)
            elif self._open(2 * path) or self._open(2 * path + 1):
                unknown.append(path)
                if not self.ahead:
                    break
        if unknown and not (len(chosen) == self.profile["leaves"] - 1 and unknown == chosen[-1:]):
            self._ask(unknown)
            return
        self._finish(set(chosen))

    def _grow_level(self) -> None:
        self._find(self.level)
        split = [p for p in self.level if self.best.get(p, (0,))[0] > 0]
        self.splits |= {p: self._split_at(self.best[p][1]) for p in split}
        self.level = [c for p in split for c in (2 * p, 2 * p + 1)]
        ask = [p for p in split if self._open(2 * p) or self._open(2 * p + 1)]
        if not ask or self.level[0].bit_length() > self.profile["depth"]:
            self._finish(set(self.splits))
            return
        self._ask(ask)

    def _grow_symmetric(self) -> None:
        """One split for the whole level: the largest sum of gains."""
        gain, sides = self.gains(np.stack([self.hists[p] for p in self.level]))
        whole = gain.sum(axis=0)
        at = int(np.argmax(whole))
        if whole.flat[at] > 1e-12:
            for i, p in enumerate(self.level):
                left = sides[i].reshape(-1, 3)[at]
                self.splits[p] = self._split_at(at)
                self.sums[2 * p], self.sums[2 * p + 1] = left, self.sums[p] - left
            self.level = [c for p in self.level for c in (2 * p, 2 * p + 1)]
            if self.level[0].bit_length() <= self.profile["depth"]:
                self._ask([p >> 1 for p in self.level[::2]])
                return
        self._finish(set(self.splits))

    def _finish(self, chosen: set[int]) -> None:
        self.splits = {p: s for p, s in self.splits.items() if p in chosen}
        leaves = {c for p in chosen for c in (2 * p, 2 * p + 1)} - chosen or {ROOT}
        value = {p: float(-self.profile["step"] * self._soft(self.sums[p][0]) / max(self.sums[p][1] + self.l2, 1e-300)) for p in leaves}
        self.done = (self.splits, value)
        self.trees.append(build_tree(self.splits, value, self.layout))
        self._start()


def add_tree(margin: np.ndarray, codes: np.ndarray, layout: Layout, splits: dict, value: dict, symmetric: bool) -> None:
    """Adds a tree's leaf values to its rows' margins; in a symmetric tree a row's leaf is found by one bit a level."""
    if symmetric and splits:
        path, p = np.ones(len(margin), np.int64), ROOT
        while p in splits:
            f, cut, missing_left = splits[p]
            right = codes[:, f] > cut
            if missing_left:
                right &= codes[:, f] != layout.bins[f]
            path, p = 2 * path + right, 2 * p
        table = np.zeros(2 * p)
        for leaf, v in value.items():
            table[leaf] = v
        margin += table[path]
        return
    cells = Cells(codes, layout.bins, np.arange(len(margin)))
    for leaf, v in value.items():
        margin[cells.of(leaf, splits)] += v


def gradients(margin: np.ndarray, y: np.ndarray, scale: float) -> list[np.ndarray]:
    p = 1.0 / (1.0 + np.exp(-margin))
    return [np.rint((p - y) * scale), np.rint(p * (1.0 - p) * scale)]


def fixed_scale(rows: int) -> float:
    """A power of two with which the sum of so many gradients stays a whole number below 2^52."""
    return 2.0 ** min(40, 52 - max(1, int(rows)).bit_length())


# --- extremely randomised trees -------------------------------------------------------------------------------------------
#: P(X <= k) of a Poisson variable of mean 1.
POISSON = np.cumsum(np.cumprod(np.r_[np.exp(-1.0), 1.0 / np.arange(1, 20)]))


def bootstrap(h: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often each row is drawn into a tree's sample."""
    return np.searchsorted(POISSON, uniform(h, seed, tree, 3), side="right").astype(np.int64)


def root_name(seed: int, tree: int) -> np.ndarray:
    return mix(seed, tree, np.array([4]))


def child_names(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return mix(names, 5), mix(names, 6)


def random_cuts(names: np.ndarray, low: np.ndarray, high: np.ndarray, layout: Layout, share: float) -> tuple[np.ndarray, np.ndarray]:
    """(candidates, cuts) of nodes x features: so many features that vary in the node, and one cut each between its least and greatest
    values, all by the node's name alone. Only candidates have a drawn cut."""
    n = low.shape[1]
    varies = low < high
    order = np.where(varies, mix(names[:, None], 7, np.arange(n)), np.uint64(2**64 - 1))
    last = max(1, int(share * n)) - 1
    chosen = varies & (order <= np.partition(order, last, axis=1)[:, last:last + 1])
    named = mix(names, 8)
    cuts = low.copy()
    wide = np.flatnonzero(layout.bins > 2)  # two values have one cut
    which, at = np.nonzero(chosen[:, wide].T)
    f = wide[which]
    a, b = layout.table[f, low[at, f]], layout.table[f, high[at, f]]
    drawn, ends = a + uniform(f, start=named[at]) * (b - a), np.r_[0, np.cumsum(np.bincount(which, minlength=len(wide)))]
    for i, first, end in zip(wide, ends, ends[1:]):
        cuts[at[first:end], i] = np.searchsorted(layout.values[i], drawn[first:end], side="right") - 1
    return chosen, np.clip(cuts, low, np.maximum(high - 1, low))


def choose(left: np.ndarray, total: np.ndarray, candidates: np.ndarray, weight: np.ndarray, min_rows: int) -> np.ndarray:
    """Each node's feature of the purest split by Gini, or -1; sums are (rows, drawn 0s, drawn 1s), ``weight`` is by class."""
    def purity(s):
        a, b = s[..., 1] * weight[0], s[..., 2] * weight[1]
        return (a * a + b * b) / np.maximum(a + b, 1e-300)
    right = total[:, None] - left
    good = candidates & (left[..., 0] >= min_rows) & (right[..., 0] >= min_rows) & ((total[:, 1] > 0) & (total[:, 2] > 0))[:, None]
    score = np.where(good, purity(left) + purity(right), -np.inf)
    best = np.argmax(score, axis=1)
    return np.where(good[np.arange(len(best)), best], best, -1)


def class_weights(ones: float, zeros: float) -> np.ndarray:
    """Balanced over a sample: its size over twice a class's."""
    n = ones + zeros
    return np.array([n / (2 * zeros) if zeros else 0.0, n / (2 * ones) if ones else 0.0])


def share_of_ones(total: np.ndarray, weight: np.ndarray) -> np.ndarray:
    a, b = total[..., 1] * weight[0], total[..., 2] * weight[1]
    return np.where(a + b > 0, b / np.maximum(a + b, 1e-300), 0.5)


class Counts:
    """Rows' counts (1, drawn 0s, drawn 1s): in one double a row where the sums over all rows fit into its 53 bits, else in three."""

    def __init__(self, zeros: np.ndarray, ones: np.ndarray):
        self.total = np.array([[len(zeros), zeros.sum(), ones.sum()]], np.int64)
        self.bits = [int(t).bit_length() for t in self.total[0]]
        self.packed = sum(self.bits) <= 53
        channels = [np.ones(len(zeros), np.int64), zeros.astype(np.int64), ones.astype(np.int64)]
        if self.packed:
            channels = [channels[0] | channels[1] << self.bits[0] | channels[2] << self.bits[0] + self.bits[1]]
        self.channels = [c.astype(np.float64) for c in channels]

    def take(self, order: np.ndarray) -> None:
        self.channels = [c.take(order) for c in self.channels]

    def unpacked(self, sums: list[np.ndarray]) -> np.ndarray:
        """The three counts, in a last axis, of sums of the channels."""
        sums = [c.astype(np.int64) for c in sums]
        if self.packed:
            parts, sums = sums[0], []
            for b in self.bits:
                sums.append(parts & (1 << b) - 1)
                parts = parts >> b
        return np.stack(sums, axis=-1)


#: Nodes of so many rows are summed each by matrix products over so many rows at a time; smaller ones all together.
BIG_NODE, PRODUCT_ROWS = 512, 4096


class Columns:
    """A block's codes (without missing ones) by column. Features of more than two values have a column each. Of those of two values, any of which
    a row has at most one (the columns of a one-hot) share a column, which holds the number of the one, or 0."""

    def __init__(self, codes: np.ndarray, layout: Layout):
        codes = np.ascontiguousarray(codes)
        self.codes, self.flat, self.layout = codes, codes.reshape(-1), layout
        self.wide, self.groups = np.flatnonzero(layout.bins > 2), []
        shared = []
        for f in np.flatnonzero(layout.bins == 2):
            own = codes[:, f] > 0
            for group, column in zip(self.groups, shared):
                if len(group) < 255 and not (column[own] > 0).any():
                    break
            else:
                group, column = [], np.zeros(len(codes), np.uint8)
                self.groups.append(group)
                shared.append(column)
            group.append(f)
            column[own] = len(group)
        self.by_column = np.concatenate([np.ascontiguousarray(codes[:, self.wide].T), *[c[None] for c in shared]])
        width = len(layout.bins)
        self.column, self.flag = np.zeros(width, np.int64), np.zeros(width, np.uint8)
        self.column[self.wide] = np.arange(len(self.wide))
        for i, group in enumerate(self.groups):
            self.column[group], self.flag[group] = len(self.wide) + i, np.arange(1, len(group) + 1)

    def best_splits(self, rows: np.ndarray, sizes: np.ndarray, counts: Counts, total: np.ndarray, names: np.ndarray,
                    profile: dict, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(feature or -1, cut, counts of the left side) of nodes, big ones first, whose ``rows`` stand one node after the other.

        ``rows`` have the codes of ``by_column``, in memory by column.
        """
        x, n, width, n_wide = rows.T, len(sizes), len(self.layout.bins), len(self.wide)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        low, high = np.zeros((n, width), np.int64), np.zeros((n, width), np.int64)
        left = np.zeros((n, width, 3), np.int64)
        for f, c in zip(self.wide, x):
            low[:, f], high[:, f] = np.minimum.reduceat(c, starts), np.maximum.reduceat(c, starts)
        node = np.repeat(np.arange(n), sizes)
        for group, c in zip(self.groups, x[n_wide:]):
            places = len(group) + 1
            at = node * places + c
            ones = counts.unpacked([np.bincount(at, w, minlength=n * places).reshape(n, places)[:, 1:] for w in counts.channels])
            left[:, group] = total[:, None] - ones
            high[:, group] = ones[..., 0] > 0
            low[:, group] = ones[..., 0] == sizes[:, None]
        chosen, cuts = random_cuts(names, low, high, self.layout, profile["column_share"])
        bound, big = cuts[:, self.wide].astype(np.uint8), int((sizes >= BIG_NODE).sum())
        sums = [np.zeros((n, n_wide)) for _ in counts.channels]
        for i in range(big):
            for a in range(starts[i], ends[i], PRODUCT_ROWS):
                b = min(a + PRODUCT_ROWS, ends[i])
                side = (x[:n_wide, a:b] <= bound[i][:, None]).astype(np.float64)
                for s, w in zip(sums, counts.channels):
                    s[i] += side @ w[a:b]  # whole numbers below 2^53: exact in any order
        if big < n:
            first, node = starts[big], node[starts[big]:]
            weights = [w[first:].astype(np.int64) for w in counts.channels]
            for j in range(n_wide):
                side = x[j, first:] <= bound[:, j].take(node)
                for s, w in zip(sums, weights):
                    s[big:, j] = np.add.reduceat(side * w, starts[big:] - first)
        left[:, self.wide] = counts.unpacked(sums)
        best = choose(left, total, chosen, weight, profile["min_rows"])
        at = np.maximum(best, 0)
        return best, cuts[np.arange(n), at], left[np.arange(n), at]

    def goes_right(self, x: np.ndarray, sizes: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """Whether each row of the nodes goes right at its node's split."""
        ends = np.cumsum(sizes)
        starts, column, flag = ends - sizes, self.column[feature], self.flag[feature]
        # right is where the code less ``base`` is at most ``span``: in bytes smaller codes wrap around
        base = np.where(flag > 0, flag, cut + 1).astype(np.uint8)
        span = np.where(flag > 0, 0, 255 - base).astype(np.uint8)
        right, big = np.empty(x.shape[1], bool), int((sizes >= BIG_NODE).sum())
        for i in range(big):
            right[starts[i]:ends[i]] = x[column[i], starts[i]:ends[i]] - base[i] <= span[i]
        if big < len(sizes):
            node = np.repeat(np.arange(big, len(sizes)), sizes[big:])
            code = x.reshape(-1).take((column * x.shape[1]).take(node) + np.arange(starts[big], x.shape[1]))
            right[starts[big]:] = code - base.take(node) <= span.take(node)
        return right


def random_tree(codes: np.ndarray | Columns, y: np.ndarray, drawn: np.ndarray, scored: np.ndarray, name: np.ndarray, layout: Layout,
                profile: dict, weight: np.ndarray, keep: bool = True) -> tuple[Tree | None, np.ndarray]:
    """A tree below the node ``name``, grown on the rows that are drawn, level by level without a bound of depth; (tree, values of ``scored``).

    ``codes`` have no missing values (medians stand for them). The drawn rows of the nodes that may still split are kept one node after the
    other, so that a level reads them in order.
    """
    columns = codes if isinstance(codes, Columns) else Columns(codes, layout)
    min_rows = profile["min_rows"]
    rows = np.flatnonzero(drawn > 0)
    if not len(rows):
        return (build_tree({}, {ROOT: 0.5}, layout) if keep else None), np.full(len(scored), 0.5)
    one = y[rows] > 0
    counts = Counts(drawn[rows] * ~one, drawn[rows] * one)
    x, names, ids, total = columns.by_column.take(rows, axis=1), name, np.zeros(1, np.int64), counts.total

    def may_split(total: np.ndarray) -> np.ndarray:
        """Enough rows for two sides, of both classes; others are leaves, whatever the features."""
        return (total[:, 0] >= 2 * min_rows) & (total[:, 1] > 0) & (total[:, 2] > 0)
    live = int(may_split(total).sum())  # these nodes come first
    parts, count = [], 1
    while True:
        best, cut, child = np.full(len(ids), -1), np.zeros(len(ids), np.int64), np.full(len(ids), -1)
        if live:
            sizes = total[:live, 0]
            best[:live], cut[:live], side = columns.best_splits(x.T, sizes, counts, total[:live], names[:live], profile, weight)
        split = np.flatnonzero(best >= 0)
        child[split[np.argsort(ids[split])]] = count + 2 * np.arange(len(split))
        count += 2 * len(split)
        parts.append((ids, best, cut, child, share_of_ones(total, weight)))
        if not len(split):
            break
        right = columns.goes_right(x, sizes, best[:live], cut[:live])
        total = np.stack([side[split], total[split] - side[split]], axis=1).reshape(-1, 3)
        ids = np.stack([child[split], child[split] + 1], axis=1).ravel()
        names = np.stack(child_names(names[split]), axis=1).ravel()
        # the children that may split, big ones first, then the others, whose rows go
        on = may_split(total)
        order = np.argsort(np.where(on, total[:, 0] < BIG_NODE, 2), kind="stable")
        own = np.where(on, total[:, 0], 0)
        start = np.empty(len(own), np.int64)
        start[order] = np.cumsum(own[order]) - own[order]
        moved = np.empty(own.sum(), np.int64)
        for s, goes in ((0, ~right), (1, right)):
            stays = np.zeros(live, bool)
            stays[split] = on[s::2]
            found, n, at = np.flatnonzero(goes & np.repeat(stays, sizes)), own[s::2], start[s::2]
            moved[np.arange(len(found)) + np.repeat(at - np.cumsum(n) + n, n)] = found
        x = x.take(moved, axis=1)
        counts.take(moved)
        ids, names, total, live = ids[order], names[order], total[order], int(on.sum())
    nodes = [np.concatenate(c)[np.argsort(np.concatenate([p[0] for p in parts]))] for c in list(zip(*parts))[1:]]
    return (_assemble(*nodes, layout) if keep else None), _leaf_values(columns.flat, columns.codes.shape[1], scored, *nodes, len(parts))


SCORED_ROWS = 1 << 14


def _leaf_values(flat: np.ndarray, width: int, rows: np.ndarray, best: np.ndarray, cut: np.ndarray, child: np.ndarray, value: np.ndarray, levels: int) -> np.ndarray:
    """The leaves' values of rows, so many at a time that their codes stay in the cache. A leaf leads to itself."""
    leaf = best < 0
    feature, bound = np.where(leaf, 0, best), np.where(leaf, 255, cut).astype(np.uint8)
    low = np.where(leaf, np.arange(len(best)), child)
    out = np.empty(len(rows))
    for first in range(0, len(rows), SCORED_ROWS):
        cells = rows[first:first + SCORED_ROWS] * width
        back, at = np.arange(first, first + len(cells)), np.zeros(len(cells), np.int64)
        for level in range(levels):
            at = low.take(at) + (flat.take(cells + feature.take(at)) > bound.take(at))
            if level % 4 == 3:
                done = leaf.take(at)
                out[back[done]] = value[at[done]]
                back, cells, at = back[~done], cells[~done], at[~done]
        out[back] = value[at]
    return out


def _assemble(best: np.ndarray, cut: np.ndarray, child: np.ndarray, value: np.ndarray, layout: Layout) -> Tree:
    threshold = np.array([layout.cuts[f][c] if f >= 0 else 0.0 for f, c in zip(best.tolist(), cut.tolist())])
    inner = best >= 0
    return Tree(best.astype(np.int32), cut.astype(np.int32), threshold, np.zeros(len(best), bool), np.where(inner, child, 0).astype(np.int32),
                np.where(inner, child + 1, 0).astype(np.int32), np.where(inner, 0.0, value))
