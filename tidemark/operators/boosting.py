"""Newton boosting on histograms: one aggregate over all rows for each level of a tree.

Features become numbers of bins once, and rows with equal bins, arm and outcome are counted
together where they lie; what is left is a written table of blocks, each a few packed arrays.  A
level asks for sums of gradients, Hessians and rows by (node, feature, bin): tasks add them up
for their blocks, Spark adds the tasks' sums, and the driver gets a bounded table, LEAVES x features x
bins at most, from which it chooses splits.  Leaves are split best first, up to LEAVES; the
children of every leaf's best split are measured in the same pass, so a tree takes as many passes as it has levels.

Sums are of whole numbers (2^-36 as unit), so they don't depend on the order of addition: a task that
runs again after a lost executor changes no tree.  Margins of earlier trees are written into the
blocks every REBASE rounds; the few trees since then are applied where the block is read.

Passes are jobs, some thousand of them for a fit, so they are for tables that no task can hold.  A table
of at most HELD bytes of bins and margins is fitted by one task that keeps them (`Held`): the same sums, so the
same trees, without a job a level.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import hash16
from ..sources.scratch import written

UNIT = 1 << 36
#: Rounds after which margins are written into the blocks.
REBASE = 25
#: Rows that cut points are taken from, those of smallest id hash; the bound of all that one task gathers.
SAMPLE = 200_000
#: Rows that are counted together at a time.
BLOCK = 1 << 17
#: Tasks whose sums the driver adds itself.
DIRECT = 16
#: Bytes that a task keeps to fit a table on its own; more go through passes.
HELD = 600_000_000
#: Bytes a row that it keeps beside the bins: outcome, mark, margin.
BESIDE = 10
#: Rows whose sums are added at a time; sums of so many whole numbers of 2^36 are exact as doubles.
CHUNK = 1 << 17
#: Features are counted together up to so many cells, if the rows are that many.
CELLS = 4096


@dataclass(frozen=True)
class Settings:
    """Fixed values of the learners; a fit stops when the held-out loss has not fallen for `patience` rounds."""

    rounds: int = 150
    step: float = 0.05
    leaves: int = 15
    bins: int = 63
    leaf_rows: int = 200
    l2: float = 1.0
    patience: int = 10
    tolerance: float = 1e-7
    least_hessian: float = 1e-3


def _mark_type(n: int) -> type:
    return np.uint8 if n <= 1 << 8 else np.uint16 if n <= 1 << 16 else np.int32


@dataclass
class Tree:
    """Nodes in the order of their making; feature -1 marks a leaf.  x <= cut goes left."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    rows: list[int] = field(default_factory=lambda: [0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def _marks(self, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A small number for each row of bins (features x rows), and the leaf that each number stands for.

        Children come after their parents; the left one keeps its parent's number.
        """
        at = np.zeros(bins.shape[1], _mark_type(len(self.feature)))
        mark, leaves = {0: 0}, [0]
        for k, f in enumerate(self.feature):
            if f >= 0:
                here = mark[k]
                right = bins[f] > self.bin[k]
                right &= at == here
                np.putmask(at, right, len(leaves))
                mark[self.left[k]], mark[self.right[k]] = here, len(leaves)
                leaves[here] = self.left[k]
                leaves.append(self.right[k])
        return at, np.array(leaves)

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins (features x rows)."""
        at, leaves = self._marks(bins)
        return leaves[at]

    def add(self, bins: np.ndarray, margin: np.ndarray) -> None:
        at, leaves = self._marks(bins)
        margin += np.array(self.value)[leaves][at]


@dataclass
class Model:
    """cuts[f]: upper ends of the bins of feature f but for the last; losses: of the held-out part, without a tree first."""

    features: list[str]
    cuts: list[np.ndarray]
    base: float
    trees: list[Tree]
    losses: list[float]

    def binned(self, columns: list[np.ndarray]) -> np.ndarray:
        """Rows x features; what lies together in memory is a feature."""
        kind = _mark_type(1 + max(map(len, self.cuts), default=0))
        return np.stack([np.searchsorted(c, x, side="left").astype(kind) for c, x in zip(self.cuts, columns, strict=True)]).T

    def probability(self, columns: list[np.ndarray]) -> np.ndarray:
        bins = self.binned(columns).T
        margin = np.full(bins.shape[1], self.base)
        for tree in self.trees:
            tree.add(bins, margin)
        return 1 / (1 + np.exp(-margin))


def stopped_after(losses: list[float], patience: int = 10, tolerance: float = 1e-7) -> int | None:
    """The round after which fitting stops: none of the last `patience` losses is lower than the one before them.

    losses[0] is the loss without a tree, losses[k] that after k rounds.  None if no round stops it.
    """
    for k in range(patience, len(losses)):
        if min(losses[k - patience + 1 : k + 1]) >= losses[k - patience] - tolerance:
            return k
    return None


def cut_hash() -> Column:
    """What chooses the rows that cut points are taken from."""
    return hash16("cuts-v1|", F.col("row_id"))


def cut_points(rows: DataFrame, features: list[str], bins: int = 63, sample: int = SAMPLE) -> list[np.ndarray]:
    """Upper ends of all bins but the last: midpoints between values if these are few, else quantiles of about `sample` rows.

    The sample is those rows whose id hash (column cut_hash, or made of row_id) is below a share of its range.
    """
    n = rows.count()
    share = min(1.0, sample / max(1, n))
    chosen = rows if share == 1.0 else rows.where((F.col("cut_hash") if "cut_hash" in rows.columns else cut_hash()) < f"{int(share * 2**64):016x}")
    at = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    few = lambda f: F.slice(F.sort_array(F.collect_set(F.col(f).cast("double"))), 1, bins + 1)
    told = chosen.agg(*[F.percentile(F.col(f).cast("double"), at).alias(f"q{k}") for k, f in enumerate(features)], *[few(f).alias(f"v{k}") for k, f in enumerate(features)]).collect()[0]
    out = []
    for k in range(len(features)):
        values = np.array(told[f"v{k}"] or [], float)
        out.append((values[1:] + values[:-1]) / 2 if len(values) <= bins else np.unique(told[f"q{k}"]))
    return out


def blocks(rows: DataFrame, features: list[str], cuts: list[np.ndarray]) -> DataFrame:
    """Packed arrays of rows that are equal in bins, arm, outcome and part, with their number, a block a row.

    rows: features, treatment, conversion, early_stop.
    """
    n = len(features)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def packed() -> pa.RecordBatch:
            cells, count = np.unique(np.concatenate(held), axis=0, return_counts=True)
            held.clear()
            one = lambda x: pa.array([np.ascontiguousarray(x).tobytes()], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([len(cells)], pa.int32()), one(cells[:, :n].T), one(cells[:, n]), one(cells[:, n + 1]), one(cells[:, n + 2]), one(count.astype("<i8")), pa.array([None], pa.binary())], names=_BLOCK.names)

        for b in batches:
            columns = [b.column(k).to_numpy(zero_copy_only=False) for k in range(n + 3)]
            binned = [np.searchsorted(c, x, side="left") for c, x in zip(cuts, columns[:n], strict=True)]
            held.append(np.stack([*binned, *columns[n:]], axis=1).astype(np.uint8))
            if sum(map(len, held)) >= BLOCK:
                yield packed()
        if held:
            yield packed()

    kept = rows.select(*[F.col(f).cast("double") for f in features], F.col("treatment").cast("int"), F.col("conversion").cast("int"), F.col("early_stop").cast("int"))
    return kept.mapInArrow(made, _BLOCK_SCHEMA)


_BLOCK_SCHEMA = "n int, bins binary, arm binary, y binary, early binary, weight binary, margin binary"
_BLOCK = pa.schema([("n", pa.int32()), *[(c, pa.binary()) for c in ("bins", "arm", "y", "early", "weight", "margin")]])


def _opened(b: pa.RecordBatch, k: int, role: str, base: float) -> tuple[np.ndarray, ...]:
    """bins (features x rows), outcome, held-out, weight and margin of the k-th block's rows that a role learns from.

    response: all rows; s: all, with the arm as the last feature; t0, t1: rows of that arm.
    """
    n, *raw = (c[k].as_py() for c in b.columns)
    bins = np.frombuffer(raw[0], np.uint8).reshape(-1, n)
    arm, y, early = (np.frombuffer(x, np.uint8) for x in raw[1:4])
    weight = np.frombuffer(raw[4], "<i8")
    margin = np.full(n, base) if raw[5] is None else np.frombuffer(raw[5], "<f8").copy()
    if role == "s":
        bins = np.concatenate([bins, arm[None]])
    keep = arm == int(role[1]) if role in ("t0", "t1") else slice(None)
    return bins[:, keep], y[keep].astype(np.int64), early[keep] == 1, weight[keep], margin[keep]


def _whole(x: np.ndarray) -> np.ndarray:
    return np.rint(x * UNIT).astype(np.int64)


_SUMS = pa.schema([("node", pa.int32()), ("feature", pa.int32()), ("bin", pa.int32()), ("g", pa.int64()), ("h", pa.int64()), ("n", pa.int64())])
#: Nodes of rows that are no histograms: the held-out loss, and the outcomes of the fitted rows.
_LOSS, _LABELS = -1, -2


@dataclass(frozen=True)
class Told:
    """What one pass tells: by node the sums (features x 256 bins x gradient, Hessian, rows); of the held-out part its
    loss, ones and rows; of the fitted part its ones and rows."""

    nodes: dict[int, np.ndarray]
    loss: tuple[float, int, int]
    labels: tuple[int, int]


def level(table: DataFrame, role: str, base: float, trees: list[Tree], current: Tree, asked: list[int], features: int, tasks: int) -> Told:
    """Sums by (node, feature, bin) of the `asked` nodes of the tree that grows, and the held-out loss before it.

    tasks: partitions of the table; the sums of a few are added by the driver, of more by Spark.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked_at = {node: k for k, node in enumerate(asked)}
        loss, labels, sums = [0, 0, 0], [0, 0, 0], None
        for b in batches:
            for k in range(b.num_rows):
                bins, y, early, weight, margin = _opened(b, k, role, base)
                for tree in trees:
                    tree.add(bins, margin)
                m, t, w = margin[early], y[early], weight[early]
                each = np.maximum(m, 0) - m * t + np.log1p(np.exp(-np.abs(m)))
                loss = [x + int(z.sum()) for x, z in zip(loss, (_whole(each) * w, t * w, w), strict=True)]
                fit = ~early
                bins, y, weight, margin = bins[:, fit], y[fit], weight[fit], margin[fit]
                labels = [labels[0] + int((y * weight).sum()), 0, labels[2] + int(weight.sum())]
                if not asked or not len(y):
                    continue
                p = 1 / (1 + np.exp(-margin))
                leaf = np.array([asked_at.get(x, -1) for x in range(len(current.feature))])[current.leaf_of(bins)]
                here = leaf >= 0
                code = leaf[here] * 256
                # Whole numbers of less than 2^53 in all, so that their sums as doubles are exact.
                values = [(_whole(x) * weight)[here].astype(float) for x in (p - y, p * (1 - p))] + [weight[here].astype(float)]
                sums = np.zeros((len(bins), 3, len(asked) * 256), np.int64) if sums is None else sums
                for f in range(len(bins)):
                    for c, x in enumerate(values):
                        sums[f, c] += np.bincount(code + bins[f, here], weights=x, minlength=len(asked) * 256).astype(np.int64)
        head = [(_LOSS, 0, 0, *loss), (_LABELS, 0, 0, *labels)]
        out = [np.array(c, np.int64) for c in zip(*head, strict=True)]
        for f in range(0 if sums is None else len(sums)):
            at = np.flatnonzero(sums[f, 2])
            more = [np.array(asked)[at // 256], np.full(len(at), f), at % 256, *sums[f][:, at]]
            out = [np.concatenate([x, z]) for x, z in zip(out, more, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c).cast(kind) for c, kind in zip(out, _SUMS.types, strict=True)], schema=_SUMS)

    found = table.mapInArrow(made, "node int, feature int, bin int, g long, h long, n long")
    if tasks > DIRECT:
        exact = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
        found = found.groupBy("node", "feature", "bin").agg(exact("g"), exact("h"), F.sum("n").alias("n"))
    rows = found.toArrow()  # nodes x features x bins at most, of each of DIRECT tasks at most
    node, feature, bin_ = (rows.column(k).to_numpy() for k in range(3))
    g, h, n = (np.array(rows.column(k).to_pylist(), object) for k in range(3, 6))
    out, head = {}, {}
    for special in (_LOSS, _LABELS):
        at = node == special
        head[special] = tuple(int(sum(x[at])) for x in (g, h, n))
    for k in asked:
        at = np.flatnonzero(node == k)
        sums = np.zeros((features, 256, 3), object)
        for c, x in enumerate((g, h, n)):
            np.add.at(sums[:, :, c], (feature[at], bin_[at]), x[at])
        # Whole numbers until here, so equal in every order of addition; one rounding each.
        out[k] = sums.astype(float) / np.array([UNIT, UNIT, 1.0])
    loss, labels = head[_LOSS], head[_LABELS]
    return Told(out, (loss[0] / UNIT, loss[1], loss[2]), (labels[0], labels[2]))


@dataclass(frozen=True)
class Split:
    gain: float
    feature: int
    bin: int


def best_split(sums: np.ndarray, settings: Settings) -> Split | None:
    """The split of largest gain that leaves both sides enough rows; ties to the first feature, then the lowest bin."""
    left = np.cumsum(sums, axis=1)
    total = left[:, -1:, :]
    right = total - left
    score = lambda x: x[..., 0] ** 2 / (x[..., 1] + settings.l2)
    gain = score(left) + score(right) - score(total)
    fine = (np.minimum(left[..., 2], right[..., 2]) >= settings.leaf_rows) & (np.minimum(left[..., 1], right[..., 1]) >= settings.least_hessian) & (gain > 0)
    if not fine.any():
        return None
    at = int(np.argmax(np.where(fine, gain, -np.inf)))
    return Split(float(gain.flat[at]), at // 256, at % 256)


def grow(ask, settings: Settings, ahead: bool = True) -> tuple[Tree, Told]:
    """A tree from `ask`, which gives the sums of some leaves of a tree; and what its first call told beside them.

    Best first: the leaf of largest gain is split next.  Before a split is made the sums of its
    children are asked for, if `ahead` together with those of all other leaves' children: each round asks with
    a tree in which every leaf that can be is split.
    """
    tree = Tree()
    first = ask(tree, [0])
    tree.value[0], tree.rows[0] = _leaf(first.nodes[0], settings)
    split = {0: best_split(first.nodes[0], settings)}
    made: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    leaves = 1
    while leaves < settings.leaves:
        open_ = [k for k, s in split.items() if s]
        if not open_:
            break
        node = min(open_, key=lambda k: (-split[k].gain, k))
        if node not in made:
            grown, asked = _split_all(tree, {k: split[k] for k in (open_ if ahead else [node]) if k not in made})
            told = ask(grown, [c for pair in asked.values() for c in pair]).nodes
            made |= {k: (told[a], told[b]) for k, (a, b) in asked.items()}
        s = split.pop(node)
        tree.feature[node], tree.bin[node], tree.gain[node] = s.feature, s.bin, s.gain
        for side, sums in zip(("left", "right"), made.pop(node), strict=True):
            child = _new(tree)
            getattr(tree, side)[node] = child
            tree.value[child], tree.rows[child] = _leaf(sums, settings)
            # The last split's children stay leaves.
            split[child] = best_split(sums, settings) if leaves + 1 < settings.leaves else None
        leaves += 1
    return tree, first


def _new(tree: Tree) -> int:
    for name, x in (("feature", -1), ("bin", 0), ("left", 0), ("right", 0), ("value", 0.0), ("rows", 0), ("gain", 0.0)):
        getattr(tree, name).append(x)
    return len(tree.feature) - 1


def _split_all(tree: Tree, splits: dict[int, Split]) -> tuple[Tree, dict[int, tuple[int, int]]]:
    """A copy of the tree with these leaves split, and the children of each."""
    ahead = Tree(*(list(getattr(tree, f)) for f in Tree.__dataclass_fields__))
    children = {}
    for k, s in splits.items():
        ahead.feature[k], ahead.bin[k] = s.feature, s.bin
        ahead.left[k], ahead.right[k] = children[k] = _new(ahead), _new(ahead)
    return ahead, children


def _leaf(sums: np.ndarray, settings: Settings) -> tuple[float, int]:
    g, h, n = sums[0].sum(axis=0)
    return float(-settings.step * g / (h + settings.l2)) if n else 0.0, int(n)


def rebased(table: DataFrame, role: str, base: float, trees: list[Tree]) -> DataFrame:
    """The blocks with the margins that these trees give; rows of other roles keep what they have."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            margins = []
            for k in range(b.num_rows):
                bins, *_, margin = _opened(b, k, "s" if role == "s" else "response", base)
                for tree in trees:
                    tree.add(bins, margin)
                margins.append(margin.astype("<f8").tobytes())
            yield b.set_column(b.num_columns - 1, _BLOCK.field("margin"), pa.array(margins, pa.binary()))

    return written(table.mapInArrow(made, _BLOCK_SCHEMA), "margins")


class Held:
    """The rows of one role in the memory of a task, feature by feature, with their margins; answers what `grow` asks.

    Sums are added up for the smaller child of a split only: its sibling has what is left of the parent.  A split marks the
    smaller child's rows.  Rows of a child are listed, but for those of the largest leaf so far, which keep the first mark.
    """

    def __init__(self, batches: Iterator[pa.RecordBatch], role: str, base: float, bins: list[int], rows: tuple[int, int], leaves: int) -> None:
        """bins: how many each feature has; rows: of the fitted and of the held-out part."""
        self.sizes = bins
        self.parts = [(np.empty((len(bins), n), np.uint8), np.empty(n, np.uint8), np.full(n, base)) for n in rows]
        self.at = np.zeros(rows[0], _mark_type(leaves))
        filled = [0, 0]
        for b in batches:
            for k in range(b.num_rows):
                x, y, early, weight, _ = _opened(b, k, role, base)
                for part, here in enumerate((~early, early)):
                    chosen = np.repeat(np.flatnonzero(here), weight[here])
                    into = slice(filled[part], filled[part] + len(chosen))
                    self.parts[part][0][:, into], self.parts[part][1][into] = x[:, chosen], y[chosen]
                    filled[part] = into.stop
        if filled != list(rows):
            raise ValueError(f"{role}: {rows} rows were counted, {filled} read")
        self.single, self.joint = [[f] for f in range(len(bins))], _joint(bins)
        self.counts: np.ndarray | None = None

    def ask(self, tree: Tree, asked: list[int]) -> Told:
        """Of the root, of both children of one split, or of no node; only splits that are then made may be asked about."""
        if not asked:
            found = {}
        elif asked == [0]:
            self.at.fill(0)
            self.mark, self.marks, self.rows = {0: 0}, 1, {}
            self.sums = found = {0: self._summed(None)}
        else:
            parent = tree.left.index(asked[0])
            found = self._split(parent, tree.feature[parent], tree.bin[parent], *asked)
            self.sums = self.sums | found
        nodes = {k: x.astype(float) / np.array([UNIT, UNIT, 1.0]) for k, x in found.items()}
        if len(asked) > 1:
            return Told(nodes, (0.0, 0, 0), (0, 0))
        y = self.parts[0][1]
        return Told(nodes, self._loss(), (int(y.sum(dtype=np.int64)), len(y)))

    def _split(self, parent: int, f: int, cut: int, left: int, right: int) -> dict[int, np.ndarray]:
        whole, listed, bins = self.sums.pop(parent), self.rows.pop(parent, None), self.parts[0][0][f]
        below, n = whole[f, : cut + 1, 2].sum(), whole[f, :, 2].sum()
        few, many = (left, right) if 2 * below <= n else (right, left)
        if listed is None:
            chosen = bins <= cut if few == left else bins > cut
            chosen &= self.at == self.mark[parent]
            part = np.concatenate([low + np.flatnonzero(chosen[low : low + CHUNK]).astype(np.int32) for low in range(0, len(chosen), CHUNK)])
        else:
            chosen = (bins[listed] <= cut) == (few == left)
            part, self.rows[many] = listed[chosen], listed[~chosen]
        self.at[part] = self.marks
        self.mark[few], self.mark[many], self.marks = self.marks, self.mark[parent], self.marks + 1
        self.rows[few], sums = part, self._summed(part)
        return {few: sums, many: whole - sums}

    def _summed(self, part: np.ndarray | None) -> np.ndarray:
        """features x 256 bins x gradient, Hessian, rows, of these fitted rows or of all."""
        bins, y, margin = self.parts[0]
        n = len(y) if part is None else len(part)
        groups = self.joint if n >= CELLS else self.single
        told = [np.zeros((3, math.prod(self.sizes[f] for f in g)), np.int64) for g in groups]
        # Numbers of all rows by bin are the same in every tree.
        count = part is not None or self.counts is None
        for low in range(0, n, CHUNK):
            here = slice(low, low + CHUNK) if part is None else part[low : low + CHUNK]
            p = 1 / (1 + np.exp(-margin[here]))
            values = [np.rint(x * UNIT) for x in (p - y[here], p * (1 - p))]
            for g, into in zip(groups, told, strict=True):
                code = bins[g[0]][here].astype(np.uint16)
                for f, size in zip(g[1:], np.cumprod([self.sizes[f] for f in g[:-1]]), strict=True):
                    code += bins[f][here] * np.uint16(size)
                code = code.astype(np.intp)
                for c, x in enumerate(values):
                    into[c] += np.bincount(code, weights=x, minlength=into.shape[1]).astype(np.int64)
                if count:
                    into[2] += np.bincount(code, minlength=into.shape[1])
        out = np.zeros((len(self.sizes), 256, 3), np.int64)
        for g, x in zip(groups, told, strict=True):
            cells = x.reshape(3, *[self.sizes[f] for f in reversed(g)])
            for k, f in enumerate(g):
                out[f, : self.sizes[f]] = cells.sum(axis=tuple(1 + a for a in range(len(g)) if a != len(g) - 1 - k)).T
        if part is None:
            self.counts = out[:, :, 2].copy() if count else self.counts
            out[:, :, 2] = self.counts
        return out

    def _loss(self) -> tuple[float, int, int]:
        """Of the held-out part: loss, ones and rows."""
        _, y, margin = self.parts[1]
        loss = 0
        for low in range(0, len(y), CHUNK):
            m, t = margin[low : low + CHUNK], y[low : low + CHUNK].astype(np.int64)
            loss += int(_whole(np.maximum(m, 0) - m * t + np.log1p(np.exp(-np.abs(m)))).sum())
        return loss / UNIT, int(y.sum(dtype=np.int64)), len(y)

    def add(self, tree: Tree) -> None:
        """The tree that was asked about last is part of the model."""
        values = np.zeros(self.marks)
        for k, mark in self.mark.items():
            if tree.feature[k] < 0:
                values[mark] = tree.value[k]
        margin = self.parts[0][2]
        for low in range(0, len(margin), CHUNK):
            margin[low : low + CHUNK] += values[self.at[low : low + CHUNK]]
        bins, _, margin = self.parts[1]
        for low in range(0, len(margin), CHUNK):
            tree.add(bins[:, low : low + CHUNK], margin[low : low + CHUNK])


def _joint(sizes: list[int]) -> list[list[int]]:
    """Groups of features with at most CELLS combinations of bins each; the largest first, each into the first group that has room."""
    groups: list[list[int]] = []
    for f in sorted(range(len(sizes)), key=lambda f: (-sizes[f], f)):
        for g in groups:
            if math.prod(sizes[x] for x in g) * sizes[f] <= CELLS:
                g.append(f)
                break
        else:
            groups.append([f])
    return groups


def boosted(ask: Callable, add: Callable[[Tree], None], settings: Settings, ahead: bool) -> tuple[list[Tree], list[float]]:
    """Trees and held-out losses, from what gives sums and what takes a tree into the model."""
    trees, losses = [], []
    for _ in range(settings.rounds):
        tree, told = grow(ask, settings, ahead)
        # The first pass of a round tells the loss after the rounds before.
        losses.append(told.loss[0] / told.loss[2])
        if stopped_after(losses, settings.patience, settings.tolerance) is not None:
            break
        trees.append(tree)
        add(tree)
    else:
        told = ask(Tree(), [])
        losses.append(told.loss[0] / told.loss[2])
    return trees, losses


def by_passes(table: DataFrame, role: str, base: float, features: int, settings: Settings) -> tuple[list[Tree], list[float]]:
    """Fitted by a job for each level: for tables of any size."""
    at, since, tasks = table, [], table.rdd.getNumPartitions()

    def add(tree: Tree) -> None:
        nonlocal at, since
        since = [*since, tree]
        if len(since) == REBASE:
            at, since = rebased(at, role, base, since), []

    return boosted(lambda tree, asked: level(at, role, base, since, tree, asked, features, tasks), add, settings, ahead=True)


def in_a_task(table: DataFrame, role: str, base: float, bins: list[int], rows: tuple[int, int], settings: Settings) -> tuple[list[Tree], list[float]]:
    """Fitted by one task that keeps the rows: for tables of at most HELD bytes."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held(batches, role, base, bins, rows, settings.leaves)
        told = pickle.dumps(boosted(held.ask, held.add, settings, ahead=False))
        yield pa.RecordBatch.from_arrays([pa.array([told], pa.binary())], names=["told"])

    return pickle.loads(bytes(table.coalesce(1).mapInArrow(made, "told binary").collect()[0].told))


def fit(table: DataFrame, features: list[str], cuts: list[np.ndarray], role: str = "response", settings: Settings | None = None) -> Model:
    """Boosted trees of one role over the blocks; needs both outcomes among the fitted and the held-out rows."""
    settings = settings or Settings()
    width = len(features) + (role == "s")
    start = level(table, role, 0.0, [], Tree(), [], width, table.rdd.getNumPartitions())
    (ones, n), held = start.labels, start.loss
    if not 0 < ones < n or not 0 < held[1] < held[2]:
        raise ValueError(f"{role}: both outcomes are needed to fit and to stop")
    base = math.log(ones / (n - ones))
    names, ends = (features, cuts) if role != "s" else ([*features, "treatment"], [*cuts, np.array([0.5])])
    if (n + held[2]) * (width + BESIDE) <= HELD:
        told = in_a_task(table, role, base, [len(c) + 1 for c in ends], (n, held[2]), settings)
    else:
        told = by_passes(table, role, base, width, settings)
    return Model(names, ends, base, *told)


def tree_rows(model: Model) -> list[tuple]:
    """(tree, node, feature, cut, left, right, value, rows, gain) of all nodes; null feature and cut at leaves."""
    out = []
    for t, tree in enumerate(model.trees):
        for k, f in enumerate(tree.feature):
            inner = f >= 0
            out.append((t, k, model.features[f] if inner else None, float(model.cuts[f][tree.bin[k]]) if inner else None, tree.left[k] if inner else None, tree.right[k] if inner else None, float(tree.value[k]), int(tree.rows[k]), float(tree.gain[k])))
    return out


TREE_SCHEMA = "tree int, node int, feature string, cut double, left int, right int, value double, rows long, gain double"


def trees_of(rows: list, features: list[str], cuts: list[np.ndarray], base: float, losses: list[float]) -> Model:
    """A model from its rows, in any order."""
    by: dict[int, dict[int, tuple]] = {}
    for t, k, *rest in rows:
        by.setdefault(t, {})[k] = tuple(rest)
    trees = []
    for t in sorted(by):
        nodes = [by[t][k] for k in range(len(by[t]))]
        at = [features.index(f) if f is not None else -1 for f, *_ in nodes]
        trees.append(Tree(at, [int(np.searchsorted(cuts[f], c)) if f >= 0 else 0 for f, (_, c, *_) in zip(at, nodes, strict=True)], [x[2] or 0 for x in nodes], [x[3] or 0 for x in nodes], [x[4] for x in nodes], [x[5] for x in nodes], [x[6] for x in nodes]))
    return Model(features, cuts, base, trees, losses)


def predict(model: Model, rows: DataFrame, name: str, arm: int | None = None) -> DataFrame:
    """Adds the probability of the outcome, under a given arm if the model knows arms; the observed arm is not used."""
    told = rows.sparkSession.sparkContext.broadcast(model)  # LEAVES nodes a round
    names = [f for f in model.features if f != "treatment"]
    asked: list[Column] = [F.col(f).cast("double") for f in names]
    if "treatment" in model.features:
        if arm is None:
            raise ValueError("an arm to predict under is needed")
        asked.append(F.lit(float(arm)))

    @F.pandas_udf("double")
    def probability(*columns: pd.Series) -> pd.Series:
        return pd.Series(told.value.probability([c.to_numpy() for c in columns]))

    return rows.withColumn(name, probability(*asked))

