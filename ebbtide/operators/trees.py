"""Decision trees by histograms: boosted rounds (second order) and full-depth forests.

Features are binned once (cut points from one sketch pass), rows are written as (id hash,
label, bins). Trees grow level by level: each task adds up its rows' two channels (g, h)
by (tree, node, feature, bin), a node's sums meet in one task, which picks its split, and the
driver sees one row a node. As soon as every open node has at most ``LOCAL_ROWS`` rows, their
rows are grouped by (tree, node) and each node's subtree is finished in one task by the same
rule, so depth has no bound and no task holds more than that many rows. These subtrees are
written as a table, as a forest of full depth has about as many nodes as its trees have rows:
the driver keeps the parts above them, and rows to be scored are dealt to the subtrees. Boosting, where each round waits for the last, keeps shares of the
rows in the executors, and a level is one job over them. All ways give the same tree: channels
are whole numbers (fixed point), so sums do not depend on order or partitioning, and ties go
to the first feature and bin.

Boosting: g and h are gradient and hessian of the log loss of the margin so far, positive
rows scaled by ``scale_pos``; the shares keep the margins and are checkpointed every
``SNAPSHOT`` rounds. Forest: g is the weighted positives, h the weight
(drawn as a Poisson bootstrap by hash of row and tree); maximizing G^2/H is the Gini rule.
"""

from __future__ import annotations

import functools
import json
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.session import ensure_checkpoint_dir, scratch_dir

MAX_BINS = 256
LOCAL_ROWS = 50_000
#: Rows times trees that a pass over a stored forest deals, rows that meet one subtree, and rows of a block of scores.
PASS_ROWS = 10_000_000
SUBTREE_ROWS = 500_000
BLOCK_BITS = 14
#: Rows that a share of a boosted table has at most.
TASK_ROWS = 250_000
SNAPSHOT = 25
#: Fixed point of the channels: 2^20 units; 10^12 rows of weight 8 still fit a long.
UNIT = float(1 << 20)
DOUBLE_UNIT = 1.0 / UNIT
#: Trees of a forest that are grown side by side.
BATCH = 20


@dataclass
class Tree:
    """Flat binary tree: a row goes left where its bin is at most ``cut``; leaves have
    feature -1 and a value."""
    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    depth: list[int] = field(default_factory=lambda: [0])

    def split(self, node: int, feature: int, cut: int) -> tuple[int, int]:
        kids = len(self.feature), len(self.feature) + 1
        self.feature[node], self.cut[node], self.left[node], self.right[node] = feature, cut, *kids
        for _ in kids:
            self.feature.append(-1)
            self.cut.append(0)
            self.left.append(0)
            self.right.append(0)
            self.value.append(0.0)
            self.depth.append(self.depth[node] + 1)
        return kids

    def arrays(self) -> list[np.ndarray]:
        """Features, cuts, left and right children, values."""
        return [np.array(x) for x in (self.feature, self.cut, self.left, self.right, self.value)]

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of a (rows, features) matrix of bins."""
        return _leaves(self.arrays(), bins)

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaves(bins)]

    def packed(self) -> dict[str, bytes]:
        return {c: np.array(getattr(self, c), kind).tobytes() for c, kind in PACKED.items()}

    @staticmethod
    def unpacked(columns: dict[str, bytes]) -> dict[str, np.ndarray]:
        return {c: np.frombuffer(columns[c], kind) for c, kind in PACKED.items()}

    def graft(self, node: int, sub: "Tree") -> None:
        """Put another tree in the place of a leaf."""
        places = {0: node}
        for k in range(len(sub.feature)):
            at = places[k]
            self.value[at] = sub.value[k]
            if sub.feature[k] >= 0:
                places[sub.left[k]], places[sub.right[k]] = self.split(at, sub.feature[k], sub.cut[k])


#: The columns of a stored subtree.
PACKED = {"feature": np.int32, "cut": np.int32, "left": np.int32, "right": np.int32, "value": np.float64, "depth": np.int32}
SUBTREE = "tree long, node long, " + ", ".join(f"{c} binary" for c in PACKED)


def _leaves(tree: list[np.ndarray], bins: np.ndarray) -> np.ndarray:
    f, c, lo, hi, _ = tree
    at = np.zeros(len(bins), np.int64)
    live = np.arange(len(bins)) if f[0] >= 0 else np.arange(0)
    while live.size:
        k = at[live]
        at[live] = k = np.where(bins[live, f[k]] <= c[k], lo[k], hi[k])
        live = live[f[k] >= 0]
    return at


@dataclass(frozen=True)
class Rule:
    """When and how a node is split. ``features``: how many are drawn a node (None: all)."""
    l2: float = 1.0
    min_weight: float = 1.0
    max_depth: int | None = 6
    rate: float = 0.3
    negate: bool = True
    features: int | None = None
    seed: int = 42

    def value(self, g: int, h: int) -> float:
        x = g * DOUBLE_UNIT / max(h * DOUBLE_UNIT + self.l2, 1e-12)
        return -self.rate * x if self.negate else x

    def drawn(self, n_features: int, tree: int, path: int) -> np.ndarray | None:
        if self.features is None or self.features >= n_features:
            return None
        return np.sort(np.random.default_rng([self.seed, tree, path]).choice(n_features, self.features, replace=False))

    def best(self, g: np.ndarray, h: np.ndarray, allowed: np.ndarray | None, depth: int) -> tuple[int, int] | None:
        """(feature, cut) of the best split of a node from its (features, bins) sums."""
        if self.max_depth is not None and depth >= self.max_depth:
            return None
        some = 0 if allowed is None else int(allowed[0])  # sums of the others may be absent
        tg, th = int(g[some].sum()) * DOUBLE_UNIT, int(h[some].sum()) * DOUBLE_UNIT
        gl, hl = np.cumsum(g, axis=1)[:, :-1] * DOUBLE_UNIT, np.cumsum(h, axis=1)[:, :-1] * DOUBLE_UNIT
        fits = np.ones(gl.shape, bool)
        if allowed is not None:
            fits[:] = False
            fits[allowed] = True
        return self.first_best(gl, hl, tg, th, fits)

    def first_best(self, gl: np.ndarray, hl: np.ndarray, tg: float, th: float, fits: np.ndarray) -> tuple[int, int] | None:
        """(row, column) of the first largest gain among the cuts that fit, by the sums to their left."""
        gr, hr = tg - gl, th - hl
        fits = fits & (hl >= self.min_weight) & (hr >= self.min_weight) & (hl > 0) & (hr > 0)
        if not fits.any():
            return None
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(fits, gl ** 2 / (hl + self.l2) + gr ** 2 / (hr + self.l2), -np.inf)
        k = int(gain.argmax())
        if gain.flat[k] <= tg ** 2 / (th + self.l2) + 1e-9:
            return None
        return divmod(k, gain.shape[1])

    def settled(self, g: np.ndarray, h: np.ndarray, depth: int) -> bool:
        """No cut can gain: one row, the deepest level, or without l2 one ratio g / h in all rows."""
        if len(g) < 2 or (self.max_depth is not None and depth >= self.max_depth):
            return True
        return self.l2 == 0 and (not g.any() or bool((g == h).all()))


def sums(cols: list[np.ndarray] | np.ndarray, n_bins: int, *channels: np.ndarray) -> list[np.ndarray]:
    """The channels (whole numbers) added up by (column, bin); all sums of a task stay below
    2^53, exact as doubles."""
    cols = [c.astype(np.intp) for c in cols]
    return [np.stack([np.bincount(c, x, n_bins) for c in cols]) for x in channels]


def _best_local(part: np.ndarray, g: np.ndarray, h: np.ndarray, rule: Rule, n_bins: int, depth: int) -> tuple[int, int] | None:
    """The best cut of rows in memory, of which ``part`` has the (feature, row) bins. Few rows
    are ordered by bin, which gives the same sums at every cut that holds a row."""
    if len(g) > n_bins:
        return rule.best(*sums(part, n_bins, g, h), None, depth)
    order = part.argsort(axis=1, kind="stable")
    own = np.take_along_axis(part, order, 1)
    gl, hl = g[order].cumsum(axis=1)[:, :-1] * DOUBLE_UNIT, h[order].cumsum(axis=1)[:, :-1] * DOUBLE_UNIT
    cut = rule.first_best(gl, hl, g.sum() * DOUBLE_UNIT, h.sum() * DOUBLE_UNIT, own[:, 1:] != own[:, :-1])
    return cut and (cut[0], int(own[cut]))


def grow_local(bins: np.ndarray, g: np.ndarray, h: np.ndarray, rule: Rule, n_bins: int, tree: int, path: int, depth: int) -> Tree:
    """A whole subtree of rows in memory. ``path`` numbers the node (root 1, children 2p and
    2p + 1) and with the tree decides which features are drawn."""
    out = Tree()
    cols, g, h = np.ascontiguousarray(bins.T), g.astype(np.float64), h.astype(np.float64)
    todo = [(0, np.arange(len(g)), path, depth)]
    while todo:
        node, rows, p, d = todo.pop()
        a, b = g[rows], h[rows]
        out.value[node] = rule.value(int(a.sum()), int(b.sum()))
        if rule.settled(a, b, d):
            continue
        drawn = rule.drawn(len(cols), tree, p)  # in ascending order, so ties go the same way as among all
        part = cols[:, rows] if drawn is None else cols[drawn[:, None], rows]
        cut = _best_local(part, a, b, rule, n_bins, d)
        if cut is not None:
            go = part[cut[0]] <= cut[1]
            left, right = out.split(node, cut[0] if drawn is None else int(drawn[cut[0]]), cut[1])
            todo += [(left, rows[go], 2 * p, d + 1), (right, rows[~go], 2 * p + 1, d + 1)]
    return out


#: (tree, id hashes, labels, margins) -> (g, h) as whole numbers of 1 / UNIT.
Channels = Callable[[int, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def _rows(batch: pa.RecordBatch | pa.Table, n_features: int):
    ids, y, margin = (batch.column(k).to_numpy() for k in range(3)) if isinstance(batch, pa.Table) else (
        batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
    bins = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, n_features)
    return ids, y, margin, bins


def grow(data: DataFrame, n_features: int, n_bins: int, first: int, trees: list[Tree], size: int, rule: Rule, channels: Channels,
         local_rows: int = LOCAL_ROWS) -> DataFrame | None:
    """Grow these trees side by side, numbered from ``first``, over (id, y, margin, bins) of ``size`` rows;
    what is below their leaves is returned as rows (tree, node, subtree)."""
    open_: dict[tuple[int, int], int] = {(t, 0): 1 for t in range(len(trees))}  # (tree, node) -> path
    size = dict.fromkeys(open_, size)

    def each(batches: Iterator[pa.RecordBatch], nodes: set[tuple[int, int]]):
        """(tree, node, bins, g, h) of the rows in these nodes, batch by batch."""
        flat = {t: trees[t].arrays() for t, _ in nodes}
        wanted = {t: np.array([(t, node) in nodes for node in range(len(trees[t].feature))]) for t in flat}
        for b in batches:
            if not b.num_rows:
                continue
            ids, y, margin, bins = _rows(b, n_features)
            for t in sorted(flat):
                g, h = channels(first + t, ids, y, margin)
                drawn = np.flatnonzero(h > 0)
                at = _leaves(flat[t], bins[drawn])
                in_them = wanted[t][at]
                at, drawn = at[in_them], drawn[in_them]
                order = np.argsort(at.astype(np.int16) if len(wanted[t]) < 1 << 15 else at, kind="stable")
                for node, own in zip(*_runs(at[order], drawn[order])):
                    yield t, node, bins[own], g[own], h[own]

    while large := {k for k in open_ if size[k] > local_rows}:
        def level(batches: Iterator[pa.RecordBatch], large=large, open_=dict(open_)) -> Iterator[pa.RecordBatch]:
            held: dict[tuple[int, int], list[np.ndarray]] = {}
            drawn = {(t, node): rule.drawn(n_features, first + t, open_[t, node]) for t, node in large}
            for t, node, bins, g, h in each(batches, large):
                own = drawn[t, node]
                new = sums(bins.T if own is None else bins.T[own], n_bins, g, h, np.ones(len(g)))
                old = held.get((t, node))
                held[t, node] = new if old is None else [x + z for x, z in zip(old, new)]
            for (t, node), channel in held.items():
                cell = np.flatnonzero(channel[2].ravel())
                # a node's sums of this task travel as one row
                yield pa.RecordBatch.from_arrays(
                    [pa.array([t]), pa.array([node]), *(pa.array([x.astype(np.int64).tobytes()], pa.binary()) for x in (
                        cell, *(x.ravel()[cell] for x in channel)))], names=["tree", "node", "cell", "g", "h", "n"])

        at_node = {(t, node): (open_[t, node], trees[t].depth[node]) for t, node in large}  # path, depth

        def pick(group: pa.Table) -> pa.Table:
            t, node = group.column("tree")[0].as_py(), group.column("node")[0].as_py()
            path, depth = at_node[t, node]
            cell, *channel = (np.frombuffer(b"".join(group.column(c).to_pylist()), np.int64) for c in ("cell", "g", "h", "n"))
            own = rule.drawn(n_features, first + t, path)
            full = np.zeros((3, n_features, n_bins), np.int64)
            at = cell if own is None else own[cell // n_bins] * n_bins + cell % n_bins
            for x, total in zip(channel, full.reshape(3, -1)):
                np.add.at(total, at, x)
            g, h, n = full
            some = 0 if own is None else int(own[0])
            cut = rule.best(g, h, own, depth)
            less = 0 if cut is None else int(n[cut[0], :cut[1] + 1].sum())
            value = rule.value(int(g[some].sum()), int(h[some].sum()))
            return pa.table({"tree": [t], "node": [node], "value": [value], "feature": [-1 if cut is None else cut[0]],
                             "cut": [0 if cut is None else cut[1]], "less": [less], "n": [int(n[some].sum())]})

        for k in large:
            trees[k[0]].value[k[1]] = rule.value(0, 0)  # of a node whose rows were not drawn
        for r in (data.mapInArrow(level, "tree long, node long, cell binary, g binary, h binary, n binary").groupBy("tree", "node")
                  .applyInArrow(pick, "tree long, node long, value double, feature long, cut long, less long, n long").collect()):
            path = open_[r.tree, r.node]
            trees[r.tree].value[r.node] = r.value
            if r.feature >= 0:
                left, right = trees[r.tree].split(r.node, r.feature, r.cut)
                open_ |= {(r.tree, left): 2 * path, (r.tree, right): 2 * path + 1}
                size |= {(r.tree, left): r.less, (r.tree, right): r.n - r.less}
        for k in large:
            del open_[k]

    if not open_:
        return None

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the rows of a node and batch travel as one row
        for t, node, bins, g, h in each(batches, set(open_)):
            yield pa.RecordBatch.from_arrays(
                [pa.array([t]), pa.array([node]), *(pa.array([x.tobytes()], pa.binary()) for x in (g, h, bins))],
                names=["tree", "node", "g", "h", "bins"])

    def finish(group: pa.Table) -> pa.Table:
        t, node = group.column("tree")[0].as_py(), group.column("node")[0].as_py()
        g, h, bins = (np.frombuffer(b"".join(group.column(c).to_pylist()), kind) for c, kind in (("g", np.int64), ("h", np.int64), ("bins", np.uint8)))
        sub = grow_local(bins.reshape(-1, n_features), g, h, rule, n_bins, first + t, open_[t, node], trees[t].depth[node])
        return pa.table({"tree": [first + t], "node": [node], **{c: pa.array([x], pa.binary()) for c, x in sub.packed().items()}})

    dealt = data.mapInArrow(deal, "tree long, node long, g binary, h binary, bins binary")
    return dealt.groupBy("tree", "node").applyInArrow(finish, SUBTREE)


def _runs(keys: np.ndarray, values: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """Distinct sorted keys, and the values of each."""
    if not keys.size:
        return [], []
    starts = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[starts].tolist(), np.split(values, starts[1:])


# ---------------------------------------------------------------------------
# Boosting of a table that stays in the executors
# ---------------------------------------------------------------------------
class _Share:
    """One partition's rows by column, and the channels of the round. Eight features of two bins share a byte."""

    def __init__(self, ids: np.ndarray, y: np.ndarray, margin: np.ndarray, bins: np.ndarray, two: Sequence[int], wide: Sequence[int]):
        self.ids, self.y, self.margin, self.wide = ids, y, margin, wide
        self.cols = np.ascontiguousarray(bins.T)
        self.eights = [two[k:k + 8] for k in range(0, len(two), 8)]
        self.bytes = [np.packbits(self.cols[e], axis=0, bitorder="little")[0] for e in self.eights]

    def begin(self, channels: Channels, tree: int, last: Tree | None) -> "_Share":
        """The round's channels, with the margins moved on by the last round's tree."""
        if last is not None:
            self.margin = self.margin + last.predict(self.cols.T)
        self.g, self.h = (x.astype(np.float64) for x in channels(tree, self.ids, self.y, self.margin))
        return self

    def sums(self, tree: list[np.ndarray], asked: list[int], n_bins: int, cells: np.ndarray) -> np.ndarray:
        """The used (channel, feature, bin) sums of the rows in each of these leaves."""
        at = _leaves(tree, self.cols.T).astype(np.int16 if len(tree[0]) < 1 << 15 else np.int64)
        order = np.argsort(at, kind="stable")
        rows_of = dict(zip(*_runs(at[order], order)))
        bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)
        out = np.zeros((len(asked), 2, cells.size), np.int64)
        for k, rows in ((k, rows_of[n]) for k, n in enumerate(asked) if n in rows_of):
            full = np.zeros((2, len(self.cols), n_bins))
            own = self.g[rows], self.h[rows]
            for f in self.wide:
                bins = self.cols[f][rows].astype(np.intp)
                for c, x in enumerate(own):
                    full[c, f] = np.bincount(bins, x, n_bins)
            for features, packed in zip(self.eights, self.bytes):
                bins = packed[rows].astype(np.intp)
                for c, x in enumerate(own):
                    by = np.bincount(bins, x, 256)
                    full[c, features, 1] = ones = (by @ bits)[:len(features)]
                    full[c, features, 0] = by.sum() - ones
            out[k] = full.reshape(2, -1)[:, cells]
        return out


def _grow_shared(ask: Callable[[Tree, list[int]], np.ndarray], n_features: int, n_bins: int, cells: np.ndarray, rule: Rule, tree: int) -> Tree:
    """One tree by levels. Of two children the lighter one is added up, the other has what is
    left of its parent; children that cannot be split get their values from their parent."""
    out = Tree()
    level, asked, rest = [(0, 1)], [0], {}  # (node, path); nodes to add up; node -> (sums of its parent, the other child)
    while level:
        known = dict(zip(asked, ask(out, asked)))
        known |= {node: parent - known[kid] for node, (parent, kid) in rest.items()}
        after, asked, rest = [], [], {}
        for node, path in level:
            full = np.zeros((2, n_features * n_bins), np.int64)
            full[:, cells] = known[node]
            g, h = full.reshape(2, n_features, n_bins)
            tg, th = int(g[0].sum()), int(h[0].sum())
            out.value[node] = rule.value(tg, th)
            cut = rule.best(g, h, rule.drawn(n_features, tree, path), out.depth[node])
            if cut is None:
                continue
            left, right = out.split(node, *cut)
            lg, lh = int(g[cut[0], :cut[1] + 1].sum()), int(h[cut[0], :cut[1] + 1].sum())
            if out.depth[left] == rule.max_depth:
                out.value[left], out.value[right] = rule.value(lg, lh), rule.value(tg - lg, th - lh)
                continue
            light, heavy = (left, right) if 2 * lh <= th else (right, left)
            asked.append(light)
            rest[heavy] = known[node], light
            after += [(left, 2 * path), (right, 2 * path + 1)]
        level = after
    return out


def _shared_rounds(data: DataFrame, n_rows: int, cuts: list[list[float]], n_bins: int, rounds: int, rule: Rule, channels: Channels, local_rows: int) -> list[Tree]:
    """Every round over persisted shares of the rows; the same trees as in one task. A level is
    a job of one stage, which returns its open nodes' sums; the round's channels are computed
    and kept by its first job, and every ``SNAPSHOT`` rounds the shares are checkpointed."""
    spark, n_features = data.sparkSession, len(cuts)
    ensure_checkpoint_dir(spark)
    tasks = max(min(spark.sparkContext.defaultParallelism, -(-n_rows // local_rows)), -(-n_rows // TASK_ROWS))
    two, wide = [k for k, c in enumerate(cuts) if len(c) == 1], [k for k, c in enumerate(cuts) if len(c) != 1]
    cells = np.concatenate([np.arange(len(c) + 1) + k * n_bins for k, c in enumerate(cuts)])

    def share(rows) -> Iterator[_Share]:
        got = [(r.id, r.y, r.margin, bytes(r.bins)) for r in rows]
        if got:
            ids, y, margin, bins = zip(*got)
            yield _Share(np.array(ids), np.array(y), np.array(margin), np.frombuffer(b"".join(bins), np.uint8).reshape(-1, n_features), two, wide)

    shares, kept, out = data.repartition(tasks).rdd.mapPartitions(share), [], []
    for k in range(rounds):
        last = out[-1] if out else None
        shares = shares.map(lambda x, k=k, last=last: x.begin(channels, k, last)).persist(StorageLevel.MEMORY_AND_DISK)
        kept.append(shares)
        if k % SNAPSHOT == 0:
            shares.checkpoint()

        def ask(tree: Tree, asked: list[int]) -> np.ndarray:
            flat = tree.arrays()
            found = shares.map(lambda x: x.sums(flat, asked, n_bins, cells))
            return found.reduce(np.add) if tasks <= 64 else found.treeReduce(np.add)

        out.append(_grow_shared(ask, n_features, n_bins, cells, rule, k))
        while len(kept) > 1:
            kept.pop(0).unpersist()
    kept.pop().unpersist()
    return out


# ---------------------------------------------------------------------------
# Tables and models
# ---------------------------------------------------------------------------
def cut_points(df: DataFrame, n_features: int, bins: int = MAX_BINS) -> list[list[float]]:
    """At most ``bins - 1`` increasing cut points of each feature (an array column), from one
    sketch pass; a feature with fewer distinct values gets all of them."""
    shares = ", ".join(f"{k / bins!r}D" for k in range(1, bins))
    row = df.selectExpr(*[f"features[{k}] AS f{k}" for k in range(n_features)]).selectExpr(
        *[f"percentile_approx(f{k}, array({shares}), 10000) AS c{k}" for k in range(n_features)],
        *[f"max(f{k}) AS m{k}" for k in range(n_features)]).first()
    return [sorted({c for c in row[f"c{k}"] or [] if c < row[f"m{k}"]}) for k in range(n_features)]


def binned(df: DataFrame, cuts: list[list[float]], *keep: str) -> DataFrame:
    """(keep..., bins): the number of cut points below each feature's value, a byte each."""
    edges = [np.array(c) for c in cuts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column(len(keep)).to_pylist(), np.float64).reshape(b.num_rows, len(edges))
            out = np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], pa.array([r.tobytes() for r in out], pa.binary())],
                                             names=[*keep, "bins"])

    src = df.select(*keep, "features")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    return src.mapInArrow(run, f"{fields}, bins binary")


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_dir(df.sparkSession, f"trees/{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


class TreeModel:
    """Trees over binned features; ``kind`` is 'boosted' (margins add up) or 'forest'."""

    def __init__(self, kind: str, cuts: list[list[float]], trees: list[Tree]):
        self.kind, self.cuts, self.trees = kind, cuts, trees

    def probability(self, bins: np.ndarray) -> np.ndarray:
        return self._probability([t.arrays() for t in self.trees], bins)

    def _probability(self, trees: list[list[np.ndarray]], bins: np.ndarray) -> np.ndarray:
        total = sum((t[4][_leaves(t, bins)] for t in trees), np.zeros(len(bins)))
        return _sigmoid(total) if self.kind == "boosted" else total / len(trees)

    def transform(self, df: DataFrame, *keep: str) -> DataFrame:
        """(keep..., probability) of rows with a ``features`` array; one pass, no shuffle."""
        rows, me = binned(df, self.cuts, *keep), self
        n = len(self.cuts)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            flat = [t.arrays() for t in me.trees]  # once a task
            for b in batches:
                bins = np.frombuffer(b"".join(b.column(len(keep)).to_pylist()), np.uint8).reshape(-1, n)
                yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], pa.array(me._probability(flat, bins))], names=[*keep, "probability"])

        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
        return rows.mapInArrow(run, f"{fields}, probability double" if keep else "probability double")

    def to_json(self) -> str:
        return json.dumps({"kind": self.kind, "cuts": self.cuts, "trees": [vars(t) for t in self.trees]})

    @staticmethod
    def from_json(text: str) -> "TreeModel":
        d = json.loads(text)
        return TreeModel(d["kind"], d["cuts"], [Tree(**t) for t in d["trees"]])


class StoredForest(TreeModel):
    """A forest whose subtrees, rows (tree, node, subtree), stay in a table. ``tops`` are the parts
    above them: each row of ``below`` belongs in the place of a leaf."""

    def __init__(self, cuts: list[list[float]], tops: list[Tree], below: DataFrame | None):
        self.kind, self.cuts, self.tops, self.below = "forest", cuts, tops, below

    @functools.cached_property
    def trees(self) -> list[Tree]:
        """The whole trees, in the memory of the caller; scoring does not need them."""
        out = [Tree(**{c: list(x) for c, x in vars(t).items()}) for t in self.tops]
        for r in self.below.orderBy("tree", "node").toLocalIterator() if self.below is not None else ():
            out[r.tree].graft(r.node, Tree(**{c: x.tolist() for c, x in Tree.unpacked(r.asDict()).items()}))
        return out

    def transform(self, df: DataFrame, *keep: str) -> DataFrame:
        """(keep..., probability): rows are numbered and written, dealt to the subtrees their trees
        lead them to, and their values meet again by block of rows, added in the order of the trees."""
        rows = _written(binned(df, self.cuts, *keep).withColumn("_row", F.monotonically_increasing_id()), "rows")
        n = rows.count()
        step = max(1, min(len(self.tops), PASS_ROWS // max(n, 1)))
        if self.below is None or not n:
            return TreeModel(self.kind, self.cuts, self.tops).transform(df, *keep)
        totals, n_trees = None, len(self.tops)
        for k in range(0, len(self.tops), step):
            totals = _written(self._pass(rows, k, k + step, -(-n // SUBTREE_ROWS), totals), "totals")

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for ids, total in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(ids, np.int64)), pa.array(np.frombuffer(total) / n_trees)],
                                                     names=["_row", "probability"])

        scores = totals.select("block", "rows", "value").mapInArrow(each, "_row long, probability double")
        return rows.join(scores, "_row").select(*keep, "probability")

    def _pass(self, rows: DataFrame, first: int, end: int, parts: int, totals: DataFrame | None) -> DataFrame:
        """(block, rows, value): the totals so far and the values of the trees from ``first`` to ``end``."""
        flat = {t: self.tops[t].arrays() for t in range(first, min(end, len(self.tops)))}
        n = len(self.cuts)

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                ids = b.column(0).to_numpy(zero_copy_only=False)
                bins = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(-1, n)
                part = (ids >> BLOCK_BITS) % parts
                for t, top in flat.items():
                    key = _leaves(top, bins) * parts + part
                    order = np.argsort(key, kind="stable")
                    for k, own in zip(*_runs(key[order], order)):
                        yield pa.RecordBatch.from_arrays([pa.array([t]), pa.array([k // parts]), pa.array([k % parts]), *(
                            pa.array([x.tobytes()], pa.binary()) for x in (ids[own], bins[own]))], names=["tree", "node", "part", "rows", "bins"])

        def score(dealt: pa.Table, subtree: pa.Table) -> pa.Table:
            out = {"block": [], "tree": [], "rows": [], "value": []}
            if dealt.num_rows:
                t, node = dealt.column("tree")[0].as_py(), dealt.column("node")[0].as_py()
                ids, bins = (np.frombuffer(b"".join(dealt.column(c).to_pylist()), kind) for c, kind in (("rows", np.int64), ("bins", np.uint8)))
                if subtree.num_rows:
                    tree = list(Tree.unpacked({c: subtree.column(c)[0].as_py() for c in PACKED}).values())[:5]
                    value = tree[4][_leaves(tree, bins.reshape(-1, n))]
                else:
                    value = np.full(len(ids), flat[t][4][node])
                order = np.argsort(ids, kind="stable")
                for block, own in zip(*_runs(ids[order] >> BLOCK_BITS, order)):
                    for c, x in zip(out, (block, t, ids[own].tobytes(), value[own].tobytes())):
                        out[c].append(x)
            return pa.table(out, pa.schema([("block", pa.int64()), ("tree", pa.int64()), ("rows", pa.binary()), ("value", pa.binary())]))

        def add(group: pa.Table) -> pa.Table:
            parts = sorted(zip(*(group.column(c).to_pylist() for c in ("tree", "rows", "value"))), key=lambda x: x[0])
            ids = np.unique(np.concatenate([np.frombuffer(x, np.int64) for _, x, _ in parts]))
            total = np.zeros(len(ids))
            for _, own, value in parts:
                total[np.searchsorted(ids, np.frombuffer(own, np.int64))] += np.frombuffer(value)
            return pa.table({"block": group.column("block")[:1], "tree": pa.array([-1]), "rows": pa.array([ids.tobytes()], pa.binary()),
                             "value": pa.array([total.tobytes()], pa.binary())})

        dealt = rows.select("_row", "bins").mapInArrow(deal, "tree long, node long, part long, rows binary, bins binary")
        own = self.below.where((F.col("tree") >= first) & (F.col("tree") < end))
        own = own.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"))
        kind = "block long, tree long, rows binary, value binary"
        values = dealt.groupBy("tree", "node", "part").cogroup(own.groupBy("tree", "node", "part")).applyInArrow(score, kind)
        return (values if totals is None else totals.unionAll(values)).groupBy("block").applyInArrow(add, kind)


def with_features(df: DataFrame, *keep: str | Column) -> DataFrame:
    """The vector column ``features`` as an array of doubles."""
    return df.select(*keep, vector_to_array("features").alias("features"))


def _prepared(train: DataFrame, row_id: str, label: str, bins: int):
    n_features = len(train.select("features").first()[0])
    cuts = cut_points(train, n_features, bins)
    rows = binned(train.select(F.xxhash64(row_id).alias("id"), F.col(label).cast("double").alias("y"), F.lit(0.0).alias("margin"), "features"),
                  cuts, "id", "y", "margin")
    return _written(rows, "bins"), cuts, n_features, max(2, max(map(len, cuts), default=1) + 1)


def boosted(train: DataFrame, row_id: str, label: str = "label", rounds: int = 200, bins: int = MAX_BINS, rule: Rule = Rule(),
            scale_pos: float | None = None, local_rows: int = LOCAL_ROWS) -> TreeModel:
    """Second-order boosting of the log loss; ``scale_pos`` defaults to negatives / positives."""
    data, cuts, n_features, n_bins = _prepared(train, row_id, label, bins)
    pos, neg = data.agg(F.expr("count_if(y = 1)"), F.expr("count_if(y <> 1)")).first()
    scale = neg / max(pos, 1) if scale_pos is None else scale_pos

    def channels(tree, ids, y, margin):
        p, w = _sigmoid(margin), np.where(y == 1.0, scale, 1.0)
        return np.rint((p - y) * w * UNIT).astype(np.int64), np.maximum(np.rint(p * (1 - p) * w * UNIT), 1).astype(np.int64)

    if pos + neg <= local_rows:
        return TreeModel("boosted", cuts, _all_rounds(data, n_features, n_bins, rounds, rule, channels))
    return TreeModel("boosted", cuts, _shared_rounds(data, pos + neg, cuts, n_bins, rounds, rule, channels, local_rows))


def _all_rounds(data: DataFrame, n_features: int, n_bins: int, rounds: int, rule: Rule, channels: Channels) -> list[Tree]:
    """Every round of a table that fits one task, in one job; the same trees."""
    def run(group: pa.Table) -> pa.Table:
        ids, y, margin, bins = _rows(group, n_features)
        out = []
        for k in range(rounds):
            out.append(grow_local(bins, *channels(k, ids, y, margin), rule, n_bins, k, 1, 0))
            margin = margin + out[-1].predict(bins)
        return pa.table({"trees": [json.dumps([vars(t) for t in out])]})

    row = data.select("*", F.lit(0).alias("g")).groupBy("g").applyInArrow(lambda t: run(t.drop_columns("g")), "trees string").first()
    return [Tree(**t) for t in json.loads(row.trees)] if row else []


def _poisson(ids: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """Poisson(1) draws by hash of row and tree."""
    x = ids.astype(np.int64).view(np.uint64) ^ np.uint64((tree * 0x9E3779B97F4A7C15 + seed * 0xD1B54A32D192ED03) & (2 ** 64 - 1))
    for shift, mult in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(mult)
    u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)
    cdf = np.cumsum([np.exp(-1.0) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040)])
    return np.searchsorted(cdf, u, "right")


def forest(train: DataFrame, row_id: str, label: str = "label", trees: int = 200, bins: int = MAX_BINS, max_depth: int | None = None,
           bootstrap: bool = True, features: int | None = -1, balanced: bool = True, seed: int = 42, local_rows: int = LOCAL_ROWS) -> TreeModel:
    """A random forest of trees grown until their leaves are pure (or ``max_depth``). By
    default each node draws the square root of the number of features."""
    data, cuts, n_features, n_bins = _prepared(train, row_id, label, bins)
    pos, neg = data.agg(F.expr("count_if(y = 1)"), F.expr("count_if(y <> 1)")).first()
    n = pos + neg
    weight = {1.0: n / (2 * max(pos, 1)), 0.0: n / (2 * max(neg, 1))} if balanced else {1.0: 1.0, 0.0: 1.0}
    rule = Rule(l2=0.0, min_weight=0.0, max_depth=max_depth, negate=False,
                features=max(1, int(n_features ** 0.5)) if features == -1 else features, seed=seed)

    def channels(tree, ids, y, margin):
        w = np.where(y == 1.0, weight[1.0], weight[0.0]) * (_poisson(ids, tree, seed) if bootstrap else 1)
        h = np.rint(w * UNIT).astype(np.int64)
        return np.where(y == 1.0, h, 0), h

    out = [Tree() for _ in range(trees)]
    below = []
    for k in range(0, trees, BATCH):
        found = grow(data, n_features, n_bins, k, out[k:k + BATCH], n, rule, channels, local_rows=local_rows)
        if found is not None:
            below.append(_written(found, "subtrees"))
    return StoredForest(cuts, out, functools.reduce(DataFrame.unionAll, below) if below else None)
