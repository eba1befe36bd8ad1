"""Gradient boosting on histograms, all settings of a grid grown in step over one binned table.

Features are cut into at most 256 bins once. A level of a tree costs one pass for the whole grid: each
task sums first and second derivatives of its rows by (setting, node, feature, bin), the sums meet
by (setting, node), and the best split of every node reaches the driver, a row each. Rows carry no
state between passes but the margins of a table that is rewritten every few trees; what came since
is applied on the fly. A tree's sample of rows is drawn by a hash of the account, so a lost task
draws the same rows again.

Splits maximise the second-order gain with an L2 penalty on leaf values; both children need a least
sum of second derivatives.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsentry.session import cut, discard

BINS = 256
#: Relative error of the quantiles that bound the bins.
BIN_ERROR = 1e-3
#: Trees between two rewrites of the margins.
REWRITE = 10
L2 = 1.0
#: Rounds without a better validation loss after which a setting stops.
PATIENCE = 15
#: Least rows of a task, and bytes of sums that tasks may send to the driver; more meet in a shuffle.
TASK_ROWS, DRIVER_BYTES = 1 << 16, 1 << 26

_SPLIT = "setting int, node int, feature int, bin int, gain double, g double, h double, left_g double, left_h double"


@dataclass(frozen=True)
class Setting:
    """One point of a grid."""

    depth: int
    rate: float
    rounds: int
    child_weight: float
    rows: float
    columns: float


# The grid that a fit searches.
GRID = (
    Setting(4, 0.05, 150, 3, 0.8, 0.7),
    Setting(3, 0.05, 200, 5, 0.8, 0.8),
    Setting(6, 0.03, 150, 3, 0.7, 0.7),
    Setting(4, 0.10, 100, 5, 0.8, 0.8),
)


@dataclass
class Tree:
    """Nodes as arrays; a leaf has feature -1. `bin` and `threshold` say the same: left holds values up to it."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    threshold: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])
    cover: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def add(self) -> int:
        for name, blank in (("feature", -1), ("bin", 0), ("threshold", 0.0), ("left", -1), ("right", -1), ("value", 0.0), ("cover", 0.0), ("gain", 0.0)):
            getattr(self, name).append(blank)
        return len(self.feature) - 1

    def node_of(self, x: np.ndarray, binned: bool = False) -> np.ndarray:
        """The leaf of each row of values, or of bins."""
        feature, left, right = np.array(self.feature), np.array(self.left), np.array(self.right)
        bound = np.array(self.bin if binned else self.threshold)
        at, every = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        while True:
            f = feature[at]
            inner = f >= 0
            if not inner.any():
                return at
            at = np.where(inner, np.where(x[every, np.maximum(f, 0)] <= bound[at], left[at], right[at]), at)

    def leaves_of(self, bins: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, which of `rows` fall into it, in their order); `bins` has a line of bins per column."""
        waiting = [(0, rows)]
        while waiting:
            node, rows = waiting.pop()
            f = self.feature[node]
            if f < 0:
                yield node, rows
                continue
            goes = bins[f][rows] <= self.bin[node]
            waiting += [(self.left[node], rows[goes]), (self.right[node], rows[~goes])]

    def add_values(self, bins: np.ndarray, margin: np.ndarray) -> None:
        """Add the leaf value of every row to its margin."""
        for leaf, rows in self.leaves_of(bins, np.arange(len(margin))):
            margin[rows] += self.value[leaf]


@dataclass
class BoostedTrees:
    """A fitted model: the margin is `base` plus the leaf values of all trees."""

    columns: list[str]
    base: float
    trees: list[Tree]

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            out += np.array(tree.value)[tree.node_of(x)]
        return out

    def with_margin(self, df: DataFrame, name: str = "margin") -> DataFrame:
        """Add the margin of each row; a missing value counts as 0, as in training."""

        @F.pandas_udf("double")
        def margin(x: pd.Series) -> pd.Series:
            return pd.Series(self.margins(np.stack(x.to_numpy())) if len(x) else np.zeros(0))

        return df.withColumn(name, margin(_values(self.columns)))

    def with_probability(self, df: DataFrame) -> DataFrame:
        scored = self.with_margin(df, "_margin")
        return scored.withColumn("probability_1", 1 / (1 + F.exp(-F.col("_margin")))).drop("_margin")

    def leaves(self) -> list[tuple[float, dict]]:
        """(value, {feature: [low, high, share of the cover]}) of every leaf."""
        found = []

        def walk(tree: Tree, node: int, path: dict) -> None:
            f = tree.feature[node]
            if f < 0:
                found.append((tree.value[node], path))
                return
            low, high, kept = path.get(f, (-math.inf, math.inf, 1.0))
            for child, bounds in ((tree.left[node], (low, min(high, tree.threshold[node]))), (tree.right[node], (max(low, tree.threshold[node]), high))):
                share = tree.cover[child] / tree.cover[node] if tree.cover[node] else 0.0
                walk(tree, child, {**path, f: (*bounds, kept * share)})

        for tree in self.trees:
            walk(tree, 0, {})
        return found

    def importances(self) -> list[float]:
        """Share of each column in the gain of all splits."""
        total = np.zeros(len(self.columns))
        for tree in self.trees:
            for f, gain in zip(tree.feature, tree.gain):
                if f >= 0:
                    total[f] += gain
        return (total / (total.sum() or 1.0)).tolist()

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, self.columns, self.base, *[getattr(t, n) for n in _NODE]) for i, t in enumerate(self.trees)] or [(-1, self.columns, self.base, *[[] for _ in _NODE])]
        kinds = ", ".join(f"{n} array<{'double' if n in ('threshold', 'value', 'cover', 'gain') else 'int'}>" for n in _NODE)
        spark.createDataFrame(rows, f"tree int, columns array<string>, base double, {kinds}").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BoostedTrees:
        rows = spark.read.parquet(path).orderBy("tree").collect()  # bounded by the model's size
        return cls(list(rows[0]["columns"]), rows[0].base, [Tree(**{n: list(r[n]) for n in _NODE}) for r in rows if r.tree >= 0])


_NODE = ("feature", "bin", "threshold", "left", "right", "value", "cover", "gain")


def _values(columns: list[str]):
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])


def bin_edges(df: DataFrame, columns: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Upper bounds of all bins but the last, per column, from approximate quantiles."""
    filled = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"c{i}") for i, c in enumerate(columns)])
    found = filled.approxQuantile([f"c{i}" for i in range(len(columns))], [k / bins for k in range(1, bins)], BIN_ERROR)
    return [np.unique(np.array(q, dtype=float)) for q in found]


def _binned(split: DataFrame, columns: list[str], edges: list[np.ndarray]) -> DataFrame:
    """(key, held, y, w, bins): a hash of the account, whether the row is held out, label, weight, one byte a column."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(4).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), len(columns))
            bins = np.stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)], axis=1).astype(np.uint8) if len(columns) else np.zeros((len(batch), 0), np.uint8)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([r.tobytes() for r in bins], pa.binary())], ["key", "held", "y", "w", "bins"])

    rows = split.select(F.xxhash64("account_id").alias("key"), (F.col("fold") == "validation").alias("held"), F.col("_y").cast("double").alias("y"), F.col("_w").cast("double").alias("w"), _values(columns).alias("x"))
    return rows.mapInArrow(run, "key long, held boolean, y double, w double, bins binary")


def _drawn(key: np.ndarray, share: float, seed: int, setting: int, tree: int) -> np.ndarray:
    """Whether each row is in a tree's sample."""
    x = key.view(np.uint64) + np.uint64((seed * 1_000_003 + setting * 65_537 + tree + 1) * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) < np.uint64(min(share, 1.0) * (2.0**64 - 2048))


@dataclass
class _Growing:
    """A setting on its way: its finished trees, the tree in work, its losses."""

    setting: Setting
    number: int
    trees: list[Tree] = field(default_factory=list)
    written: int = 0  # trees that are in the stored margins
    losses: list[float] = field(default_factory=list)
    done: bool = False

    def best_round(self) -> int:
        return int(np.argmin(self.losses))


def _joined(column: pa.Array) -> memoryview:
    """The bytes of all values of a binary column without nulls."""
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32)
    return memoryview(data)[int(ends[column.offset]) : int(ends[column.offset + len(column)])] if data is not None else memoryview(b"")


def _columns_first(column: pa.Array, n_columns: int) -> np.ndarray:
    """The bins of the rows, a line per column."""
    return np.ascontiguousarray(np.frombuffer(_joined(column), np.uint8).reshape(len(column), n_columns).T)


def _open_sums(n_columns: int, grown: list[tuple], base: float, seed: int, with_loss: bool, allowed: dict[int, np.ndarray]):
    """Task function: (setting, node, sums) of the rows it sees; node -1 carries the validation loss.

    `grown` holds (setting number, place of its margin, trees to apply, tree in work, open nodes, sample share, tree number).
    Columns that a setting's tree may not split on are left out, but for the first, whose sums are the node's.
    """
    used = {number: sorted({0, *np.flatnonzero(columns).tolist()}) for number, columns in allowed.items()} if n_columns else dict.fromkeys(allowed, [])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            key, held, y, w = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            bins = _columns_first(batch.column(4), n_columns)
            stored = np.frombuffer(_joined(batch.column(5)), dtype=float).reshape(len(batch), -1) if batch.num_columns > 5 else None
            for number, place, trees, tree, nodes, share, count in grown:
                margin = np.full(len(batch), base) if stored is None else stored[:, place].copy()
                for t in trees:
                    t.add_values(bins, margin)
                p = 1 / (1 + np.exp(-margin))
                if with_loss and held.any():
                    q = np.clip(p[held], 1e-15, 1 - 1e-15)
                    loss = -(w[held] * (y[held] * np.log(q) + (1 - y[held]) * np.log(1 - q))).sum()
                    sums[number, -1] = sums.get((number, -1), np.zeros(2)) + np.array([loss, w[held].sum()])
                rows = np.flatnonzero(~held & _drawn(key, share, seed, number, count))
                g, h = w * (p - y), w * p * (1 - p)
                # a column at a time for all open nodes; the rows of a node keep their order, so its sums are those of a node alone
                at = [(nodes.index(leaf), some) for leaf, some in tree.leaves_of(bins, rows) if leaf in nodes]
                rows = np.concatenate([some for _, some in at]) if at else rows[:0]
                first = np.repeat(np.array([k for k, _ in at], np.intp) * BINS, [len(some) for _, some in at])
                both = np.zeros((len(nodes), 2, n_columns, BINS))
                g, h = g[rows], h[rows]
                for f in used[number]:
                    cell = first + bins[f][rows]
                    for k, v in enumerate((g, h)):
                        both[:, k, f] = np.bincount(cell, v, len(nodes) * BINS).reshape(-1, BINS)
                for k, node in enumerate(nodes):
                    sums[number, node] = sums.get((number, node), 0) + both[k]
        names, part = list(sums), TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.array([n[0] for n in names], pa.int32()), pa.array([n[1] for n in names], pa.int32()), pa.array([part] * len(names), pa.int32()), pa.array([np.ascontiguousarray(sums[n]).tobytes() for n in names], pa.binary())],
            ["setting", "node", "part", "sums"],
        )

    return run


def _best_splits(n_columns: int, allowed: dict[int, np.ndarray], child_weight: dict[int, float]):
    """Task function: adds up the sums of each (setting, node) and finds its best split."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for setting, node, _, raw in zip(*(c.to_pylist() for c in batch.columns)):
                total[setting, node] = total.get((setting, node), 0) + np.frombuffer(raw, dtype=float)
        out = []
        for (setting, node), raw in total.items():
            if node < 0:
                out.append((setting, node, -1, 0, 0.0, raw[0], raw[1], 0.0, 0.0))
                continue
            g, h = raw.reshape(2, n_columns, BINS)
            all_g, all_h = float(g[0].sum()), float(h[0].sum())
            left_g, left_h = g.cumsum(axis=1)[:, :-1], h.cumsum(axis=1)[:, :-1]
            right_g, right_h = all_g - left_g, all_h - left_h
            gain = left_g**2 / (left_h + L2) + right_g**2 / (right_h + L2) - all_g**2 / (all_h + L2)
            least = child_weight[setting]
            open_ = (left_h >= least) & (right_h >= least) & allowed[setting][:, None]
            gain = np.where(open_, gain, -np.inf)
            f, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
            good = bool(np.isfinite(gain[f, b]) and gain[f, b] > 1e-9)
            out.append((setting, node, int(f) if good else -1, int(b), float(gain[f, b]) if good else 0.0, all_g, all_h, float(left_g[f, b]), float(left_h[f, b])))
        kinds = (*[pa.int32()] * 4, *[pa.float64()] * 5)
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], [c.split()[0] for c in _SPLIT.split(", ")])

    return run


def fit_grid(split: DataFrame, columns: list[str], label: str, grid=GRID, seed: int = 42, patience: int = PATIENCE) -> list[tuple[Setting, BoostedTrees, list[float]]]:
    """(setting, model, validation loss per round) of every setting, each cut at its best round.

    `split` has account_id, the columns, the label and `fold`; rows of the folds "train" and
    "validation" count, those without a label do not. Positive rows weigh as many times more as they
    are rarer in the training fold. A setting stops when `patience` rounds brought no lower
    validation loss; without validation rows it runs all its rounds. A training fold of one class
    or no rows gives a model without trees.
    """
    spark = split.sparkSession
    used = split.where(F.col(label).isNotNull() & F.col("fold").isin("train", "validation")).withColumn("_y", F.col(label))
    counts = used.where("fold = 'train'").agg(F.count_if(F.col("_y") == 1).alias("p"), F.count_if(F.col("_y") == 0).alias("q")).first()
    if not counts.p or not counts.q:
        base = 0.0 if counts.p == counts.q else math.copysign(10.0, counts.p - counts.q)
        return [(s, BoostedTrees(list(columns), base, []), []) for s in grid]
    ratio = max(1.0, counts.q / counts.p)
    base = math.log(ratio * counts.p / counts.q)
    used = used.withColumn("_w", F.when(F.col("_y") == 1, ratio).otherwise(1.0))
    edges = bin_edges(used.where("fold = 'train'"), columns)
    size = used.count()
    rows = cut(_binned(used, columns, edges).coalesce(max(1, math.ceil(size / TASK_ROWS)))).persist()
    held = size > counts.p + counts.q
    growing = [_Growing(s, i) for i, s in enumerate(grid)]
    n = len(columns)

    def sums(grown: list[tuple], source: DataFrame, with_loss: bool, allowed: dict) -> dict[tuple[int, int], tuple]:
        parts = source.mapInArrow(_open_sums(n, grown, base, seed, with_loss, allowed), "setting int, node int, part int, sums binary")
        find = _best_splits(n, allowed, {g.number: g.setting.child_weight for g in growing})
        # In the order of parts, so that sums of doubles come out alike in every run.
        order = ["setting", "node", "part"]
        if tasks * sum(len(x[4]) for x in grown) * n * BINS * 16 <= DRIVER_BYTES:
            best = pa.Table.from_batches(find(parts.toArrow().sort_by([(c, "ascending") for c in order]).to_batches())).to_pylist()
        else:
            best = [r.asDict() for r in parts.repartition("setting", "node").sortWithinPartitions(*order).mapInArrow(find, _SPLIT).collect()]
        return {(r["setting"], r["node"]): r for r in best}  # a row per open node of the grid

    tasks = rows.rdd.getNumPartitions()
    for round_ in range(max(s.rounds for s in grid) + 1):
        if round_ and round_ % REWRITE == 0 and any(not g.done for g in growing):
            fresh = cut(_with_margins(rows, growing, base, n)).persist()
            rows.unpersist()
            discard(rows)
            rows, tasks = fresh, fresh.rdd.getNumPartitions()
            for g in growing:
                g.written = len(g.trees)
        live = [g for g in growing if not g.done]
        if not live:
            break
        work = {g.number: Tree() for g in live}
        open_nodes = {g.number: [0] for g in live}
        sampled = {g.number: _columns_of(n, g.setting.columns, seed, g.number, round_) for g in live}
        for level in range(max(g.setting.depth for g in live)):
            grown = [
                (g.number, g.number, g.trees[g.written :], work[g.number], open_nodes[g.number], g.setting.rows, round_)
                for g in live if open_nodes[g.number] and not g.done
            ]
            if not grown:
                break
            found = sums(grown, rows, level == 0 and held, sampled)
            for g in live:
                if level == 0 and held and (g.number, -1) in found:
                    loss = found[g.number, -1]
                    g.losses.append(loss["g"] / loss["h"])
                    if len(g.losses) - 1 - g.best_round() >= patience:
                        g.done = True
                if len(g.trees) >= g.setting.rounds:
                    g.done = True
                if g.done:
                    continue
                tree, further = work[g.number], []
                for node in open_nodes[g.number]:
                    r = found.get((g.number, node))
                    if r is None:
                        continue
                    tree.cover[node], tree.value[node] = r["h"], -g.setting.rate * r["g"] / (r["h"] + L2)
                    f, b = r["feature"], r["bin"]
                    if f < 0 or b >= len(edges[f]):
                        continue
                    tree.feature[node], tree.bin[node], tree.threshold[node], tree.gain[node] = f, b, float(edges[f][b]), r["gain"]
                    for side, own_g, own_h in (("left", r["left_g"], r["left_h"]), ("right", r["g"] - r["left_g"], r["h"] - r["left_h"])):
                        child = tree.add()
                        getattr(tree, side)[node] = child
                        tree.cover[child], tree.value[child] = own_h, -g.setting.rate * own_g / (own_h + L2)
                        further.append(child)
                # Children's values are known from their parent; only levels that may split are summed.
                open_nodes[g.number] = further if level + 1 < g.setting.depth else []
        for g in live:
            if not g.done:
                g.trees.append(work[g.number])
    rows.unpersist()
    discard(rows)
    return [(g.setting, BoostedTrees(list(columns), base, g.trees[: g.best_round()] if g.losses else g.trees), g.losses) for g in growing]


def _columns_of(n: int, share: float, seed: int, setting: int, tree: int) -> np.ndarray:
    """The columns that a tree may split on."""
    chosen = np.zeros(n, dtype=bool)
    chosen[np.random.default_rng([seed, setting, tree]).permutation(n)[: max(1, int(n * share))]] = True
    return chosen


def _with_margins(rows: DataFrame, growing: list[_Growing], base: float, n: int) -> DataFrame:
    """The binned rows with the margin of every setting as doubles, those that are stored already carried on."""
    models = [g.trees[g.written :] for g in growing]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = _columns_first(batch.column(4), n)
            out = np.full((len(batch), len(models)), base)
            if batch.num_columns > 5:
                out = np.frombuffer(_joined(batch.column(5)), dtype=float).reshape(len(batch), -1).copy()
            for k, trees in enumerate(models):
                for t in trees:
                    t.add_values(bins, out[:, k])
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array([r.tobytes() for r in out], pa.binary())], [*batch.schema.names[:5], "margins"])

    return rows.mapInArrow(run, "key long, held boolean, y double, w double, bins binary, margins binary")
