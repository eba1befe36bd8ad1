"""PageRank as a join loop that stores each step, betweenness from start nodes dealt to tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsentry.functions.exprs import MONEY
from flowsentry.functions.segments import row_index
from flowsentry.operators.graph import nodes
from flowsentry.session import cut, discard

# Damping and tolerance of the centrality features.
DAMPING = 0.85
TOLERANCE = 1e-6
#: Links that a task may hold (8 bytes each), and links times start nodes from which it is worth it; other graphs are worked off in blocks of links.
HELD_LINKS, LEAST_WORK = 1 << 25, 1_000_000
#: Links times start nodes that are worth a task, tasks where the start nodes suffice, and at most.
TASK_WORK, LEAST_TASKS, MOST_TASKS = 4_000_000_000, 24, 2000
#: Cells (start node x account) that a task works on at a time, few enough for the processor's cache.
ROUND_CELLS = 1 << 17
#: Cells (start node x account) that one block of start nodes may reach.
BLOCK_ROWS = 200_000_000
#: Accounts of one block of links (at most 2**16: links are 16-bit places), and cells (start node x account) and start nodes of one task's share of a level.
SIDE, TASK_CELLS, TASK_STARTS = 6144, 4_000_000, 512
#: Blocks of (start nodes, accounts) that a level is cut into where these bounds allow it, and start nodes of one at least.
LEAST_BLOCKS, LEAST_STARTS = 64, 64
#: Whole numbers below this are exact as 32-bit floats.
EXACT = 1 << 24
#: Adding a link for a whole row of start nodes is so many times faster than for one of them.
ROW_GAIN = 6


def pagerank(
    edge_rows: DataFrame, damping: float = DAMPING, max_iter: int = 100, tol: float = TOLERANCE, iterations: int | None = None
) -> DataFrame:
    """(account_id, pagerank), amount-weighted, dangling mass spread evenly.

    Runs until the L1 change is below n * tol, or exactly `iterations` times.
    Raises if it does not converge in max_iter rounds.
    """
    out_weight = edge_rows.groupBy("src").agg(F.sum(F.col("weight").cast(MONEY)).cast("double").alias("total"))
    moves = cut(edge_rows.join(out_weight, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("p")))
    senders = out_weight.select(F.col("src").alias("id"), F.lit(False).alias("dangling"))
    base = cut(nodes(edge_rows).join(senders, "id", "left").select("id", F.coalesce("dangling", F.lit(True)).alias("dangling")))
    n = base.count()
    has_dangling = not base.where("dangling").isEmpty()
    ranks = base.withColumn("rank", F.lit(1.0 / n))
    for _ in range(iterations or max_iter):
        ranks, change = _rank_step(moves, base, ranks, n, damping, has_dangling, measure=iterations is None)
        if change is not None and change < n * tol:
            break
    else:
        if iterations is None:
            raise RuntimeError(f"ranks still move after {max_iter} rounds")
    return ranks.select(F.col("id").alias("account_id"), F.col("rank").alias("pagerank"))


def _rank_step(moves, base, ranks, n, damping, has_dangling, measure):
    gained = moves.join(ranks, moves.src == ranks.id).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("p")).alias("gain"))
    lost = F.lit(0.0)
    if has_dangling:
        lost = F.coalesce(ranks.where("dangling").agg(F.sum("rank")).scalar(), F.lit(0.0)) / F.lit(float(n))
    previous = ranks.select("id", F.col("rank").alias("old"))
    step = cut(
        base.join(gained, "id", "left")
        .join(previous, "id")
        .select("id", "dangling", "old", (F.lit(damping) * (F.coalesce("gain", F.lit(0.0)) + lost) + F.lit((1.0 - damping) / n)).alias("rank"))
    )
    change = step.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] if measure else None
    return step.drop("old"), change


def betweenness(edge_rows: DataFrame, pivots: int | None = None, seed: int = 42) -> DataFrame:
    """(account_id, betweenness_centrality): directed, unweighted, normalised.

    Brandes' algorithm. The start nodes are dealt to tasks. Every task holds the links and adds up the
    dependencies of its own start nodes, so no level is stored or shuffled. A graph of more than
    HELD_LINKS links, or a very small one, is worked off in steps over blocks of links instead
    (`_in_blocks`). Exact unless the caller asks for `pivots` sampled start nodes, which are scaled
    by n / pivots.
    """
    # accounts are numbered, so that a cell is one integer
    ids = cut(row_index(nodes(edge_rows), [F.col("id")], "no"))
    n = ids.count()
    links = cut(
        edge_rows.where(F.col("src") != F.col("dst"))
        .select(F.col("src").alias("a"), F.col("dst").alias("b"))
        .distinct()
        .join(ids.select(F.col("id").alias("a"), F.col("no").alias("src")), "a")
        .join(ids.select(F.col("id").alias("b"), F.col("no").alias("dst")), "b")
        .select("src", "dst")
    )
    sampled = pivots is not None and pivots < n
    starts = cut(row_index((ids.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(pivots) if sampled else ids).select("no"), [F.col("no")], "place"))
    used, held = pivots if sampled else n, links.count()
    if not held or not used:
        total = ids.select("no", F.lit(0.0).alias("delta")).limit(0)
    elif held <= HELD_LINKS and used * held >= LEAST_WORK:
        total = _in_tasks(starts, links, used, n, held)
    else:
        total = _in_blocks(starts, links, used, n)
    scale = (1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0) * (n / used if used else 1.0)
    return ids.join(total, "no", "left").select(F.col("id").alias("account_id"), (F.coalesce("delta", F.lit(0.0)) * F.lit(scale)).alias("betweenness_centrality"))


# --- start nodes dealt to tasks that hold the links --------------------------------


def _in_tasks(starts: DataFrame, links: DataFrame, used: int, n: int, held: int) -> DataFrame:
    """(no, delta): dependencies of all start nodes, summed."""
    side = -(-n // max(1, -(-n // SIDE)))
    both = links.select(F.explode(F.array(F.struct(F.lit(True).alias("out"), F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.lit(False).alias("out"), F.col("dst").alias("a"), F.col("src").alias("b")))).alias("l")).select("l.*")
    lists = cut(both.withColumn("part", _part("a", side)).groupBy("out", "part").applyInPandas(_pack_lists(side, n), "out boolean, part int, sizes binary, ends binary"))
    tasks = min(max(1, used // LEAST_STARTS), MOST_TASKS, max(LEAST_TASKS, used * held // TASK_WORK))
    # near numbers go to different tasks; one row and one partition a task
    dealt = starts.groupBy((F.col("place") % tasks).alias("t")).agg(F.collect_list("no").alias("starts")).repartitionByRange(tasks, "t")
    sums = dealt.crossJoin(F.broadcast(lists)).mapInArrow(_add_up(n), "no long, delta double")
    return cut(sums.groupBy("no").agg(F.sum("delta").alias("delta")))


def _pack_lists(side: int, n: int):
    def pack(key, rows: pd.DataFrame) -> pd.DataFrame:
        out, part = key
        rows = rows.sort_values(["a", "b"])
        sizes = np.bincount(rows.a.to_numpy() - part * side, minlength=min(side, n - part * side))
        return pd.DataFrame({"out": [out], "part": [part], "sizes": [sizes.astype(np.int32).tobytes()], "ends": [rows.b.to_numpy(np.int32).tobytes()]})

    return pack


class _Lists:
    """The other ends of the links of each account, in one direction."""

    def __init__(self, parts: dict[int, tuple[bytes, bytes]], side: int, n: int):
        self.sizes = np.zeros(n, np.int64)
        for part, (sizes, _) in parts.items():
            own = np.frombuffer(sizes, np.int32)
            self.sizes[part * side : part * side + len(own)] = own
        self.ends = np.concatenate([np.frombuffer(parts[part][1], np.int32) for part in sorted(parts)])
        self.begins = np.cumsum(self.sizes) - self.sizes

    def of(self, cells: np.ndarray, nodes: np.ndarray, several: bool) -> tuple[np.ndarray, np.ndarray]:
        """(number of links of each cell, the cells at their other ends one after another)."""
        sizes = self.sizes[nodes]
        before = np.cumsum(sizes) - sizes
        ends = self.ends[np.repeat(self.begins[nodes] - before, sizes) + np.arange(sizes.sum())]
        return sizes, ends + np.repeat(cells - nodes, sizes) if several else ends


def _sum_runs(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of so many values."""
    out, some = np.zeros(len(sizes)), np.flatnonzero(sizes)
    if len(some):
        out[some] = np.add.reduceat(values, (np.cumsum(sizes) - sizes)[some])
    return out


def _add_up(n: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every start row comes once with each part of the links."""
        parts: dict[bool, dict[int, tuple[bytes, bytes]]] = {True: {}, False: {}}
        tasks: dict[int, np.ndarray] = {}
        for batch in batches:
            for i in range(len(batch)):
                t, out, part = (batch.column(c)[i].as_py() for c in ("t", "out", "part"))
                if t not in tasks:
                    tasks[t] = np.asarray(batch.column("starts")[i].values)
                if part not in parts[out]:
                    parts[out][part] = tuple(batch.column(c)[i].as_py() for c in ("sizes", "ends"))
        if tasks:
            side = -(-n // max(1, -(-n // SIDE)))
            delta = _dependencies_of(np.concatenate(list(tasks.values())), _Lists(parts[True], side, n), _Lists(parts[False], side, n), n)
            some = np.flatnonzero(delta)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(delta[some])], ["no", "delta"])

    return run


def _dependencies_of(starts: np.ndarray, out: _Lists, into: _Lists, n: int) -> np.ndarray:
    """Dependencies on every account, summed over the start nodes.

    A cell is (start node of the round) * n + account. A level goes the way that meets fewer links:
    along the links of its cells, or against the links of the cells it may reach.
    """
    total, width = np.zeros(n), max(1, ROUND_CELLS // n)
    for first in range(0, len(starts), width):
        own = starts[first : first + width]
        several, cells = len(own) > 1, len(own) * n
        front = np.arange(len(own)) * n + own
        sigma, seen = np.zeros(cells), np.zeros(cells, bool)
        sigma[front], seen[front] = 1.0, True
        levels, ways = [front], []
        behind = len(own) * int(into.sizes.sum()) - int(into.sizes[own].sum())  # links into cells not yet seen
        while behind > 0:
            nodes = front % n
            if out.sizes[nodes].sum() <= behind:
                sizes, ends = out.of(front, nodes, several)
                ways.append((sizes, ends))
                paths = np.bincount(ends, np.repeat(sigma[front], sizes), cells)
                paths[seen] = 0.0
                found = np.flatnonzero(paths)
                sigma[found] = paths[found]
            else:
                ways.append(None)
                here = np.zeros(cells)
                here[front] = sigma[front]
                left = np.flatnonzero(~seen)
                sizes, ends = into.of(left, left % n, several)
                paths = _sum_runs(here[ends], sizes)
                found = left[paths > 0]
                sigma[found] = paths[paths > 0]
            if not len(found):
                break
            seen[found] = True
            behind -= int(into.sizes[found % n].sum())
            levels.append(found)
            front = found
        share = np.zeros(cells)
        share[levels[-1]] = 1.0 / sigma[levels[-1]]
        for depth in range(len(levels) - 2, 0, -1):
            here, below = levels[depth], levels[depth + 1]
            nodes = here % n
            if ways[depth] is not None or out.sizes[nodes].sum() <= into.sizes[below % n].sum():
                sizes, ends = ways[depth] or out.of(here, nodes, several)
                gained = _sum_runs(share[ends], sizes)
            else:
                sizes, ends = into.of(below, below % n, several)
                gained = np.bincount(ends, np.repeat(share[below], sizes), cells)[here]
            delta = gained * sigma[here]
            share[below] = 0.0
            share[here] = (1.0 + delta) / sigma[here]
            total += np.bincount(nodes, delta, n)
    return total


# --- steps over blocks of links ----------------------------------------------------


def _in_blocks(starts: DataFrame, links: DataFrame, used: int, n: int) -> DataFrame:
    """(no, delta): dependencies of all start nodes, summed.

    The links are cut into blocks by account, a level into blocks of (start nodes, accounts); one
    grouped step per breadth-first level multiplies the level by the blocks of links forwards, one
    gathers backwards, and a group holds only the links into (or out of) its accounts. Start nodes
    are worked off in blocks whose sums are added, so that no table holds a cell for every pair of
    accounts; the levels of a block are deleted when its sums are stored.
    """
    parts = max(1, -(-n // SIDE))
    side = max(1, -(-n // parts))
    packed = cut(
        links.select(_part("src", side).alias("k"), _part("dst", side).alias("j"), (F.col("src") % side).cast("int").alias("s"), (F.col("dst") % side).cast("int").alias("d"))
        .groupBy("k", "j")
        .applyInPandas(_pack_links, "k int, j int, src binary, dst binary")
    )
    size = max(1, BLOCK_ROWS // max(n, 1))
    sums = []
    for a in range(0, used, size):
        deltas, stored = _dependencies(starts.where((F.col("place") >= a) & (F.col("place") < a + size)), packed, a, min(size, used - a), n, side, parts)
        sums.append(cut(deltas))
        for table in stored:
            discard(table)
    return reduce(DataFrame.unionByName, sums).groupBy(F.col("node").alias("no")).agg(F.sum("delta").alias("delta"))


def _part(no: str, side: int):
    return F.floor(F.col(no) / side).cast("int")


_LEVEL = "p int, j int, found long, cells binary, sigma binary, seen binary"
_BACK = "p int, j int, cells binary, share binary, sums array<double>"


def _input(df: DataFrame, kind: str, k: str | None, x: str, y: str | None, **by) -> DataFrame:
    none = F.lit(None).cast("binary")
    return df.select(
        by.get("p", F.col("p")).alias("p"), by.get("j", F.col("j")).alias("j"), F.lit(kind).alias("kind"), (F.col(k) if k else F.lit(-1)).alias("k"),
        F.col(x).alias("x"), (F.col(y) if y else none).alias("y"),
    )


def _dependencies(starts: DataFrame, links: DataFrame, first: int, used: int, n: int, side: int, parts: int) -> tuple[DataFrame, list[DataFrame]]:
    """(node, delta): dependencies of a block of start nodes, summed; and the tables that this reads."""
    spark = links.sparkSession
    width = min(TASK_STARTS, max(LEAST_STARTS, -(-used * parts // LEAST_BLOCKS)), max(1, TASK_CELLS // max(n, 1)))
    blocks = -(-used // width)
    tasks = min(2000, blocks * parts)
    every = spark.range(blocks).select(F.col("id").cast("int").alias("p"))
    sides = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    place = F.col("place") - first
    levels = [
        cut(
            starts.select(F.floor(place / width).cast("int").alias("p"), _part("no", side).alias("j"), ((place % width) * side + F.col("no") % side).cast("int").alias("cell"))
            .groupBy("p", "j")
            .applyInPandas(_pack_starts(width * side), _LEVEL)
        )
    ]

    def step(rows: list[DataFrame], grow, schema: str) -> DataFrame:
        # a fixed number of partitions: the rows are few bytes and much work
        united = reduce(DataFrame.unionByName, rows).repartition(tasks, "p", "j")
        return cut(united.groupBy("p", "j").applyInPandas(grow, schema))

    into = _input(links.crossJoin(F.broadcast(every)), "links", "k", "src", "dst")
    unseen = used * n - used
    # the last frontier is the widest: do not expand it when every account is reached
    while unseen > 0:
        last = levels[-1]
        frontier = _input(last.where("found > 0").select("p", F.col("j").alias("k"), "cells", "sigma", sides.alias("j")), "level", "k", "cells", "sigma")
        seen = _input(last.where("seen is not null"), "seen", None, "seen", None)
        fresh = step([into, frontier, seen], _forward(width, side), _LEVEL)
        found = fresh.agg(F.sum("found")).first()[0] or 0
        if found == 0:
            discard(fresh)
            break
        unseen -= found
        levels.append(fresh)

    out_of = _input(links.crossJoin(F.broadcast(every)), "links", "j", "src", "dst", j=F.col("k"))
    stored = list(levels)
    below, kind, deltas = None, "ends", [spark.range(0).select(F.col("id").alias("node"), F.lit(0.0).alias("delta"))]
    for depth in range(len(levels) - 1, 0, -1):
        here = _input(levels[depth].where("found > 0"), "here", None, "cells", "sigma")
        if below is None:
            # nothing depends on the last level: its share is 1 / sigma, which the next step divides itself
            below = levels[depth].where("found > 0").select("p", "j", "cells", F.col("sigma").alias("share"))
            continue
        shares = _input(below.select("p", F.col("j").alias("k"), "cells", "share", sides.alias("j")), kind, "k", "cells", "share")
        kind = "shares"
        below = step([out_of, here, shares], _backward(width, side), _BACK)
        stored.append(below)
        spread = below.select("j", F.posexplode("sums").alias("at", "delta")).where("delta <> 0")
        deltas.append(spread.groupBy((F.col("j").cast("long") * side + F.col("at")).alias("node")).agg(F.sum("delta").alias("delta")))
    return reduce(DataFrame.unionByName, deltas).groupBy("node").agg(F.sum("delta").alias("delta")), stored


def _pack_cells(cells: np.ndarray, size: int) -> bytes:
    """Ascending cells of a block of `size` as 32-bit numbers, or as a bitmap if that is no longer."""
    if 4 * len(cells) < -(-size // 8):
        return cells.astype(np.int32).tobytes()
    held = np.zeros(size, bool)
    held[cells] = True
    return np.packbits(held).tobytes()


def _unpack_cells(packed: bytes, size: int) -> np.ndarray:
    if len(packed) < -(-size // 8):
        return np.frombuffer(packed, np.int32)
    return np.flatnonzero(np.unpackbits(np.frombuffer(packed, np.uint8), count=size)).astype(np.int32)


def _pack_paths(sigma: np.ndarray) -> bytes:
    """Numbers of paths in as few bytes as hold them exactly; they are whole numbers of at least 1."""
    most = sigma.max(initial=0)
    for kind in (np.uint8, np.uint16, np.uint32):
        if most <= np.iinfo(kind).max:
            return sigma.astype(kind).tobytes()
    return sigma.tobytes()


def _unpack_paths(packed: bytes, cells: int) -> np.ndarray:
    kind = {1: np.uint8, 2: np.uint16, 4: np.uint32}.get(len(packed) // max(cells, 1), np.float64)
    return np.frombuffer(packed, kind).astype(np.float64)


def _pack_links(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["s", "d"])
    return pd.DataFrame({"k": rows.k.iloc[:1], "j": rows.j.iloc[:1], "src": [rows.s.to_numpy(np.uint16).tobytes()], "dst": [rows.d.to_numpy(np.uint16).tobytes()]})


def _pack_starts(size: int):
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        cells = np.sort(rows.cell.to_numpy(np.int32))
        return pd.DataFrame({"p": rows.p.iloc[:1], "j": rows.j.iloc[:1], "found": len(cells), "cells": [_pack_cells(cells, size)], "sigma": [_pack_paths(np.ones(len(cells)))], "seen": [None]})

    return pack


class _Block:
    """Links of a pair of account blocks, sorted by source; places are numbers inside the blocks."""

    def __init__(self, src: bytes | np.ndarray, dst: bytes | np.ndarray, side: int):
        self.src, self.dst = np.frombuffer(src, np.int32), np.frombuffer(dst, np.int32)
        self.begins = np.searchsorted(self.src, np.arange(side + 1))

    def of(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """(place in `nodes`, link) of the links that leave them; None if they are so many that all are read faster."""
        sizes = self.begins[nodes + 1] - self.begins[nodes]
        total = int(sizes.sum())
        if total * 4 > len(self.src):
            return None
        place = np.repeat(np.arange(len(nodes)), sizes)
        return place, np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(self.begins[nodes], sizes)

    def busy(self, level: _Level) -> bool:
        """Whether a level reaches so many of the links that adding whole rows of start nodes is faster."""
        return int((self.begins[level.nodes + 1] - self.begins[level.nodes]).sum()) * ROW_GAIN > len(self.src) * level.width

    def most(self, level: _Level) -> float:
        """No account gets more paths from a level than this."""
        return float(level.values.max(initial=0.0)) * int(np.bincount(self.dst, minlength=1).max())

    def forward(self, rows: np.ndarray, out: np.ndarray) -> None:
        """Add to the row of every account in `out` the rows of those that link to it."""
        at = np.argsort(self.dst.astype(np.uint16), kind="stable")
        _add_rows(rows, self.src[at], np.searchsorted(self.dst[at], np.arange(len(out) + 1)), out)

    def backward(self, rows: np.ndarray, out: np.ndarray) -> None:
        """Add to the row of every account in `out` the rows of those it links to."""
        _add_rows(rows, self.dst, self.begins, out)


def _add_rows(rows: np.ndarray, other: np.ndarray, begins: np.ndarray, out: np.ndarray) -> None:
    """Rows of 32-bit floats hold whole numbers with sums below EXACT, so the order in which they are added is free."""
    sizes, other = np.diff(begins), other.astype(np.intp)
    held = np.empty((sizes.max(initial=0), rows.shape[1]), rows.dtype)
    ones = np.ones(len(held), rows.dtype)
    for node in np.flatnonzero(sizes):
        picked = rows.take(other[begins[node] : begins[node + 1]], 0, out=held[: sizes[node]], mode="clip")
        out[node] += ones[: len(picked)] @ picked if rows.dtype == np.float32 else np.add.reduce(picked, 0)


class _Level:
    """Cells (start node, account) of a level with a value each, by start node."""

    def __init__(self, cells: bytes | np.ndarray, values: bytes | np.ndarray, width: int, side: int):
        self.flat, self.width, self.side = np.frombuffer(cells, np.int32), width, side
        self.values, self.nodes = np.frombuffer(values, np.float64), self.flat % side
        self.bounds = np.searchsorted(self.flat, np.arange(width + 1) * side)

    def row(self, pivot: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.bounds[pivot], self.bounds[pivot + 1]
        return self.nodes[a:b], self.values[a:b]

    def rows(self, kind: type = np.float64) -> np.ndarray:
        """The level as a row of start nodes for every account."""
        dense = np.zeros(self.width * self.side, kind)
        dense[self.flat] = self.values
        return np.ascontiguousarray(dense.reshape(self.width, self.side).T)


def _read(rows: pd.DataFrame, width: int, side: int) -> tuple[dict, dict]:
    """Levels and blocks of links of a group by the block at their other side."""
    levels = {r.k: _unpack(r, width, side) for r in rows[rows.kind.isin(["level", "shares", "ends"])].itertuples()}
    places = lambda packed: np.frombuffer(packed, np.uint16).astype(np.int32)
    return levels, {r.k: _Block(places(r.x), places(r.y), side) for r in rows[rows.kind == "links"].itertuples() if r.k in levels}


def _unpack(row, width: int, side: int) -> _Level:
    """Paths, shares, or (kind "ends") the shares 1 / paths of the last level."""
    cells = _unpack_cells(row.x, width * side)
    if row.kind == "shares":
        return _Level(cells, row.y, width, side)
    paths = _unpack_paths(row.y, len(cells))
    return _Level(cells, 1.0 / paths if row.kind == "ends" else paths, width, side)


def _forward(width: int, side: int):
    def grow(key, rows: pd.DataFrame) -> pd.DataFrame:
        """The next level of a block of start nodes inside one block of accounts."""
        p, j = key
        levels, blocks = _read(rows, width, side)
        old = [np.frombuffer(r.x, np.uint8) for r in rows[rows.kind == "seen"].itertuples()]
        seen = np.unpackbits(old[0], count=width * side).astype(bool) if old else np.zeros(width * side, bool)
        if j in levels:
            seen[levels[j].flat] = True
        kind = np.float32 if sum(block.most(levels[k]) for k, block in blocks.items()) < EXACT else np.float64
        whole, few = np.zeros((side, width), kind), {}
        for k, block in blocks.items():
            if block.busy(levels[k]):
                block.forward(levels[k].rows(kind), whole)
            else:
                few[k] = block
        whole = np.ascontiguousarray(whole.T)
        for k, block in few.items():
            for pivot in range(width):
                nodes, values = levels[k].row(pivot)
                if not len(nodes):
                    continue
                some = block.of(nodes)
                if some is None:
                    dense = np.zeros(side)
                    dense[nodes] = values
                    whole[pivot] += np.bincount(block.dst, dense[block.src], side)
                else:
                    whole[pivot] += np.bincount(block.dst[some[1]], values[some[0]], side)
        paths = whole.ravel()
        found = np.flatnonzero((paths > 0) & ~seen)
        return pd.DataFrame({"p": [p], "j": [j], "found": [len(found)], "cells": [_pack_cells(found, width * side)], "sigma": [_pack_paths(paths[found])], "seen": [np.packbits(seen).tobytes()]})

    return grow


def _backward(width: int, side: int):
    def gather(key, rows: pd.DataFrame) -> pd.DataFrame:
        """(1 + delta) / sigma of a level from that of the next one, and the deltas summed by account."""
        p, j = key
        here = [_unpack(r, width, side) for r in rows[rows.kind == "here"].itertuples()]
        if not here:
            return pd.DataFrame({c: pd.Series(dtype=object) for c in ("p", "j", "cells", "share", "sums")})
        level = here[0]
        levels, blocks = _read(rows, width, side)
        whole, few = np.zeros((side, width)), {}
        for k, block in blocks.items():
            if block.busy(level):
                block.backward(levels[k].rows(), whole)
            else:
                few[k] = block
        delta = np.ascontiguousarray(whole.T).ravel()[level.flat]
        for k, block in few.items():
            for pivot in range(width):
                nodes, _ = level.row(pivot)
                below, values = levels[k].row(pivot)
                if not len(below) or not len(nodes):
                    continue
                dense = np.zeros(side)
                dense[below] = values
                some = block.of(nodes)
                own = slice(level.bounds[pivot], level.bounds[pivot + 1])
                if some is None:
                    delta[own] += np.bincount(block.src, dense[block.dst], side)[nodes]
                else:
                    delta[own] += np.bincount(some[0], dense[block.dst[some[1]]], len(nodes))
        delta *= level.values
        share = ((1.0 + delta) / level.values).tobytes()
        return pd.DataFrame({"p": [p], "j": [j], "cells": [_pack_cells(level.flat, width * side)], "share": [share], "sums": [np.bincount(level.nodes, delta, side)]})

    return gather
