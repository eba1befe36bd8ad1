"""Short closed walks and triangles without materialising two-paths through hubs.

diag(A^2) + diag(A^3) + diag(A^4) is assembled from loops, reciprocal pairs,
triangles and 4-cycles. Edges point from the lower to the higher degree end, so
triangle wedges start at their lowest-degree corner and 4-cycle wedges have a
middle that is below their apex. Both enumerate O(m^1.5) wedges at worst; the
neighbours of a hub are never paired with each other.
"""

from __future__ import annotations

from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsentry.functions.exprs import flag
from flowsentry.functions.segments import row_index
from flowsentry.operators.graph import nodes
from flowsentry.session import cut

#: Classes of accounts: at least so many, and so many pairs per two classes that meet. Wedges formed at a time.
LEAST_CLASSES, CLASS_PAIRS, WEDGES = 6, 140_000, 2_000_000


def _ranked_accounts(edge_rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, loop, rank): accounts numbered by (undirected degree, id)."""
    loops = edge_rows.where(F.col("src") == F.col("dst")).select(F.col("src").alias("id"), F.lit(1).cast("long").alias("loop"))
    degree = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("deg"))
    info = (
        nodes(edge_rows)
        .join(degree, "id", "left")
        .join(loops, "id", "left")
        .select("id", F.coalesce("deg", F.lit(0).cast("long")).alias("deg"), F.coalesce("loop", F.lit(0).cast("long")).alias("loop"))
    )
    return row_index(info, [F.col("deg"), F.col("id")], "rank").select("id", "loop", "rank")


def _ranked_pairs(pairs: DataFrame, accounts: DataFrame) -> DataFrame:
    """Undirected pairs oriented low -> high rank, with direction and loop flags.

    Ranks are longs, so wedges shuffle and compare integers instead of account ids.
    """
    a, b = (accounts.select(F.col("id").alias(x), F.col("rank").alias(f"{x}_rank"), F.col("loop").alias(f"{x}_loop")) for x in "ab")
    full = pairs.join(a, "a").join(b, "b")
    low_is_a = F.col("a_rank") < F.col("b_rank")

    def pick(when_a: str, when_b: str):
        return F.when(low_is_a, F.col(when_a)).otherwise(F.col(when_b))

    return full.select(
        pick("a_rank", "b_rank").alias("lo"),
        pick("b_rank", "a_rank").alias("hi"),
        pick("ab", "ba").alias("up"),
        pick("ba", "ab").alias("down"),
        pick("a_loop", "b_loop").alias("lo_loop"),
        pick("b_loop", "a_loop").alias("hi_loop"),
    )


def _pairs(edge_rows: DataFrame) -> DataFrame:
    """(a < b, ab, ba): undirected pairs with the directions that exist."""
    plain = edge_rows.where(F.col("src") != F.col("dst"))
    forward = F.col("src") < F.col("dst")
    return plain.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(
        F.max(F.when(forward, 1).otherwise(0)).alias("ab"), F.max(F.when(~forward, 1).otherwise(0)).alias("ba")
    )


def _closed(pairs: DataFrame) -> DataFrame:
    """Per account: directed 4-cycles through four different accounts, directed 3-cycles, their loop-weighted sum, the S^3 weight.

    A wedge apex, mid, end has its middle and its end below the apex. Wedges are not shuffled: apexes
    and ends are cut into classes by rank, and the neighbour lists of each middle go to the groups
    (class of apexes, class of ends), where the wedges are formed and met by (apex, end).
    """
    classes = max(LEAST_CLASSES, ceil(sqrt(pairs.count() / CLASS_PAIRS)))
    halves = F.array(
        F.struct(F.col("lo").alias("mid"), F.col("hi").alias("end"), F.col("up").alias("fwd"), F.col("down").alias("bwd"), F.col("lo_loop").alias("loop"), F.col("hi_loop").alias("end_loop")),
        F.struct(F.col("hi").alias("mid"), F.col("lo").alias("end"), F.col("down").alias("fwd"), F.col("up").alias("bwd"), F.col("hi_loop").alias("loop"), F.col("lo_loop").alias("end_loop")),
    )
    both = pairs.select(F.explode(halves).alias("e")).select("e.*")
    packed = F.col("end") * 8 + F.col("end_loop") * 4 + F.col("fwd") * 2 + F.col("bwd")
    above = F.col("end") > F.col("mid")
    arms = both.where(above).groupBy("mid", "loop", (F.col("end") % classes).cast("int").alias("high")).agg(F.collect_list(packed).alias("apexes"))
    # every middle is listed in its own class too, without an edge: that group closes its triangles
    own = both.where(above).select("mid", F.col("mid").alias("end"), (F.col("mid") * 8).alias("packed")).distinct()
    listed = both.select("mid", "end", packed.alias("packed")).unionByName(own)
    ends = listed.groupBy("mid", (F.col("end") % classes).cast("int").alias("low")).agg(F.collect_list("packed").alias("ends"))
    sent = arms.join(ends, "mid").repartition(classes * classes, "high", "low")
    sums = ["four_cycles", "tri_cycles", "tri_loops", "tri_product"]
    found = sent.groupBy("high", "low").applyInArrow(_meet(classes), "id long, " + ", ".join(f"{c} long" for c in sums))
    return found.groupBy("id").agg(*[F.sum(c).alias(c) for c in sums])


def _numbered(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order and the place of each among them; codes that lie close are marked rather than sorted."""
    least = codes.min() if len(codes) else 0
    span = int(codes.max() - least) + 1 if len(codes) else 0
    if span > 8 * len(codes):
        return np.unique(codes, return_inverse=True)
    held = np.zeros(span, bool)
    held[codes - least] = True
    return np.flatnonzero(held) + least, (np.cumsum(held) - 1)[codes - least]


def _meet(classes: int):
    def lists(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of each value, first value of each row, values) of a column of lists."""
        whole = column.combine_chunks()
        sizes = np.diff(whole.offsets.to_numpy())
        return np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes, whole.flatten().to_numpy()

    def summed(ids: list[np.ndarray], parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct ids and the sums of their rows of four numbers."""
        names, at = _numbered(np.concatenate(ids))
        rows = np.concatenate(parts)
        out = np.zeros((len(names), 4), np.int64)
        for c in range(4):
            np.add.at(out[:, c], at, rows[:, c])
        return names, out

    def meet(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        high, low = key[0].as_py(), key[1].as_py()
        mid, loop = table.column("mid").to_numpy(), table.column("loop").to_numpy()
        arm_row, _, arms = lists(table.column("apexes"))
        end_row, end_first, ends = lists(table.column("ends"))
        n_ends = np.bincount(end_row, minlength=len(mid))
        arms_at = np.argsort(arms, kind="stable")
        arms, arm_row = arms[arms_at], arm_row[arms_at]
        apex = arms >> 3
        # accounts by their place, so that (apex, end) is one number; apexes of a class lie `classes` apart
        names = np.unique(ends >> 3)
        end_at = np.searchsorted(names, ends >> 3)
        # pairs of an apex and an end, from the rows whose middle is itself such an end
        direct = np.flatnonzero(mid[arm_row] % classes == low)
        joined = apex[direct] // classes * len(names) + np.searchsorted(names, mid[arm_row[direct]])
        order = np.argsort(joined)
        joined, joined_bits = joined[order], arms[direct][order] & 3
        bounds = np.flatnonzero(np.concatenate([[True], apex[1:] != apex[:-1]])) if len(apex) else np.zeros(0, np.int64)
        upto = np.concatenate([[0], np.cumsum(n_ends[arm_row])])
        ids, parts = [np.zeros(0, np.int64)], [np.zeros((0, 4), np.int64)]
        start = 0
        while start < len(bounds):
            # whole apexes, at least one: its wedges are no more than the ends of the group
            stop = max(start + 1, int(np.searchsorted(upto[bounds], upto[bounds[start]] + WEDGES, "right")) - 1)
            a, b = bounds[start], bounds[stop] if stop < len(bounds) else len(apex)
            start = stop
            size = n_ends[arm_row[a:b]]
            arm = np.repeat(np.arange(a, b), size)
            end = np.arange(len(arm)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(end_first[arm_row[a:b]], size)
            below = (ends[end] >> 3 < apex[arm]) & (ends[end] >> 3 != mid[arm_row[arm]])
            arm, end = arm[below], end[below]
            if not len(arm):
                continue
            row = arm_row[arm]
            codes, at = _numbered(apex[arm] // classes * len(names) + end_at[end])
            to_apex, from_apex, fwd, bwd = arms[arm] >> 1 & 1, arms[arm] & 1, ends[end] >> 1 & 1, ends[end] & 1
            out, back = from_apex * fwd, bwd * to_apex
            n_out, n_back, n_both = (np.bincount(at, w, len(codes)).astype(np.int64) for w in (out, back, out * back))
            cycles = n_out * n_back - n_both
            through = out * (n_back[at] - back) + back * (n_out[at] - out)

            def add(who: np.ndarray, *columns: np.ndarray | int) -> None:
                names_of, sums = summed([who], [np.stack([np.broadcast_to(c, len(who)) for c in columns], 1)])
                ids.append(names_of)
                parts.append(sums)

            for who, n in ((codes // len(names) * classes + high, cycles), (names[codes % len(names)], cycles), (mid[row], through)):
                some = n > 0
                add(who[some], n[some], 0, 0, 0)
            # triangles once: the end is the lowest corner
            found = np.searchsorted(joined, codes)
            closes = np.zeros(len(codes), bool)
            if len(joined):
                found = np.minimum(found, len(joined) - 1)
                closes = joined[found] == codes
            tri = np.flatnonzero(closes[at] & (ends[end] >> 3 < mid[row]))
            bits = joined_bits[found[at[tri]]] if len(tri) else np.zeros(0, np.int64)
            xz, zx, yz, zy, yx, xy = bits >> 1, bits & 1, to_apex[tri], from_apex[tri], fwd[tri], bwd[tri]
            cyclic = xy * yz * zx + xz * zy * yx
            product = (xy + yx) * (yz + zy) * (xz + zx)
            corners = ((apex[arm[tri]], arms[arm[tri]] >> 2 & 1), (mid[row[tri]], loop[row[tri]]), (ends[end[tri]] >> 3, ends[end[tri]] >> 2 & 1))
            loops = sum(c[1] for c in corners)
            for who, own in corners:
                add(who, 0, cyclic, cyclic * (loops + own), product)
        who, sums = summed(ids, parts)
        return pa.table({"id": who, **{c: sums[:, k] for k, c in enumerate(("four_cycles", "tri_cycles", "tri_loops", "tri_product"))}})

    return meet


def _reciprocal(pairs: DataFrame) -> DataFrame:
    """Per account: reciprocal partners and the sums over them that closed walks need."""
    mutual = pairs.where((F.col("up") == 1) & (F.col("down") == 1))
    links = mutual.select(
        F.explode(
            F.array(
                F.struct(F.col("lo").alias("id"), F.col("hi").alias("other"), F.col("hi_loop").alias("other_loop")),
                F.struct(F.col("hi").alias("id"), F.col("lo").alias("other"), F.col("lo_loop").alias("other_loop")),
            )
        ).alias("l")
    ).select("l.*")
    partners = links.groupBy("id").agg(F.count(F.lit(1)).alias("mutual"), F.sum("other_loop").alias("mutual_loops"))
    second = (
        links.join(partners.select(F.col("id").alias("other"), (F.col("mutual") - 1).alias("further")), "other")
        .groupBy("id")
        .agg(F.sum("further").alias("mutual_further"))
    )
    return partners.join(second, "id", "left")


def motif_features(edge_rows: DataFrame) -> DataFrame:
    """cycle_count, short-cycle flags and directed clustering coefficient per account."""
    unranked = cut(_pairs(edge_rows))
    accounts = cut(_ranked_accounts(edge_rows, unranked))
    pairs = cut(_ranked_pairs(unranked, accounts))
    pair_degree = (
        pairs.select(F.explode(F.array("lo", "hi")).alias("id"), (F.col("up") + F.col("down")).alias("d"), (F.col("up") * F.col("down")).alias("m"))
        .groupBy("id")
        .agg(F.sum("d").alias("deg_total"), F.sum("m").alias("deg_mutual"))
    )
    joined = (
        accounts.select(F.col("id").alias("account_id"), F.col("rank").alias("id"), "loop")
        .join(pair_degree, "id", "left")
        .join(_reciprocal(pairs), "id", "left")
        .join(_closed(pairs), "id", "left")
        .na.fill(0)
    )
    loop, mutual = F.col("loop"), F.col("mutual")
    walks2 = mutual + loop
    walks3 = F.col("tri_cycles") + loop + 2 * loop * mutual + F.col("mutual_loops")
    walks4 = (
        F.col("four_cycles")
        + mutual * mutual
        + F.col("mutual_further")
        + F.col("tri_loops")
        + 3 * loop * mutual + 2 * loop * F.col("mutual_loops") + F.col("mutual_loops")
        + loop
    )
    total = (walks2 + walks3 + walks4).cast("long")
    wedge_count = F.col("deg_total") * (F.col("deg_total") - 1) - 2 * F.col("deg_mutual")
    return joined.select(
        "account_id",
        total.alias("cycle_count"),
        flag(total > 0).alias("is_in_short_cycle"),
        flag(total > 0).alias("short_cycle_indicator"),
        F.when(F.col("tri_product") > 0, F.col("tri_product") / wedge_count).otherwise(F.lit(0.0)).alias("clustering_coefficient"),
    )
