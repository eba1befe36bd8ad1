"""Weakly and strongly connected components as join loops that store each step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsentry.operators.graph import nodes
from flowsentry.session import cut, discard


def _digest(df: DataFrame) -> tuple[int, int]:
    row = df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*df.columns)).alias("h")).first()
    return row.n, row.h or 0


def weak_components(edge_rows: DataFrame) -> DataFrame:
    """(account_id, component): smallest account id of the weak component."""
    ends = cut(edge_rows.select("src", "dst"))
    return nodes(ends).join(component_stars(ends), F.col("id") == F.col("u"), "left").select(
        F.col("id").alias("account_id"), F.coalesce("v", "id").alias("component")
    )


def component_stars(ends: DataFrame) -> DataFrame:
    """(u, v): every account of the stored links `ends` (src, dst) that is not the smallest of its weak component, and the smallest.

    Alternating large-star / small-star (Kiveris et al. 2014): O(log^2 n) rounds,
    and every group is reduced by `min` with map-side partials. A round leaves stars
    as they are, so none is run once the links are stars.
    """
    # a first small-star needs no distinct links and leaves far fewer where accounts share a neighbour
    links = ends.where(F.col("src") != F.col("dst")).select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    links = cut(_small_star(links))
    stored, _ = _digest(links)
    while stored and not _are_stars(links):
        last, links = links, cut(_small_star(_large_star(links)))
        discard(last)
    return links


def _are_stars(links: DataFrame) -> bool:
    """Whether every u of the distinct links (u, v < u) has one v that is no u itself."""
    ends = links.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("leaf")), F.struct(F.col("v").alias("id"), F.lit(0).alias("leaf")))).alias("e")).select("e.*")
    held = ends.groupBy("id").agg(F.sum("leaf").alias("up"), F.min("leaf").alias("leaf"))
    return held.where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("leaf") == 0))).isEmpty()


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("l")).select("l.*")
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def strong_components(edge_rows: DataFrame) -> DataFrame:
    """(account_id, component): largest account id of the strong component.

    Chains, trees and rings are contracted first: an account with a single predecessor (or a
    single successor) is bypassed, and joins its neighbour's component later if one of its other
    edges leads back there. A coin picks accounts that are not next to each other, so a chain or
    ring of n accounts is gone after O(log n) rounds, and a bypass never adds edges. What is left
    has two edges in and two out at every account. There each account takes the highest random
    rank that reaches it and the accounts that reach the rank's owner back are its component;
    edges between ranks are dropped, so one search serves all ranks and an expected O(log n)
    searches are needed. A search takes as many rounds as the paths of that dense rest are long.
    """
    live = cut(edge_rows.where(F.col("src") != F.col("dst")).select("src", "dst").distinct())
    steps: list[tuple[str, DataFrame]] = []
    turn = 0
    while True:
        live, turn = _contract(live, turn, steps)
        if live.isEmpty():
            break
        rank = _ranks(live, turn)
        members = _walk_back(live, rank)
        steps.append(("found", members))
        live = _inside(live, rank, members)
    discard(live)
    found = _expand(steps)
    all_nodes = nodes(edge_rows)
    if found is None:
        return all_nodes.select(F.col("id").alias("account_id"), F.col("id").alias("component"))
    # Accounts that no row names are alone, or the ones their component is named after.
    named = all_nodes.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    largest = named.groupBy("component").agg(F.max("id").alias("largest"))
    return named.join(largest, "component").select(F.col("id").alias("account_id"), F.col("largest").alias("component"))


def _contract(live: DataFrame, turn: int, steps: list[tuple[str, DataFrame]]) -> tuple[DataFrame, int]:
    """Drop accounts that no edge enters or leaves and bypass single-edged ones, until there are none of either."""
    none = F.lit(None).cast(live.schema["src"].dataType)
    while True:
        ends = F.array(
            F.struct(F.col("dst").alias("id"), F.col("src").alias("from"), none.alias("to")),
            F.struct(F.col("src").alias("id"), none.alias("from"), F.col("dst").alias("to")),
        )
        ends = live.select(F.explode(ends).alias("e")).select("e.*")
        degrees = cut(ends.groupBy("id").agg(F.count("from").alias("ins"), F.count("to").alias("outs"), F.min("from").alias("from"), F.min("to").alias("to")))
        has = degrees.agg(F.max(F.least("ins", "outs") == 0).alias("dead"), F.max(F.least("ins", "outs") == 1).alias("single")).first()
        if has.dead or has.single:
            former, live = live, _bypass(live, degrees, turn, steps)
            discard(former)
        discard(degrees)
        if not (has.dead or has.single):
            return live, turn
        turn += 1


def _bypass(live: DataFrame, degrees: DataFrame, turn: int, steps: list[tuple[str, DataFrame]]) -> DataFrame:
    """Take out accounts with one edge in (even turns) or out (odd turns) that are not next to each other.

    Their other edges move to the neighbour. Edges of accounts that nothing enters or leaves go as well.
    """
    near, far, count, only = ("src", "dst", "ins", "from") if turn % 2 == 0 else ("dst", "src", "outs", "to")
    single = degrees.where(F.col(count) == 1).select("id", F.col(only).alias("anchor"), (F.pmod(F.xxhash64(F.lit(turn), "id"), F.lit(2)) == 0).alias("heads"))
    beside = single.join(single.select(F.col("id").alias("anchor"), F.col("heads").alias("other_heads")), "anchor", "left")
    # All whose neighbour has more edges; of chains, heads next to tails that stay.
    sure = beside.where("other_heads is null").select(F.col("id").alias("anchor"))
    drawn = beside.where("heads and not other_heads").join(sure, "anchor", "left_anti")
    gone = cut(beside.where("other_heads is null").select("id", "anchor").unionByName(drawn.select("id", "anchor")))
    # An account that is taken out has its other edges at its near end; the single one has it at the far end.
    moved = cut(live.join(gone.withColumnRenamed("id", near), near).select(F.col(near).alias("id"), "anchor", F.col(far).alias("other")))
    after = live.join(gone.select(F.col("id").alias(near)), near, "left_anti").join(gone.select(F.col("id").alias(far)), far, "left_anti").select("src", "dst")
    after = after.unionByName(moved.where(F.col("anchor") != F.col("other")).select(F.col("anchor").alias(near), F.col("other").alias(far))).distinct()
    # A bypass gives no account its first edge in or out, so the dead ones are still dead.
    for end, edges in (("src", "ins"), ("dst", "outs")):
        after = after.join(degrees.where(F.col(edges) == 0).select(F.col("id").alias(end)), end, "left_anti")
    after = cut(after.select("src", "dst"))
    discard(gone)
    steps.append(("moved", moved))
    return after


def _ranks(live: DataFrame, turn: int) -> DataFrame:
    """(id, rank): the highest (hash, id) among the accounts that reach an account, itself included."""
    rank = cut(nodes(live).select("id", F.struct(F.xxhash64(F.lit(turn), "id").alias("h"), F.col("id").alias("root")).alias("rank")))
    before = _digest(rank)
    while True:
        incoming = live.join(rank, live.src == rank.id).select(F.col("dst").alias("id"), "rank")
        former, rank = rank, cut(rank.unionByName(incoming).groupBy("id").agg(F.max("rank").alias("rank")))
        after = _digest(rank)
        discard(former)
        if after == before:
            return rank
        before = after


def _same_rank(live: DataFrame, rank: DataFrame) -> DataFrame:
    at_src = rank.select(F.col("id").alias("src"), F.col("rank.root").alias("root"))
    at_dst = rank.select(F.col("id").alias("dst"), F.col("rank.root").alias("_root"))
    return live.join(at_src, "src").join(at_dst, "dst").where(F.col("root") == F.col("_root")).select("src", "dst", "root")


def _walk_back(live: DataFrame, rank: DataFrame) -> DataFrame:
    """(id, component): the accounts that reach the owner of their rank; only new ones are followed."""
    same = cut(_same_rank(live, rank))
    met = fresh = cut(rank.where(F.col("id") == F.col("rank.root")).select("id", F.col("id").alias("component")))
    while True:
        back = same.join(fresh, same.dst == fresh.id, "left_semi").select(F.col("src").alias("id"), F.col("root").alias("component")).distinct()
        fresh = cut(back.join(met, "id", "left_anti"))
        if fresh.isEmpty():
            discard(same)
            return met
        former, met = met, cut(met.unionByName(fresh))
        discard(former)


def _inside(live: DataFrame, rank: DataFrame, members: DataFrame) -> DataFrame:
    """Edges that may still lie on a cycle: both ends of one rank and in no component yet."""
    known = members.select("id")
    rest = _same_rank(live, rank).join(known.withColumnRenamed("id", "src"), "src", "left_anti").join(known.withColumnRenamed("id", "dst"), "dst", "left_anti")
    after = cut(rest.select("src", "dst"))
    for step in (live, rank):
        discard(step)
    return after


def _expand(steps: list[tuple[str, DataFrame]]) -> DataFrame | None:
    """(id, component) of searched and bypassed accounts, the last step first; an account without a row is named after itself."""
    known: DataFrame | None = None
    for kind, step in reversed(steps):
        rows = step
        if kind == "moved":
            if known is not None:
                names = [known.select(F.col("id").alias(c), F.col("component").alias(f"{c}_in")) for c in ("anchor", "other")]
                rows = rows.join(names[0], "anchor", "left").join(names[1], "other", "left")
                rows = rows.select("id", F.coalesce("anchor_in", "anchor").alias("component"), F.coalesce("other_in", "other").alias("back"))
            else:
                rows = rows.select("id", F.col("anchor").alias("component"), F.col("other").alias("back"))
            rows = rows.where(F.col("component") == F.col("back")).select("id", "component").distinct()
        former, known = known, cut(rows if known is None else known.unionByName(rows))
        discard(step)
        if former is not None:
            discard(former)
    return known
