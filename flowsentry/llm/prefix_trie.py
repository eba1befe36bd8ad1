"""Prefix trie of conversations by truncation peeling.

A conversation is a path: one entry of 32 bytes per turn (digest of role and text, and the
text's length), so texts never leave the scan and the last turn is stripped by a substring.
The trie is found from its deepest level upwards. At each level the conversations that end there
are merged with the nodes that survive from below, which gives the level's nodes with all their
aggregates; then each node loses its last turn and goes on as one row of its parent's group.

Levels down to `SHALLOW` are one aggregation each. Deeper levels are worked off in bands whose
upper borders double: rows that agree up to the band's upper border are one subtree, and a subtree
of bounded size is peeled level by level inside one task. One that is larger goes by the same
aggregations as the shallow levels. So a very long conversation costs a few rounds, not one per
turn, and no group of unbounded size is collected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsentry.session import cut

#: Bytes of a path entry: digest, then the text's length.
DIGEST, ENTRY = 24, 32
#: Most turns that a conversation takes over from the first one of its group of GROUP.
HEAD_TURNS, GROUP = 8, 5
#: Levels that are always aggregated one by one.
SHALLOW = 8
#: Turns of a subtree that is peeled inside one task (32 bytes each); one of so few rows is peeled there whatever their length.
SUBTREE_TURNS, FEW_ROWS = 1 << 16, 16
#: Neighbouring ids (powers of two) whose list is made at once.
LIST_BITS = 10

_EMPTY = hashlib.sha256(b"").hexdigest()
_NODE = "key binary, parent binary, conv_id long, depth int, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
#: What goes from level to level: a path and the sums of all that hangs below it.
_ROW = "path binary, at int, n long, conv long, kids long, leaves long, saved long, ends string"
_LISTED = "path binary, n long, conv long, ends string"


def turn_entries(turns: DataFrame) -> DataFrame:
    """(conv_id, entries): the entries of each conversation in order.

    Turns go in ascending order, a null turn first, equal ones by digest. A null role or text is
    empty. Rows without a conv_id belong to no conversation. Repeated rows are turns of their own.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    size = F.unhex(F.lpad(F.hex(F.octet_length(text).cast("long")), 16, "0"))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", F.concat(F.substring(digest, 1, DIGEST), size).alias("entry")).alias("e"))
    return rows.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("e")), lambda e: e["entry"]).alias("entries"))


def rebuilt_paths(turns: DataFrame) -> DataFrame:
    """(conv_id, path): every conversation behind the first turns of the conversation that leads its group.

    Conversation c takes the first h = crc32(c in decimal) % 9 turns of conversation c - c % 5 (all if
    it has fewer, none if it is absent) in place of its own first h.
    """
    own = cut(turn_entries(turns))
    first = own.where(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("first_id"), F.slice("entries", 1, HEAD_TURNS).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEAD_TURNS + 1)).cast("int")
    joined = own.select("conv_id", "entries", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % GROUP).alias("first_id")).join(first, "first_id", "left")
    nothing = F.array().cast("array<binary>")
    whole = F.concat(F.coalesce(F.expr("slice(head, 1, h)"), nothing), F.expr("slice(entries, h + 1, greatest(size(entries) - h, 0))"))
    return joined.select("conv_id", F.unhex(F.array_join(F.transform(whole, F.hex), "")).alias("path"))


def _list_digests(paths: DataFrame) -> DataFrame:
    """(path, n, conv, ends): the conversations of each whole path, their least id and the digest of their ids in ascending order, comma-joined.

    Lists are made of neighbouring ids, a bounded number at a time; a digest reads the lists of its
    path one after the other.
    """
    lists = paths.groupBy("path", F.shiftright("conv_id", LIST_BITS).alias("part")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    lists = lists.select("path", "part", F.size("ids").cast("long").alias("n"), F.col("ids")[0].alias("conv"), F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("list"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, digest, n, conv = None, None, 0, 0
        for batch in batches:
            done = []
            for this, _, count, least, some in zip(*(c.to_pylist() for c in batch.columns)):
                if this != path:
                    if path is not None:
                        done.append((path, n, conv, digest.hexdigest()))
                    path, digest, n, conv = this, hashlib.sha256(some.encode()), count, least
                else:
                    digest.update(b"," + some.encode())
                    n += count
            yield _table(done, _LISTED)
        if path is not None:
            yield _table([(path, n, conv, digest.hexdigest())], _LISTED)

    return lists.repartition("path").sortWithinPartitions("path", "part").mapInArrow(run, _LISTED)


_KINDS = {"binary": pa.binary(), "int": pa.int32(), "long": pa.int64(), "string": pa.string()}


def _table(rows: list[tuple], columns: str) -> pa.RecordBatch:
    named = [c.split() for c in columns.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], _KINDS[kind]) for k, (_, kind) in enumerate(named)], [name for name, _ in named])


def _key(path: Column) -> Column:
    return F.unhex(F.md5(path))


def _level(rows: DataFrame, depth: int) -> DataFrame:
    """(path, key, ...): the nodes of one level, from the rows (`_ROW`) that end or survive there."""
    last = F.conv(F.hex(F.substring("path", (depth - 1) * ENTRY + DIGEST + 1, ENTRY - DIGEST)), 16, 10).cast("long") if depth else F.lit(0).cast("long")
    nodes = rows.groupBy("path").agg(
        F.sum("n").alias("n"), F.min("conv").alias("conv"), F.sum("kids").alias("kids"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("below"), F.max("ends").alias("ends")
    )
    return nodes.select(
        "path", F.lit(depth).alias("at"), "n", "conv", "kids", F.when(F.col("kids") == 0, F.lit(1)).otherwise(F.col("leaves")).cast("long").alias("leaves"),
        (F.col("below") + (F.col("n") - 1) * last).alias("saved"), F.coalesce("ends", F.lit(_EMPTY)).alias("ends"),
    )


def _emitted(nodes: DataFrame) -> DataFrame:
    parent = F.when(F.col("at") > 0, _key(F.expr(f"substring(path, 1, (at - 1) * {ENTRY})")))
    return nodes.select(
        _key(F.col("path")).alias("key"), parent.alias("parent"), F.col("conv").alias("conv_id"), F.col("at").alias("depth"), F.col("n").alias("n_convs"), F.col("kids").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"),
    )


def _stripped(nodes: DataFrame) -> DataFrame:
    """The nodes without their last turn, as rows of the level above."""
    return nodes.select(
        F.expr(f"substring(path, 1, (at - 1) * {ENTRY})").alias("path"), (F.col("at") - 1).alias("at"), "n", "conv", F.lit(1).cast("long").alias("kids"), "leaves", "saved",
        F.lit(None).cast("string").alias("ends"),
    )


def _peel(rows: list[tuple], low: int) -> tuple[list[tuple], list[tuple]]:
    """(nodes, survivors) of one subtree: all its levels deeper than `low`, from the deepest up."""
    waiting: dict[int, list[list]] = {}
    for path, depth, n, conv, kids, leaves, saved, ends in rows:
        seen, keys = hashlib.md5(path[: low * ENTRY]), {low: None}
        keys[low] = seen.digest()
        for d in range(low, depth):
            seen.update(path[d * ENTRY : (d + 1) * ENTRY])
            keys[d + 1] = seen.copy().digest()
        waiting.setdefault(depth, []).append([path, keys, n, conv, kids, leaves, saved, ends])
    nodes: list[tuple] = []
    for depth in range(max(waiting), low, -1):
        level: dict[bytes, list] = {}
        for row in waiting.pop(depth, []):
            node = level.setdefault(row[1][depth], [row[0], row[1], 0, row[3], 0, 0, 0, None])
            node[3] = min(node[3], row[3])
            for k in (2, 4, 5, 6):
                node[k] += row[k]
            node[7] = node[7] or row[7]
        for key, (path, keys, n, conv, kids, leaves, saved, ends) in level.items():
            leaves = leaves if kids else 1
            saved += (n - 1) * int.from_bytes(path[depth * ENTRY - (ENTRY - DIGEST) : depth * ENTRY], "big")
            nodes.append((key, keys[depth - 1], conv, depth, n, kids, leaves, saved, ends or _EMPTY))
            waiting.setdefault(depth - 1, []).append([path, keys, n, conv, 1, leaves, saved, None])
    return nodes, [(path[: low * ENTRY], low, n, conv, kids, leaves, saved, None) for path, _, n, conv, kids, leaves, saved, _ in waiting[low]]


def _peeled_subtrees(rows: DataFrame, low: int) -> DataFrame:
    """(survivor, node columns, row columns): nodes and survivors of subtrees that stand together, one after another."""
    both, n_node, n_row = f"{_NODE}, {_ROW}", len(_NODE.split(",")), len(_ROW.split(","))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, some = None, []

        def out() -> pa.RecordBatch:
            nodes, survivors = _peel(some, low)
            return _table([(*x, *(None,) * n_row) for x in nodes] + [(*(None,) * n_node, *x) for x in survivors], both)

        for batch in batches:
            for prefix, *values in zip(*(c.to_pylist() for c in batch.columns)):
                if prefix != group and some:
                    yield out()
                    some = []
                group = prefix
                some.append(tuple(values))
        if some:
            yield out()

    return rows.mapInArrow(run, both)


def prefix_trie(turns: DataFrame, shallow: int = SHALLOW, subtree_turns: int = SUBTREE_TURNS) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): one row per node of the rebuilt conversations' trie.

    `turns` holds (conv_id, turn, role, text); conversations are rebuilt as in `rebuilt_paths`, ties and
    nulls as in `turn_entries`. A node is named by its least member and its depth; the root has depth
    0, no text and no parent. saved_tokens sums (n_convs - 1) x bytes of the last text over the subtree.
    A conversation rebuilt without turns ends in the root. An empty table has no nodes; other
    columns are not read. A conversation's path (32 bytes a turn) is one value.
    """
    ended = _list_digests(cut(rebuilt_paths(turns)))
    zero = F.lit(0).cast("long")
    ended = cut(ended.select("path", (F.octet_length("path") / ENTRY).cast("int").alias("at"), "n", "conv", zero.alias("kids"), zero.alias("leaves"), zero.alias("saved"), "ends"))
    deepest = ended.agg(F.max("at")).first()[0] or 0
    bands = [0, shallow]
    while bands[-1] < deepest:
        bands.append(2 * bands[-1])
    found: list[DataFrame] = []
    survivors: DataFrame | None = None  # of the band below
    for low, high in reversed(list(zip(bands, bands[1:]))):
        rows = ended.where((F.col("at") > low) & (F.col("at") <= high))
        rows = rows if survivors is None else rows.unionByName(survivors)
        if not low:
            survivors = _levels(rows, 0, min(high, deepest), found)
            break
        prefixed = cut(rows.select(F.sha2(F.substring("path", 1, low * ENTRY), 256).alias("prefix"), *rows.columns))
        # Rows that agree up to the band's border are one subtree. Large ones go level by level.
        load = prefixed.groupBy("prefix").agg(F.sum("at").alias("turns"), F.count(F.lit(1)).alias("rows"))
        large = cut(load.where((F.col("turns") > subtree_turns) & (F.col("rows") > FEW_ROWS)).select("prefix"))
        none_large = large.isEmpty()
        small = prefixed if none_large else prefixed.join(large, "prefix", "left_anti")
        done = cut(_peeled_subtrees(small.repartition("prefix").sortWithinPartitions("prefix"), low))
        found.append(done.where("key is not null").select(*[c.split()[0] for c in _NODE.split(", ")]))
        survivors = done.where("key is null").select(*[c.split()[0] for c in _ROW.split(", ")])
        if not none_large:
            survivors = survivors.unionByName(_levels(prefixed.join(large, "prefix", "left_semi").drop("prefix"), low, high, found))
    found.append(_emitted(_level(survivors.unionByName(ended.where("at = 0")), 0)))
    everything = found[0]
    for some in found[1:]:
        everything = everything.unionByName(some)
    return _named(cut(everything))


def _levels(rows: DataFrame, low: int, high: int, found: list[DataFrame]) -> DataFrame:
    """What survives to level `low` of rows of the levels above it, one aggregation per level; adds the nodes to `found`."""
    survivors = rows.where(F.col("at") == high)
    for depth in range(high, low, -1):
        nodes = cut(_level(survivors, depth))
        found.append(_emitted(nodes))
        survivors = _stripped(nodes)
        if depth - 1 > low:
            survivors = survivors.unionByName(rows.where(F.col("at") == depth - 1))
    return survivors


def _named(nodes: DataFrame) -> DataFrame:
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    # A root has no parent and must not meet other nulls.
    return nodes.join(parents, "parent", "left").select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )
