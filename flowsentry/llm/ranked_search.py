"""Ranked lexical search over whole corpora, scored once per distinct bag of terms.

1. Each document is restricted to the vocabulary of the items: a vector of (term, count), its length
   n in terms, and from n the length norm m. One scan of the texts makes the vectors; document
   frequencies and totals are sums over them.
2. Documents with equal vectors and equal m score alike for every item. They are grouped by a hash
   and by the vector itself, so a class is never a guess; a class is one row, whatever its size.
3. A task scores its classes against all items of the block and keeps the best of each item.
4. A class's members come last: the best classes of an item, by score and least id, hold all its
   best documents, so only those are expanded, by ascending id and no further than the ranking goes.

Items are taken in blocks of bounded size, which go to every task.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowsentry.llm.blocks import Block, binary_rows, hash_ranges, ragged_index, same_ranges, text_blocks
from flowsentry.llm.bpe import _PairTable
from flowsentry.session import cut

TOP = 10
#: Items, and pairs of an item and a term, of a block (some MB in every task).
BLOCK_ITEMS, BLOCK_PAIRS = 4096, 1 << 19
#: Characters that no term holds, and the constants of the score.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BASE, SLOPE, SCALE = 100, 75, 1_000_000_000
#: Cells of (class, item), and pairs of a class's term and an item that holds it, worked on at once.
CELLS, EXPANDED = 1 << 20, 1 << 21

_IS_TERM = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


@dataclass
class Items:
    """A block of items: terms as bytes, and the items of each term with the term's count there."""

    ids: list
    terms: list[bytes]
    post_start: np.ndarray
    post_item: np.ndarray
    post_count: np.ndarray

    def __post_init__(self) -> None:
        self.data = np.frombuffer(b"".join(self.terms), dtype=np.uint8)
        self.ends = np.cumsum([len(t) for t in self.terms]).astype(np.int64)
        self.starts = self.ends - np.array([len(t) for t in self.terms], dtype=np.int64)
        self.seed = 0
        while True:  # a seed that tells all terms apart
            keys = hash_ranges(self.data, self.starts, self.ends, self.seed).view(np.int64)
            if len(np.unique(keys)) == len(keys) and not (keys == -1).any():
                break
            self.seed += 1
        self.table = _PairTable(keys, np.arange(len(keys)))

    def term_of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Number of the vocabulary term that each range is, -1 where it is none."""
        found = self.table[hash_ranges(data, starts, ends, self.seed).view(np.int64)]
        hit = np.flatnonzero(found >= 0)
        base, joined = len(data), np.concatenate([data, self.data])
        same = same_ranges(joined, starts[hit], ends[hit], base + self.starts[found[hit]], base + self.ends[found[hit]])
        found[hit[~same]] = -1
        return found


def term_ranges(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased data, starts, ends) of the terms of a block; none crosses a document's edge."""
    inside = _IS_TERM[block.data]
    edge = np.zeros(len(inside) + 1, dtype=bool)
    edge[block.offsets] = True
    starts = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])))
    ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    return _LOWER[block.data], starts, ends


def _item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[Items]:
    """The items with a term, in blocks; an item is a row, whatever its id."""
    numbered = cut(items.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text")).withColumn("item", F.monotonically_increasing_id()))
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    pairs = numbered.select("item", "item_id", F.explode(F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0))).alias("term")).groupBy("item", "item_id", "term").count()
    pairs = cut(pairs)
    size = pairs.agg(F.count(F.lit(1)).alias("pairs"), F.approx_count_distinct("item").alias("items")).first()
    blocks = max(math.ceil(size.pairs / BLOCK_PAIRS), math.ceil(size["items"] / BLOCK_ITEMS))
    for b in range(blocks):
        rows = pairs.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).collect()  # bounded by the size of a block
        ids = {r["item"]: r.item_id for r in rows}
        number = {item: k for k, item in enumerate(ids)}
        terms = sorted({r.term.encode() for r in rows})
        place = {t: k for k, t in enumerate(terms)}
        post = np.array([(place[r.term.encode()], number[r["item"]], r["count"]) for r in rows], dtype=np.int64).reshape(-1, 3)
        post = post[np.argsort(post[:, 0], kind="stable")]
        if len(terms):
            yield Items(list(ids.values()), terms, np.searchsorted(post[:, 0], np.arange(len(terms) + 1)), post[:, 1], post[:, 2])


def _vectors(docs: DataFrame, shared) -> DataFrame:
    """(doc_id, n, vector): length in terms and sorted (term, count) pairs as int32, of every document with a term."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        for batch in batches:
            for block in text_blocks(batch.column(1)):
                data, starts, ends = term_ranges(block)
                doc = block.doc_of(starts)
                n = np.bincount(doc, minlength=len(block))
                term = items.term_of(data, starts, ends)
                known = term >= 0
                key, tf = np.unique(doc[known] * len(items.terms) + term[known], return_counts=True)
                pairs = np.stack([key % len(items.terms), tf], axis=1).astype(np.int32)
                distinct = np.bincount(key // len(items.terms), minlength=len(block))
                has = np.flatnonzero(n)
                columns = [batch.column(0).slice(block.first, len(block)), pa.array(n, pa.int64()), binary_rows(pairs.ravel(), 2 * distinct)]
                yield pa.RecordBatch.from_arrays([c.take(pa.array(has)) for c in columns], ["doc_id", "n", "vector"])

    return docs.mapInArrow(run, "doc_id long, n long, vector binary")


def _document_frequencies(vectors: DataFrame, terms: int) -> np.ndarray:
    """Documents that hold each term; a row per term reaches the driver, at most as many as a block has."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms, dtype=np.int64)
        for batch in batches:
            raw = b"".join(x.as_buffer().to_pybytes() for x in batch.column(0))
            total += np.bincount(np.frombuffer(raw, dtype=np.int32)[::2], minlength=terms)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["term", "df"])

    out = np.zeros(terms, dtype=np.int64)
    for r in vectors.select("vector").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r.term] = r.df
    return out


def _best(item: np.ndarray, score: np.ndarray, first: np.ndarray, anonymous: np.ndarray, klass: np.ndarray, top: int) -> np.ndarray:
    """Places of each item's best classes: by score, then least id (none comes last)."""
    order = np.lexsort((klass, first, anonymous, -score, item))
    item = item[order]
    lead = np.searchsorted(item, item)
    return order[np.arange(len(item)) - lead < top]


def _scored(classes: DataFrame, shared, weights, top: int) -> DataFrame:
    """(item, score, class_id, first_id): the best classes of each item in each task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight = shared.value, weights.value
        n_items, length = len(items.ids), np.diff(items.post_start)
        worth = np.repeat(weight, length) * items.post_count
        # Sums below 2**53 are exact in doubles; else both halves of a value are summed apart.
        exact = float(np.bincount(items.post_item, weights=worth.astype(float)).max()) * (SCALE / 1000) < 2.0**53
        kept = [np.zeros(0, dtype=np.int64) for _ in range(3)] + [np.zeros(0, dtype=bool), np.zeros(0, dtype=np.int64)]
        least = np.ones(n_items, dtype=np.int64)
        for batch in batches:
            raw = batch.column(2)
            pairs = np.frombuffer(b"".join(x.as_buffer().to_pybytes() for x in raw), dtype=np.int32).reshape(-1, 2).astype(np.int64)
            entries = np.array([x.as_buffer().size // 8 for x in raw], dtype=np.int64)
            ids, m = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            anonymous = batch.column(3).is_null().to_numpy(zero_copy_only=False)
            first = batch.column(3).fill_null(0).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(entries)), entries)
            value = SCALE * pairs[:, 1] // (1000 * pairs[:, 1] + 8 * m[row])
            spread = np.cumsum(length[pairs[:, 0]])
            row_end = np.cumsum(entries)
            a = 0
            while a < len(entries):
                done = spread[row_end[a - 1] - 1] if a else 0
                b = max(a + 1, min(a + CELLS // n_items, int(np.searchsorted(spread[row_end - 1], done + EXPANDED, side="right"))))
                x, y = (row_end[a - 1] if a else 0), row_end[b - 1]
                size = length[pairs[x:y, 0]]
                at = ragged_index(items.post_start[pairs[x:y, 0]], size)
                cell = np.repeat((row[x:y] - a) * n_items, size) + items.post_item[at]
                part = np.repeat(value[x:y], size) * worth[at]
                cells = (b - a) * n_items
                if exact:
                    score = np.bincount(cell, weights=part, minlength=cells).astype(np.int64)
                else:
                    high, low = (np.bincount(cell, weights=p, minlength=cells).astype(np.int64) for p in (part >> 26, part & ((1 << 26) - 1)))
                    score = (high << 26) + low
                score = score.reshape(b - a, n_items)
                own, item = np.nonzero(score >= least)
                if len(own):
                    new = [item, score[own, item], first[a + own], anonymous[a + own], ids[a + own]]
                    both = [np.concatenate([p, q]) for p, q in zip(kept, new)]
                    some = _best(*both, top)
                    kept = [c[some] for c in both]
                    held = np.bincount(kept[0], minlength=n_items)
                    last = np.full(n_items, np.iinfo(np.int64).max)
                    np.minimum.at(last, kept[0], kept[1])
                    least = np.where(held >= top, last, 1)
                a = b
        yield pa.RecordBatch.from_arrays([pa.array(kept[0], pa.int32()), pa.array(kept[1], pa.int64()), pa.array(kept[4], pa.int64()), pa.array(kept[2], pa.int64(), mask=kept[3])], ["item", "score", "class_id", "first_id"])

    return classes.select("class_id", "m", "vector", "first_id").mapInArrow(run, "item int, score long, class_id long, first_id long")


def _first_rows(rows: DataFrame, keys: list[str], order: list, top: int, name: str = "place") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= top)


def rank_documents(items: DataFrame, docs: DataFrame, top: int = TOP, item_col: str = "item_id", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` best documents of each item, none of score 0; equal scores go by ascending doc_id.

    Terms are runs of ASCII letters, digits and all characters beyond ASCII, A-Z lower-cased. Both tables
    name their text `text_col`; null text is empty. Every row is an item or a document of its own,
    repeated ones too; a document without an id comes after those of its score that have one. An item
    without a term, or whose terms no document holds, has no rows; empty tables give an empty result;
    other columns are not read.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = items.schema[item_col].dataType
    result = None
    for block in _item_blocks(items, item_col, text_col):
        ranked = _rank_block(base, block, top)
        names = spark.createDataFrame(list(enumerate(block.ids)), f"item int, item_id {kind.simpleString()}")  # the block's items
        ranked = ranked.join(names, "item").select("item_id", F.col("place").cast("int").alias("rank"), "doc_id", "score")
        result = ranked if result is None else result.unionByName(ranked)
    return spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long") if result is None else result


def _rank_block(docs: DataFrame, block: Items, top: int) -> DataFrame:
    """(item, place, doc_id, score) for one block of items."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(block)  # bounded by BLOCK_ITEMS and BLOCK_PAIRS
    vectors = cut(_vectors(docs, shared))
    total = vectors.agg(F.count(F.lit(1)).alias("N"), F.sum("n").alias("L")).first()
    df = _document_frequencies(vectors, len(block.terms))
    n_docs, all_terms = total.N, total.L or 1
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], dtype=np.int64)
    # Documents with a term of the vocabulary; norm, hash and the vector itself name their class.
    m = F.expr(f"{BASE - SLOPE} + ({SLOPE}L * n * {n_docs}L) div {all_terms}L")
    bags = vectors.where(F.octet_length("vector") > 0).select("doc_id", m.alias("m"), "vector").withColumn("hash", F.xxhash64("vector", "m"))
    classes = cut(bags.groupBy("hash", "m", "vector").agg(F.min("doc_id").alias("first_id")).withColumn("class_id", F.monotonically_increasing_id()))
    by_rank = [F.col("score").desc(), F.col("first_id").asc_nulls_last()]
    winners = cut(_first_rows(_scored(classes, shared, spark.sparkContext.broadcast(weight), top), ["item"], [*by_rank, "class_id"], top).drop("place"))
    chosen = cut(classes.join(winners.select("class_id").distinct(), "class_id", "left_semi").drop("first_id"))
    # At most `top` classes of each item of the block: their hashes find the members, their vectors confirm them.
    members = bags.join(F.broadcast(chosen.select("hash").distinct()), "hash", "left_semi")
    members = _first_rows(members, ["hash", "m", "vector"], [F.col("doc_id").asc_nulls_last()], top, "_place").drop("_place")
    expanded = members.join(chosen, ["hash", "m", "vector"]).select("class_id", "doc_id").join(winners, "class_id")
    return cut(_first_rows(expanded.select("item", "score", "doc_id"), ["item"], [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], top))
