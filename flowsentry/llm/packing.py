"""Token-id output: best-fit-decreasing packing into rows of fixed length.

Documents are tokenised in the scan and dealt into blocks by hash; the number of blocks grows
with the text, so a block stays small. A block is packed by itself: texts longer than a row are
cut into whole rows and a rest, the rests go in decreasing length to the fullest row that still
has room, which a segment tree over the remaining capacities finds. No token is dropped.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsentry.llm.bpe import encode_documents
from flowsentry.llm.exact_dedup import in_bitmap, key_bitmap

ROW_TOKENS = 2048
#: Bytes of text in a block on average.
BLOCK_TEXT_BYTES = 16 << 20
#: Stands behind the last token of a row; free in the vocabulary.
PAD_ID = 50256
#: Ids and positions are written as little-endian 16-bit numbers.
ID_TYPE = "<u2"
#: Equal rows (id and text) beyond which their copies are dealt by input partition as well.
MANY_COPIES = 32


class Capacities:
    """Open rows by remaining capacity: a segment tree of counts over 0..limit and a stack of rows for each capacity."""

    def __init__(self, limit: int):
        self.width = 1 << max(1, limit.bit_length())
        self.count = [0] * (2 * self.width)
        self.rows: list[list[int]] = [[] for _ in range(limit + 1)]

    def add(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        node = self.width + capacity
        while node:
            self.count[node] += 1
            node >>= 1

    def best(self, need: int) -> tuple[int, int] | None:
        """Takes out the row of least capacity >= need: (capacity, row)."""
        node = self.width + need
        count = self.count
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):  # up, until a right sibling has rows
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.width:
                node *= 2
                if not count[node]:
                    node += 1
        capacity = node - self.width
        row = self.rows[capacity].pop()
        while node:
            count[node] -= 1
            node >>= 1
        return capacity, row


def best_fit_decreasing(lengths: np.ndarray, limit: int) -> list[list[int]]:
    """Rows of item numbers; `lengths` are at most `limit` and taken in decreasing order, equal ones as they come."""
    rows: list[list[int]] = []
    open_rows = Capacities(limit)
    for item in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[item])
        found = open_rows.best(need)
        if found is None:
            found = limit, len(rows)
            rows.append([])
        capacity, row = found
        rows[row].append(item)
        if capacity > need:
            open_rows.add(capacity - need, row)
    return rows


def pack_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", row_tokens: int = ROW_TOKENS) -> DataFrame:
    """(block, pack, n_tokens, ids, cu_seqlens, position_ids, doc_ids, doc_offsets, doc_rows): one row per packed row.

    ids and position_ids are `row_tokens` little-endian 16-bit numbers; behind n_tokens stand PAD_ID
    and position 0. Segment i spans cu_seqlens[i]:cu_seqlens[i + 1], holds tokens of doc_ids[i] from
    its token doc_offsets[i] on, and its positions start at 0 again. doc_rows[i] numbers the rows of
    `docs` within a block, so (block, doc_rows) tells rows of equal id apart.

    Null and empty texts have no tokens and so no segment; rows with a null id are packed under a
    null id. Repeated rows are packed each. An empty table gives an empty result; other columns
    are not read. Equal lengths go by id, so a result does not depend on the order of rows; copies of
    a row that is there more than MANY_COPIES times are spread by the partition they are read in.
    A vocabulary with an id of PAD_ID or above raises ValueError.
    """
    if not 1 <= row_tokens <= 1 << 16:
        raise ValueError("positions are 16-bit numbers: row_tokens is at most 65536")
    if (most := highest_id(vocabulary)) >= PAD_ID:
        raise ValueError(f"the vocabulary's highest id {most} reaches the padding {PAD_ID}")
    size = docs.agg(F.sum(F.octet_length(text_col)).alias("n")).first().n or 0
    blocks = max(1, math.ceil(size / BLOCK_TEXT_BYTES))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("same"))
    many = rows.groupBy("same").count().where(F.col("count") > MANY_COPIES)
    # A row that is only marked by chance is dealt elsewhere, nothing else.
    salted = in_bitmap(rows, key_bitmap(many, "same"), "same").select(F.struct("id", F.when(F.col("_hit"), F.spark_partition_id()).alias("salt")).alias("key"), "text")
    encoded = encode_documents(salted, vocabulary, "key", "text", dtype=ID_TYPE).where("n_tokens > 0")
    dealt = encoded.select(F.col("doc_id.id").alias("doc_id"), "n_tokens", "ids", F.pmod(F.xxhash64("doc_id.id", "ids", "doc_id.salt"), F.lit(blocks)).alias("block"))
    id_type = docs.schema[id_col].dataType

    def pack(group: pa.Table) -> pa.Table:
        block, order = group["block"][0].as_py(), [("doc_id", "ascending"), ("n_tokens", "ascending"), ("ids", "ascending")]
        group = group.sort_by(order)
        lengths = group["n_tokens"].to_numpy()
        tokens = np.frombuffer(b"".join(group["ids"].to_pylist()), dtype=ID_TYPE)
        starts = np.cumsum(lengths) - lengths
        full, rest = lengths // row_tokens, lengths % row_tokens
        # Pieces: (document, offset, length); whole rows first, then the rests that are packed.
        whole_doc = np.repeat(np.arange(len(lengths)), full)
        whole_at = (np.arange(len(whole_doc)) - np.repeat(np.cumsum(full) - full, full)) * row_tokens
        rests = np.flatnonzero(rest)
        packed = best_fit_decreasing(rest[rests], row_tokens)
        rows = [[(d, o, row_tokens)] for d, o in zip(whole_doc.tolist(), whole_at.tolist())]
        last, left = (full * row_tokens).tolist(), rest.tolist()
        rows += [[(d, last[d], left[d]) for d in rests[items].tolist()] for items in packed]
        ids = np.full((len(rows), row_tokens), PAD_ID, dtype=ID_TYPE)
        positions = np.zeros((len(rows), row_tokens), dtype=ID_TYPE)
        counting = np.arange(row_tokens, dtype=ID_TYPE)
        lengths_of, docs_of, offsets_of, rows_of = [], [], [], []
        names = group["doc_id"].to_pylist()
        for r, row in enumerate(rows):
            at, ends = 0, [0]
            for d, o, n in row:
                a = int(starts[d]) + o
                ids[r, at : at + n] = tokens[a : a + n]
                positions[r, at : at + n] = counting[:n]
                at += n
                ends.append(at)
            lengths_of.append(ends)
            docs_of.append([names[d] for d, _, _ in row])
            offsets_of.append([o for _, o, _ in row])
            rows_of.append([d for d, _, _ in row])
        return pa.table({
            "block": pa.array([block] * len(rows), pa.int64()), "pack": pa.array(range(len(rows)), pa.int64()), "n_tokens": pa.array([e[-1] for e in lengths_of], pa.int32()),
            "ids": pa.array([r.tobytes() for r in ids], pa.binary()), "cu_seqlens": pa.array(lengths_of, pa.list_(pa.int32())),
            "position_ids": pa.array([r.tobytes() for r in positions], pa.binary()), "doc_ids": pa.array(docs_of, pa.list_(group.schema.field("doc_id").type)),
            "doc_offsets": pa.array(offsets_of, pa.list_(pa.int64())), "doc_rows": pa.array(rows_of, pa.list_(pa.int64())),
        })

    kind = id_type.simpleString()
    return dealt.groupBy("block").applyInArrow(
        pack, f"block long, pack long, n_tokens int, ids binary, cu_seqlens array<int>, position_ids binary, doc_ids array<{kind}>, doc_offsets array<long>, doc_rows array<long>"
    )


def highest_id(vocabulary: str) -> int:
    """Highest id of a rank file, -1 of an empty one."""
    with open(vocabulary, "rb") as lines:
        return max((int(line.split()[1]) for line in lines if line.strip()), default=-1)


def unpack_documents(packed: DataFrame) -> DataFrame:
    """(doc_id, ids): the tokens of each packed row of documents put together again, as in `encode_documents` with 16-bit ids."""
    width = np.dtype(ID_TYPE).itemsize
    parts = packed.select("block", "ids", "cu_seqlens", F.posexplode(F.arrays_zip("doc_ids", "doc_offsets", "doc_rows")).alias("i", "s"))
    start = F.col("cu_seqlens")[F.col("i")]
    piece = F.substring(F.col("ids"), start * width + 1, (F.col("cu_seqlens")[F.col("i") + 1] - start) * width)
    rows = parts.select("block", F.col("s.doc_rows").alias("row"), F.col("s.doc_ids").alias("doc_id"), F.struct(F.col("s.doc_offsets").alias("o"), piece.alias("p")).alias("part"))
    joined = F.aggregate(F.array_sort(F.collect_list("part")), F.lit(b""), lambda all_, x: F.concat(all_, x["p"]))
    return rows.groupBy("block", "row", "doc_id").agg(joined.alias("ids")).select("doc_id", "ids")
