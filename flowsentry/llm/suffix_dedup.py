"""Removal of repeated byte strings with suffix arrays.

Every 50-byte window that also starts in a document of smaller id is removed. A window belongs to
its anchor, the 24-byte string of least hash inside it, so equal windows have equal anchors:

Copies of a whole text go as a whole; the rest of the work is for each text's first document.

1. Anchors of all documents are counted in packed sorted arrays; those found in two documents or
   more are marked in a bitmap whose size follows the text up to a fixed bound. A fuller bitmap
   lets more through and changes no result.
2. Windows with a marked anchor are cut out in runs (a segment: up to 27 window starts and 49
   bytes more); equal segments of a block of text travel once.
3. Segments meet by anchor. A two-stage suffix sort orders their suffixes: those smaller than
   their successor are sorted directly, the others are induced by scanning the buckets in order.
   Adjacent common prefixes of 50 bytes or more tie windows together; the least id of a tie is
   each window's first document.
4. Occurrences look up their segment's first documents; the spans go back to the texts they are in.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsentry.llm.blocks import Block, SubstringHash, binary_rows, mix, ragged_index, text_blocks
from flowsentry.llm.exact_dedup import in_bitmap, key_bitmap
from flowsentry.session import cut, discard

WINDOW, ANCHOR = 50, 24
#: Text bytes for each part of the anchors' count and of the suffix sort; a task holds one part of either.
COUNT_BYTES, SORT_BYTES = 32 << 20, 8 << 20
#: Segment text that is suffix-sorted at once.
CHUNK_BYTES = 1 << 20
#: Bits of the anchor bitmap: text bytes / 4 in powers of two, 16 MB as text goes to 512 MB, 128 MB at most.
LEAST_BITS, MOST_BITS = 20, 30
#: Stands for a null id, which is behind every other.
NO_ID = (1 << 63) - 1

_TOP = np.uint64(0xFFFFFFFF00000000)


def window_runs(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window, document, segment hash) of each run of windows with one anchor."""
    n = len(block.data)
    none = np.zeros(0, dtype=np.int64)
    if n < WINDOW:
        return none.astype(np.uint64), none, none, none, none
    hasher = block.hasher()
    grams = hasher.windows(ANCHOR)
    key = (grams & _TOP) | np.arange(len(grams), dtype=np.uint64)
    width, reach = WINDOW - ANCHOR + 1, 1
    while reach * 2 <= width:
        key = np.minimum(key[: len(key) - reach], key[reach:])
        reach *= 2
    key = np.minimum(key[: len(key) - (width - reach)], key[width - reach :])
    tails = np.bincount(np.maximum(block.offsets[:-1], block.offsets[1:] - (WINDOW - 1)), minlength=n + 1) - np.bincount(block.offsets[1:], minlength=n + 1)
    at = np.flatnonzero(np.cumsum(tails[: n - WINDOW + 1]) == 0)
    if not len(at):
        return none.astype(np.uint64), none, none, none, none
    place = (key[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    lead = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)]))
    first, last = at[lead], at[np.append(lead[1:], len(at)) - 1]
    # Least hashes are small numbers: mixed again they spread over parts and bitmap.
    return mix(grams[place[lead]]), first, last, block.doc_of(first), hasher(first, last + WINDOW).view(np.int64)


def _anchor_bitmap(docs: DataFrame, text_bytes: int) -> np.ndarray:
    """Bytes of the bitmap of anchors in two documents or more, by the leading bits of their hashes."""
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, text_bytes / 4)))))
    parts = max(1, math.ceil(text_bytes / COUNT_BYTES))
    borders = [(p << bits) // parts for p in range(parts + 1)]
    # An anchor travels as the leading `width` bits of its hash and a mark, as the difference from the one before it in its part.
    width = 31 + int(math.log2(parts))
    shift, one = np.uint64(64 - width), np.uint64(1)
    limits = np.array([b << (width + 1 - bits) for b in borders[:-1]], dtype=np.uint64)

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch.column(0)):
                anchor, _, _, doc, _ = window_runs(block)
                order = np.argsort(anchor, kind="stable")
                anchor, doc = anchor[order] >> shift, doc[order]
                again = np.flatnonzero((anchor[1:] == anchor[:-1]) & (doc[1:] != doc[:-1]))
                single, several = np.unique(anchor), np.unique(anchor[again])
                marked = single << one
                marked[np.searchsorted(single, several)] |= one  # two documents of this block have it
                starts = np.searchsorted(marked, limits)
                lengths = np.diff(np.append(starts, len(marked)))
                used = np.flatnonzero(lengths)
                steps = np.diff(marked, prepend=np.uint64(0))
                steps[starts[used]] = marked[starts[used]] - limits[used]
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), binary_rows(steps.astype(np.uint32), lengths[used])], ["part", "anchors"])

    def mark(group: pa.Table) -> pa.Table:
        part = group["part"][0].as_py()
        rows = [np.cumsum(np.frombuffer(x, dtype=np.uint32), dtype=np.uint64) for x in group["anchors"].to_pylist()]
        marked = np.sort(np.concatenate(rows)) + limits[part]
        anchors = marked >> one
        found = np.concatenate([anchors[1:][anchors[1:] == anchors[:-1]], anchors[marked & one == one]]) << shift
        low = borders[part] & ~7
        flags = np.zeros((borders[part + 1] - low + 8) & ~7, dtype=bool)
        flags[(found >> np.uint64(64 - bits)).astype(np.int64) - low] = True
        return pa.table({"at": pa.array([low >> 3], pa.int64()), "bits": pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())})

    counted = docs.select("_text").mapInArrow(find, "part int, anchors binary").groupBy("part").applyInArrow(mark, "at long, bits binary")
    bitmap = np.zeros((1 << bits >> 3) + 8, dtype=np.uint8)
    for row in counted.toLocalIterator():  # together as large as the bitmap
        some = np.frombuffer(row.bits, dtype=np.uint8)
        bitmap[row.at : row.at + len(some)] |= some
    return bitmap[: 1 << bits >> 3]


def _segments(docs: DataFrame, bitmap, parts: int) -> DataFrame:
    """Occurrences and packed segments of the runs with a marked anchor.

    An occurrence is (id, key, pos, seg_hash). A pack holds a block's distinct segments of one part
    of the anchors, with the least and the greatest id that the block has them in.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = bitmap.value
        shift = np.uint64(64 - (len(marks) * 8).bit_length() + 1)
        for batch in batches:
            for block in text_blocks(batch.column(2)):
                anchor, first, last, doc, seg = window_runs(block)
                at = (anchor >> shift).astype(np.int64)
                keep = np.flatnonzero(marks[at >> 3] >> (at & 7).astype(np.uint8) & 1)
                if not len(keep):
                    continue
                anchor, first, last, doc, seg = anchor[keep], first[keep], last[keep], doc[keep], seg[keep]
                ids, keys = (batch.column(c).slice(block.first, len(block)).to_numpy(zero_copy_only=False)[doc] for c in (0, 1))
                order = np.argsort(seg, kind="stable")
                lead = np.flatnonzero(np.concatenate([[True], seg[order][1:] != seg[order][:-1]]))
                low, high, chosen = np.minimum.reduceat(ids[order], lead), np.maximum.reduceat(ids[order], lead), order[lead]
                by_anchor = np.argsort(anchor[chosen], kind="stable")
                low, high, chosen = low[by_anchor], high[by_anchor], chosen[by_anchor]
                part = _part(anchor[chosen], parts)
                packs = []
                used, starts = np.unique(part, return_index=True)
                for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(part)]):
                    some = chosen[a:b]
                    packs.append(_pack(anchor[some], low[a:b], high[a:b], last[some] + WINDOW - first[some], block.data, first[some]))
                n, m = len(seg), len(packs)
                blank = np.concatenate([np.zeros(n, dtype=bool), np.ones(m, dtype=bool)])
                longs = [pa.array(np.concatenate([x, np.zeros(m, dtype=np.int64)]), pa.int64(), mask=blank) for x in (ids, keys, first - block.offsets[doc], seg)]
                yield pa.RecordBatch.from_arrays(
                    [*longs, pa.array(np.concatenate([np.zeros(n, dtype=np.int64), used]), pa.int32(), mask=~blank), pa.array([None] * n + packs, pa.binary())], ["id", "key", "pos", "seg_hash", "part", "pack"]
                )

    return docs.mapInArrow(run, "id long, key long, pos long, seg_hash long, part int, pack binary")


def _part(anchor: np.ndarray, parts: int) -> np.ndarray:
    """Even ranges of the hash."""
    return ((anchor >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _pack(anchor: np.ndarray, low: np.ndarray, high: np.ndarray, lengths: np.ndarray, data: np.ndarray, starts: np.ndarray) -> bytes:
    body = b"".join([anchor.tobytes(), low.astype(np.int64).tobytes(), high.astype(np.int64).tobytes(), lengths.astype(np.uint8).tobytes(), data[ragged_index(starts, lengths)].tobytes()])
    return len(anchor).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(body)


def _unpack(pack: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, low, high, lengths, text) of a pack."""
    n, body = int.from_bytes(pack[:8], "little"), zstandard.ZstdDecompressor().decompress(pack[8:])
    longs = np.frombuffer(body, dtype=np.uint64, count=3 * n).reshape(3, n)
    return longs[0], longs[1].view(np.int64), longs[2].view(np.int64), np.frombuffer(body, dtype=np.uint8, count=n, offset=24 * n).astype(np.int64), np.frombuffer(body, dtype=np.uint8, offset=25 * n)


# Suffix arrays ---------------------------------------------------------------------------------


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as a number, zeros behind the end."""
    padded = np.concatenate([text, np.zeros(8 + 64, dtype=np.uint8)]).astype(np.uint64)
    out = padded[: len(text) + 64].copy()
    for k in range(1, 8):
        out <<= np.uint64(8)
        out |= padded[k : k + len(text) + 64]
    return out


def _dense(keys: np.ndarray) -> np.ndarray:
    """Rank of each key among the distinct keys."""
    order = np.argsort(keys)
    out = np.empty(len(keys), dtype=np.uint64)
    ordered = keys[order]
    out[order] = np.cumsum(np.concatenate([[False], ordered[1:] != ordered[:-1]]))
    return out


def smaller_than_successor(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the empty suffix is smallest."""
    n = len(text)
    step = np.sign(np.append(text[1:].astype(np.int16), -1) - text)
    decided = np.where(step != 0, np.arange(n), n - 1)
    decided = np.minimum.accumulate(decided[::-1])[::-1]  # the end of the run of equal bytes
    return step[decided] > 0


def suffix_array(text: np.ndarray, depth: int = WINDOW) -> np.ndarray:
    """Positions in the order of their suffixes, compared to `depth` bytes at least (ties in any order).

    Stage 1 sorts only the suffixes smaller than their successors, by ranks of 16 bytes; depth is at
    most 64. Stage 2 goes through the buckets of first bytes upwards: behind each suffix met, its
    predecessor is next in its own bucket, if it is larger than its successor.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    words = _dense(_words(text))
    pairs = _dense(words[: n + 48] << np.uint64(32) | words[8 : n + 56])
    small = smaller_than_successor(text)
    direct = np.flatnonzero(small)
    group = pairs[direct]
    for k in range(16, depth, 16):
        group = _dense(group << np.uint64(32) | pairs[np.minimum(direct + k, n + 47)])
    direct = direct[np.argsort(group, kind="stable")]
    border = np.searchsorted(text[direct], np.arange(257))

    larger = ~small
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[n - 1]].append(np.array([n - 1]))  # behind the empty suffix
    out = []
    for byte in np.unique(text).tolist():
        induced = []
        now = np.concatenate(waiting[byte]) if waiting[byte] else np.zeros(0, dtype=np.int64)
        waiting[byte] = []
        while len(now):  # runs of this byte: each step puts one more of it in front
            induced.append(now)
            now = now[now > 0] - 1
            now = now[(text[now] == byte) & larger[now]]
        bucket = np.concatenate([*induced, direct[border[byte] : border[byte + 1]]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[larger[before] & (text[before] > byte)]
        if len(before):
            first = text[before]
            before = before[np.argsort(first, kind="stable")]
            counts = np.bincount(first, minlength=256)
            ends = np.cumsum(counts)
            for c in np.flatnonzero(counts).tolist():
                waiting[c].append(before[ends[c] - counts[c] : ends[c]])
    return np.concatenate(out)


def adjacent_prefixes(text: np.ndarray, suffixes: np.ndarray, most: int = WINDOW) -> np.ndarray:
    """Common prefix length of each suffix with the one before it in order, `most` at most; 0 for the first."""
    words = _words(text)
    out = np.zeros(len(suffixes), dtype=np.int64)
    a, b = suffixes[:-1], suffixes[1:]
    alive = np.arange(len(b))
    for k in range(0, most, 8):
        differ = words[np.minimum(a[alive] + k, len(words) - 1)] ^ words[np.minimum(b[alive] + k, len(words) - 1)]
        lead = np.full(len(alive), 8)
        for byte in range(7, -1, -1):
            lead[differ >> np.uint64(8 * (7 - byte)) & np.uint64(0xFF) != 0] = byte
        out[alive + 1] += lead
        alive = alive[lead == 8]
    room = len(text) - np.maximum(a, b)
    out[1:] = np.minimum(np.minimum(out[1:], most), room)
    return out


def first_documents(text: np.ndarray, starts: np.ndarray, lengths: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Least id of each window, for all windows of segment 0, then of segment 1, and so on."""
    windows = lengths - WINDOW + 1
    at = ragged_index(starts, windows)
    ids = np.full(len(text), NO_ID)
    ids[at] = np.repeat(low, windows)
    order = suffix_array(text)
    lead = np.flatnonzero(adjacent_prefixes(text, order) < WINDOW)
    least = np.minimum.reduceat(ids[order], lead)
    out = np.empty(len(text), dtype=np.int64)
    out[order] = np.repeat(least, np.diff(np.append(lead, len(text))))
    return out[at]


def _sort_chunk(anchor: np.ndarray, low: np.ndarray, high: np.ndarray, starts: np.ndarray, lengths: np.ndarray, data: np.ndarray) -> pa.RecordBatch:
    """(seg_hash, at, windows, first): runs of windows of one first document, where a document of the segment comes after it."""
    text = data[ragged_index(starts, lengths)]
    starts = np.cumsum(lengths) - lengths
    seg = SubstringHash(text)(starts, starts + lengths).view(np.int64)
    order = np.lexsort((seg, anchor))
    anchor, seg = anchor[order], seg[order]
    lead = np.flatnonzero(np.concatenate([[True], (seg[1:] != seg[:-1]) | (anchor[1:] != anchor[:-1])]))
    low, high, one = np.minimum.reduceat(low[order], lead), np.maximum.reduceat(high[order], lead), order[lead]
    seg, lengths = seg[lead], lengths[one]
    text = text[ragged_index(starts[one], lengths)]
    first = first_documents(text, np.cumsum(lengths) - lengths, lengths, low)
    owner = np.repeat(np.arange(len(lead)), lengths - WINDOW + 1)
    run = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (first[1:] != first[:-1])]))
    own = np.cumsum(lengths - WINDOW + 1) - (lengths - WINDOW + 1)
    size = np.diff(np.append(run, len(first)))
    useful = np.flatnonzero(first[run] < high[owner[run]])
    run, size = run[useful], size[useful]
    return pa.RecordBatch.from_arrays([pa.array(seg[owner[run]]), pa.array(run - own[owner[run]], pa.int64()), pa.array(size, pa.int64()), pa.array(first[run])], ["seg_hash", "at", "windows", "first"])


def _sorted_runs(segments: DataFrame, parts: int) -> DataFrame:
    """Suffix-sorts the segments of each part, all of an anchor together, in chunks of whole anchors."""

    def sort(packs: list[bytes]) -> Iterator[pa.RecordBatch]:
        anchor, low, high, lengths, data = (np.concatenate(x) for x in zip(*map(_unpack, packs)))
        starts = np.cumsum(lengths) - lengths
        order = np.argsort(anchor, kind="stable")
        anchor, upto = anchor[order], np.cumsum(lengths[order])
        a = 0
        while a < len(order):
            b = int(np.searchsorted(upto, (upto[a - 1] if a else 0) + CHUNK_BYTES, side="right"))
            b = int(np.searchsorted(anchor, anchor[min(max(b, a), len(anchor) - 1)], side="left" if b > a and anchor[min(b, len(anchor) - 1)] != anchor[a] and b < len(anchor) else "right"))
            some = order[a:b]
            yield _sort_chunk(anchor[a:b], low[some], high[some], starts[some], lengths[some], data)
            a = b

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, packs = None, []
        for batch in batches:
            for part, pack in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if part != here and packs:
                    yield from sort(packs)
                    packs = []
                here = part
                packs.append(pack)
        if packs:
            yield from sort(packs)

    dealt = segments.where("pack is not null").select("part", "pack").repartition(parts, "part").sortWithinPartitions("part")
    return dealt.mapInArrow(run, "seg_hash long, at long, windows long, first long")


def _strip(rows: DataFrame, id_type: str) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) from (doc_id, _text, _spans)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(2)
            for block in text_blocks(batch.column(1)):
                sizes, removed, runs, digests, kept = [], [], [], [], []
                for i in range(len(block)):
                    text = np.frombuffer(block.document(i), dtype=np.uint8)
                    found = spans[block.first + i].as_py() or []
                    change = np.zeros(len(text) + 1, dtype=np.int64)
                    for span in found:
                        change[span["start"]] += 1
                        change[span["end"]] -= 1
                    gone = np.cumsum(change[:-1]) > 0
                    left = text[~gone].tobytes()
                    sizes.append(len(text))
                    removed.append(len(text) - len(left))
                    runs.append(int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(len(gone) and gone[0]))
                    digests.append(hashlib.sha256(left).hexdigest())
                    kept.append(left)
                numbers = [pa.array(x, pa.int64()) for x in (sizes, removed, runs)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.first, len(block)), *numbers, pa.array(digests, pa.string()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
                )

    return rows.mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept): one row per row of `docs`; `kept` are the bytes left.

    A byte goes if a 50-byte string that covers it also starts in a document of smaller id, judged
    on the input; strings inside one document, or in rows of one id, do not count. A null id is
    behind every other. Null text is empty. Repeated rows get the same result each. Texts under 50
    bytes stay. An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("_text"), F.xxhash64(text).alias("_key"), F.xxhash64(F.lit(1), text).alias("_key2")).withColumn("_id", F.coalesce("doc_id", F.lit(NO_ID)))
    size = rows.agg(F.sum(F.octet_length("_text")).alias("n")).first().n or 0
    # A copy of a whole text goes as a whole, and its first document stands for it. The few rows that the bitmap takes for copies are joined.
    names = rows.where(F.octet_length("_text") >= WINDOW).select("doc_id", "_id", "_key", "_key2", F.octet_length("_text").cast("long").alias("n_bytes"))
    first = names.groupBy("_key", "_key2").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last")).where("_first < _last")
    copies = cut(names.join(first, ["_key", "_key2"]).where("_id > _first").select("doc_id", "_id", "_key", "_key2", "n_bytes"))
    marked = in_bitmap(rows, key_bitmap(copies, "_id", "_key"), "_id", "_key")
    taken_for = cut(marked.where("_hit").drop("_hit").join(copies.select("_id", "_key", "_key2"), ["_id", "_key", "_key2"], "left_anti").select("doc_id", "_text", "_key", "_id"))
    rows = marked.where("not _hit").select("doc_id", "_text", "_key", "_id").unionByName(taken_for)
    bitmap = spark.sparkContext.broadcast(_anchor_bitmap(rows, size))  # bounded by MOST_BITS
    parts = max(1, math.ceil(size / SORT_BYTES))
    segments = cut(_segments(rows.select("_id", "_key", "_text"), bitmap, parts))
    runs = cut(_sorted_runs(segments, parts))
    hits = segments.where("pack is null").select("id", "key", "pos", "seg_hash").join(runs, "seg_hash").where(F.col("first") < F.col("id"))
    start = F.col("pos") + F.col("at")
    spans = hits.select("id", "key", F.struct(start.alias("start"), (start + F.col("windows") + (WINDOW - 1)).alias("end")).alias("span"))
    spans = cut(spans.groupBy("id", "key").agg(F.collect_list("span").alias("_spans")))  # bounded by one text
    discard(segments)
    discard(runs)
    whole = copies.select("doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(""), 256).alias("kept_sha256"), F.lit(b"").alias("kept"))
    marked = in_bitmap(rows.withColumnsRenamed({"_id": "id", "_key": "key"}), key_bitmap(spans, "id", "key"), "id", "key")
    clean = marked.where("not _hit").select(
        "doc_id", F.octet_length("_text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("_text", 256).alias("kept_sha256"), F.col("_text").cast("binary").alias("kept")
    )
    touched = marked.where("_hit").join(spans, ["id", "key"], "left").select("doc_id", "_text", "_spans")
    return clean.unionByName(_strip(touched, "bigint")).unionByName(whole)
