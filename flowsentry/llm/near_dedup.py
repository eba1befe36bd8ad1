"""Near duplicates: consistent weighted sampling of TF-IDF shingles, banded, verified by weighted Jaccard.

1. Shingles are five consecutive words (all words of a shorter text). Document frequencies are
   counted over every document in a hashed feature space of fixed size, as in a hashing TF-IDF;
   a shingle's weight is its count times 1 + ln((N + 1) / (df + 1)).
2. Improved consistent weighted sampling draws (r, c, beta) per shingle and sample and takes the
   shingle of least ln a; the draws of a shingle come from a pool row chosen by its hash.
   Samples form bands; texts of equal words share one representative before banding. The same
   draws are also sampled by plain counts, in as many bands of their own, so that a pair alike
   in either similarity meets with the same chance.
3. A bucket is worked off from pivots: members outside its largest class, drawn by hash, are
   compared with all members of other classes, links join classes, the pivots are done, and the
   next round draws more, until the members that are left are one class. Before that every member
   meets its bucket's least member, first in buckets of several bands. So members of one class
   are seldom compared, pairs are never rows, and no link of two classes in one bucket is lost.
4. A pair links when the exact weighted Jaccard similarity is at least the threshold, or the
   plain one: in a large family of copies the shared shingles lose weight, the edits do not.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsentry.llm.blocks import Block, binary_rows, hash_ranges, mix, text_blocks
from flowsentry.llm.exact_dedup import in_bitmap, key_bitmap
from flowsentry.operators.components import component_stars
from flowsentry.session import cut, discard

WIDTH = 5
THRESHOLD = 0.8
#: Bands of each of the two sample sets (by weight, by plain count), and samples in a band.
BANDS, ROWS = 26, 5
#: Hashed features of the document frequencies (4 MB of float32 weights, whatever the corpus) and rows of the pool of draws.
FEATURE_BITS, POOL_BITS = 20, 15
#: Members compared with one copy of their pivot.
SALT_ROWS = 500
#: Pairs whose samples disagree in more than this many of 128 two-bit values, in both sample sets, are not compared:
#: at a weighted or plain similarity of 0.8 that has a chance of 1e-12; unlike pairs mostly go.
MOST_DISAGREEING = 52
#: Sample bits as longs: four of the samples by weight, then four of those by plain count.
BITS = tuple(f"s{k}" for k in range(8))
#: Before single bands, buckets of so many bands in a row join the closest texts.
LEVELS = (4, 2)
#: Pivots that a bucket draws in the first round, and at most in a later one.
FIRST_PIVOTS, MOST_PIVOTS = 64, 512
#: Bits of the bitmaps of the texts that a round compares.
ROUND_BITS = 1 << 22

_DRAWS: list[tuple[np.ndarray, ...]] = []


def shingles(block: Block, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash) of every shingle in text order, and the two halves of each document's digest of its words (0, 0: no word)."""
    starts, ends = block.words()
    counts = np.diff(np.searchsorted(starts, block.offsets))
    doc = np.repeat(np.arange(len(block)), counts)
    word = hash_ranges(block.data, starts, ends)
    firsts = np.cumsum(counts) - counts
    place = np.arange(len(word)) - firsts[doc]
    digest = block.word_digests(starts, ends)
    hashed = word.copy()
    step = word
    for k in range(1, width):  # the words of a shorter text all go into its only shingle
        step = np.append(step[1:], np.uint64(0))
        inside = place + k < counts[doc]
        hashed = np.where(inside, mix(hashed) + step, hashed)
    keep = (place + width <= counts[doc]) | ((place == 0) & (counts[doc] < width))
    return doc[keep], mix(hashed[keep]), digest[0], digest[1]


def _unique(doc: np.ndarray, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, hash) in order, and how often each occurs."""
    order = np.lexsort((hashed, doc))
    doc, hashed = doc[order], hashed[order]
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (hashed[1:] != hashed[:-1])])) if len(doc) else np.zeros(0, dtype=np.int64)
    return doc[first], hashed[first], np.diff(np.append(first, len(doc)))


def _features(hashed: np.ndarray) -> np.ndarray:
    return (hashed >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)


def feature_weights(docs: DataFrame) -> np.ndarray:
    """1 + ln((N + 1) / (df + 1)) of each hashed feature; every row of `docs` (doc_id, text) counts. 2**FEATURE_BITS floats."""
    slices = 256
    size = (1 << FEATURE_BITS) // slices

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(1 << FEATURE_BITS, dtype=np.int64), 0
        for batch in batches:
            for block in text_blocks(batch.column(0)):
                doc, hashed, _, _ = shingles(block)
                seen = np.sort(doc << FEATURE_BITS | _features(hashed))
                seen = seen[np.concatenate([[True], seen[1:] != seen[:-1]])] if len(seen) else seen
                df += np.bincount(seen & ((1 << FEATURE_BITS) - 1), minlength=len(df))
                n += len(np.unique(doc))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), pa.array([n] * slices, pa.int64()), binary_rows(df, np.full(slices, size))], ["part", "n", "counts"])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        docs_of: dict[int, int] = {}
        for batch in batches:
            for part, n, counts in zip(*(c.to_pylist() for c in batch.columns)):
                total[part] = total.get(part, 0) + np.frombuffer(counts, dtype=np.int64)
                docs_of[part] = docs_of.get(part, 0) + n
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([docs_of[p] for p in total], pa.int64()), pa.array([total[p].tobytes() for p in total], pa.binary())], ["part", "n", "counts"])

    schema = "part int, n long, counts binary"
    summed = docs.select("text").mapInArrow(count, schema).repartition("part").mapInArrow(add, schema)
    rows = summed.collect()  # 256 rows, 8 MB together
    out = np.full(1 << FEATURE_BITS, 1.0, dtype=np.float32)
    for r in rows:
        df = np.frombuffer(r.counts, dtype=np.int64)
        out[r.part * size : (r.part + 1) * size] = 1 + np.log((r.n + 1) / (df + 1))
    return out


def _draws() -> tuple[np.ndarray, ...]:
    """1/r, beta, ln c - r + r * beta and r for each pool row and sample; r and c follow Gamma(2, 1), beta is uniform."""
    if not _DRAWS:
        rng, shape = np.random.default_rng(9), (1 << POOL_BITS, BANDS * ROWS)
        gamma = lambda: -np.log(1 - rng.random(shape, dtype=np.float32)) - np.log(1 - rng.random(shape, dtype=np.float32))
        r, c, beta = np.maximum(gamma(), np.float32(1e-6)), np.maximum(gamma(), np.float32(1e-30)), rng.random(shape, dtype=np.float32)
        _DRAWS.append((1 / r, beta, np.log(c) - r + r * beta, r))
    return _DRAWS[0]


def signatures(doc: np.ndarray, hashed: np.ndarray, tf: np.ndarray, weight: np.ndarray, docs: int) -> np.ndarray:
    """Least ln a of each document (row) and sample (column): the samples by `weight`, then those of the same draws by the plain count `tf`.

    The value names the shingle and its level t.
    """
    inverse, beta, base, r = _draws()
    size = BANDS * ROWS
    out = np.full((docs, 2 * size), np.inf, dtype=np.float32)
    row, log_weight, log_tf = (hashed & np.uint64((1 << POOL_BITS) - 1)).astype(np.int64), np.log(weight).astype(np.float32)[:, None], np.log(tf).astype(np.float32)[:, None]
    step = 2048
    for a in range(0, len(doc), step):
        rows, some = row[a : a + step], doc[a : a + step]
        draws, shifts, scale, plain = inverse[rows], beta[rows], r[rows], base[rows]
        level = draws * log_weight[a : a + step]
        level += shifts
        np.floor(level, out=level)
        level *= scale
        np.subtract(plain, level, out=level)
        several = np.flatnonzero(tf[a : a + step] > 1)  # a count of 1 is level 0, as beta is under 1
        if len(several):
            plain[several] -= np.floor(draws[several] * log_tf[a : a + step][several] + shifts[several]) * scale[several]
        first = np.flatnonzero(np.concatenate([[True], some[1:] != some[:-1]]))
        at = some[first]
        for k, values in enumerate((level, plain)):
            part = out[:, k * size : (k + 1) * size]
            part[at] = np.minimum(part[at], np.minimum.reduceat(values, first, axis=0))
    return out


def _band_keys(signature: np.ndarray) -> np.ndarray:
    bits = signature.view(np.uint32).astype(np.uint64).reshape(len(signature), 2 * BANDS, ROWS)
    key = np.broadcast_to(mix(np.arange(1, 2 * BANDS + 1, dtype=np.uint64)), bits.shape[:2]).copy()
    for k in range(ROWS):
        key = mix(key + bits[:, :, k])
    return key.view(np.int64)


def _two_bits(signature: np.ndarray) -> np.ndarray:
    """Two bits of each of the first 128 samples of both sets, as eight longs: a set's first bits, then its second ones."""
    planes = []
    for first in (0, BANDS * ROWS):
        mixed = mix(np.ascontiguousarray(signature[:, first : first + 128]).view(np.uint32).astype(np.uint64))
        planes += [np.packbits((mixed >> np.uint64(k) & np.uint64(1)).astype(bool), axis=1).view(np.int64) for k in (7, 31)]
    return np.concatenate(planes, axis=1)


def _sketch(docs: DataFrame, weights, id_type: str) -> DataFrame:
    """(doc_id, d1, d2, n, total, bands, s0..s7): digest, number and weight of the shingles, band keys, bits of the samples; d1 is null without a word."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = weights.value
        for batch in batches:
            for block in text_blocks(batch.column(1)):
                doc, hashed, d1, d2 = shingles(block)
                doc, hashed, tf = _unique(doc, hashed)
                weight = tf * table[_features(hashed)]
                signature = signatures(doc, hashed, tf, weight, len(block))
                keys, bits = _band_keys(signature), _two_bits(signature)
                n = np.bincount(doc, weights=tf, minlength=len(block)).astype(np.int64)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(block) + 1) * 2 * BANDS, pa.int32()), pa.array(keys.ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.first, len(block)), pa.array(d1.view(np.int64), pa.int64(), mask=n == 0), pa.array(d2.view(np.int64), pa.int64()),
                     pa.array(n, pa.int64()), pa.array(np.bincount(doc, weights=weight, minlength=len(block)), pa.float64()), bands, *[pa.array(bits[:, k]) for k in range(len(BITS))]],
                    ["doc_id", "d1", "d2", "n", "total", "bands", *BITS],
                )

    return docs.mapInArrow(run, f"doc_id {id_type}, d1 long, d2 long, n long, total double, bands array<long>, " + ", ".join(f"{b} long" for b in BITS))


def _vectors(docs: DataFrame, weights, id_type: str) -> DataFrame:
    """(id, hashes, counts, bands, bits): sorted distinct 32-bit shingle values and counts (int32, none if all are 1) of each text, its band keys and sample bits.

    Two shingles of a pair share a value by chance in one pair of texts of 200 shingles out of 10**5.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = weights.value
        for batch in batches:
            for block in text_blocks(batch.column(1)):
                doc, hashed, tf = _unique(*shingles(block)[:2])
                lengths = np.bincount(doc, minlength=len(block))
                signature = signatures(doc, hashed, tf, tf * table[_features(hashed)], len(block))
                some = np.full(len(block), 1)
                value = (hashed >> np.uint64(32)).astype(np.uint32)
                if len(value):
                    first = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])]))
                    doc, value, tf = doc[first], value[first], np.add.reduceat(tf, first)
                    lengths = np.bincount(doc, minlength=len(block))
                several = np.bincount(doc, weights=tf, minlength=len(block)).astype(np.int64) > lengths
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.first, len(block)), binary_rows(value, lengths), binary_rows(tf[several[doc]].astype(np.int32), lengths * several),
                     binary_rows(_band_keys(signature).ravel(), some * 2 * BANDS), binary_rows(_two_bits(signature).ravel(), some * len(BITS))],
                    ["id", "hashes", "counts", "bands", "bits"],
                )

    return docs.mapInArrow(run, f"id {id_type}, hashes binary, counts binary, bands binary, bits binary")


def similarities(a: tuple[np.ndarray, np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[float, float]:
    """(weighted, plain) Jaccard of two vectors (hashes, counts, weights of one occurrence)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = np.minimum(a[1][i], b[1][j])
    shared, plain = float((low * a[2][i]).sum()), float(low.sum())
    all_weight = float((a[1] * a[2]).sum() + (b[1] * b[2]).sum()) - shared
    all_plain = float(a[1].sum() + b[1].sum()) - plain
    return (shared / all_weight if all_weight else 0.0, plain / all_plain if all_plain else 0.0)


def _links(pairs: DataFrame, vectors: DataFrame, weights, id_type: str, threshold: float) -> DataFrame:
    """(src, dst) of the pairs (a, b) that link. Each salted copy of a pivot a goes ahead of some of its partners."""
    named = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    vectors = in_bitmap(vectors, key_bitmap(named, "id", bits=ROUND_BITS), "id", bits=ROUND_BITS).where("_hit").select("id", "hashes", "counts")
    load = pairs.groupBy("a").count().select("a", F.ceil(F.col("count") / SALT_ROWS).cast("int").alias("salts"))
    members = pairs.join(load, "a").select("a", "b", F.pmod(F.hash("b"), "salts").alias("salt")).join(vectors, F.col("b") == F.col("id")).select("a", "salt", F.lit(1).alias("member"), "b", "hashes", "counts")
    pivots = load.join(vectors, F.col("a") == F.col("id")).select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("member"), F.col("a").alias("b"), "hashes", "counts")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = weights.value
        pivot, vector = None, None
        for batch in batches:
            found: list[tuple] = []
            for a, member, b, hashes, counts in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4, 5))):
                this = _vector(hashes, counts, table)
                if not member:
                    pivot, vector = a, this
                elif a == pivot and max(similarities(vector, this)) >= threshold:
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], batch.schema.field(0).type) for k in range(2)], ["src", "dst"])

    dealt = members.unionByName(pivots).repartition("a", "salt").sortWithinPartitions("a", "salt", "member")
    return dealt.mapInArrow(run, f"src {id_type}, dst {id_type}")


def _meet(live: DataFrame, pivot, vectors: DataFrame, weights, id_type: str, threshold: float, most_disagreeing: int) -> DataFrame:
    """(src, dst): pairs of classes that some pivot and some member of one bucket link.

    Members of a bucket are dealt over tasks, its pivots go to each of them. No pair is a row: a
    task compares a member with the pivots of other classes by sample bits, then exactly, in the
    first bucket that both share, and names each class it links with once.
    """
    chunks = F.ceil(F.col("members") / SALT_ROWS).cast("int")
    columns = ("bucket", "class", "rep")
    rows = live.select(*columns, F.pmod(F.hash("rep"), chunks).alias("salt"), F.lit(1).alias("member"))
    rows = rows.unionByName(live.where(pivot).select(*columns, F.explode(F.sequence(F.lit(0), chunks - 1)).alias("salt"), F.lit(0).alias("member")))
    named = live.select(F.col("rep").alias("id")).distinct()
    vectors = in_bitmap(vectors, key_bitmap(named, "id", bits=ROUND_BITS), "id", bits=ROUND_BITS).where("_hit").drop("_hit")
    dealt = rows.join(vectors, F.col("rep") == F.col("id")).select("bucket", "salt", "member", "class", "hashes", "counts", "bands", "bits")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = weights.value
        here, held, bits, bands = None, [], None, None
        for batch in batches:
            found: list[tuple] = []
            for bucket, salt, member, klass, hashes, counts, own_bands, own_bits in zip(*(c.to_pylist() for c in batch.columns)):
                if (bucket, salt) != here:
                    here, held, bits = (bucket, salt), [], None
                if not member:
                    held.append((klass, hashes, counts, own_bands, own_bits))
                    continue
                if not held:
                    continue
                if bits is None:
                    bits = np.frombuffer(b"".join(h[4] for h in held), dtype=np.uint64).reshape(-1, len(BITS))
                    bands = np.frombuffer(b"".join(h[3] for h in held), dtype=np.int64).reshape(-1, 2 * BANDS)
                differ = bits ^ np.frombuffer(own_bits, dtype=np.uint64)
                apart = np.minimum(*(np.bitwise_count(differ[:, k : k + 2] | differ[:, k + 2 : k + 4]).sum(axis=1) for k in (0, 4)))
                near = np.flatnonzero(apart <= most_disagreeing)
                near = near[np.argsort(apart[near], kind="stable")]
                mine = np.frombuffer(own_bands, dtype=np.int64)
                met, this = {klass}, None
                for k in near.tolist():
                    other = held[k]
                    if other[0] in met or bands[k][np.argmax(bands[k] == mine)] != bucket:
                        continue
                    this = this or _vector(hashes, counts, table)
                    if max(similarities(_vector(other[1], other[2], table), this)) >= threshold:
                        met.add(other[0])
                        found.append((other[0], klass))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], batch.schema.field(3).type) for k in range(2)], ["src", "dst"])

    return dealt.repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", "member").mapInArrow(run, f"src {id_type}, dst {id_type}")


def _vector(hashes: bytes, counts: bytes, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    value = np.frombuffer(hashes, dtype=np.uint32)
    tf = np.frombuffer(counts, dtype=np.int32) if counts else np.ones(len(value), dtype=np.int32)
    return value, tf, table[value >> np.uint32(32 - FEATURE_BITS)].astype(np.float64)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, most_disagreeing: int = MOST_DISAGREEING) -> DataFrame:
    """(doc_id, class_id, kept): one row per row of `docs`; class_id is the least id of the document's class.

    `most_disagreeing` of 128 compares all pairs that share a bucket, whatever their sample bits.

    Texts with the same words in the same order are one class. A text without words (null or
    empty) is a class of its own. Repeated rows share their class. A row without an id joins the
    class of equal words, else its class_id is null and it is kept. Different texts under one id
    share its class. An empty table gives an empty result; other columns of `docs` are not read.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = base.schema["doc_id"].dataType.simpleString()
    weights = spark.sparkContext.broadcast(feature_weights(base))  # 4 MB
    sketch = cut(_sketch(base, weights, id_type))

    # Texts of equal words have one representative, the least id. Few rows are copies, so only they meet in a join.
    named = sketch.where("d1 is not null and doc_id is not null").select("doc_id", "d1", "d2")
    # Rows without an id look for a representative too.
    same = sketch.where("d1 is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("_last"), F.max(F.col("doc_id").isNull()).alias("_anon"))
    copied = cut(same.where("rep < _last or (rep is not null and _anon)").select("d1", "d2", "rep"))
    copies = cut(named.join(copied, ["d1", "d2"]).where("doc_id > rep").select("doc_id", "rep").distinct())
    worded = in_bitmap(sketch.where("d1 is not null and doc_id is not null"), key_bitmap(copies, "doc_id"), "doc_id").select(F.col("doc_id").alias("rep"), "n", "total", "bands", *BITS, "_hit")
    texts = worded.where("not _hit").unionByName(worded.where("_hit").join(copies.select(F.col("doc_id").alias("rep")), "rep", "left_anti")).drop("_hit")

    keys = texts.select("rep", F.explode("bands").alias("bucket"))
    shared = cut(keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.min("rep").alias("lead"), F.max("rep").alias("_last")).where("lead < _last").drop("_last"))
    live = in_bitmap(keys, key_bitmap(shared, "bucket"), "bucket").where("_hit").drop("_hit").join(shared, "bucket")
    live = cut(live)
    members = live.select(F.col("rep").alias("doc_id")).distinct()
    wanted = in_bitmap(base, key_bitmap(members, "doc_id"), "doc_id").where("_hit").select("doc_id", "text")
    vectors = cut(_vectors(wanted, weights, id_type))
    lively = cut(in_bitmap(texts, key_bitmap(members.withColumnRenamed("doc_id", "rep"), "rep"), "rep").where("_hit").drop("_hit"))
    sizes = lively.drop("bands")
    bare, live = live, cut(live.join(sizes.distinct(), "rep").withColumn("class", F.col("rep")))
    digests = cut(sketch.select("doc_id", "d1", "d2"))  # what the end still needs
    for step in (bare, shared, sketch):
        discard(step)

    state = _Classes(vectors, weights, id_type, threshold, most_disagreeing)
    for run in LEVELS:  # the most alike first: runs of several bands agree
        wide = lively.select("rep", "n", "total", *BITS, F.explode(F.array(*[F.xxhash64(F.lit(k), F.slice("bands", k + 1, run)) for k in range(0, 2 * BANDS - run + 1, run)])).alias("bucket"))
        lead = wide.groupBy("bucket").agg(F.min("rep").alias("lead"), F.max("rep").alias("_last")).where("lead < _last").drop("_last")
        wide = state.label(wide.join(lead, "bucket"))
        state.compare(wide, F.col("rep") == F.col("lead"))
    former, live = live, cut(state.label(live))
    discard(former)
    state.compare(live, F.col("rep") == F.col("lead"))
    # Pairs that are left to compare: members that were no pivot yet and are not of one class.
    rest, turn, drawn = live.where(F.col("rep") != F.col("lead")).select("bucket", "rep"), 0, FIRST_PIVOTS
    while True:
        labelled = cut(state.label(rest))
        held = labelled.groupBy("bucket", "class").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket")
        held = held.agg(F.max_by("class", F.struct("n", "class")).alias("largest"), F.sum("n").alias("members"), (F.sum("n") - F.max("n")).alias("others")).where("others > 0")
        open_rows = cut(labelled.join(held, "bucket"))
        for step in (labelled, live):
            discard(step)
        live = open_rows
        if live.isEmpty():
            break
        # Pivots by place in a hash order drawn for the bucket and round.
        place = F.pmod(F.xxhash64(F.lit(turn), "bucket", "rep"), F.lit(1 << 40)) / F.lit(float(1 << 40)) * F.col("others")
        pivot = (F.col("class") != F.col("largest")) & (place < drawn)
        state.join(_meet(live, pivot, vectors, weights, id_type, threshold, most_disagreeing))
        rest, turn, drawn = live.where(~pivot).select("bucket", "rep"), turn + 1, min(8 * drawn, MOST_PIVOTS)

    for step in (vectors, lively, live):
        discard(step)
    found = state.classes
    by_text = digests.where("d1 is not null").join(copied, ["d1", "d2"], "left").select("doc_id", F.coalesce("rep", "doc_id").alias("rep"))
    if found is not None:
        by_text = by_text.join(found, "rep", "left").withColumn("rep", F.coalesce("class", "rep"))
    by_text = by_text.select("doc_id", F.col("rep").alias("class_id"))
    wordless = digests.where("d1 is null").select("doc_id", F.col("doc_id").alias("class_id"))
    return by_text.unionByName(wordless).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


class _Classes:
    """Classes joined so far, and the pairs already compared."""

    def __init__(self, vectors: DataFrame, weights, id_type: str, threshold: float, most_disagreeing: int):
        self.vectors, self.weights, self.id_type, self.threshold, self.most_disagreeing = vectors, weights, id_type, threshold, most_disagreeing
        self.classes: DataFrame | None = None
        self.done: DataFrame | None = None

    def label(self, rows: DataFrame) -> DataFrame:
        """`rows` (rep, ...) with the class of each representative."""
        rows = rows.drop("class")
        if self.classes is None:
            return rows.withColumn("class", F.col("rep"))
        return rows.join(self.classes, "rep", "left").withColumn("class", F.coalesce("class", "rep"))

    def compare(self, rows: DataFrame, pivot) -> None:
        """Compare the pivots among `rows` (bucket, rep, n, total, s0..s7, class) with the members of their buckets in other classes, and join classes."""
        t = self.threshold
        p, m = rows.where(pivot).alias("p"), rows.alias("m")
        near = (F.col("p.n") <= F.col("m.n") / t) & (F.col("m.n") <= F.col("p.n") / t)
        near |= (F.col("p.total") <= F.col("m.total") / t) & (F.col("m.total") <= F.col("p.total") / t)
        differ = [F.col(f"p.{b}").bitwiseXOR(F.col(f"m.{b}")) for b in BITS]
        apart = [F.bit_count(differ[k].bitwiseOR(differ[k + 2])) + F.bit_count(differ[k + 1].bitwiseOR(differ[k + 3])) for k in (0, 4)]
        near &= F.least(*apart) <= self.most_disagreeing
        met = p.join(m, (F.col("p.bucket") == F.col("m.bucket")) & (F.col("p.class") != F.col("m.class")) & near)
        pairs = met.select(F.least("p.rep", "m.rep").alias("a"), F.greatest("p.rep", "m.rep").alias("b"), F.least("p.class", "m.class").alias("v"), F.greatest("p.class", "m.class").alias("u")).distinct()
        if self.done is not None:
            pairs = pairs.join(self.done, ["a", "b"], "left_anti")
        pairs = cut(pairs)
        if pairs.isEmpty():
            return
        self.done = pairs.select("a", "b") if self.done is None else self.done.unionByName(pairs.select("a", "b"))
        links = _links(pairs.select("a", "b"), self.vectors, self.weights, self.id_type, t)
        self.join(links.join(pairs, (F.col("src") == F.col("a")) & (F.col("dst") == F.col("b"))).select(F.col("v").alias("src"), F.col("u").alias("dst")))

    def join(self, links: DataFrame) -> None:
        """Join the classes that `links` (src, dst) connect."""
        joined = cut(links.distinct())
        if joined.isEmpty():
            return
        # the least class of a component keeps its name, so it needs no row
        moved = component_stars(joined).select(F.col("u").alias("old"), F.col("v").alias("new"))
        if self.classes is None:
            self.classes = moved.select(F.col("old").alias("rep"), F.col("new").alias("class"))
            return
        known = self.classes.join(moved, F.col("class") == F.col("old"), "left").select("rep", F.coalesce("new", "class").alias("class"))
        # Representatives that were classes of their own until now.
        fresh = moved.join(self.classes, F.col("old") == F.col("rep"), "left_anti").select(F.col("old").alias("rep"), F.col("new").alias("class"))
        self.classes = cut(known.unionByName(fresh))


def expected_recall(similarity: float) -> float:
    """Chance that a pair of this weighted or plain similarity shares a bucket of that sample set."""
    return 1 - math.pow(1 - similarity**ROWS, BANDS)
