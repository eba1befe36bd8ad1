"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Only documents whose (length, prefix hash) occurs at least twice are hashed whole. The
surviving keys reach the second scan as a bitmap of a fixed number of bits, so what is
broadcast does not grow with the data: a full bitmap costs hashing, never a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsentry.session import cut

PREFIX_CHARS = 64
#: Bits of the surviving-key bitmap: at most 2**24 / 64 broadcast rows of two longs (4 MB).
BITMAP_BITS = 1 << 24


def normalised(text: Column) -> Column:
    """Text without ASCII white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def key_bitmap(keys: DataFrame, *columns: str, bits: int = BITMAP_BITS) -> DataFrame:
    """(word, bits): the bitmap of the keys' hashes, at most bits / 64 rows."""
    at = keys.select(_bit(*columns, bits=bits))
    return at.groupBy(F.shiftright("_bit", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_bit & 63 as int))")).alias("_bits"))


def in_bitmap(df: DataFrame, bitmap: DataFrame, *columns: str, bits: int = BITMAP_BITS) -> DataFrame:
    """`df` with `_hit`: false only if the row's key is certainly not in the bitmap."""
    marked = df.withColumn("_bit", _bit(*columns, bits=bits)).withColumn("_word", F.shiftright("_bit", 6))
    hit = F.coalesce(F.expr("(shiftrightunsigned(_bits, cast(_bit & 63 as int)) & 1L) = 1L"), F.lit(False))
    return marked.join(F.broadcast(bitmap), "_word", "left").withColumn("_hit", hit).drop("_word", "_bits", "_bit")


def _bit(*columns: str, bits: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(bits)).alias("_bit")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False, bits: int = BITMAP_BITS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of `docs`.

    Texts are equal when identical without ASCII white space. The copy with the most code
    points in the original text stays, then the smallest id (a null id comes last).
    `text_sha256` is null for documents that never needed the full hash, unless `digest_all`.

    Null text is an empty text; all empty texts are one group. Repeated rows with the kept id
    are all kept (a row is known by its id). An empty table gives an empty result; other
    columns of `docs` are not read, so their names cannot clash.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")).select(
        "doc_id", F.char_length(F.coalesce("_text", F.lit(""))).alias("_points"), normalised(F.col("_text")).alias("_norm")
    )
    size, prefix = F.octet_length("_norm").alias("_len"), F.xxhash64(F.substring("_norm", 1, PREFIX_CHARS)).alias("_prefix")
    keys = cut(base.select(size, prefix))
    by_length = keys.groupBy("_len").count().where("count > 1")
    by_prefix = keys.join(by_length, "_len", "left_semi").groupBy("_len", "_prefix").count().where("count > 1")

    scanned = in_bitmap(base.select("doc_id", "_points", "_norm", size, prefix), key_bitmap(by_prefix, "_len", "_prefix", bits=bits), "_len", "_prefix", bits=bits)
    full = F.sha2("_norm", 256)
    hashed = cut(scanned.select("doc_id", "_points", "_hit", (full if digest_all else F.when(F.col("_hit"), full)).alias("text_sha256")))

    rank = F.struct((-F.col("_points")).alias("p"), F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("id"))
    groups = hashed.where("_hit").groupBy("text_sha256").agg(F.count(F.lit(1)).alias("_n"), F.min(rank).alias("_keep")).where("_n > 1")
    groups = groups.select(F.col("text_sha256").alias("_key"), "_n", F.col("_keep.id").alias("_keep"))
    # Rows outside any group get a key of their own, so they spread evenly over the join.
    keyed = hashed.withColumn("_key", F.when(F.col("_hit"), F.col("text_sha256")).otherwise(F.concat(F.lit("-"), F.hash("doc_id", "_points").cast("string"))))
    joined = keyed.join(groups, "_key", "left")
    return joined.select(
        "doc_id",
        F.when(F.col("_n").isNull(), F.col("doc_id")).otherwise(F.col("_keep")).alias("keep_id"),
        F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("_n").isNull() | F.col("doc_id").eqNullSafe(F.col("_keep"))).alias("kept"),
        "text_sha256",
    )
