"""Quality rules with risk-controlled cutoffs.

Text statistics come from one scan. A rule rejects a document when its statistic is above a
cutoff. Cutoffs are certified on labelled documents: for each stratum and rule the grid is
walked from the mildest cutoff to the strictest, and a cutoff passes while the exact binomial
tail says that the share of good documents it rejects is at most ALPHA / rules. The walk stops
at the first failure (fixed sequence), and its level is DELTA / (strata * rules) (Bonferroni),
so with probability 1 - DELTA no stratum loses more than ALPHA of its good documents. Of the
certified cutoffs the one with the best gain is taken; a stratum with too few labels gets none.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from flowsentry.llm.blocks import Block, hash_ranges, mix, same_ranges, text_blocks
from flowsentry.session import cut

#: Largest share of a stratum's good documents that all rules together may reject, and the chance of a breach anywhere.
ALPHA = 0.02
DELTA = 0.05
#: A rejected good document weighs as much as this many rejected bad ones when a certified cutoff is chosen.
GOOD_WEIGHT = 20
MIN_WORDS = 50
#: Cutoffs of so many strata at most (some MB) go to every task; more are joined.
BROADCAST_STRATA = 20_000
MAX_REPEAT_PERCENT = 50

#: rule -> (statistic of the columns of `text_statistics`, mildest to strictest cutoffs)
_RATIO = [round(x / 100, 2) for x in range(60, 0, -1)]
RULES: dict[str, tuple[str, list[float]]] = {
    "symbols": ("try_divide(n_symbols, word_chars)", _RATIO),
    "repeats": ("try_divide(n_repeat_words, n_words)", _RATIO),
    "duplicate_lines": ("try_divide(n_dup_lines, n_lines)", _RATIO),
    "upper_case": ("try_divide(n_upper, word_chars)", _RATIO),
    "shouting": ("try_divide(n_exclaim, n_words)", _RATIO),
    "digits": ("try_divide(n_digits, word_chars)", _RATIO),
}

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclaim", "n_digits")


def _lut(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


_SYMBOL, _EXCLAIM = _lut(b"#*$%&|<>"), _lut(b"!")
_UPPER, _DIGIT = _lut(bytes(range(65, 91))), _lut(bytes(range(48, 58)))
_LEAD = np.array([(b & 0xC0) != 0x80 and b != 0x20 and not 9 <= b <= 13 for b in range(256)])


def block_statistics(block: Block) -> dict[str, np.ndarray]:
    """The counts of each document of a block."""
    data, offsets, docs = block.data, block.offsets, len(block)
    out = {
        "word_chars": block.per_document(_LEAD[data]), "n_symbols": block.per_document(_SYMBOL[data]), "n_upper": block.per_document(_UPPER[data]),
        "n_exclaim": block.per_document(_EXCLAIM[data]), "n_digits": block.per_document(_DIGIT[data]),
    }
    starts, ends = block.words()
    out["n_words"] = np.diff(np.searchsorted(starts, offsets))
    if not len(starts):
        return out | {k: np.zeros(docs, dtype=np.int64) for k in ("n_dup_lines", "n_repeat_words", "n_lines")}
    doc = np.repeat(np.arange(docs), out["n_words"])

    breaks = np.flatnonzero(data == 0x0A)
    after = np.searchsorted(breaks, starts)
    line_start, line_end = offsets[doc].copy(), offsets[doc + 1].copy()
    has = after > 0
    line_start[has] = np.maximum(line_start[has], breaks[after[has] - 1] + 1)
    has = after < len(breaks)
    line_end[has] = np.minimum(line_end[has], breaks[after[has]])
    lead = np.flatnonzero(np.concatenate([[True], line_start[1:] != line_start[:-1]]))
    line_doc = doc[lead]
    salt = mix(np.arange(docs, dtype=np.uint64))
    line_start, line_end = line_start[lead], line_end[lead]
    same = _first_equal(hash_ranges(data, line_start, line_end) ^ salt[line_doc], line_doc, lambda i, j: same_ranges(data, line_start[i], line_end[i], line_start[j], line_end[j]))
    out["n_lines"] = np.bincount(line_doc, minlength=docs)
    out["n_dup_lines"] = np.bincount(line_doc[same != np.arange(len(same))], minlength=docs)

    covered = np.zeros(len(starts) + 2, dtype=bool)
    if len(starts) > 2:
        word = hash_ranges(data, starts, ends)
        three = mix(mix(mix(word[:-2]) + word[1:-1]) + word[2:]) ^ salt[doc[:-2]]
        inside = np.flatnonzero(doc[:-2] == doc[2:])

        def equal(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            i, j = inside[i], inside[j]
            return np.logical_and.reduce([same_ranges(data, starts[i + k], ends[i + k], starts[j + k], ends[j + k]) for k in range(3)])

        first = _first_equal(three[inside], doc[inside], equal)
        again = inside[np.bincount(first, minlength=len(inside))[first] > 1]
        for k in range(3):
            covered[again + k] = True
    out["n_repeat_words"] = np.bincount(doc[covered[: len(starts)]], minlength=docs)
    return out


def _first_equal(hashed: np.ndarray, doc: np.ndarray, equal) -> np.ndarray:
    """Number of the first item of the same document that equals each item. The hash only proposes: equal(i, j) compares the items."""
    _, where, inverse = np.unique(hashed, return_index=True, return_inverse=True)
    first, own = where[inverse], np.arange(len(hashed))
    rest = np.flatnonzero(first != own)
    wrong = rest[~((doc[rest] == doc[first[rest]]) & equal(rest, first[rest]))]
    if len(wrong):  # hashes clashed: these items and their likes are compared among themselves
        first[wrong] = wrong[_first_equal(mix(hashed[wrong] + doc[wrong].astype(np.uint64)), doc[wrong], lambda i, j: equal(wrong[i], wrong[j]))]
    return first


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang") -> DataFrame:
    """(doc_id, stratum, counts...): one row per row of `docs`; null text is empty and has no words.

    Words are runs outside ASCII white space. n_dup_lines counts lines with a word that equal an
    earlier line of the text; n_repeat_words counts words inside 3-word windows found twice or more.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch.column(2)):
                counts = block_statistics(block)
                yield pa.RecordBatch.from_arrays(
                    [c.slice(block.first, len(block)) for c in batch.columns[:2]] + [pa.array(counts[k], pa.int64()) for k in _COUNTS], ["doc_id", "stratum", *_COUNTS]
                )

    stratum = F.coalesce(F.col(stratum_col).cast("string"), F.lit("")) if stratum_col else F.lit("")
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), stratum.alias("stratum"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, stratum string, " + ", ".join(f"{c} long" for c in _COUNTS)
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _statistic(rule: str) -> Column:
    return F.coalesce(F.expr(RULES[rule][0]), F.lit(0.0))  # null for a text without words: nothing to reject


def within_risk(rejected: int, good: int, alpha: float, level: float) -> bool:
    """Exact test: may we say at `level` that the false rejection rate is at most `alpha`? (P(Bin(good, alpha) <= rejected) <= level)"""
    if good == 0 or rejected >= alpha * good:
        return False
    i = np.arange(rejected, dtype=np.float64)
    steps = np.log((good - i) / (i + 1)) + math.log(alpha / (1 - alpha))
    logs = good * math.log1p(-alpha) + np.concatenate([[0.0], np.cumsum(steps)])
    top = logs.max()
    return top + math.log(np.exp(logs - top).sum()) <= math.log(level)


def choose_cutoff(rejected_good: np.ndarray, rejected_bad: np.ndarray, good: int, alpha: float, level: float) -> int | None:
    """Place of the best certified cutoff of a grid that runs from mild to strict; None if none is worth it."""
    best, gain = None, 0
    for k in range(len(rejected_good)):
        if not within_risk(int(rejected_good[k]), good, alpha, level):
            break
        now = int(rejected_bad[k]) - GOOD_WEIGHT * int(rejected_good[k])
        if now > gain:
            best, gain = k, now
    return best


def certified_cutoffs(stats: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, cutoffs map<rule, double>) from labelled documents; strata without a certified cutoff are left out.

    Documents that the base rules reject count for no rule. Rows with a null label are left out;
    of several labels of a document the lowest counts.
    """
    marked = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("_quality"))
    labelled = cut(stats.where(~base_failed()).join(marked, "doc_id").select("stratum", (F.col("_quality") > 0).alias("good"), *[_statistic(r).alias(f"s_{r}") for r in RULES]))
    # Cutoffs run downwards: a document falls to every cutoff from the first one below its statistic.
    first = [
        F.struct(F.lit(r).alias("rule"), F.expr(f"aggregate(array({','.join(map(str, RULES[r][1]))}), 0, (n, c) -> n + if(s_{r} > c, 0, 1))").alias("first"))
        for r in RULES
    ]
    counts = (
        labelled.select("stratum", "good", F.explode(F.array(*first)).alias("_r")).groupBy("stratum", "_r.rule", "_r.first")
        .agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    )
    counts = cut(counts)
    level = delta / (len(RULES) * max(1, counts.select("stratum").distinct().count()))

    def choose(group: pa.Table) -> pa.Table:
        stratum, rule = group["stratum"][0].as_py(), group["rule"][0].as_py()
        grid = RULES[rule][1]
        good, bad = np.zeros(len(grid) + 1, dtype=np.int64), np.zeros(len(grid) + 1, dtype=np.int64)
        np.add.at(good, group["first"].to_numpy(), group["good"].to_numpy())
        np.add.at(bad, group["first"].to_numpy(), group["bad"].to_numpy())
        at = choose_cutoff(np.cumsum(good)[:-1], np.cumsum(bad)[:-1], int(good.sum()), alpha / len(RULES), level)
        found = [] if at is None else [(stratum, rule, grid[at])]
        return pa.table({"stratum": pa.array([f[0] for f in found], pa.string()), "rule": pa.array([f[1] for f in found], pa.string()), "cutoff": pa.array([f[2] for f in found], pa.float64())})

    # A group holds one row per cutoff at most.
    chosen = counts.groupBy("stratum", "rule").applyInArrow(choose, "stratum string, rule string, cutoff double")
    return chosen.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed_rules).

    One row per row of `docs`, repeated rows too. Null or empty text has no words and fails the
    base rules. Without labels only the base rules reject. Null strata are one stratum. An empty
    table gives an empty result; other columns are not read.
    """
    stats = cut(text_statistics(docs, id_col, text_col, stratum_col))
    cutoffs = certified_cutoffs(stats, labels)
    joined = stats.join(cutoffs, "stratum", "left")
    failed = F.array_compact(F.array(*[F.when(_statistic(r) > F.col("cutoffs")[r], F.lit(r)) for r in RULES]))
    return joined.withColumns({"base_failed": base_failed(), "failed_rules": F.when(F.col("cutoffs").isNull(), F.array().cast("array<string>")).otherwise(failed)}).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"), "failed_rules",
    )


def keep_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """The rows of `docs` that `judge` keeps, all their columns unchanged; row by row, so no text is shuffled."""
    cutoffs = cut(certified_cutoffs(cut(text_statistics(docs, id_col, text_col, stratum_col)), labels))
    at = docs.columns.index(text_col)
    names = [f"_s{i}_{c}" for i, c in enumerate(_COUNTS)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch.column(at)):
                counts = block_statistics(block)
                rows = batch.slice(block.first, len(block))
                yield pa.RecordBatch.from_arrays([*rows.columns, *[pa.array(counts[k], pa.int64()) for k in _COUNTS]], [*rows.schema.names, *names])

    schema = StructType([*docs.schema.fields, *[StructField(n, LongType()) for n in names]])
    counted = docs.mapInArrow(run, schema).alias("d")
    stats = {c: F.col(f"d.{n}") for c, n in zip(_COUNTS, names)}
    small = cutoffs.count() <= BROADCAST_STRATA
    joined = counted.join(F.broadcast(cutoffs.alias("c")) if small else cutoffs.alias("c"), F.coalesce(F.col(f"d.`{stratum_col}`").cast("string"), F.lit("")) == F.col("c.stratum"), "left")
    packed = joined.select(F.struct(*[F.col(f"d.`{c}`") for c in docs.columns]).alias("_row"), *[v.alias(c) for c, v in stats.items()], F.col("c.cutoffs").alias("cutoffs"))
    rejected = F.lit(False)
    for r in RULES:
        rejected = rejected | F.coalesce(_statistic(r) > F.col("cutoffs")[r], F.lit(False))
    return packed.where(~base_failed() & ~rejected).select("_row.*")
