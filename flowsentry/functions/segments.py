"""Ordered computations that never put a whole key into one task.

A plain window over a key runs on one task however large the key is. The
helpers here cut each key into ordered segments: the window runs inside a
segment, a second window runs over one row per segment, and a join adds the two.
Segment numbers are plain arithmetic on the order column, so both uses of a
frame agree without sampling or a driver round trip. Callers collapse equal
order values first, hence a segment holds distinct values only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsentry.functions.exprs import MINUTE_US
from flowsentry.session import cut

SEG = "_seg"
TIME_SEGMENT_US = 15 * MINUTE_US
VALUE_RESOLUTION = 2048
#: Cells of values per factor e: of all cells, of cells that hold too many rows, and of those parts of these that still do.
RESOLUTIONS = (VALUE_RESOLUTION, 1 << 21, 1 << 33)
SEGMENT_ROWS = 1 << 16


def time_segment(us: Column, width_us: int = TIME_SEGMENT_US) -> Column:
    return F.floor(us / F.lit(width_us)).cast("long")


def value_segment(value: Column, resolution: int = VALUE_RESOLUTION) -> Column:
    """Monotone bucket number, 1/resolution wide in relative terms at every magnitude; 0 has its own."""
    # ln of the least positive double is above -745
    magnitude = F.floor((F.ln(F.abs(value)) + F.lit(746.0)) * F.lit(float(resolution)))
    return F.when(value == 0, F.lit(0)).otherwise((F.signum(value) * magnitude).cast("long"))


def even_segments(df: DataFrame, keys: Sequence[str], value: str, most: int = SEGMENT_ROWS) -> DataFrame:
    """Add `_seg`: ordered segments of the values of each key, of about `most` rows at most, for any distribution.

    Values are cut by `value_segment`; a cell that holds too many is cut again, and its parts once
    more. The last cut is so fine that a part has a million different doubles at most. One row per
    (keys, value). Only the cells that are too full are looked up, so a frame without any pays two
    small aggregations.
    """
    places = ["_c0"]
    out = df.withColumn("_c0", value_segment(F.col(value), RESOLUTIONS[0]))
    for k, resolution in enumerate(RESOLUTIONS[1:], 1):
        cells = [*keys, *places]
        full = out.groupBy(*cells).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > most).select(*cells, F.lit(True).alias("_full"))
        out = out.join(full, cells, "left").withColumn(f"_c{k}", F.when(F.col("_full"), value_segment(F.col(value), resolution)).otherwise(F.lit(0))).drop("_full")
        places.append(f"_c{k}")
    return out.withColumn(SEG, F.struct(*places)).select(*df.columns, SEG)


def _keyed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with a full key and segment.

    The helpers join a frame with its own segment summary. Stating the not-null
    condition of that join here keeps both uses of the frame identical, so that
    Spark runs its scan and shuffle once and reuses the exchange.
    """
    for name in [*keys, SEG]:
        df = df.where(F.col(name).isNotNull())
    return df


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    totals: Mapping[str, str],
    descending: bool = False,
) -> DataFrame:
    """Add inclusive running sums; `totals` maps input column -> output column.

    `df` needs a `_seg` column and one row per (keys, order).
    """
    df = _keyed(df, keys)
    direction = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    inside = (
        Window.partitionBy(*keys, SEG).orderBy(direction(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    before = Window.partitionBy(*keys).orderBy(direction(SEG)).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*keys, SEG)
        .agg(*[F.sum(src).alias(f"_s_{src}") for src in totals])
        .select(*keys, SEG, *[F.sum(f"_s_{src}").over(before).alias(f"_o_{src}") for src in totals])
    )
    local = df.select("*", *[F.sum(src).over(inside).alias(f"_l_{src}") for src in totals])
    joined = local.join(offsets, [*keys, SEG], "inner")
    return joined.select(
        *df.columns,
        *[(F.col(f"_l_{src}") + F.coalesce(F.col(f"_o_{src}"), F.lit(0))).alias(out) for src, out in totals.items()],
    )


def next_marked(
    df: DataFrame, keys: Sequence[str], order: str, marked: Column, out: str, strict: bool, backward: bool = False, beyond_out: str | None = None
) -> DataFrame:
    """Add the nearest later (or earlier) `order` value among marked rows.

    One row per (keys, order). `strict` excludes the row itself. `beyond_out` names a further
    column that always does; it is found in the same pass.
    """
    df = _keyed(df, keys)
    pick = F.max if backward else F.min
    first = (lambda c: F.col(c).asc()) if backward else (lambda c: F.col(c).desc())
    inside = Window.partitionBy(*keys, SEG).orderBy(first(order))
    ends = {out: -1 if strict else Window.currentRow, **({beyond_out: -1} if beyond_out else {})}
    beyond = Window.partitionBy(*keys).orderBy(first(SEG)).rowsBetween(Window.unboundedPreceding, -1)
    candidate = F.when(marked, F.col(order))
    summary = (
        df.groupBy(*keys, SEG)
        .agg(pick(candidate).alias("_edge"))
        .select(*keys, SEG, pick("_edge").over(beyond).alias("_beyond"))
    )
    return (
        df.select("*", *[pick(candidate).over(inside.rowsBetween(Window.unboundedPreceding, end)).alias(f"_near_{name}") for name, end in ends.items()])
        .join(summary, [*keys, SEG], "inner")
        .select(*df.columns, *[F.coalesce(f"_near_{name}", "_beyond").alias(name) for name in ends])
    )


def neighbours(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Add `prev_` and `next_` of the order column within each key, across segments.

    One row per (keys, order).
    """
    df = _keyed(df, keys)
    inside = Window.partitionBy(*keys, SEG).orderBy(order)
    along = Window.partitionBy(*keys).orderBy(SEG)
    edges = (
        df.groupBy(*keys, SEG)
        .agg(F.min(order).alias("_first"), F.max(order).alias("_last"))
        .select(*keys, SEG, F.lag("_last").over(along).alias("_before"), F.lead("_first").over(along).alias("_after"))
    )
    local = df.select("*", F.lag(order).over(inside).alias("_prev"), F.lead(order).over(inside).alias("_next"))
    return local.join(edges, [*keys, SEG]).select(
        *df.columns, F.coalesce("_prev", "_before").alias(f"prev_{order}"), F.coalesce("_next", "_after").alias(f"next_{order}")
    )


def quantiles(
    counts: DataFrame,
    keys: Sequence[str],
    value: str,
    count: str,
    probs: Mapping[str, float],
) -> DataFrame:
    """Exact linear-interpolation quantiles per key from (keys, value, count) rows.

    Histogram selection: segment totals locate the order statistics, and only the
    segments that hold one are ordered. Equal to NumPy's default `percentile`.
    Segments that `counts` brings along (`even_segments`) are used.
    """
    held = counts.where(F.col(value).isNotNull())
    binned = _keyed(held if SEG in counts.columns else held.withColumn(SEG, value_segment(F.col(value))), keys)
    ordered = Window.partitionBy(*keys).orderBy(SEG)
    whole = Window.partitionBy(*keys)
    hist = (
        binned.groupBy(*keys, SEG)
        .agg(F.sum(count).alias("_n"))
        .select(
            *keys,
            SEG,
            F.sum("_n").over(whole).alias("_total"),
            F.sum("_n").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("_upto"),
            (
                F.sum("_n").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
            ).alias("_before"),
        )
    )
    names = list(probs)
    wanted = F.array(
        *[
            F.struct(F.lit(name).alias("q"), (F.lit(float(p)) * (F.col("_total") - 1)).alias("h"))
            for name, p in probs.items()
        ]
    )
    targets = (
        hist.withColumn("_t", F.explode(wanted))
        .select(
            *keys,
            SEG,
            "_before",
            "_upto",
            F.col("_t.q").alias("_q"),
            (F.col("_t.h") - F.floor("_t.h")).alias("_frac"),
            F.explode(
                F.array(
                    F.struct(F.lit("lo").alias("side"), F.floor("_t.h").cast("long").alias("pos")),
                    F.struct(F.lit("hi").alias("side"), F.ceil("_t.h").cast("long").alias("pos")),
                )
            ).alias("_p"),
        )
        .select(*keys, SEG, "_before", "_upto", "_q", "_frac", F.col("_p.side").alias("_side"), F.col("_p.pos").alias("_pos"))
        .where((F.col("_pos") >= F.col("_before")) & (F.col("_pos") < F.col("_upto")))
    )
    needed = targets.groupBy(*keys, SEG).agg(
        F.collect_list(F.struct("_q", "_side", (F.col("_pos") - F.col("_before")).alias("_at"), "_frac")).alias("_want")
    )
    inside = Window.partitionBy(*keys, SEG).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    picked = (
        binned.join(needed, [*keys, SEG], "inner")
        .withColumn("_cum", F.sum(count).over(inside))
        .select(*keys, value, F.col(count).alias("_c"), "_cum", F.explode("_want").alias("_w"))
        .where((F.col("_w._at") < F.col("_cum")) & (F.col("_w._at") >= F.col("_cum") - F.col("_c")))
    )

    def side(name: str, which: str) -> Column:
        return F.max(F.when((F.col("_w._q") == name) & (F.col("_w._side") == which), F.col(value)))

    def frac(name: str) -> Column:
        return F.max(F.when(F.col("_w._q") == name, F.col("_w._frac")))

    aggs = [
        (side(n, "lo") + (side(n, "hi") - side(n, "lo")) * frac(n)).cast("double").alias(n) for n in names
    ]
    if keys:
        return picked.groupBy(*keys).agg(*aggs)
    return picked.agg(*aggs)


def row_index(df: DataFrame, order: Sequence[Column], out: str = "row_index") -> DataFrame:
    """0-based position in a total order, computed by a range-partitioned sort.

    The sorted frame is written first: range bounds are sampled, so the
    partition numbers must be read from one stored copy.
    """
    stored = cut(df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()))
    part = F.shiftright(F.col("_mid"), 33)
    local = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    tagged = stored.withColumn("_part", part).withColumn("_local", local)
    # one row per partition of the sort: bounded by the partition count
    offsets = (
        tagged.groupBy("_part")
        .count()
        .select(
            "_part",
            F.coalesce(
                F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ).alias("_offset"),
        )
    )
    return tagged.join(offsets, "_part").select(*df.columns, (F.col("_offset") + F.col("_local")).alias(out))
