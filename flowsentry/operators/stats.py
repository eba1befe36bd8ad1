"""Distribution statistics of feature columns against a label, and drift.

Wide tables are unpivoted and collapsed to (feature, value, counts) before any
ordering. Ranks, curves and quantiles then run on distinct values inside value
segments, so a column with one dominant value or many rows never sits in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsentry.functions.exprs import normal_sf2, safe_div
from flowsentry.functions.segments import even_segments, quantiles, row_index, running_totals
from flowsentry.session import cut

# Drift and retention thresholds.
PSI_WARNING, PSI_CRITICAL = 0.10, 0.25
PSI_EPS = 1e-4
MISSING_LIMIT, COMPOSITE_LIMIT = 0.30, 0.05


def unpivot(df: DataFrame, columns: list[str], *keep: Column | str) -> DataFrame:
    """(keep..., feature, value) rows of the given numeric columns."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    long = df.select(*keep, F.explode(pairs).alias("_p"))
    return long.select(*[c for c in long.columns if c != "_p"], "_p.feature", "_p.value")


def value_counts(long: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """(keys, value, n1, n0, n) with its value segment; nulls left out."""
    counted = (
        long.where(F.col("value").isNotNull())
        .groupBy(*keys, "value")
        .agg(F.count_if(F.col(label) == 1).alias("n1"), F.count_if(F.col(label) == 0).alias("n0"))
        .withColumn("n", F.col("n1") + F.col("n0"))
    )
    return even_segments(counted, keys, "value")


def feature_counts(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Value counts of many columns, stored: ranks and quantiles read them several times."""
    return cut(value_counts(unpivot(df, columns, F.col(label).cast("int").alias("label")), ["feature"]))


def missingness(df: DataFrame, columns: list[str]) -> DataFrame:
    wide = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    lines = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("missing_fraction")) for c in columns])
    return wide.select(F.explode(lines).alias("l")).select("l.*")


def _ranked(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Average rank of every distinct value, with class totals of its key."""
    cum = running_totals(counts, keys, "value", {"n1": "cum1", "n0": "cum0"})
    totals = counts.groupBy(*keys).agg(F.sum("n1").alias("t1"), F.sum("n0").alias("t0"))
    before = F.col("cum1") + F.col("cum0") - F.col("n")
    ranked = cum.withColumn("avg_rank", before + (F.col("n") + 1) / F.lit(2.0))
    return ranked.join(totals, keys) if keys else ranked.select("*", totals.select("t1").scalar().alias("t1"), totals.select("t0").scalar().alias("t0"))


def mann_whitney(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """U, two-sided p (normal approximation, tie and continuity corrected), |rank-biserial|."""
    counts = feature_counts(df, columns, label)
    n = F.col("n").cast("double")
    sums = _ranked(counts, ["feature"]).groupBy("feature").agg(
        F.sum(F.col("n1") * F.col("avg_rank")).alias("r1"),
        F.sum(n * n * n - n).alias("ties"),
        F.max("t1").alias("t1"),
        F.max("t0").alias("t0"),
    )
    t1, t0 = F.col("t1").cast("double"), F.col("t0").cast("double")
    total = t1 + t0
    u = F.col("r1") - t1 * (t1 + 1) / 2
    spread = F.sqrt(t1 * t0 / 12 * ((total + 1) - F.col("ties") / (total * (total - 1))))
    z = (F.greatest(u, t1 * t0 - u) - t1 * t0 / 2 - 0.5) / spread
    p = F.when((spread > 0), F.least(F.lit(1.0), F.when(z > 0, normal_sf2(z)).otherwise(1.0))).otherwise(1.0)
    both = (F.col("t1") > 0) & (F.col("t0") > 0)
    return sums.select(
        "feature",
        F.when(both, u).otherwise(0.0).alias("u_statistic"),
        F.when(both, p).otherwise(1.0).alias("p_value"),
        F.when(both, F.abs(1 - 2 * u / (t1 * t0))).otherwise(0.0).alias("effect_size"),
    )


def ks_two_sample(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic and asymptotic p-value."""
    counts = feature_counts(df, columns, label)
    gap = F.abs(F.col("cum1") / F.col("t1") - F.col("cum0") / F.col("t0"))
    stat = _ranked(counts, ["feature"]).groupBy("feature").agg(
        F.max(F.when((F.col("t1") > 0) & (F.col("t0") > 0), gap).otherwise(0.0)).alias("ks_statistic"),
        F.max("t1").alias("t1"),
        F.max("t0").alias("t0"),
    )
    en = F.sqrt(F.col("t1") * F.col("t0") / (F.col("t1") + F.col("t0")).cast("double"))
    lam = en * F.col("ks_statistic")
    # Kolmogorov series; 20 terms are exact to double precision once lam > 0.2
    terms = F.transform(
        F.sequence(F.lit(1), F.lit(20)), lambda k: F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * lam * lam)
    )
    series = F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)
    p = F.when(lam <= 0.2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), series)))
    return stat.select("feature", "ks_statistic", p.alias("p_value"))


def roc_auc(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Exact ROC-AUC per score column (ties count one half); 0.5 with one class."""
    counts = feature_counts(df, columns, label)
    sums = _ranked(counts, ["feature"]).groupBy("feature").agg(
        F.sum(F.col("n1") * F.col("avg_rank")).alias("r1"), F.max("t1").alias("t1"), F.max("t0").alias("t0")
    )
    t1, t0 = F.col("t1").cast("double"), F.col("t0").cast("double")
    auc = (F.col("r1") - t1 * (t1 + 1) / 2) / (t1 * t0)
    return sums.select("feature", F.when((t1 > 0) & (t0 > 0), auc).otherwise(0.5).alias("roc_auc"))


def curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """One point per distinct score, from high to low: counts, precision, recall, FPR, TPR."""
    counts = value_counts(df.select(F.col(score).cast("double").alias("value"), F.col(label).alias("label")), [])
    cum = running_totals(counts, [], "value", {"n1": "tp", "n0": "fp"}, descending=True)
    t1 = counts.agg(F.sum("n1")).scalar()
    t0 = counts.agg(F.sum("n0")).scalar()
    return cum.select(
        F.col("value").alias("threshold"), "n1", "tp", "fp",
        safe_div(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        safe_div(F.col("tp"), t1).alias("recall"),
        safe_div(F.col("fp"), t0).alias("false_positive_rate"),
    )


def average_precision(df: DataFrame, score: str, label: str) -> DataFrame:
    """PR-AUC as the step-wise sum of precision over recall increments."""
    points = curve(df, score, label)
    return points.agg(safe_div(F.sum(F.col("n1") * F.col("precision")), F.sum("n1")).alias("average_precision"))


def correlations(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Pearson and Spearman of each column with a 0/1 label; constant columns give 0."""
    counts = feature_counts(df, columns, label)
    # centred sums: means first (one row per feature), then deviations from them
    total_n = F.sum("n").cast("double")
    means = counts.groupBy("feature").agg(
        (F.sum(F.col("n") * F.col("value")) / total_n).alias("mx"), (F.sum("n1") / total_n).alias("my"), total_n.alias("tn")
    )
    dx, my = F.col("value") - F.col("mx"), F.col("my")
    dev = counts.join(means, "feature").groupBy("feature").agg(
        F.sum(F.col("n") * dx * dx).alias("sxx"), F.sum((F.col("n1") - F.col("n") * my) * dx).alias("sxy"),
        F.max(F.col("tn") * my * (1 - my)).alias("syy"), F.max("tn").alias("tn"),
    )
    varied = (F.sqrt(F.col("sxx") / F.col("tn")) > 1e-12) & (F.sqrt(F.col("syy") / F.col("tn")) > 1e-12)
    pearson = dev.select(
        "feature", F.coalesce(F.when(varied, F.try_divide(F.col("sxy"), F.sqrt(F.col("sxx") * F.col("syy")))), F.lit(0.0)).alias("pearson")
    )
    ranked = _ranked(counts, ["feature"])
    n, r = F.col("n").cast("double"), F.col("avg_rank")
    sums = ranked.groupBy("feature").agg(
        F.max("t1").cast("double").alias("t1"),
        F.max("t0").cast("double").alias("t0"),
        F.sum(n * r * r).alias("rr"),
        F.sum(F.col("n1") * r).alias("r1"),
    )
    t1, t0 = F.col("t1"), F.col("t0")
    total = t1 + t0
    mean_rank = (total + 1) / 2
    # the label has two rank values, (t0+1)/2 and t0+(t1+1)/2, which differ by total/2
    cov = (F.col("r1") - t1 * mean_rank) * total / 2
    var_r = F.col("rr") - total * mean_rank * mean_rank
    var_l = t1 * t0 / total * (total / 2) * (total / 2)
    spearman = F.when((var_r > 1e-9) & (var_l > 1e-9), cov / F.sqrt(var_r * var_l)).otherwise(0.0)
    return pearson.join(sums.select("feature", spearman.alias("spearman")), "feature")


def _bin_edges(counts: DataFrame, keys: list[str], bins: int, count: str = "n") -> DataFrame:
    """Distinct quantile edges per key as one small array."""
    probs = {f"q{i}": i / bins for i in range(bins + 1)}
    cuts = quantiles(counts, keys, "value", count, probs)
    return cuts.select(*keys, F.array_sort(F.array_distinct(F.array(*probs))).alias("edges"))


def _bin_of(value: Column, edges: Column) -> Column:
    """0-based bin among inner edges: [e1, e2), outer bins open-ended."""
    inner = F.slice(edges, 2, F.greatest(F.size(edges) - 2, F.lit(0)))
    return F.size(F.filter(inner, lambda e: e <= value))


def mutual_information(df: DataFrame, columns: list[str], label: str, bins: int = 10) -> DataFrame:
    """Plug-in mutual information (nats) between quantile-binned columns and the label."""
    counts = feature_counts(df, columns, label)
    binned = counts.join(_bin_edges(counts, ["feature"], bins), "feature").groupBy("feature", _bin_of(F.col("value"), F.col("edges")).alias("bin")).agg(
        F.sum("n1").alias("n1"), F.sum("n0").alias("n0")
    )
    whole = Window.partitionBy("feature")
    cells = binned.select("feature", "n1", "n0", F.sum("n1").over(whole).alias("t1"), F.sum("n0").over(whole).alias("t0"))
    total = (F.col("t1") + F.col("t0")).cast("double")
    row = (F.col("n1") + F.col("n0")).cast("double")

    def term(joint: Column, marginal: Column) -> Column:
        j = joint.cast("double")
        return F.when(j > 0, j / total * F.ln(j * total / (row * marginal.cast("double")))).otherwise(0.0)

    return cells.groupBy("feature").agg(
        F.greatest(F.lit(0.0), F.sum(term(F.col("n1"), F.col("t1")) + term(F.col("n0"), F.col("t0")))).alias("mi_score")
    )


def psi(df: DataFrame, columns: list[str], is_recent: str, bins: int = 10) -> DataFrame:
    """Population stability index per column between baseline and recent rows."""
    counts = feature_counts(df, columns, is_recent)
    base = counts.where(F.col("n0") > 0)
    binned = counts.join(_bin_edges(base, ["feature"], bins, "n0"), "feature", "left").groupBy("feature", _bin_of(F.col("value"), F.col("edges")).alias("bin")).agg(
        F.sum("n1").alias("n1"), F.sum("n0").alias("n0"), F.max(F.size("edges")).alias("n_edges")
    )
    whole = Window.partitionBy("feature")
    cells = binned.select(
        "feature", "n1", "n0", "n_edges", F.sum("n1").over(whole).alias("t1"), F.sum("n0").over(whole).alias("t0")
    )
    recent = F.when(F.col("n1") == 0, PSI_EPS).otherwise(F.col("n1") / F.col("t1"))
    expected = F.when(F.col("n0") == 0, PSI_EPS).otherwise(F.col("n0") / F.col("t0"))
    usable = (F.col("n_edges") > 1) & (F.col("t1") > 0) & (F.col("t0") > 0)
    part = F.when(usable, (recent - expected) * F.ln(recent / expected)).otherwise(0.0)
    return cells.groupBy("feature").agg(F.sum(part).alias("psi"))


def drift_metrics(
    df: DataFrame, columns: list[str], is_recent: str, warning: float = PSI_WARNING, critical: float = PSI_CRITICAL
) -> DataFrame:
    """PSI, population mean/std of both slices and status per column."""
    long = unpivot(df, columns, F.col(is_recent).cast("int").alias("recent"))

    def moment(fn, which: int, name: str) -> Column:
        return F.coalesce(fn(F.when(F.col("recent") == which, F.col("value"))), F.lit(0.0)).alias(name)

    moments = long.groupBy("feature").agg(
        moment(F.avg, 0, "baseline_mean"), moment(F.stddev_pop, 0, "baseline_std"),
        moment(F.avg, 1, "recent_mean"), moment(F.stddev_pop, 1, "recent_std"),
    )
    status = F.when(F.col("psi") >= critical, "CRITICAL").when(F.col("psi") >= warning, "WARNING").otherwise("NORMAL")
    return moments.join(psi(df, columns, is_recent), "feature").withColumn("status", status)


def drift_summary(metrics: DataFrame) -> DataFrame:
    severe, warned = F.count_if(F.col("status") == "CRITICAL"), F.count_if(F.col("status") == "WARNING")
    return metrics.agg(
        F.avg("psi").alias("overall_psi"), severe.alias("critical_features"), warned.alias("warning_features"),
        F.when(severe > 0, "CRITICAL").when(warned > 0, "WARNING").otherwise("NORMAL").alias("drift_status"),
        F.when(severe > 0, "HIGH").when(warned > 0, "MODERATE").otherwise("LOW").alias("severity"),
    )


def composite_ranking(metrics: DataFrame, parts: list[str], missing: str = "missing_fraction") -> DataFrame:
    """Mean of min-max-normalised metric columns, ranks and the retention decision.

    `metrics` has one row per feature, so its windows are as small as the schema.
    """
    metrics = cut(metrics)
    bounds = metrics.agg(
        F.struct(*[F.min(p).alias(f"{p}_low") for p in parts], *[F.max(p).alias(f"{p}_high") for p in parts]).alias("b")
    )
    bounded = metrics.withColumn("_b", bounds.scalar())

    def norm(p: str) -> Column:
        low, span = F.col(f"_b.{p}_low"), F.col(f"_b.{p}_high") - F.col(f"_b.{p}_low")
        return F.when(span < 1e-9, F.lit(0.0)).otherwise((F.col(p) - low) / span)

    score = sum((norm(p) for p in parts[1:]), norm(parts[0])) / float(len(parts))
    ranked = cut(bounded.withColumn("composite_score", F.round(score, 6)).drop("_b"))
    decided = F.when((F.col(missing) > MISSING_LIMIT) & (F.col("composite_score") < COMPOSITE_LIMIT), "REJECTED").otherwise("RETAINED")
    return ranked.select(
        *metrics.columns,
        "composite_score",
        F.row_number().over(Window.orderBy(F.desc("composite_score"), "feature")).alias("composite_rank"),
        *[F.rank().over(Window.orderBy(F.desc(p))).alias(f"{p}_rank") for p in parts],
        decided.alias("retention_decision"),
    )


def class_comparison(df: DataFrame, score: str, label: str) -> DataFrame:
    """Count, mean and median of a score per class, and the mean ratio."""
    counts = df.groupBy(F.col(label).alias("label"), F.col(score).cast("double").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    medians = quantiles(counts, ["label"], "value", "n", {"median_score": 0.5})
    stats = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("accounts"), F.avg(score).alias("mean_score"))
    clean_mean = df.where(F.col(label) == 0).agg(F.avg(score)).scalar()
    return stats.join(medians, "label").withColumn(
        "ratio_to_clean", F.col("mean_score") / (F.coalesce(clean_mean, F.lit(0.0)) + F.lit(1e-9))
    )


def percentile_of(df: DataFrame, score: str, out: str = "percentile") -> DataFrame:
    """Average rank of each row's score, as a percentage of all rows."""
    counts = even_segments(df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("value")).agg(F.count(F.lit(1)).alias("n")), [], "value")
    cum = running_totals(counts, [], "value", {"n": "cum"})
    total = counts.agg(F.sum("n")).scalar()
    rank = F.col("cum") - F.col("n") + (F.col("n") + 1) / F.lit(2.0)
    placed = cum.select(F.col("value").alias(score), (rank * 100.0 / total).alias(out))
    # A row without a score has no percentile.
    return df.join(placed, score, "left").select(*df.columns, out)


def slice_by_order(df: DataFrame, order: str = "account_id", fraction: float = 0.6, out: str = "is_recent") -> DataFrame:
    """Mark the rows after the first `fraction` of a total order (baseline / recent)."""
    indexed = row_index(df, [F.col(order)], "_row")
    total = df.agg(F.count(F.lit(1))).scalar()
    return indexed.withColumn(out, F.when(F.col("_row") >= F.floor(total * F.lit(fraction)), 1).otherwise(0).cast("int")).drop("_row")
