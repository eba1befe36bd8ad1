"""Column profiling and automatic mapping of unknown headers."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsentry.functions.exprs import valid_number
from flowsentry.sources.canonical import FIELDS, MANDATORY

STEP_HEADERS = ("step", "hour", "hours", "time_step")


def profile_columns(raw: DataFrame) -> DataFrame:
    """One row per column over the whole table.

    Columns are unpivoted and collapsed to (column, distinct value, count), so
    parsing tests run once per distinct value and a constant column costs one row.
    """
    text = raw.select(*[F.col(c).cast("string").alias(c) for c in raw.columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("source_column"), F.col(c).alias("value")) for c in raw.columns])
    values = (
        text.select(F.explode(pairs).alias("p"))
        .groupBy("p.source_column", "p.value")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("value", F.trim("value"))
    )
    v = F.col("value")
    number = valid_number(v.try_cast("double"))
    short_int = v.rlike(r"^\d{1,6}$")
    moment = F.when(~short_int, v.try_cast("timestamp"))
    n = F.col("n")

    def weight(cond):
        return F.coalesce(F.sum(F.when(cond, n)), F.lit(0)).cast("long")

    stats = values.groupBy("source_column").agg(
        F.sum("n").alias("row_count"),
        weight(v.isNull()).alias("null_count"),
        F.count(v).alias("unique_count"),
        weight(number.isNotNull()).alias("numeric_count"),
        weight(v.isNotNull() & ~short_int).alias("dt_candidates"),
        weight(moment.isNotNull()).alias("dt_count"),
        F.coalesce(F.bool_and((number >= 0) & (number == F.floor(number)) & (number <= 10_000)), F.lit(False)).alias("_stepish"),
        F.coalesce(F.bool_and(F.lower(v).isin("0", "1", "true", "false", "0.0", "1.0")), F.lit(False)).alias("label_like"),
    )
    present = F.greatest(F.col("row_count") - F.col("null_count"), F.lit(1))
    numeric_pct = F.col("numeric_count") * 100.0 / present
    dt_pct = F.col("dt_count") * 100.0 / F.greatest(F.col("dt_candidates"), F.lit(1))
    is_step = (numeric_pct > 95.0) & F.col("_stepish") & F.lower("source_column").isin(*STEP_HEADERS)
    profiled = stats.select(
        "source_column",
        _header(F.col("source_column")).alias("normalized_name"),
        "row_count",
        "null_count",
        (F.col("null_count") * 100.0 / F.greatest(F.col("row_count"), F.lit(1))).alias("null_percentage"),
        "unique_count",
        (F.col("unique_count") * 100.0 / present).alias("unique_percentage"),
        numeric_pct.alias("numeric_compatibility_pct"),
        F.when(is_step, 0.0).otherwise(dt_pct).alias("datetime_compatibility_pct"),
        is_step.alias("is_integer_step"),
        "label_like",
    )
    kind = (
        F.when(F.col("is_integer_step"), "integer_step")
        .when(F.col("datetime_compatibility_pct") >= 80.0, "datetime")
        .when(F.col("numeric_compatibility_pct") >= 80.0, "numeric")
        .otherwise("string")
    )
    return profiled.withColumn("inferred_type", kind)


def _header(name):
    lowered = F.regexp_replace(F.lower(F.trim(name)), r"[-\s./]", "_")
    return F.regexp_replace(lowered, "_+", "_")


def sample_values(raw: DataFrame, k: int = 5) -> DataFrame:
    """Up to k distinct example values per column (k smallest), one top-k query each."""
    out = None
    for name in raw.columns:
        top = (
            raw.select(F.trim(F.col(name).cast("string")).alias("value"))
            .where(F.col("value").isNotNull())
            .distinct()
            .orderBy("value")
            .limit(k)
            .select(F.lit(name).alias("source_column"), "value")
        )
        out = top if out is None else out.unionByName(top)
    return out


@dataclass
class Mapping:
    columns: dict[str, str]
    decisions: list[dict]
    missing_required: list[str] = field(default_factory=list)

    @property
    def can_predict(self) -> bool:
        return not self.missing_required

    @property
    def can_train(self) -> bool:
        return self.can_predict and "is_mule_pattern" in self.columns.values()

    @property
    def status(self) -> str:
        if not self.can_predict:
            return "dataset_not_applicable"
        auto = all(d["status"] == "auto" for d in self.decisions if d["target"] in MANDATORY)
        return "auto_ready" if auto else "mapping_required"


def score_candidates(profile: DataFrame) -> DataFrame:
    """Confidence of every (source column, canonical field) pair.

    Both sides are as small as a header row: the profile has one row per source
    column and the field table is fixed.
    """
    spark = profile.sparkSession
    fields = spark.createDataFrame(
        [(f.name, f.kind, list(f.aliases), i) for i, f in enumerate(FIELDS)],
        "target string, kind string, aliases array<string>, field_order int",
    )
    fields_array = fields.agg(F.sort_array(F.collect_list(F.struct("field_order", "target", "kind", "aliases")))).scalar()
    pairs = profile.withColumn("f", F.explode(fields_array)).select("*", "f.*").drop("f")
    source, target = F.col("normalized_name"), F.col("target")
    longest = F.greatest(F.length(source), F.length(target))
    similarity = F.when(source == target, 1.0).otherwise(1.0 - F.levenshtein(source, target) / longest)
    exact = (source == target) | F.array_contains("aliases", source)
    near = F.exists("aliases", lambda a: (F.length(a) > 3) & (F.contains(source, a) | F.contains(a, source)))
    alias = F.when(exact, 1.0).when(near, 0.85).otherwise(0.0)
    kind, inferred = F.col("kind"), F.col("inferred_type")
    type_fit = (
        F.when(kind.isin("float", "integer"), F.when(inferred.isin("numeric", "integer_step"), 1.0).otherwise(0.0))
        .when(kind == "datetime", F.when(inferred.isin("datetime", "integer_step"), 1.0).otherwise(0.0))
        .otherwise(1.0)
    )
    numeric, moment = F.col("numeric_compatibility_pct"), F.col("datetime_compatibility_pct")
    pattern = (
        F.when(target == "amount", F.when((numeric >= 80.0) & ~F.col("is_integer_step"), 1.0).otherwise(0.0))
        .when(target == "timestamp", F.when(F.col("is_integer_step") | (moment >= 80.0), 1.0).otherwise(0.0))
        .when(
            target == "transaction_type",
            F.when((inferred == "string") & (numeric < 50.0) & (moment < 50.0), 1.0).otherwise(0.5),
        )
        .when(
            target.isin("sender_account_id", "receiver_account_id", "transaction_id"),
            F.when(inferred != "datetime", 1.0).otherwise(0.5),
        )
        .when(target == "is_mule_pattern", F.when(F.col("label_like"), 1.0).otherwise(0.5))
        .otherwise(0.8)
    )
    scored = pairs.withColumns({"header_similarity": similarity, "alias_score": alias, "type_score": type_fit, "value_score": pattern})
    raw = (
        0.40 * F.greatest("header_similarity", "alias_score")
        + 0.25 * F.col("alias_score")
        + 0.20 * F.col("type_score")
        + 0.15 * F.col("value_score")
    )
    raw = F.when(
        (target == "transaction_type") & (F.col("value_score") == 1.0) & (F.col("type_score") == 1.0), F.greatest(F.lit(0.85), raw)
    ).otherwise(raw)
    confidence = (
        F.when(exact & (F.col("value_score") > 0.5), F.lit(0.99))
        .when((F.col("alias_score") > 0) & (F.col("value_score") > 0.5), F.greatest(F.lit(0.92), F.round(raw, 2)))
        .otherwise(F.round(F.least(F.lit(1.0), raw), 2))
    )
    return scored.withColumn("confidence", confidence).select(
        "source_column", "target", "field_order", "header_similarity", "alias_score", "type_score", "value_score", "confidence"
    )


def map_columns(profile: DataFrame, header: list[str]) -> Mapping:
    """Greedy assignment of source columns to canonical fields by confidence.

    Works on the candidate table only, whose size is header x fields.
    """
    candidates: dict[str, list] = {name: [] for name in header}
    for row in score_candidates(profile).where("confidence > 0.25").collect():
        candidates[row.source_column].append(row)
    for rows in candidates.values():
        rows.sort(key=lambda r: (-r.confidence, r.field_order))
    ranked = sorted(header, key=lambda c: (-(candidates[c][0].confidence if candidates[c] else 0.0), header.index(c)))
    taken: set[str] = set()
    chosen: dict[str, tuple[str | None, float]] = {}
    for name in ranked:
        pick = next((r for r in candidates[name] if r.target not in taken), None)
        if pick is not None:
            taken.add(pick.target)
        chosen[name] = (pick.target, pick.confidence) if pick is not None else (None, 0.0)
    decisions = []
    for name in header:
        target, confidence = chosen[name]
        status = "unmapped" if target is None else "manual"
        if target is not None and confidence >= 0.90:
            status = "auto"
        elif target is not None and confidence >= 0.70:
            status = "review"
        decisions.append({"source": name, "target": target, "confidence": confidence, "status": status})
    columns = {d["source"]: d["target"] for d in decisions if d["status"] in ("auto", "review")}
    missing = [m for m in MANDATORY if m not in columns.values()]
    return Mapping(columns, decisions, missing)
