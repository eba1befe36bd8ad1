"""Mixing sources to target weights by hierarchical budgeting over domain, language and source.

The token budget goes down the tree: a node's budget is split over its children by weight, and
what a child cannot supply goes to its siblings first (water filling). A node never gets more
than its subtree can supply, so a shortage left over inside a node has been passed to the
siblings of its ancestors one level up. A leaf may be read `max_epochs` times; each epoch is a
seeded order of the leaf's documents, and the leaf takes the prefix that fills its budget.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsentry.session import cut

LEVELS = ("domain", "lang", "source")
#: Leading hex digits of a document's place: the ranges of a leaf that are summed before single documents are ordered.
BIN_DIGITS = 3
#: Share of the corpus' tokens that the mixture takes, and how often a leaf may be read.
BUDGET_SHARE = 0.5
MAX_EPOCHS = 2
SEED = 7
FAMILIES = 4


def source_family(source: Column) -> Column:
    """Default domain: the source's number modulo FAMILIES, 'other' without a number."""
    number = F.regexp_extract(source, "([0-9]{1,9})$", 1)
    return F.when(number != "", F.concat(F.lit("family"), (number.cast("long") % FAMILIES).cast("string"))).otherwise(F.lit("other"))


def _weight(level: str, weights: Mapping[str, Mapping[str, float]]) -> Column:
    given = weights.get(level) or {}
    if not given:
        return F.lit(1.0)
    pairs = [x for k, v in sorted(given.items()) for x in (F.lit(k), F.lit(float(v)))]
    return F.coalesce(F.create_map(*pairs)[F.col(level)], F.lit(1.0))


def _fill(nodes: DataFrame, parent: list[str], level: str, weights: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """Split `_budget` of each parent over its children: min(capacity, share of weight), shortages passed on by weight.

    Children in order of capacity / weight: child i is full if, with all before it full, its share
    of the rest is at least its capacity. Every share is floored to whole tokens.
    """
    order = Window.partitionBy(*parent).orderBy(F.col("_ratio"), F.col(level))
    node = Window.partitionBy(*parent)
    w = nodes.withColumn("_weight", _weight(level, weights)).withColumn("_ratio", F.when(F.col("_weight") > 0, F.col("capacity") / F.col("_weight")).otherwise(F.lit(float("inf"))))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("_used", F.coalesce(F.sum("capacity").over(before), F.lit(0))).withColumn(
        "_left", F.sum("_weight").over(node) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))
    )
    w = w.withColumn("_full", (F.col("_weight") > 0) & ((F.col("_budget") - F.col("_used")) * F.col("_weight") >= F.col("capacity") * F.col("_left")))
    full = F.col("_full")
    # Fullness is monotone along the order; what is left is shared by weight among the others.
    w = w.withColumn("_rest", F.col("_budget") - F.coalesce(F.sum(F.when(full, F.col("capacity"))).over(node), F.lit(0)))
    w = w.withColumn("_open", F.sum(F.when(~full, F.col("_weight")).otherwise(0.0)).over(node))
    share = F.when(F.col("_open") > 0, F.floor(F.col("_rest") * F.col("_weight") / F.col("_open"))).otherwise(F.lit(0))
    return w.withColumn("_budget", F.when(full, F.col("capacity")).otherwise(F.least("capacity", share)).cast("long")).drop("_weight", "_ratio", "_used", "_left", "_full", "_rest", "_open")


def leaf_budgets(leaves: DataFrame, budget_share: float = BUDGET_SHARE, max_epochs: int = MAX_EPOCHS, weights: Mapping[str, Mapping[str, float]] | None = None) -> DataFrame:
    """(domain, lang, source, tokens, capacity, budget) of leaves (domain, lang, source, tokens)."""
    weights = weights or {}
    rows = leaves.withColumn("capacity", (F.col("tokens") * max_epochs).cast("long"))
    total = rows.agg(F.sum("tokens").alias("t")).first().t or 0
    root = min(int(total * budget_share), int(total) * max_epochs)
    domains = rows.groupBy("domain").agg(F.sum("capacity").alias("capacity")).withColumns({"_budget": F.lit(root).cast("long"), "_root": F.lit(0)})
    domains = _fill(domains, ["_root"], "domain", weights).select("domain", F.col("_budget"))
    langs = rows.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity")).join(domains, "domain")
    langs = _fill(langs, ["domain"], "lang", weights).select("domain", "lang", "_budget")
    return _fill(rows.join(langs, ["domain", "lang"]), ["domain", "lang"], "source", weights).withColumnRenamed("_budget", "budget")


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", domain: Column | None = None,
    weights: Mapping[str, Mapping[str, float]] | None = None, budget_share: float = BUDGET_SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED,
) -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens, leaf_budget, copies): one row per row of `docs`.

    `copies` is how often the mixture reads the document: once per full epoch of its leaf, and once
    more if it lies in the last epoch's prefix. A document is taken when the tokens ahead of it in
    that epoch are below what the prefix needs, so a leaf overshoots by less than one document.
    Tokens are words outside ASCII white space; null text has none and is taken with its place.

    Null languages and sources are nodes named ''. Repeated rows (equal id) keep one place in the
    order, and all are taken or none. An empty table gives an empty result. A weight that is not
    given is 1; weight 0 leaves a node out.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (source_family(source) if domain is None else F.coalesce(domain.cast("string"), F.lit(""))).alias("domain"),
        F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), source.alias("source"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_tokens"),
    )
    rows = cut(rows)
    budgets = cut(leaf_budgets(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), budget_share, max_epochs, weights))
    epochs = F.when(F.col("tokens") > 0, F.least(F.lit(max_epochs), F.floor(F.col("budget") / F.col("tokens")))).otherwise(F.lit(0))
    need = budgets.select(*LEVELS, F.col("budget").alias("leaf_budget"), epochs.cast("long").alias("_epochs"), (F.col("budget") - epochs * F.col("tokens")).cast("long").alias("_need"))

    # The order of the epoch that is cut: a seeded hash of the epoch and the id.
    joined = rows.join(need, list(LEVELS))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    placed = cut(joined.withColumn("_place", digest).withColumn("_bin", F.substring("_place", 1, BIN_DIGITS)))
    bins = placed.groupBy(*LEVELS, "_bin").agg(F.sum("n_tokens").alias("_tokens"), F.min("_need").alias("_need"))
    ahead = Window.partitionBy(*LEVELS).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # 16**BIN_DIGITS rows at most
    bins = bins.withColumn("_before", F.coalesce(F.sum("_tokens").over(ahead), F.lit(0)))
    # Bins wholly inside the prefix are taken, those behind it are not; the one it ends in is ordered by document.
    state = bins.select(*LEVELS, "_bin", "_before", F.when(F.col("_need") <= F.col("_before"), 0).when(F.col("_before") + F.col("_tokens") < F.col("_need"), 2).otherwise(1).alias("_state"))
    edge = placed.join(state.where("_state = 1").select(*LEVELS, "_bin", "_before"), [*LEVELS, "_bin"])
    same = Window.partitionBy(*LEVELS, "_bin", "_place")
    upto = Window.partitionBy(*LEVELS, "_bin").orderBy("_place").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    edge = edge.withColumn("_ahead", F.col("_before") + F.sum("n_tokens").over(upto) - F.sum("n_tokens").over(same))
    taken = edge.select("doc_id", "domain", "lang", "source", "n_tokens", "leaf_budget", (F.col("_epochs") + (F.col("_ahead") < F.col("_need")).cast("long")).alias("copies"))
    rest = placed.join(state.where("_state <> 1").select(*LEVELS, "_bin", "_state"), [*LEVELS, "_bin"])
    rest = rest.select("doc_id", "domain", "lang", "source", "n_tokens", "leaf_budget", (F.col("_epochs") + (F.col("_state") == 2).cast("long")).alias("copies"))
    return taken.unionByName(rest)
