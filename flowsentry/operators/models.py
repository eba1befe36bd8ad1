"""Splits, classifiers, evaluation, benchmarking, clustering."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsentry.functions.segments import quantiles, row_index
from flowsentry.operators import stats
from flowsentry.operators.boosting import GRID, BoostedTrees, Setting, fit_grid
from flowsentry.operators.isolation import IsolationForest
from flowsentry.operators.scoring import ARCHETYPE_FEATURES, threshold_table
from flowsentry.session import cut

# Split shares, probability cuts, trees of the fallback forest.
SPLIT = (0.60, 0.20, 0.20)
CUTS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
FALLBACK_TREES = 200


def temporal_split(df: DataFrame, order: str, shares=SPLIT) -> DataFrame:
    """Add `fold`: oldest rows train, then validation, newest test; ties by account."""
    indexed = row_index(df, [F.col(order), F.col("account_id")], "_row")
    n = df.count()
    first = int(n * shares[0])
    second = first + int(n * shares[1])
    fold = F.when(F.col("_row") < first, "train").when(F.col("_row") < second, "validation").otherwise("test")
    return indexed.withColumn("fold", fold).drop("_row")


def stratified_split(df: DataFrame, label: str, shares=SPLIT, seed: int = 42) -> DataFrame:
    """Add `fold` with the same class shares in each; a seeded hash decides. Rows without a label are "unlabelled".

    The cuts are exact quantiles of the hash per class, so no class is gathered
    or ordered in one task.
    """
    draw = (F.pmod(F.xxhash64(F.lit(seed), "account_id"), F.lit(1 << 31)) / float(1 << 31)).alias("value")
    counts = df.select(F.col(label).alias("_class"), draw).groupBy("_class", "value").agg(F.count(F.lit(1)).alias("n"))
    cuts = quantiles(counts, ["_class"], "value", "n", {"_a": shares[0], "_b": shares[0] + shares[1]})
    drawn = df.withColumn("_u", draw).join(cuts, F.col(label) == F.col("_class"), "left")
    fold = F.when(F.col(label).isNull(), "unlabelled").when(F.col("_u") < F.col("_a"), "train").when(F.col("_u") < F.col("_b"), "validation").otherwise("test")
    return drawn.withColumn("fold", fold).drop("_u", "_a", "_b", "_class")


def auto_split(df: DataFrame, label: str, time_columns=("first_transaction_time", "timestamp", "created_at"), seed: int = 42) -> DataFrame:
    """Temporal split on the first time column present, else a stratified one."""
    for name in time_columns:
        if name in df.columns:
            return temporal_split(df, name)
    return stratified_split(df, label, seed=seed)


def split_report(split: DataFrame, label: str, order: str | None = None) -> DataFrame:
    """Rows, class counts and period of every fold."""
    period = [F.min(order).cast("string").alias("first"), F.max(order).cast("string").alias("last")] if order else []
    return split.groupBy("fold").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col(label) == 1).alias("positives"), F.count_if(F.col(label) == 0).alias("negatives"), *period
    )


def _weighted(df: DataFrame, label: str) -> DataFrame:
    """Positive rows weigh n0/n1, at least 1."""
    counts = df.where(F.col("fold") == "train").agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q")).first()
    ratio = max(1.0, counts.q / counts.p) if counts.p else 1.0
    return df.withColumn("_weight", F.when(F.col(label) == 1, ratio).otherwise(1.0)).withColumn("label", F.col(label).cast("double"))


def with_probability(model, df: DataFrame) -> DataFrame:
    """Add probability_1 by boosted trees or a fitted pipeline."""
    if isinstance(model, BoostedTrees):
        return model.with_probability(df)
    return model.transform(df).withColumn("probability_1", vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction", "features")


def evaluate(scored: DataFrame, label: str, cut_at: float = 0.5) -> DataFrame:
    """One row: confusion counts, precision, recall, F1, ROC-AUC and PR-AUC."""
    stored = cut(scored.select("account_id", F.col(label).alias("label"), "probability_1"))
    base = threshold_table(stored, "probability_1", "label", [cut_at]).select(
        "precision", "recall", F.col("f1_score").alias("f1"), "tp", "fp", "tn", "fn"
    )
    auc = stats.roc_auc(stored, ["probability_1"], "label").select("roc_auc").scalar()
    ap = stats.average_precision(stored, "probability_1", "label").scalar()
    return base.select("*", F.coalesce(auc, F.lit(0.5)).alias("roc_auc"), ap.alias("pr_auc"))


@dataclass
class Trained:
    """A fitted model with the parameters chosen, its metrics on the test and on the validation fold."""

    model: BoostedTrees | PipelineModel
    columns: list[str]
    params: dict
    metrics: DataFrame
    name: str = "boosted trees"
    validation: DataFrame | None = None

    def importances(self) -> DataFrame:
        """Importance per feature with rank (sums to 1)."""
        weights = self.model.importances() if isinstance(self.model, BoostedTrees) else [float(x) for x in self.model.stages[-1].featureImportances.toArray()]
        rows = sorted(zip(self.columns, weights), key=lambda r: (-r[1], r[0]))
        return self.metrics.sparkSession.createDataFrame(
            [(name, w, i + 1) for i, (name, w) in enumerate(rows)], "feature string, importance double, importance_rank int"
        )

    def top_features(self, k: int = 3) -> list[str]:
        return [r.feature for r in self.importances().where(F.col("importance_rank") <= k).orderBy("importance_rank").collect()]

    def save(self, path: str) -> None:
        """Model, metrics, feature schema with importances, and parameters."""
        if isinstance(self.model, BoostedTrees):
            self.model.save(self.metrics.sparkSession, f"{path}/model")
        else:
            self.model.write().overwrite().save(f"{path}/model")
        self.metrics.coalesce(1).write.mode("overwrite").json(f"{path}/metrics")
        self.importances().coalesce(1).write.mode("overwrite").json(f"{path}/feature_schema")
        params = [(k, str(v)) for k, v in self.params.items()]
        self.metrics.sparkSession.createDataFrame(params, "name string, value string").coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def load_model(spark: SparkSession, path: str) -> BoostedTrees | PipelineModel:
    """The model that `Trained.save` put below `path`."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/model/stages")
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return PipelineModel.load(f"{path}/model")
    return BoostedTrees.load(spark, f"{path}/model")


def train_boosted(split: DataFrame, columns: list[str], label: str, grid: tuple[Setting, ...] = GRID, seed: int = 42) -> Trained:
    """Boosted trees: the setting of the best validation PR-AUC, each setting stopped early on the validation loss."""
    data = cut(split.where(F.col(label).isNotNull()))
    held, test = data.where(F.col("fold") == "validation"), data.where(F.col("fold") == "test")
    best = None
    for setting, model, losses in fit_grid(data, columns, label, grid, seed):
        quality = stats.average_precision(model.with_probability(held), "probability_1", label).first()[0] or 0.0
        if best is None or quality > best[0]:
            best = (quality, model, setting, losses)
    quality, model, setting, losses = best
    kept = {**vars(setting), "trees": len(model.trees), "validation_pr_auc": quality, "validation_loss": min(losses, default=None)}
    return Trained(model, columns, kept, evaluate(model.with_probability(test), label), validation=evaluate(model.with_probability(held), label))


def train_or_detect(split: DataFrame, columns: list[str], label: str, contamination: float = 0.05, **options):
    """Boosted trees, or an isolation forest when the labels have fewer than two classes."""
    if split.select(label).where(F.col(label).isNotNull()).distinct().count() < 2:
        return IsolationForest.fit(split, columns, trees=FALLBACK_TREES, contamination=contamination)
    return train_boosted(split, columns, label, **options)


def benchmark(split: DataFrame, columns: list[str], label: str, grid: tuple[Setting, ...] = GRID, trees: int = 100, seed: int = 42, boosted: Trained | None = None) -> dict[str, Trained]:
    """Logistic regression, random forest and boosted trees on identical folds; `boosted` is used if it was fitted on them before."""
    data = cut(_weighted(split, label))
    train, held, test = (data.where(F.col("fold") == fold) for fold in ("train", "validation", "test"))
    assemble = VectorAssembler(inputCols=columns, outputCol="raw")
    scaled = StandardScaler(inputCol="raw", outputCol="features", withMean=True)
    plain = VectorAssembler(inputCols=columns, outputCol="features")
    common = {"featuresCol": "features", "labelCol": "label", "weightCol": "_weight"}
    pipelines = {
        "logistic regression": Pipeline(stages=[assemble, scaled, LogisticRegression(**common)]),
        "random forest": Pipeline(stages=[plain, RandomForestClassifier(numTrees=trees, maxDepth=8, seed=seed, **common)]),
    }
    results = {}
    for name, pipeline in pipelines.items():
        model = pipeline.fit(train)
        results[name] = Trained(model, columns, {"name": name}, evaluate(with_probability(model, test), label), name, evaluate(with_probability(model, held), label))
    results["boosted trees"] = boosted or train_boosted(split, columns, label, grid, seed)
    return results


def benchmark_table(results: dict[str, Trained]) -> DataFrame:
    """Test and validation metrics of all models, the best by (PR-AUC, F1) on the test fold marked."""
    table = None
    for name, trained in results.items():
        held = trained.validation.select(F.struct(*[F.col(c).alias(f"validation_{c}") for c in trained.validation.columns])).scalar()
        row = trained.metrics.withColumn("_held", held).select("*", "_held.*").drop("_held").withColumn("model", F.lit(name))
        table = row if table is None else table.unionByName(row)
    best = table.agg(F.max_by("model", F.struct("pr_auc", "f1", "model"))).scalar()
    return table.withColumn("recommended", F.when(F.col("model") == best, 1).otherwise(0).cast("int"))


def benchmark_curves(results: dict[str, Trained], test: DataFrame, label: str) -> DataFrame:
    """Confusion counts and rates of every model at every probability cut."""
    curves = None
    for name, trained in results.items():
        curve = trade_off(trained, test, label).withColumn("model", F.lit(name))
        curves = curve if curves is None else curves.unionByName(curve)
    return curves


def trade_off(trained: Trained, test: DataFrame, label: str) -> DataFrame:
    return threshold_table(with_probability(trained.model, test), "probability_1", label, CUTS)


def cluster_accounts(features: DataFrame, k: int = 5, seed: int = 42, columns: list[str] | None = None) -> DataFrame:
    """(account_id, cluster_id) from k-means on standardised archetype features."""
    columns = columns or ARCHETYPE_FEATURES
    data = cut(features.select("account_id", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns]))
    k = min(k, data.count())
    steps = [
        VectorAssembler(inputCols=columns, outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=True),
        KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster_id"),
    ]
    return Pipeline(stages=steps).fit(data).transform(data).select("account_id", "cluster_id")
