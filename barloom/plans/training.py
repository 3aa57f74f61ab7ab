"""Training and scoring of classifiers on bar features, with Spark ML."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel, Pipeline
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import selecting
from barloom.operators.features import feature_matrix, forward_label, temporal_split
from barloom.operators.positions import latch_probability
from barloom.operators.scaling import Scaler, feature_columns, fit_scaler
from barloom.operators.scoring import classifier_metrics
from barloom.operators.series import BARS, Layout
from barloom.session import materialize
from barloom.sources import artefacts

MODELS = ("random_forest", "gradient_boosting", "xgboost")


@dataclass(frozen=True)
class TrainingConfig:
    model: str = "random_forest"
    horizon: int = 1
    threshold: float = 0.001
    scaler: str = "minmax"
    split: tuple[float, float, float] = (0.6, 0.2, 0.2)
    min_auc: float = selecting.MIN_AUC
    feature_score: str = "rank"
    trees: int | None = None
    seed: int = 42
    layout: Layout = field(default=BARS)


@dataclass(frozen=True)
class TrainedModel:
    model: PipelineModel
    scaler: Scaler
    features: list[str]

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``probability`` of class 1 and ``prediction``; the features must be in ``df``."""
        missing = [f for f in self.features if f not in df.columns]
        if missing:
            raise ValueError(f"features not available: {missing}")
        scaled = self.scaler.transform(df.select(*_keys(df), *self.features))
        out = self.model.transform(scaled)
        return out.select(
            *_keys(df),
            vector_to_array("probability")[1].alias("probability"),
            F.col("prediction").cast("int").alias("prediction"),
        )

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        self.model.write().overwrite().save(f"{path}/model")
        self.scaler.frame(spark).withColumn("kind", F.lit(self.scaler.kind)).coalesce(1).write.mode("overwrite").parquet(f"{path}/scaler")
        names = [(i, f) for i, f in enumerate(self.features)]
        spark.createDataFrame(names, "position int, feature string").coalesce(1).write.mode("overwrite").parquet(f"{path}/features")

    def publish(self, root: str, key: str, kind: str, stamp: str, metric: float | None = None) -> str:
        """Save under ``root`` and add the model to its index, see ``artefacts``. Returns the path."""
        spark = SparkSession.active()
        path = f"{root}/{key}_{kind}_{stamp}"
        self.save(path)
        artefacts.record(spark, root, kind, key, stamp, path, metric)
        return path

    @staticmethod
    def load_latest(spark: SparkSession, root: str, key: str, kind: str) -> "TrainedModel":
        return TrainedModel.load(spark, artefacts.latest_path(spark, root, kind, key))

    @staticmethod
    def load(spark: SparkSession, path: str) -> "TrainedModel":
        params = spark.read.parquet(f"{path}/scaler").collect()
        scaler = Scaler(params[0]["kind"], {r["feature"]: (r["center"], r["scale"], r["lower"], r["upper"]) for r in params})
        names = spark.read.parquet(f"{path}/features").orderBy("position").collect()
        return TrainedModel(PipelineModel.load(f"{path}/model"), scaler, [r["feature"] for r in names])


def _keys(df: DataFrame) -> list[str]:
    return [c for c in ("symbol", "ts", "day", "event_id", "label", "split") if c in df.columns]


def classifier(kind: str, trees: int | None = None, seed: int = 42):
    """Estimators with the usual settings; the boosted variant stands in where xgboost is asked for."""
    common = {"featuresCol": "features", "labelCol": "label", "seed": seed, "weightCol": "weight"}
    if kind == "random_forest":
        return RandomForestClassifier(numTrees=trees or 100, maxDepth=10, minInstancesPerNode=25, **common)
    if kind == "gradient_boosting":
        return GBTClassifier(maxIter=trees or 100, maxDepth=5, stepSize=0.1, **common)
    if kind == "xgboost":
        return GBTClassifier(maxIter=trees or 200, maxDepth=4, stepSize=0.05, **common)
    raise ValueError(f"unknown model {kind!r}; known: {MODELS}")


def with_weights(train: DataFrame, kind: str) -> DataFrame:
    """Balanced classes for forests, positives weighted by neg/pos for xgboost, none otherwise."""
    counts = train.agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")).first()
    pos, neg = max(counts["pos"], 1), max(counts["neg"], 1)
    weights = {
        "random_forest": ((pos + neg) / (2.0 * pos), (pos + neg) / (2.0 * neg)),
        "xgboost": (neg / pos, 1.0),
    }.get(kind, (1.0, 1.0))
    return train.withColumn("weight", F.when(F.col("label") == 1, weights[0]).otherwise(weights[1]))


def labelled_matrix(bars: DataFrame, config: TrainingConfig) -> DataFrame:
    """Features, label and split of every bar."""
    labelled = forward_label(bars, config.horizon, config.threshold, layout=config.layout)
    labels = labelled.select(*config.layout.keys, *config.layout.order, "label")
    matrix = feature_matrix(bars, layout=config.layout)
    joined = matrix.join(labels, [*config.layout.keys, *config.layout.order])
    return temporal_split(joined, *config.split, layout=config.layout)


def train(matrix: DataFrame, config: TrainingConfig = TrainingConfig()) -> TrainedModel:
    """Select, scale and fit on the training rows only."""
    rows = matrix.where(F.col("split") == "train")
    columns = feature_columns(matrix)
    report = selecting.feature_report(rows, columns, threshold=config.min_auc, score=config.feature_score)
    features = selecting.selected_features(report)
    scaler = fit_scaler(rows, features, config.scaler)
    ready = with_weights(scaler.transform(rows.select("label", *features)), config.model)
    assembler = VectorAssembler(inputCols=features, outputCol="features")
    estimator = classifier(config.model, config.trees, config.seed)
    return TrainedModel(Pipeline(stages=[assembler, estimator]).fit(ready), scaler, features)


def evaluate(model: TrainedModel, matrix: DataFrame) -> DataFrame:
    """Quality on each split."""
    return classifier_metrics(materialize(model.score(matrix)), by=["split"])


def train_pipeline(bars: DataFrame, config: TrainingConfig = TrainingConfig(), path: str | None = None):
    """Bars to a saved model and its metrics. The matrix is read many times, so it is written once."""
    matrix = materialize(labelled_matrix(bars, config))
    model = train(matrix, config)
    if path:
        model.save(path)
    return model, evaluate(model, matrix)


def signal_from_model(
    bars: DataFrame, model: TrainedModel, buy: float = 0.55, sell: float = 0.45, layout: Layout = BARS
) -> DataFrame:
    """Bars to signals: features, scaling, probabilities, latch."""
    scored = materialize(model.score(feature_matrix(bars, None, layout, model.features)))
    return latch_probability(scored, buy, sell, layout)
