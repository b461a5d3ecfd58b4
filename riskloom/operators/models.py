"""Supervised scoring with Spark ML: fraud model, scheme model, calibration, the whole chain."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark import StorageLevel
from pyspark.ml.classification import (GBTClassificationModel, GBTClassifier, RandomForestClassificationModel,
                                       RandomForestClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.storage import shared_dir, stored
from riskloom.functions.together import together
from riskloom.operators import anomaly, cost
from riskloom.sources.schema import ANOMALY_FEATURES, FEATURES, SCHEMES


@dataclass(frozen=True)
class Config:
    """Sizes of the learners. Boosting stops early once validation loss no longer improves."""

    rounds: int = 600
    step: float = 0.05
    depth: int = 5
    min_rows: int = 40
    subsample: float = 0.85
    stop_below: float = 0.0005
    type_trees: int = 100
    type_depth: int = 6
    type_min_rows: int = 15
    anomaly_trees: int = 100
    anomaly_sample: int = 4096
    cap: float = anomaly.DEFAULT_CAP
    with_anomaly: bool = True
    seed: int = 42


def assembled(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="_vector", handleInvalid="error").transform(df)


def fit_fraud_model(df: DataFrame, features: list[str], cfg: Config, label: str = "is_fraud") -> GBTClassificationModel:
    """Boosted trees on the rows of split = train, stopped on those of split = valid."""
    shared_dir(df.sparkSession)
    d = assembled(df.where(F.col("split").isin("train", "valid")), features).select(
        "_vector", F.col(label).cast("double").alias("_label"), (F.col("split") == "valid").alias("_valid"))
    # boosting reads its rows four times before the first tree; they are assembled once, and memory is left to what it caches itself
    d = d.persist(StorageLevel.DISK_ONLY)
    try:
        return GBTClassifier(
            featuresCol="_vector", labelCol="_label", validationIndicatorCol="_valid", maxIter=cfg.rounds,
            stepSize=cfg.step, maxDepth=cfg.depth, minInstancesPerNode=cfg.min_rows, subsamplingRate=cfg.subsample,
            validationTol=cfg.stop_below, maxMemoryInMB=1024, seed=cfg.seed, checkpointInterval=10).fit(d)
    finally:
        d.unpersist()


def training_curve(model: GBTClassificationModel, valid: DataFrame, features: list[str],
                   label: str = "is_fraud") -> DataFrame:
    """Validation loss after every round, and which round was best."""
    d = assembled(valid, features).withColumn(model.getLabelCol(), F.col(label).cast("double"))
    losses = [float(x) for x in model.setFeaturesCol("_vector").evaluateEachIteration(d)]
    best = losses.index(min(losses)) + 1
    rows = [(i + 1, x, i + 1 == best) for i, x in enumerate(losses)]
    return valid.sparkSession.createDataFrame(rows, "round int, loss double, best boolean")


def feature_importance(model, features: list[str], spark: SparkSession) -> DataFrame:
    gains = model.featureImportances.toArray()
    return (spark.createDataFrame([(f, float(g)) for f, g in zip(features, gains)], "feature string, gain double")
            .orderBy(F.desc("gain"), "feature"))


def fit_isotonic(df: DataFrame, score: str, label: str = "is_fraud") -> IsotonicRegressionModel:
    """Monotone map from score to probability. Rows are first reduced to one per distinct score."""
    d = df.groupBy(F.col(score).alias("_x")).agg(
        F.avg(F.col(label).cast("double")).alias("_y"), F.count("*").cast("double").alias("_w"))
    return IsotonicRegression(featuresCol="_x", labelCol="_y", weightCol="_w", isotonic=True).fit(d)


def apply_isotonic(df: DataFrame, model: IsotonicRegressionModel, score: str, out: str,
                   high: float = 1.0) -> DataFrame:
    d = model.setFeaturesCol(score).setPredictionCol("_iso").transform(df)
    return d.withColumn(out, F.least(F.greatest(F.col("_iso"), F.lit(0.0)), F.lit(float(high)))).drop("_iso")


def fit_type_model(df: DataFrame, features: list[str], cfg: Config):
    """Scheme classifier on the frauds of train and valid; classes in alphabetical order."""
    classes = sorted(SCHEMES)
    label = F.array_position(F.lit(classes), F.col("fraud_type")) - 1
    d = assembled(df.where((F.col("is_fraud") == 1) & F.col("split").isin("train", "valid")
                           & F.col("fraud_type").isin(classes)), features)
    return RandomForestClassifier(
        featuresCol="_vector", labelCol="_kind", numTrees=cfg.type_trees, maxDepth=cfg.type_depth,
        minInstancesPerNode=cfg.type_min_rows, seed=cfg.seed).fit(d.withColumn("_kind", label.cast("double")))


def raw_score(df: DataFrame, model: GBTClassificationModel, features: list[str], out: str = "p_raw") -> DataFrame:
    m = model.setFeaturesCol("_vector").setProbabilityCol("_prob").setRawPredictionCol("").setPredictionCol("")
    d = m.transform(assembled(df, features))
    return d.withColumn(out, vector_to_array("_prob")[1]).drop("_vector", "_prob")


def dominant_kind(classes: list[str] | None = None) -> Column:
    """The most likely scheme; equal ones in class order."""
    classes = classes or sorted(SCHEMES)
    top = F.greatest(*[F.col(f"p_{s}") for s in classes])
    out = F.lit(classes[-1])
    for s in reversed(classes[:-1]):
        out = F.when(F.col(f"p_{s}") == top, s).otherwise(out)
    return out


@dataclass
class RiskModel:
    """Everything needed to turn features into a probability, a scheme and a decision."""

    fraud: GBTClassificationModel
    calibrator: IsotonicRegressionModel
    schemes: RandomForestClassificationModel | None
    forest: anomaly.Forest | None
    anomaly_calibrator: IsotonicRegressionModel | None
    final: IsotonicRegressionModel | None
    features: list[str] = field(default_factory=lambda: list(FEATURES))
    cfg: Config = Config()

    def score(self, df: DataFrame) -> DataFrame:
        """Add p_raw, p_supervised, anomaly_score, p_anomaly, p_fraud and the scheme probabilities."""
        d = raw_score(df, self.fraud, self.features)
        d = apply_isotonic(d, self.calibrator, "p_raw", "p_supervised")
        if self.forest is not None:
            d = self.forest.score(d, "anomaly_score")
            d = apply_isotonic(d, self.anomaly_calibrator, "anomaly_score", "p_anomaly", self.cfg.cap)
            d = d.withColumn("_fused", anomaly.noisy_or(F.col("p_supervised"), F.col("p_anomaly")))
            d = apply_isotonic(d, self.final, "_fused", "p_fraud").drop("_fused")
        else:
            d = d.withColumn("p_fraud", F.col("p_supervised"))
        if self.schemes is not None:
            m = self.schemes.setFeaturesCol("_vector").setProbabilityCol("_prob").setRawPredictionCol("").setPredictionCol("")
            d = m.transform(assembled(d, self.features))
            d = d.withColumns({f"p_{s}": vector_to_array("_prob")[i] for i, s in enumerate(sorted(SCHEMES))}).drop("_vector", "_prob")
        return d

    def decide(self, df: DataFrame, econ=cost.DEFAULT) -> DataFrame:
        """Score and choose; ``client_avg`` and ``client_count`` are used when present."""
        known = {} if "client_avg" in df.columns else {"avg": None, "count": None}
        return cost.decide(self.score(df), econ, **known).withColumn("dominant_kind", dominant_kind())

    # -------------------------------------------------------------- storage
    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        parts = {"fraud": self.fraud, "calibrator": self.calibrator, "schemes": self.schemes,
                 "anomaly_calibrator": self.anomaly_calibrator, "final": self.final}
        for name, m in parts.items():
            if m is not None:
                m.write().overwrite().save(f"{path}/{name}")
        if self.forest is not None:
            self.forest.save(spark, f"{path}/forest")
        meta = json.dumps({"features": self.features, "cfg": asdict(self.cfg), "parts": [n for n, m in parts.items() if m is not None]})
        spark.createDataFrame([(meta,)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "RiskModel":
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        kinds = {"fraud": GBTClassificationModel, "schemes": RandomForestClassificationModel}
        got = {n: kinds.get(n, IsotonicRegressionModel).load(f"{path}/{n}") for n in meta["parts"]}
        cfg = Config(**meta["cfg"])
        forest = anomaly.Forest.load(spark, f"{path}/forest") if "anomaly_calibrator" in got else None
        return cls(got["fraud"], got["calibrator"], got.get("schemes"), forest, got.get("anomaly_calibrator"),
                   got.get("final"), meta["features"], cfg)


def fit(df: DataFrame, cfg: Config = Config(), features: list[str] | None = None, label: str = "is_fraud",
        with_types: bool = True, forest: anomaly.Forest | None = None) -> RiskModel:
    """Train on a feature table with ``split``, ``is_fraud`` and ``fraud_type``. The calibrators use
    the validation slice, which is also the early-stopping slice."""
    features = features or list(FEATURES)
    valid = df.where("split = 'valid'")

    def supervised():
        fraud = fit_fraud_model(df, features, cfg, label)
        kept = ANOMALY_FEATURES if cfg.with_anomaly else []
        va = stored(raw_score(valid, fraud, features).select(label, "p_raw", *kept), "valid")  # scored once for all calibrators
        return fraud, va, fit_isotonic(va, "p_raw", label)

    def unsupervised():
        if not cfg.with_anomaly or forest is not None:
            return forest if cfg.with_anomaly else None
        return anomaly.fit_forest(df.where("split = 'train'"), cfg.anomaly_trees, cfg.anomaly_sample, cfg.seed)

    jobs = [supervised, unsupervised] + ([lambda: fit_type_model(df, features, cfg)] if with_types else [])
    (fraud, va, cal), found, *types = together(df.sparkSession, jobs, df.count())
    model = RiskModel(fraud, cal, types[0] if types else None, found, None, None, features, cfg)
    if cfg.with_anomaly:
        va = found.score(apply_isotonic(va, cal, "p_raw", "p_supervised"), "anomaly_score")
        va = stored(va.select(label, "p_supervised", "anomaly_score"), "valid")
        model.anomaly_calibrator, model.final = fit_fusion(va, cfg.cap, label)
    return model


def fit_fusion(valid: DataFrame, cap: float, label: str = "is_fraud", a: IsotonicRegressionModel | None = None):
    """Anomaly score to probability (``a`` if it is known), then the fused value back to a probability."""
    a = a or fit_isotonic(valid, "anomaly_score", label)
    d = apply_isotonic(valid, a, "anomaly_score", "p_anomaly", cap)
    d = d.withColumn("_fused", anomaly.noisy_or(F.col("p_supervised"), F.col("p_anomaly")))
    return a, fit_isotonic(d, "_fused", label)
