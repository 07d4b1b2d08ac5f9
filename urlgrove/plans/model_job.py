"""The model as a job: features of assembled rows, fit, evaluation, gate, promotion, and retraining from feedback."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import CONTRACT_VERSION, FEATURES
from ..functions.idn import international
from ..functions.urls import lexical, url_parts
from ..operators import evaluation
from ..operators.assembly import Cohort, dealt
from ..operators.brands import closest_brand, path_brands
from ..operators.observations import with_observations
from ..tables import shared_dir, stored
from . import views
from .assembly_queries import training_rows
from .more_queries import observed
from .queries import query
from .training import Calibrated, Params, fit_calibrated, gate, importances, load_calibrated, retrained, save_calibrated
from .views import AS_OF


def url_features(rows: DataFrame, trusted: DataFrame, whois: DataFrame, tls: DataFrame, as_of: str) -> DataFrame:
    """``rows`` (url, ...) with all features of the contract. The lexical part is written before the brands are joined."""
    x = stored(international(lexical(url_parts(rows))), "lexical")
    return with_observations(path_brands(closest_brand(x, trusted), trusted), whois, tls, as_of)


@dataclass
class Trained:
    model: Calibrated
    test: DataFrame  # scored rows of the test split
    holdout: DataFrame  # scored rows of the holdouts
    cohorts: DataFrame
    status: str


def train(rows: DataFrame, path: str, version: str, primary: str, params: Params = Params(), folds: int = 5, least: float = 0.85, test: float = 0.2, seed: int = 42) -> Trained:  # noqa: B008
    """Fit, evaluate, gate and save a version from ``rows``: id (distinct), url, label, cohort, part and the features.

    An exact share of the training part, by label, is the test split; it is kept at ``path/version/test``. The gate asks for
    the recall of the holdout ``primary`` at the phishing threshold; only a version that passes becomes the current one.
    """
    spark = rows.sparkSession
    labels = rows.where("part = 'train'").select(F.col("id").alias("url"), F.col("label").cast("string").alias("cohort"))
    split = dealt(labels, [Cohort("0", holdout=test), Cohort("1", holdout=test)], seed).select(F.col("url").alias("id"), F.col("part").alias("_part"))
    rows = stored(rows.withColumn("label", F.col("label").cast("double")).join(split, "id", "left").withColumn("part", F.when(F.col("_part") == "holdout", "test").otherwise(F.col("part"))).drop("_part"), "training")
    rows.where("part = 'test'").write.mode("overwrite").parquet(f"{path}/{version}/test")
    model = fit_calibrated(rows.where("part = 'train'"), FEATURES, "label", "id", folds, params)
    scored = model.score(rows.where("part <> 'train'")).withColumn("score", F.round("score", 6))
    scored = stored(scored.select("url", "cohort", "part", "label", "score", *(c for c in evaluation.MISS_FIELDS if c in scored.columns and c not in ("url", "score"))), "scored")
    held = scored.where("part = 'holdout'")
    cohorts = stored(evaluation.cohort_summary(held, "cohort"), "cohorts")
    status = gate(cohorts.where(F.col("cohort") == primary), "recall_high", least).first().status
    save_calibrated(model, path, version, FEATURES, status)
    return Trained(model, scored.where("part = 'test'"), held, cohorts, status)


def retrain(feedback: DataFrame, assembled: Callable[[DataFrame], DataFrame], path: str, version: str, primary: str, least_rows: int = 20, **options) -> str:
    """One run of retraining: skipped with fewer than ``least_rows`` rows of feedback, else promoted or kept by the gate.

    ``assembled`` makes the training rows with their features from the accepted feedback. A version that fails the gate is saved
    beside the others, and the current one stays.
    """
    if retrained(feedback, least_rows, "") == "skipped":
        return "skipped"
    return retrained(feedback, least_rows, train(assembled(feedback), path, version, primary, **options).status)


def featured(spark: SparkSession, d: str) -> DataFrame:
    rows = stored(training_rows(spark, d), "assembled").withColumn("id", F.concat_ws("|", "url", "cohort", "part"))
    return url_features(rows, views.kept(spark, d, "seen-trusted", lambda: views.seen_trusted(spark, d)), *observed(url_parts(views.urls(spark, d))), AS_OF)


_fitted: dict[tuple, tuple[str, Trained]] = {}


def fitted(spark: SparkSession, d: str) -> tuple[str, Trained]:
    """The model of these tables, fitted at the first question and stored; and where."""
    key = views._stamp(spark, d)
    if key not in _fitted:
        path = f"{shared_dir(spark)}/models-{uuid.uuid4().hex}"
        _fitted[key] = path, train(featured(spark, d), path, CONTRACT_VERSION, "seed")
    return _fitted[key]


@query()
def model_scores(spark, d):
    """Scores of the test split and the holdouts by the stored model, which was fitted on neither."""
    path, run = fitted(spark, d)
    _, model = load_calibrated(spark, path, FEATURES, CONTRACT_VERSION)
    test = model.score(spark.read.parquet(f"{path}/{CONTRACT_VERSION}/test")).select("url", "cohort", "part", "label", F.round("score", 6).alias("score"))
    return test.unionByName(run.holdout.select("url", "cohort", "part", "label", "score"))


@query()
def model_cohorts(spark, d):
    """Recall, intervals, mean and median score of each holdout."""
    return fitted(spark, d)[1].cohorts


@query()
def model_importance(spark, d):
    """The importance of each feature in the fitted forests."""
    return importances([m for models, _ in fitted(spark, d)[1].model.folds for m in models], FEATURES)
