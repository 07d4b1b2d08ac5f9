"""Fitting, calibration, evaluation gate and promotion of the URL model."""

from __future__ import annotations

import json
import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.reports import ranked_in
from ..tables import exists, stored


def weighted(df: DataFrame, label: str) -> DataFrame:
    """Add ``weight``: rows over classes times rows of the class."""
    counts = df.groupBy(label).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"), F.count("*").alias("_k"))
    counts = counts.crossJoin(total).select(label, (F.col("_all") / (F.col("_k") * F.col("_n"))).alias("weight"))
    return df.join(F.broadcast(counts), label)  # a row a class


@dataclass(frozen=True)
class Params:
    """Sizes of the two models. Spark's trees are at most 30 deep; a node splits if each side keeps half of ``least_split`` rows."""

    trees: int = 200
    forest_depth: int = 30
    least_split: int = 2
    rounds: int = 200
    boost_depth: int = 6
    step: float = 0.1
    rows: float = 0.9
    columns: float = 0.9


def ensemble(features: list[str], label: str, trees: int | Params, rounds: int | None = None) -> list[Pipeline]:
    p = trees if isinstance(trees, Params) else Params(trees=trees, rounds=rounds, forest_depth=5)
    head = [VectorAssembler(inputCols=features, outputCol="raw_features"), StandardScaler(inputCol="raw_features", outputCol="features", withMean=True)]
    forest = RandomForestClassifier(labelCol=label, numTrees=p.trees, maxDepth=p.forest_depth, minInstancesPerNode=max(1, p.least_split // 2), weightCol="weight", seed=42)
    boosted = GBTClassifier(labelCol=label, maxIter=p.rounds, maxDepth=p.boost_depth, stepSize=p.step, subsamplingRate=p.rows, featureSubsetStrategy=str(p.columns), seed=42)
    return [Pipeline(stages=[*head, m]) for m in (forest, boosted)]


MADE = ["raw_features", "features", "rawPrediction", "probability", "prediction"]


def voted(models: list, df: DataFrame, key: str | None = None) -> DataFrame:
    """Add ``vote``, the mean probability of the models: each adds its column to the rows, so no row is joined."""
    names = [f"_p{k}" for k in range(len(models))]
    for name, m in zip(names, models, strict=True):
        df = m.transform(df).withColumn(name, vector_to_array("probability")[1]).drop(*MADE)
    return df.withColumn("vote", sum(map(F.col, names)) / len(names)).drop(*names)


def with_folds(df: DataFrame, label: str, key: str, folds: int) -> DataFrame:
    """Add ``fold``: each label is dealt to the folds in turn, by the digest of the key."""
    return ranked_in(df, label, key).withColumn("fold", (F.col("nth") % folds).cast("int")).drop("nth")


#: A fit runs hundreds of jobs, and in each every part of its rows sends the statistics of all open nodes: the parts go by the rows alone.
SMALL_PART, PARTS, LARGE_PART = 2_000, 32, 250_000


def in_parts(df: DataFrame, key: str, rows: int) -> DataFrame:
    """``df``, of about ``rows`` rows, in up to PARTS parts, beyond PARTS * LARGE_PART rows in more.

    Rows are dealt and sorted by the key, so what a fit draws in each part doesn't depend on the parts that the tables came in.
    """
    parts = max(1, min(PARTS, math.ceil(rows / SMALL_PART)), math.ceil(rows / LARGE_PART))
    return df.repartition(parts, key).sortWithinPartitions(key)


def folded(df: DataFrame, features: list[str], label: str, key: str, folds: int) -> DataFrame:
    """The rows of a fit: key, label, features, fold and weight, in parts. They are written first: every task of a fit sends the counters of the plan behind its rows."""
    rows = stored(weighted(with_folds(df.select(key, label, *features), label, key, folds), label), "folds")
    return in_parts(rows, key, rows.count())


def vote_curve(votes: DataFrame, label: str) -> IsotonicRegressionModel:
    """The isotonic curve of the labels over ``vote``. Rows of equal votes meet in one task there, so each vote is one point of their mean and number."""
    points = votes.groupBy("vote").agg(F.avg(label).alias(label), F.count("*").cast("double").alias("n")).coalesce(PARTS)
    return IsotonicRegression(featuresCol="vote", labelCol=label, weightCol="n").fit(points)


@dataclass
class Calibrated:
    """Of each fold the models fitted on the others, and the isotonic curve fitted on the fold."""

    folds: list[tuple[list, object]]

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``score``, the mean of the folds' calibrated votes."""
        names = [f"_s{k}" for k in range(len(self.folds))]
        for name, (models, curve) in zip(names, self.folds, strict=True):
            df = curve.transform(voted(models, df)).withColumnRenamed("prediction", name).drop("vote")
        return df.withColumn("score", sum(map(F.col, names)) / len(names)).drop(*names)


def fit_calibrated(df: DataFrame, features: list[str], label: str, key: str, folds: int = 5, params: Params = Params(), parallelism: int = 2) -> Calibrated:  # noqa: B008
    """Fit the calibrated ensemble on ``df``; each fit is Spark jobs over all executors.

    Forests, which hold the statistics of many nodes, are fitted ``parallelism`` at a time. Boosting is a long row of
    short jobs with few nodes: those of all folds run beside each other.
    """
    df = folded(df, features, label, key, folds).persist()
    fit = lambda k, n: ensemble(features, label, params)[n].fit(df.where(F.col("fold") != k))
    curve = lambda k, models: vote_curve(voted(models, df.where(F.col("fold") == k)), label)
    with ThreadPoolExecutor(parallelism) as few, ThreadPoolExecutor(folds) as many:
        forests, boosted = ([pool.submit(fit, k, n) for k in range(folds)] for n, pool in enumerate((few, many)))
        models = [[f.result(), b.result()] for f, b in zip(forests, boosted, strict=True)]
        out = Calibrated(list(zip(models, few.map(curve, range(folds), models), strict=True)))
    df.unpersist()
    return out


def importances(models: list, features: list[str]) -> DataFrame:
    """(feature, importance) of the forests among fitted pipelines, their mean, greatest first; equal ones by name."""
    of = [m.stages[-1].featureImportances.toArray() for m in models if isinstance(m.stages[-1], RandomForestClassificationModel)]
    rows = [(f, float(sum(x[k] for x in of) / len(of))) for k, f in enumerate(features)]
    return SparkSession.active().createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


#: The ranges of the search: whole numbers, numbers, and numbers by their logarithm.
SPACE = {"trees": ("int", 100, 400), "forest_depth": ("int", 5, 25), "least_split": ("int", 2, 8), "rounds": ("int", 100, 400), "boost_depth": ("int", 3, 10), "step": ("log", 0.01, 0.3), "rows": ("float", 0.7, 1.0), "columns": ("float", 0.6, 1.0)}


def search_space(spark: SparkSession, trials: int, seed: int = 42, space: dict = SPACE) -> DataFrame:
    """A row a trial, a column a parameter; each value is a function of seed, trial and name."""
    u = lambda name: F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col("trial").cast("string"), F.lit(f"|{name}"))), 1, 13), 16, 10).cast("double") / float(1 << 52)
    value = {
        "int": lambda x, a, b: (F.lit(a) + F.floor(x * (b - a + 1))).cast("int"),
        "float": lambda x, a, b: F.round(F.lit(float(a)) + x * (b - a), 6),
        "log": lambda x, a, b: F.round(F.exp(math.log(a) + x * (math.log(b) - math.log(a))), 6),
    }
    return spark.range(trials).select(F.col("id").cast("int").alias("trial"), *(value[kind](u(name), a, b).alias(name) for name, (kind, a, b) in space.items()))


def search(df: DataFrame, features: list[str], label: str, key: str, space: DataFrame, folds: int = 3, parallelism: int = 2, cut: float = 0.5) -> DataFrame:
    """The trials of ``space`` with f1, the mean over folds, and place (from 1): the greatest f1 first, of equal ones the smaller trial.

    A fit is a Spark job over all executors; ``parallelism`` of them run at a time. A fold's counts are one row,
    so what reaches the driver is a row for each trial and fold.
    """
    spark, trials = df.sparkSession, [r.asDict() for r in space.collect()]  # a row a trial
    df = folded(df, features, label, key, folds).persist()
    true, hit = F.col(label) == 1, F.col("vote") >= cut

    def one(job: tuple[dict, int]) -> tuple:
        row, k = job
        models = [p.fit(df.where(F.col("fold") != k)) for p in ensemble(features, label, Params(**{n: v for n, v in row.items() if n != "trial"}))]
        n = voted(models, df.where(F.col("fold") == k)).agg(F.count_if(true & hit).alias("tp"), F.count_if(~true & hit).alias("fp"), F.count_if(true & ~hit).alias("fn")).first()
        return row["trial"], k, n.tp, n.fp, n.fn

    with ThreadPoolExecutor(parallelism) as pool:
        counts = list(pool.map(one, [(row, k) for row in trials for k in range(folds)]))
    df.unpersist()
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    scores = spark.createDataFrame(counts, "trial int, fold int, tp long, fp long, fn long").groupBy("trial").agg(F.round(F.avg(f1), 9).alias("f1"))
    place = F.row_number().over(W.orderBy(F.desc("f1"), "trial"))  # a row a trial
    return space.join(F.broadcast(scores), "trial").withColumn("place", place)


def best_params(found: DataFrame) -> Params:
    row = found.where("place = 1").first().asDict()
    return Params(**{k: v for k, v in row.items() if k not in ("trial", "f1", "place")})


def gate(metrics: DataFrame, metric: str, threshold: float = 0.85) -> DataFrame:
    """status: missing (no row), null, below or passed, with the figure."""
    one = metrics.agg(F.count("*").alias("n"), F.max(metric).alias("metric"))
    status = F.when(F.col("n") == 0, "missing").when(F.col("metric").isNull(), "null").when(F.col("metric") < threshold, "below").otherwise("passed")
    return one.select(status.alias("status"), "metric", "n")


def check_contract(saved: str, features: list[str], version: str) -> None:
    """A model may score only if it was fitted on these features, in this order."""
    have = json.loads(saved)
    if have.get("version") != version or have.get("features") != features:
        raise ValueError(f"the model holds contract {have.get('version')}, not {version}")


def retrained(feedback: DataFrame, least: int, passes: str) -> str:
    """What a retraining run does: skip with too few rows, promote a model that passes the gate, keep the old one otherwise."""
    return "skipped" if feedback.limit(least).count() < least else "promoted" if passes == "passed" else "kept"


def promote(models: list, path: str, version: str, features: list[str], status: str) -> bool:
    """Save fitted models and their contract as a version; point to it only if the gate passed. Older versions stay."""
    for k, m in enumerate(models):
        m.write().overwrite().save(f"{path}/{version}/model-{k}")
    spark = SparkSession.active()
    spark.createDataFrame([(version, features)], "version string, features array<string>").coalesce(1).write.mode("overwrite").json(f"{path}/{version}/contract")
    if status == "passed":
        spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").json(f"{path}/current")
    return status == "passed"


def promoted(spark: SparkSession, path: str, features: list[str]) -> list:
    """The models that the pointer names, after a check of their contract."""
    version = spark.read.json(f"{path}/current").first()["version"]
    check_contract(spark.read.text(f"{path}/{version}/contract").first()[0], features, version)
    out, fs = [], spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    while fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{version}/model-{len(out)}")):
        out.append(PipelineModel.load(f"{path}/{version}/model-{len(out)}"))
    return out


def save_calibrated(model: Calibrated, path: str, version: str, features: list[str], status: str) -> bool:
    """Save all folds and the contract as a version; point to it only if the gate passed. Older versions stay."""
    spark = SparkSession.active()
    for k, (models, curve) in enumerate(model.folds):
        for n, m in enumerate([*models, curve]):
            m.write().overwrite().save(f"{path}/{version}/fold-{k}/part-{n}")
    spark.createDataFrame([(version, features)], "version string, features array<string>").coalesce(1).write.mode("overwrite").json(f"{path}/{version}/contract")
    if status == "passed":
        spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").json(f"{path}/current")
    return status == "passed"


def load_calibrated(spark: SparkSession, path: str, features: list[str], version: str | None = None) -> tuple[str, Calibrated]:
    """The version that the pointer names (or the one asked for), after a check of its contract."""
    version = version or spark.read.json(f"{path}/current").first()["version"]
    check_contract(spark.read.text(f"{path}/{version}/contract").first()[0], features, version)
    folds = []
    while exists(spark, f"{path}/{version}/fold-{len(folds)}"):
        at = f"{path}/{version}/fold-{len(folds)}"
        folds.append(([PipelineModel.load(f"{at}/part-0"), PipelineModel.load(f"{at}/part-1")], IsotonicRegressionModel.load(f"{at}/part-2")))
    return version, Calibrated(folds)
