"""The model job on small tables: search, calibration, importance, gate and retraining."""

import math

import pytest
from pyspark.sql import functions as F

from urlgrove.functions.constants import CONTRACT_VERSION, FEATURES
from urlgrove.functions.urls import url_parts
from urlgrove.operators.observations import with_observations
from urlgrove.plans import model_job as J
from urlgrove.plans import training as T

TINY = T.Params(trees=3, forest_depth=3, rounds=1, boost_depth=2)


def points(spark, n=240):
    u = lambda seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1000)) / 1000
    df = spark.range(n).withColumn("y", (u(1) > 0.6).cast("double"))
    return df.withColumns({"a": F.col("y") + u(2), "b": u(3), "c": F.col("y") * 0.3 + u(4)})


def test_search_space(spark):
    rows = T.search_space(spark, 60, 42).collect()
    assert rows == T.search_space(spark, 60, 42).collect() != T.search_space(spark, 60, 43).collect()
    for name, (kind, low, high) in T.SPACE.items():
        got = [r[name] for r in rows]
        assert low <= min(got) and max(got) <= high and len(set(got)) > 5 and all(isinstance(v, int if kind == "int" else float) for v in got)
    steps = sorted(r["step"] for r in rows)
    assert abs(math.log(steps[30]) - (math.log(0.01) + math.log(0.3)) / 2) < 0.6  # even by the logarithm


def test_winner_is_that_of_an_exhaustive_run(spark):
    df, features = points(spark).persist(), ["a", "b", "c"]
    grid = [{"trial": 0, "trees": 1, "forest_depth": 1}, {"trial": 1, "trees": 4, "forest_depth": 4}, {"trial": 2, "trees": 4, "forest_depth": 4}, {"trial": 3, "trees": 2, "forest_depth": 0}]
    space = spark.createDataFrame([(g["trial"], g["trees"], g["forest_depth"], 1, 2) for g in grid], "trial int, trees int, forest_depth int, rounds int, boost_depth int")
    found = {r.trial: r for r in T.search(df, features, "y", "id", space, folds=2, parallelism=3).collect()}
    folded = T.weighted(T.with_folds(df.select("id", "y", *features), "y", "id", 2), "y").persist()
    for g in grid:
        f1 = []
        for k in range(2):
            p = T.Params(trees=g["trees"], forest_depth=g["forest_depth"], rounds=1, boost_depth=2)
            models = [m.fit(folded.where(F.col("fold") != k)) for m in T.ensemble(features, "y", p)]
            rows = T.voted(models, folded.where(F.col("fold") == k)).select("y", "vote").collect()
            tp, fp, fn = (sum(x) for x in zip(*((r.y == 1 and r.vote >= 0.5, r.y == 0 and r.vote >= 0.5, r.y == 1 and r.vote < 0.5) for r in rows), strict=True))
            f1.append(2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0.0)
        assert abs(found[g["trial"]].f1 - sum(f1) / 2) < 1e-6
    order = sorted(found.values(), key=lambda r: (-r.f1, r.trial))
    assert [r.place for r in order] == [1, 2, 3, 4] and found[1].f1 == found[2].f1 and found[1].place < found[2].place
    best = T.best_params(spark.createDataFrame(list(found.values())))
    assert best.trees == order[0].trees and best.step == T.Params().step


def test_folds_are_stratified(spark):
    n = {(r.y, r.fold): r["count"] for r in T.with_folds(points(spark), "y", "id", 5).groupBy("y", "fold").count().collect()}
    for y in (0.0, 1.0):
        of = [n[y, k] for k in range(5)]
        assert max(of) - min(of) <= 1


def test_calibrated_scores_survive_a_save(spark, tmp_path):
    df = points(spark).persist()
    model = T.fit_calibrated(df, ["a", "b", "c"], "y", "id", 3, TINY)
    scores = {r.id: r.score for r in model.score(df).select("id", "score").collect()}
    assert len(model.folds) == 3 and all(0 <= s <= 1 for s in scores.values())
    truth = {r.id: r.y for r in df.collect()}
    pos, neg = [s for i, s in scores.items() if truth[i]], [s for i, s in scores.items() if not truth[i]]
    assert sum(p > q for p in pos for q in neg) / len(pos) / len(neg) > 0.9
    assert not T.save_calibrated(model, str(tmp_path), "0", ["a", "b", "c"], "below") and T.save_calibrated(model, str(tmp_path), "1", ["a", "b", "c"], "passed")
    version, back = T.load_calibrated(spark, str(tmp_path), ["a", "b", "c"])
    assert version == "1" and {r.id: r.score for r in back.score(df).select("id", "score").collect()} == scores
    with pytest.raises(ValueError):
        T.load_calibrated(spark, str(tmp_path), ["b", "a", "c"])
    found = T.importances([m for models, _ in model.folds for m in models], ["a", "b", "c"]).collect()
    of = [m.stages[-1].featureImportances for models, _ in model.folds for m in models[:1]]
    assert found[0].feature == "a" and {r.feature: round(r.importance, 9) for r in found} == {f: round(sum(x[k] for x in of) / 3, 9) for k, f in enumerate("abc")}


def test_fit_goes_by_rows_and_not_by_the_parts_they_came_in(spark):
    few, many = points(spark).coalesce(1), points(spark).repartition(60)
    assert T.folded(many, ["a", "b", "c"], "y", "id", 3).rdd.getNumPartitions() == 1
    of = lambda df: {r.id: round(r.score, 9) for r in T.fit_calibrated(df, ["a", "b", "c"], "y", "id", 3, TINY).score(df).select("id", "score").collect()}
    assert of(few) == of(many)
    parts = [T.in_parts(points(spark, 9_000).repartition(n), "id", 9_000).select("id").rdd.glom().collect() for n in (2, 60)]
    assert parts[0] == parts[1] and len(parts[0]) == 5
    assert T.in_parts(many, "id", 10**6).rdd.getNumPartitions() == 32 and T.in_parts(many, "id", 10**7).rdd.getNumPartitions() == 40


def test_curve_of_equal_votes(spark):
    rows = [(k % 7 / 7, float((k * k + k // 7) % 3 == 0)) for k in range(140)]
    df = spark.createDataFrame(rows, "vote double, y double").repartition(6)
    got, want = T.vote_curve(df, "y"), T.IsotonicRegression(featuresCol="vote", labelCol="y").fit(df)
    for a, b in ((got.boundaries, want.boundaries), (got.predictions, want.predictions)):
        assert len(a) == len(b) and all(abs(x - y) < 1e-12 for x, y in zip(a, b, strict=True))


def rows_of(spark, feedback):
    """Bad names and good ones; feedback (url, label) trains."""
    bad = [(f"http://{w}-login{k}.xyz/verify/{k}", 1, "seed", "holdout" if k % 4 == 0 else "train") for k in range(24) for w in ("bank", "post")]
    good = [(f"https://www.{w}{k}.com/news", 0, "legit", "train") for k in range(24) for w in ("tea", "sea")]
    df = spark.createDataFrame(bad + good, "url string, label int, cohort string, part string").unionByName(feedback.selectExpr("url", "label", "'feedback' as cohort", "'train' as part"))
    none = spark.createDataFrame([], "host string, created date, registrar string"), spark.createDataFrame([], "host string, issuer string, not_before string, not_after string, san array<string>, valid boolean, self_signed boolean")
    trusted = spark.createDataFrame([("bank.co.th", "bank"), ("post.co.th", "post")], "domain string, label string")
    return J.url_features(df.withColumn("id", F.concat_ws("|", "url", "cohort")), trusted, *none, "2024-01-31 00:00:00")


def test_retraining_runs(spark, tmp_path):
    told = spark.createDataFrame([(f"http://odd{k}.top/login", 1) for k in range(6)], "url string, label int")
    make = lambda feedback: rows_of(spark, feedback)
    go = lambda feedback, version, **more: J.retrain(feedback, make, str(tmp_path), version, "seed", 5, params=TINY, folds=2, **more)
    assert go(told.limit(4), "a") == "skipped" and not (tmp_path / "a").exists()
    assert go(told, CONTRACT_VERSION) == "promoted"
    version, _ = T.load_calibrated(spark, str(tmp_path), FEATURES)
    assert version == CONTRACT_VERSION
    assert go(told, "b", least=1.01) == "kept" and T.load_calibrated(spark, str(tmp_path), FEATURES)[0] == CONTRACT_VERSION
    assert (tmp_path / "b" / "contract").exists()
    test = spark.read.parquet(f"{tmp_path}/{CONTRACT_VERSION}/test")
    n = {r.label: r["count"] for r in test.groupBy("label").count().collect()}
    assert n == {0.0: round(48 * 0.2), 1.0: round((36 + 6) * 0.2)}  # an exact share of each label


def test_features_follow_the_contract(spark):
    df = rows_of(spark, spark.createDataFrame([], "url string, label int"))
    assert len(FEATURES) == 42 and set(FEATURES) <= set(df.columns) and df.select(*FEATURES).na.drop().count() == df.count() == 96


def test_observations_override_defaults(spark):
    p = url_parts(spark.createDataFrame([("http://a.com",), ("http://b.com",)], "url string"))
    none = spark.createDataFrame([], "host string, created date, registrar string"), spark.createDataFrame([], "host string, issuer string, not_before string, not_after string, san array<string>, valid boolean, self_signed boolean")
    assert {r.whois_ok for r in with_observations(p, *none, "2024-01-31 00:00:00").collect()} == {0}


def test_registered_queries_fit_the_whole_models(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(J, "_fitted", {})
    monkeypatch.setattr(J, "featured", lambda spark, d: d)
    monkeypatch.setattr(J, "train", lambda rows, path, version, primary, params=T.Params(), folds=5, **more: seen.update(params=params, folds=folds, **more))  # noqa: B008
    J.fitted(spark, "/root/testdata/sf0.001")
    assert seen == {"params": T.Params(trees=200, forest_depth=30, least_split=2, rounds=200, boost_depth=6, step=0.1, rows=0.9, columns=0.9), "folds": 5}
