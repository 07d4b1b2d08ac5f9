"""Replays, evaluation reports and pages of lists, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.urls import url_parts
from ..operators import corpus, evaluation, replay
from ..operators import verdicts as V
from ..operators.rules import evaluate, final_score
from . import views
from .queries import query
from .views import AS_OF, CAMPAIGNS, FEEDBACK, PARTS, SHAPE, VERDICTS

U = lambda what: f"CAST('0x' || substr(md5('2026|' || name || '|{what}'), 1, 13) AS BIGINT) / 4503599627370496.0"
ENDS = [sum(replay.HOURS[: k + 1]) for k in range(24)]
SCORED = """one AS (SELECT url, any_value(host) AS host, any_value(path) AS path, any_value(closest_domain) AS closest_domain, any_value(pin) AS pin, any_value(delta) AS delta FROM s1 GROUP BY url),
sc AS (SELECT *, CAST(CASE pin WHEN 'phishing' THEN greatest(b, 0.7) WHEN 'safe' THEN least(b, 0.29) ELSE b END AS DOUBLE) AS score FROM (SELECT *, round(greatest(0.0, least(1.0, 0.35 + delta)), 4) AS b FROM one)),
lb AS (SELECT *, coalesce(pin, CASE WHEN score >= 0.7 THEN 'phishing' WHEN score >= 0.3 THEN 'suspicious' ELSE 'safe' END) AS label FROM sc)"""
REPLAYED = f"""nm AS (SELECT *, url AS name FROM lb), cn AS (SELECT *, CASE WHEN label = 'phishing' THEN 2 + CAST(floor({U('n')} * 5) AS INT) ELSE 5 + CAST(floor({U('n')} * 7) AS INT) END AS n FROM nm),
ex AS (SELECT * EXCLUDE (name), url || '|' || CAST(unnest(range(1, n + 1)) AS VARCHAR) AS name FROM cn),
pk AS (SELECT * FROM ex QUALIFY row_number() OVER (ORDER BY md5('2026|' || name)) <= 900),
rp AS (SELECT CAST('0x' || substr(md5('2026|' || name), 1, 15) AS BIGINT) AS check_id, url, label, score, host, path, closest_domain, TIMESTAMP '{AS_OF}'
  - to_days(CAST(floor(CASE WHEN {U('day')} < 0.35 THEN 14 * sqrt({U('day')} * 0.35) ELSE 14 * (1 - sqrt((1 - {U('day')}) * 0.65)) END) AS INT))
  - to_hours(len(list_filter({ENDS}, lambda e: e <= floor({U('hour')} * {ENDS[-1]})))) - to_minutes(CAST(floor({U('minute')} * 60) AS INT)) - to_seconds(CAST(floor({U('second')} * 60) AS INT)) AS checked_at FROM pk)"""


def scored_urls(spark, d):
    """Every URL of many shapes once, scored from one base and its rules."""
    rows = evaluate(views.seen_features(spark, d)).dropDuplicates(["url"]).withColumn("base_score", F.lit(0.35))
    return final_score(rows).select("url", "host", "path", "closest_domain", "score", "label")


def replayed_rows(spark, d):
    scored = views.kept(spark, d, "scored-urls", lambda: scored_urls(spark, d))
    plan = replay.replayed(scored.select("url", (F.col("label") == "phishing").alias("risky")), AS_OF, 14, 900)
    return plan.join(scored, "url")


@query(f"WITH {VERDICTS}, {SCORED}, {REPLAYED} SELECT check_id, url, label, score, checked_at FROM rp")
def replayed_checks(spark, d):
    return replayed_rows(spark, d).select("check_id", "url", "label", "score", "checked_at")


@query(f"""WITH {VERDICTS}, {SCORED}, {REPLAYED}, f AS (SELECT *, substr(lower(coalesce(closest_domain, '')) || '|' || split_part(host, '.', -1) || '|' || {SHAPE}, 1, 240) AS fingerprint FROM rp WHERE label IN ('phishing', 'suspicious'))
SELECT fingerprint, count(*) AS url_count, min(checked_at) AS first_seen, max(checked_at) AS last_seen FROM f WHERE fingerprint NOT LIKE '%||' GROUP BY 1""")
def replayed_campaigns(spark, d):
    return V.campaigns(replayed_rows(spark, d), ["phishing", "suspicious"])


R4 = lambda a, b: f"coalesce(round(({a}) * 1.0 / nullif({b}, 0), 4), 0)"
CELLS = "c AS (SELECT count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn, count(*) FILTER (NOT t AND NOT p) AS tn, count(*) AS n FROM (SELECT check_id % 3 = 0 AS t, score >= 0.5 AS p FROM verdicts))"


@query(f"""WITH {VERDICTS}, {CELLS}, m AS (SELECT *, tn / nullif(tn + fn, 0) AS p0, tn / nullif(tn + fp, 0) AS r0, 2 * tn / nullif(2 * tn + fn + fp, 0) AS f0, tp / nullif(tp + fp, 0) AS p1, tp / nullif(tp + fn, 0) AS r1, 2 * tp / nullif(2 * tp + fn + fp, 0) AS f1 FROM c)
SELECT 'legitimate' AS name, round(p0, 4) AS "precision", round(r0, 4) AS recall, round(f0, 4) AS f1, tn + fp AS support FROM m UNION ALL SELECT 'phishing', round(p1, 4), round(r1, 4), round(f1, 4), tp + fn FROM m
UNION ALL SELECT 'macro avg', round((p0 + p1) / 2, 4), round((r0 + r1) / 2, 4), round((f0 + f1) / 2, 4), n FROM m
UNION ALL SELECT 'weighted avg', round((p0 * (tn + fp) + p1 * (tp + fn)) / n, 4), round((r0 * (tn + fp) + r1 * (tp + fn)) / n, 4), round((f0 * (tn + fp) + f1 * (tp + fn)) / n, 4), n FROM m
UNION ALL SELECT 'accuracy', {R4('tp + tn', 'n')}, {R4('tp + tn', 'n')}, {R4('tp + tn', 'n')}, n FROM m""")
def class_report(spark, d):
    v = views.verdicts(spark, d).withColumn("truth", (F.col("check_id") % 3 == 0).cast("int"))
    return evaluation.class_report(v, "truth", "score")


W = lambda k, sign: f"round(greatest(0.0, least(1.0, ({k} * 1.0 / n + 3.8416 / (2 * n) {sign} 1.96 * sqrt({k} * 1.0 / n * (1 - {k} * 1.0 / n) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n))), 4)"
COHORTS = f"""hh AS (SELECT event_type AS cohort, count(*) AS n, count(*) FILTER (score >= 0.7) AS h, count(*) FILTER (score >= 0.3) AS l, round(avg(score), 4) AS mean_score, round(median(score), 4) AS median_score FROM verdicts WHERE check_id % 3 = 0 GROUP BY 1),
summary AS (SELECT cohort, n, round(h * 1.0 / n, 4) AS recall_high, {W('h', '-')} AS high_from, {W('h', '+')} AS high_to, round(l * 1.0 / n, 4) AS recall_low, {W('l', '-')} AS low_from, {W('l', '+')} AS low_to, mean_score, median_score, n - l AS missed FROM hh)"""


@query(f"WITH {VERDICTS}, {COHORTS} SELECT * FROM summary")
def cohort_summary(spark, d):
    return evaluation.cohort_summary(views.verdicts(spark, d).where("check_id % 3 = 0").withColumnRenamed("event_type", "cohort"), "cohort")


@query(f"""WITH {VERDICTS}, {COHORTS}, a AS (SELECT max(recall_high) FILTER (cohort = 'error') AS "primary", max(recall_high) FILTER (cohort = 'click') AS secondary FROM summary)
SELECT *, round("primary" - secondary, 4) AS alignment FROM a""")
def alignment_score(spark, d):
    return evaluation.alignment(cohort_summary(spark, d), "cohort", "error", "click")


@query(f"""WITH {PARTS}, x AS (SELECT split_part(host, '.', -2) AS brand, CASE WHEN page_id % 50 = 7 THEN 0 ELSE 1 END AS label, url FROM p), b AS (SELECT brand, count(*) AS n FROM x GROUP BY 1)
SELECT 'rows_per_brand' AS name, max(n) <= 8 AS passed, max(n) AS value FROM b UNION ALL SELECT 'brands', count(*) >= 130, count(*) FROM b UNION ALL SELECT 'rows', count(*) >= 900, count(*) FROM x
UNION ALL SELECT 'labels', count(*) FILTER (label <> 1) = 0, count(*) FILTER (label <> 1) FROM x UNION ALL SELECT 'schemes', count(*) FILTER (NOT regexp_matches(url, '^https?://')) = 0, count(*) FILTER (NOT regexp_matches(url, '^https?://')) FROM x""")
def corpus_checks(spark, d):
    rows = url_parts(views.urls(spark, d)).select(F.element_at("labels", -2).alias("brand"), F.when(F.col("page_id") % 50 == 7, 0).otherwise(1).alias("label"), "url")
    return evaluation.corpus_checks(rows, "brand", "label", "url")


@query(f"""WITH {PARTS}, {FEEDBACK}, f AS (SELECT doc_id, url, correct_verdict, TIMESTAMP '{AS_OF}' - to_days(CAST(doc_id % 30 AS INTEGER)) AS created_at FROM feedback WHERE correct_verdict = 'safe')
SELECT doc_id, url, created_at, (SELECT count(*) FROM f) AS total FROM f ORDER BY created_at DESC, doc_id LIMIT 20 OFFSET 5""")
def feedback_page(spark, d):
    rows = views.feedback(spark, d).withColumn("created_at", F.lit(AS_OF).cast("timestamp") - F.make_dt_interval(F.col("doc_id") % 30))
    return V.page(rows.select("doc_id", "url", "correct_verdict", "created_at"), {"correct_verdict": "safe"}, [F.desc("created_at"), "doc_id"], 20, 5).drop("correct_verdict")


@query(f"""WITH {VERDICTS}, dl AS (SELECT check_id, t.label AS brand, url, checked_at FROM verdicts v JOIN trusted t ON split_part(v.closest_domain, '.', 1) = t.label WHERE v.label = 'phishing' AND length(t.label) % 2 = 1), one AS (SELECT min(brand) AS brand FROM dl)
SELECT check_id, dl.brand, url, checked_at, (SELECT count(*) FROM dl JOIN one USING (brand)) AS total FROM dl JOIN one USING (brand) ORDER BY checked_at DESC, check_id LIMIT 25""")
def delivery_page(spark, d):
    sent = V.watch_alerts(views.verdicts(spark, d), views.watch(spark, d)).select("check_id", "brand", "url", "checked_at")
    first = sent.agg(F.min("brand").alias("brand")).first()  # the page's filter, one value
    return V.page(sent, {"brand": first.brand}, [F.desc("checked_at"), "check_id"], 25)


@query(f"""WITH {PARTS} SELECT page_id, CASE WHEN length(url) > 24 THEN substr(url, 1, 24) || '…' ELSE url END AS shown FROM urls""")
def shortened_urls(spark, d):
    return views.urls(spark, d).select("page_id", corpus.shortened(F.col("url"), 24).alias("shown"))


@query(f"""WITH {VERDICTS}, {SCORED}, x AS (SELECT url, CASE WHEN min(page_id) % 27 = 0 THEN 'safe' ELSE 'phishing' END AS want FROM shaped WHERE page_id % 27 = 0 OR page_id % 9 IN (1, 3) GROUP BY url)
SELECT x.url, want, label, label = want OR (want = 'phishing' AND label = 'suspicious') AS passed FROM x JOIN lb USING (url)""")
def golden_verdicts(spark, d):
    """Known pages are safe, and hosts hidden behind @ or bare addresses at least suspicious."""
    k = F.col("page_id")
    x = views.shaped(spark, d).where((k % 27 == 0) | (k % 9).isin(1, 3)).groupBy("url").agg(F.when(F.min("page_id") % 27 == 0, "safe").otherwise("phishing").alias("want"))
    return corpus.golden(views.kept(spark, d, "scored-urls", lambda: scored_urls(spark, d)), x)


@query(f"""WITH {VERDICTS}, {CAMPAIGNS}, f AS (SELECT * FROM campaigns WHERE url_count >= 30 AND split_part(fingerprint, '|', 1) ILIKE '%TH%')
SELECT *, (SELECT count(*) FROM f) AS total FROM f ORDER BY last_seen DESC, fingerprint LIMIT 10 OFFSET 3""")
def campaign_search(spark, d):
    return V.found_campaigns(V.campaigns(views.verdicts(spark, d), ["phishing", "suspicious"]), 30, "TH", 10, 3)


@query(f"""WITH RECURSIVE {VERDICTS}, ck AS MATERIALIZED (SELECT DISTINCT url, checked_at AS ts FROM verdicts), cr AS (SELECT url, min(ts) AS ts FROM ck GROUP BY 1
 UNION ALL SELECT cr.url, (SELECT min(ck.ts) FROM ck WHERE ck.url = cr.url AND ck.ts >= cr.ts + INTERVAL 259200 SECOND) AS ts FROM cr WHERE cr.ts IS NOT NULL)
SELECT label, cr.url IS NULL AS cached, count(*) AS n FROM verdicts v LEFT JOIN cr ON cr.url = v.url AND cr.ts = v.checked_at GROUP BY 1, 2""")
def cached_checks(spark, d):
    return V.checks_by_cache(views.verdicts(spark, d), 259200)
