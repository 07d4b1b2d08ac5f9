"""Queries that assemble training sets and judge pages, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assembly, rules, targeting
from ..operators.assembly import Cohort
from . import views
from .more_queries import GENUINE, HAS, WATCHED
from .queries import query
from .views import BRANDS, FEEDBACK, SHAPED, TH, shaped

#: The default cohorts with a cap that small tables reach as well.
COHORTS = [Cohort("seed", train=0.7), Cohort("generic", train=0.7, cap=30), Cohort("feed", holdout=0.3), Cohort("targeted", train=0.0)]

ASSEMBLED = f"""src AS (SELECT url, page_id AS ord, page_id % 4 AS p FROM shaped WHERE page_id % 4 < 3 QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id % 4, page_id) = 1),
aimed AS (SELECT url, CASE WHEN p = 0 THEN 'seed' WHEN p = 1 THEN 'generic' WHEN regexp_matches(lower(url), '\\.' || {TH} || '.') OR (NOT {GENUINE}$') AND {HAS.format("string_split(host, '.')")}) THEN 'targeted' ELSE 'feed' END AS cohort
  FROM (SELECT src.*, any_value(s.host) AS host FROM src JOIN s USING (url) GROUP BY ALL)),
rk AS (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY md5('42|' || url)) AS nth, count(*) OVER (PARTITION BY cohort) AS n FROM aimed),
dealt AS (SELECT url, cohort, CASE cohort WHEN 'targeted' THEN 'holdout' WHEN 'feed' THEN CASE WHEN nth <= round_even(n * 0.3, 0) THEN 'holdout' ELSE 'train' END
  WHEN 'generic' THEN CASE WHEN nth <= least(30, round_even(n * 0.7, 0)) THEN 'train' WHEN nth > round_even(n * 0.7, 0) THEN 'holdout' END ELSE CASE WHEN nth <= round_even(n * 0.7, 0) THEN 'train' ELSE 'holdout' END END AS part FROM rk),
held AS (SELECT url FROM dealt WHERE part = 'holdout'),
good AS (SELECT DISTINCT url, 0 AS label, 'legit' AS cohort FROM shaped WHERE page_id % 4 = 3 AND url NOT IN (FROM held)),
told AS (SELECT url, CASE WHEN arg_min(correct_verdict, doc_id) = 'phishing' THEN 1 ELSE 0 END AS label, 'feedback' AS cohort FROM feedback WHERE url NOT IN (FROM held) GROUP BY url),
need AS (SELECT (SELECT count(*) FROM good) + (SELECT count(*) FILTER (label = 0) - count(*) FILTER (label = 1) FROM told) - (SELECT count(*) FROM dealt WHERE part = 'train') AS k),
spare AS (SELECT url, row_number() OVER (ORDER BY md5('42|' || url)) AS nth FROM (SELECT DISTINCT replace(url, '://', '://verify.') AS url FROM urls)
  WHERE url NOT IN (FROM held) AND url NOT IN (SELECT url FROM dealt WHERE part = 'train') AND url NOT IN (SELECT url FROM told) AND url NOT IN (SELECT url FROM good)),
assembled AS (SELECT url, 1 AS label, cohort, part FROM dealt WHERE part IS NOT NULL UNION ALL SELECT url, label, cohort, 'train' FROM good UNION ALL SELECT url, label, cohort, 'train' FROM told
  UNION ALL SELECT url, 1, 'pool', 'train' FROM spare, need WHERE nth <= k)"""


def training_rows(spark, d, cohorts=COHORTS):
    """URLs of many shapes in cohorts by page, feedback from labels, and a pool of pages under another name."""
    s = shaped(spark, d).select("page_id", "url")
    name = F.element_at(F.array(*map(F.lit, ("seed", "generic", "feed"))), (F.col("page_id") % 4 + 1).cast("int"))
    rows = s.where("page_id % 4 < 3").select("url", name.alias("cohort"), F.col("page_id").alias("ord"))
    told = views.feedback(spark, d).select("url", F.when(F.col("correct_verdict") == "phishing", "1").otherwise("0").alias("label"), F.col("doc_id").alias("ord"))
    pool = views.urls(spark, d).select(F.replace("url", F.lit("://"), F.lit("://verify.")).alias("url"))
    return assembly.assemble(rows, s.where("page_id % 4 = 3").select("url"), told, pool, targeting.brand_keywords(views.trusted(spark, d), ["kplus"]), cohorts)


@query(f"WITH {BRANDS}, {SHAPED}, {WATCHED}, {FEEDBACK}, {ASSEMBLED} SELECT url, label, cohort, part FROM assembled")
def training_set(spark, d):
    return training_rows(spark, d)


@query(f"""WITH {BRANDS}, {SHAPED}, {WATCHED}, {FEEDBACK}, {ASSEMBLED}, bad AS (SELECT url FROM assembled GROUP BY url HAVING count(DISTINCT part) > 1)
SELECT part, cohort, label, count(*) AS n, count(*) FILTER (url IN (FROM bad)) AS leaked FROM assembled GROUP BY 1, 2, 3""")
def training_audit(spark, d):
    return assembly.audit(training_rows(spark, d))


@query(f"""WITH {BRANDS}, {SHAPED}, r AS (SELECT url, CAST(page_id % 3 AS VARCHAR) AS source, page_id FROM s WHERE host <> '' AND NOT regexp_matches(lower(url), '\\.th|thai')),
f AS (SELECT url, arg_min(source, page_id) AS source FROM r GROUP BY url) SELECT url, source FROM f QUALIFY row_number() OVER (ORDER BY md5('42|' || url)) <= 120""")
def generic_snapshot(spark, d):
    rows = shaped(spark, d).select("url", (F.col("page_id") % 3).cast("string").alias("source"), F.col("page_id").alias("ord"))
    return assembly.snapshot(rows, 120)


PAGED = """paged AS (SELECT s.page_id, lower(s.netloc) AS netloc, CASE pages.page_id % 5 WHEN 1 THEN html || '<INPUT name=p type="password">' WHEN 2 THEN regexp_replace(html, '(?i)<title>', '<TITLE>Sign in to ' || (SELECT min(label) FROM trusted) || ' today ')
  WHEN 3 THEN regexp_replace(html, '(?i)<title>', '<title>www.obec.GO.TH - ' || (SELECT max(label) FROM trusted) || ' ') ELSE html END AS html FROM s JOIN pages USING (page_id))"""


def paged(spark, d):
    """Pages at URLs of many shapes; some ask for a password, some name a brand or an official suffix in the title."""
    k = F.col("page_id") % 5
    ends = views.trusted(spark, d).agg(F.min("label").alias("lo"), F.max("label").alias("hi"))  # one row
    p = shaped(spark, d).select("page_id", "host", "netloc").join(views.table(spark, d, "pages").select("page_id", "html"), "page_id").crossJoin(F.broadcast(ends))
    named = lambda to: F.regexp_replace("html", F.lit("(?i)<title>"), to)
    html = F.when(k == 1, F.concat("html", F.lit('<INPUT name=p type="password">'))).when(k == 2, named(F.concat(F.lit("<TITLE>Sign in to "), "lo", F.lit(" today ")))).when(k == 3, named(F.concat(F.lit("<title>www.obec.GO.TH - "), "hi", F.lit(" ")))).otherwise(F.col("html"))
    return p.select("page_id", "host", "netloc", html.alias("html"))


@query(f"""WITH {BRANDS}, {SHAPED}, {PAGED}, x AS (SELECT page_id, regexp_replace(netloc, '^www\\.', '') AS place, substr(html, 1, 65536) AS page FROM paged),
y AS (SELECT *, trim(lower(regexp_extract(page, '(?is)<title[^>]*>(.*?)</title>', 1))) AS title FROM x)
SELECT page_id, round(greatest(-0.2, least(0.3, (CASE WHEN EXISTS (SELECT 1 FROM trusted t WHERE contains(title, t.label) AND NOT contains(place, t.label) AND length(t.label) >= 4) THEN 0.15 ELSE 0 END)
 + (CASE WHEN regexp_matches(page, '(?i)<input[^>]*type=[''"]password[''"]') THEN 0.1 ELSE 0 END) - (CASE WHEN regexp_matches(title, '\\.(go|ac|or)\\.th') THEN 0.1 ELSE 0 END))), 4) AS content_delta FROM y""")
def content_adjustment(spark, d):
    return rules.content_adjustment(paged(spark, d), views.trusted(spark, d), "page_id").select("page_id", "content_delta")
