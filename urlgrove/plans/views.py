"""URL tables derived from the given tables, in Spark and as SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import NO_DISTANCE
from ..functions.urls import lexical, url_parts
from ..operators.brands import closest_brand, path_brands
from ..operators.rules import evaluate, final_score
from ..operators.scored import load, store
from ..tables import shared_dir, stored

AS_OF = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def urls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.replace("url", F.lit(".example."), F.lit(".")).alias("url"))


def trusted(spark: SparkSession, d: str) -> DataFrame:
    label = F.regexp_extract("url", r"^https?://[^/?#]*?([^./?#]+)\.[a-z]+(?:[/?#]|$)", 1)
    rows = urls(spark, d).where("page_id % 10 = 0").select(label.alias("label")).distinct()
    return rows.select(F.concat("label", F.lit(".com")).alias("domain"), "label")


_kept: dict[tuple, DataFrame] = {}


def _stamp(spark: SparkSession, d: str) -> tuple:
    """What tables of a folder are made from: the session's application, and names, sizes and times of the files."""
    out: list = [spark.sparkContext.applicationId, d]
    for name in ("pages", "events"):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/{name}.parquet")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        for f in [fs.getFileStatus(path), *fs.listStatus(path)]:
            out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(out)


def kept(spark: SparkSession, d: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A derived table, written at the first question about these tables and read by all that follow: joins on it plan and compute no features again."""
    key = (name, *_stamp(spark, d))
    if key not in _kept:
        _kept[key] = stored(make(), name)
    return _kept[key]


def features(spark: SparkSession, d: str) -> DataFrame:
    t = kept(spark, d, "trusted", lambda: trusted(spark, d))
    return path_brands(closest_brand(kept(spark, d, "lexical", lambda: lexical(url_parts(urls(spark, d)))), t), t)


def shaped(spark: SparkSession, d: str) -> DataFrame:
    """The pages' URLs, most of them bent into another shape by page_id, with their parts."""
    k, u, even = F.col("page_id") % 9, F.col("url"), F.col("page_id") % 2 == 0
    host = r"^(https?://[^/?#]*)\.[a-z]+"
    address = F.regexp_replace(u, F.lit(r"^(https?)://[^/?#]*"), F.concat(F.lit("$1://203.0.113."), (F.col("page_id") % 200).cast("string")))
    plain = F.when(F.col("page_id") % 4 < 2, F.regexp_replace(u, "^https:", "http:")).otherwise(u)
    bent = (
        F.when(F.col("page_id") % 27 == 0, F.concat(F.lit("https://www.obec.go.th/news/"), F.col("page_id").cast("string")))
        .when(k == 1, F.replace(u, F.lit("://"), F.lit("://user@"))).when(k == 2, F.regexp_replace(u, r"^(https?://[^/?#]*)", "$1:8443"))
        .when(k == 3, F.concat(address, F.when(even, "?next=login").otherwise("")))
        .when(k == 4, F.regexp_replace(u, host, "$1.go.th")).when(k == 5, F.concat(F.regexp_replace(F.regexp_replace(plain, r"[?#].*$", ""), host, "$1.xyz"), F.when(even, "/login").otherwise("/obec")))
        .when(k == 6, F.replace(u, F.lit("://"), F.lit("://xn--80ak6aa92e."))).when(k == 7, F.replace(u, F.lit("://"), F.lit("://obec.go.th.")))
        .when(k == 8, F.concat(F.lit("https://bit.ly/"), F.col("page_id").cast("string"))).otherwise(u)
    )
    return url_parts(urls(spark, d).withColumn("url", bent))


def seen_trusted(spark: SparkSession, d: str) -> DataFrame:
    """The trusted domains, and one under a suffix of several labels."""
    return trusted(spark, d).unionByName(spark.createDataFrame([("obec.go.th", "obec")], "domain string, label string"))


def seen_features(spark: SparkSession, d: str) -> DataFrame:
    """Features of the URLs of many shapes."""
    t = kept(spark, d, "seen-trusted", lambda: seen_trusted(spark, d))
    return path_brands(closest_brand(kept(spark, d, "seen-lexical", lambda: lexical(shaped(spark, d))), t), t)


def log(spark: SparkSession, d: str) -> DataFrame:
    """Events, each about a page; the base score grows with the event's value."""
    n = table(spark, d, "pages").agg(F.count("*").alias("c"))
    e = table(spark, d, "events").crossJoin(F.broadcast(n))
    score = F.round(F.col("value") / (F.col("value") + 20), 4)
    return e.select(F.col("event_id").alias("check_id"), F.col("ts").alias("checked_at"), "user_id", "event_type", (F.col("event_id") % F.col("c")).alias("page_id"), score.alias("base_score"))


#: Of the columns that stored verdicts hold.
CONTRACT = "2"

_stored: dict[tuple, str] = {}


def computed_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """The verdict log from its sources: URLs are scored once each, then joined to the log."""
    cols = ["page_id", "url", "norm", "host", "path", "closest_domain", "has_punycode", "homoglyph_distance", "is_typosquat", "has_login_keyword", "path_brand_hit", "has_suspicious_tld", "has_ip", "min_edit_distance", "has_https"]
    v = log(spark, d).join(evaluate(seen_features(spark, d).select(*cols)), "page_id")
    return final_score(v).withColumn("edit_distance", F.when(F.col("min_edit_distance") < NO_DISTANCE, F.col("min_edit_distance")))


def verdicts(spark: SparkSession, d: str) -> DataFrame:
    """The verdict log as stored: scored at the first question about these tables, read by all that follow."""
    key = _stamp(spark, d)
    if key not in _stored:
        path = f"{shared_dir(spark)}/verdicts-{uuid.uuid4().hex}"
        store(computed_verdicts(spark, d), path, CONTRACT)
        _stored[key] = path
    return load(spark, _stored[key], CONTRACT)


def watch(spark: SparkSession, d: str) -> DataFrame:
    """Trusted labels, watched where their length is odd."""
    return trusted(spark, d).select(F.col("label").alias("brand"), (F.length("label") % 2 == 1).alias("enabled"))


def feedback(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "pages").agg(F.count("*").alias("c"))
    rows = table(spark, d, "labels").crossJoin(F.broadcast(n)).withColumn("page_id", F.col("doc_id") % F.col("c"))
    return rows.join(urls(spark, d), "page_id").select("doc_id", "url", F.when(F.col("toxic") == 1, "phishing").otherwise("safe").alias("correct_verdict"))


PARTS = """urls AS (SELECT page_id, replace(url, '.example.', '.') AS url FROM pages),
p AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+):', 1) AS scheme, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host,
  regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS query FROM urls)"""

TRUSTED = PARTS + """,
b AS (SELECT *, split_part(host, '.', -2) AS brand, split_part(host, '.', -2) || '.' || split_part(host, '.', -1) AS registrable FROM p),
trusted AS (SELECT DISTINCT brand || '.com' AS domain, brand AS label FROM b WHERE page_id % 10 = 0)"""

BRANDS = TRUSTED + """,
near AS (SELECT l.brand, levenshtein(l.brand, t.label) AS d, t.domain FROM (SELECT DISTINCT brand FROM b) l, trusted t
  QUALIFY row_number() OVER (PARTITION BY l.brand ORDER BY levenshtein(l.brand, t.label), t.domain) = 1),
g AS (SELECT b.*, (x.domain IS NOT NULL) AS is_whitelisted, near.domain AS closest_domain, CASE WHEN x.domain IS NOT NULL THEN 0 ELSE near.d END AS min_edit_distance
  FROM b JOIN near USING (brand) LEFT JOIN trusted x ON x.domain = b.registrable),
t AS (SELECT *, CAST(NOT is_whitelisted AND (min_edit_distance = 0 OR (min_edit_distance BETWEEN 1 AND 3 AND length(brand) >= 4)) AS INTEGER) AS is_typosquat FROM g),
h AS (SELECT t.*, CAST(EXISTS (SELECT 1 FROM trusted x WHERE length(x.label) >= 4 AND x.label <> t.brand AND list_contains(regexp_extract_all(lower(t.path), '[a-z0-9]+'), x.label)) AS INTEGER) AS path_brand_hit FROM t)"""


def listed(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


IP = "regexp_matches(host, '^[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+$')"
TH = "'(go|ac|or|co)\\.th'"

SHAPED = """shaped AS (SELECT page_id, CASE WHEN page_id % 27 = 0 THEN 'https://www.obec.go.th/news/' || CAST(page_id AS VARCHAR) ELSE CASE page_id % 9
  WHEN 1 THEN replace(url, '://', '://user@') WHEN 2 THEN regexp_replace(url, '^(https?://[^/?#]*)', '\\1:8443')
  WHEN 3 THEN regexp_replace(url, '^(https?)://[^/?#]*', '\\1://203.0.113.' || CAST(page_id % 200 AS VARCHAR)) || CASE WHEN page_id % 2 = 0 THEN '?next=login' ELSE '' END
  WHEN 4 THEN regexp_replace(url, '^(https?://[^/?#]*)\\.[a-z]+', '\\1.go.th')
  WHEN 5 THEN regexp_replace(regexp_replace(CASE WHEN page_id % 4 < 2 THEN regexp_replace(url, '^https:', 'http:') ELSE url END, '[?#].*$', ''), '^(https?://[^/?#]*)\\.[a-z]+', '\\1.xyz') || CASE WHEN page_id % 2 = 0 THEN '/login' ELSE '/obec' END WHEN 6 THEN replace(url, '://', '://xn--80ak6aa92e.')
  WHEN 7 THEN replace(url, '://', '://obec.go.th.') WHEN 8 THEN 'https://bit.ly/' || CAST(page_id AS VARCHAR) ELSE url END END AS url FROM urls),
q AS (SELECT page_id, url, regexp_extract(url, '^https?://([^/?#]*)', 1) AS netloc FROM shaped),
s AS (SELECT *, lower(regexp_replace(regexp_replace(netloc, '^.*@', ''), ':.*$', '')) AS host FROM q)"""

SEEN = f"""{SHAPED},
sb AS (SELECT *, regexp_extract(url, '^([a-z]+):', 1) AS scheme, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, {IP} AS ip, CASE WHEN host LIKE '%.go.th' THEN split_part(host, '.', -3) ELSE split_part(host, '.', -2) END AS brand,
  CASE WHEN host LIKE '%.go.th' THEN split_part(host, '.', -3) || '.go.th' ELSE split_part(host, '.', -2) || '.' || split_part(host, '.', -1) END AS registrable, contains(host, 'xn--') AS puny FROM s),
st AS (SELECT domain, label FROM trusted UNION ALL SELECT 'obec.go.th', 'obec'),
sn AS (SELECT l.brand, levenshtein(l.brand, t.label) AS d, t.domain FROM (SELECT DISTINCT brand FROM sb WHERE NOT ip) l, st t
  QUALIFY row_number() OVER (PARTITION BY l.brand ORDER BY levenshtein(l.brand, t.label), t.domain) = 1),
sg AS (SELECT sb.*, (x.domain IS NOT NULL) AS is_whitelisted, sn.domain AS closest_domain, CASE WHEN x.domain IS NOT NULL THEN 0 ELSE coalesce(sn.d, 999) END AS min_edit_distance
  FROM sb LEFT JOIN sn ON sb.brand = sn.brand AND NOT sb.ip LEFT JOIN st x ON x.domain = sb.registrable),
sy AS (SELECT *, CAST(NOT is_whitelisted AND (min_edit_distance = 0 OR (min_edit_distance BETWEEN 1 AND 3 AND length(brand) >= 4)) AS INTEGER) AS is_typosquat FROM sg),
sh AS (SELECT sy.*, CAST(NOT ip AND EXISTS (SELECT 1 FROM st x WHERE length(x.label) >= 4 AND x.label <> sy.brand AND list_contains(regexp_extract_all(lower(sy.path), '[a-z0-9]+'), x.label)) AS INTEGER) AS path_brand_hit FROM sy)"""


def _verdict_sql() -> str:
    from ..functions.constants import LOGIN_KEYWORDS, SUSPICIOUS_TLDS

    return TRUSTED + f""", {SEEN},
k AS (SELECT *, list_has_any(regexp_extract_all(lower(url), '[a-z0-9]+'), {listed(LOGIN_KEYWORDS)}) AS login,
  NOT ip AND list_contains({listed(SUSPICIOUS_TLDS)}, split_part(host, '.', -1)) AS cheap, scheme = 'https' AS https FROM sh),
r AS (SELECT *, (url LIKE '%://%@%' AND regexp_matches(url, '://[^/]*@')) AS at_trick, (puny AND min_edit_distance <= 2) AS idn, (is_typosquat = 1 AND login) AS typo_cred, (path_brand_hit = 1 AND cheap) AS bait, (ip AND login) AS ip_cred,
  (min_edit_distance = 0 AND is_typosquat = 0 AND NOT ip AND NOT puny) AS white, (cheap AND NOT https) AS plain FROM k),
s1 AS (SELECT *, round(greatest(-1.0, least(1.0, 0.55 * CAST(at_trick AS INT) + 0.45 * CAST(idn AS INT) + 0.4 * CAST(typo_cred AS INT) + 0.3 * CAST(bait AS INT) + 0.5 * CAST(ip_cred AS INT) - 0.6 * CAST(white AS INT) + 0.2 * CAST(plain AS INT))), 4) AS delta,
  CASE WHEN at_trick OR idn OR typo_cred OR bait OR ip_cred THEN 'phishing' WHEN white THEN 'safe' END AS pin FROM r),
log AS (SELECT event_id AS check_id, ts AS checked_at, user_id, event_type, event_id % (SELECT count(*) FROM pages) AS page_id, round(value / (value + 20), 4) AS base FROM events),
raw AS (SELECT log.*, s1.* EXCLUDE (page_id), CAST(round(greatest(0.0, least(1.0, base + delta)), 4) AS DOUBLE) AS s0 FROM log JOIN s1 USING (page_id)),
w AS (SELECT *, CAST(CASE pin WHEN 'phishing' THEN greatest(s0, 0.7) WHEN 'safe' THEN least(s0, 0.29) ELSE s0 END AS DOUBLE) AS score FROM raw),
verdicts AS (SELECT *, coalesce(pin, CASE WHEN score >= 0.7 THEN 'phishing' WHEN score >= 0.3 THEN 'suspicious' ELSE 'safe' END) AS label, CASE WHEN min_edit_distance < 999 THEN min_edit_distance END AS edit_distance FROM w)"""


VERDICTS = _verdict_sql()
FEEDBACK = """feedback AS (SELECT l.doc_id, u.url, CASE WHEN l.toxic = 1 THEN 'phishing' ELSE 'safe' END AS correct_verdict
  FROM labels l JOIN urls u ON u.page_id = l.doc_id % (SELECT count(*) FROM pages))"""
SHAPE = "substr(regexp_replace(regexp_replace(lower(trim(path, '/')), '\\b[0-9a-f]{8,}\\b', '$hex', 'g'), '[0-9]+', '#', 'g'), 1, 120)"
PRINT = f"substr(lower(coalesce(closest_domain, '')) || '|' || split_part(host, '.', -1) || '|' || {SHAPE}, 1, 240)"
CAMPAIGNS = f"""campaigns AS (SELECT {PRINT} AS fingerprint, count(*) AS url_count, min(checked_at) AS first_seen, max(checked_at) AS last_seen
  FROM verdicts WHERE label IN ('phishing', 'suspicious') AND {PRINT} NOT LIKE '%||' GROUP BY 1)"""
