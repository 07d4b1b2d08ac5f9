"""Registered queries over the given tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.constants import BRAND_PATTERNS, LOGIN_KEYWORDS, SPOOF_TLDS, SUSPICIOUS_TLDS
from ..functions.urls import lexical, url_parts
from ..operators import corpus
from ..operators import verdicts as V
from ..sources.feeds import first_url, page_domains, valid
from ..streaming.ingest import new_only
from . import views
from .views import AS_OF, BRANDS, CAMPAIGNS, FEEDBACK, PARTS, SEEN, TRUSTED, VERDICTS, listed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


LABEL_COUNTS = ", ".join(f"count(*) FILTER (label = '{n}') AS {n}" for n in V.LABELS)
WINDOW = lambda days: f"checked_at >= TIMESTAMP '{AS_OF}' - INTERVAL {days} DAY AND checked_at <= TIMESTAMP '{AS_OF}'"
LEXICAL = ["url_length", "num_dots", "num_hyphens", "num_at", "num_slash", "num_digits", "has_ip", "entropy", "has_https", "num_subdomains", "is_thai_tld", "tld_type", "tld_type_enc", "path_depth", "domain_label_max_len", "has_port", "max_digit_run", "has_query_string", "has_punycode", "has_login_keyword", "has_suspicious_tld", "path_length", "num_login_keywords", "query_param_count", "path_entropy", "host_token_count", "digit_to_letter_ratio"]
ENTROPY = lambda c, name: f"""{name} AS (SELECT page_id, round(-sum(k * 1.0 / n * log2(k * 1.0 / n)), 6) AS e FROM (SELECT page_id, c, count(*) AS k, any_value(n) AS n
  FROM (SELECT page_id, length({c}) AS n, unnest(string_split({c}, '')) AS c FROM sq WHERE length({c}) > 0) GROUP BY 1, 2) GROUP BY 1)"""  # noqa: E731
PARENT = "CASE WHEN host LIKE '%.go.th' THEN 3 ELSE 2 END"


@query(f"""WITH {TRUSTED}, {SEEN}, sq AS (SELECT *, regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS query FROM sb), {ENTROPY('url', 'ue')}, {ENTROPY('path', 'pe')}
SELECT sq.page_id, length(url) AS url_length, length(url) - length(replace(url, '.', '')) AS num_dots, length(url) - length(replace(url, '-', '')) AS num_hyphens,
 length(url) - length(replace(url, '@', '')) AS num_at, length(url) - length(replace(url, '/', '')) AS num_slash, len(regexp_extract_all(url, '[0-9]')) AS num_digits, CAST(ip AS INT) AS has_ip,
 coalesce(ue.e, 0) AS entropy, CAST(scheme = 'https' AS INT) AS has_https, CASE WHEN ip THEN 0 ELSE greatest(0, len(string_split(host, '.')) - {PARENT}) END AS num_subdomains, CAST(host LIKE '%.th' AS INT) AS is_thai_tld,
 CASE WHEN host LIKE '%.go.th' THEN 'go.th' ELSE 'other' END AS tld_type, CASE WHEN host LIKE '%.go.th' THEN 0 ELSE 4 END AS tld_type_enc, len(list_filter(string_split(path, '/'), lambda x: x <> '')) AS path_depth,
 list_max(list_transform(string_split(host, '.'), lambda x: length(x))) AS domain_label_max_len, CAST(regexp_matches(netloc, ':[0-9]+$') AND NOT regexp_matches(netloc, ':(80|443)$') AS INT) AS has_port,
 coalesce(list_max(list_transform(regexp_extract_all(host, '[0-9]+'), lambda x: length(x))), 0) AS max_digit_run, CAST(query <> '' AS INT) AS has_query_string, CAST(puny AS INT) AS has_punycode,
 CAST(list_has_any(regexp_extract_all(lower(url), '[a-z0-9]+'), {listed(LOGIN_KEYWORDS)}) AS INT) AS has_login_keyword, CAST(list_contains({listed(SUSPICIOUS_TLDS)}, split_part(host, '.', -1)) AS INT) AS has_suspicious_tld,
 length(path) AS path_length, len(list_intersect(list_distinct(regexp_extract_all(lower(path || ' ' || query), '[a-z0-9]+')), {listed(LOGIN_KEYWORDS)})) AS num_login_keywords,
 CASE WHEN query = '' THEN 0 ELSE length(query) - length(replace(query, '&', '')) + 1 END AS query_param_count, coalesce(pe.e, 0) AS path_entropy, len(regexp_extract_all(host, '[^.\\-]+')) AS host_token_count,
 round(CASE WHEN regexp_matches(host, '[A-Za-z]') THEN len(regexp_extract_all(host, '[0-9]')) * 1.0 / len(regexp_extract_all(host, '[A-Za-z]')) ELSE len(regexp_extract_all(host, '[0-9]')) END, 6) AS digit_to_letter_ratio
FROM sq LEFT JOIN ue USING (page_id) LEFT JOIN pe USING (page_id)""")
def url_lexical_features(spark, d):
    return lexical(views.shaped(spark, d)).select("page_id", *LEXICAL)


@query(f"""WITH {TRUSTED}, {SEEN} SELECT page_id, brand, registrable, is_whitelisted, closest_domain, min_edit_distance, is_typosquat, path_brand_hit,
 CAST((path_brand_hit = 1 OR is_typosquat = 1) AND NOT ip AND list_contains({listed(SUSPICIOUS_TLDS)}, split_part(host, '.', -1)) AS INT) AS host_has_brand_and_suspicious_tld FROM sh""")
def seen_brands(spark, d):
    """Brand features of URLs of many shapes, suffixes of several labels among them."""
    return views.seen_features(spark, d).select("page_id", "brand", "registrable", "is_whitelisted", "closest_domain", "min_edit_distance", "is_typosquat", "path_brand_hit", "host_has_brand_and_suspicious_tld")


@query(f"WITH {BRANDS} SELECT page_id, brand, registrable, is_whitelisted, closest_domain, min_edit_distance, min_edit_distance AS homoglyph_distance, is_typosquat, path_brand_hit FROM h")
def closest_brands(spark, d):
    return views.features(spark, d).select("page_id", "brand", "registrable", "is_whitelisted", "closest_domain", "min_edit_distance", "homoglyph_distance", "is_typosquat", "path_brand_hit")


@query(f"WITH {VERDICTS} SELECT check_id, url, label, score FROM verdicts")
def verdict_log(spark, d):
    return views.verdicts(spark, d).select("check_id", "url", "label", "score")


@query(f"""WITH {VERDICTS}, x AS (SELECT unnest([CASE WHEN at_trick THEN 'AT_TRICK' END, CASE WHEN idn THEN 'IDN_HOMOGRAPH' END, CASE WHEN typo_cred THEN 'TYPOSQUAT_CRED' END, CASE WHEN bait THEN 'PATH_BRAND_BAIT' END, CASE WHEN ip_cred THEN 'IP_CRED' END,
 CASE WHEN white THEN 'WHITELIST_EXACT' END, CASE WHEN plain THEN 'CHEAP_TLD_PLAIN' END]) AS rule_id FROM verdicts) SELECT rule_id, count(*) AS hits FROM x WHERE rule_id IS NOT NULL GROUP BY 1""")
def rule_audit(spark, d):
    return views.verdicts(spark, d).select(F.explode("hits.rule_id").alias("rule_id")).groupBy("rule_id").agg(F.count("*").alias("hits"))


@query(f"WITH {VERDICTS}, {CAMPAIGNS} SELECT * FROM campaigns")
def campaign_rollup(spark, d):
    return V.campaigns(views.verdicts(spark, d), ["phishing", "suspicious"])


@query(f"WITH {VERDICTS}, {CAMPAIGNS} SELECT * FROM campaigns WHERE url_count >= 20 ORDER BY last_seen DESC, fingerprint LIMIT 25 OFFSET 5")
def campaign_page(spark, d):
    return V.campaigns(views.verdicts(spark, d), ["phishing", "suspicious"], 20).orderBy(F.desc("last_seen"), "fingerprint").offset(5).limit(25)


@query(f"WITH {VERDICTS} SELECT l.label, count(v.label) AS n FROM (VALUES ('phishing'), ('safe'), ('suspicious')) l(label) LEFT JOIN verdicts v USING (label) GROUP BY 1")
def stats_by_label(spark, d):
    return V.label_counts(views.verdicts(spark, d))


@query(f"WITH {VERDICTS} SELECT closest_domain, count(*) AS n FROM verdicts WHERE label <> 'safe' AND closest_domain IS NOT NULL GROUP BY 1 ORDER BY n DESC, closest_domain LIMIT 10")
def stats_top_targets(spark, d):
    return V.top_targets(views.verdicts(spark, d))


@query(f"""WITH {VERDICTS}, c AS (SELECT CAST(TIMESTAMP '{AS_OF}' AS DATE) - CAST(i AS INTEGER) AS day FROM range(7) t(i))
SELECT c.day, {LABEL_COUNTS} FROM c LEFT JOIN verdicts v ON CAST(v.checked_at AS DATE) = c.day GROUP BY 1""")
def stats_daily(spark, d):
    return V.daily(views.verdicts(spark, d), AS_OF)


@query(f"""WITH {VERDICTS}, c AS (SELECT hour(checked_at) AS hour, count(*) AS n FROM verdicts WHERE {WINDOW(30)} GROUP BY 1),
a AS (SELECT CAST(i AS INTEGER) AS hour, coalesce(n, 0) AS n FROM range(24) t(i) LEFT JOIN c ON c.hour = i) SELECT hour, n, round(n * 1.0 / greatest(1, max(n) OVER ()), 6) AS share FROM a""")
def stats_hourly(spark, d):
    return V.hourly(views.verdicts(spark, d), AS_OF)


@query(f"WITH {VERDICTS} SELECT count(*) AS total, round(count(*) FILTER (label <> 'safe') * 1.0 / count(*), 4) AS phishing_rate FROM verdicts")
def stats_rate(spark, d):
    return V.rate(views.verdicts(spark, d))


@query(f"""WITH {VERDICTS} SELECT host, count(*) AS total, min(checked_at) AS first_seen, max(checked_at) AS last_seen, round(avg(score), 9) AS mean_score, max(score) AS max_score, {LABEL_COUNTS}
FROM verdicts WHERE {WINDOW(90)} GROUP BY host""")
def host_reputation(spark, d):
    return V.reputation(views.verdicts(spark, d), AS_OF)


@query(f"""WITH {VERDICTS} SELECT host, CAST(checked_at AS DATE) AS day, count(*) AS checks, round(avg(score), 9) AS mean_score, max(score) AS max_score, {LABEL_COUNTS} FROM verdicts GROUP BY 1, 2""")
def host_timeline(spark, d):
    return V.timeline(views.verdicts(spark, d))


@query(f"""WITH {VERDICTS} SELECT * FROM (SELECT host, CAST(row_number() OVER (PARTITION BY host ORDER BY checked_at DESC, check_id) AS INTEGER) AS rank, check_id, url, label, checked_at FROM verdicts) WHERE rank <= 20""")
def host_recent(spark, d):
    return V.recent(views.verdicts(spark, d))


@query(f"""WITH {VERDICTS} SELECT check_id, url, label, score, checked_at FROM verdicts WHERE label = 'phishing' AND url ILIKE '%tion%'
AND checked_at BETWEEN '2024-01-05 00:00:00' AND '2024-01-20 23:59:59' ORDER BY checked_at DESC, check_id LIMIT 50 OFFSET 10""")
def history_page(spark, d):
    v = V.history(views.verdicts(spark, d), "phishing", "tion", "2024-01-05 00:00:00", "2024-01-20 23:59:59", 50, 10)
    return v.select("check_id", "url", "label", "score", "checked_at")


@query(f"""WITH {VERDICTS} SELECT check_id, url, closest_domain, printf('%.4f', score) AS score, checked_at FROM verdicts WHERE label = 'phishing'
AND checked_at >= TIMESTAMP '{AS_OF}' - INTERVAL 336 HOUR AND checked_at <= TIMESTAMP '{AS_OF}' ORDER BY checked_at DESC, check_id LIMIT 2000""")
def feed_indicators(spark, d):
    v = V.indicators(views.verdicts(spark, d), AS_OF, 336)
    return v.select("check_id", "url", "closest_domain", F.format_string("%.4f", "score").alias("score"), "checked_at")


@query(f"""WITH {VERDICTS} SELECT 'indicator--' || sha256(url || '|' || strftime(checked_at, '%Y-%m-%dT%H:%M:%SZ')) AS id, strftime(checked_at, '%Y-%m-%dT%H:%M:%SZ') AS created,
 '[url:value = ''' || replace(replace(url, '\\', '\\\\'), '''', '\\''') || ''']' AS pattern, CAST(round(score * 100) AS INTEGER) AS confidence FROM verdicts WHERE label = 'phishing'""")
def feed_stix(spark, d):
    return V.stix_objects(views.verdicts(spark, d).where("label = 'phishing'"))


@query(f"""WITH {VERDICTS}, {CAMPAIGNS}, {FEEDBACK}, i AS (SELECT {LABEL_COUNTS}, count(DISTINCT closest_domain) FILTER (label = 'phishing') AS targets FROM verdicts WHERE {WINDOW(30)})
SELECT i.*, (SELECT count(*) FROM campaigns WHERE {WINDOW(30).replace('checked_at', 'last_seen')}) AS campaigns, (SELECT count(*) FROM trusted) AS watched, (SELECT count(*) FROM feedback) AS feedback,
 phishing + safe + suspicious AS total, (phishing + suspicious) * 7800 AS estimated_loss FROM i""")
def impact_kpis(spark, d):
    return V.impact(views.verdicts(spark, d), views.watch(spark, d), views.feedback(spark, d), AS_OF)


@query(f"""WITH {VERDICTS} SELECT t.label AS brand, count(*) AS hit_count, max(checked_at) AS last_hit_at FROM verdicts v JOIN trusted t ON split_part(v.closest_domain, '.', 1) = t.label
WHERE v.label = 'phishing' AND length(t.label) % 2 = 1 GROUP BY 1""")
def watch_hits(spark, d):
    hits = V.watch_alerts(views.verdicts(spark, d), views.watch(spark, d))
    return hits.groupBy("brand").agg(F.count("*").alias("hit_count"), F.max("checked_at").alias("last_hit_at"))


@query(f"""WITH {PARTS}, log AS (SELECT event_type AS source, event_id, ts, url FROM events JOIN urls ON page_id = event_id % (SELECT count(*) FROM pages)),
seen AS (SELECT DISTINCT url, source FROM log WHERE ts < '2024-01-03'), top AS (SELECT * FROM log WHERE ts >= '2024-01-03' QUALIFY row_number() OVER (PARTITION BY source ORDER BY event_id) <= 500)
SELECT sha256(url) AS url_hash, source, url, min(event_id) AS ord FROM top ANTI JOIN seen USING (url, source) GROUP BY url, source""")
def feed_unseen(spark, d):
    feed = views.log(spark, d).join(views.urls(spark, d), "page_id").select("url", F.col("event_type").alias("source"), F.col("check_id").alias("ord"), "checked_at")
    ledger = feed.where("checked_at < '2024-01-03'").select(F.sha2("url", 256).alias("url_hash"), "source").distinct()
    return new_only(feed.where("checked_at >= '2024-01-03'").drop("checked_at"), ledger, 500)


@query("""WITH RECURSIVE k AS (SELECT user_id, ts FROM events), r AS (SELECT user_id, min(ts) AS ts FROM k GROUP BY 1
 UNION ALL SELECT r.user_id, (SELECT min(k.ts) FROM k WHERE k.user_id = r.user_id AND k.ts >= r.ts + INTERVAL 21600 SECOND) AS ts FROM r WHERE r.ts IS NOT NULL)
SELECT user_id, ts FROM r WHERE ts IS NOT NULL""")
def ttl_dedupe(spark, d):
    return V.ttl_first(views.table(spark, d, "events"), "user_id", "ts", 21600)


@query(f"""WITH {PARTS}, x AS (SELECT CASE WHEN regexp_matches(host, '\\.(xyz|top|cc|shop|online|site|icu|click|vip|cfd|bond|live)$') THEN 'cheap_tld' WHEN host LIKE '%xn--%' THEN 'punycode' ELSE 'other' END AS pattern,
 split_part(host, '.', -1) AS tld, split_part(host, '.', -2) AS brand FROM p), l AS (SELECT 'pattern' AS dim, pattern AS value FROM x UNION ALL SELECT 'tld', tld FROM x UNION ALL SELECT 'brand', brand FROM x),
c AS (SELECT dim, value, count(*) AS n FROM l GROUP BY 1, 2) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY dim ORDER BY n DESC, value) AS INTEGER) AS rank FROM c) WHERE rank <= 12""")
def corpus_histogram(spark, d):
    p = url_parts(views.urls(spark, d))
    x = p.select(corpus.attack_pattern(F.col("netloc"), F.col("host")).alias("pattern"), F.element_at("labels", -1).alias("tld"), F.element_at("labels", -2).alias("brand"))
    return corpus.histogram(x, ["pattern", "tld", "brand"])


@query(f"WITH {PARTS} SELECT split_part(host, '.', -2) AS brand, page_id, url FROM p QUALIFY row_number() OVER (PARTITION BY split_part(host, '.', -2) ORDER BY page_id) <= 8")
def corpus_cap_per_brand(spark, d):
    p = url_parts(views.urls(spark, d)).select(F.element_at("labels", -2).alias("brand"), "page_id", "url")
    return corpus.cap_per_brand(p, "brand", "page_id", 8)


@query("SELECT text, min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY text")
def corpus_first_wins(spark, d):
    # a group of copies may be large: the partial aggregate keeps one row of it per task
    return views.table(spark, d, "documents").where("text is not null").groupBy("text").agg(F.min("doc_id").alias("doc_id"))


@query(f"WITH {PARTS} SELECT page_id, url, CASE WHEN CAST('0x' || substr(md5(url), 1, 8) AS BIGINT) < 1288490188 THEN 'holdout' ELSE 'train' END AS part FROM urls")
def corpus_split(spark, d):
    return corpus.split(views.urls(spark, d), "url", 0.3)


EXPANDED = f"""i AS (SELECT label AS brand, row_number() OVER (ORDER BY label) - 1 AS idx FROM trusted), o AS (SELECT *, unnest(range({len(BRAND_PATTERNS)})) AS k FROM i),
z AS (SELECT brand, idx * {len(BRAND_PATTERNS)} + k AS ord, replace(replace(replace(list_extract({listed(BRAND_PATTERNS)}, CAST(k AS INTEGER) + 1), '{{b}}', brand), '{{c}}', 'co.th'), '{{t}}', list_extract({listed(SPOOF_TLDS)}, CAST((idx + k) % {len(SPOOF_TLDS)} AS INTEGER) + 1)) AS url FROM o),
expanded AS (SELECT brand, ord, url FROM z QUALIFY row_number() OVER (PARTITION BY url ORDER BY ord) = 1)"""


def listed_brands(spark, d):
    idx = F.row_number().over(W.orderBy("domain")) - 1  # a place in the list of trusted domains, a dimension table; sorted by domain, hence by label
    return views.trusted(spark, d).select(F.col("label").alias("brand"), F.lit("co.th").alias("suffix"), idx.alias("idx"))


@query(f"WITH {BRANDS}, {EXPANDED} SELECT * FROM expanded")
def brand_expansion(spark, d):
    return corpus.expand_brands(listed_brands(spark, d))


CORPUS = f"""{EXPANDED}, cur AS (SELECT * FROM (SELECT url, brand, 0 AS p, page_id AS ord FROM b WHERE page_id % 7 = 0 UNION ALL SELECT url, brand, 1, ord FROM expanded) QUALIFY row_number() OVER (PARTITION BY brand ORDER BY p, ord) <= 8),
used AS (SELECT brand, count(*) AS used FROM cur GROUP BY 1), lv AS (SELECT url, brand, page_id FROM b LEFT JOIN used USING (brand) WHERE page_id % 3 = 1 QUALIFY row_number() OVER (PARTITION BY brand ORDER BY page_id) + coalesce(used, 0) <= 8),
each AS (SELECT url, 'curated' AS source, brand AS target_brand, p, ord FROM cur UNION ALL SELECT url, 'live', brand, 2, page_id FROM lv),
one AS (SELECT url, 1 AS label, source, target_brand FROM each QUALIFY row_number() OVER (PARTITION BY url ORDER BY p, ord) = 1),
corpus AS (SELECT one.*, CASE WHEN url IN (SELECT url FROM b WHERE page_id % 2 = 0) THEN '2023-12-01' ELSE '2024-01-31' END AS collected_at FROM one)"""


@query(f"WITH {BRANDS}, {CORPUS} SELECT * FROM corpus")
def brand_corpus(spark, d):
    """A corpus of pages' URLs and of spoofed ones, some seen before."""
    b = url_parts(views.urls(spark, d)).select("page_id", "url", F.element_at("labels", -2).alias("brand"), F.col("page_id").alias("ord"), F.lit("live").alias("source"))
    old = b.where("page_id % 2 = 0").select("url", F.lit("2023-12-01").alias("collected_at"))
    return corpus.brand_corpus(old, b.where("page_id % 7 = 0"), listed_brands(spark, d), b.where("page_id % 3 = 1"), "2024-01-31")


@query(f"WITH {BRANDS}, {CORPUS} SELECT source, count(*) AS n FROM corpus GROUP BY 1")
def corpus_sources(spark, d):
    return brand_corpus(spark, d).groupBy("source").agg(F.count("*").alias("n"))


@query(f"""WITH {PARTS}, h AS (SELECT DISTINCT host FROM p WHERE page_id % 3 = 0), n AS (SELECT DISTINCT host FROM p)
SELECT host, 'old' AS origin FROM h UNION ALL SELECT host, 'new' FROM n ANTI JOIN h USING (host)""")
def insert_only_merge(spark, d):
    p = url_parts(views.urls(spark, d))
    old = p.where("page_id % 3 = 0").select("host").distinct().withColumn("origin", F.lit("old"))
    return corpus.insert_only(old, p.select("host").distinct().withColumn("origin", F.lit("new")), "host")


@query(f"""WITH {PARTS}, s AS (SELECT url FROM urls WHERE page_id % 4 <> 0) SELECT url FROM urls WHERE page_id % 5 = 0 EXCEPT SELECT url FROM s ORDER BY url LIMIT 5""")
def holdout_leaks(spark, d):
    u = views.urls(spark, d)
    return u.where("page_id % 5 = 0").select("url").distinct().join(u.where("page_id % 4 <> 0"), "url", "left_anti").orderBy("url").limit(5)


WILSON = lambda sign: f"round(greatest(0.0, least(1.0, (tp * 1.0 / (tp + fn) + 3.8416 / (2 * (tp + fn)) {sign} 1.96 * sqrt(tp * 1.0 / (tp + fn) * (1 - tp * 1.0 / (tp + fn)) / (tp + fn) + 3.8416 / (4.0 * (tp + fn) * (tp + fn)))) / (1 + 3.8416 / (tp + fn)))), 4)"


@query(f"""WITH {VERDICTS}, c AS (SELECT count(*) FILTER (score >= 0.7 AND check_id % 3 = 0) AS tp, count(*) FILTER (score >= 0.7 AND check_id % 3 <> 0) AS fp,
 count(*) FILTER (score < 0.7 AND check_id % 3 = 0) AS fn, count(*) FILTER (score < 0.7 AND check_id % 3 <> 0) AS tn FROM verdicts)
SELECT *, round((tp + tn) * 1.0 / (tp + tn + fp + fn), 6) AS accuracy, round(tp * 1.0 / (tp + fp), 6) AS "precision", round(tp * 1.0 / (tp + fn), 6) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1,
 {WILSON('-')} AS recall_low, {WILSON('+')} AS recall_high FROM c""")
def evaluation_metrics(spark, d):
    v = views.verdicts(spark, d).withColumn("truth", (F.col("check_id") % 3 == 0).cast("int"))
    return corpus.metrics(v, "truth", "score", 0.7)


@query(f"""WITH {VERDICTS}, c AS (SELECT score, count(*) FILTER (check_id % 3 = 0) AS a, count(*) FILTER (check_id % 3 <> 0) AS b FROM verdicts GROUP BY 1)
SELECT score, CAST(sum(a) OVER w AS BIGINT) AS tp, CAST(sum(b) OVER w AS BIGINT) AS fp FROM c WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)""")
def roc_points(spark, d):
    return corpus.roc(views.verdicts(spark, d).withColumn("truth", (F.col("check_id") % 3 == 0).cast("int")), "truth", "score")


@query(f"""WITH {PARTS}, c AS (SELECT conv_id, turn, text || ' ' || url AS text FROM conversations JOIN urls ON page_id = conv_id % (SELECT count(*) FROM pages))
SELECT conv_id, turn, regexp_extract(text, '(https?://[^ \\t\\n\\r]+)', 1) AS url FROM c""")
def chat_links(spark, d):
    """The first link of every message; the messages are given a page's URL."""
    n = views.table(spark, d, "pages").agg(F.count("*").alias("c"))
    c = views.table(spark, d, "conversations").crossJoin(F.broadcast(n)).withColumn("page_id", F.col("conv_id") % F.col("c"))
    c = c.join(views.urls(spark, d), "page_id").withColumn("text", F.concat_ws(" ", "text", "url"))
    return c.select("conv_id", "turn", first_url(F.col("text")).alias("url")).where("url is not null")


@query("SELECT domain, min(page_id) AS page_id, count(*) AS mentions FROM (SELECT page_id, unnest(regexp_extract_all(lower(html), '[a-z]+\\.example\\.(?:com|net|org)')) AS domain FROM pages) GROUP BY 1")
def page_domain_scan(spark, d):
    return page_domains(views.table(spark, d, "pages"), r"[a-z]+\.example\.(?:com|net|org)")


@query(f"WITH {PARTS}, {FEEDBACK} SELECT correct_verdict, count(*) AS n, count(DISTINCT url) AS urls FROM feedback GROUP BY 1")
def feedback_labels(spark, d):
    return views.feedback(spark, d).groupBy("correct_verdict").agg(F.count("*").alias("n"), F.count_distinct("url").alias("urls"))


@query(f"WITH {PARTS} SELECT page_id, (length(trim(url)) BETWEEN 3 AND 2048 AND NOT contains(trim(url), ' ') AND (contains(url, '.') OR contains(url, '://'))) AS is_valid FROM urls")
def url_validity(spark, d):
    return views.urls(spark, d).select("page_id", valid(F.col("url")).alias("is_valid"))
