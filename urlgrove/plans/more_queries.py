"""Queries over URLs of many shapes, observations, sources, corpora and models, each beside its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.constants import FREE_ISSUERS, REGISTRARS, SHORTENERS
from ..functions import idn
from ..functions.urls import etld, lexical, url_parts
from ..operators import corpus, observations, reports, targeting
from ..operators.brands import closest_brand
from ..operators import verdicts as V
from ..sinks import tables as sinks
from . import views
from .queries import query
from .views import AS_OF, BRANDS, FEEDBACK, IP, PARTS, SHAPED, TH, VERDICTS, shaped

@query(f"""WITH {PARTS}, {SHAPED} SELECT page_id, CAST({IP} AS INT) AS has_ip, CAST(regexp_matches(netloc, ':8443$') AS INT) AS has_port, CAST(contains(host, 'xn--') AS INT) AS has_punycode,
 length(url) - length(replace(url, '@', '')) AS num_at, CASE WHEN {IP} THEN 0 ELSE greatest(0, len(string_split(host, '.')) - CASE WHEN host LIKE '%.go.th' THEN 3 ELSE 2 END) END AS num_subdomains,
 CAST(host LIKE '%.th' AS INT) AS is_thai_tld, CASE WHEN host LIKE '%.go.th' THEN 'go.th' ELSE 'other' END AS tld_type, CASE WHEN host LIKE '%.go.th' THEN 0 ELSE 4 END AS tld_type_enc,
 CASE WHEN host LIKE '%.go.th' THEN 'go.th' ELSE split_part(host, '.', -1) END AS etld FROM s""")
def shaped_features(spark, d):
    x = lexical(shaped(spark, d)).withColumn("etld", etld(F.col("host"), F.col("labels")))
    return x.select("page_id", "has_ip", "has_port", "has_punycode", "num_at", "num_subdomains", "is_thai_tld", "tld_type", "tld_type_enc", "etld")


@query(f"""WITH {PARTS}, {SHAPED} SELECT page_id, CASE WHEN contains(netloc, '@') THEN 'at_redirect' WHEN regexp_matches(host, '\\.go\\.th\\.') THEN 'subdomain_spoof' WHEN host LIKE '%.xyz' OR host LIKE '%.top' THEN 'cheap_tld'
 WHEN contains(host, 'xn--') THEN 'punycode' WHEN {IP} THEN 'ip_host' ELSE 'other' END AS pattern FROM s""")
def attack_patterns(spark, d):
    return shaped(spark, d).select("page_id", corpus.attack_pattern(F.col("netloc"), F.col("host")).alias("pattern"))


#: Watched words: trusted labels of plain letters, and a code.
WATCHED = "watched AS (SELECT DISTINCT label AS brand FROM trusted WHERE regexp_matches(label, '^[a-z]{4,}$') UNION SELECT 'kplus')"
HAS = "list_has_any({}, (SELECT list(brand) FROM watched))"
GENUINE = "regexp_matches(host, '(^|\\.)" + TH[1:-1]


@query(f"""WITH {BRANDS}, {SHAPED}, {WATCHED} SELECT page_id, regexp_matches(lower(url), '\\.' || {TH} || '.') OR (NOT {GENUINE}$') AND {HAS.format("string_split(host, '.')")}) AS a_suffix,
 regexp_matches(lower(url), '\\.' || {TH} || '\\.') OR (NOT {GENUINE}$') AND {HAS.format("regexp_split_to_array(host, '[.\\-_]')")}) AS imitates,
 regexp_matches(lower(url), '\\.th|thai') AS mentions, lower(netloc) IN ({', '.join(f"'{h}'" for h in SHORTENERS)}) AS short FROM s""")
def targeting_classes(spark, d):
    brands, url, host = targeting.brand_keywords(views.trusted(spark, d), ["kplus"]), F.col("url"), F.col("host")
    s = targeting.with_brand_token(shaped(spark, d), brands, F.col("labels"), "in_labels")
    s = targeting.with_brand_token(s, brands, targeting.host_tokens(host), "in_tokens")
    return s.select("page_id", targeting.names_country_suffix(url, host, F.col("in_labels")).alias("a_suffix"), targeting.imitates_country(url, host, F.col("in_tokens")).alias("imitates"), targeting.mentions_country(url).alias("mentions"), targeting.is_shortener(F.col("netloc")).alias("short"))


@query(f"""WITH {PARTS}, {SHAPED} SELECT s.page_id, CASE WHEN s.page_id % 9 = 8 AND s.page_id % 2 = 0 THEN u.url ELSE s.url END AS expanded_url FROM s JOIN urls u USING (page_id)""")
def short_links(spark, d):
    final = views.urls(spark, d).where("page_id % 2 = 0").select(F.concat(F.lit("https://bit.ly/"), F.col("page_id").cast("string")).alias("url"), F.col("url").alias("final_url"))
    return targeting.expanded(shaped(spark, d), final).select("page_id", "expanded_url")


@query(f"""WITH {PARTS}, h AS (SELECT host, min(page_id) AS k FROM p GROUP BY 1) SELECT p.page_id, CASE WHEN k % 4 = 0 THEN -1 ELSE greatest(0, k % 3000 - 30) END AS domain_age_days,
 CAST(k % 4 > 0 AND k % 3 = 0 AS INT) AS is_known_registrar, CAST(k % 4 > 0 AS INT) AS whois_ok, CAST(k % 5 > 0 AND k % 2 = 0 AS INT) AS has_valid_cert, CASE WHEN k % 5 > 0 THEN 10 ELSE -1 END AS cert_age_days,
 CAST(k % 5 > 0 AND k % 7 = 0 AS INT) AS is_self_signed, CAST(k % 5 > 0 AS INT) AS tls_ok, CAST(k % 5 > 0 AND k % 3 = 1 AS INT) AS cert_is_lets_encrypt, CASE WHEN k % 5 > 0 THEN 90 ELSE -1 END AS cert_validity_days,
 CASE WHEN k % 5 > 0 AND k % 6 > 0 THEN 2 ELSE -1 END AS cert_san_count FROM p JOIN h USING (host)""")
def observed_features(spark, d):
    p = url_parts(views.urls(spark, d))
    out = observations.with_observations(p.select("page_id", "host"), *observed(p), AS_OF)
    return out.drop("host")


def observed(p):
    """Registrations and certificates of most hosts of ``p`` (host, page_id), by the host's first page."""
    h = p.groupBy("host").agg(F.min("page_id").alias("k"))
    day = F.to_date(F.lit(AS_OF))
    whois = h.where("k % 4 > 0").select("host", F.date_sub(day, (F.col("k") % 3000 - 30).cast("int")).alias("created"), F.when(F.col("k") % 3 == 0, f"The {REGISTRARS[0].upper()} Co").otherwise("Other Ltd").alias("registrar"))
    time = lambda n: F.date_format(F.date_add(day, n), "MMM  d HH:mm:ss yyyy 'GMT'")
    tls = h.where("k % 5 > 0").select("host", F.when(F.col("k") % 3 == 1, f"CN={FREE_ISSUERS[0].title()}").otherwise("CN=Own CA").alias("issuer"), time(-10).alias("not_before"), time(80).alias("not_after"),
        F.when(F.col("k") % 6 > 0, F.array("host", F.concat(F.lit("www."), "host"))).alias("san"), (F.col("k") % 2 == 0).alias("valid"), (F.col("k") % 7 == 0).alias("self_signed"))
    return whois, tls


@query("""WITH e AS (SELECT event_type AS source, ts, event_id, CASE WHEN event_id % 17 = 0 THEN 'error ' || CAST(event_id % 5 AS VARCHAR) END AS error, event_id % 7 - 1 AS ingested FROM events)
SELECT source, max(ts) AS last_polled_at, arg_max(error, ts) FILTER (error IS NOT NULL) AS last_error, CAST(sum(greatest(ingested, 0)) AS BIGINT) AS total_ingested, count(error) AS errors FROM e GROUP BY 1""")
def source_stats(spark, d):
    e = views.table(spark, d, "events").select(F.col("event_type").alias("source"), F.col("ts").alias("polled_at"), F.when(F.col("event_id") % 17 == 0, F.concat(F.lit("error "), (F.col("event_id") % 5).cast("string"))).alias("error"), (F.col("event_id") % 7 - 1).alias("ingested"))
    return reports.source_stats(e)


@query(f"WITH {VERDICTS} SELECT event_type AS source, label, count(*) AS n FROM verdicts GROUP BY 1, 2")
def checks_by_source(spark, d):
    return views.verdicts(spark, d).groupBy(F.col("event_type").alias("source"), "label").agg(F.count("*").alias("n"))


@query(f"""WITH {BRANDS} SELECT CASE WHEN length(label) % 2 = 0 THEN 'even' ELSE 'odd' END AS category, count(*) AS n FROM trusted GROUP BY 1""")
def trusted_by_category(spark, d):
    return views.trusted(spark, d).groupBy(F.when(F.length("label") % 2 == 0, "even").otherwise("odd").alias("category")).agg(F.count("*").alias("n"))


@query(f"WITH {BRANDS} SELECT domain, label FROM trusted WHERE domain ILIKE '%a%' ORDER BY domain LIMIT 50")
def trusted_search(spark, d):
    return views.trusted(spark, d).where(F.col("domain").ilike("%a%")).orderBy("domain").limit(50)


@query(f"""WITH {PARTS}, b AS (SELECT split_part(host, '.', -2) AS brand, count(*) AS n, count(*) FILTER (page_id % 10 < 3) AS h FROM p GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS total, count(*) AS brands, round(sum(n) * 1.0 / count(*), 4) AS mean_per_brand, max(n) AS max_per_brand, round(sum(h) * 1.0 / sum(n), 4) AS holdout_share FROM b""")
def corpus_audit(spark, d):
    p = url_parts(views.urls(spark, d)).select(F.element_at("labels", -2).alias("brand"), "page_id")
    return reports.corpus_audit(p, "brand", F.col("page_id") % 10 < 3)


@query("""SELECT quality AS label, doc_id % 10 < 3 AS held, count(*) AS n, (SELECT abs(count(*) FILTER (quality = 1) - count(*) FILTER (quality = 0)) FROM labels) AS needed FROM labels GROUP BY 1, 2""")
def class_balance(spark, d):
    l = views.table(spark, d, "labels")  # noqa: E741
    need = l.agg(F.abs(F.count_if(F.col("quality") == 1) - F.count_if(F.col("quality") == 0)).alias("needed"))
    return l.groupBy(F.col("quality").alias("label"), (F.col("doc_id") % 10 < 3).alias("held")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(need))  # one row


SUMMED = ["url_length", "path_length", "num_dots"]


@query(f"""WITH {PARTS}, x AS (SELECT length(url) AS url_length, length(path) AS path_length, length(url) - length(replace(url, '.', '')) AS num_dots FROM p),
l AS (SELECT feature, CAST(value AS DOUBLE) AS value FROM (UNPIVOT x ON url_length, path_length, num_dots INTO NAME feature VALUE value)) SELECT feature, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most FROM l GROUP BY 1""")
def feature_summary(spark, d):
    return reports.summary(lexical(url_parts(views.urls(spark, d))), SUMMED)


@query(f"""WITH {VERDICTS}, c AS (SELECT score, count(*) FILTER (check_id % 3 = 0) AS p, count(*) FILTER (check_id % 3 <> 0) AS n FROM verdicts GROUP BY 1),
bl AS (SELECT *, coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c) SELECT round(CAST(sum(p * (below + n / 2.0)) AS DOUBLE) / (CAST(sum(p) AS DOUBLE) * CAST(sum(n) AS DOUBLE)), 6) AS auc FROM bl""")
def roc_area(spark, d):
    return reports.auc(views.verdicts(spark, d).withColumn("truth", (F.col("check_id") % 3 == 0).cast("int")), "truth", "score")


@query(f"""WITH {VERDICTS} SELECT event_type AS cohort, count(*) AS n, round(count(*) FILTER (score >= 0.7) * 1.0 / count(*), 4) AS recall_high, round(count(*) FILTER (score >= 0.3) * 1.0 / count(*), 4) AS recall_low,
 round(avg(score), 6) AS mean_score, count(*) FILTER (score < 0.7) AS misses FROM verdicts WHERE check_id % 3 = 0 GROUP BY 1""")
def holdout_recall(spark, d):
    return reports.holdout_recall(views.verdicts(spark, d).where("check_id % 3 = 0").withColumnRenamed("event_type", "cohort"), "cohort")


@query(f"WITH {VERDICTS} SELECT check_id, url, score FROM verdicts WHERE check_id % 3 = 0 AND score < 0.7 ORDER BY score, check_id LIMIT 5")
def lowest_misses(spark, d):
    return views.verdicts(spark, d).where("check_id % 3 = 0 and score < 0.7").orderBy("score", "check_id").limit(5).select("check_id", "url", "score")


@query(f"""WITH {VERDICTS}, f AS (SELECT check_id % 5 AS fold, count(*) FILTER (score >= 0.7 AND check_id % 3 = 0) AS tp, count(*) FILTER (score >= 0.7 AND check_id % 3 <> 0) AS fp, count(*) FILTER (score < 0.7 AND check_id % 3 = 0) AS fn FROM verdicts GROUP BY 1)
SELECT round(avg(2.0 * tp / (2 * tp + fp + fn)), 6) AS mean_f1, round(stddev_pop(2.0 * tp / (2 * tp + fp + fn)), 6) AS std_f1 FROM f""")
def fold_scores(spark, d):
    hit, true = F.col("score") >= 0.7, F.col("check_id") % 3 == 0
    f = views.verdicts(spark, d).groupBy(F.col("check_id") % 5).agg(F.count_if(hit & true).alias("tp"), F.count_if(hit & ~true).alias("fp"), F.count_if(~hit & true).alias("fn"))
    f1 = 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return f.agg(F.round(F.avg(f1), 6).alias("mean_f1"), F.round(F.stddev_pop(f1), 6).alias("std_f1"))


@query("""WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS nth, count(*) OVER (PARTITION BY quality) AS n FROM labels)
SELECT doc_id, quality, CAST(nth % 5 AS INTEGER) AS fold, nth < CAST(floor(n * 0.3 + 0.5) AS BIGINT) AS held FROM r""")
def exact_folds(spark, d):
    """Folds stratified by label, and an exact three tenths of each label held out."""
    l = views.table(spark, d, "labels").select("doc_id", "quality")  # noqa: E741
    n = l.groupBy("quality").agg(F.count("*").alias("n"))
    r = reports.ranked_in(l, "quality", "doc_id").join(F.broadcast(n), "quality")  # a row a label
    return r.select("doc_id", "quality", (F.col("nth") % 5).cast("int").alias("fold"), (F.col("nth") < F.floor(F.col("n") * 0.3 + 0.5)).alias("held"))


@query(f"""WITH {BRANDS}, e AS (SELECT DISTINCT brand FROM b WHERE page_id % 3 = 0), a AS (SELECT DISTINCT brand FROM b WHERE page_id % 2 = 0), r AS (SELECT DISTINCT brand FROM b WHERE page_id % 7 = 0)
SELECT brand, CASE WHEN brand IN (SELECT brand FROM r) THEN 'deleted' ELSE 'kept' END AS status FROM e UNION ALL SELECT brand, CASE WHEN brand IN (SELECT brand FROM e) THEN 'conflict' ELSE 'added' END FROM a""")
def table_maintenance(spark, d):
    b = url_parts(views.urls(spark, d)).select(F.element_at("labels", -2).alias("brand"), "page_id")
    return reports.maintained(b.where("page_id % 3 = 0"), b.where("page_id % 2 = 0"), b.where("page_id % 7 = 0"), "brand")


@query(f"""WITH {PARTS}, {SHAPED}, x AS (SELECT page_id, CAST(url LIKE 'https:%' AS DOUBLE) AS has_https, CAST({IP} AS DOUBLE) AS has_ip, CAST(length(url) AS DOUBLE) AS url_length FROM s),
l AS (SELECT * FROM (UNPIVOT x ON has_https, has_ip, url_length INTO NAME feature VALUE value))
SELECT page_id, feature, value, CASE feature WHEN 'has_https' THEN 'transport' WHEN 'has_ip' THEN 'host' ELSE 'other' END AS "group", CASE feature WHEN 'has_https' THEN 'Encrypted' WHEN 'has_ip' THEN 'Bare address' ELSE feature END AS title,
 CASE feature WHEN 'has_https' THEN value = 0 WHEN 'has_ip' THEN value = 1 ELSE false END AS notable FROM l""")
def explanation_rows(spark, d):
    x = lexical(shaped(spark, d)).select("page_id", "has_https", "has_ip", "url_length")
    return reports.explained(x, "page_id", {"has_https": ("transport", "Encrypted"), "has_ip": ("host", "Bare address")})


@query(f"""WITH {VERDICTS}, x AS (SELECT *, list_filter([CASE WHEN at_trick THEN 'the host is hidden behind @' END, CASE WHEN idn THEN 'look-alike letters of a brand' END, CASE WHEN typo_cred THEN 'close to a brand, with words of a login' END,
  CASE WHEN bait THEN 'a brand in the path of a cheap domain' END, CASE WHEN ip_cred THEN 'a bare address with words of a login' END, CASE WHEN plain THEN 'a cheap domain without encryption' END], lambda t: t IS NOT NULL) AS told,
 list_filter([CASE WHEN ip THEN 'a bare address' END, CASE WHEN puny THEN 'an encoded name' END, CASE WHEN is_typosquat = 1 THEN 'close to a brand' END, CASE WHEN cheap THEN 'a cheap domain' END, CASE WHEN login THEN 'words of a login' END], lambda t: t IS NOT NULL) AS seen FROM verdicts)
SELECT check_id, CASE label WHEN 'phishing' THEN 'Dangerous: ' WHEN 'suspicious' THEN 'Take care: ' ELSE 'Looks safe: ' END || url || chr(10) ||
 CASE WHEN label <> 'safe' AND len(told) > 0 THEN array_to_string(told[1:3], '; ') WHEN len(seen) > 0 THEN array_to_string(seen[1:3], '; ') WHEN label = 'safe' THEN 'nothing suspicious' ELSE 'an unusual address' END AS reply FROM x""")
def verdict_replies(spark, d):
    v = views.verdicts(spark, d)
    return v.select("check_id", reports.reply(F.col("label"), F.col("url"), reports.reason(F.col("hits"), F.col("label"))).alias("reply"))


@query(f"WITH {VERDICTS} SELECT check_id, score, length(substr(html, 1, 65536)) AS size FROM verdicts JOIN pages USING (page_id) WHERE score > 0.3 AND score < 0.7")
def gray_zone(spark, d):
    v = views.verdicts(spark, d).where(targeting.gray_zone(F.col("score"))).select("check_id", "score", "page_id")
    return v.join(views.table(spark, d, "pages").select("page_id", F.length(F.substring("html", 1, 65536)).alias("size")), "page_id").drop("page_id")


@query(f"WITH {BRANDS} SELECT DISTINCT label AS brand FROM trusted WHERE regexp_matches(label, '^[a-z]{{4,}}$') UNION SELECT 'kplus'")
def brand_keywords(spark, d):
    return targeting.brand_keywords(views.trusted(spark, d), ["kplus"])


@query(f"""WITH {BRANDS}, hosts AS (SELECT DISTINCT host FROM b), m AS (SELECT host, arg_min(label, (-length(label), label)) AS brand FROM hosts JOIN trusted ON contains(host, label) GROUP BY 1)
SELECT host, coalesce(m.brand, split_part(host, '.', 1)) AS target_brand FROM hosts LEFT JOIN m USING (host)""")
def target_brands(spark, d):
    hosts = url_parts(views.urls(spark, d)).select("host").distinct()
    return targeting.attribute(hosts, views.trusted(spark, d).select(F.col("label").alias("brand"))).select("host", "target_brand")


@query(f"""WITH {PARTS}, f AS (SELECT url, CAST(quality AS VARCHAR) AS label, doc_id FROM labels l JOIN urls u ON u.page_id = l.doc_id % (SELECT count(*) FROM pages))
SELECT url, min(doc_id) AS ord, CAST(arg_min(label, doc_id) AS INTEGER) AS label FROM f WHERE label IN ('0', '1') AND url NOT IN (SELECT url FROM urls WHERE page_id % 5 = 0) GROUP BY 1""")
def accepted_feedback(spark, d):
    f = views.feedback(spark, d).join(views.table(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("label")), "doc_id")
    return targeting.accepted_feedback(f.select("url", "label", F.col("doc_id").alias("ord")), views.urls(spark, d).where("page_id % 5 = 0"))


@query(f"WITH {PARTS} SELECT url, min(CASE WHEN page_id % 3 = 0 THEN 0 ELSE 1 END) AS feed FROM urls GROUP BY 1")
def feeds_united(spark, d):
    u = views.urls(spark, d)
    both = u.where("page_id % 3 = 0").select("url", F.lit(0).alias("feed")).unionByName(u.where("page_id % 3 <> 0").select("url", F.lit(1).alias("feed")))
    return both.groupBy("url").agg(F.min("feed").alias("feed"))


#: Plain letters and those that each kind of spoofed host shows instead: Cyrillic, Cyrillic sent as xn--, accented, full width.
SPOOFS = {1: ("aeopc", "аеорс"), 2: ("aeopc", "аеорс"), 3: ("aeiou", "áéíóú"), 4: ("abcdefghijklmnopqrstuvwxyz", "".join(chr(0xFF41 + k) for k in range(26)))}
SPOOFED = "CASE page_id % 5 " + " ".join(f"WHEN {k} THEN translate(brand, '{a}', '{b}')" for k, (a, b) in SPOOFS.items()) + " ELSE brand END"


def spoofed(spark, d):
    """The pages' hosts, the label before the top-level domain written with look-alike letters by page_id; plain is that label as it was."""
    rows = views.urls(spark, d).select("page_id", F.lower(F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1)).alias("h"))
    plain, k = F.split_part("h", F.lit("."), F.lit(-2)), F.col("page_id") % 5
    shown = F.coalesce(*(F.when(k == n, F.translate(plain, a, b)) for n, (a, b) in SPOOFS.items()), plain)
    shown = F.concat_ws(".", shown, F.split_part("h", F.lit("."), F.lit(-1)))
    rows = rows.withColumn("shown", F.when(k == 2, shown)).withColumn("host", F.coalesce(idn.encoded(F.col("shown")), shown))
    return lexical(url_parts(rows.select("page_id", F.concat(F.lit("https://"), "host").alias("url"))))


@query(f"""WITH {BRANDS}, x AS (SELECT page_id, brand, {SPOOFED} AS shown, split_part(host, '.', -1) AS tld, min_edit_distance FROM h)
SELECT page_id, shown || '.' || tld AS decoded_host, CAST(regexp_matches(shown, '[a-z]') AND regexp_matches(shown, '[^\x00-\x7F]') AS INTEGER) AS has_mixed_script,
 CAST(page_id % 5 = 2 AND shown <> brand AS INTEGER) AS has_punycode, brand AS folded_label, min_edit_distance AS homoglyph_distance FROM x""")
def international_hosts(spark, d):
    x = closest_brand(idn.international(spoofed(spark, d)), views.trusted(spark, d))
    return x.select("page_id", "decoded_host", "has_mixed_script", "has_punycode", idn.folded(F.col("brand")).alias("folded_label"), "homoglyph_distance")


@query(f"""WITH {PARTS}, {FEEDBACK} SELECT url, CASE WHEN correct_verdict = 'phishing' THEN '1' ELSE '0' END AS label, 'feedback' AS source FROM feedback
WHERE TIMESTAMP '{AS_OF}' - to_days(CAST(doc_id % 30 AS INTEGER)) >= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY""")
def label_export(spark, d):
    at = F.lit(AS_OF).cast("timestamp") - F.make_dt_interval(F.col("doc_id") % 30)
    return sinks.label_rows(views.feedback(spark, d).withColumn("created_at", at), AS_OF, 14)


@query(f"""WITH {VERDICTS}, f AS (SELECT * FROM verdicts WHERE label = 'phishing' AND checked_at >= TIMESTAMP '{AS_OF}' - INTERVAL 336 HOUR AND checked_at <= TIMESTAMP '{AS_OF}' ORDER BY checked_at DESC, check_id LIMIT 2000)
SELECT 0 AS ord, '\ufeff' || 'url,score,closest_domain,edit_distance,checked_at' AS line
UNION ALL SELECT row_number() OVER (ORDER BY checked_at DESC, url), CASE WHEN regexp_matches(url, '[",]') THEN '"' || replace(url, '"', '""') || '"' ELSE url END || ',' || printf('%.4f', score) || ',' || coalesce(closest_domain, '') || ',' || coalesce(CAST(edit_distance AS VARCHAR), '') || ',' || strftime(checked_at, '%Y-%m-%dT%H:%M:%SZ') FROM f""")
def feed_csv_lines(spark, d):
    return sinks.feed_csv(V.indicators(views.verdicts(spark, d), AS_OF, 336))


@query(f"""WITH {VERDICTS}, watched AS (SELECT v.* EXCLUDE (brand), t.label AS brand FROM verdicts v JOIN trusted t ON split_part(v.closest_domain, '.', 1) = t.label WHERE v.label = 'phishing' AND length(t.label) % 2 = 1)
SELECT check_id, '{{"schema":"phish.alert.v1","brand":"' || brand || '","url":' || CAST(to_json(url) AS VARCHAR) || ',"label":"phishing","score":' || CAST(round(score, 4) AS VARCHAR) || ',"closest_domain":"' || closest_domain || '","reason":"watched","fired_at":"{AS_OF}"}}' AS payload FROM watched""")
def alert_payloads(spark, d):
    hits = V.watch_alerts(views.verdicts(spark, d), views.watch(spark, d)).withColumn("reason", F.lit("watched"))
    return hits.select("check_id", sinks.alert_payload(AS_OF).alias("payload"))
