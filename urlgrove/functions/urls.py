"""URL parts and lexical features as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .constants import LOGIN_KEYWORDS, REGISTRABLE_SUFFIXES, SUFFIXES, SUSPICIOUS_TLDS, TLD_TYPES

IPV4 = r"^((25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(25[0-5]|2[0-4]\d|1?\d?\d)$"


def literals(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def normalized(url: Column) -> Column:
    """Trimmed; http:// in front when there is no :// anywhere."""
    return F.when(F.contains(F.trim(url), F.lit("://")), F.trim(url)).otherwise(F.concat(F.lit("http://"), F.trim(url)))


def url_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """norm, scheme, netloc, path (without ;params of the last segment), query, host (lower case, no user or port), labels."""
    df = df.withColumn("norm", normalized(F.col(url)))
    at = lambda pattern: F.regexp_extract("norm", pattern, 1)
    df = df.withColumns({
        "scheme": F.lower(at(r"^([A-Za-z][A-Za-z0-9+.\-]*):")),
        "netloc": at(r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)"),
        "path": F.regexp_replace(at(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)"), r";[^/]*$", ""),
        "query": at(r"^[^?#]*\?([^#]*)"),
    })
    bare = F.lower(F.regexp_replace("netloc", r"^.*@", ""))
    df = df.withColumn("host", F.when(bare.startswith("["), F.regexp_extract(bare, r"^\[([^\]]*)", 1)).otherwise(F.regexp_replace(bare, r":.*$", "")))
    return df.withColumns({"labels": parts_of(F.split("host", r"\.")), "path_parts": parts_of(F.split("path", "/"))})


def parts_of(array: Column) -> Column:
    return F.filter(array, lambda x: x != "")


def is_ip(host: Column) -> Column:
    return host.rlike(IPV4) | (F.contains(host, F.lit(":")) & host.rlike("^[0-9a-f:]+$"))


def has_suffix(host: Column, suffixes: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [(host == s) | host.endswith("." + s) for s in suffixes])


def registrable(host: Column, labels: Column) -> Column:
    host = F.btrim(host, F.lit("."))  # a final dot is no part of the name
    n = F.when(has_suffix(host, REGISTRABLE_SUFFIXES), 3).otherwise(2)
    return F.when(F.size(labels) <= n, host).otherwise(F.array_join(F.slice(labels, -n, n), "."))


def brand_label(host: Column, labels: Column) -> Column:
    """The first label of the registrable domain."""
    return F.split_part(registrable(host, labels), F.lit("."), F.lit(1))


def etld(host: Column, labels: Column) -> Column:
    known = F.filter(literals(SUFFIXES), lambda s: (host == s) | host.endswith(F.concat(F.lit("."), s)))
    return F.coalesce(F.get(known, F.lit(0)), F.element_at(labels, -1), F.lit(""))


def occurrences(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, six decimals; 0 for no text."""
    chars, n = F.split(text, ""), F.length(text)
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    total = F.aggregate(F.array_distinct(F.filter(chars, lambda c: c != "")), F.lit(0.0), lambda s, c: s - share(c) * F.log2(share(c)))
    return F.when(n > 0, F.round(total, 6)).otherwise(0.0)


def words_of(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))


def lexical(df: DataFrame) -> DataFrame:
    """Lexical feature columns beside those of ``url_parts``."""
    host, labels, norm = F.col("host"), F.col("labels"), F.col("norm")
    digits = F.regexp_count(norm, F.lit(r"\p{Nd}"))
    host_digits, letters = F.regexp_count(host, F.lit(r"\p{Nd}")), F.regexp_count(host, F.lit(r"\p{L}"))
    port = F.regexp_extract("netloc", r":(\d+)$", 1)
    flag = lambda c: c.cast("int")
    tld_type = F.coalesce(F.get(F.filter(literals(TLD_TYPES), lambda s: host.endswith(F.concat(F.lit("."), s))), F.lit(0)), F.lit("other"))
    longest = lambda a: F.coalesce(F.array_max(F.transform(a, F.length)), F.lit(0))
    return df.withColumns({
        "url_length": F.length(norm),
        "num_dots": occurrences(norm, "."), "num_hyphens": occurrences(norm, "-"), "num_at": occurrences(norm, "@"), "num_slash": occurrences(norm, "/"),
        "num_digits": digits,
        "has_ip": flag(is_ip(host)),
        "entropy": entropy(norm),
        "has_https": flag(F.col("scheme") == "https"),
        "num_subdomains": F.when(is_ip(host), 0).otherwise(F.greatest(F.lit(0), F.size(labels) - F.when(has_suffix(host, SUFFIXES), 3).otherwise(2))),
        "is_thai_tld": flag(host.endswith(".th")),
        "tld_type": tld_type,
        "tld_type_enc": F.array_position(literals([*TLD_TYPES, "other"]), tld_type).cast("int") - 1,
        "path_depth": F.size("path_parts"),
        "domain_label_max_len": longest(labels),
        "has_port": flag((port != "") & ~port.isin("80", "443")),
        "max_digit_run": longest(F.regexp_extract_all(host, F.lit(r"\d+"), F.lit(0))),
        "has_query_string": flag(F.col("query") != ""),
        "has_punycode": flag(F.exists(labels, lambda x: x.startswith("xn--"))),
        "has_login_keyword": flag(F.arrays_overlap(words_of(norm), literals(LOGIN_KEYWORDS))),
        "has_suspicious_tld": flag(etld(host, labels).isin(SUSPICIOUS_TLDS)),
        "path_length": F.length("path"),
        "num_login_keywords": F.size(F.array_intersect(words_of(F.concat_ws(" ", "path", "query")), literals(LOGIN_KEYWORDS))),
        "query_param_count": F.when(F.col("query") == "", 0).otherwise(occurrences(F.col("query"), "&") + 1),
        "path_entropy": entropy(F.coalesce(F.try_url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), F.col("path"))),
        "host_token_count": F.size(F.regexp_extract_all(host, F.lit(r"[^.\-]+"), F.lit(0))),
        "digit_to_letter_ratio": F.round(F.when(letters > 0, host_digits / letters).otherwise(host_digits.cast("double")), 6),
    })


def path_shape(path: Column) -> Column:
    trimmed = F.lower(F.regexp_replace(path, "^/+|/+$", ""))
    shape = F.regexp_replace(F.regexp_replace(trimmed, r"\b[0-9a-f]{8,}\b", r"\$hex"), r"\d+", "#")
    return F.substring(shape, 1, 120)


def fingerprint(brand: Column, host: Column, path: Column) -> Column:
    tld = F.when(F.contains(host, F.lit(".")), F.regexp_extract(host, r"([^.]*)$", 1)).otherwise("")
    return F.substring(F.concat(F.lower(F.coalesce(brand, F.lit(""))), F.lit("|"), tld, F.lit("|"), path_shape(path)), 1, 240)
