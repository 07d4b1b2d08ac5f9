"""Named rules over feature columns, their combination, and the final score."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import OFFICIAL, PASSWORD_FIELD, PHISHING, SAFE_CAP, SUSPICIOUS, TITLE
from .mentions import foreign_word
from .targeting import is_private

c = F.col
#: rule id -> (delta, pinned label, condition). Users add their own.
RULES: dict[str, tuple[float, str | None, Callable[[], Column]]] = {
    "AT_TRICK": (0.55, "phishing", lambda: c("norm").rlike("://[^/]*@")),
    "IDN_HOMOGRAPH": (0.45, "phishing", lambda: (c("has_punycode") == 1) & (c("homoglyph_distance") <= 2)),
    "TYPOSQUAT_CRED": (0.40, "phishing", lambda: (c("is_typosquat") == 1) & (c("has_login_keyword") == 1)),
    "PATH_BRAND_BAIT": (0.30, "phishing", lambda: (c("path_brand_hit") == 1) & (c("has_suspicious_tld") == 1)),
    "IP_CRED": (0.50, "phishing", lambda: (c("has_ip") == 1) & (c("has_login_keyword") == 1)),
    "WHITELIST_EXACT": (-0.60, "safe", lambda: (c("min_edit_distance") == 0) & (c("is_typosquat") == 0) & (c("has_ip") == 0) & (c("has_punycode") == 0)),
    "CHEAP_TLD_PLAIN": (0.20, None, lambda: (c("has_suspicious_tld") == 1) & (c("has_https") == 0) & (c("has_ip") == 0)),
}


def label_of(score: Column) -> Column:
    return F.when(score >= PHISHING, "phishing").when(score >= SUSPICIOUS, "suspicious").otherwise("safe")


def evaluate(df: DataFrame, rules: dict = RULES) -> DataFrame:
    """Add ``rules``: the hits in order, the clamped sum of deltas and the pinned label; a phishing pin beats a safe one."""
    hit = lambda name, delta, pin, when: F.when(when(), F.struct(F.lit(name).alias("rule_id"), F.lit(delta).alias("delta"), F.lit(pin).cast("string").alias("pin_label")))
    df = df.withColumn("hits", F.array_compact(F.array(*(hit(n, *r) for n, r in rules.items()))))
    total = F.aggregate("hits", F.lit(0.0), lambda s, h: s + h.delta)
    pinned = lambda label: F.exists("hits", lambda h: h.pin_label.eqNullSafe(F.lit(label)))
    return df.withColumns({
        "score_delta": F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), total)), 4),
        "pinned_label": F.when(pinned("phishing"), "phishing").when(pinned("safe"), "safe"),
    })


def final_score(df: DataFrame, base: str = "base_score") -> DataFrame:
    """Add score and label from a base score and the evaluated rules."""
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(base) + F.col("score_delta"))), 4)
    pin = F.col("pinned_label")
    score = F.when(pin == "phishing", F.greatest(score, F.lit(PHISHING))).when(pin == "safe", F.least(score, F.lit(SAFE_CAP))).otherwise(score)
    return df.withColumn("score", score).withColumn("label", F.coalesce(pin, label_of(F.col("score"))))


def content_adjustment(df: DataFrame, trusted: DataFrame, key: str, least: int = 4) -> DataFrame:
    """Add content_delta from ``html``, ``host`` and ``netloc``: a brand in the title but not in the host, a password field, an official suffix in the title.

    Private hosts and pages without html give 0, and so do pages whose ``status``, if there is one, isn't 2xx. Brands are looked up in titles by keys, so their number has no bound.
    """
    html = F.when(F.col("status").between(200, 299), F.col("html")) if "status" in df.columns else F.col("html")
    page = F.substring(html, 1, 65536)
    title = F.trim(F.lower(F.regexp_extract(page, TITLE, 1)))
    df = df.withColumns({"_title": F.coalesce(title, F.lit("")), "_asks": F.coalesce(page.rlike(PASSWORD_FIELD), F.lit(False)), "_place": F.coalesce(F.regexp_replace(F.lower("netloc"), r"^www\.", ""), F.lit(""))})
    out = foreign_word(df, "_title", "_place", trusted, "label", least)
    delta = F.when(F.col("_foreign"), 0.15).otherwise(0.0) + F.when(F.col("_asks"), 0.10).otherwise(0.0) - F.when(F.col("_title").rlike(OFFICIAL), 0.10).otherwise(0.0)
    delta = F.when(is_private(F.col("_place")), 0.0).otherwise(F.greatest(F.lit(-0.2), F.least(F.lit(0.3), delta)))
    return out.withColumn("content_delta", F.round(delta, 4)).drop("_title", "_asks", "_place", "_foreign")
