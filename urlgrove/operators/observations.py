"""Registration and certificate features from observation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import FREE_ISSUERS, REGISTRARS
from ..functions.urls import literals

CERT_TIME = "MMM d HH:mm:ss yyyy z"


def cert_time(text):
    """``Jan  5 12:00:00 2024 GMT``, days padded with a space or not."""
    return F.try_to_timestamp(F.regexp_replace(text, " +", " "), F.lit(CERT_TIME))


#: Network columns that a labelled row may bring itself, with the value of an unknown one: those of registration, then those of the certificate.
REGISTRATION = {"domain_age_days": -1, "is_known_registrar": 0, "whois_ok": 0}
CERTIFICATE = {"has_valid_cert": 0, "cert_age_days": -1, "is_self_signed": 0, "tls_ok": 0, "cert_is_lets_encrypt": 0, "cert_validity_days": -1, "cert_san_count": -1}


def with_overrides(rows: DataFrame) -> DataFrame:
    """Network columns of labelled rows, as doubles: their own values (null or absent: not given), else those of an unknown host.

    A row without domain_age_days has no registration at all, one without has_valid_cert no certificate; a row with it counts as looked up unless it says otherwise.
    """
    given = lambda c: F.col(f"`{c}`").cast("double") if c in rows.columns else F.lit(None).cast("double")

    def block(lead: str, ok: str, defaults: dict[str, int]) -> list:
        there = given(lead).isNotNull()
        return [F.when(there, F.coalesce(given(c), F.lit(1.0 if c == ok else float(v)))).otherwise(float(v)).alias(c) for c, v in defaults.items()]

    keep = [F.col(f"`{c}`") for c in rows.columns if c not in REGISTRATION | CERTIFICATE]
    return rows.select(*keep, *block("domain_age_days", "whois_ok", REGISTRATION), *block("has_valid_cert", "tls_ok", CERTIFICATE))


def with_observations(urls: DataFrame, whois: DataFrame, tls: DataFrame, as_of: str) -> DataFrame:
    """Registration and certificate columns by host; imputed values where a host wasn't observed. At most one observation a host.

    ``whois``: host, created (date), registrar. ``tls``: host, issuer, not_before, not_after (certificate time), san (array), valid, self_signed.
    """
    day = F.to_date(F.lit(as_of))
    holds = lambda text, marks: F.exists(literals(marks), lambda m: F.contains(F.lower(text), m))
    w = whois.select("host", F.lit(1).alias("whois_ok"), F.greatest(F.datediff(day, "created"), F.lit(0)).alias("age"), holds(F.col("registrar"), REGISTRARS).cast("int").alias("known"))
    begin, end = F.to_date(cert_time(F.col("not_before"))), F.to_date(cert_time(F.col("not_after")))
    t = tls.select(
        "host", F.lit(1).alias("tls_ok"), F.col("valid").cast("int").alias("valid"), F.datediff(day, begin).alias("cert_age"), F.col("self_signed").cast("int").alias("self_signed"),
        holds(F.col("issuer"), FREE_ISSUERS).cast("int").alias("free"), F.datediff(end, begin).alias("life"), F.when(F.col("san").isNotNull(), F.size("san")).alias("sans"),
    )
    out = urls.join(w, "host", "left").join(t, "host", "left")
    got = lambda c, default: F.coalesce(F.col(c), F.lit(default))
    return out.select(
        *urls.columns, got("age", -1).alias("domain_age_days"), got("known", 0).alias("is_known_registrar"), got("whois_ok", 0).alias("whois_ok"), got("valid", 0).alias("has_valid_cert"),
        got("cert_age", -1).alias("cert_age_days"), got("self_signed", 0).alias("is_self_signed"), got("tls_ok", 0).alias("tls_ok"), got("free", 0).alias("cert_is_lets_encrypt"),
        F.when(F.col("life") >= 0, F.col("life")).otherwise(-1).alias("cert_validity_days"), got("sans", -1).alias("cert_san_count"),
    )
