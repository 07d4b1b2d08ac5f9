"""International host names: decoded labels, look-alike folds and mixed scripts.

Only labels with characters beyond ASCII or an xn-- prefix reach Python, in Arrow batches and once
for each distinct value of a batch; all others pass as nulls. The rest are built-in expressions.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .constants import CONFUSABLE, FULL_WIDTH, LATIN, LOOKS_LIKE

#: Scripts that are told apart inside a label; all other characters beyond ASCII are one more.
SCRIPTS = {
    "cyrillic": r"\p{IsCyrillic}", "greek": r"\p{IsGreek}", "latin": r"\p{IsLatin}&&[^＀-￯]&&[^\x00-\x7F]", "arabic": r"\p{IsArabic}", "hebrew": r"\p{IsHebrew}",
    "thai": r"฀-๿", "full width": r"！-｠", "cjk": r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}&&[^＀-￯]",
}


def is_odd(text: Column) -> Column:
    """True where a text has an xn-- label or a character beyond ASCII."""
    return text.rlike(r"(?i)(^|\.)xn--|[^\x00-\x7F]")


def _label(label: str) -> str:
    if not label.lower().startswith("xn--"):
        return label
    try:
        return label.lower().encode("ascii").decode("idna")
    except UnicodeError:
        return label


def _host(host: str) -> str:
    return ".".join(map(_label, host.split(".")))


def _bare(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", _host(text)) if not unicodedata.combining(c))


def _ascii(host: str) -> str:
    try:
        return host.encode("idna").decode("ascii")
    except UnicodeError:
        return host


def _each(f, texts: pd.Series) -> pd.Series:
    known = {t: f(t) for t in texts.dropna().unique()}
    return pd.Series([known.get(t) for t in texts], dtype=object)


@F.pandas_udf(StringType())
def _decoded(texts: pd.Series) -> pd.Series:
    return _each(_host, texts)


@F.pandas_udf(StringType())
def _decomposed(texts: pd.Series) -> pd.Series:
    return _each(_bare, texts)


@F.pandas_udf(StringType())
def _encoded(texts: pd.Series) -> pd.Series:
    return _each(_ascii, texts)


def decoded(host: Column) -> Column:
    """The host as a browser shows it: each xn-- label in Unicode, or as it is where that fails."""
    return F.coalesce(_decoded(F.when(is_odd(host), host)), host)


def encoded(host: Column) -> Column:
    """The host in ASCII, its labels beyond ASCII as xn-- labels; as it is where that fails."""
    return F.coalesce(_encoded(F.when(is_odd(host), host)), host)


def folded(label: Column) -> Column:
    """Decoded, without combining marks, look-alike letters replaced by the Latin ones, lower case."""
    bare = F.coalesce(_decomposed(F.when(is_odd(label), label)), label)
    return F.lower(F.translate(bare, CONFUSABLE + FULL_WIDTH, LOOKS_LIKE + LATIN))


def mixed_script(host: Column) -> Column:
    """True where a label of a decoded host has ASCII letters beside other characters, or two other scripts."""
    has = lambda x, chars: x.rlike(f"[{chars}]")
    rest = lambda x: has(F.regexp_replace(x, "|".join(f"[{c}]" for c in SCRIPTS.values()), ""), r"^\x00-\x7F")
    count = lambda x: sum((has(x, c).cast("int") for c in SCRIPTS.values()), rest(x).cast("int"))
    mixed = F.exists(F.split(host, r"\."), lambda x: (has(x, "A-Za-z") & has(x, r"^\x00-\x7F")) | (count(x) > 1))
    return F.coalesce(host.rlike(r"[^\x00-\x7F]") & mixed, F.lit(False))


def international(df: DataFrame) -> DataFrame:
    """Add decoded_host and has_mixed_script (0 for IP hosts) to the columns of ``lexical``."""
    df = df.withColumn("decoded_host", decoded(F.col("host")))
    return df.withColumn("has_mixed_script", F.when(F.col("has_ip") == 1, 0).otherwise(mixed_script(F.col("decoded_host")).cast("int")))
