"""Which of many words stand inside a text: brands in titles and hosts.

Words are looked up as keys, not tried one by one. Every place of a text gives its next ``GRAM``
characters; a table of the words' first ``GRAM`` characters says which lengths of words may begin there; only
substrings of these lengths are joined with the words. The keys of a text grow with its length
(times the few lengths of words that share a beginning), whatever the number of words is, and texts and words meet
in equi-joins on spread keys. Equal texts are matched once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM = 4


def found_words(texts: DataFrame, text: str, words: DataFrame, word: str, least: int = 1) -> DataFrame:
    """(text, word): each distinct text of the column with each distinct word of ``least`` letters or more that it contains."""
    words = words.select(F.col(word).alias("_word")).where(F.length("_word") >= max(1, least)).distinct()
    begins = words.groupBy(F.substring("_word", 1, GRAM).alias("_gram")).agg(F.collect_set(F.length("_word")).alias("_lengths"))  # lengths, not words
    distinct = texts.select(F.col(text).alias("_text")).where("_text <> ''").distinct()
    places = distinct.select("_text", F.posexplode(F.sequence(F.lit(1), F.length("_text"))).alias("_pos", "_at"))
    # a word shorter than GRAM is its own beginning, so a place offers such beginnings as well, if words may be short
    grams = F.array_distinct(F.array(*(F.substring("_text", F.col("_at"), F.lit(n)) for n in range(min(max(1, least), GRAM), GRAM + 1))))
    places = places.select("_text", "_at", F.explode(grams).alias("_gram"))
    near = places.join(begins, "_gram").select("_text", "_at", F.explode("_lengths").alias("_n"))
    keys = near.where(F.col("_at") + F.col("_n") - 1 <= F.length("_text")).select("_text", F.expr("substring(_text, _at, _n)").alias("_word")).distinct()
    return keys.join(words, "_word", "left_semi").select(F.col("_text").alias(text), F.col("_word").alias(word))


def longest_word(df: DataFrame, text: str, words: DataFrame, word: str, out: str) -> DataFrame:
    """Add ``out``: the longest word that the text contains, the smaller of equal ones; null if none."""
    found = found_words(df, text, words, word)
    best = found.groupBy(text).agg(F.min(F.struct((-F.length(word)).alias("n"), F.col(word).alias("w"))).alias("_b")).select(text, F.col("_b.w").alias(out))
    return df.join(best, text, "left")


def foreign_word(df: DataFrame, text: str, host: str, words: DataFrame, word: str, least: int = GRAM) -> DataFrame:
    """Add ``_foreign``: whether the text contains a word of ``least`` letters or more that the host doesn't."""
    found = found_words(df, text, words, word, least)
    pairs = df.select(text, host).where(F.col(text) != "").distinct().join(found, text)
    hit = pairs.where(~F.contains(F.col(host), F.col(word))).select(text, host).distinct().withColumn("_foreign", F.lit(True))
    return df.join(hit, [text, host], "left")
