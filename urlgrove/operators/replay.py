"""Replay of scored URLs into the verdict log and campaigns, with times drawn from the past.

Everything that is drawn (how often a URL was checked, which checks stay below the total, and when each took
place) is a function of seed, URL and number, so the rows of a replay are the same however often and on however many
machines it runs, and a batch written under the replay's own name stands in the log once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..streaming.step import write_batch
from .assembly import first_rows
from .verdicts import campaigns

#: How much each hour of the day counts.
HOURS = [1, 1, 1, 1, 1, 1, 2, 4, 7, 9, 9, 8, 7, 7, 8, 8, 7, 6, 5, 5, 4, 3, 2, 1]
#: Least and most checks of a harmless and of a risky URL.
HARMLESS, RISKY = (5, 11), (2, 6)
#: Where in the span of days the most checks lie, as a share counted back from now.
MODE = 0.35


def uniform(name: Column, what: str) -> Column:
    """From 0 up to 1 by name and purpose."""
    return F.conv(F.substring(F.md5(F.concat(name, F.lit(f"|{what}"))), 1, 13), 16, 10).cast("double") / float(1 << 52)


def between(u: Column, least: int, most: int) -> Column:
    return F.lit(least) + F.floor(u * (most - least + 1)).cast("int")


def triangular(u: Column, span: float, mode: float) -> Column:
    """A number from 0 to ``span`` with its peak at the share ``mode`` of it."""
    return F.when(u < mode, span * F.sqrt(u * mode)).otherwise(span * (1 - F.sqrt((1 - u) * (1 - mode))))


def weighted_index(u: Column, weights: list[int]) -> Column:
    """The place (from 0) in ``weights`` on which a number from 0 up to 1 falls."""
    ends = [sum(weights[: k + 1]) for k in range(len(weights))]
    at = F.floor(u * ends[-1])
    return F.size(F.filter(F.array(*map(F.lit, ends)), lambda end: end <= at))


def replayed(urls: DataFrame, as_of: str, days: int = 14, total: int = 240, seed: int = 2026, hours: list[int] = HOURS) -> DataFrame:
    """check_id, url and checked_at of a replay. ``urls``: url (distinct) and risky; exactly ``total`` checks, or all if there are fewer."""
    name = F.concat(F.lit(f"{seed}|"), F.col("url"))
    n = F.when(F.col("risky"), between(uniform(name, "n"), *RISKY)).otherwise(between(uniform(name, "n"), *HARMLESS))
    checks = urls.select("url", F.explode(F.sequence(F.lit(1), n)).alias("i")).withColumn("name", F.concat("url", F.lit("|"), F.col("i").cast("string")))
    checks = first_rows(checks, total, seed, "name")
    name = F.concat(F.lit(f"{seed}|"), F.col("name"))
    day = F.floor(triangular(uniform(name, "day"), days, MODE)).cast("int")
    back = F.make_dt_interval(day, weighted_index(uniform(name, "hour"), hours), between(uniform(name, "minute"), 0, 59), between(uniform(name, "second"), 0, 59).cast("decimal(18,6)"))
    number = F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")
    return checks.select(number.alias("check_id"), "url", (F.lit(as_of).cast("timestamp") - back).alias("checked_at"))


def replay_into(scored: DataFrame, root: str, as_of: str, version: str, days: int = 14, total: int = 240, seed: int = 2026) -> None:
    """Write a replay of ``scored`` (url, score, label, closest_domain, reason, host, path) as one batch of the running log: verdicts, and suspicious or phishing ones to campaigns.

    Each URL is scored once. A second replay with the same seed and time writes the same batch over.
    """
    plan = replayed(scored.select("url", (F.col("label") == "phishing").alias("risky")), as_of, days, total, seed)
    rows = plan.join(scored, "url").withColumns({"url_hash": F.sha2("url", 256), "source": F.lit("replay"), "model_version": F.lit(version)})
    run = f"replay-{seed}-" + "".join(c for c in as_of if c.isalnum())
    write_batch({"verdicts": rows, "campaigns": campaigns(rows, ["phishing", "suspicious"])}, root, run, 0, version)
