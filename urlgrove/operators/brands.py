"""Trusted domains and nearest-brand matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.constants import NO_DISTANCE, TYPO_DISTANCE
from ..functions.idn import folded
from ..functions.urls import brand_label, parts_of, registrable
from ..tables import stored

#: Trusted domains of one block: so many travel to a task as one row.
BLOCK = 20_000


def build_trusted(entries: DataFrame) -> DataFrame:
    """domain (registrable, first wins by ord), agency_name, category, label."""
    e = entries.withColumn("domain", F.lower(F.trim("domain"))).where("domain <> '' and not startswith(domain, '#')")
    e = e.withColumn("labels", parts_of(F.split("domain", r"\.")))
    e = e.withColumn("domain", registrable(F.col("domain"), F.col("labels"))).withColumn("labels", parts_of(F.split("domain", r"\.")))
    e = e.withColumn("label", brand_label(F.col("domain"), F.col("labels"))).withColumn("category", F.coalesce(F.nullif("category", F.lit("")), F.lit("other")))
    first = F.row_number().over(W.partitionBy("domain").orderBy("ord"))
    return e.withColumn("_n", first).where("_n = 1").select("domain", "agency_name", "category", "label")


def brand_blocks(trusted: DataFrame, size: int = BLOCK) -> DataFrame:
    """(block, brands): all (domain, label) in blocks of about ``size``, however many there are; one row a block."""
    count = trusted.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / size)).alias("blocks"))
    dealt = trusted.crossJoin(F.broadcast(count)).withColumn("block", F.pmod(F.xxhash64("domain"), "blocks"))  # count is one row
    return dealt.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("domain", "label"))).alias("brands"))


def met_with_blocks(rows: DataFrame, trusted: DataFrame, size: int = BLOCK, spread: int = 64) -> DataFrame:
    """``rows`` (distinct keys) once for each block of trusted domains, with the block's ``brands``.

    Each block stands ``spread`` times and a row meets one of these by its hash, so rows join on that many keys a block.
    """
    blocks = brand_blocks(trusted, size).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    ids = trusted.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / size)).alias("_n"))  # one row
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(spread)).cast("int")).crossJoin(F.broadcast(ids))
    return rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))).join(blocks, ["block", "_salt"]).drop("block", "_salt", "_n")


def nearest(label: Column, brands: Column) -> Column:
    """(distance, domain) of the brand with the least edit distance; ties go to the smaller domain."""
    return F.array_min(F.transform(brands, lambda b: F.struct(F.levenshtein(label, b.label).alias("distance"), b.domain.alias("domain"))))


#: Trusted domains up to which labels are compared with all of them; beyond it labels look for neighbours by keys first.
SCANNED = 4096
#: Labels longer than this have too many keys and are compared with all domains.
KEYED_LENGTH = 24


def shortened_forms(label: Column, deletions: int = TYPO_DISTANCE) -> Column:
    """The distinct strings that are left of a label when up to ``deletions`` characters go."""
    without = lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))
    last = out = F.array(label)
    for _ in range(deletions):
        last = F.array_distinct(F.flatten(F.transform(F.filter(last, lambda x: x != ""), without)))
        out = F.concat(out, last)
    return F.array_distinct(out)


def neighbours(labels: DataFrame, label: str, trusted: DataFrame) -> DataFrame:
    """(label, near): the nearest trusted domain of the labels that have one within TYPO_DISTANCE.

    Strings within d edits of each other share a string that is left of both after at most d deletions, so labels and
    brands meet on such strings and only these pairs are compared.
    """
    key = lambda c: F.explode(F.transform(shortened_forms(F.col(c)), lambda x: F.xxhash64(x)))
    brands = trusted.where(F.length("label") <= KEYED_LENGTH + TYPO_DISTANCE).select("domain", F.col("label").alias("_brand"), key("label").alias("_key"))
    keyed = labels.where(F.length(label) <= KEYED_LENGTH).select(label, key(label).alias("_key"))
    pairs = keyed.join(brands, "_key").select(label, "_brand", "domain").distinct()
    far = F.levenshtein(F.col(label), F.col("_brand"))
    return pairs.withColumn("_far", far).where(F.col("_far") <= TYPO_DISTANCE).groupBy(label).agg(F.min(F.struct(F.col("_far").alias("distance"), "domain")).alias("near"))


def nearest_domains(labels: DataFrame, label: str, trusted: DataFrame, block: int = BLOCK, scanned: int = SCANNED) -> DataFrame:
    """(label, near): the nearest trusted domain of each distinct label, whatever its distance."""
    scan = lambda left: met_with_blocks(left, trusted, block).select(label, nearest(F.col(label), F.col("brands")).alias("near")).groupBy(label).agg(F.min("near").alias("near"))
    if trusted.limit(scanned + 1).count() <= scanned:
        return scan(labels)
    found = stored(neighbours(labels, label, trusted), "neighbours")
    return found.unionByName(scan(labels.join(found, label, "left_anti")))


def closest_brand(urls: DataFrame, trusted: DataFrame, block: int = BLOCK, scanned: int = SCANNED) -> DataFrame:
    """Add closest_domain, min_edit_distance, homoglyph_distance, is_whitelisted and is_typosquat.

    Distances are found once for each distinct label and joined back.
    """
    urls = urls.withColumn("brand", brand_label(F.col("host"), F.col("labels"))).withColumn("registrable", registrable(F.col("host"), F.col("labels")))
    labels = urls.where("has_ip = 0 and brand <> ''").select("brand").distinct().withColumn("_folded", folded(F.col("brand")))
    labels = stored(labels, "labels")
    asked = labels.select(F.explode(F.array_distinct(F.array("brand", "_folded"))).alias("_label")).distinct()
    found = nearest_domains(asked, "_label", trusted, block, scanned)
    near, fold = found.select(F.col("_label").alias("brand"), "near"), found.select(F.col("_label").alias("_folded"), F.col("near").alias("fold"))
    labels = labels.join(near, "brand", "left").join(fold, "_folded", "left").drop("_folded")
    exact = trusted.select(F.col("domain").alias("registrable"), F.lit(True).alias("exact"))
    out = urls.join(labels, "brand", "left").join(exact, "registrable", "left")
    raw = F.when(F.col("exact"), 0).otherwise(F.coalesce("near.distance", F.lit(NO_DISTANCE)))
    typo = F.col("exact").isNull() & ((raw == 0) | (raw.between(1, TYPO_DISTANCE) & (F.length("brand") >= 4)))
    better = ~typo & (F.col("fold.distance") < raw) & (F.col("fold.distance") <= TYPO_DISTANCE)
    return out.select(
        *urls.columns,
        F.coalesce("exact", F.lit(False)).alias("is_whitelisted"),
        F.when(better, F.col("fold.domain")).otherwise(F.col("near.domain")).alias("closest_domain"),
        F.when(better, F.col("fold.distance")).otherwise(raw).alias("min_edit_distance"),
        F.least(raw, F.coalesce("fold.distance", F.lit(NO_DISTANCE))).alias("homoglyph_distance"),
        (typo | F.coalesce(better, F.lit(False))).cast("int").alias("is_typosquat"),
    )


def path_brands(urls: DataFrame, trusted: DataFrame) -> DataFrame:
    """Add path_brand_hit: a path token of four letters or more is a trusted label other than the host's; and host_has_brand_and_suspicious_tld."""
    paths = urls.select(F.coalesce("path", F.lit("")).alias("_path"), F.coalesce("brand", F.lit("")).alias("_brand")).distinct()
    tokens = paths.withColumn("_token", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("_path"), F.lit("[a-z0-9]+"), F.lit(0)))))
    tokens = tokens.where((F.length("_token") >= 4) & (F.col("_token") != F.col("_brand")))
    hits = tokens.join(trusted.select(F.col("label").alias("_token")).distinct(), "_token", "left_semi").select("_path", "_brand").distinct().withColumn("_hit", F.lit(True))
    out = urls.join(hits, (F.coalesce("path", F.lit("")) == F.col("_path")) & (F.coalesce("brand", F.lit("")) == F.col("_brand")), "left")
    out = out.withColumn("path_brand_hit", ((F.col("has_ip") == 0) & F.coalesce("_hit", F.lit(False))).cast("int")).drop("_path", "_brand", "_hit")
    bait = ((F.col("path_brand_hit") == 1) | (F.col("is_typosquat") == 1)) & (F.col("has_suspicious_tld") == 1)
    return out.withColumn("host_has_brand_and_suspicious_tld", bait.cast("int"))
