"""Mixing sources to target weights by Efraimidis-Spirakis sampling (DataFrame functions only).

Every document draws an exponential key, -ln(u) / quality; u comes from a hash of its doc_id, so reruns
agree. Within a source documents are ordered by key, sizes are prefix-summed, and those below the
source's budget are in. A target above the source's own size takes whole epochs of everything first
and selects only the fraction that is left.

No source is ever sorted as a whole: keys fall into buckets, bucket sums are prefix-summed, and the
bucket in which a budget ends is divided again between its own least and largest key, until it holds
few rows (or one key). Only these are ordered, so no task orders more of a source, whatever its weights
are. What each source needs then is one row: its epochs and the key at which its budget ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keysieve.llm.common import cut, word_count

#: Characters whose share lowers a document's quality weight.
SYMBOLS = "#*$%&|<>!"
#: Sources in a broadcast at most; more are joined by a shuffle.
BROADCAST_SOURCES = 100_000


def quality(text: Column) -> Column:
    """Weight from 0.05 to 1: the share of characters that are no symbols, to the 8th power."""
    share = F.length(F.translate(text, SYMBOLS, "")) / F.greatest(F.length(text), F.lit(1))
    return F.coalesce(F.greatest(F.pow(share, F.lit(8.0)), F.lit(0.05)), F.lit(0.05))


def exponential_key(doc_id: Column, weight: Column, seed: str = "mix") -> Column:
    digest = F.md5(F.concat(F.lit(f"{seed}-"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / weight


def source_key(source: Column) -> Column:
    """Never null, so that rows without a source are a source too."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("-"))


def sized(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """docs with source_key, size and es_key; columns of these names in docs are replaced."""
    return docs.withColumns({"source_key": source_key(F.col("source")), "size": word_count(F.col("text")), "es_key": exponential_key(F.col("doc_id"), quality(F.col("text")), seed)})


def targets(slim: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """source_key, source_size, target, epochs, rest (words of the last, partial epoch) for each source.

    Targets share all sizes by weight; those above `most` times their source's size stop there and the rest is reshared.
    That is the level at which sum(min(cap, level * weight)) meets the total, found by ordering sources by cap / weight.
    Works on one row for each source.
    """
    order = Window.orderBy(F.col("source_key") == "-", "source_key")
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    each = slim.groupBy("source_key").agg(F.sum("size").alias("source_size")).withColumn("w", w.cast("double")).withColumn("cap", F.lit(most) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), "source_key")
    whole, earlier = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    level = (F.sum("source_size").over(whole) - before("cap")) / (F.sum("w").over(whole) - before("w"))
    each = each.withColumn("level", level).withColumn("capped", F.col("level") > F.col("cap") / F.col("w"))
    final = F.first(F.when(~F.col("capped"), F.col("level")), ignorenulls=True).over(whole)
    each = each.withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.least(final * F.col("w"), F.col("cap").cast("double"))))
    words = F.floor(F.col("target")).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0).cast("long")
    return each.select("source_key", "source_size", "target", epochs.alias("epochs"), (words - epochs * F.col("source_size")).alias("rest"))


def last_buckets(slim: DataFrame, goal: DataFrame, buckets: int = 4096, few: int = 10_000) -> DataFrame:
    """(source_key, rest, before, low, high, rows): the keys from low to high among which a source's budget ends, and the words before them.

    At most `few` rows have such keys, or all of them have the same key.
    """
    place = F.log("es_key")
    ends = goal.where("rest > 0").select("source_key", "rest", F.lit(0).cast("long").alias("before"), F.lit(1e-18).alias("low"), F.lit(1e6).alias("high"))
    upto = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    while True:
        inside = slim.join(ends, "source_key").where("es_key >= low and es_key <= high")
        share = (place - F.log("low")) / (F.log("high") - F.log("low"))
        bucket = F.when(F.log("high") > F.log("low"), F.least(F.floor(share * buckets), F.lit(buckets - 1))).otherwise((F.col("es_key") > F.col("low")).cast("long"))
        sums = inside.withColumn("bucket", bucket).groupBy("source_key", "rest", "before", "bucket").agg(F.sum("size").alias("size"), F.min("es_key").alias("low"), F.max("es_key").alias("high"), F.count("*").alias("rows"))
        sums = sums.withColumn("start", F.col("before") + F.sum("size").over(upto) - F.col("size")).where("start < rest and start + size >= rest")
        ends = cut(sums.select("source_key", "rest", F.col("start").alias("before"), "low", "high", "rows"), "ends")
        if not ends.where((F.col("rows") > few) & (F.col("low") < F.col("high"))).take(1):
            return ends
        ends = ends.drop("rows")


def cutoffs(slim: DataFrame, goal: DataFrame, buckets: int = 4096, few: int = 10_000) -> DataFrame:
    """goal with the place where each source's budget ends: end_key, end_id, end_size, and end_words for each row tied there."""
    ends = last_buckets(slim, goal, buckets, few).drop("rows")
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    last = slim.withColumn("id", ident).join(ends, "source_key").where("es_key >= low and es_key <= high")
    ties = last.groupBy("source_key", "before", "rest", "es_key", "id", "size").agg(F.count("*").alias("rows"))
    within = Window.partitionBy("source_key").orderBy("es_key", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    total = F.col("rows") * F.col("size")
    ties = ties.withColumn("start", F.col("before") + F.sum(total).over(within) - total).where((F.col("start") < F.col("rest")) & (F.col("start") + total >= F.col("rest")))
    ties = ties.select("source_key", F.col("es_key").alias("end_key"), F.col("id").alias("end_id"), F.col("size").alias("end_size"), F.floor((F.col("rest") - F.col("start")) / F.col("rows")).cast("long").alias("end_words"))
    return goal.join(ties, "source_key", "left")


def mix(spark: SparkSession, docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, buckets: int = 4096, seed: str = "mix", keep: list[str] | None = None, few: int = 10_000) -> DataFrame:
    """The columns of keep (all, by default), size, source_size, target and taken for each row of docs.

    taken counts the words of all copies; the document at which a source's budget ends is taken in part, and rows tied
    there (same doc_id and size) share what is left evenly. Null texts have size 0 and are never taken, a null source is
    one more source (the last), a null doc_id draws one fixed key. A very long text is a row like others. With no words at all, all targets are 0. An empty
    table gives an empty result. Columns of docs called size, source_size, target or taken are replaced.
    """
    keep = [c for c in keep or docs.columns if c not in ("size", "source_size", "target", "taken")]
    rows = sized(docs.select(F.struct(*keep).alias("row"), "doc_id", "source", "text"), seed)
    slim = cut(rows.select("doc_id", "source_key", "size", "es_key"), "sizes")
    goal = cut(targets(slim, weights, most), "targets")
    ends = cut(cutoffs(slim, goal, buckets, few), "cutoffs")
    if keep == ["doc_id"]:
        rows = slim.withColumn("row", F.struct("doc_id"))
    if ends.count() <= BROADCAST_SOURCES:
        ends = F.broadcast(ends)
    joined = rows.join(ends, "source_key")
    own, end = F.struct("es_key", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "size"), F.struct("end_key", "end_id", "end_size")
    last = F.when((F.col("rest") <= 0) | F.col("end_key").isNull(), F.lit(0)).when(own < end, F.col("size")).when(own == end, F.col("end_words")).otherwise(F.lit(0))
    return joined.select("row.*", "size", "source_size", "target", (F.col("epochs") * F.col("size") + last).cast("long").alias("taken"))
