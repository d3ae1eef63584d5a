"""Shards that all hold the corpus mixture, by proportional stratified interleaving.

Rows are shuffled by a seeded hash and ranked within their source; a row's fraction is its rank over its
source's rows. Sorted by fraction, every source is spread evenly from first to last, so that equal cuts
all hold the mixture, each source to within a row or two.

Both ranks are exact and come from DataFrame operations only. No source and no range is ranked in one
piece: the hash and the fraction are evenly distributed, so that ranges of them make buckets of even size
whatever the sources' sizes; a row's rank is the rows of the buckets before it and its rank in its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimcheck.llm.shared import saved

#: Hash digits that order the shuffle: 60 bits.
_DIGITS = 15
#: Rows equal in key, source and text that one task numbers.
CHUNK = 10_000


def shuffle_order(key: Column, seed: int) -> Column:
    """An evenly distributed number below 2 to the 60 for each key."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))
    return F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("long")


def assign(docs: DataFrame, shards: int, key: str = "doc_id", source: str = "source", text: str = "text", seed: int = 17) -> DataFrame:
    """Each row's shard and place: columns key, source, size, text_crc32, position, shard, slot.

    ``size`` is the text's UTF-8 bytes plus 8 (null: 8). Shards differ by one row at most; ``slot`` counts
    from 0 without gaps. Rows without a source make a source of their own. The order depends on the seed,
    the keys, the sources and the texts alone, not on how the input is partitioned. Rows equal in all of them
    are numbered, and each is shuffled by its number, so that many of them (a third of all may have no key and
    no text) are spread over all shards and don't meet in one task.
    An empty table gives an empty one. Extra columns don't matter.
    """
    spark = docs.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    content = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("key"), F.col(source).alias("source"), F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")).alias("stratum"),
        (F.octet_length(content) + 8).cast("long").alias("size"), F.crc32(content.cast("binary")).alias("text_crc32"),
    )
    rows = rows.withColumn("mixed", shuffle_order(F.concat_ws(":", F.coalesce(F.col("key").cast("string"), F.lit("")), "text_crc32"), seed))
    # Equal rows are counted, and numbered where they come apart again; no number depends on a row's place.
    equal = rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))
    dealt = equal.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {CHUNK}")))).repartition("mixed", "chunk")
    numbers = F.sequence(F.col("chunk") * CHUNK, F.least(F.col("n"), (F.col("chunk") + 1) * CHUNK) - 1)
    place = shuffle_order(F.concat_ws(":", "mixed", "number"), seed)
    rows = dealt.withColumn("number", F.explode(numbers)).withColumn("mixed", F.when(F.col("number") == 0, F.col("mixed")).otherwise(place)).drop("n", "chunk", "number")
    rows = saved(rows, "mixed")
    width = -(-(1 << 4 * _DIGITS) // buckets)
    rows = rows.withColumn("bucket", F.floor(F.col("mixed") / F.lit(width)).cast("int"))
    counts = rows.groupBy("stratum", "bucket").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("stratum")
    before = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("stratum", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(whole).alias("total"))
    order = ("mixed", "key", "text_crc32", "size")
    within = Window.partitionBy("stratum", "bucket").orderBy(*order)
    ranked = rows.withColumn("rank", F.row_number().over(within)).join(counts, ["stratum", "bucket"])
    fraction = (2 * (F.col("before") + F.col("rank")) - 1).cast("double") / (2 * F.col("total")).cast("double")
    ranked = ranked.withColumn("fraction", fraction).drop("bucket", "before", "rank", "total")
    ranked = saved(ranked.withColumn("bucket", F.floor(F.col("fraction") * buckets).cast("int")), "ranked")
    counts = ranked.groupBy("bucket").agg(F.count("*").alias("n"))  # as many rows as buckets
    counts = saved(counts.select("bucket", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), "n"), "counts")
    total = counts.agg(F.sum("n")).first()[0] or 1
    within = Window.partitionBy("bucket").orderBy("fraction", "stratum", *order)
    return (
        ranked.withColumn("rank", F.row_number().over(within))
        .join(counts.drop("n"), "bucket")
        .withColumn("position", F.col("before") + F.col("rank") - 1)
        .withColumn("shard", F.expr(f"int((position * {shards}) div {total})"))
        .withColumn("slot", F.expr(f"position - (shard * {total}L + {shards - 1}) div {shards}"))
        .select(F.col("key").alias(key), "source", "size", "text_crc32", "position", "shard", "slot")
    )


def write_shards(docs: DataFrame, shards: int, path: str, key: str = "doc_id", **options) -> None:
    """Write ``docs``, whose keys are unique, as Parquet below ``path``, one folder a shard, in slot order."""
    placed = assign(docs, shards, key, **options).select(key, "shard", "slot")
    docs.drop("shard", "slot").join(placed, key).repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
