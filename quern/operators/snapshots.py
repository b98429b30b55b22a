"""Changes between full snapshots, by gaps and islands over key and content digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.sources.tables import broadcast_if_bounded

GOOD_STATUSES = ("active", "superseded")


def plain_hash(hash_col: Column) -> Column:
    """A content hash without notation: blanks around it, letter case and a leading ``sha256:`` do not count."""
    return F.regexp_replace(F.lower(F.trim(hash_col)), "^sha256:", "")


def packed_key(col: Column) -> Column:
    """A string key as bytes; lower-case hexadecimal ones of even length take half the room (first byte 1)."""
    hexed = col.rlike("^([0-9a-f][0-9a-f])+$")
    return F.when(hexed, F.concat(F.lit(b"\x01"), F.unhex(F.when(hexed, col)))).otherwise(
        F.concat(F.lit(b"\x00"), F.encode(col, "UTF-8"))
    )


def unpacked_key(col: Column) -> Column:
    rest = F.substring(col, 2, 1 << 30)
    return F.when(F.substring(col, 1, 1) == F.lit(b"\x01"), F.lower(F.hex(rest))).otherwise(F.decode(rest, "UTF-8"))


def generation_order(manifests: DataFrame) -> DataFrame:
    """(collection_id, generation_id, ord, last_ord) of the good generations, ord counting from 1 by created_at.

    Equal created_at are told apart by generation_id; a null created_at comes first. Rows whose collection_id or
    generation_id is null have no place. A generation listed twice takes its earliest place only.
    """
    in_order = Window.partitionBy("collection_id").orderBy(F.col("created_at").asc_nulls_first(), "generation_id")
    return (
        manifests.where(F.col("status").isin(*GOOD_STATUSES))
        .where(F.col("collection_id").isNotNull() & F.col("generation_id").isNotNull())
        .groupBy("collection_id", "generation_id")
        .agg(F.min("created_at").alias("created_at"))
        .select(
            "collection_id",
            "generation_id",
            F.row_number().over(in_order).alias("ord"),
            F.count(F.lit(1)).over(Window.partitionBy("collection_id")).cast("int").alias("last_ord"),
        )
    )


def validity_intervals(snapshots: DataFrame, manifests: DataFrame) -> DataFrame:
    """(collection_id, chunk_key, digest, from_ord, to_ord, last_ord): how long each content of a chunk stood.

    Of several rows of a generation and chunk the latest delivered_at counts; of equal ones the larger digest; a
    null delivered_at is earlier than any other. The digest is the 64-bit hash of the hash without notation (null
    stays null and equals only null); it is only compared within one chunk. Rows of generations that are not good
    or not in the manifests, and rows with a null chunk_id, take no part. Columns beyond those named are ignored.

    Deliveries are collapsed before the shuffle (a hash aggregate with a long as its buffer), so a chunk that was
    delivered over and over leaves one row a content, generation and partition.
    """
    order = generation_order(manifests)
    # The collection of a generation is the one its manifest states.
    place = broadcast_if_bounded(order.withColumnRenamed("generation_id", "__gen"))
    rows = (
        snapshots.select(
            F.col("generation_id").alias("__gen"),
            packed_key(F.col("chunk_id")).alias("chunk_key"),
            F.when(F.col("content_hash").isNotNull(), F.xxhash64(plain_hash(F.col("content_hash")))).alias("digest"),
            F.col("delivered_at").alias("__at"),
        )
        .where(F.col("chunk_key").isNotNull())
        .join(place, "__gen")
        .groupBy("collection_id", "chunk_key", "ord", "last_ord", "digest")
        .agg(F.max("__at").alias("__at"))
    )
    by_chunk = Window.partitionBy("collection_id", "chunk_key")
    deliveries = by_chunk.orderBy("ord", F.col("__at").asc_nulls_first(), F.col("digest").asc_nulls_first())
    latest = rows.withColumn("__next", F.lead("ord").over(deliveries)).where(~F.col("__next").eqNullSafe(F.col("ord")))
    by_ord = by_chunk.orderBy("ord")
    starts = ~(
        F.lag("ord").over(by_ord).eqNullSafe(F.col("ord") - 1) & F.lag("digest").over(by_ord).eqNullSafe(F.col("digest"))
    )
    return (
        latest.withColumn("__start", starts.cast("int"))
        .withColumn("__island", F.sum("__start").over(by_ord.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("collection_id", "chunk_key", "__island", "digest", "last_ord")
        .agg(F.min("ord").alias("from_ord"), F.max("ord").alias("to_ord"))
        .drop("__island")
    )


def snapshot_changes(snapshots: DataFrame, manifests: DataFrame) -> DataFrame:
    """(generation_id, chunk_id, change) between each good generation and the one before it in its collection.

    An interval that starts right after another of its chunk is ``changed``, one that starts after a gap ``added``
    (never in the first generation), and one that ends before the last generation with no neighbour ``removed`` in
    the generation after its end. Empty tables give no rows.
    """
    by_ord = Window.partitionBy("collection_id", "chunk_key").orderBy("from_ord")
    begin, end = F.col("from_ord"), F.col("to_ord")
    joined = F.lag("to_ord").over(by_ord).eqNullSafe(begin - 1)
    followed = F.lead("from_ord").over(by_ord).eqNullSafe(end + 1)
    events = F.array(
        F.when(begin > 1, F.struct(begin.alias("ord"), F.when(joined, "changed").otherwise("added").alias("change"))),
        F.when(~followed & (end < F.col("last_ord")), F.struct((end + 1).alias("ord"), F.lit("removed").alias("change"))),
    )
    found = (
        validity_intervals(snapshots, manifests)
        .withColumn("__event", F.array_compact(events))
        .select("collection_id", "chunk_key", F.explode("__event").alias("__event"))
        .select("collection_id", "chunk_key", "__event.ord", "__event.change")
    )
    place = broadcast_if_bounded(generation_order(manifests).drop("last_ord"))
    return found.join(place, ["collection_id", "ord"]).select(
        "generation_id", unpacked_key(F.col("chunk_key")).alias("chunk_id"), "change"
    )


def removed_counts(snapshots: DataFrame, manifests: DataFrame) -> DataFrame:
    """(generation_id, stated_removed, derived_removed, agrees) of every manifest row.

    derived_removed is 0 where nothing was removed and in a collection's first good generation, and null for
    generations that are not good. agrees is null-safe. Removals are counted before they meet the manifest.
    """
    removed = (
        snapshot_changes(snapshots, manifests).where(F.col("change") == "removed").groupBy("generation_id").agg(F.count(F.lit(1)).alias("__n"))
    )
    derived = F.when(F.col("status").isin(*GOOD_STATUSES), F.coalesce("__n", F.lit(0)).cast("bigint"))
    return (
        manifests.select("generation_id", "status", F.col("removed_chunk_count").cast("bigint").alias("stated_removed"))
        .join(removed, "generation_id", "left")
        .select("generation_id", "stated_removed", derived.alias("derived_removed"))
        .withColumn("agrees", F.col("stated_removed").eqNullSafe(F.col("derived_removed")))
    )
