"""Ingestion: records joined to their parts, revisions, reuse of embeddings, differences, gates and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_relations(records: DataFrame, relations: DataFrame, key: str, other: str, order: str, fields: list[str]) -> DataFrame:
    """Records with the array ``relations`` of their related rows in order; empty where there is none.

    Relations are packed before the join; a null key is related to nothing."""
    nested = relations.where(F.col(other).isNotNull()).groupBy(F.col(other).alias("__k")).agg(F.array_sort(F.collect_list(F.struct(order, *fields))).alias("relations"))
    kind = nested.schema["relations"].dataType
    return records.join(nested, F.col(key) == F.col("__k"), "left").drop("__k").withColumn("relations", F.coalesce("relations", F.array().cast(kind)))


def rendered(parts: list[tuple[str, Column]], separator: str = "\n") -> Column:
    """Labelled parts that have a value, one after the other."""
    return F.concat_ws(separator, *(F.when(F.trim(c) != "", F.concat(F.lit(label), F.trim(c))) for label, c in parts))


def group_digest(rows: DataFrame, group: str, revision: str) -> DataFrame:
    """(group, n, digest): SHA-256 over a group's sorted revisions, one a line."""
    revisions = F.array_sort(F.collect_list(revision))
    return rows.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(revision).alias("n"), F.sha2(F.array_join(revisions, "\n"), 256).alias("digest"))


def content_digest(rows: DataFrame, group: str, path: str, content: str) -> DataFrame:
    """(group, digest): SHA-256 over path, a zero byte and the raw digest of the content, in order of the paths."""
    part = F.concat(F.encode(F.col(path), "UTF-8"), F.lit(b"\0"), F.unhex(F.sha2(F.col(content), 256)))
    parts = F.array_sort(F.collect_list(F.struct(F.col(path).alias("p"), part.alias("b"))))
    return rows.groupBy(group).agg(F.sha2(F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["b"])), 256).alias("digest"))


def hash_counts(chunks: DataFrame) -> DataFrame:
    return chunks.where(F.col("content_hash").isNotNull()).groupBy("content_hash").agg(F.count(F.lit(1)).alias("n"))


def removed_hashes(active: DataFrame, current: DataFrame) -> DataFrame:
    """(content_hash, removed): by how many a content is rarer in ``current``, as multisets."""
    left, right = hash_counts(active).withColumnRenamed("n", "a"), hash_counts(current).withColumnRenamed("n", "c")
    return left.join(right, "content_hash", "left").select("content_hash", (F.col("a") - F.coalesce("c", F.lit(0))).alias("removed")).where("removed > 0")


def reuse_plan(current: DataFrame, active: DataFrame, width: int) -> DataFrame:
    """``current`` with (embedding, state): ``reused`` where an active chunk with the same content has an embedding of this
    width (the one of the least chunk_id), else ``pending`` with none. One row of active counts a content, so no
    chunk is doubled; a null hash reuses nothing."""
    fit = active.where(F.col("content_hash").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") == width))
    best = fit.groupBy("content_hash").agg(F.min_by("embedding", "chunk_id").alias("embedding"))
    return current.drop("embedding").join(best, "content_hash", "left").withColumn("state", F.when(F.col("embedding").isNotNull(), "reused").otherwise("pending"))


def missing(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    return expected.join(found.select(*keys).distinct(), keys, "left_anti")


def accepted_and_issues(documents: DataFrame, least: int = 40) -> DataFrame:
    """Documents with (outcome, reason): too little text is skipped, no text failed, others accepted."""
    size = F.length(F.trim(F.coalesce("text", F.lit(""))))
    return documents.withColumn("outcome", F.when(F.col("text").isNull(), "failed").when(size < least, "skipped").otherwise("accepted")).withColumn(
        "reason", F.when(F.col("outcome") == "failed", "no text").when(F.col("outcome") == "skipped", "no meaningful text")
    )


def first_of(rows: DataFrame, group: str, order: str) -> DataFrame:
    """The whole first row of each group in ``order``, its representative; combined before the shuffle."""
    others = [c for c in rows.columns if c != group]
    return rows.groupBy(group).agg(F.min_by(F.struct(*others), order).alias("__row")).select(group, "__row.*")


def repeated_keys(rows: DataFrame, key: str) -> DataFrame:
    """(key, n): keys that stand more than once; null keys are no keys."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def changed_revisions(before: DataFrame, after: DataFrame, key: str, revision: str) -> DataFrame:
    """(key, before, after): what has another revision than before, or is on one side only; none where a source stood still."""
    b, a = before.select(key, F.col(revision).alias("before")), after.select(key, F.col(revision).alias("after"))
    return b.join(a, key, "full").where(~F.col("before").eqNullSafe(F.col("after")))


def supports_reuse(manifests: DataFrame, contract: dict[str, object]) -> Column:
    """Whether a manifest fits a contract field by field; null fields fit only null."""
    ok = F.lit(True)
    for field, value in contract.items():
        ok = ok & F.col(field).eqNullSafe(F.lit(value))
    return ok


def generation_id(created_at: Column, fingerprint: Column) -> Column:
    """``20250408T124746Z-`` and 12 digits of the fingerprint's SHA-256."""
    return F.concat(F.date_format(created_at, "yyyyMMdd'T'HHmmss'Z'"), F.lit("-"), F.substring(F.sha2(fingerprint, 256), 1, 12))
