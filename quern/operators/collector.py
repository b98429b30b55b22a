"""Incremental collection: what to fetch, what changed, merging by key, coverage and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_modified(entries: DataFrame) -> DataFrame:
    """(url, lastmod): each address once with its latest modification; null only where none is known."""
    return entries.groupBy("url").agg(F.max("lastmod").alias("lastmod"))


def path_date(url: Column) -> Column:
    """The date at the beginning of an address's path, if any."""
    return F.try_to_date(F.regexp_extract(url, r"^https?://[^/]+/(\d{4}/\d{2}/\d{2})/", 1), "yyyy/MM/dd")


def candidates(entries: DataFrame, pattern: str, start: Column) -> DataFrame:
    """(url, lastmod, outcome) of sitemap entries, an address once with its latest modification: ``before_start`` where the
    date in its path lies before the start, ``unrelated`` where its decoded path does not fit the pattern, else
    ``candidate``. Nothing is a candidate but what fits."""
    path = F.regexp_extract("url", r"^https?://[^/]+([^?#]*)", 1)
    fits = F.coalesce(F.try_url_decode(path), path).rlike(f"(?i){pattern}")
    outcome = F.when(path_date(F.col("url")) < start, "before_start").when(fits, "candidate").otherwise("unrelated")
    return latest_modified(entries).withColumn("outcome", outcome)


def newest_first(rows: DataFrame, now: Column) -> DataFrame:
    """Candidates in the order in which they are fetched: latest modification first, unknown ones as if now, then by address
    downwards. A sort by ranges, no task sees all rows."""
    return rows.orderBy(F.coalesce("lastmod", now).desc(), F.col("url").desc())


def preview(rows: DataFrame, score: str, key: str, most: int = 10) -> DataFrame:
    """The rows of the highest scores, then least keys: each task passes on no more than ``most``."""
    return rows.orderBy(F.desc(score), key).limit(most)


def published_between(rows: DataFrame, start: Column, captured: Column, at: str = "published_at") -> DataFrame:
    """Rows published from the start up to when they were captured; null and later ones fall out."""
    return rows.where(F.col(at).between(start, captured))


def needs_replay(saved_version: Column, version: Column) -> Column:
    """Whether everything is looked at again: the version of the rules that the saved state names is another, or none."""
    return ~saved_version.eqNullSafe(version)


def requalified(stored: DataFrame, text: Column, rules: list[tuple[str, str]]) -> DataFrame:
    """Stored rows under the current rules: (score, topics) anew and outcome ``kept``, or ``removed_unrelated`` for those that
    no longer qualify. Rows with null text do not."""
    score, found = topics(F.coalesce(text, F.lit("")), rules)
    return stored.drop("score", "topics").withColumns({"score": score, "topics": found}).withColumn("outcome", F.when(F.col("score") > 0, "kept").otherwise("removed_unrelated"))


def outcome_counts(rows: DataFrame, outcomes: list[str], outcome: str = "outcome") -> DataFrame:
    """One row with a column for each of the stated outcomes; other outcomes are not counted."""
    return rows.agg(*(F.count_if(F.col(outcome) == o).alias(o) for o in outcomes))


def scan_start(start: Column, last_scan: Column, overlap_hours: int, replay: Column) -> Column:
    """From when entries are looked at again: an overlap before the last scan, or the very start."""
    return F.when(last_scan.isNull() | replay, start).otherwise(F.greatest(start, last_scan - F.expr(f"INTERVAL {int(overlap_hours)} HOURS")))


def fetch_plan(candidates: DataFrame, observed: DataFrame, cache: DataFrame, now: Column, last_scan: Column, scan_from: Column, ttl_hours: int = 24) -> DataFrame:
    """``candidates`` (url, lastmod) with action: ``cached`` if the same modification was observed and lies before the scan
    window; ``reusable`` if a cached copy of that modification was checked after the last scan and within the time to
    live; else ``fetch``. ``observed`` and ``cache``: (url, lastmod, checked_at), one row an address."""
    o = observed.select("url", F.col("lastmod").alias("o_lastmod"))
    c = cache.select("url", F.col("lastmod").alias("c_lastmod"), F.col("checked_at").alias("c_checked"))
    known = F.col("lastmod").isNotNull()
    cached = known & (F.col("o_lastmod") == F.col("lastmod")) & (F.col("lastmod") < scan_from)
    fresh = (F.col("c_checked") >= F.col("lastmod")) & (F.col("c_checked") <= now) & (last_scan.isNull() | (F.col("c_checked") > last_scan))
    reusable = known & (F.col("c_lastmod") == F.col("lastmod")) & fresh & (F.col("c_checked") >= now - F.expr(f"INTERVAL {int(ttl_hours)} HOURS"))
    action = F.when(cached, "cached").when(reusable, "reusable").otherwise("fetch")
    return candidates.join(o, "url", "left").join(c, "url", "left").withColumn("action", F.coalesce(action, F.lit("fetch"))).select("url", "lastmod", "action")


def merged(existing: DataFrame, found: DataFrame) -> DataFrame:
    """(key, revision, aliases, state): a keyed merge. ``existing`` and ``found``: (key, revision, aliases), one row a key.

    Aliases unite, sorted; state is ``new``, ``updated`` (another revision), ``unchanged`` or ``kept`` (not found now)."""
    e = existing.select("key", F.col("revision").alias("e_rev"), F.col("aliases").alias("e_al"), F.lit(True).alias("e_in"))
    f = found.select("key", F.col("revision").alias("f_rev"), F.col("aliases").alias("f_al"), F.lit(True).alias("f_in"))
    none = F.array().cast("array<string>")
    state = (
        F.when(F.col("f_in").isNull(), "kept").when(F.col("e_in").isNull(), "new").when(F.col("e_rev").eqNullSafe(F.col("f_rev")), "unchanged").otherwise("updated")
    )
    united = F.array_sort(F.array_union(F.coalesce("e_al", none), F.coalesce("f_al", none)))
    revision = F.when(F.col("f_in"), F.col("f_rev")).otherwise(F.col("e_rev"))
    return e.join(f, "key", "full").select("key", revision.alias("revision"), united.alias("aliases"), state.alias("state"))


def missing_months(days: DataFrame, day: str, start: Column, end: Column) -> DataFrame:
    """(month): months from start to end of which there is no row."""
    have = days.where(F.col(day).isNotNull()).select(F.trunc(day, "month").alias("month")).distinct()
    every = days.sparkSession.range(1).select(F.explode(F.sequence(F.trunc(start, "month"), F.trunc(end, "month"), F.expr("INTERVAL 1 MONTH"))).alias("month"))
    return every.join(have, "month", "left_anti")


def topics(text: Column, rules: list[tuple[str, str]], base: int = 40, step: int = 10) -> tuple[Column, Column]:
    """(score, topics) by rules (topic, expression) on folded text: the first rule must hold for any of the others to count."""
    held = [F.when(text.rlike(e), F.lit(t)) for t, e in rules]
    found = F.when(held[0].isNotNull(), F.array_compact(F.array(*held))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(found) > 0, base + step * (F.size(found) - 1)).otherwise(0), found


def peak_summary(days: DataFrame, group: str) -> DataFrame:
    """(group, days, measured, peak_day, peak, low_day, low, first_day, last_day) of (group, day, value); of equal values the
    earlier day counts, null values are not measured."""
    known = F.col("value").isNotNull()
    high = F.max(F.when(known, F.struct(F.col("value"), F.datediff(F.lit("1970-01-01").cast("date"), F.col("day")).alias("n"), F.col("day"))))
    low = F.min(F.when(known, F.struct(F.col("value"), F.col("day"))))
    return days.groupBy(group).agg(
        F.count(F.lit(1)).alias("days"), F.count("value").alias("measured"), high["day"].alias("peak_day"), high["value"].alias("peak"), low["day"].alias("low_day"), low["value"].alias("low"),
        F.min("day").alias("first_day"), F.max("day").alias("last_day"),
    )


def per_language(rows: DataFrame, key: str, notes: dict[str, str]) -> DataFrame:
    """(key, lang, note): a row for each language with a note; where no language has one, a row for each with null."""
    each = F.explode(F.array(*(F.struct(F.lit(lang).alias("lang"), F.col(c).alias("note")) for lang, c in notes.items()))).alias("x")
    none = F.coalesce(*(F.col(c) for c in notes.values())).isNull().alias("__none")
    return rows.select(key, none, each).select(key, "__none", "x.*").where(F.col("note").isNotNull() | F.col("__none")).drop("__none")
