"""Batched retrieval: nearest chunks of each source, fusion of rankings, anchors, deduplication, variety and citations.

Requests are rows; a batch of them flows through as joins and windows keyed by the request. Chunks are read once and
reduced to each query's best before anything is shuffled; the vectors of the queries are staged in the shared folder, from
which the workers read them block by block. Ordered folds, where a hit that is left out hides nothing, run over rows
sorted by request, one row at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from quern.sources.tables import arrow_mapped, broadcast_if_bounded, pandas_mapped, stage_table

#: Queries, and chunks, whose vectors are multiplied at once; bytes of queries that a worker keeps between its batches.
QUERY_BLOCK, CHUNK_BLOCK, KEPT_BYTES = 2048, 16_384, 64 << 20
#: Clauses of a plan, rows of a clause, anchors of a request, candidates of a pool (fixed values).
MOST_CLAUSES, MOST_MATCHES, MOST_ANCHORS, MOST_CANDIDATES = 8, 32, 16, 20


def cosine_distance(left: Column, right: Column) -> Column:
    """1 - cosine of two arrays, not below 0; an error for empty, unequally long, all-zero or non-finite ones."""
    dot = F.aggregate(F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    scale = norm(left) * norm(right)
    found = F.lit(1.0) - dot / F.nullif(scale, F.lit(0.0))
    ok = (F.size(left) > 0) & (F.size(left) == F.size(right)) & (scale > 0) & ~F.isnan(found) & (F.abs(found) < float("inf"))
    return F.when(ok, F.greatest(found, F.lit(0.0))).otherwise(F.raise_error(F.lit("embeddings differ in size, are zero or not finite")).cast("double"))


def lenient_distance(left: Column, right: Column) -> Column:
    """The same for stores that keep all vectors: 1 where either is all zero, not clamped; null where sizes differ."""
    dot = F.aggregate(F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    scale = norm(left) * norm(right)
    return F.when(F.size(left) == F.size(right), F.when(scale == 0, 1.0).otherwise(F.lit(1.0) - dot / scale))


def _unit_rows(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, unit vectors) of the arrays that are ``width`` wide and have a direction."""
    rows = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False) & (column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) == width))
    v = column.take(pa.array(rows)).flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, width)
    norm = np.linalg.norm(v, axis=1)
    good = np.isfinite(norm) & (norm > 0)
    return rows[good], v[good] / norm[good, None]


def _query_blocks(folder: str, width: int) -> Callable[[], Iterator[tuple[np.ndarray, np.ndarray]]]:
    """The staged queries as blocks (ids, unit vectors); kept in memory where they are few, else read again each time."""
    import pyarrow.dataset as ds

    data = ds.dataset(folder, format="parquet")
    kept = [] if data.count_rows() * width * 8 <= KEPT_BYTES else None

    def blocks() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if kept:
            yield from kept
            return
        for batch in data.to_batches(columns=["query_id", "embedding"], batch_size=QUERY_BLOCK):
            rows, unit = _unit_rows(batch.column(1), width)
            if len(rows):
                block = batch.column(0).take(pa.array(rows)).to_numpy(zero_copy_only=False), unit
                if kept is not None:
                    kept.append(block)
                yield block

    return blocks


def _near(batches: Iterator[pa.RecordBatch], folder: str, width: int, k: int, threshold: float, others: bool) -> Iterator[pa.RecordBatch]:
    blocks = _query_blocks(folder, width)

    def best(chunks: pa.Table) -> Iterator[pa.RecordBatch]:
        chunks = chunks.combine_chunks()
        rows, unit = _unit_rows(chunks["embedding"].chunk(0), width)
        if not len(rows):
            return
        own = chunks["chunk_id"].to_numpy()[rows]
        sources = chunks["source_id"].chunk(0).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)[rows]
        for ids, queries in blocks():
            distance = np.round(np.maximum(0.0, 1.0 - queries @ unit.T), 6)
            near = distance <= threshold
            if others:
                near &= ids[:, None] != own[None, :]
            q, c = np.nonzero(near)
            if not len(q):
                continue
            # No more than k of a query and source can count, whatever the other batches hold.
            d, s = distance[q, c], sources[c]
            order = np.lexsort((own[c], d, s, q))
            q, c, d, s = q[order], c[order], d[order], s[order]
            first = np.flatnonzero(np.append(True, (q[1:] != q[:-1]) | (s[1:] != s[:-1])))
            top = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q)))) < k
            at = pa.array(rows[c[top]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[q[top]]), chunks["source_id"].chunk(0).take(at), chunks["chunk_id"].chunk(0).take(at), pa.array(d[top])], ["query_id", "source_id", "chunk_id", "distance"]
            )

    kept: list[pa.RecordBatch] = []
    for batch in batches:
        kept.append(batch)
        if sum(b.num_rows for b in kept) >= CHUNK_BLOCK:
            yield from best(pa.Table.from_batches(kept))
            kept = []
    if kept and sum(b.num_rows for b in kept):
        yield from best(pa.Table.from_batches(kept))


def nearest(queries: DataFrame, chunks: DataFrame, k: int, threshold: float, others: bool = False) -> DataFrame:
    """(query_id, source_id, chunk_id, distance, rank): each query's k nearest chunks of every source within the threshold;
    with ``others``, without the chunk whose id is the query's own.

    ``queries``: (query_id BIGINT, embedding); ``chunks``: (chunk_id, source_id, embedding). Distances are rounded to 6
    places and ties go to the lesser chunk_id. Queries or chunks whose vector is null, zero, not finite or not as wide
    as the widest query's take no part. The search is exact: chunks are read once, multiplied by all queries in
    blocks read from the shared folder, and reduced to k a query and source before they are shuffled. Nothing of the
    queries goes through the driver.
    """
    kinds = {n: chunks.schema[n].dataType.simpleString() for n in ("chunk_id", "source_id")}
    schema = f"query_id long, source_id {kinds['source_id']}, chunk_id {kinds['chunk_id']}, distance double"
    asked = stage_table(queries.where(F.col("embedding").isNotNull()).select(F.col("query_id").cast("long").alias("query_id"), "embedding"), "queries")
    width = asked.agg(F.max(F.size("embedding")).alias("n")).first()["n"] or 1
    folder = asked.inputFiles()[0].rsplit("/", 1)[0] if asked.inputFiles() else None
    found = arrow_mapped(chunks.select("chunk_id", "source_id", "embedding"), lambda b: _near(b, folder, width, k, threshold, others), schema) if folder else chunks.sparkSession.createDataFrame([], schema)
    order = Window.partitionBy("query_id", "source_id").orderBy("distance", "chunk_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def near_the_best(hits: DataFrame, slack: float = 0.18) -> DataFrame:
    """Hits no farther from the query than its best one by more than ``slack``."""
    best = F.min("distance").over(Window.partitionBy("query_id"))
    return hits.withColumn("__best", best).where(F.col("distance") <= F.round(F.col("__best") + slack, 6)).drop("__best")


def _folded(rows: DataFrame, by: list[str], order: list[Column], fields: list[str], judge: Callable[[], Callable[..., bool]]) -> DataFrame:
    """The rows that an ordered fold keeps, with their place in their group from 1. ``judge`` makes a function of a group's
    state, which says of a row's ``fields``, in order, whether it is kept. Groups are sorted within partitions and passed
    one row after the other, so the memory is that of a group's state."""
    names, width = rows.columns, len(by)
    at = [names.index(f) for f in fields]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, keep, place = None, None, 0
        for frame in frames:
            kept, places = [], []
            columns = [frame[b].tolist() for b in by] + [frame.iloc[:, i].tolist() for i in at]
            for n, row in enumerate(zip(*columns)):
                if keep is None or row[:width] != group:
                    group, keep, place = row[:width], judge(), 0
                if keep(*row[width:]):
                    place += 1
                    kept.append(n)
                    places.append(place)
            yield frame.iloc[kept].assign(place=pd.Series(places, index=frame.index[kept], dtype="int64"))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", place long"
    return pandas_mapped(rows.repartition(*by).sortWithinPartitions(*by, *order), run, schema)


def without_references(hits: DataFrame, by: list[str]) -> DataFrame:
    """Hits but for those of reference use whose address a detailed hit of the same group has."""
    detailed = hits.where(~F.col("is_reference")).select(*by, "url").distinct().withColumn("is_reference", F.lit(True))
    return hits.join(detailed, [*by, "url", "is_reference"], "left_anti")


def document_key(source: Column, record: Column, title: Column) -> Column:
    """A document's identity in a ranking: the record where there is one that is not empty, else the title."""
    return F.concat_ws("\0", source, F.coalesce(F.nullif(record, F.lit("")), title))


def _one_a_document() -> Callable[..., bool]:
    documents, urls = set(), set()

    def keep(document, url, is_article, tells_url) -> bool:
        if document in documents or (is_article and url in urls):
            return False
        documents.add(document)
        if is_article or tells_url:
            urls.add(url)
        return True

    return keep


def deduplicated(hits: DataFrame, by: list[str] = ["request_id"]) -> DataFrame:  # noqa: B006
    """Hits in order of distance, one a document, one an address of articles, with their place in their group.

    ``hits``: (by…, chunk_id, source_id, record_id, title, url, is_article, is_keyed, is_reference, distance). References
    with a detailed hit of their address go first (see without_references). A hit is left out if its document was kept,
    or if it is an article whose address was kept with another article or with a hit ``is_keyed``. Of equal distances the
    lesser chunk_id comes first. A hit that is left out hides nothing, so this is a fold, not a window.
    """
    rest = without_references(hits, by).withColumn("__document", document_key(F.col("source_id"), F.col("record_id"), F.col("title")))
    return _folded(rest, by, [F.col("distance"), F.col("chunk_id")], ["__document", "url", "is_article", "is_keyed"], _one_a_document).drop("__document")


def fused(hits: DataFrame, limit: int = MOST_CANDIDATES) -> DataFrame:
    """(request_id, chunk_id, …, score, place): reciprocal rank fusion of a request's rankings, best ``limit``.

    ``hits`` are as in deduplicated, with query_id. Ranks count from 1 among the deduplicated hits of each query; a chunk's
    score is the sum of 1 / (60 + rank), rounded to 9 places. The pool is the request's deduplicated hits, each with its
    least distance; equal scores go to the nearer chunk, then to the lesser chunk_id.
    """
    ranked = deduplicated(hits, ["request_id", "query_id"])
    scores = ranked.groupBy("request_id", "chunk_id").agg(F.round(F.sum(1.0 / (60 + F.col("place"))), 9).alias("score"))
    nearest_hit = F.row_number().over(Window.partitionBy("request_id", "chunk_id").orderBy("distance", "query_id"))
    pool = deduplicated(hits.withColumn("__r", nearest_hit).where("__r = 1").drop("__r", "query_id")).drop("place")
    place = F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("score"), "distance", "chunk_id"))
    return pool.join(scores, ["request_id", "chunk_id"], "left").fillna(0.0, ["score"]).withColumn("place", place).where(F.col("place") <= limit)


def article_keys(urls: Column, hosts: list[str]) -> Column:
    """The articles that an array of addresses names on some hosts: the number after ``-i`` at a path's end, else the path."""
    path = lambda u: F.regexp_replace(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/+$", "")
    host = lambda u: F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    own = F.filter(F.coalesce(urls, F.array().cast("array<string>")), lambda u: u.isNotNull() & host(u).isin(*hosts))
    return F.array_distinct(F.transform(own, lambda u: F.coalesce(F.nullif(F.regexp_extract(path(u), r"-i(\d+)$", 1), F.lit("")), path(u))))


def diversified(hits: DataFrame, limit: int = 7, per_source: int = 3) -> DataFrame:
    """Hits that an ordered choice keeps, with their place: one a document, one an article, ``per_source`` a source.

    ``hits``: (request_id, chunk_id, source_id, record_id, title, articles, is_reference, distance, bonus), articles being
    the keys of all its addresses (see article_keys). The order is by distance less bonus, then chunk_id. A hit that
    shares an article with one kept before is left out, as is a reference that shares one with any detailed hit.
    """
    detailed = hits.where(~F.col("is_reference")).select("request_id", F.explode("articles").alias("__a")).groupBy("request_id").agg(F.collect_set("__a").alias("__detailed"))
    known = hits.join(detailed, "request_id", "left").where(~(F.col("is_reference") & F.coalesce(F.arrays_overlap("articles", "__detailed"), F.lit(False)))).drop("__detailed")

    def choice() -> Callable[..., bool]:
        documents, articles, sources = set(), set(), {}
        taken = [0]

        def keep(document, source, own) -> bool:
            own = set(own) if own is not None else set()
            if taken[0] >= limit or own & articles or document in documents or sources.get(source, 0) >= per_source:
                return False
            taken[0] += 1
            documents.add(document)
            articles.update(own)
            sources[source] = sources.get(source, 0) + 1
            return True

        return keep

    keyed = known.withColumns({"__document": document_key(F.col("source_id"), F.col("record_id"), F.col("title")), "__order": F.col("distance") - F.coalesce("bonus", F.lit(0.0))})
    return _folded(keyed, ["request_id"], [F.col("__order"), F.col("chunk_id")], ["__document", "source_id", "articles"], choice).drop("__document", "__order")


def recency_bonus(as_of: Column, *days: Column) -> Column:
    """0.08, falling to 0 over thirty days, by the first of the given texts that is a date; nothing for later dates."""
    age = F.datediff(as_of, F.coalesce(*(F.try_to_date(d, "yyyy-MM-dd") for d in days)))
    return F.coalesce(F.when(age >= 0, 0.08 * F.greatest(F.lit(0.0), 1.0 - age / 30)), F.lit(0.0))


def anchored(pool: DataFrame, anchors: DataFrame, limit: int = 20) -> DataFrame:
    """(request_id, chunk_id, place): anchors first, then the pool without documents that an anchor has, up to ``limit``; both
    in order of their own place, (request_id, chunk_id, source_id, item, distance, place)."""
    keys = anchors.select("request_id", "source_id", "item").distinct()
    rest = pool.join(keys, ["request_id", "source_id", "item"], "left_anti")
    both = anchors.select("request_id", "chunk_id", F.lit(0).alias("p"), "place", "distance").unionByName(rest.select("request_id", "chunk_id", F.lit(1).alias("p"), "place", "distance"))
    place = F.row_number().over(Window.partitionBy("request_id").orderBy("p", "place", "distance", "chunk_id"))
    return both.withColumn("place", place).where(F.col("place") <= limit).select("request_id", "chunk_id", "place")


def compiled_clauses(plans: DataFrame, most: int = MOST_CLAUSES) -> DataFrame:
    """(request_id, clause, field, op, text, number): the conditions of the first ``most`` clauses of each plan.

    ``plans``: (request_id, prefixes, days, dates, section, totals). In this order: for each prefix a range of publishers,
    for each day its number, for each date one clause of the event's and one of the research's, the section unless it is
    ``none`` or null, and the overview where totals are asked for. Null arrays are empty.
    """
    kind = "array<struct<field:string,op:string,text:string,number:bigint>>"
    one = lambda field, op, text=None, number=None: F.struct(
        F.lit(field).alias("field"), F.lit(op).alias("op"), (F.lit(None) if text is None else text).cast("string").alias("text"), (F.lit(None) if number is None else number).cast("bigint").alias("number")
    )
    none = F.array().cast(f"array<{kind}>")
    each = lambda c, make: F.coalesce(F.transform(c, make), none)
    parts = [
        each("prefixes", lambda p: F.array(one("publisher", ">=", p), one("publisher", "<", F.concat(p, F.lit("\uf8ff"))))),
        each("days", lambda d: F.array(one("protest_day", "==", number=d))),
        F.coalesce(F.flatten(F.transform("dates", lambda d: F.array(*(F.array(one(f, "==", d)) for f in ("event_date", "research_date"))))), none),
        F.when(F.col("section") != "none", F.array(F.array(one("section", "==", F.col("section"))))).otherwise(none),
        F.when(F.col("totals"), F.array(F.array(one("content_type", "==", F.lit("map-overview"))))).otherwise(none),
    ]
    clauses = F.slice(F.concat(*parts), 1, most)
    return plans.select("request_id", F.posexplode(clauses).alias("clause", "c")).select("request_id", "clause", F.explode("c").alias("c")).select("request_id", "clause", "c.*")


def clause_matches(rows: DataFrame, clauses: DataFrame, key: str, fields: list[str], limit: int = MOST_MATCHES) -> DataFrame:
    """(request_id, clause, key): rows that satisfy every condition of a clause, at most ``limit`` a clause, the least keys first.

    ``clauses`` are those of compiled_clauses: == compares with the text or the number, whichever the condition has; >= and
    < hold only between texts. Types are strict: a number is never equal to a text, and a condition on a field that is null,
    of another type or of another name never holds. Rows are unpivoted to the named fields; equal values meet by a hash
    join, so a row meets only the conditions it satisfies, and ranges by the field alone.
    """
    ident = ["request_id", "clause"]
    total = clauses.groupBy(*ident).agg(F.count(F.lit(1)).alias("n"))
    wanted = broadcast_if_bounded(clauses.join(total, ident))
    types = {f.name: f.dataType for f in rows.schema.fields}
    values = [
        F.struct(
            F.lit(f).alias("field"),
            (F.col(f) if isinstance(types[f], StringType) else F.lit(None)).cast("string").alias("text"),
            (F.col(f) if isinstance(types[f], NumericType) else F.lit(None)).cast("decimal(38,9)").alias("number"),
        )
        for f in fields
    ]
    pairs = rows.select(F.col(key).alias("__key"), F.explode(F.array(*values)).alias("x")).select("__key", "x.*").where("text is not null or number is not null")
    pairs = pairs.select("__key", "field", "text", "number", F.coalesce(F.concat(F.lit("t"), "text"), F.concat(F.lit("n"), F.col("number").cast("string"))).alias("__value"))
    equal = wanted.where("op = '=='").withColumn("__value", F.coalesce(F.concat(F.lit("t"), "text"), F.concat(F.lit("n"), F.col("number").cast("decimal(38,9)").cast("string")))).drop("text", "number")
    ranges = wanted.where("op <> '=='").withColumnRenamed("text", "__text").drop("number")
    within = F.when(F.col("op") == ">=", F.col("text") >= F.col("__text")).when(F.col("op") == "<", F.col("text") < F.col("__text"))
    met = pairs.join(equal, ["field", "__value"]).select(*ident, "n", "__key").unionByName(pairs.join(ranges, "field").where(within).select(*ident, "n", "__key"))
    full = met.groupBy(*ident, "__key", "n").agg(F.count(F.lit(1)).alias("m")).where("n = m")
    order = Window.partitionBy(*ident).orderBy("__key")
    return full.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= limit).select(*ident, F.col("__key").alias(key))


def metadata_anchors(matches: DataFrame, chunks: DataFrame, queries: DataFrame, most: int = MOST_ANCHORS) -> DataFrame:
    """The chunks that clauses matched, as anchors of their request: (request_id, chunk fields…, distance, place).

    ``matches``: (request_id, clause, chunk_id); ``chunks``: the fields of deduplicated with section, chunk_index and
    embedding; ``queries``: (request_id, embedding). Of the section ``index`` only the first chunk counts. The distance is
    the least to any query of the request; anchors are deduplicated in its order (then chunk_id) and the first count.
    """
    first = ~(F.col("section").eqNullSafe("index") & (F.coalesce("chunk_index", F.lit(0)) != 0))
    own = matches.select("request_id", "chunk_id").distinct().join(chunks.where(first), "chunk_id")
    asked = queries.select("request_id", F.col("embedding").alias("__q"))
    near = own.join(asked, "request_id").withColumn("distance", F.round(cosine_distance(F.col("__q"), F.col("embedding")), 6)).drop("__q", "embedding")
    least = near.groupBy(*[c for c in near.columns if c != "distance"]).agg(F.min("distance").alias("distance"))
    return deduplicated(least).where(F.col("place") <= most)


def cited(passages: DataFrame) -> DataFrame:
    """(request_id, citation, title, url, source) of passages with a place: citations are S1, S2, …"""
    return passages.select("request_id", F.concat(F.lit("S"), F.col("place").cast("string")).alias("citation"), "title", "url", "source")


def evidence(passages: DataFrame) -> DataFrame:
    """(request_id, evidence): the passages of a request as numbered blocks in one text."""
    block = F.concat_ws("\n", F.concat(F.lit("[S"), F.col("place").cast("string"), F.lit("]")), F.concat(F.lit("Title: "), F.coalesce("title", F.lit(""))),
                        F.concat(F.lit("URL: "), F.col("url")), F.concat(F.lit("Status: "), F.coalesce("status", F.lit("Not specified"))), F.lit("<evidence>"), F.col("text"), F.lit("</evidence>"))
    blocks = F.array_sort(F.collect_list(F.struct(F.col("place"), block.alias("b"))))
    return passages.groupBy("request_id").agg(F.array_join(F.transform(blocks, lambda x: x["b"]), "\n\n").alias("evidence"))


def selected(selections: DataFrame, pool: DataFrame) -> DataFrame:
    """(request_id, chunk_id, place): the pool's chunks by the labels C1, C2, … in the order selected.

    An unknown label or one selected twice is an error."""
    picks = selections.select("request_id", F.posexplode("labels").alias("p", "label"), (F.size(F.array_distinct("labels")) < F.size("labels")).alias("twice"))
    labelled = pool.select("request_id", "chunk_id", F.concat(F.lit("C"), F.col("place").cast("string")).alias("label"))
    found = picks.join(labelled, ["request_id", "label"], "left")
    bad = F.col("chunk_id").isNull() | F.col("twice")
    return found.select("request_id", F.when(bad, F.raise_error(F.lit("unknown or repeated label")).cast(pool.schema["chunk_id"].dataType)).otherwise(F.col("chunk_id")).alias("chunk_id"), (F.col("p") + 1).alias("place"))


def planned(requests: DataFrame) -> DataFrame:
    """Search plans in bounds: (request_id, queries, recent, dates, days). Queries are the planned one and the latest
    message, distinct, each at most 600 characters; stated dates or days switch recency off; bad dates fall out."""
    cut = lambda c: F.trim(F.substring(c, 1, 600))
    queries = F.filter(F.array_distinct(F.array(cut(F.col("standalone")), cut(F.col("latest")))), lambda q: q.isNotNull() & (q != ""))
    dates = F.slice(F.array_distinct(F.filter("dates", lambda d: F.try_to_date(d, "yyyy-MM-dd").isNotNull())), 1, 3)
    days = F.slice(F.array_distinct(F.filter("days", lambda d: d.between(1, 10000))), 1, 3)
    plain = requests.select("request_id", queries.alias("queries"), "recent", dates.alias("dates"), days.alias("days"))
    return plain.withColumn("recent", F.col("recent") & (F.size("dates") == 0) & (F.size("days") == 0))


def decorated(queries: Column, recent: Column, as_of: Column, lead: str) -> Column:
    """Queries for recent things with the lead and the month in front."""
    return F.transform(queries, lambda q: F.when(recent, F.concat(F.lit(lead + ", "), F.date_format(as_of, "MMMM yyyy"), F.lit(": "), q)).otherwise(q))
