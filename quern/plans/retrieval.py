"""Queries of the retrieval operators. Requests are the vectors whose number is divisible by 50, two to a request."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import retrieval as r
from quern.sources.tables import table

THRESHOLD = 0.75


def _vectors(spark, base):
    return table(spark, base, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("source_id"), "embedding")


def _hits(spark, base, k=8):
    chunks = _vectors(spark, base)
    queries = chunks.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    return r.nearest(queries, chunks, k, THRESHOLD, others=True).withColumn("request_id", F.floor(F.col("query_id") / 100))


def _described(rows):
    """Chunks by number with what rankings look at: records that are empty, articles under one address, references."""
    n = F.col("chunk_id")
    return rows.withColumns(
        {
            "record_id": F.when(n % 3 == 0, "").otherwise((n % 40).cast("string")),
            "title": F.concat(F.lit("t"), (n % 25).cast("string")),
            "url": F.concat(F.lit("https://www.news.example/a-i"), (n % 30).cast("string")),
            "is_article": n % 2 == 0,
            "is_keyed": n % 10 == 1,
            "is_reference": n % 7 == 0,
        }
    )


def _pool(spark, base):
    return r.fused(_described(_hits(spark, base)))


def knn_topk_per_source(spark, base):
    return _hits(spark, base).select("query_id", "source_id", "chunk_id", "distance", F.col("rank").cast("bigint").alias("rank"))


def rrf_fusion_pool(spark, base):
    return _pool(spark, base).select("request_id", "chunk_id", "score", "distance", F.col("place").cast("bigint").alias("place"))


def recent_relative_filter(spark, base):
    return r.near_the_best(_hits(spark, base)).select("query_id", "chunk_id", "distance")


def min_distance_over_queries(spark, base):
    return _hits(spark, base).groupBy("request_id", "chunk_id").agg(F.min("distance").alias("distance"))


def _documents_hit(spark, base):
    return _described(_hits(spark, base).groupBy("request_id", "chunk_id", "source_id").agg(F.min("distance").alias("distance")))


def diversify_cap_per_source(spark, base):
    aliases = F.array(F.col("url"), F.concat(F.lit("https://NEWS.example:443/p/"), (F.col("chunk_id") % 45).cast("string"), F.lit("/?q")), F.lit("https://other.example/a-i1"))
    hits = _documents_hit(spark, base).withColumns({"articles": r.article_keys(aliases, ["news.example", "www.news.example"]), "bonus": F.round(F.col("chunk_id") % 9 / 100, 2)})
    return r.diversified(hits).select("request_id", "chunk_id", "distance", "place")


def deduplicate_fold(spark, base):
    return r.deduplicated(_documents_hit(spark, base)).select("request_id", "chunk_id", "distance", "place")


def recency_bonus_rank(spark, base):
    day = F.date_format("published_at", "yyyy-MM-dd")
    bad = F.when(F.col("doc_id") % 5 == 0, "2024-13-99").otherwise(F.lit(None))
    docs = table(spark, base, "documents").select("doc_id", F.round(r.recency_bonus(F.lit("2024-06-30").cast("date"), bad, day), 6).alias("bonus"))
    return docs.where("bonus > 0")


def anchors_override_pool(spark, base):
    pool = _pool(spark, base).withColumn("item", F.coalesce(F.nullif("record_id", F.lit("")), "title"))
    chunks = _described(_vectors(spark, base)).withColumns({"section": F.when(F.col("chunk_id") % 4 == 0, "index"), "chunk_index": (F.col("chunk_id") % 8).cast("int")})
    queries = _vectors(spark, base).where("chunk_id % 50 = 0").select(F.floor(F.col("chunk_id") / 100).alias("request_id"), "embedding")
    matches = chunks.where("source_id = 3 and chunk_id % 6 < 4").select("chunk_id").crossJoin(F.broadcast(queries.select("request_id").distinct()))
    anchors = r.metadata_anchors(matches.withColumn("clause", F.lit(0)), chunks, queries).withColumn("item", F.coalesce(F.nullif("record_id", F.lit("")), "title"))
    return r.anchored(pool, anchors).withColumn("place", F.col("place").cast("bigint"))


def _search_plans(spark, base):
    n = F.col("item_id")
    return table(spark, base, "eval_item").select(
        n.alias("request_id"),
        F.when(n % 3 > 0, F.array(F.char(65 + n % 26), F.char(97 + n % 26))).alias("prefixes"),
        F.when(n % 4 > 0, F.sequence(n % 5, n % 5 + 2)).alias("days"),
        F.when(n % 5 > 0, F.array(F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (n % 400).cast("int")), "yyyy-MM-dd"), F.lit("7"))).alias("dates"),
        F.when(n % 2 == 0, "none").otherwise(F.element_at(F.array(*map(F.lit, ("news", "dossier", "index"))), (n % 3 + 1).cast("int"))).alias("section"),
        (n % 7 == 0).alias("totals"),
    )


def plan_clauses(spark, base):
    return r.compiled_clauses(_search_plans(spark, base)).withColumn("clause", F.col("clause").cast("bigint"))


def metadata_clause_match(spark, base):
    docs = table(spark, base, "source_document").select(
        "load_no", F.trim("source_label").alias("publisher"), (F.col("load_no") % 9).alias("protest_day"), F.date_format("fetched_at", "yyyy-MM-dd").alias("event_date"),
        (F.col("load_no") % 9).alias("research_date"), F.col("content_type").alias("section"), "content_type",
    )
    found = r.clause_matches(docs, r.compiled_clauses(_search_plans(spark, base)), "load_no", [c for c in docs.columns if c != "load_no"])
    return found.withColumn("clause", F.col("clause").cast("bigint"))


def reference_suppression(spark, base):
    docs = table(spark, base, "documents").where("text is not null").select(F.lit(0).alias("request_id"), "doc_id", F.sha2("text", 256).alias("url"), (F.col("doc_id") % 2 == 0).alias("is_reference"))
    return r.without_references(docs, ["request_id"]).select("doc_id")


def citations_render(spark, base):
    docs = table(spark, base, "source_document")
    few = docs.select(F.floor(F.col("load_no") / 50).alias("request_id"), (F.col("load_no") % 50 + 1).alias("place"), "title", F.col("canonical_url").alias("url"), F.col("source_label").alias("source"))
    return r.cited(few)


def evidence_blocks(spark, base):
    docs = table(spark, base, "source_document")
    few = docs.select(F.floor(F.col("load_no") / 50).alias("request_id"), (F.col("load_no") % 50 + 1).alias("place"), "title", F.col("canonical_url").alias("url"), F.col("legal_status").alias("status"), "text")
    return r.evidence(few).select("request_id", F.sha2("evidence", 256).alias("h"))


def selection_by_label(spark, base):
    pool = _pool(spark, base)
    picks = pool.groupBy("request_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 3").select("request_id", F.array(F.lit("C3"), F.lit("C1")).alias("labels"))
    return r.selected(picks, pool).withColumn("place", F.col("place").cast("bigint"))


def plan_bounds(spark, base):
    items = table(spark, base, "eval_item").select(
        F.col("item_id").alias("request_id"), F.col("question").alias("standalone"), F.when(F.col("item_id") % 2 == 0, F.col("question")).otherwise(F.concat("question", F.lit(" "), F.col("passage"))).alias("latest"),
        (F.col("item_id") % 3 > 0).alias("recent"), F.when(F.col("item_id") % 4 == 0, F.array(F.lit("2024-02-30"), F.lit("2024-02-28"), F.lit("2024-02-28"))).otherwise(F.array().cast("array<string>")).alias("dates"),
        F.when(F.col("item_id") % 5 == 0, F.array(F.lit(0), F.lit(7), F.lit(7))).otherwise(F.array().cast("array<int>")).alias("days"),
    )
    plans = r.planned(items)
    asked = r.decorated(F.col("queries"), F.col("recent"), F.lit("2024-06-30").cast("date"), "civic protests")
    return plans.select("request_id", "recent", F.size("queries").cast("bigint").alias("n"), F.sha2(F.array_join(asked, "|"), 256).alias("asked"), F.array_join("dates", ",").alias("dates"))


QUERIES = {f.__name__: f for f in (
    knn_topk_per_source, rrf_fusion_pool, recent_relative_filter, min_distance_over_queries, diversify_cap_per_source, deduplicate_fold, recency_bonus_rank,
    anchors_override_pool, plan_clauses, metadata_clause_match, reference_suppression, citations_render, evidence_blocks, selection_by_label, plan_bounds,
)}

_HITS = f"""WITH RECURSIVE d AS (
  SELECT q.vec_id AS query_id, c.label AS source_id, c.vec_id AS chunk_id, round(greatest(0, list_cosine_distance(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[]))), 6) AS distance
  FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id, source_id ORDER BY distance, chunk_id) AS rank FROM d WHERE distance <= {THRESHOLD}),
hits AS (SELECT *, query_id // 100 AS request_id FROM k WHERE rank <= 8)"""


def _described_sql(name, rows):
    return f""", {name} AS (SELECT *, source_id || '/' || coalesce(nullif(CASE WHEN chunk_id % 3 = 0 THEN '' ELSE CAST(chunk_id % 40 AS VARCHAR) END, ''), 't' || (chunk_id % 25)) AS doc,
  chunk_id % 30 AS url, chunk_id % 2 = 0 AS art, chunk_id % 10 = 1 AS keyed, chunk_id % 7 = 0 AS ref FROM {rows})"""


def _folded_sql(name, rows, by):
    """An ordered fold step by step: a row after the other of each group, with the documents and addresses kept so far."""
    keys, same = ", ".join(by), " AND ".join(f"x.{b} = m.{b}" for b in by)
    return f""", {name}_o AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY distance, chunk_id) AS pos FROM {rows} m
  WHERE NOT (ref AND EXISTS (SELECT 1 FROM {rows} x WHERE {same} AND x.url = m.url AND NOT x.ref))),
{name}_f AS (SELECT DISTINCT {keys}, CAST(0 AS BIGINT) AS pos, CAST([] AS VARCHAR[]) AS docs, CAST([] AS BIGINT[]) AS urls, CAST(NULL AS BIGINT) AS chunk_id, false AS kept FROM {name}_o
  UNION ALL SELECT {", ".join("o." + b for b in by)}, o.pos, CASE WHEN took THEN list_append(f.docs, o.doc) ELSE f.docs END, CASE WHEN took AND (o.art OR o.keyed) THEN list_append(f.urls, o.url) ELSE f.urls END, o.chunk_id, took
  FROM {name}_f f JOIN {name}_o o ON {" AND ".join(f"o.{b} = f.{b}" for b in by)} AND o.pos = f.pos + 1,
    LATERAL (SELECT NOT (list_contains(f.docs, o.doc) OR (o.art AND list_contains(f.urls, o.url))) AS took) t),
{name} AS (SELECT o.*, row_number() OVER (PARTITION BY {", ".join("o." + b for b in by)} ORDER BY o.pos) AS place FROM {name}_o o JOIN {name}_f f ON {" AND ".join(f"o.{b} = f.{b}" for b in by)} AND o.pos = f.pos WHERE f.kept)"""


_FUSED = (
    _HITS
    + _described_sql("h", "hits")
    + _folded_sql("r", "h", ["request_id", "query_id"])
    + ", u AS (SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY request_id, chunk_id ORDER BY distance, query_id) AS n FROM h) WHERE n = 1)"
    + _folded_sql("p", "u", ["request_id"])
    + """, s AS (SELECT request_id, chunk_id, round(sum(1.0::DOUBLE / (60 + place)), 9) AS score FROM r GROUP BY ALL),
pool AS (SELECT * FROM (SELECT p.* EXCLUDE place, coalesce(score, 0) AS score, row_number() OVER (PARTITION BY request_id ORDER BY coalesce(score, 0) DESC, distance, chunk_id) AS place FROM p LEFT JOIN s USING (request_id, chunk_id)) WHERE place <= 20)"""
)
_DOCS = _HITS + ", m AS (SELECT request_id, chunk_id, source_id, min(distance) AS distance FROM hits GROUP BY ALL)" + _described_sql("docs", "m")
_PLANS = """WITH p AS (SELECT item_id AS n, item_id AS request_id, CASE WHEN n % 3 > 0 THEN [chr(CAST(65 + n % 26 AS INT)), chr(CAST(97 + n % 26 AS INT))] ELSE [] END AS prefixes,
  CASE WHEN n % 4 > 0 THEN [n % 5, n % 5 + 1, n % 5 + 2] ELSE [] END AS days, CASE WHEN n % 5 > 0 THEN [strftime(DATE '2024-01-01' + CAST(n % 400 AS INT), '%Y-%m-%d'), '7'] ELSE [] END AS dates,
  CASE WHEN n % 2 = 0 THEN 'none' ELSE ['news', 'dossier', 'index'][n % 3 + 1] END AS section, n % 7 = 0 AS totals FROM eval_item),
c AS (
  SELECT request_id, 1 AS kind, i, 0 AS j, 'publisher' AS field, '>=' AS op, prefixes[i] AS text, NULL::BIGINT AS number FROM p, unnest(range(1, len(prefixes) + 1)) AS r(i)
  UNION ALL SELECT request_id, 1, i, 0, 'publisher', '<', prefixes[i] || chr(63743), NULL FROM p, unnest(range(1, len(prefixes) + 1)) AS r(i)
  UNION ALL SELECT request_id, 2, i, 0, 'protest_day', '==', NULL, days[i] FROM p, unnest(range(1, len(days) + 1)) AS r(i)
  UNION ALL SELECT request_id, 3, i, 0, 'event_date', '==', dates[i], NULL FROM p, unnest(range(1, len(dates) + 1)) AS r(i)
  UNION ALL SELECT request_id, 3, i, 1, 'research_date', '==', dates[i], NULL FROM p, unnest(range(1, len(dates) + 1)) AS r(i)
  UNION ALL SELECT request_id, 4, 0, 0, 'section', '==', section, NULL FROM p WHERE section <> 'none'
  UNION ALL SELECT request_id, 5, 0, 0, 'content_type', '==', 'map-overview', NULL FROM p WHERE totals),
o AS (SELECT *, dense_rank() OVER (PARTITION BY request_id ORDER BY kind, i, j) - 1 AS clause FROM c)"""

SQL = {
    "knn_topk_per_source": _HITS + " SELECT query_id, source_id, chunk_id, distance, rank FROM hits",
    "rrf_fusion_pool": _FUSED + " SELECT request_id, chunk_id, score, distance, place FROM pool",
    "recent_relative_filter": _HITS + " SELECT query_id, chunk_id, distance FROM (SELECT *, min(distance) OVER (PARTITION BY query_id) AS b FROM hits) WHERE distance <= round(b + 0.18, 6)",
    "min_distance_over_queries": _HITS + " SELECT request_id, chunk_id, min(distance) AS distance FROM hits GROUP BY ALL",
    "diversify_cap_per_source": _DOCS
    + """, a AS (SELECT *, [CAST(url AS VARCHAR), '/p/' || (chunk_id % 45)] AS keys, distance - round(chunk_id % 9 / 100.0::DOUBLE, 2) AS sorted FROM docs),
o AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY sorted, chunk_id) AS pos FROM a m WHERE NOT (ref AND EXISTS (SELECT 1 FROM a x WHERE x.request_id = m.request_id AND NOT x.ref AND list_has_any(x.keys, m.keys)))),
f AS (SELECT DISTINCT request_id, CAST(0 AS BIGINT) AS pos, CAST([] AS VARCHAR[]) AS docs, CAST([] AS VARCHAR[]) AS arts, CAST([] AS INTEGER[]) AS sources, false AS kept FROM o
  UNION ALL SELECT o.request_id, o.pos, CASE WHEN took THEN list_append(f.docs, o.doc) ELSE f.docs END, CASE WHEN took THEN list_concat(f.arts, o.keys) ELSE f.arts END,
    CASE WHEN took THEN list_append(f.sources, o.source_id) ELSE f.sources END, took
  FROM f JOIN o ON o.request_id = f.request_id AND o.pos = f.pos + 1,
    LATERAL (SELECT len(f.docs) < 7 AND NOT list_contains(f.docs, o.doc) AND NOT list_has_any(f.arts, o.keys) AND len(list_filter(f.sources, lambda s: s = o.source_id)) < 3 AS took) t)
SELECT o.request_id, o.chunk_id, o.distance, row_number() OVER (PARTITION BY o.request_id ORDER BY o.pos) AS place FROM o JOIN f ON o.request_id = f.request_id AND o.pos = f.pos WHERE f.kept""",
    "deduplicate_fold": _DOCS + _folded_sql("q", "docs", ["request_id"]) + " SELECT request_id, chunk_id, distance, place FROM q",
    "plan_clauses": _PLANS + " SELECT request_id, clause, field, op, text, number FROM o WHERE clause < 8",
    "metadata_clause_match": _PLANS
    + """, x AS (SELECT load_no, trim(source_label, ' ') AS publisher, load_no % 9 AS protest_day, strftime(fetched_at, '%Y-%m-%d') AS event_date, content_type FROM source_document),
q AS (SELECT request_id, clause, max(field) AS field, min(text) AS low, max(text) AS high, max(number) AS number FROM o WHERE clause < 8 GROUP BY ALL),
m AS (SELECT request_id, clause, load_no FROM q, x WHERE CASE field WHEN 'publisher' THEN publisher >= low AND publisher < high WHEN 'protest_day' THEN protest_day = number WHEN 'event_date' THEN event_date = low
  WHEN 'section' THEN content_type = low WHEN 'content_type' THEN content_type = low ELSE false END)
SELECT request_id, clause, load_no FROM (SELECT *, row_number() OVER (PARTITION BY request_id, clause ORDER BY load_no) AS n FROM m) WHERE n <= 32""",
    "recency_bonus_rank": """SELECT * FROM (SELECT doc_id, round(CASE WHEN CAST(published_at AS DATE) <= DATE '2024-06-30' THEN 0.08::DOUBLE * greatest(0.0::DOUBLE, 1.0::DOUBLE - (DATE '2024-06-30' - CAST(published_at AS DATE)) / 30.0::DOUBLE) ELSE 0 END, 6) AS bonus FROM documents) WHERE bonus > 0""",
    "anchors_override_pool": _FUSED
    + """, near AS (SELECT q.vec_id // 100 AS request_id, c.label AS source_id, c.vec_id AS chunk_id, min(round(greatest(0, list_cosine_distance(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[]))), 6)) AS distance
  FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0 AND c.label = 3 AND c.vec_id % 6 < 4 AND NOT (c.vec_id % 4 = 0 AND c.vec_id % 8 <> 0) GROUP BY ALL)"""
    + _described_sql("nd", "near")
    + _folded_sql("an", "nd", ["request_id"])
    + """, b AS (SELECT request_id, chunk_id, 0 AS p, place FROM an WHERE place <= 16
  UNION ALL SELECT request_id, chunk_id, 1, place FROM pool d WHERE NOT EXISTS (SELECT 1 FROM an WHERE an.place <= 16 AND an.request_id = d.request_id AND an.doc = d.doc)),
w AS (SELECT request_id, chunk_id, row_number() OVER (PARTITION BY request_id ORDER BY p, place) AS place FROM b) SELECT * FROM w WHERE place <= 20""",
    "reference_suppression": "SELECT doc_id FROM documents d WHERE text IS NOT NULL AND NOT (doc_id % 2 = 0 AND EXISTS (SELECT 1 FROM documents x WHERE x.doc_id % 2 = 1 AND x.text = d.text))",
    "citations_render": "SELECT load_no // 50 AS request_id, 'S' || (load_no % 50 + 1) AS citation, title, canonical_url AS url, source_label AS source FROM source_document",
    "evidence_blocks": """SELECT load_no // 50 AS request_id, sha256(string_agg('[S' || (load_no % 50 + 1) || ']' || chr(10) || 'Title: ' || coalesce(title, '') || chr(10) || 'URL: ' || canonical_url || chr(10) || 'Status: ' || coalesce(legal_status, 'Not specified') || chr(10) || '<evidence>' || chr(10) || text || chr(10) || '</evidence>', chr(10) || chr(10) ORDER BY load_no)) AS h
FROM source_document GROUP BY 1""",
    "selection_by_label": _FUSED + " SELECT request_id, chunk_id, CASE place WHEN 3 THEN CAST(1 AS BIGINT) ELSE 2 END AS place FROM pool p WHERE place IN (1, 3) AND EXISTS (SELECT 1 FROM pool x WHERE x.request_id = p.request_id AND x.place = 3)",
    "plan_bounds": """WITH p AS (SELECT item_id, trim(question[:600], ' ') AS a, trim((CASE WHEN item_id % 2 = 0 THEN question ELSE question || ' ' || passage END)[:600], ' ') AS b FROM eval_item),
q AS (SELECT item_id, list_filter(CASE WHEN a IS NOT DISTINCT FROM b THEN [a] ELSE [a, b] END, lambda x: x IS NOT NULL AND x <> '') AS l, item_id % 3 > 0 AND item_id % 4 <> 0 AND item_id % 5 <> 0 AS recent FROM p)
SELECT item_id AS request_id, recent, len(l) AS n, sha256(array_to_string(list_transform(l, lambda x: CASE WHEN recent THEN 'civic protests, June 2024: ' || x ELSE x END), '|')) AS asked, CASE WHEN item_id % 4 = 0 THEN '2024-02-28' ELSE '' END AS dates FROM q""",
}
