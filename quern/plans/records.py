"""Queries of record construction, checks, revisions, prompts and guards."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.operators import collector, ingest, records
from quern.plans.scalars import _BLANKS, _normal_sql
from quern.sources.tables import table

KINDS = [(r"/(pdf|map)/", "file"), (r"/news/", "news"), (r"example/[^/]+/0+[13579]", "odd")]
MANIFEST_KEYS = ["count", "smoke"]


def _docs(spark, base):
    return table(spark, base, "source_document")


def pf20_first_match(spark, base):
    return _docs(spark, base).select("load_no", records.first_match(F.col("canonical_url"), KINDS, "page").alias("kind"))


def sf19_first_given(spark, base):
    d = table(spark, base, "dosje")
    return d.select("rec_no", records.first_given(F.col("kosto_eur"), F.col("kosto_tekst"), F.col("periudha"), F.col("viti_fillimit")).alias("given"))


def pf31_violations(spark, base):
    c = F.col
    checks = {
        "hash": c("content_hash").isNotNull(), "tokens": c("token_count").between(1, 700), "index": c("chunk_index") >= 0, "width": F.size("embedding") == 64,
        "direction": F.exists("embedding", lambda x: x != 0) & ~F.exists("embedding", lambda x: F.isnan(x)),
    }
    broken = F.array_join(records.violations(checks), ",")
    return table(spark, base, "chunk_record").groupBy("source_id", broken.alias("broken")).agg(F.count(F.lit(1)).alias("n"))


def sc9_closed_keys(spark, base):
    return table(spark, base, "generation_manifest").select("generation_id", F.array_join(records.unknown_keys(F.col("validation_results"), ["count"]), ",").alias("unknown"))


def pf33_sticky_context(spark, base):
    return _docs(spark, base).select("load_no", records.sticky_context(F.col("source_label"), F.col("title"), F.col("legal_status")).alias("sticky"))


def pf28_document(spark, base):
    made = records.document(F.col("source_id"), F.col("relative_path"), F.lit(""), F.when(F.col("load_no") % 4 == 0, " ").otherwise(F.col("title")), F.col("text"))
    return _docs(spark, base).select("load_no", made.alias("d")).select("load_no", "d.document_id", "d.title", F.sha2("d.text", 256).alias("h"))


def sf25_record_revision(spark, base):
    fields = {k: F.col(k) for k in ("document_id", "source_id", "language", "legal_status", "revision")}
    return _docs(spark, base).select("load_no", records.revision(fields).alias("revision_hash"))


def _passages(spark, base):
    n = F.col("load_no")
    return _docs(spark, base).select(
        F.floor(n / 20).alias("request_id"), (n % 20 + 1).alias("place"), "title", F.col("source_label").alias("publisher"), F.col("source_label").alias("source"), F.col("canonical_url").alias("url"), F.col("legal_status").alias("status"),
        F.when(n % 3 == 0, "body_read").alias("access"), (n % 5 == 0).alias("is_reference"), "text", F.create_map(F.lit("event_date"), F.date_format("fetched_at", "yyyy-MM-dd"), F.lit("source_kind"), F.col("content_type")).alias("metadata"),
    )


def _asked(spark, base):
    i = F.col("item_id")
    said = F.when(i % 2 == 0, F.concat(F.lit("Visitor: "), F.col("question")))
    history = F.when(i % 2 == 0, F.array(F.struct(F.lit("user").alias("role"), F.col("question").alias("text")))).otherwise(F.array().cast("array<struct<role:string,text:string>>"))
    return table(spark, base, "eval_item").where("question is not null").select((i - 1).alias("request_id"), "question", said.alias("transcript"), history.alias("history"), F.col("answer").alias("interpretation"), F.lit("2024-06-30").alias("as_of"), (i % 3 == 0).alias("recent"))


def sf28_rank_prompt(spark, base):
    found = records.rank_prompt(_passages(spark, base), _asked(spark, base))
    get = lambda path: F.get_json_object("prompt", path)
    return found.select(
        "request_id", get("$.question").alias("question"), get("$.interpretation").alias("interpretation"), get("$.scope_hint_only.recent").cast("boolean").alias("recent"), get("$.passages[2].id").alias("third"), get("$.passages[2].metadata.source_kind").alias("kind"),
        F.length(get("$.passages[2].text")).cast("bigint").alias("n"), F.contains("prompt", F.lit('"research_date":null')).alias("nulls"),
    )


def sf28_grounded_prompt(spark, base):
    return records.grounded_prompt(_passages(spark, base), _asked(spark, base)).select("request_id", F.sha2("prompt", 256).alias("h"))


def sf30_refusal(spark, base):
    n = F.col("event_id")
    body = F.when(n % 4 == 0, '{"detail": "daily_quota_exhausted"}').when(n % 4 == 1, "{broken").when(n % 4 == 2, '{"detail": ["x"]}')
    return table(spark, base, "events").select("event_id", records.refusal(F.element_at(F.array(F.lit(503), F.lit(429), F.lit(500)), (n % 3 + 1).cast("int")), body).alias("reason"))


def so8_in_order(spark, base):
    rows = table(spark, base, "events").withColumns({"batch": F.floor(F.col("event_id") / 64), "index": (F.col("event_id") % 64).cast("int")})
    whole = rows.withColumn("low", F.min("index").over(Window.partitionBy("batch"))).withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("batch")))
    found = records.in_order(whole.withColumn("index", F.col("index") - F.col("low")), "batch", "index", "user_id", "size")
    return found.select("batch", F.array_join(F.col("values").cast("array<string>"), ",").alias("users"))


def se9_same_set(spark, base):
    sets = table(spark, base, "lidhje").groupBy("dosje_id").agg(F.collect_list("lloji").alias("a"), F.collect_list(F.when(F.col("rec_no") % 2 == 0, F.col("lloji"))).alias("b"))
    return sets.select("dosje_id", records.same_set(F.col("a"), F.col("b")).alias("same"))


def pf14_candidates(spark, base):
    n = F.col("load_no")
    dated = F.concat(F.lit("https://a.example/"), F.date_format("fetched_at", "yyyy/MM/dd"), F.lit("/Gjykat%C3%AB-"), n.cast("string"))
    entries = _docs(spark, base).select(F.when(n % 3 > 0, dated).otherwise(F.col("canonical_url")).alias("url"), F.when(n % 4 > 0, F.col("fetched_at")).alias("lastmod"))
    found = collector.candidates(entries, "gjykatë-|/news/", F.lit("2025-01-10").cast("date"))
    return found.select("url", "outcome")


def so5_first_candidates(spark, base):
    entries = _docs(spark, base).select(F.col("canonical_url").alias("url"), F.when(F.col("load_no") % 4 > 0, F.col("fetched_at")).alias("lastmod"))
    return collector.newest_first(collector.latest_modified(entries), F.lit("2025-01-20").cast("timestamp_ntz")).limit(25).select("url")


def so6_preview(spark, base):
    return collector.preview(table(spark, base, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id")


def pf24_publication_window(spark, base):
    return collector.published_between(table(spark, base, "documents"), F.lit("2023-06-01").cast("timestamp_ntz"), F.col("ingested_at")).select("doc_id")


def _requalified(spark, base):
    return collector.requalified(table(spark, base, "documents").select("doc_id", "text"), F.lower("text"), [("court", "gjykat|court"), ("money", "euro|fund")])


def pf27_requalified(spark, base):
    return _requalified(spark, base).select("doc_id", F.col("score").cast("bigint").alias("score"), "outcome")


def ag13_outcome_counts(spark, base):
    return collector.outcome_counts(_requalified(spark, base), ["kept", "removed_unrelated", "new"])


def ag16_first_rows(spark, base):
    return ingest.first_of(_docs(spark, base).select("source_id", "load_no", "title", "language"), "source_id", "load_no")


def ag18_repeated_keys(spark, base):
    return ingest.repeated_keys(_docs(spark, base), "document_id")


def sf33_frozen_sources(spark, base):
    old, new = (ingest.content_digest(_docs(spark, base).where(w), "source_id", "load_no", "text").select("source_id", "digest") for w in ("text is not null", "text is not null and load_no % 50 > 0"))
    return ingest.changed_revisions(old, new, "source_id", "digest").select("source_id")


def sf29_rich_blocks(spark, base):
    b = F.posexplode(records.blocks(F.col("text"))).alias("p", "b")
    return table(spark, base, "documents").select("doc_id", b).groupBy("doc_id", "b.kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("b.items")).alias("items"))


def wn12_batches(spark, base):
    rows = records.batched(table(spark, base, "chunk_record").dropDuplicates(["chunk_id"]), "source_id", "chunk_id", 16)
    return rows.groupBy("source_id", "batch").agg(F.count(F.lit(1)).alias("n"), F.min("chunk_id").alias("first"))


def pf22_allowed_origins(spark, base):
    allowed = table(spark, base, "source_catalog").select(F.regexp_replace(F.upper("base_url"), "/$", ":443").alias("origin"))
    asked = _docs(spark, base).select("load_no", F.when(F.col("load_no") % 3 == 0, "https://other.example").otherwise(F.regexp_extract("canonical_url", r"^(https?://[^/]+)", 1)).alias("url"))
    return records.from_allowed_origins(asked, "url", allowed).select("load_no")


def pf21_request_bounds(spark, base):
    sizes = {"question": F.length(F.trim("question")).between(2, 200), "citations": F.col("min_citations").between(0, 2)}
    return table(spark, base, "eval_item").select("item_id", F.array_join(records.violations(sizes), ",").alias("broken"))


def ag5_reuse_counters(spark, base):
    m = table(spark, base, "generation_manifest")
    return m.groupBy("collection_id").agg(F.sum("reused_embedding_count").cast("bigint").alias("reused"), F.sum("embedded_chunk_count").cast("bigint").alias("embedded"), F.count_if(F.col("failed_file_count") > 0).alias("with_failures"))


QUERIES = {f.__name__: f for f in (
    pf20_first_match, sf19_first_given, pf31_violations, sc9_closed_keys, pf33_sticky_context, pf28_document, sf25_record_revision, sf28_rank_prompt, sf28_grounded_prompt, sf30_refusal, so8_in_order, se9_same_set, pf14_candidates, so5_first_candidates, so6_preview, pf24_publication_window, pf27_requalified, ag13_outcome_counts, ag16_first_rows, ag18_repeated_keys, sf33_frozen_sources, sf29_rich_blocks, wn12_batches,
    pf22_allowed_origins, pf21_request_bounds, ag5_reuse_counters,
)}

_TRIM = lambda c: f"nullif(trim({c}, {_BLANKS}), '')"
_JSON = " || ', ' || ".join(f"'\"{k}\": ' || coalesce(CAST(to_json({k}) AS VARCHAR), 'null')" for k in ("document_id", "language", "legal_status", "revision", "source_id"))

SQL = {
    "pf20_first_match": "SELECT load_no, CASE WHEN regexp_matches(canonical_url, '/(pdf|map)/') THEN 'file' WHEN regexp_matches(canonical_url, '/news/') THEN 'news' WHEN regexp_matches(canonical_url, 'example/[^/]+/0+[13579]') THEN 'odd' ELSE 'page' END AS kind FROM source_document",
    "sf19_first_given": f"SELECT rec_no, coalesce({_TRIM('kosto_eur')}, {_TRIM('kosto_tekst')}, {_TRIM('periudha')}, {_TRIM('viti_fillimit')}) AS given FROM dosje",
    "pf31_violations": """SELECT source_id, concat_ws(',', CASE WHEN content_hash IS NULL THEN 'hash' END, CASE WHEN NOT coalesce(token_count BETWEEN 1 AND 700, FALSE) THEN 'tokens' END, CASE WHEN NOT coalesce(chunk_index >= 0, FALSE) THEN 'index' END,
  CASE WHEN NOT coalesce(len(embedding) = 64, FALSE) THEN 'width' END, CASE WHEN embedding IS NULL OR len(list_filter(embedding, lambda x: x <> 0)) = 0 OR len(list_filter(embedding, lambda x: isnan(x))) > 0 THEN 'direction' END) AS broken, count(*) AS n FROM chunk_record GROUP BY ALL""",
    "sc9_closed_keys": "SELECT generation_id, array_to_string(list_sort(list_filter(coalesce(json_keys(validation_results), []), lambda k: k <> 'count')), ',') AS unknown FROM generation_manifest",
    "pf33_sticky_context": "SELECT load_no, concat_ws(chr(10), 'Source: ' || source_label, 'Title: ' || title, legal_status) AS sticky FROM source_document",
    "pf28_document": f"""SELECT load_no, sha256(concat_ws(chr(0), source_id, relative_path, ''))[:32] AS document_id,
  coalesce(CASE WHEN load_no % 4 > 0 THEN {_TRIM('title')} END, regexp_replace(regexp_extract(relative_path, '([^/]+)$', 1), '\\.[^.]*$', '')) AS title, sha256({_normal_sql("text")}) AS h FROM source_document""",
    "sf25_record_revision": f"SELECT load_no, sha256('{{' || {_JSON} || '}}') AS revision_hash FROM source_document",
    "sf28_rank_prompt": """WITH o AS (SELECT *, load_no // 20 AS request_id, row_number() OVER (PARTITION BY load_no // 20 ORDER BY load_no) AS k FROM source_document),
p AS (SELECT request_id, 'C' || (load_no % 20 + 1) AS third, content_type AS kind, length(text[:1800]) AS n FROM o WHERE k = 3)
SELECT request_id, question, answer AS interpretation, item_id % 3 = 0 AS recent, third, kind, n, TRUE AS nulls FROM p JOIN eval_item ON item_id - 1 = request_id WHERE question IS NOT NULL""",
    "sf28_grounded_prompt": """WITH b AS (SELECT load_no // 20 AS r, string_agg(concat_ws(chr(10), '[S' || (load_no % 20 + 1) || ']', 'Title: ' || coalesce(title, ''), 'Publisher: ' || coalesce(source_label, ''), 'URL: ' || coalesce(canonical_url, ''),
  'Legal or institutional status: ' || coalesce(nullif(legal_status, ''), 'Not specified'), CASE WHEN load_no % 5 = 0 THEN 'Reference-only use: publisher headline and short introduction only. Identify/cite the article or show a short supplied excerpt; do not summarize its full text or infer incident dates from publication dates.'
  WHEN load_no % 3 = 0 THEN 'Research page-access record: body_read. This describes the author''s research; the original page was not re-fetched during ingestion.' ELSE '' END, '<evidence>', coalesce(text, ''), '</evidence>'), chr(10) || chr(10) ORDER BY load_no) AS t FROM source_document GROUP BY 1)
SELECT item_id - 1 AS request_id, sha256(CASE WHEN item_id % 2 = 0 THEN 'Recent conversation (unverified context, never evidence):' || chr(10) || '<conversation>' || chr(10) || 'Visitor: ' || question || chr(10) || '</conversation>' || chr(10) || chr(10) ELSE '' END
  || 'Visitor question:' || chr(10) || question || chr(10) || chr(10) || 'Evidence blocks:' || chr(10) || chr(10) || coalesce(t, '')) AS h FROM eval_item LEFT JOIN b ON r = item_id - 1 WHERE question IS NOT NULL""",
    "sf29_rich_blocks": f"""WITH b AS (SELECT doc_id, unnest(string_split_regex(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '\\n[ \\t]*\\n\\s*', chr(1), 'g'), chr(1))) AS b FROM documents),
l AS (SELECT doc_id, list_filter(list_transform(string_split(b, chr(10)), lambda x: trim(x, {_BLANKS})), lambda x: x <> '') AS l FROM b WHERE trim(b, {_BLANKS}) <> ''),
k AS (SELECT doc_id, CASE WHEN len(list_filter(l, lambda x: x[1:2] IN ('- ', '* '))) = len(l) THEN 'list' WHEN len(list_filter(l, lambda x: regexp_matches(x, '^[0-9]+[.)] '))) = len(l) THEN 'ordered' ELSE 'paragraph' END AS kind, len(l) AS c FROM l)
SELECT doc_id, kind, count(*) AS n, CAST(sum(CASE WHEN kind = 'paragraph' THEN 1 ELSE c END) AS BIGINT) AS items FROM k GROUP BY ALL""",
    "sf30_refusal": "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'unavailable' WHEN 1 THEN CASE WHEN event_id % 4 = 0 THEN 'daily_quota_exhausted' ELSE 'too_many_requests' END ELSE 'request_failed' END AS reason FROM events",
    "so8_in_order": "SELECT event_id // 64 AS batch, string_agg(user_id, ',' ORDER BY event_id) AS users FROM events GROUP BY 1",
    "se9_same_set": "SELECT dosje_id, bool_and(lloji IS NULL OR EXISTS (SELECT 1 FROM lidhje y WHERE y.dosje_id IS NOT DISTINCT FROM x.dosje_id AND y.lloji = x.lloji AND y.rec_no % 2 = 0)) AS same FROM lidhje x GROUP BY 1",
    "pf14_candidates": """WITH e AS (SELECT DISTINCT load_no % 3 > 0 AS dated, CASE WHEN load_no % 3 > 0 THEN 'https://a.example/' || strftime(fetched_at, '%Y/%m/%d') || '/Gjykat%C3%AB-' || load_no ELSE canonical_url END AS url, CASE WHEN load_no % 3 > 0 THEN CAST(fetched_at AS DATE) END AS day FROM source_document)
SELECT url, CASE WHEN day < DATE '2025-01-10' THEN 'before_start' WHEN dated OR contains(lower(url), '/news/') THEN 'candidate' ELSE 'unrelated' END AS outcome FROM e""",
    "so5_first_candidates": "SELECT url FROM (SELECT canonical_url AS url, max(CASE WHEN load_no % 4 > 0 THEN fetched_at END) AS m FROM source_document GROUP BY 1) ORDER BY coalesce(m, TIMESTAMP '2025-01-20') DESC, url DESC LIMIT 25",
    "so6_preview": "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 10",
    "pf24_publication_window": "SELECT doc_id FROM documents WHERE published_at >= TIMESTAMP '2023-06-01' AND published_at <= ingested_at",
    "pf27_requalified": """WITH h AS (SELECT doc_id, coalesce(regexp_matches(lower(text), 'gjykat|court'), false) AS a, coalesce(regexp_matches(lower(text), 'euro|fund'), false) AS b FROM documents)
SELECT doc_id, CAST(CASE WHEN a THEN 40 + CASE WHEN b THEN 10 ELSE 0 END ELSE 0 END AS BIGINT) AS score, CASE WHEN a THEN 'kept' ELSE 'removed_unrelated' END AS outcome FROM h""",
    "ag13_outcome_counts": "SELECT count(*) FILTER (regexp_matches(lower(text), 'gjykat|court')) AS kept, count(*) - count(*) FILTER (regexp_matches(lower(text), 'gjykat|court')) AS removed_unrelated, CAST(0 AS BIGINT) AS new FROM documents",
    "ag16_first_rows": "SELECT source_id, load_no, title, language FROM source_document x WHERE load_no = (SELECT min(load_no) FROM source_document y WHERE y.source_id IS NOT DISTINCT FROM x.source_id)",
    "ag18_repeated_keys": "SELECT document_id, count(*) AS n FROM source_document WHERE document_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "sf33_frozen_sources": "SELECT DISTINCT source_id FROM source_document WHERE text IS NOT NULL AND load_no % 50 = 0",
    "wn12_batches": "WITH c AS (SELECT DISTINCT source_id, chunk_id FROM chunk_record), r AS (SELECT *, (row_number() OVER (PARTITION BY source_id ORDER BY chunk_id) - 1) // 16 AS batch FROM c) SELECT source_id, batch, count(*) AS n, min(chunk_id) AS first FROM r GROUP BY ALL",
    "pf22_allowed_origins": "SELECT load_no FROM source_document WHERE load_no % 3 <> 0 AND regexp_extract(canonical_url, '^(https?://[^/]+)', 1) IN (SELECT regexp_replace(base_url, '/$', '') FROM source_catalog)",
    "pf21_request_bounds": "SELECT item_id, concat_ws(',', CASE WHEN NOT coalesce(length(trim(question, ' ')) BETWEEN 2 AND 200, FALSE) THEN 'question' END, CASE WHEN NOT coalesce(min_citations BETWEEN 0 AND 2, FALSE) THEN 'citations' END) AS broken FROM eval_item",
    "ag5_reuse_counters": "SELECT collection_id, CAST(sum(reused_embedding_count) AS BIGINT) AS reused, CAST(sum(embedded_chunk_count) AS BIGINT) AS embedded, count(*) FILTER (failed_file_count > 0) AS with_failures FROM generation_manifest GROUP BY 1",
}
