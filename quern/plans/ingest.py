"""Queries of ingestion: chunks, differences, reuse, revisions, relations and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions.text import paragraphs
from quern.operators import chunking, ingest
from quern.sources.tables import table


def _docs(spark, base):
    return table(spark, base, "source_document")


def fo2_greedy_pack(spark, base):
    packed = chunking.packed_lines(paragraphs(F.col("text")), "\n\n", 120)
    return _docs(spark, base).select("load_no", F.posexplode(packed).alias("p", "t")).select("load_no", F.col("p").cast("bigint").alias("chunk_index"), F.octet_length("t").cast("bigint").alias("bytes"), F.sha2("t", 256).alias("h"))


def fo6_chunk_documents(spark, base):
    found = chunking.chunked(_docs(spark, base).dropDuplicates(["document_id"]))
    return found.select("document_id", "source_id", "chunk_index", "token_count", "content_hash", "chunk_id")


def ag1_content_hash_counts(spark, base):
    return ingest.hash_counts(table(spark, base, "chunk_record"))


def ag3_removed_multiset(spark, base):
    """Contents of superseded generations that are rarer in active ones."""
    status = table(spark, base, "generation_manifest").select("generation_id", "status")
    rows = table(spark, base, "chunk_snapshot").select("generation_id", "content_hash").join(status, "generation_id")
    return ingest.removed_hashes(rows.where("status = 'superseded'"), rows.where("status = 'active'"))


def jn2_embedding_reuse(spark, base):
    """Every stored chunk anew: its content has a usable embedding already, in whichever row, or is pending."""
    rows = table(spark, base, "chunk_record")
    plan = ingest.reuse_plan(rows.select("chunk_id", "content_hash", "source_id"), rows, 64)
    return plan.groupBy("source_id", "state").agg(F.count(F.lit(1)).alias("n"))


def ag4_group_digest(spark, base):
    return ingest.group_digest(_docs(spark, base), "source_id", "revision")


def sc5_content_revision(spark, base):
    one = _docs(spark, base).groupBy("source_id", "relative_path").agg(F.min("text").alias("text")).where("text is not null")
    return ingest.content_digest(one, "source_id", "relative_path", "text")


def jn9_missing_sources(spark, base):
    return ingest.missing(table(spark, base, "source_catalog").select("source_id"), _docs(spark, base).where("content_type = 'pdf'"), ["source_id"])


def ag2_documents_per_source(spark, base):
    return _docs(spark, base).groupBy("source_id").agg(F.count_distinct("document_id").alias("documents"), F.count(F.lit(1)).alias("deliveries"))


def pf17_outcomes(spark, base):
    docs = ingest.accepted_and_issues(table(spark, base, "documents"))
    return docs.groupBy("source", "outcome").agg(F.count(F.lit(1)).alias("n"))


def ag16_representative(spark, base):
    return ingest.first_of(table(spark, base, "chunk_record").select("source_id", "chunk_id"), "source_id", "chunk_id")


def jn1_nested_relations(spark, base):
    dosje = table(spark, base, "dosje").select("rec_no", F.trim("id").alias("id"), "titull", "kategori", "kosto_tekst")
    lidhje = table(spark, base, "lidhje").select("rec_no", F.trim("dosje_id").alias("dosje_id"), "emri", "roli")
    nested = ingest.with_relations(dosje, lidhje, "id", "dosje_id", "rec_no", ["emri", "roli"])
    people = F.array_join(F.transform("relations", lambda x: F.concat_ws("/", x["emri"], x["roli"])), "; ")
    text = ingest.rendered([("Title: ", F.col("titull")), ("Category: ", F.col("kategori")), ("Cost: ", F.col("kosto_tekst")), ("Related: ", people)])
    return nested.select("rec_no", F.size("relations").cast("bigint").alias("n"), F.sha2(text, 256).alias("h"))


def jn13_reuse_contract(spark, base):
    m = table(spark, base, "generation_manifest")
    fits = ingest.supports_reuse(m, {"embedding_deployment": "embed-small", "embedding_dimensions": 64, "parser_version": "1.1.0", "chunker_version": "1.1.0", "normalization_version": "1.0.0"})
    return m.select("generation_id", fits.alias("reusable"))


def jn12_active_chunks(spark, base):
    active = table(spark, base, "generation_manifest").where("status = 'active'").select("generation_id", F.col("chunk_count").alias("stated"))
    rows = table(spark, base, "chunk_snapshot").groupBy("generation_id").agg(F.count_distinct("chunk_id").alias("chunks"))
    return active.join(rows, "generation_id", "left").select("generation_id", "stated", "chunks", (F.col("stated") == F.col("chunks")).alias("complete"))


def sk9_generation_id(spark, base):
    m = table(spark, base, "generation_manifest").where("source_revisions is not null")
    return m.select("generation_id", ingest.generation_id(F.col("created_at"), F.col("source_revisions")).alias("made"), F.col("generation_id").rlike(r"^\d{8}T\d{6}Z-[0-9a-f]{12}$").alias("well_formed"))


def so1_document_order(spark, base):
    from pyspark.sql import Window

    order = Window.partitionBy("source_id").orderBy("relative_path", "document_id", "load_no")
    return _docs(spark, base).select("load_no", "source_id", F.row_number().over(order).cast("bigint").alias("place"))


def ag14_chunk_sizes(spark, base):
    rows = table(spark, base, "chunk_record").where("token_count between 1 and 700")
    return rows.groupBy("source_id").agg(F.round(F.avg("token_count"), 6).alias("mean"), F.max("token_count").alias("most"), F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (
    fo2_greedy_pack, fo6_chunk_documents, ag1_content_hash_counts, ag3_removed_multiset, jn2_embedding_reuse, ag4_group_digest, sc5_content_revision, jn9_missing_sources,
    ag2_documents_per_source, pf17_outcomes, ag16_representative, jn1_nested_relations, jn13_reuse_contract, jn12_active_chunks, sk9_generation_id, so1_document_order, ag14_chunk_sizes,
)}

_GENERATIONS = "(SELECT content_hash FROM chunk_snapshot s JOIN generation_manifest m USING (generation_id) WHERE status = '{}' AND content_hash IS NOT NULL)"
_ACTIVE, _CURRENT = _GENERATIONS.format("superseded"), _GENERATIONS.format("active")
_WS = r"[\s\x0B\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

SQL = {
    "fo2_greedy_pack": f"""WITH RECURSIVE p AS (
  SELECT load_no, list_filter(list_transform(string_split_regex(text, '\\n{_WS}*\\n'), lambda s: regexp_replace(s, '^{_WS}+|{_WS}+$', '', 'g')), lambda s: s <> '') AS l FROM source_document),
w AS (
  SELECT load_no, l, 1 AS i, CAST(0 AS BIGINT) AS c, l[1] AS cur FROM p WHERE len(l) > 0
  UNION ALL
  SELECT load_no, l, i + 1, CASE WHEN strlen(cur || chr(10) || chr(10) || l[i + 1]) <= 408 THEN c ELSE c + 1 END, CASE WHEN strlen(cur || chr(10) || chr(10) || l[i + 1]) <= 408 THEN cur || chr(10) || chr(10) || l[i + 1] ELSE l[i + 1] END
  FROM w WHERE i < len(l))
SELECT load_no, c AS chunk_index, max(strlen(cur)) AS bytes, sha256(max_by(cur, i)) AS h FROM w GROUP BY load_no, c""",
    "ag1_content_hash_counts": "SELECT content_hash, count(*) AS n FROM chunk_record WHERE content_hash IS NOT NULL GROUP BY 1",
    "ag3_removed_multiset": f"""WITH a AS (SELECT content_hash, count(*) AS n FROM {_ACTIVE} WHERE content_hash IS NOT NULL GROUP BY 1), c AS (SELECT content_hash, count(*) AS n FROM {_CURRENT} GROUP BY 1)
SELECT a.content_hash, a.n - coalesce(c.n, 0) AS removed FROM a LEFT JOIN c USING (content_hash) WHERE a.n > coalesce(c.n, 0)""",
    "jn2_embedding_reuse": f"""SELECT source_id, CASE WHEN content_hash IN (SELECT content_hash FROM chunk_record WHERE content_hash IS NOT NULL AND len(embedding) = 64) THEN 'reused' ELSE 'pending' END AS state, count(*) AS n FROM chunk_record GROUP BY ALL""",
    "ag4_group_digest": "SELECT source_id, count(revision) AS n, sha256(string_agg(revision, chr(10) ORDER BY revision)) AS digest FROM source_document GROUP BY 1",
    "jn9_missing_sources": "SELECT source_id FROM source_catalog WHERE source_id NOT IN (SELECT source_id FROM source_document WHERE content_type = 'pdf')",
    "ag2_documents_per_source": "SELECT source_id, count(DISTINCT document_id) AS documents, count(*) AS deliveries FROM source_document GROUP BY 1",
    "pf17_outcomes": "SELECT source, CASE WHEN text IS NULL THEN 'failed' WHEN length(trim(text, ' ')) < 40 THEN 'skipped' ELSE 'accepted' END AS outcome, count(*) AS n FROM documents GROUP BY ALL",
    "sc5_content_revision": """WITH o AS (SELECT source_id, relative_path AS p, min(text) AS t FROM source_document GROUP BY ALL)
SELECT source_id, sha256(unhex(string_agg(hex(encode(p)) || '00' || sha256(t), '' ORDER BY p))) AS digest FROM o WHERE t IS NOT NULL GROUP BY 1""",
    "ag16_representative": "SELECT source_id, min(chunk_id) AS chunk_id FROM chunk_record GROUP BY 1",
    "jn1_nested_relations": """WITH r AS (SELECT trim(dosje_id, ' ') AS id, count(*) AS n, string_agg(concat_ws('/', emri, roli), '; ' ORDER BY rec_no) AS p FROM lidhje WHERE dosje_id IS NOT NULL GROUP BY 1)
SELECT rec_no, coalesce(n, 0) AS n, sha256(concat_ws(chr(10), CASE WHEN trim(titull, ' ') <> '' THEN 'Title: ' || trim(titull, ' ') END, CASE WHEN trim(kategori, ' ') <> '' THEN 'Category: ' || trim(kategori, ' ') END,
  CASE WHEN trim(kosto_tekst, ' ') <> '' THEN 'Cost: ' || trim(kosto_tekst, ' ') END, CASE WHEN trim(p, ' ') <> '' THEN 'Related: ' || trim(p, ' ') END)) AS h FROM dosje d LEFT JOIN r ON trim(d.id, ' ') = r.id""",
    "jn13_reuse_contract": """SELECT generation_id, embedding_deployment IS NOT DISTINCT FROM 'embed-small' AND embedding_dimensions IS NOT DISTINCT FROM 64 AND parser_version IS NOT DISTINCT FROM '1.1.0' AND chunker_version IS NOT DISTINCT FROM '1.1.0'
  AND normalization_version IS NOT DISTINCT FROM '1.0.0' AS reusable FROM generation_manifest""",
    "jn12_active_chunks": "SELECT m.generation_id, any_value(chunk_count) AS stated, nullif(count(DISTINCT chunk_id), 0) AS chunks, any_value(chunk_count) = nullif(count(DISTINCT chunk_id), 0) AS complete FROM generation_manifest m LEFT JOIN chunk_snapshot s ON m.generation_id = s.generation_id WHERE status = 'active' GROUP BY 1",
    "sk9_generation_id": r"SELECT generation_id, strftime(created_at, '%Y%m%dT%H%M%SZ') || '-' || sha256(source_revisions)[:12] AS made, regexp_matches(generation_id, '^\d{8}T\d{6}Z-[0-9a-f]{12}$') AS well_formed FROM generation_manifest WHERE source_revisions IS NOT NULL",
    "so1_document_order": "SELECT load_no, source_id, row_number() OVER (PARTITION BY source_id ORDER BY relative_path, document_id, load_no) AS place FROM source_document",
    "ag14_chunk_sizes": "SELECT source_id, round(avg(token_count), 6) AS mean, max(token_count) AS most, count(*) AS n FROM chunk_record WHERE token_count BETWEEN 1 AND 700 GROUP BY 1",
}
