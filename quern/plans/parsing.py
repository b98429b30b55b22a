"""Queries of the parsers of structured sources. Records come from dosje and lidhje; files are made from other tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.plans.scalars import _BLANKS, _normal_sql
from quern.sources import parsers
from quern.sources.tables import table


def _told(documents, *keys):
    return documents.select(*keys, "suffix", "title", F.sha2("text", 256).alias("h"), F.sha2("sticky_context", 256).alias("sticky"))


def ud1_dossier(spark, base):
    return _told(parsers.dossier_documents(table(spark, base, "dosje"), table(spark, base, "lidhje"), "rec_no"), "rec_no", "legal_status", F.get_json_object("metadata", "$.relation_count").cast("bigint").alias("relations"))


def _maps(spark, base):
    """A file for each region, its nations as places, and as their events the customers of one segment."""
    r, n, c = (table(spark, base, t) for t in ("region", "nation", "customer"))
    event = F.struct(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("title"), F.lit("2025-06-01").alias("startDate"), F.when(F.col("c_custkey") % 2 == 0, "2025-06-03").alias("endDate"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_custkey") % 3).alias("dayCount"), F.col("c_mktsegment").alias("location"))
    events = c.where("c_mktsegment = 'BUILDING'").groupBy("c_nationkey").agg(F.collect_list(event).alias("protests"))
    none = F.array().cast(events.schema["protests"].dataType)
    place = F.struct(F.col("n_nationkey").cast("string").alias("id"), F.lit("").alias("city"), F.col("n_name").alias("title"), F.col("r_name").alias("country"), F.lit("1.5").alias("latitude"), (F.col("n_nationkey") % 2 == 0).alias("chapterActive"), F.coalesce("protests", none).alias("protests"))
    return r.join(n, F.col("n_regionkey") == F.col("r_regionkey")).join(events, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy(F.col("r_name").alias("path")).agg(F.to_json(F.collect_list(place)).alias("value"))


def ud1_places(spark, base):
    return _told(parsers.place_documents(_maps(spark, base), "Map"), "path", "content_type")


#: A made index of reports is full at so many bytes, half of what the parser takes: one more report fits. It spans so many load numbers at most.
_FULL, _SPAN = 1_000_000, 10_000


def ud1_research(spark, base):
    """For each source as many indexes as its reports fill, in order of their load numbers."""
    n = F.col("load_no")
    access = F.element_at(F.array(*map(F.lit, ("body opened", "Indexed text: read", "search-result only", "", "failed"))), (n % 5 + 1).cast("int"))
    source = F.struct(F.col("source_label").alias("outlet"), F.when(n % 3 > 0, F.col("title")).alias("title"), F.when(n % 11 == 0, F.lit("https://youtu.be/x")).otherwise(F.col("canonical_url")).alias("url"), F.when(n % 2 == 0, F.date_format("fetched_at", "yyyy-MM-dd")).alias("event_date"), access.alias("access"), F.concat(F.lit("x "), F.substring("text", 1, 300)).alias("summary"))
    docs = table(spark, base, "source_document").where("trim(source_label) <> '' and text is not null").select(F.col("source_id").alias("path"), "load_no", (n - n % _SPAN).alias("span"), source.alias("s"))
    before = F.sum(F.octet_length(F.to_json("s")) + 1).over(Window.partitionBy("path", "span").orderBy("load_no").rowsBetween(Window.unboundedPreceding, -1))
    numbered = docs.withColumn("number", F.floor(F.coalesce(before, F.lit(0)) / _FULL))
    files = numbered.groupBy("path", "span", "number").agg(F.to_json(F.struct(F.lit(7).alias("day"), F.lit("2025-06-07").alias("calendar_date"), F.collect_list("s").alias("sources"))).alias("value"))
    found = parsers.research_documents(files, "Research")
    return found.select("path", "canonical_url", F.get_json_object("metadata", "$.evidence_access").alias("access"), F.length("title").cast("bigint").alias("n"))


def ud1_references(spark, base):
    n = F.col("load_no")
    article = F.struct(F.concat(F.lit("https://news.example/a-i"), n.cast("string")).alias("url"), F.array(F.col("canonical_url")).alias("aliases"), F.concat(F.lit("Title "), n.cast("string")).alias("title"), F.concat(F.lit("An introduction of some length "), n.cast("string")).alias("publisher_excerpt"), F.when(n % 4 == 0, "Ide").when(n % 4 == 1, "").otherwise("News").alias("section"), F.lit("2025-06-07T00:00:00Z").alias("published_at"), F.array(F.lit("t")).alias("topics"), F.lit(50).alias("relevance_score"))
    files = table(spark, base, "source_document").groupBy(F.col("source_id").alias("path")).agg(F.to_json(F.struct(F.lit("r/1").alias("schema_version"), F.collect_list(article).alias("articles"))).alias("value"))
    return _told(parsers.reference_documents(files, "News", ("ide", "blog")), "path", F.get_json_object("metadata", "$.article_genre").alias("genre"))


def ud1_series(spark, base):
    """A program source for each event type, its days being those of the table with the sums of their values."""
    daily = table(spark, base, "events").groupBy("event_type", F.to_date("ts").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    day = F.datediff("date", F.lit("2020-01-01").cast("date"))
    row = F.concat(F.lit("{ day: "), day.cast("string"), F.lit(", date: '"), F.col("date").cast("string"), F.lit("', peak: "), F.when(F.col("n") % 5 > 0, F.col("n").cast("string")).otherwise("null"), F.lit(", mean: 1.50, note: { sq: \"shënim\" } }, // a day"))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("date", row.alias("r")))), lambda x: x["r"]), "\n")
    files = daily.groupBy(F.col("event_type").alias("path")).agg(F.concat(F.lit("// Method\nexport const participation: Day[] = [\n"), rows, F.lit("\n] as const;\nexport const participationEvents = [{ day: 3, tier: 'big', label: { sq: 'a', en: 'b' } }];")).alias("value"))
    return parsers.series_documents(files, "Pulse").select("path", "suffix", F.sha2("text", 256).alias("h"))


QUERIES = {f.__name__: f for f in (ud1_dossier, ud1_places, ud1_research, ud1_references, ud1_series)}

_T = lambda c: f"trim(coalesce({c}, ''), {_BLANKS})"
_OR = lambda c, other="Not specified": f"coalesce(nullif({c}, ''), '{other}')"
_DOSSIER = [c for c in "id titull kategori statusi viti_fillimit periudha permbledhje fraza_theksuar pershkrim kosto_eur kosto_tekst kosto_besueshmeria burimet shenime_editoriale".split()]
_NL = "chr(10)"

SQL = {
    "ud1_dossier": f"""WITH d AS (SELECT rec_no, {", ".join(f"{_T(c)} AS {c}" for c in _DOSSIER)} FROM dosje),
l AS (SELECT {_T("dosje_id")} AS id, string_agg(concat_ws(' - ', {", ".join(f"nullif({_T(c)}, '')" for c in ("lloji", "emri", "roli", "statusi", "shenim"))}), {_NL} ORDER BY rec_no) AS lines, count(*) AS n FROM lidhje WHERE dosje_id IS NOT NULL GROUP BY 1),
s AS (SELECT rec_no, list_transform(string_split_regex(burimet, '[\\n,;]+'), lambda x: trim(x, {_BLANKS})) AS u FROM d),
u AS (SELECT rec_no, array_to_string(list_filter(u, lambda x, i: regexp_matches(x, '^(?i:https?)://[^/?#\\s]+') AND list_position(u, x) = i), {_NL}) AS urls FROM s),
k AS (SELECT d.*, l.lines, coalesce(l.n, 0) AS relations, u.urls, {_OR("statusi", "Status not specified")} AS legal_status FROM d LEFT JOIN l USING (id) JOIN u USING (rec_no) WHERE d.id <> '' AND titull <> ''),
t AS (SELECT *, concat('Dossier: ', titull, {_NL}, 'Category: ', kategori, {_NL}, 'Legal or institutional status: ', legal_status, {_NL}, 'This record contains sourced public-interest claims; allegations are not final judgments.') AS ctx FROM k),
x AS (SELECT *, concat_ws({_NL} || {_NL}, ctx, 'Period: ' || coalesce(nullif(periudha, ''), nullif(viti_fillimit, ''), 'Not specified'), 'Summary: ' || nullif(permbledhje, ''), 'Highlighted statement: ' || nullif(fraza_theksuar, ''),
  'Description:' || {_NL} || pershkrim, 'Reported cost: ' || coalesce(nullif(kosto_tekst, ''), nullif(kosto_eur, ''), 'Not specified'), 'Cost confidence: ' || {_OR("kosto_besueshmeria")},
  'Editorial and current-status notes:' || {_NL} || shenime_editoriale, 'Related people, institutions, places, and claims:' || {_NL} || lines, 'Sources:' || {_NL} || nullif(urls, '')) AS body FROM t)
SELECT rec_no, legal_status, relations, id AS suffix, titull AS title, sha256({_normal_sql("body")}) AS h, sha256(ctx) AS sticky FROM x""",
    "ud1_places": f"""WITH p AS (SELECT r_name AS path, n_nationkey, n_name, c_custkey AS c, c_name FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey AND c_mktsegment = 'BUILDING'),
g AS (SELECT path, n_nationkey AS k, n_name, count(c) AS n FROM p GROUP BY ALL),
w AS (SELECT path, 'map-city' AS content_type, 'city:' || k AS suffix, 'Map — ' || n_name || ', ' || path AS title, concat_ws({_NL}, 'Map: ' || n_name || ', ' || path || '.', 'Map label: ' || n_name || '.', 'Map location type: not specified.', 'Map coordinates: 1.5, None.',
    'Local chapter active: ' || CASE WHEN k % 2 = 0 THEN 'yes' ELSE 'no' END || '.', 'Protest records for this city: ' || n || '.', 'Protest days for this city: not specified.') AS t, 'Source: Map' || {_NL} || 'City: ' || n_name || ', ' || path AS s FROM g
  UNION ALL SELECT path, 'map-protest', 'protest:' || c, c_name || ' — ' || n_name || ', 2025-06-01', concat_ws({_NL}, 'Protest: ' || c_name || '.', 'City: ' || n_name || ', ' || path || '.', 'Date: 2025-06-01' || CASE WHEN c % 2 = 0 THEN ' through 2025-06-03.' ELSE '.' END,
    'Protest days in this record: ' || CASE WHEN c % 3 > 0 THEN CAST(c % 3 AS VARCHAR) ELSE 'not specified' END || '.', 'Meeting location: BUILDING'), concat_ws({_NL}, 'Source: Map', 'Protest: ' || c_name, 'Place: ' || n_name || ', ' || path, 'Date: 2025-06-01') FROM p WHERE c IS NOT NULL
  UNION ALL SELECT path, 'map-overview', 'overview', 'Map: totals', concat_ws({_NL}, 'Map: totals of the whole map.', 'location count: ' || count(DISTINCT n_nationkey), 'country count: 1', 'protest record count: ' || count(c), 'protest day count: ' || sum(coalesce(c % 3, 0))), 'Source: Map' || {_NL} || 'Totals of the whole map' FROM p GROUP BY path)
SELECT path, content_type, suffix, title, sha256(t) AS h, sha256(s) AS sticky FROM w""",
    "ud1_research": f"""SELECT source_id AS path, canonical_url, CASE load_no % 5 WHEN 0 THEN 'body_read' WHEN 1 THEN 'indexed_body_read' WHEN 3 THEN 'not_recorded' END AS access,
  length(CASE WHEN load_no % 3 > 0 AND nullif(trim(title, {_BLANKS}), '') IS NOT NULL THEN trim(regexp_replace(title, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'), {_BLANKS}) ELSE trim(regexp_replace(source_label, '\\s+', ' ', 'g'), {_BLANKS}) END) AS n
FROM source_document WHERE trim(source_label, ' ') <> '' AND text IS NOT NULL AND load_no % 5 IN (0, 1, 3) AND load_no % 11 <> 0""",
    "ud1_references": f"""SELECT source_id AS path, CASE WHEN load_no % 4 = 0 THEN 'opinion' ELSE 'reporting' END AS genre, CAST(load_no AS VARCHAR) AS suffix, 'Title ' || load_no AS title,
  sha256('Title ' || load_no || {_NL} || {_NL} || 'Publisher-provided short introduction:' || {_NL} || 'An introduction of some length ' || load_no || {_NL} || {_NL} || 'Author/byline: News. Section: ' || CASE load_no % 4 WHEN 0 THEN 'Ide' WHEN 1 THEN 'Not specified' ELSE 'News' END || '.') AS h,
  sha256('Publisher: News' || {_NL} || 'Article: Title ' || load_no || {_NL} || 'Publication timestamp: 2025-06-07T00:00:00Z; not an established incident date.') AS sticky FROM source_document""",
    "ud1_series": f"""WITH d AS (SELECT event_type AS path, CAST(ts AS DATE) AS date, count(*) AS n FROM events GROUP BY ALL),
e AS (SELECT *, date - DATE '2020-01-01' AS day, CASE WHEN n % 5 > 0 THEN n END AS peak, ['janar', 'shkurt', 'mars', 'prill', 'maj', 'qershor', 'korrik', 'gusht', 'shtator', 'tetor', 'nëntor', 'dhjetor'][month(date)] AS sq FROM d),
h AS (SELECT *, 'Day ' || day || ', ' || date || ' (' || day(date) || ' ' || sq || ' ' || year(date) || ' / ' || day(date) || ' ' || monthname(date) || ' ' || year(date) || ')' AS heading, 'peak ' || coalesce(CAST(peak AS VARCHAR), 'not published') || ', mean 1.5, median not published' AS figures FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY peak DESC NULLS LAST, date) AS hi, row_number() OVER (PARTITION BY path ORDER BY peak NULLS LAST, date) AS lo FROM h)
SELECT path, 'index' AS suffix, sha256(count(*) || ' protest days recorded, from ' || min(CASE WHEN peak IS NOT NULL THEN date END) || ' to ' || max(CASE WHEN peak IS NOT NULL THEN date END) || ', with ' || count(peak) || ' of them carrying a published figure. The index is highest on day '
  || max(CASE WHEN hi = 1 THEN day END) || ' (' || max(CASE WHEN hi = 1 THEN date END) || ') at ' || max(peak) || ' and lowest on day ' || max(CASE WHEN lo = 1 THEN day END) || ' (' || max(CASE WHEN lo = 1 THEN date END) || ') at ' || min(peak) || '.' || {_NL} || {_NL}
  || string_agg(heading || ': ' || figures || '.', {_NL} || {_NL} ORDER BY date)) AS h FROM r GROUP BY path
UNION ALL SELECT DISTINCT path, 'events', sha256('Day 3 (big). a / b.') FROM r
UNION ALL SELECT path, 'day-' || day || '-sq', sha256(heading || '.' || {_NL} || {_NL} || 'shënim' || {_NL} || {_NL} || 'Estimated participation index (not a number of people): ' || figures || '.') FROM r""",
}
