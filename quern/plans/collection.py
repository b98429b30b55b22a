"""Queries of collection, pages and evaluation. Pages are made from source_document, scans from two deliveries of it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.operators import collector, evaluation
from quern.plans.scalars import _lines_sql
from quern.sources import markup
from quern.sources.tables import table

ROBOTS = "User-agent: *\nDisallow: /map/\nAllow: /map/*-2$\n\nUser-agent: quern\nDisallow: /*pdf\nAllow: /pdf/0\nDisallow: /news/00000001\n"
TOPICS = [("court", r"gjykat|court|tribunal|gericht"), ("money", r"euro|fund|fond"), ("protest", r"protest|marsh")]


def _docs(spark, base):
    return table(spark, base, "source_document")


def _pages(spark, base):
    """A page for each document: two heads, menus and forms inside what counts, elements without an end, character references,
    and the text itself with whatever it holds, escaped."""
    escaped = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    html = F.concat(
        F.lit("<!doctype html><html><head><meta property='og:title' content='"), F.col("document_id"), F.lit(" &amp; <b>more</b>'><meta property='og:title' content='x'><meta name=empty content=''><link rel='next' href='/n'><link rel='alternate canonical' href='"), F.col("canonical_url"),
        F.lit("'></head><body><head><meta name='late' content='y'></head><nav>menu</nav><p>before</p><main class='other'><!-- <main class='b'> --></main><main class='a b'><nav><ul><li>menu &gt; <b>x</b></li></ul></nav><h1>"), F.col("document_id"),
        F.lit(" &amp;&nbsp;<i>more</i></h1><script>var x = '<p>1</p>';</script><div>first<br>second &eacute;&#233;</div><form><p>hidden</p><input name=q></form><img src=x alt='no'>A passage that every page has, so that none is too short to count.<p>"), escaped,
        F.lit("</p><a href='/news/"), F.col("load_no").cast("string"), F.lit("/?utm=1#top'>n</a><a href='https://other.example/news/9/'>o</a><a>none</a><A HREF='../news/"), F.col("load_no").cast("string"),
        F.lit("/x/'>deep</A></main><p>after</p></body></html>"),
    )
    return _docs(spark, base).select("load_no", F.col("canonical_url").alias("url"), html.alias("html"))


def sc17_main_text(spark, base):
    found = markup.main_texts(_pages(spark, base), "load_no", css_class="b")
    return found.select("load_no", "title", F.sha2("text", 256).alias("h"))


def sc16_link_discovery(spark, base):
    return markup.discovered_links(_pages(spark, base), "load_no", r"/news/[^/]+/")


def sc18_head_fields(spark, base):
    return markup.head_fields(_pages(spark, base), "load_no")


def sc19_sitemap_entries(spark, base):
    """Sitemaps with and without a prefix for their name space, some with a page map that is no XML."""
    prefix = F.when(F.length("source_id") % 2 == 0, "s:").otherwise("")
    broken = F.when(F.col("load_no") % 9 == 0, "<PageMap>a & b < c</PageMap>").otherwise("")
    tag = lambda name, value: F.concat(F.lit("<"), prefix, F.lit(name + ">"), value, F.lit("</"), prefix, F.lit(name + ">"))
    entry = tag("url", F.concat(tag("loc", F.concat(F.lit(" "), F.replace("canonical_url", F.lit("&"), F.lit("&amp;")), F.lit("?a=1&amp;b=2 "))), F.when(F.col("load_no") % 4 > 0, tag("lastmod", F.date_format("fetched_at", "yyyy-MM-dd"))).otherwise(""), broken))
    space = F.concat(F.lit("<?xml version='1.0'?><"), prefix, F.lit("urlset xmlns"), F.when(prefix == "", "").otherwise(":s"), F.lit("='http://www.sitemaps.org/schemas/sitemap/0.9'>"))
    maps = _docs(spark, base).groupBy("source_id").agg(F.concat(F.first(space), F.array_join(F.array_sort(F.collect_list(entry)), ""), F.lit("</"), F.first(prefix), F.lit("urlset>")).alias("html"))
    return markup.sitemap_rows(maps.withColumn("url", F.lit("")), "source_id").groupBy("source_id", "link").agg(F.max("lastmod").alias("lastmod"))


def sc20_robots(spark, base):
    path = F.regexp_extract("canonical_url", r"^https?://[^/]+(/.*)$", 1)
    allowed = lambda agent: markup.robots_allowed(path, markup.robots_rules(ROBOTS, agent))
    return _docs(spark, base).select("load_no", allowed("quern/1.0").alias("own"), allowed("other").alias("other"))


def ag11_max_lastmod(spark, base):
    entries = _docs(spark, base).select(F.col("canonical_url").alias("url"), F.when(F.col("load_no") % 3 > 0, F.col("fetched_at")).alias("lastmod"))
    return collector.latest_modified(entries)


def pf15_path_dates(spark, base):
    dated = F.concat(F.lit("https://a.example/"), F.date_format("fetched_at", "yyyy/MM/dd"), F.lit("/x"))
    url = F.when(F.col("load_no") % 3 == 0, F.lit("https://a.example/2025/13/40/x")).otherwise(dated)
    return _docs(spark, base).select("load_no", collector.path_date(url).alias("day")).where(F.col("day") >= F.lit("2025-01-10").cast("date"))


def jn10_fetch_plan(spark, base):
    docs = _docs(spark, base).groupBy(F.col("document_id").alias("url")).agg(F.min("load_no").alias("n"), F.min("fetched_at").alias("lastmod"))
    hour = lambda h: F.expr(f"INTERVAL {h} HOURS")
    seen = docs.select("url", F.when(F.col("n") % 4 == 0, F.col("lastmod")).otherwise(F.col("lastmod") - hour(1)).alias("lastmod"))
    cache = docs.select("url", F.when(F.col("n") % 3 == 0, F.col("lastmod")).otherwise(F.col("lastmod") - hour(1)).alias("lastmod"), (F.col("lastmod") + hour(2)).alias("checked_at"))
    now, last = (F.lit(t).cast("timestamp_ntz") for t in ("2025-01-20 00:00:00", "2025-01-19 06:00:00"))
    start = collector.scan_start(F.lit("2025-01-01").cast("timestamp_ntz"), last, 48, F.lit(False))
    return collector.fetch_plan(docs.select("url", "lastmod"), seen, cache, now, last, start)


def jn11_merge_counters(spark, base):
    """Deliveries before a day are the index, those from then on what was found; the last of each counts."""
    docs = _docs(spark, base).select(F.col("document_id").alias("key"), "fetched_at", F.col("revision"), F.col("canonical_url").alias("alias"), F.col("load_no").alias("n"))
    side = lambda rows: rows.groupBy("key").agg(F.max_by("revision", "n").alias("revision"), F.array_sort(F.collect_set("alias")).alias("aliases"))
    day = F.lit("2025-01-12").cast("timestamp_ntz")
    return collector.merged(side(docs.where(F.col("fetched_at") < day)), side(docs.where(F.col("fetched_at") >= day))).select("key", "revision", F.array_join("aliases", ",").alias("aliases"), "state")


def ag12_missing_months(spark, base):
    days = table(spark, base, "orders").select(F.to_date("o_orderdate").alias("day"))
    return collector.missing_months(days, "day", F.lit("1990-01-05").cast("date"), F.lit("2002-12-01").cast("date"))


def sf15_topic_rules(spark, base):
    score, found = collector.topics(F.lower("text"), TOPICS)
    return table(spark, base, "documents").where("text is not null").select("doc_id", score.cast("bigint").alias("score"), F.array_join(found, ",").alias("topics"))


def ag9_peak_summary(spark, base):
    daily = table(spark, base, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.round(F.sum("value"), 4).alias("v"), F.count(F.lit(1)).alias("n"))
    return collector.peak_summary(daily.select("event_type", "day", F.when(F.col("n") % 5 > 0, F.col("n")).alias("value")), "event_type")


def pf30_per_language(spark, base):
    return collector.per_language(table(spark, base, "eval_item").withColumn("en", F.when(F.col("item_id") % 4 == 0, F.col("passage"))).withColumn("sq", F.when(F.col("item_id") % 6 > 0, F.col("answer"))), "item_id", {"sq": "sq", "en": "en"})


def ag10_map_totals(spark, base):
    r, n, c = (table(spark, base, t) for t in ("region", "nation", "customer"))
    cities = n.join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("n_regionkey", "n_nationkey").agg(F.count("c_custkey").alias("m"), F.round(F.sum("c_acctbal"), 2).alias("b"))
    return r.join(cities, F.col("r_regionkey") == F.col("n_regionkey"), "left").groupBy("r_name").agg(
        F.count("n_nationkey").alias("places"), F.sum("m").alias("people"), F.round(F.sum("b"), 2).alias("total")
    )


def _answers(spark, base):
    i = F.col("item_id")
    return table(spark, base, "eval_item").select(
        i.alias("case_id"),
        F.when(i % 9 == 0, F.lit(None)).when(i % 5 == 0, F.concat(F.lit("# Head\nE.G. nr. 5 "), "passage", F.lit(" [S1]"))).otherwise(F.concat("passage", F.lit(" [S"), (i % 4).cast("string"), F.lit("]"))).alias("answer"),
        F.slice(F.array(F.lit("S1"), F.lit("S2"), F.lit("S3")), F.lit(1), (i % 4).cast("int")).alias("citations"), F.array("suite").alias("sources"), "min_citations", F.lit(2).alias("max_citations"),
        F.array(F.lit("smoke"), F.lit("questions")).alias("expected_any"), F.array_compact(F.array(F.when(i % 3 == 0, F.lit("smoke")))).alias("expected_all"), F.array(F.lit("GJYKATA")).alias("forbidden"), (i % 7 > 0).alias("expect_markers"), F.lit(8).alias("max_sentences"),
        (i % 11 > 0).alias("done"), (i % 13 == 0).alias("error"),
    )


def sf31_eval_rules(spark, base):
    return evaluation.failures(_answers(spark, base)).select("case_id", F.array_join("failures", ",").alias("failures"), "passed")


def ag17_suite_passed(spark, base):
    done = evaluation.failures(_answers(spark, base))
    suites = table(spark, base, "eval_item").select(F.col("item_id").alias("case_id"), "suite", "lang")
    return done.join(suites, "case_id").groupBy("suite", "lang").agg(F.bool_and("passed").alias("all_passed"), F.count_if("passed").alias("n"))


def sc23_event_streams(spark, base):
    i = F.col("event_id")
    events = table(spark, base, "events").select(F.floor(i / 10).alias("stream"), F.col("event_id").alias("o"), F.when(i % 10 == 9, "done").when((i % 70 == 3), "error").otherwise("delta").alias("name"), F.col("props").alias("data"))
    parsed = evaluation.parsed_events(evaluation.streamed(events, "stream", "o"), "stream")
    return parsed.select("stream", F.col("seq").cast("bigint").alias("seq"), "name", "data")


def st11_complete_streams(spark, base):
    return evaluation.complete_streams(sc23_event_streams(spark, base), "stream")


def so9_random_pick(spark, base):
    """Two of each language, by a hash of the id and a seed: the same whatever the partitions are."""
    drawn = F.sha2(F.concat(F.lit("7:"), F.col("item_id").cast("string")), 256)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(drawn, "item_id"))
    return table(spark, base, "eval_item").withColumn("place", place).where("place <= 2").select("lang", "item_id")


def ud8_conversation_replay(spark, base):
    """Items as turns of conversations of six, with what each turn was asked."""
    i = F.col("item_id") - 1
    turns = _answers(spark, base).drop("error").join(evaluation.failures(_answers(spark, base)).withColumnRenamed("case_id", "id"), F.col("case_id") == F.col("id"))
    asked = table(spark, base, "eval_item").select(F.floor(i / 6).alias("case_id"), (i % 6).cast("int").alias("turn"), F.coalesce("question", F.lit("?")).alias("question"), "item_id")
    return evaluation.replayed_history(
        asked.join(turns.select(F.col("case_id").alias("item_id"), "answer", "failures"), "item_id").drop("item_id"), 6, 900, 250
    ).select("case_id", "turn", F.col("at").alias("said_at"), "role", F.sha2("text", 256).alias("h"))


def sk13_report(spark, base):
    return evaluation.report(evaluation.failures(_answers(spark, base))).select("passed", "cases", "failed", F.sha2("report", 256).alias("h"))


QUERIES = {f.__name__: f for f in (
    sc17_main_text, sc16_link_discovery, sc18_head_fields, sc19_sitemap_entries, sc20_robots, ag11_max_lastmod, pf15_path_dates, jn10_fetch_plan, jn11_merge_counters, ag12_missing_months,
    sf15_topic_rules, ag9_peak_summary, pf30_per_language, ag10_map_totals, sf31_eval_rules, ag17_suite_passed, sc23_event_streams, st11_complete_streams, so9_random_pick, ud8_conversation_replay, sk13_report,
)}

_ROB = "WITH p AS (SELECT load_no, regexp_extract(canonical_url, '^https?://[^/]+(/.*)$', 1) AS p FROM source_document)"
_EV = """a AS (SELECT item_id, suite, lang, min_citations, CASE WHEN item_id % 9 = 0 THEN '' WHEN item_id % 5 = 0 THEN '# Head' || chr(10) || 'E.G. nr. 5 ' || passage || ' [S1]' ELSE passage || ' [S' || (item_id % 4) || ']' END AS t, (item_id % 4) AS k FROM eval_item),
b AS (SELECT *, trim(coalesce(t, '')) AS a FROM a),
f AS (SELECT item_id AS case_id, suite, lang, array_to_string(list_filter([
  CASE WHEN a = '' THEN 'empty_answer' END, CASE WHEN item_id % 11 = 0 THEN 'missing_done_event' END, CASE WHEN item_id % 13 = 0 THEN 'stream_error' END, CASE WHEN k < min_citations THEN 'too_few_citations' END,
  CASE WHEN k > 2 THEN 'too_many_citations' END, CASE WHEN suite NOT IN ('smoke', 'questions') THEN 'expected_source_missing' END, CASE WHEN item_id % 3 = 0 AND suite <> 'smoke' THEN 'required_sources_missing' END,
  CASE WHEN item_id % 7 > 0 AND k > 0 AND NOT (contains(a, 'S1') OR (k > 1 AND contains(a, 'S2')) OR (k > 2 AND contains(a, 'S3'))) THEN 'citation_markers_missing_from_answer' END, CASE WHEN contains(lower(a), 'gjykata') THEN 'forbidden_phrase_present' END,
  CASE WHEN list_bool_or(list_transform(string_split(a, chr(10)), lambda l: regexp_matches(l, '^ {0,3}(#{1,6}( |$)|>( |$)|\\|.*\\| *$)') OR contains(l, '```') OR regexp_matches(l, '\\[[^\\]]+\\]\\('))) THEN 'unsupported_markdown_in_answer' END,
  CASE WHEN len(list_filter(regexp_extract_all(a, 'S\\d+\\]'), lambda m: NOT list_contains(['S1]', 'S2]', 'S3]'][:k], m))) > 0 THEN 'unknown_citation_marker' END,
  CASE WHEN len(list_filter(string_split_regex(regexp_replace(regexp_replace(trim(regexp_replace(a, '\\[S\\d+\\]', '', 'g')), '\\b([nN][rR]|[nN][oO])\\.(\\s*\\d)', '\\2', 'g'), '\\b([pP]\\.[sS][hH]|[eE]\\.[gG]|[iI]\\.[eE])\\.', '', 'g'), '[.!?]+(\\s+|$)'), lambda s: trim(s) <> '')) > 8 THEN 'too_many_sentences' END
  ], lambda x: x IS NOT NULL), ',') AS failures FROM b)"""

SQL = {
    "sc17_main_text": f"""SELECT load_no, document_id || ' & more' AS title, sha256(trim(regexp_replace(document_id || ' &' || chr(160) || 'more' || chr(10) || chr(10) || 'first' || chr(10) || chr(10) || 'second éé' || chr(10) || chr(10)
  || 'A passage that every page has, so that none is too short to count.' || chr(10) || chr(10) || coalesce(nullif({_lines_sql("text", "trim")}, '') || chr(10) || chr(10), '') || 'nononedeep', chr(10) || '{{3,}}', chr(10) || chr(10), 'g'), ' ')) AS h FROM source_document WHERE text IS NOT NULL""",
    "sc16_link_discovery": "SELECT load_no, regexp_extract(canonical_url, '^https?://[^/]+') || '/news/' || load_no || '/' AS link FROM source_document WHERE text IS NOT NULL",
    "sc18_head_fields": "SELECT load_no, 'og:title' AS field, document_id || ' & more' AS value FROM source_document WHERE text IS NOT NULL UNION ALL SELECT load_no, 'canonical', canonical_url FROM source_document WHERE text IS NOT NULL",
    "sc19_sitemap_entries": "SELECT source_id, canonical_url || '?a=1&b=2' AS link, strftime(max(CASE WHEN load_no % 4 > 0 THEN fetched_at END), '%Y-%m-%d') AS lastmod FROM source_document GROUP BY ALL",
    "sc20_robots": _ROB + """ SELECT load_no, CASE WHEN starts_with(p, '/news/00000001') THEN FALSE WHEN starts_with(p, '/pdf/0') THEN TRUE ELSE NOT contains(p, 'pdf') END AS own,
  CASE WHEN starts_with(p, '/map/') THEN regexp_matches(p, '^/map/.*-2$') ELSE TRUE END AS other FROM p""",
    "ag11_max_lastmod": "SELECT canonical_url AS url, max(CASE WHEN load_no % 3 > 0 THEN fetched_at END) AS lastmod FROM source_document GROUP BY 1",
    "pf15_path_dates": "SELECT load_no, CAST(fetched_at AS DATE) AS day FROM source_document WHERE load_no % 3 > 0 AND CAST(fetched_at AS DATE) >= DATE '2025-01-10'",
    "jn10_fetch_plan": """WITH d AS (SELECT document_id AS url, min(load_no) AS n, min(fetched_at) AS m FROM source_document GROUP BY 1)
SELECT url, m AS lastmod, CASE WHEN n % 4 = 0 AND m < TIMESTAMP '2025-01-17 06:00:00' THEN 'cached'
  WHEN n % 3 = 0 AND m + INTERVAL 2 HOUR <= TIMESTAMP '2025-01-20' AND m + INTERVAL 2 HOUR > TIMESTAMP '2025-01-19 06:00:00' THEN 'reusable' ELSE 'fetch' END AS action FROM d""",
    "jn11_merge_counters": """WITH s AS (SELECT document_id AS key, fetched_at >= TIMESTAMP '2025-01-12' AS late, max_by(revision, load_no) AS revision, list(DISTINCT canonical_url) AS l FROM source_document GROUP BY ALL),
o AS (SELECT * FROM s WHERE NOT late), f AS (SELECT * FROM s WHERE late)
SELECT coalesce(o.key, f.key) AS key, CASE WHEN f.key IS NULL THEN o.revision ELSE f.revision END AS revision, array_to_string(list_sort(list_distinct(list_concat(coalesce(o.l, []), coalesce(f.l, [])))), ',') AS aliases,
  CASE WHEN f.key IS NULL THEN 'kept' WHEN o.key IS NULL THEN 'new' WHEN o.revision IS NOT DISTINCT FROM f.revision THEN 'unchanged' ELSE 'updated' END AS state FROM o FULL JOIN f ON o.key = f.key""",
    "ag12_missing_months": """SELECT CAST(m AS DATE) AS month FROM generate_series(DATE '1990-01-01', DATE '2002-12-01', INTERVAL 1 MONTH) AS r(m)
WHERE CAST(m AS DATE) NOT IN (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) FROM orders)""",
    "sf15_topic_rules": """WITH h AS (SELECT doc_id, regexp_matches(lower(text), 'gjykat|court|tribunal|gericht') AS a, regexp_matches(lower(text), 'euro|fund|fond') AS b, regexp_matches(lower(text), 'protest|marsh') AS c FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(CASE WHEN a THEN 40 + 10 * (CAST(b AS INT) + CAST(c AS INT)) ELSE 0 END AS BIGINT) AS score, CASE WHEN a THEN concat_ws(',', 'court', CASE WHEN b THEN 'money' END, CASE WHEN c THEN 'protest' END) ELSE '' END AS topics FROM h""",
    "ag9_peak_summary": """WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL), v AS (SELECT event_type, day, CASE WHEN n % 5 > 0 THEN n END AS value FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC NULLS LAST, day) AS hi, row_number() OVER (PARTITION BY event_type ORDER BY value NULLS LAST, day) AS lo FROM v)
SELECT event_type, count(*) AS days, count(value) AS measured, max(CASE WHEN hi = 1 THEN day END) AS peak_day, max(value) AS peak, max(CASE WHEN lo = 1 THEN day END) AS low_day, min(value) AS low, min(day) AS first_day, max(day) AS last_day FROM r GROUP BY 1""",
    "pf30_per_language": """WITH e AS (SELECT item_id, CASE WHEN item_id % 6 > 0 THEN answer END AS sq, CASE WHEN item_id % 4 = 0 THEN passage END AS en FROM eval_item)
SELECT item_id, 'sq' AS lang, sq AS note FROM e WHERE sq IS NOT NULL OR en IS NULL UNION ALL SELECT item_id, 'en', en FROM e WHERE en IS NOT NULL OR sq IS NULL""",
    "ag10_map_totals": "SELECT r_name, count(DISTINCT n_nationkey) AS places, count(c_custkey) AS people, round(sum(c_acctbal), 2) AS total FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1",
    "sf31_eval_rules": f"WITH {_EV} SELECT case_id, failures, failures = '' AS passed FROM f",
    "so9_random_pick": "SELECT lang, item_id FROM (SELECT lang, item_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('7:' || item_id), item_id) AS n FROM eval_item) WHERE n <= 2",
    "sk13_report": f"""WITH {_EV} SELECT count(*) = 0 AS passed, (SELECT count(*) FROM f) AS cases, count(*) AS failed,
  sha256('{{"passed":' || (count(*) = 0) || ',"results":[' || string_agg('{{"id":' || case_id || ',"failures":["' || replace(failures, ',', '","') || '"]}}', ',' ORDER BY case_id) || ']}}') AS h FROM f WHERE failures <> ''""",
    "ud8_conversation_replay": f"""WITH {_EV},
q AS (SELECT (item_id - 1) // 6 AS case_id, (item_id - 1) % 6 AS turn, coalesce(question, '?')[:250] AS question, CASE WHEN NOT (list_contains(string_split(failures, ','), 'stream_error') OR list_contains(string_split(failures, ','), 'missing_done_event')) THEN nullif(t, '')[:250] END AS answer
  FROM b JOIN f ON f.case_id = b.item_id JOIN eval_item USING (item_id)),
s AS (SELECT case_id, turn AS said, 0 AS part, 'user' AS role, question AS x FROM q UNION ALL SELECT case_id, turn, 1, 'assistant', answer FROM q WHERE answer IS NOT NULL),
p AS (SELECT q.case_id, q.turn, s.said, s.role, s.x, sum(length(s.x)) OVER w AS n, row_number() OVER w AS r FROM q JOIN s ON s.case_id = q.case_id AND s.said < q.turn WINDOW w AS (PARTITION BY q.case_id, q.turn ORDER BY s.said DESC, s.part DESC ROWS UNBOUNDED PRECEDING))
SELECT case_id, CAST(turn AS INTEGER) AS turn, CAST(said AS INTEGER) AS said_at, role, sha256(x) AS h FROM p WHERE n <= 900 AND r <= 6""",
    "ag17_suite_passed": f"WITH {_EV} SELECT suite, lang, bool_and(failures = '') AS all_passed, count(*) FILTER (failures = '') AS n FROM f GROUP BY ALL",
    "sc23_event_streams": "SELECT event_id // 10 AS stream, row_number() OVER (PARTITION BY event_id // 10 ORDER BY event_id) - 1 AS seq, CASE WHEN event_id % 10 = 9 THEN 'done' WHEN event_id % 70 = 3 THEN 'error' ELSE 'delta' END AS name, props AS data FROM events",
    "st11_complete_streams": "SELECT event_id // 10 AS stream, bool_or(event_id % 10 <> 9 AND event_id % 70 <> 3) AND bool_or(event_id % 10 = 9) AND NOT bool_or(event_id % 10 <> 9 AND event_id % 70 = 3) AS complete FROM events GROUP BY 1",
}
