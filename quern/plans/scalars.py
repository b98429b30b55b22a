"""Queries of the scalar functions over the text tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import dates, text, urls
from quern.functions.text import MARKERS, PLAIN, TIDY_PAGE, rewritten
from quern.sources.tables import table


def _docs(spark, base):
    return table(spark, base, "documents")


def sf1_normalize_text_hash(spark, base):
    clean = text.normalized(F.col("text"))
    return _docs(spark, base).select("doc_id", F.length(clean).cast("bigint").alias("n"), F.sha2(clean, 256).alias("content_hash"), text.stable_id(F.col("source"), F.col("doc_id").cast("string"), F.lit("")).alias("document_id"))


def sf2_tidy_page_text(spark, base):
    return _docs(spark, base).select("doc_id", F.sha2(rewritten(F.col("text"), TIDY_PAGE), 256).alias("h"))


def ag14_token_estimate(spark, base):
    return _docs(spark, base).select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


def sf12_sentence_stats(spark, base):
    sizes = _docs(spark, base).where("text is not null").select("doc_id", F.transform(text.sentences(F.col("text")), F.length).alias("s"))
    return sizes.select("doc_id", F.size("s").cast("bigint").alias("n"), F.array_max("s").cast("bigint").alias("longest"))


def sf13_paragraph_stats(spark, base):
    sizes = _docs(spark, base).where("text is not null").select("doc_id", F.transform(text.paragraphs(F.col("text")), F.octet_length).alias("s"))
    return sizes.select("doc_id", F.size("s").cast("bigint").alias("n"), F.array_max("s").cast("bigint").alias("longest"))


def sf10_strip_markdown(spark, base):
    return _docs(spark, base).select("doc_id", F.sha2(text.normalized(text.unescaped(rewritten(F.col("text"), PLAIN))), 256).alias("h"))


def sf9_clean_markup(spark, base):
    return _docs(spark, base).select("doc_id", F.sha2(text.clean_markup(F.col("text")), 256).alias("h"))


def sf8_fold_text(spark, base):
    return table(spark, base, "eval_item").select("item_id", F.sha2(text.folded(F.col("passage")), 256).alias("h"))


def sf11_strip_markers(spark, base):
    cited = F.concat(F.col("question"), F.lit(" [S1] [S22]  fund"))
    return table(spark, base, "eval_item").select("item_id", rewritten(cited, MARKERS).alias("plain"))


def sf32_sf18_genre_text(spark, base):
    """A document's genre by its type, and its title and text as one searchable text without what is empty."""
    genre = F.when(F.lower("content_type").isin("question-answer", "transcript"), "opinion").otherwise("reporting")
    return _docs(spark, base).select("doc_id", genre.alias("genre"), F.sha2(text.joined_text(F.col("title"), F.col("text")), 256).alias("h"))


def sf14_excerpt(spark, base):
    return _docs(spark, base).select("doc_id", text.excerpt(F.col("text")).alias("excerpt"))


def sf21_title_from_text(spark, base):
    return _docs(spark, base).where(F.col("text").isNotNull()).select("doc_id", text.first_title(F.col("text"), F.col("source")).alias("title"))


def sf22_source_urls(spark, base):
    found = urls.web_addresses(F.col("burimet"))
    return table(spark, base, "dosje").select("rec_no", F.posexplode(found).alias("p", "url")).select("rec_no", F.col("p").cast("bigint").alias("p"), "url")


def pf19_url_one_form(spark, base):
    return table(spark, base, "source_document").select("load_no", urls.one_form(F.concat("canonical_url", F.lit("?utm=1#x")), r"[a-z0-9.-]+\.example").alias("url"))


def sf16_article_key(spark, base):
    numbered = F.when(F.col("load_no") % 2 == 0, F.concat(F.regexp_replace("canonical_url", "/$", ""), F.lit("-i"), F.col("load_no").cast("string"))).otherwise(F.col("canonical_url"))
    return table(spark, base, "source_document").select("load_no", urls.article_key(numbered).alias("k"))


def sf20_spelled_date(spark, base):
    day = F.to_date("published_at")
    return _docs(spark, base).select("doc_id", dates.spelled_date(day).alias("spelled"), dates.printed_figure(F.col("n_chars") / 8).alias("figure"))


def sf23_instant(spark, base):
    stamped = F.concat(F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("doc_id") % 3 == 0, "Z").when(F.col("doc_id") % 3 == 1, "+02:00").otherwise(""))
    return _docs(spark, base).select("doc_id", F.unix_seconds(dates.instant(stamped)).alias("epoch"))


def sf24_client_key(spark, base):
    return table(spark, base, "events").select("event_id", F.substring(F.sha2(F.concat(F.lit("salt:"), F.sha2(F.col("user_id").cast("string"), 256)), 256), 1, 16).alias("client"))


def sf26_language_of_question(spark, base):
    return table(spark, base, "eval_item").where(F.col("question").isNotNull()).select("item_id", text.said_in_albanian(F.col("question")).alias("albanian"))


def sf27_hash_embedding(spark, base):
    vector = text.hash_embedding(F.col("passage"))
    return table(spark, base, "eval_item").where(F.col("passage").isNotNull()).select("item_id", F.posexplode(vector).alias("p", "v")).select("item_id", F.col("p").cast("bigint").alias("p"), F.round("v", 6).alias("v"))


def pf8_prefix_range(spark, base):
    return table(spark, base, "source_document").where(urls.within_prefix(F.col("title"), "Open")).select("load_no", "title")


def pf23_client_address(spark, base):
    hops = F.concat_ws(", ", F.lit("10.0.0.1"), F.col("user_id").cast("string"), F.lit("192.0.2.9"))
    header = F.when(F.col("event_id") % 4 == 0, F.lit(" , ")).otherwise(hops)
    return table(spark, base, "events").select("event_id", urls.client_address(header, F.lit("peer"), 1).alias("address"))


QUERIES = {f.__name__: f for f in (
    sf1_normalize_text_hash, sf2_tidy_page_text, ag14_token_estimate, sf12_sentence_stats, sf13_paragraph_stats, sf10_strip_markdown, sf9_clean_markup, sf8_fold_text, sf32_sf18_genre_text,
    sf11_strip_markers, sf14_excerpt, sf21_title_from_text, sf22_source_urls, pf19_url_one_form, sf16_article_key, sf20_spelled_date, sf23_instant, sf24_client_key,
    sf26_language_of_question, sf27_hash_embedding, pf8_prefix_range, pf23_client_address,
)}

# The SQL is written from what the operations are defined to do, line by line, and shares no pattern with the operators.
_BLANKS = " || ".join(f"chr({c})" for c in (*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288))
_BREAKS = r"[\r\n\x0B\x0C\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"
_W = r"[\s\x0B\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _lines_sql(expr: str, trim: str) -> str:
    """Lines of a text with blanks and tabs run together and trimmed, and empty lines but for one, as one text."""
    lines = f"list_transform(string_split_regex({expr}, '{_BREAKS}'), lambda x: {trim}(regexp_replace(x, '[ \t]+', ' ', 'g'), {_BLANKS}))"
    return f"trim(regexp_replace(array_to_string({lines}, chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), {_BLANKS})"


def _normal_sql(expr: str) -> str:
    return _lines_sql(f"replace(replace({expr}, chr(13) || chr(10), chr(10)), chr(65279), '')", "rtrim")


def _words_sql(expr: str) -> str:
    return f"array_to_string(list_filter(string_split_regex({expr}, '{_W}+'), lambda x: x <> ''), ' ')"


def _without(expr: str, *patterns: tuple[str, str]) -> str:
    for pattern, instead in patterns:
        expr = f"regexp_replace({expr}, '{pattern}', '{instead}', 'g')"
    return expr


_AMP = "replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
_N = _normal_sql("text")
_S = f"list_filter(list_transform(string_split(regexp_replace(text, '([.!?]){_W}+([A-ZÇË0-9])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: trim(s, {_BLANKS})), lambda s: s <> '')"
_P = f"list_filter(list_transform(string_split_regex(text, '\n{_W}*\n'), lambda s: trim(s, {_BLANKS})), lambda s: s <> '')"
_FIT = f"list_filter(list_transform(string_split_regex(replace(text, chr(13) || chr(10), chr(10)), '{_BREAKS}'), lambda s: trim(ltrim(trim(s, {_BLANKS}), '#'), {_BLANKS})), lambda s: length(s) BETWEEN 3 AND 140)"
_BARE = _without(
    "text", (r"!\[[^\]]*\]\([^)]+\)", ""), (r"\[([^\]]+)\]\((https?://[^)]+)\)", r"\1 (\2)"), (r"(?m)^\s{0,3}#{1,6}\s*", ""), ("[*_~]{1,3}", ""), (r"(?m)^\s*>\s?", ""),
    ("(?s)```.*?```", ""), (r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>", ""), ("(?s)<!--.*?-->", ""), ("<[^>]+>", " "),
)
_MONTH = lambda names: "list_extract([" + ", ".join(f"'{n}'" for n in names) + "], month(published_at))"
_SPELL = lambda names: f"day(published_at) || ' ' || {_MONTH(names)} || ' ' || year(published_at)"
_PATH = r"regexp_extract(u, '^https?://[^/]*(/[^?#]*)', 1)"
_COMMON = "['diaspora', 'shqipëri', 'revolucioni', 'nga', 'dhe', 'për', 'është', 'çfarë']"

SQL = {
    "sf1_normalize_text_hash": f"SELECT doc_id, length({_N}) AS n, sha256({_N}) AS content_hash, sha256(concat_ws(chr(0), source, CAST(doc_id AS VARCHAR), ''))[:32] AS document_id FROM documents",
    "sf2_tidy_page_text": f"SELECT doc_id, sha256({_lines_sql("replace(text, chr(13) || chr(10), chr(10))", "trim")}) AS h FROM documents",
    "ag14_token_estimate": "SELECT doc_id, CAST(CASE WHEN text = '' THEN 0 WHEN text IS NOT NULL THEN greatest(1, ceil(strlen(text) / 3.4::DOUBLE)) END AS BIGINT) AS tokens FROM documents",
    "sf12_sentence_stats": f"SELECT doc_id, len({_S}) AS n, list_max(list_transform({_S}, lambda s: length(s))) AS longest FROM documents WHERE text IS NOT NULL",
    "sf13_paragraph_stats": f"SELECT doc_id, len({_P}) AS n, list_max(list_transform({_P}, lambda s: strlen(s))) AS longest FROM documents WHERE text IS NOT NULL",
    "sf10_strip_markdown": f"SELECT doc_id, sha256({_normal_sql(_AMP.format(_BARE))}) AS h FROM documents",
    "sf9_clean_markup": f"SELECT doc_id, sha256({_words_sql(_without(_AMP.format('text'), ('<[^>]*>', ' ')))}) AS h FROM documents",
    "sf8_fold_text": f"SELECT item_id, sha256({_words_sql('strip_accents(lower(passage))')}) AS h FROM eval_item",
    "sf11_strip_markers": f"SELECT item_id, {_words_sql('question')} || ' fund' AS plain FROM eval_item",
    "sf32_sf18_genre_text": "SELECT doc_id, CASE WHEN lower(content_type) IN ('question-answer', 'transcript') THEN 'opinion' ELSE 'reporting' END AS genre, sha256(concat_ws(chr(10) || chr(10), nullif(trim(title, ' '), ''), nullif(text, ''))) AS h FROM documents",
    "sf14_excerpt": "SELECT doc_id, CASE WHEN length(text) <= 280 THEN text ELSE regexp_replace(text[:279], ' [^ ]*$', '') || '…' END AS excerpt FROM documents",
    "sf21_title_from_text": f"SELECT doc_id, coalesce({_FIT}[1], array_to_string(list_transform(string_split(translate(source, '-_', '  '), ' '), lambda w: upper(w[:1]) || lower(w[2:])), ' ')) AS title FROM documents WHERE text IS NOT NULL",
    "sf22_source_urls": f"""WITH s AS (SELECT rec_no, list_transform(string_split_regex(burimet, '[\\n,;]+'), lambda x: trim(x, {_BLANKS})) AS l FROM dosje),
        f AS (SELECT rec_no, list_filter(l, lambda x, i: regexp_matches(x, '^(?i:https?)://[^/?#\\s]+') AND list_position(l, x) = i) AS l FROM s)
        SELECT rec_no, CAST(i - 1 AS BIGINT) AS p, l[i] AS url FROM f, unnest(range(1, len(l) + 1)) AS r(i)""",
    "pf19_url_one_form": r"""SELECT load_no, 'https://' || regexp_replace(regexp_extract(canonical_url, '^https://([^/?#]*)', 1), '^www\.', '') || coalesce(nullif(regexp_replace(regexp_extract(canonical_url, '^https://[^/?#]*([^?#]*)', 1), '/+$', ''), ''), '/') AS url FROM source_document""",
    "sf16_article_key": rf"""WITH t AS (SELECT load_no, CASE WHEN load_no % 2 = 0 THEN regexp_replace(canonical_url, '/$', '') || '-i' || load_no ELSE canonical_url END AS u FROM source_document)
        SELECT load_no, CASE WHEN regexp_matches({_PATH}, '-i\d+$') THEN regexp_extract({_PATH}, '-i(\d+)$', 1) ELSE 'legacy-' || sha256({_PATH})[:24] END AS k FROM t""",
    "sf20_spelled_date": f"SELECT doc_id, strftime(published_at, '%Y-%m-%d') || ' (' || {_SPELL(dates.ALBANIAN_MONTHS)} || ' / ' || {_SPELL(dates.ENGLISH_MONTHS)} || ')' AS spelled, coalesce(regexp_replace(format('{{:.2f}}', n_chars / 8), '\\.?0+$', ''), 'not published') AS figure FROM documents",
    "sf23_instant": "SELECT doc_id, CAST(CASE doc_id % 3 WHEN 0 THEN epoch(published_at) WHEN 1 THEN epoch(published_at) - 7200 END AS BIGINT) AS epoch FROM documents",
    "sf24_client_key": "SELECT event_id, sha256('salt:' || sha256(CAST(user_id AS VARCHAR)))[:16] AS client FROM events",
    "sf26_language_of_question": f"SELECT item_id, regexp_matches(lower(question), '[çë]') OR list_has_any(list_transform(string_split_regex(question, '{_W}+'), lambda w: lower(trim(w, '.,!?;:()[]\"'''))), {_COMMON}) AS albanian FROM eval_item WHERE question IS NOT NULL",
    "sf27_hash_embedding": f"""WITH w AS (SELECT item_id, list_filter(string_split_regex(lower(passage), '{_W}+'), lambda x: x <> '') AS l FROM eval_item WHERE passage IS NOT NULL),
        b AS (SELECT item_id, list_transform(l, lambda x: CAST('0x' || sha256(x)[:2] AS INTEGER) % 8) AS l FROM w),
        c AS (SELECT item_id, p, CAST(len(list_filter(l, lambda x: x = p)) AS DOUBLE) AS n FROM b, range(8) AS r(p))
        SELECT item_id, p, round(CASE WHEN sum(n * n) OVER (PARTITION BY item_id) > 0 THEN n / sqrt(sum(n * n) OVER (PARTITION BY item_id)) ELSE 0 END, 6) AS v FROM c""",
    "pf8_prefix_range": "SELECT load_no, title FROM source_document WHERE title >= 'Open' AND title < 'Open' || chr(63743)",
    "pf23_client_address": "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'peer' ELSE CAST(user_id AS VARCHAR) END AS address FROM events",
}
