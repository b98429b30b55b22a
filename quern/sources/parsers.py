"""Parsers of structured sources: dossiers with relations, places with events, research and reference indexes, day series and
page snapshots. Each gives document rows

    (suffix, title, text, content_type, canonical_url, sticky_context, legal_status, metadata)

where suffix tells the documents of one file apart and metadata is JSON; null fields are the source's own. Labels that name a
source are parameters. What a file must have is checked, and a file that lacks it is an error, not a row less."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType, _parse_datatype_string

from quern.functions.dates import printed_figure, spelled_date
from quern.functions.text import STRIP, normalized, rewritten, stable_id
from quern.functions.urls import article_key, is_web, web_addresses
from quern.operators.ingest import with_relations
from quern.sources.tables import pandas_mapped

FIELDS = ["suffix", "title", "text", "content_type", "canonical_url", "sticky_context", "legal_status", "metadata"]
_RESEARCH = "day bigint, calendar_date string, sources array<struct<id string, outlet string, title string, url string, published_display string, event_date string, access string, summary string, reporting_lineage string>>"
_REFERENCES = (
    "schema_version string, articles array<struct<url string, aliases array<string>, title string, publisher_excerpt string, author string, section string, published_at string, modified_at string, "
    "captured_at string, topics array<string>, relevance_score bigint, content_use string, excerpt_kind string, policy_url string>>"
)
_PLACES = (
    "array<struct<id string, title string, city string, country string, latitude string, longitude string, type string, chapterActive boolean, protestCount string, "
    "protests array<struct<id string, title string, startDate string, endDate string, dayCount bigint, description string, location string, importance string, participants string, source string, sourceUrl string>>>>"
)


def _clean(name: str) -> Column:
    return F.coalesce(rewritten(F.col(name), STRIP), F.lit(""))


def _given(value: Column, otherwise: str = "Not specified") -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(otherwise))


def _refused(ok: Column, message: str, value: Column, kind: str = "string") -> Column:
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(F.raise_error(F.lit(message)).cast(kind))


def _document(suffix: Column, title: Column, text: Column, content_type: str, sticky: Column, metadata: Column, url: Column | None = None, status: Column | None = None) -> list[Column]:
    null = F.lit(None).cast("string")
    values = (suffix, title, normalized(text), F.lit(content_type), null if url is None else url, sticky, null if status is None else status, F.to_json(metadata))
    return [v.alias(f) for v, f in zip(values, FIELDS)]


def unknown_paths(text: str, schema: StructType | ArrayType) -> list[str]:
    """Places in a JSON text that a closed schema does not name, at any depth."""

    def walk(value, kind, path: str) -> Iterator[str]:
        if isinstance(kind, ArrayType) and isinstance(value, list):
            for x in value:
                yield from walk(x, kind.elementType, path + "[]")
        elif isinstance(kind, StructType) and isinstance(value, dict):
            known = {f.name: f.dataType for f in kind.fields}
            for k, v in value.items():
                if k not in known:
                    yield f"{path}.{k}"
                else:
                    yield from walk(v, known[k], f"{path}.{k}")

    return sorted(set(walk(json.loads(text), schema, "$")))


def closed_json(files: DataFrame, schema: str, value: str = "value", most_bytes: int = 16_000_000) -> DataFrame:
    """``files`` with (d): the value under a closed schema. Unknown keys at any depth, texts over ``most_bytes`` and what does
    not fit are errors."""
    kind = _parse_datatype_string(schema)

    @F.pandas_udf("string")
    def others(values: pd.Series) -> pd.Series:
        return values.map(lambda v: ", ".join(unknown_paths(v, kind)), na_action="ignore")

    text = _refused(F.octet_length(value) <= most_bytes, "the document is too large", F.col(value))
    bad = F.raise_error(F.concat(F.lit("unknown keys: "), F.col("__others"))).cast("string")
    told = files.withColumn("__text", text).withColumn("__others", others("__text"))
    return told.withColumn("d", F.from_json(F.when(F.col("__others") == "", F.col("__text")).otherwise(bad), kind, {"mode": "FAILFAST"})).drop("__text", "__others")


def dossier_documents(records: DataFrame, relations: DataFrame, order: str) -> DataFrame:
    """A document for each record with an id and a title; its relations, by dosje_id in the order of ``order``, are lines of
    it. Values are trimmed; parts without a value are left out, but for the description and the notes, which keep their
    heading. Records that repeat give their document again."""
    named = ["id", "titull", "kategori", "statusi", "viti_fillimit", "periudha", "permbledhje", "fraza_theksuar", "pershkrim", "kosto_eur", "kosto_tekst", "kosto_besueshmeria", "burimet", "eshte_pretendim_i_nxjerre", "shenime_editoriale"]
    related = ["lloji", "emri", "roli", "statusi", "shenim"]
    own = records.select(order, *(_clean(c).alias(c) for c in named)).where("id <> '' and titull <> ''")
    lines = F.concat_ws(" - ", *(F.nullif(_clean(c), F.lit("")) for c in related))
    joined = with_relations(own, relations.select(_clean("dosje_id").alias("__id"), F.col(order).alias("__n"), lines.alias("line")), "id", "__id", "__n", ["line"])
    c = {n: F.col(n) for n in named}
    status, urls = _given(c["statusi"], "Status not specified"), web_addresses(c["burimet"])
    sticky = F.concat_ws("\n", F.concat(F.lit("Dossier: "), c["titull"]), F.concat(F.lit("Category: "), c["kategori"]), F.concat(F.lit("Legal or institutional status: "), status),
                         F.lit("This record contains sourced public-interest claims; allegations are not final judgments."))
    optional = lambda label, value: F.when(value != "", F.concat(F.lit(label), value))
    text = F.concat_ws(
        "\n\n", sticky, F.concat(F.lit("Period: "), _given(F.coalesce(F.nullif(c["periudha"], F.lit("")), c["viti_fillimit"]))), optional("Summary: ", c["permbledhje"]),
        optional("Highlighted statement: ", c["fraza_theksuar"]), F.concat(F.lit("Description:\n"), c["pershkrim"]), F.concat(F.lit("Reported cost: "), _given(F.coalesce(F.nullif(c["kosto_tekst"], F.lit("")), c["kosto_eur"]))),
        F.concat(F.lit("Cost confidence: "), _given(c["kosto_besueshmeria"])), F.concat(F.lit("Editorial and current-status notes:\n"), c["shenime_editoriale"]),
        F.when(F.size("relations") > 0, F.concat(F.lit("Related people, institutions, places, and claims:\n"), F.array_join(F.transform("relations", lambda r: r["line"]), "\n"))),
        F.when(F.size(urls) > 0, F.concat(F.lit("Sources:\n"), F.array_join(urls, "\n"))),
    )
    claim = F.lower(c["eshte_pretendim_i_nxjerre"]).isin("true", "1", "yes")
    meta = F.struct(c["id"].alias("record_id"), c["kategori"].alias("category"), urls.alias("source_urls"), claim.alias("extracted_claim"), F.size("relations").alias("relation_count"))
    return joined.select(order, *_document(c["id"], c["titull"], text, "dossier", sticky, meta, status=status))


def place_documents(files: DataFrame, label: str, key: str = "path", value: str = "value") -> DataFrame:
    """From files that hold a JSON array of places with their events: a document for each place, each event, and the totals of
    each file. An empty array, a place without id, name or list and an event without id, title or start are errors."""
    places = files.select(key, F.from_json(value, _PLACES, {"mode": "FAILFAST"}).alias("p"))
    each = places.select(key, F.explode(F.when(F.size("p") > 0, F.col("p")).otherwise(F.raise_error(F.lit("a file of places is empty")).cast(_PLACES))).alias("p")).select(key, "p.*")
    name = F.coalesce(F.nullif(_clean("city"), F.lit("")), _clean("title"))
    place = each.withColumns({"__id": _refused((_clean("id") != "") & (name != "") & F.col("protests").isNotNull(), "a place lacks an id, a name or its list", _clean("id")), "__city": name, "__country": _clean("country")})
    where = F.concat_ws(", ", "__city", "__country")
    line = lambda text, value, end=".": F.concat(F.lit(text), value, F.lit(end))
    own = F.concat_ws(
        "\n", line(f"{label}: ", where), line("Map label: ", _given(F.col("title"), "not specified")), line("Map location type: ", _given(F.col("type"), "not specified")),
        line("Map coordinates: ", F.concat_ws(", ", F.coalesce("latitude", F.lit("None")), F.coalesce("longitude", F.lit("None")))), line("Local chapter active: ", F.when(F.col("chapterActive"), "yes").otherwise("no")),
        line("Protest records for this city: ", F.size("protests").cast("string")), line("Protest days for this city: ", _given(F.col("protestCount"), "not specified")),
    )
    cities = place.select(key, *_document(F.concat(F.lit("city:"), "__id"), F.concat(F.lit(f"{label} — "), where), own, "map-city", F.concat(F.lit(f"Source: {label}\nCity: "), where), F.struct(F.concat(F.lit("city:"), "__id").alias("record_id"), F.col("__id").alias("city_id"))))
    events = place.select(key, "__id", "__city", "__country", F.explode("protests").alias("e"))
    part = lambda f: F.coalesce(rewritten(F.col(f"e.{f}"), STRIP), F.lit(""))
    start = part("startDate")
    ident = _refused((part("id") != "") & (part("title") != "") & (start != ""), "an event lacks an id, a title or its start", part("id"))
    told = F.concat_ws(
        "\n", line("Protest: ", part("title")), line("City: ", where), line("Date: ", F.concat(start, F.when(part("endDate") != "", F.concat(F.lit(" through "), part("endDate"))).otherwise(""))),
        line("Protest days in this record: ", F.coalesce(F.col("e.dayCount").cast("string"), F.lit("not specified"))),
        *(F.when(part(f) != "", F.concat(F.lit(f"{says}: "), F.col(f"e.{f}"))) for f, says in (("location", "Meeting location"), ("description", "Description"), ("importance", "Map importance"), ("participants", "Reported participants"), ("source", "Map source"), ("sourceUrl", "Original source URL"))),
    )
    protests = events.withColumn("__event", ident).select(
        key, *_document(F.concat(F.lit("protest:"), "__event"), F.concat(part("title"), F.lit(" — "), F.col("__city"), F.lit(", "), start), told, "map-protest",
                        F.concat(F.lit(f"Source: {label}\nProtest: "), part("title"), F.lit("\nPlace: "), where, F.lit("\nDate: "), start),
                        F.struct(F.concat(F.lit("protest:"), "__event").alias("record_id"), F.col("__id").alias("city_id"), F.col("__event").alias("protest_id"))),
    )
    days = F.aggregate("protests", F.lit(0).cast("bigint"), lambda a, e: a + F.coalesce(e["dayCount"], F.lit(0)))
    totals = place.groupBy(key).agg(F.count("__id").alias("location_count"), F.count_distinct("__country").alias("country_count"), F.sum(F.size("protests")).alias("protest_record_count"), F.sum(days).alias("protest_day_count"))
    names = totals.columns[1:]
    summary = F.concat_ws("\n", F.lit(f"{label}: totals of the whole map."), *(F.concat(F.lit(n.replace("_", " ") + ": "), F.col(n).cast("string")) for n in names))
    overview = totals.select(key, *_document(F.lit("overview"), F.lit(f"{label}: totals"), summary, "map-overview", F.lit(f"Source: {label}\nTotals of the whole map"), F.struct(*names)))
    return cities.unionByName(protests).unionByName(overview)


def research_documents(files: DataFrame, label: str, key: str = "path", value: str = "value") -> DataFrame:
    """From JSON indexes of one day's reports (a closed schema, 2 MB at most): a document for each report but those on video
    hosts and those whose page was not read. A day below 1, a bad date, an empty list, an address that is no web address
    and a report without outlet or summary are errors."""
    d = closed_json(files.select(key, value), _RESEARCH, value, 2_000_000)
    whole = d.select(key, "d.day", "d.calendar_date", F.sha2(value, 256).alias("revision"), "d.sources")  # the digest once a file, not once a report
    ok = (F.col("day") >= 1) & F.try_to_date("calendar_date", "yyyy-MM-dd").isNotNull() & (F.size("sources") > 0)
    sources = "array<" + _RESEARCH.split("array<")[1]
    each = whole.select(key, "day", "calendar_date", "revision", F.explode(F.when(ok, F.col("sources")).otherwise(F.raise_error(F.lit("an index lacks its day, date or sources")).cast(sources))).alias("s"))
    one = lambda f: rewritten(F.regexp_replace(F.coalesce(F.col(f"s.{f}"), F.lit("")), r"\s+", " "), STRIP)
    host = F.lower(F.regexp_extract(one("url"), r"^[A-Za-z]+://([^/?#:]+)", 1))
    access = F.translate(F.lower(one("access")), "_-", "  ")
    read = access.rlike("(?:body|text|statement).{0,30}(?:opened|read)")
    evidence = F.when(read, F.when(F.contains(access, F.lit("indexed")), "indexed_body_read").otherwise("body_read")).when(~access.rlike("indexed only|snippet|excerpt|failed|search result"), "not_recorded")
    kept = each.where(~host.isin("youtube.com", "www.youtube.com", "youtu.be") & evidence.isNotNull())
    title = F.coalesce(F.nullif(one("title"), F.lit("")), one("outlet"))
    url = _refused(is_web(one("url")) & ~one("url").rlike("^[A-Za-z]+://[^/?#]*@") & (one("outlet") != "") & (one("summary") != ""), "a report lacks its address, outlet or summary", one("url"))
    text = F.concat_ws(
        "\n", F.lit(f"{label}: the author's summary of public reporting."), F.concat(F.lit("Publisher: "), one("outlet"), F.lit(". Article: "), title, F.lit(".")),
        F.concat(F.lit("Publication as recorded in research: "), _given(one("published_display"), "Not recorded"), F.lit(".")), F.when(one("event_date") != "", F.concat(F.lit("Reported event date: "), one("event_date"), F.lit("."))),
        one("summary"), F.when(one("reporting_lineage") != "", F.concat(F.lit("Reporting lineage: "), one("reporting_lineage"))),
    )
    meta = F.struct(F.lit("protest-research").alias("source_kind"), F.col("day").alias("protest_day"), F.col("calendar_date").alias("research_date"), one("event_date").alias("reported_event_date"), evidence.alias("evidence_access"), one("outlet").alias("publisher"), "revision")
    return kept.select(key, *_document(url, title, text, "research-summary", F.concat(F.lit(f"Source: {label}\nDocument: "), title), meta, url=url, status=F.lit("Research summary of public reporting, not independent corroboration.")))


def reference_documents(files: DataFrame, publisher: str, opinion_sections: tuple[str, ...], key: str = "path", value: str = "value") -> DataFrame:
    """From JSON indexes of article references (a closed schema): a document for each, with the publisher's short introduction
    only. Titles of 5 to 500 characters, introductions of 20 to 280 and one article an identity are demanded."""
    d = closed_json(files.select(key, value), _REFERENCES, value)
    each = d.select(key, F.explode("d.articles").alias("a")).select(key, "a.*").withColumn("article", article_key(F.col("url")))
    twice = each.groupBy(key, "article").agg(F.count(F.lit(1)).alias("__n"))
    ok = F.length("title").between(5, 500) & F.length("publisher_excerpt").between(20, 280) & is_web(F.col("url")) & (F.col("__n") == 1)
    known = each.join(twice, [key, "article"]).withColumn("url", _refused(ok, "a reference is malformed or stands twice", F.col("url")))
    text = F.concat(F.col("title"), F.lit("\n\nPublisher-provided short introduction:\n"), F.col("publisher_excerpt"), F.lit("\n\nAuthor/byline: "), F.coalesce("author", F.lit(publisher)), F.lit(". Section: "), _given(F.col("section")), F.lit("."))
    sticky = F.concat(F.lit(f"Publisher: {publisher}\nArticle: "), F.col("title"), F.lit("\nPublication timestamp: "), F.col("published_at"), F.lit("; not an established incident date."))
    genre = F.when(F.lower("section").isin(*opinion_sections), "opinion").otherwise("reporting")
    meta = F.struct(F.lit("article-reference").alias("source_kind"), F.lit("reference").alias("content_use"), "published_at", F.substring("published_at", 1, 10).alias("published_date"), "modified_at", "captured_at", "section", "topics", "relevance_score", "aliases", genre.alias("article_genre"))
    return known.select(key, *_document(F.col("article"), F.col("title"), text, "article-reference", sticky, meta, url=F.col("url"), status=F.lit("Publisher-provided article reference, not independently verified findings.")))


def series_documents(files: DataFrame, label: str, key: str = "path", value: str = "value") -> DataFrame:
    """From program sources with the exported arrays ``participation`` (day, date, peak, mean, median, note) and
    ``participationEvents`` (day, tier, label): the index day by day with its peak and low, the events, and a document for
    each day and language with a note; a day without any has one in both languages. A day without number or date and a
    series without days are errors. Of equal figures the earlier day is the peak or low."""
    names = ["day", "date", "peak", "mean", "median", "sq", "en", "saturday"]

    def days(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from quern.sources.literals import field, objects

        for f in frames:
            rows = []
            for k, source in zip(f[key], f[value]):
                found = objects(source, "participation")
                if not found or any(field(o, "day") is None or not field(o, "date") for o in found):
                    raise ValueError("a series is empty, or a day lacks its number or date")
                rows += [(k, n, int(field(o, "day")), *(o.get(c) for c in names[1:5]), field(o, "note.sq"), field(o, "note.en"), bool(field(o, "saturday"))) for n, o in enumerate(found)]
            yield pd.DataFrame(rows, columns=[key, "n", *names]).astype({c: "float64" for c in names[2:5]})

    def events(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from quern.sources.literals import field, objects

        for f in frames:
            rows = []
            for k, source in zip(f[key], f[value]):
                try:
                    found = objects(source, "participationEvents")
                except ValueError:
                    found = []
                said = lambda o, part: " / ".join(filter(None, (field(o, f"{part}.sq"), field(o, f"{part}.en"))))
                rows += [(k, n, ". ".join(filter(None, (f"Day {int(field(o, 'day'))} ({field(o, 'tier') or 'event'})", said(o, "label"), said(o, "sub")))) + ".") for n, o in enumerate(found) if field(o, "day") is not None]
            yield pd.DataFrame(rows, columns=[key, "n", "line"])

    given = files.select(key, value).where(F.col(value).isNotNull())
    day = pandas_mapped(given, days, f"{key} string, n int, day int, date string, peak double, mean double, median double, sq string, en string, saturday boolean")
    figures = F.concat(F.lit("peak "), printed_figure(F.col("peak")), F.lit(", mean "), printed_figure(F.col("mean")), F.lit(", median "), printed_figure(F.col("median")))
    heading = F.concat(F.lit("Day "), F.col("day").cast("string"), F.lit(", "), spelled_date(F.to_date("date")), F.when(F.col("saturday"), ", e shtunë / Saturday").otherwise(""))
    day = day.withColumns({"figures": figures, "heading": heading})
    known = F.col("peak").isNotNull()
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.concat("heading", F.lit(": "), "figures", F.lit(".")).alias("l")))), lambda x: x["l"]), "\n\n")
    index = day.groupBy(key).agg(
        F.count(F.lit(1)).alias("day_count"), F.count("peak").alias("measured_day_count"), F.max(F.when(known, F.struct("peak", (-F.col("n")).alias("n"), "day", "date"))).alias("hi"),
        F.min(F.when(known, F.struct("peak", "n", "day", "date"))).alias("lo"), F.min(F.when(known, F.struct("n", "date")))["date"].alias("first_date"), F.max(F.when(known, F.struct("n", "date")))["date"].alias("last_date"), lines.alias("lines"),
    )
    at = lambda x: F.concat(F.lit("day "), F.col(f"{x}.day").cast("string"), F.lit(" ("), F.col(f"{x}.date"), F.lit(") at "), printed_figure(F.col(f"{x}.peak")))
    summary = F.concat(
        F.col("day_count").cast("string"), F.lit(" protest days recorded, from "), F.col("first_date"), F.lit(" to "), F.col("last_date"), F.lit(", with "), F.col("measured_day_count").cast("string"),
        F.lit(" of them carrying a published figure. The index is highest on "), at("hi"), F.lit(" and lowest on "), at("lo"), F.lit("."),
    )
    shared = F.struct("day_count", "measured_day_count", "first_date", "last_date", F.lit("index").alias("section"))
    status = F.lit("Estimated participation index from a crowd-counting model, not an official count")
    whole = index.select(key, *_document(F.lit("index"), F.lit(f"{label}: index day by day"), F.concat_ws("\n\n", summary, "lines"), "participation-index", F.lit(f"Source: {label}"), shared, status=status))
    told = pandas_mapped(given, events, f"{key} string, n int, line string").groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n\n").alias("t"))
    moments = told.select(key, *_document(F.lit("events"), F.lit(f"{label}: events"), F.col("t"), "participation-index", F.lit(f"Source: {label}"), F.struct(F.lit("events").alias("section")), status=status))
    notes = F.explode(F.array(*(F.struct(F.lit(c).alias("lang"), F.nullif(F.col(c), F.lit("")).alias("note")) for c in ("sq", "en")))).alias("x")
    by_language = day.select("*", notes, F.coalesce(F.nullif("sq", F.lit("")), F.nullif("en", F.lit(""))).isNull().alias("__none")).select("*", "x.lang", "x.note").where(F.col("note").isNotNull() | F.col("__none"))
    title = F.concat(F.lit(f"{label} — Dita "), F.col("day").cast("string"), F.lit(" / Day "), F.col("day").cast("string"), F.lit(", "), F.col("date"))
    text = F.concat_ws("\n\n", F.concat("heading", F.lit(".")), "note", F.concat(F.lit("Estimated participation index (not a number of people): "), "figures", F.lit(".")))
    meta = F.struct(F.concat(F.lit("day-"), F.col("day").cast("string")).alias("record_id"), F.lit("day").alias("section"), F.col("day").alias("protest_day"), F.col("date").alias("event_date"), F.lit("protest-day").alias("source_kind"), F.col("lang").alias("language"))
    daily = by_language.select(key, *_document(F.concat(F.lit("day-"), F.col("day").cast("string"), F.lit("-"), F.col("lang")), title, text, "protest-day", F.concat(F.lit(f"Source: {label}\nDocument: "), title), meta, status=status))
    return whole.unionByName(moments).unionByName(daily)


def snapshot_documents(told: DataFrame) -> DataFrame:
    """Documents of page snapshots from (relative_path, text, meta), meta being their front matter as JSON: a valid
    canonical_url and a source_label are demanded; the date of the snapshot stands in the sticky context."""
    get = lambda f: rewritten(F.coalesce(F.get_json_object("meta", f"$.{f}"), F.lit("")), STRIP)
    url = _refused(is_web(get("canonical_url")) & (get("source_label") != ""), "a snapshot lacks its canonical_url or source_label", get("canonical_url"))
    dated = F.when(get("snapshot_date") != "", F.concat(F.lit("Snapshot date: "), get("snapshot_date"), F.lit(". Check the linked site for current status.")))
    sticky = F.concat_ws("\n", F.concat(F.lit("Source: "), get("source_label")), F.concat(F.lit("Document: "), get("title")), dated)
    meta = F.from_json("meta", "map<string,string>")
    return told.select("relative_path", *_document(stable_id(F.col("relative_path")), get("title"), F.col("text"), "markdown", sticky, meta, url=url))
