"""Files, literals, pages and publication on small made inputs."""

import hashlib
import json

import duckdb
import pytest
from pyspark.sql import functions as F

from quern.plans import parsing
from quern.sources import files, literals, markup, parsers
from quern.sources.publication import PublicationError, Store

SCRIPT = """// a header
/* "not this one either at all" */
export const days: Day[] = [
  { day: 1, date: "2025-01-01", peak: 3.5, note: { sq: "ditë e parë" } }, // "nor this comment at all"
  { day: 2, date: '2025-01-02', peak: null, open: true },
];
const a = "A sentence with \\"quotes\\" and a } bracket";
const b = `Template text with ${slot} inside it`;
const again = "A sentence with \\"quotes\\" and a } bracket";
const path = "/images/some long name with blanks.png"; const short = "too short";
"""


def test_literals(spark):
    assert literals.prose(SCRIPT) == ['A sentence with "quotes" and a } bracket', "Template text with inside it"]
    assert [literals.field(o, "day") for o in literals.objects(SCRIPT, "days")] == [1.0, 2.0]
    with pytest.raises(ValueError):
        literals.objects("export const x = [ { a: 1 ", "x")
    df = spark.createDataFrame([("f", SCRIPT), ("g", None)], "path string, value string")
    rows = literals.series(df.where("path = 'f'"), "days", ["date", "sq"], ["day", "peak"]).orderBy("pos").collect()
    assert [(r["date"], r["sq"], r["peak"]) for r in rows] == [("2025-01-01", "ditë e parë", 3.5), ("2025-01-02", None, None)]
    assert literals.literal_texts(df).count() == 1


def test_csv_and_json(spark, tmp_path):
    (tmp_path / "d.csv").write_text('\ufeffid,titull,burimet\na1," x, y ","https://a.example\nhttps://b.example"\na2,,"say ""hi"""\n', encoding="utf-8")
    got = files.read_csv(spark, str(tmp_path / "d.csv"), ["id", "titull", "burimet"]).collect()
    assert [tuple(r) for r in got] == [("a1", "x, y", "https://a.example\nhttps://b.example"), ("a2", "", 'say "hi"')]
    (tmp_path / "i.json").write_text(json.dumps({"day": 3, "sources": [{"id": "s", "url": "u"}]}))
    schema = "day int, sources array<struct<id string, url string>>"
    assert files.read_json_closed(spark, str(tmp_path / "i.json"), schema).select(F.inline("sources")).collect() == [("s", "u")]
    for bad in ({"day": 3, "other": 1}, {"day": "x"}):
        (tmp_path / "i.json").write_text(json.dumps(bad))
        with pytest.raises(Exception):
            files.read_json_closed(spark, str(tmp_path / "i.json"), schema).collect()
    (tmp_path / "i.json").write_text(json.dumps({"day": 3}))
    with pytest.raises(Exception):
        files.read_json_closed(spark, str(tmp_path / "i.json"), schema, most_bytes=3).collect()


def test_documents(spark, tmp_path):
    root = tmp_path / "site"
    (root / "posts" / "old").mkdir(parents=True)
    body = "\n# A heading\n\nText with a [link](https://x.example/a) and **bold** words, long enough.\n<script>var secret = 1</script><!-- hidden -->"
    (root / "posts" / "one.md").write_text("---\ntitle: First\ndraft: false\n---\n" + body)
    (root / "posts" / "two.md").write_text("---\ntitle: Second\ndraft: true\n---\n" + body)
    (root / "posts" / "old" / "three.md").write_text(body)
    (root / "posts" / "tiny.md").write_text("tiny")
    (root / "code.ts").write_text(SCRIPT)
    catalog = tmp_path / "c.yaml"
    catalog.write_text("sources:\n- id: s\n  label: S\n  base_url: https://s.example\n  language: sq\n  rules:\n  - include: ['posts/**/*.md']\n    exclude: ['posts/old/*']\n    parser: markdown\n")
    source = files.read_catalog(str(catalog))[0]
    rules = files.catalog_rules(spark, [source])
    assert files.resolved(rules, spark.createDataFrame([("s", str(root))], "source_id string, root string")).count() == 1
    with pytest.raises(Exception):
        files.resolved(rules, spark.createDataFrame([], "source_id string, root string")).collect()
    every = files.read_files(spark, str(root))
    docs, issues = files.documents(source, source.rules[0], every)
    (got,) = docs.collect()
    assert got["title"] == "First" and got["text"].startswith("A heading\n\nText with a link (https://x.example/a) and bold words") and "secret" not in got["text"] and "hidden" not in got["text"]
    assert got["relative_path"] == "posts/one.md" and len(got["document_id"]) == 32 and got["canonical_url"] == "https://s.example/"
    assert [r["relative_path"] for r in issues.collect()] == ["posts/tiny.md"]
    code, _ = files.documents(source, files.Rule(("*.ts",), "string_literals"), every)
    assert code.count() == 1
    with pytest.raises(ValueError):
        files.parser("unknown")


def test_pages():
    page = "<html><body><main><nav><p>menu</p></nav><h1>The  title</h1><p>" + "word " * 30 + "</p><br>end &amp; more<button>x</button></main>after</body></html>"
    title, text = markup.main_text(page)
    assert title == "The title" and text.startswith("The title\n\nword") and text.endswith("end & more") and "menu" not in text and "after" not in text
    assert markup.main_text("<main>short</main>") is None and markup.main_text(page, css_class="none") is None
    broken = "<x:urlset xmlns:x='u'><x:url><x:loc>https://a.example/1</x:loc><PageMap>a & b</PageMap></x:url></x:urlset>"
    assert markup.sitemap_entries(broken) == [("https://a.example/1", None)]
    for bad in ("<!DOCTYPE a><urlset/>", "<urlset><url></url></urlset>", "<sitemapindex/>"):
        with pytest.raises(ValueError):
            markup.sitemap_entries(bad)
    assert markup.robots_rules("User-agent: *\nDisallow:\n", "q") == [(0, True, "^")]


def test_robots():
    text = "User-agent: *\nDisallow: /\nContent-Signal: search=yes, use=full\n\nUser-Agent: quern\nuser-agent: other\nCrawl-delay: 2\nRequest-rate: 1/5s # slow\nAllow: /a*b$\nContent-Signal: use=reference\n"
    own = markup.robots(text, "Quern/1.0")
    assert own.rules == ((3, True, "^/a.*b$"),) and own.delay == 5 and own.signals == {"search": "yes", "use": "reference"} and own.may_index
    assert markup.robots(text, "third").rules == ((1, False, "^/"),)
    assert not markup.robots("User-agent: *\nContent-Signal: search=no, search=yes", "q").may_index
    for bad in ("Crawl-delay: 61", "Request-rate: 0/5", "Content-Signal: use=never"):
        with pytest.raises(ValueError):
            markup.robots(f"User-agent: *\n{bad}\n", "q")


def test_parsers_refuse_what_is_not_whole(spark):
    def made(parse, value):
        return parse(spark.createDataFrame([("f", json.dumps(value) if not isinstance(value, str) else value)], "path string, value string")).collect()

    research = lambda df: parsers.research_documents(df, "R")
    source = {"outlet": "O", "url": "https://o.example/1", "summary": "s", "access": "body read"}
    good = {"day": 3, "calendar_date": "2025-06-01", "sources": [source, source | {"url": "https://youtu.be/x"}, source | {"access": "snippet"}]}
    assert [r["canonical_url"] for r in made(research, good)] == ["https://o.example/1"]
    for bad in (good | {"day": 0}, good | {"sources": []}, good | {"calendar_date": "2025-13-01"}, good | {"extra": 1}, good | {"sources": [source | {"inner": 1}]}, good | {"sources": [source | {"url": "ftp://x"}]}, good | {"sources": [source | {"summary": ""}]}):
        with pytest.raises(Exception):
            made(research, bad)
    places = lambda df: parsers.place_documents(df, "Map")
    place = {"id": "p", "city": "C", "country": "X", "protests": [{"id": "e", "title": "T", "startDate": "2025-06-01"}]}
    assert sorted(r["suffix"] for r in made(places, [place])) == ["city:p", "overview", "protest:e"]
    for bad in ([], [place | {"id": " "}], [{"id": "p", "city": "C"}], [place | {"protests": [{"id": "e", "title": "T"}]}]):
        with pytest.raises(Exception):
            made(places, bad)
    with pytest.raises(Exception):
        made(lambda df: parsers.series_documents(df, "S"), "export const participation = [];")
    told = spark.createDataFrame([("a.md", "text", '{"title": "t", "canonical_url": "https://a.example/", "source_label": "A", "snapshot_date": "2025-06-01"}'), ("b.md", "text", '{"title": "t"}')], "relative_path string, text string, meta string")
    (got,) = parsers.snapshot_documents(told.where("relative_path = 'a.md'")).collect()
    assert got["canonical_url"] == "https://a.example/" and "2025-06-01" in got["sticky_context"]
    with pytest.raises(Exception):
        parsers.snapshot_documents(told).collect()


def test_research_of_a_source_beyond_one_index(spark, tmp_path):
    n = F.col("id")
    label = F.when(n % 50 == 0, " Small  one ").when(n % 50 == 1, " ").otherwise("Large")
    text = F.when(n % 50 != 2, F.repeat(F.lit("ë"), 400))
    docs = spark.range(8_000, 14_000).select(n.alias("load_no"), F.when(n % 50 == 0, "small").otherwise("large").alias("source_id"), label.alias("source_label"), F.concat(F.lit("https://o.example/"), n).alias("canonical_url"), F.concat(F.lit("  Title "), n).alias("title"), text.alias("text"), F.lit("2025-06-01 10:00:00").cast("timestamp_ntz").alias("fetched_at"))
    docs.write.parquet(str(tmp_path / "source_document.parquet"))
    got = [tuple(r) for r in parsing.ud1_research(spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW source_document AS SELECT * FROM read_parquet('{tmp_path}/source_document.parquet/*.parquet')")
    want = con.execute(parsing.SQL["ud1_research"]).fetchall()
    assert len(want) > 3_000 and sorted(got, key=repr) == sorted(want, key=repr)
    source = {"outlet": "O", "url": "https://o.example/1", "summary": "s" * 900, "access": "body read"}
    one, large = (json.dumps({"day": 3, "calendar_date": "2025-06-01", "sources": [source] * k}) for k in (2, 3_000))
    read = lambda v: parsers.research_documents(spark.createDataFrame([("f", v)], "path string, value string"), "R").collect()
    assert [json.loads(r["metadata"])["revision"] for r in read(one)] == [hashlib.sha256(one.encode()).hexdigest()] * 2
    with pytest.raises(Exception, match="too large"):
        read(large)


def test_publication(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    one, two, bad = "20250101T000000Z-" + "a" * 12, "20250102T000000Z-" + "b" * 12, "20250103T000000Z-" + "c" * 12
    chunks = lambda e: spark.createDataFrame([("c1", "s1", "t", [1.0, 0.0]), ("c2", "s2", "t", e)], "chunk_id string, source_id string, text string, embedding array<float>")
    assert store.current() is None and not store.ready()
    assert store.publish(one, chunks([0.0, 1.0]), 2)["status"] == "active" and store.ready()
    store.publish(two, chunks([0.5, 1.0]), 2)
    assert store.current() == two and store.manifest(one)["status"] == "superseded" and store.manifest(two)["previous_generation_id"] == one
    for wrong in ([0.0, 0.0], [1.0]):
        with pytest.raises(PublicationError):
            store.publish(bad, chunks(wrong), 2)
        assert store.manifest(bad)["status"] == "failed" and store.current() == two
        bad = bad.replace("c", "d")
    for refused in (lambda: store.publish(two, chunks([1.0, 1.0]), 2), lambda: store.publish("x", chunks([1.0, 1.0]), 2), lambda: store.publish(bad.replace("d", "e"), chunks(None), 2), lambda: store.rollback(two, two), lambda: store.rollback(one, one)):
        with pytest.raises(PublicationError):
            refused()
    assert store.rollback(one, two)["status"] == "active" and store.current() == one and store.manifest(two)["status"] == "superseded"
    assert store.chunks(one).where("source_id = 's2'").count() == 1
    assert store.audit().where("outcome = 'active'").count() == 3 and "embedding" not in store.passages(one).columns
    with store._writing():
        with pytest.raises(PublicationError):
            store.rollback(two, one)
    assert store.rollback(two, one)["status"] == "active" and not store.unlock()
