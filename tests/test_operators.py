"""Ordered folds and the other operators against plain simulations, and their edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import dates, text, urls
from quern.operators import admission, chunking, collector, conversation, evaluation, ingest, retrieval


def test_sliding_log_and_windows(spark):
    random.seed(1)
    rows = [(i, random.choice([1, 1, 1, 2, 3]), random.randint(0, 3000)) for i in range(900)]
    df = spark.createDataFrame(rows, "event_id long, client long, epoch long")
    logs, want = {}, {}
    for i, c, t in sorted(rows, key=lambda r: (r[2], r[0])):
        logs[c] = [x for x in logs.get(c, []) if x > t - 100]
        want[i] = len(logs[c]) < 4
        if want[i]:
            logs[c].append(t)
    assert dict(map(tuple, admission.sliding_log(df, 4, 100).collect())) == want
    counts, daily, want = {}, {}, {}
    for i, c, t in sorted(rows, key=lambda r: (r[2], r[0])):
        key, day = (c, t // 50), t // 500
        if counts.get(key, 0) >= 2:
            want[i] = (False, "client", max(1, 50 - t % 50 + 1))
        elif daily.get(day, 0) >= 30:
            want[i] = (False, "daily", max(1, 500 - t % 500 + 1))
        else:
            counts[key], daily[day] = counts.get(key, 0) + 1, daily.get(day, 0) + 1
            want[i] = (True, None, 0)
    got = {r[0]: tuple(r)[1:] for r in admission.coupled_windows(df, 2, 30, 50, 500).collect()}
    assert got == want
    with pytest.raises(ValueError):
        admission.coupled_windows(df, 1, 1, 7, 50)
    assert admission.coupled_windows(df.limit(0), 1, 1).count() == admission.sliding_log(df.limit(0), 1, 1).count() == 0


def plain_history(turns, most, budget):
    kept = []
    for n, role, t in reversed(turns[-most:]):
        if budget <= 1:
            break
        t = t if len(t) <= budget else t[: budget - 1].rstrip() + "…"
        budget -= len(t)
        kept.insert(0, (n, role, t))
    return kept


def test_history_fold(spark):
    turns = {1: [(1, "user", "older turn"), (2, "assistant", "aaaa      bbbb")], 2: [(n, "user", "x" * n) for n in range(1, 30)], 3: [(1, "user", "👏" * 20)]}
    rows = [(c, *t) for c, ts in turns.items() for t in ts] + [(4, 1, "assistant", " [S1] "), (4, 2, "system", "no"), (5, 1, "user", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    for budget in (10, 57, 400):
        got = sorted(map(tuple, conversation.server_history(df, 6, budget).collect()))
        clean = {c: [(n, r, " ".join(t.split()) if r == "assistant" else t) for n, r, t in ts] for c, ts in turns.items()}
        assert got == sorted((c, *k) for c, ts in clean.items() for k in plain_history(ts, 6, budget))


def test_retrieval_folds(spark):
    random.seed(2)
    rows = [(r, i, random.choice("ab"), random.choice(["", "r1", "r2", None]), f"t{random.randint(0, 9)}", f"u{random.randint(0, 6)}", random.random() < 0.5, random.random() < 0.3, round(random.random(), 2)) for r in range(12) for i in range(25)]
    df = spark.createDataFrame(rows, "request_id int, chunk_id int, source_id string, record_id string, title string, url string, is_article boolean, is_reference boolean, distance double").withColumn("is_keyed", F.lit(False))
    want = {}
    for r in range(12):
        own = [x for x in rows if x[0] == r]
        detailed, keys, seen, kept = {x[5] for x in own if not x[7]}, set(), set(), []
        for x in sorted(own, key=lambda x: (x[8], x[1])):
            key = (x[2], x[3] or x[4])
            if (x[7] and x[5] in detailed) or key in keys or (x[6] and x[5] in seen):
                continue
            keys.add(key)
            seen |= {x[5]} if x[6] else set()
            kept.append(x[1])
        want[r] = kept
    got = {}
    for x in retrieval.deduplicated(df).orderBy("request_id", "place").collect():
        got.setdefault(x["request_id"], []).append(x["chunk_id"])
    assert got == want
    some = retrieval.diversified(df.withColumns({"articles": F.array("url"), "bonus": F.lit(None).cast("double")}), 4, 2).collect()
    assert max(x["place"] for x in some) == 4 and retrieval.deduplicated(df.limit(0)).count() == 0


def test_nearest_and_distances(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((60, 6)).round(3)
    rows = [(i, i % 3, [float(x) for x in e]) for i, e in enumerate(v)] + [(100, 0, None), (101, 0, [0.0] * 6), (102, 0, [1.0]), (103, None, [float(x) for x in v[0]]), (104, 0, [float("nan")] * 6)]
    chunks = spark.createDataFrame(rows, "chunk_id long, source_id int, embedding array<float>").repartition(4)
    queries = chunks.where("chunk_id in (0, 7, 100, 101, 102)").select(F.col("chunk_id").alias("query_id"), "embedding")
    got = retrieval.nearest(queries, chunks, 4, 0.9).collect()
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in (0, 7):
        for s in range(3):
            d = sorted((round(max(0.0, 1 - float(unit[q] @ unit[i])), 5), i) for i in range(60) if i % 3 == s)
            want = [i for x, i in d if x <= 0.9][:4]
            assert [x["chunk_id"] for x in sorted((x for x in got if (x["query_id"], x["source_id"]) == (q, s)), key=lambda x: x["rank"])] == want
    assert any(x["source_id"] is None for x in got) and not {x["chunk_id"] for x in got} & {100, 101, 102, 104}
    pair = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0])], "a array<double>, b array<double>")
    assert pair.select(retrieval.cosine_distance(F.col("a"), F.col("b"))).first()[0] == 1.0
    for bad in ([[0.0], [1.0]], [[1.0], [1.0, 0.0]], [[float("nan")], [1.0]], [[], []]):
        with pytest.raises(Exception):
            spark.createDataFrame([bad], "a array<double>, b array<double>").select(retrieval.cosine_distance(F.col("a"), F.col("b"))).collect()
    zero = spark.createDataFrame([([0.0], [1.0])], "a array<double>, b array<double>")
    assert zero.select(retrieval.lenient_distance(F.col("a"), F.col("b"))).first()[0] == 1.0


def test_selection_labels(spark):
    pool = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "request_id int, chunk_id string, place int")
    pick = lambda labels: retrieval.selected(spark.createDataFrame([(1, labels)], "request_id int, labels array<string>"), pool)
    assert [r["chunk_id"] for r in pick(["C2", "C1"]).orderBy("place").collect()] == ["y", "x"]
    for bad in (["C3"], ["C1", "C1"]):
        with pytest.raises(Exception):
            pick(bad).collect()


def test_chunks():
    random.seed(4)
    sentence = "Kur gjykata pezulloi miratimin, fshati Gunash kërkoi fonde."
    body = "\n\n".join(" ".join([sentence] * random.randint(1, 60)) for _ in range(20)) + "\n\n" + "x" * 9000
    found = chunking.chunks("doc", body, "Source: a\nTitle: b")
    assert [c[0] for c in found] == list(range(len(found))) and all(c[2] <= 700 and c[1].startswith("Source: a\nTitle: b\n\n") for c in found)
    assert len({c[4] for c in found}) == len(found) and chunking.chunks("doc", "short", "")[0][1] == "short" and chunking.chunks("doc", " \n", "") == []
    with pytest.raises(ValueError):
        chunking.chunks("doc", body, "s" * 2000)
    assert chunking.tail("one two three", 2) == "three" and chunking.tail("x" * 50, 3) == "x" * 10
    assert "".join(chunking.hard_cut("y" * 1000, 10)) == "y" * 1000 and all(chunking.tokens(p) <= 10 for p in chunking.hard_cut("y" * 1000 + " ab cd", 10))


def test_chunked_and_reuse(spark):
    docs = spark.createDataFrame([("d1", "s", "text one", None, 1), ("d2", "s", None, "", 1), ("d3", "s", "", "", 1)], "document_id string, source_id string, text string, sticky_context string, chunk_id int")
    assert [r["document_id"] for r in chunking.chunked(docs).collect()] == ["d1"]
    now = spark.createDataFrame([("c1", "h1"), ("c2", "h2"), ("c3", None)], "chunk_id string, content_hash string")
    old = spark.createDataFrame([("o2", "h1", [2.0]), ("o1", "h1", [1.0]), ("o3", "h2", [1.0, 2.0]), ("o4", None, [1.0])], "chunk_id string, content_hash string, embedding array<float>")
    got = {r["chunk_id"]: (r["state"], r["embedding"]) for r in ingest.reuse_plan(now, old, 1).collect()}
    assert got == {"c1": ("reused", [1.0]), "c2": ("pending", None), "c3": ("pending", None)}


def test_collector_and_evaluation(spark):
    old = spark.createDataFrame([("a", "1", ["x"]), ("b", None, None)], "key string, revision string, aliases array<string>")
    new = spark.createDataFrame([("a", "2", ["y", "x"]), ("b", None, ["z"]), ("c", "1", None)], "key string, revision string, aliases array<string>")
    assert sorted(map(tuple, collector.merged(old, new).collect())) == [("a", "2", ["x", "y"], "updated"), ("b", None, ["z"], "unchanged"), ("c", "1", [], "new")]
    body = spark.createDataFrame([("s", ": hi\r\nevent: meta\r\ndata: {\r\ndata: }\r\n\r\n\n\ndata: x\n\nevent: none\n\n")], "stream string, body string")
    assert [tuple(r)[2:] for r in evaluation.parsed_events(body, "stream").orderBy("seq").collect()] == [("meta", "{\n}"), ("message", "x")]
    n = spark.createDataFrame([("Sipas nr. 5 e.g. kështu. Po! Jo? [S1]",)], "a string").select(evaluation.sentence_count(F.col("a"))).first()[0]
    assert n == 3


def test_scalars(spark):
    row = spark.createDataFrame([("a\r\n\r\n\r\n\r\nb \t c  \n", "https://www.a.example/x/?q#f", "2025-01-02T03:04:05+02:00", "https://a.example/../b")], "t string, u string, s string, d string")
    got = row.select(
        text.normalized(F.col("t")), urls.one_form(F.col("u"), r"a\.example"), dates.instant(F.col("s")).cast("string"), urls.one_form(F.col("d"), r"a\.example"), dates.instant(F.lit("2025-01-02T03:04:05")),
        dates.seconds_until_reset(F.lit(3599), 3600), dates.printed_figure(F.lit(120.0)), dates.printed_figure(F.lit(None).cast("double")), text.excerpt(F.lit("word " * 100), 20), text.token_estimate(F.lit("")),
    ).first()
    assert tuple(got) == ("a\n\nb c", "https://a.example/x", "2025-01-02 01:04:05", None, None, 2, "120", "not published", got[8], 0)
    assert got[8].endswith("…") and len(got[8]) <= 20
