"""The general data-preparation operators against brute force and hand-made cases."""

import random
import re
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quern.operators.packed_values import explode_packed
from quern.operators.snapshots import removed_counts, snapshot_changes, validity_intervals

SNAP = "generation_id string, collection_id string, chunk_id string, content_hash string, delivered_at timestamp_ntz, change string, ord int"
MANI = "generation_id string, collection_id string, status string, created_at timestamp_ntz, removed_chunk_count bigint"
T0 = datetime(2025, 1, 1)


def cut(text):
    """Character by character, as the statement reads."""
    if text is None or text.strip().lower() in ("", "-", "n/a"):
        return []
    out, cur, i, quote, address = [], "", 0, "", False
    while i < len(text):
        c = text[i]
        if quote:
            if c == quote:
                if quote == '"' and text[i + 1 : i + 2] == '"':
                    cur += '"'
                    i += 1
                else:
                    quote = ""
            else:
                cur += c
        elif c in '"“':
            quote, address = ("”" if c == "“" else '"'), False
        elif c in "|\t\r\n":
            out, cur, address = [*out, cur], "", False
        elif c in ",;":
            rest = text[i + 1 :]
            if address and rest[:1].isalnum() and not re.match("https?://", rest, re.I):
                cur += c
            else:
                out, cur, address = [*out, cur], "", False
        else:
            if re.match("https?://", text[i:], re.I):
                address = True
            if c.isspace() or c == "”":
                address = False
            cur += c
        i += 1
    return [v.strip() for v in [*out, cur] if v.strip()]


FIELDS = [
    None, "", " ", "-", " n/a ", "N/A", "a", "a,b;c|d\te\nf\r\ng", " a , , b ", '"a, b"', '"a ""b"", c";d', "“x; y” | z", '“a "b, c” d', '"a “b, c" d',
    "http://a.example/x?ids=1,2", "http://a.example/x,http://b.example/y;rev=3", "http://a.example/x, b", "see http://a.example/b,c d,e", 'x"y,z"w', "a,a,a",
    '"unclosed, a', "￿,￾;￿￾", "http://a.example/b;HTTPS://c.example", '""', '"-"', 'http://a.example/p,q.html"r,s",t', "é,ë;ç",
]


def test_packed_values(spark):
    random.seed(3)
    parts = ["a", "B2", " ", ",", ";", "|", "\n", '"', '""', "“", "”", "http://x.example/", "https://", "é", ",7"]
    fields = FIELDS + ["".join(random.choices(parts, k=random.randint(1, 14))) for _ in range(600)] + ["x, " * 20000]
    # A doubled quote outside of quotes opens and closes, which brute force and the fold read alike.
    df = spark.createDataFrame([(i, f, "clash") for i, f in enumerate(fields)], "k long, f string, item_pos string")
    got = {}
    for r in explode_packed(df, "k", "f").collect():
        got.setdefault(r["k"], []).append((r["item_pos"], r["item_value"]))
    for i, f in enumerate(fields):
        assert [v for _, v in sorted(got.get(i, []))] == cut(f), f
        assert [p for p, _ in sorted(got.get(i, []))] == list(range(1, len(cut(f)) + 1))
    assert explode_packed(df.limit(0), "k", "f").count() == 0


def brute_changes(snap, mani):
    order = {}
    for g, c, s, at, _ in mani:
        if s in ("active", "superseded") and g is not None and c is not None:
            order.setdefault(c, []).append((at or datetime.min, g))
    plain = lambda h: None if h is None else re.sub("^sha256:", "", h.strip().lower())
    out = set()
    for gens in order.values():
        states = []
        for _, g in sorted(gens):
            rows = {}
            for gg, _, k, h, at in snap:
                if gg == g and k is not None and (k not in rows or (at or datetime.min) > rows[k][0]):
                    rows[k] = (at or datetime.min, plain(h))
            states.append((g, {k: v[1] for k, v in rows.items()}))
        for (_, a), (g, b) in zip(states, states[1:]):
            out |= {(g, k, "added") for k in b.keys() - a.keys()} | {(g, k, "removed") for k in a.keys() - b.keys()}
            out |= {(g, k, "changed") for k in a.keys() & b.keys() if a[k] != b[k]}
    return out


def test_snapshot_changes(spark):
    random.seed(5)
    mani = [(f"{c}{i}", c, random.choice(["active", "superseded", "superseded", "failed"]), T0 + timedelta(days=i // 2 * 2), random.choice([None, 1])) for c in "pq" for i in range(8)]
    mani += [("r0", "r", "active", None, 0), ("r1", "r", "superseded", T0, 0), (None, "r", "active", T0, 0), ("r9", None, "active", T0, 0)]
    snap, n = [], 0
    for g, c, *_ in mani:
        for k in ["00ff", "AB", "k3", "", None, "k5"]:
            if random.random() < 0.7:
                for _ in range(random.choice([1, 1, 3])):
                    n += 1
                    h = random.choice([None, "aa", "sha256:AA", " Bb ", "SHA256:bb"])
                    snap += [(g, c, k, h, T0 + timedelta(minutes=n))] * random.choice([1, 2])
    snap += [("unknown", "p", "k3", "aa", T0)]
    s = spark.createDataFrame([(*r, "clash", 7) for r in snap], SNAP)
    m = spark.createDataFrame(mani, MANI)
    want = brute_changes(snap, mani)
    assert {"added", "removed", "changed"} == {x[2] for x in want}
    assert sorted(map(tuple, snapshot_changes(s, m).collect())) == sorted(want)
    counts = {r["generation_id"]: r for r in removed_counts(s, m).collect()}
    assert len(counts) == len(mani)
    for g, c, status, *_ in mani:
        if status == "failed":
            assert counts[g]["derived_removed"] is None
        elif g is not None and c is not None:
            assert counts[g]["derived_removed"] == sum(x[0] == g and x[2] == "removed" for x in want)
    for a, b in ((s.limit(0), m), (s, m.limit(0))):
        assert snapshot_changes(a, b).count() == 0 and validity_intervals(a, b).count() == 0


def test_snapshot_ties_and_hot_key(spark):
    m = spark.createDataFrame([("g1", "c", "active", T0, 0), ("g2", "c", "active", T0 + timedelta(1), 0)], MANI)
    rows = [("g1", "c", "k", "aa", T0), ("g2", "c", "k", "AA", T0)] * 3000
    s = spark.createDataFrame([(*r, "", 1) for r in rows], SNAP)
    assert snapshot_changes(s, m).count() == 0
    assert validity_intervals(s, m).select("from_ord", "to_ord").collect() == [(1, 2)]
    tied = s.union(s.limit(1).withColumn("content_hash", F.lit("bb")).select(s.columns))
    assert snapshot_changes(tied, m).count() in (0, 1)
