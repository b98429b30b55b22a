"""The consistent form on hand-made look-alikes and decoys, and the pairs against brute force."""

import random

from quern.llm import lookalikes
from quern.llm.lookalikes import consistent, look_alike_classes, look_alike_pairs

SAME = [
    ["Vendimi 12, ligji", "Ｖｅｎｄｉｍｉ　１２， ｌｉｇｊｉ", "Vendi​mi 12, li­gji", "Vendіmі 12, lіgјі", "﻿Vendimi 12,⁠ ligji️"],
    ["çështje ë", "çështje ë", "c‍̧ështje ë", "çёshtje ё", "çёshtje ｅ̈"],
    ["office flat stone", "oﬃce ﬂat ﬆone", "οffice flat stonе"],
    ["ABEHOPTX", "АВЕНОРТХ", "ΑΒΕΗΟΡΤΧ", "ＡＢＥＨＯＰＴＸ"],
    ["", "​", "﻿­"],
]
SAME += [
    ["VIII l No kg", "Ⅷ ⅼ № ㎏", "VIII\u2007l\u00a0No\u202fkg"],
    ["AB Fg x", "𝐀𝐁 𝔉𝔤 𝑥", "ＡＢ Ｆｇ ｘ", "ꓮꓐ ꓝɡ х", "ᎪВ Fɡ χ"],
    ["カタ ガ...", "ｶﾀ ｶﾞ…", "ｶﾀ ガ‥."],
    ["Uno koxaiu", "Սոo κοχαιυ"],
    ["a-b", "a‑b", "a‐b"],
]
APART = ["x2", "x²", "x3", "X2", "é", "e", "É", "ë", "x 2", "x  2", "１", "2", "½", "1/2", "①", "º", "ª", "¨", "ı", "i"]


def rows():
    out = [(f"s{g}{n}", v) for g, group in enumerate(SAME) for n, v in enumerate(group)]
    return out + [(f"a{n}", v) for n, v in enumerate(APART)] + [("n1", None), (None, "x2"), ("a0", "x2")]


def test_forms(spark):
    df = spark.createDataFrame([(k, v, 1) for k, v in rows()], 'document_id string, "title" string, ord int'.replace('"', "`"))
    got = {r["document_id"]: r["title"] for r in consistent(df, ["title"]).collect() if r["document_id"]}
    for g, group in enumerate(SAME):
        assert {got[f"s{g}{n}"] for n in range(len(group))} == {group[0]}
    assert len({got[f"a{n}"] for n in range(len(APART))}) == len(APART)
    assert got["n1"] is None and consistent(df.limit(0), ["title"]).count() == 0


def brute(pairs):
    form = {v: group[0] for group in SAME for v in group}
    known = [(k, v) for k, v in pairs if k is not None and v is not None]
    return {(min(a, b), max(a, b)) for a, x in known for b, y in known if a != b and x != y and form.get(x, x) == form.get(y, y)}


def test_pairs_and_classes(spark):
    random.seed(3)
    more = rows() + [(f"d{n}", random.choice(random.choice(SAME))) for n in range(80)]
    df = spark.createDataFrame([(k, v, "x" * 70000 if n == 5 else v, "") for n, (k, v) in enumerate(more)], "document_id string, title string, text string, form string").repartition(4)
    got = look_alike_pairs(df).collect()
    assert len(got) == len({tuple(r) for r in got})
    want = brute(more)
    assert {tuple(r)[1:] for r in got if r["field_name"] == "title"} == want
    texts = {k: v for n, (k, v) in enumerate(more) if n != 5 and k}
    assert {tuple(r)[1:] for r in got if r["field_name"] == "text"} == brute(list(texts.items()))
    classes = {r["document_id"]: r for r in look_alike_classes(df).collect() if r["field_name"] == "title"}
    assert set(classes) == {x for p in want for x in p}
    for a, b in want:
        assert classes[a]["class_id"] == classes[b]["class_id"]
    assert look_alike_pairs(df.limit(0)).count() == 0


def test_bounds_lose_no_text(spark, monkeypatch):
    monkeypatch.setattr(lookalikes, "MOST_COPIES", 3)
    monkeypatch.setattr(lookalikes, "MOST_VARIANTS", 4)
    data = [(f"k{n:03d}", "ab" + "​" * (n % 8), None) for n in range(120)]
    got = {tuple(r)[1:] for r in look_alike_pairs(spark.createDataFrame(data, "document_id string, title string, text string")).collect()}
    assert {x for p in got for x in p} == {k for k, *_ in data}
    assert len(got) < 120 * 14


def test_every_stored_form_meets_every_other(spark, monkeypatch):
    """One title in many stored ways, a few keys each, beside a group of copies: all pairs, whatever the blocks."""
    monkeypatch.setattr(lookalikes, "MOST_VARIANTS", 16)
    marks = ["\u200b", "\u2060", "\ufeff"]
    ways = ["".join(marks[n // 3**i % 3] for i in range(5)) for n in range(150)]
    data = [(f"k{n:03d}", "ab" + ways[n % 150], None) for n in range(320)] + [("k000", "ab", None), ("z", "b", None)]
    df = spark.createDataFrame(data, "document_id string, title string, text string").repartition(3)
    got = [tuple(r)[1:] for r in look_alike_pairs(df).collect()]
    want = {(a, b) for a, x, _ in data for b, y, _ in data if a < b and x != y and "z" not in (a, b)}
    assert len(got) == len(set(got)) and set(got) == want


def test_accents_meet_the_latin_letter(spark):
    """Look-alike letters with accents, by themselves or composed, become what the Latin letter becomes with them."""
    same = [("ӓ", "ä"), ("ӓ", "ä"), ("ӧ", "ö"), ("ӧ", "ö"), ("о​̈", "ö"), ("ӱ", "ÿ"), ("ӱ", "ÿ"), ("Ӓ", "Ä"), ("Ӧ", "Ö"), ("Ӱ", "Ÿ"), ("ὸ", "ò"), ("ὸ", "ò")]
    same += [("Ὰ", "À"), ("Ὰ", "À"), ("Ὲ", "È"), ("Ὶ", "Ì"), ("Ὸ", "Ò"), ("Ὺ", "Ỳ"), ("Ὴ", "H̀"), ("Ὴ", "H̀"), ("Ή", "H́"), ("Ἀ", "A̓"), ("ӧ̄", "ȫ"), ("օ̈", "ö"), ("ё", "ë")]
    texts = [f"Zgj {x} dhe {x}" for pair in same for x in pair] + ["Zgj й Й ή"]
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, title string")
    got = [r["title"] for r in consistent(df, ["title"]).orderBy("n").collect()]
    assert got[0:-1:2] == got[1:-1:2] == [f"Zgj {x} dhe {x}" for _, x in same] and got[-1] == "Zgj й Й H́".replace("H́", "ή")
    pairs = {(r[1], r[2]) for r in look_alike_pairs(df.selectExpr("format_string('%03d', n) document_id", "title", "cast(null as string) text")).collect()}
    assert {(f"{2 * n:03d}", f"{2 * n + 1:03d}") for n in range(len(same))} <= pairs
