"""Records: rules, closed keys, JSON text, rich text and guards."""

import json

from pyspark.sql import functions as F

from quern.operators import records


def test_rules_and_keys(spark):
    df = spark.createDataFrame([("a1", '{"k": 1, "z": 2}'), (None, None), ("zz", "[1]")], "t string, j string")
    got = df.select(records.first_match(F.col("t"), [("^a", "A"), ("1", "B")], "none"), records.unknown_keys(F.col("j"), ["k"])).collect()
    assert [tuple(r) for r in got] == [("A", ["z"]), ("none", []), ("none", [])]
    assert spark.range(1).select(records.violations({"a": F.lit(True), "b": F.lit(False), "c": F.lit(None).cast("boolean")})).first()[0] == ["b", "c"]
    assert spark.range(1).select(records.first_given(F.lit(None).cast("string"), F.lit(" \n"), F.lit("x"))).first()[0] == "x"


def test_json_text(spark):
    values = {"b": 'say "hi"\n', "a": "ë\\", "c": None}
    got = spark.createDataFrame([values], "a string, b string, c string").select(records.json_text({k: F.col(k) for k in values})).first()[0]
    assert json.loads(got) == values and got == json.dumps(values, sort_keys=True, ensure_ascii=False)


def test_blocks(spark):
    text = "A line\nand more\n\n- one\n- two\n \n1. first\n2) second\n\n\n- mixed\nwith text\n"
    got = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(records.blocks(F.col("t")).alias("b")).collect()
    assert [(b["kind"], b["items"]) for b in got[0]["b"]] == [("paragraph", ["A line and more"]), ("list", ["one", "two"]), ("ordered", ["first", "second"]), ("paragraph", ["- mixed with text"])]
    assert got[1]["b"] == [] and got[2]["b"] is None


def test_origins(spark):
    asked = spark.createDataFrame([(1, "HTTPS://A.example:443"), (2, "https://a.example/x"), (3, "https://b.example"), (4, None), (5, "http://c.example:8080")], "n int, url string")
    allowed = spark.createDataFrame([("https://a.example",), ("http://c.example:8080",)], "origin string")
    assert sorted(r["n"] for r in records.from_allowed_origins(asked, "url", allowed).collect()) == [1, 5]
