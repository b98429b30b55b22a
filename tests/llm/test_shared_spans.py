"""Shared spans against brute force over all stretches."""

import random

import pytest

from quern.llm import shared_spans as module
from quern.llm.shared_spans import LENGTH, shared_share, shared_spans


def brute(docs):
    holders = {}
    for d, x in docs:
        for i in range(len(x or "") - LENGTH + 1):
            holders.setdefault(x[i : i + LENGTH], set()).add(d)
    out = set()
    for d, x in docs:
        if d is None or not x:
            continue
        covered = bytearray(len(x) + 1)
        for i in range(len(x) - LENGTH + 1):
            if holders[x[i : i + LENGTH]] - {d, None}:
                covered[i : i + LENGTH] = b"\1" * LENGTH
        start = None
        for i, c in enumerate(covered):
            if c and start is None:
                start = i
            if not c and start is not None:
                out.add((d, start, i))
                start = None
    return out


def made():
    random.seed(11)
    text = lambda n: "".join(random.choices("abcdefgh ëç👏漢", k=n))
    pieces = [text(n) for n in (359, 360, 361, 400, 500, 900, 1500)]
    docs = [(i, text(random.randint(0, 300)) + random.choice(pieces)[random.randint(0, 60) :] + text(random.randint(0, 300)) + random.choice(pieces) + text(50)) for i in range(60)]
    copy = text(700)
    docs += [(100 + i, copy) for i in range(30)] + [(140, "x" + copy[100:620] + "y"), (141, copy[200:] + "z")]
    docs += [(150, "a" * 1200), (151, "b" + "a" * 800), (152, "ab" * 500), (153, pieces[4] + pieces[4])]
    docs += [(160, None), (161, ""), (162, "short"), (163, pieces[3]), (163, pieces[3]), (164, text(60000) + pieces[5])]
    docs += [(170, copy[:400])]
    return docs


@pytest.mark.parametrize("hot", [20_000, 2])
def test_against_brute_force(spark, hot, monkeypatch):
    docs = made()
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, span_start string").repartition(5)
    for block in (module._BLOCK, 16):
        monkeypatch.setattr(module, "_BLOCK", block)
        got = list(map(tuple, shared_spans(df, hot_places=hot).collect()))
        assert len(got) == len(set(got))
        assert set(got) == brute(docs)
        if hot == 2:
            break


def test_share_and_empty(spark):
    df = spark.createDataFrame([(1, "k" * 500), (2, "k" * 500 + "u" * 500), (3, None), (4, "")], "doc_id long, text string")
    assert sorted(map(tuple, shared_share(df).collect())) == [(1, 500, 500, 1.0), (2, 1000, 500, 0.5), (3, None, 0, 0.0), (4, 0, 0, 0.0)]
    assert shared_spans(df.limit(0)).count() == 0
    null = spark.createDataFrame([(None, "k" * 500), (1, "k" * 500)], "doc_id long, text string")
    assert shared_spans(null).count() == 0


def test_many_copies_in_blocks(spark, monkeypatch):
    """Copies of one text beyond what a block holds, in several partitions, beside texts that hold a part of it."""
    monkeypatch.setattr(module, "_COPIES", 7)
    random.seed(5)
    copy = "".join(random.choices("abcdefgh ", k=900))
    docs = [(n, copy) for n in range(50)] + [(100, "x" + copy[300:]), (101, copy[:300] + "y" * 400), (102, copy[:365] + "z")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    assert set(map(tuple, shared_spans(df).collect())) == brute(docs)
