"""Splitting: limits, cover and level against a plain reading of the rules, on made and random texts."""

import random
import re
from collections import Counter

import numpy as np
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import pieces as module
from quern.llm.pieces import MOST_TOKENS, OVERLAP_TOKENS, pieces, split_oversized, tokens


def plain_level(text):
    small = lambda units: all(tokens(len(u.strip().encode())) <= MOST_TOKENS - OVERLAP_TOKENS for u in units)
    paragraphs = regex.split(r"\n\s*\n", text)
    sentences = [s for p in paragraphs for s in regex.split(r"(?<=[.!?])\s+(?=[\p{Lu}\p{Nd}])", p)]
    words = [w for s in sentences for w in s.split()]
    return next((n for n, u in (("paragraph", paragraphs), ("sentence", sentences), ("word", words)) if small(u)), "character")


def checked(text):
    level, found = pieces(text)
    if not text.strip():
        assert not found
        return
    if tokens(len(text.encode())) <= MOST_TOKENS:
        assert (level, found) == (None, [(0, len(text))])
        return
    assert level == plain_level(text)
    end = 0
    for n, (a, b) in enumerate(found):
        assert a < b and tokens(len(text[a:b].encode())) <= MOST_TOKENS
        if n:
            assert tokens(len(text[a : max(a, end)].encode())) <= OVERLAP_TOKENS
            assert a <= end or not text[end:a].strip()
            assert b > end
        else:
            assert not text[:a].strip()
        if b < len(text) and level != "character":
            assert text[b].isspace() and not text[b - 1].isspace()
        end = b
    assert not text[end:].strip()


SENTENCE = "Kur gjykata pezulloi miratimin, fshati Gunash kërkoi 52 mijë euro nga fondi"


def test_levels():
    random.seed(1)
    sentence = lambda: " ".join(random.choices(SENTENCE.split(), k=12)) + random.choice([".", "!", "?"])
    paragraph = lambda n: "Më ".join(sentence() + " " for _ in range(n)).strip()
    texts = ["\n\n".join(paragraph(6) for _ in range(9)), paragraph(80), " ".join(SENTENCE.lower().split() * 90), "x" * 9000, "ë" * 2500 + " " + "fjalë " * 300, "\r\n \r\n".join([paragraph(3)] * 30)]
    for text in [*texts, "\n\n\n" + texts[0] + "  \n", "a " + " \n" * 3000 + "b " * 1500, "", "   ", "short", "x" * 2380, "x" * 2381, "漢" * 5000]:
        checked(text)
    assert [pieces(t)[0] for t in texts] == ["paragraph", "sentence", "word", "character", "character", "paragraph"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([" ", "\n\n", "\n \n", ". A", "! 9", "? Ë", "word", "x" * 400, "ë" * 300, " ", "\r\n", "fjalë e gjatë ", "漢字" * 40]), max_size=120))
def test_random(parts):
    checked("".join(parts))


def test_cut_follows_the_topic():
    one = ["Deti valët peshku anija porti rrjeta kripa bregu deti valët peshku anija"] * 20
    two = ["Gjykata ligji akti seanca prokurori dosja juristi vendimi gjykata ligji akti"] * 20
    text = ". ".join(one + two) + "."
    _, found = pieces(text)
    assert text[: found[0][1]].count("Gjykata") == 0 and text[found[0][1] :].lstrip().startswith("Gjykata")


def test_operator(spark):
    long = ". ".join([SENTENCE] * 60)
    rows = [(1, "a", long, "clash"), (2, "a", long, "clash"), (3, "b", None, ""), (4, None, "", ""), (5, "c", "short", ""), (None, None, "y" * 3000, ""), (6, "d", "fjalë " * 60000, "")]
    df = spark.createDataFrame(rows, "load_no long, document_id string, text string, piece string")
    got = split_oversized(df, ["load_no", "document_id"]).collect()
    assert {r["load_no"] for r in got} == {1, 2, 6, None}
    for key in (1, 6, None):
        own = sorted((r for r in got if r["load_no"] == key), key=lambda r: r["chunk_index"])
        assert [r["chunk_index"] for r in own] == list(range(len(own)))
        assert all(r["token_count"] == tokens(len(r["piece"].encode())) <= MOST_TOKENS for r in own)
    assert [r["piece"] for r in got if r["load_no"] == 1] == [r["piece"] for r in got if r["load_no"] == 2]
    assert {(r["document_id"], r["cut_at"]) for r in got} == {("a", "sentence"), (None, "character"), ("d", "word")}
    assert split_oversized(df.limit(0), ["load_no"]).count() == 0
    assert re.sub(r"\s", "", "".join(r["piece"] for r in got if r["load_no"] is None))


def test_overlap_keeps_the_given_limit():
    """Limits below and above the usual one, also over long white space between pieces."""
    gap = ("fjalë " * 40).strip() + " " * 150
    for text, most, overlap in ((gap * 30, 100, 20), (("fjalë e gjatë. " * 4000).strip(), 2000, 80)):
        level, found = pieces(text, most, overlap)
        assert level and len(found) > 2
        assert all(tokens(len(text[a:b].encode())) <= most for a, b in found)
        if most > MOST_TOKENS:
            assert all(a < end for (_, end), (a, _) in zip(found, found[1:]))


def test_similarity_and_valleys_against_counts():
    """Block similarity against the cosine of word counts, and climbs against walking outwards."""
    random.seed(8)
    for n in (1, 2, 79, 80, 81, 161, 400, 2500):
        words = random.choices([f"w{i}" for i in range(60)], k=n)
        t = module._Text(" ".join(words))
        got, k = t.similarities(np.arange(n)), module._BLOCK_WORDS
        for i in range(n):
            left, right = Counter(words[max(0, i - k) : i]), Counter(words[i : i + k])
            norm = (sum(c * c for c in left.values()) * sum(c * c for c in right.values())) ** 0.5
            assert abs(got[i] - (sum(left[w] * right[w] for w in left) / norm if norm else 0)) < 1e-9
        s = np.round(got, 1)
        for i, v in enumerate(module._valleys(s)):
            a = b = i
            while a > 0 and s[a - 1] >= s[a]:
                a -= 1
            while b < n - 1 and s[b + 1] >= s[b]:
                b += 1
            assert abs(v - (s[a] + s[b] - 2 * s[i])) < 1e-9


def test_cuts_prefer_changes_of_topic():
    """Texts of paragraphs on changing topics: where a window of sizes holds just one change of topic, the cut is mostly there."""
    random.seed(21)
    topics = [["".join(random.choices("abdefgiklmnoprstuvz", k=random.randint(3, 9))) for _ in range(60)] for _ in range(12)]
    common = ["dhe", "në", "për", "me", "një", "nga", "që", "është"]
    at_change = possible = 0
    for _ in range(60):
        paragraphs, of = [], []
        for topic in random.sample(topics, 4):
            for _ in range(random.randint(5, 8)):
                paragraphs.append(" ".join(random.choice(common if random.random() < 0.2 else topic) for _ in range(25)) + ".")
                of.append(id(topic))
        text = "\n\n".join(paragraphs)
        starts = np.cumsum([0] + [len(p) + 2 for p in paragraphs[:-1]]).tolist()
        changes = {s for s, a, b in zip(starts[1:], of, of[1:]) if a != b}
        _, found = pieces(text)
        ends = [b for _, b in found]
        begin = 0
        for end in ends[:-1]:
            room = module.room(MOST_TOKENS - OVERLAP_TOKENS)
            inside = [s for s in changes if begin + room * module._LEAST_FILL < s - 2 <= begin + room - 20]
            if len(inside) == 1:
                possible += 1
                at_change += end + 2 == inside[0]
            begin = end + 2
    assert possible > 60 and at_change >= 0.8 * possible
