"""Encoding against two public tokenizer libraries, and the lexicon against a plain dictionary."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest

from quern.llm.codepoints import texts_of
from quern.llm.lexicon import Lexicon, compiled
from quern.llm.tokenize import RANKS, _words, encode_ids, merged, read_ranks

pytestmark = pytest.mark.skipif(not os.path.exists(RANKS), reason="no vocabulary files here")
ATOMS = ["'", "s", "re", "ll", "'s", "'LL", " ", "  ", "\n", "\r\n", "\t", "a", "Ë", "1", "½", "é", "!", "..", "👏🏽", " ", "́", "d", "T", "<|endoftext|>", "​", "漢", "٣"]


def fuzz(n, seed=1, longest=14):
    random.seed(seed)
    return ["".join(random.choices(ATOMS, k=random.randint(0, longest))) for _ in range(n)]


def test_lexicon():
    random.seed(2)
    words = {bytes(random.choices(range(256), k=random.randint(1, 5))) for _ in range(3000)} | {b"a" * k for k in range(1, 60)}
    entries = {w: [random.randrange(50000) for _ in range(random.randint(1, 3))] for w in words}
    lexicon = Lexicon(compiled(entries | {b"": [1]}))
    asked = sorted(words) + [w + b"x" for w in words] + [b""]
    data = np.frombuffer(b"".join(asked) + b" ", np.uint8)
    ends = np.cumsum([len(w) for w in asked])
    for w, p in zip(asked, lexicon.places(data, np.concatenate([[0], ends[:-1]]), ends)):
        got = None if p < 0 else lexicon.ids[lexicon.offsets[p] : lexicon.offsets[p + 1]].tolist()
        assert got == entries.get(w)
    assert len(lexicon.bases) < sum(map(len, words))  # ends of words are shared
    assert Lexicon(compiled({})).places(data, np.array([0]), np.array([2])).tolist() == [-1]


def test_words_follow_the_pattern():
    import public_tokenizers
    import regex

    texts = fuzz(5000) + ["word " * 500 + "tail's\n\n", "x" * 9000]
    got = [b"" for _ in texts]
    for limit in (1 << 20, 64):
        parts = [[] for _ in texts]
        for t in texts_of(pa.array(texts), group_bytes=limit):
            _, starts, ends, counted = _words(t)
            w, p = [t.data[a:b] for a, b in zip(starts.tolist(), ends.tolist())], 0
            for r, k in zip(t.rows.tolist(), counted.tolist()):
                parts[r] += w[p:k]
                p = k
        for text, got in zip(texts, parts):
            assert [x.decode() for x in got] == regex.findall(public_tokenizers.PATTERN, text)


def test_long_word_merges():
    import tiktoken

    ranks = read_ranks(RANKS)
    enc = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    random.seed(4)
    for word in ["a" * 5000, "".join(random.choices("abcË漢", k=3000)), "e", "zhk"]:
        assert merged(word.encode(), ranks) == enc.encode_ordinary(word)


def test_encode_ids(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(RANKS.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    texts = [None, "", " ", "Çfarë është kjo?", None, "<|endoftext|> x", "It's 'scare' ''s 's", "fjala " * 30000] + fuzz(800, 9, 40)
    rows = [(i if i != 4 else None, x, "clash") for i, x in enumerate(texts)] + [(5, texts[5], "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    for words in (60000, 3):
        got = encode_ids(df, "doc_id", "text", lexicon_words=words)
        assert got.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
        got = got.collect()
        assert len(got) == len(rows) and [r["ids"] for r in got if r["doc_id"] is None] == [[]]
        for r in got:
            want = texts[r["doc_id"]] if r["doc_id"] is not None else None
            assert r["ids"] == (t.encode(want, add_special_tokens=False).ids if want else [])
    assert encode_ids(df.limit(0), "doc_id", "text").count() == 0
