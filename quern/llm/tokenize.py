"""Encoding of texts with a public byte-level BPE vocabulary, by a lexicon transducer and exact merges for the rest."""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.codepoints import LETTER, NUMBER, OTHER, SPACE, Texts, classes, hashes, texts_of
from quern.llm.lexicon import compiled, opened
from quern.sources.tables import arrow_mapped, shared_file, stage_table

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How many of the most frequent words the lexicon holds: a bound on its memory that no result depends on.
LEXICON_WORDS = 60_000
#: Words rarer than one in so many are left to the exact merges.
RAREST = 300_000
_STEPS = 8  # of the histogram of counts, a doubling
_LONGEST = 64  # bytes of a word that may enter the lexicon
_FLUSH = 300_000  # distinct words a task holds before it passes its counts on
#: What follows an apostrophe in a word of its own (fixed values of the vocabulary's pattern).
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


@functools.cache
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word: the adjacent pair with the lowest rank is merged, the leftmost first, until none is left.

    A heap of pairs over a linked list, so a very long word takes n log n."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    n = len(word)
    ends = list(range(1, n + 1))  # of the part that starts here
    after, prior = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or ends[j] != end:
            continue
        alive[j] = False
        ends[i], after[i] = end, after[j]
        if after[i] < n:
            prior[after[i]] = i
            if (r := ranks.get(word[i : ends[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, ends[after[i]]))
        if (h := prior[i]) >= 0 and (r := ranks.get(word[h:end])) is not None:
            heapq.heappush(heap, (r, h, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : ends[i]]])
        i = after[i]
    return out


def word_starts(t: Texts) -> np.ndarray:
    """Which code points start a word of the vocabulary's pattern: an apostrophe with its ending, a run of letters, of
    numbers or of other marks, each with one blank before it if there is one, or white space."""
    cps = t.cps
    n = len(cps)
    kind = classes()[cps]
    start = np.empty(n, bool)
    if not n:
        return start
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    first = t.starts[t.starts < n]
    start[first] = True
    # The last white space before another run, in the same text, stands alone or goes with that run.
    heads = np.flatnonzero(start)
    last = np.zeros(n, bool)
    last[first] = True
    led = heads[(heads > 0) & (kind[heads] != SPACE) & ~last[heads]]
    led = led[kind[led - 1] == SPACE]
    start[led - 1] = True
    start[led[cps[led - 1] == 0x20]] = False
    # An apostrophe that starts a word, with letters right after it.
    quotes = np.flatnonzero((cps == 0x27) & start)
    quotes = quotes[quotes + 1 < n]
    quotes = quotes[(kind[quotes + 1] == LETTER) & ~last[quotes + 1]]
    done = np.zeros(len(quotes), bool)
    for ending in _ENDINGS:
        k = len(ending)
        fits = ~done & (quotes + k < n)
        for i, c in enumerate(ending):
            at = np.minimum(quotes + 1 + i, n - 1)
            fits &= (cps[at] == ord(c)) & ~(last[at])
        done |= fits
        start[quotes[fits] + 1] = False
        rest = quotes[fits] + 1 + k
        rest = rest[rest < n]
        start[rest[kind[rest] == LETTER]] = True
    return start


def _words(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, number of words up to each text's end)."""
    data = np.frombuffer(t.data, np.uint8)
    start = word_starts(t)
    at = np.flatnonzero(start)
    counted = np.searchsorted(at, t.ends)
    if len(t.cps) != len(data):
        at = np.flatnonzero((data & 0xC0) != 0x80)[at]
    return data, at, np.append(at[1:], len(data))[: len(at)], counted


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[bytes, int] = {}

    def out() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["word", "n"])
        counts.clear()
        return made

    for batch in batches:
        for t in texts_of(batch.column(0)):
            data, starts, ends, _ = _words(t)
            short = ends - starts <= _LONGEST
            starts, ends = starts[short], ends[short]
            _, where, n = np.unique(hashes(data, starts, ends), return_index=True, return_counts=True)
            for a, b, k in zip(starts[where].tolist(), ends[where].tolist(), n.tolist()):
                word = t.data[a:b]
                counts[word] = counts.get(word, 0) + k
            if len(counts) > _FLUSH:
                yield out()
    if counts:
        yield out()


def frequent_words(df: DataFrame, text: str, limit: int = LEXICON_WORDS, rarest: int = RAREST) -> DataFrame:
    """(word, n) of the most frequent words over all rows: at most ``limit``, none rarer than one in ``rarest``.

    Words are counted in each task before they are shuffled. Where to stop is read off a histogram of the counts, which
    has a few hundred rows whatever the corpus is, so no partition sends more words than it has among those chosen."""
    counted = arrow_mapped(df.select(F.col(text)), _count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    size = F.floor(F.log2("n") * _STEPS).cast("int")
    repeated = stage_table(counted.where("n > 1").withColumn("size", size), "words")
    sizes = sorted(repeated.groupBy("size").agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n")).collect(), reverse=True)
    all_words, taken, least = sum(r["n"] for r in sizes), 0, None
    for r in sizes:
        taken += r["words"]
        if taken > limit or 2 ** ((r["size"] + 1) / _STEPS) * rarest < all_words:
            break
        least = r["size"]
    return repeated.where(F.col("size") >= least if least is not None else F.lit(False)).select("word", "n")


def publish_file(spark: SparkSession, content: bytes, label: str) -> str:
    """Put a file of bounded size into the shared folder and have every executor fetch it; its name for SparkFiles."""
    name = f"{label}-{hashlib.sha256(content).hexdigest()[:24]}.bin"
    spark.sparkContext.addFile(shared_file(spark, content, name))
    return name


def _with_ids(ranks_file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = read_ranks(SparkFiles.get(ranks_file))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([merged(w, ranks) for w in batch.column(0).to_pylist()], pa.list_(pa.int32()))], ["word", "ids"])

    return run


def compile_lexicon(df: DataFrame, text: str, ranks_file: str, limit: int = LEXICON_WORDS) -> bytes:
    """The lexicon of the corpus's most frequent words: at most ``limit`` words and their ids come to the driver."""
    words = arrow_mapped(frequent_words(df, text, limit).select("word"), _with_ids(ranks_file), "word binary, ids array<int>")
    return compiled({bytes(r["word"]): r["ids"] for r in words.collect()})


def _encoder(name: str, ranks_file: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, ranks = opened(SparkFiles.get(name)), read_ranks(SparkFiles.get(ranks_file))
        known = len(lexicon.ids)
        memo: dict[bytes, list[int]] = {}
        for batch in batches:
            per_row = np.zeros(batch.num_rows, np.int64)
            made = []
            for t in texts_of(batch.column(1)):
                data, starts, ends, counted = _words(t)
                place = lexicon.places(data, starts, ends)
                offset = lexicon.offsets[np.maximum(place, 0)]
                length = lexicon.offsets[np.maximum(place, 0) + 1] - offset if len(lexicon.offsets) > 1 else np.zeros(len(place), np.int32)
                unseen = np.flatnonzero(place < 0)
                extra: list[int] = []
                for k, a, b in zip(unseen.tolist(), starts[unseen].tolist(), ends[unseen].tolist()):
                    word = t.data[a:b]
                    if (ids := memo.get(word)) is None:
                        ids = merged(word, ranks)
                        if len(memo) > _FLUSH:
                            memo.clear()
                        if b - a <= _LONGEST:
                            memo[word] = ids
                    offset[k], length[k] = known + len(extra), len(ids)
                    extra += ids
                pool = np.concatenate([lexicon.ids, np.array(extra, np.int32)]) if extra else lexicon.ids
                before = np.concatenate([[0], np.cumsum(length, dtype=np.int64)])
                take = np.repeat(offset - before[:-1], length) + np.arange(before[-1])
                made.append(pool[take])
                np.add.at(per_row, t.rows, np.diff(np.concatenate([[0], before[counted]])))
            offsets = np.concatenate([[0], np.cumsum(per_row)]).astype(np.int32)
            values = np.concatenate(made) if made else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(values))], ["key", "ids"])

    return encode


def encode_ids(df: DataFrame, key: str, text: str, ranks_path: str = RANKS, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """(key, ids): each row's text as ids of the vocabulary in ``ranks_path``, special tokens being ordinary text.

    Empty and null texts give the empty list. Rows that repeat and null keys stay. Two passes over the texts: one counts
    the words of all rows, for the lexicon of the ``lexicon_words`` most frequent; the other encodes, without a shuffle.
    A word that the lexicon doesn't know is merged exactly, so its size changes the speed only. Very long texts are
    worked on in pieces cut where no word can go across. The driver reads the vocabulary at ``ranks_path`` and hands it to
    the executors.
    """
    kind = df.schema[key].dataType.simpleString()
    with open(ranks_path, "rb") as f:
        ranks = publish_file(df.sparkSession, f.read(), "ranks")
    lexicon = publish_file(df.sparkSession, compile_lexicon(df, text, ranks, lexicon_words), "lexicon")
    encoded = arrow_mapped(df.select(F.col(key).alias("key"), F.col(text).alias("text")), _encoder(lexicon, ranks), f"key {kind}, ids array<int>")
    return encoded.withColumnRenamed("key", key)
