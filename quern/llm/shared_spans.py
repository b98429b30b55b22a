"""Long exact spans shared between documents, by repeated-phrase automata.

Every stretch of ``LENGTH`` characters holds at least one chosen phrase of ``PHRASE`` characters: the phrase with the least
hash among those that start in it, which is the same one wherever the stretch occurs. A phrase that two documents have is
confirmed as recurring. Every document with recurring phrases, copies included, is streamed through the automaton of its
shard, an Aho-Corasick automaton of the recurring phrases that its documents have, which gives every occurrence of each,
also where it was not chosen. Around an occurrence, the stretches that hold the phrase are compared with those of the
other occurrences of the same phrase; as all of them overlap, the outermost shared ones give what the occurrence covers.

Shards are of documents, each of about a megabyte, so that a document is streamed once and an automaton has a few hundred
phrases; were they of phrases alone, every document would go through all shards, whose number grows with the corpus.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.codepoints import Texts, mixed, texts_of
from quern.sources.tables import arrow_mapped, broadcast_if_bounded, stage_table

LENGTH, PHRASE = 360, 80
#: Starts of phrases in a stretch, and characters beside a phrase that a stretch can hold.
_CHOICES = LENGTH - PHRASE + 1
_SIDE = LENGTH - PHRASE
#: Phrases at more places than this are compared through the shuffle, stretch by stretch, instead of in one task.
HOT_PLACES = 20_000
#: A text's copies are streamed in blocks of about so many.
_COPIES = 1000
_SHARD_BYTES = 1 << 20
_BLOCK = 4096  # occurrences compared at once
_BASE = 0x9E3779B97F4A7C15


@functools.cache
def _values() -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 2**64 - 1, 0x110000, dtype=np.uint64)


@functools.lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2^64."""
    with np.errstate(over="ignore"):
        return tuple(np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(n - 1, b, np.uint64))]) for b in (np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))))


def rolling(cps: np.ndarray, length: int) -> np.ndarray:
    """A hash of each stretch of so many code points."""
    n = len(cps)
    if n < length:
        return np.zeros(0, np.uint64)
    power, inverse = _powers(1 << max(10, n.bit_length()))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_values()[cps] * power[:n])])
    return mixed((sums[length:] - sums[:-length]) * inverse[: n - length + 1])


def chosen(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the chosen phrases; of equal hashes in a stretch the first counts."""
    h = rolling(t.cps, PHRASE)
    n = len(h) - _CHOICES + 1
    if n <= 0:
        return np.zeros(0, np.int64), h[:0]
    low = np.uint64((1 << 26) - 1)
    places = []
    step = 1 << 25
    text_end = np.repeat(t.ends, np.diff(np.concatenate([[0], t.ends])))
    for a in range(0, n, step):
        part = h[a : a + step + _CHOICES - 1]
        keys = (part & ~low) | np.arange(len(part), dtype=np.uint64)
        padded = np.concatenate([keys, np.full(-len(keys) % _CHOICES, np.uint64(2**64 - 1))]).reshape(-1, _CHOICES)
        ahead = np.minimum.accumulate(padded, axis=1).ravel()
        behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
        m = len(part) - _CHOICES + 1
        least = np.minimum(behind[:m], ahead[_CHOICES - 1 : _CHOICES - 1 + m])
        at = np.arange(a, a + m)
        least = least[at + LENGTH <= text_end[at]]
        places.append(np.unique(least & low).astype(np.int64) + a)
    places = np.unique(np.concatenate(places))
    return places, h[places]


def _phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(phrase, digest, place, n, lo, hi, copies) of (doc_id, digest, text): of each text its chosen phrases, with the first
    place and the number of places; copies of a text in one group of texts give its phrases once."""
    for batch in batches:
        ids, digests = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
        for t in texts_of(batch.column(2), whole=True):
            places, found = chosen(t)
            if not len(places):
                continue
            text = np.searchsorted(t.ends, places, side="right")
            digest, doc = digests[t.rows], ids[t.rows]
            order = np.lexsort((doc, digest))
            first = np.flatnonzero(np.append(True, digest[order][1:] != digest[order][:-1]))
            lo, hi = np.minimum.reduceat(doc[order], first), np.maximum.reduceat(doc[order], first)
            copies = np.diff(np.append(first, len(doc)))
            group = np.empty(len(doc), np.int64)
            group[order] = np.repeat(np.arange(len(first)), copies)
            one = np.zeros(len(doc), bool)
            one[order[first]] = True
            keep = one[text]
            g, found, places = group[text[keep]], found[keep], places[keep] - t.starts[text[keep]]
            o = np.lexsort((places, found, g))
            g, found, places = g[o], found[o], places[o]
            head = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (found[1:] != found[:-1])))
            n, g = np.diff(np.append(head, len(g))), g[head]
            columns = (found[head].view(np.int64), digest[order][first][g], places[head].astype(np.int32), n, lo[g], hi[g], copies[g])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["phrase", "digest", "place", "n", "lo", "hi", "copies"])


def recurring_phrases(docs: DataFrame, hot_places: int = HOT_PLACES) -> DataFrame:
    """(digest, copies, phrases): a row for each text with phrases that another document has, too. phrases are structs
    (place, phrase, hot), the first place in the text and whether the phrase stands at more than ``hot_places`` places."""
    found = arrow_mapped(docs, _phrases, "phrase long, digest long, place int, n long, lo long, hi long, copies long")
    # Combined before each shuffle; the join of a phrase that very many texts have can be split, which a window can't.
    of_text = found.groupBy("phrase", "digest").agg(F.min("place").alias("place"), F.max("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("copies").alias("copies"))
    recurring = of_text.groupBy("phrase").agg(F.sum("n").alias("__n"), F.min("lo").alias("__lo"), F.max("hi").alias("__hi")).where("__lo <> __hi").select("phrase", "__n")
    # Nothing else is asked of the join's other side, so both sides share one shuffle.
    counted = of_text.join(recurring, "phrase")
    return counted.groupBy("digest").agg(F.max("copies").alias("copies"), F.collect_list(F.struct("place", "phrase", (F.col("__n") > hot_places).alias("hot"))).alias("phrases"))


_OCCURRENCE = "phrase long, hot boolean, lo long, hi long, around string, before int, docs array<long>, places array<int>"


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each place of each recurring phrase in (doc_id, text, phrases), with the characters around it, by one automaton a shard
    of documents. Places with the same surroundings in a shard come in one row, with the document of each."""
    for batch in batches:
        ids, phrases = batch.column(0).to_pylist(), batch.column(2)
        for t in texts_of(batch.column(1), whole=True, group_bytes=_SHARD_BYTES):
            text = t.cps.astype("<u4").tobytes().decode("utf-32-le")
            texts: dict[str, list[int]] = {}
            for i, begin, end in zip(t.rows.tolist(), t.starts.tolist(), t.ends.tolist()):
                texts.setdefault(text[begin:end], []).append(i)
            automaton = ahocorasick.Automaton()
            for own, rows in texts.items():
                for p in phrases[rows[0]].as_py():
                    automaton.add_word(own[p["place"] : p["place"] + PHRASE], (p["phrase"], p["hot"]))
            if not len(automaton):
                continue
            automaton.make_automaton()
            out: dict[tuple, tuple[list[int], list[int]]] = {}
            for own, rows in texts.items():
                docs = [ids[i] for i in rows]
                for last, (h, hot) in automaton.iter(own):
                    p = last + 1 - PHRASE
                    a = max(0, p - _SIDE)
                    d, at = out.setdefault((h, hot, own[a : p + LENGTH], p - a), ([], []))
                    d += docs
                    at += [p] * len(docs)
            h, hot, around, before = zip(*out)
            docs, places = zip(*out.values())
            columns = (h, hot, [min(d) for d in docs], [max(d) for d in docs], around, before, docs, places)
            kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["phrase", "hot", "lo", "hi", "around", "before", "docs", "places"])


class _Stretches:
    """The stretches that hold a phrase, for many occurrences: of each, by how far they start before the phrase."""

    def __init__(self, around: pa.Array, before: np.ndarray):
        t = next(texts_of(around, whole=True, group_bytes=1 << 40))
        lengths = np.diff(np.concatenate([[0], t.ends]))
        width = 2 * _SIDE + PHRASE
        self.left, self.right = before, lengths - before - PHRASE
        power, self.inverse = _powers(1024)
        sums = np.zeros((len(before), width + 1), np.uint64)
        row = np.repeat(np.arange(len(before)), lengths)
        column = np.arange(len(t.cps)) - np.repeat(t.starts - (_SIDE - before), lengths)
        sums[row, column + 1] = _values()[t.cps] * power[column]
        self.sums = np.cumsum(sums, axis=1)

    def at(self, o: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows that have it, its hash) of the stretches that start o characters before the phrase."""
        rows = np.flatnonzero((self.left >= o) & (self.right >= _SIDE - o))
        c = _SIDE - o
        return rows, mixed((self.sums[rows, c + LENGTH] - self.sums[rows, c]) * self.inverse[c] ^ np.uint64(o))


def _shared(rows: np.ndarray, h: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Of the rows, those whose stretch some other document has."""
    if not len(rows):
        return rows
    order = np.argsort(h, kind="stable")
    rows, h = rows[order], h[order]
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    differ = np.minimum.reduceat(lo[rows], first) != np.maximum.reduceat(hi[rows], first)
    return rows[np.repeat(differ, np.diff(np.append(first, len(h))))]


def _outermost(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """For each occurrence, how far before the phrase the last and the first shared stretch start; -1 if there is none."""
    n = table.num_rows
    least, most = np.full(n, LENGTH), np.full(n, -1)
    phrase, lo, hi = (table[c].to_numpy() for c in ("phrase", "lo", "hi"))
    s = _Stretches(table["around"].combine_chunks(), table["before"].to_numpy())

    def note(rows: np.ndarray, o: int) -> None:
        least[rows] = np.minimum(least[rows], o)
        most[rows] = np.maximum(most[rows], o)

    # What documents of one shard have in common is shared as far as it goes.
    common = np.flatnonzero((lo != hi) & (s.left + s.right >= _SIDE))
    least[common], most[common] = np.maximum(0, _SIDE - s.right[common]), np.minimum(_SIDE, s.left[common])
    for o in (0, _SIDE):
        note(_shared(*s.at(o), lo, hi), o)
    # The others need looking at only in groups with an occurrence whose reach is still open at an end.
    open_phrases = np.unique(phrase[(lo == hi) & ((least > 0) | (most < _SIDE))])
    live = np.isin(phrase, open_phrases)
    for o in range(1, _SIDE):
        rows, h = s.at(o)
        keep = live[rows]
        note(_shared(rows[keep], h[keep], lo, hi), o)
    return least, most


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences sorted by phrase, as intervals (doc_id, a, b). A phrase's occurrences are kept together."""
    kept: list[pa.RecordBatch] = []

    def done(table: pa.Table) -> pa.RecordBatch:
        least, most = _outermost(table)
        own = np.flatnonzero(most >= 0)
        docs, places = (table[c].combine_chunks().take(pa.array(own)) for c in ("docs", "places"))
        counts = docs.value_lengths().to_numpy(zero_copy_only=False)
        doc, p = docs.flatten().to_numpy(), places.flatten().to_numpy()
        return pa.RecordBatch.from_arrays(
            [pa.array(doc), pa.array((p - np.repeat(most[own], counts)).astype(np.int32)), pa.array((p + LENGTH - np.repeat(least[own], counts)).astype(np.int32))], ["doc_id", "a", "b"]
        )

    for batch in batches:
        kept.append(batch)
        if sum(b.num_rows for b in kept) < _BLOCK:
            continue
        table = pa.Table.from_batches(kept)
        phrase = table["phrase"].to_numpy()
        starts = np.flatnonzero(np.append(True, phrase[1:] != phrase[:-1]))
        begin = 0
        for a in starts[1:].tolist():
            if a - begin >= _BLOCK:
                yield done(table.slice(begin, a - begin))
                begin = a
        last = int(starts[-1])
        if last > begin:
            yield done(table.slice(begin, last - begin))
            begin = last
        kept = table.slice(begin).to_batches()
    if kept:
        yield done(pa.Table.from_batches(kept))


def _hot_stretches(batches: Iterator[pa.RecordBatch], back: bool) -> Iterator[pa.RecordBatch]:
    """All stretches of hot phrases: (h, lo, hi), combined in each batch; or back, (h, docs, places, o)."""
    for batch in batches:
        for begin in range(0, batch.num_rows, 512):
            table = pa.Table.from_batches([batch.slice(begin, 512)])
            lo, hi = table["lo"].to_numpy(), table["hi"].to_numpy()
            s = _Stretches(table["around"].combine_chunks(), table["before"].to_numpy())
            found = [(rows, h, o) for o in range(_SIDE + 1) for rows, h in [s.at(o)]]
            rows, h = (np.concatenate([f[k] for f in found]) for k in (0, 1))
            if back:
                o = np.repeat(np.arange(_SIDE + 1, dtype=np.int32), [len(f[0]) for f in found])
                docs, places = (table[c].combine_chunks().take(pa.array(rows)) for c in ("docs", "places"))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), docs, places, pa.array(o)], ["h", "docs", "places", "o"])
            elif len(h):
                order = np.argsort(h)
                first = np.flatnonzero(np.append(True, h[order][1:] != h[order][:-1]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[order][first].view(np.int64)), pa.array(np.minimum.reduceat(lo[rows[order]], first)), pa.array(np.maximum.reduceat(hi[rows[order]], first))], ["h", "lo", "hi"]
                )


def _hot_covered(occurrences: DataFrame) -> DataFrame:
    """The same as _covered for phrases of many texts: stretches are compared through the shuffle, combined before it."""
    stretches = arrow_mapped(occurrences, lambda b: _hot_stretches(b, False), "h long, lo long, hi long")
    shared = stretches.groupBy("h").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select("h")
    back = arrow_mapped(occurrences, lambda b: _hot_stretches(b, True), "h long, docs array<long>, places array<int>, o int")
    reach = back.join(shared, "h").groupBy("docs", "places").agg(F.min("o").alias("least"), F.max("o").alias("most"))
    each = reach.select(F.explode(F.arrays_zip("docs", "places")).alias("x"), "least", "most")
    return each.select(F.col("x.docs").alias("doc_id"), (F.col("x.places") - F.col("most")).alias("a"), (F.col("x.places") + LENGTH - F.col("least")).alias("b"))


def _runs(intervals: DataFrame) -> DataFrame:
    """Intervals of each document joined where they overlap or touch."""
    order = Window.partitionBy("doc_id").orderBy("a", "b")
    reached = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return (
        intervals.groupBy("doc_id", "a").agg(F.max("b").alias("b"))
        .withColumn("__new", F.coalesce(F.col("a") > reached, F.lit(True)).cast("int"))
        .withColumn("__run", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("doc_id", "__run")
        .agg(F.min("a").alias("span_start"), F.max("b").alias("span_end"))
        .drop("__run")
    )


def shared_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", hot_places: int = HOT_PLACES) -> DataFrame:
    """(doc_id, span_start, span_end): longest runs of characters that lie in some ``LENGTH`` consecutive ones which the
    text of another doc_id holds, too; starts count from 0 in code points, ends are exclusive.

    Null and shorter texts give no rows, rows with a null key take no part, repeated rows count once; should a key have
    several texts, their runs are joined by position. Keys must be whole numbers. Phrases are sought in one copy of a text
    for each task; the copies are streamed in blocks spread over tasks. Phrases that stand at very many places are compared
    in another, distributed way with the same result. Nothing grows with the corpus on the driver or in a broadcast.
    """
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("digest"), F.col(text).alias("text")).where(F.col("doc_id").isNotNull() & (F.length("text") >= LENGTH))
    phrases = stage_table(recurring_phrases(docs, hot_places), "phrases")
    # Texts with very many copies are spread, with their phrases once for each block.
    many = phrases.where(F.col("copies") > _COPIES).select("digest", F.ceil(F.col("copies") / _COPIES).cast("int").alias("__blocks"))
    blocks = F.coalesce("__blocks", F.lit(1))
    spread = docs.join(broadcast_if_bounded(many), "digest", "left").withColumn("__block", F.pmod(F.xxhash64("doc_id"), blocks).cast("int"))
    told = phrases.withColumn("__block", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.col("copies") / _COPIES)).cast("int") - 1)))
    joined = spread.join(told, ["digest", "__block"]).select("doc_id", "text", "phrases")
    found = arrow_mapped(joined, _occurrences, _OCCURRENCE)
    some_hot = bool(phrases.where(F.exists("phrases", lambda p: p["hot"])).limit(1).count())
    if some_hot:
        found = stage_table(found, "occurrences")
    cold = found.where(~F.col("hot")) if some_hot else found
    parts = arrow_mapped(cold.repartition("phrase").sortWithinPartitions("phrase"), _covered, "doc_id long, a int, b int")
    if some_hot:
        parts = parts.unionByName(_hot_covered(found.where("hot")))
    return _runs(parts).withColumnRenamed("doc_id", key)


def shared_share(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, shared_chars, shared_part) of every row: how much of its text is shared elsewhere. A null text
    has null n_chars and shares nothing; shared_part of an empty one is 0."""
    spans = shared_spans(docs, key, text).groupBy(key).agg(F.sum(F.col("span_end") - F.col("span_start")).alias("__s"))
    shared, n = F.coalesce("__s", F.lit(0)).cast("bigint"), F.length(text).cast("bigint")
    return docs.select(key, n.alias("n_chars")).join(spans, key, "left").select(
        key, "n_chars", shared.alias("shared_chars"), F.when(F.col("n_chars") > 0, F.round(shared / F.col("n_chars"), 6)).otherwise(F.lit(0.0)).alias("shared_part")
    )
