"""Evaluation texts that leaked into a corpus, found by template windows with typed slots.

A text's words are folded (no case, no accents). Words that are numbers, units or names become typed placeholders, and
the windows of ``WINDOW`` consecutive words of the resulting template are hashed. A window of a document joins the equal
ones of evaluation items; the words that stood in the slots then tell a verbatim leak (the same words) from a question
that was given other parameters (each slot word of the item always replaced by one and the same word, along one alignment
of the two texts) and from chance.
Names are known in two ways, each with its own template: words written with a capital inside a sentence of any
evaluation item, whatever their case in the document; and words so written where they stand.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.codepoints import LETTER, NUMBER, Texts, classes, folded, hashes, mixed, texts_of
from quern.llm.tokenize import publish_file
from quern.sources.tables import arrow_mapped, broadcast_if_bounded, stage_table

WINDOW = 13
#: Of the words of a window, so many must be no slots for a re-parameterised question to count.
LEAST_LITERALS = 7
#: And so large a share of the windows of the item's question or passage must stand in the document.
LEAST_SHARE = 0.8
#: Items are handled in blocks of at most about this many windows; their patterns are a file that all workers of a machine map.
BLOCK_WINDOWS = 4_000_000
#: Numbers written as words, folded (fixed values).
NUMBER_WORDS = tuple(
    "zero nje dy tre kater pese gjashte shtate tete nente dhjete njezet tridhjete dyzet pesedhjete njeqind dyqind treqind "
    "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred "
    "due quattro cinque sei sette otto nove dieci undici dodici venti trenta quaranta cinquanta sessanta settanta ottanta novanta cento duecento "
    "null zwei drei vier funf sechs sieben acht neun zehn elf zwolf zwanzig dreißig vierzig funfzig sechzig siebzig achtzig neunzig hundert".split()
)
#: Units, folded (fixed values).
UNITS = tuple(
    "euro euros eur lek leke usd dollar dollars dollare chf km kilometra kilometres kilometer m metra meters metres meter cm mm "
    "kg kilogram g gram grams ton tons tonne tonnes tonelata ha hektar hektare hectares percent perqind prozent percento "
    "mije thousand tausend mila milion milione million millionen milioni miliarde billion milliarden miliardi litra liters litri "
    "vjet years jahre anni dite days tage giorni ore hours stunden javë jave weeks wochen settimane muaj months monate mesi".split()
)
_NUM, _UNIT, _NAME = (np.uint64(x) for x in (0x1111_2222_3333_4444, 0x5555_6666_7777_8888, 0x9999_AAAA_BBBB_CCCC))
_ROW = "key {kind}, place int, pattern long, exact long, slots array<string>"
_KEY = ["pattern", "exact"]


@functools.cache
def _upper() -> np.ndarray:
    out = np.zeros(0x110000, bool)
    for cp in (*range(0x41, 0x5B), *range(0xC0, 0xD800), *range(0xF900, 0x1F000)):
        out[cp] = unicodedata.category(chr(cp)) in ("Lu", "Lt")
    return out


@functools.cache
def _stops() -> np.ndarray:
    out = np.zeros(0x110000, bool)
    out[[ord(c) for c in ".!?:\n"]] = True
    return out


@functools.cache
def _typed_hashes() -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the units and of the number words."""
    return tuple(np.array([_hash_of(u) for u in words], np.uint64) for words in (UNITS, NUMBER_WORDS))


def _hash_of(word: str) -> int:
    cps = np.array([int(folded()[ord(c)]) for c in word], np.uint64)
    return int(hashes(cps, np.array([0]), np.array([len(cps)]))[0])


class Words:
    """The folded words of some texts: where each starts and ends, its hash and what kind of slot it can be."""

    def __init__(self, t: Texts):
        fold = folded()[t.cps]
        kept = fold != 0
        self.cps, original = fold[kept], t.cps[kept]
        ends = np.concatenate([[0], np.cumsum(kept)])[t.ends]
        kind = classes()[self.cps]
        inside = (kind == LETTER) | (kind == NUMBER)
        n = len(inside)
        start = inside.copy()
        start[1:] &= ~inside[:-1]
        begins = np.concatenate([[0], ends[:-1]])
        begins = begins[begins < n]
        start[begins] = inside[begins]
        self.starts = np.flatnonzero(start)
        # A word ends at the next one that touches it (in another text), or where its run ends.
        stop = np.flatnonzero(inside & np.append(~inside[1:] | start[1:], True)[:n]) + 1 if n else np.zeros(0, np.int64)
        self.ends = stop
        self.text = np.searchsorted(ends, self.starts, side="right")
        self.hash = hashes(self.cps.astype(np.uint64), self.starts, self.ends)
        digits = np.concatenate([[0], np.cumsum(kind == NUMBER)])
        units, numbers = _typed_hashes()
        self.number = (digits[self.ends] > digits[self.starts]) | np.isin(self.hash, numbers)
        self.unit = np.isin(self.hash, units)
        first = np.ones(len(self.starts), bool)
        first[1:] = self.text[1:] != self.text[:-1]
        stops = np.concatenate([[0], np.cumsum(_stops()[original])])
        after_stop = np.ones(len(self.starts), bool)
        after_stop[1:] = stops[self.starts[1:]] > stops[self.ends[:-1]]
        self.named = _upper()[original[self.starts]] & ~first & ~after_stop & ~self.number
        self._all: str | None = None

    def word(self, i: int) -> str:
        if self._all is None:
            self._all = self.cps.astype("<u4").tobytes().decode("utf-32-le", "replace")
        return self._all[self.starts[i] : self.ends[i]]

    def windows(self, values: np.ndarray) -> np.ndarray:
        """A hash of the values of each window; windows that go over a text's end are left in, see whole()."""
        n = max(0, len(values) - WINDOW + 1)
        out = np.zeros(n, np.uint64)
        for j in range(WINDOW):
            out = out * np.uint64(0x9E3779B97F4A7C15) + values[j : j + n]
        return mixed(out)

    def whole(self) -> np.ndarray:
        n = max(0, len(self.text) - WINDOW + 1)
        return self.text[:n] == self.text[WINDOW - 1 :][:n] if n else np.zeros(0, bool)

    def templates(self, names: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(values, slots) of either way to know names."""
        plain = np.where(self.unit, _UNIT, np.where(self.number, _NUM, mixed(self.hash)))
        fixed = self.unit | self.number
        return [(np.where(named & ~fixed, _NAME, plain), named | fixed) for named in (np.isin(self.hash, names), self.named)]


def _joint(pattern: np.ndarray, exact: np.ndarray) -> np.ndarray:
    return mixed(pattern * np.uint64(3) ^ exact)


def _rows(batches: Iterator[pa.RecordBatch], names: np.ndarray, wanted: np.ndarray | None, verbatim: bool, least_literals: int) -> Iterator[pa.RecordBatch]:
    """Windows of (key, text) rows with ``least_literals``: all, or those whose pattern (if verbatim: pattern and words) is
    wanted (sorted). The place of a window counts from some place that is the same for all windows of a row."""
    seen = np.zeros(1 << 22, bool)
    if wanted is not None:
        seen[(wanted >> np.uint64(42)).astype(np.int64)] = True
    for batch in batches:
        keys: list[int] = []
        place: list[int] = []
        pattern: list[int] = []
        exact: list[int] = []
        slots: list[list[str]] = []
        for t in texts_of(batch.column(1), whole=True):
            w = Words(t)
            whole, words = w.whole(), w.windows(w.hash)
            for way, (values, slot) in enumerate(w.templates(names)):
                found = w.windows(values ^ np.uint64(way))
                filled = np.concatenate([[0], np.cumsum(slot)])
                at = np.flatnonzero(whole & (filled[WINDOW:] - filled[:-WINDOW] <= WINDOW - least_literals) if len(whole) else whole)
                if wanted is not None:
                    asked = _joint(found[at], words[at]) if verbatim else found[at]
                    maybe = seen[(asked >> np.uint64(42)).astype(np.int64)]
                    at, asked = at[maybe], asked[maybe]
                    at = at[wanted[np.minimum(np.searchsorted(wanted, asked), len(wanted) - 1)] == asked]
                keys += t.rows[w.text[at]].tolist()
                place += at.tolist()
                pattern += found[at].view(np.int64).tolist()
                exact += words[at].view(np.int64).tolist()
                for i in at.tolist():
                    slots.append([w.word(i + j) for j in np.flatnonzero(slot[i : i + WINDOW]).tolist()])
        if keys:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keys)), pa.array(place, pa.int32()), pa.array(pattern, pa.int64()), pa.array(exact, pa.int64()), pa.array(slots, pa.list_(pa.string()))],
                ["key", "place", "pattern", "exact", "slots"],
            )


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for t in texts_of(batch.column(0), whole=True):
            w = Words(t)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(w.hash[w.named]).view(np.int64))], ["h"])


def item_texts(items: DataFrame) -> DataFrame:
    """(item_id, part, text) of the questions and passages of evaluation items."""
    parts = F.explode(F.array(*(F.struct(F.lit(c).alias("part"), F.col(c).alias("text")) for c in ("question", "passage"))))
    return items.select("item_id", parts.alias("p")).select("item_id", "p.part", "p.text").where(F.col("text").isNotNull())


def template_matches(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", verbatim: bool = False, least_literals: int = 0) -> DataFrame:
    """(doc_id, place, exact, slots, item_id, part, i_place, i_exact, i_slots, i_windows): windows of documents and items with one
    template, each with its place, the hash of its words and the words in its slots; if ``verbatim``, only those whose words
    are the same. Windows with fewer than ``least_literals`` words outside slots are left out before anything is joined.

    The documents are read once a block of items, of which there is one unless items have more than BLOCK_WINDOWS windows.
    The workers pass on only windows that have a partner; these meet the items' windows by a broadcast where the measured
    size of those allows it, else through a shuffle.
    """
    spark = docs.sparkSession
    parts = item_texts(items).select(F.struct("item_id", "part").alias("key"), "text")
    names = np.unique(np.array([r["h"] for r in arrow_mapped(parts.select("text"), _names, "h long").distinct().collect()], np.int64).view(np.uint64))
    item_kind, doc_kind = parts.schema["key"].dataType.simpleString(), docs.schema[key].dataType.simpleString()
    windows = arrow_mapped(parts, lambda b: _rows(b, names, None, verbatim, least_literals), _ROW.format(kind=item_kind))
    windows = windows.select(F.col("key.item_id").alias("item_id"), F.col("key.part").alias("part"), F.col("place").alias("i_place"), "pattern", F.col("exact").alias("i_exact"), F.col("slots").alias("i_slots"))
    # Verbatim leaks need no places: a window that an item repeats counts once.
    counted = windows.groupBy("item_id", "part").agg(F.count_distinct("i_place").alias("i_windows"))
    windows = stage_table(windows.drop("i_place", "part").distinct() if verbatim else windows.join(counted, ["item_id", "part"]), "items")
    blocks = -(-windows.count() // BLOCK_WINDOWS) or 1
    out = None
    for block in range(blocks):
        some = windows.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block) if blocks > 1 else windows
        drawn = np.array([(r["pattern"], r["i_exact"]) for r in some.select("pattern", "i_exact").distinct().collect()], np.int64).reshape(-1, 2).view(np.uint64)
        wanted = np.unique(_joint(drawn[:, 0], drawn[:, 1]) if verbatim else drawn[:, 0])
        names_file, wanted_file = publish_file(spark, names.tobytes(), "names"), publish_file(spark, wanted.tobytes(), "windows")

        def find(batches: Iterator[pa.RecordBatch], names_file=names_file, wanted_file=wanted_file, n=len(wanted)) -> Iterator[pa.RecordBatch]:
            if n:
                known = np.fromfile(SparkFiles.get(names_file), np.uint64)
                yield from _rows(batches, known, np.memmap(SparkFiles.get(wanted_file), np.uint64, "r"), verbatim, least_literals)

        hits = arrow_mapped(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), find, _ROW.format(kind=doc_kind))
        some = broadcast_if_bounded(some)
        joined = hits.join(some.withColumn("exact", F.col("i_exact")), _KEY).where("slots = i_slots") if verbatim else hits.join(some, "pattern").where(F.size("slots") == F.size("i_slots"))
        out = joined if out is None else out.unionByName(joined)
    return out.withColumnRenamed("key", key)


def leaked_items(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id), distinct: ``WINDOW`` consecutive words of the item's question or passage stand in the document.

    Words are runs of letters and digits, compared without case and accents; combining marks vanish first. Null and
    empty texts, items shorter than a window and empty tables give no rows. Null keys of documents come out as null.
    """
    return template_matches(docs.select(key, text), items, key, text, verbatim=True).select(key, "item_id").distinct()


def reparameterised_items(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", least_literals: int = LEAST_LITERALS, least_share: float = LEAST_SHARE) -> DataFrame:
    """(doc_id, item_id, part, windows, replaced), distinct: items whose template stands in a document with other slot words.

    Windows are put together by alignment, that is how far the document's place is from the item's; one alignment is one
    occurrence. In it, ``least_share`` of the part's windows with ``least_literals`` words outside slots must be there,
    whether their slots changed or not; each slot word of the item must stand for one word of the document and the other
    way round; and at least one must differ. So an item with one number changed is found although most of its windows are
    verbatim, a verbatim copy is not, and a document with both has the changed one reported. A slot takes one word, as it
    did in the item. ``windows`` are those of the best alignment, ``replaced`` its slot words that differ. Null texts and
    empty tables give no rows.
    """
    found = template_matches(docs.select(key, text), items, key, text, least_literals=least_literals)
    pairs = F.array_distinct(F.flatten(F.collect_set(F.arrays_zip("i_slots", "slots"))))
    grouped = found.groupBy(key, "item_id", "part", "i_windows", F.col("place") - F.col("i_place")).agg(F.count_distinct("i_place").alias("windows"), pairs.alias("__p"))
    one = lambda field: F.size(F.array_distinct(F.transform("__p", lambda p: p[field]))) == F.size("__p")
    replaced = F.size(F.filter("__p", lambda p: p["i_slots"] != p["slots"])).cast("bigint")
    changed = grouped.where((F.col("windows") >= F.col("i_windows") * least_share) & one("i_slots") & one("slots")).withColumn("replaced", replaced).where("replaced > 0")
    best = changed.groupBy(key, "item_id", "part").agg(F.max(F.struct("windows", "replaced")).alias("b"))
    return best.select(key, "item_id", "part", "b.windows", "b.replaced")
