"""Splitting of oversized texts at natural boundaries, where the vocabulary changes most.

White space is a boundary of a paragraph, a sentence or a word. Blocks of words slide over the text; where the block
before a boundary and the one after it have the least in common, the similarity has a valley. Inside each window of
sizes a piece may have, the cut is made at the most natural boundary there, and of those in the deepest valley.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.sources.tables import arrow_mapped

#: Tokens of a piece, and of what it repeats of the end of the one before.
MOST_TOKENS, OVERLAP_TOKENS = 700, 80
LEVELS = ("paragraph", "sentence", "word", "character")
#: Words of a sliding block, and the least share of its room that a piece uses if a cut allows it.
_BLOCK_WORDS, _LEAST_FILL = 80, 0.5
_STRETCH = 1024  # words counted at once
_RUN = regex.compile(r"\s+")
_OPENER = regex.compile(r"[\p{Lu}\p{Nd}]")


def tokens(n_bytes: int) -> int:
    """UTF-8 bytes / 3.4, rounded up."""
    return -(-n_bytes * 5 // 17)


def room(n_tokens: int) -> int:
    """The most bytes that so many tokens have."""
    return n_tokens * 17 // 5


class _Text:
    """A text's words (runs without white space) and the kind of boundary before each: 0 paragraph, 1 sentence, 2 word."""

    def __init__(self, text: str):
        self.text = text
        cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.bytes = np.concatenate([[0], np.cumsum(1 + (cps >= 0x80) + (cps >= 0x800) + (cps >= 0x10000).astype(np.int64))])
        starts, ends, kinds = [0], [], [0]
        for m in _RUN.finditer(text):
            a, b = m.span()
            if b == len(text):
                ends.append(a)
                break
            if a == 0:
                starts[0] = b
                continue
            ends.append(a)
            starts.append(b)
            run = m.group()
            kinds.append(0 if run.count("\n") > 1 else 1 if text[a - 1] in ".!?" and _OPENER.match(text, b) else 2)
        if len(ends) < len(starts):
            ends.append(len(text))
        self.starts, self.ends, self.kinds = np.array(starts), np.array(ends), np.array(kinds)

    def size(self, a: int, b: int) -> int:
        return int(self.bytes[b] - self.bytes[a])

    def level(self, most: int) -> int:
        """The coarsest level at which every unit has at most so many bytes."""
        for level in range(3):
            first = np.flatnonzero(self.kinds <= level)
            last = np.append(first[1:], len(self.kinds)) - 1
            if (self.bytes[self.ends[last]] - self.bytes[self.starts[first]]).max() <= most:
                return level
        return 3

    def similarities(self, at: np.ndarray) -> np.ndarray:
        """For the boundaries before these words, the cosine of the counts of words in the blocks before and after; 0 at the start.

        Words are counted along the text, a stretch of words with its own vocabulary at a time; the counts of a block are
        the difference of two places."""
        named: dict[str, int] = {}
        words = np.array([named.setdefault(self.text[a:b].strip(".,;:!?()[]\"'«»“”").lower(), len(named)) for a, b in zip(self.starts.tolist(), self.ends.tolist())])
        k, out = _BLOCK_WORDS, np.zeros(len(at))
        for first in range(0, len(words), _STRETCH):
            some = np.flatnonzero((at >= first) & (at < first + _STRETCH))
            if not len(some):
                continue
            begin, stop = max(0, first - k), min(len(words), first + _STRETCH + k)
            known, own = np.unique(words[begin:stop], return_inverse=True)
            counts = np.zeros((stop - begin + 1, len(known)), np.int32)
            counts[np.arange(1, stop - begin + 1), own] = 1
            np.cumsum(counts, axis=0, out=counts)
            here = at[some] - begin
            until = counts[here]
            left, right = until - counts[np.maximum(here - k, 0)], counts[np.minimum(here + k, stop - begin)] - until
            norm = np.sqrt((left * left).sum(1).astype(float) * (right * right).sum(1))
            out[some] = (left * right).sum(1) / np.where(norm > 0, norm, 1)
        return out


def _valleys(similarity: np.ndarray) -> np.ndarray:
    """How far the similarity climbs on both sides of each place."""

    def peaks(s: np.ndarray) -> np.ndarray:
        # Where the stretch that has only fallen up to here began.
        falls = np.append(False, s[:-1] >= s[1:])
        return s[np.maximum.accumulate(np.where(falls, 0, np.arange(len(s))))]

    return peaks(similarity) + peaks(similarity[::-1])[::-1] - 2 * similarity


def _overlap(t: _Text, begin: int, end: int, start: int, stop: int, most: int, most_tokens: int) -> int:
    """Where a piece that adds text[start:stop] begins, so that it repeats up to ``most`` bytes of the end of the piece
    text[begin:end] before it: at a word, or inside the last one if that alone is too long; start if nothing fits."""
    most = min(most, room(most_tokens) - t.size(end, stop))
    if most <= 0:
        return start
    at = int(np.searchsorted(t.bytes, t.bytes[end] - most))
    at = max(at, begin)
    word = int(np.searchsorted(t.starts, at))
    if word < len(t.starts) and t.starts[word] < end:
        return int(t.starts[word])
    return at if at < end else start


def pieces(text: str, most_tokens: int = MOST_TOKENS, overlap_tokens: int = OVERLAP_TOKENS) -> tuple[str | None, list[tuple[int, int]]]:
    """(level, [(start, end)]) of a text: its pieces as places in it, each with what it repeats. The level is the finest
    boundary at which a cut was made: as cuts are made at no finer one than the text needs, and a unit that is too long is
    always cut, it is the coarsest level that does. A text of at most ``most_tokens`` is one piece and has no level; one of
    white space only has no piece."""
    if not text.strip():
        return None, []
    t = _Text(text)
    if tokens(int(t.bytes[-1])) <= most_tokens:
        return None, [(0, len(text))]
    body = room(most_tokens - overlap_tokens)
    level = t.level(body)
    allowed = np.flatnonzero(t.kinds <= level)  # words before which a cut may be
    similarity, used = np.zeros(len(t.kinds)), 0
    similarity[allowed] = t.similarities(allowed)
    depth = np.zeros(len(t.kinds))
    for kind in range(min(level, 2) + 1):
        # A boundary is compared with those as natural as itself.
        same = np.flatnonzero(t.kinds <= kind)
        own = t.kinds[same] == kind
        depth[same[own]] = _valleys(similarity[same])[own]
    cuts: list[tuple[int, int]] = []
    start, last = int(t.starts[0]), int(t.ends[-1])
    while t.size(start, last) > body:
        # Boundaries whose piece ends within the room.
        stop = int(np.searchsorted(t.bytes[t.ends], t.bytes[start] + body, side="right"))
        lo = int(np.searchsorted(t.starts, start, side="right"))
        a, b = np.searchsorted(allowed, [lo, stop], side="left")
        if b < len(allowed) and allowed[b] == stop and stop < len(t.starts):
            b += 1
        inside = allowed[a:b]
        if len(inside):
            full = inside[t.bytes[t.ends[inside - 1]] - t.bytes[start] >= body * _LEAST_FILL]
            if len(full):
                finest = full[t.kinds[full] == t.kinds[full].min()]
                cut = int(finest[len(finest) - 1 - int(np.argmax(depth[finest][::-1]))])
            else:
                cut = int(inside[-1])
            used = max(used, int(t.kinds[cut]))
            cuts.append((start, int(t.ends[cut - 1])))
            start = int(t.starts[cut])
        else:
            # A word too long for a piece: as many characters as fit.
            end = int(np.searchsorted(t.bytes, t.bytes[start] + body, side="right")) - 1
            cuts.append((start, end))
            start, used = end, 3
    cuts.append((start, last))
    out = [cuts[0]]
    for before, (a, b) in zip(cuts, cuts[1:]):
        out.append((_overlap(t, before[0], before[1], a, b, room(overlap_tokens), most_tokens), b))
    return LEVELS[used], out


def _split(batches: Iterator[pa.RecordBatch], most: int, overlap: int) -> Iterator[pa.RecordBatch]:
    names = ["row", "chunk_index", "piece", "token_count", "cut_at", "piece_start", "piece_end"]
    kinds = (pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32())
    for batch in batches:
        keys = pa.Table.from_batches([batch.select(range(1, batch.num_columns))])
        columns: list[list] = [[] for _ in names]
        size = 0

        def made() -> pa.RecordBatch:
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            own = keys.take(arrays[0]).combine_chunks()
            for c in columns:
                c.clear()
            return pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in own.columns), *arrays[1:]], names=[*own.column_names, *names[1:]])

        for row, value in enumerate(batch.column(0)):
            text = value.as_py()
            if text is None:
                continue
            level, found = pieces(text, most, overlap)
            for n, (a, b) in enumerate(found):
                piece = text[a:b]
                for c, v in zip(columns, (row, n, piece, tokens(len(piece.encode())), level, a, b)):
                    c.append(v)
                size += b - a
            if size > 4_000_000:
                yield made()
                size = 0
        if columns[0]:
            yield made()


def split_oversized(df: DataFrame, keys: list[str], text: str = "text", most_tokens: int = MOST_TOKENS, overlap_tokens: int = OVERLAP_TOKENS) -> DataFrame:
    """(keys…, chunk_index, piece, token_count, cut_at, piece_start, piece_end) of the texts over ``most_tokens`` tokens.

    Pieces are numbered from 0 and are stretches of the text in code points (end exclusive), none with more than
    ``most_tokens``; each after the first begins with up to ``overlap_tokens`` of the end of the one before. cut_at is
    the coarsest level that allows this for the whole text. Only the white space between pieces stands in no piece.
    Texts within the limit, null and blank ones give no rows; rows that repeat give their pieces again. Keys may have any
    names but those of the result. The size is filtered before Python, and nothing is shuffled.
    """
    chosen = df.where(F.octet_length(text) > room(most_tokens)).select(F.col(text).alias("__text"), *keys)
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return arrow_mapped(
        chosen,
        lambda b: _split(b, most_tokens, overlap_tokens),
        f"{kinds}, chunk_index int, piece string, token_count int, cut_at string, piece_start int, piece_end int",
    )
