"""Texts of an Arrow batch as arrays of code points, so that whole batches are worked on without a loop per character."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
_TOP = 0x110000
#: Texts are worked on in groups of about this many bytes, which bounds a task's memory whatever a batch holds.
GROUP_BYTES = 1 << 20


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point: letter, number, white space or other."""
    import regex

    valid = [*range(0xD800), *range(0xE000, _TOP)]
    text, places = "".join(map(chr, valid)), np.array(valid)
    out = np.zeros(_TOP, np.uint8)
    for value, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, text):
            out[places[m.start() : m.end()]] = value
    return out


@functools.cache
def folded() -> np.ndarray:
    """Code point to its form without case and accents; 0 for combining marks, which vanish.

    A character whose form has several characters keeps itself in lower case where that is one character.
    """
    out = np.arange(_TOP, dtype=np.uint32)
    for cp in (*range(0xD800), *range(0xE000, 0x323B0)):
        if cp < 0x80:
            out[cp] = ord(chr(cp).lower())
            continue
        c = chr(cp)
        if unicodedata.category(c) == "Mn":
            out[cp] = 0
            continue
        low = c.lower()
        if low == c and not unicodedata.decomposition(c):
            continue
        bare = "".join(x for x in unicodedata.normalize("NFD", low) if unicodedata.category(x) != "Mn")
        if len(bare) == 1:
            out[cp] = ord(bare)
        elif len(low) == 1:
            out[cp] = ord(low)
    return out


@dataclass
class Texts:
    """Some texts one after the other. rows: the text's number in its batch; ends: the code points up to each text's
    end, so that text i is cps[ends[i - 1]:ends[i]]."""

    rows: np.ndarray
    cps: np.ndarray
    ends: np.ndarray
    data: bytes
    byte_ends: np.ndarray

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate([[0], self.ends[:-1]]).astype(np.int64)


def _decoded(rows: list[int], parts: list[bytes]) -> Texts:
    data = b"".join(parts)
    byte_ends = np.cumsum([len(p) for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64)
    cps = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
    if len(cps) == len(data):
        ends = byte_ends
    else:
        heads = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
        ends = heads[byte_ends]
    return Texts(np.array(rows, np.int64), cps, ends, data, byte_ends)


def _pieces(text: bytes, limit: int) -> Iterator[bytes]:
    """A long text cut in front of white space that follows an ASCII letter or digit: no token, word or run of white
    space goes over such a place. A stretch without one stays whole."""
    at = 0
    while len(text) - at > 2 * limit:
        cut = at + limit
        while (cut := text.find(b" ", cut)) > 0 and not chr(text[cut - 1]).isalnum():
            cut += 1
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def texts_of(column: pa.Array | pa.ChunkedArray, whole: bool = False, group_bytes: int = GROUP_BYTES) -> Iterator[Texts]:
    """The texts of a string column in groups; null ones are left out. Unless whole, a long text comes in pieces, which
    follow each other with the same row number."""
    rows: list[int] = []
    parts: list[bytes] = []
    size = 0
    for i, value in enumerate(column.cast(pa.large_binary())):
        if not value.is_valid:
            continue
        text = value.as_py()
        for piece in [text] if whole or len(text) <= 2 * group_bytes else _pieces(text, group_bytes):
            try:
                piece.decode("utf-8")
            except UnicodeDecodeError:
                piece = piece.decode("utf-8", "replace").encode("utf-8")
            rows.append(i)
            parts.append(piece)
            size += len(piece)
            if size >= group_bytes:
                yield _decoded(rows, parts)
                rows, parts, size = [], [], 0
    if rows:
        yield _decoded(rows, parts)


def hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A 64-bit hash of values[starts:ends] for each pair of places; a step for each place in the longest."""
    out = np.full(len(starts), seed, np.uint64)
    prime = np.uint64(0x100000001B3)
    lengths = ends - starts
    live = np.flatnonzero(lengths > 0)
    at = 0
    while len(live):
        h = out[live] ^ values[starts[live] + at]
        h *= prime
        h ^= h >> np.uint64(29)
        out[live] = h
        at += 1
        live = live[lengths[live] > at]
    return mixed(out)


def mixed(h: np.ndarray) -> np.ndarray:
    """The bits of 64-bit values well mixed."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))
