"""Text functions as column expressions. Rewriting is a list of (pattern, replacement) steps."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

Steps = list[tuple[str, str]]

#: White space of Unicode, and the same without the line feed; both engines' \s is narrower.
WS = r"[\s\x0B\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
WS_IN_LINE = r"[ \t\r\f\x0B\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
STRIP: Steps = [(f"^{WS}+", ""), (f"{WS}+$", "")]
COLLAPSE: Steps = [(f"{WS}+", " "), ("^ | $", "")]
#: One line feed for each kind of line end, one blank for blanks and tabs, no blanks at line ends, one empty line at most.
NORMALIZE: Steps = [
    (r"\r\n", "\n"), (r"\x{FEFF}", ""), (r"[\r\x0B\x0C\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]", "\n"),
    (r"[ \t]+", " "), (f"{WS_IN_LINE}+\n", "\n"), (r"\n{3,}", "\n\n"), *STRIP,
]
#: The same for page text: lines lose blanks at both ends.
TIDY_PAGE: Steps = [
    (r"\r\n", "\n"), (r"[\r\x0B\x0C\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]", "\n"), (r"[ \t]+", " "),
    (f"{WS_IN_LINE}+\n", "\n"), (f"\n{WS_IN_LINE}+", "\n"), (r"\n{3,}", "\n\n"), *STRIP,
]
#: Markdown and markup to plain text, in this order; entities are left to unescape().
PLAIN: Steps = [
    (r"!\[[^\]]*\]\([^)]+\)", ""), (r"\[([^\]]+)\]\((https?://[^)]+)\)", "$1 ($2)"), (r"(?m)^\s{0,3}#{1,6}\s*", ""), (r"[*_~]{1,3}", ""),
    (r"(?m)^\s*>\s?", ""), (r"(?s)```.*?```", ""), (r"(?is)<script\b[^>]*>.*?</script\s*>", ""), (r"(?is)<style\b[^>]*>.*?</style\s*>", ""),
    (r"(?s)<!--.*?-->", ""), (r"<[^>]+>", " "),
]
MARKERS: Steps = [(r"\[S\d+\]", " "), *COLLAPSE]
SENTENCE_BREAK = rf"([.!?]){WS}+([A-ZÇË0-9])"
PARAGRAPH_BREAK = rf"\n{WS}*\n"


def rewritten(col: Column, steps: Steps) -> Column:
    return reduce(lambda c, s: F.regexp_replace(c, s[0], s[1]), steps, col)


@F.pandas_udf(StringType())
def unescaped(values: pd.Series) -> pd.Series:
    """Character references resolved, by the standard's table of more than two thousand names, in one Arrow pass."""
    import html

    return values.map(lambda v: html.unescape(v) if "&" in v else v, na_action="ignore")


def normalized(col: Column) -> Column:
    return rewritten(col, NORMALIZE)


def token_estimate(col: Column) -> Column:
    """UTF-8 bytes / 3.4 rounded up, at least 1; 0 for an empty text, null for null."""
    return F.when(col == "", 0).when(col.isNotNull(), F.greatest(F.lit(1), F.ceil(F.octet_length(col) / F.lit(3.4)))).cast("bigint")


def stable_id(*parts: Column) -> Column:
    """The first 32 hexadecimal digits of SHA-256 over the parts with zero bytes between them."""
    return F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, 32)


def paragraphs(col: Column) -> Column:
    return F.filter(F.transform(F.split(col, PARAGRAPH_BREAK), lambda p: rewritten(p, STRIP)), lambda p: p != "")


def sentences(col: Column) -> Column:
    """Sentences end at white space between a stop and a capital or digit; the mark between is a control character."""
    return F.filter(F.transform(F.split(F.regexp_replace(col, SENTENCE_BREAK, "$1\x01$2"), "\x01"), lambda s: rewritten(s, STRIP)), lambda s: s != "")


def excerpt(col: Column, most: int = 280) -> Column:
    """The text, or its beginning up to a word's end within ``most`` characters, with an ellipsis."""
    return F.when(F.length(col) <= most, col).otherwise(F.concat(F.regexp_replace(F.substring(col, 1, most - 1), " [^ ]*$", ""), F.lit("…")))


def first_title(text: Column, fallback: Column) -> Column:
    """The first line of 3 to 140 characters, without heading marks; else the fallback in title case."""
    lines = F.transform(F.split(text, r"\r\n|[\n\r\x0B\x0C\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"), lambda x: rewritten(x, [*STRIP, ("^#+", ""), *STRIP]))
    fits = F.filter(lines, lambda x: F.length(x).between(3, 140))
    return F.coalesce(F.get(fits, F.lit(0)), F.initcap(F.translate(fallback, "-_", "  ")))


@F.pandas_udf(StringType())
def folded(values: pd.Series) -> pd.Series:
    """Without case and accents, white space collapsed."""
    import unicodedata

    def fold(v: str) -> str:
        return " ".join("".join(c for c in unicodedata.normalize("NFKD", v.casefold()) if not unicodedata.combining(c)).split())

    return values.map(fold, na_action="ignore")


def clean_markup(col: Column) -> Column:
    """Entities resolved, tags dropped, white space collapsed."""
    return rewritten(unescaped(col), [(r"<[^>]*>", " "), *COLLAPSE])


def joined_text(*parts: Column) -> Column:
    """The parts that are not null or empty, trimmed of blanks but for the last, with empty lines between them."""
    return F.concat_ws("\n\n", *(F.nullif(F.trim(p), F.lit("")) for p in parts[:-1]), F.nullif(parts[-1], F.lit("")))


def hash_embedding(col: Column, width: int = 8) -> Column:
    """A deterministic vector: each word counts in the bucket of the first byte of its SHA-256; the result has length 1.

    A stand-in for an embedding model wherever one would be called."""
    words = F.filter(F.split(F.lower(col), f"{WS}+"), lambda w: w != "")
    buckets = F.transform(words, lambda w: F.conv(F.substring(F.sha2(w, 256), 1, 2), 16, 10).cast("int") % width)
    counts = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda b: F.size(F.filter(buckets, lambda x: x == b)).cast("double"))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c))
    return F.transform(counts, lambda c: F.when(norm > 0, c / norm).otherwise(0.0))


# Words by which a question is known to be in Albanian.
ALBANIAN_WORDS = ("çfarë", "është", "për", "dhe", "nga", "revolucioni", "shqipëri", "diaspora")


def said_in_albanian(question: Column, words: tuple[str, ...] = ALBANIAN_WORDS) -> Column:
    """Whether a question is in Albanian: by its letters or its commonest words."""
    said = F.transform(F.split(question, f"{WS}+"), lambda w: F.lower(F.regexp_replace(w, r"^[.,!?;:()\[\]\"']+|[.,!?;:()\[\]\"']+$", "")))
    return F.lower(question).rlike("[çë]") | F.arrays_overlap(said, F.array(*map(F.lit, words)))
