"""Several values packed in one field, as one row a value with its position."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A mark in front of a delimiter that belongs to an address, and the one that tells a real mark apart.
_MARK, _REAL = "\uffff", "\ufffe"
#: An address up to a comma or semicolon directly before a letter or digit, unless another address starts there.
_IN_ADDRESS = r"((?:(?i:https?)://|\G(?<!^))[^\s,;|]*)([,;])(?=[\p{L}\p{N}])(?!(?i:https?)://)"
_DELIMITER = rf"(?<!{_MARK})[,;]|[|\t\r\n\x0b\x0c\x85\x{{2028}}\x{{2029}}]"
_BLANKS = r"(?U)^\s+|\s+$"
_EMPTY_FIELDS = ("", "-", "n/a")


def _trimmed(col: Column) -> Column:
    return F.regexp_replace(col, _BLANKS, "")


def _plain_values(piece: Column) -> Column:
    """An unquoted piece cut at its delimiters."""
    kept = F.replace(piece, F.lit(_MARK), F.lit(_MARK + _REAL))
    kept = F.regexp_replace(kept, _IN_ADDRESS, f"$1{_MARK}$2")
    restore = lambda v: reduce(
        lambda c, ab: F.replace(c, F.lit(ab[0]), F.lit(ab[1])), ((_MARK + ",", ","), (_MARK + ";", ";"), (_MARK + _REAL, _MARK)), v
    )
    return F.transform(F.split(kept, _DELIMITER, -1), restore)


def packed_values(col: Column) -> Column:
    """The values packed in a string, in order, as an array; null for a null string.

    Values are divided by line breaks, commas, semicolons, bars or tabs, mixed. ``"…"`` (inner quotes doubled) and
    ``“…”`` protect what they hold and are dropped; whichever opens first holds the other. In an unquoted http(s)
    address a comma or semicolon directly before a letter or digit belongs to it, unless another address starts
    there. Values are trimmed and empty ones left out, repeats kept. A field that is only ``-`` or ``n/a`` (either
    case) has no values. A quote that is never closed protects the rest of the field; a ``”`` that closes nothing is an
    ordinary character at which an address ends.

    The field is split at its quote characters; a fold over the pieces keeps which quote is open. Pieces between an
    opening and a closing quote are literals, the others are split on delimiters, and the first and last of those
    values join what stands directly beside them. Two literals with nothing between them are one with a quote in it.
    """
    pieces = F.split(col, "(?=[\"“”])|(?<=[\"“”])", -1)
    no_strings = F.array().cast("array<string>")
    start = F.struct(no_strings.alias("done"), F.lit("").alias("open"), F.lit("").alias("cur"), F.lit("").alias("before"))

    def state(done: Column, opened: Column, cur: Column, before: Column) -> Column:
        return F.struct(done.alias("done"), opened.alias("open"), cur.alias("cur"), before.alias("before"))

    def step(s: Column, both: Column) -> Column:
        done, opened, cur, before = (s[k] for k in ("done", "open", "cur", "before"))
        piece, values = both["piece"], both["values"]
        # before is '"' when the piece before this one closed a "…" literal.
        return (
            F.when((opened == "") & (piece == '"') & (before == '"'), state(done, F.lit('"'), F.concat(cur, F.lit('"')), F.lit("")))
            .when((opened == "") & piece.isin('"', "“"), state(done, piece, cur, F.lit("")))
            .when((opened == '"') & (piece == '"'), state(done, F.lit(""), cur, piece))
            .when((opened == "“") & (piece == "”"), state(done, F.lit(""), cur, F.lit("")))
            .when(opened != "", state(done, opened, F.concat(cur, piece), F.lit("")))
            .when(F.size(values) == 1, state(done, opened, F.concat(cur, F.element_at(values, 1)), F.lit("")))
            .otherwise(
                state(
                    F.concat(done, F.array(F.concat(cur, F.element_at(values, 1))), F.slice(values, F.lit(2), F.greatest(F.size(values) - 2, F.lit(0)))),
                    opened,
                    F.element_at(values, -1),
                    F.lit(""),
                )
            )
        )

    # Every piece is split once, before the fold, which looks at the values several times.
    split = F.transform(F.filter(pieces, lambda p: p != ""), lambda p: F.struct(p.alias("piece"), _plain_values(p).alias("values")))
    folded = F.aggregate(split, start, step, lambda s: F.concat(s["done"], F.array(s["cur"])))
    values = F.filter(F.transform(folded, _trimmed), lambda v: v != "")
    return F.when(F.lower(_trimmed(col)).isin(*_EMPTY_FIELDS), no_strings).otherwise(values)


def explode_packed(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, item_pos, item_value): each value of ``column`` as a row of its own, positions counting from 1.

    Null fields and fields without values give no rows. Rows that repeat give their values again under their key.
    No shuffle: the split runs inside the scan's tasks. Only the two named columns are read.
    """
    return df.select(F.col(key), F.posexplode(packed_values(F.col(column))).alias("__pos", "item_value")).select(
        key, (F.col("__pos") + 1).cast("int").alias("item_pos"), "item_value"
    )
