"""Text that looks the same in one consistent form, by SQL that DuckDB runs inside each Arrow batch."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.sources.tables import arrow_mapped, broadcast_if_bounded, stage_table

# Letters of other scripts, and of phonetic ones, that look like the Latin ones under them.
_LETTERS = (
    ("АВЕЅІЈКМНОРСТУХаеѕіјкорсухһԁԛԝүҮӏӀԌԚԜѴѵ", "ABESIJKMHOPCTYXaesijkopcyxhdqwyYlIGQWVv"),
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαικνορυχ", "ABEZHIKMNOPTYXaikvopux"),
    ("ՍՏՕԼոօհցսզɑɡ", "USOLnohguqag"),
    ("ᎠᎪᎬᎫᎥᎻᏀᏂᏃᏒᏙᏚᏞᏟᏢᏤᏦᏴᎷᎳᎢ", "DAEJiHGhZRVSLCPVKBMWT"),
    ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"),
    ("ⲞⲟⲢⲣⲤⲥⲔⲘⲚⲦⲨⲬⲎⲒⲌ", "OoPpCcKMNTYXHIZ"),
)
_HYPHENS = "\u2010\u2011"
# Kinds of compatibility forms that look different from what they stand for; invisible characters.
_DIFFERENT = ("<super>", "<sub>", "<fraction>", "<circle>")
_UNSEEN = [
    0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, *range(0x180B, 0x1810), *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065),
    *range(0x2066, 0x2070), 0x3164, *range(0xFE00, 0xFE10), 0xFEFF, 0xFFA0, *range(0xE0000, 0xE0080), *range(0xE0100, 0xE01F0),
]
#: Members of a class of copies that are paired with each other class's in full; rows of a look that meet in one block.
MOST_COPIES, MOST_VARIANTS = 50, 1000
_SLICE_BYTES = 4 << 20


def _latin() -> dict[str, str]:
    """Each look-alike letter to its Latin one, without accents."""
    return {a: b for one, two in _LETTERS for a, b in zip(one, two, strict=True)}


def _plain(c: str, latin: dict[str, str]) -> str:
    """What a character looks like: its canonical parts, and those of compatibility forms that look alike, in Latin letters."""
    kind, *parts = (unicodedata.decomposition(c) or "-").split()
    if kind == "-" or kind in _DIFFERENT:
        return latin.get(c, c)
    if kind.startswith("<"):
        if unicodedata.category(c) == "Zs":
            return " "
        if parts[0] == "0020":
            return c  # an accent that stands by itself
    else:
        parts = [kind, *parts]
    return "".join(_plain(chr(int(p, 16)), latin) for p in parts)


@functools.cache
def forms() -> dict[str, str]:
    """Every character that has another consistent form, with it: from the decompositions of Unicode and the letters above."""
    latin, out = _latin() | dict.fromkeys(_HYPHENS, "-") | {"\u1680": " "}, {}
    decomposition = unicodedata.decomposition
    for c in map(chr, (*range(0xA0, 0xD800), *range(0xE000, 0x323B0), *range(0xE0000, 0xE01F0))):  # no other plane has any
        if decomposition(c) or c in latin:
            form = unicodedata.normalize("NFC", _plain(c, latin))
            if form != unicodedata.normalize("NFC", c):
                out[c] = form
    return {c: f for c, f in out.items() if ord(c) not in _UNSEEN}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _one_of(codes: list[int]) -> str:
    """A regular expression for one of these code points."""
    ranges: list[list[int]] = []
    for c in sorted(codes):
        if ranges and c == ranges[-1][1] + 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "[" + "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"


def consistent_sql(column: str) -> str:
    """SQL of DuckDB for the consistent form of a string column: without invisible characters, with compatibility forms as what
    they stand for (but for superscripts, subscripts, fractions and circled ones), blanks of any kind as a plain blank and
    look-alike letters as Latin ones, composed at the end, so that accents join the Latin letter. Case, accents,
    superscripts and digits stay. The variable ``forms`` must hold the forms of several characters.

    Each step asks first whether there is anything to do, as translate builds its table for every text."""
    one = {c: f for c, f in forms().items() if len(f) == 1}
    several = [ord(c) for c, f in forms().items() if len(f) != 1]
    unseen, singles, many = _quoted(_one_of(_UNSEEN)), _quoted(_one_of([ord(c) for c in one])), _quoted(_one_of(several))
    seen = f"CASE WHEN regexp_matches({column}, {unseen}) THEN regexp_replace({column}, {unseen}, '', 'g') ELSE {column} END"
    spelled = f"list_reduce(list_prepend(x, list_distinct(regexp_extract_all(x, {many}))), lambda t, c: replace(t, c, getvariable('forms')[c]))"
    translated = f"translate(x, {_quoted(''.join(one))}, {_quoted(''.join(one.values()))})"
    for test, step in ((many, spelled), (singles, translated)):
        seen = f"list_transform([{seen}], lambda x: CASE WHEN regexp_matches(x, {test}) THEN {step} ELSE x END)[1]"
    return f"nfc_normalize({seen})"


def _formed(batches: Iterator[pa.RecordBatch], fields: list[str]) -> Iterator[pa.RecordBatch]:
    import duckdb

    con = duckdb.connect(config={"threads": "1", "memory_limit": "512MB"})
    several = pa.table({"c": [c for c, f in forms().items() if len(f) != 1], "f": [f for f in forms().values() if len(f) != 1]})
    con.register("several", several)
    con.execute("SET VARIABLE forms = (SELECT map(list(c), list(f)) FROM several)")
    for batch in batches:
        names = batch.schema.names
        columns = ", ".join(f"{consistent_sql(_name(n))} AS {_name(n)}" if n in fields else _name(n) for n in names)
        # Slices of about as many bytes; a longer text is one of its own.
        size = sum((pc.fill_null(pc.binary_length(batch.column(n)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for n in fields), np.full(batch.num_rows, 64))
        part_of = (np.cumsum(size) - size) // _SLICE_BYTES
        starts = np.flatnonzero(np.append(True, part_of[1:] != part_of[:-1])) if batch.num_rows else []
        for a, b in zip(starts, np.append(starts[1:], batch.num_rows)):
            part = pa.Table.from_batches([batch.slice(a, b - a)])
            con.register("part", part)
            found = con.sql(f"SELECT {columns} FROM part").to_arrow_table()
            con.unregister("part")
            yield from found.cast(part.schema).combine_chunks().to_batches()
    con.close()


def _name(column: str) -> str:
    return '"' + column.replace('"', '""') + '"'


def consistent(df: DataFrame, fields: list[str]) -> DataFrame:
    """``df`` with the given string columns in consistent form; nulls stay null, empty texts empty, and all other columns as
    they are (of types that Arrow and DuckDB share). Forms that look the same become equal. Nothing is shuffled."""
    return arrow_mapped(df, lambda b: _formed(b, fields), df.schema)


def _rows(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(field_name, form1, form2, raw, id), distinct: the form by two 64-bit hashes, the stored text by one."""
    doubled = df.select(F.col(key).alias("id"), *(F.col(f).alias(f"f{n}") for n, f in enumerate(fields)), *(F.xxhash64(f).alias(f"r{n}") for n, f in enumerate(fields)))
    formed = consistent(doubled, [f"f{n}" for n in range(len(fields))])
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f"f{n}").alias("form"), F.col(f"r{n}").alias("raw")) for n, f in enumerate(fields))))
    rows = formed.select("id", each.alias("x")).select("x.*", "id").where(F.col("form").isNotNull() & F.col("id").isNotNull())
    return rows.select("field_name", F.xxhash64("form").alias("form1"), F.xxhash64(F.lit(1), F.reverse("form")).alias("form2"), "raw", "id").distinct()


_FORM = ["field_name", "form1", "form2"]


def _several(rows: DataFrame) -> DataFrame:
    """The rows of forms that are stored in more than one way."""
    kinds = rows.groupBy(*_FORM).agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo <> hi").select(*_FORM)
    return rows.join(kinds, _FORM)


def look_alike_pairs(df: DataFrame, key: str = "document_id", fields: tuple[str, ...] = ("title", "text")) -> DataFrame:
    """(field_name, key_a, key_b), key_a < key_b, distinct: different keys whose field looks the same but is not equal.

    Null fields and keys take no part. Of a group of more than MOST_COPIES keys with equal text the first so many are
    paired with those of every other stored form, the others with the first of each: no text loses its link. Stored forms
    of a look are all paired, however many; their pairs are spread over blocks of about MOST_VARIANTS rows.
    look_alike_classes gives all groups whole, whatever their size.
    """
    rows = stage_table(_several(stage_table(_rows(df, key, list(fields)), "forms")), "looks")
    # Window limits go below the shuffle, so that no task ranks a whole group of copies.
    in_raw = Window.partitionBy(*_FORM, "raw").orderBy("id")
    ranked = rows.withColumn("copy", F.row_number().over(in_raw)).where(F.col("copy") <= MOST_COPIES)
    few = ranked.select(*_FORM, "raw", "id", (F.col("copy") == 1).alias("first"))
    rest = rows.join(few.select(*_FORM, "raw", "id"), [*_FORM, "raw", "id"], "left_anti")

    def blocks(of: DataFrame) -> DataFrame:
        n = of.groupBy(*_FORM).agg(F.ceil(F.count(F.lit(1)) / MOST_VARIANTS).cast("int").alias("blocks"))
        return broadcast_if_bounded(n.where("blocks > 1"))

    def met(one: DataFrame, two: DataFrame, on: list[str], condition: str) -> DataFrame:
        x, y = one.alias("x"), two.alias("y")
        found = x.join(y, [F.col(f"x.{c}") == F.col(f"y.{c}") for c in _FORM + on] + [F.expr(condition)])
        a, b = F.col("x.id"), F.col("y.id")
        return found.select(F.col("x.field_name").alias("field_name"), F.least(a, b).alias(f"{key}_a"), F.greatest(a, b).alias(f"{key}_b"))

    count, own = F.coalesce("blocks", F.lit(1)), F.pmod(F.xxhash64("raw", "id"), F.coalesce("blocks", F.lit(1))).cast("int")
    # Every pair of blocks meets once: within a block as x.id < y.id, between two as the lower with the higher.
    placed = few.join(blocks(few), _FORM, "left").select(*_FORM, "raw", "id", own.alias("own"), F.explode(F.sequence(F.lit(0), count - 1)).alias("other"))
    placed = placed.select(*_FORM, "raw", "id", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    pairs = met(placed, placed, ["low", "high"], "x.raw <> y.raw and x.id <> y.id and (x.own < y.own or (x.own = y.own and x.low = x.high and x.id < y.id))")
    # Further copies meet the first of every other stored form.
    many = blocks(rest)
    copies = rest.join(many, _FORM, "left").select(*_FORM, "raw", "id", own.alias("own"))
    firsts = few.where("first").join(many, _FORM, "left").select(*_FORM, "raw", "id", F.explode(F.sequence(F.lit(0), count - 1)).alias("own"))
    return pairs.unionByName(met(copies, firsts, ["own"], "x.raw <> y.raw and x.id <> y.id")).distinct()


def look_alike_classes(df: DataFrame, key: str = "document_id", fields: tuple[str, ...] = ("title", "text")) -> DataFrame:
    """(field_name, key, class_id, stored_forms, keys): a row for each key whose field looks like another that is stored in
    a different way. class_id is the least key of its look, stored_forms how many ways there are, keys how many keys."""
    rows = _several(stage_table(_rows(df, key, list(fields)), "forms"))
    classes = rows.groupBy(*_FORM).agg(F.min("id").alias("class_id"), F.count_distinct("raw").alias("stored_forms"), F.count_distinct("id").alias("keys"))
    return rows.join(classes, _FORM).where(F.col("keys") > 1).select("field_name", F.col("id").alias(key), "class_id", "stored_forms", "keys").distinct()
