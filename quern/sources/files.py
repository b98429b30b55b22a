"""Files as tables: discovery, CSV, JSON under a closed schema, text, Markdown with front matter, and a registry of parsers."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.functions.text import PLAIN, STRIP, first_title, normalized, rewritten, stable_id, unescaped
from quern.sources.tables import pandas_mapped


@dataclass(frozen=True)
class Rule:
    """Files of a source: what to include and exclude, and the parser."""

    include: tuple[str, ...]
    parser: str
    exclude: tuple[str, ...] = ()
    options: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Source:
    id: str
    label: str
    base_url: str
    language: str
    rules: tuple[Rule, ...]
    optional: bool = False


def read_catalog(path: str) -> list[Source]:
    """A catalog of sources from YAML; unknown keys and repeated ids are errors."""
    import yaml

    with open(path, encoding="utf-8-sig") as f:
        raw = yaml.safe_load(f)
    sources = [Source(**{**s, "rules": tuple(Rule(**{**r, "include": tuple(r["include"]), "exclude": tuple(r.get("exclude", ()))}) for r in s["rules"])}) for s in raw["sources"]]
    if len({s.id for s in sources}) < len(sources):
        raise ValueError("a source id is used twice")
    return sources


def catalog_rules(spark: SparkSession, sources: list[Source]) -> DataFrame:
    """(source_id, label, base_url, language, optional, rule_no, parser, include, exclude): a row for each rule."""
    rows = [(s.id, s.label, s.base_url, s.language, s.optional, n, r.parser, list(r.include), list(r.exclude)) for s in sources for n, r in enumerate(s.rules)]
    return spark.createDataFrame(rows, "source_id string, label string, base_url string, language string, optional boolean, rule_no int, parser string, include array<string>, exclude array<string>")


def resolved(rules: DataFrame, roots: DataFrame) -> DataFrame:
    """Rules with their source's root from (source_id, root). Optional sources without one fall out; others are an error."""
    found = rules.join(roots, "source_id", "left").where(F.col("root").isNotNull() | ~F.col("optional"))
    absent = F.raise_error(F.concat(F.lit("no root for source "), F.col("source_id"))).cast("string")
    return found.withColumn("root", F.when(F.col("root").isNull(), absent).otherwise(F.col("root")))


def _expression(glob: str) -> str:
    """A glob as a regular expression: ``**/`` any directories, ``*`` and ``?`` inside a name."""
    import re

    parts = re.split(r"(\*\*/|\*\*|\*|\?)", glob)
    told = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "^" + "".join(told.get(p, re.escape(p)) for p in parts) + "$"


def discovered(files: DataFrame, rule: Rule, relative: str = "relative_path") -> DataFrame:
    """Files that an include names and no exclude does, each once."""
    any_of = lambda globs: F.coalesce(F.array_max(F.array(*(F.col(relative).rlike(_expression(g)) for g in globs))), F.lit(False)) if globs else F.lit(False)
    return files.where(any_of(rule.include) & ~any_of(rule.exclude)).dropDuplicates([relative])


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, relative_path, content, value) of every file below a directory; value is UTF-8 text without a byte order mark,
    bytes that are none being replaced."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content")
    relative = F.substring_index("path", root.removeprefix("file:").rstrip("/") + "/", -1)
    return raw.select("path", relative.alias("relative_path"), "content", F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), r"^\x{FEFF}", "").alias("value"))


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV file as trimmed strings, absent values empty: header, quotes doubled inside quotes, line feeds inside them."""
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', inferSchema=False, encoding="UTF-8")
    bare = raw.toDF(*(c.lstrip("\ufeff").strip() for c in raw.columns))
    return bare.select(*(F.coalesce(rewritten(F.col(f"`{c}`"), STRIP), F.lit("")).alias(c) for c in columns))


def read_json_closed(spark: SparkSession, path: str, schema: StructType | str, most_bytes: int = 16_000_000) -> DataFrame:
    """A JSON document of at most so many bytes under a closed schema: other keys, and what does not fit, are errors."""
    from pyspark.sql.types import _parse_datatype_string

    kind = schema if isinstance(schema, StructType) else _parse_datatype_string(schema)
    texts = spark.read.text(path, wholetext=True)
    large = F.raise_error(F.lit("the document is too large")).cast("string")
    text = F.when(F.octet_length("value") > most_bytes, large).otherwise(F.col("value"))
    keys = F.array_except(F.json_object_keys(text), F.array(*(F.lit(f.name) for f in kind.fields)))
    other = F.raise_error(F.concat(F.lit("unknown keys: "), F.array_join(keys, ", "))).cast("string")
    return texts.select(F.from_json(F.when(F.size(keys) > 0, other).otherwise(text), kind, {"mode": "FAILFAST"}).alias("d")).select("d.*")


def front_matter(files: DataFrame, key: str = "path", value: str = "value") -> DataFrame:
    """(key, meta, body): the YAML block at the head of a Markdown file as JSON, and the rest. A file without one has an
    empty object; one that is not a mapping counts as none."""

    def split(text: str) -> tuple[str, str]:
        import yaml

        if not text.startswith("---\n") or text.count("---") < 2:
            return "{}", text
        _, head, body = text.split("---", 2)
        told = yaml.safe_load(head)
        return json.dumps(told if isinstance(told, dict) else {}, default=str, ensure_ascii=False), body

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(k, *split(v)) for k, v in zip(f[key], f[value]) if isinstance(v, str)], columns=[key, "meta", "body"])

    return pandas_mapped(files.select(key, value), run, f"{key} string, meta string, body string")


def parsed_text(files: DataFrame) -> DataFrame:
    return files.select("relative_path", normalized(F.col("value")).alias("text"), F.lit("{}").alias("meta"))


def parsed_markdown(files: DataFrame) -> DataFrame:
    """Plain text of Markdown files; drafts fall out."""
    told = front_matter(files, "relative_path")
    draft = F.coalesce(F.get_json_object("meta", "$.draft").cast("boolean"), F.lit(False))
    return told.where(~draft).select("relative_path", normalized(unescaped(rewritten(F.col("body"), PLAIN))).alias("text"), "meta")


def parsed_literals(files: DataFrame) -> DataFrame:
    from quern.sources.literals import literal_texts

    return literal_texts(files, "relative_path").withColumn("meta", F.lit("{}"))


#: Parsers by name: files (relative_path, value) to (relative_path, text, meta). Others may be registered.
PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {"text": parsed_text, "markdown": parsed_markdown, "string_literals": parsed_literals}


def parser(name: str) -> Callable[[DataFrame], DataFrame]:
    try:
        return PARSERS[name]
    except KeyError:
        raise ValueError(f"there is no parser {name}") from None


def documents(source: Source, rule: Rule, files: DataFrame, least: int = 40) -> tuple[DataFrame, DataFrame]:
    """(documents, issues) of the files of a rule. Documents: document_id, source_id, source_label, relative_path,
    canonical_url, language, content_type, title, text, metadata, revision. Issues: (relative_path, reason) of files with
    less than ``least`` characters of text."""
    found = discovered(files, rule)
    told = parser(rule.parser)(found).join(found.select("relative_path", F.sha2("content", 256).alias("revision")), "relative_path")
    stem: Column = F.regexp_replace(F.regexp_extract("relative_path", r"([^/]+)$", 1), r"\.[^.]*$", "")
    title = F.coalesce(F.nullif(F.trim(F.get_json_object("meta", "$.title")), F.lit("")), first_title(F.col("text"), stem))
    url = F.coalesce(F.get_json_object("meta", "$.canonical_url"), F.lit(source.base_url.rstrip("/") + "/"))
    good = F.length("text") >= least
    docs = told.where(good).select(
        stable_id(F.lit(source.id), F.col("relative_path"), F.lit("")).alias("document_id"), F.lit(source.id).alias("source_id"), F.lit(source.label).alias("source_label"), "relative_path",
        url.alias("canonical_url"), F.lit(source.language).alias("language"), F.lit(rule.parser).alias("content_type"), title.alias("title"), "text", F.col("meta").alias("metadata"), "revision",
    )
    return docs, told.where(~F.coalesce(good, F.lit(False))).select("relative_path", F.lit("no meaningful text").alias("reason"))
