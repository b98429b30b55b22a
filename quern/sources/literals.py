"""Program sources as data: string literals, and arrays of object literals with typed fields."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from quern.sources.tables import pandas_mapped

#: One token of a source: a comment, a string with its escapes, a number, a name, or any other character but blanks.
_TOKEN = re.compile(
    r"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\"|`(?:\\.|[^`\\])*`)"
    r"|(?P<number>\d[\d_]*(?:\.\d+)?)|(?P<name>[^\W\d][\w$]*)|(?P<mark>\S)",
    re.S,
)
_ESCAPES = {"n": "\n", "r": "\n", "t": " "}
_CLOSES = {"[": "]", "{": "}", "(": ")"}
_WORDS = {"true": True, "false": False, "null": None, "undefined": None}
# How paths and names of assets begin and end.
PATHS = ("@/", "./", "../", "/images/", "/documents/")
ASSETS = (".png", ".jpg", ".jpeg", ".svg", ".webp", ".pdf")


def decoded(body: str) -> str:
    """The text of a literal: escapes resolved, template slots as a blank, lines tidied."""
    text = re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), body, flags=re.S)
    text = re.sub(r"\$\{[^}]+\}", " ", text)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(re.sub(r"[ \t]+", " ", x).rstrip() for x in text.splitlines())).strip()


def tokens(source: str, start: int = 0) -> list[tuple[str, str]]:
    """(kind, text) of what stands in a source from a place on, comments aside."""
    return [(m.lastgroup, m[0]) for m in _TOKEN.finditer(source, start) if m.lastgroup != "comment"]


def leading_comment(source: str) -> str:
    """The text of the line comments at the beginning of a source, one line after the other."""
    lines = []
    for line in source.lstrip("\ufeff").splitlines():
        if not line.strip().startswith("//"):
            break
        lines.append(line.strip().lstrip("/").strip())
    return "\n".join(lines)


def prose(source: str, least_chars: int = 18, least_blanks: int = 2, paths: tuple[str, ...] = PATHS, assets: tuple[str, ...] = ASSETS) -> list[str]:
    """Distinct string literals that read as prose: long enough, with blanks, and no paths, assets or drawings."""

    def reads(t: str) -> bool:
        low = t.lower()
        return len(t) >= least_chars and t.count(" ") >= least_blanks and not (t.startswith(paths) or low.endswith(assets) or "<svg" in low or "</svg>" in low)

    return list(dict.fromkeys(t for kind, text in tokens(source) if kind == "string" and reads(t := decoded(text[1:-1]))))


class _Reader:
    """Values of a program's literals from its tokens: objects as dicts, arrays as lists, strings decoded, calls as
    {"call": name, "of": values}; whatever else a value consists of is passed over."""

    def __init__(self, found: list[tuple[str, str]]):
        self.found, self.at = found, 0

    def here(self) -> tuple[str, str]:
        if self.at >= len(self.found):
            raise ValueError("a bracket is not closed")
        return self.found[self.at]

    def take(self) -> tuple[str, str]:
        token = self.here()
        self.at += 1
        return token

    def rest(self, closer: str) -> None:
        """Pass over what else belongs to a value, up to a comma or the end of what holds it."""
        while self.here()[1] not in (",", closer):
            if (opened := self.take()) in [("mark", o) for o in _CLOSES]:
                self.several(_CLOSES[opened[1]])
        if self.here()[1] == ",":
            self.take()

    def several(self, closer: str) -> list:
        out = []
        while self.here() != ("mark", closer):
            out.append(self.value())
            self.rest(closer)
        self.take()
        return out

    def fields(self) -> dict:
        out = {}
        while self.here() != ("mark", "}"):
            kind, text = self.take()
            if self.here() == ("mark", ":"):
                self.take()
                out[text[1:-1] if kind == "string" else text] = self.value()
            self.rest("}")
        self.take()
        return out

    def value(self):
        kind, text = self.here()
        if kind == "mark" and text in _CLOSES.values():
            return None
        self.take()
        if kind == "string":
            return decoded(text[1:-1])
        if kind == "number":
            return float(text.replace("_", ""))
        if (kind, text) == ("mark", "-") and self.here()[0] == "number":
            return -self.value()
        if kind == "mark" and text in "[{(":
            return self.fields() if text == "{" else self.several(_CLOSES[text])
        if kind == "name" and text not in _WORDS and self.at < len(self.found) and self.here() == ("mark", "("):
            self.take()
            return {"call": text, "of": self.several(")")}
        return _WORDS.get(text)


def constant(source: str, name: str):
    """The value of an exported constant; an error if there is none, or if a bracket of it is not closed."""
    found = tokens(source)
    for n in range(len(found) - 2):
        if [t for _, t in found[n : n + 3]] == ["export", "const", name]:
            equals = next((m for m in range(n + 3, len(found)) if found[m][1] == "="), None)
            if equals is not None:
                reader = _Reader(found[equals + 1 :])
                return reader.value()
    raise ValueError(f"there is no constant {name}")


def objects(source: str, name: str) -> list[dict]:
    """The objects of an exported array."""
    value = constant(source, name)
    if not isinstance(value, list):
        raise ValueError(f"there is no array {name}")
    return [x for x in value if isinstance(x, dict)]


def field(entry: dict, key: str) -> str | float | bool | None:
    """A field's value: a string, a number, true or false; None if it is null or not there. A key with dots goes into inner
    objects, a plain one is looked for in them, too."""
    head, _, tail = key.partition(".")
    if head in entry:
        inner = entry[head]
        return field(inner, tail) if tail and isinstance(inner, dict) else None if tail or isinstance(inner, (dict, list)) else inner
    return None if tail else next((v for x in entry.values() if isinstance(x, dict) and (v := field(x, key)) is not None), None)


def literal_texts(files: DataFrame, key: str = "path", source: str = "value") -> DataFrame:
    """(key, text): the prose of each source file as paragraphs; files without any give no row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, "\n\n".join(p)) for k, s in zip(f[key], f[source]) if isinstance(s, str) and (p := prose(s))]
            yield pd.DataFrame(rows, columns=[key, "text"])

    return pandas_mapped(files.select(key, source), run, f"{key} string, text string")


def series(files: DataFrame, name: str, strings: list[str], numbers: list[str], key: str = "path", source: str = "value") -> DataFrame:
    """(key, pos, strings…, numbers…): a row for each object of an exported array, absent and null fields null."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, n, *(field(o, c) for c in strings), *(field(o, c) for c in numbers)) for k, s in zip(f[key], f[source]) if isinstance(s, str) for n, o in enumerate(objects(s, name))]
            out = pd.DataFrame(rows, columns=[key, "pos", *strings, *numbers])
            yield out.astype({c: "float64" for c in numbers})

    kinds = ", ".join([f"{key} string, pos int", *(f"`{c}` string" for c in strings), *(f"`{c}` double" for c in numbers)])
    return pandas_mapped(files.select(key, source), run, kinds)
