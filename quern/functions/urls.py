"""Addresses: validity, one form, keys, and rules on their paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import STRIP, rewritten


def _part(url: Column, part: str) -> Column:
    return F.try_parse_url(url, F.lit(part))


def is_web(url: Column) -> Column:
    """An http or https address with a host."""
    return F.coalesce(url.rlike(r"^(?i:https?)://[^/?#\s]+"), F.lit(False))


def one_form(url: Column, host_pattern: str) -> Column:
    """``https://host/path`` without query, fragment, trailing slashes and ``www.``; null unless the address is https on a
    host that fits the pattern, without user, backslash, control characters and dot segments."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^https://([^/?#]*)", 1)), r"^www\.", "")
    path = F.regexp_extract(url, r"^https://[^/?#]*([^?#]*)", 1)
    ok = url.rlike("^https://") & host.rlike(f"^(?:{host_pattern})$") & ~url.rlike(r"[\\\x00-\x1F]") & ~F.coalesce(F.try_url_decode(path), path).rlike(r"(^|/)\.\.?(/|$)")
    return F.when(ok, F.concat(F.lit("https://"), host, F.coalesce(F.nullif(F.regexp_replace(path, "/+$", ""), F.lit("")), F.lit("/"))))


def article_key(url: Column) -> Column:
    """The number at the end of an address, else a digest of its path."""
    path = F.regexp_extract(url, r"^https?://[^/]*(/[^?#]*)", 1)
    number = F.regexp_extract(path, r"-i(\d+)$", 1)
    return F.when(number != "", number).otherwise(F.concat(F.lit("legacy-"), F.substring(F.sha2(path, 256), 1, 24)))


def web_addresses(packed: Column) -> Column:
    """The distinct valid addresses in a field, in order."""
    parts = F.transform(F.split(packed, r"[\n,;]+"), lambda p: rewritten(p, STRIP))
    return F.array_distinct(F.filter(parts, is_web))


def within_prefix(value: Column, prefix: str) -> Column:
    """Strings from the prefix up to, not including, the prefix followed by U+F8FF, by bytes: a range that a scan can prune."""
    return (value >= prefix) & (value < prefix + "\uf8ff")


def client_address(forwarded: Column, peer: Column, trusted_hops: int) -> Column:
    """The address that the last trusted proxy saw: so many places before the end of the forwarded list, else the peer."""
    hops = F.filter(F.transform(F.split(forwarded, ","), lambda h: F.trim(h)), lambda h: h != "")
    return F.coalesce(F.when(F.size(hops) > trusted_hops, F.element_at(hops, -1 - trusted_hops)), peer)
