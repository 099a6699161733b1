"""Text expressions that agree between Java regex, RE2 and Python."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space, as a character set and as a regex class.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)
W = r"[\s\p{Z}\x0B\x1c-\x1f\x85]"
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x0B\x1c-\x1f\x85]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times in ``body``."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    """Trim Unicode white space; ``trim`` alone removes spaces only."""
    return F.btrim(text, F.lit(WHITESPACE))


def collapse(text: Column) -> Column:
    """Each run of white space becomes one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{W}+", " "))


def strip_tags(markup: Column) -> Column:
    """Markup to one-line text."""
    return collapse(F.regexp_replace(markup, "<[^>]+>", " "))


def token_count(text: Column) -> Column:
    """Words and single punctuation marks; 0 for blank text."""
    return F.regexp_count(text, F.lit(TOKEN)).cast("bigint")


def decode_text(content: Column) -> Column:
    """UTF-8 bytes to text: malformed bytes dropped, line ends normalized to ``\\n``."""
    raw = content.cast("string")
    valid = F.when(F.is_valid_utf8(raw), raw).otherwise(
        F.replace(F.make_valid_utf8(raw), F.lit("�"), F.lit(""))
    )
    return F.regexp_replace(valid, "\r\n?", "\n")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\z", 1)


def suffix(name: Column) -> Column:
    """Last extension with its dot, as written; empty for none or a leading dot only."""
    return F.regexp_extract(name, r"[^/](\.[^./]+)\z", 1)


def stem(name: Column) -> Column:
    return F.substr(name, F.lit(1), F.length(name) - F.length(suffix(name)))


def truncate(text: Column, size: int) -> Column:
    return F.substring(text, 1, size)


def uuid_text(key: Column) -> Column:
    """A UUID-shaped SHA-256 of ``key``: the same input gives the same identifier."""
    return F.regexp_replace(
        F.substring(F.sha2(key, 256), 1, 32),
        "^(.{8})(.{4})(.{4})(.{4})(.{12})$",
        "$1-$2-$3-$4-$5",
    )
