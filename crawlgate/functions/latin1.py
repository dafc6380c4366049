"""Bytes as text: one character for each byte, so that patterns and splits are byte-exact."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of the Unicode property, as UTF-8 bytes read as Latin-1, and the same read backwards.
_BLANK = r"[\x09-\x0d\x20]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80"
_BLANK_BACK = r"[\x09-\x0d\x20]|[\x85\xa0]\xc2|\x80\x9a\xe1|[\x80-\x8a\xa8\xa9\xaf]\x80\xe2|\x9f\x81\xe2|\x80\x80\xe3"

#: What percent-encoding replaces: controls, blank, delete, all non-ASCII, and the signs of each set.
_SIGNS = {"rule": r'"<>`', "path": r'"<>`{}', "query": r"\"<>'", "plain_query": r'"<>', "fragment": r'"<>`', "control": "", "userinfo": r'"<>`{}'}
_UPPER_ASCII = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` made once."""
    return F.get(F.transform(F.array(value), then), 0)


def from_bytes(content: Column) -> Column:
    """A binary column as Latin-1 text."""
    return F.decode(content, "ISO-8859-1")


def from_text(text: Column) -> Column:
    """A string's UTF-8 bytes as Latin-1 text."""
    return from_bytes(F.encode(text, "UTF-8"))


def to_text(latin: Column) -> Column:
    """The string whose UTF-8 bytes these are; null if they are not UTF-8."""
    return F.try_validate_utf8(F.encode(latin, "ISO-8859-1").cast("string"))


def trim(latin: Column) -> Column:
    """Without Unicode white space at both ends, in time linear in the text.

    Only texts with bytes beyond ASCII need more than the built-in trim.
    """
    left = F.regexp_replace(latin, f"^(?:{_BLANK})+", "")
    wide = F.reverse(F.regexp_replace(F.reverse(left), f"^(?:{_BLANK_BACK})+", ""))
    return F.when(latin.rlike(r"[\x80-\xff]"), wide).otherwise(F.btrim(latin, F.lit("\t\n\x0b\x0c\r ")))


def lower_ascii(latin: Column) -> Column:
    """A to Z in lower case, all else as it is."""
    return F.translate(latin, _UPPER_ASCII, _UPPER_ASCII.lower())


def percent_encode(latin: Column, kind: str = "rule") -> Column:
    """Bytes of the set as %XX; existing escapes stay.  Only texts that need it are taken apart."""
    signs = _SIGNS[kind]
    blank = r"\x20" if kind != "control" else ""
    unsafe = rf"[\x00-\x1f{blank}\x7f-\xff{signs}]"
    encoded = F.transform(F.regexp_extract_all(latin, F.lit(r"([\x00-\xff])"), F.lit(1)), lambda c: F.when(c.rlike(unsafe), F.concat(F.lit("%"), F.hex(F.encode(c, "ISO-8859-1")))).otherwise(c))
    return F.when(latin.rlike(unsafe), F.array_join(encoded, "")).otherwise(latin)
