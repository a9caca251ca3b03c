"""Encoding repair and Unicode normalization: Arrow UDFs, only rows that need them are sent."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.functions.text import normalize_whitespace, text_or_empty

# fixed values: typographic characters that are written plainly
_PLAIN = str.maketrans({
    "‘": "'", "’": "'", "‚": "'", "‛": "'",
    "“": '"', "”": '"', "„": '"', "‟": '"',
    "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl",
    "ﬅ": "ſt", "ﬆ": "st",
    " ": "\n", " ": "\n", "\x85": "\n",
})
_TO_PLAIN = re.compile("[" + "".join(map(chr, _PLAIN)) + "]")
# fixed values: control characters that carry no text
_CONTROL = re.compile("[\x00-\x08\x0b\x0e-\x1f\x7f﻿￹-￻]")


def _byte_table() -> dict[int, int]:
    """Windows-1252 characters to their bytes; bytes without a character stand for themselves."""
    table = {}
    for b in range(0x80, 0xA0):
        table[b] = b
        try:
            table[ord(bytes([b]).decode("cp1252"))] = b
        except UnicodeDecodeError:
            pass
    return table


_BYTES = _byte_table()
_TAIL = "[\x80-\xbf" + "".join(chr(c) for c in _BYTES if c > 0xFF) + "]"
# UTF-8 of two, three or four bytes, read as Windows-1252 or Latin-1
_MOJIBAKE = re.compile(f"[\xc2-\xdf]{_TAIL}|[\xe0-\xef]{_TAIL}{{2}}|[\xf0-\xf4]{_TAIL}{{3}}")


def _unmix(text: str) -> str:
    """Undo UTF-8 that was read with a one-byte code, as often as it applies."""
    def decode(match: re.Match) -> str:
        run = match.group()
        try:
            return run.translate(_BYTES).encode("latin-1").decode("utf-8")
        except UnicodeError:
            return run

    while (repaired := _MOJIBAKE.sub(decode, text)) != text:
        text = repaired
    return text


def _fix(text: str) -> str:
    if "&" in text and "<" not in text:
        text = html.unescape(text)
    if not text.isascii():
        text = _unmix(text)
        if _TO_PLAIN.search(text):
            text = text.translate(_PLAIN)
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    return unicodedata.normalize("NFC", _CONTROL.sub("", text))


def _settle(text: str) -> str:
    """Repair and NFKC until nothing changes: compatibility forms may hide entities."""
    while (repaired := unicodedata.normalize("NFKC", _fix(text))) != text:
        text = repaired
    return text


@F.pandas_udf(T.StringType())
def _fix_udf(texts: pd.Series) -> pd.Series:
    return texts.map(_fix, na_action="ignore")


@F.pandas_udf(T.StringType())
def _nfkc_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


@F.pandas_udf(T.StringType())
def _fix_nfkc_udf(texts: pd.Series) -> pd.Series:
    return texts.map(_settle, na_action="ignore")


# ASCII without ampersands, and letters of Latin-1: no rule changes them (the second byte of mixed-up UTF-8 is never one)
_PLAIN_TEXT = r"\A[\x20-\x25\x27-\x7e\t\n\f\u00c0-\u00ff]*\z"


def _where_needed(c: Column, udf) -> Column:
    # plain rows stay in the JVM; the UDF sees a null for them
    needed = F.when(~text_or_empty(c).rlike(_PLAIN_TEXT), c)
    return F.coalesce(udf(needed), text_or_empty(c))


def fix_encoding(c: Column) -> Column:
    return _where_needed(c, _fix_udf)


def nfkc(c: Column) -> Column:
    return _where_needed(c, _nfkc_udf)


def normalize_text(c: Column) -> Column:
    """Encoding repair, NFKC, then white space."""
    return normalize_whitespace(_where_needed(c, _fix_nfkc_udf))
