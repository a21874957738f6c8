"""Unicode normalization and entity decoding: Arrow functions that see only what needs them.

Spark has no built-in for these. Text that a cheap pattern proves unchanged is passed as
null, so Python receives nothing for it, and the original is put back.
"""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions.text import fold_line

#: Below U+0300 no text changes under NFC and only C1/C0 characters belong to a C category.
NFC_TRIGGER = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\xad\u0300-\x{10ffff}]"
#: Characters below U+0100 that NFKC changes, everything above, and ampersands.
NFKC_TRIGGER = r"[&\xa0\xa8\xaa\xaf\xb2-\xb5\xb8-\xba\xbc-\xbe\u0100-\x{10ffff}]"


def nfc_text(s: str) -> str:
    """NFC without control, format, private and unassigned characters but \\n \\r \\t."""
    return "".join(c for c in unicodedata.normalize("NFC", s) if c in "\n\r\t" or unicodedata.category(c)[0] != "C")


def _over(function):
    def run(s: pd.Series) -> pd.Series:
        return s.map(function, na_action="ignore")

    return F.pandas_udf(run, "string")


def _guarded(c: Column, trigger: str, function) -> Column:
    return F.coalesce(_over(function)(F.when(c.rlike(trigger), c)), c)


def nfc(c: Column) -> Column:
    return _guarded(c, NFC_TRIGGER, nfc_text)


def unescape(c: Column) -> Column:
    return _guarded(c, "&", html.unescape)


def compatible(c: Column) -> Column:
    """NFKC, then entities decoded."""
    return _guarded(c, NFKC_TRIGGER, lambda s: html.unescape(unicodedata.normalize("NFKC", s)))


def _compatible_lines(s: str) -> str:
    return "\n".join(html.unescape(unicodedata.normalize("NFKC", x)).replace("\n", " ") for x in s.split("\n"))


def compatible_lines(c: Column) -> Column:
    """``compatible`` on every line of a text; a text that needs it goes to Python once."""
    return _guarded(c, NFKC_TRIGGER, _compatible_lines)


def line_key(c: Column, preserve_case: bool = False) -> Column:
    """The key under which two lines are equal."""
    return fold_line(compatible(F.coalesce(c, F.lit(""))), preserve_case)
