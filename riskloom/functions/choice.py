"""Option letters of multiple-choice answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.functions.text import strip

_EDGE = r"(?:$|[^\p{L}\p{N}_])"
# Fixed values, tried in this order after the first-character test.
LETTER_PATTERNS = [
    r"(?i)(?:^|[^\p{L}\p{N}_])([ABCD])" + _EDGE,
    r"(?i)answer[:\s]+([ABCD])" + _EDGE,
    r"(?i)option[:\s]+([ABCD])" + _EDGE,
    r"(?i)choice[:\s]+([ABCD])" + _EDGE,
    r"(?i)^([ABCD])\)",
]


def option_letter(text: Column, strict: bool = False) -> Column:
    """The option chosen in a response, or NULL.

    The default keeps two known habits: any first letter A-D decides, and the
    article "a" counts as option A.  ``strict`` tries the explicit phrases first
    and takes a bare letter only in upper case.
    """
    bare = strip(text)
    head = F.upper(F.substring(bare, 1, 1))

    def found(pattern: str) -> Column:
        return F.upper(F.nullif(F.regexp_extract(bare, pattern, 1), F.lit("")))

    if strict:
        loose, *phrases = LETTER_PATTERNS
        exact = loose.replace("(?i)", "", 1)
        return F.coalesce(*[found(p) for p in phrases], found(exact))
    return F.when(head.isin("A", "B", "C", "D"), head).otherwise(
        F.coalesce(*[found(p) for p in LETTER_PATTERNS]))


def option_index(letter: Column) -> Column:
    return F.ascii(letter) - F.lit(65)
