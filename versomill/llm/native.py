"""Word arrays by DataFrame functions only."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Everything but ASCII letters and digits and characters beyond ASCII.
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
BREAKS = BREAK + "+"
#: A character of a word.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def ascii_lower(text: Column) -> Column:
    """A-Z only; letters beyond ASCII keep their case.

    ``lower`` is much the faster and is right wherever all characters are ASCII.
    """
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def word_array(text: Column) -> Column:
    """Words of ASCII letters, digits and characters beyond ASCII, in lower case; none for a null."""
    flat = F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), BREAKS, " "))
    return F.filter(F.split(flat, " "), lambda w: w != "")
