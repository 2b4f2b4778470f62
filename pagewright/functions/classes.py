"""Character classes that give Java's regular expressions the meaning the text rules were written for.

Unqualified classes of the two engines differ: here a word character is any letter, number or underscore of any script, a
letter excludes figures and underscores, and white space is what a Unicode-aware split takes as a separator.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions.fold import SPACES

WORD = r"[\p{L}\p{N}_]"
LETTER = r"[\p{L}\p{Nl}\p{No}]"
SPACE = f"[{SPACES}]"
NOT_SPACE = f"[^{SPACES}]"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+\z", "")


def text_lines(c: Column) -> Column:
    """The stripped lines of a text that hold anything."""
    return F.filter(F.transform(F.split(c, "\n", -1), strip), lambda x: x != "")


def words(c: Column) -> Column:
    """The pieces of a text between white space."""
    return F.regexp_extract_all(c, F.lit(f"{NOT_SPACE}+"), F.lit(0))
