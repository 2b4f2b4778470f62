"""Letter folding that stays inside the JVM: tables are generated from Unicode data."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(1)
def latin_fold_table() -> tuple[str, str]:
    """Accented Latin letters and the bare lower-case letter each one folds to."""
    source, target = [], []
    for cp in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        ch = chr(cp)
        base = unicodedata.normalize("NFKD", ch)[0]
        if base != ch and base.isascii() and base.isalpha():
            source.append(ch)
            target.append(base.lower())
    return "".join(source) + "ıİ", "".join(target) + "ii"


def fold_letters(c: Column) -> Column:
    """Lower-case, accents removed, dotless and dotted i merged, marks and half rings dropped."""
    source, target = latin_fold_table()
    folded = F.translate(c, source, target)
    return F.lower(F.regexp_replace(folded, r"[\p{M}\p{Cf}ʿʾ’‘'`´]", ""))


def py_fold(text: str) -> str:
    """The same folding for a Python string."""
    return text.translate(_py_table()).lower()


class _Folded(dict):
    """Code point -> what it folds to, None where it is dropped; filled as code points are met."""

    def __missing__(self, cp: int) -> int | None:
        ch = chr(cp)
        self[cp] = out = None if unicodedata.category(ch) in ("Mn", "Mc", "Me", "Cf") or ch in "ʿʾ’‘'`´" else cp
        return out


@lru_cache(1)
def _py_table() -> _Folded:
    return _Folded(str.maketrans(*latin_fold_table()))


_NO_LETTERS = re.compile(r"[^\w\n]+|[\d_]+")
#: In the tables of ``fold_text``: a character not met yet, and one that is dropped.
_UNMET, _GONE = 0x110000, 0x110001
_PIECE = 1 << 16


@lru_cache(1)
def _text_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point what it folds to, and the same or a blank where that is no letter; filled as code points are met."""
    return np.full(_UNMET, _UNMET, np.uint32), np.full(_UNMET, ord(" "), np.uint32)


def fold_text(text: str) -> tuple[str, str]:
    """``py_fold`` of a whole text, and the same with blanks in place of all but letters and line ends.

    Characters are looked up in arrays, some ten times faster than by ``translate`` on long texts; on a few words it is slower.
    """
    if "Σ" in text:  # the only letter whose lower-case form depends on its neighbours
        folded = py_fold(text)
        return folded, _NO_LETTERS.sub(" ", folded)
    # piece by piece, so that the arrays stay small
    parts = [_fold_piece(text[k : k + _PIECE]) for k in range(0, len(text), _PIECE)]
    return "".join(p[0] for p in parts), "".join(p[1] for p in parts)


def _fold_piece(text: str) -> tuple[str, str]:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.intp)
    small, letters = _text_tables()
    out = small[points]
    kept = out < _UNMET
    if not kept.all():
        if fresh := set(points[out == _UNMET].tolist()):
            for cp in fresh:
                low = py_fold(chr(cp))
                small[cp] = ord(low) if low else _GONE
                letters[cp] = ord(" ") if _NO_LETTERS.match(low) else small[cp]
            out = small[points]
            kept = out < _UNMET
        points, out = points[kept], out[kept]
    return out.tobytes().decode("utf-32-le", "surrogatepass"), letters[points].tobytes().decode("utf-32-le", "surrogatepass")


#: Inside of a character class for every character that Python's ``str.split`` takes as white space. Said by properties, which
#: the regular expressions of the JVM test some thirty times faster than a list of ranges.
SPACES = r"\p{javaWhitespace}\p{Zs}\x85"


def word_count(c: Column) -> Column:
    """Number of words separated by any Unicode white space; null and blank text give 0."""
    return F.coalesce(F.regexp_count(c, F.lit(f"[^{SPACES}]+")), F.lit(0)).cast("bigint")
