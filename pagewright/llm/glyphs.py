"""What a reader sees: one character for each group that looks alike, none for what does not show."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# Letters of other alphabets and the Latin letter of the same shape.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХҮԌԚԜҺаеѕіјорсухԁԛԝһүѵӏ", "ABESIJKMHOPCTYXYGQWHaesijopcyxdqwhyvl"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳοϲανρυι", "ABEZHIKMNOPTYXCjocavpuı"))
CHEROKEE = dict(zip("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏚᏙᏞᏟᏢᏦᏴ", "DRTAJEWMHGZSVLCPKB"))
LISU = dict(zip("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"))
SMALL_CAPITALS = dict(zip("ᴄᴏᴠᴡᴢꜱ", "covwzs"))
ARMENIAN = dict(zip("ՕՍօոսց", "OUonug"))
OTHER = {"‐": "-", "‑": "-", "﹣": "-", "－": "-", "˗": "-", "ɑ": "a", "ɡ": "g", "Ɩ": "l", "ǀ": "|", "∣": "|", "’": "'", "ʼ": "'", "′": "'", "″": '"'}
#: Kinds of compatibility forms that differ from their plain character in width, font or joining only.
SAME_SHAPE = {"<wide>", "<narrow>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>", "<noBreak>", "<small>"}
#: Ligatures and Roman numerals, which look like the letters they are made of.
LIGATURES, NUMERALS = range(0xFB00, 0xFB07), range(0x2160, 0x2180)


@lru_cache(1)
def table() -> dict[int, str | None]:
    """Translation table: look-alikes to one character, blanks to a space, unseen characters to nothing."""
    out: dict[int, str | None] = {}
    for cp in (*range(0x80, 0x3100), *range(0xA640, 0xAB70), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x1EE00, 0x1EF00), *range(0xE0000, 0xE01F0)):
        ch = chr(cp)
        cat = unicodedata.category(ch)
        if cat == "Zs" or cp in (0x2800, 0x3164, 0xFFA0):
            out[cp] = " "
        elif cat == "Cf" and not 0x600 <= cp < 0x606 or 0xFE00 <= cp < 0xFE10 or 0xE0100 <= cp < 0xE01F0 or cp in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5):
            out[cp] = None
        else:
            parts = unicodedata.decomposition(ch).split()
            if parts and parts[0] in SAME_SHAPE:
                out[cp] = unicodedata.normalize("NFKC", ch)
            elif cp in LIGATURES or cp in NUMERALS:
                out[cp] = unicodedata.normalize("NFKC", ch)
    for pairs in (CYRILLIC, GREEK, ARMENIAN, CHEROKEE, LISU, SMALL_CAPITALS, OTHER):
        out |= {ord(a): b for a, b in pairs.items()}
    # forms whose plain character is itself a look-alike (bold Greek capitals and the like)
    return {k: v.translate(out) if v else v for k, v in out.items()}


def shape(text: str) -> str:
    """A stretch of text without line breaks as it looks: every character by the table, accents composed, a dot set on a dotless i."""
    return unicodedata.normalize("NFC", text.translate(table())).replace("ı\u0307", "i")


_SPECIAL = re.compile(r"[^\x00-\x7f]")
_PLAIN = re.compile(r"[\x00-\x7fçğıöşüÇĞİÖŞÜâîûÂÎÛéèêàùäßāūīḥḫṣṭḳġżẕñʿʾء-ي٠-٩یکگپچ،؛؟—–«»\n]*")


def seen(text: str) -> str:
    """The text as it looks: composed accents, look-alikes in one alphabet, plain blanks, nothing unseen.

    Line breaks stay. Blanks at line ends do not show and go; a soft hyphen shows at a line end only.
    """
    if _PLAIN.fullmatch(text):
        return _ends(text)
    text = re.sub("\xad(?=[^\\S\\n]*(?:\\n|$))", "-", text)
    return _ends(shape(re.sub("\r\n?|[\x0b\x85\u2028\u2029]", "\n", text)))


def _ends(text: str) -> str:
    return re.sub(r"[ \t]+(?=\n|$)", "", text) if " \n" in text or "\t\n" in text or text.endswith((" ", "\t")) else text
