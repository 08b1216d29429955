"""Glyph names of simple fonts' codes under the predefined encodings."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Glyph names of characters that are no letters or digits.
_SIGNS = {
    " ": "space", "!": "exclam", '"': "quotedbl", "#": "numbersign", "$": "dollar", "%": "percent", "&": "ampersand", "'": "quotesingle", "(":
    "parenleft", ")": "parenright", "*": "asterisk", "+": "plus", ",": "comma", "-": "hyphen", ".": "period", "/": "slash", ":": "colon", ";":
    "semicolon", "<": "less", "=": "equal", ">": "greater", "?": "question", "@": "at", "[": "bracketleft", "\\": "backslash", "]": "bracketright", "^":
    "asciicircum", "_": "underscore", "`": "grave", "{": "braceleft", "|": "bar", "}": "braceright", "~": "asciitilde", "¡": "exclamdown", "¢": "cent",
    "£": "sterling", "⁄": "fraction", "¥": "yen", "ƒ": "florin", "§": "section", "¤": "currency", "“": "quotedblleft", "«": "guillemotleft", "‹":
    "guilsinglleft", "›": "guilsinglright", "ﬁ": "fi", "ﬂ": "fl", "–": "endash", "†": "dagger", "‡": "daggerdbl", "·": "periodcentered", "¶": "paragraph",
    "•": "bullet", "‚": "quotesinglbase", "„": "quotedblbase", "”": "quotedblright", "»": "guillemotright", "…": "ellipsis", "‰": "perthousand", "¿":
    "questiondown", "´": "acute", "ˆ": "circumflex", "˜": "tilde", "¯": "macron", "˘": "breve", "˙": "dotaccent", "¨": "dieresis", "˚": "ring", "¸":
    "cedilla", "˝": "hungarumlaut", "˛": "ogonek", "ˇ": "caron", "—": "emdash", "ª": "ordfeminine", "º": "ordmasculine", "ı": "dotlessi", "‘":
    "quoteleft", "’": "quoteright", "€": "Euro", "™": "trademark", "©": "copyright", "®": "registered", "°": "degree", "±": "plusminus", "²":
    "twosuperior", "³": "threesuperior", "¹": "onesuperior", "×": "multiply", "÷": "divide", "µ": "mu", "¬": "logicalnot", "¦": "brokenbar", "¼":
    "onequarter", "½": "onehalf", "¾": "threequarters", "√": "radical", "∞": "infinity", "≠": "notequal", "≤": "lessequal", "≥": "greaterequal", "∂":
    "partialdiff", "∑": "summation", "∏": "product", "π": "pi", "∫": "integral", "Ω": "Omega", "≈": "approxequal", "∆": "Delta", "◊": "lozenge", "�":
    "apple",
}
# Glyph names of the standard encoding's codes from 161 up.
_STANDARD = {
    161: "exclamdown", 162: "cent", 163: "sterling", 164: "fraction", 165: "yen", 166: "florin", 167: "section", 168: "currency", 169: "quotesingle", 170:
    "quotedblleft", 171: "guillemotleft", 172: "guilsinglleft", 173: "guilsinglright", 174: "fi", 175: "fl", 177: "endash", 178: "dagger", 179:
    "daggerdbl", 180: "periodcentered", 182: "paragraph", 183: "bullet", 184: "quotesinglbase", 185: "quotedblbase", 186: "quotedblright", 187:
    "guillemotright", 188: "ellipsis", 189: "perthousand", 191: "questiondown", 193: "grave", 194: "acute", 195: "circumflex", 196: "tilde", 197:
    "macron", 198: "breve", 199: "dotaccent", 200: "dieresis", 202: "ring", 203: "cedilla", 205: "hungarumlaut", 206: "ogonek", 207: "caron", 208:
    "emdash", 225: "AE", 227: "ordfeminine", 232: "Lslash", 233: "Oslash", 234: "OE", 235: "ordmasculine", 241: "ae", 245: "dotlessi", 248: "lslash", 249:
    "oslash", 250: "oe", 251: "germandbls",
}
# Names of a compact font's string numbers from 150 on, and the letters and marks that follow them.
_MORE_STRINGS = ("onesuperior", "logicalnot", "mu", "trademark", "Eth", "onehalf", "plusminus", "Thorn", "onequarter", "divide", "brokenbar", "degree", "thorn", "threequarters", "twosuperior", "registered", "minus", "eth", "multiply", "threesuperior", "copyright")
_MARKED = ("A acute", "A circumflex", "A dieresis", "A grave", "A ring", "A tilde", "C cedilla", "E acute", "E circumflex", "E dieresis", "E grave", "I acute", "I circumflex", "I dieresis", "I grave", "N tilde", "O acute", "O circumflex", "O dieresis", "O grave", "O tilde", "S caron", "U acute", "U circumflex", "U dieresis", "U grave", "Y acute", "Y dieresis", "Z caron")
_MARKS = {"GRAVE": "grave", "ACUTE": "acute", "CIRCUMFLEX": "circumflex", "TILDE": "tilde", "DIAERESIS": "dieresis", "RING ABOVE": "ring", "CEDILLA": "cedilla", "CARON": "caron", "STROKE": "slash"}
_LETTERS = {"Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe", "ß": "germandbls", "Ð": "Eth", "ð": "eth", "Þ": "Thorn", "þ": "thorn"}


def glyph(char: str) -> str | None:
    """A character's glyph name: a sign's own, a letter with its mark's name behind it, a digit's word."""
    if char in _SIGNS:
        return _SIGNS[char]
    if char in _LETTERS:
        return _LETTERS[char]
    name = unicodedata.name(char, "")
    if char.isascii() and char.isalpha():
        return char
    if char.isascii() and char.isdigit():
        return name.removeprefix("DIGIT ").lower()
    head, sep, mark = name.partition(" WITH ")
    if sep and mark in _MARKS and head.startswith("LATIN "):
        base = head.rsplit(" ", 1)[1]
        return (base.lower() if "SMALL" in head else base) + _MARKS[mark]
    return None


@cache
def table(encoding: str) -> dict[int, str]:
    """Names by code of "Standard", "WinAnsi" or "MacRoman"."""
    out = {}
    for code in range(32, 256):
        if encoding == "Standard":
            char = {39: "’", 96: "‘"}.get(code, chr(code)) if code < 127 else None
        else:
            try:
                char = bytes([code]).decode("cp1252" if encoding == "WinAnsi" else "mac_roman")
            except UnicodeDecodeError:
                char = None
            if encoding == "WinAnsi":
                char = {0xA0: " ", 0xAD: "-"}.get(code, char if char is not None or code < 127 else "•")
                char = "•" if code == 127 else char
            elif code == 0xCA:
                char = " "
            elif code == 0xDB:
                char = "¤"
            elif code == 0xF0:
                char = "�"
        name = glyph(char) if char is not None else _STANDARD.get(code) if encoding == "Standard" else None
        if name:
            out[code] = name
    return out


@cache
def standard_strings() -> dict[int, str]:
    """Names of the string numbers that every compact font knows, up to the end of its Latin ones.

    They are the standard encoding's in its order, then signs, then letters with marks, first
    the capitals and then the small ones.
    """
    names = ["", *table("Standard").values(), *_MORE_STRINGS]
    marked = [f"{base}{mark}" for base, mark in (x.split(" ") for x in _MARKED)]
    return dict(enumerate([*names, *marked, *[f"{m[0].lower()}{m[1:]}" for m in marked]]))


@cache
def characters() -> dict[str, str]:
    """Characters by glyph name, for all characters of the predefined encodings."""
    out: dict[str, str] = {}
    for page in ("cp1252", "mac_roman"):
        for code in range(32, 256):
            try:
                char = bytes([code]).decode(page)
            except UnicodeDecodeError:
                continue
            if name := glyph(char):
                out.setdefault(name, char)
    return out


def glyph_name(code: Column, encoding: str = "Standard") -> Column:
    """The glyph that a code stands for; null where the encoding has none."""
    pairs = [F.lit(x) for kv in table(encoding).items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), code.cast("int"))
