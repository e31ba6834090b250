"""Undoing disguised spellings: look-alike letters, digits and signs for letters, hidden characters, spread letters."""

from __future__ import annotations

import re
import unicodedata

_HIDDEN = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
#: Letters of other alphabets that look like Latin ones, and the Latin ones.
_ALIKE = dict(zip(map(ord, "аеорсухіјѕԁһңкмтвзαοερυικνѵ"), "aeopcyxijsdhnkmtb3aoepuikvv"))
_SIGNS = str.maketrans("43150$@7!8", "aeiiosa" "tib")
_MIXED = re.compile(r"(?<![\w$@!])(?=[\w$@!]*[^\W\d_])(?=[\w$@!]*[\d$@!])[\w$@!]+")
_SPREAD = re.compile(r"(?<![^\W_])[^\W\d_](?:[ .\-*]{1,2}[^\W\d_](?![^\W_])){2,}")
_LONG = re.compile(r"([^\W\d_])\1{2,}")
_SIZE = re.compile(r"f/?\d|\d+(mm|k|px|x|d|th|st|nd|rd)|\w*\d{4,}")
#: What separates phrases. Underscores stand for spaces.
_PHRASES = re.compile(r"[,.;:!?|\n\r\"“”„(){}\[\]—–…•<>/\\]+|\s-\s|\s--")


def plain(text: str) -> str:
    """Lower case, with what hides a spelling undone. '5' becomes s only beside letters, and a size such as 35mm stays."""
    t = text.translate(_HIDDEN)
    if not t.isascii():
        t = unicodedata.normalize("NFKC", t)
    t = t.lower().replace("_", " ")
    if not t.isascii():
        # letters of other alphabets only in words that hold Latin letters too
        t = re.sub(r"\w+", lambda m: m[0].translate(_ALIKE) if re.search("[a-z]", m[0]) else m[0], t)
    if any(c in t for c in "0123456789$@!"):
        t = _MIXED.sub(lambda m: m[0] if _SIZE.fullmatch(m[0]) else _sign(m[0]), t)
    t = _SPREAD.sub(lambda m: re.sub(r"[ .\-*]", "", m[0]) if len(m[0]) > 6 else m[0], t)
    return _LONG.sub(r"\1", t)


def _sign(word: str) -> str:
    body = word.rstrip("!") if word.endswith("!") else word
    return body.replace("5", "s").translate(_SIGNS) + word[len(body) :]


def phrases(text: str) -> list[str]:
    """The phrases of a text after plain(), without blanks."""
    return [" ".join(p.split()) for p in _PHRASES.split(plain(text)) if p.strip()]
