"""Undoing what happens to the characters of a text on its way: wrong decoding, hidden characters, line-end hyphens, markup.

Plain Python over whole texts, for use inside Arrow batches; each step looks for its trigger before it rewrites anything.
"""

from __future__ import annotations

import re
import unicodedata


def _high(byte: int) -> str:
    try:
        return bytes([byte]).decode("cp1252")
    except UnicodeDecodeError:
        return chr(byte)


_BYTE = {_high(b): b for b in range(0x80, 0x100)} | {chr(b): b for b in range(0x80, 0x100)}
_LEAD = "".join(_high(b) for b in range(0xC2, 0xF5))
_TAIL = "".join(re.escape(c) for c in dict.fromkeys([*(_high(b) for b in range(0x80, 0xC0)), *map(chr, range(0x80, 0xC0))]))
_BROKEN = re.compile(f"[{_LEAD}][{_TAIL}]{{1,3}}")
_HIDDEN = re.compile(r"[­͏​-‏‪-‮⁠-⁤⁦-⁩﻿\x00-\x08\x0e-\x1b\x7f]+")
_HYPHEN = re.compile(r"[-‐‑](?<=[^\W\d_][-‐‑])(?:[ \t]*[\r\n\x85  ]+[ \t>|*]*)?(?=[^\W\d_])")
_TAG = re.compile(r"</?[A-Za-z][A-Za-z0-9]{0,9}(?:\s[^<>]{0,80})?/?>")
_NOTE = re.compile(r"\[\^?\d{1,4}\]|[¹²³⁰-⁹]+")
_MARKS = re.compile("[̀-ͯ]+")
_APOSTROPHE = re.compile(r"['’ʼ′‘`´]+")
_WORD = re.compile(r"[^\W_]+").findall


def _redecode(m: re.Match) -> str:
    try:
        return bytes(_BYTE[c] for c in m[0]).decode("utf-8")
    except UnicodeDecodeError:
        return m[0]


def repair_encoding(text: str) -> str:
    """UTF-8 that was read as Windows-1252 or Latin-1, read rightly; what isn't such a sequence stays as it is."""
    if text.isascii() or not ("\u00c3" in text or "\u00e2" in text or "\u00c2" in text or "\u00c5" in text or _BROKEN.search(text)):
        return text
    return _BROKEN.sub(_redecode, text)


def rejoin(text: str) -> str:
    """Text without hyphens inside words, at line ends or not; a quotation or table mark at the next line's start goes too."""
    return _HYPHEN.sub("", text) if "-" in text or "\u2010" in text or "\u2011" in text else text


def prepare(text: str) -> str:
    """Text of which the parts between white space can be read alone: encoding repaired, tags out, parted words whole again."""
    text = repair_encoding(text)
    if "<" in text:
        text = _TAG.sub("", text)
    return rejoin(text)


def words_in(chunk: str) -> list[str]:
    """The words of a part without white space, as written but for hidden characters, note marks and apostrophes."""
    if not chunk.isalnum():
        chunk = _APOSTROPHE.sub("", _NOTE.sub("", _HIDDEN.sub("", chunk)))
        if not chunk.isascii():
            chunk = unicodedata.normalize("NFC", chunk)
            chunk = _MARKS.sub("", chunk)
    return _WORD(chunk)


def bare(word: str) -> str:
    """A word in lower case without marks, ligatures written out."""
    word = word.lower()
    if not word.isascii():
        word = _MARKS.sub("", unicodedata.normalize("NFKD", word.replace("\u00df", "ss").replace("\u0153", "oe").replace("\u00e6", "ae").replace("\u00f8", "o")))
    return word
