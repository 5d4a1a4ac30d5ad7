"""Words of texts, as both corpus and held-out passages are read."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

import numpy as np
import pyarrow as pa

WORD = re.compile(r"[^\W_]+")
_BROKEN = re.compile("[ÂÃâ][\u0080-ÿŒ-ƒˆ˜‐-™]{1,2}")
_TAG = re.compile(r"<[^<>]{1,40}>|&[a-zA-Z]{2,8};|&#\d{1,6};")
_HYPHEN = re.compile("(?<=[^\\W\\d_])[-‐­]\\s*\n\\s*(?=[a-zà-ÿ])")
_UNSEEN = re.compile("[­​-‍⁠﻿]")


def _mend(m: re.Match) -> str:
    for coding in ("cp1252", "latin-1"):
        try:
            return m.group().encode(coding).decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            pass
    return m.group()


def clean(text: str | None) -> str:
    """Text without markup, invisible characters and divided words, twice-coded characters mended, in lower case. Null is empty."""
    if not text:
        return ""
    if not text.isascii():
        if "Ã" in text or "Â" in text or "â" in text:
            text = _BROKEN.sub(_mend, text)
        text = _UNSEEN.sub("", text) if _UNSEEN.search(text) else text
        text = unicodedata.normalize("NFC", text)
    if "<" in text or "&" in text:
        text = _TAG.sub(" ", text)
    if "-\n" in text or "- \n" in text or "‐" in text:
        text = _HYPHEN.sub("", text)
    return text.lower()


def words(text: str | None) -> list[str]:
    return WORD.findall(clean(text))


def fold(word: str) -> str:
    """Word without accents."""
    if word.isascii():
        return word
    return "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c)).replace("ß", "ss")


_ASCII = np.array([chr(c).isalnum() if c < 128 else True for c in range(256)])
_LETTER = np.zeros(0x110000, dtype=bool)  # filled for the characters that occur
_ASKED = np.zeros(0x110000, dtype=bool)


def _word_bytes(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 belong to letters or digits, as :data:`WORD` has them."""
    inside = _ASCII[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        first = data[lead]
        size = 2 + (first >= 0xE0).astype(np.int64) + (first >= 0xF0)
        code = (first & np.array([0, 0, 0x1F, 0x0F, 0x07])[size]).astype(np.int64)
        for k in range(1, 4):
            more = size > k
            code[more] = code[more] << 6 | (data[lead[more] + k] & 0x3F)
        new = np.unique(code[~_ASKED[code]])
        _LETTER[new] = [chr(c).isalnum() for c in new.tolist()]
        _ASKED[new] = True
        off = ~_LETTER[code]
        for k in range(4):
            inside[lead[off & (size > k)] + k] = False
    return inside


def coded_words(texts: Sequence[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The words of cleaned texts: the different words without accents, the number of each word in order, and how many words each text has."""
    raw = [clean(t).encode() for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    inside = _word_bytes(data)
    edge = np.flatnonzero(np.diff(inside, prepend=False))
    begin, end = edge[::2], edge[1::2]
    offsets = np.append(0, np.cumsum(end - begin))
    words = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[inside])))
    coded = words.dictionary_encode()
    after = np.cumsum([len(r) + 1 for r in raw]) if raw else np.zeros(0, dtype=np.int64)
    upto = np.searchsorted(begin, after)
    return [fold(w) for w in coded.dictionary.to_pylist()], coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.diff(upto, prepend=0)
