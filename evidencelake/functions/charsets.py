"""Which charset undeclared bytes have: every charset that can decode all of them is scored by tables over its characters, and by words.

A text in its own charset consists of that script's common characters (first-level ideographs, kana, syllables, small letters); read
as another charset it becomes rare ideographs, capitals among small letters, or words of two alphabets. The tables are NumPy arrays
over all 65,536 code units, built by rule from the charsets' own layout; the distinct words of all bytes are scored, by array lookups.
A text in Cyrillic capitals alone can't be told from one in small letters of the other Cyrillic charset by this, and is taken for that.
"""

from __future__ import annotations

from functools import cache

import numpy as np

#: Charsets by name, in the order in which ties are decided: those that few byte strings satisfy come first.
CANDIDATES = ("utf_16_le", "utf_16_be", "shift_jis", "euc_jp", "euc_kr", "gb18030", "big5", "cp1251", "koi8_r", "cp1253", "cp1252")
#: Lead bytes of the most common characters of each double-byte charset.
COMMON_ROWS = {"gb18030": range(0xB0, 0xD8), "big5": range(0xA4, 0xC7), "shift_jis": range(0x88, 0x98), "euc_jp": range(0xB0, 0xD0), "euc_kr": range(0xB0, 0xC9)}
#: Code points of a script's common characters: kana and the marks of East Asian texts; small letters of single-byte charsets.
KANA, MARKS = range(0x3041, 0x30FF), (0x3001, 0x3002, 0xFF0C, 0xFF1A, 0xFF01, 0xFF1F, 0x300C, 0x300D, 0xFF08, 0xFF09, 0x300A, 0x300B, 0x201C, 0x201D)
SMALL = {"cp1251": range(0x430, 0x460), "koi8_r": range(0x430, 0x460), "cp1253": range(0x3AC, 0x3CF), "cp1252": range(0xDF, 0x100)}
#: The most frequent small letters; others of the alphabet speak half as much for it.
FREQUENT = {"cp1251": "оеаинтсрвлкмдпуяыьгз", "koi8_r": "оеаинтсрвлкмдпуяыьгз", "cp1253": "αοιετσνηυρπκμλςάόίέή"}
CAPITAL = {"cp1251": range(0x400, 0x430), "koi8_r": range(0x400, 0x430), "cp1253": range(0x386, 0x3AC), "cp1252": range(0xC0, 0xDF)}
#: Spaces in place of the ASCII characters that are never the second byte of another one.
SPACED = bytes(32 if b < 0x30 or 0x3A <= b < 0x40 else b for b in range(256))
#: Latin letters with marks: they speak neither for nor against an East Asian charset.
LATIN = range(0xC0, 0x250)


@cache
def weights(charset: str) -> np.ndarray:
    """How much each code unit speaks for a charset, from 0 to 1; ASCII is no matter."""
    w = np.zeros(1 << 16, np.float32)
    if charset in COMMON_ROWS:
        trails = [t for t in range(0x40, 0xFF) if t != 0x7F] if charset in ("big5", "shift_jis") else list(range(0xA1, 0xFF))
        common = b"".join(bytes((lead, t)) for lead in COMMON_ROWS[charset] for t in trails).decode(charset, "ignore")
        # Japanese is told from other ideographs by its kana: without any, it is less likely than they are.
        w[[ord(c) for c in common if ord(c) < 1 << 16]] = 0.7 if charset in ("shift_jis", "euc_jp") else 1
        w[list(MARKS)] = 1
        if charset in ("shift_jis", "euc_jp"):
            w[list(KANA)] = 1
    elif charset.startswith("utf_16"):
        w[0x80:0x3000] = w[0x3000:0x3100] = w[0x4E00:0xA000] = w[0xAC00:0xD7A4] = 1
    else:
        w[list(SMALL[charset])] = 0.5 if charset in FREQUENT else 1
        w[[ord(c) for c in FREQUENT.get(charset, "")]] = 1
        w[list(CAPITAL[charset])] = 0.3 if charset in FREQUENT else 0.6
        w[[0xA0, 0xAB, 0xBB, 0x2013, 0x2014, 0x2018, 0x2019, 0x201C, 0x201D, 0x2026]] = 0.6
    return w


@cache
def _kinds(charset: str) -> np.ndarray:
    """0 other, 1 ASCII letter, 2 small and 3 capital letter of the charset's own half."""
    k = np.zeros(1 << 16, np.int8)
    k[65:91] = k[97:123] = 1
    k[list(SMALL.get(charset, ()))] = 2
    k[list(CAPITAL.get(charset, ()))] = 3
    return k


def _foreign(charset: str, units: np.ndarray) -> float:
    """How many letters stand where the charset's script doesn't write them.

    Latin has ASCII letters in a word: of a word without any, all but the first letter. Greek and Cyrillic have none: of a mixed word,
    all that aren't ASCII. Anywhere a capital after a small letter; in Greek a final sigma within a word, and another one at its end.
    """
    kinds = _kinds(charset)[units]
    word = np.cumsum(kinds == 0)
    mixed = (np.bincount(word, kinds == 1) > 0)[word]
    own = kinds >= 2
    after = np.r_[kinds[1:], np.int8(0)]
    raised = (kinds == 2) & (after == 3)
    if charset == "cp1252":
        return float((own & (after >= 2) & ~mixed | raised).sum())
    cost = (own & mixed).sum() + (raised & ~mixed).sum()
    if charset == "cp1253":
        cost += (~mixed & ((units == 0x3C2) & (after > 0) | (units == 0x3C3) & (after == 0))).sum()
    return float(cost)


def score(body: bytes, charset: str) -> float:
    """From 0 to 1; 0 if the bytes aren't valid in the charset."""
    try:
        text = body.decode(charset)
    except UnicodeDecodeError:
        return 0.0
    units = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16)
    high = units >= 0x80
    if charset.startswith("utf_16"):
        # Texts have spaces, letters and line ends in them, wrongly ordered bytes and other charsets hardly have.
        plain = int(((units < 0x80) & (units >= 0x20)).sum()) + int(np.isin(units, [9, 10, 13]).sum())
        return (float(weights(charset)[units[high]].sum()) + plain) / max(len(units), 1) if len(units) > 1 and plain else 0.0
    if charset in COMMON_ROWS:
        high &= (units < LATIN.start) | (units >= LATIN.stop)
    n = int(high.sum())
    if n == 0:
        return 0.0
    own = float(weights(charset)[units[high]].sum())
    return max(0.0, own - _foreign(charset, units) if charset in SMALL else own) / n


def _words(body: bytes) -> bytes:
    """The words that aren't ASCII, each once: one that fills a page speaks no louder than one that occurs in it."""
    return b" ".join(dict.fromkeys(w for w in body.translate(SPACED).split() if not w.isascii()))


def guess(body: bytes | None) -> str | None:
    """The charset in which the bytes read best; null for null and empty bytes. Latin-1 where nothing speaks for any other."""
    if not body:
        return None
    if body[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return "utf_16"
    names = CANDIDATES if 0 in body[:4096] or b"\0" in body else CANDIDATES[2:]
    words = _words(body)
    best = max(((score(body if c.startswith("utf_16") else words, c), -i) for i, c in enumerate(names)), default=(0.0, 0))
    return names[-best[1]] if best[0] > 0.2 else "cp1252"
