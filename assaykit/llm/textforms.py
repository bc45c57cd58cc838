"""Plain functions on strings that several operators share: folding, word features, edit distance."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

_EXTRA = str.maketrans({"ß": "ss", "ø": "o", "đ": "d", "ł": "l", "æ": "ae", "œ": "oe", "ı": "i", "’": "'", "：": ":", "（": "(", "）": ")", "，": ",", "／": "/"})
_WORD = re.compile(r"[^\W_]+")
_HAN = re.compile(r"[一-鿿]")


def fold(text: str) -> str:
    """Compatibility form, case folded, without combining marks."""
    t = unicodedata.normalize("NFKD", text.casefold().translate(_EXTRA))
    return unicodedata.normalize("NFKC", "".join(c for c in t if not unicodedata.combining(c)))


def words(text: str) -> list[str]:
    """Runs of letters and digits of an already folded text; runs that mix Han and Latin letters are parted."""
    out: list[str] = []
    for w in _WORD.findall(text):
        out.extend(re.findall(r"[一-鿿]+|[^一-鿿]+", w) if _HAN.search(w) else [w])
    return out


def pair_grams(tokens: list[str]) -> list[str]:
    """Unordered neighbouring letters of each word with its edges: exchanged letters and reordered words change few of them.

    The k-th repetition of a gram is a gram of its own, so sets behave as multisets.
    """
    seen: dict[str, int] = {}
    out = []
    for w in tokens:
        s = f"^{w}$"
        for a, b in zip(s, s[1:]):
            g = a + b if a <= b else b + a
            seen[g] = n = seen.get(g, 0) + 1
            out.append(g if n == 1 else f"{g}{n}")
    return out


def osa(a: str, b: str, most: int = 3) -> int:
    """Edit distance with exchange of neighbours counted once; ``most + 1`` as soon as it must exceed ``most``."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return last[-1]


_LINE_WORDS = re.compile(r"[^\W\d_一-鿿]+|[一-鿿]")
#: ASCII marks and digits become blanks, so that a plain split parts words.
_BLANKED = {ord(c): " " for c in map(chr, range(128)) if not c.isalpha()}


@lru_cache(maxsize=20_000)
def words_of(line: str) -> tuple[str, ...]:
    """Words of a line in lower case: Latin words and single Han characters; numbers are left out, as they vary."""
    low = line.lower()
    return tuple(low.translate(_BLANKED).split() if low.isascii() else _LINE_WORDS.findall(low))
