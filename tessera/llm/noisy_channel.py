"""Noisy-channel restoration of disguised words under a character language model."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Codes: 0 for all that is no letter, 1-26 for a-z, 27-58 for the Latin-1 letters from U+00E0 on, 59 for other letters.
CODES = 60
_OTHER = 59
#: Letters that digits and signs stand in for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e"}
#: Signs that may be put between the letters of a word.
BETWEEN = set(" .-_*'~^,")
#: Log costs of the channel: a substitution, a sign dropped, a repetition undone.
SUBSTITUTED, DROPPED, UNDONE = -1.2, -1.0, -0.3
#: Log costs of a sign of LEET that stands for itself: inside a word, and where punctuation is at home (the ends).
KEPT, PUNCTUATION = -5.0, -1.0
_ODD = re.compile(r"[^\W\d_]")
_SIGNS = re.compile(r"[^\w\s]")
_RUN = re.compile(r"([^\W\d_])\1\1")
_TAIL = re.compile(r"([^\w\s])\1{2,}$")
SPACED = re.compile(r"(?<!\S)(?:[^\s] ){2,}[^\s](?!\S)")


def code(c: str) -> int:
    o = ord(c)
    if 97 <= o <= 122:
        return o - 96
    if 0xE0 <= o <= 0xFF and o != 0xF7:
        return o - 0xE0 + 27
    return _OTHER if c.isalpha() else 0


def _codes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    out = np.zeros(len(raw), np.int64)
    low = raw < 0x100
    out[low] = _TABLE[raw[low]]
    high = np.flatnonzero(~low)
    if len(high):
        out[high] = [_OTHER if chr(x).isalpha() else 0 for x in raw[high].tolist()]
    return out


_TABLE = np.array([code(chr(i)) for i in range(0x100)], np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(CODES**3, np.int64)

    def add(texts: list[str]) -> None:
        c = _codes("\n" + "\n".join(texts) + "\n")
        np.add(total, np.bincount((c[:-2] * CODES + c[1:-1]) * CODES + c[2:], minlength=CODES**3), out=total)

    held, size = [], 0
    for b in batches:
        for t in b.column("text"):
            held.append(t.as_py() or "")
            size += len(held[-1])
            if size > 1_000_000:
                add(held)
                held, size = [], 0
    if held:
        add(held)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])


def language_model(docs: DataFrame, text_col: str = "text", smoothing: float = 0.1) -> np.ndarray:
    """log P(c | a, b) of letter codes, counted over all texts; each task sends at most 60^3 sums."""
    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(_count, "gram long, n long")
    found = counts.groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(CODES**3)
    total[found["gram"].to_numpy(np.int64)] = found["n"].to_numpy(np.float64)
    total = total.reshape(CODES, CODES, CODES) + smoothing
    return np.log(total / total.sum(axis=2, keepdims=True)).astype(np.float32)


def _lattice(word: str) -> list[list[tuple[str, float]]]:
    """Per step the strings that may have stood there, with the channel's log cost."""
    steps, i = [], 0
    while i < len(word):
        c, j = word[i], i
        while j < len(word) and word[j] == c:
            j += 1
        n = j - i
        own: list[tuple[str, float]]
        if c.isalpha():
            own = [(c * n, 0.0)] if n < 3 else [(c, UNDONE), (c * 2, UNDONE)]
        else:
            sign = c in LEET and not c.isdigit()
            own = [(" ", 0.0 if not sign else PUNCTUATION if c in "(!|+" and (i == 0 or j == len(word)) else KEPT * n)]
            if c in BETWEEN:
                own.append(("", DROPPED))
            for x in LEET.get(c, ""):
                own += [(x * n, SUBSTITUTED * n)] if n < 3 else [(x, SUBSTITUTED + UNDONE)]
        steps.append(own)
        i = j
    return steps


def restore(word: str, lm: np.ndarray) -> str:
    """The likeliest plain text of a disguised word (lower case): Viterbi over the lattice, the state being the last two codes; back-pointers keep the time linear in the word."""
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for options in [*_lattice(word.lower()), [(" ", 0.0)]]:
        new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, out) in best.items():
            for s, cost in options:
                x, y, total = a, b, score + cost
                for c in s:
                    z = code(c)
                    if not (z == 0 and y == 0):
                        total += float(lm[x, y, z])
                        x, y = y, z
                if (x, y) not in new or total > new[x, y][0]:
                    new[x, y] = (total, (out, s))
        best = new
    way, parts = max(best.values(), key=lambda x: x[0])[1], []
    while way:
        way, s = way
        parts.append(s)
    return "".join(reversed(parts)).strip()


def ambiguous(token: str) -> bool:
    """Whether a token's lattice has a path of letters beside the token itself: letters with other characters, a run of letters, or signs that stand for letters alone."""
    if _ODD.search(token):
        return not token.isalpha() or bool(_RUN.search(token))
    return sum(c in LEET for c in token) >= 2 and bool(_SIGNS.search(token))


def plain(token: str, lm: np.ndarray) -> str:
    """A token, restored if its lattice has more than one path. Rows of one sign at its end are ornament, and so is punctuation at its edges that stands for no letter; other edge signs go through the lattice."""
    t = _TAIL.sub("", token.lower())
    t = t.strip(".,;:?\"')[]{}<>") if not t.isalpha() else t
    return restore(t, lm) if ambiguous(t) else t
