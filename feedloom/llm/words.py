"""Words as rows of letter classes, and scores of words cached per worker.

Linear and kernel models here are additive over words or take their maximum, so a
word's contribution is computed once and then looked up. A kernel gets words of one
length, of any length, whole. Caches are bounded and emptied when full.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

CLASSES = 32
CELLS = 1 << 17  # letters that a kernel gets at once, or one word
CACHE_WORDS = 200_000
CACHE_LETTERS = 1 << 23
EDGE = 31  # stands before and after a word
_code: dict[int, int] = {}


def letter_class(c: int) -> int:
    """1-26 for a-z, 27-30 for other letters, 0 for anything else."""
    if 97 <= c <= 122:
        return c - 96
    return 27 + c % 4 if c > 127 and chr(c).isalpha() else 0


_LOW = np.array([letter_class(c) for c in range(0x250)], np.uint8)


def characters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def classes(chars: np.ndarray) -> np.ndarray:
    """letter_class of each character, as bytes."""
    low = chars < len(_LOW)
    codes = _LOW[np.where(low, chars, 0)]
    if not low.all():
        found, back = np.unique(chars[~low], return_inverse=True)
        codes[~low] = np.array([_code.setdefault(int(c), letter_class(int(c))) for c in found], np.uint8)[back]
    return codes


def codepoints(words: list[str]) -> np.ndarray:
    """The characters of equally long words, one row each, a zero on either side."""
    return np.pad(characters("".join(words)).reshape(len(words), -1).astype(np.int64), ((0, 0), (1, 1)))


def letters(words: list[str], edge: int = 1) -> np.ndarray:
    """Class codes of equally long words, one row each, `edge` edges on either side."""
    codes = classes(characters("".join(words))).reshape(len(words), -1).astype(np.int64)
    return np.pad(codes, ((0, 0), (edge, edge)), constant_values=EDGE)


def by_length(words: list[str]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        out.setdefault(len(w), []).append(i)
    return out


def bare(word: str) -> str:
    """A word's letters."""
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


def score_words(words: list[str], width: int, kernel: Callable[[np.ndarray], np.ndarray], rows_of: Callable[[list[str]], np.ndarray] = letters) -> np.ndarray:
    """kernel(rows of classes) for all words' letters; zeros for a word without any."""
    held = [bare(w) for w in words]
    out = np.zeros((len(words), width), np.float64)
    for n, rows in by_length(held).items():
        if n:
            step = max(1, CELLS // n)
            for low in range(0, len(rows), step):
                at = rows[low : low + step]
                out[at] = kernel(rows_of([held[i] for i in at]))
    return out


class Scores(dict):
    """word -> its row in `table`; rows of new words are computed together."""

    def __init__(self, width: int, kernel: Callable[[np.ndarray], np.ndarray], extra: Callable[[str], tuple], rows_of: Callable[[list[str]], np.ndarray] = letters) -> None:
        self.width, self.kernel, self.extra, self.rows_of = width, kernel, extra, rows_of
        self._reset()

    def _reset(self) -> None:
        self.clear()
        self.new: list[str] = []
        self.letters = 0
        self.table = np.empty((0, self.width))
        self.facts = np.empty((0, len(self.extra(""))))

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        self.new.append(word)
        return at

    def rows(self, words: list[str]) -> np.ndarray:
        """Row numbers of the words; their scores are in `table` until the next call."""
        if len(self) > CACHE_WORDS or self.letters > CACHE_LETTERS:
            self._reset()
        at = np.array(list(map(self.__getitem__, words)), np.int64)
        if self.new:
            self.letters += sum(map(len, self.new))
            self.table = np.concatenate((self.table, score_words(self.new, self.width, self.kernel, self.rows_of)))
            self.facts = np.concatenate((self.facts, np.array([self.extra(w) for w in self.new], float)))
            self.new = []
        return at
